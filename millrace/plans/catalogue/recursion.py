"""Equivalent SQL of the change-point and peak queries: recursive common table expressions over lists.

Every fragment names its tables; ``key`` is the series column or empty. They state what the operators compute in the plainest way, one
candidate after the other, and are meant for tables of test size.
"""

from __future__ import annotations

from collections.abc import Sequence


def _k(key: str) -> str:
    return f"{key}, " if key else ""


def points(rows: str, key: str, features: Sequence[str], jump: int, target: str | None = None) -> str:
    """From rows (key, i, features) the table a: a row per series of lists over the admissible rows, idx and prefix sums."""
    up = f"OVER ({f'PARTITION BY {key}' if key else ''} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = {"q": " + ".join(f"{c} * {c}" for c in features), **{f"s_{c}": c for c in features}}
    if target:
        cols |= {"yn": f"CASE WHEN {target} IS NULL THEN 0 ELSE 1 END", "ys": f"coalesce({target}, 0)", "yq": f"coalesce({target} * {target}, 0)"}
    before = ", ".join(f"coalesce(sum({e}) {up}, 0) AS {c}" for c, e in cols.items())
    whole = ", ".join(f"sum({e}) AS {c}" for c, e in cols.items())
    group = f"GROUP BY {key}" if key else ""
    return (f"p AS (SELECT {_k(key)}i, {before} FROM {rows}), "
            f"pe AS (SELECT {_k(key)}i, {', '.join(cols)} FROM p WHERE i % {jump} = 0 UNION ALL SELECT {_k(key)}count(*) AS i, {whole} FROM {rows} {group}), "
            f"a AS (SELECT {_k(key)}list(i ORDER BY i) AS idx, {', '.join(f'list({c} ORDER BY i) AS {c}' for c in cols)} FROM pe {group})")


def _gain(features: Sequence[str], a: str, j: str, b: str) -> str:
    left, right = f"(idx[{j}] - idx[{a}])", f"(idx[{b}] - idx[{j}])"
    apart = " + ".join(f"pow((s_{c}[{j}] - s_{c}[{a}]) / {left} - (s_{c}[{b}] - s_{c}[{j}]) / {right}, 2)" for c in features)
    return f"{left} * {right}::DOUBLE / ({left} + {right}) * ({apart})"


def _arrays(features: Sequence[str]) -> str:
    return ", ".join(["idx", *[f"s_{c}" for c in features]])


def exact(key: str, features: Sequence[str], min_size: int, penalties: Sequence[float]) -> str:
    """sg: segments (key, penalty, regime, start_idx, end_idx) of least cost, from a."""
    spread = " + ".join(f"pow(s_{c}[e + 1] - s_{c}[j], 2)" for c in features)
    costs = (f"list_transform(range(1, e + 1), lambda j: CASE WHEN idx[e + 1] - idx[j] >= {min_size} THEN "
             f"best[j] + q[e + 1] - q[j] - ({spread}) / (idx[e + 1] - idx[j]) ELSE 'inf'::DOUBLE END)")
    tried = ", ".join(f"({float(p)}::DOUBLE)" for p in penalties)
    return (f"dp AS (SELECT {_k(key)}penalty, 1 AS e, [-penalty] AS best, [0::BIGINT] AS back, q, {_arrays(features)} FROM a, (VALUES {tried}) t(penalty) "
            f"UNION ALL SELECT {_k(key)}penalty, e + 1, list_append(best, list_min(costs) + penalty), "
            f"list_append(back, CASE WHEN list_min(costs) = 'inf'::DOUBLE THEN 1 ELSE list_position(costs, list_min(costs)) END), q, {_arrays(features)} "
            f"FROM (SELECT *, {costs} AS costs FROM dp WHERE e < len(idx))), "
            f"wk AS (SELECT {_k(key)}penalty, e AS z, back, idx FROM dp WHERE e = len(idx) UNION ALL SELECT {_k(key)}penalty, back[z], back, idx FROM wk WHERE z > 1), "
            f"sb AS (SELECT {_k(key)}penalty, idx[z] AS cut FROM wk), {_segments(key)}")


def _segments(key: str) -> str:
    return (f"sg AS (SELECT * FROM (SELECT {_k(key)}penalty, (row_number() OVER w - 1)::INT AS regime, cut AS start_idx, lead(cut) OVER w AS end_idx FROM sb "
            f"WINDOW w AS (PARTITION BY {_k(key)}penalty ORDER BY cut)) WHERE end_idx IS NOT NULL)")


def _by_strength(key: str, penalties: Sequence[float]) -> str:
    """sg from cuts st (key, cut, strength): those stronger than the penalty."""
    tried = ", ".join(f"({float(p)}::DOUBLE)" for p in penalties)
    return (f"tr(penalty) AS (VALUES {tried}), sb AS (SELECT {_k(key)}penalty, cut FROM st, tr WHERE strength > penalty "
            f"UNION ALL SELECT {_k(key)}penalty, unnest([0, list_max(idx)]) AS cut FROM a, tr), {_segments(key)}")


def binary(key: str, features: Sequence[str], min_size: int, penalties: Sequence[float]) -> str:
    """sg of greedy binary segmentation for each penalty, each by its own recursion over segments."""
    gains = (f"list_transform(range(a + 1, b), lambda j: CASE WHEN idx[j] - idx[a] >= {min_size} AND idx[b] - idx[j] >= {min_size} THEN "
             f"{_gain(features, 'a', 'j', 'b')} ELSE -1 END)")
    tried = ", ".join(f"({float(p)}::DOUBLE)" for p in penalties)
    inner = f"SELECT {_k(key)}penalty, 1::BIGINT AS a, len(idx)::BIGINT AS b, {_arrays(features)} FROM a, (VALUES {tried}) t(penalty)"
    split = (f"SELECT {_k(key)}penalty, ab[1] AS a, ab[2] AS b, {_arrays(features)} FROM (SELECT *, unnest([[a, a + list_position(gs, list_max(gs))], "
             f"[a + list_position(gs, list_max(gs)), b]]) AS ab FROM bs WHERE list_max(gs) > penalty)")
    return (f"bs AS (SELECT *, {gains} AS gs FROM ({inner}) UNION ALL SELECT *, {gains} AS gs FROM ({split})), "
            f"sb AS (SELECT {_k(key)}penalty, idx[a + list_position(gs, list_max(gs))] AS cut FROM bs WHERE list_max(gs) > penalty "
            f"UNION ALL SELECT DISTINCT {_k(key)}penalty, unnest([0, list_max(idx)]) AS cut FROM bs), {_segments(key)}")


def binary_count(features: Sequence[str], min_size: int, n: int) -> str:
    """sg of one series: ``n`` times the best split of all."""
    lo, hi = "list_max(list_filter(cuts, lambda x: x < j))", "list_min(list_filter(cuts, lambda x: x > j))"
    gains = (f"list_transform(range(1, len(idx) + 1), lambda j: CASE WHEN NOT list_contains(cuts, j) AND idx[j] - idx[{lo}] >= {min_size} AND idx[{hi}] - idx[j] >= {min_size} "
             f"THEN {_gain(features, lo, 'j', hi)} ELSE -1 END)")
    return (f"bc AS (SELECT 0 AS r, [1::BIGINT, len(idx)::BIGINT] AS cuts, {_arrays(features)} FROM a UNION ALL SELECT r + 1, list_append(cuts, list_position(gs, list_max(gs))), {_arrays(features)} "
            f"FROM (SELECT *, {gains} AS gs FROM bc WHERE r < {n}) WHERE list_max(gs) >= 0), "
            f"sb AS (SELECT 0 AS penalty, idx[unnest(cuts)] AS cut FROM (SELECT * FROM bc ORDER BY r DESC LIMIT 1)), {_segments('')}")


def window(gains: str, features: Sequence[str], min_size: int, jump: int, width: int, penalties: Sequence[float]) -> str:
    """sg of sliding-window detection in one series, from ``gains`` (row_index, gain): candidates from the highest down, until one fails."""
    order = max(max(width, 2 * min_size) // (2 * jump), 1)
    return (f"gs AS (SELECT row_index AS i, gain, row_number() OVER (ORDER BY row_index) - 1 AS slot, count(*) OVER () AS m FROM {gains}), "
            f"pk AS (SELECT x.i, x.gain FROM gs x WHERE NOT EXISTS (SELECT 1 FROM gs y WHERE y.i <> x.i AND y.gain >= x.gain "
            f"AND least((y.slot - x.slot + y.m) % y.m, (x.slot - y.slot + y.m) % y.m) <= {order})), "
            f"nb AS (SELECT i, gain, coalesce((SELECT max(y.i) FROM pk y WHERE y.i < x.i AND y.gain > x.gain), 0) AS lo, "
            f"coalesce((SELECT min(y.i) FROM pk y WHERE y.i > x.i AND y.gain >= x.gain), (SELECT list_max(idx) FROM a)) AS hi FROM pk x), "
            f"ng AS (SELECT i, gain, {_gain(features, 'lp', 'ip', 'hp')} AS g FROM (SELECT i, gain, list_position(idx, lo) AS lp, list_position(idx, i) AS ip, list_position(idx, hi) AS hp, {_arrays(features)} FROM nb, a)), "
            f"st AS (SELECT i AS cut, min(g) OVER (ORDER BY gain DESC, i DESC) AS strength FROM ng), {_by_strength('', penalties)}")


def measures(key: str) -> str:
    """tn: number of segments, mean length and explained share of the target per penalty, from sg and a with a target."""
    on = f"sg.{key} = a.{key}" if key else "true"
    at = {x: f"({x}[list_position(idx, end_idx)] - {x}[list_position(idx, start_idx)])" for x in ("yn", "ys", "yq")}
    lead = f"sg.{key}, " if key else ""
    return (f"sy AS (SELECT {lead}penalty, end_idx, {', '.join(f'{e} AS {x}' for x, e in at.items())} FROM sg JOIN a ON {on}), "
            f"tn AS (SELECT {_k(key)}penalty, count(*)::INT AS n_regimes, max(end_idx) / count(*)::DOUBLE AS avg_seg_len, "
            f"CASE WHEN sum(yq) - pow(sum(ys), 2) / sum(yn) <= 0 THEN 0 ELSE greatest(0, 1 - sum(yq - CASE WHEN yn > 0 THEN ys * ys / yn ELSE 0 END) / (sum(yq) - pow(sum(ys), 2) / sum(yn))) END AS r2_target "
            f"FROM sy GROUP BY {_k(key)}penalty)")


def picked(key: str, low: int, high: int, length: float, tried: str = "tn") -> str:
    """ch: the penalty of each series, from the measures of what was tried: the best explained share among reasonable segmentations, fewer regimes on ties, else the median."""
    group = f"GROUP BY {key}" if key else ""
    good = f"FILTER (n_regimes BETWEEN {low} AND {high} AND avg_seg_len >= {length})"
    return f"ch AS (SELECT {_k(key)}coalesce(arg_min(penalty, (-r2_target, n_regimes, penalty)) {good}, quantile_cont(penalty, 0.5)) AS penalty FROM {tried} {group})"


def timed(rows: str, key: str) -> str:
    """Columns of segments sg with times of rows (key, i, ts): a SELECT."""
    on = f"AND x.{key} = sg.{key} AND y.{key} = sg.{key}" if key else ""
    lead = f"sg.{key}, " if key else ""
    return (f"SELECT {lead}regime, start_idx, end_idx, x.ts AS start_time, y.ts AS end_time, end_idx - start_idx AS n_samples FROM sg "
            f"JOIN {rows} x ON x.i = start_idx JOIN {rows} y ON y.i = end_idx - 1 {on}")


def thinned(tops: str, key: str, distance: int) -> str:
    """th: of peaks (key, i, v) those that remain from the highest down (the later one on ties), ``distance`` apart."""
    first = f"list({{'i': i, 'v': v}} ORDER BY v DESC, i DESC) AS l"
    group = f"GROUP BY {key}" if key else "HAVING count(*) > 0"
    return (f"tl AS (SELECT {_k(key)}NULL::STRUCT(i BIGINT, v DOUBLE) AS one, l FROM (SELECT {_k(key)}{first} FROM {tops} {group}) "
            f"UNION ALL SELECT {_k(key)}l[1], list_filter(l, lambda x: abs(x.i - l[1].i) >= {distance}) FROM tl WHERE len(l) > 0), "
            f"th AS (SELECT {_k(key)}one.i AS i, one.v AS v FROM tl WHERE one IS NOT NULL)")


def tops(rows: str, key: str) -> str:
    """tp: local maxima (key, i, v) of rows (key, i, v), flat tops by their middle row; NULL is above nothing."""
    part = f"PARTITION BY {key}" if key else ""
    return (f"tr1 AS (SELECT *, lag(v) OVER ({part} ORDER BY i) AS pv FROM {rows}), "
            f"tr2 AS (SELECT {_k(key)}i, v, sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER ({part} ORDER BY i) AS run FROM tr1), "
            f"tr3 AS (SELECT {_k(key)}run, min(i) AS i0, max(i) AS i1, any_value(v) AS v FROM tr2 GROUP BY {_k(key)}run), "
            f"tr4 AS (SELECT *, lag(v) OVER ({part} ORDER BY i0) AS vl, lead(v) OVER ({part} ORDER BY i0) AS vr FROM tr3), "
            f"tp AS (SELECT {_k(key)}((i0 + i1) // 2)::BIGINT AS i, v FROM tr4 WHERE v > vl AND v > vr)")
