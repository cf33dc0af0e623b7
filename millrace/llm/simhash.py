"""SimHash near-dedup with vantage-point trees over fingerprints.

The 64 bits are cut into parts, one more than the radius, so two fingerprints within the radius are equal in a part at least
(in two of one part more, for very many fingerprints). Each part has a tree whose metric is the Hamming distance of its bits,
where only ``reach`` has to be looked for: what the radius leaves to a part, which is none at that number of parts. At each
node a fingerprint is at home on one side of the median distance from the node's vantage point; by the triangle inequality
anything within reach can only be on the other side if that distance is within reach of the median, and only then the
fingerprint visits there too. Each leaf compares whole fingerprints of its visitors with those at home, going on with trees of
its own below. One tree over all bits (``parts=1``) gives the same links, but 64 random bits leave its bounds little to prune.
Trees are laid over a bounded sample, the fingerprints with the smallest hash. It decides how even the leaves are, never which
pairs are found: all pairs within the radius are compared.

Only distinct fingerprints are compared, and a leaf returns links to the smallest fingerprint of each group that it sees,
not pairs; groups across leaves are joined as connected components. A leaf or shard of more than TILE fingerprints is cut
into blocks by hash, and each pair of blocks is a task of its own.

Defined cases: NULL or blank text has fingerprint zero, which links like any other; repeated rows and equal texts share a
fingerprint; a component's id is its smallest doc_id, NULL only if all its doc_ids are NULL. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import kept
from millrace.llm.graph import components

SAMPLE = 4096
LEVELS = 13
LEAF = 4096
TILE = 16384


def own_key() -> Column:
    """A document, whatever its doc_id: one may stand for several texts."""
    return F.xxhash64("doc_id", "text")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, mins: int = 0) -> tuple[int, list[int], bytes]:
    """64 bits, set where over half of the shingles' hashes have them set, ``mins`` min-hashes of the shingles, and their sorted set.

    With ``mins`` all three are of the set of shingles, and without the set is empty. ASCII letters are lower-cased; text without words has fingerprint 0.
    """
    plain = b" ".join(text.lower().split())
    if not plain:
        return 0, [0] * mins, b""
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(plain))
    if len(starts) >= shingle:
        starts, ends = starts[:len(starts) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones, least, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), [2 ** 64 - 1] * mins, np.zeros(0, np.uint64)
    parts = (np.array([digest(plain[a:b], seed) for a, b in zip(starts[at:at + 65536].tolist(), ends[at:at + 65536].tolist(), strict=True)], np.uint64)
             for at in range(0, len(starts), 65536))
    if mins:
        held = np.unique(np.concatenate(list(parts)))
        parts = (held[at:at + 65536] for at in range(0, len(held), 65536))
    for hashes in parts:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = [min(m, int((hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & 2 ** 64 - 1 | 1)).min())) for j, m in enumerate(least)]
    total = len(held) if mins else len(starts)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big"), least, held.tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, mins: int = 0) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), keys (``mins`` min-hashes) and id: equal for equal sets of shingles, or fp without them.

    With ``mins`` also own, a hash of doc_id and text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", shingle, seed, mins) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [np.array(k, np.uint64).view(np.int64) for _, k, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([f for f, _, _ in found], np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(np.array([xxhash.xxh64_intdigest(s, seed) if mins else f for f, _, s in found], np.uint64).view(np.int64)), *batch.columns[2:]],
                ["doc_id", "fp", "keys", "id", *batch.schema.names[2:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = [own_key().alias("own")] if mins else []
    return docs.select("doc_id", "text", *own).mapInArrow(run, f"doc_id {kind}, fp long, keys array<long>, id long" + ", own long" * len(own))


def with_sets(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Rows with a column grams, the sorted set of the text's shingles, eight bytes each, in place of their last column, the text."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [fingerprint(x or b"", shingle, seed, 1)[2] for x in batch.column(len(names)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*names, "grams"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("grams", T.BinaryType())]))


def vantage_tree(points: np.ndarray, levels: int) -> list | None:
    """Nested [vantage, median, near, far]; None is a leaf. The vantage point is the one that spreads the others most."""
    if not levels or len(points) < 8:
        return None
    tried = points[:: max(1, len(points) // 16)]
    far = np.bitwise_count(tried[:, None] ^ points[None, :]).astype(np.int64)
    best = int(np.argmax(far.var(axis=1)))
    middle = int(np.median(far[best]))
    near = far[best] <= middle
    if near.all():
        return None
    return [int(tried[best]), middle, vantage_tree(points[near], levels - 1), vantage_tree(points[~near], levels - 1)]


def number_leaves(tree: list | None, first: int = 0) -> tuple:
    """The tree with numbered leaves, and the next number."""
    if tree is None:
        return first, first + 1
    near, first = number_leaves(tree[2], first)
    far, first = number_leaves(tree[3], first)
    return [tree[0], tree[1], near, far], first


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices that are at home there, indices that visit) for ``points``."""
    def down(node, own: np.ndarray, other: np.ndarray):
        if not len(own) and not len(other):
            return
        if isinstance(node, int):
            yield node, own, other
            return
        vantage, middle, near, far = node
        d, e = (np.bitwise_count(points[x] ^ np.uint64(vantage)).astype(np.int64) for x in (own, other))
        yield from down(near, own[d <= middle], np.append(own[(d > middle) & (d - radius <= middle)], other[e - radius <= middle]))
        yield from down(far, own[d > middle], np.append(own[(d <= middle) & (d + radius > middle)], other[e + radius > middle]))

    yield from down(tree, np.arange(len(points)), np.arange(0))


class Groups:
    """Groups of points 0 .. n-1 under links that arrive in arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            pairs = np.unique(np.maximum(a, b)[apart] * len(self.root) + np.minimum(a, b)[apart])
            a, b = pairs // len(self.root), pairs % len(self.root)
            np.minimum.at(self.root, a, b)
            while not np.array_equal(higher := self.root[self.root], self.root):
                self.root = higher


def link_within(points: np.ndarray, home: np.ndarray, visiting: np.ndarray, radius: int, groups: Groups, agree=None,
                mask: int = 2 ** 64 - 1, reach: int | None = None) -> None:
    """Link visiting points to home points within ``radius`` for which ``agree`` holds; both are indices of ``points``.

    Pairs within ``reach`` in the bits of ``mask`` are looked for; others may be passed over.
    """
    reach = radius if reach is None else reach
    seen = points & np.uint64(mask)
    stack = [(home, visiting)]
    while stack:
        home, visiting = stack.pop()
        if not len(home) or not len(visiting):
            continue
        if len(home) > 2048:
            tree = vantage_tree(seen[home[:: max(1, len(home) // 256)]], 1)
            if tree is not None:
                d, e = (np.bitwise_count(seen[x] ^ np.uint64(tree[0])).astype(np.int64) for x in (home, visiting))
                near = d <= tree[1]
                if 0.05 < near.mean() < 0.95:
                    stack += [(home[near], visiting[e - reach <= tree[1]]), (home[~near], visiting[e + reach > tree[1]])]
                    continue
        for at in range(0, len(home), 2048):
            block = home[at:at + 2048]
            for v in range(0, len(visiting), 256):
                some = visiting[v:v + 256]
                q, s = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[block][None, :]) <= radius)
                a, b = some[q], block[s]
                # what is linked meanwhile is not asked again
                while agree is not None and len(a):
                    apart = groups.root[a] != groups.root[b]
                    a, b = a[apart], b[apart]
                    held = agree(a[:4096], b[:4096])
                    groups.link(a[:4096][held], b[:4096][held])
                    a, b = a[4096:], b[4096:]
                groups.link(a, b)


def in_tiles(rows: DataFrame, key: str, overlap: bool = False, tile: int = TILE) -> DataFrame:
    """Rows (key, fp, home, ...) with __i, __j and visits: what a task (key, __i, __j) compares, its home rows with its visiting ones.

    Every row at home meets every other row of its key in some task. Keys of ``tile`` rows or less have one task; larger ones
    one for each pair of blocks. Without ``overlap`` all rows must be at home, and a pair of blocks is taken once.
    """
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > tile)
    large = size.select(key, F.ceil(F.col("__n") / tile).cast("int").alias("__b"))
    own = F.pmod(F.xxhash64("fp"), F.col("__b")).cast("int")
    every = F.sequence(F.lit(0), F.col("__b") - 1)
    as_home = F.transform(every, lambda x: F.struct(own.alias("i"), x.alias("j"), F.lit(True).alias("h"), (x == own).alias("v")))
    as_visit = F.transform(every, lambda x: F.struct(x.alias("i"), own.alias("j"), F.lit(False).alias("h"), F.lit(True).alias("v")))
    met = F.concat(F.filter(as_home, lambda x: F.lit(overlap) | (x["j"] >= x["i"])), F.filter(as_visit, lambda x: x["i"] < x["j"]))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("h"), F.lit(True).alias("v")))
    tasks = F.when(F.col("__b").isNull(), alone).when(F.col("home"), met).otherwise(as_visit)
    spread = rows.join(large, key, "left").withColumn("__x", F.explode(tasks)).drop("__b", "home")
    return spread.select("*", F.col("__x.i").alias("__i"), F.col("__x.j").alias("__j"), F.col("__x.h").alias("home"), F.col("__x.v").alias("visits")).drop("__x")


def parts_of(n: int, radius: int) -> list[int]:
    """Masks of which any two of ``n`` fingerprints within ``radius`` have equal bits in one at least."""
    equal = 1 if n <= 2 ** 25 else 2
    cuts = [round(64 * i / (radius + equal)) for i in range(radius + equal + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(some) for some in combinations(parts, equal)]


def similar_links(distinct: DataFrame, radius: int = 4, parts: int | None = None, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp): enough of them to connect all within ``radius``.

    ``parts`` cuts the bits into fewer parts than the radius asks for; then leaves overlap by ``radius // parts``.
    """
    n = distinct.count()
    if parts is None:
        masks, reach = parts_of(n, radius), 0
    else:
        cuts = [round(64 * i / parts) for i in range(parts + 1)]
        masks, reach = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)], radius // parts
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
    some = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 16 * 2 ** levels)).collect()
    sample, trees, leaves = np.array([r[0] for r in some], np.int64).view(np.uint64), [], [0]
    for mask in masks:
        tree, last = number_leaves(vantage_tree(sample & np.uint64(mask), levels), leaves[-1])
        trees.append(tree)
        leaves.append(last)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            for mask, tree in zip(masks, trees, strict=True):
                found = [(np.full(len(own) + len(other), at, np.int32), np.append(own, other), np.arange(len(own) + len(other)) < len(own))
                         for at, own, other in route(tree, signed.view(np.uint64) & np.uint64(mask), reach)]
                if found:
                    at, rows, home = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(signed[rows]), pa.array(home)], ["part", "fp", "home"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        mask = masks[int(np.searchsorted(leaves, rows["part"].iloc[0], side="right")) - 1]
        points, where = np.unique(rows["fp"].to_numpy(np.int64), return_inverse=True)
        home, visits = (np.unique(where[rows[x].to_numpy(bool)]) for x in ("home", "visits"))
        groups = Groups(len(points))
        link_within(points.view(np.uint64), home, visits, radius, groups, mask=mask, reach=reach)
        member = np.flatnonzero(groups.root != np.arange(len(points)))
        return pd.DataFrame({"a": points[member], "b": points[groups.root[member]]})

    dealt = kept(distinct.select("fp").mapInArrow(deal, "part int, fp long, home boolean"))
    return in_tiles(dealt, "part", reach > 0, tile).groupBy("part", "__i", "__j").applyInPandas(solve, "a long, b long")


def similar_sets(sets: list[bytes], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of shingles of each pair (a, b) have a Jaccard similarity of ``least`` or more; two empty sets have."""
    size = np.array([len(x) // 8 for x in sets], np.int64)
    out = np.zeros(len(a), bool)
    order = np.flatnonzero(np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
    while len(order):
        # so many pairs that their sets fit in memory
        some = order[:max(1, int(np.searchsorted(np.cumsum(size[a[order]] + size[b[order]]), 2_000_000)))]
        order = order[len(some):]
        rows, where = np.unique(np.append(a[some], b[some]), return_inverse=True)
        x, y = where[:len(some)], where[len(some):]
        flat, own = np.frombuffer(b"".join(sets[i] for i in rows), np.uint64), size[rows]
        kinds, number = np.unique(flat, return_inverse=True)
        begin, wide = np.cumsum(own) - own, len(kinds) + 1
        known = np.repeat(np.arange(len(rows)), own) * wide + number
        count = own[x]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[x], count)
        asked = np.repeat(y, count) * wide + number[at]
        hit = known[np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))] == asked if len(known) else np.zeros(0, bool)
        both = np.bincount(np.repeat(np.arange(len(some)), count), hit, len(some))
        out[some] = both >= least * (own[x] + own[y] - both) - 1e-9
    return out


class Priors:
    """For each row the keys smaller than that of its shard: a pair that has one in common meets, and is checked, in that shard."""

    def __init__(self, keys: list) -> None:
        size = np.array([len(k) for k in keys], np.int64)
        self.keys = np.zeros((len(keys), int(size.max(initial=0))), np.int64)
        self.there = np.arange(self.keys.shape[1]) < size[:, None]
        self.keys[self.there] = np.concatenate([np.asarray(k, np.int64) for k in keys]) if len(keys) else 0

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair has no smaller key in common."""
        out = np.ones(len(a), bool)
        keys, there = self.keys[b], self.there[b]
        for i in range(self.keys.shape[1]):
            out &= ~((self.keys[a, i][:, None] == keys) & there & self.there[a, i][:, None]).any(axis=1)
        return out

    def most_shared(self, home: np.ndarray, visiting: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Which rows of both sides have a key that half of each have, if there is one."""
        known, count = np.unique(self.keys[home][self.there[home]], return_counts=True)
        frequent = known[2 * count >= len(home)]
        if not len(frequent):
            return None
        has = [(self.keys[visiting] == k) & self.there[visiting] for k in frequent]
        n = [int(h.any(axis=1).sum()) for h in has]
        best = int(np.argmax(n))
        if 2 * n[best] < len(visiting):
            return None
        return ((self.keys[home] == frequent[best]) & self.there[home]).any(axis=1), has[best].any(axis=1)


def link_first_meetings(points: np.ndarray, priors: Priors, home: np.ndarray, visiting: np.ndarray, radius: int, groups: Groups, agree) -> None:
    """``link_within`` for the pairs that meet in no shard before. Rows with the same smaller key need not be held against each other at all."""
    stack = [(home, visiting)]
    while stack:
        home, visiting = stack.pop()
        if not len(home) or not len(visiting):
            continue
        both = priors.most_shared(home, visiting) if len(home) * len(visiting) > 1024 else None
        if both is not None:
            stack += [(home[both[0]], visiting[~both[1]]), (home[~both[0]], visiting)]
            continue
        link_within(points, home, visiting, radius, groups, agree)


def _in_shards(rows: DataFrame, out: str, radius: int, tile: int, check, answer, keys: DataFrame | None = None) -> DataFrame:
    """Rows (key, fp, id, prior, ...) by key: ``answer`` on the groups that pairs within ``radius`` and in ``check`` make.

    ``check(rest, a, b)`` says which pairs (indices) hold, ``rest`` being what the columns after prior hold. Shards of up to ``tile`` rows
    are streamed through tasks by the batch, larger ones are cut into tiles; ``keys`` are the keys of the rows, where that is cheaper to count.
    """
    more = rows.columns[4:]

    def agree_on(priors: Priors, rest: list, shift=None):
        def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x, y = (x, y) if shift is None else (shift[x], shift[y])
            out = priors.first_meeting(x, y)
            out[out] = check(rest, x[out], y[out])
            return out
        return agree

    def solve_tile(part: pd.DataFrame) -> pd.DataFrame:
        signed, ids, priors = part["fp"].to_numpy(np.int64), part["id"].to_numpy(np.int64), Priors(part["prior"].tolist())
        groups = Groups(len(part))
        link_first_meetings(signed.view(np.uint64), priors, *(np.flatnonzero(part[x].to_numpy(bool)) for x in ("home", "visits")), radius, groups,
                            agree_on(priors, [[bytes(x) for x in part[c]] for c in more]))
        a, b = answer(np.full(len(part), part["key"].iloc[0]), ids, groups.root)
        return pd.DataFrame({"a": a, "b": b})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shards(end: bool) -> pa.RecordBatch:
            joined = pa.Table.from_batches(held).combine_chunks()
            key = joined.column(0).to_numpy()
            whole = len(key) if end else int(np.searchsorted(key, key[-1]))
            held[:] = [] if end or whole == len(key) else joined.slice(whole).to_batches()
            cuts = np.append(np.flatnonzero(np.append(True, key[1:whole] != key[:max(0, whole - 1)])), whole) if whole else np.zeros(1, int)
            several = np.flatnonzero(np.diff(cuts) > 1)
            picked = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in several]) if len(several) else np.zeros(0, int)
            part = joined.take(pa.array(picked)) if len(picked) else joined.slice(0, 0)
            key, signed = key[picked], part.column(1).to_numpy()
            points, ids, priors = signed.view(np.uint64), part.column(2).to_numpy(), Priors(part.column(3).to_pylist())
            rest = [part.column(4 + k).to_pylist() for k in range(len(more))]
            groups = Groups(len(key))
            # neighbours settle shards of two; larger ones are searched
            near = np.flatnonzero((key[1:] == key[:-1]) & (np.bitwise_count(points[1:] ^ points[:-1]) <= radius))
            near = near[agree_on(priors, rest)(near, near + 1)]
            groups.link(near, near + 1)
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, int)
            for i in np.flatnonzero(np.diff(cuts) > 2):
                some = np.arange(cuts[i], cuts[i + 1])
                link_first_meetings(points, priors, some, some, radius, groups, agree_on(priors, rest))
            a, b = answer(key, ids, groups.root)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 16384:
                yield shards(False)
        if held:
            yield shards(True)

    large = kept((rows if keys is None else keys).groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > tile).select("key"))
    if large.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(solve, out)
    streamed = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    hot = rows.join(large, "key", "left_semi").withColumn("home", F.lit(True))
    return streamed.mapInArrow(solve, out).union(in_tiles(hot, "key", tile=tile).groupBy("key", "__i", "__j").applyInPandas(solve_tile, out))


def links_in_shards(docs: DataFrame, ids: DataFrame, radius: int, least: float, tile: int = TILE, shingle: int = 5, seed: int = 42) -> DataFrame:
    """Edges between texts (by id) within ``radius`` that have a min-hash in common and a Jaccard similarity of their sets of ``least``.

    ``ids`` has a row (id, fp, keys, own) per text. A pair is checked in the shard of its smallest common min-hash alone. A first pass over
    fingerprints finds which texts have a partner to be checked in which shard; only their sets of shingles, longer than the texts, are made,
    and go there and nowhere else.
    """
    pairs = ids.select("id", "fp", "own", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = kept(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1))
    listed = kept(pairs.join(sizes, "key").groupBy("id", "fp", "own").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    shards = listed.select(F.explode("keys").alias("key"), "fp", "id", F.col("keys").alias("__k")).withColumn(
        "prior", F.filter("__k", lambda k: k < F.col("key"))).drop("__k")

    def with_partner(key: np.ndarray, ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        return key[some], ids[some]

    def links(key: np.ndarray, ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        member = np.flatnonzero(root != np.arange(len(root)))
        return ids[member], ids[root[member]]

    met = _in_shards(shards, "a long, b long", radius, tile, lambda rest, x, y: np.ones(len(x), bool), with_partner)
    wanted = kept(met.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("at")).join(listed, "id"))
    texts = docs.select(own_key().alias("own"), "text").dropDuplicates(["own"]).join(wanted, "own").select("id", "fp", "keys", "at", "text")
    rows = with_sets(texts, shingle, seed).select(F.explode("at").alias("key"), "fp", "id", F.col("keys").alias("__k"), "grams").select(
        "key", "fp", "id", F.filter("__k", lambda k: k < F.col("key")).alias("prior"), "grams")
    sizes_met = wanted.select(F.explode("at").alias("key"))
    return _in_shards(rows, "a long, b long", radius, tile, lambda rest, x, y: similar_sets(rest[0], x, y, least), links, sizes_met)


def _grouped(docs: DataFrame, shingle: int, radius: int, seed: int, shards: int, least: float) -> DataFrame:
    """A row per document as of ``fingerprints``, with root (the component) and component_id."""
    marked = kept(fingerprints(docs, shingle, seed, shards))
    more = [F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("own").alias("own")] if shards else []
    distinct = kept(marked.groupBy("id").agg(F.min("doc_id").alias("first"), *more))
    if shards:
        edges = links_in_shards(docs, distinct, radius, least, shingle=shingle, seed=seed)
    else:
        edges = similar_links(distinct.select(F.col("id").alias("fp")), radius)
    reach = kept(components(edges))
    named = distinct.select("id", "first").join(reach.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.drop("keys").join(named.join(ids, "root").select("id", "root", "component_id"), "id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, shards: int = 0, least: float = 0.75) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    Without ``shards`` all fingerprints within ``radius`` are linked, through the vantage-point trees. Their bounds prune little
    once parts of the bits are as short as at larger radii (four bits at 14); for such radii ``shards`` min-hashes say
    which fingerprints are compared: texts whose shingles are similar by s share none with probability (1 - s) ** shards. Both only
    search: a link needs a Jaccard similarity of ``least`` of the sets of shingles, and only texts with equal sets are one text.
    """
    return _grouped(docs, shingle, radius, seed, shards, least).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 22, seed: int = 42, shards: int = 8, least: float = 0.8) -> DataFrame:
    """Of each component the document with the smallest doc_id, once if its row is repeated. Columns as in ``docs``.

    A doc_id may stand for several texts: each is a document. Documents with NULL doc_id stay.
    """
    found = _grouped(docs, shingle, radius, seed, shards, least).filter(F.col("doc_id").isNotNull())
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "own"))["own"].alias("__own")).select("__own")
    keyed = docs.filter(F.col("doc_id").isNotNull()).withColumn("__own", own_key())
    stay = keyed.join(first, "__own", "left_semi").dropDuplicates(["__own"]).drop("__own")
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))
