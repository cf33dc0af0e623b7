"""The conversation prefix trie against a brute-force trie and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from millrace.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string, pos string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def some_rows() -> list[tuple]:
    draw = random.Random(6)
    rows = []
    for c in [*range(0, 8), *range(100, 130), 200, 201, 250, 307, 399, -3, -100, -150]:
        for t in range(draw.choice([1, 2, 3, 4, 7])):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "日本", None, ""])))
    for c in range(500, 560):  # copies
        rows += [(c, t, "user", "same " * t) for t in range(4)]
    rows += [(600, t, "user", f"long {t}") for t in range(300)]
    rows += [(601, t, "user", f"long {t}" if t < 12 else f"other {t}") for t in range(60)]
    rows += [(610, None, "user", "first"), (610, 0, "user", "second"), (610, 0, "user", "second"), (610, 0, "a", "tie"), (None, 1, "user", "no id"), (611, None, None, None)]
    return [(*r, 9, "n", "p") for r in rows]


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    convs: dict[int, list] = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


def as_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members: dict[tuple, list[int]] = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for k, own in members.items():
        below = [n for n in members if n[:len(k)] == k]
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(k))))
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), sum(len(n) == len(k) + 1 for n in below), len(leaf),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_turns_are_numbered_in_order(table, rows):
    got = sorted((r["conv_id"], r["pos"], r["chars"]) for r in turns.numbered(table).collect())
    assert got == sorted((c, i + 1, len(t)) for c, own in in_order(rows).items() for i, (_, t) in enumerate(own))


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_trie_of_rebuilt_conversations(table, rows, most):
    assert nodes(turns.prefix_trie(turns.rebuilt(turns.numbered(table)), most)) == brute(as_rebuilt(in_order(rows)))


def test_trie_of_conversations_as_they_are(spark, rows):
    few = [r for r in rows if r[0] not in (600, 601)]
    assert nodes(turns.prefix_trie(turns.with_marks(turns.numbered(spark.createDataFrame(few, SCHEMA))), 5)) == brute(in_order(few))


def test_member_lists_over_blocks(spark, monkeypatch):
    draw = random.Random(1)
    members = [(rep, rep + 3 * i) for rep, n in ((1, 4000), (2, 1), (3, 512), (5, 1024)) for i in range(n)]
    draw.shuffle(members)
    got = dict(map(tuple, turns.member_hashes(spark.createDataFrame(members, "rep long, conv_id long").repartition(7)).collect()))
    for rep in (1, 2, 3, 5):
        assert got[rep] == hashlib.sha256(",".join(map(str, sorted(c for r, c in members if r == rep))).encode()).hexdigest()


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "a", 1, "n", "p")]):
        assert turns.prefix_trie(turns.rebuilt(turns.numbered(spark.createDataFrame(rows, SCHEMA)))).count() == 0


def test_op12_query_and_its_sql(spark, table, rows, tmp_path):
    table.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(queries.ORACLES["op12_prefix_trie"]).fetchall()
    got = nodes(queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)))
    assert got == brute(as_rebuilt(in_order(rows)))
    assert got == sorted(want, key=str)
