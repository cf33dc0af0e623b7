"""Corpus operators against brute force, SQL and planted cases, on small tables with every awkward kind of row."""

from __future__ import annotations

import hashlib
import random
import struct
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, passages, pieces, quality, queries, repeats, search, simhash, templates, urls
from millrace.llm.graph import components
from tests.compare import differences

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, start int, fp string, root string"


def texts() -> list[str | None]:
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeéß日") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    prose = [" ".join(draw.choice(words) for _ in range(draw.randint(60, 160))) for _ in range(30)]
    shared = " ".join(draw.choice(words) for _ in range(70))
    out = prose[:12] + [p + "\n" + shared + "\n" + q for p, q in zip(prose[12:18], prose[18:24], strict=True)]
    out += [f"Posted by user{i} on 2024 in news\n{p}" for i, p in enumerate(prose[:12])]
    near = prose[25].split()
    out += [" ".join(near), " ".join([*near[:40], "changed", *near[41:]])]
    out += [None, "", " ", "\n\n", "one", "a b c", "# $ % & x", prose[0], prose[0], prose[0], "x" * 5000, "y z " * 3000, "a\tb\rc\x0bd\x0ce ▁ f", "Ü MIXED Case\n" * 3]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", ["s1", "s2", "é", None][i % 4], None if t is None else len(t), "z", None, 1, "f", "r") for i, t in enumerate(texts())]
    return found + [found[0], found[1], (None, "null id " * 20, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sql(name: str, rows) -> pd.DataFrame:
    con = duckdb.connect()
    documents = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("documents", documents)
    return con.execute(queries.ORACLES[name]).df()


def sane(rows) -> list[tuple]:
    """Rows on which the SQL's own ids are distinct."""
    return [r for r in {r[0]: r for r in rows}.values() if r[0] is not None]


def test_quality_measures(spark, rows):
    clean = sane(rows)
    got = quality.quality_rules(spark.createDataFrame(clean, SCHEMA)).drop("__host", "removed_lines").toPandas()
    assert differences(got, sql("op9_quality_rules", clean)) is None


def test_quality_removes_lines_of_a_host_but_the_first(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(15)]
    rows = [(i, f"All rights reserved here\n{b}", "s") for i, b in enumerate(body)] + [(i, "All rights reserved here\nshort tail of ten other words to stay one two", "t") for i in range(20, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in quality.keep_good(docs).collect()}
    assert out[0].startswith("All rights") and all(out[i] == body[i] for i in range(1, 15)) and out[20].startswith("All rights")


def test_line_templates(spark, rows):
    clean = [r for r in sane(rows) if r[1] is not None]
    got = templates.drop_recurring_lines(spark.createDataFrame(clean, SCHEMA), counts=True).toPandas()
    assert got.n_dropped.sum() >= 11  # the lines of one template, but the first
    assert differences(got, sql("op3_line_templates", clean)) is None


def test_a_line_whose_only_free_token_varies_is_a_template(spark):
    clean = [(i, f"Written by the author {name}\nown text number {name}", "en", "s", 1) for i, name in enumerate("abcdefghijkl")]
    got = templates.drop_recurring_lines(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long"), counts=True).toPandas()
    assert differences(got, sql("op3_line_templates", clean)) is None
    assert got.n_dropped.sum() == 11


def test_mixing(spark, rows):
    clean = sane(rows)
    docs = spark.createDataFrame(clean, SCHEMA)
    got = mixing.mixed_sizes(docs).toPandas()
    assert differences(got, sql("op4_mix_sources", clean)) is None
    assert (got.taken <= 2 * got["size"]).all()
    taken = mixing.mix_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    for r in got[got["size"] > 0].itertuples():
        assert taken.get(r.doc_id, 0) * r.size == r.taken


def test_a_fractional_maximum_keeps_its_fraction(spark):
    rows = [(i, "w " * 10, "s") for i in range(50)] + [(100 + i, "w " * 10, "t") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_sizes(docs, weights=(1, 1), max_epochs=1.5).toPandas()
    assert set(got["target"]) == {750.0} and (got["taken"] <= 2 * got["size"]).all()
    assert got.assign(s=got["doc_id"] >= 100).groupby("s")["taken"].sum().tolist() == [750, 750]


def test_fingerprints_and_components(docs, rows):
    def one(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [one(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    ids = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    want = Counter((r[0], p, ids[g]) for r, p, g in zip(rows, prints, root, strict=True))
    got = Counter((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize(("parts", "tile"), [(None, 16384), (None, 40), (1, 16384), (1, 40), (2, 40), (3, 16384)])
def test_trees_find_all_pairs(spark, parts, tile):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2 ** 63, 600, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << draw.choice(64, k, replace=False).astype(np.uint64)) for k in draw.integers(1, 7, 400)]
    points = np.unique(np.concatenate([base, base[:400] ^ np.array(flips, np.uint64), base[:100] ^ np.uint64(0b11110000)])).view(np.int64)
    edges = simhash.similar_links(spark.createDataFrame([(int(p),) for p in points], "fp long"), parts=parts, leaf=64, tile=tile)
    got = components(edges).collect()
    far = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :])
    groups = simhash.Groups(len(points))
    groups.link(*np.nonzero(far <= 4))
    want = {int(points[i]): int(points[groups.root == groups.root[i]].min()) for i in range(len(points)) if (groups.root == groups.root[i]).sum() > 1}
    assert {r.node: r.root for r in got} == want


@pytest.mark.parametrize("n", [1000, 2 ** 30])
def test_parts_hold_every_pair_within_the_radius(n):
    draw = np.random.default_rng(3)
    masks = simhash.parts_of(n, 4)
    for _ in range(2000):
        apart = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        assert any(not apart & m for m in masks)


def test_a_shard_of_many_texts_is_cut_into_tiles(spark):
    draw = np.random.default_rng(11)
    common = " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(120):
        own = common + " " + " ".join(f"w{x}" for x in draw.integers(0, 10 ** 6, 15))
        rows += [(3 * i, own), (3 * i + 1, own + " end"), (3 * i + 2, own if i % 2 else None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = simhash.fingerprints(docs, 5, mins=6).dropDuplicates(["id"]).cache()
    assert marked.selectExpr("explode(keys) AS k", "fp").distinct().groupBy("k").count().agg({"count": "max"}).first()[0] > 100
    whole, cut = ({(r.node, r.root) for r in components(simhash.links_in_shards(docs, marked, 14, 0.75, tile)).collect()} for tile in (10 ** 6, 16))
    assert cut == whole and len(whole) > 100


@pytest.mark.parametrize("tile", [10 ** 6, 60])
def test_links_in_shards_equal_brute_force(spark, tile):
    """Groups of near copies with many min-hashes in common, each pair checked in one shard only."""
    draw = np.random.default_rng(23)
    rows = []
    for g in range(6):
        own = [f"g{g}w{x}" for x in draw.integers(0, 10 ** 6, 90)]
        for _ in range(60):
            other = list(own)
            for c in draw.choice(90, int(draw.integers(0, 16)), replace=False):
                other[c] = f"n{draw.integers(0, 10 ** 6)}"
            rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = simhash.fingerprints(docs, 5, mins=8).dropDuplicates(["id"]).cache()
    texts = {r.id: (r.fp % 2 ** 64, set(r["keys"]), {tuple(rows[r.doc_id][1].split()[k:k + 5]) for k in range(86)}) for r in marked.collect()}
    ids = list(texts)
    groups = simhash.Groups(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            (x, k, s), (y, m, t) = texts[a], texts[ids[j]]
            if bin(x ^ y).count("1") <= 18 and k & m and len(s & t) >= 0.7 * len(s | t):
                groups.link(np.array([i]), np.array([j]))
    want = {frozenset(ids[i] for i in np.flatnonzero(groups.root == r)) for r in set(groups.root.tolist()) if (groups.root == r).sum() > 1}
    got: dict[int, set] = {}
    for r in components(simhash.links_in_shards(docs, marked, 18, 0.7, tile)).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert 50 < sum(map(len, want)) < len(ids) - 20 and {frozenset(g) for g in got.values()} == want


def test_one_doc_id_with_several_texts(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "xyz")
    rows = [(1, one, "a"), (1, two, "a"), (2, three, "a"), (2, three, "b"), (3, one + " more", "a"), (None, one, "a"), (None, two, "a")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, own string"))
    assert left.columns == ["doc_id", "text", "own"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, one), (1, two), (2, three), (None, one), (None, two)], key=str)


def test_near_dedup_decides_by_exact_similarity(spark):
    draw = np.random.default_rng(17)
    rows, pairs = [], {}
    for i in range(300):
        own = [f"w{x}" for x in draw.integers(0, 10 ** 9, 104)]
        other, changed = list(own), draw.choice(20, int(draw.integers(1, 7)), replace=False)
        for c in changed:
            other[5 * c + 2] = f"n{draw.integers(0, 10 ** 9)}"
        a, b = ({tuple(t[k:k + 5]) for k in range(100)} for t in (own, other))
        pairs[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert {i for i, s in pairs.items() if 2 * i + 1 not in left} == {i for i, s in pairs.items() if s >= 0.8}
    assert all(2 * i in left for i in pairs) and {s >= 0.8 for s in pairs.values()} == {True, False}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("many", [4096, 1])
def test_repeated_bytes(docs, rows, many):
    size = 60
    counts = Counter(b[i:i + size] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - size + 1))
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if counts[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[r[0], len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()] += 1
    got = repeats.without_repeats(docs, size, gram=16, many=many).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == want


@pytest.mark.parametrize("length", [60, 200, 600, 1000])
def test_repeated_bytes_of_any_length(spark, length):
    """A block that two texts share, a copy within a text of some 3 MB, and a repeat across the border of a piece."""
    draw = random.Random(length)
    noise = lambda n: bytes(draw.choices(range(97, 123), k=n))
    block, inner, edge = noise(3000), noise(1500), noise(2500)
    long = noise(900_000) + inner + noise(2 * repeats.PIECE - 900_000 - 1500 - 1200) + edge + noise(1_800_000) + inner + noise(4000)
    texts = [noise(500) + block + noise(271), block + noise(40), long, noise(77) + edge, noise(2000), noise(length - 1)]
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    spans = {i: [(x.start, x.end) for x in r.spans] for i, r in got.items()}
    at = [long.index(inner), long.rindex(inner), long.index(edge)]
    assert spans == {0: [(500, 3500)], 1: [(0, 3000)], 2: sorted([(at[0], at[0] + 1500), (at[1], at[1] + 1500), (at[2], at[2] + 2500)]), 3: [(77, 2577)], 4: [], 5: []}
    assert got[0].kept == texts[0][:500] + texts[0][3500:]


def test_repeated_bytes_refuses_lengths_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="length"):
        repeats.without_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 40_000)


def unigram_model(v: pieces.Vocabulary) -> bytes:
    """The vocabulary as a model file of the published library, with our scores."""
    def number(x: int) -> bytes:
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    put = lambda n, b: number(n << 3 | 2) + number(len(b)) + b
    flag = lambda n, x: number(n << 3) + number(x)
    byte_ids, out = set(v.byte_ids.tolist()), b""
    for i, p in enumerate(v.pieces):
        kind = 1 if v.normal[i] else 6 if i in byte_ids else 2 if i == 0 else 3
        out += put(1, put(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", v.scores[i] if v.normal[i] else 0) + flag(3, kind))
    return out + put(2, flag(3, 1) + flag(24, 0) + flag(35, 1)) + put(3, put(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))


def test_pieces_agree_with_the_published_library(docs, rows):
    library = pytest.importorskip("sentencepiece")
    v = pieces.load_vocabulary(VOCABULARY)
    model, own = library.SentencePieceProcessor(model_proto=unigram_model(v)), pieces.Segmenter(v)
    found = pieces.encoded(docs, own)
    want = Counter((r[0], None if r[1] is None else tuple(model.encode(r[1]))) for r in rows)
    got = found.collect()
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids)) for r in got) == want
    assert sum(not r.round_trip for r in got) == 1  # the text that holds a marker
    back = Counter((r.doc_id, r.text) for r in pieces.decoded(found, own).collect())
    assert back == Counter((r[0], r[1] and r[1].replace("▁", " ")) for r in rows)
    counts = Counter((r.doc_id, r.n_tokens) for r in pieces.token_counts(docs, own).collect())
    assert counts == Counter((r.doc_id, r.n_pieces) for r in got)


def test_long_part_like_short_ones():
    own = pieces.Segmenter(pieces.load_vocabulary(VOCABULARY))
    part = " thisisaverylongwordé日本" * 1
    assert list(own._viterbi([part.replace(" ", "▁")]))[0] == own._one(part.replace(" ", "▁"))


def test_top_k(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, draw.normal(0, .2, 8).astype(float).tolist(), 0, 1) for i in range(300)]
    vectors += [(i, [0.5] * 8, 0, 1) for i in range(300, 340)] + [(20, vectors[20][1], 0, 1), (400, None, 0, 1), (401, [1.0, None], 0, 1), (402, [float("nan")] * 8, 0, 1), (403, [float("inf")] * 8, 0, 1), (420, [], 0, 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score int, cell int").repartition(4)
    got = sorted(map(tuple, search.top_k(table, F.col("vec_id") % 20 == 0, n_pivots=8).collect()))
    good = [(i, np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v)))) for i, v, _, _ in vectors if v is not None and None not in v and np.isfinite(v).all()]
    want, seen = [], set()
    for q, (i, v) in enumerate(good):
        if i % 20 or (i, v.tobytes()) in seen:
            continue
        seen.add((i, v.tobytes()))
        best = sorted((-int(v @ w), j) for c, (j, w) in enumerate(good) if c != q)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert search.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_url_aliases(spark):
    link = '<head><link rel="canonical" href="{}"></head>'.format
    fresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    pages = [
        (1, "http://A.example.org/es/1", None), (2, "http://b.example.net/x", link("http://a.example.org/es/1")), (3, "http://c.net/y#top", fresh("http://b.example.net/x")),
        (4, "http://d.net/fr/", link("//e.com/fr/z")), (5, "http://f.net/q", link("http://d.net/fr/")), (6, "http://f.net/q", link("http://g.com/de/")),
        (7, "http://g.com/de/", None), (8, "mailto:x", "<p>"), (9, None, None), (10, "http://sub.example.org/en/12?x", None), (11, "http://h.net/a/b", link("../c"))]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    table = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table, rules).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == got[6][2:] == (None, "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][2:] == ("example.org/en/1", "block")
    assert urls.judge(table.limit(0), rules).count() == 0


def test_near_passages(spark, docs):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(120)]
    changed = list(shared)
    changed[60] = "other"
    alone = [[word() for _ in range(200)] for _ in range(5)]
    rows = [(1, alone[0] + shared + alone[1]), (2, alone[2][:30] + changed), (3, alone[3]), (4, alone[4] + shared[:40])]
    found = passages.near_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"))
    got = {(r.doc_id, r.partner_id): (r.start, r.end) for r in found.collect()}
    assert set(got) == {(1, 2), (2, 1)}
    assert abs(got[1, 2][0] - 200) <= 8 and abs(got[1, 2][1] - 320) <= 8 and abs(got[2, 1][0] - 30) <= 8 and abs(got[2, 1][1] - 150) <= 8
    own = passages.near_passages(docs).collect()
    assert {12, 13, 14, 15, 16, 17} <= {r.doc_id for r in own} and all(r.end - r.start >= 50 for r in own)


def hot_phrase() -> list[tuple[int, str]]:
    """A phrase too short for a passage in all documents; around it every two documents have a passage in common, but for a word."""
    draw = random.Random(21)
    words = lambda n: ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    phrase, rows = words(40), []
    for i in range(30):
        left, right = words(24), words(24)
        rows += [(2 * i + j, " ".join(words(80) + left[:3] + words(1) + left[4:] + phrase + right[:20] + words(1) + right[21:] + words(80))) for j in range(2)]
    return rows


def test_blocks_of_a_hot_min_hash_lose_no_pair(spark):
    table = spark.createDataFrame(hot_phrase(), "doc_id long, text string")
    few, all_in_one = ({(r.doc_id, r.start, r.end) for r in passages.near_passages(table, many=many).collect()} for many in (4, 4096))
    assert few == all_in_one and {i for i, _, _ in few} == set(range(60))


def test_matched_windows_are_held_against_all_others():
    draw = np.random.default_rng(4)
    word = lambda n: draw.integers(1, 2 ** 32, n, dtype=np.uint32)
    middle, share = 60, 8 / 9
    left, right, core = word(55), word(55), word(1)
    leader, a, b = np.concatenate([left, word(5), core, word(60)]), np.concatenate([left, word(5), core, right, word(5)]), np.concatenate([word(60), core, right, word(5)])
    rows = [leader, a, b] + [np.concatenate([word(60), core, word(60)]) for _ in range(3)]
    windows = []
    for _ in range(14):  # near copies of one text and of parts of it
        own = a.copy()
        own[draw.integers(0, 121, draw.integers(0, 12))] = word(1)[0]
        cut = int(draw.integers(0, 121))
        own[:cut // 2 * int(draw.integers(0, 2))] = word(1)[0]
        windows.append(own)
    for some in (rows, rows[::-1], windows, windows[:5]):
        keys, n = np.arange(len(some)) // 2 * (len(some) > 6) + np.arange(len(some)) * (len(some) <= 6), len(some)
        got = passages.match_groups(np.zeros(n, int), keys, np.zeros(n, int), np.full(n, middle), [x.tobytes() for x in some], 46, share)
        want = set()
        for i, x in enumerate(some):
            hits = [np.isin(x, y) for j, y in enumerate(some) if keys[i] != keys[j]]
            sums = [np.append(0, np.cumsum(h)) for h in hits]
            spans = [(p, q) for s in sums for p in range(middle + 1) for q in range(max(p + 46, middle + 1), 122) if s[q] - s[p] >= share * (q - p) - 1e-9]
            if spans:
                want.add((int(keys[i]), min(p for p, _ in spans), max(q for _, q in spans)))
        assert {tuple(map(int, r[:3])) for r in got} == want
    assert len(want) > 0


@pytest.mark.parametrize("seed", range(6))
def test_classes_of_equal_windows_stand_for_their_members(seed):
    """Keys repeated within a class and across classes, several middles and groups: every window has the span of its matches with other documents."""
    draw = np.random.default_rng(seed)
    word = lambda n: draw.integers(1, 2 ** 32, n, dtype=np.uint32)
    share, rows = 8 / 9, []
    for g in range(3):
        base = word(121)
        kinds = []
        for _ in range(4):
            own = base.copy()
            own[draw.integers(0, 121, draw.integers(0, 14))] = word(1)[0]
            own[:int(draw.integers(0, 50))] = word(1)[0]
            cut = int(draw.integers(0, 14))
            kinds.append((60 - cut, own[cut:]))
        for _ in range(14):
            middle, body = kinds[draw.integers(0, 4)]
            rows.append((g, int(draw.integers(0, 5)), int(draw.integers(0, 900)), middle, body))
    group, keys, starts, middles = (np.array([r[k] for r in rows]) for k in range(4))
    got = passages.match_groups(group, keys, starts, middles, [r[4].tobytes() for r in rows], 46, share)
    want, partners = Counter(), {}
    for g, key, start, middle, x in rows:
        spans = []
        for h, other, _, _, y in rows:
            if g == h and key != other:
                s = np.append(0, np.cumsum(np.isin(x, y)))
                own = [(p, q) for p in range(middle + 1) for q in range(max(p + 46, middle + 1), len(x) + 1) if s[q] - s[p] >= share * (q - p) - 1e-9]
                spans += own
                if own:
                    partners.setdefault((g, key), set()).add(other)
        if spans:
            want[key, start + min(p for p, _ in spans), start + max(q for _, q in spans)] += 1
    assert Counter(tuple(map(int, r[:3])) for r in got) == want and want
    assert all(any(int(r[3]) in found for (_, key), found in partners.items() if key == r[0]) and r[3] != r[0] for r in got)


def crowd(n: int) -> list[tuple[int, np.ndarray]]:
    """Windows around one phrase too short for a passage: every sixth is a near copy of one text or of part of it, the others have nothing else in common."""
    draw = np.random.default_rng(12)
    word = lambda n: draw.integers(1, 2 ** 32, n, dtype=np.uint32)
    base, rows = word(121), []
    for i in range(n):
        own, cut = base.copy(), int(draw.integers(0, 14))
        own[draw.integers(0, 121, draw.integers(0, 12))] = word(1)[0]
        if i % 6:
            own[:50], own[75:] = word(50), word(46)
        elif i % 4:
            own[:int(draw.integers(0, 45))] = word(1)[0]
        rows.append((60 - cut, own[cut:]))
    return rows


@pytest.mark.parametrize("listed", [40, 1 << 18])
def test_windows_of_a_crowd_are_paired_by_what_they_share(monkeypatch, listed):
    rows, share, seen, real = crowd(180), 8 / 9, [], passages.bounds
    monkeypatch.setattr(passages, "LISTED", listed)
    monkeypatch.setattr(passages, "bounds", lambda hit, *rest: seen.append(len(hit)) or real(hit, *rest))
    n = len(rows)
    got = passages.match_groups(np.zeros(n, int), np.arange(n), np.zeros(n, int), np.array([m for m, _ in rows]), [x.tobytes() for _, x in rows], 46, share)
    want, pairs = set(), 0
    for i, (middle, x) in enumerate(rows):
        sums = [np.append(0, np.cumsum(np.isin(x, y))) for j, (_, y) in enumerate(rows) if i != j]
        spans = [(p, q) for s in sums if s[-1] > 40 for p in range(middle + 1) for q in range(max(p + 46, middle + 1), len(x) + 1) if s[q] - s[p] >= share * (q - p) - 1e-9]
        pairs += sum(s[-1] > 40 for s in sums)
        if spans:
            want.add((i, min(p for p, _ in spans), max(q for _, q in spans)))
    assert {tuple(map(int, r[:3])) for r in got} == want and len(want) >= 20 and len({int(r[4]) for r in got}) == 1
    # the bounds of all windows, and fewer intervals than there are pairs that share enough
    assert sum(seen) - n < pairs < n * (n - 1) / 20


def test_shingles_of_many_texts_are_those_of_each():
    hashes = passages.Hashes(5)
    texts = [b"a b c d e f", None, b"", b" a\tB  c\nd ", b"A b c d e", b"f g h i j k l " * 20, b"x"]
    tokens, starts = passages.shingles(texts, hashes)
    for text, low, high in zip(texts, starts[:-1], starts[1:], strict=True):
        alone, ends = passages.shingles([text], hashes)
        assert list(tokens[low:high]) == list(alone) and list(ends) == [0, len(alone)]
    assert list(np.diff(starts)) == [2, 0, 0, 0, 1, 136, 0] and tokens[0] == tokens[2]
    assert list(passages.parts_of([b"x" * passages.TEXTS, None, b"y"])) == [(0, 2), (2, 3)] and list(passages.parts_of([])) == []


def test_repetitive_texts_are_compared_in_little_time(spark):
    rows = [(1, "y z " * 50_000), (2, "y z " * 50_000 + "end"), (3, "z y y " * 30_000), (4, "y " * 100_000)]
    begin = time.perf_counter()
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.perf_counter() - begin < 60
    assert {(r.doc_id, r.start) for r in found} >= {(1, 0), (2, 0)} and all(r.end > 99_000 for r in found if r.doc_id in (1, 2))


def test_sets_of_copies_are_linked_by_component(spark):
    draw = random.Random(9)
    words = lambda n: ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, other = words(110), words(70)
    near = [*passage[:55], *words(1), *passage[56:]]
    # the same passage, nearly, in two sets of copies; a pair apart from them; a chain of passages that touch
    rows = [(i, words(1) + t) for t, ids in ((passage, (1, 2)), (near, (3, 4)), (other, (5, 6))) for i in ids]
    one, two, three = words(70), words(70), words(70)
    rows += [(7, one), (8, one + two), (9, two + three), (10, three)]
    copies = {1: rows[0][1], 2: rows[0][1], 3: rows[2][1], 4: rows[2][1]}
    table = [(i, " ".join(copies.get(i, t))) for i, t in rows]
    groups: dict = {}
    for r in passages.near_passages(spark.createDataFrame(table, "doc_id long, text string")).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [5, 6], [7, 8, 9, 10]]


def test_empty_tables(empty):
    own = pieces.Segmenter(pieces.load_vocabulary(VOCABULARY))
    for made in (quality.quality_rules(empty), quality.keep_good(empty), templates.drop_recurring_lines(empty), simhash.near_duplicates(empty),
                 mixing.mixed_sizes(empty), mixing.mix_documents(empty), repeats.without_repeats(empty), passages.near_passages(empty),
                 pieces.encoded(empty, own), pieces.token_counts(empty, own)):
        assert made.count() == 0


def test_pipeline_on_awkward_rows(spark, docs, empty):
    for table in (docs, empty):
        now, before = table, None
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, "").cache()
            now.count()
            if name != "encode":
                assert now.columns == before.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, "").cache()
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids))  # copies and repeated rows are gone
    assert {12, 13, 14, 15, 16, 17} <= set(ids)  # clean documents stay
