"""Byte pairs against the published library, whitening against whole-number and numpy brute force."""

from __future__ import annotations

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bytepairs, queries, whitening

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(RANKS).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bytepairs.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n: int, seed: int = 5) -> list[str]:
    draw = random.Random(seed)
    parts = ["a", "word", " the", "'s", "'", "ll", "12", "é", "ß", "日本", "!", "...", "<|endoftext|>", "\U0001f600", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c",
             "\x85", "\xa0", " ", " ", " ", "​", "　", "́", "٣", "Ⅷ", "_"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 80))) for _ in range(n)]


def test_cut_texts_have_the_ids_of_whole_texts(library, monkeypatch):
    for run in (2, 3, 10_000):
        monkeypatch.setattr(bytepairs, "RUN", run)
        monkeypatch.setattr(bytepairs, "_LONG_RUN", bytepairs.re.compile(f"[{bytepairs.WHITE}]{{{run},}}"))
        for step in (1, 4, 17):
            for text in odd_texts(400, run + step):
                assert "".join(bytepairs.cuts(text, step)) == text
                assert bytepairs.encode(library, text, step).tolist() == library.encode_ordinary(text), (run, step, text)


def test_runs_of_white_space_on_which_the_library_gives_up(library):
    for text in ("a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "x y " + "\u3000" * 1_100_000):
        assert library.decode(bytepairs.encode(library, text).tolist()) == text
    # the merges of a run are those of a shorter one that the library still takes
    short = "a" + " " * 60_000 + "b"
    assert bytepairs.encode(library, short).tolist() == library.encode_ordinary(short)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    prose = " ".join(draw.choice(["alpha", "bêta", "'s", "12", "日", "gamma\n"]) for _ in range(60_000))
    return [*odd_texts(60), None, "", " ", prose, prose, "x" * 200_000, " " * 70_000 + "end"]


def test_byte_pairs_of_a_table(spark, library, texts):
    rows = [(i, t, "en", b"z", 3) for i, t in enumerate(texts)] + [(0, "again", "en", b"z", 3), (None, "null id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids binary, n_tokens long").repartition(3)
    codec = bytepairs.Codec(spark, RANKS)
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t, *_ in rows), key=str)
    plain = bytepairs.encoded(docs, codec)
    assert plain.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted(((r["doc_id"], r["ids"]) for r in plain.collect()), key=str) == want
    back = bytepairs.decoded(plain.withColumn("more", F.lit("kept")), codec)
    assert back.columns == ["doc_id", "ids", "n_tokens", "more", "bytes"]
    assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    packed = bytepairs.decoded(bytepairs.encoded(docs, codec, packed=True), codec).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in packed), key=str) == want
    assert bytepairs.decoded(bytepairs.encoded(docs.limit(0), codec), codec).count() == 0


def test_ids_that_end_inside_a_character_and_null_ids(spark, library):
    codec = bytepairs.Codec(spark, RANKS)
    ids = library.encode_ordinary("日")
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, []), (4, ids)], "doc_id int, ids array<int>")
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bytepairs.decoded(rows, codec).collect()}
    assert back[4] == "日".encode() and back[1] == back[4][:len(back[1])] and 0 < len(back[1]) < 3 and back[2] == back[3] == b""


def test_op11_query(spark, library, texts, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_byte_pairs"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def brute(vectors, scale=1024, shift=100_000):
    x = [[int(np.floor(scale * float(np.float32(c)))) + shift for c in v] for v in vectors]
    n, width = len(x), max(map(len, x))
    x = [r + [shift] * (width - len(r)) for r in x]
    sums = [sum(r[i] for r in x) for i in range(width)]
    y = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    return n, sums, y


@pytest.mark.parametrize("spread", [1.0, 1e5, 3e7])
def test_covariance_sums_are_exact(spark, spread):
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(300, 5)) * spread * [1, 2, 0.5, 1e-4, 0]).astype(np.float32).tolist() + [[0.5, -0.5], []]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    n, sums, cross = whitening.covariance_sums(table)
    want_n, want_sums, y = brute(vectors)
    assert (n, sums) == (want_n, want_sums)
    assert cross == [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]


def test_square_sums_in_parts():
    draw = np.random.default_rng(8)
    for bits in (10, 30, 45, 61):
        z = draw.integers(-2 ** bits, 2 ** bits, (700, 3))
        assert whitening.square_sums(z) == [sum(int(v) ** 2 for v in c) for c in z.T]
        assert whitening.square_sums(z.astype(object)) == whitening.square_sums(z)


def test_centred_entries_beyond_64_bits():
    x = np.array([[2 ** 39, -5], [7, 2 ** 39]])
    n, sums = 2 ** 40, [3, 2 ** 70]
    y = whitening.centred(x, n, sums, 100_000)
    assert y.tolist() == [[n * int(a) - s for a, s in zip(r, sums, strict=True)] for r in x]
    assert whitening.square_sums(y) == [sum(v * v for v in c) for c in zip(*y.tolist(), strict=True)]


def test_whitened_values(spark):
    draw = np.random.default_rng(2)
    mixing = draw.normal(size=(12, 12))
    vectors = (draw.normal(size=(2500, 12)) @ mixing * 0.3).astype(np.float32)
    rows = [(i % 2400, v.tolist(), "x", 1) for i, v in enumerate(vectors)] + [(7000, None, "x", 1), (7001, [None] * 12, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component int").repartition(3)
    got = whitening.whitened(table).toPandas()
    n, sums, y = brute(vectors.tolist())
    y = np.array(y, float)
    values, axes = np.linalg.eigh((y / n).T @ (y / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 8 * len(vectors) and set(got["n"]) == {n}
    assert np.allclose(got.groupby("component")["explained"].first(), values[:8] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    want = {}
    for i, r in enumerate(y):
        want.setdefault(i % 2400, []).append((sum(int(c) ** 2 for c in r), np.abs(r / n @ axes[:, :8] / np.sqrt(values[:8]))))
    for vec_id, part in got.groupby("vec_id"):
        assert sorted(int(d) for d in part[part["component"] == 1]["deviation"]) == sorted(d for d, _ in want[vec_id])
        if len(want[vec_id]) == 1:
            assert np.allclose(part.sort_values("component")["whitened"].abs(), want[vec_id][0][1], atol=1e-8)
    signs = np.sign(got[got["component"] == 1].set_index("vec_id")["whitened"])
    direct = {i: np.sign(r @ axes[:, 0]) for i, r in enumerate(y) if 100 < i < 2400}
    assert abs(sum(signs[i] * s for i, s in direct.items())) == len(direct)


def test_whitening_of_flat_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [])], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(50)], schema)).toPandas()
    assert flat["identity_error"].iloc[0] < 1e-9 and (flat[flat["component"] > 1]["whitened"] == 0).all()
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e30])], schema)).collect()
