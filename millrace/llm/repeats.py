"""Exact removal of repeated byte strings: hash-compared suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Two suffixes count as equal if they agree
in ``length`` bytes, so what a suffix array would show of them is whether their common extension reaches that far; it is
read from polynomial prefix hashes instead of comparing bytes. To keep suffixes of a 100-TB corpus out of one sort:

* each window of ``length`` bytes has an anchor, the position with the smallest hash of ``gram`` bytes in it (the first of
  equals); equal windows have equal anchors at the same place, so only suffixes at equal anchors need be compared;
* consecutive windows with one anchor form a run. Runs whose whole extent (two independent hashes) occurs again are repeated
  altogether; this settles the inside of shared passages, and within a task all but one of the equal runs are settled
  before anything is shuffled;
* of anchors where different extents meet, the bytes around them are brought together by anchor; their suffixes are sorted
  by (anchor, distance to it, hash), and neighbours that agree are compared byte by byte;
* an anchor with more than ``many`` different extents is not gathered: its suffixes are counted by hash, a row each.

So instead of a mergesort with a logarithmic comparison per pair, every suffix is compared by its hash at one length,
and Spark's sort brings equals together. Texts of any length are read in pieces of bounded size.

Defined cases: NULL text is an empty string; documents shorter than ``length`` lose nothing; repeated rows are documents that
repeat each other; NULL doc_ids are kept apart by their texts; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import kept

PIECE = 1 << 19
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hashes:
    """Polynomial hashes modulo 2^64 of bytes that a seeded table has mapped to odd numbers."""

    def __init__(self, seed: int) -> None:
        drawn = np.random.default_rng(seed).integers(0, 2 ** 63, 258, dtype=np.uint64) * U(2) + U(1)
        self.table, self.base = drawn[:256], int(drawn[256])
        self._up = self._down = np.ones(1, np.uint64)

    def grams(self, data: np.ndarray, size: int) -> np.ndarray:
        """Of every ``size`` bytes; ``size`` is a power of two."""
        h, width = self.table[data], 1
        while width < size:
            h = h[:-width] * U(pow(self.base, width, 2 ** 64)) + h[width:]
            width *= 2
        return _mixed(h)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            n = len(data) + 1
            self._up = np.cumprod(np.append(U(1), np.full(n - 1, self.base, np.uint64)))
            self._down = np.cumprod(np.append(U(1), np.full(n - 1, pow(self.base, -1, 2 ** 64), np.uint64)))
        return np.append(U(0), np.cumsum(self.table[data] * self._up[:len(data)]))

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[start]) * self._down[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int, grams: Hashes, extents: Hashes) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in joined texts that end at ``ends``: first window, number, distance of the anchor, its hash, the extent's."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = grams.grams(data, gram)
    least = sliding_least((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    size = np.diff(np.append(0, ends))
    starts = np.flatnonzero(np.arange(len(least)) + length <= np.repeat(ends, size)[:len(least)])
    anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    first, at = starts[new], anchor[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    whole = extents.between(extents.prefix(data), first, last + length)
    count, distance = last - first + 1, at - first
    return first, count, distance, h[at], _mixed(whole + ((count << field_bits(length)) + distance).astype(np.uint64))


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, list]]:
    """(keys, offsets, bytes) of about PIECE bytes; a longer text is cut so that each window is whole in one piece."""
    keys, offsets, parts, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            for at in range(0, max(1, len(text) - length + 1), PIECE):
                part = text[at:at + PIECE + length - 1]
                if len(part) < length:
                    continue
                keys.append(key)
                offsets.append(at)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield keys, offsets, parts
                    keys, offsets, parts, size = [], [], [], 0
    if parts:
        yield keys, offsets, parts


def field_bits(length: int) -> int:
    """Bits that hold a run's number of windows and the distance of its anchor, both at most ``length``; the rest is for its place."""
    if not 0 < length < 2 ** 15:
        raise ValueError("length must be between 1 and 32767")
    return max(9, length.bit_length())


# a run in one number: first window, number of windows, distance of the anchor, "settled", "stands for several"
def _pack(first, count, distance, settled, several, bits):
    return (first << (2 * bits + 2)) | (count << (bits + 2)) | (distance << 2) | (settled.astype(np.int64) << 1) | several


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all documents (key, text): key, run, same (hash of the extent), route (hash of the anchor)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, extents = Hashes(1), Hashes(2)
        for keys, offsets, parts in _pieces(batches, length):
            ends = np.cumsum([len(p) for p in parts])
            first, count, distance, anchor, same = runs(np.frombuffer(b"".join(parts), np.uint8), ends, length, gram, grams, extents)
            part = np.searchsorted(ends, first, "right")
            begin = np.append(0, ends)[part]
            place = first - begin + np.array(offsets, np.int64)[part]
            _, one, which, times = np.unique(anchor ^ _mixed(same), return_index=True, return_inverse=True, return_counts=True)
            stands = np.zeros(len(first), bool)
            stands[one] = True
            route = np.where(stands, anchor, _mixed(anchor + first.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)[part]), pa.array(_pack(place, count, distance, ~stands, times[which] > 1, field_bits(length))),
                 pa.array(same.view(np.int64)), pa.array(route.view(np.int64))], ["key", "run", "same", "route"])

    return docs.mapInArrow(find, "key long, run long, same long, route long")


def settle(found: DataFrame, many: int) -> DataFrame:
    """Runs at anchors that occur again: key, run, whole (the whole run is repeated), asked (its bytes are needed), hot, route."""
    settled, several = F.col("run").bitwiseAND(2) != 0, F.col("run").bitwiseAND(1) != 0
    weight = F.when(several, 2).otherwise(1)
    same, every = W.partitionBy("route", "same"), W.partitionBy("route")
    # dealt by anchor once, which serves the windows of both kinds
    once = found.repartition("route").withColumn("one", F.row_number().over(same.orderBy("key", "run")) == 1).withColumn("twins", F.sum(weight).over(same))
    totals = once.select(
        "*", F.sum(weight).over(every).alias("all"), F.sum(F.when((F.col("twins") < 2) & ~settled, 1).otherwise(0)).over(every).alias("open"),
        F.sum(F.col("one").cast("int")).over(every).alias("kinds"))
    return totals.filter(settled | (F.col("all") > 1)).select(
        "key", "run", "route", (settled | (F.col("twins") > 1)).alias("whole"),
        (F.col("one") & ~settled & (F.col("open") > 0)).alias("asked"), (F.col("kinds") > many).alias("hot"))


def windows_around(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """For each asked run its bytes, by anchor; for a hot anchor a row per window, by the window's hash."""
    listed = asked.groupBy("key").agg(F.collect_list(F.struct("run", "route", "hot")).alias("runs"))
    joined = docs.join(listed, "key")
    bits = field_bits(length)
    mask = (1 << bits) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(3)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sort, key, start, distance, body = [], [], [], [], []
                for k, text, own in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    seen = set()
                    for r in own:
                        if (r["run"], r["route"]) in seen:  # repeated rows
                            continue
                        seen.add((r["run"], r["route"]))
                        first, count, off = r["run"] >> (2 * bits + 2), (r["run"] >> (bits + 2)) & mask, (r["run"] >> 2) & mask
                        piece = text[first:first + count + length - 1]
                        if not r["hot"]:
                            sort.append(r["route"])
                            key.append(k)
                            start.append(first)
                            distance.append(off)
                            body.append(piece)
                            continue
                        i = np.arange(count)
                        h = hashes.between(hashes.prefix(np.frombuffer(piece, np.uint8)), i, i + length)
                        h = _mixed(h + np.array([r["route"]], np.int64).view(np.uint64) + (off - i).astype(np.uint64) * U(0x9E3779B97F4A7C15))
                        sort += h.view(np.int64).tolist()
                        key += [k] * count
                        start += range(first, first + count)
                        distance += [-1] * count
                        body += [None] * count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sort, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(distance, pa.int32()), pa.array(body, pa.binary())],
                    ["sort", "key", "start", "distance", "body"])

    return joined.select("key", "text", "runs").mapInArrow(cut, "sort long, key long, start long, distance int, body binary")


def equal_windows(group: np.ndarray, distance: np.ndarray, bodies: list[bytes], length: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows that another row of the same group has at the same distance from the anchor."""
    size = np.array([len(b) for b in bodies])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(bodies), np.uint8)
    count = size - length + 1
    row = np.repeat(np.arange(len(bodies)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = begin[row] + window
    h = hashes.between(hashes.prefix(data), start, start + length)
    h = _mixed(h + group[row].astype(np.uint64) * U(0x9E3779B97F4A7C15) + (distance[row] - window).astype(np.uint64))
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = order[near], order[near + 1]
    true = np.zeros(len(near), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for at in range(0, len(near), 8192):
        true[at:at + 8192] = (view[start[a[at:at + 8192]]] == view[start[b[at:at + 8192]]]).all(axis=1)
    hit = np.zeros(len(row), bool)
    hit[a[true]] = hit[b[true]] = True
    return row[hit], window[hit]


def compared(rows: DataFrame, length: int, rows_at_once: int = 2048) -> DataFrame:
    """key, start, end of the bytes covered by windows that occur again, from the rows of ``windows_around``."""
    def intervals(keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((starts, keys))
        k, s = keys[order], starts[order]
        new = np.append(True, (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1))[:len(k)]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(k) - 1)[:new.sum()]
        return pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(s[new]), pa.array(s[last] + length)], ["key", "start", "end"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(4)
        held: list[pa.RecordBatch] = []
        lone = None  # last row of counted windows: hash, key, start
        for batch in batches:
            counted = batch.column(3).to_numpy() < 0
            if counted.any():
                h, k, s = (batch.column(i).to_numpy()[counted] for i in (0, 1, 2))
                if lone is not None:
                    h, k, s = np.append(lone[0], h), np.append(lone[1], k), np.append(lone[2], s)
                same = h[1:] == h[:-1]
                hit = np.append(False, same) | np.append(same, False)
                lone = (h[-1], k[-1], s[-1])
                yield intervals(k[hit], s[hit])
            if not counted.all():
                held.append(batch.filter(pa.array(~counted)))
            if sum(b.num_rows for b in held) >= rows_at_once:
                yield from gathered(held, hashes, False)
        yield from gathered(held, hashes, True)

    def gathered(held: list[pa.RecordBatch], hashes: Hashes, end: bool) -> Iterator[pa.RecordBatch]:
        """Work on the anchors that are complete; the last one may go on in the next batch."""
        if not held:
            return
        joined = pa.Table.from_batches(held).combine_chunks()
        anchors = joined.column(0).to_numpy()
        whole = len(anchors) if end else int(np.searchsorted(anchors, anchors[-1]))
        held[:] = [] if end else joined.slice(whole).to_batches()
        cuts = np.append(np.flatnonzero(np.append(True, anchors[1:whole] != anchors[:whole - 1])), whole) if whole else np.zeros(1, int)
        at = 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + rows_at_once, "right")) - 1)
            part = joined.slice(cuts[at], cuts[to] - cuts[at])
            at = to
            bodies = part.column(4).to_pylist()
            group = np.cumsum(np.append(0, np.diff(part.column(0).to_numpy()) != 0))
            row, window = equal_windows(group, part.column(3).to_numpy().astype(np.int64), bodies, length, hashes)
            if len(row):
                yield intervals(part.column(1).to_numpy()[row], part.column(2).to_numpy()[row] + window)

    return rows.repartition("sort").sortWithinPartitions("sort").mapInArrow(solve, "key long, start long, end long")


def repeated_intervals(docs: DataFrame, length: int = 200, gram: int = 32, many: int = 4096) -> DataFrame:
    """key, start, end of bytes to remove, for documents (key, text); intervals of a key may overlap."""
    marks = kept(settle(anchored(docs, length, gram), many))
    asked = marks.filter("asked")
    bits = field_bits(length)
    first, count = F.shiftright("run", 2 * bits + 2), F.shiftright("run", bits + 2).bitwiseAND((1 << bits) - 1)
    whole = marks.filter("whole").select("key", first.alias("start"), (first + count + (length - 1)).alias("end"))
    return whole.union(compared(windows_around(docs, asked, length), length))


def without_repeats(docs: DataFrame, length: int = 200, **settings) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed bytes as maximal runs [start, end)), kept (the bytes left)."""
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    spans = repeated_intervals(keyed.select("key", "text"), length, **settings).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    joined = keyed.join(spans, "key", "left").select("doc_id", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, removed, left = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, own, rest, end = text or b"", [], [], 0
                    for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                        if own and a <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], b)
                        else:
                            own.append({"start": a, "end": b})
                    for x in own:
                        rest.append(text[end:x["start"]])
                        end = x["end"]
                    sizes.append(len(text))
                    removed.append(own)
                    left.append(b"".join(rest) + text[end:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(left, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
