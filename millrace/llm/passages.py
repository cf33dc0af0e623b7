"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. For a hash function, a compact window (l, c, r) stands for all subsequences that start in
l .. c, end in c .. r and so have their min-hash at c; the windows of a text are the nodes of the Cartesian tree of its hashes,
and those too narrow for a passage are not visited, which leaves about 2 n / 46 of n. Passages with a Jaccard similarity s
of their shingles share the min-hash with probability s under each function: with two functions a passage at 0.8 is found
with probability 0.96, and a longer one has more windows to be found by.

Windows meet by min-hash. Where the whole window, by the hash of its shingles, occurs in two documents it is a repeated
passage as it stands. Where there are several kinds, windows of one document only and two documents of each other kind
are looked at with their shingles to both sides: every two of a group are compared, and an interval around c in which the shingles of both agree in 8/9 (a similarity of 0.8 at equal lengths) is a
match if it has at least 50 words; a passage is all its matches together. Only pairs that can add nothing are passed over: both windows are linked
already, and neither can reach further, even if all its shingles that occur in another document of the group agreed. A large group is dealt by hash into blocks, and each pair of blocks is a task of its own.

Defined cases: NULL and short texts have no passages; rows equal in doc_id and text count as one document, and repetition within a
document is none; a document's overlapping passages are joined, and each such run has the id of its component, the runs that matches
and whole repeats connect, as one partner is named only; NULL doc_ids are kept apart by their texts; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import kept
from millrace.llm.graph import components
from millrace.llm.repeats import Hashes, _mixed
from millrace.llm.simhash import Groups

SHINGLE = 5
REACH = 60
#: Groups of so many windows are worth the bounds of what each can reach.
BOUNDED = 8
#: In groups of so many only windows that have enough in common are paired.
CROWD = 32
#: Windows that a task compares at a time, more where a group is larger.
PART = 2048
#: Windows with their shingles in a batch.
ROWS = 8192
#: Bytes of texts whose shingles are found together.
TEXTS = 1 << 18
#: Pairs that are listed at a time, more where the first round left has more.
LISTED = 1 << 18
U = np.uint64


def shingles(texts: list[bytes | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words, ASCII letters lower-cased, text after text, and where each text begins, with the end of the last."""
    plain = b"\n".join(b" ".join((text or b"").lower().split()) for text in texts)
    data = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    if len(gaps) < SHINGLE - 1:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(plain))
    text_of = np.append(0, np.cumsum(data[gaps] == 10))
    first = np.flatnonzero(text_of[:len(starts) - SHINGLE + 1] == text_of[SHINGLE - 1:])
    tokens = hashes.between(hashes.prefix(data), starts[first], ends[first + SHINGLE - 1])
    return tokens, np.searchsorted(text_of[first], np.arange(len(texts) + 1))


def parts_of(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TEXTS bytes together."""
    sums = np.cumsum([len(text or b"") for text in texts])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sums, TEXTS + (sums[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def compact_windows(order: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree's nodes that span ``width`` or more."""
    found, stack = [], [(0, len(order) - 1)]
    while stack:
        low, high = stack.pop()
        if high - low + 1 < width:
            continue
        c = low + int(order[low:high + 1].argmin())
        found.append((low, c, high))
        stack.append((low, c - 1))
        stack.append((c + 1, high))
    return found


def windows_of(docs: DataFrame, functions: int, width: int) -> DataFrame:
    """Compact windows of documents (key, text): route (function and min-hash), same (hash of the whole window), key, l, c, r."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(5)
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in parts_of(texts):
                tokens, starts = shingles(texts[low:high], hashes)
                long = np.flatnonzero(np.diff(starts) >= width)
                if not len(long):
                    continue
                # equal shingles of a text are ordered by a hash of their place, so that the tree stays shallow
                noise = _mixed((np.arange(1, len(tokens) + 1) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)) & U(0xFFFF)
                total = np.append(U(0), np.cumsum(tokens * (_mixed(tokens) | U(1))))
                for f in range(functions):
                    hashed = _mixed(tokens * U(2 * f + 3) + U(f))
                    order = (hashed & ~U(0xFFFF)) | noise
                    found = [compact_windows(order[starts[i]:starts[i + 1]], width) for i in long]
                    rows, of = np.concatenate([np.array(x, np.int64) for x in found]), np.repeat(long, [len(x) for x in found])
                    begin, middle, end = (rows + starts[of][:, None]).T
                    route = hashed[middle] ^ U(f * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    place = (middle - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64)
                    # a sum over the window, with its two ends: equal windows agree, others by chance of 2^-64 only
                    same = _mixed(_mixed(total[end + 1] - total[begin]) + place + tokens[begin] * U(3) + tokens[end] * U(5))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route.view(np.int64)), pa.array(same.view(np.int64)), pa.array(keys[low + of]), *[pa.array(rows[:, i].astype(np.int32)) for i in range(3)]],
                        ["route", "same", "key", "l", "c", "r"])

    return docs.mapInArrow(find, "route long, same long, key long, l int, c int, r int")


def settle(found: DataFrame, many: int) -> DataFrame:
    """Windows whose min-hash occurs in two documents: ``partner`` and ``link`` if the whole window does, ``asked`` if it must be looked at.

    A min-hash with more than ``many`` windows to be looked at has its documents dealt into ``shares`` blocks.
    """
    same, every = W.partitionBy("route", "same"), W.partitionBy("route")
    low, high, several = F.col("low"), F.col("high"), F.col("low") < F.col("high")
    row, before = F.row_number().over(same.orderBy("key", "c")), F.lag("key").over(same.orderBy("key", "c"))
    # dealt by min-hash once, which serves the windows of both kinds
    classed = found.repartition("route").withColumns({"one": row == 1, "new": F.coalesce(before != F.col("key"), F.lit(True)), "low": F.min("key").over(same), "high": F.max("key").over(same)})
    # two documents of a kind, so that kinds which have one document in common are compared by another
    totals = classed.withColumn("look", ~several | F.col("new") & F.col("key").isin(low, high)).select(
        "*", F.min("key").over(every).alias("first"), F.max("key").over(every).alias("last"),
        F.sum(F.col("one").cast("long")).over(every).alias("kinds"), F.sum(F.col("look").cast("long")).over(every).alias("looks"))
    return totals.filter(F.col("first") < F.col("last")).select(
        "key", "route", "l", "c", "r", F.when(several, F.when(F.col("key") == low, high).otherwise(low)).alias("partner"),
        F.when(several, F.xxhash64("route", "same")).alias("link"), (F.col("look") & (F.col("kinds") > 1)).alias("asked"),
        F.when(F.col("looks") > many, F.ceil(2 * F.col("looks") / many)).otherwise(1).cast("int").alias("shares")).filter(
        F.col("asked") | F.col("partner").isNotNull())


def around(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked window its shingles up to REACH to both sides of c, four bytes each, once for every task (sort) it is compared in.

    Each pair of blocks of a min-hash is a task, so every window meets every other one in some task.
    """
    listed = asked.groupBy("key").agg(F.collect_set(F.struct("route", "l", "c", "r", "shares")).alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(5)
        for batch in batches:
            keys, texts, own = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            ends, fields = own.offsets.to_numpy(), {name: own.values.field(i).to_numpy() for i, name in enumerate(("route", "l", "c", "r", "shares"))}
            for at, end in parts_of(texts):
                tokens, starts = shingles(texts[at:end], hashes)
                tokens = (_mixed(tokens) >> U(32)).astype(np.uint32)
                route, left, middle, right, shares = (fields[name][ends[at]:ends[end]] for name in ("route", "l", "c", "r", "shares"))
                of = np.repeat(np.arange(at, end), np.diff(ends[at:end + 1]))
                low, high = np.maximum(left, middle - REACH).astype(np.int64), np.minimum(right, middle + REACH).astype(np.int64) + 1
                # each pair of blocks that a window's block is in
                n, times = shares.astype(np.int64), np.maximum(1, shares - 1)
                row = np.repeat(np.arange(len(of)), times)
                block, other = ((keys[of] >> 7) % n)[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                other += (other >= block) & (n[row] > 1)
                pair = (np.minimum(block, other) * n[row] + np.maximum(block, other)).astype(np.uint64)
                sort = (route[row].view(U) + pair * U(0x51ED270B7F4A7C15)).view(np.int64)
                for some in np.array_split(np.arange(len(row)), -(-len(row) // ROWS)):
                    of_row = row[some]
                    size = (high - low)[of_row]
                    stops = np.cumsum(size)
                    body = tokens[np.arange(stops[-1]) + np.repeat((starts[of - at] + low)[of_row] - stops + size, size)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sort[some]), pa.array(keys[of[of_row]]), pa.array(low[of_row].astype(np.int32)), pa.array((middle - low)[of_row].astype(np.int32)),
                         pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.append(0, 4 * stops).astype(np.int32)), pa.py_buffer(body)])],
                        ["sort", "key", "start", "middle", "body"])

    return docs.join(listed, "key").select("key", "text", "own").mapInArrow(cut, "sort long, key long, start int, middle int, body binary")


def bounds(hit: np.ndarray, size: np.ndarray, middle: np.ndarray, share: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``hit`` the least start and the largest end of all intervals of ``width`` around ``middle`` with ``share`` of hits; end 0 if there are none."""
    n, wide = hit.shape
    sums = np.zeros((n, wide + 1))
    np.cumsum(hit - share, axis=1, out=sums[:, 1:])
    place, middle = np.arange(wide + 1)[None, :], middle[:, None]
    sums[place > size[:, None]] = -np.inf
    # a start holds if the largest sum from its first possible end on is not below its own, an end by the least sum up to its last possible start
    highest = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    lowest = np.minimum.accumulate(sums, axis=1)
    ends, begins = np.maximum(place + width, middle + 1), np.minimum(place - width, middle)
    starts = (place <= middle) & (ends <= wide) & (np.take_along_axis(highest, np.minimum(ends, wide), axis=1) >= sums - 1e-9)
    stops = (place > middle) & (begins >= 0) & (place <= size[:, None]) & (np.take_along_axis(lowest, np.maximum(begins, 0), axis=1) <= sums + 1e-9)
    return np.where(starts.any(axis=1), starts.argmax(axis=1), wide + 1), np.where(stops.any(axis=1), wide - stops[:, ::-1].argmax(axis=1), 0)


def widens(hit: np.ndarray, size: np.ndarray, middle: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> np.ndarray:
    """Rows of ``hit`` of which an interval around ``middle`` with ``share`` of hits can begin before ``low`` or end after ``high``; none that do are missed."""
    sums = np.zeros((len(hit), hit.shape[1] + 1), np.float32)
    np.cumsum(hit - np.float32(share), axis=1, out=sums[:, 1:])
    place, middle = np.arange(hit.shape[1] + 1, dtype=np.int16)[None, :], middle[:, None].astype(np.int16)
    least = lambda x: np.where(x, sums, np.float32(np.inf)).min(axis=1) - np.float32(1e-3)
    most = lambda x: np.where(x, sums, np.float32(-np.inf)).max(axis=1)
    after = place > middle
    return (most(after) >= least(place < low[:, None].astype(np.int16))) | (
        most((place > high[:, None].astype(np.int16)) & (place <= size[:, None].astype(np.int16))) >= least(~after))


class Hits:
    """Which places of windows hold a shingle of another window, by the numbers of their shingles in their group."""

    def __init__(self, kinds: np.ndarray, none: int) -> None:
        self.kinds, self.none = kinds, none  # the number of places beyond a window
        self.slot = np.full(none + 1, -1, np.int16)

    def of(self, rest: np.ndarray, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per pair the places of ``rest`` that the leader holds, and those of the leader that ``rest`` holds. A group has one leader."""
        wide = self.kinds.shape[1]
        one, which = np.unique(leader, return_inverse=True)
        own = self.kinds[one]
        self.slot[own] = np.arange(wide, dtype=np.int16)[None, :]
        self.slot[self.none] = -1
        found, slots = self.slot[self.kinds[rest]], self.slot[own]
        self.slot[own] = -1
        held = np.zeros((len(rest), wide + 1), bool)
        np.put_along_axis(held, found.astype(np.intp) % (wide + 1), True, axis=1)
        held[:, wide] = False
        return found >= 0, np.take_along_axis(held, slots[which].astype(np.intp) % (wide + 1), axis=1)


def reachable(kinds: np.ndarray, lows: np.ndarray, highs: np.ndarray, size: np.ndarray, middles: np.ndarray, width: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of what each class can match in its group: all its shingles that another document of the group has are taken as hits."""
    inside = np.arange(kinds.shape[1])[None, :] < size[:, None]
    where = kinds[inside]
    low, high = np.full(int(kinds.max()) + 1, np.iinfo(np.int64).max), np.full(int(kinds.max()) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, where, np.broadcast_to(lows[:, None], kinds.shape)[inside])
    np.maximum.at(high, where, np.broadcast_to(highs[:, None], kinds.shape)[inside])
    hit = np.zeros(kinds.shape, bool)
    hit[inside] = (low < high)[where]
    found = [bounds(hit[i:i + 2048], size[i:i + 2048], middles[i:i + 2048], share, width) for i in range(0, len(hit), 2048)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Shared:
    """Pairs of classes of a group that can have ``least`` places of one in common, by the rank of the earlier, some at a time.

    The commonest shingles of a class that together have fewer than ``least`` of its places make no match alone: a class it can match
    holds one of its other, rare ones. A group is ``dense`` that is small, or in which that lists more pairs than there are.
    """

    def __init__(self, number: np.ndarray, rank: np.ndarray, kinds: np.ndarray, size: np.ndarray, least: int) -> None:
        self.rank, n, groups = rank, len(size), np.bincount(number)
        size = np.where(groups[number] < CROWD, 0, size)
        inside = np.arange(kinds.shape[1])[None, :] < size[:, None]
        code, places = np.unique(kinds[inside].astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        kind, owner = code // n, code % n
        common = np.bincount(kind)[kind]
        falling = np.lexsort((-common, owner))
        rare = np.zeros(len(code), bool)
        rare[falling] = np.cumsum(places[falling]) - (np.cumsum(size) - size)[owner[falling]] >= least
        keep = common > 1
        kind, owner, rare = kind[keep], owner[keep], rare[keep]
        # a rare shingle leads to all later holders, another one to those for which it is rare
        self.holders, self.few = owner, owner[rare]
        here, end, before = np.arange(len(kind)), np.searchsorted(kind, kind, "right"), np.append(0, np.cumsum(rare))
        first, count = np.where(rare, here + 1, before[here + 1]), np.where(rare, end - here - 1, before[end] - before[here + 1])
        self.dense = ((groups < CROWD) | (np.bincount(number[owner], count, len(groups)) > groups * (groups - 1) / 2))[number]
        use = np.flatnonzero((count > 0) & ~self.dense[owner])
        use = use[np.argsort(rank[owner[use]], kind="stable")]
        self.owner, self.rare, self.first, self.count = owner[use], rare[use], first[use], count[use]
        self.sums, self.ranks = np.cumsum(self.count), rank[self.owner]
        self.next, self.listed = 0, [np.zeros(0, np.int64)] * 3

    def _list(self) -> None:
        """The next entries, all those of a rank together."""
        low = self.next
        last = min(len(self.sums) - 1, int(np.searchsorted(self.sums, LISTED + (self.sums[low - 1] if low else 0))))
        high = self.next = int(np.searchsorted(self.ranks, self.ranks[last], "right"))
        first, count, rare = self.first[low:high], self.count[low:high], self.rare[low:high]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
        wide = np.repeat(rare, count)
        later = np.empty(len(at), np.int64)
        later[wide], later[~wide] = self.holders[at[wide]], self.few[at[~wide]]
        pairs = np.unique(np.repeat(self.owner[low:high], count) * len(self.rank) + later)
        earlier, later = pairs // len(self.rank), pairs % len(self.rank)
        order = np.lexsort((later, self.rank[earlier]))
        self.listed = [self.rank[earlier[order]], later[order], earlier[order]]

    def of(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """(later, earlier) where the earlier has this rank; ranks are asked for in order."""
        while self.next < len(self.ranks) and self.ranks[self.next] <= rank:
            self._list()
        ranks, later, earlier = self.listed
        some = slice(np.searchsorted(ranks, rank), np.searchsorted(ranks, rank, "right"))
        return later[some], earlier[some]


def match_groups(group: np.ndarray, keys: np.ndarray, starts: np.ndarray, middles: np.ndarray, bodies: list[bytes], width: int, share: float) -> np.ndarray:
    """Rows (key, start, end, partner, link) in shingles, for windows in order of ``group``.

    Windows of a group with the same shingles around the same middle are one class, known by its smallest and largest key: classes are
    compared, and what one matches holds for its members. Round by round one class of each group is compared with those behind it.
    Windows that matches connect have the same link.
    """
    known: dict[tuple, int] = {}
    of = np.array([known.setdefault(x, len(known)) for x in zip(group.tolist(), middles.tolist(), bodies, strict=True)])
    one = np.unique(of, return_index=True)[1]  # classes are numbered as they appear, so groups stay in order
    windows, bodies = group, [bodies[i] for i in one]
    group, middles_of, member_keys = group[one], middles[one], keys
    lows, highs = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(lows, of, keys)
    np.maximum.at(highs, of, keys)

    size = np.array([len(b) // 4 for b in bodies])
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(first, len(group)))
    # shingles are numbered, those of each group apart
    number = np.repeat(np.arange(len(first)), length)
    each, kind = np.unique(np.repeat(number, size) << 32 | np.frombuffer(b"".join(bodies), np.uint32), return_inverse=True)
    kinds = np.full((len(bodies), int(size.max())), len(each), np.int32)
    kinds[np.arange(kinds.shape[1])[None, :] < size[:, None]] = kind
    head, rank = np.repeat(first, length), np.arange(len(group)) - np.repeat(first, length)
    least, most = np.full(len(group), -1), np.full(len(group), np.iinfo(np.int64).max)
    large = np.repeat(length, length) >= BOUNDED
    if large.any():
        least[large], most[large] = reachable(kinds[large], lows[large], highs[large], size[large], middles_of[large], width, share)
    low, high = np.full(len(group), kinds.shape[1] + 1), np.zeros(len(group), np.int64)
    below, above = np.full(len(group), np.iinfo(np.int64).max), np.full(len(group), np.iinfo(np.int64).min)
    # the members of a class match each other from end to end
    own = np.flatnonzero((lows < highs) & (size >= width))
    low[own], high[own], below[own], above[own] = 0, size[own], lows[own], highs[own]
    # what can match nothing at all has nothing left to reach; it is never linked, so it is passed over by itself
    idle, linked = most == 0, Groups(len(group))
    least_hits = int(np.ceil(share * width - 1e-9))
    shared, hits_of = Shared(number, rank, kinds, size, least_hits), Hits(kinds, len(each))
    left = np.flatnonzero(shared.dense)
    for at in range(int(length.max()) - 1):
        left = left[rank[left] > at]
        later, earlier = shared.of(at)
        if not len(left) + len(later):
            continue
        leader, rest = np.append(head[left] + at, earlier), np.append(left, later)
        order = np.argsort(rest, kind="stable")
        leader, rest = leader[order], rest[order]
        done = (low <= least) & (high >= most)
        apart = (lows[rest] < highs[rest]) | (lows[leader] < highs[leader]) | (lows[rest] != lows[leader])
        use = apart & ~(done[rest] & done[leader] & (linked.root[rest] == linked.root[leader])) & ~(idle[rest] | idle[leader])
        rest, leader = rest[use], leader[use]
        if not len(rest):
            continue
        near, same = np.zeros(len(rest), bool), linked.root[rest] == linked.root[leader]
        for one, two, hit in zip((rest, leader), (leader, rest), hits_of.of(rest, leader), strict=True):
            some = np.flatnonzero(~(done[one] & same) & (hit.sum(axis=1) >= least_hits))
            # a match of two windows that are linked already matters if it reaches further
            known = np.flatnonzero(same[some] & large[one[some]] & (high[one[some]] > 0))
            own = one[some[known]]
            some = np.delete(some, known[~widens(hit[some[known]], size[own], middles_of[own], low[own], high[own], share)])
            for at_once in np.array_split(some, len(some) // 2048 + 1):
                own, other = one[at_once], two[at_once]
                a, b = bounds(hit[at_once], size[own], middles_of[own], share, width)
                hits = b > 0
                near[at_once[hits]] = True
                np.minimum.at(low, own[hits], a[hits])
                np.maximum.at(high, own[hits], b[hits])
                np.minimum.at(below, own[hits], lows[other[hits]])
                np.maximum.at(above, own[hits], highs[other[hits]])
        linked.link(rest[near], leader[near])
    found = np.flatnonzero(high[of] > 0)
    mine, key = of[found], member_keys[found]
    partner = np.where(below[mine] != key, below[mine], above[mine])
    # a class of one document may have matched a class that holds nothing but that document and others: never itself alone
    root = linked.root[mine]
    head_of = np.full(len(group), len(windows))
    np.minimum.at(head_of, of, np.arange(len(of)))
    at = head_of[root]
    link = _mixed(_mixed(windows[at].astype(np.int64).view(U)) + _mixed(member_keys[at].view(U)) * U(3) + (starts[at] + middles[at]).astype(np.int64).view(U)).view(np.int64)
    return np.column_stack([key, starts[found] + low[mine], starts[found] + high[mine], partner, link])


def compared(rows: DataFrame, width: int, share: float) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(end: bool) -> Iterator[pa.RecordBatch]:
            joined = pa.Table.from_batches(held).combine_chunks()
            sort = joined.column(0).to_numpy()
            whole = len(sort) if end else int(np.searchsorted(sort, sort[-1]))
            held[:] = [] if end or whole == len(sort) else joined.slice(whole).to_batches()
            if not whole:
                return
            key, start, middle = (joined.column(i).to_numpy()[:whole].astype(np.int64) for i in (1, 2, 3))
            group = np.cumsum(np.append(0, np.diff(sort[:whole]) != 0))
            # a min-hash of one document only has nothing to be compared with
            shared = np.flatnonzero(np.bincount(group)[group] > 1)
            at = 0
            while at < len(shared):  # whole groups, some PART rows at a time
                last = group[shared[min(len(shared), at + PART) - 1]]
                end = int(np.searchsorted(group[shared], last)) if last != group[shared[at]] else at
                end = end if end > at else int(np.searchsorted(group[shared], last, "right"))
                some = shared[at:end]
                at = end
                columns = match_groups(sort[some], key[some], start[some], middle[some], joined.column(4).take(pa.array(some)).to_pylist(), width, share)
                yield pa.RecordBatch.from_arrays([pa.array(columns[:, i]) for i in range(5)], ["key", "start", "end", "partner", "link"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192:
                yield from groups(False)
        if held:
            yield from groups(True)

    return rows.repartition("sort").sortWithinPartitions("sort").mapInArrow(solve, "key long, start long, end long, partner long, link long")


def near_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, functions: int = 2, many: int = 16384) -> DataFrame:
    """doc_id, start, end (words [start, end)), partner_id, component_id: the passages that another document nearly repeats, joined per document."""
    width, share = min_words - SHINGLE + 1, 2 * similarity / (1 + similarity)
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    texts = keyed.select("key", "text")
    marks = kept(settle(windows_of(texts, functions, width), many))
    whole = marks.filter(F.col("partner").isNotNull()).select("key", F.col("l").cast("long").alias("start"), (F.col("r") + 1).cast("long").alias("end"), "partner", "link")
    found = whole.union(compared(around(texts, marks.filter("asked")), width, share))

    # runs of overlapping passages of a document: a run begins where a start lies beyond all ends before it
    sweep = W.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(sweep.rowsBetween(W.unboundedPreceding, -1))
    numbered = found.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(sweep.rowsBetween(W.unboundedPreceding, 0)))
    joined = kept(numbered.groupBy("key", "run").agg(
        F.min("start").alias("start"), (F.max("end") + (SHINGLE - 1)).alias("end"), F.min("partner").alias("partner"),
        F.collect_set("link").alias("links")).withColumn("node", F.xxhash64("key", "run")))
    ends = joined.select("node", F.explode("links").alias("link"))
    least = ends.groupBy("link").agg(F.min("node").alias("a"))
    reach = kept(components(ends.join(least, "link").select("a", F.col("node").alias("b"))))
    linked = joined.drop("links").join(reach, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    names = keyed.select("key", "doc_id").distinct()
    return (
        linked.join(names, "key").join(names.select(F.col("key").alias("partner"), F.col("doc_id").alias("partner_id")), "partner")
        .select("doc_id", "start", "end", "partner_id", "component_id"))
