"""Conversation prefix trie, built as a burst trie.

A node of depth d is a distinct sequence of the first d turns; conversations that begin with it are its members. A turn is known
by 16 bytes of the SHA-256 of its role and text, so text is never shuffled; conversations with the same turns are one class
with its smallest id and the number of them.

All classes start in one container under the root. In each round a container with more than ``most`` classes is burst:
its classes go to a container per next turn, whose head is a node of the trie. Containers that are small enough are dealt to
shards; a shard sorts the suffixes of a container and sweeps over them once, with a stack of the open nodes. What a subtree sums
(leaves, saved tokens) is carried up over the burst nodes, a level at a time. Rounds are as many as the deepest burst.

A conversation of any length, and a class of any size, is spread over tasks: turns are numbered by ranges of the sorted table, a
conversation alone in its container becomes nodes row by row, member lists are hashed as a stream of sorted blocks. Only a container of
several long conversations is held by a task: ``most`` times their turns, 24 bytes each.

Defined cases: NULL role or text is empty; NULL turn sorts first; turns with the same number are ordered by their hash, equal rows
count each; rows without conv_id take no part; an empty table has no nodes. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import kept

WIDTH = 16  # bytes of a turn id
MOST = 4096  # classes in a container
IN_BLOCK = 512  # ids in a block of a member list
NOBODY = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "end_rep long, end_weight long, head binary")


def _turn_id(role: Column, text: Column) -> Column:
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, chars: turns in order. Ranges of the sorted table are numbered apart and offset by the counts before."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_id(role, text).alias("id"), F.length(text).cast("long").alias("chars"))
    dealt = kept(rows.repartitionByRange("conv_id", "turn", "id").withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "id"))
    return dealt.join(base, ["conv_id", "part"]).select("conv_id", (F.col("base") + inside).cast("long").alias("pos"), "id", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversation c with its first h turns taken from conversation c - c % ``group``; h = crc32(decimal c) % ``most``.

    ``turns`` as of ``numbered``. Each conversation also gets a row at pos 0, so that one without turns is still there.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    first = turns.filter((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "id", "chars")
    there = first.groupBy("base").agg(F.max("pos").alias("there"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(there, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    lent = convs.join(first, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", "pos", "id", "chars")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "id", "chars")
    mark = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars"))
    return lent.unionByName(own).unionByName(mark)


def with_marks(turns: DataFrame) -> DataFrame:
    """Conversations as they are, with a row at pos 0 each."""
    mark = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars"))
    return turns.unionByName(mark)


def sweep(classes: list[tuple[bytes, int, int, np.ndarray]], depth: int) -> list[list]:
    """Nodes under the head of one container, the head first, from (turn ids, smallest id, members, characters of each turn).

    A node is [smallest id, depth, parent, members, children, leaves, saved below and here, smallest id and size of the class that ends here].
    """
    head = [None, depth, None, 0, 0, 0, 0, None, None]
    found, stack, spent, last = [head], [head], [0], b""

    def close() -> None:
        node, chars = stack.pop(), spent.pop()
        above = stack[-1]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * chars
        above[0] = node[0] if above[0] is None else min(above[0], node[0])
        above[3] += node[3]
        above[4] += 1
        above[5] += node[5]
        above[6] += node[6]

    for ids, rep, weight, chars in sorted(classes, key=lambda c: c[0]):
        common, end = 0, min(len(last), len(ids))
        while common < end and last[common:common + WIDTH] == ids[common:common + WIDTH]:
            common += WIDTH
        common //= WIDTH
        while len(stack) > common + 1:
            close()
        for k in range(common, len(ids) // WIDTH):
            node = [rep, depth + k + 1, stack[-1], 0, 0, 0, 0, None, None]
            found.append(node)
            stack.append(node)
            spent.append(int(chars[k]))
        node = stack[-1]
        node[0] = rep if node[0] is None else min(node[0], rep)
        node[3] += weight
        node[7], node[8] = rep, weight
        last = ids
    while len(stack) > 1:
        close()
    head[5] = head[5] or 1
    return found


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, rep, weight, pos, id, chars) sorted by node, rep, pos: the nodes of each container."""
    schema = pa.schema([(n, t) for n, t in zip(
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "end_weight", "head"],
        [pa.int64()] * 9 + [pa.binary()], strict=True)])
    node, depth, classes, ready = None, 0, {}, []

    def close() -> None:
        own = [(b"".join(ids), rep, weight, np.array(chars, np.int64)) for rep, (weight, ids, chars) in classes.items()]
        for k, n in enumerate(sweep(own, depth)):
            ready.append((n[0], n[1], n[2][0] if n[2] else None, *n[3:], None if k else node))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
        ready.clear()
        return out

    for batch in batches:
        for own, d, rep, weight, _, turn, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != node:
                if classes:
                    close()
                node, depth, classes = own, d, {}
                if len(ready) > 20_000:
                    yield flush()
            one = classes.get(rep)
            if one is None:
                one = classes[rep] = (weight, [], [])
            if turn is not None:
                one[1].append(turn)
                one[2].append(chars)
    if classes:
        close()
    if ready:
        yield flush()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, conv_id) in order to (rep, first, ids): runs of at most IN_BLOCK members, comma-joined."""
    for batch in batches:
        reps, ids = (c.to_numpy() for c in batch.columns)
        new = np.append(True, reps[1:] != reps[:-1]) if len(reps) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        within = np.arange(len(reps)) - np.repeat(starts, np.diff(np.append(starts, len(reps))))
        starts = np.flatnonzero(within % IN_BLOCK == 0)
        ends = np.append(starts[1:], len(reps))
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(reps[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], ["rep", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to (rep, ends): SHA-256 of the whole list, a block at a time."""
    rep, state = None, hashlib.sha256()
    for batch in batches:
        reps, ends = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != rep:
                if rep is not None:
                    reps.append(rep)
                    ends.append(state.hexdigest())
                rep, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ends, pa.string())], ["rep", "ends"])
    if rep is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["rep", "ends"])


def member_hashes(members: DataFrame) -> DataFrame:
    """(rep, ends) from (rep, conv_id): SHA-256 of the decimal ids, ascending, comma-joined.

    Ranges of the sorted pairs are joined to blocks where they lie; a list's hash then reads its blocks in order, as a stream.
    """
    blocks = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_blocks, "rep long, first long, ids string")
    return blocks.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_hashed, "rep long, ends string")


def prefix_trie(paths: DataFrame, most: int = MOST) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, pos, id, chars), with a row at pos 0 each, as of ``rebuilt`` or ``with_marks``.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = paths.sparkSession
    paths = kept(paths)
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "id")).alias(f"x{k}") for k in range(3)]
    same = ["n", "x0", "x1", "x2"]
    keyed = kept(paths.groupBy("conv_id").agg(F.max("pos").alias("n"), *lanes))
    root = F.lit(bytes(WIDTH))
    classes = kept(keyed.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("node", root))
    many = classes.filter(F.col("weight") > 1)
    ends = member_hashes(keyed.join(many, same).select("rep", "conv_id"))
    steps = kept(paths.filter(F.col("pos") > 0).join(classes.select(F.col("rep").alias("conv_id")), "conv_id").withColumnRenamed("conv_id", "rep"))

    at = classes.select("rep", "weight", "n", "node")
    heads, closed, burst_ends, depth = [], [], [], 0
    level = at.agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs")).filter(F.col("conv_id").isNotNull()).select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    while True:
        heads.append(kept(level))
        sizes = kept(at.groupBy("node").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("weight").alias("members")))
        big = sizes.filter(F.col("n_classes") > most)
        small = sizes.filter(F.col("n_classes") <= most)
        closed.append(kept(at.join(small, "node").select("rep", "weight", "n", "node", F.lit(depth).cast("long").alias("depth"), (F.col("members") == 1).alias("alone"))))
        if big.isEmpty():
            break
        burst = at.join(big.select("node"), "node")
        burst_ends.append(kept(burst.filter(F.col("n") == depth).select("node", F.col("rep").alias("end_rep"), F.col("weight").alias("end_weight"))))
        step = steps.filter(F.col("pos") == depth + 1).select("rep", "id", "chars")
        child = F.unhex(F.substring(F.sha2(F.concat("node", "id"), 256), 1, 2 * WIDTH))
        moved = kept(burst.filter(F.col("n") > depth).join(step, "rep").select("rep", "weight", "n", child.alias("child"), F.col("node").alias("parent"), "chars"))
        level = moved.groupBy(F.col("child").alias("node")).agg(
            F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"))
        at = moved.select("rep", "weight", "n", F.col("child").alias("node"))
        depth += 1

    small = closed[0]
    for more in closed[1:]:
        small = small.unionByName(more)
    # a conversation alone in its container is a chain: a node per turn
    after = small.filter("alone").join(steps.drop("chars"), "rep").filter(F.col("pos") > F.col("depth"))
    last, none = F.col("pos") == F.col("n"), F.lit(None)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = after.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.col("rep")).alias("end_rep"), F.when(last, one).alias("end_weight"), none.cast("binary").alias("head"))
    ended = F.col("n") == F.col("depth")
    chain_heads = small.filter("alone").select(
        F.col("rep").alias("conv_id"), "depth", none.cast("long").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(ended, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(ended, F.col("rep")).alias("end_rep"), F.when(ended, one).alias("end_weight"), F.col("node").alias("head"))
    suffixes = small.filter(~F.col("alone")).alias("c").join(
        steps.alias("s"), (F.col("c.rep") == F.col("s.rep")) & (F.col("s.pos") > F.col("c.depth")), "left").select(
        "node", "depth", "c.rep", "weight", "pos", "id", "chars")
    swept = suffixes.repartition("node").sortWithinPartitions("node", "rep", "pos").mapInArrow(_swept, NODE)
    inner = kept(swept.unionByName(chain).unionByName(chain_heads))

    # subtree sums of the heads, from the deepest up
    figures = ["n_children", "n_leaves", "saved_tokens", "end_rep", "end_weight"]
    summary = inner.filter(F.col("head").isNotNull()).select(F.col("head").alias("node"), *figures)
    done, below = [], None
    for d in reversed(range(len(heads))):
        here = summary
        if below is not None:
            up = below.groupBy(F.col("parent").alias("node")).agg(
                F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            here = here.unionByName(up.join(burst_ends[d], "node", "left").select("node", *figures))
        own = heads[d].join(here, "node").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
        below = kept(own)
        above = heads[d - 1].select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")) if d else None
        named = below.join(above, "parent") if d else below.withColumn("parent_conv_id", none.cast("long"))
        done.append(named.select("conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", *figures))
    nodes = inner.filter(F.col("head").isNull()).drop("head")
    for part in done:
        nodes = nodes.unionByName(part)
    hashed = F.coalesce("ends", F.when(F.col("end_rep").isNull(), F.lit(NOBODY)).otherwise(F.sha2(F.col("end_rep").cast("string").cast("binary"), 256)))
    return nodes.join(ends.withColumnRenamed("rep", "end_rep"), "end_rep", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", hashed.alias("ends_sha256"))
