"""Exact top-k inner products as a Voronoi kNN join.

With M the largest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0); then the nearest in Euclidean
distance is the one with the highest inner product. Pivots (a bounded number, the vectors with the smallest hash of their
id) cut both sides into Voronoi cells. Summaries per cell - the farthest query, and the k+1 candidates nearest to the
pivot - give each query cell a distance within which its answers must lie; a candidate is sent to a group of query cells
only if the triangle inequality allows one of them to need it. Each group is solved locally in blocks of bounded size,
and the blocks' best are merged.

The driver holds pivots, cell summaries and bounds: pivots squared times k numbers, whatever the table's size.

Defined cases: vectors that are NULL, or hold NULL, NaN or an infinity, take no part; shorter vectors, empty ones too, count
as padded with zeros; a repeated row is a candidate each time, but a repeated query is answered once; a query's own row is left out
once, other rows with its id stay; with fewer candidates than k all are returned. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import kept

QUERIES_IN_BLOCK = 2048
CANDIDATES_IN_BLOCK = 16384


def whole_vectors(table: DataFrame, scale: float) -> DataFrame:
    """vec_id, v (floor(scale * x) as packed doubles), n2 (squared norm); invalid vectors are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    ids.append(i)
                    packed.append(v.tobytes())
                    norms.append(float(v @ v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "n2"])

    return table.select("vec_id", "embedding").mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, v binary, n2 double")


def stacked(packed, width: int) -> np.ndarray:
    out = np.zeros((len(packed), width))
    for k, p in enumerate(packed):
        own = np.frombuffer(p, np.float64)
        out[k, :len(own)] = own
    return out


def _distances(rows: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From rows with their extra coordinate to pivots, which have it as their last column."""
    square = (rows ** 2).sum(1)[:, None] + lift[:, None] ** 2 + (pivots ** 2).sum(1)[None, :]
    return np.sqrt(np.maximum(0, square - 2 * (rows @ pivots[:, :-1].T + lift[:, None] * pivots[None, :, -1])))


def best_of(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per query the indices of the k highest inner products, ties to the smaller id."""
    for at in range(0, len(queries), 128):
        for score in queries[at:at + 128] @ points.T:
            rows = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            yield rows[np.lexsort((ids[rows], -score[rows]))[:k]]


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, n_pivots: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for each row for which ``is_query`` holds."""
    id_type = table.schema["vec_id"].dataType.simpleString()
    vectors = kept(whole_vectors(table, scale))
    count, width, largest = vectors.agg(F.count(F.lit(1)), F.max(F.length("v")), F.max("n2")).first()
    schema = f"query_id {id_type}, rank int, vec_id {id_type}, score long"
    if not count:
        return table.sparkSession.createDataFrame([], schema)
    width = (width or 0) // 8
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).collect()
    lift = lambda n2: np.sqrt(np.maximum(0, largest - np.asarray(n2, float)))
    pivots = np.unique(np.column_stack([stacked([r["v"] for r in chosen], width), lift([r["n2"] for r in chosen])]), axis=0)
    slack = 1e-6 * (1 + np.sqrt(largest))

    def assign(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    rows = stacked(part.column(1).to_pylist(), width)
                    n2 = part.column(2).to_numpy(zero_copy_only=False)
                    far = _distances(rows, np.zeros(len(rows)) if as_query else lift(n2), pivots)
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(rows)), cell])],
                        ["vec_id", "v", "cell", "d"])
        return run

    cells = f"vec_id {id_type}, v binary, cell int, d double"
    data = kept(vectors.mapInArrow(assign(False), cells))
    asked = kept(vectors.filter(is_query).dropDuplicates(["vec_id", "v"]).mapInArrow(assign(True), cells))
    # bounds from summaries
    near = data.select("cell", "d").withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("d"))).filter(F.col("r") <= k + 1)
    nearest = near.select("cell", "d").toPandas()
    farthest = asked.groupBy("cell").agg(F.max("d").alias("u"), F.count(F.lit(1)).alias("n")).toPandas().set_index("cell")
    if farthest.empty:
        return table.sparkSession.createDataFrame([], schema)
    between = _distances(pivots[:, :-1], pivots[:, -1], pivots)
    bound = {}
    for i, row in farthest.iterrows():
        upper = np.sort(row["u"] + between[i][nearest["cell"].to_numpy()] + nearest["d"].to_numpy())
        bound[i] = (row["u"], upper[k] if len(upper) > k else np.inf)
    # groups of neighbouring query cells with about a block of queries each
    groups: list[list[int]] = []
    open_cells = sorted(bound, key=lambda i: -farthest.loc[i, "n"])
    while open_cells:
        seed = open_cells[0]
        own, size = [], 0
        for i in sorted(open_cells, key=lambda j: between[seed][j]):
            if own and size + farthest.loc[i, "n"] > QUERIES_IN_BLOCK:
                break
            own.append(i)
            size += farthest.loc[i, "n"]
        groups.append(own)
        open_cells = [i for i in open_cells if i not in own]
    group_of = {i: g for g, own in enumerate(groups) for i in own}
    q_blocks = [max(1, int(np.ceil(farthest.loc[own, "n"].sum() / QUERIES_IN_BLOCK))) for own in groups]
    s_blocks = max(1, int(np.ceil(count / CANDIDATES_IN_BLOCK)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            block = batch.column(4).to_numpy()
            for g, own in enumerate(groups):
                goes = np.zeros(len(cell), bool)
                for i in own:
                    u, theta = bound[i]
                    apart = between[i][cell]
                    goes |= np.maximum(apart - u - d, d - apart - u) <= theta + slack
                rows = np.flatnonzero(goes)
                for b in range(q_blocks[g]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), g, np.int32)), pa.array(np.full(len(rows), b, np.int32)), pa.array(block[rows]),
                         batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.zeros(len(rows), bool))],
                        ["g", "qb", "sb", "vec_id", "v", "asks"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        q, s = rows[asks], rows[~asks]
        if q.empty or s.empty:
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": [], "own": []})
        queries, points, ids = stacked(q["v"].tolist(), width), stacked(s["v"].tolist(), width), s["vec_id"].to_numpy()
        packed, found = s["v"].to_numpy(), []
        for i, v, mine, best in zip(q["vec_id"], q["v"], queries, best_of(queries, points, ids, k + 1), strict=True):
            found.append(pd.DataFrame({"query_id": i, "q": v, "vec_id": ids[best], "score": (points[best] @ mine).astype(np.int64),
                                       "own": [x == i and packed[j] == v for x, j in zip(ids[best], best, strict=True)]}))
        return pd.concat(found, ignore_index=True)

    layout = f"g int, qb int, sb int, vec_id {id_type}, v binary, asks boolean"
    home = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(s_blocks)).cast("int")
    # equal rows spread too: a repeated row may go to any block
    sent = data.withColumn("sb", F.pmod(home + F.spark_partition_id(), F.lit(s_blocks)).cast("int")).mapInArrow(needed, layout)
    listed = table.sparkSession.createDataFrame(
        [(int(i), g, q_blocks[g]) for i, g in group_of.items()], "cell int, g int, n int")
    asking = (
        asked.join(F.broadcast(listed), "cell")  # a row per pivot at most
        .withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.col("n")).cast("int"))
        .withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(s_blocks - 1))))
        .select("g", "qb", "sb", "vec_id", "v", F.lit(True).alias("asks")))
    local = sent.union(asking).groupBy("g", "qb", "sb").applyInPandas(
        solve, f"query_id {id_type}, q binary, vec_id {id_type}, score long, own boolean")
    first_own = F.row_number().over(W.partitionBy("query_id", "q", "own").orderBy("vec_id"))
    ranked = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    others = local.withColumn("__o", first_own).filter(~(F.col("own") & (F.col("__o") == 1)))
    return others.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
