"""MLlib's boosted trees from sums per cell, a short job a round.

A tree sees of a row only in which bin of each feature it lies. Where the bins of all features make few cells, the sums of a
round's sample per cell are all that a tree needs, so a round is one pass over
the rows instead of two stages per level, and the tree is grown on the driver. For the squared error the samples of many rounds are summed in one pass.
Bins, samples and trees are those that MLlib's own fit makes of the same rows in the same partitions, with sums added in another order.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Cells whose sums travel to the driver each round.
MOST_CELLS = 1 << 17
#: Cells that are scored once each instead of the rows.
MOST_SCORED = 1 << 16
#: Partitions of training rows that a task of a round goes through, and those it looks at together.
TASK_BLOCKS, TOGETHER = 64, 16
LANES = 256
#: Rounds whose samples are summed in one job, fewer where there are many cells.
AHEAD = 30
EPSILON = 2.0 ** -52
U = np.uint64
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


# --- draws -----------------------------------------------------------------------------------------------------------


def hashed_seeds(seeds: np.ndarray) -> np.ndarray:
    """Spark's start states of its generator for these seeds: two Murmur hashes of the eight bytes."""
    m = np.uint32

    def rolled(x: np.ndarray, by: int) -> np.ndarray:
        return (x << m(by)) | (x >> m(32 - by))

    data = seeds.astype(np.int64).view(U)

    def murmur(h: np.ndarray) -> np.ndarray:
        for shift in (32, 0):
            k = ((data >> U(shift)) & U(0xFFFFFFFF)).astype(m).byteswap()
            h = rolled(h ^ (rolled(k * m(0xCC9E2D51), 15) * m(0x1B873593)), 13) * m(5) + m(0xE6546B64)
        h = h ^ m(8)
        h = (h ^ (h >> m(16))) * m(0x85EBCA6B)
        h = (h ^ (h >> m(13))) * m(0xC2B2AE35)
        return h ^ (h >> m(16))

    low = murmur(np.full(data.shape, 0x3C074A61, m))
    return (murmur(low).astype(U) << U(32)) | low.astype(U)


def stepped(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << U(21))
    state = state ^ (state >> U(35))
    return state ^ (state << U(4))


@lru_cache(16)
def leap(steps: int) -> np.ndarray:
    """The images of the 64 bits after so many steps; a step is linear in the bits."""
    out, power = U(1) << np.arange(64, dtype=U), stepped(U(1) << np.arange(64, dtype=U))
    while steps:
        if steps & 1:
            out = leapt(power, out)
        power, steps = leapt(power, power), steps >> 1
    return out


def leapt(images: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for bit in range(64):
        out ^= images[bit] * ((state >> U(bit)) & U(1))
    return out


def draws(seeds: np.ndarray, many: int) -> np.ndarray:
    """``many`` numbers in [0, 1) for each seed, as ``nextDouble`` of Spark's generator gives them; lanes of each go side by side."""
    each = -(-many // LANES)
    state, images, lanes = hashed_seeds(seeds)[:, None], leap(2 * each), 1
    while lanes < LANES:
        state, images, lanes = np.concatenate([state, leapt(images, state)], axis=1), leapt(images, images), 2 * lanes
    out = np.empty((each, len(seeds), LANES))
    for i in range(each):
        state = stepped(state)
        high = state & U((1 << 26) - 1)
        state = stepped(state)
        out[i] = ((high << U(27)) + (state & U((1 << 27) - 1))) * 2.0 ** -53
    return out.transpose(1, 2, 0).reshape(len(seeds), -1)[:, :many]


# --- bins and rows ---------------------------------------------------------------------------------------------------


def thresholds(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Up to ``most`` of them at equal weights, from sampled values of which so much weight is ``expected``; what is missing counts as zeros."""
    some = values != 0.0
    held, place = np.unique(values[some], return_inverse=True)
    if not len(held):
        return np.zeros(0)
    weight = np.bincount(place, weights[some])
    zeros = expected - weight.sum()
    if zeros > EPSILON * some.sum() * 100:
        at = int(np.searchsorted(held, 0.0))
        held, weight = np.insert(held, at, 0.0), np.insert(weight, at, zeros)
    middles = (held[:-1] + held[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride, sums, found = expected / (most + 1), np.cumsum(weight), []
    target = stride
    for i in range(1, len(held)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def bins_of(train: DataFrame, weight: str, most: int, seed: int) -> list[np.ndarray]:
    """Thresholds of each feature, from the sample that MLlib takes."""
    spark = train.sparkSession
    count, weights = train.agg(F.count(F.lit(1)), F.sum(weight)).first()
    need = max(min(most, count) ** 2, 10_000)
    share = need / count if need < count else 1.0
    rows = train
    if share < 1:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sampled = train._jdf.javaRDD().sample(False, share, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(sampled, train._jdf.schema()), spark)
    found = rows.select(vector_to_array("__features").alias("x"), F.col(weight).alias("w")).toPandas()
    x, w = np.stack(found["x"].to_numpy()), found["w"].to_numpy()
    return [thresholds(x[:, f], w, share * weights, min(most, count) - 1) for f in range(x.shape[1])]


def blocks(rows: DataFrame, label: str, weight: str, edges: list[np.ndarray]) -> DataFrame:
    """A row per partition: its number, and the cells, labels and weights of its rows as bytes."""
    shape = [len(e) + 1 for e in edges]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, labels, weights = [], [], []
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(edges))
            bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
            cells.append(np.ravel_multi_index(bins, shape).astype(np.int32))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            if not np.isfinite(labels[-1]).all():
                raise ValueError("a label is NULL, NaN or infinite")
            weights.append(batch.column(2).to_numpy())
        if cells:
            held = [pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in (cells, labels, weights)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *held], ["number", "cells", "labels", "weights"])

    return cut_lineage(rows.select(vector_to_array("__features").alias("x"), F.col(label).alias("y"), F.col(weight).alias("w")).mapInArrow(
        packed, "number int, cells binary, labels binary, weights binary"))


def sampled(held: list, level: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, ...]:
    """A round's sample of some blocks: cells, weights and what ``level`` leaves of the labels."""
    many = max(len(cells) for _, cells, _, _ in held)
    taken = draws(seed + 1 + np.array([number for number, *_ in held]), many) < rate if rate < 1 else np.ones((len(held), many), bool)
    cells, y, w = (np.concatenate([block[i][use[:len(block[1])]] for block, use in zip(held, taken, strict=True)]) for i in (1, 2, 3))
    return cells, w, y - level[cells]


# --- trees -----------------------------------------------------------------------------------------------------------


def impurity(stats: np.ndarray) -> np.ndarray:
    """Variance from weight, sum and squares in the last axis."""
    n, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def grow(sums: np.ndarray, bins: list[np.ndarray], edges: list[np.ndarray], depth: int) -> tuple[dict[int, dict], np.ndarray]:
    """Nodes by number (children of i are 2i and 2i + 1) and the prediction of each cell, from the ``sums`` per cell."""
    at, nodes, wanted = np.ones(len(sums), np.int64), {}, [1]
    kept: dict[int, np.ndarray] = {}
    for level in range(depth + 1):
        if not wanted:
            break
        place = np.full(int(at.max()) + 1, -1)
        place[wanted] = np.arange(len(wanted))
        rows = np.flatnonzero(place[at] >= 0)
        best: list[tuple | None] = [None] * len(wanted)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            wide = len(edge) + 1
            spot = place[at[rows]] * wide + bins[f][rows]
            total = np.stack([np.bincount(spot, sums[rows, k], len(wanted) * wide) for k in range(4)], axis=-1).reshape(len(wanted), wide, 4).cumsum(axis=1)
            left, whole = total[:, :-1], total[:, -1:]
            right = whole - left
            if not level and 1 not in kept:
                kept[1] = left[0, 0] + right[0, 0]
            own = impurity(np.stack([kept[i] for i in wanted]))
            count = left[..., 0] + right[..., 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = own[:, None] - left[..., 0] / count * impurity(left) - right[..., 0] / count * impurity(right)
                valid = (left[..., 3] >= 1) & (right[..., 3] >= 1) & (gain >= 0)
            gain = np.where(valid, gain, -np.inf)
            top = gain.argmax(axis=1)
            for n, split in enumerate(top):
                if best[n] is None or gain[n, split] > best[n][0]:
                    best[n] = (float(gain[n, split]), f, int(split), left[n, split], right[n, split])
        following = []
        for n, number in enumerate(wanted):
            gain, f, split, left, right = best[n]
            stats = kept[number]
            node = nodes[number] = {"stats": stats, "impurity": float(impurity(stats)) if gain >= 0 else -1.0}
            if gain <= 0 or level == depth:
                continue
            node |= {"gain": gain, "feature": f, "threshold": float(edges[f][split])}
            own = at == number
            at[own] = 2 * number + (bins[f][own] > split)
            for child, held in ((2 * number, left), (2 * number + 1, right)):
                kept[child] = held
                nodes[child] = {"stats": held, "impurity": float(impurity(held))}
                if level + 1 < depth and abs(nodes[child]["impurity"]) >= EPSILON:
                    following.append(child)
        wanted = following
    for number in sorted(nodes, reverse=True):  # children that say the same become one leaf
        node = nodes[number]
        if "gain" in node and not any("gain" in nodes[c] for c in (2 * number, 2 * number + 1)) and mean(nodes[2 * number]["stats"]) == mean(nodes[2 * number + 1]["stats"]):
            node["said"] = mean(nodes[2 * number]["stats"])
            for key in ("gain", "feature", "threshold"):
                del node[key]
    said = np.zeros(int(at.max()) + 1)
    for number in map(int, np.unique(at)):
        leaf = next(i for k in reversed(range(number.bit_length())) if "gain" not in nodes[i := number >> k])
        said[number] = nodes[leaf].get("said", mean(nodes[leaf]["stats"]))
    return nodes, said[at]


def node_rows(tree: int, nodes: dict[int, dict]) -> list[tuple]:
    """Rows of a tree as MLlib stores them, numbered in depth-first order."""
    rows: list[tuple] = []

    def add(number: int) -> int:
        node, own = nodes[number], len(rows)
        rows.append(())
        inner = "gain" in node
        left, right = (add(2 * number), add(2 * number + 1)) if inner else (-1, -1)
        stats = [float(x) for x in node["stats"][:3]]
        rows[own] = (tree, (own, node.get("said", mean(node["stats"])), node["impurity"], stats, int(node["stats"][3]), node["gain"] if inner else -1.0, left, right,
                            (node["feature"], [node["threshold"]], -1) if inner else (-1, [], -1)))
        return own

    add(1)
    return rows


def as_model(spark: SparkSession, gbt: GBTRegressor, trees: list[dict[int, dict]], weights: list[float], features: int) -> GBTRegressionModel:
    """The fitted model, through files in MLlib's own form."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/boosted-{uuid.uuid4().hex}"
    gbt.save(f"{folder}/estimator")
    said = json.loads(spark.read.text(f"{folder}/estimator/metadata").first()[0])
    own = {k: v for k, v in said["paramMap"].items() if k in ("featuresCol", "labelCol", "predictionCol", "weightCol", "maxDepth", "seed")}
    defaults = {k: v for k, v in said["defaultParamMap"].items() if k not in ("featureSubsetStrategy", "lossType", "maxIter", "stepSize", "subsamplingRate", "validationTol")}
    tree = {**said, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": own, "defaultParamMap": defaults}
    model = {**said, "class": "org.apache.spark.ml.regression.GBTRegressionModel", "numFeatures": features, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    spark.createDataFrame([(i, json.dumps({**tree, "uid": f"dtr_{i:012x}"}), w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    spark.createDataFrame([row for i, nodes in enumerate(trees) for row in node_rows(i, nodes)], NODES).coalesce(1).write.parquet(f"{folder}/data")
    return GBTRegressionModel.load(folder)


# --- rounds ----------------------------------------------------------------------------------------------------------


def boost(gbt: GBTRegressor, train: DataFrame, watched: DataFrame | None, rounds: int,
          settled: Callable[[Sequence[float]], tuple[int, bool]]) -> tuple[GBTRegressionModel, int | None, float | None] | None:
    """Model, best round and its absolute error on the watched rows; ``settled`` (errors) is the best round and whether no more are needed.

    None if there are too many cells, or a tree would draw features for each node.
    """
    spark, label, weight = train.sparkSession, gbt.getLabelCol(), gbt.getWeightCol()
    share, features = gbt.getFeatureSubsetStrategy(), len(train.first()["__features"])
    if share != "all" and np.ceil(float(share) * features) < features:
        return None
    seed, rate, step, absolute = gbt.getSeed(), gbt.getSubsamplingRate(), gbt.getStepSize(), gbt.getLossType() == "absolute"
    edges = bins_of(train, weight, gbt.getMaxBins(), seed)
    shape = [len(e) + 1 for e in edges]
    size = int(np.prod(shape, dtype=float))
    if not 1 < size <= MOST_CELLS:
        return None
    ship_package(spark)
    bins = list(np.unravel_index(np.arange(size), shape))
    held = blocks(train, label, weight, edges)
    if watched is not None:
        held = held.union(blocks(watched, label, weight, edges).withColumn("number", F.lit(-1)))
    tasks = min(held.rdd.getNumPartitions(), max(spark.sparkContext.defaultParallelism, held.rdd.getNumPartitions() // TASK_BLOCKS))
    packs = held.rdd.coalesce(tasks).map(lambda r: (
        r["number"], np.frombuffer(r["cells"], np.int32), np.frombuffer(r["labels"]), np.frombuffer(r["weights"]))).persist()

    def job(at: int, many: int, around: np.ndarray, signs: bool, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the samples of ``many`` rounds from ``at``, of labels less ``around`` or of their signs, and the errors of ``levels``."""
        def work(mine: Iterator) -> Iterator:
            sums, error, some = np.zeros((many, 4, size)), np.zeros((len(levels), 2)), []

            def add() -> None:
                for k in range(many):
                    cells, w, left = sampled(some, around, seed + at + k, rate)
                    left = np.where(left < 0, -1.0, 1.0) if signs else left
                    for i, v in enumerate((w, w * left, w * left * left, None)):
                        sums[k, i] += np.bincount(cells, v, size)
                some.clear()

            for block in mine:
                if block[0] < 0:
                    for k, level in enumerate(levels):
                        error[k] += (block[3] * np.abs(block[2] - level[block[1]])).sum(), block[3].sum()
                elif many:
                    some.append(block)
                    if len(some) == TOGETHER:
                        add()
            if some:
                add()
            yield sums, error

        found = packs.mapPartitions(work).collect()
        return sum(s for s, _ in found).transpose(0, 2, 1), sum(e for _, e in found)

    trees, errors, best = [], [], None
    levels: list[np.ndarray] = []  # after each round that has not been judged
    level, middle = np.zeros(size), None
    try:
        while True:
            at = len(trees)
            # what is left of the labels in a cell follows from its sums, so samples for the squared error are taken some rounds ahead
            if at == 0:
                many = 1
            elif absolute:
                many = min(1, rounds - at)
            else:
                many = min(AHEAD, max(1, MOST_CELLS * 8 // size), rounds - at)
            if not many and watched is None:
                break
            sums, error = job(at, many, level if absolute or middle is None else middle, absolute and at > 0, levels if watched is not None else [])
            errors += [float(e / n) for e, n in error]
            if errors:
                best, done = settled(errors)
                if done:
                    break
            if not many:
                break
            levels = []
            for own in sums:
                if len(trees) and not absolute:
                    w, d, rest = own[:, 0], own[:, 1], middle - level
                    own = np.stack([w, 2 * (d + rest * w), 4 * (own[:, 2] + 2 * rest * d + rest * rest * w), own[:, 3]], axis=1)
                nodes, said = grow(own, bins, edges, gbt.getMaxDepth())
                level = level + said * (step if trees else 1.0)
                middle = level if middle is None else middle
                trees.append(nodes)
                levels.append(level)
    finally:
        packs.unpersist()
    trees = trees if best is None else trees[:best + 1]
    model = as_model(spark, gbt.setMaxIter(rounds), trees, [1.0, *[step] * (len(trees) - 1)], features)
    return model, best, None if best is None else errors[best]


# --- scores ----------------------------------------------------------------------------------------------------------


def split_points(model: GBTRegressionModel) -> list[np.ndarray]:
    """All thresholds of the ensemble, per feature."""
    found: list[set[float]] = [set() for _ in range(model.numFeatures)]
    for feature, value in re.findall(r"If \(feature (\d+) <= (\S+)\)", model.toDebugString):
        found[int(feature)].add(float(value))
    return [np.array(sorted(x)) for x in found]


def score_by_cells(model: GBTRegressionModel, rows: DataFrame, inputs: Sequence[Column], output: str) -> DataFrame | None:
    """``rows`` with the model's prediction for ``inputs``, looked up: between two thresholds of a feature all trees say the same, so each cell is scored once.

    None if there are too many cells.
    """
    points = split_points(model)
    shape = [len(p) + 1 for p in points]
    size = int(np.prod(shape, dtype=float))
    if size > MOST_SCORED:
        return None

    def place(x: Column, edge: np.ndarray, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(x <= F.lit(float(edge[half])), place(x, edge, low, half)).otherwise(place(x, edge, half + 1, high))

    cell = F.lit(0)
    for x, edge in zip(inputs, points, strict=True):
        missing = F.raise_error("Encountered null or NaN in a feature").cast("int")
        cell = cell * F.lit(len(edge) + 1) + F.when(x.isNull() | F.isnan(x), missing).otherwise(place(x, edge, 0, len(edge)))
    # the upper end of a cell is in it; the last has none
    ends = [np.append(p, p[-1] + max(1.0, abs(p[-1]))) if len(p) else np.zeros(1) for p in points]
    grid = np.stack([e[b] for e, b in zip(ends, np.unravel_index(np.arange(size), shape), strict=True)], axis=1)
    table = rows.sparkSession.createDataFrame(pd.DataFrame({"__cell": np.arange(size, dtype=np.int32), "x": grid.tolist()}), "__cell int, x array<double>")
    scored = model.transform(table.withColumn("__features", array_to_vector("x"))).select("__cell", F.col(model.getPredictionCol()).alias(output))
    return rows.withColumn("__cell", cell).join(F.broadcast(scored), "__cell", "left").select(*rows.columns, output)
