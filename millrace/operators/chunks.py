"""Order-dependent work on series of any length.

A series may hold a large share of all rows, so a window over a whole series would put it in one task. Every
operator therefore works on *chunks*: pieces of a series that are short in time (or in row numbers). Two ways of
joining chunks are used:

* **carry** - what a chunk must know of the rows before or after it is one row per chunk (a count, a sum, the last
  value); a window over those summary rows, not over the data, brings it across;
* **halo** - rows near a chunk border are copied into the neighbouring chunk, frame functions run inside a chunk, and
  the copies are dropped. One shuffle, no second pass.

Rows need a non-null series key and time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import chunk_of, duration_micros

CHUNK = "__chunk"
HOME = "__home"
POSITION = "__pos"
DEFAULT_CHUNK = "1 day"
DEFAULT_ROWS = 100_000
GRID_POINTS = 1_000


def time_position(time_col: str) -> Column:
    return F.unix_micros(F.col(time_col))


def _keys(series_cols: Sequence[str]) -> list[str]:
    return [*series_cols, CHUNK]


def chunk_window(series_cols: Sequence[str], order: Sequence[Column | str]) -> W:
    return W.partitionBy(*_keys(series_cols)).orderBy(*order)


def with_time_chunk(df: DataFrame, time_col: str, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Add the chunk number; a frame that was chunked earlier keeps its chunks."""
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, chunk_of(time_position(time_col), duration_micros(chunk)))


def grid_chunk(step: str, chunk: str = DEFAULT_CHUNK) -> str:
    """The default chunk of a grid holds at least ``GRID_POINTS`` points: a day of hours would be 24 rows, nearly as many summary rows
    and border copies as data. A chunk that is named stays as it is."""
    least = GRID_POINTS * duration_micros(step)
    return f"{least} us" if chunk == DEFAULT_CHUNK and least > duration_micros(chunk) else chunk


def carry(
    df: DataFrame,
    series_cols: Sequence[str],
    summary: Mapping[str, Column],
    before: Mapping[str, Callable[[W], Column]] | None = None,
    after: Mapping[str, Callable[[W], Column]] | None = None,
) -> DataFrame:
    """Join to each row of a chunked frame what the chunks before or after it pass on.

    ``summary`` is aggregated per chunk with map-side combine. ``before`` and ``after`` are window expressions over
    the earlier (later) summary rows of the series; both frames grow one row at a time, never shrink.

    The join is a shuffled hash join on (series, chunk) with the summary as the built side: nothing is broadcast on an
    estimate, the data is shuffled once by the keys of the chunk windows that follow, and never by the series alone.
    """
    per_chunk = df.groupBy(*_keys(series_cols)).agg(*[c.alias(n) for n, c in summary.items()])
    up = W.partitionBy(*series_cols).orderBy(F.col(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*series_cols).orderBy(F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)
    passed = per_chunk.select(
        *_keys(series_cols),
        *[make(up).alias(n) for n, make in (before or {}).items()],
        *[make(down).alias(n) for n, make in (after or {}).items()],
    )
    return df.join(passed.hint("shuffle_hash"), _keys(series_cols), "inner")


def row_index(
    df: DataFrame,
    series_cols: Sequence[str],
    time_col: str,
    *,
    tie_cols: Sequence[str] = (),
    name: str = "row_index",
    total: str | None = None,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Number rows of each series from 0 in time order; ``total`` adds the series' row count."""
    chunked = with_time_chunk(df, time_col, chunk)
    later = {"__later": lambda w: F.sum("__n").over(w)} if total else None
    joined = carry(
        chunked, series_cols, {"__n": F.count(F.lit(1))},
        before={"__base": lambda w: F.sum("__n").over(w)}, after=later,
    )
    base = F.coalesce(F.col("__base"), F.lit(0))
    inside = F.row_number().over(chunk_window(series_cols, [time_col, *tie_cols]))
    out = joined.withColumn(name, (base + inside - 1).cast("long"))
    if total:
        here = F.count(F.lit(1)).over(W.partitionBy(*_keys(series_cols)))
        out = out.withColumn(total, base + here + F.coalesce(F.col("__later"), F.lit(0)))
    return out.drop(CHUNK, "__base", "__later")


def prefix_sums(
    df: DataFrame,
    series_cols: Sequence[str],
    time_col: str,
    sums: Mapping[str, Column],
    *,
    tie_cols: Sequence[str] = (),
    index: str = "row_index",
    total: str = "n_rows",
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Row number plus, per entry of ``sums``, the sum over all earlier rows of the series (NULL counts as 0).

    One carry for all sums and the row number together. The series' row count is added as ``total``; the total of a
    sum is its prefix at the last row plus that row's own term.
    """
    chunked = with_time_chunk(df, time_col, chunk)
    for name, term in sums.items():
        chunked = chunked.withColumn(f"__t_{name}", F.coalesce(term.cast("double"), F.lit(0.0)))
    summary = {"__n": F.count(F.lit(1)), **{f"__s_{n}": F.sum(f"__t_{n}") for n in sums}}

    def summed(column: str) -> Callable[[W], Column]:
        return lambda w: F.sum(column).over(w)

    before = {"__base": summed("__n"), **{f"__b_{n}": summed(f"__s_{n}") for n in sums}}
    joined = carry(chunked, series_cols, summary, before=before, after={"__later": summed("__n")})
    w = chunk_window(series_cols, [time_col, *tie_cols])
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.col("__base"), F.lit(0))
    here = F.count(F.lit(1)).over(W.partitionBy(*_keys(series_cols)))
    out = joined.select(
        *df.columns,
        (base + F.row_number().over(w) - 1).cast("long").alias(index),
        (base + here + F.coalesce(F.col("__later"), F.lit(0))).cast("long").alias(total),
        *[
            (F.coalesce(F.col(f"__b_{n}"), F.lit(0.0)) + F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0.0))).alias(n)
            for n in sums
        ],
    )
    return out


def with_halo(df: DataFrame, position: Column, length: int, before: int, after: int) -> DataFrame:
    """Copy rows into every chunk that needs them.

    A chunk of ``length`` positions needs the rows up to ``before`` positions ahead of its first and ``after``
    positions behind its last. ``__home`` marks the one copy that belongs to the chunk.
    """
    placed = df.withColumn(POSITION, position)
    pos = F.col(POSITION)
    own = chunk_of(pos, length)
    first, last = chunk_of(pos - F.lit(after), length), chunk_of(pos + F.lit(before), length)
    return placed.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(HOME, F.col(CHUNK) == own)


def by_chunk(df: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Partition by (series, chunk) explicitly: input that is already partitioned by series would not be split."""
    return df.repartition(*_keys(series_cols))


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME)).drop(CHUNK, HOME, POSITION)


def framed(
    df: DataFrame,
    series_cols: Sequence[str],
    time_col: str,
    before: int,
    after: int,
    build: Callable[[W], Mapping[str, Column]],
    *,
    step: str | None = None,
    tie_cols: Sequence[str] = (),
    chunk: str = DEFAULT_CHUNK,
    rows_per_chunk: int = DEFAULT_ROWS,
) -> DataFrame:
    """Add columns computed over the rows ``before`` .. ``after`` around each row.

    ``build`` gets the ordered chunk window and returns named columns. With ``step`` the series is a regular grid, so
    distance in rows equals distance in time and no row number is needed; without it rows are numbered first.
    """
    if step is not None:
        unit = duration_micros(step)
        length = max(duration_micros(grid_chunk(step, chunk)), unit * max(1, before + after))
        placed = with_halo(df, time_position(time_col), length, before * unit, after * unit)
    else:
        numbered = row_index(df, series_cols, time_col, tie_cols=tie_cols, name="__i", chunk=chunk)
        length = max(rows_per_chunk, before + after, 1)
        placed = with_halo(numbered, F.col("__i"), length, before, after)
    w = W.partitionBy(*_keys(series_cols)).orderBy(POSITION, *([] if step is None else tie_cols))
    out = by_chunk(placed, series_cols).select("*", *[c.alias(n) for n, c in build(w).items()])
    return home_rows(out).drop("__i")
