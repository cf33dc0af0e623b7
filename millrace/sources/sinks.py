"""Writing tables, increments, CSV results and bin tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import to_numeric
from millrace.operators.joins import semi_new_rows
from millrace.session import kept_table

# written with microseconds, so that a round trip is exact
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# one row per day and shift
ORE_QUALITY_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()), T.StructField("Shift", T.IntegerType()), T.StructField("TimeStamp", T.TimestampType()),
    T.StructField("Class_15", T.DoubleType()), T.StructField("Class_12", T.DoubleType()), T.StructField("Grano", T.DoubleType()),
    T.StructField("Daiki", T.DoubleType()), T.StructField("Shisti", T.DoubleType()), T.StructField("Original_Sheet", T.StringType()),
])


def write_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ("mill",)) -> None:
    """Replace a table, one folder per mill; tasks write their own files, so a large mill needs no gathering."""
    writer = df.write.mode("overwrite")
    cols = [c for c in partition_by if c in df.columns]
    (writer.partitionBy(*cols) if cols else writer).parquet(path)


def write_jdbc(df: DataFrame, table: str, options: Mapping[str, str], mode: str = "append", batch: int = 1000) -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", str(batch)).mode(mode).save()


def stored_max(df: DataFrame, series_cols: Sequence[str], time_col: str) -> DataFrame:
    return df.groupBy(*series_cols).agg(F.max(time_col).alias("max_ts"))


def path_has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists and holds rows."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return False
    listed = files.listFiles(folder, True)
    while listed.hasNext():
        inside = listed.next().getPath().toString()[len(files.makeQualified(folder).toString()):]
        if inside.endswith(".parquet") and not any(part.startswith(("_", ".")) for part in inside.split("/")):
            return not spark.read.parquet(path).isEmpty()
    return False


# --- high-water marks ----------------------------------------------------------------------------------------------

MARKS, MONTH = "_marks", "month"


def with_month(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumn(MONTH, F.date_format(time_col, "yyyy-MM"))


def append_marks(written: DataFrame, path: str, series_cols: Sequence[str], time_col: str) -> None:
    """Note the largest time of each series among rows just written, in a folder that readers of the table do not see."""
    stored_max(written, series_cols, time_col).write.mode("append").parquet(f"{path}/{MARKS}")


def known_marks(spark: SparkSession, path: str, series_cols: Sequence[str]) -> DataFrame | None:
    """The largest noted time per series, or None where a table has no marks."""
    if not path_has_data(spark, f"{path}/{MARKS}"):
        return None
    return spark.read.parquet(f"{path}/{MARKS}").groupBy(*series_cols).agg(F.max("max_ts").alias("max_ts"))


def stored_since(stored: DataFrame, marks: DataFrame, series_cols: Sequence[str], time_col: str, listed: int = 512) -> DataFrame:
    """Rows of a table that are newer than their series' mark: what a run wrote that did not come to note its marks.

    Up to ``listed`` series become a condition of their own each, so that folders (by series and month) and row groups before a
    mark are not read, and one series that has stopped does not widen what is read of the others. With more, the oldest mark is the condition.
    """
    known = marks.limit(listed + 1).collect()
    if not known:
        return stored
    month = MONTH in stored.columns
    if len(known) > listed:
        known = [marks.agg(F.min("max_ts").alias("max_ts")).first()]
        series_cols = []
    wanted = F.lit(False)
    for row in known:
        own = F.col(time_col) > F.lit(row["max_ts"])
        for c in series_cols:
            own = F.col(c).eqNullSafe(F.lit(row[c])) & own
        if month:
            own = own & (F.col(MONTH) >= F.date_format(F.lit(row["max_ts"]), "yyyy-MM"))
        wanted = wanted | own
    if series_cols:  # a series that has no mark is read whole
        named = F.lit(False)
        for row in known:
            same = F.lit(True)
            for c in series_cols:
                same = same & F.col(c).eqNullSafe(F.lit(row[c]))
            named = named | same
        wanted = wanted | ~named
    return stored.filter(wanted)


def stored_limits(spark: SparkSession, path: str, series_cols: Sequence[str], time_col: str) -> DataFrame:
    """Largest stored time per series: the marks, and what was written beyond them. A table without marks is read once."""
    stored, marks = spark.read.parquet(path), known_marks(spark, path, series_cols)
    if marks is None:
        return stored_max(stored, series_cols, time_col)
    marks = kept_table(marks)
    beyond = stored_max(stored_since(stored, marks, series_cols, time_col), series_cols, time_col)
    # series without a mark were first written by a run that did not end
    return kept_table(marks.unionByName(beyond).groupBy(*series_cols).agg(F.max("max_ts").alias("max_ts")))


def write_append_new(df: DataFrame, path: str, series_cols: Sequence[str], time_col: str, partition_by: Sequence[str] = ("mill",)) -> None:
    """Append rows newer than each series' stored maximum; create the table when it is absent or empty.

    The maxima are noted beside the table with each append, so old rows are not read again.
    """
    spark = df.sparkSession
    cols = [c for c in partition_by if c in df.columns]
    there = path_has_data(spark, path)
    fresh = semi_new_rows(df, stored_limits(spark, path, series_cols, time_col), series_cols, time_col) if there else df
    fresh = kept_table(fresh.select(*df.columns))
    writer = fresh.write.mode("append" if there else "overwrite")
    (writer.partitionBy(*cols) if cols else writer).parquet(path)
    append_marks(fresh, path, series_cols, time_col)


def _typed(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return to_numeric(name)
    if isinstance(kind, T.IntegerType):
        return to_numeric(name).cast("int")
    return F.col(name).cast("string").try_cast(kind.simpleString()) if not isinstance(kind, T.StringType) else F.col(name).cast("string")


def typed_rows(df: DataFrame, schema: T.StructType = ORE_QUALITY_SCHEMA, required: Sequence[str] = ("Date", "Shift", "TimeStamp")) -> tuple[DataFrame, DataFrame]:
    """Rows cast to ``schema``, and the rejected rows whose required cells cannot be read (with the reason)."""
    cast = df.select("*", F.struct(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields]).alias("__row"))
    bad = F.filter(F.array(*[F.when(F.col(f"__row.{c}").isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
    marked = cast.withColumn("unreadable", bad)
    good = marked.filter(F.size("unreadable") == 0).select("__row.*")
    rejected = marked.filter(F.size("unreadable") > 0).drop("__row")
    return good, rejected


def write_typed(df: DataFrame, path: str, rejected_path: str, schema: T.StructType = ORE_QUALITY_SCHEMA) -> None:
    good, rejected = typed_rows(df, schema)
    good.write.mode("append").parquet(path)
    rejected.write.mode("append").parquet(rejected_path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", TIME_FORMAT).csv(path)


def write_bin_info(info: DataFrame, path: str) -> None:
    info.coalesce(1).write.mode("overwrite").json(path)  # one row per feature


def read_bin_info(spark: SparkSession, path: str) -> DataFrame:
    from millrace.operators.binning import BIN_INFO_SCHEMA

    return spark.read.schema(BIN_INFO_SCHEMA).json(path)


def truncate_tables(spark: SparkSession, tables: Sequence[str]) -> None:
    """Empty the named tables, keeping their schemas."""
    for name in tables:
        spark.createDataFrame([], spark.table(name).schema).write.mode("overwrite").insertInto(name)
