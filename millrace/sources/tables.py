"""Tables, catalog, landed sheets and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import year_from_name
from millrace.operators.modelling import METADATA_SCHEMA


def scan_table(spark: SparkSession, table: str, columns: Sequence[str] = ("*",), where: str | None = None, limit: int | None = None) -> DataFrame:
    df = spark.table(table)
    if where:
        df = df.where(where)
    df = df.selectExpr(*columns)
    return df.limit(limit) if limit is not None else df


def run_sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """SQL text over the catalog; frames given by keyword become temporary views of that name."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def catalog_profile(spark: SparkSession, tables: Sequence[str] | None = None, time_col: str | None = None) -> DataFrame:
    """Per table: columns with types, rows, latest time. One aggregate per table."""
    names = list(tables) if tables is not None else [t.name for t in spark.catalog.listTables()]
    out = None
    for name in names:
        df = spark.table(name)
        newest = F.max(F.col(time_col).cast("timestamp")) if time_col in df.columns else F.lit(None).cast("timestamp")
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), newest.alias("max_ts")).select(
            F.lit(name).alias("table_name"), F.array(*[F.lit(f"{c} {t}") for c, t in df.dtypes]).alias("columns"), "n_rows", "max_ts")
        out = part if out is None else out.unionByName(part)
    return out


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def scan_sheets(spark: SparkSession, path: str, *, format: str = "csv", schema=None) -> DataFrame:
    """Landed sheet rows of many files: ``sheet``, ``row_no`` and text columns, plus file and year of the file name."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    return df.withColumn("row_no", F.col("row_no").cast("int")).withColumn("file_year", year_from_name("file"))


def scan_model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*_metadata.json`` below ``folder`` with its name and whether the model beside it exists.

    Metadata may be a file or a folder written by Spark. The listing of model files is names only, not contents.
    """
    meta = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(f"{folder}/*_metadata.json")
    name = F.regexp_extract("__path", r"([^/]+)_metadata\.json", 1)
    meta = meta.withColumn("__path", F.col("_metadata.file_path")).withColumn("model_name", name).drop("__path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = files.select(F.regexp_extract("path", r"([^/]+)_model(?:/|\.|$)", 1).alias("model_name")).filter("model_name != ''").distinct()
    joined = meta.join(found.withColumn("__has", F.lit(True)), "model_name", "left")
    return joined.withColumn("files_complete", F.coalesce("__has", F.lit(False))).drop("__has")
