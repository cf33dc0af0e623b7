"""What the corpus operators share: words, let-bindings, tables kept between steps, lines of a document."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends there and nothing is computed twice.

    The files are replicated by the store, so a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside nested lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the given positions (an array, NULL for none)."""
    every = lines(text)
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), dropped)
    return F.when(dropped.isNull(), text).otherwise(
        let(every, lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")))


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """Replace the text; a column ``n_chars`` follows it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
