"""Session and lineage helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once; workers import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="run-"), "millrace"), "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    sc.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="run-"), "checkpoints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that loops and reused inputs are not recomputed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; with ``partition_by`` a filter reads only its folders."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
