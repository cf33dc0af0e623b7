from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from millrace.session import build_session

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


def make_spark() -> SparkSession:
    spark = build_session(
        "millrace-tests", master=f"local[{os.environ.get('TEST_CPUS', '8')}]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-"),
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        })
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_spark()
