"""Continuous forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.columns import duration_micros
from millrace.operators.joins import semi_new_rows
from millrace.operators.modelling import FittedModel, predict_batch
from millrace.sources.sinks import path_has_data, stored_max

LATE = "6 hours"


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType | str, time_col: str, max_files: int | None = None) -> DataFrame:
    """Files of a folder as a stream; times become timestamps, which watermarks require."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder).withColumn(time_col, F.col(time_col).cast("timestamp"))


def stream_resample(log: DataFrame, tag_cols: Sequence[str], time_col: str, value_col: str, step: str = "1 minute", late: str = LATE) -> DataFrame:
    """Mean per tag and bucket, emitted when the watermark has passed the bucket."""
    buckets = log.withWatermark(time_col, late).groupBy(*tag_cols, F.window(time_col, step).alias("__w"))
    return buckets.agg(F.avg(value_col).alias(value_col), F.count(value_col).alias("n")).select(
        *tag_cols, F.col("__w.start").alias(time_col), value_col, "n")


def stream_dedup(log: DataFrame, keys: Sequence[str], time_col: str, late: str = LATE) -> DataFrame:
    """One row per key within the lateness horizon."""
    return log.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))


def stream_score(log: DataFrame, model: FittedModel) -> DataFrame:
    return predict_batch(model, log)


def insert_only_newer(path: str, late_path: str, series_cols: Sequence[str], time_col: str):
    """Batch writer: rows newer than their series' stored maximum are appended, older ones are kept aside and counted.

    A batch that is replayed after a failure finds its rows stored already: these are neither appended again nor late. Late rows carry the batch number.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            first = batch.agg(F.min(time_col)).first()[0]
            if first is None:
                return
            if path_has_data(spark, path):
                # a stored maximum older than the whole batch decides nothing, so older files are not read
                recent = spark.read.parquet(path).filter(F.col(time_col) >= F.lit(first))
                limits = stored_max(recent, series_cols, time_col)
                fresh = semi_new_rows(batch, limits, series_cols, time_col).select(*batch.columns)
                joined = batch.join(limits, list(series_cols)).filter(F.col(time_col) <= F.col("max_ts"))
                same = [c for c in batch.columns]
                already = recent.select(*[F.col(c).alias(f"__{c}") for c in same])
                equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
                late = joined.join(already, equal, "left_anti")
                late.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(late_path)
            else:
                fresh = batch
            fresh.write.mode("append").parquet(path)
        finally:
            batch.unpersist()

    return write


def stream_incremental(stream: DataFrame, path: str, late_path: str, checkpoint: str, series_cols: Sequence[str], time_col: str):
    """Process what has arrived since the last run and stop: the scheduled append."""
    return (stream.writeStream.foreachBatch(insert_only_newer(path, late_path, series_cols, time_col))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def last_value_processor(key_names: Sequence[str], ttl_ms: int | None) -> StatefulProcessor:
    """Processor that holds the newest non-null value of a key; each row leaves with the value that holds at its time.

    A local class travels to the workers by value, also to the one that prepares state and gets no shipped files.
    Rows of a key within one micro-batch are put in time order; bound a batch with ``maxFilesPerTrigger``.
    """
    names = list(key_names)

    class LastValue(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
            self.last = handle.getValueState("last", schema, ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            held = self.last.get() if self.last.exists() else None
            frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
            known = frame.loc[frame["value"].notna()]
            if held is None:
                filled = frame["value"].ffill()
            else:
                # the held value takes its place in time: older rows do not see it, newer ones not what came before it
                before = (frame["ts"] < pd.Timestamp(held[0])).to_numpy()
                later = pd.concat([pd.Series([held[1]]), frame["value"][~before]]).ffill().iloc[1:]
                filled = pd.concat([frame["value"][before].ffill(), later])
            if len(known):
                newest = known.iloc[-1]
                if held is None or newest["ts"] >= pd.Timestamp(held[0]):
                    self.last.update((newest["ts"].to_pydatetime(), float(newest["value"])))
            out = frame[["ts", "seq"]].copy()
            out["value"] = filled.to_numpy()
            for name, part in zip(names, key):
                out[name] = part
            yield out[[*names, "ts", "seq", "value"]]

        def close(self) -> None:
            pass

    return LastValue()


def ordered_fill_processor(key_names: Sequence[str], bucket_ms: int) -> StatefulProcessor:
    """Processor that keeps rows until the watermark has passed them and lets them go in time order, filled forwards.

    Rows wait in buckets of event time, each with a timer at its end; a batch touches the buckets of its own rows only, so the state of a
    key is what arrived within the lateness, and a backlog of any length passes through it chunk by chunk.
    """
    names = list(key_names)

    class OrderedFill(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", T.StructType([T.StructField("value", T.DoubleType())]))
            lists = [T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType()))]
            self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("bucket", T.LongType())]), T.StructType(lists))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            for frame in rows:
                us = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
                for bucket, part in frame.assign(us=us).groupby(us // (1000 * bucket_ms), sort=True):
                    end = (int(bucket) + 1) * bucket_ms
                    if end <= passed:  # its time has gone: too late
                        continue
                    mine = (part["us"].tolist(), part["seq"].tolist(), [None if pd.isna(v) else float(v) for v in part["value"]])
                    if self.waiting.containsKey((int(bucket),)):
                        mine = tuple([*old, *new] for old, new in zip(self.waiting.getValue((int(bucket),)), mine, strict=True))
                    else:
                        self.handle.registerTimer(end)
                    self.waiting.updateValue((int(bucket),), mine)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            ready = sorted(b for (b,) in self.waiting.keys() if (b + 1) * bucket_ms <= passed)
            held = self.last.get()[0] if self.last.exists() else None
            for bucket in ready:  # all that are due, in order, whatever timer came first
                rows = []
                for us, seq, value in sorted(zip(*self.waiting.getValue((bucket,)), strict=True), key=lambda r: r[:2]):
                    held = held if value is None else value
                    rows.append((us, seq, held))
                self.waiting.removeKey((bucket,))
                out = pd.DataFrame({"ts": pd.to_datetime([r[0] for r in rows], unit="us"), "seq": [r[1] for r in rows],
                                    "value": pd.Series([r[2] for r in rows], dtype="float64")})
                for name, part in zip(names, key, strict=True):
                    out[name] = part
                yield out[[*names, "ts", "seq", "value"]]
            if held is not None:
                self.last.update((held,))

        def close(self) -> None:
            pass

    return OrderedFill()


def stream_step_fill(log: DataFrame, key_cols: Sequence[str], ttl_ms: int | None = None, late: str | None = None, bucket: str = "1 minute") -> DataFrame:
    """Forward fill of ``value`` per key across batches. Input: key columns, ts, seq (tie-break), value.

    Without ``late`` each row leaves at once, with the value known so far. With it rows wait until the watermark, ``late`` behind the
    newest time, has passed their ``bucket``, and leave in time order, whatever order they came in; rows behind the watermark are dropped.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    types = dict((f.name, f.dataType) for f in log.schema.fields)
    schema = T.StructType([*[T.StructField(c, types[c]) for c in key_cols], T.StructField("ts", T.TimestampType()),
                           T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])
    slim = log.select(*key_cols, "ts", "seq", "value")
    if late is not None:
        if ttl_ms is not None:
            raise ValueError("rows in event time do not expire by the clock: give either late or ttl_ms")
        processor = ordered_fill_processor(key_cols, duration_micros(bucket) // 1000)
        return slim.withWatermark("ts", late).groupBy(*key_cols).transformWithStateInPandas(processor, schema, "append", "EventTime")
    mode = "ProcessingTime" if ttl_ms else "None"
    return slim.groupBy(*key_cols).transformWithStateInPandas(last_value_processor(key_cols, ttl_ms), schema, "append", mode)
