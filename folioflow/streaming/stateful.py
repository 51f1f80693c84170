"""Structured Streaming: opening and finishing streams, cohorts, sessions, dedup and joins; ``keyed`` has ordered release and loop stops.

Each operator takes a streaming frame (a batch frame works for the stateless ones) and keeps bounded state per key; the
batch forms in ``folioflow.operators`` give the same rows once a stream has ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.sources.workspace import shared_dir
from folioflow.streaming.keyed import rocks_store


def opened(spark: SparkSession, folder: str, name: str = "*.parquet", files: int | None = None) -> DataFrame:
    """The Parquet files of a folder whose name fits, as a stream, ``files`` files to a batch; times have a zone, as watermarks need."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    out = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, on the RocksDB state store, and gives its rows. Complete mode keeps the last batch, by an idempotent sink."""
    with rocks_store(stream.sparkSession):
        return _finished(stream, name, mode)


def _finished(stream: DataFrame, name: str, mode: str) -> DataFrame:

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    writer.foreachBatch(batch_sink(f"{path}/rows")).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def batch_sink(path: str):
    """A sink that writes each batch once: a repeated batch overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def waiting_failure(rows: DataFrame, by: str, index: str, failed: str) -> DataFrame:
    """(by, blocked_at): keys with a failure behind an index that hasn't come; the batch form of the stop signal."""
    came = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.col(index))).alias("came"), F.min(F.when(F.col(failed), F.col(index))).alias("bad"))
    missing = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("bad")), "came"))
    return came.where("bad is not null").select(by, missing.alias("blocked_at")).where("blocked_at is not null")


def counted_cohorts(stream: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """(by, cohort, n, total): batches of exactly ``size`` rows of a key, as soon as they are full."""
    rows = stream.select(F.col(by).cast("long").alias("by"), F.col(value).cast("double").alias("value"))

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cohort, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for frame in frames:
            for v in frame["value"]:
                n, total = n + 1, total + (0.0 if pd.isna(v) else float(v))
                if n == size:
                    out.append((key[0], cohort, n, total))
                    cohort, n, total = cohort + 1, 0, 0.0
        state.update((cohort, n, total))
        yield pd.DataFrame(out, columns=["by", "cohort", "n", "total"])

    out = rows.groupBy("by").applyInPandasWithState(gather, "by long, cohort long, n long, total double", "cohort long, n long, total double", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("by", by)


def session_counts(stream: DataFrame, by: str, ts: str, gap: str, late: str) -> DataFrame:
    """(by, first_ts, n): sessions by a gap, closed when the watermark passes them."""
    window = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(window, by).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts")).select(by, "first_ts", "n")


def once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, by: str, ts: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with one key where the right one follows within a time; state is cut by the watermarks."""
    one = left.withWatermark(ts, late)
    two = right.select(F.col(by).alias("other_by"), F.col(ts).alias("other_ts"), *(F.col(c).alias(f"other_{c}") for c in right.columns if c not in (by, ts))).withWatermark("other_ts", late)
    near = (F.col(by) == F.col("other_by")) & (F.col("other_ts") >= F.col(ts)) & (F.col("other_ts") <= F.col(ts) + F.expr(f"interval {within}"))
    return one.join(two, near).drop("other_by")


def enriched(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream with a static table beside it."""
    return stream.join(table, key, "left")
