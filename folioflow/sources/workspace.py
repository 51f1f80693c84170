"""Tables of a session and the shared folder for intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local session (``local[..]``) gets a temporary folder, kept in the session's settings;
    on a cluster that folder would be unseen by executors, so the call is refused.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or spark.conf.get("folioflow.scratch", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("folioflow.scratch", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` frame that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(df: DataFrame, weight: Column, each: int) -> int:
    """Tasks of a shuffle: the session's number, or more where one would get more than ``each`` of the rows' summed weight."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Holds Arrow batches of texts small, so that Python workers stay small whatever a text's length."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
