"""Run records as JSON lines: a source that bears damage, resume, and sinks that never overwrite."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.workspace import shared_dir


def record_line(fields: list[str], error: Column | None = None, options: Column | None = None) -> Column:
    """A success row ``{path, page, .., options}`` or an error row ``{path, page, error}``; nulls are left out."""
    fine = F.to_json(F.struct("path", "page", *fields, *([options.alias("options")] if options is not None else [])))
    return fine if error is None else F.when(error.isNotNull(), F.to_json(F.struct("path", "page", error.alias("error")))).otherwise(fine)


def like_a_record(line: Column, start: str = '{"path":') -> Column:
    """Whether a line may be the beginning of a record."""
    return line.startswith(start) | F.lit(start).startswith(line)


def classed(lines: DataFrame) -> DataFrame:
    """Adds kind (record, error, cut, damaged, foreign, blank) to (value): nothing that can't be parsed is fatal."""
    line = F.regexp_replace("value", "^﻿", "")
    path, page, text, error = (F.get_json_object(line, f"$.{k}") for k in ("path", "page", "text", "error"))
    kind = (
        F.when(F.trim(line) == "", "blank")
        .when(line.contains("\0"), "damaged")
        .when(path.isNull(), F.when(like_a_record(line), "cut").otherwise("foreign"))
        .when(error.isNotNull(), "error")
        .when(text.isNotNull(), "record")
        .otherwise("foreign")
    )
    return lines.select(line.alias("line"), kind.alias("kind"), path.alias("path"), F.coalesce(page.cast("int"), F.lit(1)).alias("page"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(line, kind, path, page) of a records folder; a folder that isn't there has no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return classed(spark.createDataFrame([], "value string"))
    return classed(spark.read.text(path))


def done(rows: DataFrame) -> DataFrame:
    """(path, page) with a successful record."""
    return rows.where("kind = 'record'").select("path", "page").distinct()


def pending(inputs: DataFrame, rows: DataFrame) -> DataFrame:
    """Inputs (path, page) without a successful record. Inputs that occur twice are refused."""
    twice = inputs.groupBy("path", "page").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['path']} occurs twice in the inputs")
    return inputs.join(done(rows), ["path", "page"], "left_anti")


def by_run(rows: DataFrame, settings: list[str], current: dict | None = None) -> DataFrame:
    """Records per combination of settings (JSON paths), and whether it is the current one; absent settings are null."""
    read = rows.where("kind = 'record'").select(*(F.get_json_object("line", f"$.{s}").alias(s.replace(".", "_")) for s in settings))
    names = [s.replace(".", "_") for s in settings]
    counted = read.groupBy(*names).agg(F.count("*").alias("n"))
    if current is None:
        return counted
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.lit(current.get(n)).cast("string"))
    return counted.withColumn("current", same)


def summary(inputs: DataFrame, rows: DataFrame) -> DataFrame:
    """Inputs by status: done, failed, not_run."""
    best = rows.where("kind in ('record', 'error')").groupBy("path", "page").agg(F.max((F.col("kind") == "record").cast("int")).alias("ok"))
    status = F.when(F.col("ok") == 1, "done").when(F.col("ok") == 0, "failed").otherwise("not_run")
    return inputs.join(best, ["path", "page"], "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- sinks -----------------------------------------------------------------------------------------------------------


def write_new(df: DataFrame, path: str) -> None:
    """Writes a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def fingerprint(df: DataFrame) -> tuple:
    """Count and order-free sums of row hashes."""
    row = F.xxhash64(*(df[c] for c in sorted(df.columns)))
    return tuple(df.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first())


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def freeze(df: DataFrame, path: str) -> str:
    """Writes a table once; a second time its rows must be the same. Returns written or identical."""
    if not exists(df.sparkSession, path):
        write_new(df, path)
        return "written"
    if fingerprint(df) != fingerprint(df.sparkSession.read.parquet(path)):
        raise ValueError(f"{path} holds other rows")
    return "identical"


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames, so that readers see all rows or none."""
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.part")
    if not fs.rename(make(f"{path}.part"), make(path)):
        raise OSError(f"{path} could not be put in place")


def repaired(spark: SparkSession, path: str, to: str) -> DataFrame:
    """A new records folder with the intact lines of an old one; cut and damaged lines go, foreign ones are refused."""
    rows = scan(spark, path)
    if foreign := rows.where("kind = 'foreign'").limit(1).collect():
        raise ValueError(f"a line of {path} is no record: {foreign[0]['line'][:80]}")
    rows.where("kind in ('record', 'error')").select("line").write.mode("errorifexists").text(to)
    return scan(spark, to)


def prepared(spark: SparkSession, path: str, configuration: dict, resume: bool = False) -> bool:
    """Opens an output folder: a new one must be empty, a resumed one must hold the same configuration. True if resumed."""
    text = json.dumps(configuration, sort_keys=True)
    if exists(spark, f"{path}/configuration"):
        found = spark.read.text(f"{path}/configuration").first()[0]
        if not resume or found != text:
            raise ValueError(f"{path} holds a run" + (" of another configuration" if resume else ""))
        return True
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/configuration")
    return False


def complete(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Problems (key, problem): missing, repeated or unexpected rows. None: every expected row is there once."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("asked", F.lit(True)).join(counted, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def job_plan(jobs: DataFrame) -> DataFrame:
    """Jobs with an id that their settings decide: the SHA-256 of them as JSON with sorted names."""
    return jobs.withColumn("job_id", F.sha2(F.to_json(F.struct(*sorted(jobs.columns)), {"ignoreNullFields": "false"}), 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that nothing uses yet."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
