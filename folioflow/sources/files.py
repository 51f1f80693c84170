"""File sources: lists, signatures, JSON folders, page ranges. All are read by Spark, in any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The first bytes of PNG and JPEG files.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF"}


def listed(text: Column) -> Column:
    """(place, entry) of a list's text: without byte-order mark, blank lines and ``#`` lines; entries are trimmed."""
    lines = F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n")
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("place"), F.trim(x).alias("entry")))
    return F.filter(rows, lambda r: (r["entry"] != "") & ~r["entry"].startswith("#"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, entry) in the order of the file; a path that can't be read is an error that names it."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.explode(listed(F.col("value"))).alias("r")).select("file", "r.place", "r.entry")


def text_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(file, text) of all files below a folder whose name fits the pattern."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def image_kind(content: Column) -> Column:
    """png or jpeg by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for kind, mark in SIGNATURES.items():
        out = F.when(head.startswith(mark), kind).otherwise(out)
    return out


def checked_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, length, kind) of the images below a folder, and (file, problem) of what is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length", image_kind(F.col("content")).alias("kind"))
    return files.where("kind is not null"), files.where("kind is null").select("file", F.lit("not a PNG or JPEG file").alias("problem"))


def stem(path: Column) -> Column:
    """The file name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def parent(path: Column) -> Column:
    """The name of the folder that holds a path, with either separator."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)


def json_folder(spark: SparkSession, path: str, schema: str, manifest: DataFrame, key: str, least: int = 0, text: str = "text") -> DataFrame:
    """JSON records of a folder joined with their manifest by file stem, texts of ``least`` characters or more."""
    records = spark.read.schema(schema).json(path, multiLine=True).withColumn(key, stem(F.col("_metadata.file_path")))
    return records.where(F.length(text) >= least).join(manifest, key)


def zipped(inputs: Column, outputs: Column) -> Column:
    """Pairs (input, output) by position; an error if the lengths differ."""
    return F.when(F.size(inputs) == F.size(outputs), F.arrays_zip(inputs.alias("input"), outputs.alias("output"))).otherwise(F.raise_error(F.lit("inputs and outputs differ in length")))


def capped(files: DataFrame, folder: Column, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each folder."""
    return files.withColumn("nth", F.row_number().over(Window.partitionBy(folder).orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def page_numbers(spec: Column, pages: Column) -> Column:
    """Sorted distinct numbers of a range text like ``1-10,12,5-``; null where a number is out of 1..pages or not one."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.when(p.rlike(r"^\d+$"), low(p)).when(p.rlike(r"^\d+-$"), pages).otherwise(F.regexp_extract(p, r"-(\d+)$", 1).cast("int"))
    fine = F.forall(parts, lambda p: p.rlike(r"^\d+(-\d*)?$") & (low(p) >= 1) & (low(p) <= high(p)) & (high(p) <= pages))
    return F.when(fine, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def run_outputs(spark: SparkSession, path: str, result: str) -> DataFrame:
    """(page, result) of a run, whichever way it was kept; ``result`` is the schema of a page's result.

    A folder holds a JSON file for each page: its stem names the page, and files without a ``result`` are skipped. A file is
    a report: its ``inputs`` and the outputs of its first sample pair up by position, to the end of the shorter; the folder
    of an input names the page.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.from_json("value", f"result struct<{result}>")["result"].alias("result"), stem(F.col("_metadata.file_path")).alias("page"))
        return rows.where("result is not null").select("page", "result")
    report = spark.read.text(path, wholetext=True).select(F.from_json("value", f"inputs array<struct<path:string>>, samples array<struct<outputs:array<struct<{result}>>>>").alias("r"))
    inputs, outputs = F.col("r.inputs"), F.get("r.samples", F.lit(0))["outputs"]
    n = F.least(F.size(inputs), F.size(outputs))
    pairs = F.slice(F.arrays_zip(inputs.alias("input"), outputs.alias("output")), 1, F.greatest(n, F.lit(0)))
    return report.select(F.explode(pairs).alias("p")).select(parent(F.col("p.input.path")).alias("page"), F.col("p.output").alias("result"))
