"""Members of tar and zip archives, read by Spark: archives are dealt to tasks by their size, one member at a time is in memory."""

from __future__ import annotations

import fnmatch
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a damaged, encrypted or unknown archive raises. A store that fails raises OSError instead: the task fails and Spark runs it again.
DAMAGE = (tarfile.TarError, zipfile.BadZipFile, EOFError, RuntimeError, zlib.error, lzma.LZMAError, pa.ArrowInvalid)
SCHEMA = "archive string, member string, content binary, problem string"


def _opened(path: str):
    """A seekable stream of a path of any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(at)


def _tar(stream, wanted) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=stream, mode="r|*") as archive:
        for entry in archive:
            if entry.isfile() and wanted(entry.name):
                yield entry.name, archive.extractfile(entry).read()


def _zip(stream, wanted) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(stream) as archive:
        for entry in archive.infolist():
            if not entry.is_dir() and wanted(entry.filename):
                yield entry.filename, archive.read(entry)


def _reader(pattern: str):
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("problem", pa.string())])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, only in zip(batch["path"].to_pylist(), batch["only"].to_pylist(), strict=True):
                names = None if only is None else set(only)
                wanted = lambda n: fnmatch.fnmatchcase(n, pattern) and (names is None or n in names)  # noqa: E731, B023
                try:
                    with _opened(path) as stream:
                        for name, content in (_zip if path.lower().endswith(".zip") else _tar)(stream, wanted):
                            yield row(path, name, content, None)
                except DAMAGE as error:
                    yield row(path, None, None, f"{type(error).__name__}: {error}")

    return read


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def members(spark: SparkSession, path: str, pattern: str = "*", wanted: DataFrame | None = None) -> DataFrame:
    """(archive, member, content, problem) of the members below ``path`` whose name fits the pattern.

    ``wanted`` (archive, member), archives by their file name, keeps only those members: archives without any are not opened,
    unwanted members are not kept in memory. Repeated wanted rows count once, rows with a null name not at all. An archive
    that is damaged gives the members before the damage and one row with its problem; other archives go on. Members of one
    name are all given. A file without bytes gives no row, as Spark lists none. A member is a value of one row, so it must
    stay below 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    if wanted is None:
        asked = files.withColumn("only", F.lit(None).cast("array<string>"))
    else:
        lists = wanted.dropna(subset=["archive", "member"]).groupBy(F.col("archive").alias("name")).agg(F.collect_set("member").alias("only"))
        asked = files.join(lists, file_name(F.col("path")) == F.col("name")).select("path", "only")
    return asked.mapInArrow(_reader(pattern), SCHEMA)
