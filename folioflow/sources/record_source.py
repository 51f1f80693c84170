"""Run records as a Spark data source: ``spark.read.format("records")`` and ``df.write.format("records").mode("append")``.

Reading takes byte ranges of the files of a folder, so a file of any size is read by many tasks: a task has the lines that begin
in its range. A last line that a crash cut, even inside a character, is kind ``cut``; other bytes that aren't UTF-8 refuse the
file, and so does a line that is no record if ``foreign`` is ``refuse`` (the default; ``keep`` gives it kind ``foreign``).

Writing appends. Each task writes a part file aside; the commit first cuts what a crash left at the end of earlier files
(or ends their last line), then moves the parts in, so a failed write leaves the folder as it was. Files are reached by
Arrow's file systems (a local or shared folder, HDFS, an object store) from tasks and driver alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, offset long, line string, kind string, path string, page int"
BOM = b"\xef\xbb\xbf"
START = b'{"path":'
RANGE = 64 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def files_of(path: str) -> list[arrow_fs.FileInfo]:
    """The record files of a folder (or the one file), by name; nothing if it isn't there."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.File:
        return [info]
    if info.type == arrow_fs.FileType.NotFound:
        return []
    found = system.get_file_info(arrow_fs.FileSelector(at))
    return sorted((f for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def kind_of(line: bytes, last: bool) -> tuple[str, str | None, int | None]:
    """(kind, path, page) of a line; ``last`` says that no line end follows it. Raises ValueError for foreign bytes."""
    if not line.strip(b" \t\r"):
        return "blank", None, None
    if b"\0" in line:
        return "damaged", None, None
    try:
        text = line.decode()
    except UnicodeDecodeError as error:
        if last and error.end == len(line) and error.reason == "unexpected end of data":
            return "cut", None, None
        raise ValueError("bytes that are not UTF-8") from None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return ("cut" if line.startswith(START) or START.startswith(line) else "foreign"), None, None
    if not isinstance(value, dict) or not isinstance(value.get("path"), str):
        return "foreign", None, None
    page = value.get("page")
    kind = "error" if value.get("error") is not None else "record" if value.get("text") is not None else "foreign"
    return kind, value["path"], page if isinstance(page, int) else 1


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.keep = options.get("foreign", "refuse") == "keep"

    def partitions(self) -> list[ByteRange]:
        cut = [ByteRange(f.path, k, min(k + self.range, f.size)) for f in files_of(self.path) for k in range(0, f.size, self.range)]
        return cut or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if not part.file:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as file:
            for offset, line, last in _lines(file, part.begin, part.end):
                line = line.removeprefix(BOM) if offset == 0 else line
                try:
                    kind, path, page = kind_of(line, last)
                except ValueError as error:
                    raise ValueError(f"{part.file}, byte {offset}: {error}") from None
                if kind == "foreign" and not self.keep:
                    raise ValueError(f"{part.file}, byte {offset}: no record (a JSON object with a path): {line[:80]!r}")
                yield part.file, offset, line.decode(errors="replace"), kind, path, page


def _lines(file, begin: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, whether no line end follows) of the lines that begin in [begin, end); a line may run on beyond it."""
    at = max(0, begin - 1)
    file.seek(at)
    held, start, skipping = [], at, begin > 0
    while at < end or held or skipping:
        data = file.read(piece)
        if not data:
            break
        from_ = 0
        while (cut := data.find(b"\n", from_)) >= 0:
            if not skipping:
                yield start, b"".join([*held, data[from_:cut]]), False
            held, skipping, from_, start = [], False, cut + 1, at + cut + 1
            if start >= end:
                return
        if not skipping and from_ < len(data):
            held.append(data[from_:])
        at += len(data)
    if held:
        yield start, b"".join(held), True


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("records are appended, never overwritten")
        self.path, self.run = options["path"], uuid.uuid4().hex

    def _aside(self) -> str:
        return f"{opened(self.path)[1]}/_{self.run}"

    def write(self, rows: Iterator) -> Written:
        system, _ = opened(self.path)
        system.create_dir(self._aside(), recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{self._aside()}/{name}") as out:
            for row in rows:
                out.write(row["line"].encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for info in files_of(self.path):
            _repair(system, info)
        system.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.rows:
                system.move(f"{self._aside()}/{message.part}", f"{root}/{message.part}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        if system.get_file_info(self._aside()).type == arrow_fs.FileType.Directory:
            system.delete_dir(self._aside())


def _tail(system: arrow_fs.FileSystem, info: arrow_fs.FileInfo, piece: int = 1 << 16) -> tuple[int, bytes]:
    """Where a file's last line begins, and that line; empty if the file ends with a line end."""
    with system.open_input_file(info.path) as file:
        end, data = info.size, b""
        while end:
            begin = max(0, end - piece)
            file.seek(begin)
            data = file.read(end - begin) + data
            if (cut := data.rfind(b"\n")) >= 0:
                return begin + cut + 1, data[cut + 1 :]
            end = begin
        return 0, data


def _repair(system: arrow_fs.FileSystem, info: arrow_fs.FileInfo) -> None:
    """A cut last record goes and a whole one gets its line end; what isn't a record refuses. Only a file with such an end is written anew."""
    begin, line = _tail(system, info)
    if not line:
        return
    kind, *_ = kind_of(line.removeprefix(BOM), True)
    if kind == "foreign":
        raise ValueError(f"{info.path}, byte {begin}: no record, so nothing is appended")
    keep, more = (info.size, b"\n") if kind in ("record", "error") else (begin, b"")
    folder, _, name = info.path.rpartition("/")
    aside = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with system.open_input_file(info.path) as old, system.open_output_stream(aside) as new:
        while keep > 0:
            data = old.read(min(keep, 1 << 20))
            new.write(data)
            keep -= len(data)
        new.write(more)
    system.move(aside, info.path)


class Records(DataSource):
    """Options: path; range (bytes a task reads); foreign (refuse, keep). Frames to write have a column ``line``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        if "line" not in schema.names:
            raise ValueError("frames to write need a column line")
        return RecordWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``records`` known to a session."""
    spark.dataSource.register(Records)


