"""Operator 8, media columns: signature sniffing and carving.

An Aho-Corasick automaton over magic bytes runs once over each binary value. A hit counts only if the validator of its
format can follow the structure and gives a length inside the value. The hit at offset 0 corrects the declared type;
hits inside become embedded spans, which ``carve`` cuts out. All work is by row, inside the tasks.

``as_wave`` stores any bytes losslessly as 8-bit mono samples; the stored column is written and read by Spark.
A null value has type null and no spans; an empty one, or one with no known structure, is application/octet-stream.
Null texts are empty. Extra columns are ignored, repeated rows each count.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import shared_dir, small_batches

UNIT = 64
STEP = 1 << 16
RATE = 8000
UNKNOWN = "application/octet-stream"


def as_wave(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wave_payload(data: bytes) -> bytes:
    """The samples of a validated wave."""
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


# Each validator takes a value and an offset and gives the length of the structure there, or 0.


def _riff(d: bytes, at: int) -> int:
    if len(d) < at + 12 or d[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    end, place, chunks = at + size, at + 12, 0
    while place + 8 <= min(end, len(d)):
        length = struct.unpack_from("<I", d, place + 4)[0]
        place += 8 + length + length % 2
        chunks += 1
    return size if chunks and end <= len(d) and place >= end else 0


def _png(d: bytes, at: int) -> int:
    place = at + 8
    while place + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, place)
        end = place + 12 + size
        if end > len(d) or struct.unpack_from(">I", d, end - 4)[0] != zlib.crc32(d[place + 4 : end - 4]):
            return 0
        if kind == b"IEND":
            return end - at
        place = end
    return 0


def _gif(d: bytes, at: int) -> int:
    if len(d) < at + 13:
        return 0
    place = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 128 else 0)
    while place < len(d):
        mark = d[place]
        if mark == 0x3B:
            return place + 1 - at
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 < len(d):
            place += 11 + (3 << (d[place + 9] & 7) + 1 if d[place + 9] & 128 else 0)
        else:
            return 0
        while place < len(d) and d[place]:
            place += d[place] + 1
        place += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(d) and d[place] == 0xFF:
        kind, size = d[place + 1], struct.unpack_from(">H", d, place + 2)[0]
        place += 2 + size
        if kind == 0xDA:
            end = d.find(b"\xff\xd9", place)
            return end + 2 - at if end >= 0 else 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    if len(d) < at + 54:
        return 0
    size, _, start, head = struct.unpack_from("<IIII", d, at + 2)
    return size if head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(d) - at else 0


def _pdf(d: bytes, at: int) -> int:
    """To the last end mark before the next header: saved changes append further ones."""
    after = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, after if after >= 0 else len(d))
    return end + 5 - at if end >= 0 and d.find(b"startxref", at, end) >= 0 else 0


def _gzip(d: bytes, at: int) -> int:
    """Inflates the member to its end in bounded steps, whatever its size; what comes out is thrown away."""
    view, place, z = memoryview(d), at, zlib.decompressobj(31)
    try:
        while place < len(d) and not z.eof:
            part = view[place : place + STEP]
            place += len(part)
            z.decompress(part, STEP)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, STEP)
        return place - len(z.unused_data) - at if z.eof else 0
    except zlib.error:
        return 0


def _zip(d: bytes, at: int) -> int:
    end = d.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return 0
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(d) else 0


#: Magic bytes, media type and validator.
SIGNATURES = (
    (b"RIFF", None, _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
)
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniffed(data: bytes, machine) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid structure; one that lies inside a later format's hit is still listed."""
    out = []
    for last, (k, size) in machine.iter(data.decode("latin-1")):
        at = last - size + 1
        _, kind, valid = SIGNATURES[k]
        if length := valid(data, at):
            out.append((at, length, kind or _RIFF_TYPES[data[at + 8 : at + 12]]))
    return sorted(out)


def sniff(media: DataFrame, key: str = "doc_id", value: str = "media", declared: str = "declared") -> DataFrame:
    """key, declared, media_type (corrected), embedded: array of (offset, length, type) below offset 0."""
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            types, spans = [], []
            for data in batch[value].to_pylist():
                found = sniffed(data, machine) if data else []
                types.append(None if data is None else next((t for at, _, t in found if not at), UNKNOWN))
                spans.append([{"offset": a, "length": n, "type": t} for a, n, t in found if a])
            yield pa.RecordBatch.from_arrays([batch[key], batch[declared], pa.array(types, pa.string()), pa.array(spans, pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))], names=[key, declared, "media_type", "embedded"])

    return media.select(key, value, declared).mapInArrow(run, f"{key} {kind}, {declared} string, media_type string, embedded array<struct<offset:bigint,length:bigint,type:string>>")


def carve(media: DataFrame, key: str = "doc_id", value: str = "media", declared: str = "declared") -> DataFrame:
    """A row (key, offset, type, data) for each embedded structure."""
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [(k, at, t, data[at : at + n]) for k, data in zip(batch[key], batch[value].to_pylist(), strict=True) if data for at, n, t in sniffed(data, machine) if at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], batch.schema.field(key).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], names=[key, "offset", "type", "data"])

    return media.select(key, value).mapInArrow(run, f"{key} {kind}, offset long, type string, data binary")


def _stored_waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch["text"].to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            media.append(as_wave(data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array([UNKNOWN] * len(sizes), pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as a wave in a media column, written to the shared folder and read back."""
    import uuid

    spark = docs.sparkSession
    small_batches(spark)
    waves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stored_waves, "doc_id long, n_bytes long, declared string, media binary")
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    waves.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(waves.schema).parquet(path)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = [[] for _ in names]
        for doc, size, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
            found = sniffed(data, machine)
            kind = next((t for at, _, t in found if not at), UNKNOWN)
            payload = wave_payload(data)
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = counts[counts > 0] / len(payload)
            entropy = float(-(share * np.log2(share)).sum())
            inside = ",".join(f"{t}@{a}+{n}" for a, n, t in found if a)
            mean = float((counts * np.arange(256)).sum() / len(payload))
            values = (doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"type={kind};mean={mean:.4f};entropy={entropy:.4f};high={int(counts[128:].sum())};embedded={inside}")
            for column, v in zip(out, values, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row."""
    return store_texts(docs).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
