"""Operator 12, fill-in-middle transformation: texts cut at line borders and put out as prefix, suffix and middle.

The ends of all lines of an Arrow batch of texts are the ones of a packed bit vector over the batch's UTF-8 bytes. A
directory holds the popcount before each block of 512 bits: the difference of two ranks is a text's number of lines, and
select on a text's first rank plus a cut gives the byte where the cut falls. A second vector, of the bytes that begin a code
point, turns bytes into code points. No text is decoded, no line becomes an object; memory is that of one batch.

A cut is drawn per row from the digest of ``seed:doc_id``, so reruns agree and equal doc_ids get equal draws. A null text is
empty and a null doc_id has no digits (``seed:``). A text that is empty or holds a mark stays plain, as does a share of the
rest if ``percent`` is below 100. Repeated rows each come out, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
WORDS_PER_BLOCK = 8


class BitVector:
    """Rank and select over packed bits, both for arrays of arguments."""

    def __init__(self, flags: np.ndarray):
        block = 64 * WORDS_PER_BLOCK
        packed = np.packbits(flags, bitorder="little")
        room = np.zeros((len(flags) // block + 1) * block // 8, np.uint8)  # a block more than full, so that rank(len) has a word
        room[: len(packed)] = packed
        self.words = room.view("<u8").reshape(-1, WORDS_PER_BLOCK)
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        block, word = at >> 9, at >> 6 & 7
        whole = np.where(np.arange(WORDS_PER_BLOCK) < word[:, None], np.bitwise_count(self.words[block]), 0).sum(1)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.directory[block] + whole + np.bitwise_count(self.words[block, word] & below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The position of the one that has ``rank`` ones before it."""
        block = np.searchsorted(self.directory, rank, "right") - 1
        rest = rank - self.directory[block]
        upto = np.bitwise_count(self.words[block]).cumsum(1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(1)
        rest = rest - np.where(word, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block << 9) + (word << 6) + (bits.cumsum(1) <= rest[:, None]).sum(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, one after the other, and where each begins (and the last ends)."""
    column = column.fill_null("").cast(pa.large_string())
    _, begins, data = column.buffers()
    at = np.frombuffer(begins, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


def line_cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines of each text, the bytes where its prefix and its middle end, and code points of prefix and middle.

    ``draws`` has two unsigned numbers a text; each modulo (lines + 1) is a number of lines.
    """
    ends = data == 10
    ends[at[1:][at[1:] > at[:-1]] - 1] = True
    lines = BitVector(ends)
    before = lines.rank(at)
    n = np.diff(before)
    counts = np.sort(draws % (n + 1)[:, None], axis=1)
    cuts = []
    for k in (0, 1):
        some = counts[:, k] > 0
        cut = at[:-1].copy()
        cut[some] = lines.select(before[:-1][some] + counts[some, k] - 1) + 1
        cuts.append(cut)
    points = BitVector((data & 0xC0) != 0x80)
    first, second, third = points.rank(at[:-1]), points.rank(cuts[0]), points.rank(cuts[1])
    return n, cuts[0], cuts[1], second - first, third - second


def _batch(batch: pa.RecordBatch, seed: str, percent: int, spm_percent: int) -> pa.RecordBatch:
    data, at = text_bytes(batch["text"])
    digests = [hashlib.sha256(f"{seed}:{key or ''}".encode()).digest() for key in batch["key"].to_pylist()]
    draws = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).astype(np.int64)
    n, first, second, prefix_chars, middle_chars = line_cuts(data, at, draws[:, :2])
    forms, outputs = [], []
    raw = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for i, (begin, cut, other, end) in enumerate(zip(at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), strict=True)):
        text = raw[begin:end]
        if not text or any(m in text for m in marks) or draws[i, 2] % 100 >= percent:
            forms.append(PLAIN)
            outputs.append(text)
            continue
        head, middle, tail = raw[begin:cut], raw[cut:other], raw[other:end]
        if draws[i, 3] % 100 < spm_percent:
            forms.append(SPM)
            outputs.append(b"".join((marks[1], tail, marks[0], head, marks[2], middle)))
        else:
            forms.append(PSM)
            outputs.append(b"".join((marks[0], head, marks[1], tail, marks[2], middle)))
    plain = np.array([f == PLAIN for f in forms], bool)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).view(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transformed(docs: DataFrame, seed: str = "7", percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: ``percent`` of the texts are cut, ``spm_percent`` of those put the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(batch, seed, percent, spm_percent)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output; a cut text holds no mark, so the marks are the only borders."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def digests(out: DataFrame) -> DataFrame:
    """The columns of ``transformed`` with digests of the output and of the text rebuilt from it, in place of the output."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
