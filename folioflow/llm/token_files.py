"""Operator 3, token-ID output in a bit-plane shuffled binary format.

Texts are encoded with a public tokenizer, an end id closes each document. Documents are dealt by ranges of doc_id and
sorted; each partition writes chunks of whole documents in that order, a file's chunks being its rows. A chunk's ids are
cut into blocks of 16,384; each block is transposed into its four byte planes and each plane is compressed with
zstandard (a plane of zeros takes no bytes). The chunk index (file, chunk, first id in the file, doc_ids, lengths) lies
in columns of its own, so it's read without the payload. The files are written and read by Spark, in any store.

Where a tokenizer splits at white space, a text's ids are those of its words in a row: words are dictionary-encoded in
Arrow, each worker process keeps the ids of about 600,000 words it has met and encodes only new ones. Any other tokenizer
gets whole texts. Only one row per file meets in one task (file totals). A null text is empty: it holds the end id alone.
Equal doc_ids are ordered by text. Null doc_ids come first. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches, stored

MAGIC = b"TKPL"
BLOCK = 16_384
CHUNK = 131_072
END_ID = 2
CHUNKS = "file int, chunk int, first_id long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Header (magic, block length, ids), plane lengths, planes."""
    press = zstandard.ZstdCompressor(level=3)
    sizes, planes = [], []
    for k in range(0, len(ids), BLOCK):
        for plane in np.ascontiguousarray(ids[k : k + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T):
            data = press.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(data))
            planes.append(data)
    return MAGIC + struct.pack("<IQ", BLOCK, len(ids)) + np.array(sizes, "<u4").tobytes() + b"".join(planes)


def unpack(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a token chunk")
    block, n = struct.unpack_from("<IQ", data, 4)
    blocks = -(-n // block)
    sizes = np.frombuffer(data, "<u4", 4 * blocks, 16)
    ends = np.cumsum(np.r_[16 + 16 * blocks, sizes])
    out, press = np.zeros((n, 4), np.uint8), zstandard.ZstdDecompressor()
    for b in range(blocks):
        rows = out[b * block : (b + 1) * block]
        for p in range(4):
            at = 4 * b + p
            if sizes[at]:
                rows[:, p] = np.frombuffer(press.decompress(data[ends[at] : ends[at + 1]]), np.uint8)
    return out.view("<u4").ravel()


def _byte_marks() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_MARKS = _byte_marks()


SLICE = 4 << 20
#: A punctuation mark right after a Latin letter or a digit starts a token of its own; a space there changes no id.
AFTER_WORDS = "([a-z0-9\u00e0-\u00f6\u00f8-\u00ff])([.,!?;:])"


class WordIds:
    """Ids of whole texts by their words; the ids of words met before are kept by the worker process, and bounded.

    Texts are lower-cased (ASCII letters), split at white space and marks after words, and dictionary-encoded in Arrow; only words that are new
    to the process go through the tokenizer. That holds for tokenizers that lower-case, drop white space and never merge
    over it; ``by_words`` tries that on a text, and a tokenizer that fails is given whole texts instead.
    """

    _kept: dict[str, WordIds] = {}

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.at: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.end, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0, np.zeros(0, np.int32)
        self.by_words = self._by_words()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def forget(self, least: int = 3) -> None:
        """Keeps the words met in ``least`` slices or more, if they are less than half of what there is room for."""
        kept = np.flatnonzero(self.seen[: len(self.at)] >= least)
        if 2 * len(kept) >= self.most:
            kept = kept[:0]
        words, sizes = list(self.at), self.sizes[kept]
        self.at = {words[k]: i for i, k in enumerate(kept.tolist())}
        ids = np.concatenate([self.flat[a : a + n] for a, n in zip(self.starts[kept], sizes, strict=True)]) if len(kept) else self.flat[:0]
        self.starts, self.sizes, self.flat, self.end = np.cumsum(sizes) - sizes, sizes, ids, len(ids)
        self.seen = np.ones(len(kept), np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.batch(texts, add_special_tokens=False)]

    def _by_words(self) -> bool:
        """Whether this tokenizer gives a text the ids of its words, in lower case or not, with each way of splitting them."""
        text = "The Quick\tbr\u00f6wn fox, jumped.  over 12 (lazy) dogs\r\n\u00c9t\u00e9 na\u00efve. \u6771\u4eac it's x.y"
        try:
            values = [v for ids in self.ids(pa.array([text])) for v in ids.tolist()]
        except (AttributeError, TypeError, KeyError):
            return False
        return values == self.whole([text])[0]

    @staticmethod
    def marks(word: str) -> str | None:
        """What the tokenizer's normalizer and splitter make of a word, where that is plain: lower-case Latin letters."""
        if word.isalpha() and word.islower():
            if word.isascii():
                return word
            if max(word) < "\u0250" and word.lower() == word and unicodedata.is_normalized("NFC", word):
                return word.encode().decode("latin-1").translate(BYTE_MARKS)
        return None

    def learn(self, words: list[str]) -> None:
        """Ids of words that aren't known."""
        known, tokenize, marks = len(self.at), self.tokenizer.model.tokenize, self.marks
        marked = [(w, m) for w in words if (m := marks(w))]
        self.at.update(zip((w for w, _ in marked), range(known, known + len(marked)), strict=True))
        plain = [w for w in words if w not in self.at]
        self.at.update(zip(plain, range(len(self.at), len(self.at) + len(plain)), strict=True))
        lists = [[t.id for t in tokenize(m)] for _, m in marked] + self.whole(plain)
        self._append(known, [len(x) for x in lists], [i for x in lists for i in x])

    def _append(self, known: int, sizes: list[int], ids: list[int]) -> None:
        def room(a: np.ndarray, n: int) -> np.ndarray:
            return a if n <= len(a) else np.r_[a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)]

        n = len(sizes)
        self.starts, self.sizes, self.flat, self.seen = room(self.starts, known + n), room(self.sizes, known + n), room(self.flat, self.end + len(ids)), room(self.seen, known + n)
        self.sizes[known : known + n] = sizes
        self.starts[known : known + n] = self.end + np.cumsum([0, *sizes[:-1]]) if n else 0
        self.flat[self.end : self.end + len(ids)] = ids
        self.end += len(ids)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = pc.fill_null(texts, "")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), AFTER_WORDS, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, parted))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.at) > self.most:
            self.forget()
        if new := [w for w in words if w not in self.at]:
            self.learn(new)
        named = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.seen[named] += 1
        word = named[coded.indices.to_numpy()]
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[word] - (ends - sizes), sizes)] if len(ends) else np.zeros(0, np.uint32)
        cuts = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column in slices of about SLICE bytes, so that what is made of one stays small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _chunks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, file = WordIds.of(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        chunk = first = 0
        docs, parts, lengths, total = [], [], [], 0

        def row():
            ids = np.concatenate(parts).astype("<u4", copy=False)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(ids)], pa.binary())], names=["file", "chunk", "first_id", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            keys = iter(batch["doc_id"].to_pylist())
            for texts in _slices(batch["text"]):
                coded = memo.ids(texts) if memo.by_words else [np.array(ids, "<u4") for ids in memo.whole([t or "" for t in texts.to_pylist()])]
                for ids in coded:
                    docs.append(next(keys))
                    parts += [ids, end]
                    lengths.append(len(ids) + 1)
                    total += len(ids) + 1
                    if total >= CHUNK:
                        yield row()
                        chunk, first, docs, parts, lengths, total = chunk + 1, first + total, [], [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files to the shared folder; returns the table of their chunks as read back."""
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(_chunks(tokenizer, end_id), CHUNKS), "tokens")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], []]
        for file, first, docs, lengths, payload in zip(*(batch[c].to_pylist() for c in ("file", "first_id", "doc_ids", "lengths", "payload")), strict=True):
            ids, at = unpack(payload), 0
            for doc, n in zip(docs, lengths, strict=True):
                for column, value in zip(out, (file, doc, first + at, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                    column.append(value)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files' payload and index."""
    files = chunks.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    starts = files.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = chunks.select("file", "first_id", "doc_ids", "lengths", "payload").mapInArrow(_documents, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
