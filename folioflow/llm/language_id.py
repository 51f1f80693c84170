"""Operator 6, language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points, everything but letters is a space; n-grams of one to three fall into 2**16
buckets. Training counts n-grams of all labelled rows inside the tasks; each task hands on one count array per language,
and these are summed in two steps. The log-probability matrix takes 256 KB for each learned language, so its size follows the
number of different labels and not of documents; it is collected and broadcast in blocks of at most ``LABELS`` languages,
and with more than one block texts pass all of them one after the other, with the best so far beside them. Scoring makes a
sparse matrix (text, bucket, count) of a batch's texts and multiplies it with the block's columns.

A null text, or one without a letter, is ``und`` with score 0; so is everything if no row is labelled. The score is the
posterior with the likelihood weakened to that of at most 200 n-grams, so that it stays informative on long texts.
Labels tie towards the lesser name. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import discard, small_batches, stored

BITS = 16
ORDERS = (1, 2, 3)
EVIDENCE = 200
LABELS = 256
CHARS = 200_000
CELLS = 4_000_000
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_buckets(text: str) -> np.ndarray | None:
    """Buckets of all n-grams of a text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[points]
    if not known.any():
        return None
    c = np.empty(len(points) + 2, np.uint32)
    c[0] = c[-1] = 32
    c[1:-1] = np.where(known, points, 32)
    parts = []
    for n in ORDERS:
        h = np.full(len(c) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        parts.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(parts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            found = gram_buckets(text)
            if found is not None:
                if lang not in sums:
                    sums[lang], docs[lang] = np.zeros(1 << BITS, np.int64), 0
                np.add.at(sums[lang], found, 1)
                docs[lang] += 1
        if len(sums) > 64:
            yield _packed(sums, docs)
            sums, docs = {}, {}
    if sums:
        yield _packed(sums, docs)


def _packed(sums: dict, docs: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "docs", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, n, raw in zip(batch["lang"].to_pylist(), batch["docs"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(raw, "<i8")
            docs[lang] = docs.get(lang, 0) + n
    if sums:
        yield _packed(sums, docs)


def _log_shares(smoothing: float):
    """The summed counts of a language as logarithms of smoothed shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _summed(batches):
            rows = [np.frombuffer(raw, "<i8") + smoothing for raw in batch["counts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["docs"], pa.array([np.log(x / x.sum()).astype("<f4").tobytes() for x in rows], pa.binary())], names=["lang", "docs", "counts"])

    return run


class Block:
    """Log-probabilities (buckets x languages) and log priors of some languages."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.logs, self.prior = langs, logs, prior


def train(labelled: DataFrame, smoothing: float = 0.5, labels: int = LABELS) -> list[Broadcast]:
    """Broadcast blocks of languages in order of their names, from all rows with text and lang."""
    kind = "lang string, docs long, counts binary"
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = rows.mapInArrow(_counts, kind)
    part = counted.repartition(32, "lang", F.pmod(F.xxhash64("counts"), F.lit(8))).mapInArrow(_summed, kind)
    whole = stored(part.repartition(8, "lang").mapInArrow(_log_shares(smoothing), kind), "languages")
    docs = {r["lang"]: r["docs"] for r in whole.select("lang", "docs").collect()}  # a row per language
    names, total, blocks = sorted(docs), sum(docs.values()), []
    for k in range(0, len(names), labels):
        mine = names[k : k + labels]
        found = {r["lang"]: np.frombuffer(r["counts"], "<f4") for r in whole.where(F.col("lang").between(mine[0], mine[-1])).collect()}
        logs = np.array([found[n] for n in mine], np.float32).T.copy()
        blocks.append(spark.sparkContext.broadcast(Block(mine, logs, np.log(np.array([docs[n] for n in mine]) / total))))
    discard(whole)
    return blocks


def sparse_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a letter and their numbers of n-grams; then each one's different buckets one after the other as (begin, bucket, count)."""
    grams = [(i, found) for i, text in enumerate(texts) if text and (found := gram_buckets(text)) is not None]
    if not grams:
        return (np.zeros(0, np.int64),) * 4
    sizes = np.array([len(g) for _, g in grams])
    keys, counts = np.unique(np.repeat(np.arange(len(grams), dtype=np.uint64), sizes) << np.uint64(BITS) | np.concatenate([g for _, g in grams]), return_counts=True)
    begins = np.searchsorted(keys >> np.uint64(BITS), np.arange(len(grams), dtype=np.uint64))
    return np.array([i for i, _ in grams]), sizes, begins, np.stack([(keys & np.uint64((1 << BITS) - 1)).astype(np.int64), counts])


def totals(begins: np.ndarray, cells: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Summed log-probabilities (texts x languages): the sparse matrix times the columns of a block, a few at a time."""
    step = max(1, CELLS // cells.shape[1])
    parts = [np.add.reduceat(logs[cells[0], k : k + step] * cells[1][:, None].astype(np.float64), begins, axis=0) for k in range(0, logs.shape[1], step)]
    return np.concatenate(parts, axis=1)


#: What is known of a text after some blocks: the best language, its log posterior, that with weakened likelihood, and the log of the weakened sum.
Known = tuple[str, float, float, float]
NOTHING: Known = (UNKNOWN, -np.inf, -np.inf, -np.inf)


def seen_block(texts: list[str | None], block: Block, before: list[Known]) -> list[Known]:
    """The state of each text of a batch after one more block; of equal languages the earlier stays."""
    after = list(before)
    for part in _parts(texts):
        at, sizes, begins, cells = sparse_counts(texts[part])
        if not len(at) or not block.langs:
            continue
        sums = totals(begins, cells, block.logs)
        strong, weak = sums + block.prior, sums * np.minimum(1.0, EVIDENCE / sizes)[:, None] + block.prior
        best = strong.argmax(1)
        top = weak.max(1)
        lump = top + np.log(np.exp(weak - top[:, None]).sum(1))
        for row, i in enumerate((at + part.start).tolist()):
            name, held, weakened, total = after[i]
            total = float(np.logaddexp(total, lump[row]))
            if strong[row, best[row]] > held:
                name, held, weakened = block.langs[best[row]], float(strong[row, best[row]]), float(weak[row, best[row]])
            after[i] = name, held, weakened, total
    return after


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Slices of a batch of about ``CHARS`` characters."""
    begin = chars = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if chars and chars + n > CHARS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += n
    yield slice(begin, len(texts))


def _score(known: Known) -> float:
    return float(np.exp(known[2] - known[3])) if known[1] > -np.inf else 0.0


def classify(texts: list[str | None], model: list[Block]) -> tuple[list[str], list[float]]:
    """Language and score of each text of a batch."""
    known = [NOTHING] * len(texts)
    for block in model:
        known = seen_block(texts, block, known)
    return [k[0] for k in known], [_score(k) for k in known]


_STATE = ("lang_pred", "held", "weakened", "total")


def _pass(block: Broadcast, first: bool, dropped: tuple[str, ...] = ()):
    """Adds a block's findings to the state columns at the end of a batch; ``dropped`` columns end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            known = [NOTHING] * len(texts) if first else list(zip(*(batch[c].to_pylist() for c in _STATE), strict=True))
            known = seen_block(texts, block.value, known)
            names = [n for n in batch.schema.names if n not in _STATE + dropped]
            state = [pa.array([k[0] for k in known], pa.string()), *(pa.array([k[j] for k in known], pa.float64()) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *state], names=[*names, *_STATE])

    return run


def _known(rows: DataFrame, model: list[Broadcast], *dropped: str) -> DataFrame:
    """Rows (text among their columns) with lang_pred and score, without the dropped columns."""
    if not model:
        return rows.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")).drop(*dropped)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    for k, block in enumerate(model):
        gone = dropped if k == len(model) - 1 else ()
        kind = ", ".join([*(f"`{n}` {t}" for n, t in kinds.items() if n not in gone), "lang_pred string, held double, weakened double, total double"])
        rows = rows.mapInArrow(_pass(block, not k, gone), kind)
    score = F.when(F.col("held") > float("-inf"), F.exp(F.col("weakened") - F.col("total"))).otherwise(0.0)
    return rows.withColumn("score", score).drop("held", "weakened", "total")


def accepted(docs: DataFrame, model: list[Broadcast], least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of ``least`` or more."""
    if len(model) > 1:
        named = {c: f"own {c}" for c in docs.columns if c != "text"}
        found = _known(docs.withColumnsRenamed(named), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
        return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in named.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = classify(batch["text"].to_pylist(), [b.value for b in model])
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: list[Broadcast], *carried: str) -> DataFrame:
    """The carried columns with lang_pred and score of each row's whole text."""
    return _known(docs.select(*carried, F.col("text").cast("string").alias("text")), model, "text")


def held_out(doc_id: Column, of: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that aren't held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, "doc_id", "held_out")
