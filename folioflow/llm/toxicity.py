"""Operator 4, toxicity: a counterfactual-regularised classifier.

Logistic regression over the words of a text and their first four and five letters (presence, hashed into 2**18
weights). For each labelled text that names a group, a counterfactual copy has its identity terms swapped for others of
the same kind; the loss adds ``pull`` times the squared change of the logit, so that naming a group moves no score.

It is fitted on the driver from hashed features of a bounded sample: at most about ``most`` labelled texts of either
class, picked by a hash of doc_id (all of them if there are fewer); the intercept is set back to the classes' true
shares. The weights (1 MB) are broadcast and every whole text is scored in the tasks.

Null or empty texts score by the intercept alone; without labels of both classes, or with no label at all, every score is
the share of toxic labels (0 if none). Several labels of a doc_id count as toxic if one is, and one text of a doc_id is learned from,
so ``most`` bounds what reaches the driver; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.language_id import held_out
from folioflow.sources.workspace import small_batches

BITS = 18
MOST = 6000
#: Identity terms by kind; a counterfactual puts the next term of the kind in place of each.
IDENTITY = (
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "black white asian latino arab african european indigenous",
    "women men girls boys",
    "woman man girl boy",
    "gay straight lesbian bisexual transgender queer",
    "american mexican chinese indian russian german french spanish turkish polish",
    "immigrants refugees citizens foreigners",
    "frauen männer mädchen jungen",
    "muslime christen juden",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos",
    "old young disabled blind deaf",
)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain_bytes(text: str | None) -> bytes:
    """Lower-case UTF-8 with a space for each ASCII character that is no letter or digit."""
    return text.lower().encode().translate(_PUNCTUATION) if text else b""


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return plain_bytes(text).split()


def swaps(identity=IDENTITY) -> dict[bytes, bytes]:
    out = {}
    for kind in identity:
        terms = [t.encode() for t in kind.split()]
        out |= dict(zip(terms, terms[1:] + terms[:1], strict=True))
    return out


class Features(dict):
    """Word to its feature numbers; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        mask, letters = (1 << BITS) - 1, word.decode(errors="replace")
        out = [xxhash.xxh3_64_intdigest(word) & mask]
        out += [xxhash.xxh3_64_intdigest(f"{n}:{letters[:n]}") & mask for n in (4, 5) if len(letters) > n]
        value = self[word] = tuple(out)
        return value


def features_of(words, memo: Features) -> list[int]:
    return list({f for w in set(words) for f in memo[w]})


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, swap = Features(), swaps()
    for batch in batches:
        own, other = [], []
        for text in batch["text"].to_pylist():
            words = plain_words(text)
            own.append(features_of(words, memo))
            other.append(features_of([swap.get(w, w) for w in words], memo) if any(w in swap for w in words) else [])
        packed = ([np.array(x, "<i4").tobytes() for x in side] for side in (own, other))
        yield pa.RecordBatch.from_arrays([batch["toxic"], *(pa.array(x, pa.binary()) for x in packed)], names=["toxic", "own", "other"])


def _matrix(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of each entry."""
    return np.repeat(np.arange(len(packed), dtype=np.int32), [len(x) // 4 for x in packed]), np.frombuffer(b"".join(packed), "<i4")


def telling(y: np.ndarray, row: np.ndarray, col: np.ndarray, chi: float = 25.0, least: int = 100) -> np.ndarray:
    """Features whose presence depends on the class: chi-squared of ``chi`` or more, or among the ``least`` best.

    Features that only tell by chance would add up over a long text.
    """
    n, t = len(y), float(y.sum())
    seen = np.bincount(col, minlength=1 << BITS).astype(float)
    hits = np.bincount(col, y[row], 1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.nan_to_num(n * (hits * n - seen * t) ** 2 / (seen * (n - seen) * t * (n - t)), posinf=0.0)
    value[seen < 3] = 0
    return (value > 0) & (value >= min(chi, np.partition(value, -least)[-least]))


def slope(w: np.ndarray, b: float, y: np.ndarray, cells: tuple, pairs: int, own: tuple, other: tuple, pull: float) -> tuple[np.ndarray, float]:
    """The gradient, by weights and intercept, of the mean log loss plus ``pull`` times the mean squared change of counterfactual logits."""
    row, col = cells
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -30, 30)))
    d = (p - y) / len(y)
    g = np.bincount(col, d[row], len(w))
    if pairs:
        change = np.bincount(own[0], w[own[1]], pairs) - np.bincount(other[0], w[other[1]], pairs)
        c = 2 * pull * change / pairs
        g += np.bincount(own[1], c[own[0]], len(w)) - np.bincount(other[1], c[other[0]], len(w))
    return g, float(d.sum())


def fit(rows: list, share: float, pull: float = 1.0, ridge: float = 2e-4, steps: int = 60, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept from (toxic, own, other) rows by full-batch Adam; share is the true part of toxic labels."""
    y = np.array([r["toxic"] for r in rows], np.float32)
    row, col = _matrix([r["own"] for r in rows])
    pairs = [r for r in rows if len(r["other"])]
    a_row, a_col = _matrix([r["own"] for r in pairs])
    b_row, b_col = _matrix([r["other"] for r in pairs])
    common = telling(y, row, col)
    w, b, m, v, mb, vb = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = slope(w, b, y, (row, col), len(pairs), (a_row, a_col), (b_row, b_col), pull)
        g = (g + ridge * w) * common
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + t / 20)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    seen = float(y.mean())
    return w.astype(np.float32), b + float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Fits on at most about ``most`` labelled texts of either class; all columns but text and toxic stay unused."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    zero = np.zeros(1 << BITS, np.float32)
    if not 0 < share < 1:
        return zero, float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(draw < F.when(F.col("toxic") == 1, most / sizes[1]).otherwise(most / sizes[0]))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("one")).select("one.text", "toxic")
    rows = one.mapInArrow(_labelled, "toxic int, own binary, other binary").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return zero, float(np.log(share / (1 - share)))
    return fit(rows, share, pull)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (w, b) = Features(), model.value
        for batch in batches:
            logits = np.array([w[features_of(plain_words(t), memo)].sum(dtype=np.float64) if t else 0.0 for t in batch["text"].to_pylist()], np.float64) + b
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = MOST, pull: float = 1.0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out documents aren't read."""
    small_batches(docs.sparkSession)
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), most, pull)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double, predicted int")
