"""Operator 13, quality rules: counts of each text, and perplexity bands of a modified Kneser-Ney model of its language.

The model has n-grams of ``ORDER`` characters: words of any script and any inflection share them, and no word is unknown.
Tasks count the n-grams of all whole texts and hand on one row per language and n-gram, Spark sums them. Lower orders,
discounts (from the counts of counts of each language and order), context weights and interpolated probabilities are
aggregates and joins of those rows. For scoring, hashes and logarithms go into sorted arrays that a directory of their first
bits indexes. They are broadcast only if the counted rows are at most ``most``; a larger model stays a table, and the
n-grams of each different text are joined with it (same scores, more shuffle).

A document's perplexity is taken per letter or digit, so that runs of cheap symbols count fully: its bits are those of all characters,
divided by its letters and digits. The model rejects it outside the band of its language: the median less ``below`` or plus ``above``
times the median distance on that side. Short texts vary more, so the distance grows by sqrt(1 + LENGTH / characters in words).
Medians are exact over all documents that pass the base rules, in steps of 1/512 bit; what meets is one row per language
and step. For the model white space is one space, control characters are white space and digits are 0; a text's start and end count.

A null text has no words; a text without words has no score and fails the base rules. A null lang is a language of its own. Equal
rows each come out; a language whose documents all fail the base rules has no band and rejects nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.language_id import letters
from folioflow.llm.words import WordHashes, mixed
from folioflow.sources.workspace import discard, small_batches, stored

ORDER = 5
WINDOW = 5
MOST = 4_000_000
LANGUAGES = 100_000
STEPS = 512
LENGTH = 300
LEAST_SPREAD = 4
ABOVE, BELOW = 7.0, 20.0
LEAST_DISCOUNT = 0.1
#: The marks of a text's start and end, the symbols that are counted, white space of the word pattern.
START, END = "\x02", "\x03"
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

_GOLD = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_GOLD, k + 1, 1 << 64)) for k in range(ORDER)]
_FLUSH = 1_000_000
_MERGE = 200_000
CHUNK = 300_000


class Points:
    """The code points of a batch of texts as the model sees them, and sums over the texts as they are."""

    def __init__(self, texts: list[str]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        begins = np.cumsum(lens) - lens
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        symbol = np.zeros(128, bool)
        symbol[[ord(c) for c in SYMBOLS]] = True
        self.word_chars = lens - _summed(space, begins, lens)
        self.n_symbols = _summed(symbol[np.minimum(raw, 127)] & (raw < 127), begins, lens)
        doc = np.repeat(np.arange(len(texts)), lens)
        points = np.full(len(raw) + ORDER * len(texts), ord(START), np.uint32)
        points[np.arange(len(raw)) + (ORDER - 1) + ORDER * doc] = np.where((raw >= 48) & (raw <= 57), 48, np.maximum(raw, 32))
        points[np.cumsum(lens + ORDER) - 1] = ord(END)
        drop = (points == 32) & np.isin(np.concatenate([[32], points[:-1]]), (32, ord(START)))
        self.points = points[~drop]
        self.doc = np.repeat(np.arange(len(texts)), lens + ORDER)[~drop]
        self.at = np.flatnonzero(self.points != ord(START))  # what is predicted
        self.n_letters = np.bincount(self.doc[letters()[self.points] | (self.points == 48)], minlength=len(texts))


def _summed(flags: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[begins + lens] - upto[begins]


@functools.lru_cache(4096)
def _language(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _language_seeds(langs: list[str]) -> np.ndarray:
    return np.fromiter(map(_language, langs), np.uint64, len(langs))


def gram_hashes(seeds: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams of one length; ``windows`` has their code points, the last first."""
    h = seeds + np.uint64(len(windows))
    for point, power in zip(windows, _POWERS, strict=False):
        h = h + point.astype(np.uint64) * power
    return mixed(h)


def all_hashes(seeds: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of the highest order at places that have enough before them, added up over the whole array."""
    wide = points.astype(np.uint64)
    h = wide * _POWERS[0]
    for k in range(1, ORDER):
        h[k:] += wide[:-k] * _POWERS[k]
    return mixed(h[at] + seeds + np.uint64(ORDER))


def gram_counts(langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of a batch: the place of their language in the sorted languages, their code points, their counts."""
    p = Points(texts)
    names, lang = np.unique(np.array(langs, object), return_inverse=True)
    used = np.flatnonzero(np.bincount(p.points))
    small = np.zeros(used[-1] + 1, np.uint64)
    small[used] = np.arange(len(used))
    width = max(1, int(len(used) - 1).bit_length())
    of = lang[p.doc[p.at]]
    if width * ORDER + len(names).bit_length() <= 64:
        code = small[p.points]
        key = code.copy()
        for k in range(1, ORDER):
            key[k:] |= code[:-k] << np.uint64(width * k)
        key = key[p.at] | of.astype(np.uint64) << np.uint64(width * ORDER)
        found, counts = np.unique(key, return_counts=True)
        mask = np.uint64((1 << width) - 1)
        windows = np.stack([used[found >> np.uint64(width * k) & mask] for k in range(ORDER - 1, -1, -1)], 1).astype(np.uint32)
        return (found >> np.uint64(width * ORDER)).astype(np.int64), windows, counts
    rows = np.stack([of, *(p.points[p.at - k] for k in range(ORDER - 1, -1, -1))], 1)
    found, counts = np.unique(rows, axis=0, return_counts=True)
    return found[:, 0], found[:, 1:].astype(np.uint32), counts


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of a batch that hold about ``CHUNK`` characters each, so that arrays stay small; a longer text is one by itself."""
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > CHUNK:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


class _Counts:
    """Counts of a task; those of new chunks wait until there are enough to merge."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.langs, self.windows, self.counts = np.zeros(0, object), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, langs: list[str], texts: list[str]) -> None:
        names = np.unique(np.array(langs, object))
        lang, windows, counts = gram_counts(langs, texts)
        keys = gram_hashes(_language_seeds(names.tolist())[lang], [windows[:, ORDER - 1 - k] for k in range(ORDER)])
        self.waiting.append((keys, names[lang], windows, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(_MERGE, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.langs, self.windows, self.counts), *self.waiting]
        keys, langs, windows, counts = (np.concatenate([p[k] for p in parts]) for k in range(4))
        self.waiting, self.n_waiting = [], 0
        self.keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(inverse, counts, len(self.keys)).astype(np.int64)
        self.langs, self.windows = langs[first], windows[first]

    def packed(self) -> pa.RecordBatch:
        text = self.windows.tobytes().decode("utf-32-le", "surrogatepass")
        grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
        return pa.RecordBatch.from_arrays([pa.array(self.langs.tolist(), pa.string()), pa.array(grams, pa.string()), pa.array(self.counts, pa.int64())], names=["lang", "gram", "c"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counts()
    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
        for part in _chunks(texts):
            held.add(langs[part], texts[part])
        if len(held.keys) > _FLUSH:
            held.merge()
            yield held.packed()
            held = _Counts()
    held.merge()
    if len(held.keys):
        yield held.packed()


def with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) without nulls in lang and text."""
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): the n-grams of the highest order of all texts with a word."""
    small_batches(docs.sparkSession)
    rows = with_words(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("lang", "text")
    return rows.mapInArrow(_count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts; where those are missing, half of the count discounted."""
    n = lambda k: F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}")
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    rate = lambda k: F.when(F.col(f"n{k}") > 0, F.greatest(F.lit(LEAST_DISCOUNT), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))
    return grams.groupBy("lang").agg(*(n(k) for k in (1, 2, 3, 4))).select("lang", *(F.coalesce(F.when(F.col("n1") > 0, rate(k)), F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)))


def fitted(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, gram, log_p, log_back) of all orders from 0, and the stored frames it was made of.

    log_p is null for a bare context, log_back where nothing follows. The row of the empty n-gram has the probability of an
    unknown character and the weight that leads to it.
    """
    levels = {order: stored(grams, "quality-counts")}
    for k in range(order - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "quality-counts")
    scraps = list(levels.values())
    few = levels[1].select("lang").distinct().count() <= LANGUAGES
    beside = F.broadcast if few else lambda df: df
    below = levels[1].groupBy("lang", F.lit("").alias("gram")).agg((1.0 / (F.count("*") + 1)).alias("p"))
    parts = [below.select("lang", "gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back"))]
    for k in range(1, order + 1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = levels[k].join(beside(discounts(levels[k])), "lang").select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"), (F.col("c") - taken).alias("left"), taken.alias("taken"), "c")
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("taken") / F.sum("c")).alias("back"))
        lower = below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
        joined = rows.join(contexts, ["lang", "context"]).join(lower, ["lang", "rest"])
        below = stored(joined.select("lang", "gram", "context", "back", (F.col("left") / F.col("total") + F.col("back") * F.col("lower")).alias("p")), "quality-order")
        scraps.append(below)
        parts.append(below.select("lang", "gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back")))
        parts.append(below.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("log_p"), F.log("back").alias("log_back")).distinct())
    model = functools.reduce(DataFrame.unionByName, parts).groupBy("lang", "gram").agg(F.max("log_p").alias("log_p"), F.max("log_back").alias("log_back"))
    return stored(model, "quality-model"), scraps


class SortedTable:
    """Values by 64-bit hash: sorted hashes, and where those of each value of their first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.begins = np.searchsorted(self.keys >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begins).max(initial=0))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        out, hit = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.begins[bucket], self.begins[bucket + 1]
        waiting = np.flatnonzero(at < end)
        while len(waiting):
            here = at[waiting]
            same = self.keys[here] == hashes[waiting]
            out[waiting[same]], hit[waiting[same]] = self.values[here[same]], True
            at[waiting] += 1
            waiting = waiting[~same & (at[waiting] < end[waiting])]
        return out, hit


class Model:
    """Logarithms of probabilities and of back-off weights by the hash of language and n-gram."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]]):
        """parts: bytes of hashes and of both logarithms (nan for none); the list is emptied."""
        tables = []
        for n in (1, 2):
            known = [(np.frombuffer(p[0], np.uint64), np.frombuffer(p[n], np.float64)) for p in parts]
            known = [(k[~np.isnan(v)], v[~np.isnan(v)]) for k, v in known]
            tables.append(SortedTable(*(np.concatenate([np.zeros(0, kind), *(x[i] for x in known)]) for i, kind in enumerate((np.uint64, np.float64)))))
        parts.clear()
        self.log_p, self.log_back = tables

    def nats(self, langs: list[str], points: Points) -> np.ndarray:
        """The negative log-probability of each text; nan if the model has nothing of its language."""
        at, doc = points.at, points.doc[points.at]
        seeds = _language_seeds(langs)[doc]
        total, waiting = np.zeros(len(at)), np.arange(len(at))
        for k in range(ORDER, -1, -1):
            here, seed = at[waiting], seeds[waiting]
            found, hit = self.log_p.look(all_hashes(seed, points.points, here) if k == ORDER else gram_hashes(seed, [points.points[here - j] for j in range(k)]))
            total[waiting] += found
            waiting, here, seed = waiting[~hit], here[~hit], seed[~hit]
            if not len(waiting):
                break
            total[waiting] += self.log_back.look(gram_hashes(seed, [points.points[here - 1 - j] for j in range(k - 1)]))[0] if k else np.nan
        return -np.bincount(doc, total, minlength=len(langs))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and both logarithms (nan for null) of a task's model rows, as bytes."""
    for batch in batches:
        grams = batch["gram"].to_pylist()
        seeds = _language_seeds(batch["lang"].to_pylist())
        lens = np.fromiter(map(len, grams), np.int64, len(grams))
        keys = np.zeros(len(grams), np.uint64)
        for k in np.unique(lens):
            mine = np.flatnonzero(lens == k)
            points = np.frombuffer("".join(grams[i] for i in mine).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(mine), k)
            keys[mine] = gram_hashes(seeds[mine], [points[:, k - 1 - j] for j in range(k)])
        values = [batch[c].fill_null(np.nan).to_numpy(zero_copy_only=False).tobytes() for c in ("log_p", "log_back")]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (keys.tobytes(), *values)], names=["keys", "log_p", "log_back"])


def arrays(model: DataFrame) -> Model:
    """The model's rows as arrays on the driver; the caller has counted them."""
    return Model([tuple(r) for r in model.select("lang", "gram", "log_p", "log_back").mapInArrow(_pack, "keys binary, log_p binary, log_back binary").collect()])


def features(text: str, memo: WordHashes) -> tuple[int, int, int]:
    """Words, lines that equal an earlier line, words in windows that occur twice or more."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if len(words) > WINDOW:
        ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(ids) - WINDOW + 1
        h = ids[:n] * _POWERS[0]
        for k in range(1, WINDOW):
            h += ids[k : n + k] * _POWERS[k]
        sorted_h = np.sort(h)
        twice = sorted_h[1:][sorted_h[1:] == sorted_h[:-1]]
        if len(twice):
            again, marked = np.isin(h, twice), np.zeros(len(ids), bool)
            for k in range(WINDOW):
                marked[k : n + k] |= again
            repeated = int(marked.sum())
    return len(words), len(lines) - len(set(lines)), repeated


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters")


def measured(docs: DataFrame, model: Model | None, *carried: str) -> DataFrame:
    """doc_id, lang, the carried columns, the features and the nats of each row of ``with_words``; nats are null without a model or words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            if not texts:
                continue
            n_words, n_dup_lines, n_repeat_words = zip(*(features(t, memo) for t in texts), strict=True)
            parts = []
            for part in _chunks(texts):
                points = Points(texts[part])
                parts.append((points.word_chars, points.n_symbols, points.n_letters, shared.value.nats(langs[part], points) if shared.value else np.full(len(points.n_letters), np.nan)))
            word_chars, n_symbols, n_letters, nats = map(np.concatenate, zip(*parts, strict=True))
            nats = np.where(np.array(n_words) > 0, nats, np.nan)
            counts = [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *counts, pa.array(nats, pa.float64(), mask=np.isnan(nats))], names=[*names, *_FEATURES, "nats"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*names, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), *(f"{c} long" for c in _FEATURES), "nats double"]))


def _grams_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, mark, text in zip(*(batch[c].to_pylist() for c in ("lang", "mark", "text")), strict=True):
            _, windows, counts = gram_counts([lang], [text])
            joined = windows.tobytes().decode("utf-32-le", "surrogatepass")
            grams = [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)]
            n = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([mark] * n, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "mark", "gram", "n"])


def measured_by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """As ``measured``, with a model of any size: the n-grams of each different text are joined with the model's rows, order by order."""
    marked = rows.withColumn("mark", F.sha2(F.encode("text", "utf-8"), 256))
    texts = marked.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    waiting, parts, kept = stored(texts.select("lang", "mark", "text").mapInArrow(_grams_of_texts, "lang string, mark string, gram string, n long"), "quality-waiting"), [], []
    probable = model.where("log_p is not null").select("lang", "gram", "log_p")
    weights = model.where("log_back is not null").select("lang", F.col("gram").alias("context"), "log_back")
    for k in range(ORDER, -1, -1):
        kept.append(waiting)
        seen = waiting.join(probable, ["lang", "gram"], "left")
        parts.append(seen.where("log_p is not null").select("lang", "mark", (F.col("n") * F.col("log_p")).alias("part")))
        missing = seen.where("log_p is null")
        if not k:
            parts.append(missing.select("lang", "mark", F.lit(float("nan")).alias("part")))
            break
        after = missing.withColumn("context", F.substring("gram", 1, k - 1)).join(weights, ["lang", "context"], "left")
        after = stored(after.select("lang", "mark", F.substring("gram", 2, k - 1).alias("gram"), "n", (F.col("n") * F.coalesce("log_back", F.lit(0.0))).alias("part")), "quality-waiting")
        parts.append(after.select("lang", "mark", "part"))
        waiting = after.select("lang", "mark", "gram", "n")
        kept[-1] = after
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy("lang", "mark").agg((-F.sum("part")).alias("nats"))
    return measured(marked, None, "mark").drop("nats").join(sums, ["lang", "mark"], "left").withColumn("nats", F.when(~F.isnan("nats"), F.col("nats"))).drop("mark")


def _median(counts: DataFrame, value: str, name: str) -> DataFrame:
    """(lang, name): the least value that half of the language's documents don't exceed; counts has (lang, value, n)."""
    upto = Window.partitionBy("lang").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(Window.partitionBy("lang"))
    return counts.select("lang", value, (2 * F.sum("n").over(upto) >= whole).alias("half")).where("half").groupBy("lang").agg(F.min(value).alias(name))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, middle, low, high) in steps, of rows (lang, step): the median and the median distances below and above it."""
    counts = rows.groupBy("lang", "step").agg(F.count("*").alias("n"))
    away = counts.join(_median(counts, "step", "middle"), "lang").withColumn("away", F.abs(F.col("step") - F.col("middle")))
    low = _median(away.where("step <= middle").groupBy("lang", "away").agg(F.sum("n").alias("n")), "away", "low")
    high = _median(away.where("step >= middle").groupBy("lang", "away").agg(F.sum("n").alias("n")), "away", "high")
    spread = lambda c: F.greatest(c, F.lit(LEAST_SPREAD)).alias(c)
    return away.select("lang", "middle").distinct().join(low, "lang").join(high, "lang").select("lang", "middle", spread("low"), spread("high"))


def judged(docs: DataFrame, above: float = ABOVE, below: float = BELOW, most: int = MOST) -> DataFrame:
    """doc_id, lang, the features, base_failed, bits (a letter or digit), perplexity and kept of each row."""
    rows = with_words(docs)
    model, scraps = fitted(counted(docs))
    if model.count() <= most:
        found = measured(rows, arrays(model))
    else:
        found = measured_by_join(rows, model)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bits = F.col("nats") / float(np.log(2)) / F.greatest("n_letters", F.lit(1))
    found = found.withColumn("base_failed", failed).withColumn("bits", bits).withColumn("step", F.floor(F.col("bits") * STEPS))
    found = stored(found, "quality-rows")
    for scrap in [model, *scraps]:
        discard(scrap)
    of_langs = stored(bands(found.where("not base_failed and step is not null")), "quality-bands")
    if of_langs.count() <= LANGUAGES:  # a row per language: a third of all documents may be of one
        of_langs = F.broadcast(of_langs)
    stretch = F.sqrt(1 + LENGTH / F.greatest("word_chars", F.lit(1)))
    away = F.col("step") - F.col("middle")
    outside = (away > above * F.col("high") * stretch) | (-away > below * F.col("low") * stretch)
    out = found.join(of_langs, "lang", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))
    return out.select("doc_id", "lang", *_FEATURES, "base_failed", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "kept")
