"""Joins: resume, merge, similarity by shared grams, perceptual hashes, as-of."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import word_list
from folioflow.sources.workspace import small_batches, stored


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs not yet done (resume)."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def inventory(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Counts of inputs by status: done or missing."""
    seen = done.select(key).distinct().withColumn("found", F.lit(True))
    return inputs.join(seen, key, "left").groupBy(F.when(F.col("found"), "done").otherwise("missing").alias("status")).agg(F.count("*").alias("n"))


def merged(base: DataFrame, newer: DataFrame, key: str, value: str, strict: bool = False) -> DataFrame:
    """Upsert: the newer value wins where both have the key; keys of either side stay. strict refuses keys that only the newer side has."""
    both = base.select(key, F.col(value).alias("old")).join(newer.select(key, F.col(value).alias("new")), key, "full").select(key, F.coalesce("new", "old").alias(value), F.when(F.col("old").isNull(), F.raise_error(F.lit("a new row matches no old one")).cast("string") if strict else F.lit("inserted")).when(F.col("new").isNull(), "kept").otherwise("updated").alias("action"))
    return both


BROADCAST = 2_000_000


def beside(df: DataFrame) -> DataFrame:
    """A stored frame, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


#: Bytes of text, or words, that a Python worker works on at a time (a longer text is one piece).
PIECE = 1 << 20
_RANDOM = np.random.default_rng(13)
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C1B


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about PIECE bytes or words each."""
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        yield first, end
        first = end


def _word_hashes(data: np.ndarray, edges: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the words of texts that lie one behind another; edges are their first bytes and the end."""
    inside = np.r_[False, _WORD[data], False]
    border = np.zeros(len(data) + 1, bool)
    border[edges] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * powers[0][: len(data)])]
    h = (sums[ends] - sums[starts]) * powers[1][starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), np.searchsorted(edges, starts, "right") - 1


def gram_marks(docs: DataFrame, key: str, size: int) -> DataFrame:
    """(key, a, b): each run of ``size`` lower-cased ASCII words of a text by 128 bits of hash, repeats included; no text goes along.

    Words are hashed once, by the bytes of whole Arrow batches; a run's hashes are sums of its words' by odd weights of their places.
    """
    weights = np.random.default_rng(size).integers(0, 1 << 63, (2, size), np.uint64) * np.uint64(2) + np.uint64(1)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(PIECE)
        for batch in batches:
            texts = batch.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for first, end in _pieces(offsets):
                edges = offsets[first : end + 1].astype(np.int64)
                if edges[-1] - edges[0] > len(powers[0]):
                    powers = _powers(int(edges[-1] - edges[0]))
                words, row = _word_hashes(data[edges[0] : edges[-1]], edges - edges[0], powers)
                n = max(0, len(words) - size + 1)
                whole = np.flatnonzero(row[:n] == row[size - 1 :]) if n else np.zeros(0, np.int64)
                a, b = (sum((w * words[k : n + k] for k, w in enumerate(side)), np.zeros(n, np.uint64))[whole].view(np.int64) for side in weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[whole])), pa.array(a), pa.array(b)], names=[key, "a", "b"])

    lowered = docs.select(key, F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return lowered.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, a long, b long")


def contaminated(docs: DataFrame, reference: DataFrame, key: str, ref_key: str, size: int = 13, least: int = 3, distinct_words: int = 8) -> DataFrame:
    """Documents that share ``least`` or more distinct n-grams with the reference, and the item they share most with.

    A gram counts for the first item that has it. Grams meet as 128-bit hashes where documents are read (a broadcast while
    the reference has few grams, 20 bytes each); only hits are shuffled. Ties of the item go to the smallest id.
    """
    words = reference.select(ref_key, word_list(F.col("text")).alias("w")).where(F.size("w") >= size)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    rich = words.select(ref_key, F.explode(F.filter(runs, lambda g: F.size(F.array_distinct(g)) >= distinct_words)).alias("g")).select(ref_key, F.array_join("g", " ").alias("text"))
    known = stored(gram_marks(rich, ref_key, size).groupBy("a", "b").agg(F.min(ref_key).alias(ref_key)), "grams")
    hits = gram_marks(docs, key, size).join(beside(known), ["a", "b"]).select(key, ref_key, "a", "b").distinct()
    by_item = hits.groupBy(key, ref_key).agg(F.count("*").alias("shared"))
    top = F.min_by(ref_key, F.struct(-F.col("shared"), F.col(ref_key)))
    return by_item.groupBy(key).agg(F.sum("shared").alias("hits"), top.alias("top_item")).where(F.col("hits") >= least)


BITS = 60


def _majorities(lists: pa.Array) -> pa.Array:
    """The 60 bits that most of a list's words have in their MD5; every different word of the batch is hashed once."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), offsets.astype(np.int64) - offsets[0]
    digests = b"".join(hashlib.md5(w.encode()).digest()[:8] for w in coded.dictionary.to_pylist())
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)[:, :BITS]
    sizes = np.diff(offsets)
    up = np.zeros((len(sizes), BITS), bool)
    for first, end in _pieces(offsets):
        some = np.flatnonzero(sizes[first:end]) + first  # reduceat takes no empty ranges
        if len(some):
            held = bits[codes[offsets[first] : offsets[end]]]
            up[some] = 2 * np.add.reduceat(held, offsets[some] - offsets[first], axis=0, dtype=np.int32) > sizes[some, None]
    return pa.array(up @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)), mask=sizes == 0)


def simhash(docs: DataFrame, key: str) -> DataFrame:
    """(key, simhash): 60 bits by majority over the MD5 of a text's distinct words; texts without words have no row. Votes are counted by Arrow batches."""
    small_batches(docs.sparkSession)
    words = F.array_distinct(word_list(F.col("text")))
    return docs.select(key, F.arrow_udf(_majorities, "long")(words).alias("simhash")).where("simhash is not null")


def _in_bands(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs (one, two) of hashes that agree in some three of ``most + 3`` bands, as all do that differ in ``most`` bits at most."""
    edges = [round(k * BITS / (most + 3)) for k in range(most + 4)]
    masks = [(1 << end) - (1 << first) for first, end in itertools.pairwise(edges)]
    chosen = F.lit([sum(c) for c in itertools.combinations(masks, 3)]).cast("array<bigint>")
    keyed = lambda side, name: side.select(F.col("simhash").alias(name), F.posexplode(chosen).alias("band", "mask")).select(name, "band", F.col(name).bitwiseAND(F.col("mask")).alias("bits"))
    return keyed(left, "one").join(keyed(right, "two"), ["band", "bits"])


def _in_flips(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs (one, two) of hashes of which one of three bands differs in ``most // 3`` bits at most; the right side's bands come with so many bits flipped."""
    wide = BITS // 3
    flips = [sum(1 << b for b in chosen) for n in range(most // 3 + 1) for chosen in itertools.combinations(range(wide), n)]
    part = lambda k: F.shiftright("simhash", wide * k).bitwiseAND((1 << wide) - 1)
    key = lambda k, value: F.struct(F.lit(k).alias("band"), value.alias("bits"))
    plain = left.select(F.col("simhash").alias("one"), F.explode(F.array(*(key(k, part(k)) for k in range(3)))).alias("key"))
    spread = lambda k: F.transform(F.lit(flips).cast("array<bigint>"), lambda m: key(k, part(k).bitwiseXOR(m)))
    flipped = F.flatten(F.array(*map(spread, range(3))))
    return plain.join(right.select(F.col("simhash").alias("two"), F.explode(flipped).alias("key")), "key")


def near_by_hamming(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(one, two, distance): distinct hashes (simhash) of either side that differ in at most ``most`` bits.

    Up to 4 bits, hashes meet by three of ``most + 3`` bands (35 keys of 25 or 26 bits a hash for 4, so chance pairs are one
    in a million or fewer). Beyond, the right side is the smaller one and comes with flipped bits: with 8 that is 633 keys for
    a right hash, 3 for a left one, and chance pairs are 0.06 % of all. Then bits are counted.
    """
    distance = F.bit_count(F.col("one").bitwiseXOR(F.col("two"))).cast("int")
    met = (_in_bands if most <= 4 else _in_flips)(left, right, most)
    return met.select("one", "two", distance.alias("distance")).where(F.col("distance") <= most).distinct()


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one union, one sort per key, no range join."""
    rows = left.select(by, at, F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("v")).unionByName(right.select(by, at, F.lit(0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("row"), F.col(value).alias("v")))
    upto = Window.partitionBy(by).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("v", ignorenulls=True).over(upto)).where("side = 1").select("row.*", F.col("found").alias(value))


def null_tolerant(settings: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of settings that agree with a wanted row, whose nulls stand for anything: one equi-join per set of null columns."""
    shape = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    once = wanted.select(*columns, shape.alias("shape")).distinct()
    rows, earlier = settings.limit(0), []
    for (pattern,) in sorted(once.select("shape").distinct().collect()):  # 2 ** columns at most
        named = [c for c, bit in zip(columns, pattern, strict=True) if bit == "0"]
        if not named:
            return settings
        some, left = once.where(F.col("shape") == pattern).select(*named), settings
        for other, names in earlier:
            left = left.join(other, names, "left_anti")
        rows = rows.unionByName(left.join(some, named, "left_semi"))
        earlier.append((some, named))
    return rows
