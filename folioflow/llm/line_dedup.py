"""Operator 2, line dedup by a suffix array over line ids.

Every line of every text gets a 128-bit id. Lines that occur once can't be part of a repeat and go at once. Prefix
doubling then ranks the suffixes that are left: round k sorts pairs of ranks ``2**k`` lines apart and keeps pairs that
occur twice, so a rank of round k names a repeated block of ``2**k`` lines, in the order of the suffix array. Two ranks
that overlap name a block of any length, so the suffixes with equal ranks at depth m are the interval with a longest
common prefix of m lines or more. The array is sorted only as deep as a run of ``min_words`` words needs.

A run is repeated if it has ``min_words`` words or more and an equal run begins earlier (by doc_id, then line). All its
lines are deleted. It is enough to look at runs that just reach ``min_words``, from each first line and from each last
line: a longer repeated run is the union of those inside it, and they are repeated too.

Ranks come from a range-partitioned sort and are written to the shared folder each round. Names and their counts are
pre-aggregated and written before they are joined back, so that Spark may split the partition of a line or run that a
third of all documents hold. A document's own lines are one row.
Rows with equal doc_id and text are one record; each comes back, with the same lines deleted. Rows with a null doc_id
have no place in the order: they come back whole and delete nothing. Null texts stay null; empty lines count no words;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import discard, small_batches, stored

MIN_WORDS = 50
KEY = ["doc_id", "mark"]


def short_runs(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, lines) of the runs that just reach ``least`` words, from each start and from each end."""
    c = np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(c, c[:-1] + least)  # first prefix sum that reaches it
    found = {(i, int(e) - i) for i, e in enumerate(ends) if e < len(c)}
    starts = np.searchsorted(c, c[1:] - least, side="right") - 1
    return sorted(found | {(int(s), e + 1 - int(s)) for e, s in enumerate(starts) if s >= 0})


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, starts, spans = [], [], [], []
            for text in batch["text"].to_pylist():
                lines = text.encode().split(b"\n")
                ids = [xxhash.xxh3_128_intdigest(line) for line in lines]
                high.append([(x >> 64) - (1 << 63) for x in ids])
                low.append([(x & (1 << 64) - 1) - (1 << 63) for x in ids])
                runs = short_runs(np.fromiter((len(line.split()) for line in lines), np.int64, len(lines)), least)
                starts.append([r[0] for r in runs])
                spans.append([r[1] for r in runs])
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(high, longs), pa.array(low, longs), pa.array(starts, ints), pa.array(spans, ints)], names=["doc_id", "mark", "high", "low", "starts", "spans"])

    return run


def _ranked(groups: DataFrame, *by: str) -> DataFrame:
    """Adds rank: increasing with ``by`` over all partitions."""
    return groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, start, span): runs of lines that an equal run precedes; mark is a hash of the text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("mark", F.xxhash64("text"))
    lines = stored(texts.mapInArrow(_lines(min_words), "doc_id long, mark long, high array<long>, low array<long>, starts array<int>, spans array<int>"), "lines").where("doc_id is not null")
    ids = lines.select(*KEY, F.posexplode(F.arrays_zip("high", "low"))).select(*KEY, "pos", "col.high", "col.low").distinct()
    twice = stored(_ranked(ids.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "high", "low"), "ids")
    suffixes = stored(ids.join(twice, ["high", "low"]).select(*KEY, "pos", "rank"), "suffixes")
    runs = lines.select(*KEY, F.explode(F.arrays_zip("starts", "spans")).alias("r")).select(*KEY, F.col("r.starts").alias("start"), F.col("r.spans").alias("span")).distinct()
    runs = runs.join(suffixes.select(*KEY, F.col("pos").alias("start")), [*KEY, "start"], "left_semi")
    runs = stored(runs.withColumn("level", F.floor(F.log2(F.col("span").cast("double"))).cast("int")), "runs")
    deepest = runs.agg(F.max("level")).first()[0]
    out = None
    for level in range((deepest if deepest is not None else -1) + 1):
        block = 1 << level
        head = suffixes.select(*KEY, F.col("pos").alias("start"), F.col("rank").alias("r1"))
        tail = suffixes.select(*KEY, F.col("pos").alias("tail"), F.col("rank").alias("r2"))
        named = runs.where(F.col("level") == level).withColumn("tail", F.col("start") + F.col("span") - block).join(head, [*KEY, "start"]).join(tail, [*KEY, "tail"])
        name = ["span", "r1", "r2"]
        named = stored(named, "named")
        first = stored(named.groupBy(*name).agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*name, "first"), "first")
        later = stored(named.join(first, name).where(F.struct("doc_id", "mark", "start") != F.col("first")).select(*KEY, "start", "span"), "later")
        out = later if out is None else out.union(later)
        for done in (named, first):
            discard(done)
        if level == deepest:
            break
        ahead = suffixes.select(*KEY, (F.col("pos") - block).alias("pos"), F.col("rank").alias("next"))
        paired = stored(suffixes.join(ahead, [*KEY, "pos"]), "paired")
        again = _ranked(paired.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rank").alias("one"), F.col("next").alias("two")), "one", "two")
        again = stored(again, "ranks")
        pairs = paired.withColumnsRenamed({"rank": "one", "next": "two"})
        shorter, suffixes = suffixes, stored(pairs.join(again, ["one", "two"]).select(*KEY, "pos", "rank"), "suffixes")
        for done in (paired, again, shorter):
            discard(done)
        if suffixes.isEmpty():
            break
    return out if out is not None else runs.select(*KEY, "start", "span")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, deleted = [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            gone = {i for s in spans or () for i in range(s["start"], s["start"] + s["span"])}
            texts.append(text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone))
            counts.append(len(lines))
            deleted.append(sorted(gone))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(deleted, pa.list_(pa.int32()))], names=["doc_id", "text", "n_lines", "deleted_lines"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines and deleted_lines (their numbers from 0) of each row."""
    spans = later_copies(docs, min_words).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "span")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string, n_lines long, deleted_lines array<int>")
