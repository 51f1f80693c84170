"""A training-corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns what it keeps.

language ID (documents without a recognisable language go) -> n-gram Jaccard join (one document of each group stays) ->
benchmark decontamination (documents that hold a benchmark item go) -> mixing sources to target weights (documents come
out as often as the mix takes them) -> sharding (one row per document and shard).
All stages but the last return the columns of documents. An empty table passes through with no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontamination, language_id, mixing, ngram_join, sharding
from folioflow.sources.workspace import stored, table

LEAST_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: learns from the labelled rows; rejects ``und`` and scores below one half.

    The score weighs a text as if it had at most 200 n-grams, so a long text stays if 200 of its n-grams, taken on average,
    make one language likelier than all others together.
    """
    return language_id.accepted(docs, language_id.train(docs), LEAST_LANGUAGE_SCORE)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 with five words and 0.8: the document with the least doc_id of each group stays.

    Rows without words or doc_id are in no group and stay. Rows with one doc_id and different texts are told apart; of
    rows equal in both, the least by all columns stays.
    """
    heads = ngram_join.group_heads(docs, size=5, percent=80).select(F.col("doc_id").alias("head"), F.col("mark").alias("head_mark"))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    worded, mark = docs.where(~wordless), F.xxhash64(docs["text"].cast("string"))
    # few doc_ids come twice with a text: those rows alone are grouped by it, so that texts move once, to meet the heads
    again = stored(worded.where("doc_id is not null").groupBy("doc_id", mark.alias("mark")).count().where("count > 1").select(F.col("doc_id").alias("twice"), F.col("mark").alias("twice_mark")), "again")
    same = (docs["doc_id"] == F.col("twice")) & (mark == F.col("twice_mark"))
    least = worded.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias("kept_row")).select("kept_row.*")
    once = worded.join(again, same, "left_anti").unionByName(least)
    kept = once.join(heads, (once["doc_id"] == F.col("head")) & (F.xxhash64(once["text"].cast("string")) == F.col("head_mark")), "left_semi")
    return kept.unionByName(docs.where(wordless | F.col("doc_id").isNull()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go; rows are told apart by doc_id and text."""
    marked = docs.withColumn("text_mark", F.xxhash64(F.col("text").cast("string")))
    keyed = marked.select(F.xxhash64("doc_id", "text_mark").alias("doc_id"), "text")
    found = decontamination.leaks(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"].cast("string"))) == F.col("leaked"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document comes out as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the shard and place of each row, under a map rebalanced by bytes."""
    return sharding.shard_evenly(docs)


STAGES = [
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL can't train a classifier or walk a latent space; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
