"""Queries of contracts, dictionaries that must agree, draws under quotas and gated drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import contracts as C
from folioflow.operators import measures
from folioflow.plans.registry import query
from folioflow.sources.workspace import table

_WIDTH, _HEIGHT = "(p_size % 9 + 1) * 16", "(p_partkey % 7 + 1) * 16"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as recognised pages; each eleventh has another fault put in."""
    fault = F.col("p_partkey") % 11
    ids = F.concat(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i + 300), F.array(F.when(fault == 1, 9).otherwise(263)))
    ids = F.when(fault == 2, F.concat(F.array(F.lit(11)), ids)).when(fault == 3, F.array().cast("array<int>")).when(fault == 10, F.concat(F.array(F.lit(70_000)), ids)).otherwise(ids)
    price = F.col("p_retailprice") if "p_retailprice" in table(spark, sf, "part").columns else F.col("p_size").cast("double")
    timing = F.when(fault == 4, F.lit(float("inf"))).when(fault == 5, F.lit(None).cast("double")).otherwise(price)
    rows = table(spark, sf, "part").select("p_partkey", ids.alias("token_ids"), F.expr(_WIDTH).alias("w"), F.expr(_HEIGHT).alias("h"), "p_type", timing.alias("t"), price.alias("price"), fault.alias("fault"))
    names = [x for t in C.TIMINGS for x in (F.lit(t), F.col("t") if t == "decode_ms" else F.col("price"))]
    other = [F.lit("queue_ms"), F.when(F.col("fault") == 6, F.lit(-1.0)).otherwise(0.0)]
    return rows.select(
        "p_partkey", "token_ids", F.size("token_ids").alias("output_tokens"), F.when(F.col("fault") == 7, "length").otherwise("eos").alias("finish_reason"), F.col("p_type").alias("text"),
        F.lit(False).alias("teacher_forced"), F.when(F.col("fault") == 8, "int8").otherwise("fp32").alias("precision"), F.col("w").alias("width"), F.col("h").alias("height"),
        ((F.col("w") / 16) * (F.col("h") / 16) + 16 + (F.col("fault") == 9).cast("int")).cast("int").alias("input_tokens"), F.create_map(*names, *other).alias("timings"),
        F.struct(F.lit(64).alias("max_new_tokens"), F.lit(512).alias("max_dimension")).alias("options"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 11 WHEN 1 THEN ['finish_reason'] WHEN 2 THEN ['no_stop_inside'] WHEN 3 THEN ['valid_token_ids', 'finish_reason'] WHEN 4 THEN ['timing.decode_ms', 'other_timings'] WHEN 5 THEN ['timing.decode_ms', 'other_timings']
WHEN 6 THEN ['other_timings'] WHEN 7 THEN ['finish_reason'] WHEN 8 THEN ['precision'] WHEN 9 THEN ['prefix_patch_shape'] ELSE ['valid_token_ids'] END AS broken FROM part WHERE p_partkey % 11 > 0""")
def inference_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of a recognised page, and which of them rows with planted faults break."""
    return C.breaches(results(spark, sf), C.result_rules(strict=True), "p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN ['cache'] ELSE ['cache', 'lock'] END AS sources, c_custkey % 13 = 0 AS conflict FROM customer WHERE c_custkey % 65 <> 0
UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, ['cache'], false FROM customer WHERE c_custkey % 65 = 0""")
def merged_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries as one: keys that only one has, and keys whose entries differ."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    lock = rows.where("c_custkey % 5 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    more = rows.where("c_custkey % 5 = 0 and c_custkey % 13 = 0 and c_custkey % 65 <> 0")
    return C.merged({"cache": rows, "lock": lock.unionByName(more)}, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'restore' WHEN page_id % 9 = 0 THEN 'altered' ELSE 'present' END AS state FROM pages""")
def restored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a lock whose files are there with their digest, there with another, or to be restored."""
    pages = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    found = pages.where("page_id % 7 <> 0").withColumn("html", F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return C.restored(pages.select("page_id", F.sha2(F.encode("html", "utf-8"), 256).alias("sha")), found, "page_id", "sha", F.encode("html", "utf-8"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS at, round(1 / list_sum(list_transform(e, lambda v: exp(v - list_max(e)))), 9) AS probability FROM e""")
def winner_probability(spark: SparkSession, sf: str) -> DataFrame:
    """The largest of each vector's logits and its softmax share."""
    found = table(spark, sf, "embeddings").select("vec_id", C.winner(F.transform("embedding", lambda v: v.cast("double"))).alias("w"))
    return found.select("vec_id", "w.at", F.round("w.probability", 9).alias("probability"))


@query("""SELECT l_linenumber AS batch, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10 FROM lineitem GROUP BY l_linenumber""")
def batch_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Median and tenth of each batch's times, ranked over ranges so that no batch is sorted in one task."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("batch"), "l_extendedprice")
    return measures.percentiles(rows, "batch", "l_extendedprice").select("batch", "median", "p10")


@query("""SELECT stage, round(quantile_cont(ms, 0.5), 6) AS median FROM (SELECT unnest(['quantity', 'discounted', 'taxed']) AS stage, unnest([l_quantity::DOUBLE, l_extendedprice * (1 - l_discount), l_extendedprice * (1 + l_tax)]) AS ms FROM lineitem WHERE l_linenumber = 1) GROUP BY stage""")
def stage_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of each stage's times in the rows of batch 1."""
    price = F.col("l_extendedprice")
    stages = {"quantity": F.col("l_quantity").cast("double"), "discounted": price * (1 - F.col("l_discount")), "taxed": price * (1 + F.col("l_tax"))}
    long = F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), ms.alias("ms")) for name, ms in stages.items())))
    return measures.percentiles(table(spark, sf, "lineitem").where("l_linenumber = 1").select(long.alias("s")).select("s.*"), "stage", "ms").select("stage", "median")


@query("""WITH s AS (SELECT doc_id, source, sha256('seed' || chr(0) || source || chr(0) || doc_id) AS draw FROM documents WHERE source IS NOT NULL)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) AS rn FROM s WHERE left(draw, 12) < printf('%012x', (0.35 * 281474976710656)::BIGINT)) WHERE rn <= 20""")
def quota_draw(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded draw of 35 of a hundred documents, at most 20 of each source."""
    return C.drawn(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 20, 0.35, "seed")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: 1 - abs(v::DOUBLE)) AS c, list_transform(embedding[7:12], lambda v: v > 0) AS h FROM embeddings),
p AS (SELECT vec_id, h, list_transform(range(1, 7), lambda k: list_reduce(c[1:k], lambda a, b: a * b)) AS p FROM v),
t AS (SELECT unnest([0.3::DOUBLE, 0.5, 0.7, 0.9]) AS threshold), n AS (SELECT threshold, coalesce(nullif(list_position(list_transform(p, lambda x: x >= threshold), false), 0) - 1, 6) AS n, coalesce(nullif(list_position(h, false), 0) - 1, 6) AS r FROM p, t)
SELECT threshold, sum(n)::BIGINT AS drafted, sum(least(n, r))::BIGINT AS kept, round((sum(least(n, r)) + count(*)) * 9 / sum(9 + CASE WHEN n > 0 THEN 0.6 + 1.7 + (n - 1) ELSE 0 END), 6) AS speedup FROM n GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What gates of several confidences would draft, keep and gain."""
    steps = table(spark, sf, "embeddings").select(F.transform(F.slice("embedding", 1, 6), lambda v: 1 - F.abs(v.cast("double"))).alias("c"), F.transform(F.slice("embedding", 7, 6), lambda v: v > 0).alias("h"))
    return C.swept(steps, "c", "h", [0.3, 0.5, 0.7, 0.9], 9.0, (1.7, 1.0), 0.6).withColumn("speedup", F.round("speedup", 6))
