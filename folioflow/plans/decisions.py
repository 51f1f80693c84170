"""Queries of proposals, loops, tree scores, routes and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import loops, measures, proposals, scoring
from folioflow.plans.registry import query
from folioflow.sources.workspace import table, tasks_for

FEATURES = ["p_size", "p_retailprice"]
TREES = [
    [{"feature": k % 2, "threshold": 10.0 + 4 * k if k % 2 == 0 else 900.0 + 15 * k, "left": 1, "right": 2}, {"feature": 1 - k % 2, "threshold": 950.0 + 10 * k if k % 2 == 0 else 8.0 + 3 * k, "left": 3, "right": 4}, {"value": 0.01 * k}, {"value": -0.02 * k}, {"value": 0.03}]
    for k in range(12)
]


def _case(tree: list[dict], k: int = 0) -> str:
    node = tree[k]
    if "value" in node:
        return f"{node['value']!r}::DOUBLE"
    return f"CASE WHEN {FEATURES[node['feature']]} <= {node['threshold']!r} THEN {_case(tree, node['left'])} ELSE {_case(tree, node['right'])} END"


@query(f"SELECT p_partkey, round(0.125 + {' + '.join(map(_case, TREES))}, 9) AS score FROM part")
def tree_table_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """A model written out, read back, checked and scored."""
    model = scoring.parsed_trees(scoring.exported(0.125, TREES, FEATURES), FEATURES)
    return table(spark, sf, "part").select("p_partkey", F.round(scoring.tree_score(model, [F.col(f) for f in FEATURES]), 9).alias("score"))


@query("""SELECT p_partkey, CASE WHEN p_size - 20 >= 0 AND p_size * least(1, 768 / p_retailprice) >= 8 THEN 768 WHEN p_size - 10 >= 0 AND p_size * least(1, 1024 / p_retailprice) >= 8 THEN 1024 ELSE 1536 END AS size,
CASE WHEN p_size / 50 >= 0.8 THEN 768 WHEN p_size / 50 >= 0.5 THEN 1024 ELSE 1536 END AS cleared FROM part""")
def route_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest size that a score and the line height allow, and the lowest size that clears its threshold."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    share = size / 50
    return table(spark, sf, "part").select("p_partkey", scoring.chosen({768: size - 20, 1024: size - 10}, size, price).alias("size"), scoring.cleared({768: share, 1024: share}, {768: 0.8, 1024: 0.5}).alias("cleared"))


@query("""WITH t AS (SELECT unnest([5.0, 15.0, 25.0, 35.0, 45.0]::DOUBLE[]) AS threshold) SELECT threshold, round(1 - sum(CASE WHEN p_size >= threshold THEN p_retailprice * 0.4 ELSE p_retailprice END) / sum(p_retailprice), 8) AS saved, round(count(*) FILTER (p_size >= threshold AND p_brand LIKE '%1') / count(*), 8) AS wrong, round(count(*) FILTER (p_size >= threshold AND p_brand LIKE '%1') / count(*), 8) <= 0.1 AS allowed FROM part, t GROUP BY threshold""")
def policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Saved cost and misrouted share of a grid of thresholds, against a budget."""
    out = scoring.policy_grid(table(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice") * 0.4, F.col("p_retailprice"), F.col("p_brand").endswith("1"), [5.0, 15.0, 25.0, 35.0, 45.0], 0.1)
    return out.withColumns({"saved": F.round("saved", 8), "wrong": F.round("wrong", 8)})


@query("""WITH m AS (SELECT user_id, avg(value) AS a, stddev_pop(value) / 1000 AS noise, max(event_type) AS stop FROM events GROUP BY user_id) SELECT user_id, a / 5000 <= greatest(0.02, noise + 0.01) AND stop IN ('view', 'signup') AS fine, CASE WHEN a - 100 > 2 * noise THEN 'must-match' ELSE 'near-tie' END AS decision FROM m""")
def noise_aware_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("a"), (F.stddev_pop("value") / 1000).alias("noise"), F.max("event_type").alias("stop"))
    return m.select("user_id", scoring.acceptable(F.col("a") / 5000, F.col("noise"), F.col("stop"), F.lit("view"), F.lit("signup")).alias("fine"), scoring.margin_decision(F.col("a"), F.lit(100.0), F.col("noise")).alias("decision"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 60 - 25 THEN p_size ELSE 35 END AS budget, round((0.33 * p_retailprice + 0.000049 * p_retailprice * p_retailprice + p_size * (4.3 + 0.00064 * p_retailprice) / 1.47) / 1000, 9) AS seconds, round((p_retailprice - p_size) / greatest(p_size - 1, 1), 9) AS per_token FROM part""")
def page_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Output budgets, modelled seconds and derived rates."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    speed = scoring.speeds(price, size, size)
    return table(spark, sf, "part").select("p_partkey", scoring.budget_of(size, F.lit(25), 60, F.lit(True)).alias("budget"), F.round(scoring.page_seconds(price, size), 9).alias("seconds"), F.round(speed["ms_per_token"], 9).alias("per_token"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:32], lambda v: -abs(v::DOUBLE)) AS p FROM embeddings) SELECT vec_id, round(list_sum(p) / 32, 8) AS mean, round(list_min(p), 8) AS least, round(len(list_filter(p, lambda v: exp(v) < 0.9)) / 32, 8) AS below_most FROM x""")
def first_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the first 32 log-probabilities."""
    c = scoring.confidence(F.transform("embedding", lambda v: -F.abs(v.cast("double"))))
    rows = table(spark, sf, "embeddings").select("vec_id", c.alias("c"))
    return rows.select("vec_id", F.round("c.mean", 8).alias("mean"), F.round("c.least", 8).alias("least"), F.round("c.below_most", 8).alias("below_most"))


@query("""WITH t AS (SELECT p_partkey, p_size AS n, list_concat(list_concat([1, 2, 90], list_transform(range(0, p_size), lambda i: 7)), [91, 5]) AS t FROM part) SELECT p_partkey, len(t)::INT AS tokens, 2 AS first, (n + 3)::INT AS last, (n + 4)::INT AS seen_inside, (n * (n + 2) / 2)::BIGINT * 0 AS hidden FROM t""")
def prompt_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt around image tokens, the image's place in it, and what a query inside it sees."""
    rows = table(spark, sf, "part").select("p_partkey", scoring.prompt([1, 2, 90], 7, 91, [5], F.col("p_size")).alias("t"))
    at = rows.withColumn("at", scoring.image_range(F.col("t"), 90, 91))
    hidden = F.aggregate(F.sequence(F.col("at.first"), F.col("at.last")), F.lit(0).cast("long"), lambda s, k: s + scoring.masked(F.col("at.first"), k, F.col("at.first"), F.col("at.last")).cast("long"))
    return at.select("p_partkey", F.size("t").alias("tokens"), F.col("at.first").cast("int").alias("first"), F.col("at.last").cast("int").alias("last"), scoring.visible_end(F.col("at.first"), F.col("at.first"), F.col("at.last")).cast("int").alias("seen_inside"), hidden.alias("hidden"))


@query("""WITH w AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)), o AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos FROM w),
g AS (SELECT conv_id, pos, lag(word, 3) OVER u || ' ' || lag(word, 2) OVER u || ' ' || lag(word) OVER u || ' ' || word AS gram FROM o WINDOW u AS (PARTITION BY conv_id ORDER BY pos)) SELECT conv_id, gram, max(pos) AS last FROM g WHERE pos >= 4 GROUP BY ALL""")
def gram_index(spark: SparkSession, sf: str) -> DataFrame:
    """The latest place of every four-word gram of a conversation."""
    turns = table(spark, sf, "conversations")
    tasks = tasks_for(turns, F.length("text"), 1 << 22)
    return proposals.last_occurrences(turns.select("conv_id", "turn", T.word_list(F.col("text")).alias("words")), "conv_id", "turn", "words", " ", tasks=tasks)


@query()
def ngram_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier n-gram proposes for the end of every text, with the words before as tokens, and how much of it the text's own end confirms."""
    words = table(spark, sf, "documents").select("doc_id", F.transform(T.word_list(F.col("text")), lambda w: F.crc32(w)).alias("w")).where(F.size("w") > 16)
    head = words.select("doc_id", F.slice("w", 1, F.size("w") - 8).alias("tokens"), F.slice("w", -8, 8).alias("truth"))
    found = proposals.proposals(head, "doc_id", "tokens")
    return found.join(head.select("doc_id", "truth"), "doc_id").select("doc_id", "size", "start", F.size("draft").alias("n"), proposals.accepted(F.col("draft"), F.col("truth")).alias("accepted"))


@query()
def counting_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Where texts end by repeating or by counting: tokens are characters, digit runs are one number."""
    return loops.loop_stops(table(spark, sf, "documents"), "doc_id", "text", {48 + d: d for d in range(10)})


@query()
def draft_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed acceptance against cost over each user's events, with probes."""
    steps = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") % 100 / 100).alias("rate"), F.lit(1.0).alias("extra"), F.lit(2.0).alias("single"))
    return proposals.drafting(steps, "user_id", "event_id", "rate", "extra", "single").withColumn("smooth", F.round("smooth", 9))


@query("""WITH p AS (SELECT l_returnflag, l_partkey AS m, count(*)::DOUBLE AS c FROM lineitem WHERE l_quantity < 25 GROUP BY ALL), q AS (SELECT l_returnflag, l_partkey AS m, count(*)::DOUBLE AS c FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL),
a AS (SELECT l_returnflag, m, c / sum(c) OVER (PARTITION BY l_returnflag) AS p FROM p), b AS (SELECT l_returnflag, m, c / sum(c) OVER (PARTITION BY l_returnflag) AS q FROM q), t AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p DESC, m) AS rn FROM a),
j AS (SELECT l_returnflag, p, greatest(coalesce(q, 0), 1e-300) AS q FROM t LEFT JOIN b USING (l_returnflag, m) WHERE rn <= 32), s AS (SELECT l_returnflag, sum(p * ln(p / q)) AS top, 1 - sum(p) AS rp, greatest(1 - sum(q), 1e-300) AS rq FROM j GROUP BY l_returnflag)
SELECT l_returnflag, round(greatest(top + CASE WHEN rp > 1e-12 THEN rp * ln(rp / rq) ELSE 0 END, 0), 6) AS kl FROM s""")
def kl_topk_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence over the 32 likeliest of many keys, the rest pooled."""
    lines = table(spark, sf, "lineitem")
    side = lambda rule: lines.where(rule).groupBy("l_returnflag", "l_partkey").agg(F.count("*").cast("double").alias("c"))
    return measures.divergence(side("l_quantity < 25"), side("l_quantity >= 25"), "l_returnflag", "l_partkey", "c")


@query("""WITH a AS (SELECT o_orderpriority, o_orderkey % 3 AS slot, median(o_totalprice) AS m FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority, max(m) FILTER (slot = 0) AS one, max(m) FILTER (slot = 1) AS mid, max(m) FILTER (slot = 2) AS two FROM a GROUP BY o_orderpriority)
SELECT o_orderpriority, CASE WHEN abs(one - two) / least(one, two) > 0.05 THEN 'unstable' WHEN 1 - mid / one < -0.01 OR 1 - mid / two < -0.01 THEN 'regression' WHEN 1 - mid / one >= 0.005 AND 1 - mid / two >= 0.005 THEN 'eligible' ELSE 'no gain' END AS verdict FROM b""")
def bracket_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate between two controls: their drift, its gain over both, and what follows within limits."""
    rows = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("slot"), "o_totalprice")
    b = measures.bracketed(rows, "o_orderpriority", "slot", "o_totalprice")
    gain = F.least(1 - F.col("c") / F.col("a"), 1 - F.col("c") / F.col("b"))
    drift = F.abs(F.col("a") - F.col("b")) / F.least("a", "b")
    return b.select("o_orderpriority", F.when(drift > 0.05, "unstable").when(gain < -0.01, "regression").when(gain >= 0.005, "eligible").otherwise("no gain").alias("verdict"))


@query("""WITH l AS (SELECT event_id, user_id, ts, value, sum((value > 150)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, count(*) AS n FROM l WHERE b = 0 GROUP BY user_id) SELECT u.user_id, coalesce(n, 0) AS leading FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id)""")
def leading_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the leading run of accepted steps of each user."""
    broken = F.min(F.when(F.col("value") > 150, F.struct("ts", "event_id")))
    first = table(spark, sf, "events").groupBy("user_id").agg(broken.alias("stop"))
    before = F.count_if(F.col("stop").isNull() | (F.struct("ts", "event_id") < F.col("stop")))
    return table(spark, sf, "events").join(first, "user_id").groupBy("user_id").agg(before.alias("leading"))


@query("""WITH d AS (SELECT unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i, doc_id FROM documents), n AS (SELECT doc_id, i, c BETWEEN '0' AND '9' AS digit, lag(c BETWEEN '0' AND '9') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM d)
SELECT doc_id, count(*) FILTER (digit AND before IS NOT TRUE) AS numbers, count(*) FILTER (NOT digit) AS others FROM n GROUP BY doc_id""")
def number_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Digit runs as one symbol each: how many numbers and how many other symbols a text has."""
    runs = F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1))
    return table(spark, sf, "documents").select("doc_id", runs.cast("long").alias("numbers"), F.length(F.regexp_replace("text", "[0-9]", "")).cast("long").alias("others"))
