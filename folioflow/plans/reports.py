"""Queries of reports: lookups, stage statistics, reruns, contracts with problem lists, labels and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import seeded_rank
from folioflow.operators import measures
from folioflow.operators import vectors as V
from folioflow.plans.registry import query
from folioflow.sources.workspace import table


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that can't be decided is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())


def globbed(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern in which ``*`` stands for anything."""
    return name.rlike("^" + ".*".join("\\Q" + p + "\\E" if p else "" for p in pattern.split("*")) + "$")


def url_quoted(text: Column) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS steps, p_retailprice FROM lineitem LEFT JOIN part ON p_partkey = CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey END")
def token_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens looked up in a table, the first of each sequence replaced by a fixed row."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_partkey")).alias("p_partkey"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("steps"))
    return rows.join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", "left").drop("p_partkey")


@query("WITH s AS (SELECT p_brand, max(p_retailprice) / 127 AS scale FROM part GROUP BY p_brand) SELECT p_partkey, round(round_even(p_retailprice / scale, 0) * scale, 6) AS restored FROM part JOIN s USING (p_brand)")
def group_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Values coded by their group's scale and multiplied back."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    scales = part.groupBy("p_brand").agg((F.max("p_retailprice") / 127).alias("scale"))
    return part.join(scales, "p_brand").select("p_partkey", F.round(F.rint(F.col("p_retailprice") / F.col("scale")) * F.col("scale"), 6).alias("restored"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e, b.e AS f FROM x a JOIN x b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(e[i] - f[i]))), 9) AS worst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - f[i]) * (e[i] - f[i]))) / 64), 9) AS rms, true AS same_pattern, 64 - len(list_filter(range(1, 65), lambda i: e[i] = f[i])) AS differing FROM p")
def tensor_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Largest and root mean square difference of two vectors, whether they are finite in the same places, entries that differ."""
    a = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e"))
    both = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id").withColumn("d", F.zip_with("e", "f", lambda x, y: x - y))
    odd = lambda v: F.transform(v, lambda x: F.when(F.isnan(x), 1).when(x == float("inf"), 2).when(x == float("-inf"), 3).otherwise(0))
    return both.select("vec_id", F.round(F.array_max(F.transform("d", lambda x: F.abs(x))), 9).alias("worst"), F.round(F.sqrt(V.dot(F.col("d"), F.col("d")) / 64), 9).alias("rms"), (odd(F.col("e")) == odd(F.col("f"))).alias("same_pattern"), F.size(F.filter("d", lambda x: x != 0)).cast("long").alias("differing"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) % 4 AS stage FROM embeddings) SELECT label, stage, round(max(v), 8) AS most, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.5), 8) AS p50, round(quantile_cont(v, 0.99), 8) AS p99 FROM x GROUP BY ALL")
def stage_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Means, maxima and percentiles over two axes."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).select("label", ((F.col("i") + 1) % 4).cast("long").alias("stage"), F.col("x").cast("double").alias("v"))
    sums = cells.groupBy("label", "stage").agg(F.round(F.max("v"), 8).alias("most"), F.round(F.avg("v"), 8).alias("mean"))
    ranked = measures.quantiles(cells, ["label", "stage"], "v", p50=0.5, p99=0.99)
    return sums.join(ranked, ["label", "stage"]).select("label", "stage", "most", "mean", F.round("p50", 8).alias("p50"), F.round("p99", 8).alias("p99"))


@query("SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS weighted, max(p_size) AS most, sum(p_size)::BIGINT AS steps FROM part GROUP BY p_brand")
def step_weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size"), 6).alias("weighted"), F.max("p_size").alias("most"), F.sum("p_size").alias("steps"))


@query("""WITH f AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_size % 3 = 0 THEN 'repetition' WHEN p_size % 3 = 1 THEN 'length' ELSE 'eos' END AS finish FROM part), r AS (SELECT p_partkey, p_retailprice * 2 AS ms, p_size % 5 = 0 AS failed FROM part WHERE p_size % 3 < 2)
SELECT p_partkey, CASE WHEN r.p_partkey IS NULL THEN 'first' WHEN failed THEN 'kept' ELSE 'rerun' END AS provenance, CASE WHEN r.p_partkey IS NOT NULL AND NOT failed THEN 'eos' ELSE finish END AS finish, round(f.p_retailprice + coalesce(r.ms, 0), 6) AS total_ms FROM f LEFT JOIN r USING (p_partkey)""")
def escalated_reruns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that looped or ran out are run again: the rerun replaces them and times add up; a failed rerun keeps the first row."""
    finish = F.when(F.col("p_size") % 3 == 0, "repetition").when(F.col("p_size") % 3 == 1, "length").otherwise("eos")
    first = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("ms"), finish.alias("finish"))
    again = first.where(F.col("finish").isin("repetition", "length")).select("p_partkey", (F.col("ms") * 2).alias("more"), (F.col("p_size") % 5 == 0).alias("failed"))
    both = first.join(again, "p_partkey", "left")
    rerun = F.coalesce(~F.col("failed"), F.lit(False))
    return both.select("p_partkey", F.when(rerun, "rerun").when(F.col("failed"), "kept").otherwise("first").alias("provenance"), F.when(rerun, "eos").otherwise(F.col("finish")).alias("finish"), F.round(F.col("ms") + F.coalesce("more", F.lit(0.0)), 6).alias("total_ms"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN 'flag' END], lambda x: x IS NOT NULL) AS problems FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08 OR l_linestatus = 'O' AND l_returnflag <> 'N'""")
def contract_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a contract, with the list of what they break."""
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08, "flag": (F.col("l_linestatus") != "O") | (F.col("l_returnflag") == "N")}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", problems(rules).alias("problems")).where("size(problems) > 0")


@query("SELECT c_custkey, c_name LIKE 'Customer#%00%1' AS fits, 'https://x.example/' || c_custkey || '?q=' || replace(c_mktsegment, ' ', '%20') AS link FROM customer WHERE c_mktsegment NOT LIKE '%\\%%'")
def names_and_links(spark: SparkSession, sf: str) -> DataFrame:
    """Names against a wildcard pattern, and quoted links."""
    return table(spark, sf, "customer").select("c_custkey", globbed(F.col("c_name"), "Customer#*00*1").alias("fits"), F.concat(F.lit("https://x.example/"), "c_custkey", F.lit("?q="), url_quoted(F.col("c_mktsegment"))).alias("link"))


@query("SELECT p_name, count(*) AS kept FROM (SELECT p_name, row_number() OVER (PARTITION BY p_name ORDER BY sha256('s6' || chr(0) || p_partkey)) AS rn FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')) WHERE rn <= 5 GROUP BY p_name")
def licensed_per_title(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of allowed kinds, five per title at most, picked by a seeded rank."""
    rows = table(spark, sf, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).withColumn("rank", seeded_rank("s6", F.col("p_partkey")))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("p_name").orderBy("rank"))).where("rn <= 5").groupBy("p_name").agg(F.count("*").alias("kept"))


@query("WITH t AS (SELECT doc_id, list_sort(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS n FROM documents) SELECT doc_id, n[len(n) // 2 + 1] AS upper_median, list_sum(n)::BIGINT AS characters FROM t")
def line_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Upper median of a document's line lengths, and their sum."""
    lengths = F.array_sort(F.transform(F.split("text", "\n"), lambda x: F.length(x)))
    rows = table(spark, sf, "documents").select("doc_id", lengths.alias("n"))
    return rows.select("doc_id", F.element_at("n", (F.floor(F.size("n") / 2) + 1).cast("int")).cast("long").alias("upper_median"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("characters"))


@query("""WITH h AS (SELECT doc_id, (instr('0123456789abcdef', substr(sha256('s7' || chr(0) || doc_id), 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha256('s7' || chr(0) || doc_id), 2, 1)) - 1 AS byte FROM documents) SELECT CASE WHEN byte < 5 THEN 'invert' WHEN byte < 20 THEN 'rotate' ELSE 'plain' END AS change, count(*) AS n FROM h GROUP BY 1""")
def seeded_augmentation(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded choice of a change: about two percent inverted, six percent rotated."""
    byte = F.conv(F.substring(seeded_rank("s7", F.col("doc_id")), 1, 2), 16, 10).cast("int")
    return table(spark, sf, "documents").groupBy(F.when(byte < 5, "invert").when(byte < 20, "rotate").otherwise("plain").alias("change")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS step, p_brand FROM part), a AS (SELECT p_brand, step, (p_size > 10)::INT AS ok, min((p_size > 10)::INT) OVER (PARTITION BY p_brand ORDER BY step ROWS UNBOUNDED PRECEDING) AS alive FROM p)
SELECT step, round(avg(ok), 6) AS accuracy, round(avg(alive), 6) AS accepted FROM a WHERE step <= 8 GROUP BY step""")
def step_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of each draft step, and the share of drafts accepted up to it."""
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    first = table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") > 10).cast("int").alias("ok")).withColumn("step", F.row_number().over(order)).where("step <= 8")  # cut in each task
    rows = first.withColumn("alive", F.min("ok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(F.col("step").cast("long").alias("step")).agg(F.round(F.avg("ok"), 6).alias("accuracy"), F.round(F.avg("alive"), 6).alias("accepted"))


@query("""WITH r AS (SELECT user_id AS arm, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM events) SELECT round, arm, event_id, CASE WHEN round % 2 = 1 THEN dense_rank() OVER (PARTITION BY round ORDER BY arm) ELSE dense_rank() OVER (PARTITION BY round ORDER BY arm DESC) END AS place FROM r WHERE round <= 6""")
def alternating_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Arms take turns; every second round goes in reversed order."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("arm"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("round")).where("round <= 6")
    up, down = (F.dense_rank().over(Window.partitionBy("round").orderBy(o)) for o in (F.col("arm"), F.desc("arm")))
    return rows.select("round", "arm", "event_id", F.when(F.col("round") % 2 == 1, up).otherwise(down).alias("place"))


@query("WITH x AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_sum(e), 9) AS total FROM x")
def pairwise_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by halving: entries are added to those half the length further on until one is left."""
    v = V.doubles(F.col("embedding"))

    def halved(v: Column, half: int) -> Column:
        return F.transform(F.array(v), lambda w: F.zip_with(F.slice(w, 1, half), F.slice(w, half + 1, half), lambda a, b: a + b))[0]

    for half in (32, 16, 8, 4, 2, 1):
        v = halved(v, half)
    return table(spark, sf, "embeddings").select("vec_id", F.round(v[0], 9).alias("total"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') = 0 AS clean, round(CASE WHEN count(value) < 2 THEN NULL ELSE (max(value) - min(value)) / min(value) END, 6) AS spread FROM events WHERE value > 0 GROUP BY ALL")
def repeat_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of repeated measurements, null below two."""
    spread = F.when(F.count("value") >= 2, (F.max("value") - F.min("value")) / F.min("value"))
    return table(spark, sf, "events").where("value > 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") == "error") == 0).alias("clean"), F.round(spread, 6).alias("spread"))
