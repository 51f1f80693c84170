"""Queries that audit and compare runs: contracts, reports recomputed, matches, grids of policies, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import strings as S
from folioflow.functions.text import url_family
from folioflow.operators import audits as A
from folioflow.operators import vectors as V
from folioflow.plans.registry import query
from folioflow.sources.workspace import table, tasks_for


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey || ':' || CAST(l_quantity AS INT) AS row FROM lineitem),
r AS (SELECT l_orderkey, repetition, l_linenumber, row || CASE WHEN repetition = 2 AND l_orderkey % 3 = 0 AND l_linenumber = l_orderkey % 5 + 1 THEN '!' ELSE '' END AS row FROM o, (SELECT unnest(range(3)) AS repetition)),
s AS (SELECT l_orderkey, repetition, string_agg(row, chr(10) ORDER BY l_linenumber, row) AS out FROM r GROUP BY ALL) SELECT l_orderkey, count(*) AS repetitions, count(DISTINCT out) = 1 AS identical FROM s GROUP BY l_orderkey""")
def identical_repetitions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all repetitions of an order's rows gave one output, place by place; the third of every third order is changed in one row, where it has that row."""
    lines = table(spark, sf, "lineitem")
    dealt = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("quantity")).repartition(tasks_for(lines, F.lit(1), 1 << 19), "l_orderkey")
    rows = dealt.select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_partkey", "quantity").alias("row"), F.explode(F.array(*map(F.lit, range(3)))).alias("repetition"))
    changed = (F.col("repetition") == 2) & (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == F.col("l_orderkey") % 5 + 1)
    rows = rows.withColumn("row", F.when(changed, F.concat("row", F.lit("!"))).otherwise(F.col("row")))
    return A.repetitions(rows, ["l_orderkey"], "repetition", ["l_linenumber", "row"])


@query("""WITH r AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS most FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_filter([CASE WHEN o_custkey % 7 = 0 THEN 'n' END, CASE WHEN o_custkey % 10 = 0 THEN 'total' END, CASE WHEN o_custkey % 15 = 0 THEN 'most' END], lambda x: x IS NOT NULL) AS problems FROM r WHERE o_custkey % 7 = 0 OR o_custkey % 10 = 0 OR o_custkey % 15 = 0""")
def reports_recomputed(spark: SparkSession, sf: str) -> DataFrame:
    """A report's counts, sums and maxima against the rows they are of; every seventh, tenth and fifteenth customer's report is wrong."""
    facts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"))
    key = F.col("o_custkey")
    report = facts.select("o_custkey", (F.col("n") + (key % 7 == 0).cast("int")).alias("said_n"), (F.col("total") * F.when(key % 10 == 0, 1.001).otherwise(1.0)).alias("said_total"), F.when(key % 15 == 0, F.col("most") + 1).otherwise(F.col("most")).alias("said_most"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.abs(F.col(b))
    marks = {"n": F.col("said_n") != F.col("n"), "total": ~near("said_total", "total"), "most": ~near("said_most", "most")}
    return report.join(facts, "o_custkey").select("o_custkey", A.kept_names(marks).alias("problems")).where("size(problems) > 0")


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size % 4 = 0 THEN 'type' END, 'colour'], lambda x: x IS NOT NULL) AS missing, list_filter([CASE WHEN p_brand <> 'Brand#13' THEN 'brand' END, CASE WHEN p_size % 4 <> 0 AND p_type <> 'PROMO' THEN 'type' END], lambda x: x IS NOT NULL) AS differing FROM part""")
def settings_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Settings that a contract wants and that are missing or differ."""
    settings = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")))
    found = table(spark, sf, "part").select("p_partkey", A.unmet(settings, {"brand": "Brand#13", "type": "PROMO", "colour": "red"}).alias("c"))
    return found.select("p_partkey", "c.missing", "c.differing")


@query("""WITH f AS (SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'reviewed-' || page_id % 7 WHEN contains(url, '/es/') THEN 'es-pages' WHEN regexp_matches(html, '<title>[A-D]') THEN 'early-titles' ELSE lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) END AS family, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]utm_source=([a-z]+)', 1), '') AS feed FROM pages)
SELECT DISTINCT page_id, unnest(list_filter(['family:' || family, 'host:' || host, 'feed:' || feed], lambda x: x IS NOT NULL)) AS key FROM f""")
def family_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A page's keys: its family by an override, a part of its address, its text or its host; its host; its feed."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    reviewed = pages.where("page_id % 50 = 0").select("page_id", F.concat(F.lit("reviewed-"), F.col("page_id") % 7).alias("family"))
    host = url_family(F.col("url"))
    rules = [(F.col("url").contains("/es/"), F.lit("es-pages")), (F.col("html").rlike("<title>[A-D]"), F.lit("early-titles"))]
    found = A.families(pages, "page_id", reviewed, rules, host)
    feed = F.nullif(F.regexp_extract("url", "[?&]utm_source=([a-z]+)", 1), F.lit(""))
    keys = F.array_compact(F.array(F.concat(F.lit("family:"), "family"), F.concat(F.lit("host:"), host), F.concat(F.lit("feed:"), feed)))
    return found.select("page_id", F.explode(F.array_distinct(keys)).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_partkey % 17 = 0 THEN 'repeated' ELSE 'other content' END AS problem FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 17 = 0 OR p_partkey % 5 = 0
UNION ALL SELECT -1 - p_partkey, 'unexpected' FROM part WHERE p_partkey % 13 = 0""")
def one_to_one_match(spark: SparkSession, sf: str) -> DataFrame:
    """Records against predictions that lack some, repeat some, change some and add others."""
    part = table(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("\0", "p_name", F.col("p_size").cast("string")), 256).alias("digest"))
    key = F.col("p_partkey")
    changed = part.where(key % 9 != 0).withColumn("digest", F.when(key % 5 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    predicted = changed.unionByName(changed.where(key % 17 == 0)).unionByName(part.where(key % 13 == 0).withColumn("p_partkey", -1 - key))
    return A.matched(part, predicted, "p_partkey", "digest")


@query("SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 33 = 0")
def rows_without_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Selected rows that no row of the parent table equals."""
    parent = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    chosen = parent.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 11 == 0).cast("int"))
    return chosen.exceptAll(parent)


@query("""SELECT l_partkey, sum(l_quantity) FILTER (l_linenumber = 1) AS one, sum(l_quantity) FILTER (l_linenumber = 2) AS two, sum(l_quantity) FILTER (l_linenumber = 3) AS three FROM lineitem GROUP BY l_partkey HAVING one IS NOT NULL AND two IS NOT NULL AND three IS NOT NULL""")
def complete_over_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that were run at every size, a column for each."""
    return A.side_by_side(table(spark, sf, "lineitem"), ["l_partkey"], F.col("l_linenumber"), {"one": 1, "two": 2, "three": 3}, F.col("l_quantity")).dropna()


@query("""WITH f AS (SELECT p_partkey, unnest([768, 1024, 1536]) AS size FROM part), t AS (SELECT p_partkey, size, (p_partkey * 31 + size) % 11 AS token FROM f), r AS (SELECT p_partkey, CASE WHEN p_size > 35 THEN 768 WHEN p_size > 15 THEN 1024 ELSE 1536 END AS size, p_size FROM part)
SELECT r.p_partkey, r.size, (r.p_partkey * 31 + r.size + CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END) % 11 = token AS same FROM r JOIN t ON r.p_partkey = t.p_partkey AND r.size = t.size""")
def routed_against_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A routed run against the fixed run of the size that each page was routed to."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    fixed = part.select("p_partkey", F.explode(F.array(*map(F.lit, (768, 1024, 1536)))).alias("size")).withColumn("token", (key * 31 + F.col("size")) % 11)
    size = F.when(F.col("p_size") > 35, 768).when(F.col("p_size") > 15, 1024).otherwise(1536)
    routed = part.select("p_partkey", size.alias("size"), ((key * 31 + size + (F.col("p_size") % 6 == 0).cast("int")) % 11).alias("said"))
    return routed.join(fixed, ["p_partkey", "size"]).select("p_partkey", "size", (F.col("said") == F.col("token")).alias("same"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS batch, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
SELECT o_orderpriority AS profile, batch, count(*) AS jobs, count(c_custkey) AS receipts, sum(n)::BIGINT AS n, round(avg(total), 4) AS mean, round(max(total), 4) AS most FROM orders LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY ALL""")
def jobs_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Planned jobs with their reports and receipts, by profile and batch; a job without a report has no batch."""
    report = table(spark, sf, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("batch")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    receipt = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("receipt"))
    jobs = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("profile")).join(report, "o_orderkey", "left").join(receipt, "o_custkey", "left")
    return jobs.groupBy("profile", "batch").agg(F.count("*").alias("jobs"), F.count("receipt").alias("receipts"), F.sum("n").alias("n"), F.round(F.avg("total"), 4).alias("mean"), F.round(F.max("total"), 4).alias("most"))


@query("""WITH r AS (SELECT p_type AS operator, p_partkey % 2 AS round, max(p_size) AS shape, avg(p_retailprice) AS ms FROM part GROUP BY ALL) SELECT a.operator, a.shape = b.shape AS same_shape, round(a.ms / b.ms, 8) AS speedup FROM r a JOIN r b ON a.operator = b.operator AND a.round = 0 AND b.round = 1""")
def rounds_by_operator(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of each operator: whether shapes agree, and the speedup."""
    rows, even = table(spark, sf, "part"), F.col("p_partkey") % 2 == 0
    pick = lambda f, column, which: f(F.when(which, F.col(column)))
    sides = rows.groupBy(F.col("p_type").alias("operator")).agg(pick(F.max, "p_size", even).alias("s0"), pick(F.max, "p_size", ~even).alias("s1"), pick(F.avg, "p_retailprice", even).alias("m0"), pick(F.avg, "p_retailprice", ~even).alias("m1"))
    return sides.dropna().select("operator", (F.col("s0") == F.col("s1")).alias("same_shape"), F.round(F.col("m0") / F.col("m1"), 8).alias("speedup"))


@query("""WITH n AS (SELECT DISTINCT 'decode.' || c_nationkey || '.' || c_mktsegment AS name, CASE WHEN c_nationkey < 3 THEN 'decode.*.' || c_mktsegment ELSE 'decode.' || c_nationkey || '.' || c_mktsegment END AS key FROM customer)
SELECT key, count(*) AS names, count(*) > 1 AS ambiguous FROM n GROUP BY key""")
def ambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised names, and whether more than one name has become the same."""
    name = F.concat_ws(".", F.lit("decode"), "c_nationkey", "c_mktsegment")
    key = F.when(F.col("c_nationkey") < 3, S.stage_name(name)).otherwise(name)
    return table(spark, sf, "customer").groupBy(key.alias("key")).agg(F.countDistinct(name).alias("names")).withColumn("ambiguous", F.col("names") > 1)


@query("""WITH r AS (SELECT o_orderpriority AS component, o_custkey AS page, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS one, sum(o_totalprice) FILTER (o_orderkey % 2 = 1) AS two FROM orders GROUP BY ALL)
SELECT component, page, CASE WHEN one IS NULL THEN 'only two' WHEN two IS NULL THEN 'only one' ELSE 'both' END AS present, round(two - one, 4) AS delta FROM r""")
def component_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Two audited runs by component and page, with what only one of them has."""
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_orderpriority": "component", "o_custkey": "page"})
    both = A.side_by_side(rows, ["component", "page"], F.col("o_orderkey") % 2, {"one": 0, "two": 1}, F.col("o_totalprice"))
    present = F.when(F.col("one").isNull(), "only two").when(F.col("two").isNull(), "only one").otherwise("both")
    return both.select("component", "page", present.alias("present"), F.round(F.col("two") - F.col("one"), 4).alias("delta"))


@query("""WITH c AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM c) ORDER BY sum(n) DESC, l_linenumber LIMIT 1)
SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 6) AS mean FROM lineitem JOIN b USING (l_linenumber) GROUP BY ALL""")
def shared_stratum(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates compared in the largest stratum that all of them were measured in."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    return A.shared_stratum(rows, "l_returnflag", "l_linenumber").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 6).alias("mean"))


@query("""WITH e AS (SELECT unnest([{'k': 'ECONOMY', 'wanted': 40}, {'k': 'PROMO', 'wanted': 40}, {'k': 'UNSEEN', 'wanted': 0}, {'k': 'ABSENT', 'wanted': 3}], recursive := true)), g AS (SELECT p_type AS k, count(*) AS n, bool_and(p_size > 0) AS fine FROM part GROUP BY 1)
SELECT k, wanted, coalesce(n, 0) AS n, coalesce(n, 0) = wanted AND coalesce(fine, true) AS passes FROM e LEFT JOIN g USING (k)""")
def expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Categories against the exact counts that a gate expects, those without rows too."""
    wanted = spark.createDataFrame([("ECONOMY", 40), ("PROMO", 40), ("UNSEEN", 0), ("ABSENT", 3)], "k string, wanted int")
    found = table(spark, sf, "part").groupBy(F.col("p_type").alias("k")).agg(F.count("*").alias("n"), F.bool_and(F.col("p_size") > 0).alias("fine"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(found, "k", "left").select("k", "wanted", n.alias("n"), ((n == F.col("wanted")) & F.coalesce("fine", F.lit(True))).alias("passes"))


@query("SELECT 'decode.*.' || p_type AS stage, max(p_retailprice) AS most, count(DISTINCT p_size) AS layers FROM part GROUP BY 1")
def stage_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value of each stage over its layers."""
    stage = S.stage_name(F.concat(F.lit("decode."), "p_size", F.lit("."), "p_type"))
    return table(spark, sf, "part").groupBy(stage.alias("stage")).agg(F.max("p_retailprice").alias("most"), F.countDistinct("p_size").alias("layers"))


@query("SELECT p_brand, p_partkey, p_retailprice AS saved FROM part WHERE p_size <= 30 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def best_allowed_point(spark: SparkSession, sf: str) -> DataFrame:
    """The point of each curve that saves most within a limit; ties go to the first."""
    best = F.max_by(F.struct("p_partkey", F.col("p_retailprice").alias("saved")), F.struct("p_retailprice", -F.col("p_partkey")))
    return table(spark, sf, "part").where("p_size <= 30").groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_partkey", "b.saved")


@query("WITH t AS (SELECT unnest([0.015, 0.045, 0.085]::DOUBLE[]) AS tolerance) SELECT l_returnflag, l_linenumber AS size, tolerance, round(avg((l_discount <= tolerance)::INT), 8) AS share, count(*) AS n FROM lineitem, t GROUP BY ALL")
def tolerance_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of rows within each tolerance, by group and size, in one pass."""
    tolerances = [0.015, 0.045, 0.085]
    shares = F.array(*(F.struct(F.lit(t).alias("tolerance"), F.round(F.avg((F.col("l_discount") <= t).cast("int")), 8).alias("share")) for t in tolerances))
    groups = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("size")).agg(F.count("*").alias("n"), shares.alias("shares"))
    return groups.select("l_returnflag", "size", "n", F.inline("shares"))


@query("""WITH x AS (SELECT p_type, p_retailprice AS chars, unnest([{'policy': 'full', 'err': p_size * 0.001, 'ms': 10.0}, {'policy': 'routed', 'err': CASE WHEN p_size > 25 THEN 0.06 ELSE p_size * 0.001 END, 'ms': CASE WHEN p_size > 25 THEN 4.0 ELSE 10.0 END}, {'policy': 'small', 'err': 0.06, 'ms': 4.0}]) AS p FROM part)
SELECT p.policy AS policy, p_type AS category, count(*) AS n, round((sum(p.err * chars) / sum(chars))::DOUBLE, 8) AS weighted, round(1 - sum(p.ms)::DOUBLE / (10 * count(*)), 8) AS saved FROM x GROUP BY GROUPING SETS ((policy, category), (policy))""")
def policies_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Error weighted by characters and time saved, by policy and category and over all categories."""
    small, exact = F.col("p_size") > 25, F.col("p_size") * 0.001
    point = lambda name, err, ms: F.struct(F.lit(name).alias("policy"), err.alias("err"), ms.alias("ms"))
    points = F.array(point("full", exact, F.lit(10.0)), point("routed", F.when(small, 0.06).otherwise(exact), F.when(small, 4.0).otherwise(10.0)), point("small", F.lit(0.06), F.lit(4.0)))
    rows = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_retailprice").alias("chars"), F.inline(points))
    sets = rows.groupingSets([["policy", "category"], ["policy"]], "policy", "category")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum(F.col("err") * F.col("chars")) / F.sum("chars"), 8).alias("weighted"), F.round(1 - F.sum("ms") / (10 * F.count("*")), 8).alias("saved"))


@query("""WITH x AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), r AS (SELECT label, vec_id, round(sqrt(list_sum(list_transform(e, lambda v: pow(v - round_even(v * 16, 0) / 16, 2))) / list_sum(list_transform(e, lambda v: v * v))), 9) AS error FROM x)
SELECT label, vec_id, error FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY error DESC, vec_id) <= 5""")
def worst_coded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The five rows of each tensor that lose most when they are coded in sixteenths; a task keeps five before it shuffles."""
    e = V.doubles(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select("label", "vec_id", e.alias("e")).withColumn("d", F.transform("e", lambda v: v - F.rint(v * 16) / 16))
    errors = rows.select("label", "vec_id", F.round(F.sqrt(V.dot(F.col("d"), F.col("d")) / V.dot(F.col("e"), F.col("e"))), 9).alias("error"))
    return errors.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("error"), "vec_id"))).where("nth <= 5").drop("nth")


@query("""WITH g AS (SELECT low, high FROM (SELECT unnest([10, 20]) AS low), (SELECT unnest([30, 40]) AS high)) SELECT low, high, round(avg(CASE WHEN p_size >= high THEN 1.0 WHEN p_size >= low THEN 3.0 ELSE 6.0 END::DOUBLE), 8) AS cost, round(avg((CASE WHEN p_size >= high THEN p_partkey % 10 < 8 WHEN p_size >= low THEN p_partkey % 10 < 9 ELSE true END)::INT), 8) AS quality FROM part, g GROUP BY ALL""")
def cascade_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cost and quality of two-stage cascades over a grid of both thresholds."""
    size, luck = F.col("p_size"), F.col("p_partkey") % 10
    grid = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low in (10, 20) for high in (30, 40)))
    rows = table(spark, sf, "part").select("p_size", "p_partkey", F.inline(grid))
    cost = F.when(size >= F.col("high"), 1.0).when(size >= F.col("low"), 3.0).otherwise(6.0)
    fine = F.when(size >= F.col("high"), luck < 8).when(size >= F.col("low"), luck < 9).otherwise(True)
    return rows.groupBy("low", "high").agg(F.round(F.avg(cost), 8).alias("cost"), F.round(F.avg(fine.cast("int")), 8).alias("quality"))


@query("""WITH k AS (SELECT o_orderkey, unnest(CASE WHEN o_custkey % 3 = 0 THEN ['a', 'b'] WHEN o_custkey % 3 = 1 THEN ['a'] ELSE ['c'] END) AS run FROM orders), s AS (SELECT l_orderkey, l_linenumber, (l_quantity % 5)::INT AS score FROM lineitem), j AS (SELECT run, score FROM k JOIN s ON l_orderkey = o_orderkey),
m AS (SELECT run, score, count(*) AS n FROM j GROUP BY ALL), o AS (SELECT run, o_orderkey, max(score) - min(score) AS apart FROM k JOIN s ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) > 1)
SELECT run, n, mean, common, apart FROM (SELECT run, sum(n)::BIGINT AS n, round(sum(n * score) / sum(n), 8) AS mean, arg_max(score, n * 10 - score) AS common FROM m GROUP BY run) JOIN (SELECT run, round(avg(apart), 8) AS apart FROM o GROUP BY run) USING (run)""")
def unblinded_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of blinded outputs given back to their runs: mean, commonest score, and how far repeats of an output lie apart."""
    third = F.col("o_custkey") % 3
    runs = F.when(third == 0, F.array(F.lit("a"), F.lit("b"))).when(third == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("c")))
    keys = table(spark, sf, "orders").select("o_orderkey", F.explode(runs).alias("run"))
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") % 5).cast("int").alias("score")).agg(F.count("*").alias("n"))
    joined = keys.join(scores, "o_orderkey")
    outputs = joined.groupBy("run", "o_orderkey").agg(F.sum("n").alias("n"), (F.max("score") - F.min("score")).alias("apart"))
    apart = outputs.where("n > 1").groupBy("run").agg(F.round(F.avg("apart"), 8).alias("apart"))
    counts = joined.groupBy("run", "score").agg(F.sum("n").alias("n"))
    means = counts.groupBy("run").agg(F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 8).alias("mean"), F.max_by("score", F.struct("n", -F.col("score"))).alias("common"), F.sum("n").alias("total"))
    return means.join(apart, "run").select("run", F.col("total").alias("n"), "mean", "common", "apart")


@query("SELECT p_brand, statistic, round(value, 6) AS value FROM (SELECT p_brand, avg(p_retailprice) AS mean_price, max(p_retailprice) AS most_price, avg(p_size) AS mean_size, max(p_size)::DOUBLE AS most_size FROM part GROUP BY p_brand) UNPIVOT (value FOR statistic IN (mean_price, most_price, mean_size, most_size))")
def flat_report(spark: SparkSession, sf: str) -> DataFrame:
    """A nested summary as one row per figure."""
    summary = table(spark, sf, "part").groupBy("p_brand").agg(*(f(c).cast("double").alias(f"{name}_{short}") for name, f in (("mean", F.avg), ("most", F.max)) for short, c in (("price", "p_retailprice"), ("size", "p_size"))))
    return summary.unpivot("p_brand", [c for c in summary.columns if c != "p_brand"], "statistic", "value").withColumn("value", F.round("value", 6))
