"""Queries over run records: sources, resume, sinks, constraints, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import audits as A
from folioflow.operators import measures
from folioflow.plans.registry import query
from folioflow.sources import files, records
from folioflow.sources.workspace import table

_LINES = """
l AS (SELECT event_id, 'f/' || user_id AS path, (event_id % 7)::INT AS page, event_type AS mode, value, event_id % 40 AS k FROM events),
r AS (SELECT *, CASE WHEN k = 1 THEN 'damaged' WHEN k = 2 THEN 'cut' WHEN k = 3 THEN 'foreign' WHEN k = 4 THEN 'blank' WHEN k = 5 THEN 'error' ELSE 'record' END AS kind FROM l)"""


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a folder of JSON lines, some of them damaged, cut, foreign, blank or errors; read back by the tolerant source."""
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("f/"), "user_id").alias("path"), (F.col("event_id") % 7).cast("int").alias("page"), F.col("event_type").alias("text"), "value", (F.col("event_id") % 40).alias("k"))
    line = records.record_line(["text", "value"], F.when(F.col("k") == 5, "no image"), F.struct(F.col("text").alias("mode")))
    written = F.when(F.col("k") == 1, F.concat(line, F.lit("\0\0"))).when(F.col("k") == 2, F.expr("'{\"path\":\"f/'")).when(F.col("k") == 3, "plain words").when(F.col("k") == 4, " ").otherwise(line)
    path = records.scratch(spark, "records")
    rows.select(written.alias("value")).write.text(path)
    return records.scan(spark, path)


@query(f"WITH {_LINES} SELECT kind, count(*) AS n FROM r GROUP BY kind")
def jsonl_tolerant_scan(spark: SparkSession, sf: str) -> DataFrame:
    return event_records(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES}, i AS (SELECT DISTINCT path, p::INT AS page FROM l, (SELECT unnest(range(0, 9)) AS p)) SELECT path, page FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = 'record' AND r.path = i.path AND r.page = i.page)")
def jsonl_resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.concat(F.lit("f/"), "user_id").alias("path")).distinct()
    inputs = users.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return records.pending(inputs, event_records(spark, sf))


@query(f"WITH {_LINES} SELECT mode AS options_mode, count(*) AS n, mode = 'click' AS current FROM r WHERE kind = 'record' GROUP BY mode")
def jsonl_counts_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return records.by_run(event_records(spark, sf), ["options.mode"], {"options_mode": "click"})


@query(f"""WITH {_LINES}, i AS (SELECT DISTINCT path, p::INT AS page FROM l, (SELECT unnest(range(0, 9)) AS p)),
b AS (SELECT path, page, max((kind = 'record')::INT) AS ok FROM r WHERE kind IN ('record', 'error') GROUP BY ALL)
SELECT CASE ok WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'not_run' END AS status, count(*) AS n FROM i LEFT JOIN b USING (path, page) GROUP BY 1""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.concat(F.lit("f/"), "user_id").alias("path")).distinct()
    return records.summary(users.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(8)))), event_records(spark, sf))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN '{"path":"' || p_type || '","page":' || p_size || ',"error":"too large"}'
ELSE '{"path":"' || p_type || '","page":' || p_size || ',"p_brand":"' || p_brand || '"}' END AS line FROM part""")
def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnsRenamed({"p_type": "path", "p_size": "page"})
    return part.select("p_partkey", records.record_line(["p_brand"], F.when(F.col("page") > 45, "too large")).alias("line"))


@query("""WITH l AS (SELECT conv_id, string_split(regexp_replace(string_agg(text, chr(10) ORDER BY turn, role, text), '\\r\\n', chr(10), 'g'), chr(10)) AS x FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, generate_subscripts(x, 1) - 1 AS place, trim(unnest(x)) AS entry FROM l) SELECT conv_id, place::INT AS place, entry FROM e WHERE entry <> '' AND entry NOT LIKE '#%'""")
def input_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"]), "\n").alias("text"))
    return lists.select("conv_id", F.explode(files.listed(F.col("text"))).alias("r")).select("conv_id", "r.place", "r.entry")


@query("""WITH s AS (SELECT p_partkey, p_size + 3 AS pages FROM part) SELECT p_partkey, list_sort(list_distinct(list_concat(list_concat([1, 2, 3], [least(pages, 4)]), range(pages - 1, pages + 1))))::INT[] AS numbers FROM s WHERE p_partkey % 5 <> 0""")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.col("p_size") + 3
    spec = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("1-"), pages + 1)).otherwise(F.concat(F.lit("1-3, "), F.least(pages, F.lit(4)), F.lit(","), pages - 1, F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", files.page_numbers(spec, pages).alias("numbers")).where("numbers is not null")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 15")
def capped_per_folder(spark: SparkSession, sf: str) -> DataFrame:
    return files.capped(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), F.col("source"), 15, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source")


@query("SELECT p_brand AS profile, p_size % 4 AS batch, m AS mode, sha256('{\"batch\":' || (p_size % 4) || ',\"mode\":\"' || m || '\",\"profile\":\"' || p_brand || '\"}') AS job_id FROM part, (SELECT unnest(['exact', 'fast']) AS m) GROUP BY ALL")
def job_plan(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "part").select(F.col("p_brand").alias("profile"), (F.col("p_size") % 4).alias("batch")).distinct()
    return records.job_plan(jobs.withColumn("mode", F.explode(F.array(F.lit("exact"), F.lit("fast")))))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), x AS (SELECT doc_id AS conv_id FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(c.conv_id, x.conv_id) AS conv_id, CASE WHEN n IS NULL THEN 'missing' WHEN x.conv_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM c FULL JOIN x USING (conv_id) WHERE n IS NULL OR x.conv_id IS NULL OR n > 1""")
def exact_once_completeness(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("conv_id"))
    return records.complete(table(spark, sf, "conversations"), expected, "conv_id")


@query("SELECT 'written' AS first, 'identical' AS again, count(*) AS n FROM supplier")
def freeze_or_identical(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "supplier"), records.scratch(spark, "frozen")
    first, again = records.freeze(rows, path), records.freeze(rows.repartition(3), path)
    return spark.read.parquet(path).agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.count("*").alias("n"))


# ---- comparisons -----------------------------------------------------------------------------------------------------

_RUNS = """
a AS (SELECT o_custkey % 50 AS page, o_orderkey AS step, o_custkey % 3 + o_orderkey % 11 AS token, o_totalprice AS ms FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_custkey % 50 AS page, o_orderkey AS step, o_custkey % 3 + o_orderkey % 11 + CASE WHEN o_orderkey % 101 = 7 THEN 1 ELSE 0 END AS token, o_totalprice * 0.9 AS ms FROM orders WHERE o_orderkey % 17 <> 0)"""


def two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same pages and steps, each with gaps and a few changed tokens."""
    base = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("page"), F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 3 + F.col("o_orderkey") % 11).alias("token"), F.col("o_totalprice").alias("ms"))
    changed = base.withColumn("token", F.col("token") + (F.col("step") % 101 == 7).cast("int")).withColumn("ms", F.col("ms") * 0.9)
    return base.where("step % 13 <> 0"), changed.where("step % 17 <> 0")


@query(f"""WITH {_RUNS}, j AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.step, b.step) AS step, a.step IS NULL AS no_a, b.step IS NULL AS no_b, a.token = b.token AS same FROM a FULL JOIN b ON a.page = b.page AND a.step = b.step)
SELECT page, count(*) AS steps, count(*) FILTER (no_a) AS only_right, count(*) FILTER (no_b) AS only_left, count(*) FILTER (same IS FALSE) AS flips, min(step) FILTER (no_a OR no_b OR NOT same) AS first_difference FROM j GROUP BY page""")
def run_outer_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both runs' steps side by side: missing on either side, changed tokens and the first difference of each page."""
    a, b = two_runs(spark, sf)
    both = a.select("page", "step", F.col("token").alias("one")).join(b.select("page", "step", F.col("token").alias("two")), ["page", "step"], "full")
    differs = F.col("one").isNull() | F.col("two").isNull() | (F.col("one") != F.col("two"))
    return both.groupBy("page").agg(F.count("*").alias("steps"), F.count_if(F.col("one").isNull()).alias("only_right"), F.count_if(F.col("two").isNull()).alias("only_left"), F.count_if(F.col("one") != F.col("two")).alias("flips"), F.min(F.when(differs, F.col("step"))).alias("first_difference"))


@query(f"""WITH {_RUNS}, m AS (SELECT page, median(a.ms) AS one, median(b.ms) AS two, count(*) AS n FROM a JOIN b USING (page, step) GROUP BY page)
SELECT page, n, round(one, 4) AS one, round(two, 4) AS two, round(1 - two / one, 6) AS saved FROM m""")
def run_medians_by_page(spark: SparkSession, sf: str) -> DataFrame:
    a, b = two_runs(spark, sf)
    both = a.select("page", "step", F.col("ms").alias("x")).join(b.select("page", "step", F.col("ms").alias("y")), ["page", "step"])
    median = lambda c, name: measures.quantiles(both, ["page"], c, **{name: 0.5}).select("page", name)
    m = both.groupBy("page").agg(F.count("*").alias("n")).join(median("x", "one"), "page", "left").join(median("y", "two"), "page", "left")
    return m.select("page", "n", F.round("one", 4).alias("one"), F.round("two", 4).alias("two"), F.round(1 - F.col("two") / F.col("one"), 6).alias("saved"))


@query(f"""WITH {_RUNS}, s AS (SELECT page, sha256(string_agg(step || ':' || coalesce(token::VARCHAR, ''), ',' ORDER BY step)) AS sig, count(*) AS n FROM a GROUP BY page), t AS (SELECT page, sha256(string_agg(step || ':' || coalesce(token::VARCHAR, ''), ',' ORDER BY step)) AS sig, count(*) AS n FROM b GROUP BY page)
SELECT s.page, s.sig = t.sig AS same_tokens, s.n = t.n AS same_length, s.sig = t.sig AND s.n = t.n AS exact FROM s JOIN t USING (page)""")
def output_equality_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Equality of two runs' outputs, by a signature of the placed tokens that sums in any order."""
    return A.same_outputs(*two_runs(spark, sf), ["page"], ["step", "token"])


@query("""WITH p AS (SELECT o_orderpriority AS page, o_orderstatus AS run, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT page, max(n) FILTER (run = 'F') AS f_n, max(n) FILTER (run = 'O') AS o_n, max(n) FILTER (run = 'P') AS p_n, max(total) FILTER (run = 'F') AS f_total, max(total) FILTER (run = 'O') AS o_total, max(total) FILTER (run = 'P') AS p_total FROM p GROUP BY page""")
def runs_pivoted(spark: SparkSession, sf: str) -> DataFrame:
    """Named runs side by side per page."""
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("page")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return wide.select("page", *(F.col(f"{k}_{c}").alias(f"{k.lower()}_{c}") for c in ("n", "total") for k in "FOP"))


@query("""WITH b AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT r.o_orderpriority, r.o_orderstatus, round(r.m / b.m - 1, 6) AS change FROM b r JOIN b ON b.o_orderpriority = r.o_orderpriority AND b.o_orderstatus = 'F'""")
def runs_against_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of a page against the page's baseline run."""
    m = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    base = m.where("o_orderstatus = 'F'").select("o_orderpriority", F.col("m").alias("base"))
    return m.join(base, "o_orderpriority").select("o_orderpriority", "o_orderstatus", F.round(F.col("m") / F.col("base") - 1, 6).alias("change"))


@query("""SELECT c_custkey, n_name, r_name, c_acctbal >= 0 AS solvent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def locked_references(spark: SparkSession, sf: str) -> DataFrame:
    """Three-way lookup: rows, their lock and their reference."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", (F.col("c_acctbal") >= 0).alias("solvent"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(n = d AND n = top, false) AS whole FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def steps_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and their steps: each step once, from the first to the last."""
    steps = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("top"))
    return table(spark, sf, "orders").select("o_orderkey").join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("n") == F.col("d")) & (F.col("n") == F.col("top")), F.lit(False)).alias("whole"))


_CHECKS = {
    "linenumber_positive": "l_linenumber >= 1",
    "quantity_range": "l_quantity between 1 and 50",
    "discount_range": "l_discount between 0 and 1",
    "finite_price": "not isnan(l_extendedprice) and abs(l_extendedprice) < 1e12",
    "known_flag": "l_returnflag in ('A', 'N', 'R')",
    "known_status": "l_linestatus in ('O', 'F')",
    "open_not_returned": "not (l_linestatus = 'O' and l_returnflag <> 'N')",
    "ship_before_receipt": "l_shipdate is not null",
    "price_per_unit": "l_extendedprice / l_quantity >= 900",
    "tax_range": "l_tax between 0 and 0.08",
}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, false)) AS broken FROM lineitem" for k, v in _CHECKS.items()) + ")")
def result_contract(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows break each rule of a result: types, ranges, finite values, dependent fields. One pass for all rules."""
    counted = table(spark, sf, "lineitem").agg(*(F.count_if(~F.coalesce(F.expr(v), F.lit(False))).alias(k) for k, v in _CHECKS.items()))
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, _CHECKS)), F.array(*_CHECKS))).alias("rule", "broken"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 5 THEN 'incomplete' WHEN failed > done THEN 'failed' WHEN done = n THEN 'exact' WHEN done > 0 THEN 'partial' ELSE 'unproven' END AS status FROM s""")
def outcome_status(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered decision table over counts."""
    at = lambda kind: F.count_if(F.col("event_type") == kind)
    s = table(spark, sf, "events").groupBy("user_id").agg(at("purchase").alias("done"), at("error").alias("failed"), F.count("*").alias("n"))
    status = F.when(F.col("n") < 5, "incomplete").when(F.col("failed") > F.col("done"), "failed").when(F.col("done") == F.col("n"), "exact").when(F.col("done") > 0, "partial").otherwise("unproven")
    return s.select("user_id", status.alias("status"))


@query("""WITH o AS (SELECT event_type, user_id % 9 AS arm, value, row_number() OVER (PARTITION BY event_type, user_id % 9 ORDER BY ts, event_id) AS rn FROM events)
SELECT event_type, arm, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM o WHERE rn > 4 GROUP BY ALL""")
def without_warmups(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each arm without its first four samples."""
    arm = (F.col("user_id") % 9).alias("arm")
    rows = table(spark, sf, "events").select("event_type", arm, "value", "ts", "event_id")
    head = Window.partitionBy("event_type", "arm").orderBy("ts", "event_id")
    warm = rows.withColumn("rn", F.row_number().over(head)).where("rn <= 4").select("event_id")  # four rows an arm, cut in each task
    later = rows.join(warm, "event_id", "left_anti")
    return later.groupBy("event_type", "arm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))


@query("""WITH c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), q AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
b AS (SELECT q.event_id, arg_max(c.value, (c.ts, c.event_id)) AS before FROM q JOIN c ON c.user_id = q.user_id AND (c.ts, c.event_id) < (q.ts, q.event_id) GROUP BY q.event_id),
a AS (SELECT q.event_id, arg_min(c.value, (c.ts, c.event_id)) AS after FROM q JOIN c ON c.user_id = q.user_id AND (c.ts, c.event_id) > (q.ts, q.event_id) GROUP BY q.event_id)
SELECT q.event_id, round(before, 6) AS before, round(after, 6) AS after FROM q LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)""")
def nearest_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Interleaved controls: the nearest one before and after each candidate, by two windows and no join."""
    rows = table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    control = F.when(F.col("event_type") == "click", F.col("value"))
    before = F.last(control, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(control, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.select("event_id", "event_type", F.round(before, 6).alias("before"), F.round(after, 6).alias("after")).where("event_type = 'purchase'").drop("event_type")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN '1-2' WHEN l_linenumber <= 4 THEN '3-4' ELSE '5+' END AS bucket, l_quantity FROM lineitem) SELECT bucket, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM s GROUP BY bucket""")
def step_buckets(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(F.when(step <= 2, "1-2").when(step <= 4, "3-4").otherwise("5+").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""WITH m AS (SELECT p_brand, p_size, avg(p_retailprice) AS d FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY d DESC, p_size) AS hi, row_number() OVER (PARTITION BY p_brand ORDER BY d, p_size) AS lo FROM m)
SELECT p_brand, p_size, CASE WHEN hi <= 2 THEN 'gain' ELSE 'loss' END AS side FROM r WHERE hi <= 2 OR lo <= 2""")
def gains_and_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest and the two smallest part types of each brand by mean price."""
    m = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("d"))
    hi = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("d"), "p_size"))
    lo = F.row_number().over(Window.partitionBy("p_brand").orderBy("d", "p_size"))
    return m.withColumn("hi", hi).withColumn("lo", lo).where("hi <= 2 or lo <= 2").select("p_brand", "p_size", F.when(F.col("hi") <= 2, "gain").otherwise("loss").alias("side"))
