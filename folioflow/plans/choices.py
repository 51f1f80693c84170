"""Queries that select, rank and set rows against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import sampling
from folioflow.operators import audits as A
from folioflow.operators import select
from folioflow.plans.registry import query
from folioflow.sources.workspace import table

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1))"


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), F.when(F.col("html").contains("<table"), "tables").when(F.length("html") > 2000, "long").otherwise("ordinary").alias("category"))


_P = f"p AS (SELECT page_id, {_HOST} AS host, CASE WHEN html LIKE '%<table%' THEN 'tables' WHEN length(html) > 2000 THEN 'long' ELSE 'ordinary' END AS category FROM pages)"


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE category WHEN 'tables' THEN 0 WHEN 'long' THEN 1 ELSE 2 END, sha256('s2' || chr(0) || page_id)) AS rn FROM p) SELECT page_id, host, category FROM r WHERE rn = 1")
def best_page_of_family(spark: SparkSession, sf: str) -> DataFrame:
    """One page per host: by category priority, then by seeded rank."""
    order = F.when(F.col("category") == "tables", 0).when(F.col("category") == "long", 1).otherwise(2)
    return sampling.best_of_family(hosts(spark, sf), "host", order, "s2", "page_id").drop("priority")


@query(f"""WITH {_P}, o AS (SELECT *, sha256('s3' || chr(0) || category || chr(0) || page_id) AS rank FROM p),
a AS (SELECT host, arg_min(page_id, (rank, page_id)) AS page_id, min(rank) AS rank, 'tables' AS category FROM o WHERE category = 'tables' GROUP BY host ORDER BY rank LIMIT 5),
b AS (SELECT host, arg_min(page_id, (rank, page_id)) AS page_id, min(rank) AS rank, 'long' AS category FROM o WHERE category = 'long' AND host NOT IN (SELECT host FROM a) GROUP BY host ORDER BY rank LIMIT 5),
c AS (SELECT host, arg_min(page_id, (rank, page_id)) AS page_id, min(rank) AS rank, 'ordinary' AS category FROM o WHERE category = 'ordinary' AND host NOT IN (SELECT host FROM a UNION ALL SELECT host FROM b) GROUP BY host ORDER BY rank LIMIT 5)
SELECT host, page_id, category FROM a UNION ALL SELECT host, page_id, category FROM b UNION ALL SELECT host, page_id, category FROM c""")
def stratified_one_per_family(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.one_per_family(hosts(spark, sf), "host", "category", ["tables", "long", "ordinary"], 5, "s3", "page_id")


@query(f"""WITH {_P}, x AS (SELECT DISTINCT host FROM p WHERE page_id % 10 = 0), r AS (SELECT *, sha256('s4' || chr(0) || page_id) AS rank FROM p WHERE host NOT IN (SELECT host FROM x)),
c AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank) AS nth FROM r) SELECT page_id, host, category FROM c WHERE nth <= 2 ORDER BY rank LIMIT 40""")
def greedy_quota_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A quota of pages with two per host at most, none of a host that the other split uses."""
    rows = hosts(spark, sf)
    return sampling.filled(rows, "host", "page_id", 40, 2, "s4", rows.where("page_id % 10 = 0"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS turn FROM documents) SELECT doc_id, turn, row_number() OVER (PARTITION BY turn ORDER BY source) AS place FROM r WHERE turn <= 13""")
def round_robin_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sources take turns, thirteen documents each at most, in an interleaved order."""
    return sampling.interleaved(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", 13, F.col("n_chars"), F.col("doc_id")).select("doc_id", "turn", "place")


@query(f"""WITH {_P}, t AS (SELECT page_id, host FROM p WHERE category = 'tables' ORDER BY page_id LIMIT 10), u AS (SELECT page_id, host, 0 AS kind FROM t UNION ALL SELECT page_id, host, 1 FROM p WHERE page_id NOT IN (SELECT page_id FROM t)),
c AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY kind, page_id) AS nth FROM u) SELECT page_id, host FROM c WHERE nth <= 2 ORDER BY kind, page_id LIMIT 30""")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with tables first, up to a third; two of a host at most."""
    rows = hosts(spark, sf)
    return sampling.priority_union(rows.where("category = 'tables'").select("page_id", "host"), rows.select("page_id", "host"), "host", "page_id", 30, 3, 2)


@query("""WITH g AS (SELECT user_id % 5 AS page, event_type, list_sort(list_distinct(list(user_id))) AS names FROM events GROUP BY ALL) SELECT page, event_type, dense_rank() OVER (PARTITION BY page ORDER BY sha256('s5' || chr(0) || page || chr(0) || event_type))::INT AS letter, len(names) AS n FROM g""")
def blinded_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Equal outputs of a page under one letter, shuffled by a seed."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 5).alias("page"), "event_type", "user_id")
    return sampling.blinded(rows, ["page", "event_type"], "user_id", "s5").select("page", "event_type", "letter", "n")


@query()
def separated_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The four darkest tiles of a page that don't overlap."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "e"))
    return sampling.separated(rows.select("page", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.abs("e").alias("ink")), "page", "x", "y", "ink", 3, 4)


@query("SELECT event_id, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS leaves_at, sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) IS NOT NULL AS counted FROM events")
def ordered_emission(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.leaving(table(spark, sf, "events"), "event_id", "ts").withColumn("counted", F.lit(True))


@query("WITH d AS (SELECT DISTINCT host FROM (SELECT " + _HOST + " AS host, page_id FROM pages) WHERE page_id % 2 = 0), f AS (SELECT DISTINCT " + _HOST + " AS host FROM pages WHERE page_id % 3 = 0) SELECT host, CASE WHEN host IN (SELECT host FROM d) AND host IN (SELECT host FROM f) THEN 'both' WHEN host IN (SELECT host FROM d) THEN 'known' ELSE 'new' END AS side FROM (SELECT host FROM d UNION SELECT host FROM f)")
def exclusion_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Known and flagged families: their union, what is new, and the overlap that must be empty."""
    rows = hosts(spark, sf)
    known, flagged = rows.where("page_id % 2 = 0").select("host").distinct(), rows.where("page_id % 3 = 0").select("host").distinct()
    new = flagged.exceptAll(known.intersect(flagged)).withColumn("side", F.lit("new"))
    both = known.intersect(flagged).withColumn("side", F.lit("both"))
    return new.unionByName(both).unionByName(known.subtract(flagged).withColumn("side", F.lit("known")))


@query("WITH u AS (SELECT o_custkey FROM orders WHERE o_totalprice > 480000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM u)")
def unused_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that none of several manifests names."""
    used = table(spark, sf, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("k")).union(table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"))
    rows = table(spark, sf, "customer")
    return rows.join(used.distinct(), rows.c_custkey == F.col("k"), "left_anti").select("c_custkey", "c_mktsegment")


@query("WITH n AS (SELECT page_id, lower(unnest(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1))) AS name FROM pages), k AS (SELECT DISTINCT name FROM n WHERE page_id % 2 = 0) SELECT name, count(DISTINCT page_id) AS pages FROM n WHERE page_id % 2 = 1 AND name NOT IN (SELECT name FROM k) GROUP BY name")
def unresolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets that nothing holds, and how many pages have them."""
    names = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), 1)).alias("name")).withColumn("name", F.lower("name"))
    known = names.where("page_id % 2 = 0").select("name").distinct()
    return names.where("page_id % 2 = 1").join(known, "name", "left_anti").groupBy("name").agg(F.countDistinct("page_id").alias("pages"))


@query("SELECT l_returnflag, l_linestatus, l_quantity, n FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_returnflag, l_linestatus, l_quantity) AS rn FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity) WHERE rn <= 15")
def flagged_head(spark: SparkSession, sf: str) -> DataFrame:
    """Counts sorted by several keys, the first fifteen."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus", "l_quantity").limit(15)


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations), u AS (SELECT conv_id, max(rn) AS n FROM r GROUP BY conv_id),
w AS (SELECT j, count(*) FILTER (n >= j) / count(*) AS reach FROM u, (SELECT unnest(range(1, (SELECT max(n) FROM u) + 1)) AS j) GROUP BY j), c AS (SELECT j, (1 + sum(reach) OVER (ORDER BY j)) / (10 + 3 * j) AS gain FROM w) SELECT j, round(gain, 8) AS gain FROM c WHERE gain = (SELECT max(gain) FROM c)""")
def best_draft_length(spark: SparkSession, sf: str) -> DataFrame:
    """The survival curve to the longest run, and the length with most accepted rows for its cost."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    lengths = turns.groupBy("n").agg(F.count("*").alias("c"))  # one row per length
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    below = F.coalesce(F.lead("n").over(Window.orderBy(F.desc("n"))), F.lit(0))
    curve = lengths.withColumns({"reach": F.sum("c").over(upto) / whole, "below": below}).select(F.explode(F.sequence(F.col("below") + 1, F.col("n"))).alias("j"), "reach")
    gain = (1 + F.sum("reach").over(Window.orderBy("j"))) / (10 + 3 * F.col("j"))
    ranked = curve.withColumn("gain", gain)
    return ranked.orderBy(F.desc("gain"), "j").limit(1).select("j", F.round("gain", 8).alias("gain"))


@query("""WITH r AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 5 = 0 AND turn = 1 UNION ALL SELECT conv_id, turn + 1, role, text || '!' FROM conversations WHERE conv_id % 7 = 0 AND turn = 2)
SELECT conv_id, 'message' AS key, count(*) AS n FROM r GROUP BY conv_id, role, text HAVING count(*) > 1 UNION ALL SELECT conv_id, 'turn', count(*) FROM r GROUP BY conv_id, turn HAVING count(*) > 1""")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that must be unique and aren't: equal messages, equal turn numbers; some of either are put in."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    copies = rows.where("conv_id % 5 = 0 and turn = 1")
    moved = rows.where("conv_id % 7 = 0 and turn = 2").select("conv_id", (F.col("turn") + 1).alias("turn"), "role", F.concat("text", F.lit("!")).alias("text"))
    return A.repeated(rows.unionByName(copies).unionByName(moved), {"message": ["conv_id", "role", "text"], "turn": ["conv_id", "turn"]}, "conv_id")


@query("""SELECT category, count(*) AS n FROM (SELECT coalesce(CASE WHEN lang <> 'en' THEN lang END, CASE WHEN length(text) >= 100 THEN 'other' END) AS category FROM documents) WHERE category IS NOT NULL GROUP BY category""")
def gate_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by category; those without one are 'other' if they are long enough, else none."""
    known = F.when(F.col("lang") != "en", F.col("lang"))
    rows = table(spark, sf, "documents").select(select.gate_category(known, F.length("text")).alias("category"))
    return rows.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1) AS name FROM pages) SELECT name FROM p WHERE regexp_matches(name, '^[0-9]*[05]$')""")
def dropped_names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct base names that a pattern excludes."""
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return select.without_named(table(spark, sf, "pages").select(path.alias("path")), "path", "^[0-9]*[05]$")[1]
