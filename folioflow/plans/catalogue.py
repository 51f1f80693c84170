"""The registry of queries outside the llm subpackage, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import joins, measures, sampling, select, sequences, vectors
from folioflow.operators.graph import connected_components
from folioflow.plans.registry import QUERIES, SQL, query  # noqa: F401
from folioflow.sources.workspace import stored, table

def _grams(name: str, key: str, source: str) -> str:
    """CTEs: the distinct 13-word grams (with eight distinct words) of a table's texts."""
    return f"""
w_{name} AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {source}),
g_{name} AS (SELECT k, unnest(list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12])) AS g FROM w_{name} WHERE len(w) >= 13),
grams_{name} AS (SELECT DISTINCT k, array_to_string(g, ' ') AS gram FROM g_{name} WHERE len(list_distinct(g)) >= 8)"""


@query(f"""
WITH {_grams("d", "doc_id", "documents")}, {_grams("b", "item_id", "benchmark")}, f AS (SELECT gram, min(k) AS item_id FROM grams_b GROUP BY gram),
h AS (SELECT d.k AS doc_id, f.item_id, d.gram FROM grams_d d JOIN f USING (gram)),
n AS (SELECT doc_id, count(*) AS hits FROM h GROUP BY doc_id HAVING count(*) >= 3),
t AS (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, item_id) AS rn FROM h GROUP BY doc_id, item_id)
SELECT n.doc_id, n.hits, t.item_id AS top_item FROM n JOIN t ON n.doc_id = t.doc_id AND t.rn = 1""")
def decontam_13gram(spark: SparkSession, sf: str) -> DataFrame:
    return joins.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return joins.remaining(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def rerun_semi_count(spark: SparkSession, sf: str) -> DataFrame:
    again = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang").join(again, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'done' END AS status, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1")
def missing_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return joins.inventory(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0 OR toxic = 1")
def null_tolerant_match(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(1, 0), (None, 1)], "quality int, toxic int")
    return joins.null_tolerant(table(spark, sf, "labels"), wanted, ["quality", "toxic"])


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return select.keep_first(table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h")), F.col("h"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def normalized_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.sha2(F.lower(T.collapsed(F.col("text"))), 256)
    return select.keep_first(table(spark, sf, "documents").select("doc_id", "lang", norm.alias("h")), F.col("h"), "doc_id").select("doc_id", "lang")


@query("""
WITH s AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n FROM s WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT split) > 1""")
def cross_split_shared_lines(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test")
    lines = table(spark, sf, "documents").select(split.alias("split"), F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("line", "n")


@query("""
WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
p AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', h[i]) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 100) AS left100 FROM h)
SELECT doc_id, CASE WHEN left100 < 70 THEN 'train' WHEN left100 < 85 THEN 'val' ELSE 'test' END AS split FROM p""")
def hash_split_70_15_15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", select.hash_split(F.col("doc_id")).alias("split"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1' || chr(0) || lang || chr(0) || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20")
def seeded_rank_quota(spark: SparkSession, sf: str) -> DataFrame:
    return select.seeded_quota(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, "s1").select("doc_id", "lang")


@query("SELECT host, min(page_id) AS page_id, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, page_id FROM pages) GROUP BY host")
def one_per_family_best(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(T.url_family(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn <= 5")
def round_robin_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return select.round_robin(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", 5, "n_chars", "doc_id").select("doc_id", "source", "rn")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return select.top_k(rows, "l_suppkey", 3, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z0-9]+') AS b FROM conversations),
q AS (SELECT conv_id, turn, a, b, list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1]) AS d FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CAST(CASE WHEN a = b THEN NULL WHEN len(d) > 0 THEN d[1] ELSE least(len(a), len(b)) END AS BIGINT) AS differs_at FROM q""")
def first_divergence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("after")).where("after is not null")
    words = rows.select("conv_id", "turn", T.word_list(F.col("text")).alias("a"), T.word_list(F.col("after")).alias("b"))
    return words.select("conv_id", "turn", T.first_divergence(F.col("a"), F.col("b")).cast("long").alias("differs_at"))


@query("SELECT conv_id, sha256(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn)) AS truth FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id")
def ground_truth_assembly(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "conversations").where("role <> 'system' and trim(text) <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("text")))).alias("blocks"))
    return blocks.select("conv_id", F.sha2(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), 256).alias("truth"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN n_chars < 300 THEN 'tiny' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' WHEN regexp_matches(text, '[Ll]icense') THEN 'license' WHEN n_chars >= 10000 THEN 'long' ELSE 'ordinary' END AS category FROM documents) GROUP BY category")
def category_rules(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.when(F.col("n_chars") < 300, "tiny").when(F.col("text").rlike("[0-9]{4}"), "numbers").when(F.col("text").rlike("[Ll]icense"), "license").when(F.col("n_chars") >= 10000, "long").otherwise("ordinary")
    return table(spark, sf, "documents").groupBy(rule.alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text_projection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(props) AS with_props, max(length(props)) AS longest FROM events GROUP BY event_type")
def props_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count("props").alias("with_props"), F.max(F.length("props")).cast("long").alias("longest"))


@query("""
WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
l AS (SELECT doc_id, pos - 1 AS pos, p, w = lag(w, p) OVER (PARTITION BY doc_id, p ORDER BY pos) AS same FROM t, (SELECT unnest(range(1, 5)) AS p)),
r AS (SELECT *, pos - coalesce(max(CASE WHEN same IS NOT TRUE THEN pos END) OVER (PARTITION BY doc_id, p ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS run FROM l),
s AS (SELECT doc_id, pos, p, row_number() OVER (PARTITION BY doc_id ORDER BY pos, p) AS rn FROM r WHERE same AND run + p >= greatest(4, 4 * p))
SELECT doc_id, pos AS stop, p AS period FROM s WHERE rn = 1""")
def loop_exact_rule(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", F.transform(T.word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return sequences.loops(words, "doc_id", "w", 4, 4)


@query()
def loop_exact_rule_128(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", F.transform(T.word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return sequences.loops(words, "doc_id", "w", 128, 256)


@query()
def repeated_tail_block_64(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(sequences.tail_repeats(T.word_list(F.col("text")), 64)).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 3 AND w[len(w)] = w[len(w) - 1] AND w[len(w)] = w[len(w) - 2] OR len(w) >= 6 AND w[len(w) - 1:len(w)] = w[len(w) - 3:len(w) - 2] AND w[len(w) - 1:len(w)] = w[len(w) - 5:len(w) - 4]")
def repeated_tail_block(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", T.word_list(F.col("text")).alias("w"))
    same = lambda k: (F.size("w") >= 3 * k) & (F.slice("w", -k, k) == F.slice("w", -2 * k, k)) & (F.slice("w", -k, k) == F.slice("w", -3 * k, k))
    return words.where(F.when(F.size("w") >= 6, same(1) | same(2)).when(F.size("w") >= 3, same(1)).otherwise(False)).select("doc_id")


@query("""
WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM l WHERE trim(line) <> '')
SELECT doc_id, min(pos) AS start, count(*) AS length FROM g GROUP BY doc_id, gap HAVING count(*) >= 4""")
def line_runs_islands(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.trim("line") != "").alias("flag"))
    return sequences.islands(lines, "doc_id", "pos", "flag", 4)


@query("""
WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n)
SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.sessions(table(spark, sf, "events"), "user_id", "ts", 3600)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e AS (SELECT user_id, rn, value AS ema FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, e.ema * 0.85 + o.value * 0.15 FROM e JOIN o ON o.user_id = e.user_id AND o.rn = e.rn + 1)
SELECT user_id, round(arg_max(ema, rn), 6) AS ema FROM e GROUP BY user_id""")
def ema_policy(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.moving_average(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 0.15)


@query("""
WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS eos, min(CASE WHEN event_type = 'error' THEN event_id END) AS loop, max(event_id) AS cap FROM events GROUP BY user_id)
SELECT user_id, least(coalesce(eos, cap), coalesce(loop, cap), cap) AS stop_at, CASE WHEN eos IS NOT NULL AND eos <= coalesce(loop, eos) THEN 'eos' WHEN loop IS NOT NULL THEN 'loop' ELSE 'length' END AS reason FROM f""")
def stop_ladder(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_id")))
    found = table(spark, sf, "events").groupBy("user_id").agg(at("purchase").alias("eos"), at("error").alias("loop"), F.max("event_id").alias("cap"))
    reason = F.when(F.col("eos").isNotNull() & (F.col("eos") <= F.coalesce("loop", "eos")), "eos").when(F.col("loop").isNotNull(), "loop").otherwise("length")
    return found.select("user_id", F.least("eos", "loop", "cap").alias("stop_at"), reason.alias("reason"))


@query("""
WITH p AS (SELECT l_returnflag, l_linenumber AS m, count(*)::DOUBLE AS c FROM lineitem WHERE l_quantity < 25 GROUP BY ALL), q AS (SELECT l_returnflag, l_linenumber AS m, count(*)::DOUBLE AS c FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL),
a AS (SELECT l_returnflag, m, c / sum(c) OVER (PARTITION BY l_returnflag) AS p FROM p), b AS (SELECT l_returnflag, m, c / sum(c) OVER (PARTITION BY l_returnflag) AS q FROM q)
SELECT l_returnflag, round(greatest(sum(p * ln(p / greatest(coalesce(q, 0), 1e-300))), 0), 6) AS kl FROM a LEFT JOIN b USING (l_returnflag, m) GROUP BY l_returnflag""")
def kl_topk(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    side = lambda rule: lines.where(rule).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").cast("double").alias("c"))
    return measures.divergence(side("l_quantity < 25"), side("l_quantity >= 25"), "l_returnflag", "l_linenumber", "c")


@query("SELECT lang, count(*) AS n, CAST(sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) AS BIGINT) AS flips, round(1000.0 * sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) / count(*), 6) AS per_1000 FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def agreement_rollup(spark: SparkSession, sf: str) -> DataFrame:
    flips = F.sum((F.col("quality") != F.col("toxic")).cast("int"))
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang").agg(F.count("*").alias("n"), flips.alias("flips"), F.round(1000.0 * flips / F.count("*"), 6).alias("per_1000"))


@query("SELECT lang, count(*) AS n, round(avg(toxic) - avg(1 - quality), 6) AS change, count(*) < 20 OR round(avg(toxic) - avg(1 - quality), 6) <= 0.01 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def gate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return measures.gate(rows, "lang", 1 - F.col("quality"), F.col("toxic"), 0.01, 20)


@query("SELECT event_type, user_id % 5 AS cohort, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (event_type), ())")
def breakdown_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("cohort")).createOrReplaceTempView("folioflow_cohorts")
    return spark.sql("SELECT event_type, cohort, count(*) AS n FROM folioflow_cohorts GROUP BY GROUPING SETS ((event_type, cohort), (event_type), ())")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority LIKE '5%') AS low, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def all_row_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderstatus").agg(F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"), F.count_if(F.col("o_orderpriority").like("5%")).alias("low"), F.count("*").alias("n"))


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 4) AS deviation FROM lineitem GROUP BY l_returnflag")
def pop_std_from_moments(spark: SparkSession, sf: str) -> DataFrame:
    return measures.moments(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT CASE WHEN value < 1 THEN '0-1' WHEN value < 10 THEN '1-10' WHEN value < 100 THEN '10-100' ELSE '100+' END AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram_unequal_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").groupBy(F.when(v < 1, "0-1").when(v < 10, "1-10").when(v < 100, "10-100").otherwise("100+").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT event_type, user_id % 7 AS candidate, quantile_cont(value, 0.5) AS cost FROM events GROUP BY ALL), b AS (SELECT *, min(cost) OVER (PARTITION BY event_type) AS best FROM m) SELECT event_type, min(candidate) AS candidate FROM b WHERE cost <= best * 1.02 GROUP BY event_type")
def tolerance_argmin(spark: SparkSession, sf: str) -> DataFrame:
    return measures.tolerance_argmin(table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("candidate"), "value"), "event_type", "candidate", "value")


@query("WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) FILTER (o_orderkey % 3 = 0) AS a, quantile_cont(o_totalprice, 0.5) FILTER (o_orderkey % 3 = 1) AS c, quantile_cont(o_totalprice, 0.5) FILTER (o_orderkey % 3 = 2) AS b FROM orders GROUP BY 1) SELECT o_orderpriority, round(abs(a - b) / least(a, b), 6) AS drift, round(1 - c / a, 6) AS gain_before, round(1 - c / b, 6) AS gain_after, abs(a - b) / least(a, b) <= 0.05 AS stable FROM m")
def bracket_drift(spark: SparkSession, sf: str) -> DataFrame:
    return measures.bracket(table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("slot"), "o_totalprice"), "o_orderpriority", "slot", "o_totalprice")


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice / l_quantity))), 4) AS geo_mean FROM lineitem GROUP BY l_returnflag")
def geo_mean_speedup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.ln(F.col("l_extendedprice") / F.col("l_quantity")))), 4).alias("geo_mean"))


@query("SELECT event_type, round(corr(event_id, value), 6) AS r FROM events GROUP BY event_type")
def pearson_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.corr("event_id", "value"), 6).alias("r"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS argmax FROM embeddings")
def argmax_first_tie(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", vectors.argmax_first(F.col("embedding")).alias("argmax"))


@query("""
WITH b AS (SELECT vec_id, k, embedding[k * 32 + 1:k * 32 + 32] AS part FROM embeddings, (SELECT unnest(range(0, 2)) AS k)),
s AS (SELECT *, list_max(list_transform(part, lambda v: abs(v::DOUBLE))) / 127 AS scale FROM b)
SELECT vec_id, CAST(k AS INT) AS block, round(scale, 9) AS scale, CAST(list_sum(list_transform(part, lambda v: CASE WHEN scale > 0 THEN round_even(v::DOUBLE / scale, 0) ELSE 0 END)) AS BIGINT) AS code_sum FROM s""")
def quantize_absmax_q8(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.quantized(F.col("embedding"))).alias("block", "q"))
    return q.select("vec_id", "block", F.round("q.scale", 9).alias("scale"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN CASE WHEN p_retailprice <= 1000 THEN 0.1 ELSE 0.3 END ELSE CASE WHEN p_retailprice <= 1500 THEN -0.2 ELSE 0.5 END END + CASE WHEN p_size <= 25 THEN 0.05 ELSE -0.05 END AS score FROM part")
def tree_scoring(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    one = F.when(size <= 10, F.when(price <= 1000, 0.1).otherwise(0.3)).otherwise(F.when(price <= 1500, -0.2).otherwise(0.5))
    return table(spark, sf, "part").select("p_partkey", (one + F.when(size <= 25, 0.05).otherwise(-0.05)).alias("score"))


@query("SELECT doc_id, d.lang, coalesce(l.quality, 0) AS quality, CASE WHEN l.doc_id IS NULL THEN 'default' ELSE 'label' END AS provenance FROM documents d LEFT JOIN labels l USING (doc_id)")
def escalation_merge(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").select("doc_id", "lang").join(labels.withColumn("seen", F.lit(True)), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(0)).alias("quality"), F.when(F.col("seen"), "label").otherwise("default").alias("provenance"))


@query("SELECT count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS odd_lang, count(*) - count(DISTINCT doc_id) AS repeated_id FROM documents")
def constraint_suite(spark: SparkSession, sf: str) -> DataFrame:
    fails = {"null_text": "text is null", "wrong_length": "n_chars <> length(text)", "odd_lang": "lang not in ('en', 'de', 'fr', 'es')"}
    return table(spark, sf, "documents").agg(*(F.count_if(F.expr(rule)).alias(k) for k, rule in fails.items()), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_id"))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, e.ts, round(v.value, 6) AS value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def as_of_value(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    seen = events.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "value").withColumn("value", F.round("value", 6))


@query("""
WITH c AS (SELECT p_brand, p_retailprice AS v, p_size > 25 AS f FROM part),
p AS (SELECT a.p_brand, avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END) AS u FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.f AND NOT b.f GROUP BY a.p_brand)
SELECT b.p_brand, round(2 * u - 1, 6) AS rank_biserial FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN p USING (p_brand)""")
def rank_biserial(spark: SparkSession, sf: str) -> DataFrame:
    return measures.rank_biserial(table(spark, sf, "part"), "p_brand", F.col("p_size") > 25, "p_retailprice")


@query("""
WITH r AS (SELECT lang, n_chars::DOUBLE AS s, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.0, 100.0, 300.0, 1000.0, 3000.0]::DOUBLE[]) AS threshold),
c AS (SELECT lang, threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold) AS n, count(*) FILTER (y) AS pos FROM r, t GROUP BY ALL)
SELECT lang, threshold, round(tp / pos, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tp DESC, threshold) AS rn FROM c WHERE n > 0 AND pos > 0 AND tp >= 0.5::DOUBLE * n) WHERE rn = 1""")
def threshold_grid_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return measures.best_threshold(rows, "lang", F.col("n_chars").cast("double"), F.col("quality") == 1, [0.0, 100.0, 300.0, 1000.0, 3000.0], 0.5)


@query("SELECT lower(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1)) AS parent, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def page_parent_key(spark: SparkSession, sf: str) -> DataFrame:
    parent = F.lower(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1))
    return table(spark, sf, "pages").groupBy(parent.alias("parent")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""WITH n AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, round(coalesce(total, o_totalprice), 2) AS o_totalprice, CASE WHEN o_orderkey IS NULL THEN 'inserted' WHEN l_orderkey IS NULL THEN 'kept' ELSE 'updated' END AS action FROM orders FULL JOIN n ON o_orderkey = l_orderkey""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    newer = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return joins.merged(table(spark, sf, "orders"), newer, "o_orderkey", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_SIM = """
{n}w AS (SELECT {k} AS k, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM {t}), {n}h AS (SELECT k, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM {n}w),
{n}v AS (SELECT k, b, sum((h >> b & 1) * 2 - 1) > 0 AS up FROM {n}h, (SELECT unnest(range(0, 60)) AS b) GROUP BY ALL), {n}s AS (SELECT k, sum(CASE WHEN up THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS sim FROM {n}v GROUP BY k)"""


@query(f"""WITH {_SIM.format(n="d", k="doc_id", t="documents")}, t AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 0 ELSE 1 END AS split, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS text_class, sim FROM documents LEFT JOIN ds ON k = doc_id),
l AS (SELECT a.sim, a.split, count(DISTINCT b.sim) AS near FROM (SELECT DISTINCT sim, split FROM t) a JOIN (SELECT DISTINCT sim, split FROM t) b ON a.split <> b.split AND bit_count(xor(a.sim, b.sim)) <= 4 GROUP BY ALL)
SELECT doc_id, text_class, coalesce(near, 0) AS cross_split_near FROM t LEFT JOIN l USING (sim, split)""")
def pairwise_dup_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Membership in classes of equal normalised text, and how many similar hashes (4 of 60 bits) the other split holds."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 < 7, 0).otherwise(1).alias("split"))
    norm = F.sha2(F.lower(T.collapsed(F.col("text"))), 256)
    keyed = docs.select("doc_id", "split", norm.alias("h"))
    classes = keyed.groupBy("h").agg(F.min("doc_id").alias("text_class"))
    rows = stored(keyed.join(classes, "h").join(joins.simhash(docs, "doc_id"), "doc_id", "left").drop("h"), "hashed")  # read four times below
    each = rows.where("simhash is not null").select("simhash", "split").distinct()
    near = joins.near_by_hamming(each.where("split = 0").select("simhash"), each.where("split = 1").select("simhash"), 4)
    links = near.select(F.col("one").alias("simhash"), F.lit(0).alias("split"), F.col("two").alias("other")).union(near.select("two", F.lit(1), "one"))
    counted = links.groupBy("simhash", "split").agg(F.count("*").alias("near"))
    return rows.join(counted, ["simhash", "split"], "left").select("doc_id", "text_class", F.coalesce("near", F.lit(0)).alias("cross_split_near"))


@query(f"""WITH {_SIM.format(n="d", k="doc_id", t="documents")}, {_SIM.format(n="b", k="item_id", t="benchmark")},
x AS (SELECT DISTINCT ds.k FROM ds JOIN bs ON bit_count(xor(ds.sim, bs.sim)) <= 8) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT k FROM x) AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL)""")
def blocklist_hamming_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Documents neither equal to a blocked text nor within 8 of 60 bits of one's hash; texts without words are kept."""
    docs, blocked = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    hashed = stored(joins.simhash(docs, "doc_id"), "hashed")
    near = joins.near_by_hamming(hashed.select("simhash").distinct(), joins.simhash(blocked, "item_id").select("simhash").distinct(), 8).select(F.col("one").alias("simhash")).distinct()
    out = docs.select("doc_id", F.sha2("text", 256).alias("h")).join(blocked.select(F.sha2("text", 256).alias("h")).distinct(), "h", "left_anti")
    return out.join(hashed.join(near, "simhash").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


@query("""
WITH RECURSIVE n AS (SELECT doc_id, md5(lower(text)) AS k FROM documents UNION ALL SELECT doc_id, 'l:' || md5(split_part(text, chr(10), 1)) FROM documents WHERE length(split_part(text, chr(10), 1)) >= 20),
c AS (SELECT k, min(doc_id) AS hub FROM n GROUP BY k HAVING count(*) > 1), e AS (SELECT DISTINCT doc_id AS a, hub AS b FROM n JOIN c USING (k) WHERE doc_id <> hub), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS x, a AS y FROM f UNION SELECT r.x, f.b FROM r JOIN f ON r.y = f.a)
SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x""")
def near_dup_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents tied by equal lower-cased text or an equal first line of 20 characters or more."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    line = F.split("text", "\n", 2)[0]
    keys = docs.select("doc_id", F.md5(F.lower("text")).alias("k")).union(docs.where(F.length(line) >= 20).select("doc_id", F.concat(F.lit("l:"), F.md5(line))))
    hubs = stored(keys.groupBy("k").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("k", "hub"), "hubs")
    return connected_components(keys.join(hubs, "k").select("doc_id", "hub"), "doc_id", "hub").select(F.col("vertex").alias("doc_id"), "component")


@query()
def cer_ascii_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Character error rates of whole texts by role."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf, "conversations").select("role", F.col("text").alias("a"), following.alias("b")).where("b is not null")
    return measures.rates(pairs, "role", F.levenshtein("a", "b"), F.length("a"))


@query()
def bounded_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """Edits from each item to the next, null above 60."""
    items = table(spark, sf, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(after, "item_id").select("item_id", F.nullif(F.levenshtein("text", "other", 60), F.lit(-1)).cast("long").alias("edits"))


@query("SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 200")
def token_frequency_top(spark: SparkSession, sf: str) -> DataFrame:
    """Words are sorted inside their row, so that the first of each document is known and only words are shuffled."""
    sorted_words = table(spark, sf, "documents").select(F.array_sort(T.word_list(F.col("text"))).alias("w"))
    each = sorted_words.select(F.explode(F.zip_with("w", F.concat(F.array(F.lit("")), "w"), lambda x, before: F.struct(x.alias("w"), (x != before).cast("int").alias("new")))).alias("x")).where("x.w is not null")
    return each.groupBy("x.w").agg(F.count("*").alias("n"), F.sum("x.new").alias("docs")).orderBy(F.desc("n"), "w").limit(200)


@query("""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rn FROM c)
SELECT lang, count(*) AS words, round(sum(CASE WHEN rn <= 100 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM r GROUP BY lang""")
def token_frequency_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a language's hundred commonest words; each task keeps its own hundred before they meet."""
    counts = stored(table(spark, sf, "documents").select("lang", F.explode(T.word_list(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")), "counts")
    top = select.top_k(counts.select("lang", "n", "w"), "lang", 100, F.desc("n"), F.col("w")).groupBy("lang").agg(F.sum("n").alias("top"))
    return counts.groupBy("lang").agg(F.count("*").alias("words"), F.sum("n").alias("all")).join(top, "lang").select("lang", "words", F.round(F.col("top") / F.col("all"), 6).alias("coverage"))


@query("SELECT event_id, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS leaves_at FROM events")
def ordered_emit(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.leaving(table(spark, sf, "events"), "event_id", "ts")


@query("SELECT p_partkey FROM (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM part) WHERE running - p_size < 5000")
def prefix_to_target(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.prefix_to_target(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 5000, "p_partkey").select("p_partkey")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS cohort FROM documents")
def count_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cohorts(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 8).select("doc_id", "cohort")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(max(CASE WHEN rn = ceil(0.95 * n) THEN value END), 6) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def percentiles_exact(spark: SparkSession, sf: str) -> DataFrame:
    return measures.percentiles(table(spark, sf, "events"), "event_type", "value")


@query("SELECT j, round(avg(CASE WHEN n >= j THEN 1.0 ELSE 0.0 END), 6) AS reach FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), (SELECT unnest(range(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)) + 1)) AS j) GROUP BY j")
def survival_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Share of conversations with j turns or more, to the longest: counted by length first, so one row per length is ranked."""
    lengths = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = lengths.select("n", F.round(F.sum("c").over(upto) / F.sum("c").over(whole), 6).alias("reach"), (F.coalesce(F.lead("n").over(Window.orderBy(F.desc("n"))), F.lit(0)) + 1).alias("least"))
    return steps.select(F.explode(F.sequence("least", "n")).alias("j"), "reach")


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, list_dot_product(list_transform(a, lambda v: v::DOUBLE), list_transform(embedding, lambda v: v::DOUBLE)) AS d FROM q, embeddings WHERE vec_id <> q)
SELECT q, vec_id AS best, round(d, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d DESC, vec_id) AS rn FROM s) WHERE rn = 1""")
def screened_top1(spark: SparkSession, sf: str) -> DataFrame:
    """Best other vector of every twentieth vector: coded vectors screen by bounds, what may win is scored exactly."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.screened(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding")
