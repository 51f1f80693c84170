"""Queries over text and JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import edits as E
from folioflow.functions import json_walk as J
from folioflow.functions import strings as S
from folioflow.functions import text as T
from folioflow.functions import unicode as U
from folioflow.plans.registry import query
from folioflow.sources.files import parent, stem
from folioflow.sources.workspace import table

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def turn_pairs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Each turn with the one after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", *columns, after.alias("after")).where("after is not null")


@query()
def error_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Micro and macro character and word error rates of whole texts by role; empty truths are counted apart."""
    rows = turn_pairs(spark, sf).withColumns({"a": F.split(F.trim("text"), r"\s+"), "b": F.split(F.trim("after"), r"\s+")})
    each = rows.select("role", E.edits(F.col("text"), F.col("after")).alias("c"), F.length("text").alias("n"), E.edits(F.col("a"), F.col("b")).alias("w"), F.size("a").alias("m"))
    some = F.col("n") > 0
    rate = lambda e, n: (F.round(F.sum(F.when(some, F.col(e))) / F.sum(F.when(some, F.col(n))), 6), F.round(F.avg(F.when(some, F.col(e) / F.col(n))), 6))
    (cer, cer_macro), (wer, wer_macro) = rate("c", "n"), rate("w", "m")
    return each.groupBy("role").agg(F.count("*").alias("n"), F.count_if(~some).alias("n_empty"), cer.alias("cer"), cer_macro.alias("cer_macro"), wer.alias("wer"), wer_macro.alias("wer_macro"))


@query("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM conversations), w AS (SELECT conv_id, turn, string_split_regex(text, '\\s+') AS a, string_split_regex(after, '\\s+') AS b, text = after AS same, sha256(text) AS one FROM p WHERE after IS NOT NULL),
q AS (SELECT *, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) AS d FROM w)
SELECT conv_id, turn, same, one AS sha, CASE WHEN len(d) > 0 THEN d[1] - 1 ELSE least(len(a), len(b)) END AS prefix, round(CASE WHEN len(d) > 0 THEN d[1] - 1 ELSE least(len(a), len(b)) END / greatest(len(a), len(b)), 6) AS prefix_share FROM q""")
def agreement_record(spark: SparkSession, sf: str) -> DataFrame:
    """Exact equality, common prefix and its share, digest: two outputs of one page side by side."""
    rows = turn_pairs(spark, sf).select("conv_id", "turn", "text", "after", F.split("text", r"\s+").alias("a"), F.split("after", r"\s+").alias("b"))
    rows = rows.withColumn("prefix", S.common_prefix(F.col("a"), F.col("b")))
    return rows.select("conv_id", "turn", (F.col("text") == F.col("after")).alias("same"), F.sha2("text", 256).alias("sha"), "prefix", F.round(F.col("prefix") / F.greatest(F.size("a"), F.size("b")), 6).alias("prefix_share"))


@query("SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '[-+]?\\d+(?:[.,]\\d+)*'), ' ')) AS numbers FROM documents")
def number_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(S.numbers(F.col("text")), " "), 256).alias("numbers"))


@query("SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) AS stem, regexp_extract(split_part(url, '?', 1), '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1) AS parent FROM pages")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.substring_index("url", "?", 1)
    return table(spark, sf, "pages").select("page_id", stem(path).alias("stem"), parent(path).alias("parent"))


_HEAD = "lower(regexp_replace(replace(split_part(text, chr(10), 1), 'fi', 'fi'), '[^\\pL\\p{Nl}\\p{No}]', '', 'g'))"


@query(f"""SELECT doc_id, {_HEAD} AS furniture FROM documents WHERE length({_HEAD}) >= 4""")
def furniture_lines(spark: SparkSession, sf: str) -> DataFrame:
    """First lines as headers: their letters alone, in NFKC; ligatures that are put in come out as letters."""
    first = F.replace(F.split("text", "\n", 2)[0], F.lit("fi"), F.lit("\ufb01"))
    return table(spark, sf, "documents").select("doc_id", U.furniture(first).alias("furniture")).where("furniture is not null")


_EVENT = """'{"event_type":' || to_json(event_type) || ',"in":[{"a":{"k":' || json_extract_string(props, '$.k') || ',"z":"' || '} \\" {' || '"}},null],"user_id":' || user_id || '}'"""


@query(f"""SELECT event_id, sha256({_EVENT}) AS digest FROM events""")
def canonical_json_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of nested JSON whose names are sorted at every depth, whatever order and spaces they came with."""
    inner = F.concat(F.lit('{ "z" : "} \\" {", "k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    mixed = F.concat(F.lit('{ "user_id": '), "user_id", F.lit(', "in" : [{"a" :'), inner, F.lit('}, null ],\n "event_type": "'), "event_type", F.lit('" }'))
    return table(spark, sf, "events").select("event_id", J.json_digest(mixed).alias("digest"))


@query("""SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT) AS k_sum, count(*) FILTER (coalesce(json_extract(props, '$.missing')::BIGINT, 0) = 0) AS defaulted FROM events GROUP BY event_type""")
def typed_json_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """JSON as a typed struct, absent keys by their default."""
    props = F.from_json("props", "k bigint, missing bigint")
    return table(spark, sf, "events").select("event_type", props.alias("p")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.count_if(F.coalesce("p.missing", F.lit(0)) == 0).alias("defaulted"))


@query(f"""SELECT event_id, sha256({_EVENT}) AS found, event_id || ' done' IS NULL AS empty FROM events""")
def json_in_noise(spark: SparkSession, sf: str) -> DataFrame:
    """The first JSON object of a noisy line, nested and with braces in its strings, and the last line that holds one."""
    whole = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","in":[{"a":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"z":"} \\" {"}},null],"user_id":'), "user_id", F.lit("}"))
    noisy = F.concat(F.lit("log ["), "event_id", F.lit("] "), whole, F.lit(" then {\"x\":1}\n"), F.lit("{\"last\":1}\nend"))
    return table(spark, sf, "events").select("event_id", F.sha2(J.first_object(noisy), 256).alias("found"), (S.last_json_line(noisy) != '{"last":1}').alias("empty"))


@query("""WITH t AS (SELECT p_partkey, unnest(['run', 'note', 'files', 'C:\\scans\\' || p_brand || '.png', 'deep', p_type || '.json', 'of ' || p_type, 'k' || p_size]) AS text FROM part)
SELECT p_partkey, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY text)) AS texts FROM t GROUP BY p_partkey""")
def json_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Every string and name inside nested JSON, whatever its depth."""
    inner = F.struct(F.array(F.struct(F.concat(F.col("p_type"), F.lit(".json")).alias("deep"), F.col("p_size").alias("k"))).alias("files"))
    rows = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(inner.alias("run"), F.array(F.concat(F.lit("C:\\scans\\"), "p_brand", F.lit(".png")), F.concat(F.lit("of "), "p_type")).alias("note"))).alias("j"))
    rows = rows.withColumn("j", F.replace("j", F.lit('"k":'), F.concat(F.lit('"k'), F.regexp_extract("j", '"k":(\\d+)', 1), F.lit('":'))))
    found = J.strings(J.walk(rows, "p_partkey", "j"), "p_partkey")
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("text")), "\n"), 256).alias("texts"))


@query("""SELECT p_partkey, p_brand || '.png' AS name FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT p_partkey, p_type || '.pdf' FROM part WHERE p_size % 3 = 1""")
def pages_named_in_json(spark: SparkSession, sf: str) -> DataFrame:
    """Which files nested JSON names: by name or stem, behind other extensions, in paths of either slash, URL-quoted."""
    size = F.col("p_size") % 3
    path = F.when(size == 0, F.concat(F.lit("C:\\scans\\"), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit(".png"))).when(size == 1, F.concat(F.lit("run/"), "p_brand", F.lit(".jpg"))).otherwise("nothing")
    inner = F.array(F.struct(F.struct(path.alias("image")).alias("x")), F.struct(F.struct(F.when(size == 1, F.concat(F.lit("s3:"), "p_type", F.lit(".pdf.json"))).alias("image")).alias("x")))
    rows = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(inner.alias("evidence"))).alias("j"))
    names = table(spark, sf, "part").select(F.explode(F.array(F.concat("p_brand", F.lit(".png")), F.concat("p_type", F.lit(".pdf")))).alias("name")).distinct()
    return J.named(rows, "p_partkey", "j", names, "name")


@query("""SELECT event_id, event_id % 5 IN (0, 1, 3) AS bad FROM events""")
def non_finite_json(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that hold a number that isn't finite at some depth; words in strings don't count."""
    value = F.element_at(F.array(*(F.lit(x) for x in ("NaN", "-Infinity", '"a, NaN ,"', "1e999", "1e300"))), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat(F.lit('{"metrics":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"deep":[{"v":'), value, F.lit("}]}}"))
    return table(spark, sf, "events").select("event_id", J.has_non_finite(text).alias("bad"))


@query("""SELECT p_partkey, 'decode.*.' || p_type AS stage, '/c/parts/' || p_brand AS path, p_size AS token, CASE WHEN p_size > 25 THEN ['--size=' || p_size] ELSE [] END AS flags FROM part""")
def name_normalizations(spark: SparkSession, sf: str) -> DataFrame:
    """Stage names, drive letters, token numbers and settings that differ from their default."""
    size = F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(F.lit(25))
    return table(spark, sf, "part").select(
        "p_partkey",
        S.stage_name(F.concat(F.lit("decode."), "p_size", F.lit("."), "p_type")).alias("stage"),
        S.unix_path(F.concat(F.lit("C:\\parts\\"), "p_brand")).alias("path"),
        S.token_number(F.concat(F.lit("token_id:"), "p_size")).alias("token"),
        S.differing_flags({"size": size}, {"size": 25}).alias("flags"),
    )


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'a' ELSE 'b' END AS split, unnest(string_split(text, chr(10) || chr(10))) AS block FROM documents), h AS (SELECT split, sha256(trim(regexp_replace(nfc_normalize(block), '\\s+', ' ', 'g'))) AS sha, length(trim(regexp_replace(nfc_normalize(block), '\\s+', ' ', 'g'))) AS n FROM b)
SELECT sha, count(*) AS copies FROM h WHERE n >= 160 GROUP BY sha HAVING count(DISTINCT split) > 1""")
def cross_split_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Text blocks of 160 characters or more, in normal form, that lie in two splits; half of them come decomposed."""
    split = F.when(F.col("doc_id") % 10 < 7, "a").otherwise("b")
    blocks = table(spark, sf, "documents").select(split.alias("split"), F.explode(F.split("text", "\n\n")).alias("block"))
    forms = F.when(F.length("block") % 2 == 0, F.array(F.lit("NFD"), F.lit("NFC"))).otherwise(F.array(F.lit("NFC")))
    normal = U.in_forms(blocks.withColumn("forms", forms), "block", "forms")
    hashed = normal.select("split", S.collapsed_white(F.col("block")).alias("plain")).where(F.length("plain") >= 160).select("split", F.sha2("plain", 256).alias("sha"))
    return hashed.groupBy("sha").agg(F.count("*").alias("copies"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("sha", "copies")


@query("""SELECT conv_id, sha256(nfc_normalize(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (t <> ''), ''))) AS truth FROM (SELECT *, CASE WHEN role = 'user' THEN trim('H ' || text) ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS t FROM conversations) WHERE role <> 'system' GROUP BY conv_id""")
def ground_truth_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Nested blocks as ordered text: user turns stand for tables with html, system turns for ignored blocks."""
    block = F.struct("turn", "role", "text", F.when(F.col("role") == "user", "table").otherwise("text").alias("kind"), F.col("turn").cast("double").alias("order"), (F.col("role") == "system").alias("ignore"), F.concat(F.lit("H "), "text").alias("html"), F.lit("").alias("latex"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.count_if(F.col("role") != "system").alias("n")).where("n > 0")
    return rows.select("conv_id", F.sha2(U.normal_form(S.assembled(F.col("blocks")), "NFC"), 256).alias("truth"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'for'))) AS k FROM w) SELECT doc_id FROM s WHERE n >= 30 AND k > 0.04 * n""")
def training_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of 30 words or more with more than 4 % English stop words."""
    words = T.word_list(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    stops = F.size(F.filter("w", lambda x: x.isin("the", "of", "and", "to", "in", "is", "that", "for")))
    return rows.where((F.size("w") >= 30) & (stops > 0.04 * F.size("w"))).select("doc_id")


@query("""SELECT doc_id, md5(nfc_normalize(regexp_replace(regexp_replace(text, '[\\s]+', ' ', 'g'), '^ | $', '', 'g'))) AS plain FROM documents""")
def white_space_form(spark: SparkSession, sf: str) -> DataFrame:
    """NFC, and white space of 29 code points collapsed; texts of even length come decomposed."""
    text = F.when(F.length("text") % 2 == 0, U.normal_form(F.col("text"), "NFD")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(U.normal_text(text)).alias("plain"))


@query()
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as the truth of the next: exactness, edits and rates in normal form, what blank truths' outputs make up."""
    rows = turn_pairs(spark, sf).withColumn("text", F.when(F.col("turn") % 5 == 0, F.lit(" \n")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", E.page_quality(F.col("text"), F.col("after")).alias("q")).select("conv_id", "turn", "q.*")


@query()
def relative_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits over the longer length of each turn and the next, by characters and by words."""
    rows = turn_pairs(spark, sf)
    return rows.select("conv_id", "turn", E.relative_edits(F.col("text"), F.col("after")).alias("c"), E.relative_edits(F.split("text", r"\s+"), F.split("after", r"\s+")).alias("w")).select("conv_id", "turn", F.col("c.value").alias("characters"), F.col("w.value").alias("words"), F.col("c.method").alias("method"))
