"""Queries over pixel tables; the pages are drawn from the embeddings, 8 x 8 pixels each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import pixels as P
from folioflow.operators import polygons as G
from folioflow.plans.registry import query
from folioflow.sources.workspace import table

_PAGES = """
e AS (SELECT vec_id AS page, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT page, (i // 8)::INT AS y, (i % 8)::INT AS x, greatest(0, 255 - floor(abs(e) * 800))::INT AS r, (greatest(0, 255 - floor(abs(e) * 800)) * 3 % 256)::INT AS g, (255 - greatest(0, 255 - floor(abs(e) * 800)))::INT AS b FROM e),
q AS (SELECT page, y, x, r AS v FROM p)"""


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(255 - F.floor(F.abs(F.col("e").cast("double")) * 800), F.lit(0)).cast("int")
    return cells.select("page", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("r")).withColumns({"g": F.col("r") * 3 % 256, "b": 255 - F.col("r")})


def gray(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf).select("page", "y", "x", F.col("r").alias("v"))


@query(f"WITH {_PAGES} SELECT page, sum((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)::BIGINT AS luma, sum(greatest(255 - b - ((((g * (255 - b) + 128) >> 8) + g * (255 - b) + 128) >> 8), 0))::BIGINT AS red, sum((r * 257) >> 8)::BIGINT AS high FROM p GROUP BY page")
def pixel_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Luma, red out of inks (g as cyan, b as black) and the high byte of 16-bit samples, summed by page."""
    rows = drawn(spark, sf)
    red = P.cmyk_to_rgb(F.col("g"), F.col("r"), F.col("r"), F.col("b"))["r"]
    return rows.groupBy("page").agg(F.sum(P.luma(F.col("r"), F.col("g"), F.col("b"))).cast("long").alias("luma"), F.sum(red).cast("long").alias("red"), F.sum(F.shiftright(F.col("r") * 257, 8)).cast("long").alias("high"))


@query(f"WITH {_PAGES}, h AS (SELECT page, v, count(*) AS n FROM q GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY v) AS below, sum(n) OVER (PARTITION BY page) AS pixels FROM h) SELECT page, min(v) AS level FROM c WHERE below > floor(pixels * 0.9) GROUP BY page")
def histogram_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return P.level_at(P.histogram(gray(spark, sf)), 0.9).select("page", "level")


_BOX = """
h AS (SELECT page, v, count(*) AS n FROM q GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY v) AS below, sum(n) OVER (PARTITION BY page) AS pixels FROM h),
l AS (SELECT page, min(v) AS level FROM c WHERE below > floor(pixels * 0.9) GROUP BY page HAVING min(v) >= 160),
d AS (SELECT q.*, v <= level - 64 AS dark FROM q JOIN l USING (page)),
ix AS (SELECT page, x AS a, count(*) FILTER (dark) >= 2 AS f FROM d GROUP BY ALL), iy AS (SELECT page, y AS a, count(*) FILTER (dark) >= 2 AS f FROM d GROUP BY ALL),
gx AS (SELECT *, a - sum(f::INT) OVER (PARTITION BY page ORDER BY a) AS g FROM ix), gy AS (SELECT *, a - sum(f::INT) OVER (PARTITION BY page ORDER BY a) AS g FROM iy),
sx AS (SELECT page, min(s) AS "left", max(t) AS "right" FROM (SELECT page, min(a) AS s, max(a) + 1 AS t FROM gx WHERE f GROUP BY page, g HAVING count(*) >= 4) GROUP BY page),
sy AS (SELECT page, min(s) AS top, max(t) AS bottom FROM (SELECT page, min(a) AS s, max(a) + 1 AS t FROM gy WHERE f GROUP BY page, g HAVING count(*) >= 4) GROUP BY page),
box AS (SELECT page, "left", top, "right", bottom FROM sx JOIN sy USING (page) WHERE (64 - ("right" - "left") * (bottom - top)) * 100 >= 640)"""


@query(f"WITH {_PAGES}, {_BOX} SELECT * FROM box")
def margin_crop(spark: SparkSession, sf: str) -> DataFrame:
    return P.content_box(gray(spark, sf))


@query(f"WITH {_PAGES}, {_BOX} SELECT page, count(*) AS n, sum(v * (1 + x - coalesce(\"left\", 0)) * (1 + y - coalesce(top, 0)))::BIGINT AS check FROM q LEFT JOIN box USING (page) WHERE \"left\" IS NULL OR x >= \"left\" AND x < \"right\" AND y >= top AND y < bottom GROUP BY page")
def cropped_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = gray(spark, sf)
    return P.cropped(rows, P.content_box(rows)).groupBy("page").agg(F.count("*").alias("n"), F.sum(F.col("v") * (1 + F.col("x")) * (1 + F.col("y"))).cast("long").alias("check"))


@query(f"""WITH {_PAGES}, n AS (SELECT *, abs(lead(v) OVER (PARTITION BY page, y ORDER BY x) - v) AS dx, abs(lead(v) OVER (PARTITION BY page, x ORDER BY y) - v) AS dy FROM q)
SELECT page, round(avg(v), 6) AS mean, round(stddev_pop(v), 4) AS deviation, round(avg((v < 160)::INT), 6) AS ink, round(avg((v < 80)::INT), 6) AS dark, round(avg(dx) + avg(dy), 6) AS edges, count(*) FILTER (dx > 40 OR dy > 40) AS strong FROM n GROUP BY page""")
def page_features(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_features(gray(spark, sf))


@query(f"""WITH {_PAGES}, i AS (SELECT page, y AS a, count(*) FILTER (v < 160) / 8 > 0.01 AS f FROM q GROUP BY ALL), g AS (SELECT *, a - sum(f::INT) OVER (PARTITION BY page ORDER BY a) AS g FROM i),
r AS (SELECT page, min(a) AS s, max(a) + 1 AS t, count(*) AS length FROM g WHERE f GROUP BY page, g), b AS (SELECT *, s - lag(t) OVER (PARTITION BY page ORDER BY s) AS before FROM r)
SELECT page, count(*) FILTER (length >= 2) AS lines, max(length) AS tallest, count(before) AS gaps, coalesce(max(before), 0) AS widest_gap FROM b GROUP BY page""")
def text_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    return P.line_features(gray(spark, sf), 8)


@query(f"WITH {_PAGES} SELECT page, round(avg(CASE WHEN greatest(r, g, b) > 0 THEN floor((greatest(r, g, b) - least(r, g, b)) * 255 / greatest(r, g, b)) ELSE 0 END), 6) AS saturation FROM p WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY page")
def colour_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return P.saturation(drawn(spark, sf))


@query("""WITH e AS (SELECT vec_id AS page, list_transform(embedding, lambda v: greatest(0, 255 - floor(abs(v::DOUBLE) * 800))) AS e FROM embeddings), k AS (SELECT unnest(range(0, 64)) AS k),
b AS (SELECT page, k, e[(k // 8 * 7 + k % 8) % 64 + 1] > e[(k // 8 * 7 + k % 8 + 1) % 64 + 1] AS bit FROM e, k) SELECT page, sum(CASE WHEN bit AND k > 0 THEN 1::HUGEINT << (63 - k) WHEN bit THEN -9223372036854775808 ELSE 0 END)::BIGINT AS dhash FROM b GROUP BY page""")
def difference_hash(spark: SparkSession, sf: str) -> DataFrame:
    """64-bit difference hash of 9 x 8 pixels; rows overlap in the vector that they are drawn from."""
    v = lambda i: F.greatest(255 - F.floor(F.abs(F.get("embedding", i).cast("double")) * 800), F.lit(0))
    cells = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).select("vec_id", "embedding", "y", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("x"))
    return P.difference_hash(cells.select(F.col("vec_id").alias("page"), "y", "x", v(((F.col("y") * 7 + F.col("x")) % 64).cast("int")).alias("v")))


@query("""WITH s AS (SELECT DISTINCT p_size + 3 AS size, p_size % 7 + 2 AS out FROM part), t AS (SELECT size, out, unnest(range(0, out)) AS "to" FROM s),
c AS (SELECT *, ("to" + 0.5::DOUBLE) * (size::DOUBLE / out) AS centre, greatest(size::DOUBLE / out, 1) AS wide FROM t), r AS (SELECT *, unnest(range(greatest(trunc(centre - 2 * wide + 0.5::DOUBLE)::INT, 0), least(trunc(centre + 2 * wide + 0.5::DOUBLE)::INT, size))) AS source FROM c),
k AS (SELECT *, abs((source - centre + 0.5::DOUBLE) / wide) AS x FROM r), w AS (SELECT *, CASE WHEN x < 1 THEN (1.5::DOUBLE * x - 2.5::DOUBLE) * x * x + 1 WHEN x < 2 THEN (((x - 5) * x + 8) * x - 4) * -0.5::DOUBLE ELSE 0 END AS raw FROM k)
SELECT size, out, "to", source::INT AS source, round(raw / sum(raw) OVER (PARTITION BY size, out, "to"), 9) AS weight FROM w""")
def resampling_weights(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select((F.col("p_size") + 3).alias("size"), (F.col("p_size") % 7 + 2).alias("out"))
    return P.weights(sizes, "size", "out").withColumn("weight", F.round("weight", 9))


@query()
def resized_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.resized(gray(spark, sf), 8, 8, 5, 12)


@query("""WITH s AS (SELECT p_partkey, p_size * 37 + 5 AS w, (p_partkey % 90) * 11 + 7 AS h FROM part), a AS (SELECT *, w / h AS aspect, CASE WHEN w < 128 OR h < 128 THEN 128 ELSE 768 END AS bound FROM s),
b AS (SELECT *, CASE WHEN w < h THEN bound ELSE trunc(bound * aspect) END AS w1, CASE WHEN w < h THEN trunc(bound / aspect) ELSE bound END AS h1 FROM a),
c AS (SELECT *, CASE WHEN w1 > 768 THEN 768 ELSE w1 END AS w2, CASE WHEN w1 > 768 THEN trunc(768 / aspect) ELSE h1 END AS h2 FROM b),
d AS (SELECT *, CASE WHEN h2 > 768 THEN trunc(768 * aspect) ELSE w2 END AS w3, CASE WHEN h2 > 768 THEN 768 ELSE h2 END AS h3 FROM c)
SELECT p_partkey, (CASE WHEN w BETWEEN 128 AND 768 AND h BETWEEN 128 AND 768 THEN w ELSE w3 END)::INT AS w, (CASE WHEN w BETWEEN 128 AND 768 AND h BETWEEN 128 AND 768 THEN h ELSE h3 END)::INT AS h, (round_even(w / 16, 0) * 16)::INT AS patch, (round_even(w / 16, 0) * round_even(h / 16, 0) + 16)::INT AS tokens FROM d""")
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded sizes, patch multiples and token counts of pages."""
    w, h = F.col("p_size") * 37 + 5, ((F.col("p_partkey") % 90) * 11 + 7).cast("int")
    size = P.bounded(w, h, 128, 768)
    return table(spark, sf, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"), P.to_patch(w).alias("patch"), (F.rint(w / 16) * F.rint(h / 16) + 16).cast("int").alias("tokens"))


@query("""WITH s AS (SELECT p_partkey, p_size AS n, 97::DOUBLE / p_size AS step, 2::DOUBLE / greatest(p_size - 1, 1) AS gap FROM part),
a AS (SELECT *, list_transform(range(0, n), lambda k: trunc(list_reduce(range(0, k), lambda pos, i: pos + step, step * 0.5::DOUBLE))::BIGINT) AS nearest, list_transform(range(0, n), lambda i: CASE WHEN n = 1 THEN -1 WHEN i < n // 2 THEN -1 + gap * i ELSE 1 - gap * (n - 1 - i) END) AS grid FROM s)
SELECT p_partkey, md5(array_to_string(nearest, ' ')) AS nearest, round(list_sum(list_transform(range(0, n), lambda i: grid[i + 1] * (i + 1))), 6) AS grid FROM a""")
def index_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest source indexes, positions summed step by step, and an evenly spaced grid, for every size."""
    grid = F.when(F.col("p_size") > 1, P.linspace(F.lit(-1.0), F.lit(1.0), F.col("p_size"))).otherwise(F.array(F.lit(-1.0)))
    weighed = F.aggregate(F.transform(grid, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return table(spark, sf, "part").select("p_partkey", F.md5(F.array_join(P.nearest(F.lit(97), F.col("p_size")), " ")).alias("nearest"), F.round(weighed, 6).alias("grid"))


@query(f"""WITH {_PAGES}, n AS (SELECT page, v, lead(v) OVER r AS a, lag(v) OVER r AS b, lead(v) OVER c AS d, lag(v) OVER c AS e FROM q WINDOW r AS (PARTITION BY page, y ORDER BY x), c AS (PARTITION BY page, x ORDER BY y))
SELECT page, count(*) AS pixels, count(*) FILTER (v < 160) AS ink, count(*) FILTER (abs(a - v) > 40) + count(*) FILTER (abs(d - v) > 40) AS edges, sum(abs(a - v))::BIGINT AS across, sum(abs(d - v))::BIGINT AS down, count(*) FILTER ((v < 160) <> (a < 160)) AS transitions,
coalesce(sum(abs(4 * v - a - b - d - e)) FILTER (v < 160), 0)::BIGINT AS laplacian, count(a + b + d + e) FILTER (v < 160) AS inner FROM n GROUP BY page""")
def neighbour_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, differences, ink transitions and Laplacians of each page, by tiles of 5 pixels with a halo."""
    return P.neighbour_sums(gray(spark, sf), 5)


@query()
def resample_losses(spark: SparkSession, sf: str) -> DataFrame:
    """What pages lose when they are scaled to 6 and to 3 pixels and back."""
    rows = gray(spark, sf)
    loss = lambda size: P.resample_loss(rows, 8, 8, size).select("page", F.round("change", 6).alias(f"change_{size}"), F.round("lossy", 6).alias(f"lossy_{size}"))
    return loss(6).join(loss(3), "page")


@query("""WITH s AS (SELECT p_partkey AS page, p_size AS n, 100 AS w, 60 AS h FROM part), r AS (SELECT *, least(n + 40, 100) - n AS rw, 30 AS rh, greatest(0, least(n + 20, 100) - n) AS kw, 10 AS kh FROM s)
SELECT page, (rw * rh - kw * kh)::BIGINT AS pixels, round((rw * rh - kw * kh) / 6000, 6) AS share FROM r""")
def masked_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of a figure's region, partly beyond the page, without the caption that is kept inside it."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").cast("double").alias("n"))
    box = lambda x1, y1, x2, y2: F.array(x1, y1, x2, y1, x2, y2, x1, y2)
    low, high = (F.lit(v).cast("double") for v in (5.0, 35.0))
    regions = rows.select("page", box(F.col("n"), low, F.col("n") + 40, high).alias("poly"))
    kept = rows.select("page", box(F.col("n") - 7, low, F.col("n") + 20, F.lit(15.0)).alias("poly"))
    pages = rows.select("page", F.lit(100).alias("width"), F.lit(60).alias("height"))
    return G.masked(pages, regions, kept).withColumn("share", F.round("share", 6))


@query("""SELECT p_partkey AS page, round(CASE WHEN p_size % 3 = 0 THEN list_sort([p_size, p_size % 5 + 1, 9])[2] / 200 WHEN p_size % 3 = 1 THEN (p_size + 3) / 200 ELSE 1 END, 9) AS height FROM part""")
def polygon_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Upper median height of a page's lines; of its blocks where lines have no polygons; else 1."""
    n = F.col("p_size").cast("double")
    poly = lambda h: F.array(F.lit(3.0), F.lit(2.0), F.lit(9.0), F.lit(2.0), F.lit(9.0), h + 2, F.lit(3.0), h + 2)
    line = lambda text, h: F.struct(F.lit(text).alias("text"), poly(h).alias("poly"))
    none = F.array().cast("array<struct<text:string,poly:array<double>>>")
    block = lambda text, p, lines: F.struct(F.lit(text).alias("text"), p.alias("poly"), lines.alias("lines"))
    no_poly = F.lit(None).cast("array<double>")
    lined = F.array(block("two\nlines", poly(n + 90), F.array(line("a", n), line("", n + 500))), block("x", no_poly, F.array(line("b", F.pmod(n, F.lit(5)) + 1), line("c", F.lit(9.0)))))
    single = F.array(block("one line", poly(n + 3), none), block("two\nlines", poly(n + 90), none))
    blocks = F.when(F.col("p_size") % 3 == 0, lined).when(F.col("p_size") % 3 == 1, single).otherwise(F.array(block("", poly(n), none)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.round(G.line_height(blocks, F.lit(200.0)), 9).alias("height"))
