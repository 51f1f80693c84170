"""Queries over vectors: coding, transforms, attention, bounds. Results are whole vectors or sums over all coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import vectors as V
from folioflow.plans.registry import query
from folioflow.sources.workspace import table

_E = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"
_HALF = "h AS (SELECT vec_id, label, k, e[k * 32 + 1:k * 32 + 32] AS p FROM x, (SELECT unnest([0, 1]) AS k))"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))


def halves(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(k.alias("k"), F.slice("e", k * 32 + 1, 32).alias("p")))
    return rows(spark, sf).select("vec_id", "label", F.explode(parts).alias("h")).select("vec_id", "label", "h.k", "h.p")


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: greatest(e[i], 0) * greatest(e[i], 0) * e[i + 32])), 9) AS gated FROM x")
def squared_relu_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).select("vec_id", F.round(V.total(V.squared_relu_glu(F.slice("e", 1, 32), F.slice("e", 33, 32))), 9).alias("gated"))


@query(f"WITH {_E} SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * (b.e[i] + 0.5 * a.e[i]))), 6) AS moved FROM x a JOIN x b ON b.vec_id = a.vec_id + 1")
def scaled_addition(spark: SparkSession, sf: str) -> DataFrame:
    a = rows(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.total(F.transform(V.axpy(F.lit(0.5), F.col("e"), F.col("f")), lambda v, i: v * (i + 1))), 6).alias("moved"))


_Q = "s AS (SELECT *, list_max(list_transform(p, lambda v: abs(v))) / {top} AS scale FROM h), c AS (SELECT *, list_transform(p, lambda v: CASE WHEN scale > 0 THEN round_even(v / scale, 0) ELSE 0 END) AS code FROM s)"


@query(f"WITH {_E}, {_HALF}, {_Q.format(top=127)}, d AS (SELECT a.vec_id, a.k, a.scale * list_dot_product(a.code, b.p) AS d FROM c a JOIN h b ON b.vec_id = a.vec_id + 1 AND a.k = b.k) SELECT vec_id, round(sum(d), 8) AS product FROM d GROUP BY vec_id")
def quantized_dot(spark: SparkSession, sf: str) -> DataFrame:
    a = rows(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return a.select("vec_id", V.quantized(F.col("e")).alias("parts")).join(b, "vec_id").select("vec_id", F.round(V.quantized_dot(F.col("parts"), F.col("f")), 8).alias("product"))


@query(f"WITH {_E}, {_HALF}, {_Q.format(top=32767)} SELECT vec_id, k, round(scale, 12) AS scale, list_sum(code)::BIGINT AS code_sum FROM c")
def quantize_16(spark: SparkSession, sf: str) -> DataFrame:
    q = rows(spark, sf).select("vec_id", F.posexplode(V.quantized(F.col("e"), top=32767)).alias("k", "q"))
    return q.select("vec_id", "k", F.round("q.scale", 12).alias("scale"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"))


@query(f"WITH {_E}, {_HALF}, {_Q.format(top=7)} SELECT vec_id, k, list_sum(list_transform(range(1, 33, 2), lambda i: (code[i]::INT & 15) + ((code[i + 1]::INT & 15) << 4)))::BIGINT AS bytes, list_sum(list_transform(range(1, 33), lambda i: i * code[i]))::BIGINT AS codes FROM c")
def pack_nibbles(spark: SparkSession, sf: str) -> DataFrame:
    """Four-bit codes packed two to a byte, and read back with their signs."""
    q = rows(spark, sf).select("vec_id", F.posexplode(V.quantized(F.col("e"), top=7)).alias("k", "q")).select("vec_id", "k", V.packed_nibbles(F.col("q.codes")).alias("data"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c)
    return q.select("vec_id", "k", add(F.col("data")).alias("bytes"), add(F.transform(V.unpacked_nibbles(F.col("data")), lambda c, i: c * (i + 1))).alias("codes"))


@query(f"WITH {_E}, y AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i IN (4, 41) THEN 0 ELSE e[i] END) AS z, e FROM x), h AS (SELECT vec_id, e, k, z[k * 32 + 1:k * 32 + 32] AS p FROM y, (SELECT unnest([0, 1]) AS k)), {_Q.format(top=127)}, b AS (SELECT vec_id, any_value(e) AS e, sum(list_sum(list_transform(range(1, 33), lambda i: (k * 32 + i) * code[i] * scale))) AS coded FROM c GROUP BY vec_id) SELECT vec_id, round(coded + 4 * e[4] + 41 * e[41], 6) AS restored FROM b")
def exact_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Coded vectors with two exact columns, restored."""
    coded = rows(spark, sf).select("vec_id", V.with_exceptions(F.col("e"), [40, 3, 3]).alias("c"))
    return coded.select("vec_id", F.round(V.total(F.transform(V.restored(F.col("c")), lambda v, i: v * (i + 1))), 6).alias("restored"))


_BF = "CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2::DOUBLE, floor(log2(abs(v))) - 7), 0) * pow(2::DOUBLE, floor(log2(abs(v))) - 7) END"


@query(f"WITH {_E}, b AS (SELECT vec_id, e, list_transform(e, lambda v: {_BF}) AS r FROM x) SELECT vec_id, round(list_sum(r), 9) AS rounded, round(list_max(list_transform(range(1, 65), lambda i: abs(e[i] - r[i]))), 9) AS worst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - r[i]) * (e[i] - r[i]))) / list_sum(list_transform(e, lambda v: v * v))), 9) AS relative FROM b")
def bf16_rounding(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors rounded to eight bits of mantissa: their sum, the largest and the relative error."""
    r = rows(spark, sf).withColumn("r", F.transform("e", V.bf16)).withColumn("d", F.zip_with("e", "r", lambda a, b: a.cast("double") - b))
    return r.select("vec_id", F.round(V.total(F.col("r")), 9).alias("rounded"), F.round(F.array_max(F.transform("d", lambda x: F.abs(x))), 9).alias("worst"), F.round(V.relative(F.col("d"), F.col("e")), 9).alias("relative"))


@query(f"WITH {_E}, {_HALF} SELECT vec_id, k, i::INT AS i, round(list_sum(list_transform(range(0, 32), lambda j: p[j + 1] * (1 - 2 * (bit_count(i::INT & j::INT) % 2)))) / sqrt(32), 8) + 0 AS value FROM h, (SELECT unnest(range(0, 32)) AS i)")
def hadamard_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """Every coordinate of both blocks' transforms, by passes of sums and differences."""
    h = halves(spark, sf).select("vec_id", "k", F.posexplode(V.fast_hadamard(F.col("p"))).alias("i", "value"))
    return h.withColumn("value", F.round("value", 8) + 0.0)


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * e[i])), 6) AS back FROM x")
def rotation_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Signs flipped and transformed, and back again: the vector itself."""
    h = halves(spark, sf).withColumn("p", V.unrotated(V.rotated(F.col("p"), 5), 5)).withColumn("part", V.total(F.transform("p", lambda v, i: v * (F.col("k") * 32 + i + 1))))
    return h.groupBy("vec_id").agg(F.round(F.sum("part"), 6).alias("back"))


@query(f"WITH {_E}, {_HALF} SELECT label, k, round(avg(list_max(list_transform(p, lambda v: abs(v))) / sqrt(list_sum(list_transform(p, lambda v: v * v)) / 32)), 6) AS crest FROM h GROUP BY ALL")
def crest_factors(spark: SparkSession, sf: str) -> DataFrame:
    return halves(spark, sf).groupBy("label", "k").agg(F.round(F.avg(V.crest(F.col("p"))), 6).alias("crest"))


@query(f"WITH {_E}, {_HALF}, m AS (SELECT *, list_max(list_transform(p, lambda v: abs(v))) AS m FROM h), f AS (SELECT vec_id, k, f, list_sum(list_transform(p, lambda v: pow(v - least(greatest(round_even(v / (m * f / 7), 0), -7), 7) * (m * f / 7), 2))) AS error FROM m, (SELECT unnest([1.0, 0.95, 0.9, 0.85, 0.8]::DOUBLE[]) AS f)) SELECT vec_id, k, arg_min(f, (error, -f)) AS factor FROM f GROUP BY ALL")
def best_clip_factor(spark: SparkSession, sf: str) -> DataFrame:
    return halves(spark, sf).select("vec_id", "k", V.best_clip(F.col("p")).alias("factor"))


@query(f"""WITH {_E}, s AS (SELECT *, vec_id // 16 AS seq FROM x), z AS (SELECT a.vec_id AS q, b.vec_id AS k, b.e, list_dot_product(a.e, b.e) / 8 AS z FROM s a JOIN s b ON a.seq = b.seq AND b.vec_id <= a.vec_id),
m AS (SELECT q, sum(exp(z)) + 1 AS whole FROM z GROUP BY q) SELECT q AS vec_id, round(sum(exp(z) / whole * list_sum(list_transform(range(1, 65), lambda i: i * e[i]))), 6) AS attended FROM z JOIN m USING (q) GROUP BY q""")
def softmax_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Causal attention inside sequences of 16 vectors, with a sink."""
    r = rows(spark, sf).withColumn("seq", F.floor(F.col("vec_id") / 16))
    return V.attention(r, "seq", "vec_id", "e").select("vec_id", F.round(V.total(F.transform("output", lambda v, i: v * (i + 1))), 6).alias("attended"))


@query(f"""WITH {_E}, b AS (SELECT label, vec_id // 500 AS block, i, min(e[i]) AS low, max(e[i]) AS high FROM x, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), q AS (SELECT vec_id, label, e FROM x WHERE vec_id % 20 = 0)
SELECT vec_id, block, round(sum(greatest(e[i] * low, e[i] * high)), 6) AS bound FROM q JOIN b USING (label) GROUP BY ALL""")
def block_upper_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """For every twentieth vector (the query set) and every block of its label's rows, the greatest product the block may hold."""
    r = rows(spark, sf)
    blocks = V.block_bounds(r.withColumn("block", F.struct("label", F.floor(F.col("vec_id") / 500).alias("k"))), "block", "e", 64)
    asked = r.where("vec_id % 20 = 0").select("vec_id", "label", "e")
    return blocks.withColumn("label", F.col("block.label")).join(asked, "label").select("vec_id", F.col("block.k").alias("block"), F.round(V.bound(F.col("e"), F.col("low"), F.col("high")), 6).alias("bound"))


@query(f"""WITH {_E}, {_HALF}, {_Q.format(top=7)}, d AS (SELECT label, vec_id, k, p, list_transform(range(1, 33), lambda i: p[i] - code[i] * scale) AS d FROM c) SELECT label, round(sqrt(sum(list_sum(list_transform(d, lambda v: v * v))) / sum(list_sum(list_transform(p, lambda v: v * v)))), 8) AS error, round(max(list_max(list_transform(d, lambda v: abs(v)))), 8) AS worst FROM d GROUP BY label""")
def coding_error(spark: SparkSession, sf: str) -> DataFrame:
    """Relative and largest error of four-bit coding by label."""
    r = rows(spark, sf).withColumn("d", F.zip_with("e", V.dequantized(V.quantized(F.col("e"), top=7)), lambda a, b: a.cast("double") - b))
    return r.groupBy("label").agg(F.round(F.sqrt(F.sum(V.dot(F.col("d"), F.col("d"))) / F.sum(V.dot(F.col("e"), F.col("e")))), 8).alias("error"), F.round(F.max(F.array_max(F.transform("d", lambda x: F.abs(x)))), 8).alias("worst"))


@query(f"WITH {_E} SELECT label, (i - 1)::INT AS i, (j - 1)::INT AS j, round(avg(e[i] * e[j]), 8) AS gram FROM x, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of X^T X over all 64 dimensions; a task adds up its rows before anything moves."""
    return V.gram_matrix(table(spark, sf, "embeddings"), "label", "embedding", 64, 8)


@query(f"""WITH {_E}, {_HALF}, {_Q.format(top=7)}, d AS (SELECT label, vec_id, unnest(range(1, 33)) + 32 * k AS col, unnest(p) AS w, unnest(list_transform(range(1, 33), lambda i: p[i] - code[i] * scale)) AS d FROM c),
g AS (SELECT i, j, avg(e[i] * e[j]) AS g FROM x, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL),
m AS (SELECT a.label, sum(a.d * g * b.d) AS d, sum(a.w * g * b.w) AS w FROM d a JOIN g ON a.col = g.i JOIN d b ON a.vec_id = b.vec_id AND a.label = b.label AND b.col = g.j GROUP BY a.label)
SELECT label, round(sqrt(d / w), 8) AS error FROM m""")
def gram_weighted_error(spark: SparkSession, sf: str) -> DataFrame:
    """Error of four-bit coding as the layer behind it sees it: rows weighed by the mean Gram matrix of all vectors."""
    r = rows(spark, sf).withColumn("d", F.zip_with("e", V.dequantized(V.quantized(F.col("e"), top=7)), lambda a, b: a.cast("double") - b))
    gram = V.gram_sums(r.withColumn("all", F.lit(0)), "all", "e", 64).groupBy("i", "j").agg((F.sum("v") / F.sum("n")).alias("gram"))
    return V.row_weighted_error(r, "label", "d", "e", gram, 64).withColumn("error", F.round("error", 8))


@query(f"WITH {_E}, d AS (SELECT label, i, sum(e[i] * e[i]) AS energy FROM x, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY energy DESC, i) AS rn FROM d) SELECT label, list_sort(list((i - 1)::INT) FILTER (rn <= 8)) AS columns, round(sum(energy) FILTER (rn <= 8) / sum(energy), 8) AS share FROM r GROUP BY label")
def strongest_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The eight columns of most energy by label, in column order, and their share of the whole."""
    cells = rows(spark, sf).select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("energy"))
    ranked = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("energy")).alias("m"), "i"))).alias("r"))
    top = F.slice("r", 1, 8)
    return ranked.select("label", F.array_sort(F.transform(top, lambda x: x["i"])).alias("columns"), F.round(V.total(F.transform(top, lambda x: x["m"])) / V.total(F.transform("r", lambda x: x["m"])), 8).alias("share"))


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * e[i] / sqrt(list_sum(list_transform(e, lambda v: v * v)) / 64 + 1e-6))), 6) AS normed FROM x")
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised vectors, weighted by their column numbers and summed."""
    return rows(spark, sf).select("vec_id", F.round(V.total(F.transform(V.rms_norm(F.col("e")), lambda v, i: v * (i + 1))), 6).alias("normed"))


@query(f"WITH {_E} SELECT label, (i - 1)::INT AS i, round(ln(sum(exp(e[i]))), 8) AS log_sum_exp FROM x, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def partial_softmax_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The softmax denominators of all coordinates, merged from per-chunk maxima and sums."""
    from folioflow.operators import measures

    cells = rows(spark, sf).select("label", "vec_id", F.posexplode("e").alias("i", "x")).select(F.struct("label", "i").alias("cell"), "vec_id", F.col("x").cast("double").alias("v"))
    out = measures.log_sum_exp(cells, "cell", F.col("vec_id") % 4, "v", 8)
    return out.select("cell.label", "cell.i", "log_sum_exp")
