"""Aggregates: rates, gates, percentiles, brackets, divergence, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.sampling import running


def rates(df: DataFrame, group: str, edits: Column, length: Column) -> DataFrame:
    """Micro (ratio of sums) and macro (mean of ratios) rates by group, over rows with a length."""
    rows = df.select(group, edits.alias("edits"), length.alias("length"))
    some = F.col("length") > 0
    return rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum(F.when(~some, 1).otherwise(0)).alias("n_empty"),
        F.round(F.sum(F.when(some, F.col("edits"))) / F.sum(F.when(some, F.col("length"))), 6).alias("micro"),
        F.round(F.avg(F.when(some, F.col("edits") / F.col("length"))), 6).alias("macro"),
    )


def quantiles(df: DataFrame, keys: list[str], value: str, **points: float) -> DataFrame:
    """The keys and a linear quantile for each named point; null values don't count, groups without others have no row.

    Rows are ranked over range partitions of (keys, value), so a group may lie in many tasks; only the rows at the ranks
    that are asked for meet by group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("group"), F.col(value).alias("value"))
    ranked = running(rows.withColumn("one", F.lit(1)), ["group", "value"], place=("sum", F.col("one")))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per group
    at = ranked.join(sizes.withColumn("first", first), "group").withColumn("rank", F.col("place") - F.col("first") - 1)
    where = lambda q: (F.col("n") - 1) * q
    pick = lambda q, side: F.max(F.when(F.col("rank") == side(where(q)), F.col("value")))
    line = lambda q: pick(q, F.floor) + (pick(q, F.ceil) - pick(q, F.floor)) * F.max(where(q) - F.floor(where(q)))
    near = F.max(F.when(F.col("rank") == F.ceil(0.95 * F.col("n")) - 1, F.col("value")))
    return at.groupBy("group").agg(*(line(q).alias(name) for name, q in points.items()), near.alias("nearest_p95")).select(*(F.col(f"group.{k}").alias(k) for k in keys), *points, "nearest_p95")


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median, linear p10 and nearest-rank p95 by group, over ranges of rows as in ``quantiles``."""
    return quantiles(df, [group], value, median=0.5, p10=0.1).select(group, F.round("median", 6).alias("median"), F.round("p10", 6).alias("p10"), F.round("nearest_p95", 6).alias("p95"))


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation from sums that merge."""
    s, q, n = F.sum(value), F.sum(F.col(value) * F.col(value)), F.count(value)
    return df.groupBy(group).agg(n.alias("n"), F.round(s / n, 6).alias("mean"), F.round(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), 4).alias("deviation"))


def gate(df: DataFrame, group: str, reference: Column, candidate: Column, limit: float, least: int) -> DataFrame:
    """Whether each group's mean rises by at most ``limit``; groups of fewer than ``least`` rows pass."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(candidate) - F.avg(reference), 6).alias("change")).withColumn("passed", (F.col("n") < least) | (F.col("change") <= limit))


def tolerance_argmin(df: DataFrame, group: str, candidate: str, cost: str, within: float = 0.02) -> DataFrame:
    """The smallest candidate whose median cost is within ``within`` of the group's best."""
    med = quantiles(df.select(group, candidate, cost), [group, candidate], cost, median=0.5).select(group, candidate, F.col("median").alias("cost"))
    best = med.withColumn("best", F.min("cost").over(Window.partitionBy(group)))
    return best.where(F.col("cost") <= F.col("best") * (1 + within)).groupBy(group).agg(F.min(candidate).alias(candidate))


def bracketed(df: DataFrame, case: str, slot: str, ms: str) -> DataFrame:
    """(case, a, c, b): medians of the controls (slots 0 and 2) and the candidate (1)."""
    medians = quantiles(df.where(F.col(slot).isin(0, 1, 2)), [case, slot], ms, median=0.5)
    m = lambda k: F.max(F.when(F.col(slot) == k, F.col("median")))
    return medians.groupBy(case).agg(m(0).alias("a"), m(1).alias("c"), m(2).alias("b"))


def bracket(df: DataFrame, case: str, slot: str, ms: str) -> DataFrame:
    """Drift of the controls before and after a candidate, and its gain over each."""
    a, c, b = F.col("a"), F.col("c"), F.col("b")
    return bracketed(df, case, slot, ms).select(
        case, F.round(F.abs(a - b) / F.least(a, b), 6).alias("drift"), F.round(1 - c / a, 6).alias("gain_before"), F.round(1 - c / b, 6).alias("gain_after"), (F.abs(a - b) / F.least(a, b) <= 0.05).alias("stable")
    )


def divergence(p: DataFrame, q: DataFrame, group: str, key: str, weight: str, k: int = 32) -> DataFrame:
    """Kullback-Leibler divergence of two distributions per group over p's top k keys, the rest pooled."""
    share = lambda df, name: df.withColumn(name, F.col(weight) / F.sum(weight).over(Window.partitionBy(group))).select(group, key, name)
    top = share(p, "p").withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("p"), key))).where(F.col("rn") <= k)
    both = top.join(share(q, "q"), [group, key], "left").withColumn("q", F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-300)))
    rest_p, rest_q = 1 - F.sum("p"), F.greatest(1 - F.sum("q"), F.lit(1e-300))
    tail = F.when(rest_p > 1e-12, rest_p * F.ln(rest_p / rest_q)).otherwise(0.0)
    return both.groupBy(group).agg(F.round(F.greatest(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))) + tail, F.lit(0.0)), 6).alias("kl"))


def rank_biserial(df: DataFrame, group: str, flag: Column, value: str) -> DataFrame:
    """Rank-biserial correlation of a flag with a value per group, from the U statistic with mean ranks for ties.

    Equal values are counted before the window, so it sees one row per distinct value. Groups that lack either side get null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(flag).alias("ones"), F.count_if(~flag).alias("zeros"))
    below = F.sum("zeros").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    wins = counts.withColumn("wins", F.col("ones") * (F.coalesce(below, F.lit(0)) + F.col("zeros") / 2))
    pairs = F.sum("ones").cast("double") * F.sum("zeros")
    return wins.groupBy(group).agg(F.round(2 * F.sum("wins") / F.nullif(pairs, F.lit(0.0)) - 1, 6).alias("rank_biserial"))


def log_sum_exp(df: DataFrame, group: str, chunk: Column, value: str, digits: int = 6) -> DataFrame:
    """The softmax denominator's logarithm per group, merged from chunks that each hold (maximum, sum of exp(x - maximum))."""
    top = df.select(group, chunk.alias("chunk"), value)
    parts = top.join(top.groupBy(group, "chunk").agg(F.max(value).alias("m")), [group, "chunk"]).groupBy(group, "chunk", "m").agg(F.sum(F.exp(F.col(value) - F.col("m"))).alias("s"))
    merged = parts.groupBy(group).agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "s")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["s"] * F.exp(p["m"] - F.col("top")))
    return merged.select(group, F.round(F.col("top") + F.ln(total), digits).alias("log_sum_exp"))


def best_threshold(df: DataFrame, group: str, score: Column, truth: Column, grid: list[float], least_precision: float) -> DataFrame:
    """(group, threshold, recall): of a fixed grid, the threshold of most recall whose precision suffices; ties go to the least.

    One pass counts every threshold's hits on the map side; rows are not multiplied by the grid.
    """
    rows = df.select(group, score.alias("score"), truth.alias("truth"))
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if((F.col("score") >= t) & F.col("truth")).alias("tp"), F.count_if(F.col("score") >= t).alias("n")) for t in grid]
    counted = rows.groupBy(group).agg(F.count_if("truth").alias("positives"), F.array(*cells).alias("cells"))
    each = counted.select(group, "positives", F.explode("cells").alias("c")).select(group, "positives", "c.*").where((F.col("n") > 0) & (F.col("tp") >= least_precision * F.col("n")) & (F.col("positives") > 0))
    best = each.groupBy(group).agg(F.min(F.struct((-F.col("tp")).alias("m"), "threshold", "positives")).alias("b"))
    return best.select(group, F.col("b.threshold").alias("threshold"), F.round(-F.col("b.m") / F.col("b.positives"), 6).alias("recall"))
