"""Dedup, sampling, ranking and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import seeded_rank


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by a total order; map-side aggregation instead of a window, so hot keys don't sort."""
    rest = F.struct(*order, F.struct(*df.columns).alias("kept_row"))
    return df.groupBy(key.alias("dedup_key")).agg(F.min(rest).alias("r")).select("r.kept_row.*")


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def seeded_quota(df: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group in seeded pseudorandom order."""
    return top_k(df.withColumn("rank_hash", seeded_rank(seed, F.col(group), F.col(key))), group, k, F.col("rank_hash"), F.col(key))


def hash_split(key: Column) -> Column:
    """train, val or test (70/15/15) by the SHA-256 of a key modulo 100, folded over its hex digits."""
    digits = F.split(F.sha2(key.cast("string"), 256), "")
    left = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("int")) % 100)
    return F.when(left < 70, "train").when(left < 85, "val").otherwise("test")


def round_robin(df: DataFrame, group: str, k: int, *order: str) -> DataFrame:
    """Groups take turns: the first row of every group, then the second, to k rows each."""
    return top_k(df, group, k, *map(F.col, order))


def gate_category(category: Column, characters: Column, least: int = 100, other: str = "other") -> Column:
    """A row's category; without one it is ``other`` if it has ``least`` characters, else none."""
    return F.coalesce(category, F.when(characters >= least, other))


def without_named(df: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose base name doesn't match a pattern, and the distinct names that were dropped; null paths stay."""
    name = F.regexp_extract(F.col(path), r"([^/\\]*)$", 1)
    hit = F.coalesce(name.rlike(pattern), F.lit(False))
    return df.where(~hit), df.where(hit).select(name.alias("name")).distinct()
