"""Selection under quotas: seeded ranks, interleaving, greedy choice with caps and exclusions, prefixes, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import seeded_rank
from folioflow.sources.workspace import stored


def running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """Adds running aggregates in a global order without gathering the rows: sums or maxima of each range are made first.

    Rows are range-partitioned by the order and numbered there; one row per partition meets in one task, and what
    precedes a partition is added back. A sum column is given as ``name=F.sum(..)``, a maximum as ``name=F.max(..)``,
    both by their column: ``("sum", column)`` or ``("max", column)``.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()), "ranged")
    whole = {name: (F.sum if kind == "sum" else F.max)(c).alias(name) for name, (kind, c) in sums.items()}
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("range_part").agg(*whole.values())
    ahead = ahead.select("range_part", *((F.sum if kind == "sum" else F.max)(name).over(before).alias(f"{name}_before") for name, (kind, _) in sums.items()))
    inside = Window.partitionBy("range_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(ahead), "range_part")  # a row per partition
    for name, (kind, c) in sums.items():
        own = (F.sum if kind == "sum" else F.max)(c).over(inside)
        out = out.withColumn(name, own + F.coalesce(f"{name}_before", F.lit(0)) if kind == "sum" else F.greatest(own, F.col(f"{name}_before")))
    return out.drop("range_part", *(f"{n}_before" for n in sums))


def prefix_to_target(df: DataFrame, amount: str, target: float, *order: str) -> DataFrame:
    """Rows in order up to the first whose running sum reaches the target."""
    return running(df, list(order), running=("sum", F.col(amount))).where(F.col("running") - F.col(amount) < target)


def leaving(df: DataFrame, index: str, arrival: str) -> DataFrame:
    """Ordered emission: when each index may leave, given that indexes leave in order."""
    return running(df.select(index, arrival), [index], leaves_at=("max", F.col(arrival))).select(index, "leaves_at")


def cohorts(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows of a group in batches of ``size`` in order; a group's rows may lie in many tasks."""
    out = running(df.withColumn("one", F.lit(1)), [group, order], place=("sum", F.col("one")))
    first = out.groupBy(group).agg(F.min("place").alias("first"))
    return out.join(first, group).withColumn("cohort", F.floor((F.col("place") - F.col("first")) / size)).drop("one", "place", "first")


def interleaved(df: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    """Groups take turns, the first row of each, then the second, up to ``most`` each: (turn, place) is the order."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= most)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy(group)))


def best_of_family(df: DataFrame, family: str, priority: Column, seed: str, key: str) -> DataFrame:
    """One row per family: least priority, then the seeded rank; aggregated, not sorted."""
    best = F.min(F.struct(priority.alias("priority"), seeded_rank(seed, F.col(key)).alias("rank"), F.struct(*df.columns).alias("row")))
    return df.groupBy(F.col(family).alias("family_key")).agg(best.alias("b")).select("b.row.*", "b.priority")


def one_per_family(df: DataFrame, family: str, category: str, categories: list[str], quota: int, seed: str, key: str) -> DataFrame:
    """Greedy, category by category: the first ``quota`` families by seeded rank that no earlier category took."""
    rank = seeded_rank(seed, F.col(category), F.col(key))
    pool = df.withColumn("rank", rank)
    taken = None
    for name in categories:
        own = pool.where(F.col(category) == name)
        if taken is not None:
            own = own.join(taken.select(family).distinct(), family, "left_anti")
        best = own.groupBy(family).agg(F.min(F.struct("rank", key)).alias("b")).orderBy("b.rank", f"b.{key}").limit(quota)
        found = stored(best.select(family, F.col(f"b.{key}").alias(key), F.lit(name).alias(category)), "chosen")  # quota rows
        taken = found if taken is None else taken.unionByName(found)
    return taken


def filled(df: DataFrame, family: str, key: str, target: int, cap: int, seed: str, excluded: DataFrame | None = None) -> DataFrame:
    """The first ``target`` rows by seeded rank with at most ``cap`` of a family; families of the other split are left out."""
    pool = df if excluded is None else df.join(excluded.select(family).distinct(), family, "left_anti")
    ranked = pool.withColumn("rank", seeded_rank(seed, F.col(key)))
    capped = ranked.withColumn("nth", F.row_number().over(Window.partitionBy(family).orderBy("rank", key))).where(F.col("nth") <= cap)
    return capped.orderBy("rank", key).limit(target).drop("nth", "rank")


def priority_union(first: DataFrame, rest: DataFrame, family: str, key: str, limit: int, share: int, cap: int) -> DataFrame:
    """Rows of the first kind up to a share of the limit, then the others, at most ``cap`` of a family."""
    head = first.orderBy(key).limit(limit // share).withColumn("kind", F.lit(0))
    both = head.unionByName(rest.join(head.select(key), key, "left_anti").withColumn("kind", F.lit(1)))
    capped = both.withColumn("nth", F.row_number().over(Window.partitionBy(family).orderBy("kind", key))).where(F.col("nth") <= cap)
    return capped.orderBy("kind", key).limit(limit).drop("nth", "kind")


def blinded(outputs: DataFrame, by: list[str], name: str, seed: str) -> DataFrame:
    """Equal outputs under one letter, in seeded order: (letter, by.., n), with the number of different names that gave them."""
    groups = outputs.groupBy(*by).agg(F.countDistinct(name).alias("n"))
    return groups.withColumn("letter", F.dense_rank().over(Window.partitionBy(by[0]).orderBy(seeded_rank(seed, *(F.col(c) for c in by)))))


def separated(tiles: DataFrame, page: str, x: str, y: str, score: str, size: int, most: int) -> DataFrame:
    """Greedy choice of up to ``most`` tiles of a page by score that don't overlap; a page's tiles are one array."""
    best = tiles.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), (-F.col(y)).alias("y"), (-F.col(x)).alias("x"))), asc=False).alias("tiles"))
    none = F.array().cast(best.schema["tiles"].dataType)
    apart = lambda a, b: (F.abs(a["x"] - b["x"]) >= size) | (F.abs(a["y"] - b["y"]) >= size)
    chosen = F.aggregate("tiles", none, lambda kept, t: F.when((F.size(kept) < most) & F.forall(kept, lambda k: apart(k, t)), F.concat(kept, F.array(t))).otherwise(kept))
    return best.select(page, F.posexplode(chosen).alias("nth", "t")).select(page, "nth", (-F.col("t.x")).alias(x), (-F.col("t.y")).alias(y), F.col("t.s").alias(score))


def abba(processes: int) -> list[str]:
    """Alternating arms, each pair reversed after the last: A B B A A B .."""
    return [arm for k in range(processes) for arm in ("AB" if k % 2 == 0 else "BA")]
