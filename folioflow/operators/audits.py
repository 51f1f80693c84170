"""Audits of runs: contracts, one-to-one matches, recomputed reports, shared strata."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_names(marks: dict[str, Column]) -> Column:
    """Names whose condition holds, in the order given; a null condition counts as not holding."""
    return F.filter(F.array(*(F.when(mark, F.lit(name)) for name, mark in marks.items())), lambda x: x.isNotNull())


def unmet(values: Column, expected: dict[str, str]) -> Column:
    """(missing, differing) names of a map against the values that a contract expects."""
    absent = {k: values[k].isNull() for k in expected}
    other = {k: values[k] != v for k, v in expected.items()}
    return F.struct(kept_names(absent).alias("missing"), kept_names(other).alias("differing"))


def matched(one: DataFrame, two: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem) for keys that are not once on either side with one digest.

    Both sides are counted in one aggregate, so a key that occurs very often meets as one partial row per task.
    """
    both = one.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"), F.col(digest).alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        two.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"), F.lit(None).cast("string").alias("a"), F.col(digest).alias("b"))
    )
    counts = both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.min("a").alias("a"), F.min("b").alias("b"))
    problem = F.when(F.col("r") == 0, "missing").when(F.col("l") == 0, "unexpected").when((F.col("l") > 1) | (F.col("r") > 1), "repeated").when(~F.col("a").eqNullSafe(F.col("b")), "other content")
    return counts.select(key, problem.alias("problem")).where("problem is not null")


def side_by_side(rows: DataFrame, keys: list[str], run: Column, runs: dict[str, object], value: Column) -> DataFrame:
    """Sum of a value for each named run beside the others; null where a run has none."""
    return rows.groupBy(*keys).agg(*(F.sum(F.when(run == which, value)).alias(name) for name, which in runs.items()))


def shared_stratum(rows: DataFrame, candidate: str, stratum: str) -> DataFrame:
    """The rows of the one stratum that all candidates were measured in and that has the most rows; ties go to the smallest."""
    cells = rows.groupBy(stratum, candidate).agg(F.count("*").alias("n"))
    all_of_them = cells.agg(F.countDistinct(candidate).alias("candidates"))
    whole = cells.groupBy(stratum).agg(F.count("*").alias("met"), F.sum("n").alias("n")).join(F.broadcast(all_of_them), F.col("met") == F.col("candidates"))
    best = whole.agg(F.min_by(stratum, F.struct(-F.col("n"), F.col(stratum))).alias(stratum))
    return rows.join(F.broadcast(best), stratum)


def families(rows: DataFrame, key: str, overrides: DataFrame, rules: list[tuple[Column, Column]], otherwise: Column) -> DataFrame:
    """Adds family: an override (key, family) of that row, else the first rule (condition, family) that holds, else the last resort."""
    ruled = otherwise
    for holds, family in reversed(rules):
        ruled = F.when(holds, family).otherwise(ruled)
    given = overrides.groupBy(key).agg(F.min("family").alias("reviewed"))
    return rows.join(given, key, "left").withColumn("family", F.coalesce("reviewed", ruled)).drop("reviewed")


SIGNATURE = ("n", "part0", "part1", "part2", "part3")


def signatures(rows: DataFrame, keys: list[str], output: list[str]) -> DataFrame:
    """(keys, n, part0 .. part3): a digest of each key's output rows as a multiset of whole rows.

    It counts rows and adds four 48-bit parts of each one's SHA-256, so it sums in any order and no output is gathered; to keep
    order, have the place among the output's columns.
    """
    whole = F.sha2(F.to_json(F.struct(*(F.col(c) for c in output)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("digest", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"part{k}") for k in range(4)]
    return rows.select(*keys, whole.alias("digest")).groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def repetitions(rows: DataFrame, case: list[str], repetition: str, output: list[str]) -> DataFrame:
    """(case, repetitions, identical): whether all repetitions of a case gave the same output rows.

    Digests don't compress and there are as many as repetitions; rows that are dealt by case beforehand need no shuffle of them.
    """
    each = signatures(rows, [*case, repetition], output)
    one = functools.reduce(Column.__and__, (F.min(c) == F.max(c) for c in SIGNATURE))
    return each.groupBy(*case).agg(F.count("*").alias("repetitions"), one.alias("identical"))


def same_outputs(one: DataFrame, two: DataFrame, keys: list[str], output: list[str]) -> DataFrame:
    """(keys, same_tokens, same_length, exact) of the keys that both runs have."""
    other = signatures(two, keys, output).withColumnsRenamed({c: f"other_{c}" for c in SIGNATURE})
    equal = lambda names: F.struct(*names).eqNullSafe(F.struct(*(F.col(f"other_{c}").alias(c) for c in names)))
    return signatures(one, keys, output).join(other, keys).select(*keys, equal(SIGNATURE).alias("same_tokens"), equal(("n",)).alias("same_length"), equal(SIGNATURE).alias("exact"))


def repeated(rows: DataFrame, keys: dict[str, list[str]], carried: str) -> DataFrame:
    """(carried, key, n): for each named key that must be unique, its values that occur more than once; nulls are values."""
    twice = [rows.groupBy(*{carried: 0, **dict.fromkeys(columns)}).agg(F.count("*").alias("n")).where("n > 1").select(carried, F.lit(name).alias("key"), "n") for name, columns in keys.items()]
    return functools.reduce(DataFrame.unionByName, twice)
