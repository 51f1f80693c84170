"""Runs, islands, loops and ordered folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches


def islands(df: DataFrame, by: str, at: str, flag: str, least: int = 1) -> DataFrame:
    """(by, start, length) of runs of consecutive rows with a true flag."""
    w = Window.partitionBy(by).orderBy(at)
    runs = df.withColumn("gap", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)).where(flag)
    return runs.groupBy(by, "gap").agg(F.min(at).alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("gap")


def lag_run_loop(tokens: DataFrame, by: str, at: str, token: str, periods: int, least: int) -> DataFrame:
    """(by, stop, period): the first place where tokens repeat those p back so long that run + p >= max(least, 4 p)."""
    w = Window.partitionBy(by).orderBy(at)
    back = F.array(*(F.struct(F.lit(p).alias("p"), F.col(token).eqNullSafe(F.lag(token, p).over(w)).alias("same")) for p in range(1, periods + 1)))
    long = tokens.select(by, at, back.alias("back")).select(by, at, F.explode("back").alias("x")).select(by, at, "x.*")
    per = Window.partitionBy(by, "p").orderBy(at)
    broken = F.coalesce(F.max(F.when(~F.col("same"), F.col(at))).over(per), F.lit(-1))
    found = long.withColumn("run", F.col(at) - broken).where(F.col("same") & (F.col("run") + F.col("p") >= F.greatest(F.lit(least), 4 * F.col("p"))))
    return found.groupBy(by).agg(F.min(F.struct(at, "p")).alias("first")).select(by, F.col(f"first.{at}").alias("stop"), F.col("first.p").alias("period"))


def run_points(ids: np.ndarray, p: int, need: int) -> np.ndarray:
    """Places, every run of ``need`` equal to those p back has one: grid points from which eight places in a row are equal."""
    step = need - 7
    at = np.arange(p + step - 1, len(ids) - 7, step)
    for k in range(8):
        at = at[ids[at + k] == ids[at + k - p]]
        if not len(at):
            break
    return at


def may_run(ids: np.ndarray, ends: np.ndarray, needs: dict[int, int]) -> dict[int, list[int]]:
    """For each of many sequences, laid end to end in ``ids`` up to its end, the p for which it may have a run of ``needs[p]`` places equal to those p back.

    One pass over all of them for each p; sequences without any are left out. A needed run below 16 places is too short
    for the grid, so then all may.
    """
    found: dict[int, list[int]] = {}
    for p, need in needs.items():
        for i in np.unique(np.searchsorted(ends, run_points(ids, p, need), "right")).tolist() if need >= 16 else range(len(ends)):
            found.setdefault(i, []).append(p)
    return found


def exact_needs(periods: int, least: int, repeats: int = 4) -> dict[int, int]:
    """The equal places that a loop of each period needs."""
    return {p: max(least, repeats * p) - p for p in range(1, periods + 1)}


def first_loop(ids: np.ndarray, periods: int, least: int, repeats: int = 4, among: list[int] | None = None) -> tuple[int, int] | None:
    """(stop, period) as in lag_run_loop, of one row's tokens; of two periods at one place the shorter. ``among``: the only periods that may be found, if known."""
    best = None
    for p in range(1, periods + 1) if among is None else among:
        if p >= len(ids):
            break
        need = max(least, repeats * p) - p
        if need >= 16 and not len(run_points(ids, p, need)):
            continue
        edges = np.r_[-1, np.flatnonzero(ids[p:] != ids[:-p]), len(ids) - p]
        long = np.flatnonzero(np.diff(edges) > need)
        if len(long) and (best is None or edges[long[0]] + need + p < best[0]):
            best = int(edges[long[0]]) + need + p, p
    return best


def _named(words: pa.Array) -> np.ndarray:
    """Words as numbers, equal where the words are; numbers stay as they are."""
    return words.to_numpy(zero_copy_only=False) if pa.types.is_integer(words.type) and not words.null_count else words.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def loops(rows: DataFrame, by: str, words: str, periods: int, least: int) -> DataFrame:
    """(by, stop, period) of lag_run_loop over arrays of words or their hashes; a row per period would be too many for long periods."""
    small_batches(rows.sparkSession)
    needs = exact_needs(periods, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lists = batch[words]
            keys, ids, ends = batch[by].to_pylist(), _named(lists.flatten()), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, among in sorted(may_run(ids, ends, needs).items()):
                if hit := first_loop(ids[ends[i - 1] if i else 0 : ends[i]], periods, least, among=among):
                    found.append((keys[i], *hit))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=[by, "stop", "period"])

    some = rows.select(F.col(by).cast("long").alias(by), words).where(F.size(words) >= least)
    return some.mapInArrow(run, f"{by} long, stop long, period long")


def tail_repeats(words: Column, longest: int) -> Column:
    """Whether the words end with a block of at most so many words three times. Bound in lambdas, so computed once."""
    block = lambda t, k, n: F.slice(t, n * k + 1, k)
    same = lambda t: F.exists(F.sequence(F.lit(1), F.lit(longest)), lambda k: (F.size(t) >= 3 * k) & (block(t, k, 0) == block(t, k, 1)) & (block(t, k, 0) == block(t, k, 2)))
    return F.exists(F.array(F.slice(F.reverse(words), 1, 3 * longest)), same)


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """(by, session, first, last, n): events apart by more than the gap begin a session."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = (micros - F.lag(micros).over(w) > gap_seconds * 1_000_000).cast("int")
    return events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w)).groupBy(by, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def moving_average(df: DataFrame, by: str, at: list[str], value: str, alpha: float) -> DataFrame:
    """The exponential average after a key's last row, the first one seeding it; an ordered fold of the key's array."""
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*at, value))).alias("rows"))
    start = F.get("rows", F.lit(0))[value].cast("double")
    fold = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), start, lambda acc, r: acc * (1 - alpha) + r[value] * alpha)
    return rows.select(by, F.round(fold, 6).alias("ema"))
