"""Next-token proposals from earlier n-grams, accepted runs, and the policy that decides when to draft."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches


def _merged(lists: Column) -> Column:
    """Lists of one place as one: all first tokens, then all second ones, and so on."""
    longest = F.array_max(F.transform(lists, F.size))
    at = lambda k: F.transform(F.filter(lists, lambda own: F.size(own) > k), lambda own: F.get(own, k))
    return F.when(F.size(lists) == 1, F.get(lists, F.lit(0))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), at)))


def last_occurrences(parts: DataFrame, document: str, at: str, tokens: str, joined: str, size: int = 4, tasks: int | None = None) -> DataFrame:
    """(document, gram, last): the index of a lookup, each gram's latest place in its document, counted from 1.

    parts: document, ``at``, and an array of tokens; a document's tokens are those of its parts in the order of ``at`` (null
    last), of parts at one place the first tokens before the second ones. Grams are joined with ``joined``, which no
    token holds; those with null tokens are left out. Parts, not tokens, are dealt and sorted, to ``tasks`` tasks; a gram
    across parts has its first tokens from the ends of the parts before.
    """
    whole = parts.where(F.size(tokens) > 0).select(document, at, F.col(tokens).alias("tokens"))
    dealt = whole.repartition(tasks, document) if tasks else whole.repartition(document)
    placed = dealt.groupBy(document, at).agg(F.array_sort(F.collect_list("tokens")).alias("lists")).select(document, at, _merged(F.col("lists")).alias("tokens"))
    order = Window.partitionBy(document).orderBy(F.asc_nulls_last(at))
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - size + 2, F.lit(1)), size - 1)
    ends = placed.withColumn("tail", tail(F.col("tokens"))) if size > 1 else placed.withColumn("tail", F.slice("tokens", 1, 0))
    none = F.slice("tail", 1, 0)
    earlier = [F.coalesce(F.lag("tail", k).over(order), none) for k in range(size - 1, 0, -1)] or [none]
    start = F.coalesce(F.sum(F.size("tokens")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ends.select(document, "tokens", start.alias("start"), tail(F.concat(*earlier)).alias("before") if size > 1 else none.alias("before"))
    rows = rows.select(document, (F.col("start") - F.size("before")).alias("start"), F.concat("before", "tokens").alias("all")).where(F.size("all") >= size)
    pieces = lambda i: [x for k in range(size) for x in (F.lit(joined), F.get("all", i + k))][1:]
    grams = F.transform(F.slice("all", size, F.size("all")), lambda _, i: F.concat(*pieces(i)))  # null if a token is
    each = rows.select(document, "start", F.posexplode(grams).alias("i", "gram")).where("gram is not null").select(document, "gram", (F.col("start") + F.col("i") + size).alias("at"))
    return each.groupBy(document, "gram").agg(F.max("at").alias("last"))


def proposals(rows: DataFrame, key: str, tokens: str, longest: int = 4, least: int = 2, draft: int = 8, history: str | None = None) -> DataFrame:
    """(key, size, start, draft): what followed the latest earlier occurrence of the longest tail gram.

    Sizes go from ``longest`` down to ``least`` within the row's tokens; failing that, a full ``longest`` gram is sought
    in ``history`` (earlier pages of the document, apart by -1, which no match crosses). A continuation that runs into
    the end repeats with the period from its start. No match gives no row.
    """

    def propose(own: list[int], past: list[int]):
        n = len(own)
        for size in range(min(longest, n - 1), least - 1, -1):
            tail = own[n - size :]
            for start in range(n - size - 1, -1, -1):
                if own[start : start + size] == tail:
                    begin = start + size
                    return size, begin, [own[begin + k % (n - begin)] for k in range(draft)]
        if n >= longest:
            tail = own[n - longest :]
            for start in range(len(past) - longest, -1, -1):
                if past[start : start + longest] == tail:
                    begin = start + longest
                    ahead = past[begin : begin + draft]
                    ahead = ahead[: ahead.index(-1)] if -1 in ahead else ahead
                    if ahead:
                        return longest, -1, ahead
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            past = batch["history"].to_pylist()
            found = [(k, *hit) for k, own, p in zip(batch[key].to_pylist(), batch["tokens"].to_pylist(), past, strict=True) if own and (hit := propose(own, p or []))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.list_(pa.int64()))], names=[key, "size", "start", "draft"])

    small_batches(rows.sparkSession)
    past = F.col(history) if history else F.lit(None)
    some = rows.select(F.col(key).cast("long").alias(key), F.col(tokens).cast("array<bigint>").alias("tokens"), past.cast("array<bigint>").alias("history"))
    return some.mapInArrow(run, f"{key} long, size int, start int, draft array<bigint>")


def accepted(draft: Column, truth: Column) -> Column:
    """Length of the leading run of matches."""
    same = F.zip_with(draft, F.slice(truth, 1, F.greatest(F.size(draft), F.lit(1))), lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(draft), F.size(truth)).cast("long"))


def drafting(steps: DataFrame, by: str, at: str, rate: str, extra: str, single: str, alpha: float = 0.15, start: float = 0.6, probe: int = 16) -> DataFrame:
    """(by, at, smooth, draft): a smoothed acceptance rate against its cost, with a probe every ``probe`` idle steps.

    The state (rate, idle steps) is folded over a key's ordered steps.
    """
    rows = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(rate).cast("double").alias("r"), (F.col(extra) / F.col(single)).alias("cost")))).alias("steps"))
    state = F.struct(F.lit(start).alias("smooth"), F.lit(0).alias("idle"), F.array().cast("array<struct<at:bigint,smooth:double,draft:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        draft = (s["smooth"] > x["cost"]) | (s["idle"] >= probe - 1)
        smooth = F.when(draft, s["smooth"] * (1 - alpha) + x["r"] * alpha).otherwise(s["smooth"])
        return F.struct(smooth.alias("smooth"), F.when(draft, 0).otherwise(s["idle"] + 1).alias("idle"), F.concat(s["out"], F.array(F.struct(x["at"].cast("long").alias("at"), smooth.alias("smooth"), draft.alias("draft")))).alias("out"))

    return rows.select(by, F.explode(F.aggregate("steps", state, step, lambda s: s["out"])).alias("x")).select(by, F.col("x.at").alias(at), "x.smooth", "x.draft")
