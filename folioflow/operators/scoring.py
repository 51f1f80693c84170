"""Tree tables, routes, labels and their evaluation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_trees(text: str, features: list[str], most: int = 10_000) -> dict:
    """A model ``{version, features, baseline, trees: [[node, ..], ..]}``, checked.

    A node is a leaf ``{value}`` or ``{feature, threshold, left, right}`` with children further on in its tree.
    """
    model = json.loads(text)
    if model.get("version") != 1 or model.get("features") != features:
        raise ValueError("another version or other features")
    for tree in model["trees"]:
        if not 0 < len(tree) <= most:
            raise ValueError("an empty or too large tree")
        for at, node in enumerate(tree):
            fine = set(node) == {"value"} or set(node) == {"feature", "threshold", "left", "right"} and node["feature"] < len(features) and at < min(node["left"], node["right"]) and max(node["left"], node["right"]) < len(tree)
            if not fine:
                raise ValueError(f"node {at} has another shape")
    return model


def exported(baseline: float, trees: list[list[dict]], features: list[str]) -> str:
    return json.dumps({"version": 1, "features": features, "baseline": baseline, "trees": trees}, sort_keys=True)


def tree_score(model: dict, features: list[Column]) -> Column:
    """Baseline plus the leaf of each tree, in their order; a value at the threshold goes left. Stays inside codegen."""

    def at(tree: list[dict], k: int) -> Column:
        node = tree[k]
        if "value" in node:
            return F.lit(float(node["value"]))
        return F.when(features[node["feature"]] <= node["threshold"], at(tree, node["left"])).otherwise(at(tree, node["right"]))

    total = F.lit(float(model["baseline"]))
    for tree in model["trees"]:
        total = total + at(tree, 0)
    return total


def chosen(scores: dict[int, Column], line: Column, long_side: Column, least_line: float = 8.0, whole: int = 1536) -> Column:
    """The smallest size whose score isn't negative and whose lines are high enough when scaled, else the whole size."""
    out = F.lit(whole)
    for size in sorted(scores, reverse=True):
        out = F.when((scores[size] >= 0) & (line * F.least(F.lit(1.0), size / long_side) >= least_line), size).otherwise(out)
    return out


def cleared(shares: dict[int, Column], thresholds: dict[int, float], whole: int = 1536) -> Column:
    """The lowest size whose probability reaches its threshold."""
    out = F.lit(whole)
    for size in sorted(shares, reverse=True):
        out = F.when(shares[size] >= thresholds[size], size).otherwise(out)
    return out


def acceptable(disagreement: Column, noise: Column, stop: Column, one: Column, two: Column, tolerance: float = 0.02, margin: float = 0.01) -> Column:
    """Noise-aware label: disagreement within the larger of a tolerance and the noise, and a stop that a reference had."""
    return (disagreement <= F.greatest(F.lit(tolerance), noise + margin)) & (stop.eqNullSafe(one) | stop.eqNullSafe(two))


def margin_decision(first: Column, second: Column, error: Column) -> Column:
    """must-match where the two best are further apart than twice the error, else near-tie."""
    return F.when(first - second > 2 * error, "must-match").otherwise("near-tie")


def policy_grid(rows: DataFrame, score: Column, cost_low: Column, cost_high: Column, wrong: Column, grid: list[float], budget: float) -> DataFrame:
    """(threshold, saved, wrong, allowed) of sending rows at or above a threshold the cheap way, for a fixed grid in one pass."""
    cells = [F.struct(F.lit(t).alias("threshold"), (1 - F.sum(F.when(score >= t, cost_low).otherwise(cost_high)) / F.sum(cost_high)).alias("saved"), (F.count_if((score >= t) & wrong) / F.count("*")).alias("wrong")) for t in grid]
    each = rows.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    return each.withColumn("allowed", F.col("wrong") <= budget)


def budget_of(requested: Column, used: Column, context: int, fit: Column) -> Column:
    """The output budget: as requested, or what is left of the context where it may be fitted; an error where nothing fits."""
    left = context - used
    return F.when(requested <= left, requested).when(fit & (left > 0), left).otherwise(F.raise_error(F.lit("no room for the output")).cast("int"))


def page_seconds(inputs: Column, outputs: Column) -> Column:
    """Cost model of a page; its factors are fixed values."""
    return (0.33 * inputs + 0.000049 * inputs * inputs + outputs * (4.3 + 0.00064 * inputs) / 1.47) / 1000


def speeds(ms: Column, first_ms: Column, tokens: Column) -> Column:
    return F.struct((ms / 1000).alias("seconds"), ((ms - first_ms) / F.greatest(tokens - 1, F.lit(1))).alias("ms_per_token"))


def confidence(log_p: Column, k: int = 32) -> Column:
    """Mean, least, shares below one half and nine tenths of the first k probabilities, and whether there are fewer."""
    some = F.slice(log_p, 1, k)
    share = lambda t: F.aggregate(some, F.lit(0.0), lambda s, x: s + (F.exp(x) < t).cast("double")) / F.size(some)
    return F.struct((F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some)).alias("mean"), F.array_min(some).alias("least"), share(0.5).alias("below_half"), share(0.9).alias("below_most"), (F.size(log_p) < k).alias("short"))


def prompt(prefix: list[int], image: int, end: int, suffix: list[int], patches: Column) -> Column:
    """Fixed tokens around a run of image tokens."""
    whole = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    return F.concat(whole(prefix), F.array_repeat(F.lit(image), patches), whole([end]), whole(suffix))


def image_range(tokens: Column, begin: int, end: int) -> Column:
    """(first, last) place of the image's marks; an error unless each is there once."""
    once = lambda t: F.size(F.filter(tokens, lambda x: x == t)) == 1
    return F.when(once(begin) & once(end), F.struct((F.array_position(tokens, begin) - 1).alias("first"), (F.array_position(tokens, end) - 1).alias("last"))).otherwise(F.raise_error(F.lit("the image marks must be there once")))


def masked(query: Column, key: Column, first: Column, last: Column) -> Column:
    """Whether a key is hidden from a query: it comes later, unless both lie in the image."""
    inside = lambda p: p.between(first, last)
    return (key > query) & ~(inside(query) & inside(key))


def visible_end(query: Column, first: Column, last: Column) -> Column:
    """One past the last key that a query sees."""
    return F.when(query.between(first, last), last + 1).otherwise(query + 1)
