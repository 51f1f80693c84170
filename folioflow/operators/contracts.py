"""Contracts of run records: named rules over a row, suites of them, what a row breaks, and dictionaries that must agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the recognised pages' format: stop tokens, vocabulary, patch side, tokens before the patches, whole context.
STOPS = (11, 263)
VOCABULARY = 65_536
PATCH = 16
PREFIX = 16
CONTEXT = 16_384
TIMINGS = ("image_decode_ms", "preprocessing_ms", "prefill_ms", "decode_ms", "total_ms", "time_to_first_token_ms")


def broken(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule that is null is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda n: n.isNotNull())


def breaches(df: DataFrame, rules: Mapping[str, Column], *keys: str) -> DataFrame:
    """(keys, broken): the rows that break a rule."""
    return df.select(*keys, broken(rules).alias("broken")).where(F.size("broken") > 0)


def counted(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken): how many rows break each rule, in one pass."""
    sums = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.col(f"`{n}`") for n in rules)))).alias("rule", "broken"))


def finite(value: Column) -> Column:
    """A number that is one, not infinite and not negative."""
    return value.isNotNull() & ~F.isnan(value.cast("double")) & (value.cast("double") < float("inf")) & (value >= 0)


def within(values: Column, low: float, high: float) -> Column:
    """An array, not null, whose entries are all finite and in a range."""
    return values.isNotNull() & F.forall(values, lambda v: F.coalesce(~F.isnan(v.cast("double")) & v.between(low, high), F.lit(False)))


def result_rules(precisions: tuple[str, ...] = ("fp32", "bf16"), cap: str = "options.max_new_tokens", most: str = "options.max_dimension", strict: bool = False) -> dict[str, Column]:
    """Rules of a recognised page (``token_ids, output_tokens, finish_reason, text, teacher_forced, precision, width, height, input_tokens, timings``).

    With ``strict`` no stop token may come before the end, and every other timing of the map must be finite too.
    """
    ids, last = F.col("token_ids"), F.element_at("token_ids", -1)
    some, stop, n = F.size(ids) > 0, last.isin(*STOPS), F.size(ids)
    side = lambda c: (F.col(c) > 0) & (F.col(c) <= F.col(most)) & (F.col(c) % PATCH == 0)
    rules = {
        "valid_output_budget": F.col(cap) > 0,
        "valid_dimension_limit": F.col(most) > 0,
        "valid_token_ids": some & F.forall(ids, lambda t: F.coalesce(t.between(0, VOCABULARY - 1), F.lit(False))),
        "output_count": (F.col("output_tokens") == n) & (n <= F.col(cap)),
        "finish_reason": some & (((F.col("finish_reason") == "eos") & stop) | ((F.col("finish_reason") == "length") & ~stop & (n == F.col(cap)))),
        "text_string": F.col("text").isNotNull(),
        "free_running": ~F.col("teacher_forced"),
        "precision": F.col("precision").isin(*precisions),
        "image_dimensions": side("width") & side("height"),
        "prefix_integer": F.col("input_tokens") > 0,
        "prefix_patch_shape": F.col("input_tokens") == (F.floor(F.col("width") / PATCH) * F.floor(F.col("height") / PATCH) + PREFIX),
        "context_budget": F.col("input_tokens") + F.col(cap) <= CONTEXT,
        **{f"timing.{t}": finite(F.col("timings")[t]) for t in TIMINGS},
    }
    if strict:
        rules["no_stop_inside"] = ~F.exists(F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), lambda t: t.isin(*STOPS))
        rules["other_timings"] = F.forall(F.map_values("timings"), finite)
    return rules


def interval_rules(whole: Column, parts: Mapping[str, Column], slack: float = 1e-12) -> dict[str, Column]:
    """Each part of a time lies in the whole, and so does their sum, but for rounding."""
    total = sum(parts.values(), F.lit(0.0))
    return {f"part.{name}": finite(part) & (part <= whole * (1 + slack)) for name, part in parts.items()} | {"parts": total <= whole * (1 + slack)}


def merged(sources: Mapping[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """(key, fields, sources, conflict): dictionaries as one; of a key whose sources disagree the fields are null and conflict is true.

    Values are compared as whole rows of fields, nulls like any value; sources are named in order.
    """
    rows = None
    for name, df in sources.items():
        one = df.select(key, F.struct(*fields).alias("entry"), F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.groupBy(key).agg(F.min("entry").alias("low"), F.max("entry").alias("high"), F.array_sort(F.collect_set("source")).alias("sources"))  # a name per source
    agree = F.col("low").eqNullSafe(F.col("high"))
    return found.select(key, *(F.when(agree, F.col(f"low.{f}")).alias(f) for f in fields), "sources", (~agree).alias("conflict"))


def restored(locked: DataFrame, found: DataFrame, key: str, digest: str, content: Column) -> DataFrame:
    """(key, state): what a lock names, present with its digest, to be restored (missing) or altered; keys found twice refuse nothing, one good copy will do."""
    have = found.select(F.col(key).alias("have"), F.sha2(content.cast("binary"), 256).alias("have_sha"))
    best = locked.select(key, digest).join(have, F.col(key) == F.col("have"), "left").groupBy(key, digest).agg(F.max((F.col("have_sha") == F.col(digest)).cast("int")).alias("same"))
    return best.select(key, F.when(F.col("same") == 1, "present").when(F.col("same") == 0, "altered").otherwise("restore").alias("state"))


def winner(logits: Column) -> Column:
    """(at, probability): the largest logit, the first of equals, and its softmax share; null for no logits."""
    top = F.array_max(logits)
    whole = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))
    return F.when(F.size(logits) > 0, F.struct((F.array_position(logits, top) - 1).cast("int").alias("at"), (1 / whole).alias("probability")))


def swept(steps: DataFrame, confidence: str, hits: str, thresholds: list[float], single: float, rows: tuple[float, float], draft: float) -> DataFrame:
    """(threshold, drafted, kept, speedup): how a confidence gate on draft tokens would pay.

    A step drafts while the running product of confidences reaches the threshold, and keeps the leading hits among those.
    A step costs ``single``, plus ``draft`` and ``rows`` (first, every further) for what it drafts; speedup is the tokens times
    ``single`` over the cost. Each row is folded once for all thresholds.
    """
    product = F.aggregate(confidence, F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("all")), lambda s, c: F.struct((s["p"] * c.cast("double")).alias("p"), F.concat(s["all"], F.array(s["p"] * c.cast("double"))).alias("all")), lambda s: s["all"])
    leading = F.array_position(F.transform(hits, lambda h: F.coalesce(h, F.lit(False))), False)
    right = F.when(leading > 0, leading - 1).otherwise(F.size(hits))
    long = lambda t: F.coalesce(F.nullif(F.array_position(F.transform("product", lambda p: p >= t), False), F.lit(0)) - 1, F.size("product"))
    each = steps.select(product.alias("product"), right.alias("right"))
    gates = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), long(t).alias("n")) for t in thresholds)))
    cost = F.lit(float(single)) + F.when(F.col("n") > 0, draft + rows[0] + rows[1] * (F.col("n") - 1)).otherwise(0.0)
    priced = each.select("right", gates.alias("g")).select("g.threshold", "g.n", F.least("g.n", "right").alias("kept"), "right").withColumn("cost", cost)
    sums = priced.groupBy("threshold").agg(F.sum("n").alias("drafted"), F.sum("kept").alias("kept"), F.count("*").alias("steps"), F.sum("cost").alias("cost"))
    return sums.select("threshold", "drafted", "kept", ((F.col("kept") + F.col("steps")) * single / F.col("cost")).alias("speedup"))


def drawn(df: DataFrame, category: str, key: str, quota: int, rate: float, seed: str) -> DataFrame:
    """Rows of a seeded Bernoulli draw, at most ``quota`` of each category: a reader's sample, the same for any split of the input.

    A row is drawn if the first 48 bits of its SHA-256 are below ``rate``; of more than ``quota`` those of least digest stay. A
    task keeps its own ``quota`` of each category before rows move, so samples merge. Null categories are none.
    """
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(category).cast("string"), F.col(key).cast("string")), 256)
    below = F.lpad(F.hex(F.lit(int(rate * (1 << 48)))), 12, "0")
    some = df.where(F.col(category).isNotNull()).withColumn("draw", digest).where(F.substring("draw", 1, 12) < F.lower(below))
    place = F.row_number().over(Window.partitionBy(category).orderBy("draw", key))
    return some.withColumn("place", place).where(F.col("place") <= quota).drop("draw", "place")
