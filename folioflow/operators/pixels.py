"""Pages as pixel tables (page, y, x, r, g, b): gray, histograms, ink, crops, resampling, sizes.

All of it groups by page and line, so a page's pixels may lie in many tasks; only counts per line meet by page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ink contrast, lightest background needed, ink pixels of a line, lines of a run, percent of area saved.
CONTRAST, LIGHT, LEAST_INK, LEAST_RUN, SAVING = 64, 160, 2, 4, 10


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """(r, g, b) by integers: each ink scaled by what black leaves, rounded."""
    rest = 255 - k

    def one(ink: Column) -> Column:
        product = ink * rest + 128
        return F.greatest(rest - F.shiftright(F.shiftright(product, 8) + product, 8), F.lit(0))

    return F.struct(one(c).alias("r"), one(m).alias("g"), one(y).alias("b"))


def to_patch(v: Column) -> Column:
    """The nearest multiple of 16, halves to the even one."""
    return (F.rint(v / 16) * 16).cast("int")


def bounded(w: Column, h: Column, low: int, high: int) -> Column:
    """(w, h) scaled into [low, high] with its aspect kept, fractions cut off."""
    aspect = w / h
    bound = F.when((w < low) | (h < low), float(low)).otherwise(float(high))
    one = F.when(w < h, F.struct(bound.cast("int").alias("w"), (bound / aspect).cast("int").alias("h"))).otherwise(F.struct((bound * aspect).cast("int").alias("w"), bound.cast("int").alias("h")))
    two = F.when(one["w"] > high, F.struct(F.lit(high).alias("w"), (high / aspect).cast("int").alias("h"))).otherwise(one)
    three = F.when(two["h"] > high, F.struct((high * aspect).cast("int").alias("w"), F.lit(high).alias("h"))).otherwise(two)
    return F.when(w.between(low, high) & h.between(low, high), F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))).otherwise(three)


def aligned(w: Column, h: Column, least: int, most: int) -> Column:
    """(w, h) in whole patches with an area from least to most; null below one patch or above an aspect of 200."""
    pw, ph, area = to_patch(w), to_patch(h), w.cast("double") * h
    down, up = F.sqrt(area / most), F.sqrt(least / area)
    fit = lambda f: (f * 16).cast("int")
    size = (
        F.when(pw * ph > most, F.struct(fit(F.floor(w / down / 16)).alias("w"), fit(F.floor(h / down / 16)).alias("h")))
        .when(pw * ph < least, F.struct(fit(F.ceil(w * up / 16)).alias("w"), fit(F.ceil(h * up / 16)).alias("h")))
        .otherwise(F.struct(pw.alias("w"), ph.alias("h")))
    )
    return F.when((w >= 16) & (h >= 16) & (F.greatest(w, h) / F.least(w, h) <= 200), size)


def linspace(start: Column, end: Column, steps: Column) -> Column:
    """Evenly spaced values, counted from either end to the middle."""
    step = (end - start) / F.greatest(steps - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.when(i < F.floor(steps / 2), start + step * i).otherwise(end - step * (steps - 1 - i)))


def nearest(size: Column, out: Column) -> Column:
    """Source index of each of ``out`` places; the position is a running sum of steps, not a product."""
    step = size.cast("double") / out
    start = F.struct((step * 0.5).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), out), start, lambda s, _: F.struct((s["at"] + step).alias("at"), F.concat(s["found"], F.array(s["at"].cast("int"))).alias("found")), lambda s: s["found"])


def cubic(x: Column, a: float = -0.5) -> Column:
    x = F.abs(x)
    return F.when(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1).when(x < 2, (((x - 5) * x + 8) * x - 4) * a).otherwise(0.0)


def triangle(x: Column) -> Column:
    return F.greatest(1 - F.abs(x), F.lit(0.0))


KERNELS = {"cubic": (cubic, 2.0), "triangle": (triangle, 1.0)}


def weights(sizes: DataFrame, size: str, out: str, kind: str = "cubic") -> DataFrame:
    """Rows (size, out, to, source, weight) of a resampling; the weights of one place sum to 1."""
    kernel, reach = KERNELS[kind]
    scale = F.col(size).cast("double") / F.col(out)
    wide = F.greatest(scale, F.lit(1.0))
    centre = (F.col("to") + 0.5) * scale
    first = F.greatest((centre - reach * wide + 0.5).cast("int"), F.lit(0))
    last = F.least((centre + reach * wide + 0.5).cast("int"), F.col(size)) - 1
    each = sizes.select(size, out).distinct().withColumn("to", F.explode(F.sequence(F.lit(0), F.col(out) - 1))).withColumn("source", F.explode(F.sequence(first, last)))
    raw = each.withColumn("raw", kernel((F.col("source") - centre + 0.5) / wide))
    whole = F.sum("raw").over(Window.partitionBy(size, out, "to"))
    return raw.select(size, out, "to", "source", F.when(whole != 0, F.col("raw") / whole).otherwise(F.col("raw")).alias("weight"))


def fixed_point(weight: Column, bits: int = 22) -> Column:
    """A weight as an integer, halves away from zero."""
    return (F.signum(weight) * F.floor(F.abs(weight) * (1 << bits) + 0.5)).cast("int")


def resized(gray: DataFrame, width: int, height: int, to_width: int, to_height: int, kind: str = "cubic") -> DataFrame:
    """(page, y, x, v) resampled: along x, rounded and clamped, then along y; in fixed point."""
    spark, half = gray.sparkSession, 1 << 21

    def one(df: DataFrame, axis: str, other: str, size: int, out: int) -> DataFrame:
        if size == out:
            return df
        table = weights(spark.createDataFrame([(size, out)], "size int, out int"), "size", "out", kind).select("to", "source", fixed_point(F.col("weight")).alias("w"))
        clamped = F.least(F.greatest(F.shiftright(F.sum(F.col("v") * F.col("w")) + half, 22), F.lit(0)), F.lit(255)).cast("int")
        return df.join(F.broadcast(table), F.col(axis) == F.col("source")).groupBy("page", other, "to").agg(clamped.alias("v")).withColumnRenamed("to", axis)

    return one(one(gray, "x", "y", width, to_width), "y", "x", height, to_height).select("page", "y", "x", "v")


def histogram(gray: DataFrame) -> DataFrame:
    """(page, v, n): pixels of each level, at most 256 rows a page."""
    return gray.groupBy("page", "v").agg(F.count("*").alias("n"))


def level_at(counts: DataFrame, share: float) -> DataFrame:
    """(page, level, pixels): the first level with more than that share of the pixels at or below it."""
    below = F.sum("n").over(Window.partitionBy("page").orderBy("v"))
    total = F.sum("n").over(Window.partitionBy("page"))
    return counts.select("page", "v", below.alias("below"), total.alias("pixels")).where(F.col("below") > F.floor(F.col("pixels") * share)).groupBy("page", "pixels").agg(F.min("v").alias("level"))


def ink_lines(gray: DataFrame, axis: str, ink: Column) -> DataFrame:
    """(page, at, ink): dark pixels of each row (axis y) or column (axis x)."""
    return gray.groupBy("page", F.col(axis).alias("at")).agg(F.count_if(ink).alias("ink"))


def runs(lines: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """(page, start, end, length) of runs of flagged lines."""
    order = Window.partitionBy("page").orderBy("at")
    island = lines.withColumn("flag", flag).withColumn("gap", F.col("at") - F.sum(F.col("flag").cast("int")).over(order)).where("flag")
    return island.groupBy("page", "gap").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.count("*").alias("length")).where(F.col("length") >= least).drop("gap")


def content_box(gray: DataFrame, pad: int = 0, saving: int = SAVING) -> DataFrame:
    """(page, left, top, right, bottom) of pages with a light background whose content leaves ``saving`` percent of the area."""
    background = level_at(histogram(gray), 0.9).where(F.col("level") >= LIGHT)
    dark = gray.join(background, "page").withColumn("dark", F.col("v") <= F.col("level") - CONTRAST)

    def span(axis: str, low: str, high: str) -> DataFrame:
        found = runs(ink_lines(dark, axis, F.col("dark")), F.col("ink") >= LEAST_INK, LEAST_RUN)
        return found.groupBy("page").agg(F.min("start").alias(low), F.max("end").alias(high))

    size = gray.groupBy("page").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    box = span("x", "left", "right").join(span("y", "top", "bottom"), "page").join(size, "page")
    box = box.select("page", F.greatest(F.col("left") - pad, F.lit(0)).alias("left"), F.greatest(F.col("top") - pad, F.lit(0)).alias("top"), F.least(F.col("right") + pad, "w").alias("right"), F.least(F.col("bottom") + pad, "h").alias("bottom"), "w", "h")
    removed = F.col("w") * F.col("h") - (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    return box.where(removed * 100 >= F.col("w") * F.col("h") * saving).select("page", "left", "top", "right", "bottom")


def cropped(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside their page's box, counted from its corner; pages without a box stay whole."""
    inside = F.col("left").isNull() | (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    both = pixels.join(boxes, "page", "left").where(inside)
    moved = {"x": (F.col("x") - F.coalesce("left", F.lit(0))).cast("int"), "y": (F.col("y") - F.coalesce("top", F.lit(0))).cast("int")}
    return both.withColumns(moved).select(*pixels.columns)


def page_features(gray: DataFrame, ink: int = 160, dark: int = 80, edge: int = 40) -> DataFrame:
    """Mean, deviation, ink and dark shares, mean neighbour differences and the share of strong edges of each page, in one pass of sums."""
    right = F.lead("v").over(Window.partitionBy("page", "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy("page", "x").orderBy("y"))
    near = gray.withColumns({"dx": F.abs(right - F.col("v")), "dy": F.abs(down - F.col("v"))})
    s, q, n = F.sum("v"), F.sum(F.col("v") * F.col("v")), F.count("*")
    return near.groupBy("page").agg(
        F.round(s / n, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), 4).alias("deviation"),
        F.round(F.avg((F.col("v") < ink).cast("int")), 6).alias("ink"),
        F.round(F.avg((F.col("v") < dark).cast("int")), 6).alias("dark"),
        F.round(F.avg("dx") + F.avg("dy"), 6).alias("edges"),
        F.count_if((F.col("dx") > edge) | (F.col("dy") > edge)).alias("strong"),
    )


def line_features(gray: DataFrame, width: int, ink: int = 160) -> DataFrame:
    """(page, lines, tallest, gaps, widest_gap): runs of two or more inked rows, and what lies between runs."""
    rows = runs(ink_lines(gray, "y", F.col("v") < ink), F.col("ink") / width > 0.01)
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("page").orderBy("start"))
    return rows.withColumn("before", gap).groupBy("page").agg(F.count_if(F.col("length") >= 2).alias("lines"), F.max("length").alias("tallest"), F.count("before").alias("gaps"), F.coalesce(F.max("before"), F.lit(0)).alias("widest_gap"))


def saturation(pixels: DataFrame, step: int = 4) -> DataFrame:
    """Mean integer saturation on a grid of every fourth pixel."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    some = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return some.groupBy("page").agg(F.round(F.avg(F.when(high > 0, F.floor((high - low) * 255 / high)).otherwise(0)), 6).alias("saturation"))


def difference_hash(gray: DataFrame) -> DataFrame:
    """(page, dhash): 64 bits from 9 x 8 gray pixels, whether each is lighter than its right neighbour, row by row."""
    after = F.lead("v").over(Window.partitionBy("page", "y").orderBy("x"))
    bits = gray.withColumn("after", after).where("after is not null").select("page", F.when(F.col("v") > F.col("after"), F.expr("shiftleft(1L, cast(63 - (y * 8 + x) as int))")).otherwise(F.lit(0)).alias("bit"))
    return bits.groupBy("page").agg(F.bit_or("bit").alias("dhash"))


def tiled(gray: DataFrame, tile: int, halo: int) -> DataFrame:
    """(page, ty, tx, y, x, v): pixels by the tiles that need them, each tile with ``halo`` pixels of its neighbours around it.

    A pixel near a border comes once for every tile that it touches, so work on a tile needs no other and no self join.
    """
    near = lambda c: F.transform(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)), lambda t: t.cast("int"))
    both = gray.select("page", "y", "x", "v", F.explode(near("y")).alias("ty")).select("*", F.explode(near("x")).alias("tx"))
    return both.where("ty >= 0 and tx >= 0").select("page", "ty", "tx", "y", "x", "v")


NEIGHBOUR_SUMS = ("pixels", "ink", "edges", "across", "down", "transitions", "laplacian", "inner")


def neighbour_sums(gray: DataFrame, tile: int = 256, ink: int = 160, edge: int = 40) -> DataFrame:
    """(page, pixels, ink, edges, across, down, transitions, laplacian, inner) of each page's pixels and their neighbours.

    edges: pairs side by side or one above the other that differ by more than ``edge``; across and down: summed differences;
    transitions: pairs side by side of which one is inked; laplacian: summed |4 v - neighbours| of the ``inner`` inked pixels
    that have all four. Tiles of bounded size are computed apart, with a halo of one pixel, and their sums are added.
    """

    def sums(table: pa.Table) -> pa.Table:
        ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
        y, x, v = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "v"))
        top, left = ty * tile - 1, tx * tile - 1
        cells = np.full((tile + 2, tile + 2), -1, np.int64)
        cells[y - top, x - left] = v
        own, here = cells[1:-1, 1:-1], cells[1:-1, 1:-1] >= 0
        right, below = cells[1:-1, 2:], cells[2:, 1:-1]
        beside, under = here & (right >= 0), here & (below >= 0)
        dx, dy = np.abs(own - right) * beside, np.abs(own - below) * under
        inked = here & (own < ink)
        inside = inked & beside & under & (cells[1:-1, :-2] >= 0) & (cells[:-2, 1:-1] >= 0)
        curve = np.abs(4 * own - right - below - cells[1:-1, :-2] - cells[:-2, 1:-1])
        found = (here.sum(), inked.sum(), (dx > edge).sum() + (dy > edge).sum(), dx.sum(), dy.sum(), (beside & (inked != (right < ink))).sum(), (curve * inside).sum(), inside.sum())
        return pa.table([table["page"].slice(0, 1).combine_chunks(), *(pa.array([int(n)], pa.int64()) for n in found)], names=["page", *NEIGHBOUR_SUMS])

    dealt = tiled(gray, tile, 1)
    kind = f"page {gray.schema['page'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in NEIGHBOUR_SUMS)
    return dealt.groupBy("page", "ty", "tx").applyInArrow(sums, kind).groupBy("page").agg(*(F.sum(c).alias(c) for c in NEIGHBOUR_SUMS))


def native_features(gray: DataFrame, tile: int = 256) -> DataFrame:
    """(page, ink_per_edge, laplacian): inked pixels for each strong edge, and the mean Laplacian over inner ink."""
    s = neighbour_sums(gray, tile)
    return s.select("page", (F.col("ink") / F.greatest("edges", F.lit(1))).alias("ink_per_edge"), F.when(F.col("inner") > 0, F.col("laplacian") / F.col("inner")).otherwise(0.0).alias("laplacian"))


def resample_loss(gray: DataFrame, width: int, height: int, size: int, ink: int = 160, lossy: int = 60) -> DataFrame:
    """(page, change, lossy): mean change of inked pixels, and the share that changes by more than ``lossy``, when pages of one size
    are scaled to a long side of ``size`` (cubic) and back (triangle). Pages that would grow, or have no ink, lose nothing."""
    scale = size / max(width, height)
    pages = gray.select("page").distinct()
    if scale >= 1:
        return pages.select("page", F.lit(0.0).alias("change"), F.lit(0.0).alias("lossy"))
    w, h = max(1, int(width * scale)), max(1, int(height * scale))
    back = resized(resized(gray, width, height, w, h), w, h, width, height, "triangle").select("page", "y", "x", F.col("v").alias("back"))
    diff = F.abs(F.col("v") - F.col("back"))
    lost = gray.where(F.col("v") < ink).join(back, ["page", "y", "x"]).groupBy("page").agg(F.avg(diff).alias("change"), F.avg((diff > lossy).cast("int")).alias("lossy"))
    return pages.join(lost, "page", "left").select("page", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("change", "lossy")))
