"""Polygons on pages: pixels of regions without what other polygons keep, by a sweep along scan lines, and heights of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches

#: Scan lines of a strip; pages are cut into strips, so that neither a tall page nor its polygons are one row.
STRIP = 64


def _points(poly: Column) -> Column:
    """(x, y) of a polygon given as x, y, x, y ..."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(poly) / 2).cast("int") - 1), lambda k: F.struct(F.get(poly, 2 * k).cast("double").alias("x"), F.get(poly, 2 * k + 1).cast("double").alias("y")))


def _spans(polys: pa.ListArray, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """(polygon, y, start, end): the pixels of each row, from start to before end, whose centres lie in a polygon (even-odd rule).

    Rows are held between low and high, pixels between 0 and width. Edges are cut into their scan lines, and the
    crossings of one polygon and line are paired; edges without a number at either end cross nothing.
    """
    v, n = polys.flatten().to_numpy(zero_copy_only=False).astype(float), polys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    points = n // 2
    polygon = np.repeat(np.arange(len(n)), points)
    k = np.arange(len(polygon)) - np.repeat(np.cumsum(points) - points, points)
    base = np.repeat(np.cumsum(n) - n, points)
    a, b = base + 2 * k, base + 2 * np.where(k + 1 < points[polygon], k + 1, 0)
    ax, ay, bx, by = v[a], v[a + 1], v[b], v[b + 1]
    edges = np.flatnonzero(np.isfinite(ax + ay + bx + by) & (ay != by))
    polygon, ax, ay, bx, by = (c[edges] for c in (polygon, ax, ay, bx, by))
    first, last = (np.clip(np.ceil(f(ay, by) - 0.5), low[polygon], high[polygon]).astype(np.int64) for f in (np.minimum, np.maximum))
    lines = np.maximum(last - first, 0)
    e = np.repeat(np.arange(len(lines)), lines)
    y = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(lines) - lines, lines)
    x = np.ceil(ax[e] + (y + 0.5 - ay[e]) * (bx[e] - ax[e]) / (by[e] - ay[e]) - 0.5)
    polygon, x = polygon[e], np.clip(x, 0, width[polygon[e]]).astype(np.int64)
    order = np.lexsort((x, y, polygon))
    polygon, y, x = polygon[order], y[order], x[order]
    same = (polygon[1:] == polygon[:-1]) & (y[1:] == y[:-1])
    heads = np.flatnonzero(np.r_[True, ~same])[: len(x)]
    place = np.arange(len(x)) - np.repeat(heads, np.diff(np.r_[heads, len(x)]))
    at = np.flatnonzero((place[:-1] % 2 == 0) & same & (x[:-1] < x[1:]))
    return polygon[at], y[at], x[at], x[at + 1]


def masked(pages: DataFrame, regions: DataFrame, kept: DataFrame, page: str = "page") -> DataFrame:
    """(page, pixels, share) of each page's pixels that a region covers and no kept polygon does.

    pages: page, width, height; regions and kept: page, ``poly`` as x, y, x, y ... (fewer than three points, or a null, hold
    nothing). What lies beyond a page doesn't count; a page without regions has none. Polygons meet in strips of their page;
    along each row the borders of spans are swept with counts of what is open, many strips at a time. An empty page has share 0.
    """

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, polys = batch["polys"], batch["polys"].flatten()
            strip = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
            size = lambda c: batch[c].to_numpy(zero_copy_only=False)[strip].astype(np.int64)
            low = size("strip") * STRIP
            polygon, y, start, end = _spans(polys.field("poly"), low, np.minimum(low + STRIP, size("height")), size("width"))
            kind = np.tile(polys.field("kind").to_numpy(zero_copy_only=False)[polygon], 2)
            by, line, x, step = np.tile(strip[polygon], 2), np.tile(y, 2), np.r_[start, end], np.repeat([1, -1], len(y))
            order = np.lexsort((x, line, by))
            by, x, kind, step = by[order], x[order], kind[order], step[order]
            inside = (np.cumsum(step * (kind == 0)) > 0) & (np.cumsum(step * (kind == 1)) == 0)
            wide = np.where(inside, np.diff(x, append=0), 0)  # nothing is open at the last border of a line
            pixels = np.bincount(by, wide, len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch[page], pa.array(pixels)], names=[page, "pixels"])

    both = regions.select(page, F.lit(0).alias("kind"), F.col("poly").cast("array<double>").alias("poly")).unionByName(kept.select(page, F.lit(1).alias("kind"), F.col("poly").cast("array<double>").alias("poly")))
    ys = F.filter("poly", lambda v, i: (i % 2 == 1) & v.isNotNull() & ~F.isnan(v))
    first, last = F.greatest(F.ceil(F.array_min(ys) - 0.5), F.lit(0)), F.least(F.ceil(F.array_max(ys) - 0.5), F.col("height"))
    met = both.where(F.size("poly") >= 6).join(pages.select(page, "width", "height"), page).where("width > 0").withColumns({"first": first, "last": last}).where("first < last")
    strips = met.select(page, "width", "height", "kind", "poly", F.explode(F.sequence(F.floor(F.col("first") / STRIP), F.floor((F.col("last") - 1) / STRIP))).alias("strip"))
    grouped = strips.groupBy(page, "width", "height", "strip").agg(F.collect_list(F.struct("kind", "poly")).alias("polys"))
    small_batches(pages.sparkSession)
    found = grouped.mapInArrow(swept, f"{page} {pages.schema[page].dataType.simpleString()}, pixels long").groupBy(page).agg(F.sum("pixels").alias("pixels"))
    pixels = F.coalesce("pixels", F.lit(0)).cast("long")
    area = F.col("width").cast("long") * F.col("height")
    return pages.join(found, page, "left").select(page, pixels.alias("pixels"), F.when(area > 0, pixels / area).otherwise(0.0).alias("share"))


def tall(poly: Column) -> Column:
    """Height of a polygon; null without points."""
    y = F.transform(_points(poly), lambda p: p["y"])
    return F.when(F.size(poly) >= 2, F.array_max(y) - F.array_min(y))


def line_height(blocks: Column, page_height: Column) -> Column:
    """The upper median height of a page's text lines as a share of the page; 1 if nothing tells.

    blocks: ``text, poly, lines`` (each ``text, poly``) of what isn't ignored. Without lines that have text and a polygon, blocks of one
    line of at most 120 characters stand for them.
    """
    said = lambda b: F.coalesce(b["text"], F.lit("")) != ""
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array().cast("array<struct<text:string,poly:array<double>>>"))))
    heights = F.filter(F.transform(F.filter(lines, said), lambda b: tall(b["poly"])), lambda h: h.isNotNull())
    single = lambda b: said(b) & ~b["text"].contains("\n") & (F.length(b["text"]) <= 120)
    spare = F.filter(F.transform(F.filter(blocks, single), lambda b: tall(b["poly"])), lambda h: h.isNotNull())
    upper = lambda a: F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int")) / page_height
    return F.when(F.size(heights) > 0, upper(heights)).when(F.size(spare) > 0, upper(spare)).otherwise(1.0)
