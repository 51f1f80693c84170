"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import discard, stored

CHUNK = 400_000


class Groups:
    """Union-find; the least name of a group is its top."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars (vertex, least vertex reached), in chunks of a bounded number of edges."""

    def out(groups: Groups) -> pa.RecordBatch:
        rows = [(x, t) for x in list(groups.up) if (t := groups.top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

    groups, n = Groups(), 0
    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            groups.join(a, b)
        n += batch.num_rows
        if n >= CHUNK:
            yield out(groups)
            groups, n = Groups(), 0
    if n:
        yield out(groups)


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each task replaces its edges by stars, without a shuffle."""
    return edges.mapInArrow(_stars, "u long, v long")


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small star: each vertex hands its least neighbour to the greater ones, then hooks the lesser ones on it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v")
    return contracted(small)


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: every vertex has one lesser neighbour, which has none."""
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v").isNull()).alias("centre"))
    return not seen.where("least is not null and (least < most or centre > 0)").count()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(vertex, component)`` for every vertex with an edge to another; component is the least vertex of its component.

    Tasks contract their own edges first. Then the two star steps alternate until only stars are left, which takes about
    log(n) squared rounds on any shape. Each round's edges are written to the shared folder, and the ones before go.
    Null ends and loops are dropped; no edges give no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = stored(contracted(ends), "edges")
    while not _settled(now):
        before, now = now, stored(_round(now), "edges")
        discard(before)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
