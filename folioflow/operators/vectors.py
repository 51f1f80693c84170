"""Array columns: products, norms, quantisation, attention, top-1."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.sampling import running
from folioflow.sources.workspace import small_batches, stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + eps)
    return F.transform(v, lambda x: x.cast("double") / scale)


def quantized(v: Column, block: int = 32, top: int = 127) -> Column:
    """Blocks of (scale, codes): absolute maximum over ``top``, half-even rounding; a zero block has scale 0."""
    parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(block)), lambda i: F.slice(v, i, block))

    def one(part: Column) -> Column:
        scale = F.array_max(F.transform(part, lambda x: F.abs(x.cast("double")))) / top
        return F.struct(scale.alias("scale"), F.transform(part, lambda x: F.when(scale > 0, F.rint(x.cast("double") / scale)).otherwise(0.0).cast("int")).alias("codes"))

    return F.transform(parts, one)


def hadamard(v: Column, block: int = 32) -> Column:
    """Walsh-Hadamard transform of each block, scaled by the block's root."""
    sign = lambda i, j: 1 - 2 * (F.bit_count(i.bitwiseAND(j)) % 2)
    at = F.sequence(F.lit(0), F.size(v) - 1)
    return F.transform(
        at,
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(block - 1)), F.lit(0.0), lambda s, j: s + F.get(v, (i - i % block + j).cast("int")).cast("double") * sign(i % block, j)) / (block**0.5),
    )


def argmax_first(v: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def gram_sums(df: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(group, i, j, v, n): X^T X over the first dims and the number of rows, one matrix for each group and task.

    A task adds up batches of vectors as matrix products and hands on its groups' sums; vectors of another length or with
    nulls aren't rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch["g"].type
            groups = np.array(batch["g"].to_pylist(), object)
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            for g in {*groups.tolist()}:
                mine = x[[k == g for k in groups]]
                held = sums.setdefault(g, [np.zeros((dims, dims)), 0])
                held[0] += mine.T @ mine
                held[1] += len(mine)
        i, j = (a.ravel() for a in np.indices((dims, dims)))
        for g, (total_, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * dims * dims, kind), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total_.ravel()), pa.array(np.full(dims * dims, n), pa.int64())], names=["g", "i", "j", "v", "n"])

    rows = df.select(F.col(group).alias("g"), F.transform(F.slice(vector, 1, dims), lambda a: a.cast("double")).alias("x")).where((F.size("x") == dims) & ~F.exists("x", lambda a: a.isNull()))
    return rows.mapInArrow(run, f"g {rows.schema['g'].dataType.simpleString()}, i int, j int, v double, n long").withColumnRenamed("g", group)


def gram_matrix(df: DataFrame, group: str, vector: str, dims: int, digits: int = 6) -> DataFrame:
    """Mean of X^T X over the first dims, by group; a task and group moves one matrix."""
    return gram_sums(df, group, vector, dims).groupBy(group, "i", "j").agg(F.round(F.sum("v") / F.sum("n"), digits).alias("gram"))


def weighted_error(deltas: DataFrame, weights: DataFrame, gram: DataFrame, by: list[str], block: int = 64) -> DataFrame:
    """(by, error): sqrt(tr(D G D^T) / tr(W G W^T)) of matrices given as cells (by, row, col, v), with G as cells (i, j, gram).

    Cells are cut into blocks of ``block`` columns; a row's block meets only the blocks of G above it, so that G lies over
    all tasks and no matrix is whole in one. tr(X G X^T) is the sum over rows of x G x^T.
    """
    part = lambda c: F.floor(F.col(c) / block).cast("int")
    cells = gram.select("i", "j", "gram").withColumn("bi", part("i")).withColumn("bj", part("j")).groupBy("bi", "bj").agg(F.collect_list(F.struct((F.col("i") % block).alias("i"), (F.col("j") % block).alias("j"), "gram")).alias("g"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of x^T y of pairs of strips, by matrix and pair of blocks."""
        kind, sums = None, {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_arrays([pa.array([dict(k[0]) for k in keys], kind), *(pa.array([k[c] for k in keys], pa.int32()) for c in (1, 2)), pa.array([list(map(float, v.ravel())) for v in sums.values()], pa.list_(pa.float64()))], names=["own", "bi", "bj", "c"])

        for batch in batches:
            kind = batch["own"].type
            names = batch["own"].to_pylist()
            for r, (name, bi, bj) in enumerate(zip(names, batch["bi"].to_pylist(), batch["bj"].to_pylist(), strict=True)):
                x, y = (batch[c][r].values.to_numpy(zero_copy_only=False) for c in ("x", "y"))
                at = (tuple(name.items()), bi, bj)
                if at not in sums and len(sums) * block * block >= 1 << 21:
                    yield out()
                    sums.clear()
                sums[at] = sums.get(at, 0) + np.outer(x, y)
        if sums:
            yield out()

    def energy(matrix: DataFrame, name: str) -> DataFrame:
        entries = F.map_from_entries(F.collect_list(F.struct((F.col("col") % block).alias("c"), "v")))
        strips = matrix.withColumn("b", part("col")).groupBy(*by, "row", "b").agg(entries.alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast(dict(matrix.dtypes)["col"])), F.lit(0.0)))
        strips = strips.select(*by, "row", F.col("b").alias("bi"), dense.alias("x"))
        met = strips.join(strips.select(*by, "row", F.col("bi").alias("bj"), F.col("x").alias("y")), [*by, "row"]).select(F.struct(*by).alias("own"), "bi", "bj", "x", "y")
        small_batches(met.sparkSession)
        own = met.schema["own"].dataType.simpleString()
        summed = met.mapInArrow(products, f"own {own}, bi int, bj int, c array<double>").join(cells, ["bi", "bj"])
        form = F.aggregate("g", F.lit(0.0), lambda s, c: s + c["gram"] * F.get("c", (c["i"] * block + c["j"]).cast("int")))
        return summed.select("own.*", form.alias("e")).groupBy(*by).agg(F.sum("e").alias(name))

    return energy(deltas, "d").join(energy(weights, "w"), by).select(*by, F.sqrt(F.col("d") / F.col("w")).alias("error"))


def row_weighted_error(rows: DataFrame, by: str, delta: str, weight: str, gram: DataFrame, dims: int) -> DataFrame:
    """``weighted_error`` of matrices given as rows of arrays of one length.

    tr(X G X^T) is the sum of the entries of X^T X times those of G, and a task adds up X^T X, so only such sums move.
    """
    energy = lambda c, name: gram_sums(rows, by, c, dims).join(F.broadcast(gram), ["i", "j"]).groupBy(by).agg(F.sum(F.col("v") * F.col("gram")).alias(name))
    return energy(delta, "d").join(energy(weight, "w"), by).select(by, F.sqrt(F.col("d") / F.col("w")).alias("error"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def axpy(a: Column, x: Column, y: Column) -> Column:
    """y + a x."""
    return F.zip_with(x, y, lambda p, q: q.cast("double") + a * p.cast("double"))


def squared_relu_glu(gate: Column, up: Column) -> Column:
    """max(gate, 0) squared times up, entry by entry; a gate that is no number counts as 0."""
    open_ = lambda g: F.when(F.isnan(g), 0.0).otherwise(F.greatest(g, F.lit(0.0)))
    return F.zip_with(gate, up, lambda g, u: open_(g.cast("double")) * open_(g.cast("double")) * u.cast("double"))


def dequantized(parts: Column) -> Column:
    """Codes times scales of the blocks of ``quantized``."""
    return F.flatten(F.transform(parts, lambda p: F.transform(p["codes"], lambda c: c * p["scale"])))


def quantized_dot(parts: Column, x: Column, block: int = 32) -> Column:
    """Dot product of coded blocks with a plain vector: one scale per block."""
    own = lambda i: F.slice(x, i * block + 1, block)
    return total(F.transform(parts, lambda p, i: p["scale"] * dot(p["codes"], own(i))))


def with_exceptions(v: Column, columns: list[int], block: int = 32, top: int = 127) -> Column:
    """Blocks coded without some columns (their codes are 0), which are kept as they are: struct(parts, columns, values)."""
    kept = F.array(*map(F.lit, sorted(set(columns))))
    rest = F.transform(v, lambda x, i: F.when(F.array_contains(kept, i), 0.0).otherwise(x.cast("double")))
    return F.struct(quantized(rest, block, top).alias("parts"), kept.alias("columns"), F.transform(kept, lambda k: F.get(v, k).cast("double")).alias("values"))


def restored(coded: Column) -> Column:
    """The vector of ``with_exceptions``: codes times scales, exact columns over them."""
    return F.transform(dequantized(coded["parts"]), lambda x, i: F.when(F.array_contains(coded["columns"], i), F.element_at(coded["values"], F.array_position(coded["columns"], i).cast("int"))).otherwise(x))


def packed_nibbles(codes: Column) -> Column:
    """Codes of -8..7, two to a byte, the first in the low half."""
    return F.transform(F.sequence(F.lit(0), F.size(codes) - 1, F.lit(2)), lambda i: F.get(codes, i).bitwiseAND(15) + F.shiftleft(F.get(codes, i + 1).bitwiseAND(15), 4))


def nibble(byte: Column, high: bool) -> Column:
    """A half of a byte with its sign."""
    half = F.shiftright(byte, 4) if high else byte.bitwiseAND(15)
    return F.when(half > 7, half - 16).otherwise(half)


def unpacked_nibbles(data: Column) -> Column:
    return F.flatten(F.transform(data, lambda b: F.array(nibble(b, False), nibble(b, True))))


def bf16(x: Column) -> Column:
    """A number with eight bits of mantissa, halves to even (normal numbers)."""
    x = x.cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 7)
    return F.when(x == 0, 0.0).otherwise(F.rint(x / unit) * unit)


def fast_hadamard(v: Column, size: int = 32) -> Column:
    """Walsh-Hadamard transform of one block in log2(size) passes of sums and differences, scaled by the block's root."""
    def passed(v: Column, k: int) -> Column:
        return F.transform(F.array(v), lambda w: F.transform(w, lambda x, i: F.when(i.bitwiseAND(k) == 0, x + F.get(w, i + k)).otherwise(F.get(w, i - k) - x)))[0]

    v, k = doubles(v), 1
    while k < size:
        v, k = passed(v, k), 2 * k
    return F.transform(v, lambda x: x / size**0.5)


def signs(seed: int, size: int = 32) -> list[int]:
    """+1 or -1 from the top bits of a 64-bit mixing generator."""
    return [1 - 2 * (splitmix(seed + k) >> 63) for k in range(size)]


def splitmix(state: int) -> int:
    """One step of the 64-bit split-mix generator; its constants are fixed values."""
    z = (state + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return z ^ z >> 31


def rotated(v: Column, seed: int, size: int = 32) -> Column:
    """Signs flipped, then transformed."""
    flips = F.array(*(F.lit(float(s)) for s in signs(seed, size)))
    return fast_hadamard(F.zip_with(v, flips, lambda x, s: x.cast("double") * s), size)


def unrotated(v: Column, seed: int, size: int = 32) -> Column:
    """The inverse of ``rotated``."""
    flips = F.array(*(F.lit(float(s)) for s in signs(seed, size)))
    return F.zip_with(fast_hadamard(v, size), flips, lambda x, s: x * s)


def crest(block: Column) -> Column:
    """Largest magnitude over the root mean square."""
    return F.array_max(F.transform(block, lambda x: F.abs(x.cast("double")))) / F.sqrt(dot(block, block) / F.size(block))


def relative(error: Column, reference: Column) -> Column:
    """Length of the error over that of the reference."""
    return F.sqrt(dot(error, error) / dot(reference, reference))


def clipped_error(block: Column, factor: float, top: int = 7) -> Column:
    """Squared error of a block coded with its scale shrunk by a factor."""
    scale = F.array_max(F.transform(block, lambda x: F.abs(x.cast("double")))) * factor / top
    back = lambda x: F.greatest(F.least(F.rint(x / scale), F.lit(float(top))), F.lit(-float(top))) * scale
    return F.when(scale > 0, total(F.transform(block, lambda x: (x.cast("double") - back(x.cast("double"))) * (x.cast("double") - back(x.cast("double")))))).otherwise(0.0)


def best_clip(block: Column, factors: tuple[float, ...] = (1.0, 0.95, 0.9, 0.85, 0.8)) -> Column:
    """The factor of least squared error, the first of equals."""
    return F.array_min(F.array(*(F.struct(clipped_error(block, f).alias("error"), F.lit(k).alias("k"), F.lit(f).alias("factor")) for k, f in enumerate(factors))))["factor"]


class SoftmaxState:
    """Partial softmax averages of some queries: the largest logit, the sum of exponentials and the weighted vectors, both for that logit."""

    def __init__(self, top: np.ndarray, whole: np.ndarray, output: np.ndarray):
        self.top, self.whole, self.output = top, whole, output

    @classmethod
    def of(cls, logits: np.ndarray, values: np.ndarray) -> SoftmaxState:
        """Logits (queries x keys, -inf where a key isn't seen) and the keys' values."""
        top = logits.max(1, initial=-np.inf)
        e = np.exp(logits - np.where(np.isfinite(top), top, 0.0)[:, None])
        return cls(top, e.sum(1), e @ values)

    def merged(self, other: SoftmaxState) -> SoftmaxState:
        top = np.maximum(self.top, other.top)
        base = np.where(np.isfinite(top), top, 0.0)
        one, two = np.exp(self.top - base), np.exp(other.top - base)
        return SoftmaxState(top, self.whole * one + other.whole * two, self.output * one[:, None] + other.output * two[:, None])

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.top, self.whole, self.output)]

    @classmethod
    def unpacked(cls, top: bytes, whole: bytes, output: bytes) -> SoftmaxState:
        n = len(top) // 8
        return cls(np.frombuffer(top), np.frombuffer(whole), np.frombuffer(output).reshape(n, -1) if n else np.zeros((0, 0)))


def _block(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r["code"] for r in rows], np.int64), np.array([r["at"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.float64)


def attention(rows: DataFrame, by: str, at: str, vector: str, sink: float = 0.0, block: int = 512) -> DataFrame:
    """(by, at, output): each row's softmax average of the vectors of its sequence up to itself, with a sink logit; ``at`` is an integer.

    Rows in order of (by, at) are cut into blocks whatever their sequences. A block of queries meets the blocks of keys that
    share a sequence with it, each meeting gives a partial state of its queries, and states are merged, 32 blocks of keys at
    a time and then all. So a sequence of any length is never in one task, and a short one shares its block with others.
    """
    spread = running(rows.select(F.col(by).alias("by"), F.col(at).cast("long").alias("at"), doubles(F.col(vector)).alias("x")), ["by", "at"], place=("sum", F.lit(1)))
    one = F.struct("by", F.xxhash64("by").alias("code"), "at", "x")
    blocks = spread.groupBy(F.floor((F.col("place") - 1) / block).alias("block")).agg(F.collect_list(one).alias("rows"))
    first, last = F.array_min(F.transform("rows", lambda r: F.struct(r["by"], r["at"]))), F.array_max(F.transform("rows", lambda r: F.struct(r["by"], r["at"])))
    blocks = stored(blocks.select("block", first.alias("first"), last.alias("last"), "rows"), "attention-blocks")
    asked, seen = blocks.select(F.col("block").alias("q"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("rows").alias("asked")), blocks.select(F.col("block").alias("k"), "first", "last", "rows")
    meetings = asked.join(seen, F.col("q") == F.col("k")).unionByName(asked.join(seen, F.col("f.by").eqNullSafe(F.col("last.by")) & (F.col("k") < F.col("q"))))
    meetings = meetings.unionByName(asked.join(seen, F.col("l.by").eqNullSafe(F.col("first.by")) & (F.col("k") > F.col("q")) & (F.col("first.at") <= F.col("l.at"))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (code, place, x), (other, before, y) = _block(row["asked"]), _block(row["rows"])
                logits = np.where((code[:, None] == other) & (before <= place[:, None]), x @ y.T / np.sqrt(x.shape[1]), -np.inf)
                state = SoftmaxState.of(logits, y).packed()
                yield pa.RecordBatch.from_arrays([pa.array([row["q"]], pa.int64()), pa.array([row["k"] // 32], pa.int64()), *(pa.array([s], pa.binary()) for s in state)], names=["q", "part", "top", "whole", "output"])

    kind = "q long, part long, top binary, whole binary, output binary"

    def merge(table: pa.Table) -> pa.Table:
        states = [SoftmaxState.unpacked(*(table[c][i].as_py() for c in ("top", "whole", "output"))) for i in range(table.num_rows)]
        state = functools.reduce(SoftmaxState.merged, states).packed()
        return pa.table([table["q"].slice(0, 1).combine_chunks(), table["part"].slice(0, 1).combine_chunks(), *(pa.array([s], pa.binary()) for s in state)], names=["q", "part", "top", "whole", "output"])

    parts = meetings.select("q", "k", "asked", "rows").mapInArrow(meet, kind).groupBy("q", "part").applyInArrow(merge, kind)
    whole = parts.groupBy("q").applyInArrow(merge, kind).select("q", "top", "whole", "output")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                state = SoftmaxState.unpacked(*(row[c][0].as_py() for c in ("top", "whole", "output")))
                dims = state.output.shape[1]
                done = state.merged(SoftmaxState(np.full(len(state.top), float(sink)), np.ones(len(state.top)), np.zeros((len(state.top), dims))))
                given = row["rows"].flatten()
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(state.top) + 1) * dims, pa.int32()), pa.array((done.output / done.whole[:, None]).ravel()))
                yield pa.RecordBatch.from_arrays([given.field("by"), given.field("at"), out], names=["by", "at", "output"])

    joined = whole.join(blocks.select(F.col("block").alias("q"), "rows"), "q").select("top", "whole", "output", "rows")
    out = joined.mapInArrow(finish, f"by {spread.schema['by'].dataType.simpleString()}, at long, output array<double>")
    return out.select(F.col("by").alias(by), F.col("at").alias(at), "output")


def block_bounds(rows: DataFrame, block: str, vector: str, dims: int) -> DataFrame:
    """Least and greatest value of every coordinate of a block of rows: what a scan needs to skip it."""
    cells = rows.select(block, F.posexplode(vector).alias("i", "x")).groupBy(block, "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda r: r[c])
    return cells.groupBy(block).agg(ordered("low").alias("low"), ordered("high").alias("high"))


def bound(query: Column, low: Column, high: Column) -> Column:
    """The greatest dot product that a vector inside the bounds can have with the query."""
    best = F.zip_with(low, high, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return total(F.zip_with(query, best, lambda q, r: F.greatest(q.cast("double") * r["a"], q.cast("double") * r["b"])))


def _ordered_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, terms added from first to last, so that equal vectors give equal products."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _codes(x: np.ndarray, block: int = 32, top: int = 127) -> np.ndarray:
    """Vectors as the eight-bit codes of ``quantized`` give them back."""
    out = np.zeros(x.shape)
    for k in range(0, x.shape[1], block):
        part = x[:, k : k + block]
        scale = np.abs(part).max(1, keepdims=True) / top
        out[:, k : k + block] = np.where(scale > 0, np.rint(part / np.where(scale > 0, scale, 1.0)) * scale, 0.0)
    return out


def screened(rows: DataFrame, asked: DataFrame, key: str, vector: str, queries: int = 1024, block: int = 2048) -> DataFrame:
    """(q, best, score): the row of greatest dot product with each asked vector, other than itself; ties go to the least key.

    Rows and asked vectors are cut into blocks that meet pairwise; a meeting gives one row per asked vector. Inside it codes
    of eight bits give each product within a bound of their rounding, and only rows whose upper bound reaches the best lower
    bound are scored exactly. The bound never drops a winner. Keys are whole numbers; vectors have one length and no nulls.
    """

    def blocks(df: DataFrame, n: int, names: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // n)))).cast("int")
        numbered = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), doubles(F.col(vector)).alias("x"), part.alias("block"))
        lists = numbered.groupBy("block").agg(F.collect_list(F.struct("k", "x")).alias("r"))
        return stored(lists.select(F.col("r.k").alias(names[0]), F.flatten("r.x").alias(names[1])), "screened")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, x, ids, a = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("keys", "x", "ids", "a"))
                x, a = x.reshape(len(keys), -1), a.reshape(len(ids), -1)
                coded = _codes(x)
                near, off = a @ coded.T, np.abs(a).sum(1)[:, None] * np.abs(x - coded).max(1)
                other = ids[:, None] != keys
                least = np.where(other, near - off, -np.inf).max(1, keepdims=True)
                q, r = np.nonzero(other & (near + off >= least - 1e-9))
                score = _ordered_dots(a[q], x[r])
                order = np.lexsort((keys[r], -score, q))
                first = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[first]], pa.int64()), pa.array(keys[r[first]], pa.int64()), pa.array(score[first], pa.float64())], names=["q", "k", "d"])

    met = blocks(rows, block, ("keys", "x")).crossJoin(blocks(asked, queries, ("ids", "a")))
    best = met.mapInArrow(meet, "q long, k long, d double").groupBy("q").agg(F.min(F.struct((-F.col("d")).alias("m"), "k")).alias("b"))
    return best.select("q", F.col("b.k").alias("best"), F.round(-F.col("b.m"), 6).alias("score"))

