"""Operator 1, n-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

1. One pass hashes each text into its shingle set and keeps its size and digest; it also counts shingles into a fixed
   number of buckets. Equal sets form a class, named by its least doc_id, so copies cost nothing later.
2. The global order puts shingles of thin buckets first (ties by hash). A bucket's level is how far it lies above the
   usual one, in deviations of chance, so a frequent shingle stands out of a bucket that holds hundreds of rare ones.
   Two sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1`` of either, so only those
   are looked at.
3. Their holders meet once, sorted by shingle. Shingles with few holders give candidate pairs, which must share as many
   of those shingles as their sizes ask for; a parity bitmap of each set then bounds the overlap from above before any
   set is moved. Holders of shingles with many are passed on as they come: they are tied to families, a family is dealt
   into size-bounded blocks that meet pairwise. A family whose sets are mostly unlike each other costs the square of its
   blocks.
4. Each task stores the sets of a group in a trie along the global order and walks it with each probe: sets with a
   common path share the partial overlap, and subtrees whose remaining length can't reach the threshold are cut.
   Links are exact: every candidate is decided by its whole sets.
5. Components of the links name the document groups.

Broadcast: the bucket levels (2**23 bytes) and a bitmap of candidate classes (2**22 bits), both of fixed size. Both are
destroyed when the links are stored.
Rows: one for each input row. Null or empty texts have an empty set and are linked with nothing. A set is known by its
doc_id and digest, so rows that share a doc_id keep their own texts and links; ``ngram_components`` ties such rows
together, as one document, ``group_heads`` doesn't. Rows with a null doc_id are linked with nothing. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.words import WordHashes, shingle_sets
from folioflow.operators.graph import Groups, connected_components
from folioflow.sources.workspace import discard, small_batches, stored

ORDER_BITS = 23
SLICES = 16
FLAG_BITS = 22


# ---- passes over the texts -------------------------------------------------------------------------------------------


DIGESTS = "doc_id long, mark long, n long, d1 long, d2 long, slice int, counts binary"


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: all low bytes, then the next ones."""
    planes = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """The counts of one slice from ``packed``."""
    n = (1 << ORDER_BITS) // SLICES
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _digests(size: int):
    """Rows for documents (slice null), then the partition's bucket counts in slices (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHashes(), np.zeros(1 << ORDER_BITS, np.uint32)
        mask = np.uint64((1 << ORDER_BITS) - 1)
        for batch in batches:
            n, d = [], []
            for s in shingle_sets(batch["text"].to_pylist(), size, memo):
                n.append(len(s))
                d.append(digest(s))
                np.add.at(counts, (s & mask).astype(np.int64), np.uint32(1))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(n, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["doc_id", "mark", "n", "d1", "d2", "slice", "counts"])
        parts = counts.reshape(SLICES, -1)
        kept = [k for k in range(SLICES) if parts[k].any()]
        none = pa.array([None] * len(kept), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(kept, pa.int32()), pa.array([packed(parts[k]) for k in kept], pa.binary())], names=["doc_id", "mark", "n", "d1", "d2", "slice", "counts"])

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the count arrays of each slice that reach this task; one row per slice and task comes out."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            new = unpacked(raw)
            sums[k] = sums[k] + new if k in sums else new
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(v) for v in sums.values()], pa.binary())], names=["slice", "counts"])


def levels_of(counts: np.ndarray) -> np.ndarray:
    """A level from 0 to 63 for each bucket, by its distance from the median in deviations; above four, by the logarithm."""
    usual = float(np.median(counts))
    z = (counts - usual) / math.sqrt(usual + 1)
    return np.floor(np.clip(np.where(z < 4, 4 * (z + 4), 32 + 3 * np.log2(np.maximum(z - 3, 1))), 0, 63)).astype(np.uint8)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sum_counts(batches):
        for k, raw in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels_of(unpacked(raw)).tobytes()], pa.binary())], names=["slice", "counts"])


def order_levels(counted: DataFrame) -> np.ndarray:
    """The level of each bucket; counts are summed in two steps on the executors, a slice's levels are made there too."""
    kind = "slice int, counts binary"
    part = counted.select("slice", "counts").mapInArrow(_sum_counts, kind)  # several input files a task
    levels = np.zeros((SLICES, (1 << ORDER_BITS) // SLICES), np.uint8)
    for row in part.repartition(SLICES, "slice").mapInArrow(_levels, kind).toLocalIterator():  # 16 rows of a fixed size
        levels[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return levels.ravel()


def _ordered(sets, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order is the global order: six bits of level, 58 of hash."""
    level = levels[(sets & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (sets >> np.uint64(6))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of 2**k hash slots (about as many as shingles): whether an odd number of shingles falls there."""
    slots = 1 << max(7, len(shingles).bit_length() - 1)
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def can_reach(n1: int, p1: bytes, n2: int, p2: bytes, percent: int) -> bool:
    """Whether two sets may reach the threshold: each odd slot of both parities together is a shingle that one lacks."""
    a, b = np.frombuffer(p1, np.uint8), np.frombuffer(p2, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    most = (n1 + n2 - int(np.bitwise_count(a ^ b).sum())) // 2
    return 100 * most >= percent * (n1 + n2 - most)


def _reaching(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("n1", "p1", "n2", "p2")), strict=True)
            yield batch.filter(pa.array([can_reach(*r, percent) for r in rows], pa.bool_())).select(["probe", "cls"])

    return run


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _prefixes(size: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = WordHashes(), levels.value
        for batch in batches:
            ids, d, n, parts, parities = [], [], [], [], []
            for doc, s in zip(batch["doc_id"].to_pylist(), shingle_sets(batch["text"].to_pylist(), size, memo), strict=True):
                if len(s) and doc is not None:
                    p = prefix_length(len(s), percent)
                    key = _ordered(s, table)
                    ids.append(doc)
                    d.append(digest(s))
                    n.append(len(s))
                    parts.append(np.partition(key, p - 1)[:p] if p < len(key) else key)
                    parities.append(parity(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(n, pa.int64()), _as_lists(parts), pa.array(parities, pa.binary())], names=["doc_id", "d1", "d2", "n", "prefix", "parity"])

    return run


def _whole_sets(size: int, levels, flags):
    """Ordered sets of the documents whose flag is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table, bits = WordHashes(), levels.value, flags.value
        for batch in batches:
            doc = np.array(batch["doc_id"].fill_null(-1)).astype(np.int64)
            slot = (doc % (1 << FLAG_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            sets = list(shingle_sets(batch["text"].to_pylist(), size, memo))
            d = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), _as_lists([np.sort(_ordered(s, table)) for s in sets])], names=["doc_id", "d1", "d2", "shingles"])

    return run


# ---- the trie --------------------------------------------------------------------------------------------------------


class Node:
    """A run of shingles without branch; ``ends`` are the sets that stop here, shortest and longest those below."""

    __slots__ = ("run", "children", "ends", "shortest", "longest")

    def __init__(self, run: np.ndarray, size: int):
        self.run, self.children, self.ends, self.shortest, self.longest = run, {}, [], size, size


def insert(root: Node, shingles: np.ndarray, name: int) -> None:
    node, at, size = root, 0, len(shingles)
    while True:
        node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
        if at == size:
            node.ends.append(name)
            return
        child = node.children.get(int(shingles[at]))
        if child is None:
            leaf = Node(shingles[at:], size)
            leaf.ends.append(name)
            node.children[int(shingles[at])] = leaf
            return
        rest = shingles[at : at + len(child.run)]
        differ = np.flatnonzero(child.run[: len(rest)] != rest)
        same = int(differ[0]) if len(differ) else len(rest)
        if same < len(child.run):
            upper = Node(child.run[:same], child.shortest)
            upper.longest = child.longest
            child.run = child.run[same:]
            upper.children[int(child.run[0])] = child
            node.children[int(shingles[at])] = upper
            child = upper
        node, at = child, at + same


STEP = 64


def walk(root: Node, probe: np.ndarray, percent: int, joined) -> Iterator[int]:
    """Names of the stored sets that reach the threshold with the probe. joined(names): whether all are known to be linked."""
    n = len(probe)
    stack = [(root, 0, 0, 0)]  # node, overlap so far, shingles walked, place in the probe
    while stack:
        node, overlap, depth, at = stack.pop()
        if 100 * node.longest < percent * n or 100 * n < percent * node.shortest:
            continue
        if not node.children and joined(node.ends):
            continue
        need = -(-percent * (n + max(node.shortest, -(-percent * n // 100))) // (100 + percent))  # for the easiest size below
        run, cut = node.run, False
        for k in range(0, len(run), STEP):
            part = run[k : k + STEP]
            place = np.searchsorted(probe[at:], part) + at
            inside = place < n
            overlap += int(np.count_nonzero(probe[place[inside]] == part[inside]))
            at, depth = int(place[-1]), depth + len(part)
            if overlap + min(node.longest - depth, n - at) < need:
                cut = True
                break
        if cut:
            continue
        if node.ends and 100 * overlap >= percent * (n + depth - overlap):
            yield from node.ends
        stack += [(c, overlap, depth, at) for c in node.children.values()]


LINKS = "a long, b long, a_id long, b_id long"


def _trie_links(percent: int):
    """Rows (key.., cls, doc_id, side, shingles) sorted by key; side 0 is stored, 1 probes, 2 does both. Gives spanning links."""

    def decide(names, sides, sets) -> list[tuple[int, int]]:
        groups, found, root = Groups(), [], Node(np.zeros(0, np.uint64), 1 << 60)
        order = sorted(range(len(names)), key=lambda i: (len(sets[i]), names[i]))
        root.longest = 0
        for i in order:
            if sides[i] != 1:
                insert(root, sets[i], names[i])
        for i in order:
            if sides[i]:
                me = names[i]
                for other in walk(root, sets[i], percent, lambda names, me=me: all(groups.top(x) == groups.top(me) for x in names)):
                    if other != me and groups.join(other, me):
                        found.append((other, me))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, ids, sides, sets = None, [], {}, [], []

        def out():
            pairs = decide(names, sides, sets)
            cells = zip(*((a, b, ids[a], ids[b]) for a, b in pairs), strict=True) if pairs else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cells], names=["a", "b", "a_id", "b_id"])

        for batch in batches:
            lists = batch["shingles"]
            ends = np.array(lists.offsets)
            flat = np.array(lists.values).view(np.uint64)
            for r, (k, cls, doc, side) in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "cls", "doc_id", "side")), strict=True)):
                if k != key:
                    if len(names) > 1:
                        yield out()
                    key, names, ids, sides, sets = k, [], {}, [], []
                names.append(cls)
                ids[cls] = doc
                sides.append(side)
                sets.append(flat[ends[r] : ends[r + 1]].copy())
        if len(names) > 1:
            yield out()

    return run


# ---- the join --------------------------------------------------------------------------------------------------------


SHARING = "holders array<struct<n:bigint,cls:bigint>>, cls long, hub long"


def _sharing(few: int):
    """Rows (shingle, n, cls) sorted by all three: the holders of a shingle as a list, or (cls, hub) where they are many.

    No more than ``few`` + 1 holders wait, and the rest of a batch; a hub is the shingle below zero.
    """
    kind = pa.list_(pa.struct([("n", pa.int64()), ("cls", pa.int64())]))

    def out(lists: list[tuple[np.ndarray, np.ndarray]], cls: list[np.ndarray], hubs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        def rows(holders, c, h):
            return pa.RecordBatch.from_arrays([holders, c, h], names=["holders", "cls", "hub"])

        sizes = [len(n) for n, _ in lists]
        if sizes:
            fields = [pa.array(np.concatenate([x[i] for x in lists])) for i in (0, 1)]
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            empty = pa.nulls(len(sizes), pa.int64())
            yield rows(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["n", "cls"])), empty, empty)
        if cls:
            c = np.concatenate(cls)
            yield rows(pa.nulls(len(c), kind), pa.array(c), pa.array(np.concatenate(hubs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros(0, np.int64)] * 3  # the last shingle's holders, which may go on in the next batch
        many = None  # a shingle whose first holders have left already
        for batch in batches:
            s, n, c = (np.concatenate([w, np.array(batch[k])]) for w, k in zip(waiting, ("shingle", "n", "cls"), strict=True))
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(s)]
            lists, cls, hubs = [], [], []
            last = len(starts) - 1
            for i in np.flatnonzero(((ends - starts) > 1) | (s[starts] == many)) if many is not None else np.flatnonzero((ends - starts) > 1):
                a, b = starts[i], ends[i]
                if b - a > few or s[a] == many:
                    many = s[a]
                    cls.append(c[a:b])
                    hubs.append(np.full(b - a, -(int(s[a]) & ((1 << 63) - 1)) - 1))
                elif i < last:
                    lists.append((n[a:b], c[a:b]))
            keep = starts[last] if last >= 0 and s[starts[last]] != many else len(s)
            waiting = [x[keep:] for x in (s, n, c)]
            yield from out(lists, cls, hubs)
        if len(waiting[0]) > 1:
            yield from out([(waiting[1], waiting[2])], [], [])

    return run


def _candidate_pairs(percent: int):
    """Class pairs of holder lists whose sizes can reach the threshold, and how often; (probe, stored), the smaller set probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int, int, int], int] = {}
            for holders, times in zip(batch["holders"].to_pylist(), batch["times"].to_pylist(), strict=True):
                for i, x in enumerate(holders):
                    for y in holders[i + 1 :]:
                        if 100 * x["n"] < percent * y["n"]:
                            break
                        key = (x["cls"], y["cls"], x["n"], y["n"])
                        found[key] = found.get(key, 0) + times
            cells = [*zip(*found, strict=True), list(found.values())] if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cells], names=["probe", "cls", "n1", "n2", "shared"])

    return run


def _flags(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over doc_id modulo 2**22; at most 65,536 rows reach the driver."""
    slot = F.pmod(F.col("doc_id"), F.lit(1 << FLAG_BITS))
    rows = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(doc_id, {1 << FLAG_BITS}) % 64 as int))")).alias("bits")).collect()
    words = np.zeros(1 << (FLAG_BITS - 6), np.int64)
    for r in rows:
        words[r["w"]] = r["bits"]
    return words.view(np.uint8)


def jaccard_links(docs: DataFrame, size: int = 4, percent: int = 85, few: int = 64, block: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, classes, links)``, all but rows stored.

    rows: doc_id, mark (hash of the text), n, d1, d2 (digest) of each document. classes: cls, class_id, d1, d2, n of each
    different set. links: pairs of classes (a, b) and their doc_ids (a_id, b_id) that span all groups.
    few: holders up to which a shingle gives pairs; above it its holders form a family. block: sets of a family that
    one task stores at once. Neither changes the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_digests(size), DIGESTS), "digests")
    levels = spark.sparkContext.broadcast(order_levels(first.where("slice is not null")))
    rows = first.where("slice is null").select("doc_id", "mark", "n", "d1", "d2")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    names = classes.select(F.col("class_id").alias("doc_id"), "d1", "d2", "cls")
    one_set = ["doc_id", "d1", "d2"]

    prefixes = texts.mapInArrow(_prefixes(size, percent, levels), "doc_id long, d1 long, d2 long, n long, prefix array<long>, parity binary")
    prefixes = stored(prefixes.join(names, one_set).dropDuplicates(one_set).select("cls", "n", "prefix", "parity"), "prefixes")
    held = prefixes.select("cls", "n", F.explode("prefix").alias("shingle")).select("shingle", "n", "cls")
    sharing = stored(held.repartition("shingle").sortWithinPartitions("shingle", "n", "cls").mapInArrow(_sharing(few), SHARING), "sharing")

    # What two sets share beyond their prefixes lies after the one that ends first, so it is at most ceil(t n) - 1 of the
    # larger n. Shingles with many holders aren't counted: sets that share one of those meet in their family.
    beyond = F.expr(f"({percent} * n2 + 99) div 100 - 1")
    needed = F.expr(f"({percent} * (n1 + n2) + {99 + percent}) div {100 + percent}")
    pairs = (
        sharing.where("holders is not null")
        .groupBy("holders")
        .agg(F.count("*").alias("times"))
        .mapInArrow(_candidate_pairs(percent), "probe long, cls long, n1 long, n2 long, shared long")
        .groupBy("probe", "cls", "n1", "n2")
        .agg(F.sum("shared").alias("shared"))
        .where(F.col("shared") + beyond >= needed)
        .select("probe", "cls")
    )
    one = prefixes.select(F.col("cls").alias("probe"), F.col("n").alias("n1"), F.col("parity").alias("p1"))
    two = prefixes.select("cls", F.col("n").alias("n2"), F.col("parity").alias("p2"))
    pairs = stored(pairs.join(one, "probe").join(two, "cls").select("probe", "cls", "n1", "p1", "n2", "p2").mapInArrow(_reaching(percent), "probe long, cls long"), "pairs")

    # a frequent shingle is a vertex of its own, below zero: its holders are never gathered by it
    family = connected_components(sharing.where("hub is not null"), "cls", "hub").where("vertex >= 0")
    base = math.log(100 / percent * (1 + 1e-6))  # sets that can reach the threshold lie in one scale or in neighbouring ones
    scaled = family.join(classes, family.vertex == classes.cls).select("cls", "component", F.floor(F.ln("n") / base).cast("int").alias("scale"))
    members = scaled.groupBy("component", "scale").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = members.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("scale", "blocks"))).alias("all"))
    at = lambda k: F.try_element_at("all", F.col("scale") + k)
    dealt = stored(scaled.join(members, "component").select("cls", "component", "scale", at(0).alias("blocks"), at(1).alias("above"), at(-1).alias("below"), F.pmod(F.xxhash64("cls"), at(0)).cast("int").alias("mine")), "dealt")
    scale, mine = F.col("scale"), F.col("mine")

    def met(s1, b1, s2, b2, side):
        """The meeting of two blocks, and whether this one is stored there (0), probes (1) or does both (2)."""
        return F.struct(F.xxhash64("component", s1, b1, s2, b2).alias("id"), F.lit(side).cast("int").alias("side"))

    none = F.array().cast("array<struct<id:bigint,side:int>>")
    meets = F.flatten(
        F.array(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda j: F.when(mine < j, met(scale, mine, scale, j, 0)).when(mine > j, met(scale, j, scale, mine, 1)).otherwise(met(scale, mine, scale, mine, 2)),
            ),
            F.coalesce(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: met(scale, mine, scale + 1, j, 0)), none),
            F.coalesce(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: met(scale - 1, j, scale, mine, 1)), none),
        )
    )
    probes = F.concat(F.lit("0:"), "probe").alias("key")
    tasks = (
        pairs.select(probes, "cls", F.lit(0).alias("side"))
        .union(pairs.select(probes, F.col("probe").alias("cls"), F.lit(1).alias("side")).distinct())
        .union(dealt.select("cls", F.explode(meets).alias("m")).select(F.concat(F.lit("1:"), "m.id"), "cls", "m.side"))
    )
    wanted = pairs.select("cls").union(pairs.select("probe")).union(dealt.select("cls")).distinct().join(names, "cls")
    flags = spark.sparkContext.broadcast(_flags(wanted))
    sets = texts.mapInArrow(_whole_sets(size, levels, flags), "doc_id long, d1 long, d2 long, shingles array<long>").dropDuplicates(one_set)
    called = tasks.join(names, "cls").join(sets, one_set).select("key", "cls", "doc_id", "side", "shingles")
    links = stored(called.repartition("key").sortWithinPartitions("key").mapInArrow(_trie_links(percent), LINKS), "links")
    for used in (levels, flags):
        used.destroy()
    for done in (prefixes, sharing, pairs, dealt):
        discard(done)
    return rows, classes, links


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85, few: int = 64, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and class_id (least doc_id with the same set).

    docs needs doc_id and text. A document with an empty set, or a null doc_id, is its own component. Rows that share a
    doc_id are one document: what is linked with any of their texts is in one component. Each row is returned.
    """
    rows, classes, links = jaccard_links(docs, size, percent, few, block)
    sets = rows.where("n > 0 and doc_id is not null")
    several = sets.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("one"), F.max(F.struct("d1", "d2")).alias("two")).where("one <> two").select("doc_id")
    same = sets.join(several, "doc_id", "left_semi").join(classes, ["d1", "d2", "n"]).select("doc_id", "class_id")
    components = stored(connected_components(links.select("a_id", "b_id").union(same), "a_id", "b_id"), "components")
    known = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), "class_id")
    out = rows.join(known, F.col("doc_id").isNotNull() & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    return (
        out.join(components, out.class_id == components.vertex, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "class_id", "doc_id").alias("component_id"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
        )
    )


def group_heads(docs: DataFrame, size: int = 5, percent: int = 80, few: int = 64, block: int = 512) -> DataFrame:
    """(doc_id, mark) of one text of each group of linked texts, the one of least doc_id; mark is xxhash64 of the text.

    Rows that share a doc_id are texts of their own. Rows without words or doc_id are in no group.
    """
    rows, classes, links = jaccard_links(docs, size, percent, few, block)
    components = stored(connected_components(links, "a", "b"), "components")
    grouped = classes.join(components, classes.cls == components.vertex, "left").select(F.coalesce("component", "cls").alias("group"), F.struct("class_id", "d1", "d2").alias("one"))
    heads = grouped.groupBy("group").agg(F.min("one").alias("one")).select(F.col("one.class_id").alias("doc_id"), "one.d1", "one.d2")
    return rows.join(heads, ["doc_id", "d1", "d2"]).groupBy("doc_id", "d1", "d2").agg(F.min("mark").alias("mark")).select("doc_id", "mark")
