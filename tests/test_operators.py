"""Operators that SQL can't express, against plain versions."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import pixels, proposals, sampling, scoring, vectors
from folioflow.plans.registry import QUERIES
from folioflow.streaming import stateful


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["été", "two", "x", "ß東", "five"]) for _ in range(rng.randrange(1, 40)))) for c in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.role: r for r in QUERIES["error_rates"](spark, str(tmp_path)).collect()}
    plain = {r.role: r for r in QUERIES["cer_ascii_pairs"](spark, str(tmp_path)).collect()}
    for role in ("user", "assistant"):
        pairs = [(a[3], b[3]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[2] == role]
        c, w = [edits(a, b) for a, b in pairs], [edits(a.split(), b.split()) for a, b in pairs]
        n, m = [len(a) for a, _ in pairs], [len(a.split()) for a, _ in pairs]
        mean = lambda e, k: sum(x / y for x, y in zip(e, k)) / len(e)
        assert (got[role].cer, got[role].wer) == pytest.approx((sum(c) / sum(n), sum(w) / sum(m)), abs=1e-6)
        assert (got[role].cer_macro, got[role].wer_macro) == pytest.approx((mean(c, n), mean(w, m)), abs=1e-6)
        assert plain[role].micro == got[role].cer and plain[role].n == len(pairs)


def test_bounded_edits(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.item_id: r.edits for r in QUERIES["bounded_levenshtein"](spark, sf).collect()}
    assert got == {i: (e if (e := edits(t, items[i + 1])) <= 60 else None) for i, t in items.items() if i + 1 in items}


def test_resampling_by_plain_sums(spark):
    rng = random.Random(2)
    page = [[rng.randrange(256) for _ in range(9)] for _ in range(7)]
    df = spark.createDataFrame([(1, y, x, page[y][x]) for y in range(7) for x in range(9)], "page int, y int, x int, v int")

    def kernel(x):
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else (((x - 5) * x + 8) * x - 4) * -0.5 if x < 2 else 0.0

    def line(values, out):
        size, done = len(values), []
        scale = size / out
        wide = max(scale, 1.0)
        for to in range(out):
            centre = (to + 0.5) * scale
            places = range(max(int(centre - 2 * wide + 0.5), 0), min(int(centre + 2 * wide + 0.5), size))
            raw = [kernel((p - centre + 0.5) / wide) for p in places]
            fixed = [int(w / sum(raw) * (1 << 22) + (0.5 if w > 0 else -0.5)) for w in raw]
            done.append(min(max(sum(f * values[p] for f, p in zip(fixed, places)) + (1 << 21) >> 22, 0), 255))
        return done

    rows = [line(r, 4) for r in page]
    want = list(zip(*(line(list(c), 11) for c in zip(*rows))))
    got = {(r.y, r.x): r.v for r in pixels.resized(df, 9, 7, 4, 11).collect()}
    assert got == {(y, x): want[y][x] for y in range(11) for x in range(4)}


def test_proposals(spark):
    rows = [(1, [1, 2, 3, 9, 1, 2, 3], None), (2, [7, 7, 7], None), (3, [1, 2, 3, 4], [5, 1, 2, 3, 4, 8, 9, -1, 6]), (4, [1, 2], [1, 2, 3]), (5, [4, 5, 1, 4, 5, 2, 4, 5], None), (6, [], None)]
    df = spark.createDataFrame(rows, "id long, t array<int>, past array<int>")
    got = {r.id: (r["size"], r.start, r.draft) for r in proposals.proposals(df, "id", "t", draft=5, history="past").collect()}
    assert got == {1: (3, 3, [9, 1, 2, 3, 9]), 2: (2, 2, [7] * 5), 3: (4, -1, [8, 9]), 5: (2, 5, [2, 4, 5, 2, 4])}
    same = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 5]), ([9], [1])], "d array<int>, t array<int>")
    assert [r[0] for r in same.select(proposals.accepted(F.col("d"), F.col("t"))).collect()] == [2, 1, 0]


def test_draft_policy(spark, sf):
    events = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value").collect())
    state, want = {}, {}
    for user, at, value in events:
        smooth, idle = state.get(user, (0.6, 0))
        draft = smooth > 0.5 or idle >= 15
        smooth, idle = (smooth * 0.85 + value % 100 / 100 * 0.15, 0) if draft else (smooth, idle + 1)
        state[user], want[user, at] = (smooth, idle), (round(smooth, 9), draft)
    got = {(r.user_id, r.event_id): (r.smooth, r.draft) for r in QUERIES["draft_policy"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-8 for k in want)


def test_separated_tiles(spark):
    rows = [(1, x, y, s) for x, y, s in [(0, 0, 9.0), (1, 1, 8.0), (4, 0, 7.0), (0, 4, 6.0), (5, 5, 5.0), (9, 9, 4.0)]]
    got = [(r.x, r.y) for r in sampling.separated(spark.createDataFrame(rows, "p int, x int, y int, s double"), "p", "x", "y", "s", 3, 4).orderBy("nth").collect()]
    assert got == [(0, 0), (4, 0), (0, 4), (5, 5)]
    assert sampling.abba(3) == ["A", "B", "B", "A", "A", "B"]


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100)) for i in range(2000)]
    got = {r.k: (r.total, r.top) for r in sampling.running(spark.createDataFrame(rows, "k long, v long").repartition(9), ["k"], total=("sum", F.col("v")), top=("max", F.col("v"))).collect()}
    total = top = 0
    for k, v in rows:
        total, top = total + v, max(top, v)
        assert got[k] == (total, top)


def test_tree_models_are_checked():
    fine = scoring.exported(0.5, [[{"feature": 0, "threshold": 1.0, "left": 1, "right": 2}, {"value": 1}, {"value": 2}]], ["a"])
    assert scoring.parsed_trees(fine, ["a"])["baseline"] == 0.5
    for bad in (fine.replace('"left": 1', '"left": 0'), fine.replace('"right": 2', '"right": 9'), fine.replace('"version": 1', '"version": 2'), fine.replace('{"value": 1}', "{}")):
        with pytest.raises(ValueError):
            scoring.parsed_trees(bad, ["a"])
    with pytest.raises(ValueError):
        scoring.parsed_trees(fine, ["b"])


def test_mixing_generator():
    assert vectors.splitmix(0) == 0xE220A8397B1DCDAF
    assert set(vectors.signs(5)) == {1, -1}


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(lane, at, float(lane * 100 + at), at == 11 and lane == 2) for lane in range(3) for at in range(20) if (lane, at) != (1, 7)]
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "lane long, at long, v double, bad boolean").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}.parquet")
    path = tmp_path / "flat"
    path.mkdir()
    for k in range(4):
        for f in (tmp_path / f"in/part{k}.parquet").glob("*.parquet"):
            f.rename(path / f"{k}.parquet")
    stream = stateful.opened(spark, str(path), files=1)
    blocked = stateful.waiting_failure(spark.createDataFrame([(1, 0, False), (1, 2, True), (2, 0, True)], "l long, i long, f boolean"), "l", "i", "f")
    assert [tuple(r) for r in blocked.collect()] == [(1, 1)]
    cohorts = stateful.finished(stateful.counted_cohorts(stream, "lane", "v", 6), "c").collect()
    assert sorted((r.lane, r.cohort, r.n) for r in cohorts) == [(lane, c, 6) for lane in range(3) for c in range(3)]


def test_grams_of_long_texts_are_marked_once_a_place(spark):
    from folioflow.operators import joins

    long = " ".join(f"w{k % 5000}" for k in range(60_000))  # told apart pair by pair, the runs of one such text take minutes
    docs = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, None), (4, "W0 w1, w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "doc_id long, text string")
    began = time.time()
    rows = joins.gram_marks(docs, "doc_id", 13).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("unlike")).collect()
    assert {tuple(r) for r in rows} == {(1, 60_000 - 12, 5000), (4, 1, 1)}
    assert time.time() - began < 30
    known = spark.createDataFrame([(7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (8, "a a a a a a a a a a a a a a a a")], "item_id long, text string")
    assert [tuple(r) for r in joins.contaminated(docs, known, "doc_id", "item_id").collect()] == [(1, 3, 7)]


def test_simhash_of_long_texts_by_plain_votes(spark):
    from folioflow.operators import joins

    def plain(text):
        words = set(re.findall("[a-z0-9]+", text.lower()))
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
        return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else None

    texts = [" ".join(f"w{k % 40_000}x{j}" for k in range(60_000)) for j in range(4)] + ["a b a", "A, b! é", "...", "", "one"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(2)
    joins.simhash(rows.where("doc_id > 3"), "doc_id").collect()
    began = time.time()
    got = {r.doc_id: r.simhash for r in joins.simhash(rows, "doc_id").collect()}
    assert time.time() - began < 8  # 60 passes over a text's hashes took longer
    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t) is not None}


def test_latest_places_of_grams_over_parts(spark, tmp_path):
    """Grams across parts, parts of one place and null tokens, by plain lists; more input is dealt to more tasks."""
    import random

    from pyspark.sql import functions as F

    from folioflow.operators.proposals import last_occurrences
    from folioflow.plans.decisions import gram_index
    from folioflow.sources.workspace import tasks_for

    rng = random.Random(6)
    parts = [(d, t, [rng.choice("abcü") for _ in range(rng.choice([0, 1, 1, 2, 3, 9, 40]))]) for d in (1, 2, None) for t in range(30)]
    parts += [(4, 0, ["a", "b"]), (4, 1, list("cde")), (4, 1, list("CD")), (4, None, ["z"]), (4, 2, None), (5, 0, ["a", "b", None, *"abcdabcd"]), (6, 0, list("abc"))]
    tokens = {d: [w for p in sorted((p for p in parts if p[0] == d and p[2]), key=lambda p: p[1]) for w in p[2]] for d in (1, 2, None, 5, 6)} | {4: [*"ab", "C", "c", "D", "d", "e", "z"]}
    df = spark.createDataFrame(parts, "d long, t long, w array<string>")
    for size in (1, 2, 4):
        want = {(d, " ".join(g)): i + size for d, w in tokens.items() for i in range(len(w) - size + 1) if None not in (g := w[i : i + size])}
        for tasks in (None, 1, 7):
            assert {(r.d, r.gram): r["last"] for r in last_occurrences(df, "d", "t", "w", " ", size, tasks).collect()} == want
    weights = spark.createDataFrame([(10,), (None,), (25,)], "n long")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert (tasks_for(weights, F.col("n"), 5), tasks_for(weights, F.col("n"), 40), tasks_for(weights.limit(0), F.col("n"), 5)) == (max(7, least), least, least)
    many = spark.range(600).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.repeat(F.lit("one two six ten "), 4096).alias("text"))
    many.write.parquet(f"{tmp_path}/conversations.parquet")
    assert gram_index(spark, str(tmp_path)).rdd.getNumPartitions() == -(-600 * 65536 // (1 << 22)) > least
