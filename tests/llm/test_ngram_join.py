"""The prefix-tree join against all pairs by brute force."""

import random

from folioflow.llm.ngram_join import ngram_components

SCHEMA = "doc_id long, text string, shingles int"


def brute(rows, size=4, percent=85):
    sets = []
    for doc, text, _ in rows:
        words = text.encode().lower().split() if text else []
        grams = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        sets.append((doc, grams))
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {(d, len(s), top(d)) for d, s in sets}


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, **more).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute(rows)


def test_near_copies_edges_and_ties(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(0, None, 1), (1, "", 1), (2, " \t\n", 1), (3, "One Two", 2), (4, "one\ttwo", 2), (5, "one two three four", 3), (6, "ONE two three four", 3), (7, "ÄÖ ä ö é", 4), (8, "äö ä ö é", 4)]
    base = [word() for _ in range(120)]
    for k in range(60):
        text = base[:]
        for _ in range(rng.randrange(9)):
            text[rng.randrange(len(text))] = word()
        rows.append((100 + k, " ".join(text), 0))
    shared = [word() for _ in range(30)]
    for k in range(40):
        text = [word() for _ in range(20)] + shared if k % 2 else [word() for _ in range(3)] + shared
        rows.append((300 + k, " ".join(text), 0))
    rows.append((900, " ".join(word() for _ in range(6000)), 0))
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, few=3, block=7)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_table_of_the_driver(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, 0) for r in docs.collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == brute(rows)


def test_rows_of_one_doc_id_keep_their_texts(spark):
    from folioflow.llm.ngram_join import group_heads

    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = lambda words, k: " ".join([*words[:k], "x", *words[k + 1 :]])
    rows = [(5, " ".join(one), 0), (5, " ".join(two), 0), (6, near(one, 59), 0), (7, near(two, 59), 0), (5, " ".join(one), 1), (8, " ".join(one), 0), (9, None, 0)]
    for _ in range(2):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = sorted((r.doc_id, r.component_id) for r in ngram_components(df).collect())
        assert got == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 9)]
        assert sorted(r.doc_id for r in group_heads(df).collect()) == [5, 5]
        rows.reverse()


def test_low_thresholds_and_wide_sizes(spark):
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(300)]
    rows = [(k, " ".join(shared[: 30 + 3 * k] + [f"{k}w{j}" for j in range(rng.randrange(250))]), 0) for k in range(60)]
    for percent in (10, 50, 100):
        check_at(spark, rows, percent)


def check_at(spark, rows, percent):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, SCHEMA), percent=percent, few=2, block=9).collect()}
    assert got == brute(rows, percent=percent)


def test_rows_without_an_id_are_linked_with_nothing(spark):
    rows = [(None, "a b c d e f", 0), (None, "a b c d e f", 0), (5, "a b c d e f", 0), (3, "a b c d e f", 0), (None, None, 0)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.class_id) for r in ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(None, 3, None, None), (None, 3, None, None), (5, 3, 3, 3), (3, 3, 3, 3), (None, 0, None, None)], key=repr)


def test_frequent_shingles_stand_out_of_full_buckets():
    import numpy as np

    from folioflow.llm.ngram_join import levels_of, packed, unpacked

    rng = np.random.default_rng(3)
    counts = rng.poisson(400, 1 << 19)
    frequent = np.zeros(len(counts), bool)
    frequent[rng.choice(len(counts), 2000, replace=False)] = True
    counts[frequent] += 128
    counts[7] = 3_000_000
    levels = levels_of(counts)
    assert np.percentile(levels[frequent], 2) > np.percentile(levels[~frequent], 99.9)
    assert levels[7] == levels.max() == 63
    assert (np.diff(levels[np.argsort(counts)].astype(int)) >= 0).all()
    assert (unpacked(packed(counts)) == counts).all()


def test_holders_meet_across_batches():
    import pyarrow as pa

    from folioflow.llm.ngram_join import _sharing

    rng = random.Random(4)
    sizes = {s: rng.choice([1, 1, 2, 3, 4, 5, 17]) for s in range(-40, 40)}
    rows = sorted((s, rng.randrange(9), 100 * s % 977 + k) for s, m in sizes.items() for k in range(m))
    wanted = {s: sorted((n, c) for x, n, c in rows if x == s) for s in sizes}
    for width in (1, 3, 10, 1000):
        cuts = [rows[k : k + width] for k in range(0, len(rows), width)]
        batches = [pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*cut, strict=True)], names=["shingle", "n", "cls"]) for cut in cuts]
        lists, edges = [], set()
        for out in _sharing(4)(iter(batches)):
            for r in out.to_pylist():
                if r["holders"] is None:
                    edges.add((r["cls"], r["hub"]))
                else:
                    lists.append([(h["n"], h["cls"]) for h in r["holders"]])
        assert sorted(lists) == sorted(w for w in wanted.values() if 1 < len(w) <= 4)
        assert edges == {(c, -(s & ((1 << 63) - 1)) - 1) for s, w in wanted.items() if len(w) > 4 for _, c in w}


def test_sets_at_the_ends_of_the_size_range(spark):
    rng = random.Random(6)
    rows = []
    for f in range(4):
        words = [f"{f}w{j}" for j in range(203)]
        for n in range(160 - 40 * (f % 2), 204, 3):
            rows.append((1000 * f + n, " ".join(words[:n] if f < 2 else words[203 - n :]), 0))
        for k in range(12):
            text = words[:]
            for _ in range(rng.randrange(4, 10)):
                text[rng.randrange(203)] = f"{f}x{rng.randrange(10**6)}"
            rows.append((1000 * f + 500 + k, " ".join(text[: rng.randrange(170, 204)]), 0))
    rng.shuffle(rows)
    for percent in (80, 85, 97):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()}
        assert got == brute(rows, percent=percent)
