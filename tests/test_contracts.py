"""Contracts, merged dictionaries, gates and draws on small fixtures; loops of Gram-weighted errors."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import audits, contracts, joins, vectors


def test_rules_on_whole_and_broken_records(spark):
    kind = "k int, token_ids array<int>, output_tokens int, finish_reason string, text string, teacher_forced boolean, precision string, width int, height int, input_tokens int, timings map<string,double>, options struct<max_new_tokens:int,max_dimension:int>"
    times = dict.fromkeys(contracts.TIMINGS, 1.0)
    fine = {"token_ids": [5, 6, 11], "output_tokens": 3, "finish_reason": "eos", "text": "", "teacher_forced": False, "precision": "bf16", "width": 32, "height": 16, "input_tokens": 18, "timings": times, "options": (4, 64)}
    changes = [
        ({}, []), ({"token_ids": [5, 6, 7, 8], "output_tokens": 4, "finish_reason": "length"}, []),
        ({"token_ids": [5, 11, 11]}, ["no_stop_inside"]), ({"token_ids": None}, ["valid_token_ids", "output_count", "finish_reason", "no_stop_inside"]),
        ({"token_ids": [5, -1, 11]}, ["valid_token_ids"]), ({"token_ids": [5, None, 11]}, ["valid_token_ids", "no_stop_inside"]), ({"output_tokens": 2}, ["output_count"]), ({"text": None}, ["text_string"]), ({"teacher_forced": None}, ["free_running"]),
        ({"width": 24}, ["image_dimensions", "prefix_patch_shape"]), ({"input_tokens": 19}, ["prefix_patch_shape"]), ({"options": (0, 64)}, ["valid_output_budget", "output_count"]),
        ({"timings": times | {"decode_ms": math.nan}}, ["timing.decode_ms", "other_timings"]), ({"timings": times | {"x": -1.0}}, ["other_timings"]), ({"timings": None}, [*(f"timing.{t}" for t in contracts.TIMINGS), "other_timings"]),
    ]
    rows = [(i, *(fine | c).values()) for i, (c, _) in enumerate(changes)]
    df = spark.createDataFrame(rows, kind)
    rules = contracts.result_rules(strict=True)
    got = {r.k: r.broken for r in contracts.breaches(df, rules, "k").collect()}
    assert got == {i: b for i, (_, b) in enumerate(changes) if b}
    sums = {r.rule: r.broken for r in contracts.counted(df, rules).collect()}
    assert sums == {name: sum(name in b for _, b in changes) for name in rules}
    parts = spark.createDataFrame([(1, 10.0, 4.0, 6.0), (2, 10.0, 4.0, 6.1), (3, 10.0, 11.0, 0.0), (4, 10.0, None, 1.0)], "k int, t double, a double, b double")
    found = {r.k: r.broken for r in contracts.breaches(parts, contracts.interval_rules(F.col("t"), {"a": F.col("a"), "b": F.col("b")}), "k").collect()}
    assert found == {2: ["parts"], 3: ["part.a", "parts"], 4: ["part.a", "parts"]}
    ranges = spark.createDataFrame([([0.0, 1.0],), ([1.1],), ([None],), (None,), ([],), ([math.nan],)], "v array<double>")
    assert [r[0] for r in ranges.select(contracts.within(F.col("v"), -1, 1)).collect()] == [True, False, False, False, True, False]


def test_dictionaries_gates_and_draws(spark):
    one = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("d", 4, "y")], "k string, n int, s string")
    two = spark.createDataFrame([("a", 1, None), ("b", 2, "z"), ("c", 3, "q"), ("d", 4, None), ("c", 3, "q")], "k string, n int, s string")
    got = {r.k: (r.n, r.s, r.sources, r.conflict) for r in contracts.merged({"two": two, "one": one}, "k", ["n", "s"]).collect()}
    assert got == {"a": (1, None, ["one", "two"], False), "b": (None, None, ["one", "two"], True), "c": (3, "q", ["two"], False), "d": (None, None, ["one", "two"], True)}
    logits = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0],), ([],), (None,)], "v array<double>")
    found = [r[0] for r in logits.select(contracts.winner(F.col("v"))).collect()]
    assert found[0].at == 1 and abs(found[0].probability - 1 / (2 + math.exp(-2))) < 1e-12 and found[1].probability == 1 and found[2] is None and found[3] is None
    steps = [([0.9, 0.9, 0.5], [True, False, True]), ([0.2], [True]), ([0.95, 0.95], [True, True]), ([], [])]
    out = contracts.swept(spark.createDataFrame(steps, "c array<double>, h array<boolean>"), "c", "h", [0.8], 9.0, (1.7, 1.0), 0.6).first()
    assert (out.drafted, out.kept) == (4, 3) and abs(out.speedup - 7 * 9 / (4 * 9 + 2 * (0.6 + 1.7 + 1.0))) < 1e-9
    rows = [(f"c{i % 3}" if i % 10 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "c string, i int")
    want = set()
    for c in ("c0", "c1", "c2"):
        drawn = sorted((hashlib.sha256(f"s\0{c}\0{i}".encode()).hexdigest(), i) for x, i in rows if x == c)
        want |= {(c, i) for h, i in [d for d in drawn if int(d[0][:12], 16) < int(0.5 * (1 << 48))][:7]}
    for parts in (1, 5):
        assert {tuple(r) for r in contracts.drawn(df.repartition(parts), "c", "i", 7, 0.5, "s").collect()} == want


def test_repetitions_tell_outputs_apart(spark):
    base = [("a", 1), ("b", 2), ("b", 2), (None, 3)]
    outputs = {0: [base, base[::-1]], 1: [base, base[:3]], 2: [base, [("a", 1), ("b", 2), ("c", 2), (None, 3)]], 3: [base], 4: [[("a", 1), ("c", 3)], [("a", 3), ("c", 1)]]}
    rows = [(case, k, *row) for case, reps in outputs.items() for k, out in enumerate(reps) for row in out]
    df = spark.createDataFrame(rows, "case int, repetition int, text string, n int")
    got = {r.case: (r.repetitions, r.identical) for r in audits.repetitions(df, ["case"], "repetition", ["text", "n"]).collect()}
    assert got == {0: (2, True), 1: (2, False), 2: (2, False), 3: (1, True), 4: (2, False)}


def test_digests_of_repetitions_stay_where_their_rows_are(spark, sf):
    """One shuffle, of whole rows by case; a case's digests are compared in the same task."""
    from folioflow.plans.audits import identical_repetitions

    plan = identical_repetitions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange ") == 1


def test_gram_matrices_and_weighted_errors(spark):
    rng = np.random.default_rng(2)
    x, d, w = rng.normal(size=(50, 10)), rng.normal(size=(6, 10)), rng.normal(size=(6, 10))
    vectors_df = spark.createDataFrame([("g" if i % 2 else None, v.tolist()) for i, v in enumerate(x)] + [("g", [1.0]), ("g", None), ("g", [None] * 10)], "g string, v array<double>")
    sums = vectors.gram_sums(vectors_df.repartition(3), "g", "v", 10).groupBy("g", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    for g, part in (("g", x[1::2]), (None, x[::2])):
        whole = part.T @ part
        assert all(abs(r.v - whole[r.i, r.j]) < 1e-9 and r.n == 25 for r in sums if r.g == g)
    gram = x.T @ x / 50
    cells = lambda m: spark.createDataFrame([("k", i, j, float(m[i, j])) for i in range(6) for j in range(10) if (i + j) % 4], "k string, row int, col int, v double")
    mask = np.array([[bool((i + j) % 4) for j in range(10)] for i in range(6)])
    g = spark.createDataFrame([(i, j, float(gram[i, j])) for i in range(10) for j in range(10)], "i int, j int, gram double")
    want = math.sqrt(np.trace((d * mask) @ gram @ (d * mask).T) / np.trace((w * mask) @ gram @ (w * mask).T))
    for block in (3, 64):
        assert abs(vectors.weighted_error(cells(d), cells(w), g, ["k"], block).first().error - want) < 1e-9


def test_contaminated_by_sets_of_grams(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(6)] + [(9, "same " * 30), (10, "short text"), (11, None)]
    docs = [(i, " ".join([*(rng.choice(words) for _ in range(20)), *(items[i % 6][1].split()[5 : 5 + i % 25]), "End."])) for i in range(60)] + [(90, None), (91, ""), (92, "same " * 40)]
    grams = lambda t: {tuple(t.lower().replace(".", "").split()[i : i + 13]) for i in range(len((t or "").split()) - 12)} if t else set()
    known = {}
    for i, t in items:
        for g in grams(t):
            if len(set(g)) >= 8:
                known[g] = min(i, known.get(g, i))
    want = {}
    for i, t in docs:
        hits = [known[g] for g in grams(t) if g in known]
        if len(hits) >= 3:
            want[i] = (len(hits), min(set(hits), key=lambda x: (-hits.count(x), x)))
    out = joins.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id")
    assert {r.doc_id: (r.hits, r.top_item) for r in out.collect()} == want and len(want) > 10


def test_weighted_error_of_rows_moves_sums_only(spark):
    rng = np.random.default_rng(11)
    d, w = rng.standard_normal((2, 200, 6))
    g = w.T @ w / 200
    gram = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(6) for j in range(6)], "i int, j int, gram double")
    rows = spark.createDataFrame([("k", a.tolist(), b.tolist()) for a, b in zip(d, w, strict=True)], "k string, d array<double>, w array<double>")
    got = vectors.row_weighted_error(rows, "k", "d", "w", gram, 6)
    assert abs(got.first().error - np.sqrt(np.trace(d @ g @ d.T) / np.trace(w @ g @ w.T))) < 1e-9


def test_screened_by_blocks_takes_the_least_key_of_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 40))
    x[60:] = x[:60]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.q: r.best for r in vectors.screened(rows, rows.where("id % 3 = 0"), "id", "v", 7, 11).collect()}
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert got == {q: int(np.flatnonzero(score[q] >= score[q].max() - 1e-9)[0]) for q in range(0, 120, 3)}
