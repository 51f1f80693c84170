"""Loop stops: whole sequences, token by token, and as a stream; ordered release and page proposals as keyed state."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import loops
from folioflow.streaming import keyed, stateful

ZERO = 10  # tokens 10 to 19 are the digits
DIGITS = {ZERO + d: d for d in range(10)}


def spelled(number):
    return [ZERO + int(c) for c in str(number)]


def counted(prefix, numbers, row):
    return [1000 + k for k in range(prefix)] + [t for n in numbers for t in [*spelled(n), *row]]


def by_tokens(tokens, rule=loops.Rule(), cut=None):
    """(stop, rule, period) of the detector, packed and unpacked at places of ``cut``."""
    detector = loops.Detector(rule)
    for at, token in enumerate(tokens):
        if cut and at % cut == 0:
            detector = loops.Detector.unpacked(detector.packed(), rule)
        if hit := detector.push(token, DIGITS.get(token)):
            return at, *hit


def by_whole(tokens, rule=loops.Rule()):
    ids = np.array(tokens, np.int64)
    return loops.first_stop(ids, np.array([DIGITS.get(t, -1) for t in tokens], np.int64), rule) if tokens else None


def exactly(tokens):
    """The exact rule by its words: the first end of a window of max(256, 4 p) tokens with period p."""
    for end in range(len(tokens)):
        for p in range(1, 129):
            window = tokens[max(0, end + 1 - max(256, 4 * p)) : end + 1]
            if len(window) == max(256, 4 * p) and window[p:] == window[:-p]:
                return end, "exact", p


def cases():
    row = [731, 4083, 732, 531, 3763, 911, 949, 736, 733, 530, 3764, 912, 948, 737, 532, 864]
    looped = lambda prefix, cycle, n: [1000 + k for k in range(prefix)] + [cycle[k % len(cycle)] for k in range(n)]
    return {
        "short cycle": (looped(10, [1, 2, 3], 990), (265, "exact", 3)),
        "one token short": (looped(10, [1, 2, 3], 255), None),
        "four repeats": (looped(5, list(range(100, 200)), 995), (404, "exact", 100)),
        "too long a period": (looped(0, list(range(100, 229)), 4000), None),
        "a break starts anew": (looped(0, [7, 8], 200) + [9] + looped(0, [7, 8], 255), None),
        "numbers that stay": (looped(10, [ZERO + 1, ZERO + 2, 731, 4000, 709], 990), (265, "exact", 5)),
        "128 rows of period 17": (counted(30, range(44, 44 + 200), row), (30 + 56 * 18 + 72 * 19 - 1, "counting", 17)),
        "127 rows": (counted(30, range(44, 44 + 127), row), None),
        "counting down by 3": (counted(3, range(9000, 0, -3), [5, 6]), (3 + 128 * 6 - 1, "counting", 3)),
        "a number off its step": (counted(0, [*range(100, 200), 500, *range(501, 601)], [5, 6]), None),
        "two numbers a row": (counted(0, (n for k in range(300) for n in (k + 100, 7)), [5]), (128 * 6 - 1, "counting", 4)),
        "period 128": (counted(0, range(100, 400), [2000 + k for k in range(127)]), (128 * 130 - 1, "counting", 128)),
        "period 129": (counted(0, range(100, 400), [2000 + k for k in range(128)]), None),
        "varying items": (counted(0, range(1, 400), []) + [t for n in range(400) for t in [*spelled(n), 5000 + n * 1919 % 3000]], None),
        "numbers beyond 64 bits": (counted(0, range(10**30, 10**30 + 200), [5, 6]), (128 * 33 - 1, "counting", 3)),
        "nothing": ([], None),
    }


def test_cases_by_token_and_whole():
    for name, (tokens, want) in cases().items():
        assert by_tokens(tokens) == want, name
        assert by_tokens(tokens, cut=37) == want, name
        assert by_whole(tokens) == want, name
        if want is None or want[1] == "exact":
            assert exactly(tokens[:1500]) == want or len(tokens) > 1500, name


def test_random_sequences_agree():
    rng, small, hits = random.Random(3), loops.Rule(6, 12, 3, 4), set()
    for _ in range(1500):
        tokens = []
        while len(tokens) < 120:
            cycle = [rng.choice([1, 2, 3, *range(ZERO, ZERO + 10)]) for _ in range(rng.randrange(1, 5))]
            start, step = rng.randrange(60), rng.choice([0, 1, 1, 7, -3])
            for k in range(rng.randrange(1, 9)):
                tokens += cycle if rng.random() < 0.4 else [*cycle, *spelled(abs(start + k * step)), 4]
        got = by_tokens(tokens, small)
        assert got == by_whole(tokens, small) == by_tokens(tokens, small, cut=11)
        hits.add(got and got[1])
    assert hits == {"exact", "counting", None}


def test_batch_and_stream_agree(spark, tmp_path):
    named = {k: v for k, (v, _) in cases().items() if len(v) < 5000}
    want = {k: w for k, (v, w) in cases().items() if w and k in named}
    rows = spark.createDataFrame([*named.items(), ("null", None), ("null token", [None] * 300)], "k string, t array<int>")
    assert {r.k: (r.stop, r.rule, r.period) for r in loops.loop_stops(rows, "k", "t", DIGITS).collect()} == want
    tokens = rows.where("k <> 'null token'").select("k", F.posexplode("t").alias("i", "t")).withColumn("part", F.pmod(F.xxhash64("k", "i"), F.lit(3)))
    for part in range(3):  # any order, over three batches
        tokens.where(f"part = {part}").orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    stream = stateful.opened(spark, f"{tmp_path}/t", files=1)
    got = {r.k: (r.stop, r.rule, r.period) for r in stateful.finished(keyed.loop_stops(stream, "k", "i", "t", DIGITS), "l").collect()}
    assert got == want and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != keyed.ROCKS


def test_release_in_order_with_stop(spark, tmp_path):
    rows = [(lane, at, float(lane * 100 + at), at == 11 and lane in (2, 3)) for lane in range(4) for at in range(20) if (lane, at) not in ((1, 7), (3, 4))]
    rows += [(None, 0, 1.0, False), (0, None, 1.0, False), (0, -1, 1.0, False), (5, 0, None, None)]
    random.Random(8).shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "lane long, at long, v double, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = stateful.finished(keyed.released(stateful.opened(spark, f"{tmp_path}/in", files=1), "lane", "at", "v", "bad"), "t").collect()
    left = {(r.lane, r["at"]): (r.v, r.signal) for r in out if r.signal != "blocked"}
    want = {(0, k) for k in range(20)} | {(1, k) for k in range(7)} | {(2, k) for k in range(12)} | {(3, k) for k in range(4)} | {(5, 0)}
    assert set(left) == want and len(left) == sum(r.signal != "blocked" for r in out)
    assert left[2, 11] == (211.0, "failed") and all(v == (float(a * 100 + b) if a != 5 else None, "row") for (a, b), v in left.items() if (a, b) != (2, 11))
    assert [r["at"] for r in out if r.signal == "blocked" and r.lane == 3][0] <= 4


def test_pages_before_propose(spark, tmp_path):
    rng = random.Random(4)
    pages = {d: [[rng.randrange(4) for _ in range(rng.choice([0, 3, 6, 30]))] for _ in range(7)] for d in range(6)}
    want = {}
    for d, own in pages.items():
        index = {}
        for at, tokens in enumerate(own[:5]):  # the fifth is the last
            grams = [tuple(tokens[i : i + 4]) for i in range(len(tokens) - 3)]
            hit = next(((i, *index[g]) for i, g in enumerate(grams) if g in index), None)
            if hit:
                want[d, at] = hit
            index |= {g: (at, tokens[i + 4 : i + 12]) for i, g in enumerate(grams)}
    rows = [(d, at, tokens, at == 4) for d, own in pages.items() for at, tokens in enumerate(own)]
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], "d long, page long, t array<int>, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = stateful.finished(keyed.page_proposals(stateful.opened(spark, f"{tmp_path}/in", files=1), "d", "page", "t", "last"), "p")
    assert len(want) > 5 and {(r[0], r[1]): (r[2], r[3], r[4]) for r in out.collect()} == want


def test_failures_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "i long, d long")
    out = {r.i: (r.q, r.error) for r in keyed.isolated(rows, lambda r: 6 // r["d"], "i", "q").collect()}
    assert all(out[i] == ((str(6 // (i % 3)), None) if i % 3 else (None, out[i][1])) for i in range(9)) and "ZeroDivisionError" in out[0][1]


def test_a_loop_that_grid_points_may_miss():
    """Runs just long enough, at every offset, are found; a run one place short isn't."""
    from folioflow.operators.sequences import first_loop

    rng = np.random.default_rng(3)
    for p, need in ((1, 255), (5, 251), (64, 192), (100, 300), (128, 384)):
        for lead in (0, 1, 7, 100, 191, 250):
            for length in (need - 1, need):
                ids = rng.integers(1000, 1 << 40, lead + p + length + 30)
                for k in range(lead + p, lead + p + length):
                    ids[k] = ids[k - p]
                assert first_loop(ids, 128, 256) == ((lead + p + need - 1, p) if length == need else None)


def test_texts_are_sifted_together(spark):
    """Texts laid end to end stop where each alone does, also across pieces; few are looked at alone."""
    rng = random.Random(11)
    letters = "abcdefgh é漢😀"
    plain = ["".join(rng.choice(letters) for _ in range(400)) + " ".join(str(rng.randrange(10**6)) for _ in range(140)) for _ in range(300)]
    looped = {k: plain[k][: rng.randrange(300)] + "é漢 😀x"[: rng.randrange(1, 6)] * 300 for k in range(0, 300, 30)}
    counted_ = {k: plain[k][: rng.randrange(300)] + "".join(f"{n}. x😀\n" for n in range(95, 95 + rng.choice([127, 128, 200]))) for k in range(1, 300, 40)}
    texts = dict(enumerate(plain)) | looped | counted_ | {300: None, 301: "", 302: "7" * 255, 303: "7" * 256, 304: "7" * 300}
    digits = {48 + d: d for d in range(10)}
    alone = lambda t: loops.first_stop(np.array([ord(c) for c in t], np.int64), np.array([digits.get(ord(c), -1) for c in t], np.int64)) if t else None
    want = {k: hit for k, t in texts.items() if (hit := alone(t))}
    assert {r for _, r, _ in want.values()} == {"exact", "counting"} and len(want) > len(looped)
    df = spark.createDataFrame([*texts.items()], "k long, t string").coalesce(1)
    assert {r.k: (r.stop, r.rule, r.period) for r in loops.loop_stops(df, "k", "t", digits).collect()} == want
    arrays = df.select("k", F.transform(F.split("t", ""), lambda c: F.ascii(c)).alias("t"))
    assert {r.k: (r.stop, r.rule, r.period) for r in loops.loop_stops(arrays, "k", "t", digits).collect()} == want
    kept = [t for t in texts.values() if t]
    ids = np.concatenate([[ord(c) for c in t] for t in kept])
    digit = np.where((ids >= 48) & (ids < 58), ids - 48, -1)
    exact, counting = loops.may_stop(ids, digit, np.cumsum([len(t) for t in kept]))
    assert len(exact) <= 15 and sum(map(len, counting.values())) < 8 * len(kept)
    assert list(loops._pieces(np.array([3, 6, 20, 21, 22]), 6)) == [(0, 2), (2, 3), (3, 5)]


def test_many_items_of_a_key_in_one_batch():
    """A large batch is held as arrays and leaves in frames; its order, repeats and what waits from before are as for a small one."""
    import tracemalloc

    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.asked = {}, 0

        def exists(self):
            return bool(self.rows)

        def containsKey(self, key):
            self.asked += 1
            return key in self.rows

        def getValue(self, key):
            return self.rows[key]

        def removeKey(self, key):
            del self.rows[key]

        def updateValue(self, key, value):
            self.rows[key] = value

        def clear(self):
            self.rows.clear()

        def get(self):
            return self.rows[()]

        def update(self, value):
            self.rows[()] = value

    class Handle:
        def getMapState(self, *_):
            return Held()

        def getValueState(self, *_):
            return Held()

    n = 200_000
    at = np.random.default_rng(1).permutation(n)
    frames = lambda: (pd.DataFrame({"at": part, "value": part / 2.0, "failed": False}) for part in np.array_split(at, 40))
    release = keyed._Release()
    release.init(Handle())
    tracemalloc.start()
    seen = 0
    for out in release.handleInputRows((7,), frames(), None):
        assert len(out) <= keyed.FRAME and (out["at"] == np.arange(seen, seen + len(out))).all() and (out["value"] == out["at"] / 2).all()
        seen += len(out)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and most < 100 * n and release.waiting.asked == 0
    late = pd.DataFrame({"at": [n + 2, n + 1, n + 2, 5], "value": [1.0, None, 2.0, 3.0], "failed": [False] * 4})
    assert sum(map(len, release.handleInputRows((7,), [late], None))) == 0 and len(release.waiting.rows) == 2
    left = pd.concat(release.handleInputRows((7,), [pd.DataFrame({"at": [n, n + 3], "value": [None, None], "failed": [False, True]})], None))
    assert left["at"].tolist() == [n, n + 1, n + 2, n + 3] and left["signal"].tolist() == ["row"] * 3 + ["failed"]
    assert left["value"].isna().tolist() == [True, True, False, True] and left["value"].iloc[2] == 2.0 and not release.waiting.rows
