"""Attention over blocks against whole sequences; states merge in any order."""

import numpy as np

from folioflow.operators import vectors as V


def whole(rows, sink):
    out = {}
    for by, at, x in rows:
        seen = [np.array(y) for b, k, y in rows if b == by and k <= at]
        z = np.array([float(np.dot(x, y)) / np.sqrt(len(x)) for y in seen])
        top = max(z.max(), sink)
        e = np.exp(z - top)
        out.setdefault((by, at), []).append((e[:, None] * np.array(seen)).sum(0) / (e.sum() + np.exp(sink - top)))
    return out


def test_blocks_give_whole_sequences(spark):
    rng = np.random.default_rng(1)
    rows = [(s, at, (rng.normal(size=4) * (30 if s == 3 else 1)).tolist()) for s, n in ((1, 40), (2, 1), (3, 25), (4, 9), (None, 7)) for at in range(n)]
    rows += [(5, at // 3, rng.normal(size=4).tolist()) for at in range(20)]  # ties see each other
    df = spark.createDataFrame(rows, "s long, i long, v array<double>").repartition(5)
    want = whole(rows, 0.5)
    for block in (1, 4, 7, 512):
        got = {}
        for r in V.attention(df, "s", "i", "v", 0.5, block).collect():
            got.setdefault((r.s, r.i), []).append(np.array(r.output))
        assert got.keys() == want.keys()
        for k, outputs in want.items():
            order = lambda many: sorted(many, key=lambda o: o.tolist())
            assert np.allclose(order(got[k]), order(outputs), atol=1e-12)
    assert V.attention(df.limit(0), "s", "i", "v").count() == 0


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    logits, values = rng.normal(size=(5, 30)) * 300, rng.normal(size=(30, 3))
    logits[2, :10] = -np.inf
    logits[4] = -np.inf
    parts = [V.SoftmaxState.of(logits[:, k : k + 10], values[k : k + 10]) for k in (0, 10, 20)]
    one, two = parts[0].merged(parts[1]).merged(parts[2]), parts[2].merged(parts[0].merged(parts[1]))
    whole_state = V.SoftmaxState.of(logits, values)
    for state in (one, two, V.SoftmaxState.unpacked(*one.packed())):
        assert np.allclose(state.whole, whole_state.whole) and np.allclose(state.output, whole_state.output) and (state.top == whole_state.top).all()
