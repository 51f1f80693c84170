"""Neighbours over tiles, and resampling losses, against whole arrays."""

import numpy as np

from folioflow.operators import pixels as P


def pages(spark, arrays):
    rows = [(k, y, x, int(v)) for k, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "page long, y int, x int, v int")


def whole_sums(a):
    a = a.astype(int)
    dx, dy = np.abs(np.diff(a, axis=1)), np.abs(np.diff(a, axis=0))
    inked = a < 160
    mid = a[1:-1, 1:-1]
    curve = np.abs(4 * mid - a[:-2, 1:-1] - a[2:, 1:-1] - a[1:-1, :-2] - a[1:-1, 2:]) if min(a.shape) > 2 else np.zeros((0, 0), int)
    inside = mid < 160
    return (a.size, inked.sum(), (dx > 40).sum() + (dy > 40).sum(), dx.sum(), dy.sum(), (inked[:, 1:] != inked[:, :-1]).sum(), curve[inside].sum() if curve.size else 0, inside.sum() if curve.size else 0)


def test_neighbours_by_tiles(spark):
    rng = np.random.default_rng(3)
    arrays = {k: rng.integers(0, 256, shape) for k, shape in enumerate([(1, 1), (1, 9), (9, 1), (7, 11), (16, 16), (33, 5), (2, 2)])} | {20: np.full((6, 6), 255), 21: np.zeros((5, 8), int)}
    df = pages(spark, arrays)
    want = {k: tuple(map(int, whole_sums(a))) for k, a in arrays.items()}
    for tile in (1, 4, 5, 256):
        got = {r.page: tuple(r)[1:] for r in P.neighbour_sums(df.repartition(3), tile).collect()}
        assert got == want
    found = {r.page: (r.ink_per_edge, r.laplacian) for r in P.native_features(df, 4).collect()}
    assert all(abs(found[k][0] - w[1] / max(w[2], 1)) < 1e-12 and abs(found[k][1] - (w[6] / w[7] if w[7] else 0)) < 1e-12 for k, w in want.items())
    assert P.neighbour_sums(df.limit(0)).count() == 0


def plain_resize(a, size, kernel, reach):
    """One axis (the last), fixed-point weights of 22 bits."""
    n = a.shape[-1]
    if n == size:
        return a
    scale = n / size
    wide = max(scale, 1.0)
    out = np.zeros((*a.shape[:-1], size), np.int64)
    for to in range(size):
        centre = (to + 0.5) * scale
        first, last = max(int(centre - reach * wide + 0.5), 0), min(int(centre + reach * wide + 0.5), n)
        raw = np.array([kernel((k - centre + 0.5) / wide) for k in range(first, last)])
        w = raw / raw.sum()
        fixed = np.array([int(np.sign(x) * np.floor(abs(x) * (1 << 22) + 0.5)) for x in w])
        out[..., to] = np.clip((a[..., first:last] @ fixed + (1 << 21)) >> 22, 0, 255)
    return out


def cubic(x):
    x = abs(x)
    return (1.5 * x - 2.5) * x * x + 1 if x < 1 else (((x - 5) * x + 8) * x - 4) * -0.5 if x < 2 else 0.0


def test_losses_by_whole_arrays(spark):
    rng = np.random.default_rng(5)
    arrays = {k: np.clip(rng.normal(150, 90, (8, 12)), 0, 255).astype(int) for k in range(4)} | {9: np.full((8, 12), 255)}
    got = {r.page: (r.change, r.lossy) for r in P.resample_loss(pages(spark, arrays), 12, 8, 6).collect()}
    for k, a in arrays.items():
        down = plain_resize(plain_resize(a, 6, cubic, 2.0).T, 4, cubic, 2.0).T
        back = plain_resize(plain_resize(down, 12, lambda x: max(1 - abs(x), 0.0), 1.0).T, 8, lambda x: max(1 - abs(x), 0.0), 1.0).T
        ink = a < 160
        want = (np.abs(a - back)[ink].mean(), (np.abs(a - back)[ink] > 60).mean()) if ink.any() else (0.0, 0.0)
        assert abs(got[k][0] - want[0]) < 1e-9 and abs(got[k][1] - want[1]) < 1e-9
    assert {tuple(r)[1:] for r in P.resample_loss(pages(spark, arrays), 12, 8, 12).collect()} == {(0.0, 0.0)}


def inside(poly, x, y):
    """Even-odd rule for one point."""
    points = list(zip(poly[::2], poly[1::2], strict=False))
    hit = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if (ay <= y < by or by <= y < ay) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
            hit = not hit
    return hit


def test_masked_pixels_by_each_centre(spark):
    from folioflow.operators import polygons as G

    rng = np.random.default_rng(7)
    some = lambda k: (rng.uniform(-5, 30, 2 * k)).tolist()
    sizes = {1: (24, 17), 2: (9, 30), 3: (12, 12), 4: (8, 8), 5: (0, 5)}
    regions = [(1, some(3)), (1, some(5)), (2, some(4)), (2, some(7)), (3, [0.0, 0.0, 6.0, 0.0, 6.0, 6.0, 0.0, 6.0]), (3, [3.0, 3.0]), (4, None), (9, some(3))]
    kept = [(1, some(4)), (2, some(3)), (3, [0.0, 0.0, 6.0, 0.0, 6.0, 3.0, 0.0, 3.0])]
    schema = "page long, poly array<double>"
    pages_df = spark.createDataFrame([(p, w, h) for p, (w, h) in sizes.items()], "page long, width int, height int")
    got = {r.page: (r.pixels, r.share) for r in G.masked(pages_df, spark.createDataFrame(regions, schema), spark.createDataFrame(kept, schema)).collect()}
    for p, (w, h) in sizes.items():
        hits = sum(any(inside(q, x + 0.5, y + 0.5) for k, q in regions if k == p and q and len(q) >= 6) and not any(inside(q, x + 0.5, y + 0.5) for k, q in kept if k == p) for y in range(h) for x in range(w))
        assert got[p] == (hits, hits / (w * h) if w * h else 0.0)
    assert got[3][0] == 18 and set(got) == set(sizes)


def test_polygons_over_strips_and_far_beyond_pages(spark):
    """Tall pages are cut into strips; lines beyond a page are never made, however far a polygon reaches."""
    from folioflow.operators import polygons as G

    rng = np.random.default_rng(9)
    sizes = {"a": (9, 3 * G.STRIP + 5), "b": (7, G.STRIP), "c": (12, 2 * G.STRIP), "d": (5, 5), "e": (0, 9), "f": (4, 130)}
    some = lambda h, k: [float(rng.uniform(-3, 14) if i % 2 == 0 else rng.uniform(-9, h + 9)) for i in range(2 * k)]
    far = [-1e12, -1e12, 1e12, -1e12, 1e12, 1e12, -1e12, 1e12]
    regions = [(p, some(h, k)) for p, (_, h) in sizes.items() if p in "abc" for k in (3, 5, 8)] + [("d", far), ("e", far), ("f", [0.0, 0.0, 4.0, 0.0, 4.0, 130.0, 0.0, 130.0, 9.0])]
    kept = [(p, some(h, 4)) for p, (_, h) in sizes.items() if p in "abc"] + [("d", [1.0, 1.0, 3.0, 1.0, 3.0, 1e12, 1.0, 1e12]), ("f", [0.0, 0.0, None, 1.0, None, 2.0]), ("f", [0.0, 300.0, 4.0, 300.0, 4.0, 400.0])]
    pages_df = spark.createDataFrame([(p, w, h) for p, (w, h) in sizes.items()], "page string, width int, height int")
    schema = "page string, poly array<double>"
    masked = G.masked(pages_df, spark.createDataFrame(regions, schema), spark.createDataFrame(kept, schema))
    got = {r.page: r.pixels for r in masked.collect()}
    for p, (w, h) in sizes.items():
        if p in "abc":
            hits = lambda polys: [q for k, q in polys if k == p]  # noqa: B023, E731
            assert got[p] == sum(any(inside(q, x + 0.5, y + 0.5) for q in hits(regions)) and not any(inside(q, x + 0.5, y + 0.5) for q in hits(kept)) for y in range(h) for x in range(w)) > 0
    assert (got["d"], got["e"], got["f"]) == (25 - 2 * 4, 0, 4 * 130) and set(got) == set(sizes)
