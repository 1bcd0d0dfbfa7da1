"""Block pair counts, set algebra on random maps, small bounds, cell distances and Hilbert unions against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from celestrum.functions import bounds, cells, hcells
from celestrum.operators import area_map, blocks, correlation, points, random_points


def sphere(n, seed, near=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 3)) if near is None else np.array(near) + 0.05 * rng.standard_normal((n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(*map(float, p), float(rng.integers(-3, 9)), int(rng.integers(0, 4))) for p in v]
    rows += [rows[0]] * copies
    return spark.createDataFrame(rows, "ux double, uy double, uz double, weight double, region int"), np.array(rows)


@pytest.mark.parametrize(("wanted", "most"), [(256, 4096), (8, 5)])
def test_block_pairs_are_all_pairs(spark, monkeypatch, wanted, most):
    monkeypatch.setattr(blocks.blocked, "__defaults__", (wanted, most))
    a, va = table(spark, np.concatenate([sphere(150, 1), sphere(120, 2, (0, 0.1, 1))]), 3, copies=40)
    b, vb = table(spark, np.concatenate([sphere(100, 4), sphere(150, 5, (0.05, 0, 1)), [[1.0, 0.0, 0.0]]]), 6)
    edges = [0.0, 1.0, 4.0, 30.0, 100.0]
    got = {(r["bin"], r["region_a"], r["region_b"]): (r["n_pairs"], r["weight"]) for r in blocks.binned_pairs(a.withColumn("extra", F.lit(1)), b, edges, regions=True).collect()}
    angle = np.degrees(np.arccos(np.clip(va[:, :3] @ vb[:, :3].T, -1, 1)))
    number = np.digitize(angle, edges) - 1
    want = {}
    for i, j in np.argwhere(number < 4):
        key = (int(number[i, j]), int(va[i, 4]), int(vb[j, 4]))
        n, w = want.get(key, (0, 0.0))
        want[key] = (n + 1, w + va[i, 3] * vb[j, 3])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert blocks.binned_pairs(a.limit(0), b, edges).count() == 0
    nulls = a.limit(1).select(F.lit(None).cast("double").alias("ux"), "uy", "uz", "weight")
    assert blocks.binned_pairs(nulls, b, edges).count() == 0


def random_map(rng, levels, share):
    """Cells of several levels in one corner of the sky, none in another."""
    out, stack = {}, [(2, x, y) for x in range(3) for y in range(3)]
    while stack:
        level, x, y = stack.pop()
        if rng.random() < share:
            out[level, x, y] = rng.choice([1.0, 2.0])
        elif level < levels and rng.random() < 0.7:
            stack += [(level + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
    return out


def fine(cells_, level):
    out = {}
    for (at, x, y), w in cells_.items():
        side = 1 << (level - at)
        out.update({(x * side + i, y * side + j): w for i in range(side) for j in range(side)})
    return out


def test_set_algebra_of_random_maps(spark):
    rng = random.Random(4)
    frame = lambda m: spark.createDataFrame([(*k, w) for k, w in m.items()], "level int, x long, y long, weight double")
    for _ in range(3):
        a, b = random_map(rng, 5, 0.3), random_map(rng, 6, 0.25)
        fa, fb = fine(a, 6), fine(b, 6)
        got = {(r["level"], r["x"], r["y"]): r["weight"] for r in area_map.exclude(frame(a), frame(b)).collect()}
        assert fine(got, 6) == {k: w for k, w in fa.items() if k not in fb}
        assert sum(4 ** (6 - k[0]) for k in got) == len(fine(got, 6))  # no cell lies in another
        union = {(r["level"], r["x"], r["y"]): r["weight"] for r in area_map.ingest(frame(a), frame(b)).collect()}
        assert set(fine(union, 6)) == set(fa) | set(fb) and sum(4 ** (6 - k[0]) for k in union) == len(fine(union, 6))
        whole = frame({(6, x, y): 1.0 for x, y in fa})
        merged = {(r["level"], r["x"], r["y"]) for r in area_map.merge_siblings(whole).collect()}
        assert set(fine(dict.fromkeys(merged, 1.0), 6)) == set(fa)
        for level, x, y in merged:  # no four siblings are left
            assert not all((level, x // 2 * 2 + i, y // 2 * 2 + j) in merged for i in (0, 1) for j in (0, 1)) or level == 2


def test_small_bounds_are_not_lost(spark):
    for shape in (bounds.Circle(200, 10, 0.01), bounds.ConvexPolygon(((50, 10), (50.02, 10), (50.01, 10.02)))):
        area = area_map.pixelize(spark, shape, 12).agg(F.sum(cells.level_area(F.col("level")))).first()[0]
        assert area == pytest.approx(shape.area, rel=0.25)


def test_may_touch_is_never_wrong(spark):
    v, _ = table(spark, sphere(400, 8), 9)
    for shape in (bounds.Circle(200, 10, 5), bounds.Annulus(120, -40, 10, 20), bounds.Wedge(80, 20, 30, 10, 120), bounds.ConvexPolygon(((50, 10), (80, 10), (65, 40))), bounds.LatitudeBand(-20, 10), bounds.LongitudeBand(350, 20), bounds.LatLonBox(-30, 0, 340, 30), bounds.Circle(200, 10, 5) & bounds.LatitudeBand(0, 90), bounds.Circle(10, 10, 5) | bounds.LongitudeBand(40, 60)):
        inside = v.where(shape.contains()).select(*[F.col(c).alias(f"p{c}") for c in ("ux", "uy", "uz")])
        near = v.crossJoin(inside.limit(20)).where(F.degrees(F.acos(F.col("ux") * F.col("pux") + F.col("uy") * F.col("puy") + F.col("uz") * F.col("puz"))) <= 7.0)
        assert near.where(~shape.may_touch(F.lit(7.0))).isEmpty(), shape


def test_distances_to_cells(spark):
    v, raw = table(spark, sphere(25, 11), 12)
    cell = v.withColumns({"x": F.lit(30).cast("long"), "y": F.lit(17).cast("long")})
    near, far = cells.distances(4)
    got = [(r["near"], r["far"]) for r in cell.select(near.alias("near"), far.alias("far")).collect()]
    t = np.linspace(0, 1, 60)
    lam = np.arcsin(1 - (17 + t) * 2 / 52)[:, None]
    eta = np.radians((30 + t) * 2.5 + 91.25 + 32.5)[None, :]
    grid = np.stack(np.broadcast_arrays(-np.sin(lam), np.cos(lam) * np.cos(eta), np.cos(lam) * np.sin(eta)), axis=-1).reshape(-1, 3)
    angle = np.degrees(np.arccos(np.clip(raw[:, :3] @ grid.T, -1, 1)))
    for (a, b), some in zip(got, angle, strict=True):
        assert a <= some.min() + 1e-6 and b >= some.max() - 1e-6 and a == pytest.approx(some.min(), abs=0.06) and b == pytest.approx(some.max(), abs=0.06)


def test_no_points_of_an_empty_bound(spark, monkeypatch):
    monkeypatch.setattr(random_points, "HOPELESS", 10_000)

    class Empty(bounds.Bound):
        def contains(self, vector=("ux", "uy", "uz")):
            return F.lit(False)

    with pytest.raises(ValueError, match="none of"):
        random_points.in_bound(spark, Empty(), 10)
    p = random_points.in_bound(spark, bounds.Circle(200, 10, 1), 500)
    assert p.count() == 500 and p.where(bounds.Circle(200, 10, 1).contains()).count() == 500
    lon, lat = random_points.as_arrays(p)
    assert lon.shape == lat.shape == (500,) and abs(lat.mean() - 10) < 0.2


def test_k_nearest_of_few_targets(spark):
    a, va = table(spark, sphere(20, 21), 1)
    b, vb = table(spark, sphere(2, 22), 1)
    named = lambda df, n: df.select(F.monotonically_increasing_id().alias(n), "ux", "uy", "uz")
    got = points.k_nearest(named(a, "k"), named(b, "t"), ["k"], "t", 5).collect()
    assert len(got) == 40 and {r["rank"] for r in got} == {1, 2}
    assert points.k_nearest(named(a, "k"), named(b, "t").limit(0), ["k"], "t", 5).count() == 0


def test_coverings_hold_their_circle():
    rng = np.random.default_rng(3)
    axis = np.array([0.3, -0.5, 0.8])
    for radius, most in ((5.0, 8), (5.0, 60), (0.2, 30), (80.0, 40)):
        ids = hcells.coverer(tuple(axis), radius, most)
        assert len(ids) <= max(most, 6)
        v = sphere(3000, 5, axis / np.linalg.norm(axis)) if radius < 30 else sphere(3000, 5)
        v = v[v @ axis / np.linalg.norm(axis) >= math.cos(math.radians(radius))]
        leaf = hcells.encode(*v.T)
        low = ids & -ids
        held = ((leaf[:, None] >= ids - (low - 1)) & (leaf[:, None] <= ids + (low - 1))).any(axis=1)
        assert held.all()
        inner = hcells.coverer(tuple(axis), radius, most, interior=True)
        if len(inner):
            c = hcells.corners(inner).reshape(-1, 3)
            assert (c @ axis / np.linalg.norm(axis) >= math.cos(math.radians(radius)) - 1e-12).all()
    assert rng is not None


def test_hybrid_bins_are_those_of_both_estimators():
    bins = correlation.Bins.logarithmic(0.1, 10.0, 4).with_resolutions(4, 64)
    assert correlation._runs([k for k, r in enumerate(bins.resolutions) if not r]) and correlation._runs([0, 1, 4, 5, 7]) == [(0, 1), (4, 5), (7, 7)]
