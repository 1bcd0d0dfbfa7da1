"""Blocks of points: their number, what meets, counts of points with angles of their own and nearest ones, against brute force."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from celestrum.functions import theory
from celestrum.functions.cosmo import Cosmology
from celestrum.operators import blocks, correlation, points, trees
from celestrum.plans import more, registry  # noqa: F401  more adds its queries
from tests.oracle import assert_same


def sphere(n, seed, near=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 3)) if near is None else np.array(near) + 0.05 * rng.standard_normal((n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v, **columns):
    rows = [(k, *map(float, p), *[float(c[k]) for c in columns.values()]) for k, p in enumerate(v)]
    return spark.createDataFrame(rows, "k long, ux double, uy double, uz double" + "".join(f", {c} double" for c in columns))


def many(spark, n, seed):
    """Points by hashes, evenly over the sphere."""
    u = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), "id") % 1_000_003 / 1_000_003.0 + 1.0) % 1.0
    z = 2.0 * u(1) - 1.0
    across, a = F.sqrt(1.0 - z * z), 2.0 * math.pi * u(2)
    return spark.range(n).select((F.cos(a) * across).alias("ux"), (F.sin(a) * across).alias("uy"), z.alias("uz"), F.lit(1.0).alias("weight"), F.lit(-1).alias("region"))


def test_a_larger_catalog_has_larger_blocks(spark):
    """Blocks that meet grow with the square of their number, so there are no more than tiles."""
    made = blocks.blocked(many(spark, 120_000, 1))
    assert made.agg(F.sum("n")).first()[0] == 120_000 and made.count() <= 2 * blocks.TILES


def test_pairs_within_are_all_pairs_within():
    rng = np.random.default_rng(1)
    a, b = np.concatenate([sphere(700, 1), sphere(300, 2, (0, 0, 1)), [[1.0, 0, 0]] * 150]), np.concatenate([sphere(900, 3), sphere(500, 4, (0, 0.1, 1))])
    times, weight = rng.integers(1, 4, len(b)), rng.normal(size=len(b))
    for many_, weights in ((None, None), (times, None), (None, weight), (times, weight)):
        one, by = trees.order(a), trees.order(b)
        tree = trees.Tree(b[by], None if many_ is None else many_[by], None if weights is None else weights[by])
        theta = rng.uniform(0, 3.3, len(a))
        c, at = trees.cosines(theta)
        n, w = trees.within(trees.Tree(a[one]), tree, c, at, True)
        near = a[one] @ b.T > c[:, None]
        times_ = np.ones(len(b)) if many_ is None else times
        assert (n == near @ times_).all()
        assert w == pytest.approx(near @ (times_ * (1.0 if weights is None else weights)), abs=1e-9)


def test_estimates_read_pair_counts_once(spark):
    """Counts are a table: samples and covariances don't count pairs again."""
    g, n = many(spark, 300, 2).withColumn("region", F.lit(0)), many(spark, 300, 3).withColumn("region", F.lit(1))
    counts = correlation.pair_counts(g, n, correlation.Bins((5.0, 40.0), (0,)), regions=True)
    samples = correlation.leave_one_out(counts, 2).withColumn("wtheta", F.col("DD"))
    plan = correlation.covariance(samples)._jdf.queryExecution().toString()
    assert "InArrow" not in plan


def test_projected_pairs_of_near_and_far_probes(spark):
    """Redshifts so small that a probe's bins are wider than the sky, none, zero and large ones."""
    z = [1e-6, 0.0, 0.004, *np.random.default_rng(4).uniform(0.03, 1.2, 197)]
    a, b = sphere(200, 5), sphere(300, 6)
    probes = table(spark, a, redshift=z).unionByName(table(spark, a[:1], redshift=[0.0]).withColumn("redshift", F.lit(None).cast("double")))
    edges = [5.0, 20.0, 50.0, 300.0]
    got = {r["bin"]: r["n_pairs"] for r in points.projected_pairs(probes, table(spark, b), Cosmology(), "redshift", edges).collect()}
    distance = np.array([r[0] for r in probes.where("redshift IS NOT NULL").orderBy("k").select(Cosmology().angular_diameter_distance("redshift")).collect()])
    r = np.arccos(np.clip(a @ b.T, -1, 1)) * distance[:, None]
    want = {k: int(((r >= edges[k]) & (r < edges[k + 1])).sum()) for k in range(3)}
    assert got == {k: n for k, n in want.items() if n}


def test_counts_within_own_radii(spark):
    radius = np.random.default_rng(7).uniform(-1, 30, 200)
    a, b = np.concatenate([sphere(120, 8), sphere(80, 9, (0, 0, 1))]), np.concatenate([sphere(400, 10), sphere(200, 11, (0, 0, 1))])
    found = points.count_within(table(spark, a, radius=radius), table(spark, b), ["k"], F.col("radius"), 20.0)
    near = a @ b.T > np.cos(np.radians(np.minimum(radius, 20.0)))[:, None]
    near[radius <= 0] = False
    assert [r["n_pairs"] for r in found.orderBy("k").collect()] == near.sum(axis=1).tolist()
    assert "_cx" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 10**9])
def test_weighed_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(points, "FEW", few)
    a, b, w = sphere(50, 12), sphere(400, 13), np.random.default_rng(14).normal(size=400)
    own = np.arange(50) - 20.0
    found = points.weigh_pairs(table(spark, a, own=own), table(spark, b, weight=w), ["k"], 40.0, 10.0, "own").orderBy("k").collect()
    dot = a @ b.T
    near = (dot > math.cos(math.radians(40))) & (dot <= math.cos(math.radians(10)))
    assert [r["n_pairs"] for r in found] == near.sum(axis=1).tolist()
    assert [r["weight"] or 0.0 for r in found] == pytest.approx((near @ w).tolist(), abs=1e-9)
    assert [r["product"] or 0.0 for r in found] == pytest.approx((own * (near @ w)).tolist(), abs=1e-9)


@pytest.mark.parametrize(("wanted", "most"), [(1 << 14, 1 << 18), (20, 30)])
def test_nearest_with_ties(spark, monkeypatch, wanted, most):
    """Targets at equal places: the smaller ids are nearest. Blocks of a few points, too."""
    monkeypatch.setattr(blocks.blocked, "__defaults__", (wanted, most))
    a = np.concatenate([sphere(150, 15), sphere(60, 16, (0, 0, 1))])
    b = np.concatenate([sphere(100, 17), sphere(60, 18, (0, 0, 1)), a[:20], a[:20], a[:5]])
    probes, targets = table(spark, a), table(spark, b).withColumnRenamed("k", "t")
    angle = np.round(np.degrees(np.arctan2(np.linalg.norm(np.cross(a[:, None], b[None]), axis=2), a @ b.T)), 9)
    rank = np.lexsort((np.broadcast_to(np.arange(len(b)), angle.shape), angle), axis=1)
    got = {(r["k"], r["rank"]): r["t"] for r in points.k_nearest(probes, targets, ["k"], "t", 3).collect()}
    assert got == {(i, n + 1): int(rank[i, n]) for i in range(len(a)) for n in range(3)}
    best = {r["k"]: r["t"] for r in points.closest_match(probes, targets, ["k"], "t", 4.0).collect()}
    assert best == {i: int(rank[i, 0]) if angle[i, rank[i, 0]] <= 4.0 else None for i in range(len(a))}


def test_nearest_makes_no_row_of_a_pair_that_is_not_near(spark):
    a, b = table(spark, sphere(400, 19)), table(spark, sphere(3000, 20)).withColumnRenamed("k", "t")
    made = points._nearest(a, points._to_find(b, "t"), ["k"], "t", 1, 60.0)
    assert made.count() <= 400 * blocks.of_points(b, ["t"]).count()


def test_corners_at_poles_of_other_spheres(spark, tmp_path):
    """The query's cells of these keys have a corner at the pole, whose longitude only rounding decides: as in SQL."""
    pq.write_table(pa.table({"o_orderkey": [363864, 467818, 5], "o_totalprice": [1.0, 2.0, 3.0]}), tmp_path / "orders.parquet")
    name = "b28_bounds_of_other_spheres"
    assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], str(tmp_path))


def test_integrals_of_rows_are_not_interpreted(spark):
    """No lambda over an array of a row's steps; growth and distance are those of the rule in Columns."""
    z = spark.createDataFrame([(k / 4.0,) for k in range(5)] + [(None,)], "z double")
    u = theory.Expansion()
    found = z.select(u.comoving_distance("z").alias("d"), u.growth("z").alias("g"), (2997.92458 * theory.integral(lambda t: 1.0 / u.e(t), "z")).alias("want"))
    assert "aggregate(" not in found.select("d", "g")._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert [r["d"] for r in rows[:5]] == pytest.approx([r["want"] for r in rows[:5]], rel=1e-13) and rows[0]["g"] == pytest.approx(1.0, rel=1e-13)
    assert rows[5]["d"] is None and rows[5]["g"] is None
