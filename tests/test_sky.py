"""Edges of the grid, empty inputs, bin edges, shapes, text formats and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from celestrum.functions import bounds, cells, coords, text
from celestrum.operators import area_map, correlation, field_map, points, random_points, regions
from celestrum.sources import text_io
from celestrum.streaming import accumulate

POINTS = "k long, lam double, eta double, weight double"


def survey(spark, rows):
    df = spark.createDataFrame([(k, float(a), float(b), 1.0) for k, (a, b) in enumerate(rows)], POINTS)
    ux, uy, uz = coords.survey_to_xyz("lam", "eta")
    return df.withColumns({"ux": ux, "uy": uy, "uz": uz})


def test_cells_wrap_and_reach_the_poles(spark):
    df = cells.with_cell(survey(spark, [(0, 91.2501), (0, 91.2499), (89.9999, 0), (-89.9999, 0), (90, 0), (-90, 0)]), 4)
    rows = df.orderBy("k").collect()
    assert (rows[0]["x"], rows[1]["x"]) == (0, 143)
    assert [r["y"] for r in rows[2:]] == [0, 51, 0, 51]


def test_cell_of_a_centre_is_the_cell(spark):
    some = spark.range(0, 36 * 13 * 16 * 16, 97).select((F.col("id") % 576).alias("x0"), F.floor(F.col("id") / 576).cast("long").alias("y0"))
    ux, uy, uz = cells.center_xyz(16, "x0", "y0")
    assert cells.with_cell(some.withColumns({"ux": ux, "uy": uy, "uz": uz}), 16).where("x <> x0 OR y <> y0").count() == 0


def test_index_numbers_go_both_ways(spark):
    some = spark.range(5000).select((F.col("id") * 7 % 2304).alias("x"), (F.col("id") * 5 % 832).alias("y"))
    x, y = cells.xy_of_hpix(64, cells.hpixnum(64), cells.superpixnum(64))
    a, b = cells.xy_of_pixnum(64, cells.pixnum(64))
    assert some.where((x != F.col("x")) | (y != F.col("y")) | (a != F.col("x")) | (b != F.col("y"))).count() == 0


@pytest.mark.parametrize("theta", [0.3, 4.0, 33.0, 180.0])
def test_range_join_finds_all_pairs(spark, theta):
    rng = np.random.default_rng(5)
    rows = [(math.degrees(math.asin(z)), e) for z, e in zip(rng.uniform(-1, 1, 60), rng.uniform(-180, 180, 60), strict=True)] + [(89.9, 10), (-89.9, 190), (0, 91.25), (0, 91.24), (90, 0), (90, 77)]
    a = survey(spark, rows)
    found = points.pairs(a.select("k", "ux", "uy", "uz"), a.select(F.col("k").alias("j"), "ux", "uy", "uz"), theta)
    v = np.array(a.orderBy("k").select("ux", "uy", "uz").toPandas())
    want = int((np.clip(v @ v.T, -1, 1) > math.cos(math.radians(theta)) + 1e-15).sum())
    assert found.count() == want


def test_bins_are_half_open(spark):
    a = survey(spark, [(0, 0)]).select("k", "ux", "uy", "uz")
    b = survey(spark, [(1, 0), (2, 0)]).select(F.col("k").alias("j"), "ux", "uy", "uz")
    counts = {r["bin"]: r["n_pairs"] for r in points.binned_pairs(a, b, [0.5, 1.0 + 1e-9, 2.0 + 1e-9, 3.0]).collect()}
    assert counts == {0: 1, 1: 1}


def test_empty_catalogs(spark):
    none, one = survey(spark, []), survey(spark, [(3, 4)])
    left, right = none.select("k", "ux", "uy", "uz"), one.select(F.col("k").alias("j"), "ux", "uy", "uz")
    assert points.pairs(left, right, 5.0).count() == 0
    assert points.count_pairs(one.select("k", "ux", "uy", "uz"), none.select(F.col("k").alias("j"), "ux", "uy", "uz"), ["k"], 5.0).collect()[0]["n_pairs"] == 0
    assert points.k_nearest(one.select("k", "ux", "uy", "uz"), none.select(F.col("k").alias("j"), "ux", "uy", "uz"), ["k"], "j", 3).count() == 0


def test_k_nearest_goes_round_the_sky(spark):
    a, b = survey(spark, [(-60, -100)]), survey(spark, [(60, 80), (61, 81), (0, 0)])
    rows = points.k_nearest(a.select("k", "ux", "uy", "uz"), b.select(F.col("k").alias("j"), "ux", "uy", "uz"), ["k"], "j", 3, start=1.0).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["j"] == 2


def map_of(spark, rows):
    return spark.createDataFrame([(a, b, c, float(w)) for a, b, c, w in rows], "level int, x long, y long, weight double")


def cells_of(df, level=4):
    return {(r["x"], r["y"]): r["weight"] for r in area_map.expand(df, level).collect()}


def test_resolve_merges_siblings_and_drops_what_is_covered(spark):
    quad = [(3, 2 * 5 + a, 2 * 7 + b, 1) for a in (0, 1) for b in (0, 1)]
    out = area_map.resolve(map_of(spark, [*quad, (4, 20, 28, 9), (3, 100, 50, 2), (3, 100, 50, 4)])).collect()
    assert {(r["level"], r["x"], r["y"], r["weight"]) for r in out} == {(2, 5, 7, 1.0), (3, 100, 50, 3.0)}


def test_set_algebra_adds_up(spark):
    a = map_of(spark, [(2, 1, 1, 2), (3, 8, 8, 3), (4, 40, 40, 5)])
    b = map_of(spark, [(3, 2, 2, 7), (2, 4, 4, 1), (4, 41, 41, 1)])
    fine_a, fine_b = cells_of(a), cells_of(b)
    both = fine_a.keys() & fine_b.keys()
    assert cells_of(area_map.intersect(a, b)) == {k: fine_a[k] for k in both}
    assert cells_of(area_map.imprint(a, b)) == {k: fine_b[k] for k in both}
    assert cells_of(area_map.exclude(a, b)) == {k: w for k, w in fine_a.items() if k not in both}
    assert cells_of(area_map.add(a, b, False)) == {k: fine_a.get(k, 0) + fine_b.get(k, 0) for k in fine_a.keys() | fine_b.keys()}
    empty = a.limit(0)
    assert cells_of(area_map.exclude(a, empty)) == fine_a and area_map.intersect(a, empty).count() == 0
    assert area_map.resolve(empty).count() == 0


def test_shapes_have_the_area_of_their_points(spark):
    n = 40000
    sky = random_points.over_map(area_map.coverage(map_of(spark, [(2, x, y, 1) for x in range(144) for y in range(52)]), 2), n, seed=3).cache()
    assert abs(sky.agg(F.avg("uz")).first()[0]) < 0.02 and abs(sky.agg(F.avg("ux")).first()[0]) < 0.02
    shapes = [bounds.Circle(200, 10, 40), bounds.Annulus(10, -60, 20, 60, "galactic"), bounds.LatLonBox(-20, 50, 300, 40), bounds.Wedge(100, 20, 50, 30, 120), bounds.ConvexPolygon(((180, -20), (220, -20), (220, 20), (180, 20))), bounds.Circle(10, 20, 30, "survey") & bounds.LatitudeBand(-90, 90)]
    got = sky.agg(*[F.sum(F.when(s.contains(), 1).otherwise(0)).alias(f"s{k}") for k, s in enumerate(shapes)]).first()
    for k, s in enumerate(shapes):
        share = s.area / cells.SKY_DEG2
        assert abs(got[k] / n - share) < 4 * math.sqrt(share / n) + 1e-3, s
    wedge = random_points.in_bound(spark, bounds.Circle(200, 10, 5), 500, seed=2)
    assert wedge.count() == 500 and wedge.where(~bounds.Circle(200, 10, 5).contains()).count() == 0


def test_pixelized_circle_has_about_its_area(spark):
    p = area_map.pixelize(spark, bounds.Circle(60, 0, 3, "survey"), 7)
    assert abs(area_map.summary(p).first()["area"] / bounds.Circle(60, 0, 3).area - 1) < 0.03


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        coords.sphere("mars")
    with pytest.raises(ValueError):
        cells.level_of(6)
    with pytest.raises(ValueError):
        field_map._kind("other")


def test_bin_schemes():
    b = correlation.Bins.logarithmic(0.01, 10, 6)
    assert len(b) == 18 and abs(b.edges[0] - 0.01) < 1e-12 and abs(b.edges[-1] - 10) < 1e-9
    assert correlation.Bins.linear(0, 10, 5).find(4.0) == 2 and b.find(20) is None
    r = b.with_resolutions()
    assert r.resolutions[0] == 0 and r.resolutions[-1] > 0 and all(x == 0 for x in r.using_pairs(2).resolutions)


def test_regions_have_near_equal_area(spark):
    covered = spark.createDataFrame([(x, y, 1.0) for x in range(40) for y in range(10, 30)], "x long, y long, weight double")
    areas = [r["area"] for r in regions.region_areas(regions.regionate(covered, 16, 7)).collect()]
    assert len(areas) == 7 and max(areas) < 1.3 * min(areas)


def test_copied_columns_come_from_the_catalog(spark):
    pts = spark.range(300).withColumn("ux", F.lit(1.0))
    catalog = spark.createDataFrame([(k, k / 2) for k in range(50)], "id2 long, z double")
    out = random_points.with_copied(pts, catalog, ["id2", "z"], seed=4)
    assert out.count() == 300 and out.where("z <> id2 / 2").count() == 0 and out.select("id2").distinct().count() > 40


def test_text_formats_go_both_ways(spark, tmp_path):
    a = map_of(spark, [(2, 1, 1, 2), (3, 8, 8, 3), (4, 40, 40, 5)])
    for hpixel in (True, False):
        path = f"{tmp_path}/map{hpixel}"
        text_io.write_map(a, path, hpixel)
        assert {tuple(r) for r in text_io.read_map(spark, path, hpixel).collect()} == {tuple(r) for r in a.collect()}
    f = spark.createDataFrame([(3, 4, 0.5, 2.5, 7), (9, 9, 1.0, -1.0, 0)], "x long, y long, unmasked double, intensity double, n_points long")
    text_io.write_field(f, f"{tmp_path}/field", 8)
    back, resolution = text_io.read_field(spark, f"{tmp_path}/field")
    assert resolution == 8 and {tuple(r) for r in back.collect()} == {tuple(r) for r in f.collect()}
    for system in ("equatorial", "galactic", "survey", "ecliptic"):
        text_io.write_catalog(survey(spark, [(10, 20), (-30, 140)]), f"{tmp_path}/{system}", system, ("weight", "k"))
        back = text_io.read_catalog(spark, f"{tmp_path}/{system}", system, weight=2, index=3)
        assert np.allclose(back.orderBy("id").select("ux", "uy", "uz").toPandas(), survey(spark, [(10, 20), (-30, 140)]).orderBy("k").select("ux", "uy", "uz").toPandas())


def test_odd_text_rows_are_left_out(spark, tmp_path):
    (tmp_path / "m.txt").write_text("5 6 8 1.5\n\nx y z\n1 2 7 1.0\n1 2 -4 1.0\n3 4 16\n")
    assert text_io.read_map(spark, f"{tmp_path}/m.txt").count() == 2
    (tmp_path / "f.txt").write_text("1 2 8 1 1 1\n1 2 16 1 1 1\n")
    with pytest.raises(ValueError):
        text_io.read_field(spark, f"{tmp_path}/f.txt")


def test_correlation_files(spark, tmp_path):
    c = spark.createDataFrame([(0, 1.5, 0.25, 0.1), (1, 3.0, -0.5, None)], "bin int, theta double, wtheta double, error double")
    text_io.write_correlation(c, f"{tmp_path}/c")
    assert [r[0].split()[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["1.5", "3"] or [float(r[0].split()[0]) for r in spark.read.text(f"{tmp_path}/c").collect()] == [1.5, 3.0]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a:1,b:2,,c", "  42abc", "x")], "p string, n string, t string")
    row = df.select(text.tokenize("p", ":,").alias("t"), text.parse_pairs("p").alias("m"), text.leading_int("n").alias("n"), text.leading_int("t", 7).alias("d"), text.leading_double(F.lit("-1.5e2z")).alias("f"), text.from_hex(F.lit("ff")).alias("h"), text.format_time(F.lit(0)).alias("when")).first()
    assert row["t"] == ["a", "1", "b", "2", "c"] and row["m"]["b"] == "2" and (row["n"], row["d"], row["f"], row["h"]) == (42, 7, -150.0, 255)
    assert row["when"] == "Thu, 01 Jan 1970 00:00:00 GMT"


def test_stream_adds_to_cells(spark, tmp_path):
    rows = survey(spark, [(0, 0), (0, 0.1), (50, 60)])
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = accumulate.cell_totals(stream, 4).writeStream.outputMode("complete").format("memory").queryName("cell_totals").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = cells.with_cell(rows, 4).groupBy("x", "y").count()
    assert {(r["x"], r["y"], r["n_points"]) for r in spark.table("cell_totals").collect()} == {tuple(r) for r in want.collect()}


def test_covering_tries_all_levels(spark):
    one = spark.createDataFrame([(12, 70000, 20000, 1.0)], "level int, x long, y long, weight double")
    assert [r["level"] for r in area_map.covering(one, 1).collect()] == [12]
    assert {r["level"] for r in area_map.covering(one, 20).collect()} == {14} and area_map.covering(one, 20).count() == 16
    assert {r["level"] for r in area_map.covering(one, 1000).collect()} == {15}
    assert {r["level"] for r in area_map.covering(one, 0).collect()} == {2}


@pytest.mark.parametrize(("lam", "eta"), [(60, 0), (3.3, 179.999), (-20.01, 77.7)])
def test_small_circles_are_pixelized(spark, lam, eta):
    circle = bounds.Circle(lam, eta, 0.01, "survey")
    got = area_map.summary(area_map.pixelize(spark, circle, 13)).first()
    assert got["area"] == pytest.approx(circle.area, rel=0.1)
