"""More sky queries and their SQL: text formats, cells in other spheres, cell-annulus relations, Hilbert unions, regions, hybrid and cross correlations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.functions import bounds, cells, coords, hcells
from celestrum.operators import area_map, blocks, correlation, field_map, points, random_points, regions
from celestrum.plans import registry as base
from celestrum.plans.fixtures import catalog, catalog_sql, center_sql, sky_map, sky_map_sql, x_sql, y_sql
from celestrum.plans.registry import CUSTOMER, DOT, ORDERS, PART, SUPPLIER, XYZ, customer, orders, part, query, r, rs, supplier
from celestrum.sources import scratch, text_io
from celestrum.streaming import accumulate

# Text formats: written and read back


def _round_trip(spark, df: DataFrame, write, read):
    path = scratch.folder(spark, "text")
    write(df, path)
    return read(spark, path)


@query("a1_a2_map_text", f"SELECT level, x, y, weight FROM {sky_map_sql('m')}")
def _(spark, d):
    return _round_trip(spark, sky_map(spark, "m"), text_io.write_map, text_io.read_map)


@query("a1_a2_map_text_of_one_index", f"SELECT level, x, y, 1e0 AS weight FROM {sky_map_sql('n')}")
def _(spark, d):
    return _round_trip(spark, sky_map(spark, "n"), lambda a, p: text_io.write_map(a, p, hpixel=False, weighted=False), lambda s, p: text_io.read_map(s, p, hpixel=False))


@query("a3_a4_field_text", f"SELECT x, y, unmasked, {rs('intensity', 2)} AS intensity, n_points FROM {base._FIELD}")
def _(spark, d):
    f = _round_trip(spark, base.field(spark, d), lambda a, p: text_io.write_field(a, p, 8), lambda s, p: text_io.read_field(s, p)[0])
    return f.withColumn("intensity", r(F.col("intensity"), 2))


def _vector(df, n: int = 9):
    return [r(F.col(c), n).alias(c) for c in XYZ]


_V = ", ".join(f"{rs(c, 9)} AS {c}" for c in XYZ)


@query("a5_a6_position_text", f"SELECT {_V} FROM {SUPPLIER}")
def _(spark, d):
    c = _round_trip(spark, supplier(spark, d), text_io.write_catalog, text_io.read_catalog)
    return c.select(*_vector(c))


@query("a7_a8_weighted_text", f"SELECT {_V.replace(', 9)', ', 7)')}, {rs('weight')} AS weight, {rs('2e0 * weight')} AS twice FROM {CUSTOMER}")
def _(spark, d):
    c = customer(spark, d).withColumn("twice", 2.0 * F.col("weight"))
    got = _round_trip(spark, c, lambda a, p: text_io.write_catalog(a, p, "galactic", ("twice", "weight")), lambda s, p: text_io.read_catalog(s, p, "galactic", fields={"twice": 2}, weight=3))
    # Negative weights stand; only a missing one is 1.
    return got.select(*_vector(got, 7), r(F.col("weight")).alias("weight"), r(F.col("twice")).alias("twice"))


@query("a9_attached_field", f"SELECT k, {rs('weight * 0.5e0 + ra')} AS mag FROM {CUSTOMER}")
def _(spark, d):
    c = customer(spark, d)
    values = c.select("k", (F.col("weight") * 0.5 + F.col("ra")).alias("mag"))
    return c.join(values, "k", "left").select("k", r(F.col("mag")).alias("mag"))


@query("a10_a11_redshift_text", f"SELECT {_V}, {rs('redshift')} AS redshift, {rs('weight')} AS weight FROM {PART}")
def _(spark, d):
    got = _round_trip(spark, part(spark, d), lambda a, p: text_io.write_catalog(a, p, "survey", ("redshift", "weight")), lambda s, p: text_io.read_catalog(s, p, "survey", redshift=2, weight=3))
    return got.select(*_vector(got), r(F.col("redshift")).alias("redshift"), r(F.col("weight")).alias("weight"))


@query("a12_a13_indexed_text", f"SELECT k AS id, {_V} FROM {SUPPLIER}")
def _(spark, d):
    got = _round_trip(spark, supplier(spark, d), lambda a, p: text_io.write_catalog(a, p, "equatorial", ("k",)), lambda s, p: text_io.read_catalog(s, p, index=2))
    return got.select("id", *_vector(got))


@query("a14_streamed_tree", f"SELECT {x_sql(16)} AS x, {y_sql(16)} AS y, count(*) AS n_points, {rs('sum(weight)', 2)} AS weight FROM {ORDERS} GROUP BY ALL")
def _(spark, d):
    """The catalog's rows as a stream of files into totals by cell; what the stream leaves is a table."""
    source, out = scratch.folder(spark, "stream"), scratch.folder(spark, "totals")
    orders(spark, d).select(*XYZ, "weight").repartition(4).write.parquet(source)
    rows = spark.readStream.schema("ux double, uy double, uz double, weight double").option("maxFilesPerTrigger", 2).parquet(source)
    totals = accumulate.cell_totals(rows, 16).writeStream.outputMode("complete").option("checkpointLocation", scratch.folder(spark, "progress"))
    totals.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("x", "y", "n_points", r(F.col("weight"), 2).alias("weight"))


@query("a15_correlation_text", f"SELECT bin, {rs('(DD - DR - RD + RR) / RR', 3)} AS wtheta, {rs('1e0 / sqrt(DD)', 3)} AS error FROM (SELECT bin, {base._WIDE} FROM ({base._COUNTS}) GROUP BY bin)")
def _(spark, d):
    g, n = base._samples(spark, d)
    w = correlation.auto_correlation(g, n, base.BINS).select("bin", "theta", "wtheta", "error")
    path = scratch.folder(spark, "text")
    text_io.write_correlation(w, path)
    f = F.split("value", " ")
    bin_ = base.BINS.number(f[0].cast("double"))
    return spark.read.text(path).select(bin_.alias("bin"), r(f[1].cast("double"), 3).alias("wtheta"), r(f[2].cast("double"), 3).alias("error"))


@query("a16_covariance_text", f"""SELECT a.bin AS bin_a, b.bin AS bin_b, round(49e0 / 64e0 * sum(a.d * b.d), 5) + 0e0 AS covariance FROM (SELECT *, w - avg(w) OVER (PARTITION BY bin) AS d FROM {base._LOOW}) a
  JOIN (SELECT *, w - avg(w) OVER (PARTITION BY bin) AS d FROM {base._LOOW}) b ON a.region = b.region GROUP BY ALL""")
def _(spark, d):
    path = scratch.folder(spark, "text")
    text_io.write_covariance(correlation.covariance(base._leave_one_out(spark, d)), path, base.BINS)
    f = F.split("value", " ")
    number = lambda k: base.BINS.number(f[k].cast("double"))
    return spark.read.text(path).select(number(0).alias("bin_a"), number(1).alias("bin_b"), r(f[2].cast("double"), 5).alias("covariance"))


_ID = "(2 * (k * 7919 % 16384) + 1)"


@query("a21_cell_tokens", f"SELECT k, rtrim(lpad(lower(hex(id)), 16, '0'), '0') AS token, id AS back FROM (SELECT k, ({_ID})::BIGINT * 140737488355328::BIGINT AS id FROM {CUSTOMER})")
def _(spark, d):
    c = customer(spark, d).select("k", F.expr(f"cast({_ID} as bigint) * 140737488355328").alias("id"))
    return c.select("k", hcells.token("id").alias("token")).withColumn("back", hcells.from_token("token"))


@query("x7_converted_file", f"SELECT k AS id, {_V} FROM {CUSTOMER}")
def _(spark, d):
    once = _round_trip(spark, customer(spark, d), lambda a, p: text_io.write_catalog(a, p, "equatorial", ("k",)), lambda s, p: text_io.read_catalog(s, p, index=2))
    twice = _round_trip(spark, once, lambda a, p: text_io.write_catalog(a, p, "ecliptic", ("id",)), lambda s, p: text_io.read_catalog(s, p, "ecliptic", index=2))
    return twice.select("id", *_vector(twice))


# Positions and cells


@query("b2_b10_spheres", " UNION ALL ".join(f"SELECT k, '{s}' AS system, {_V} FROM {SUPPLIER}" for s in ("sdss", "eq", "gal", "Ecliptic")))
def _(spark, d):
    s, out = supplier(spark, d), None
    for name in ("sdss", "eq", "gal", "Ecliptic"):
        lon, lat = coords.angles(name)
        first = (lat, lon) if coords.sphere(name) == "survey" else (lon, lat)
        one = s.select("k", F.lit(name).alias("system"), *[r(c, 9).alias(n) for n, c in zip(XYZ, coords.unit_vector(*first, name), strict=True)])
        out = one if out is None else out.unionByName(one)
    return out


@query("b16_fields", f"SELECT k, {rs('mag')} AS weight, {rs('weight')} AS mag, {rs('weight + mag')} AS total FROM (SELECT *, abs(weight) / 100e0 AS mag FROM {CUSTOMER})")
def _(spark, d):
    from celestrum.operators import catalogs

    c = catalogs.with_field(customer(spark, d), "mag", F.abs("weight") / 100.0)
    c = catalogs.with_field(c, "total", F.col("weight") + F.col("mag"))
    return catalogs.swap_weight(c, "mag").select("k", *[r(F.col(n)).alias(n) for n in ("weight", "mag", "total")])


def _corner_sql(res: int, dx: int, dy: int) -> tuple[str, str, str]:
    lam, eta = f"asin(1e0 - (y + {dy}) * {2 / (13 * res)!r}e0)", f"radians((x + {dx}) * {360 / (36 * res)!r}e0 + 91.25e0 + 32.5e0)"
    return f"(-sin({lam}))", f"(cos({lam}) * cos({eta}))", f"(cos({lam}) * sin({eta}))"


_CORNERS = [_corner_sql(64, dx, dy) for dy in (0, 1) for dx in (0, 1)]


@query("b21_corners", "SELECT k, " + ", ".join(f"{rs(v, 9)} AS {n}{i}" for i, c in enumerate(_CORNERS) for n, v in zip("xyz", c, strict=True)) + f" FROM {base._CELL}")
def _(spark, d):
    at = cells.corners(64)
    return base._cell(spark, d).select("k", *[r(at[i][n], 9).alias(f"{n}{i}") for i in range(4) for n in "xyz"])


@query("b23_levels", f"SELECT l::INTEGER AS level, pow(2, l)::BIGINT AS resolution, l::INTEGER AS back, {rs(f'{cells.cell_area(4)!r}e0 * 16e0 / pow(4, l)', 9)} AS area FROM range(2, 16) t(l)")
def _(spark, d):
    levels = spark.range(2, 16).select(F.col("id").cast("int").alias("level"), F.pow(F.lit(2.0), F.col("id")).cast("long").alias("resolution"))
    back = spark.createDataFrame([(1 << k, cells.level_of(1 << k), cells.cell_area(1 << k)) for k in range(2, 16)], "resolution long, back int, area double")
    return levels.join(back, "resolution").select("level", "resolution", "back", r(F.col("area"), 9).alias("area"))


_RA = [f"(((degrees(atan2({c[1]}, {c[0]})) + 95e0) % 360e0) + 360e0) % 360e0" for c in _CORNERS]


@query("b28_bounds_of_other_spheres", f"""SELECT k, {rs("list_min(t)")} AS lon_min, {rs("list_max(t)")} AS lon_max_continuous, {rs("list_min(dec)")} AS lat_min, {rs("list_max(dec)")} AS lat_max
  FROM (SELECT *, CASE WHEN list_max(ra) - list_min(ra) > 180e0 THEN list_transform(ra, lambda v: CASE WHEN v < 180e0 THEN v + 360e0 ELSE v END) ELSE ra END AS t
    FROM (SELECT k, [{", ".join(_RA)}] AS ra, [{", ".join(f"degrees(asin({c[2]}))" for c in _CORNERS)}] AS dec FROM {base._CELL}))""")
def _(spark, d):
    b = cells.bounds_in("equatorial", 64)
    return base._cell(spark, d).select("k", *[r(b[n]).alias(n) for n in ("lon_min", "lon_max_continuous", "lat_min", "lat_max")])


@query("b30_superpixel_cells", "SELECT s AS superpixel, 16::BIGINT AS n, (16 * (s % 144) * 4 + 24)::BIGINT AS sum_x, (16 * (s // 144) * 4 + 24)::BIGINT AS sum_y, ((s % 144) * 4 + 1)::BIGINT AS next_x FROM range(7488) t(s)")
def _(spark, d):
    s = spark.range(7488).select(F.col("id").alias("superpixel"), cells.of_superpixel(16, "id").alias("c"))
    total = lambda n: F.aggregate("c", F.lit(0).cast("long"), lambda a, v: a + v[n])
    first = s.withColumns({"x": F.col("c")[0]["x"], "y": F.col("c")[0]["y"]})
    return first.select("superpixel", F.size("c").cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"), cells.next_cell(16)[0].cast("long").alias("next_x"))


@query("b31_cell_weights", f"SELECT x, y, {rs('(weight * 3e0 + 1e0) * 0.5e0')} AS weight FROM {sky_map_sql('n')}")
def _(spark, d):
    a = area_map.scale_weight(area_map.add_constant_weight(area_map.scale_weight(sky_map(spark, "n"), 3.0), 1.0), 0.5)
    return a.select("x", "y", r(F.col("weight")).alias("weight"))


# Predicates


@query("c1_containment", f"SELECT k, x // 8 = 100 AND y // 8 = 50 AS cell_in_cell, x // 16 = {x_sql(4)} AND y // 16 = {y_sql(4)} AS point_in_cell FROM (SELECT *, {x_sql(64)} AS x, {y_sql(64)} AS y FROM {ORDERS})")
def _(spark, d):
    c = cells.with_cell(cells.with_cell(orders(spark, d), 64), 4, ("x4", "y4"))
    return c.select("k", cells.contains_cell(3, F.lit(100), F.lit(50), "x", "y").alias("cell_in_cell"), cells.contains_cell(4, "x4", "y4", "x", "y").alias("point_in_cell"))


_BOX = (-20.0, 35.0, 150.0, -140.0)
_ETA_MIN = "(CASE WHEN e >= 180e0 THEN e - 360e0 ELSE e END)"
_CELLS8 = "(SELECT *, x * 1.25e0 + 91.25e0 AS e, degrees(asin(1e0 - (y + 1) * {s}e0)) AS low, degrees(asin(1e0 - y * {s}e0)) AS high FROM (SELECT i % 288 AS x, i // 288 AS y FROM range(29952) t(i)))".format(s=repr(2 / 104))
_FROM = f"((({_ETA_MIN} - 150e0) % 360e0 + 360e0) % 360e0)"


@query("c2_cells_and_boxes", f"""SELECT x, y, low >= -20e0 - 1e-9 AND high <= 35e0 + 1e-9 AND ({_FROM} + 1e-9) % 360e0 + 1.25e0 <= 70e0 + 2e-9 AS within,
  high > -20e0 + 1e-9 AND low < 35e0 - 1e-9 AND ({_FROM} < 70e0 - 1e-9 OR {_FROM} + 1.25e0 > 360e0 + 1e-9) AS meets FROM {_CELLS8}""")
def _(spark, d):
    every = spark.range(29952).select((F.col("id") % 288).alias("x"), F.floor(F.col("id") / 288).cast("long").alias("y"))
    return every.select("x", "y", cells.within_box(8, *_BOX).alias("within"), cells.meets_box(8, *_BOX).alias("meets"))


@query("d3_window", f"SELECT x, y FROM {_CELLS8} WHERE high > -20e0 AND low < 35e0 AND ({_FROM} < 70e0 OR {_FROM} + 1.25e0 > 360e0)")
def _(spark, d):
    x0, x1, y0, y1 = cells.window(8, -20.0 + 1e-9, 35.0 - 1e-9, 150.0 + 1e-9, -140.0 - 1e-9)
    columns = spark.range((x1 - x0) % 288 + 1).select(((F.col("id") + x0) % 288).alias("x"))
    return columns.withColumn("y", F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))))


_NEAR_FAR: dict[str, str] = {}


def _edge_sql(dx: int) -> str:
    """Cosines of the angles to the nearest and farthest point of a meridian edge, from ux, uy, uz, low, high (radians), x."""
    e = f"radians((x + {dx}) * 2.5e0 + 91.25e0 + 32.5e0)"
    return f"(uy * cos({e}) + uz * sin({e}))"


def _near_sql() -> str:
    parts = ", ".join(f"{_edge_sql(dx)} AS w{dx}" for dx in (0, 1))
    more = ", ".join(f"sqrt(ux * ux + w{k} * w{k}) AS s{k}, atan2(-ux, w{k}) AS t{k}" for k in (0, 1))
    near = ", ".join(f"s{k} * CASE WHEN t{k} BETWEEN low AND high THEN 1e0 ELSE greatest(cos(low - t{k}), cos(high - t{k})) END" for k in (0, 1))
    turn = lambda k: f"(CASE WHEN t{k} > 0 THEN t{k} - pi() ELSE t{k} + pi() END)"
    far = ", ".join(f"s{k} * CASE WHEN {turn(k)} BETWEEN low AND high THEN -1e0 ELSE least(cos(low - t{k}), cos(high - t{k})) END" for k in (0, 1))
    inside = lambda sign, eta: f"CASE WHEN ((({eta} - ((x * 2.5e0 + 91.25e0))) % 360e0) + 360e0) % 360e0 <= 2.5e0 THEN cos({sign}asin(ux) - greatest(low, least(high, {sign}asin(ux)))) ELSE -1e0 END"
    eta, opposite = "degrees(atan2(uz, uy)) - 32.5e0", "degrees(atan2(-uz, -uy)) - 32.5e0"
    return f"""(SELECT k, x, y, degrees(acos(greatest(-1e0, least(1e0, greatest({near}, {inside('-', eta)}))))) AS near, degrees(acos(greatest(-1e0, least(1e0, least({far}, -({inside('', opposite)})))))) AS far
      FROM (SELECT *, {more} FROM (SELECT s.k, s.ux, s.uy, s.uz, c.x, c.y, asin(1e0 - (c.y + 1) * {2 / 52!r}e0) AS low, asin(1e0 - c.y * {2 / 52!r}e0) AS high, {parts} FROM (SELECT * FROM {SUPPLIER} WHERE k <= 10) s, (SELECT i % 144 AS x, i // 144 AS y FROM range(7488) t(i)) c)))"""


@query("c4_annulus_relation", f"SELECT k, status, count(*) AS n FROM (SELECT k, CASE WHEN near >= 25e0 OR far < 10e0 THEN 0 WHEN near >= 10e0 AND far < 25e0 THEN 1 ELSE -1 END AS status FROM {_near_sql()}) GROUP BY ALL")
def _(spark, d):
    return _point_cells(spark, d).withColumn("status", cells.annulus_relation(4, 10.0, 25.0)).groupBy("k", "status").agg(F.count("*").alias("n"))


def _point_cells(spark, d) -> DataFrame:
    """Ten positions and all cells of resolution 4: a row for each of both."""
    return supplier(spark, d).where("k <= 10").select("k", *XYZ).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7487)))).select("k", *XYZ, (F.col("c") % 144).cast("long").alias("x"), F.floor(F.col("c") / 144).cast("long").alias("y"))


@query("c5_cell_distances", f"SELECT k, {rs('sum(near)', 4)} AS near, {rs('sum(far)', 4)} AS far FROM {_near_sql()} GROUP BY k")
def _(spark, d):
    near, far = cells.distances(4)
    return _point_cells(spark, d).groupBy("k").agg(r(F.sum(near), 4).alias("near"), r(F.sum(far), 4).alias("far"))


_C4 = [_corner_sql(4, dx, dy) for dy in (0, 1) for dx in (0, 1)]
_CDOT = [f"(s.ux * {a} + s.uy * {b} + s.uz * {c})" for a, b, c in _C4]


@query("c5_corner_distances", f"SELECT k, {rs('sum(1e0 - pow(greatest(' + ', '.join(_CDOT) + '), 2))', 6)} AS near, {rs('sum(1e0 - pow(least(' + ', '.join(_CDOT) + '), 2))', 6)} AS far FROM {SUPPLIER} s, (SELECT i % 144 AS x, i // 144 AS y FROM range(7488) t(i)) c WHERE k <= 10 GROUP BY k")
def _(spark, d):
    near, far = cells.corner_distances(4)
    return _point_cells(spark, d).groupBy("k").agg(r(F.sum(near), 6).alias("near"), r(F.sum(far), 6).alias("far"))


_FOOT = f"(SELECT DISTINCT {x_sql(8)} AS x, {y_sql(8)} AS y FROM {ORDERS})"
_FOOT4 = f"(SELECT DISTINCT {x_sql(4)} AS x, {y_sql(4)} AS y FROM {CUSTOMER})"


def _foot(spark, d):
    return points.footprint(orders(spark, d), 8)


def _foot4(spark, d):
    return points.footprint(customer(spark, d), 4)


@query("c10_occupied_superpixels", f"SELECT 144 * (y // 2) + x // 2 AS superpixel, {rs(f'count(*) * {cells.cell_area(8)!r}e0')} AS area, false AS empty FROM {_FOOT} GROUP BY ALL")
def _(spark, d):
    a = _foot(spark, d)
    return area_map.occupied_superpixels(a).select("superpixel", r(F.col("area")).alias("area"), F.lit(a.isEmpty()).alias("empty"))


# Cells of shapes and maps of catalogs


@query("d2_cells_that_may_be_near", f"""SELECT s.k, count(*) AS n FROM {SUPPLIER} s, (SELECT i % 288 AS x, i // 288 AS y FROM range(29952) t(i)) c
  WHERE greatest({", ".join(f"s.ux * {a} + s.uy * {b} + s.uz * {z}" for a, b, z in [_corner_sql(8, dx, dy) for dy in (0, 1) for dx in (0, 1)])}) > cos(radians(6e0)) + 1e-12 GROUP BY s.k""")
def _(spark, d):
    near, _ = cells.corner_distances(8, XYZ, "cx", "cy")
    at = F.transform(cells.corners(8, "cx", "cy"), lambda c: c["x"] * F.col("ux") + c["y"] * F.col("uy") + c["z"] * F.col("uz"))
    return cells.cover(supplier(spark, d), 8, 6.0).where(F.array_max(at) > math.cos(math.radians(6.0)) + 1e-12).groupBy("k").agg(F.count("*").alias("n"))


_RING = [(0.5, 0.5, 4), *[(x, y, 3) for x, y in ((0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75), (0.5, 0.25), (0.5, 0.75), (0.25, 0.5), (0.75, 0.5))], *[(x, y, 2) for x, y in ((0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.5))], *[(x, y, 1) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))]]


def _pixelized_sql(circle: bounds.Circle, start: int, level: int) -> str:
    """level, x, y: from cells of a level on, those wholly in by their probe points stay, others are divided; at the last those half in stay."""
    ax, ay, az = circle.axis
    lam = lambda dy: f"asin(1e0 - (y + {dy}e0) / (6.5e0 * pow(2, level)))"
    eta = lambda dx: f"radians((x + {dx}e0) * 10e0 / pow(2, level) + 123.75e0)"
    hit = lambda dx, dy: f"(-sin({lam(dy)}) * ({ax!r}) + cos({lam(dy)}) * cos({eta(dx)}) * ({ay!r}) + cos({lam(dy)}) * sin({eta(dx)}) * ({az!r}) >= {math.cos(math.radians(circle.radius))!r} - 1e-15)"
    score = " + ".join(f"CASE WHEN {hit(dx, dy)} THEN {w} ELSE 0 END" for dx, dy, w in _RING)
    whole = sum(w for *_, w in _RING)
    # A cell of a level is no wider than 12 degrees over its resolution from its middle on.
    near = f"(-sin({lam(0.5)}) * ({ax!r}) + cos({lam(0.5)}) * cos({eta(0.5)}) * ({ay!r}) + cos({lam(0.5)}) * sin({eta(0.5)}) * ({az!r}) >= cos(least(pi(), radians({circle.radius}e0 + 60e0 / pow(2, level)))))"
    return f"""(WITH RECURSIVE every(level, x, y) AS (SELECT {start}, i % {36 << start}, i // {36 << start} FROM range({(36 << start) * (13 << start)}) t(i)),
      now(level, x, y, score) AS (SELECT level, x, y, {score} FROM every WHERE {near}
        UNION ALL SELECT level, x, y, {score} FROM (SELECT level + 1 AS level, 2 * x + a AS x, 2 * y + b AS y FROM now, range(2) p(a), range(2) q(b) WHERE score < {whole} AND level < {level}) WHERE {near})
      SELECT level::INTEGER AS level, x, y FROM now WHERE score = {whole} OR level = {level} AND 2 * score >= {whole})"""


_C5 = bounds.Circle(200, 10, 5)


@query("d4_adaptive_cells", f"SELECT level, x, y FROM {_pixelized_sql(_C5, 4, 7)}")
def _(spark, d):
    return area_map.pixelize(spark, _C5, 7).select("level", "x", "y")


_C3 = bounds.Circle(60, 0, 3, "survey")


@query("p8_x8_pixelized_circle", f"SELECT count(*) AS n, {rs(f'sum({cells.cell_area(4)!r}e0 * 16e0 / pow(4, level))')} AS area FROM {_pixelized_sql(_C3, 5, 8)}")
def _(spark, d):
    p = area_map.pixelize(spark, _C3, 8, start=5)
    return p.agg(F.count("*").alias("n"), r(F.sum(cells.level_area(F.col("level")))).alias("area"))


@query("d4_topped_up", f"SELECT true AS within, true AS near")
def _(spark, d):
    area = area_map.pixelize(spark, _C5, 8, top_up=True).agg(F.sum(cells.level_area(F.col("level"))).alias("area"))
    one = cells.cell_area(256)
    return area.select((F.col("area") <= _C5.area + one).alias("within"), (F.col("area") > _C5.area * 0.99).alias("near"))


@query("d9_dump", f"SELECT 144 * (y // 4) + x // 4 AS superpixel, 4 * (y % 4) + x % 4 AS hpixel, weight FROM (SELECT x * 2 + a AS x, y * 2 + b AS y, weight FROM {sky_map_sql('m')}, range(2) p(a), range(2) q(b)) WHERE 144 * (y // 4) + x // 4 < 2000")
def _(spark, d):
    return area_map.dump(sky_map(spark, "m"), 4).where("superpixel < 2000")


_UP = "(SELECT DISTINCT x, y FROM (SELECT x * 2 + a AS x, y * 2 + b AS y FROM {f}, range(2) p(a), range(2) q(b)))".format(f=_FOOT4)


@query("f1_f2_f3_of_catalogs", f"""SELECT 'union' AS kind, x, y FROM (SELECT x, y FROM {_FOOT} UNION SELECT x, y FROM {_UP}) UNION ALL SELECT 'both', a.x, a.y FROM {_FOOT} a JOIN {_UP} b ON a.x = b.x AND a.y = b.y
  UNION ALL SELECT 'without', a.x, a.y FROM {_UP} a ANTI JOIN {_FOOT} b ON a.x = b.x AND a.y = b.y""")
def _(spark, d):
    """Set algebra of the catalogs' footprints, at two resolutions."""
    a, b = scratch.written(_foot(spark, d), "foot"), scratch.written(_foot4(spark, d), "foot")
    kinds = {"union": area_map.ingest(a, b), "both": area_map.intersect(a, b), "without": area_map.exclude(b, a)}
    out = None
    for kind, m in kinds.items():
        one = area_map.expand(m, 3).select(F.lit(kind).alias("kind"), "x", "y")
        out = one if out is None else out.unionByName(one)
    return out


@query("f9_clear", "SELECT 0::BIGINT AS n, true AS empty")
def _(spark, d):
    a = area_map.clear(_foot(spark, d))
    return a.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("empty"))


# Bins, orderings, regions


@query("g15_g26_bins", "SELECT k::INTEGER AS bin, round(pow(10e0, (k - 6) / 3e0), 9) AS theta_min, round(pow(10e0, (k - 5) / 3e0), 9) AS theta_max, round(pow(10e0, (k - 5.5e0) / 3e0), 9) AS theta FROM range(9) t(k)")
def _(spark, d):
    t = correlation.Bins.logarithmic(0.01, 10.0, 3).table(spark)
    return t.select("bin", *[r(F.col(c), 9).alias(c) for c in ("theta_min", "theta_max", "theta")])


@query("g25_bin_resolutions", f"""SELECT k::INTEGER AS bin, coalesce((SELECT min(res) FROM (SELECT (4 * pow(2, i))::INTEGER AS res FROM range(7) r(i)) WHERE sqrt({cells.cell_area(4)!r}e0 * 16e0 / (res * res)) <= 0.5e0 * pow(10e0, (k - 6) / 3e0)), 0)::INTEGER AS resolution FROM range(9) t(k)""")
def _(spark, d):
    return correlation.Bins.logarithmic(0.01, 10.0, 3).with_resolutions(4, 256).table(spark).select("bin", "resolution")


@query("h2_sections", f"""SELECT stripe, (sum(fresh) OVER (ORDER BY stripe) - 1)::INTEGER AS section FROM (SELECT stripe, CASE WHEN (row_number() OVER (PARTITION BY island ORDER BY stripe) - 1) % w = 0 THEN 1 ELSE 0 END AS fresh
  FROM (SELECT *, sum(gap) OVER (ORDER BY stripe) AS island, greatest(1, round_even(count(*) OVER () / 3e0, 0)) AS w FROM (SELECT stripe, CASE WHEN stripe - lag(stripe) OVER (ORDER BY stripe) > 1 THEN 1 ELSE 0 END AS gap FROM (
    SELECT DISTINCT CASE WHEN s < 0 THEN s + 288 ELSE s END AS stripe FROM (SELECT f + CASE WHEN eta < 1.25e0 * (f - 10) - 32.5e0 - 0.625e0 + 1e-7 THEN 1 ELSE 0 END + CASE WHEN eta > 1.25e0 * (f - 10) - 32.5e0 + 0.625e0 - 1e-7 THEN 1 ELSE 0 END AS s
      FROM (SELECT *, CAST(trunc((eta + 32.5e0) / 1.25e0) AS BIGINT) + 10 AS f FROM (SELECT CASE WHEN e >= 180e0 THEN e - 360e0 ELSE e END AS eta FROM (SELECT (x + 0.5e0) * 1.25e0 + 91.25e0 AS e FROM {sky_map_sql('m')} WHERE x % 20 < 7))))))))""")
def _(spark, d):
    m = sky_map(spark, "m").where("x % 20 < 7")
    return regions.sections(m, 8, 9)


@query("h1_h4_regions", "SELECT 10::BIGINT AS n_regions, true AS covered, true AS near_equal")
def _(spark, d):
    cov = area_map.coverage(_foot(spark, d), 3)
    areas = regions.region_areas(regions.regionate(cov, 8, 10))
    whole = cov.agg(F.sum("weight")).first()[0] * cells.cell_area(8)
    spread = F.max("area") - F.min("area")
    return areas.agg(F.count("*").alias("n_regions"), (F.abs(F.sum("area") - whole) < 1e-6).alias("covered"), (spread < 4 * cells.cell_area(8)).alias("near_equal"))


@query("h3_region_bounds", f"""SELECT region, count(*) AS n_cells, {rs(f'count(*) * {cells.cell_area(4)!r}e0')} AS area FROM (SELECT CASE WHEN a >= b AND a > 0 THEN 0 WHEN b > 0 THEN 1 END AS region FROM (SELECT x, y,
  {" + ".join(f"CASE WHEN degrees(asin(1e0 - (y + {dy}e0) * {2 / 52!r}e0)) BETWEEN -40e0 AND 0e0 THEN 1 ELSE 0 END" for _, dy, in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)))} AS a,
  {" + ".join(f"CASE WHEN degrees(asin(1e0 - (y + {dy}e0) * {2 / 52!r}e0)) BETWEEN -5e0 AND 30e0 THEN 1 ELSE 0 END" for _, dy, in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)))} AS b FROM {sky_map_sql('n')})) WHERE region IS NOT NULL GROUP BY region""")
def _(spark, d):
    cov = area_map.coverage(sky_map(spark, "n"), 2)
    some = regions.from_bounds(cov, [bounds.LatitudeBand(-40, 0, "survey"), bounds.LatitudeBand(-5, 30, "survey")], 4)
    return regions.region_areas(some).select("region", "n_cells", r(F.col("area")).alias("area"))


@query("h4_region_areas", f"SELECT region::INTEGER AS region, count(*) AS n_cells, {rs(f'count(*) * {cells.cell_area(4)!r}e0')} AS area FROM (SELECT (4 * (y // 20) + x // 36) AS region FROM {sky_map_sql('n')}) GROUP BY region")
def _(spark, d):
    blocks_ = regions.block_regions(area_map.coverage(sky_map(spark, "n"), 2), 36, 20, 4)
    return regions.region_areas(blocks_).select("region", "n_cells", r(F.col("area")).alias("area"))


_MIX = f"(SELECT 3 AS level, x, y FROM {_FOOT} UNION ALL SELECT 2, x, y FROM {_FOOT4})"


@query("h5_orderings", f"""SELECT level::INTEGER AS level, x, y, row_number() OVER (PARTITION BY s ORDER BY level, y, x) AS local_rank, row_number() OVER (PARTITION BY s ORDER BY level, h) AS super_rank
  FROM (SELECT *, CASE WHEN level = 3 THEN 144 * (y // 2) + x // 2 ELSE 144 * y + x END AS s, CASE WHEN level = 3 THEN 2 * (y % 2) + x % 2 ELSE 0 END AS h FROM {_MIX})""")
def _(spark, d):
    from pyspark.sql import Window

    both = _foot(spark, d).select("level", "x", "y").unionByName(_foot4(spark, d).select("level", "x", "y"))
    order = cells.superpixel_order()
    by = lambda keys: F.row_number().over(Window.partitionBy(order[0]).orderBy(*keys)).cast("long")
    return both.select("level", "x", "y", by(cells.local_order()).alias("local_rank"), by(order[1:]).alias("super_rank"))


@query("h6_equality", "SELECT true AS same, false AS with_weights, true AS up_to_tolerance, false AS other")
def _(spark, d):
    a = scratch.written(_foot(spark, d), "foot")
    doubled, close = area_map.scale_weight(a, 2.0), area_map.add_constant_weight(a, 1e-7)
    found = (area_map.same_geometry(a, doubled), area_map.same_geometry(a, doubled, True), area_map.same_geometry(a, close, True), area_map.same_geometry(a, a.where("x > 3")))
    return spark.createDataFrame([found], "same boolean, with_weights boolean, up_to_tolerance boolean, other boolean")


# Random points


@query("j1_j2_points_in_maps", "SELECT 5000::BIGINT AS n, 5000::BIGINT AS inside, true AS even")
def _(spark, d):
    m = sky_map(spark, "n")
    p = random_points.over_map(m, 5000, seed=11)
    found = area_map.find_location(p, m, 2).agg(F.count("*").alias("n"), F.count("map_weight").alias("inside"))
    # Shares of the three weights among the points and among the cells.
    share = area_map.find_location(p, m, 2).groupBy("map_weight").count().join(m.groupBy(F.col("weight").alias("map_weight")).agg(F.count("*").alias("cells")), "map_weight")
    total = m.count()
    even = share.agg(F.max(F.abs(F.col("count") / 5000 - F.col("cells") / total)).alias("off"))
    return found.crossJoin(even.select((F.col("off") < 0.03).alias("even")))


@query("j1_j3_points_in_shapes", "SELECT q::INTEGER AS q, 300::BIGINT AS n, 300::BIGINT AS inside FROM range(4) t(q)")
def _(spark, d):
    circle, out = bounds.Circle(200, 10, 2), None
    for q in range(4):
        p = random_points.in_quadrant(spark, circle, q, 300, seed=q)
        one = p.agg(F.lit(q).alias("q"), F.count("*").alias("n"), F.count(F.when(circle.contains(), 1)).alias("inside"))
        out = one if out is None else out.unionByName(one)
    return out


# Correlations


@query("g22_pixel_bins", f"""SELECT bin, {rs("sum(a.delta * b.delta * a.unmasked * b.unmasked) / sum(a.unmasked * b.unmasked)")} AS wtheta FROM (SELECT a.*, b.delta AS bd, b.unmasked AS bu, CASE WHEN {DOT} > cos(radians(8e0)) + 1e-15 THEN 0 ELSE 1 END AS bin FROM {base._F4} a
  JOIN {base._F4} b ON (b.y > a.y OR b.y = a.y AND b.x > a.x) AND {DOT} <= cos(radians(5e0)) + 1e-15 AND {DOT} > cos(radians(12e0)) + 1e-15) GROUP BY bin""".replace("a.delta * b.delta * a.unmasked * b.unmasked", "delta * bd * unmasked * bu").replace("sum(a.unmasked * b.unmasked)", "sum(unmasked * bu)"))
def _(spark, d):
    bins = correlation.Bins((5.0, 8.0, 12.0), (4, 4))
    return correlation.pixel_correlation(base.field(spark, d), "density", 3, bins).select(F.col("bin").cast("int").alias("bin"), r(F.col("wtheta")).alias("wtheta"))


_HYBRID = (2.0, 5.0, 8.0)
_HBIN = f"{DOT} <= cos(radians(2e0)) + 1e-15 AND {DOT} > cos(radians(5e0)) + 1e-15"
_ONES = f"(SELECT *, 1e0 AS one FROM {ORDERS})"


def _count_sql(a: str, b: str) -> str:
    return f"(SELECT count(*)::DOUBLE AS c FROM {a} a, {b} b WHERE {_HBIN})"


@query("g21_g25_hybrid", f"""SELECT 0 AS bin, 0 AS resolution, {rs("(dd.c - 2e0 * dr.c + rr.c) / rr.c")} AS wtheta FROM {_count_sql(CUSTOMER, CUSTOMER)} dd, {_count_sql(CUSTOMER, catalog_sql('part'))} dr, {_count_sql(catalog_sql('part'), catalog_sql('part'))} rr
  UNION ALL SELECT 1, 4, {rs("sum(a.delta * b.delta * a.unmasked * b.unmasked) / sum(a.unmasked * b.unmasked)")} FROM {base._F4} a JOIN {base._F4} b ON (b.y > a.y OR b.y = a.y AND b.x > a.x) AND {DOT} <= cos(radians(5e0)) + 1e-15 AND {DOT} > cos(radians(8e0)) + 1e-15""")
def _(spark, d):
    """The narrow bin by pairs of customers, the wide one by cells of the orders' field."""
    g, n = base._samples(spark, d)
    bins = correlation.Bins(_HYBRID, (0, 0)).with_resolutions(4, 4)
    w = correlation.hybrid_correlation(g, n, base.field(spark, d), "density", 3, bins)
    return w.select("bin", "resolution", r(F.col("wtheta")).alias("wtheta"))


_OTH_C = f"(SELECT *, {base._region_sql('')} AS region FROM {catalog_sql('orders')} WHERE k % 3 = 0)"
_SUP_C = f"(SELECT *, {base._region_sql('')} AS region FROM {SUPPLIER})"


def _kinds_sql(kinds) -> str:
    return " UNION ALL ".join(f"SELECT bin, '{kind}' AS kind, ra_, rb_, count(*)::DOUBLE AS w FROM (SELECT {base._LSBIN} AS bin, a.region AS ra_, b.region AS rb_ FROM {a} a, {b} b) WHERE bin IS NOT NULL GROUP BY ALL" for kind, a, b in kinds)


_XCOUNTS = _kinds_sql((("DD", base._GAL_C, _OTH_C), ("DR", base._GAL_C, base._RAN_C), ("RD", base._RAN_C, _OTH_C), ("RR", base._RAN_C, base._RAN_C)))
_XLOOW = f"(SELECT bin, region, (DD - DR - RD + RR) / RR AS w FROM (SELECT bin, region, {base._WIDE} FROM ({_XCOUNTS}) c, range(8) g(region) WHERE ra_ <> region AND rb_ <> region GROUP BY bin, region))"


@query("x3_cross_jackknife", f"SELECT bin, {rs('m')} AS wtheta, {rs('7e0 / 8e0 * sqrt(sum((w - m) * (w - m)))')} AS error FROM (SELECT *, avg(w) OVER (PARTITION BY bin) AS m FROM {_XLOOW}) GROUP BY bin, m")
def _(spark, d):
    g, n = base._samples(spark, d)
    other = base._with_region(orders(spark, d).where("k % 3 = 0").withColumn("weight", F.lit(1.0)))
    w = correlation.cross_correlation(g, other, n, n, base.BINS, n_regions=8)
    return w.select("bin", r(F.col("wtheta")).alias("wtheta"), r(F.col("error")).alias("error"))


_CUT = f"(SELECT * FROM {base._GAL_C} WHERE weight BETWEEN 0e0 AND 6000e0)"
_PCOUNTS = _kinds_sql((("DD", _CUT, _CUT), ("DR", _CUT, base._RAN_C), ("RD", base._RAN_C, _CUT), ("RR", base._RAN_C, base._RAN_C)))


@query("p5_x4_cut_sample", f"SELECT bin, {rs('(DD - DR - RD + RR) / RR')} AS wtheta, {rs('1e0 / sqrt(DD)')} AS error FROM (SELECT bin, {base._WIDE} FROM ({_PCOUNTS}) GROUP BY bin)")
def _(spark, d):
    """Customers within a cut of their balance, as a cut of magnitudes."""
    g = base._with_region(customer(spark, d).where(F.col("weight").between(0.0, 6000.0)).withColumn("weight", F.lit(1.0)))
    _, n = base._samples(spark, d)
    w = correlation.auto_correlation(g, n, base.BINS)
    return w.select("bin", r(F.col("wtheta")).alias("wtheta"), r(F.col("error")).alias("error"))


_PER_FIELD = f"(SELECT bin, ra_ AS field, {base._WIDE} FROM ({base._COUNTS}) WHERE ra_ = rb_ GROUP BY ALL)"


@query("x11_combined_fields", f"""SELECT bin, {rs('m')} AS wtheta, {rs('(n - 1e0) / n * sqrt(sum((w - m) * (w - m)))')} AS error FROM (SELECT *, avg(w) OVER (PARTITION BY bin) AS m, count(w) OVER (PARTITION BY bin) AS n FROM (
  SELECT a.bin, a.field, (sum(b.DD) - sum(b.DR) - sum(b.RD) + sum(b.RR)) / sum(b.RR) AS w FROM {_PER_FIELD} a JOIN {_PER_FIELD} b ON a.bin = b.bin AND a.field <> b.field GROUP BY ALL)) GROUP BY bin, m, n""")
def _(spark, d):
    """Each region's own pairs as one field's counts."""
    g, n = base._samples(spark, d)
    pairs = correlation.pair_counts(g, n, base.BINS, regions=True).where("region_a = region_b")
    per = pairs.groupBy("bin", F.col("region_a").alias("field")).pivot("kind", ["DD", "DR", "RD", "RR"]).agg(F.sum("weight")).na.fill(0.0)
    w = correlation.combine_fields(per)
    return w.select("bin", r(F.col("wtheta")).alias("wtheta"), r(F.col("error")).alias("error"))


@query("x10_shuffled_weights", f"SELECT count(*) AS n, {rs('sum(weight)', 2)} AS weight, {rs('sum(ux * uy)')} AS positions, true AS moved FROM {ORDERS}")
def _(spark, d):
    o = orders(spark, d).select("k", *XYZ, "weight")
    s = correlation.shuffled_weights(o.select(*XYZ, "weight", "k"))
    moved = s.join(o.select("k", F.col("weight").alias("was")), "k")
    return moved.agg(F.count("*").alias("n"), r(F.sum("weight"), 2).alias("weight"), r(F.sum(F.col("ux") * F.col("uy"))).alias("positions"), (F.count(F.when(F.col("weight") != F.col("was"), 1)) > 0.9 * F.count("*")).alias("moved"))


@query("x5_density_map", f"SELECT x // 4 AS x, y // 4 AS y, {rs(f'sum(n_points) / (count(*) / 16e0 * {cells.cell_area(2) if False else cells.SUPERPIXEL_DEG2 * 4!r}e0)')} AS density FROM {base._FIELD} GROUP BY ALL".replace("x // 4", "x // 2").replace("y // 4", "y // 2").replace("count(*) / 16e0", "count(*) / 4e0").replace(f"{cells.SUPERPIXEL_DEG2 * 4!r}", f"{cells.cell_area(4)!r}"))
def _(spark, d):
    f = field_map.densities(field_map.resample(base.field(spark, d), "density", 3, 2), 4)
    return f.select("x", "y", r(F.col("point_density")).alias("density"))


@query("x6_random_catalog", "SELECT 2000::BIGINT AS n, 2000::BIGINT AS inside, 2000::BIGINT AS with_weight")
def _(spark, d):
    """Random positions over a map, each with the weight of a row of the catalog."""
    m = sky_map(spark, "n")
    p = random_points.with_copied(random_points.over_map(m, 2000, seed=3, weighted=True), customer(spark, d), ["weight"], seed=3)
    known = customer(spark, d).select("weight").distinct()
    inside = area_map.find_location(p, m, 2, how="left_semi").join(known, "weight", "left_semi")
    return inside.agg(F.count("*").alias("n"), F.count("ux").alias("inside"), F.count("weight").alias("with_weight"))


# Cells on the Hilbert curve: unions of ids, by arithmetic on their places along the curve


def _id_sql(level: int, p: str) -> str:
    return f"((2 * ({p}) + 1)::BIGINT * {1 << (60 - 2 * level)}::BIGINT)"


def _ids(spark, level: int, rule: str) -> DataFrame:
    """Cells of the first two faces whose place satisfies a rule."""
    return spark.range(2 * 4**level).withColumnRenamed("id", "p").where(rule).select(((2 * F.col("p") + 1) * (1 << (60 - 2 * level))).alias("cell"))


_A6, _B4 = "(p * 7 + p // 13) % 5 < 3", "(p * 3 + p // 7) % 4 < 2"
_FINE_A = f"(SELECT p FROM range({2 * 4**6}) t(p) WHERE {_A6})"
_FINE_B = f"(SELECT p * 16 + i AS p FROM range({2 * 4**4}) t(p), range(16) f(i) WHERE {_B4})"


def _places(cells_: DataFrame, level: int) -> DataFrame:
    """Places of the cells' descendants at one level."""
    first = F.shiftright(hcells.range_min("cell"), 60 - 2 * level + 1)
    last = F.shiftright(hcells.range_max("cell"), 60 - 2 * level + 1)
    return cells_.select(F.explode(F.sequence(first, last)).alias("p"))


@query("l15_union_algebra", f"SELECT 'union' AS kind, p FROM (SELECT p FROM {_FINE_A} UNION SELECT p FROM {_FINE_B}) UNION ALL SELECT 'both', p FROM {_FINE_A} SEMI JOIN {_FINE_B} USING (p) UNION ALL SELECT 'without', p FROM {_FINE_B} ANTI JOIN {_FINE_A} USING (p)")
def _(spark, d):
    rule = lambda s: s.replace("//", "div")
    a, b = _ids(spark, 6, rule(_A6)), _ids(spark, 4, rule(_B4))
    out = None
    for kind, cells_ in (("union", hcells.union(a, b)), ("both", hcells.intersection(a, b)), ("without", hcells.difference(b, a))):
        one = _places(cells_, 6).select(F.lit(kind).alias("kind"), "p")
        out = one if out is None else out.unionByName(one)
    return out


@query("l15_normalized", f"SELECT {_id_sql(4, 'p')} AS cell FROM range(64) t(p) WHERE p >= 32 AND p % 16 < 4 AND false UNION ALL SELECT {_id_sql(2, 'q')} FROM range(4) t(q)")
def _(spark, d):
    """All cells of level 4 in four of level 2 (whose parent they'd fill but for its last one), some of them twice and with descendants."""
    fine = _ids(spark, 4, "p < 64")
    kids = fine.where("cell % 3 = 0").select(F.explode(hcells.children("cell")).alias("cell"))
    whole = hcells.normalize(fine.unionByName(fine).unionByName(kids))
    # Four of level 2 make one of level 1: divide it again.
    return whole.select(F.explode(hcells.children("cell")).alias("cell"))


@query("l6_family", f"""SELECT p, {_id_sql(4, 'p // 4')} AS parent, {_id_sql(5, 'p')} - {(1 << 50) - 1} AS low, {_id_sql(5, 'p')} + {(1 << 50) - 1} AS high, {_id_sql(6, '4 * p')} AS first_child, {_id_sql(6, '4 * p + 3')} AS last_child,
  {_id_sql(5, 'p + 1')} AS next, {_id_sql(5, '4 * (p // 4)')} AS first_sibling, 5 AS level FROM range(2048) t(p)""")
def _(spark, d):
    c = _ids(spark, 5, "true").withColumn("p", F.shiftright("cell", 51)).where("p < 2048")
    kids = hcells.children("cell")
    return c.select("p", hcells.parent("cell", 4).alias("parent"), hcells.range_min("cell").alias("low"), hcells.range_max("cell").alias("high"), kids[0].alias("first_child"), kids[3].alias("last_child"), hcells.next_cell("cell").alias("next"), hcells.siblings("cell")[0].alias("first_sibling"), hcells.level_of("cell").alias("level"))


@query("l7_l16_status", f"""SELECT p, {rs("n / 16e0")} AS share, CASE WHEN n = 16 THEN 1 WHEN n > 0 THEN -1 ELSE 0 END AS status, n >= 8 AS softened FROM (SELECT t.p, count(a.p) AS n FROM range(512) t(p) LEFT JOIN {_FINE_A.replace('< 3', '< 2')} a ON a.p // 16 = t.p GROUP BY t.p)""")
def _(spark, d):
    union = hcells.normalize(_ids(spark, 6, _A6.replace("//", "div").replace("< 3", "< 2")))
    some = _ids(spark, 4, "true")
    soft = _places(hcells.soften(union, 4), 4).select("p", F.lit(True).alias("softened"))
    found = hcells.status(some, union).withColumn("p", F.shiftright("cell", 53))
    return found.join(soft, "p", "left").select("p", r(F.col("share")).alias("share"), "status", F.coalesce("softened", F.lit(False)).alias("softened"))


@query("l22_curve_regions", f"SELECT region, count(*) AS n FROM (SELECT least(7, floor((row_number() OVER (ORDER BY p) - 0.5e0) / (count(*) OVER () / 8e0)))::INTEGER AS region FROM {_FINE_A}) GROUP BY region")
def _(spark, d):
    return hcells.regions(_ids(spark, 6, _A6.replace("//", "div")), 8).groupBy("region").agg(F.count("*").alias("n"))


@query("l14_coverer", f"SELECT k FROM {ORDERS} WHERE ux * cos(radians(105e0)) + uy * sin(radians(105e0)) >= cos(radians(7e0)) - 1e-15")
def _(spark, d):
    """Points of a circle by a covering of at most 40 cells of several levels."""
    ids = hcells.coverer((math.cos(math.radians(200)), math.sin(math.radians(200)), 0.0), 7.0, 40)
    cover = spark.createDataFrame([(int(c),) for c in ids], "cell long")
    c = orders(spark, d).withColumn("leaf", hcells.leaf_id("ra", coords.declination()))
    return hcells.locate(c, cover).where(bounds.Circle(200, 0, 7).contains()).select("k")
