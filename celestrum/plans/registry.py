"""Names of the sky queries, their plans and their DuckDB equivalents. Names begin with the operators' ids in the survey."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.functions import bounds, cells, coords, text
from celestrum.functions.cosmo import Cosmology
from celestrum.operators import area_map, blocks, correlation, field_map, points, random_points, regions
from celestrum.plans.fixtures import ETA, catalog, catalog_sql, center_sql, fine_sql, sky_map, sky_map_sql, x_sql, y_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r(c, n: int = 6):
    """Rounded, without negative zeros."""
    return F.round(c, n) + 0.0


def rs(e: str, n: int = 6) -> str:
    return f"(round({e}, {n}) + 0e0)"


CUSTOMER, ORDERS, SUPPLIER = catalog_sql("customer", "c_acctbal AS weight"), catalog_sql("orders", "o_totalprice AS weight"), catalog_sql("supplier", "s_acctbal AS weight")
PART = catalog_sql("part", "0.05e0 + p_size / 50e0 AS redshift", "p_retailprice AS weight")
DOT = "greatest(-1e0, least(1e0, a.ux * b.ux + a.uy * b.uy + a.uz * b.uz))"
XYZ = ("ux", "uy", "uz")


def customer(spark, d) -> DataFrame:
    return catalog(spark, d, "customer", "c_acctbal AS weight")


def orders(spark, d) -> DataFrame:
    return catalog(spark, d, "orders", "o_totalprice AS weight")


def supplier(spark, d) -> DataFrame:
    return catalog(spark, d, "supplier", "s_acctbal AS weight")


def part(spark, d) -> DataFrame:
    return catalog(spark, d, "part", "0.05D + p_size / 50D AS redshift", "p_retailprice AS weight")


# Coordinates


@query("b1_b6_unit_vectors", f"""SELECT k, {rs("ux", 9)} AS ux, {rs("uy", 9)} AS uy, {rs("uz", 9)} AS uz,
  {rs("-sin(radians(lam))", 9)} AS sx, {rs("cos(radians(lam)) * cos(radians(eta + 32.5e0))", 9)} AS sy, {rs("cos(radians(lam)) * sin(radians(eta + 32.5e0))", 9)} AS sz
  FROM (SELECT *, 90e0 * uz AS lam, ra - 180e0 AS eta FROM {CUSTOMER})""")
def _(spark, d):
    c = customer(spark, d)
    vx, vy, vz = coords.unit_vector(F.col("ra"), coords.declination("uz"), "equatorial")
    sx, sy, sz = coords.unit_vector(90.0 * F.col("uz"), F.col("ra") - 180.0, "survey")
    return c.select("k", r(vx, 9).alias("ux"), r(vy, 9).alias("uy"), r(vz, 9).alias("uz"), r(sx, 9).alias("sx"), r(sy, 9).alias("sy"), r(sz, 9).alias("sz"))


@query("b3_b4_angles", f"SELECT k, {rs('-degrees(asin(ux))')} AS lambda, {rs(ETA)} AS eta, {rs('ra')} AS ra, {rs('degrees(asin(uz))')} AS dec FROM {ORDERS}")
def _(spark, d):
    return orders(spark, d).select("k", r(coords.survey_lambda()).alias("lambda"), r(coords.survey_eta()).alias("eta"), r(coords.right_ascension()).alias("ra"), r(coords.declination()).alias("dec"))


_GAL = "radians(ra) - 4.9368292465e0"
_LON = f"degrees(atan2(0.45598377618e0 * sqrt(1e0 - uz * uz) * sin({_GAL}) + 0.88998808748e0 * uz, sqrt(1e0 - uz * uz) * cos({_GAL})) + 0.57477043300e0)"


@query("b5_b8_galactic", f"SELECT k, {rs(f'(({_LON} % 360e0) + 360e0) % 360e0')} AS lon, {rs(f'degrees(asin(0.45598377618e0 * uz - 0.88998808748e0 * sqrt(1e0 - uz * uz) * sin({_GAL})))')} AS lat FROM {CUSTOMER}")
def _(spark, d):
    lon, lat = coords.galactic()
    return customer(spark, d).select("k", r(lon).alias("lon"), r(lat).alias("lat"))


@query("b7_b9_round_trips", f"SELECT k, {rs('ra')} AS ra, {rs('degrees(asin(uz))')} AS dec, {rs('-degrees(asin(ux))')} AS lambda, {rs(ETA)} AS eta FROM {SUPPLIER}")
def _(spark, d):
    s = supplier(spark, d)
    ra, dec = coords.survey_to_equatorial(coords.survey_lambda(), coords.survey_eta())
    lam, eta = coords.galactic_to_survey(*coords.galactic())
    return s.select("k", r(ra).alias("ra"), r(dec).alias("dec"), r(lam).alias("lambda"), r(eta).alias("eta"))


_AB = f"FROM {CUSTOMER} a JOIN {SUPPLIER} b ON a.k = b.k"


def _ab(spark, d):
    a, b = customer(spark, d), supplier(spark, d)
    names = lambda df, p: df.select("k", F.col("ra").alias(f"{p}_ra"), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    return names(a, "a").join(names(b, "b"), "k"), tuple(f"a{c}" for c in XYZ), tuple(f"b{c}" for c in XYZ)


_NORM = "sqrt(pow(a.uy * b.uz - a.uz * b.uy, 2) + pow(a.uz * b.ux - a.ux * b.uz, 2) + pow(a.ux * b.uy - a.uy * b.ux, 2))"


@query("b11_b12_l3_distance", f"""SELECT a.k AS k, {rs(f"degrees(atan2({_NORM}, {DOT}))")} AS angle, {rs(f"degrees(asin(sqrt(abs(1e0 - {DOT} * {DOT}))))")} AS folded, {rs(DOT)} AS dot,
  {rs("a.uy * b.uz - a.uz * b.uy")} AS cx, {rs("a.uz * b.ux - a.ux * b.uz")} AS cy, {rs("a.ux * b.uy - a.uy * b.ux")} AS cz {_AB}""")
def _(spark, d):
    df, a, b = _ab(spark, d)
    cx, cy, cz = coords.cross(a, b)
    return df.select("k", r(coords.angular_distance(a, b)).alias("angle"), r(coords.angular_distance(a, b, True)).alias("folded"), r(coords.dot(a, b)).alias("dot"), r(cx).alias("cx"), r(cy).alias("cy"), r(cz).alias("cz"))


_DRA = "radians(b.ra - a.ra)"
_PA = f"degrees(atan2(sin({_DRA}), sqrt(1e0 - a.uz * a.uz) * tan(asin(b.uz)) - a.uz * cos({_DRA})))"


@query("b13_l4_position_angle", f"SELECT a.k AS k, {rs(f'CASE WHEN {_PA} > 1e-15 THEN {_PA} ELSE {_PA} + 360e0 END')} AS angle {_AB}")
def _(spark, d):
    df, _, _ = _ab(spark, d)
    return df.select("k", r(coords.position_angle("a_ra", coords.declination("auz"), "b_ra", coords.declination("buz"))).alias("angle"))


def _rot(i: int) -> str:
    v, k = ["a.ux", "a.uy", "a.uz"], ["b.ux", "b.uy", "b.uz"]
    j, m = (i + 1) % 3, (i + 2) % 3
    return f"{v[i]} * cos(radians(-25e0)) + ({k[j]} * {v[m]} - {k[m]} * {v[j]}) * sin(radians(-25e0)) + {k[i]} * (a.ux * b.ux + a.uy * b.uy + a.uz * b.uz) * (1e0 - cos(radians(-25e0)))"


@query("b14_rotate", f"SELECT a.k AS k, {rs(_rot(0))} AS x, {rs(_rot(1))} AS y, {rs(_rot(2))} AS z {_AB}")
def _(spark, d):
    df, a, b = _ab(spark, d)
    x, y, z = coords.rotate(a, b, F.lit(25.0))
    return df.select("k", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"))


@query("b15_b34_stretch", f"""SELECT k, {rs("1e0 + q * (0.000192312e0 - q * (1.82764e-08 + 1.28162e-11 * q))", 9)} AS stretch, weight < 5000e0 - 1e-15 AS below, weight >= 5000e0 - 1e-15 AS atleast
  FROM (SELECT *, pow(degrees(asin(uz)), 2) AS q FROM {CUSTOMER})""")
def _(spark, d):
    return customer(spark, d).select("k", r(coords.longitude_stretch(coords.declination()), 9).alias("stretch"), coords.lt("weight", F.lit(5000.0)).alias("below"), coords.ge("weight", F.lit(5000.0)).alias("atleast"))


_DC = "(3000e0 / 0.705e0 * redshift / sqrt(1e0 + 1.718e0 * 0.2736e0 * redshift + 0.315e0 * sqrt(0.2736e0) * redshift * redshift))"


@query("b17_b18_l26_cosmology", f"""SELECT k, {rs(_DC)} AS comoving, {rs(f"{_DC} / (1e0 + redshift)")} AS diameter, {rs(f"{_DC} * (1e0 + redshift)")} AS luminosity,
  {rs(f"radians(0.5e0) * {_DC} / (1e0 + redshift)")} AS projected, {rs(f"degrees(10e0 / ({_DC} / (1e0 + redshift)))", 9)} AS angle FROM {PART}""")
def _(spark, d):
    c, z = Cosmology(), F.col("redshift")
    return part(spark, d).select("k", r(c.comoving_distance(z)).alias("comoving"), r(c.angular_diameter_distance(z)).alias("diameter"), r(c.luminosity_distance(z)).alias("luminosity"), r(c.projected_distance(z, F.lit(0.5))).alias("projected"), r(c.projected_angle(z, F.lit(10.0)), 9).alias("angle"))


@query("l1_l2_ecliptic", f"""SELECT k, {rs("((degrees(atan2(sin(radians(ra)) * c * cos(e) + uz * sin(e), cos(radians(ra)) * c)) % 360e0) + 360e0) % 360e0")} AS lon, {rs("degrees(asin(uz * cos(e) - c * sin(e) * sin(radians(ra))))")} AS lat
  FROM (SELECT *, sqrt(1e0 - uz * uz) AS c, radians(23.4392911e0) AS e FROM {SUPPLIER})""")
def _(spark, d):
    lon, lat = coords.ecliptic()
    return supplier(spark, d).select("k", r(lon).alias("lon"), r(lat).alias("lat"))


# Cells


@query("b19_cell_index", f"SELECT k, {x_sql(4)} AS x4, {y_sql(4)} AS y4, {x_sql(256)} AS x256, {y_sql(256)} AS y256, {x_sql(32768)} AS x32768, {y_sql(32768)} AS y32768 FROM {catalog_sql('lineitem', key='l_orderkey * 10 + l_linenumber', offset=99)}")
def _(spark, d):
    df = catalog(spark, d, "lineitem", key="l_orderkey * 10 + l_linenumber", offset=99)
    return df.select("k", *[e.alias(f"{n}{res}") for res in (4, 256, 32768) for n, e in (("x", cells.cell_x(res)), ("y", cells.cell_y(res)))])


_CELL = f"(SELECT k, {x_sql(64)} AS x, {y_sql(64)} AS y FROM {ORDERS})"


def _cell(spark, d):
    return cells.with_cell(orders(spark, d), 64).select("k", "x", "y")


@query("b20_b28_cell_geometry", f"""SELECT k, {rs(f"degrees(asin(1e0 - (y + 0.5e0) * {2 / 832!r}e0))")} AS lambda, {rs(f"CASE WHEN e >= 180e0 THEN e - 360e0 ELSE e END")} AS eta,
  {rs(f"degrees(asin(1e0 - (y + 1) * {2 / 832!r}e0))")} AS lambda_min, {rs(f"degrees(asin(1e0 - y * {2 / 832!r}e0))")} AS lambda_max
  FROM (SELECT *, (x + 0.5e0) * {360 / 2304!r}e0 + 91.25e0 AS e FROM {_CELL})""")
def _(spark, d):
    lam, eta = cells.center(64)
    b = cells.bounds(64)
    return _cell(spark, d).select("k", r(lam).alias("lambda"), r(eta).alias("eta"), r(b["lambda_min"]).alias("lambda_min"), r(b["lambda_max"]).alias("lambda_max"))


@query("b21_b25_b26_family", """SELECT k, 16::BIGINT AS n_children, ((x * 4) + (y * 4))::BIGINT AS low, ((x * 4 + 3) + (y * 4 + 3))::BIGINT AS high, xor(x, 1)::BIGINT AS sx, xor(y, 1)::BIGINT AS sy, x % 2 = 0 AND y % 2 = 0 AS first FROM """ + _CELL)
def _(spark, d):
    kids = cells.children(2)
    total = F.transform(kids, lambda c: c["x"] + c["y"])
    sib = cells.siblings()
    return _cell(spark, d).select("k", F.size(kids).cast("long").alias("n_children"), F.array_min(total).alias("low"), F.array_max(total).alias("high"), sib[2]["x"].alias("sx"), sib[2]["y"].alias("sy"), cells.is_first_sibling().alias("first"))


@query("b22_b24_index_numbers", f"""SELECT k, (2304 * y + x)::BIGINT AS pixnum, (144 * (y // 16) + x // 16)::BIGINT AS superpixnum, (16 * (y % 16) + x % 16)::BIGINT AS hpixnum, (x // 8)::BIGINT AS px, (y // 8)::BIGINT AS py, x AS bx, y AS by FROM {_CELL}""")
def _(spark, d):
    bx, by = cells.xy_of_hpix(64, cells.hpixnum(64), cells.superpixnum(64))
    return _cell(spark, d).select("k", cells.pixnum(64).alias("pixnum"), cells.superpixnum(64).alias("superpixnum"), cells.hpixnum(64).alias("hpixnum"), cells.parent("x", 3).alias("px"), cells.parent("y", 3).alias("py"), bx.cast("long").alias("bx"), by.cast("long").alias("by"))


_STRIPE = "CAST(trunc((eta + 32.5e0) / 0.15625e0) AS BIGINT) + 10"


@query("b27_b29_stripes", f"""SELECT stripe, count(*) AS n, {rs(f"count(*) * {cells.cell_area(64)!r}e0")} AS area FROM (
  SELECT CASE WHEN s < 0 THEN s + 2304 ELSE s END AS stripe FROM (
    SELECT f + CASE WHEN eta < 0.15625e0 * (f - 10) - 32.5e0 - 0.078125e0 + 1e-7 THEN 1 ELSE 0 END + CASE WHEN eta > 0.15625e0 * (f - 10) - 32.5e0 + 0.078125e0 - 1e-7 THEN 1 ELSE 0 END AS s
    FROM (SELECT *, {_STRIPE} AS f FROM (SELECT *, CASE WHEN e >= 180e0 THEN e - 360e0 ELSE e END AS eta FROM (SELECT *, (x + 0.5e0) * 0.15625e0 + 91.25e0 AS e FROM {_CELL}))))) GROUP BY stripe""")
def _(spark, d):
    return _cell(spark, d).withColumn("stripe", cells.stripe(64)).groupBy("stripe").agg(F.count("*").alias("n"), r(F.count("*") * cells.cell_area(64)).alias("area"))


@query("b33_m13_m14_text", """SELECT event_id, list_filter(string_split_regex(props, '[{}":, ]'), lambda x: x <> '') AS tokens, lower(hex(event_id)) AS hex, len(string_split(event_type, '_'))::INTEGER AS n FROM events""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", text.tokenize("props", '{}":, ').alias("tokens"), text.to_hex("event_id").alias("hex"), F.size(text.split_keep_empty("event_type", "_")).alias("n"))


# Predicates and shapes

_DEC = "degrees(asin(uz))"


@query("c2_c11_c15_shapes", f"""SELECT k, sx >= cos(radians(40e0)) AS circle, sx >= cos(radians(60e0)) AND sx <= cos(radians(20e0)) AS annulus, {_DEC} BETWEEN -30e0 AND 45e0 AS latitude, ra BETWEEN 100e0 AND 250e0 AS longitude,
  ra >= 300e0 OR ra <= 30e0 AS wrapped, {_DEC} BETWEEN -30e0 AND 45e0 AND ra BETWEEN 100e0 AND 250e0 AS box
  FROM (SELECT *, ux * cos(radians(105e0)) * cos(radians(10e0)) + uy * sin(radians(105e0)) * cos(radians(10e0)) + uz * sin(radians(10e0)) AS sx FROM {ORDERS})""")
def _(spark, d):
    shapes = {"circle": bounds.Circle(200, 10, 40), "annulus": bounds.Annulus(200, 10, 20, 60), "latitude": bounds.LatitudeBand(-30, 45), "longitude": bounds.LongitudeBand(100, 250), "wrapped": bounds.LongitudeBand(300, 30), "box": bounds.LatLonBox(-30, 45, 100, 250)}
    return orders(spark, d).select("k", *[b.contains().alias(n) for n, b in shapes.items()])


_SQUARE = bounds.ConvexPolygon(((180, -20), (220, -20), (220, 20), (180, 20)))
_HOLE = ((195.0, -5.0), (205.0, -5.0), (205.0, 5.0), (195.0, 5.0))


def _inside_sql(shape) -> str:
    return " AND ".join(f"ux * ({x!r})::DOUBLE + uy * ({y!r})::DOUBLE + uz * ({z!r})::DOUBLE >= -1e-15" for x, y, z in shape._planes())


@query("c11_l13_polygons", f"SELECT k, convex, convex AND NOT hole AS ring FROM (SELECT k, {_inside_sql(_SQUARE)} AS convex, {_inside_sql(bounds.ConvexPolygon(_HOLE))} AS hole FROM {ORDERS})")
def _(spark, d):
    ring = bounds.LoopPolygon((_SQUARE.vertices, _HOLE), (20.0, 80.0))
    return orders(spark, d).select("k", _SQUARE.contains().alias("convex"), ring.contains().alias("ring"))


@query("c3_c6_annulus_bins", f"""SELECT bin, count(*) AS n FROM (SELECT CASE WHEN t < 10e0 THEN 0 WHEN t < 20e0 THEN 1 WHEN t < 40e0 THEN 2 ELSE 3 END AS bin FROM (
  SELECT degrees(acos(greatest(-1e0, least(1e0, ux * cos(radians(105e0)) + uy * sin(radians(105e0)))))) AS t FROM {ORDERS}) WHERE t < 80e0) GROUP BY bin""")
def _(spark, d):
    at = bounds._lit(bounds._unit(200.0, 0.0, "equatorial"))
    return orders(spark, d).withColumn("bin", correlation.Bins((0.0, 10.0, 20.0, 40.0, 80.0), (0,) * 4).number(coords.angular_distance(XYZ, at))).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


_LOC = f"""(SELECT p.k, p.weight, coalesce(n.weight, m.weight) AS map_weight FROM (SELECT *, {x_sql(8)} AS x, {y_sql(8)} AS y FROM {ORDERS}) p
  LEFT JOIN {sky_map_sql('m')} m ON p.x = m.x AND p.y = m.y LEFT JOIN {sky_map_sql('n')} n ON p.x // 2 = n.x AND p.y // 2 = n.y)"""


@query("c7_e1_point_in_map", f"SELECT k, map_weight FROM {_LOC}")
def _(spark, d):
    both = sky_map(spark, "m").unionByName(sky_map(spark, "n"))
    return area_map.find_location(orders(spark, d), both, 3).select("k", "map_weight")


@query("c8_e2_e3_status", f"""SELECT n.x, n.y, {rs("coalesce(u, 0e0)")} AS unmasked, {rs("mw")} AS mean_weight, CASE WHEN coalesce(u, 0e0) > 1 - 1e-9 THEN 1 WHEN coalesce(u, 0e0) > 0 THEN -1 ELSE 0 END AS status
  FROM {sky_map_sql('n')} n LEFT JOIN (SELECT x // 2 AS x, y // 2 AS y, count(*) / 4e0 AS u, avg(weight) AS mw FROM {sky_map_sql('m')} GROUP BY ALL) f ON n.x = f.x AND n.y = f.y""")
def _(spark, d):
    s = area_map.status(sky_map(spark, "n"), sky_map(spark, "m"))
    return s.select("x", "y", r(F.col("unmasked")).alias("unmasked"), r(F.col("mean_weight")).alias("mean_weight"), "status")


@query("c9_f7_weights", f"SELECT x, y, {rs('CASE WHEN abs(weight * 2e0 - 1e0) < 1e-15 THEN 0e0 ELSE 1e0 / (weight * 2e0 - 1e0) END')} AS weight FROM {sky_map_sql('m')} WHERE weight BETWEEN 2e0 AND 3e0")
def _(spark, d):
    a = area_map.invert_weight(area_map.add_constant_weight(area_map.scale_weight(area_map.weight_range(sky_map(spark, "m"), 2.0, 3.0), 2.0), -1.0))
    return a.select("x", "y", r(F.col("weight")).alias("weight"))


# Joins of catalogs


@query("e4_pair_counts", f"SELECT a.k, count(b.k) AS n_pairs FROM {SUPPLIER} a LEFT JOIN {CUSTOMER} b ON {DOT} > cos(radians(5e0)) + 1e-15 GROUP BY a.k")
def _(spark, d):
    return points.count_pairs(supplier(spark, d).select("k", *XYZ), customer(spark, d).select(F.col("k").alias("ck"), *XYZ), ["k"], 5.0)


@query("e5_weighted_pairs", f"SELECT a.k, count(b.k) AS n_pairs, {rs('sum(b.weight)', 2)} AS tree_weight, {rs('sum(a.weight * b.weight)', 2)} AS both FROM {SUPPLIER} a LEFT JOIN {ORDERS} b ON {DOT} > cos(radians(4e0)) + 1e-15 AND {DOT} <= cos(radians(1e0)) + 1e-15 GROUP BY a.k")
def _(spark, d):
    a = supplier(spark, d).select("k", F.col("weight").alias("wa"), *XYZ)
    out = points.weigh_pairs(a, orders(spark, d).select("weight", *XYZ), ["k"], 4.0, 1.0, "wa")
    return out.select("k", "n_pairs", r(F.col("weight"), 2).alias("tree_weight"), r(F.col("product"), 2).alias("both"))


_EDGES = (0.5, 1.0, 2.0, 5.0, 10.0)
_BIN = "CASE " + " ".join(f"WHEN {DOT} <= cos(radians({a}e0)) + 1e-15 AND {DOT} > cos(radians({b}e0)) + 1e-15 THEN {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END"


@query("e5_l19_binned_pairs", f"SELECT bin, count(*) AS n_pairs, {rs('sum(w) / 1e6', 2)} AS weight FROM (SELECT {_BIN} AS bin, a.weight * b.weight AS w FROM {CUSTOMER} a, {ORDERS} b) WHERE bin IS NOT NULL GROUP BY bin")
def _(spark, d):
    out = blocks.binned_pairs(customer(spark, d), orders(spark, d), list(_EDGES))
    # In millions: sums of 1e14 in doubles are good to a few units.
    return out.select("bin", "n_pairs", r(F.col("weight") / 1e6, 2).alias("weight"))


def _region_sql(alias: str) -> str:
    return f"(CASE WHEN {y_sql(4)} < 26 THEN 0 ELSE 4 END + {x_sql(4)} // 36)::INTEGER"


def _with_region(df):
    """Eight blocks of 36 columns and 26 rows at resolution 4."""
    return cells.with_cell(df, 4, ("_rx", "_ry")).withColumn("region", (F.when(F.col("_ry") < 26, 0).otherwise(4) + F.floor(F.col("_rx") / 36)).cast("int")).drop("_rx", "_ry")


@query("e6_region_pairs", f"""SELECT bin, region_a, region_b, count(*) AS n_pairs FROM (SELECT {_BIN} AS bin, a.region AS region_a, b.region AS region_b
  FROM (SELECT *, {_region_sql('')} AS region FROM {SUPPLIER}) a, (SELECT *, {_region_sql('')} AS region FROM {ORDERS}) b) WHERE bin IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    one = F.lit(1.0)  # only the number of pairs is asked for
    out = blocks.binned_pairs(_with_region(supplier(spark, d).withColumn("weight", one)), _with_region(orders(spark, d).withColumn("weight", one)), list(_EDGES), regions=True)
    return out.select("bin", "region_a", "region_b", "n_pairs")


@query("e7_neighbour_lists", f"SELECT a.k, b.k AS ck, {rs(f'degrees(atan2({_NORM}, {DOT}))')} AS separation FROM {SUPPLIER} a JOIN {CUSTOMER} b ON {DOT} > cos(radians(3e0)) + 1e-15")
def _(spark, d):
    out = points.pairs(supplier(spark, d).select("k", *XYZ), customer(spark, d).select(F.col("k").alias("ck"), *XYZ), 3.0, separation=True)
    return out.select("k", "ck", r(F.col("separation")).alias("separation"))


@query("e8_e10_l20_k_nearest", f"""SELECT k, rank::INTEGER AS rank, sk, {rs("separation")} AS separation FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY separation, sk) AS rank FROM (
  SELECT a.k, b.k AS sk, round(degrees(atan2({_NORM}, {DOT})), 9) AS separation FROM {CUSTOMER} a, {SUPPLIER} b)) WHERE rank <= 3""")
def _(spark, d):
    out = points.k_nearest(customer(spark, d).select("k", *XYZ), supplier(spark, d).select(F.col("k").alias("sk"), *XYZ), ["k"], "sk", 3)
    return out.select("k", "rank", "sk", r(F.col("separation")).alias("separation"))


@query("e9_closest_match", f"""SELECT c.k, coalesce(m.sk, -1) AS sk, {rs("m.separation")} AS separation FROM {CUSTOMER} c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY separation, sk) AS n FROM (
  SELECT a.k, b.k AS sk, round(degrees(atan2({_NORM}, {DOT})), 12) AS separation FROM {CUSTOMER} a JOIN {SUPPLIER} b ON {DOT} >= cos(radians(4e0)) - 1e-15)) WHERE n = 1) m ON c.k = m.k""")
def _(spark, d):
    out = points.closest_match(customer(spark, d).select("k", *XYZ), supplier(spark, d).select(F.col("k").alias("sk"), *XYZ), ["k"], "sk", 4.0)
    return out.select("k", F.coalesce("sk", F.lit(-1)).alias("sk"), r(F.col("separation")).alias("separation"))


@query("e11_l21_points_in_cells", f"""SELECT m.x, m.y, count(p.k) AS n_points, {rs("coalesce(sum(p.weight), 0e0)", 2)} AS weight FROM {sky_map_sql('n')} m LEFT JOIN (SELECT *, {x_sql(4)} AS x, {y_sql(4)} AS y FROM {ORDERS}) p ON m.x = p.x AND m.y = p.y GROUP BY m.x, m.y""")
def _(spark, d):
    out = points.within_cells(orders(spark, d), sky_map(spark, "n").select("x", "y"), 4, F.col("weight"))
    return out.select("x", "y", "n_points", r(F.col("weight"), 2).alias("weight"))


@query("g11_g12_tree_summary", f"SELECT count(*) AS base_nodes, sum(n)::BIGINT AS n_points, {rs('sum(w)', 0)} AS weight, {rs(f'count(*) * {cells.cell_area(8)!r}e0')} AS area FROM (SELECT {x_sql(8)} AS x, {y_sql(8)} AS y, count(*) AS n, sum(weight) AS w FROM {ORDERS} GROUP BY ALL)")
def _(spark, d):
    t = points.tree_summary(orders(spark, d), 8)
    return t.select("base_nodes", "n_points", r(F.col("weight"), 0).alias("weight"), r(F.col("area")).alias("area"))


_AD = f"({_DC} / (1e0 + redshift))"


@query("g24_radial_pairs", f"""SELECT bin, count(*) AS n_pairs FROM (SELECT CASE WHEN r < 20e0 THEN 0 WHEN r < 50e0 THEN 1 WHEN r < 100e0 THEN 2 END AS bin FROM (
  SELECT radians(degrees(atan2({_NORM}, {DOT}))) * a.ad AS r FROM (SELECT *, {_AD} AS ad FROM {PART}) a, {CUSTOMER} b) WHERE r >= 5e0 AND r < 100e0) GROUP BY bin""")
def _(spark, d):
    return points.projected_pairs(part(spark, d).select("k", "redshift", *XYZ), customer(spark, d).select(F.col("k").alias("ck"), *XYZ), Cosmology(), "redshift", [5.0, 20.0, 50.0, 100.0])


@query("x12_own_radius", f"SELECT a.k, count(b.k) AS n_pairs FROM {PART} a LEFT JOIN {ORDERS} b ON {DOT} > cos(least(radians(1.5e0), 30e0 / {_AD.replace('redshift', 'a.redshift')})) + 1e-15 GROUP BY a.k")
def _(spark, d):
    a = part(spark, d).select("k", "redshift", *XYZ)
    return points.count_within(a, orders(spark, d).select(*XYZ), ["k"], Cosmology().projected_angle("redshift", F.lit(30.0)), 1.5)


# Maps

_M8, _N8 = fine_sql("m"), fine_sql("n")


@query("f1_g1_union", f"SELECT x, y FROM (SELECT x, y FROM {_M8} UNION SELECT x, y FROM {_N8})")
def _(spark, d):
    return area_map.expand(area_map.ingest(sky_map(spark, "m"), sky_map(spark, "n")), 3).select("x", "y")


@query("f2_l15_intersection", f"SELECT m.x, m.y, m.weight FROM {_M8} m JOIN {_N8} n ON m.x = n.x AND m.y = n.y")
def _(spark, d):
    return area_map.intersect(sky_map(spark, "m"), sky_map(spark, "n")).select("x", "y", "weight")


@query("f3_difference", f"SELECT n.x, n.y, n.weight FROM {_N8} n ANTI JOIN {_M8} m ON m.x = n.x AND m.y = n.y")
def _(spark, d):
    return area_map.expand(area_map.exclude(sky_map(spark, "n"), sky_map(spark, "m")), 3)


@query("f4_imprint", f"SELECT m.x, m.y, n.weight FROM {_M8} m JOIN {_N8} n ON m.x = n.x AND m.y = n.y")
def _(spark, d):
    return area_map.imprint(sky_map(spark, "m"), sky_map(spark, "n")).select("x", "y", "weight")


@query("f5_add", f"SELECT coalesce(m.x, n.x) AS x, coalesce(m.y, n.y) AS y, coalesce(m.weight, 0e0) + coalesce(n.weight, 0e0) AS weight FROM {_M8} m FULL JOIN {_N8} n ON m.x = n.x AND m.y = n.y")
def _(spark, d):
    return area_map.expand(area_map.add(sky_map(spark, "m"), sky_map(spark, "n"), drop_single=False), 3)


@query("f6_multiply", f"SELECT m.x, m.y, m.weight * n.weight AS weight FROM {_M8} m JOIN {_N8} n ON m.x = n.x AND m.y = n.y")
def _(spark, d):
    return area_map.multiply(sky_map(spark, "m"), sky_map(spark, "n")).select("x", "y", "weight")


@query("f8_one_region", f"SELECT x, y, weight FROM {sky_map_sql('m')} WHERE (CASE WHEN y // 2 < 26 THEN 0 ELSE 4 END + (x // 2) // 36) <> 3")
def _(spark, d):
    at = (F.when(F.floor(F.col("y") / 2) < 26, 0).otherwise(4) + F.floor(F.floor(F.col("x") / 2) / 36)).cast("int")
    return sky_map(spark, "m").where(at != 3).select("x", "y", "weight")


@query("g2_map_summary", f"SELECT count(*) AS size, {rs(f'count(*) * {cells.cell_area(8)!r}e0')} AS area, min(level) AS min_level, max(level) AS max_level, min(weight) AS min_weight, max(weight) AS max_weight, {rs('avg(weight)')} AS mean_weight FROM {sky_map_sql('m')}")
def _(spark, d):
    s = area_map.summary(sky_map(spark, "m"))
    return s.withColumns({"area": r(F.col("area")), "mean_weight": r(F.col("mean_weight"))})


@query("g2_rollup", f"SELECT coalesce(superpixel, -1) AS superpixel, count(*) AS size, {rs(f'count(*) * {cells.cell_area(8)!r}e0')} AS area FROM (SELECT 144 * (y // 2) + x // 2 AS superpixel FROM {sky_map_sql('m')}) GROUP BY ROLLUP (superpixel)")
def _(spark, d):
    s = area_map.by_superpixel(sky_map(spark, "m"))
    return s.withColumns({"superpixel": F.coalesce("superpixel", F.lit(-1)), "area": r(F.col("area"))})


@query("d5_coverage", f"SELECT x // 2 AS x, y // 2 AS y, count(*) / 4e0 AS weight FROM {_M8} GROUP BY ALL")
def _(spark, d):
    return area_map.coverage(sky_map(spark, "m"), 2).select("x", "y", "weight")


@query("d8_l16_soften", f"SELECT x // 2 AS x, y // 2 AS y, {rs('avg(weight)')} AS weight FROM {_M8} GROUP BY ALL")
def _(spark, d):
    return area_map.soften(sky_map(spark, "m"), 2).select("x", "y", r(F.col("weight")).alias("weight"))


@query("d7_footprint", f"SELECT DISTINCT {x_sql(16)} AS x, {y_sql(16)} AS y FROM {CUSTOMER}")
def _(spark, d):
    return points.footprint(customer(spark, d), 16).select("x", "y")


@query("d1_cells_within", f"""SELECT s.k, count(*) AS n FROM {SUPPLIER} s, (SELECT {center_sql(8)} FROM (SELECT i % 288 AS x, i // 288 AS y FROM range({288 * 104}) t(i))) c
  WHERE s.ux * c.ux + s.uy * c.uy + s.uz * c.uz > cos(radians(6e0)) + 1e-15 GROUP BY s.k""")
def _(spark, d):
    near = cells.cover(supplier(spark, d), 8, 6.0)
    return near.where(coords.dot(XYZ, cells.center_xyz(8, "cx", "cy")) > math.cos(math.radians(6.0)) + 1e-15).groupBy("k").agg(F.count("*").alias("n"))


@query("d4_pixelize")
def _(spark, d):
    p = area_map.pixelize(spark, bounds.Circle(200, 10, 5), 7)
    return p.groupBy("level").agg(F.count("*").alias("n"), r(F.sum(cells.level_area(F.col("level")))).alias("area"))


@query("h1_regions")
def _(spark, d):
    cov = area_map.coverage(sky_map(spark, "n"), 2)
    return regions.region_areas(regions.regionate(cov, 4, 10))


@query("e14_h4_find_region", f"SELECT k, {_region_sql('')} AS region FROM {ORDERS}")
def _(spark, d):
    every = spark.range(144 * 52).select((F.col("id") % 144).alias("x"), F.floor(F.col("id") / 144).cast("long").alias("y"))
    blocks = every.withColumn("region", (F.when(F.col("y") < 26, 0).otherwise(4) + F.floor(F.col("x") / 36)).cast("int"))
    return regions.find_region(orders(spark, d), blocks, 4).select("k", "region")


# Fields

_FIELD = f"""(SELECT m.x, m.y, 1e0 AS unmasked, coalesce(i, 0e0) AS intensity, coalesce(n, 0) AS n_points FROM {sky_map_sql('m')} m
  LEFT JOIN (SELECT {x_sql(8)} AS x, {y_sql(8)} AS y, sum(weight) AS i, count(*) AS n FROM {ORDERS} GROUP BY ALL) p ON m.x = p.x AND m.y = p.y)"""


def field(spark, d):
    return field_map.from_points(orders(spark, d), sky_map(spark, "m"), 3, F.col("weight"))


@query("g3_field_from_points", f"SELECT x, y, unmasked, {rs('intensity', 2)} AS intensity, n_points FROM {_FIELD}")
def _(spark, d):
    return field(spark, d).withColumn("intensity", r(F.col("intensity"), 2))


@query("g4_g5_resample", f"SELECT x // 2 AS x, y // 2 AS y, count(*) / 4e0 AS unmasked, {rs('sum(intensity)', 2)} AS intensity, sum(n_points)::BIGINT AS n_points, {rs(f'sum(intensity) / (count(*) / 4e0 * {cells.cell_area(4)!r}e0)', 2)} AS density FROM {_FIELD} GROUP BY ALL")
def _(spark, d):
    f = field_map.densities(field_map.resample(field(spark, d), "density", 3, 2), 4)
    return f.select("x", "y", "unmasked", r(F.col("intensity"), 2).alias("intensity"), "n_points", r(F.col("density"), 2).alias("density"))


_CA = f"{cells.cell_area(8)!r}e0"


@query("g6_g8_field_means", f"""SELECT {rs("sum(intensity * unmasked) / sum(unmasked)", 3)} AS scalar, {rs(f"avg(intensity / ({_CA} * unmasked))", 3)} AS density, {rs("sum(CASE WHEN n_points > 0 THEN intensity / n_points ELSE 0e0 END * unmasked) / sum(unmasked)", 3)} AS sampled,
  count(*) AS size, sum(n_points)::BIGINT AS n_points FROM {_FIELD}""")
def _(spark, d):
    f = field(spark, d)
    out = field_map.totals(f, 8).select("size", "n_points")
    for kind in field_map.KINDS:
        out = out.crossJoin(field_map.mean(f, kind, 8).select(r(F.col("mean"), 3).alias(kind)))
    return out


_DENSITY = f"(SELECT *, (intensity - e) / e AS delta FROM (SELECT *, avg(intensity / ({_CA} * unmasked)) OVER () * unmasked * {_CA} AS e FROM {_FIELD}))"


@query("b32_g7_over_density", f"SELECT x, y, {rs('delta')} AS intensity FROM {_DENSITY}")
def _(spark, d):
    f = field_map.over_density(field(spark, d), "density", 8)
    return f.select("x", "y", r(F.col("intensity")).alias("intensity"))


@query("g9_e12_covariance", f"SELECT {rs('sum(delta * delta) / count(*)')} AS variance, {rs('sum(delta * delta) / count(*)')} AS covariance FROM {_DENSITY}")
def _(spark, d):
    f = field_map.over_density(field(spark, d), "density", 8)
    return f.agg(r(field_map.variance(f)).alias("variance")).crossJoin(field_map.covariance(f, f).select(r(F.col("covariance")).alias("covariance")))


@query("g10_errors_by_region", f"""SELECT {rs("avg(v)")} AS variance, {rs("sqrt(sum((v - m) * (v - m))) / count(*)")} AS error FROM (SELECT v, avg(v) OVER () AS m FROM (
  SELECT (CASE WHEN y // 2 < 26 THEN 0 ELSE 4 END + (x // 2) // 36) AS region, sum(delta * delta) / count(*) AS v FROM {_DENSITY} GROUP BY ALL))""")
def _(spark, d):
    f = field_map.over_density(field(spark, d), "density", 8)
    f = f.withColumn("region", (F.when(F.floor(F.col("y") / 2) < 26, 0).otherwise(4) + F.floor(F.floor(F.col("x") / 2) / 36)).cast("int"))
    per = f.groupBy("region").agg(field_map.variance(f).alias("variance"))
    out = field_map.with_errors(per, "variance")
    return out.select(r(F.col("variance")).alias("variance"), r(F.col("error")).alias("error"))


_F4 = f"(SELECT *, (intensity - e) / e AS delta, {center_sql(4)} FROM (SELECT *, avg(intensity / ({cells.cell_area(4)!r}e0 * unmasked)) OVER () * unmasked * {cells.cell_area(4)!r}e0 AS e FROM (SELECT x // 2 AS x, y // 2 AS y, count(*) / 4e0 AS unmasked, sum(intensity) AS intensity FROM {_FIELD} GROUP BY ALL)))"


@query("e13_l18_g22_pixel_correlation", f"""SELECT {rs("sum(a.delta * b.delta * a.unmasked * b.unmasked) / sum(a.unmasked * b.unmasked)")} AS wtheta, {rs("sum(a.unmasked * b.unmasked)")} AS pixel_weight, count(*) AS n_pairs
  FROM {_F4} a JOIN {_F4} b ON (b.y > a.y OR b.y = a.y AND b.x > a.x) AND {DOT} <= cos(radians(4e0)) + 1e-15 AND {DOT} > cos(radians(8e0)) + 1e-15""")
def _(spark, d):
    f = field_map.over_density(field_map.resample(field(spark, d), "density", 3, 2), "density", 4)
    c = field_map.correlate(f, None, 4, 4.0, 8.0)
    return c.select(r(F.col("pixel_wtheta") / F.col("pixel_weight")).alias("wtheta"), r(F.col("pixel_weight")).alias("pixel_weight"), "n_pairs")


@query("e15_p7_local_density", f"""SELECT s.k, {rs(f"coalesce(sum(c.unmasked), 0e0) * {_CA}")} AS local_area, {rs("coalesce(sum(c.intensity), 0e0)", 2)} AS local_intensity, {rs(f"sum(c.n_points) / (sum(c.unmasked) * {_CA})")} AS local_point_density
  FROM {SUPPLIER} s LEFT JOIN (SELECT *, {center_sql(8)} FROM {_FIELD}) c ON s.ux * c.ux + s.uy * c.uy + s.uz * c.uz > cos(radians(5e0)) + 1e-15 AND s.ux * c.ux + s.uy * c.uy + s.uz * c.uz <= cos(radians(1e0)) + 1e-15 GROUP BY s.k""")
def _(spark, d):
    n = field_map.neighbourhood(supplier(spark, d), field(spark, d), ["k"], 8, 5.0, 1.0)
    return n.select("k", r(F.col("local_area")).alias("local_area"), r(F.col("local_intensity"), 2).alias("local_intensity"), r(F.col("local_point_density")).alias("local_point_density"))


@query("g13_g14_histogram", f"""SELECT b.bin::INTEGER AS bin, count(v) AS n, {rs("coalesce(sum(w), 0e0)", 2)} AS weight, {rs("avg(v)", 4)} AS mean_value FROM range(10) b(bin)
  LEFT JOIN (SELECT l_quantity AS v, l_extendedprice AS w FROM lineitem) l ON l.v >= 0e0 + 60e0 * b.bin / 10 AND l.v < 0e0 + 60e0 * (b.bin + 1) / 10 GROUP BY b.bin""")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    h = correlation.histogram(li, F.col("l_quantity"), F.col("l_extendedprice"), correlation.Bins.linear(0.0, 60.0, 10))
    return h.select("bin", "n", r(F.col("weight"), 2).alias("weight"), r(F.col("mean_value"), 4).alias("mean_value"))


# Correlation functions

_LS = (2.0, 5.0, 10.0, 20.0)
_LSBIN = "CASE " + " ".join(f"WHEN {DOT} <= cos(radians({a}e0)) + 1e-15 AND {DOT} > cos(radians({b}e0)) + 1e-15 THEN {k}" for k, (a, b) in enumerate(zip(_LS, _LS[1:]))) + " END"
_GAL_C = f"(SELECT *, {_region_sql('')} AS region FROM {CUSTOMER})"
_RAN_C = f"(SELECT *, {_region_sql('')} AS region FROM {catalog_sql('part')})"
_COUNTS = "".join(f"{' UNION ALL ' if i else ''}SELECT bin, '{kind}' AS kind, ra_, rb_, count(*)::DOUBLE AS w FROM (SELECT {_LSBIN} AS bin, a.region AS ra_, b.region AS rb_ FROM {a} a, {b} b) WHERE bin IS NOT NULL GROUP BY ALL" for i, (kind, a, b) in enumerate((("DD", _GAL_C, _GAL_C), ("DR", _GAL_C, _RAN_C), ("RD", _RAN_C, _GAL_C), ("RR", _RAN_C, _RAN_C))))
_WIDE = ", ".join(f"sum(CASE WHEN kind = '{k}' THEN w ELSE 0e0 END) AS {k}" for k in ("DD", "DR", "RD", "RR"))


def _samples(spark, d, with_regions: bool = True):
    g = _with_region(customer(spark, d).withColumn("weight", F.lit(1.0)))
    n = _with_region(catalog(spark, d, "part").withColumn("weight", F.lit(1.0)))
    return g, n


BINS = correlation.Bins(_LS, (0,) * 3)


@query("g16_g17_g23_landy_szalay", f"SELECT bin, DD, DR, RD, RR, {rs('(DD - DR - RD + RR) / RR')} AS wtheta, {rs('1e0 / sqrt(DD)')} AS error FROM (SELECT bin, {_WIDE} FROM ({_COUNTS}) GROUP BY bin)")
def _(spark, d):
    g, n = _samples(spark, d)
    w = correlation.angular_correlation(correlation.pair_counts(g, n, BINS))
    return w.withColumns({"wtheta": r(F.col("wtheta")), "error": r(F.col("error"))})


_LOO = f"(SELECT bin, region, {_WIDE} FROM ({_COUNTS}) c, range(8) g(region) WHERE ra_ <> region AND rb_ <> region GROUP BY bin, region)"
_LOOW = f"(SELECT bin, region, (DD - DR - RD + RR) / RR AS w FROM {_LOO})"


def _leave_one_out(spark, d):
    g, n = _samples(spark, d)
    s = correlation.leave_one_out(correlation.pair_counts(g, n, BINS, regions=True), 8)
    return s.select("bin", "region", correlation.landy_szalay(F.col("DD"), F.col("DR"), F.col("RD"), F.col("RR")).alias("wtheta"))


@query("g18_leave_one_out", f"SELECT bin, region::INTEGER AS region, {rs('w')} AS wtheta FROM {_LOOW}")
def _(spark, d):
    return _leave_one_out(spark, d).withColumn("wtheta", r(F.col("wtheta")))


@query("g20_covariance", f"""SELECT a.bin AS bin_a, b.bin AS bin_b, {rs("49e0 / 64e0 * sum(a.d * b.d)", 9)} AS covariance FROM (SELECT *, w - avg(w) OVER (PARTITION BY bin) AS d FROM {_LOOW}) a
  JOIN (SELECT *, w - avg(w) OVER (PARTITION BY bin) AS d FROM {_LOOW}) b ON a.region = b.region GROUP BY ALL""")
def _(spark, d):
    c = correlation.covariance(_leave_one_out(spark, d))
    return c.withColumn("covariance", r(F.col("covariance"), 9))


@query("p5_g19_g21_jackknife", f"SELECT bin, {rs('m')} AS wtheta, {rs('7e0 / 8e0 * sqrt(sum((w - m) * (w - m)))')} AS error FROM (SELECT *, avg(w) OVER (PARTITION BY bin) AS m FROM {_LOOW}) GROUP BY bin, m")
def flagship(spark, sf_dir: str) -> DataFrame:
    """Auto-correlation of `customer` positions with `part` positions as randoms, and its leave-one-region-out error."""
    g, n = _samples(spark, sf_dir)
    return correlation.auto_correlation(g, n, BINS, n_regions=8).select("bin", r(F.col("wtheta")).alias("wtheta"), r(F.col("error")).alias("error"))


@query("x3_weighted_cross", f"SELECT bin, count(*) AS n_pairs, {rs('avg(w)', 2)} AS mean FROM (SELECT {_LSBIN} AS bin, a.weight * b.weight AS w FROM {CUSTOMER} a, {SUPPLIER} b) WHERE bin IS NOT NULL GROUP BY bin")
def _(spark, d):
    w = correlation.weighted_cross_correlation(customer(spark, d), supplier(spark, d), BINS)
    return w.select("bin", "n_pairs", r(F.col("mean"), 2).alias("mean"))


@query("j1_j2_random_points")
def _(spark, d):
    p = random_points.over_map(sky_map(spark, "n"), 5000, seed=11)
    return area_map.find_location(p, sky_map(spark, "n"), 2).select("id", *[r(F.col(c), 9).alias(c) for c in XYZ], "map_weight")


# Pipelines


@query("p1_occupied_map", f"SELECT m.x, m.y, m.weight FROM {sky_map_sql('m')} m SEMI JOIN (SELECT {x_sql(8)} AS x, {y_sql(8)} AS y FROM {ORDERS}) p ON m.x = p.x AND m.y = p.y")
def _(spark, d):
    occupied = field(spark, d).where("n_points > 0").select(F.lit(3).alias("level"), "x", "y", F.lit(1.0).alias("weight"))
    return area_map.intersect(sky_map(spark, "m"), occupied).select("x", "y", "weight")


@query("p3_combine_maps", f"SELECT count(*) AS n, {rs('sum(weight)')} AS weight FROM (SELECT x // 2 AS x, y // 2 AS y, avg(weight) AS weight FROM (SELECT m.* FROM {_M8} m SEMI JOIN {_N8} n ON m.x = n.x AND m.y = n.y) WHERE weight >= 2e0 GROUP BY ALL)")
def _(spark, d):
    both = area_map.weight_range(area_map.intersect(sky_map(spark, "m"), sky_map(spark, "n")), 2.0)
    return area_map.soften(both, 2).agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query("p9_stripe_filter", f"""SELECT x, y, weight FROM (SELECT *, CASE WHEN e >= 180e0 THEN e - 360e0 ELSE e END AS eta FROM (SELECT *, (x + 0.5e0) * 1.25e0 + 91.25e0 AS e FROM {sky_map_sql('m')})) WHERE eta > 0e0 AND eta < 40e0""")
def _(spark, d):
    eta = cells.edge_eta(8, F.col("x") + 0.5)
    strip = spark.range(288).select(F.col("id").alias("x")).where((eta > 0.0) & (eta < 40.0)).select(cells.stripe(8).alias("stripe")).distinct()
    return sky_map(spark, "m").withColumn("stripe", cells.stripe(8)).join(strip, "stripe", "left_semi").select("x", "y", "weight")


@query("p11_density_histogram", f"""SELECT bin, n, {rs("area")} AS area, {rs("sum(area) OVER (ORDER BY bin)")} AS upto FROM (SELECT n_points::INTEGER AS bin, count(*) AS n, count(*) * {_CA} AS area FROM {_FIELD} GROUP BY ALL)""")
def _(spark, d):
    from pyspark.sql import Window

    per = field(spark, d).groupBy(F.col("n_points").cast("int").alias("bin")).agg(F.count("*").alias("n"), (F.sum("unmasked") * cells.cell_area(8)).alias("area"))
    return per.select("bin", "n", r(F.col("area")).alias("area"), r(F.sum("area").over(Window.orderBy("bin"))).alias("upto"))  # as many rows as different counts


@query("p12_p13_systematics", f"""SELECT m.x, m.y, {rs("avg(p.redshift)")} AS seeing, {rs("avg(p.weight)", 3)} AS extinction, count(*) AS n_objects FROM {sky_map_sql('n')} m JOIN (SELECT *, {x_sql(4)} AS x, {y_sql(4)} AS y FROM {PART}) p ON m.x = p.x AND m.y = p.y
  GROUP BY m.x, m.y HAVING avg(p.redshift) BETWEEN 0.3e0 AND 0.8e0""")
def _(spark, d):
    per = cells.with_cell(part(spark, d), 4).groupBy("x", "y").agg(F.avg("redshift").alias("seeing"), F.avg("weight").alias("extinction"), F.count("*").alias("n_objects"))
    out = sky_map(spark, "n").select("x", "y").join(per, ["x", "y"]).where(F.col("seeing").between(0.3, 0.8))
    return out.select("x", "y", r(F.col("seeing")).alias("seeing"), r(F.col("extinction"), 3).alias("extinction"), "n_objects")


@query("p10_systematics_cross", f"""SELECT {rs("sum(a.delta * b.delta) / count(*)")} AS wtheta, count(*) AS n_pairs FROM {_DENSITY.replace('AS delta', f'AS delta, {center_sql(8)}')} a
  JOIN (SELECT weight - avg(weight) OVER () AS delta, {center_sql(8)} FROM {sky_map_sql('m')}) b ON {DOT} <= cos(radians(2e0)) + 1e-15 AND {DOT} > cos(radians(3e0)) + 1e-15""")
def _(spark, d):
    a = field_map.over_density(field(spark, d), "density", 8)
    b = sky_map(spark, "m").select("x", "y", F.lit(1.0).alias("unmasked"), F.col("weight").alias("intensity"), F.lit(1).alias("n_points"))
    c = field_map.correlate(a, field_map.over_density(b, "scalar", 8), 8, 2.0, 3.0)
    return c.select(r(F.col("pixel_wtheta") / F.col("pixel_weight")).alias("wtheta"), "n_pairs")


@query("l5_l6_hilbert_cells")
def _(spark, d):
    from celestrum.functions import hcells

    c = customer(spark, d).select("k", hcells.leaf_id("ra", coords.declination()).alias("leaf"))
    return c.select("k", hcells.token(hcells.parent("leaf", 12)).alias("token"), hcells.level_of(hcells.parent("leaf", 12)).alias("level"))


@query("l15_hilbert_union")
def _(spark, d):
    from celestrum.functions import hcells

    c = orders(spark, d).select(hcells.leaf_id("ra", coords.declination()).alias("leaf"))
    return hcells.normalize(c.select(hcells.parent("leaf", 3).alias("cell"))).select(hcells.token("cell").alias("token"))


@query("l10_l14_covering_search", f"SELECT k FROM {ORDERS} WHERE ux * cos(radians(105e0)) + uy * sin(radians(105e0)) >= cos(radians(7e0)) - 1e-15")
def _(spark, d):
    from celestrum.functions import hcells

    # Longitude 200 degrees on the equator; the covering is the coarse filter, the circle decides.
    ids = hcells.covering((math.cos(math.radians(200)), math.sin(math.radians(200)), 0.0), 7.0, 5)
    cover = spark.createDataFrame([(int(c),) for c in ids], "cell long")
    c = orders(spark, d).withColumn("leaf", hcells.leaf_id("ra", coords.declination()))
    return hcells.locate(c, cover, levels=[5]).where(bounds.Circle(200, 0, 7).contains()).select("k")


@query("d6_covering", f"SELECT DISTINCT x // 2 AS x, y // 2 AS y FROM {sky_map_sql('m')}")
def _(spark, d):
    return area_map.covering(sky_map(spark, "m"), 8000).select("x", "y")


@query("c12_pixel_scores", f"""SELECT x, y, (SELECT count(*) FROM (VALUES (0.5e0, 0.5e0), (0.25e0, 0.25e0), (0.75e0, 0.25e0), (0.25e0, 0.75e0), (0.75e0, 0.75e0)) p(dx, dy) WHERE degrees(asin(1e0 - (y + dy) * {2 / 52!r}e0)) BETWEEN -10e0 AND 35e0) AS held FROM {sky_map_sql('n')}""")
def _(spark, d):
    held = F.lit(0)
    band = bounds.LatitudeBand(-10, 35, "survey")
    for dx, dy in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)):
        v = coords.survey_to_xyz(cells.edge_lambda(4, F.col("y") + dy), cells.edge_eta(4, F.col("x") + dx))
        held = held + F.when(band.contains(v), 1).otherwise(0)
    return sky_map(spark, "n").select("x", "y", held.cast("long").alias("held"))


@query("c13_c14_quadrants", f"""SELECT q, count(*) AS n, sum(CASE WHEN map_weight IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS inside FROM (
  SELECT l.map_weight, CASE WHEN l.k % 4 = 0 THEN 1 WHEN l.k % 4 = 1 THEN 2 WHEN l.k % 4 = 2 THEN 4 ELSE 8 END AS q FROM {_LOC} l) GROUP BY q""")
def _(spark, d):
    both = sky_map(spark, "m").unionByName(sky_map(spark, "n"))
    found = area_map.find_location(orders(spark, d), both, 3)
    q = F.when(F.col("k") % 4 == 0, 1).when(F.col("k") % 4 == 1, 2).when(F.col("k") % 4 == 2, 4).otherwise(8)
    return found.groupBy(q.alias("q")).agg(F.count("*").alias("n"), F.count("map_weight").alias("inside"))


_SYS = f"(SELECT x, y, avg(redshift) AS v, count(*) AS n FROM (SELECT *, {x_sql(8)} AS x, {y_sql(8)} AS y FROM {PART}) GROUP BY ALL)"


@query("x1_fill_systematics", f"""SELECT m.x, m.y, {rs("coalesce(s.v, p.v)")} AS v FROM {sky_map_sql('m')} m LEFT JOIN {_SYS} s ON m.x = s.x AND m.y = s.y
  LEFT JOIN (SELECT x // 2 AS x, y // 2 AS y, sum(v * n) / sum(n) AS v FROM {_SYS} GROUP BY ALL HAVING sum(n) >= 2) p ON m.x // 2 = p.x AND m.y // 2 = p.y WHERE coalesce(s.v, p.v) IS NOT NULL""")
def _(spark, d):
    own = cells.with_cell(part(spark, d), 8).groupBy("x", "y").agg(F.sum("redshift").alias("s"), F.count("*").alias("n"))
    up = own.groupBy(cells.parent("x", 1).alias("px"), cells.parent("y", 1).alias("py")).agg((F.sum("s") / F.sum("n")).alias("pv"), F.sum("n").alias("pn")).where("pn >= 2")
    out = sky_map(spark, "m").select("x", "y").join(own, ["x", "y"], "left").withColumns({"px": cells.parent("x", 1), "py": cells.parent("y", 1)}).join(up, ["px", "py"], "left")
    return out.withColumn("v", F.coalesce(F.col("s") / F.col("n"), "pv")).where("v IS NOT NULL").select("x", "y", r(F.col("v")).alias("v"))


@query("x2_assign_systematics", f"SELECT g.k, {rs('s.v')} AS v FROM (SELECT *, {x_sql(8)} AS x, {y_sql(8)} AS y FROM {CUSTOMER}) g JOIN {_SYS} s ON g.x = s.x AND g.y = s.y")
def _(spark, d):
    own = cells.with_cell(part(spark, d), 8).groupBy("x", "y").agg(F.avg("redshift").alias("v"))
    return cells.with_cell(customer(spark, d), 8).join(own, ["x", "y"]).select("k", r(F.col("v")).alias("v"))


@query("p8_pixelize_circles")
def _(spark, d):
    out = None
    for theta, phi in ((20.0, 0.0), (22.0, 2.0), (0.0, 0.0)):
        one = area_map.pixelize(spark, bounds.Circle(theta, phi, 3.0, "survey"), 6, start=5)
        out = one if out is None else out.unionByName(one)
    fine = area_map.expand(out, 6).select("x", "y").distinct()
    return fine.agg(F.count("*").alias("n"), r(F.count("*") * cells.cell_area(64)).alias("area"))


_RB = "CASE WHEN r < 20e0 THEN 0 WHEN r < 50e0 THEN 1 WHEN r < 100e0 THEN 2 END"


@query("p6_radial_correlation", "SELECT bin, dd, dr, round(dd / (dr * 1e0), 6) + 0e0 AS ratio FROM (SELECT bin, sum(CASE WHEN kind = 'dd' THEN 1 ELSE 0 END)::BIGINT AS dd, sum(CASE WHEN kind = 'dr' THEN 1 ELSE 0 END)::BIGINT AS dr FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {_RB} AS bin FROM (SELECT radians(degrees(atan2({_NORM}, {DOT}))) * a.ad AS r FROM (SELECT *, {_AD} AS ad FROM {PART}) a, {other} b) WHERE r >= 5e0 AND r < 100e0" for kind, other in (("dd", CUSTOMER), ("dr", SUPPLIER))) + ") GROUP BY bin) WHERE dr > 0")
def _(spark, d):
    probes, edges = part(spark, d).select("k", "redshift", *XYZ), [5.0, 20.0, 50.0, 100.0]
    dd = points.projected_pairs(probes, customer(spark, d).select(F.col("k").alias("ck"), *XYZ), Cosmology(), "redshift", edges).withColumnRenamed("n_pairs", "dd")
    dr = points.projected_pairs(probes, supplier(spark, d).select(F.col("k").alias("ck"), *XYZ), Cosmology(), "redshift", edges).withColumnRenamed("n_pairs", "dr")
    return dr.join(dd, "bin", "left").withColumn("dd", F.coalesce("dd", F.lit(0))).select("bin", "dd", "dr", r(F.col("dd") / F.col("dr")).alias("ratio"))
