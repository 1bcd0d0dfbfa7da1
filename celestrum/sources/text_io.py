"""Whitespace-separated text: catalogs, maps, fields and correlation results.

Readers are one scan: rows that don't parse are dropped, as are maps' rows with
an impossible resolution. Writers leave a folder of part files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celestrum.functions import cells, coords


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.element_at("f", 1) != "")


def _number(k: int, kind: str = "double") -> Column:
    return F.get("f", F.lit(k)).try_cast(kind)


def read_catalog(spark: SparkSession, path: str, system: str = "equatorial", theta: int = 0, phi: int = 1, weight: int | None = None, redshift: int | None = None, index: int | None = None, fields: dict[str, int] | None = None, radians: bool = False) -> DataFrame:
    """ux, uy, uz and weight (1 without a column), redshift, id and named fields (0 where missing), by column number from 0."""
    scale = 180.0 / 3.141592653589793 if radians else 1.0
    rows = _fields(spark, path)
    ux, uy, uz = coords.unit_vector(_number(theta) * scale, _number(phi) * scale, system)
    made = {"ux": ux, "uy": uy, "uz": uz, "weight": F.coalesce(_number(weight), F.lit(1.0)) if weight is not None and weight >= 0 else F.lit(1.0)}
    if redshift is not None:
        made["redshift"] = _number(redshift)
    if index is not None:
        made["id"] = _number(index, "bigint")
    made |= {name: F.coalesce(_number(k), F.lit(0.0)) for name, k in (fields or {}).items()}
    return rows.where(_number(theta).isNotNull() & _number(phi).isNotNull()).select(*[c.alias(n) for n, c in made.items()])


def write_catalog(df: DataFrame, path: str, system: str = "equatorial", columns: tuple[str, ...] = ()) -> None:
    """Longitude, latitude (survey: lambda, eta) and the named columns."""
    lon, lat = coords.angles(system)
    first = (lat, lon) if coords.sphere(system) == "survey" else (lon, lat)
    df.select(F.concat_ws(" ", *[c.cast("string") for c in (*first, *(F.col(c) for c in columns))])).write.text(path)


def read_map(spark: SparkSession, path: str, hpixel: bool = True, weighted: bool = True) -> DataFrame:
    """level, x, y, weight from `hpixnum superpixnum resolution [weight]`, or `pixnum resolution [weight]` of the single index."""
    rows = _fields(spark, path)
    at = 2 if hpixel else 1
    r = _number(at, "bigint")
    rows = rows.where((r > 0) & (r % 2 == 0)).withColumn("_r", r)
    if hpixel:
        x, y = cells.xy_of_hpix("_r", _number(0, "bigint"), _number(1, "bigint"))
    else:
        n = F.col("_r") * cells.NX0
        x, y = _number(0, "bigint") % n, F.floor(_number(0, "bigint") / n).cast("long")
    weight = F.coalesce(_number(at + 1), F.lit(1.0)) if weighted else F.lit(1.0)
    out = rows.select(F.round(F.log2("_r")).cast("int").alias("level"), x.cast("long").alias("x"), y.cast("long").alias("y"), weight.alias("weight"))
    return out.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def write_map(df: DataFrame, path: str, hpixel: bool = True, weighted: bool = True) -> None:
    r = F.pow(F.lit(2.0), F.col("level")).cast("long")
    h = (r / cells.SUPER_RES).cast("long")
    superpix = cells.superpixnum_at(F.col("level"))
    hpix = h * (F.col("y") % h) + F.col("x") % h
    key = [hpix, superpix, r] if hpixel else [cells.NX0 * r * F.col("y") + F.col("x"), r]
    out = df.withColumns({"_s": superpix, "_h": hpix}).repartitionByRange("_s").sortWithinPartitions("_s", "level", "_h")
    out.select(F.concat_ws(" ", *[c.cast("string") for c in (*key, *([F.col("weight")] if weighted else []))])).write.text(path)


def read_field(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The field (x, y, unmasked, intensity, n_points) and its resolution; ValueError if the file mixes resolutions."""
    rows = _fields(spark, path).withColumn("_r", _number(2, "bigint")).where("_r > 0")
    low, high = rows.agg(F.min("_r"), F.max("_r")).first()
    if low != high:
        raise ValueError(f"{path} has cells of resolutions {low} to {high}; a field has one")
    x, y = cells.xy_of_hpix("_r", _number(0, "bigint"), _number(1, "bigint"))
    return rows.select(x.alias("x"), y.alias("y"), _number(3).alias("unmasked"), _number(4).alias("intensity"), _number(5, "bigint").alias("n_points")), low


def write_field(df: DataFrame, path: str, resolution: int) -> None:
    key = [cells.hpixnum(resolution), cells.superpixnum(resolution), F.lit(resolution)]
    df.select(F.concat_ws(" ", *[c.cast("string") for c in (*key, *(F.col(c) for c in ("unmasked", "intensity", "n_points")))])).write.text(path)


def write_correlation(df: DataFrame, path: str) -> None:
    """theta and the result's other columns with six significant digits, ordered by theta, in one file: a row a bin."""
    columns = [c for c in df.columns if c not in ("bin", "theta")]
    df.coalesce(1).sortWithinPartitions("theta").select(F.concat_ws(" ", *[F.format_string("%.6g", F.col(c).cast("double")) for c in ("theta", *columns)])).write.text(path)


def write_covariance(df: DataFrame, path: str, bins) -> None:
    """theta_a, theta_b, covariance: a row a pair of bins."""
    centers = F.array(*[F.lit(c) for c in bins.centers])
    at = lambda c: F.get(centers, F.col(c))
    df.coalesce(1).sortWithinPartitions("bin_a", "bin_b").select(F.concat_ws(" ", *[F.format_string("%.6g", c.cast("double")) for c in (at("bin_a"), at("bin_b"), F.col("covariance"))])).write.text(path)


def write_ids(df: DataFrame, path: str, columns: tuple[str, ...] = ()) -> None:
    """Lines of `id weight` and the named columns: points or cells of the Hilbert curve."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "weight", *columns)])).write.text(path)


def read_ids(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """id, weight (1 where missing) and the named columns as integers; lines without an id are dropped."""
    more = [_number(k + 2, "bigint").alias(c) for k, c in enumerate(columns)]
    return _fields(spark, path).select(_number(0, "bigint").alias("id"), F.coalesce(_number(1), F.lit(1.0)).alias("weight"), *more).where(F.col("id").isNotNull())


def read_regions(spark: SparkSession, path: str) -> list:
    """(number, shape) of lines `number circle ra dec radius` or `number rectangle dec_min dec_max ra_min ra_max`, in order; others are left out. A list of shapes, which plans are made of, so it is on the driver."""
    from celestrum.functions import bounds

    shapes = {"circle": (bounds.Circle, 3), "rectangle": (bounds.LatLonBox, 4)}
    rows = _fields(spark, path).select(_number(0, "int").alias("n"), F.get("f", F.lit(1)).alias("kind"), F.transform(F.slice("f", 3, 4), lambda v: v.try_cast("double")).alias("v")).where(F.col("n").isNotNull()).orderBy("n").collect()
    return [(r["n"], shapes[r["kind"]][0](*r["v"])) for r in rows if r["kind"] in shapes and len(r["v"]) == shapes[r["kind"]][1] and None not in r["v"]]
