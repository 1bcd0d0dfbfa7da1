"""Hilbert cells: published ids, families, unions, coverings."""

import numpy as np
from pyspark.sql import functions as F

from celestrum.functions import hcells

#: Latitude, longitude and leaf token.
KNOWN = [(0.0, 0.0, "1000000000000001"), (49.703498679, 11.770681595, "47a1cbd595522b39"), (55.685376759, 12.588490937, "46525318b63be0f9"), (45.486546517, -93.449700022, "52b30b71698e729d"), (58.299984854, 23.049300056, "46ed8886cfadda85"), (34.364439040, 108.330699969, "3663f18a24cbe857")]


def test_published_ids(spark):
    df = spark.createDataFrame(KNOWN, "lat double, lon double, token string").withColumn("leaf", hcells.leaf_id("lon", "lat"))
    for r in df.withColumn("made", hcells.token("leaf")).withColumn("back", hcells.from_token("token")).collect():
        assert r["made"] == r["token"] and r["back"] == r["leaf"]


def test_families(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(np.degrees(np.arcsin(z)))) for a, z in zip(rng.uniform(0, 360, 300), rng.uniform(-1, 1, 300), strict=True)], "ra double, dec double").withColumn("leaf", hcells.leaf_id("ra", "dec"))
    for level in (0, 5, 17, 29):
        up = df.withColumn("up", hcells.parent("leaf", level))
        assert up.where(hcells.level_of("up") != level).count() == 0
        assert up.where(~hcells.contains("up", "leaf")).count() == 0
        kids = up.withColumn("kid", F.explode(hcells.children("up")))
        assert kids.where(hcells.parent("kid", level) != F.col("up")).count() == 0
        assert kids.where(hcells.contains("kid", "leaf")).count() == 300
    c = df.withColumn("cell", hcells.parent("leaf", 20)).withColumn("c", hcells.center("cell"))
    near = F.cos(F.radians("ra")) * F.cos(F.radians("dec")) * F.col("c.x") + F.sin(F.radians("ra")) * F.cos(F.radians("dec")) * F.col("c.y") + F.sin(F.radians("dec")) * F.col("c.z")
    assert c.where(near < 1 - 1e-10).count() == 0


def test_unions(spark):
    base = spark.createDataFrame([(12.0, 34.0)], "a double, b double").select(hcells.parent(hcells.leaf_id("a", "b"), 8).alias("cell"))
    kids = base.select(F.explode(hcells.children("cell")).alias("cell"))
    grand = kids.limit(1).select(F.explode(hcells.children("cell")).alias("cell"))
    assert hcells.normalize(kids.unionByName(grand)).collect() == base.collect()
    assert hcells.normalize(base.limit(0)).count() == 0
    points = spark.createDataFrame([(12.0, 34.0), (200.0, -3.0)], "a double, b double").withColumn("leaf", hcells.leaf_id("a", "b"))
    assert hcells.locate(points, base).count() == 1


def test_covering_holds_the_circle():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = hcells.covering((1, 1, 0.3), 10, 6)
    at = np.array([1, 1, 0.3]) / np.linalg.norm([1, 1, 0.3])
    inside = v[v @ at > np.cos(np.radians(10))]
    low = np.int64(1 << 48)
    assert set(((hcells.encode(*inside.T) & -low) | low).tolist()) <= set(ids.tolist())
