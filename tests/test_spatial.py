"""JN7 with many centres: geohash columns and the cell join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from encore.functions.geo import geohash_centre, geohash_code, geohash_point, haversine_py
from encore.operators import ranking, spatial


def test_geohash_columns_agree_with_the_parameter_form(spark):
    rnd = random.Random(4)
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(200)]
    points += [(42.3331, -83.0511), (90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for p in (1, 4, 6, 11):
        code = geohash_code(F.col("lat"), F.col("lon"), p)
        for r in df.select("lat", "lon", code.alias("c"), geohash_point(code).alias("m")).collect():
            if r.lat is None:
                assert r.c is None and r.m is None
                continue
            assert len(r.c) == p
            assert tuple(r.m) == pytest.approx(geohash_centre(r.c), abs=1e-9)
            a, b = spatial.geohash_bits(p)
            assert abs(r.m.latitude - r.lat) <= 90 / 2**a + 1e-9 and abs(r.m.longitude - r.lon) <= 180 / 2**b + 1e-9
    known = df.select(geohash_code(F.lit(42.3331), F.lit(-83.0511), 6).alias("c")).first().c
    assert known == "dpsby4"
    odd = spark.createDataFrame([("",), ("a!",), (None,), ("DPSBY4",)], "c string").select(geohash_point(F.col("c")).alias("m"))
    assert [r.m is None for r in odd.collect()] == [True, True, True, False]


def globe(rnd, n):
    out = []
    for _ in range(n):
        kind = rnd.random()
        lat = rnd.uniform(85, 90) if kind < .2 else rnd.uniform(-90, -80) if kind < .3 else rnd.uniform(-90, 90)
        lon = rnd.choice([-180.0, 180.0]) if kind > .95 else rnd.uniform(179, 180) if kind > .8 else rnd.uniform(-180, 180)
        out.append((lat, lon))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_near_centres_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(11)
    points = [(i, rnd.choice("xy"), *p) for i, p in enumerate(globe(rnd, 250) + [(42.0, -83.0)] * 120)]
    points += [(900, "x", None, 1.0), (901, "x", 1.0, float("nan")), (902, "y", 91.0, 0.0), (903, "x", 90.0, 12.0)]
    centres = [(i, rnd.choice("xy"), *p, rnd.choice([0.0, 1.0, 150.0, 900.0, 4000.0, 13000.0]))
               for i, p in enumerate(globe(rnd, 60) + [(42.0, -83.0), (90.0, 0.0), (-90.0, 5.0)])]
    centres += [(97, "x", 1.0, 1.0, None), (98, "y", 1.0, 1.0, -1.0), (99, "x", None, 1.0, 10.0)]
    p = spark.createDataFrame(points, "id int, k string, latitude double, longitude double").repartition(4)
    c = spark.createDataFrame(centres, "centre int, k string, centre_latitude double, centre_longitude double, radius double")

    def near(q, m):
        ok = None not in (*q[2:4], *m[2:5]) and abs(q[2]) <= 90 and q[3] == q[3] and m[4] >= 0
        return ok and haversine_py(q[2], q[3], m[2], m[3]) <= m[4] + 1e-7

    for on in ([], ["k"]):
        both = p if on else p.drop("k")
        got = sorted((r.id, r.centre) for r in spatial.near_centres(both, c if on else c.drop("k"), on).collect())
        assert got == sorted((q[0], m[0]) for q in points for m in centres if near(q, m) and (not on or q[1] == m[1]))
    assert spatial.near_centres(p.limit(0), c.drop("k")).count() == 0
    assert spatial.near_centres(p.drop("k"), c.limit(0).drop("k")).count() == 0


def test_covers_are_few_cells(spark):
    c = spark.createDataFrame([(a / 1.0, b / 1.0, r) for a in range(-90, 91, 15) for b in range(-180, 181, 60)
                               for r in (0.01, 3.0, 150.0, 2000.0)],
                              "centre_latitude double, centre_longitude double, radius double")
    n = spatial.covered(c, "centre_latitude", "centre_longitude", "radius", "miles").groupBy(*c.columns).count()
    assert n.agg(F.max("count")).first()[0] <= 9 and n.count() == c.distinct().count()


def test_split_join_spreads_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
        table = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        out = ranking.split_join(rows, table, ["k"], parts=8)
        assert out.count() == 9000 and out.where("v <> 2 * k").count() == 0
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) <= 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_covers_are_stored_by_columns(spark):
    points = spark.createDataFrame([(1, 42.0, -83.0)], "id int, latitude double, longitude double")
    centres = spark.createDataFrame([("a", 42.0, -83.1, 20.0)], "n string, centre_latitude double, centre_longitude double, radius double")
    out = spatial.near_centres(points, centres)
    cover = next(r for r in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_cell" in r and "Relation" in r)
    assert "parquet" in cover and [(r.id, r.n) for r in out.collect()] == [(1, "a")]
