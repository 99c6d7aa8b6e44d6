"""Distributed rank primitives against plain window / pandas results."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.operators import ranking


def random_frame(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.choice([None, 1.0, 2.0, 2.0, 3.5, rnd.random()]))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_row_number_by_range_equals_window(spark):
    df = random_frame(spark)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = ranking.row_number_by_range(df, order, num_partitions=7)
    exp = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    assert sorted(got.select("id", "rank").collect()) == sorted(exp.select("id", "rank").collect())


def test_row_number_by_range_with_scope(spark):
    df = random_frame(spark)
    order = [F.col("v").asc_nulls_last(), F.col("id").asc()]
    got = ranking.row_number_by_range(df, order, scope=["g"], out="rn", num_partitions=5)
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(got.select("id", "rn").collect()) == sorted(exp.select("id", "rn").collect())


def test_average_rank_matches_pandas(spark):
    df = random_frame(spark)
    got = {r["id"]: r["r"] for r in ranking.average_rank(df, "v", ["g"], "r").collect()}
    pdf = df.toPandas()
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    for _, row in pdf.iterrows():
        e = row["r"]
        if pd.isna(e):
            assert got[row["id"]] is None
        else:
            assert abs(got[row["id"]] - e) < 1e-9


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k long, w long")
    got = ranking.running_sum_by_range(df, ["k"], "w", out="cum", num_partitions=6)
    exp = {k: sum(i % 3 for i in range(k + 1)) for k in range(100)}
    assert {r["k"]: r["cum"] for r in got.collect()} == exp


def test_presence_score_edges(spark):
    one = spark.createDataFrame([("x", 1)], "artist_name string, position long")
    assert ranking.presence_score(one, "position").collect()[0]["api_presence_score"] == 1.0
    three = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "artist_name string, position long")
    got = {r["artist_name"]: r["api_presence_score"]
           for r in ranking.presence_score(three, "position").collect()}
    assert got == {"x": 1.0, "y": 0.5, "z": 0.0}


def test_top_k_plans_take_ordered(spark):
    df = random_frame(spark)
    plan = ranking.top_k(df, [F.col("v").desc_nulls_last(), "id"], 5)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_top_k_per_group(spark):
    df = random_frame(spark)
    got = ranking.top_k_per_group(df, ["g"], [F.col("id")], 3).groupBy("g").count().collect()
    assert all(r["count"] == 3 for r in got)


def test_salted_join_equals_broadcast(spark, monkeypatch):
    # one value holds a third of the rows; force the salted path
    rows = [(i, 0.0 if i % 3 == 0 else float(i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v double")
    exp = {r["id"]: r["r"] for r in ranking.average_rank(df, "v", out="r").collect()}
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 5)
    got_df = ranking.average_rank(df, "v", out="r")
    assert {r["id"]: r["r"] for r in got_df.collect()} == exp
    assert "_salt" not in got_df.columns


def test_top_k_per_group_plans_window_group_limit(spark):
    df = spark.range(10000).select((F.col("id") % 7).alias("g"), F.col("id"))
    out = ranking.top_k_per_group(df, ["g"], [F.col("id").desc()], 5)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2      # map side and reduce side


def test_unscoped_rank_has_no_single_partition_exchange(spark):
    df = random_frame(spark)
    out = ranking.row_number_by_range(df, [F.col("v").desc_nulls_last(), F.col("id")])
    out.write.format("noop").mode("overwrite").save()
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
