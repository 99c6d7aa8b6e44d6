"""PIPE1/PIPE2 on hand-made plays covering the semantic traps."""

import math

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from conftest import play, plays_df
from encore.constants import ARTIST
from encore.operators import features as feat
from encore.plans import oracle
from encore.plans.pipelines import superfan_scores


def edge_rows(user=None):
    u = {"user": user} if user is not None else {}
    return [
        # A: two tracks in one month and album, a 121-day gap -> all features
        play("A", "a1", "alb", "2020-01-01 10:00:00", **u),
        play("A", "a2", "alb", "2020-01-05 10:00:00", skipped=None, **u),
        play("A", "a1", "alb", "2020-05-05 10:00:00", reason_start=None, **u),   # +121 days
        play("A", "a1", "alb", "2020-05-05 10:00:00", reason_end=None, **u),     # tied ts
        # B: gap of exactly 120 days -> no revisit (strict > 120) -> NULL score
        play("B", "b1", "x", "2021-01-01 00:00:00", **u),
        play("B", "b2", "x", "2021-01-02 00:00:00", **u),
        play("B", "b1", "x", "2021-05-02 00:00:00", **u),
        # C: album always NULL with two tracks -> num_true_albums = 0, not NULL
        play("C", "c1", None, "2019-03-01 23:59:59", skipped=None, **u),
        play("C", "c2", None, "2019-03-02 00:00:01", skipped=None, **u),      # 1 day boundary
        play("C", "c1", None, "2019-12-01 00:00:00", skipped=True, **u),
        # D: a single track -> no multi-track month or album
        play("D", "d1", "y", "2018-01-01 00:00:00", reason_start="fwdbtn", **u),
        # podcasts: NULL artist, dropped
        play(None, None, None, "2018-01-01 00:00:00", **u),
    ]


def duck_features(rows):
    df = pd.DataFrame(rows)
    con = duckdb.connect()
    con.register("pdf", df)
    con.execute("CREATE TABLE artist_plays AS SELECT * FROM pdf WHERE master_metadata_album_artist_name IS NOT NULL")
    sql = oracle.FEATURES_CTE.split("artist_plays AS (")[1]
    sql = "WITH " + sql.split("),\n", 1)[1]
    return con.execute(sql + " SELECT * FROM features").fetchdf()


def as_dict(df, key=ARTIST):
    return {r[key]: r.asDict() for r in df.collect()}


def test_features_match_plain_sql(spark):
    rows = edge_rows()
    got = as_dict(feat.features(plays_df(spark, rows)))
    exp = duck_features(rows).set_index(ARTIST)
    assert set(got) == {"A", "B", "C", "D"}
    for artist, r in got.items():
        for c in feat.FEATURE_COLUMNS:
            e = exp.loc[artist, c]
            e = None if pd.isna(e) else float(e)
            g = None if r[c] is None else float(r[c])
            assert (e is None and g is None) or math.isclose(e, g, rel_tol=1e-12), (artist, c, g, e)


def test_feature_traps(spark):
    got = as_dict(feat.features(plays_df(spark, edge_rows())))
    assert got["A"]["revisit_rate"] == 1
    assert got["B"]["revisit_rate"] is None            # exactly 120 days is not a revisit
    assert got["C"]["num_true_albums"] == 0            # NULL album group counts 0
    assert got["D"]["num_true_albums"] is None
    assert got["D"]["listening_consistency"] is None
    # SUM(pred)/COUNT(*): the NULL reason counts in the denominator only
    assert math.isclose(got["A"]["intentional_listening_rate"], 3 / 4)
    assert math.isclose(got["A"]["completion_rate"], 3 / 4)
    # AVG ignores NULL skipped
    assert got["A"]["skip_rate"] == 0.0
    assert got["C"]["skip_rate"] == 1.0


def test_rollup_features_equal_single_aggregates(spark):
    plays = feat.drop_podcasts(plays_df(spark, edge_rows()))
    fused = as_dict(feat.features(plays))
    singles = [feat.play_counts(plays), feat.distinct_counts(plays), feat.skip_rates(plays),
               feat.intentional_rates(plays), feat.completion_rates(plays),
               feat.listening_consistency(plays), feat.true_album_counts(plays),
               feat.revisit_counts(plays)]
    for s in singles:
        for artist, r in as_dict(s).items():
            for c, v in r.items():
                if c != ARTIST:
                    assert fused[artist][c] == v, (c, artist)


def test_previous_play_matches_window(spark):
    plays = feat.drop_podcasts(plays_df(spark, edge_rows()))
    got = sorted(tuple(r) for r in feat.previous_play(plays).collect())
    df = pd.DataFrame(edge_rows()).dropna(subset=[ARTIST])
    con = duckdb.connect()
    con.register("p", df)
    exp = con.execute(f"""SELECT {ARTIST}, ts, prev, datediff('day', prev, ts) FROM (
        SELECT {ARTIST}, ts, lag(ts) OVER (PARTITION BY {ARTIST} ORDER BY ts) AS prev FROM p)""").fetchall()
    norm = lambda rows: sorted((a, str(t), None if p is None else str(p), d) for a, t, p, d in rows)
    assert norm(got) == norm(exp)
    # 23:59:59 -> 00:00:01 is one day boundary
    c = [r for r in got if r[0] == "C" and r[3] == 1]
    assert len(c) == 1


def test_scores_null_last_and_constant_feature(spark):
    sc = superfan_scores(feat.features(plays_df(spark, edge_rows())))
    rows = {r["artist_name"]: r for r in sc.collect()}
    ranks = sorted(r["rank"] for r in rows.values())
    assert ranks == [1, 2, 3, 4]
    # A and C have every feature; B (no revisit) and D (single track) have a
    # NULL score and rank after them, ties broken by name
    for a in "AC":
        assert rows[a]["superfan_score"] is not None
    for a in "BD":
        assert rows[a]["superfan_score"] is None
    assert {rows["A"]["rank"], rows["C"]["rank"]} == {1, 2}
    assert [rows[a]["rank"] for a in "BD"] == [3, 4]
    # revisit_rate is 1 for both scored artists: a constant feature scales to 0
    assert rows["A"]["log_revisit_rate"] == 0.0 and rows["C"]["log_revisit_rate"] == 0.0
    for r in rows.values():
        for c in r.asDict():
            if c.startswith("log_") and r[c] is not None:
                assert 0.0 <= r[c] <= 1.0


def test_scope_equals_per_user_runs(spark):
    rows = edge_rows(user=1) + [dict(r, user_id=2) for r in edge_rows(user=1)[:7]]
    scoped = plays_df(spark, rows, scoped=True)
    both = superfan_scores(feat.features(scoped, scope=["user_id"]), scope=["user_id"])
    got = {(r["user_id"], r["artist_name"]): (r["rank"], r["superfan_score"])
           for r in both.collect()}
    for u in (1, 2):
        one = superfan_scores(feat.features(scoped.where(F.col("user_id") == u).drop("user_id")))
        for r in one.collect():
            g = got[(u, r["artist_name"])]
            assert g[0] == r["rank"]
            assert (g[1] is None and r["superfan_score"] is None) or math.isclose(
                g[1], r["superfan_score"], rel_tol=1e-12)


def test_previous_play_hot_tie_group_in_chunks(spark):
    # seven plays share one timestamp: expanded in chunks of 2 rows
    rows = [play("H", f"t{i}", "a", "2020-01-02 00:00:00") for i in range(7)]
    rows += [play("H", "t", "a", "2020-01-01 00:00:00")]
    got = sorted((str(r["prev_timestamp"]), r["difference_days"])
                 for r in feat.previous_play(plays_df(spark, rows), tie_chunk=2).collect())
    assert got == sorted([("None", None), ("2020-01-01 00:00:00", 1)]
                         + [("2020-01-02 00:00:00", 0)] * 6)


def test_approx_distinct_counts_close(spark):
    rows = [play("A", f"t{i % 40}", f"al{i % 7}", "2020-01-01 00:00:00") for i in range(400)]
    exact = feat.distinct_counts(plays_df(spark, rows)).first()
    approx = feat.distinct_counts(plays_df(spark, rows), approx=True).first()
    assert exact["num_unique_songs_for_artist"] == 40 and exact["unique_albums_for_artist"] == 7
    assert abs(approx["num_unique_songs_for_artist"] - 40) <= 2
    assert abs(approx["unique_albums_for_artist"] - 7) <= 1


def test_features_same_with_or_without_materialised_rollup(spark):
    plays = plays_df(spark, edge_rows())
    a = sorted(tuple(r) for r in feat.features(plays, materialise=True).collect())
    b = sorted(tuple(r) for r in feat.features(plays, materialise=False).collect())
    assert a == b


def test_rollup_is_stored_by_columns(spark):
    out = feat.features(plays_df(spark, edge_rows()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "parquet" in plan


def test_stored_keeps_what_parquet_cannot_hold(spark):
    from encore.session import stored
    rows = spark.range(3)
    assert stored(rows.select("id", F.lit(None).alias("none"))).where("none IS NULL").count() == 3
    twice = stored(rows.select("id", F.col("id").alias("ID")))
    assert twice.columns == ["id", "ID"] and sorted(tuple(r) for r in twice.collect()) == [(0, 0), (1, 1), (2, 2)]
