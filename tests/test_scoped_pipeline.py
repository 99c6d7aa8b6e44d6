"""The whole pipeline for several listeners at once (scope = user_id) equals
running it per listener."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import play, plays_df
from encore.operators import digest, events, features, recency
from encore.plans.pipelines import superfan_scores
from encore.schemas import ARTIST_PAGE_SCHEMA, RESPONSE_SCHEMA, TRACK_PAGE_SCHEMA
from encore.sources import event_responses, ranked_pages


def user_plays(u, names):
    rows = []
    for i, n in enumerate(names):
        for d, t in [("2020-01-01", "a"), ("2020-01-02", "b"), ("2020-09-01", "a")][: 1 + (i % 3)]:
            rows.append(play(n, f"{n}-{t}", f"{n}-alb", f"{d} 10:00:00", user=u))
    return rows


def pages(spark, scoped):
    rows = [(1, "long_term", 1, None, [{"name": "Drake"}, {"name": "The Band"}]),
            (1, "short_term", 1, None, [{"name": "Drake"}]),
            (2, "long_term", 1, None, [{"name": "Adele"}])]
    schema = T.StructType([T.StructField("user_id", T.LongType())] + ARTIST_PAGE_SCHEMA.fields)
    df = spark.createDataFrame(rows, schema)
    tr = spark.createDataFrame([(1, "long_term", 1, None, [{"name": "x", "artists": [{"name": "Drake"}]}])],
                               T.StructType([T.StructField("user_id", T.LongType())]
                                            + TRACK_PAGE_SCHEMA.fields))
    return df, tr


def catalogue(spark):
    evs = [{"id": str(i), "name": n, "url": f"u{i}", "images": [{"url": f"i{i}", "width": 1}],
            "dates": {"start": {"localDate": f"2026-07-0{i}"}},
            "_embedded": {"venues": [{"name": "V", "city": {"name": "Detroit"}}]},
            "latitude": 42.3, "longitude": -83.0, "classification": "Music", "country": "US",
            "source": "ticketmaster"}
           for i, n in enumerate(["Drake Live", "The Band", "Adele Tour", "Adele Again"], 1)]
    body = json.dumps({"_embedded": {"events": evs}})
    return event_responses.flatten_events(
        spark.createDataFrame([("all", 200, body)], RESPONSE_SCHEMA), keep_catalogue=True)


def run(spark, plays, scope):
    feats = features.features(plays, scope=scope)
    scores = superfan_scores(feats, scope=scope)
    p, t = pages(spark, bool(scope))
    if not scope:
        u = plays.select("user_id").first()["user_id"]
        p, t = p.where(F.col("user_id") == u).drop("user_id"), t.where(F.col("user_id") == u).drop("user_id")
    ranked = ranked_pages.flatten_ranked_artists(p, scope)
    tracks = ranked_pages.flatten_ranked_tracks(t, scope)
    blended = recency.blend(scores, recency.api_presence(ranked, scope=scope),
                            recency.track_breadth(tracks, scope=scope),
                            recency.time_range_consistency(ranked, scope=scope), scope=scope)
    top = recency.top_blended(blended, 50, scope).withColumnRenamed("blend_rank", "artist_rank")
    matched = events.match_events(top, catalogue(spark), scope=scope)
    return blended, matched, digest.digest(matched, scope=scope, as_of="2026-06-07")


def test_scoped_equals_per_user(spark):
    rows = user_plays(1, ["Drake", "The Band", "Other"]) + user_plays(2, ["Adele", "Drake"])
    allp = plays_df(spark, rows, scoped=True)
    blended, matched, docs = run(spark, allp, ["user_id"])
    for u in (1, 2):
        one = allp.where(F.col("user_id") == u)
        b1, m1, d1 = run(spark, one, [])  # unscoped run on one listener (user_id kept as data)
        got_b = {r["artist_name"]: round(r["blended_score"], 12)
                 for r in blended.where(F.col("user_id") == u).collect()}
        exp_b = {r["artist_name"]: round(r["blended_score"], 12) for r in b1.collect()}
        assert got_b == exp_b
        got_m = sorted((r["searched_artist"], r["event_id"])
                       for r in matched.where(F.col("user_id") == u).collect())
        exp_m = sorted((r["searched_artist"], r["event_id"]) for r in m1.collect())
        assert got_m == exp_m
        assert docs.where(F.col("user_id") == u).first()["html"] == d1.first()["html"]
    # user 2 never listed "The Band": only user 1 matches that event
    assert {r["user_id"] for r in matched.where(F.col("event_id") == "2").collect()} == {1}


def test_described_features_are_read_from_a_copy(spark, monkeypatch):
    """Two passes read the features of all listeners: neither makes them again."""
    from encore.plans import catalog
    plays = plays_df(spark, [play("A", "t1", "x", "2020-01-01", user=1), play("A", "t2", "x", "2020-06-01", user=1),
                             play("B", "t1", "y", "2020-01-01", user=2)], scoped=True)
    monkeypatch.setattr(catalog.stand_in, "listener_plays", lambda spark, base: plays)
    described = []
    describe = catalog.explore.describe
    monkeypatch.setattr(catalog.explore, "describe", lambda df, **kept: described.append(df) or describe(df, **kept))
    out = catalog.QUERIES["scoped_agg18_describe"](spark, "").collect()
    plan = described[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith("Relation") and len(plan.strip().splitlines()) == 1
    assert {(r.user_id, r.column_name, r["count"], r["max"]) for r in out} >= {
        (1, "play_count_per_artist", 1, 2.0), (2, "play_count_per_artist", 1, 1.0)}
