"""Ranked pages, recency features, event responses and matching."""

import json
import math

from pyspark.sql import functions as F

from encore.functions.geo import geohash_centre, haversine_py
from encore.operators import events as ev
from encore.operators import recency
from encore.schemas import ARTIST_PAGE_SCHEMA, RESPONSE_SCHEMA, TRACK_PAGE_SCHEMA
from encore.sources import event_responses as er
from encore.sources import ranked_pages as rp


def artist_pages(spark):
    rows = [
        ("long_term", 1, "n2", [{"name": "A"}, {"name": "B"}]),
        ("long_term", 2, None, [{"name": "C"}]),
        ("long_term", 3, None, [{"name": "IGNORED"}]),          # after the last page
        ("medium_term", 1, None, [{"name": "B"}, {"name": "D"}]),
        ("short_term", 1, None, [{"name": "D"}]),
        ("short_term", 2, None, []),                             # empty page after the end
    ]
    return spark.createDataFrame(rows, ARTIST_PAGE_SCHEMA)


def test_pages_stop_at_first_null_next(spark):
    got = sorted(tuple(r) for r in rp.flatten_ranked_artists(artist_pages(spark)).collect())
    assert got == [("long_term", 1, "A"), ("long_term", 2, "B"), ("long_term", 3, "C"),
                   ("medium_term", 1, "B"), ("medium_term", 2, "D"), ("short_term", 1, "D")]


def test_recency_features(spark):
    ranked = rp.flatten_ranked_artists(artist_pages(spark))
    pres = {r["artist_name"]: r["api_presence_score"]
            for r in recency.api_presence(ranked).collect()}
    assert pres == {"A": 1.0, "B": 0.5, "C": 0.0}
    cons = {r["artist_name"]: r["time_range_consistency"]
            for r in recency.time_range_consistency(ranked).collect()}
    assert cons == {"A": 1 / 3, "B": 2 / 3, "C": 1 / 3, "D": 2 / 3}


def test_tracks_first_artist_and_breadth(spark):
    rows = [("long_term", 1, None, [
        {"name": "t1", "artists": [{"name": "A"}, {"name": "Z"}]},
        {"name": "t1", "artists": [{"name": "A"}]},           # same track twice
        {"name": "t2", "artists": [{"name": "A"}]},
        {"name": "t3", "artists": [{"name": "B"}]},
        {"name": "t4", "artists": []}])]                      # no credited artist
    tracks = rp.flatten_ranked_tracks(spark.createDataFrame(rows, TRACK_PAGE_SCHEMA))
    assert [r["artist_name"] for r in tracks.orderBy("position").collect()] == ["A", "A", "A", "B", None]
    got = {r["artist_name"]: (r["track_breadth"], r["track_breadth_score"])
           for r in recency.track_breadth(tracks).collect()}
    assert got == {"A": (2, 1.0), "B": (1, 0.5)}


def event(eid, name, images, date, lat=42.3331, lon=-83.0511, venue=True, address=True,
          cls="Music", country="US", source="ticketmaster"):
    v = {"name": f"V{eid}", "city": {"name": "Detroit"}}
    if address:
        v["address"] = {"line1": f"{eid} Main"}
    e = {"id": str(eid), "name": name, "url": f"u{eid}",
         "images": [{"url": u, "width": w} for u, w in images],
         "dates": {"start": {"localDate": date}}, "latitude": lat, "longitude": lon,
         "classification": cls, "country": country, "source": source}
    if venue:
        e["_embedded"] = {"venues": [v]}
    return e


def responses(spark):
    body = {"_embedded": {"events": [
        event(1, "Drake Live", [("i1a", 100), ("i1b", 300), ("i1c", 300)], "2026-08-01"),
        event(2, "Drakeo the Ruler", [("i2", 50)], "2026-07-01"),
        event(3, "drake WITH Future", [("i3", 10)], "2026-07-15", address=False),
        event(4, "Drake Toronto", [("i4", 10)], "2026-06-01", lat=46.0),   # ~250 miles north
        event(5, "Drake Hockey", [("i5", 10)], "2026-06-02", cls="Sports"),
        event(6, "The Band", [("i6", 10)], "2026-06-03"),
    ]}}
    rows = [("Drake", 200, json.dumps(body)), ("Nobody", 200, "{}"),
            ("Broken", 500, '{"errors": []}')]
    return spark.createDataFrame(rows, RESPONSE_SCHEMA)


def test_flatten_events_and_routing(spark):
    flat = {r["ticket_link"]: r for r in er.flatten_events(responses(spark)).collect()}
    assert len(flat) == 6
    assert flat["u1"]["artist_image"] == "i1b"          # widest; first wins a tie
    assert flat["u3"]["address"] is None
    assert flat["u1"]["artist_name"] == "Drake Live"    # the event name, not the query
    errs = er.error_responses(responses(spark)).collect()
    assert [(r["query"], r["status"]) for r in errs] == [("Broken", 500)]


def test_keyword_match_modes(spark):
    cat = er.flatten_events(responses(spark), keep_catalogue=True) \
        .withColumnRenamed("artist_name", "event_name")
    arts = spark.createDataFrame([("Drake", 1), ("The Band", 2), ("Unknown Act", 3)],
                                 "searched_artist string, artist_rank int")
    got = {(r["searched_artist"], r["event_id"])
           for r in ev.keyword_match(arts, cat, "searched_artist", "event_name").collect()}
    # whole-word containment: "Drakeo" is not "Drake"
    assert got == {("Drake", "1"), ("Drake", "3"), ("Drake", "4"), ("Drake", "5"),
                   ("The Band", "6")}
    exact = {(r["searched_artist"], r["event_id"]) for r in ev.keyword_match(
        arts, cat, "searched_artist", "event_name", mode="exact").collect()}
    assert exact == {("The Band", "6")}


def test_match_events_filters_and_cap(spark):
    cat = er.flatten_events(responses(spark), keep_catalogue=True)
    arts = spark.createDataFrame([("Drake", 1)], "artist_name string, artist_rank int")
    got = ev.match_events(arts, cat, per_artist=1).collect()
    # sports (5) filtered, far (4) outside 150 miles; soonest of {1, 3} is 3
    assert [(r["event_id"], r["event_position"]) for r in got] == [("3", 1)]
    two = ev.match_events(arts, cat, per_artist=5).collect()
    assert sorted(r["event_id"] for r in two) == ["1", "3"]


def test_geo():
    lat, lon = geohash_centre("dpsby4")
    assert abs(lat - 42.3331) < 0.01 and abs(lon + 83.0511) < 0.01
    assert abs(haversine_py(0, 0, 0, 1, "km") - 111.19) < 0.1


def test_haversine_column_matches_python(spark):
    df = spark.createDataFrame([(42.0, -83.0, 43.5, -80.1)], "a double, b double, c double, d double")
    got = df.select(ev.haversine("a", "b", "c", "d").alias("x")).first()["x"]
    assert math.isclose(got, haversine_py(42.0, -83.0, 43.5, -80.1), rel_tol=1e-12)


def test_fuzzy_keyword_match(spark):
    cat = spark.createDataFrame([("1", "Drake Live"), ("2", "Drak World Tour"), ("3", "The Bnd"),
                                 ("4", "Drakeo the Ruler"), ("5", "Blake Shelton"),
                                 ("6", "The Band Reunion")], "event_id string, event_name string")
    arts = spark.createDataFrame([("Drake", 1), ("The Band", 2)],
                                 "searched_artist string, artist_rank int")
    got = {(r["searched_artist"], r["event_id"]) for r in ev.keyword_match(
        arts, cat, "searched_artist", "event_name", mode="fuzzy", max_edits=1,
        event_key="event_id").collect()}
    # one edit: drak, drakeo, blake(2 edits: no); the bnd; exact hits too
    assert got == {("Drake", "1"), ("Drake", "2"), ("Drake", "4"),
                   ("The Band", "3"), ("The Band", "6")}


def test_null_names_do_not_match_in_outer_joins(spark):
    rows = [("long_term", 1, None, [{"name": None}, {"name": "A"}]),
            ("short_term", 1, None, [{"name": None}])]
    ranked = rp.flatten_ranked_artists(spark.createDataFrame(rows, ARTIST_PAGE_SCHEMA))
    got = {r["artist_name"]: r["time_range_consistency"]
           for r in recency.time_range_consistency(ranked).collect()}
    assert got == {"A": 1 / 3}


def test_strict_flatten_raises_on_missing_field(spark):
    import pytest
    ok = er.flatten_events(responses(spark)).count()
    assert ok == 6                                   # lenient: address NULL for event 3
    with pytest.raises(Exception, match="event field missing"):
        er.flatten_events(responses(spark), strict=True).collect()


def test_offsets_across_blocks(spark, monkeypatch):
    exp = sorted(tuple(r) for r in rp.flatten_ranked_artists(artist_pages(spark)).collect())
    monkeypatch.setattr(rp, "BLOCK", 1)
    assert sorted(tuple(r) for r in rp.flatten_ranked_artists(artist_pages(spark)).collect()) == exp


def test_repeated_pages_and_null_lists(spark):
    rows = [("a", 1, "n", [{"name": "x"}, {"name": "y"}]), ("a", 1, "n", [{"name": "x"}, {"name": "y"}]),
            ("a", 2, None, [{"name": "z"}]), ("a", 3, None, [{"name": "beyond"}]),
            (None, 1, "n", [{"name": "p"}]), (None, 2, None, [{"name": "q"}])]
    got = rp.flatten_ranked_artists(spark.createDataFrame(rows, ARTIST_PAGE_SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [
        ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), (None, 1, "p"), (None, 2, "q")]))


def test_null_scope_is_refused(spark):
    import pytest

    from encore.operators import ranking
    df = spark.createDataFrame([(1, 2), (None, 3)], "user_id long, v long")
    with pytest.raises(Exception, match="NULL in scope column user_id"):
        ranking.row_number_by_range(df, ["v"], ["user_id"]).collect()


def test_every_response_takes_one_route(spark):
    rows = [("q", 200, '{"_embedded": {"events": []}}'), ("q", 200, "{}"), ("q", 200, "{cut"),
            ("q", 200, None), ("q", None, "{}"), ("q", 429, "x")]
    df = spark.createDataFrame(rows, "query string, status int, body string")
    assert er.error_responses(df).count() == 1
    got = sorted((r.reason for r in er.unreadable_responses(df).collect()))
    assert got == ["body is not JSON", "body is not JSON", "no status"]


def test_keyword_match_splits_a_hot_token(spark, monkeypatch):
    """One token in a third of the events and a pair in many: every join gives the same."""
    import random

    from encore.operators import events, ranking
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(900):
        name = rnd.choices(words, k=rnd.randint(1, 4))
        rows.append((i, " ".join((["The", "hot"] if i % 3 == 0 else []) + name + (["hot"] if i % 5 == 0 else []))))
    artists = [("The",), ("hot",), ("The Hot",), ("hot w3",), ("w1 w1",), ("w5",), ("absent",), ("w2 w3 w4",), ("  ",)]
    artists += [(" ".join(rnd.choices(words, k=2)),) for _ in range(60)]
    e = spark.createDataFrame(rows, "event_id int, event_name string").repartition(4)
    a = spark.createDataFrame(artists, "artist_name string").distinct()
    want = sorted((n, i) for n in {x[0] for x in artists} for i, t in rows
                  if n.split() and f" {' '.join(n.lower().split())} " in f" {t.lower()} ")
    for few in (10**6, 0):
        monkeypatch.setattr(events, "BROADCAST_ROWS", few)
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", few)
        got = sorted((r.artist_name, r.event_id) for r in events.keyword_match(a, e).collect())
        assert got == want


def test_pages_of_a_list_do_not_meet_in_one_task(spark):
    """The last page number is broadcast, whatever the size that Spark assumes for it."""
    from encore.plans import stand_in
    ranked = spark.createDataFrame([("long_term", i) for i in range(1, 121)], "list string, pos long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stand_in._paginate(ranked, F.struct(F.col("pos").cast("string").alias("name")))
        pages = sorted(out.collect(), key=lambda r: r.page_no)
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [(r.page_no, len(r["items"]), r.next is None) for r in pages] == [(1, 50, False), (2, 50, False), (3, 20, True)]


def test_pages_seen_once_are_not_grouped_by_items(spark):
    plan = rp.flatten_ranked_artists(artist_pages(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "min(items" not in plan and "list-pages" not in plan and "LogicalRDD [_list" in plan
    once = sorted(tuple(r) for r in rp.flatten_ranked_artists(artist_pages(spark)).collect())
    other = spark.createDataFrame([("long_term", 1, "n2", [{"name": "Z"}])], ARTIST_PAGE_SCHEMA)
    again = artist_pages(spark).unionByName(artist_pages(spark)).unionByName(other)
    assert sorted(tuple(r) for r in rp.flatten_ranked_artists(again).collect()) == once


def test_stand_in_events_are_grouped_as_narrow_rows(spark, tmpdir_path):
    from encore.plans import stand_in
    spark.sql("SELECT k AS o_orderkey, 1L AS o_custkey, TIMESTAMP_NTZ '2001-01-31 00:00:00' AS o_orderdate, "
              "p AS o_orderpriority FROM VALUES (8L, '1-URGENT'), (3L, '3-MEDIUM'), (8L, '3-MEDIUM') AS t(k, p)"
              ).write.parquet(f"{tmpdir_path}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 2 AS c_nationkey").write.parquet(f"{tmpdir_path}/customer.parquet")
    spark.sql("SELECT 2 AS n_nationkey, 'PERU' AS n_name").write.parquet(f"{tmpdir_path}/nation.parquet")
    out = stand_in.event_responses(spark, tmpdir_path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    grouped = [x for x in plan.splitlines() if "partial_collect_list" in x]
    assert grouped and not any("tickets.example" in x for x in grouped)
    rows = er.flatten_events(out, keep_catalogue=True).collect()
    assert [(r.event_id, r.classification, r.city, r.concert_date, r.artist_image[-6:]) for r in rows] == [
        ("3", "Sports", "PERU", "2027-01-31", "/c.jpg"), ("8", "Music", "PERU", "2027-01-31", "/b.jpg"),
        ("8", "Sports", "PERU", "2027-01-31", "/b.jpg")]


def test_bodies_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", 200, '{"_embedded": {"events": [{"id": "1", "name": "A Live"}]}}'), ("b", 200, "{}"),
                                  ("c", 200, "x{"), ("d", 500, "{}"), ("e", None, None)], "query string, status int, body string")
    parsed = er.flatten_events(rows, keep_catalogue=True)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.query, r.event_id) for r in parsed.collect()] == [("a", "1")]
    assert er.parse_responses(rows).count() == 5
    named = spark.createDataFrame([("A",)], "name string")
    out = ev.keyword_match(named, parsed.withColumnRenamed("artist_name", "event_name"), "name")  # the match reads what was written of them
    assert "from_json(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.name, r.event_name, r.event_id) for r in out.collect()] == [("A", "A Live", "1")]


def test_stand_in_lists_are_grouped_as_narrow_rows(spark):
    from encore.plans import stand_in
    o = spark.sql("SELECT k AS o_custkey, 1.0D * k AS o_totalprice, TIMESTAMP_NTZ '1999-01-31 00:00:00' AS o_orderdate "
                  "FROM VALUES (8L), (3L) AS t(k)")
    out = stand_in._artist_pages(o)
    plan = out._jdf.queryExecution().executedPlan().toString()
    grouped = [x for x in plan.splitlines() if "partial_collect_list" in x]
    assert grouped and not any("lpad" in x for x in grouped)
    assert [[i.name for i in r["items"]] for r in out.collect()] == [["Customer#000000008", "Customer#000000003"]]


def test_only_what_the_match_reads_goes_through_it(spark, monkeypatch):
    seen = []
    match = ev.keyword_match

    def watched(artists, catalogue, *args, **kept):
        seen.extend(catalogue.columns)
        return match(artists, catalogue, *args, **kept)

    monkeypatch.setattr(ev, "keyword_match", watched)
    cols = ["event_id", "artist_name", "ticket_link", "artist_image", "concert_date", "venue", "city", "address", "classification",
            "country", "source"]
    same = ("1", "A Live", "t", "i", "2026-01-01", "v", "c", "d", "music", "US", "ticketmaster")
    events = spark.createDataFrame([same, same, ("2", "B", "t2", "i", "2026-01-02", "v", "c", None, "music", "US", "ticketmaster")], cols
                                   ).selectExpr("*", "42.3331D AS latitude", "-83.0511D AS longitude")
    artists = spark.createDataFrame([("A", 1), ("B", 2)], "artist_name string, artist_rank long")
    for few in (10**6, 0):
        monkeypatch.setattr(ev, "BROADCAST_ROWS", few)
        got = sorted((r.searched_artist, r.event_position, r.event_id, r.artist_name, r.ticket_link, r.address or "")
                     for r in ev.match_events(artists, events).collect())
        assert got == [("A", 1, "1", "A Live", "t", "d"), ("A", 2, "1", "A Live", "t", "d"), ("B", 1, "2", "B", "t2", "")]
    assert "ticket_link" not in seen and "artist_image" not in seen
