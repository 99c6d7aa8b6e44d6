"""The end-to-end job over files, as a user would run it."""

import json
import os

from conftest import play
from encore.plans import job
from test_sources_sinks import write_export


def test_job_end_to_end(spark, tmpdir_path):
    rows = []
    for n, k in [("Drake", 3), ("The Band", 2), ("Solo", 1)]:
        for i in range(k):
            rows += [play(n, f"{n}{i}", f"{n}-alb", f"2020-01-0{i + 1} 10:00:00"),
                     play(n, f"{n}{i}b", f"{n}-alb", f"2020-01-0{i + 1} 11:00:00"),
                     play(n, f"{n}{i}", f"{n}-alb", f"2020-09-0{i + 1} 10:00:00")]
    os.makedirs(f"{tmpdir_path}/plays")
    write_export(f"{tmpdir_path}/plays/2020.json", rows)
    with open(f"{tmpdir_path}/pages.json", "w") as f:
        f.write(json.dumps({"list": "long_term", "page_no": 1, "next": None,
                            "items": [{"name": "The Band"}, {"name": "Drake"}]}) + "\n")
    ev = {"id": "1", "name": "Drake Live", "url": "u1", "images": [{"url": "i", "width": 1}],
          "dates": {"start": {"localDate": "2026-07-01"}},
          "_embedded": {"venues": [{"name": "V", "city": {"name": "Detroit"},
                                    "address": {"line1": "1 Main"}}]},
          "latitude": 42.3, "longitude": -83.0, "classification": "Music", "country": "US",
          "source": "ticketmaster"}
    with open(f"{tmpdir_path}/responses.json", "w") as f:
        f.write(json.dumps({"query": "Drake", "status": 200,
                            "body": json.dumps({"_embedded": {"events": [ev]}})}) + "\n")
        f.write(json.dumps({"query": "X", "status": 503, "body": ""}) + "\n")
    out = f"{tmpdir_path}/out"
    job.main(["--plays", f"{tmpdir_path}/plays/*.json", "--artist-pages", f"{tmpdir_path}/pages.json",
              "--responses", f"{tmpdir_path}/responses.json", "--as-of", "2026-06-07",
              "--out", out], stop_session=False)
    for d in ("features", "scores", "blended", "events", "errors", "top_artists.csv", "digests"):
        assert os.path.isdir(f"{out}/{d}"), d
    assert spark.read.parquet(f"{out}/features").count() == 3
    assert [r["artist_name"] for r in spark.read.parquet(f"{out}/events").collect()] == ["Drake Live"]
    assert spark.read.parquet(f"{out}/errors").first()["status"] == 503
    html = "".join(r["value"] for r in spark.read.text(f"{out}/digests").collect())
    assert "Drake Live" in html and "June 07, 2026" in html


def test_job_from_names_csv(spark, tmpdir_path):
    with open(f"{tmpdir_path}/names.csv", "w") as f:
        f.write('artist_name\nDrake\n"HARDY, Eric Church, Morgan Wallen"\nNobody\n')
    ev = {"id": "1", "name": "Drake Live", "url": "u1", "images": [{"url": "i", "width": 1}],
          "dates": {"start": {"localDate": "2026-07-01"}},
          "_embedded": {"venues": [{"name": "V", "city": {"name": "Detroit"},
                                    "address": {"line1": "1 Main"}}]},
          "latitude": 42.3, "longitude": -83.0, "classification": "Music", "country": "US",
          "source": "ticketmaster"}
    with open(f"{tmpdir_path}/responses.json", "w") as f:
        f.write(json.dumps({"query": "Drake", "status": 200,
                            "body": json.dumps({"_embedded": {"events": [ev]}})}) + "\n")
    out = f"{tmpdir_path}/out2"
    job.main(["--artists-csv", f"{tmpdir_path}/names.csv", "--responses",
              f"{tmpdir_path}/responses.json", "--as-of", "2026-06-07", "--out", out],
             stop_session=False)
    ev_rows = spark.read.parquet(f"{out}/events").collect()
    assert [(r["searched_artist"], r["artist_rank"]) for r in ev_rows] == [("Drake", 1)]
    assert os.path.isdir(f"{out}/digests") and os.path.isdir(f"{out}/top_artists.csv")


def test_every_name_is_matched(spark, monkeypatch):
    """More names than one digest is made from: all are matched, the digests come in parts."""
    monkeypatch.setattr(job, "MAX_NAMES", 2)
    names = spark.createDataFrame([(f"Name{i}", i) for i in range(5)], "artist_name string, chart_position long")
    evs = [{"id": str(i), "name": f"Name{i} Live", "url": f"u{i}", "images": [],
            "dates": {"start": {"localDate": "2026-07-01"}}, "_embedded": {"venues": []},
            "latitude": 42.3, "longitude": -83.0, "classification": "Music", "country": "US",
            "source": "ticketmaster"} for i in range(5)]
    responses = spark.createDataFrame([("q", 200, json.dumps({"_embedded": {"events": evs}}))],
                                      "query string, status int, body string")
    out = job.run_names(spark, names, responses, as_of="2026-06-07")
    got = sorted((r["searched_artist"], r["artist_rank"]) for r in out["events"].collect())
    assert got == [(f"Name{i}", i + 1) for i in range(5)]
    docs = {r["digest_part"]: r for r in out["digests"].collect()}
    assert {k: r["n_events"] for k, r in docs.items()} == {0: 2, 1: 2, 2: 1}
    assert all((f"Name{i} Live" in docs[p]["html"]) == (i // 2 == p) for i in range(5) for p in docs)
