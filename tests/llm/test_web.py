"""URL rules, WARC archives and shards against brute force and round trips."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from encore.llm import hilbert, url_filter, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "", "block"),
         ("net", "/long/path/that/wins/", "allow")]


def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        path = rest[n:]
        path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules_match_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["net", "x.net", "example.net", "A.example.NET", "q.a.example.net", "anet", "b.org", "c.b.org",
             "xb.org", "example.com", "www.example.com", "example.community", "", "..", "n\u00e9t.net"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/de/1", "/fr/z?u=/en/", "?a", "#b", "/long/path/that/wins/1"]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "") for h in hosts for p in paths]
    urls += [None, "", "://", "a://b://c", "http://x.net/\n/en/"] + rnd.choices(urls, k=300)
    df = spark.createDataFrame([(i, u, "h", {"k": 1}) for i, u in enumerate(urls)],
                               "page_id long, url string, host string, extra map<string,int>")
    out = url_filter.judge(df, RULES, chunks=5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert "extra" in out.columns
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_rules_edge_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert url_filter.judge(df, [], default="block").first().verdict == "block"
    with pytest.raises(ValueError):
        url_filter.judge(df, [("a", "/", "block")] * (url_filter.MAX_RULES + 1))


def test_warc_round_trip(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "ROTATE", 2000)
    big = "<p>" + "x" * 200
    rows = [(i, f"http://h{i % 4}.example.org/p{i}", f"{big}{i % 6}") for i in range(40)]
    rows += [(50, None, None), (51, "no scheme\r\nX: y", ""), (52, "http://\u00fc.org/\u00e4 b", "short"),
             (53, "http://z.org/", "short"), (60, "http://d.org/", big), (60, "http://d.org/", big),
             (None, "http://n.org/", big), (61, "http://e.org/", "\u20ac" * 5000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    archive = warc.write_archive(pages, "file:" + tmpdir_path)
    assert len(archive.blocks) > 5 and archive.starts == sorted(archive.starts)
    wanted = pages.select("page_id", "url").union(pages.select("page_id", "url"))
    places = warc.lookup(wanted, archive, "file:" + tmpdir_path)
    got = warc.read_records(places, "file:" + tmpdir_path, payloads=True).collect()
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        at = first.get(h) if sum((x or "").encode() == h for _, _, x in rows) > 1 else None
        alone = at is None or at == i
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "response" if alone else "revisit",
                     None if alone else at, h if alone else None))
    assert sorted(repr((*r[:5], r[5] and bytes(r[5]))) for r in got) == sorted(
        repr(w) for w in want)
    one = places.where("page_id = 3").first()
    with open(f"{tmpdir_path}/{one.file}", "rb") as f:
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_warc_empty(spark, tmpdir_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages, "file:" + tmpdir_path)
    places = warc.lookup(pages.select("page_id", "url"), archive, "file:" + tmpdir_path)
    assert archive.blocks == [] and warc.read_records(places, "file:" + tmpdir_path).count() == 0


def test_curve_visits_neighbours():
    import numpy as np
    for d, bits in ((2, 4), (3, 2), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        index = hilbert.curve_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def doc_frame(spark, n, seed=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "t" * rnd.randrange(900)]), rnd.choice([None, "en", "de", "fr"]),
             rnd.choice(["src0", "src1", "src22", None]), 7) for i in range(n)]
    rows += rows[:5] + [(None, "x", None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int"), rows


def test_shards_are_even_runs(spark):
    df, rows = doc_frame(spark, 203)
    got = hilbert.shard_documents(df, shards=10).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(10)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    by_id = {r.doc_id: r.size for r in got}
    assert all(by_id[i] == len((t or "").encode()) + 16 for i, t, *_ in rows)


def test_shards_edge_tables(spark):
    df, _ = doc_frame(spark, 3)
    assert hilbert.shard_documents(df.limit(0), shards=4).count() == 0
    few = hilbert.shard_documents(df.limit(2), shards=40)
    assert sorted(r.shard for r in few.collect()) == [0, 1]
    zones = hilbert.zone_map(hilbert.shard_documents(df, shards=2), ["size", "lang"])
    assert {r.shard for r in zones.collect()} == {0, 1}


def test_zone_maps_prune_every_dimension(spark):
    df = spark.range(4096).select(F.col("id").alias("doc_id"),
                                  F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"),
                                  F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("b"))
    placed = hilbert.cut_runs(hilbert.with_curve(df, ["a", "b"]), ["hilbert", "doc_id"], 64)
    zones = hilbert.zone_map(placed, ["a", "b"])
    for c in ("a", "b"):
        hit = zones.where(f"min_{c} <= 100 AND max_{c} >= 50").count()
        assert hit <= 20  # a sort by the other dimension alone would hit all 64


def test_shards_are_written_whole(spark, tmpdir_path):
    docs = spark.createDataFrame([(i if i % 3 else None, f"t{i // 2}", "en", "s", i, i) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, slot int, row_key int")
    hilbert.write_shards(docs, f"{tmpdir_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmpdir_path}/shards")
    assert sorted(r.slot for r in back.collect()) == list(range(20)) and back.select("shard").distinct().count() == 4
    assert {tuple(r) for r in back.select(*docs.columns).collect()} == {tuple(r) for r in docs.collect()}


def test_curve_matches_brute_force(spark):
    """Bucket and index of every row: bounds are the quantiles of the whole values."""
    import math

    import numpy as np
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, *(f"crawl-2023-{m:02}" for m in range(1, 13))]),
             rnd.choice([None, math.nan, rnd.random(), 0.5]), rnd.choice([None, rnd.randrange(-50, 50)]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n long").repartition(3)
    got = {r.i: r.hilbert for r in hilbert.with_curve(df, ["s", "d", "n"], bits=5).collect()}

    def numbers(col, order):
        known = sorted((v for v in col if v is not None), key=order)
        bounds = [order(known[len(known) * k // 32]) for k in range(1, 32)]
        return [0 if v is None else sum(b <= order(v) for b in bounds) for v in col]

    cols = list(zip(*rows))
    grid = np.array([numbers(cols[1], str.encode), numbers(cols[2], lambda v: math.inf if v != v else v),
                     numbers(cols[3], int)]).T
    assert [got[i] for i in cols[0]] == hilbert.curve_index(grid, 5).tolist()
    assert len(set(grid[:, 0])) == 13 and grid[:, 0].max() > 27


def test_long_names_are_told_apart(spark):
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.concat(
        F.lit("crawl-2023-"), F.lpad((F.pmod(F.xxhash64("id"), F.lit(12)) + 1).cast("string"), 2, "0")).alias("source"))
    placed = hilbert.shard_documents(docs, shards=40)
    per = placed.groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert per[1] <= 4 and per[0] < 12


def test_rules_with_odd_hosts(spark):
    rules = [("net", "/", "block"), ("a b.org", "/", "block"), ("x,y", "/", "allow"), ("p/q", "/", "block")]
    hosts = ["x.net,foo", "x.net", "net,x", "a.org,b", "z.a b.org", "b.org", "x,y", "x.y", "k.x,y", "a!.net",
             "\x01.net", "net\x01", "q", "p", "", ".net", "net.", "a..net", "Ünet"]
    df = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id int, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(df, rules).collect()}
    for i, h in enumerate(hosts):
        fits = [r + "/" for r, _, _ in rules if (h == r or h.endswith("." + r)) and "/" not in r]
        assert got[i] == max(fits, key=len, default=None), h


def test_bounds_are_exact_quantiles_of_all_rows(spark):
    import numpy as np
    n = 120_000
    df = spark.range(n).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 40)).alias(c)
                                       for i, c in enumerate("ab")])
    rows = hilbert.with_curve(df, ["a", "b"]).collect()

    def numbers(col):
        known = np.sort(col)
        return np.searchsorted(known[[n * i // 256 for i in range(1, 256)]], col, "right")

    grid = np.stack([numbers(np.array([r[c] for r in rows])) for c in "ab"], axis=1)
    assert [r.hilbert for r in rows] == hilbert.curve_index(grid, 8).tolist()
