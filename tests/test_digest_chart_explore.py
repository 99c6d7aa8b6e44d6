"""Digest, chart seeding, CSV round trip, exploration statistics."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from encore.constants import DIGEST_DIVIDER
from encore.operators import chart, digest, explore
from encore.sources import sinks


def matched(spark, n=3):
    rows = [(f"A{i % 2}", i % 2 + 1, i + 1, str(i), f"Show <{i}> & co", f"u{i}", f"img{i}",
             f"2026-0{7 - i}-01", "Hall", "Detroit", None if i == 0 else "1 Main")
            for i in range(n)]
    return spark.createDataFrame(rows, "searched_artist string, artist_rank int, event_position int, "
                                       "event_id string, artist_name string, ticket_link string, "
                                       "artist_image string, concert_date string, venue string, "
                                       "city string, address string")


def test_digest_order_dividers_escape(spark):
    doc = digest.digest(matched(spark), as_of="2026-06-07").first()
    html = doc["html"]
    assert doc["n_events"] == 3
    assert "June 07, 2026" in html
    assert html.count("<hr") == 2                       # never after the last card
    assert "Show &lt;0&gt; &amp; co" in html and "Show <0>" not in html
    # chronological: 2026-05 (i=2) before 2026-06 (i=1) before 2026-07 (i=0)
    assert html.index("img2") < html.index("img1") < html.index("img0")
    raw = digest.digest(matched(spark), as_of="2026-06-07", escape=False).first()["html"]
    assert "Show <0> & co" in raw


def test_empty_digest(spark):
    empty = matched(spark).limit(0)
    doc = digest.digest(empty, as_of="2026-06-07").first()
    assert doc["n_events"] == 0 and DIGEST_DIVIDER.strip() not in doc["html"]


def test_chart_seed(spark):
    items = ["\n\tTaylor Swift\t", "Bill Withers", "A &amp; B", "X Featuring Y", "Drake",
             "<b>Drake</b>", "Ella with Z"] + [f"N{i}" for i in range(100)]
    html = "<ul>" + "".join(f"<li><a href='/x'>{t}</a></li>" for t in items) + "</ul>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = [r["artist_name"] for r in chart.chart_seed(pages).orderBy("chart_position").collect()]
    assert got[:6] == ["Taylor Swift", "Bill", "A", "X", "Drake", "Ella"]
    assert len(got) == 50


def test_csv_round_trip(spark):
    df = spark.createDataFrame([("HARDY, Eric Church, Morgan Wallen",), ('Say "Hi"',)],
                               "artist_name string")
    path = sinks.scratch_path(spark, "csv-test")
    sinks.write_csv(df, path)
    back = sorted(r["artist_name"] for r in sinks.read_csv(spark, path).collect())
    assert back == sorted(["HARDY, Eric Church, Morgan Wallen", 'Say "Hi"'])


def stats_frame(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(f"k{i}", rnd.choice([None, 1, 2, 2, 3, rnd.randint(0, 50)]), rnd.random() * 10,
             rnd.choice([None, 0.5, 0.5, rnd.random()]), 7.0) for i in range(n)]
    return spark.createDataFrame(rows, "k string, a long, b double, c double, const double")


def test_describe_matches_pandas(spark):
    df = stats_frame(spark)
    got = {r["column_name"]: r for r in explore.describe(df).collect()}
    pdf = df.toPandas().drop(columns="k").astype(float).describe()
    for c in ["a", "b", "c", "const"]:
        for mine, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(float(got[c][mine]), float(pdf.loc[theirs, c]),
                                rel_tol=1e-9, abs_tol=1e-12), (c, mine)


def test_histogram_matches_numpy(spark):
    df = stats_frame(spark)
    got = explore.histogram(df).toPandas()
    pdf = df.toPandas()
    for c in ["a", "b", "c", "const"]:
        vals = pdf[c].dropna().astype(float).to_numpy()
        counts, _ = np.histogram(vals, bins=30)
        mine = got[got.column_name == c].sort_values("bin")["count"].to_numpy()
        assert list(mine) == list(counts), c


def test_spearman_matches_pandas(spark):
    df = stats_frame(spark)
    got = {(r["col_a"], r["col_b"]): r["rho"] for r in explore.spearman(df).collect()}
    corr = df.toPandas().drop(columns="k").astype(float).corr(method="spearman")
    for (a, b), v in got.items():
        e = corr.loc[a, b]
        if pd.isna(e):
            assert v is None, (a, b)
        else:
            assert math.isclose(v, e, rel_tol=1e-9, abs_tol=1e-12), (a, b)


def test_kruskal_matches_formula(spark):
    rnd = random.Random(5)
    rows = [(i % 3, float(rnd.randint(0, 9)), float(i % 3 + rnd.random())) for i in range(90)]
    df = spark.createDataFrame(rows, "cluster int, x double, y double")
    got = {r["feature"]: r for r in explore.kruskal_wallis(df, "cluster", ["x", "y"]).collect()}
    pdf = pd.DataFrame(rows, columns=["cluster", "x", "y"])
    for f in ["x", "y"]:
        r = pdf[f].rank(method="average")
        n = len(pdf)
        h = 12 / (n * (n + 1)) * sum(r[pdf.cluster == g].sum() ** 2 / (pdf.cluster == g).sum()
                                     for g in range(3)) - 3 * (n + 1)
        t = pdf[f].value_counts().to_numpy()
        h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
        assert math.isclose(got[f]["statistic"], h, rel_tol=1e-9)
        assert math.isclose(got[f]["p_value"], math.exp(-h / 2), rel_tol=1e-9)


def test_kmeans_and_pca_shapes(spark):
    rnd = random.Random(1)
    rows = [(f"k{i}", rnd.random() + (i % 3) * 5, rnd.random(), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x double, y double, s double")
    cl = explore.kmeans_clusters(df, ["x", "y", "s"], "k", "s")
    sizes = {r["cluster"]: r["count"] for r in explore.cluster_sizes(cl).collect()}
    assert sizes == {0: 20, 1: 20, 2: 20}
    # highest mean score is cluster 0
    means = {r["cluster"]: r["m"] for r in cl.groupBy("cluster").agg({"s": "avg"})
             .withColumnRenamed("avg(s)", "m").collect()}
    assert means[0] > means[1] > means[2]
    pc = explore.pca_coords(cl, ["x", "y", "s"]).toPandas()
    assert abs(pc["PC1"].mean()) < 1e-9 and abs(pc["PC2"].mean()) < 1e-9
    assert pc["PC1"].var() >= pc["PC2"].var()


def test_scoped_statistics_equal_per_scope(spark):
    from pyspark.sql import functions as F
    df = stats_frame(spark).withColumn("user_id", (F.abs(F.xxhash64("k")) % 3).cast("long"))
    scoped = {
        "describe": explore.describe(df.drop("k"), scope=["user_id"]),
        "histogram": explore.histogram(df.drop("k"), scope=["user_id"]),
        "spearman": explore.spearman(df.drop("k"), scope=["user_id"]),
    }
    for u in range(3):
        one = df.where(F.col("user_id") == u).drop("k", "user_id")
        for name, fn in (("describe", explore.describe), ("histogram", explore.histogram),
                         ("spearman", explore.spearman)):
            exp = sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v
                               for v in r) for r in fn(one).collect())
            got = sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v
                               for v in r)
                         for r in scoped[name].where(F.col("user_id") == u).drop("user_id").collect())
            assert got == exp, (name, u)


def test_entities_and_spaces_in_names(spark):
    items = ["Beyonc&eacute;", "Guns N&#8217; Roses", "&nbsp; A&#x4E2D; \u2003", "AT&amp;T", "&amp;lt;",
             "&bogus; x", "a & b", "&#xD800;", "&#0;", "R&D"]
    html_text = "".join(f"<li><a href='#'>{i}</a></li>" for i in items)
    df = spark.createDataFrame([(1, html_text), (2, None)], "page_id long, html string")
    got = [r.text for r in chart.element_texts(df).orderBy("position").collect()]
    assert got == ["Beyonc\u00e9", "Guns N\u2019 Roses", "A\u4e2d", "AT&T", "&lt;", "&bogus; x", "a & b",
                   "&#xD800;", "&#0;", "R&D"]


def test_items_by_class(spark):
    html_text = ('<ul><li class="item top">A</li><li class="topping">B</li><li>C</li>'
                 "<li><a href='/x' class='top'>D</a></li></ul>")
    df = spark.createDataFrame([(1, html_text)], "page_id long, html string")
    got = chart.element_texts(df, chart.class_pattern("top")).orderBy("position").collect()
    assert [r.text for r in got] == ["A", "D"]


def test_elements_by_class(spark):
    long_text = "y" * 300_000
    cases = [
        ("<div class='a'>1<p class=a>2<b>3</div>4", "a", ["123", "23"]),      # unclosed inside
        ('<ul class="x a"><li class="a b">R&amp;D <i>i</i></li><li class="ab">n</li>', "a", ["R&D in", "R&D i"]),
        ("</p><a CLASS=\"a\" title='>'>t<!-- <i class=a> --><script>'<b class=a>'</script>u</a>", "a", ["tu"]),
        ("<img class=a><br class='a'/>z", "a", ["", ""]),
        ("<p title=\"class='a'\" data-class=a>no</p><p class=A>no</p>", "a", []),
        ("1 < 2 <q class=a>3 < 4 > 5</q>", "a", ["3 < 4 > 5"]),
        (f"<p class=a>{long_text}", "a", [long_text]), ("", "a", []), (None, "a", []),
        ("<p class='b a b'>both</p>", "b", ["both"]),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(cases)], "page_id long, html string")
    out = chart.elements_by_class(df, ["a", "b", "a"])
    got = {}
    for r in out.orderBy("page_id", "class", "position").collect():
        got.setdefault((r.page_id, r["class"]), []).append(r.text)
    for i, (_, c, texts) in enumerate(cases):
        assert got.get((i, c), []) == texts, cases[i][0][:80]
    assert got[9, "a"] == ["both"]
    assert out.where("position < 1").count() == 0
    assert chart.elements_by_class(df, []).count() == 0
    assert chart.elements_by_class(df.limit(0), ["a"]).count() == 0


def test_chart_csv_by_header_keeps_order(spark, tmpdir_path):
    from encore.plans import job
    names = [f"N{i:03d}" for i in range(60, 0, -1)]
    df = spark.createDataFrame([(7, i + 1, n) for i, n in enumerate(names)],
                               "page_id long, chart_position long, artist_name string").repartition(4)
    sinks.write_csv(df, f"{tmpdir_path}/c")
    schema = "artist_name string, chart_position long"
    back = sinks.read_csv(spark, f"{tmpdir_path}/c", spark.createDataFrame([], schema).schema)
    top = job.run_names(spark, back)["top"].orderBy("artist_rank").collect()
    assert [r.artist_name for r in top] == names


def test_kmeans_keeps_nulls_and_ignores_partitions(spark):
    rows = [(f"a{i}", float(i % 7), None if i % 5 == 0 else i / 10, None if i % 11 == 0 else i / 100)
            for i in range(90)]
    df = spark.createDataFrame(rows, "k string, x double, y double, s double")
    got = [sorted((r.k, r.y, r.s, r.cluster) if r.s is not None else (r.k, -1, -1, r.cluster)
                  for r in explore.kmeans_clusters(df.repartition(n), ["x", "y", "s"], "k", "s").na.fill(-2, ["y"])
                  .collect()) for n in (1, 7)]
    assert got[0] == got[1] and len({g[3] for g in got[0]}) == 3
    assert sum(g[2] == -1 for g in got[0]) == 9


def test_chi_square_tail():
    assert abs(explore.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(explore.chi2_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(explore.chi2_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(explore.chi2_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert explore.chi2_tail(0.0, 4) == 1.0 and explore.chi2_tail(None, 2) is None


def test_quartiles_by_brackets_and_by_sort_agree(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, 7.0 if i % 3 == 0 else rnd.gauss(0, 50), float(rnd.randrange(4)), None if i % 2 else rnd.random(),
             None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, e double").repartition(6)
    want = df.toPandas()[["a", "b", "c"]].describe()
    for margin in (3, -2000):  # a bracket that misses sends its column to the sort
        monkeypatch.setattr(explore, "SKETCH_MARGIN", margin)
        got = {r["column_name"]: r for r in explore.describe(df, ["a", "b", "c", "e"]).collect()}
        assert set(got) == {"a", "b", "c"}
        for c in want.columns:
            for q, p in (("25%", "p25"), ("50%", "p50"), ("75%", "p75")):
                assert math.isclose(got[c][p], want[c][q], rel_tol=1e-12), (c, p, margin)
    monkeypatch.setattr(explore, "SKETCH_MARGIN", 3)
    by = df.withColumn("u", F.when(F.col("k") % 3 == 0, 1).otherwise(F.col("k") % 7))
    scoped = {(r["u"], r["column_name"]): r["p50"] for r in explore.describe(by, ["a", "c"], scope=["u"]).collect()}
    median = by.toPandas().groupby("u")[["a", "c"]].median()
    assert scoped.keys() == {(u, c) for u in median.index for c in "ac"}
    assert all(math.isclose(v, median[c][u], rel_tol=1e-12) for (u, c), v in scoped.items())
    assert explore.describe(df.limit(0), ["a"]).count() == 0


def test_spearman_ranks_by_null_patterns(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        x = rnd.randrange(12)
        rows.append((i % 2, float(x), float(x * x) if rnd.random() < .7 else None, rnd.random() if rnd.random() < .5 else None,
                     rnd.choice([1.0, 2.0]) if rnd.random() < .6 else None, 5.0, None))
    df = spark.createDataFrame(rows, "u int, a double, b double, c double, d double, e double, f double").repartition(5)
    cols = list("abcdef")
    pdf = df.toPandas()
    for scope, frames in (([], {(): pdf}), (["u"], {(u,): p for u, p in pdf.groupby("u")})):
        got = {tuple(r)[:-1]: r["rho"] for r in explore.spearman(df, cols, scope=scope).collect()}
        seen = set()
        for key, p in frames.items():
            for i, x in enumerate(cols):
                for y in cols[i:]:
                    both = p[[x, y]].dropna() if x != y else p[[x]].dropna()
                    if not len(both):
                        continue
                    seen.add((*key, x, y))
                    if both[x].nunique() < 2 or both[y].nunique() < 2:
                        assert got[*key, x, y] is None
                    else:
                        want = both[x].rank().corr(both[y].rank())
                        assert math.isclose(got[*key, x, y], want, abs_tol=1e-9)
        assert set(got) == seen
    assert explore.spearman(df.limit(0), cols).count() == 0


def test_kmeans_goes_on_until_centres_stop(spark):
    rnd = random.Random(2)
    rows = [(f"p{i}", rnd.random(), rnd.random() ** 2) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = [{r.k: r.cluster for r in explore.kmeans_clusters(df.repartition(n), ["x", "y"], "k", "x").collect()}
           for n in (4, 32)]
    assert got[0] == got[1]
    centre = {c: [sum(r[i] for r in rows if got[0][r[0]] == c) / max(1, sum(got[0][r[0]] == c for r in rows)) for i in (1, 2)]
              for c in (0, 1, 2)}
    for k, x, y in rows:  # a standstill: every row is nearest to its own centre
        gap = {c: (x - m[0])**2 + (y - m[1])**2 for c, m in centre.items()}
        assert gap[got[0][k]] <= min(gap.values()) + 1e-7
    with pytest.raises(RuntimeError):
        explore.kmeans_clusters(df, ["x", "y"], "k", "x", limit=1)
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, x double")
    assert [r.cluster for r in explore.kmeans_clusters(same, ["x"], "k", "x").collect()] == [0, 0]
    assert explore.kmeans_clusters(same.limit(0), ["x"], "k", "x").count() == 0


def test_coordinates_keep_nulls_and_match_numpy(spark):
    rnd = random.Random(3)
    rows = [(f"k{i}", rnd.random() * 3, rnd.random(), None if i % 4 == 0 else rnd.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, x double, y double, s double")
    got = {r.k: r for r in explore.pca_coords(df, ["x", "y", "s"]).collect()}
    assert sum(r.s is None for r in got.values()) == 20
    data = np.array([[x, y, s or 0.0] for _, x, y, s in rows])
    centred = data - data.mean(0)
    vt = np.linalg.svd(centred, full_matrices=False)[2][:2]
    vt *= np.sign(vt[np.arange(2), np.abs(vt).argmax(1)])[:, None]
    for (k, *_), p in zip(rows, centred @ vt.T):
        assert abs(got[k].PC1 - p[0]) < 1e-9 and abs(got[k].PC2 - p[1]) < 1e-9


def test_exploration_parts_are_lazy(spark, monkeypatch):
    from encore.plans import pipelines
    table = spark.createDataFrame([(f"a{i}", i, float(i % 3)) for i in range(9)], "artist string, n long, v double")
    for name in ("kmeans_clusters", "spearman", "describe", "histogram"):
        monkeypatch.setattr(explore, name, lambda *a, **k: pytest.fail("not asked for"))
    found = pipelines.explore_features(table)
    assert {tuple(r) for r in found["profile"].collect()} == {("artist", 9, "string"), ("n", 9, "bigint"), ("v", 9, "double")}
    with pytest.raises(KeyError):
        found["nothing"]
