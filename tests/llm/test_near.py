"""SimHash, embeddings, mixing and the pipeline against brute force."""

import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from encore.llm import common, embed_dedup, mixing, simhash
from encore.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def groups(nodes, links):
    """Smallest node reachable, by union-find."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)]
    links += [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (3, 2)]
    got = common.connected_components(spark.createDataFrame(links, "a long, b long"))
    want = groups({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {n: want[n] for n in linked}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text, shingle=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_bits():
    for t in (None, "", " \t", "one", "one two", "A b c d a b c d", "x " * 70_000, "\u00c4 \u00e4 \u2003 z"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("run_rows", [simhash.RUN_ROWS, 3])
def test_links_find_all_within_three_bits(spark, run_rows):
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:  # families and chains of near copies
        for _ in range(rnd.randrange(1, 12)):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.variant_links(df, 3, run_rows).collect()
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i]
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert groups(signed, [(r.a, r.b) for r in got]) == groups(signed, near)


def test_components_of_documents(spark):
    docs = read_table(spark, SF, "documents").withColumn("fp", F.lit("x"))
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "  "), (903, "a b"), (903, "a b"), (None, "a b")],
                                  "doc_id long, text string")
    df = docs.select("doc_id", "text", "fp").unionByName(extra, allowMissingColumns=True)
    rows = df.select("doc_id", "text").collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    at = range(len(rows))
    of = groups(at, [(i, j) for i in at for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i in at:
        if rows[i].doc_id is not None:
            least[of[i]] = min(rows[i].doc_id, least.get(of[i], math.inf))
    want = Counter((rows[i].doc_id, fps[i], least.get(of[i])) for i in at)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == want
    kept = simhash.near_dedup(df).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_one_document_of_each_group_without_names(spark):
    import corpus_pipeline as cp
    far = ["one two three four five six", "sun moon star sky cloud rain", "red green blue black white grey"]
    rows = [(5, far[0]), (5, far[1]), (2, far[1]), (7, far[0]), *[(None, far[2])] * 6, (None, far[1]), (5, far[0])]
    assert min((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a in far for b in far if a != b) > 3
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row_key int").repartition(3)
    got = cp.drop_near_copies(spark, df, SF)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, far[0]), (2, far[1]), (None, far[2])])
    clash = spark.createDataFrame([(5, far[0]), (5, far[1])], "doc_id long, text string")
    assert cp.drop_near_copies(spark, clash, SF).count() == 2


# -------------------------------------------------------------- embeddings --

def slow_vectors(rows, cosine=0.93):
    def ok(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    at = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and ok(v)]
    links, near = [], Counter()
    for x in at:
        for y in at:
            a, b = (np.array(rows[k][1], float) for k in (x, y))
            if x != y and rows[x][2] == rows[y][2] and len(a) == len(b) \
                    and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links.append((x, y))
                near[x] += 1
    of = groups(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[of[i]] = min(r[0], least.get(of[i], math.inf))
    return Counter((r[0], near[i], least.get(of[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("cell,block", [(4096, 2048), (12, 7)])
def test_vectors_match_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(9, 8))
    rows = [(i, (centres[i % 9] + rnd.normal(size=8) * rnd.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist(),
             i % 2) for i in range(160)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [], 0), (204, [0.0] * 8, 0),
             (205, [1.0] * 7 + [None], 0), (206, [math.nan] + [1.0] * 7, 0), (207, [math.inf] + [1.0] * 7, 0),
             (208, rows[2][1], None), (209, rows[4][1][:4], 0), (210, rows[4][1][:4], 0),
             (211, [1e-30] * 8, 0), (212, [1e30] * 8, 0), (None, rows[6][1], 0), (None, [9.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows],
                               "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = embed_dedup.embedding_components(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == slow_vectors(
        [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.embedding_components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ mixing --

def test_poisson_inverse_is_the_quantile():
    u = np.array([0.0, 0.1, 0.5, 0.9, 0.999999, 1 - 2**-53])
    for rate in (1e-9, 0.3, 1.0, 7.5, 256.0):
        got = mixing.poisson_inverse(np.full(len(u), rate), u)
        total, k = 0.0, 0
        cdf = []
        while k < rate + 40 * math.sqrt(rate) + 40:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            cdf.append(total)
            k += 1
        want = [next((i for i, c in enumerate(cdf) if x < c), len(cdf)) for x in u[:5]]
        assert np.abs(got[:5] - want).max() <= (1 if rate > 100 else 0)
    big = mixing.draw(np.full(2000, 900.0), np.arange(2000, dtype=np.int64) * 7919)
    assert abs(big.mean() - 900) < 5 and abs(big.var() / 900 - 1) < 0.2


def test_mix_matches_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, f"t{i}", rnd.choice(["a"] * 6 + ["b", "c", None]), 0) for i in range(3000)]
    rows += [(1, "t1", "a", 0), (None, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(4)
    got = mixing.mix(df, alpha=0.5, seed=7).collect()
    n = Counter(r[2] for r in rows)
    per = len(rows) / sum(math.sqrt(x) for x in n.values())
    keys = df.select("doc_id", "text", "source", mixing.row_hash(7, "doc_id", "text").alias("h")).collect()
    want = Counter()
    for r in keys:
        k = int(mixing.draw(np.array([math.sqrt(n[r.source]) * per / n[r.source]]), np.array([r.h]))[0])
        want.update((r.doc_id, r.source, c) for c in range(k))
    assert Counter((r.doc_id, r.source, r.copy) for r in got) == want
    share = Counter(r.source for r in got)
    for s, x in n.items():
        assert abs(share[s] - per * math.sqrt(x)) < 5 * math.sqrt(per * math.sqrt(x))
    again = mixing.mix(df.repartition(2), alpha=0.5, seed=7).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]  # the same global order


def test_mix_weights_and_edges(spark):
    df = spark.createDataFrame([(i, "x", "a" if i % 2 else "b") for i in range(400)],
                               "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix(df, weights={"a": 3.0, "zz": 5.0}, total=600).collect())
    assert set(got) == {"a"} and abs(got["a"] - 600) < 150
    assert mixing.mix(df, weights={}).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"a": -1.0})


# ---------------------------------------------------------------- pipeline --

def test_stages_match_brute_force(spark):
    import corpus_pipeline as cp
    docs = read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(900, "12 34 !!", None, "src0", 8), (901, None, None, None, 0)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra)
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    steps = [docs]
    for name, f in cp.STAGES:
        steps.append(common.stored(f(spark, steps[-1], SF), name))
        if name != "byte_bpe":
            assert steps[-1].columns == docs.columns
    ids = [[r.doc_id for r in s.collect()] for s in steps]
    assert set(ids[0]) - set(ids[1]) == {900, 901}
    rows = steps[1].collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    at = range(len(rows))
    of = groups(at, [(i, j) for i in at for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for i in at:
        least[of[i]] = min(rows[i].doc_id, least.get(of[i], math.inf))
    assert sorted(ids[2]) == sorted(least.values())
    assert set(ids[3]) <= set(ids[2]) and sorted(ids[4]) == sorted(ids[3])
    import hashlib
    text = {r.doc_id: r.text for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in steps[4].collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")
def test_queries_and_their_sql(spark):
    from encore.llm.catalog import ORACLE, QUERIES
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        got = Counter(tuple(r) for r in df.collect())
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert got == Counter(want), name


def test_mix_and_pipeline_leave_columns_alone(spark):
    import corpus_pipeline as cp
    names = ["_n", "_order", "_pid", "_rate", "_source", "copy", "Score", "lang_pred"]
    df = spark.createDataFrame([(i, f"hello there number {i} and more words", "en", "s", *range(8)) for i in range(30)],
                               "doc_id long, text string, lang string, source string, "
                               + ", ".join(f"{n} int" for n in names)).repartition(3)
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, df, SF)
        assert out.schema == df.schema
        assert all(tuple(r)[4:] == tuple(range(8)) for r in out.collect())
    assert mixing.mix(df).columns == [c for c in df.columns if c != "copy"] + ["copy"]


def test_stages_on_empty_and_repeated_rows(spark):
    import corpus_pipeline as cp
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the same words here again", "en", "a", 5)] * 6 + [(2, None, None, None, None), (None, "", "fr", None, 0),
            (3, "le monde est grand et beau", "fr", "b", 9)]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        kept = cp.identify_language(spark, df, SF).collect()
        assert sorted(r.doc_id for r in kept) == ([1] * 6 + [3] if data else [])
        near = cp.drop_near_copies(spark, df, SF).collect()
        assert sorted(r.doc_id for r in near) == ([1, 2, 3] if data else [])
        assert {tuple(r) for r in cp.mix_sources(spark, df, SF).collect()} <= set(data)
        coded = cp.encode_tokens(spark, df, SF).collect()
        assert len(coded) == len(data) and all((r.n_tokens == 0) == (len(r.ids) == 0) for r in coded)


def test_vectors_without_ids_are_apart(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 4)
    rows = [(None, [math.cos(i), math.sin(i)], 1) for i in range(0, 40)] + [(7, [math.cos(3), math.sin(3)], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed_dedup.embedding_components(df, cosine=0.9999).collect()
    assert len(got) == 41 and sum(r.component_id == 7 for r in got) == 2
