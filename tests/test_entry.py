"""Driver contract: entry smoke run and every registered query against its
SQL twin at sf0.001 (the driver runs the same comparison at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 50
    assert "artist_name" in df.columns and "rank" in df.columns


def test_every_query_has_oracle_or_is_ml():
    from encore.plans.catalog import QUERIES
    from encore.plans.oracle import ORACLE
    assert set(entry.oracle_sql()) <= set(entry.queries())
    qs, sqls = QUERIES, ORACLE
    assert set(sqls) <= set(qs)
    assert {q for q in qs if q not in sqls} <= {"ml3_cluster_frame"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")
def test_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    from encore.plans.catalog import QUERIES as qs
    from encore.plans.oracle import ORACLE as sqls
    bad = []
    for name, sql in sqls.items():
        df = qs[name](spark, SF)
        cols = df.columns
        got = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)
        res = con.execute(sql)
        ocols = [d[0] for d in res.description]
        perm = [ocols.index(c) for c in cols]
        exp = sorted((tuple(norm(r[i]) for i in perm) for r in res.fetchall()), key=repr)
        if got != exp:
            bad.append(name)
    assert not bad
