"""JSON export scan, incremental ingest and sinks."""

import json
import os

from pyspark.sql import functions as F

from conftest import play
from encore.constants import PLAY_COLUMNS
from encore.operators import digest
from encore.sources import sinks, tables
from encore.streaming.ingest import append_new_plays, ingest_exports


def write_export(path, rows, drop=()):
    out = []
    for r in rows:
        d = {k: (v.strftime("%Y-%m-%dT%H:%M:%SZ") if k == "ts" else v)
             for k, v in r.items() if k not in drop}
        d["extra_column"] = "ignored"
        out.append(d)
    with open(path, "w") as f:
        json.dump(out, f)


def test_json_exports_union_by_name(spark, tmpdir_path):
    write_export(os.path.join(tmpdir_path, "a.json"),
                 [play("A", "t", "x", "2020-01-01 10:00:00")])
    write_export(os.path.join(tmpdir_path, "b.json"),
                 [play("B", "u", "y", "2021-01-01 23:30:00")], drop=("platform", "skipped"))
    df = tables.read_play_history(spark, os.path.join(tmpdir_path, "*.json"))
    assert df.columns == PLAY_COLUMNS
    rows = {r["master_metadata_album_artist_name"]: r for r in df.collect()}
    assert rows["B"]["platform"] is None and rows["B"]["skipped"] is None
    assert rows["A"]["platform"] == "ios"
    assert str(rows["B"]["ts"]) == "2021-01-01 23:30:00"     # 'Z' read as UTC, session UTC


def test_union_exports(spark):
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    b = spark.createDataFrame([(2, "y")], "k long, b string")
    u = tables.union_exports([a, b])
    assert sorted(u.columns) == ["a", "b", "k"] and u.count() == 2
    assert tables.union_exports([a, a], dedupe=True).count() == 1


def test_incremental_ingest(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    out = os.path.join(tmpdir_path, "table")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    write_export(os.path.join(src, "1.json"), [play("A", "t", "x", "2020-01-01 10:00:00"),
                                               play("A", "u", "x", "2020-02-01 10:00:00")])
    ingest_exports(spark, src, out, ckpt)
    assert spark.read.parquet(out).count() == 2
    write_export(os.path.join(src, "2.json"), [play("B", "t", "x", "2021-03-01 10:00:00")])
    ingest_exports(spark, src, out, ckpt)
    df = spark.read.parquet(out)
    assert df.count() == 3                       # old file not re-read
    assert {r["year"] for r in df.select("year").collect()} == {2020, 2021}


def test_save_table_and_view(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    sinks.save_table(df, "encore_test_table")
    sinks.save_table(df, "encore_test_table")    # re-runnable: overwrite
    assert spark.table("encore_test_table").count() == 2
    sinks.register_view(df, "encore_view")
    assert spark.sql("SELECT sum(k) AS s FROM encore_view").first()["s"] == 3


def test_write_digests_per_scope(spark, tmpdir_path):
    ev = spark.createDataFrame(
        [(1, "A", 1, 1, "e1", "Show", "u", "i", "2026-07-01", "V", "C", "Addr"),
         (2, "B", 1, 1, "e2", "Gig", "u", "i", "2026-07-02", "V", "C", None)],
        "user_id long, searched_artist string, artist_rank int, event_position int, "
        "event_id string, artist_name string, ticket_link string, artist_image string, "
        "concert_date string, venue string, city string, address string")
    docs = digest.digest(ev, scope=["user_id"], as_of="2026-06-07")
    path = os.path.join(tmpdir_path, "digests")
    sinks.write_digests(docs, path, scope=["user_id"])
    parts = sorted(d for d in os.listdir(path) if d.startswith("user_id="))
    assert parts == ["user_id=1", "user_id=2"]


def test_digest_packs_are_found_by_their_index(spark, tmpdir_path):
    rows = [(i, f"n{i % 3}", f"<p>{'é' * (i * 7 % 50)}\n{i}</p>") for i in range(200)] + [(200, "n0", "")]
    docs = spark.createDataFrame(rows, "user_id long, name string, html string").repartition(5)
    path = sinks.write_digest_packs(docs, os.path.join(tmpdir_path, "packs"), ["user_id", "name"], pack_bytes=1000)
    assert sorted(map(tuple, sinks.read_digest_packs(spark, path).collect())) == sorted(rows)
    total = sum(len(h.encode()) + 1 for *_, h in rows)
    files = [f for d, _, names in os.walk(f"{path}/packs") for f in names if f.startswith("part-")]
    assert total / 1200 <= len(files) <= total / 1000 + 1
    one = sinks.read_digest_packs(spark, path, F.col("user_id") == 7).collect()
    assert [tuple(r) for r in one] == [rows[7]]
    assert sinks.read_digest_packs(spark, path, F.col("user_id") == -7).count() == 0
    with open(os.path.join(path, "packs", spark.read.parquet(f"{path}/index").where("user_id = 9").first()["file"]), "rb") as f:
        at = spark.read.parquet(f"{path}/index").where("user_id = 9").first()
        f.seek(at["offset"])
        assert f.read(at["length"]).decode() == rows[9][2]


def test_bucketed_tables_join_without_exchange_and_go(spark):
    from encore.plans.catalog import bucketed_join
    f = spark.range(500).select(F.concat(F.lit("a"), "id").alias("master_metadata_album_artist_name"), "id")
    r = spark.range(0, 900, 2).select(F.concat(F.lit("a"), "id").alias("artist_name"), (F.col("id") * 2).alias("v"))
    with sinks.saved_tables(spark, "t_features", "t_recency") as names:
        out = bucketed_join(spark, f, r, names)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 500 and out.where("v <> 2 * id").count() == 0 and out.where("v IS NULL").count() == 250
        assert all(spark.catalog.tableExists(n) for n in names)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_ingest_adds_each_play_once(spark, tmpdir_path):
    src, out, ckpt = (os.path.join(tmpdir_path, n) for n in ("src", "table", "ckpt"))
    os.makedirs(src)
    a = play("A", "t", "x", "2020-01-31 23:59:59")
    b = play("A", None, None, "2020-02-01 00:00:00", reason_end=None)
    c = play("B", "u", "y", "2021-03-01 10:00:00")
    write_export(os.path.join(src, "1.json"), [a, b, b])
    ingest_exports(spark, src, out, ckpt, dedupe=True)
    assert spark.read.parquet(out).count() == 2
    write_export(os.path.join(src, "2.json"), [b, c, {**a, "shuffle": True}])
    ingest_exports(spark, src, out, ckpt, dedupe=True)
    ingest_exports(spark, src, out, ckpt, dedupe=True)
    df = spark.read.parquet(out)
    assert df.count() == 4 and df.select("year", "month").distinct().count() == 3
    # a batch tried again after its files were written adds nothing
    append_new_plays(df, out, PLAY_COLUMNS)
    assert spark.read.parquet(out).count() == 4


def test_exports_are_written_compressed(spark, tmpdir_path):
    import glob

    from encore.plans import catalog
    from encore.session import ensure_checkpoint_dir
    base = f"{tmpdir_path}/tables"
    spark.sql("""SELECT id AS l_orderkey, id AS l_partkey, 1 AS l_linenumber, 2D AS l_quantity, 0.1D AS l_discount,
                 'R' AS l_returnflag, 'F' AS l_linestatus FROM range(6)""").write.parquet(f"{base}/lineitem.parquet")
    spark.sql("""SELECT id AS o_orderkey, id AS o_custkey, TIMESTAMP_NTZ '1998-03-01' + make_dt_interval(90 * (id - 3))
                 AS o_orderdate, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM range(6)
                 """).write.parquet(f"{base}/orders.parquet")
    spark.sql("SELECT id AS p_partkey, 'b' AS p_brand FROM range(6)").write.parquet(f"{base}/part.parquet")
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/overlapping-exports-*"))
    rows = catalog.QUERIES["set4_overlapping_exports"](spark, base).collect()
    [path] = set(glob.glob(f"{root}/overlapping-exports-*")) - before
    files = glob.glob(f"{path}/exports/*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    days = sorted(str(r.ts.date()) for r in rows)
    assert days == ["1997-06-04", "1997-09-02", "1997-12-01", "1998-03-01", "1998-03-01", "1998-05-30", "1998-05-30",
                    "1998-08-28"]


def play_tables(spark, path, orders=((1, 10, "1997-12-31"), (2, 11, "1998-01-01"))):
    """Small orders, line items and parts; every order has lines 1 and 2."""
    spark.createDataFrame([(k, c, "O", d, "1-URGENT") for k, c, d in orders],
                          "o_orderkey long, o_custkey long, o_orderstatus string, d string, o_orderpriority string"
                          ).selectExpr("*", "CAST(d AS TIMESTAMP_NTZ) AS o_orderdate").drop("d").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, 5, n, 3.0, 0.1, "R", "F") for k in sorted({o[0] for o in orders}) for n in (1, 2)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, "
                          "l_returnflag string, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(5, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")


def test_exported_batches_are_small_and_made_from_one_copy(spark, tmpdir_path):
    from encore.plans import catalog
    play_tables(spark, tmpdir_path)
    out = catalog.QUERIES["src1_json_union_by_name"](spark, tmpdir_path)
    assert out.inputFiles() and all(f.endswith(".json.gz") for f in out.inputFiles())
    assert sorted((str(r.ts), r.platform, r.master_metadata_album_artist_name) for r in out.collect()) == [
        ("1997-12-31 00:00:00", "O", "Customer#000000010"), ("1997-12-31 23:59:59", "O", "Customer#000000010"),
        ("1998-01-01 00:00:00", None, "Customer#000000011"), ("1998-01-01 23:59:59", None, "Customer#000000011")]


def test_orders_meet_listeners_before_line_items(spark, tmpdir_path):
    from encore.plans import stand_in
    play_tables(spark, tmpdir_path, [(1, 10, "1997-12-31"), (2, 11, "1998-01-01"), (4, 12, "1998-01-01")])
    spark.createDataFrame([(0, 7), (1, 8), (1, 8), (None, 9)], "event_id long, user_id long").write.parquet(f"{tmpdir_path}/events.parquet")
    out = stand_in.listener_plays(spark, tmpdir_path)
    assert out.columns[-1] == "user_id"
    assert sorted((r.user_id, r.master_metadata_album_artist_name[-2:]) for r in out.collect()) == sorted(
        [(7, "12")] * 2 + [(8, "10")] * 4)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert "event_id" in joins[-1]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_stages_leave_no_shuffle_files(spark):
    import time

    from encore import session
    for write in (session.stored, session.materialise):
        before = shuffle_files(spark)
        out = write(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
        for _ in range(40):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.25)
        assert not left
        assert out.count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
