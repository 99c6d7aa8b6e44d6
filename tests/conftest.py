import os
import sys
import tempfile
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("encore-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="encore-wh-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from encore.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="encore-test-")


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def play(artist, track, album, when, reason_start="clickrow", reason_end="trackdone",
         skipped=False, user=None):
    row = {"ts": ts(when), "platform": "ios", "ms_played": 1000, "ip_addr": None,
           "master_metadata_track_name": track,
           "master_metadata_album_artist_name": artist,
           "master_metadata_album_album_name": album,
           "spotify_track_uri": None if track is None else f"uri:{track}",
           "reason_start": reason_start, "reason_end": reason_end,
           "shuffle": False, "skipped": skipped}
    if user is not None:
        row["user_id"] = user
    return row


def plays_df(spark, rows, scoped=False):
    from pyspark.sql import types as T
    from encore.schemas import PLAY_SCHEMA
    fields = list(PLAY_SCHEMA.fields)
    if scoped:
        fields = [T.StructField("user_id", T.LongType(), True)] + fields
    schema = T.StructType(fields)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], schema)
