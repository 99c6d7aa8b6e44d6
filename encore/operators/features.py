"""Per-artist behavioural features (FLT1-7, AGG1-10, WIN1, WIN3, JN1, PIPE1).

Scale notes
-----------
* Every aggregate is written so Spark can combine map-side (count, sum,
  min, max), so a hot artist holding a third of all plays never lands in
  one task as raw rows.
* ``count(distinct track) > 1`` is written ``min(track) <> max(track)``:
  same truth value (both ignore NULL), but it is a plain partial
  aggregate instead of a distinct-aggregate with an Expand.
* Revisits take ``lag`` over *distinct days* per artist, not over plays:
  the same gaps, but a hot artist contributes at most one row per day to
  the window instead of all of its plays.
* ``features`` scans the plays once: one map-side-combined pre-aggregate
  to (scope, artist, day, album, track) is materialised once and feeds all
  feature branches; each branch ends hash-partitioned by
  (scope, artist), so the left-join chain runs without re-shuffling its
  inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.constants import (ALBUM, ARTIST, COMPLETED_REASON, INTENTIONAL_REASONS,
                              PLAY_COLUMNS, REVISIT_GAP_DAYS, TRACK)
from encore.functions.columns import day_gap, flag, month_key, ratio
from encore.operators.ranking import range_sorted, require_scope
from encore.session import stored


def _keys(scope, *cols):
    return [*scope, *cols]


# ---------------------------------------------------------------- filters ---

def project_plays(plays: DataFrame, columns=PLAY_COLUMNS) -> DataFrame:
    """PRJ1: fixed projection; Catalyst prunes it further per query."""
    return plays.select(*columns)


def drop_podcasts(plays: DataFrame, artist: str = ARTIST) -> DataFrame:
    """FLT1: drop rows without an artist (podcasts); pushed to the scan."""
    return plays.where(F.col(artist).isNotNull())


def keep_complete(plays: DataFrame, cols) -> DataFrame:
    """FLT2: keep rows where all of ``cols`` are non-null."""
    return plays.dropna(how="any", subset=list(cols))


def drop_all_null(plays: DataFrame, cols) -> DataFrame:
    """FLT3: drop rows where all of ``cols`` are NULL."""
    return plays.dropna(how="all", subset=list(cols))


def intentional_flag(reason_start="reason_start"):
    """FLT4: 1/0/NULL for an intentional start."""
    return flag(F.col(reason_start).isin(*INTENTIONAL_REASONS))


def completed_flag(reason_end="reason_end"):
    """FLT5: 1/0/NULL for a play that ran to the end."""
    return flag(F.col(reason_end) == F.lit(COMPLETED_REASON))


# ------------------------------------------------------ single aggregates ---

def play_counts(plays: DataFrame, scope=(), artist=ARTIST) -> DataFrame:
    """AGG1: plays per artist."""
    return (plays.groupBy(*_keys(scope, artist))
            .agg(F.count(F.lit(1)).alias("play_count_per_artist")))


def distinct_counts(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM,
                    track=TRACK, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """AGG2: distinct albums and distinct tracks per artist (NULLs not counted).

    Exact: two one-key partial aggregates joined on the artist instead of
    a two-column distinct aggregate (which would triple the rows with an
    Expand before the shuffle).  ``approx=True``: one pass of HyperLogLog++
    sketches (``approx_count_distinct``, relative error ``rsd``) merged
    map-side, no distinct shuffle at all.
    """
    k = _keys(scope, artist)
    if approx:
        return plays.groupBy(*k).agg(
            F.approx_count_distinct(album, rsd).alias("unique_albums_for_artist"),
            F.approx_count_distinct(track, rsd).alias("num_unique_songs_for_artist"))
    albums = (plays.select(*k, album).distinct()
              .groupBy(*k).agg(F.count(album).alias("unique_albums_for_artist")))
    tracks = (plays.select(*k, track).distinct()
              .groupBy(*k).agg(F.count(track).alias("num_unique_songs_for_artist")))
    return albums.join(tracks, k, "full")


def month_sketches(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM, track=TRACK, ts="ts",
                   lg_k: int = 12) -> DataFrame:
    """AGG2, approximate and incremental: a HyperLogLog sketch of albums and of tracks per
    artist and month (at most 2**lg_k registers, relative standard error about
    1.04 / sqrt(2**lg_k)).  Sketches of any months merge, so a stored table is extended by
    the new months' plays alone."""
    return (plays.groupBy(*_keys(scope, artist), month_key(ts).alias("year_month"))
            .agg(F.hll_sketch_agg(album, lg_k).alias("albums"), F.hll_sketch_agg(track, lg_k).alias("tracks")))


def sketched_counts(sketches: DataFrame, scope=(), artist=ARTIST) -> DataFrame:
    """AGG2 from :func:`month_sketches`: estimated distinct albums and tracks per artist."""
    return sketches.groupBy(*_keys(scope, artist)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("albums")).alias("unique_albums_for_artist"),
        F.hll_sketch_estimate(F.hll_union_agg("tracks")).alias("num_unique_songs_for_artist"))


def multi_track_albums(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM,
                       track=TRACK) -> DataFrame:
    """AGG3 + FLT6: distinct tracks per (artist, album), only groups with > 1."""
    k = _keys(scope, artist, album)
    return (plays.select(*k, track).distinct()
            .groupBy(*k).agg(F.count(track).alias("num_tracks"))
            .where(F.col("num_tracks") > 1)
            .withColumnRenamed(album, "album_name"))


def true_album_counts(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM,
                      track=TRACK) -> DataFrame:
    """AGG4: albums with more than one distinct track, per artist.

    ``count(album)`` so a qualifying NULL-album group counts 0 while the
    artist is still present; artists with no qualifying group are absent.
    """
    k = _keys(scope, artist)
    return (plays.groupBy(*k, album)
            .agg((F.min(track) != F.max(track)).alias("_multi"))
            .where(F.col("_multi"))
            .groupBy(*k).agg(F.count(album).alias("num_true_albums")))


def listening_consistency(plays: DataFrame, scope=(), artist=ARTIST, track=TRACK,
                          ts="ts") -> DataFrame:
    """AGG5: months (``YYYY-MM``) with more than one distinct track."""
    k = _keys(scope, artist)
    return (plays.groupBy(*k, month_key(ts).alias("year_month"))
            .agg((F.min(track) != F.max(track)).alias("_multi"))
            .where(F.col("_multi"))
            .groupBy(*k).agg(F.count(F.lit(1)).alias("listening_consistency")))


def active_months(plays: DataFrame, scope=(), artist=ARTIST, ts="ts") -> DataFrame:
    """AGG6: distinct active months per artist (older definition)."""
    k = _keys(scope, artist)
    return (plays.select(*k, month_key(ts).alias("year_month")).distinct()
            .groupBy(*k).agg(F.count(F.lit(1)).alias("active_months")))


def skip_rates(plays: DataFrame, scope=(), artist=ARTIST, skipped="skipped") -> DataFrame:
    """AGG7: mean of a nullable boolean; NULLs ignored."""
    return (plays.groupBy(*_keys(scope, artist))
            .agg(F.avg(flag(F.col(skipped))).alias("skip_rate")))


def intentional_rates(plays: DataFrame, scope=(), artist=ARTIST,
                      reason_start="reason_start") -> DataFrame:
    """AGG8: SUM(pred)/COUNT(*): NULL reasons count in the denominator only."""
    return (plays.groupBy(*_keys(scope, artist))
            .agg(ratio(F.sum(intentional_flag(reason_start)), F.count(F.lit(1)))
                 .alias("intentional_listening_rate")))


def completion_rates(plays: DataFrame, scope=(), artist=ARTIST,
                     reason_end="reason_end") -> DataFrame:
    """AGG9: SUM(pred)/COUNT(*) for completed plays."""
    return (plays.groupBy(*_keys(scope, artist))
            .agg(ratio(F.sum(completed_flag(reason_end)), F.count(F.lit(1)))
                 .alias("completion_rate")))


def revisit_counts(plays: DataFrame, scope=(), artist=ARTIST, ts="ts",
                   gap_days: int = REVISIT_GAP_DAYS) -> DataFrame:
    """AGG10 + WIN1 + FLT7: consecutive-play gaps of more than ``gap_days`` days.

    Gaps between consecutive plays are the gaps between consecutive
    distinct play days (same-day pairs are 0), so the window runs over
    distinct (artist, day) rows.  Artists without a revisit are absent.
    """
    k = _keys(scope, artist)
    days = plays.select(*k, F.to_date(ts).alias("_day")).distinct()
    w = Window.partitionBy(*k).orderBy("_day")
    return (days.withColumn("_gap", day_gap(F.lag("_day").over(w), F.col("_day")))
            .where(F.col("_gap") > gap_days)
            .groupBy(*k).agg(F.count(F.lit(1)).alias("revisit_rate")))


def partition_totals(plays: DataFrame, scope=(), artist=ARTIST) -> DataFrame:
    """WIN3: each play beside its artist's total, as aggregate + join.

    ``count(*) over (partition by artist)`` would buffer a hot artist in one
    task; the grouped count combines map-side and the join back is a
    one-row-per-key build side (broadcast by AQE when small, skew-split
    otherwise).
    """
    k = _keys(scope, artist)
    totals = plays.groupBy(*k).agg(F.count(F.lit(1)).alias("total_plays"))
    return plays.select(*k).join(totals, k, "inner")


# --------------------------------------------------------------- PIPE1 -----

def play_rollup(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM, track=TRACK,
                ts="ts", reason_start="reason_start", reason_end="reason_end",
                skipped="skipped") -> DataFrame:
    """One row per (scope, artist, day, album, track) with additive counters.

    Every PIPE1 feature is derivable from these rows; the shuffle that
    builds them carries map-side-combined rows only.
    """
    return (drop_podcasts(require_scope(plays, scope), artist)
            .groupBy(*scope, artist, F.to_date(ts).alias("day"), album, track)
            .agg(F.count(F.lit(1)).alias("n_plays"),
                 F.sum(intentional_flag(reason_start)).alias("n_intent"),
                 F.sum(completed_flag(reason_end)).alias("n_done"),
                 F.sum(flag(F.col(skipped))).alias("n_skip"),
                 F.count(skipped).alias("n_skip_known")))


FEATURE_COLUMNS = ["play_count_per_artist", "unique_albums_for_artist",
                   "num_unique_songs_for_artist", "completion_rate",
                   "intentional_listening_rate", "skip_rate", "listening_consistency",
                   "num_true_albums", "revisit_rate"]


def features(plays: DataFrame, scope=(), artist=ARTIST, album=ALBUM, track=TRACK,
             ts="ts", reason_start="reason_start", reason_end="reason_end",
             skipped="skipped", materialise: bool = True) -> DataFrame:
    """PIPE1: the wide per-artist feature table (F7), one row per artist.

    ``materialise=True`` (default) writes the rollup once: right when
    the plays are expensive to re-read (JSON, joins).  For a columnar play
    table ``False`` is cheaper at scale: each branch then scans only its
    own columns with map-side aggregation and nothing is written.

    Four two-level aggregates over the rollup: (artist, track) gives play
    counts, the three rates and distinct tracks; (artist, album) gives
    distinct and multi-track albums; (artist, month) the consistency;
    (artist, day) the revisits.  JN1: the play-count table is the left
    side of a left-join chain, so features an artist lacks (no multi-track
    month, no multi-track album, no revisit) are NULL.
    """
    r = play_rollup(plays, scope, artist, album, track, ts, reason_start, reason_end, skipped)
    if materialise:
        # Catalyst prunes a shared aggregate differently in every branch, so
        # without this each branch would rescan the plays; the rollup is
        # written once to the shared folder, by columns, and read by all four branches.
        r = stored(r, "play-rollup")
    k = _keys(scope, artist)
    # (artist, track): the additive counters ride along the distinct-track
    # grouping, so play counts, rates and distinct tracks share two levels.
    by_track = (r.groupBy(*k, track).agg(
        F.sum("n_plays").alias("n_plays"), F.sum("n_done").alias("n_done"),
        F.sum("n_intent").alias("n_intent"), F.sum("n_skip").alias("n_skip"),
        F.sum("n_skip_known").alias("n_skip_known"))
        .groupBy(*k).agg(
        F.sum("n_plays").alias("play_count_per_artist"),
        F.count(track).alias("num_unique_songs_for_artist"),
        ratio(F.sum("n_done"), F.sum("n_plays")).alias("completion_rate"),
        ratio(F.sum("n_intent"), F.sum("n_plays")).alias("intentional_listening_rate"),
        ratio(F.sum("n_skip"), F.sum("n_skip_known")).alias("skip_rate")))
    # (artist, album): distinct albums and multi-track ("true") albums
    by_album = (r.groupBy(*k, album).agg((F.min(track) != F.max(track)).alias("_multi"))
                .groupBy(*k).agg(
                    F.count(album).alias("unique_albums_for_artist"),
                    F.when(F.max(F.col("_multi").cast("int")) == 1,
                           F.count(F.when(F.col("_multi"), F.col(album))))
                    .alias("num_true_albums")))
    consistency = listening_consistency(r, scope, artist, track, ts="day")
    revisits = revisit_counts(r, scope, artist, ts="day")
    out = (by_track.join(by_album, k, "left")
           .join(consistency, k, "left")
           .join(revisits, k, "left"))
    return out.select(*k, *FEATURE_COLUMNS)


TIE_CHUNK = 1 << 20


def previous_play(plays: DataFrame, scope=(), artist=ARTIST, ts="ts",
                  tie_chunk: int = TIE_CHUNK) -> DataFrame:
    """WIN1 + SCL2: each play with the previous play time of its artist and the
    day-boundary gap (``LAG(ts) OVER (PARTITION BY artist ORDER BY ts)``).

    Output is one row per play: (scope, artist, ts, prev_timestamp,
    difference_days).  Plays sharing a timestamp are interchangeable, so
    the work runs on distinct (artist, ts) with a multiplicity: the first
    copy gets the previous distinct time, the others their own time.
    The lag itself is distributed: distinct times are range-partitioned on
    (scope, artist, ts), lagged inside each range partition, and the first
    row of a partition takes the last time of the same artist from the
    previous partitions (a table of one row per (artist, partition)).  A
    hot artist is therefore spread over many tasks.
    """
    k = _keys(scope, artist)
    distinct = drop_podcasts(plays, artist).groupBy(*k, ts).agg(F.count(F.lit(1)).alias("_c"))
    r = range_sorted(distinct, [F.col(ts).asc()], k)
    local = r.withColumn("_prev", F.lag(ts).over(Window.partitionBy(*k, "_pid").orderBy("_mid")))
    seg = r.groupBy(*k, "_pid").agg(F.max(ts).alias("_last"))
    seg = seg.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*k).orderBy("_pid")))
    joined = local.join(seg.select(*k, "_pid", "_carry"), [*k, "_pid"], "left")
    first_prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    # Re-expand each distinct time to its plays.  Every array holds at most
    # ``tie_chunk`` rows: when some (artist, ts) has more plays than that
    # (checked on the materialised distinct table), it is cut into chunks
    # that are spread over tasks before the rows are generated.
    base = joined.select(*k, ts, first_prev.alias("_first_prev"), "_c")
    if (r.agg(F.max("_c")).first()[0] or 0) > tie_chunk:
        chunks = (base.select("*", F.explode(F.sequence(
            F.lit(0), F.floor((F.col("_c") - 1) / tie_chunk).cast("long"))).alias("_chunk"))
                  .repartition(*k, ts, "_chunk"))
    else:
        chunks = base.withColumn("_chunk", F.lit(0).cast("long"))
    lo = F.col("_chunk") * tie_chunk + 1
    hi = F.least(F.col("_c"), (F.col("_chunk") + 1) * tie_chunk)
    out = (chunks.select(*k, ts, "_first_prev", F.explode(F.sequence(lo, hi)).alias("_i"))
           .withColumn("prev_timestamp",
                       F.when(F.col("_i") == 1, F.col("_first_prev")).otherwise(F.col(ts))))
    return out.select(*k, ts, "prev_timestamp",
                      day_gap(F.col("prev_timestamp"), F.col(ts)).cast("long")
                      .alias("difference_days"))
