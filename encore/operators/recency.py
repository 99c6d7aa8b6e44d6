"""Recency signals from ranked lists and the blend (AGG11, AGG16, JN2, JN3,
PRJ6, PRJ8, SCL9-SCL12, WIN5, FLT8, TOP1).

All inputs here are list-sized (a ranked list per time range per scope),
far smaller than the play history; joins to the per-artist score table
are left equi-joins whose build side AQE broadcasts once its runtime
size is known to be under the threshold, and sort-merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.constants import BLEND_WEIGHTS, TOP_ARTISTS
from encore.operators import ranking, scaling
from encore.session import stored

_FLAG = {"short_term": "in_short", "medium_term": "in_medium", "long_term": "in_long"}


def api_presence(ranked: DataFrame, list_name: str = "long_term", scope=()) -> DataFrame:
    """WIN5 + AGG16: presence score from one ranked list: (n - rank) / (n - 1)."""
    # the list length comes from a per-list count joined back in the plan
    one = ranked.where(F.col("list") == list_name).select(*scope, "list", "artist_name",
                                                          "position")
    return (ranking.presence_score(one, "position", [*scope, "list"], "api_presence_score")
            .select(*scope, "artist_name", "api_presence_score"))


def time_range_consistency(ranked: DataFrame, scope=()) -> DataFrame:
    """JN3 + PRJ8 + FLT8 + SCL11: share of the three lists an artist appears in.

    Two full outer joins with the key coalesced (``join(on=...)``); NULL
    names are dropped first so they cannot match each other.
    """
    k = [*scope, "artist_name"]
    frames = {}
    for lst, flag in _FLAG.items():
        frames[flag] = (ranked.where((F.col("list") == lst) & F.col("artist_name").isNotNull())
                        .select(*k).distinct().withColumn(flag, F.lit(1)))
    both = (frames["in_long"].join(frames["in_medium"], k, "full")
            .join(frames["in_short"], k, "full")
            .fillna(0, subset=list(_FLAG.values())))
    return both.withColumn(
        "time_range_consistency",
        (F.col("in_short") + F.col("in_medium") + F.col("in_long")) / 3.0)


def track_breadth(tracks: DataFrame, list_name: str = "long_term", scope=()) -> DataFrame:
    """AGG11 + PRJ6 + AGG12 + SCL12: distinct track names per artist in a
    top-track list, divided by the largest such count."""
    k = [*scope, "list", "artist_name"]
    per = (tracks.where((F.col("list") == list_name) & F.col("artist_name").isNotNull())
           .select(*k, "track_name").distinct()
           .groupBy(*k).agg(F.count("track_name").alias("track_breadth")))
    per = stored(per, "track-breadth")  # counts and their maximum read it
    # the maximum is per list, joined back in the plan
    return (scaling.max_normalise(per, "track_breadth", "track_breadth_score", [*scope, "list"])
            .drop("list"))


def blend(scores: DataFrame, presence: DataFrame, breadth: DataFrame,
          consistency: DataFrame, scope=(), weights=None) -> DataFrame:
    """JN2 + FLT8 + SCL9: left-join the three recency features onto the score
    table, NULL -> 0 on the four inputs, weighted blend."""
    weights = weights or BLEND_WEIGHTS
    k = [*scope, "artist_name"]
    df = (scores.join(presence.select(*k, "api_presence_score"), k, "left")
          .join(breadth.select(*k, "track_breadth_score"), k, "left")
          .join(consistency.select(*k, "time_range_consistency"), k, "left"))
    df = df.fillna(0, subset=list(weights))
    return scaling.weighted_score(df, weights, "blended_score")


BLEND_OUTPUT = ["artist_name", "superfan_score", "api_presence_score",
                "time_range_consistency", "track_breadth_score", "blended_score"]


def top_blended(blended: DataFrame, n: int = TOP_ARTISTS, scope=()) -> DataFrame:
    """TOP1: the ``n`` highest blended scores (ties by name), with their order.

    Without a scope this is a TakeOrderedAndProject; with one, a per-scope
    WindowGroupLimit.
    """
    order = [F.col("blended_score").desc_nulls_last(), F.col("artist_name").asc()]
    if scope:
        return ranking.top_k_per_group(blended, scope, order, n, out="blend_rank")
    # the window below sees only the n rows left by the top-k
    return (ranking.top_k(blended, order, n)
            .withColumn("blend_rank", F.row_number().over(Window.orderBy(*order)).cast("long")))
