"""Paged ranked lists (SRC4, SRC5, WIN4).

A page row is (scope..., list, page_no, next, items).  Pages are read in
``page_no`` order and reading stops at the first page whose ``next`` is
NULL; the 1-based list position is the index in the concatenated items.
A page that was fetched more than once (equal list and page_no) is read
once (the least items, if they differ); a NULL list or scope is a list of
its own.  Offsets are running sums over page sizes (one narrow row per
page, never the items) inside blocks of BLOCK pages and over the blocks'
totals, so no list is summed in one task; they join back on (list,
page_no), and items are exploded with ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.ranking import BROADCAST_ROWS, broadcast_if_small
from encore.session import materialise, stored

BLOCK = 10_000   # pages whose sizes are summed together


def _kept_pages(pages: DataFrame, scope, list_col: str) -> DataFrame:
    k = [*scope, list_col]
    # a struct is equal to itself even where its fields are NULL
    pages = stored(pages.select(*k, "page_no", "next", "items"), "list-pages")
    key, length = F.struct(*k).alias("_list"), F.coalesce(F.size("items"), F.lit(0)).cast("long")
    # narrow rows say which pages are there; items are grouped only if some page is there twice
    seen = materialise(pages.groupBy(key, "page_no").agg(
        F.count("next").alias("_more"), F.count(F.lit(1)).alias("_copies"), F.max(length).alias("_n")), "list-sizes")
    if seen.where("_copies > 1").isEmpty():
        one = pages.select(key, "page_no", "items")
    else:
        one = materialise(pages.groupBy(key, "page_no").agg(F.min("items").alias("items")), "list-pages")
        seen = seen.drop("_n").join(one.select("_list", "page_no", length.alias("_n")), ["_list", "page_no"])
    last = (seen.where(F.col("_more") < F.col("_copies"))
            .groupBy(F.col("_list").alias("_l")).agg(F.min("page_no").alias("_last")))
    kept = (seen.join(broadcast_if_small(last), F.col("_list") == F.col("_l"), "left")
            .where(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last"))))
    sizes = kept.select("_list", "page_no", F.floor(F.col("page_no") / BLOCK).alias("_block"), "_n")
    inside = (Window.partitionBy("_list", "_block").orderBy("page_no")
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy("_list").orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    blocks = (sizes.groupBy("_list", "_block").agg(F.sum("_n").alias("_n"))
              .select("_list", "_block", F.sum("_n").over(across).alias("_before")))
    offsets = (sizes.withColumn("_inside", F.sum("_n").over(inside)).join(blocks, ["_list", "_block"])
               .select("_list", "page_no", (F.coalesce("_before", F.lit(0))
                                            + F.coalesce("_inside", F.lit(0))).alias("_off")))
    few = seen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (one.join(F.broadcast(offsets) if few else offsets, ["_list", "page_no"])
            .select("_list.*", "_off", "items"))


def flatten_ranked_artists(pages: DataFrame, scope=(), list_col: str = "list") -> DataFrame:
    """SRC4 + WIN4: (scope, list, position, artist_name)."""
    kept = _kept_pages(pages, scope, list_col)
    ex = kept.select(*scope, list_col, "_off", F.posexplode("items").alias("_pos", "_item"))
    return ex.select(*scope, list_col,
                     (F.col("_off") + F.col("_pos") + 1).cast("long").alias("position"),
                     F.col("_item.name").alias("artist_name"))


def flatten_ranked_tracks(pages: DataFrame, scope=(), list_col: str = "list") -> DataFrame:
    """SRC5: (scope, list, position, artist_name, track_name); the first credited
    artist only (NULL when the track lists none)."""
    kept = _kept_pages(pages, scope, list_col)
    ex = kept.select(*scope, list_col, "_off", F.posexplode("items").alias("_pos", "_item"))
    return ex.select(*scope, list_col,
                     (F.col("_off") + F.col("_pos") + 1).cast("long").alias("position"),
                     F.get(F.col("_item.artists"), 0).getField("name").alias("artist_name"),
                     F.col("_item.name").alias("track_name"))
