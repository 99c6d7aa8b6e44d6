"""Chronological event digest (TOP4, SCL16, SCL18, AGG15, WIN7, PIPE6).

The digest input is the matched-event table, bounded by construction
(top-k artists x per-artist cap per scope), so gathering one scope's
cards into a single document row is a bounded collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import html
from encore.functions.columns import long_date

DIGEST_ORDER = ["concert_date", "artist_rank", "event_position"]


def chronological(events: DataFrame, scope=(), order=DIGEST_ORDER) -> DataFrame:
    """TOP4: events by date (ties: artist rank, then the artist's own order),
    numbered per scope."""
    w = Window.partitionBy(*scope).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return events.withColumn("digest_position", F.row_number().over(w).cast("long"))


def event_cards(events: DataFrame, escape: bool = True) -> DataFrame:
    """SCL18: one HTML card per event."""
    return events.withColumn("card_html", html.card(escape))


def digest(events: DataFrame, scope=(), as_of: Column | str | None = None,
           escape: bool = True, order=DIGEST_ORDER) -> DataFrame:
    """PIPE6 + AGG15 + WIN7: one HTML document per scope: the date line, then the
    cards in chronological order with a divider between consecutive cards."""
    if as_of is None:
        day = F.current_date()
    elif isinstance(as_of, str):
        day = F.lit(as_of).cast("date")
    else:
        day = as_of
    keyed = events.select(*scope, *[F.col(c) for c in order], html.card(escape).alias("_card"))
    docs = keyed.groupBy(*scope).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("_card"))))
        .alias("_cards"),
        F.count(F.lit(1)).alias("n_events"))
    cards = F.transform("_cards", lambda x: x["_card"])
    return docs.select(*scope, "n_events",
                       long_date(day).alias("digest_date"),
                       html.document(cards, long_date(day)).alias("html"))
