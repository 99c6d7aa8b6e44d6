"""Match ranked artists against an event catalogue (JN5-JN8, SCL17, TOP5, PIPE5).

Per-artist search calls become one distributed join:

* JN8 category filters and the JN7 radius are column predicates applied to
  the catalogue first (pushed to the scan where the columns are stored);
* JN6 keyword match without a cross product: names are lower-cased and
  split into word tokens; each artist is blocked on its *rarest* pair of
  adjacent tokens (its token if it has one only; document frequency over the
  filtered catalogue), which every matching event must contain, so blocking is
  exact.  The artist side is broadcast where it is counted to be small; beyond
  that rows of key and event number are shuffled, and a key that many events
  hold is split.  Each candidate is verified on its event, which it meets by number;
* each distinct artist name is matched once, however many listeners'
  lists hold it, and the (listener, artist) pairs join back afterwards;
* TOP5 keeps at most ``per_artist`` events per artist with a
  WindowGroupLimit (a per-task top-k before the shuffle); what the match and the
  cap do not read joins back to the events that are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.constants import (EARTH_RADIUS, EVENT_CLASSIFICATION, EVENT_COUNTRY, EVENT_GEOHASH,
                              EVENT_RADIUS, EVENT_RADIUS_UNIT, EVENT_SOURCE, EVENTS_PER_ARTIST)
from encore.functions.geo import geohash_centre, haversine
from encore.operators.ranking import BROADCAST_ROWS, split_join, top_k_per_group
from encore.operators.spatial import near_centres
from encore.session import stored

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def name_tokens(c) -> Column:
    """SCL17: lower-cased word tokens of a name (empty pieces removed)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != F.lit(""))


def normalised(c) -> Column:
    """Token sequence joined by single spaces."""
    return F.array_join(name_tokens(c), " ")


def category_filter(catalogue: DataFrame, classification=EVENT_CLASSIFICATION,
                    country=EVENT_COUNTRY, source=EVENT_SOURCE) -> DataFrame:
    """JN8: music events in one country from the primary ticket source."""
    cond = F.lit(True)
    if classification is not None:
        cond = cond & (F.lower(F.col("classification")) == classification.lower())
    if country is not None:
        cond = cond & (F.col("country") == country)
    if source is not None:
        cond = cond & (F.col("source") == source)
    return catalogue.where(cond)


def radius_filter(catalogue: DataFrame, geohash: str = EVENT_GEOHASH,
                  radius: float = EVENT_RADIUS, unit: str = EVENT_RADIUS_UNIT) -> DataFrame:
    """JN7: events within ``radius`` of the centre of a geohash cell.

    A latitude band (exact: one degree of latitude is a fixed distance)
    is applied first as a cheap pushable range predicate, then the exact
    great-circle distance.
    """
    lat0, lon0 = geohash_centre(geohash)
    band = math.degrees(radius / EARTH_RADIUS[unit])
    dist = haversine("latitude", "longitude", lat0, lon0, unit)
    return (catalogue.where(F.col("latitude").between(lat0 - band, lat0 + band))
            .withColumn("distance", dist)
            .where(F.col("distance") <= radius))


def keyword_match(artists: DataFrame, catalogue: DataFrame, artist_col: str = "artist_name",
                  event_col: str = "event_name", mode: str = "contains",
                  max_edits: int = 1, event_key: str | None = None) -> DataFrame:
    """JN5 + JN6: every (artist, event) pair whose names match.

    ``mode="exact"``: equal token sequences (an equi-join on the normalised
    name).  ``mode="contains"``: the artist's token sequence occurs
    contiguously in the event name's (whole-word containment).
    ``mode="fuzzy"``: some run of as many consecutive event-name words as
    the artist name has is within ``max_edits`` character edits of it
    (``event_key`` names the catalogue key used to report a pair once).
    The artist side is broadcast only if it has at most ``BROADCAST_ROWS``
    rows (counted); beyond that Spark/AQE choose the join from the measured
    size.  ``contains`` writes the catalogue and splits its names into keys once.
    """
    # the artist list feeds three branches below; it is written once
    a = stored(artists.withColumn("_anorm", normalised(artist_col))
               .where(F.length("_anorm") > 0), "match-artists")
    few = a.count() <= BROADCAST_ROWS

    def side(df):
        return F.broadcast(df) if few else df

    if mode == "exact":
        c = catalogue.withColumn("_anorm", normalised(event_col))
        return c.join(side(a), "_anorm").drop("_anorm")
    if mode == "fuzzy":
        return _fuzzy_match(a, catalogue, artist_col, event_col, max_edits, event_key, side)
    if mode != "contains":
        raise ValueError(f"unknown match mode {mode!r}")
    # the keys and the candidates' events read the catalogue
    catalogue = stored(catalogue.withColumn("_event", F.monotonically_increasing_id()), "match-events")
    own, seen = name_tokens(artist_col), name_tokens(event_col)
    a_key = a.select("*", F.explode(F.array_distinct(F.when(F.size(own) > 1, adjacent(own)).otherwise(own)))
                     .alias("_key"))
    # events by key, only keys that occur in artist names (a semi-join against that set)
    keys = a_key.select("_key").distinct()
    c = stored(catalogue.select("_event", F.explode(F.array_distinct(F.concat(seen, adjacent(seen)))).alias("_key"))
               .join(side(keys), "_key", "left_semi"), "match-event-keys")
    df_key = c.groupBy("_key").agg(F.count(F.lit(1)).alias("_df"))
    # rarest key per artist (ties by text); one absent from the catalogue has
    # frequency 0 and correctly blocks everything.
    block = (a_key.join(df_key, "_key", "left")
             .withColumn("_df", F.coalesce("_df", F.lit(0)))
             .groupBy(*artists.columns, "_anorm")
             .agg(F.min_by("_key", F.struct("_df", "_key")).alias("_key")))
    cand = stored(c.join(F.broadcast(block), "_key") if few
                  else split_join(c, stored(block, "match-keys"), ["_key"]), "match-candidates")
    near = cand.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cand = catalogue.join(F.broadcast(cand) if near else cand, "_event")
    hay = F.concat(F.lit(" "), F.array_join(seen, " "), F.lit(" "))
    needle = F.concat(F.lit(" "), F.col("_anorm"), F.lit(" "))
    return cand.where(F.instr(hay, needle) > 0).drop("_key", "_anorm", "_event")


def adjacent(tokens: Column) -> Column:
    """Every two adjacent tokens, joined by a space."""
    return F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
                      F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def shortened(text: Column, k: int) -> Column:
    """The distinct texts that remain when up to ``k`` characters are taken out."""
    out = F.array(text)
    for _ in range(k):
        out = F.array_union(out, F.flatten(F.transform(out, lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))))
    return out


def _fuzzy_match(a: DataFrame, catalogue: DataFrame, artist_col: str, event_col: str,
                 k: int, event_key: str | None, side) -> DataFrame:
    """Edit-distance match on whole-word windows, without a cross product.

    Two texts within ``k`` edits have a text in common among those that
    remain when up to ``k`` characters are taken out of each, so candidates
    are generated by an equi-join on (word count, remaining text) and then
    verified; names that merely have the same length never meet.  The set
    of artist word counts is a bounded summary (names have few words).
    """
    a = a.withColumn("_m", F.size(name_tokens(artist_col)))
    sizes = sorted(r["_m"] for r in a.select("_m").distinct().collect())
    if not sizes:
        kept = [f for f in a.schema.fields if f.name not in ("_anorm", "_m")]
        return a.sparkSession.createDataFrame([], T.StructType([*catalogue.schema.fields, *kept]))
    tok = name_tokens(event_col)
    n = F.size(tok)

    def window_of(m):
        # one-argument lambda: ``transform`` reads a second argument as the index
        return lambda i: F.struct(F.lit(m).alias("m"),
                                  F.array_join(F.slice(tok, i, m), " ").alias("w"))

    windows = F.flatten(F.array(*[
        F.when(n >= m, F.transform(F.sequence(F.lit(1), n - m + 1), window_of(m)))
        .otherwise(F.array().cast("array<struct<m:int,w:string>>"))
        for m in sizes]))
    c = catalogue.select("*", F.explode(windows).alias("_win"))
    c = c.select("*", F.col("_win.m").alias("_m"), F.col("_win.w").alias("_w")).drop("_win")
    cand = (c.withColumn("_rest", F.explode(shortened(F.col("_w"), k)))
            .join(side(a.withColumn("_rest", F.explode(shortened(F.col("_anorm"), k)))), ["_m", "_rest"]))
    hit = cand.where(F.levenshtein("_w", "_anorm", k).between(0, k))
    hit = hit.drop("_m", "_rest", "_w", "_anorm")
    keys = [col for col in a.columns if col not in ("_anorm", "_m")]
    if event_key:
        return hit.dropDuplicates([*keys, event_key])
    return hit.distinct()


#: The catalogue's columns that match, radius and cap read.
MATCHED = ["event_name", "event_id", "concert_date", "latitude", "longitude"]


def match_events(artists: DataFrame, catalogue: DataFrame, artist_col: str = "artist_name",
                 rank_col: str = "artist_rank", scope=(), mode: str = "contains",
                 per_artist: int = EVENTS_PER_ARTIST, geohash: str | None = EVENT_GEOHASH,
                 radius: float = EVENT_RADIUS, unit: str = EVENT_RADIUS_UNIT,
                 classification=EVENT_CLASSIFICATION, country=EVENT_COUNTRY,
                 source=EVENT_SOURCE, centres: DataFrame | None = None) -> DataFrame:
    """PIPE5: filters, radius, keyword match and the per-artist cap.

    ``artists``: (scope..., artist_name, artist_rank); ``catalogue``:
    flattened events with event_id, artist_name (event name), coordinates
    and categories, shared by all scopes.  The distinct names are broadcast
    only if counted to be few.
    ``centres`` (scope..., centre_latitude, centre_longitude, radius), one row per scope,
    puts a centre of its own to each scope in place of ``geohash``; a scope without one
    gets no events.
    Returns F10 columns plus searched_artist, artist_rank and event_id.
    The kept events per artist are the soonest (ties by event id).
    """
    cat = category_filter(catalogue, classification, country, source)
    if geohash is not None and centres is None:
        cat = radius_filter(cat, geohash, radius, unit)
    # parsed and filtered once: the keyword join reads the columns it needs, the other
    # columns are for the events that are kept
    cat = stored(cat.withColumnRenamed("artist_name", "event_name")
                 .withColumn("_row", F.monotonically_increasing_id()), "match-catalogue")
    scope = list(scope)
    # the artist list is read twice (names to match, pairs to join back)
    arts = stored(artists.select(*scope, F.col(artist_col).alias("searched_artist"),
                                 F.col(rank_col).alias("artist_rank")), "artists")
    # Each distinct name is matched and capped once, whatever the number of
    # listeners whose lists hold it; the (listener, artist) pairs join back
    # afterwards (a name on many lists is a skewed key there, which AQE's
    # skew join splits; its build side is at most ``per_artist`` rows).
    names = arts.select("searched_artist").distinct()
    pairs = keyword_match(names, cat.select("_row", *MATCHED), "searched_artist", "event_name", mode,
                          event_key="event_id")
    name = ["searched_artist"]
    if centres is not None:
        # each name is looked up once for each distinct centre that asks for it
        arts = stored(arts.join(centres, scope), "artists-at-centres")
        name += ["centre_latitude", "centre_longitude", "radius"]
        pairs = near_centres(pairs, arts.select(*name).distinct(), ["searched_artist"], unit)
    kept = top_k_per_group(pairs, name,
                           [F.col("concert_date").asc_nulls_last(), F.col("event_id").asc()],
                           per_artist, out="event_position")
    # at most per_artist events of each name and centre
    few = arts.limit(BROADCAST_ROWS // per_artist + 1).count() <= BROADCAST_ROWS // per_artist
    kept = (F.broadcast(kept) if few else kept).join(cat.drop(*MATCHED), "_row")
    kept = arts.join(kept, name)
    return kept.select(*scope, "searched_artist", "artist_rank", "event_position", "event_id",
                       F.col("event_name").alias("artist_name"), "ticket_link", "artist_image",
                       "concert_date", "venue", "city", "address")
