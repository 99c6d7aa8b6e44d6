"""Event-search responses (SRC6, SRC7, AGG14, SCL14).

A response row is (query, status, body) with ``body`` the JSON text of one
search result page.  Parsing is ``from_json`` with a declared schema (no
inference), then ``explode`` of the embedded events; absent keys give
NULL instead of an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.schemas import FLAT_EVENT_COLUMNS, RESPONSE_BODY


def widest_image_url(images) -> Column:
    """AGG14: URL of the widest image; the first one wins a tie on width."""
    images = F.col(images) if isinstance(images, str) else images
    best = F.aggregate(
        images, F.lit(None).cast("struct<url:string,width:int>"),
        lambda acc, x: F.when(acc.isNull() | (x["width"] > acc["width"]), x).otherwise(acc))
    return best["url"]


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add the parsed body as ``_doc``.  It is generated, one row from one, so that filters on
    it read what was parsed; filters on a plain column would parse the body again."""
    return responses.select("*", F.explode(F.array(F.from_json("body", RESPONSE_BODY))).alias("_doc"))


def ok_responses(parsed: DataFrame) -> DataFrame:
    """SRC7: status 200 with an ``_embedded`` block (the rows that yield events)."""
    return parsed.where((F.col("status") == 200) & F.col("_doc._embedded").isNotNull())


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """SRC7: what is neither a result nor an API error: no status, or status 200 with a
    body that is not JSON, as (query, status, reason)."""
    reason = (F.when(F.col("status").isNull(), F.lit("no status"))
              .when((F.col("status") == 200) & (F.col("body").isNull() | F.try_parse_json("body").isNull()),
                    F.lit("body is not JSON")))
    return responses.select("query", "status", reason.alias("reason")).where("reason IS NOT NULL")


def error_responses(responses: DataFrame) -> DataFrame:
    """SRC7: the error lines: every non-200 response as (query, status, message)."""
    return (responses.where(F.col("status") != 200)
            .select("query", "status",
                    F.format_string("API error for %s: %d", F.col("query"), F.col("status"))
                    .alias("message")))


def flatten_events(responses: DataFrame, keep_catalogue: bool = False,
                   strict: bool = False) -> DataFrame:
    """SRC6: one row per event of every successful response.

    Columns: query, artist_name (the *event* name), ticket_link,
    artist_image (widest), concert_date, venue, city, address (first
    venue), and with ``keep_catalogue`` the event id, coordinates and
    category fields used by the catalogue filters.  Missing keys give NULL;
    ``strict=True`` instead fails the job on the first event that lacks one
    of the seven fields (no images, no venue, no address, ...).
    """
    ev = (ok_responses(parse_responses(responses))
          .select("query", F.explode("_doc._embedded.events").alias("e")))
    venue = F.get(F.col("e._embedded.venues"), 0)
    cols = [
        F.col("query"),
        F.col("e.name").alias("artist_name"),
        F.col("e.url").alias("ticket_link"),
        widest_image_url("e.images").alias("artist_image"),
        F.col("e.dates.start.localDate").alias("concert_date"),
        venue["name"].alias("venue"),
        venue["city"]["name"].alias("city"),
        venue["address"]["line1"].alias("address"),
    ]
    if keep_catalogue:
        cols += [F.col("e.id").alias("event_id"), F.col("e.latitude").alias("latitude"),
                 F.col("e.longitude").alias("longitude"),
                 F.col("e.classification").alias("classification"),
                 F.col("e.country").alias("country"), F.col("e.source").alias("source")]
    flat = ev.select(*cols)
    if strict:
        checks = [F.assert_true(F.col(n).isNotNull(), F.lit(f"event field missing: {n}"))
                  for n in FLAT_EVENT_COLUMNS]
        flat = flat.where(F.coalesce(*checks).isNull())
    return flat
