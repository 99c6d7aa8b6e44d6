"""End-to-end weekly job: plays -> features -> scores -> blend -> events -> digest.

usage:
  python -m encore.plans.job --plays 'exports/*.json' --out /shared/encore/run-2026-06-07 \\
      [--plays-format json|parquet] [--artist-pages pages.parquet] [--track-pages t.parquet] \\
      [--responses responses.parquet] [--scope user_id] [--as-of 2026-06-07]
  python -m encore.plans.job --artists-csv chart.csv --responses r.parquet --out ...

Writes under ``--out``: ``features/``, ``scores/``, ``blended/`` (all
artists), ``top_artists.csv/`` (the six blended columns, SNK2), ``events/``
and ``digests/`` (one HTML document per scope, SNK4).  Every input other
than the plays is optional: without ranked lists the recency features are
0 (as NULL -> 0 does), without responses no events are matched.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.constants import TOP_ARTISTS
from encore.operators import digest as digest_ops
from encore.operators import events as event_ops
from encore.operators import features as feat
from encore.operators import recency
from encore.operators.ranking import row_number_by_range
from encore.plans.pipelines import superfan_scores
from encore.session import materialise
from encore.schemas import ARTIST_PAGE_SCHEMA, RESPONSE_SCHEMA, TRACK_PAGE_SCHEMA
from encore.sources import event_responses, ranked_pages, sinks, tables


def _read(spark: SparkSession, path: str, schema: T.StructType, scope_fields) -> DataFrame:
    """A JSON (declared schema) or parquet input of the given shape."""
    if path.endswith(".json") or "*.json" in path:
        return spark.read.schema(T.StructType([*scope_fields, *schema.fields])).json(path)
    return spark.read.parquet(path)


def _empty(spark: SparkSession, schema: T.StructType, scope_fields) -> DataFrame:
    return spark.createDataFrame([], T.StructType([*scope_fields, *schema.fields]))


def run(spark: SparkSession, plays: DataFrame, artist_pages: DataFrame | None = None,
        track_pages: DataFrame | None = None, responses: DataFrame | None = None,
        scope=(), as_of: str | None = None, top_n: int = TOP_ARTISTS,
        materialise_rollup: bool = True) -> dict[str, DataFrame]:
    """The whole pipeline as DataFrames (nothing is written here).

    ``materialise_rollup``: keep True when the plays are expensive to
    re-read (JSON exports, joins); for a columnar play table False lets
    each feature branch scan only its own columns instead of writing the
    rollup to the checkpoint folder.
    """
    scope = list(scope)
    sf = [plays.schema[c] for c in scope]
    features = feat.features(plays, scope=scope, materialise=materialise_rollup)
    scores = superfan_scores(features, scope=scope)
    ap = artist_pages if artist_pages is not None else _empty(spark, ARTIST_PAGE_SCHEMA, sf)
    tp = track_pages if track_pages is not None else _empty(spark, TRACK_PAGE_SCHEMA, sf)
    ranked = ranked_pages.flatten_ranked_artists(ap, scope)
    tracks = ranked_pages.flatten_ranked_tracks(tp, scope)
    blended = recency.blend(scores, recency.api_presence(ranked, scope=scope),
                            recency.track_breadth(tracks, scope=scope),
                            recency.time_range_consistency(ranked, scope=scope), scope=scope)
    # three results read the blend, and two the events: each is computed once
    blended = materialise(blended, "blended")
    top = (recency.top_blended(blended, top_n, scope)
           .withColumnRenamed("blend_rank", "artist_rank"))
    rs = responses if responses is not None else _empty(spark, RESPONSE_SCHEMA, [])
    catalogue = event_responses.flatten_events(rs, keep_catalogue=True)
    events = materialise(event_ops.match_events(top, catalogue, scope=scope), "events")
    docs = digest_ops.digest(events, scope=scope, as_of=as_of)
    return {"features": features, "scores": scores, "blended": blended, "top": top,
            "events": events, "errors": event_responses.error_responses(rs), "digests": docs}


#: Names that one digest document is made from at most.
MAX_NAMES = 10_000
#: Column of a names list that sorts as its rows stand (``sinks.read_csv``).
ROW_ORDER = "_row_order"


def run_names(spark: SparkSession, names: DataFrame, responses: DataFrame | None = None,
              as_of: str | None = None, name_col: str = "artist_name",
              order: list[str] | None = None) -> dict[str, DataFrame]:
    """The chart-seeded flow: a list of names (e.g. the chart CSV) instead of a
    listening history.  The artist rank follows ``order``: ``chart_position`` where the
    list has it, else the rows' places in their files (ROW_ORDER), else the name.  A name
    keeps its best place.  All names are matched; beyond MAX_NAMES there is a digest document
    for every MAX_NAMES ranks (``digest_part``), so none gathers more than their events."""
    if order is None:
        order = [c for c in ("chart_position", ROW_ORDER) if c in names.columns][:1]
    one = names.where(F.col(name_col).isNotNull()).groupBy(name_col).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in order])
    many = one.limit(MAX_NAMES + 1).count() > MAX_NAMES
    ranked = row_number_by_range(one, [*[F.col(c).asc_nulls_last() for c in order],
                                       F.col(name_col).asc()], out="artist_rank")
    top = ranked.select(F.col(name_col).alias("artist_name"), "artist_rank")
    rs = responses if responses is not None else _empty(spark, RESPONSE_SCHEMA, [])
    catalogue = event_responses.flatten_events(rs, keep_catalogue=True)
    events = event_ops.match_events(top, catalogue)
    parts = events.withColumn("digest_part", F.floor((F.col("artist_rank") - 1) / MAX_NAMES))
    docs = digest_ops.digest(parts if many else events, ["digest_part"] if many else [], as_of=as_of)
    return {"top": top, "events": events, "errors": event_responses.error_responses(rs), "digests": docs}


def write_outputs(out: dict[str, DataFrame], path: str, scope=()) -> None:
    """Persist the job's results (overwrite: re-runnable)."""
    scope = list(scope)
    for name in ("features", "scores", "blended", "events", "errors"):
        if name in out:
            out[name].write.mode("overwrite").parquet(f"{path}/{name}")
    blend_cols = [*scope, "artist_name", "superfan_score", "api_presence_score",
                  "time_range_consistency", "track_breadth_score", "blended_score"]
    top_cols = [c for c in blend_cols if c in out["top"].columns] or out["top"].columns
    sinks.write_csv(out["top"], f"{path}/top_artists.csv", top_cols)
    if scope:
        sinks.write_digest_packs(out["digests"], f"{path}/digests", scope)
    else:
        sinks.write_digests(out["digests"], f"{path}/digests")


def main(argv=None, stop_session: bool = True) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--plays")
    p.add_argument("--artists-csv", help="names CSV (header artist_name) instead of plays")
    p.add_argument("--plays-format", choices=["json", "parquet"], default="json")
    p.add_argument("--artist-pages")
    p.add_argument("--track-pages")
    p.add_argument("--responses")
    p.add_argument("--scope", action="append", default=[])
    p.add_argument("--as-of")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("encore-job").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # month keys and day gaps are UTC's
    if a.artists_csv:
        resp = _read(spark, a.responses, RESPONSE_SCHEMA, []) if a.responses else None
        names = sinks.read_csv(spark, a.artists_csv, None, ROW_ORDER)
        if "chart_position" in names.columns:
            names = names.withColumn("chart_position", F.col("chart_position").cast("long"))
        out = run_names(spark, names, resp, a.as_of)
        write_outputs(out, a.out.rstrip("/"))
        if stop_session:
            spark.stop()
        return
    if not a.plays:
        raise SystemExit("one of --plays or --artists-csv is required")
    if a.plays_format == "json":
        plays = tables.read_play_history(spark, a.plays)
        if a.scope:
            raise SystemExit("--scope needs a parquet play table that carries the scope columns")
    else:
        plays = spark.read.parquet(a.plays)
    sf = [plays.schema[c] for c in a.scope]
    pages = _read(spark, a.artist_pages, ARTIST_PAGE_SCHEMA, sf) if a.artist_pages else None
    tpages = _read(spark, a.track_pages, TRACK_PAGE_SCHEMA, sf) if a.track_pages else None
    resp = _read(spark, a.responses, RESPONSE_SCHEMA, []) if a.responses else None
    # parquet plays are cheap to re-read column by column; JSON is parsed once
    out = run(spark, plays, pages, tpages, resp, a.scope, a.as_of,
              materialise_rollup=(a.plays_format == "json"))
    write_outputs(out, a.out.rstrip("/"), a.scope)
    if stop_session:
        spark.stop()


if __name__ == "__main__":
    main()
