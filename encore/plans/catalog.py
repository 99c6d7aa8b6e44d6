"""Registered queries: one per inventory item (named after its ID).

Each query takes (spark, sf_dir), reads the driver's tables through the
stand-in builders, runs the library operator on the whole input and
returns a DataFrame whose column names match the SQL twin in
``encore.plans.oracle``.  Doubles are rounded to 6 places for the
cross-engine comparison only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.constants import ARTIST
from encore.operators import features as feat
from encore.plans import pipelines as pipe
from encore.plans import stand_in
from encore.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


SCORE_COLS = ["log_play_count_per_artist", "log_num_unique_songs_for_artist",
              "log_completion_rate", "log_intentional_listening_rate",
              "log_listening_consistency", "log_num_true_albums", "log_revisit_rate",
              "superfan_score"]


# ---------------------------------------------------------------- PIPE1/2 --

@register("pipe1_features")
def q_pipe1(spark, base):
    """PIPE1: wide per-artist feature table (F7)."""
    out = feat.features(stand_in.plays(spark, base))
    return r6(out, ["completion_rate", "intentional_listening_rate", "skip_rate"])


@register("pipe1_features_columnar")
def q_pipe1_columnar(spark, base):
    """PIPE1 over a columnar play table: every branch reads its own columns and no
    roll-up is written."""
    from encore.sources import sinks
    path = sinks.scratch_path(spark, "plays")
    stand_in.plays(spark, base).write.parquet(path)
    out = feat.features(spark.read.parquet(path), materialise=False)
    return r6(out, ["completion_rate", "intentional_listening_rate", "skip_rate"])


def _scores(spark, base, rank: bool = True):
    return pipe.superfan_scores(feat.features(stand_in.plays(spark, base)), rank=rank)


@register("pipe2_superfan_scores")
def q_pipe2(spark, base):
    """PIPE2: log, scale, score and globally rank every artist (F8)."""
    return r6(_scores(spark, base).select("artist_name", "rank", *SCORE_COLS), SCORE_COLS)


@register("top2_top50_by_rank")
def q_top2(spark, base):
    """Flagship: plays -> PIPE1 -> PIPE2 -> the 50 highest-ranked artists."""
    out = pipe.top_ranked(_scores(spark, base, rank=False), 50)
    return r6(out.select("artist_name", "rank", *SCORE_COLS), SCORE_COLS)


# ------------------------------------------------------ single aggregates --

def _pd(spark, base):
    return feat.drop_podcasts(stand_in.plays(spark, base))


@register("flt1_drop_podcasts")
def q_flt1(spark, base):
    """FLT1 + PRJ1: plays with an artist, fixed 12-column projection."""
    return feat.project_plays(_pd(spark, base))


SOURCE_COLS = ["master_metadata_track_name", ARTIST, "master_metadata_album_album_name",
               "spotify_track_uri"]


@register("flt2_complete_rows")
def q_flt2(spark, base):
    """FLT2: rows where track, artist, album and URI are all present."""
    return feat.keep_complete(feat.project_plays(stand_in.plays(spark, base)), SOURCE_COLS)


@register("flt3_drop_all_null")
def q_flt3(spark, base):
    """FLT3: drop rows where track, artist, album and URI are all NULL."""
    return feat.drop_all_null(feat.project_plays(stand_in.plays(spark, base)), SOURCE_COLS)


@register("agg1_play_count")
def q_agg1(spark, base):
    """AGG1: plays per artist."""
    return feat.play_counts(_pd(spark, base))


@register("agg2_distinct_albums_tracks")
def q_agg2(spark, base):
    """AGG2: distinct albums and tracks per artist."""
    return feat.distinct_counts(_pd(spark, base))


@register("agg2_sketched_counts")
def q_agg2_sketched(spark, base):
    """AGG2, approximate: monthly sketches stored, read back and merged per artist, with
    the exact counts and whether the estimates are within the bound (three standard errors
    of 2^12 registers, one at least)."""
    from encore.sources import sinks
    plays = _pd(spark, base)
    path = sinks.scratch_path(spark, "month-sketches")
    feat.month_sketches(plays).write.parquet(path)
    exact, got = feat.distinct_counts(plays), feat.sketched_counts(spark.read.parquet(path))
    cols = ["unique_albums_for_artist", "num_unique_songs_for_artist"]
    within = [F.abs(F.col(f"_{c}") - F.col(c)) <= F.greatest(F.lit(1.0), F.col(c) * (3 * 1.04 / 64)) for c in cols]
    return (exact.join(got.withColumnsRenamed({c: f"_{c}" for c in cols}), ARTIST, "full")
            .select(ARTIST, *cols, F.coalesce(within[0] & within[1], F.lit(False)).alias("within_bound")))


@register("agg3_multi_track_albums")
def q_agg3(spark, base):
    """AGG3 + FLT6: distinct tracks per (artist, album), groups with more than one."""
    return feat.multi_track_albums(_pd(spark, base))


@register("agg4_true_albums")
def q_agg4(spark, base):
    """AGG4: albums with more than one distinct track, per artist."""
    return feat.true_album_counts(_pd(spark, base))


@register("agg5_listening_consistency")
def q_agg5(spark, base):
    """AGG5: months with more than one distinct track, per artist."""
    return feat.listening_consistency(_pd(spark, base))


@register("agg6_active_months")
def q_agg6(spark, base):
    """AGG6: distinct active months per artist."""
    return feat.active_months(_pd(spark, base))


@register("agg7_skip_rate")
def q_agg7(spark, base):
    """AGG7: mean of the nullable skipped flag per artist."""
    return r6(feat.skip_rates(_pd(spark, base)), ["skip_rate"])


@register("agg8_intentional_rate")
def q_agg8(spark, base):
    """AGG8 + FLT4: intentional starts over all plays per artist."""
    return r6(feat.intentional_rates(_pd(spark, base)), ["intentional_listening_rate"])


@register("agg9_completion_rate")
def q_agg9(spark, base):
    """AGG9 + FLT5: completed plays over all plays per artist."""
    return r6(feat.completion_rates(_pd(spark, base)), ["completion_rate"])


@register("agg10_revisits")
def q_agg10(spark, base):
    """AGG10 + FLT7: gaps of more than 120 days between consecutive plays."""
    return feat.revisit_counts(_pd(spark, base))


@register("win1_previous_play")
def q_win1(spark, base):
    """WIN1 + SCL2: previous play time per artist and the day gap, per play."""
    return feat.previous_play(_pd(spark, base))


@register("win3_partition_total")
def q_win3(spark, base):
    """WIN3: each play beside its artist's total play count."""
    return feat.partition_totals(_pd(spark, base))


# ------------------------------------------------------ recency and blend --

from encore.operators import recency  # noqa: E402
from encore.sources import ranked_pages  # noqa: E402


def _artists(spark, base):
    return ranked_pages.flatten_ranked_artists(stand_in.artist_pages(spark, base))


def _tracks(spark, base):
    return ranked_pages.flatten_ranked_tracks(stand_in.track_pages(spark, base))


@register("src4_ranked_artists")
def q_src4(spark, base):
    """SRC4 + WIN4: paged ranked artist lists flattened to (list, position, name)."""
    return _artists(spark, base)


@register("src5_ranked_tracks")
def q_src5(spark, base):
    """SRC5: paged ranked tracks flattened, first credited artist only."""
    return _tracks(spark, base)


@register("win5_presence_score")
def q_win5(spark, base):
    """WIN5 + AGG16: (n - rank) / (n - 1) over the long-term list."""
    return r6(recency.api_presence(_artists(spark, base)), ["api_presence_score"])


@register("jn3_time_range_consistency")
def q_jn3(spark, base):
    """JN3 + SCL11: full outer joins of the three lists, share of lists present."""
    return r6(recency.time_range_consistency(_artists(spark, base)), ["time_range_consistency"])


@register("agg11_track_breadth")
def q_agg11(spark, base):
    """AGG11 + AGG12 + SCL12: distinct top tracks per artist over the maximum."""
    return r6(recency.track_breadth(_tracks(spark, base)), ["track_breadth_score"])


def _recency_parts(spark, base):
    a = stored(_artists(spark, base), "ranked-artists")  # four parts read it
    return (recency.api_presence(a), recency.track_breadth(_tracks(spark, base)),
            recency.time_range_consistency(a))


@register("pipe3_recency")
def q_pipe3(spark, base):
    """PIPE3: presence, time-range consistency and track breadth per listed artist."""
    pres, breadth, cons = _recency_parts(spark, base)
    k = ["artist_name"]
    out = (cons.select(*k, "time_range_consistency")
           .join(pres, k, "full").join(breadth.select(*k, "track_breadth_score"), k, "full"))
    return r6(out, ["api_presence_score", "time_range_consistency", "track_breadth_score"])


BLEND_DOUBLES = ["superfan_score", "api_presence_score", "time_range_consistency",
                 "track_breadth_score", "blended_score"]


def _blended(spark, base):
    # the blend reads scores only; the global historical rank is not needed
    pres, breadth, cons = _recency_parts(spark, base)
    return recency.blend(_scores(spark, base, rank=False), pres, breadth, cons)


@register("jn2_blend_all")
def q_jn2(spark, base):
    """JN2 + FLT8 + SCL9: every scored artist with the blended score."""
    return r6(_blended(spark, base).select(*recency.BLEND_OUTPUT), BLEND_DOUBLES)


@register("pipe4_blend_top50")
def q_pipe4(spark, base):
    """PIPE4 + TOP1: the 50 best blended scores (F9 columns plus order)."""
    top = recency.top_blended(_blended(spark, base), 50)
    return r6(top.select(*recency.BLEND_OUTPUT, "blend_rank"), BLEND_DOUBLES)


# ------------------------------------------------------------- events ------

from encore.operators import events as ev_ops  # noqa: E402
from encore.operators.spatial import near_centres  # noqa: E402
from encore.sources import event_responses as responses  # noqa: E402

FLAT = ["query", "artist_name", "ticket_link", "artist_image", "concert_date", "venue", "city",
        "address"]


def _catalogue(spark, base):
    return responses.flatten_events(stand_in.event_responses(spark, base), keep_catalogue=True)


@register("src6_flat_events")
def q_src6(spark, base):
    """SRC6 + AGG14 + SCL14: responses parsed and flattened to 7 event columns."""
    return responses.flatten_events(stand_in.event_responses(spark, base))


@register("src7_error_responses")
def q_src7(spark, base):
    """SRC7: non-200 responses as error lines."""
    return responses.error_responses(stand_in.event_responses(spark, base))


@register("src7_unreadable_responses")
def q_src7_unreadable(spark, base):
    """SRC7: responses without a status or with a body that is not JSON."""
    return responses.unreadable_responses(stand_in.event_responses(spark, base))


@register("jn8_category_filter")
def q_jn8(spark, base):
    """JN8: music events in the US from the primary source."""
    return ev_ops.category_filter(_catalogue(spark, base)).select("event_id", *FLAT)


@register("jn7_radius_filter")
def q_jn7(spark, base):
    """JN7: events within 150 miles of the centre of geohash dpsby4."""
    out = ev_ops.radius_filter(_catalogue(spark, base))
    return r6(out.select("event_id", "artist_name", "distance"), ["distance"])


def _nation_centres(spark, base):
    """A centre and a radius for every nation, some of them around the events."""
    k = F.col("n_nationkey")
    return read_table(spark, base, "nation").select(
        "n_name", (F.lit(42.3331) + (k % 7 - 3) * 0.9).alias("centre_latitude"),
        (F.lit(-83.0511) + (k % 5 - 2) * 1.2).alias("centre_longitude"),
        (40 + (k % 6) * 35).cast("double").alias("radius"))


@register("jn7_nation_centres")
def q_jn7_centres(spark, base):
    """JN7 with many centres: events within each nation's own radius of its centre."""
    out = near_centres(_catalogue(spark, base), _nation_centres(spark, base))
    return r6(out.select("n_name", "event_id", "artist_name", "distance"), ["distance"])


def _top_artists(spark, base):
    top = recency.top_blended(_blended(spark, base), 50)
    return top.select("artist_name", F.col("blend_rank").alias("artist_rank"))


@register("jn6_keyword_match")
def q_jn6(spark, base):
    """JN5 + JN6: every (top artist, event) pair whose names match as whole words."""
    cat = _catalogue(spark, base).select("event_id", F.col("artist_name").alias("event_name"))
    arts = _top_artists(spark, base).withColumnRenamed("artist_name", "searched_artist")
    return (ev_ops.keyword_match(arts, cat, "searched_artist", "event_name")
            .select("searched_artist", "artist_rank", "event_id", "event_name"))


@register("pipe5_match_events")
def q_pipe5(spark, base):
    """PIPE5 + TOP5: top-50 artists matched to nearby music events, at most 5 each."""
    return ev_ops.match_events(_top_artists(spark, base), _catalogue(spark, base))


# ----------------------------------------------------- digest and chart ----

from encore.functions.columns import long_date  # noqa: E402
from encore.operators import chart as chart_ops  # noqa: E402
from encore.operators import digest as digest_ops  # noqa: E402
from encore.sources import sinks  # noqa: E402
from encore.sources.tables import read_table  # noqa: E402

DIGEST_AS_OF = "2026-06-07"


def _matched(spark, base):
    return q_pipe5(spark, base)


@register("top4_events_by_date")
def q_top4(spark, base):
    """TOP4: matched events in chronological order (digest position)."""
    return (digest_ops.chronological(_matched(spark, base))
            .select("digest_position", "concert_date", "searched_artist", "event_id"))


@register("scl18_event_cards")
def q_scl18(spark, base):
    """SCL18: one escaped HTML card per matched event."""
    return digest_ops.event_cards(_matched(spark, base)).select("event_id", "searched_artist",
                                                               "card_html")


@register("pipe6_digest")
def q_pipe6(spark, base):
    """PIPE6 + AGG15 + WIN7 + SCL16: the whole chronological HTML digest."""
    return digest_ops.digest(_matched(spark, base), as_of=DIGEST_AS_OF)


@register("scl16_long_date")
def q_scl16(spark, base):
    """SCL16: 'June 07, 2026' style text of every order date."""
    o = read_table(spark, base, "orders")
    return o.select("o_orderkey", long_date("o_orderdate").alias("long_date"))


def _pages(spark, base):
    return read_table(spark, base, "pages").select("page_id", "html")


@register("src8_chart_items")
def q_src8(spark, base):
    """SRC8 + SCL15: element texts of every page in document order."""
    return chart_ops.element_texts(_pages(spark, base))


@register("src8_elements_by_class")
def q_src8_class(spark, base):
    """SRC8: elements of three classes on any tag, nested and unclosed ones among them."""
    return chart_ops.elements_by_class(stand_in.classed_pages(spark, base), ["ad", "top", "entry"])


@register("scl13_primary_name")
def q_scl13(spark, base):
    """SCL13: element texts cut at the first &/with/featuring, stripped."""
    items = chart_ops.element_texts(_pages(spark, base))
    return items.select("page_id", "position", chart_ops.primary_name("text").alias("artist_name"))


@register("pipe7_chart_seed")
def q_pipe7(spark, base):
    """PIPE7 + SET2 + TOP6: up to 50 distinct names per page, first 100 items."""
    return chart_ops.chart_seed(_pages(spark, base))


@register("snk1_saved_features")
def q_snk1(spark, base):
    """SNK1: the feature table saved as a catalog table and read back by name."""
    with sinks.saved_tables(spark, "encore_features") as [name]:
        sinks.save_table(_feature_table(spark, base), name)
        out = r6(spark.table(name), ["completion_rate", "intentional_listening_rate", "skip_rate"])
        return pipe.materialise(out)


BUCKETS = 16


def bucketed_join(spark, features, recency_table, names):
    """Features and recency saved in equal buckets by artist and joined: no shuffle."""
    sinks.save_table(features, names[0], bucket_by=(BUCKETS, ARTIST))
    sinks.save_table(recency_table.withColumnRenamed("artist_name", ARTIST), names[1], bucket_by=(BUCKETS, ARTIST))
    return spark.table(names[0]).join(spark.table(names[1]).hint("merge"), ARTIST, "left")


@register("snk1_bucketed_join")
def q_snk1_bucketed(spark, base):
    """SNK1 + JN2: saved features joined with saved recency features, bucket by bucket."""
    pres, breadth, cons = _recency_parts(spark, base)
    k = ["artist_name"]
    table = (cons.select(*k, "time_range_consistency").join(pres, k, "full")
             .join(breadth.select(*k, "track_breadth_score"), k, "full"))
    with sinks.saved_tables(spark, "encore_features", "encore_recency") as names:
        out = bucketed_join(spark, feat.features(stand_in.plays(spark, base)), table, names).select(
            ARTIST, "play_count_per_artist", "revisit_rate", "time_range_consistency",
            "api_presence_score", "track_breadth_score")
        return pipe.materialise(r6(out, ["time_range_consistency", "api_presence_score", "track_breadth_score"]))


@register("snk3_view_top_artists")
def q_snk3(spark, base):
    """SNK3: the scores as a view that SQL reads."""
    name = f"encore_scores_{uuid.uuid4().hex}"
    sinks.register_view(_scores(spark, base, rank=False), name)
    return r6(spark.sql(f"""SELECT artist_name, superfan_score FROM {name}
                            WHERE superfan_score >= 0.5"""), ["superfan_score"])


@register("snk4_written_digests")
def q_snk4(spark, base):
    """SNK4: one digest document per listener (the event's city stands for one), written
    to packs with an index and read back whole."""
    path = sinks.scratch_path(spark, "digests")
    events = _matched(spark, base).withColumn("listener", F.coalesce("city", F.lit("none")))
    docs = digest_ops.digest(events, scope=["listener"], as_of=DIGEST_AS_OF)
    return sinks.read_digest_packs(spark, sinks.write_digest_packs(docs, path, ["listener"], pack_bytes=1 << 16))


@register("pipe7_chart_events")
def q_pipe7_events(spark, base):
    """PIPE7 + PIPE5: the chart-seeded flow.  A chart CSV (supplier and customer names
    as a chart page has them, in order, in several files) -> names -> events."""
    from encore.plans import job
    path = sinks.scratch_path(spark, "chart-names")
    seed = chart_ops.chart_seed(stand_in.chart_pages(spark, base))
    sinks.write_csv(seed.repartition(3), path, ["chart_position", "page_id", "artist_name"])
    names = sinks.read_csv(spark, path, T.StructType([
        T.StructField("artist_name", T.StringType()), T.StructField("chart_position", T.LongType())]))
    out = job.run_names(spark, names, stand_in.event_responses(spark, base), as_of="2026-06-07")
    return out["events"]


@register("snk2_src3_chart_csv")
def q_snk2(spark, base):
    """SNK2 + SRC3: the chart seed written as CSV with a header and read back."""
    path = sinks.scratch_path(spark, "chart-csv")
    sinks.write_csv(chart_ops.chart_seed(_pages(spark, base)), path,
                    ["page_id", "chart_position", "artist_name"])
    schema = T.StructType([T.StructField("page_id", T.LongType()),
                           T.StructField("chart_position", T.LongType()),
                           T.StructField("artist_name", T.StringType())])
    return sinks.read_csv(spark, path, schema)


# ---------------------------------------------------------- exploration ----

from encore.constants import EARLY_BLEND_WEIGHTS  # noqa: E402
from encore.operators import explore  # noqa: E402


def _feature_table(spark, base):
    return pipe.materialise(feat.features(stand_in.plays(spark, base)))


@register("agg19_column_profile")
def q_agg19(spark, base):
    """AGG19: non-null count and type of every feature-table column."""
    return explore.column_profile(_feature_table(spark, base))


@register("agg18_describe")
def q_agg18(spark, base):
    """AGG18: count, mean, std, min, exact quartiles, max per numeric feature."""
    out = explore.describe(_feature_table(spark, base))
    return r6(out, ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("agg20_histogram")
def q_agg20(spark, base):
    """AGG20: 30 equal-width bins per numeric feature."""
    return r6(explore.histogram(_feature_table(spark, base)), ["bin_lo", "bin_hi"])


@register("agg21_spearman")
def q_agg21(spark, base):
    """AGG21: pairwise-complete Spearman correlation of the numeric features."""
    return r6(explore.spearman(_feature_table(spark, base)), ["rho"])


@register("scl8_raw_superfan_score")
def q_scl8(spark, base):
    """SCL8: the raw min-max score variant (no log), ranked."""
    out = pipe.superfan_scores(_feature_table(spark, base), log=False)
    cols = ["play_count_per_artist", "num_unique_songs_for_artist", "completion_rate",
            "intentional_listening_rate", "listening_consistency", "num_true_albums",
            "revisit_rate", "superfan_score"]
    return r6(out.select("artist_name", "rank", *cols), cols)


@register("scl10_early_blend")
def q_scl10(spark, base):
    """SCL10: the earlier blend weights (.70/.15/.10/.05)."""
    pres, breadth, cons = _recency_parts(spark, base)
    out = recency.blend(_scores(spark, base, rank=False), pres, breadth, cons,
                        weights=EARLY_BLEND_WEIGHTS)
    return r6(out.select(*recency.BLEND_OUTPUT), BLEND_DOUBLES)


X_COLS = SCORE_COLS  # scaled log features + score, as fed to K-Means and PCA


def _clustered(spark, base):
    scores = pipe.materialise(_scores(spark, base, rank=False))
    return explore.kmeans_clusters(scores, X_COLS, "artist_name", "superfan_score")


@register("ml1_kmeans")
def q_ml1(spark, base):
    """ML1: K-Means (k=3, fixed starting centres) on the scaled features and score."""
    return r6(_clustered(spark, base).select("artist_name", "superfan_score", "cluster"), ["superfan_score"])


@register("agg17_cluster_sizes")
def q_agg17(spark, base):
    """AGG17: artists per K-Means cluster."""
    return explore.cluster_sizes(_clustered(spark, base))


@register("ml3_cluster_frame")
def q_ml3(spark, base):
    """ML2 + ML3: centred 2-component PCA coordinates with cluster, name and score."""
    out = explore.pca_coords(_clustered(spark, base), X_COLS)
    return r6(out.select("PC1", "PC2", F.col("cluster").cast("string").alias("cluster"),
                         "artist_name", "superfan_score"), ["PC1", "PC2", "superfan_score"])


@register("ml4_kruskal_wallis")
def q_ml4(spark, base):
    """ML4: Kruskal-Wallis H and p for each feature (NULL as 0) across the clusters."""
    c = _clustered(spark, base).fillna(0, subset=X_COLS)
    return r6(explore.kruskal_wallis(c, "cluster", X_COLS), ["statistic", "p_value"])


@register("pipe8_explore")
def q_pipe8(spark, base):
    """PIPE8: the whole exploration of the feature table as one long table: profile,
    statistics, histograms, correlations, clusters, coordinates and tests."""
    return r6(pipe.explore_features(feat.features(stand_in.plays(spark, base))).long(), ["value"])


@register("top3_log_score_preview")
def q_top3_log(spark, base):
    """TOP3: the 30 best log-scaled scores of the exploration."""
    top = pipe.explore_features(feat.features(stand_in.plays(spark, base)))["preview"]
    return r6(top.select("artist_name", "superfan_score"), ["superfan_score"])


# ----------------------------------------------- sources and single steps --

from encore.operators import ranking as rank_ops  # noqa: E402
from encore.operators import scaling  # noqa: E402
from encore.sources import tables  # noqa: E402

EXPORT_SPLIT = "1998-01-01"


@register("src1_json_union_by_name")
def q_src1(spark, base):
    """SRC1 + SET1 + SET4: plays exported as two JSON batches with different
    column sets, scanned back with the declared schema (missing -> NULL)."""
    plays = feat.project_plays(stand_in.plays(spark, base))
    path = sinks.scratch_path(spark, "plays-json")
    cut = F.lit(EXPORT_SPLIT).cast("timestamp_ntz")
    # the plays are made once, both batches are written from them
    plays = stored(plays, "plays")
    for batch, rows in (("old", plays.where(F.col("ts") < cut)),
                        ("new", plays.where(F.col("ts") >= cut).drop("platform", "ip_addr"))):
        rows.write.option("compression", "gzip").json(f"{path}/batch={batch}")
    back = tables.read_play_history(spark, [f"{path}/batch=old", f"{path}/batch=new"],
                                    multi_line=False)
    return back.withColumn("ts", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


def _overlapping_exports(spark, base, dedupe):
    """A play table ingested from two exports that share half a year, in two runs."""
    from encore.streaming.ingest import ingest_exports
    path = sinks.scratch_path(spark, "overlapping-exports")
    plays = feat.project_plays(stand_in.plays(spark, base))
    for name, own in (("first", F.col("ts") < F.lit(OVERLAP[1]).cast("timestamp_ntz")),
                      ("second", F.col("ts") >= F.lit(OVERLAP[0]).cast("timestamp_ntz"))):
        plays.where(own).write.option("compression", "gzip").json(f"{path}/exports/{name}")
        ingest_exports(spark, f"{path}/exports/*", f"{path}/plays", f"{path}/checkpoint", multi_line=False,
                       dedupe=dedupe)
    back = feat.project_plays(spark.read.parquet(f"{path}/plays"))
    return back.withColumn("ts", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


OVERLAP = ("1998-01-01", "1998-07-01")


@register("set4_overlapping_exports")
def q_set4(spark, base):
    """SET4 + SRC1: overlapping exports ingested as they are: shared plays count twice."""
    return _overlapping_exports(spark, base, False)


@register("set4_deduped_exports")
def q_set4_deduped(spark, base):
    """SET4 + SRC1: overlapping exports ingested with every play once."""
    return _overlapping_exports(spark, base, True)


@register("src9_preview")
def q_src9(spark, base):
    """SRC9: a five-row preview of the plays (repeatable order)."""
    plays = feat.project_plays(stand_in.plays(spark, base))
    return tables.preview(plays, 5, [F.col(c).asc_nulls_first() for c in plays.columns])


@register("agg13_minmax_fit")
def q_agg13(spark, base):
    """AGG13: per-feature min and max of the log features (the scaler fit)."""
    f = scaling.drop_features(_feature_table(spark, base))
    num = scaling.numeric_columns(f)
    logs = scaling.add_log_columns(f, num)
    fit = scaling.minmax_fit(logs, [f"log_{c}" for c in num])
    arr = F.array(*[F.struct(F.lit(f"log_{c}").alias("column_name"),
                             F.col(f"_min_log_{c}").alias("min"),
                             F.col(f"_max_log_{c}").alias("max")) for c in num])
    return r6(fit.select(F.inline(arr)), ["min", "max"])


@register("win6_average_rank")
def q_win6(spark, base):
    """WIN6: average rank (ties share the mean rank) of each artist's play count."""
    counts = _feature_table(spark, base).select(ARTIST, "play_count_per_artist")
    return rank_ops.average_rank(counts, "play_count_per_artist", out="avg_rank")


@register("top3_top20_raw_score")
def q_top3(spark, base):
    """TOP3 + TOP7: the 20 best raw (no log) scores, sorted for display."""
    scored = pipe.superfan_scores(_feature_table(spark, base), log=False, rank=False)
    top = rank_ops.top_k(scored, [F.col("superfan_score").desc_nulls_last(),
                                  F.col("artist_name").asc()], 20)
    return r6(top.select("artist_name", "superfan_score"), ["superfan_score"])


@register("jn6_fuzzy_keyword_match")
def q_jn6_fuzzy(spark, base):
    """JN6 (edit-distance mode): top artists matched to events whose name holds
    a run of words within one character edit of the artist name."""
    cat = _catalogue(spark, base).withColumnRenamed("artist_name", "event_name")
    arts = _top_artists(spark, base).withColumnRenamed("artist_name", "searched_artist")
    return (ev_ops.keyword_match(arts, cat, "searched_artist", "event_name", mode="fuzzy", max_edits=1, event_key="event_id")
            .select("searched_artist", "artist_rank", "event_id", "event_name"))


@register("pipe5_rank_top50_events")
def q_pipe5_rank(spark, base):
    """TOP2 + PIPE5: the 50 best artists by historical rank (no recency blend)
    matched to nearby music events, at most 5 each."""
    top = pipe.top_ranked(_scores(spark, base, rank=False), 50)
    return ev_ops.match_events(top.select("artist_name", F.col("rank").alias("artist_rank")),
                               _catalogue(spark, base))


# ------------------------------------------------- many listeners at once --

SCOPE = ["user_id"]


def _listener_features(spark, base):
    return feat.features(stand_in.listener_plays(spark, base), scope=SCOPE)


@register("scoped_pipe2_scores")
def q_scoped_pipe2(spark, base):
    """PIPE1 + PIPE2 per listener: features, scaling, score and rank within each."""
    out = pipe.superfan_scores(_listener_features(spark, base), scope=SCOPE)
    return r6(out.select(*SCOPE, "artist_name", "rank", *SCORE_COLS), SCORE_COLS)


@register("scoped_win6_average_rank")
def q_scoped_win6(spark, base):
    """WIN6 per listener: average rank of each artist's play count."""
    counts = _listener_features(spark, base).select(*SCOPE, ARTIST, "play_count_per_artist")
    return rank_ops.average_rank(counts, "play_count_per_artist", SCOPE, out="avg_rank")


@register("scoped_agg18_describe")
def q_scoped_agg18(spark, base):
    """AGG18 per listener: summary statistics of the feature columns."""
    # two passes read the features
    out = explore.describe(stored(_listener_features(spark, base), "listener-features"), scope=SCOPE)
    return r6(out, [c for c in ("mean", "std", "min", "p25", "p50", "p75", "max") if c in out.columns])


@register("scoped_pipe4_blend_top50")
def q_scoped_pipe4(spark, base):
    """PIPE3 + PIPE4 + TOP1 per listener: each listener's 50 best blended scores from the
    listener's own plays and ranked lists."""
    scores = pipe.superfan_scores(_listener_features(spark, base), scope=SCOPE, rank=False)
    artists, tracks = stand_in.listener_pages(spark, base)
    ranked = stored(ranked_pages.flatten_ranked_artists(artists, SCOPE), "ranked-artists")
    heard = ranked_pages.flatten_ranked_tracks(tracks, SCOPE)
    out = recency.blend(scores, recency.api_presence(ranked, scope=SCOPE),
                        recency.track_breadth(heard, scope=SCOPE),
                        recency.time_range_consistency(ranked, scope=SCOPE), scope=SCOPE)
    top = recency.top_blended(out, 50, SCOPE)
    return r6(top.select(*SCOPE, *recency.BLEND_OUTPUT, "blend_rank"), BLEND_DOUBLES)


@register("scoped_pipe5_listener_centres")
def q_scoped_pipe5_centres(spark, base):
    """PIPE5 + JN7 per listener: the events of each listener's 50 best artists within the
    listener's own radius of the listener's own centre."""
    scores = pipe.superfan_scores(_listener_features(spark, base), scope=SCOPE, rank=False)
    top = pipe.top_ranked(scores, 50, SCOPE).select(*SCOPE, "artist_name", F.col("rank").alias("artist_rank"))
    u = F.col("user_id")
    centres = read_table(spark, base, "events").select(*SCOPE).distinct().select(
        *SCOPE, (F.lit(42.3331) + (u % 5 - 2) * 0.8).alias("centre_latitude"),
        (F.lit(-83.0511) + (u % 3 - 1) * 1.5).alias("centre_longitude"),
        (30 + (u % 4) * 60).cast("double").alias("radius"))
    return (ev_ops.match_events(top, _catalogue(spark, base), scope=SCOPE, centres=centres)
            .select(*SCOPE, "searched_artist", "artist_rank", "event_position", "event_id"))


@register("scoped_pipe6_digests")
def q_scoped_pipe6(spark, base):
    """PIPE5 + PIPE6 per listener: the events of each listener's 50 best artists as one
    digest document each."""
    scores = pipe.superfan_scores(_listener_features(spark, base), scope=SCOPE, rank=False)
    top = pipe.top_ranked(scores, 50, SCOPE).select(*SCOPE, "artist_name", F.col("rank").alias("artist_rank"))
    matched = ev_ops.match_events(top, _catalogue(spark, base), scope=SCOPE)
    return digest_ops.digest(matched, scope=SCOPE, as_of=DIGEST_AS_OF)
