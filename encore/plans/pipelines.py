"""Scoring pipelines: PIPE1 (features), PIPE2 (scores and rank), TOP2.

The other composites live with their operators - PIPE3/PIPE4 in
``operators.recency``, PIPE5 in ``operators.events``, PIPE6 in
``operators.digest``, PIPE7 in ``operators.chart`` - and the whole chain
is ``plans.job.run``.  PIPE8 (the exploration) is composed here.

Materialisation points are explicit and few: the per-artist feature
table is written once before the scaler fit reads it (so the play
scan is not repeated), and ranking writes its range-sorted input.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.constants import (ARTIST, DROPPED_FEATURES, LOG_SCORE_WEIGHTS, RAW_SCORE_WEIGHTS,
                              TOP_ARTISTS)
from encore.operators import features as feat
from encore.operators import explore, ranking, scaling
from encore.operators.ranking import top_k
from encore import session

features = feat.features  # PIPE1


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage."""
    return session.materialise(df, name)


def superfan_scores(feature_table: DataFrame, scope=(), key: str = ARTIST,
                    weights: dict | None = None, log: bool = True,
                    drop=DROPPED_FEATURES, rank: bool = True) -> DataFrame:
    """PIPE2: drop collinear features, log1p, min-max scale, weighted score, rank.

    Output (F8): the scaled ``log_*`` columns (or the raw scaled features
    with ``log=False``), ``superfan_score``, ``artist_name`` and ``rank``
    (1 = highest score, NULL scores last, ties by name).
    """
    scope = list(scope)
    weights = weights or (LOG_SCORE_WEIGHTS if log else RAW_SCORE_WEIGHTS)
    df = session.stored(scaling.drop_features(feature_table, drop), "feature-table")
    num = scaling.numeric_columns(df, exclude=scope)
    if log:
        df = scaling.prefixed_columns(scaling.add_log_columns(df, num), "log_", [*scope, key])
        num = [f"log_{c}" for c in num]
    else:
        df = df.select(*num, *scope, key)
    scaled = scaling.minmax_scale(df, num, scope)
    scored = (scaling.weighted_score(scaled, weights, "superfan_score")
              .withColumnRenamed(key, "artist_name"))
    if not rank:
        return scored
    return ranking.row_number_by_range(
        scored, [F.col("superfan_score").desc_nulls_last(), F.col("artist_name").asc()],
        scope, out="rank")


def top_ranked(scores: DataFrame, n: int = TOP_ARTISTS, scope=()) -> DataFrame:
    """TOP2: the first ``n`` by historical rank, in rank order.

    On a table that already carries ``rank`` this is a filter.  On an
    unranked score table the global rank is not computed at all: the
    first ``n`` come from a top-k (TakeOrderedAndProject, or a per-scope
    WindowGroupLimit) and are numbered among themselves, which gives the
    same ranks 1..n.
    """
    scope = list(scope)
    if "rank" in scores.columns:
        return scores.where(F.col("rank") <= n).orderBy(*scope, "rank")
    order = [F.col("superfan_score").desc_nulls_last(), F.col("artist_name").asc()]
    if scope:
        return ranking.top_k_per_group(scores, scope, order, n, out="rank").orderBy(*scope, "rank")
    top = ranking.top_k(scores, order, n)
    # numbering the n rows left by the top-k
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


class Exploration:
    """PIPE8: the exploration of a feature table.  Each part is computed when it is asked
    for and once: ``profile``, ``describe``, ``histogram``, ``spearman``, the log-scaled
    ``scores`` with the best ``preview`` of them, ``clusters`` with their ``sizes``, the
    ``frame`` of their coordinates, and ``kruskal_wallis``, the test of every feature across
    the clusters.  The table is written once; the profile is observed on the way."""

    PARTS = ("profile", "describe", "histogram", "spearman", "scores", "preview", "clusters",
             "sizes", "frame", "kruskal_wallis")

    def __init__(self, feature_table: DataFrame, preview: int = 30):
        self._given, self._preview = feature_table, preview

    def __getitem__(self, part: str) -> DataFrame:
        if part not in self.PARTS:
            raise KeyError(part)
        return getattr(self, part)

    @cached_property
    def _profiled(self) -> tuple[DataFrame, DataFrame]:
        return explore.profiled(self._given)

    @property
    def table(self) -> DataFrame:
        return self._profiled[0]

    @property
    def profile(self) -> DataFrame:
        return self._profiled[1]

    @cached_property
    def describe(self) -> DataFrame:
        return explore.describe(self.table)

    @cached_property
    def histogram(self) -> DataFrame:
        return explore.histogram(self.table)

    @cached_property
    def spearman(self) -> DataFrame:
        return explore.spearman(self.table)

    @cached_property
    def scores(self) -> DataFrame:
        # superfan_scores stores what it is given
        return superfan_scores(self.table if "_profiled" in self.__dict__ else self._given, rank=False)

    @property
    def preview(self) -> DataFrame:
        return top_k(self.scores, [F.col("superfan_score").desc_nulls_last(), F.col("artist_name").asc()],
                     self._preview)

    @property
    def columns(self) -> list[str]:
        """What clusters, coordinates and tests read: the scaled features and the score."""
        return [c for c in self.scores.columns if c.startswith("log_")] + ["superfan_score"]

    @cached_property
    def clusters(self) -> DataFrame:
        return materialise(explore.kmeans_clusters(materialise(self.scores), self.columns, "artist_name",
                                                   "superfan_score"))

    @property
    def sizes(self) -> DataFrame:
        return explore.cluster_sizes(self.clusters)

    @cached_property
    def frame(self) -> DataFrame:
        return explore.pca_coords(self.clusters, self.columns)

    @cached_property
    def kruskal_wallis(self) -> DataFrame:
        return explore.kruskal_wallis(self.clusters.fillna(0, subset=self.columns), "cluster", self.columns)

    def long(self) -> DataFrame:
        """All parts as one table (part, item, detail, metric, value)."""
        def rows(part, df, item, detail, metrics):
            long = explore.unpivot(df.withColumns({"_i": F.col(item).cast("string"), "_d": detail.cast("string")}),
                                   metrics, keys=["_i", "_d"], name="metric", drop_nulls=False)
            return long.select(F.lit(part).alias("part"), F.col("_i").alias("item"), F.col("_d").alias("detail"),
                               "metric", "value")

        none = F.lit("")
        by = self.clusters.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("count"), F.min("superfan_score").alias("least"),
            F.max("superfan_score").alias("greatest"))
        parts = [rows("profile", self.profile, "column_name", F.col("dtype"), ["non_null"]),
                 rows("describe", self.describe, "column_name", none,
                      [c for c in self.describe.columns if c != "column_name"]),
                 rows("histogram", self.histogram, "column_name", F.col("bin"), ["bin_lo", "bin_hi", "count"]),
                 rows("spearman", self.spearman, "col_a", F.col("col_b"), ["rho"]),
                 rows("clusters", by, "cluster", none, ["count", "least", "greatest"]),
                 rows("frame", self.frame, "artist_name", F.col("cluster"),
                      [*[c for c in self.frame.columns if c.startswith("PC")], "superfan_score"]),
                 rows("kruskal_wallis", self.kruskal_wallis, "feature", none, ["statistic", "p_value", "groups", "N"])]
        return reduce(DataFrame.unionByName, parts)


def explore_features(feature_table: DataFrame, preview: int = 30) -> Exploration:
    """PIPE8: the exploration of a feature table, part by part or as one long table."""
    return Exploration(feature_table, preview)
