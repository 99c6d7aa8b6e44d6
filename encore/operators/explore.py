"""Exploration statistics (AGG17-AGG21, ML1-ML4, PIPE8).

Everything is computed on an unpivoted (feature, value) frame so all
features share one pass per statistic instead of a Python loop of jobs.
Quartiles are selected from brackets that sketches give; average ranks use the
distributed range-rank primitives in ``encore.operators.ranking``, never a
single-partition window or an in-memory percentile map per feature.
The fits (K-Means rounds, PCA) are distributed aggregations; their
fitted models are fixed-size (k centres, d x 2 loadings).
"""

from __future__ import annotations

import math

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from encore.constants import (DESCRIBE_QUANTILES, HIST_BINS, KMEANS_K, KMEANS_LIMIT,
                              KMEANS_SEED_ROUNDS, PCA_K)
from encore.operators.ranking import (average_rank, broadcast_if_small, join_per_value,
                                      row_number_by_range, running_sums_by_range)
from encore.operators.scaling import numeric_columns
from encore.session import materialise

#: The sketch errs by up to n / SKETCH_ACCURACY rows; brackets reach SKETCH_MARGIN times that.
SKETCH_ACCURACY, SKETCH_MARGIN = 10_000, 3


def unpivot(df: DataFrame, cols, keys=(), name: str = "column_name",
            value: str = "value", drop_nulls: bool = True) -> DataFrame:
    """Long (keys..., column_name, value double) form of ``cols``."""
    arr = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v"))
                    for c in cols])
    out = df.select(*keys, F.inline(arr)).withColumnsRenamed({"n": name, "v": value})
    return out.where(F.col(value).isNotNull()) if drop_nulls else out


def column_profile(df: DataFrame) -> DataFrame:
    """AGG19: (column_name, non_null, dtype) for every column, one aggregate pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"),
                             F.col(f.name).cast("long").alias("non_null"),
                             F.lit(f.dataType.simpleString()).alias("dtype"))
                    for i, f in enumerate(df.schema.fields)])
    return counts.select(F.inline(arr)).drop("i")


def profiled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG19 without a pass of its own: ``df`` materialised, and its column profile from
    the counts observed while it was written."""
    seen = Observation(f"profile-{uuid.uuid4().hex}")
    stored = materialise(df.observe(seen, *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]))
    counts = seen.get
    rows = [(f.name, int(counts[f"n{i}"]), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return stored, df.sparkSession.createDataFrame(rows, "column_name string, non_null long, dtype string")


def describe(df: DataFrame, cols=None, quantiles=DESCRIBE_QUANTILES, scope=()) -> DataFrame:
    """AGG18: count, mean, sample std, min, exact quartiles (linear
    interpolation), max per numeric column (per scope); NULLs excluded.

    Quartiles by selection, without sorting or shuffling the values: the aggregate that
    gives the other statistics also keeps a mergeable quantile sketch, whose answers a
    little below and above each quantile bracket it; a second pass counts what lies below
    the bracket and gathers, by value, only what lies in it (some 10^-3 of the rows; a value
    that many rows share is one row).  ``df`` is read twice and should be materialised."""
    scope = list(scope)
    cols = cols or numeric_columns(df, exclude=scope)
    g = [*scope, "column_name"]
    long = unpivot(df, cols, keys=scope)
    sides = [min(max(q + e * SKETCH_MARGIN / SKETCH_ACCURACY, 0.0), 1.0) for q in quantiles for e in (-1, 1)]
    stats = materialise(long.groupBy(*g).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.percentile_approx("value", sides, SKETCH_ACCURACY).alias("_sides")), "statistics")
    # values wanted for each quantile: those at floor and ceil of h = (n - 1) q, from 0
    targets = stats.select(*g, F.inline(F.array(*[F.struct(
        F.lit(q).alias("q"), ((F.col("count") - 1) * q).alias("_h"),
        F.get("_sides", F.lit(2 * i)).alias("_lo"), F.get("_sides", F.lit(2 * i + 1)).alias("_hi"))
        for i, q in enumerate(quantiles)])))
    # without a scope: one row per quantile and column, a proven small bound
    met = (long.join(F.broadcast(targets) if not scope else broadcast_if_small(targets), g)
           .where(F.col("value") <= F.col("_hi")))
    held = (met.withColumn("value", F.when(F.col("value") >= F.col("_lo"), F.col("value")))
            .groupBy(*g, "q", "_h", "value").agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*g, "q").orderBy(F.col("value").asc_nulls_first())
    held = held.withColumn("_to", F.sum("_c").over(upto))

    def at(h):  # the value whose rows hold position h; NULL if the bracket does not
        return F.max(F.when((F.col("_to") - F.col("_c") <= h) & (h < F.col("_to")), F.col("value")))

    h = F.col("_h")
    qv = materialise(held.groupBy(*g, "q", "_h").agg(at(F.floor(h)).alias("_a"), at(F.ceil(h)).alias("_z")),
                     "quantiles")
    missed = qv.where(F.col("_a").isNull() | F.col("_z").isNull())
    if missed.limit(1).count():  # a sketch erred by more than the margin: sort these groups
        qv = (qv.join(missed.select(*g, "q"), [*g, "q"], "left_anti")
              .unionByName(_by_position(long.join(missed.select(*g).distinct(), g, "left_semi"),
                                        missed.select(*g, "q", "_h"), g)))
    wide = qv.withColumn("qv", F.col("_a") + (h - F.floor(h)) * (F.col("_z") - F.col("_a"))).groupBy(*g).agg(*[
        F.max(F.when(F.col("q") == q, F.col("qv"))).alias(f"p{int(round(q * 100))}") for q in quantiles])
    return stats.join(wide, g, "left").select(
        *g, "count", "mean", "std", "min",
        *[f"p{int(round(q * 100))}" for q in quantiles], "max")


def _by_position(long: DataFrame, targets: DataFrame, g: list[str]) -> DataFrame:
    """The values at floor and ceil of ``_h`` by a distributed sort of all values; a row id
    splits a value that many rows share over several partitions."""
    ranked = row_number_by_range(long.withColumn("_row", F.monotonically_increasing_id()),
                                 [F.col("value").asc(), F.col("_row").asc()], g, out="_rn")
    h = F.col("_h")
    wanted = targets.withColumn("_rn", F.explode(F.array_distinct(F.array(
        (F.floor(h) + 1).cast("long"), (F.ceil(h) + 1).cast("long")))))
    return (ranked.join(wanted, [*g, "_rn"]).groupBy(*g, "q", "_h")
            .agg(F.min("value").alias("_a"), F.max("value").alias("_z")))


def histogram(df: DataFrame, cols=None, bins: int = HIST_BINS, scope=()) -> DataFrame:
    """AGG20: equal-width bins between min and max per column (per scope), last
    bin closed on the right, empty bins included; a constant column spans +-0.5."""
    scope = list(scope)
    cols = cols or numeric_columns(df, exclude=scope)
    g = [*scope, "column_name"]
    long = unpivot(df, cols, keys=scope)
    rng = long.groupBy(*g).agg(F.min("value").alias("_lo0"), F.max("value").alias("_hi0"))
    same = F.col("_lo0") == F.col("_hi0")
    rng = rng.select(*g,
                     F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("lo"),
                     F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("hi"))
    # without a scope: one row per column, a proven small bound
    binned = long.join(F.broadcast(rng) if not scope else rng, g).select(
        *g,
        F.least(F.floor((F.col("value") - F.col("lo")) * float(bins)
                        / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)).cast("int").alias("bin"))
    counts = binned.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*g, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    return (grid.join(counts, [*g, "bin"], "left")
            .select(*g, "bin",
                    (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def spearman(df: DataFrame, cols=None, scope=()) -> DataFrame:
    """AGG21: Spearman correlation for every column pair (upper triangle with
    the diagonal, per scope), pairwise-complete rows, average ranks for ties.
    A pair without complete rows is absent, one with a constant column NULL.

    A column's ranks within a pair depend only on which rows the partner leaves, and that
    only on the rows' pattern of NULLs (a bit mask).  So each column is ranked once for each
    different set of patterns that its partners leave, all sets in one pass: rows unpivot
    to one (column, value) each, the counts per distinct value and set run up in value
    order, and the ranks join back by value.  One aggregate over the rows' rank vectors then
    gives all sums of products."""
    scope = list(scope)
    cols = cols or numeric_columns(df, exclude=scope)
    d = len(cols)
    mask = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, c in enumerate(cols)), F.lit(0).cast("long"))
    base = materialise(df.select(*scope, *cols).withColumn("_mask", mask)
                       .withColumn("_row", F.monotonically_increasing_id()), "spearman-rows")
    masks = sorted(r[0] for r in base.select("_mask").distinct().collect())  # at most 2^d
    sets: list[list[tuple[int, ...]]] = [[] for _ in cols]
    of = {}
    for i in range(d):
        for j in range(d):
            rows = tuple(m for m in masks if m >> i & 1 and m >> j & 1)
            if rows not in sets[i]:
                sets[i].append(rows)
            of[i, j] = sets[i].index(rows)
    width = max(map(len, sets), default=0)
    if not width:
        return df.sparkSession.createDataFrame([], T.StructType(
            [f for f in df.schema.fields if f.name in scope])).selectExpr(
                "*", "'' AS col_a", "'' AS col_b", "0D AS rho")

    def counted(i, s):  # 1 for rows of the set
        rows = sets[i][s] if s < len(sets[i]) else ()
        return F.expr(f"if(_mask in ({', '.join(map(str, rows))}), 1L, 0L)" if rows else "0L")

    parts = range(width)
    each = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"),
                              *[counted(i, s).alias(f"_f{s}") for s in parts]) for i, c in enumerate(cols)])
    long = base.select(*scope, "_row", F.inline(each)).where(F.col("_v").isNotNull())
    counts = long.groupBy(*scope, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"),
                                                  *[F.sum(f"_f{s}").alias(f"_f{s}") for s in parts])
    up = running_sums_by_range(counts, [F.col("_v").asc()], {f"_f{s}": f"_t{s}" for s in parts}, [*scope, "_c"])
    ranked = materialise(up.select(*scope, "_c", "_v", "_n", *[f"_f{s}" for s in parts], *[
        (F.col(f"_t{s}") - (F.col(f"_f{s}") - 1) / 2.0).alias(f"_r{s}") for s in parts]), "ranks")
    facts = ranked.groupBy(*scope, "_c").agg(
        F.array(*[F.sum(f"_f{s}") for s in parts]).alias("n"),
        F.array(*[F.count(F.when(F.col(f"_f{s}") > 0, 1)) for s in parts]).alias("values"),
        F.array(*[F.sum(F.col(f"_f{s}") * F.col(f"_r{s}") * F.col(f"_r{s}")) for s in parts]).alias("square"))
    table = ranked.select(*scope, "_c", "_v", "_n", F.array(*[f"_r{s}" for s in parts]).alias("_ranks"))
    vectors = (join_per_value(long.select(*scope, "_row", "_c", "_v"), table, [*scope, "_c", "_v"], "_n", "inner")
               .groupBy(*scope, "_row")
               .agg(*[F.max(F.when(F.col("_c") == i, F.col("_ranks"))).alias(f"_x{i}") for i in range(d)]))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = vectors.groupBy(*scope).agg(*[
        F.sum(F.get(f"_x{i}", F.lit(of[i, j])) * F.get(f"_x{j}", F.lit(of[j, i]))).alias(f"_p{i}_{j}")
        for i, j in pairs])
    rows = sums.select(*scope, F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.lit(of[i, j]).alias("_a"), F.lit(of[j, i]).alias("_b"),
        F.col(f"_p{i}_{j}").alias("_p")) for i, j in pairs]))).where(F.col("_p").isNotNull())
    for side, at in (("_i", "_a"), ("_j", "_b")):
        own = facts.select(*scope, F.col("_c").alias(side), *[F.col(c).alias(f"{c}{at}") for c in ("n", "values", "square")])
        rows = rows.join(own, [*scope, side]).withColumns(
            {f"{c}{at}": F.get(f"{c}{at}", F.col(at)) for c in ("n", "values", "square")})
    # every set's ranks have mean (n + 1) / 2
    middle = F.col("n_a") * F.pow((F.col("n_a") + 1) / 2.0, F.lit(2))
    var = [F.col(f"square{at}") - middle for at in ("_a", "_b")]
    rho = F.when((F.col("values_a") > 1) & (F.col("values_b") > 1), (F.col("_p") - middle) / F.sqrt(var[0] * var[1]))
    name = F.array(*[F.lit(c) for c in cols])
    return rows.select(*scope, F.get(name, F.col("_i")).alias("col_a"), F.get(name, F.col("_j")).alias("col_b"),
                       rho.alias("rho"))


def _uniform(round_: int) -> Column:
    """A number in [0, 1) for each key and round: the first 48 bits of an MD5."""
    return F.expr(f"cast(conv(substring(md5(cast(concat_ws('|', '{round_}', cast(_key as string)) as binary)), 1, 12), "
                  f"16, 10) as double) / {float(1 << 48)}D")


def _nearest(rows: DataFrame, points: list[list[float]]) -> DataFrame:
    """``rows`` (_key, _0, _1, ...) with the number, from 1, of the first nearest point
    and the squared distance to it.  The points stand in one array literal, which generated
    code reads as data: the next round's points need no new code."""
    d = len(points[0])
    flat = F.expr("array(" + ", ".join(f"{float(v)!r}D" for p in points for v in p) + ")")
    gaps = ["0D" + "".join(f" + (_{i} - get(_p, {d * j + i})) * (_{i} - get(_p, {d * j + i}))" for i in range(d))
            for j in range(len(points))]
    return (rows.withColumn("_p", flat).withColumn("_gaps", F.expr(f"array({', '.join(gaps)})"))
            .withColumn("_gap", F.array_min("_gaps"))
            .withColumn("_raw", F.expr("cast(array_position(_gaps, _gap) as int)")).drop("_p", "_gaps"))


def kmeans_seeds(rows: DataFrame, d: int, k: int, rounds: int = KMEANS_SEED_ROUNDS) -> list[list[float]]:
    """Starting centres of ``rows`` (_key, _0.._d-1) by k-means||: from one row, each round
    takes every row with a chance of 2k times its share of the summed squared distance to
    the rows taken so far (drawn by a hash of the key, so neither partitions nor retries
    matter).  About 2k rows a round reach the driver.  Weighted by the rows nearest to them,
    they are cut to ``k``: the heaviest first, then always the one of greatest weight times
    squared distance."""
    cols = [f"_{i}" for i in range(d)]
    place = lambda r: [_uniform(r).asc(), F.col("_key").asc_nulls_first(), *[F.col(c).asc() for c in cols]]
    seeds = [list(r) for r in rows.orderBy(*place(0)).limit(1).select(*cols).collect()]
    for r in range(1, rounds + 1 if seeds else 1):
        far = _nearest(rows, seeds)
        total = round(far.agg(F.sum("_gap")).first()[0], 9)
        if not total:
            break
        taken = far.where(_uniform(r) * F.lit(total) < F.lit(2.0 * k) * F.col("_gap"))
        seeds += [list(row) for row in taken.orderBy(*place(r)).select(*cols).collect()]
    if not seeds:
        return []
    weight = {r[0] - 1: r[1] for r in _nearest(rows, seeds).groupBy("_raw").count().collect()}
    gap = [float("inf")] * len(seeds)
    out: list[list[float]] = []
    while len(out) < k:
        best = max(range(len(seeds)), key=lambda i: (weight.get(i, 0) * (gap[i] if out else 1.0), -i))
        out.append(seeds[best])
        gap = [min(g, sum((a - b) * (a - b) for a, b in zip(s, seeds[best]))) for g, s in zip(gap, seeds)]
    return out


def kmeans_clusters(df: DataFrame, cols, key: str, score: str, k: int = KMEANS_K,
                    limit: int = KMEANS_LIMIT) -> DataFrame:
    """ML1: K-Means on the features with NULL as 0, in separate columns: the returned
    columns keep their NULLs.  Adds ``cluster``, 0..k-1 by descending mean ``score``.

    Lloyd's rounds from :func:`kmeans_seeds` until no centre moves; more than ``limit``
    rounds are an error, never an unfinished fit.  A round is one aggregate (k rows reach
    the driver); centres are rounded to 9 places against the order of summation.  An empty
    cluster keeps its centre; a row as near to two centres goes to the first.  Rows should
    be materialised: every round reads them."""
    cols = list(cols)
    x = {f"_{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(cols)}
    rows = df.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in x.items()])
    centres = kmeans_seeds(rows, len(cols), k) or [[0.0] * len(cols)] * k
    for _ in range(limit):
        new = list(centres)
        for row in _nearest(rows, centres).groupBy("_raw").agg(*[F.avg(c).alias(c) for c in x]).collect():
            new[row[0] - 1] = [round(v, 9) for v in row[1:]]
        if new == centres:
            break
        centres = new
    else:
        raise RuntimeError(f"centres still move after {limit} rounds")
    placed = _nearest(df.withColumns(x), centres).drop("_gap", *x)
    means = placed.groupBy("_raw").agg(F.avg(score).alias("_m"))
    # k rows: bounded by the cluster count
    order = means.select("_raw", (F.row_number().over(
        Window.orderBy(F.col("_m").desc_nulls_last(), F.col("_raw"))) - 1).alias("cluster"))
    return placed.join(F.broadcast(order), "_raw").drop("_raw")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """AGG17: rows per cluster."""
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))


def pca_model(df: DataFrame, cols, k: int = PCA_K) -> tuple[list[float], list[list[float]]]:
    """ML2: (means, loadings) of the first ``k`` principal components of the features with
    NULL as 0.  One aggregate gives the d(d+1)/2 covariances; their eigenvectors are taken on
    the driver (d x d numbers), each with its largest absolute loading positive."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    d = len(x)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                 *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[d:]):
        gram[i, j] = gram[j, i] = v if v is not None and v == v else 0.0
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :k].T
    signs = [1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0 for v in vectors]
    return [v or 0.0 for v in row[:d]], [(v * s).tolist() for v, s in zip(vectors, signs)]


def pca_coords(df: DataFrame, cols, k: int = PCA_K, prefix: str = "PC") -> DataFrame:
    """ML2 + ML3: adds the centred projection on the first ``k`` principal components;
    the columns of ``df`` keep their NULLs, which the projection reads as 0."""
    means, loadings = pca_model(df, cols, k)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    return df.withColumns({f"{prefix}{j + 1}": sum(
        ((c - F.lit(m)) * F.lit(w) for c, m, w in zip(x, means, load)), F.lit(0.0))
        for j, load in enumerate(loadings)})


def chi2_tail(x: float | None, df: int) -> float | None:
    """Upper tail of the chi-square distribution for any degrees of freedom (closed
    form: a finite sum, with ``erfc`` where ``df`` is odd)."""
    if x is None or df < 1:
        return None
    half, odd = x / 2, df % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    for i in range(df // 2):
        n = i + odd / 2
        total += math.exp(n * math.log(half) - half - math.lgamma(n + 1)) if half > 0 else float(n == 0)
    return min(total, 1.0)


def kruskal_wallis(df: DataFrame, group: str, cols) -> DataFrame:
    """ML4: tie-corrected Kruskal-Wallis H and p for each feature across groups.

    Average ranks per feature (distributed), rank sums per (feature, group),
    tie correction from the tie-group sizes.  ``p`` is the chi-square tail
    with (groups - 1) degrees of freedom.  All-tied features and a single
    group give NULL.
    """
    long = unpivot(df, cols, keys=[group], name="feature")
    ranked = average_rank(long, "value", ["feature"], "_r")
    per = ranked.groupBy("feature", group).agg(F.sum("_r").alias("_R"),
                                                F.count(F.lit(1)).alias("_n"))
    tot = per.groupBy("feature").agg(F.sum("_n").alias("N"),
                                     F.sum(F.col("_R") * F.col("_R") / F.col("_n")).alias("_s"),
                                     F.count(F.lit(1)).alias("groups"))
    ties = (long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t"))
            .groupBy("feature").agg(F.sum(F.pow("t", 3) - F.col("t")).alias("_tt")))
    j = tot.join(ties, "feature")
    n = F.col("N").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    c = 1 - F.col("_tt") / (F.pow(n, 3) - n)
    hc = F.when(c > 0, h / c)
    # one row per feature: the tail of each statistic is taken on the driver
    rows = [(*r, chi2_tail(r["statistic"], r["groups"] - 1))
            for r in j.select("feature", hc.alias("statistic"), "groups", "N").collect()]
    return df.sparkSession.createDataFrame(
        rows, "feature string, statistic double, groups long, N long, p_value double"
    ).select("feature", "statistic", "p_value", "groups", "N")
