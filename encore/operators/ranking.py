"""Distributed ranking primitives and top-k (WIN2, WIN4-6, TOP1-7, SET2).

A window without ``PARTITION BY`` (``row_number() over (order by s)``)
plans a single-partition exchange: every row in one task.  Instead:

1. range-partition on (scope, order) and sort within partitions, so each
   partition holds a contiguous slice of the global order;
2. tag rows with ``monotonically_increasing_id`` (partition index in the
   high bits, in-partition position in the low bits) and write the result
   once to the shared checkpoint folder, so the two passes below read
   identical ids even after an executor loss (range bounds are sampled);
3. count rows per (scope, partition) and turn the counts into offsets:
   without a scope that is one row per range partition, summed on the
   driver as RDD.zipWithIndex does; with a scope, a window partitioned by
   scope (at most #partitions rows per scope);
4. rank = offset + in-partition position + 1.

Ties are broken by the caller's full ordering (always include a key), so
the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.session import materialise, stored

_PART_BITS = 33
BROADCAST_ROWS = 1_000_000   # checked size bound for broadcasting a derived table


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def require_scope(df: DataFrame, scope) -> DataFrame:
    """``df`` with a check on its scope columns: a NULL fails the job, since joins on
    the scope would drop the row without a word."""
    if not scope:
        return df
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in scope column {c}")))
                           .otherwise(F.col(c)) for c in scope})


def range_sorted(df: DataFrame, order, scope=(), num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted, id-tagged copy of ``df``, materialised once.

    Adds ``_mid`` (monotonic id) and ``_pid`` (range partition index).
    """
    df = require_scope(df, scope)
    keys = [*_as_cols(scope), *_as_cols(order)]
    # without an explicit count AQE may merge adjacent ranges of a small
    # input (still range-partitioned); ids are assigned after that, once
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    r = (ranged.sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = stored(r, "range-sorted")
    return r.withColumn("_pid", F.shiftright("_mid", _PART_BITS))


def _segment_offsets(r: DataFrame, scope, weight: str | None) -> DataFrame:
    """Per (scope, range partition): row count (or weight), first id and the
    total of the earlier partitions of the same scope (``_off``)."""
    seg = r.groupBy(*scope, "_pid").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"),
        F.min("_mid").alias("_first"))
    if not scope:
        # One row per range partition: a bound fixed by the partition count,
        # so (like RDD.zipWithIndex) the counts come to the driver, the
        # offsets are summed there and go back as a broadcast table.
        rows = sorted(seg.collect(), key=lambda x: x["_pid"])
        out, acc = [], 0
        for x in rows:
            out.append((int(x["_pid"]), int(x["_n"] or 0), int(x["_first"]), acc))
            acc += int(x["_n"] or 0)
        schema = "_pid long, _n long, _first long, _off long"
        return F.broadcast(r.sparkSession.createDataFrame(out, schema))
    w = Window.partitionBy(*scope).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # With a scope the table follows the number of scopes (each scope spans
    # at most #partitions rows of the window): broadcast under a checked
    # size, sort-merge joined on (scope, partition) beyond it.
    return broadcast_if_small(seg.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it has at most BROADCAST_ROWS rows (counted; ``df``
    is a cheap aggregate over a checkpointed input, so it is not stored)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_number_by_range(df: DataFrame, order, scope=(), out: str = "rank",
                        num_partitions: int | None = None) -> DataFrame:
    """WIN2: ``row_number() over (partition by scope order by order)`` without a
    single-partition window."""
    scope = list(scope)
    r = range_sorted(df, order, scope, num_partitions)
    seg = _segment_offsets(r, scope, None)
    out_df = r.join(seg.select(*scope, "_pid", "_off", "_first"), [*scope, "_pid"])
    return (out_df.withColumn(out, (F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
                              .cast("long"))
            .drop("_mid", "_pid", "_off", "_first"))


def running_sum_by_range(df: DataFrame, order, weight: str, scope=(), out: str = "cum",
                         num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` in (scope, order) order, distributed.

    Inside a range partition the running sum is a window over
    (scope, partition) - bounded by the partition size - and the totals of
    earlier partitions come from the segment offsets.
    """
    scope = list(scope)
    r = range_sorted(df, order, scope, num_partitions)
    seg = _segment_offsets(r, scope, weight)
    w = (Window.partitionBy(*scope, "_pid").orderBy("_mid")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumn("_local", F.sum(weight).over(w))
    out_df = local.join(seg.select(*scope, "_pid", "_off"), [*scope, "_pid"])
    return (out_df.withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_mid", "_pid", "_off", "_local"))


def running_sums_by_range(df: DataFrame, order, weights: dict[str, str], scope) -> DataFrame:
    """:func:`running_sum_by_range` of several columns in one pass: ``weights`` maps each to
    the name of its running sum.  ``scope`` must not be empty."""
    scope = list(scope)
    r = range_sorted(df, order, scope)
    seg = r.groupBy(*scope, "_pid").agg(*[F.sum(w).alias(f"_off_{w}") for w in weights])
    # one row per range partition and scope: at most #partitions rows of the window
    before = Window.partitionBy(*scope).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(*scope, "_pid", *[F.coalesce(F.sum(f"_off_{w}").over(before), F.lit(0)).alias(f"_off_{w}")
                                       for w in weights])
    here = (Window.partitionBy(*scope, "_pid").orderBy("_mid")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumns({out: F.sum(w).over(here) for w, out in weights.items()})
    joined = local.join(broadcast_if_small(seg), [*scope, "_pid"])
    return (joined.withColumns({out: F.col(out) + F.col(f"_off_{w}") for w, out in weights.items()})
            .drop("_mid", "_pid", *[f"_off_{w}" for w in weights]))


def join_per_value(rows: DataFrame, table: DataFrame, keys, count_col: str = "_c",
                   how: str = "left", salt_buckets: int | None = None) -> DataFrame:
    """Join ``rows`` to a per-key ``table`` that carries each key's row count.

    The table is materialised; if it has at most ``BROADCAST_ROWS`` rows
    (a checked size) it is broadcast.  Otherwise a key holding more than
    one partition's fair share of the rows is split into pieces of a
    quarter share: it gets ceil(4 x count / fair share) salts, its table
    row is replicated once per salt, and its data rows are dealt
    round-robin over the salts, so a key with a third of all rows spreads
    over the partitions.  The replicated rows total at most about five
    times the partition count, and the list of hot keys (at most the
    partition count) is broadcast.
    """
    keys = list(keys)
    table = materialise(table, "per-value")
    n = table.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count_col)), keys, how)
    s = salt_buckets or _parts(rows)
    total = table.agg(F.sum(count_col)).first()[0] or 0
    fair = max(1, -(-total // s))
    # pieces of a quarter share: the pieces of one hot key hash into the
    # partitions with little stacking; replicated rows stay <= 4 x s + s
    piece = max(1, fair // 4)
    hot = (table.where(F.col(count_col) > fair)
           .select(*keys, F.ceil(F.col(count_col) / piece).cast("int").alias("_salts")))
    if hot.limit(1).count() == 0:
        return rows.join(table.drop(count_col), keys, how)
    salted_rows = (rows.join(F.broadcast(hot), keys, "left")
                   .withColumn("_salt", F.pmod(F.monotonically_increasing_id(),
                                               F.coalesce("_salts", F.lit(1))))
                   .drop("_salts"))
    salted_table = (table.join(F.broadcast(hot), keys, "left")
                    .withColumn("_salt", F.explode(F.sequence(
                        F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
                    .drop("_salts", count_col))
    return salted_rows.join(salted_table, [*keys, "_salt"], how).drop("_salt")


def split_join(rows: DataFrame, table: DataFrame, keys, parts: int | None = None) -> DataFrame:
    """Inner equi-join of ``rows`` and ``table``, a materialised one whose keys may repeat.

    ``table`` is broadcast if counted to have at most BROADCAST_ROWS rows.  Beyond that
    both are shuffled, and a key that holds more than one partition's fair share of the
    rows is split: its rows are dealt round-robin over pieces of a quarter share, and its
    table rows go to every piece.  ``rows`` is read twice then, once to count."""
    keys = list(keys)
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    parts = parts or _parts(rows)
    counts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
                    .join(table.select(*keys).distinct(), keys, "left_semi"), "key-counts")
    total = counts.agg(F.sum("_c")).first()[0] or 0
    fair = max(1, -(-total // parts))
    # at most ``parts`` keys hold more than a fair share
    hot = (counts.where(F.col("_c") > fair)
           .select(*keys, F.ceil(F.col("_c") / max(1, fair // 4)).cast("int").alias("_salts")))
    if hot.limit(1).count() == 0:
        return rows.join(table, keys)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = (rows.join(F.broadcast(hot), keys, "left")
             .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("_salts"))
    spread = (table.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def average_rank(df: DataFrame, value: str, scope=(), out: str = "avg_rank") -> DataFrame:
    """WIN6: rank of ``value`` with ties given their average rank; NULL stays NULL.

    avg_rank(v) = #(values < v) + (count(v) + 1) / 2.  The counts per
    distinct value combine map-side (a hot value collapses to one row),
    the running sum runs over distinct values only, and the result joins
    back on (scope, value) - broadcast under a checked size, else with hot
    values salted (:func:`join_per_value`).
    """
    scope = list(scope)
    return join_per_value(df, average_rank_table(df, value, scope, out), [*scope, value])


def average_rank_table(df: DataFrame, value: str, scope=(), out: str = "avg_rank") -> DataFrame:
    """WIN6 as a table: one row per (scope, distinct non-null value) with its
    average rank and its row count ``_c``; join it back with
    :func:`join_per_value`."""
    scope = list(scope)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*scope, value).agg(F.count(F.lit(1)).alias("_c")))
    cum = running_sum_by_range(counts, [F.col(value).asc()], "_c", scope, "_cum")
    return cum.select(*scope, value, "_c",
                      (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """TOP1/TOP3/TOP7: ordered top-k; plans as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge)."""
    return df.orderBy(*_as_cols(order)).limit(k)


def top_k_per_group(df: DataFrame, group, order, k: int, out: str = "position") -> DataFrame:
    """TOP5: at most ``k`` rows per group; planned as WindowGroupLimit on both
    sides of the shuffle, so a large group is cut to ``k`` map-side."""
    w = Window.partitionBy(*group).orderBy(*_as_cols(order))
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def presence_score(ranked: DataFrame, rank: str, scope=(), out: str = "api_presence_score") -> DataFrame:
    """WIN5 + AGG16: ``(n - rank) / (n - 1)``; rank 1 -> 1.0, last -> 0.0.

    ``n`` is the list length (count per scope, joined back).  A one-item
    list gives 1.0 instead of a division error.
    """
    scope = list(scope)
    if scope:
        totals = ranked.groupBy(*scope).agg(F.count(F.lit(1)).alias("_total"))
        joined = ranked.join(broadcast_if_small(totals), scope, "left")
    else:
        n = ranked.count()
        joined = ranked.withColumn("_total", F.lit(n).cast("long"))
    score = F.when(F.col("_total") == 1, F.lit(1.0)).otherwise(
        (F.col("_total") - F.col(rank)).cast("double") / (F.col("_total") - 1).cast("double"))
    return joined.withColumn(out, score).drop("_total")


def ordered_distinct(df: DataFrame, value: str, position: str, scope=()) -> DataFrame:
    """SET2: keep each value once, at its first position (order-preserving distinct)."""
    return df.groupBy(*scope, value).agg(F.min(position).alias(position))
