"""Sharding along a Hilbert curve.

Several metadata columns are quantised to equi-depth buckets (bounds are the exact quantiles
of the whole values of all rows), the bucket vector is turned into its index on a
Hilbert curve, rows are range-sorted by that index, and the sorted sequence is cut
into runs whose counts differ by at most one.  Rows of one shard are then close in
every dimension at once, so a reader that knows the shards' value ranges
(``zone_map``) skips most files for a filter on any of them.

Only the narrow columns are sorted; texts do not move.  Exact positions come from
per-partition counts of a checkpointed range sort (one number per partition reaches
the driver).  Ties on the curve are broken by the given columns; rows equal in all
of them are interchangeable.

Cases: null values take the lowest bucket, NaN the highest; a frequent value takes a bucket
in proportion to the rows before it; an empty table gives no rows; fewer rows
than shards leave the last shards empty; repeated rows get slots of their own;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import checkpointed, free_names, stored


def ordered(df: DataFrame, name: str) -> Column:
    """The column in a type whose order buckets follow: strings as UTF-8 bytes, fractions as
    doubles, other types as whole numbers."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return df[name].cast("binary")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return df[name].cast("double")
    return df[name].cast("long")


def bucket_bounds(df: DataFrame, value: Column, bits: int) -> list:
    """The quantiles of the values that part them into 2**bits buckets; nulls are left out.

    Distinct values with their counts are range-sorted and summed up, so a frequent value is
    one row; only the bounds (under 2**bits rows) and a sum per partition reach the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
              .repartitionByRange(parts, "v").sortWithinPartitions("v"))
    at = checkpointed(counts).withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "p", F.shiftright("_at", 33))
    before, n = [], 0
    for p, c in sorted(at.groupBy("p").agg(F.sum("c")).collect()):
        before.append((p, n))
        n += c
    if not n:
        return []
    offsets = df.sparkSession.createDataFrame(before, "p long, before long")
    here = Window.partitionBy("p").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (at.withColumn("c_here", F.sum("c").over(here)).join(F.broadcast(offsets), "p")
            .select("v", "c", (F.col("before") + F.col("c_here")).alias("upto")))

    def below(rows):
        """How many of the bounds, at places n * i / 2**bits, are among the first rows."""
        return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.call_function(
            "div", rows * F.lit(1 << bits) + F.lit(n - 1), F.lit(n)) - 1))

    times = (below(F.col("upto")) - below(F.col("upto") - F.col("c"))).cast("int")
    rows = upto.select("v", "upto", times.alias("times")).where("times > 0").collect()
    return [bytes(r.v) if isinstance(r.v, bytearray) else r.v
            for r in sorted(rows, key=lambda r: r.upto) for _ in range(r.times)]


def buckets(values: pd.Series, bounds: list) -> np.ndarray:
    """The number of bounds that are not above each value, 0 for null."""
    codes, uniques = pd.factorize(values)  # null and NaN are -1
    out = np.array([bisect_right(bounds, v) for v in uniques.tolist()] + [0], np.int64)
    return out[codes]


def curve_index(buckets: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``buckets`` (n, d), values under 2**bits."""
    x = [buckets[:, i].astype(np.int64) for i in range(buckets.shape[1])]
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of each level
        for i in range(d):
            hit, t = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ t)
            x[i] = np.where(hit, x[i], x[i] ^ t) if i else x[0]
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def with_curve(df: DataFrame, dims: Sequence[str], bits: int = 8, out: str = "hilbert") -> DataFrame:
    """Add the Hilbert index over ``dims`` (``bits`` * dims at most 62).  ``df`` is read
    once per dimension and once more and should be materialised."""
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must be at most 62")
    # pandas has one mark for NULL and NaN: NaN goes as infinity
    values = [F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v) if kind in ("float", "double") else v
              for v, kind in ((ordered(df, c), dict(df.dtypes)[c]) for c in dims)]
    bounds = [bucket_bounds(df, v, bits) for v in values]

    def index(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            parts = [buckets(s, k) for s, k in zip(cols, bounds)]
            yield pd.Series(curve_index(np.stack(parts, axis=1), bits))

    return df.withColumn(out, F.pandas_udf(index, "long")(*values))


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Add shard and slot: the rows sorted by ``order`` cut into ``shards`` runs
    whose counts differ by at most one, the larger ones first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    at = srt.withColumn("_at", F.monotonically_increasing_id())
    counts = sorted(at.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    before, n = [], 0
    for p, c in counts:
        before.append((p, n))
        n += c
    offsets = df.sparkSession.createDataFrame(before, "p long, before long")
    small, more = divmod(n, shards)
    cut = more * (small + 1)  # rows in the larger shards
    pos, first = F.col("_pos"), F.col("shard") * small + F.least("shard", F.lit(more))
    return (at.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("p"))
            .withColumn("_pos", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .withColumn("shard", F.when(pos < cut, F.floor(pos / F.lit(small + 1))).otherwise(
                more + F.floor((pos - cut) / F.lit(max(small, 1)))).cast("int"))
            .withColumn("slot", (pos - first).cast("long"))
            .drop("_at", "_pos", "p", "before"))


def zone_map(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per shard: rows, and least and greatest value of every dimension."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *[f(c).alias(f"{k}_{c}") for c in dims for k, f in (("min", F.min), ("max", F.max))])


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 8,
                    dims: Sequence[str] = ("lang", "source", "size", "doc_id"),
                    keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang, source, size, text_crc32, hilbert, shard, slot) of every
    document, and its columns ``keep``; size is the text's UTF-8 bytes plus 16, a null text
    has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = checkpointed(docs.select("doc_id", "lang", "source",
                                      (F.octet_length(text) + 16).cast("long").alias("size"),
                                      F.crc32(text.cast("binary")).alias("text_crc32"), *keep))
    curve = with_curve(narrow, dims, bits)
    return cut_runs(curve, ["hilbert", "doc_id", "text_crc32", "size", "lang", "source"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write whole documents in the order of the curve, one folder per shard; rows are
    found by a number of their own, so ids may be null or repeat.  A column named ``shard``
    is replaced."""
    kept = [c for c in docs.columns if c.lower() != "shard"]
    key, slot = free_names([*docs.columns, "lang", "source", "size", "text_crc32", "hilbert", "shard", "slot"],
                           "row_key", "row_slot")
    keyed = stored(docs.select(*kept).withColumn(key, F.monotonically_increasing_id()), "shard-rows")
    placed = shard_documents(keyed, shards, keep=[key]).select(key, "shard", F.col("slot").alias(slot))
    (keyed.join(placed, key).repartition("shard").sortWithinPartitions("shard", slot)
     .select(*kept, "shard").write.partitionBy("shard").parquet(path))
