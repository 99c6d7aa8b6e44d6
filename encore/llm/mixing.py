"""Mixing sources to target weights by Poisson replication.

Source s with n_s documents and target weight w_s gets the mean repetition rate
total * w_s / sum(w) / n_s.  Each document's count is drawn by inverting the Poisson
distribution with that mean at a uniform number made from a hash of the seed, its id
and its text, so that the draw is the same on every run and retry.  Documents are
exploded by their count and shuffled globally: copies are ordered by a hash of seed,
id, text and copy number; as hashes are uniform, equal hash ranges are even
partitions and no sampling pass is needed.

Cases: a null source is a source of its own; sources without a given weight have
weight 0 and leave; rows equal in id and text draw equal counts; null ids and texts
are hashed as such; empty tables and all-zero weights give no rows; very large rates
are drawn as sums of smaller ones; extra columns stay, whatever their names, but for
one named as ``copy_col``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import free_names

#: Rates above this are split, since exp(-rate) must not vanish.
PART_RATE = 256.0
#: Sources up to this many are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def poisson_inverse(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Least k with u < P(X <= k), X Poisson with mean ``rate`` (at most PART_RATE)."""
    p = np.exp(-rate)
    total, k, last = p.copy(), np.zeros(len(rate), np.int64), np.zeros(len(rate), bool)
    while True:
        go = (u >= total) & ~last
        if not go.any():
            return k
        k[go] += 1
        p = np.where(go, p * rate / np.maximum(k, 1), p)
        last |= go & (total + p == total) & (k > rate)  # rounding holds the sum under u
        total = np.where(go, total + p, total)


def uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes (splitmix64 finaliser)."""
    z = hashes.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def draw(rate: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Poisson counts; a rate of m parts is the sum of m draws with rate / m."""
    out, parts = np.zeros(len(rate), np.int64), np.maximum(np.ceil(rate / PART_RATE), 1).astype(np.int64)
    for i in range(int(parts.max(initial=0))):
        on = (parts > i) & (rate > 0)
        out[on] += poisson_inverse(rate[on] / parts[on], uniform(hashes[on], i))
    return out


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5,
                 total: int | None = None, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate).  Without ``weights`` the target weight of a source is
    its document count to the power ``alpha``; ``total`` is the size of the mixed
    corpus, by default that of ``docs``."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        w = F.pow("n_docs", F.lit(alpha))
    else:
        if any(x < 0 for x in weights.values()):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()],
                                                  "wsource string, w double")
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("wsource")), "left")
        w = F.coalesce("w", F.lit(0.0))
    counts = counts.withColumn("weight", w)
    sums = counts.agg(F.sum("weight"), F.sum("n_docs")).first()
    per_weight = (total if total is not None else sums[1] or 0) / sums[0] if sums[0] else 0.0
    return counts.select("source", "n_docs", (F.col("weight") * per_weight / F.col("n_docs")).alias("rate"))


def row_hash(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5,
        total: int | None = None, seed: int = 42, source_col: str = "source",
        id_col: str = "doc_id", text_col: str = "text", copy_col: str = "copy") -> DataFrame:
    """The mixed corpus in its global order: every document as often as drawn, with
    ``copy_col`` counting from 0; all columns of ``docs`` stay."""
    names = [c for c in docs.columns if c.lower() != copy_col.lower()]
    of, per, n_, at, pid = free_names([*docs.columns, copy_col], "_source", "_rate", "_n", "_order", "_pid")
    rates = source_rates(docs, weights, alpha, total, source_col)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = rates.select(F.col("source").alias(of), F.col("rate").alias(per))
    joined = docs.select(*names).join(F.broadcast(small) if few else small,
                                      docs[source_col].eqNullSafe(F.col(of)))

    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rate, h in batches:
            yield pd.Series(draw(rate.to_numpy(np.float64), h.to_numpy(np.int64)))

    n = F.pandas_udf(count, "long")(per, row_hash(seed, id_col, text_col))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = row_hash(seed + 1, id_col, text_col, copy_col)
    return (joined.withColumn(n_, n).where(F.col(n_) > 0)
            .withColumn(copy_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_) - 1)))
            .withColumn(at, order)
            .withColumn(pid, F.floor((F.shiftrightunsigned(F.col(at).bitwiseXOR(
                F.lit(-(1 << 63)).cast("long")), 32) * parts) / F.lit(1 << 32)).cast("int"))
            .repartitionById(parts, F.col(pid)).sortWithinPartitions(at, id_col, copy_col)
            .select(*names, copy_col))
