"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.session import ensure_checkpoint_dir
from encore.sources.sinks import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: later uses
    neither recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder; partitions and their order stay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(taken, *wanted: str) -> list[str]:
    """The wanted column names, each followed by underscores until no column has it."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges`` (a long, b long).

    Alternates the large-star and small-star steps of the two-phase algorithm
    for components in MapReduce until the edge set no longer changes; every
    step is an aggregate with map-side minimum and an equality join (a hot
    centre is one row on one side, and adaptive execution splits the other).
    Returns (node, component) for each node that has an edge to another node;
    component is the smallest node.  No edges give an empty table.
    """
    a, b = F.col("a"), F.col("b")
    now = checkpointed(edges.where(a.isNotNull() & b.isNotNull() & (a != b))
                       .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
                 .where(a != b).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(a.alias("a"), F.col("m").alias("b")),
            F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = checkpointed(small.where(a != b).distinct())
        if mark(now) == seen:
            break
        seen = mark(now)
    return now.select(a.alias("node"), b.alias("component")).unionByName(
        now.select(b.alias("node"), b.alias("component"))).distinct()


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose values in ``column`` (texts or lists) hold at
    most ``most`` bytes or items; a row that holds more is a part of its own."""
    values = batch.column(column)
    size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(total, most + (total[lo - 1] if lo else 0), "right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
