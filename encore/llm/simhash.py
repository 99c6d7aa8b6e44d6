"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint holds 64 bits.  Two that differ in at most 3 bits, cut into two
halves, differ in at most one bit of one half.  So each distinct fingerprint is
indexed under 64 variants: a half with one bit position made a wildcard.  Equal
variants meet by a shuffle on the variant key and a sorted sweep; each meeting
is verified on all 64 bits, and a run of m fingerprints gives at most m - 1
links that span its local components, never all pairs.  A run of over
``RUN_ROWS`` fingerprints, which agree on 31 bits, is not held in a task: its
rows go to a second level with variants of the other half, after which at most
18 bits are free, so that no run can have more than 2**18 members.

Cases: null and empty texts have no words, hence fingerprint zero, and link
like any other; equal texts have equal fingerprints and are compared once;
repeated rows each get a result row; a null doc_id is never a component id
unless its whole component has none; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import checkpointed, connected_components, stored

#: Rows of one variant key that a task holds at once.
RUN_ROWS = 8192


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    ones, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[i:i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *others, fp) of every row; fp is the fingerprint as a signed long."""
    names = [id_col, *others]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names) + "fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(0)), np.uint64,
                              b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], [*names, "fp"])

    return docs.select(text_col, *names).mapInArrow(run, schema)


def local_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) links that span the components of distinct ``fps`` under
    Hamming distance; each component is searched from its first member."""
    child, root = [], []
    rest = fps
    while len(rest) > 1:
        start, rest = rest[0], rest[1:]
        front = np.array([start])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, 4_000_000 // len(rest))
            for i in range(0, len(front), step):
                near |= (np.bitwise_count(front[i:i + step, None] ^ rest) <= distance).any(axis=0)
            front, rest = rest[near], rest[~near]
            child.append(front)
            root.append(np.full(len(front), start))
    none = np.array([], np.uint64)
    return np.concatenate([none, *child]), np.concatenate([none, *root])


def _sweep(distance: int, hold: int | None):
    """Rows (key, fp) sorted by key -> links (a, b), or (key, a, null) for the
    rows of a run longer than ``hold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(a.view(np.int64)),
                 pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))],
                ["key", "a", "b"])

        def close(key, parts):
            fps = np.unique(np.concatenate(parts))
            if len(fps) > 1:
                a, b = local_links(fps, distance)
                if len(a):
                    yield out(np.full(len(a), key), a, b)

        key, parts, held, over = None, [], 0, False
        for batch in batches:
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            pick = (ends - starts > 1)
            pick[[0, -1]] = True  # may go on from or into another batch
            pairs = pick & (ends - starts == 2)  # runs of two that are whole: one step for all
            pairs[[0, -1]] = False
            x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
            near = (x != y) & (np.bitwise_count(x ^ y) <= distance)
            if near.any():
                yield out(keys[starts[pairs]][near], x[near], y[near])
            for s, e in zip(starts[pick & ~pairs], ends[pick & ~pairs]):
                if key is None or keys[s] != key:
                    if parts and not over:
                        yield from close(key, parts)
                    key, parts, held, over = keys[s], [], 0, False
                parts.append(fps[s:e])
                held += e - s
                if hold and held > hold:
                    over = True
                if over:
                    a = np.concatenate(parts)
                    yield out(np.full(len(a), key), a, None)
                    parts = []
        if parts and not over:
            yield from close(key, parts)

    return run


def _variants(rows: DataFrame, value, width: int) -> DataFrame:
    """Every row once per variant ``v`` of ``value``, with ``part``: the low half
    (v under ``width``) or the high half, bit v mod ``width`` taken out."""
    v = F.col("v")
    half = F.when(v < width, value).otherwise(F.shiftrightunsigned(value, width))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(width)))
    return (rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
            .withColumn("part", half.bitwiseAND(F.lit((1 << width) - 1)).bitwiseAND(F.bitwise_not(bit))))


def _swept(rows: DataFrame, distance: int, hold: int | None) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_sweep(distance, hold), "key long, a long, b long"))


def variant_links(distinct: DataFrame, distance: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: every pair within
    ``distance`` bits is joined by a path of links, and every link is such a pair
    or lies in such a path."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one wildcard find up to 3 differing bits")
    first = _variants(distinct.select("fp"), F.col("fp"), 32).select(
        F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(F.col("part")).alias("key"), "fp")
    met = stored(_swept(first, distance, run_rows), "simhash-links")
    links, over = met.where("b IS NOT NULL").select("a", "b"), met.where("b IS NULL")
    if over.isEmpty():
        return links
    # the half that the first key does not hold: variants under 32 keep the low half
    other = F.when(F.shiftright("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    second = _variants(over.select("key", F.col("a").alias("fp")), other, 16).select(
        F.xxhash64("key", "v", "part").alias("key"), "fp")
    return links.unionByName(_swept(second, distance, None).select("a", "b"))


def _nodes(rows: DataFrame, first: Column, distance: int, run_rows: int) -> DataFrame:
    """(fp, first, component) of each distinct fingerprint; first is the least value."""
    least = checkpointed(rows.groupBy("fp").agg(F.min(first).alias("first")))
    of = connected_components(variant_links(least, distance, run_rows))
    return least.join(of, least["fp"] == of["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3,
                       id_col: str = "doc_id", text_col: str = "text",
                       run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id
    reachable over links of at most ``distance`` differing bits."""
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    node = _nodes(rows, F.col(id_col), distance, run_rows)
    ids = node.groupBy("component").agg(F.min("first").alias("component_id"))
    per_fp = node.join(ids, "component").select(F.col("fp").alias("fp2"), "component_id")
    return (rows.join(per_fp, rows["fp"] == per_fp["fp2"])
            .select(id_col, rows["fp"], "component_id"))


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 3,
               keep_nameless: bool = True) -> DataFrame:
    """One row of each component, by a key of its own: the least doc_id (null last), of
    those the least text hash, of those the first row.  With ``keep_nameless`` all rows
    without a doc_id stay beside it.  All columns stay."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    named = keyed.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"),
                         F.col(key).alias("key"))
    rows = checkpointed(fingerprints(named, shingle, others=("text_hash", "key")))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "key")
    node = _nodes(rows, first, distance, RUN_ROWS)
    kept = node.groupBy("component").agg(F.min("first").alias("first")).select(
        F.col("first.key").alias(key), F.col("first.nameless").alias("nameless"))
    if not keep_nameless:
        return keyed.join(kept, key, "left_semi").drop(key)
    return (keyed.join(kept.where(~F.col("nameless")), key, "left_semi")
            .unionByName(keyed.where("doc_id IS NULL")).drop(key))
