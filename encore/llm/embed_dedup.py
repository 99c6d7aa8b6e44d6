"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Only vectors with equal, non-null labels are compared.  Equal vectors are collapsed
first.  Spherical k-means, fitted on a bounded sample, assigns every vector to its
home cell (label, dimension, nearest centre).  A pair can straddle two cells, so a
vector also visits each cell that may hold a partner: the angle to the bisector of
the two centres, and the angle to the cell's centre less the cell's radius, must
both be within the threshold's angle.  So no pair is lost, and each row's links are
counted once, in its home cell.

A cell of m members is cut into ceil(m / BLOCK) blocks; one group compares one block
of home rows with one block of members, so no group is larger than about two blocks
however large the cell.  A group returns counts and links that span its local
components, never the pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components and
rows with a null label link with nothing and form their own component; vectors of
different length are not compared; equal vectors link; rows that share a vec_id
count as one in components; a null vec_id is never a component id of others; ids of
2**62 or more fail the job; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import checkpointed, connected_components, stored

#: Rows of a block; a group holds at most about two blocks.
BLOCK = 2048
#: Rows that a cell of the largest label should have on average.
CELL_ROWS = 4096
#: Most cells (bounds the broadcast centres) and most vectors that k-means fits on.
MAX_CELLS, SAMPLE = 4096, 20_000
#: Bytes that the sample and the centres may each take, whatever the dimension.
MODEL_BYTES = 64 << 20
#: Nodes of vectors without an id are row numbers above this; ids must lie below it.
NO_ID = 1 << 62


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safely for tiny and huge values."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit rows ``x``, started from k rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return np.unique(centres, axis=0)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column whose rows all have one length."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def fit_centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centres of the most frequent dimension; others use one cell."""
    sizes = vectors.groupBy("label", "dim").count().groupBy("dim").agg(
        F.max("count").alias("most"), F.sum("count").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return {}
    fit_rows = max(1, MODEL_BYTES // (8 * sizes["dim"]))
    k = min(MAX_CELLS, fit_rows, math.ceil(sizes["most"] / CELL_ROWS))
    if k < 2:
        return {}
    share = min(1 << 20, math.ceil((1 << 20) * min(SAMPLE, fit_rows) / sizes["n"]))
    rows = (vectors.where((F.col("dim") == sizes["dim"]) & (F.pmod("h1", F.lit(1 << 20)) < share))
            .orderBy("h1", "h2").limit(2 * min(SAMPLE, fit_rows)).select("embedding").toArrow())
    x = unit(matrix(rows["embedding"].combine_chunks()))
    return {sizes["dim"]: spherical_kmeans(x, min(k, len(x)))}


def members(vectors: DataFrame, centres: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Every vector in its home cell and in the cells that it visits: adds cell and
    home (boolean)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    reach = math.acos(min(1.0, max(-1.0, cosine))) + 1e-9
    names = vectors.columns

    def by_dim(b: pa.RecordBatch):
        dims = b.column(names.index("dim")).to_numpy()
        for d in np.unique(dims):
            yield int(d), np.flatnonzero(dims == d)

    def sims(b, at, c):
        return unit(matrix(b.column(names.index("embedding")).take(pa.array(at)))) @ c.T

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {d: np.full(len(c), 2.0) for d, c in shared.value.items()}
        for b in batches:
            for d, at in by_dim(b):
                if d in low:
                    s = sims(b, at, shared.value[d])
                    np.minimum.at(low[d], s.argmax(axis=1), s.max(axis=1))
        for d, v in low.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(v), pa.int32()),
                                              pa.array(range(len(v)), pa.int32()), pa.array(v)],
                                             ["dim", "cell", "low"])

    wide = {}
    if centres:
        found = (vectors.mapInArrow(radii, "dim int, cell int, low double")
                 .groupBy("dim", "cell").agg(F.min("low")).collect())
        wide = {d: np.zeros(len(c)) for d, c in centres.items()}
        for d, c, low in found:
            wide[d][c] = math.acos(min(1.0, max(-1.0, low))) if low < 2 else -math.inf

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at in by_dim(b):
                if d not in shared.value:
                    row, cell, home = at, np.zeros(len(at), np.int32), np.ones(len(at), bool)
                else:
                    c = shared.value[d]
                    s = sims(b, at, c)
                    own = s.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-300))[own]
                    past = (s[np.arange(len(s)), own][:, None] - s) / apart
                    go = (past <= math.sin(min(reach, math.pi / 2)) + 1e-9)
                    go &= np.arccos(np.clip(s, -1, 1)) <= wide[d] + reach
                    go[np.arange(len(s)), own] = True
                    i, cell = np.nonzero(go)
                    row, home = at[i], cell == own[i]
                kept = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(cell, pa.int32()), pa.array(home)], [*names, "cell", "home"])

    schema = vectors.withColumns({"cell": F.lit(0), "home": F.lit(True)}).schema
    return vectors.mapInArrow(place, schema)


def block_links(cosine: float):
    """Group function: links of one block of home rows to one block of members, as
    (node, n) counts and (node, root) spanning links."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
        x = unit(matrix(table["embedding"].combine_chunks()))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(a), np.int64)
        left, right = [], []  # links that span: a row and its first partner, then merged
        root = np.arange(len(a) + len(b))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(a), 256):
            rows = a[at:at + 256]
            near = x[rows] @ x[b].T >= cosine
            near &= (h1[rows, None] != h1[b]) | (h2[rows, None] != h2[b])  # not the row itself
            n[at:at + len(rows)] = near @ copies[b]
            for i in np.flatnonzero(near.any(axis=1)):
                js = np.flatnonzero(near[i])
                me = find(at + i)
                for j, first in zip(*np.unique(root[len(a) + js], return_index=True)):
                    other = find(j)
                    if other != me:  # the first partner there stands for the merge
                        root[other] = me
                        left.append(rows[i])
                        right.append(b[js[first]])
        hit = np.flatnonzero(n)
        return pa.table({
            "h1": pa.array(np.concatenate([h1[a][hit], h1[left] if left else np.array([], np.int64)])),
            "h2": pa.array(np.concatenate([h2[a][hit], h2[left] if left else np.array([], np.int64)])),
            "n": pa.array(np.concatenate([n[hit], np.zeros(len(left), np.int64)])),
            "a": pa.array([None] * len(hit) + node[left].tolist(), pa.int64()),
            "b": pa.array([None] * len(hit) + node[right].tolist(), pa.int64())})

    return run


def embedding_components(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id",
                         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    e = F.col("embedding")
    valid = (F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
             & F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
             & F.exists(e, lambda v: v != 0))
    number = vectors[id_col].cast("long")
    rows = (vectors.select(F.when(number >= NO_ID, F.raise_error(F.lit("id of 2**62 or more")))
                           .otherwise(number).alias("id"), vectors[label_col].alias("label"),
                           vectors[vec_col].cast("array<double>").alias("embedding"))
            .withColumn("valid", F.coalesce(valid, F.lit(False)))
            .withColumn("h1", F.xxhash64("label", "embedding"))
            .withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label")))
    distinct = checkpointed(rows.where("valid").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("id").alias("node"), F.count("*").alias("copies"))
        .withColumn("node", F.coalesce("node", F.lit(NO_ID) + F.monotonically_increasing_id()))
        .withColumn("dim", F.size("embedding")))
    placed = members(distinct, fit_centres(distinct), cosine)
    cell = ["label", "dim", "cell"]
    placed = stored(placed, "embedding-members")
    blocks = (placed.groupBy(*cell).count()
              .select(*cell, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = (placed.join(blocks, cell)
             .withColumn("block", F.pmod(F.col("h2"), F.col("blocks")).cast("int"))
             .withColumn("every", F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.where("home").withColumn("other", F.explode("every")).select(
        *cell, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"),
        "h1", "h2", "node", "copies", "embedding").unionByName(
        dealt.withColumn("other", F.explode("every")).select(
            *cell, F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"),
            "h1", "h2", "node", "copies", "embedding"))
    found = stored(groups.groupBy(*cell, "i", "j").applyInArrow(
        block_links(cosine), "h1 long, h2 long, n long, a long, b long"), "embedding-links")
    links = found.where("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    of = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    per = (distinct.select("h1", "h2", "node", "copies").join(links, ["h1", "h2"], "left")
           .join(of, "node", "left")
           .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"),
                   (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
                   F.coalesce("component", "node").alias("component"))
           .withColumn("component", F.when(F.col("component") < NO_ID, F.col("component"))))
    own = rows.select("id", "valid", "h1", "h2")
    return (own.join(per, F.col("valid") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
            .select(F.col("id").alias("vec_id"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("valid"), F.col("component")).otherwise(F.col("id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
