"""Audit of how the sources of each language differ in their words.

One Arrow pipeline runs inside the scan: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and hash ``group_by`` give a task's partial counts of (language,
source, term).  They are shuffled once by (language, term) and merged; a language keeps
the terms of at least ``min_docs`` of its documents.  With V kept terms, N occurrences of
them in a group and a term's count there, the term's share is

    p = 1 + floor(10^9 (count + 1) / (N + V))

and its divergence from a reference share q is floor((p - q)^2 / q).  All of it is integer
arithmetic.  Part ``term`` ranks a group's terms against its language.  Part ``pair`` sums
over all kept terms for every two sources of a language: the merged counts are cut into
columnar shards by the term's hash, each shard is one matrix of terms by sources, and the
terms that a shard does not hold, with count 0 in both sources, are added at the end.  More
than ``BLOCK`` sources of a language are compared block by block.

Skew: a hot group or word is one row per task and source, shards follow the terms and not
the groups, and the ranks of terms keep ``top`` rows per group before any shuffle.

Cases: null text, language and source are empty texts; a group without terms takes part
with counts 0; a language without kept terms has pairs of value 0; equal values rank by
the item's UTF-8 bytes; equal documents count each; empty tables give no rows; other
columns are ignored.  Counts up to 10^14 are exact, larger ones fail the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import slices, stored

#: What stands between terms: ASCII characters other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: SCALE as a product, so that counts up to 10^14 do not overflow on the way.
HIGH, LOW = 31_250, 32_000
#: Rows of partial counts that a task holds.
HELD_ROWS = 400_000
#: Rows of merged counts in a shard, and sources compared in one matrix.
SHARD_ROWS, BLOCK = 200_000, 64
#: Groups up to this many are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by task; a null term
    tells that the group occurs."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                          for c in ("text", "lang", "source")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            both = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return both.rename_columns(["group", "term", "n", "docs"])

        def report(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([g[i] for g in numbers], pa.string()) for i in (0, 1))
            group = table["group"]
            out = pa.table([langs.take(group), sources.take(group), table["term"].cast(pa.string()),
                            table["n"], table["docs"]], ["lang", "source", "term", "n", "docs"])
            return iter(out.to_batches(max_chunksize=10_000))

        for b in batches:
            for part in slices(b, 0):
                keys = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                groups = pa.array([numbers.setdefault(k, len(numbers)) for k in keys], pa.int32())
                lists = pc.split_pattern_regex(pc.ascii_lower(part.column(0)), BETWEEN)
                term, doc = lists.flatten(), pc.list_parent_indices(lists)
                full = pc.greater(pc.binary_length(term), 0)
                coded = term.filter(full).dictionary_encode()
                per_doc = pa.table([doc.filter(full), coded.indices], ["doc", "code"]).group_by(
                    ["doc", "code"]).aggregate([([], "count_all")])
                own = pa.table([groups.take(per_doc["doc"]), per_doc["code"], per_doc["count_all"]],
                               ["group", "code", "n"]).group_by(["group", "code"]).aggregate(
                                   [("n", "sum"), ("n", "count")])
                held.append(pa.table([own["group"], coded.dictionary.take(own["code"]), own["n_sum"],
                                      own["n_count"]], ["group", "term", "n", "docs"]))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [merged()]
                    rows = len(held[0])
                    if rows > HELD_ROWS // 2:
                        yield from report(held[0])
                        held, rows = [], 0
        if held:
            yield from report(merged())
        if numbers:
            zero = pa.array([0] * len(numbers), pa.int64())
            yield from report(pa.table([pa.array(range(len(numbers)), pa.int32()), pa.nulls(len(numbers), pa.string()),
                                        zero, zero], ["group", "term", "n", "docs"]))

    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def merged_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total, lead): merged counts of the kept terms, with the
    language's total and a mark on one row of each term; rows with a null term are the
    groups."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (partial_counts(docs).repartition(parts, "lang", "term").groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    each = (each.withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
            .withColumn("lead", F.col("source") == F.min("source").over(term)))
    return each.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("docs", "in_docs")


def share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / size) in whole numbers."""
    def div(a, b):
        return F.call_function("div", a, b)
    up = (count + 1) * F.lit(HIGH).cast("long")
    return 1 + div(up, size) * F.lit(LOW).cast("long") + div((up % size) * F.lit(LOW).cast("long"), size)


def share_of(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`share` in numpy."""
    up = (count + 1) * HIGH
    return 1 + up // size * LOW + up % size * LOW // size


def shard_sums(table: pa.Table) -> pa.Table:
    """Of one shard: for every two sources (of the two blocks), the summed divergence over
    the shard's terms, the number of these terms, and the divergence of a term that
    occurs in neither."""
    term = table["term"].combine_chunks()
    mark = pc.is_null(term)
    groups = table.filter(mark).sort_by([("idx", "ascending")])
    idx, name = groups["idx"].to_numpy(), groups["source"].combine_chunks()
    size = groups["size"].to_numpy()
    cells = table.filter(pc.invert(mark))
    code = cells["term"].combine_chunks().dictionary_encode()
    row, n_terms = code.indices.to_numpy(), len(code.dictionary)
    col, n = np.searchsorted(idx, cells["idx"].to_numpy()), cells["n"].to_numpy()
    order = np.argsort(row, kind="stable")
    row, col, n = row[order], col[order], n[order]
    k = len(idx)
    sums = np.zeros((k, k), np.int64)
    step = max(1, (1 << 20) // max(k, 1))
    for lo in range(0, n_terms, step):
        a, b = np.searchsorted(row, [lo, lo + step])
        counts = np.zeros((min(step, n_terms - lo), k), np.int64)
        counts[row[a:b] - lo, col[a:b]] = n[a:b]
        p = share_of(counts, size)
        for s in range(k):
            d = p[:, s:s + 1] - p
            sums[s] += (d * d // p).sum(0)
    zero = share_of(np.zeros(k, np.int64), size)
    rest = (zero[:, None] - zero) ** 2 // zero
    first, second = groups["block_a"][0].as_py(), groups["block_b"][0].as_py()
    block = idx // BLOCK
    own = block[:, None] != block if first != second else np.ones((k, k), bool)
    i, j = np.nonzero(own & ~np.eye(k, dtype=bool))
    lang = pa.array([table["lang"][0].as_py()] * len(i), pa.string())
    return pa.table([lang, name.take(pa.array(i)), name.take(pa.array(j)), pa.array(sums[i, j]),
                     pa.array(np.full(len(i), n_terms, np.int64)), pa.array(rest[i, j])],
                    ["lang", "source", "item", "value", "seen", "rest"])


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language; ``groups`` has
    lang, source, idx, size (N + V), n_sources, n_terms and shards."""
    facts = ["lang", "source", "idx", "size", "n_sources", "shards"]
    some = groups.where("n_sources > 1 AND n_terms > 0")
    cells = (kept.where("term IS NOT NULL").select("lang", "source", "term", "n")
             .join(some.select(*facts), ["lang", "source"])
             .withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))))
    marks = some.select(*facts, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    last = F.floor((F.col("n_sources") - 1) / F.lit(BLOCK)).cast("int")
    own = F.floor(F.col("idx") / F.lit(BLOCK)).cast("int")
    rows = (cells.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .withColumns({"block_a": F.least(own, F.col("other")), "block_b": F.greatest(own, F.col("other"))}))
    sums = (rows.select("lang", "block_a", "block_b", "shard", "source", "idx", "size", "term", "n")
            .groupBy("lang", "block_a", "block_b", "shard")
            .applyInArrow(shard_sums, "lang string, source string, item string, value long, seen long, rest long")
            .groupBy("lang", "source", "item")
            .agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("rest").alias("rest")))
    terms = groups.groupBy("lang").agg(F.first("n_terms").alias("n_terms"))
    return (sums.join(terms, "lang")
            .select("lang", "source", "item",
                    (F.col("value") + (F.col("n_terms") - F.col("seen")) * F.col("rest")).alias("value")))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, q, value, rank) for the sources of all documents."""
    kept = stored(merged_counts(docs, min_docs), "term-counts")
    size = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("own"), F.count(F.when(F.col("lead"), F.col("term"))).alias("lead"),
        F.count("term").alias("cells"))
    lang = Window.partitionBy("lang")  # one row per source
    terms = F.sum("lead").over(lang)
    groups = stored(size.select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("idx"),
        F.count("*").over(lang).alias("n_sources"), terms.alias("n_terms"),
        (F.col("own") + terms).alias("size"), (F.sum("own").over(lang) + terms).alias("lang_size"),
        (1 + F.floor(F.sum("cells").over(lang) / F.lit(SHARD_ROWS))).alias("shards")), "term-groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = F.broadcast(groups) if few else groups

    p, q = share(F.col("n"), F.col("size")), share(F.col("total"), F.col("lang_size"))
    rise = (kept.where("term IS NOT NULL")
            .join(side.select("lang", "source", "size", "lang_size"), ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .where("p > q"))
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    rise = (rise.select("lang", "source", F.lit("term").alias("part"), "item",
                        F.expr("(p - q) * (p - q) div q").alias("value"))
            .withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top))
    none = groups.where("n_terms = 0").select("lang", "source")
    pairs = pair_sums(kept, side).unionByName(
        none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item")
        .withColumn("value", F.lit(0).cast("long")))
    pairs = (pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(group)))
    return (rise.unionByName(pairs.select(*rise.columns))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
