"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (orders 1 to 3, lower-cased letters, runs of other
characters as one space) per language are gathered with Spark over a bounded sample
of labelled documents, smoothed into a log-probability matrix of buckets x languages
(both bounded) and broadcast.  A batch of texts is one sparse matrix: the bucket ids
of all n-grams with one row pointer per text; scores are segment sums of gathered
matrix rows.

``score`` is the posterior of the predicted language with log-likelihoods divided by
the number of orders, since each character is counted once per order.

Cases: a null text or one without a letter is ``und`` with score 0; equal texts get
equal results; ties between languages go to the first in name order; a training set
without labels makes every text ``und``; very long texts are scored in pieces;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import slices

#: Labelled documents that training takes at most, but one of each language at least.
SAMPLE_DOCS = 20_000
#: Languages that a model may hold; more are refused.
MAX_LANGS = 500
ORDERS = 3
BITS = 16
#: Characters whose n-grams are in memory at once.
PIECE = 1 << 18


def clean(text: str | None) -> np.ndarray:
    """Code points of the text: lower-cased letters, other runs as one space."""
    text = (text or "").lower()
    if not text.isascii() or not text.isalpha():
        text = "".join([c if c.isalpha() else " " for c in text])
        text = " ".join(text.split())
    if not text:
        return np.array([], np.uint32)
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(chars: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-grams of orders 1 to ORDERS, piece by piece, none twice."""
    mask, step = np.uint32((1 << bits) - 1), PIECE
    for at in range(0, len(chars), step):
        part = chars[at:at + step + ORDERS - 1]
        h, out = np.zeros(len(part), np.uint32), []
        for n in range(1, ORDERS + 1):
            h = h[:len(part) - n + 1] * np.uint32(0x01000193) ^ (part[n - 1:] + np.uint32(n * 0x9E37))
            mixed = h * np.uint32(0x85EBCA6B)
            out.append(((mixed ^ (mixed >> np.uint32(15))) & mask)[:step])
        yield np.concatenate(out)


def batch_rows(texts, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of a batch in bounded pieces: (text number, row pointer, bucket ids)."""
    rows, starts, ids, held = [], [], [], 0
    for i, t in enumerate(texts):
        for b in buckets(clean(t), bits):
            if len(b):
                rows.append(i)
                starts.append(held)
                ids.append(b)
                held += len(b)
            if held > 2 * PIECE:
                yield np.array(rows), np.array(starts), np.concatenate(ids)
                rows, starts, ids, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), np.concatenate(ids)


#: Languages, log-probabilities (buckets x languages), log-priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def fitted(langs: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.5) -> Model:
    """Smoothed model from n-gram counts (buckets x languages) and document counts."""
    p = counts + smoothing
    return langs, np.log(p / p.sum(axis=0)).astype(np.float32), np.log((docs + 1.0) / (docs + 1.0).sum())


def scores(model: Model, texts) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior of each text."""
    langs, logp, prior = model
    n = len(texts)
    if not langs:
        return ["und"] * n, np.zeros(n)
    total, seen = np.zeros((n, len(langs))), np.zeros(n, np.int64)
    for rows, starts, ids in batch_rows(texts):
        np.add.at(total, rows, np.stack([np.add.reduceat(logp[:, k][ids], starts, dtype=np.float64)
                                         for k in range(len(langs))], axis=1))
        np.add.at(seen, rows, np.diff(np.append(starts, len(ids))))
    z = prior + total / ORDERS
    best = z.argmax(axis=1)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    score = np.where(seen > 0, 1 / z.sum(axis=1), 0.0)
    return [langs[k] if s else "und" for k, s in zip(best, seen)], score


def quota(n: list[int], total: int) -> int:
    """The most rows a language may give so that all give ``total`` at most (but 1 each)."""
    left, sizes = total, sorted(n)
    for i, k in enumerate(sizes):
        share = left // (len(sizes) - i)
        if k > share:
            return max(1, share)
        left -= k
    return max(1, sizes[-1]) if sizes else 1


def least_rows(rows: DataFrame, most: int) -> DataFrame:
    """(text, lang, n): of each language the ``most`` rows of least hash h, equal
    rows (one text, language and hash) as one with their number n."""
    cell = F.shiftright("h", 53)
    by_cell = rows.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # the cell of each language in which its last row lies, and the rows before that cell
    edge = (by_cell.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
            .where(F.col("before") < most).groupBy("lang")
            .agg(F.max_by(F.struct("cell", "before"), "cell").alias("e")).select("lang", "e.*").toArrow().to_pylist())
    spark = rows.sparkSession
    edges = F.broadcast(spark.createDataFrame([(r["lang"], r["cell"], r["before"]) for r in edge],
                                              "lang string, edge long, before long"))
    near = rows.join(edges, "lang")
    over = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (near.where(cell == F.col("edge")).groupBy("lang", "before", "h").agg(F.count("*").alias("n"))
            .withColumn("taken", F.col("before") + F.coalesce(F.sum("n").over(over), F.lit(0)))
            .where(F.col("taken") < most).groupBy("lang")
            .agg(F.max_by(F.struct("h", F.least("n", F.lit(most) - F.col("taken")).alias("last")), "h").alias("e"))
            .select("lang", "e.*").toArrow().to_pylist())
    cut = F.broadcast(spark.createDataFrame([(r["lang"], r["h"], r["last"]) for r in cuts],
                                            "lang string, cut long, last long"))
    return (rows.join(cut, "lang").where(F.col("h") <= F.col("cut")).groupBy("lang", "h", "cut", "last")
            .agg(F.min("text").alias("text"), F.count("*").alias("n"))
            .select("text", "lang", F.when(F.col("h") == F.col("cut"), F.col("last")).otherwise(F.col("n")).alias("n")))


def train(docs: DataFrame, labelled: Column, sample_docs: int = SAMPLE_DOCS, text_col: str = "text",
          label_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fit on the rows where ``labelled`` holds and text and label are not null.  Of over
    ``sample_docs`` rows each language gives those of least hash over text and id, up to
    an equal quota, so that every language has some; priors count all rows."""
    rows = docs.where(labelled & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(label_col).count().orderBy(label_col).limit(MAX_LANGS + 1).collect()}
    if len(n) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    langs, total = sorted(n), sum(n.values())
    named = [F.col(c) for c in docs.columns if c.lower() == id_col.lower()]
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"),
                       F.shiftrightunsigned(F.xxhash64(text_col, *named), 1).alias("h"))
    if total > sample_docs:
        rows = least_rows(rows, quota(list(n.values()), sample_docs))
    else:
        rows = rows.select("text", "lang", F.lit(1).cast("long").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang, k in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for ids in buckets(clean(text.as_py())):
                    own += k * np.bincount(ids, minlength=1 << BITS)
        for lang, own in sums.items():  # at most 2**BITS rows a language
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                ["lang", "bucket", "n"])

    found = (rows.repartition(max(1, min(16, sample_docs // 1000)))
             .mapInArrow(count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((1 << BITS, len(langs)))
    col = {k: i for i, k in enumerate(langs)}
    counts[found["bucket"].to_numpy(), [col[k] for k in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return fitted(langs, counts, np.array([n[k] for k in langs], float))


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score to every row, under the names of
    ``results``; the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in [r.lower() for r in results]]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at):  # bounded memory, here and in the JVM that reads it
                lang, score = scores(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)],
                                                 [*names, *results])

    kept = docs.select(*names)
    schema = kept.withColumns({results[0]: F.lit(""), results[1]: F.lit(0.0)}).schema
    return kept.mapInArrow(run, schema)
