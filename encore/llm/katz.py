"""Katz backoff n-gram language model with Good-Turing discounts.

Tokens are the lower-cased words of a text and one end; a start, which is no token, stands
before them as a history.  With c the training count of an n-gram, c(h) that of its history
h, d the Good-Turing discount for c up to 5 and 1 above:

    P(w | h) = d c(h, w) / (c(h) + 1/2)      if c(h, w) > 0
             = alpha(h) P(w | h')            otherwise, h' being h without its first word,

down to P(w), the smoothed share.  alpha(h) makes all words and one unknown word sum to one
exactly; the half keeps mass for unseen words where no count of h is discounted.  Every
training word has n-grams of its own; words are told apart by a 64-bit hash.

The tokens of the documents are stored in chunks, each with a dictionary of its words, in a
table bucketed by chunk.  For
each order a chunk sends its distinct n-grams, once, with their counts in its training
documents, packed by bucket (a hash of the history).  A bucket's task adds the counts up,
writes that part of the n-gram table (``part=grams`` of the folder ``order=n``) and answers
each chunk: the n-gram's count, its id, and of its history what the discounts leave and
what the seen words hold by the order below.  The next order's histories are those ids, so
counts and probabilities are made recursively, and a chunk ends with P of each token.  A
history that holds more than one bucket's share of the training tokens is dealt by history
and word, and its sums are merged.  ``score`` and ``fit`` are this one path; for
``score_with`` the stored table's rows take the place of training documents.

A null text is empty (its end is scored), repeated rows are scored alike, an empty table
gives no rows, without training rows all words are unknown; ids of any type, also null ones,
stay as they are.  Long texts are cut into pieces that overlap by their histories; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.sources.sinks import scratch_path

#: Counts up to K are discounted.
K = 5
CHUNK = 1 << 19  # tokens of a chunk
BUCKET = 1 << 20  # tokens for each bucket
TASK_BYTES = 4 << 20  # text for each task over chunks
TABLE_ROWS = 1 << 16  # n-grams in a row of the table
#: Codes of a chunk's tokens, and ids: START and END are fixed, id 0 is unknown.
START, END, FIRST_WORD = 0, 1, 2
START_ID, END_ID, FIRST_ID = 1, 2, 3
STATS = K + 2  # of a history: n-grams seen 1..K times, its count, what seen words hold below

ENTRIES = "chunk long, bucket int, ctx binary, runs binary, next binary, n binary, low binary"
MERGED = ("part string, chunk long, bucket int, ids binary, counts binary, stats binary, ctx array<long>, "
          "next array<long>, n array<long>, low array<double>")
SCORES = "rid long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Model(NamedTuple):
    """Training totals; the counts that words have, descending, and the first id of each
    (at most sqrt(2 tokens) of them); for each order from 2 the discounts and the sums of
    the histories that are dealt over buckets.  The n-gram tables are under ``path``."""
    path: str
    order: int
    buckets: int
    tokens: int
    distinct: int
    docs: int
    levels: np.ndarray | None = None
    starts: np.ndarray | None = None
    discounts: dict[int, np.ndarray] = {}
    hot: dict[int, dict[int, np.ndarray]] = {}

    @property
    def base_total(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    @property
    def low_total(self) -> float:
        """What smoothed shares are divided by: all words, end and unknown."""
        return self.base_total + 0.1 * (self.docs == 0)


    def word_ids(self, count: np.ndarray, rank: np.ndarray, bucket: int) -> np.ndarray:
        """Ids of words by count, rank among the bucket's words of that count, and bucket;
        frequent words have small ones."""
        ids = np.zeros(len(count), np.int64)
        known = count > 0
        ids[known] = (self.starts[np.searchsorted(-self.levels, -count[known])] + rank[known] * self.buckets + bucket)
        return ids

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """P(w) of words by id."""
        count = np.where(ids == END_ID, self.docs, 0)
        word = ids >= FIRST_ID
        count[word] = self.levels[np.searchsorted(self.starts, ids[word], "right") - 1]
        return (count + 0.1) / self.low_total


# ------------------------------------------------------------------ packing --

def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits as compressed planes of their bytes that are not all 0."""
    v = np.ascontiguousarray(values).view(np.uint64)
    width = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(v).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * size, "zstd", asbytes=True), np.uint8)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = planes.reshape(width, size).T
    return out.view(np.int64).reshape(-1)


def pack_floats(values: np.ndarray) -> bytes:
    """Numbers of few distinct values: the values, and each one's place among them."""
    distinct, place = np.unique(values, return_inverse=True)
    own = pack(distinct.astype(np.float64))
    return len(own).to_bytes(8, "little") + own + pack(place.astype(np.int64))


def unpack_floats(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return unpack(data[8:cut]).view(np.float64)[unpack(data[cut:])]


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A hash of one or two ids."""
    x = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29)) ^ np.asarray(b).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def blocks(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The parts of a sorted array of buckets."""
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)]):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


# ------------------------------------------------------------------- chunks --

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def chunk_schema(id_type: str) -> str:
    return (f"chunk long, tokens long, train_tokens long, train_docs long, rid array<long>, id array<{id_type}>, "
            "held array<boolean>, train array<boolean>, lens array<int>, leads array<int>, codes binary, words binary")


def chunked(order: int, size: int):
    """Chunks of documents and of pieces of long ones.  A piece starts with up to
    ``order`` - 1 tokens of before (``leads``), which are histories only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        doc, made = first, 0
        rows, codes, words = [], [], {}

        def chunk():
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            by_hash = np.argsort(hashes)
            place = np.empty(len(words) + FIRST_WORD, np.int64)
            place[:FIRST_WORD] = START, END
            place[FIRST_WORD + by_hash] = np.arange(len(words)) + FIRST_WORD
            cols = list(zip(*rows))
            lens, leads, train = np.array(cols[4]), np.array(cols[5]), np.array(cols[3])
            ends = int(np.sum(np.array(cols[6])[train]))
            values = [[first + made], [int((lens - leads).sum())], [int((lens - leads)[train].sum())], [ends],
                      *[[list(c)] for c in cols[:6]], [pack(place[np.array(codes, np.int64)])],
                      [pack(np.diff(hashes[by_hash], prepend=np.uint64(0)))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(values, types)], names)

        id_type = None
        for b in batches:
            if id_type is None:
                id_type = b.schema.field(1).type
                names = ["chunk", "tokens", "train_tokens", "train_docs", "rid", "id", "held", "train", "lens",
                         "leads", "codes", "words"]
                types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.bool_()),
                         pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            for text, key, held, train in zip(b.column(0), *[c.to_pylist() for c in b.columns[1:]]):
                own = words_of(text.as_py())
                total = len(own) + 2  # with start and end
                at = 1
                while at < total:
                    end = min(total, at + size)
                    lead = min(at, order - 1)
                    part = own[max(0, at - lead - 1):end - 1]
                    if at == lead:
                        codes.append(START)
                    add, n = words.setdefault, FIRST_WORD
                    codes += [add(w, len(words) + n) for w in part]
                    if end == total:
                        codes.append(END)
                    rows.append((doc, key, held, train, end - at + lead, lead, end == total))
                    at = end
                    if len(codes) >= size:
                        yield chunk()
                        made += 1
                        rows, codes, words = [], [], {}
                doc += 1
        if rows:
            yield chunk()

    return run


class Tokens:
    """A chunk's tokens: code, place in the piece, whether they are scored, and learnt."""

    def __init__(self, row: dict):
        """``row`` with or without its words."""
        self.row = row
        lens, leads = np.array(row["lens"]), np.array(row["leads"])
        self.piece = np.repeat(np.arange(len(lens)), lens)
        self.codes = unpack(row["codes"])
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.scored = self.place >= leads[self.piece]
        self.train = self.scored & np.array(row["train"], bool)[self.piece]


def send_words(buckets: int):
    """A chunk's words with their training counts; buckets are ranges of the hash, so they
    follow the dictionary's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                t = Tokens(row)
                words = np.cumsum(unpack(row["words"]).view(np.uint64), dtype=np.uint64)
                n = np.bincount(t.codes[t.train], minlength=len(words) + FIRST_WORD)[FIRST_WORD:]
                bucket = (words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                yield entries([(row["chunk"], k, b"", b"", pack(np.diff(words[s], prepend=np.uint64(0))), pack(n[s]),
                                b"") for k, s in blocks(bucket)])

    return run


def entries(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
        ["chunk", "bucket", "ctx", "runs", "next", "n", "low"])


def evaluate(t: Tokens, answers: list[dict], model: Model, order: int, id_type: pa.DataType):
    """P of each token by the orders below ``order``, as far as answered; yields the
    n-grams of ``order`` to send, or returns the scores where ``order`` is beyond the
    model's.  Answers come by order and bucket, as the n-grams were sent."""
    by_order: dict[int, list[dict]] = {}
    for a in sorted(answers, key=lambda a: (a["order"], a["bucket"])):
        by_order.setdefault(a["order"], []).append(a)
    own = [(unpack(a["counts"]), unpack(a["ids"]), a["bucket"]) for a in by_order.get(1, [])]
    fixed = np.array([START_ID, END_ID]) if model.docs else np.zeros(2, np.int64)
    ids = np.concatenate([fixed, *[model.word_ids(*o) for o in own]])
    counts = np.concatenate([np.full(2, model.docs), *[o[0] for o in own]])
    word, c_word = ids[t.codes], counts[t.codes]
    word_rank = np.unique(ids, return_inverse=True)[1][t.codes]  # under 2 * CHUNK
    p = (c_word + 0.1) / model.low_total
    gram, c_gram = word, c_word  # id and count of the n-gram that ends here
    for n in range(2, order + 1):
        if n > model.order:
            break
        ctx, c_ctx = np.roll(gram, 1), np.roll(c_gram, 1)
        at = np.flatnonzero((t.place >= n - 1) & (ctx > 0))
        before = np.roll(word_rank, 1) if n == 2 else np.unique(ctx, return_inverse=True)[1]
        _, pick, entry = np.unique(before[at] << 21 | word_rank[at], return_index=True, return_inverse=True)
        pick = at[pick]
        heavy = c_ctx[pick] * model.buckets > model.tokens
        bucket = (mixed(ctx[pick], np.where(heavy, word[pick] + 1, 0)) % np.uint64(model.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        pick, heavy, eb = pick[by], heavy[by], bucket[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        entry = place[entry]
        eh, ew = ctx[pick], word[pick]
        turn = np.ones(len(eh), bool)  # first n-gram of a history in a bucket
        turn[1:] = (eh[1:] != eh[:-1]) | (eb[1:] != eb[:-1])
        if n == order:
            learnt = np.bincount(entry, t.train[at], len(eh)).astype(np.int64)
            low = np.where(learnt > 0, p[pick], 0.0) if n > 2 else None
            out = []
            for k, s in blocks(eb):
                first = np.flatnonzero(turn[s])
                runs = np.diff(np.append(first, s.stop - s.start)) * 2 + heavy[s][first]
                out.append((t.row["chunk"], k, pack(eh[s][first]), pack(runs), pack(ew[s]), pack(learnt[s]),
                            b"" if low is None else pack_floats(low[s])))
            return entries(out)
        c = np.zeros(len(eh), np.int64)
        new_ids, stats = c, np.zeros((int(turn.sum()), STATS))
        if len(eh):
            c = np.concatenate([unpack(a["counts"]) for a in by_order[n]])
            stats = np.concatenate([unpack_floats(a["stats"]).reshape(STATS, -1).T for a in by_order[n]])
            if n < model.order:
                new_ids = np.concatenate([unpack(a["ids"]) for a in by_order[n]])
        if model.hot[n]:
            hot = np.array(sorted(model.hot[n]))
            own = np.flatnonzero(heavy[turn])
            stats[own] = np.array([model.hot[n][h] for h in hot])[np.searchsorted(hot, eh[turn][own])]
        d = model.discounts[n]
        r = np.arange(1, K + 1)
        total, below = stats[:, K], stats[:, K + 1]
        kept = (stats[:, :K] * (d - 1) * r).sum(axis=1) + total
        some = (total > 0) & (1 - below >= 1e-12)
        alpha = np.ones(len(stats))
        alpha[some] = (1 - kept[some] / (total[some] + 0.5)) / (1 - below[some])
        place = np.cumsum(turn) - 1
        share = np.where(c <= K, d[np.clip(c, 1, K) - 1], 1.0) * c / (total[place] + 0.5)
        p[at] = np.where(c[entry] > 0, share[entry], alpha[place][entry] * p[at])
        gram, c_gram = np.zeros_like(word), np.zeros_like(word)
        if n < model.order:
            gram[at], c_gram[at] = new_ids[entry], c[entry]
    s, pieces = t.scored, len(t.row["rid"])

    def per(values):
        return np.bincount(t.piece[s], values[s], pieces)

    known = per(c_word > 0)
    return pa.table({
        "rid": pa.array(t.row["rid"], pa.int64()), "held_out": pa.array(t.row["held"], pa.bool_()),
        "n_tokens": per(np.ones(len(s))).astype(np.int64), "n_known": known.astype(np.int64),
        "base_score": per(np.log10((c_word + 0.1) / model.base_total)), "score": per(np.log10(p)),
        "id": pa.array(t.row["id"], id_type)})


# ------------------------------------------------------------------ buckets --

def merged_rows(rows: list[dict]) -> pa.Table:
    ints = pa.list_(pa.int64())
    return pa.Table.from_pylist(rows, schema=pa.schema(
        [("part", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()),
         ("counts", pa.binary()), ("stats", pa.binary()), ("ctx", ints), ("next", ints), ("n", ints),
         ("low", pa.list_(pa.float64()))]))


def table_rows(bucket: int, ctx, following, n, low=None) -> Iterator[dict]:
    for lo in range(0, len(following), TABLE_ROWS):
        s = slice(lo, lo + TABLE_ROWS)
        yield {"part": "grams", "chunk": -1, "bucket": bucket, "ctx": ctx[s], "next": following[s], "n": n[s],
               "low": None if low is None else low[s]}


def merge_words(group: pa.Table) -> pa.Table:
    """Training counts of a bucket's words, and each word's rank among those of its count;
    how many words have each count."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    bucket = rows[0]["bucket"]
    words = [np.cumsum(unpack(r["next"]).view(np.uint64), dtype=np.uint64) for r in rows]
    word, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack(r["n"]) for r in rows])).astype(np.int64)
    by = np.argsort(total, kind="stable")
    count, first, size = np.unique(total[by], return_index=True, return_counts=True)
    rank = np.empty(len(word), np.int64)
    rank[by] = np.arange(len(by)) - np.repeat(first, size)
    rank[total == 0] = 0
    out, lo = [], 0
    for r, own in zip(rows, words):
        at = place[lo:lo + len(own)]
        lo += len(own)
        if r["chunk"] >= 0:
            out.append({"part": "answers", "chunk": r["chunk"], "bucket": bucket, "ids": pack(rank[at]),
                        "counts": pack(total[at])})
    out.append({"part": "sums", "chunk": -1, "bucket": bucket, "ctx": count[count > 0], "n": size[count > 0]})
    known = total > 0
    return merged_rows(out + list(table_rows(bucket, rank[known], word[known].view(np.int64), total[known])))


def merge_grams(model: Model, order: int):
    """Training counts of a bucket's n-grams, and the sums of their histories."""
    buckets, want_ids = model.buckets, order < model.order

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        bucket = rows[0]["bucket"]
        heads, runs = [unpack(r["ctx"]) for r in rows], [unpack(r["runs"]) for r in rows]
        head, run_len = np.concatenate(heads), np.concatenate(runs)
        ctx = np.repeat(head, run_len >> 1)
        word = np.concatenate([unpack(r["next"]) for r in rows])
        n = np.concatenate([unpack(r["n"]) for r in rows])
        by = np.lexsort((word, ctx))
        cs, ws = ctx[by], word[by]
        new_ctx = np.ones(len(by), bool)
        new_ctx[1:] = cs[1:] != cs[:-1]
        new = new_ctx.copy()
        new[1:] |= ws[1:] != ws[:-1]
        first = np.flatnonzero(new)
        c = np.add.reduceat(n[by], first)
        if order == 2:
            share = model.shares(ws[first])
        else:
            share = np.maximum.reduceat(np.concatenate([unpack_floats(r["low"]) for r in rows])[by], first)
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        g_ctx, g_word = cs[first], ws[first]
        histories, history = np.unique(g_ctx, return_inverse=True)
        seen = c > 0

        def per(values):
            return np.bincount(history, np.where(seen, values, 0), len(histories))

        stats = np.stack([*[per(c == r) for r in range(1, K + 1)], per(c), per(share)], 1)
        ids = np.zeros(len(c), np.int64)
        ids[seen] = FIRST_ID + np.arange(int(seen.sum())) * buckets + bucket
        out, lo, lo_run = [], 0, 0
        for r, own, lens in zip(rows, heads, runs):
            size = int((lens >> 1).sum())
            at = entry[lo:lo + size]
            lo += size
            if r["chunk"] >= 0:
                out.append({"part": "answers", "chunk": r["chunk"], "bucket": bucket,
                            "ids": pack(ids[at]) if want_ids else None, "counts": pack(c[at]),
                            "stats": pack_floats(stats[np.searchsorted(histories, own)].T.reshape(-1))})
        hot = np.unique(head[run_len & 1 == 1])
        out.append({"part": "sums", "chunk": -1, "bucket": bucket, "ctx": hot,
                    "n": [int((c == r).sum()) for r in range(1, K + 2)],
                    "low": stats[np.searchsorted(histories, hot)].reshape(-1)})
        return merged_rows(out + list(table_rows(bucket, g_ctx[seen], g_word[seen], c[seen],
                                                 share[seen] if order > 2 else None)))

    return run


# -------------------------------------------------------------------- model --

def discounts(n: np.ndarray) -> np.ndarray:
    """d_1..d_K from the numbers of n-grams seen 1..K+1 times; where Good-Turing gives
    no value between 0 and 1, (r - 1/2) / r."""
    out = np.empty(K)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0
        out[r - 1] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def table(spark: SparkSession, path: str, order: int, part: str = "grams") -> DataFrame:
    """A part of the stored table of an order: ``grams`` has in lists the history's id,
    the word's id, the count and, from order 3, P by the order below; for words the rank
    among the bucket's words of its count, the hash and the count."""
    return spark.read.schema(MERGED).parquet(f"{path}/order={order}").where(F.col("part") == part)


def word_levels(words: DataFrame, buckets: int, docs: int) -> dict:
    """The counts that words have, the first id of each, and how many words there are."""
    found = (words.where("part = 'sums'").select(F.explode(F.arrays_zip("ctx", "n")).alias("c"))
             .groupBy("c.ctx").agg(F.max("c.n").alias("most"), F.sum("c.n").alias("words"))
             .orderBy(F.desc("ctx")).toArrow())
    most = found["most"].to_numpy().astype(np.int64)
    return {"levels": found["ctx"].to_numpy().astype(np.int64),
            "starts": FIRST_ID + np.cumsum(most * buckets) - most * buckets,
            "distinct": int(found["words"].to_numpy().sum()) + (docs > 0)}


def gram_sums(grams: DataFrame) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Discounts of an order, and the whole sums of histories dealt over buckets, no more
    than there are buckets."""
    sums = grams.where("part = 'sums'")
    by_count = sums.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(K + 1)]).first()
    one = (sums.select(F.posexplode("ctx").alias("i", "h"), "low")
           .select("h", *[F.col("low")[F.col("i") * STATS + k].alias(f"s{k}") for k in range(STATS)])
           .groupBy("h").agg(*[F.sum(f"s{k}") for k in range(STATS)]).collect())
    return discounts(np.array(by_count, float)), {r[0]: np.array(r[1:], float) for r in one}


def packed_table(order: int, heavy: set[int]):
    """Rows of a stored table as they are sent by a chunk; in no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ctx, word = np.array(r["ctx"], np.int64), np.array(r["next"], np.int64)
                hot = np.isin(ctx, np.fromiter(heavy, np.int64, len(heavy)))
                if order == 1:
                    word = np.diff(word.view(np.uint64), prepend=np.uint64(0))
                low = pack_floats(np.array(r["low"], float)) if order > 2 else b""
                yield entries([(-1, r["bucket"], pack(ctx), pack(2 + hot.astype(np.int64)), pack(word),
                                pack(np.array(r["n"], np.int64)), low)])

    return run


def _chunks(docs: DataFrame, train: Column, held_out: Column, id_col: str, text_col: str, order: int) -> tuple[DataFrame, int]:
    """The stored chunks, in buckets by chunk, and the number of these: only answers are
    shuffled to meet them."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    id_type = rows.schema["id"].dataType.simpleString()
    spark, name = docs.sparkSession, f"katz_chunks_{uuid.uuid4().hex}"
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(8, -(-size // TASK_BYTES))
    (rows.mapInArrow(chunked(order, CHUNK), chunk_schema(id_type)).write.bucketBy(tasks, "chunk")
     .option("path", scratch_path(spark, "katz-chunks")).saveAsTable(name))
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files stay in the scratch folder
    return chunks, tasks


def _answers(spark: SparkSession, path: str, orders: int) -> DataFrame:
    out = None
    for n in range(1, orders + 1):
        one = table(spark, path, n, "answers").select(F.lit(n).alias("order"), "chunk", "bucket", "ids", "counts",
                                                      "stats")
        out = one if out is None else out.unionByName(one)
    return out


def _walk(chunks: DataFrame, path: str, model: Model, order: int, tasks: int, schema: str) -> DataFrame:
    """``evaluate`` for every chunk with its answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.to_pylist(), []
        for row in left.to_pylist():
            got = evaluate(Tokens(row), answers, model, order, left.schema.field("id").type.value_type)
            out.append(pa.Table.from_batches([got]) if isinstance(got, pa.RecordBatch) else got)
        return pa.concat_tables(out)

    answers = _answers(chunks.sparkSession, path, order - 1)
    return (chunks.drop("words").groupBy("chunk")
            .cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
            .applyInArrow(run, schema))


def _run(chunks: DataFrame, tasks: int, order: int, path: str, base: Model | None = None) -> Model:
    """All orders: n-grams are sent, merged and stored under ``path``; with ``base`` the
    training counts are those of its tables."""
    spark = chunks.sparkSession
    tokens, learnt, docs = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in
                                        ("tokens", "train_tokens", "train_docs")]).first()
    model = base or Model(path, order, max(8, -(-tokens // BUCKET)), learnt, 0, docs)

    def merge(sent: DataFrame, n: int, how):
        if base:
            heavy = set(base.hot.get(n, {}))
            sent = sent.unionByName(table(spark, base.path, n).mapInArrow(packed_table(n, heavy), ENTRIES))
        out = sent.repartition(model.buckets, "bucket").groupBy("bucket").applyInArrow(how, MERGED)
        out.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/order={n}")
        return spark.read.schema(MERGED).parquet(f"{path}/order={n}")

    words = merge(chunks.mapInArrow(send_words(model.buckets), ENTRIES), 1, merge_words)
    if not base:
        model = model._replace(**word_levels(words, model.buckets, model.docs), discounts={}, hot={})
    for n in range(2, model.order + 1):
        grams = merge(_walk(chunks, path, model, n, tasks, ENTRIES), n, merge_grams(model, n))
        if not base:
            d, hot = gram_sums(grams)
            model = model._replace(discounts={**model.discounts, n: d}, hot={**model.hot, n: hot})
    return model


def _scores(chunks: DataFrame, tasks: int, path: str, model: Model, id_col: str) -> DataFrame:
    id_type = chunks.schema["id"].dataType.elementType.simpleString()
    done = _walk(chunks, path, model, model.order + 1, tasks, f"{SCORES}, id {id_type}")
    pieces = done.groupBy("rid").agg(
        F.first("id").alias(id_col), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return pieces.drop("rid")


def score(docs: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          order: int = 2) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row: the id, held_out,
    n_tokens, n_known, train_tokens, base_score, score (log10).  The n-gram tables are
    stored in the shared folder."""
    chunks, tasks = _chunks(docs, train, held_out, id_col, text_col, order)
    path = scratch_path(docs.sparkSession, "katz-tables")
    return _scores(chunks, tasks, path, _run(chunks, tasks, order, path), id_col)


def fit(docs: DataFrame, path: str, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from all rows; the n-gram tables are stored under ``path``."""
    return _run(*_chunks(docs, F.lit(True), F.lit(False), id_col, text_col, order), order, path)


def score_with(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score documents by a fitted model: their n-grams meet the stored tables' rows.
    The columns are those of ``score``; held_out is true."""
    chunks, tasks = _chunks(docs, F.lit(False), F.lit(True), id_col, text_col, model.order)
    path = scratch_path(docs.sparkSession, "katz-answers")
    _run(chunks, tasks, model.order, path, model)
    return _scores(chunks, tasks, path, model, id_col)
