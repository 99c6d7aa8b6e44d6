"""Byte-level BPE encoding and decoding.

A text is cut into pieces (words) by the tokenizer's pattern.  ``encode_words``
encodes a column of distinct words with Spark's higher-order functions alone: a word's
bytes start as one part each, and a fold merges, step by step, the leftmost adjacent
pair whose joined bytes have the least rank, until no pair has one.  The rank map is a
literal: an array of small maps chosen by a hash of the bytes, so that a lookup does
not scan the vocabulary.  Bytes are written as ISO-8859-1 characters, since the
literal comes from JSON, whose map keys are strings.  ``decode_ids`` gets the tokens'
bytes from a literal array and concatenates them, also with higher-order functions.

``encode`` applies this to documents.  Words whose share of all pieces is over
1 / ``FREQUENT`` (fewer than ``FREQUENT`` whatever the corpus) are found by counts,
encoded once by the fold above and broadcast.  The other words are encoded where they
occur, once per task, by the same merges over arrays of many words at a time: the
higher-order fold takes about 50 microseconds a word there, more than the whole budget
(README, op4).  No text and no piece occurrence is shuffled, only counts of frequent words.

Cases: a null text is empty, an empty text has no tokens; equal texts have equal ids;
null ids and ids outside the vocabulary decode to nothing; empty tables give no rows;
very long words of a task are merged in n log n steps; extra columns stay, but for those that carry
a result's name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm import pieces
from encore.llm.common import checkpointed, slices

#: Words with a larger share of all pieces than 1 / FREQUENT are broadcast.
FREQUENT = 1 << 18
#: Words of more bytes are merged by a heap, with the same result.
LONG = 256
#: Small maps of the rank literal.
MAPS = 1 << 14
#: Words that a task remembers beside the frequent ones.
CACHE = 500_000
#: Bytes of texts whose pieces a task holds at once (a longer text is held alone).
PART = 1 << 20
#: Words that are merged at once.
BATCH = 1 << 14
NO_RANK = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal array of maps (folded to a constant by Spark)."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        maps[xxhash.xxh64_intdigest(text.encode(), 42) % MAPS][text] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of a non-empty word, by a fold of ranked merges."""
    table = rank_literal(ranks)

    def rank(x):  # xxhash64 has seed 42
        own = F.get(table, F.xxhash64(x).bitwiseAND(F.lit(MAPS - 1)).cast("int"))
        return F.coalesce(F.try_element_at(own, x), F.lit(NO_RANK))

    # parts p[0..n-1]; r[i] is the rank of p[i-1] joined with p[i], r[0] = r[n] = none
    def step(state, _):
        p, r = state["p"], state["r"]

        def merge(at):  # 1-based place of the least rank: parts at-2 and at-1 join
            a = at - 2
            joined = F.concat(F.get(p, a), F.get(p, a + 1))
            beside = F.array(F.concat(F.get(p, a - 1), joined), F.concat(joined, F.get(p, a + 2)))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), a), F.array(joined), F.slice(p, a + 3, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), a), F.transform(beside, rank),
                         F.slice(r, a + 4, F.size(r))).alias("r"))

        least = F.array_min(r)
        return F.when(least >= NO_RANK, state).otherwise(
            _let(F.array_position(r, least).cast("int"), merge))

    def fold(p):
        none, n = F.array(F.lit(NO_RANK)), F.size(p) - 1
        pairs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                          lambda i: rank(F.concat(F.get(p, i - 1), F.get(p, i))))
                       ).otherwise(F.array().cast("array<int>"))
        start = F.struct(p.alias("p"), F.concat(none, pairs, none).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)["p"]

    bytes_ = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(_let(bytes_, fold), rank)


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of a list of token ids."""
    vocabulary = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(vocabulary, separators=(",", ":"))), "array<string>")
    known = F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit("")))
    return F.encode(F.array_join(known, ""), "ISO-8859-1")


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word of a task."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    costs = [ranks.get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while costs and (least := min(costs)) < NO_RANK:
        i = costs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps: a heap of (rank, place) over linked parts, where
    an entry counts only while its two parts are still those it was made for."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def pair_model(ranks: dict[bytes, int]) -> pieces.Model | None:
    """The pairs of tokens that merge, for :func:`merge_batch`; None where a byte is no token."""
    if any(bytes([i]) not in ranks for i in range(256)):
        return None
    surfaces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        surfaces[rank] = token
    rows = [(ranks[t[:k]] * len(surfaces) + ranks[t[k:]], r) for t, r in ranks.items()
            for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    pairs, rank = np.array(sorted(rows), np.int64).reshape(-1, 2).T
    none = np.array([], np.int32)
    return pieces.Model(pairs.copy(), rank.astype(np.int32), rank.astype(np.int32), none, none,
                        np.array([ranks[bytes([i])] for i in range(256)], np.int32), surfaces,
                        np.zeros(len(surfaces), np.int8), "")


def merge_batch(words: list[bytes], ranks: dict[bytes, int], model: pieces.Model | None) -> list[bytes]:
    """The same merges for many words at once; ids as little-endian 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    at = []
    for i, w in enumerate(words):
        if model is None or len(w) > LONG or w in ranks:
            out[i] = np.array(merge_word(w, ranks), "<u4").tobytes()
        else:
            at.append(i)
    for k in range(0, len(at), BATCH):
        own = [words[i] for i in at[k:k + BATCH]]
        sym, n = pieces.merge_words(model, model.byte_ids[np.frombuffer(b"".join(own), np.uint8)],
                                    np.fromiter(map(len, own), np.int64, len(own)))
        raw, ends = sym.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        for i, lo, hi in zip(at[k:], [0, *ends[:-1]], ends):
            out[i] = raw[lo:hi]
    return out


def frequent_words(docs: DataFrame, pattern: str, text_col: str) -> DataFrame:
    """Words that hold over 1 / FREQUENT of all pieces.  A task reports the words that
    hold that share of its own pieces, so the counts are lower bounds, and a word
    that no task reports holds no such share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, n = regex.compile(pattern).findall, Counter(), 0

        def report():
            own = {w: c for w, c in seen.items() if c * FREQUENT > n}
            return pa.RecordBatch.from_arrays([pa.array([None, *own], pa.string()),
                                               pa.array([n, *own.values()], pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                pieces = find(text.as_py() or "")
                seen.update(pieces)
                n += len(pieces)
                if len(seen) > 2 * CACHE:
                    yield report()
                    seen, n = Counter(), 0
        yield report()

    found = (docs.select(text_col).mapInArrow(count, "word string, n long")
             .groupBy("word").agg(F.sum("n").alias("n")))
    found = checkpointed(found)
    total = (found.where("word IS NULL").first() or (None, 0))[1]
    return found.where(F.col("word").isNotNull() & (F.col("n") * FREQUENT > total)).select("word")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers)
    and ids to every row."""
    words = frequent_words(docs, pattern, text_col)
    known = {r["word"]: np.array(r["ids"], "<u4").tobytes()
             for r in words.select("word", encode_words(F.col("word"), ranks).alias("ids")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks, pair_model(ranks)))
    results = ("n_tokens", "ids_sha256", "ids")
    names = [c for c in docs.columns if c.lower() not in results]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        known, ranks, model = shared.value
        cache = dict(known)
        for b in batches:
            for part in slices(b, at, PART):
                if len(cache) > len(known) + CACHE:
                    cache = dict(known)
                found = [find(t.as_py() or "") for t in part.column(at)]
                new = list(set(chain.from_iterable(found)).difference(cache))
                cache.update(zip(new, merge_batch([w.encode() for w in new], ranks, model)))
                rows = [b"".join([cache[w] for w in own]) for own in found]
                sizes = [len(r) // 4 for r in rows]
                ids = pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32),
                                               pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(sizes, pa.int64()),
                     pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()), ids],
                    [*names, *results])

    kept = docs.select(*names)
    schema = kept.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""),
                               "ids": F.array(F.lit(0))}).schema
    return kept.mapInArrow(run, schema)
