"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text (32-byte window, computed for all
positions at once by doubling).  A chunk ends where the hash's top bits are zero:
more bits are asked before the normal size and fewer after it (normalised chunking),
between a least and a greatest size.  Boundaries depend on nearby bytes alone, so an
edit changes the chunks around it and the others stay.  A fingerprint is the set of
chunk digests with their lengths; likeness is the shared length over the smaller
set's length (containment).

``edited_pairs`` needs each document's successor in id order.  Documents are dealt
into id ranges at ids taken from a quantile sketch; a row whose id starts a range is
also sent to the range before it, and the smallest id to the last one.  So one
shuffle brings every document together with its successor, and each range is read
in one sorted pass that holds two documents.

Cases: null texts are empty; an empty text has no chunk, two empty sets have
likeness 1, an empty and another 0; a null doc_id sorts after all others; rows that
repeat a doc_id follow each other in order of their text; a single document is its
own successor; empty tables give no rows; very long texts are hashed in pieces;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, NORMAL, MOST = 16, 64, 256
WINDOW, PIECE = 32, 1 << 20
#: Text bytes that one range should hold.
RANGE_BYTES = 64 << 20
#: Most ranges, which bounds the quantile sketch; beyond, ranges grow (they are streamed).
MOST_RANGES = 20_000


def gear_table() -> np.ndarray:
    """256 random 32-bit values from the splitmix64 sequence."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at every position."""
    h, s = gear[data], 1
    while s < WINDOW:
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h, s = wider, s * 2
    return h


def boundaries(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of all chunks of ``data``."""
    bits = NORMAL.bit_length() - 1
    easy, hard = np.uint32(1 << (33 - bits)), np.uint32(1 << (31 - bits))
    raw, ends, strict = np.frombuffer(data, np.uint8), [], []
    for at in range(0, len(raw), PIECE):
        lead = min(at, WINDOW - 1)
        h = gear_hashes(raw[at - lead:at + PIECE], gear)[lead:]
        hit = np.flatnonzero(h < easy)
        ends += (hit + (at + 1)).tolist()
        strict += (h[hit] < hard).tolist()
    cuts, start, n = [], 0, len(data)
    for end, firm in zip(ends, strict):
        while end - start > MOST:
            start += MOST
            cuts.append(start)
        if end - start >= NORMAL or firm and end - start >= LEAST:
            start = end
            cuts.append(end)
    while n - start > MOST:
        start += MOST
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def chunk_set(data: bytes, gear: np.ndarray) -> dict[str, int]:
    """Digest -> length of the distinct chunks, in order of first appearance."""
    out, start, digest = {}, 0, xxhash.xxh3_64_hexdigest
    for end in boundaries(data, gear):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Shared chunk length over the smaller set's length."""
    if not a or not b:
        return float(not a and not b)
    shared = sum([n for d, n in a.items() if d in b])
    return shared / min(sum(a.values()), sum(b.values()))


def as_text(chunks: dict[str, int]) -> str:
    return " ".join([f"{d}-{n}" for d, n in chunks.items()])


def with_successors(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(id, text, slot) in ranges of ids, sorted: slot 0 rows in order, then the
    first row of what follows (slot 1: the next range, 2: the smallest id)."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit((1 << 63) - 1).cast("long"))
    share = [i / parts for i in range(1, parts)]
    found = rows.agg(F.min(key).alias("least"), *(
        [F.percentile_approx(key, share, 100 * parts).alias("at")] if share else [])).first()
    least, bounds = found[0], np.unique(np.array((found[1] if share else None) or [], np.int64))
    last = len(bounds)

    def target(ids: pd.Series) -> pd.Series:
        k = ids.to_numpy(np.int64)
        own = np.searchsorted(bounds, k, "right")
        first = (own > 0) & (bounds[own - 1] == k) if last else np.zeros(len(k), bool)
        return pd.Series([[(p, 0)] + [(p - 1, 1)] * f + [(last, 2)] * (i == least)
                          for p, f, i in zip(own.tolist(), first.tolist(), k.tolist())])

    to = F.pandas_udf(target, "array<struct<pid:int,slot:int>>")
    return (rows.withColumn("k", key).withColumn("to", F.explode(to("k")))
            .select("id", "text", "k", "to.pid", "to.slot")
            .repartitionById(last + 1, F.col("pid"))
            .sortWithinPartitions("pid", "slot", "k", "text")
            .select("id", "text", "slot"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text (the last quarter of the
    code points replaced by the successor's first as many), with the likeness of
    the fingerprint to the edited text's and to the successor's."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    parts = min(parts, MOST_RANGES)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, before, out, held = gear_table(), None, [], 0
        for b in batches:
            for doc_id, value, slot in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if slot and before is None:
                    continue
                text = value.as_py()
                chunks = chunk_set(text.encode(), gear)
                if before is not None:
                    own_id, own, own_chunks = before
                    n = len(own)
                    edited = (own[:n - n // 4] + text[:n // 4]).encode()
                    new = chunk_set(edited, gear)
                    out.append((own_id, n, hashlib.sha256(edited).hexdigest(), as_text(own_chunks),
                                as_text(new), likeness(own_chunks, new), likeness(own_chunks, chunks)))
                    held += n
                    if held > PIECE:
                        yield batch(out, b.schema.field(0).type)
                        out, held = [], 0
                before = None if slot else (doc_id, text, chunks)
            if out:
                yield batch(out, b.schema.field(0).type)
                out, held = [], 0

    def batch(rows, id_type):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *types])],
                                          [id_col, *fields])

    schema = (f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return with_successors(docs, id_col, text_col, parts).mapInArrow(run, schema)
