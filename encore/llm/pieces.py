"""SentencePiece encoding and decoding of BPE models with byte fallback.

The pieces of the model become a sorted table of symbol pairs: the pair of pieces (a, b)
has an entry where a + b is a piece, with that piece's id and its rank (the place of its
score from the best).  A text is cut into words at borders that no piece crosses, and all
new words of a batch are merged together in vectorised rounds over one flat array of
symbols: the least pair rank of every word (a segmented minimum), all its occurrences
merged at once from the left, finished words taken out and the array compacted, until no
pair remains.  One merge after another is the rule to match, so a word stops its round
after an occurrence whose new pair ranks better than the round's.  Characters without a
piece become the pieces of their bytes.

Every task merges a word once and remembers it (a bounded store); texts are not shuffled,
and only the model's tables are broadcast.

Cases: a null text is empty and has no ids; equal texts have equal ids; texts and words of
any length are taken whole; null ids decode to the empty text, ids outside the vocabulary
raise; empty tables give no rows; extra columns stay, but for those that carry a result's
name.  Models with pieces defined by users, or with a normaliser other than ``identity``
that keeps white space and puts one space before the text, are not supported.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import slices

#: The character that stands for a space in pieces, and the text of the unknown piece.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Words and characters of words that a task remembers.
CACHE_WORDS, CACHE_CHARS = 400_000, 16_000_000
NO_RANK = np.int32((1 << 31) - 1)


@dataclass
class Model:
    """Tables of a model; ``pairs`` is sorted, ``merged`` and ``ranks`` go with it."""
    pairs: np.ndarray
    merged: np.ndarray
    ranks: np.ndarray
    chars: np.ndarray      # code points that are pieces
    char_ids: np.ndarray
    byte_ids: np.ndarray   # piece of each byte
    surfaces: list[bytes]  # what a piece decodes to, a leading SPACE kept
    kinds: np.ndarray      # 0 text, 1 byte, 2 nothing, 3 unknown
    pattern: str           # words


def char_class(chars: set[str]) -> str:
    """The characters as a class of a regular expression, in ranges."""
    out, points = [], sorted(map(ord, chars))
    for i, c in enumerate(points):
        if i and points[i - 1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def read_model(path: str) -> Model:
    """Read a model file (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0
                      for i in range(size)], np.int8)
    pieces = [sp.id_to_piece(i) for i in range(size)]
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == 0}
    scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
    place = {s: r for r, s in enumerate(scores)}  # equal scores rank alike: the leftmost pair goes first
    rows = [(ids[p[:k]] * size + ids[p[k:]], i, place[sp.get_score(i)])
            for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    singles = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    # a character of no longer piece is a word alone; a word also ends before SPACE
    # unless some piece goes on there
    joining = {c for p in ids if len(p) > 1 for c in p}
    crosses = any(b == SPACE != a for p in ids for a, b in zip(p, p[1:]))
    join = char_class(joining - {SPACE}) or r"^\s\S"
    pattern = (f"[{join}{SPACE}]+|[^{join}{SPACE}]" if crosses else
               f"{SPACE}*[{join}]+|{SPACE}+|[^{join}{SPACE}]")
    surface = [bytes([int(p[1:-1], 16)]) if k == 1 else b"" if k == 2 else
               UNKNOWN.encode() if k == 3 else p.encode() for p, k in zip(pieces, kinds)]
    byte_ids = np.full(256, sp.unk_id(), np.int32)
    for i in np.flatnonzero(kinds == 1):
        byte_ids[surface[i][0]] = i
    return Model(table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32),
                 np.array([c for c, _ in singles], np.int64), np.array([i for _, i in singles], np.int32),
                 byte_ids, surface, kinds, pattern)


def pair_ranks(model: Model, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged id) of symbol pairs; NO_RANK where they do not merge."""
    key = a.astype(np.int64) * len(model.surfaces) + b
    at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
    known = (model.pairs[at] == key) & (a >= 0) & (b >= 0)
    return np.where(known, model.ranks[at], NO_RANK), model.merged[at]


def merge_words(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge ``symbols``, the characters of all words one after another with ``sizes``
    of them in each; returns the merged symbols and their number in each word.  Negative
    symbols merge with nothing."""
    sym, word = symbols.copy(), np.repeat(np.arange(len(sizes)), sizes)
    if not len(sym) or not len(model.pairs):
        return sym, sizes

    def ranks_at(i):
        inside = i + 1 < len(sym)
        j = np.where(inside, i + 1, i)
        r, m = pair_ranks(model, sym[i], sym[j])
        return np.where(inside & (word[i] == word[j]), r, NO_RANK), m

    rank, merged = ranks_at(np.arange(len(sym)))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        open_ = least < NO_RANK
        if not open_.all():
            keep = np.repeat(open_, n)
            done.append((word[~keep], sym[~keep]))
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            if not len(sym):
                break
            least, n = least[open_], n[open_]
        hit = np.flatnonzero(rank == np.repeat(least, n))
        # of overlapping occurrences every other one, from the left
        first = np.concatenate([[True], np.diff(hit) != 1])
        at = hit[((hit - np.maximum.accumulate(np.where(first, hit, 0))) & 1) == 0]
        new, own, w = merged[at], rank[at], word[at]
        # a word goes on after an occurrence only if its new pairs rank no better
        after, before = np.minimum(at + 2, len(sym) - 1), np.maximum(at - 1, 0)
        follows = np.concatenate([[False], at[1:] == at[:-1] + 2])
        left = np.where(follows, np.concatenate([[0], new[:-1]]), sym[before])
        better = (((at + 2 < len(sym)) & (word[after] == w) & (pair_ranks(model, new, sym[after])[0] < own))
                  | ((at > 0) & (word[before] == w) & (pair_ranks(model, left, new)[0] < own)))
        if better.any():
            seen = np.cumsum(better) - better
            opens = np.concatenate([[True], w[1:] != w[:-1]])
            keep = seen == np.maximum.accumulate(np.where(opens, seen, 0))
            at, new = at[keep], new[keep]
        sym[at] = new
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
        at = at - np.arange(len(at))
        changed = np.concatenate([at, at[at > 0] - 1])
        rank[changed], merged[changed] = ranks_at(changed)
    word = np.concatenate([w for w, _ in done])
    order = np.argsort(word, kind="stable")
    return np.concatenate([s for _, s in done])[order], np.bincount(word, minlength=len(sizes))


def encode_words(model: Model, lookup: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of every word, as little-endian 32-bit integers; ``lookup`` is
    :func:`char_lookup`'s table."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = lookup[points]
    sym, n = merge_words(model, np.where(ids >= 0, ids, -2 - points.astype(np.int32)), sizes)
    odd = np.flatnonzero(sym < 0)
    if len(odd):  # characters without a piece: their bytes
        own = [model.byte_ids[np.frombuffer(chr(-2 - s).encode("utf-8", "surrogatepass"), np.uint8)]
               for s in sym[odd]]
        wide = np.ones(len(sym), np.int64)
        wide[odd] = [len(b) for b in own]
        word = np.repeat(np.repeat(np.arange(len(n)), n), wide)
        at = np.cumsum(wide) - wide
        out = np.repeat(sym, wide)
        fill = np.repeat(at[odd], wide[odd]) + np.concatenate([np.arange(len(b)) for b in own])
        out[fill] = np.concatenate(own)
        sym, n = out, np.bincount(word, minlength=len(n))
    raw, ends = sym.astype("<i4").tobytes(), np.cumsum(n) * 4
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def char_lookup(model: Model) -> np.ndarray:
    """Piece of every code point, -1 without one."""
    table = np.full(0x110000, -1, np.int32)
    table[model.chars] = model.char_ids
    return table


def encode(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``ids`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = ("n_tokens", "ids")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in results])
    names = kept.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find, lookup = re.compile(model.pattern).findall, char_lookup(model)
        known: dict[str, bytes] = {}
        chars = 0
        for b in batches:
            for part in slices(b, at, 1 << 20):
                texts = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in part.column(at).to_pylist()]
                new = list({w for words in texts for w in words if w not in known})
                if new:
                    size = sum(map(len, new))
                    if len(known) + len(new) > CACHE_WORDS or chars + size > CACHE_CHARS:
                        known, chars = {}, 0
                        new = list({w for words in texts for w in words})
                        size = sum(map(len, new))
                    known.update(zip(new, encode_words(model, lookup, new)))
                    chars += size
                rows = [b"".join([known[w] for w in words]) for words in texts]
                n = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                               pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), ids], [*names, *results])

    schema = kept.withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.array(F.lit(0))}).schema
    return kept.mapInArrow(run, schema)


def text_of(raw: bytes) -> str:
    """UTF-8 text; every byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        codecs.register_error("each_byte", lambda e: ("�", e.start + 1))
        return raw.decode("utf-8", "each_byte")


def decode(rows: DataFrame, model: Model, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of a list of ids."""
    shared = rows.sparkSession.sparkContext.broadcast((model.surfaces, model.kinds))
    kept = rows.select(*[c for c in rows.columns if c.lower() != "decoded"])
    names = kept.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces, kinds = shared.value
        space = SPACE.encode()
        table = pa.array([s.replace(space, b" ") if k == 0 else s for s, k in zip(surfaces, kinds)], pa.binary())
        opens = np.array([s.startswith(space) and k == 0 for s, k in zip(surfaces, kinds)])
        for b in batches:
            for part in slices(b, at, 1 << 19):
                lists = pc.fill_null(part.column(at), pa.scalar([], part.column(at).type))
                ids = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(kinds):
                    raise ValueError("id outside the vocabulary")
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                taken = table.take(pa.array(ids))
                place = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy())])
                raw = taken.buffers()[2].to_pybytes() if len(ids) else b""
                out = []
                for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    first = lo
                    while first < hi and kinds[ids[first]] == 2:
                        first += 1
                    skip = int(first < hi and opens[ids[first]])  # the space put before the text
                    if (kinds[ids[lo:hi]] == 2).any():  # bytes on both sides of it are apart
                        cuts = [lo, *(np.flatnonzero(kinds[ids[lo:hi]] == 2) + lo).tolist(), hi]
                        text = "".join(text_of(raw[place[a]:place[z]]) for a, z in zip(cuts, cuts[1:]))
                        out.append(text[skip:])
                    else:
                        out.append(text_of(raw[place[lo] + skip:place[hi]]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit("")).schema)
