"""Detection of periodic runs of words, and their collapse to one period.

A run is a stretch of words with smallest period q and at least ``min_words`` and
``repeats`` * q words that no neighbouring word extends.  They are found on a grammar:

1. Cut.  Of a run's words any few in a row (``window_size``) stand once more in the run,
   so stretches of windows that occur once in their document hold no run.
2. Re-Pair.  The word ids of all stretches of a batch are rewritten pair by pair: a round
   replaces the pairs that occur at least twice by new symbols, the more frequent ones
   first where occurrences overlap, until no pair occurs twice.  What is left of a stretch
   is paired up to one root.
3. Runs of a symbol.  A run lies in the smallest node that holds it and crosses there the
   border between the two children.  So the runs across its border are computed once for
   each symbol: at periods where a word next to the border recurs, the match is extended
   both ways (longest common extensions by prefix hashes and binary search, proven
   afterwards word by word).
4. Places.  Runs are translated to all places of their symbol in the derivations; those
   that a neighbouring word extends are part of a longer one found in a larger symbol and
   merge into it; of equal intervals the smallest period stays.

Documents are independent rows: nothing is shuffled.  Batches hold about 4 MB of text, one
document at least; work in numpy follows the words, not their square.

Cases: a null text is empty; documents without words have no runs and collapse to the
empty text; equal texts have equal runs; overlapping runs stay apart and a word leaves if
any of them drops it; empty tables give no rows; extra columns stay, but for those that
carry a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import slices

RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hash of integers (splitmix64 finaliser)."""
    z = x.astype(np.uint64) + _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def window_size(min_words: int, repeats: int) -> int:
    """Words in a row that occur again in any run that holds them: with a period q of at
    most length / repeats, a window of up to length - 2q + 1 words can move by q."""
    return min(n - 2 * (n // repeats) + 1 for n in range(min_words, min_words + repeats))


def stretches(codes: np.ndarray, doc: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int]]:
    """Half-open intervals outside of which there are no runs; none crosses documents."""
    k = window_size(min_words, repeats)
    if len(codes) < min_words:
        return []
    own, n = mixed(codes), len(codes) - k + 1
    h = mixed(doc[:n])
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + own[i:i + n]
    inside = doc[:n] == doc[k - 1:]
    s = np.sort(h[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    live = inside & (twice[at] == h)
    edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # live windows of neighbouring documents are apart: a window does not cross them
    keep = hi - lo + k - 1 >= min_words
    return list(zip(lo[keep].tolist(), (hi[keep] + k - 1).tolist()))


class Grammar:
    """Re-Pair grammar of the stretches of one batch; symbols under ``words`` are words,
    each other one has children, a length and a first place in the text."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray):
        self.words = int(text.max()) + 1
        self.left, self.right, self.length, self.first = [], [], [], []
        self.rounds: list[tuple[int, int]] = []  # symbols made by each round
        self.size = self.words
        seq, pos = text.astype(np.int64), np.arange(len(text))
        part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        while len(seq) > 1:  # the more frequent pair first
            key = np.where(part[1:] == part[:-1], seq[:-1] * self.size + seq[1:], -1)
            pairs, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            count[pairs < 0] = 0
            if count.max() < 2:
                break
            order = np.lexsort((mixed(pairs), count))
            place = np.empty(len(pairs), np.int64)
            place[order] = np.arange(1, len(pairs) + 1)
            place[count < 2] = 0
            p = np.concatenate([[0], place[inverse], [0]])
            hit = np.flatnonzero((p[1:-1] > 0) & (p[1:-1] >= p[:-2]) & (p[1:-1] >= p[2:]))
            first = np.concatenate([[True], np.diff(hit) != 1])  # a pair of one symbol overlaps itself
            at = hit[((hit - np.maximum.accumulate(np.where(first, hit, 0))) & 1) == 0]
            seq, pos, part = self._replace(seq, pos, part, at, key[at], bounds)
        while len(seq) > len(bounds) - 1:  # what is left, two by two
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            nth = np.arange(len(seq)) - np.repeat(start, np.diff(np.append(start, len(seq))))
            at = np.flatnonzero((nth[:-1] % 2 == 0) & (part[1:] == part[:-1]))
            seq, pos, part = self._replace(seq, pos, part, at, seq[at] * self.size + seq[at + 1], bounds)
        self.roots = seq
        cat = lambda x: np.concatenate(x) if x else np.array([], np.int64)
        self.left, self.right = cat(self.left), cat(self.right)
        self.length, self.first = cat(self.length), cat(self.first)

    def _replace(self, seq, pos, part, at, keys, bounds):
        made, first, which = np.unique(keys, return_index=True, return_inverse=True)
        ends = np.append(pos[1:], bounds[-1])  # symbols follow each other in the text
        place = at[first]
        self.left.append(seq[place])
        self.right.append(seq[place + 1])
        self.first.append(pos[place])
        self.length.append(ends[place + 1] - pos[place])
        self.rounds.append((self.size, self.size + len(made)))
        seq = seq.copy()
        seq[at] = self.size + which
        self.size += len(made)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        return seq[stay], pos[stay], part[stay]


def common_extension(prefix: np.ndarray, power: np.ndarray, x: np.ndarray, q: np.ndarray,
                     most: np.ndarray, back: bool) -> np.ndarray:
    """Length, at most ``most``, of the longest common part of the text from x and from
    x + q on (``back``: up to x and up to x + q), by prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        a, b = (x - mid, x) if back else (x, x + mid)
        same = (prefix[b] - prefix[a]) * power[q] == prefix[b + q] - prefix[a + q]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def border_runs(text: np.ndarray, grammar: Grammar, min_words: int, repeats: int):
    """(symbol, offset, length, period) of the runs across each symbol's border."""
    words = grammar.words
    wide = np.flatnonzero(grammar.length >= min_words)
    child = np.concatenate([np.ones(words, np.int64), grammar.length])
    # words around the border that a run matches one period on, at least
    near = min(max(-(-min_words // 2) - q, -(-repeats * q // 2) - q) for q in range(1, min_words + 1))
    near = max(near, 1)
    found = []
    for s in wide.tolist():
        f, n = int(grammar.first[s]), int(grammar.length[s])
        c, e, top = f + int(child[grammar.left[s]]), f + n, n // repeats
        q = np.flatnonzero(text[c + 1:min(c + top + 1, e - near + 1)] == text[c]) + 1
        for k in range(1, near if len(q) else 0):
            q = q[text[c + q + k] == text[c + k]]
        if len(q):
            found.append((np.full(len(q), s), np.full(len(q), c), q))
        lo = max(c - 1 - top, f + near - 1)
        q = np.flatnonzero(text[lo:c - 1][::-1] == text[c - 1]) + 1 if lo < c - 1 else q[:0]
        for k in range(1, near if len(q) else 0):
            q = q[text[c - 1 - q - k] == text[c - 1 - k]]
        if len(q):
            found.append((np.full(len(q), s), c - q, q))
    if not found:
        return tuple(np.array([], np.int64) for _ in range(4))
    s, x, q = (np.concatenate(v) for v in zip(*found))
    f, e = grammar.first[s], grammar.first[s] + grammar.length[s]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _BASE, np.uint64)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(mixed(text) * power[:-1])])
        back = common_extension(prefix, power, x, q, x - f, True)
        on = common_extension(prefix, power, x, q, e - x - q, False)
    size = back + q + on
    keep = (size >= min_words) & (size >= repeats * q)
    s, q, x, back, size = s[keep], q[keep], x[keep], back[keep], size[keep]
    at = x - back
    _, one = np.unique(np.stack([s, at, size, q], 1), axis=0, return_index=True)
    s, at, size, q, x = s[one], at[one], size[one], q[one], x[one]
    # of one interval the smallest period: rows are sorted by symbol, start, length, period
    lead = np.ones(len(s), bool)
    lead[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1]) | (size[1:] != size[:-1])
    s, at, size, q, x = s[lead], at[lead], size[lead], q[lead], x[lead]
    out = []
    for row in zip(s.tolist(), at.tolist(), size.tolist(), q.tolist(), x.tolist()):
        s_, a, n, p, mid = row
        if not np.array_equal(text[a:a + n - p], text[a + p:a + n]):  # equal hashes of unlike words
            lo, hi = int(grammar.first[s_]), int(grammar.first[s_] + grammar.length[s_])
            same = text[lo:hi - p] == text[lo + p:hi]
            stops = np.flatnonzero(~same) + lo
            a = int(max(stops[stops < mid], default=lo - 1)) + 1
            n = int(min(stops[stops >= mid], default=hi - p)) + p - a
            if n < min_words or n < repeats * p:
                continue
        out.append((s_, a - int(grammar.first[s_]), n, p))
    return tuple(np.array(v, np.int64) for v in (zip(*out) if out else ([], [], [], [])))


def grammar_runs(text: np.ndarray, bounds: np.ndarray, min_words: int, repeats: int):
    """(start, length, period) in ``text`` of the runs of its parts."""
    g = Grammar(text, bounds)
    none = tuple(np.array([], np.int64) for _ in range(3))
    s, offset, size, period = border_runs(text, g, min_words, repeats)
    if not len(s):
        return none
    begin = np.searchsorted(s, np.arange(len(g.left) + 1))  # runs of each symbol (sorted)
    has = np.concatenate([np.zeros(g.words, bool), begin[1:] > begin[:-1]])
    for lo, hi in g.rounds:  # symbols that lead to one with runs
        i = np.arange(lo, hi) - g.words
        has[lo:hi] |= has[g.left[i]] | has[g.right[i]]
    child = np.concatenate([np.ones(g.words, np.int64), g.length])
    starts, ends, out = bounds[:-1], bounds[1:], []
    node, at, part = g.roots[has[g.roots]], starts[has[g.roots]], np.flatnonzero(has[g.roots])
    while len(node):
        i = node - g.words
        n = begin[i + 1] - begin[i]
        if n.any():
            which = np.repeat(begin[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(at, n) + offset[which], size[which], period[which], np.repeat(part, n)))
        both = np.concatenate([g.left[i], g.right[i]])
        at = np.concatenate([at, at + child[g.left[i]]])
        part = np.concatenate([part, part])
        go = has[both]
        node, at, part = both[go], at[go], part[go]
    a, n, q, part = (np.concatenate(v) for v in zip(*out))
    lo, hi, e = starts[part], ends[part], a + n
    grows = (((a > lo) & (text[np.maximum(a - 1, 0)] == text[np.maximum(a - 1, 0) + q]))
             | ((e < hi) & (text[np.minimum(e, len(text) - 1)] == text[e - q])))
    rows = np.unique(np.stack([a, n, q], 1)[~grows], axis=0)
    lead = np.ones(len(rows), bool)
    lead[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return tuple(rows[lead].T)


def batch_runs(codes: np.ndarray, doc: np.ndarray, min_words: int, repeats: int):
    """(start, length, period) of all runs of a batch; ``codes`` are word ids, ``doc`` the
    document of each word, ascending.  Sorted by start, then period."""
    cuts = stretches(codes, doc, min_words, repeats)
    if not cuts:
        return tuple(np.array([], np.int64) for _ in range(3))
    used, text = np.unique(np.concatenate([codes[a:b] for a, b in cuts]), return_inverse=True)
    sizes = np.array([b - a for a, b in cuts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    a, n, q = grammar_runs(text, bounds, min_words, repeats)
    cut = np.searchsorted(bounds, a, "right") - 1
    a = a - bounds[cut] + np.array([x for x, _ in cuts])[cut]
    order = np.lexsort((q, a))
    return a[order], n[order], q[order]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = 24, repeats: int = 3) -> DataFrame:
    """Add ``n_words``, ``runs`` (by start, then period; start is a word number from 0)
    and ``collapsed``, the words that no run holds after its first period, joined by one
    space.  Words are runs of characters other than ASCII white space."""
    if repeats < 3 or min_words < repeats:
        raise ValueError("repeats must be at least 3, min_words at least repeats")
    results = ("n_words", "runs", "collapsed")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in results])
    names = kept.columns
    col = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, col):
                lists = pc.ascii_split_whitespace(pc.fill_null(part.column(col), ""))
                flat, doc = lists.flatten(), pc.list_parent_indices(lists)
                full = pc.greater(pc.binary_length(flat), 0)
                flat, doc = flat.filter(full), doc.filter(full).to_numpy().astype(np.int64)
                rows = part.num_rows
                n = np.bincount(doc, minlength=rows)
                opens = np.cumsum(n) - n
                codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                a, size, q = batch_runs(codes, doc, min_words, repeats)
                own = doc[a] if len(a) else a
                edge = np.zeros(len(flat) + 1, np.int64)
                np.add.at(edge, a + q, 1)
                np.add.at(edge, a + size, -1)
                stay = np.cumsum(edge)[:-1] == 0
                words = flat if stay.all() else flat.filter(pa.array(stay))
                left = np.bincount(doc[stay], minlength=rows)
                texts = pc.binary_join(pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), words), " ")
                spans = pa.StructArray.from_arrays([pa.array(a - opens[own]), pa.array(size), pa.array(q)],
                                                   ["start", "length", "period"])
                per = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(per), spans), texts], [*names, *results])

    schema = kept.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(RUN_TYPE),
                               "collapsed": F.lit("")}).schema
    return kept.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period (ties: least start, then period), null
    without one."""
    def compare(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1))
                .otherwise(0))

    return F.get(F.array_sort(runs, compare), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeat_tail(text: Column, key: Column) -> Column:
    """The text with an end that is made periodic where ``key`` (a long) is a multiple of
    ten, unchanged elsewhere: with n words and g = key div 10, those from a = g mod n on
    repeat the first 1 + (n - a) div (3 + g mod 8) of them."""
    own = words(text)
    n, g = F.size(own), F.floor(key / 10).cast("long")

    def put(n, a, p):
        tail = F.slice(own, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), F.slice(
            F.flatten(F.array_repeat(tail, times)), F.lit(1), (n - a).cast("int"))), " ")

    a = g % n
    return F.when((key % 10 == 0) & (n > 0), put(n, a, 1 + F.floor((n - a) / (3 + g % 8)))).otherwise(text)
