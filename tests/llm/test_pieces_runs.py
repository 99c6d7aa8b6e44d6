"""SentencePiece coding, periodic runs and source divergence against the library,
brute force and a dictionary model."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from encore.llm import catalog, divergence, pieces, runs
from encore.sources.tables import read_table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ------------------------------------------------------------ SentencePiece --

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


def texts():
    rnd = random.Random(5)
    marks = "ab▁ \n\tanine日本é😀\x00.,<0x>THEthe"
    out = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    out += ["".join(rnd.choice("an") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    out += ["a" * n for n in range(60)] + ["na" * n for n in range(40)] + ["    " * n for n in range(20)]
    return out + ["", " ", "<s> </s><unk><0x0A>", "a \x85 b", "\U0010ffff"]


def test_pieces_equal_the_library(spark, library, model):
    rows = spark.createDataFrame(list(enumerate(texts())), "i long, text string").repartition(3)
    got = {r.i: r for r in pieces.decode(pieces.encode(rows, model), model).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == library.decode(ids), t


def test_pieces_query(spark, library):
    got = {r.doc_id: r for r in catalog.QUERIES["op12_sentencepiece"](spark, SF).collect()}
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(library.decode(ids).encode())


def test_pieces_edges(spark, library, model):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    rows = spark.createDataFrame([("a", None, 1, 2), ("a", "", 1, 2), (None, "x y", 1, 2), ("b", "x y", 1, 2),
                                  ("c", long + " end " + "z" * 1_000_000, 1, 2)],
                                 "doc_id string, text string, ids int, Decoded int")
    out = pieces.encode(rows, model)
    assert out.columns == ["doc_id", "text", "Decoded", "n_tokens", "ids"]
    got = pieces.decode(out, model).select("doc_id", "text", "n_tokens", "ids", "decoded").collect()
    assert [(r.n_tokens, r.decoded) for r in got[:2]] == [(0, ""), (0, "")]
    assert got[2].ids == got[3].ids == library.encode("x y")
    assert got[4].ids == library.encode(got[4].text) and got[4].decoded == got[4].text
    assert pieces.encode(rows.limit(0), model).count() == 0


def test_pieces_decode_any_ids(spark, library, model):
    rnd = random.Random(2)
    lists = [[rnd.choice([0, 1, 2, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 28705, 259, rnd.randrange(32000)])
              for _ in range(rnd.randint(0, 8))] for _ in range(500)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "i long, ids array<int>")
    got = {r.i: r.decoded for r in pieces.decode(rows, model).collect()}
    assert got[-1] == ""
    for i, x in enumerate(lists):
        assert got[i] == library.decode(x), x


def test_pieces_word_stops_for_a_better_pair():
    # "ab" ranks worse than "aba", which one merge of "ab" makes possible
    names = ["a", "b", "ab", "aba"]
    at = {p: i for i, p in enumerate(names)}
    score = {"aba": 0, "ab": 1}
    rows = sorted((at[p[:k]] * 4 + at[p[k:]], at[p], score[p]) for p in score for k in range(1, len(p))
                  if p[:k] in at and p[k:] in at)
    table = np.array(rows)
    m = pieces.Model(table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), None, None, None,
                     [b""] * 4, None, "")
    text = [at[c] for c in "ababab"]
    sym, n = pieces.merge_words(m, np.array(text * 2, np.int32), np.array([6, 6]))
    one = list("ababab")
    while True:
        pairs = [(score.get(x + y, 9), i) for i, (x, y) in enumerate(zip(one, one[1:]))]
        if not pairs or min(pairs)[0] == 9:
            break
        i = min(pairs)[1]
        one[i:i + 2] = [one[i] + one[i + 1]]
    assert [names[s] for s in sym] == one * 2 and n.tolist() == [len(one)] * 2


# ------------------------------------------------------------- periodic runs --

def brute_runs(words, m=24, r=3):
    codes = np.unique(np.array(words), return_inverse=True)[1] if words else np.array([], int)
    out = {}
    for q in range(1, len(words) // r + 1):
        edge = np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(m, r * q):
                out.setdefault((int(a), int(b - a) + q), q)
    return sorted((a, q, n) for (a, n), q in out.items())


def collapse(words, found):
    gone = {i for a, q, n in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rnd):
    k, out = rnd.choice([1, 2, 3, 5, 50]), []
    for _ in range(rnd.randint(0, 6)):
        if rnd.random() < .6:
            unit = [rnd.randrange(k) for _ in range(rnd.randint(1, 40))]
            part = unit * rnd.randint(1, 9)
            out += part[:len(part) - rnd.randint(0, len(unit) - 1)]
        else:
            out += [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
    return out


@pytest.mark.parametrize("m,r", [(24, 3), (6, 3), (12, 4), (3, 3)])
def test_runs_equal_brute_force(m, r):
    rnd = random.Random(m)
    for _ in range(60):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 6))]
        sizes = [len(d) for d in docs]
        doc = np.repeat(np.arange(len(docs)), sizes)
        start = np.cumsum([0, *sizes])
        got = [[] for _ in docs]
        for a, n, q in zip(*runs.batch_runs(np.array(sum(docs, []), np.int64), doc, m, r)):
            got[doc[a]].append((int(a - start[doc[a]]), int(q), int(n)))
        assert got == [brute_runs(d, m, r) for d in docs]


def test_runs_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(runs, "mixed", lambda x: np.asarray(x).astype(np.uint64) & np.uint64(1))
    rnd = random.Random(9)
    for _ in range(40):
        words = random_words(rnd)
        got = runs.batch_runs(np.array(words, np.int64), np.zeros(len(words), np.int64), 24, 3)
        assert [(int(a), int(q), int(n)) for a, n, q in zip(*got)] == brute_runs(words)


def edited(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_runs_query(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = edited(d.doc_id, d.text)
        found = brute_runs(words)
        r = got[d.doc_id]
        assert r.n_runs == len(found)
        if found:
            best = max(found, key=lambda x: (x[2] * 10**9 // x[1], -x[0], -x[1]))
            assert (r.start, r.period, r.length, r.exponent_milli) == (*best, 1000 * best[2] // best[1])
        else:
            assert (r.start, r.period, r.length, r.exponent_milli) == (None,) * 4
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, q, n in found).encode())
        assert r.collapsed_sha256 == sha(collapse(words, found).encode())
    assert sum(r.n_runs > 0 for r in got.values()) >= 10


def test_runs_edges(spark):
    cases = [None, "", " \n\t ", "a " * 23, "a " * 24, "a\x0bb " * 30, "a b " * 12, "x " + "a b " * 30,
             "ab " * 200_000, "one two three " * 3]
    rows = spark.createDataFrame([(str(i), t, 7, "k") for i, t in enumerate(cases * 2)],
                                 "doc_id string, text string, Runs int, extra string").repartition(3)
    out = runs.periodic_runs(rows)
    assert out.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"]
    got = {int(r.doc_id): r for r in out.collect()}
    for i, t in enumerate(cases * 2):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        want = [(0, 1, len(words))] if t and len(t) > 10**5 else brute_runs(words)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == want and got[i].n_words == len(words)
        assert got[i].collapsed == collapse(words, want)
    assert runs.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(rows, repeats=2)


def test_strongest_run_breaks_ties(spark):
    lists = [[(9, 30, 10), (0, 24, 8), (40, 24, 8)], [(0, 25, 8), (30, 100, 32)], []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, runs {runs.RUN_TYPE}")
    got = [r.b and tuple(r.b) for r in rows.select(runs.strongest(F.col("runs")).alias("b")).collect()]
    assert got == [(0, 24, 8), (0, 25, 8), None]


# ---------------------------------------------------------- source divergence --

def brute_audit(rows, min_docs, top):
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    seen, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            seen[lang, w].add(i)
            count[lang, source][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (l, w), d in seen.items() if l == lang and len(d) >= min_docs]
        total = Counter({w: sum(count[lang, s][w] for s in sources) for w in kept})
        n = {s: sum(count[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: share(count[lang, s][w], n[s], len(kept)) for w in kept} for s in sources}
        q = {w: share(total[w], sum(n.values()), len(kept)) for w in kept}
        for s in sources:
            pair = sorted((-sum((p[s][w] - p[t][w])**2 // p[t][w] for w in kept), t.encode(), t)
                          for t in sources if t != s)
            term = sorted((-((p[s][w] - q[w])**2 // q[w]), w.encode(), w) for w in kept
                          if count[lang, s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, x, -v, r) for part, rank in (("pair", pair), ("term", term))
                    for r, (v, _, x) in enumerate(rank, 1)]
    return sorted(out)


def audit_rows():
    rnd = random.Random(3)
    vocabulary = ["the", "The", "de", "Été", "été", "x1y", "naïve", "zz", "q", "中文", "it's"]
    out = [(" ".join(rnd.choices(vocabulary, range(1, 12), k=rnd.randint(0, 30))), rnd.choice(["en", "fr", "", None]),
            rnd.choice(["s1", "s2", "Sé", "", None])) for _ in range(300)]
    return out + [(None, "en", "only-null"), ("", "xx", "a"), ("lone", "xx", "b"), ("the the", "yy", "one")] + out[:5]


@pytest.mark.parametrize("held,block,shard", [(400_000, 64, 200_000), (3, 2, 4)])
def test_audit_equals_dictionary_model(spark, monkeypatch, held, block, shard):
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard)
    df = spark.createDataFrame([(*r, "k", 1) for r in audit_rows()],
                               "text string, lang string, source string, term string, n int").repartition(5)
    for min_docs, top in ((3, 200), (1, 3)):
        got = sorted(tuple(r) for r in divergence.audit(df, min_docs, top).collect())
        assert got == brute_audit(audit_rows(), min_docs, top)


def test_audit_without_rows_or_groups(spark):
    df = spark.createDataFrame([(None, None, None), ("a long " * 300_000, "en", "s")], "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).count() == 0
    assert divergence.audit(df).count() == 0  # one source in each language, nothing above its language
    both = df.withColumn("source", F.lit("t")).unionByName(df)
    got = sorted(tuple(r) for r in divergence.audit(both).where("part = 'pair'").collect())
    assert [r[:4] for r in got] == [("", "", "pair", "t"), ("", "t", "pair", ""), ("en", "s", "pair", "t"),
                                    ("en", "t", "pair", "s")]
    assert all(r[4] == 0 for r in got)


def test_share_is_exact(spark):
    rows = [(c, s) for c in (0, 1, 7, 10**6, 10**13 + 7, 2 * 10**14) for s in (1, 3, 10**6 + 3, 2 * 10**14) if c < s]
    got = spark.createDataFrame(rows, "c long, s long").select(
        divergence.share(F.col("c"), F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // s for c, s in rows]
    assert divergence.share_of(*np.array(rows).T).tolist() == [r.p for r in got]
