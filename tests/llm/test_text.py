"""Language ID, chunk fingerprints, BPE and the language model against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from encore.llm import bpe, cdc, katz, lang_id
from encore.sources.tables import read_table

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- language ID --

def test_language_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents").withColumn("score", F.lit(1))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = lang_id.predict(docs, lang_id.train(docs, ~held)).where(held & F.col("lang").isNotNull()).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    train = spark.createDataFrame([("hello there world", "en"), ("bonjour le monde", "fr"), (None, "en"),
                                   ("x", None)], "text string, lang string")
    model = lang_id.train(train, F.lit(True))
    assert model[0] == ["en", "fr"]
    texts = [None, "", "123 !?", "le monde", "LE MONDE", "hello " * 200_000, "\U0001F600", "\u4e2d\u6587"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(rows, model).collect()}
    assert [got[i][0] for i in (0, 1, 2, 6)] == ["und"] * 4 and got[0][1] == 0
    assert got[3] == got[4] and got[3][0] == "fr" and got[5][0] == "en"
    assert got[7][0] in ("en", "fr")
    assert lang_id.predict(rows.limit(0), model).count() == 0
    none = lang_id.train(train.limit(0), F.lit(True))
    assert {r.lang_pred for r in lang_id.predict(rows, none).collect()} == {"und"}


def test_language_sample_covers_labels_and_is_bounded(spark):
    rows = [(i, f"hello there number {'abc'[i % 3] * (i % 40)}", "en") for i in range(3000)]
    rows += [(None, "same text again", "de")] * 1000 + [(i, "bonjour le monde", "fr") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    h = F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 1).alias("h")
    got = lang_id.least_rows(df.select("text", "lang", h), 40).collect()
    per = Counter()
    for r in got:
        per[r.lang] += r.n
    assert per == {"en": 40, "de": 40, "fr": 3}
    en = sorted((r.h, r.text) for r in df.where("lang = 'en'").select("text", h).collect())[:40]
    assert Counter(t for _, t in en) == Counter(r.text for r in got if r.lang == "en" for _ in range(r.n))
    assert lang_id.quota([3000, 1000, 3], 83) == 40 and lang_id.quota([5, 6], 1) == 1
    model = lang_id.train(df, F.lit(True), sample_docs=60)
    assert len({tuple(model[1][:, k]) for k in range(3)}) == 3 and np.ptp(model[1][:, 2]) > 0
    out = lang_id.predict(spark.createDataFrame([(1, "bonjour le monde")], "doc_id long, text string"), model)
    assert out.first().lang_pred == "fr"


def test_language_pieces_equal_whole(monkeypatch):
    chars = lang_id.clean("abc def " * 50)
    whole = np.sort(np.concatenate(list(lang_id.buckets(chars))))
    monkeypatch.setattr(lang_id, "PIECE", 7)
    assert (np.sort(np.concatenate(list(lang_id.buckets(chars)))) == whole).all()


# ------------------------------------------------------------ fingerprints --

def slow_cuts(data, gear):
    bits = cdc.NORMAL.bit_length() - 1
    h, start, cuts = 0, 0, []
    for i, x in enumerate(data):
        h = ((h << 1) + int(gear[x])) & 0xFFFFFFFF
        n = i + 1 - start
        if (n >= cdc.LEAST and h < 1 << (31 - bits)) or (n >= cdc.NORMAL and h < 1 << (33 - bits)) or n == cdc.MOST:
            cuts.append(i + 1)
            start = i + 1
    return cuts + ([len(data)] if start < len(data) else [])


def test_boundaries_match_rolling_hash(monkeypatch):
    gear, rnd = cdc.gear_table(), random.Random(3)
    texts = [bytes(rnd.choices(b"abcde \n\xc3", k=n)) for n in (0, 1, 15, 16, 31, 32, 33, 64, 300, 5000)] + [b"a" * 2000]
    for piece in (cdc.PIECE, 40):
        monkeypatch.setattr(cdc, "PIECE", piece)
        for t in texts:
            assert cdc.boundaries(t, gear) == slow_cuts(t, gear)


def test_insertion_leaves_other_chunks():
    gear, rnd = cdc.gear_table(), random.Random(4)
    text = bytes(rnd.choices(range(97, 123), k=20_000))
    a, b = cdc.chunk_set(text, gear), cdc.chunk_set(text[:7000] + b"inserted" + text[7000:], gear)
    assert cdc.likeness(a, b) > 0.95 and cdc.likeness(a, {}) == 0 and cdc.likeness({}, {}) == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_pairs_match_brute_force(spark, parts):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcd \u00e9\u4e2d", k=rnd.choice([0, 1, 3, 4, 50, 700]))) for _ in range(60)]
    rows = [(3 * i, t, 0) for i, t in enumerate(texts)] + [(6, "again", 0), (7, None, 0), (None, "last", 0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, pid int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = cdc.edited_pairs(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    gear = cdc.gear_table()
    order = sorted(((i if i is not None else math.inf, t or "", i) for i, t, _ in rows), key=lambda r: r[:2])
    want = []
    for (_, t, i), (_, u, _) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        e = (t[:len(t) - k] + u[:k]).encode()
        a, b, c = (cdc.chunk_set(x, gear) for x in (t.encode(), e, u.encode()))
        want.append((i, len(t), hashlib.sha256(e).hexdigest(), cdc.as_text(a), cdc.as_text(b),
                     cdc.likeness(a, b), cdc.likeness(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_edited_pairs_edge_tables(spark):
    df = spark.createDataFrame([(5, "only one text"), ], "doc_id long, text string")
    one = cdc.edited_pairs(df).first()
    assert one.near_next == 1 and one.n_chars == 13
    assert cdc.edited_pairs(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert cdc.edited_pairs(none).count() == 2


# --------------------------------------------------------------------- BPE --

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", "a", "Hello world, it's  fine\n\n  ", "\u00dcberstra\u00dfe \u4e2d\u6587 \U0001F600\u200d", "x" * 300, " \t\u00a0\u3000 y",
         "don't we'll 12345 \u0664\u0665", "<|endoftext|>", "\x00\x01", "word " * 50, "Zzyzxqqwv" * 9]


def test_fold_and_loop_match_tiktoken(spark):
    words = sorted({w for t in TEXTS for w in __import__("regex").findall(public_tokenizers.PATTERN, t)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.ids for r in df.select("w", bpe.encode_words(F.col("w"), RANKS).alias("ids")).collect()}
    assert got == {w: ENCODER.encode_ordinary(w) for w in words}
    assert all(bpe.merge_word(w.encode(), RANKS) == got[w] for w in words)


@pytest.mark.parametrize("frequent", [1 << 18, 8])
def test_encode_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    monkeypatch.setattr(bpe, "CACHE", 5)
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, *TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN).withColumn("back", bpe.decode_ids(F.col("ids"), RANKS))
    for r in out.collect():
        ids = ENCODER.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.back) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decode_unknown_ids(spark):
    df = spark.createDataFrame([([64, None, 10**6, -1, 65],), ([],), (None,)], "ids array<int>")
    back = [r[0] for r in df.select(bpe.decode_ids(F.col("ids"), RANKS)).collect()]
    by_id = {v: k for k, v in RANKS.items()}
    assert bytes(back[0]) == by_id[64] + by_id[65] and bytes(back[1]) == b""


# ---------------------------------------------------------- language model --

def slow_katz(rows, train, order):
    """Scores by dictionaries, straight from the formulas."""
    uni, gram, hist, stream = Counter(), Counter(), Counter(), {}
    for i, t in rows:
        tokens = ["start", *katz.words_of(t), "end"]
        if train(i):
            uni.update(tokens[1:])
            for n in range(2, order + 1):
                for j in range(n - 1, len(tokens)):
                    gram[tuple(tokens[j - n + 1:j + 1])] += 1
                    hist[tuple(tokens[j - n + 1:j])] += 1
    n = sum(uni.values())
    words = [*uni, *(["end"] if "end" not in uni else []), "unknown"]
    low = {w: (uni[w] + .1) / sum(uni[x] + .1 for x in words) for w in words}
    d = {k: katz.discounts(np.array([sum(v == r for g, v in gram.items() if len(g) == k) for r in range(1, 7)],
                                    float)) for k in range(2, order + 1)}
    follow = {}
    for g in gram:
        follow.setdefault(g[:-1], []).append(g[-1])
    alphas = {}

    def seen(h, w):
        c = gram[(*h, w)]
        return (d[len(h) + 1][c - 1] if c <= 5 else 1) * c / (hist[h] + .5)

    def p(h, w):
        if not h:
            return low.get(w, low["unknown"])
        if gram[(*h, w)]:
            return seen(h, w)
        if h not in alphas:
            mass = sum(p(h[1:], x) for x in follow.get(h, []))
            alphas[h] = (1 if not hist[h] or 1 - mass < 1e-12 else
                         (1 - sum(seen(h, x) for x in follow[h])) / (1 - mass))
        return alphas[h] * p(h[1:], w)
    out = []
    for i, t in rows:
        tokens = ["start", *katz.words_of(t), "end"]
        s = sum(math.log10(p(tuple(tokens[max(0, j - order + 1):j]), tokens[j])) for j in range(1, len(tokens)))
        b = sum(math.log10((uni[w] + .1) / (n + .1 * (len(uni) + 1))) for w in tokens[1:])
        out.append((i, len(tokens) - 1, sum(uni[w] > 0 for w in tokens[1:]), n, round(b, 6), round(s, 6)))
    return out, [sum(p(h, w) for w in words) for h in list(hist)[:20]]


def katz_rows(seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(3000)] + ["The", "the"] * 300
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60))) + " rare phrase of words" * (i % 3 == 0))
            for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\t new words\x0bhere new words \u00a0x "), (5, rows[5][1]),
                   (5, "other text"), (110, "never seen never seen " * 20), (111, "one two " * 40)]


@pytest.mark.parametrize("order,chunk,bucket", [(2, 1 << 19, 1 << 21), (2, 7, 100), (3, 1 << 19, 1 << 21),
                                                (3, 5, 60), (1, 9, 100), (4, 11, 300)])
def test_katz_matches_brute_force(spark, monkeypatch, order, chunk, bucket):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    rows = katz_rows(order)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, train int").repartition(3)
    got = katz.score(df, F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 0, order=order).collect()
    want, sums = slow_katz(rows, lambda i: i % 10 != 0, order)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in got) == sorted(want)
    assert all(r.held_out == (r.doc_id % 10 == 0) for r in got)
    assert all(abs(s - 1) < 1e-9 for s in sums)


@pytest.mark.parametrize("order,bucket", [(2, 1 << 21), (2, 60), (3, 60)])
def test_stored_model_scores_alike(spark, monkeypatch, tmpdir_path, order, bucket):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    rows = katz_rows(20 + order)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 10 == 0
    model = katz.fit(df.where(~held), f"{tmpdir_path}/ngrams{order}{bucket}", order=order)
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 8), F.round("score", 8)]
    got = katz.score_with(model, df.where(held)).select(cols).collect()
    want = katz.score(df, ~held, held, order=order).where("held_out").select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 8
    grams = katz.table(spark, model.path, 2).select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)))
    assert grams.first()[0] == model.tokens


def test_katz_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a")], "doc_id long, text string")
    none = katz.score(df, F.lit(False), F.lit(True)).collect()
    assert len(none) == 2 and all(math.isfinite(r.score) and r.train_tokens == 0 for r in none)
    assert katz.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0
    assert not {r.held_out for r in katz.score(df, F.col("doc_id") > 0, F.col("doc_id") < 0).collect()} - {False}
    named = spark.createDataFrame([("x", "a b", 1), (None, "a b", 2)], "doc_id string, text string, rid int")
    got = katz.score(named, F.lit(True), F.lit(False)).collect()
    assert {r.doc_id for r in got} == {"x", None} and got[0].score == got[1].score


def test_packed_numbers():
    for a in ([], [0], [5, -1, 1 << 40], [255, 256]):
        assert katz.unpack(katz.pack(np.array(a, np.int64))).tolist() == a
    a = np.array([0.5, -1e-9, 0.5, 3.0])
    assert katz.unpack_floats(katz.pack_floats(a)).tolist() == a.tolist()


def test_long_words_merge_alike(monkeypatch):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rnd = random.Random(4)
    words = ["".join(rnd.choices("etaoinshr\u00e9", k=900)).encode(), b"a" * 701, b"ab" * 400,
             bytes(rnd.randrange(256) for _ in range(600))]
    long = [bpe.merge_word(w, ranks) for w in words]
    monkeypatch.setattr(bpe, "LONG", 1 << 30)
    assert long == [bpe.merge_word(w, ranks) for w in words]
    assert all(bpe.merge_long(w[:k], ranks) == bpe.merge_word(w[:k], ranks) for w in words for k in range(1, 40))
    big = "".join(rnd.choices("etaoinshr", k=1_000_000)).encode()
    by_id = {i: b for b, i in ranks.items()}
    assert b"".join(by_id[i] for i in bpe.merge_long(big, ranks)) == big


def test_words_merged_together_as_one_by_one(monkeypatch):
    rnd = random.Random(5)
    words = [bytes(rnd.choices(b"etaoinshr \xc3\xa9\xff", k=rnd.randrange(1, 60))) for _ in range(3000)]
    words += [w for w in list(RANKS)[::97]] + [b"a" * 300, b"ab" * 120]
    want = [np.array(bpe.merge_word(w, RANKS), "<u4").tobytes() for w in words]
    model = bpe.pair_model(RANKS)
    assert bpe.merge_batch(words, RANKS, model) == want
    monkeypatch.setattr(bpe, "BATCH", 7)
    assert bpe.merge_batch(words[:100], RANKS, model) == want[:100]
    assert bpe.merge_batch([], RANKS, model) == []
    few = {b"a": 0, b"b": 1, b"ab": 2}
    assert bpe.pair_model(few) is None
    assert bpe.merge_batch([b"abab"], few, None) == [np.array([2, 2], "<u4").tobytes()]
