"""Registered queries of the training-data operators, one per operator, each over
its whole table, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from encore.sources.tables import read_table

QUERIES = {}
ORACLE = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def id_crc():
    """Unsigned CRC-32 of the doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@register("op1_language_id")
def op1(spark, sf_dir):
    """Language of every document; a quarter of the ids is held out of training."""
    from encore.llm import lang_id
    docs = read_table(spark, sf_dir, "documents")
    held = F.pmod(id_crc(), F.lit(4)) == 2
    model = lang_id.train(docs, ~held)
    return (lang_id.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@register("op5_simhash")
def op5(spark, sf_dir):
    """SimHash components of all documents: 3-word shingles, at most 3 bits."""
    from encore.llm import simhash
    docs = read_table(spark, sf_dir, "documents")
    return (simhash.simhash_components(docs, shingle=3, distance=3)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


@register("op6_hilbert_shards")
def op6(spark, sf_dir):
    """All documents along a Hilbert curve over language, source, size and id, cut
    into 40 shards by the law `rows`."""
    from encore.llm import hilbert
    placed = hilbert.shard_documents(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hilbert")


#: Fixed by the query's contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register("op10_url_filter")
def op10(spark, sf_dir):
    """Verdict of every page's URL under the fixed rules."""
    from encore.llm import url_filter
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return (url_filter.judge(pages, URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


ORACLE["op10_url_filter"] = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages)
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h))
          AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h))
          AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM u"""


@register("op3_chunk_fingerprints")
def op3(spark, sf_dir):
    """Chunk fingerprints of every document and its edited text, with likenesses."""
    from encore.llm import cdc
    return cdc.edited_pairs(read_table(spark, sf_dir, "documents"))


@register("op8_embedding_dedup")
def op8(spark, sf_dir):
    """Cosine links of at least 0.93 between all vectors of a label, and components."""
    from encore.llm import embed_dedup
    return embed_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), cosine=0.93)


@register("op9_poisson_mix")
def op9(spark, sf_dir):
    """The mixed corpus: sources weighted by the square root of their size, every
    document repeated as drawn, in the global shuffle order."""
    from encore.llm import mixing
    return mixing.mix(read_table(spark, sf_dir, "documents"), alpha=0.5, seed=42)


@register("op4_byte_bpe")
def op4(spark, sf_dir):
    """Token ids of every document and the text decoded from them, as digests."""
    import public_tokenizers

    from encore.llm import bpe
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (bpe.encode(docs, ranks, public_tokenizers.PATTERN)
            .select("doc_id", "n_tokens", "ids_sha256",
                    F.sha2(bpe.decode_ids(F.col("ids"), ranks), 256).alias("decoded_sha256")))


@register("op2_warc_index")
def op2(spark, sf_dir):
    """Write all pages as WARC records with a capture index, find every page's capture
    through the index and read the records back."""
    from encore.llm import warc
    from encore.sources.sinks import scratch_path
    pages = read_table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    archive = warc.write_archive(pages, path)
    return warc.read_records(warc.lookup(pages.select("url", "page_id"), archive, path), path)


ORACLE["op2_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS g, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON g = payload_digest"""


@register("op7_katz_lm")
def op7(spark, sf_dir):
    """Katz backoff score of every document; a tenth of the ids is held out."""
    from encore.llm import katz
    docs = read_table(spark, sf_dir, "documents")
    rest = F.pmod(id_crc(), F.lit(10))
    return katz.score(docs, train=rest != 0, held_out=rest == 0)


@register("op11_source_divergence")
def op11(spark, sf_dir):
    """How the sources of each language differ: every pair of sources, and the terms that
    stand out in each."""
    from encore.llm import divergence
    return divergence.audit(read_table(spark, sf_dir, "documents"), min_docs=3, top=200)


ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY 1),
size AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM n WHERE n.lang = g.lang AND n.source = g.source), 0)
                + v AS size, total + v AS lang_size FROM g JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
             CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // size AS HUGEINT) AS p,
             CAST(1 + 1000000000::HUGEINT * (total + 1) // lang_size AS HUGEINT) AS q
      FROM size JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
         FROM p WHERE n > 0 AND p > q),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (FROM term UNION ALL FROM pair))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 200"""


@register("op12_sentencepiece")
def op12(spark, sf_dir):
    """SentencePiece ids of every document and the text decoded from them, as digests."""
    import public_tokenizers

    from encore.llm import pieces
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, model).select("doc_id", "n_tokens", "ids")
    return (pieces.decode(coded, model)
            .select("doc_id", "n_tokens",
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
                    .alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    """Periodic runs of words in every document, a tenth of them made periodic from some
    word on, and digests of the runs and of the collapsed text."""
    from encore.llm import runs
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", runs.repeat_tail(F.col("text"), id_crc()).alias("text"))
    found = runs.periodic_runs(docs, min_words=24, repeats=3)
    top = runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return (found.withColumn("top", top)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                    F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@register("pipeline")
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
