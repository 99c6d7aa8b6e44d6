"""Corpus pipeline: language ID, SimHash near-dedup, mixing, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
the next documents, whose columns all stages but the last keep.  ``run`` applies them to
the documents table; each stage's result is written as Parquet in the shared folder and
read again, so a later stage never recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import bpe, lang_id, mixing, simhash
from encore.llm.common import free_names, stored
from encore.sources.tables import read_table

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised: not those without a letter, nor
    those where no language has a posterior of at least LEAST_SCORE.  The model learns
    from the labelled documents.  A null text goes, equal texts stay or go together, a
    table without labels leaves nothing; the input's columns stay as they are."""
    model = lang_id.train(docs, F.lit(True))
    lang, score = free_names(docs.columns, "lang_pred", "score")
    named = lang_id.predict(docs, model, results=(lang, score))
    return (named.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
            .select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by SimHash (3-word shingles, 3 bits), also
    of groups without ids or with clashing ones: the least doc_id (null last), then the
    least text hash, then the first row.  Null and empty texts are one group; the input's
    columns stay as they are."""
    return simhash.near_dedup(docs, shingle=3, distance=3, keep_nameless=False).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to target weights (square root of the source's size) and shuffle.
    A null source is one of its own, rows equal in id and text are drawn equally often; the
    input's columns stay as they are."""
    copy, = free_names(docs.columns, "copy")
    return mixing.mix(docs, alpha=0.5, seed=42, copy_col=copy).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded
    from them.  A null text is empty, equal texts have equal ids, repeated rows stay; only
    doc_id and source go along."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "source", "n_tokens", "ids", "ids_sha256",
                       F.sha2(bpe.decode_ids(F.col("ids"), ranks), 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("byte_bpe", encode_tokens)]

#: Hashes, trained models and Unicode patterns cannot be put in DuckDB SQL; the stages
#: are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
