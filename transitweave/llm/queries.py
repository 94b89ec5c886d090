"""The queries of the operators, by name. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .common import table
from .decontaminate import leaks
from .merkle import merkle_manifest
from .ngram_join import similar_documents
from .piece_codec import piece_digests
from .quality import quality_scores, train
from .shards import byte_shards
from .simhash import simhash_groups
from .spelling import spelling_variants
from .token_counts import token_counts
from .token_records import read_records, record_folder, write_records
from .suffix_dedup import repeat_digests
from .topk import top_k
from .urls import url_verdicts


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that copy a test item, whole or edited: see decontaminate.leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.6)


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes: see shards.byte_shards."""
    return byte_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op3_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document, fitted on labels outside the held-out third: see quality.quality_scores."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels"), most=20_000))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are alike to nine tenths: see ngram_join.similar_documents."""
    return similar_documents(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page's URL, by rules and by two models: see urls.url_verdicts."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 50th vector the five others of highest product: see topk.top_k."""
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces, and of the text that they decode to: see piece_codec.piece_digests."""
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 100 bytes: see suffix_dedup.repeat_digests."""
    return repeat_digests(table(spark, sf_dir, "documents"), length=100)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document: see token_counts.token_counts."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of token ids, written and read again: see token_records."""
    folder = record_folder(spark)
    index = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_records(folder, index)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and roots, and whether a tampered copy still verifies: see merkle.merkle_manifest."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in four bits at most: see simhash.simhash_groups."""
    return simhash_groups(table(spark, sf_dir, "documents"), n=4, radius=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their commoner neighbours: see spelling.spelling_variants."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_byte_shards, op3_quality_ranker, op4_ngram_jaccard_join, op5_url_verdicts, op6_exact_top_k, op7_piece_codec, op8_suffix_dedup, op9_token_counts, op10_token_records, op11_merkle_manifest, op12_simhash_groups, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | {
        "op6_exact_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS c FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
            SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    }
