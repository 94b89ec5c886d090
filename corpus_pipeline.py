"""A corpus pipeline: documents in, tokens of clean and distinct documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the docs of the next one. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from transitweave.llm.common import scope, ship, table, written
from transitweave.llm.decontaminate import without_leaks
from transitweave.llm.ngram_join import one_of_each
from transitweave.llm.piece_codec import piece_digests
from transitweave.llm.quality import good_documents, train
from transitweave.llm.suffix_dedup import cut_documents


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first deletes what other stages have left in the shared folder, apart from what docs read: their results have been written by then."""

    @wraps(f)
    def scoped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark, "pipeline", f.__name__, docs):
            return f(spark, docs, sf_dir)

    return scoped


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, train(docs, table(spark, sf_dir, "labels"), most=20_000))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a five-word Jaccard similarity of 0.8 or more, the smallest id stays."""
    ship(spark)
    return one_of_each(docs, n=5, num=4, den=5)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 that also start earlier go; documents stay, if need be empty."""
    ship(spark)
    return cut_documents(docs, length=100)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, copied or edited, go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), least=0.6)


@stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    ship(spark)
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", pieces)]

#: SQL can't express the fitted classifier, the alignment or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.split(" ")[0].lower())
    return docs
