"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. An empty table gives an empty result in every stage;
columns beyond doc_id, text and lang are carried along, whatever their names. A null text counts as empty. Rows that repeat id and text stay or go together,
but in the second stage, where one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import decontaminate, exact_dedup, near_dedup, quality, sentencepiece
from tamarack.llm.common import release, scratch_path, table
from tamarack.llm.queries import tokenizer_file

#: SentencePiece cannot be expressed in SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows that the classifier rejects: null texts and texts without words, and those whose score is over their language's threshold."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; a null id loses to others."""
    return exact_dedup.deduplicated(docs, keep="least")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; a null id loses to others. Texts without words stay."""
    return near_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows that hold an item of the benchmark or nearly so."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, round_trip; a null or empty text has no ids."""
    return sentencepiece.encode(docs, sentencepiece.read_model(spark, tokenizer_file("piece_bpe_32k.model"))).drop("parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages' outputs are in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
