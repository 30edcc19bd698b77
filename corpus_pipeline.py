"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing, SentencePiece encoding; each stage a Parquet table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import toxicity
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.mixing import materialise
from tessera.llm.near_dups import drop_near_duplicates
from tessera.llm.piece_sampling import encode_documents
from tessera.plans.scratch import Scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the labels of the documents at hand.

    Null and empty texts score 0 and stay, repeated rows and null ids are judged by their own text, an empty table or one
    without labels rejects nothing. Columns more stay as they are.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.apply(docs, model, keep=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that another document, or they themselves, have before; no document goes.

    Null texts stay null, empty ones empty; rows that repeat id and text are one document and get the same text; null ids
    come first among the occurrences of a line. n_chars follows the text.
    """
    return drop_repeated_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Null and empty texts have no duplicates and stay, so do null ids. Of an id with several texts each is judged on its own;
    rows that repeat id and text stay or go together.
    """
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents (or word runs) that the mix takes, some twice.

    Null and empty texts give no words and go; null sources are a source of their own; an empty table stays empty. Rows
    that repeat id, text and source take the same words.
    """
    return materialise(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids (as digests) and sampled segmentations of every document of the mix, a row each, null texts as empty ones."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Learned scores and similarity components have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
