"""The corpus pipeline: language, near duplicates, repeated passages, mixture, tokens.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.llm import bpe, language, mixing, nearjoin, suffixdedup
from ledgerwing.llm.registry import tokenizer_path
from ledgerwing.llm.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A language that the model gives less than this goes: no language of four or more stands out then.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, all columns; the model learns from a bounded sample of the labelled ones.

    Null texts, texts without a letter and those of too low a score go; repeated rows stay as often as they come. Where
    no row has a label nothing can be told and nothing stays. An empty table stays empty.
    """
    return language.keep_identified(docs, language.fit(docs, F.lit(True)), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more: the one of least doc_id.

    Texts without words, null texts and rows with a null doc_id stay. Rows of one doc_id stay or go together.
    """
    return nearjoin.keep_one(docs, nearjoin.Similarity(n=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages of 200 bytes or more that occur elsewhere too.

    Null texts stay null, shorter ones as they are; n_chars follows the text, other columns stay.
    """
    return suffixdedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target mixture takes, all columns.

    Texts without a word, null ones too, are never taken; a null language or source counts as `unknown`. Repeated
    rows are taken together.
    """
    return mixing.select_documents(docs, mixing.PIPELINE_MIXTURE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the decoded text, of every row.

    Null and empty texts have no tokens and the digest of the empty text.
    """
    path = tokenizer_path()
    rows = docs.select("doc_id", "lang", "source", bpe.round_trip_column(F.col("text"), path).alias("both"))
    decoded = F.sha2(F.col("both.decoded").cast("binary"), 256)
    return rows.select("doc_id", "lang", "source", F.size("both.ids").cast("long").alias("n_tokens"), F.col("both.ids").alias("ids"), decoded.alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: SQL cannot express the fitted language model; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}-{name.replace(' ', '-')}")
    return docs
