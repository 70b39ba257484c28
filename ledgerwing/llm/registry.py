"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwing.llm import bpe, fptree, language, lexpack, mixing, multiprobe, nearjoin, ngramlm, repair, sharding, suffixdedup, urlfilter, voronoi

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeat_digests(_read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.scaled_top10(_read(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(_read(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest5(_read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"), mixing.CORPUS_MIXTURE)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.held_out_scores(_read(spark, sf_dir, "documents"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.link(_read(spark, sf_dir, "documents"), nearjoin.Similarity(n=3, percent=90))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.page_verdicts(_read(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexpack.packed_digests(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_digests(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_repeats": op1_repeats,
        "op2_topk": op2_topk,
        "op3_language": op3_language,
        "op4_ann": op4_ann,
        "op5_mixing": op5_mixing,
        "op6_sharding": op6_sharding,
        "op7_lm_score": op7_lm_score,
        "op8_near_join": op8_near_join,
        "op9_url_filter": op9_url_filter,
        "op10_bpe": op10_bpe,
        "op11_packing": op11_packing,
        "op12_ranked_search": op12_ranked_search,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": voronoi.ORACLE_SQL,
        "op5_mixing": mixing.oracle_sql(mixing.CORPUS_MIXTURE),
        "op9_url_filter": urlfilter.ORACLE_SQL,
        "op12_ranked_search": fptree.ORACLE_SQL,
    }
