"""The registered query of each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import ann, chat, decontaminate, forest, langid, linededup, mixing, pages, paragraphs, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join_documents(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"), whole_words=paragraphs.WHOLE_WORDS)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_differencing": op1,
    "op2_ngram_jaccard_forest": op2,
    "op3_mix_hierarchy": op3,
    "op4_decontaminate": op4,
    "op5_nearest_one_bit": op5,
    "op6_main_text": op6,
    "op7_line_dedup": op7,
    "op8_language_id": op8,
    "op9_paragraph_minhash": op9,
    "op10_chat_rotation": op10,
}

ORACLES: dict[str, str] = {
    "op3_mix_hierarchy": mixing.oracle(),
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op10_chat_rotation": chat.ORACLE,
}
