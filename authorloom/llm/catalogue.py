"""Queries of the operators of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.llm import (
    ann,
    bpe,
    chat,
    collocations,
    decontam,
    lm_mix,
    near_dup,
    quality,
    secret_scan,
    suffix_dedup,
    token_align,
    toxicity,
    warc,
)
from authorloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, folder, "documents")))


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    mark = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    given = spark.createDataFrame([(-1, 0, "user", mark), (-1, 1, "assistant", mark)], rows.schema)
    return chat.digests(chat.conversations(rows.union(given)))


@query
def op11_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_mix.language_model(table(spark, folder, "documents"))


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    return token_align.alignment(table(spark, folder, "documents"), *map(public_tokenizers.path, files))
