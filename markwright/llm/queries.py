"""The ``opN_*`` queries of this subpackage and their DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (
    change_feed,
    decontaminate,
    jaccard_join,
    kneser_ney,
    language_id,
    line_dedup,
    personal_data,
    piece_codec,
    product_codes,
    repetition,
    token_files,
    url_filter,
    warc,
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return kneser_ney.classify(read(spark, sf_dir, "documents"), trusted)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(warc.captures(read(spark, sf_dir, "pages")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.evaluate(url_filter.captures_of(pages), url_filter.entries_of(pages))


def op9_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.boundaries(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compressed(read(spark, sf_dir, "embeddings"))


def op12_sequenced_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.sequenced(read(spark, sf_dir, "client_changes"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_warc,
        op3_sentencepiece,
        op4_language_id,
        op5_substring_dedup,
        op6_ngram_jaccard_join,
        op7_quality_rules,
        op8_url_filters,
        op9_token_binary_output,
        op10_benchmark_decontamination,
        op11_vector_code_compression,
        op12_sequenced_change_applier,
        op13_pii,
    )
}

ORACLES: dict[str, str] = {"op8_url_filters": url_filter.ORACLE}
