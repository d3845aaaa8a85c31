"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rankfold.llm import ann, decontaminate, html_text, language, lm, near_dup, phrases, pieces, pii, sharding, spelling, suffix_dedup, toxicity
from rankfold.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), check=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.overlap_report(documents(spark, sf_dir), benchmark).drop("longest")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_lm_score": op6_lm_score,
    "op7_ann": op7_ann,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_sharding": op11_sharding,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
