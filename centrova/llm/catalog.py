"""The queries of this subpackage: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from centrova.llm.frames import documents, table

#: Where the public vocabularies are; a parameter of the operators, never copied.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.suffix_dedup import removals

    return removals(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.mixing import mixed_words

    return mixed_words(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.quality_classifier import classify

    return classify(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.license_scan import licences

    return licences(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.substring_dedup import removals

    return removals(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.jaccard_join import components_by_id

    return components_by_id(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.quality_rules import verdicts

    return verdicts(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centrova.llm.decontaminate import contamination_digest

    return contamination_digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_mixing, op4_quality_classifier, op5_license_scan, op6_substring_dedup, op7_jaccard_join, op8_token_counts, op9_quality_rules, op10_decontamination, pipeline)}


def oracle_sql() -> dict[str, str]:
    from centrova.llm import mixing, sql

    return {"op3_mixing": mixing.oracle_sql(), "op7_jaccard_join": sql.jaccard(), "op9_quality_rules": sql.quality_rules(), "op10_decontamination": sql.decontamination()}
