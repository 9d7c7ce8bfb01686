"""The queries of this subpackage, each over its whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.gallery.base import Query, table
from plumbline.llm import contamination, divergence, filters, language, licenses, neighbours, pitmanyor, resampling, secrets, sentencepieces, simhash, tokenfiles, toxicity


def op1_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_simhash_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op4_sentencepiece_n_best(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.report(table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.report(table(spark, folder, "documents"))


def op6_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(spark, table(spark, folder, "documents"))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.licenses(table(spark, folder, "documents"))
    told = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("spans", F.array_join(told, ","))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.report(table(spark, folder, "documents"))


def op10_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return pitmanyor.report(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filters.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.report(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_importance_resampling": Query(op1_importance_resampling),
    "op2_toxicity": Query(op2_toxicity),
    "op3_simhash_near_copies": Query(op3_simhash_near_copies),
    "op4_sentencepiece_n_best": Query(op4_sentencepiece_n_best),
    "op5_token_files": Query(op5_token_files),
    "op6_secret_ledger": Query(op6_secret_ledger, secrets.ORACLE_SQL),
    "op7_neighbours": Query(op7_neighbours),
    "op8_licenses": Query(op8_licenses),
    "op9_language": Query(op9_language),
    "op10_benchmark_passages": Query(op10_benchmark_passages),
    "op11_language_model": Query(op11_language_model),
    "op12_filter_audit": Query(op12_filter_audit, filters.ORACLE_SQL),
    "op13_source_divergence": Query(op13_source_divergence, divergence.ORACLE_SQL),
}
