"""A corpus made ready for training: stages over ``documents``, each one of the operators of ``plumbline.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import contamination, language, secrets, sentencepieces, simhash
from plumbline.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the models are taught by the labelled rows of these documents."""
    return language.recognised(docs, language.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest ``doc_id``, of each group linked by fingerprints 3 or fewer bits apart."""
    return simhash.first_of_each(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the characters of its secrets become ``*``."""
    return secrets.masked(spark, docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text and the scores of the next best."""
    return sentencepieces.encode(docs).selectExpr(
        "doc_id",
        "segmentations[0].ids AS ids",
        "cast(octet_length(segmentations[0].ids) / 4 AS long) AS n_tokens",
        "transform(segmentations, x -> x.score) AS scores",
        "restored",
    )


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", free_of_benchmarks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", as_pieces),
]
#: No stage but the fourth can be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return kept
        folder = scratch_folder(spark, f"stage-{i}")
        kept.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
