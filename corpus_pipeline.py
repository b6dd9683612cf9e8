"""A training corpus from the ``documents`` table: five stages, each written as Parquet and read back as the next one's documents.

Rejects of the quality classifier go, repeated and similar lines are cut to one, one document of each near-duplicate class stays,
documents with benchmark passages go, and the sources are mixed to their target weights. Every stage works on all that the one before
kept. Rows with null ids or texts, repeated rows and further columns pass through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orepulse.llm import decontamination, lines, mixing, order_minhash, quality
from orepulse.llm.common import cut, table

ORACLE_SQL = None  # the learned classifier and the similarity components have no SQL form


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with the lines that no earlier line resembles; ``n_chars`` follows the text."""
    return _counted(lines.dedup_lines(docs, size=lines.SHORT_SHINGLE))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.drop_near_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: ``doc_id, source, size, source_size, target, taken`` of every document with a share in it."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", keep_good),
    ("lines", cut_lines),
    ("near copies", drop_near_copies),
    ("benchmark", drop_leaks),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
