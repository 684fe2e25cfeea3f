"""Registered queries of this subpackage and the SQL that states the same results, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.annotations import written_lines
from tallyfield.operators.ballots import ballots, first_questions
from tallyfield.sources.tables import table

from . import clusters, consensus, leakage, mixture, truncation


def _consensus(spark: SparkSession, folder: str, **settings) -> consensus.Consensus:
    questions = first_questions(table(spark, folder, "workflows"))
    return consensus.consensus(ballots(table(spark, folder, "classifications"), questions), consensus.Settings(**settings))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).subjects.select("workflow_id", "subject_id", "task", "answer")


def p1_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject with a ballot; the least of five ballots is that of ``p1_found`` alone."""
    return _consensus(spark, folder, min_ballots=1).subjects


def p1_volunteers(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).volunteers


LEDGER = 2103


def _transcriptions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "classifications").where(F.col("workflow_id") == LEDGER)
    return rows.select("id", F.array_join(written_lines(F.col("annotations")), "\n").alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clusters(_transcriptions(spark, folder)).members.select("cluster_id", "id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clusters(_transcriptions(spark, folder)).summary


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that leaked: documents that hold them, sources, longest passage."""
    found = p6_leaks(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return (
        found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"), F.max("passage").alias("longest"))
        .join(table(spark, folder, "eval_items").select("item_id", "suite"), "item_id")
    )


def _mixture(spark: SparkSession, folder: str, **settings) -> mixture.Mixture:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), mixture.Settings(**settings))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mixture in which every source that has documents meets its target."""
    return _mixture(spark, folder).documents


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares


def p7_budget_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mixture half as large as all sources with targets, for which some are too small whatever their repeats."""
    return _mixture(spark, folder, budget_share=0.5).shares


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation(table(spark, folder, "documents")).documents


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_documents(spark, folder).select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation(table(spark, folder, "documents")).sources


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation(table(spark, folder, "documents")).limits


QUERIES = {
    "p1_found": p1_found,
    "p1_consensus": p1_consensus,
    "p1_volunteers": p1_volunteers,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_budget_shares": p7_budget_shares,
    "p8_found": p8_found,
    "p8_documents": p8_documents,
    "p8_sources": p8_sources,
    "p8_limits": p8_limits,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_items": p6_items,
}
SQL: dict[str, str] = {}
