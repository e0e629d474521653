"""Queries of this subpackage: name -> function of the session and the data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvloom.llm import bpe, canonical, garble, names, packing, pii
from cvloom.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "experience").select("exp_id", "description"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(_lines(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_lines(_lines(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.inconsistent_values(table(spark, d, "candidates"), _lines(spark, d))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_values(table(spark, d, "candidates"), _lines(spark, d)).select("field", "row_id", "line_no", "canonical")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_mentions(table(spark, d, "education"), table(spark, d, "experience"), table(spark, d, "organisations")).select("field", "row_id", "org_id")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name with its cluster: the entry that it means, or else the spellings that it goes with."""
    said = names.mentions(table(spark, d, "education"), table(spark, d, "experience"))
    return names.link_values(said, table(spark, d, "organisations"))


def p6_ties(spark: SparkSession, d: str) -> DataFrame:
    """How many typed names are linked, how many mean two entries equally, and how many none."""
    return p6_clusters(spark, d).groupBy("kind").agg(F.count("*").alias("n_names"), F.count("org_id").alias("n_linked"), F.sum(F.col("tie").cast("bigint")).alias("n_ties"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(_documents(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, d))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(packing.pack_documents(_documents(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled_documents(_documents(spark, d))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.judged(_documents(spark, d)).select("doc_id", "restored", "garbled")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_redacted, p5_found, p5_canonical, p6_found, p6_clusters, p6_ties, p7_ids, p8_containers, p8_usage, p9_found, p9_restored)}
