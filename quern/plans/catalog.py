"""Catalog of the engine's registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import q_clones, q_code, q_extract, q_fusion, q_graph, q_incremental, q_intent, q_investigation, q_lexical, q_lines, q_quality, q_routes, q_vectors, search

FAMILIES = (q_lines, q_lexical, q_vectors, q_graph, q_fusion, q_quality, q_incremental, q_investigation, q_routes, q_code, q_clones, q_extract, q_intent)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir, "open license terms", 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in FAMILIES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in FAMILIES for name, sql in m.ORACLES.items()}
