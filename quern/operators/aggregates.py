"""Summaries of the index: languages, symbols, first locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_languages(files: DataFrame, n: int) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(n)


def top_symbols(symbols: DataFrame, n: int) -> DataFrame:
    """Most frequent names of three or more characters."""
    g = symbols.where(F.length("name") >= 3).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    return g.orderBy(F.desc("n"), "name").limit(n)


def first_location(findings: DataFrame, *keys: str) -> DataFrame:
    """Count and first line of the findings of each key."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
