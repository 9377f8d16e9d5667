"""Sinks: written tables that cut lineage, upserts, partition overwrites, JSON artifacts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; one of our own where it is unset, in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so later steps do not recompute it."""
    path = f"{shared_dir(df.sparkSession)}/quern-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same keys."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def replace_children(current: DataFrame, changes: DataFrame, dirty: DataFrame, key: str = "path") -> DataFrame:
    """All rows of the dirty keys go, those of ``changes`` come: delete, then insert."""
    return current.join(dirty.select(key).distinct(), key, "left_anti").unionByName(changes)


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_artifact(df: DataFrame, path: str) -> None:
    """A report as one JSON file; for results that are small by nature."""
    df.coalesce(1).write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)`` of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
