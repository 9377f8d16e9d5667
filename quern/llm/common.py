"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is configured, in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing will read again."""
    path = getattr(df, "_quern_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def maybe_broadcast(df: DataFrame, row_limit: int) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be within ``row_limit``."""
    return F.broadcast(df) if df.limit(row_limit + 1).count() <= row_limit else df


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Components of the graph given by ``edges(a long, b long)``.

    Alternates large-star and small-star steps until the edge set is stable, so
    every step is two shuffles over the edges and the number of rounds grows with
    the logarithm of the longest path. Returns ``(id, component_id)`` for nodes
    that have an edge, ``component_id`` being the smallest id of the component.
    """

    def star(both: DataFrame, keep: str) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if keep == "large":
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = materialize(star(both, "large").where("a <> b").distinct(), label)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = materialize(star(down, "small").where("a <> b").distinct(), label)
        discard(now), discard(large)
        now, before = small, seen
        seen = mark(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )
