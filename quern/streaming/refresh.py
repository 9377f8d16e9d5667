"""Incremental refresh as a stream: new files arrive, state is brought up to date in batches.

The reference has no streams; this wraps its batch refresh, so every micro-batch is an
upsert of changed files and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.incremental import changed
from quern.sources.sinks import upsert


def refresh_batch(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(changed files, new state)`` of one batch of ``(path, text)`` against ``state(path, sha256, complete)``.

    Of several versions of a path in a batch the greatest text hash counts, so the
    result does not depend on their order.
    """
    now = batch.select("path", "text", F.sha2("text", 256).alias("sha256"))
    now = now.groupBy("path").agg(F.max_by("text", "sha256").alias("text"), F.max("sha256").alias("sha256"))
    new = changed(now, state)
    return new, upsert(state, new.select("path", "sha256", F.lit(True).alias("complete")), "path")


def refresh_stream(
    spark: SparkSession, source: str, schema: str, state_path: str, checkpoint: str, on_change: Callable[[DataFrame], None], fmt: str = "parquet"
) -> StreamingQuery:
    """Watch ``source`` for files of ``(path, text)`` rows and keep the state table current.

    The state alternates between two folders, so a batch that is run again after a
    failure reads the state from before it.
    """
    state_schema = "path string, sha256 string, complete boolean"

    def one(batch: DataFrame, epoch: int) -> None:
        old, new = f"{state_path}/{epoch % 2}", f"{state_path}/{(epoch + 1) % 2}"
        s = batch.sparkSession
        try:
            state = s.read.schema(state_schema).parquet(old) if epoch else s.createDataFrame([], state_schema)
        except Exception as e:  # the first batch after an empty start
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = s.createDataFrame([], state_schema)
        fresh, now = refresh_batch(batch, state)
        now.write.mode("overwrite").parquet(new)
        on_change(fresh)

    stream = spark.readStream.format(fmt).schema(schema).load(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
