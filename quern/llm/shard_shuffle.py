"""Sharding by a two-pass external shuffle.

The first pass scatters records by seeded hashes into buckets of which each fits into a
task's memory; the second shuffles every bucket by Fisher-Yates, in memory, and writes it.
The buckets one after another are the shuffled corpus, and shards are equal stretches of
it. Both passes are DataFrame functions: the scatter is the engine's own exchange, and
its ``shuffle`` of arrays draws by Fisher-Yates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize, maybe_broadcast

#: Bytes of records that a bucket holds on average, and the least number of buckets.
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 64
#: The exchange has a partition for each bucket, up to so many.
MAX_PARTITIONS = 20_000
#: Bytes of a record besides its text, as an estimate.
RECORD_BYTES = 64
#: Rows of heavy keys or of buckets that a broadcast may hold.
BROADCAST_ROWS = 2_000_000


def _key(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[Column, Column]:
    text = docs[text_col].cast("string")
    return F.xxhash64(F.lit(seed), docs[id_col], text), F.xxhash64(text, docs[id_col], F.lit(~seed))


def shuffle_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 1,
    bucket_bytes: int = BUCKET_BYTES,
    min_buckets: int = MIN_BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc, shard, slot)``: every row of ``docs``, its place in the shuffled corpus.

    ``doc`` is the row with all its columns, whatever their names. Shard sizes in rows
    differ by one at most; ``slot`` counts from 0 without gaps in each. The number of
    buckets follows the bytes of the texts, so a bucket fits into memory at every size. A row's bucket
    follows from seed, id and text alone; copies of one row that are more than an
    eighth of a bucket are spread by their places in ``docs``, so these must come from
    a table or files, whose order a lost executor does not change. The buckets are
    written once, as Parquet, and everything after reads them. The same seed, rows and
    parameters give the same shuffle if no row repeats so often. Null ids and texts are
    values like others; repeated rows keep a place each; an empty table gives no rows.
    """
    d1, d2 = _key(docs, id_col, text_col, seed)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), d1.alias("d1"), d2.alias("d2"), F.monotonically_increasing_id().alias("at"))
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + RECORD_BYTES
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).head()
    buckets = max(min_buckets, -(-n_bytes // bucket_bytes))

    heavy = docs.select(d1.alias("h1"), d2.alias("h2"), size.alias("size")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    heavy = materialize(heavy.where(F.col("n") * F.col("size") > bucket_bytes // 8).where("n > 1").select("h1", "h2"), "shard-heavy")
    same = (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2"))
    spread = keyed.join(maybe_broadcast(heavy, BROADCAST_ROWS), same, "left")
    salt = F.when(F.col("h1").isNotNull(), F.col("at")).otherwise(F.lit(0))
    spread = spread.select("doc", "d1", "d2", F.pmod(F.xxhash64("d1", "d2", salt), F.lit(buckets)).alias("bucket"))

    # The scatter, then a bucket at a time in the order of its hashes: one array, shuffled.
    # Partitions are named, not hashed, so each has its equal part of the buckets.
    parts = min(buckets, MAX_PARTITIONS)
    scattered = spread.withColumn("part", (F.col("bucket") % parts).cast("int")).repartitionById(parts, F.col("part")).sortWithinPartitions("bucket", "d1", "d2")
    held = scattered.groupBy("part", "bucket").agg(F.collect_list("doc").alias("docs"))
    drawn = held.select("bucket", F.posexplode(F.shuffle("docs", seed)).alias("pos", "doc"))
    written = materialize(drawn, "shard-buckets")
    discard(heavy)

    # One row for each bucket: where it begins in the shuffled corpus.
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("bucket", before.alias("begin"))
    place = written.join(maybe_broadcast(begins, BROADCAST_ROWS), "bucket").select("doc", (F.col("begin") + F.col("pos")).alias("place"))
    # Shard k holds the places from ceil(k * rows / shards) on.
    rows = max(n_rows, 1)
    place = place.select("doc", F.expr(f"place * {shards} div {rows}").alias("shard"), "place")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return place.select("doc", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 1, **options) -> None:
    """Write ``docs`` in shuffled order, a folder ``shard=K`` for each shard, all columns and ``slot`` in it.

    Columns called ``shard`` or ``slot`` in ``docs`` get the name with ``source_`` in front.
    """
    out = shuffle_shards(docs, shards, seed, **options)
    names = {c: f"source_{c}" if c in ("shard", "slot") else c for c in docs.columns}
    out = out.select(*[F.col("doc").getField(c).alias(n) for c, n in names.items()], "shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def shard_digests(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of :func:`shuffle_shards`.

    The law is that of ``rows``; which shard a row would go to if there were one more
    is not a question of this law, so ``grown_shard`` is null.
    """
    text = F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit(""))
    return sharded.select(
        F.col("doc").getField(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
