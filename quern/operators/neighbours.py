"""Distinct neighbours of items that share a group, counted by blocks of items instead of pairs of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.sinks import materialize

#: Items of a block; a pair of blocks is one table of so many bits squared (32 MB) in one task at a time.
BLOCK = 16_384
#: Pairs of a row up to which bits are set one by one, not as whole rows of bits.
FEW = 256
#: Pairs of two blocks up to which they are sorted instead of marked.
SPARSE = 1_000_000
TASKS = 2_048


def _count(table):
    """Bits of a pair of blocks: who of the left meets whom of the right, counted on both sides."""
    import numpy as np
    import pyarrow as pa

    def lists(name):
        x = table[name].combine_chunks()
        return x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy(zero_copy_only=False)

    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, n = lists("left")
    right, m = lists("right")
    a0, b0 = np.concatenate(([0], np.cumsum(n)[:-1])), np.concatenate(([0], np.cumsum(m)[:-1]))

    def places(part):
        size = n[part].astype(np.int64) * m[part]
        row = np.repeat(part, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return left[a0[row] + at // m[row]].astype(np.int64), right[b0[row] + at % m[row]]

    def counts(*sides):
        keep = [(np.full(int((c > 0).sum()), b), np.flatnonzero(c), c[c > 0]) for b, c in sides]
        block, place, count = (np.concatenate(x) for x in zip(*keep))
        return pa.table({"block": pa.array(block, pa.int32()), "place": pa.array(place, pa.int32()), "n": pa.array(count, pa.int64())})

    if (n.astype(np.int64) * m).sum() <= SPARSE:
        a, b = places(np.arange(len(n)))
        code = np.unique(a << 32 | b)
        a, b = code >> 32, code & 0xFFFFFFFF
        if i == j:
            return counts((i, np.bincount(a[a != b], minlength=1)))
        return counts((i, np.bincount(a)), (j, np.bincount(b)))
    high, wide = int(left.max()) + 1, (int(right.max()) >> 3) + 1
    seen = np.zeros((high, wide), np.uint8)
    small = n.astype(np.int64) * m <= FEW
    for k in np.flatnonzero(~small):
        mine, theirs = left[a0[k] : a0[k] + n[k]], right[b0[k] : b0[k] + m[k]]
        bits = np.zeros(wide * 8, np.uint8)
        bits[theirs] = 1
        bits = np.packbits(bits, bitorder="little")
        seen[mine] |= bits
    rows = np.flatnonzero(small)
    for part in np.array_split(rows, max(1, len(rows) // 65_536)):
        a, b = places(part)
        np.bitwise_or.at(seen.reshape(-1), a * wide + (b >> 3), (1 << (b & 7)).astype(np.uint8))
    if i == j:
        own = np.arange(min(high, wide * 8))
        seen[own, own >> 3] &= ~(1 << (own & 7)).astype(np.uint8)
    by_left = np.bitwise_count(seen).sum(axis=1, dtype=np.int64)
    if i == j:
        return counts((i, by_left))
    by_right = np.zeros(wide * 8, np.int64)
    for s in range(0, high, 1_024):
        by_right += np.unpackbits(seen[s : s + 1_024], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts((i, by_left), (j, by_right))


def neighbour_counts(pairs: DataFrame, item: str, group: str, block: int = BLOCK) -> DataFrame:
    """``(item, neighbours)``: how many other items share a group with each; items without any give no row.

    Items are dealt into blocks of about ``block`` and numbered within them. A group is a list of
    places for each block it has items in, and lists meet by pairs of blocks: what moves is a
    group's items once for each of its blocks, where pairs of items would be its square. A task
    marks the pairs of two blocks as bits, so one that several groups hold counts once.
    """
    rows = pairs.select(F.col(item).alias("item"), F.col(group).alias("group")).where("item is not null and group is not null").distinct()
    rows = materialize(rows)
    items = rows.select("item").distinct()
    blocks = max(1, -(-items.count() // block))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    numbered = materialize(numbered.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1))
    lists = materialize(rows.join(numbered, "item").groupBy("group", "block").agg(F.collect_list("place").alias("places")))  # at most a block's items each
    one = lists.select("group", F.col("block").alias("i"), F.col("places").alias("left"))
    two = lists.select("group", F.col("block").alias("j"), F.col("places").alias("right"))
    met = one.join(two, "group").where("i < j or (i = j and size(left) > 1)").select("i", "j", "left", "right")
    tasks = min(TASKS, blocks * (blocks + 1))
    counted = met.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(_count, "block int, place int, n long")
    total = counted.groupBy("block", "place").agg(F.sum("n").alias("neighbours"))
    return numbered.join(total, ["block", "place"]).select(F.col("item").alias(item), "neighbours")
