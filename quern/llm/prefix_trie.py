"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a 128-bit digest: the exclusive
or of the digests of (position, turn), which running sums give for all depths at once,
and which tells the parent's key by taking off the last turn. Counts of leaves and
savings then go up the edges in rounds of doubling: in round k every node gives what it
has gathered to its 2^k-th ancestor and takes that one's pointer, so a trie of depth d
needs log2(d) rounds, not d.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize

#: Conversations share the head of the first of each group of so many ids ...
GROUP = 100
#: ... of less than this many turns, by the hash of the id.
HEADS = 6
#: Ids of one run of so many (as a power of two) are joined to one text before they are hashed.
RUN_BITS = 12


def _half(digest: Column, part: int) -> Column:
    """The first or second 64 bits of a hexadecimal digest, signed."""
    return F.conv(F.substring(digest, 1 + 16 * part, 16), 16, -10).cast("long")


def turn_key(role: Column, text: Column) -> Column:
    """What tells turns apart: a 128-bit digest of role and text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ordered_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, block, seq, key, chars)``: the turns in order, texts as digests and lengths.

    ``seq`` rises along each conversation, ordered by turn, null first, and among equal
    turns by ``key``. Ranges of the whole order are dealt to tasks, so a very long
    conversation spans many; ``block`` is the range. Rows with a null conversation are
    no conversation and are left out; null roles and texts are empty.
    """
    role, text = (F.coalesce(convs[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = convs.where(convs[conv_col].isNotNull()).select(
        convs[conv_col].cast("long").alias("conv_id"), convs[turn_col].alias("turn"), turn_key(role, text).alias("key"), F.char_length(text).alias("chars")
    )
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("conv_id", F.shiftright("seq", 33).cast("int").alias("block"), "seq", "key", "chars")


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """``(conv_id, block, *sums)``: the aggregates over the blocks of the conversation before this one."""
    totals = rows.groupBy("conv_id", "block").agg(*[v.alias(k) for k, v in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda k: F.sum(k) if k == "n" else F.bit_xor(k)
    return totals.select("conv_id", "block", *[F.coalesce(of(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in sums])


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``turns`` of :func:`ordered_turns` with their rank in the conversation, from 1."""
    in_block = Window.partitionBy("conv_id", "block").orderBy("seq")
    rows = turns.withColumn("at", F.row_number().over(in_block))
    rows = rows.join(_before(turns, n=F.count("*")), ["conv_id", "block"])
    return rows.select("conv_id", "block", (F.col("at") + F.col("n_before")).alias("rank"), "key", "chars")


def rebuilt_turns(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``(conv_id, block, pos, key, chars)`` of the rebuilt conversations, position 0 for each as such.

    Conversation c takes its first h turns, h being crc32(c) mod ``heads``, from the
    conversation whose id is c without its remainder by ``group`` (fewer if that has
    fewer, none if it is absent), and its own turns after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    firsts = ranked_turns(turns.where(F.col("conv_id") % group == 0)).where(F.col("rank") < heads)
    head = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "chars"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = ranked_turns(turns).withColumn("base", base).join(head, "base", "left").withColumn("h", h)
    shared = F.slice(F.coalesce(F.col("head"), F.array().cast("array<struct<rank:bigint,key:string,chars:int>>")), F.lit(1), F.col("h"))
    own = own.withColumn("shared", shared)
    row = lambda block, pos, key, chars: F.struct(block.cast("int").alias("block"), pos.cast("long").alias("pos"), key.alias("key"), chars.alias("chars"))
    kept = F.when(F.col("rank") > F.col("h"), F.array(row(F.col("block"), F.col("rank") - F.col("h") + F.size("shared"), F.col("key"), F.col("chars"))))
    start = F.concat(F.array(row(F.lit(-1), F.lit(0), F.lit(""), F.lit(0))), F.transform("shared", lambda x: row(F.lit(-1), x["rank"], x["key"], x["chars"])))
    none = F.array().cast("array<struct<block:int,pos:bigint,key:string,chars:int>>")
    rows = F.concat(F.coalesce(kept, none), F.when(F.col("rank") == 1, start).otherwise(none))
    return own.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")


def prefix_digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, chars, x1, x2, p1, p2)``: the node of each prefix and that of its parent.

    ``rows(conv_id, block, pos, key, chars)`` have positions from 0, the root, without
    gaps, and blocks that rise with them; a task holds a block, never a conversation.
    """
    own = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("key")).cast("binary"))
    at_root = F.col("pos") == 0
    rows = rows.withColumn("own", own).select(
        "conv_id", "block", "pos", "chars", *[F.when(at_root, F.lit(0)).otherwise(_half(F.col("own"), k)).cast("long").alias(f"h{k + 1}") for k in (0, 1)]
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("r1", F.bit_xor("h1").over(so_far)).withColumn("r2", F.bit_xor("h2").over(so_far))
    out = out.join(_before(rows, h1=F.bit_xor("h1"), h2=F.bit_xor("h2")), ["conv_id", "block"])
    x1, x2 = F.col("r1").bitwiseXOR(F.col("h1_before")), F.col("r2").bitwiseXOR(F.col("h2_before"))
    up = lambda x, h: F.when(F.col("pos") > 0, x.bitwiseXOR(F.col(h)))
    return out.select("conv_id", "pos", "chars", x1.alias("x1"), x2.alias("x2"), up(x1, "h1").alias("p1"), up(x2, "h2").alias("p2"))


def roll_up(nodes: DataFrame) -> DataFrame:
    """``(x1, x2, n_leaves, saved)`` over each node's subtree.

    ``nodes(x1, x2, depth, p1, p2, leaves, saved)`` bring their own values; the root has
    depth 0 and no parent. Sums are combined before the shuffle, so an ancestor of very
    many nodes gets one row from each task; only nodes whose pointer's target has a
    pointer itself look it up, and the join may be split where many point to one node.
    """
    now = materialize(nodes.select("x1", "x2", "depth", F.col("p1").alias("j1"), F.col("p2").alias("j2"), "leaves", "saved"), "trie-round")
    deepest = now.agg(F.max("depth")).head()[0] or 0
    step = 1
    while step <= deepest:
        given = now.where(F.col("depth") >= step).groupBy(F.col("j1").alias("x1"), F.col("j2").alias("x2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("much"))
        added = now.join(given, ["x1", "x2"], "left").select(
            "x1", "x2", "depth", "j1", "j2", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("much", F.lit(0))).alias("saved")
        )
        far, near = added.where(F.col("depth") >= 2 * step), added.where(F.col("depth") < 2 * step)
        aims = now.where(F.col("depth") >= step).select(F.col("x1").alias("t1"), F.col("x2").alias("t2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        far = far.join(aims, (F.col("j1") == F.col("t1")) & (F.col("j2") == F.col("t2"))).select("x1", "x2", "depth", F.col("n1").alias("j1"), F.col("n2").alias("j2"), "leaves", "saved")
        none = F.lit(None).cast("long")
        near = near.select("x1", "x2", "depth", none.alias("j1"), none.alias("j2"), "leaves", "saved")
        after = materialize(far.unionByName(near), "trie-round")
        discard(now)
        now, step = after, step * 2
    return now.select("x1", "x2", F.col("leaves").alias("n_leaves"), "saved")


def _ends(last: DataFrame) -> DataFrame:
    """``(x1, x2, ends_sha256)`` from ``last(conv_id, x1, x2)``: the ids in order, hashed.

    Ids of a run become one text first, before the shuffle where tasks hold several. A node
    with one run is hashed as it is; the runs of the others go through a running hash in
    order, a node in one task, as SHA-256 asks, but never in memory at once.
    """
    run = F.shiftright("conv_id", RUN_BITS).alias("run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = last.groupBy("x1", "x2", run).agg(text.alias("ids"))
    runs = materialize(runs, "trie-ends")
    several = runs.groupBy("x1", "x2").agg(F.count("*").alias("n")).where("n > 1").select("x1", "x2")
    one = runs.join(several, ["x1", "x2"], "left_anti").select("x1", "x2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = runs.join(several, ["x1", "x2"], "left_semi").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "run").select("x1", "x2", "ids")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        pack = lambda: pa.RecordBatch.from_pylist([{"x1": node[0], "x2": node[1], "ends_sha256": state.hexdigest()}], schema=pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())]))
        for batch in batches:
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node:
                    if node is not None:
                        yield pack()
                    node, state = (a, b), sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield pack()

    return one.unionByName(many.mapInArrow(chained, "x1 long, x2 long, ends_sha256 string"))


def conversation_trie(convs: DataFrame, group: int = GROUP, heads: int = HEADS, **columns: str) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations, with their subtree sums.

    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: ``conv_id`` is the smallest member of a node, a member
    being a conversation that begins with its turns; ``saved_tokens`` sums (members - 1)
    times the code points of the last text over the subtree; ``ends_sha256`` hashes the
    ids of the members that end there. Turns are ordered by ``turn``, null first, then by
    ``turn_key``; repeated rows are turns of their own; null roles and texts are empty;
    rows with a null conversation are left out; an empty table has no nodes; other
    columns are ignored, whatever their names.
    """
    turns = materialize(ordered_turns(convs, **columns), "trie-turns")
    rows = materialize(rebuilt_turns(turns, group, heads), "trie-rows")
    paths = materialize(prefix_digests(rows), "trie-paths")
    discard(rows)
    nodes = paths.groupBy("x1", "x2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars")
    )
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "trie-children")
    sums = roll_up(
        nodes.select("x1", "x2", "depth", "p1", "p2", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    )
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("x1", "x2"), "pos").alias("x")).select("conv_id", "x.*")
    out = nodes.join(sums, ["x1", "x2"]).join(_ends(last), ["x1", "x2"], "left")
    parents = nodes.where("n_children > 0").select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(parents, ["p1", "p2"], "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
