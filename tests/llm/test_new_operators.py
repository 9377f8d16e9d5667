"""Fill-in-middle, conversation trie and sharding against brute force, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import fill_in_middle as fim
from quern.llm import prefix_trie, quality_crf, queries, shard_shuffle

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def nulls_first(rows):
    return sorted(tuple((v is not None, v if v is not None else 0) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert nulls_first(got.select(order).collect()) == nulls_first(want.select(", ".join(order)).fetchall())


def test_training_rows_are_bounded_by_rows(spark):
    """Ids that repeat thousands of times give one training row each."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.range(8000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    rows = quality_crf.training_rows(docs, labels).collect()
    kept = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(r.doc_id for r in rows) == sorted(kept)
    assert len(quality_crf.training_rows(docs, labels, max_docs=7).collect()) == 7


# --- fill in the middle --------------------------------------------------------------------
def plain_transform(text: str, key: str):
    h = [int(hashlib.sha256(key.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<PSM> \né߀中🙂́\x7f"), max_size=60), st.integers(-5, 10_000))
def test_fim_of_any_text(text, key):
    n, form, prefix, middle, out = fim.transform(text.encode(), f"1:{key}")
    assert (n, form, prefix, middle, out.decode()) == plain_transform(text, f"1:{key}")
    assert fim.restore(out, form) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.data())
def test_select_bit(data, draw):
    mask = int.from_bytes(data, "big")
    at = [i for i in range(8 * len(data)) if mask >> i & 1]
    assert mask.bit_count() == len(at)
    if at:
        rank = draw.draw(st.integers(0, len(at) - 1))
        assert fim.select_bit(mask, 8 * len(data), rank) == at[rank]


def test_units():
    bits = lambda m, n: [i for i in range(n) if m >> i & 1]
    assert bits(fim.unit_starts(b"ab, cd\n e", "word"), 9) == [0, 4, 8]
    assert bits(fim.unit_starts(b", cd", "word"), 4) == [0, 2]
    assert bits(fim.unit_starts(b"a\n\nb\n", "line"), 5) == [0, 2, 3]
    assert bits(fim.unit_starts(b"a\x80\xc3\xa9\xa9", "char"), 5) == [0, 1, 2, 4]  # stray bytes count for themselves
    assert fim.unit_starts(b"") == 0
    with pytest.raises(ValueError):
        fim.unit_starts(b"a", "page")


ODD = [(1, None), (None, "a text with a null id"), (None, None), (2, ""), (3, "holds <M> itself"), (4, "x中" * 200_000), (5, "same"), (5, "same"), (6, "<"), (7, "<S"), (-8, "é\n" * 40)]


def test_fim_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("n", "form", "output", "key", "prefix_units"):
        df = df.withColumn(c, F.lit("x"))
    got = fim.restored(fim.fill_in_middle(df)).collect()
    rows = sorted(((r.doc_id is None, r.doc_id or 0), r.n, r.form, r.prefix_units, r.middle_units, r.output.decode()) for r in got)
    assert rows == sorted(((i is None, i or 0), *plain_transform(t or "", f"1:{'' if i is None else i}")) for i, t in ODD)
    assert sorted(r.text.decode() for r in got) == sorted(t or "" for _, t in ODD)
    assert fim.restored(fim.fill_in_middle(df.limit(0))).count() == 0


# --- conversation trie ----------------------------------------------------------------------
def brute_trie(rows, group=100, heads=6):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0, key), role, text))
    by = {c: [v[1:] for v in sorted(rows)] for c, rows in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = abs(c) % group * (1 if c >= 0 else -1)
        built[c] = tuple(by.get(c - rest, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not kids[node]
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), up, len(who), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_of_odd_conversations(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, "user", "null turns come first"), (7, 0, "user", None), (-130, 2, "user", "negative"), (-131, 1, "a", "negative")]
    for c in [*range(0, 40), *range(100, 140), *range(201, 260), 5003]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 40])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "so", "", "中文", "no " * 50])))
    rows += rows[50:60]  # repeated rows are turns of their own
    rows += [(100, t, "user", "hi") for t in range(1000, 1300)]  # a long one
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("block", "rank", "key", "head", "depth", "base", "n"):
        df = df.withColumn(c, F.lit("x"))
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 4)  # so that ids of one node fall into many runs
    got = prefix_trie.conversation_trie(df)
    assert nulls_first(got.collect()) == nulls_first(brute_trie(rows))
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_trie_of_one_conversation_over_many_blocks(spark, request):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    request.addfinalizer(lambda: spark.conf.unset(name))
    rows = [(0, t, "user", str(t % 7)) for t in range(600)] + [(1, t, "user", str(t % 7)) for t in range(650)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.ordered_turns(df)
    assert turns.where("conv_id = 1").select("block").distinct().count() > 1
    assert nulls_first(prefix_trie.conversation_trie(df).collect()) == nulls_first(brute_trie(rows))


def test_trie_of_equal_conversations(spark):
    rows = [(c, t, "user", "the same") for c in range(300) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.conversation_trie(df, group=1, heads=1)
    assert nulls_first(got.collect()) == nulls_first(brute_trie(rows, 1, 1)) and got.count() == 4


# --- sharding ---------------------------------------------------------------------------------
def check_shards(rows, n, shards=16):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == n and set(by) <= set(range(shards))
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shard_shuffle.shard_digests(shard_shuffle.shuffle_shards(docs)).collect()
    check_shards(rows, docs.count())
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    again = shard_shuffle.shuffle_shards(docs.repartition(5)).select("doc.doc_id", "shard", "slot").collect()
    assert {tuple(r) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    other = shard_shuffle.shuffle_shards(docs, seed=2).select("doc.doc_id", "shard", "slot").collect()
    assert sum((r.doc_id, r.shard, r.slot) in {(x.doc_id, x.shard, x.slot) for x in rows} for r in other) < 20


def test_shuffle_is_uniform(spark):
    """Rows of 20 ids over 400 seeds: each id lands in each shard equally often, next to each other as often as chance has it."""
    docs = spark.range(400 * 20).select(F.col("id").alias("doc_id"), (F.col("id") % 20).cast("string").alias("text"))
    rows = shard_shuffle.shuffle_shards(docs, shards=10, min_buckets=40).select("doc.doc_id", "doc.text", "shard", "slot").collect()
    check_shards(rows, 8000, 10)
    count = collections.Counter((r.text, r.shard) for r in rows)
    chi = sum((count[str(a), b] - 40) ** 2 / 40 for a in range(20) for b in range(10))
    assert chi < 171 + 5 * (2 * 171) ** 0.5
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert abs(rises - 3999.5) < 5 * (8000 / 12) ** 0.5


def test_shards_of_odd_rows(spark):
    rows = ODD + [(9, "hot")] * 3000 + [(None, "hot")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("bucket", "pos", "shard", "slot", "place", "d1", "at", "h1"):
        df = df.withColumn(c, F.lit("x"))
    out = shard_shuffle.shuffle_shards(df, bucket_bytes=20_000)
    got = out.collect()
    check_shards(got, len(rows))
    assert collections.Counter((r.doc.doc_id, r.doc.text) for r in got) == collections.Counter(rows)
    assert got[0].doc.bucket == "x"
    # copies of one row do not meet in one bucket: all shards have their part
    hot = collections.Counter(r.shard for r in got if r.doc.doc_id == 9)
    assert len(hot) == 16 and max(hot.values()) < 300
    assert shard_shuffle.shard_digests(shard_shuffle.shuffle_shards(df.limit(0))).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("slot", F.lit("mine"))
    shard_shuffle.write_shards(df, f"file://{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    check_shards(back.collect(), len(ODD), 3)
    assert {r.source_slot for r in back.collect()} == {"mine"}
