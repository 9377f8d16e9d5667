"""N-gram Jaccard join over prefix trees.

A document is the set of its word 5-grams. Two documents link when their Jaccard
similarity is at least 0.75. The join runs in steps that lose no link:

1. Sets become sorted 64-bit hashes; equal sets collapse to the smallest id.
2. Prefix filter in hash order: similar sets share a number of their smallest hashes.
   Only documents that share that many with anyone at all stay candidates; in a normal
   corpus that leaves the near copies and little else.
3. The n-grams of the candidates are put into one global order, rare ones first, by
   their number of candidates. A candidate needs 75 % of its n-grams shared.
4. Candidates that meet under an n-gram of their prefix in that order form clusters,
   and clusters are cut into blocks. Only blocks that share such an n-gram meet, so a
   large group of near copies costs blocks squared, not members squared, in rows.
5. Where two blocks meet, one is stored in a trie of globally ordered n-grams and
   traversed once with all sets of the other: partial overlaps are shared by all sets
   below a node, and a subtree is left by the probes whose overlap cannot reach the
   threshold with the lengths that remain. Of the links found a spanning forest goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import connected_components, discard, materialize, maybe_broadcast

#: Words of an n-gram, and the similarity as a ratio of integers.
N = 5
NUM, DEN = 3, 4
#: Shared hashes that step 2 asks for: one in so many of a set.
SLACK = 12
#: Sets of a block: a task holds two blocks.
BLOCK = 512
#: Rows up to which a table of ids is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Words whose hashes a worker keeps.
CACHE_WORDS = 400_000

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[\x09-\x0D\x20]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd

_words: dict[bytes, int] = {}


def word_list(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    data = text.encode("utf-8", "surrogatepass").translate(_UPPER)
    if b"\x0b" in data or b"\x0c" in data:
        data = _SPACE.sub(b" ", data)
    return data.split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its word n-grams.

    A text of fewer words has its whole sequence as the only one; one without words has
    none. The n-grams of all texts are hashed in one go: a sum of the word hashes with
    an odd factor for each place, mixed.
    """
    global _words
    if len(_words) > CACHE_WORDS:
        _words = {}
    lists = [word_list(t) for t in texts]
    flat = list(chain.from_iterable(lists))
    new = set(flat).difference(_words)
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    total = len(flat)
    h = np.fromiter(map(_words.__getitem__, flat), np.uint64, total)
    acc = np.zeros(max(0, total - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(1)
        for k in range(n):
            factor = factor * _MIX
            acc += h[k : k + len(acc)] * factor
        acc = _mixed(acc)
    out, at = [], 0
    for words in lists:
        m = len(words)
        if m >= n:
            s = np.sort(acc[at : at + m - n + 1])
            fresh = s[1:] != s[:-1]
            out.append(s if fresh.all() else s[np.concatenate([[True], fresh])])
        elif m:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=m)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def least_overlap(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shared n-grams that a set of ``n`` needs for a link with any other set."""
    return -(-n * num // den)


def filter_prefix(n: int) -> tuple[int, int]:
    """``(length, shared)``: of so many smallest hashes, so many must be shared."""
    shared = max(1, n // SLACK)
    return min(n, n - least_overlap(n) + shared), shared


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _batched(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """``(keys, texts)`` of about ``size`` characters; a key is a tuple of the columns before the text."""
    keys: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        *ids, last = batch.columns
        for k in range(batch.num_rows):
            keys.append(tuple(c[k].as_py() for c in ids))
            texts.append(last[k].as_py() or "")
            held += len(texts[-1])
            if held >= size:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two signed longs; the first is its node in the graph."""
    return tuple(_signed(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.uint64)).tolist())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, n, d1, d2, prefix)``: size and 128-bit digest of the set, its smallest hashes.

    ``text_key`` is the ``xxhash64`` of the text, as rows may repeat an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _batched(batches):
            sets = shingle_sets(texts)
            digests = [_digest(s) for s in sets]
            prefixes = [_signed(s[: filter_prefix(len(s))[0]]) for s in sets]
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.int64()) for c in zip(*keys)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["doc_id", "text_key", "n", "d1", "d2", "prefix"],
            )

    texts = _texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return texts.mapInArrow(run, "doc_id long, text_key long, n long, d1 long, d2 long, prefix array<long>")


def set_members(texts: DataFrame) -> DataFrame:
    """``(node, gram)``: the n-grams of the rows ``(node, text)`` whose set has the digest ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _batched(batches):
            sets = [s if _digest(s)[0] == key else s[:0] for (key,), s in zip(keys, shingle_sets(texts))]
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ids = np.repeat(np.array([k for (k,) in keys], np.int64), [len(s) for s in sets])
            for a in range(0, len(values), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a : a + 200_000]), pa.array(_signed(values[a : a + 200_000]))], names=["node", "gram"]
                )

    return texts.select("node", "text").mapInArrow(run, "node long, gram long")


class Trie:
    """A path-compressed prefix tree over sets in global order.

    A node holds a run of ranks, its children and the sets that end in it, and the
    sizes of the smallest and largest set below it.
    """

    __slots__ = ("run", "children", "ends", "low", "high")

    def __init__(self, run: np.ndarray) -> None:
        self.run = run
        self.children: list[Trie] = []
        self.ends: list[int] = []
        self.low = self.high = 0

    @staticmethod
    def build(sets: list[np.ndarray], ids: list[int]) -> "Trie":
        """From sets given as arrays of ranks in ascending order."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        root = Trie(np.zeros(0, np.int64))

        def grow(node: Trie, part: list[int], depth: int) -> None:
            sizes = [len(sets[k]) for k in part]
            node.low, node.high = min(sizes), max(sizes)
            k = 0
            while k < len(part) and len(sets[part[k]]) == depth:
                node.ends.append(ids[part[k]])
                k += 1
            while k < len(part):
                head = sets[part[k]][depth]
                m = k + 1
                while m < len(part) and sets[part[m]][depth] == head:
                    m += 1
                a, b = sets[part[k]], sets[part[m - 1]]  # sorted: the outer two share what all share
                width = min(len(a), len(b)) - depth
                same = np.flatnonzero(a[depth : depth + width] != b[depth : depth + width])
                width = int(same[0]) if len(same) else width
                child = Trie(a[depth : depth + width])
                node.children.append(child)
                stack.append((child, part[k:m], depth + width))
                k = m

        stack = [(root, order, 0)] if order else []
        while stack:
            grow(*stack.pop())
        return root

    def similar(self, probes: list[np.ndarray], num: int = NUM, den: int = DEN) -> Iterator[tuple[int, np.ndarray]]:
        """``(id of a set, positions of the probes)`` with Jaccard similarity of num/den.

        One traversal for all probes. A node adds what its run shares with each probe,
        found in posting lists; the ranks of probes and sets are those of one order.
        """
        size = np.array([len(p) for p in probes], np.int64)
        flat = np.concatenate(probes) if probes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(probes)), size)[order]
        flat = flat[order]
        stack = [(child, 0, np.zeros(len(probes), np.int64)) for child in self.children]
        while stack:
            node, depth, shared = stack.pop()
            low = np.searchsorted(flat, node.run, side="left")
            count = np.searchsorted(flat, node.run, side="right") - low
            total = int(count.sum())
            if total:
                at = np.arange(total) + np.repeat(low - (np.cumsum(count) - count), count)
                shared = shared + np.bincount(owner[at], minlength=len(probes))
            depth += len(node.run)
            best = np.minimum(size, shared + (node.high - depth))
            alive = den * best >= num * (size + max(node.low, depth) - best)
            if not alive.any():
                continue
            if node.ends:
                hit = np.flatnonzero(den * shared >= num * (size + depth - shared))
                if len(hit):
                    for k in node.ends:
                        yield k, hit
            stack += [(child, depth, shared) for child in node.children]


def _forest(links: Iterator[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Links ``(a, [b, ...])`` thinned to a spanning forest of the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for a, others in links:
        ra = find(a)
        for b in others:
            rb = find(b)
            if ra != rb:
                root[rb] = ra
                out.append((a, b))
    return out


def join_blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between and within blocks: for ``pairs(left, right)`` of blocks.

    ``sets(node, block, dfs, grams)``. What comes out has the components of all links of
    each pair of blocks, not each link.
    """
    left = pairs.join(sets.withColumnRenamed("block", "left"), "left").select("left", "right", F.lit(True).alias("probe"), "node", "dfs", "grams")
    right = pairs.join(sets.withColumnRenamed("block", "right"), "right").select("left", "right", F.lit(False).alias("probe"), "node", "dfs", "grams")
    rows = left.unionByName(right.where("left <> right"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        probe = np.array(table.column("probe").to_pylist(), bool)
        grams = table.column("grams").combine_chunks()
        flat = grams.flatten().to_numpy()
        df = table.column("dfs").combine_chunks().flatten().to_numpy()
        cuts = np.cumsum([0, *grams.value_lengths().to_pylist()])
        # Positions in the global order, rare n-grams first, within this pair of blocks.
        unique, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((unique, df[first]))] = np.arange(len(unique))
        ranks = rank[inverse]
        own = [np.unique(ranks[a:b]) for a, b in zip(cuts, cuts[1:])]
        probes = np.flatnonzero(probe)
        stored = probes if probe.all() else np.flatnonzero(~probe)
        trie = Trie.build([own[k] for k in stored], [int(nodes[k]) for k in stored])
        found = trie.similar([own[k] for k in probes])
        ids = nodes[probes]
        edges = _forest((k, ids[hit].tolist()) for k, hit in found)
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("left", "right").applyInArrow(run, "a long, b long")


def candidate_nodes(rows: DataFrame) -> DataFrame:
    """``(node)``: the sets that share enough of their smallest hashes with others.

    ``rows`` are those of :func:`set_rows`, each set once.
    """
    grams = rows.select(F.col("d1").alias("node"), F.explode("prefix").alias("gram"))
    shared = materialize(grams.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "ngram-shared")
    n_shared = grams.join(shared, "gram").groupBy("node").agg(F.count("*").alias("shared"))
    # A partner may have three quarters of the size, and the lesser of both demands holds.
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) / SLACK))
    sizes = rows.select(F.col("d1").alias("node"), "n")
    out = n_shared.join(sizes, "node").where(F.col("shared") >= need).select("node")
    out = materialize(out, "ngram-nodes")
    discard(shared)
    return out


def ordered_sets(texts: DataFrame) -> DataFrame:
    """``(node, n, dfs, grams)`` of the rows ``(node, text)`` that can still link.

    The global order of n-grams is by the number of sets that hold them, then by hash.
    Arrays come unsorted, as each comparison ranks its own n-grams anyway.
    """
    grams = materialize(set_members(texts), "ngram-grams")
    dfs = materialize(grams.groupBy("gram").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "ngram-dfs")
    sizes = grams.groupBy("node").agg(F.count("*").alias("n"))
    shared = grams.join(dfs.select("gram"), "gram").groupBy("node").agg(F.count("*").alias("shared"))
    nodes = shared.join(sizes, "node").where(F.col("shared") >= F.ceil(F.col("n") * NUM / DEN)).select("node", "n")
    nodes = materialize(nodes, "ngram-nodes")
    own = grams.join(maybe_broadcast(nodes, BROADCAST_ROWS), "node").join(dfs, "gram", "left")
    item = F.struct(F.coalesce("df", F.lit(1)).alias("df"), "gram")
    sets = own.groupBy("node", "n").agg(F.collect_list(item).alias("g"))
    out = materialize(sets.select("node", "n", F.col("g.df").alias("dfs"), F.col("g.gram").alias("grams")), "ngram-sets")
    discard(grams)
    return out


def prefix_buckets(sets: DataFrame) -> DataFrame:
    """``(gram, node)``: the shared n-grams in the prefix of every set in the global order."""
    items = F.array_sort(F.arrays_zip("dfs", "grams"))
    length = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    rows = sets.select("node", F.slice(items, 1, length.cast("int")).alias("g"))
    rows = rows.select("node", F.explode("g").alias("g")).where("g.dfs > 1")
    return rows.select(F.col("g.grams").alias("gram"), "node")


def link_sets(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(id, component_id)`` of the sets that link to another one, by node."""
    buckets = materialize(prefix_buckets(sets), "ngram-buckets")
    heads = materialize(buckets.groupBy("gram").agg(F.count("*").alias("k"), F.min("node").alias("head")).where("k > 1").select("gram", "head"), "ngram-heads")
    buckets = materialize(buckets.join(heads, "gram"), "ngram-met")
    stars = buckets.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    clusters = materialize(connected_components(stars, "ngram-cc"), "ngram-clusters")

    # Small clusters share blocks; large ones are cut, neighbours under one n-gram together.
    home = buckets.groupBy("node").agg(F.min("head").alias("home"))
    size = clusters.groupBy(F.col("component_id").alias("cluster")).agg(F.count("*").alias("k"))
    nodes = clusters.select(F.col("id").alias("node"), F.col("component_id").alias("cluster")).join(size, "cluster").join(home, "node")
    small = nodes.where(F.col("k") <= block // 2)
    n_blocks = max(1, -(-small.count() // block))
    small = small.select("node", F.pmod(F.xxhash64("cluster"), F.lit(n_blocks)).cast("string").alias("block"))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy("home", "node"))
    large = nodes.where(F.col("k") > block // 2).withColumn("r", order)
    part = F.floor((F.col("r") - 1) / block).cast("string")
    large = large.select("node", F.concat_ws(":", F.col("cluster").cast("string"), part).alias("block"))
    where = materialize(small.unionByName(large), "ngram-where")

    # Blocks that share an n-gram of prefixes; each block also meets itself.
    at = buckets.select("gram", "node").join(where.where(F.contains("block", F.lit(":"))), "node").select("gram", "block").distinct()
    several = at.groupBy("gram").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("gram")
    at = materialize(at.join(several, "gram"), "ngram-at")
    other = at.select("gram", F.col("block").alias("right"))
    pairs = at.select("gram", F.col("block").alias("left")).join(other, "gram").where("left < right").select("left", "right").distinct()
    own = where.select(F.col("block").alias("left")).distinct().withColumn("right", F.col("left"))
    pairs = materialize(pairs.unionByName(own), "ngram-pairs")
    placed = materialize(sets.select("node", "dfs", "grams").join(where, "node"), "ngram-placed")
    links = materialize(join_blocks(pairs, placed), "ngram-links")
    out = materialize(connected_components(links, "ngram-cc"), "ngram-groups")
    for t in (buckets, heads, clusters, where, at, pairs, placed, links):
        discard(t)
    return out


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, n, label)`` for every row: rows of one label are one component.

    The label of a row without a set, ``n`` being 0, means nothing.
    """
    texts = _texts(docs, id_col, text_col)
    rows = materialize(set_rows(docs, id_col, text_col), "ngram-rows")
    equal = rows.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    equal = materialize(equal, "ngram-equal")
    # Of several equal sets one goes on: one row of the least id.
    extra = equal.where("copies > 1").select("d1", "rep")
    lone = rows.where("n > 0").join(maybe_broadcast(extra, BROADCAST_ROWS), "d1", "left_anti").select("d1", "n", "prefix")
    many = rows.join(maybe_broadcast(extra, BROADCAST_ROWS), "d1").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    many = many.groupBy("d1").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = candidate_nodes(lone.unionByName(many))
    wanted = nodes.join(equal.select(F.col("d1").alias("node"), "rep"), "node").select("node", "rep")
    wanted = maybe_broadcast(materialize(wanted, "ngram-wanted"), BROADCAST_ROWS)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    groups = link_sets(ordered_sets(found))

    labelled = rows.select("doc_id", "text_key", "n", "d1").join(groups.withColumnRenamed("id", "d1"), "d1", "left")
    return labelled.select("doc_id", "text_key", "n", F.coalesce("component_id", "d1").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that is reachable by links. A null or empty
    text, or one of white space, has an empty set, links to nothing and is its own
    component. A null id stays null and never is the smallest one while its component
    has another. Repeated rows give repeated results; an empty table gives none; other
    columns are ignored.
    """
    labelled = labelled_rows(docs, id_col, text_col)
    least = labelled.where("n > 0").groupBy("label").agg(F.count("*").alias("k"), F.min("doc_id").alias("least")).where("k > 1")
    least = materialize(least.select("label", "least"), "ngram-least")
    own = labelled.join(least, (labelled["label"] == least["label"]) & (labelled["n"] > 0), "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id, null ids last.

    Rows are told apart by id and text, so a text that stands alone stays whatever other
    rows have its id; of rows that repeat both one stays. Null and empty texts, and those
    of white space, are no copies of anything and all stay. All columns of ``docs`` stay,
    whatever their names.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    rows = labelled_rows(docs, id_col, text_col).where("n > 0").select("label", "doc_id", "text_key")
    groups = materialize(rows.groupBy("label").agg(F.count("*").alias("k"), F.min(rank).alias("r")).where("k > 1"), "near-groups")
    first = F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("text_key") == F.col("r.text_key"))
    own = rows.join(groups.select("label", "r"), "label").select("doc_id", "text_key", first.alias("first"))
    own = own.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("first").alias("first")).where("not first or rows > 1")
    own = materialize(own, "near-gone").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("first").alias("__first"))
    here = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__key"))
    rest = docs.join(maybe_broadcast(own.select("__id", "__key"), BROADCAST_ROWS), here, "left_anti")
    # Rows that repeat the id and the text of the one that stays: any of them.
    again = own.where("__first").select("__id", "__key")
    if again.isEmpty():
        return rest.select(*docs.columns)
    again = docs.join(maybe_broadcast(again, BROADCAST_ROWS), here).dropDuplicates(["__id", "__key"])
    return rest.select(*docs.columns).unionByName(again.select(*docs.columns))
