"""Benchmark decontamination by spaced-seed hashing, in SQL functions alone.

A mask selects some positions of a window of words and ignores the others, so a
substituted word at an ignored position leaves the hash as it is. The hashes of all
windows of the training texts are joined with those of the benchmark; around every hit
the two texts are laid over each other on that diagonal and compared word by word. The
best segment there counts: each equal word adds one, each substituted one takes half
away. So quotes of a part of a passage are found, and an inserted word costs no more
than the rest of the segment on its shorter side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, maybe_broadcast

#: Fixed masks: 1 selects a word, 0 ignores it.
MASKS = ("1101011", "11100101")
#: What a substituted word takes from the score of a segment.
SUBSTITUTION = 0.5
#: Score of a segment, at least; of a shorter passage all words must be equal.
MIN_SCORE = 10.0
#: Words of a passage, at least. Passages of fewer words than a mask are looked for as
#: they are; still shorter ones are phrases of everyday use.
MIN_WORDS = 4
#: Rows up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case words of ``text`` without ASCII punctuation; empty for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.filter(parts, lambda w: w != "")


def seed_hashes(hashed: Column, mask: str) -> Column:
    """``struct(at, seed)`` of every window of the mask over an array of word hashes."""
    picked = [k for k, c in enumerate(mask) if c == "1"]
    n = F.size(hashed) - len(mask) + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(mask), *[F.get(hashed, i + k) for k in picked]).alias("seed")),
    )


def _seeds(df: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """A row for each window of each mask: the columns of ``keep``, ``at`` and ``seed``."""
    hashed = df.select(*keep, F.transform(F.col("words"), lambda w: F.xxhash64(w)).alias("h"))
    all_masks = F.concat(*[seed_hashes(F.col("h"), m) for m in masks])
    return hashed.select(*keep, F.explode(all_masks).alias("s")).select(*keep, "s.at", "s.seed")


def passages(benchmark: DataFrame, min_words: int = MIN_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, item_words)`` of the passages that are long enough to be looked for."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), words(benchmark[text_col].cast("string")).alias("words"))
    return rows.where(F.size("words") >= min_words).select("item_id", F.col("words").alias("item_words"))


def _best_segment(equal: Column) -> Column:
    """``(score, start, end, matched)`` of the best run of an array of booleans.

    Of runs of one score the first one, and of those the shortest: the sum so far starts
    anew wherever it would not be positive.
    """
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("hits"),
        F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("matched"),
    )

    def step(x: Column, same: Column) -> Column:
        fresh = x["sum"] <= 0
        total = F.when(fresh, 0.0).otherwise(x["sum"]) + F.when(same, 1.0).otherwise(-SUBSTITUTION)
        begin = F.when(fresh, x["at"]).otherwise(x["from"])
        hits = F.when(fresh, 0).otherwise(x["hits"]) + same.cast("int")
        better = total > x["score"]
        return F.struct(
            (x["at"] + 1).alias("at"), total.alias("sum"), begin.alias("from"), hits.alias("hits"),
            F.when(better, total).otherwise(x["score"]).alias("score"), F.when(better, begin).otherwise(x["start"]).alias("start"),
            F.when(better, x["at"] + 1).otherwise(x["end"]).alias("end"), F.when(better, hits).otherwise(x["matched"]).alias("matched"),
        )

    return F.aggregate(equal, zero, step)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_score: float = MIN_SCORE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_key, item_id, start_word, matched, overlap, item_words, share)`` of the overlaps.

    One row for each text and passage, the best segment of their diagonals: ``overlap``
    words of the passage from the ``start_word`` of the text on, ``matched`` of them
    equal, ``share`` being their ratio. It scores ``min_score`` or, if the passage has
    fewer words, matches it whole. Passages under ``min_words`` words are not looked for.
    ``text_key`` is the ``xxhash64`` of the text, as rows may repeat an id; rows that
    repeat both are one. Null and empty texts match nothing; null ids stay null; an empty
    table on either side gives none; other columns are ignored. Both sides of the first
    join are rows of hashes: the benchmark's are broadcast up to ``BROADCAST_ROWS`` and
    shuffled beyond, and texts are read again only for the hits.
    """
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    items = passages(benchmark, min_words)
    # Lengths of passages that are shorter than a mask: a few small numbers.
    shortest = min(map(len, masks))
    short = sorted(r[0] for r in items.where(F.size("item_words") < shortest).select(F.size("item_words")).distinct().collect())
    wanted = _seeds(items.select("item_id", F.col("item_words").alias("words")), ["item_id"], masks)
    rows = texts.select("doc_id", "text_key", words(F.col("text")).alias("words"))
    seeds = _seeds(rows, ["doc_id", "text_key"], masks + tuple("1" * n for n in short))
    if short:
        whole = items.where(F.size("item_words") < shortest).select("item_id", F.col("item_words").alias("words"))
        for n in short:
            wanted = wanted.unionByName(_seeds(whole.where(F.size("words") == n), ["item_id"], ("1" * n,)))
    wanted = wanted.select("item_id", F.col("at").alias("item_at"), "seed")
    hits = seeds.join(maybe_broadcast(wanted, BROADCAST_ROWS), "seed")
    hits = hits.select("doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = materialize(hits, "seed-hits")

    # Texts of the hits only, cut to the parts that lie over the passages.
    found = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    own = texts.join(maybe_broadcast(found, BROADCAST_ROWS), here).dropDuplicates(["doc_id", "text_key"])
    own = own.select("hit_id", "hit_key", words(F.col("text")).alias("words"))
    rows = hits.join(items, "item_id").join(own, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    n_item = F.size("item_words")
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    over = F.greatest(F.lit(0), F.least(n_item, F.size("words") - F.col("diagonal")) - low)
    rows = rows.select(
        "doc_id",
        "text_key",
        "item_id",
        n_item.alias("item_words"),
        (F.col("diagonal") + low).alias("begin"),
        F.slice("words", F.col("diagonal") + low + 1, over).alias("doc_part"),
        F.slice("item_words", low + 1, over).alias("item_part"),
    )
    equal = F.zip_with("doc_part", "item_part", lambda a, b: a == b)
    rows = rows.select("doc_id", "text_key", "item_id", "item_words", "begin", _best_segment(equal).alias("s"))
    rows = rows.where(F.col("s.score") >= F.least(F.lit(min_score), F.col("item_words").cast("double")))
    best = F.max_by(F.struct("begin", "item_words", "s"), F.struct("s.score", -(F.col("begin") + F.col("s.start"))))
    rows = rows.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select("doc_id", "text_key", "item_id", "b.*")
    overlap = F.col("s.end") - F.col("s.start")
    return rows.select(
        "doc_id",
        "text_key",
        "item_id",
        (F.col("begin") + F.col("s.start")).cast("long").alias("start_word"),
        F.col("s.matched").cast("long").alias("matched"),
        overlap.cast("long").alias("overlap"),
        F.col("item_words").cast("long").alias("item_words"),
        F.round(F.col("s.matched") / overlap, 6).alias("share"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps a passage.

    Rows are told apart by id and text, so of a repeated or null id the others stay, as
    do null and empty texts. All columns of ``docs`` stay, whatever their names.
    """
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    here = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__key"))
    return docs.join(maybe_broadcast(materialize(bad, "leaks"), BROADCAST_ROWS), here, "left_anti")
