"""Substring dedup by hashing units of lines.

Every line is cut at sentence ends into units, and long sentences after words that their
own hashes choose, so that copies are cut alike wherever they stand. Each unit is hashed,
the digests are grouped over the whole corpus, the earliest ranked occurrence of
each digest stays, and the others are removed where they make up their whole line or stand
in a run of some length. Removed units keep their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: Words in a run of removed units that is not a whole line, at least.
MIN_RUN_WORDS = 20
#: Words of a line that goes because all its units repeat, at least.
MIN_LINE_WORDS = 1
#: Sentences of more words are cut after every word whose hash ends in ``CUT_BITS`` zeros,
#: so a passage that was pasted into the middle of a sentence loses few words at its ends.
LONG_SENTENCE = 12
CUT_BITS = 2
#: A unit of fewer words takes in the next one of its line.
MIN_UNIT_WORDS = 4

_SENTENCE_END = re.compile(r"[.!?][^\S\n]+")
_WORD = re.compile(r"(\S+)\s*")


def _sentence_cuts(line: str) -> list[int]:
    """Ends of the sentences of ``line`` and, in long ones, of the words chosen by hash."""
    ends = [m.end() for m in _SENTENCE_END.finditer(line)]
    if not ends or ends[-1] != len(line):
        ends.append(len(line))
    out, begin = [], 0
    for end in ends:
        words = list(_WORD.finditer(line, begin, end))
        if len(words) > LONG_SENTENCE:
            out += [m.end() for m in words[:-1] if crc32(m[1].lower().encode()) & ((1 << CUT_BITS) - 1) == 0]
        out.append(end)
        begin = end
    return out


SCHEMA = "doc_id long, row long, line int, unit int, start long, length long, words int, d1 long, d2 long"


def split_units(text: str, min_words: int = MIN_UNIT_WORDS) -> list[tuple[int, int, int, int, str]]:
    """``(line, start, length, words, normalised form)`` of the units of ``text``.

    Offsets are code points. A unit never crosses a line; lower case and single
    spaces make the normalised form; units without a word are left out.
    """
    out = []
    at = 0
    for number, line in enumerate(text.split("\n")):
        begin = 0
        cuts = _sentence_cuts(line)
        for k, end in enumerate(cuts):
            words = line[begin:end].lower().split()
            if len(words) < min_words and k + 1 < len(cuts):
                continue
            if words:
                out.append((number, at + begin, end - begin, len(words), " ".join(words)))
            begin = end
        at += len(line) + 1
    return out


def hashed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit of each document, with a 128-bit digest in two columns.

    ``row`` numbers the rows of ``docs`` in the order in which they are read.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names]
        ids, row, line, unit, start, length, words, d1, d2 = cols

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            for c in cols:
                c.clear()
            return batch

        for batch in batches:
            keys, rows, texts = batch.columns
            for k in range(batch.num_rows):
                key, number = keys[k].as_py(), rows[k].as_py()
                for n, (at, s, size, w, norm) in enumerate(split_units(texts[k].as_py() or "")):
                    digest = blake2b(norm.encode(), digest_size=16).digest()
                    ids.append(key)
                    row.append(number)
                    line.append(at)
                    unit.append(n)
                    start.append(s)
                    length.append(size)
                    words.append(w)
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(ids) >= 50_000:
                    yield out()
        if ids:
            yield out()

    picked = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("text")
    )
    return picked.mapInArrow(run, SCHEMA)


def duplicate_units(
    docs: DataFrame,
    min_run_words: int = MIN_RUN_WORDS,
    min_line_words: int = MIN_LINE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The units to remove: ``(doc_id, row, unit, start, length, words, keep_doc_id, keep_unit)``.

    The occurrence with the smallest (doc_id, row, unit) of each digest stays, ``row``
    being the number of the row as it is read, so rows that repeat an id, or have none,
    are documents of their own. Another occurrence goes if all units of its line repeat
    and the line has ``min_line_words`` words or more, or if it and the removable units
    right before and after it have ``min_run_words`` words or more together. With the
    defaults every repeated line goes, and of other repeats those of some length. A null
    or empty text has no units; null ids rank first; an empty table gives an empty
    result; other columns are ignored. Counts per digest are combined before the shuffle
    and the join back is one that the engine may split, so one very common unit does not
    land in one task; the windows are each over one document.
    """
    units = materialize(hashed_units(docs, id_col, text_col), "units")
    first = (
        units.groupBy("d1", "d2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "unit")).alias("first"))
        .where("n > 1")
        .select("d1", "d2", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.row").alias("keep_row"), F.col("first.unit").alias("keep_unit"))
    )
    first = materialize(first, "first-units")
    same = (F.col("row") == F.col("keep_row")) & (F.col("unit") == F.col("keep_unit"))
    rest = units.join(first, ["d1", "d2"]).where(~same).drop("d1", "d2")
    by_doc = Window.partitionBy("row").orderBy("unit")
    rest = rest.withColumn("island", F.col("unit") - F.row_number().over(by_doc))
    rest = rest.withColumn("run_words", F.sum("words").over(Window.partitionBy("row", "island")))
    goes = F.col("run_words") >= min_run_words
    if min_line_words < min_run_words:
        # A line goes whole if no unit of it is left out: the units of a line are numbered
        # in one run, from that of its first unit to that of its last.
        of_line = Window.partitionBy("row", "line")
        ends = units.groupBy("row", "line").agg(F.count("*").alias("line_units"))
        rest = rest.withColumn("gone", F.count("*").over(of_line)).withColumn("line_words", F.sum("words").over(of_line))
        rest = rest.join(ends, ["row", "line"])
        goes = goes | ((F.col("gone") == F.col("line_units")) & (F.col("line_words") >= min_line_words))
    return rest.where(goes).select("doc_id", "row", "unit", "start", "length", "words", "keep_doc_id", "keep_unit")
