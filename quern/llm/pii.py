"""PII: pattern detection and information-theoretic sanitisation.

Patterns find the protected entities. Corpus co-occurrence then estimates how much a
term tells about an entity. The events are the pieces of all lines of all texts: a line,
or each run of ``PIECE_TERMS`` terms of a longer one. Every count is one of pieces, copies
included: those that hold the term, the entity, both, and all of them. A term t discloses
an entity e when the pointwise mutual information ``log2(p(t | e) / p(t))``, smoothed
towards independence, reaches a given share of the information content ``-log2 p(e)`` of
the entity. Disclosing terms are generalised like the entities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, maybe_broadcast

KINDS = ("email", "ip", "card", "phone", "term")

#: Share of the entity's information content from which a term discloses it.
DISCLOSURE = 0.8
#: Pieces without any link between term and entity that are added to those of an entity,
#: so one shared piece tells less than many.
SMOOTHING = 2.0
#: Terms of a piece.
PIECE_TERMS = 64
#: Counts that a worker holds before it hands them on.
HELD_COUNTS = 200_000
#: Rows up to which a table of terms is sent to all workers.
BROADCAST_ROWS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, each character looked at a bounded number of times."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    # Parts may have any number of zeros in front; three digits left compare as numbers.
    parts = lambda m: [p.lstrip("0") or "0" for p in m[0].split(".")]
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in parts(m))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]


def find_base(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind index)`` of all pattern matches, by start, then kind."""
    spans = []
    if "@" in text:
        spans += [(s, e, 0) for s, e in _emails(text)]
    spans += [(s, e, 1) for s, e in _ips(text)]
    spans += [(s, e, 2) for s, e in _cards(text)]
    spans += [(s, e, 3) for s, e in _phones(text)]
    return sorted(spans, key=lambda x: (x[0], x[2]))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def outside(text: str, base: list[tuple[int, int, int]], start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str]]:
    """``(start, end, term)`` of the terms of ``text[start:end]`` that touch no span of ``base``."""
    k, reach = 0, -1
    for m in _TERM.finditer(text, start, len(text) if end is None else end):
        s, e = m.span()
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s:
            yield s, e, m[0].lower()


def pieces_of(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """``(terms, entities)`` of every piece of ``text``.

    A piece has ``PIECE_TERMS`` terms of one line, the last one of a line fewer; an entity
    belongs to the piece of the terms before it. A line without terms is one piece.
    """
    base = find_base(text)
    at, k = 0, 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        own = []
        while k < len(base) and base[k][0] <= stop:
            own.append(base[k])
            k += 1
        if own:
            found = list(outside(text, own, at, stop))
            terms = [t for _, _, t in found]
            starts = [s for s, _, _ in found]
        else:
            terms, starts = [t.lower() for t in _TERM.findall(text, at, stop)], []
        pieces = [(set(terms[i : i + PIECE_TERMS]), set()) for i in range(0, max(1, len(terms)), PIECE_TERMS)]
        for s, e, _ in own:
            pieces[max(0, bisect_left(starts, s) - 1) // PIECE_TERMS][1].add(text[s:e])
        yield from pieces
        at = stop + 1


def piece_counts(texts: DataFrame) -> DataFrame:
    """``(entity, term, n)``: the pieces that hold an entity and a term.

    A null entity stands for any, and so does a null term: rows with one null count an
    entity or a term alone, the row with two counts all pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone: Counter = Counter()
        both: Counter = Counter()
        total = 0

        def out() -> pa.RecordBatch:
            rows = [(None, t, n) for t, n in alone.items()] + [(e, t, n) for (e, t), n in both.items()]
            alone.clear(), both.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["entity", "term", "n"])

        for batch in batches:
            for value in batch.column(0):
                for terms, entities in pieces_of(value.as_py() or ""):
                    total += 1
                    alone.update(terms)
                    for e in entities:
                        both[e, None] += 1
                        both.update((e, t) for t in terms)
                    if len(alone) + len(both) >= HELD_COUNTS:
                        yield out()
        both[None, None] += total
        yield out()

    return texts.mapInArrow(run, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING, text_col: str = "text") -> DataFrame:
    """``(entity, term, pmi, ic)`` of the terms above the threshold, from the whole corpus.

    A null text has one piece, without terms, as an empty one has.
    """
    counts = materialize(piece_counts(docs.select(docs[text_col].cast("string").alias("text"))), "pii-counts")
    total = counts.where("entity is null and term is null").agg(F.sum("n")).head()[0] or 0  # one number
    entities = counts.where("entity is not null and term is null").select("entity", F.col("n").alias("n_entity"))
    terms = counts.where("entity is null and term is not null").select("term", F.col("n").alias("n_term"))
    pairs = counts.where("entity is not null and term is not null").select("entity", "term", F.col("n").alias("n_both"))
    joined = pairs.join(maybe_broadcast(entities, BROADCAST_ROWS), "entity")
    n = F.lit(float(total))
    ic = -F.log2(F.col("n_entity") / n)
    joined = joined.join(terms, "term")
    p_term = F.col("n_term") / n
    given = (F.col("n_both") + F.lit(smoothing) * p_term) / (F.col("n_entity") + F.lit(smoothing))
    rated = joined.select("entity", "term", F.log2(given / p_term).alias("pmi"), ic.alias("ic"))
    return rated.where((F.col("ic") > 0) & (F.col("pmi") >= disclosure * F.col("ic")))


def _own_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(digest, terms)``: the disclosing terms of the entities that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, values = [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                own = {text[s:e] for s, e, _ in find_base(text)}
                digests += [batch.column(0)[k].as_py()] * len(own)
                values += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(values, pa.string())], names=["digest", "entity"]
            )

    own = texts.select(F.md5("text").alias("digest"), "text").mapInArrow(run, "digest string, entity string").distinct()
    return own.join(terms.select("entity", "term"), "entity").groupBy("digest").agg(F.collect_set("term").alias("terms"))


def add_term_spans(text: str, base: list[tuple[int, int, int]], terms: set[str]) -> list[tuple[int, int, int]]:
    """Base spans and those of the disclosing terms outside them."""
    if not terms:
        return base
    return sorted(base + [(s, e, 4) for s, e, t in outside(text, base) if t in terms], key=lambda x: (x[0], x[2]))


def generalize(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with entities replaced by their kind and disclosing terms by a class."""
    out, at = [], 0
    for s, e, k in spans:
        if s < at:
            continue
        out += [text[at:s], "[TERM]" if k == 4 else f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, n_found long, base_sha256 string, spans string"
)


def find_pii(
    docs: DataFrame,
    disclosure: float = DISCLOSURE,
    smoothing: float = SMOOTHING,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Personal data of every row of ``docs``; with ``with_text`` also the sanitised text.

    ``n_found`` counts all spans; ``base_sha256`` digests those of the patterns alone.
    A null text counts as empty; a null id stays null; repeated rows give repeated
    results; an empty table gives none; other columns are ignored. Terms count as
    disclosing in the documents that hold the entity. Up to ``broadcast_rows``
    disclosing terms go to the workers as one table, more are joined by entity.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    terms = materialize(disclosing_terms(picked, disclosure, smoothing), "pii-terms")
    head = terms.select("entity", "term").limit(broadcast_rows + 1).collect()  # bounded by the limit
    if len(head) <= broadcast_rows:
        table: dict[str, set[str]] = {}
        for entity, term in head:
            table.setdefault(entity, set()).add(term)
        shared = docs.sparkSession.sparkContext.broadcast(table)
        rows = picked.select("doc_id", "text", F.lit(None).cast("array<string>").alias("terms"))
    else:
        shared = None
        rows = picked.withColumn("digest", F.md5("text")).join(_own_terms(picked, terms), "digest", "left")
        rows = rows.select("doc_id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else {}
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                base = find_base(text)
                own = set(batch.column(2)[k].as_py() or ())
                if known and base:
                    own = set().union(*(known.get(text[s:e], ()) for s, e, _ in base))
                spans = add_term_spans(text, base, own)
                kinds = [x[2] for x in spans]
                digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
                row = (batch.column(0)[k].as_py(), *(kinds.count(i) for i in range(5)), len(spans), digest, spans_text(spans))
                out.append((*row, generalize(text, spans)) if with_text else row)
            cols = list(zip(*out)) or [()] * (9 + with_text)
            types = [pa.int64()] * 7 + [pa.string()] * (2 + with_text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")]
            )

    schema = SCHEMA + (", sanitized string" if with_text else "")
    return rows.mapInArrow(run, schema)
