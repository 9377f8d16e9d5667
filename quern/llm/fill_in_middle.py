"""Fill-in-the-middle transformation by bit-parallel work on big integers.

Every text is a row of bytes, and one big integer holds a bit for each of them:
``bytes.translate`` turns the bytes into class digits, which ``int(..., 2)`` reads as a
mask; shifted boolean operations on the masks mark where units begin; ``bit_count``
numbers the units; and the byte at which a unit begins is the position of a set bit of
given rank, found by halving the mask again and again. No character is looked at in a
Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents, those from this hash on stay plain; of the others, those below the second go suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of output that one Arrow batch holds before it is sent.
FLUSH_BYTES = 16 << 20


def _class(*ranges: tuple[int, int]) -> bytes:
    """A translation table: digit 1 for the bytes in ``ranges`` (ends included), else 0."""
    return bytes(0x31 if any(a <= b <= z for a, z in ranges) else 0x30 for b in range(256))


_CONTINUES = _class((0x80, 0xBF))
_LEADS = (_class((0xC2, 0xF4)), _class((0xE0, 0xF4)), _class((0xF0, 0xF4)))  # of 2, 3, 4 bytes at least
_WORD = _class((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF))
_LINE_END = _class((0x0A, 0x0A))


def _mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i of ``data`` is of the class."""
    return int(data[::-1].translate(table), 2) if data else 0


def unit_starts(data: bytes, unit: str = "char") -> int:
    """A mask of the bytes at which units begin.

    ``char``: code points; a byte continues one if it is a continuation byte within reach
    of a leading byte, so a stray one counts for itself. ``word``: letters, digits and
    all beyond ASCII, each word with what follows it; ``line``: lines with their ends. A
    text that begins before its first word or line has its first unit at byte 0.
    """
    if not data:
        return 0
    if unit == "char":
        two, three, four = (_mask(data, t) for t in _LEADS)
        inside = _mask(data, _CONTINUES) & (two << 1 | three << 2 | four << 3)
        return ((1 << len(data)) - 1) & ~inside
    if unit == "word":
        words = _mask(data, _WORD)
        return words & ~(words << 1) | 1
    if unit == "line":
        return (_mask(data, _LINE_END) << 1 | 1) & ((1 << len(data)) - 1)
    raise ValueError(f"unit {unit!r} is none of char, word, line")


def select_bit(mask: int, width: int, rank: int) -> int:
    """Position of the set bit of ``mask`` that has ``rank`` set bits below it.

    The mask is halved until one bit is left, so the work is that of counting it twice.
    """
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def draws(key: str) -> list[int]:
    """Four numbers below 2**32 from the SHA-256 of ``key``."""
    digest = sha256(key.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(data: bytes, key: str, unit: str = "char", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple[int, str, int | None, int | None, bytes]:
    """``(units, form, units of the prefix, units of the middle, output)`` of one text."""
    starts = unit_starts(data, unit)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(key)
    if not data or h3 % 100 >= plain_from or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = [len(data) if k == n else select_bit(starts, len(data), k) for k in (one, two)]
    prefix, middle, suffix = data[: cut[0]], data[cut[0] : cut[1]], data[cut[1] :]
    if h4 % 100 < spm_below:
        return n, "spm", one, two - one, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", one, two - one, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text of :func:`transform` again, from its output and form alone.

    Texts that hold a marker stay plain, and no marker can begin inside another, so the
    first place of each marker is the one that was put there.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second)
    end = output.index(MIDDLE)
    a, b, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return a + middle + b if form == "psm" else b + middle + a


def _flushed(rows: Iterator[tuple], weight, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``rows``, each of about ``FLUSH_BYTES`` bytes by ``weight`` at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= FLUSH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def fill_in_middle(
    docs: DataFrame,
    salt: str = "1",
    unit: str = "char",
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n, form, prefix_units, middle_units, output)`` for every row of ``docs``.

    ``output`` is the transformed text as bytes, for texts are never decoded. What becomes
    of a row is drawn from ``salt`` and its id, so repeated rows become the same and a row
    with a null id is drawn as if its id were written with no digits. A null text is an
    empty one, and empty texts stay plain; an empty table gives an empty result; other
    columns are ignored, whatever their names. Rows are independent, so there is no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, text in zip(*(c for c in batch.columns)):
                    key, data = key.as_py(), text.as_py() or b""
                    yield (key, *transform(data, f"{salt}:{'' if key is None else key}", unit, plain_from, spm_below))

        yield from _flushed(rows(), lambda r: len(r[5]), schema)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` of :func:`fill_in_middle` with the column ``text``: the bytes rebuilt from output and form."""
    names = transformed.columns
    form, output = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o.as_py(), f.as_py()) for f, o in zip(batch.column(form), batch.column(output))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)
    return transformed.mapInArrow(run, f"{fields}, text binary")
