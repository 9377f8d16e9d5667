"""Sequence packing by the online sum-of-squares rule.

Documents become token ids, are cut at the window length, and every remainder is
placed into the fill level that minimises the sum of squared counts of partially
filled windows; the counts live in one array indexed by fill level. Each input
partition packs its own stream, so nothing is shuffled and a lost executor only
repeats its partitions. When a stream ends, the windows that are still open are
joined by cutting, which leaves at most one padded window for each partition.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END_ID = 1
#: Word encodings that a worker keeps; the table starts anew when it is full.
CACHE_WORDS = 1_000_000
#: Characters that are encoded in one step.
STEP_CHARS = 1 << 20

#: ASCII punctuation that never joins letters before it into one pre-token.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"



def _plain(word: str) -> bool:
    """True for letters of the older scripts that stay letters in lower case."""
    return word.isalpha() and word[-1] <= "\u052f" and (word.isascii() or word.lower().isalpha())


_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts through the tokenizer, each distinct word encoded once.

    It relies on two facts of the tokenizer file: its normaliser acts on single
    characters and white space, and its pre-tokeniser never joins characters across
    white space and drops it. So the ids of a text are the ids of its pieces between
    spaces and line feeds, in order. Other white space stays inside a piece and is
    left to the tokenizer.

    New words made of letters alone are one pre-token each, and only the last id of a
    pre-token has the end-of-word mark; so many of them are encoded as one text and
    taken apart at the marks. Punctuation behind letters is a pre-token of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        # Ends of pre-tokens, by id.
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        #: The ids of every known word, as bytes of little-endian uint32.
        self.known: dict[str, bytes] = {"": b""}

    def _odd(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tok.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters, all encoded in one call."""
        ids = self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._odd(words)
        data = np.array(ids, "<u4").tobytes()
        cuts = (stops * 4).tolist()
        return (data[a:b] for a, b in zip([0, *cuts], cuts))

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = next(self._odd([tail]))
        return self.tails[tail]

    def _learn(self, words: list[str]) -> None:
        known = self.known
        cores = [w.rstrip(_TAIL) for w in words]
        fresh = [c for c in set(cores).difference(known) if _plain(c)]
        ids = dict(zip(fresh, self._letters(fresh))) if fresh else {}
        other = []
        for w, core in zip(words, cores):
            if core is w or len(core) == len(w):
                if w in ids:
                    known[w] = ids[w]
                else:
                    other.append(w)
            elif core in ids:
                known[w] = ids[core] + self._tail(w[len(core) :])
            elif core in known and _plain(core):
                known[w] = known[core] + self._tail(w[len(core) :])
            else:
                other.append(w)
        if other:
            known.update(zip(other, self._odd(other)))

    def _look_up(self, lists: list[list[str]]) -> None:
        """Make sure that all words of ``lists`` are known; starts anew beyond the limit."""
        new = set().union(*lists).difference(self.known)
        if len(new) + len(self.known) > CACHE_WORDS:
            self._reset()
            new = set().union(*lists) - {""}
        if new:
            self._learn(list(new))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of ``texts`` as uint32, without special tokens of the tokenizer's own."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self._look_up(split)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any length, ``STEP_CHARS`` characters or so at a time."""
        if len(text) <= 2 * STEP_CHARS:
            return self.encode_many([text])[0]
        parts, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STEP_CHARS)
            end = len(text) if end < 0 else end
            parts.append(self.encode_many([text[at:end]])[0])
            at = end + 1
        return np.concatenate(parts)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Online packer: a level array counts the open windows of every fill.

    ``level[h]`` is the number of windows filled to ``h``; placing an item of ``s``
    ids into a window of fill ``h`` changes the sum of squares by
    ``1 - 2*level[h]`` (``h`` > 0) plus ``2*level[h+s] + 1`` (``h + s`` below the
    window). The level with the smallest change wins, the fullest one among equals.
    """

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.bins: dict[int, list] = {}
        self.next_id = 0

    def new_bin(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int, item) -> tuple[int, list] | None:
        """Put ``item`` of ``size`` ids; returns (bin, its items) if that fills the bin."""
        w, level = self.window, self.level
        top = w - size
        gain = 1 - 2 * level[: top + 1]
        gain[level[: top + 1] == 0] = 1 << 40
        gain[0] = 0
        after = 2 * level[size : w + 1] + 1
        after[top] = 0
        cost = gain + after
        h = top - int(np.argmin(cost[::-1]))
        if h == 0:
            b = self.new_bin()
            self.bins[b] = []
        else:
            held = self.open[h]
            b = held.pop()
            level[h] -= 1
        self.bins[b].append((item, h))
        if h + size == w:
            return b, self.bins.pop(b)
        level[h + size] += 1
        self.open.setdefault(h + size, []).append(b)
        return None

    def drain(self) -> list[tuple[int, list]]:
        """The bins that are still open, the fullest first."""
        out = []
        for h in sorted(self.open, reverse=True):
            out += [(b, self.bins.pop(b)) for b in self.open[h]]
        self.open.clear()
        self.level[:] = 0
        return out


def pack_stream(
    docs: Iterator[tuple[int | None, np.ndarray]], window: int = WINDOW
) -> Iterator[tuple[int | None, int, np.ndarray, int, int, int]]:
    """Pack (doc_id, ids) pairs; yields (doc_id, start, ids, doc_tokens, bin, offset)."""
    packer = SumOfSquares(window)
    for doc, ids in docs:
        n, at = len(ids), 0
        while n - at >= window:
            yield doc, at, ids[at : at + window], n, packer.new_bin(), 0
            at += window
        if at < n:
            full = packer.place(n - at, (doc, at, ids[at:].copy(), n))
            if full is not None:
                for (d, s, piece, total), offset in full[1]:
                    yield d, s, piece, total, full[0], offset
    # What is open at the end is joined: cut wherever a window is full.
    b, fill = -1, window
    for _, items in packer.drain():
        for (d, s, piece, total), _ in items:
            while len(piece):
                if fill == window:
                    b, fill = packer.new_bin(), 0
                part = piece[: window - fill]
                yield d, s, part, total, b, fill
                fill += len(part)
                s += len(part)
                piece = piece[len(part) :]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack every row of ``docs`` into windows of ``window`` ids; a row for each piece.

    A null text counts as empty and still takes its end id; a null id stays null;
    repeated rows are packed each on its own; an empty table gives no pieces; other
    columns are ignored. ``sequence_id`` is unique over all partitions. With
    ``with_ids`` the ids themselves come along as ``ids``.
    """
    from quern.llm.token_counts import tokenizer_path

    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        enc = encoder(path)

        def stream() -> Iterator[tuple[int | None, np.ndarray]]:
            keys: list = []
            held: list[str] = []
            size = 0

            def coded() -> Iterator[tuple[int | None, np.ndarray]]:
                many = enc.encode_many(held) if size <= 2 * STEP_CHARS else map(enc.encode, held)
                for key, ids in zip(keys, many):
                    yield key, np.append(ids, np.uint32(end_id))

            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for k in range(batch.num_rows):
                    keys.append(ids[k].as_py())
                    held.append(texts[k].as_py() or "")
                    size += len(held[-1])
                    if size >= STEP_CHARS:
                        yield from coded()
                        keys, held, size = [], [], 0
            yield from coded()

        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for doc, start, piece, total, b, offset in pack_stream(stream(), window):
            crc = zlib.crc32(piece.astype("<u4").tobytes())
            row = (doc, start, len(piece), crc, total, base + b, offset)
            rows.append((*row, piece.astype(np.int32)) if with_ids else row)
            if len(rows) >= 8192:
                yield out()
        if rows:
            yield out()

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
