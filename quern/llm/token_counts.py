"""Token counts: batch encoding inside Arrow functions, lengths only.

Each Arrow batch is cut into encoder batches of roughly equal bytes, and long
texts are split at boundaries where the tokenizer can never join the two sides,
so one very long document neither stalls a batch nor needs its encodings in
memory at once. Only the lengths leave the worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that one encoder call gets, and the length from which a text is split.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

#: A space or line feed after a plain ASCII letter, digit or point, or a full stop or comma
#: of scripts without blanks after one of their letters: byte-level pre-tokenisation
#: always starts a new word there, normalisation never composes across it, and no special
#: token contains any of them.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.])[ \n]|(?<=[\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF])[\u3001\u3002\uFF0C\uFF01\uFF1F]")

_loaded: dict[str, Callable] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_safely(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut ``text`` into pieces of about ``size`` characters whose token counts add up.

    Where no safe boundary follows, the piece stays whole.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def _length_encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function that gives the token counts of texts; loaded once per worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def count_batch(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts of ``texts``, encoding about ``batch_bytes`` bytes at a time."""
    encode = _length_encoder(path)
    splits = not path.endswith(".model")  # sentencepiece normalises the ends of every text
    counts = [0] * len(texts)
    todo: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(owner, encode(todo)):
            counts[i] += n
        todo.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        for piece in split_safely(text) if splits else [text]:
            todo.append(piece)
            owner.append(i)
            held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                flush()
    if todo:
        flush()
    return counts


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    One row out for each row in, repeated rows included; a null text counts as
    empty (0 bytes, 0 tokens); a null id stays null; other columns are ignored,
    whatever their names; an empty table gives an empty result. ``tokenizer`` is
    a file name known to ``public_tokenizers`` or a path.
    """
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = count_batch(texts, path)
            n_bytes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
