"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. A chain over the lines, with features of the
line and of its neighbours, gives forward-backward marginals; their mean, weighted by
line length, is the quality of the document. The model is fitted on the driver from
the line features of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: documents, and lines of one document (documents with
#: more lines are not drawn). Scoring has no such bounds.
TRAIN_DOCS = 3000
TRAIN_LINES = 400
EPOCHS = 160
L2 = 1e-3
SEED = 7
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "letters", "upper", "digits", "symbols", "stops", "non_ascii", "mean_word",
    "distinct", "top_share", "symbols_per_word", "stops_per_word", "starts_upper", "empty", "pipes", "shout",
)
#: Characters that are ordinary punctuation of prose; other ASCII punctuation counts as symbols.
_STOPS = ".,;:'\"()-?"

_CLASS = np.zeros(1 << 16, np.uint8)  # 0 other, 1 letter, 2 capital, 3 digit, 4 stop, 5 symbol, 6 space


def _fill_classes() -> None:
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace():
            _CLASS[c] = 6
        elif ch.isupper():
            _CLASS[c] = 2
        elif ch.isalpha():
            _CLASS[c] = 1
        elif ch.isdigit():
            _CLASS[c] = 3
        elif ch in _STOPS:
            _CLASS[c] = 4
        elif c > 32:
            _CLASS[c] = 5


_fill_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, weights, lines per text)``; blank lines are skipped.

    A text without any other line has one empty line.
    """
    lines: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = [x for x in text.split("\n") if x and not x.isspace()] or [""]
        lines += own
        counts[k] = len(own)
    n = len(lines)
    size = np.fromiter(map(len, lines), np.int64, n)
    # A line feed behind each line keeps every segment non-empty.
    code = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, 0xFFFF)]
    kind[code > 0xFFFF] = 0
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    by = {c: np.add.reduceat((kind == c).astype(np.int32), start) for c in (1, 2, 3, 4, 5)}
    non_ascii = np.add.reduceat((code > 127).astype(np.int32), start)
    pipes = np.add.reduceat((code == 124).astype(np.int32), start)
    shout = np.add.reduceat((code == 33).astype(np.int32), start)
    words = np.empty(n, np.int64)
    distinct = np.empty(n)
    top = np.empty(n)
    for k, line in enumerate(lines):
        own = line.lower().split()
        words[k] = m = len(own)
        unique = len(set(own))
        distinct[k] = unique / m if m else 1.0
        # The share of the words that their most frequent one has is only worth counting where words repeat.
        top[k] = max(map(own.count, set(own))) / m if m > 3 and unique <= 12 and unique < m // 2 else 0.0
    chars = np.maximum(size, 1)
    some = np.maximum(words, 1)
    letters = by[1] + by[2]
    first = kind[start]
    x = np.stack(
        [
            np.log1p(size), np.log1p(words), letters / chars, by[2] / np.maximum(letters, 1), by[3] / chars,
            by[5] / chars, by[4] / chars, non_ascii / chars, np.minimum(size / some, 40) / 10, distinct, top,
            np.minimum(by[5] / some, 4), np.minimum(by[4] / some, 2), first == 2, size == 0,
            np.minimum(pipes / some, 2), np.minimum(shout / some, 3),
        ],
        axis=1,
    )
    return x.astype(np.float32), (size + 1).astype(np.float64), counts


def _with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one after (zeros at the ends), and 1."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1)


def forward_backward(
    emission: np.ndarray, counts: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for every line, and expected pair counts summed over all chains.

    ``emission`` is the score of good against bad; all chains advance together.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    e = np.clip(emission, -30, 30)
    good = 1.0 / (1.0 + np.exp(-e))
    psi = np.stack([1 - good, good], axis=1)
    jump = np.exp(transition - transition.max())
    alpha = np.empty((len(emission), 2))
    beta = np.ones((len(emission), 2))
    for t in range(longest):
        at = start[: active[t]] + t
        a = psi[at] if t == 0 else (alpha[at - 1] @ jump) * psi[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        ahead = psi[at + 1] * beta[at + 1]
        b = ahead @ jump.T
        joint = alpha[at][:, :, None] * jump[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post[:, 1] / post.sum(axis=1), pairs


@dataclass
class CrfModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray

    def emissions(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _with_neighbours((x - self.mean) / self.scale, counts) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of every text, from 0 to 1."""
        if not texts:
            return np.zeros(0)
        x, weight, counts = line_features(texts)
        good, _ = forward_backward(self.emissions(x, counts), counts, self.transition)
        begin = np.cumsum(counts) - counts
        score = np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)
        return np.clip(score, 0.0, 1.0)


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, l2: float = L2) -> CrfModel:
    """Maximum conditional likelihood by Adam; every line bears its document's label.

    Lines count by one over the lines of their document, so long documents do not rule.
    Without any document the model is neutral and scores 0.5.
    """
    d = len(FEATURES)
    if not len(counts):
        return CrfModel(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros(3 * d + 1), np.zeros((2, 2)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    f = _with_neighbours((x - mean) / scale, counts).astype(np.float64)
    y = np.repeat(labels, counts).astype(np.float64)
    share = np.repeat(1.0 / counts, counts) / len(counts)
    first = np.cumsum(counts) - counts
    inner = np.ones(len(y), bool)
    inner[first] = False
    n_pairs = max(1, int(inner.sum()))
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:-1].astype(int)[inner[1:]], y[1:].astype(int)[inner[1:]]), 1)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = forward_backward(f @ w, counts, trans)
        gradient = np.concatenate([f.T @ ((y - good) * share), ((observed - pairs) / n_pairs).ravel()]) - l2 * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient * gradient
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return CrfModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> DataFrame:
    """Line features of the sample: labelled documents whose crc32 is not 0 modulo 5.

    The sample is the ``max_docs`` ids with the smallest hashes, so it is the same on
    every run; ids are drawn from the labels alone and their texts never leave the
    executors. Of rows that repeat an id, the one of the least text hash counts, so the
    bound holds for rows too.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                x, _, counts = line_features([batch.column(2)[k].as_py() or ""])
                if counts[0] <= max_lines:
                    rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), int(counts[0]), x.tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "label", "lines", "x"])

    # The drawn ids are max_docs rows at most.
    joined = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    joined = joined.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"))
    return joined.mapInArrow(run, "doc_id long, label int, lines int, x binary")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> CrfModel:
    """Fit the model on the bounded sample of :func:`training_rows`."""
    rows = sorted(training_rows(docs, labels, max_docs).collect(), key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    d = len(FEATURES)
    x = np.concatenate([np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, d) for r in rows] or [np.zeros((0, d), np.float32)])
    return fit(x, np.array([r["lines"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64))


def score_documents(
    docs: DataFrame, model: CrfModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Only the text enters the score. A null text counts as empty, which is one empty
    line; a null id stays null and counts as not held out; repeated rows give repeated
    results; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            held: list[str] = []
            size = 0
            for value in batch.column(2):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size > 1 << 20:
                    scores.append(model.score(held))
                    held, size = [], 0
            scores.append(model.score(held))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(F.crc32(docs[id_col].cast("long").cast("string")) % 5 == 0, F.lit(False))
    picked = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("text")
    )
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled sample, then score all of ``docs``."""
    return score_documents(docs, train(docs, labels, max_docs), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    The rows themselves pass through the scorer, so repeated or missing ids do not
    matter.
    """
    model = train(docs, labels, max_docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[np.ndarray] = []
            held: list[str] = []
            size = 0
            for value in batch.column(at):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size > 1 << 20:
                    keep.append(model.score(held) >= threshold)
                    held, size = [], 0
            keep.append(model.score(held) >= threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
