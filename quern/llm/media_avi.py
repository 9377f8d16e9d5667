"""Media columns: AVI files of motion-JPEG frames.

A payload of bytes is stored losslessly: every byte becomes one 8x8 block of that
grey value, coded by its DC coefficient alone with a quantiser step of 8, which a
decoder turns back into the same value. Frames are baseline JPEGs of 64 blocks in a
row with a restart marker after each row, so the rows of all frames decode in
parallel. The reader parses the RIFF index, decodes the intra frames it points to,
takes grey histograms, and cuts shots where the histogram difference stands out from
its surroundings, which gives rows of timed clips. Frames of other writers are decoded
by the tables that they bring, to the means of their blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.jpeg_frames import block_means

#: Blocks in a row: a row is one restart interval.
ROW = 64
#: Rows of a frame at most; short payloads get frames of fewer rows.
ROWS = 8
FPS = 25
#: Histogram bins, frames on each side for the adaptive threshold, and its parts.
BINS = 16
SPAN = 12
FACTOR = 3.0
FLOOR = 0.15
#: Rows that are coded or decoded in one step.
STEP_ROWS = 1 << 14

# --- fixed values of the JPEG format: the Huffman codes used here -----------------
#: DC: categories 0 to 11, all with codes of 4 bits, in order. AC: end of block alone,
#: code 0 of 1 bit.
_DC_COUNTS = bytes([0, 0, 0, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_DC_VALUES = bytes(range(12))
_AC_COUNTS = bytes([1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_AC_VALUES = bytes([0])

_DIFF = np.arange(-255, 256)
_CATEGORY = np.where(_DIFF == 0, 0, np.floor(np.log2(np.maximum(np.abs(_DIFF), 1))).astype(np.int64) + 1)
#: By difference + 255: bits of the whole block (4 for the category, its bits, 1 to end).
_BITS = (_CATEGORY + 5).astype(np.int64)
_AMPLITUDE = np.where(_DIFF < 0, _DIFF + (1 << _CATEGORY) - 1, _DIFF)
_CODE = (((_CATEGORY << _CATEGORY) | _AMPLITUDE) << 1).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_header(rows: int) -> bytes:
    quant = _segment(0xDB, b"\x00" + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
    huff = _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_VALUES + b"\x10" + _AC_COUNTS + _AC_VALUES)
    restart = _segment(0xDD, struct.pack(">H", ROW))
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + huff + restart + scan


def _encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every row of ``samples`` (n, ROW), and their lengths.

    The bytes come stuffed (0 after each 255), rows one after the other.
    """
    n = len(samples)
    values = samples.astype(np.int64)
    diff = values.copy()
    diff[:, 0] -= 128
    diff[:, 1:] -= values[:, :-1]
    diff += 255
    bits = _BITS[diff]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = (ends - bits + (base << 3)[:, None]).ravel()
    # A block has 13 bits at most, so it touches 3 bytes at most.
    word = _CODE[diff].ravel() << (24 - (at & 7) - bits.ravel())
    total = int(size.sum())
    where = at >> 3
    out = np.bincount(where, weights=word >> 16, minlength=total + 2)
    out += np.bincount(where + 1, weights=(word >> 8) & 255, minlength=total + 2)
    out += np.bincount(where + 2, weights=word & 255, minlength=total + 2)[: total + 2]
    raw = out[:total].astype(np.uint8)
    pad = (size << 3) - ends[:, -1]
    raw[base + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    full = raw == 255
    row_of = np.repeat(np.arange(n), size)
    extra = np.bincount(row_of[full], minlength=n)
    place = np.arange(total) + np.cumsum(full) - full
    stuffed = np.zeros(total + int(full.sum()), np.uint8)
    stuffed[place] = raw
    return stuffed, size + extra


def _decode_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples (n, ROW) of the rows at ``start`` in ``data``; all rows go in lockstep."""
    n = len(start)
    ends = np.cumsum(size)
    take = np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)
    raw = data[take]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
    keep[(ends - size)] = True  # a row's first byte follows no 255 of its own
    row_of = np.repeat(np.arange(n), size)
    clean = np.concatenate([raw[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    length = np.bincount(row_of[keep], minlength=n)
    at = (np.cumsum(length) - length) << 3
    wide = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    out = np.empty((ROW, n), np.uint8)
    level = np.full(n, 128, np.int64)
    for k in range(ROW):
        window = (wide[at >> 3] << (at & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)
        category = (window >> np.uint32(28)).astype(np.int64)
        amplitude = ((window >> np.uint32(12)) & np.uint32(0xFFFF)).astype(np.int64) >> (16 - category)
        low = (amplitude << 1) < (1 << category)
        level += amplitude - np.where(low, (1 << category) - 1, 0)
        out[k] = level
        at = at + category + 5
    return out.T


_HEADERS = {r: _jpeg_header(r) for r in range(1, ROWS + 1)}
_RESTARTS = [bytes([0xFF, 0xD0 + (r & 7)]) for r in range(ROWS)]


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _coded_rows(samples: np.ndarray) -> tuple[bytes, list[int]]:
    """Entropy-coded rows as one string, and where each of them ends in it."""
    parts, ends, base = [], [], 0
    for a in range(0, len(samples), STEP_ROWS):
        coded, size = _encode_rows(samples[a : a + STEP_ROWS])
        parts.append(coded.tobytes())
        ends += (np.cumsum(size) + base).tolist()
        base += len(parts[-1])
    return b"".join(parts), ends


def _padded(payload: bytes) -> tuple[np.ndarray, int]:
    """Samples in rows, filled up to whole frames, and the rows of a frame."""
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // ROW
    rows = min(ROWS, n)
    return np.frombuffer(payload + b"\x00" * (-n % rows * ROW), np.uint8).reshape(-1, ROW), rows


def _assemble(coded: bytes, begin: int, ends: list[int], rows: int, n_payload: int) -> bytes:
    """The AVI file of the rows that end at ``ends`` in ``coded``, the first from ``begin``."""
    header = _HEADERS[rows]
    n_frames = len(ends) // rows
    frames: list[bytes] = []
    for f in range(0, len(ends), rows):
        parts = [header]
        for r in range(rows - 1):
            parts += [coded[begin : ends[f + r]], _RESTARTS[r]]
            begin = ends[f + r]
        parts += [coded[begin : ends[f + rows - 1]], b"\xff\xd9"]
        begin = ends[f + rows - 1]
        frames.append(b"".join(parts))
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n_frames, 0, 1, largest, ROW * 8, rows * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n_frames, largest, 0, 0, 0, 0, ROW * 8, rows * 8)
    image = struct.pack("<IiiHH4sIiiII", 40, ROW * 8, rows * 8, 1, 24, b"MJPG", ROW * 8 * rows * 8 * 3, 0, 0, 0, 0)
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\x00" % n_payload))
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", image))) + info
    index, body, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def write_many(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; the rows of all of them are coded together.

    Each payload must be a positive multiple of 64 bytes. A last frame is filled with
    zeros; the true length stands in the INFO list.
    """
    if not payloads:
        return []
    padded = [_padded(p) for p in payloads]
    coded, ends = _coded_rows(np.concatenate([x for x, _ in padded]))
    out, begin, row = [], 0, 0
    for (samples, rows), payload in zip(padded, payloads):
        own = ends[row : row + len(samples)]
        out.append(_assemble(coded, begin, own, rows, len(payload)))
        begin, row = own[-1], row + len(samples)
    return out


def write_avi(payload: bytes) -> bytes:
    """An AVI file (MJPG, 512 pixels wide) whose frames hold ``payload``."""
    return write_many([payload])[0]


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def parse_index(data: bytes) -> tuple[dict, np.ndarray]:
    """``(info, index)``: rate, frame count and payload length; (offset, size) of frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    info: dict = {"payload": None}
    movi = 0
    index = np.zeros((0, 2), np.int64)
    for kind, at, size in _chunks(data, 12, len(data)):
        if kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif kind == b"LIST" and data[at : at + 4] == b"INFO":
            for k, a, s in _chunks(data, at + 4, at + size):
                if k == b"ICMT" and data[a : a + 8] == b"payload=":
                    info["payload"] = int(data[a + 8 : a + s].rstrip(b"\x00"))
        elif kind == b"LIST" and data[at : at + 4] == b"hdrl":
            for k, a, _ in _chunks(data, at + 4, at + size):
                if k == b"avih":
                    info["us"], info["frames"] = struct.unpack_from("<I", data, a)[0], struct.unpack_from("<I", data, a + 16)[0]
        elif kind == b"idx1":
            entries = np.frombuffer(data, "<u4", size // 4, at).reshape(-1, 4).astype(np.int64)
            entries = entries[entries[:, 0] == int.from_bytes(b"00dc", "little")]
            index = np.stack([entries[:, 2] + movi + 8, entries[:, 3]], axis=1)
    return info, index


def _row_spans(data: bytes, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the coded rows of the indexed frames begin and end, and the rows of a frame.

    All frames must share the first one's header, as those of :func:`write_many` do.
    """
    first = data[index[0, 0] : index[0, 0] + index[0, 1]]
    at, rows = 2, 1
    while first[at + 1] != 0xDA:
        if first[at + 1] == 0xC0:
            rows = struct.unpack_from(">H", first, at + 5)[0] // 8
        at += 2 + struct.unpack_from(">H", first, at + 2)[0]
    begin = index[:, 0] + at + 2 + struct.unpack_from(">H", first, at + 2)[0]
    end = index[:, 0] + index[:, 1] - 2
    if rows == 1:
        return begin, end, rows
    # A 255 followed by D0 to D7 is a restart marker: stuffing keeps the data clear of it.
    view = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero(view[:-1] == 255)
    mark = mark[(view[mark + 1] & 0xF8) == 0xD0]
    frame = np.searchsorted(begin, mark, side="right") - 1
    mark = mark[(frame >= 0) & (mark < end[frame])].reshape(len(index), rows - 1)
    start = np.concatenate([begin[:, None], mark + 2], axis=1).ravel()
    stop = np.concatenate([mark, end[:, None]], axis=1).ravel()
    return start, stop, rows


def _own_frames(data: bytes, index: np.ndarray) -> bool:
    """True if all indexed frames have the header of :func:`write_many`, so that rows decode in lockstep."""
    if not len(index):
        return False
    for header in _HEADERS.values():
        if data.startswith(header, index[0, 0]):
            return all(data.startswith(header, a) for a in index[:, 0].tolist())
    return False


def read_foreign(data: bytes) -> tuple[bytes, np.ndarray, dict]:
    """``(b"", frames, info)`` of an AVI file of any baseline motion-JPEG, frames of one size.

    ``frames`` has the grey mean of every 8x8 block. A frame that is not baseline JPEG
    is an error; an empty frame repeats the one before it, as such files have it.
    """
    info, index = parse_index(data)
    frames: list[np.ndarray] = []
    for at, size in index.tolist():
        frames.append(block_means(data[at : at + size]) if size or not frames else frames[-1])
    if len({f.shape for f in frames}) > 1:
        raise ValueError("frames of several sizes")
    return b"", np.stack(frames) if frames else np.zeros((0, 1, 1), np.uint8), info


def read_many(files: list[bytes]) -> list[tuple[bytes, np.ndarray, dict]]:
    """``(payload, frames, info)`` of stored files of :func:`write_many`, from their bytes alone.

    ``frames`` holds the grey samples (frames, rows, ROW), one for each 8x8 block. The
    rows of all files decode in lockstep.
    """
    heads = [(info, *_row_spans(data, index)) for data in files for info, index in [parse_index(data)]]
    base = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    view = np.frombuffer(b"".join(files), np.uint8)
    start = np.concatenate([h[1] + b for h, b in zip(heads, base)])
    size = np.concatenate([h[2] - h[1] for h in heads])
    rows = np.concatenate(
        [_decode_rows(view, start[a : a + STEP_ROWS], size[a : a + STEP_ROWS]) for a in range(0, len(start), STEP_ROWS)]
    )
    out, at = [], 0
    for info, begin, _, per_frame in heads:
        frames = rows[at : at + len(begin)].reshape(-1, per_frame, ROW)
        at += len(begin)
        out.append((frames.tobytes()[: info["payload"]], frames, info))
    return out


def read_avi(data: bytes) -> tuple[bytes, np.ndarray, dict]:
    """Payload, frames and info of a file of ours; frames and info of one of another writer."""
    return read_many([data])[0] if _own_frames(data, parse_index(data)[1]) else read_foreign(data)


def histogram_differences(frames: np.ndarray) -> np.ndarray:
    """Half the L1 distance (0 to 1) of the grey histograms of consecutive frames."""
    n, size = len(frames), frames.shape[1] * frames.shape[2]
    bins = (frames.reshape(n, size) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    return np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * size)


def find_shots(diff: np.ndarray, span: int = SPAN, factor: float = FACTOR, floor: float = FLOOR) -> np.ndarray:
    """First frames of the shots after the first one.

    A cut lies where a difference exceeds ``floor`` plus the mean and ``factor``
    standard deviations of the differences around it, itself left out.
    """
    n = len(diff)
    if n == 0:
        return np.zeros(0, np.int64)
    one = np.concatenate([[0.0], np.cumsum(diff)])
    two = np.concatenate([[0.0], np.cumsum(diff * diff)])
    k = np.arange(n)
    a, b = np.maximum(0, k - span), np.minimum(n, k + span + 1)
    count = np.maximum(1, b - a - 1)
    mean = (one[b] - one[a] - diff) / count
    dev = np.sqrt(np.maximum(0.0, (two[b] - two[a] - diff * diff) / count - mean * mean))
    return np.flatnonzero(diff > floor + mean + factor * dev) + 1


def clips(frames: np.ndarray, us: int) -> list[tuple[int, int, int, float, float, float]]:
    """``(clip, first frame, frames, start s, end s, mean grey)`` of every shot."""
    cuts = find_shots(histogram_differences(frames))
    edges = np.concatenate([[0], cuts, [len(frames)]])
    grey = frames.reshape(len(frames), -1).mean(axis=1)
    return [
        (k, int(a), int(b - a), a * us / 1e6, b * us / 1e6, float(grey[a:b].mean()))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
    ]


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes of ``text``, zeros appended up to a positive multiple of 64; bytes before."""
    raw = text.encode("utf-8")
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media binary)``: every text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                media = write_avi(payload_of(batch.column(1)[k].as_py() or "")[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()], pa.int64()), pa.array([media], pa.binary())], names=["doc_id", "media"]
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clips of the files in ``media(doc_id, media)``; a null file has none, nor has one without frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s", "mean_grey"]
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                _, frames, info = read_avi(data) if data is not None else (b"", (), {})
                if len(frames):
                    rows += [(batch.column(0)[k].as_py(), *c) for c in clips(frames, info["us"])]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_grey double"
    )


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as AVI, read it back, and digest what came back.

    One row for each row of ``docs``, repeated ones included. A null text counts as
    empty (64 zero bytes); a null id stays null; an empty table gives none; other
    columns are ignored. ``feature`` lists frames, shots, the frames at which shots
    begin as a checksum, and the mean histogram difference. The stored file lives in
    the worker only while its row is made.
    """

    def row(n: int, media: bytes, back: bytes, frames: np.ndarray, info: dict) -> tuple:
        diff = histogram_differences(frames)
        cuts = find_shots(diff)
        first = cuts[0] * info["us"] / 1e6 if len(cuts) else 0.0
        feature = (
            f"frames={len(frames)};shots={len(cuts) + 1};cuts={zlib.crc32(cuts.astype('<u4').tobytes())};"
            f"first={first:.2f};diff={diff.mean() if len(diff) else 0.0:.6f}"
        )
        return (
            n,
            len(back),
            hashlib.sha256(back).hexdigest(),
            zlib.crc32(back[-64:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            feature,
        )

    def some(payloads: list[tuple[bytes, int]]) -> list[tuple]:
        media = write_many([p for p, _ in payloads])
        return [row(n, m, *r) for (_, n), m, r in zip(payloads, media, read_many(media))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[bytes, int]] = []
            size = 0
            for k in range(batch.num_rows):
                held.append(payload_of(batch.column(1)[k].as_py() or ""))
                size += len(held[-1][0])
                if size >= STEP_ROWS * ROW or k + 1 == batch.num_rows:
                    rows += some(held)
                    held, size = [], 0
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)

