"""Baseline JPEG frames of other writers, decoded to grey means of 8x8 blocks.

Reads the tables that the frame itself brings: quantisers, Huffman codes, sampling and
restart intervals. Frames that are not baseline, or bring no codes, are refused.
"""

from __future__ import annotations

import struct

import numpy as np

# --- fixed values of the JPEG format: markers of frames that are not sequential with Huffman codes
_OTHER_FRAMES = (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """``(length, code) -> value`` of a Huffman table: codes of a length count up, then double."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of one restart interval, stuffing removed, ones behind the end."""

    def __init__(self, data: bytes) -> None:
        raw = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.value, self.left = int.from_bytes(raw, "big"), 8 * len(raw)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends too soon")
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that no table has")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _intervals(data: bytes, at: int) -> list[bytes]:
    """The entropy-coded bytes from ``at`` on, cut at restart markers, up to any other one."""
    out, begin = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            return [*out, data[begin:]]
        if data[k + 1] == 0 or data[k + 1] == 0xFF:
            at = k + 1 + (data[k + 1] == 0)
        elif 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[begin:k])
            begin = at = k + 2
        else:
            return [*out, data[begin:k]]


def block_means(frame: bytes) -> np.ndarray:
    """Grey means (rows, columns) of the 8x8 blocks of the first component of ``frame``.

    The mean of a block is its DC coefficient alone; the AC codes are read past.
    """
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, int] = {}
    huff: dict[tuple[int, int], dict] = {}
    parts: list[tuple[int, int, int, int]] = []
    at, restart, height, width = 2, 0, 0, 0
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("no scan in the frame")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the first one is that of DC
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only samples of 8 bits are read")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in _OTHER_FRAMES:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    if not parts or any(c not in tables for c, *_ in parts):
        raise ValueError("only frames of one scan are read")
    if any((0, tables[c][0]) not in huff or (1, tables[c][1]) not in huff or q not in quant for c, _, _, q in parts):
        raise ValueError("the frame lacks a table")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]  # a single component is not interleaved
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    _, h0, v0, q0 = parts[0]
    out = np.zeros((down * v0, across * h0), np.float64)
    spans = _intervals(frame, at)
    step = restart or across * down
    if len(spans) * step < across * down:
        raise ValueError("the scan ends too soon")
    for k, span in enumerate(spans):
        bits = _Bits(span)
        level = [0] * len(parts)
        for mcu in range(k * step, min((k + 1) * step, across * down)):
            for i, (c, h, v, _) in enumerate(parts):
                dc, ac = huff[0, tables[c][0]], huff[1, tables[c][1]]
                for block in range(h * v):
                    level[i] += bits.signed(bits.symbol(dc))
                    n = 1
                    while n < 64:
                        symbol = bits.symbol(ac)
                        if symbol == 0:
                            break
                        n += (symbol >> 4) + 1
                        bits.take(symbol & 15)
                    if i == 0:
                        out[mcu // across * v + block // h, mcu % across * h + block % h] = level[0]
    # The DC coefficient is eight times the mean around 128.
    return np.clip(np.rint(out * quant[q0] / 8 + 128), 0, 255).astype(np.uint8)
