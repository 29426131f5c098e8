"""A baseline JPEG decoder for frames of any camera that carry their own tables.

Sequential Huffman frames with 8-bit samples, one to four components, any
sampling factors, and restart intervals.  What is decoded is the first
component: grey, or luma.  Progressive, lossless and arithmetic frames raise
``ValueError``, and so does a frame without the tables that it names.
"""

from __future__ import annotations

import numpy as np

#: Place of the k-th coefficient of a block: along the diagonals, back and forth.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


class _Bits:
    """Most significant bits first, from an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * (len(data) + 8)

    def peek(self, n: int) -> int:
        return self.value >> (self.left - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("frame ends early")
        out = self.peek(n)
        self.left -= n
        if self.left & 0xFFF == 0:
            self.value &= (1 << self.left) - 1
        return out


def _huffman(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """By the next 16 bits: symbol, and length of its code (0: none)."""
    symbol, length, code, k = [0] * 65536, [0] * 65536, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            first, span = code << (16 - n), 1 << (16 - n)
            symbol[first : first + span], length[first : first + span] = [symbols[k]] * span, [n] * span
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: tuple, ac: tuple, out: list[int] | None) -> int:
    """Reads a block and returns its DC difference; AC coefficients go to ``out``, in zigzag order."""

    def symbol(table: tuple) -> int:
        at = bits.peek(16)
        if not table[1][at]:
            raise ValueError("unknown code")
        bits.take(table[1][at])
        return table[0][at]

    size = symbol(dc)
    difference, k = _signed(bits.take(size), size), 1
    while k < 64:
        code = symbol(ac)
        skip, size = code >> 4, code & 15
        if not size:
            if skip != 15:
                break
            k += 16
            continue
        k += skip
        if k > 63:
            raise ValueError("block runs over")
        value = _signed(bits.take(size), size)
        if out is not None:
            out[k] = value
        k += 1
    return difference


def _segments(data: bytes):
    """(marker, body) up to the scan, whose body goes on to the end of the frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], data[at + 4 : at + 2 + size], data[at + 2 + size :]
        at += 2 + size
    raise ValueError("no scan")


def decode(data: bytes) -> np.ndarray:
    """The first component of a frame, (rows, columns) of unsigned bytes."""
    quantisers, tables, interval, shape = {}, {}, 0, None
    for marker, body, rest in _segments(data):
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            rows, columns = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            shape = rows, columns, parts
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline frames only")
        elif marker == 0xDA:
            break
    if shape is None or body[0] != len(shape[2]):
        raise ValueError("one scan of all components is expected")
    rows, columns, parts = shape
    used = {body[i]: (body[i + 1] >> 4, 0x10 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
    try:
        coders = [(h, v, tables[used[c][0]], tables[used[c][1]]) for c, h, v, _ in parts]
        quantiser = quantisers[parts[0][3]]
    except KeyError:
        raise ValueError("a table is missing") from None
    if len(parts) == 1:  # a scan of one component has single blocks
        coders = [(1, 1, *coders[0][2:])]
        wide, high, across, down = 1, 1, -(-columns // 8), -(-rows // 8)
    else:
        wide, high = parts[0][1], parts[0][2]
        most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
        across, down = -(-columns // (8 * most_h)), -(-rows // (8 * most_v))
        columns, rows = -(-columns * wide // most_h), -(-rows * high // most_v)
    blocks = np.zeros((down * high, across * wide, 64), np.int64)
    end = rest.rfind(b"\xff\xd9")
    pieces, coded = [], rest[: end if end >= 0 else len(rest)]
    start = at = 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        if 0xD0 <= coded[at + 1] <= 0xD7:
            pieces.append(coded[start:at])
            start = at + 2
        at += 2
    pieces.append(coded[start:])
    readers = [_Bits(p.replace(b"\xff\x00", b"\xff")) for p in pieces]
    level, reader = [0] * len(parts), 0
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            level, reader = [0] * len(parts), reader + 1
        bits = readers[min(reader, len(readers) - 1)]
        for i, (h, v, dc, ac) in enumerate(coders):
            for y in range(v):
                for x in range(h):
                    own = [0] * 64 if i == 0 else None
                    level[i] += _block(bits, dc, ac, own)
                    if own is not None:
                        own[0] = level[0]
                        blocks[unit // across * high + y, unit % across * wide + x, ZIGZAG] = np.array(own) * quantiser
    pixels = np.einsum("yu,abuv,xv->abyx", _COS, blocks.reshape(*blocks.shape[:2], 8, 8).astype(np.float64), _COS)
    plane = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)
    return plane.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)[:rows, :columns]
