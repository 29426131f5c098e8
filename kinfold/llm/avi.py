"""Byte payloads as motion-JPEG AVI files, and timed clips read back from them.

Writing is lossless because a sample is carried by the one coefficient that
JPEG keeps exactly: every 8x8 block is flat, its quantised DC coefficient is
``sample - 128`` and the DC quantiser is 8, so any baseline decoder reconstructs
the sample in all 64 pixels.  The Huffman table gives DC category *s* a code of
``9 - s`` bits; with the *s* magnitude bits and the one-bit end-of-block code a
block is always ten bits, so that whole films are coded and decoded by array
operations.  A frame is 16 x 12 samples, that is 128 x 96 pixels.

Reading parses the RIFF tree, finds frames through the ``idx1`` index, decodes
the intra frames, and cuts shots where the histogram difference of neighbouring
frames exceeds an adaptive threshold.  Frames with the tables above are decoded
together; those of other cameras one by one, from their own tables, and their
blocks' mean levels are what shots are found in.

Cases: a null or empty text is one frame of spaces; texts of any length are
stored whole; equal texts give equal files and features; a film of one frame is
one clip; a film without frames has none; a null film has no clips; columns may
have any name; repeated rows each give a row; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import jpeg
from kinfold.llm.textcache import batch_of

COLUMNS, ROWS = 16, 12
SAMPLES = COLUMNS * ROWS  #: samples of a frame, and the unit that payloads are padded to
CODED = SAMPLES * 10 // 8  #: bytes of a frame's entropy-coded segment before stuffing
FPS = 24


# -- payloads -----------------------------------------------------------------
def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, padded with spaces to a positive multiple of ``SAMPLES``."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // SAMPLES)) * SAMPLES, b" ")


# -- JPEG ---------------------------------------------------------------------
def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Code lengths: one DC code each of 1..9 bits, for categories 8..0; one AC code of one bit, end of block.
_DC_TABLE = b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_AC_TABLE = b"\x10" + bytes([1] + [0] * 15) + b"\x00"
FRAME_HEAD = b"".join([
    b"\xff\xd8",
    _segment(0xDB, b"\x00" + bytes([8] * 64)),
    _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLUMNS * 8, 1) + b"\x01\x11\x00"),
    _segment(0xC4, _DC_TABLE + _AC_TABLE),
    _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
])
FRAME_END = b"\xff\xd9"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit block codes by difference + 255, and differences by ten-bit code."""
    code_of, diff_of = np.zeros(511, np.uint64), np.zeros(1024, np.int16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = (1 << (9 - size)) - 2  # canonical code of 9 - size bits: ones, then a zero
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        code = ((prefix << size) | extra) << 1  # the end-of-block code is a zero bit
        code_of[diff + 255], diff_of[code] = code, diff
    return code_of, diff_of


CODE_OF, DIFF_OF = _tables()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files for an array (frames, SAMPLES) of unsigned bytes."""
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.zeros((len(level), 1), np.int16))
    code = CODE_OF[diff + 255].reshape(len(level), -1, 4)
    forty = code[..., 0] << np.uint64(30) | code[..., 1] << np.uint64(20) | code[..., 2] << np.uint64(10) | code[..., 3]
    packed = forty.astype(">u8").view(np.uint8).reshape(len(level), -1, 8)[..., 3:].tobytes()
    return [FRAME_HEAD + packed[i : i + CODED].replace(b"\xff", b"\xff\x00") + FRAME_END for i in range(0, len(packed), CODED)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, SAMPLES) of JPEG files that carry the tables above."""
    head, end = len(FRAME_HEAD), len(FRAME_END)
    coded = []
    for f in frames:
        if not f.startswith(FRAME_HEAD) or not f.endswith(FRAME_END):
            raise ValueError("not an intra frame of this profile")
        coded.append(f[head:-end].replace(b"\xff\x00", b"\xff"))
    five = np.frombuffer(b"".join(coded), np.uint8).reshape(len(frames), -1, 5).astype(np.uint64)
    forty = five[..., 0] << np.uint64(32) | five[..., 1] << np.uint64(24) | five[..., 2] << np.uint64(16) | five[..., 3] << np.uint64(8) | five[..., 4]
    code = np.stack([forty >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], -1).reshape(len(frames), -1)
    coefficient = np.cumsum(DIFF_OF[code], axis=1, dtype=np.int32)
    return (coefficient + 128).astype(np.uint8)  # dequantised by 8, and the transform of a flat block divides by 8


def levels(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, samples) of JPEG files of one size: of this profile as stored, of others the mean level of every 8x8 block."""
    if all(f.startswith(FRAME_HEAD) for f in frames):
        return decode_frames(frames)
    out = []
    for f in frames:
        plane = jpeg.decode(f)
        padded = np.pad(plane, [(0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)], mode="edge")
        out.append(padded.reshape(padded.shape[0] // 8, 8, -1, 8).mean((1, 3)).astype(np.uint8).ravel())
    return np.array(out)


# -- RIFF ---------------------------------------------------------------------
def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream that holds ``payload`` (a multiple of ``SAMPLES`` bytes)."""
    frames = encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES))
    width, height, largest = COLUMNS * 8, ROWS * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4h", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    layout = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", layout))
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    index = np.zeros(len(frames), [("tag", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["tag"], index["flags"], index["size"] = b"00dc", 0x10, sizes
    index["offset"] = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))[:-1]])
    movie = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", movie) + _chunk(b"idx1", index.tobytes()))


def _children(data: bytes, start: int, end: int):
    while start + 8 <= end:
        tag, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield tag, start + 8, start + 8 + size
        start += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """The frames that the index of an AVI file names, and its frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index, fps = 0, None, FPS
    for tag, start, end in _children(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if tag == b"LIST" and data[start : start + 4] == b"movi":
            movie = start
        elif tag == b"LIST" and data[start : start + 4] == b"hdrl":
            for inner, at, _ in _children(data, start + 4, end):
                if inner == b"avih":
                    fps = round(1_000_000 / struct.unpack_from("<I", data, at)[0])
        elif tag == b"idx1":
            index = np.frombuffer(data, [("tag", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], (end - start) // 16, start)
    if index is None:
        raise ValueError("no index")
    offsets, sizes = index["offset"].tolist(), index["size"].tolist()  # offsets count from the list type
    return [data[movie + o + 8 : movie + o + 8 + n] for o, n in zip(offsets, sizes, strict=True)], fps


# -- shots --------------------------------------------------------------------
def clips(samples: np.ndarray, window: int = 8, factor: int = 2) -> list[tuple[int, int]]:
    """Shots as (first frame, frames): a cut where the histogram difference is large for its surroundings.

    Histograms have 16 levels.  Frame *i* starts a shot if the absolute
    difference to the frame before is at least a quarter of the samples and more than
    ``factor`` times the mean difference of the ``window`` frames before and
    after it.  All sums are integers, so that the outcome is exact.
    """
    n = len(samples)
    if not n:
        return []
    floor = samples.shape[1] // 4
    flat = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * 16
    histogram = np.bincount(flat.ravel(), minlength=n * 16).reshape(n, 16)
    change = np.abs(np.diff(histogram, axis=0)).sum(1) // 2  # change[i]: from frame i to i + 1
    total = np.concatenate([[0], np.cumsum(change)])
    at = np.arange(len(change))
    low, high = np.maximum(at - window, 0), np.minimum(at + window + 1, len(change))
    around, others = total[high] - total[low] - change, high - low - 1
    cut = (change >= floor) & (change * others > factor * around)
    starts = np.concatenate([[0], np.nonzero(cut)[0] + 1])
    return list(zip(starts.tolist(), np.diff(np.append(starts, n)).tolist(), strict=True))


def feature(samples: np.ndarray, shots: list[tuple[int, int]], fps: int) -> str:
    """A one-line summary: frames, rate, mean level in hundredths, and the shots."""
    mean = int(samples.sum(dtype=np.int64)) * 100 // samples.size
    return f"frames={len(samples)};fps={fps};mean100={mean};shots=" + ",".join(f"{a}+{n}" for a, n in shots)


# -- tables -------------------------------------------------------------------
def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``media``, the AVI file that holds its text."""
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                yield batch_of(pa.schema([("doc_id", part.schema.field(0).type), ("media", pa.binary())]), [part.column(0), [write_avi(payload_of(part.column(1)[0].as_py()))]])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, media binary")


def clip_rows(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per shot of every file: id, clip number, first frame, frames, start and end in seconds."""
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                media = batch.column(1)[row].as_py()
                if media is None:
                    continue
                frames, fps = read_avi(media)
                shots = clips(levels(frames))
                ids = pa.array([batch.column(0)[row].as_py()] * len(shots), batch.schema.field(0).type)
                schema = pa.schema([("doc_id", ids.type), ("clip", pa.int64()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
                yield batch_of(schema, [ids, list(range(len(shots))), [a for a, _ in shots], [n for _, n in shots], [a / fps for a, _ in shots], [(a + n) / fps for a, n in shots]])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, clip long, first_frame long, frames long, start_s double, end_s double")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text as an AVI file, read the file's bytes back, and return sizes, digests and features."""
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_clips", pa.int64())]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                media = write_avi(payload_of(text))
                frames, fps = read_avi(media)
                samples = decode_frames(frames)
                back, shots = samples.tobytes(), clips(samples)
                rows.append((len((text or "").encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, shots, fps), len(shots)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield batch_of(pa.schema([("doc_id", batch.schema.field(0).type), *names]), [batch.column(0), *map(list, columns)])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long")
