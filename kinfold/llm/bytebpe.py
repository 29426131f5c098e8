"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Texts are cut into pre-tokens on arrays of character classes, and equal
pre-tokens of a batch are found by sorting, so that the memo from pre-token to
ids is asked once for each.  Distinct pre-tokens of a batch are put, by length, into padded integer
matrices.  In each round every row merges its leftmost minimum-rank pair; the
row closes up, only the two pairs beside the merge are looked up again in a
hash table of pairs, and rows without a mergeable pair leave the matrix.  In
matrices wider than ``WIDE`` a round goes on from the left with the row's other
pairs of the same rank, as the next rounds would, unless the merged id takes
part in a pair of lower rank, which would have to go first.

Cases: a null text counts as empty; an empty text has no ids and decodes to
empty bytes; repeated rows each give a row; an empty table gives an empty
table; pre-tokens of any length are rows of a matrix.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.textcache import batch_of, groups, held

NONE = np.int32(2**31 - 1)
WIDE = 64
CELLS = 1_000_000
#: The pattern that is followed on arrays; texts are matched one by one with any other. Fixed value.
ARRAYS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _SPACE, _LETTER, _NUMBER, _BREAK = range(5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        bits = max(8, int(len(keys) * 2.5).bit_length())
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where the pair is absent or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.nonzero((left.ravel() >= 0) & (right.ravel() >= 0))[0]
        slot = self._slot(keys[todo])
        while len(todo):
            seen = self.keys[slot]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go_on = ~hit & (seen != -1)
            todo, slot = todo[go_on], (slot[go_on] + 1) & self.mask
        return out.reshape(left.shape)


def early(left: np.ndarray, right: np.ndarray, merged: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` ids take part in a pair that merges to a lower one."""
    out = np.zeros(n, bool)
    out[left[merged < left]] = True
    out[right[merged < right]] = True
    return out


def classes() -> np.ndarray:
    """Of every code point whether it is white space, a letter, a number or anything else."""
    import regex

    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, run in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(run, every):
            out[found.start() : found.end()] = kind
    return out


def _cut(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of ``ARRAYS`` start and end; the last character and those between texts are breaks.

    Runs of a kind, but: a contraction begins at an apostrophe where no match
    is under way; white space before something else leaves its last character
    out, which is a match of its own or, if a blank, begins the next one.
    """
    edge = np.append(True, kind[1:] != kind[:-1])
    at = np.flatnonzero(code == 39)
    at = at[(at == 0) | (kind[at - 1] != _OTHER) & (code[at - 1] != 32)]
    one, two = code[at + 1], code[np.minimum(at + 2, len(code) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    edge[at[short | long] + 1] = False
    edge[at[short] + 2] = True
    edge[at[long] + 3] = True
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _BREAK))
    edge[last] = True
    edge[last[code[last] == 32] + 1] = False
    edges = np.flatnonzero(edge)
    inside = kind[edges] != _BREAK
    return edges[inside], np.append(edges[1:], len(code))[inside]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[starts[i] : starts[i] + sizes[i]]``."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class ByteBpe:
    MOST, LONG = 300_000, 64  #: pre-tokens after which a batch begins with an empty memo; bytes of those that are forgotten after their batch

    def __init__(self, rank_path: str, pattern: str):
        import regex

        with open(rank_path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.token[i] = token
        rank = self.rank
        splits = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, merged = np.array(splits, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.first = early(left, right, merged, len(self.token))
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.pattern, self.classes = regex.compile(pattern), classes() if pattern == ARRAYS else None
        sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.token_bytes, self.token_sizes, self.token_starts = np.frombuffer(b"".join(self.token), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.forget()

    def forget(self) -> None:
        """Empties the memo, which numbers pre-tokens; ``ids`` holds their ids one after the other, ``ends`` where those of each end."""
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    # -- merging ---------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string, each merged on its own."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) < 2:
                out[i] = self.byte_id[np.frombuffer(p, np.uint8)]
            else:
                buckets.setdefault(4 if len(p) <= 4 else (len(p) + 3) // 4 * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            for at in range(0, len(members), max(1, CELLS // width)):
                part = members[at : at + max(1, CELLS // width)]
                merge = self._merge_rows if width <= WIDE else self._merge_wide_rows
                for i, ids in zip(part, merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ranks of the pairs that start at each id, and sizes; the last column stays padding."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        cells = np.full((len(rows), width + 1), -1, np.int32)
        cells[:, :width][np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((len(rows), width + 1), NONE, np.int32)
        ranks[:, :width] = self.pairs.find(cells[:, :-1], cells[:, 1:])
        return cells, ranks, sizes

    def _merge_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        cells, ranks, sizes = self._matrix(rows, width)
        done: list = [None] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(alive)), at]
            stop = best == NONE
            if stop.any():
                for r in np.nonzero(stop)[0].tolist():
                    done[alive[r]] = cells[r, : sizes[r]].copy()
                keep = ~stop
                alive, cells, ranks, sizes, at, best = alive[keep], cells[keep], ranks[keep], sizes[keep], at[keep], best[keep]
                if not len(alive):
                    break
            sizes -= 1
            used = int(sizes.max()) + 1
            behind = np.arange(used) > at[:, None]  # the row closes up behind the merge
            cells = np.where(behind, cells[:, 1 : used + 1], cells[:, :used])
            ranks = np.where(behind, ranks[:, 1 : used + 1], ranks[:, :used])
            cells[:, -1], ranks[:, -1] = -1, NONE
            row = np.arange(len(alive))
            cells[row, at] = best
            has = np.nonzero(at > 0)[0]
            touched, place = np.concatenate([row, has]), np.concatenate([at, at[has] - 1])
            ranks[touched, place] = self.pairs.find(cells[touched, place], cells[touched, place + 1])
        return done

    def _merge_wide_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        cells, ranks, sizes = self._matrix(rows, width)
        done: list = [None] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            best = ranks.min(1)
            stop = best == NONE
            if stop.any():
                for r in np.nonzero(stop)[0].tolist():
                    done[alive[r]] = cells[r, : sizes[r]].copy()
                keep = ~stop
                alive, cells, ranks, sizes, best = alive[keep], cells[keep], ranks[keep], sizes[keep], best[keep]
                if not len(alive):
                    break
            row, at = np.nonzero(ranks == best[:, None])
            number = np.arange(len(row))
            new = np.append(True, row[1:] != row[:-1])
            start = np.maximum.accumulate(np.where(new | np.append(True, at[1:] != at[:-1] + 1), number, 0))
            merge = (number - start) & 1 == 0  # a run of equal ids merges in twos from its left
            merge &= new | ~self.first[best[row]]
            row, at = row[merge], at[merge]
            stay = np.arange(cells.shape[1]) < sizes[:, None]
            stay[row, at + 1] = False
            cells[row, at] = best[row]
            merged = np.zeros(cells.shape, bool)
            merged[row, at] = True
            sizes = stay.sum(1)
            inside = np.arange(int(sizes.max()) + 1) < sizes[:, None]
            shape = inside.shape
            new_cells, new_ranks, new_merged = np.full(shape, -1, np.int32), np.full(shape, NONE, np.int32), np.zeros(shape, bool)
            new_cells[inside], new_ranks[inside], new_merged[inside] = cells[stay], ranks[stay], merged[stay]
            cells, ranks = new_cells, new_ranks
            again = new_merged[:, :-1].copy()
            again[:, :-1] |= new_merged[:, 1:-1]
            touched, place = np.nonzero(again)
            ranks[touched, place] = self.pairs.find(cells[touched, place], cells[touched, place + 1])
        return done

    # -- texts -----------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        data, starts, ends, last = self._pre_tokens(texts)
        numbers, kept = self._numbers(data, starts, ends)
        sizes = np.diff(self.ends, prepend=0)
        first, n = self.ends - sizes, sizes[numbers]
        ids = _gather(self.ids, first[numbers], n).astype("<u4").tobytes()
        bounds = 4 * np.append(0, np.cumsum(n))[np.append(0, last)]
        self._trim(kept)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _pre_tokens(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 text, where its pre-tokens start and end, and how many there are up to each text's end."""
        if self.classes is None:
            found = [[m.encode("utf-8") for m in self.pattern.findall(t)] for t in texts]
            ends = np.cumsum([len(m) for f in found for m in f], dtype=np.int64)
            return b"".join(m for f in found for m in f), np.append(0, ends[:-1])[: len(ends)], ends, np.cumsum([len(f) for f in found], dtype=np.int64)
        joined = "".join([t + "\n" for t in texts])
        data = joined.encode("utf-8")
        plain = len(data) == len(joined)
        code = np.frombuffer(data, np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.classes[code]
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[breaks] = _BREAK
        starts, ends = _cut(code, kind)
        last = np.searchsorted(starts, breaks)
        if not plain:
            place = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # of each character's first byte
            starts, ends = place[starts], place[ends]
        return data, starts, ends, last

    def _numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
        """The memo's numbers of all pre-tokens, and how many of its numbers are to be kept.

        Pre-tokens of up to 16 bytes are compared as two integers and a size,
        longer ones are asked for one by one.
        """
        padded, sizes = data + bytes(16), ends - starts
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
        low, high = words[starts] & _MASK[np.minimum(sizes, 8)], words[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
        mixed = (low ^ ((high ^ sizes.astype(np.uint64)) * _ODD)) * _ODD
        order = np.argsort(mixed ^ (mixed >> np.uint64(29)))
        low, high, size = low[order], high[order], sizes[order]
        new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]))[: len(order)]
        long = size > 16
        new |= long
        new[1:] |= long[:-1]
        first = order[new]
        keys = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        get = self.number.get
        found = np.fromiter([get(k, -1) for k in keys], np.int64, len(keys))
        asked = [keys[i] for i in np.flatnonzero(found < 0).tolist()]
        miss = sorted(set(asked), key=len)
        self.number.update(zip(miss, range(len(self.ends), len(self.ends) + len(miss)), strict=True))
        found[found < 0] = [self.number[k] for k in asked]
        kept = len(self.ends) + sum(len(k) <= self.LONG for k in miss)
        if miss:
            coded = self.encode_pieces(miss)
            self.ids = np.concatenate([self.ids, *coded])
            self.ends = np.append(self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum([len(x) for x in coded]))
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(found, np.diff(np.append(np.flatnonzero(new), len(order))))
        return out, kept

    def _trim(self, kept: int) -> None:
        if kept > self.MOST:
            self.forget()
        while len(self.number) > kept:  # the long ones of this batch are the last
            self.number.popitem()
        self.ends = self.ends[:kept]
        self.ids = self.ids[: self.ends[-1] if len(self.ends) else 0]

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        return _gather(self.token_bytes, self.token_starts[at], self.token_sizes[at]).tobytes()


def codec(rank_path: str, pattern: str) -> ByteBpe:
    return held("bytebpe", (rank_path, pattern), lambda: ByteBpe(rank_path, pattern))


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``; no shuffle."""
    return _map(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), _encode_batches(rank_path, pattern), "ids binary, n_tokens long")


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text_bytes``, the bytes that ``ids`` stand for."""

    def run(batches):
        code = codec(rank_path, pattern)
        for b in batches:
            yield batch_of(pa.schema([("doc_id", b.schema.field(0).type), ("text_bytes", pa.binary())]), [b.column(0), [code.decode(x or b"") for x in b.column(1).to_pylist()]])

    return _map(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")), run, "text_bytes binary")


def digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Encode, decode what was encoded, and return counts and digests of both forms in one pass; ``keep`` are named columns to carry along."""
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *keep)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches):
        code = codec(rank_path, pattern)
        for batch in batches:
            whole = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in groups(whole):
                ids = code.encode_batch(whole[start:end])
                part = batch.slice(start, end - start)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                back = pa.array([hashlib.sha256(code.decode(x)).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, sha, back, *part.columns[2:]], names=[part.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256", *part.schema.names[2:]])

    fields = picked.schema.fields
    return picked.mapInArrow(run, T.StructType([fields[0], *added, *fields[2:]]))


def _pieces(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for start, end in groups(texts):
            yield batch.column(0).slice(start, end - start), texts[start:end]


def _encode_batches(rank_path: str, pattern: str):
    def run(batches):
        code = codec(rank_path, pattern)
        for b, texts in _pieces(batches):
            ids = code.encode_batch(texts)
            yield batch_of(pa.schema([("doc_id", b.type), ("ids", pa.binary()), ("n_tokens", pa.int64())]), [b, ids, [len(x) // 4 for x in ids]])

    return run


def _map(df: DataFrame, run, columns: str) -> DataFrame:
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {columns}")
