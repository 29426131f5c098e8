"""Token identifiers in a Re-Pair compressed, randomly accessible store.

Documents are put in ascending id order, cut into shards, encoded, and every
shard is compressed on its own by Re-Pair: adjacent pairs of ids are replaced by
nonterminals, the frequent ones first, until no pair occurs ``MIN_COUNT``
times; first inside the distinct parts (words, marks, digits) of the shard,
weighted by how often each occurs, and then across parts.  A pair of two equal ids is replaced from the
left of each run.  A shard's file holds the rules, the length of every rule's
expansion, the final sequence, and running sums of expansion lengths at every
``STRIDE``-th symbol, so that a range of tokens is decoded by expanding the
symbols that cover it and no others.  The end id never enters a rule, so
documents stay aligned with the sequence.

A shard is one binary value in the layout of :func:`pack`; Spark's Parquet
writer commits shards, so retried or lost tasks leave no partial files, and any
file system that Spark writes to will do.

Cases: null texts count as empty and hold the end id alone; rows are ordered by
id, then text, so repeated ids keep a defined order (null ids first); columns
may have any name; texts of any length are encoded whole; an empty table makes
an empty store.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.durable import durable
from kinfold.llm.textcache import batch_of, held

END = 1
MAGIC = b"KFRP1\x00\x00\x00"
SHARD_CHARS = 6_500_000
MIN_COUNT = 16
STRIDE = 256
#: What the way by parts relies on in the vocabulary file. Fixed values.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


# -- encoding -----------------------------------------------------------------
class PartEncoder:
    """The tokenizers library's ids, part by part where that is the same as the whole text.

    Normalisation of the vocabulary changes letters one by one, and its
    pre-tokenisation cuts texts into parts that its model codes on their own.
    Texts made only of printable ASCII, line ends, tabs and precomposed Latin-1
    letters, without a special token's brackets, are cut here and their parts
    given to the library's model; any other text goes through the library
    whole, and so do all texts if the vocabulary file normalises or splits in
    another way.

    It numbers the parts met so far; ``ids`` holds their ids one after the
    other, ``ends`` where those of each end.  Number 0 is the end id.  Parts of
    up to 16 characters, as two integers, are found by binary search in arrays
    that are sorted by a mix of both; longer ones, and those whose mix another
    part has, are found in a dictionary.
    """

    SAFE = re.compile("[\t\n -~À-ÖØ-öø-ÿ]*")
    MOST, MOST_LONG, MOST_IDS = 800_000, 100_000, 8_000_000  #: parts, parts in the dictionary, and ids, after which a shard begins with no parts

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        by_part = (form.get("normalizer") or {}).get("normalizers") == NORMALIZER and ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0] == SPLIT
        self.by_part = by_part and all(t["content"].startswith("<|") and not t["single_word"] for t in form.get("added_tokens", ()))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level text
        rest = [b for b in range(256) if b not in plain]
        self.letter = np.arange(256, dtype="<u2")  # of byte-level text, but line ends stay, which no part has
        self.letter[rest] = 256 + np.arange(len(rest))
        self.letter[10] = 10
        self.forget()

    def forget(self) -> None:
        self.ids, self.ends = array("i", [END]), array("q", [1])
        self.mixed, self.low, self.high = np.array([[2**64 - 1], [0], [0]], np.uint64)  # behind all others, and no part's
        self.number, self.long = np.zeros(1, np.int32), {}

    def __len__(self) -> int:
        return len(self.ends) - 1

    def full(self) -> bool:
        return len(self) > self.MOST or len(self.long) > self.MOST_LONG or len(self.ids) > self.MOST_IDS

    def items(self) -> Iterator[tuple[str, int]]:
        """Every part with its number."""
        for low, high, number in zip(self.low[:-1].tolist(), self.high[:-1].tolist(), self.number[:-1].tolist(), strict=True):
            yield struct.pack("<2Q", low, high).rstrip(b"\0").decode("latin-1"), number
        yield from self.long.items()

    def _add(self, parts: list[str]) -> range:
        """The numbers of parts that have none yet."""
        if parts:
            mapped = self.letter[np.frombuffer("\n".join(parts).encode("utf-8"), np.uint8)].tobytes().decode("utf-16-le")
            for part in mapped.split("\n"):
                self.ids.extend([t.id for t in self.tokenize(part)])
                self.ends.append(len(self.ids))
        return range(len(self.ends) - len(parts), len(self.ends))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all parts of texts that are ``safe``, and how many parts each text has.

        Equal parts are found by sorting, so that a shard looks each up once,
        all at a time; longer ones are asked for one by one.
        """
        joined = "\n".join(texts).lower()
        data = np.frombuffer(joined.encode("latin-1") + bytes(32), np.uint8)
        starts, ends = _cut(data[:-32])
        sizes = ends - starts
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from every place on
        low, high = words[starts] & _MASK[np.minimum(sizes, 8)], words[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
        mixed = (low ^ (high * _ODD)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)
        low, high = low[order], high[order]
        new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(order)]
        long = sizes[order] > 16
        new |= long
        new[1:] |= long[:-1]
        first = order[new]
        found = self._found(mixed[first], low[new], high[new], long[new], joined, starts[first], ends[first])
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(found, np.diff(np.append(np.flatnonzero(new), len(order))))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return out, np.diff(np.searchsorted(starts, bounds), prepend=0)

    def _found(self, mixed: np.ndarray, low: np.ndarray, high: np.ndarray, long: np.ndarray, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the parts of ``joined`` from ``starts`` to ``ends``, in ascending order of ``mixed``; new parts get one."""

        def texts(at: np.ndarray) -> list[str]:
            return [joined[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        place = np.searchsorted(self.mixed, mixed)
        taken = self.mixed[place] == mixed
        known = taken & (self.low[place] == low) & (self.high[place] == high)
        apart = long | taken & ~known
        same = mixed[1:] == mixed[:-1]
        apart[1:] |= same
        apart[:-1] |= same
        out = self.number[place].astype(np.int64)
        new, apart = np.flatnonzero(~(known | apart)), np.flatnonzero(apart)
        out[new] = self._add(texts(new))
        self.mixed, self.low, self.high, self.number = (np.insert(x, place[new], y[new]) for x, y in ((self.mixed, mixed), (self.low, low), (self.high, high), (self.number, out)))
        others = texts(apart)
        missing = [part for part in dict.fromkeys(others) if part not in self.long]
        self.long.update(zip(missing, self._add(missing), strict=True))
        out[apart] = [self.long[part] for part in others]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def safe(self, text: str) -> bool:
        return self.by_part and "<|" not in text and self.SAFE.fullmatch(text) is not None


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of lower-case Latin-1 text start and end: runs of letters, single digits, runs of other marks, and an apostrophe that begins a part with the endings after it."""
    kind = _CLASS[data]
    before = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)[: len(kind)]
    edge = (kind != before) | (kind == _DIGIT)
    after = np.concatenate([data, np.zeros(3, np.uint8)])
    at = np.flatnonzero((data == 39) & (before != _OTHER))
    one, two = after[at + 1], after[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    edge[at[short | long] + 1] = False
    after_ending = np.concatenate([at[short] + 2, at[long] + 3])
    edge[after_ending[after_ending < len(edge)]] = True
    starts = np.flatnonzero(edge & (kind != _SPACE))
    ends = np.append(np.flatnonzero(edge), len(data))
    return starts, ends[np.searchsorted(ends, starts, side="right")]


def encoder(path: str) -> PartEncoder:
    return held("tokenstore", path, lambda: PartEncoder(path))


# -- Re-Pair ------------------------------------------------------------------
BUCKETS = 1 << 18  #: of a first, rough count of pairs


class _Sequence:
    """Symbols with links to their neighbours, in which pairs are replaced."""

    def __init__(self, symbols: np.ndarray, joined: np.ndarray, weight: np.ndarray | None, least: int):
        """joined[i]: symbols i and i + 1 may become one; weight: how often each symbol counts."""
        n = len(symbols)
        self.end, self.least, self.weight = n, least, weight
        self.symbol = symbols.astype(np.int64)
        self.after = np.append(np.where(joined, np.arange(1, n), n), n) if n else np.zeros(0, np.int64)
        self.before = np.full(n + 1, n)
        self.before[1:n][joined] = np.nonzero(joined)[0]
        self.open = np.nonzero(joined)[0]  # where a pair starts that may be frequent

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.after[at]]

    def _counted(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``at`` and ``keys`` without every second place of a run of equal symbols, pairs that can be replaced together; and the places left out."""
        run = np.nonzero(keys >> 32 == keys & 0xFFFFFFFF)[0]
        if not len(run):
            return at, keys, at[:0]
        own = at[run]
        starts = np.append(True, self.after[own[:-1]] != own[1:])
        number = np.arange(len(own))
        odd = (number - np.maximum.accumulate(np.where(starts, number, 0))) & 1 == 1
        stay = np.ones(len(at), bool)
        stay[run[odd]] = False
        return at[stay], keys[stay], at[~stay]

    def step(self, first: int) -> list[tuple[int, int]]:
        """Replaces frequent pairs that do not touch one another by symbols from ``first`` on; returns the pairs."""
        at = self.open
        keys = self._pairs(at)
        bucket = (keys * 0x9E3779B97F4A7C1 >> 40) & (BUCKETS - 1)
        rough = np.bincount(bucket, self.weight[at] if self.weight is not None else None, BUCKETS)[bucket] >= self.least
        at, keys = at[rough], keys[rough]
        places, keys_of, skipped = self._counted(at, keys)
        order = np.argsort(keys_of)
        places, ranked = places[order], keys_of[order]
        starts = np.nonzero(np.append(True, ranked[1:] != ranked[:-1]))[0] if len(ranked) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(ranked)))
        counts = sizes if self.weight is None else np.add.reduceat(self.weight[places], starts) if len(starts) else sizes
        found = ranked[starts]
        frequent = counts >= self.least
        number, lefts, rights, pairs = np.full(len(found), -1), set(), set(), []
        candidates = np.nonzero(frequent)[0]
        candidates = candidates[np.lexsort((found[candidates], -counts[candidates]))]
        for i, key in zip(candidates.tolist(), found[candidates].tolist(), strict=True):
            a, b = key >> 32, key & 0xFFFFFFFF
            if a not in rights and b not in lefts and (a != b or a not in lefts and a not in rights):
                number[i] = first + len(pairs)
                pairs.append((a, b))
                lefts.add(a)
                rights.add(b)
        if not pairs:
            self.open = places[:0]
            return pairs
        new = np.repeat(number, sizes)
        left, new = places[new >= 0], new[new >= 0]
        right = self.after[left]
        beyond = self.after[right]
        self.symbol[left], self.symbol[right] = new, -1
        self.after[left], self.before[beyond] = beyond, left
        # A pair that is not frequent can only get rarer; the others, and those beside new symbols, are looked at again.
        again = places[np.repeat(frequent & (number < 0), sizes)]
        beside = np.sort(np.concatenate([again, skipped, left, self.before[left]]))
        beside = beside[np.append(True, beside[1:] != beside[:-1]) & (beside < self.end)]
        self.open = beside[(self.symbol[beside] >= 0) & (self.after[beside] < self.end)]
        return pairs

    def replace_all(self, base: int, rules: list[tuple[int, int]]) -> np.ndarray:
        """Appends to ``rules`` until no pair is frequent; returns which symbols are left."""
        while len(self.open):
            rules += self.step(base + len(rules))
        return self.symbol >= 0


def repair(words: list[np.ndarray], order: np.ndarray, base: int, end: int = END, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and the final sequence for the concatenation of ``words[order[i]]``.

    Symbols from ``base`` up are nonterminals; rule *i* defines ``base + i``.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return _repair(np.concatenate([np.zeros(0, np.int64), *words]), sizes, order, base, end, least)


def _repair(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray, base: int, end: int = END, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    rules: list[tuple[int, int]] = []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    times = np.bincount(order, minlength=len(sizes))
    inside = _Sequence(flat, (owner[:-1] == owner[1:]) & (flat[:-1] != end) & (flat[1:] != end), times[owner], least)
    stay = inside.replace_all(base, rules)
    sizes = np.bincount(owner[stay], minlength=len(sizes))
    symbols = _gather(inside.symbol[stay], np.cumsum(sizes) - sizes, sizes, order)
    across = _Sequence(symbols, (symbols[:-1] != end) & (symbols[1:] != end), None, least)
    stay = across.replace_all(base, rules)
    return np.array(rules, np.int64).reshape(-1, 2), across.symbol[stay]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[starts[i] : starts[i] + sizes[i]]`` for i in ``order``."""
    n = sizes[order]
    ends = np.cumsum(n)
    step = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[step + np.repeat(starts[order] - (ends - n), n)]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[base + i] = out[a] + out[b]
    return out[base:]


# -- the file -----------------------------------------------------------------
def pack(rules: np.ndarray, sequence: np.ndarray, doc_tokens: np.ndarray, base: int) -> bytes:
    """Header (magic, base, rules, symbols, documents, tokens, bytes of a symbol), rules, expansion lengths, tokens of each document, tokens before every ``STRIDE``-th symbol, sequence (its low 16 bits, then, if symbols have more, its high ones)."""
    lengths = expansion_lengths(rules, base)
    sizes = np.concatenate([np.ones(base, np.int64), lengths])[sequence]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<6Q", base, len(rules), len(sequence), len(doc_tokens), int(doc_tokens.sum()), width)
    before = (np.cumsum(sizes) - sizes)[::STRIDE]
    return head + b"".join(x.tobytes() for x in (rules.astype("<u4"), lengths.astype("<u4"), doc_tokens.astype("<u4"), before.astype("<u8"), sequence.astype("<u2"), (sequence >> 16).astype("<u2") if width > 2 else sequence[:0]))


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.base, rules, symbols, docs, self.n_ids, width = struct.unpack_from("<6Q", data, 8)
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.doc_tokens = take("<u4", docs)
        self.before = take("<u8", -(-symbols // STRIDE))
        self.sequence = take("<u2", symbols)
        if width > 2:
            self.sequence = self.sequence | take("<u2", symbols).astype(np.uint32) << 16

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.base]
        return out

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``end``; only the symbols that cover them are expanded."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        if 8 * (end - start) > self.n_ids:  # every rule is expanded once, then the symbols are looked up
            rules, _ = self._expanded(self.rules.ravel().astype(np.int64))
            sizes = np.concatenate([np.ones(self.base, np.int64), self.lengths])
            flat = np.concatenate([np.arange(self.base, dtype=np.uint32), rules])
            return _gather(flat, np.cumsum(sizes) - sizes, sizes, self.sequence)[start:end]
        first, last = np.searchsorted(self.before, [start, end - 1], side="right") - 1
        out, at = self._expanded(self.sequence[first * STRIDE : (last + 1) * STRIDE].astype(np.int64), start - int(self.before[first]), end - int(self.before[first]))
        return out[start - int(self.before[first]) - at :][: end - start]

    def _expanded(self, symbols: np.ndarray, start: int = 0, end: int | None = None) -> tuple[np.ndarray, int]:
        """Tokens of ``symbols``, those that cover ``start`` to ``end`` if given, and how many were left out before them."""
        at = 0
        while True:
            if end is not None:
                sizes = self._sizes(symbols)
                ends = at + np.cumsum(sizes)
                a, b = np.searchsorted(ends, [start, end - 1], side="right")
                at = int(ends[a] - sizes[a])
                symbols = symbols[a : b + 1]
            rule = symbols >= self.base
            if not rule.any():
                return symbols.astype(np.uint32), at
            out = np.repeat(symbols, 1 + rule)
            left = np.nonzero(rule)[0] + np.arange(int(rule.sum()))
            pairs = self.rules[symbols[rule] - self.base]
            out[left], out[left + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out

    def document(self, i: int) -> np.ndarray:
        end = int(self.doc_tokens[: i + 1].sum(dtype=np.int64))
        return self.ids(end - int(self.doc_tokens[i]), end)


# -- tables -------------------------------------------------------------------
class _Builder:
    """Collects documents up to a shard's size."""

    def __init__(self, code: PartEncoder):
        self.code, self.base = code, code.tokenizer.get_vocab_size()
        self.reset()

    def reset(self) -> None:
        if self.code.full():
            self.code.forget()
        self.whole: list[np.ndarray] = []  # texts that the library coded, one part each
        self.safe: list[str] = []  # the others
        self.is_safe: list[bool] = []
        self.doc_ids: list = []
        self.n_chars = 0

    def add(self, doc_id, text: str | None) -> None:
        text = text or ""
        self.is_safe.append(self.code.safe(text))
        if self.is_safe[-1]:
            self.safe.append(text)
        else:
            self.whole.append(self.code.whole(text))
        self.doc_ids.append(doc_id)
        self.n_chars += len(text) + 1

    def finish(self) -> tuple[list, int, bytes]:
        parts, counts = self.code.numbers(self.safe)
        is_safe = np.array(self.is_safe)
        of_doc = np.ones(len(is_safe), np.int64)
        of_doc[is_safe] = counts
        last = np.cumsum(of_doc + 1) - 1  # the end id's place
        order = np.zeros(int(last[-1]) + 1, np.int64)  # number 0 is the end id
        order[last[~is_safe] - 1] = -1 - np.arange(len(self.whole))
        inner = np.repeat(is_safe, of_doc + 1)
        inner[last] = False
        order[inner] = parts
        known = order >= 0
        used = np.zeros(len(self.code.ends), bool)
        used[order[known]] = True
        place = np.cumsum(used) - 1  # numbers within the shard
        order = np.where(known, place[np.where(known, order, 0)], place[-1] - order)
        ends = np.array(self.code.ends)
        starts, numbers = np.append(0, ends[:-1]), np.flatnonzero(used)
        flat = _gather(np.array(self.code.ids), starts, ends - starts, numbers).astype(np.int64)
        flat = np.concatenate([flat, *self.whole])
        sizes = np.append((ends - starts)[numbers], [len(w) for w in self.whole]).astype(np.int64)
        tokens = np.diff(np.cumsum(sizes[order])[last], prepend=0)
        out = self.doc_ids, int(tokens.sum()), pack(*_repair(flat, sizes, order, self.base), tokens, self.base)
        self.reset()
        return out


def write_store(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Shards of all rows in ascending id order, written to the shared folder and read back.

    One range shuffle by id.  A row is a shard: ``part`` (ascending id ranges),
    ``before`` (ids of the part's shards before it), ``doc_ids``, ``n_ids``, and
    the packed ``data``.
    """
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        builder, before = _Builder(encoder(tokenizer_path)), 0
        part = TaskContext.get().partitionId()
        kind = None

        def shard():
            nonlocal before
            doc_ids, n_ids, data = builder.finish()
            schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(kind)), ("n_ids", pa.int64()), ("data", pa.binary())])
            before += n_ids
            return batch_of(schema, [[part], [before - n_ids], [doc_ids], [n_ids], [data]])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                builder.add(doc_id, text)
                if builder.n_chars >= shard_chars:
                    yield shard()
        if builder.doc_ids:
            yield shard()

    ordered = picked.repartitionByRange(picked["doc_id"]).sortWithinPartitions("doc_id", "text")
    return durable(ordered.mapInArrow(run, f"part int, before long, doc_ids array<{id_type}>, n_ids long, data binary"), "token-shards")


def read_store(store: DataFrame) -> DataFrame:
    """Per document: id, ``start`` (tokens of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Running sums over the parts need one row a part, of which there are as many
    as shuffle partitions; these rows are broadcast, and shards are not shuffled.
    """
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    first = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("first"))
    joined = store.join(F.broadcast(first), "part").select("doc_ids", (F.col("before") + F.col("first")).alias("offset"), "data")
    id_type = store.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ids, raw = batch.column(0)[row].as_py(), shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.doc_tokens, dtype=np.int64)
                starts = ends - shard.doc_tokens
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
                yield batch_of(schema, [pa.array(ids, kind), starts + batch.column(1)[row].as_py(), ends - starts, crc])

    return joined.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
