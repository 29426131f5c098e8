"""Bounded memo tables and exact cut points for tokenizers.

A tokenizer that never joins text across a certain boundary can be applied to
the parts separately.  Parts repeat, so each Python worker keeps a table from
part to result; the table is emptied when it reaches its bound, which limits
memory and cannot change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Code points with the Unicode property White_Space; fixed values of the standard.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Characters of text handled between two flushes of a batch.
FLUSH_CHARS = 1_000_000


_held: dict = {}
_owner = ""


def only(owner: str) -> None:
    """From now on this Python worker keeps tables of ``owner`` alone: workers outlive stages, and operators."""
    global _owner
    if owner != _owner:
        _held.clear()
        _owner = owner


def held(owner: str, key, make: Callable):
    """What ``make`` has made for ``key`` in this worker, kept until another operator's turn."""
    only(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make``.

    ``trim`` bounds the memory: after ``bound`` bytes, as estimated, the entries
    become an older generation, which replaces the one before it; an older
    entry that is asked for moves back.  Keys over ``LONG`` characters are
    forgotten at every ``trim``.
    """

    LONG, ENTRY = 64, 200  #: characters; bytes that an entry takes beside its key's and value's own

    def __init__(self, make: Callable | None, bound: int = 48_000_000):
        super().__init__()
        self.make, self.bound, self.used, self.older, self.long = make, bound // 2, 0, {}, []

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self[key] = value
        if len(key) > self.LONG:
            self.long.append(key)
        else:
            self.used += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)

    def missing(self, keys: set) -> list:
        """Those of ``keys`` without a value; the others can be read, whichever generation holds them."""
        new = keys.difference(self)
        if self.older:
            for key in new.intersection(self.older):
                self.put(key, self.older[key])
                new.discard(key)
        return list(new)

    def trim(self) -> None:
        for key in self.long:
            self.pop(key, None)
        self.long.clear()
        if self.used > self.bound:
            self.older, self.used = dict(self), 0
            self.clear()


def groups(texts: list[str | None], limit: int = FLUSH_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
