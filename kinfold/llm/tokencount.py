"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece of text form a doubly linked list; a heap holds every
adjacent pair whose concatenation is a vocabulary entry.  The best-ranked pair
(leftmost on ties) is popped again and again and its right symbol is unlinked.
The number of tokens is the number of initial symbols less the merges made: no
token identifier is ever produced.

Cases: a null text counts as empty; an empty text has 0 bytes and 0 tokens;
repeated rows each give a row; columns may have any name; an empty table gives
an empty table.  Texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import re
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.textcache import Memo, batch_of, held

#: What stands for a space in the pieces of the vocabulary file; a fixed value of the format.
SPACE_MARK = "▁"


def merges_made(symbols: list[str], rank: dict[str, float]) -> int:
    """How many merges apply to ``symbols`` when lower ranks go first, leftmost on ties."""
    text = list(symbols)
    heap = [(r, i, both) for i, both in enumerate(map(add, text, text[1:])) if (r := rank.get(both)) is not None]
    if not heap:
        return 0
    left, right, made, get, pop, push = [*range(-1, len(text) - 1)], [*range(1, len(text)), -1], 0, rank.get, heapq.heappop, heapq.heappush
    heapq.heapify(heap)
    while heap:
        _, i, joined = pop(heap)
        here, j = text[i], right[i]
        # An entry is out of date if one of the two has been merged into something else since.
        if not here or j < 0 or len(here) + len(text[j]) != len(joined) or here + text[j] != joined:
            continue
        text[i], text[j] = joined, ""
        made += 1
        right[i] = after = right[j]
        if after >= 0:
            left[after] = i
            both = joined + text[after]
            if (r := get(both)) is not None:
                push(heap, (r, i, both))
        before = left[i]
        if before >= 0:
            both = text[before] + joined
            if (r := get(both)) is not None:
                push(heap, (r, before, both))
    return made


class PieceCounter:
    """Counts as a byte-fallback piece model with identity normalisation does."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # A plain space stands in for the mark, so that most strings here keep one byte a character.
        self.rank = {model.id_to_piece(i).replace(SPACE_MARK, " "): -model.get_score(i) for i in ids}
        self.joins = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.chunks = self._chunk_pattern()
        self.fragment = Memo(self._count_fragment, 96_000_000)
        self.chunk = Memo(self._count_chunk, 32_000_000)

    def _chunk_pattern(self) -> re.Pattern | None:
        """Parts that no vocabulary entry reaches across, as far as a pattern can tell them.

        They end before a space, around a line end and after a run of letters,
        each only if the vocabulary allows it; ``_count_chunk`` cuts finer.
        """
        letters = "A-Za-zÀ-ÖØ-öø-ɏͰ-ӿ"
        letter = re.compile(f"[{letters}]")
        if any(a != " " and b == " " for a, b in self.joins):
            return None
        if any("\n" in pair for pair in self.joins):
            return re.compile(" *[^ ]+| +")
        if any(letter.match(a) and not letter.match(b) for a, b in self.joins):
            return re.compile(" *[^ \n]+| +|\n")
        return re.compile(f" *[^{letters} \n]*[{letters}]+| *[^{letters} \n]+| +|\n")

    def _count_fragment(self, piece: str) -> int:
        initial = sum(1 if c in self.rank else len(c.encode("utf-8")) for c in piece)
        return initial - merges_made(list(piece), self.rank)

    def _count_chunk(self, chunk: str) -> int:
        joins = self.joins
        cuts = [i for i, pair in enumerate(map(add, chunk, chunk[1:]), 1) if pair not in joins]  # no piece holds these two side by side
        if not cuts:
            return self.fragment[chunk]
        return sum(self.fragment[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (" " + text).replace(SPACE_MARK, " ")  # with the dummy prefix of the format
        total = self._count_chunk(text) if self.chunks is None else sum(map(self.chunk.__getitem__, self.chunks.findall(text)))
        self.chunk.trim()
        self.fragment.trim()
        return total


def counter(model_path: str) -> PieceCounter:
    return held("tokencount", model_path, lambda: PieceCounter(model_path))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    One pass without a shuffle; the id column keeps its type.
    """
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(model_path).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            rows = [batch.column(0), [len((t or "").encode("utf-8")) for t in texts], tokens, [n > limit for n in tokens]]
            yield batch_of(pa.schema([("doc_id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]), rows)

    return picked.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
