"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector.  A letter trigram is the element-wise
product of its letters' vectors, each rotated by its place; a text is the sum
(bundle) of its trigram vectors; a language prototype is the sum of its unit
text vectors.  Prototypes and texts are compared by cosine after the mean
prototype, what all languages share, is taken out of both.

Training is one pass over all labelled rows, or over a hash-chosen share of
them, about ``max_train_docs`` in expectation; whole texts are used.  Partial sums leave a
task as (language, dimension, integer) rows and are added by Spark, so that the
driver receives languages x dimensions numbers, however many rows there are.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
any labelled row every text is ``und``; ties go to the first language in
alphabetical order; null labels are never learned; over ``MAX_LANGUAGES`` labels
are an error, as profiles go through the driver; texts of any length are read
whole; columns may have any name; repeated rows each give a row; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.durable import durable, scratch
from kinfold.llm.frames import place, positional
from kinfold.llm.textcache import batch_of, groups, held

DIMENSIONS = 1024
SEED = 20240229
UNKNOWN = "und"
MAX_LANGUAGES = 1000  #: more labels than these end the job with an error
_UNIT = 1 << 20  #: a unit text vector is summed in integers of this scale, whose order of addition does not matter
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_vector(code_point: int) -> np.ndarray:
    return np.random.default_rng([SEED, code_point]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


class Trigrams:
    """Trigram vectors, made on demand; the table is emptied at its bound."""

    def __init__(self, bound: int = 30_000):
        self.letter = lru_cache(20_000)(letter_vector)
        self.index: dict[int, int] = {}
        self.rows = np.zeros((1024, DIMENSIONS), np.int8)
        self.bound = bound

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        if len(self.index) + len(keys) > self.bound:
            self.index.clear()
        for key in keys.tolist():
            if key not in self.index:
                at = self.index[key] = len(self.index)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.rows[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return self.rows[[self.index[k] for k in keys.tolist()]]


def trigram_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three 21-bit code points) of the lower-cased letters, words set off by single spaces, and counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.int64)
    padded = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    return np.unique(padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:], return_counts=True)


def bundle(texts: list[str | None], block: int = 4096, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and which of them have a letter."""
    trigrams = held("langid", "trigrams", Trigrams)
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    for first in range(0, len(texts), rows):
        found = [trigram_keys(t) for t in texts[first : first + rows]]
        keys = np.concatenate([k for k, _ in found])
        counts = np.concatenate([c for _, c in found]).astype(np.float32)
        row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        seen, column = np.unique(keys, return_inverse=True)
        part = out[first : first + rows]
        for start in range(0, len(seen), block):
            use = (column >= start) & (column < start + block)
            matrix = np.zeros((len(found), min(block, len(seen) - start)), np.float32)
            matrix[row[use], column[use] - start] = counts[use]
            part += matrix @ trigrams.vectors(seen[start : start + block]).astype(np.float32)
        has[first : first + rows] = [len(k) > 0 for k, _ in found]
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(1))
    out /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
    return out, has


class Profiles:
    """Language prototypes, with the mean of all taken out."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = sorted(sums)
        raw = np.array([sums[k] / max(np.linalg.norm(sums[k]), 1e-9) for k in self.languages]).reshape(-1, DIMENSIONS)
        self.mean = raw.mean(0).astype(np.float32) if len(raw) > 1 else np.zeros(DIMENSIONS, np.float32)
        own = raw - self.mean
        self.rows = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32) if len(raw) else raw.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        vectors, has = bundle(texts)
        vectors -= self.mean
        cosine = (vectors @ self.rows.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).tolist()


def fold_of(id_col: Column | str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % folds


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train_docs: int | None = 20_000, key: Column | None = None) -> Profiles:
    """Prototypes from labelled rows: a share chosen by the hash of ``key`` so that about ``max_train_docs`` rows are used, all rows if that is None."""
    label, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = train.where(label.isNotNull())
    if max_train_docs is not None and (n := rows.count()) > max_train_docs:
        chosen = F.pmod(F.xxhash64(key if key is not None else text, F.lit(SEED)), F.lit(1 << 30))
        rows = rows.where(chosen < F.lit(max_train_docs * (1 << 30) // n))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in groups(texts):
                vectors, has = bundle(texts[start:end])
                scaled = np.rint(vectors * np.float32(_UNIT)).astype(np.int64)
                for lang, vector, ok in zip(langs[start:end], scaled, has, strict=True):
                    if ok:
                        sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield batch_of(pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("value", pa.int64())]), [[lang] * DIMENSIONS, list(range(DIMENSIONS)), vector.tolist()])

    parts = rows.select(text.alias("text"), label.alias("lang")).mapInArrow(run, "lang string, dim int, value long")
    found = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(found) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"over {MAX_LANGUAGES} languages among the labels")
    sums: dict[str, np.ndarray] = {}
    for lang, dim, value in found:
        sums.setdefault(lang, np.zeros(DIMENSIONS))[dim] = value
    return Profiles(sums)


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score``; the text is the only input of a prediction."""
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in groups(texts):
                names, scores = profiles.predict(texts[start:end])
                ids = batch.column(0).slice(start, end - start)
                yield batch_of(pa.schema([("doc_id", ids.type), ("lang_pred", pa.string()), ("score", pa.float64())]), [ids, names, scores])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def annotate(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_name: str = "__kf_lang", score_name: str = "__kf_score") -> DataFrame:
    """``df`` with two more columns, whatever its own columns are called."""
    plain, _ = positional(df)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for start, end in groups(texts):
                names, scores = profiles.predict(texts[start:end])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang", "score"])

    marked = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    return marked.toDF(*df.columns, lang_name, score_name)


def percentile(values: DataFrame, share: float, buckets: int = 4096) -> float | None:
    """The interpolated percentile of all of ``values`` (value), None without any.

    Values are counted in buckets, then those of the bucket that holds the rank
    in finer ones, until it holds one value; the driver gets ``buckets`` rows a round.
    """
    n, least, most = values.agg(F.count("value"), F.min("value"), F.max("value")).first()
    if not n:
        return None

    def ranked(rank: int) -> float:
        lo, hi, below = least, most, 0
        while lo < hi:  # the ends fall into different buckets, so that each round leaves fewer values
            bucket = F.floor((F.col("value") - lo) / (hi - lo) * (buckets - 1))
            counts = values.where(F.col("value").between(lo, hi)).groupBy(bucket.alias("bucket")).agg(F.count("value"), F.min("value"), F.max("value")).collect()
            for _, count, lo, hi in sorted(counts):  # noqa: B020  of the bucket that holds the rank
                if below + count > rank:
                    break
                below += count
        return lo

    position = share * (n - 1)
    lower = int(position)
    first = ranked(lower)
    return first if position == lower else (lower + 1 - position) * first + (position - lower) * ranked(lower + 1)


def least_score(train: DataFrame, profiles: Profiles, share: float = 0.001, text_col: str = "text", lang_col: str = "lang") -> float:
    """Half the score below which ``share`` of all labelled texts with letters lie.

    Half, so that labelled texts themselves stay: a text has to be much less like its language than the oddest of them.
    """
    label, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = train.where(label.isNotNull()).select(F.lit(0).alias("id"), text.alias("text"))
    with scratch(train.sparkSession):
        scored = durable(predict(rows, profiles, "id").where(F.col("lang_pred") != UNKNOWN).select(F.col("score").alias("value")), "langid-scores")
        return (percentile(scored, share) or 0.0) / 2


def filter_known(df: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a learned language with a score of at least ``least``."""
    plain, restore = positional(df)
    marked = annotate(plain, profiles, place(df, text_col), "lang", "score")
    return restore(marked.where((F.col("lang") != UNKNOWN) & (F.col("score") >= least)))
