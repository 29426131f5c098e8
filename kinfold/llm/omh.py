"""Near-duplicate classes by Order MinHash and banded alignment.

Texts.  A text is the sequence of all its words, runs of junk included.

Sketch.  Words are hashed, runs of ``KMER`` words become k-mers, and equal
k-mers of a text are told apart by their occurrence number.  For each of
``BANDS`` hash orders the ``PICKS`` smallest labelled k-mers are sampled and,
put back in text order, hashed to a bucket key; texts of at most ``SHORT``
words have ``SHORT_BANDS`` keys of a single k-mer more.  Texts that agree in
any key are candidates; keeping the order makes that likelier the fewer edits
lie between two texts.

Links.  Two texts are linked if their word edit distance is at most
``1 - SIMILARITY`` of the longer one's words, which banded bit-parallel
alignment decides exactly.  Classes are the connected components of links,
named by their least id.

No bucket is expanded into all pairs.  A text is first aligned with the shortest
text of a bucket, that which it shares most buckets with, then with the shortest
texts of its other buckets, unless they are in one component by then.  Buckets
whose members still lie in several components are settled exactly: up to
``SMALL`` members, pairs across components are aligned; members of larger ones
are joined on a selection of their words and word pairs.  A text of n words
selects one more disjoint place (a word, or two adjacent words) than the edits
a link may have; each edit breaks one place at most, so every shorter or equal
text linked with it contains one of them.  The places that occur in the fewest
texts of other components are selected, and a text with enough pairs of words
of its own needs no join at all.  A text whose places occur in more texts than
there are of a length that allows a link is not joined: blocks of such texts
meet blocks of these, where the words that two texts share, repeats counted,
leave few pairs to be aligned.

A link is missed only if two texts share no bucket at all; the README has the
measured rates by similarity and length.

Cases: equal texts are always in one class, empty ones too; a null text is a
class of its own; a text without words is compared by equality only; rows with
a null id are not part of the result; ids may have any type that can be
ordered; an id with several texts has a row, and a class, for each; texts of
any length are aligned whole; an empty table gives an empty table.  Texts are
told apart by 64 bits of their MD5 within the graph of links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.durable import durable, release, scratch, tidy
from kinfold.llm.frames import place, positional
from kinfold.llm.textcache import batch_of, only

KMER, PICKS, BANDS, SIMILARITY = 3, 2, 64, 0.8
SHORT, SHORT_BANDS = 64, 32
PERIOD, REPEATS = 8, 16
SMALL = 16
SHARDS = 32  #: groups over which the pairs of one text are dealt
CHUNK = 512  #: words over which one table of least costs goes; a longer text deals its places over several
RARE = 1000  #: words that more texts have are not selected
LARGEST = 4  #: components whose own texts are left out of the prices of their places
BROAD = 64  #: a text whose places have so many occurrences or fewer is always joined by them
BLOCK = 128  #: texts of a block
MOST_BROADCAST = 500_000  #: rows of two short keys that may be broadcast, counted first
FILTER_BITS = 1 << 25  #: bounds the broadcast bit table at 2**19 rows of two numbers
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, BANDS + SHORT_BANDS, dtype=np.int64).astype(np.uint64)
_BASE = 0xA24BAED4963EE407  #: odd, so that it has an inverse modulo 2**64
_PIECE = 1 << 18  #: characters hashed together
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# -- sketches -----------------------------------------------------------------
def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``_BASE`` and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, split at white space."""
    if len(text) > _PIECE:
        words, pieces, size = text.split(), [[]], 0
        for word in words:
            if size > _PIECE:
                pieces.append([])
                size = 0
            pieces[-1].append(word)
            size += len(word) + 1
        return np.concatenate([_hashes(" ".join(p)) for p in pieces])
    return _hashes(text)


def _hashes(text: str) -> np.ndarray:
    """A polynomial of a word's code points, taken from running sums over the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edge = np.zeros(len(points) + 2, np.int8)
    edge[1:-1] = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    edge = np.diff(edge)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _FOLD)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def folded(words: np.ndarray) -> np.ndarray:
    """``words`` without what repeats a block of up to ``PERIOD`` words in place after its first ``REPEATS`` occurrences; not used for links."""
    n = len(words)
    more = None
    for period in range(1, min(PERIOD, n - 1) + 1):
        same = words[period:] == words[:-period]
        if np.count_nonzero(same) <= (REPEATS - 1) * period:
            continue
        at, same = np.arange(n), np.concatenate([np.zeros(period, bool), same])
        last = np.maximum.accumulate(np.where(same, -1, at))
        further = same & (at - last > (REPEATS - 1) * period)
        more = further if more is None else more | further
    return words if more is None else words[~more]


def words_of(text: str | None) -> np.ndarray:
    """Hashes of all words of a text, repeats included: links are defined on them."""
    return word_hashes(text or "")


def labelled(values: np.ndarray) -> np.ndarray:
    """Hashes of (value, how many equal values come before it)."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(values))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(values + occurrence * _MIX)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        out = mix(out * _MIX + words[j : len(out) + j])
    return out


def _band_keys(grams: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """A key of the ``picks`` smallest labelled k-mers, in text order, for every seed."""
    n, keys = len(grams), np.empty(len(seeds), np.uint64)
    step = max(1, 1_000_000 // n)
    for start in range(0, len(seeds), step):
        some = seeds[start : start + step]
        order = grams[None, :] * (some[:, None] | np.uint64(1))  # grams are mixed already; an odd factor gives another order
        rows, places = np.arange(len(some)), []
        for pick in range(min(picks, n)):
            if pick:
                order[rows, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            places.append(order.argmin(1))
        key = some.copy()
        for place in np.sort(np.array(places), axis=0):  # back in text order
            key = mix(key * _MIX + grams[place])
        keys[start : start + len(some)] = key
    return keys


def bucket_keys(words: np.ndarray) -> np.ndarray:
    """64-bit keys, one for each band; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    grams = labelled(runs(words, min(KMER, len(words))))
    keys = _band_keys(grams, _SEEDS[:BANDS], PICKS)
    if len(words) <= SHORT:
        keys = np.concatenate([keys, _band_keys(grams, _SEEDS[BANDS:], 1)])
    return keys.view(np.int64)


# -- alignment ----------------------------------------------------------------
def band_distance(x: list, y: list, most: int) -> int | None:
    """Edit distance of two sequences, or None if over ``most``; only a band of ``2 * most + 1`` diagonals is computed.

    The band of a column is one integer whose top bit is the row ``most`` below
    the main diagonal; it slides down one row a column.
    """
    a, b = (x, y) if len(x) >= len(y) else (y, x)
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_b and a[start] == b[start]:
        start += 1
    while end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    rows, columns = len(a), len(b)
    if rows - columns > most:
        return None
    if not columns:
        return rows
    most = min(most, rows)
    where: dict = {}
    for i, v in enumerate(a):
        where[v] = where.get(v, 0) | 1 << i
    width = 2 * most + 1
    full, top, lower = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    plus, minus = full & ~((1 << most) - 1), 0
    score, worst = most, most + columns - (rows - most)
    for i, v in enumerate(b):
        bits = where.get(v, 0)
        shift = i - most
        match = (bits >> shift if shift >= 0 else bits << -shift) & full
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        h_plus = (minus | ~(diagonal | plus)) & full
        h_minus = diagonal & plus
        if i < rows - most:
            score += not diagonal & top
            if score > worst:
                return None
        else:
            score += bool(h_plus & lower) - bool(h_minus & lower)
            lower >>= 1
        down = (diagonal & full) >> 1
        plus, minus = (h_minus | ~(down | h_plus)) & full, down & h_plus
    return score if score <= most else None


def within(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> int | None:
    """Word edit distance of two texts if they are similar enough, else None."""
    longer = max(len(x), len(y))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return None
    shared = len(np.intersect1d(labelled(x), labelled(y), assume_unique=True)) if longer else 0
    if longer - shared > most:
        return None
    a, b = x.tolist(), y.tolist()
    narrow = 12
    while narrow < most:  # close texts need a narrow band only
        found = band_distance(a, b, narrow)
        if found is not None:
            return found
        narrow *= 4
    return band_distance(a, b, most)


# -- selection of places ------------------------------------------------------
def places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, which are odd, and of all pairs of adjacent words, which are even."""
    return mix(words ^ _FOLD) | np.uint64(1), runs(words, 2) & ~np.uint64(1)


def most_edits(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that a link of a text of ``n`` words with a text no longer may have."""
    return int((1 - similarity) * n + 1e-9)


def _least_costs(single: np.ndarray, double: np.ndarray, quota: int) -> np.ndarray:
    """``best[i, c]``: the least cost of ``c`` disjoint places among the first ``i`` words."""
    n, far = len(single), 1 << 40
    best = np.full((n + 1, quota + 1), far, np.int64)
    best[:, 0] = 0
    for i in range(1, n + 1):
        row = np.minimum(best[i - 1, 1:], best[i - 1, :-1] + single[i - 1])
        if i > 1:
            row = np.minimum(row, best[i - 2, :-1] + double[i - 2])
        best[i, 1:] = row
    return best


def _cheapest(single: np.ndarray, double: np.ndarray, quota: int) -> list[tuple[int, int]]:
    """``quota`` disjoint places (start, width) of least total cost; ``single`` and ``double`` cost a word and a pair at each start."""
    best = _least_costs(single, double, quota)
    out, i, c = [], len(single), quota
    while c:
        if best[i, c] == best[i - 1, c]:
            i -= 1
        elif best[i, c] == best[i - 1, c - 1] + single[i - 1]:
            i, c = i - 1, c - 1
            out.append((i, 1))
        else:
            i, c = i - 2, c - 1
            out.append((i, 2))
    return out


def _shares(single: np.ndarray, double: np.ndarray, cuts: list[tuple[int, int]], quota: int) -> list[int]:
    """How many of ``quota`` places each of the chunks ``cuts`` gives at least total cost.

    The least cost of c places is convex in c (places are a matching on a path
    whose words have an edge of their own), so the cheapest next ones are taken.
    """
    if len(cuts) == 1:
        return [quota]
    more = [np.diff(_least_costs(single[x:y], double[x : y - 1], min(quota, y - x))[-1]) for x, y in cuts]
    chunk = np.repeat(np.arange(len(cuts)), [len(m) for m in more])
    return np.bincount(chunk[np.argsort(np.concatenate(more), kind="stable")[:quota]], minlength=len(cuts)).tolist()


def selection(words: np.ndarray, grams: np.ndarray, prices: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Hashes of more disjoint places than a link may have edits, but for those without a price.

    ``prices`` says how many texts have each of ``grams`` (0: no other
    component has it).  Words that are not listed are too frequent to be
    selected, pairs that are not listed have no price.  Pairs alone are always
    enough, so that only a text of one word may be left without a selection.
    """
    hashes = [x.view(np.int64) for x in places(words)]
    order = np.argsort(grams)
    grams, prices = np.append(grams[order], 0), np.append(prices[order], 0)
    found = [np.minimum(np.searchsorted(grams[:-1], x), len(grams) - 1) for x in hashes]
    single, double = (np.where(grams[at] == x, prices[at], missing) for at, x, missing in zip(found, hashes, (1 << 30, 0), strict=True))
    free = np.concatenate([[False], double == 0, [False]]).astype(np.int8)
    stretches = np.flatnonzero(np.diff(free) == -1) - np.flatnonzero(np.diff(free) == 1)
    if int(((stretches + 1) // 2).sum()) > most_edits(len(words), similarity):
        return np.zeros(0, np.int64)  # enough pairs of its own
    out = set()
    starts = [x for x in range(0, len(words), CHUNK) if not x or len(words) - x >= 4]  # a few words at the end join the chunk before
    cuts = list(zip(starts, [*starts[1:], len(words)], strict=True))
    for (start, end), share in zip(cuts, _shares(single, double, cuts, most_edits(len(words), similarity) + 1), strict=True):
        for at, width in _cheapest(single[start:end], double[start : end - 1], share):
            if (single, double)[width - 1][start + at]:
                out.add(int(hashes[width - 1][start + at]))
    return np.array(sorted(out), np.int64)


# -- tables -------------------------------------------------------------------
def sketch(docs: DataFrame) -> DataFrame:
    """(id, digest, n, keys) of (id, text)."""

    def run(batches):
        only("omh")
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                digests.append(None if text is None else hashlib.md5(text.encode("utf-8")).digest())
                sizes.append(len(words))
                keys.append(bucket_keys(words))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            schema = pa.schema([("id", batch.schema.field(0).type), ("digest", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
            yield batch_of(schema, [batch.column(0), digests, sizes, pa.ListArray.from_arrays(pa.array(ends), flat)])

    return docs.mapInArrow(run, f"id {_kind(docs)}, digest binary, n long, keys array<long>")


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def narrowed(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``docs`` without most rows whose ``key`` is not in ``wanted``, so that fewer texts are shuffled.

    A bit table of hashed keys with at most ``FILTER_BITS / 64`` rows is
    broadcast; false positives stay for the join that follows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {FILTER_BITS}) % 64 as int))")
    table = wanted.select(F.floor(place / 64).alias("__kf_word"), bit.alias("__kf_bit")).groupBy("__kf_word").agg(F.bit_or("__kf_bit").alias("__kf_bits"))
    marked = docs.select("*", F.floor(place / 64).alias("__kf_word"), bit.alias("__kf_bit")).join(F.broadcast(table), "__kf_word")
    return marked.where(F.col("__kf_bits").bitwiseAND(F.col("__kf_bit")) != 0).select(*docs.columns)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once for every row of ``nodes`` (node, id)."""
    wanted = nodes.select(F.xxhash64("node", "id").alias("own"), "node", "id")
    marked = docs.select(F.xxhash64(F.unhex(F.md5(F.col("text").cast("binary")))).alias("node"), "id", "text").withColumn("own", F.xxhash64("node", "id"))
    found = narrowed(marked, wanted, "own").join(wanted, ["own", "node", "id"])  # a semi join would be pushed below the bit table
    return found.dropDuplicates(["own", "node", "id"]).select("node", "text")


def aligned(pool: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts, in ``pool`` (node, text), are similar enough.

    A text travels once for each pair it is the ``b`` of, and to at most
    ``SHARDS`` groups that it is the ``a`` of: pairs are dealt by ``a`` and a
    hash of ``b``, so that a hot ``a`` needs neither counting nor one task.
    """
    spread = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SHARDS)).cast("int").alias("shard"))
    heads = spread.select("a", "shard").distinct().select(F.col("a").alias("node"), "a", "shard", F.lit(0).alias("role"))
    needed = durable(heads.unionByName(spread.select(F.col("b").alias("node"), "a", "shard", F.lit(1).alias("role"))), "omh-needed")
    rows = needed.join(narrowed(pool, needed, "node"), "node").select("a", "shard", "role", "node", "text")
    grouped = rows.repartition("a", "shard").sortWithinPartitions("a", "shard", "role")

    def run(batches):
        only("omh")
        head, head_words = None, None
        for batch in batches:
            left, right = [], []
            for a, shard, role, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if role == 0:
                    head, head_words = (a, shard), words
                elif within(head_words, words, similarity) is not None:
                    left.append(a)
                    right.append(b)
            yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [left, right])

    return grouped.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): the least id it is connected with.

    In each round every vertex points at its least neighbour, pointers are
    doubled until they rest, and links are rewritten to what their ends point
    at; links within a component vanish, so that a star is done in one round.
    Rounds are written; the driver learns only whether anything is left.
    """
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = durable(order(links), "omh-edges")
    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "omh-labels")
    while not edges.isEmpty():
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        points = durable(near.select(F.col("a").alias("v"), F.least("a", "b").alias("to"), F.lit(True).alias("moved")), "omh-points")
        while True:
            ahead = points.select(F.col("v").alias("to"), F.col("to").alias("further"))
            fresh = durable(points.select("v", "to").join(ahead, "to").select("v", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "omh-points")
            release(points)
            points = fresh
            if points.where("moved").isEmpty():
                break
        of_a, of_b = points.select(F.col("v").alias("a"), F.col("to").alias("x")), points.select(F.col("v").alias("b"), F.col("to").alias("y"))
        fewer = durable(order(edges.join(of_a, "a").join(of_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "omh-edges")
        moved = durable(labels.join(points.select(F.col("v").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "omh-labels")
        for old in (edges, labels, points):
            release(old)
        edges, labels = fewer, moved
    release(edges)
    return labels


def _index(texts: DataFrame) -> DataFrame:
    """(gram, node, comp, n) of (node, comp, text): the distinct words and word pairs of a text."""
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for node, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                grams = np.unique(np.concatenate(places(words))).view(np.int64)
                yield batch_of(schema, [pa.array(grams), *(pa.array(np.full(len(grams), x, np.int64)) for x in (node, comp, len(words)))])

    return texts.mapInArrow(run, "gram long, node long, comp long, n long")


def _selected(texts: DataFrame, priced: DataFrame, similarity: float) -> DataFrame:
    """(gram, node, comp, n, cost): the selected places of ``texts`` (node, comp, text), and the sum of their prices, of which ``priced`` (node, gram, price) has all."""
    none = F.lit(None).cast("long")
    rows = texts.select("node", F.lit(0).alias("role"), "text", "comp", none.alias("gram"), none.alias("price"))
    rows = rows.unionByName(priced.select("node", F.lit(1).alias("role"), F.lit(None).cast("string").alias("text"), none.alias("comp"), "gram", "price"))
    grouped = rows.repartition("node").sortWithinPartitions("node", "role")
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "node", "comp", "n", "cost")])

    def run(batches):
        now, prices = None, []

        def result():
            node, comp, text = now
            words = words_of(text)
            listed, price = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in prices)]) for i in (0, 1))
            grams = selection(words, listed, price, similarity)
            cost = price[np.isin(listed, grams)].sum()
            return batch_of(schema, [pa.array(grams), *(pa.array(np.full(len(grams), x, np.int64)) for x in (node, comp, len(words), cost))])

        for batch in batches:
            role = batch.column(1).to_numpy()
            gram, count = (batch.column(i).fill_null(0).to_numpy() for i in (4, 5))
            heads = np.flatnonzero(role == 0).tolist()
            for start, end in zip([0, *heads], [*heads, len(role)], strict=True):
                if start in heads[:1] or role[start] == 0:
                    if now is not None:
                        yield result()
                    now, prices = tuple(batch.column(i)[start].as_py() for i in (0, 3, 2)), []
                    start += 1
                prices.append((gram[start:end], count[start:end]))
        if now is not None:
            yield result()

    return grouped.mapInArrow(run, "gram long, node long, comp long, n long, cost long")


def length_class(similarity: float = SIMILARITY):
    """A class of the length ``n``; texts of lengths that allow a link are in one class or in adjacent ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 / similarity)).cast("int")


def _shared(labels: list[np.ndarray]):
    """A function of a text's distinct labelled words: how many of them each of ``labels`` has."""
    flat = np.concatenate(labels)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(labels)), [len(x) for x in labels])[order]

    def run(own: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
        sizes = last - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(owner[at], minlength=len(labels))

    return run


def block_pairs(texts: DataFrame, broad: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ``broad`` and no longer ``members`` (node, comp, n) in different components that share enough words for a link.

    Both are dealt into blocks of about ``BLOCK`` texts of a length class, and
    every block of ``broad`` meets every block of its class and the one below.
    A text travels once for each block that it meets.
    """
    blocks = lambda df, column: df.groupBy(length_class(similarity).alias(column)).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"of_{column}"))
    grid = F.broadcast(blocks(broad, "x").join(blocks(members, "y"), F.col("y").isin(F.col("x"), F.col("x") - 1)))
    own, each = lambda column: F.pmod(F.xxhash64("node"), F.col(f"of_{column}")).cast("int"), lambda column: F.explode(F.sequence(F.lit(0), F.col(f"of_{column}") - 1))
    left = broad.select("node", "comp", length_class(similarity).alias("x")).join(grid, "x").withColumn("in_x", own("x")).withColumn("in_y", each("y")).withColumn("role", F.lit(0))
    right = members.select("node", "comp", length_class(similarity).alias("y")).join(grid, "y").withColumn("in_y", own("y")).withColumn("in_x", each("x")).withColumn("role", F.lit(1))
    cell = ["x", "y", "in_x", "in_y"]
    rows = left.select(*cell, "role", "node", "comp").unionByName(right.select(*cell, "role", "node", "comp"))
    grouped = rows.join(texts.select("node", "text"), "node").select(*cell, "role", "node", "comp", "text").repartition(*cell).sortWithinPartitions(*cell, "role")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        only("omh")
        now, shared, heads, labels = None, None, [], []
        for batch in batches:
            pairs = [np.zeros((0, 2), np.int64)]
            for *key, role, node, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = labelled(words_of(text))
                if key != now:
                    now, shared, heads, labels = key, None, [], []
                if role == 0:
                    heads.append((node, comp, len(own), most_edits(len(own), similarity)))
                    labels.append(own)
                    continue
                if not heads:
                    continue
                if shared is None:
                    shared, labels = _shared(labels), []
                    nodes, comps, sizes, most = np.array(heads, np.int64).T
                near = (comps != comp) & (sizes >= len(own)) & (sizes - len(own) <= most) & (sizes - shared(own) <= most)
                if near.any():
                    pairs.append(np.stack([nodes[near], np.full(near.sum(), node)], 1))
            flat = np.concatenate(pairs)
            yield batch_of(schema, [pa.array(flat.min(1)), pa.array(flat.max(1))])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def place_pairs(pool: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ``members`` (node, comp, n) in different components, every link among them."""
    texts = durable(narrowed(pool, members, "node").join(members.select("node", "comp"), "node").select("node", "comp", "text"), "omh-large-texts")
    index = durable(_index(texts), "omh-index")
    largest = [r.comp for r in members.groupBy("comp").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "comp").limit(LARGEST).collect()]
    own = [F.count_if(F.col("comp") == c).alias(f"own{i}") for i, c in enumerate(largest)]
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *own)
    alone, word = F.col("lo") == F.col("hi"), F.col("gram").bitwiseAND(F.lit(1)) == 1
    listed = counts.where((word & (alone | (F.col("texts") <= RARE))) | (~word & ~alone))
    price = F.col("texts")
    for i, c in enumerate(largest):
        price = price - F.when(F.col("comp") == c, F.col(f"own{i}")).otherwise(0)
    price = F.when(alone, 0).otherwise(price).cast("long")
    priced = durable(index.join(listed, "gram").select("gram", "node", "comp", "n", price.alias("price")), "omh-priced")
    release(index)
    tidy(pool.sparkSession)
    sizes = members.groupBy(length_class(similarity).alias("length")).agg(F.count(F.lit(1)).alias("window"))
    sizes = sizes.unionByName(sizes.withColumn("length", F.col("length") + 1)).groupBy("length").agg(F.sum("window").alias("window"))
    chosen = _selected(texts, priced, similarity).withColumn("length", length_class(similarity)).join(F.broadcast(sizes), "length")
    chosen = durable(chosen.select("gram", "node", "comp", "n", ((F.col("cost") > BROAD) & (F.col("cost") > F.col("window"))).alias("broad")), "omh-chosen")
    x, y = chosen.where("not broad").alias("x"), priced.where("price > 0").alias("y")
    near = (F.col("y.n") <= F.col("x.n")) & (F.col("y.n") >= similarity * F.col("x.n") - 1e-9)
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.comp") != F.col("y.comp")) & near)
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    broad = durable(chosen.where("broad").select("node", "comp", "n").distinct(), "omh-broad")
    if not broad.isEmpty():
        pairs = pairs.unionByName(durable(block_pairs(texts, broad, members, similarity), "omh-blocks"))
    release(texts)
    return pairs.distinct()


def _across(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``placed`` (key, node, n, comp) with one key, different components and lengths that allow a link."""
    x, y = placed.alias("x"), placed.alias("y")
    near = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & near)
    return joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _links(pool: DataFrame, members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), labels (id, comp)) over texts that share buckets: ``members`` (key, node, n)."""
    rank = F.shiftleft("n", 32).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 32) - 1)))
    heads = members.groupBy("key").agg(F.min_by("node", rank).alias("head"), F.shiftright(F.min(rank), 32).alias("least"))
    met = members.join(heads, "key").where((F.col("node") != F.col("head")) & (F.col("least") >= similarity * F.col("n") - 1e-9))
    met = durable(met.groupBy("head", "node").agg(F.count(F.lit(1)).alias("times")), "omh-met")
    first = met.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("times", "head"))["head"].alias("a")).select("a", "b")
    first = durable(first, "omh-pairs")
    tidy(pool.sparkSession)
    links = durable(aligned(pool, first, similarity), "omh-links")
    tidy(pool.sparkSession)
    labels = components(links)

    of = lambda column: labels.select(F.col("id").alias(column), F.col("comp").alias("comp_" + column))
    more = met.select(F.col("head").alias("a"), F.col("node").alias("b")).join(first, ["a", "b"], "left_anti")
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
    links = durable(links.unionByName(aligned(pool, durable(more, "omh-pairs"), similarity)), "omh-links")
    labels = components(links)
    tidy(pool.sparkSession)

    placed = members.join(labels, F.col("node") == F.col("id"), "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "size")
    rest = durable(placed.join(mixed, "key"), "omh-mixed")
    tidy(pool.sparkSession)
    large = durable(rest.where(F.col("size") > SMALL).select("node", "comp", "n").distinct(), "omh-large")
    pairs = _across(rest.where(F.col("size") <= SMALL), similarity)
    if not large.isEmpty():
        pairs = pairs.unionByName(place_pairs(pool, large, similarity)).distinct()
    tested = met.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"), "omh-pairs")
    tidy(pool.sparkSession)
    if not pairs.isEmpty():
        found = durable(aligned(pool, pairs, similarity), "omh-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    return links, labels


def _classed(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """What :func:`classes` returns, with ``root``, which names a class of texts (null for null texts)."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("id").isNotNull())
    with scratch(df.sparkSession) as keep:
        digest = F.unhex(F.md5(F.col("text").cast("binary")))
        rows = keep(durable(docs.groupBy("id", digest.alias("digest")).agg(F.count(F.lit(1)).alias("rows")), "omh-rows"))
        nodes = sketch(docs).where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        nodes = durable(nodes.select(F.xxhash64("digest").alias("node"), "digest", "id", "n", "keys"), "omh-nodes")
        names = keep(durable(nodes.select("node", "digest", "id"), "omh-names"))
        tidy(df.sparkSession)
        keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
        shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"), "omh-shared")
        tidy(df.sparkSession)
        members = durable(narrowed(keyed, shared, "key").join(shared, "key"), "omh-members")
        release(nodes, shared)
        tidy(df.sparkSession)
        pool = durable(texts_of(docs, names.join(members.select("node").distinct(), "node", "left_semi").select("node", "id")), "omh-pool")
        tidy(df.sparkSession)
        links, labels = _links(pool, members, similarity)
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        linked = names.join(labels.withColumnRenamed("id", "node"), "node").select("node", "id", "comp")
        least = linked.groupBy("comp").agg(F.min("id").alias("least"))
        of_linked = keep(durable(linked.select("node", "comp").join(least, "comp").join(ends, "node").select("node", "comp", "least", "links"), "omh-linked"))
    of_text = names.join(of_linked, "node", "left").select("digest", F.coalesce("least", "id").alias("least"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("root"))
    found = rows.join(of_text, "digest", "left")
    return found.select("id", "digest", "rows", F.coalesce("least", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "root")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, digest, rows, class_id, links): one row for every distinct (id, text).

    ``digest`` is null for null texts; ``links`` counts the links of the text
    that were aligned, of which there are enough to connect its class.
    """
    return _classed(df, id_col, text_col, similarity).drop("root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class, that of the least id and then digest; rows with a null id stay.

    Of rows with the same id and text, the least by the JSON form of its columns stays.
    """
    plain, restore = positional(df)
    own, ident, text = plain.columns, place(df, id_col), place(df, text_col)
    none = F.lit("").cast("binary")
    found = _classed(plain, ident, text, similarity).select(F.col("id").alias("kid"), F.coalesce("digest", none).alias("kd"), "rows", "root")
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct("kid", "kd")).alias("b")).select("b.*").withColumn("first", F.lit(True))
    judged = found.join(best, ["kid", "kd"], "left").select("kid", "kd", "rows", (F.col("first") | F.col("root").isNull()).alias("first"))
    gone = durable(judged.where("first is null or not first or rows > 1"), "omh-gone")
    marked = plain.withColumns({"kid": F.col(ident), "kd": F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), none)})
    keys = gone.select("kid", "kd")
    if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)  # no text is shuffled
    kept = marked.join(keys, ["kid", "kd"], "left_anti").select(*own)
    repeated = gone.where("first")
    if not repeated.isEmpty():
        whole = F.struct(*own)
        once = marked.join(repeated.select("kid", "kd"), ["kid", "kd"]).groupBy("kid", "kd").agg(F.min_by(whole, F.to_json(whole)).alias("w")).select("w.*")
        kept = kept.unionByName(once)
    return restore(kept)
