"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Rows of a source are put in hash order and cut into blocks.  With integer
weights *w* that sum to *P*, block *k* (from 1) of a source is released at slot
``floor((k-1) P / w)`` and due by slot ``ceil(k P / w)``; in every slot the
released block with the earliest deadline runs.  The schedule repeats after *P*
slots, so only one period is computed, over the weights and not the rows.
Before every slot each source has had its share of slots to within less than
one block, as long as it has blocks; slots of an exhausted source are passed
over, and the rest keep their proportions.  No row is dropped or repeated.

Ranks within a source are sums over hash buckets plus a rank within the
bucket, so that a source with a third of all rows is spread over
``16 ** BUCKET_DIGITS`` groups.  DataFrame functions only.

The schedule of one period is made in one row, so that there may be
``MAX_SOURCES`` sources; with more the job ends with an error.

Cases: a null source is a source of its own; a source without a weight, or with
one below 1, gets weight 1; repeated rows each keep a place, ordered by id and
then by the digest of the text; columns may have any name; texts of any length
are carried along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.frames import place, positional

BLOCK = 100
TOTAL = 1000
BUCKET_DIGITS = 3
ALPHA = 0.5
MAX_SOURCES = 10_000
#: What :func:`mix` adds: block of the source (from 0), its release and deadline, the slot that it got, place in the block.
ADDED = ("block", "release", "deadline", "slot", "pos")


def tempered_weights(df: DataFrame, source_col: str = "source", alpha: float = ALPHA, total: int = TOTAL) -> DataFrame:
    """Integer weights (source, weight) in proportion to ``count ** alpha``, about ``total`` together, at least 1 each."""
    counts = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("__kf_n"))
    power = F.pow(F.col("__kf_n").cast("double"), F.lit(alpha)) if alpha != 0.5 else F.sqrt(F.col("__kf_n").cast("double"))
    sizes = counts.select("source", power.alias("__kf_p"))
    whole = sizes.agg(F.sum("__kf_p").alias("__kf_sum"))
    return sizes.join(F.broadcast(whole)).select("source", F.greatest(F.lit(1), F.round(total * F.col("__kf_p") / F.col("__kf_sum")).cast("long")).cast("long").alias("weight"))


def schedule(weights: DataFrame) -> DataFrame:
    """One period: (source, weight, period, k, slot), earliest deadline first among released blocks, ties to the first source by name."""
    gathered = weights.select(F.struct(F.col("source"), F.greatest(F.lit(1), F.coalesce(F.col("weight"), F.lit(1))).cast("long").alias("weight")).alias("s"))
    row = gathered.agg(F.array_sort(F.collect_list("s")).alias("sources")).where(F.size("sources") > 0)
    bounded = F.when(F.size("sources") > MAX_SOURCES, F.raise_error(F.lit(f"over {MAX_SOURCES} sources"))).otherwise(F.col("sources"))
    row = row.select(bounded.alias("sources"))
    row = row.select("sources", F.transform("sources", lambda s: s["weight"]).alias("ws"), F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["weight"]).alias("period"))
    period, ws = F.col("period"), F.col("ws")

    def step(state, t):
        due = F.transform(state["given"], lambda a, i: F.when(F.floor(a * period / F.get(ws, i)) <= t, F.ceil((a + 1) * period / F.get(ws, i))).otherwise(F.lit(1 << 62)))
        return F.struct(state["given"].alias("given"), state["picks"].alias("picks"), F.array_position(due, F.array_min(due)).alias("pick"))

    def take(state, t):
        chosen = step(state, t)
        pick = chosen["pick"]
        return F.struct(F.transform(state["given"], lambda a, i: a + F.when(i == pick - 1, F.lit(1)).otherwise(F.lit(0))).alias("given"), F.concat(state["picks"], F.array(pick.cast("long"))).alias("picks"))

    start = F.struct(F.transform("ws", lambda w: F.lit(0).cast("long")).alias("given"), F.array().cast("array<bigint>").alias("picks"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, take, lambda s: s["picks"])
    slots = row.select("sources", "period", F.posexplode(run).alias("slot", "pick")).select(F.element_at("sources", F.col("pick").cast("int")).alias("s"), "period", F.col("slot").cast("long").alias("slot"), "pick")
    k = F.row_number().over(Window.partitionBy("pick").orderBy("slot")).cast("long")
    return slots.select(F.col("s.source").alias("source"), F.col("s.weight").alias("weight"), "period", k.alias("k"), "slot")


def _named(source: Column) -> Column:
    """A source as a string that is never null, so that windows and joins share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def mix(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None, mark_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with the columns of ``ADDED``, their names after ``__kf_``.

    Rows of one id are ordered by the digest of their text, computed from ``text_col`` or read from ``mark_col``.
    """
    plain, _ = positional(df)
    mark = F.md5(F.col(place(df, text_col)).cast("binary")) if text_col else F.col(place(df, mark_col)) if mark_col else None
    out = _mixed(plain, weights, place(df, id_col), place(df, source_col), mark, block)
    return out.toDF(*df.columns, *["__kf_" + c for c in ADDED])


def _mixed(plain: DataFrame, weights: DataFrame, ident: str, source: str, mark: Column | None, block: int) -> DataFrame:
    """``plain`` (c0, c1, ...) with the columns of ``ADDED``; its rows are shuffled once, by source and hash bucket."""
    named = _named(F.col(source))
    key = F.md5(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary"))
    keyed = plain.select("*", named.alias("of"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket"), key.alias("key"), *([mark.alias("mark")] if mark is not None else []))
    counts = plain.select(named.alias("of"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket")).groupBy("of", "bucket").agg(F.count(F.lit(1)).alias("n"))
    plan = schedule(weights).withColumn("of", _named(F.col("source")))
    per_source = plan.groupBy("of").agg(F.first("weight").alias("w"), F.first("period").alias("p"))
    before = counts.select("of", "bucket", (F.sum("n").over(Window.partitionBy("of").orderBy("bucket")) - F.col("n")).alias("before")).join(per_source, "of", "left")
    order = ["key", ident, *(["mark"] if mark is not None else [])]
    within = F.row_number().over(Window.partitionBy("of", "bucket").orderBy(*order)) - 1
    rank = F.col("before") + F.col("within")
    ranked = keyed.withColumn("within", within).drop("key", "mark").join(before, ["of", "bucket"])
    b, w, p = F.col("block"), F.col("w"), F.col("p")
    blocks = ranked.select(*plain.columns, "of", "w", "p", F.floor(rank / block).alias("block"), (rank % block).alias("pos")).withColumn("k", b % w + 1)
    placed = blocks.join(plan.select("of", "k", F.col("slot").alias("at")), ["of", "k"])
    return placed.select(*plain.columns, "block", F.floor(b * p / w).alias("release"), F.ceil((b + 1) * p / w).alias("deadline"), (F.floor(b / w) * p + F.col("at")).alias("slot"), "pos")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix` in mixed order, what it added taken off."""
    plain, _ = positional(mixed)
    own = plain.columns[: -len(ADDED)]
    return plain.orderBy(*plain.columns[-2:]).select(*own).toDF(*mixed.columns[: len(own)])


SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), weights AS (SELECT source, greatest(1, round({TOTAL} * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts))::BIGINT) AS w FROM counts
), packed AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(w ORDER BY source NULLS FIRST) AS ws, sum(w)::BIGINT AS p FROM weights
), run AS (
  SELECT 0::BIGINT AS t, NULL::BIGINT AS pick, list_transform(ws, lambda x: 0::BIGINT) AS given FROM packed
  UNION ALL
  SELECT t + 1, pick2, list_transform(given, lambda a, i: CASE WHEN i = pick2 THEN a + 1 ELSE a END)
  FROM (SELECT t, given, p, list_position(due, list_min(due))::BIGINT AS pick2 FROM (
    SELECT t, given, p, list_transform(given, lambda a, i: CASE WHEN (a * p) // ws[i] <= t THEN ((a + 1) * p + ws[i] - 1) // ws[i] ELSE 4611686018427387904 END) AS due FROM run, packed WHERE t < p))
), slots AS (
  SELECT names[pick] AS source, ws[pick] AS w, p, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS k FROM run, packed WHERE pick IS NOT NULL
), ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents
), blocks AS (SELECT doc_id, ranked.source, r // {BLOCK} AS block, r % {BLOCK} AS pos, w, p FROM ranked JOIN (SELECT DISTINCT source, w, p FROM slots) s ON ranked.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, blocks.source, block::BIGINT AS block, ((block * blocks.p) // blocks.w)::BIGINT AS release, (((block + 1) * blocks.p + blocks.w - 1) // blocks.w)::BIGINT AS deadline,
  ((block // blocks.w) * blocks.p + slot)::BIGINT AS slot, pos::BIGINT AS pos
FROM blocks JOIN slots ON blocks.source IS NOT DISTINCT FROM slots.source AND slots.k = block % blocks.w + 1
"""
