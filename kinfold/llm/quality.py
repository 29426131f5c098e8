"""Quality rules judged by document and by host.

A document fails its base rules when it has too few words or repeats itself.
Failures are counted by host, a host's rate is shrunk towards the corpus with
an empirical beta prior, and the documents of hosts whose shrunken rate is too
high are rejected as well.  The prior's mean is that of the hosts' rates; its
variance is theirs less the part that binomial chance gives hosts of their
sizes.  A shrunken rate is too high if it is over ``MOST_HOST_RATE``, or else
over both ``TIMES_MEAN`` times the prior's mean and ``DEVIATIONS`` standard
deviations of the prior above it: hosts are held against the corpus they are
in, and like hosts are never told apart by chance.  Everything is DataFrame
functions; repeats inside a text are found by sorting hashes of its three-word
windows, so that time is n log n in the words of a text.

Cases: a null text has no words and fails; a null host is a host of its own;
repeated rows are judged and counted one by one; texts of any length are read
whole; columns may have any name; an empty table gives an empty table; with one
host, or equal rates everywhere, the prior is as strong as ``MOST_PRIOR``
documents.  Window hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.durable import durable
from kinfold.llm.frames import place, positional

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  #: percent of words in repeated three-word windows
MOST_HOST_RATE, TIMES_MEAN, DEVIATIONS = 0.5, 2, 2
LEAST_PRIOR, MOST_PRIOR = 1.0, 10_000.0


def with_base(df: DataFrame, text: Column, keep: list[Column], prefix: str = "") -> DataFrame:
    """``keep`` and the base columns, their names after ``prefix``; the names of ``keep`` must not begin with ``__kf_``."""
    first = df.select(*keep, F.coalesce(text, F.lit("")).alias("__kf_text"))
    hold = [F.col(f"`{c}`") for c in first.columns[: len(keep)]]
    words = first.select(*hold, "__kf_text", F.filter(F.split("__kf_text", SPACE), lambda w: w != "").alias("__kf_words"))
    w = F.col("__kf_words")
    windows = F.when(F.size(w) > 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(windows, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    measured = words.select(*hold, "__kf_text", F.size(w).cast("long").alias("__kf_n"), F.array_sort(hashed).alias("__kf_sorted"))
    s = F.col("__kf_sorted")
    same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    t = F.col("__kf_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = measured.select(
        *hold, F.col("__kf_n"), F.length(F.translate(t, SPACES, "")).cast("long").alias("__kf_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("__kf_symbols"),
        lines.alias("__kf_lines"), F.size(covered).cast("long").alias("__kf_repeat"),
    )
    failed = (F.col("__kf_n") < LEAST_WORDS) | (100 * F.col("__kf_repeat") > MOST_REPEATED * F.col("__kf_n"))
    return counted.select(
        *hold, F.col("__kf_n").alias(prefix + "n_words"), F.col("__kf_chars").alias(prefix + "word_chars"), F.col("__kf_symbols").alias(prefix + "n_symbols"),
        (F.size("__kf_lines") - F.size(F.array_distinct("__kf_lines"))).cast("long").alias(prefix + "n_dup_lines"), F.col("__kf_repeat").alias(prefix + "n_repeat_words"), failed.alias(prefix + "base_failed"),
    )


def host_verdicts(judged: DataFrame, host: str, failed: str, most: float = MOST_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunken failure rate and ``rejected``; hosts are pre-aggregated before the shuffle."""
    hosts = judged.groupBy(F.col(host).alias("__kf_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("__kf_mean"), F.var_pop(rate).alias("__kf_var"), F.avg(1 / F.col("host_docs")).alias("__kf_inverse"))
    mean = F.col("__kf_mean")
    spread = mean * (1 - mean)
    between = F.col("__kf_var") - spread * F.col("__kf_inverse")
    strength = F.when(between <= spread / (MOST_PRIOR + 1), F.lit(MOST_PRIOR)).otherwise(F.greatest(F.lit(LEAST_PRIOR), spread / between - 1))
    prior = prior.select("__kf_mean", strength.alias("__kf_strength"))
    shrunk = (F.col("__kf_strength") * mean + F.col("host_failures")) / (F.col("__kf_strength") + F.col("host_docs"))
    high = F.least(F.lit(most), F.greatest(TIMES_MEAN * mean, mean + DEVIATIONS * F.sqrt(spread / (F.col("__kf_strength") + 1))))
    rated = hosts.join(F.broadcast(prior))  # one row, the outcome of a global aggregate
    return rated.select("__kf_host", "host_docs", "host_failures", F.round(shrunk, 6).alias("host_rate"), (shrunk > high).alias("host_rejected"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = MOST_HOST_RATE) -> DataFrame:
    """Per row: id, base columns, the host's figures and ``kept``.

    The base columns are computed once and written (a few numbers a row); the
    text is not shuffled.
    """
    base = durable(with_base(df, F.col(f"`{text_col}`"), [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host")]), "quality-base")
    verdicts = host_verdicts(base, "host", "base_failed", most)
    joined = base.join(verdicts, F.col("host").eqNullSafe(F.col("__kf_host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), "host_docs", "host_failures", "host_rate",
    )


def filter_kept(df: DataFrame, text_col: str = "text", host_col: str = "source", most: float = MOST_HOST_RATE) -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns and no others."""
    plain, restore = positional(df)
    own, host = plain.columns, place(df, host_col)
    marked = with_base(plain, F.col(place(df, text_col)), [F.col(c) for c in own], "q_").select(*own, "q_base_failed")
    stored = durable(marked, "quality-docs")
    bad = host_verdicts(stored, host, "q_base_failed", most).where("host_rejected").select("__kf_host")
    good = stored.where(~F.col("q_base_failed"))
    return restore(good.join(bad, F.col(host).eqNullSafe(F.col("__kf_host")), "left_anti"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (SELECT source, count(*) AS host_docs, sum(base_failed::BIGINT)::BIGINT AS host_failures FROM judged GROUP BY source
), prior AS (SELECT m, v - m * (1 - m) * k AS v FROM (SELECT avg(host_failures / host_docs) AS m, var_pop(host_failures / host_docs) AS v, avg(1 / host_docs) AS k FROM hosts)
), strength AS (SELECT m, CASE WHEN v <= m * (1 - m) / 10001.0 THEN 10000.0 ELSE greatest(1.0, m * (1 - m) / v - 1) END AS s FROM prior
), rated AS (
  SELECT source, host_docs, host_failures, (s * m + host_failures) / (s + host_docs) AS rate, least(0.5, greatest(2 * m, m + 2 * sqrt(m * (1 - m) / (s + 1)))) AS high FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > high AS kept,
  host_docs, host_failures, round(rate, 6) AS host_rate
FROM judged JOIN rated ON judged.source IS NOT DISTINCT FROM rated.source
"""
