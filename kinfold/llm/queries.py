"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import avi, bytebpe, chat, langid, mixing, omh, quality, tokencount, tokenstore, urlfilter
from kinfold.session import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of("doc_id") == 2, F.lit(True))
    profiles = langid.fit(docs.where(~held_out), key=docs["doc_id"])
    return langid.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Dated list entries of the query: (domain, action, day). Fixed values.
LIST_ENTRIES = (
    ("spam-farm.example.org", "block", "2024-01-01"),
    ("spam-farm.example.org", "remove", "2024-09-01"),
    ("spam-farm.example.org", "block", "2025-03-01"),
    ("example.org", "block", "2024-06-15"),
    ("example.org", "remove", "2024-08-01"),
    ("tionsh.example.net", "block", "2024-02-01"),
    ("tionsh.example.net", "allow", "2024-05-01"),
    ("tionsh.example.net", "remove", "2024-11-20"),
    ("blog.tionble.example.com", "block", "2024-03-10"),
    ("m.tiontion.example.com", "allow", "2024-01-15"),
    ("example.com", "block", "2025-01-01"),
    ("example.com", "remove", "2025-02-01"),
    ("ththre.example.com", "allow", "2025-01-10"),
    ("ththan.example.net", "block", "2025-06-01"),
    ("ththan.example.net", "allow", "2025-06-01"),
    ("example.net", "block", "2025-10-01"),
)
#: ``pages`` has no fetch time; a capture's day follows from its id within two years.
FIRST_DAY, DAYS = "2024-01-01", 731
#: Beside the fixed entries, the list has this many for every host of the table, with actions and days from a hash.
ENTRIES_A_HOST = 40


def _listed(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    each = hosts.select("domain", F.explode(F.sequence(F.lit(1), F.lit(ENTRIES_A_HOST))).alias("i"))
    code = F.conv(F.substring(F.md5(F.concat_ws("#", "domain", "i").cast("binary")), 1, 6), 16, 10).cast("int")
    action = F.element_at(F.array(*[F.lit(a) for a in urlfilter.ACTIONS]), code % 3 + 1)
    return each.select("domain", action.alias("action"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(code / 3).cast("int") % DAYS).alias("day"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")))
    entries = spark.createDataFrame([(d, a, datetime.date.fromisoformat(x)) for d, a, x in LIST_ENTRIES], "domain string, action string, day date")
    return urlfilter.evaluate(captures, entries.unionByName(_listed(pages))).withColumnRenamed("id", "page_id")


OP2_SQL = rf"""
WITH fixed(domain, action, day) AS (VALUES {", ".join(f"('{d}', '{a}', DATE '{x}')" for d, a, x in LIST_ENTRIES)}
), hosts AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')) AS domain FROM pages
), coded AS (SELECT domain, ('0x' || substr(md5(domain || '#' || i), 1, 6))::INTEGER AS code FROM hosts, (SELECT unnest(generate_series(1, {ENTRIES_A_HOST})) AS i) WHERE domain <> ''
), entries AS (SELECT * FROM fixed UNION ALL SELECT domain, ['remove', 'allow', 'block'][code % 3 + 1], (DATE '{FIRST_DAY}' + ((code // 3) % {DAYS})::INTEGER)::DATE FROM coded
), latest AS (SELECT domain, day, max_by(action, list_position(['remove', 'allow', 'block'], action)) AS action FROM entries GROUP BY domain, day
), spans AS (SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM latest
), captures AS (
  SELECT page_id, coalesce(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')), '') AS host,
    (DATE '{FIRST_DAY}' + (((page_id % {DAYS}) + {DAYS}) % {DAYS})::INTEGER)::DATE AS fetch_day FROM pages
), active AS (
  SELECT page_id, host, fetch_day, domain, action, valid_from FROM captures LEFT JOIN spans
    ON (host = domain OR ends_with(host, '.' || domain)) AND fetch_day >= valid_from AND (valid_to IS NULL OR fetch_day < valid_to) AND action <> 'remove'
)
SELECT page_id, host, fetch_day, max_by(domain, length(domain)) AS matched_domain, max_by(action, length(domain)) AS action, max_by(valid_from, length(domain)) AS active_since,
  count(domain)::BIGINT AS n_active, CASE WHEN max_by(action, length(domain)) = 'block' THEN 'block' ELSE 'allow' END AS verdict
FROM active GROUP BY page_id, host, fetch_day
"""


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.read_store(tokenstore.write_store(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = omh.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("rows").alias("n_rows"), F.col("links").alias("n_links"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


#: Conversation -7 of the query: control strings of common templates inside its texts.
PROBE = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for c, n, r, t in PROBE])).alias("p")).select("p.*")
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of every document's film."""
    return avi.clip_rows(avi.to_media(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.mix(docs, mixing.tempered_weights(docs))
    return mixed.select("doc_id", "source", *[F.col(f"__kf_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "pos")])


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_token_output, op4_near_duplicates, op5_token_counts, op6_byte_bpe, op7_chat_format, op8_quality_rules, op9_media, op10_mixing, media_clips)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op7_chat_format": chat.SQL, "op8_quality_rules": quality.SQL, "op10_mixing": mixing.SQL}
