"""Candidate generation: inverted keys, inverse frequency weights, best K per reference record.

Country is part of the join key, so countries need no loop.  A record's
repeated tokens are folded into a multiplicity before anything is shuffled;
keys above the frequency cap are dropped below the join, which bounds the
candidate side of every key, and adaptive execution splits keys that are
frequent on the reference side.  Weights are summed as integers (billionths),
so that scores, and ties at the K boundary, do not depend on the order of
addition; ties go to the lesser candidate id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.text import frame_address, frame_country, frame_name

SCALE = 1_000_000_000


def normalize_records(df: DataFrame) -> DataFrame:
    """``df`` with the raw (null-filled) and normalised forms of name, address and country."""
    return df.withColumns({
        "business_name_raw": F.coalesce("business_name", F.lit("")),
        "business_address_raw": F.coalesce("business_address", F.lit("")),
        "country_raw": F.coalesce("country", F.lit("UNKNOWN")),
        "business_name_normalized": frame_name(F.col("business_name")),
        "business_address_normalized": frame_address(F.col("business_address")),
        "country_normalized": frame_country(F.col("country")),
    })


def _channel(prefix: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(prefix), t))


def key_array(prefix_keys: bool = False) -> Column:
    """All keys of a normalised record, repeats kept: name words, address words, 3 to 6 character integers."""
    name, address = F.split("business_name_normalized", " "), F.split("business_address_normalized", " ")
    raw = F.split(F.concat_ws(" ", "business_name_raw", "business_address_raw"), " ")
    parts = [
        _channel("nw:", F.filter(name, lambda w: F.length(w) >= 3)),
        _channel("aw:", F.filter(address, lambda w: F.length(w) >= 4)),
        _channel("d:", F.filter(raw, lambda w: w.rlike(r"^[+-]?[0-9]+\z") & F.length(w).between(3, 6))),
    ]
    if prefix_keys:
        parts.append(_channel("n3p:", F.transform(F.filter(name, lambda w: F.length(w) >= 3), lambda w: F.substring(w, 1, 3))))
    return F.concat(*parts)


def blocking_keys(df: DataFrame, prefix_keys: bool = False, dedupe_keys: bool = False) -> DataFrame:
    """(country, entity_id, key, times): each distinct key of a record and how often it has it."""
    keyed = normalize_records(df).select(F.col("country_raw").alias("country"), "entity_id", key_array(prefix_keys).alias("__keys"))
    keyed = keyed.select("country", "entity_id", F.array_sort("__keys").alias("__keys"))
    first = F.filter(F.transform("__keys", lambda k, i: F.when((i == 0) | (k != F.get("__keys", i - 1)), i)), lambda i: i.isNotNull())  # where runs of equal keys start
    keyed = keyed.select("country", "entity_id", "__keys", first.alias("__first"))
    runs = F.transform("__first", lambda i, j: F.struct(F.get("__keys", i).alias("key"), (F.coalesce(F.get("__first", j + 1), F.size("__keys")) - i).cast("long").alias("times")))
    exploded = keyed.select("country", "entity_id", F.explode(runs).alias("k"))
    times = F.lit(1).cast("long") if dedupe_keys else F.col("k.times")
    return exploded.select("country", "entity_id", F.col("k.key").alias("key"), times.alias("times"))


#: Words that the pattern channel takes out of names, and out of addresses.
NAME_STOP_WORDS = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "pvt", "private", "co", "company", "and", "or", "the", "of", "for", "in", "on", "at", "to", "a", "an", "sa", "sarl", "gmbh",
    "enterprises", "services", "solutions", "systems", "traders", "group", "center", "service", "shop", "store", "llp",
)
ADDRESS_STOP_WORDS = (
    "road", "street", "lane", "nagar", "city", "flat", "near", "floor", "block", "plot", "building", "opp", "opposite", "behind", "post", "dist", "district", "state", "maharashtra", "delhi", "karnataka", "kerala",
    "tamil", "nadu", "gujarat", "bengal", "uttar", "pradesh", "rajasthan", "andhra", "telangana", "route", "rue", "avenue", "bd", "boulevard", "cedex", "paris",
)


def pattern_keys(df: DataFrame) -> DataFrame:
    """(country, entity_id, key), distinct: words, numbers and three-letter prefixes found by pattern after stop words are taken out."""
    without = lambda c, words: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)\b(?:{'|'.join(words)})\b", "")
    cleaned = df.select(F.coalesce("country", F.lit("UNKNOWN")).alias("country"), "entity_id", without("business_name", NAME_STOP_WORDS).alias("n"), without("business_address", ADDRESS_STOP_WORDS).alias("a"))
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(rf"(?U)\b{pattern}\b"), 0)
    words, both = found(F.col("n"), "[a-z0-9]{3,}"), F.concat_ws(" ", "n", "a")
    prefixes = F.transform(words, lambda w: F.substring(w, 1, 3))
    keys = F.concat(_channel("nw:", words), _channel("aw:", found(F.col("a"), "[a-z]{3,}")), _channel("d:", found(both, r"[0-9]{1,6}")), _channel("n3p:", prefixes))
    return cleaned.select("country", "entity_id", F.explode(F.array_distinct(keys)).alias("key"))


def key_weights(candidate_keys: DataFrame, max_key_freq: int) -> DataFrame:
    """(country, key, df, weight): ``1 / (1 + ln df)`` for keys with at most ``max_key_freq`` occurrences."""
    counts = candidate_keys.groupBy("country", "key").agg(F.sum("times").alias("df")).where(F.col("df") <= max_key_freq)
    return counts.select("country", "key", "df", (1.0 / (1.0 + F.log("df"))).alias("weight"))


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference (S1) and candidate (S2, S3) records by id prefix."""
    return records.where(F.col("entity_id").startswith("S1-")), records.where(F.col("entity_id").startswith("S2-") | F.col("entity_id").startswith("S3-"))


def scores(s1: DataFrame, others: DataFrame, max_key_freq: int = 2000, prefix_keys: bool = False, dedupe_keys: bool = False) -> DataFrame:
    """(s1_id, cand_id, blocking_score) of every pair that shares a key within a country."""
    mine = blocking_keys(s1, prefix_keys, dedupe_keys).withColumnsRenamed({"entity_id": "s1_id", "times": "m"})
    theirs = blocking_keys(others, prefix_keys, dedupe_keys).withColumnsRenamed({"entity_id": "cand_id", "times": "n"})
    weights = key_weights(theirs.withColumnRenamed("n", "times"), max_key_freq).select("country", "key", F.round(F.col("weight") * SCALE).cast("long").alias("w"))
    hits = mine.join(theirs.join(weights, ["country", "key"]), ["country", "key"])
    # One exchange, by reference record, serves the sums, the ranking and the join that adds records without candidates.
    summed = hits.repartition("s1_id").groupBy("s1_id", "cand_id").agg(F.sum(F.col("m") * F.col("n") * F.col("w")).alias("__score"))
    return summed.select("s1_id", "cand_id", (F.col("__score") / SCALE).alias("blocking_score"))


def best(pair_scores: DataFrame, top_k: int = 50) -> DataFrame:
    """The ``top_k`` candidates of every reference record, with their ``rank`` from 1."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("blocking_score"), "cand_id")
    return pair_scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def candidates(s1: DataFrame, others: DataFrame, top_k: int = 50, max_key_freq: int = 2000, prefix_keys: bool = False, dedupe_keys: bool = False) -> DataFrame:
    """Best candidates, and a row with nulls for each reference record without any."""
    top = best(scores(s1, others, max_key_freq, prefix_keys, dedupe_keys), top_k)
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(top, "s1_id", "left")


def diagnostics(s1: DataFrame, others: DataFrame, found: DataFrame) -> DataFrame:
    """One row: sizes, pairs, the share of the cross product that blocking avoids, and candidates per reference record."""
    n1 = s1.agg(F.count(F.lit(1)).alias("total_s1_entities"))
    n2 = others.agg(F.count(F.when(F.col("entity_id").startswith("S2-"), 1)).alias("total_s2_records"), F.count(F.when(F.col("entity_id").startswith("S3-"), 1)).alias("total_s3_records"))
    n3 = found.agg(F.count("cand_id").alias("total_candidate_pairs"))
    row = n1.join(F.broadcast(n2)).join(F.broadcast(n3))  # one row each
    possible = F.col("total_s1_entities") * (F.col("total_s2_records") + F.col("total_s3_records"))
    pairs = F.col("total_candidate_pairs")
    return row.select(
        "total_s1_entities", "total_s2_records", "total_s3_records", possible.alias("total_possible_pairs"), pairs.alias("total_candidate_pairs"),
        F.when(possible > 0, 1.0 - F.try_divide(pairs, possible)).otherwise(1.0).alias("candidate_reduction_ratio"), F.coalesce(F.try_divide(pairs, F.col("total_s1_entities")), F.lit(0.0)).alias("avg_candidates_per_s1"),
    )
