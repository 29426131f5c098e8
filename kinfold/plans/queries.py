"""Registered entity-resolution queries over the derived records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.durable import durable
from kinfold.functions.text import ADDRESS_WORDS, LEGAL_WORDS, frame_address, frame_name
from kinfold.operators import blocking, features, matching, metrics, reports, validator
from kinfold.plans.ratio_sql import four_places, fuzzy_sql, heuristic_sql
from kinfold.sources import synthetic, tsv

CAP, TOP_K, GRID = Config().max_key_freq, 50, (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def _sources(spark, sf_dir):
    return blocking.split_sources(synthetic.records(spark, sf_dir))


def _ids(spark, sf_dir) -> DataFrame:
    return _sources(spark, sf_dir)[0].select(F.col("entity_id").alias("s1_id"))


def _truth(spark, sf_dir) -> DataFrame:
    return metrics.truth_pairs(synthetic.truth(spark, sf_dir))


def _top(spark, sf_dir) -> DataFrame:
    return blocking.candidates(*_sources(spark, sf_dir), top_k=TOP_K, max_key_freq=CAP)


def _jaccard_scored(spark, sf_dir, top: DataFrame | None = None) -> DataFrame:
    """Candidates scored by the overlap of their frame-normalised words: a score that SQL can express too."""
    words = synthetic.records(spark, sf_dir).select("entity_id", F.array_distinct(F.split(F.concat_ws(" ", frame_name(F.col("business_name")), frame_address(F.col("business_address"))), " ")).alias("w"))
    x, y = words.select(F.col("entity_id").alias("s1_id"), F.col("w").alias("x")), words.select(F.col("entity_id").alias("cand_id"), F.col("w").alias("y"))
    both = (_top(spark, sf_dir) if top is None else top).where("cand_id is not null").join(x, "s1_id").join(y, "cand_id")
    return both.select("s1_id", "cand_id", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("prob"))


def scan_er_records(spark, sf_dir):
    return synthetic.records(spark, sf_dir)


def normalize_frame(spark, sf_dir):
    return blocking.normalize_records(synthetic.records(spark, sf_dir)).drop("business_name", "business_address", "country")


def blocking_keys(spark, sf_dir):
    return blocking.blocking_keys(synthetic.records(spark, sf_dir))


def blocking_keys_prefix(spark, sf_dir):
    return blocking.blocking_keys(synthetic.records(spark, sf_dir), prefix_keys=True, dedupe_keys=True)


def pattern_blocking_keys(spark, sf_dir):
    return blocking.pattern_keys(synthetic.records(spark, sf_dir))


def key_idf_weights(spark, sf_dir):
    keys = blocking.blocking_keys(_sources(spark, sf_dir)[1])
    return blocking.key_weights(keys, CAP).withColumn("weight", F.round("weight", 6))


def blocking_scores(spark, sf_dir):
    return blocking.scores(*_sources(spark, sf_dir), max_key_freq=CAP).withColumn("blocking_score", F.round("blocking_score", 6))


def candidates_topk(spark, sf_dir):
    return _top(spark, sf_dir).withColumn("blocking_score", F.round("blocking_score", 6))


def candidate_lists(spark, sf_dir):
    return tsv.id_lists(_ids(spark, sf_dir), _top(spark, sf_dir), "candidate_entity_ids")


def fast_candidates(spark, sf_dir):
    from kinfold.plans.resolve import fast_mode

    return fast_mode(candidate_lists(spark, sf_dir)).withColumn("blocking_score", F.round("blocking_score", 6)).withColumn("position", F.col("position").cast("long"))


def exact_name_baseline(spark, sf_dir):
    return matching.exact_name_baseline(_top(spark, sf_dir), synthetic.records(spark, sf_dir))


def truth_pairs(spark, sf_dir):
    return _truth(spark, sf_dir)


def cross_country_check(spark, sf_dir):
    """True pairs of different countries, with the S3 labels in lower case so that there are some to find: labels are compared raw."""
    records = synthetic.records(spark, sf_dir)
    return reports.cross_country(_truth(spark, sf_dir), records.withColumn("country", F.when(F.col("entity_id").startswith("S3-"), F.lower("country")).otherwise(F.col("country"))))


def country_counts(spark, sf_dir):
    return reports.country_counts(synthetic.records(spark, sf_dir))


def match_histogram(spark, sf_dir):
    return reports.match_histogram(synthetic.truth(spark, sf_dir))


def truth_summary(spark, sf_dir):
    return reports.truth_summary(synthetic.truth(spark, sf_dir))


def blocking_recall(spark, sf_dir):
    return metrics.blocking_recall(_truth(spark, sf_dir), _top(spark, sf_dir)).withColumn("blocking_recall", F.round("blocking_recall", 6))


def blocking_diagnostics(spark, sf_dir):
    row = blocking.diagnostics(*_sources(spark, sf_dir), _top(spark, sf_dir))
    return row.withColumns({c: F.round(c, 6) for c in ("candidate_reduction_ratio", "avg_candidates_per_s1")})


def _rounded(row: DataFrame) -> DataFrame:
    return row.withColumns({c: F.round(c, 6) for c, kind in row.dtypes if kind == "double"})


def pair_metrics(spark, sf_dir):
    return _rounded(metrics.evaluate(_ids(spark, sf_dir), _truth(spark, sf_dir), exact_name_baseline(spark, sf_dir)))


def macro_f05(spark, sf_dir):
    return _rounded(metrics.entity_scores(_ids(spark, sf_dir), _truth(spark, sf_dir), matching.decide(_jaccard_scored(spark, sf_dir), 0.5)))


def threshold_grid(spark, sf_dir):
    return _rounded(metrics.threshold_table(_ids(spark, sf_dir), _truth(spark, sf_dir), _jaccard_scored(spark, sf_dir), GRID))


def matches_decided(spark, sf_dir):
    top = durable(_top(spark, sf_dir), "er-candidates")
    return matching.decide(_jaccard_scored(spark, sf_dir, top), 0.55, top)


def matching_lists(spark, sf_dir):
    return tsv.id_lists(_ids(spark, sf_dir), matches_decided(spark, sf_dir), "matched_entity_ids")


def error_samples(spark, sf_dir):
    return reports.error_samples(_truth(spark, sf_dir), matching.decide(_jaccard_scored(spark, sf_dir), 0.5), synthetic.records(spark, sf_dir))


def native_features(spark, sf_dir):
    return _rounded(features.pair_features(_top(spark, sf_dir), synthetic.records(spark, sf_dir), fuzzy=False))


def token_jaccard(spark, sf_dir):
    return _jaccard_scored(spark, sf_dir)


def digit_overlap(spark, sf_dir):
    full = features.pair_features(_top(spark, sf_dir), synthetic.records(spark, sf_dir), fuzzy=False)
    return _rounded(full.select("s1_id", "cand_id", "dig_jaccard", "dig_exact_match", "dig_count_shared"))


def validator_violations(spark, sf_dir):
    """Result lines with planted faults: every kind of rule fires for some records."""
    lists = tsv.id_lists(_ids(spark, sf_dir), _truth(spark, sf_dir), "ids")
    number = F.substring("source1_entity_id", 4, 20).cast("long")
    line = F.concat_ws("\t", "source1_entity_id", "ids")
    faulty = F.when(number % 11 == 0, F.col("source1_entity_id")).when(number % 13 == 0, F.concat(line, F.lit(",S1-1"))).when(number % 17 == 0, F.concat(line, F.lit(", S2-5"))).when(number % 19 == 0, F.concat(line, F.lit(",S3-x,S3-x"))).when(number % 23 == 0, F.concat(F.lit("X"), line)).otherwise(line)
    lines = lists.select(faulty.alias("line"))
    s1, others = _sources(spark, sf_dir)
    return validator.violations(lines, s1.select(F.col("entity_id").alias("id")), others.select(F.col("entity_id").alias("id")))


def id_anti_join(spark, sf_dir):
    """Reference records whose true matches are not all among their candidates."""
    return validator.not_in_candidates(_truth(spark, sf_dir), _top(spark, sf_dir).where("cand_id is not null"))


def _some_unknown(spark, sf_dir) -> DataFrame:
    """Candidates of which those with an id that 7 divides name a record that there is not."""
    top = _top(spark, sf_dir).where("cand_id is not null")
    return top.withColumn("cand_id", F.when(F.split_part("cand_id", F.lit("-"), F.lit(2)).cast("long") % 7 == 0, F.concat(F.col("cand_id"), F.lit("x"))).otherwise(F.col("cand_id")))


def features_with_unknown_ids(spark, sf_dir):
    full = features.pair_features(_some_unknown(spark, sf_dir), synthetic.records(spark, sf_dir), fuzzy=False, keep_unknown=True)
    return _rounded(full.select("s1_id", "cand_id", "name_exact_match", "name_len_diff", "addr_missing_flag", "name_jaccard", "dig_count_shared", "is_s2"))


def fast_mode_features(spark, sf_dir):
    """The native features of the fast mode, over the first five of every list."""
    from kinfold.plans.resolve import fast_mode

    records = synthetic.records(spark, sf_dir)
    return _rounded(features.pair_features(fast_mode(candidate_lists(spark, sf_dir)), records, fuzzy=False, view=features.fast_view(records)))


def overlap_scores(spark, sf_dir):
    """The hand-weighted scorer with plain word overlaps in place of fuzzy ratios."""
    scored = matching.score_pairs(_request_pairs(spark, sf_dir), native=True)
    return scored.select("s1_id", "cand_id", "confidence_score", "is_match", "decision", "numeric_anchor_match")


def fuzzy_features(spark, sf_dir):
    return _rounded(features.pair_features(_top(spark, sf_dir), synthetic.records(spark, sf_dir)))


def _request_pairs(spark, sf_dir) -> DataFrame:
    records = synthetic.records(spark, sf_dir)
    x = records.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_address"), F.col("country").alias("s1_country"))
    y = records.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("cand_name"), F.col("business_address").alias("cand_address"), F.col("country").alias("cand_country"))
    return _top(spark, sf_dir).where("cand_id is not null").select("s1_id", "cand_id", "rank").join(x, "s1_id").join(y, "cand_id")


def heuristic_score(spark, sf_dir):
    return matching.ranked_batch(matching.score_pairs(_request_pairs(spark, sf_dir)).withColumnRenamed("rank", "position"), "s1_id").select("s1_id", "cand_id", "confidence_score", "is_match", "decision", "rank", "total_candidates", "match_count")


def gbt_match(spark, sf_dir):
    """Train, choose a threshold, and score: the metrics on held-out reference records."""
    from kinfold.plans import resolve

    done = resolve.train(synthetic.records(spark, sf_dir), _truth(spark, sf_dir), Config())
    return done.test_metrics.withColumn("threshold", F.lit(done.threshold))


# -- SQL ----------------------------------------------------------------------
_KEYS = r"""
prep AS (
  SELECT entity_id, coalesce(business_name, '') AS business_name_raw, coalesce(business_address, '') AS business_address_raw, coalesce(country, 'UNKNOWN') AS country_raw,
    trim(regexp_replace(regexp_replace(replace(lower(coalesce(business_name, '')), '&', ' and '), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS business_name_normalized,
    trim(regexp_replace(regexp_replace(lower(coalesce(business_address, '')), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS business_address_normalized,
    trim(upper(coalesce(country, 'UNKNOWN'))) AS country_normalized
  FROM records
), tokens AS (
  SELECT country_raw AS country, entity_id, 'nw:' || w AS key FROM (SELECT country_raw, entity_id, unnest(string_split(business_name_normalized, ' ')) AS w FROM prep) WHERE length(w) >= 3
  UNION ALL SELECT country_raw, entity_id, 'aw:' || w FROM (SELECT country_raw, entity_id, unnest(string_split(business_address_normalized, ' ')) AS w FROM prep) WHERE length(w) >= 4
  UNION ALL SELECT country_raw, entity_id, 'd:' || w FROM (SELECT country_raw, entity_id, unnest(string_split(business_name_raw || ' ' || business_address_raw, ' ')) AS w FROM prep) WHERE regexp_full_match(w, '[+-]?[0-9]+') AND length(w) BETWEEN 3 AND 6
), keys AS (SELECT country, entity_id, key, count(*)::BIGINT AS times FROM tokens GROUP BY ALL)"""
_SCORES = f"""{_KEYS}, weights AS (
  SELECT country, key, sum(times)::BIGINT AS df, 1.0::DOUBLE / (1.0 + ln(sum(times)::DOUBLE)) AS weight FROM keys WHERE entity_id NOT LIKE 'S1-%' GROUP BY country, key HAVING sum(times) <= {CAP}
), scored AS (
  SELECT x.entity_id AS s1_id, y.entity_id AS cand_id, sum(x.times * y.times * round(w.weight * 1e9)::BIGINT)::DOUBLE / 1e9 AS score
  FROM keys x JOIN keys y ON x.country = y.country AND x.key = y.key JOIN weights w ON w.country = y.country AND w.key = y.key WHERE x.entity_id LIKE 'S1-%' AND y.entity_id NOT LIKE 'S1-%' GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM scored
), top AS (SELECT * FROM ranked WHERE rank <= {TOP_K}
), ids AS (SELECT DISTINCT entity_id AS s1_id FROM records WHERE entity_id LIKE 'S1-%'
), pairs AS (SELECT DISTINCT source1_entity_id AS s1_id, trim(c) AS cand_id FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS c FROM truth) WHERE trim(c) <> '')"""
_JACCARD = f"""{_SCORES}, words AS (SELECT entity_id, list_distinct(string_split(concat_ws(' ', business_name_normalized, business_address_normalized), ' ')) AS w FROM prep
), jac AS (
  SELECT s1_id, cand_id, round(len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))), 6) AS prob FROM top JOIN words x ON x.entity_id = s1_id JOIN words y ON y.entity_id = cand_id
)"""


def _metrics_sql(predicted: str, name: str = "ent") -> str:
    return f"""marks AS (SELECT s1_id, cand_id, max(t) AS t, max(p) AS p FROM (SELECT s1_id, cand_id, 1 AS t, 0 AS p FROM pairs UNION ALL SELECT s1_id, cand_id, 0, 1 FROM {predicted}) GROUP BY 1, 2
), cnt AS (SELECT s1_id, sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred, sum(t * p)::BIGINT AS tp FROM (SELECT s1_id, t, p FROM marks UNION ALL SELECT s1_id, 0, 0 FROM ids) GROUP BY 1
), pr AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_pred END AS precision, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_true END AS recall FROM cnt
), {name} AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM pr)"""


_GRID_SQL = f"""grid AS (SELECT unnest([{", ".join(f"{g}::DOUBLE" for g in GRID)}]) AS threshold
), cnt AS (
  SELECT threshold, s1_id, sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred, sum(t * p)::BIGINT AS tp FROM (
    SELECT threshold, s1_id, cand_id, max(t) AS t, max(p) AS p FROM (
      SELECT threshold, s1_id, cand_id, 1 AS t, 0 AS p FROM pairs, grid UNION ALL SELECT threshold, s1_id, cand_id, 0, (prob >= threshold)::INT FROM jac, grid UNION ALL SELECT threshold, s1_id, NULL, 0, 0 FROM ids, grid) GROUP BY ALL) GROUP BY ALL
), pr AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_pred END AS p, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 THEN 0 ELSE tp::DOUBLE / n_true END AS r FROM cnt
), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 1.25 * p * r / (0.25 * p + r) END AS f05 FROM pr)
SELECT threshold, round(avg(f05), 6) AS macro_f05, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(coalesce(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE END), 1.0), 6) AS singleton_accuracy FROM f GROUP BY threshold"""

_SUMMARY = """SELECT round(macro_f05, 6) AS macro_f05, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(singleton_accuracy, 6) AS singleton_accuracy, singleton_count, singleton_correct, total_true_pairs, total_predicted_pairs, true_positives,
  round(p, 6) AS pair_precision, round(r, 6) AS pair_recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS pair_f05, total_predicted_pairs - true_positives AS false_merges, total_true_pairs - true_positives AS false_negatives
FROM (SELECT *, coalesce(true_positives::DOUBLE / nullif(total_predicted_pairs, 0), 0) AS p, coalesce(true_positives::DOUBLE / nullif(total_true_pairs, 0), 0) AS r FROM (
  SELECT avg(f05) AS macro_f05, avg(precision) AS macro_precision, avg(recall) AS macro_recall, coalesce(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE END), 1.0) AS singleton_accuracy,
    count(*) FILTER (n_true = 0) AS singleton_count, count(*) FILTER (n_true = 0 AND n_pred = 0) AS singleton_correct, sum(n_true)::BIGINT AS total_true_pairs, sum(n_pred)::BIGINT AS total_predicted_pairs, sum(tp)::BIGINT AS true_positives FROM ent))"""

_LEGAL = "|".join(LEGAL_WORDS)
#: strip_accents is the fold of the letters that the generator uses.
_NAME = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(strip_accents({c})), '&', ' and '), '@', ' '), '[^\\w\\s]', ' ', 'g'), '\\b(?:{_LEGAL})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def _address(c: str) -> str:
    out = f"lower(strip_accents({c}))"
    for short, long in ADDRESS_WORDS.items():
        out = f"regexp_replace({out}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_VIEW = f"""{_SCORES}, view AS (
  SELECT *, list_distinct(regexp_extract_all({_NAME('n')}, '\\b[a-z0-9]{{3,}}\\b')) AS nt, list_distinct(regexp_extract_all({_NAME('a')}, '\\b[a-z0-9]{{3,}}\\b')) AS at, list_distinct(regexp_extract_all(name || ' ' || addr, '\\b\\d{{1,6}}\\b')) AS dg
  FROM (SELECT entity_id, name, addr, country, {_NAME('name')} AS n, {_address('addr')} AS a FROM (SELECT entity_id, coalesce(business_name, '') AS name, coalesce(business_address, '') AS addr, country FROM records))
), h AS (
  SELECT s1_id, cand_id, score, x.name AS xname, y.name AS yname, x.addr AS xaddr, y.addr AS yaddr, x.n AS xn, y.n AS yn, x.a AS xa, y.a AS ya, x.nt AS xnt, y.nt AS ynt, x.at AS xat, y.at AS yat, x.dg AS xdg, y.dg AS ydg, x.country AS xc, y.country AS yc, (x.addr IN ('', 'None') OR y.addr IN ('', 'None')) AS gone
  FROM top JOIN view x ON x.entity_id = s1_id JOIN view y ON y.entity_id = cand_id
)"""
_J = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_DIGITS = f"round({_J('xdg', 'ydg')}, 6) AS dig_jaccard, (len(list_intersect(xdg, ydg)) > 0)::INT::DOUBLE AS dig_exact_match, len(list_intersect(xdg, ydg))::DOUBLE AS dig_count_shared"
_NATIVE_SQL = f"""SELECT s1_id, cand_id, (lower(xname) = lower(yname) AND xname <> '')::INT::DOUBLE AS name_exact_match, (xn = yn AND xn <> '')::INT::DOUBLE AS name_norm_equality, round({_J('xnt', 'ynt')}, 6) AS name_jaccard,
  abs(length(xn) - length(yn))::DOUBLE AS name_len_diff, abs(len(xnt) - len(ynt))::DOUBLE AS name_token_count_diff, (xn[1:4] = yn[1:4] AND xn <> '')::INT::DOUBLE AS name_prefix_sim, (right(xn, 4) = right(yn, 4) AND xn <> '')::INT::DOUBLE AS name_suffix_sim,
  (NOT gone AND lower(xaddr) = lower(yaddr))::INT::DOUBLE AS addr_exact_match, round(CASE WHEN gone THEN 0.0 ELSE {_J('xat', 'yat')} END, 6) AS addr_jaccard, abs(length(xa) - length(ya))::DOUBLE AS addr_len_diff, gone::INT::DOUBLE AS addr_missing_flag, {_DIGITS},
  (coalesce(upper(trim(xc)), 'NONE') = coalesce(upper(trim(yc)), 'NONE'))::INT::DOUBLE AS country_exact_match, starts_with(cand_id, 'S2-')::INT::DOUBLE AS is_s2, round(score, 6) AS blocking_score FROM h"""
_BASELINE = "named AS (SELECT s1_id, cand_id FROM top JOIN records x ON x.entity_id = s1_id JOIN records y ON y.entity_id = cand_id WHERE lower(trim(coalesce(x.business_name, ''))) = lower(trim(coalesce(y.business_name, ''))) AND trim(coalesce(x.business_name, '')) <> '')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_WORDS_OF = lambda c, stop: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: NOT list_contains({_LIST(stop)}, w))"
_PATTERN_KEYS = f"""cleaned AS (SELECT coalesce(country, 'UNKNOWN') AS country, entity_id, {_WORDS_OF('business_name', blocking.NAME_STOP_WORDS)} AS n, {_WORDS_OF('business_address', blocking.ADDRESS_STOP_WORDS)} AS a FROM records
), found AS (
  SELECT country, entity_id, unnest(list_transform(list_filter(n, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}')), lambda w: 'nw:' || w)) AS key FROM cleaned
  UNION ALL SELECT country, entity_id, unnest(list_transform(list_filter(a, lambda w: regexp_full_match(w, '[a-z]{{3,}}')), lambda w: 'aw:' || w)) FROM cleaned
  UNION ALL SELECT country, entity_id, unnest(list_transform(list_filter(list_concat(n, a), lambda w: regexp_full_match(w, '[0-9]{{1,6}}')), lambda w: 'd:' || w)) FROM cleaned
  UNION ALL SELECT country, entity_id, unnest(list_transform(list_filter(n, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}')), lambda w: 'n3p:' || substr(w, 1, 3))) FROM cleaned)"""
_UNKNOWN_SQL = f"""SELECT s1_id, cand_id, (lower(xname) = lower(yname) AND xname <> '')::INT::DOUBLE AS name_exact_match, abs(length(xn) - length(yn))::DOUBLE AS name_len_diff, (xaddr IN ('', 'None') OR yaddr IN ('', 'None'))::INT::DOUBLE AS addr_missing_flag,
  round({_J('xnt', 'ynt')}, 6) AS name_jaccard, len(list_intersect(xdg, ydg))::DOUBLE AS dig_count_shared, starts_with(cand_id, 'S2-')::INT::DOUBLE AS is_s2
FROM (SELECT t.s1_id, t.cand_id, x.name AS xname, coalesce(y.name, '') AS yname, x.n AS xn, coalesce(y.n, '') AS yn, x.addr AS xaddr, coalesce(y.addr, '') AS yaddr, x.nt AS xnt, coalesce(y.nt, []::VARCHAR[]) AS ynt, x.dg AS xdg, coalesce(y.dg, []::VARCHAR[]) AS ydg
  FROM (SELECT s1_id, CASE WHEN split_part(cand_id, '-', 2)::BIGINT % 7 = 0 THEN cand_id || 'x' ELSE cand_id END AS cand_id FROM top) t JOIN view x ON x.entity_id = t.s1_id LEFT JOIN view y ON y.entity_id = t.cand_id)"""
_FAST_H = f"""{_SCORES}, fast AS (SELECT s1_id, cand_id, 5.0::DOUBLE / (1 + position) AS score FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY cand_id) - 1 AS position FROM top) WHERE position < 5
), fview AS (
  SELECT *, list_filter("at", lambda w: regexp_full_match(w, '\\p{{Nd}}+')) AS dg FROM (SELECT entity_id, country_raw AS country, business_name_normalized AS n, business_address_normalized AS a,
    list_distinct(list_filter(string_split(business_name_normalized, ' '), lambda w: w <> '')) AS nt, list_distinct(list_filter(string_split(business_address_normalized, ' '), lambda w: w <> '')) AS at FROM prep)
), h AS (
  SELECT s1_id, cand_id, score, x.n AS xname, y.n AS yname, x.a AS xaddr, y.a AS yaddr, x.n AS xn, y.n AS yn, x.a AS xa, y.a AS ya, x.nt AS xnt, y.nt AS ynt, x.at AS xat, y.at AS yat, x.dg AS xdg, y.dg AS ydg, x.country AS xc, y.country AS yc, (x.a IN ('', 'None') OR y.a IN ('', 'None')) AS gone
  FROM fast JOIN fview x ON x.entity_id = s1_id JOIN fview y ON y.entity_id = cand_id)"""
_SPLIT = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
_SET = lambda a, b: _J(f"list_distinct({_SPLIT(a)})", f"list_distinct({_SPLIT(b)})")
_OVERLAP_SQL = f"""SELECT s1_id, cand_id, confidence_score, confidence_score >= 0.6 AS is_match, CASE WHEN confidence_score >= 0.6 THEN 'MATCH' ELSE 'NO_MATCH' END AS decision, anchored AS numeric_anchor_match FROM (
  SELECT *, CASE WHEN apart THEN 0.0 ELSE {four_places('CASE WHEN anchored THEN least(1.0::DOUBLE, raw + 0.05::DOUBLE) ELSE raw END')} END AS confidence_score FROM (
    SELECT *, CASE WHEN xa <> '' AND ya <> '' THEN 0.5::DOUBLE * by_set + 0.2::DOUBLE * by_sort + 0.3::DOUBLE * by_addr ELSE 0.7::DOUBLE * by_set + 0.3::DOUBLE * by_sort END AS raw FROM (
      SELECT s1_id, cand_id, xa, ya, list_has_any(xdg, ydg) AS anchored, trim(coalesce(xc, '')) <> '' AND trim(coalesce(yc, '')) <> '' AND lower(trim(xc)) <> lower(trim(yc)) AS apart, {_SET('xn', 'yn')} AS by_set, {_SET('xa', 'ya')} AS by_addr,
        CASE WHEN list_sort({_SPLIT('xn')}) = list_sort({_SPLIT('yn')}) AND xn <> '' THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_intersect({_SPLIT('xn')}, {_SPLIT('yn')})) / nullif(len(list_distinct({_SPLIT('xn')})) + len(list_distinct({_SPLIT('yn')})), 0), 0) END AS by_sort FROM h)))"""
_LINES = """, lists AS (SELECT ids.s1_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS l, split_part(ids.s1_id, '-', 2)::BIGINT AS k FROM ids LEFT JOIN pairs ON pairs.s1_id = ids.s1_id GROUP BY ids.s1_id
), lines AS (
  SELECT CASE WHEN k % 11 = 0 THEN s1_id WHEN k % 13 = 0 THEN s1_id || chr(9) || l || ',S1-1' WHEN k % 17 = 0 THEN s1_id || chr(9) || l || ', S2-5' WHEN k % 19 = 0 THEN s1_id || chr(9) || l || ',S3-x,S3-x' WHEN k % 23 = 0 THEN 'X' || s1_id || chr(9) || l ELSE s1_id || chr(9) || l END AS line FROM lists
), good AS (SELECT split_part(line, chr(9), 1) AS s1_id, split_part(line, chr(9), 2) AS l FROM lines WHERE contains(line, chr(9))
), each AS (SELECT s1_id, unnest(string_split(l, ',')) AS id FROM good WHERE trim(l) <> '')
SELECT 'no_tab' AS rule, NULL AS s1_id, line AS detail FROM lines WHERE NOT contains(line, chr(9))
UNION ALL SELECT 'duplicate_row', s1_id, count(*)::VARCHAR FROM good GROUP BY s1_id HAVING count(*) > 1
UNION ALL SELECT 'repeated_id', s1_id, id FROM each GROUP BY s1_id, id HAVING count(*) > 1
UNION ALL SELECT 'self_source_id', s1_id, id FROM each WHERE starts_with(id, 'S1-')
UNION ALL SELECT 'bad_prefix', s1_id, id FROM each WHERE NOT regexp_matches(id, '^S[123]-')
UNION ALL SELECT 'missing_s1', s1_id, NULL FROM ids WHERE s1_id NOT IN (SELECT s1_id FROM good)
UNION ALL SELECT DISTINCT 'foreign_s1', s1_id, NULL FROM good WHERE s1_id NOT IN (SELECT s1_id FROM ids)
UNION ALL SELECT 'unknown_id', s1_id, id FROM each WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records)"""


def _sql(ctes: str, select: str) -> str:
    return f"WITH {synthetic.RECORDS_ORACLE}{', ' + ctes if ctes else ''} {select}"


def oracle_sql() -> dict[str, str]:
    cand = "SELECT ids.s1_id, cand_id, round(score, 6) AS blocking_score, rank FROM ids LEFT JOIN top ON top.s1_id = ids.s1_id"
    lists = "SELECT ids.s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS {} FROM ids LEFT JOIN {} m ON m.s1_id = ids.s1_id GROUP BY ids.s1_id"
    prefix = _KEYS.replace("), keys AS", "  UNION ALL SELECT country_raw, entity_id, 'n3p:' || substr(w, 1, 3) FROM (SELECT country_raw, entity_id, unnest(string_split(business_name_normalized, ' ')) AS w FROM prep) WHERE length(w) >= 3\n), keys AS")
    return {
        "scan_er_records": _sql("", "SELECT * FROM records"),
        "normalize_frame": _sql(_KEYS, "SELECT * FROM prep"),
        "blocking_keys": _sql(_KEYS, "SELECT * FROM keys"),
        "blocking_keys_prefix": _sql(prefix, "SELECT country, entity_id, key, 1::BIGINT AS times FROM keys"),
        "key_idf_weights": _sql(_SCORES, "SELECT country, key, df, round(weight, 6) AS weight FROM weights"),
        "blocking_scores": _sql(_SCORES, "SELECT s1_id, cand_id, round(score, 6) AS blocking_score FROM scored"),
        "candidates_topk": _sql(_SCORES, cand),
        "candidate_lists": _sql(_SCORES, lists.format("candidate_entity_ids", "top")),
        "fast_candidates": _sql(_SCORES, "SELECT s1_id, cand_id, position, round(5.0::DOUBLE / (1 + position), 6) AS blocking_score FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY cand_id) - 1 AS position FROM top) WHERE position < 5"),
        "exact_name_baseline": _sql(f"{_SCORES}, {_BASELINE}", "SELECT * FROM named"),
        "truth_pairs": _sql(_SCORES, "SELECT * FROM pairs"),
        "cross_country_check": _sql(_SCORES, "SELECT s1_id, cand_id, x.country AS s1_country, CASE WHEN cand_id LIKE 'S3-%' THEN lower(y.country) ELSE y.country END AS matched_country FROM pairs JOIN records x ON x.entity_id = s1_id JOIN records y ON y.entity_id = cand_id WHERE x.country <> CASE WHEN cand_id LIKE 'S3-%' THEN lower(y.country) ELSE y.country END"),
        "country_counts": _sql("", "SELECT substr(entity_id, 1, 2) AS source, country, count(*) AS n FROM records GROUP BY ALL"),
        "match_histogram": _sql("", "SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: trim(x) <> ''))::BIGINT AS matches, count(*) AS entities FROM truth GROUP BY 1"),
        "truth_summary": _sql("", "SELECT count(*) AS entities, count(*) FILTER (n = 0) AS singletons, sum(n)::BIGINT AS pairs, round(100.0::DOUBLE * count(*) FILTER (n = 0) / count(*), 4) AS singleton_pct FROM (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: trim(x) <> '')) AS n FROM truth)"),
        "blocking_recall": _sql(_SCORES, "SELECT count(*) AS true_pairs, count(top.cand_id) AS found_pairs, round(count(top.cand_id)::DOUBLE / count(*), 6) AS blocking_recall FROM pairs LEFT JOIN top ON top.s1_id = pairs.s1_id AND top.cand_id = pairs.cand_id"),
        "blocking_diagnostics": _sql(_SCORES, "SELECT *, total_s1_entities * (total_s2_records + total_s3_records) AS total_possible_pairs, round(1 - total_candidate_pairs::DOUBLE / (total_s1_entities * (total_s2_records + total_s3_records)), 6) AS candidate_reduction_ratio, round(total_candidate_pairs::DOUBLE / total_s1_entities, 6) AS avg_candidates_per_s1 FROM (SELECT count(*) FILTER (entity_id LIKE 'S1-%') AS total_s1_entities, count(*) FILTER (entity_id LIKE 'S2-%') AS total_s2_records, count(*) FILTER (entity_id LIKE 'S3-%') AS total_s3_records, (SELECT count(*) FROM top) AS total_candidate_pairs FROM records)"),
        "pair_metrics": _sql(f"{_SCORES}, {_BASELINE}, {_metrics_sql('named')}", _SUMMARY),
        "macro_f05": _sql(f"{_JACCARD}, decided AS (SELECT * FROM jac WHERE prob >= 0.5), {_metrics_sql('decided')}", "SELECT s1_id, n_true, n_pred, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05 FROM ent"),
        "threshold_grid": _sql(f"{_JACCARD}, {_GRID_SQL.split(')\nSELECT threshold, round', 1)[0]})", "SELECT threshold, round" + _GRID_SQL.split(")\nSELECT threshold, round", 1)[1]),
        "matches_decided": _sql(_JACCARD, "SELECT s1_id, cand_id, prob FROM jac WHERE prob >= 0.55"),
        "matching_lists": _sql(f"{_JACCARD}, decided AS (SELECT * FROM jac WHERE prob >= 0.55)", lists.format("matched_entity_ids", "decided")),
        "error_samples": _sql(f"{_JACCARD}, decided AS (SELECT * FROM jac WHERE prob >= 0.5), kinds AS (SELECT coalesce(p.s1_id, d.s1_id) AS s1_id, coalesce(p.cand_id, d.cand_id) AS cand_id, CASE WHEN p.s1_id IS NOT NULL AND d.s1_id IS NOT NULL THEN 'TRUE_POSITIVE' WHEN d.s1_id IS NOT NULL THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS type FROM pairs p FULL JOIN decided d ON p.s1_id = d.s1_id AND p.cand_id = d.cand_id)",
            "SELECT type, s1_id, cand_id, x.business_name AS s1_name, y.business_name AS cand_name, x.business_address AS s1_addr, y.business_address AS cand_addr FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY s1_id, cand_id) AS n FROM kinds) LEFT JOIN records x ON x.entity_id = s1_id LEFT JOIN records y ON y.entity_id = cand_id WHERE n <= 5"),
        "native_features": _sql(_VIEW, _NATIVE_SQL),
        "token_jaccard": _sql(_JACCARD, "SELECT * FROM jac"),
        "digit_overlap": _sql(_VIEW, f"SELECT s1_id, cand_id, {_DIGITS} FROM h"),
        "validator_violations": _sql(_SCORES + _LINES.split("\nSELECT 'no_tab'", 1)[0], "SELECT 'no_tab'" + _LINES.split("\nSELECT 'no_tab'", 1)[1]),
        "pattern_blocking_keys": _sql(_PATTERN_KEYS, "SELECT DISTINCT country, entity_id, key FROM found"),
        "features_with_unknown_ids": _sql(_VIEW, _UNKNOWN_SQL),
        "fast_mode_features": _sql(_FAST_H, _NATIVE_SQL),
        "overlap_scores": _sql(_VIEW, _OVERLAP_SQL),
        "fuzzy_features": "WITH " + synthetic.RECORDS_ORACLE + ", " + fuzzy_sql(_VIEW, _NATIVE_SQL, features.FEATURE_NAMES),
        "heuristic_score": "WITH " + synthetic.RECORDS_ORACLE + ", " + heuristic_sql(_VIEW),
        "id_anti_join": _sql(_SCORES, "SELECT DISTINCT pairs.s1_id FROM pairs WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.s1_id = pairs.s1_id AND top.cand_id = pairs.cand_id)"),
    }


def queries() -> dict:
    made = (
        scan_er_records, normalize_frame, blocking_keys, blocking_keys_prefix, key_idf_weights, blocking_scores, candidates_topk, candidate_lists, fast_candidates, exact_name_baseline, truth_pairs, cross_country_check,
        country_counts, match_histogram, truth_summary, blocking_recall, blocking_diagnostics, pair_metrics, macro_f05, threshold_grid, matches_decided, matching_lists, error_samples, native_features, token_jaccard, digit_overlap,
        validator_violations, id_anti_join, pattern_blocking_keys, features_with_unknown_ids, fast_mode_features, overlap_scores, fuzzy_features, heuristic_score, gbt_match,
    )
    return {f.__name__: f for f in made}
