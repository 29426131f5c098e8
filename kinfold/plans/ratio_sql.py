"""SQL for the fuzzy ratios of :mod:`kinfold.functions.fuzzy`, as common table expressions over distinct pairs of strings.

The longest common subsequence is bit-parallel on 128-bit integers, so strings
on the shorter side may have up to 126 characters.
"""

from __future__ import annotations


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def _joined(words: str) -> str:
    return f"coalesce(array_to_string(list_sort({words}), ' '), '')"


def _masks(short: str, long: str) -> str:
    """For every character of ``long`` a number whose bits are its places in ``short``."""
    return f"list_transform(string_split({long}, ''), lambda c: list_sum(list_transform(range(length({short})), lambda i: CASE WHEN {short}[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)"


def _common(masks: str, full: str, n: str) -> str:
    """Length of the longest common subsequence, given the masks of one side's characters."""
    return f"{n} - bit_count(list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}))"


def _best_window(short: str, long: str) -> str:
    n, size = f"length({short})", f"length({long})"
    spans = (
        f"list_concat(list_concat(list_transform(list_filter(range(1, {n}), lambda i: contains({short}, {long}[i])), lambda i: {{'s': 1, 'l': i}}), "
        f"list_transform(list_filter(range(0, {size} - {n} + 1), lambda i: contains({short}, {long}[i + {n}])), lambda i: {{'s': i + 1, 'l': {n}}})), "
        f"list_transform(list_filter(range({size} - {n} + 1, {size}), lambda i: contains({short}, {long}[i + 1])), lambda i: {{'s': i + 1, 'l': {size} - i}}))"
    )
    return f"SELECT p, q, short, long, spans, masks, (1::HUGEINT << {n}::INT) - 1 AS bits FROM (SELECT *, {spans} AS spans, {_masks(short, long)} AS masks FROM sided)"


def four_places(c: str) -> str:
    """Half up by the shortest decimal form of a double, as Spark rounds."""
    return f"round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE"


def ratio_ctes(source: str, texts: str, partials: str) -> str:
    """CTEs from ``source`` (with): ``texts`` selects pairs (a, b), ``partials`` those of them that need windows.

    They end in ``r`` (a, b, ratio, token_sort, token_set) and ``w`` (p, q, partial), ``parts`` holds what ``w`` may be asked for.
    """
    window = f"coalesce(list_max(list_transform(spans, lambda x: 200.0::DOUBLE * ({_common('masks[x.s : x.s + x.l - 1]', 'bits', 'length(short)')}) / (length(short) + x.l))), 0)"
    return f"""{source}, texts AS (SELECT DISTINCT a, b FROM ({texts})
), parts AS (
  SELECT a, b, {_joined(_words('a'))} AS sa, {_joined(_words('b'))} AS sb, coalesce(array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' '), '') AS sh, {_joined('list_filter(x, lambda w: NOT list_contains(y, w))')} AS ox,
    {_joined('list_filter(y, lambda w: NOT list_contains(x, w))')} AS oy, len(x) = 0 OR len(y) = 0 AS wordless
  FROM (SELECT a, b, list_sort(list_distinct({_words('a')})) AS x, list_sort(list_distinct({_words('b')})) AS y FROM texts)
), lcs AS MATERIALIZED (
  SELECT p, q, CASE WHEN p = '' OR q = '' THEN 0 ELSE {_common('masks', 'bits', 'length(p)')} END AS c FROM (
    SELECT p, q, {_masks('p', 'q')} AS masks, (1::HUGEINT << length(p)::INT) - 1 AS bits FROM (SELECT a AS p, b AS q FROM parts UNION SELECT sa, sb FROM parts UNION SELECT ox, oy FROM parts))
), sides AS (SELECT DISTINCT p, q FROM ({partials})
), sided AS (
  SELECT p, q, CASE WHEN length(p) <= length(q) THEN p ELSE q END AS short, CASE WHEN length(p) <= length(q) THEN q ELSE p END AS long FROM sides WHERE p <> '' AND q <> ''
  UNION ALL SELECT p, q, q, p FROM sides WHERE length(p) = length(q) AND p <> ''
), w AS MATERIALIZED (
  SELECT p, q, max(CASE WHEN contains(long, short) THEN 100.0::DOUBLE ELSE {window} END) AS partial FROM ({_best_window('short', 'long')}) GROUP BY p, q
  UNION ALL SELECT p, q, CASE WHEN p = q THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END FROM sides WHERE p = '' OR q = ''
), r AS MATERIALIZED (
  SELECT a, b, CASE WHEN a = b THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * l1.c / (length(a) + length(b)) END AS ratio, CASE WHEN sa = sb THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * l2.c / (length(sa) + length(sb)) END AS token_sort,
    CASE WHEN wordless THEN 0.0::DOUBLE WHEN sh <> '' AND (ox = '' OR oy = '') THEN 100.0::DOUBLE
      WHEN sh = '' THEN 100.0::DOUBLE - 100.0::DOUBLE * (length(ox) + length(oy) - 2 * l3.c) / (length(ox) + length(oy))
      ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (length(ox) + length(oy) - 2 * l3.c) / (2 * length(sh) + 2 + length(ox) + length(oy)), 100.0::DOUBLE - 100.0::DOUBLE * (1 + length(ox)) / (2 * length(sh) + 1 + length(ox)), 100.0::DOUBLE - 100.0::DOUBLE * (1 + length(oy)) / (2 * length(sh) + 1 + length(oy))) END AS token_set
  FROM parts JOIN lcs l1 ON l1.p = a AND l1.q = b JOIN lcs l2 ON l2.p = sa AND l2.q = sb JOIN lcs l3 ON l3.p = ox AND l3.q = oy
)"""


def fuzzy_sql(view: str, native: str, names: tuple[str, ...]) -> str:
    """All 27 features: the ``native`` select over ``h`` of ``view`` and the ten fuzzy ones, in the order of ``names``."""
    raw = "(SELECT DISTINCT xname, yname FROM h)"
    ctes = ratio_ctes(
        view,
        "SELECT xn AS a, yn AS b FROM h UNION SELECT xa, ya FROM h UNION SELECT xname, yname FROM h UNION SELECT xn || ' ' || xa, yn || ' ' || ya FROM h",
        f"SELECT xn AS p, yn AS q FROM h UNION SELECT xa, ya FROM h UNION SELECT xname, yname FROM h UNION SELECT sa, sb FROM parts JOIN {raw} ON a = xname AND b = yname UNION SELECT ox, oy FROM parts JOIN {raw} ON a = xname AND b = yname",
    )
    longer = "greatest(length(xname), length(yname))::DOUBLE / least(length(xname), length(yname))"
    weighted = f"""CASE WHEN xname = '' OR yname = '' THEN 0.0::DOUBLE WHEN {longer} < 1.5 THEN greatest(m.ratio, 0.95::DOUBLE * greatest(m.token_sort, m.token_set))
      ELSE greatest(m.ratio, (CASE WHEN {longer} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) * w1.partial, 0.95::DOUBLE * (CASE WHEN {longer} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) * CASE WHEN p.wordless THEN 0.0::DOUBLE WHEN p.sh <> '' THEN 100.0::DOUBLE ELSE greatest(w2.partial, w3.partial) END) END"""
    fuzzy = {
        "name_fuzz_ratio": "n.ratio", "name_partial_ratio": "wn.partial", "name_token_sort": "n.token_sort", "name_token_set": "n.token_set", "name_wratio": weighted, "addr_fuzz_ratio": "ad.ratio", "addr_partial_ratio": "wa.partial",
        "addr_token_sort": "ad.token_sort", "addr_token_set": "ad.token_set", "comb_token_set": "co.token_set",
    }
    made = ", ".join(f"round({f'CASE WHEN gone THEN 0.0::DOUBLE ELSE {c} END' if k.startswith('addr_') else c}, 6) AS {k}" for k, c in fuzzy.items())
    joins = """FROM h JOIN r n ON n.a = xn AND n.b = yn JOIN r ad ON ad.a = xa AND ad.b = ya JOIN r m ON m.a = xname AND m.b = yname JOIN r co ON co.a = xn || ' ' || xa AND co.b = yn || ' ' || ya
  JOIN parts p ON p.a = xname AND p.b = yname JOIN w wn ON wn.p = xn AND wn.q = yn JOIN w wa ON wa.p = xa AND wa.q = ya JOIN w w1 ON w1.p = xname AND w1.q = yname JOIN w w2 ON w2.p = p.sa AND w2.q = p.sb JOIN w w3 ON w3.p = p.ox AND w3.q = p.oy"""
    return f"{ctes}, fz AS (SELECT s1_id, cand_id, {made} {joins}), nat AS ({native}) SELECT s1_id, cand_id, {', '.join(names)} FROM nat JOIN fz USING (s1_id, cand_id)"


def heuristic_sql(view: str) -> str:
    """The hand-weighted scorer and its ranks, over ``h`` and ``top`` of ``view``."""
    ctes = ratio_ctes(view, "SELECT xn AS a, yn AS b FROM h UNION SELECT xa, ya FROM h", "SELECT '' AS p, '' AS q")
    return f"""{ctes}, judged AS (
  SELECT s1_id, cand_id, rank AS place, CASE WHEN trim(coalesce(xc, '')) <> '' AND trim(coalesce(yc, '')) <> '' AND lower(trim(xc)) <> lower(trim(yc)) THEN 0.0::DOUBLE ELSE {four_places('CASE WHEN list_has_any(xdg, ydg) THEN least(1.0::DOUBLE, raw + 0.05::DOUBLE) ELSE raw END')} END AS confidence_score FROM (
    SELECT h.*, top.rank, CASE WHEN xa <> '' AND ya <> '' THEN 0.5::DOUBLE * (n.token_set / 100) + 0.2::DOUBLE * (n.token_sort / 100) + 0.3::DOUBLE * (ad.token_set / 100) ELSE 0.7::DOUBLE * (n.token_set / 100) + 0.3::DOUBLE * (n.token_sort / 100) END AS raw
    FROM h JOIN top USING (s1_id, cand_id) JOIN r n ON n.a = xn AND n.b = yn JOIN r ad ON ad.a = xa AND ad.b = ya)
) SELECT s1_id, cand_id, confidence_score, confidence_score >= 0.6 AS is_match, CASE WHEN confidence_score >= 0.6 THEN 'MATCH' ELSE 'NO_MATCH' END AS decision, row_number() OVER (PARTITION BY s1_id ORDER BY confidence_score DESC, place)::INT AS rank,
  count(*) OVER (PARTITION BY s1_id) AS total_candidates, count(*) FILTER (confidence_score >= 0.6) OVER (PARTITION BY s1_id) AS match_count FROM judged"""
