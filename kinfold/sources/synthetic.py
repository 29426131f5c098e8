"""Entity-resolution records with known truth, derived from the customer and nation tables.

Every customer gives one clean S1 record and one S2 and one S3 record, which
are either noisy copies (suffix dropped, upper case, typo, words reordered,
street abbreviated, field missing) or look-alikes at another unit that are not
matches.  The rules are integer arithmetic on the key in SQL that Spark and
other engines read alike, so the records are the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.session import table

#: Fixed word lists of the generator.
FIRST = "Alpha,Blue Ridge,Café,Delta,Evergreen,First,Golden,Harbor,Imperial,Jade,Kestrel,Lotus,Metro,Nova,Orion,Pioneer,Quartz,Royal,Silver,Titan"
SECOND = "Foods,Textiles,Motors,Pharma,Books,Bakery,Steel,Paper,Optics,Travel,Garden,Music,Dental,Marine,Timber,Coffee,Sports,Jewels,Plastics,Ceramics,Farms,Tools,Labs"
SUFFIX = "Pvt Ltd,LLC,Inc,GmbH,Services,Traders,Group,Co"
STREET = "Oak Street,Hill Road,Lake Avenue,Mill Lane,Park Boulevard,King Street,Queen Road,North Avenue,South Lane,Church Street,Market Road,Temple Road,River Avenue,Station Road,Garden Lane,School Street,Forest Road"
CITY = "Springfield,Riverton,Lakeview,Hillcrest,Fairmont,Georgetown,Ashland,Milton,Clayton,Dayton,Kingston,Oxford,Bristol,Newport,Salem,Franklin,Clinton,Auburn,Burlington"


def _pick(words: str, n: str) -> str:
    return f"split_part('{words}', ',', CAST(1 + ({n}) % {words.count(',') + 1} AS INT))"


RECORDS_SQL = f"""
clean AS (
  SELECT c_custkey AS k, n_name AS country, {_pick(FIRST, 'c_custkey * 7 + c_custkey / 20')} AS w1, {_pick(SECOND, 'c_custkey * 13 + 5')} AS w2, {_pick(SUFFIX, 'c_custkey * 3')} AS w3,
    CAST(100 + (c_custkey * 37) % 900 AS STRING) AS num, {_pick(STREET, 'c_custkey * 11 + 3')} AS street, {_pick(CITY, 'c_custkey * 5 + 1')} AS city, CAST(100000 + (c_custkey * 7919) % 900000 AS STRING) AS pin
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), records AS (
  SELECT concat('S1-', CAST(k AS STRING)) AS entity_id, concat(w1, ' ', w2, ' ', w3) AS business_name, concat(num, ' ', street, ', ', city, ' ', pin) AS business_address, country FROM clean
  UNION ALL
  SELECT concat('S2-', CAST(k AS STRING)), CASE k % 6 WHEN 0 THEN concat(w1, ' ', w2, ' ', w3) WHEN 1 THEN concat(w1, ' ', w2) WHEN 2 THEN upper(concat(w1, ' ', w2, ' ', w3))
      WHEN 3 THEN concat(w1, ' ', substr(w2, 1, length(w2) - 1), ' ', w3) WHEN 4 THEN concat(w2, ' ', w1, ' ', w3) ELSE concat(w1, ' & ', w2, ', ', w3, '.') END,
    CASE WHEN k % 10 = 0 THEN concat(CAST(100 + (k * 53 + 7) % 900 AS STRING), ' ', street, ', ', city) WHEN k % 17 = 0 THEN NULL ELSE concat(num, ' ', street, ', ', city, ' ', pin) END, CASE WHEN k % 97 = 0 THEN NULL ELSE country END FROM clean
  UNION ALL
  SELECT concat('S3-', CAST(k AS STRING)), CASE k % 4 WHEN 0 THEN concat(w1, ' ', w2) WHEN 1 THEN lower(concat(w1, ' ', w2, ' ', w3)) WHEN 2 THEN concat(w1, '  ', w2, ' @ ', city) ELSE concat(w1, ' ', w2, ' ', w3) END,
    CASE WHEN k % 7 = 0 THEN concat(CAST(100 + (k * 71 + 11) % 900 AS STRING), ' ', street, ', ', city) ELSE replace(replace(concat(num, ' ', street, ' ', city, ', ', pin), 'Street', 'St.'), 'Road', 'Rd') END, country FROM clean
), truth AS (
  SELECT concat('S1-', CAST(k AS STRING)) AS source1_entity_id,
    concat(CASE WHEN k % 10 = 0 THEN '' ELSE concat('S2-', CAST(k AS STRING)) END, CASE WHEN k % 10 = 0 OR k % 7 = 0 THEN '' ELSE ', ' END, CASE WHEN k % 7 = 0 THEN '' ELSE concat('S3-', CAST(k AS STRING)) END) AS matched_entity_ids FROM clean
)"""
#: The same text for an engine whose division of integers is not integral and whose string type is called VARCHAR.
RECORDS_ORACLE = RECORDS_SQL.replace("c_custkey / 20", "c_custkey // 20").replace("AS STRING)", "AS VARCHAR)")
RECORDS_SPARK = RECORDS_SQL.replace("c_custkey / 20", "c_custkey DIV 20")


def _run(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return spark.sql(f"WITH customer AS (SELECT * FROM {{customer}}), nation AS (SELECT * FROM {{nation}}), {RECORDS_SPARK} SELECT * FROM {what}", customer=customer, nation=nation)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country) of all three sources."""
    return _run(spark, sf_dir, "records")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): a comma list, empty for singletons."""
    return _run(spark, sf_dir, "truth")
