"""Tab-separated sources and sinks with an explicit schema and no quoting."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "candidate_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SOURCE) -> DataFrame:
    """A header TSV; quotes are ordinary characters.  A missing path raises when Spark resolves it."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", emptyValue="", mode="PERMISSIVE").csv(path)


def load_dataset(spark: SparkSession, folder: str, train: bool) -> dict[str, DataFrame]:
    """``s1``, ``s2``, ``s3`` and, for training, ``truth`` below ``folder``/{train,test}."""
    kind = "train" if train else "test"
    found = {f"s{i}": read_tsv(spark, f"{folder}/{kind}/{kind}_source{i}.tsv") for i in (1, 2, 3)}
    if train:
        found["truth"] = read_tsv(spark, f"{folder}/train/train_ground_truth.tsv", TRUTH)
    return found


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of part files with header; empty strings are written as nothing at all."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a source file."""
    lines = spark.read.text(path)
    first = F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))
    return lines.select(first.alias("id")).where((F.col("id") != "") & (F.col("id") != "entity_id")).distinct()


def read_candidate_lists(spark: SparkSession, path: str, first: int = 5) -> DataFrame:
    """(s1_id, cand_id, position): the first ids of every list, positions from 0."""
    rows = read_tsv(spark, path, CANDIDATES)
    return first_candidates(rows, first)


def first_candidates(lists: DataFrame, first: int) -> DataFrame:
    ids = F.filter(F.transform(F.split("candidate_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.posexplode(F.slice(ids, 1, first)).alias("position", "cand_id"))


def id_lists(all_ids: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """One row for every id of ``all_ids`` (s1_id) with the sorted comma list of its pairs (s1_id, cand_id); empty without any."""
    lists = pairs.where(F.col("cand_id").isNotNull()).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    return all_ids.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def save_json(data, path: str) -> None:
    """A small report, written by the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2)


def cached_parquet(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first if it is not there; name the path after the settings that shape it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(conf).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
