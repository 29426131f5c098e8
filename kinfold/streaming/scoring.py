"""Scoring of candidate pairs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.matching import score_pairs

PAIR_SCHEMA = "request_id string, position int, s1_name string, s1_address string, s1_country string, candidate_id string, cand_name string, cand_address string, cand_country string"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON requests, one pair a line."""
    return spark.readStream.schema(PAIR_SCHEMA).json(folder)


def score_stream(requests: DataFrame, output: str, checkpoint: str, threshold: float = 0.60):
    """Append scored pairs to Parquet; scoring keeps no state, so replays after a failure give the same rows."""
    return score_pairs(requests, threshold).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").start()
