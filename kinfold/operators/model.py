"""The pair classifier: gradient-boosted trees of MLlib over the named features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators.features import FEATURE_NAMES

#: Feature groups of the ablation study, by name.
GROUPS = {
    "name": tuple(n for n in FEATURE_NAMES if n.startswith("name_")),
    "address": tuple(n for n in FEATURE_NAMES if n.startswith(("addr_", "dig_"))),
    "joint": ("comb_token_set", "country_exact_match", "is_s2"),
    "blocking": ("blocking_score",),
}
EXPERIMENTS = {
    "A_name": ("name",), "B_address": ("address",), "C_name_address": ("name", "address"), "D_with_joint": ("name", "address", "joint"), "E_full": ("name", "address", "joint", "blocking"),
}


def train(rows: DataFrame, config: Config = Config(), features: Sequence[str] = FEATURE_NAMES) -> PipelineModel:
    """Fit on labelled features; the model can be saved with ``model.write()``."""
    trees = GBTClassifier(labelCol="__label", featuresCol="__features", maxIter=config.model_rounds, maxDepth=config.model_depth, stepSize=config.step_size, subsamplingRate=config.subsample, featureSubsetStrategy=config.feature_share, seed=config.seed)
    stages = [VectorAssembler(inputCols=list(features), outputCol="__features"), trees]
    return Pipeline(stages=stages).fit(rows.withColumn("__label", F.col("label").cast("double")))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(s1_id, cand_id, prob)."""
    return model.transform(rows).select("s1_id", "cand_id", vector_to_array("probability")[1].alias("prob"))


def importances(model: PipelineModel, features: Sequence[str] = FEATURE_NAMES) -> list[tuple[str, float]]:
    """Features by falling normalised importance."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))


def split_ids(ids: DataFrame, config: Config = Config()) -> DataFrame:
    """(s1_id, part): a hash sample of about ``train_sample_size`` reference ids, cut into train, tune and test."""
    picked = ids.select("s1_id").distinct().orderBy(F.xxhash64("s1_id", F.lit(config.seed)), "s1_id").limit(config.train_sample_size)
    u = F.pmod(F.xxhash64("s1_id", F.lit(config.seed + 1)), F.lit(10_000)) / 10_000
    return picked.select("s1_id", F.when(u < config.test_ratio, "test").when(u < config.test_ratio + config.tune_ratio, "tune").otherwise("train").alias("part"))
