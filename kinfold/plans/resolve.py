"""Training and inference runs, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.durable import durable
from kinfold.operators import blocking, features, matching, metrics, model
from kinfold.sources import tsv


@dataclass
class Trained:
    model: PipelineModel
    threshold: float
    thresholds: DataFrame
    test_metrics: DataFrame
    baseline_metrics: DataFrame
    recall: DataFrame
    rows: DataFrame
    tune_ids: DataFrame
    tune_truth: DataFrame


def _candidates(s1: DataFrame, others: DataFrame, config: Config) -> DataFrame:
    return blocking.candidates(s1, others, config.blocking_top_k, config.max_key_freq, config.prefix_keys, config.dedupe_keys)


def _stored(make: Callable[[], DataFrame], label: str, config: Config, cache: str | None, spark: SparkSession) -> DataFrame:
    """A table for this run or, below ``cache``, for every run with the same settings."""
    return tsv.cached_parquet(spark, f"{cache}/{label}-{config.digest()}", make) if cache else durable(make(), label)


def train(records: DataFrame, truth: DataFrame, config: Config = Config(), cache: str | None = None) -> Trained:
    """Fit on one part of the reference records, choose the threshold on a second, report on a third.

    ``cache`` names a folder in which candidates and features are found again by later runs over the same data.
    """
    spark = records.sparkSession
    s1, others = blocking.split_sources(records)
    parts = durable(model.split_ids(s1.select(F.col("entity_id").alias("s1_id")), config), "er-parts")
    sampled = s1.join(parts.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    pairs = _stored(lambda: _candidates(sampled, others, config), "er-candidates", config, cache, spark)
    rows = _stored(lambda: features.labelled_features(pairs, records, truth).join(parts, "s1_id"), "er-features", config, cache, spark)
    fitted = model.train(rows.where("part = 'train'"), config)
    scored = durable(model.score(fitted, rows.where("part <> 'train'")).join(parts, "s1_id"), "er-scored")

    def of(part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        ids = parts.where(F.col("part") == part).select("s1_id")
        return ids, truth.join(ids, "s1_id", "left_semi"), scored.where(F.col("part") == part)

    table = durable(metrics.threshold_table(*of("tune"), config.threshold_grid), "er-thresholds")
    threshold = metrics.best_threshold(table)
    ids, true, tested = of("test")
    report = metrics.evaluate(ids, true, matching.decide(tested, threshold))
    named = matching.exact_name_baseline(pairs.join(ids, "s1_id", "left_semi"), records)
    return Trained(fitted, threshold, table, report, metrics.evaluate(ids, true, named), metrics.blocking_recall(truth.join(parts, "s1_id", "left_semi"), pairs), rows, *of("tune")[:2])


def refit(records: DataFrame, truth: DataFrame, config: Config = Config()) -> PipelineModel:
    """The classifier fitted on all sampled pairs, for use after the threshold is chosen."""
    s1, others = blocking.split_sources(records)
    ids = model.split_ids(s1.select(F.col("entity_id").alias("s1_id")), config)
    sampled = s1.join(ids.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    return model.train(durable(features.labelled_features(_candidates(sampled, others, config), records, truth), "er-features"), config)


def infer(records: DataFrame, fitted: PipelineModel, threshold: float, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(matching lists, candidate lists) of all reference records, ready for :func:`kinfold.sources.tsv.write_tsv`."""
    s1, others = blocking.split_sources(records)
    pairs = durable(_candidates(s1, others, config), "er-candidates")
    scored = model.score(fitted, features.pair_features(pairs, records, keep_unknown=True))
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    matched = tsv.id_lists(ids, matching.decide(scored, threshold, pairs), "matched_entity_ids")
    return matched.orderBy("source1_entity_id"), tsv.id_lists(ids, pairs, "candidate_entity_ids").orderBy("source1_entity_id")


def ablation(rows: DataFrame, ids: DataFrame, truth: DataFrame, config: Config = Config()) -> list[dict]:
    """One fit for each feature group on ``part = 'train'`` rows, thresholds chosen on 'tune'."""
    out = []
    tune = rows.where("part = 'tune'")
    for name, groups in model.EXPERIMENTS.items():
        used = [f for g in groups for f in model.GROUPS[g]]
        fitted = model.train(rows.where("part = 'train'"), config, used)
        scored = durable(model.score(fitted, tune), "er-ablation")
        threshold = metrics.best_threshold(metrics.threshold_table(ids, truth, scored, config.ablation_grid))
        found = metrics.evaluate(ids, truth, matching.decide(scored, threshold)).first().asDict()
        out.append({"experiment": name, "features": len(used), "threshold": threshold, **found})
    return out


def fast_mode(candidate_lists: DataFrame, first: int = 5) -> DataFrame:
    """The first candidates of every list with a score that falls with the place, 5 / (1 + place)."""
    rows = tsv.first_candidates(candidate_lists, first)
    return rows.select("s1_id", "cand_id", "position", (5.0 / (1.0 + F.col("position"))).alias("blocking_score"))


def fast_match(lists: DataFrame, records: DataFrame, fitted: PipelineModel, threshold: float = 0.60, first: int = 5) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): the first candidates of every list scored with the features of the fast mode, in the list's order."""
    pairs = durable(fast_mode(lists, first), "er-fast")
    scored = model.score(fitted, features.pair_features(pairs, records, view=features.fast_view(records)))
    hits = matching.decide(scored, threshold).join(pairs.select("s1_id", "cand_id", "position"), ["s1_id", "cand_id"])
    joined = hits.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "cand_id"))), lambda x: x["cand_id"]), ",").alias("ids"))  # at most ``first`` a record
    all_ids = lists.select(F.col("source1_entity_id").alias("s1_id")).distinct()
    return all_ids.join(joined, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
