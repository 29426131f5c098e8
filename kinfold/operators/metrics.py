"""Truth tables, pair and entity metrics, threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import f_half, id_list


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id): the exploded comma lists."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.array_distinct(id_list(F.col("matched_entity_ids")))).alias("cand_id"))


def entity_scores(ids: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp, precision, recall, f05) over ``ids`` (s1_id) and all ids of both pair tables."""
    marked = truth.select("s1_id", "cand_id", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predicted.select("s1_id", "cand_id", F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = marked.groupBy("s1_id", "cand_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    padded = pairs.unionByName(ids.select("s1_id", F.lit(None).cast("string").alias("cand_id"), F.lit(0).alias("t"), F.lit(0).alias("p")))
    counts = padded.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    empty = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    p = F.when(empty, 1.0).when((F.col("n_true") == 0) | (F.col("n_pred") == 0), 0.0).otherwise(F.try_divide(F.col("tp"), F.col("n_pred")))
    r = F.when(empty, 1.0).when((F.col("n_true") == 0) | (F.col("n_pred") == 0), 0.0).otherwise(F.try_divide(F.col("tp"), F.col("n_true")))
    rated = counts.select("s1_id", "n_true", "n_pred", "tp", p.alias("precision"), r.alias("recall"))
    return rated.withColumn("f05", f_half(F.col("precision"), F.col("recall")))


def _summary() -> list:
    single = F.col("n_true") == 0
    return [
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg(F.when(single, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0))), F.lit(1.0)).alias("singleton_accuracy"),
        F.count(F.when(single, 1)).alias("singleton_count"), F.count(F.when(single & (F.col("n_pred") == 0), 1)).alias("singleton_correct"),
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("total_true_pairs"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("total_predicted_pairs"), F.coalesce(F.sum("tp"), F.lit(0)).alias("true_positives"),
    ]


def evaluate(ids: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row with the 14 metrics of a prediction."""
    row = entity_scores(ids, truth, predicted).agg(*_summary())
    tp, pred, true = F.col("true_positives"), F.col("total_predicted_pairs"), F.col("total_true_pairs")
    row = row.withColumns({"pair_precision": F.coalesce(F.try_divide(tp, pred), F.lit(0.0)), "pair_recall": F.coalesce(F.try_divide(tp, true), F.lit(0.0))})
    return row.withColumns({"pair_f05": f_half(F.col("pair_precision"), F.col("pair_recall")), "false_merges": pred - tp, "false_negatives": true - tp})


def threshold_table(ids: DataFrame, truth: DataFrame, scored: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(threshold, macro_f05, macro_precision, macro_recall, singleton_accuracy) for every threshold, in one job.

    ``scored`` is (s1_id, cand_id, prob).  Counts per entity are made for all
    thresholds at once, as arrays of conditional sums, so that pairs are
    neither copied nor joined once a threshold.
    """
    grid = list(grid)
    pairs = truth.select("s1_id", "cand_id", F.lit(1).alias("t"), F.lit(None).cast("double").alias("prob")).unionByName(scored.select("s1_id", "cand_id", F.lit(0).alias("t"), F.col("prob").cast("double")))
    pairs = pairs.groupBy("s1_id", "cand_id").agg(F.max("t").alias("t"), F.max("prob").alias("prob"))
    pairs = pairs.unionByName(ids.select("s1_id", F.lit(None).cast("string").alias("cand_id"), F.lit(0).alias("t"), F.lit(None).cast("double").alias("prob")))
    taken = lambda g: F.col("prob") >= F.lit(g)
    counts = pairs.groupBy("s1_id").agg(
        F.sum("t").alias("n_true"), F.array(*[F.count(F.when(taken(g), 1)) for g in grid]).alias("pred"), F.array(*[F.count(F.when(taken(g) & (F.col("t") == 1), 1)) for g in grid]).alias("hit"),
    )
    rows = counts.select("s1_id", "n_true", F.posexplode(F.arrays_zip("pred", "hit")).alias("i", "c")).select("s1_id", "n_true", F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("i") + 1).alias("threshold"), F.col("c.pred").alias("n_pred"), F.col("c.hit").alias("tp"))
    empty, none = (F.col("n_true") == 0) & (F.col("n_pred") == 0), (F.col("n_true") == 0) | (F.col("n_pred") == 0)
    rated = rows.withColumns({"precision": F.when(empty, 1.0).when(none, 0.0).otherwise(F.try_divide(F.col("tp"), F.col("n_pred"))), "recall": F.when(empty, 1.0).when(none, 0.0).otherwise(F.try_divide(F.col("tp"), F.col("n_true")))})
    rated = rated.withColumn("f05", f_half(F.col("precision"), F.col("recall")))
    return rated.groupBy("threshold").agg(*_summary()[:4])


def best_threshold(table: DataFrame) -> float:
    """The threshold with the highest macro F0.5, the lowest of equals."""
    return table.orderBy(F.desc("macro_f05"), "threshold").first()["threshold"]


def blocking_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share (1 if there are none)."""
    hit = truth.join(found.where("cand_id is not null").select("s1_id", "cand_id", F.lit(1).alias("__hit")).distinct(), ["s1_id", "cand_id"], "left")
    row = hit.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("__hit").alias("found_pairs"))
    return row.select("true_pairs", "found_pairs", F.coalesce(F.try_divide(F.col("found_pairs"), F.col("true_pairs")), F.lit(1.0)).alias("blocking_recall"))
