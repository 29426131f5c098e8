"""Exploratory aggregates, cross-country check, error samples and their HTML."""

from __future__ import annotations

import csv
import os
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.text import id_list
from kinfold.sources.tsv import save_json


def country_counts(records: DataFrame) -> DataFrame:
    source = F.substring("entity_id", 1, 2)
    return records.groupBy(source.alias("source"), "country").agg(F.count(F.lit(1)).alias("n"))


def match_histogram(truth: DataFrame) -> DataFrame:
    """(matches, entities): how many reference records have how many matches."""
    return truth.select(F.size(id_list(F.col("matched_entity_ids"))).cast("long").alias("matches")).groupBy("matches").agg(F.count(F.lit(1)).alias("entities"))


def truth_summary(truth: DataFrame) -> DataFrame:
    n = F.size(id_list(F.col("matched_entity_ids"))).cast("long")
    row = truth.select(n.alias("n")).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") == 0).alias("singletons"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return row.withColumn("singleton_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("singletons"), F.col("entities")), 4), F.lit(0.0)))


def cross_country(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs (s1_id, cand_id) whose records name different countries; pairs with a null country or unknown id are left out."""
    x = records.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"))
    y = records.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("matched_country"))
    return pairs.join(x, "s1_id").join(y, "cand_id").where(F.col("s1_country") != F.col("matched_country")).select("s1_id", "cand_id", "s1_country", "matched_country")


def error_samples(truth: DataFrame, predicted: DataFrame, records: DataFrame, each: int = 5) -> DataFrame:
    """The first ``each`` true positives, false positives and false negatives by id, with their texts."""
    t, p = truth.select("s1_id", "cand_id", F.lit(True).alias("t")), predicted.select("s1_id", "cand_id", F.lit(True).alias("p"))
    kind = F.when(F.col("t") & F.col("p"), "TRUE_POSITIVE").when(F.col("p"), "FALSE_POSITIVE").otherwise("FALSE_NEGATIVE")
    joined = t.join(p, ["s1_id", "cand_id"], "full_outer").select("s1_id", "cand_id", kind.alias("type"))
    first = joined.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("s1_id", "cand_id"))).where(F.col("n") <= each).drop("n")
    x = records.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_addr"))
    y = records.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("cand_name"), F.col("business_address").alias("cand_addr"))
    return first.join(x, "s1_id", "left").join(y, "cand_id", "left").select("type", "s1_id", "cand_id", "s1_name", "cand_name", "s1_addr", "cand_addr")


def html_table(title: str, rows: list[dict]) -> str:
    """A small report as HTML."""
    if not rows:
        return f"<h2>{escape(title)}</h2><p>none</p>"
    head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def eda(records: DataFrame, truth: DataFrame, pairs: DataFrame) -> dict:
    """The exploratory summary: rows and countries of each source, match counts, singletons, and cross-country pairs, which are counted."""
    counts: dict[str, dict] = {}
    for r in country_counts(records).orderBy(F.desc("n"), "country").collect():
        counts.setdefault(r.source, {})[r.country] = r.n
    summary = truth_summary(truth).first()
    return {
        "dataset_statistics": {s: {"rows": sum(c.values()), "countries": c} for s, c in sorted(counts.items())},
        "ground_truth_distribution": {**summary.asDict(), "match_count_distribution": {r.matches: r.entities for r in match_histogram(truth).orderBy("matches").collect()}},
        "noise_characteristics": {"cross_country_matches": cross_country(pairs, records).count()},
    }


def eda_html(summary: dict) -> str:
    sizes = [{"source": s, "rows": x["rows"], "countries": len(x["countries"])} for s, x in summary["dataset_statistics"].items()]
    found = {k: v for k, v in summary["ground_truth_distribution"].items() if k != "match_count_distribution"}
    matches = [{"matches": k, "entities": v} for k, v in summary["ground_truth_distribution"]["match_count_distribution"].items()]
    parts = html_table("Sources", sizes), html_table("Truth", [found]), html_table("Matches of a reference record", matches), html_table("Pairs", [summary["noise_characteristics"]])
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Entity resolution: the data</title></head><body>{''.join(parts)}</body></html>"


def write_eda(summary: dict, folder: str) -> None:
    """``eda_summary.json`` and ``eda_report.html``, written by the driver."""
    save_json(summary, f"{folder}/eda_summary.json")
    with open(f"{folder}/eda_report.html", "w", encoding="utf-8") as f:
        f.write(eda_html(summary))


def write_csv(rows: list[dict], path: str) -> None:
    """A small table, such as the outcome of an ablation, written by the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else [])
        out.writeheader()
        out.writerows(rows)
