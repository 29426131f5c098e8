"""A whole run over a folder of dataset files: reports, training, inference, both result files, and their validation.

    python -m kinfold DATA OUT [--cache FOLDER] [--ablation]

``DATA`` has ``train/`` and, optionally, ``test/`` with the files that
:func:`kinfold.sources.tsv.load_dataset` reads.  Tables may lie on any file
system of Spark's; the small reports are written by the driver below ``OUT``.
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators import metrics, model, reports, validator
from kinfold.plans import resolve
from kinfold.session import get_session, ship
from kinfold.sources import tsv

log = logging.getLogger("kinfold")


@contextmanager
def timed(what: str) -> Iterator[None]:
    start = time.perf_counter()
    log.info("%s: begun", what)
    yield
    log.info("%s: %.1f s", what, time.perf_counter() - start)


def _records(found: dict[str, DataFrame]) -> DataFrame:
    """All sources; candidate records of one id count once."""
    return found["s1"].unionByName(found["s2"].unionByName(found["s3"]).dropDuplicates(["entity_id"]))


def run(spark: SparkSession, data: str, out: str, config: Config = Config(), cache: str | None = None, ablation: bool = False, test: bool = True) -> dict:
    """The report that is also written to ``OUT/reports/validation_report.json``."""
    ship(spark)
    found = tsv.load_dataset(spark, data, train=True)
    records, truth = _records(found), metrics.truth_pairs(found["truth"])
    with timed("exploratory report"):
        reports.write_eda(reports.eda(records, found["truth"], truth), f"{out}/reports")
    with timed("training"):
        done = resolve.train(records, truth, config, cache)
    row = lambda df: df.first().asDict()
    report = {
        "threshold": done.threshold, "test": row(done.test_metrics), "exact_name_baseline": row(done.baseline_metrics), "blocking": row(done.recall),
        "thresholds": [r.asDict() for r in done.thresholds.orderBy("threshold").collect()], "importances": dict(model.importances(done.model)),
    }
    if ablation:
        with timed("ablation"):
            reports.write_csv(resolve.ablation(done.rows, done.tune_ids, done.tune_truth, config), f"{out}/reports/experiment_results.csv")
    if test:
        with timed("inference"):
            new = tsv.load_dataset(spark, data, train=False)
            every = _records(new)
            matches, candidates = resolve.infer(every, resolve.refit(records, truth, config), done.threshold, config)
            tsv.write_tsv(matches, f"{out}/output/matching_results.tsv")
            tsv.write_tsv(candidates, f"{out}/output/candidate_pairs.tsv")
        with timed("validation"):
            ids = lambda source: new[source].select(F.col("entity_id").alias("id"))
            errors, warnings = validator.validate_results(spark, f"{out}/output/matching_results.tsv", f"{out}/output/candidate_pairs.tsv", ids("s1"), ids("s2").unionByName(ids("s3")))
            report |= {"errors": errors, "warnings": warnings}
    tsv.save_json(report, f"{out}/reports/validation_report.json")
    return report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__.split("\n", 1)[0])
    parser.add_argument("data")
    parser.add_argument("out")
    parser.add_argument("--cache")
    parser.add_argument("--ablation", action="store_true")
    parser.add_argument("--no-test", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    report = run(get_session(), args.data, args.out, cache=args.cache, ablation=args.ablation, test=not args.no_test)
    for problem in report.get("errors", []):
        log.error(problem)
    return int(bool(report.get("errors")))
