import json
import math

import pytest
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators import blocking, features, matching, metrics, reports, validator
from kinfold.plans import job, queries, resolve
from kinfold.sources import synthetic, tsv

RECORD = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def basic(spark):
    return spark.createDataFrame([
        ("S1-1", "Blue Foods Ltd", "12 Oak Street 560001", "IN"), ("S1-2", "Delta Motors", "99 Hill Road", "US"), ("S1-3", None, None, None), ("S1-4", "Lone Star", "1 Moon", "ZZ"),
        ("S2-1", "Blue Foods", "12 Oak St 560001", "IN"), ("S3-1", "Blue  Blue Foods", None, "IN"), ("S2-2", "Delta Motors", "98 Hill Road", "US"), ("S3-2", "Delta Motors", "99 Hill Road", "us"), ("S2-3", "Nameless", None, None),
    ], RECORD)


def by_id(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_keys_keep_repeats(spark, basic):
    keys = by_id(blocking.blocking_keys(basic), "entity_id", "key")
    assert keys["S3-1", "nw:blue"].times == 2
    assert ("S1-1", "d:560001") in keys and ("S1-1", "d:12") not in keys  # two characters are too few
    assert not [k for k in keys if k[0] == "S1-3"]
    assert keys["S1-4", "aw:moon"].country == "ZZ"


def test_digit_channel(spark):
    df = spark.createDataFrame([("S1-1", "68, 123456 1234567 -12 4Th 123", None, "X")], RECORD)
    keys = {r.key for r in blocking.blocking_keys(df).collect()}
    assert {k for k in keys if k.startswith("d:")} == {"d:123456", "d:-12", "d:123"}


def test_weights_scores_and_top(spark, basic):
    s1, others = blocking.split_sources(basic)
    weights = by_id(blocking.key_weights(blocking.blocking_keys(others), 2), "key")
    assert ("nw:blue",) not in weights  # three occurrences, cap two
    assert weights["nw:foods",].weight == pytest.approx(1 / (1 + math.log(2)))
    got = by_id(blocking.candidates(s1, others, top_k=1, max_key_freq=10), "s1_id")
    assert got["S1-1",].cand_id == "S2-1" and got["S1-2",].cand_id == "S2-2"  # 'us' is another label than 'US'
    assert got["S1-4",].cand_id is None and got["S1-3",].cand_id is None
    full = by_id(blocking.scores(s1, others, 10), "s1_id", "cand_id")
    w = lambda n: 1 / (1 + math.log(n))
    assert full["S1-1", "S3-1"].blocking_score == pytest.approx(2 * w(3) + w(2), abs=1e-6)
    once = by_id(blocking.scores(s1, others, 10, dedupe_keys=True), "s1_id", "cand_id")
    assert once["S1-1", "S3-1"].blocking_score == pytest.approx(2 * w(2), abs=1e-6)
    assert any(r.key == "n3p:blu" for r in blocking.blocking_keys(s1, prefix_keys=True).collect())


def test_queries_keep_keys_up_to_the_operators_cap(spark, monkeypatch):
    """A name word with 600 occurrences counts, one with 2001 does not."""
    rows = [("S1-1", "plenty", None, "A"), ("S1-2", "common", None, "A")]
    rows += [(f"S2-{i}", "plenty", None, "A") for i in range(600)] + [(f"S3-{i}", "common", None, "A") for i in range(2001)]
    monkeypatch.setattr(synthetic, "records", lambda spark, sf_dir: spark.createDataFrame(rows, RECORD))
    assert {r.s1_id: r["count"] for r in queries.blocking_scores(spark, "").groupBy("s1_id").count().collect()} == {"S1-1": 600}
    assert [(r.key, r.df) for r in queries.key_idf_weights(spark, "").collect()] == [("nw:plenty", 600)]


def test_gbt_match_trains_the_whole_model(monkeypatch):
    seen = []

    def train(records, truth, config):
        seen.append(config)
        raise StopIteration

    monkeypatch.setattr(resolve, "train", train)
    monkeypatch.setattr(synthetic, "records", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries, "_truth", lambda spark, sf_dir: None)
    with pytest.raises(StopIteration):
        queries.gbt_match(None, "")
    assert (seen[0].blocking_top_k, seen[0].max_key_freq, seen[0].model_rounds, seen[0].step_size) == (50, 2000, 300, 0.05)


def test_top_k_ties_go_to_lesser_id(spark):
    rows = [("S1-1", "same thing", None, "A")] + [(f"S2-{i}", "same thing", None, "A") for i in range(9)]
    s1, others = blocking.split_sources(spark.createDataFrame(rows, RECORD))
    assert sorted(r.cand_id for r in blocking.candidates(s1, others, top_k=3).collect()) == ["S2-0", "S2-1", "S2-2"]


def test_diagnostics(spark, basic):
    s1, others = blocking.split_sources(basic)
    row = blocking.diagnostics(s1, others, blocking.candidates(s1, others)).first()
    assert (row.total_s1_entities, row.total_s2_records, row.total_s3_records, row.total_possible_pairs) == (4, 3, 2, 20)
    assert row.candidate_reduction_ratio == pytest.approx(1 - row.total_candidate_pairs / 20)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string")


def test_metrics_golden(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth, pred = pairs(spark, [("a", "x"), ("a", "z"), ("c", "q")]), pairs(spark, [("a", "x"), ("a", "y"), ("a", "z"), ("d", "w")])
    rows = by_id(metrics.entity_scores(ids, truth, pred), "s1_id")
    assert rows["a",].f05 == pytest.approx(0.7143, abs=1e-4)
    assert rows["b",].f05 == 1 and rows["c",].f05 == 0 and rows["d",].f05 == 0
    one = metrics.evaluate(ids, truth, pred).first()
    assert (one.singleton_count, one.singleton_correct, one.false_merges, one.false_negatives) == (2, 1, 2, 1)
    assert one.singleton_accuracy == 0.5 and one.pair_precision == 0.5
    none = metrics.evaluate(ids.limit(0), truth.limit(0), pred.limit(0)).first()
    assert none.macro_f05 == 0 and none.singleton_accuracy == 1


def test_threshold_table_and_ties(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.3), ("b", "z", 0.5)], "s1_id string, cand_id string, prob double")
    truth = pairs(spark, [("a", "x")])
    table = metrics.threshold_table(ids, truth, scored, (0.2, 0.6, 0.8))
    rows = by_id(table, "threshold")
    for t in (0.2, 0.6, 0.8):
        direct = metrics.evaluate(ids, truth, matching.decide(scored.withColumn("cand_id", F.concat(F.lit("S2-"), "cand_id")), t).withColumn("cand_id", F.substring("cand_id", 4, 9))).first()
        assert rows[t,].macro_f05 == pytest.approx(direct.macro_f05)
    assert metrics.best_threshold(table) == 0.6


def test_truth_lists(spark):
    df = spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1"), ("S1-3", " S2-1 ,, S3-9,S2-1"), ("S1-4", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, metrics.truth_pairs(df).collect())) == [("S1-2", "S2-1"), ("S1-3", "S2-1"), ("S1-3", "S3-9")]
    assert dict(map(tuple, reports.match_histogram(df).collect())) == {0: 2, 1: 1, 3: 1}
    assert reports.truth_summary(df).first().singletons == 2


def test_features(spark, basic):
    cand = pairs(spark, [("S1-1", "S2-1"), ("S1-3", "S2-3"), ("S1-1", "S3-1"), ("S1-1", "S9-gone")]).withColumn("blocking_score", F.lit(float("nan")))
    rows = by_id(features.pair_features(cand, basic), "s1_id", "cand_id")
    assert len(rows) == 3
    first = rows["S1-1", "S2-1"]
    assert list(first.asDict())[2:] == list(features.FEATURE_NAMES)
    assert first.name_norm_equality == 1 and first.name_exact_match == 0 and first.addr_fuzz_ratio == 100 and first.dig_count_shared == 2 and first.blocking_score == 0 and first.is_s2 == 1
    assert rows["S1-1", "S3-1"].addr_missing_flag == 1 and rows["S1-1", "S3-1"].addr_token_set == 0
    assert rows["S1-3", "S2-3"].country_exact_match == 1 and rows["S1-3", "S2-3"].name_wratio == 0


def test_matcher_rules(spark):
    scored = spark.createDataFrame([("S1-1", "S1-2", 0.9), ("S1-1", "X-2", 0.9), ("S1-1", "S2-1", 0.55), ("S1-1", "S3-1", 0.54), ("S1-1", "S3-2", 0.8)], "s1_id string, cand_id string, prob double")
    got = matching.decide(scored, 0.55, pairs(spark, [("S1-1", "S2-1"), ("S1-1", None)]))
    assert [r.cand_id for r in got.collect()] == ["S2-1"]


def test_heuristic(spark):
    rows = [(1, 0, "Blue Foods Ltd", "12 Oak St", "IN", "S2-1", "Blue Foods", "12 Oak Street", "in "), (1, 1, "Blue Foods", None, "IN", "S2-2", "Blue Foods", "x", None), (1, 2, "Blue", "a", "IN", "S2-3", "Blue", "a", "US"), (1, 3, "Blue Foods", "7 Elm", "IN", "S2-4", "Qqq Zzz", "1 Www", "IN")]
    df = spark.createDataFrame(rows, "request_id int, position int, s1_name string, s1_address string, s1_country string, candidate_id string, cand_name string, cand_address string, cand_country string")
    got = {r.candidate_id: r for r in matching.ranked_batch(matching.score_pairs(df)).collect()}
    assert got["S2-1"].confidence_score == 1 and got["S2-1"].rank == 1 and got["S2-2"].confidence_score == 1
    assert got["S2-3"].confidence_score == 0 and got["S2-3"].decision == "NO_MATCH"
    assert not got["S2-4"].is_match and got["S2-4"].total_candidates == 4 and got["S2-4"].match_count == 2


@pytest.mark.parametrize(("line", "rule"), [
    ("S1-1", "no_tab"), ("S1-1\tS2-1,S2-1", "repeated_id"), ("S1-1\tS1-2", "self_source_id"), ("S1-1\t S2-1", "bad_prefix"), ("S1-1\tS2-1,", "bad_prefix"), ("S1-1\tS2-404", "unknown_id"), ("S1-7\t", "foreign_s1"), ("S1-2\t", "missing_s1"),
])
def test_validator_rules(spark, line, rule):
    required, known = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string"), spark.createDataFrame([("S2-1",)], "id string")
    lines = spark.createDataFrame([(line,)], "line string")
    assert rule in {r.rule for r in validator.violations(lines, required, known).collect()}


def test_validator_duplicate_and_clean(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    lines = spark.createDataFrame([("S1-1\tS2-1",), ("S1-1\t",), ("S1-2\t",)], "line string")
    assert [r.rule for r in validator.violations(lines, required).collect()] == ["duplicate_row"]
    lists = tsv.id_lists(required.select(F.col("id").alias("s1_id")), pairs(spark, [("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")]), "matched_entity_ids")
    tsv.write_tsv(lists.coalesce(1), str(tmp_path / "out"))
    fatal, found = validator.validate(spark, str(tmp_path / "out"), required)
    assert fatal == [] and found.count() == 0
    (tmp_path / "bad.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    assert validator.validate(spark, str(tmp_path / "bad.tsv"), required)[0] == ["comma separated"]
    (tmp_path / "empty.tsv").write_text("")
    assert validator.validate(spark, str(tmp_path / "empty.tsv"), required)[0] == ["empty file"]
    assert validator.not_in_candidates(pairs(spark, [("S1-1", "S2-1")]), pairs(spark, [("S1-1", "S3-2")])).count() == 1


def test_tsv_quotes_and_cache(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Bob\tback\\slash \tIN\nS1-2\t\t x\tUS\n', encoding="utf-8")
    rows = by_id(tsv.read_tsv(spark, str(tmp_path / "s.tsv")), "entity_id")
    assert rows["S1-1",].business_name == '"Bob' and rows["S1-1",].country == "IN"
    assert sorted(r.id for r in tsv.read_ids(spark, str(tmp_path / "s.tsv")).collect()) == ["S1-1", "S1-2"]
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1, S2-2,,S2-3,S2-4,S2-5,S2-6\nS1-2\t\n")
    first = tsv.read_candidate_lists(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r.cand_id, r.position) for r in first] == [(f"S2-{i + 1}", i) for i in range(5)]
    made = []
    for _ in range(2):
        assert tsv.cached_parquet(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    tsv.save_json({"a": 1}, str(tmp_path / "r/x.json"))
    assert json.loads((tmp_path / "r/x.json").read_text()) == {"a": 1}
    with pytest.raises(Exception, match="(?i)path"):
        tsv.read_tsv(spark, str(tmp_path / "none.tsv")).count()


def test_reports(spark, basic):
    truth, pred = pairs(spark, [("S1-1", "S2-1"), ("S1-2", "S3-2")]), pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S3-1")])
    kinds = {r.type for r in reports.error_samples(truth, pred, basic).collect()}
    assert kinds == {"TRUE_POSITIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE"}
    assert [r.cand_id for r in reports.cross_country(truth, basic).collect()] == ["S3-2"]
    assert "<table>" in reports.html_table("x", [{"a": "<"}]) and "&lt;" in reports.html_table("x", [{"a": "<"}])


def test_end_to_end(spark):
    sf = "/root/testdata/sf0.001"
    records, truth = synthetic.records(spark, sf), metrics.truth_pairs(synthetic.truth(spark, sf))
    config = Config(blocking_top_k=5, model_rounds=3)
    done = resolve.train(records, truth, config)
    assert done.test_metrics.first().macro_f05 > 0.5 and done.recall.first().blocking_recall > 0.9
    matched, lists = resolve.infer(records, done.model, done.threshold, config)
    assert matched.count() == lists.count() == 150
    assert resolve.fast_mode(lists, 2).agg(F.min("blocking_score")).first()[0] == 2.5


def test_stream(spark, tmp_path):
    from kinfold.streaming import scoring

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"request_id": "r", "position": 0, "s1_name": "Blue Foods", "cand_name": "Blue Foods Ltd"}) + "\n")
    run = scoring.score_stream(scoring.read_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first().decision == "MATCH"


# -- files, reports, whole runs ----------------------------------------------------
def _dataset(tmp_path, n=40):
    names = [f"Acme {w} {i}" for i, w in enumerate(["Traders", "Foods", "Paper", "Steel"] * (n // 4))]
    rows = {k: ["entity_id\tbusiness_name\tbusiness_address\tcountry"] for k in ("1", "2", "3")}
    truth = ["source1_entity_id\tmatched_entity_ids"]
    for i, name in enumerate(names):
        place = f"{100 + i} High Street Unit{i}x"
        rows["1"].append(f"S1-{i}\t{name}\t{place}\tUS")
        rows["2"].append(f"S2-{i}\t{name.upper()} Inc\t{place} near park\tUS")
        rows["3"].append(f"S3-{i}\t{name.replace('Acme', 'Acm') if i % 2 else 'Other Name'}\t{place if i % 2 else 'elsewhere 9'}\tUS")
        truth.append(f"S1-{i}\tS2-{i}" + (f",S3-{i}" if i % 2 else ""))
    for kind in ("train", "test"):
        (tmp_path / kind).mkdir()
        for k, lines in rows.items():
            (tmp_path / kind / f"{kind}_source{k}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("\n".join(truth) + "\n", encoding="utf-8")


def test_whole_run(spark, tmp_path):
    _dataset(tmp_path)
    out, config = tmp_path / "out", Config(model_rounds=3, ablation_grid=(0.3, 0.5))
    report = job.run(spark, str(tmp_path), str(out), config, cache=str(tmp_path / "cache"), ablation=True)
    assert report["errors"] == [] and report["warnings"] == [] and sum(report["importances"].values()) > 0
    for name in ("eda_summary.json", "eda_report.html", "validation_report.json"):
        assert (out / "reports" / name).stat().st_size > 100
    lines = (out / "reports" / "experiment_results.csv").read_text().splitlines()
    assert len(lines) == 6 and lines[0].startswith("experiment,features,threshold")
    summary = json.loads((out / "reports" / "eda_summary.json").read_text())
    assert summary["dataset_statistics"]["S1"] == {"rows": 40, "countries": {"US": 40}} and summary["ground_truth_distribution"]["pairs"] == 60
    assert len(list((tmp_path / "cache").iterdir())) == 2  # candidates and features, found again by a second run
    found = tsv.load_dataset(spark, str(tmp_path), train=True)
    records = job._records(found)
    again = resolve.train(records, job.metrics.truth_pairs(found["truth"]), config, str(tmp_path / "cache"))
    assert len(list((tmp_path / "cache").iterdir())) == 2 and again.threshold == report["threshold"]
    lists = spark.createDataFrame([("S1-1", "S2-1, S3-1,S2-3"), ("S1-2", ""), ("S1-3", "S2-3,S9-9")], tsv.CANDIDATES)
    got = {r.source1_entity_id: r.matched_entity_ids for r in resolve.fast_match(lists, records, again.model, threshold=0.0).collect()}
    assert got == {"S1-1": "S2-1,S3-1,S2-3", "S1-2": "", "S1-3": "S2-3"}  # the list's order, unknown ids skipped


def test_file_rules(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    check = lambda data: (tmp_path / "r.tsv").write_bytes(data) and validator.validate(spark, str(tmp_path / "r.tsv"), ids)
    assert validator.validate(spark, str(tmp_path / "none.tsv"), ids) == (["file not found"], None)
    head = b"source1_entity_id\tmatched_entity_ids\n"
    assert check(head + b"S1-1\t\xff\xfe\n")[0] == ["not UTF-8"]
    assert check(b"source1_entity_id,matched_entity_ids\n")[0] == ["comma separated"]
    fatal, table = check(head + b"S1-1\tS2-1\n" + head + b"S1-2\t\n")
    assert fatal == [] and [tuple(r) for r in table.collect()] == [("repeated_header", None, "1")]
    (tmp_path / "m.tsv").write_bytes(head + b"S1-1\tS2-1\nS1-2\t\n")
    (tmp_path / "c.tsv").write_bytes(head.replace(b"matched", b"candidate") + b"S1-1\tS2-9\nS1-2\t\n")
    errors, warnings = validator.validate_results(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), ids)
    assert errors == [] and len(warnings) == 2 and "not among their candidates" in warnings[1]
    errors, warnings = validator.validate_results(spark, str(tmp_path / "m.tsv"), str(tmp_path / "absent.tsv"), ids)
    assert errors == [] and "not found" in warnings[1]


def test_key_multiplicities_of_repeated_tokens(spark):
    rows = spark.createDataFrame([("S1-1", "foo bar foo foo", "12345 12345 bar", "US"), ("S2-1", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    got = {(r.entity_id, r.key): r.times for r in blocking.blocking_keys(rows).collect()}
    assert got == {("S1-1", "nw:foo"): 3, ("S1-1", "nw:bar"): 1, ("S1-1", "aw:12345"): 2, ("S1-1", "d:12345"): 2}
