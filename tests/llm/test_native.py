"""Chat formatting, URL lists and mixing: edge cases, brute force, and plans without Python."""

import datetime
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import chat, mixing, queries, urlfilter

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_url_filters", "op7_chat_format", "op8_quality_rules", "op10_mixing"])
def test_native_plans(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    assert not [w for w in ("Python", "Pandas", "ArrowEval", "MapIn") if w in text]


# -- chat -----------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, valid string"


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\l\\b\\g<>\\", "", None, "\\Q</turn>\n\\E", "é中\U0001F600\n"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "clash") for i, t in enumerate(nasty)] + [(2, 0, "a>b\n<", "x", "c"), (3, None, None, None, None), (None, 0, "user", "q", "c"), (4, 0, "user", "same", "c"), (4, 0, "user", "same", "c")]
    made = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for conv, _, role, text, _ in rows:
        want[conv].append((role or "", text or ""))
    assert back == dict(want)
    for r in made.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    spoken = "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert got[1].loss_chars == len(spoken) and got[1].loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want[1]).encode()).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize(("roles", "valid"), [(["user", "assistant"], True), (["system", "user", "assistant"], True), (["assistant"], False), (["user"], False), (["user", "user", "assistant"], False), (["user", "assistant", "system"], False), (["user", "assistant", "user", "assistant"], True)])
def test_state_machine(spark, roles, valid):
    df = spark.createDataFrame([(1, i, r, "x", None) for i, r in enumerate(roles)], TURNS)
    assert chat.format_conversations(df).first().valid is valid


def test_a_long_conversation(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn <{i}> " + "x" * (i % 50), None) for i in range(6000)], TURNS)
    r = chat.digests(chat.format_conversations(df)).first()
    spoken = "".join(f"turn <{i}> " + "x" * (i % 50) for i in range(1, 6000, 2))
    assert r.n_turns == 6000 and r.loss_chars == len(spoken) and r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()


# -- lists ------------------------------------------------------------------------
def day(text):
    return datetime.date.fromisoformat(text)


def test_url_lists(spark):
    entries = spark.createDataFrame([
        ("bad.org", "block", day("2024-01-10")), ("bad.org", "remove", day("2024-02-10")), ("bad.org", "block", day("2024-03-10")), ("ok.bad.org", "allow", day("2024-01-01")),
        ("tie.net", "block", day("2024-01-01")), ("tie.net", "allow", day("2024-01-01")), ("Case.com", "block", day("2024-01-01")), ("x.y", "what", day("2024-01-01")), (None, "block", day("2024-01-01")), ("z.z", "block", None),
    ], "domain string, action string, day date")
    cases = [
        (1, "http://bad.org/a", "2024-01-09", "allow"), (2, "http://bad.org/a", "2024-01-10", "block"), (3, "https://www.bad.org:8080/?q", "2024-02-09", "block"), (4, "http://bad.org", "2024-02-10", "allow"),
        (5, "http://u:p@BAD.org./", "2024-04-01", "block"), (6, "http://ok.bad.org/x", "2024-04-01", "allow"), (7, "http://notbad.org", "2024-04-01", "allow"), (8, "http://tie.net", "2024-04-01", "block"),
        (9, "http://case.com", "2024-04-01", "block"), (10, None, "2024-04-01", "allow"), (11, "nonsense", "2024-04-01", "allow"), (12, "http://bad.org", None, "allow"), (2, "http://bad.org/a", "2024-01-10", "block"), (13, "http://z.z", "2024-04-01", "allow"),
    ]
    captures = spark.createDataFrame([(i, u, d and day(d), "clash") for i, u, d, _ in cases], "page_id long, url string, fetch_day date, domain string")
    got = Counter((r.id, r.verdict) for r in urlfilter.evaluate(captures, entries).collect())
    assert got == Counter((i, v) for i, _, _, v in cases)
    assert urlfilter.evaluate(captures.limit(0), entries).count() == 0
    assert urlfilter.evaluate(captures, entries.limit(0)).where("verdict = 'block'").count() == 0


# -- mixing -------------------------------------------------------------------------
def test_deviation_below_one_block(spark):
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), (None, 7), ("e", None), ("f", 0)], "source string, weight long")
    rows = mixing.schedule(weights).collect()
    period = rows[0].period
    assert period == 18 and sorted(r.slot for r in rows) == list(range(18))
    weight, order = {r.source: r.weight for r in rows}, {r.slot: r.source for r in rows}
    given = Counter()
    for slot in range(period):
        given[order[slot]] += 1
        for source, w in weight.items():
            assert abs(given[source] - (slot + 1) * w / period) < 1
    assert given == weight


def test_many_sources(spark, monkeypatch):
    rng = random.Random(5)
    weights = [(f"s{i}", rng.randint(1, 9)) for i in range(150)]
    rows = mixing.schedule(spark.createDataFrame(weights, "source string, weight long")).collect()
    period = sum(w for _, w in weights)
    assert sorted(r.slot for r in rows) == list(range(period)) and Counter(r.source for r in rows) == dict(weights)
    for r in rows:
        assert (r.k - 1) * period // r.weight <= r.slot < -(-r.k * period // r.weight)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 100)
    with pytest.raises(Exception, match="over 100 sources"):
        mixing.schedule(spark.createDataFrame(weights, "source string, weight long")).collect()


def test_mix_with_any_column_names(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "x") for i in range(50)], "doc_id long, source string, `a.b` string").withColumn("__kf_slot", F.lit(-1)).withColumn("of", F.lit("clash"))
    mixed = mixing.mix(docs, mixing.tempered_weights(docs, total=10), block=4)
    assert mixing.in_order(mixed).columns == docs.columns and len({tuple(r)[-2:] for r in mixed.collect()}) == 50


def test_mix_keeps_every_row(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else None, "x") for i in range(500)] + [(7, "t7", "big", "x"), (None, None, "new", "y"), (None, "u", "new", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string").repartition(3)
    mixed = mixing.mix(docs, mixing.tempered_weights(docs, total=10), text_col="text", block=7)
    got = mixed.collect()
    assert Counter(map(tuple, mixing.in_order(mixed).collect())) == Counter(rows)
    assert len({(r["__kf_slot"], r["__kf_pos"]) for r in got}) == len(rows)
    for r in got:
        assert r["__kf_release"] <= r["__kf_slot"] < r["__kf_deadline"]
    by = defaultdict(list)
    for r in got:
        by[r.source].append((r["__kf_block"], r["__kf_pos"]))
    for places in by.values():
        assert sorted(places) == [(i // 7, i % 7) for i in range(len(places))]
    assert mixing.mix(docs.limit(0), mixing.tempered_weights(docs.limit(0))).count() == 0
