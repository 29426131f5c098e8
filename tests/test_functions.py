import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import fuzzy, fuzzy_batch, text


def lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abé ", max_size=20), st.text("abé ", max_size=20))
def test_ratio_is_indel_similarity(a, b):
    total = len(a) + len(b)
    assert fuzzy.ratio(a, b) == pytest.approx(200 * lcs(a, b) / total if total else 100)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", min_size=1, max_size=8), st.text("ab ", min_size=1, max_size=12))
def test_partial_ratio_against_all_windows(a, b):
    def one(s, t):
        n, m = len(s), len(t)
        spans = [t[max(0, i) : min(m, i + n)] for i in range(-n + 1, m)]
        return max(200 * lcs(s, w) / (n + len(w)) for w in spans)

    short, long = (a, b) if len(a) <= len(b) else (b, a)
    want = max(one(short, long), one(long, short)) if len(a) == len(b) else one(short, long)
    assert fuzzy.partial_ratio(a, b) == pytest.approx(want)


def test_token_ratios():
    assert fuzzy.token_sort_ratio("new york mets", "mets new york") == 100
    assert fuzzy.token_set_ratio("blue foods", "blue foods ltd") == 100
    assert fuzzy.token_set_ratio("", "x") == 0
    assert fuzzy.ratio("", "") == 100
    assert fuzzy.weighted_ratio("", "") == 0
    assert fuzzy.token_set_ratio("a b c", "d e f") < 50


def test_normalisers(spark):
    rows = [("Café & Söhne Pvt Ltd", "12 Oak St., Apt 4 no 7", "fr "), (None, None, None), ("None", "None", ""), ("株式会社", "東京", "JP"), ("A_b @ C. Co", "St Mary Ave", "us")]
    df = spark.createDataFrame(rows, "n string, a string, c string")
    got = df.select(text.normalize_name(F.col("n")).alias("n"), text.normalize_address(F.col("a")).alias("a"), text.normalize_country(F.col("c")).alias("c"), text.frame_name(F.col("n")).alias("fn"), text.frame_country(F.col("c")).alias("fc")).collect()
    assert [r.n for r in got] == ["cafe and sohne", "", "", "", "a_b c"]
    assert [r.a for r in got] == ["12 oak street apartment 4 number 7", "", "", "", "street mary avenue"]
    assert [r.c for r in got] == ["FR", "UNKNOWN", "UNKNOWN", "JP", "US"]
    assert [r.fn for r in got] == ["café and söhne pvt ltd", "", "none", "株式会社", "a_b c co"]
    assert [r.fc for r in got] == ["FR", "UNKNOWN", "", "JP", "US"]


def test_digits_and_tokens(spark):
    df = spark.createDataFrame([("68, 12 123456 1234567 -12 4Th 12",)], "t string")
    assert df.select(text.numeric_tokens(F.col("t"))).first()[0] == ["68", "12", "123456"]
    df = spark.createDataFrame([("blue foods ltd ab blue",)], "t string")
    assert df.select(text.significant_tokens(F.col("t"))).first()[0] == ["blue", "foods"]


def test_f_half(spark):
    df = spark.createDataFrame([(2 / 3, 1.0), (0.0, 0.0)], "p double, r double")
    got = [r[0] for r in df.select(text.f_half(F.col("p"), F.col("r"))).collect()]
    assert got[0] == pytest.approx(0.7143, abs=1e-4) and got[1] == 0


def test_bit_parallel_lcs_random():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcdé", k=rng.randint(0, 30))) for _ in range(2))
        assert fuzzy._lcs(fuzzy._masks(a), len(a), b) == lcs(a, b)


def test_batches_equal_single_pairs():
    """Every ratio of a batch is that of its pair, to the last bit, whatever the lengths and alphabets."""
    rng, words = random.Random(2), ["oak", "street", "é", "100", "blue", "ridge", "株式", "a", "foods", "\x1f"]
    pairs = [("", ""), ("", "a"), (" ", "a"), ("a", "a"), ("ab " * 150, "ba " * 200), ("x", "x" * 300), ("a b", "b a"), (" a", "a ")]
    for _ in range(1500):
        a = " ".join(rng.choices(words, k=rng.randint(0, 7)))
        b = "".join(c for c in a if rng.random() < 0.9) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 9)))
        pairs.append((a, b))
    pairs += [tuple("".join(chr(rng.randint(0x4E00, 0x5200)) for _ in range(rng.randint(1, 160))) for _ in "ab") for _ in range(40)]
    pairs += [tuple("".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in "ab") for _ in range(400)]
    got = fuzzy_batch.scores(list(fuzzy.KINDS), [a for a, _ in pairs], [b for _, b in pairs])
    for (kind, one), rated in zip(fuzzy.KINDS.items(), got, strict=True):
        assert rated.tolist() == [one(a, b) for a, b in pairs], kind
    assert [len(x) for x in fuzzy_batch.scores(["partial", "weighted"], [], [])] == [0, 0]


def test_ratios_of_a_batch_are_fast():
    """Ten thousand pairs of addresses; one pair after the other took over a millisecond for each."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["oak", "hill", "lake", "street", "road", "springfield", "riverton", "104", "731", "550103"], k=7)) for _ in range(20_000)]
    start = time.process_time()
    fuzzy_batch.scores(["ratio", "partial", "token_sort", "token_set"], texts[::2], texts[1::2])
    assert time.process_time() - start < 2.5
