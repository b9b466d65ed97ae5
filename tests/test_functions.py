import datetime as dt
import math
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposurelab.functions import links, times, tokens


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("unit,freq", [("hour", "h"), ("day", "D"), ("minute", "min")])
def test_round_time_goes_half_to_even(spark, unit, freq):
    texts = [
        "2020-01-01 12:00:00", "2020-01-02 12:00:00", "2020-01-02 00:30:00", "2020-01-02 01:30:00",
        "2020-01-02 11:59:59.999999", "2020-01-02 12:00:00.000001", "1969-12-30 12:00:00", "1969-12-31 12:00:00",
        "1965-03-04 05:30:00", "2020-01-01 00:00:30",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", times.epoch_us(times.round_time(F.col("t").cast("timestamp"), unit)).alias("us")).collect()
    expected = pd.to_datetime(pd.Series(texts), format="ISO8601").dt.round(freq).astype("datetime64[us]").astype("int64")
    assert {r["i"]: r["us"] for r in got} == dict(enumerate(expected))


def test_floor_time(spark):
    c = times.epoch_us(times.floor_time(F.col("t").cast("timestamp"), "day"))
    assert one(spark, c, t="1969-12-31 23:00:00") == -86_400_000_000


def test_parse_post_time(spark):
    parse = lambda s: one(spark, times.epoch_us(times.parse_post_time("t")), t=s)
    assert parse("Wed Oct 10 20:19:24 +0000 2018") == 1539202764_000_000
    assert parse("Wed Oct 10 22:19:24 +0200 2018") == 1539202764_000_000
    assert parse("2018-10-10T20:19:24Z") == 1539202764_000_000
    assert parse("no date") is None
    c = times.parse_post_time(times.format_post_time(F.timestamp_seconds(F.lit(1539202764))))
    assert one(spark, F.unix_seconds(c)) == 1539202764


def test_normal_distribution(spark):
    normal = statistics.NormalDist()
    ps = [1e-12, 1e-6, 0.01, 0.024, 0.025, 0.3, 0.5, 0.77, 0.98, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", links.normal_quantile("p").alias("q"), links.normal_cdf(links.normal_quantile("p")).alias("b")).collect():
        assert r["q"] == pytest.approx(normal.inv_cdf(r["p"]), abs=1e-8)
        assert r["b"] == pytest.approx(r["p"], rel=1e-9)
    xs = [-38.0, -8.0, -7.2, -1.0, 0.0, 0.5, 3.0, 9.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", links.normal_cdf("x").alias("c")).collect():
        assert r["c"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_links_invert(spark):
    assert one(spark, links.expit(links.logit("p")), p=0.3) == pytest.approx(0.3)
    assert one(spark, links.clip("p", 0.01), p=0.0) == 0.01
    assert one(spark, links.log1p("p"), p=0.5) == pytest.approx(math.log(1.5))


def test_student_p_value(spark):
    # Exact values: df=1 is the Cauchy distribution, df=2 has a closed form.
    rows = [(1.0, 1), (2.0, 2), (0.0, 5), (1.96, 10**7), (-30.0, 1), (2.5, 400), (1.0, 0), (None, 3), (0.5, 10**6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, n long")
    p = [r["p"] for r in df.orderBy("i").select(links.student_p("t", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(0.5, abs=1e-12)
    assert p[1] == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert p[2] == 1.0
    assert p[3] == pytest.approx(0.05, abs=1e-4)
    assert p[4] == pytest.approx(2 * math.atan(1 / 30) / math.pi, rel=1e-10)
    # By numeric integration of the density.
    norm = math.exp(math.lgamma(200.5) - math.lgamma(200)) / math.sqrt(400 * math.pi)
    steps = 20_000
    area = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * (1 + (2.5 * i / steps) ** 2 / 400) ** -200.5 for i in range(steps + 1))
    assert p[5] == pytest.approx(1 - 2 * norm * area * 2.5 / steps / 3, rel=1e-8)
    assert p[6] is None and p[7] is None
    assert p[8] == pytest.approx(math.erfc(0.5 / math.sqrt(2)), abs=1e-6)


def test_post_tokens(spark):
    text = "RT @someone: Don't look at https://x.org/a?b #Vote2020 \U0001F600 me@here.org!"
    assert one(spark, tokens.post_tokens("t"), t=text) == [
        "rt", ":", "don't", "look", "at", "#vote2020", "\U0001F600", "me", "@", "here", ".", "org", "!",
    ]


def test_words_and_ngrams(spark):
    assert one(spark, tokens.words("t"), t="Über 3 Dinge, über-all") == ["über", "dinge", "über", "all"]
    grams = lambda n: one(spark, tokens.ngrams(tokens.words(F.col("t")), n), t="a b c")
    assert grams(1) == ["a", "b", "c"]
    assert grams(2) == ["a b", "b c"]
    assert grams(4) == []
    sets = one(spark, tokens.ngram_sets(tokens.words(F.col("t")), 2, 3), t="a b c")
    assert [(s["size"], s["terms"]) for s in sets] == [(2, ["a b", "b c"]), (3, ["a b c"])]
    assert one(spark, tokens.drop_words(tokens.words(F.col("t")), ["b"]), t="a b c") == ["a", "c"]


def test_padding(spark):
    ids = F.array(*[F.lit(i) for i in (1, 2, 3)])
    assert one(spark, tokens.pad_front(ids, 5)) == [0, 0, 1, 2, 3]
    assert one(spark, tokens.pad_front(ids, 2)) == [2, 3]
    assert one(spark, tokens.wrap_back(ids, 7, 101, 102)) == [101, 1, 2, 3, 102, 0, 0]
    assert one(spark, tokens.wrap_back(ids, 4, 101, 102)) == [101, 1, 2, 102]
    assert one(spark, tokens.mask(tokens.wrap_back(ids, 7, 101, 102))) == [1, 1, 1, 1, 1, 0, 0]
    assert one(spark, tokens.one_hot(F.lit(1), 3)) == [0, 1, 0]


def test_gap_seconds(spark):
    a, b = F.lit(dt.datetime(2020, 1, 1, 0, 0, 1, 500000)), F.lit(dt.datetime(2020, 1, 1))
    assert one(spark, times.gap_seconds(a, b)) == 1.5
