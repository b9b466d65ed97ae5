import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposurelab.operators import explore, stats


@pytest.fixture(scope="module")
def values(spark):
    """A hot key with repeated values, small keys, a null value and a null key."""
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([1, 2, 2, 5, 7, rng.random() * 100]))) for _ in range(700)]
    rows += [(k, float(rng.randint(0, 50))) for k in "abc" for _ in range(rng.randint(1, 9))]
    rows += [("hot", None), ("single", 4.0)]
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    return pdf, spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None).values.tolist(), "k string, v double").repartition(6).cache()


SEGMENTS = [None, 10, 1000]


def cut(width):
    return None if width is None else F.floor(F.col("v") / width)


@pytest.mark.parametrize("segment", SEGMENTS)
def test_describe_is_exact_however_values_are_cut(values, segment):
    pdf, df = values
    names = {"q25": "25%", "q50": "50%", "q75": "75%"}
    got = stats.describe(df, "v", ["k"], segment=cut(segment)).toPandas().set_index("k").sort_index()
    expected = pdf.groupby("k")["v"].describe().sort_index()
    for c in ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]:
        assert np.allclose(got[c].astype(float), expected[names.get(c, c)], equal_nan=True), c
    whole = stats.describe(df, "v", segment=cut(segment)).toPandas().iloc[0]
    for c, e in pdf["v"].describe().items():
        assert whole[{v: k for k, v in names.items()}.get(c, c)] == pytest.approx(e)


@pytest.mark.parametrize("segment", SEGMENTS)
def test_ecdf_averages_ties(values, segment):
    pdf, df = values
    got = stats.ecdf(df, "v", segment=cut(segment)).toPandas().set_index("v")["ratio"].sort_index()
    v = pdf["v"].dropna()
    expected = (v.rank() / len(v)).groupby(v).first().sort_index()
    assert np.allclose(got, expected) and np.allclose(got.index, expected.index)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (9.99,), (10.0,), (None,)], "v double")
    got = {r["bin"]: (r["left_edge"], r["n"]) for r in stats.histogram(df, "v", 4).collect()}
    assert got == {0: (0.0, 2), 1: (2.5, 1), 3: (7.5, 2)}
    inside = stats.histogram(df, "v", 2, low=0, high=3).collect()
    assert {r["bin"]: r["n"] for r in inside} == {0: 2, 1: 1}
    flat = stats.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 2, density=True).first()
    assert (flat["bin"], flat["left_edge"], flat["n"], flat["density"]) == (1, 3.0, 2, 2.0)


def test_pearson_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = 0.3 * x + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    row = stats.pearson_test(df, "x", "y").first()
    assert row["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert row["t"] == pytest.approx(row["r"] * np.sqrt(298 / (1 - row["r"] ** 2)))
    assert 0 < row["p_value"] < 1e-3
    halves = stats.pearson_test(df.withColumn("h", F.col("x") > 0), "x", "y", ["h"]).collect()
    assert len(halves) == 2 and all(0 < r["p_value"] <= 1 for r in halves)


def test_zscores(spark):
    got = stats.zscores(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [r["a_norm"] for r in got] == pytest.approx([-0.5**0.5, 0.5**0.5])
    assert [r["b_norm"] for r in got] == [None, None]


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 1, 2, 5, 6, 100, None]], "v int")
    got = {r["bin"]: r["n"] for r in explore.binned_counts(df, "v", [0, 1, 5]).collect()}
    assert got == {"(0,1]": 2, "(1,5]": 2, "(5,inf]": 2}


def test_group_operators_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    assert [tuple(r) for r in explore.group_mean(df, ["k"], "v").collect()] == [("a", 1.0)]
    assert [tuple(r) for r in explore.group_sizes(df, ["k"], "v").collect()] == [("a", 1)]
    assert explore.id_copies(df, "k").first()[0] == 2


def test_describe_dense_counts_absent_hours_as_zero(spark):
    hourly = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (2, 1, 1)], "user_id int, period int, n_posts int")
    got = explore.describe_dense(hourly, "user_id", F.lit(4)).toPandas().set_index("user_id").sort_index()
    expected = pd.DataFrame({1: [4, 2, 0, 0], 2: [1, 0, 0, 0]}).describe().T
    assert np.allclose(got[["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), expected)


@pytest.mark.parametrize("mean", [False, True])
def test_calendar_grid_over_a_year_end(spark, mean):
    rows = [("2019-12-28 10:00:00", 1.0), ("2019-12-28 11:00:00", 3.0), ("2020-01-05 00:00:00", 7.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = {r["day"]: r for r in explore.calendar_grid(df, "t", "v", mean=mean).collect()}
    assert min(got) == dt.date(2019, 12, 22) and max(got) == dt.date(2020, 1, 11) and len(got) == 21
    assert got[dt.date(2019, 12, 28)]["value"] == (2.0 if mean else 4.0)
    assert got[dt.date(2020, 1, 5)]["week"] == 2 and got[dt.date(2020, 1, 5)]["weekday"] == 0
    assert got[dt.date(2020, 1, 1)]["tick"] == "Jan.\n2020" and got[dt.date(2019, 12, 31)]["tick"] is None
    assert got[dt.date(2019, 12, 30)]["value"] == 0.0


def test_date_slice_includes_both_ends(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), ("2020-01-03",)], "d string").withColumn(
        "t", F.col("d").cast("timestamp")
    )
    assert explore.date_slice(df, "t", "2020-01-01", "2020-01-02").count() == 2
    assert explore.date_slice(df, "t", "2020-01-02").count() == 2


def test_samples_do_not_depend_on_the_partitions(spark):
    ids = spark.range(2000)
    pick = lambda df: sorted(r["id"] for r in explore.sample_fraction(df, "id", 0.1).collect())
    assert pick(ids.repartition(1)) == pick(ids.repartition(9)) and 140 < len(pick(ids)) < 260
    assert explore.sample_rows(ids.repartition(3), "id", 10).count() == 10
    share = explore.split(ids, "id").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.25) < 0.03
    folds = ids.select(explore.fold_of("id", 5).alias("f")).groupBy("f").count().collect()
    assert sorted(r["f"] for r in folds) == [0, 1, 2, 3, 4]


def test_profile_and_shape(spark):
    df = spark.createDataFrame([(1, "b"), (3, None), (3, "a")], "n int, s string")
    got = {r["column"]: r for r in explore.column_profile(df).collect()}
    assert (got["n"]["mean"], got["n"]["n_distinct"], got["n"]["n_missing"]) == (7 / 3, 2, 0)
    assert (got["s"]["smallest"], got["s"]["largest"], got["s"]["n_missing"], got["s"]["mean"]) == ("a", "b", 1, None)
    assert explore.shape(df).first()["columns"] == "n int, s string"
    assert [tuple(r) for r in explore.top_values(df, "n", 1).collect()] == [(3, 2)]


def test_profile_of_every_type_in_one_scan(spark, tmp_path):
    rows = [
        (2**60 + 1, 1.5, "x", True, dt.date(2020, 1, 2)), (2**60, 10.0, "x", None, None),
        (-5, 9.0, None, True, dt.date(2019, 1, 2)), (-5, None, "", False, dt.date(2019, 1, 2)),
    ]
    spark.createDataFrame(rows, "`a b` long, r double, s string, f boolean, d date").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    profile = explore.column_profile(df)
    got = {r["column"]: r for r in profile.collect()}
    assert (got["a b"]["smallest"], got["a b"]["largest"], got["a b"]["top"], got["a b"]["top_n"]) == ("-5", str(2**60 + 1), "-5", 2)
    # Numbers by size, not by text.
    assert (got["r"]["smallest"], got["r"]["largest"], got["r"]["q50"], got["r"]["n_missing"]) == ("1.5", "10.0", 9.0, 1)
    assert (got["s"]["smallest"], got["s"]["top"], got["s"]["n_distinct"], got["s"]["q50"]) == ("", "x", 2, None)
    assert (got["f"]["type"], got["f"]["smallest"], got["d"]["largest"]) == ("boolean", "false", "2020-01-02")
    plan = profile._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert explore.column_profile(df.filter("r > 99")).count() == 0
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_bootstrap_band(spark):
    rng = np.random.default_rng(3)
    days = [dt.datetime(2020, 1, 1 + i % 2, 10) for i in range(800)]
    data = pd.DataFrame({"id": range(800), "t": days, "v": rng.normal(5, 2, 800)})
    df = spark.createDataFrame(data)
    band = explore.bootstrap_band(df, "t", "v", "id", replicates=203, seed="a").orderBy("day").collect()
    again = explore.bootstrap_band(df.repartition(7), "t", "v", "id", replicates=203, seed="a").orderBy("day").collect()
    normal = explore.daily_band(df, "t", "v").orderBy("day").collect()
    assert len(band) == 2
    for b, a, n in zip(band, again, normal):
        assert (b["n"], b["mean"]) == (n["n"], pytest.approx(n["mean"]))
        assert (a["low"], a["high"]) == (pytest.approx(b["low"]), pytest.approx(b["high"]))
        assert (b["low"], b["high"]) == (pytest.approx(n["low"], abs=0.06), pytest.approx(n["high"], abs=0.06))
    odd = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), None), (2, None, 1.0)], "id long, t timestamp, v double")
    assert explore.bootstrap_band(odd, "t", "v", "id").count() == 0


def test_once_or_repeating(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "a")], "k int, m string")
    flags = explore.once_or_repeating(pairs, "k", "m")
    got = {r["k"]: (r["n_once"], r["n_repeating"]) for r in explore.once_repeating_sizes(flags, "k").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 1)}


def test_unions(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert sorted(map(tuple, explore.tolerant_union([a, b]).select("x", "y", "z").collect())) == [(1, 2, None), (3, None, 4)]
    tagged = explore.tagged_union({"p": a, "q": a}).collect()
    assert sorted(r["origin"] for r in tagged) == ["p", "q"]


def test_repost_flag(spark):
    df = spark.createDataFrame([("RT x", False), ("x RT ", False), ("y", True)], "t string, c boolean")
    assert [r[0] for r in df.select(explore.repost_flag("t", "c")).collect()] == [True, False, True]
