import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposurelab.operators import causal, glm, mixed


def pandas_backdoor(df, missing="zero", user=None):
    """The published estimator, written out on a pandas frame."""
    keys = ([user] if user else []) + ["g", "t", "x"]
    p = df.dropna(subset=keys).groupby(keys)["y"].mean().to_frame("m").reset_index()
    p["v"] = p["m"] * (1 - p["m"])
    lead = ([user] if user else []) + ["g"]
    cells = p.groupby(lead + ["x"]).agg(m=("m", "sum"), v=("v", "sum"), n=("t", "nunique"))
    m, v = (cells["m"] / cells["n"]).unstack(), (cells["v"] / cells["n"] ** 2).unstack()
    if missing == "zero":
        m, v = m.fillna(0), v.fillna(0)
    else:
        m, v = m.dropna(), v.dropna()
    if user:
        m, v, n = m.groupby(user).mean(), v.groupby(user).mean(), v.groupby(user).size()
        return pd.DataFrame({"ate": m[1] - m[0], "band": 2 * np.sqrt((v[0] + v[1]) / n)})
    return m[1].mean() - m[0].mean(), 2 * math.sqrt((v[0].mean() + v[1].mean()) / len(v))


@pytest.fixture(scope="module")
def study():
    """Stratum drives both treatment and outcome; the true effect is 0.2."""
    rng = np.random.default_rng(3)
    rows = []
    for t in range(900):
        g = int(rng.integers(0, 12))
        x = int(rng.random() < 0.2 + 0.05 * g)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((g, t, x, int(rng.random() < 0.1 + 0.04 * g + 0.2 * x), int(rng.integers(0, 30))))
    rows += [(99, 5000, 1, 1, 1), (99, 5001, 1, 0, 2)]
    return pd.DataFrame(rows, columns=["g", "t", "x", "y", "u"])


@pytest.mark.parametrize("missing", ["zero", "drop"])
@pytest.mark.parametrize("partitions", [1, 8])
def test_backdoor_matches_the_written_out_estimator(spark, study, missing, partitions):
    df = spark.createDataFrame(study).repartition(partitions)
    row = causal.backdoor_cate(causal.conditional_response(df, "g", "t", "x", "y"), "g", "t", "x", missing=missing).first()
    ate, band = pandas_backdoor(study, missing)
    assert row["ate"] == pytest.approx(ate, abs=1e-12) and row["band"] == pytest.approx(band, abs=1e-12)
    assert row["n_strata"] == (13 if missing == "zero" else 12)


def test_backdoor_recovers_the_effect(spark, study):
    cond = causal.conditional_response(spark.createDataFrame(study), "g", "t", "x", "y")
    row = causal.backdoor_cate(cond, "g", "t", "x", missing="drop").first()
    assert abs(row["ate"] - 0.2) < row["band"] + 0.02
    naive = study.groupby("x")["y"].mean()
    assert abs(naive[1] - naive[0] - 0.2) > abs(row["ate"] - 0.2)


def test_backdoor_per_user(spark, study):
    cond = causal.conditional_response(spark.createDataFrame(study), "g", "t", "x", "y", user="u")
    got = causal.backdoor_cate(cond, "g", "t", "x", user="u").toPandas().set_index("u").sort_index()
    expected = pandas_backdoor(study, user="u").sort_index()
    assert np.allclose(got["ate"], expected["ate"]) and np.allclose(got["band"], expected["band"])


def test_one_arm_only_gives_no_effect(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 0)], "g int, t int, x int, y int")
    row = causal.backdoor_cate(causal.conditional_response(df, "g", "t", "x", "y"), "g", "t", "x").first()
    assert row["ate"] is None and row["band"] is None


def test_time_filter_is_strict_and_null_keys_drop(spark):
    rows = [(1, 1, 0, 1, 600), (1, 1, 0, 0, 601), (1, 2, 1, 1, 700), (None, 3, 1, 1, 900), (1, 4, 1, 0, None), (1, 5, 1, 1, -5)]
    df = spark.createDataFrame(rows, "g int, t int, x int, y int, s int").withColumns(
        {"xt": F.timestamp_seconds(F.lit(0)), "yt": F.timestamp_seconds("s")}
    )
    kept = df.filter(causal.far_enough("yt", "xt", 600))
    assert sorted(r["s"] for r in kept.collect()) == [601, 700, 900]
    dropped = causal.dropped_share(df, "yt", "xt", 600).first()
    assert dropped["n_dropped"] == 3 and dropped["share_dropped"] == 0.5
    row = causal.estimate_ate(df, "x", "y", "g", "t", "xt", "yt", 600).first()
    assert row["ate"] == 1.0 and row["n_strata"] == 1


def test_binarise_and_after_treat_null_as_zero(spark):
    df = spark.createDataFrame([("NEGATIVE", 1), ("POSITIVE", 3), (None, None)], "l string, s int")
    got = df.select(causal.binarise("l").alias("b"), causal.is_after(F.timestamp_seconds("s"), F.timestamp_seconds(F.lit(2))).alias("a")).collect()
    assert [(r["b"], r["a"]) for r in got] == [(1, 0), (0, 1), (0, 0)]


def test_before_after_matches_the_written_out_estimator(spark):
    rng = np.random.default_rng(8)
    rows = [(int(t % 2), t, int(rng.integers(0, 6)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for t in range(40) for _ in range(12)]
    rows.append((1, 777, 1, 1, 1))
    data = pd.DataFrame(rows, columns=["x", "t", "u", "a", "y"])
    m = data.groupby(["x", "t", "u", "a"])["y"].mean().unstack("a")
    d, v = m[1] - m[0], m[1] * (1 - m[1]) + m[0] * (1 - m[0])
    label = d.groupby(["x", "t"]).mean().groupby("x").mean()
    per_post = v.groupby(["x", "t"])
    user_var = per_post.sum() / np.square(per_post.count())
    per_label = user_var.groupby("x")
    variance = (per_label.sum() / np.square(per_label.count())).sum()
    row = causal.before_after_ate(spark.createDataFrame(data), "x", "t", "u", "a", "y").first()
    assert row["ate"] == pytest.approx(label[1] - label[0])
    assert row["variance"] == pytest.approx(variance)
    assert row["std_error"] == pytest.approx(math.sqrt(variance))


def test_absorbed_glm_equals_dense_glm(spark, study):
    df = spark.createDataFrame(study[study["g"] < 90])
    for link in ("probit", "logit"):
        dense = glm.dense_glm(df, "g", "x", "y", link)
        row = glm.glm_ate(df, "g", "x", "y", link).first()
        assert row["coefficient"] == pytest.approx(dense.coefficients[0], abs=1e-6)
        fitted = dense.transform(
            __import__("pyspark.ml.feature", fromlist=["RFormula"]).RFormula(formula="y ~ x + g").fit(
                df.select(F.col("y").cast("double"), F.col("x").cast("double"), F.col("g").cast("string"))
            ).transform(df.select(F.col("y").cast("double"), F.col("x").cast("double"), F.col("g").cast("string")))
        ).groupBy("g").pivot("x", [0.0, 1.0]).agg(F.avg("prediction")).toPandas()
        assert row["ate"] == pytest.approx((fitted["1.0"] - fitted["0.0"]).mean(), abs=1e-6)
        assert row["coefficient_se"] == pytest.approx(dense.summary.coefficientStandardErrors[0], rel=1e-5)
        assert row["ate_se"] == pytest.approx(dense_ate_error(study[study["g"] < 90], row["coefficient"], dense, link), rel=1e-4)


def dense_ate_error(data, beta, dense, link):
    """Delta method with the whole information matrix; the fitted means come from plain Newton steps per stratum."""
    normal = __import__("statistics").NormalDist()
    mean = (lambda e: 1 / (1 + math.exp(-e))) if link == "logit" else normal.cdf
    slope = (lambda e: mean(e) * (1 - mean(e))) if link == "logit" else normal.pdf
    cells = data.groupby(["g", "x"])["y"].agg(["size", "sum"]).unstack("x", fill_value=0)
    strata = []
    for _, r in cells.iterrows():
        n, k = (r["size", 0], r["size", 1]), (r["sum", 0], r["sum", 1])
        if not 0 < sum(k) < sum(n):
            strata.append(None)
            continue
        low, high = -12.0, 12.0
        for _ in range(80):
            a = (low + high) / 2
            score = sum(slope(e) * (k[i] - n[i] * mean(e)) / (mean(e) * (1 - mean(e))) for i, e in enumerate((a, a + beta)) if n[i])
            low, high = (a, high) if score > 0 else (low, a)
        strata.append((a, n))
    size = len(strata) + 1
    information, gradient = np.zeros((size, size)), np.zeros(size)
    for j, s in enumerate(strata):
        if s is None:
            information[j, j] = 1.0
            continue
        for arm, eta in enumerate((s[0], s[0] + beta)):
            if not s[1][arm]:
                continue
            weight = s[1][arm] * slope(eta) ** 2 / (mean(eta) * (1 - mean(eta)))
            row = np.zeros(size)
            row[j], row[-1] = 1.0, arm
            information += weight * np.outer(row, row)
            gradient += (1 if arm else -1) * slope(eta) * row / len(strata)
    return math.sqrt(gradient @ np.linalg.solve(information, gradient))


def test_glm_margins_equal_the_data(spark, study):
    rows = glm.glm_margins(spark.createDataFrame(study), "g", "x", "y").collect()
    assert len(rows) == study["g"].nunique() + 1
    for r in rows:
        assert r["fitted"] == pytest.approx(r["observed"], abs=1e-4)
    assert [r["observed"] for r in rows if r["g"] is None] == [study.loc[study["x"] == 1, "y"].sum()]


def test_separated_strata_raise(spark):
    rows = [(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1), (2, 1, 1), (3, 0, 0), (3, 1, 0)]
    df = spark.createDataFrame(rows, "g int, x int, y int")
    with pytest.raises(ValueError, match="separate"):
        glm.glm_ate(df, "g", "x", "y")
    with pytest.raises(ValueError, match="separate"):
        glm.glm_ate(df.withColumn("x", 1 - F.col("x")), "g", "x", "y")
    # Without a stratum that has both arms and both outcomes nothing is estimated.
    row = glm.glm_ate(df.filter("g = 3"), "g", "x", "y").first()
    assert (row["coefficient"], row["coefficient_se"], row["ate_se"], row["n_constant"]) == (0.0, None, None, 1)


def test_glm_strata_without_variation(spark):
    rows = [(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 0, 0), (3, 0, 1), (3, 1, 1), (3, 1, 0), (4, 1, 1), (4, 1, 0)]
    df = spark.createDataFrame(rows, "g int, x int, y int")
    zero = glm.glm_ate(df, "g", "x", "y").first()
    assert zero["n_strata"] == 4
    # Strata 1 and 2 fit exactly, 3 shows no effect, 4 lacks the control arm.
    assert zero["ate"] == pytest.approx(0.5 / 4, abs=1e-6)
    assert glm.glm_ate(df, "g", "x", "y", missing="drop").first()["ate"] == pytest.approx(0.0, abs=1e-6)


def test_mixed_model_recovers_effects(spark):
    rng = np.random.default_rng(11)
    users, groups = 60, 30
    bias, mood = rng.normal(0, 0.8, users), rng.normal(0, 0.5, groups)
    rows = []
    for _ in range(9000):
        u, g, x = int(rng.integers(users)), int(rng.integers(groups)), int(rng.integers(2))
        p = 1 / (1 + math.exp(-(-0.5 + 0.9 * x + bias[u] + mood[g])))
        rows.append((u, g, x, int(rng.random() < p)))
    df = spark.createDataFrame(rows, "u int, g int, x int, y int")
    one = F.lit(1)
    fit = mixed.fit_mixed_model(
        df, "y", {"intercept": one, "x": F.col("x")}, {"group": ("g", one), "user": ("u", one)}, tolerance=1e-3
    )
    assert fit.means[1] == pytest.approx(0.9, abs=0.15)
    assert all(b >= a - 1e-6 for a, b in zip(fit.bounds, fit.bounds[1:])) and len(fit.bounds) == fit.sweeps
    rows = {r["name"]: r for r in fit.summary().filter("kind = 'random'").collect()}
    assert rows.keys() == {"group", "user"}
    for name, levels in (("group", groups), ("user", users)):
        # With all effects known, the log SD is known up to 1 / sqrt(2 levels).
        assert rows[name]["sd"] == pytest.approx(1 / math.sqrt(2 * levels), rel=0.1)
        truth = math.log({"group": mood, "user": bias}[name].std())
        assert abs(fit.log_sds[name][0] - truth) < 4 * fit.log_sds[name][1]
    assert fit.sigmas["user"] == pytest.approx(bias.std(), abs=0.25)
    effects = fit.effects["user"].toPandas().set_index("u")["mean"].sort_index()
    assert np.corrcoef(effects, bias)[0, 1] > 0.9
    effect = causal.average_individual_effect(fit.coefficients(), "intercept", ["x"]).first()["effect"]
    expit = lambda v: 1 / (1 + math.exp(-v))
    assert effect == pytest.approx(expit(fit.means.sum()) - expit(fit.means[0]))
    qq = mixed.random_effect_qq(fit.effects["user"], fit.sigmas["user"]).toPandas()
    assert qq["n"].sum() == users and np.corrcoef(qq["sample"], qq["theoretical"])[0, 1] > 0.95


def test_mixed_model_with_two_factors_of_one_key(spark):
    """Bias and effect per user; the bound rises although both share their levels."""
    rng = np.random.default_rng(12)
    bias, effect = rng.normal(0, 0.5, 80), rng.normal(0, 0.9, 80)
    rows = []
    for _ in range(12000):
        u, x = int(rng.integers(80)), int(rng.integers(2))
        rows.append((u, x, int(rng.random() < 1 / (1 + math.exp(-(0.3 + bias[u] + (effect[u] - 0.4) * x))))))
    df = spark.createDataFrame(rows, "u int, x int, y int")
    fixed = {"intercept": F.lit(1), "x": F.col("x")}
    fit = mixed.fit_mixed_model(df, "y", fixed, {"bias": ("u", F.lit(1)), "effect": ("u", F.col("x"))}, tolerance=1e-2)
    assert all(b >= a - 1e-6 for a, b in zip(fit.bounds, fit.bounds[1:]))
    assert fit.sigmas["effect"] == pytest.approx(effect.std(), abs=0.2) and fit.sigmas["bias"] == pytest.approx(bias.std(), abs=0.15)
    assert fit.means[1] == pytest.approx(effect.mean() - 0.4, abs=0.15)
    made = fit.effects["effect"].toPandas().set_index("u")["mean"].sort_index()
    assert np.corrcoef(made, effect)[0, 1] > 0.85 and abs(made.mean()) < 0.02


def test_difference_in_differences(spark):
    row = causal.difference_in_differences(
        spark.createDataFrame([(0.1, 0.2, 0.3)], "a double, b double, c double"), "a", "b", "c"
    ).first()
    expit = lambda v: 1 / (1 + math.exp(-v))
    assert row["effect"] == pytest.approx(expit(0.6) - expit(0.3))
    assert row["printed_effect"] == pytest.approx(expit(0.1) - expit(0.6))


def test_covariate_glm_finds_the_sign(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(2000):
        a, b = rng.gauss(5, 2), rng.gauss(0, 9)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-(a - 5)))), a, b))
    table = glm.covariate_glm(spark.createDataFrame(rows, "l int, a double, b double"), "l", ["a", "b"])
    got = {r["term"]: r for r in table.collect()}
    assert got["a_norm"]["coefficient"] == pytest.approx(2.0, abs=0.3)
    assert got["a_norm"]["p_value"] < 1e-6 < got["b_norm"]["p_value"]


def test_fits_that_do_not_settle_raise(spark):
    rows = [(i % 5, i % 2, int(i % 3 == 0 or i % 14 == 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, x int, y int")
    with pytest.raises(RuntimeError):
        mixed.fit_mixed_model(df, "y", {"one": F.lit(1)}, {"g": ("g", F.lit(1))}, max_sweeps=1)
    with pytest.raises(RuntimeError):
        glm.fit_absorbed(glm.stratum_cells(df, "g", "x", "y"), "g", max_steps=1)


def test_reply_model_on_the_medium_tables(spark):
    """The coefficient that the model settles on, worked out in advance."""
    import os

    from exposurelab.plans.queries.effects import reply_model
    from exposurelab.plans.queries.registry import Tables

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    fit = reply_model(Tables(spark, folder))
    assert fit.means[1] == pytest.approx(-0.0210, abs=1e-3) and fit.change < 1e-4
    assert fit is reply_model(Tables(spark, folder + "/"))
