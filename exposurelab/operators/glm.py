"""Stratified binary regression: dense for few strata, absorbed for any number."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import clip, expit, normal_cdf, normal_pdf, normal_quantile
from ..session import cut_lineage, scratch_path
from ..sources.sinks import materialize
from .stats import zscores

PROBIT, LOGIT = "probit", "logit"


def stratum_cells(df: DataFrame, stratum: str, treatment: str, outcome: str) -> DataFrame:
    """One row per stratum with rows and successes of either arm."""
    arm = lambda x, what, name: F.coalesce(F.sum(F.when(F.col(treatment) == x, what)), F.lit(0)).cast("double").alias(name)
    return (
        df.dropna(subset=[stratum, treatment, outcome])
        .groupBy(stratum)
        .agg(
            arm(0, F.lit(1), "n0"), arm(0, F.col(outcome), "k0"),
            arm(1, F.lit(1), "n1"), arm(1, F.col(outcome), "k1"),
        )
    )


def _mean_and_slope(eta: Column, link: str) -> tuple[Column, Column]:
    if link == PROBIT:
        return clip(normal_cdf(eta)), normal_pdf(eta)
    mu = clip(expit(eta))
    return mu, mu * (1 - mu)


def _score_and_weight(n: Column, k: Column, eta: Column, link: str) -> tuple[Column, Column]:
    mu, slope = _mean_and_slope(eta, link)
    spread = mu * (1 - mu)
    return slope * (k - n * mu) / spread, n * slope * slope / spread


def fit_absorbed(cells: DataFrame, stratum: str, link: str = PROBIT, max_steps: int = 100, tolerance: float = 1e-8) -> tuple[DataFrame, float]:
    """Fisher scoring with one intercept per stratum, however many there are.

    The intercepts are a column of the stratum table and are eliminated row by
    row; only the sums for the one shared coefficient reach the driver.  A
    stratum whose outcomes are all equal has its intercept at infinity and says
    nothing about the coefficient, so it is left out of the steps.  Raises
    RuntimeError if the coefficient still moves after ``max_steps``, and
    ValueError if the strata separate it, so that no finite value is the best.
    """
    mixed = (F.col("k0") + F.col("k1") > 0) & (F.col("k0") + F.col("k1") < F.col("n0") + F.col("n1"))
    base = materialize(cells, scratch_path(cells.sparkSession, "cells"))
    _refuse_separation(base.filter(mixed))
    # Start from the stratum's smoothed rate.
    rate = (F.col("k0") + F.col("k1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    start = normal_quantile(rate) if link == PROBIT else F.log(rate / (1 - rate))
    state = cut_lineage(base.filter(mixed).withColumn("a", start))
    beta = 0.0
    for step in range(max_steps):
        s0, w0 = _score_and_weight(F.col("n0"), F.col("k0"), F.col("a"), link)
        s1, w1 = _score_and_weight(F.col("n1"), F.col("k1"), F.col("a") + F.lit(beta), link)
        parts = state.select("*", s0.alias("s0"), w0.alias("w0"), s1.alias("s1"), w1.alias("w1")).withColumn(
            "w", F.col("w0") + F.col("w1")
        )
        parts = cut_lineage(parts) if step % 4 == 3 else parts
        sums = parts.agg(
            F.sum(F.col("s1") - F.col("w1") * (F.col("s0") + F.col("s1")) / F.col("w")).alias("top"),
            F.sum(F.col("w1") - F.col("w1") * F.col("w1") / F.col("w")).alias("bottom"),
        ).first()
        if not sums["bottom"]:
            break
        change = sums["top"] / sums["bottom"]
        change = max(-2.0, min(2.0, change))
        move = (F.col("s0") + F.col("s1") - F.col("w1") * change) / F.col("w")
        bounded = F.greatest(F.least(move, F.lit(2.0)), F.lit(-2.0))
        state = parts.withColumn("a", F.col("a") + bounded).drop("s0", "w0", "s1", "w1", "w")
        beta += change
        if abs(change) < tolerance:
            break
    else:
        raise RuntimeError(f"no convergence in {max_steps} steps; the last one moved by {change:.2g}")
    fitted = base.join(state.select(stratum, "a"), stratum, "left")
    return fitted, beta


def _refuse_separation(cells: DataFrame) -> None:
    """A larger coefficient always fits better where each stratum has failures only
    without treatment or successes only with it; a smaller one in the mirrored case."""
    both = cells.filter((F.col("n0") > 0) & (F.col("n1") > 0))
    seen = both.agg(
        F.every((F.col("k0") == 0) | (F.col("k1") == F.col("n1"))).alias("up"),
        F.every((F.col("k0") == F.col("n0")) | (F.col("k1") == 0)).alias("down"),
    ).first()
    if seen["up"] or seen["down"]:
        raise ValueError("the strata separate the outcomes by treatment: the coefficient has no finite estimate")


def fitted_arms(fitted: DataFrame, beta: float, link: str) -> DataFrame:
    """Fitted means ``m0, m1`` of the arms a stratum has, their slopes ``d0, d1`` and weights ``w0, w1``.

    In a stratum whose outcomes are all equal the means are that outcome and do
    not move with the coefficients, so slopes and weights are 0.
    """
    constant = F.when(F.col("k0") + F.col("k1") > 0, 1.0).otherwise(0.0)
    columns = {}
    for arm, eta in (("0", F.col("a")), ("1", F.col("a") + F.lit(beta))):
        mu, slope = _mean_and_slope(eta, link)
        n, still = F.col(f"n{arm}"), F.col("a").isNull()
        columns[f"m{arm}"] = F.when(n > 0, F.when(still, constant).otherwise(mu))
        columns[f"d{arm}"] = F.when(still | (n == 0), 0.0).otherwise(slope)
        columns[f"w{arm}"] = F.when(still, 0.0).otherwise(n * slope * slope / (mu * (1 - mu)))
    return fitted.withColumns(columns)


def glm_margins(df: DataFrame, stratum: str, treatment: str, outcome: str, link: str = LOGIT) -> DataFrame:
    """Observed and fitted successes per stratum, and of all treated rows (stratum null).

    A logit fit reproduces every one of these sums; that is what makes it the best fit.
    """
    fitted, beta = fit_absorbed(stratum_cells(df, stratum, treatment, outcome), stratum, link)
    arms = fitted_arms(fitted, beta, link)
    part = lambda arm: F.coalesce(F.col(f"n{arm}") * F.col(f"m{arm}"), F.lit(0.0))
    by_stratum = arms.select(
        stratum, (F.col("k0") + F.col("k1")).alias("observed"), (part("0") + part("1")).alias("fitted")
    )
    treated = arms.agg(F.sum("k1").alias("observed"), F.sum(part("1")).alias("fitted"))
    return by_stratum.unionByName(treated, allowMissingColumns=True)


def glm_ate(df: DataFrame, stratum: str, treatment: str, outcome: str, link: str = PROBIT, missing: str = "zero") -> DataFrame:
    """Mean over strata of the difference between fitted arm means, with standard errors.

    ``missing="zero"`` counts an arm that a stratum does not have as 0.
    ``coefficient_se`` comes from the Schur complement of the intercepts in the
    Fisher information, ``ate_se`` from the delta method over all coefficients;
    both are sums over the strata.  ``n_constant`` strata hold equal outcomes
    only and are fitted exactly.  Without a stratum that tells the arms apart the
    coefficient is 0 and the errors are null.
    """
    fitted, beta = fit_absorbed(stratum_cells(df, stratum, treatment, outcome), stratum, link)
    arms = fitted_arms(fitted, beta, link)
    counted = (F.col("n0") > 0) & (F.col("n1") > 0) if missing == "drop" else F.lit(True)
    w, w1 = F.col("w0") + F.col("w1"), F.col("w1")
    pull = F.when(counted, F.col("d1") - F.col("d0")).otherwise(0.0)
    lean = F.when(counted, F.col("d1")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = arms.agg(
        F.avg(F.when(counted, zero("m1") - zero("m0"))).alias("ate"),
        F.count_if(counted).alias("n_strata"),
        F.count_if(F.col("a").isNull()).alias("n_constant"),
        F.sum(w1 - F.coalesce(F.try_divide(w1 * w1, w), F.lit(0.0))).alias("_information"),
        F.sum(F.try_divide(pull * pull, w)).alias("_own"),
        (F.sum(lean) - F.coalesce(F.sum(F.try_divide(pull * w1, w)), F.lit(0.0))).alias("_shared"),
    )
    # Where no stratum tells the arms apart, rounding may leave a trace of information.
    information = F.when(F.col("_information") > 1e-12, F.col("_information"))
    variance = F.col("_own") + F.col("_shared") * F.col("_shared") / information
    return sums.select(
        "ate",
        (F.sqrt(variance) / F.col("n_strata")).alias("ate_se"),
        F.lit(beta).alias("coefficient"),
        F.sqrt(1 / information).alias("coefficient_se"),
        "n_strata",
        "n_constant",
    )


def dense_glm(df: DataFrame, stratum: str, treatment: str, outcome: str, link: str = PROBIT):
    """The same model with a dummy per stratum; Spark ML allows 4,096 columns."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    ready = df.select(
        F.col(outcome).cast("double").alias("y"),
        F.col(treatment).cast("double").alias("x"),
        F.col(stratum).cast("string").alias("g"),
    ).dropna()
    shaped = RFormula(formula="y ~ x + g", featuresCol="features", labelCol="label").fit(ready).transform(ready)
    return GeneralizedLinearRegression(family="binomial", link=link, maxIter=50, tol=1e-10).fit(shaped)


def covariate_glm(df: DataFrame, label: str, covariates: Sequence[str], link: str = LOGIT) -> DataFrame:
    """Binary regression of a label on standardised covariates, as a coefficient table."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    names = [f"{c}_norm" for c in covariates]
    # A constant covariate has no z-score and no influence.
    ready = zscores(df.dropna(subset=[label, *covariates]), covariates).fillna(0.0, names)
    shaped = VectorAssembler(inputCols=names, outputCol="features").transform(ready).select(
        F.col(label).cast("double").alias("label"), "features"
    )
    model = GeneralizedLinearRegression(family="binomial", link=link, tol=1e-10, maxIter=50).fit(shaped)
    s = model.summary
    values = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    try:
        errors = [s.coefficientStandardErrors, s.tValues, s.pValues]
    except Exception as missing:
        # Covariates that depend on one another leave no standard errors.
        if "No Std. Error" not in str(missing):
            raise
        errors = [[None] * len(values)] * 3
    return df.sparkSession.createDataFrame(
        list(zip([*names, "intercept"], values, *errors)),
        "term string, coefficient double, std_error double, z double, p_value double",
    )


def covariate_margins(df: DataFrame, label: str, covariates: Sequence[str], link: str = LOGIT) -> DataFrame:
    """Observed and fitted sums of label times standardised covariate, per term; equal under a logit fit."""
    names = [f"{c}_norm" for c in covariates]
    table = {r["term"]: r["coefficient"] for r in covariate_glm(df, label, covariates, link).collect()}
    ready = zscores(df.dropna(subset=[label, *covariates]), covariates).fillna(0.0, names)
    eta = F.lit(table["intercept"])
    for name in names:
        eta = eta + F.lit(table[name]) * F.col(name)
    mu, _ = _mean_and_slope(eta, link)
    rows = ready.select(F.col(label).cast("double").alias("_y"), mu.alias("_mu"), F.lit(1.0).alias("intercept"), *names)
    terms = [*names, "intercept"]
    sums = rows.agg(
        *[F.struct(F.sum(F.col("_y") * F.col(c)).alias("observed"), F.sum(F.col("_mu") * F.col(c)).alias("fitted")).alias(c) for c in terms]
    )
    listed = F.array(*[F.struct(F.lit(c).alias("term"), F.col(f"{c}.observed"), F.col(f"{c}.fitted")) for c in terms])
    return sums.select(F.inline(listed))
