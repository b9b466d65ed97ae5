"""Effect estimators on tables of (stratum, post, treatment, outcome).

Treatment and outcome are 0/1 columns.  Every step is a partial aggregation, so
what is shuffled is one row per group and task, not one per response.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import clip, expit, logit
from ..functions.columns import as_column
from ..functions.times import epoch_us, round_time, seconds_to_us
from .stats import pearson, pearson_test

ZERO, DROP = "zero", "drop"


def binarise(c, positive: str = "NEGATIVE") -> Column:
    """1 where the label is ``positive``; NULL counts as 0."""
    return F.coalesce(as_column(c) == positive, F.lit(False)).cast("int")


def is_after(later, earlier) -> Column:
    """1 when ``later`` lies after ``earlier``; NULL on either side gives 0."""
    return F.coalesce(epoch_us(later) > epoch_us(earlier), F.lit(False)).cast("int")


def far_enough(y_time, x_time, seconds: float) -> Column:
    """The response came more than ``seconds`` after the post."""
    gap = epoch_us(y_time) - epoch_us(x_time)
    return F.coalesce(gap > seconds_to_us(seconds), F.lit(False))


def dropped_share(df: DataFrame, y_time: str, x_time: str, seconds: float) -> DataFrame:
    """How many rows the time filter drops, as count and share."""
    flag = (~far_enough(y_time, x_time, seconds)).cast("int")
    return df.agg(F.sum(flag).cast("long").alias("n_dropped"), F.avg(flag).alias("share_dropped"))


def conditional_response(df: DataFrame, stratum: str, post: str, treatment: str, outcome: str, user: str | None = None) -> DataFrame:
    """Mean outcome per (user, stratum, post, treatment); rows without a key are left out."""
    keys = [k for k in (user, stratum, post, treatment) if k]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.avg(outcome).alias("mean"))


def backdoor_cells(cond: DataFrame, stratum: str, post: str, treatment: str, user: str | None = None) -> DataFrame:
    """Per (user, stratum): mean and variance of either arm, NULL for an empty arm.

    The variance follows the published estimator: p(1-p) per post, not divided
    by the number of responses behind p.
    """
    keys = [k for k in (user, stratum) if k]
    # The post is a key of ``cond``, so counting rows counts posts.
    n = F.count(post)
    m = F.sum("mean") / n
    v = F.sum(F.col("mean") * (1 - F.col("mean"))) / (n * n)
    arms = cond.groupBy(*keys, treatment).agg(m.alias("m"), v.alias("v"))
    pick = lambda name, x: F.max(F.when(F.col(treatment) == x, F.col(name))).alias(f"{name}{x}")
    return arms.groupBy(*keys).agg(pick("m", 0), pick("m", 1), pick("v", 0), pick("v", 1))


def backdoor_cate(
    cond: DataFrame,
    stratum: str,
    post: str,
    treatment: str,
    user: str | None = None,
    missing: str = ZERO,
) -> DataFrame:
    """Back-door adjusted effect and its band of two standard errors.

    ``missing="zero"`` counts an arm that a stratum does not have as rate 0, as
    the original study did; ``"drop"`` uses only strata with both arms.
    """
    cells = backdoor_cells(cond, stratum, post, treatment, user)
    if missing == DROP:
        cells = cells.filter(F.col("m0").isNotNull() & F.col("m1").isNotNull())
    elif missing != ZERO:
        raise ValueError(missing)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    n = F.count(F.lit(1))
    effect = F.avg(zero("m1")) - F.avg(zero("m0"))
    band = 2 * F.sqrt((F.avg(zero("v1")) + F.avg(zero("v0"))) / n)
    if user is None:
        # An arm that occurs nowhere has no effect to report.
        seen = (F.count("m0") > 0) & (F.count("m1") > 0)
        effect, band = F.when(seen, effect), F.when(seen, band)
        return cells.agg(effect.alias("ate"), band.alias("band"), n.alias("n_strata"))
    return cells.groupBy(user).agg(effect.alias("ate"), band.alias("band"), n.alias("n_strata"))


def estimate_ate(
    df: DataFrame,
    treatment: str,
    outcome: str,
    stratum: str,
    post: str,
    treatment_time: str,
    outcome_time: str,
    min_gap_seconds: float,
    user: str | None = None,
    missing: str = ZERO,
) -> DataFrame:
    """Time filter, conditional response, back-door adjustment."""
    kept = df.filter(far_enough(outcome_time, treatment_time, min_gap_seconds))
    cond = conditional_response(kept, stratum, post, treatment, outcome, user)
    return backdoor_cate(cond, stratum, post, treatment, user, missing)


def binary_response_ate(
    df: DataFrame,
    treatment: str,
    treatment_value: str,
    outcome: str,
    outcome_value: str,
    treatment_time: str,
    outcome_time: str,
    min_gap_seconds: float,
    frequency: str,
    post: str,
    missing: str = ZERO,
) -> DataFrame:
    """``estimate_ate`` for text labels, strata being the rounded post time."""
    ready = df.withColumns(
        {
            "_x": binarise(treatment, treatment_value),
            "_y": binarise(outcome, outcome_value),
            "_g": round_time(treatment_time, frequency),
        }
    )
    return estimate_ate(ready, "_x", "_y", "_g", post, treatment_time, outcome_time, min_gap_seconds, missing=missing)


def before_after_ate(
    df: DataFrame, treatment: str, post: str, user: str, after: str, outcome: str
) -> DataFrame:
    """Before/after difference per user, averaged over users, posts and labels.

    Returns the effect, its variance and its standard error.  Users with only
    one side add nothing to the means.
    """
    keys = [treatment, post, user]
    side = lambda a: F.avg(F.when(F.col(after) == a, F.col(outcome)))
    per_user = (
        df.dropna(subset=[*keys, after])
        .groupBy(*keys)
        .agg(side(0).alias("b"), side(1).alias("a"))
        .select(
            *keys,
            (F.col("a") - F.col("b")).alias("d"),
            (F.col("a") * (1 - F.col("a")) + F.col("b") * (1 - F.col("b"))).alias("v"),
        )
    )
    # The sum over no rows is 0 and 0/0 is no value, as in the original.
    spread = lambda c: F.try_divide(F.coalesce(F.sum(c), F.lit(0.0)), F.count(c) * F.count(c))
    per_post = per_user.groupBy(treatment, post).agg(F.avg("d").alias("d"), spread("v").alias("v"))
    per_label = per_post.groupBy(treatment).agg(F.avg("d").alias("d"), spread("v").alias("v"))
    of = lambda x: F.max(F.when(F.col(treatment) == x, F.col("d")))
    return per_label.agg(
        (of(1) - of(0)).alias("ate"),
        F.sum("v").alias("variance"),
        F.sqrt(F.sum("v")).alias("std_error"),
    )


def average_individual_effect(coefficients: DataFrame, intercept: str, effects: list[str]) -> DataFrame:
    """``expit(all terms) - expit(intercept)`` from a one-row coefficient frame."""
    total = F.col(intercept)
    for name in effects:
        total = total + F.col(name)
    return coefficients.select((expit(total) - expit(intercept)).alias("effect"))


def difference_in_differences(coefficients: DataFrame, intercept: str, after: str, interaction: str) -> DataFrame:
    """Two effects from the four-term model, on one row of coefficients.

    ``effect`` is the change that the label adds to the step from before to
    after.  ``printed_effect`` is the sum of four terms the original study
    printed, two of which cancel.
    """
    b0, b1, b2 = F.col(intercept), F.col(after), F.col(interaction)
    return coefficients.select(
        (expit(b0 + b1 + b2) - expit(b0 + b1)).alias("effect"),
        (expit(b0) - expit(b0 + b1 + b2)).alias("printed_effect"),
    )


def negative_score(label, score, negative: str = "NEGATIVE") -> Column:
    """Probability of the negative label from (label, score of that label)."""
    return F.when(as_column(label) == negative, as_column(score)).otherwise(1 - as_column(score))


def score_logits(df: DataFrame, pairs: dict[str, tuple[str, str]], eps: float = 1e-9) -> DataFrame:
    """Logit of the negative score for each ``name: (label, score)``."""
    return df.select(
        *[logit(clip(negative_score(label, score), eps)).alias(name) for name, (label, score) in pairs.items()]
    )


def score_association(
    df: DataFrame, label_a: str, score_a: str, label_b: str, score_b: str, test: bool = False
) -> DataFrame:
    """Pearson correlation between the logit scores of posts and responses."""
    logits = score_logits(df, {"a": (label_a, score_a), "b": (label_b, score_b)})
    return pearson_test(logits, "a", "b") if test else pearson(logits, "a", "b")
