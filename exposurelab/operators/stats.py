"""Exact quantiles, summaries, histograms, distributions and correlations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import student_p
from .scan import running_weight

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def value_weights(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per key with their number of rows."""
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )


def _order_statistic(value: str, position: Column) -> Column:
    """The value at a zero-based position, from running weights."""
    holds = (F.col("running") - F.col("n") <= position) & (position < F.col("running"))
    return F.max(F.when(holds, F.col(value)))


def _quantile(value: str, share: float) -> Column:
    """Linear interpolation between the two neighbouring order statistics."""
    place = (F.col("total") - 1) * F.lit(share)
    low = _order_statistic(value, F.floor(place))
    high = _order_statistic(value, F.ceil(place))
    part = F.max(place - F.floor(place))
    return low + (high - low) * part


def summarise(
    weights: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float] | None = None, segment: Column | None = None
) -> DataFrame:
    """count, mean, std, min, quantiles and max from a ``value, n`` table."""
    quantiles = QUARTILES if quantiles is None else quantiles
    ranked = running_weight(weights, keys, value, "n", segment)
    mean = F.col("total_sum") / F.col("total")
    squares = F.sum(F.col("n") * (F.col(value) - mean) * (F.col(value) - mean))
    count = F.sum("n")
    return ranked.groupBy(*keys).agg(
        count.cast("long").alias("count"),
        F.max(mean).alias("mean"),
        F.sqrt(F.try_divide(squares, count - 1)).alias("std"),
        F.min(value).alias("min"),
        *[_quantile(value, share).alias(name) for name, share in quantiles.items()],
        F.max(value).alias("max"),
    )


def describe(
    df: DataFrame, value: str, by: Sequence[str] = (), quantiles: dict[str, float] | None = None, segment: Column | None = None
) -> DataFrame:
    """Summary of a numeric column, overall or per key, with exact quantiles.

    Values are collapsed to (value, count) first; ranks come from segmented
    running sums, so that no task sees a whole hot group.  ``segment`` is a monotone function of the value.
    """
    real = df.withColumn(value, F.col(value).cast("double"))
    return summarise(value_weights(real, list(by), value), list(by), value, quantiles, segment)


def ecdf(df: DataFrame, value: str, by: Sequence[str] = (), segment: Column | None = None) -> DataFrame:
    """Distinct values with their average rank divided by the number of rows."""
    keys = list(by)
    ranked = running_weight(value_weights(df, keys, value), keys, value, "n", segment)
    rank = F.col("running") - F.col("n") + (F.col("n") + 1) / 2
    return ranked.select(*keys, value, "n", (rank / F.col("total")).alias("ratio"))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    by: Sequence[str] = (),
    low: float | None = None,
    high: float | None = None,
    density: bool = False,
) -> DataFrame:
    """Equal-width histogram; the last bin includes its right edge.

    The range is that of the whole column when it is not given.  Empty bins are
    left out.  ``density`` adds the height that makes the area one (per key).
    """
    keys = list(by)
    v = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    if low is None or high is None:
        edge = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("e")).scalar()
        rows = rows.withColumn("_e", edge)
        lo = F.col("_e.lo") if low is None else F.lit(float(low))
        hi = F.col("_e.hi") if high is None else F.lit(float(high))
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    # A single value gets a bin range of one around it.
    flat = lo == hi
    lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    width = (hi - lo) / F.lit(bins)
    rows = rows.withColumn("_lo", lo).withColumn("_w", width).filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
    number = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    counted = rows.groupBy(*keys, number.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w")
    )
    left = (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge")
    if not density:
        return counted.select(*keys, "bin", left, "n")
    if keys:
        totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        counted = counted.join(totals, keys)
    else:
        counted = counted.withColumn("_total", rows.agg(F.count(F.lit(1))).scalar())
    height = F.col("n") / (F.col("_total") * F.col("_w"))
    return counted.select(*keys, "bin", left, "n", height.alias("density"))


def grid_counts(df: DataFrame, x: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts on an equal-width grid over two columns (data of a pair plot)."""
    keys = list(by)
    ends = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]
    edges = df.agg(F.struct(*ends).alias("e")).scalar()
    rows = df.dropna(subset=[x, y]).withColumn("_e", edges)

    def number(c):
        lo, hi = F.col(f"_e.lo_{c}"), F.col(f"_e.hi_{c}")
        place = F.try_divide((F.col(c).cast("double") - lo) * bins, hi - lo)
        return F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1)).cast("long")

    return rows.groupBy(*keys, number(x).alias("bin_x"), number(y).alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, number of pairs and t statistic."""
    pairs = df.dropna(subset=[x, y])
    r, n = F.corr(x, y), F.count(F.lit(1))
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
    return pairs.groupBy(*by).agg(r.alias("r"), n.alias("n"), t.alias("t"))


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``pearson`` with the two-sided p value, overall or per key."""
    return pearson(df, x, y, by).withColumn("p_value", student_p("t", F.col("n") - 2))


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Columns minus their mean over their sample standard deviation."""
    parts = [s for c in columns for s in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    moments = df.agg(F.struct(*parts).alias("m")).scalar()
    rows = df.withColumn("_m", moments)
    scaled = {
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_m.m_{c}"), F.col(f"_m.s_{c}")) for c in columns
    }
    return rows.withColumns(scaled).drop("_m")
