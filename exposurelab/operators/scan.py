"""Segmented scans: running sums, numbers and nearest rows without a task per key.

A window over a key puts the key's rows into one task.  Here the axis along which a
key is scanned is cut into segments by a monotone function of the value, so that equal
values share a segment and segments follow the order.  Each (key, segment) is
scanned by itself; one summary row per (key, segment) is scanned along the key, and
what the segments before (or behind) hold is joined back.  The cut depends on the
value alone: nothing is counted or sampled while a plan is built, there is one path
for all keys, and any segmentation gives the same rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Segments of a value axis: values that differ by less than a 4,096th part may share one.
RESOLUTION = 4_096
# Segments of a time axis.
SEGMENT_SECONDS = 86_400.0

SEGMENT = "_segment"


def value_segment(value: Column, resolution: float = RESOLUTION) -> Column:
    """A whole number that never falls as the value rises: even steps near 0, even ratios further out."""
    real = value.cast("double")
    return F.floor(F.signum(real) * F.log1p(F.abs(real)) * F.lit(float(resolution)))


def step_segment(value: Column, step: int) -> Column:
    """Segments of ``step`` on an axis of whole numbers."""
    return F.floor(value / F.lit(step))


def text_segment(value: Column, length: int = 2) -> Column:
    """Texts by their first characters."""
    return F.substring(value.cast("string"), 1, length)


def _named(keys: Sequence[str]) -> list[str]:
    return [f"_at_{i}" for i in range(len(keys))]


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their (key, segment); null keys and segments match themselves."""
    columns = [*keys, SEGMENT]
    other = summary.withColumnsRenamed(dict(zip(columns, _named(columns))))
    same = [rows[c].eqNullSafe(other[o]) for c, o in zip(columns, _named(columns))]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return rows.join(other, condition).drop(*_named(columns))


def running_weight(df: DataFrame, keys: Sequence[str], value: str, weight: str, segment: Column | None = None) -> DataFrame:
    """Cumulative weight along ``value`` inside each key, with the key's totals.

    Adds ``running`` (weight of this and all smaller values), ``total`` and
    ``total_sum`` (weight times value).  ``value`` is a number, unique per key.
    ``segment`` is a monotone function of it.
    """
    keys = list(keys)
    cut = df.withColumn("_product", F.col(weight) * F.col(value)).withColumn(
        SEGMENT, value_segment(F.col(value)) if segment is None else segment
    )
    along = Window.partitionBy(*keys, SEGMENT).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("running", F.sum(weight).over(along)).drop("_product")
    sums = cut.groupBy(*keys, SEGMENT).agg(F.sum(weight).alias("_w"), F.sum("_product").alias("_ws"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, SEGMENT,
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset"),
        F.sum("_w").over(whole).alias("total"),
        F.sum("_ws").over(whole).alias("total_sum"),
    )
    return (
        join_summary(rows, offsets, keys)
        .withColumn("running", F.col("running") + F.col("_offset"))
        .drop(SEGMENT, "_offset")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: str, segment: Column, name: str) -> DataFrame:
    """Number of each row along ``order`` inside its key, from 1; ``order`` is unique per key."""
    keys = list(keys)
    rows = df.withColumn(SEGMENT, segment)
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(order)
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, SEGMENT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    made = join_summary(rows.withColumn(name, F.row_number().over(inside)), offsets, keys)
    return made.withColumn(name, F.col(name) + F.col("_offset")).drop(SEGMENT, "_offset")


def nearest(
    df: DataFrame, keys: Sequence[str], position: str, is_mark: Column, mark_id: str,
    allow_same: bool = True, step: int = 1,
) -> DataFrame:
    """Adds ``_before`` and ``_after``, structs of ``t`` and ``id``: the last mark up to a row and the first behind it.

    ``position`` is a whole number; ``step`` the length of a segment.  Of marks at one
    place the smallest id counts.  Rows and marks without a position match nothing.
    ``t`` of ``_before`` is negated.
    """
    keys = list(keys)
    placed = F.col(position).isNotNull()
    rows = df.withColumn(SEGMENT, step_segment(F.col(position), step))
    rows = rows.withColumn("_past", F.when(is_mark & placed, F.struct((-F.col(position)).alias("t"), F.col(mark_id).alias("id"))))
    rows = rows.withColumn("_coming", F.when(is_mark & placed, F.struct(F.col(position).alias("t"), F.col(mark_id).alias("id"))))
    inside = Window.partitionBy(*keys, SEGMENT)
    # Both frames start at the unbounded end, which Spark evaluates in one pass.
    upward = inside.orderBy(position).rangeBetween(Window.unboundedPreceding, 0 if allow_same else -1)
    downward = inside.orderBy(F.desc(position)).rangeBetween(Window.unboundedPreceding, -1)
    matched = rows.withColumn("_before", F.min("_past").over(upward)).withColumn("_after", F.min("_coming").over(downward))
    ends = rows.groupBy(*keys, SEGMENT).agg(F.min("_past").alias("_p"), F.min("_coming").alias("_c"))
    up = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SEGMENT, F.min("_p").over(up).alias("_carry_p"), F.min("_c").over(down).alias("_carry_c"))
    found = join_summary(matched, carried, keys)
    return (
        found.withColumn("_before", F.when(placed, F.coalesce("_before", "_carry_p")))
        .withColumn("_after", F.when(placed, F.coalesce("_after", "_carry_c")))
        .drop("_past", "_coming", "_carry_p", "_carry_c", SEGMENT)
    )
