"""Matching responses with the posts they answer or stand near to."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..functions.times import epoch_us, seconds_to_us
from .scan import SEGMENT_SECONDS, nearest, running_weight, step_segment


def join_source(
    responses: DataFrame, sources: DataFrame, on: str, source_id: str, how: str = "inner"
) -> DataFrame:
    """Responses with the columns of the post they answer (one row per source id).

    Both sides keep their columns, so no name may occur twice.
    """
    shared = set(responses.columns) & set(sources.columns)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}")
    return responses.join(sources, F.col(on) == F.col(source_id), how)


def distinct_marks(df: DataFrame, user: str, time: str, mark_id: str) -> DataFrame:
    """Each user's distinct (time, id) interactions, one row each.

    A row per pair rather than a list per user: a list has no bound.
    """
    return df.select(user, time, mark_id).distinct()


def asof_neighbours(
    df: DataFrame,
    user: str,
    time: str,
    is_mark: Column,
    mark_id: str,
    allow_same_time: bool = True,
    segment_seconds: float = SEGMENT_SECONDS,
) -> DataFrame:
    """Per row the last mark of the same user at or before it and the first after.

    Adds ``before_id, before_us, after_id, after_us``.  Ties in time go to the
    smallest id.  ``allow_same_time=False`` looks strictly before, so that a mark
    does not find itself.  Marks without a time are none.

    A segmented scan: the pairs are never built, a task holds one user's rows of
    ``segment_seconds``, and the nearest marks of other segments are carried over.
    """
    rows = df.filter(F.col(user).isNotNull()).withColumn("_us", epoch_us(time))
    matched = nearest(rows, [user], "_us", is_mark, mark_id, allow_same_time, seconds_to_us(segment_seconds))
    return (
        matched.withColumn("before_id", F.col("_before.id"))
        .withColumn("before_us", -F.col("_before.t"))
        .withColumn("after_id", F.col("_after.id"))
        .withColumn("after_us", F.col("_after.t"))
        .drop("_us", "_before", "_after")
    )


def near_marks(matched: DataFrame, time: str, seconds: float = 3600) -> DataFrame:
    """Rows of ``asof_neighbours`` with a neighbour less than ``seconds`` away."""
    us, limit = epoch_us(time), seconds_to_us(seconds)
    near = (us - F.col("before_us") < limit) | (F.col("after_us") - us < limit)
    return matched.filter(F.coalesce(near, F.lit(False)))


def neighbour_pairs(matched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (post, neighbouring mark), tagged ``before`` or ``after``."""
    sides = F.array(
        F.struct(F.lit("before").alias("side"), F.col("before_id").alias("mark_id")),
        F.struct(F.lit("after").alias("side"), F.col("after_id").alias("mark_id")),
    )
    return (
        matched.select(*columns, F.explode(sides).alias("_pair"))
        .select(*columns, "_pair.side", "_pair.mark_id")
        .filter(F.col("mark_id").isNotNull())
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_id: str,
    left_time: str,
    right_time: str,
    seconds: float,
) -> DataFrame:
    """Join on the id, keeping pairs less than ``seconds`` apart."""
    gap = F.abs(epoch_us(left_time) - epoch_us(right_time))
    return join_source(left, right, on, right_id).filter(gap < seconds_to_us(seconds))


def range_join(
    posts: DataFrame,
    marks: DataFrame,
    post_key: str,
    mark_key: str,
    post_time: str,
    mark_time: str,
    seconds: float,
) -> DataFrame:
    """All (post, mark) pairs of one key less than ``seconds`` apart, ends open.

    Time is cut into buckets as wide as the reach, so a mark has partners in its
    own and the two adjoining buckets only.  The join is then an equi-join on
    (key, bucket), which adaptive execution splits when a bucket is hot.
    """
    width = seconds_to_us(seconds)
    shared = set(posts.columns) & set(marks.columns)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}")
    home = F.floor(epoch_us(mark_time) / F.lit(width))
    left = posts.withColumn("_pb", F.floor(epoch_us(post_time) / F.lit(width)))
    right = marks.withColumn("_mb", F.explode(F.array(home - 1, home, home + 1)))
    gap = F.abs(epoch_us(post_time) - epoch_us(mark_time))
    return left.join(
        right, (F.col(post_key) == F.col(mark_key)) & (F.col("_pb") == F.col("_mb")) & (gap < width)
    ).drop("_pb", "_mb")


def counts_around(
    posts: DataFrame,
    marks: DataFrame,
    user: str,
    time: str,
    seconds: float,
    segment_seconds: float = SEGMENT_SECONDS,
) -> DataFrame:
    """Per (user, moment) the number of posts, and of marks less than ``seconds`` away.

    Both sides name their user and time alike.  No pair is built: a mark adds one
    when its reach begins and takes it back when it ends, and a running sum over
    the moments gives the number of marks in reach.
    """
    width = seconds_to_us(seconds)
    us, one, none = epoch_us(time), F.lit(1).cast("long"), F.lit(0).cast("long")
    begin = F.struct((us - (width - 1)).alias("us"), one.alias("change"))
    end = F.struct((us + width).alias("us"), (-one).alias("change"))
    reach = marks.select(user, F.explode(F.array(begin, end)).alias("_d")).select(
        user, F.col("_d.us").alias("us"), F.col("_d.change").alias("change"), none.alias("n_posts")
    )
    stays = posts.select(user, us.alias("us"), none.alias("change"), one.alias("n_posts"))
    moments = (
        stays.unionByName(reach)
        .dropna(subset=[user, "us"])
        .groupBy(user, "us")
        .agg(F.sum("change").alias("change"), F.sum("n_posts").alias("n_posts"))
    )
    return (
        running_weight(moments, [user], "us", "change", step_segment(F.col("us"), seconds_to_us(segment_seconds)))
        .filter("n_posts > 0")
        .select(user, "us", "n_posts", F.col("running").alias("n_marks"))
    )


def keep_users(df: DataFrame, user: str, label: str, post: str) -> DataFrame:
    """Rows of users who met more than one label and more than one post."""
    several = (F.col("_lo") < F.col("_hi")) & (F.col("_first") < F.col("_last"))
    users = (
        df.filter(F.col(user).isNotNull())
        .groupBy(user)
        .agg(
            F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.min(post).alias("_first"), F.max(post).alias("_last")
        )
        .filter(several)
        .select(user)
    )
    return df.join(users, user, "left_semi")


def keep_both_sides(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Rows whose key group has more than one value of ``side``."""
    both = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.min(side).alias("_lo"), F.max(side).alias("_hi"))
        .filter(F.col("_lo") < F.col("_hi"))
        .select(*keys)
    )
    return df.join(both, list(keys), "left_semi")


def align_left(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left")


def align_outer(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Columns of both sides next to each other, ids of either side kept."""
    return left.join(right, on, "full")


def strict_lookup(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner lookup that raises when it runs and a key is missing from the table.

    The check is part of the joined rows: each side is read once, and nothing runs while
    the plan is built.  Null keys are missing, too.
    """
    found = table.withColumn("_found", F.lit(True))
    joined = keys.join(found, on, "left")
    missing = F.raise_error(F.concat(F.lit(f"no match for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    # A filter on a nondeterministic error is neither folded nor dropped with unused columns.
    checked = joined.filter(F.when(F.col("_found").isNull(), missing.cast("boolean")).otherwise(F.lit(True)))
    return checked.drop("_found")


def missing_keys(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Distinct keys of ``df`` that the table does not have."""
    wanted = df.select(F.col(key).alias(table_key)).dropna().distinct()
    return wanted.join(table.select(table_key), table_key, "left_anti")


def with_reference_count(
    posts: DataFrame, post_id: str, references: DataFrame, reference_id: str, name: str = "n_references"
) -> DataFrame:
    """Posts with the number of rows that point at them, 0 when there are none."""
    counts = references.groupBy(F.col(reference_id).alias(post_id)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        posts.join(counts, post_id, "left")
        .withColumn(name, F.coalesce("_n", F.lit(0)).cast("long"))
        .drop("_n")
    )


def around(df: DataFrame, time: str, center, seconds: float) -> DataFrame:
    """Rows strictly less than ``seconds`` away from one moment."""
    gap = F.abs(epoch_us(time) - epoch_us(as_column(center)))
    return df.filter(gap < seconds_to_us(seconds))
