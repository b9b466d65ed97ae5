"""Counts, checks, calendars, samples and set operations."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_column
from ..functions.times import round_time
from .stats import QUARTILES, describe, summarise


# ---- projections and filters -------------------------------------------------

def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Only the columns whose name starts with the prefix."""
    return df.select([c for c in df.columns if c.startswith(prefix)])


def date_slice(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Closed range; either end may be open."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def repost_flag(text, truncated) -> Column:
    """Text starts with the repost mark, or was cut."""
    return as_column(text).startswith("RT ") | as_column(truncated)


def fill_missing(df: DataFrame, text: Sequence[str] = (), numbers: Sequence[str] = (), marker: str = "DUMMY_VALUE") -> DataFrame:
    if text:
        df = df.fillna(marker, subset=list(text))
    if numbers:
        df = df.fillna(0, subset=list(numbers))
    return df


# ---- counts ------------------------------------------------------------------

def group_mean(df: DataFrame, by: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.avg(value).alias(name))


def distinct_count(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "n_distinct") -> DataFrame:
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count_distinct(column).alias(name)) if by else df.agg(
        F.count_distinct(column).alias(name)
    )


def group_sizes(df: DataFrame, by: Sequence[str], value: str | None = None, name: str = "n") -> DataFrame:
    """Rows per group; with ``value`` only its non-null rows count."""
    what = F.lit(1) if value is None else F.col(value)
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count(what).alias(name))


def groups_over(df: DataFrame, by: Sequence[str], threshold: int, name: str = "n_groups") -> DataFrame:
    """Number of groups with more rows than the threshold."""
    return group_sizes(df, by).filter(F.col("n") > threshold).agg(F.count(F.lit(1)).alias(name))


def count_if(df: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def value_counts(df: DataFrame, column: str, sort: bool = True) -> DataFrame:
    counts = group_sizes(df, [column])
    return counts.orderBy(F.desc("n"), column) if sort else counts


def count_of_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many groups have each size."""
    return group_sizes(df, by, name="size").groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def binned_counts(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts in ``(edge, next edge]``; the last bin has no upper end.

    Bins without rows are reported with 0; values at or below the first edge
    belong nowhere.
    """
    ends = [*edges[1:], None]
    names, tests = [], []
    for low, high in zip(edges, ends):
        test = F.col(value) > low
        if high is not None:
            test = test & (F.col(value) <= high)
        names.append(f"({low},{'inf' if high is None else high}]")
        tests.append(test)
    # One global aggregate with a column per bin, turned into rows afterwards.
    counted = df.agg(*[F.count_if(t).alias(f"b{i}") for i, t in enumerate(tests)])
    rows = F.array(
        *[F.struct(F.lit(n).alias("bin"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.bin", "r.n")


def pivot_counts(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, prefix: str = "n_") -> DataFrame:
    """Counts with one column per given value, 0 where there is none."""
    cells = [
        F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values
    ]
    return df.dropna(subset=[*rows, column]).groupBy(*rows).agg(*cells)


def id_copies(df: DataFrame, key: str, name: str = "max_copies") -> DataFrame:
    """Largest number of rows that share an id; 1 means the id is unique."""
    return group_sizes(df, [key]).agg(F.max("n").alias(name))


def member_counts(lists: DataFrame, members: str, name: str = "member") -> DataFrame:
    """How many lists each member occurs in (every occurrence counts)."""
    return (
        lists.select(F.explode(members).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    )


def list_lengths(lists: DataFrame, key: str, members: str) -> DataFrame:
    """Length per key, added up when a key's list comes in several parts."""
    return lists.groupBy(key).agg(F.sum(F.coalesce(F.size(members), F.lit(0))).cast("long").alias("n"))


def activity(df: DataFrame, user: str, time: str, post: str, unit: str = "hour") -> DataFrame:
    """Distinct posts per user and rounded time."""
    return (
        df.dropna(subset=[user, time])
        .groupBy(user, round_time(time, unit).alias("period"))
        .agg(F.count_distinct(post).alias("n_posts"))
    )


def active_users(hourly: DataFrame, user: str = "user_id") -> DataFrame:
    """Users with at least one post, per period."""
    return hourly.filter(F.col("n_posts") > 0).groupBy("period").agg(
        F.count_distinct(user).alias("n_users")
    )


def describe_dense(hourly: DataFrame, user: str, n_periods: Column) -> DataFrame:
    """Summary per user over every period, where absent periods count as 0.

    The zeros are not built: they enter as one weighted row per user.
    """
    real = hourly.select(user, F.col("n_posts").cast("double").alias("n_posts"))
    seen = real.groupBy(user, "n_posts").agg(F.count(F.lit(1)).alias("n"))
    zeros = (
        real.groupBy(user)
        .agg(F.count(F.lit(1)).alias("_seen"))
        .select(user, F.lit(0.0).alias("n_posts"), (n_periods - F.col("_seen")).cast("long").alias("n"))
        .filter(F.col("n") > 0)
    )
    return summarise(seen.unionByName(zeros), [user], "n_posts")


# ---- calendars ---------------------------------------------------------------

def daily(df: DataFrame, time: str, value: str, mean: bool = False) -> DataFrame:
    """Values of one day combined by sum (or mean)."""
    how = F.avg if mean else F.sum
    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(time).cast("timestamp").cast("date").alias("day"))
        .agg(how(value).alias("value"))
    )


# Month names on the calendar's week axis.
MONTHS = ["Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]


def calendar_grid(df: DataFrame, time: str, value: str, start=None, end=None, mean: bool = False) -> DataFrame:
    """One row per day of whole Sunday-first weeks around ``[start, end]``.

    ``week`` counts from the first Sunday, ``weekday`` is 0 on Sunday, days
    without data and days outside the range have 0.  ``tick`` names the month on
    its first day, with the year in January.
    """
    by_day = daily(df, time, value, mean)
    span = by_day.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi")).alias("s"))
    one = df.sparkSession.range(1).select(span.scalar().alias("s"))
    first = F.lit(start).cast("date") if start is not None else F.col("s.lo")
    last = F.lit(end).cast("date") if end is not None else F.col("s.hi")
    sunday = F.date_sub("first", F.dayofweek("first") - 1)
    after = F.date_add("last", 1)
    # The grid ends before the Sunday that follows the last day.
    stop = F.date_add("last", F.lit(7) - F.dayofweek("last"))
    days = (
        one.select(first.alias("first"), last.alias("last"))
        .withColumn("sunday", sunday)
        .select("first", "last", "sunday", F.explode(F.sequence("sunday", stop)).alias("day"))
    )
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("day"))
    tick = F.when(
        F.dayofmonth("day") == 1,
        F.when(F.month("day") == 1, F.concat(name, F.lit("\n"), F.year("day").cast("string"))).otherwise(name),
    )
    inside = (F.col("day") >= F.col("first")) & (F.col("day") < after)
    return days.join(by_day, "day", "left").select(
        "day",
        F.floor(F.datediff("day", "sunday") / 7).cast("long").alias("week"),
        (F.dayofweek("day") - 1).cast("long").alias("weekday"),
        F.when(inside, F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("value"),
        tick.alias("tick"),
    )


def daily_band(df: DataFrame, time: str, value: str, by: Sequence[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Mean per rounded day with a normal confidence band."""
    n, sd = F.count(value), F.stddev_samp(value)
    half = z * F.try_divide(sd, F.sqrt(n))
    return (
        df.dropna(subset=[*by, time])
        .groupBy(*by, round_time(time, "day").alias("day"))
        .agg(
            n.alias("n"),
            F.avg(value).alias("mean"),
            (F.avg(value) - half).alias("low"),
            (F.avg(value) + half).alias("high"),
        )
    )


# Draws of 16 bits that one digest holds.
DRAWS = 8
# How many of 65,536 draws a Poisson count of mean 1 leaves at k or fewer, k = 0, 1, ...
POISSON_STEPS = [int(65_536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def bootstrap_band(
    df: DataFrame, time: str, value: str, key: str, by: Sequence[str] = (), replicates: int = 200, level: float = 0.95, seed: str = ""
) -> DataFrame:
    """Mean per rounded day with a percentile bootstrap band.

    Replicate b gives each row a Poisson weight of mean 1 that depends on ``key``,
    b and ``seed`` alone, so a row never has to meet the others of its day: all
    weighted sums are one aggregate that map tasks begin, and every run and
    cluster draws the same.  A replicate without any row of a day is left out there.
    """
    keys = [*by, "day"]
    rows = df.dropna(subset=[*by, time, value]).select(
        *by, round_time(time, "day").alias("day"), F.col(value).cast("double").alias("_v"), F.col(key).cast("string").alias("_key")
    )
    blocks = -(-replicates // DRAWS)
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).withColumn(
        "_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col("_block").cast("string"), "_key"))
    )
    sums = []
    for i in range(DRAWS):
        draw = F.conv(F.substring("_hash", 4 * i + 1, 4), 16, 10).cast("int")
        weight = F.lit(0)
        for step in POISSON_STEPS:
            weight = weight + (draw >= step).cast("int")
        sums += [F.sum(weight).alias(f"_w{i}"), F.sum(weight * F.col("_v")).alias(f"_s{i}")]
    per_block = drawn.groupBy(*keys, "_block").agg(*sums, F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean"))
    means = F.array(*[
        F.when(F.col("_block") * DRAWS + i < replicates, F.try_divide(F.col(f"_s{i}"), F.col(f"_w{i}"))) for i in range(DRAWS)
    ])
    spread = per_block.select(*keys, "_n", F.when(F.col("_block") == 0, F.col("_mean")).alias("_mean"), F.explode(means).alias("_m"))
    tail = (1 - level) / 2
    return spread.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"),
        F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"),
    )


# ---- profile -----------------------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns, with the column list and types."""
    listing = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(listing).alias("columns"),
    )


def value_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``: every distinct value of every column as text, nulls included.

    One scan; map tasks count before anything is shuffled.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(c):
        # -0.0 and 0.0 are one value.
        signless = F.col(f"`{c}`") + F.lit(0).cast(kinds[c]) if isinstance(kinds[c], T.FractionalType) else F.col(f"`{c}`")
        return signless.cast("string").alias("value")

    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c)) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, rows, missing, distinct, extremes, most frequent value, moments and quartiles.

    All of it comes from one table of (column, value, count), which a single scan
    makes; its shuffle is read again for the quartiles.  ``top`` is the most
    frequent value, among equals the first as text.  Moments and quartiles are of
    numeric columns.  An empty table has no rows to explode and gives no profile.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if columns is None or f.name in columns}
    numeric = [c for c, k in kinds.items() if isinstance(k, T.NumericType)]
    exact = [c for c in numeric if not isinstance(kinds[c], (T.FloatType, T.DoubleType))]
    only = lambda names, kind: F.when(F.col("column").isin(names), F.expr(f"try_cast(value AS {kind})"))
    counts = value_rows(df, list(kinds))
    # Numbers are ordered as numbers, whole ones beyond the precision of doubles, too.
    order = F.struct(only(numeric, "double").alias("real"), only(exact, "decimal(38, 18)").alias("exact"), F.col("value"))
    present = F.col("value").isNotNull()
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(present, order))["value"].alias("smallest"),
        F.max(F.when(present, order))["value"].alias("largest"),
        F.min(F.when(present, F.struct((-F.col("n")).alias("less"), F.col("value")))).alias("_top"),
    )
    # The condition names the count, so that it stays behind the shuffle and both uses share it.
    real = F.when(F.col("n") > 0, only(numeric, "double"))
    reals = counts.filter(real.isNotNull()).select("column", real.alias("value"), "n")
    moments = summarise(reals, ["column"], "value").select("column", "mean", "std", *QUARTILES)
    types = F.create_map(*[F.lit(x) for c, k in kinds.items() for x in (c, k.simpleString())])
    # Both sides have a row per column.
    return facts.join(F.broadcast(moments), "column", "left").select(
        "column", types[F.col("column")].alias("type"), "n_rows", "n_missing", "smallest", "largest",
        "mean", "std", "n_distinct", F.col("_top.value").alias("top"), (-F.col("_top.less")).alias("top_n"), *QUARTILES,
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return value_counts(df, column).limit(k)


def column_quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe`` of several numeric columns in one pass over long rows."""
    long = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    ).alias("r")
    return describe(df.select(long).select("r.*"), "value", ["column"])


# ---- order, samples, sets ----------------------------------------------------

def n_smallest(df: DataFrame, value: str, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).orderBy(value, *key).limit(n)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def _draw(key: str, seed: str) -> Column:
    """A repeatable number in [0, 1) from the key's digest."""
    text = F.concat(F.lit(seed), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: str = "") -> DataFrame:
    """Rows whose key draws below the fraction; the same rows on every run."""
    return df.filter(_draw(key, seed) < fraction)


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows in random but repeatable order."""
    return df.withColumn("_draw", _draw(key, seed)).orderBy("_draw", key).limit(n).drop("_draw")


def split(df: DataFrame, key: str, test_share: float = 0.25, seed: str = "") -> DataFrame:
    """Adds ``is_test``; the split is a property of the key, not of the run."""
    return df.withColumn("is_test", _draw(key, seed) < test_share)


def fold_of(key: str, folds: int, seed: str = "fold") -> Column:
    return F.floor(_draw(key, seed) * folds).cast("int")


def tagged_union(frames: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """Rows of all frames under one another, with the name of their frame."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tolerant_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name where columns may be absent on either side."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_members(lists: DataFrame, members: str, name: str = "member") -> DataFrame:
    """All list members as one set."""
    return lists.select(F.explode(members).alias(name)).distinct()


def once_or_repeating(pairs: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct (key, member) with ``repeating``: the member occurs more than once overall."""
    counts = pairs.groupBy(member).agg((F.count(F.lit(1)) > 1).alias("repeating"))
    return pairs.select(key, member).distinct().join(counts, member)


def once_repeating_sizes(flags: DataFrame, key: str) -> DataFrame:
    return flags.groupBy(key).agg(
        F.count_if(~F.col("repeating")).alias("n_once"), F.count_if("repeating").alias("n_repeating")
    )


def set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``a`` that ``b`` does not have."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")
