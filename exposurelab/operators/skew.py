"""Lookups in tables that are small beside the rows, however frequent some keys are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.sinks import materialize

# Lookup tables: the longest one that is broadcast, and the frequent keys of longer ones.
BROADCAST_ROWS = 500_000
FREQUENT_ROWS = 200_000
# Frequent keys are chosen by one text in so many; a key that is missed is joined like the rare ones.
FREQUENT_SHARE = 16


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: str,
    spread_by: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows to a lookup table that is small beside them, such as a word list.

    A table of at most ``broadcast_rows`` rows (counted, up to that bound) goes
    to every executor.  Of a longer one the rows of frequent keys do.
    """
    if fits_broadcast(table, broadcast_rows):
        return left.join(F.broadcast(table), on, how)
    return split_join(left, table, on, spread_by, how, min(broadcast_rows, FREQUENT_ROWS))


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """The table has at most ``rows`` rows; counting stops beyond that."""
    return table.limit(rows + 1).count() <= rows


def lookup(rows: DataFrame) -> DataFrame:
    """Narrow rows that are broadcast up to a bound, so that no text is shuffled to meet them."""
    return F.broadcast(rows) if fits_broadcast(rows) else rows


def split_join(
    left: DataFrame, table: DataFrame, on: str, spread_by: str, how: str = "inner", rows: int = FREQUENT_ROWS
) -> DataFrame:
    """Inner or left join: rows of the ``rows`` most frequent keys meet the table where they lie, the others by a shuffle.

    Which keys are frequent is looked up in the rows of one ``spread_by`` in ``FREQUENT_SHARE``;
    it decides the way of a row and not its result.
    """
    columns = [c for c in table.columns if c != on]
    some = left.filter(F.col(on).isNotNull() & (F.pmod(F.xxhash64(spread_by), F.lit(FREQUENT_SHARE)) == 0))
    top = some.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), on).limit(rows).select(on)
    known = top.join(table.withColumn("_found", F.lit(True)), on, "left")
    known = materialize(known, scratch_path(left.sparkSession, "frequent"))
    # Read twice, so that neither reader's columns take the name of the other's.
    keys = known.select(F.col(on).alias("_key")).distinct()
    near = left.join(F.broadcast(known), on)
    if how == "inner":
        near = near.filter("_found")
    rare = left.join(F.broadcast(keys), F.col(on) == F.col("_key"), "left_anti")
    far = rare.join(table, on, how)
    names = [on, *[c for c in left.columns if c != on], *columns]
    return near.select(*names).unionByName(far.select(*names))


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, and those of keys with several; null is a key like any."""
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(F.col(key).alias("_key"))
    several = materialize(several, scratch_path(df.sparkSession, "repeated"))
    # Where few keys repeat, or none, no row moves.
    several = F.broadcast(several) if fits_broadcast(several) else several
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(several, same, "left_anti"), df.join(several, same, "left_semi")
