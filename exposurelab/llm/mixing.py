"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the budget over its size.
Each document draws its count from a Poisson distribution of that mean, inverted at
a number hashed from its id and a seed, so a draw never depends on order, partitions
or reruns.  Documents are exploded by their counts and dealt out by another hash.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from .common import quoted, shuffle_partitions

SEED = "mix"
TEMPERATURE = 0.7
# A larger mean is the sum of parts, each inverted at a hash of its own.
PART_MEAN = 16.0
TERMS = 96
HEX = 13  # digits of a digest: 52 bits


def rates(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    weights: Mapping[str, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
) -> DataFrame:
    """``source, size, rate`` per source; a null source is one of its own.

    A document's size is its code points plus one for its end mark.  ``weights``
    are target weights by source (those not named get none); without them a
    source's weight is its size to the power ``temperature``.  The budget is
    ``epochs`` times the whole size, so that rates average ``epochs`` by size.
    """
    size = F.length(F.coalesce(quoted(text_col), F.lit(""))) + 1
    sizes = docs.groupBy(quoted(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        named = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        table = F.create_map(*named) if named else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("source").cast("string")), F.lit(0.0))
    weighted = sizes.withColumn("weight", weight)
    all_size, all_weight = (weighted.agg(F.sum(c)).scalar() for c in ("size", "weight"))
    share = F.try_divide(F.col("weight"), all_weight)
    return weighted.select(
        "source", "size",
        F.coalesce(share * F.lit(float(epochs)) * all_size / F.col("size"), F.lit(0.0)).alias("rate"),
    )


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) hashed from the parts."""
    return (number(*parts).cast("double") + 0.5) / float(1 << 4 * HEX)


def number(*parts: Column) -> Column:
    """52 bits hashed from the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("long")


def distribution(mean: Column) -> Column:
    """P(X <= k), k = 0, 1, ..., of a Poisson variable with a mean of PART_MEAN at most.

    After TERMS terms what is missing is below the spacing of the hashed numbers.
    """
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(state, k):
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), F.array_append(state["all"], state["sum"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["all"])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Mapping[str, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """Documents repeated to the target mix, in shuffled order.

    All columns of ``docs`` and ``copy`` (0, 1, ...), ``rate`` (its source's mean)
    and ``shuffle_key``; input columns of these names give way.  Partitions and the
    rows inside them are ordered by ``shuffle_key``, so files written from the
    result are globally shuffled.  Rows with the same id draw the same count; all
    rows with a null id share one draw; a null text has size one; an empty table
    gives no rows.  A source without weight disappears, which is the feature.
    """
    table = rates(docs, source_col, text_col, weights, temperature, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    table = table.withColumn("_parts", parts).select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
        F.col("rate").alias("_rate"), "_parts", distribution(F.col("rate") / F.col("_parts")).alias("_cdf"),
    ).withColumn("_key", F.struct("_none", "_source")).drop("_none", "_source")
    own = [c for c in docs.columns if c.lower() not in ("copy", "rate", "shuffle_key")]
    rows = docs.select(
        F.struct(*[quoted(c) for c in own]).alias("_row"), quoted(id_col).alias("_id"),
        F.struct(
            quoted(source_col).isNull().alias("_none"),
            F.coalesce(quoted(source_col).cast("string"), F.lit("")).alias("_source"),
        ).alias("_key"),
    )
    joined = lookup_join(rows, table, "_key", "_id")
    drawn = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda j: F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(seed), F.col("_id"), j))),
    )
    count = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("_count", count).filter("_count > 0").select(
        "_row", "_id", "_rate", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy")
    )
    keyed = copies.withColumn("shuffle_key", number(F.lit(seed), F.lit("order"), F.col("_id"), F.col("copy")))
    # The keys are uniform, so equal ranges are equal loads and nothing needs sampling.
    n = shuffle_partitions(docs.sparkSession)
    place = F.floor(F.col("shuffle_key") / F.lit(float(1 << 4 * HEX)) * n).cast("int")
    return (
        keyed.repartitionById(n, F.least(place, F.lit(n - 1)))
        .sortWithinPartitions("shuffle_key", "_id", "copy")
        .select(
            *[F.col("_row").getField(c).alias(c) for c in own],
            "copy", F.col("_rate").alias("rate"), "shuffle_key",
        )
    )
