"""Connected components by alternating stars, in DataFrame joins only.

Every round replaces the edges by stars around the smallest neighbour, once over
all neighbours and once over the smaller ones.  Only minimums per node are
gathered, never lists of neighbours, so a node with very many edges costs a
partially aggregated minimum and a join that adaptive execution can split (which it
does for joins of stored tables).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge between two nodes.

    ``component`` is the smallest node that can be reached.  Nodes may be of any
    ordered type.  Edges with a null end and loops add nothing; repeated edges
    and either direction count once; without edges the result is empty.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    current = ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    table, path = store(current, "edges")
    before = _mark(table)
    while before[0]:
        lowest, lowest_path = store(_lowest_neighbours(table), "lowest")
        following, new_path = store(_small_star(_large_star(table, lowest)), "edges")
        remove(spark, path, lowest_path)
        table, path = following, new_path
        after = _mark(table)
        if after == before:
            break
        before = after
    roots = table.select("lo").distinct()
    return table.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )


def _lowest_neighbours(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, or the node itself if that is smaller."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    return both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))


def _large_star(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its smallest neighbour (or itself)."""
    larger = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    return larger.join(lowest, "node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    lowest = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums of digests, to see whether a round changed any."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("hi", "lo"), 20)), F.lit(0)),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("lo", "hi"), 20)), F.lit(0)),
    ).first()
    return tuple(row)
