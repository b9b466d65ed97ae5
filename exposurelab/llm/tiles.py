"""Comparing all rows of some tiles with all rows of others, without pair rows.

A tile is a bounded array of rows.  Pairs of tiles are joined and compared in
numpy; what leaves a comparison is one row per linked member, tied to the first
member of its group, so the output never grows with the square of a group.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parts_for(counts: DataFrame, rows_per_tile: int) -> DataFrame:
    """Adds ``parts``: the number of tiles that ``n`` rows need."""
    return counts.withColumn("parts", F.ceil(F.col("n") / rows_per_tile).cast("int"))


def part_pairs(pairs: DataFrame, same: str) -> DataFrame:
    """Explode ``parts_a`` x ``parts_b`` into ``part_a, part_b``.

    Where ``same`` holds, the two sides are one bucket and each pair counts once.
    """
    made = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    first = F.when(F.expr(same), F.col("part_a")).otherwise(F.lit(0))
    return made.withColumn("part_b", F.explode(F.sequence(first, F.col("parts_b") - 1)))


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the groups of ``i`` and ``j``; labels point to the smallest member."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels = shorter
    return labels
