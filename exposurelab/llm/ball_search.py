"""Exact ranked search by inner products over sparse ball trees.

A document's vector holds, for the terms that queries use, its integer weight of each
term; a query's vector holds the rarity of its terms.  Every task builds ball trees over
its documents: each node knows the centroid of its documents and how far they lie from it.
Search takes nodes best-first and stops where no bound reaches the weakest result so far;
bounds are rounded up.  Leaves are scored in integers, so that the results are exact.
"""

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, quoted, store, terms_of, to_batch

RESULTS = 10
LEAF = 64
BLOCK = 8_192  # documents of one tree
CELLS = 1 << 22  # items times terms of the queries that are searched for at once

# Relative error that bounds allow for; sums of 2 ** 20 rounded terms stay below it.
SLACK = 1e-9


class Items(NamedTuple):
    """Queries that are searched for together: ids, and the count of each term in each of them."""

    ids: list
    terms: dict[bytes, int]
    counts: list[dict[int, int]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, cells: int = CELLS) -> Iterator[Items]:
    """The items in blocks whose table of items and terms has at most ``cells`` fields.

    Only one block is on the driver at a time.  Items without terms find nothing and are left out.
    """
    rows = items.select(quoted(id_col), F.coalesce(quoted(text_col), F.lit("")).cast("binary"))
    block = Items([], {}, [])
    for key, text in rows.toLocalIterator():
        words = terms_of(bytes(text))
        if not words:
            continue
        fresh = len(set(words) - block.terms.keys())
        if block.ids and (len(block.ids) + 1) * (len(block.terms) + fresh) > cells:
            yield block
            block = Items([], {}, [])
        found: dict[int, int] = {}
        for word in words:
            term = block.terms.setdefault(word, len(block.terms))
            found[term] = found.get(term, 0) + 1
        block.ids.append(key)
        block.counts.append(found)
    if block.ids:
        yield block


def term_table(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, counts``: all terms of a document counted, and those of the queries one by one."""
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))

    def run(part):
        made = []
        for key, text in part:
            words = terms_of(text)
            found: dict[int, int] = {}
            for word in words:
                term = terms.get(word)
                if term is not None:
                    found[term] = found.get(term, 0) + 1
            made.append((key, len(words), list(found), list(found.values())))
        return made

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, run, f"id {kind}, n long, terms array<int>, counts array<int>")


class Vectors(NamedTuple):
    """Rows of a sparse matrix of whole numbers, none of them empty."""

    starts: np.ndarray  # one more than rows
    terms: np.ndarray
    values: np.ndarray

    def take(self, order: np.ndarray) -> "Vectors":
        sizes = np.diff(self.starts)[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(starts[-1]) + np.repeat(self.starts[:-1][order] - starts[:-1], sizes)
        return Vectors(starts, self.terms[place], self.values[place])

    def part(self, first: int, end: int) -> "Vectors":
        a, b = self.starts[first], self.starts[end]
        return Vectors(self.starts[first : end + 1] - a, self.terms[a:b], self.values[a:b])

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vector[self.terms] * self.values, self.starts[:-1])

    def sum(self, size: int) -> np.ndarray:
        return np.bincount(self.terms, self.values, size)


class BallTree:
    """Bounds of all items at all nodes, over documents in the order of the leaves.

    Node i has the children 2 i + 1 and 2 i + 2; a level halves every node of the one above.
    """

    def __init__(self, vectors: Vectors, queries: np.ndarray, leaf: int = LEAF):
        n, size = len(vectors.starts) - 1, queries.shape[1]
        self.levels = max(0, math.ceil(math.log2(max(1, n / leaf))))
        edges, order = [np.array([0, n])], np.arange(n)
        real = vectors._replace(values=vectors.values.astype(float))
        for _ in range(self.levels):
            cuts = [0]
            for a, b in zip(edges[-1], edges[-1][1:]):
                order[a:b] = order[a:b][self.along(real.take(order[a:b]), size)]
                cuts += [(a + b + 1) // 2, b]
            edges.append(np.array(cuts))
        self.order, self.edges = order, edges
        self.vectors = vectors.take(order)
        real = real.take(order)
        squares = np.add.reduceat(real.values**2, real.starts[:-1])
        norms = np.sqrt((queries**2).sum(axis=1))
        self.bounds = np.empty(((2 << self.levels) - 1, len(queries)))
        sums = highs = None
        for level in range(self.levels, -1, -1):
            ends = edges[level]
            if sums is None:
                leaves = [real.part(a, b) for a, b in zip(ends, ends[1:])]
                sums = [x.sum(size) for x in leaves]
                highs = [self.highest(x, size) for x in leaves]
            else:
                sums = [a + b for a, b in zip(sums[::2], sums[1::2])]
                highs = [np.maximum(a, b) for a, b in zip(highs[::2], highs[1::2])]
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                self.bounds[(1 << level) - 1 + i] = self.bound(real.part(a, b), squares[a:b], sums[i], highs[i], queries, norms)

    @staticmethod
    def along(vectors: Vectors, size: int) -> np.ndarray:
        """Order of the rows between two of them that lie far apart."""
        if len(vectors.starts) < 3:
            return np.arange(len(vectors.starts) - 1)
        squares = np.add.reduceat(vectors.values**2, vectors.starts[:-1])

        def dense(row):
            return vectors.part(row, row + 1).sum(size)

        mean = vectors.sum(size) / (len(vectors.starts) - 1)
        a = int(np.argmax(squares - 2 * vectors.dot(mean)))
        to_a = vectors.dot(dense(a))
        b = int(np.argmax(squares - 2 * to_a))
        return np.argsort(to_a - vectors.dot(dense(b)), kind="stable")

    @staticmethod
    def highest(vectors: Vectors, size: int) -> np.ndarray:
        found = np.zeros(size)
        np.maximum.at(found, vectors.terms, vectors.values)
        return found

    @staticmethod
    def bound(vectors, squares, total, high, queries, norms) -> np.ndarray:
        """No inner product in the node is larger: centroid plus radius, over all terms or term by term.

        Rounding errors are relative to the largest numbers that enter, so these widen the result.
        """
        if not len(squares):
            return np.zeros(len(queries))
        center = total / len(squares)
        around = center @ center
        far = squares - 2 * vectors.dot(center) + around
        radius = math.sqrt(max(0.0, far.max()) + SLACK * (squares.max() + around))
        middle = queries @ center
        return (middle + np.minimum(norms * radius, queries @ (high - center) + SLACK * middle)) * (1 + SLACK)

    def search(self, item: int, query: np.ndarray, ids: list, best: "Best") -> None:
        """Take the documents of the nodes whose bound reaches the weakest result so far."""
        waiting = [(-self.bounds[0, item], 0)]
        first_leaf = (1 << self.levels) - 1
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < best.least:
                return
            if node < first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if self.bounds[child, item] >= best.least:
                        heapq.heappush(waiting, (-self.bounds[child, item], child))
                continue
            a, b = self.edges[-1][node - first_leaf : node - first_leaf + 2]
            if a < b:
                scores = self.vectors.part(a, b).dot(query)
                for place in np.flatnonzero(scores >= best.least):
                    best.add(int(scores[place]), ids[self.order[a + place]])


class Best:
    """The highest scores so far; equal ones by id, null ids last."""

    def __init__(self, size: int):
        self.size, self.found, self.least = size, [], 1

    def add(self, score: int, key) -> None:
        if score < self.least:
            return
        self.found.append((-score, key is None, key))
        self.found.sort(key=lambda x: x[:2] if x[1] else x)
        del self.found[self.size :]
        if len(self.found) == self.size:
            self.least = -self.found[-1][0]


def rarities(n_docs: int, frequencies: dict[int, int], size: int) -> np.ndarray:
    """Weight of each term; a term no document holds weighs something, but adds nothing."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(size)], np.int64
    )


def search_block(rows: DataFrame, block: Items, results: int) -> DataFrame:
    """``item, item_id, id, score``: each task's highest scores per item of a block."""
    spark = rows.sparkSession
    n_docs, n_terms = rows.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    # One count per term of the block.
    weights = rarities(n_docs, {r["term"]: r["count"] for r in counted.collect()}, len(block.terms))
    ids, counts = block.ids, block.counts
    kinds = f"item int, id {rows.schema['id'].dataType.simpleString()}, score long"
    schema = arrow_schema(spark, kinds)

    def vectors_of(batch):
        n, lists, tfs = (batch.column(i) for i in (1, 2, 3))
        sizes = np.diff(lists.offsets.to_numpy())
        there = np.flatnonzero(sizes)
        length = np.asarray(n.to_numpy(), np.int64)
        m = 25 + 75 * length * n_docs // (n_terms or 1)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
        starts = np.concatenate([[0], np.cumsum(sizes[there])])
        return there, Vectors(starts, lists.flatten().to_numpy(), values)

    def run(batches):
        exact = np.zeros((len(ids), len(weights)), np.int64)
        for row, found in zip(exact, counts):
            row[list(found)] = list(found.values())
        exact *= weights
        queries = exact.astype(float)
        best = [Best(results) for _ in ids]
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                there, vectors = vectors_of(batch)
                if not len(there):
                    continue
                keys = batch.column(0).take(pa.array(there)).to_pylist()
                tree = BallTree(vectors, queries)
                for item, query in enumerate(exact):
                    tree.search(item, query, keys, best[item])
        made = [(item, key, -score) for item, b in enumerate(best) for score, _, key in b.found]
        if made:
            yield to_batch(made, schema)

    return rows.mapInArrow(run, kinds)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    results: int = RESULTS,
    cells: int = CELLS,
) -> DataFrame:
    """``<item_col>, rank, <id_col>, score``: the ``results`` highest-scoring documents of each item.

    Only scores above 0 count; equal scores go by ascending id, null ids last.  Null texts
    have no terms.  Repeated documents are ranked one by one, repeated items searched for
    one by one.  Tables without rows or terms give no rows.  Items are searched for in blocks of at most
    ``cells`` (items times their terms); each block reads the documents once.
    """
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType.simpleString()
    kind = docs.schema[id_col].dataType.simpleString()
    made = spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long")
    for block in item_blocks(items, item_col, item_text_col, cells):
        rows, _ = store(term_table(docs, block.terms, id_col, text_col), "terms")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = search_block(rows, block, results).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= results)
        # Ids of the block's items, by their place in it.
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_kind}")
        found = ranked.join(F.broadcast(names), "item").select(
            F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"
        )
        made = made.unionByName(found)
    return made
