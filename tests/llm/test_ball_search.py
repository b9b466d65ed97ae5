import math
import random

import numpy as np
import pytest

from exposurelab.llm import ball_search as bs
from exposurelab.llm.common import terms_of

from .helpers import no_docs, odd_docs

ITEMS = "item_id long, text string"


def slowly(docs, items, k=10):
    """Every document scored for every item, as the contract says."""
    counts = [(key, terms_of((text or "").encode())) for key, text in docs]
    n_docs = sum(bool(w) for _, w in counts)
    n_terms = sum(len(w) for _, w in counts)
    frequency = {}
    for _, words in counts:
        for w in set(words):
            frequency[w] = frequency.get(w, 0) + 1
    made = []
    for key, text in items:
        scores = []
        for doc, words in counts:
            score = 0
            for term in terms_of((text or "").encode()):
                tf = words.count(term)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[term] + 1)))
                    score += weight * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * len(words) * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        made += [(key, rank, doc, -score) for rank, (score, _, doc) in enumerate(scores[:k], 1)]
    return sorted(made, key=repr)


def found(rows):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()], key=repr)


def corpus(n, seed, vocabulary=60, longest=40):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(2000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(longest)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7)])
def test_against_scoring_everything(spark, seed, parts):
    docs, items = corpus(700, seed)
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    made = bs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, ITEMS))
    assert found(made) == slowly(docs, items)


def test_blocks_of_items_change_nothing(spark):
    docs, items = corpus(200, 3)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert len(list(bs.item_blocks(frames[1], "item_id", "text", 30))) > 3
    assert found(bs.search(*frames, cells=30, results=4)) == slowly(docs, items, 4)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    docs, size = 2000, 50
    sizes = rng.integers(1, 12, docs)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Two topics, so that subtrees differ.
    terms = np.concatenate([np.sort(rng.choice(25, s, replace=False)) + 25 * (i % 2) for i, s in enumerate(sizes)])
    vectors = bs.Vectors(starts, terms, rng.integers(1, 10**6, starts[-1]))
    queries = np.zeros((8, size), np.int64)
    for q in range(8):
        queries[q, rng.choice(25, 5, replace=False) + 25 * (q % 2)] = rng.integers(1, 9000, 5)
    tree = bs.BallTree(vectors, queries.astype(float), leaf=16)
    assert sorted(tree.order) == list(range(docs))
    scores = np.array([[int(s) for s in tree.vectors.dot(q)] for q in queries])
    for level, edges in enumerate(tree.edges):
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            assert (tree.bounds[(1 << level) - 1 + i] >= scores[:, a:b].max(axis=1)).all()
    visited = []

    class Seen(bs.Vectors):
        def part(self, first, end):
            visited.append(end - first)
            return super().part(first, end)

    tree.vectors = Seen(*tree.vectors)
    for q in range(8):
        best = bs.Best(10)
        tree.search(q, queries[q], list(range(docs)), best)
        assert [-s for s, _, _ in best.found] == sorted(scores[q].tolist(), reverse=True)[:10]
    assert sum(visited) < 8 * docs * 0.6


def test_ties_by_id(spark):
    docs = [(i, "same words here") for i in (9, 3, 7, 1, 5)] + [(None, "same words here"), (2, "other")]
    made = bs.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, "SAME")], ITEMS), results=6)
    assert [r["doc_id"] for r in made.orderBy("rank").collect()] == [1, 3, 5, 7, 9, None]


def test_odd_documents(spark):
    items = [(1, "Text some été"), (2, None), (None, "word"), (3, "absent"), (1, "id")]
    docs = odd_docs(spark)
    made = bs.search(docs, spark.createDataFrame(items, ITEMS))
    assert found(made) == slowly([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert bs.search(no_docs(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert bs.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    strings = spark.createDataFrame([("b", "x y"), ("a", "x")], "doc_id string, text string")
    assert [r["doc_id"] for r in bs.search(strings, spark.createDataFrame([(1, "x")], ITEMS)).collect()] == ["a", "b"]
