"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each later model also sees the
probabilities of the earlier ones.  In training those come from models that did not
see the row (out-of-fold), so that the later models learn how far to trust them.

Features are words and word beginnings that are present.  Which ones matter is
counted in the tasks; the driver fits small dense models on a bounded sample of
labelled rows, and scoring is one pass over the texts.
"""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows, quoted, remove, store

SAMPLE = 8_192
FEATURES = 512
FOLDS = 5
PREFIXES = (4, 6)
Z_LEAST = 4.0
# Toxic texts are about a tenth, so the penalty keeps a single insult below one half.
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def presence(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES])


class Chain:
    """Fitted categories in order: their features, weights and biases."""

    def __init__(self, models: list[tuple[str, list[str], np.ndarray, float]]):
        self.models = models
        self.names = [m[0] for m in models]
        self.wanted = set().union(*[m[1] for m in models]) if models else set()
        self.words = frozenset(f for f in self.wanted if not f.endswith("*"))
        self.starts = {n: frozenset(f for f in self.wanted if f.endswith("*") and len(f) == n + 1) for n in PREFIXES}
        self.weights = [dict(zip(m[1], m[2][: len(m[1])].tolist())) for m in models]
        self.links = [m[2][len(m[1]) :].tolist() for m in models]

    def predict(self, text: str) -> list[float]:
        words = set(WORD.findall(text.lower()))
        found = set(words & self.words)
        for n, known in self.starts.items():
            found |= {w[:n] + "*" for w in words if len(w) > n} & known
        made: list[float] = []
        for (_, _, _, bias), weights, links in zip(self.models, self.weights, self.links):
            z = bias + sum(sorted(weights[f] for f in found if f in weights))
            z += sum(w * logit(p) for w, p in zip(links, made))
            made.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return made


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    features: int = FEATURES,
    folds: int = FOLDS,
) -> Chain:
    """Fit the chain on about ``sample`` labelled rows, twice as many where ids repeat.

    ``labels`` has the id and a 0/1 column for each category, in the order of the
    chain; null labels are left out of their category and equal label rows count once.  The sample is drawn by a
    hash of the id; rows with the same id and text are one.  Without any labelled row of both classes a category predicts
    its share of ones (one half without labels).
    """
    known = labels.select(quoted(id_col).alias("_label_id"), *[quoted(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)])
    known = known.filter("_label_id is not null").distinct()
    total = known.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    drawn = known.filter(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 30)) < share)
    text = id_and_text(docs, id_col, text_col).withColumn("_text", F.xxhash64("text"))
    # The sample is bounded by its parameter, so it can go to every task.
    drawn = drawn.withColumnRenamed("_label_id", "id")
    # An id may have many rows: equal ones count once, and of more than twice the sample a part is drawn.
    pairs = text.select("id", "_text").join(F.broadcast(drawn.select("id").distinct()), "id").distinct()
    pairs, pairs_path = store(pairs, "toxicity-pairs")
    part = int(min(1.0, 2 * sample / max(pairs.count(), 1)) * (1 << 30))
    pairs = pairs.filter(F.pmod(F.xxhash64("_text", "id"), F.lit(1 << 30)) < part)
    rows = text.join(F.broadcast(pairs), ["id", "_text"]).dropDuplicates(["id", "_text"]).drop("_text")
    rows, rows_path = store(rows.join(F.broadcast(drawn), "id"), "toxicity-sample")
    ys = [f"_y{i}" for i in range(len(categories))]

    def count(part):
        totals = Counter()
        for _, words, *y in part:
            for f in presence(words):
                totals[f] += 1
                for i, value in enumerate(y):
                    if value == 1:
                        totals[f, i] += 1
        return [(f, n, [totals[f, i] for i in range(len(ys))]) for f, n in totals.items() if isinstance(f, str)]

    parts = map_rows(rows.select("id", "text", *ys), count, "feature string, n long, ones array<long>")
    sums = [F.sum(F.col("ones")[i]).alias(f"_y{i}") for i in range(len(ys))]
    counts = parts.groupBy("feature").agg(F.sum("n").alias("n"), *sums).filter("n >= 3")
    shares = rows.agg(F.count(F.lit(1)), *[F.sum((F.col(y) == 1).cast("long")) for y in ys]).first()
    n_rows = max(shares[0], 1)
    chosen = []
    for i in range(len(ys)):
        p = (shares[1 + i] or 0) / n_rows
        spread = F.sqrt(F.col("n") * max(p * (1 - p), 1e-9))
        z = F.abs((F.col(f"_y{i}") - F.col("n") * p) / spread)
        top = counts.withColumn("z", z).filter(F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "feature").limit(features)
        chosen.append([r[0] for r in top.select("feature").collect()])

    index = {f: j for j, f in enumerate(sorted(set().union(*chosen)))} if chosen else {}

    def mark(part):
        return [(i, sorted(index[f] for f in presence(words) if f in index), list(y)) for i, words, *y in part]

    kind = docs.schema[id_col].dataType.simpleString()
    marked = map_rows(rows.select("id", "text", *ys), mark, f"id {kind}, found array<int>, y array<int>").collect()
    remove(docs.sparkSession, pairs_path, rows_path)
    marked.sort(key=lambda r: (r[0], r[1]))
    x = np.zeros((len(marked), len(index)), np.float32)
    for k, r in enumerate(marked):
        x[k, r[1]] = 1
    y = np.array([[-1 if v is None else v for v in r[2]] for r in marked]).reshape(len(marked), len(ys))
    return fit_chain(x, y, index, chosen, categories, folds)


def fit_chain(x, y, index, chosen, categories, folds: int) -> Chain:
    """The models of the chain; ``y`` is -1 where a label is missing."""
    fold = np.arange(len(x)) % folds
    earlier = np.zeros((len(x), 0), np.float32)
    models = []
    for i, name in enumerate(categories):
        columns = [index[f] for f in chosen[i]]
        inputs = np.concatenate([x[:, columns], earlier], axis=1)
        has = y[:, i] >= 0
        out = np.zeros(len(x))
        for k in range(folds):
            seen, held = has & (fold != k), fold == k
            w, b = fit_logistic(inputs[seen], y[seen, i])
            out[held] = 1 / (1 + np.exp(-np.clip(inputs[held] @ w + b, -40, 40)))
        w, b = fit_logistic(inputs[has], y[has, i])
        models.append((name, chosen[i], w, b))
        p = np.clip(out, 1e-4, 1 - 1e-4)
        earlier = np.concatenate([earlier, np.log(p / (1 - p))[:, None].astype(np.float32)], axis=1)
    return Chain(models)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by Newton steps until they stop."""
    n, d = x.shape
    ones = int(y.sum()) if n else 0
    if ones in (0, n):
        p = (ones + 0.5) / (n + 1)
        return np.zeros(d), math.log(p / (1 - p))
    inputs = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1).astype(np.float64)
    ridge = np.full(d + 1, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(d + 1)

    def loss(w):
        z = inputs @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -40, 40)))
        slope = inputs.T @ (p - y) + ridge * w
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        new = loss(w)
        if abs(now - new) <= 1e-8 * max(1.0, abs(now)):
            break
        now = new
    else:
        raise RuntimeError(f"no convergence in {steps} steps")
    return w[:-1], float(w[-1])


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``p_<category>`` for every document; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"p_{c} double" for c in chain.names)

    def run(rows):
        return [(i, *chain.predict(t)) for i, t in rows]

    return map_rows(id_and_text(docs, id_col, text_col), run, f"id {kind}, {columns}")


def non_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose probability of ``category`` is below the threshold, all columns.

    A filter on one Arrow column, so rows stay where they are.
    """
    place = chain.names.index(category)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([chain.predict(t or "")[place] for t in texts])

    return docs.filter(probability(quoted(text_col)) < threshold)
