"""Multinomial naive Bayes, its grid search and the evaluation of predictions.

``counts`` tables have one row per (document, term) with the occurrences ``n``
and the document's label.  Document-term rows meet the counts of their term in the task that
has all of its rows (``termcount``); no table of terms leaves the cluster.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .termcount import Cells, Known, Settings, hits, known_terms, log_sums, place


def _argmax(scores: Sequence[Column], classes: Sequence) -> Column:
    """The class with the largest score; the first one on a tie."""
    best, name = scores[0], F.lit(classes[0])
    for score, label in zip(scores[1:], classes[1:]):
        name = F.when(score > best, F.lit(label)).otherwise(name)
        best = F.greatest(best, score)
    return name


def _log(value: Column) -> Column:
    """The logarithm, minus infinity at zero (where Spark has null)."""
    return F.when(value > 0, F.log(value)).otherwise(F.lit(float("-inf")))


# Fixed value: smaller smoothing counts as this, so that unseen words keep a finite score.
LEAST_ALPHA = 1e-10


def _of(label: str, c, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col(label) == c, value)), F.lit(0))


def term_table(counts: DataFrame, label: str, classes: Sequence, n: str = "n", by: Sequence[str] = ("term",)) -> DataFrame:
    """One row per term with its occurrences in each class (``c0, c1, ...``)."""
    return counts.groupBy(*by).agg(
        *[_of(label, c, F.col(n)).alias(f"c{i}") for i, c in enumerate(classes)]
    )


def count_terms(
    counts: DataFrame,
    key: str,
    label: str,
    classes: Sequence,
    fold: str = "fold",
    folds: int = 5,
    is_test: str = "is_test",
    partitions: int | None = None,
    rounds: int = 1,
) -> Known:
    """Terms counted once for the grid search and for the test documents of the setting it finds."""
    cells = Cells(folds, len(classes))
    cell = cells.cell(label, classes, fold, range(folds), F.col(is_test))
    return known_terms(counts.filter(F.col(is_test).isNotNull()), key, cell, cells, partitions, rounds)


def naive_bayes(
    docs: DataFrame,
    counts: DataFrame | Known,
    key: str,
    label: str,
    classes: Sequence,
    is_test: str = "is_test",
    alpha: float = 1.0,
    fit_prior: bool = True,
    sizes: tuple[int, int] = (0, 255),
    partitions: int | None = None,
    rounds: int = 1,
) -> DataFrame:
    """Predicted class and scores of the test documents.

    ``docs`` has one row per document with ``label`` and ``is_test``; ``counts``
    carries both columns too, or is what ``count_terms`` made of it, of which n-grams of the ``sizes`` are taken.
    Terms that no training document has are ignored.
    A class without training documents scores minus infinity with a fitted prior.
    Terms travel as 88 bits of hash, in as many ``rounds`` one after the other, and are counted when this is called.
    """
    k, alpha = len(classes), max(alpha, LEAST_ALPHA)
    if not isinstance(counts, Known):
        cells = Cells(0, k)
        cell = cells.cell(label, classes, held=F.col(is_test))
        counts = known_terms(counts.filter(F.col(is_test).isNotNull()), key, cell, cells, partitions, rounds)
    low, high = sizes
    words = [sum(int(w[:, i].sum()) for size, w in counts.words.items() if low <= size <= high) for i in range(k)]
    vocabulary = sum(int(v[-1]) for size, v in counts.vocabulary.items() if low <= size <= high)
    by_class = [F.count_if(F.col(label) == c).alias(f"d{i}") for i, c in enumerate(classes)]
    priors = docs.filter(~F.col(is_test)).agg(F.struct(*by_class).alias("p")).scalar()
    sums = log_sums(counts, key, k, alpha, low, high)
    rows = docs.filter(F.col(is_test)).join(sums, key, "left").withColumn("_p", priors)
    seen = sum((F.col(f"_p.d{i}") for i in range(k)), F.lit(0))
    scores = []
    for i in range(k):
        score = F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) - F.coalesce(F.col("_n"), F.lit(0)) * F.log(
            F.lit(words[i]) + F.lit(alpha) * F.lit(vocabulary)
        )
        prior = _log(F.try_divide(f"_p.d{i}", seen)) if fit_prior else F.lit(0.0)
        scores.append(score + prior)
    named = rows.withColumns({f"score_{i}": s for i, s in enumerate(scores)})
    cols = [F.col(f"score_{i}") for i in range(k)]
    return named.withColumn("predicted", _argmax(cols, classes)).select(
        key, label, "predicted", *[f"score_{i}" for i in range(k)]
    )


def naive_bayes_grid(
    docs: DataFrame,
    counts: DataFrame | Known,
    key: str,
    label: str,
    classes: Sequence,
    ranges: Sequence[tuple[int, int]],
    alphas: Sequence[float],
    fold: str = "fold",
    folds: int = 5,
    partitions: int | None = None,
    rounds: int = 1,
) -> DataFrame:
    """Mean cross-validated accuracy of every (n-gram range, alpha, prior) setting.

    ``counts`` carries ``label``, ``fold`` and the n-gram ``size``, or is the listed form of
    ``ngram_occurrences``, or what ``count_terms`` made of either.  All settings come from one count: the training counts of a fold are the total minus the
    fold's own; the score of an n-gram range is the sum of the scores of its
    sizes.  Rows of ``counts`` may repeat a term.  Terms travel as 88 bits of hash, in ``partitions``
    partitions (Spark's number by default) that are dealt over ``rounds`` one after the other, and are counted when
    this is called; a document's known terms meet again before its sums are made.
    """
    k = len(classes)
    smoothing = [max(float(a), LEAST_ALPHA) for a in alphas]
    known = counts
    if not isinstance(known, Known):
        cells = Cells(folds, k)
        known = known_terms(counts, key, cells.cell(label, classes, fold, range(folds)), cells, partitions, rounds)
    # Ranges without any n-gram have no settings.
    tried = [(lo, hi) for lo, hi in ranges if any(lo <= size <= hi and v[-1] for size, v in known.vocabulary.items())]
    within = lambda values, lo, hi: sum(v for size, v in values.items() if lo <= size <= hi)
    words = [within(known.words, lo, hi)[:, :k] for lo, hi in tried]
    sizes = np.zeros((folds + 1, k))
    for r in docs.groupBy(place(fold, range(folds)).alias("_fold")).agg(
        *[F.count_if(F.col(label) == c).alias(f"d{i}") for i, c in enumerate(classes)]
    ).collect():
        sizes[r["_fold"]] = [r[f"d{i}"] for i in range(k)]
    others = sizes.sum(0) - sizes[:folds]
    with np.errstate(divide="ignore", invalid="ignore"):
        priors = np.log(others / others.sum(1, keepdims=True))
    settings = Settings(
        tried, smoothing,
        np.array([w.sum(0) - w[:folds] for w in words]).reshape(len(tried), folds, k),
        np.array([within(known.vocabulary, lo, hi)[:folds] for lo, hi in tried]).reshape(len(tried), folds),
        np.where(np.isnan(priors), -np.inf, priors),
    )
    places = docs.select(
        key, F.when(F.col(label).isNull(), F.lit(-1)).otherwise(place(label, classes)).alias("_class"),
        place(fold, range(folds)).alias("_fold"),
    )
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.get(F.array(*[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in tried or ranges]), F.col("range"))
    return (
        hits(known, places, key, settings, parts)
        .withColumn("accuracy", F.try_divide("_hits", "_rows"))
        .groupBy("range", "alpha_index", "fit_prior")
        .agg(F.avg("accuracy").alias("mean_accuracy"))
        .withColumn("_r", span)
        .select(
            "_r.low", "_r.high", "alpha_index", F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("alpha_index")).alias("alpha"),
            "fit_prior", "mean_accuracy",
        )
    )


def best_setting(grid: DataFrame) -> DataFrame:
    """The setting with the best mean accuracy; ties go to the first in order."""
    score = F.round("mean_accuracy", 9)
    return grid.orderBy(score.desc(), "low", "high", "alpha_index", F.desc("fit_prior")).limit(1)


def confusion(predictions: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Counts for every (actual, predicted) pair of the given labels, 0 included."""
    grid = (
        predictions.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(actual))
        .select(actual, F.explode(F.array(*[F.lit(x) for x in labels])).alias(predicted))
    )
    counts = predictions.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [actual, predicted], "left").fillna(0, ["n"])


def accuracy(predictions: DataFrame, actual: str, predicted: str, name: str = "accuracy") -> DataFrame:
    return predictions.agg(F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias(name))
