"""A text scorer that is trained here and scores in the JVM.

Words are hashed into a fixed number of buckets; a logistic regression on their
shares of the text is fitted by Spark ML, whose gradients are summed in a tree.  The
weights are a small table that can be stored, and scoring is a column expression.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.columns import as_column
from ..functions.links import expit
from ..sources.sinks import materialize

BUCKETS = 4_096
INTERCEPT = -1  # bucket of the intercept in a stored table


def word_buckets(text, buckets: int = BUCKETS) -> Column:
    """The bucket of every word, by digest: the same on every machine and in SQL."""
    return F.transform(
        F.coalesce(tk.words(text), F.array().cast("array<string>")),
        lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(buckets),
    )


@dataclass(frozen=True)
class HashedScorer:
    """Logit of the negative label: intercept plus the mean weight of a text's words."""

    weights: tuple[float, ...]
    intercept: float = 0.0

    def logit(self, text) -> Column:
        # One literal that is folded once, however many buckets there are.
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        picked = F.transform(word_buckets(text, len(self.weights)), lambda b: F.get(table, b.cast("int")))
        total = F.aggregate(picked, F.lit(0.0), lambda s, w: s + w)
        return F.lit(self.intercept) + F.coalesce(F.try_divide(total, F.size(picked).cast("double")), F.lit(0.0))

    def probability(self, text) -> Column:
        return expit(self.logit(text))

    def __call__(self, text) -> Column:
        """``label`` and how sure it is; null and empty texts have the intercept alone."""
        p = self.probability(text)
        negative = p >= 0.5
        return F.struct(
            F.when(negative, "NEGATIVE").otherwise("POSITIVE").alias("label"), F.when(negative, p).otherwise(1 - p).alias("score")
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(INTERCEPT, float(self.intercept)), *enumerate(map(float, self.weights))]
        return spark.createDataFrame(rows, "bucket int, weight double")

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> "HashedScorer":
        return read_scorer(materialize(self.table(spark), path, overwrite))


def read_scorer(table: DataFrame, buckets: int | None = None) -> HashedScorer:
    """A scorer from ``bucket, weight``; buckets without a row weigh nothing.

    The table has at most one row per bucket, so its size is set by their number.
    """
    rows = {r["bucket"]: r["weight"] for r in table.select("bucket", "weight").collect()}
    size = max(rows, default=0) + 1 if buckets is None else buckets
    if size < 1 or any(b != INTERCEPT and not 0 <= b < size for b in rows):
        raise ValueError("no table of bucket weights")
    return HashedScorer(tuple(rows.get(b, 0.0) for b in range(size)), rows.get(INTERCEPT, 0.0))


def load_scorer(spark: SparkSession, path: str) -> HashedScorer:
    return read_scorer(spark.read.parquet(path))


def train_scorer(
    df: DataFrame, text: str, is_negative, buckets: int = BUCKETS, regularisation: float = 1e-4, max_steps: int = 200
) -> HashedScorer:
    """Fit a scorer to labelled texts; rows with a null label are left out.

    Raises RuntimeError if the fit does not settle in ``max_steps``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, Normalizer

    label = as_column(is_negative).cast("double")
    rows = df.select(word_buckets(text, buckets).cast("array<string>").alias("buckets"), label.alias("label")).dropna(subset=["label"])
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], "buckets", "counts")
    features = Normalizer(inputCol="counts", outputCol="features", p=1.0).transform(counter.transform(rows))
    fit = LogisticRegression(family="binomial", maxIter=max_steps, regParam=regularisation, aggregationDepth=2).fit(
        features.select("label", "features")
    )
    if fit.summary.totalIterations >= max_steps:
        raise RuntimeError(f"no convergence in {max_steps} steps")
    return HashedScorer(tuple(map(float, fit.coefficients.toArray())), float(fit.intercept))


def keyword_scorer(negative: Sequence[str], positive: Sequence[str]):
    """A scorer without training: the label with more keywords wins, ties are positive."""

    def score(text) -> Column:
        words = F.coalesce(tk.words(text), F.array().cast("array<string>"))
        count = lambda listed: F.size(F.filter(words, lambda w: w.isin(list(listed)))).cast("double")
        bad, good = count(negative), count(positive)
        worse = bad > good
        share = (1 + F.when(worse, bad).otherwise(good)) / (2 + bad + good)
        return F.struct(F.when(worse, "NEGATIVE").otherwise("POSITIVE").alias("label"), share.alias("score"))

    return score
