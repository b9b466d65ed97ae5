"""A fitted text classifier that can be stored: stems, terms and class sizes as tables.

Fitting tokenizes, stems by table, drops stop words and counts n-grams per class.  The
tables and a manifest with the settings are written once, the manifest last; prediction
reads them and needs nothing else.
"""

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..sources.sinks import has_success, materialize
from .classify import LEAST_ALPHA, _argmax, _log, term_table
from .skew import lookup
from .text import ngram_occurrences, stemmed_texts

VERSION = 1


@dataclass(frozen=True)
class Settings:
    classes: tuple
    stop_words: tuple[str, ...] = ()
    low: int = 1
    high: int = 1
    alpha: float = 1.0
    fit_prior: bool = True


@dataclass(frozen=True)
class TextModel:
    settings: Settings
    stems: DataFrame
    terms: DataFrame  # term, c0, c1, ...
    words: tuple[int, ...]  # occurrences of all terms per class
    documents: tuple[int, ...]
    vocabulary: int


def prepared(df: DataFrame, key: str, text: str, stems: DataFrame | None, stop_words: Sequence[str]) -> DataFrame:
    """``key, tokens``: stemmed tokens without stop words; texts without any token have no row."""
    tokens = stemmed_texts(df, key, text, stems)
    return tokens.withColumn("tokens", tk.drop_words("tokens", list(stop_words)))


def fit_text_model(
    df: DataFrame, key: str, text: str, label: str, settings: Settings, path: str, stems: DataFrame | None = None,
    tokens: DataFrame | None = None,
) -> TextModel:
    """Fit to labelled texts (``key`` unique) and store below ``path``; a model there is an error.

    ``tokens`` is what ``prepared`` made of these texts or more with the same stems and stop words, if it is stored already.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    if has_success(df, f"{path}/manifest"):
        raise FileExistsError(f"a model lies at {path}")
    none = spark.createDataFrame([], "token string, stem string")
    kept_stems = materialize(none if stems is None else stems.select("token", "stem"), f"{path}/stems", overwrite=True)
    labelled = df.dropna(subset=[key, label])
    if tokens is None:
        tokens = prepared(labelled, key, text, kept_stems, settings.stop_words)
    tokens = tokens.select(key, "tokens").join(lookup(labelled.select(key, label)), key)
    counts = ngram_occurrences(tokens, key, "tokens", settings.low, settings.high, keep=[label])
    terms = materialize(term_table(counts, label, settings.classes), f"{path}/terms", overwrite=True)
    k = len(settings.classes)
    sums = terms.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"n{i}") for i in range(k)]).first()
    sizes = labelled.agg(*[F.count_if(F.col(label) == c).alias(f"d{i}") for i, c in enumerate(settings.classes)]).first()
    manifest = {
        "version": VERSION, **asdict(settings), "vocabulary": sums["v"],
        "words": [sums[f"n{i}"] for i in range(k)], "documents": [sizes[f"d{i}"] for i in range(k)],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").write.mode("overwrite").parquet(f"{path}/manifest")
    return load_text_model(spark, path)


def load_text_model(spark: SparkSession, path: str) -> TextModel:
    """A stored model; one without a manifest was never finished and raises FileNotFoundError."""
    path = path.rstrip("/")
    if not has_success(spark.range(0), f"{path}/manifest"):
        raise FileNotFoundError(f"no finished model at {path}")
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
    if manifest["version"] != VERSION:
        raise ValueError(f"model of version {manifest['version']}, this is {VERSION}")
    named = {f: manifest[f] for f in Settings.__dataclass_fields__}
    named["classes"], named["stop_words"] = tuple(named["classes"]), tuple(named["stop_words"])
    return TextModel(
        Settings(**named), spark.read.parquet(f"{path}/stems"), spark.read.parquet(f"{path}/terms"),
        tuple(manifest["words"]), tuple(manifest["documents"]), manifest["vocabulary"],
    )


def predict(model: TextModel, df: DataFrame, key: str, text: str, tokens: DataFrame | None = None) -> DataFrame:
    """``key, predicted, score_0, ...`` of every text; those without a known term score the priors.

    ``tokens`` is as in ``fit_text_model``.  Terms meet the model's as two 64-bit hashes.
    """
    s, k = model.settings, len(model.settings.classes)
    alpha = max(s.alpha, LEAST_ALPHA)
    if tokens is None:
        tokens = prepared(df, key, text, model.stems, s.stop_words)
    else:
        tokens = tokens.select(key, "tokens").join(lookup(df.select(key).distinct()), key, "left_semi")
    hashes = [F.xxhash64("term").alias("term_a"), F.xxhash64(F.lit(1), "term").alias("term_b")]
    terms = model.terms.filter(F.col("term").isNotNull()).select(*hashes, *[f"c{i}" for i in range(k)])
    known = ngram_occurrences(tokens, key, "tokens", s.low, s.high).select(key, "n", *hashes).join(terms, ["term_a", "term_b"])
    sums = known.groupBy(key).agg(
        F.sum("n").alias("_n"), *[F.sum(F.col("n") * F.log(F.col(f"c{i}") + F.lit(alpha))).alias(f"_s{i}") for i in range(k)]
    )
    rows = df.select(key).join(sums, key, "left").fillna(0)
    total = sum(model.documents)
    for i in range(k):
        score = F.col(f"_s{i}") - F.col("_n") * F.log(F.lit(float(model.words[i])) + F.lit(alpha * model.vocabulary))
        prior = _log(F.lit(model.documents[i] / total if total else 0.0)) if s.fit_prior else F.lit(0.0)
        rows = rows.withColumn(f"score_{i}", F.when(F.col("_n") > 0, score).otherwise(F.lit(0.0)) + prior)
    scores = [F.col(f"score_{i}") for i in range(k)]
    return rows.withColumn("predicted", _argmax(scores, s.classes)).select(key, "predicted", *scores)
