"""Scores, terms, vocabularies, id sequences and vectors of texts."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.columns import as_column, bind
from ..functions.links import expit
from .scan import numbered, text_segment
from .skew import BROADCAST_ROWS, lookup_join, split_repeated
from .stats import describe

VECTOR_ROWS = 20_000

Scorer = Callable[[pd.Series], pd.DataFrame]


def score_text(text, factory: Callable[[], Scorer], fields: str = "label string, score double") -> Column:
    """Score texts with a model that is built once per task.

    ``factory`` is called on the worker; what it returns takes a batch of texts
    and gives a frame with the columns named in ``fields``.  This is a UDF column
    and not a map over batches, so filters and column pruning pass it by.
    """

    @F.pandas_udf(fields)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            yield scorer(batch)

    return score(as_column(text))


def linear_scores(
    df: DataFrame, key: str, text: str, weights: DataFrame, names: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Independent logistic scores: the mean weight of the known words, per column of ``names``.

    ``weights`` has one row per ``token``, however many there are.  Texts without a
    known word score one half.
    """
    known = look_up_words(df, key, text, weights, "left", broadcast_rows)
    hits = F.sum(F.when(F.col(names[0]).isNotNull(), F.col("n")))
    means = known.groupBy(key).agg(*[(F.sum(F.col("n") * F.col(c)) / hits).alias(c) for c in names])
    return means.select(key, *[expit(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])


def word_counts(df: DataFrame, key: str, tokens: Column, outer: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Occurrences per (key, token).

    A text's tokens lie in one partition, so they are collapsed before the shuffle.
    """
    spread = (F.explode_outer if outer else F.explode)(tokens).alias("token")
    return df.select(key, *keep, spread).groupBy(key, *keep, "token").agg(F.count("token").alias("n"))


def look_up_words(
    df: DataFrame, key: str, text: str, table: DataFrame, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Words of the texts with the columns of ``table(token, ...)`` and a number ``n``.

    Nothing is shuffled here for the words of a short table and for the frequent
    words of a long one: they meet the table where their text lies, and the caller's
    sums per text follow at once.
    """
    explode = F.explode if how == "inner" else F.explode_outer
    rows = df.select(key, explode(tk.words(text)).alias("token")).withColumn("n", F.lit(1).cast("long"))
    return lookup_join(rows, table, "token", key, how, broadcast_rows)


def term_occurrences(df: DataFrame, key: str, terms: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``keep, term, n, first``: per term, ``n`` adds up to its occurrences and ``first`` to the (key, keep) that have it.

    A row per occurrence, made where the text lies.  Only texts that share their key with
    another are shuffled: what they have in common counts once.
    """
    once, several = split_repeated(df, key)

    def marked(listed: Column) -> Column:
        in_order = lambda arr: F.transform(
            arr, lambda w, i: F.struct(w.alias("term"), ((i == 0) | (F.get(arr, i - 1) != w)).cast("long").alias("first"))
        )
        return bind(F.sort_array(listed), in_order)

    one = F.lit(1).cast("long")
    single = once.select(*keep, F.explode(marked(terms)).alias("_t")).select(
        *keep, "_t.term", one.alias("n"), "_t.first"
    )
    shared = several.select(key, *keep, F.explode(terms).alias("term")).groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("n"))
    return single.unionByName(shared.select(*keep, "term", "n", one.alias("first")))


def polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame, name: str = "polarity", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Polarity in [-1, 1] and mean subjectivity from ``lexicon(token, valence, subjectivity)``.

    The valences of all known words are summed to ``s``; the polarity is
    ``s / sqrt(s*s + 15)``.  Texts without a known word get 0 and 0.
    """
    known = look_up_words(df, key, text, lexicon, "left", broadcast_rows)
    total = F.coalesce(F.sum(F.col("n") * F.col("valence")), F.lit(0.0))
    hits = F.sum(F.when(F.col("valence").isNotNull(), F.col("n")))
    leaning = F.coalesce(F.sum(F.col("n") * F.col("subjectivity")) / hits, F.lit(0.0))
    return known.groupBy(key).agg(total.alias("_s"), leaning.alias("subjectivity")).select(
        key, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15)).alias(name), "subjectivity"
    )


def stem_tokens(df: DataFrame, key: str, text: str, stems: DataFrame | None = None) -> DataFrame:
    """Tokens of posts in their order, one row per token, stemmed by table.

    Tokens that the table does not have stay as they are.
    """
    rows = df.select(key, F.posexplode(tk.post_tokens(text)).alias("pos", "token"))
    if stems is None:
        return rows
    return lookup_join(rows, stems, "token", key, "left").select(
        key, "pos", F.coalesce("stem", "token").alias("token")
    )


def stemmed_texts(df: DataFrame, key: str, text: str, stems: DataFrame | None = None, name: str = "tokens") -> DataFrame:
    """``key`` with the stemmed tokens of its texts as one array; texts without any have no row.

    Only the tokens that a stem changes leave their text, and come back to their
    places in it.  Texts that share their key are sorted by place and token.
    """
    once, several = split_repeated(df.select(key, text), key)
    together = regroup_tokens(stem_tokens(several, key, text, stems), key, name=name)
    if stems is None:
        plain = once.select(key, tk.post_tokens(text).alias(name))
    else:
        changing = stems.filter(F.col("stem") != F.col("token"))
        rows = once.select(key, F.posexplode(tk.post_tokens(text)).alias("pos", "token"))
        changed = lookup_join(rows, changing, "token", key, "inner").groupBy(F.col(key).alias("_key")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("_changed")
        )
        # The tokens without a stem that changes them, up to each that has one, and what follows the last.
        merge = lambda arr, at: F.concat(
            F.flatten(F.transform(at, lambda c, i: F.concat(
                F.slice(arr, F.coalesce(F.get(at, i - 1)["pos"] + 1, F.lit(0)) + 1, c["pos"] - F.coalesce(F.get(at, i - 1)["pos"] + 1, F.lit(0))),
                F.array(c["stem"]),
            ))),
            F.slice(arr, F.element_at(at, -1)["pos"] + 2, F.size(arr)),
        )
        put = lambda arr: F.when(F.col("_changed").isNull(), arr).otherwise(merge(arr, F.col("_changed")))
        plain = once.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, bind(tk.post_tokens(text), put).alias(name))
    return plain.filter(F.size(name) > 0).unionByName(together)


def regroup_tokens(rows: DataFrame, key: str, token: str = "token", name: str = "tokens") -> DataFrame:
    """Token rows back to one array per text (a text is one row to begin with)."""
    packed = F.sort_array(F.collect_list(F.struct("pos", token)))
    return rows.groupBy(key).agg(F.transform(packed, lambda p: p[token]).alias(name))


def ngram_rows(df: DataFrame, key: str, tokens: str, low: int, high: int, keep: Sequence[str] = ()) -> DataFrame:
    """Occurrences per (key, term) for all n-grams with ``low <= n <= high``."""
    by_size = df.select(key, *keep, F.explode(tk.ngram_sets(tokens, low, high)).alias("_g"))
    return (
        by_size.select(key, *keep, F.col("_g.size").alias("size"), F.explode("_g.terms").alias("term"))
        .groupBy(key, *keep, "size", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ngram_totals(df: DataFrame, key: str, text: str, low: int, high: int, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Per key and n-gram size the n-grams (``n``) and the different ones (``n_terms``), counted where the text lies.

    Only texts that share their key are shuffled, by key and n-gram.
    """
    once, several = split_repeated(df.select(key, text), key)
    by_size = prepare_terms(once, text, stop_words).select(key, F.explode(tk.ngram_sets("tokens", low, high)).alias("_g"))
    long = lambda c: F.size(c).cast("long")
    single = by_size.select(
        key, F.col("_g.size").alias("size"), long("_g.terms").alias("n"), long(F.array_distinct("_g.terms")).alias("n_terms")
    ).filter("n > 0")
    rows = ngram_rows(prepare_terms(several, text, stop_words), key, "tokens", low, high)
    return single.unionByName(rows.groupBy(key, "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms")))


def ngram_occurrences(
    df: DataFrame, key: str, tokens: str, low: int, high: int, keep: Sequence[str] = (), listed: bool = False
) -> DataFrame:
    """A row with ``n = 1`` per occurrence of an n-gram, made where the text lies; nothing is shuffled.

    In the ``listed`` form a text is one row: ``low``, ``high`` and the hashes of its tokens in their order, from
    which ``classify`` makes the n-grams of these sizes where it counts them.
    """
    if listed:
        hashes = F.transform(tokens, lambda w: F.xxhash64(w)).alias("words")
        return df.select(key, *keep, F.lit(low).alias("low"), F.lit(high).alias("high"), hashes)
    by_size = df.select(key, *keep, F.explode(tk.ngram_sets(tokens, low, high)).alias("_g"))
    return by_size.select(
        key, *keep, F.col("_g.size").alias("size"), F.explode("_g.terms").alias("term"), F.lit(1).cast("long").alias("n")
    )


def english_stop_words() -> list[str]:
    """The stop words that Spark ML ships (needs a running session)."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def prepare_terms(df: DataFrame, text: str, stop_words: Sequence[str] | None = None, name: str = "tokens") -> DataFrame:
    words = english_stop_words() if stop_words is None else stop_words
    return df.withColumn(name, tk.drop_words(tk.post_tokens(text), words))


# ---- vocabularies and sequences ------------------------------------------------

def vocabulary(df: DataFrame, tokens: Column, num_words: int) -> DataFrame:
    """The ``num_words - 1`` most frequent words with ids from 1; ties by word.

    The list has a fixed size, so numbering it in one task is safe.
    """
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(num_words - 1)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", place.alias("id"))


def encode(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, bound: int | None = None, unknown: int | None = None, name: str = "ids") -> DataFrame:
    """Token arrays as id arrays in text order.

    Unknown words are skipped, or get the ``unknown`` id.  ``bound`` is the size
    of a vocabulary that is known to have no more words; others are counted.
    """
    rows = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    vocab = vocab.withColumnRenamed("id", "_id")
    if bound is not None and bound <= BROADCAST_ROWS:
        ids = rows.join(F.broadcast(vocab), "token", "left")
    else:
        ids = lookup_join(rows, vocab, "token", key, "left")
    if unknown is not None:
        ids = ids.withColumn("_id", F.when(F.col("token").isNotNull(), F.coalesce("_id", F.lit(unknown))))
    entry = F.when(F.col("_id").isNotNull(), F.struct("pos", "_id"))
    packed = F.sort_array(F.collect_list(entry))
    return ids.groupBy(key).agg(F.transform(packed, lambda p: p["_id"]).alias(name))


def padded_sequences(df: DataFrame, key: str, text: str, num_words: int = 20_000, length: int = 30) -> DataFrame:
    """Last ``length`` known word ids, zeros in front."""
    words = tk.words(text)
    ids = encode(df, key, words, vocabulary(df, words, num_words), bound=num_words)
    return ids.withColumn("ids", tk.pad_front("ids", length))


def subword_sequences(
    df: DataFrame, key: str, text: str, vocab: DataFrame, begin: int, end: int, unknown: int,
    length: int = 220, bound: int | None = None, marker: str = "DUMMY_VALUE",
) -> DataFrame:
    """Fixed-length id sequences with begin and end marks, mask and cut flag."""
    filled = df.select(key, F.coalesce(F.col(text), F.lit(marker)).alias(text))
    ids = encode(filled, key, tk.words(text), vocab, bound, unknown)
    return ids.select(
        key,
        (F.size("ids") > length - 2).alias("was_cut"),
        tk.wrap_back("ids", length, begin, end).alias("ids"),
    ).withColumn("mask", tk.mask("ids"))


def category_codes(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Distinct labels with codes in alphabetical order, from 0."""
    labels = numbered(df.select(label).dropna().distinct(), [], label, text_segment(F.col(label)), name)
    return labels.select(label, (F.col(name) - 1).cast("int").alias(name))


def one_hot(df: DataFrame, label: str) -> DataFrame:
    """Adds ``code`` and the ``one_hot`` array."""
    codes = category_codes(df, label)
    size = codes.agg(F.count(F.lit(1)).cast("int")).scalar()
    coded = df.join(codes, label).withColumn("_k", size)
    return coded.withColumn("one_hot", tk.one_hot("code", F.col("_k"))).drop("_k")


def mean_vectors(df: DataFrame, key: str, text: str, vectors: DataFrame, dim: int, vector: str = "vector", broadcast_rows: int = VECTOR_ROWS) -> DataFrame:
    """Mean of the word vectors per text; words without a vector are left out.

    One sum per dimension in a single aggregation, so a token row is never
    multiplied by the dimension.
    """
    # Vectors are wide, so fewer of them are broadcast.
    known = look_up_words(df, key, text, vectors, broadcast_rows=broadcast_rows)
    weight = F.sum("n")
    sums = [
        (F.sum(F.col("n") * F.col(vector).getItem(i).cast("double")) / weight).alias(f"_d{i}") for i in range(dim)
    ]
    means = known.groupBy(key).agg(weight.alias("n_words"), *sums)
    return means.select(key, "n_words", F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias("mean_vector"))


def scores_by_label(scored: DataFrame, labels: DataFrame, key: str, label: str, scores: Sequence[str]) -> DataFrame:
    """Labels joined to score columns, summarised per label and score."""
    joint = labels.select(key, label).join(scored.select(key, *scores), key, "left")
    long = F.explode(
        F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("value")) for s in scores])
    ).alias("r")
    return describe(joint.select(label, long).select(label, "r.*"), "value", [label, "name"])
