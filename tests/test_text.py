import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposurelab.functions import tokens as tk
from exposurelab.operators import classify, scorer as sc, text as tx, textmodel as tm

from .scorers import LinearScorer


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "good good bad"), (2, "nothing known"), (3, ""), (4, None), (5, "bad awful")]
    return spark.createDataFrame(rows, "id int, text string")


@pytest.mark.parametrize("rows", [100, 1])
def test_polarity(spark, docs, rows):
    lexicon = spark.createDataFrame([("good", 2.0, 0.5), ("bad", -1.0, 1.0)], "token string, valence double, subjectivity double")
    got = {r["id"]: r for r in tx.polarity(docs, "id", "text", lexicon, broadcast_rows=rows).collect()}
    assert got[1]["polarity"] == pytest.approx(3 / math.sqrt(24)) and got[1]["subjectivity"] == pytest.approx(2 / 3)
    assert got[5]["polarity"] == pytest.approx(-1 / 4)
    assert [got[i]["polarity"] for i in (2, 3, 4)] == [0, 0, 0] and got[2]["subjectivity"] == 0


def test_stems_keep_the_order(spark):
    df = spark.createDataFrame([(1, "@you running dogs run")], "id int, text string")
    stems = spark.createDataFrame([("running", "run"), ("dogs", "dog")], "token string, stem string")
    packed = tx.regroup_tokens(tx.stem_tokens(df, "id", "text", stems), "id")
    assert packed.first()["tokens"] == ["run", "dog", "run"]


def test_stop_words_come_from_spark_by_default(spark):
    df = spark.createDataFrame([(1, "the house and the dog")], "id int, text string")
    assert tx.prepare_terms(df, "text").first()["tokens"] == ["house", "dog"]
    assert tx.prepare_terms(df, "text", ["dog"]).first()["tokens"] == ["the", "house", "and", "the"]


def test_sequences(spark):
    rows = [(1, "a a a b b c"), (2, "d c"), (3, None), (4, " ".join("a" * 40))]
    df = spark.createDataFrame(rows, "id int, text string")
    vocab = {r["token"]: r["id"] for r in tx.vocabulary(df, tk.words("text"), 3).collect()}
    assert vocab == {"a": 1, "b": 2}
    got = {r["id"]: r["ids"] for r in tx.padded_sequences(df, "id", "text", 4, 4).collect()}
    # Words 1..3 are a, b, c; d is unknown and skipped.
    assert got == {1: [1, 2, 2, 3], 2: [0, 0, 0, 3], 3: [0, 0, 0, 0], 4: [1, 1, 1, 1]}
    table = spark.createDataFrame([("a", 5), ("dummy_value", 9)], "token string, id int")
    sub = {r["id"]: r for r in tx.subword_sequences(df, "id", "text", table, 101, 102, 100, length=8).collect()}
    assert sub[2]["ids"] == [101, 100, 100, 102, 0, 0, 0, 0] and sub[2]["mask"] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert sub[4]["was_cut"] and sub[4]["ids"] == [101, 5, 5, 5, 5, 5, 5, 102] and not sub[1]["was_cut"]
    # The marker for null text is split like any text.
    assert sub[3]["ids"][1:3] == [100, 100]


def test_one_hot_and_vectors(spark):
    df = spark.createDataFrame([(1, "x", "a b b"), (2, "w", "c"), (3, "x", "b zzz")], "id int, l string, text string")
    assert {r["id"]: r["one_hot"] for r in tx.one_hot(df, "l").collect()} == {1: [0, 1], 2: [1, 0], 3: [0, 1]}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0])], "token string, vector array<float>")
    for rows in (100, 1):
        means = tx.mean_vectors(df, "id", "text", vectors, 2, broadcast_rows=rows)
        assert {r["id"]: (r["n_words"], r["mean_vector"]) for r in means.collect()} == {1: (3, [3.0, 2.0]), 3: (1, [4.0, 3.0])}


def corpus(spark):
    rows = [
        (1, "x", False, 0, "win cash now cash"), (2, "y", False, 1, "see you now"), (3, "x", False, 2, "cash prize"),
        (4, "y", False, 0, "hello you there"), (5, "x", True, 1, "cash now"), (6, "y", True, 2, "you there unknown"),
        (7, "x", True, 0, "unknown only words here none"), (8, "y", False, 2, "now see cash"),
    ]
    return spark.createDataFrame(rows, "id int, label string, is_test boolean, fold int, text string")


def counted(df, high=1):
    return tx.ngram_rows(tx.prepare_terms(df, "text", []), "id", "tokens", 1, high, keep=["label", "is_test", "fold"])


def plain_nb(train, classes, alpha, prior, grams):
    """Scores of one document by the textbook formula."""
    vocab = {w for _, ws in train for w in ws}
    out = {}

    def scores(words):
        for c in classes:
            bag = [w for l, ws in train if l == c for w in ws]
            share = sum(l == c for l, _ in train) / len(train)
            total = math.log(share) if prior else 0.0
            for w in words:
                if w in vocab:
                    total += math.log((bag.count(w) + alpha) / (len(bag) + alpha * len(vocab)))
            out[c] = total
        return dict(out)

    return scores


def grams(text, low, high):
    ws = text.split()
    return [" ".join(ws[i : i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]


@pytest.mark.parametrize("alpha,prior", [(1.0, True), (0.3, False)])
def test_naive_bayes_by_hand(spark, alpha, prior):
    df = corpus(spark)
    rows = df.collect()
    got = classify.naive_bayes(df.drop("text"), counted(df), "id", "label", ["x", "y"], alpha=alpha, fit_prior=prior).collect()
    scores = plain_nb([(r["label"], grams(r["text"], 1, 1)) for r in rows if not r["is_test"]], ["x", "y"], alpha, prior, grams)
    assert {r["id"] for r in got} == {5, 6, 7}
    for r in got:
        text = next(x["text"] for x in rows if x["id"] == r["id"])
        s = scores(grams(text, 1, 1))
        assert r["score_1"] - r["score_0"] == pytest.approx(s["y"] - s["x"])
        assert r["predicted"] == ("y" if s["y"] > s["x"] else "x")


def test_grid_search_by_hand(spark):
    df = corpus(spark)
    rows = df.collect()
    ranges, alphas = [(1, 1), (1, 2), (2, 2)], [0.5, 2.0]
    grid = classify.naive_bayes_grid(df.drop("text"), counted(df, 2), "id", "label", ["x", "y"], ranges, alphas, folds=3)
    got = {(r["low"], r["high"], r["alpha"], r["fit_prior"]): r["mean_accuracy"] for r in grid.collect()}
    assert len(got) == 12
    for (low, high, alpha, prior), value in got.items():
        folds = []
        for f in range(3):
            train = [(r["label"], grams(r["text"], low, high)) for r in rows if r["fold"] != f]
            scores = plain_nb(train, ["x", "y"], alpha, prior, grams)
            hits = []
            for r in rows:
                if r["fold"] == f:
                    s = scores(grams(r["text"], low, high))
                    hits.append(("y" if s["y"] > s["x"] + 1e-12 else "x") == r["label"])
            folds.append(np.mean(hits))
        assert value == pytest.approx(np.mean(folds)), (low, high, alpha, prior)
    best = classify.best_setting(grid).first()
    assert best["mean_accuracy"] == max(got.values())


def test_confusion_keeps_empty_labels(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    got = {(r["y"], r["p"]): r["n"] for r in classify.confusion(p, "y", "p", ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got[("a", "b")] == 1 and got[("c", "c")] == 0
    assert classify.accuracy(p, "y", "p").first()[0] == pytest.approx(2 / 3)


def test_scores_by_label(spark):
    scored = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id int, s double")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, label string")
    got = {r["label"]: r for r in tx.scores_by_label(scored, labels, "id", "label", ["s"]).collect()}
    assert got["a"]["count"] == 2 and got["a"]["mean"] == pytest.approx(0.3)


def test_linear_scorer_runs_in_tasks(spark, docs):
    scorer = LinearScorer({"good": (1.0, -1.0), "bad": (-1.0, 0.0)}, [0.0, 0.0], ["p", "q"])
    got = {r["id"]: r["s"] for r in docs.select("id", tx.score_text("text", scorer, "p double, q double").alias("s")).collect()}
    assert got[1]["p"] == pytest.approx(1 / (1 + math.exp(-1 / 3))) and got[4]["q"] == 0.5
    assert F is not None


def test_a_class_without_training_documents_never_wins(spark):
    docs = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 0, True)], "d long, y int, is_test boolean")
    counts = spark.createDataFrame(
        [(1, 1, False, "a", 2), (2, 1, False, "b", 1), (3, 0, True, "a", 1), (3, 0, True, "b", 1)],
        "d long, y int, is_test boolean, term string, n long",
    )
    for alpha in (1.0, 0.0):
        row = classify.naive_bayes(docs, counts, "d", "y", [0, 1], alpha=alpha).first()
        assert row["predicted"] == 1 and row["score_0"] == float("-inf") and row["score_1"] > -100
    # Without smoothing an unseen word is as good as impossible, but not undefined.
    both = docs.union(spark.createDataFrame([(4, 0, False)], "d long, y int, is_test boolean"))
    more = counts.union(spark.createDataFrame([(4, 0, False, "c", 3)], "d long, y int, is_test boolean, term string, n long"))
    row = classify.naive_bayes(both, more, "d", "y", [0, 1], alpha=0.0).first()
    assert row["predicted"] == 1 and row["score_0"] < row["score_1"] - 20


def test_scores_from_all_words(spark):
    docs = spark.createDataFrame([(1, "good good bad other"), (2, "other"), (3, None)], "d long, text string")
    weights = spark.createDataFrame([("good", 1.0, -1.0), ("bad", -1.0, 0.0)], "token string, p double, q double")
    for limit in (0, 10):
        rows = {r["d"]: r for r in tx.linear_scores(docs, "d", "text", weights, ["p", "q"], broadcast_rows=limit).collect()}
        assert rows[1]["p"] == pytest.approx(1 / (1 + math.exp(-1 / 3))) and rows[1]["q"] == pytest.approx(1 / (1 + math.exp(2 / 3)))
        assert rows[2]["p"] == rows[3]["q"] == 0.5


def reviews(spark, n=600):
    rng = random.Random(8)
    good, bad, plain = ["fine", "great", "kind"], ["awful", "vile", "cruel"], ["day", "post", "text", "word", "line"]
    rows = []
    for i in range(n):
        negative = i % 3 == 0
        words = rng.choices(plain, k=8) + rng.choices(bad if negative else good, k=rng.randrange(1, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(negative)))
    return spark.createDataFrame(rows, "id int, t string, y int").repartition(4)


def test_trained_scorer_on_held_out_texts(spark, tmp_path):
    df = reviews(spark)
    scorer = sc.train_scorer(df.filter("id < 400"), "t", F.col("y") == 1, buckets=512)
    stored = scorer.save(spark, str(tmp_path / "scorer"))
    assert stored == scorer == sc.load_scorer(spark, str(tmp_path / "scorer"))
    scored = df.filter("id >= 400").withColumn("s", stored("t"))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = scored.collect()
    assert sum((r["s"]["label"] == "NEGATIVE") == (r["y"] == 1) for r in rows) / len(rows) > 0.97
    assert all(0.5 <= r["s"]["score"] <= 1 for r in rows)


def test_scorer_of_odd_texts(spark):
    scorer = sc.HashedScorer(tuple(float(i) for i in range(8)), -0.25)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One one two"), (4, "one " * 50_000)], "id int, t string")
    got = {r["id"]: r["l"] for r in df.select("id", scorer.logit("t").alias("l")).collect()}
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    assert got[1] == got[2] == -0.25
    assert got[3] == pytest.approx(-0.25 + (2 * bucket("one") + bucket("two")) / 3) and got[4] == pytest.approx(-0.25 + bucket("one"))
    with pytest.raises(ValueError):
        sc.read_scorer(spark.createDataFrame([(9, 1.0)], "bucket int, weight double"), 8)
    with pytest.raises(RuntimeError):
        sc.train_scorer(reviews(spark, 60), "t", F.col("y") == 1, buckets=64, max_steps=1)


def test_stored_model_predicts_like_the_fresh_one(spark, tmp_path):
    df = reviews(spark)
    stems = spark.createDataFrame([("great", "good"), ("fine", "good"), ("vile", "bad")], "token string, stem string")
    settings = tm.Settings((0, 1), stop_words=("day", "post"), low=1, high=2, alpha=0.5)
    fresh = tm.fit_text_model(df.filter("id < 400"), "id", "t", "y", settings, str(tmp_path / "m"), stems)
    again = tm.load_text_model(spark, str(tmp_path / "m"))
    assert again.settings == settings and again.words == fresh.words
    rest = df.filter("id >= 400")
    rows = {r["id"]: tuple(r) for r in tm.predict(fresh, rest, "id", "t").collect()}
    assert rows == {r["id"]: tuple(r) for r in tm.predict(again, rest, "id", "t").collect()}
    truth = {r["id"]: r["y"] for r in rest.collect()}
    assert sum(rows[i][1] == y for i, y in truth.items()) / len(truth) > 0.97
    vocabulary = {r["term"] for r in again.terms.collect()}
    assert "good" in vocabulary and not {"great", "day"} & vocabulary
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "unseen")], "id int, t string")
    prior = [math.log(n / sum(fresh.documents)) for n in fresh.documents]
    for r in tm.predict(again, empty, "id", "t").collect():
        assert (r["predicted"], [r["score_0"], r["score_1"]]) == (0, pytest.approx(prior))


def test_models_that_are_foreign_or_unfinished(spark, tmp_path):
    df, settings = reviews(spark, 30), tm.Settings((0, 1))
    with pytest.raises(FileNotFoundError):
        tm.load_text_model(spark, str(tmp_path / "none"))
    tm.fit_text_model(df, "id", "t", "y", settings, str(tmp_path / "m"))
    with pytest.raises(FileExistsError):
        tm.fit_text_model(df, "id", "t", "y", settings, str(tmp_path / "m"))
    foreign = spark.createDataFrame([('{"version": 99}',)], "manifest string")
    foreign.write.parquet(str(tmp_path / "f" / "manifest"))
    with pytest.raises(ValueError):
        tm.load_text_model(spark, str(tmp_path / "f"))
