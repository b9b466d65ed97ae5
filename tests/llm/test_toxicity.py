import numpy as np
import pytest

from exposurelab.llm import toxicity
from exposurelab.llm.queries import QUERIES

from .helpers import no_docs, odd_docs


def made_up(n, seed):
    """Texts with two insults or junk words in some; the second label follows the first."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.zipf(1.4, 80) % 3000]
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        if junk:
            words += ["xx1", "xx2"]
        if toxic:
            words[10] = rng.choice(["scum", "vermin", "vermine", "verminous"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made_up(900, 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600], "doc_id long, junk int, toxic int")
    chain = toxicity.train(frame, known, ["junk", "toxic"])
    found = {r["id"]: r for r in toxicity.score(frame, chain).collect()}
    for name, place in (("junk", 1), ("toxic", 2)):
        right = [(found[r[0]][f"p_{name}"] >= 0.5) == bool(r[place]) for r in labels[600:]]
        assert np.mean(right) > 0.97
    kept = {r["doc_id"] for r in toxicity.non_toxic(frame, chain).collect()}
    assert kept == {i for i, r in found.items() if r["p_toxic"] < toxicity.THRESHOLD}


def test_the_chain_passes_probabilities_on():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.5).astype(np.float32)
    first = (x[:, 0] > 0).astype(int)
    index = {f"f{i}": i for i in range(6)}
    # The second category equals the first, but only sees features that tell nothing.
    chain = toxicity.fit_chain(x, np.stack([first, first], axis=1), index, [["f0"], ["f4"]], ["a", "b"], 5)
    assert chain.models[1][2][-1] > 0.3
    assert chain.predict("f0 f4")[1] > 0.8 > 0.2 > chain.predict("f4")[1]


def test_query_on_held_out_labels(spark):
    """Trained on half of the labels, the other half is predicted."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    chain = toxicity.train(docs, labels.filter("doc_id % 2 = 0"), ["low_quality", "toxic"])
    held = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 2 = 1").collect()}
    found = {r["id"]: r["p_toxic"] >= toxicity.THRESHOLD for r in toxicity.score(docs.filter("doc_id % 2 = 1"), chain).collect()}
    toxic = [found[i] for i, y in held.items() if y == 1]
    clean = [found[i] for i, y in held.items() if y == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r["rejected"] == (r["p_toxic"] >= toxicity.THRESHOLD) for r in rows)


def test_odd_documents_and_labels(spark):
    labels = spark.createDataFrame(
        [(1, 1, None), (1, 1, None), (2, None, None), (None, 1, 1), (3, 0, None), (99, 1, 1)],
        "doc_id long, toxic int, other int",
    )
    chain = toxicity.train(odd_docs(spark), labels, ["toxic", "other"])
    rows = toxicity.score(odd_docs(spark), chain).collect()
    assert len(rows) == 10 and all(0 <= r["p_other"] <= 1 for r in rows)
    assert rows[0]["p_other"] == pytest.approx(0.5)
    assert toxicity.score(no_docs(spark), chain).count() == 0
    assert toxicity.non_toxic(odd_docs(spark), chain).columns == odd_docs(spark).columns
    empty = toxicity.train(no_docs(spark), labels.limit(0), ["toxic"])
    assert empty.predict("anything")[0] == pytest.approx(0.5)


def test_the_sample_is_bounded_however_often_an_id_comes(spark, monkeypatch):
    """One labelled id on 5,000 different rows and one on 5,000 equal ones."""
    docs = [(7, f"text {i} of one id") for i in range(5000)] + [(8, "the same text")] * 5000 + [(i, f"w{i} other") for i in range(9, 19)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 19)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, *rest: seen.append(len(x)) or fit(x, *rest))
    toxicity.train(frame, labels, ["toxic"], sample=20)
    # Twice the sample, as far as a draw by hash keeps to it.
    assert 0 < seen[0] <= 80


def test_fits_that_do_not_settle_raise():
    x = np.random.default_rng(1).random((50, 3))
    with pytest.raises(RuntimeError):
        toxicity.fit_logistic(x, (x[:, 0] > 0.5).astype(int), steps=1)
