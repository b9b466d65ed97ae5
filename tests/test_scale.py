"""What the large inputs asked for: nothing wide is shuffled, keys that repeat still count right."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from exposurelab.functions import tokens as tk
from exposurelab.operators import classify, skew
from exposurelab.operators import text as tx
from exposurelab.operators import textmodel as tm
from exposurelab.plans.queries import effects, texts as text_queries

TEXTS = [(1, "Going going gone by the red cars"), (1, "red cars wanted"), (2, "red cars"), (None, "red"), (None, "cars"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "d int, t string").repartition(3)


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_ngram_totals_of_keys_that_repeat(texts):
    rows = tx.ngram_rows(tx.prepare_terms(texts, "t", ["the"]), "d", "tokens", 1, 3)
    wanted = rows.groupBy("d", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    made = tx.ngram_totals(texts, "d", "t", 1, 3, ["the"])
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, wanted.collect()))


def test_ngrams_of_single_keys_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c")], "d int, t string")
    made = tx.ngram_totals(df, "d", "t", 1, 2, [])
    assert not [x for x in exchanges(made) if "term" in x.split("AS")[0] and "size" not in x]
    assert {tuple(r) for r in made.collect()} == {(1, 1, 3, 2), (1, 2, 2, 2), (2, 1, 1, 1)}


def test_term_occurrences_count_a_key_once(texts):
    got = tx.term_occurrences(texts, "d", tk.words("t")).groupBy("term").agg(F.sum("n"), F.sum("first")).collect()
    seen, keys = Counter(), {}
    for key, text in TEXTS:
        for word in (text or "").lower().split():
            seen[word] += 1
            keys.setdefault(word, set()).add(key)
    assert {r[0]: (r[1], r[2]) for r in got} == {w: (n, len(keys[w])) for w, n in seen.items()}


def test_stemmed_texts_like_regrouped_rows(spark, texts):
    stems = spark.createDataFrame([("going", "go"), ("cars", "car"), ("wanted", "want"), ("red", "red")], "token string, stem string")
    plain = lambda df: Counter((r["d"], tuple(r["tokens"])) for r in df.collect())
    wanted = plain(tx.regroup_tokens(tx.stem_tokens(texts, "d", "t", stems), "d"))
    assert plain(tx.stemmed_texts(texts, "d", "t", stems)) == wanted
    assert plain(tx.stemmed_texts(texts, "d", "t")) == plain(tx.regroup_tokens(tx.stem_tokens(texts, "d", "t"), "d"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_copies_no_table(spark, how):
    left = spark.createDataFrame([(i, w) for i in range(64) for w in ("a", "b", f"w{i}", None)], "d int, token string")
    table = spark.createDataFrame([("a", 1), ("w3", 3), ("w9", 9), ("x", 0)], "token string, v int")
    made = skew.split_join(left, table, "token", "d", how, rows=2)
    assert Counter(map(tuple, made.select("d", "token", "v").collect())) == Counter(
        map(tuple, left.join(table, "token", how).select("d", "token", "v").collect())
    )
    assert "explode" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_grid_gathers_a_document_before_its_sums(spark):
    docs = spark.createDataFrame([(i, i % 2, i % 5) for i in range(20)], "d int, y int, fold int")
    counts = docs.select("*", F.lit(1).alias("size"), F.explode(F.array(F.lit("a"), F.concat(F.lit("w"), F.col("y")))).alias("term"), F.lit(1).cast("long").alias("n"))
    got = classify.naive_bayes_grid(docs, counts, "d", "y", [0, 1], [(1, 1)], [1.0], partitions=3)
    assert [x for x in exchanges(got) if "hashpartitioning(d#" in x and "REPARTITION_BY_NUM" in x]
    assert [r["mean_accuracy"] for r in got.collect()] == [1.0, 1.0]


def test_large_files_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    spark.range(100).select(F.col("id").alias("post"), F.lit(1).alias("y")).write.parquet(str(tmp_path / "r"))
    responses, posts = spark.read.parquet(str(tmp_path / "r")), spark.range(50).select(F.col("id").alias("post"))
    size = sum(s for _, s, _ in effects.file_versions(responses))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(effects, "PARTITION_BYTES", size / (3 * cores))
    made = effects.met(responses, posts)
    assert f"{3 * cores})" in "".join(exchanges(made)) or f", {3 * cores}" in "".join(exchanges(made))
    assert made.count() == 50


def listed_and_rows(spark, n=60):
    words = ["red", "car", "sun", "sea", "oak"]
    texts = [(i, i % 2 if i % 13 else None, i % 5, i % 4 == 0, [words[(i * j + j // 3) % 5] for j in range(i % 9)] + [f"w{i % 7}"]) for i in range(n)]
    df = spark.createDataFrame(texts, "d int, y int, fold int, is_test boolean, tokens array<string>").repartition(3)
    keep = ["y", "fold", "is_test"]
    rows = tx.ngram_occurrences(df, "d", "tokens", 1, 3, keep=keep)
    return df.drop("tokens"), tx.ngram_occurrences(df, "d", "tokens", 1, 3, keep=keep, listed=True), rows


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "shuffle" in f}


def test_refit_takes_the_terms_that_the_grid_counted(spark):
    docs, listed, rows = listed_and_rows(spark)
    before = shuffle_files(spark)
    known = classify.count_terms(listed, "d", "y", [0, 1], partitions=6, rounds=3)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    # Three rounds of terms were shuffled, and their files are gone; what is left is of the few totals.
    left = [f.rpartition("/")[2] for f in shuffle_files(spark) - before if f.endswith(".data")]
    assert len({f.split("_")[1] for f in left}) <= 1
    for low, high in [(1, 1), (2, 3), (1, 3)]:
        got = classify.naive_bayes(docs, known, "d", "y", [0, 1], alpha=0.5, sizes=(low, high)).collect()
        chosen = rows.filter(F.col("size").between(low, high))
        for wanted in (classify.naive_bayes(docs, chosen, "d", "y", [0, 1], alpha=0.5), classify.naive_bayes(docs, chosen, "d", "y", [0, 1], alpha=0.5, rounds=2)):
            assert {r["d"]: (r["predicted"], round(r["score_0"], 9), round(r["score_1"], 9)) for r in got} == {
                r["d"]: (r["predicted"], round(r["score_0"], 9), round(r["score_1"], 9)) for r in wanted.collect()
            }
    assert sum(int(v[-1]) for v in known.vocabulary.values()) == rows.filter("not is_test").select("size", "term").distinct().count()


def test_a_model_takes_tokens_that_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(i, ["red cars going", "blue car gone", "", None][i % 4], i % 2 if i % 11 else None) for i in range(40)], "d int, t string, y int")
    stems = spark.createDataFrame([("cars", "car"), ("going", "go")], "token string, stem string")
    settings = tm.Settings((0, 1), stop_words=("blue",), low=1, high=2)
    tokens = tx.ngram_occurrences(tm.prepared(df, "d", "t", stems, ["blue"]), "d", "tokens", 1, 2, keep=["tokens"], listed=True)
    # The texts are not read a second time.
    bare = df.withColumn("t", F.lit("nothing of this counts"))
    fresh = tm.fit_text_model(df.filter("d < 30"), "d", "t", "y", settings, str(tmp_path / "a"), stems)
    again = tm.fit_text_model(bare.filter("d < 30"), "d", "t", "y", settings, str(tmp_path / "b"), stems, tokens)
    assert (again.words, again.documents, again.vocabulary) == (fresh.words, fresh.documents, fresh.vocabulary)
    assert Counter(map(tuple, again.terms.collect())) == Counter(map(tuple, fresh.terms.collect()))
    wanted = tm.predict(fresh, df.filter("d >= 30"), "d", "t")
    assert Counter(map(tuple, tm.predict(again, bare.filter("d >= 30"), "d", "t", tokens).collect())) == Counter(map(tuple, wanted.collect()))
    assert "term#" not in "".join(exchanges(wanted))


def test_grid_in_rounds_counts_all_terms(spark):
    docs, listed, rows = listed_and_rows(spark)
    train = ~F.col("is_test")
    found = lambda counts, **more: Counter(
        (r["low"], r["high"], r["alpha_index"], r["fit_prior"], round(r["mean_accuracy"], 9))
        for r in classify.naive_bayes_grid(docs.filter(train), counts.filter(train), "d", "y", [0, 1], [(1, 1), (2, 3), (1, 3)], [0.5, 2.0], **more).collect()
    )
    wanted = found(rows)
    assert len(wanted) == 12
    assert found(listed) == found(listed, partitions=7, rounds=3) == found(rows, rounds=2) == wanted
    before = shuffle_files(spark)
    cells = classify.Cells(5, 2)
    classify.known_terms(listed, "d", cells.cell("y", [0, 1], "fold", range(5)), cells, 7, 3)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    left = {f.rpartition("/")[2].split("_")[1] for f in shuffle_files(spark) - before if f.endswith(".data")}
    assert len(left) <= 1


def test_texts_are_not_shuffled_to_meet_their_labels(spark):
    class Given:
        labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
        texts = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("red cars going").alias("text")).repartition(3)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stems = spark.createDataFrame([("cars", "car")], "token string, stem string")
        plans = []
        stored, text_queries.stored = text_queries.stored, lambda rows, name: plans.append(exchanges(rows)) or rows
        text_queries.labelled_terms(Given, 2)
        docs, terms = text_queries.stem_terms(Given, stems)
        assert not plans[0] and not [x for x in plans[1] if "text" in x]
        assert {tuple(r["tokens"]) for r in terms.collect()} == {("red", "car", "going")} and terms.count() == docs.count() == 40
    finally:
        text_queries.stored = stored
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_follow_the_terms(spark, monkeypatch):
    _, listed, _ = listed_and_rows(spark)
    terms = listed.agg(F.sum(3 * F.size("words"))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    assert text_queries.dealt(listed) == {"partitions": cores, "rounds": 1}
    monkeypatch.setattr(text_queries, "PARTITION_TERMS", terms / (3 * cores))
    assert text_queries.dealt(listed) == {"partitions": 3 * cores, "rounds": 3}
    monkeypatch.setattr(text_queries, "PARTITION_TERMS", 1)
    assert text_queries.dealt(listed) == {"partitions": terms, "rounds": text_queries.COUNT_ROUNDS}
    assert text_queries.dealt(listed.filter("false"))["rounds"] == 1


def test_best_setting_of_a_count_like_that_of_rows(spark):
    docs, listed, rows = listed_and_rows(spark)
    train, ranges = ~F.col("is_test"), [(1, 1), (2, 3), (1, 3)]
    known = classify.count_terms(listed, "d", "y", [0, 1], partitions=6, rounds=2)
    best = [
        classify.best_setting(classify.naive_bayes_grid(docs.filter(train), counts, "d", "y", [0, 1], ranges, [0.5, 2.0])).first()
        for counts in (known, rows.filter(train))
    ]
    assert best[0] == best[1]
