import math
from collections import Counter

import pytest

from exposurelab.llm import mixing
from exposurelab.llm.queries import QUERIES, SQL
from tests.oracle_check import compare, connect

from .helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert compare(QUERIES["op2_poisson_mix"](spark, SF), connect(SF), SQL["op2_poisson_mix"]) is None


def test_rates_reach_the_weights(spark):
    docs = spark.createDataFrame(
        [(i, "x" * 99, "big" if i < 900 else "small") for i in range(1000)], "doc_id long, text string, source string"
    )
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, weights={"big": 1.0, "small": 3.0}).collect()}
    assert rates["big"] == pytest.approx(0.25 / 0.9) and rates["small"] == pytest.approx(0.75 / 0.1)
    n = Counter(r["source"] for r in mixing.mix(docs, weights={"big": 1.0, "small": 3.0}).collect())
    assert abs(n["small"] - 750) < 5 * math.sqrt(750) and abs(n["big"] - 250) < 5 * math.sqrt(250)
    assert "big" not in {r["source"] for r in mixing.mix(docs, weights={"small": 1.0}).collect()}


def test_large_means_are_sums_of_parts(spark):
    docs = spark.createDataFrame([(i, "abc", "s") for i in range(200)], "doc_id long, text string, source string")
    counts = Counter(r["doc_id"] for r in mixing.mix(docs, epochs=100.0).collect())
    mean = sum(counts.values()) / 200
    spread = sum((counts[i] - mean) ** 2 for i in range(200)) / 200
    assert abs(mean - 100) < 4 and 65 < spread < 145


def test_order_is_shuffled_and_sorted_by_key(spark):
    docs = spark.createDataFrame([(i, "abc", "s") for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, epochs=2.0).collect()
    keys = [r["shuffle_key"] for r in rows]
    assert keys == sorted(keys)
    ids = [r["doc_id"] for r in rows]
    assert ids != sorted(ids) and rows == mixing.mix(docs.repartition(7), epochs=2.0).collect()


def test_odd_documents(spark):
    rows = mixing.mix(odd_docs(spark), epochs=3.0).collect()
    assert rows and set(rows[0].asDict()) == {
        "doc_id", "text", "lang", "source", "n_chars", "kept", "node", "copy", "rate", "shuffle_key"
    }
    twice = Counter((r["doc_id"], r["copy"]) for r in rows if r["doc_id"] == 6)
    assert set(twice.values()) <= {2}
    assert mixing.mix(no_docs(spark)).count() == 0
