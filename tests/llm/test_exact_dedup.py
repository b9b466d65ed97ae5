import hashlib
from collections import defaultdict

import pytest

from exposurelab.llm import exact_dedup
from exposurelab.llm.queries import QUERIES, SQL
from tests.oracle_check import compare, connect

from .helpers import fold, no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert compare(QUERIES["op6_exact_dedup"](spark, SF), connect(SF), SQL["op6_exact_dedup"]) is None


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan, partitions", [(2, 16), (3, 5), (8, 4)])
def test_tree_of_any_shape(spark, keep, fan, partitions):
    docs = spark.createDataFrame([(i, f"Text {i % 37}" if i % 3 else "hot") for i in range(600)], "doc_id long, text string")
    rows = exact_dedup.digests(docs.repartition(9))
    groups = exact_dedup.merge_runs(rows, keep, fan, partitions).collect()
    wanted = defaultdict(list)
    for i in range(600):
        wanted[hashlib.sha256((f"text {i % 37}" if i % 3 else "hot").encode()).digest()].append(i)
    best = min if keep == "smallest" else max
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in groups} == {
        d: (best(v), len(v)) for d, v in wanted.items()
    }
    assert len(groups) == len(wanted)


def test_odd_documents(spark):
    rows = exact_dedup.exact_duplicates(odd_docs(spark), keep="smallest").collect()
    assert len(rows) == 10
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["id"]].append(r)
    assert by_id[2][0]["keep_id"] == 1 and not by_id[2][0]["kept"] and by_id[1][0]["kept"]
    # Null and empty texts are equal; a null id stays only among null ids.
    assert by_id[3][0]["group_size"] == 3 and by_id[4][0]["keep_id"] == 3
    assert [r["kept"] for r in by_id[6]] == [True, True]
    assert sorted((r["group_size"], r["kept"]) for r in by_id[None]) == [(2, True), (2, True), (3, False)]
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0


def test_kept_documents_have_one_row_per_text(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [fold(r["text"] or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({fold(r["text"] or "") for r in docs.collect()})
    assert {r["doc_id"] for r in rows} == {1, 3, 5, 6, None}
    assert exact_dedup.kept_documents(no_docs(spark)).count() == 0


def test_bad_choice(spark):
    with pytest.raises(ValueError):
        exact_dedup.merge_runs(exact_dedup.digests(no_docs(spark)), "first")
