import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from exposurelab.llm import mixing, toxicity
from exposurelab.llm.queries import VOCABULARY, toxicity_chain

from .helpers import fold, no_docs, odd_docs
from .test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = []
    for number, stage in enumerate(stages.values()):
        tasks = docs.rdd.getNumPartitions()
        made = stage(spark, docs, SF)
        assert number == 4 or made.columns == columns
        made.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append(docs.collect())
    chain = toxicity_chain(spark, SF)
    everything = spark.read.parquet(f"{SF}/documents.parquet").collect()
    clean = {r["doc_id"] for r in everything if chain.predict(r["text"] or "")[1] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in kept[0]} == clean
    first = {}
    for r in sorted(kept[0], key=lambda r: r["doc_id"]):
        first.setdefault(fold(r["text"] or ""), r["doc_id"])
    assert {r["doc_id"] for r in kept[1]} == set(first.values())
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept[1]}
    assert {r["doc_id"] for r in kept[2]} == set(plain_groups(prints).values())
    mixed = mixing.mix(spark.createDataFrame(kept[2], docs_schema(spark))).select(*columns).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, kept[3]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    tokens = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept[3])
    assert sum(r["length"] for r in kept[4]) == tokens
    assert all(len(r["ids"]) == 4 * r["length"] for r in kept[4])
    sizes = {}
    for r in kept[4]:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes.values()) and max(sizes.values()) <= 2048
    # A task leaves at most one sequence of each smaller power of two.
    assert sum(s < 2048 for s in sizes.values()) <= 11 * tasks


def docs_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_run_is_registered(spark):
    assert driver.queries()["pipeline"](spark, SF).count() > 0
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in driver.queries()}


def test_stages_take_odd_and_empty_documents(spark):
    columns = docs_schema(spark).names
    for docs in (odd_docs(spark).select(*columns), no_docs(spark)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, SF)
            assert number == 4 or made.columns == columns
            assert (made.count() > 0) == (docs.count() > 0)
