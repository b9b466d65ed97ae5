import re

import numpy as np
import pytest
import xxhash

from exposurelab.llm import simhash
from exposurelab.llm.components import connected_components
from exposurelab.llm.queries import QUERIES

from .helpers import fold, no_docs, odd_docs, smallest_linked

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", fold(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    ids, values = list(prints), np.array(list(prints.values()), np.uint64)
    links = []
    for k, i in enumerate(ids):
        links += [(i, ids[j]) for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius)]
    return smallest_linked(ids, links)


def test_query_against_all_pairs(spark):
    rows = QUERIES["op8_simhash"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{v:016x}" for i, v in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_groups(prints)


@pytest.mark.parametrize("tile", [2048, 5])
def test_tiles_against_all_pairs(spark, tile):
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(40):
        at = int(rng.integers(1 << 63))
        for _ in range(12):
            values.add(at)
            at ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
    scheme = simhash.Close()
    rows = [(np.array([v], ">u8").tobytes(), scheme.key(np.array([v], np.uint64))) for v in values]
    links = simhash.linked(spark.createDataFrame(rows, "node binary, key array<int>"), scheme, tile).collect()
    made = smallest_linked(values, [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in links])
    assert made == plain_groups({v: v for v in values})


def test_odd_documents(spark):
    rows = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 10
    found = {}
    for r in rows:
        found.setdefault(r["id"], []).append(r["component"])
    assert found[2] == [1] and found[4] == [3] and found[6] == [6, 6]
    assert sorted(found[None], key=str) == [3, None, None]
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    kept = simhash.kept_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 5, 6, None]
    assert simhash.kept_documents(no_docs(spark)).count() == 0


def test_components_of_every_shape(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (7, None), (None, None)]
    links += [(int(a), int(b)) for a, b in rng.integers(400, 600, (120, 2))]
    made = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert made == smallest_linked({x for pair in real for x in pair}, real)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_kept_documents_against_all_pairs(spark):
    """The stage keeps the smallest id of each group that the contract's links make."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    kept = {r["doc_id"] for r in simhash.kept_documents(docs).collect()}
    assert kept == set(plain_groups(prints).values())


def test_long_texts_vote_in_chunks():
    hashes = [xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(simhash.CHUNK + 1000)]
    right = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int(simhash.fingerprint(hashes)[0]) == right and int(simhash.fingerprint([])[0]) == 0
