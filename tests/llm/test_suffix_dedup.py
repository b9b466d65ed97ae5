import hashlib
from collections import Counter

import numpy as np
import pytest

from exposurelab.llm import suffix_dedup
from exposurelab.llm.queries import QUERIES

from .helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def plain_spans(texts, length):
    """Maximal removed runs of each of some byte strings, by counting all strings."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    made = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        made.append(list(zip(edges[::2], edges[1::2])))
    return made


def spans_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return {r["id"]: ([(s["a"], s["b"]) for s in r["spans"]], bytes(r["kept"]), r["n_bytes"]) for r in rows}


def repetitive(seed):
    rng = np.random.default_rng(seed)
    letters = lambda n, k=4: "".join("abcdé\0"[c] for c in rng.integers(0, k, n))
    passages = [letters(int(rng.integers(20, 120)), 6) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [letters(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(8))]
            a, b = sorted(rng.integers(0, len(p), 2))
            parts += [p[a:b] if rng.random() < 0.5 else p, letters(int(rng.integers(0, 40)))]
        texts.append("".join(parts))
    return [*texts, texts[0], texts[1][:50], "abc" * 100, "a" * 90, "", "b" * 29, "cd" * 15]


@pytest.mark.parametrize("seed, group", [(1, 2000), (2, 2000), (3, 1), (4, 3)])
def test_against_counting_all_strings(spark, seed, group):
    texts = repetitive(seed)
    data = [t.encode() for t in texts]
    found = spans_of(spark, texts, length=30, gram=8, group=group)
    for i, spans in enumerate(plain_spans(data, 30)):
        assert found[i][0] == spans
        gone = {k for a, b in spans for k in range(a, b)}
        assert found[i][1] == bytes(x for k, x in enumerate(data[i]) if k not in gone) and found[i][2] == len(data[i])


def test_query_against_counting_all_strings(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op10_run_length_index"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for (i, data), spans in zip(texts.items(), plain_spans(list(texts.values()), 200)):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept + data[at:]).hexdigest()


@pytest.mark.parametrize("text", ["banana", "abracadabra abracadabra", "aaaaaaa", "ab" * 40 + "ba" * 40])
def test_longest_matches_from_run_ends(text):
    data = np.frombuffer(text.encode() + b"\0", np.uint8).astype(np.int16) + 1
    data[-1] = 0
    n = len(text)
    index = suffix_dedup.RunIndex(data)
    found = index.matches(np.full(n + 1, n))
    for i in range(n):
        longest = max(
            (k for j in range(n) if j != i for k in range(n - max(i, j) + 1) if text[i : i + k] == text[j : j + k]), default=0
        )
        assert found[i] == longest
    assert sum(index.lengths) == n + 1 and len(index.first) == len(index.heads) - 1


def test_segments_cover_every_start_once():
    data = ("some words that repeat " * 400).encode()
    for chunk in (1 << 20, 1000):
        at = 0
        for _, _, first, n in suffix_dedup.segments(data, 200, 32, chunk):
            assert first == at and n > 0
            at += n
        assert at == len(data) - 199
    assert list(suffix_dedup.segments(b"x" * 199)) == []


def test_odd_documents(spark):
    rows = suffix_dedup.remove_repeats(odd_docs(spark)).collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], []).append(r)
    assert by_id[5][0]["kept"] == b"" and by_id[6][0]["kept"] == by_id[6][1]["kept"] == b""
    assert {r["n_bytes"] for r in by_id[None]} == {0, 12}
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(no_docs(spark), length=10, gram=20)
