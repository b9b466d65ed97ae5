import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from exposurelab.llm import packing
from exposurelab.llm.queries import QUERIES, VOCABULARY

from .helpers import no_docs, odd_docs

PATH = public_tokenizers.path(VOCABULARY)
SF = "/root/testdata/sf0.001"


@cache
def whole_tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    made = whole_tokenizer().encode(text or "", add_special_tokens=False).ids
    return np.array([*made, 1], "<u4")


def check_sequences(rows, full=2048, cut=True):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= full
        if cut:
            assert at == full or at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize(
    "text",
    [
        "Plain words, and more words.", "it's we'll 'S don't x_y__z '''s", "\u00c0\u00c9\u00d7\u00f7\u00df \u00aa\u00b2 \u00bd 12345 a1b2",
        "\u0391\u03a3 \u0391\u03a3' \u0130stanbul e\u0301", "a\x85c \x1cq a\x0bb\x0cc \x00 \x7f \u2028 \u00a0x", "\u65e5\u672c\u8a9e 123",
        "a<|endoftext|>b <|startoftext|>", "###$$$%%% &&&x", "", " \n\t ", "x" * 5000, "MiXeD CASE\u00c9",
        "End. Next, more... (odd). a,b 1,000.5 .x ,, 'tis, it's. x\u00d7, \u00f7.", "<|ENDOFTEXT|>. <|endoftext|>, .",
    ],
)
def test_words_give_the_same_ids_as_the_whole_text(text):
    assert packing.WordTokenizer(PATH).encode(text) == ids_of(text)[:-1].tobytes()


def test_small_tables_of_words_change_nothing():
    tokenizer = packing.WordTokenizer(PATH)
    tokenizer.words.size = tokenizer.parts.size = 3
    text = "one two three four five one two six seven one. Two, three!"
    assert tokenizer.encode(text) == ids_of(text)[:-1].tobytes()
    assert len(tokenizer.words) <= 3 and len(tokenizer.words.old) <= 3


def test_query_against_tokenizing_whole_texts(spark):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_sequences(rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        ids = ids_of(texts[key])
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)


def test_odd_documents(spark):
    rows = packing.pack(odd_docs(spark).coalesce(1), PATH).collect()
    check_sequences(rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 2 * len(ids_of("no id at all")) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 60_001
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_three_limits_hold_at_once(spark):
    rows = [(i, "word " * (i % 7 * 9 + 1), "ask " * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, answer string, question string").coalesce(1)
    for cut in (True, False):
        made = packing.pack(
            docs, PATH, "id", "answer", "question", max_tokens=256, max_segments=6, max_loss=150, cut=cut, window=64
        ).collect()
        for pieces in check_sequences(made, 256, cut).values():
            assert len(pieces) <= 6 and sum(p["loss_tokens"] for p in pieces) <= 150
        assert sum(r["length"] for r in made) == sum(len(ids_of(q + a)) for _, a, q in rows)
        loss = sum(r["loss_tokens"] for r in made)
        assert loss == sum(len(ids_of(a)) for _, a, _ in rows)
        if not cut:
            assert len(made) == len(rows)


def test_example_that_cannot_fit():
    with pytest.raises(ValueError):
        list(packing.Packer(10, 5, 10, cut=False).add("x", 11, 0))
    with pytest.raises(ValueError):
        packing.Packer(0, 1, 1, cut=True)


def test_whole_examples_fill_sequences_well():
    rng = np.random.default_rng(0)
    packer, sizes, n = packing.Packer(2048, 64, 2048, cut=False), [], 0
    for i in range(3000):
        size = int(rng.integers(10, 900))
        n += size
        sizes += [sum(e - s for _, s, e, _ in q) for q in packer.add(i, size, 0)]
    sizes += [sum(e - s for _, s, e, _ in q) for q in packer.finish()]
    assert sum(sizes) == n and n / (2048 * len(sizes)) > 0.97
