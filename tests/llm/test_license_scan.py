import random
import re

import pytest

from exposurelab.llm import license_scan as ls
from exposurelab.llm.license_rules import RULES

from .helpers import no_docs, odd_docs

PARSED = ls.parse_rules(RULES)


def labels(text):
    _, phrases, found = ls.Scanner(PARSED, ls.PHRASES).scan(text.encode())
    return [p[0] for p in phrases], [d.label for d in found]


@pytest.mark.parametrize(
    "text, phrases, found",
    [
        ("Released under the MIT License.", [], ["mit"]),
        ("Er kommt mit. Lizenz mit allem.", [], []),
        ("Licensed under the Apache License, Version 2.0.", [], ["apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by"], ["cc-by-nc-4.0"]),
        ("CC BY 4.0, then CC BY-SA", ["cc-by", "cc-by"], ["cc-by-4.0", "cc-by-sa"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl"], ["gpl-3.0"]),
        ("Copyright (c) 2019-2021 The Authors. All rights reserved.", ["reserved"], ["copyright"]),
        ("All Rights\n\nReserved", ["reserved"], []),
        ("SPDX-License-Identifier: BSD-3-Clause", [], ["bsd-3-clause"]),
        ("GNU Lesser General Public License v2.1", ["gpl"], ["lgpl-2.1"]),
        ("écc by", [], []),
        ("https://creativecommons.org/licenses/by-sa/4.0/", [], ["cc-by-sa-4.0"]),
        ("", [], []),
        ("!!! ...", [], []),
    ],
)
def test_texts(text, phrases, found):
    assert labels(text) == (phrases, found)


def test_hundreds_of_rules_and_no_label_without_its_words():
    assert len(PARSED) > 250
    with pytest.raises(ValueError):
        ls.parse_rules("mit | 9 | mit | mit license")
    with pytest.raises(ValueError):
        ls.parse_rules("no rule at all")


def samples(rule):
    """Texts a rule matches: options left out or taken, first or last choice."""
    for keep, choice in ((True, 0), (True, -1), (False, 0), (False, -1)):
        text = rule.pattern[4:-2].replace("  ", " ")
        text = re.sub(r"\(\?:\[\^ \]\+ \)\{\d,\d+\}\??", "some ", text)
        text = text.replace("[sc]", "s" if choice else "c").replace("[0-9]{4}", "2020").replace("\\", "")
        text = re.sub(r"\{0,2\}", "?", text)
        text = re.sub(r"\[([^\]]+)\]", lambda m: m.group(1)[choice], text)
        while (new := re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m.group(2) and not keep else m.group(1).split("|")[choice], text)) != text:
            text = new
        yield re.sub(r"(\w)\?", r"\1" if keep else "", text)


@pytest.mark.parametrize("rule", PARSED, ids=[f"{i}-{r.label}" for i, r in enumerate(PARSED)])
def test_keywords_are_in_every_match(rule):
    """The prefilter never hides a match: what a rule matches holds all its keywords."""
    for text in samples(rule):
        words = text.encode().split()
        assert re.search(rule.pattern.encode(), ls.joined(words)), text
        assert rule.keywords <= set(words), text


def by_pairs(found):
    def beats(e, d):
        if e is d or e.start > d.start or e.end < d.end or e.priority < d.priority:
            return False
        sizes = e.end - e.start, d.end - d.start
        return e.priority > d.priority or sizes[0] > sizes[1] or sizes[0] == sizes[1] and e.order < d.order

    return {d for d in found if not any(beats(e, d) for e in found)}


def test_suppression_against_all_pairs():
    rng = random.Random(7)
    for _ in range(300):
        found = []
        for order in range(rng.randrange(12)):
            start = rng.randrange(8)
            found.append(ls.Detection(start, start + rng.randrange(1, 7), rng.randrange(1, 5), order, "x"))
        assert set(ls.resolved(found)) == by_pairs(found)


def test_a_long_text_keeps_all_places():
    n, phrases, found = ls.Scanner(PARSED, ls.PHRASES).scan(b"All rights reserved. " * 50_000)
    assert n == 150_000 and len(phrases) == 50_000 and phrases[-1] == ("reserved", 149_997, 150_000)
    n, _, found = ls.Scanner(PARSED, ls.PHRASES).scan(b"MIT License " * 20_000)
    assert [d.start for d in found] == list(range(0, 40_000, 2))


def test_odd_documents(spark):
    rows = ls.scan(odd_docs(spark)).collect()
    assert len(rows) == 10 and sum(r["id"] is None for r in rows) == 3
    empty = next(r for r in rows if r["id"] == 3)
    assert (empty["n_words"], empty["phrases"], empty["detections"], empty["score"]) == (0, [], [], 0.0)
    assert next(r for r in rows if r["id"] == 5)["n_words"] == 60_000
    assert ls.scan(no_docs(spark)).count() == 0


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, "Use it, Bob's way.")], "doc_id long, text string")
    rules = ls.parse_rules("bob | 2 | bob | (?:use it )?bob s way")
    row = ls.scan(docs, rules=rules, phrases={"use it": "use"}).first()
    assert [s["label"] for s in row["detections"]] == ["bob"] and row["detections"][0]["end"] == 5
    assert row["phrases"][0]["end"] == 2 and row["score"] == 0.8
