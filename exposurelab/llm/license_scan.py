"""License detection by ordered signature rules.

A text is reduced to its words.  The words it holds decide which rules can match at all;
only these run.  Where detections overlap, one that lies inside another of the same or a
higher priority is suppressed.  Phrases are found besides, and stay whatever the rules say.
"""

import re
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, quoted, terms_of
from .license_rules import RULES

# The phrases that are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# How sure a detection makes, by priority; phrases alone.
CONFIDENCE = {1: 0.4, 2: 0.6, 3: 0.9, 4: 1.0}
PHRASE_CONFIDENCE = 0.8
SPAN = "array<struct<label: string, start: int, end: int>>"


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: frozenset[bytes]
    pattern: str


class Detection(NamedTuple):
    start: int  # first word
    end: int  # word after the last one
    priority: int
    order: int
    label: str


def parse_rules(text: str) -> tuple[Rule, ...]:
    """Rules in order, from lines of ``label | priority | keywords | regex``."""
    rules = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, priority, keywords, regex = (x.strip() for x in line.split(" | ", 3))
            if int(priority) not in CONFIDENCE or not keywords:
                raise ValueError(f"no rule: {line}")
            rules.append(Rule(label, int(priority), frozenset(keywords.encode().split()), spaced(regex)))
    return tuple(rules)


def spaced(regex: str) -> str:
    """The regex for joined words: every word there has a blank of its own on either side."""
    return " (?:" + regex.replace(" ", "  ") + ") "


def joined(words: list[bytes]) -> bytes:
    return b" " + b"  ".join(words) + b" "


class Scanner:
    """Rules and phrases, compiled; built once per worker process."""

    def __init__(self, rules: Sequence[Rule], phrases: dict[str, str]):
        self.rules = [(i, r, re.compile(r.pattern.encode())) for i, r in enumerate(rules)]
        self.phrases = [(frozenset(p.encode().split()), re.compile(spaced(re.escape(p).replace("\\ ", " ")).encode()), label) for p, label in phrases.items()]
        # A rule is looked at where the first of its keywords occurs.
        self.gates: dict[bytes, list] = {}
        for entry in self.rules:
            self.gates.setdefault(min(entry[1].keywords, key=lambda w: (-len(w), w)), []).append(entry)
        self.openers = frozenset(self.gates) | {w for words, _, _ in self.phrases for w in words}

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[Detection]]:
        """Number of words, places of phrases (label, start, end), and the detections that stand."""
        words = terms_of(text)
        present = set(words)
        hints = present & self.openers
        if not hints:
            return len(words), [], []
        phrases = [(regex, label) for needed, regex, label in self.phrases if needed <= present]
        rules = [entry for w in hints for entry in self.gates.get(w, ()) if entry[1].keywords <= present]
        if not phrases and not rules:
            return len(words), [], []
        whole = joined(words)
        places = sorted((start, end, label) for regex, label in phrases for start, end in matches(regex, whole))
        found = [
            Detection(start, end, rule.priority, order, rule.label)
            for order, rule, regex in rules
            for start, end in matches(regex, whole)
        ]
        return len(words), [(label, start, end) for start, end, label in places], resolved(found)


def matches(regex: re.Pattern, whole: bytes):
    """Words from and to of each match, left to right."""
    at = word = 0
    for match in regex.finditer(whole):
        word += whole.count(b" ", at, match.start()) // 2
        size = whole.count(b" ", match.start(), match.end()) // 2
        yield word, word + size
        word += size
        at = match.end()


def resolved(found: list[Detection]) -> list[Detection]:
    """Detections that lie in no other one of the same or a higher priority; of equal ones the first rule's.

    One pass in order of their starts: of every priority only the furthest end counts.
    """
    reach = dict.fromkeys(CONFIDENCE, -1)
    kept = []
    for d in sorted(found, key=lambda d: (d.start, -d.end, -d.priority, d.order)):
        if all(reach[p] < d.end for p in reach if p >= d.priority):
            kept.append(d)
        reach[d.priority] = max(reach[d.priority], d.end)
    return kept


@cache
def scanner_of(rules: tuple[Rule, ...] | None, phrases: tuple) -> Scanner:
    return Scanner(parse_rules(RULES) if rules is None else rules, dict(phrases))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``id, n_words, phrases, detections, score`` of every document, in word numbers.

    ``rules`` defaults to the signatures of ``license_rules``.  ``score`` is the confidence
    of the surest detection or phrase, 0 without any.  Null texts are empty and have no
    words; null ids stay; repeated rows are scanned as often as they come; texts are
    whole, whatever their length; an empty table gives no rows.
    """
    key = (None if rules is None else tuple(rules), tuple(phrases.items()))
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"))

    def run(part):
        scanner = scanner_of(*key)
        made = []
        for name, text in part:
            n, places, found = scanner.scan(text)
            sure = [CONFIDENCE[d.priority] for d in found] + [PHRASE_CONFIDENCE] * bool(places)
            made.append((name, n, named(places), named([(d.label, d.start, d.end) for d in found]), max(sure, default=0.0)))
        return made

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, run, f"id {kind}, n_words long, phrases {SPAN}, detections {SPAN}, score double")


def named(spans: list[tuple]) -> list[dict]:
    return [{"label": label, "start": start, "end": end} for label, start, end in spans]
