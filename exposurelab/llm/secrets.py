"""Secrets in texts: patterns, and windows of high entropy in candidate strings.

Everything is DataFrame functions.  Places of matches come from splitting a text at
a pattern: the lengths of the pieces between matches and of the matches add up to
offsets.  Entropy slides over a candidate one character at a time: a table of counts
and the sum of c*log2(c) over it change only for the character that enters and the
one that leaves.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# The base patterns, the group that is measured, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# The same matches as the base patterns, with the least length where that changes nothing
# else: a run that is too short holds no other match.
SEARCHED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of one class of characters and the entropy that a window has to reach."""

    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-Fa-f]{32,}", 32, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
# Candidates that are not secrets: one repeated unit, words without digits, documented examples, digits alone.
ALLOWED = (
    r"^(.{1,4})\1+.{0,3}$",
    r"^[A-Za-z=_/+-]*$",
    r"^[0-9]*$",
    r"(?i)example|sample|placeholder|lorem|xxxx",
)


CHANGES = "array<struct<code:int,by:int,i:int>>"
SPANS = "array<struct<start:int,kind:string,end:int,match:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches_any(text: Column, patterns) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Structs ``start, kind, end, match`` of the non-overlapping matches, by start.

    Matches whose ``group`` is shorter than ``least`` are dropped after matching.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # The piece before each match and the match itself; what follows the last match is cut off.
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))

    def spans(zipped):
        ends = running_sums(F.transform(zipped, lambda z: F.length(z["piece"]) + F.length(z["match"])))
        numbered = F.transform(zipped, lambda z, i: F.struct(z.alias("z"), i.alias("i")))
        kept = F.filter(numbered, lambda x: F.length(x["z"]["measured"]) >= least)

        def placed(x, all_ends):
            end = F.get(all_ends, x["i"])
            return F.struct(
                (end - F.length(x["z"]["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["z"]["match"].alias("match")
            )

        return once(ends, lambda all_ends: F.transform(kept, lambda x: placed(x, all_ends)))

    return once(F.arrays_zip(pieces.alias("piece"), found.alias("match"), groups.alias("measured")), spans)


def once(value: Column, function) -> Column:
    """``function`` of a variable that holds ``value``, so that it is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), function), 1)


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each element: every round adds the element twice as far back.

    The rounds are the logarithm of the length, so texts with very many matches
    cost little more per match than others.
    """
    # A last round that reaches back beyond the start adds nothing.
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int"))

    def add(sums, j):
        back = F.pow(F.lit(2.0), j).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(rounds, numbers, add)


def in_order(spans: Column, classes=CLASSES) -> Column:
    """Spans by start, then kind as listed: base patterns, then entropy classes."""
    order = F.array(*[F.lit(b[0]) for b in BASE], *[F.lit(c.kind) for c in classes])
    ranked = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s.alias("span"))
    )
    return F.transform(F.array_sort(ranked), lambda r: r["span"])


def hot_stretch(chars: Column, window: int, bits: float) -> Column:
    """``first, last`` start of the windows whose Shannon entropy reaches ``bits``, or nulls.

    With n = ``window``, entropy is log2(n) - S/n for S = sum of c*log2(c) over the
    counts c.  A table of counts, one for each distinct character, slides along: a
    step lets one character enter, or one leave before the next enters, and changes
    one count and its part of S.  ``chars`` has to be a variable of a lambda, so that it
    is not made anew in every step.
    """
    most = float(window) * (F.log2(F.lit(float(window))) - F.lit(float(bits)))

    def part(count):
        return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))

    def coded(known):
        codes = F.transform(chars, lambda c: F.array_position(known, c).cast("int"))
        return once(codes, lambda numbers: slide(numbers, F.size(known)))

    def slide(codes, n):
        def change(code, by, i):
            return F.struct(code.alias("code"), F.lit(by).alias("by"), i.alias("i"))

        enter = F.transform(codes, lambda code, i: change(code, 1, i + 1 - window))
        leave = F.transform(codes, lambda code, i: change(code, -1, F.lit(-1)))
        # The first window fills up; from then on one leaves before one enters.
        turns = F.flatten(F.transform(
            F.arrays_zip(leave.alias("out"), F.slice(enter, window + 1, F.size(codes)).alias("into")),
            lambda both: F.when(both["into"].isNotNull(), F.array(both["out"], both["into"])).otherwise(F.array().cast(CHANGES)),
        ))

        def step(state, turn):
            count = F.element_at(state["counts"], turn["code"])
            s = state["s"] + part(count + turn["by"]) - part(count)
            hot = (turn["i"] >= 0) & (s <= most + 1e-9)
            return F.struct(
                s.alias("s"),
                F.concat(
                    F.slice(state["counts"], 1, turn["code"] - 1), F.array(count + turn["by"]),
                    F.slice(state["counts"], turn["code"] + 1, n),
                ).alias("counts"),
                F.when(hot, F.least(state["first"], turn["i"])).otherwise(state["first"]).alias("first"),
                F.when(hot, turn["i"]).otherwise(state["last"]).alias("last"),
            )

        none = F.struct(
            F.lit(0.0).alias("s"), F.array_repeat(F.lit(0), n).alias("counts"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(
            F.concat(F.slice(enter, 1, window), turns), none, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
        )

    return once(F.array_distinct(chars), coded)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``id, base, added``: arrays of spans ``start, kind, end, match`` in code points, end exclusive.

    ``base`` holds the pattern matches by start, then kind as listed.  ``added``
    holds, for each candidate of a class, the stretch from the first to the last
    window that reaches the entropy of the class, unless the candidate meets an
    ``allowed`` pattern or the stretch lies inside a base match or a stretch of an
    earlier class.  Null texts count as empty; rows come back as often as they came.
    """
    rows = id_and_text(docs, id_col, text_col)
    arrays = []
    for kind, pattern, group, least in BASE:
        spans = matches(F.col("text"), SEARCHED.get(kind, pattern), group, least, kind)
        # Most texts hold no match: one search, without offsets, tells.
        arrays.append(F.when(F.col("text").rlike(SEARCHED.get(kind, pattern)), spans).otherwise(no_spans()).alias(f"_{kind}"))
    for c in classes:
        arrays.append(
            F.when(F.col("text").rlike(c.pattern), matches(F.col("text"), c.pattern, 0, c.window, c.kind)).otherwise(no_spans()).alias(f"_{c.kind}")
        )
    found = rows.select("id", *arrays)
    found = found.withColumn("base", in_order(F.concat(*[F.col(f"_{b[0]}") for b in BASE])))
    added = no_spans()
    for c in classes:
        candidates = F.filter(f"_{c.kind}", lambda s: ~matches_any(s["match"], allowed))
        spelled = F.transform(candidates, lambda s: F.struct(s.alias("s"), F.split(s["match"], "").alias("chars")))
        hot = F.transform(
            spelled, lambda x: F.struct(x["s"].alias("s"), hot_stretch(x["chars"], c.window, c.bits).alias("h"))
        )
        hot = F.filter(hot, lambda x: x["h"]["first"].isNotNull())
        spans = F.transform(
            hot,
            lambda x: F.struct(
                (x["s"]["start"] + x["h"]["first"]).alias("start"), F.lit(c.kind).alias("kind"),
                (x["s"]["start"] + x["h"]["last"] + c.window).alias("end"),
                F.substring(x["s"]["match"], x["h"]["first"] + 1, x["h"]["last"] - x["h"]["first"] + c.window).alias("match"),
            ),
        )
        found = found.withColumn(f"_new_{c.kind}", spans)
        covering = F.concat(F.col("base"), added)
        fresh = F.filter(
            f"_new_{c.kind}",
            lambda s: ~F.exists(covering, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
        )
        found = found.withColumn(f"_added_{c.kind}", fresh)
        added = F.concat(added, F.col(f"_added_{c.kind}"))
    return found.select("id", "base", in_order(added, classes).alias("added"))
