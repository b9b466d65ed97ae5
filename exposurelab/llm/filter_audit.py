"""How filters interact: removal games, their potential and every order of the filters.

Of each document only the set of filters it fails matters, so the corpus shrinks to
one count per set of failed filters.  The removal game gives a coalition of filters the
number of documents that fail any of them.  Hart and Mas-Colell's potential of that
game is found recursively over all coalitions; a filter's Shapley value is the grand
potential minus the potential without the filter.  A step of an order is the
difference of two coalitions.
"""

import hashlib
import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, quoted

# The 2 ** k coalitions are columns and the k! orders are rows.
MAX_FILTERS = 6
# Parts that rows without an id are spread over.
NAMELESS = 1_000

# The filters of the production query.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that begin no character


def failed(text: bytes) -> int:
    """Filters A to D that a text fails, as bits 0 to 3: too short, repetitive, capitals, signs."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    short = len(words) < MIN_WORDS
    repeats = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    loud = 100 * capitals > MAX_CAPITALS * len(text.translate(None, CONTINUED))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return short | repeats << 1 | loud << 2 | signs << 3


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask, digest`` of every document: the filters A to D it fails, and its text's SHA-256."""
    rows = docs.select(
        quoted(id_col).alias("id"),
        F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def run(part):
        return [(key, name, failed(text), hashlib.sha256(text).digest()) for key, name, text in part]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows, run, f"id {kind}, part string, mask int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters A to E that they fail.

    E is failed by a text that a smaller id has, too.  Copies are counted by text before
    anything is compared, so that a large group of them is a few rows per task.
    Labels that a document has several times count once.
    """
    rows = failed_filters(docs, id_col, text_col, part_col).groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    flags = (
        labels.filter(quoted(id_col).isNotNull())
        .groupBy(quoted(id_col).alias("id"))
        .agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f) for f, c in (("is_good", "quality"), ("is_toxic", "toxic"))])
    )
    # Rows without an id find no labels; spread by their text they do not meet in one task.
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NAMELESS))).otherwise(0).cast("int")
    known = rows.withColumn("salt", spread).join(flags.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    known = known.fillna(False, ["is_good", "is_toxic"])
    texts = known.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
    )
    first = F.min("first").over(Window.partitionBy("digest"))
    copies = F.col("n_known") - F.when(F.col("first") == first, F.col("n_first")).otherwise(0)
    split = texts.withColumn("copies", copies).select(
        "part", "is_good", "is_toxic",
        F.explode(
            F.array(
                F.struct("mask", (F.col("n") - F.col("copies")).alias("n")),
                F.struct((F.col("mask") + F.lit(16)).alias("mask"), F.col("copies").alias("n")),
            )
        ).alias("s"),
    )
    count = lambda flag: F.sum(F.when(flag, F.col("s.n")).otherwise(0))
    return split.filter("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), count(F.col("is_good")).alias("good"), count(F.col("is_toxic")).alias("toxic")
    )


def potentials(worth: Sequence[Column], k: int) -> list[Column]:
    """Potential of every coalition times the factorial of its size, which keeps it whole.

    P(S) = (v(S) + sum of P(S without i)) / |S|, hence Q(S) = (|S| - 1)! v(S) + sum of Q(S without i).
    """
    found = [F.lit(0).cast("long")]
    for s in range(1, 1 << k):
        own = worth[s] * F.lit(math.factorial(s.bit_count() - 1))
        found.append(sum((found[s ^ 1 << i] for i in range(k) if s >> i & 1), own))
    return found


def interactions(counts: DataFrame, filters: str = FILTERS, losses: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """Every step of every order of the filters, per part.

    ``counts`` has ``part, mask`` (filter i is bit i), ``n`` and the columns of ``losses``,
    one row per part and mask.  ``filters`` is one letter each, ``MAX_FILTERS`` at most.
    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails,
    <loss>_lost, shapley``; ``shapley`` is the Shapley value times the number of orders.
    An empty table has no parts and gives no rows.
    """
    k = len(filters)
    if not 1 <= k <= MAX_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MAX_FILTERS} different filters")
    everyone = (1 << k) - 1
    games = ["n", *losses]

    def worth(name, s):
        return F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(name)).otherwise(0))

    # Worth of each coalition in each game: documents, and those that it would be a loss to remove.
    values = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.array(*[worth(name, s) if s else F.lit(0).cast("long") for s in range(1 << k)]).alias(f"v_{name}") for name in games],
    )
    v = [F.col("v_n")[s] for s in range(1 << k)]
    potential = potentials(v, k)
    # k! times (P(N) - P(N without i)).
    shapley = [potential[everyone] - potential[everyone ^ 1 << i] * F.lit(k) for i in range(k)]
    values = values.withColumn("shapleys", F.array(*shapley))
    orders = ["".join(p) for p in permutations(filters)]
    steps = values.withColumn("filter_order", F.explode(F.lit(orders))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k)))
    )
    before = F.expr("substring(filter_order, 1, step - 1)")
    letter = F.expr("substring(filter_order, step, 1)")
    bits = lambda names: sum((F.when(F.instr(names, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("s", bits(before)).withColumn("own", bits(letter))
    with_own = F.col("s") + F.col("own")
    gained = lambda name: F.get(f"v_{name}", with_own) - F.get(f"v_{name}", F.col("s"))
    place = F.instr(F.lit(filters), letter) - 1
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v_n", with_own)).alias("kept"),
        gained("n").alias("removed"),
        (F.get("v_n", F.col("own")) - gained("n")).alias("redundant"),
        (F.get("v_n", F.lit(everyone)) - F.get("v_n", F.lit(everyone) - F.col("own"))).alias("unique_fails"),
        *[gained(name).alias(f"{name}_lost") for name in losses],
        F.get("shapleys", place).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the filters A to E on whole texts, per value of ``part_col``.

    Null texts are empty and a null part is the empty string.  A row without an id has
    no labels, fails E never and makes no other row fail it.  Rows repeated with their
    id count as often as they come and are no copies of each other.  Labels hold the
    same id, ``quality`` and ``toxic``; nulls there are neither good nor toxic.
    """
    return interactions(failure_counts(docs, labels, id_col, text_col, part_col))
