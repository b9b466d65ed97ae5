"""Counts of terms by class and fold, in numpy over packed blocks of terms.

The terms of a few texts travel as one row per part of the hash space: of every term 12 bytes, which
are 88 bits of hash and its n-gram size, and its number.  A part's task sorts its terms once and gives back, per text,
which counts its terms have elsewhere.  The hash space may be gone through in rounds, so that only
a share of the terms lies in shuffle files at a time; every round counts all texts.
"""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import scratch_path
from ..sources.sinks import materialize

# Terms that a task unpacks at a time, repeated terms and log sums that it looks at together.
CHUNK_TERMS = 2_000_000
SLICE_TERMS = 100_000
SLICE_ROWS = 4_096
SLICE_KEYS = 4_096
# The largest count whose place is looked up in a table.
MOST_TABLE = 1 << 24

MASK = (1 << 64) - 1

# Columns of the listed form: one row per text, with the hashes of its tokens in their order.
LISTED = ["low", "high", "words"]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, and not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def place(c: str, values: Sequence) -> Column:
    """The place of a value in a list; what the list does not have gets its length."""
    return F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))


@dataclass(frozen=True)
class Cells:
    """Terms are counted by fold and class, with one more fold and class for all others.

    Texts of a fold are held against all other folds, and texts of the fold after the others (``held``),
    which are not counted, against all that are.
    """

    folds: int
    classes: int

    @property
    def held(self) -> int:
        return self.folds + 1

    @property
    def count(self) -> int:
        return (self.folds + 2) * (self.classes + 1)

    def cell(self, label: str, classes: Sequence, fold: str | None = None, folds: Sequence = (), held: Column | None = None) -> Column:
        """Fold and class as one number."""
        f = F.lit(0) if fold is None else place(fold, folds)
        f = f if held is None else F.when(held, F.lit(self.held)).otherwise(f)
        return f * (self.classes + 1) + place(label, classes)


@dataclass(frozen=True)
class Known:
    """``rows(key, held, small, large)``: per text, ``size, n, k0, k1, ...`` for each known term, one after the other.

    ``small`` has those of at most 255 in a byte each.  The totals are by n-gram size.
    """

    rows: DataFrame
    words: dict[int, np.ndarray]  # occurrences by fold and class, without those held
    vocabulary: dict[int, np.ndarray]  # terms that other folds have, by fold; then all terms


def known_terms(counts: DataFrame, key: str, cell: Column, cells: Cells, partitions: int | None = None, rounds: int = 1) -> Known:
    """All terms of ``counts`` held against the other folds.

    ``counts`` has a row per (text, term) with ``term``, ``n`` and perhaps ``size``, or the listed form.
    """
    spark = counts.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-parts // rounds))
    if "words" in counts.columns:
        rows = counts.select(F.col(key).alias("_key"), cell.cast("int").alias("cell"), *LISTED)
    else:
        size = F.col("size") if "size" in counts.columns else F.lit(0)
        rows = counts.filter(F.col("term").isNotNull()).select(
            F.col(key).alias("_key"), cell.cast("int").alias("cell"), size.cast("int").alias("size"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.xxhash64("term").alias("term_a"), F.hash("term").alias("term_b"),
        )
    kind = rows.schema["_key"].dataType
    block = StructType([
        StructField("part", IntegerType()), StructField("keys", ArrayType(kind)), StructField("cells", ArrayType(IntegerType())),
        StructField("runs", ArrayType(IntegerType())), StructField("width", IntegerType()), StructField("block", BinaryType()),
    ])
    found = StructType([
        StructField(key, kind), StructField("held", BooleanType()), StructField("small", BinaryType()),
        StructField("large", ArrayType(LongType())), StructField("stats", ArrayType(LongType())),
    ])
    path, arrow = scratch_path(spark, "terms"), to_arrow_type(kind)
    made = []
    for number in range(rounds):
        blocks = rows.mapInArrow(_packer(parts, rounds, number), block).repartitionById(parts, F.col("part"))
        with shuffles_removed(spark):
            made.append(materialize(blocks.mapInArrow(_counter(cells, key, arrow), found), f"{path}/{number}"))
    every = made[0]
    for other in made[1:]:
        every = every.unionByName(other)
    counted = (cells.folds + 1) * (cells.classes + 1)
    sums = (
        every.filter("stats is not null").select(F.col("stats")[0].alias("size"), F.posexplode(F.slice("stats", 2, counted + cells.folds + 1)))
        .groupBy("size", "pos").agg(F.sum("col").alias("n")).collect()
    )
    totals: dict[int, np.ndarray] = {}
    for r in sums:
        totals.setdefault(r["size"], np.zeros(counted + cells.folds + 1, np.int64))[r["pos"]] = r["n"]
    return Known(
        every.filter("stats is null").drop("stats"),
        {s: t[:counted].reshape(cells.folds + 1, cells.classes + 1) for s, t in totals.items()},
        {s: t[counted:] for s, t in totals.items()},
    )


# ---- packing -------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits stirred, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _sized(b: np.ndarray, size) -> np.ndarray:
    """The second hash with the n-gram size in its last byte."""
    return (b & np.uint32(0xFFFFFF00)) | np.asarray(size, np.uint32)


def _in_round(a: np.ndarray, rounds: int, number: int) -> np.ndarray:
    """The terms whose turn it is, by the upper bits of their hash."""
    low, high = (number << 64) // rounds, ((number + 1) << 64) // rounds
    return (a >= np.uint64(low)) & (a <= np.uint64(high - 1))


def _rows(batch: pa.RecordBatch, rounds: int, number: int):
    """Text, hashes and number of the terms of a batch of rows."""
    whole = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("term_a", "term_b", "size", "n")}
    a, b, size = whole["term_a"].view(np.uint64), whole["term_b"].view(np.uint32), whole["size"]
    if len(size) and not 0 <= size.min() <= size.max() < 256:
        raise ValueError("sizes of n-grams are 0 to 255")
    at = np.flatnonzero(_in_round(a, rounds, number))
    yield at, a[at], _sized(b[at], size[at]), whole["n"][at]


def _grams(batch: pa.RecordBatch, rounds: int, number: int):
    """The same of all n-grams of texts in the listed form; a word that a text repeats is one row."""
    low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
    lists = batch.column("words")
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    rows = 0
    while rows < len(lists):
        # As many texts as make a chunk, one at least.
        sizes = np.cumsum((at[rows + 1 :] - at[rows:-1]) * (high[rows:] - low[rows:] + 1))
        end = rows + max(1, int(np.searchsorted(sizes, CHUNK_TERMS, "right")))
        words = flat[at[rows] : at[end]]
        lengths = at[rows + 1 : end + 1] - at[rows:end]
        text = np.repeat(np.arange(rows, end), lengths)
        # Words from here to the end of the text.
        rest = np.repeat(at[rows + 1 : end + 1] - at[rows], lengths) - np.arange(len(words))
        least, most = int(low[rows:end].min()), int(high[rows:end].max())
        alike = low[rows:end].max() == least and high[rows:end].min() == most
        found, gram = [], words
        for size in range(1, most + 1):
            if size > 1:
                gram = _mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[size - 1 :])
            if not len(gram):
                break
            if size < least:
                continue
            there = rest[: len(gram)] >= size
            if rounds > 1:
                there &= _in_round(gram, rounds, number)
            if not alike:
                there &= (low[text[: len(gram)]] <= size) & (size <= high[text[: len(gram)]])
            spots = np.flatnonzero(there)
            a, b, of = gram[spots], np.zeros(len(spots), np.uint64), text[spots]
            for i in range(size):
                b += words[spots + i] * np.uint64((0xD1B54A32D192ED03 * (2 * i + 1) ^ (0x2545F4914F6CDD1D << i)) & MASK | 1)
            b = _sized((_mixed(b) >> np.uint64(32)).astype(np.uint32), size)
            n = np.ones(len(a), np.int64)
            if size == 1 and len(a):
                # Equal words of a text lie together by this hash; any that do not are only not put together.
                together = a ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(together)
                a, b, of = a[order], b[order], of[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (of[1:] != of[:-1])
                starts = np.flatnonzero(new)
                n = np.diff(np.append(starts, len(a)))
                a, b, of = a[starts], b[starts], of[starts]
            found.append((of, a, b, n))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))
        rows = end


def _packer(parts: int, rounds: int, number: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = batch.column("_key"), batch.column("cell").to_numpy()
            for text, a, b, n in (_grams if "words" in batch.schema.names else _rows)(batch, rounds, number):
                if not len(a):
                    continue
                part = ((a & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                both = part * batch.num_rows + text
                order = np.argsort(both)
                both, a, b, n = (x[order] for x in (both, a, b, n))
                starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                part, text = np.divmod(both[starts], batch.num_rows)
                # Parts have runs of texts, and runs have terms.
                used, at = np.unique(part, return_index=True)
                lists = pa.array(np.append(at, len(starts)), pa.int32())
                at = starts[at]
                ends = np.append(at[1:], len(a))
                width = 1 if n.min() >= 0 and n.max() < 1 << 8 else 8
                n = n.astype(np.uint8 if width == 1 else np.int64)
                blocks = [b"".join(x[i:j].tobytes() for x in (a, b, n)) for i, j in zip(at, ends)]
                runs = np.diff(np.append(starts, len(a)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()), pa.ListArray.from_arrays(lists, keys.take(pa.array(text))),
                        pa.ListArray.from_arrays(lists, pa.array(cells[text], pa.int32())),
                        pa.ListArray.from_arrays(lists, pa.array(runs, pa.int32())),
                        pa.array(np.full(len(used), width), pa.int32()), pa.array(blocks, pa.binary()),
                    ],
                    ["part", "keys", "cells", "runs", "width", "block"],
                )

    return pack


# ---- counting --------------------------------------------------------------------------

def _counter(cells: Cells, key: str, kind: pa.DataType):
    names = [key, "held", "small", "large", "stats"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, runs, packed = [], [], [], []
        for batch in batches:
            keys.append(batch.column("keys").flatten())
            groups.append(batch.column("cells").flatten().to_numpy())
            runs.append(batch.column("runs").flatten().to_numpy())
            lengths = [int(x.sum()) for x in np.split(runs[-1], np.cumsum(batch.column("runs").value_lengths().to_numpy())[:-1])]
            for block, e, width in zip(batch.column("block"), lengths, batch.column("width").to_pylist()):
                raw = np.frombuffer(block.as_buffer(), np.uint8)
                packed.append((
                    raw[: 8 * e].view(np.uint64), raw[8 * e : 12 * e].view(np.uint32),
                    raw[12 * e :].view(np.uint8 if width == 1 else np.int64).astype(np.int64),
                ))
        if not packed:
            return
        a, b, n = (np.concatenate(x) for x in zip(*packed))
        packed.clear()
        groups, runs = np.concatenate(groups), np.concatenate(runs)
        text = np.repeat(np.arange(len(runs), dtype=np.int32), runs)
        for stats, columns in _counted(cells, pa.concat_arrays(keys), groups, text, a, b, n):
            rows = len(columns[0]) if columns else len(stats)
            none = [pa.nulls(rows, t) for t in (kind, pa.bool_(), pa.binary(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(columns or none), pa.nulls(rows, none[3].type) if stats is None else stats], names)

    return count


def _longs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel(), pa.int64()))


def _counted(cells: Cells, keys: pa.Array, groups, text, a, b, n):
    """The totals of all sizes, then the columns of texts with known terms."""
    folds, classes, wide = cells.folds, cells.classes, cells.count
    order = np.argsort(a)
    same = (sorted_a := a[order])[1:] == sorted_a[:-1]
    other = (sorted_b := b[order])[1:] != sorted_b[:-1]
    if (same & other).any():
        order = np.lexsort((b, a))
        other = (sorted_b := b[order])[1:] != sorted_b[:-1]
    starts = np.flatnonzero(np.append(True, ~same | other))
    size = (sorted_b & np.uint32(0xFF)).astype(np.int64)
    del a, b, sorted_a, sorted_b, same, other
    text, n = text[order], n[order]
    cell = groups.astype(np.int64)[text]
    lengths = np.diff(np.append(starts, len(text)))
    high = int(size.max()) + 1
    by_place = lambda at, weights: np.bincount(size[at] * wide + cell[at], weights, high * wide).reshape(high, folds + 2, classes + 1)[:, : folds + 1]
    words = by_place(slice(None), n).astype(np.int64).reshape(high, -1)
    terms = np.zeros((high, folds + 1), np.int64)
    # Terms of one row only: the vocabularies of the other folds have them.
    alone = starts[lengths == 1]
    single = by_place(alone, None)
    named = by_place(alone, n[alone] > 0)[:, :, :classes].sum(2)
    terms[:, :folds] = named.sum(1)[:, None] - named[:, :folds]
    terms[:, folds] = single.sum((1, 2))
    # The others, some at a time.
    many = np.repeat(lengths > 1, lengths)
    text, size, n, cell = text[many], size[many], n[many], cell[many]
    lengths = lengths[lengths > 1]
    ends = np.cumsum(lengths)
    texts, found = [], []
    for first in range(0, len(lengths), SLICE_TERMS):
        last = min(first + SLICE_TERMS, len(lengths))
        rows = slice(int(ends[first] - lengths[first]), int(ends[last - 1]))
        c, s, t = cell[rows], size[rows], n[rows]
        spot = np.repeat(np.arange(last - first), lengths[first:last])
        table = np.bincount(spot * wide + c, t, (last - first) * wide).reshape(-1, folds + 2, classes + 1)
        table[:, cells.held] = table[:, : folds + 1].sum(1)
        outside = table[:, cells.held, None, :classes] - table[:, :folds, :classes]
        there = outside.sum(2) > 0
        counted = np.zeros(last - first, bool)
        counted[spot[c < cells.held * (classes + 1)]] = True
        sizes = s[ends[first:last] - lengths[first:last] - rows.start]
        for z in np.unique(sizes):
            terms[z, :folds] += there[sizes == z].sum(0)
            terms[z, folds] += counted[sizes == z].sum()
        fold = c // (classes + 1)
        # Texts of folds, and those held: against all.
        for own, k in (
            ((at := np.flatnonzero(fold < folds))[there[spot[at], fold[at]]], lambda own: outside[spot[own], fold[own]]),
            ((at := np.flatnonzero(fold == cells.held))[counted[spot[at]]], lambda own: table[spot[own], cells.held, :classes]),
        ):
            texts.append(text[rows][own])
            found.append(np.column_stack([s[own], t[own], k(own).astype(np.int64)]))
    stats = np.column_stack([np.arange(high), words, terms])[words.sum(1) + terms.sum(1) > 0]
    yield _longs(stats, np.arange(len(stats) + 1) * stats.shape[1]), None
    if not found:
        return
    text, found = np.concatenate(texts), np.concatenate(found)
    if keys.null_count:
        keyed = keys.is_valid().to_numpy(zero_copy_only=False)[text]
        text, found = text[keyed], found[keyed]
    order = np.argsort(text, kind="stable")
    text, found = text[order], found[order]
    large = found.max(1, initial=0) > 255
    small, large = (text[~large], found[~large].astype(np.uint8)), (text[large], found[large])
    every = np.unique(text)
    for first in range(0, len(every), SLICE_KEYS):
        mine = every[first : first + SLICE_KEYS]
        at = [np.append(np.searchsorted(x, mine), np.searchsorted(x, mine[-1], "right")) for x in (small[0], large[0])]
        ends = [(x - x[0]) * (2 + classes) for x in at]
        held = groups[mine] // (classes + 1) == cells.held
        data = small[1][at[0][0] : at[0][-1]].tobytes()
        yield None, [
            keys.take(pa.array(mine)), pa.array(held),
            pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(ends[0].astype(np.int32).tobytes()), pa.py_buffer(data)]),
            _longs(large[1][at[1][0] : at[1][-1]], ends[1]),
        ]


def _entries(small: pa.Array, large: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of every known term, and ``size, n, k0, k1, ...``."""
    wide, at = 2 + classes, np.arange(len(small))
    lengths = pc.binary_length(small).fill_null(0).to_numpy()
    bounds = np.frombuffer(small.buffers()[1], np.int32)[small.offset : small.offset + len(small) + 1]
    data = np.frombuffer(small.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if lengths.sum() else np.zeros(0, np.uint8)
    more = large.value_lengths().fill_null(0).to_numpy()
    rows = np.concatenate([data.reshape(-1, wide).astype(np.int64), large.flatten().to_numpy().reshape(-1, wide)])
    return np.concatenate([np.repeat(at, lengths // wide), np.repeat(at, more // wide)]), rows


# ---- sums of logarithms ------------------------------------------------------------------

def log_sums(known: Known, key: str, classes: int, alpha: float, low: int, high: int) -> DataFrame:
    """Per text that is held the occurrences ``_n`` of known terms and the sums ``_s0, ...`` of ``n log(k + alpha)``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _entries(batch.column("small"), batch.column("large"), classes)
            pick = (low <= rows[:, 0]) & (rows[:, 0] <= high)
            at, rows = at[pick], rows[pick]
            total = lambda x: np.bincount(at, x, batch.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(total(rows[:, 1]).astype(np.int64)),
                    *[pa.array(total(rows[:, 1] * np.log(rows[:, 2 + i] + alpha))) for i in range(classes)],
                ],
                [key, "_n", *[f"_s{i}" for i in range(classes)]],
            )

    fields = [known.rows.schema[key], StructField("_n", LongType()), *[StructField(f"_s{i}", DoubleType()) for i in range(classes)]]
    parts = known.rows.filter("held").select(key, "small", "large").mapInArrow(sums, StructType(fields))
    return parts.groupBy(key).agg(F.sum("_n").alias("_n"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(classes)])


@dataclass(frozen=True)
class Settings:
    """What the grid tries, with the words, vocabularies and priors that each fold is held against."""

    ranges: list[tuple[int, int]]
    smoothing: list[float]
    words: np.ndarray  # range, fold, class
    vocabulary: np.ndarray  # range, fold
    priors: np.ndarray  # fold, class: logarithms


def hits(known: Known, docs: DataFrame, key: str, settings: Settings, partitions: int) -> DataFrame:
    """``range, fold, fit_prior, alpha_index``: the texts (``_rows``) and those put into their class (``_hits``).

    ``docs`` has ``key``, the place of the class ``_class`` (minus one for none) and ``_fold``.  A text's terms meet
    again before their sums are made, so no row of sums is shuffled.
    """
    terms = known.rows.filter(~F.col("held")).select(key, "small", "large")
    both = terms.unionByName(docs.select(key, "_class", "_fold"), allowMissingColumns=True)
    schema = "range int, fold int, fit_prior boolean, alpha_index int, _hits bigint, _rows bigint"
    found = both.repartition(partitions, key).mapInArrow(_scorer(key, settings), schema)
    return found.groupBy("range", "fold", "fit_prior", "alpha_index").agg(F.sum("_hits").alias("_hits"), F.sum("_rows").alias("_rows"))


def _scorer(key: str, settings: Settings):
    folds, classes = settings.priors.shape
    low = min(lo for lo, _ in settings.ranges)
    sizes, alphas = max(hi for _, hi in settings.ranges) - low + 1, np.array(settings.smoothing)
    firsts: dict[int, dict[int, int]] = {}
    for r, (lo, hi) in enumerate(settings.ranges):
        firsts.setdefault(lo, {})[hi] = r
    with np.errstate(divide="ignore"):
        wholes = np.log(settings.words[..., None] + alphas * settings.vocabulary[:, :, None, None])
    # Without words and terms there is no logarithm and no score.
    wholes[np.isneginf(wholes)] = np.nan

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        code = table.column(key).combine_chunks().dictionary_encode().indices
        none = len(table)  # a null key meets no terms
        code = code.fill_null(none).to_numpy().astype(np.int64)
        label = table.column("_class").combine_chunks()
        is_doc = label.is_valid().to_numpy(zero_copy_only=False)
        doc, right = code[is_doc], label.drop_null().to_numpy()
        fold = table.column("_fold").combine_chunks().drop_null().to_numpy()
        at, rows = _entries(table.column("small").combine_chunks(), table.column("large").combine_chunks(), classes)
        of = code[at]
        pick = (rows[:, 0] >= low) & (rows[:, 0] < low + sizes)
        group = (of * sizes + rows[:, 0] - low)[pick]
        order = np.argsort(group, kind="stable")
        group, rows = group[order], rows[pick][order]
        values = np.unique(rows[:, 2:])
        spot = np.searchsorted(values, rows[:, 2:]) if len(values) and values[-1] >= MOST_TABLE else None
        if spot is None:
            place_of = np.zeros(int(values[-1]) + 1 if len(values) else 1, np.int32)
            place_of[values] = np.arange(len(values))
            spot = place_of[rows[:, 2:]]
        logs = np.log(values[:, None] + alphas[None, :])
        order = np.argsort(doc, kind="stable")
        doc, right, fold = doc[order], right[order], fold[order]
        made = np.zeros((len(settings.ranges), folds, 2, len(alphas)), np.int64)
        every, there = np.zeros(folds, np.int64), np.zeros(folds, bool)
        distinct = np.unique(doc)
        for start in range(0, len(distinct), SLICE_KEYS):
            mine = distinct[start : start + SLICE_KEYS]
            s = np.zeros((len(mine) * sizes, classes, len(alphas)))
            m = np.zeros(len(mine) * sizes)
            first, last = np.searchsorted(group, [mine[0] * sizes, (mine[-1] + 1) * sizes])
            for at in range(first, last, SLICE_ROWS):
                part = slice(at, min(at + SLICE_ROWS, last))
                g, n = group[part], rows[part, 1]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                where = np.searchsorted(mine, g[starts] // sizes)
                # Terms of a key that docs do not have are left out.
                ours = mine[np.minimum(where, len(mine) - 1)] == g[starts] // sizes
                where = (where * sizes + g[starts] % sizes)[ours]
                m[where] += np.add.reduceat(n, starts)[ours]
                for i in range(classes):
                    s[where, i] += np.add.reduceat(n[:, None] * logs[spot[part, i]], starts)[ours]
            s, m = s.reshape(len(mine), sizes, classes, len(alphas)), m.reshape(len(mine), sizes)
            a, b = np.searchsorted(doc, [mine[0], mine[-1] + 1])
            use = a + np.flatnonzero(fold[a:b] < folds)
            who, cls, f = np.searchsorted(mine, doc[use]), right[use], fold[use]
            there |= np.bincount(f, minlength=folds) > 0
            every += np.bincount(f[cls >= 0], minlength=folds)
            for lo, tried in firsts.items():
                sum_s, sum_m = np.zeros((len(mine), classes, len(alphas))), np.zeros(len(mine))
                for hi in range(lo, max(tried) + 1):
                    sum_s += s[:, hi - low]
                    sum_m += m[:, hi - low]
                    if hi not in tried:
                        continue
                    r = tried[hi]
                    words = sum_s[who] - sum_m[who][:, None, None] * wholes[r][f]
                    for p, scores in enumerate((words, words + settings.priors[f][:, :, None])):
                        best, name = scores[:, 0], np.zeros((len(who), len(alphas)), np.int8 if classes < 128 else np.int64)
                        for i in range(1, classes):
                            name[scores[:, i] > best] = i
                            best = np.fmax(best, scores[:, i])
                        right_ones = name == cls[:, None]
                        for each in range(folds):
                            made[r, each, p] += right_ones[f == each].sum(0)
        for r in range(len(settings.ranges)):
            f, p, i = (x.ravel() for x in np.indices(made.shape[1:]))
            pick = there[f]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(pick.sum(), r), pa.int32()), pa.array(f[pick], pa.int32()), pa.array(p[pick] == 1),
                    pa.array(i[pick], pa.int32()), pa.array(made[r].ravel()[pick], pa.int64()), pa.array(every[f][pick], pa.int64()),
                ],
                ["range", "fold", "fit_prior", "alpha_index", "_hits", "_rows"],
            )

    return score
