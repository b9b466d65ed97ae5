"""Long repeated substrings by run-length indexes.

A byte goes when a string of ``length`` bytes around it also starts somewhere else.
Three steps find those strings without a suffix array of the whole corpus:

1. Every start of such a string has an anchor, the smallest hash among the k-byte
   strings inside it.  Equal strings have equal anchors, so only texts around equal
   anchors need comparing.  Neighbouring starts with one anchor form a segment.
2. Segments that are equal as a whole are repeated; digests tell.
3. Different segments with equal anchors share strings in part.  Each task builds a
   run-length compressed Burrows-Wheeler transform of such segments and samples the
   suffixes at the ends of its runs.  The longest match of a suffix with a neighbour
   in sorted order is one less than that of the suffix before it, except at run
   ends.  Streaming over the text from sample to sample therefore gives the longest
   match with any other place for every position, from the samples alone.

Groups of different segments that are too large for one index are compared by
digests that Spark counts: first of what stands before and after the anchor at some
distances, then of the strings that these leave open; the result is the same.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_text, map_rows, remove, store

LENGTH = 200
GRAM = 32
CHUNK = 1 << 20
GROUP = 2_000
BATCH = 1_000_000
STEPS = 8
BLOCK = 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_tables[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            table = np.full(max(n, 1 << 16), base, np.uint64)
            table[0] = 1
            _tables[i] = np.multiply.accumulate(table)
    return _tables


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of every ``gram`` bytes, modulo 2**64."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by block-wise running minimums."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple]:
    """``anchor, digest, first start, number of starts`` of each segment of a text.

    A segment's bytes are those from its first start to ``length`` after its last.
    Chunks bound the memory for long texts; they share no start.
    """
    whole = np.frombuffer(data, np.uint8)
    starts = len(data) - length + 1
    width = length - gram + 1
    for begin in range(0, max(starts, 0), chunk):
        stop = min(begin + chunk, starts)
        h = gram_hashes(whole[begin : stop + length - 1], gram)
        # The place in the low bits makes the leftmost of equal hashes the smallest.
        ranked = (h & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        least = sliding_minimum(ranked, width)
        edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        counts = np.diff(np.append(edges, len(least)))
        anchors = h[(least[edges] & np.uint64(0xFFFFFF)).astype(np.int64)].view(np.int64)
        for anchor, first, n in zip(anchors.tolist(), (edges + begin).tolist(), counts.tolist()):
            yield anchor, signed(xxhash.xxh3_64_intdigest(data[first : first + n + length - 1])), first, n


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of an array of small numbers, by doubling until all differ."""
    n = len(text)
    # Seven characters of nine bits at once to begin with.
    h = min(7, n)
    key = np.zeros(n, np.int64)
    for i in range(h):
        key *= 1 << 9
        key[: n - i] += text[i:].astype(np.int64) + 1
    order = np.argsort(key)
    while True:
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        h *= 2


class RunIndex:
    """A run-length Burrows-Wheeler transform with the suffixes at its run ends.

    ``text`` is an array of byte values + 1 with 0 after every segment.  Only the run
    heads, run lengths and sampled suffixes with their neighbours are kept.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = -1  # nothing comes before the start, so it is a run of its own
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        ends = np.append(heads[1:], len(text)) - 1
        self.text = text
        self.heads, self.lengths = before[heads], ends - heads + 1
        # First suffix of a run with the one above it, last suffix with the one below it.
        self.first, self.above = order[heads[1:]], order[heads[1:] - 1]
        self.last, self.below = order[ends[:-1]], order[ends[:-1] + 1]

    def matches(self, ends: np.ndarray) -> np.ndarray:
        """For each place, the longest match with any other place, within segments.

        ``ends`` holds the place where the segment of each place ends.
        """
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for samples, others in ((self.first, self.above), (self.last, self.below)):
            reach = np.zeros(n, np.int64)
            reach[samples] = samples + common_prefix(self.text, samples, others)
            # From one place to the next a match loses one character, until a sample renews it.
            sampled = np.zeros(n, np.int64)
            sampled[samples] = samples + 1
            nearest = np.maximum.accumulate(sampled) - 1
            reach = np.where(nearest >= 0, reach[nearest], 0)
            best = np.maximum(best, np.minimum(reach, ends) - np.arange(n))
        return best


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes."""
    n = len(text)
    step = 16
    padded = np.concatenate([text.astype(np.int16), np.full(step, -1, np.int16)])
    view = np.lib.stride_tricks.sliding_window_view(padded, step)
    size = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        x, y = a[active] + size[active], b[active] + size[active]
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        differ = view[x] != view[y]
        any_differ = differ.any(axis=1)
        size[active] += np.where(any_differ, np.argmax(differ, axis=1), step)
        active = active[~any_differ]
    return np.minimum(size, n - np.maximum(a, b))


def repeated_starts(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of some different segments, half-open runs of starts that also start elsewhere."""
    sizes = np.array([len(p) + 1 for p in parts])
    stops = np.cumsum(sizes)
    text = np.zeros(int(stops[-1]), np.int16)
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text[:] = joined
    text += 1
    text[stops - 1] = 0
    found = RunIndex(text).matches(np.repeat(stops - 1, sizes)) >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
    made: list[list[tuple[int, int]]] = [[] for _ in parts]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(stops, a, side="right"))
        begin = int(stops[k] - sizes[k])
        made[k].append((a - begin, b - begin))
    return made


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
) -> DataFrame:
    """``id, n_bytes, spans, kept``: the maximal removed runs of bytes and the bytes that stay.

    ``spans`` are structs ``a, b`` (end exclusive) by place; ``kept`` is binary, as a
    run may end inside a character.  Every byte inside a string of ``length`` bytes
    that starts twice or more anywhere goes, judged on the input.  Texts are taken as
    UTF-8 bytes, null as empty; matches never cross texts.  Ids may be null or
    repeat: places are kept by id and digest of the text, and rows that repeat both
    are copies of each other like any other rows.  Empty tables give no rows.
    """
    rows = byte_rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut_out(part):
        made = []
        for key, data, runs in part:
            spans: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in runs or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            made.append((key, len(data), [{"a": a, "b": b} for a, b in spans], b"".join(kept)))
        return made

    placed = joined(rows, repeated_runs(docs, id_col, text_col, length, gram, group), "left").select("id", "data", "runs")
    return map_rows(placed, cut_out, f"id {kind}, n_bytes long, spans array<struct<a:int,b:int>>, kept binary", batch=128)


def byte_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("id", F.xxhash64("text").alias("print"), F.col("text").cast("binary").alias("data"))


def repeated_runs(
    docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """``id, print, runs``: bytes of repeated strings, as runs that may overlap."""
    if not 0 < gram <= length:
        raise ValueError("gram is at most length")
    rows = byte_rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(part):
        made = []
        for key, number, data in part:
            for x in segments(data, length, gram):
                made.append((key, number, *x))
        return made

    ddl = f"id {kind}, print long, anchor long, digest long, first int, n int"
    long_enough = rows.filter(F.octet_length("data") >= length)
    every, every_path = store(map_rows(long_enough, cut, ddl, batch=64), "segments")
    # Anchors that occur twice, and among their segments the equal ones.
    # What is joined on hot anchors is stored first, so that the join may split them.
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("anchor")
    shared, _ = store(shared, "shared-anchors")
    again, again_path = store(every.join(shared, "anchor"), "shared-segments")
    remove(docs.sparkSession, every_path)
    kinds = again.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print", "first", "n")).alias("example"),
    )
    kinds, kinds_path = store(kinds, "segment-kinds")
    variety = kinds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("different"), F.min("copies").alias("least")
    ).filter("different > 1 and least = 1").select("anchor", "different")
    variety, _ = store(variety, "mixed-anchors")
    # Only groups in which a segment occurs once have anything left to decide.
    compared = kinds.join(variety, "anchor").select(
        "anchor", "digest", "copies", "different", "example.id", "example.print", "example.first", "example.n"
    )
    wanted = compared.groupBy("id", "print").agg(
        F.collect_list(F.struct("anchor", "digest", "first", "n", "copies", (F.col("different") > group).alias("large"))).alias("parts")
    )
    at = joined(rows, wanted).select("data", "parts")

    def spell(part):
        made = []
        for data, parts in part:
            for p in parts:
                made.append((p["anchor"], p["digest"], p["copies"], p["large"], data[p["first"] : p["first"] + p["n"] + length - 1]))
        return made

    spelled = map_rows(at, spell, "anchor long, digest long, copies long, large boolean, bytes binary", batch=64)
    spelled, spelled_path = store(spelled, "segment-bytes")
    small = spelled.filter(~F.col("large")).repartition("anchor").sortWithinPartitions("anchor", "digest")
    partial = small.mapInArrow(index_batches(arrow_schema(docs.sparkSession, MARKS), length), MARKS)
    large = large_groups(spelled.filter("large"), length, gram)
    marks, marks_path = store(partial.unionByName(large), "segment-marks")
    # A segment with copies is repeated as a whole, others in the runs that were found.
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("example.n").alias("b")))
    states = kinds.join(marks, ["anchor", "digest"], "left").select(
        "anchor", "digest", F.when(F.col("copies") > 1, whole).otherwise(F.col("runs")).alias("runs")
    ).filter("runs is not null")
    states, _ = store(states, "segment-states")
    moved = F.transform(
        "runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + length - 1).alias("b"))
    )
    placed = again.join(states, ["anchor", "digest"]).select("id", "print", moved.alias("runs"))
    return placed.groupBy("id", "print").agg(F.flatten(F.collect_list("runs")).alias("runs"))


MARKS = "anchor long, digest long, runs array<struct<a:int,b:int>>"


def joined(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Rows by id and digest of the text, null ids included."""
    other = other.withColumnRenamed("id", "_id").withColumnRenamed("print", "_print")
    on = rows["id"].eqNullSafe(other["_id"]) & (rows["print"] == other["_print"])
    return rows.join(other, on, how)


def index_batches(schema: pa.Schema, length: int):
    """Whole groups of segments, gathered to batches of bounded size, through one index each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        parts: list[bytes] = []
        size = 0

        def marks():
            rows = [(*k, [{"a": a, "b": b} for a, b in runs]) for k, runs in zip(keys, repeated_starts(parts, length)) if runs]
            keys.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "digest", "bytes")]
            for anchor, digest, data in zip(*columns):
                if size > BATCH and keys[-1][0] != anchor:
                    yield marks()
                    size = 0
                keys.append((anchor, digest))
                parts.append(data)
                size += len(data)
        if parts:
            yield marks()

    return run


def large_groups(spelled: DataFrame, length: int, gram: int, steps: int = STEPS) -> DataFrame:
    """The same marks for groups too large for one index, from digests that Spark counts.

    A string holds the anchor, some bytes before it and some after it, ``length`` in
    all.  It can only repeat if both parts do, so digests of the bytes before and
    after the anchor, taken at ``steps`` distances each, bound the strings that need
    a digest of their own.
    """
    rest = length - gram
    levels = sorted({-(-rest * k // steps) for k in range(1, steps + 1)}) if rest else []

    def sides(part):
        made = []
        for anchor, digest, _, _, data in part:
            at = anchor_place(data, anchor, gram)
            for n in levels:
                if n <= at:
                    made.append((anchor, digest, -n, xxhash.xxh3_128_digest(data[at - n : at])))
                if at + gram + n <= len(data):
                    made.append((anchor, digest, n, xxhash.xxh3_128_digest(data[at + gram : at + gram + n])))
        return made

    around = map_rows(spelled, sides, "anchor long, digest long, side int, string binary", batch=64)
    around, _ = store(around, "anchor-sides")
    often, _ = store(
        around.groupBy("anchor", "side", "string").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "shared-sides"
    )
    reach = around.join(often, ["anchor", "side", "string"]).groupBy("anchor", "digest").agg(
        F.max(F.when(F.col("side") < 0, -F.col("side"))).alias("before"), F.max(F.when(F.col("side") > 0, F.col("side"))).alias("after")
    )
    open_ones = spelled.join(reach, ["anchor", "digest"], "left").select("anchor", "digest", "bytes", "before", "after")

    open_ones, _ = store(open_ones, "open-segments")

    def reachable(data, anchor, before, after):
        """The anchor's place, and the first and last start that both sides leave open."""
        at = anchor_place(data, anchor, gram)
        # Below the next level a side may still be shared.
        most_before, most_after = (min((n for n in levels if n > (x or 0)), default=rest + 1) - 1 for x in (before, after))
        return at, max(0, at - most_before), min(at, len(data) - length, most_after + at + gram - length)

    def blocks(part):
        made = []
        for anchor, digest, data, before, after in part:
            at, low, high = reachable(data, anchor, before, after)
            for k in range(max(0, at - high + BLOCK - 1) // BLOCK, (at - low + 1) // BLOCK):
                first = at - BLOCK * k - BLOCK + 1
                made.append((anchor, digest, k, first, xxhash.xxh3_128_digest(data[first : first + length + BLOCK - 1])))
        return made

    # Starts at one distance from the anchor go together: if all bytes of a block repeat, each of its strings does.
    together, _ = store(
        map_rows(open_ones, blocks, "anchor long, digest long, k int, first int, string binary", batch=64), "blocks"
    )
    common = together.groupBy("anchor", "k", "string").agg(F.count(F.lit(1)).alias("m"), F.min("digest").alias("shown_by"))
    common, _ = store(common.filter("m > 1").drop("m"), "repeated-blocks")
    solved = together.join(common, ["anchor", "k", "string"]).groupBy("anchor", "digest").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("k").alias("solved"),
        F.collect_list(F.when(F.col("digest") == F.col("shown_by"), F.col("k"))).alias("shown"),
    )
    solved, _ = store(solved, "solved-blocks")

    def windows(part):
        """Strings outside repeated blocks, and of each repeated block once, to hold the others against."""
        made = []
        for anchor, digest, data, before, after, done, shown in part:
            at, low, high = reachable(data, anchor, before, after)
            done, shown = set(done or ()), set(shown or ())
            for i in range(low, high + 1):
                k = (at - i) // BLOCK
                if k not in done or k in shown:
                    made.append((anchor, digest, i, k not in done, xxhash.xxh3_128_digest(data[i : i + length])))
        return made

    left = open_ones.join(solved.drop("firsts"), ["anchor", "digest"], "left").select(
        "anchor", "digest", "bytes", "before", "after", "solved", "shown"
    )
    strings = map_rows(left, windows, "anchor long, digest long, i int, own boolean, string binary", batch=64)
    strings, _ = store(strings, "group-strings")
    counts = strings.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    counts, _ = store(counts, "repeated-strings")
    places = strings.filter("own").join(counts, ["anchor", "string"]).groupBy("anchor", "digest").agg(
        F.sort_array(F.collect_list("i")).alias("starts")
    )
    one = F.transform("starts", lambda i: F.struct(i.alias("a"), (i + 1).alias("b")))
    many = F.transform("firsts", lambda i: F.struct(i.alias("a"), (i + BLOCK).alias("b")))
    return places.select("anchor", "digest", one.alias("runs")).unionByName(
        solved.select("anchor", "digest", many.alias("runs"))
    )


def anchor_place(data: bytes, anchor: int, gram: int) -> int:
    """Where a segment's anchor stands: the place in all of its strings."""
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram).view(np.int64)
    return int(np.argmax(hashes == anchor))
