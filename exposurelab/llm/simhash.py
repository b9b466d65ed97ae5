"""Near-duplicates by SimHash, compared in tiles.

Distinct fingerprints are filed into tiles by counts that bound their distance, above
all by the number of bits that are set.  Pairs of tiles whose counts differ beyond the
radius are skipped; the rest is compared by exclusive-or and bit counts in numpy.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows, quoted, remove, store
from .components import connected_components
from .tiles import merge_labels, part_pairs, parts_for

TILE = 2048
SEED = 42
CHUNK = 65_535  # the most votes that 16-bit sums hold


@dataclass(frozen=True)
class Close:
    """Fingerprints of 64 bits over all shingles that differ in at most ``radius`` bits.

    Filed by the bit counts of four 16-bit words: the sum of the differences of these
    counts is at most the distance.
    """

    shingle: int = 3
    radius: int = 2

    def node(self, word: np.ndarray) -> bytes:
        return word.astype(">u8").tobytes()

    def key(self, word: np.ndarray) -> list[int]:
        return np.bitwise_count(word.view(np.uint16)).tolist()

    def steps(self) -> list[tuple[int, ...]]:
        near = product(range(-self.radius, self.radius + 1), repeat=4)
        return [d for d in near if sum(map(abs, d)) <= self.radius and d >= (0,) * 4]

    def apart(self, a: list[bytes], b: list[bytes]):
        """A function of a slice of ``a`` that marks which of ``b`` are linked."""
        x, y = (np.frombuffer(b"".join(s), ">u8").astype(np.uint64) for s in (a, b))
        return lambda at: np.bitwise_count(x[at, None] ^ y[None, :]) <= self.radius


def shingle_hashes(text: str, scheme: Close = Close()) -> list[int]:
    """XXH64 of every shingle, repeats included.

    Words are runs of anything but space and \t-\r, A-Z in lower case.  Fewer words
    than a shingle: the whole sequence; none: nothing.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    size = scheme.shingle
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    hashes = [digest(joined[s:e], SEED) for s, e in pairs]
    return hashes


def fingerprint(hashes: list[int]) -> np.ndarray:
    """The SimHash of shingle hashes as one 64-bit word.

    Every shingle votes with its hash; a bit is set by more than half.  No shingles: zero.
    """
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(np.array(hashes[at : at + CHUNK], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Close = Close()) -> DataFrame:
    """``id, text_hash, node, key`` of every document; null texts count as empty.

    ``node`` holds the fingerprint, ``key`` says which tiles to look in.
    """

    def run(rows):
        made = []
        for key, text, text_hash in rows:
            hashes = shingle_hashes(text, scheme)
            word = fingerprint(hashes)
            made.append((key, text_hash, scheme.node(word), scheme.key(word)))
        return made

    kind = docs.schema[id_col].dataType.simpleString()
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_rows(texts, run, f"id {kind}, text_hash long, node binary, key array<int>")


def linked(values: DataFrame, scheme: Close = Close(), tile: int = TILE) -> DataFrame:
    """``a, b``: links that span the groups of the distinct ``node, key`` rows.

    Every pair that can be linked is compared; of the links found in one pair of
    tiles only a spanning set is returned, so groups are right though not every link
    is listed.
    """
    steps = scheme.steps()
    key = [f"c{i}" for i in range(len(steps[0]))]
    filed = values.select("node", *[F.col("key")[i].alias(k) for i, k in enumerate(key)])
    # The number of keys is bounded whatever the input: 17**4.
    sizes, sizes_path = store(parts_for(filed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), tile), "tile-sizes")
    tiles = (
        filed.join(F.broadcast(sizes.filter("parts > 1").select(*key, "parts")), key, "left")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
        .groupBy(*key, "part")
        .agg(F.collect_list("node").alias("nodes"))
    )
    tiles, tiles_path = store(tiles, "tiles")
    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps]))
    a = sizes.select(*[F.col(k).alias(f"a_{k}") for k in key], F.col("parts").alias("parts_a"), step.alias("step"))
    a = a.select("*", *[(F.col(f"a_{k}") + F.col("step")[i]).alias(f"b_{k}") for i, k in enumerate(key)]).drop("step")
    b = sizes.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("parts").alias("parts_b"))
    pairs = a.join(b, [f"b_{k}" for k in key])
    same = " and ".join(f"a_{k} = b_{k}" for k in key)
    pairs = part_pairs(pairs, same).withColumn("same", F.expr(f"{same} and part_a = part_b"))
    for s in "ab":
        names = [F.col(k).alias(f"{s}_{k}") for k in key]
        side = tiles.select(*names, F.col("part").alias(f"part_{s}"), F.col("nodes").alias(f"nodes_{s}"))
        pairs = pairs.join(side, [*[f"{s}_{k}" for k in key], f"part_{s}"])

    def compare(rows):
        made = []
        for x, y, same_tile in rows:
            made.extend(compare_tiles(x, y, same_tile, scheme))
        return made

    links = map_rows(pairs.select("nodes_a", "nodes_b", "same"), compare, "a binary, b binary", batch=16)
    links, _ = store(links.distinct(), "links")
    remove(values.sparkSession, sizes_path, tiles_path)
    return links


def compare_tiles(x: Sequence[bytes], y: Sequence[bytes], same: bool, scheme: Close) -> list[tuple[bytes, bytes]]:
    """Members of each group inside a pair of tiles, tied to one of its members."""
    everyone = list(x) if same else [*x, *y]
    offset = 0 if same else len(x)
    labels = np.arange(len(everyone))
    marks = scheme.apart(x, x if same else y)
    for at in range(0, len(x), 128):
        i, j = np.nonzero(marks(slice(at, at + 128)))
        i += at
        j += offset
        off = i != j
        labels = merge_labels(labels, i[off], j[off])
    return [(everyone[k], everyone[labels[k]]) for k in np.flatnonzero(labels != np.arange(len(labels)))]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Close = Close()) -> DataFrame:
    """``id, node, component, root, text_hash``: the smallest id that links reach from each document.

    ``root`` is the same for all documents of a group, ``text_hash`` tells rows with equal ids apart.
    Documents with equal fingerprints are linked, those without words among them.
    Null ids take part but never name a component unless its ids are all null.
    Repeated rows come back as often as they came; an empty table gives no rows.
    """
    prints, _ = store(fingerprints(docs, id_col, text_col, scheme), "fingerprints")
    classes, _ = store(prints.groupBy("node", "key").agg(F.min("id").alias("first")), "classes")
    roots = connected_components(linked(classes.select("node", "key"), scheme))
    grouped = classes.join(roots, "node", "left").select(
        "node", "first", F.coalesce("component", "node").alias("root")
    )
    smallest, _ = store(grouped.groupBy("root").agg(F.min("first").alias("component")), "components")
    named = grouped.join(smallest, "root").select("node", "component", "root")
    return prints.join(named, "node").select("id", "node", "component", "root", "text_hash")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Close = Close()) -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns.

    Where rows repeat that id, the text with the smallest hash stays, and of identical
    rows one.
    """
    groups = near_duplicates(docs, id_col, text_col, scheme)
    stay = groups.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(
        F.min(F.struct("text_hash", "id")).alias("s")
    ).select(F.col("s.id").alias("_stay"), F.col("s.text_hash").alias("_hash"))
    rows = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(id_col).alias("_id"),
        F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))).alias("_text"),
    )
    same = F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_text") == F.col("_hash"))
    kept = rows.join(stay, same, "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
