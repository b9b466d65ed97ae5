"""Near-duplicate vectors by cross-polytope hashing with verified pairs.

Vectors are turned by three rounds of random signs and fast Hadamard transforms; the
nearest of the 2d signed axes is the hash, and the next nearest give further probes.
A bucket lists numbers of vectors and short sketches; the sketches bound distances from
below, so a tile of a bucket tells which members can have a partner there.  Only these
fetch their vectors and are compared exactly.  A pair that meets in several buckets
counts only in the smallest bucket both were sent to, which each tile can tell by
itself, so pairs never have to be gathered.
"""

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_schema, map_rows, quoted, remove, store
from .components import connected_components
from .tiles import merge_labels, part_pairs, parts_for

THRESHOLD = 0.98
TABLES = 6
HASHES = 2
PROBES = 3
TILE = 1024
SEED = 7
ROUNDS = 3
# A sketch is so many coordinates of a turned unit vector, in steps of 1 / 127.
SKETCH = 16
# Tiles of at most so many members are compared many at once.
SMALL = 48
PAIRS_AT_ONCE = 500_000
SIFTED = "key long, part_a int, part_b int, side int, node long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(padded: np.ndarray, t: int, k: int, seed: int) -> np.ndarray:
    """Vectors after rounds of random signs and Hadamard transforms; lengths and angles stay."""
    signs = np.random.default_rng([seed, padded.shape[1], t, k]).choice((-1.0, 1.0), (ROUNDS, padded.shape[1]))
    for s in signs:
        padded = hadamard(padded * s)
    return padded


def padded_to_power(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    padded = np.zeros((n, 1 << max(0, d - 1).bit_length()))
    padded[:, :d] = x
    return padded


def sketches(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """Two longs per unit vector: its first coordinates after a turn of their own, as signed bytes."""
    y = turned(padded_to_power(x), tables, 0, seed)[:, :SKETCH]
    made = np.zeros((len(x), SKETCH), np.int8)
    made[:, : y.shape[1]] = np.rint(127 * y)
    return made.view("<i8")


def sketch_radius(threshold: float) -> float:
    """The largest squared distance of the sketches of two unit vectors with that cosine.

    Their distance is sqrt(2 - 2 cos), no turn or projection enlarges it, and
    rounding moves each coordinate of the difference by one step at most.
    """
    return (127 * np.sqrt(max(0.0, 2 - 2 * threshold)) + np.sqrt(SKETCH) + 0.01) ** 2


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers (vectors, tables, probes) of unit vectors, best probe first.

    A bucket joins one signed axis per hash.  Each hash offers its two nearest axes;
    the probes are the combinations that lose least.
    """
    padded = padded_to_power(x)
    n, width = padded.shape
    made = np.empty((n, tables, probes), np.int64)
    choices = list(product((0, 1), repeat=hashes))
    for t in range(tables):
        losses, axes = np.zeros((n, hashes, 2)), np.zeros((n, hashes, 2), np.int64)
        for k in range(hashes):
            y = turned(padded, t, k, seed)
            size = np.abs(y)
            best = np.argmax(size, axis=1)
            rows = np.arange(n)
            top = size[rows, best]
            size[rows, best] = -1
            second = np.argmax(size, axis=1) if width > 1 else best
            losses[:, k, 1] = top - np.abs(y[rows, second])
            for c, axis in enumerate((best, second)):
                axes[:, k, c] = 2 * axis + (y[rows, axis] < 0)
        total = np.stack([sum(losses[:, k, c[k]] for k in range(hashes)) for c in choices], axis=1)
        number = np.zeros((n, len(choices)), np.int64)
        for j, c in enumerate(choices):
            for k in range(hashes):
                number[:, j] = number[:, j] * 2 * width + axes[:, k, c[k]]
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        made[:, t] = np.take_along_axis(number, order, axis=1)
    return made


def usable(values: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it is to link with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    with np.errstate(over="ignore"):
        norm = float(x @ x)
    return x if np.isfinite(x).all() and 0 < norm < np.inf else None


def links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    tile: int = TILE,
) -> DataFrame:
    """``id, n_links, component`` for every row.

    Two vectors link when their labels are equal and not null and their cosine in
    double precision is at least ``threshold``.  Vectors that are null, empty,
    zero, not finite or of another length than their partner link with nothing.
    ``component`` is the smallest id that links reach; null ids take part, but name
    a component only among themselves.  Repeated rows count as vectors of their
    own.  Equal vectors are one while hashing and comparing.
    """
    if probes > 2**hashes:
        raise ValueError("probes are at most 2 to the power of hashes")
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(
        quoted(id_col).alias("id"), quoted(label_col).cast("string").alias("label"), quoted(vector_col).alias("v")
    )

    # Single precision stays single where it is stored; everything is computed in double.
    real = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"

    def prepare(part):
        made = []
        for key, label, values in part:
            x = usable(values) if label is not None else None
            raw = None if x is None else x.astype(real).tobytes()
            made.append((key, label, raw, None if raw is None else xxhash.xxh128_digest(raw)))
        return made

    prepared, _ = store(map_rows(rows, prepare, f"id {kind}, label string, v binary, same binary"), "vectors")
    # Equal vectors of a label stand for one; -0.0 and 0.0 are told apart, which costs nothing but a link's detour.
    classes = (
        prepared.filter("v is not null").groupBy("label", "same")
        .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min(F.col("id")).alias("first"))
    )

    def hash_rows(part):
        made = []
        by_size: dict[int, list] = {}
        for row in part:
            by_size.setdefault(len(row[2]), []).append(row)
        for rows in by_size.values():
            x = np.stack([np.frombuffer(r[2], real) for r in rows]).astype(np.float64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            every = codes(unit, tables, hashes, probes, SEED).reshape(len(rows), -1).tolist()
            made.extend((*row, *s, c) for row, s, c in zip(rows, sketches(unit, tables, SEED).tolist(), every))
        return made

    hashed = map_rows(
        classes, hash_rows, f"label string, same binary, v binary, n long, first {kind}, s0 long, s1 long, codes array<long>"
    )
    # A bucket is known by a digest; should two share one, their members are told apart when they are compared.
    keys = F.transform(
        "codes", lambda c, i: F.xxhash64("label", F.octet_length("v"), F.floor(i / probes).cast("int"), c)
    )
    # The numbers are fixed once they are written.
    classes, _ = store(
        hashed.withColumn("keys", F.array_distinct(keys)).drop("codes").withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    filed = classes.select(F.explode("keys").alias("key"), "node", "s0", "s1")
    sizes = parts_for(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tile)
    sizes, sizes_path = store(sizes.drop("n"), "bucket-sizes")
    tiled = (
        filed.join(sizes, "key")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        # Said outright, so that adaptive execution may split a hot bucket in the join.
        .repartition("key", "part")
        .groupBy("key", "part", "parts").agg(F.collect_list(F.struct("node", "s0", "s1")).alias("rows"))
    )
    tiled, tiled_path = store(tiled, "bucket-tiles")
    inner = tiled.select("key", F.col("part").alias("part_a"), F.col("part").alias("part_b"), F.col("rows").alias("a"))
    pairs = sizes.filter("parts > 1").withColumn("parts_a", F.col("parts")).withColumn("parts_b", F.col("parts"))
    pairs = part_pairs(pairs, "true").filter("part_a < part_b").drop("parts", "parts_a", "parts_b")
    for side in "ab":
        pairs = pairs.join(
            tiled.filter("parts > 1").select("key", F.col("part").alias(f"part_{side}"), F.col("rows").alias(side)),
            ["key", f"part_{side}"],
        )
    radius = sketch_radius(threshold)
    sifted = sift(inner, radius).unionByName(sift(pairs.select("key", "part_a", "part_b", "a", "b"), radius))
    held = (
        sifted.join(classes.select("node", "n", "label", "v", "keys"), "node")
        .groupBy("key", "part_a", "part_b")
        .agg(F.collect_list(F.struct("side", "node", "n", "label", "v", "keys")).alias("rows"))
    )

    def compare(part):
        few = [r for r in part if len(r[3]) <= SMALL]
        made = compare_few(few, threshold, real) if few else []
        for number, part_a, part_b, rows in part:
            if len(rows) > SMALL:
                made.extend(compare_members(number, rows, part_a != part_b, threshold, real))
        return made

    found = map_rows(held, compare, "node long, n long, root long", batch=32)
    found, _ = store(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("linked"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest, _ = store(named.groupBy("root").agg(F.min("first").alias("component")), "components")
    summary = (
        named.drop("component").join(smallest, "root").join(counts, "node", "left")
        .select("label", "same", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    )
    remove(spark, tiled_path, sizes_path)
    return prepared.join(summary, ["label", "same"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")
    )


def sift(tiles: DataFrame, radius: float) -> DataFrame:
    """``key, part_a, part_b, side, node``: members that can have a partner in their tile or the other one.

    ``tiles`` has ``key, part_a, part_b`` and the members ``a``, or ``a`` and ``b`` of two
    tiles; a member is ``node`` and its sketch ``s0, s1``.  At most the members come out.
    """
    across = "b" in tiles.columns

    def members(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        node, *sketch = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        points = np.stack(sketch, axis=1).astype("<i8").view(np.int8).astype(np.float32)
        return node, points, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part_a, part_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sides = [members(batch.column(i)) for i in range(3, 5 if across else 4)]
            if across:
                near = two_tiles(sides[0][1:], sides[1][1:], radius)
            else:
                near = [one_tile(*sides[0][1:], radius)]
            for side, ((node, _, ends), kept) in enumerate(zip(sides, near)):
                kept = np.flatnonzero(kept)
                if len(kept):
                    tile = np.searchsorted(ends, kept, side="right") - 1
                    columns = [key[tile], part_a[tile], part_b[tile], np.full(len(kept), side), node[kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    target = arrow_schema(tiles.sparkSession, SIFTED)
    return tiles.mapInArrow(run, SIFTED)


def close(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of two sets of sketches lie within the radius; sums of small whole numbers are exact."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T) <= radius


def pairs_within(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i < j`` of all pairs inside runs that begin at some places and have some sizes."""
    n = np.repeat(sizes, sizes)  # members of the run of every member
    begin = np.repeat(begins, sizes)
    member = begin + np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = np.repeat(member, n)
    j = np.repeat(begin, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i[i < j], j[i < j]


def one_tile(points: np.ndarray, ends: np.ndarray, radius: float) -> np.ndarray:
    """Members that lie near another of their tile."""
    near = np.zeros(len(points), bool)
    sizes = np.diff(ends)
    for k in np.flatnonzero(sizes > SMALL):
        x = points[ends[k] : ends[k + 1]]
        for at in range(0, len(x), 256):
            near[ends[k] + at : ends[k] + min(at + 256, len(x))] = close(x[at : at + 256], x, radius).sum(axis=1) > 1
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    groups = np.split(small, np.flatnonzero(np.diff(np.cumsum(sizes[small] ** 2) // PAIRS_AT_ONCE)) + 1)
    for tiles in groups:
        i, j = pairs_within(ends[tiles], sizes[tiles])
        apart = points[i] - points[j]
        hit = np.einsum("ij,ij->i", apart, apart) <= radius
        near[i[hit]] = near[j[hit]] = True
    return near


def two_tiles(a: tuple, b: tuple, radius: float) -> list[np.ndarray]:
    """Members of either side that lie near one of the other side of their pair of tiles."""
    (x, x_ends), (y, y_ends) = a, b
    near = [np.zeros(len(x), bool), np.zeros(len(y), bool)]
    for k in range(len(x_ends) - 1):
        left, right = slice(x_ends[k], x_ends[k + 1]), slice(y_ends[k], y_ends[k + 1])
        hit = close(x[left], y[right], radius)
        near[0][left], near[1][right] = hit.any(axis=1), hit.any(axis=0)
    return near


def own_links(sent: np.ndarray, key: np.ndarray, p: np.ndarray, q: np.ndarray, weight: np.ndarray, links: np.ndarray) -> None:
    """Adds the links of pairs whose smallest shared bucket is ``key``."""
    for s in range(0, len(p), 20_000):
        i, j, k = p[s : s + 20_000], q[s : s + 20_000], key[s : s + 20_000]
        shared = (sent[i][:, :, None] == sent[j][:, None, :]).any(axis=2)
        own = np.where(shared, sent[i], np.iinfo(np.int64).max).min(axis=1) == k
        np.add.at(links, i[own], weight[j[own]])
        np.add.at(links, j[own], weight[i[own]])


def sent_to(rows: list, keys: np.ndarray) -> np.ndarray:
    """Buckets of every member; a shorter list is filled up with the bucket it is in."""
    width = max(len(r["keys"]) for r in rows)
    fill = keys.tolist()
    return np.array([r["keys"] + [k] * (width - len(r["keys"])) for r, k in zip(rows, fill)], np.int64)


def compare_few(groups: list, threshold: float, real: str) -> list[tuple[int, int, int]]:
    """The same as ``compare_members`` for many small tiles ``key, part_a, part_b, rows`` at once."""
    rows = [r for g in groups for r in g[3]]
    sizes = np.array([len(g[3]) for g in groups], np.int64)
    of = np.repeat(np.arange(len(groups)), sizes)
    key = np.array([g[0] for g in groups], np.int64)[of]
    across = np.array([g[1] != g[2] for g in groups], bool)[of]
    side = np.array([r["side"] for r in rows])
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault((r["label"], len(r["v"])), len(kinds)) for r in rows])
    weight = np.array([r["n"] for r in rows], np.int64)
    width = max(len(r["v"]) for r in rows)
    # Vectors of another length are never compared; zeros behind a shorter one change no product.
    x = np.stack([np.frombuffer(r["v"].ljust(width, b"\0"), real) for r in rows]).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    i, j = pairs_within(np.cumsum(sizes) - sizes, sizes)
    both = (kind[i] == kind[j]) & (~across[i] | (side[i] != side[j]))
    i, j = i[both], j[both]
    near = [np.empty(0, bool)]
    for s in range(0, len(i), 50_000):
        p, q = i[s : s + 50_000], j[s : s + 50_000]
        near.append(np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold)
    near = np.concatenate(near)
    i, j = i[near], j[near]
    links = np.zeros(len(rows), np.int64)
    own_links(sent_to(rows, key), key[i], i, j, weight, links)
    labels = merge_labels(np.arange(len(rows)), i, j)
    members = np.unique(np.concatenate([i, j]))
    return [(rows[m]["node"], int(links[m]), rows[labels[m]]["node"]) for m in members.tolist()]


def compare_members(key: int, rows: list, across: bool, threshold: float, real: str) -> list[tuple[int, int, int]]:
    """``node, links found here first, one member of its group`` for linked members of a tile, or across two."""
    rows = sorted(rows, key=lambda r: (r["side"], r["node"]))
    cut = sum(r["side"] == 0 for r in rows) if across else 0
    if len({(r["label"], len(r["v"])) for r in rows}) > 1:
        # Two buckets share a digest.
        made = []
        for kind in sorted({(r["label"], len(r["v"])) for r in rows}):
            made.extend(compare_members(key, [r for r in rows if (r["label"], len(r["v"])) == kind], across, threshold, real))
        return made
    if across and cut in (0, len(rows)):
        return []
    weight = np.array([r["n"] for r in rows], np.int64)
    x = np.stack([np.frombuffer(r["v"], real) for r in rows]).astype(np.float64)
    sent = sent_to(rows, np.full(len(rows), key))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    labels = np.arange(len(rows))
    links = np.zeros(len(rows), np.int64)
    seen = np.zeros(len(rows), bool)
    last = cut if across else len(rows)
    for at in range(0, last, 128):
        block = slice(at, min(at + 128, last))
        cosine = (x[block] @ x[cut:].T) / np.outer(norm[block], norm[cut:])
        i, j = np.nonzero(cosine >= threshold - 1e-9)
        i, j = i + at, j + cut
        upper = i < j
        i, j = i[upper], j[upper]
        exact = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
        i, j = i[exact], j[exact]
        own_links(sent, np.full(len(i), key), i, j, weight, links)
        labels = merge_labels(labels, i, j)
        seen[i] = seen[j] = True
    members = np.flatnonzero(seen)
    return [(rows[m]["node"], int(links[m]), rows[labels[m]]["node"]) for m in members]
