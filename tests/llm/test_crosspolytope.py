import numpy as np
import pytest

from exposurelab.llm import crosspolytope
from exposurelab.llm.queries import QUERIES

from .helpers import smallest_linked

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, threshold=0.98):
    known = {}
    for key, vector, label in rows:
        x = crosspolytope.usable(vector)
        if x is not None and label is not None:
            known[key] = (x / np.linalg.norm(x), label)
    links = [
        (a, b) for a in known for b in known
        if a < b and known[a][1] == known[b][1] and len(known[a][0]) == len(known[b][0]) and known[a][0] @ known[b][0] >= threshold
    ]
    ids = [r[0] for r in rows]
    n = {i: sum(i in pair for pair in links) for i in ids}
    return n, smallest_linked(ids, links)


def clusters(rng, d, n, noise, start=0):
    center = rng.normal(size=d)
    return [(start + i, (center + noise * rng.normal(size=d)).astype(np.float32).tolist(), i % 2) for i in range(n)]


@pytest.mark.parametrize("tile", [1024, 7])
@pytest.mark.parametrize("d", [64, 10])
def test_links_of_clusters(spark, d, tile):
    rng = np.random.default_rng(d)
    rows = []
    for noise in (0.02, 0.1, 0.14, 1.0):
        rows += clusters(rng, d, 30, noise, len(rows))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(12)]
    n, component = brute_force(rows)
    found = {r["id"]: r for r in crosspolytope.links(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()}
    lost = sum(n.values()) - sum(r["n_links"] for r in found.values())
    assert 0 <= lost <= 0.005 * sum(n.values())
    if lost == 0:
        assert {i: r["component"] for i, r in found.items()} == component


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [
        (1, a, 0), (2, a, None), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [float("nan"), 1.0, 1.0], 0),
        (6, [None, 1.0, 1.0], 0), (7, [], 0), (8, [float("inf"), 1.0, 1.0], 0), (9, [2.0, 4.0, 6.0], 0),
        (10, a, 1), (11, [1.0, 2.0, 3.0, 0.0], 0), (None, a, 0), (12, [5.0], 0), (13, [7.0], 0), (14, [-5.0], 0),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", component int")
    found = {r["id"]: (r["n_links"], r["component"]) for r in crosspolytope.links(frame).collect()}
    assert found[1] == (2, 1) and found[9] == (2, 1) and found[None] == (2, 1)
    assert found[12] == (1, 12) and found[13] == (1, 12)
    assert all(found[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 8, 10, 11, 14))
    assert crosspolytope.links(frame.limit(0)).count() == 0


def test_transform_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels)
    n = {r[0]: int(linked[i].sum()) - 1 for i, r in enumerate(rows)}
    found = {r["vec_id"]: r["n_links"] for r in QUERIES["op4_cross_polytope"](spark, folder).collect()}
    assert found.keys() == n.keys() and sum(found.values()) >= 0.99 * sum(n.values())
    assert all(found[i] <= n[i] for i in n)


@pytest.mark.parametrize("d", [1, 3, 64, 100])
@pytest.mark.parametrize("threshold", [0.98, 0.7])
def test_sketches_never_part_a_pair(d, threshold):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d))
    y = x + rng.normal(size=(300, d)) * rng.uniform(0, 0.3, (300, 1))
    x, y = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y)]
    a, b = [crosspolytope.sketches(v, 6, 7).view(np.int8).astype(np.float32) for v in (x, y)]
    alike = np.einsum("ij,ij->i", x, y) >= threshold
    assert alike.any()
    assert (((a - b) ** 2).sum(axis=1)[alike] <= crosspolytope.sketch_radius(threshold)).all()


def test_sketches_part_most_other_pairs():
    x = np.random.default_rng(3).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = crosspolytope.sketches(x, 6, 7).view(np.int8).astype(np.float32)
    assert crosspolytope.close(a, a, crosspolytope.sketch_radius(0.98)).sum() <= 400 + 20


def test_members_near_others_in_tiles(monkeypatch):
    monkeypatch.setattr(crosspolytope, "PAIRS_AT_ONCE", 300)
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 48, 49, 300, 1, 20, 3]
    points = rng.integers(-9, 9, (sum(sizes), 16)).astype(np.float32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    expected = []
    for s, e in zip(ends, ends[1:]):
        apart = ((points[s:e, None] - points[None, s:e]) ** 2).sum(axis=2) <= 450
        expected += (apart.sum(axis=1) > 1).tolist()
    assert crosspolytope.one_tile(points, ends, 450).tolist() == expected and 20 < sum(expected) < len(expected)
    near = crosspolytope.two_tiles((points, ends[[0, 3, 9]]), (points, ends[[0, 4, 9]]), 450)
    whole = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= 450
    block = np.zeros_like(whole)
    block[: ends[3], : ends[4]] = block[ends[3] :, ends[4] :] = True
    assert near[0].tolist() == (whole & block).any(axis=1).tolist() and near[1].tolist() == (whole & block).any(axis=0).tolist()


def test_buckets_with_one_digest_keep_labels_apart():
    row = lambda node, label, v: {"side": 0, "node": node, "n": 1, "label": label, "v": np.array(v, "<f4").tobytes(), "keys": [5, node]}
    rows = [row(1, "a", [1, 0]), row(2, "b", [1, 0]), row(3, "a", [2, 0]), row(4, "b", [1, 0, 0]), row(6, "b", [3, 0])]
    found = crosspolytope.compare_members(5, rows, False, 0.98, "<f4")
    assert sorted(found) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (6, 1, 2)]
    assert sorted(crosspolytope.compare_few([(5, 0, 0, rows)], 0.98, "<f4")) == sorted(found)


def test_few_members_are_compared_like_many():
    rng = np.random.default_rng(11)
    groups = []
    for g in range(40):
        across = g % 3 == 0
        rows = [
            {"side": int(rng.integers(0, 2)) if across else 0, "node": 100 * g + m, "n": int(rng.integers(1, 4)), "label": "ab"[int(rng.integers(0, 2))],
             "v": (np.eye(3)[int(rng.integers(0, 3))] + rng.normal(size=3) * 0.08).astype("<f4").tobytes(),
             "keys": [g, *rng.integers(-3, 3, int(rng.integers(0, 4))).tolist()]}
            for m in range(int(rng.integers(1, 9)))
        ]
        rows.sort(key=lambda r: r["side"])
        groups.append((g, 0, int(across), rows))
    many = [x for g, a, b, rows in groups for x in crosspolytope.compare_members(g, rows, a != b, 0.98, "<f4")]
    assert sorted(crosspolytope.compare_few(groups, 0.98, "<f4")) == sorted(many) and len(many) > 20
