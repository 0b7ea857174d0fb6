"""Operators on vectors against brute force."""

import numpy as np
import pytest

from folioforge.llm import ann, vector_dedup
from folioforge.llm.common import local_components
from folioforge.llm.components import connected_components


@pytest.fixture(scope="module")
def vectors(spark):
    """Near copies, exact copies, ties, and rows that take no part."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.vstack([base, base[:20] + rng.normal(scale=0.03, size=(20, 16)), np.repeat(base[:1], 60, axis=0), base[2:3] + rng.normal(scale=0.02, size=(90, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 2) if i < 80 else 0) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [float("inf")] + [1.0] * 15, 0), (904, [None] + [1.0] * 15, 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (907, [], 0)]
    return spark.createDataFrame([(*r, "e") for r in rows + odd], "vec_id long, embedding array<float>, label int, vec string").repartition(3), rows


def links(rows):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    n = np.sqrt((x**2).sum(axis=1))
    hit = (x @ x.T / np.outer(n, n) >= 0.98) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("block", [2048, 16])
def test_components_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    df, rows = vectors
    got = {r["vec_id"]: r for r in vector_dedup.vector_components(df).collect()}
    hit = links(rows)
    roots = local_components(len(rows), *np.nonzero(np.triu(hit)))
    for i in range(len(rows)):
        assert got[i]["n_links"] == hit[i].sum() and got[i]["component_id"] == roots[i] and got[i]["kept"] == (roots[i] == i)
    for i in range(900, 908):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(rows) + 8


def test_rows_count_by_themselves(spark):
    """Repeated ids with equal, other or unusable vectors, null ids, and lengths that share a power of two."""
    x, y = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(5, x, 1), (5, None, 1), (5, y, 1), (3, y, 1), (7, x, 1), (None, x, 1), (None, None, None), (9, [*x, 0.0], 1), (9, [*x, 0.0], 1), (2, [*x, 1e-9], 1), (4, x, 2)]
    got = vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(5, 1, 5), (5, 0, 5), (5, 1, 3), (3, 1, 3), (7, 1, 5), (None, 0, None), (None, 0, None), (9, 2, 2), (9, 2, 2), (2, 2, 2), (4, 0, 4)]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_planted_pairs_at_the_threshold(spark):
    """Pairs at cosines just above 0.98 and just below, in the width of the real vectors."""
    rng = np.random.default_rng(6)
    rows, near = [], {}
    for i in range(300):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9802 + 0.0148 * (i % 100) / 99 if i % 3 else 0.9798
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
        near[2 * i] = bool(i % 3)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == got[i + 1] == 0 for i, n in near.items() if not n)
    assert sum(got[i] == got[i + 1] == 1 for i, n in near.items() if n) >= 198  # of 200


def test_components_empty(vectors):
    assert vector_dedup.vector_components(vectors[0].limit(0)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(vector_dedup.hadamard(vector_dedup.hadamard(x)), x)
    assert np.allclose((vector_dedup.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))


def exact(rows, every, k):
    x, ids = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[0] for r in rows])
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        yield int(ids[i]), [(int(ids[j]), float(s[j])) for j in order]


def test_nearest_small(vectors):
    df, rows = vectors
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, best in exact(rows, 20, 20):
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in [r["vec_id"] for r in own]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += len({b[0] for b in best} & {r["vec_id"] for r in own})
        total += 20
        known = dict(best)
        assert all(r["score"] == pytest.approx(known[r["vec_id"]], abs=1e-12) for r in own if r["vec_id"] in known)
    assert set(got) == {q for q, _ in exact(rows, 20, 20)}
    assert hits / total >= 0.9


def test_nearest_few_and_none(spark, vectors):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = ann.nearest(few).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert ann.nearest(vectors[0].limit(0)).count() == 0


def test_clustered_vectors_read_few_lists(spark):
    """Clusters, one dense group, and vectors of no cluster: every query's recall and how many lists it reads."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 32))
    x = np.vstack([centres[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 32)), centres[:1] + 0.02 * rng.normal(size=(400, 32)), rng.normal(size=(600, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(x[rng.permutation(len(x))].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = [len({b[0] for b in best} & got[q]) / 20 for q, best in exact(rows, 20, 20)]
    assert np.mean(recall) > 0.97 and min(recall) >= 0.8
    x = np.array([r[1] for r in rows])
    index = ann.Centroids(ann.two_level_split(ann.lifted(x, 1.0), 80, rng))
    ratios = ann.calibrate(index, x, 1.0, 20, 0.95)
    q = x[::20]
    scale = ann.reach(q, -np.partition(-(q @ x.T), 20, axis=1)[:, 20], 1.0)
    lifted = np.pad(q, ((0, 0), (0, 1)))
    reads = index.within(lifted, scale, ratios, np.full(len(index.points), 60), 20)
    assert reads.mean() < 0.5
    near = np.sqrt(((lifted[:, None] - index.points[None]) ** 2).sum(axis=2))
    bound = np.maximum(near.min(axis=1) + ratios[ann.likeness(scale, near.min(axis=1))] * scale, ann.CLOSE * near.min(axis=1))
    assert (reads == (near <= bound[:, None])).mean() > 0.99  # the graph reaches what is within the bound


def test_repeated_ids_have_one_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, None), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (None, [5.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2.0), (0, 2, 0.2)]


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 8))
    q = rng.normal(size=(50, 8))
    ids, _ = ann.Centroids(points).search(q, 32)
    true = ((q[:, None] - points[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (ids[:, 0] == true).mean() > 0.95


def test_connected_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 700)]
    df = spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long")
    roots = local_components(1000, *(np.array([p[i] for p in pairs]) for i in (0, 1)))
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {i: int(roots[i]) for p in pairs if p[0] != p[1] for i in p}
    assert connected_components(df.limit(0)).count() == 0
