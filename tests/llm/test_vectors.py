import numpy as np
import pytest

from trackloom.llm import embedding_links
from trackloom.llm.embedding_links import CrossPolytope, _meet, _transform, link_vectors, planned

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows
            if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            (_, x, la), (_, y, lb) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a].add(b)
                links[b].add(a)
    low = {k: good[k][0] for k in links}
    while True:
        new = {k: min([low[k], *(low[m] for m in links[k])]) for k in links}
        if new == low:
            break
        low = new
    return sorted((good[k][0], len(links[k]), low[k], low[k] == good[k][0]) for k in links)


@pytest.mark.parametrize("tile", [64, 1024])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_links, "TILE", tile)
    dice = np.random.default_rng(tile)
    rows = []
    for k in range(40):
        centre = dice.normal(size=20)
        for _ in range(12 if k else 150):
            rows.append((len(rows), (centre + dice.normal(size=20) * dice.uniform(0, 0.3)).tolist(), int(dice.integers(2))))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(90)]
    rows += [(len(rows) + k, (2 * np.array(rows[3][1])).tolist(), rows[3][2]) for k in range(3)]
    rows += [(len(rows), [1.0, 2.0], 0), (len(rows) + 1, [1.0, 2.01], 0)]
    bad = [(9001, None, 0), (9002, [0.0] * 20, 0), (9003, [float("nan")] + [1.0] * 19, 0), (9004, rows[0][1], None),
           (9005, [float("inf")] * 20, 0), (9006, [], 0), (9007, [None] + [1.0] * 19, 0), (None, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "'x' AS node", "'y' AS key").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i, _, _ in bad]
    assert got == sorted(brute(rows, 0.98) + alone, key=str)


def test_recall_of_buckets():
    polytope = planned(64, 50_000, 0.98)
    dice = np.random.default_rng(8)
    a, b = dice.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert _meet(polytope.buckets(a), polytope.buckets(b)).any(1).all()
    far = _meet(polytope.buckets(a[:5000]), polytope.buckets(a[5000:10_000])).any(1).mean()
    assert far < 0.02


def test_transform_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = _transform(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(_transform(y), x)
    assert CrossPolytope(4, 2, 1, 5).buckets(np.eye(4)).shape == (4, 2, 2)


def test_empty(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shared_ids_with_unlike_vectors(spark):
    dice = np.random.default_rng(4)
    a, b = dice.normal(size=(2, 16))
    near = lambda v: (v + dice.normal(size=16) * 0.01).tolist()
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, near(a), 0), (4, near(a), 0), (3, near(b), 0), (5, None, 0), (5, near(a), 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False),
                   (5, 0, 5, True), (5, 0, 5, True)]
