import numpy as np
import pytest

from orepulse.llm.components import components
from orepulse.llm.vectors import near_vectors


def brute(ids, x, cosine=0.95):
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= cosine) & ~np.eye(len(x), dtype=bool)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], label.max() + 1).min(axis=1))
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, hit.sum(axis=1), label)}
        label = new


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1120)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, small, block):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], [r.embedding for r in rows]
    rng = np.random.default_rng(1)
    near = [x[0] + 0.01 * rng.standard_normal(64) * np.linalg.norm(x[0]) for _ in range(60)]
    ids, x = ids + [10_000 + i for i in range(70)], x + [v.tolist() for v in near] + [x[0]] * 10
    docs = spark.createDataFrame([(i, [float(v) for v in e], 3) for i, e in zip(ids, x)], "vec_id long, embedding array<float>, n_links int")
    x = [r.embedding for r in docs.orderBy("vec_id").collect()]
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(docs, block=block).collect()}
    assert out == brute(sorted(ids), x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0])]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), None: (0, None, True)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
