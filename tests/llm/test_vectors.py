from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import mtree, queries, vector_graph, vectors


def clumps(n: int = 600, d: int = 24, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, d))
    return centres[np.arange(n) % len(centres)] + r.normal(size=(n, d)) * r.choice([0.02, 0.1, 0.6], (n, 1))


def frame(spark, ids, x, extra: bool = True):
    df = spark.createDataFrame([(None if i is None else int(i), None if v is None else [float(a) for a in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "cell", "len", "node", "rank", "d", "bound")]) if extra else df


def odd(spark):
    x = [[1, 0, 0], [2, 0, 0], [1, 0, 0], None, [], [0, 0, 0], [float("nan"), 1, 1], [float("inf"), 1, 1], [1, 0], [0, 1, 0], [0, 1, 0], [5, 5, 5], [0.999, 0.01, 0]]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None, 11]
    return frame(spark, ids, x)


def all_pairs(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(s >= threshold, 1)), strict=True)}


def groups_of(ids, x, threshold) -> dict:
    """Class and number of links of each id, by brute force."""
    pairs = all_pairs(ids, x, threshold)
    root, links = {int(i): int(i) for i in ids}, {int(i): 0 for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {int(i): (find(int(i)), links[int(i)]) for i in ids}


def found(df) -> dict:
    rows = df.collect()
    out = {r.vec_id: (r.class_id, r.n_links) for r in rows}
    assert len(out) == len(rows)
    return out


def share(got: dict, want: dict) -> float:
    """Of the links; none may be more than there are."""
    assert got.keys() == want.keys() and all(got[i][1] <= n for i, (_, n) in want.items())
    return sum(n for _, n in got.values()) / sum(n for _, n in want.values())


def test_recall_and_exactness_of_the_graph(spark):
    x = clumps().astype(np.float32).astype(float)
    ids = np.arange(len(x)) * 3
    want = groups_of(ids, x, 0.95)
    assert sum(n for _, n in want.values()) > 600
    assert share(found(vector_graph.near_groups(spark, frame(spark, ids, x), threshold=0.95)), want) >= 0.99


def test_several_shards(spark, monkeypatch):
    """Some ten shards, chunks that are cut, and a class that is a third of all rows."""
    monkeypatch.setattr(vector_graph, "SHARD", 90)
    monkeypatch.setattr(vector_graph, "CHUNK", 150)
    r = np.random.default_rng(4)
    x = np.concatenate([clumps(900, 16, 3), r.normal(size=16) + 0.02 * r.normal(size=(450, 16))])
    x = x[r.permutation(len(x))].astype(np.float32).astype(float)
    want = groups_of(np.arange(len(x)), x, 0.95)
    got = found(vector_graph.near_groups(spark, frame(spark, range(len(x)), x)))
    assert share(got, want) >= 0.99 and sum(got[i] == w for i, w in want.items()) >= 0.97 * len(want)


def test_chain_of_near_vectors(spark):
    """One class of links between neighbours only, and copies of one of them."""
    a = np.arange(40) * 0.2
    x = np.stack([np.cos(a[:20]), np.sin(a[:20]), 0 * a[:20]], 1)
    x = np.concatenate([x[:8], np.repeat(x[3:4], 5, 0)])
    want = groups_of(np.arange(len(x)) + 7, x.astype(np.float32).astype(float), 0.95)
    assert found(vector_graph.near_groups(spark, frame(spark, np.arange(len(x)) + 7, x))) == want


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 200), st.integers(2, 8), st.integers(0, 99))
def test_condensed_groups_hold_their_members(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(max(1, n // 8), d))[np.arange(n) % max(1, n // 8)] + 0.1 * r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = r.choice([0.0, 0.02], n)
    owner, centres, radii = vector_graph.condense(x, own, np.ones(n), 0.159)
    for g, (c, radius) in enumerate(zip(centres, radii, strict=True)):
        assert (owner == g).sum() > 1 and radius <= 0.159
        assert (vector_graph.angles(x[owner == g], c) + own[owner == g] <= radius + 1e-12).all()


def test_graph_is_connected_and_found(spark):
    """The search finds all in range, from the medoid, in a graph without brute force."""
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 32))
    x[750:] = x[:750] + 0.15 * r.normal(size=(750, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vector_graph.Graph(x)
    assert (graph.count > 0).all() and (graph.count <= vector_graph.DEGREE).all()
    sims = graph.search(graph.x, np.full(1500, 0.93), vector_graph.BEAM)
    near = x @ x.T >= 0.95
    assert (sims[near] >= 0.94).mean() > 0.98 and (sims > -2).mean() < 0.7


def test_centres_split_what_is_large(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(40, 4)) * 50, r.normal(size=(3000, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centres, counts = vectors.centres_of(df, len(x), 25)
    assert sum(counts.values()) == len(x) and max(counts.values()) <= 100 and len(centres) > vectors.FLAT and len(centres.groups) > 1
    at, d = centres.near(x, 3)
    exact = vectors.distances(x, centres.points)
    assert (np.diff(d, axis=1) >= 0).all() and (d[:, 0] <= exact.min(1) + 1e-6).mean() > 0.9


def test_pruned_neighbours_are_distinct():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:40]
    kept = vector_graph.robust_prune(x, np.arange(80), near, 10)
    for i, row in enumerate(kept):
        row = row[row >= 0]
        assert row[0] == near[i, 0] and len(set(row.tolist())) == len(row)
        for a in range(len(row)):  # none is ALPHA times nearer to one kept before than to the node
            for b in range(a):
                assert vector_graph.ALPHA * (1 - x[row[a]] @ x[row[b]]) > 1 - x[row[a]] @ x[i] - 1e-12


def test_odd_vectors_in_the_graph(spark):
    got = found(vector_graph.near_groups(spark, odd(spark)))
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 11: (1, 3), 10: (10, 0)}


@pytest.mark.parametrize("f, alone", [(vector_graph.near_groups, 1), (mtree.nearest, 0)])
def test_empty_and_single(spark, f, alone):
    assert f(spark, frame(spark, [], [])).count() == 0
    assert f(spark, frame(spark, [1], [[1.0, 2.0]])).count() == alone
    assert f(spark, frame(spark, [1, 2], [None, None])).count() == 0


def nearest(ids, x, k):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(x)):
        order = np.lexsort((ids, d[i]))[: min(k, len(x) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(d[i, j])) for j in order]
    return out


def same(got: dict, want: dict) -> bool:
    """The same neighbours in the same order, at distances alike but for rounding."""
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    return all(abs(a - b) < 1e-5 for i, v in want.items() for (_, a), (_, b) in zip(got[i], v, strict=True))


def by_id(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbor_id, r.distance))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 260), st.integers(1, 6), st.integers(1, 12), st.booleans(), st.integers(0, 999))
def test_tree_is_exact(n, d, k, grid, seed):
    """Also with ties, on a grid."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 3, (n, d)).astype(float) if grid else r.normal(size=(n, d))
    ids = r.permutation(n) * 2 + 1
    tree = mtree.Tree(ids, x)
    rows, dist, who = tree.search(x, ids, np.full(n, np.inf), k)
    want = nearest(ids, x, k)
    for i in range(n):
        got = [(int(w), float(v)) for w, v in zip(who[rows == i], dist[rows == i], strict=True)]
        assert same({0: got}, {0: want[int(ids[i])]})


def test_stored_distances_avoid_computations():
    x = clumps(3000, 4, 5)
    ids = np.arange(len(x))
    tree = mtree.Tree(ids, x)
    tree.search(x, ids, np.full(len(x), np.inf), 5)
    assert tree.avoided > 0 and tree.computed < 0.6 * len(x) ** 2


def test_nearest_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL", 60)
    x = clumps(500, 6, 7).astype(np.float32).astype(float)
    ids = np.arange(500) * 5
    assert same(by_id(mtree.nearest(spark, frame(spark, ids, x), k=7).collect()), nearest(ids, x, 7))


def test_many_equal_vectors(spark, monkeypatch):
    """A cell that is too large for one tree."""
    monkeypatch.setattr(mtree, "CELL", 30)
    x = np.concatenate([np.zeros((200, 3)), np.eye(3), np.ones((1, 3))])
    ids = np.arange(len(x))
    assert same(by_id(mtree.nearest(spark, frame(spark, ids, x), k=4).collect()), nearest(ids, x, 4))


def test_odd_vectors_in_the_tree(spark):
    got = by_id(mtree.nearest(spark, odd(spark), k=10).collect())
    ids = np.array([1, 2, 3, 6, 10, 11])
    x = np.array([[1, 0, 0], [2, 0, 0], [1, 0, 0], [0, 0, 0], [0, 1, 0], [0.999, 0.01, 0]], np.float32).astype(float)
    assert same(got, nearest(ids, x, 10))  # fewer than k other rows


def read(spark, small):
    t = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    return t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)


def test_queries(spark, small):
    ids, x = read(spark, small)
    assert found(queries.op2_embedding_near_dups(spark, small)) == groups_of(ids, x, vector_graph.THRESHOLD)
    want = {i: v for i, v in nearest(ids, x, mtree.K).items() if i % queries.EVERY == 0}
    assert same(by_id(queries.op10_exact_top_k(spark, small).collect()), want)
