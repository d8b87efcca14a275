import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import pivot
from threadloom.llm.grid import union_find
from threadloom.llm.knn import nearest, similar_pairs
from threadloom.llm.pivot import clusters, isolated_clusters, measure
from threadloom.llm.tree import best_bins, fit_tree
from threadloom.llm.vectors import build_index, usable_vectors
from threadloom.session import Scratch

ROW = "thread_id long, kind string, value string, dimensions int, stamp string, vec string, id int"


def vectors(spark, x, ids=None):
    rows = [(int(i), "s", json.dumps([float(v) for v in r]), x.shape[1], "1", "clash", 0) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return usable_vectors(spark.createDataFrame(rows, ROW), F.col("kind"), "thread_id", "value", "dimensions", "stamp")


def groups_of(rng, n, size, noise, d=12):
    return np.concatenate([rng.normal(size=d) + noise * rng.normal(size=(size, d)) for _ in range(n)])


def test_usable(spark):
    good = "[1, 2.5e0]"
    texts = [good, None, "", "null", "{}", "[]", "[1]", "[1,2,3]", "[0,0.0]", "[1,null]", '[1,"2"]', "[1,true]", "[NaN,1]", "[1e999,1]", "[1,2", "[1,2]]", "[1,2] 3", "[[1,2]]", " [ 3 ,4]\n"]
    rows = [(i, "s", t, 2, "1", None, 0) for i, t in enumerate(texts)]
    rows += [(100, "s", "[1,0]", 2, "1", None, 0), (100, "s", "[0,1]", 2, "2", None, 0), (100, "s", "bad", 2, "3", None, 0), (100, "s", "[5,5]", 2, None, None, 0), (100, None, good, 2, "9", None, 0), (None, "s", good, 2, "9", None, 0), (101, "s", good, None, "1", None, 0)]
    got = {r.id: np.frombuffer(r.vec, "<f4").tolist() for r in usable_vectors(spark.createDataFrame(rows, ROW), F.col("kind"), "thread_id", "value", "dimensions", "stamp").collect()}
    assert set(got) == {0, 18, 100} and got[100] == [0, 1] and got[18] == pytest.approx([0.6, 0.8])


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    tree = fit_tree(x, 40, branch=4)
    seen = best_bins(tree, x[:20], tree.leaves)
    assert all(sorted(r) == list(range(tree.leaves)) for r in seen.tolist())
    assert (best_bins(tree, x, 3)[:, 0] == best_bins(tree, x, 1)[:, 0]).all()
    assert fit_tree(np.ones((50, 3)), 10).leaves == 1 and fit_tree(np.zeros((0, 3)), 5).leaves == 1
    assert best_bins(tree, x[:0], 2).shape == (0, 2)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([groups_of(rng, 40, 9, 0.3), rng.normal(size=(200, 12))])
    x[5] = x[4]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    edges, index = nearest(vectors(spark, x), 6, 0.8, Scratch(spark))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:6] if s[i, j] >= 0.8}
    got = {(r.left_id, r.right_id) for r in edges.collect()}
    assert len(got & want) / len(want) > 0.99 and len(got - want) < 0.01 * len(want)
    assert similar_pairs(edges).where("left_id >= right_id").count() == 0 and list(index.recall.values()) == [1.0]


def test_recall_of_the_index(spark, monkeypatch):
    rng = np.random.default_rng(3)
    scratch = Scratch(spark)
    df = scratch.save(vectors(spark, groups_of(rng, 150, 8, 0.3)), "v")
    index = build_index(df, 6, 0.7, target=0.95, leaf_rows=60)
    assert index.trees["s#12"].leaves > 10 and index.recall["s#12"] >= 0.95


def test_many_equal_vectors(spark):
    x = np.concatenate([np.ones((60, 4)), np.random.default_rng(4).normal(size=(20, 4)), np.array([[1, 1, 1, 1.1]])])
    edges, _ = nearest(vectors(spark, x), 3, 0.9, Scratch(spark))
    got = {}
    for r in edges.collect():
        got.setdefault(r.left_id, set()).add(r.right_id)
    assert all(got[i] == {0, 1, 2} - {i} | ({3} if i < 3 else set()) for i in range(60)) and got[80] == {0, 1, 2}


def test_empty_and_alone(spark):
    x = np.eye(3)
    assert nearest(vectors(spark, x).limit(0), 6, 0.8, Scratch(spark))[0].count() == 0
    assert nearest(vectors(spark, x[:1]), 6, 0.8, Scratch(spark))[0].count() == 0
    assert isolated_clusters(vectors(spark, x), 0.8, 2, Scratch(spark)).count() == 0
    assert clusters(vectors(spark, x).limit(0), 0.8, Scratch(spark)).count() == 0


def test_isolated_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([groups_of(rng, 15, 6, 0.15), groups_of(rng, 4, 3, 0.1), groups_of(rng, 3, 9, 0.6), rng.normal(size=(50, 12))])
    x[1] = x[0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    hood = [frozenset(np.flatnonzero(r >= 0.8).tolist()) for r in s]
    want = set()
    for h in {h for h in hood if len(h) >= 4 and all(hood[j] == h for j in h)}:
        m = sorted(h)
        rep = max(m, key=lambda i: (round(float((s[i, m].sum() - 1) / (len(m) - 1)), 5), -i))
        want |= {(rep, i) for i in m}
    got = {tuple(r) for r in isolated_clusters(vectors(spark, x), 0.8, 4, Scratch(spark)).collect()}
    assert {i for _, i in got} == {i for _, i in want} and len(got & want) >= len(want) - 6


def test_large_groups_are_measured_alike(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones(8) + 0.1 * rng.normal(size=(50, 8)), np.ones(8) + 0.6 * rng.normal(size=(50, 8))])
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
    rows = [(i // 50, i, 1 + i % 2, bytearray(v.tobytes())) for i, v in enumerate(u)]
    df = Scratch(spark).save(spark.createDataFrame(rows, "group_id long, id long, weight long, vec binary"), "m")
    for floor in (0.7, 0.95):
        whole, parts = ({r.id: (round(r["mean"], 6), r.tight) for r in measure(df, floor, Scratch(spark), held).collect()} for held in (4096, 8))
        assert whole == parts


def test_dense_rows_stay_linear(monkeypatch):
    s = np.full((300, 300), 0.9, np.float32)
    ids = np.arange(300)
    cols = pivot.similar_edges(0.8, dense=10)("v", ids, ids, s, True)
    assert len(cols[0]) <= 300 * 11
    low = ids[np.argmin(pivot._rank(ids))]
    assert {int(x) for a, b in zip(cols[1].to_numpy(), cols[2].to_numpy()) if low in (a, b) for x in (a, b)} == set(range(300))


def test_clusters(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([4 * np.eye(12)[i] + 0.3 * rng.normal(size=(7, 12)) for i in range(5)] + [-4 * np.eye(12)[:3]])
    got = clusters(vectors(spark, x), 0.8, Scratch(spark)).collect()
    assert [r["size"] for r in got] == [7] * 5 and all(len(r.typical_ids) <= 3 and r.representative_id == r.typical_ids[0] for r in got)


def test_rank_is_that_of_spark(spark):
    ids = np.array([0, 1, -1, 5, 1001, 1 << 40, -(1 << 62), (1 << 63) - 1])
    got = spark.createDataFrame([(int(i),) for i in ids], "id long").select(F.xxhash64(F.lit(5), "id")).collect()
    assert pivot._rank(ids).tolist() == [r[0] for r in got]


def test_a_dense_group_is_one_cluster(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([4 * np.eye(12)[0] + 0.3 * rng.normal(size=(400, 12)), 4 * np.eye(12)[1] + 0.3 * rng.normal(size=(5, 12))])
    got = clusters(vectors(spark, x), 0.8, Scratch(spark)).collect()
    assert sorted(r["size"] for r in got) == [5, 400]
    u = x[:400] / np.linalg.norm(x[:400], axis=1)[:, None]
    assert max(got, key=lambda r: r["size"]).representative_id == int(np.argmax((u @ u.T).sum(1)))


def test_dense_clusters_against_brute_force(spark):
    x = np.random.default_rng(9).normal(size=(1200, 3))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    near, rank = (s >= 0.8) & ~np.eye(len(x), dtype=bool), pivot._rank(np.arange(len(x)))
    active, pivots = np.ones(len(x), bool), []
    while True:
        low = np.where(near & active, rank, np.iinfo(np.int64).max).min(1)
        new = np.flatnonzero(active & (near & active).any(1) & (rank < low))
        if not len(new):
            break
        pivots += new.tolist()
        active &= ~near[new].any(0)
        active[new] = False
    want = np.where(near[:, pivots], s[:, pivots], -2)
    group = np.where(want.max(1) > -2, np.array(pivots)[want.argmax(1)], np.arange(len(x)))
    assigned = {r.id: r.pivot for r in pivot.cluster(vectors(spark, x), 0.8, Scratch(spark))[0].collect()}
    assert near.sum(1).max() > 64 and sorted(set(assigned.values())) == sorted(set(group.tolist()))
    assert sum(assigned[i] != g for i, g in enumerate(group.tolist())) <= 2  # two pivots within 1e-4


@pytest.mark.parametrize("n", [40, 20])
def test_thinned_pairs_link_the_same_rows(n):
    # groups of ten, each linked to the next by its least similar pair, which is no neighbour of smallest rank
    s = np.full((40, 40), 0.1, np.float32)
    for g in range(4):
        at = np.arange(10 * g, 10 * g + 10)
        s[np.ix_(at, at)] = 0.95
    ids = np.concatenate([np.sort(g)[np.argsort(-pivot._rank(np.sort(g)))] for g in np.arange(40).reshape(4, 10)])
    order = np.arange(0, 40, 10)[np.argsort(-pivot._rank(ids[::10]))]
    for g, h in zip(order[:-1], order[1:]):
        s[g, h] = s[h, g] = 0.91
    a, b = (ids, ids) if n == 40 else (ids[:20], ids[20:])
    s = s if n == 40 else np.maximum(s[:20, 20:], np.kron(np.eye(2), np.full((10, 10), 0.95))).astype(np.float32)
    cols = pivot.similar_edges(0.9, dense=3)("v", a, b, s, n == 40)
    i, j = np.nonzero((s >= 0.9) & (a[:, None] != b))
    every, kept = union_find(a[i], b[j]), union_find(cols[1].to_numpy(), cols[2].to_numpy())
    assert all((u == v).all() for u, v in zip(every, kept)) and len(cols[0]) < len(i)


def test_dense_groups_that_one_pair_links_are_not_isolated(spark):
    # two groups of 80 around (1, 0) and at a right angle; row 0 and row 80 lean towards each other
    rng = np.random.default_rng(11)
    x = 0.01 * rng.normal(size=(160, 6))
    x[:80, 0] += 1
    x[80:, 1] += 1
    lean = np.deg2rad(27)
    x[0, :2], x[80, :2] = (np.cos(lean), np.sin(lean)), (np.sin(lean), np.cos(lean))
    x = np.concatenate([x, 0.01 * rng.normal(size=(5, 6)) - np.eye(6)[2]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    assert s[0, 80] >= 0.8 and (s[:80, 80:160] >= 0.8).sum() == 1 and s[:80, :80].min() >= 0.8 and s[80:160, 80:160].min() >= 0.8
    # ids of which the two leaning rows are nobody's neighbour of smallest rank
    ids = np.arange(165)
    ids[:160] = rng.permutation(160)
    while {np.argmin(pivot._rank(ids[:80])), np.argmin(pivot._rank(ids[80:160]))} & {0}:
        ids[:160] = rng.permutation(160)
    got = {r.id for r in isolated_clusters(vectors(spark, x, ids), 0.8, 4, Scratch(spark)).collect()}
    assert got == {160, 161, 162, 163, 164}


def test_a_clique_of_many_is_one_group(spark):
    rng = np.random.default_rng(12)
    x = 0.02 * rng.normal(size=(1200, 8)) + np.eye(8)[0]
    df = vectors(spark, np.concatenate([x, -np.eye(8)[:2]]))
    assert [r["size"] for r in clusters(df, 0.8, Scratch(spark)).collect()] == [1200]
    got = isolated_clusters(df, 0.8, 4, Scratch(spark)).collect()
    assert len({r.representative_id for r in got}) == 1 and {r.id for r in got} == set(range(1200))


def test_pairs_that_the_search_missed(spark, monkeypatch):
    # one visit of many small leaves misses pairs of most groups; edges lead back to the first pivot
    rng = np.random.default_rng(13)
    x = np.concatenate([4 * np.eye(16)[i] + 0.35 * rng.normal(size=(12, 16)) for i in range(16)])
    index = pivot.build_index
    monkeypatch.setattr(pivot, "build_index", lambda v, k, floor: index(v, k, floor, target=0.5, leaf_rows=4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    cut = next(f for f in (0.8, 0.7, 0.6) if all(s[i : i + 12, i : i + 12].min() >= f for i in range(0, 192, 12)))
    got = isolated_clusters(vectors(spark, x), cut, 4, Scratch(spark)).collect()
    assert len(got) >= 0.9 * len(x) and all(r.id // 12 == r.representative_id // 12 for r in got)


def test_sets_without_near_rows_are_calibrated(spark):
    rng = np.random.default_rng(14)
    df = Scratch(spark).save(vectors(spark, rng.normal(size=(600, 8))), "v")
    index = build_index(df, 4, 0.9999, target=0.9, leaf_rows=30)
    assert index.visits["s#8"] > 1 and 0.9 <= index.recall["s#8"] <= 1
