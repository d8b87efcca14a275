"""Hierarchical k-means tree over unit vectors, with batched best-bin-first traversal.

The tree is fitted on a bounded sample and is itself bounded (``max_leaves``), so it may be broadcast. Leaves hold no
rows: a row's leaf is the first one its own traversal reaches, and the rows stay in a distributed table keyed by leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth-first order; node 0 is the root, the children of a node are consecutive."""

    centers: np.ndarray  # float32 [nodes, d]
    first_child: np.ndarray  # int32 [nodes], -1 for a leaf
    n_children: np.ndarray  # int32 [nodes]
    leaf_of: np.ndarray  # int32 [nodes], -1 for an inner node

    @property
    def leaves(self) -> int:
        return int(self.leaf_of.max()) + 1


def _kmeans(x: np.ndarray, k: int, iters: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of ``x`` after Lloyd iterations from ``k`` distinct starting rows."""
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    label = np.zeros(len(x), np.int64)
    for _ in range(iters):
        new = np.argmax(x @ centers.T - 0.5 * (centers * centers).sum(1), axis=1)
        if (new == label).all() and _:
            break
        label = new
        order = np.argsort(label, kind="stable")
        found, start = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        centers[found] = sums / np.diff(np.append(start, len(x)))[:, None]
    return label


def fit_tree(sample: np.ndarray, leaves: int, branch: int = 16, iters: int = 10, seed: int = 7) -> Tree:
    """Split the sample recursively by k-means until each node holds its share for about ``leaves`` leaves.

    An empty sample, or one whose rows are all alike, gives a single leaf.
    """
    x = np.ascontiguousarray(sample, np.float32)
    rng = np.random.default_rng(seed)
    share = max(1.0, len(x) / max(1, leaves))
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1] if x.ndim == 2 else 1, np.float32)
    centers, first, count, queue, at = [mean], [-1], [0], [(0, np.arange(len(x)))], 0
    while at < len(queue):
        node, rows = queue[at]
        at += 1
        k = min(branch, int(np.ceil(len(rows) / share)))
        if k < 2 or len(rows) < 2 * k:
            continue
        label = _kmeans(x[rows], k, iters, rng)
        groups = [rows[label == g] for g in range(k)]
        groups = [g for g in groups if len(g)]
        if len(groups) < 2:
            continue
        first[node], count[node] = len(centers), len(groups)
        for g in groups:
            queue.append((len(centers), g))
            centers.append(x[g].mean(0))
            first.append(-1)
            count.append(0)
    first_child = np.asarray(first, np.int32)
    leaf_of = np.full(len(first), -1, np.int32)
    leaf_of[first_child < 0] = np.arange(int((first_child < 0).sum()), dtype=np.int32)
    return Tree(np.asarray(centers, np.float32), first_child, np.asarray(count, np.int32), leaf_of)


def best_bins(tree: Tree, queries: np.ndarray, visits: int) -> np.ndarray:
    """For each query the first ``visits`` leaves of its best-bin-first traversal, padded with -1.

    Every query has its own priority queue (a row of ``score``); in each step all queries pop their best node together,
    a popped leaf is a visit, a popped inner node puts its children into the queue.
    """
    n, visits = len(queries), min(visits, tree.leaves)
    out = np.full((n, visits), -1, np.int32)
    if not n:
        return out
    q = np.ascontiguousarray(queries, np.float32)
    half = 0.5 * (tree.centers * tree.centers).sum(1)
    widest = int(tree.n_children.max(initial=0))
    score = np.full((n, 1), 0.0, np.float32)
    node = np.zeros((n, 1), np.int32)
    done = np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        best = np.argmax(score[live], axis=1)
        popped = node[live, best]
        score[live, best] = -np.inf
        leaf = tree.leaf_of[popped]
        hit = leaf >= 0
        rows = live[hit]
        out[rows, done[rows]] = leaf[hit]
        done[rows] += 1
        inner, at = live[~hit], popped[~hit]
        if len(inner):
            wide_s = np.full((n, widest), -np.inf, np.float32)
            wide_n = np.full((n, widest), -1, np.int32)
            order = np.argsort(at, kind="stable")
            nodes, start = np.unique(at[order], return_index=True)
            for p, rows_p in zip(nodes, np.split(inner[order], start[1:])):
                kids = slice(tree.first_child[p], tree.first_child[p] + tree.n_children[p])
                width = tree.n_children[p]
                wide_s[rows_p, :width] = q[rows_p] @ tree.centers[kids].T - half[kids]
                wide_n[rows_p, :width] = np.arange(kids.start, kids.stop, dtype=np.int32)
            score, node = np.concatenate([score, wide_s], 1), np.concatenate([node, wide_n], 1)
            if score.shape[1] > 8 * widest + visits:  # popped entries leave the queue
                keep = np.argsort(-score, axis=1, kind="stable")[:, : int((score > -np.inf).sum(1).max(initial=1))]
                score, node = np.take_along_axis(score, keep, 1), np.take_along_axis(node, keep, 1)
        live = live[(done[live] < visits) & (score[live].max(axis=1) > -np.inf)]
    return out
