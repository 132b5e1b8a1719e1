"""Cover trees and the search with them against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import cover_tree
from tests.oracle import same

ROWS = "vec_id long, embedding array<double>, v string, q int"
LONG = 2**63


def vectors(seed):
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(k, [x + draw.gauss(0, 0.02) for x in draw.choice(centres)]) for k in range(160)]
    rows += [(draw.randrange(160), [draw.uniform(-2, 2) for _ in range(4)]) for _ in range(40)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(200, 260)] + [(220, [0.5, 0.5, 0.5, 0.5])] * 3 + [(None, [0.5, 0.5, 0.5, 0.5])] * 2
    rows += [(None, [3.0, 3.0, 3.0, 3.0]), (240, [0.0] * 4), (20, None), (40, [1.0, None, 1.0, 1.0]), (60, [math.nan, 0.0, 0.0, 0.0]), (80, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(300, [1.0, 2.0]), (301, [-1.0, 2.0]), (320, []), (340, []), (360, [1.0])]
    rows += [(400, [1e9, 1.0, 0.0, 0.0]), (420, [1e9 + 1, -1.0, 0.0, 0.0]), (440, [1e300, 0.0, 0.0, 0.0]), (460, [-1e300, 0.0, 1e-300, 0.0]), (480, [-0.0, -1e-9, 1.7e308, 0.0])]
    draw.shuffle(rows)
    return rows


def by_hand(rows, top, every=20):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    kept = [(k, i, w) for k, (i, v) in enumerate(rows) if (w := whole(v)) is not None]
    out = []
    for k, i, v in kept:
        if i is None or i % every:
            continue
        found = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -LONG), LONG - 1), j is None, j or 0) for n, j, w in kept if n != k and len(w) == len(v)]
        out += [(i, r, None if unnamed else j, -s) for r, (s, unnamed, j) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"part_rows": 10, "block_rows": 7}, {"sample": 12, "least_parts": 3, "top": 2}, {"top": 500}])
def test_search(spark, settings):
    rows = vectors(len(settings))
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS).repartition(3)
    found = cover_tree.search(table, F.col("vec_id") % 20 == 0, **settings)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows, settings.get("top", 5))


def test_without_rows(spark):
    assert cover_tree.search(spark.createDataFrame([], ROWS), F.col("vec_id") % 20 == 0).count() == 0
    assert cover_tree.search(spark.createDataFrame([(0, [1.0], "", 1), (20, None, "", 1)], ROWS), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("n", "d", "far"), [(1, 3, 5), (2, 1, 9), (300, 2, 30), (400, 6, 1000), (250, 3, 2**40)])
def test_trees_cover(n, d, far):
    draw = np.random.default_rng(n)
    x = np.unique(draw.integers(-far, far, (n, d)).astype(float), axis=0)
    draw.shuffle(x)
    tree = cover_tree.CoverTree(x)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert sorted(tree.order) == list(range(len(x)))

    def points(node):
        p = int(tree.point[node])
        return {p} if tree.leaf[node] else set().union(*(points(int(c)) for c in tree.children(node)))

    assert points(tree.root) == set(range(len(x)))
    for node in range(len(tree.point)):
        assert tree.reach[node] == max(apart[tree.point[node], j] for j in points(node))
    for i in tree.order[1:]:
        # Nested in its parent, which covers it; apart from all centres of its level and above.
        assert apart[i, tree.parent[i]] <= 2.0 ** (tree.level[i] + 1) and tree.level[tree.parent[i]] > tree.level[i]
        others = [j for j in range(len(x)) if j != i and tree.level[j] >= tree.level[i]]
        assert all(apart[i, j] > 2.0 ** tree.level[i] for j in others)


def test_bounds_leave_out_far_clusters(monkeypatch):
    draw = np.random.default_rng(7)
    x = np.unique(np.concatenate([draw.integers(-9, 9, (200, 3)) + np.array(c) for c in ([5000, 0, 0], [0, 5000, 0], [0, 0, 5000])]).astype(float), axis=0)
    opened = []
    tree = cover_tree.CoverTree.opened
    monkeypatch.setattr(cover_tree.CoverTree, "opened", lambda self, nodes: opened.append(len(out := tree(self, nodes))) or out)
    queries = x[x[:, 0] > 2000][:40]
    for i, points, scores in cover_tree.best_pairs(queries, np.full(len(queries), -np.inf), x, 6):
        s = x @ queries[i]
        assert sorted(scores) == sorted(int(v) for v in s[s >= np.sort(s)[-6]]) and all(x[points, 0] > 2000)
    assert max(opened) < len(x) / 2


def test_sql_gives_the_same_rows(spark):
    same(spark, cover_tree.op11_cover_tree, cover_tree.OP11_SQL, "/root/testdata/sf0.001")
