"""Approximate nearest neighbours by learned partitions.

From a bounded sample a nearest-neighbour graph is built and cut into balanced parts (recursive bisection, started along
the main direction and refined by swaps that lower the cut). A small network learns to tell the part of a vector. It
puts every row of the table into its most probable part, and sends a query to several, the most probable ones, where its
neighbours are found by exact inner product in double precision. Every row is indexed; there is no other cut.

There are `least_parts` parts, and one for `part_rows` rows where those are more, so that a part does not grow with the table. Beyond
`fan` parts the partition is one of partitions: each part is cut again, by a graph and a network of its own, learned where its
rows are, and a query's probability of a part is the product of the two. How many parts a query visits is set on rows that the
networks have not seen: so many that `cover` of their neighbours among such rows are in them, and more where the parts hold too few rows.

Equal vectors count once: each stands with its top + 1 smallest ids, which is all that any query can see of them, and equal
queries are searched once. So a third of the table in one point is one vector. Where a part gets many queries or rows (a
network that puts all into one part) it is searched in blocks of at most `block_rows` rows and queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or differ in length from the sample's most
common length, take no part; rows without id are no queries, and candidates after all others in ties; rows that share an id, or an
id and a vector, are rows of their own, and a query leaves out itself alone; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.llm.common import column, keep, table

TOP = 20
#: Rows of the sample: half of it teaches the networks, half sets the number of parts to visit.
SAMPLE = 8192
PART_ROWS = 8192
LEAST_PARTS = 32
FAN = 128
BLOCK_ROWS = 8192
COVER = 0.93
NEIGHBOURS = 10


def usable(vector: str = "embedding"):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def graph(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Symmetric nearest-neighbour lists by inner product."""
    near = [set() for _ in range(len(x))]
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        for i, row in enumerate(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else []):
            for j in row:
                near[at + i].add(int(j))
                near[int(j)].add(at + i)
    return [np.array(sorted(n), dtype=np.int64) for n in near]


def halve(x: np.ndarray, near: list[np.ndarray], nodes: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """True for the nodes of the first side, which gets this share of them."""
    own = x[nodes] - x[nodes].mean(axis=0)
    main = np.linalg.svd(own, full_matrices=False)[2][0] if len(nodes) > 1 else np.ones(x.shape[1])
    size = round(len(nodes) * share)
    side = np.zeros(len(nodes), dtype=bool)
    side[np.argsort(own @ main, kind="stable")[:size]] = True
    place = {int(n): k for k, n in enumerate(nodes)}
    inner = [np.array([place[int(j)] for j in near[int(n)] if int(j) in place], dtype=np.int64) for n in nodes]
    for _ in range(rounds):
        gain = np.array([np.sum(side[i] != side[k]) - np.sum(side[i] == side[k]) for k, i in enumerate(inner)])
        ones, others = np.flatnonzero(side), np.flatnonzero(~side)
        ones, others = ones[np.argsort(-gain[ones], kind="stable")], others[np.argsort(-gain[others], kind="stable")]
        pairs = min(len(ones), len(others))
        good = int(np.sum(gain[ones[:pairs]] + gain[others[:pairs]] > 2))
        if not good:
            break
        take = max(1, good // 4)
        side[ones[:take]], side[others[:take]] = False, True
    return side


def partition(x: np.ndarray, near: list[np.ndarray], parts: int) -> np.ndarray:
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        nodes, base, k = todo.pop()
        if k == 1:
            label[nodes] = base
            continue
        left = k // 2
        side = halve(x, near, nodes, left / k)
        todo += [(nodes[side], base, left), (nodes[~side], base + left, k - left)]
    return label


class Router:
    """A network with one hidden layer: the parts' probabilities of a vector's direction."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, steps: int = 400, seed: int = 5):
        draw = np.random.default_rng(seed)
        d = x.shape[1]
        self.w = [draw.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), draw.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        self.scale = float(np.sqrt(d))
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        unit = self._unit(x)
        for t in range(1, steps + 1):
            pick = draw.integers(0, len(x), 512)
            a, y = unit[pick], label[pick]
            h = np.maximum(a @ self.w[0] + self.w[1], 0)
            p = self._soft(h @ self.w[2] + self.w[3])
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ self.w[2].T) * (h > 0)
            for k, g in enumerate((a.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                g = g + 1e-4 * self.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * self.scale

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the parts' probabilities."""
        z = np.maximum(self._unit(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Tree:
    """One router, or one for the parts and one within each of them. Part p of a tree of two levels is part p % inner of part p // inner."""

    def __init__(self, root: Router, children: dict[int, Router] | None = None, outer: int = 1, inner: int = 1):
        self.root, self.children, self.parts, self.inner = root, children, outer * inner, inner

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        logs = self.root.logs(x)
        if self.children is not None:
            even = np.full((len(x), self.inner), -np.log(self.inner))
            logs = np.concatenate([logs[:, [k]] + (self.children[k].logs(x) if k in self.children else even) for k in range(logs.shape[1])], axis=1)
        return np.argsort(-logs, axis=1, kind="stable")


def learned(x: np.ndarray, parts: int) -> Router:
    parts = min(parts, max(1, len(x)))
    return Router(x, partition(x, graph(x, NEIGHBOURS), parts), parts)


def matrix(values: pa.Array, d: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


#: Stands for no id where ids are compared.
UNNAMED = np.iinfo(np.int64).max


def best(queries: np.ndarray, rows: np.ndarray, ids: list[list[int | None]], top: int) -> Iterator[tuple[int, list[int | None], list[float], list[bool]]]:
    """Of each query the ids of its nearest rows, top at most, ties to the smaller id, their scores, and whether they are equal to the query; rough
    scores choose, sums in one order decide."""
    least_ids = np.array([UNNAMED if i[0] is None else i[0] for i in ids], np.int64)
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ rows.T
        for i, line in enumerate(rough):
            k = at + i
            pick = np.arange(len(line))
            if len(line) > top:
                least = np.partition(line, len(line) - top)[len(line) - top]
                pick = np.flatnonzero(line >= least - 1e-9 * max(1.0, abs(least)))
            exact = (rows[pick] * queries[k]).sum(axis=1)
            order = np.lexsort((least_ids[pick], -exact))[:top]
            found = sorted((-s, x is None, x or 0, bool((rows[p] == queries[k]).all())) for p, s in zip(pick[order].tolist(), exact[order].tolist(), strict=True) for x in ids[p])[:top]
            yield k, [None if unnamed else x for _, unnamed, x, _ in found], [-s for s, *_ in found], [twin for *_, twin in found]


def _children(outer: int, inner: int, sample: int, d: int):
    """A router for each part, learned from its drawn rows, as bytes."""
    def run(group: pa.Table) -> pa.Table:
        x = matrix(group.column("v").combine_chunks(), d)[:sample]
        return pa.table({"part": group.column("part")[:1], "router": pa.array([pickle.dumps(learned(x, inner))], pa.binary())})

    return run


def learn(rows: DataFrame, n: int, parts: int, fan: int, sample: int, cover: float) -> tuple[Tree | None, int, int]:
    """The tree, the length of vectors, and how many parts a query visits, from a bounded sample of rows (vec_id, v)."""
    draw = F.pmod(F.xxhash64("v", F.lit("ann")), F.lit(1 << 40))
    # The first by hash: the same rows in every run.
    drawn = rows.where(draw < int(min(1.0, 1.5 * sample / max(n, 1)) * (1 << 40))).select("v", draw.alias("drawn")).orderBy("drawn", "v").limit(sample).toArrow()
    if not drawn.num_rows:
        return None, 1, 1
    values = drawn.column("v").combine_chunks()
    lengths = values.value_lengths().to_numpy()
    d = int(np.bincount(lengths).argmax())
    x = matrix(values.filter(pa.array(lengths == d)), d)
    taught, unseen = x[: max(1, len(x) // 2)], x[len(x) // 2 :]
    outer, inner = (parts, 1) if parts <= fan else (-(-parts // fan) if parts <= fan * fan else fan, fan)
    outer = min(outer, len(taught))
    tree = Tree(learned(taught, outer), None, outer)
    if inner > 1:
        shared = rows.sparkSession.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(column(batch, "v"), d)
                part = shared.value.ranked(v)[:, 0] if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([column(batch, "v"), pa.array(part.astype(np.int32))], ["v", "part"])

        some = rows.where((F.size("v") == d) & (F.pmod(F.xxhash64("v", F.lit("child")), F.lit(1 << 40)) < int(min(1.0, outer * sample / max(n, 1)) * (1 << 40))))
        # No part's group grows beyond twice the sample, however uneven the parts are.
        rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("v", F.lit("child")), "v"))
        bounded = some.select("v").mapInArrow(place, "v array<double>, part int").select("*", rank.alias("rank")).where(F.col("rank") <= 2 * sample).drop("rank")
        found = bounded.groupBy("part").applyInArrow(_children(outer, inner, sample, d), "part int, router binary").collect()
        tree = Tree(tree.root, {r[0]: pickle.loads(r[1]) for r in found}, outer, inner)
    ranked = tree.ranked(unseen)
    near, at = graph(unseen, NEIGHBOURS), np.argsort(ranked, axis=1)
    reach = np.concatenate([at[i, ranked[j, 0]] for i, j in enumerate(near)]) if len(unseen) > 1 else np.zeros(1, np.int64)
    share = np.cumsum(np.bincount(reach, minlength=tree.parts)) / max(len(reach), 1)
    return tree, d, min(tree.parts, int(np.searchsorted(share, cover)) + 1)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, sample: int = SAMPLE, part_rows: int = PART_ROWS, least_parts: int = LEAST_PARTS, fan: int = FAN, block_rows: int = BLOCK_ROWS, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where is_query holds, their nearest among all rows but their own."""
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), (F.coalesce(is_query, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).alias("asks")).where(usable("v"))
    # Each distinct vector with its smallest ids; the window is cut in each task before anything is exchanged.
    firsts = named.select("v", "vec_id").select("*", F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))).alias("nth")).where(F.col("nth") <= top + 1)
    points = keep(firsts.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))).alias("held")).select("v", F.transform("held", lambda z: z["vec_id"]).alias("ids")))
    n = points.count()
    tree, d, probes = learn(points, n, max(least_parts, -(-n // part_rows)), fan, sample, cover)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(column(batch, "v"), d)
            part = shared.value.ranked(v)[:, 0] if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    placed = keep(points.where(F.size("v") == d).mapInArrow(place, "v array<double>, ids array<long>, part int"))
    sizes = np.zeros(tree.parts, np.int64)
    for part, count in placed.groupBy("part").count().collect():
        sizes[part] = count
    asking = keep(named.where("asks").select("v").distinct().where(F.size("v") == d))
    row_blocks = np.maximum(1, -(-sizes // block_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(column(batch, "v"), d)
            who, part = [], []
            for i, line in enumerate(shared.value.ranked(v) if len(v) else ()):
                enough = int(np.searchsorted(np.cumsum(sizes[line]), 2 * top + 1)) + 1
                mine = line[: max(probes, enough)]
                mine = mine[sizes[mine] > 0]
                who.append(np.full(len(mine), i))
                part.append(mine)
            rows_of = pa.array(np.concatenate(who) if who else [], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "v").take(rows_of), pa.array(np.concatenate(part) if part else [], pa.int32())], ["v", "part"])

    routed = asking.mapInArrow(route, "v array<double>, part int")
    # Queries of a part are at most asking rows a part times the parts visited; only beyond a block's size are a part's rows sent twice.
    asked = asking.count()
    query_blocks = max(1, ceil(asked * probes / tree.parts / block_rows))
    blocks_of = F.element_at(F.from_json(F.lit(json.dumps(row_blocks.tolist())), "array<int>"), F.col("part") + 1)
    right = placed.select("part", F.pmod(F.xxhash64("v"), blocks_of).cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), "ids", "v")
    left = routed.select("part", F.explode(F.sequence(F.lit(0), blocks_of - 1)).alias("row_block"), F.pmod(F.xxhash64("v", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"), "v")

    def rerank(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        ids, scores, twins = [], [], []
        if queries.num_rows and block.num_rows:
            for _, near, exact, equal in best(matrix(queries.column("v").combine_chunks(), d), matrix(block.column("v").combine_chunks(), d), block.column("ids").to_pylist(), top + 1):
                ids.append(near)
                scores.append(exact)
                twins.append(equal)
        asked_v = queries.column("v").combine_chunks() if ids else pa.array([], pa.list_(pa.float64()))
        return pa.table({"v": asked_v, "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64())), "twins": pa.array(twins, pa.list_(pa.bool_()))})

    on = ["part", "row_block", "query_block"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(rerank, "v array<double>, ids array<long>, scores array<double>, twins array<boolean>")
    # A query's lists are as many as the parts and blocks it visits.
    pairs = F.array_sort(F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "scores", "twins"), lambda z: F.struct((-z["scores"]).alias("far"), z["ids"].isNull().alias("unnamed"), z["ids"].alias("id"), z["twins"].alias("twin"))))))
    lists = found.groupBy("v").agg(pairs.alias("near"))
    asks = named.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    # A query leaves itself out once, where it is among the first.
    itself = F.array_position(F.transform("near", lambda z: F.coalesce(z["twin"] & (z["id"] == F.col("query_id")), F.lit(False))), True)
    others = F.slice(F.filter(F.col("near"), lambda z, k: k + 1 != F.col("itself")), 1, top)
    mine = asks.select("query_id", "near", itself.alias("itself")).select("query_id", F.posexplode(others).alias("at", "z"))
    return mine.select("query_id", (F.col("at") + 1).alias("rank"), F.col("z.id").alias("vec_id"), (-F.col("z.far")).alias("score"))


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
