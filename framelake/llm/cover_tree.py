"""Exact top-k search by largest inner product with two cover trees.

The table is cut into parts around pivots, the first centres of a cover tree over a bounded sample; a part is known by its pivot, its covering
radius and its number of rows. Within a part, blocks of rows and blocks of queries get a cover tree each, and both are descended
together: no vector below node p has, with any query below node q, a larger inner product than
<q, p> + r_p |q| + r_q |p| + r_q r_p, so a pair of nodes whose bound is under the worst k-th score of q's queries is left out. Centres are rows
themselves, so the k-th largest lower bound of the centres seen is such a worst score, for a whole group of queries at once.

Queries first search the parts nearest to them; with the k-th scores found there they go to those of the other parts that their bounds
cannot leave out, and to no others. Nothing is approximate: where vectors are spread so evenly that no bound leaves a part out, a
query visits all of them.

Components become floor(scale * x). Inner products are compared exactly: in double precision where no sum can pass 2 ** 53, and in whole numbers
otherwise. Equal vectors count once, each with the top + 1 smallest ids of its rows, which is all that any query can see of them. A part with over
`block_rows` rows or queries is searched in blocks, so no task grows with the table.

Defined cases: null vectors and those that hold null or non-finite components (or overflow when scaled) take no part, as queries or candidates; zero and
empty vectors do; vectors are compared with those of their own length; rows without id are candidates, after all others in ties,
with a null vec_id, and no queries; rows that share an id are rows of their own: a query leaves out itself alone; scores beyond a
long are the largest or smallest long; ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import column, keep, table

TOP = 5
SCALE = 256
#: Rows of the sample that pivots come from, and most pivots.
SAMPLE = 4096
MOST_PIVOTS = 4096
PART_ROWS = 4096
LEAST_PARTS = 6
BLOCK_ROWS = 4096
#: Doubles hold whole numbers below this.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: A floor above this would leave out scores that are cut to the largest long.
TOPMOST = float(1 << 63) * (1 - 1e-12)
#: Components beyond this are compared in whole numbers alone, without trees.
HUGE = 2.0**200
SLACK = 1e-9


def scaled(vector: str, scale: int = SCALE):
    """floor(scale * x) of each component, whole numbers in doubles; those of 2 ** 53 and more are whole as they are."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))


def usable(vector: str):
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class CoverTree:
    """Over distinct points. Centres of level l are more than 2 ** l apart (where doubles can tell), each under its nearest centre of level l + 1, which
    is within 2 ** (l + 1). Nodes are (point, k): the point with what comes under it from its k-th level with children on; children(node)
    are the point's next node and the other points of that level. reach is the largest distance of a node to what is below it.
    """

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.order, self.level, self.parent = self._net()
        self.size = norms(x)
        # Points by parent and level, the highest level first: the runs are the parents' nodes.
        others = self.order[1:]
        rank = np.lexsort((-self.level[others], self.parent[others]))
        kids = others[rank]
        new = np.ones(len(kids), bool)
        new[1:] = (self.parent[kids[1:]] != self.parent[kids[:-1]]) | (self.level[kids[1:]] != self.level[kids[:-1]])
        self.kids, self.run = kids, np.append(np.flatnonzero(new), len(kids))
        levels = np.bincount(self.parent[kids[self.run[:-1]]], minlength=n) if len(kids) else np.zeros(n, np.int64)
        # Node numbers: each point's nodes in a row, the last of them the point alone.
        self.first = np.concatenate([[0], np.cumsum(levels + 1)])
        self.point = np.repeat(np.arange(n), levels + 1)
        self.leaf = np.zeros(len(self.point), bool)
        self.leaf[self.first[1:] - 1] = True
        self.group = np.cumsum(~self.leaf) - 1
        self.reach = self._reach()

    def _net(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, n = self.x, len(self.x)
        level, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
        far = self._apart(x, x[:1])[:, 0]
        near, order, left = np.zeros(n, np.int64), [np.array([0])], np.arange(1, n)
        top = int(np.ceil(np.log2(far.max()))) if n > 1 and far.max() > 0 else 0
        level[0] = top
        lowest = min(-2, top - 60)
        at = top - 1
        while len(left):
            above, chosen = near.copy(), []
            bare = left[far[left] > 2.0**at] if at > lowest else left
            for k in range(0, len(bare), 256):
                some = bare[k : k + 256]
                if at > lowest:
                    some = some[far[some] > 2.0**at]
                    between = self._apart(x[some], x[some])
                    taken = np.zeros(len(some), bool)
                    for i in range(len(some)):
                        taken[i] = not (between[i][taken] <= 2.0**at).any()
                    some = some[taken]
                chosen.append(some)
                # What this adds may cover the points after it.
                d = self._apart(x[left], x[some]) if len(some) else np.zeros((len(left), 0))
                if d.shape[1]:
                    best = d.argmin(axis=1)
                    least = d[np.arange(len(left)), best]
                    nearer = least < far[left]
                    far[left[nearer]], near[left[nearer]] = least[nearer], some[best[nearer]]
            new = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            if len(new):
                level[new], parent[new] = at, above[new]
                order.append(new)
                gone = np.zeros(n, bool)
                gone[new] = True
                left = left[~gone[left]]
            at -= 1
        return np.concatenate(order), level, parent

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))

    def _reach(self) -> np.ndarray:
        """Of each node the largest distance from its point to a point below it."""
        reach = np.zeros(len(self.point))
        run_of = np.empty(len(self.x), np.int64)
        run_of[self.kids] = np.repeat(np.arange(len(self.run) - 1), np.diff(self.run))
        node_of_run = np.flatnonzero(~self.leaf)
        who = self.kids.copy()
        climber = who.copy()
        while len(who):
            node = node_of_run[run_of[climber]]
            up = self.parent[climber]
            np.maximum.at(reach, node, norms(self.x[who] - self.x[up]))
            more = up != self.order[0]
            who, climber = who[more], up[more]
        # A node holds what the point's later nodes hold.
        for i in range(len(reach) - 2, -1, -1):
            if self.point[i] == self.point[i + 1]:
                reach[i] = max(reach[i], reach[i + 1])
        return reach

    def children(self, node: int) -> np.ndarray:
        g = self.group[node]
        return np.concatenate([[node + 1], self.first[self.kids[self.run[g] : self.run[g + 1]]]])

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        """The children of these nodes; points alone stay."""
        open_ = nodes[~self.leaf[nodes]]
        g = self.group[open_]
        begin, n = self.run[g], self.run[g + 1] - self.run[g]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.concatenate([nodes[self.leaf[nodes]], open_ + 1, self.first[self.kids[at]]])

    @property
    def root(self) -> int:
        return int(self.first[self.order[0]])


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def whole(a: np.ndarray, b: np.ndarray) -> int:
    """Their inner product in whole numbers, as a long can hold it."""
    return min(max(sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), -LONG - 1), LONG)


def best_pairs(queries: np.ndarray, floors: np.ndarray, rows: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each query with any: its number, row numbers and exact inner products, among them the `top` largest of all rows and all that tie with the
    last of these, but none below the query's floor, a score that the query has elsewhere reached `top` times."""
    if not len(queries) or not len(rows):
        return

    def picked(points: np.ndarray, scores: list[int], floor: float) -> tuple[np.ndarray, list[int]]:
        least = max(sorted(scores)[-top] if len(scores) >= top else -np.inf, floor)
        pick = [j for j, s in enumerate(scores) if s >= least]
        return points[pick], [scores[j] for j in pick]

    most = max(float(np.abs(queries).max(initial=0)), float(np.abs(rows).max(initial=0)))
    if most > HUGE:
        for i, q in enumerate(queries):
            yield i, *picked(np.arange(len(rows)), [whole(q, r) for r in rows], floors[i])
        return
    # The largest sum of products on the way: squares of distances are at most four times as much.
    exact = 4 * most * most * max(rows.shape[1], 1) < EXACT
    asked, data = CoverTree(queries), CoverTree(rows)
    lows = _lows(asked, floors[asked.point])
    below = [(asked.root, np.array([data.root]), -np.inf)]
    while below:
        q, nodes, floor = below.pop()
        v, reach_q, size_q, every = queries[asked.point[q]], asked.reach[q], asked.size[asked.point[q]], None
        floor = max(floor, lows[q])
        while True:
            points = data.point[nodes]
            if every is None and 4 * len(points) > len(rows):
                every = rows @ v
            score, size, reach = rows[points] @ v if every is None else every[points], data.size[points], data.reach[nodes]
            # For sums and roots that doubles round.
            fuzz = SLACK * (size_q + reach_q) * (size + reach)
            # A point stands at one node of a list at most, so each lower bound is one of another row.
            floor = min(max(floor, kth(score - reach_q * size - fuzz, top)), TOPMOST)
            near = score + reach * size_q + reach_q * size + reach_q * reach + fuzz >= floor
            nodes = nodes[near]
            inner = ~data.leaf[nodes]
            if not inner.any() or (not asked.leaf[q] and reach_q > data.reach[nodes].max()):
                break
            nodes = data.opened(nodes)
        if asked.leaf[q]:
            points = data.point[nodes]
            scores = [int(s) for s in score[near].tolist()] if exact else [whole(v, rows[p]) for p in points]
            yield int(asked.point[q]), *picked(points, scores, floors[asked.point[q]])
        elif len(nodes):
            below += [(int(c), nodes, floor) for c in asked.children(q)]


def _lows(tree: CoverTree, own: np.ndarray) -> np.ndarray:
    """The smallest of `own`, a value for each node's point, among the points below each node."""
    lows = own.copy()
    # Children come after their parents by level: from the lowest level up.
    for p in tree.order[::-1]:
        for node in range(tree.first[p + 1] - 2, tree.first[p] - 1, -1):
            lows[node] = min(own[node], *lows[tree.children(node)])
    return lows


def matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), len(flat) // max(len(values), 1))


def pivots(points: DataFrame, n: int, part_rows: int, least_parts: int, sample: int, most: int) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, the first centres of a cover tree over it."""
    draw = F.pmod(F.xxhash64("v", F.lit("pivot")), F.lit(1 << 40))
    drawn = points.where(draw < int(min(1.0, 1.5 * sample / max(n, 1)) * (1 << 40))).select("v", draw.alias("drawn")).orderBy("drawn", "v").limit(sample).toArrow().column("v").combine_chunks()
    lengths = np.array(drawn.value_lengths().to_pylist(), np.int64)
    parts = min(most, max(least_parts, -(-n // part_rows)))
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        x = matrix(drawn.filter(pa.array(lengths == d)))
        share = max(1, round(parts * len(x) / len(lengths)))
        if np.abs(x).max() <= HUGE:
            out[int(d)] = x[CoverTree(x).order[:share]]
    return out


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, scale: int = SCALE, part_rows: int = PART_ROWS, least_parts: int = LEAST_PARTS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where is_query holds, the rows but themselves with the largest inner products."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("given"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    named = raw.select("id", scaled("given", scale).alias("v"), (F.col("asks") & F.col("id").isNotNull()).alias("asks")).where(usable("v"))
    # The smallest ids of each distinct vector, cut in each task before anything is exchanged; null stands last.
    firsts = named.select("v", "id").select("*", F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))).alias("nth")).where(F.col("nth") <= top + 1)
    points = keep(firsts.groupBy("v").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("unnamed"), "id"))).alias("ids")).select(F.monotonically_increasing_id().alias("p"), "v", F.transform("ids", lambda z: z["id"]).alias("ids")))
    n = points.count()
    shared = spark.sparkContext.broadcast(pivots(points, n, part_rows, least_parts, sample, most_pivots))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """d, the vectors' length, part, the number of the nearest pivot, and apart, its distance."""
        for batch in batches:
            v = column(batch, "v")
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(v) else np.zeros(0, np.int64)
            part, apart = np.zeros(len(v), np.int32), np.zeros(len(v))
            for d in np.unique(lengths):
                mine = np.flatnonzero(lengths == d)
                centres = shared.value.get(int(d))
                if centres is not None:
                    x = matrix(v.take(pa.array(mine)))
                    for at in range(0, len(x), 1024):
                        part[mine[at : at + 1024]] = CoverTree._apart(x[at : at + 1024], centres).argmin(axis=1)
                    apart[mine] = norms(x - centres[part[mine]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(part), pa.array(apart)], [*batch.schema.names, "d", "part", "apart"])

    placed = keep(points.mapInArrow(nearest, "p long, v array<double>, ids array<long>, d int, part int, apart double"))
    sizes = keep(placed.groupBy("d", "part").agg(F.count("*").alias("n"), F.max("apart").alias("reach")))
    # One row a pivot; lengths that the sample has not met have part 0 alone, and are not known to the driver.
    about: dict[int, dict[int, tuple[int, float]]] = {}
    lengths = list(shared.value)
    for d, part, count, reach in sizes.where(F.col("d").isin(lengths)).collect() if lengths else []:
        about.setdefault(d, {})[part] = (count, reach)
    known = spark.sparkContext.broadcast(about)
    asking = keep(named.where("asks").select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v", F.lit(float("-inf")).alias("floor")))

    def routed(first: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, floors = column(batch, "v"), column(batch, "floor").to_numpy(zero_copy_only=False)
                lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(v) else np.zeros(0, np.int64)
                who, part = [], []
                for d in np.unique(lengths):
                    mine = np.flatnonzero(lengths == d)
                    parts = np.array(sorted(known.value.get(int(d), {})), np.int64)
                    if not len(parts):
                        # Not in the sample: one part, searched in the first round.
                        if first:
                            who.append(mine)
                            part.append(np.zeros(len(mine), np.int64))
                        continue
                    centres = shared.value[int(d)][parts]
                    counts, reach = (np.array([known.value[int(d)][int(k)][i] for k in parts]) for i in (0, 1))
                    x = matrix(v.take(pa.array(mine)))
                    score = x @ centres.T
                    order = np.argsort(-score, axis=1, kind="stable")
                    # The nearest parts that hold top + 1 distinct vectors come first, in both rounds alike.
                    held = np.cumsum(counts[order], axis=1) - counts[order]
                    home = np.zeros(score.shape, bool)
                    np.put_along_axis(home, order, held < top + 1, axis=1)
                    size = norms(x)
                    upper = score + reach * size[:, None] * (1 + 1e-9) + 1e-9 * size[:, None] * norms(centres)
                    go = home if first else ~home & ~(upper < floors[mine][:, None])
                    i, k = np.nonzero(go)
                    who.append(mine[i])
                    part.append(parts[k])
                rows = pa.array(np.concatenate(who) if who else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, "q").take(rows), column(batch, "v").take(rows), column(batch, "floor").take(rows), pa.array((np.concatenate(part) if part else np.zeros(0)).astype(np.int32))], ["q", "v", "floor", "part"])

        return route

    def rerank(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        q, ids, scores, twins = [], [], [], []
        if queries.num_rows and block.num_rows:
            numbers, names = queries.column("q").to_pylist(), block.column("ids").to_pylist()
            asked, rows = (matrix(t.column("v").combine_chunks()) for t in (queries, block))
            for i, pick, found in best_pairs(asked, queries.column("floor").to_numpy(), rows, top + 1):
                seen = sorted((-s, x is None, x or 0, bool((rows[j] == asked[i]).all())) for j, s in zip(pick.tolist(), found, strict=True) for x in names[j])[: top + 1]
                q += [numbers[i]] * len(seen)
                scores += [-s for s, *_ in seen]
                ids += [None if unnamed else x for _, unnamed, x, _ in seen]
                twins += [twin for *_, twin in seen]
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()), "twin": pa.array(twins, pa.bool_())})

    def found_by(queries: DataFrame, first: bool) -> DataFrame:
        """q, id, score, and twin, whether the vectors are equal: top + 1 for each query and block at most."""
        sent = queries.mapInArrow(routed(first), "q long, v array<double>, floor double, part int").withColumn("d", F.size("v"))
        asked = sent.groupBy("d", "part").agg(F.count("*").alias("asked"))
        # How many blocks of rows and of queries a part is dealt into.
        blocks = keep(sizes.join(asked, ["d", "part"]).select("d", "part", F.ceil(F.col("n") / block_rows).cast("int").alias("row_blocks"), F.ceil(F.col("asked") / block_rows).cast("int").alias("query_blocks")))
        left = sent.join(blocks, ["d", "part"]).select("d", "part", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"), F.pmod(F.xxhash64("q"), F.col("query_blocks")).cast("int").alias("query_block"), "q", "v", "floor")
        right = placed.join(blocks, ["d", "part"]).select("d", "part", F.pmod(F.xxhash64("p"), F.col("row_blocks")).cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "ids", "v")
        on = ["d", "part", "row_block", "query_block"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(rerank, "q long, id long, score long, twin boolean")

    order = [F.desc("score"), F.asc_nulls_last("id")]
    by_query = Window.partitionBy("q").orderBy(*order)

    def nearest_of(found: DataFrame) -> DataFrame:
        return found.select("*", F.row_number().over(by_query).alias("nth")).where(F.col("nth") <= top + 1)

    one = keep(nearest_of(found_by(asking, True)))
    # The score that a query has reached top + 1 times (once may be by itself): what is below it elsewhere is no use.
    score = F.col("score").cast("double")
    reached = one.where(F.col("nth") == top + 1).select("q", F.when(F.abs(score) < EXACT, score).when(score > 0, score * (1 - 1e-12)).otherwise(float("-inf")).alias("reached"))
    again = keep(asking.join(reached, "q", "left").select("q", "v", F.coalesce("reached", "floor").alias("floor")))
    both = nearest_of(one.drop("nth").unionByName(found_by(again, False)))
    lists = both.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score", "twin"))).alias("near"))
    asks = named.where("asks").select(F.col("id").alias("query_id"), "v")
    listed = asks.join(asking.join(lists, "q").select("v", "near"), "v").select("query_id", "near")
    # A query leaves itself out once, where it is among the first.
    itself = F.array_position(F.transform("near", lambda z: F.coalesce(z["twin"] & (z["id"] == F.col("query_id")), F.lit(False))), True)
    others = F.slice(F.filter(F.col("near"), lambda z, k: k + 1 != F.col("itself")), 1, top)
    return listed.select("query_id", "near", itself.alias("itself")).select("query_id", F.posexplode(others).alias("at", "z")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("z.id").alias("vec_id"), F.col("z.score").alias("score"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
