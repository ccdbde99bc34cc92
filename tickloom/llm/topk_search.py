"""Exact top-k inner-product search with cover trees over queries and data.

Vectors become whole numbers. A net of centres (farthest first, on a bounded sample) is the trees' top level: every
vector goes to its nearest centre, and cells are split by row, so that a block holds a bounded number of vectors.
Each block gets a cover tree, built once and stored: a node has a centre and a covering radius; its children cover its points within a
smaller radius and their centres are that far apart. Children of one point have no radius; they are kept side by side and tested at once.
Two nodes' largest inner product is at most q·p + Rq|p| + Rp|q| + Rq·Rp. Query blocks first search a data block of their
own centre; that gives every query a k-th score. Then the cells, their blocks and the blocks' trees are searched, dual-tree, by the same
rule: node pairs whose bound is under the query group's worst k-th score are left out. A data block meets a few query blocks at a time;
only queries travel once per pair. A bound that only ties is kept, so ties go to the smaller id exactly.

Defined results: null vectors and vectors with null or non-finite components take no part; shorter vectors count as filled
up with zeros; a query id that several rows share is one query, with the smallest of their vectors, and none of those rows is its
candidate; other repeated rows are candidates each; a query with fewer candidates gets them all; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, written

K, SCALE = 20, 64
#: Rows of the sample that the centres come from, most centres, rows of a data block and of a query block, query blocks per search.
SAMPLE, CENTRES, DATA_ROWS, QUERY_ROWS, TOGETHER = 2048, 256, 2048, 1024, 16
#: Points up to which a node has no child nodes; each level's radius is so much smaller; points up to which a query node's are searched at once.
LEAF, SHRINK, AT_ONCE = 64, 1.3, 256
#: Leaves of a data tree that a query without scores meets first.
SEEDS = 16
LOW = np.iinfo(np.int64).min


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key as vec_id, v array<long>: floor(64 x) of each component, of the vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return usable.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


class Tree:
    """A block's points in tree order and its nodes.

    Node n has the points first[n]:last[n], of which first[n]:single[n] are its children of one point, the child nodes
    below[start[n]:start[n + 1]], the point centre[n] as its centre and the covering radius[n]. Node 0 is the root.
    """

    NAMES = ("ids", "points", "first", "single", "last", "radius", "centre", "start", "below")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        self.points = self.points.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(1))
        self.centres, self.reach = self.points[self.centre], self.norms[self.centre]

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> Tree:
        data = points.astype(np.float64)
        nodes: list[tuple[np.ndarray, int, float, np.ndarray, list[int]]] = []  # points, centre, radius, single points, children
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(ids)), 0, -1)] if len(ids) else []
        while stack:
            mine, centre, parent = stack.pop()
            if parent >= 0:
                nodes[parent][4].append(len(nodes))
            away = np.sqrt(np.maximum(0, ((data[mine] - data[centre]) ** 2).sum(1)))
            parts, single = cls._net(data, mine, centre, away)
            stack += [(part, c, len(nodes)) for part, c in parts]
            nodes.append((mine, centre, float(away.max()) * (1 + 1e-9), single, []))
        # points in the order of a walk from the root: each node's are together, single ones first
        order, first, single, last = [], [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
        at, walk = 0, [0] if nodes else []
        while walk:
            n = walk.pop()
            first[n], last[n] = at, at + len(nodes[n][0])
            order.append(nodes[n][3])
            at += len(nodes[n][3])
            single[n] = at
            walk += nodes[n][4]
        # a stack visits a node's whole subtree before its next sibling, so ranges are nested
        take = np.concatenate(order) if order else np.zeros(0, np.int64)
        place = np.empty(len(take), np.int64)
        place[take] = np.arange(len(take))
        below = [c for *_, children in nodes for c in children]
        start = np.cumsum([0, *(len(children) for *_, children in nodes)])
        return cls(
            ids=ids[take], points=points[take], first=np.array(first, np.int64), single=np.array(single, np.int64), last=np.array(last, np.int64), radius=np.array([n[2] for n in nodes]),
            centre=place[np.array([n[1] for n in nodes], np.int64)] if nodes else np.zeros(0, np.int64), start=start, below=np.array(below, np.int64),
        )

    @staticmethod
    def _net(data: np.ndarray, mine: np.ndarray, centre: int, away: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
        """Children that cover the points within the next radius, their centres that far apart: (points, centre) of each, and those of one point."""
        reach = away.max() / SHRINK
        if len(mine) <= LEAF or reach == 0:
            return [], mine
        parts, single, left, near, c = [], [], mine, away, centre
        while left.size:
            inside = near <= reach
            part, left = left[inside], left[~inside]
            if part.size > 1:
                parts.append((part, c))
            else:
                single.append(c)
            if left.size:
                c = int(left[0])
                near = np.sqrt(np.maximum(0, ((data[left] - data[c]) ** 2).sum(1)))
        return parts, np.array(single, np.int64)

    def stored(self) -> bytes:
        """The tree as bytes, points in the smallest whole-number type that holds them."""
        whole_points = self.points.astype(np.int64)
        most = int(np.abs(whole_points).max(initial=0))
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        return pickle.dumps({n: getattr(self, n) for n in self.NAMES} | {"points": whole_points.astype(kind)})

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(**pickle.loads(data))

    def children(self, n: int) -> np.ndarray:
        return self.below[self.start[n] : self.start[n + 1]]


class Best:
    """The k best of each query so far, by score and then id."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k, self.kth = k, np.full(n, LOW, np.int64) if kth is None else kth.copy()
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows: numbers of the queries; scores: of each of them with each of ids."""
        scores = np.where(query_ids[:, None] == ids[None, :], LOW, scores)
        least = np.maximum(self.kth[rows], LOW + 1)
        hits = scores >= least[:, None]
        if scores.shape[1] > self.k and hits.sum() > 4 * self.k * len(rows):
            hits = scores >= np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])[:, None]
        q, d = np.nonzero(hits)
        if not q.size:
            return
        changed = np.zeros(len(self.kth), bool)
        changed[rows[q]] = True
        mine = changed[self.query]
        query = np.concatenate((self.query[mine], rows[q]))
        found, score = np.concatenate((self.ids[mine], ids[d])), np.concatenate((self.score[mine], scores[q, d]))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        begins = np.r_[True, query[1:] != query[:-1]]
        rank = np.arange(query.size) - np.maximum.accumulate(np.where(begins, np.arange(query.size), 0))
        last = rank == self.k - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], score[last])
        keep = rank < self.k
        self.query, self.ids, self.score = (np.concatenate((old[~mine], new[keep])) for old, new in ((self.query, query), (self.ids, found), (self.score, score)))


def slack(x):
    """A bound with what floating point may have lost."""
    return x + np.abs(x) * 1e-9 + 1e-3


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first:last, one after the other."""
    sizes = last - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def seeded(queries: Tree, data: Tree, best: Best) -> tuple[np.ndarray, int]:
    """Compares every query with the SEEDS leaves of the largest bounds, as long as these reach its k-th score. Returns which leaves (by node) each query has met, and the products made."""
    met, made, ends = np.zeros((len(queries.ids), len(data.first)), bool), 0, np.flatnonzero(data.start[1:] == data.start[:-1])
    most = slack(queries.points @ data.centres[ends].T + data.radius[ends] * queries.norms[:, None])
    order = np.argsort(-most, axis=1, kind="stable")[:, :SEEDS]
    for place in order.T:
        going = most[np.arange(len(place)), place] >= best.kth
        for n in np.unique(ends[place[going]]):
            rows, points = np.flatnonzero(going & (ends[place] == n)), np.arange(data.first[n], data.last[n])
            best.add(rows, queries.ids[rows], data.ids[points], products(queries.points[rows], data.points[points]))
            met[rows, n] = True
            made += rows.size * points.size
    return met, made


def dual_search(queries: Tree, data: Tree, best: Best) -> int:
    """Searches two trees, leaving out node pairs whose bound is under the worst k-th score of the query node. Returns the number of inner products of points.

    A query node takes the data nodes and points that its parent could not leave out, and opens data nodes while they are wider than itself.
    Query points that are children themselves, and all of a node of at most AT_ONCE, open what is left by bounds of their own, all at once.
    """
    made = 0

    def opened(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child nodes and single points of data nodes."""
        return ranges_below(nodes), ranges(data.first[nodes], data.single[nodes])

    def ranges_below(nodes: np.ndarray) -> np.ndarray:
        return data.below[ranges(data.start[nodes], data.start[nodes + 1])]

    def alone(rows: np.ndarray, nodes: np.ndarray, points: np.ndarray) -> None:
        """Each query point meets the points of the data nodes that its own bound does not leave out; all hits are merged at once.

        Where most pairs of the query points and those nodes are left, one product covers them all, else each node has its own.
        """
        nonlocal made
        held, wanted = [np.zeros(0, np.int64)], [np.zeros((rows.size, 0), bool)]  # data nodes with single points, and the query points that need them
        may = np.ones((rows.size, nodes.size), bool)
        while nodes.size:
            may &= slack(queries.points[rows] @ data.centres[nodes].T + data.radius[nodes] * queries.norms[rows][:, None]) >= best.kth[rows][:, None]
            going = may.any(0)
            nodes, may = nodes[going], may[:, going]
            some = data.single[nodes] > data.first[nodes]
            held.append(nodes[some])
            wanted.append(may[:, some] & ~before[np.ix_(rows, nodes[some])])
            may = np.repeat(may, data.start[nodes + 1] - data.start[nodes], axis=1)
            nodes = ranges_below(nodes)
        nodes, want = np.concatenate(held), np.concatenate(wanted, axis=1)
        sizes = data.single[nodes] - data.first[nodes]
        found = np.concatenate((points, ranges(data.first[nodes], data.single[nodes])))
        if not found.size:
            return
        if 2 * (want.sum(0) @ sizes) >= rows.size * sizes.sum():
            scores = products(queries.points[rows], data.points[found])
            made += scores.size
            if not want.all():
                scores[:, points.size :][~np.repeat(want, sizes, axis=1)] = LOW
        else:
            scores = np.full((rows.size, found.size), LOW, np.int64)
            scores[:, : points.size] = products(queries.points[rows], data.points[points])
            made += rows.size * points.size
            for n, size, end, column in zip(nodes, sizes, points.size + np.cumsum(sizes), want.T):
                own = np.flatnonzero(column)
                scores[own, end - size : end] = products(queries.points[rows[own]], data.points[data.first[n] : data.single[n]])
                made += own.size * size
        best.add(rows, queries.ids[rows], data.ids[found], scores)

    if not len(queries.ids) or not len(data.ids):
        return 0
    leaf = data.start[1:] == data.start[:-1]
    before = np.zeros((len(queries.ids), len(data.first)), bool)
    if (best.kth == LOW).any():
        before, made = seeded(queries, data, best)
    stack = [(0, np.zeros(1, np.int64), np.zeros(0, np.int64))]
    while stack:
        q, nodes, points = stack.pop()
        worst = best.kth[queries.first[q] : queries.last[q]].min()
        centre, radius, length = queries.centres[q], queries.radius[q], queries.reach[q]
        near_nodes = lambda n: n[slack(data.centres[n] @ centre + radius * data.reach[n] + data.radius[n] * length + radius * data.radius[n]) >= worst]
        near_points = lambda n: n[slack(data.points[n] @ centre + radius * data.norms[n]) >= worst]
        nodes, points = near_nodes(nodes), near_points(points)
        while (wide := (data.radius[nodes] >= radius) & ~leaf[nodes]).any():
            below, more = opened(nodes[wide])
            nodes, points = np.concatenate((nodes[~wide], near_nodes(below))), np.concatenate((points, near_points(more)))
        if nodes.size or points.size:
            few = queries.last[q] - queries.first[q] <= AT_ONCE
            rows = np.arange(queries.first[q], queries.last[q] if few else queries.single[q])
            if rows.size:
                alone(rows, nodes, points)
            stack += [] if few else [(int(c), nodes, points) for c in queries.children(q)]
    return made


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum stays under 2^53, else in whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def centres_of(rows: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first centres among the rows."""
    rows = rows.astype(np.float64)
    chosen, away = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(rows)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _blocks(rows: DataFrame, centres: np.ndarray, size: int, name: str) -> DataFrame:
    """block, cell, part, tree (bytes), its root's middle and radius, and how far from the cell's centre it goes: one row per block of about `size` vectors."""
    dim = centres.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in frames:
            x = filled(pdf["v"], dim)
            near = (((c**2).sum(1) - 2 * x @ c.T)).argmin(1) if len(pdf) else np.zeros(0, np.int64)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": list(x.astype(np.int64)), "cell": near})

    # written, so that a row's number is the same whenever a task runs again
    cells = written(rows.mapInPandas(assign, "vec_id long, v array<long>, cell int"), f"{name}-cells").withColumn("row", F.monotonically_increasing_id())
    parts = {r["cell"]: -(-r["n"] // size) for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per centre
    many: Column = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("cell")) if parts else F.lit(1)
    cells = cells.withColumn("part", F.pmod(F.xxhash64("row"), many))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filled(pdf["v"], dim)
        tree = Tree.build(pdf["vec_id"].to_numpy(np.int64), x.astype(np.int64))
        cell = int(pdf["cell"].iloc[0])
        far = float(np.sqrt(((x - shared.value[cell]) ** 2).sum(1).max())) * (1 + 1e-9)
        return pd.DataFrame({"cell": [cell], "part": [int(pdf["part"].iloc[0])], "tree": [tree.stored()], "middle": [tree.centres[0]], "radius": [tree.radius[0]], "far": [far]})

    built = cells.groupBy("cell", "part").applyInPandas(build, "cell int, part long, tree binary, middle array<double>, radius double, far double")
    return written(built.withColumn("block", F.concat_ws(".", "cell", "part")), name)


def filled(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of one length, filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


HITS = "q_block string, d_block string, worst long, kth binary, products long, query_id array<long>, vec_id array<long>, score array<long>"


def _search(pairs: DataFrame, asked: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Searches pairs (q_block, d_block, kth: scores so far or null); one row per pair. A task holds one data block and about TOGETHER query blocks."""
    many = pairs.groupBy("d_block").agg(F.count("*").alias("n")).select("d_block", F.ceil(F.col("n") / TOGETHER).alias("slices"))
    sliced = pairs.join(many, "d_block").withColumn("slice", F.pmod(F.xxhash64("q_block"), F.col("slices")))
    queries = sliced.select("d_block", "slice", "q_block", "kth").join(asked.select(F.col("block").alias("q_block"), F.col("tree").alias("q_tree")), "q_block")
    blocks = sliced.select(F.col("d_block").alias("block"), F.col("slice").alias("part_of")).distinct().join(data.select("block", F.col("tree").alias("d_tree")), "block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        tree = Tree.load(right["d_tree"].iloc[0]) if len(left) else None
        for block, kth, stored in zip(left["q_block"], left["kth"], left["q_tree"]):
            own = Tree.load(stored)
            best = Best(len(own.ids), k, None if kth is None else np.frombuffer(kth, np.int64))
            made = dual_search(own, tree, best)
            rows.append((block, right["block"].iloc[0], int(best.kth.min()), best.kth.tobytes(), made, own.ids[best.query], best.ids, best.score))
        return pd.DataFrame(rows, columns=["q_block", "d_block", "worst", "kth", "products", "query_id", "vec_id", "score"])

    return queries.groupBy("d_block", "slice").cogroup(blocks.groupBy("block", "part_of")).applyInPandas(run, HITS)


def searched(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame | None:
    """The hits of every pair of a query block and a data block that was searched (columns HITS); None without vectors."""
    bounded(vectors.sparkSession)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not sizes["n"]:
        return None
    sample = pd.DataFrame([r.asDict() for r in vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()])
    dim = max(sizes["dim"], (queries.agg(F.max(F.size("v"))).first()[0] or 0))
    centres = centres_of(filled(sample["v"], dim), max(1, min(CENTRES, sizes["n"] // DATA_ROWS)))
    data = _blocks(vectors, centres, DATA_ROWS, "vectors")
    asked = _blocks(queries, centres, QUERY_ROWS, "queries")
    d = data.select(F.col("block").alias("d_block"), F.col("cell").alias("d_cell"), F.col("part").alias("d_part"), F.col("middle").alias("d_middle"), F.col("radius").alias("d_radius"))
    q = asked.select(F.col("block").alias("q_block"), F.col("cell").alias("q_cell"), F.col("middle").alias("q_middle"), F.col("radius").alias("q_radius"))
    # a tree is stored, so its order of points, in which kth scores are kept, is fixed
    home = q.join(d.groupBy("d_cell").agg(F.min_by("d_block", "d_part").alias("d_block")), F.col("q_cell") == F.col("d_cell")).select("q_block", "d_block")
    first = written(_search(home.withColumn("kth", F.lit(None).cast("binary")), asked, data, k), "home-hits")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))

    def bound(x: str, r: str):
        dot = F.aggregate(F.zip_with("q_middle", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        most = dot + F.col("q_radius") * norm(F.col(x)) + F.col(r) * norm(F.col("q_middle")) + F.col("q_radius") * F.col(r)
        return most + F.abs(most) * 1e-9 + 1e-3

    known = first.select("q_block", F.col("d_block").alias("home"), "worst", "kth")
    # cells first (at most CENTRES rows), then the blocks of the cells that a query block needs
    middles = vectors.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "c_cell int, c_middle array<double>")
    cells = middles.join(data.groupBy(F.col("cell").alias("c_cell")).agg(F.max("far").alias("c_radius")), "c_cell")
    wanted = q.join(known, "q_block").join(F.broadcast(cells), bound("c_middle", "c_radius") >= F.col("worst"))
    pairs = wanted.join(d, (F.col("c_cell") == F.col("d_cell")) & (F.col("d_block") != F.col("home")) & (bound("d_middle", "d_radius") >= F.col("worst")))
    pairs = written(pairs.select("q_block", "d_block", "kth"), "block-pairs")
    return first.unionByName(_search(pairs, asked, data, k))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v) the k rows of vectors (vec_id, v) with the largest inner products."""
    found = searched(vectors, queries, k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = found.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("hit")).select("hit.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
