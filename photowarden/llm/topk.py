"""Exact top-k inner-product search with cover trees on both sides.

Vectors are dealt by a hash of their id to reference blocks, queries to query blocks. One task a block builds the block's
cover tree, once; the trees are written to the shared folder as rows. A reference tree then meets groups of query trees,
so it is copied once for every QUERIES * GROUP queries, and both trees are descended together: a pair of nodes can score
at most q.c + |q| R + |c| r + r R (centres q, c; covering radii r, R), and is pruned when that is below the worst k-th
score of the query node's group. Per query the blocks' best k are merged.

How much is pruned depends on the data: vectors of many dimensions that are all about equally far apart have balls as large
as their distances, and nearly every pair is scored. The result is exact in any case.

Scores are integers and are computed and compared as such: by floating point where no sum can reach 2^53, by 64-bit
integers up to 2^63, and beyond by unbounded ones; a score that is no long counts as the greatest or least long. Ties go
to the smaller id. Equal vectors share one point of the tree, of which a query needs the k + 1 smallest distinct ids only
(its own may be one), and k rows of each.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; vectors of another
length than the query's are no candidates; a null id takes no part; rows that share an id are one candidate each; very
long vectors are whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.llm import common

LEAF = 32
#: Vectors of a reference block and of a query block; query blocks that meet a reference tree at once.
REFERENCES, QUERIES, GROUP = 2048, 1024, 16
#: A small table is cut into more blocks than it needs, down to so many vectors each.
LEAST_BLOCKS, LEAST_REFERENCES = 32, 256
_NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integer-valued doubles, as exact 64-bit integers (those beyond are cut to the limits)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    limits = np.iinfo(np.int64)
    return np.array([[min(max(x, limits.min + 1), limits.max) for x in row] for row in whole(a).dot(whole(b).T)], np.int64).reshape(len(a), len(b))


class CoverTree:
    """Nodes as arrays: centre point, covering radius, children, and the points of a leaf.

    Built from the top: a node's points are dealt to a net of centres that lie more than the next scale (a power of two
    below the radius) apart and cover it within that scale; the node's own centre is the first (nesting, covering,
    separation). Each centre with points of its own is a child; centres that cover only themselves are one leaf together.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[np.ndarray | None] = []
        if len(points):
            with np.errstate(over="ignore", invalid="ignore"):
                near = int(((points - points.mean(0)) ** 2).sum(1).argmin())
                every = np.arange(len(points))
                todo = [(-1, near, every, self._distances(near, every))]
                while todo:
                    todo += self._grow(*todo.pop())
        self._measure()

    def _measure(self) -> None:
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.points**2).sum(1))

    def _distances(self, centre: int, among: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[among] - self.points[centre]) ** 2).sum(1))

    def _node(self, parent: int, centre: int, far: np.ndarray, leaf: np.ndarray | None) -> int:
        if parent >= 0:
            self.children[parent].append(len(self.centre))
        self.centre.append(centre)
        self.radius.append(float(far.max()) * (1 + 1e-12))
        self.children.append([])
        self.leaf.append(leaf)
        return len(self.centre) - 1

    def _grow(self, parent: int, centre: int, members: np.ndarray, far: np.ndarray) -> list[tuple]:
        radius = float(far.max())
        if len(members) <= LEAF or not 0 < radius < math.inf:  # beyond a double's range nothing is pruned
            self._node(parent, centre, far, members)
            return []
        me = self._node(parent, centre, far, None)
        scale = 2.0 ** math.floor(math.log2(radius))
        scale = scale / 2 if scale == radius else scale
        below, alone = [], []
        left, c, d, where = members, centre, far, far
        while len(left):
            within = d <= scale
            if within.sum() > 1:
                below.append((me, c, left[within], d[within]))
            else:
                alone.append((c, float(where[within][0])))
            left, where = left[~within], where[~within]
            if len(left):
                c = int(left[0])
                d = self._distances(c, left)
        if alone:
            self._node(me, centre, np.array([x for _, x in alone]), np.array([x for x, _ in alone]))
        return below

    def dump(self) -> bytes:
        leaves = [k for k, x in enumerate(self.leaf) if x is not None]
        parent = np.full(len(self.centre), -1)
        for k, some in enumerate(self.children):
            parent[some] = k
        out = io.BytesIO()
        sizes = np.array([len(self.leaf[k]) for k in leaves], np.int64)
        held = np.concatenate([self.leaf[k] for k in leaves]) if leaves else np.zeros(0, np.int64)
        for a in (self.points, np.array(self.centre, np.int64), np.array(self.radius), parent, np.array(leaves, np.int64), sizes, held):
            np.save(out, a)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        source = io.BytesIO(data)
        points, centre, radius, parent, leaves, sizes, held = (np.load(source) for _ in range(7))
        tree = cls.__new__(cls)
        tree.points, tree.centre, tree.radius = points, centre.tolist(), radius.tolist()
        tree.children, tree.leaf = [[] for _ in tree.centre], [None] * len(tree.centre)
        for k, p in enumerate(parent.tolist()):
            if p >= 0:
                tree.children[p].append(k)
        for k, part in zip(leaves.tolist(), np.split(held, np.cumsum(sizes)[:-1]), strict=False):
            tree.leaf[k] = part
        tree._measure()
        return tree


class DualSearch:
    """The k best distinct-vector candidates of every query, by a simultaneous descent."""

    def __init__(self, queries: CoverTree, query_ids: np.ndarray, vectors: CoverTree, owners: list[np.ndarray], k: int):
        self.k = k
        self.query_ids = query_ids
        self.owners = owners
        self.top_score = np.full((len(query_ids), k), _NONE, np.int64)
        self.top_id = np.full((len(query_ids), k), np.iinfo(np.int64).max, np.int64)
        self.q, self.r = queries, vectors
        self.qn, self.rn = self.q.norm, self.r.norm
        self.pruned = self.visited = self.scored = 0
        if len(queries.points) and len(vectors.points):
            self.members = [None] * len(self.q.centre)
            self._collect(0)
            self._visit(0, 0)

    def _collect(self, node: int) -> np.ndarray:
        leaf = self.q.leaf[node]
        got = leaf if leaf is not None else np.concatenate([self._collect(c) for c in self.q.children[node]])
        self.members[node] = got
        return got

    def _bounds(self, a: list[int], b: list[int]) -> np.ndarray:
        """Greatest possible score of each pair of nodes."""
        qc, rc = [self.q.centre[x] for x in a], [self.r.centre[x] for x in b]
        r, big = np.array([self.q.radius[x] for x in a]), np.array([self.r.radius[x] for x in b])
        product = self.q.points[qc] @ self.r.points[rc].T
        return product + self.qn[qc][:, None] * big[None, :] + self.rn[rc][None, :] * r[:, None] + r[:, None] * big[None, :]

    def _worst(self, node: int) -> int:
        return int(self.top_score[self.members[node], -1].min())

    def _visit(self, a: int, b: int) -> None:
        self.visited += 1
        q_leaf, r_leaf = self.q.leaf[a], self.r.leaf[b]
        if q_leaf is not None and r_leaf is not None:
            self._score(q_leaf, r_leaf)
            return
        left = [a] if q_leaf is not None else self.q.children[a]
        right = [b] if r_leaf is not None else self.r.children[b]
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = self._bounds(left, right)
        bounds += 0.5 + 1e-9 * np.abs(bounds)  # scores are integers, bounds are rounded; ties must be seen
        for flat in np.argsort(-bounds, axis=None, kind="stable").tolist():
            i, j = divmod(flat, len(right))
            if bounds[i, j] < self._worst(left[i]):
                self.pruned += 1
                continue
            self._visit(left[i], right[j])

    def _score(self, some: np.ndarray, points: np.ndarray) -> None:
        self.scored += len(some) * len(points)
        for a in range(0, len(some), 256):
            rows = some[a : a + 256]
            scores = products(self.q.points[rows], self.r.points[points])
            hit, at = np.nonzero(scores >= self.top_score[rows, -1][:, None])
            if not len(hit):
                continue
            owned = [self.owners[p] for p in points[at].tolist()]
            n = np.array([len(o) for o in owned])
            ids = np.concatenate(owned)
            q = np.repeat(rows[hit], n)
            s = np.repeat(scores[hit, at], n)
            mine = ids == self.query_ids[q]
            changed = np.unique(q)
            q = np.concatenate((q[~mine], np.repeat(changed, self.k)))
            s = np.concatenate((s[~mine], self.top_score[changed].ravel()))
            ids = np.concatenate((ids[~mine], self.top_id[changed].ravel()))
            order = np.lexsort((ids, ~s, q))
            q, s, ids = q[order], s[order], ids[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best = place < self.k
            self.top_score[q[best], place[best]] = s[best]
            self.top_id[q[best], place[best]] = ids[best]


def first_owners(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the sorted ids that share a vector those that can be among a query's best k, whichever id is its own."""
    repeat = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return ids[(repeat < k) & (np.cumsum(repeat == 0) <= k + 1)]


def valid(vector: str) -> Column:
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(False))


_TREE = "block int, dim int, tree binary, ids binary, sizes binary"


def _trees(rows: DataFrame, k: int | None) -> DataFrame:
    """One cover tree for each block and length; of references (with k) over distinct vectors and their owners."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        dim = table.column("dim")[0].as_py()
        points = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)[order]
        ids, sizes = ids[order], np.ones(len(ids), np.int64)
        if k is not None:
            points, inverse = np.unique(points, axis=0, return_inverse=True)
            by_point = np.argsort(inverse.ravel(), kind="stable")
            owners = [first_owners(o, k) for o in np.split(ids[by_point], np.cumsum(np.bincount(inverse.ravel()))[:-1])]
            ids, sizes = np.concatenate(owners), np.array([len(o) for o in owners], np.int64)
        return pa.Table.from_arrays(
            [pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (CoverTree(points).dump(), ids.tobytes(), sizes.tobytes()))],
            ["block", "dim", "tree", "ids", "sizes"],
        )

    return rows.groupBy("block", "dim").applyInArrow(build, _TREE)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. vectors: integer-valued double arrays; is_query: which rows are queries."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = vectors.filter(valid(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"), F.size(vector).alias("dim"))
    n = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    n_blocks = max(1, -(-n[0] // REFERENCES), min(LEAST_BLOCKS, n[0] // LEAST_REFERENCES))
    q_blocks = max(1, -(-n[1] // QUERIES))
    groups = -(-q_blocks // GROUP)
    block = lambda m: common.spread("id", m).cast("int").alias("block")
    refs = common.written(_trees(rows.select("id", "v", "dim", block(n_blocks)), k), "reference-trees")
    queries = common.written(_trees(rows.filter("is_query").select("id", "v", "dim", block(q_blocks)), None), "query-trees")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.withColumn("qg", F.col("block") % groups).withColumn("rb", every(n_blocks))
    right = refs.withColumn("rb", F.col("block")).withColumn("qg", every(groups))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for ref in r.to_pylist() if q.num_rows else []:
            sizes = np.frombuffer(ref["sizes"], np.int64)
            owners = np.split(np.frombuffer(ref["ids"], np.int64), np.cumsum(sizes)[:-1])
            tree = CoverTree.load(ref["tree"])
            for query in q.to_pylist():
                ids = np.frombuffer(query["ids"], np.int64)
                found = DualSearch(CoverTree.load(query["tree"]), ids, tree, owners, k)
                at = np.nonzero(found.top_score != _NONE)
                for column, values in zip(out, (ids[at[0]], found.top_id[at], found.top_score[at]), strict=True):
                    column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = left.groupBy("rb", "qg", "dim").cogroup(right.groupBy("rb", "qg", "dim")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
