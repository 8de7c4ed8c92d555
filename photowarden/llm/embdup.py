"""Near-duplicate vectors by cosine: tiles in the order of principal axes, compared a few dimensions at a time.

1. Equal vectors are one class with a count, so a group of copies is one row, however large.
2. A task sums the products of its unit vectors' components; the eigenvectors of the sum are the axes, leading ones first.
   They only turn the vectors, so no cosine changes and whatever the axes are the result is the same.
3. Classes are ordered by the cells that their leading coordinates lie in and cut into blocks. Linked unit vectors are at
   most sqrt(2 - 2t) apart; blocks meet only if their boxes of leading coordinates are no farther apart than that. They
   find each other through slabs of the first coordinate of just this width.
4. Two blocks are compared tile by tile. The product of the leading dimensions plus the product of the norms of what
   follows bounds the cosine. Pairs whose bound stays below the threshold are dropped, the others get the next dimensions.
   Where many pairs of a tile are left, the whole tile gets all dimensions in one matrix product. Pairs that reach the
   threshold but for rounding are decided on the given components, not the turned ones.
5. A pair of blocks gives each of its classes the number of rows that it found linked, and a spanning forest of the links:
   no more rows than it has classes, also within a group of thousands of near copies.

What is compared is all pairs of blocks within reach: where the leading coordinates part nothing that is all blocks, and
the work grows with the square of the classes, at a few multiplications a pair. Only the table of blocks' boxes is joined
with itself.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; neither
does one with a null id, whose component is null and which stays; vectors of different lengths don't link; repeated rows
are vectors of their own; rows that share an id but not the vector are linked only through their vectors; multiples of a
vector have cosine 1; an empty table gives no rows; other columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common
from photowarden.llm.components import contracted_components

THRESHOLD = 0.95
#: Bytes and rows of a block at most; small inputs have about BLOCKS blocks of at least LEAST_ROWS rows.
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS, BLOCKS = 8 << 20, 16384, 512, 24
TILE = 1024
#: Blocks that one task builds, on average.
BLOCKS_A_TASK = 16
#: Dimensions after which pairs are looked at again.
STAGES = (8, 16, 32)
#: Leading coordinates that blocks are ordered and parted by.
AXES = 4
#: Wider than what double precision loses in a bound.
SLACK = 1e-9


def _doubles(batch: pa.RecordBatch) -> list[bytes | None]:
    """The components of each valid vector as little-endian doubles (no negative zero)."""
    column = batch.column(1)
    out: list[bytes | None] = []
    for value in column:
        part = value.values
        if part is None or not len(part) or part.null_count:
            out.append(None)
            continue
        v = part.to_numpy(zero_copy_only=False) + 0.0
        out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the greatest component is taken out first, so that no square is too large or small."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _by_length(vectors: list[bytes]):
    """(length, positions) of the vectors of each length."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors)) // 8
    for n in np.unique(lengths).tolist():
        yield n, np.flatnonzero(lengths == n)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the axes (columns), most energy first. Each task sends length squared sums a length; the driver
    gets as many for each of the at most 16 commonest lengths. Vectors of other lengths keep their own coordinates."""
    common_lengths = [r.n for r in classes.groupBy((F.length("vec") / 8).cast("int").alias("n")).count().orderBy(F.desc("count"), "n").limit(16).collect()]

    def sums(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(0).to_pylist()
            for n, at in _by_length(vectors):
                if n in common_lengths:
                    u = _unit(_matrix([vectors[k] for k in at]))
                    totals[n] = totals.get(n, 0.0) + u.T @ u
        for n, total in totals.items():
            at = np.triu_indices(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), n), pa.int32()), pa.array(at[0] * n + at[1], pa.int64()), pa.array(total[at])], ["n", "at", "x"])

    axes = {}
    rows = classes.select("vec").mapInArrow(sums, "n int, at long, x double").groupBy("n", "at").agg(F.sum("x").alias("x")).toArrow()
    for n in common_lengths:
        part = rows.filter(pa.compute.equal(rows["n"], n))
        total = np.zeros(n * n)
        total[part["at"].to_numpy()] = part["x"].to_numpy()
        total = total.reshape(n, n)
        axes[n] = np.linalg.eigh(total + np.triu(total, 1).T)[1][:, ::-1].copy()
    return axes


def _turned(vectors: list[bytes], axes: dict[int, np.ndarray]) -> np.ndarray:
    u = _unit(_matrix(vectors))
    return u @ axes[u.shape[1]] if u.shape[1] in axes else u


def _with_norms(u: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Per cut the dimensions since the cut before, and the norm of those that follow as a last column."""
    energy = np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1]
    out = []
    for a, b in itertools.pairwise([0, *cuts]):
        rest = np.sqrt(energy[:, b]) if b < u.shape[1] else np.zeros(len(u))
        out.append(np.column_stack((u[:, a:b], rest)))
    return out


def _linked(a: int, b: int, parts: tuple, turned: tuple, given: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the linked pairs of the tile at row a of the left and b of the right block."""
    lead = parts[0][0][a : a + TILE] @ parts[1][0][b : b + TILE].T
    least = threshold - SLACK
    at = np.flatnonzero(lead >= least)
    i, j = np.divmod(at, lead.shape[1])
    if len(at) * 8 > lead.size:
        cosine = turned[0][a : a + TILE] @ turned[1][b : b + TILE].T
        at = np.flatnonzero(cosine >= least)
        i, j, value = *np.divmod(at, cosine.shape[1]), cosine.ravel()[at]
    else:
        left, right = parts[0][0][a + i], parts[1][0][b + j]
        value = lead.ravel()[at] - left[:, -1] * right[:, -1]
        for left_part, right_part in zip(parts[0][1:], parts[1][1:], strict=True):
            left, right = left_part[a + i], right_part[b + j]
            bound = value + np.einsum("ij,ij->i", left, right)
            keep = bound >= least
            i, j, value = i[keep], j[keep], (bound - left[:, -1] * right[:, -1])[keep]
    sure = value >= threshold + SLACK
    near = np.flatnonzero(~sure)
    if len(near):
        sure[near] = [_cosine(x, y) >= threshold for x, y in zip(given[0][a + i[near]], given[1][b + j[near]], strict=True)]
    return i[sure] + a, j[sure] + b


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


class Forest:
    """Union by the smaller root over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links that surely lie within one tree are passed over in bulk, again after each tree that grew."""
        while len(x):
            self._flatten()
            apart = self.root[x] != self.root[y]
            x, y = x[apart], y[apart]
            if not len(x):
                return
            _, one = np.unique(self.root[x], return_index=True)  # a link for each tree
            for p, q in zip(x[one].tolist(), y[one].tolist(), strict=True):
                r, s = self._find(p), self._find(q)
                if r != s:
                    self.root[max(r, s)] = min(r, s)
                    self.links.append((p, q))

    def _flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up


def compare_blocks(left: dict, right: dict, axes: dict[int, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Classes, the rows that each is linked with here, and a spanning forest of the links. A block against itself counts
    every pair once from each end."""
    same = left["block"] == right["block"]
    given = _matrix(left["vecs"]), _matrix(right["vecs"])
    turned = tuple(_turned(x["vecs"], axes) for x in (left, right))
    width = given[0].shape[1]
    cuts = [c for c in STAGES if c < width] + [width]
    parts = tuple(_with_norms(u, cuts) for u in turned)
    ids = [np.array(x["classes"], np.int64) for x in (left, right)]
    copies = [np.array(x["copies"], np.int64) for x in (left, right)]
    m, n = len(ids[0]), len(ids[1])
    found = [np.zeros(m, np.int64), np.zeros(n, np.int64)]
    forest = Forest(m + (0 if same else n))
    for a in range(0, m, TILE):
        for b in range(a if same else 0, n, TILE):
            i, j = _linked(a, b, parts, turned, given, threshold)
            if same:
                i, j = (x[i < j] for x in (i, j))
            np.add.at(found[0], i, copies[1][j])
            np.add.at(found[1], j, copies[0][i])
            forest.add(i, j if same else j + m)
    if same:
        return ids[0], found[0] + found[1], [(int(ids[0][p]), int(ids[0][q])) for p, q in forest.links]
    both = np.concatenate(ids)
    return both, np.concatenate(found), [(int(both[p]), int(both[q])) for p, q in forest.links]


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """block, n (vector length), low and high (of the leading coordinates), and its classes, copies and vecs."""
    width = np.sqrt(max(2 - 2 * threshold, 1e-6))

    def cells(batches):
        for batch in common.slices(batches, 4096):
            vectors = batch.column("vec").to_pylist()
            lead = np.zeros((len(vectors), AXES))
            for n, at in _by_length(vectors):
                k = min(n, AXES)
                lead[at, :k] = _turned([vectors[p] for p in at], axes)[:, :k]
            cell = np.floor(lead / width).astype(np.int32)
            names = [f"c{k}" for k in range(AXES)]
            columns = [batch.column(c) for c in batch.schema.names] + [pa.array([len(v) // 8 for v in vectors], pa.int32())]
            columns += [pa.array(cell[:, k]) for k in range(AXES)] + [pa.array(list(map(np.ndarray.tolist, lead)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n", *names, "lead"])

    n_classes, width_bytes = classes.agg(F.count("*"), F.max(F.length("vec"))).first()
    rows_of_block = max(1, min(BLOCK_ROWS, max(LEAST_ROWS, n_classes // BLOCKS), BLOCK_BYTES // max(width_bytes or 8, 8)))
    tasks = max(1, -(-n_classes // (rows_of_block * BLOCKS_A_TASK)))
    keys = ["n", *(f"c{k}" for k in range(AXES)), "class"]
    placed = classes.select("class", "copies", "vec").mapInArrow(cells, f"class long, copies long, vec binary, n int, {', '.join(f'c{k} int' for k in range(AXES))}, lead array<double>")

    def build(batches):
        held: list[tuple] = []

        def block():
            low, high = np.array([h[4] for h in held]).min(0), np.array([h[4] for h in held]).max(0)
            ids, copies, vecs, n, _ = zip(*held, strict=True)
            held.clear()
            # the smallest class of a block is its name
            row = [[min(ids)], [n[0]], [low.tolist()], [high.tolist()], [list(ids)], [list(copies)], [list(vecs)]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["block", "n", "low", "high", "classes", "copies", "vecs"])

        for batch in common.slices(batches, 1024):
            for row in zip(*(batch.column(c).to_pylist() for c in ("class", "copies", "vec", "n", "lead")), strict=True):
                if held and (held[-1][3] != row[3] or len(held) >= rows_of_block):
                    yield block()
                held.append(row)
        if held:
            yield block()

    ordered = placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(build, "block long, n int, low array<double>, high array<double>, classes array<long>, copies array<long>, vecs array<binary>")


def _pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """left, right: blocks (each with itself too) whose boxes are within reach of a link."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 1e-6))) + SLACK
    boxes = blocks.select("block", "n", "low", "high")
    slab = lambda x: F.floor(x / F.lit(reach)).cast("long")
    own = boxes.withColumn("slab", F.explode(F.sequence(slab(F.col("low")[0]), slab(F.col("high")[0]))))
    wide = boxes.withColumn("slab", F.explode(F.sequence(slab(F.col("low")[0]) - 1, slab(F.col("high")[0]) + 1)))
    gap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda k: F.pow(F.greatest(F.lit(0.0), F.get("r.low", k) - F.get("l.high", k), F.get("l.low", k) - F.get("r.high", k)), 2)), F.lit(0.0), lambda s, x: s + x)
    met = own.alias("l").join(wide.alias("r"), (F.col("l.n") == F.col("r.n")) & (F.col("l.slab") == F.col("r.slab")) & (F.col("l.block") <= F.col("r.block")))
    back = wide.alias("l").join(own.alias("r"), (F.col("l.n") == F.col("r.n")) & (F.col("l.slab") == F.col("r.slab")) & (F.col("l.block") <= F.col("r.block")))
    ends = [F.col("l.block").alias("left"), F.col("r.block").alias("right")]
    return met.filter(gap <= reach * reach).select(*ends).unionByName(back.filter(gap <= reach * reach).select(*ends)).distinct()


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of vec_id, embedding: vec_id, n_links (other rows linked directly), component_id (the smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id)."""
    spark = rows.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark)

    def valid(batches):
        for batch in common.slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_doubles(batch), pa.binary())], ["vec_id", "vec"])

    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(valid, "vec_id long, vec binary")
    usable = given.filter("vec is not null and vec_id is not null")
    grouped = usable.groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    classes = scratch.written(grouped, "classes")
    axes = principal_axes(classes)
    blocks = scratch.written(_blocks(classes, axes, threshold), "blocks")
    pairs = scratch.written(_pairs(blocks, threshold), "pairs")
    sides = pairs.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))

    def compare(key, table):
        held = {b["block"]: b for b in table.select(["block", "classes", "copies", "vecs"]).to_pylist()}
        ids, found, links = compare_blocks(held[key[0].as_py()], held[key[1].as_py()], axes, threshold)
        at = np.flatnonzero(found)
        a, b = zip(*links, strict=True) if links else ((), ())
        none = [None] * len(links)
        return pa.Table.from_arrays([pa.array(ids[at].tolist() + none, pa.int64()), pa.array(found[at].tolist() + none, pa.int64()), pa.array([None] * len(at) + list(a), pa.int64()), pa.array([None] * len(at) + list(b), pa.int64())], ["class", "found", "a", "b"])

    met = sides.join(blocks.select("block", "classes", "copies", "vecs"), "block").groupBy("left", "right").applyInArrow(compare, "class long, found long, a long, b long")
    met = scratch.written(met, "met")
    counts = met.filter("class is not null").groupBy("class").agg(F.sum("found").alias("found"))
    joined = contracted_components(met.filter("a is not null").select("a", "b"), "a", "b", scratch, "components").withColumnRenamed("node", "class")
    lowest = classes.select("class", "least").join(joined, "class").groupBy("component").agg(F.min("least").alias("lowest"))
    facts = classes.join(counts, "class", "left").join(joined, "class", "left").join(lowest, "component", "left")
    facts = scratch.written(facts.select("vec", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component_id")), "facts")
    scratch.keep("facts")
    known = usable.join(facts, "vec").select("vec_id", "n_links", "component_id")
    alone = given.filter("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
