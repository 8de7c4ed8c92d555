"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new capacities are demands, and a byte that changes shard costs one (or what a cost
matrix says); a minimum-cost flow between shards gives the fewest moved bytes. Every arc is then a byte range of an old
shard, a range is a run of blocks (old shard, hash of doc_id and checksum) with rows at both ends split by their middle byte, and
only the files of shards that give or get a block are written again.

Only shard totals (bounded by the number of shards) reach the driver. Byte offsets come from block totals and a window
inside each block, so a hot old shard is many blocks. The text crosses the network once, dealt by runs of blocks.

Defined results: null text has no bytes, so 16 with the overhead; rows with a null shard
key are in an old shard of their own, NO_SHARD, of which all bytes move; very long texts are rows like others, and a shard
may differ from its capacity by half of one; repeated rows are placed each on its own, ties ordered by size and checksum; an empty table gives no rows; extra
columns are carried along, and the columns that this module adds begin with an underscore until the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.llm import common

ROW_OVERHEAD = 16
#: The old shard of rows whose shard key is null.
NO_SHARD = -(1 << 31)
#: Blocks of an old shard: so many at least, and more so that a block holds about this many bytes.
LEAST_BLOCKS, BLOCK_BYTES = 64, 64 << 20
#: Runs of blocks, the unit in which rows are dealt to tasks.
LEAST_RUNS, RUN_BYTES = 160, 256 << 20


def min_cost_flow(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Integer flows from supplies to demands (equal sums) of least total cost, by successive shortest paths.

    Each round runs Dijkstra with potentials over the residual bipartite graph, one vectorised row a settled node.
    """
    m, n = cost.shape
    flow = np.zeros((m, n), np.int64)
    left, want = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    if left.sum() != want.sum():
        raise ValueError("supplies and demands must have equal sums")
    potential = np.zeros(m + n)
    while left.any():
        dist = np.full(m + n, np.inf)
        dist[:m][left > 0] = 0
        parent = np.full(m + n, -1)
        done = np.zeros(m + n, bool)
        target = -1
        while True:
            open_dist = np.where(done, np.inf, dist)
            u = int(open_dist.argmin())
            if not np.isfinite(open_dist[u]):
                raise ValueError("no path")
            done[u] = True
            if u >= m and want[u - m] > 0:
                target = u
                break
            if u < m:
                v, reach = slice(m, m + n), dist[u] + np.maximum(0, cost[u] + potential[u] - potential[m:])
            else:
                back = flow[:, u - m] > 0
                v, reach = slice(0, m), np.where(back, dist[u] + np.maximum(0, -cost[:, u - m] + potential[u] - potential[:m]), np.inf)
            better = (reach < dist[v]) & ~done[v]
            dist[v] = np.where(better, reach, dist[v])
            parent[v] = np.where(better, u, parent[v])
        potential += np.minimum(dist, dist[target])
        path = [target]
        while parent[path[-1]] >= 0:
            path.append(int(parent[path[-1]]))
        steps = list(zip(path[1:], path, strict=False))  # from, to
        amount = min(left[path[-1]], want[target - m], *(flow[v, u - m] for u, v in steps if u >= m)) if any(u >= m for u, _ in steps) else min(left[path[-1]], want[target - m])
        for u, v in steps:
            if u < m:
                flow[u, v - m] += amount
            else:
                flow[v, u - m] -= amount
        left[path[-1]] -= amount
        want[target - m] -= amount
    return flow


@dataclass
class ReshardPlan:
    """Flows between shards in bytes; ranges: per old shard the ends of its byte ranges and the shards they go to."""

    old_bytes: dict[int, int]
    capacities: list[int]
    flow: dict[tuple[int, int], int]
    ranges: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)

    @property
    def moved_bytes(self) -> int:
        return sum(v for (i, j), v in self.flow.items() if i != j)

    @property
    def affected(self) -> list[int]:
        """New shards whose files differ from the old shard of the same number."""
        touched = {k for (i, j), v in self.flow.items() if i != j and v for k in (i, j)}
        return [j for j in range(len(self.capacities)) if j in touched or j not in self.old_bytes]


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def plan_reshard(old_bytes: dict[int, int], capacities: list[int], cost: np.ndarray | None = None) -> ReshardPlan:
    """cost[i, j]: of moving a byte from the i-th old shard in order of number to new shard j; default: one if i's number isn't j."""
    olds = sorted(old_bytes)
    if cost is None:
        cost = (np.array(olds)[:, None] != np.arange(len(capacities))[None, :]).astype(float) if olds else np.zeros((0, len(capacities)))
    flow = min_cost_flow(np.array([old_bytes[i] for i in olds], np.int64), np.array(capacities, np.int64), cost)
    plan = ReshardPlan(dict(old_bytes), list(capacities), {(olds[a], int(b)): int(flow[a, b]) for a, b in zip(*np.nonzero(flow), strict=True)})
    for i in olds:
        arcs = sorted(((j != i, j, v) for (k, j), v in plan.flow.items() if k == i))  # what stays comes first
        plan.ranges[i] = (np.cumsum([v for *_, v in arcs]).tolist(), [j for _, j, _ in arcs])
    return plan


def utf8_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_OVERHEAD


def reshard(docs: DataFrame, old_shard: Column, n_shards: int, path: str, id_column: str = "doc_id", text: str = "text", cost: np.ndarray | None = None) -> tuple[DataFrame, ReshardPlan]:
    """Rewrite docs into shards 0..n_shards-1 of equal bytes under `path`, one folder a shard.

    old_shard: the number of the shard that holds a row now. Returns the rows read back, with shard and slot (position
    in the shard, gapless from 0), and the plan.
    """
    spark = docs.sparkSession
    own = docs.columns
    tie = [F.col(id_column), F.col("__pw_size"), F.col("__pw_crc")]
    rows = docs.withColumns({"__pw_old": F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD)), "__pw_size": utf8_bytes(text), "__pw_crc": F.crc32(F.coalesce(F.col(text), F.lit("")))})

    # 1. block totals; the number of blocks of an old shard follows from its bytes
    sums = {r["__pw_old"]: int(r["b"]) for r in rows.groupBy("__pw_old").agg(F.sum("__pw_size").alias("b")).collect()}
    if not sums:
        empty = docs.withColumns({"shard": F.lit(0).cast("int"), "slot": F.lit(0).cast("long")}).limit(0)
        return empty, ReshardPlan({}, [0] * n_shards, {})
    plan = plan_reshard(sums, even_capacities(sum(sums.values()), n_shards), cost)
    total = sum(sums.values())
    n_runs = max(LEAST_RUNS, total // RUN_BYTES)
    tasks, usual = total // RUN_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape, first = [], 0
    for i in sorted(sums):
        runs = max(1, round(n_runs * sums[i] / total))
        blocks = runs * max(1, -(-max(LEAST_BLOCKS, sums[i] // BLOCK_BYTES) // runs))
        shape.append((i, runs, blocks, first, *plan.ranges[i]))
        first += runs
    # one row an old shard: proven small enough to broadcast
    shapes = F.broadcast(spark.createDataFrame(shape, "__pw_old int, __pw_runs int, __pw_blocks int, __pw_first int, __pw_ends array<long>, __pw_to array<int>"))
    rows = rows.join(shapes, "__pw_old").withColumn("__pw_block", F.pmod(F.xxhash64(id_column, "__pw_crc"), F.col("__pw_blocks")).cast("int"))
    rows = rows.withColumn("__pw_run", (F.col("__pw_first") + F.floor(F.col("__pw_block") * F.col("__pw_runs") / F.col("__pw_blocks"))).cast("int"))
    totals = common.written(rows.groupBy("__pw_run", "__pw_old", "__pw_block").agg(F.sum("__pw_size").alias("__pw_bytes")), "blocks")
    before = Window.partitionBy("__pw_old").orderBy("__pw_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__pw_from", F.coalesce(F.sum("__pw_bytes").over(before), F.lit(0).cast("long")))

    # 2. the shard of a row: by the byte range that holds its middle
    block = Window.partitionBy("__pw_run", "__pw_old", "__pw_block").orderBy(*tie)

    def placed(rows: DataFrame, per_run: DataFrame) -> DataFrame:
        rows = (rows.repartition(tasks, "__pw_run") if tasks > usual else rows.repartition("__pw_run")).join(per_run, "__pw_run")
        rows = rows.withColumn("__pw_at", F.element_at("__pw_starts", F.col("__pw_block")) + F.sum("__pw_size").over(block.rowsBetween(Window.unboundedPreceding, -0)) - F.col("__pw_size") / 2)
        index = F.size(F.filter("__pw_ends", lambda e: e <= F.col("__pw_at")))
        return rows.withColumn("__pw_shard", F.element_at("__pw_to", F.least(index + 1, F.size("__pw_to"))))

    by_run = starts.groupBy("__pw_run").agg(F.map_from_entries(F.collect_list(F.struct("__pw_block", "__pw_from"))).alias("__pw_starts"))
    narrow = placed(rows.select("__pw_run", "__pw_old", "__pw_block", "__pw_size", "__pw_crc", "__pw_ends", "__pw_to", id_column), by_run)
    counts = common.written(narrow.groupBy("__pw_shard", "__pw_run", "__pw_old", "__pw_block").agg(F.count("*").alias("__pw_n")), "counts")

    # 3. slots: rows of the shard in earlier blocks, plus the place within the block
    earlier = Window.partitionBy("__pw_shard").orderBy("__pw_old", "__pw_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__pw_base", F.coalesce(F.sum("__pw_n").over(earlier), F.lit(0).cast("long")))
    per_run = (
        bases.groupBy("__pw_run").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("__pw_block", "__pw_shard"), "__pw_base"))).alias("__pw_bases"))
        .join(by_run, "__pw_run")
    )
    full = placed(rows, per_run)
    within = Window.partitionBy("__pw_run", "__pw_old", "__pw_block", "__pw_shard").orderBy(*tie)
    full = full.withColumn("slot", F.element_at("__pw_bases", F.struct("__pw_block", "__pw_shard")) + F.row_number().over(within) - 1)
    full = full.select(*(F.col(f"`{c}`") for c in own if c not in ("shard", "slot")), F.col("__pw_shard").alias("shard"), F.col("slot").cast("long").alias("slot"))
    affected = plan.affected
    full.filter(F.col("shard").isin(affected) if affected else F.lit(False)).write.partitionBy("shard").parquet(path)
    kinds = [f"`{n}` {k}" for n, k in full.dtypes]
    result = spark.read.schema(", ".join(kinds)).parquet(path).select(*(F.col(f"`{c}`") for c in full.columns))  # the folder column came last
    if len(affected) < n_shards:
        result = result.unionByName(full.filter(~F.col("shard").isin(affected)))
    return result, plan
