"""Order statistics and sums over sliding windows, in blocks that overlap by a window.

A video's rows are dealt to blocks of time or of rows; a row that a later block's first windows reach back to goes to that
block too (its halo). So one long video is many tasks, none holds more than a block, and a block is one pass: bounds of all
windows by two pointers, sums by differences of running sums in extended precision, maxima by a table of maxima over powers
of two, medians by a sorted window into and out of which each value goes once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photowarden.operators.windows import by_frame
from photowarden.runtime import ship

#: Seconds and rows of a block.
SECONDS, ROWS = 60.0, 65_536
#: Powers of e that running sums of decayed weights span.
POWERS = 300.0


def _run(rows: DataFrame, at: Column, reach: Column, columns: dict[str, Column], kernel: Callable, fields: dict[str, str]) -> DataFrame:
    """The kernel's arrays for each block's own rows, beside those rows; null where it gives none.

    A row goes whole to its own block, and with the kernel's columns only to those that reach back to it; so nothing is joined,
    and what made the rows runs once. `at` and `reach` are a row's place and the last place that reaches back to it, in blocks.
    Rows without a place are spread by their frame number.
    """
    ship()
    types = {"double": pa.float64(), "long": pa.int64()}
    own = F.floor(at)
    placed = rows.select(
        "video_id", "frame_idx", *(c.alias(f"_k_{n}") for n, c in columns.items()), own.alias("_own"), F.struct("*").alias("_whole"), F.explode_outer(F.sequence(own, F.floor(reach))).alias("_block"),
    ).withColumns({"_whole": F.when(F.col("_own").isNull() | (F.col("_own") == F.col("_block")), F.col("_whole")), "_part": F.when(F.col("_own").isNull(), F.pmod(F.xxhash64("frame_idx"), F.lit(4096))).otherwise(0)})

    def run(table: pa.Table) -> pa.Table:
        whole, narrow = table.column("_whole"), table.drop_columns(["_whole"])
        narrow = narrow.rename_columns([n.removeprefix("_k_") for n in narrow.column_names])
        if narrow.column("_own")[0].as_py() is None:
            return pa.Table.from_arrays([whole, *(pa.nulls(len(whole), types[k]) for k in fields.values())], ["_whole", *fields])
        frame, ts = (narrow.column(c).to_numpy(zero_copy_only=False) for c in ("frame_idx", "_at"))
        order = np.lexsort((frame, ts))
        narrow = narrow.take(pa.array(order))
        keep, found = kernel(ts[order], narrow)
        own = np.flatnonzero(narrow.column("_own").to_numpy() == narrow.column("_block").to_numpy())
        none = ~np.broadcast_to(keep, len(order))[own]
        made = (pa.array(np.where(none, 0, np.asarray(found[n])[own]).astype("f8" if k == "double" else "i8"), types[k], mask=none) for n, k in fields.items())
        return pa.Table.from_arrays([whole.take(pa.array(order[own])), *made], ["_whole", *fields])

    schema = T.StructType([placed.schema["_whole"], *(T.StructField(n, T.DoubleType() if k == "double" else T.LongType()) for n, k in fields.items())])
    made = placed.groupBy("video_id", "_block", "_part").applyInArrow(run, schema)
    return made.select("_whole.*", *fields)


def in_time_blocks(rows: DataFrame, columns: dict[str, Column], span: float, kernel: Callable, fields: dict[str, str], seconds: float | None = None) -> DataFrame:
    """Adds the fields of a kernel(ts, table) over rows of at most `span` seconds before each row; null without a time."""
    wide = max(SECONDS if seconds is None else seconds, span)
    ts = F.nanvl(F.col("ts").cast("double"), F.lit(None).cast("double"))
    return _run(rows, ts / wide, (ts + span * (1 + 1e-9) + 1e-9) / wide, {"_at": ts, **columns}, kernel, fields)


def in_row_blocks(rows: DataFrame, columns: dict[str, Column], history: int, kernel: Callable, fields: dict[str, str], size: int | None = None) -> DataFrame:
    """Adds the fields of a kernel(row, table) over the last `history` rows."""
    wide = max(ROWS if size is None else size, history)
    numbered = rows.withColumn("_row", (F.row_number().over(by_frame()) - 1).cast("double"))
    row = F.col("_row")
    return _run(numbered, row / wide, (row + history - 1) / wide, {"_at": row, **columns}, kernel, fields).drop("_row")


# ---- kernels -----------------------------------------------------------------------------------------------------------


def sliding_max(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The maximum of x[low:high] for each pair of bounds; minus infinity where it is empty."""
    out = np.full(len(low), -np.inf)
    length = high - low
    level, table = 0, x
    while (length >> level).any():  # table[k] is the maximum of 2**level values from k on
        at = np.flatnonzero((length >> level) == 1)
        out[at] = np.maximum(table[low[at]], table[high[at] - (1 << level)])
        step = 1 << level
        if len(table) <= step:
            break
        table = np.maximum(table[:-step], table[step:])
        level += 1
    return out


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.longdouble), np.cumsum(x, dtype=np.longdouble)))


def contrast_kernel(span: float, threshold: float, half_life: float, least: int) -> Callable:
    """Counts, mean, deviation, maximum, hits and decayed mean of the differences `d` within the last `span` seconds; a
    window's first row has no difference within it."""
    rate = np.log(2) / half_life

    def kernel(ts: np.ndarray, table: pa.Table) -> tuple[np.ndarray, dict]:
        d = table.column("d").to_numpy(zero_copy_only=False).astype(float)
        there = np.isfinite(d)
        x = np.where(there, d, 0.0)
        low, high = np.searchsorted(ts, ts - span, "left"), np.searchsorted(ts, ts, "right")
        first = low + 1
        between = lambda c: c[high] - c[first]
        n = np.maximum(between(np.concatenate(([0], np.cumsum(there)))), 1)
        middle = x.mean() if len(x) else 0.0
        mean = between(_running(np.where(there, x - middle, 0.0))) / n
        square = between(_running(np.where(there, (x - middle) ** 2, 0.0))) / n
        weighted = np.full(len(ts), np.nan)
        a = 0
        while a < len(ts):  # in pieces of time that the weights' powers allow
            b = max(a + 1, int(np.searchsorted(ts, ts[a] + POWERS / rate, "right")))
            start = low[a]
            g = np.where(there[start:b], np.exp(np.clip(rate * (ts[start:b] - ts[a]), -700, POWERS + 1)), 0.0)
            # rows of the same time may lie beyond the piece: none does, because its end is behind all of its last time
            total, weight = _running(g * x[start:b]), _running(g)
            lo, hi = np.minimum(first[a:b] - start, b - start), np.minimum(high[a:b] - start, b - start)
            below = weight[hi] - weight[lo]
            weighted[a:b] = np.divide(total[hi] - total[lo], below, out=np.full(b - a, np.nan, np.longdouble), where=below > 0)
            a = b
        found = {
            "w_count": high - low, "w_from": ts[np.minimum(low, len(ts) - 1)], "w_mean": mean + middle, "w_std": np.sqrt(np.maximum(square - mean * mean, 0)), "w_max": sliding_max(np.where(there, d, -np.inf), np.minimum(first, high), high),
            "w_hits": between(np.concatenate(([0], np.cumsum(there & (x >= threshold))))), "w_weighted": weighted,
        }
        return high - low >= least, found

    return kernel


CONTRAST_FIELDS = {"w_count": "long", "w_from": "double", "w_mean": "double", "w_std": "double", "w_max": "double", "w_hits": "long", "w_weighted": "double"}


def sliding_median(values: np.ndarray, history: int) -> np.ndarray:
    """The median (linear between the middle two) of the values that are numbers among the last `history`; NaN without one."""
    out = np.full(len(values), np.nan)
    there = np.flatnonzero(~np.isnan(values))
    events = sorted([(k, True) for k in there.tolist()] + [(k + history, False) for k in there.tolist() if k + history < len(values)])
    held: list[float] = []
    for e, (at, comes) in enumerate(events):
        if comes:
            insort(held, float(values[at]))
        else:
            held.pop(bisect_left(held, float(values[at - history])))
        until = events[e + 1][0] if e + 1 < len(events) else len(values)
        if until > at and held:
            m = len(held)
            out[at:until] = (held[(m - 1) // 2] + held[m // 2]) / 2
        elif until > at:
            out[at:until] = np.nan
    return out


def median_kernel(history: int) -> Callable:
    def kernel(ts: np.ndarray, table: pa.Table) -> tuple[np.ndarray, dict]:
        median = sliding_median(table.column("gap").to_numpy(zero_copy_only=False).astype(float), history)
        return ~np.isnan(median), {"w_median": median}

    return kernel
