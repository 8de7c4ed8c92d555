"""Sources of frames and signals, and time alignment.

A frame table has video_id, frame_idx, ts (seconds), width, height and rgba (row-major bytes, four a pixel); a signal
table has video_id, frame_idx, ts and brightness (0..1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photowarden.runtime import ship

FRAMES = T.StructType([
    T.StructField("video_id", T.StringType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("ts", T.DoubleType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType()),
])
#: A second of the events signal is three days of its clock.
EVENT_UNIT, EVENT_FULL_SCALE = 259_200.0, 500.0


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of one or more videos (a folder or glob of Parquet files)."""
    return spark.read.schema(FRAMES).parquet(path)


def rgba_of(data: np.ndarray, channels: int) -> bytes:
    """Opaque RGBA bytes of an image's grey, BGR or BGRA bytes."""
    px = data.reshape(-1, channels)
    out = np.full((len(px), 4), 255, np.uint8)
    out[:, :3] = px if channels == 1 else px[:, 2::-1]
    if channels == 4:
        out[:, 3] = px[:, 3]
    return out.tobytes()


def read_images(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """Decoded image files named <video>/<frame>.<ext> as frames; the image source gives grey or BGR(A) rows, top first."""
    ship()
    images = spark.read.format("image").load(path).select("image.*").filter("height > 0 and width > 0")
    name = F.split("origin", "/")
    stem = F.regexp_extract(F.element_at(name, -1), r"(\d+)", 1).cast("int")
    rows = images.select(F.element_at(name, -2).alias("video_id"), stem.alias("frame_idx"), (stem / fps).alias("ts"), "width", "height", "nChannels", "data")

    def run(batches):
        for batch in batches:
            made = [rgba_of(np.frombuffer(d, np.uint8), n) for n, d in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], FRAMES.names)

    return rows.mapInArrow(run, FRAMES)


def signal_from_events(events: DataFrame, unit: float = EVENT_UNIT, full_scale: float = EVENT_FULL_SCALE) -> DataFrame:
    """Brightness of each user's events in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / unit
    return events.select(F.col("user_id").alias("video_id"), F.row_number().over(order).alias("frame_idx"), at.alias("ts"), F.least(F.col("value") / full_scale, F.lit(1.0)).alias("brightness"))


def byte_of(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255))).cast("int")


def frames_from_embeddings(embeddings: DataFrame, fps: float = 30.0, transparent_below: int = 0) -> DataFrame:
    """8x8 frames of each label's vectors; red, green and blue are the bytes shifted by 0, 21 and 42 places. Pixels whose
    blue is below `transparent_below` are transparent."""
    order = Window.partitionBy("label").orderBy("vec_id")
    bytes_ = F.transform("embedding", byte_of)
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(two(F.get("b", i)), two(F.get("b", (i + 21) % 64)), two(F.get("b", (i + 42) % 64)), F.when(F.get("b", (i + 42) % 64) < transparent_below, "00").otherwise("FF")))
    numbered = embeddings.select(F.col("label").alias("video_id"), F.row_number().over(order).alias("frame_idx"), bytes_.alias("b"))
    return numbered.select("video_id", "frame_idx", ((F.col("frame_idx") - 1) / fps).alias("ts"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(pixels, "")).alias("rgba"))


def kept_times(ts: np.ndarray, least_gap: float) -> list[int]:
    """Positions of sorted times that a greedy limiter keeps."""
    kept, at = [], 0
    while at < len(ts):
        kept.append(at)
        at = max(at + 1, int(np.searchsorted(ts, ts[at] + least_gap * (1 - 1e-9))))
        while at < len(ts) and ts[at] - ts[kept[-1]] < least_gap:
            at += 1
    return kept


def last_kept(ts: np.ndarray, least_gap: float, before: float) -> dict:
    """The last time that a block of sorted times keeps, by the first that it keeps: kept[j] if that is time[j]. What was
    kept before the block is at `before` or earlier, so only the block's first times can be first."""
    first = int(np.searchsorted(ts, before + least_gap * (1 + 1e-9))) + 1
    after = np.searchsorted(ts, ts + least_gap * (1 - 1e-9))  # a little early, see kept_times
    known: dict[int, float] = {}
    for start in range(min(first, len(ts))):
        path, at = [], start
        while at not in known:
            path.append(at)
            then = max(at + 1, int(after[at]))
            while then < len(ts) and ts[then] - ts[at] < least_gap:
                then += 1
            if then >= len(ts):
                known[at] = float(ts[at])
                break
            at = then
        known.update(dict.fromkeys(path, known[at]))
    return {"time": ts[:first].tolist(), "kept": [known[k] for k in range(min(first, len(ts)))]}


#: Rows of a block of a video's times.
BLOCK_ROWS = 65_536


def limit_rate(rows: DataFrame, least_gap: float = 1 / 60, rows_a_block: int | None = None) -> DataFrame:
    """Greedy limiter: a row is dropped when it comes less than `least_gap` after the last row that was kept.

    Blocks of a video's times tell the last time that they keep for each time that they may begin with; these tables are
    followed through a video, and then every block finds its kept rows. No task holds more than a block.
    """
    ship()
    w = Window.partitionBy("video_id").orderBy("ts", "frame_idx")
    narrow = rows.select("video_id", "frame_idx", F.col("ts").cast("double").alias("ts"))
    narrow = narrow.withColumns({"_block": F.floor((F.row_number().over(w) - 1) / (rows_a_block or BLOCK_ROWS)), "_before": F.lag("ts").over(w)})
    kinds = dict(narrow.dtypes)
    video = f"video_id {kinds['video_id']}"

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.lexsort((table.column("frame_idx").to_numpy(zero_copy_only=False), table.column("ts").to_numpy(zero_copy_only=False)))))

    def tabulate(table: pa.Table) -> pa.Table:
        table = ordered(table)
        before = table.column("_before")[0].as_py()
        found = last_kept(table.column("ts").to_numpy(), least_gap, -np.inf if before is None else before)
        return pa.Table.from_arrays([table.column("video_id").slice(0, 1), table.column("_block").slice(0, 1), pa.array([found["time"]], pa.list_(pa.float64())), pa.array([found["kept"]], pa.list_(pa.float64()))], ["video_id", "_block", "time", "kept"])

    def follow(table: pa.Table) -> pa.Table:
        blocks, last, found = sorted(table.select(["_block", "time", "kept"]).to_pylist(), key=lambda b: b["_block"]), None, []
        for b in blocks:
            found.append(last)
            last = next((k for t, k in zip(b["time"], b["kept"], strict=True) if last is None or t - last >= least_gap), last)
        return pa.Table.from_arrays([table.column("video_id"), pa.array([b["_block"] for b in blocks], pa.int64()), pa.array(found, pa.float64())], ["video_id", "_block", "last"])

    def keep(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, last = ordered(table), entry.column("last")[0].as_py()
        ts = table.column("ts").to_numpy()
        start = 0
        while last is not None and start < len(ts) and ts[start] - last < least_gap:
            start += 1
        return table.select(["video_id", "frame_idx"]).take(pa.array([start + k for k in kept_times(ts[start:], least_gap)], pa.int64()))

    tables = narrow.groupBy("video_id", "_block").applyInArrow(tabulate, f"{video}, _block long, time array<double>, kept array<double>")
    entries = tables.groupBy("video_id").applyInArrow(follow, f"{video}, _block long, last double")
    kept = narrow.groupBy("video_id", "_block").cogroup(entries.groupBy("video_id", "_block")).applyInArrow(keep, f"{video}, frame_idx {kinds['frame_idx']}")
    same = rows["video_id"].eqNullSafe(kept["video_id"]) & rows["frame_idx"].eqNullSafe(kept["frame_idx"])
    return rows.join(kept, same, "left_semi")


def sessions(rows: DataFrame, gap: float = 1000.0) -> DataFrame:
    """Adds session: a new one after more than `gap` seconds without a row."""
    w = Window.partitionBy("video_id").orderBy("ts", "frame_idx")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w).cast("long")).drop("_new")


def fixed_intervals(rows: DataFrame, interval: float, columns: list[str]) -> DataFrame:
    """One row a tick (0, interval, ... below the duration) with the last frame at or before it (as-of).

    Ticks and frames are put in one order and frames carried forward by a window, so nothing is joined by range.
    """
    w = Window.partitionBy("video_id").orderBy("at", "is_tick").rowsBetween(Window.unboundedPreceding, 0)
    start = Window.partitionBy("video_id")
    rel = rows.withColumn("_rel", F.col("ts") - F.min("ts").over(start))
    last = rel.groupBy("video_id").agg(F.max("_rel").alias("d")).filter("d > 0")
    n = F.ceil(F.col("d") / interval).cast("long") - 1
    ticks = last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long")))).alias("tick"))
    held = F.struct(*(F.col(c) for c in columns))
    both = rel.select("video_id", F.col("_rel").alias("at"), F.lit(0).alias("is_tick"), F.lit(None).cast("long").alias("tick"), held.alias("held")).unionByName(
        ticks.select("video_id", (F.col("tick") * interval).alias("at"), F.lit(1).alias("is_tick"), "tick", F.lit(None).cast(rel.select(held.alias("h")).schema["h"].dataType).alias("held"))
    )
    return both.withColumn("held", F.last("held", ignorenulls=True).over(w)).filter("is_tick = 1").select("video_id", "tick", "at", "held.*")


def first_bin_resolution(rows: DataFrame, column: str = "bin_resolution", order: str = "ts") -> DataFrame:
    """The first value in order of time that is neither missing nor zero, else 0."""
    useful = F.when(F.col(column) != 0, F.struct(F.col(order), F.col(column)))
    return rows.agg(F.coalesce(F.min(useful)[column], F.lit(0.0)).alias(column))
