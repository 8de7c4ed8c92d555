"""Flashes, clusters and violation windows.

Everything is keyed by video: one exchange and one sort serve all windows. The window state machine, which no associative
aggregate can run, goes over blocks of a video's narrow rows, from window to window and not from frame to frame; how a block
leaves it is tabulated for every way of finding it, and only these tables are followed through a video.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from photowarden.functions.scalar import clean_unit
from photowarden.operators.windows import by_frame, within_seconds
from photowarden.runtime import ship



def with_flashes(signal: DataFrame, threshold: float = 0.2, seed: Column | None = None) -> DataFrame:
    """Adds intensity (change against the previous frame; first frame 0, or against `seed`) and is_flash."""
    before = F.lag("brightness").over(by_frame())
    if seed is not None:
        before = F.coalesce(before, seed)
    return signal.withColumn("intensity", F.coalesce(F.abs(F.col("brightness") - before), F.lit(0.0))).withColumn("is_flash", F.col("intensity") > threshold)


def temporal_change(signal: DataFrame) -> DataFrame:
    """Adds temporal_change: as the intensity, over cleaned brightness and never seeded."""
    b = clean_unit(F.col("brightness"))
    return signal.withColumn("_b", b).withColumn("temporal_change", F.coalesce(F.abs(F.col("_b") - F.lag("_b").over(by_frame())), F.lit(0.0))).drop("_b")


def active(rows: DataFrame, least: float = 0.001) -> DataFrame:
    """Rows of interest: flashes and visible changes."""
    return rows.filter(F.col("is_flash") | (F.col("intensity") > least) | (F.col("temporal_change") > least))


def flash_counts(flagged: DataFrame) -> DataFrame:
    """Per video: frames, flashes, mean intensity of flashes within 0..1 (0 if none) and greatest intensity."""
    own = F.when(F.col("is_flash") & F.col("intensity").between(0.0, 1.0), F.col("intensity"))
    return flagged.groupBy("video_id").agg(
        F.count("*").alias("frame_count"), F.count_if("is_flash").alias("flash_count"), F.coalesce(F.avg(own), F.lit(0.0)).alias("avg_intensity"), F.max("intensity").alias("max_intensity")
    )


def clusters(flagged: DataFrame, gap: float = 0.3) -> DataFrame:
    """Single-linkage clusters of flashes in time: a flash more than `gap` after the last one begins a new cluster."""
    flashes = flagged.filter("is_flash")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(by_frame()) > gap).cast("int"), F.lit(1))
    numbered = flashes.withColumn("_new", new).withColumn("cluster_id", F.sum("_new").over(by_frame()).cast("int"))
    return numbered.groupBy("video_id", "cluster_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("count")
    )


def cluster_statistics(found: DataFrame) -> DataFrame:
    """Per video: sizes, durations, and flashes a second over the whole span (0 if there is none)."""
    d = F.col("end_time") - F.col("start_time")
    span = F.max("end_time") - F.min("start_time")
    return found.groupBy("video_id").agg(
        F.count("*").alias("cluster_count"), F.sum("count").alias("flashes"), F.avg("count").alias("avg_size"), F.max("count").alias("max_size"), F.min("count").alias("min_size"),
        F.percentile("count", 0.5).alias("median_size"), F.avg(d).alias("avg_duration"), F.max(d).alias("max_duration"), F.min(d).alias("min_duration"),
        F.when(span > 0, F.sum("count") / span).otherwise(0.0).alias("density"),
    )


def flash_histogram(flagged: DataFrame) -> DataFrame:
    """Flashes a whole second (tumbling) of each video."""
    return flagged.filter("is_flash").groupBy("video_id", F.floor("ts").alias("second")).agg(F.count("*").alias("flashes"))


def flash_statistics(flagged: DataFrame) -> DataFrame:
    """Per video: flashes, flashes a second of duration, and most in a tumbling second; zeros without flashes."""
    peak = flash_histogram(flagged).groupBy("video_id").agg(F.max("flashes").alias("max_per_second"))
    base = flagged.groupBy("video_id").agg(F.count_if("is_flash").alias("total"), (F.max("ts") - F.min("ts")).alias("duration"))
    rate = F.when(F.col("duration") > 0, F.col("total") / F.col("duration")).otherwise(0.0)
    return base.join(peak, "video_id", "left").select("video_id", "total", rate.alias("per_second"), F.coalesce("max_per_second", F.lit(0).cast("long")).alias("max_per_second"))


def rolling_flashes(flagged: DataFrame, seconds: float = 1.0, allowed: int = 3) -> DataFrame:
    """Per video: most flashes within any rolling second, and how many flashes end a second with more than allowed."""
    counted = flagged.filter("is_flash").withColumn("n", within_seconds("count(*)", seconds))
    return counted.groupBy("video_id").agg(F.max("n").alias("max_flashes"), F.count_if(F.col("n") > allowed).alias("sequence_violations"))


_WINDOW = "struct<start_time:double,start_frame:int,end_frame:int,frame_count:int,flash_count:int,closed_at:double>"
_STATE = f"first double, ws double, wf int, k int, last double, frames int, done array<{_WINDOW}>"


def closed_windows(frame: np.ndarray, ts: np.ndarray, is_flash: np.ndarray, length: float) -> tuple[list[dict], tuple | None]:
    """Closed windows of a video's frames in order, and time, frame and flashes of the one left open."""
    starts, flashes = np.flatnonzero(is_flash), np.concatenate(([0], np.cumsum(is_flash)))
    sorted_times = bool((np.diff(ts) >= 0).all())
    done, at = [], 0
    while (nth := int(np.searchsorted(starts, at))) < len(starts):
        opens = int(starts[nth])
        until = ts[opens] + length
        if sorted_times:
            closes = int(np.searchsorted(ts, until))
        else:
            later = np.flatnonzero(ts[opens:] >= until)
            closes = opens + int(later[0]) if len(later) else len(ts)
        if closes >= len(ts):
            return done, (float(ts[opens]), int(frame[opens]), int(flashes[-1] - flashes[opens]))
        done.append({
            "start_time": float(ts[opens]), "start_frame": int(frame[opens]), "end_frame": int(frame[closes]) - 1, "frame_count": int(frame[closes] - frame[opens]),
            "flash_count": int(flashes[closes + 1] - flashes[opens]), "closed_at": float(ts[closes]),
        })
        at = closes + 1
    return done, None


def violation_windows(flagged: DataFrame, allowed: int = 3, length: float = 1.0) -> DataFrame:
    """All closed flash-triggered windows of each video and the state at its end.

    A window opens at the first flash outside of a window and closes at the first frame, flash or not, that is `length`
    or more later; a flash on that frame counts, and opens no window. Returns one row a video: first, last (times),
    frames, ws, wf, k (the open window, null if none) and done (closed windows). A task holds the numbers of one video; its
    videos pass one after the other in order, as a call a video would cost more than the video does.
    """
    ship()
    rows = flagged.select("video_id", "frame_idx", F.col("ts").cast("double").alias("ts"), F.coalesce("is_flash", F.lit(False)).alias("is_flash"))
    schema = f"video_id {dict(rows.dtypes)['video_id']}, {_STATE}"
    kinds = to_arrow_schema(flagged.sparkSession.createDataFrame([], schema).schema)

    def video(name, pieces: list[pa.RecordBatch]) -> dict:
        frame, ts, is_flash = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in pieces]) for k in (1, 2, 3))
        done, left = closed_windows(frame, ts, is_flash.astype(bool), length)
        ws, wf, k = left or (None, None, 0)
        return {"video_id": name, "first": float(ts[0]), "ws": ws, "wf": wf, "k": k, "last": float(ts[-1]), "frames": len(ts), "done": done}

    def run(batches):
        name, held = None, []  # the video that may go on
        for batch in batches:
            codes = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                this = batch.column(0)[a].as_py()
                if held and this != name:
                    found.append(video(name, held))
                    held = []
                name = this
                held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_pylist(found, schema=kinds)
        if held:
            yield pa.RecordBatch.from_pylist([video(name, held)], schema=kinds)

    return rows.repartition("video_id").sortWithinPartitions("video_id", F.asc_nulls_last("frame_idx")).mapInArrow(run, schema)


#: Rows of a block of a video's frames.
BLOCK_ROWS = 65_536
_ENTRY = "ws double, wf int, k long"
_TABLE = f"_block long, until array<double>, exits array<struct<ws:double,wf:int,k:bigint>>, idle struct<ws:double,wf:int,k:bigint>, flashes long"


def _first_at(ts: np.ndarray, start: int, until: float, rising: bool) -> int:
    """The first place from `start` on whose time is `until` or later; the length if there is none."""
    if rising:
        return max(start, int(np.searchsorted(ts, until)))
    later = np.flatnonzero(ts[start:] >= until)
    return start + int(later[0]) if len(later) else len(ts)


def block_exits(frame: np.ndarray, ts: np.ndarray, is_flash: np.ndarray, length: float, before: float) -> dict:
    """How a block of frames leaves the window state, by how it finds it: `idle` if no window is open, and exits[j] if the
    open window closes at the first frame of time until[j] or later. Windows that were opened before the block end by
    before + length, so only the block's first frames can close them."""
    starts, counts = np.flatnonzero(is_flash), np.concatenate(([0], np.cumsum(is_flash)))
    rising = bool((np.diff(ts) >= 0).all())
    known: dict[int, dict | None] = {}  # the exit after the window that opens at a place

    def leave(at: int) -> dict | None:
        path = []
        while True:
            nth = int(np.searchsorted(starts, at))
            if nth == len(starts):
                found = None
                break
            opens = int(starts[nth])
            if opens in known:
                found = known[opens]
                break
            path.append(opens)
            closes = _first_at(ts, opens, ts[opens] + length, rising)
            if closes == len(ts):
                found = {"ws": float(ts[opens]), "wf": int(frame[opens]), "k": int(counts[-1] - counts[opens])}
                break
            at = closes + 1
        known.update(dict.fromkeys(path, found))
        return found

    highest = np.maximum.accumulate(ts)
    new = np.flatnonzero(np.diff(highest, prepend=-np.inf) > 0)
    new = new[: int(np.searchsorted(highest[new], before + length)) + 1]
    return {"until": highest[new].tolist(), "exits": [leave(int(k) + 1) for k in new], "idle": leave(0), "flashes": int(counts[-1])}


def block_entries(blocks: list[dict]) -> tuple[list[dict | None], dict | None]:
    """The state in which each of a video's blocks, in order, finds the window, and the state at the end."""
    entries, state = [], None
    for b in blocks:
        entries.append(state)
        if state is None:
            state = b["idle"]
            continue
        at = bisect_left(b["until"], state["ws"] + b["length"])
        state = b["exits"][at] if at < len(b["until"]) else {**state, "k": state["k"] + b["flashes"]}
    return entries, state


def windows_in_blocks(flagged: DataFrame, length: float = 1.0, rows_a_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The closed windows (video_id and the fields of violation_windows' done) and the open window of each video (video_id,
    ws, wf, k; null without one), as violation_windows has them, with no task that holds more than a block of frames.

    Where a block leaves the window state is a function of how it finds it, of a few values: those of the frames that can
    close a window from before. A block gives this function as a table; a video's tables, a row a block, are followed
    from the first to the last; then every block knows how it begins, and finds its windows.
    """
    ship()
    size = rows_a_block or BLOCK_ROWS
    number = F.row_number().over(by_frame()) - 1
    earlier = F.max("ts").over(by_frame().rowsBetween(Window.unboundedPreceding, -1))
    rows = flagged.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("ts").cast("double").alias("ts"), F.coalesce("is_flash", F.lit(False)).alias("is_flash"))
    rows = rows.withColumns({"_block": F.floor(number / size), "_before": earlier})
    rows = rows.withColumn("_last", F.max("_block").over(Window.partitionBy("video_id")))
    one = violation_windows(rows.filter("_last = 0"), length=length)  # videos of one block need no tables
    rows = rows.filter("_last > 0").drop("_last")
    video = f"video_id {dict(rows.dtypes)['video_id']}"
    arrow = lambda schema: to_arrow_schema(flagged.sparkSession.createDataFrame([], schema).schema)
    table_kinds, entry_kinds, window_kinds = arrow(f"{video}, {_TABLE}"), arrow(f"{video}, _block long, {_ENTRY}"), arrow(f"{video}, {_WINDOW[7:-1].replace(':', ' ')}")

    def ordered(table: pa.Table) -> tuple:
        order = np.argsort(table.column("frame_idx").to_numpy(), kind="stable")
        return tuple(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("frame_idx", "ts", "is_flash", "_before"))

    def exits(table: pa.Table) -> pa.Table:
        frame, ts, is_flash, before = ordered(table)
        found = block_exits(frame, ts, is_flash.astype(bool), length, float(before[0]) if before[0] == before[0] else -np.inf)
        return pa.Table.from_pylist([{"video_id": table.column("video_id")[0].as_py(), "_block": table.column("_block")[0].as_py(), **found}], schema=table_kinds)

    def follow(table: pa.Table) -> pa.Table:
        blocks = sorted(({**b, "length": length} for b in table.to_pylist()), key=lambda b: b["_block"])
        states, last = block_entries(blocks)
        none = {"ws": None, "wf": None, "k": 0}
        rows = [{"video_id": b["video_id"], "_block": b["_block"], **(s or none)} for b, s in zip(blocks, states, strict=True)]
        return pa.Table.from_pylist([*rows, {"video_id": blocks[0]["video_id"], "_block": -1, **(last or none)}], schema=entry_kinds)

    def windows(table: pa.Table, entry: pa.Table) -> pa.Table:
        if not table.num_rows:  # the state at the video's end
            return window_kinds.empty_table()
        frame, ts, is_flash, _ = ordered(table)
        is_flash, (e,) = is_flash.astype(bool), entry.to_pylist()
        done, at = [], 0
        if e["ws"] is not None:
            closes = _first_at(ts, 0, e["ws"] + length, bool((np.diff(ts) >= 0).all()))
            if closes == len(ts):
                return window_kinds.empty_table()
            flashes = e["k"] + int(is_flash[: closes + 1].sum())
            done.append({"start_time": e["ws"], "start_frame": e["wf"], "end_frame": int(frame[closes]) - 1, "frame_count": int(frame[closes]) - e["wf"], "flash_count": flashes, "closed_at": float(ts[closes])})
            at = closes + 1
        done += closed_windows(frame[at:], ts[at:], is_flash[at:], length)[0] if at < len(ts) else []
        name = table.column("video_id")[0].as_py()
        return pa.Table.from_pylist([{"video_id": name, **w} for w in done], schema=window_kinds)

    tables = rows.groupBy("video_id", "_block").applyInArrow(exits, f"{video}, {_TABLE}")
    entries = tables.groupBy("video_id").applyInArrow(follow, f"{video}, _block long, {_ENTRY}")
    closed = rows.groupBy("video_id", "_block").cogroup(entries.groupBy("video_id", "_block")).applyInArrow(windows, f"{video}, {_WINDOW[7:-1].replace(':', ' ')}")
    names = [f.split(":")[0] for f in _WINDOW[7:-1].split(",")]
    closed = one.select("video_id", F.explode("done").alias("w")).select("video_id", *(f"w.{n}" for n in names)).unionByName(closed)
    return closed, one.select("video_id", "ws", "wf", F.col("k").cast("long").alias("k")).unionByName(entries.filter("_block = -1").drop("_block"))


def violations(flagged: DataFrame, allowed: int = 3, length: float = 1.0, compat: bool = False) -> DataFrame:
    """Windows with more than `allowed` flashes; one still open at the end counts from half its length on.

    compat: the frame count of an incomplete window is one short.
    """
    done, left = windows_in_blocks(flagged, length)
    closed = done.select(
        "video_id", "start_time", (F.col("start_time") + length).alias("end_time"), F.lit(length).alias("duration"), "start_frame", "end_frame", "frame_count", "flash_count",
        F.lit(False).alias("incomplete"), "closed_at",
    )
    ends = flagged.groupBy("video_id").agg(F.max_by(F.col("ts").cast("double"), "frame_idx").alias("last"), F.count("*").cast("int").alias("frames"))
    state = left.withColumnRenamed("video_id", "_video").join(ends, F.col("_video").eqNullSafe(F.col("video_id"))).drop("_video")
    end = F.least(F.col("ws") + length, F.col("last"))
    last = F.col("frames") - (1 if compat else 0)
    tail = state.filter(F.col("ws").isNotNull() & (end - F.col("ws") >= length / 2)).select(
        "video_id", F.col("ws").alias("start_time"), end.alias("end_time"), (end - F.col("ws")).alias("duration"), F.col("wf").alias("start_frame"), last.alias("end_frame"),
        (last - F.col("wf") + 1).alias("frame_count"), F.col("k").cast("int").alias("flash_count"), F.lit(True).alias("incomplete"), F.col("last").alias("closed_at"),
    )
    return closed.unionByName(tail).filter(F.col("flash_count") > allowed)


def violation_statistics(flagged: DataFrame, allowed: int = 3, length: float = 1.0) -> DataFrame:
    """Per video, zeros where there is nothing: violations, dangerous frames and time with their percentages."""
    found = violations(flagged, allowed, length).groupBy("video_id").agg(F.count("*").alias("n"), F.sum("frame_count").alias("f"), F.sum("duration").alias("t"))
    base = flagged.groupBy("video_id").agg(F.count("*").alias("total_frames"), (F.max("ts") - F.min("ts")).alias("duration"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda a, b: F.when(F.col(b) > 0, zero(a) / F.col(b) * 100).otherwise(0.0)
    return base.join(found, "video_id", "left").select(
        "video_id", zero("n").cast("long").alias("violation_count"), zero("f").cast("long").alias("dangerous_frames"), "total_frames", part("f", "total_frames").alias("dangerous_frame_percent"),
        zero("t").cast("double").alias("dangerous_time"), part("t", "duration").alias("dangerous_time_percent"),
    )


def associated_clusters(flagged: DataFrame, gap: float = 0.3, allowed: int = 3, length: float = 1.0) -> DataFrame:
    """Violations with the clusters that overlap them, as known when the window closed.

    A cluster overlaps if it began before the window's end and has a flash after its start, up to the closing frame.
    Windows of a video don't overlap, so each flash looks back to the last window that began before it: windows and
    flashes are put in one order, and nothing is joined by range.
    """
    found = violations(flagged, allowed, length)
    new = F.coalesce((F.col("ts") - F.lag("ts").over(by_frame()) > gap).cast("int"), F.lit(1))
    flashes = flagged.filter("is_flash").withColumn("_new", new).withColumn("cluster_id", F.sum("_new").over(by_frame()).cast("int"))
    of_cluster = Window.partitionBy("video_id", "cluster_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    flashes = flashes.withColumns({"c_start": F.min("ts").over(of_cluster), "nth": F.count("*").over(of_cluster)})
    window = F.struct("start_frame", "start_time", "end_time", "closed_at")
    events = flashes.select("video_id", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.struct("cluster_id", "ts", "c_start", "nth").alias("flash"), F.lit(None).cast("struct<start_frame:int,start_time:double,end_time:double,closed_at:double>").alias("w"))
    events = events.unionByName(found.select("video_id", F.col("start_time").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["flash"].dataType).alias("flash"), window.alias("w")))
    so_far = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("w", F.last("w", ignorenulls=True).over(so_far)).filter((F.col("kind") == 0) & (F.col("flash.ts") <= F.col("w.closed_at")) & (F.col("flash.c_start") < F.col("w.end_time")))
    met = met.groupBy("video_id", "w", F.col("flash.cluster_id").alias("cluster_id")).agg(F.max("flash.nth").alias("count"), F.min("flash.c_start").alias("c_start"), F.max("flash.ts").alias("c_end"))
    return met.select("video_id", "w.start_frame", "cluster_id", "count", F.greatest("c_start", "w.start_time").alias("overlap_start"), F.least("c_end", "w.end_time").alias("overlap_end"))
