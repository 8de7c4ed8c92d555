"""The same flash semantics on streams of frames (video_id, frame_idx, ts, brightness).

State is a few numbers a video. Frames of a micro-batch are put in order; a watermark on `event_time` bounds how late a
frame may be, and closes a video that has gone quiet. Videos are dealt to buckets, and a bucket's videos are one call and
one row of state: a call costs some twenty milliseconds whatever it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from photowarden.runtime import ship

OUT = "video_id string, kind string, start_time double, end_time double, start_frame long, end_frame long, flash_count long, incomplete boolean"
#: previous brightness, open window (time, frame, flashes), open cluster (start, last, first frame, last frame, flashes), last time, frames
STATE = "prev double, ws double, wf long, k long, cs double, cl double, cf long, ce long, cn long, last double, frames long"
#: The state of a bucket: its videos, when each is over if nothing comes, and their numbers.
BUCKET = f"videos array<struct<video: string, due: bigint, {STATE.replace(' ', ': ').replace(',:', ',')}>>"
#: Buckets of videos; a query that starts again from its checkpoint must have the same.
BUCKETS = 256
_EMPTY = (None, None, None, 0, None, None, None, None, 0, None, 0)


#: Seconds that event_time is after ts: a watermark begins at 0, and a frame at or before it counts as late.
EVENT_START = 86_400


def with_event_time(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Adds event_time from ts (seconds, a day on) and its watermark."""
    return frames.withColumn("event_time", F.timestamp_micros(((F.col("ts") + EVENT_START) * 1_000_000).cast("long"))).withWatermark("event_time", delay)


def event_ms(ts: float) -> int:
    """event_time of a ts in milliseconds."""
    return int((ts + EVENT_START) * 1000)


def advance(video: str, s: tuple, ts: list, frames: list, brightness: list, threshold: float, gap: float, allowed: int, length: float) -> tuple[tuple, list]:
    """The state after some frames in order, and the rows of OUT that end in them."""
    prev, ws, wf, k, cs, cl, cf, ce, cn, last, n = s
    out = []
    for t, frame, b in zip(ts, frames, brightness, strict=True):
        n += 1
        if prev is not None and abs(b - prev) > threshold:
            if ws is None:
                ws, wf, k = t, frame, 1
            else:
                k += 1
            if cn and t - cl > gap:
                out.append((video, "cluster", cs, cl, cf, ce, cn, False))
                cn = 0
            if not cn:
                cs, cf = t, frame
            cl, ce, cn = t, frame, cn + 1
        if ws is not None and t >= ws + length:
            if k > allowed:
                out.append((video, "violation", ws, ws + length, wf, frame - 1, k, False))
            ws, wf, k = None, None, 0
        prev, last = b, t
    return (prev, ws, wf, k, cs, cl, cf, ce, cn, last, n), out


def ending(video: str, s: tuple, allowed: int, length: float) -> list:
    """The rows of OUT that a video's end gives: its open window, from half its length on, and its open cluster."""
    _, ws, wf, k, cs, cl, cf, ce, cn, last, n = s
    out = []
    if ws is not None:
        end = min(ws + length, last)
        if end - ws >= length / 2 and k > allowed:
            out.append((video, "violation", ws, end, wf, n, k, True))
    if cn:
        out.append((video, "cluster", cs, cl, cf, ce, cn, False))
    return out


def cleaned(s) -> tuple:
    """A state as read back: what was None isn't a number."""
    return tuple(None if isinstance(v, float) and v != v else v for v in s)


def by_video(rows: pd.DataFrame) -> Iterator[tuple[str | None, list, list, list]]:
    """Video, times, frame numbers and brightness of each video, in order."""
    codes, names = pd.factorize(rows["video_id"], use_na_sentinel=False)
    order = np.lexsort((rows["frame_idx"].to_numpy(), rows["ts"].to_numpy(), codes))
    columns = [rows[c].to_numpy()[order].tolist() for c in ("ts", "frame_idx", "brightness")]
    cuts = [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        name = names[codes[order[a]]]
        yield (None if pd.isna(name) else name, *(c[a:b] for c in columns))


def flash_events(frames: DataFrame, threshold: float = 0.2, gap: float = 0.3, allowed: int = 3, length: float = 1.0, quiet_ms: int = 5_000, buckets: int = BUCKETS) -> DataFrame:
    """Violation windows and closed clusters as they end (append mode); a quiet video gives its open ones.

    Frames are put in order within a micro-batch; `ordered.flash_events_in_order` does so across them.
    """
    ship(frames.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {v[0]: (v[1], cleaned(v[2:])) for v in state.get[0]} if state.exists else {}
        watermark, came, out = state.getCurrentWatermarkMs(), set(), []
        rows = [] if state.hasTimedOut else list(batches)
        for video, *columns in by_video(pd.concat(rows)) if rows else ():
            s, found = advance(str(video), known[video][1] if video in known else _EMPTY, *columns, threshold, gap, allowed, length)
            known[video] = (max(event_ms(s[9]) + quiet_ms, watermark + 1), s)
            came.add(video)
            out += found
        for video in [v for v, (due, _) in known.items() if due < watermark and v not in came]:
            out += ending(str(video), known.pop(video)[1], allowed, length)
        if known:
            state.update(([(v, due, *s) for v, (due, s) in known.items()],))
            state.setTimeoutTimestamp(max(min(due for due, _ in known.values()), watermark + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    video = F.col("video_id").cast("string")
    dealt = frames.withColumns({"video_id": video, "_bucket": F.pmod(F.xxhash64(video), F.lit(buckets))})
    return dealt.groupBy("_bucket").applyInPandasWithState(step, OUT, BUCKET, "append", GroupStateTimeout.EventTimeTimeout)


def flash_sessions(flashes: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """Clusters of flashes as session windows over event_time."""
    return flashes.groupBy("video_id", F.session_window("event_time", gap).alias("w")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("count"))


def flashes_per_second(flashes: DataFrame) -> DataFrame:
    """Flashes a tumbling second of event_time."""
    return flashes.groupBy("video_id", F.window("event_time", "1 second").alias("w")).agg(F.count("*").alias("flashes")).select("video_id", F.col("w.start").alias("second"), "flashes")


def status(query) -> dict:
    """State of a running query: whether it is active, and its last progress."""
    return {"active": query.isActive, "status": query.status, "progress": query.lastProgress}
