"""Streams of frames whose order is lost between micro-batches: a buffer a video, and operators on what leaves it in order.

Every video keeps the frames of the last `delay` seconds of its own time. A frame leaves when the video's latest frame is
`delay` after it, with all frames before it, so what leaves is in order however the micro-batches were cut. A frame that
comes when later ones have left is late: it is counted and takes no part. The watermark closes a video that has gone quiet:
its frames leave, and what was open ends. Rows that are behind the watermark itself don't reach the operators; Spark counts
them in the query's progress (numRowsDroppedByWatermark), so the watermark's delay should be the greater one.

Videos are dealt to buckets, and a bucket's videos are one call and one row of state (transformWithState, which needs the
RocksDB state store: see `state_store`), as a call and each of its state variables cost milliseconds whatever they hold. A
video's state is bounded by the frames of `delay` seconds, the flashes of one second, and a few numbers.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from photowarden.operators import risk
from photowarden.runtime import ship
from photowarden.streaming import live

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
RISK_INPUTS = ("brightness", "psi_score", "coverage", "red", "chroma_rg", "chroma_by", "flicker_hz", "pattern")
RISK_OUT = "video_id string, frame_idx long, ts double, session long, is_flash boolean, intensity double, red_delta double, max_flashes long, risk_debt double, base_level string, risk_level string, late_frames long"
#: What carried_state gives of a video for a stream to go on from.
CARRIED = "video_id string, frames long, ts double, brightness double, red double, flashes long, intensity double, valid long, peak long, over long, debt double, level long, recent array<double>"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside use the RocksDB state store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Videos:
    """The videos of a bucket: names, a row of numbers each, the frames that wait (with their video's place) and the times of
    the last flashes. Numbers are doubles, so frame numbers are exact up to 2 ** 53."""

    SCHEMA = "names array<string>, timer long, numbers binary, waiting binary, places binary, recent binary, counts binary"

    def __init__(self, width: int, columns: int, state: tuple | None):
        names, self.timer, *parts = state or ([], -1, *[b""] * 5)
        whole = lambda k, kind=np.float64: np.frombuffer(bytes(parts[k]), kind)
        self.names, self.numbers = list(names), whole(0).reshape(-1, width).copy()
        self.waiting, self.places = whole(1).reshape(-1, columns), whole(2, np.int64)
        self.recent = [r.tolist() for r in np.split(whole(3), np.cumsum(whole(4, np.int64))[:-1])] if names else []
        self.at = {n: k for k, n in enumerate(self.names)}

    def found(self, names: list[str | None], start: tuple) -> list[int]:
        """The places of videos; new ones begin with the numbers."""
        new = [n for n in dict.fromkeys(names) if n not in self.at]
        self.at |= {n: k for k, n in enumerate(new, len(self.names))}
        self.names += new
        self.recent += [[] for _ in new]
        self.numbers = np.concatenate((self.numbers, np.tile(np.array(start, np.float64), (len(new), 1))))
        return [self.at[n] for n in names]

    def keep(self, kept: np.ndarray) -> None:
        """Only these videos stay; their frames must be among the ones that wait."""
        places = np.cumsum(kept) - 1
        there = kept[self.places]
        self.waiting, self.places, self.numbers = self.waiting[there], places[self.places[there]], self.numbers[kept]
        self.names, self.recent = ([x for x, k in zip(xs, kept, strict=True) if k] for xs in (self.names, self.recent))
        self.at = {n: k for k, n in enumerate(self.names)}

    def state(self) -> tuple:
        recent = np.array([t for r in self.recent for t in r], np.float64)
        counts = np.array([len(r) for r in self.recent], np.int64)
        return (self.names, self.timer, *(np.ascontiguousarray(x).tobytes() for x in (self.numbers, self.waiting, self.places.astype(np.int64), recent, counts)))


class InOrder(StatefulProcessor):
    """Keeps frames until their order is sure and hands them on. Subclasses have the `start` of a video's own numbers, take
    `released` frames and a video's `end`.

    A video's first numbers are its latest time, the last time that left, late frames, and when it is over if nothing comes
    (-1: not known). A bucket's timer is not later than the earliest of these."""

    FIRST = (-np.inf, -np.inf, 0, -1)
    start: tuple = ()

    def __init__(self, columns: tuple[str, ...], delay: float, quiet_ms: int, out: str):
        self.columns, self.delay, self.quiet_ms = ("ts", "frame_idx", *columns), delay, quiet_ms
        self.out = [c.split(" ")[0] for c in out.split(", ")]

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("videos", Videos.SCHEMA)

    def _videos(self) -> Videos:
        return Videos(len(self.FIRST) + len(self.start), len(self.columns), self.state.get())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, watermark = self._videos(), timerValues.getCurrentWatermarkInMs()
        came = pd.concat(list(rows))
        codes, names = pd.factorize(came["video_id"], use_na_sentinel=False)
        of = np.array(held.found([None if pd.isna(n) else n for n in names], (*self.FIRST, *self.start)), np.int64)[codes]
        fresh = came[list(self.columns)].to_numpy(np.float64, na_value=np.nan)
        latest, left, late, closes = held.numbers[:, :4].T  # views
        new = ~(fresh[:, 0] <= left[of])
        late += np.bincount(of[~new], minlength=len(late))
        timed = fresh[:, 0] == fresh[:, 0]
        np.maximum.at(latest, of[timed], fresh[timed, 0])
        every, places = np.concatenate((held.waiting, fresh[new])), np.concatenate((held.places, of[new]))
        ready = every[:, 0] <= (latest - self.delay)[places]
        held.waiting, held.places = every[~ready], places[~ready]
        out = self._released(held, every[ready], places[ready])
        for k in np.unique(of).tolist():
            closes[k] = max(live.event_ms(latest[k]) + self.quiet_ms if np.isfinite(latest[k]) else 0, watermark + 1)
        self._kept(held)
        yield from self._frame(out)

    def _released(self, held: Videos, frames: np.ndarray, places: np.ndarray) -> list[tuple]:
        """Hands on frames in order, video by video."""
        if not len(frames):
            return []
        order = np.lexsort((frames[:, 1], frames[:, 0], places))  # a time that isn't a number is last
        frames, places = frames[order], places[order]
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
        out, n = [], len(self.FIRST)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = int(places[a])
            numbers = held.numbers[k]
            numbers[1] = frames[b - 1, 0]
            numbers[n:], held.recent[k], rows = self.released(str(held.names[k]), numbers[n:].tolist(), held.recent[k], frames[a:b], int(numbers[2]))
            out += rows
        return out

    def _kept(self, held: Videos) -> None:
        """Writes the state, and registers a timer."""
        if not held.names:
            self.state.clear()
            return
        closes = held.numbers[:, 3]
        first = int(closes[closes >= 0].min()) if (closes >= 0).any() else -1
        if first >= 0 and not 0 <= held.timer <= first:
            self.handle.registerTimer(first)
            held.timer = first
        self.state.update(held.state())

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._videos()
        if not held.names:  # a timer of before a later video's earlier one
            return
        held.timer, closes = -1, held.numbers[:, 3]
        over = (closes >= 0) & (closes <= timerValues.getCurrentWatermarkInMs())
        gone = over[held.places]
        out = self._released(held, held.waiting[gone], held.places[gone])
        n = len(self.FIRST)
        for k in np.flatnonzero(over).tolist():
            out += self.end(str(held.names[k]), held.numbers[k, n:].tolist())
        held.keep(~over)
        self._kept(held)
        yield from self._frame(out)

    def released(self, video: str, numbers: list[float], recent: list[float], frames: np.ndarray, late: int) -> tuple[tuple, list[float], list[tuple]]:
        """A video's numbers and last flashes after some frames (a row each, in order), and the rows that they give."""
        raise NotImplementedError

    def end(self, video: str, numbers: list[float]) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    video = F.col("video_id").cast("string")
    return rows.withColumns({"video_id": video, "_bucket": F.pmod(F.xxhash64(video), F.lit(buckets))})


class FlashEvents(InOrder):
    """live.flash_events on frames in order."""

    start = tuple(np.nan if x is None else x for x in live._EMPTY)
    #: Whole numbers in live.STATE.
    WHOLE = frozenset(k for k, c in enumerate(live.STATE.split(", ")) if c.endswith(" long"))

    def __init__(self, delay: float, quiet_ms: int, threshold: float, gap: float, allowed: int, length: float):
        super().__init__(("brightness",), delay, quiet_ms, live.OUT)
        self.limits = (threshold, gap, allowed, length)

    def _read(self, numbers: list[float]) -> tuple:
        return tuple(None if x != x else int(x) if k in self.WHOLE else x for k, x in enumerate(numbers))

    def released(self, video: str, numbers: list[float], recent: list[float], frames: np.ndarray, late: int) -> tuple[tuple, list[float], list[tuple]]:
        ts, frame, brightness = frames[:, 0].tolist(), frames[:, 1].astype(int).tolist(), frames[:, 2].tolist()
        s, out = live.advance(video, self._read(numbers), ts, frame, brightness, *self.limits)
        return tuple(np.nan if x is None else x for x in s), recent, out

    def end(self, video: str, numbers: list[float]) -> list[tuple]:
        return live.ending(video, self._read(numbers), *self.limits[2:])


def flash_events_in_order(frames: DataFrame, delay: float = 2.0, threshold: float = 0.2, gap: float = 0.3, allowed: int = 3, length: float = 1.0, quiet_ms: int = 5_000, buckets: int = live.BUCKETS) -> DataFrame:
    """live.flash_events where frames may come up to `delay` seconds of their video's time after later ones."""
    ship(frames.sparkSession)
    return _dealt(frames, buckets).groupBy("_bucket").transformWithStateInPandas(FlashEvents(delay, quiet_ms, threshold, gap, allowed, length), live.OUT, "append", "eventTime")


def _clamp(x):
    return np.clip(x, 0.0, 1.0)


def _near(x, end: float):
    return _clamp((x - risk.NEAR_FROM * end) / (end - risk.NEAR_FROM * end))


class LiveRisk(InOrder):
    """The severity, debt and sticky level of `risk.risk_levels`, frame by frame.

    After more than `gap` seconds without a frame the analysis of a video begins anew; its debt and level stay, as they
    stay until the video is over.
    """

    #: frames, time, brightness, red, session; flashes, their intensity, valid ones, peak, seconds over it; debt, level
    start = (0, np.nan, np.nan, np.nan, 0, 0, 0.0, 0, 0, 0, 0.0, 0)

    def __init__(self, delay: float, quiet_ms: int, threshold: float, gap: float):
        super().__init__(RISK_INPUTS, delay, quiet_ms, RISK_OUT)
        self.threshold, self.gap = threshold, gap

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._videos()
        places = held.found([None if pd.isna(v) else v for v in initialState["video_id"]], (*self.FIRST, *self.start))
        for k, r in zip(places, initialState.itertuples(index=False), strict=True):
            held.numbers[k] = (r.ts, r.ts, 0, -1, r.frames, r.ts, r.brightness, r.red, 0, r.flashes, r.intensity, r.valid, r.peak, r.over, r.debt, r.level)
            held.recent[k] = sorted(map(float, r.recent))
        self.state.update(held.state())

    def _released(self, held: Videos, frames: np.ndarray, places: np.ndarray) -> list[tuple]:
        """What goes from frame to frame is followed video by video, all else is for the bucket's frames at once."""
        if not len(frames):
            return []
        order = np.lexsort((frames[:, 1], frames[:, 0], places))
        frames, places = frames[order], places[order]
        values = dict(zip(self.columns, frames.T, strict=True))
        ts, b, red = (values[c] for c in ("ts", "brightness", "red"))
        own = held.numbers[:, len(self.FIRST) :]  # a view, as in `start`
        first = np.concatenate(([True], np.diff(places) != 0))
        known = first & (own[places, 0] > 0)
        before = lambda x, k: np.where(first, np.where(known, own[places, k], np.nan), np.concatenate(([np.nan], x[:-1])))
        anew = ts - before(ts, 1) > self.gap
        begins = anew | (first & ~known)
        intensity, red_delta = (np.abs(x - np.where(begins, x, before(x, k))) for x, k in ((b, 2), (red, 3)))
        is_flash = intensity > self.threshold
        n, session, count, valids, peaks, overs = (np.empty(len(ts), np.int64) for _ in range(6))
        totals = np.empty(len(ts))
        runs = [*np.flatnonzero(first | anew).tolist(), len(ts)]
        for a, e in zip(runs, runs[1:], strict=False):
            k = places[a]
            frames_before, _, _, _, at, flashes, total, valid, peak, over = own[k, :10].tolist()
            recent = held.recent[k] if frames_before else []
            if anew[a]:
                frames_before, at, flashes, total, valid, peak, over, recent = 0, at + 1, 0, 0.0, 0, 0, 0, []
            flash, x, t = is_flash[a:e], intensity[a:e], ts[a:e]
            times = np.concatenate((recent, t[flash]))
            rolling = np.zeros(e - a, np.int64)
            rolling[flash] = np.searchsorted(times, t[flash], "right") - np.searchsorted(times, t[flash] - 1.0, "left")
            good = flash & (x >= 0) & (x <= 1)
            n[a:e], session[a:e] = np.arange(1, e - a + 1) + int(frames_before), at
            count[a:e], valids[a:e] = flash.cumsum() + int(flashes), good.cumsum() + int(valid)
            totals[a:e] = total + np.where(good, x, 0.0).cumsum()
            peaks[a:e], overs[a:e] = np.maximum.accumulate(np.maximum(rolling, int(peak))), (rolling > risk.FLASHES).cumsum() + int(over)
            z = e - 1
            own[k, :10] = n[z], ts[z], b[z], red[z], at, count[z], totals[z], valids[z], peaks[z], overs[z]
            held.recent[k] = times[times >= ts[z] - 1.0].tolist()
            held.numbers[k, 1] = ts[z]
        add, base = self._severity(values, n, red_delta, count, np.divide(totals, valids, out=np.zeros(len(ts)), where=valids > 0), peaks, overs)
        debts, whole = [], np.flatnonzero(first).tolist()
        for a, e in zip(whole, [*whole[1:], len(ts)], strict=True):
            debt = float(own[places[a], 10])
            for x in add[a:e].tolist():
                debt = min(1.0, max(0.0, risk.DEBT_DECAY * debt + (1 - risk.DEBT_DECAY) * x))
                debts.append(debt)
            own[places[a], 10] = debt
        owed = np.array(debts)
        rank = np.where(owed >= risk.DEBT_LIMITS[0], 2, np.where(owed >= risk.DEBT_LIMITS[1], np.maximum(base, 1), base))
        levels = np.empty(len(ts), np.int64)
        for a, e in zip(whole, [*whole[1:], len(ts)], strict=True):
            levels[a:e] = np.maximum.accumulate(np.maximum(rank[a:e], int(own[places[a], 11])))
            own[places[a], 11] = levels[e - 1]
        names, labels = [str(v) for v in held.names], lambda x: [risk.RANKS[k] for k in x.tolist()]
        most, late = np.where(count > 1, peaks, 0), held.numbers[places, 2].astype(np.int64)
        return list(zip([names[k] for k in places.tolist()], values["frame_idx"].astype(np.int64).tolist(), ts.tolist(), session.tolist(), is_flash.tolist(), intensity.tolist(), red_delta.tolist(), most.tolist(), debts, labels(rank), labels(levels), late.tolist(), strict=True))

    @staticmethod
    def _severity(values: dict[str, np.ndarray], n: np.ndarray, red_delta: np.ndarray, count: np.ndarray, average: np.ndarray, peaks: np.ndarray, overs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each frame adds to the debt, and its level without the debt."""
        several = count > 1
        most, violations = np.where(several, peaks, 0), np.where(several, overs, 0)
        psi, cover, red, rg, by, hz, pattern = (values[c] for c in ("psi_score", "coverage", "red", "chroma_rg", "chroma_by", "flicker_hz", "pattern"))
        signals = {"psi": _clamp(psi), "avg_intensity": _clamp(average), "coverage": _clamp(cover), "red": red, "red_delta": red_delta, "chroma": np.maximum(rg, by), "pattern": _clamp(pattern)}
        low, high = risk.FLICKER
        in_band = (hz >= low) & (hz <= high)
        hazard = np.where(in_band, np.where(hz <= risk.PEAK, _clamp(1 - (risk.PEAK - hz) / (risk.PEAK - low)), _clamp(1 - (hz - risk.PEAK) / (high - risk.PEAK))), 0.0)
        w, limits = risk.DEBT_WEIGHTS, risk.LIMITS
        spatial = np.maximum(_near(signals["avg_intensity"], limits["avg_intensity"][0]), _near(signals["coverage"], limits["coverage"][0]))
        add = _clamp(w["spatial"] * spatial + w["psi"] * _near(signals["psi"], limits["psi"][0]) + w["flashes"] * _clamp((most - 1) / 2) + w["flicker"] * hazard)
        reaches = [np.any([x >= limits[name][k] for name, x in signals.items()], axis=0) | (in_band & ((signals["avg_intensity"] >= limits["avg_intensity"][k]) | (signals["coverage"] >= limits["coverage"][k]))) for k in (0, 1)]
        color = _clamp(np.maximum(np.maximum(red_delta * risk.RED_DELTA_FACTOR, red), signals["chroma"]))
        weighted = risk.WEIGHTS["psi"] * signals["psi"] + risk.WEIGHTS["color"] * color + risk.WEIGHTS["pattern"] * signals["pattern"]
        base = np.select([~(several & (n > 1)), reaches[0] | (most > risk.FLASHES) | (violations > 0), reaches[1], weighted >= risk.WEIGHTED[0], weighted >= risk.WEIGHTED[1]], [0, 2, 1, 2, 1], 0)
        return add, base


def live_risk(frames: DataFrame, delay: float = 2.0, threshold: float = 0.2, gap: float = 1000.0, quiet_ms: int = 5_000, carried: DataFrame | None = None, buckets: int = live.BUCKETS) -> DataFrame:
    """Rows of RISK_OUT, a frame each, from frames with RISK_INPUTS; carried: what carried_state made of earlier frames."""
    ship(frames.sparkSession)
    grouped = None if carried is None else _dealt(carried, buckets).groupBy("_bucket")
    out = _dealt(frames, buckets).groupBy("_bucket").transformWithStateInPandas(LiveRisk(delay, quiet_ms, threshold, gap), RISK_OUT, "append", "eventTime", grouped)
    return out.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("ts", "intensity", "red_delta", "risk_debt")})  # pandas has nulls for NaN


def carried_state(rows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Rows of CARRIED, one a video, from the rows of risk.risk_levels (with is_flash and intensity) of all its frames."""
    last = F.max(F.struct("ts", "frame_idx", "brightness", "red", "flashes", "max_flashes", "sequence_violations", "risk_debt", "risk_level"))
    good = F.when(F.col("is_flash") & F.col("intensity").between(0.0, 1.0), F.col("intensity"))
    ends = rows.withColumn("_end", F.max("ts").over(Window.partitionBy("video_id")))
    found = ends.groupBy("video_id").agg(
        F.count("*").alias("frames"), last.alias("l"), F.coalesce(F.sum(good), F.lit(0.0)).alias("intensity"), F.count(good).alias("valid"),
        F.array_sort(F.collect_list(F.when(F.col("is_flash") & (F.col("ts") >= F.col("_end") - seconds), F.col("ts")))).alias("recent"),
    )
    several = F.col("l.flashes") > 1
    level = F.array_position(F.array(*map(F.lit, risk.RANKS)), F.col("l.risk_level")) - 1
    return found.select(
        F.col("video_id").cast("string").alias("video_id"), "frames", "l.ts", "l.brightness", "l.red", "l.flashes", "intensity", "valid", F.when(several, F.col("l.max_flashes")).otherwise(F.col("l.flashes")).cast("long").alias("peak"),
        F.col("l.sequence_violations").cast("long").alias("over"), F.col("l.risk_debt").alias("debt"), level.cast("long").alias("level"), "recent",
    )
