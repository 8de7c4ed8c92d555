"""Temporal metrics over ordered frames, as window expressions and array functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.functions.color import cie76, red_area_fraction, rgb_to_lab
from photowarden.functions.scalar import clean_unit, half_up
from photowarden.operators import sliding
from photowarden.operators.windows import by_frame, last_rows, so_far
from photowarden.runtime import ship


def delta(column: str) -> Column:
    """Change against the previous frame; 0 for the first."""
    return F.coalesce(F.abs(F.col(column) - F.lag(column).over(by_frame())), F.lit(0.0))


def delta_e(lab: str = "lab") -> Column:
    """Colour difference against the previous frame; 0 for the first."""
    return F.coalesce(cie76(F.col(lab), F.lag(lab).over(by_frame())), F.lit(0.0))


def variability(values: Column) -> Column:
    """Population deviation of an array, over 255 if any value exceeds 1; NaN and missing are left out; below two: 0."""
    good = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(good)
    some = F.greatest(n, F.lit(1))
    mean = F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / some
    spread = F.sqrt(F.aggregate(good, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / some)
    return F.when(n >= 2, spread / F.when(F.array_max(good) > 1, 255.0).otherwise(1.0)).otherwise(0.0)


def temporal_contrast(signal: DataFrame, frames: int = 15, compat: bool = False) -> DataFrame:
    """Adds current_rate, the greatest brightness change a second over the last frames, and max_rate so far.

    Steps of a millisecond or less don't count and a rate is at most 1000. compat: blocks of 15 frames instead of a
    sliding window, without the oldest step.
    """
    w = by_frame()
    b = clean_unit(F.col("brightness"))
    rows = signal.withColumn("_b", b)
    dt = F.col("ts") - F.lag("ts").over(w)
    rate = F.when(dt > 0.001, F.least(F.abs(F.col("_b") - F.lag("_b").over(w)) / dt, F.lit(1000.0))).otherwise(0.0)
    rows = rows.withColumn("_rate", F.coalesce(rate, F.lit(0.0)))
    if compat:
        n = F.row_number().over(w) - 1  # frames before
        j = (n + 1) % frames
        steps = F.when(n < frames - 1, n - 1).when(j <= 1, 0).otherwise(j - 1)  # so many of the latest steps count
        recent = F.collect_list("_rate").over(last_rows(frames))
        rows = rows.withColumn("_n", F.greatest(steps, F.lit(0))).withColumn("_all", recent)
        rows = rows.withColumn("current_rate", F.coalesce(F.array_max(F.slice("_all", F.greatest(F.size("_all") - F.col("_n") + 1, F.lit(1)), F.col("_n"))), F.lit(0.0))).drop("_n", "_all")
    else:
        rows = rows.withColumn("current_rate", F.coalesce(F.max("_rate").over(last_rows(frames - 1)), F.lit(0.0)))
    return rows.withColumn("max_rate", F.max("current_rate").over(so_far())).drop("_b", "_rate")


def coherence_of(values: np.ndarray, max_lag: int = 10) -> np.ndarray:
    """Autocorrelation at lags 1.. of each row of equally long windows (rows by values); a constant's variance is 1e-8."""
    n = values.shape[1]
    x = values - values.mean(1, keepdims=True)
    variance = (x * x).mean(1)
    variance = np.where(variance == 0, 1e-8, variance)
    lags = range(1, min(max_lag, n - 1) + 1)
    return np.stack([(x[:, : n - k] * x[:, k:]).sum(1) / ((n - k) * variance) for k in lags], 1) if n >= 2 else np.zeros((len(x), 0))


_COHERENCE = "coherence_score double, lags array<struct<lag:int,correlation:double>>"


def coherence(signal: DataFrame, window: int = 30, max_lag: int = 10) -> DataFrame:
    """Adds coherence_score, the mean absolute autocorrelation of the last values, and lags (lag, correlation).

    The windows of a batch go through numpy together, by length.
    """

    @F.arrow_udf(_COHERENCE)
    def run(windows: pa.Array) -> pa.Array:
        sizes = np.diff(windows.offsets.to_numpy())
        flat, first = windows.flatten().to_numpy(), np.cumsum(sizes) - sizes
        n_lags = np.clip(sizes - 1, 0, max_lag)
        ends = np.cumsum(n_lags)
        score, found = np.zeros(len(sizes)), np.empty(int(n_lags.sum()))
        for n in np.unique(sizes[sizes >= 2]).tolist():
            rows = np.flatnonzero(sizes == n)
            got = coherence_of(flat[first[rows][:, None] + np.arange(n)], max_lag)
            score[rows] = np.abs(got).mean(1)
            found[(ends - n_lags)[rows][:, None] + np.arange(got.shape[1])] = got
        number = np.arange(len(found)) - np.repeat(ends - n_lags, n_lags) + 1
        pairs = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(found)], ["lag", "correlation"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pairs)
        return pa.StructArray.from_arrays([pa.array(score), lists], ["coherence_score", "lags"])

    ship()
    rows = signal.withColumn("_c", run(F.collect_list(clean_unit(F.col("brightness"))).over(last_rows(window))))
    return rows.withColumns({"coherence_score": F.col("_c.coherence_score"), "lags": F.col("_c.lags")}).drop("_c")


def highest_peak(values: np.ndarray, min_lag: int = 2, threshold: float = 0.25) -> tuple[bool, int, float]:
    """The highest strict peak of the normalised autocorrelation, if it is above the threshold."""
    n = len(values)
    if n < min_lag + 2:
        return False, 0, 0.0
    x = np.where(np.isfinite(values), values, 0.0)
    x = x - x.mean()
    lags = np.arange(min_lag, n // 2)
    if len(lags) < 3:
        return False, 0, 0.0
    wide = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(x, wide)
    products = np.fft.irfft(spectrum * spectrum.conj(), wide)[lags]
    squares = np.concatenate(([0.0], np.cumsum(x * x)))
    norm = np.sqrt(squares[n - lags] * (squares[n] - squares[lags]))
    corr = np.divide(products, norm, out=np.zeros(len(lags)), where=norm > 0)
    peaks = np.flatnonzero((corr[1:-1] > corr[:-2]) & (corr[1:-1] > corr[2:])) + 1
    if not len(peaks):
        return False, 0, 0.0

    def plain(lag: int) -> float:
        a, b = x[: n - lag], x[lag:]
        return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))

    highest = peaks[corr[peaks] >= corr[peaks].max() - 1e-9]  # told apart by plain sums
    best, lag = max((plain(k), -k) for k in lags[highest].tolist())
    return (True, -lag, best) if best > threshold else (False, 0, 0.0)


def periodicity(values: Column, min_lag: int = 2, threshold: float = 0.25) -> Column:
    """struct<is_periodic, period, confidence> of an array of doubles, computed in Arrow batches."""

    ship()

    @F.pandas_udf("is_periodic boolean, period int, confidence double")
    def run(arrays: pd.Series) -> pd.DataFrame:
        found = [highest_peak(np.array([np.nan if x is None else x for x in a], float), min_lag, threshold) for a in arrays]
        return pd.DataFrame(found, columns=["is_periodic", "period", "confidence"])

    return run(values)


def flicker_frequency(flagged: DataFrame, threshold: float = 0.2, history: int = 1000) -> DataFrame:
    """Adds flicker_frequency: one over the median gap (0 to 10 s) between strong changes of the last rows, at most 100.

    Event time, not the clock of the machine, is measured. Rows that share a video and frame number each have their own.
    """
    w = by_frame()
    strong = F.col("temporal_change") > threshold
    rows = flagged.withColumn("_at", F.when(strong, F.col("ts")))
    rows = rows.withColumn("_prev", F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.col("_at") - F.col("_prev")
    rows = rows.withColumn("_gap", F.when((gap > 0) & (gap < 10), gap))
    rows = sliding.in_row_blocks(rows, {"gap": F.col("_gap")}, history, sliding.median_kernel(history), {"w_median": "double"})
    median = F.col("w_median")
    return rows.withColumn("flicker_frequency", F.coalesce(F.when(median > 0, F.least(1 / median, F.lit(100.0))), F.lit(0.0))).drop("_at", "_prev", "_gap", "w_median")


def edge_change(rows: DataFrame, window: int = 2) -> DataFrame:
    """Adds edge_change: mean absolute change of edge_density over the last window-1 steps."""
    step = rows.withColumn("_d", F.abs(F.col("edge_density") - F.lag("edge_density").over(by_frame())))
    return step.withColumn("edge_change", F.coalesce(F.avg("_d").over(last_rows(window - 1)), F.lit(0.0))).drop("_d")


def color_history(rows: DataFrame, k: int = 30) -> DataFrame:
    """Adds per channel c of mean_c: variance_c (deviation of the last k means) and change_c (mean absolute step)."""
    for c in "rgb":
        rows = rows.withColumn(f"_d{c}", F.abs(F.col(f"mean_{c}") - F.lag(f"mean_{c}").over(by_frame())))
    many = F.count("*").over(last_rows(k)) >= 2
    for c in "rgb":
        spread = F.stddev_pop(f"mean_{c}").over(last_rows(k)) / F.when(F.max(f"mean_{c}").over(last_rows(k)) > 1, 255.0).otherwise(1.0)
        rows = rows.withColumn(f"variance_{c}", F.when(many, spread).otherwise(0.0)).withColumn(f"change_{c}", F.when(many, F.avg(f"_d{c}").over(last_rows(k - 1))).otherwise(0.0))
    return rows.drop("_dr", "_dg", "_db")


def _spikes_of(c: str, fixed: float, deviations: float) -> Column:
    h, mean = F.col(f"_h{c}"), F.col(f"_m{c}")
    spread = F.sqrt(F.greatest(F.aggregate(h, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.greatest(F.size(h), F.lit(1)), F.lit(0.0)))
    limit = mean + deviations * spread
    marked = F.transform(h, lambda x, i: F.struct(F.lit(c).alias("channel"), i.alias("frame_index"), x.alias("magnitude")))
    return F.when(F.size(h) >= 2, F.filter(marked, lambda s: (s["magnitude"] > fixed) & (s["magnitude"] > limit))).otherwise(F.slice(marked, 1, 0))


def color_spikes(rows: DataFrame, k: int = 30, fixed: float = 0.2, deviations: float = 2.0) -> DataFrame:
    """Adds spikes: steps of the channel means (of 0..1) above `fixed` and above their mean plus two deviations, within
    the last k frames; frame_index counts from the newest step."""
    for c in "rgb":
        rows = rows.withColumn(f"_d{c}", F.abs(F.col(f"mean_{c}") - F.lag(f"mean_{c}").over(by_frame())) / 255.0)
    found = []
    for c in "rgb":
        rows = rows.withColumn(f"_h{c}", F.reverse(F.collect_list(f"_d{c}").over(last_rows(k - 1))))
        rows = rows.withColumn(f"_m{c}", F.aggregate(f"_h{c}", F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(f"_h{c}"), F.lit(1)))
        found.append(_spikes_of(c, fixed, deviations))
    rows = rows.withColumn("spikes", F.concat(*found))
    return rows.drop(*(f"_{p}{c}" for p in "dhm" for c in "rgb"))


def red_states(colors: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Adds lab, red_area, red_on and red_transition to rows with mean colour r, g, b."""
    rows = colors.withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    rows = rows.withColumn("red_area", red_area_fraction(F.col("r"), F.col("g"), F.col("b"), F.col("lab")))
    rows = rows.withColumn("red_on", (F.col("red_area") >= threshold).cast("int"))
    return rows.withColumn("red_transition", F.coalesce((F.col("red_on") != F.lag("red_on").over(by_frame())).cast("int"), F.lit(0)))


def duration_seconds(times: Column) -> Column:
    """Span of an ordered array of times: seconds if the median positive step is below 1, else milliseconds; without a
    span, median step times steps, or 30 frames a second."""
    n = F.size(times)
    steps = F.array_sort(F.filter(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.get(times, i - 1) - F.get(times, i - 2)), lambda d: d > 0))
    m = F.size(steps)
    median = F.when(m > 0, (F.get(steps, F.floor((m - 1) / 2).cast("int")) + F.get(steps, F.floor(m / 2).cast("int"))) / 2)
    span = F.element_at(times, -1) - F.element_at(times, 1)
    known = F.when(span > 0, span).otherwise(median * (n - 1))
    return F.when(n <= 1, 0.0).when(known.isNull(), (n - 1) / 30.0).otherwise(known / F.when(F.coalesce(median < 1, F.abs(span) < 10), 1.0).otherwise(1000.0))


def red_window(rows: DataFrame, k: int = 30, least: int = 5, threshold: float = 0.25, places: int | None = 3) -> DataFrame:
    """Adds red_metrics over the last k frames of red_states; with fewer than `least` frames, of this frame alone.

    places: decimals of the shares and the rate (None: all)."""
    n = F.count("*").over(last_rows(k))
    first_kept = F.row_number().over(by_frame()) - n + 1
    rows = rows.withColumns({"_n": n, "_t": F.sum("red_transition").over(last_rows(k)), "_row": F.row_number().over(by_frame()), "_first": first_kept})
    oldest = F.first("red_transition").over(last_rows(k))  # the step into the window isn't within it
    rows = rows.withColumns({"_inside": F.col("_t") - oldest, "_times": F.collect_list("ts").over(last_rows(k)), "_avg": F.avg("red_area").over(last_rows(k)), "_max": F.max("red_area").over(last_rows(k)), "_on": F.avg("red_on").over(last_rows(k))})
    enough = F.col("_n") >= least
    seconds = F.when(enough, duration_seconds(F.col("_times"))).otherwise(0.0)
    transitions = F.when(enough, F.col("_inside")).otherwise(0)
    events = F.floor(transitions / 2)
    rate = F.when((events > 0) & (seconds > 0), F.least(events / seconds, F.lit(60.0))).otherwise(0.0)
    cut = lambda x: half_up(x, places) if places is not None else x
    pick = lambda many, one: cut(F.when(enough, F.col(many)).otherwise(F.col(one).cast("double")))
    made = F.struct(
        pick("_avg", "red_area").alias("red_area_avg"), pick("_max", "red_area").alias("red_area_max"), pick("_on", "red_on").alias("red_on_fraction"), transitions.cast("long").alias("red_transitions"),
        events.cast("long").alias("red_flash_events"), cut(rate).alias("red_flash_per_second"), rate.between(3.0, 30.0).alias("red_flicker_in_risk_band"),
        F.lit(threshold).alias("red_area_threshold_used"), F.floor(seconds * 1000 + 0.5).cast("long").alias("window_duration_ms"),
    )
    return rows.withColumn("red_metrics", made).drop("_n", "_t", "_row", "_first", "_inside", "_times", "_avg", "_max", "_on")


#: Powers of e that a block of the decayed mean spans: what is a whole block older weighs below the precision of a double.
DECAY_BLOCK = 300.0


def with_decayed_mean(rows: DataFrame, value: str, lam: float, into: str) -> DataFrame:
    """Adds the mean of the values so far, weighted by exp(-lam * age); null before the first value.

    Weights grow with time from the start of a block of time, so they stay within a double's range; a block takes over
    the sums of the one before it. A row belongs to the block of the latest time with a value so far.
    """
    w, inside = by_frame(), Window.partitionBy("video_id", "_block").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    some = F.col(value).isNotNull()
    power = lam * (F.col("ts") - F.min("ts").over(Window.partitionBy("video_id")))
    rows = rows.withColumn("_power", power)
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.max(F.when(some, F.col("_power"))).over(so_far()) / DECAY_BLOCK), F.lit(0)))
    rows = rows.withColumn("_g", F.when(some, F.exp(F.col("_power") - F.col("_block") * DECAY_BLOCK)))
    rows = rows.withColumns({"_sum": F.sum(F.col(value) * F.col("_g")).over(inside), "_weight": F.sum("_g").over(inside)})
    old = F.lag("_block").over(w)
    fade = F.exp((old - F.col("_block")) * DECAY_BLOCK)
    rows = rows.withColumns({f"{c}_in": F.when(F.col("_block") != old, F.lag(c).over(w) * fade) for c in ("_sum", "_weight")})
    whole = lambda c: F.col(c) + F.coalesce(F.last(f"{c}_in", ignorenulls=True).over(so_far()), F.lit(0.0))
    return rows.withColumn(into, whole("_sum") / whole("_weight")).drop("_power", "_block", "_g", "_sum", "_weight", "_sum_in", "_weight_in")


def with_contrast_windows(colors: DataFrame, interval: float = 1 / 30, window_seconds: float = 1.0, half_life: float = 1 / 3, threshold: float = 2.3, stream_half_life: float | None = None) -> DataFrame:
    """Adds contrast_window: colour contrast over a sliding range of time, null where the range holds too few samples.

    Colour differences are to the previous sample; a window's differences are those within it. Weights halve every
    half_life, in blocks of time, see `sliding`; stream_weighted is the decayed mean over all differences so far, in closed form by blocks of time.
    """
    least = max(5, math.ceil(1 / interval))
    span = max(window_seconds, least * interval)
    rows = colors.withColumn("_lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    rows = rows.withColumn("_d", cie76(F.col("_lab"), F.lag("_lab").over(by_frame())))
    lam = math.log(2) / (stream_half_life or half_life)
    rows = with_decayed_mean(rows, "_d", lam, "_stream")
    rows = sliding.in_time_blocks(rows, {"d": F.col("_d")}, span, sliding.contrast_kernel(span, threshold, half_life, least), sliding.CONTRAST_FIELDS)
    made = F.struct(
        F.col("w_from").alias("start_time"), F.col("ts").alias("end_time"), (F.col("ts") - F.col("w_from")).alias("duration"), F.col("w_count").alias("sample_count"),
        half_up(F.least(F.lit(100.0), F.col("w_mean") / threshold * 100), 2).alias("sensitivity"), half_up(F.col("w_std"), 2).alias("fluctuations"), half_up(F.col("w_mean"), 2).alias("average_delta_e"),
        half_up(F.col("w_max"), 2).alias("max_delta_e"), F.col("w_hits").alias("significant_changes"), half_up(F.nanvl(F.col("w_weighted"), F.lit(None).cast("double")), 2).alias("weighted_average_delta_e"),
        half_up(F.col("_stream"), 2).alias("stream_weighted_average_delta_e"),
    )
    rows = rows.withColumn("contrast_window", F.when(F.col("w_count").isNotNull(), made))
    return rows.drop("_lab", "_d", "_stream", *sliding.CONTRAST_FIELDS)


def contrast_windows(colors: DataFrame, **options: float) -> DataFrame:
    """video_id, frame_idx and the fields of with_contrast_windows, where the range holds enough samples."""
    return with_contrast_windows(colors, **options).filter("contrast_window is not null").select("video_id", "frame_idx", "contrast_window.*")


def last_k(rows: DataFrame, k: int) -> DataFrame:
    """The last k rows of each video."""
    w = Window.partitionBy("video_id").orderBy(F.desc("frame_idx"))
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def history(column: str, k: int) -> Column:
    """The last k values up to this row, oldest first."""
    return F.collect_list(column).over(last_rows(k))
