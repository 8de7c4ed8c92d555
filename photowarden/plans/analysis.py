"""The whole analysis of frames as one declarative plan: a wide nested row a frame, and summaries of videos.

The pixels are read once, exchanged once (the frame difference needs the previous raster of a video) and met in one
Arrow pass; all temporal metrics are windows over that one order, so nothing is joined.

A summary reads the rows several times: summarise a written analysis, or rows cut by `sources.store.materialized`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.functions.color import rgb_to_lab
from photowarden.functions.scalar import base_file_name, magnitude, to_fixed
from photowarden.operators import flash, frame_metrics, risk, spectral, temporal
from photowarden.operators.windows import by_frame, so_far
from photowarden.params import Flags, Sampling, Thresholds
from photowarden.sources.store import materialized

PIXEL_METRICS = ["brightness", "coverage", "red_intensity", "dominant_color", "entropy", "chromatic", "color_deviation", "spatial", "edges", "pattern", "pixel_contrast"]
KEYS = ["video_id", "frame_idx"]


def analyze(frames: DataFrame, thresholds: Thresholds | None = None, flags: Flags | None = None, sampling: Sampling | None = None, spectral_fps: float = 60.0) -> DataFrame:
    """One row a frame: video_id, frame_idx and the nested metrics. Flags decide which optional groups are planned."""
    thresholds, flags, sampling = thresholds or Thresholds(), flags or Flags(), sampling or Sampling()
    rows = frame_metrics.frame_metrics(frames, PIXEL_METRICS, with_difference=True, with_scene_change=True)
    start = F.min("ts").over(so_far())
    rows = rows.withColumn("relative_timestamp", F.col("ts") - start)
    rows = flash.temporal_change(flash.with_flashes(rows, thresholds.brightness_change))
    rows = temporal.flicker_frequency(rows, thresholds.brightness_change)
    rows = temporal.temporal_contrast(rows, compat=flags.compat)
    rows = temporal.coherence(rows)
    rows = risk.with_psi(rows, F.col("coverage"), compat=flags.compat)
    rows = rows.withColumns({"r": F.col("dominant_color.r"), "g": F.col("dominant_color.g"), "b": F.col("dominant_color.b"), "edge_density": F.col("edges.density")})
    rows = temporal.edge_change(rows).withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    rows = rows.withColumns({"cie76_delta": temporal.delta_e(), "red_delta_frame": temporal.delta("red_intensity")})
    for c in "rgb":
        rows = rows.withColumn(f"mean_{c}", F.col(f"color_deviation.mean_{c}"))
    rows = temporal.color_spikes(temporal.color_history(rows))
    rows = spectral.spectra(rows, spectral_fps)
    inputs = {
        "psi_score": F.col("psi.score"), "red": F.col("red_intensity"), "chroma_rg": F.col("chromatic.red_green"), "chroma_by": F.col("chromatic.blue_yellow"), "flicker_hz": F.col("dominant_frequency"),
    }
    if flags.compat:
        inputs |= {"chroma_rg": F.lit(0.0), "chroma_by": F.lit(0.0), "flicker_hz": F.lit(0.0)}
    rows = risk.risk_levels(risk.with_flash_peaks(rows.withColumns(inputs)))
    if flags.red:
        rows = temporal.red_window(temporal.red_states(rows))
    if flags.temporal_contrast:
        rows = temporal.with_contrast_windows(rows, sampling.interval)
    n = F.row_number().over(by_frame())
    return rows.select(
        *KEYS, F.col("ts").alias("timestamp"), "relative_timestamp", "brightness", "is_flash", "intensity",
        F.struct(
            F.struct("color_deviation.r", "color_deviation.g", "color_deviation.b").alias("current"), _channels("variance").alias("temporal"), F.col("spikes"), _channels("change").alias("average_change")
        ).alias("color_variance"),
        "temporal_change", "flicker_frequency", "entropy", "psi",
        F.struct("spatial.center", "spatial.periphery", F.array("spatial.q0", "spatial.q1", "spatial.q2", "spatial.q3").alias("quadrants")).alias("spatial_map"),
        F.col("chromatic").alias("chromatic_flashes"), F.struct("current_rate", "max_rate").alias("temporal_contrast"), F.struct("difference", "motion").alias("frame_difference"),
        F.struct("dominant_frequency", "dominant_inst_freq", "window_size", "spectral_flatness", "confidence", "bin_resolution", "amplitude", "phase").alias("spectral_analysis"),
        F.struct("coherence_score", "lags").alias("temporal_coherence"),
        F.struct("edge_density", F.col("edges.count").cast("long").alias("edge_count"), F.col("edge_change").alias("temporal_edge_change")).alias("edge_detection"),
        "red_intensity", F.col("red_delta_frame").alias("red_delta"), "dominant_color", F.col("lab").alias("dominant_lab"), "cie76_delta", F.col("pattern").alias("patterned_stimulus_score"),
        F.col("scene_change").alias("scene_change_score"), "spectral_flatness", magnitude(F.col("change_r"), F.col("change_g"), F.col("change_b")).alias("color_change_magnitude"), F.col("pixel_contrast").alias("contrast_sensitivity"),
        *([F.col("red_metrics"), F.col("red_on").alias("red_state"), F.col("red_transition")] if flags.red else []),
        *([F.col("contrast_window").alias("temporal_contrast_sensitivity")] if flags.temporal_contrast else []),
        F.col("flashes").alias("flash_count"), "risk_level", "risk_debt", n.cast("long").alias("frames_analyzed"),
        F.floor(n / F.greatest(F.lit(0.001), F.col("relative_timestamp")) + 0.5).alias("fps"), F.col("flashes").alias("sequence_length"),
    )


def _channels(prefix: str):
    return F.struct(*(F.col(f"{prefix}_{c}").alias(c) for c in "rgb"))


def summarize(rows: DataFrame, thresholds: Thresholds | None = None, sampling: Sampling | None = None, names: DataFrame | None = None) -> DataFrame:
    """One row a video: totals, violations, clusters, severity and thresholds. names: video_id, name (optional)."""
    thresholds, sampling = thresholds or Thresholds(), sampling or Sampling()
    rows = materialized(rows.select(*KEYS, "relative_timestamp", "brightness", "intensity", "is_flash", "risk_level", F.struct("psi.score").alias("psi")))
    flagged = rows.select(*KEYS, F.col("relative_timestamp").alias("ts"), "brightness", "intensity", "is_flash")
    base = rows.groupBy("video_id").agg(
        F.max("relative_timestamp").alias("duration"), F.count_if("is_flash").alias("flash_count"), F.max_by("risk_level", "frame_idx").alias("risk_level"), F.count("*").alias("frames")
    )
    scores = risk.psi_statistics(rows.select("video_id", F.col("psi.score").alias("score")))
    found = flash.clusters(flagged, thresholds.cluster_gap)
    out = base.join(flash.violation_statistics(flagged), "video_id").join(flash.cluster_statistics(found).drop("flashes"), "video_id", "left").join(scores, "video_id", "left")
    zeros = [c for c, k in out.dtypes if k in ("double", "bigint", "int") and c != "video_id"]
    out = out.fillna(0, zeros).withColumns({"analysis_interval": F.lit(sampling.interval), "analysis_fps": to_fixed(F.lit(1 / sampling.interval), 2).cast("double"), "cluster_gap": F.lit(thresholds.cluster_gap), "flash_intensity": F.lit(thresholds.brightness_change), "flashes_per_second": F.lit(thresholds.flashes_per_second)})
    if names is not None:
        out = out.join(names, "video_id", "left").withColumn("file_name", F.coalesce(base_file_name(F.col("name")), F.lit("unknown"))).drop("name")
    return out


def short_summary(summary: DataFrame) -> DataFrame:
    """Totals, violations, severity (of the scores other than zero) and thresholds of each video."""
    return summary.select(
        "video_id", "duration", "flash_count", "risk_level", "violation_count", "dangerous_frame_percent", "dangerous_time_percent", "psi_avg", "psi_max", "psi_min",
        "analysis_interval", "cluster_gap", "flash_intensity", "flashes_per_second",
    )


def cluster_report(rows: DataFrame, gap: float = 0.3) -> DataFrame:
    """Per video: formatted cluster statistics and the list of clusters; videos without flashes have no row."""
    flagged = materialized(rows.select(*KEYS, F.col("relative_timestamp").alias("ts"), "is_flash"))
    found = flash.clusters(flagged, gap)
    item = F.struct("cluster_id", to_fixed(F.col("start_time"), 3).alias("start_time"), to_fixed(F.col("end_time"), 3).alias("end_time"), to_fixed(F.col("end_time") - F.col("start_time"), 3).alias("duration"), "start_frame", "end_frame", "count")
    listed = found.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("clusters"))
    return flash.cluster_statistics(found).join(listed, "video_id").withColumns({c: to_fixed(F.col(c), 2) for c in ("avg_size", "median_size", "density")})


def report(rows: DataFrame) -> DataFrame:
    """Per video: totals, mean flash rate (at 60 frames a second), risk factors and recommendations."""
    rows = materialized(rows.select(*KEYS, "relative_timestamp", "intensity", "is_flash", "risk_level"))
    flagged = rows.select(*KEYS, "intensity", "is_flash")
    counts = risk.recommendations(risk.risk_factors(flash.flash_counts(flagged)))
    ends = rows.groupBy("video_id").agg(F.max("relative_timestamp").alias("duration"), F.max_by("risk_level", "frame_idx").alias("risk_level"))
    rate = F.col("flash_count") / (F.col("frame_count") / 60.0)
    return counts.join(ends, "video_id").withColumns({"average_flash_rate": rate, "frame_rate": F.col("frame_count") / F.when(F.col("duration") > 0, F.col("duration")).otherwise(1.0)})
