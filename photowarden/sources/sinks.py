"""Export: CSV, NDJSON and JSON documents, chart projections, summaries and reports; foreachBatch sinks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photowarden.functions.scalar import magnitude, to_fixed
from photowarden.operators.explore import flatten_metrics
from photowarden.sources.store import materialized

# The CSV contract. Header, flat source column, decimals (None: a whole number).
CSV_BASE: list[tuple[str, str, int | None]] = [
    ("Timestamp", "timestamp", 6), ("Brightness", "brightness", 4), ("Flash Detected", "is_flash", None), ("Intensity", "intensity", 4),
    ("Current R Variance", "color_variance.current.r", 4), ("Current G Variance", "color_variance.current.g", 4), ("Current B Variance", "color_variance.current.b", 4),
    ("Temporal R Variance", "color_variance.temporal.r", 4), ("Temporal G Variance", "color_variance.temporal.g", 4), ("Temporal B Variance", "color_variance.temporal.b", 4),
    ("R Change Rate", "color_variance.average_change.r", 4), ("G Change Rate", "color_variance.average_change.g", 4), ("B Change Rate", "color_variance.average_change.b", 4),
    ("Color Spikes Count", "color_variance.spikes", None), ("Temporal Change", "temporal_change", 4), ("Flicker Frequency (Hz)", "flicker_frequency", 2), ("Frame Entropy", "entropy", 4),
    ("PSI Score", "psi.score", 4), ("PSI Frequency", "psi.components.frequency", 4), ("PSI Intensity", "psi.components.intensity", 4), ("PSI Coverage", "psi.components.coverage", 4), ("PSI Duration", "psi.components.duration", 4),
    ("Center Flash Intensity", "spatial_map.center", 4), ("Peripheral Flash Intensity", "spatial_map.periphery", 4), ("Red-Green Contrast", "chromatic_flashes.red_green", 4), ("Blue-Yellow Contrast", "chromatic_flashes.blue_yellow", 4),
    ("Temporal Contrast Rate", "temporal_contrast.current_rate", 4), ("Frame Difference", "frame_difference.difference", 4), ("Motion Ratio", "frame_difference.motion", 4),
    ("Dominant Frequency (Hz)", "spectral_analysis.dominant_frequency", 2), ("Dominant Inst. Frequency (Hz)", "spectral_analysis.dominant_inst_freq", 2), ("Spectral Flatness", "spectral_flatness", 4),
    ("Spectral Confidence", "spectral_analysis.confidence", 4), ("Temporal Coherence", "temporal_coherence.coherence_score", 4), ("Edge Density", "edge_detection.edge_density", 4), ("Edge Count", "edge_detection.edge_count", None),
    ("Edge Change Rate", "edge_detection.temporal_edge_change", 4), ("Red Intensity", "red_intensity", 4), ("Red Delta", "red_delta", 4),
    ("Dominant Color R", "dominant_color.r", 1), ("Dominant Color G", "dominant_color.g", 1), ("Dominant Color B", "dominant_color.b", 1), ("Dominant Lab L", "dominant_lab.L", 2), ("Dominant Lab a", "dominant_lab.a", 2), ("Dominant Lab b", "dominant_lab.b", 2),
    ("CIE76 Delta", "cie76_delta", 4), ("Patterned Stimulus Score", "patterned_stimulus_score", 4), ("Scene Change Score", "scene_change_score", 4), ("Color Change Magnitude", "color_change_magnitude", 4),
    ("Contrast Sensitivity", "contrast_sensitivity.sensitivity", 4), ("Contrast Fluctuations", "contrast_sensitivity.fluctuations", 4), ("Contrast Avg DeltaE", "contrast_sensitivity.average_delta_e", 4), ("Contrast Max DeltaE", "contrast_sensitivity.max_delta_e", 4),
    ("Contrast Significant Changes", "contrast_sensitivity.significant_changes", None), ("Contrast Total Samples", "contrast_sensitivity.total_samples", None), ("Contrast Fluctuation Rate", "contrast_sensitivity.fluctuation_rate", 4),
    ("Contrast Weighted Avg DeltaE", "contrast_sensitivity.weighted_average_delta_e", 4), ("Contrast Window Size", "contrast_sensitivity.window_size", None), ("Contrast Weight Decay", "contrast_sensitivity.weight_decay", 6),
    ("Contrast Coefficient of Variation", "contrast_sensitivity.coefficient_of_variation", 4), ("Contrast Median DeltaE", "contrast_sensitivity.median_delta_e", 4), ("Contrast 90th Percentile DeltaE", "contrast_sensitivity.p90_delta_e", 4),
    ("Contrast 95th Percentile DeltaE", "contrast_sensitivity.p95_delta_e", 4),
]
CSV_TEMPORAL: list[tuple[str, str, int | None]] = [
    ("Temporal Window Duration", "temporal_contrast_sensitivity.duration", 2), ("Temporal Window Sample Count", "temporal_contrast_sensitivity.sample_count", None), ("Temporal Window Sensitivity", "temporal_contrast_sensitivity.sensitivity", 4),
    ("Temporal Window Fluctuations", "temporal_contrast_sensitivity.fluctuations", 4), ("Temporal Window Avg DeltaE", "temporal_contrast_sensitivity.average_delta_e", 4), ("Temporal Window Max DeltaE", "temporal_contrast_sensitivity.max_delta_e", 4),
    ("Temporal Window Significant Changes", "temporal_contrast_sensitivity.significant_changes", None), ("Temporal Stream Weighted Avg DeltaE", "temporal_contrast_sensitivity.stream_weighted_average_delta_e", 4),
]
CSV_RED: list[tuple[str, str, int | None]] = [
    ("Red Area Avg", "red_metrics.red_area_avg", 4), ("Red Area Max", "red_metrics.red_area_max", 4), ("Red On Fraction", "red_metrics.red_on_fraction", 4), ("Red Transitions", "red_metrics.red_transitions", None),
    ("Red Flash Events", "red_metrics.red_flash_events", None), ("Red Flash Per Second", "red_metrics.red_flash_per_second", 4), ("Red Flicker In Risk Band", "red_metrics.red_flicker_in_risk_band", None), ("Red State", "red_state", None),
]


def csv_columns(red: bool = False, temporal_contrast: bool = False) -> list[tuple[str, str, int | None]]:
    return CSV_BASE + CSV_TEMPORAL * temporal_contrast + CSV_RED * red


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with a time of 0 or later."""
    return rows.filter("timestamp >= 0")


def csv_rows(rows: DataFrame, red: bool = False, temporal_contrast: bool = False) -> DataFrame:
    """The CSV contract's columns as text, in order of time; what a row doesn't have is 0."""
    if "color_change_magnitude" not in rows.columns and "color_variance" in rows.columns:
        change = F.col("color_variance.average_change")
        rows = rows.withColumn("color_change_magnitude", magnitude(change["r"], change["g"], change["b"]))
    flat = flatten_metrics(valid_rows(rows))
    have = set(flat.columns)

    def cell(source: str, places: int | None) -> Column:
        x = F.col(f"`{source}`") if source in have else F.lit(0.0)
        return to_fixed(x, places) if places is not None else F.coalesce(x, F.lit(0.0)).cast("long").cast("string")

    return flat.orderBy("timestamp").select(*(cell(s, p).alias(h) for h, s, p in csv_columns(red, temporal_contrast)))


def write_csv(rows: DataFrame, path: str, single_file: bool = False, stored: bool = False, **flags: bool) -> None:
    """Rows are computed once, then sorted: a sort over all partitions reads what it sorts twice. stored: they are a table."""
    wanted = {source.split(".")[0] for _, source, _ in csv_columns(**flags)}
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.split(".")[0] in wanted))
    out = csv_rows(rows if stored else materialized(rows), **flags)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def ndjson_lines(rows: DataFrame, key: str = "timestamp") -> DataFrame:
    """value: one nested JSON object a line, in order of time."""
    return valid_rows(rows).orderBy(key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(rows: DataFrame, path: str, single_file: bool = False, stored: bool = False) -> None:
    """As `write_csv`, with all columns."""
    out = ndjson_lines(rows if stored else materialized(valid_rows(rows)))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def json_documents(rows: DataFrame, by: str = "video_id") -> DataFrame:
    """One document a video: metadata and the analysis rows in order of time. A video's rows make one string."""
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != by))
    grouped = valid_rows(rows).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("timestamp").alias("_k"), own.alias("_v")))).alias("a"), F.count("*").alias("total_frames"), F.max("timestamp").alias("duration"))
    meta = F.struct(F.col("total_frames"), F.col("duration"))
    return grouped.select(by, F.to_json(F.struct(meta.alias("metadata"), F.transform("a", lambda x: x["_v"]).alias("analysis")), {"pretty": "true"}).alias("document"))


def write_json(rows: DataFrame, path: str, by: str = "video_id") -> None:
    json_documents(rows, by).select("document").write.mode("overwrite").text(path)


def json_arrays(rows: DataFrame) -> DataFrame:
    """value: lines of JSON arrays of the rows, one array a partition, and so a file; no partition is held in memory."""

    def run(batches):
        some = False
        for batch in batches:
            lines = [("," if some or k else "[") + r for k, r in enumerate(batch.column(0).to_pylist())]
            some = some or bool(lines)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], ["value"])

    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string")


def export_charts(rows: DataFrame, charts: list[tuple[str, list[str]]], path: str, formats: tuple[str, ...] = ("csv",)) -> DataFrame:
    """All rows of the distinct x and y columns of the charts, in the asked formats; missing is empty in CSV."""
    out = rows.select(*dict.fromkeys(c for x, ys in charts for c in (x, *ys)))
    for f in formats:
        target = f"{path}/{f}"
        if f == "csv":
            out.write.mode("overwrite").option("header", True).option("nullValue", "").csv(target)
        elif f == "ndjson":
            out.write.mode("overwrite").option("ignoreNullFields", "false").json(target)
        elif f == "json":
            json_arrays(out).write.mode("overwrite").text(target)
        else:
            raise ValueError(f"unknown format {f}")
    return out


def export_selected(rows: DataFrame, path: str, csv: bool = True, json: bool = False, ndjson: bool = False, summary: DataFrame | None = None, **flags: bool) -> list[str]:
    """Writes each selected format and, if given, the summary; returns the paths. Rows are computed once for all formats."""
    done, stored = [], csv + json + ndjson > 1
    if stored:
        rows = materialized(valid_rows(rows))
    for on, name, write in ((csv, "csv", lambda p: write_csv(rows, p, stored=stored, **flags)), (json, "json", lambda p: write_json(rows, p)), (ndjson, "ndjson", lambda p: write_ndjson(rows, p, stored=stored))):
        if on:
            write(f"{path}/{name}")
            done.append(f"{path}/{name}")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{path}/summary")
        done.append(f"{path}/summary")
    return done


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps every micro-batch as Parquet under its number: one that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def flash_alerts(send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on the flashes of every micro-batch."""
    return lambda batch, number: send(batch.filter("is_flash"), number)
