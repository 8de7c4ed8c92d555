"""Queries over whole exports, settings as arguments, restarts within a video, and what runs beside a stream. Same tables and
rules as in `catalog`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photowarden import registry
from photowarden.catalog import FLAGGED, GAP, SCORE, SCORES, SIGNAL, SOBEL, THRESHOLD, W, WINDOWS, fixed_sql, flagged, frames, lin_sql, query, signal, table, with_
from photowarden.catalog_live import ORACLES, QUERIES
from photowarden.catalog_plans import _LIVE, LIMIT, analyzed, event_rows, of_frames, risk_sql
from photowarden.functions import scalar
from photowarden.operators import explore, flash, frame_metrics, risk, windows
from photowarden.params import Thresholds
from photowarden.plans import analysis
from photowarden.runtime import passing_folder
from photowarden.sources import importers, sinks, store
from photowarden.sources import frames as sources
from photowarden.streaming import live

__all__ = ["ORACLES", "QUERIES"]

# ---- exports by value ---------------------------------------------------------------------------------------------------

#: What the frames' pixels give for the columns of an export.
EXPORTED = SOBEL + f""", co AS (SELECT video_id, frame_idx, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(lum) AS brightness, avg(CASE WHEN lum > 0.5 THEN 1.0 ELSE 0.0 END) AS coverage, avg(r) / 255 AS red,
  avg(abs(r - g) / sqrt(2)) / 255 AS red_green, avg(abs(b - (r + g) / 2.0) / sqrt(6)) / 255 AS blue_yellow, stddev_pop(r) / 255 AS dr, stddev_pop(g) / 255 AS dg, stddev_pop(b) / 255 AS db FROM px GROUP BY 1, 2),
sh AS (SELECT video_id, frame_idx, greatest(0, least(255, floor(lum * 255 + 0.5))) AS shade, count(*) / 64.0 AS p FROM px GROUP BY 1, 2, 3), en AS (SELECT video_id, frame_idx, -sum(p * log2(p)) AS entropy FROM sh GROUP BY 1, 2),
ed AS (SELECT video_id, frame_idx, count_if(m * 255 > 50) AS edges FROM so GROUP BY 1, 2),
ex AS (SELECT *, coalesce(abs(brightness - lag(brightness) OVER {W}), 0.0) AS intensity, coalesce(abs(red - lag(red) OVER {W}), 0.0) AS red_delta FROM co JOIN en USING (video_id, frame_idx) JOIN ed USING (video_id, frame_idx))"""
#: Columns of the CSV contract, the SQL of their values and their decimals.
CSV_SQL = [
    ("Timestamp", "(frame_idx - 1) / 30.0", 6), ("Brightness", "brightness", 4), ("Intensity", "intensity", 4), ("Current R Variance", "dr", 4), ("Current G Variance", "dg", 4), ("Current B Variance", "db", 4),
    ("Frame Entropy", "entropy", 4), ("Red-Green Contrast", "red_green", 4), ("Blue-Yellow Contrast", "blue_yellow", 4), ("Edge Density", "edges / 36.0", 4), ("Edge Count", "edges", 0), ("Red Intensity", "red", 4), ("Red Delta", "red_delta", 4),
    ("Dominant Color R", "r", 1), ("Dominant Color G", "g", 1), ("Dominant Color B", "b", 1), ("PSI Coverage", "coverage", 4),
]


@query("csv_pixels", with_(EXPORTED, "SELECT " + ", ".join(f'{fixed_sql(x, p)} AS "{h}"' for h, x, p in CSV_SQL) + f""", (intensity > {LIMIT})::INTEGER::VARCHAR AS "Flash Detected" FROM ex"""))
def _csv_pixels(spark, d):
    """The CSV file of the analysed frames, read back as text: every column that one frame and the one before it decide."""
    path = passing_folder(spark, "export")
    sinks.write_csv(analyzed(spark, d), path, red=True, temporal_contrast=True)
    return spark.read.option("header", True).csv(path).select(*(h for h, _, _ in CSV_SQL), "Flash Detected")


def _event_entries(spark, d) -> DataFrame:
    return flagged(spark, d).select("video_id", "frame_idx", F.col("ts").alias("timestamp"), "brightness", "intensity", "is_flash")


_CSV_VALUE = lambda x, p: f"round({fixed_sql(x, p)}::DOUBLE, 6)"


@query("exported_values", with_(FLAGGED, f"""SELECT format, CASE WHEN format = 'csv' THEN {_CSV_VALUE('ts', 6)} ELSE round(ts, 6) END AS timestamp, CASE WHEN format = 'csv' THEN {_CSV_VALUE('brightness', 4)} ELSE round(brightness, 6) END AS brightness,
  CASE WHEN format = 'csv' THEN {_CSV_VALUE('intensity', 4)} ELSE round(intensity, 6) END AS intensity, is_flash FROM flagged, (VALUES ('csv'), ('json'), ('ndjson')) AS f(format) WHERE ts >= 0"""))
def _exported_values(spark, d):
    """All rows of the three formats of one export, each with its own reader."""
    path, rows = passing_folder(spark, "export"), _event_entries(spark, d)
    sinks.export_selected(rows, path, csv=True, json=True, ndjson=True)
    cells = spark.read.option("header", True).csv(f"{path}/csv")
    back = {
        "csv": cells.select(*(F.col(h).cast("double").alias(n) for n, h in (("timestamp", "Timestamp"), ("brightness", "Brightness"), ("intensity", "Intensity"))), (F.col("`Flash Detected`") == "1").alias("is_flash")),
        "json": importers.read_json_documents(spark, f"{path}/json", rows.schema), "ndjson": importers.read_ndjson(spark, f"{path}/ndjson", rows.schema),
    }
    return reduce(DataFrame.unionByName, (r.select(F.lit(f).alias("format"), "timestamp", "brightness", "intensity", "is_flash") for f, r in back.items()))


_RATED = with_(SCORES, f", r AS (SELECT video_id, {SCORE} AS score FROM q) SELECT video_id, avg(score) AS psi_avg, max(score) AS psi_max, min(score) AS psi_min FROM r WHERE score <> 0 GROUP BY 1")


@query("exported_summary", f"""SELECT video_id, duration, flash_count, risk_level, violation_count, dangerous_frame_percent, dangerous_time_percent, round(1 / 30.0, 6) AS analysis_interval, {GAP}::DOUBLE AS cluster_gap, 0.3::DOUBLE AS flash_intensity, 5::BIGINT AS flashes_per_second,
  round(coalesce(psi_avg, 0.0), 6) AS psi_avg, round(coalesce(psi_max, 0.0), 6) AS psi_max, round(coalesce(psi_min, 0.0), 6) AS psi_min FROM ({ORACLES['signal_summary']}) LEFT JOIN ({_RATED}) USING (video_id)""")
def _exported_summary(spark, d):
    """The short summary of an export, read back."""
    path = passing_folder(spark, "export")
    summary = analysis.short_summary(analysis.summarize(event_rows(spark, d), Thresholds(brightness_change=0.3, flashes_per_second=5)))
    sinks.export_selected(_event_entries(spark, d), path, csv=False, summary=summary)
    back = spark.read.schema(summary.schema).json(f"{path}/summary")
    return back.withColumn("flashes_per_second", F.col("flashes_per_second").cast("long"))


@query("last_analysis", with_(FLAGGED, "SELECT video_id, frame_idx, round(ts, 6) AS timestamp, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity, is_flash, true AS cleared FROM flagged"))
def _last_analysis(spark, d):
    """Rows kept as the last analysis, loaded again after another analysis took their place and they took its, and cleared."""
    name = f"last_{passing_folder(spark, 'last').rpartition('-')[2]}"
    rows = _event_entries(spark, d)
    importers.save_last(rows.limit(0), name)
    importers.save_last(rows, name)
    kept = store.materialized(importers.load_last(spark, name))
    importers.clear_last(spark, name)
    return kept.withColumn("cleared", F.lit(not spark.catalog.tableExists(name)))


@query("searched_fields", with_(EXPORTED, f""", sf AS (SELECT *, abs(edges / 36.0 - lag(edges / 36.0) OVER {W}) AS moved FROM ex), se AS (SELECT *, coalesce(moved, 0.0) AS change FROM sf)
SELECT frame_idx, unnest(['edge_detection.edge_density', 'edge_detection.edge_count', 'edge_detection.temporal_edge_change']) AS field, round(unnest([edges / 36.0, edges::DOUBLE, change]), 6) AS value FROM se"""))
def _searched_fields(spark, d):
    """The fields of the flat analysis whose names have a text in them, whatever its case, one row a field."""
    flat = explore.flatten_metrics(analyzed(spark, d))
    found = explore.search_fields(flat, "EDGE_De")
    return flat.unpivot([F.col("frame_idx").cast("long").alias("frame_idx")], [F.col(f"`{c}`") for c in found], "field", "value").withColumn("frame_idx", F.col("frame_idx").cast("int"))


# ---- settings -----------------------------------------------------------------------------------------------------------

LIMITS, GAPS = (0.05, 0.1, 0.2, 0.5), (0.05, 0.3, 2.0)


@query("threshold_setter", with_(SIGNAL, f", i AS (SELECT *, coalesce(abs(brightness - lag(brightness) OVER {W}), 0.0) AS intensity FROM sig) SELECT video_id, lim::DOUBLE AS brightness_change, count(*) AS frames, count_if(intensity > lim)::BIGINT AS flashes FROM i, (VALUES {', '.join(f'({x})' for x in LIMITS)}) AS t(lim) GROUP BY ALL"))
def _threshold_setter(spark, d):
    """Flashes of each video under several settings of the threshold."""
    rows = signal(spark, d)
    each = []
    for x in LIMITS:
        limit = Thresholds(brightness_change=x).brightness_change
        each.append(flash.with_flashes(rows, limit).groupBy("video_id").agg(F.lit(limit).alias("brightness_change"), F.count("*").alias("frames"), F.count_if("is_flash").alias("flashes")))
    return reduce(DataFrame.unionByName, each)


@query("gap_setter", with_(FLAGGED, f", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id, gap ORDER BY frame_idx) <= gap THEN 0 ELSE 1 END AS fresh FROM flagged, (VALUES {', '.join(f'({x})' for x in GAPS)}) AS t(gap) WHERE is_flash) SELECT video_id, gap::DOUBLE AS cluster_gap, sum(fresh)::BIGINT AS clusters, count(*) AS flashes FROM g GROUP BY ALL"))
def _gap_setter(spark, d):
    """Clusters of each video under several settings of the gap."""
    rows = flagged(spark, d)
    each = []
    for x in GAPS:
        gap = Thresholds(cluster_gap=x).cluster_gap
        each.append(flash.clusters(rows, gap).groupBy("video_id").agg(F.lit(gap).alias("cluster_gap"), F.count("*").alias("clusters"), F.sum("count").alias("flashes")))
    return reduce(DataFrame.unionByName, each)


@query("recommended_gaps", with_(SIGNAL, ", m AS (SELECT video_id, greatest(0.01, least(0.5, (max(ts) - min(ts)) / greatest(count(*) - 1, 1))) AS i FROM sig GROUP BY 1) SELECT video_id, round(i, 6) AS interval_s, floor(greatest(0.05, least(2.0, 3.5 * i)) * 100 + 0.5) / 100 AS gap FROM m"))
def _recommended_gaps(spark, d):
    """The recommended cluster gap for each video's mean interval, kept within the limits of the setting."""
    mean = (F.max("ts") - F.min("ts")) / F.greatest(F.count("*") - 1, F.lit(1))
    rows = signal(spark, d).groupBy("video_id").agg(F.greatest(F.lit(0.01), F.least(F.lit(0.5), mean)).alias("interval_s"))
    return rows.withColumn("gap", scalar.recommended_cluster_gap(F.col("interval_s")))


@query("percent_arguments", """SELECT event_id, CASE event_id % 6 WHEN 4 THEN 0.0 WHEN 5 THEN NULL WHEN 0 THEN round(floor(value) % 100, 6) ELSE least(100.0, CASE WHEN event_id % 6 = 1 AND floor(value) <= 1 THEN floor(value) * 100 ELSE floor(value) END) END AS percent FROM events""")
def _percent_arguments(spark, d):
    """Percentile arguments in their spellings: a share, a number, with a sign, with a p, below 0, and no number."""
    whole, kind = F.floor("value").cast("string"), F.col("event_id") % 6
    text = F.when(kind == 0, F.concat(F.lit("0."), F.lpad((F.floor("value") % 100).cast("string"), 2, "0"))).when(kind == 1, whole).when(kind == 2, F.concat(F.lit(" "), whole, F.lit("% "))).when(kind == 3, F.concat(F.lit("P"), whole))
    text = text.when(kind == 4, F.concat(F.lit("-"), whole)).otherwise("median")
    return table(spark, d, "events").select("event_id", scalar.percent_argument(text).alias("percent"))


@query("metric_labels", r"""WITH k AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', 'X') END || '2Part' AS key FROM part),
h AS (SELECT *, list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda a, c: (a * 31 + c) & 4294967295, 0::BIGINT) AS h FROM k)
SELECT p_partkey, key, array_to_string(list_transform(list_filter(string_split(regexp_replace(translate(key, '._', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  (CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END % 16)::INTEGER AS color FROM h""")
def _metric_labels(spark, d):
    """Labels and palette entries of dotted, underlined and camel-cased names."""
    glue = F.when(F.col("p_partkey") % 3 == 0, ".").when(F.col("p_partkey") % 3 == 1, "_").otherwise("X")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), glue), F.lit("2Part")).alias("key"))
    return rows.withColumns({"label": scalar.label(F.col("key")), "color": scalar.color_number(F.col("key"))})


@query("sql_functions", f"""WITH c AS (SELECT event_id, value, floor(value) % 256 AS r, floor(value * 3) % 256 AS g, floor(value * 7) % 256 AS b FROM events)
SELECT event_id, round(0.2126 * {lin_sql('r')} + 0.7152 * {lin_sql('g')} + 0.0722 * {lin_sql('b')}, 6) AS luminance, CASE WHEN value / 500 > 0.7 THEN 'high' WHEN value / 500 > 0.4 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN value / 500 > 0.7 THEN 1.0 WHEN value / 500 > 0.4 THEN 0.5 ELSE 0.0 END AS number FROM c""")
def _sql_functions(spark, d):
    """The library's functions under their names in SQL."""
    registry.register_sql(spark)
    return table(spark, d, "events").selectExpr(
        "event_id", "luminance(double(floor(value) % 256), double(floor(value * 3) % 256), double(floor(value * 7) % 256)) AS luminance",
        "psi_band(value / 500) AS band", "double(risk_number(psi_band(value / 500))) AS number",
    )


@query("registered_operators", with_(FLAGGED, "SELECT video_id, count(*) AS frames, count_if(is_flash)::BIGINT AS flashes, round(max(intensity), 6) AS most FROM flagged GROUP BY 1"))
def _registered_operators(spark, d):
    """Operators found by their names."""
    named = registry.METRICS
    rows = named["flash.with_flashes"](named["frames.signal_from_events"](table(spark, d, "events")), THRESHOLD)
    return rows.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if("is_flash").alias("flashes"), F.max("intensity").alias("most"))


# ---- several files, and restarts ----------------------------------------------------------------------------------------


@query("playlist", of_frames(with_(FLAGGED, "SELECT video_id::VARCHAR AS video_id, frame_idx, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity, is_flash FROM flagged")))
def _playlist(spark, d):
    """Frames in several files a video, read by a pattern: each video begins anew."""
    path = passing_folder(spark, "playlist")
    rows = frames(spark, d).withColumn("video_id", F.col("video_id").cast("string"))
    rows.withColumn("part", F.concat_ws("-", F.lit("film"), F.pmod(F.xxhash64("video_id"), F.lit(3)), F.pmod("frame_idx", F.lit(2)))).write.partitionBy("part").parquet(path)
    read = sources.read_frames(spark, f"{path}/part=film-*")
    return flash.with_flashes(frame_metrics.frame_metrics(read, ["brightness"]), LIMIT).select("video_id", "frame_idx", "brightness", "intensity", "is_flash")


#: Seconds without a frame after which the states begin anew.
PAUSE = 0.5
RESTARTED = f"""{SIGNAL.replace('sig AS', 'sg AS')}, nw AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts, frame_idx) > {PAUSE} THEN 1 ELSE 0 END AS fresh FROM sg), pt AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY ts, frame_idx) AS part FROM nw),
sig AS (SELECT video_id::VARCHAR || '#' || part::BIGINT AS video_id, (row_number() OVER (PARTITION BY video_id, part ORDER BY frame_idx))::INTEGER AS frame_idx, ts, brightness, video_id::VARCHAR AS of_video, part::BIGINT AS segment FROM pt)"""


def _restarted(spark, d) -> DataFrame:
    rows = sources.sessions(signal(spark, d), PAUSE)
    return windows.restarted(rows, F.col("session")).drop("session")


@query("restarted_violations", with_(WINDOWS.replace(SIGNAL, RESTARTED), "SELECT video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_frame, end_frame, flash_count::BIGINT AS flash_count, incomplete FROM violations"))
def _restarted_violations(spark, d):
    """Windows whose state begins anew after a pause: the first frame is no flash, and no window spans the pause."""
    rows = flash.violations(flash.with_flashes(_restarted(spark, d), THRESHOLD))
    return rows.select("video_id", "start_time", "end_time", "start_frame", "end_frame", F.col("flash_count").cast("long").alias("flash_count"), "incomplete")


_RANKS = "['low', 'medium', 'high']"


@query("restarted_risk", with_(FLAGGED.replace(SIGNAL, RESTARTED) + ", rows_ AS (SELECT * FROM flagged)" + risk_sql(_LIVE), f"""SELECT of_video, segment, frame_idx, mf::BIGINT AS max_flashes, round(debt, 6) AS risk_debt, {_RANKS}[max(rank) OVER {W} + 1] AS risk_level,
  {_RANKS}[max(rank) OVER (PARTITION BY of_video ORDER BY segment, frame_idx) + 1] AS level_carried FROM le"""))
def _restarted_risk(spark, d):
    """Levels that begin anew after a pause, as between videos, and such that a restart leaves alone, as live."""
    b, k = F.col("brightness"), F.col("frame_idx")
    inputs = {"psi_score": 0.75 * b, "coverage": 0.2 * b * b, "red": 0.7 * b, "chroma_rg": (k % 11) / 13.0, "chroma_by": (k % 7) / 9.0, "flicker_hz": (k % 40).cast("double"), "pattern": (k % 13) / 15.5}
    rows = risk.risk_levels(risk.with_flash_peaks(flash.with_flashes(_restarted(spark, d), THRESHOLD).withColumns(inputs)))
    rows = rows.withColumn("level_carried", windows.levels_carried(["low", "medium", "high"]))
    return rows.select("of_video", "segment", "frame_idx", F.col("max_flashes").cast("long").alias("max_flashes"), "risk_debt", "risk_level", "level_carried")


# ---- beside a stream ----------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = passing_folder(spark, "beside")
    rows = _event_entries(spark, d)
    rows.repartition(4, "video_id").write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


@query("live_alerts", with_(FLAGGED, "SELECT video_id, frame_idx, round(ts, 6) AS timestamp, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity FROM flagged WHERE is_flash"))
def _live_alerts(spark, d):
    """The flashes of every micro-batch, handed to a function that keeps them."""
    stream, path = _streamed(spark, d)
    run = stream.writeStream.foreachBatch(sinks.flash_alerts(sinks.append_sink(f"{path}/alerts"))).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/alerts").select("video_id", "frame_idx", "timestamp", "brightness", "intensity")


@query("live_status", with_(FLAGGED, "SELECT false AS active, count(*) AS rows_seen, count_if(is_flash)::BIGINT AS flashes FROM flagged"))
def _live_status(spark, d):
    """What a stream's status tells once it has ended, and the rows that its batches said they had."""
    stream, path = _streamed(spark, d)
    run = stream.writeStream.foreachBatch(sinks.append_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    seen = sum(p["numInputRows"] for p in run.recentProgress)
    kept = spark.read.parquet(f"{path}/out").agg(F.count_if("is_flash").alias("flashes"))
    return kept.select(F.lit(live.status(run)["active"]).alias("active"), F.lit(seen).cast("long").alias("rows_seen"), "flashes")
