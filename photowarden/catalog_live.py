"""Queries over video files and streams: frames through uncompressed video, live sources that stop and start again, frames out
of order, and risk levels that go on from a batch. Same tables and rules as in `catalog`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photowarden.catalog import GAP, PIXELS, SIGNAL, W, WINDOWS, FLAGGED, flagged, frames, query, with_
from photowarden.catalog_plans import _LIVE, ORACLES, QUERIES, risk_sql
from photowarden.operators import frame_metrics, risk
from photowarden.runtime import passing_folder
from photowarden.sources import sinks, video
from photowarden.sources.store import materialized
from photowarden.streaming import live, ordered

__all__ = ["ORACLES", "QUERIES"]

# ---- video files --------------------------------------------------------------------------------------------------------

#: Pixels after a file of 4:2:0 samples of the full range: luma by pixel, chroma by block of 2x2, in whole numbers.
FILMED = PIXELS + """, yy AS (
  SELECT *, (299000 * r + 587000 * g + 114000 * b + 500000) // 1000000 AS luma FROM px
), uv AS (
  SELECT video_id, frame_idx, x // 2 AS cx, y // 2 AS cy, (sum(-168736 * r - 331264 * g + 500000 * b + 128000000)::BIGINT + 2000000) // 4000000 - 128 AS u,
    (sum(500000 * r - 418688 * g - 81312 * b + 128000000)::BIGINT + 2000000) // 4000000 - 128 AS v FROM px GROUP BY ALL
), film AS (
  SELECT p.video_id, p.frame_idx, p.pos, p.x, p.y, greatest(0, least(255, floor((luma * 1000000 + 1402000 * v + 500000) / 1000000.0)))::INTEGER AS r,
    greatest(0, least(255, floor((luma * 1000000 - 344136 * u - 714136 * v + 500000) / 1000000.0)))::INTEGER AS g, greatest(0, least(255, floor((luma * 1000000 + 1772000 * u + 500000) / 1000000.0)))::INTEGER AS b
  FROM yy p JOIN uv c ON p.video_id = c.video_id AND p.frame_idx = c.frame_idx AND p.x // 2 = cx AND p.y // 2 = cy
)"""
#: Bytes of a partition: a file of these small frames is several.
FEW_BYTES = 2000


def _films(spark: SparkSession, d: str) -> str:
    path = passing_folder(spark, "films")
    video.write_y4m(frames(spark, d), path)
    return path


@query("y4m_frames", with_(FILMED, "SELECT video_id::VARCHAR AS video_id, frame_idx, round((frame_idx - 1) / 30.0, 6) AS ts, pos, r, g, b, 255 AS a FROM film"))
def _y4m_frames(spark, d):
    """Every pixel of frames written to video files and read back in ranges of frames."""
    back = video.read_y4m(spark, _films(spark, d), partition_bytes=FEW_BYTES)
    px = frame_metrics.pixels(back).select("video_id", "frame_idx", "pos", "r", "g", "b", "a")
    return px.join(back.select("video_id", "frame_idx", "ts"), ["video_id", "frame_idx"])


@query("y4m_sampled", with_(FILMED, """SELECT video_id::VARCHAR AS video_id, frame_idx, (x // 2 + y // 2 * 4)::INTEGER AS pos,
  floor(avg(r) + 0.5)::INTEGER AS r, floor(avg(g) + 0.5)::INTEGER AS g, floor(avg(b) + 0.5)::INTEGER AS b FROM film GROUP BY ALL"""))
def _y4m_sampled(spark, d):
    """Frames read at half their width and height."""
    back = video.read_y4m(spark, _films(spark, d), sample=2, partition_bytes=FEW_BYTES)
    return frame_metrics.pixels(back).select("video_id", "frame_idx", "pos", "r", "g", "b")


# ---- live sources -------------------------------------------------------------------------------------------------------

#: The signal of the films, and a limit that its small changes pass.
FILM_SIGNAL = FILMED + """, lf AS (
  SELECT *, CASE WHEN r / 255.0 > 0.04045 THEN pow((r / 255.0 + 0.055) / 1.055, 2.4) ELSE r / 255.0 / 12.92 END AS lr, CASE WHEN g / 255.0 > 0.04045 THEN pow((g / 255.0 + 0.055) / 1.055, 2.4) ELSE g / 255.0 / 12.92 END AS lg,
    CASE WHEN b / 255.0 > 0.04045 THEN pow((b / 255.0 + 0.055) / 1.055, 2.4) ELSE b / 255.0 / 12.92 END AS lb FROM film
), sig AS (SELECT video_id, frame_idx, (frame_idx - 1) / 30.0 AS ts, avg(0.2126 * lr + 0.7152 * lg + 0.0722 * lb) AS brightness FROM lf GROUP BY 1, 2)"""
FILM_LIMIT = 0.02


def _film_sql(sql: str) -> str:
    return sql.replace(SIGNAL, FILM_SIGNAL).replace("> 0.1 AS is_flash", f"> {FILM_LIMIT} AS is_flash")


def _first_half(spark: SparkSession, path: str, part: str) -> None:
    """A film folder in which every file ends in the middle, as while it is being written."""
    fs, inside = video._file_system(path)
    fs.create_dir(f"{inside}/{part}")
    for name, size in video.list_files(path):
        with fs.open_input_file(name) as f, fs.open_output_stream(f"{inside}/{part}/{name.rpartition('/')[2]}") as out:
            out.write(f.read(size // 2))


def _rest(path: str, part: str) -> None:
    fs, inside = video._file_system(path)
    for name, _ in video.list_files(path):
        fs.copy_file(name, f"{inside}/{part}/{name.rpartition('/')[2]}")


@query("live_source", _film_sql(with_(WINDOWS, "SELECT video_id::VARCHAR AS video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame, flash_count::BIGINT AS flash_count FROM closed WHERE flash_count > 3")))
def _live_source(spark, d):
    """Violations from video files that grow while they are read, by a query that stops half way and starts again."""
    path = _films(spark, d)
    _first_half(spark, path, "live")
    for again in (False, True):
        if again:
            _rest(path, "live")
        stream = frame_metrics.frame_metrics(video.stream_y4m(spark, f"{path}/live"), ["brightness"])
        signal = live.with_event_time(stream.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ts", "brightness"))
        found = live.flash_events(signal, FILM_LIMIT, GAP)
        run = found.writeStream.foreachBatch(sinks.append_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{path}/out").filter("kind = 'violation' and not incomplete").select("video_id", "start_time", "end_time", "start_frame", "end_frame", "flash_count")


# ---- frames out of order ------------------------------------------------------------------------------------------------

#: Seconds that frames may come after later ones, in the queries below.
DELAY = 2.0
_BOUND = f"ts <= (SELECT max(ts) FROM sig s WHERE s.video_id = {{t}}.video_id) - {DELAY}"


#: Rows of a file of a micro-batch, at least; videos of a bucket of state, about.
FILE_ROWS, BUCKET_VIDEOS = 250_000, 500


def _buckets(rows: DataFrame) -> int:
    """Buckets that the rows' videos are dealt to: a call and its state have a bounded number of videos."""
    return max(live.BUCKETS, rows.select("video_id").distinct().count() // BUCKET_VIDEOS)


def _shuffled(spark: SparkSession, rows: DataFrame, batches: int = 10) -> DataFrame:
    """A stream of the rows in so many micro-batches, in which about half of the frames come a batch later than their time
    asks for, and no batch is in order."""
    path, rows = passing_folder(spark, "shuffled"), materialized(rows)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    slot = F.least(F.floor((F.col("ts") - first) * (batches - 1) / (last - first)), F.lit(batches - 2)) + F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(2))
    kept = rows.withColumn("_slot", slot.cast("int"))
    sizes = [n for _, n in kept.groupBy("_slot").count().collect()]
    files = max(1, min(sizes) // FILE_ROWS) if len(sizes) == batches else 1
    kept.repartition(batches * files, "_slot", F.pmod(F.xxhash64("video_id"), F.lit(files))).write.partitionBy("_slot").parquet(f"{path}-slots")
    for k in range(batches):  # so many files a batch, the oldest first; none is empty, as rows are dealt in turn
        one = spark.read.schema(kept.schema).parquet(f"{path}-slots").filter(F.col("_slot") == k).drop("_slot")
        (one.coalesce(1) if files == 1 else one.repartition(files)).sortWithinPartitions(F.xxhash64("frame_idx", "video_id")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return live.with_event_time(stream, "1 day")


def _collected(spark: SparkSession, found: DataFrame) -> DataFrame:
    path = passing_folder(spark, "out")
    with ordered.state_store(spark):
        run = found.writeStream.foreachBatch(sinks.append_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _narrow(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "ts", "brightness", *more)


@query("live_ordered", with_(WINDOWS, f"SELECT video_id::VARCHAR AS video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame, flash_count::BIGINT AS flash_count FROM closed c WHERE flash_count > 3 AND EXISTS (SELECT 1 FROM sig f WHERE f.video_id = c.video_id AND f.frame_idx = c.end_frame + 1 AND f.{_BOUND.format(t='f')})"))
def _live_ordered(spark, d):
    """Closed windows of frames in ten shuffled micro-batches."""
    rows = _narrow(flagged(spark, d))
    found = ordered.flash_events_in_order(_shuffled(spark, rows), DELAY, 0.1, GAP, buckets=_buckets(rows))
    return _collected(spark, found).filter("kind = 'violation' and not incomplete").select("video_id", "start_time", "end_time", "start_frame", "end_frame", "flash_count")


def _with_inputs(rows: DataFrame) -> DataFrame:
    b, k = F.col("brightness"), F.col("frame_idx")
    return rows.withColumns({"psi_score": 0.75 * b, "coverage": 0.2 * b * b, "red": 0.7 * b, "chroma_rg": (k % 11) / 13.0, "chroma_by": (k % 7) / 9.0, "flicker_hz": (k % 40).cast("double"), "pattern": (k % 13) / 15.5})


_LEVELS = "['low', 'medium', 'high']"


@query("live_risk", with_(FLAGGED + ", rows_ AS (SELECT * FROM flagged)" + risk_sql(_LIVE), f"SELECT * FROM (SELECT video_id::VARCHAR AS video_id, frame_idx::BIGINT AS frame_idx, round(rdelta, 6) AS red_delta, mf::BIGINT AS max_flashes, round(debt, 6) AS risk_debt, {_LEVELS}[rank + 1] AS base_level, {_LEVELS}[max(rank) OVER {W} + 1] AS risk_level FROM le) q WHERE EXISTS (SELECT 1 FROM sig f WHERE f.video_id::VARCHAR = q.video_id AND f.frame_idx = q.frame_idx AND f.{_BOUND.format(t='f')})"))
def _live_risk(spark, d):
    """Debt and level of each frame from ten shuffled micro-batches."""
    rows = _narrow(_with_inputs(flagged(spark, d)), *ordered.RISK_INPUTS[1:])
    return _collected(spark, ordered.live_risk(_shuffled(spark, rows), DELAY, 0.1, buckets=_buckets(rows))).select("video_id", "frame_idx", "red_delta", "max_flashes", "risk_debt", "base_level", "risk_level")


@query("live_risk_carried", ORACLES["live_risk"].replace("AND f.frame_idx = q.frame_idx AND", "AND f.frame_idx = q.frame_idx AND f.ts > (SELECT (min(ts) + max(ts)) / 2 FROM sig) AND"))
def _live_risk_carried(spark, d):
    """The same where the first half of the time was a batch, whose result the stream goes on from."""
    rows = _with_inputs(flagged(spark, d))
    middle = rows.agg(((F.min("ts") + F.max("ts")) / 2)).first()[0]
    early = risk.risk_levels(risk.with_flash_peaks(rows.filter(F.col("ts") <= middle)))
    stream = _shuffled(spark, _narrow(rows.filter(F.col("ts") > middle), *ordered.RISK_INPUTS[1:]))
    found = ordered.live_risk(stream, DELAY / 2, 0.1, carried=ordered.carried_state(early), buckets=_buckets(rows))
    latest = rows.groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.max("ts").alias("_end"))
    kept = _collected(spark, found).join(latest, "video_id").filter(F.col("ts") <= F.col("_end") - DELAY)
    return kept.select("video_id", "frame_idx", "red_delta", "max_flashes", "risk_debt", "base_level", "risk_level")
