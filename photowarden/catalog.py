"""Queries over the driver's tables, one or more an operator, and their DuckDB SQL.

Events are brightness signals (a user is a video), embeddings are 8x8 frames (a label is a video). Doubles are rounded
to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photowarden.functions import color, scalar
from photowarden.operators import explore, flash, frame_metrics, quantiles, risk, spectral, temporal
from photowarden.params import Flags, Thresholds
from photowarden.plans import analysis
from photowarden.sources import frames as sources
from photowarden.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD, GAP = 0.1, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), places) for n, k in df.dtypes if k == "double"})


def query(name: str, sql: str | None = None, places: int = 6):
    def add(f, sql=sql):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), places)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def signal(spark: SparkSession, d: str) -> DataFrame:
    return sources.signal_from_events(table(spark, d, "events"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return flash.with_flashes(signal(spark, d), THRESHOLD)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return sources.frames_from_embeddings(table(spark, d, "embeddings"))


def metrics(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return frame_metrics.frame_metrics(frames(spark, d), list(names))


def colors(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d, "dominant_color").select("video_id", "frame_idx", "ts", "dominant_color.r", "dominant_color.g", "dominant_color.b")


#: Mean colours stretched about the middle, so that saturated branches are met: factor 8, and red raised.
def vivid(spark: SparkSession, d: str) -> DataFrame:
    wide = lambda c, up: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(c) - 128) * 8 + 128 + up))
    return colors(spark, d).select("video_id", "frame_idx", "ts", wide("r", 130).alias("r"), wide("g", 0).alias("g"), wide("b", -60).alias("b"))


# ---- SQL parts -------------------------------------------------------------------------------------------------------

W = "(PARTITION BY video_id ORDER BY frame_idx)"
SIGNAL = """sig AS (
  SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS frame_idx,
    epoch_us(ts) / 1e6 / 259200.0 AS ts, least(value / 500.0, 1.0) AS brightness FROM events
)"""
FLAGGED = f"""{SIGNAL}, fl AS (
  SELECT *, coalesce(abs(brightness - lag(brightness) OVER {W}), 0.0) AS intensity FROM sig
), flagged AS (SELECT *, intensity > {THRESHOLD} AS is_flash FROM fl)"""
CLUSTERS = f"""{FLAGGED}, cl0 AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER {W} <= {GAP} THEN 0 ELSE 1 END AS fresh FROM flagged WHERE is_flash
), cl1 AS (SELECT *, (sum(fresh) OVER {W})::INTEGER AS cluster_id FROM cl0), clusters AS (
  SELECT video_id, cluster_id, min(ts) AS start_time, max(ts) AS end_time, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS count FROM cl1 GROUP BY ALL
)"""
WINDOWS = f"""{FLAGGED}, RECURSIVE_STEPS AS (
  SELECT video_id, frame_idx, ts, CASE WHEN is_flash THEN ts END AS ws, CASE WHEN is_flash THEN frame_idx END AS wf, is_flash::INTEGER AS k,
    NULL::DOUBLE AS c_start, NULL::INTEGER AS c_frame, NULL::INTEGER AS c_k FROM flagged WHERE frame_idx = 1
  UNION ALL
  SELECT video_id, frame_idx, ts, CASE WHEN closes THEN NULL ELSE ws END, CASE WHEN closes THEN NULL ELSE wf END, CASE WHEN closes THEN 0 ELSE k END,
    CASE WHEN closes THEN ws END, CASE WHEN closes THEN wf END, CASE WHEN closes THEN k END
  FROM (
    SELECT f.video_id, f.frame_idx, f.ts, CASE WHEN f.is_flash AND s.ws IS NULL THEN f.ts ELSE s.ws END AS ws, CASE WHEN f.is_flash AND s.ws IS NULL THEN f.frame_idx ELSE s.wf END AS wf,
      s.k + f.is_flash::INTEGER AS k, coalesce(f.ts >= s.ws + 1.0, false) AS closes
    FROM RECURSIVE_STEPS s JOIN flagged f ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx + 1
  )
), closed AS (
  SELECT video_id, c_start AS start_time, c_start + 1.0 AS end_time, 1.0::DOUBLE AS duration, c_frame AS start_frame, frame_idx - 1 AS end_frame, frame_idx - c_frame AS frame_count, c_k AS flash_count, false AS incomplete, ts AS closed_at
  FROM RECURSIVE_STEPS WHERE c_start IS NOT NULL
), tails AS (
  SELECT video_id, ws AS start_time, least(ws + 1.0, ts) AS end_time, least(ws + 1.0, ts) - ws AS duration, wf AS start_frame, frame_idx AS end_frame, frame_idx - wf + 1 AS frame_count, k AS flash_count, true AS incomplete, ts AS closed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx DESC) AS n FROM RECURSIVE_STEPS) WHERE n = 1 AND ws IS NOT NULL AND least(ws + 1.0, ts) - ws >= 0.5
), violations AS (SELECT * FROM (SELECT * FROM closed UNION ALL SELECT * FROM tails) WHERE flash_count > 3)"""


def with_(parts: str, select: str) -> str:
    return f"WITH RECURSIVE {parts} {select}" if "RECURSIVE_STEPS" in parts else f"WITH {parts} {select}"


def fixed_sql(x: str, places: int) -> str:
    """Decimals as text, halves away from zero: printf rounds exact halves to even."""
    return f"printf('%.{places}f', CASE WHEN abs(({x}) * {2 ** (places + 1)}.0::DOUBLE) % 2 = 1 THEN ({x})::DOUBLE * (1 + pow(2, -51)) ELSE ({x})::DOUBLE END)"


def lin_sql(v: str) -> str:
    return f"(CASE WHEN {v} / 255.0 > 0.04045 THEN pow(({v} / 255.0 + 0.055) / 1.055, 2.4) ELSE {v} / 255.0 / 12.92 END)"


def smooth_lin_sql(v: str) -> str:
    low, high = f"floor({v})", f"least(floor({v}) + 1, 255)"
    return f"({lin_sql(low)} + ({v} - {low}) * ({lin_sql(high)} - {lin_sql(low)}))"


PIXELS = f"""fr AS (
  SELECT label AS video_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id))::INTEGER AS frame_idx,
    list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255)))::INTEGER) AS bytes FROM embeddings
), px0 AS (
  SELECT video_id, frame_idx, p AS pos, p % 8 AS x, p // 8 AS y, bytes[p + 1] AS r, bytes[(p + 21) % 64 + 1] AS g, bytes[(p + 42) % 64 + 1] AS b FROM fr, unnest(range(64)) AS t(p)
), px AS (SELECT *, 0.2126 * {lin_sql('r')} + 0.7152 * {lin_sql('g')} + 0.0722 * {lin_sql('b')} AS lum FROM px0)"""


def lab_sql(r: str, g: str, b: str, source: str, keep: str, name: str) -> str:
    """CTEs that add L, a, bb of the colour expressions to the kept columns of a source."""
    f = lambda t: f"(CASE WHEN {t} > pow(6.0 / 29, 3) THEN pow({t}, 1.0 / 3) ELSE {t} / (3 * pow(6.0 / 29, 2)) + 16.0 / 116 END)"
    rows = [f"({w[0]} * lr + {w[1]} * lg + {w[2]} * lb) / {white}" for w, white in zip(color.XYZ, color.WHITE, strict=True)]
    return f"""{name}1 AS (SELECT {keep}, {smooth_lin_sql(r)} AS lr, {smooth_lin_sql(g)} AS lg, {smooth_lin_sql(b)} AS lb FROM {source}),
{name}2 AS (SELECT {keep}, {rows[0]} AS xx, {rows[1]} AS yy, {rows[2]} AS zz FROM {name}1),
{name} AS (SELECT {keep}, 116 * {f('yy')} - 16 AS l, 500 * ({f('xx')} - {f('yy')}) AS a, 200 * ({f('yy')} - {f('zz')}) AS bb FROM {name}2)"""


COLORS = f"{PIXELS}, col AS (SELECT video_id, frame_idx, (frame_idx - 1) / 30.0 AS ts, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY video_id, frame_idx)"
VIVID = COLORS + ", viv AS (SELECT video_id, frame_idx, ts, greatest(0.0, least(255.0, (r - 128) * 8 + 258)) AS r, greatest(0.0, least(255.0, (g - 128) * 8 + 128)) AS g, greatest(0.0, least(255.0, (b - 128) * 8 + 68)) AS b FROM col)"

# ---- signals: flashes, clusters, windows ------------------------------------------------------------------------------


@query("flash_counts", with_(FLAGGED, "SELECT video_id, count(*) AS frame_count, count_if(is_flash)::BIGINT AS flash_count, round(coalesce(avg(intensity) FILTER (WHERE is_flash AND intensity BETWEEN 0 AND 1), 0.0), 9) AS avg_intensity, round(max(intensity), 9) AS max_intensity FROM flagged GROUP BY video_id"), places=9)
def _flash_counts(spark, d):
    return flash.flash_counts(flagged(spark, d))


@query("brightness_diff", with_(FLAGGED, "SELECT video_id, frame_idx, round(intensity, 6) AS intensity, is_flash FROM flagged"))
def _brightness_diff(spark, d):
    return flagged(spark, d).select("video_id", "frame_idx", "intensity", "is_flash")


@query("seeded_brightness_diff", with_(SIGNAL, f"SELECT video_id, frame_idx, round(abs(brightness - coalesce(lag(brightness) OVER {W}, 0.5)), 6) AS intensity, abs(brightness - coalesce(lag(brightness) OVER {W}, 0.5)) > 0.1 AS is_flash FROM sig"))
def _seeded(spark, d):
    return flash.with_flashes(signal(spark, d), THRESHOLD, F.lit(0.5)).select("video_id", "frame_idx", "intensity", "is_flash")


@query("temporal_change", with_(FLAGGED, f"SELECT video_id, frame_idx, round(coalesce(abs(brightness - lag(brightness) OVER {W}), 0.0), 6) AS temporal_change FROM flagged"))
def _temporal_change(spark, d):
    return flash.temporal_change(signal(spark, d)).select("video_id", "frame_idx", "temporal_change")


@query("active_timeline", with_(FLAGGED, "SELECT video_id, frame_idx, round(intensity, 6) AS intensity FROM flagged WHERE is_flash OR intensity > 0.001"))
def _active(spark, d):
    return flash.active(flash.temporal_change(flagged(spark, d))).select("video_id", "frame_idx", "intensity")


@query("flash_clusters", with_(CLUSTERS, "SELECT video_id, cluster_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_frame, end_frame, count FROM clusters"))
def _clusters(spark, d):
    return flash.clusters(flagged(spark, d), GAP)


@query("cluster_statistics", with_(CLUSTERS, """SELECT video_id, count(*) AS cluster_count, sum(count)::BIGINT AS flashes, round(avg(count), 6) AS avg_size, max(count) AS max_size, min(count) AS min_size, round(median(count), 6) AS median_size,
  round(avg(end_time - start_time), 6) AS avg_duration, round(max(end_time - start_time), 6) AS max_duration, round(min(end_time - start_time), 6) AS min_duration,
  round(CASE WHEN max(end_time) - min(start_time) > 0 THEN sum(count) / (max(end_time) - min(start_time)) ELSE 0.0 END, 6) AS density FROM clusters GROUP BY video_id"""))
def _cluster_statistics(spark, d):
    return flash.cluster_statistics(flash.clusters(flagged(spark, d), GAP))


@query("flash_histogram", with_(FLAGGED, "SELECT video_id, floor(ts)::BIGINT AS second, count(*) AS flashes FROM flagged WHERE is_flash GROUP BY ALL"))
def _histogram(spark, d):
    return flash.flash_histogram(flagged(spark, d))


@query("flash_statistics", with_(FLAGGED, """, peak AS (SELECT video_id, max(n) AS m FROM (SELECT video_id, floor(ts), count(*) AS n FROM flagged WHERE is_flash GROUP BY ALL) GROUP BY 1)
SELECT f.video_id, count_if(is_flash)::BIGINT AS total, round(CASE WHEN max(ts) - min(ts) > 0 THEN count_if(is_flash) / (max(ts) - min(ts)) ELSE 0.0 END, 6) AS per_second, coalesce(any_value(m), 0)::BIGINT AS max_per_second FROM flagged f LEFT JOIN peak p ON f.video_id = p.video_id GROUP BY f.video_id"""))
def _flash_statistics(spark, d):
    return flash.flash_statistics(flagged(spark, d))


@query("rolling_flashes", with_(FLAGGED, """, n AS (SELECT video_id, count(*) OVER (PARTITION BY video_id ORDER BY ts RANGE BETWEEN 1.0 PRECEDING AND CURRENT ROW) AS n FROM flagged WHERE is_flash)
SELECT video_id, max(n) AS max_flashes, count_if(n > 3)::BIGINT AS sequence_violations FROM n GROUP BY video_id"""))
def _rolling(spark, d):
    return flash.rolling_flashes(flagged(spark, d))


@query("violations", with_(WINDOWS, "SELECT video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(duration, 6) AS duration, start_frame, end_frame, frame_count, flash_count, incomplete FROM violations"))
def _violations(spark, d):
    return flash.violations(flagged(spark, d)).drop("closed_at")


@query("violation_windows", with_(WINDOWS, "SELECT video_id, count(*) AS closed_windows, sum(flash_count)::BIGINT AS flashes FROM closed GROUP BY 1"))
def _violation_windows(spark, d):
    s = flash.violation_windows(flagged(spark, d)).filter(F.size("done") > 0)
    return s.select("video_id", F.size("done").cast("long").alias("closed_windows"), F.aggregate("done", F.lit(0).cast("long"), lambda a, w: a + w["flash_count"]).alias("flashes"))


@query("violation_statistics", with_(WINDOWS, """, per AS (SELECT video_id, count(*) AS n, sum(frame_count) AS f, sum(duration) AS t FROM violations GROUP BY 1)
SELECT b.video_id, coalesce(any_value(n), 0)::BIGINT AS violation_count, coalesce(any_value(f), 0)::BIGINT AS dangerous_frames, count(*) AS total_frames, round(coalesce(any_value(f), 0) / count(*) * 100, 6) AS dangerous_frame_percent,
  round(coalesce(any_value(t), 0.0), 6) AS dangerous_time, round(CASE WHEN max(ts) - min(ts) > 0 THEN coalesce(any_value(t), 0.0) / (max(ts) - min(ts)) * 100 ELSE 0.0 END, 6) AS dangerous_time_percent
FROM flagged b LEFT JOIN per p ON b.video_id = p.video_id GROUP BY b.video_id"""))
def _violation_statistics(spark, d):
    return flash.violation_statistics(flagged(spark, d))


@query("violation_clusters", with_(WINDOWS, f""", c0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER {W} <= {GAP} THEN 0 ELSE 1 END AS fresh FROM flagged WHERE is_flash), c1 AS (SELECT *, (sum(fresh) OVER {W})::INTEGER AS cluster_id FROM c0),
cut AS (SELECT v.video_id, v.start_frame, v.start_time, v.end_time, c.cluster_id, count(*) AS count, min(c.ts) AS c_start, max(c.ts) AS c_end FROM violations v JOIN c1 c ON c.video_id = v.video_id AND c.ts <= v.closed_at GROUP BY ALL)
SELECT video_id, start_frame, cluster_id, count, round(greatest(c_start, start_time), 6) AS overlap_start, round(least(c_end, end_time), 6) AS overlap_end FROM cut WHERE c_end > start_time AND c_start < end_time"""))
def _violation_clusters(spark, d):
    return flash.associated_clusters(flagged(spark, d), GAP)


RATES = f"""{SIGNAL}, st AS (SELECT *, ts - lag(ts) OVER {W} AS dt, abs(brightness - lag(brightness) OVER {W}) AS db FROM sig), ra AS (SELECT *, coalesce(CASE WHEN dt > 0.001 THEN least(db / dt, 1000.0) ELSE 0.0 END, 0.0) AS rate FROM st),
cu AS (SELECT *, max(rate) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS current_rate FROM ra)"""


@query("temporal_contrast", with_(RATES, f"SELECT video_id, frame_idx, round(current_rate, 6) AS current_rate, round(max(current_rate) OVER {W}, 6) AS max_rate FROM cu"))
def _temporal_contrast(spark, d):
    return temporal.temporal_contrast(signal(spark, d)).select("video_id", "frame_idx", "current_rate", "max_rate")


@query("temporal_contrast_blocks", with_(RATES, f""", nn AS (SELECT *, frame_idx - 1 AS n, CASE WHEN frame_idx - 1 < 14 THEN greatest(frame_idx - 2, 0) WHEN frame_idx % 15 <= 1 THEN 0 ELSE frame_idx % 15 - 1 END AS steps FROM ra),
bl AS (SELECT a.video_id, a.frame_idx, coalesce(max(b.rate), 0.0) AS current_rate FROM nn a LEFT JOIN ra b ON a.video_id = b.video_id AND b.frame_idx > a.frame_idx - a.steps AND b.frame_idx <= a.frame_idx GROUP BY ALL)
SELECT video_id, frame_idx, round(current_rate, 6) AS current_rate, round(max(current_rate) OVER {W}, 6) AS max_rate FROM bl"""))
def _temporal_contrast_blocks(spark, d):
    return temporal.temporal_contrast(signal(spark, d), compat=True).select("video_id", "frame_idx", "current_rate", "max_rate")


COHERENCE = f"""{SIGNAL}, wi AS (SELECT video_id, frame_idx, list(brightness) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v FROM sig),
st AS (SELECT *, len(v) AS n, list_avg(v) AS m, list_var_pop(v) AS s FROM wi), pa AS (SELECT video_id, frame_idx, n, CASE WHEN s = 0 THEN 1e-8 ELSE s END AS s, k, i, (v[i] - m) * (v[i + k] - m) AS p FROM st, unnest(range(1, 11)) AS t(k), unnest(range(1, 31)) AS u(i) WHERE k <= n - 1 AND i <= n - k),
co AS (SELECT video_id, frame_idx, k, sum(p) / ((any_value(n) - k) * any_value(s)) AS c FROM pa GROUP BY video_id, frame_idx, k)"""


@query("temporal_coherence", with_(COHERENCE, "SELECT s.video_id, s.frame_idx, round(coalesce(avg(abs(c)), 0.0), 6) AS coherence_score, count(c)::INTEGER AS lags FROM sig s LEFT JOIN co ON co.video_id = s.video_id AND co.frame_idx = s.frame_idx GROUP BY s.video_id, s.frame_idx"))
def _coherence(spark, d):
    return temporal.coherence(signal(spark, d)).select("video_id", "frame_idx", "coherence_score", F.size("lags").alias("lags"))


@query("periodicity", f"""WITH {SIGNAL}, v AS (SELECT video_id, list(brightness ORDER BY frame_idx) AS v FROM sig GROUP BY 1), s AS (SELECT *, len(v) AS n, list_avg(v) AS m FROM v WHERE len(v) >= 4),
p AS (SELECT video_id, n, k, sum((v[i] - m) * (v[i + k] - m)) AS c, sqrt(sum((v[i] - m) * (v[i] - m)) * sum((v[i + k] - m) * (v[i + k] - m))) AS d FROM s, unnest(range(2, n // 2)) AS t(k), unnest(range(1, n + 1)) AS u(i) WHERE i <= n - k GROUP BY ALL),
c AS (SELECT video_id, k, CASE WHEN d > 0 THEN c / d ELSE 0 END AS c FROM p), e AS (SELECT *, c > lag(c) OVER (PARTITION BY video_id ORDER BY k) AND c > lead(c) OVER (PARTITION BY video_id ORDER BY k) AS peak FROM c),
b AS (SELECT video_id, max(c) AS c, arg_max(k, c) AS k FROM e WHERE peak GROUP BY 1)
SELECT s.video_id, coalesce(b.c > 0.25, false) AS is_periodic, (CASE WHEN b.c > 0.25 THEN b.k ELSE 0 END)::INTEGER AS period, round(CASE WHEN b.c > 0.25 THEN b.c ELSE 0.0 END, 6) AS confidence FROM s LEFT JOIN b USING (video_id)""")
def _periodicity(spark, d):
    first = signal(spark, d).groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "brightness"))), lambda x: x["brightness"]).alias("v"))
    return first.filter(F.size("v") >= 4).select("video_id", temporal.periodicity(F.col("v")).alias("p")).select("video_id", "p.*")


@query("flicker_frequency", f"""WITH {FLAGGED}, ch AS (SELECT *, CASE WHEN intensity > 0.1 THEN ts END AS hit FROM flagged), pr AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ch),
ga AS (SELECT *, CASE WHEN hit - prev > 0 AND hit - prev < 10 THEN hit - prev END AS gap FROM pr), me AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS m FROM ga)
SELECT video_id, frame_idx, round(CASE WHEN m > 0 THEN least(1 / m, 100.0) ELSE 0.0 END, 6) AS flicker_frequency FROM me""")
def _flicker(spark, d):
    return temporal.flicker_frequency(flash.temporal_change(signal(spark, d)), THRESHOLD).select("video_id", "frame_idx", "flicker_frequency")


@query("rate_limited", with_(SIGNAL + """, RECURSIVE_STEPS AS (
  SELECT video_id, frame_idx, ts, ts AS last, true AS kept FROM sig WHERE frame_idx = 1
  UNION ALL SELECT s.video_id, s.frame_idx, s.ts, CASE WHEN s.ts - r.last >= 0.25 THEN s.ts ELSE r.last END, s.ts - r.last >= 0.25 FROM RECURSIVE_STEPS r JOIN sig s ON s.video_id = r.video_id AND s.frame_idx = r.frame_idx + 1
)""", "SELECT video_id, frame_idx FROM RECURSIVE_STEPS WHERE kept"))
def _rate_limited(spark, d):
    return sources.limit_rate(signal(spark, d), 0.25).select("video_id", "frame_idx")


@query("inactivity_sessions", with_(SIGNAL, f", n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts, frame_idx) > 0.5 THEN 1 ELSE 0 END AS fresh FROM sig), s AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY ts, frame_idx) AS session FROM n) SELECT video_id, session::BIGINT AS session, count(*) AS frames FROM s GROUP BY ALL"))
def _sessions(spark, d):
    return sources.sessions(signal(spark, d), 0.5).groupBy("video_id", "session").agg(F.count("*").alias("frames"))


@query("fixed_intervals", with_(SIGNAL, """, rel AS (SELECT *, ts - min(ts) OVER (PARTITION BY video_id) AS rt FROM sig), du AS (SELECT video_id, max(rt) AS d FROM rel GROUP BY 1 HAVING max(rt) > 0),
ti AS (SELECT video_id, k AS tick, k * 0.5 AS rt FROM du, unnest(range(0, 1 + greatest(ceil(d / 0.5)::BIGINT - 1, 0))) AS t(k))
SELECT t.video_id, t.tick, round(t.rt, 6) AS rel_ts, round(r.brightness, 6) AS brightness FROM ti t ASOF LEFT JOIN rel r ON t.video_id = r.video_id AND t.rt >= r.rt"""))
def _fixed(spark, d):
    return sources.fixed_intervals(signal(spark, d), 0.5, ["brightness"]).withColumnRenamed("at", "rel_ts")


#: The severity score of the rows of q.
SCORES = FLAGGED + f""", p AS (SELECT *, coalesce(count_if(is_flash) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, CASE WHEN is_flash THEN coalesce(ts - lag(ts) OVER {W}, 0.0) END AS lasted FROM flagged),
q AS (SELECT *, coalesce(last_value(lasted IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS l FROM p)"""
SCORE = "0.3 * least(f / (frame_idx / 60.0) / 3.0, 1.0) + 0.25 * least(intensity / 0.2, 1.0) + 0.15 * least(l / 50.0, 1.0) + 0.1 * brightness"


@query("psi", with_(SCORES, f"SELECT video_id, frame_idx, round({SCORE}, 6) AS score FROM q"))
def _psi(spark, d):
    return risk.with_psi(flagged(spark, d)).select("video_id", "frame_idx", F.col("psi.score").alias("score"))


@query("psi_compat", with_(FLAGGED, """, p AS (SELECT *, coalesce(count_if(is_flash) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, CASE WHEN is_flash THEN ts END AS lasted FROM flagged),
q AS (SELECT *, coalesce(last_value(lasted IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS l FROM p),
s AS (SELECT video_id, 0.3 * least(f / (frame_idx / 60.0) / 3.0, 1.0) + 0.25 * least(intensity / 0.2, 1.0) + 0.15 * least(l / 50.0, 1.0) + 0.1 * brightness AS score FROM q)
SELECT video_id, round(avg(score), 6) AS psi_avg, round(max(score), 6) AS psi_max, round(min(score), 6) AS psi_min FROM s WHERE score <> 0 GROUP BY 1"""))
def _psi_compat(spark, d):
    return risk.psi_statistics(risk.with_psi(flagged(spark, d), compat=True).select("video_id", F.col("psi.score").alias("score")))


RISK = f"""{FLAGGED}, pk AS (SELECT *, CASE WHEN is_flash THEN count(*) OVER (PARTITION BY video_id, is_flash ORDER BY ts RANGE BETWEEN 1.0 PRECEDING AND CURRENT ROW) END AS n FROM flagged),
cu AS (SELECT *, count_if(is_flash) OVER {W} AS flashes, coalesce(avg(intensity) FILTER (WHERE is_flash) OVER {W}, 0.0) AS ai, coalesce(max(n) OVER {W}, 0) AS peak, count_if(n > 3) OVER {W} AS overs FROM pk),
ad AS (SELECT *, CASE WHEN flashes > 1 THEN peak ELSE 0 END AS mf, CASE WHEN flashes > 1 THEN overs ELSE 0 END AS sv FROM cu),
de AS (SELECT *, least(1, 0.4 * greatest(0, least(1, (least(ai, 1) - 0.64) / 0.16)) + 0.25 * greatest(0, least(1, (mf - 1) / 2.0))) AS add FROM ad),
RECURSIVE_STEPS AS (SELECT video_id, frame_idx, 0.05 * add AS debt FROM de WHERE frame_idx = 1 UNION ALL SELECT d.video_id, d.frame_idx, 0.95 * r.debt + 0.05 * d.add FROM RECURSIVE_STEPS r JOIN de d ON d.video_id = r.video_id AND d.frame_idx = r.frame_idx + 1),
ra AS (SELECT d.*, debt, CASE WHEN flashes > 1 AND d.frame_idx > 1 THEN CASE WHEN ai >= 0.8 OR mf > 3 OR sv > 0 THEN 2 WHEN ai >= 0.6 THEN 1 ELSE 0 END ELSE 0 END AS base FROM de d JOIN RECURSIVE_STEPS r ON d.video_id = r.video_id AND d.frame_idx = r.frame_idx),
le AS (SELECT *, CASE WHEN debt >= 0.85 THEN 2 WHEN debt >= 0.6 THEN greatest(base, 1) ELSE base END AS rank FROM ra)"""


@query("risk_levels", with_(RISK, f"SELECT video_id, frame_idx, mf::BIGINT AS max_flashes, sv::BIGINT AS sequence_violations, round(debt, 6) AS risk_debt, ['low', 'medium', 'high'][rank + 1] AS base_level, ['low', 'medium', 'high'][max(rank) OVER {W} + 1] AS risk_level FROM le"))
def _risk_levels(spark, d):
    zero = {c: F.lit(0.0) for c in ("psi_score", "coverage", "red", "chroma_rg", "chroma_by", "flicker_hz", "pattern")}
    rows = risk.risk_levels(risk.with_flash_peaks(flagged(spark, d)).withColumns(zero))
    return rows.select("video_id", "frame_idx", F.col("max_flashes").cast("long").alias("max_flashes"), F.col("sequence_violations").cast("long").alias("sequence_violations"), "risk_debt", "base_level", "risk_level")


COUNTS = FLAGGED + ", counts AS (SELECT video_id, count(*) AS frame_count, count_if(is_flash) AS flash_count, coalesce(avg(intensity) FILTER (WHERE is_flash), 0.0) AS avg_intensity FROM flagged GROUP BY 1)"


def _labels(a: str, b: str, c: str, none: str) -> str:
    return f"concat_ws('; ', CASE WHEN flash_count / (frame_count / 60.0) > 3 THEN '{a}' END, CASE WHEN avg_intensity > 0.5 THEN '{b}' END, CASE WHEN flash_count > 5 THEN '{c}' END, CASE WHEN NOT (flash_count / (frame_count / 60.0) > 3 OR avg_intensity > 0.5 OR flash_count > 5) THEN '{none}' END)"


@query("risk_factors", with_(COUNTS, f"SELECT video_id, {_labels('High Flash Rate', 'High Intensity', 'Multiple Sequences', 'No significant risk factors')} AS factors FROM counts"))
def _risk_factors(spark, d):
    return risk.risk_factors(flash.flash_counts(flagged(spark, d))).select("video_id", F.array_join("risk_factors", "; ").alias("factors"))


@query("recommendations", with_(COUNTS, f"SELECT video_id, {_labels('Warning: High flash rate detected', 'Warning: High intensity flashes detected', 'Multiple flash sequences detected', 'No significant issues detected')} AS recommendations FROM counts"))
def _recommendations(spark, d):
    return risk.recommendations(flash.flash_counts(flagged(spark, d))).select("video_id", F.array_join("recommendations", "; ").alias("recommendations"))


@query("temporal_variability", with_(SIGNAL, "SELECT video_id, round(CASE WHEN count(*) >= 2 THEN stddev_pop(brightness) / CASE WHEN max(brightness) > 1 THEN 255.0 ELSE 1.0 END ELSE 0.0 END, 6) AS variability FROM sig GROUP BY 1"))
def _variability(spark, d):
    return signal(spark, d).groupBy("video_id").agg(F.collect_list("brightness").alias("v")).select("video_id", temporal.variability(F.col("v")).alias("variability"))


@query("last_rows", with_(SIGNAL, "SELECT video_id, frame_idx, round(brightness, 6) AS brightness FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx DESC) AS k FROM sig) WHERE k <= 10"))
def _last_rows(spark, d):
    return temporal.last_k(signal(spark, d), 10).select("video_id", "frame_idx", "brightness")


@query("red_durations", with_(SIGNAL, f", g AS (SELECT *, ts - lag(ts) OVER {W} AS dt FROM sig), s AS (SELECT video_id, count(*) AS n, max(ts) - min(ts) AS span, quantile_cont(dt, 0.5) FILTER (WHERE dt > 0) AS med FROM g GROUP BY 1) SELECT video_id, round(CASE WHEN n <= 1 THEN 0.0 WHEN span > 0 THEN span / CASE WHEN coalesce(med < 1, abs(span) < 10) THEN 1.0 ELSE 1000.0 END WHEN med IS NULL THEN (n - 1) / 30.0 ELSE med * (n - 1) END, 6) AS seconds FROM s"))
def _red_durations(spark, d):
    times = signal(spark, d).groupBy("video_id").agg(F.sort_array(F.collect_list("ts")).alias("t"))
    return times.select("video_id", temporal.duration_seconds(F.col("t")).alias("seconds"))


# ---- frames ----------------------------------------------------------------------------------------------------------


@query("frame_luma", with_(PIXELS, """SELECT video_id, frame_idx, round(avg(lum), 6) AS brightness, round(avg(CASE WHEN lum > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(r) / 255, 6) AS red_intensity FROM px GROUP BY 1, 2"""))
def _frame_luma(spark, d):
    return metrics(spark, d, "brightness", "coverage", "red_intensity").drop("ts")


@query("frame_dominant_color", with_(COLORS, "SELECT video_id, frame_idx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM col"))
def _dominant(spark, d):
    return colors(spark, d).drop("ts")


@query("frame_entropy", with_(PIXELS, ", h AS (SELECT video_id, frame_idx, greatest(0, least(255, floor(lum * 255 + 0.5))) AS bin, count(*) / 64.0 AS p FROM px GROUP BY 1, 2, 3) SELECT video_id, frame_idx, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY 1, 2"))
def _entropy(spark, d):
    return metrics(spark, d, "entropy").drop("ts")


@query("frame_chromatic", with_(PIXELS, "SELECT video_id, frame_idx, round(avg(abs(r - g) / sqrt(2)) / 255, 6) AS red_green, round(avg(abs(b - (r + g) / 2.0) / sqrt(6)) / 255, 6) AS blue_yellow FROM px GROUP BY 1, 2"))
def _chromatic(spark, d):
    return metrics(spark, d, "chromatic").select("video_id", "frame_idx", "chromatic.*")


@query("frame_color_deviation", with_(PIXELS, "SELECT video_id, frame_idx, round(stddev_pop(r) / 255, 6) AS r, round(stddev_pop(g) / 255, 6) AS g, round(stddev_pop(b) / 255, 6) AS b FROM px GROUP BY 1, 2"))
def _deviation(spark, d):
    return metrics(spark, d, "color_deviation").select("video_id", "frame_idx", "color_deviation.r", "color_deviation.g", "color_deviation.b")


_INNER = "(x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0) < 1.6 * 1.6"


@query("frame_spatial", with_(PIXELS, f"SELECT video_id, frame_idx, round(avg(lum) FILTER (WHERE {_INNER}), 6) AS center, round(avg(lum) FILTER (WHERE NOT ({_INNER})), 6) AS periphery, " + ", ".join(f"round(avg(lum) FILTER (WHERE (CASE WHEN x < 4 THEN 0 ELSE 1 END) + (CASE WHEN y < 4 THEN 0 ELSE 2 END) = {k}), 6) AS q{k}" for k in range(4)) + " FROM px GROUP BY 1, 2"))
def _spatial(spark, d):
    return metrics(spark, d, "spatial").select("video_id", "frame_idx", "spatial.*")


SOBEL = PIXELS + """, gr AS (SELECT video_id, frame_idx, list(lum ORDER BY pos) AS l FROM px GROUP BY 1, 2), so0 AS (
  SELECT video_id, frame_idx, y, x, -l[p - 8] - 2 * l[p] - l[p + 8] + l[p - 6] + 2 * l[p + 2] + l[p + 10] AS gx, -l[p - 8] - 2 * l[p - 7] - l[p - 6] + l[p + 8] + 2 * l[p + 9] + l[p + 10] AS gy
  FROM (SELECT *, y * 8 + x AS p FROM gr, unnest(range(1, 7)) AS t(y), unnest(range(1, 7)) AS u(x))
), so AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM so0)"""


@query("frame_edges", with_(SOBEL, "SELECT video_id, frame_idx, round(count_if(m * 255 > 50) / 36.0, 6) AS density, count_if(m * 255 > 50)::DOUBLE AS count FROM so GROUP BY 1, 2"))
def _edges(spark, d):
    return metrics(spark, d, "edges").select("video_id", "frame_idx", "edges.*")


@query("frame_pattern", with_(SOBEL, """, ro AS (SELECT video_id, frame_idx, y, sum(m) AS s FROM so GROUP BY ALL UNION ALL SELECT video_id, frame_idx, y, 0.0 FROM gr, (VALUES (0), (7)) AS e(y)),
ce AS (SELECT video_id, frame_idx, list(d ORDER BY y) AS d FROM (SELECT *, s - avg(s) OVER (PARTITION BY video_id, frame_idx) AS d FROM ro) GROUP BY 1, 2),
co AS (SELECT video_id, frame_idx, d, greatest(0, (d[1] * d[3] + d[2] * d[4] + d[3] * d[5] + d[4] * d[6] + d[5] * d[7] + d[6] * d[8]) / 6, (d[1] * d[4] + d[2] * d[5] + d[3] * d[6] + d[4] * d[7] + d[5] * d[8]) / 5) AS best, list_sum(list_transform(d, lambda q: abs(q))) AS total FROM ce),
bl AS (SELECT video_id, frame_idx, stddev_pop(lum) / 0.5 AS c FROM px GROUP BY 1, 2)
SELECT c.video_id, c.frame_idx, round(greatest(0, least(1, 0.5 * bl.c + 0.5 * CASE WHEN total > 1e-6 THEN least(best / (total / 8 + 1e-6), 1) ELSE 0 END)), 6) AS pattern FROM co c JOIN bl ON c.video_id = bl.video_id AND c.frame_idx = bl.frame_idx"""))
def _pattern(spark, d):
    return metrics(spark, d, "pattern").drop("ts")


@query("frame_palette", with_(PIXELS, ", k AS (SELECT video_id, frame_idx, r // 32 * 32 AS r, g // 32 * 32 AS g, b // 32 * 32 AS b, count(*) AS n FROM px GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY n DESC, r, g, b)::INTEGER AS place FROM k) SELECT video_id, frame_idx, place, r, g, b, n FROM o WHERE place <= 5"))
def _palette(spark, d):
    rows = metrics(spark, d, "palette").select("video_id", "frame_idx", F.posexplode("palette").alias("p", "c"))
    return rows.select("video_id", "frame_idx", (F.col("p") + 1).alias("place"), "c.r", "c.g", "c.b", F.col("c.count").alias("n"))


HIST = PIXELS + ", hi AS (SELECT video_id, frame_idx, least(31, floor(floor(lum * 255) / 8))::INTEGER AS bin, count(*) AS n FROM px GROUP BY ALL)"


@query("frame_histogram", with_(HIST, "SELECT video_id, frame_idx, bin, n FROM hi"))
def _frame_histogram(spark, d):
    return metrics(spark, d, "histogram").select("video_id", "frame_idx", F.posexplode("histogram").alias("bin", "n")).filter("n > 0")


@query("scene_change", with_(HIST, """, pa AS (SELECT video_id, frame_idx, bin, n AS a, 0 AS b FROM hi UNION ALL SELECT video_id, frame_idx + 1, bin, 0, n FROM hi), su AS (SELECT video_id, frame_idx, bin, sum(a) AS a, sum(b) AS b FROM pa GROUP BY ALL)
SELECT f.video_id, f.frame_idx, round(CASE WHEN f.frame_idx = 1 THEN 0.0 ELSE coalesce(sum(abs(a - b)) FILTER (WHERE a <> b) / sum(a + b) FILTER (WHERE a <> b), 0.0) END, 6) AS scene_change FROM fr f JOIN su s ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx GROUP BY f.video_id, f.frame_idx"""))
def _scene_change(spark, d):
    return frame_metrics.scene_change(frames(spark, d)).drop("ts")


@query("frame_difference", with_(PIXELS, ", d AS (SELECT a.video_id, a.frame_idx, abs(a.r - coalesce(b.r, 0)) + abs(a.g - coalesce(b.g, 0)) + abs(a.b - coalesce(b.b, 0)) AS d FROM px a LEFT JOIN px b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx + 1 AND a.pos = b.pos) SELECT video_id, frame_idx, round(sum(d) / (64 * 765.0), 6) AS difference, round(avg(CASE WHEN d > 76.5 THEN 1.0 ELSE 0.0 END), 6) AS motion FROM d GROUP BY 1, 2"))
def _difference(spark, d):
    return frame_metrics.frame_difference(frames(spark, d)).drop("ts")


@query("pixel_filters", with_(PIXELS, "SELECT video_id, frame_idx, count(*) AS pixels, round(avg(lum), 6) AS luminance FROM px WHERE pos % greatest(1, 64 // 1024) = 0 GROUP BY 1, 2"))
def _pixel_filters(spark, d):
    px = frame_metrics.require_rgb(frame_metrics.valid_pixels(frame_metrics.sampled_pixels(frame_metrics.pixels(frames(spark, d)).filter("a <> 0"), 64)))
    return px.groupBy("video_id", "frame_idx").agg(F.count("*").alias("pixels"), F.avg(color.luminance(F.col("r"), F.col("g"), F.col("b"))).alias("luminance"))


@query("lab_colors", with_(COLORS + ", " + lab_sql("r", "g", "b", "col", "video_id, frame_idx", "lab"), "SELECT video_id, frame_idx, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS b FROM lab"))
def _lab(spark, d):
    lab = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return colors(spark, d).withColumn("lab", lab).select("video_id", "frame_idx", F.col("lab.L").alias("l"), "lab.a", "lab.b")


@query("cie76_delta", with_(COLORS + ", " + lab_sql("r", "g", "b", "col", "video_id, frame_idx", "lab"), f"SELECT video_id, frame_idx, round(coalesce(sqrt(pow(l - lag(l) OVER {W}, 2) + pow(a - lag(a) OVER {W}, 2) + pow(bb - lag(bb) OVER {W}, 2)), 0.0), 6) AS delta_e FROM lab"))
def _cie76(spark, d):
    rows = colors(spark, d).withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    return rows.withColumn("delta_e", temporal.delta_e()).select("video_id", "frame_idx", "delta_e")


@query("red_delta", with_(COLORS, f"SELECT video_id, frame_idx, round(coalesce(abs(r / 255 - lag(r / 255) OVER {W}), 0.0), 6) AS red_delta FROM col"))
def _red_delta(spark, d):
    return metrics(spark, d, "red_intensity").withColumn("red_delta", temporal.delta("red_intensity")).select("video_id", "frame_idx", "red_delta")


PIXEL_CONTRAST = PIXELS + ", " + lab_sql("r", "g", "b", "px0", "video_id, frame_idx, pos", "lab") + """, de AS (
  SELECT *, sqrt(pow(l - lag(l) OVER w, 2) + pow(a - lag(a) OVER w, 2) + pow(bb - lag(bb) OVER w, 2)) AS d FROM lab WINDOW w AS (PARTITION BY video_id, frame_idx ORDER BY pos)
), ag AS (
  SELECT video_id, frame_idx, avg(d) AS m, stddev_pop(d) AS s, max(d) AS x, count_if(d >= 2.3)::BIGINT AS hits, sum(d * exp(-0.1 * (63 - pos))) FILTER (WHERE pos >= 14) / sum(exp(-0.1 * (63 - pos))) FILTER (WHERE pos >= 14) AS w,
    quantile_cont(d, 0.5) AS q50, quantile_cont(d, 0.9) AS q90, quantile_cont(d, 0.95) AS q95 FROM de WHERE d IS NOT NULL GROUP BY 1, 2
)"""


@query("pixel_contrast", with_(PIXEL_CONTRAST, """SELECT video_id, frame_idx, floor(least(100.0, m / 2.3 * 100) * 100 + 0.5) / 100 AS sensitivity, floor(s * 100 + 0.5) / 100 AS fluctuations, floor(m * 100 + 0.5) / 100 AS average_delta_e, floor(x * 100 + 0.5) / 100 AS max_delta_e, hits AS significant_changes,
  floor(hits / 63.0 * 10000 + 0.5) / 100 AS fluctuation_rate, floor(w * 100 + 0.5) / 100 AS weighted_average_delta_e, floor(s / m * 1000 + 0.5) / 1000 AS coefficient_of_variation, floor(q50 * 100 + 0.5) / 100 AS median_delta_e, floor(q90 * 100 + 0.5) / 100 AS p90_delta_e, floor(q95 * 100 + 0.5) / 100 AS p95_delta_e FROM ag"""))
def _pixel_contrast(spark, d):
    return metrics(spark, d, "pixel_contrast").select("video_id", "frame_idx", "pixel_contrast.*").drop("total_samples", "window_size", "weight_decay")


RED = VIVID + ", " + lab_sql("r", "g", "b", "viv", "video_id, frame_idx, ts, r, g, b", "lab") + f""", ra AS (
  SELECT *, greatest(0, least(1, CASE WHEN a > 30 AND sqrt(a * a + bb * bb) > 35 AND r - greatest(g, b) > 60 AND r / 255 > 0.7 THEN greatest(0.3, least(r / 255, 1.0)) ELSE least(r / 255 * 0.05, 0.1) END)) AS area FROM lab
), ro AS (SELECT *, (area >= 0.25)::INTEGER AS on_ FROM ra), rt AS (SELECT *, CASE WHEN on_ <> lag(on_) OVER {W} THEN 1 ELSE 0 END AS tr FROM ro)"""


@query("red_states", with_(RED, "SELECT video_id, frame_idx, round(area, 6) AS red_area, on_ AS red_on, tr AS red_transition FROM rt"))
def _red_states(spark, d):
    return temporal.red_states(vivid(spark, d)).select("video_id", "frame_idx", "red_area", "red_on", "red_transition")


@query("red_window", with_(RED, """, wi AS (SELECT *, count(*) OVER w AS n, avg(area) OVER w AS av, max(area) OVER w AS mx, avg(on_) OVER w AS fr, sum(tr) OVER w - first_value(tr) OVER w AS t, ts - min(ts) OVER w AS sec FROM rt WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
ev AS (SELECT *, CASE WHEN n >= 5 THEN t ELSE 0 END AS trans, floor(CASE WHEN n >= 5 THEN t ELSE 0 END / 2.0) AS events FROM wi), rr AS (SELECT *, CASE WHEN events > 0 AND sec > 0 THEN least(events / sec, 60.0) ELSE 0.0 END AS rate FROM ev)
SELECT video_id, frame_idx, round(CASE WHEN n >= 5 THEN av ELSE area END, 6) AS red_area_avg, round(CASE WHEN n >= 5 THEN mx ELSE area END, 6) AS red_area_max, round(CASE WHEN n >= 5 THEN fr ELSE on_ END, 6) AS red_on_fraction,
  trans::BIGINT AS red_transitions, events::BIGINT AS red_flash_events, round(rate, 6) AS red_flash_per_second, rate BETWEEN 3 AND 30 AS red_flicker_in_risk_band FROM rr"""))
def _red_window(spark, d):
    return temporal.red_window(temporal.red_states(vivid(spark, d)), places=None).select("video_id", "frame_idx", "red_metrics.*").drop("red_area_threshold_used", "window_duration_ms")


@query("color_history", with_(COLORS, """, dd AS (SELECT *, abs(r - lag(r) OVER w) AS dr, abs(g - lag(g) OVER w) AS dg, abs(b - lag(b) OVER w) AS db FROM col WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))
SELECT video_id, frame_idx, """ + ", ".join(f"round(CASE WHEN frame_idx >= 2 THEN stddev_pop({c}) OVER w / CASE WHEN max({c}) OVER w > 1 THEN 255.0 ELSE 1.0 END ELSE 0.0 END, 6) AS variance_{c}, round(CASE WHEN frame_idx >= 2 THEN avg(d{c}) OVER v ELSE 0.0 END, 6) AS change_{c}" for c in "rgb") + " FROM dd WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), v AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)"))
def _color_history(spark, d):
    rows = metrics(spark, d, "color_deviation").select("video_id", "frame_idx", "color_deviation.mean_r", "color_deviation.mean_g", "color_deviation.mean_b")
    return temporal.color_history(rows).drop("mean_r", "mean_g", "mean_b")


@query("color_spikes", with_(VIVID, ", dd AS (" + " UNION ALL ".join(f"SELECT video_id, frame_idx, '{c}' AS channel, abs({c} - lag({c}) OVER {W}) / 255.0 AS d FROM viv" for c in "rgb") + """), st AS (SELECT *, avg(d) OVER w AS m, stddev_pop(d) OVER w AS s, count(d) OVER w AS n FROM dd WINDOW w AS (PARTITION BY video_id, channel ORDER BY frame_idx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
hit AS (SELECT a.video_id, a.frame_idx, count(*) AS n, sum(b.d) AS total FROM st a JOIN dd b ON a.video_id = b.video_id AND a.channel = b.channel AND b.frame_idx BETWEEN a.frame_idx - 28 AND a.frame_idx AND b.d > 0.2 AND b.d > a.m + 2 * a.s WHERE a.n >= 2 GROUP BY ALL)
SELECT v.video_id, v.frame_idx, coalesce(n, 0)::INTEGER AS spikes, round(coalesce(total, 0.0), 6) AS total FROM viv v LEFT JOIN hit h ON v.video_id = h.video_id AND v.frame_idx = h.frame_idx"""))
def _color_spikes(spark, d):
    rows = vivid(spark, d).select("video_id", "frame_idx", *(F.col(c).alias(f"mean_{c}") for c in "rgb"))
    return temporal.color_spikes(rows).select("video_id", "frame_idx", F.size("spikes").alias("spikes"), F.aggregate("spikes", F.lit(0.0), lambda s, x: s + x["magnitude"]).alias("total"))


@query("edge_change", with_(SOBEL, f", ed AS (SELECT video_id, frame_idx, count_if(m * 255 > 50) / 36.0 AS e FROM so GROUP BY 1, 2), dd AS (SELECT *, abs(e - lag(e) OVER {W}) AS d FROM ed) SELECT video_id, frame_idx, round(coalesce(avg(d) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0.0), 6) AS edge_change FROM dd"))
def _edge_change(spark, d):
    rows = metrics(spark, d, "edges").select("video_id", "frame_idx", F.col("edges.density").alias("edge_density"))
    return temporal.edge_change(rows, 5).select("video_id", "frame_idx", "edge_change")


@query("chromatic_history", with_(PIXELS, ", c AS (SELECT video_id, frame_idx, avg(abs(r - g) / sqrt(2)) / 255 AS rg FROM px GROUP BY 1, 2) SELECT video_id, frame_idx, count(*) OVER w AS n, round(sum(rg) OVER w, 6) AS total FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def _chromatic_history(spark, d):
    rows = metrics(spark, d, "chromatic").withColumn("h", temporal.history("chromatic", 10))
    return rows.select("video_id", "frame_idx", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0.0), lambda s, x: s + x["red_green"]).alias("total"))


STREAM = VIVID + ", " + lab_sql("r", "g", "b", "viv", "video_id, frame_idx, ts", "lab") + f""", de AS (SELECT *, sqrt(pow(l - lag(l) OVER {W}, 2) + pow(a - lag(a) OVER {W}, 2) + pow(bb - lag(bb) OVER {W}, 2)) AS d FROM lab),
ga AS (SELECT *, CASE WHEN d IS NOT NULL THEN exp(ln(2) * 3 * ts) END AS g FROM de), em AS (SELECT *, sum(d * g) OVER {W} / sum(g) OVER {W} AS stream FROM ga),
pa AS (SELECT a.video_id, a.frame_idx, a.ts AS e, a.stream, b.ts, b.d, b.frame_idx AS f FROM em a JOIN em b ON a.video_id = b.video_id AND b.ts BETWEEN a.ts - 1.0 AND a.ts),
ag AS (SELECT video_id, frame_idx, any_value(stream) AS stream, count(*) AS n, min(f) AS first, max(e) - min(ts) AS duration FROM pa GROUP BY 1, 2 HAVING count(*) >= 30),
me AS (SELECT p.video_id, p.frame_idx, avg(d) AS m, stddev_pop(d) AS s, max(d) AS x, count_if(d >= 2.3)::BIGINT AS hits, sum(d * exp(-(e - ts) * ln(2) * 3)) / sum(exp(-(e - ts) * ln(2) * 3)) AS w FROM pa p JOIN ag a ON p.video_id = a.video_id AND p.frame_idx = a.frame_idx AND p.f > a.first GROUP BY 1, 2)"""


@query("contrast_windows", with_(STREAM, """SELECT a.video_id, a.frame_idx, n AS sample_count, round(duration, 6) AS duration, floor(least(100.0, m / 2.3 * 100) * 100 + 0.5) / 100 AS sensitivity, floor(s * 100 + 0.5) / 100 AS fluctuations, floor(m * 100 + 0.5) / 100 AS average_delta_e,
  floor(x * 100 + 0.5) / 100 AS max_delta_e, hits AS significant_changes, floor(w * 100 + 0.5) / 100 AS weighted_average_delta_e, floor(stream * 100 + 0.5) / 100 AS stream_weighted_average_delta_e FROM ag a JOIN me ON a.video_id = me.video_id AND a.frame_idx = me.frame_idx"""))
def _contrast_windows(spark, d):
    return temporal.contrast_windows(vivid(spark, d)).drop("start_time", "end_time")


SPECTRUM = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), h AS (SELECT vec_id, i, (v[i + 1] - list_median(v)) * 0.5 * (1 - cos(2 * pi() * i / 63)) AS s FROM v, unnest(range(64)) AS t(i)),
z AS (SELECT vec_id, k, sum(s * cos(2 * pi() * k * i / 64)) AS re, -sum(s * sin(2 * pi() * k * i / 64)) AS im FROM h, unnest(range(32)) AS t(k) GROUP BY 1, 2), a AS (SELECT vec_id, k, sqrt(re * re + im * im) * 2 / 31.5 AS a FROM z WHERE k BETWEEN 3 AND 31),
b AS (SELECT vec_id, arg_max(k, a) AS kk, max(a) AS top FROM a GROUP BY 1), n AS (SELECT a.vec_id, any_value(top) AS top, avg(a.a * a.a) AS noise FROM a JOIN b ON a.vec_id = b.vec_id AND a.k BETWEEN kk - 4 AND kk + 4 AND a.k <> kk GROUP BY 1),
f AS (SELECT a.vec_id, exp(avg(ln(a.a * a.a + greatest(1e-20, 1e-12 * top * top)))) / avg(a.a * a.a) AS flat FROM a JOIN b ON a.vec_id = b.vec_id GROUP BY 1)"""


@query("spectral_analysis", f"WITH {SPECTRUM} SELECT b.vec_id, round(kk * 60 / 64.0, 6) AS dominant_frequency, round(flat, 6) AS spectral_flatness, round(10 * log10(n.top * n.top / greatest(noise, 1e-12)), 6) AS confidence FROM b JOIN n ON b.vec_id = n.vec_id JOIN f ON b.vec_id = f.vec_id")
def _spectral(spark, d):
    return spectral.vector_spectra(table(spark, d, "embeddings"), F.transform("embedding", lambda x: x.cast("double")), "vec_id")


# ---- quantiles, explorer, formats ------------------------------------------------------------------------------------


@query("quantile_statistics", "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS size, count(DISTINCT l_extendedprice) AS distinct_values, round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1, 2")
def _quantiles(spark, d):
    return quantiles.statistics(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query("kth_smallest", "SELECT l_returnflag, round(list_sort(list(l_quantity))[1001], 6) AS kth FROM lineitem GROUP BY 1")
def _kth(spark, d):
    return quantiles.kth_smallest(table(spark, d, "lineitem"), "l_quantity", 1000, ["l_returnflag"])


@query("first_sorted", "SELECT round(l_extendedprice, 6) AS value FROM lineitem ORDER BY l_extendedprice LIMIT 25")
def _first_sorted(spark, d):
    return quantiles.first_sorted(table(spark, d, "lineitem"), "l_extendedprice", 25)


def _rank_sql(q: float) -> str:
    return f"round(list_sort(list(value))[least(floor(count(*) * {q}) + 1, count(*))::BIGINT], 6)"


@query("latency_statistics", f"SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, {_rank_sql(0.5)} AS p50, {_rank_sql(0.95)} AS p95, {_rank_sql(0.99)} AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY 1")
def _latency(spark, d):
    return quantiles.latency_statistics(table(spark, d, "events"), "value", ["event_type"])


@query("by_category", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, arg_min(p_name, (p_retailprice, p_name)) AS fastest, arg_max(p_name, (p_retailprice, p_name)) AS slowest FROM part GROUP BY 1")
def _by_category(spark, d):
    return quantiles.by_category(table(spark, d, "part"), "p_brand", "p_name", "p_retailprice")


@query("slowest_five", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def _slowest(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_retailprice").limit(5)


@query("normalise", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / (b - a), 6) AS l_extendedprice, round((l_quantity - c) / (e - c), 6) AS l_quantity FROM lineitem, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS e FROM lineitem)")
def _normalise(spark, d):
    return explore.normalise(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])


@query("explore_zoom", with_(SIGNAL, ", z AS (SELECT video_id, frame_idx, brightness FROM sig WHERE frame_idx - 1 BETWEEN 10 AND 50) SELECT video_id, frame_idx, round(CASE WHEN max(brightness) OVER w = min(brightness) OVER w THEN 0.5 ELSE (brightness - min(brightness) OVER w) / (max(brightness) OVER w - min(brightness) OVER w) END, 6) AS brightness FROM z WINDOW w AS (PARTITION BY video_id)"))
def _explore(spark, d):
    return explore.explore(signal(spark, d), "frame_idx", ["brightness"], center=30, width=40, by=["video_id"]).select("video_id", "frame_idx", "brightness")


@query("selection", with_(SIGNAL, "SELECT video_id, frame_idx, round(brightness, 6) AS brightness FROM sig WHERE frame_idx - 1 BETWEEN 12 AND 17"))
def _selection(spark, d):
    return explore.selection(explore.numbered(signal(spark, d), "frame_idx", ["video_id"]), 10, 2, 7).select("video_id", "frame_idx", "brightness")


@query("chart_bounds", "SELECT min(l_orderkey) AS min_x, max(l_orderkey) AS max_x, round(least(min(l_tax), min(l_discount)), 6) AS min_y, round(greatest(max(l_tax), max(l_discount)), 6) AS max_y FROM lineitem")
def _bounds(spark, d):
    return explore.bounds(table(spark, d, "lineitem"), "l_orderkey", ["l_tax", "l_discount"])


@query("nearest_point", "SELECT x, y, round(d, 6) AS distance FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, sqrt(pow(l_quantity - 25.3, 2) + pow(l_extendedprice / 1000 - 40.2, 2)) AS d FROM lineitem) WHERE d < 12 ORDER BY d, x, y LIMIT 1".replace("SELECT x, y,", "SELECT round(x, 6) AS x, round(y, 6) AS y,"))
def _nearest(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return explore.nearest_point(points, 25.3, 40.2)


@query("flattened", with_(FLAGGED, "SELECT video_id::DOUBLE AS video_id, frame_idx::DOUBLE AS frame_idx, round(ts, 6) AS ts, round(brightness, 6) AS \"b.brightness\", is_flash::INTEGER::DOUBLE AS \"b.is_flash\" FROM flagged"))
def _flattened(spark, d):
    nested = flagged(spark, d).select("video_id", "frame_idx", "ts", F.struct("brightness", "is_flash").alias("b"))
    return explore.flatten_metrics(nested)


@query("json_scan", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def _json_scan(spark, d):
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("fixed_decimals", f"SELECT event_id, {fixed_sql('value', 2)} AS two, {fixed_sql('value / 7', 4)} AS four, {fixed_sql('floor(value) / 8 - 20', 2)} AS halves, {fixed_sql('floor(value) / 2', 0)} AS whole FROM events")
def _fixed_decimals(spark, d):
    return table(spark, d, "events").select(
        "event_id", scalar.to_fixed(F.col("value"), 2).alias("two"), scalar.to_fixed(F.col("value") / 7, 4).alias("four"),
        scalar.to_fixed(F.floor("value") / 8 - 20, 2).alias("halves"), scalar.to_fixed(F.floor("value") / 2, 0).alias("whole"),
    )


@query("csv_rows", with_(FLAGGED, "SELECT printf('%.6f', ts) AS \"Timestamp\", printf('%.4f', brightness) AS \"Brightness\", (is_flash::INTEGER)::VARCHAR AS \"Flash Detected\", printf('%.4f', intensity) AS \"Intensity\" FROM flagged WHERE ts >= 0"))
def _csv_rows(spark, d):
    rows = flagged(spark, d).select(F.col("ts").alias("timestamp"), "brightness", "is_flash", "intensity")
    return sinks.csv_rows(rows).select("Timestamp", "Brightness", "Flash Detected", "Intensity")


@query("safe_file_names", "SELECT p_partkey, 'analysis-' || regexp_replace(regexp_replace(p_name, '\\.[^/.]+$', ''), '[^A-Za-z0-9_\\-.]', '_', 'g') AS file_name FROM part")
def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.base_file_name(F.col("p_name")).alias("file_name"))


@query("scalar_functions", "SELECT event_id, CASE WHEN value / 500 > 0.7 THEN 'high' WHEN value / 500 > 0.4 THEN 'medium' ELSE 'low' END AS band, (floor(floor(value) / 60)::BIGINT)::VARCHAR || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS clock, round(value / 500 * 100, 6) AS progress, round(sqrt(value * value + 1 + 4), 6) AS magnitude, floor(value * 10 + 0.5) / 10 AS half_up, CASE WHEN value / 500 BETWEEN 0 AND 1 THEN round(value / 500, 6) ELSE 0.0 END AS cleaned FROM events")
def _scalars(spark, d):
    x = F.col("value")
    return table(spark, d, "events").select(
        "event_id", scalar.psi_band(x / 500).alias("band"), scalar.format_time(x).alias("clock"), scalar.progress_percent(x, F.lit(500.0)).alias("progress"),
        scalar.magnitude(x, F.lit(1.0), F.lit(2.0)).alias("magnitude"), scalar.half_up(x, 1).alias("half_up"), scalar.clean_unit(x / 500).alias("cleaned"),
    )


@query("first_bin_resolution", with_(SIGNAL, "SELECT round(coalesce(arg_min(brightness, (ts, brightness)) FILTER (WHERE brightness <> 0), 0.0), 6) AS bin_resolution FROM sig"))
def _bin_resolution(spark, d):
    return sources.first_bin_resolution(signal(spark, d).withColumn("bin_resolution", F.col("brightness")))


# ---- whole plans -----------------------------------------------------------------------------------------------------

ANALYSIS = PIXELS + f""", fl AS (SELECT video_id, frame_idx, avg(lum) AS brightness, avg(r) / 255 AS red_intensity, avg(CASE WHEN lum > 0.5 THEN 1.0 ELSE 0.0 END) AS coverage FROM px GROUP BY 1, 2),
hs AS (SELECT video_id, frame_idx, -sum(p * log2(p)) AS entropy FROM (SELECT video_id, frame_idx, floor(lum * 255 + 0.5) AS bin, count(*) / 64.0 AS p FROM px GROUP BY 1, 2, 3) GROUP BY 1, 2),
an AS (SELECT fl.*, entropy, coalesce(abs(brightness - lag(brightness) OVER (PARTITION BY fl.video_id ORDER BY fl.frame_idx)), 0.0) AS intensity, coalesce(abs(red_intensity - lag(red_intensity) OVER (PARTITION BY fl.video_id ORDER BY fl.frame_idx)), 0.0) AS red_delta FROM fl JOIN hs ON fl.video_id = hs.video_id AND fl.frame_idx = hs.frame_idx)"""


def analyzed(spark: SparkSession, d: str) -> DataFrame:
    return analysis.analyze(frames(spark, d), Thresholds(0.05), Flags(red=True))


@query("analysis", with_(ANALYSIS, """SELECT video_id, frame_idx, round((frame_idx - 1) / 30.0, 6) AS timestamp, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity, intensity > 0.05 AS is_flash, round(entropy, 6) AS entropy,
  round(red_intensity, 6) AS red_intensity, round(red_delta, 6) AS red_delta, frame_idx::BIGINT AS frames_analyzed FROM an"""))
def _analysis(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", "timestamp", "brightness", "intensity", "is_flash", "entropy", "red_intensity", "red_delta", "frames_analyzed")


@query("analysis_summary", with_(ANALYSIS, "SELECT video_id, count(*) AS frames, count_if(intensity > 0.05)::BIGINT AS flash_count, round(max(frame_idx - 1) / 30.0, 6) AS duration, 0::BIGINT AS violation_count, 0.3::DOUBLE AS cluster_gap FROM an GROUP BY 1"))
def _summary(spark, d):
    return analysis.summarize(analyzed(spark, d)).select("video_id", "frames", "flash_count", "duration", "violation_count", "cluster_gap")


@query("analysis_report", with_(ANALYSIS, "SELECT video_id, count(*) AS frame_count, count_if(intensity > 0.05)::BIGINT AS flash_count, round(count_if(intensity > 0.05) / (count(*) / 60.0), 6) AS average_flash_rate, round(count(*) / (max(frame_idx - 1) / 30.0), 6) AS frame_rate FROM an GROUP BY 1"))
def _report(spark, d):
    return analysis.report(analyzed(spark, d)).select("video_id", "frame_count", "flash_count", "average_flash_rate", "frame_rate")


@query("ndjson_rows", with_(FLAGGED, "SELECT to_json({'timestamp': frame_idx, 'video_id': video_id, 'is_flash': is_flash})::VARCHAR AS value FROM flagged"))
def _ndjson(spark, d):
    return sinks.ndjson_lines(flagged(spark, d).select(F.col("frame_idx").alias("timestamp"), "video_id", "is_flash"))


@query("chart_export", with_(FLAGGED, "SELECT frame_idx, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity FROM flagged"))
def _chart_export(spark, d):
    return explore.chart_columns(flagged(spark, d), "frame_idx", ["brightness", "intensity", "brightness"])


@query("union_of_chunks", with_(FLAGGED, "SELECT video_id, count(*) AS frames FROM (SELECT video_id FROM flagged WHERE is_flash UNION ALL SELECT video_id FROM flagged WHERE NOT is_flash) GROUP BY 1"))
def _union(spark, d):
    rows = flagged(spark, d)
    return rows.filter("is_flash").unionByName(rows.filter("not is_flash")).groupBy("video_id").agg(F.count("*").alias("frames"))
