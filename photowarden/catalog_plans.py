"""Queries over whole plans: every group of the composed analysis, summaries, exports read back, streams, and operators on
inputs that reach their branches. Same tables and rules as in `catalog`.

The SQL of the composed analysis is that of the single operators with its signal taken from the frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photowarden.catalog import (
    CLUSTERS, ORACLES, QUERIES, COHERENCE, COLORS, FLAGGED, GAP, HIST, PIXEL_CONTRAST, PIXELS, RATES, SIGNAL, SOBEL, W, WINDOWS, colors, fixed_sql, flagged, frames, lab_sql, metrics, query, signal, smooth_lin_sql, table, with_,
)
from photowarden.functions import color
from photowarden.operators import flash, frame_metrics, risk, spectral
from photowarden.params import Flags, Thresholds
from photowarden.plans import analysis
from photowarden.runtime import passing_folder
from photowarden.sources import documents, importers, sinks
from photowarden.sources.frames import frames_from_embeddings
from photowarden.streaming import live

__all__ = ["ORACLES", "QUERIES"]

#: The signal of the frames in place of the events'.
FRAME_SIGNAL = f"{PIXELS}, sig AS (SELECT video_id, frame_idx, (frame_idx - 1) / 30.0 AS ts, avg(lum) AS brightness FROM px GROUP BY 1, 2)"
LIMIT = 0.05


def of_frames(sql: str) -> str:
    return sql.replace(SIGNAL, FRAME_SIGNAL).replace("> 0.1 AS is_flash", f"> {LIMIT} AS is_flash")


def analyzed(spark: SparkSession, d: str) -> DataFrame:
    return analysis.analyze(frames(spark, d), Thresholds(LIMIT), Flags(red=True, temporal_contrast=True))


# ---- the composed analysis, group by group ------------------------------------------------------------------------------


@query("analysis_signal", with_(of_frames(FLAGGED), f""", co AS (SELECT video_id, frame_idx, avg(CASE WHEN lum > 0.5 THEN 1.0 ELSE 0.0 END) AS coverage FROM px GROUP BY 1, 2),
p AS (SELECT f.*, coverage, coalesce(count_if(is_flash) OVER (PARTITION BY f.video_id ORDER BY f.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, CASE WHEN is_flash THEN coalesce(ts - lag(ts) OVER (PARTITION BY f.video_id ORDER BY f.frame_idx), 0.0) END AS lasted
  FROM flagged f JOIN co ON f.video_id = co.video_id AND f.frame_idx = co.frame_idx),
q AS (SELECT *, least(n / (frame_idx / 60.0) / 3.0, 1.0) AS pf, least(intensity / 0.2, 1.0) AS pi, least(coalesce(last_value(lasted IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / 50.0, 1.0) AS pd,
  CASE WHEN intensity > {LIMIT} THEN ts END AS hit FROM p),
pr AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM q),
ga AS (SELECT *, CASE WHEN hit - prev > 0 AND hit - prev < 10 THEN hit - prev END AS gap FROM pr), me AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS m FROM ga)
SELECT video_id, frame_idx, round(ts, 6) AS relative_timestamp, round(intensity, 6) AS temporal_change, round(CASE WHEN m > 0 THEN least(1 / m, 100.0) ELSE 0.0 END, 6) AS flicker_frequency,
  round(pf, 6) AS frequency, round(pi, 6) AS intensity, round(coverage, 6) AS coverage, round(pd, 6) AS duration, round(brightness, 6) AS brightness, round(0.3 * pf + 0.25 * pi + 0.2 * coverage + 0.15 * pd + 0.1 * brightness, 6) AS score FROM me"""))
def _analysis_signal(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", "relative_timestamp", "temporal_change", "flicker_frequency", "psi.components.*", "psi.score")


@query("analysis_temporal", with_(of_frames(RATES), """, wi AS (SELECT video_id, frame_idx, list(brightness) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v FROM sig),
st2 AS (SELECT *, len(v) AS n, list_avg(v) AS m, list_var_pop(v) AS s FROM wi), pa AS (SELECT video_id, frame_idx, n, CASE WHEN s = 0 THEN 1e-8 ELSE s END AS s, k, i, (v[i] - m) * (v[i + k] - m) AS p FROM st2, unnest(range(1, 11)) AS t(k), unnest(range(1, 31)) AS u(i) WHERE k <= n - 1 AND i <= n - k),
co AS (SELECT video_id, frame_idx, k, sum(p) / ((any_value(n) - k) * any_value(s)) AS c FROM pa GROUP BY video_id, frame_idx, k), sc AS (SELECT video_id, frame_idx, avg(abs(c)) AS score, count(*)::INTEGER AS lags, max(c) FILTER (WHERE k = 1) AS first FROM co GROUP BY 1, 2)
SELECT c.video_id, c.frame_idx, round(current_rate, 6) AS current_rate, round(max(current_rate) OVER (PARTITION BY c.video_id ORDER BY c.frame_idx), 6) AS max_rate, round(coalesce(score, 0.0), 6) AS coherence_score, coalesce(lags, 0) AS lags, round(first, 6) AS first_lag
FROM cu c LEFT JOIN sc ON c.video_id = sc.video_id AND c.frame_idx = sc.frame_idx"""))
def _analysis_temporal(spark, d):
    rows = analyzed(spark, d).select("video_id", "frame_idx", "temporal_contrast.*", "temporal_coherence.*")
    return rows.select("video_id", "frame_idx", "current_rate", "max_rate", "coherence_score", F.size("lags").alias("lags"), F.get("lags", F.lit(0))["correlation"].alias("first_lag"))


_AVG = "CASE WHEN frame_idx >= 2 THEN avg(d{c}) OVER v ELSE 0.0 END"


@query("analysis_color", with_(COLORS + ", " + lab_sql("r", "g", "b", "col", "video_id, frame_idx, r, g, b", "lab"), """, cu AS (SELECT video_id, frame_idx, stddev_pop(r) / 255 AS cr, stddev_pop(g) / 255 AS cg, stddev_pop(b) / 255 AS cb, avg(abs(r - g) / sqrt(2)) / 255 AS rg, avg(abs(b - (r + g) / 2.0) / sqrt(6)) / 255 AS yb FROM px GROUP BY 1, 2),
dd AS (SELECT lab.*, cr, cg, cb, rg, yb, abs(r - lag(r) OVER w) AS dr, abs(g - lag(g) OVER w) AS dg, abs(b - lag(b) OVER w) AS db, sqrt(pow(l - lag(l) OVER w, 2) + pow(a - lag(a) OVER w, 2) + pow(bb - lag(bb) OVER w, 2)) AS de FROM lab JOIN cu ON lab.video_id = cu.video_id AND lab.frame_idx = cu.frame_idx WINDOW w AS (PARTITION BY lab.video_id ORDER BY lab.frame_idx)),
ch AS (SELECT *, """ + ", ".join(f"{_AVG.format(c=c)} AS a{c}, CASE WHEN frame_idx >= 2 THEN stddev_pop({c}) OVER w / CASE WHEN max({c}) OVER w > 1 THEN 255.0 ELSE 1.0 END ELSE 0.0 END AS t{c}" for c in "rgb") + """ FROM dd WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), v AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW))
SELECT video_id, frame_idx, round(cr, 6) AS current_r, round(cg, 6) AS current_g, round(cb, 6) AS current_b, round(tr, 6) AS temporal_r, round(tg, 6) AS temporal_g, round(tb, 6) AS temporal_b, round(ar, 6) AS change_r, round(ag, 6) AS change_g, round(ab, 6) AS change_b,
  round(sqrt(ar * ar + ag * ag + ab * ab), 6) AS magnitude, round(rg, 6) AS red_green, round(yb, 6) AS blue_yellow, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(l, 6) AS lab_l, round(a, 6) AS lab_a, round(bb, 6) AS lab_b, round(coalesce(de, 0.0), 6) AS cie76_delta FROM ch"""))
def _analysis_color(spark, d):
    v = "color_variance"
    named = {f"{to}_{c}": F.col(f"{v}.{group}.{c}") for group, to in (("current", "current"), ("temporal", "temporal"), ("average_change", "change")) for c in "rgb"}
    return analyzed(spark, d).select(
        "video_id", "frame_idx", *(c.alias(n) for n, c in named.items()), F.col("color_change_magnitude").alias("magnitude"), "chromatic_flashes.red_green", "chromatic_flashes.blue_yellow",
        "dominant_color.r", "dominant_color.g", "dominant_color.b", *(F.col(f"dominant_lab.{c}").alias(f"lab_{c.lower()}") for c in ("L", "a", "b")), "cie76_delta",
    )


@query("analysis_spikes", with_(COLORS, ", dd AS (" + " UNION ALL ".join(f"SELECT video_id, frame_idx, '{c}' AS channel, abs({c} - lag({c}) OVER {W}) / 255.0 AS d FROM col" for c in "rgb") + """), st AS (SELECT *, avg(d) OVER w AS m, stddev_pop(d) OVER w AS s, count(d) OVER w AS n FROM dd WINDOW w AS (PARTITION BY video_id, channel ORDER BY frame_idx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
hit AS (SELECT a.video_id, a.frame_idx, count(*) AS n FROM st a JOIN dd b ON a.video_id = b.video_id AND a.channel = b.channel AND b.frame_idx BETWEEN a.frame_idx - 28 AND a.frame_idx AND b.d > 0.2 AND b.d > a.m + 2 * a.s WHERE a.n >= 2 GROUP BY ALL)
SELECT v.video_id, v.frame_idx, coalesce(n, 0)::INTEGER AS spikes FROM col v LEFT JOIN hit h ON v.video_id = h.video_id AND v.frame_idx = h.frame_idx"""))
def _analysis_spikes(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", F.size("color_variance.spikes").alias("spikes"))


@query("analysis_contrast", with_(PIXEL_CONTRAST, """SELECT video_id, frame_idx, floor(least(100.0, m / 2.3 * 100) * 100 + 0.5) / 100 AS sensitivity, floor(s * 100 + 0.5) / 100 AS fluctuations, floor(m * 100 + 0.5) / 100 AS average_delta_e, floor(x * 100 + 0.5) / 100 AS max_delta_e, hits AS significant_changes, 64::BIGINT AS total_samples,
  floor(hits / 63.0 * 10000 + 0.5) / 100 AS fluctuation_rate, floor(w * 100 + 0.5) / 100 AS weighted_average_delta_e, 50::BIGINT AS window_size, 0.1::DOUBLE AS weight_decay, floor(s / m * 1000 + 0.5) / 1000 AS coefficient_of_variation, floor(q50 * 100 + 0.5) / 100 AS median_delta_e, floor(q90 * 100 + 0.5) / 100 AS p90_delta_e, floor(q95 * 100 + 0.5) / 100 AS p95_delta_e FROM ag"""))
def _analysis_contrast(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", "contrast_sensitivity.*")


_DISC = "(x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0) < 1.6 * 1.6"


@query("analysis_space", with_(SOBEL, f""", sp AS (SELECT video_id, frame_idx, avg(lum) FILTER (WHERE {_DISC}) AS center, avg(lum) FILTER (WHERE NOT ({_DISC})) AS periphery, {", ".join(f"avg(lum) FILTER (WHERE (CASE WHEN x < 4 THEN 0 ELSE 1 END) + (CASE WHEN y < 4 THEN 0 ELSE 2 END) = {k}) AS q{k}" for k in range(4))} FROM px GROUP BY 1, 2),
ed AS (SELECT video_id, frame_idx, count_if(m * 255 > 50) AS n FROM so GROUP BY 1, 2), ec AS (SELECT *, abs(n - lag(n) OVER {W}) / 36.0 AS d FROM ed),
df AS (SELECT a.video_id, a.frame_idx, abs(a.r - coalesce(b.r, 0)) + abs(a.g - coalesce(b.g, 0)) + abs(a.b - coalesce(b.b, 0)) AS d FROM px a LEFT JOIN px b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx + 1 AND a.pos = b.pos),
ds AS (SELECT video_id, frame_idx, sum(d) / (64 * 765.0) AS difference, avg(CASE WHEN d > 76.5 THEN 1.0 ELSE 0.0 END) AS motion FROM df GROUP BY 1, 2)
SELECT s.video_id, s.frame_idx, round(center, 6) AS center, round(periphery, 6) AS periphery, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(n / 36.0, 6) AS edge_density, n::BIGINT AS edge_count, round(coalesce(e.d, 0.0), 6) AS temporal_edge_change, round(difference, 6) AS difference, round(motion, 6) AS motion
FROM sp s JOIN ec e ON s.video_id = e.video_id AND s.frame_idx = e.frame_idx JOIN ds ON s.video_id = ds.video_id AND s.frame_idx = ds.frame_idx"""))
def _analysis_space(spark, d):
    quarters = [F.get("spatial_map.quadrants", F.lit(k)).alias(f"q{k}") for k in range(4)]
    return analyzed(spark, d).select("video_id", "frame_idx", "spatial_map.center", "spatial_map.periphery", *quarters, "edge_detection.*", "frame_difference.*")


@query("analysis_scene", with_(HIST, """, pa AS (SELECT video_id, frame_idx, bin, n AS a, 0 AS b FROM hi UNION ALL SELECT video_id, frame_idx + 1, bin, 0, n FROM hi), su AS (SELECT video_id, frame_idx, bin, sum(a) AS a, sum(b) AS b FROM pa GROUP BY ALL)
SELECT f.video_id, f.frame_idx, round(CASE WHEN f.frame_idx = 1 THEN 0.0 ELSE coalesce(sum(abs(a - b)) FILTER (WHERE a <> b) / sum(a + b) FILTER (WHERE a <> b), 0.0) END, 6) AS scene_change_score FROM fr f JOIN su s ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx GROUP BY f.video_id, f.frame_idx"""))
def _analysis_scene(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", "scene_change_score")


@query("analysis_red", with_(COLORS + ", " + lab_sql("r", "g", "b", "col", "video_id, frame_idx, ts, r, g, b", "lab"), f""", ra AS (
  SELECT *, greatest(0, least(1, CASE WHEN a > 30 AND sqrt(a * a + bb * bb) > 35 AND r - greatest(g, b) > 60 AND r / 255 > 0.7 THEN greatest(0.3, least(r / 255, 1.0)) ELSE least(r / 255 * 0.05, 0.1) END)) AS area FROM lab
), ro AS (SELECT *, (area >= 0.25)::INTEGER AS on_ FROM ra), rt AS (SELECT *, CASE WHEN on_ <> lag(on_) OVER {W} THEN 1 ELSE 0 END AS tr FROM ro),
wi AS (SELECT *, count(*) OVER w AS n, avg(area) OVER w AS av, max(area) OVER w AS mx, avg(on_) OVER w AS fr, sum(tr) OVER w - first_value(tr) OVER w AS t, ts - min(ts) OVER w AS sec FROM rt WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
ev AS (SELECT *, CASE WHEN n >= 5 THEN t ELSE 0 END AS trans, floor(CASE WHEN n >= 5 THEN t ELSE 0 END / 2.0) AS events FROM wi), rr AS (SELECT *, CASE WHEN events > 0 AND sec > 0 THEN least(events / sec, 60.0) ELSE 0.0 END AS rate FROM ev)
SELECT video_id, frame_idx, floor(CASE WHEN n >= 5 THEN av ELSE area END * 1000 + 0.5) / 1000 AS red_area_avg, floor(CASE WHEN n >= 5 THEN mx ELSE area END * 1000 + 0.5) / 1000 AS red_area_max, floor(CASE WHEN n >= 5 THEN fr ELSE on_ END * 1000 + 0.5) / 1000 AS red_on_fraction,
  trans::BIGINT AS red_transitions, events::BIGINT AS red_flash_events, floor(rate * 1000 + 0.5) / 1000 AS red_flash_per_second, rate BETWEEN 3 AND 30 AS red_flicker_in_risk_band, 0.25::DOUBLE AS red_area_threshold_used,
  floor(CASE WHEN n >= 5 THEN sec ELSE 0 END * 1000 + 0.5)::BIGINT AS window_duration_ms, on_ AS red_state, tr AS red_transition FROM rr"""))
def _analysis_red(spark, d):
    return analyzed(spark, d).select("video_id", "frame_idx", "red_metrics.*", "red_state", "red_transition")


# ---- the risk classifier with every input alive -------------------------------------------------------------------------

_NEAR = "greatest(0, least(1, ({x} - 0.8 * {e}) / ({e} - 0.8 * {e})))"


def risk_sql(inputs: str) -> str:
    """CTEs up to le from flagged; inputs: SQL of psi, cover, red, rg, yb, hz and pat over the rows of flagged."""
    reach = lambda p, a, c, r, rd, ch, pt: f"psi >= {p} OR ai >= {a} OR cover >= {c} OR red >= {r} OR rdelta >= {rd} OR greatest(rg, yb) >= {ch} OR pat >= {pt} OR (hz BETWEEN 3 AND 30 AND (ai >= {a} OR cover >= {c}))"
    return f""", pk AS (SELECT f.*, {inputs}, CASE WHEN is_flash THEN count(*) OVER (PARTITION BY f.video_id, is_flash ORDER BY f.ts RANGE BETWEEN 1.0 PRECEDING AND CURRENT ROW) END AS n FROM rows_ f),
cu AS (SELECT *, count_if(is_flash) OVER {W} AS flashes, coalesce(avg(intensity) FILTER (WHERE is_flash AND intensity BETWEEN 0 AND 1) OVER {W}, 0.0) AS ai, coalesce(max(n) OVER {W}, 0) AS peak, count_if(n > 3) OVER {W} AS overs, coalesce(abs(red - lag(red) OVER {W}), 0.0) AS rdelta FROM pk),
ad AS (SELECT *, CASE WHEN flashes > 1 THEN peak ELSE 0 END AS mf, CASE WHEN flashes > 1 THEN overs ELSE 0 END AS sv FROM cu),
de AS (SELECT *, greatest(0, least(1, 0.4 * greatest({_NEAR.format(x='ai', e='0.8')}, {_NEAR.format(x='cover', e='0.25')}) + 0.25 * {_NEAR.format(x='psi', e='0.8')} + 0.25 * greatest(0, least(1, (mf - 1) / 2.0))
  + 0.1 * CASE WHEN hz BETWEEN 3 AND 18 THEN greatest(0, least(1, 1 - (18 - hz) / 15.0)) WHEN hz BETWEEN 18 AND 30 THEN greatest(0, least(1, 1 - (hz - 18) / 12.0)) ELSE 0 END)) AS add FROM ad),
RECURSIVE_STEPS AS (SELECT video_id, frame_idx, 0.05 * add AS debt FROM de WHERE frame_idx = 1 UNION ALL SELECT d.video_id, d.frame_idx, 0.95 * r.debt + 0.05 * d.add FROM RECURSIVE_STEPS r JOIN de d ON d.video_id = r.video_id AND d.frame_idx = r.frame_idx + 1),
wt AS (SELECT d.*, debt, 0.7 * psi + 0.2 * greatest(0, least(1, greatest(rdelta * 1.5, red, rg, yb))) + 0.1 * pat AS weighted FROM de d JOIN RECURSIVE_STEPS r ON d.video_id = r.video_id AND d.frame_idx = r.frame_idx),
ra AS (SELECT *, CASE WHEN NOT (flashes > 1 AND frame_idx > 1) THEN 0 WHEN {reach(0.8, 0.8, 0.25, 0.8, 0.6, 0.8, 0.8)} OR mf > 3 OR sv > 0 THEN 2 WHEN {reach(0.65, 0.6, 0.15, 0.5, 0.4, 0.5, 0.5)} THEN 1 WHEN weighted >= 0.75 THEN 2 WHEN weighted >= 0.5 THEN 1 ELSE 0 END AS base FROM wt),
le AS (SELECT *, CASE WHEN debt >= 0.85 THEN 2 WHEN debt >= 0.6 THEN greatest(base, 1) ELSE base END AS rank FROM ra)"""


_LIVE = "0.75 * brightness AS psi, 0.2 * brightness * brightness AS cover, 0.7 * brightness AS red, (frame_idx % 11) / 13.0 AS rg, (frame_idx % 7) / 9.0 AS yb, (frame_idx % 40)::DOUBLE AS hz, (frame_idx % 13) / 15.5 AS pat"


@query("risk_inputs", with_(FLAGGED + ", rows_ AS (SELECT * FROM flagged)" + risk_sql(_LIVE), f"SELECT video_id, frame_idx, round(rdelta, 6) AS red_delta, mf::BIGINT AS max_flashes, round(debt, 6) AS risk_debt, ['low', 'medium', 'high'][rank + 1] AS base_level, ['low', 'medium', 'high'][max(rank) OVER {W} + 1] AS risk_level FROM le"))
def _risk_inputs(spark, d):
    b, k = F.col("brightness"), F.col("frame_idx")
    live_inputs = {"psi_score": 0.75 * b, "coverage": 0.2 * b * b, "red": 0.7 * b, "chroma_rg": (k % 11) / 13.0, "chroma_by": (k % 7) / 9.0, "flicker_hz": (k % 40).cast("double"), "pattern": (k % 13) / 15.5}
    rows = risk.risk_levels(risk.with_flash_peaks(flagged(spark, d).withColumns(live_inputs)))
    return rows.select("video_id", "frame_idx", "red_delta", F.col("max_flashes").cast("long").alias("max_flashes"), "risk_debt", "base_level", "risk_level")


# ---- spectra ------------------------------------------------------------------------------------------------------------

_WINDOWED = """wi AS (SELECT video_id, frame_idx, list(brightness) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS v FROM sig),
h AS (SELECT video_id, frame_idx, i, (v[i + 1] - list_median(v)) * 0.5 * (1 - cos(2 * pi() * i / 63)) AS s FROM wi, unnest(range(64)) AS t(i) WHERE len(v) = 64),
z AS (SELECT video_id, frame_idx, k, sum(s * cos(2 * pi() * k * i / 64)) AS re, -sum(s * sin(2 * pi() * k * i / 64)) AS im FROM h, unnest(range(32)) AS t(k) GROUP BY ALL),
am AS (SELECT *, sqrt(re * re + im * im) * 2 / 31.5 AS a, atan2(im, re) AS ph FROM z)"""


@query("signal_spectra", f"""WITH {SIGNAL}, {_WINDOWED}, a AS (SELECT * FROM am WHERE k BETWEEN 3 AND 31), b AS (SELECT video_id, frame_idx, arg_max(k, a) AS kk, max(a) AS top, arg_max(ph, a) AS ph FROM a GROUP BY 1, 2),
n AS (SELECT a.video_id, a.frame_idx, avg(a.a * a.a) AS noise FROM a JOIN b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.k BETWEEN kk - 4 AND kk + 4 AND a.k <> kk GROUP BY 1, 2),
f AS (SELECT a.video_id, a.frame_idx, exp(avg(ln(a.a * a.a + greatest(1e-20, 1e-12 * top * top)))) / avg(a.a * a.a) AS flat FROM a JOIN b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx GROUP BY 1, 2),
m AS (SELECT b.*, noise, flat, b.ph - p.ph - 2 * pi() * kk / 64 AS moved FROM b JOIN n USING (video_id, frame_idx) JOIN f USING (video_id, frame_idx) LEFT JOIN am p ON p.video_id = b.video_id AND p.frame_idx = b.frame_idx - 1 AND p.k = kk)
SELECT s.video_id, s.frame_idx, round(coalesce(kk * 60 / 64.0, 0.0), 6) AS dominant_frequency, round(coalesce(kk * 60 / 64.0 + coalesce((moved + pi() - 2 * pi() * floor((moved + pi()) / (2 * pi())) - pi()) * 60 / (2 * pi()), 0.0), 0.0), 6) AS dominant_inst_freq, round(coalesce(flat, 0.0), 6) AS spectral_flatness,
  round(coalesce(10 * log10(top * top / greatest(noise, 1e-12)), 0.0), 6) AS confidence, round(CASE WHEN kk IS NULL THEN 0.0 ELSE 60 / 64.0 END, 6) AS bin_resolution, least(s.frame_idx, 64)::INTEGER AS window_size FROM sig s LEFT JOIN m ON s.video_id = m.video_id AND s.frame_idx = m.frame_idx""")
def _signal_spectra(spark, d):
    return spectral.spectra(signal(spark, d)).drop("amplitude", "phase", "ts", "brightness")


@query("spectrum_bins", f"WITH {SIGNAL}, {_WINDOWED} SELECT video_id, frame_idx, k::INTEGER AS bin, round(re * CASE WHEN k = 0 THEN 1 ELSE 2 END / 31.5, 6) AS re, round(im * CASE WHEN k = 0 THEN 1 ELSE 2 END / 31.5, 6) AS im FROM am WHERE k > 0")
def _spectrum_bins(spark, d):
    """Amplitude and phase of every bin, as a complex number."""
    rows = spectral.spectra(signal(spark, d)).select("video_id", "frame_idx", F.posexplode(F.arrays_zip("amplitude", "phase")).alias("bin", "p")).filter("bin > 0")
    return rows.select("video_id", "frame_idx", "bin", (F.col("p.amplitude") * F.cos("p.phase")).alias("re"), (F.col("p.amplitude") * F.sin("p.phase")).alias("im"))


@query("padded_spectra", """WITH v AS (SELECT vec_id, list_transform(embedding[1:50], lambda x: x::DOUBLE) AS v FROM embeddings), h AS (SELECT vec_id, i, (v[i + 1] - list_median(v)) * 0.5 * (1 - cos(2 * pi() * i / 49)) AS s FROM v, unnest(range(50)) AS t(i)),
z AS (SELECT vec_id, k, sum(s * cos(2 * pi() * k * i / 64)) AS re, -sum(s * sin(2 * pi() * k * i / 64)) AS im FROM h, unnest(range(32)) AS t(k) GROUP BY 1, 2), a AS (SELECT vec_id, k, sqrt(re * re + im * im) * 2 / 24.5 AS a FROM z WHERE k BETWEEN 3 AND 31),
b AS (SELECT vec_id, arg_max(k, a) AS kk, max(a) AS top FROM a GROUP BY 1), n AS (SELECT a.vec_id, any_value(top) AS top, avg(a.a * a.a) AS noise FROM a JOIN b ON a.vec_id = b.vec_id AND a.k BETWEEN kk - 4 AND kk + 4 AND a.k <> kk GROUP BY 1),
f AS (SELECT a.vec_id, exp(avg(ln(a.a * a.a + greatest(1e-20, 1e-12 * top * top)))) / avg(a.a * a.a) AS flat FROM a JOIN b ON a.vec_id = b.vec_id GROUP BY 1)
SELECT b.vec_id, round(kk * 60 / 64.0, 6) AS dominant_frequency, round(flat, 6) AS spectral_flatness, round(10 * log10(n.top * n.top / greatest(noise, 1e-12)), 6) AS confidence FROM b JOIN n ON b.vec_id = n.vec_id JOIN f ON b.vec_id = f.vec_id""")
def _padded(spark, d):
    """Fifty values, padded with zeros to 64."""
    return spectral.vector_spectra(table(spark, d, "embeddings"), F.transform(F.slice("embedding", 1, 50), lambda x: x.cast("double")), "vec_id")


# ---- pixels -------------------------------------------------------------------------------------------------------------


@query("edge_map", with_(SOBEL, "SELECT video_id, frame_idx, (y * 8 + x)::INTEGER AS pos FROM so WHERE m * 255 > 50"))
def _edge_map(spark, d):
    """Places of the edge pixels in the map of each frame."""
    rows = metrics(spark, d, "edge_map").withColumn("h", F.hex("edge_map"))
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring("h", i * 2 + 1, F.lit(2)) == "FF")
    return rows.select("video_id", "frame_idx", F.explode(at).alias("pos"))


@query("pixel_sampling", with_(PIXELS, """, wide AS (SELECT video_id, frame_idx, bytes[p % 64 + 1] * 2 - 100 AS r, bytes[(p % 64 + 21) % 64 + 1] AS g, bytes[(p % 64 + 42) % 64 + 1] AS b FROM fr, unnest(range(2304)) AS t(p) WHERE p % (2304 // 1024) = 0)
SELECT video_id, frame_idx, count(*) AS pixels, sum(r)::BIGINT AS red, sum(g)::BIGINT AS green FROM wide WHERE b >= 64 AND r BETWEEN 0 AND 255 GROUP BY 1, 2"""))
def _pixel_sampling(spark, d):
    """Frames of 48x48: every second pixel, without the transparent ones (blue below 64) and those with a false red."""
    wide = frames(spark, d).withColumns({"width": F.lit(48), "height": F.lit(48), "rgba": F.unhex(F.repeat(F.hex("rgba"), 36))})
    px = frame_metrics.sampled_pixels(frame_metrics.pixels(wide), 48 * 48)
    px = px.withColumns({"a": F.when(F.col("b") < 64, 0).otherwise(F.col("a")), "r": F.col("r") * 2 - 100}).filter("a <> 0")
    return frame_metrics.require_rgb(frame_metrics.valid_pixels(px)).groupBy("video_id", "frame_idx").agg(F.count("*").alias("pixels"), F.sum("r").alias("red"), F.sum("g").alias("green"))


@query("luminance255", with_(COLORS, f"SELECT video_id, frame_idx, round(255 * (0.2126 * {smooth_lin_sql('r')} + 0.7152 * {smooth_lin_sql('g')} + 0.0722 * {smooth_lin_sql('b')}), 6) AS luminance FROM col"))
def _luminance255(spark, d):
    return colors(spark, d).select("video_id", "frame_idx", color.luminance255(F.col("r"), F.col("g"), F.col("b")).alias("luminance"))


# ---- summaries and reports ----------------------------------------------------------------------------------------------

#: The events' signal with times from each video's start.
RELATIVE = SIGNAL.replace("epoch_us(ts) / 1e6 / 259200.0 AS ts", "epoch_us(ts) / 1e6 / 259200.0 - min(epoch_us(ts) / 1e6 / 259200.0) OVER (PARTITION BY user_id) AS ts")


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Analysis rows of the events' signal."""
    rows = flagged(spark, d).withColumn("relative_timestamp", F.col("ts") - F.min("ts").over(analysis.so_far()))
    return risk.with_psi(rows).withColumn("risk_level", F.when(F.col("frame_idx") > 5, "high").otherwise("low"))


@query("signal_summary", with_(WINDOWS.replace(SIGNAL, RELATIVE), f""", per AS (SELECT video_id, count(*) AS n, sum(frame_count) AS f, sum(duration) AS t FROM violations GROUP BY 1),
c0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER {W} <= {GAP} THEN 0 ELSE 1 END AS fresh FROM flagged WHERE is_flash), c1 AS (SELECT *, (sum(fresh) OVER {W})::INTEGER AS cluster_id FROM c0),
cl AS (SELECT video_id, cluster_id, min(ts) AS s, max(ts) AS e, count(*) AS k FROM c1 GROUP BY ALL), cs AS (SELECT video_id, count(*) AS clusters, max(k) AS biggest, CASE WHEN max(e) - min(s) > 0 THEN sum(k) / (max(e) - min(s)) ELSE 0.0 END AS density FROM cl GROUP BY 1)
SELECT b.video_id, count(*) AS frames, count_if(is_flash)::BIGINT AS flash_count, round(max(ts), 6) AS duration, CASE WHEN count(*) > 5 THEN 'high' ELSE 'low' END AS risk_level, coalesce(any_value(n), 0)::BIGINT AS violation_count, coalesce(any_value(f), 0)::BIGINT AS dangerous_frames,
  round(coalesce(any_value(f), 0) / count(*) * 100, 6) AS dangerous_frame_percent, round(coalesce(any_value(t), 0.0), 6) AS dangerous_time, round(CASE WHEN max(ts) - min(ts) > 0 THEN coalesce(any_value(t), 0.0) / (max(ts) - min(ts)) * 100 ELSE 0.0 END, 6) AS dangerous_time_percent,
  coalesce(any_value(clusters), 0)::BIGINT AS cluster_count, coalesce(any_value(biggest), 0)::BIGINT AS max_size, round(coalesce(any_value(density), 0.0), 6) AS density FROM flagged b LEFT JOIN per p ON b.video_id = p.video_id LEFT JOIN cs ON b.video_id = cs.video_id GROUP BY b.video_id"""))
def _signal_summary(spark, d):
    names = ("video_id", "frames", "flash_count", "duration", "risk_level", "violation_count", "dangerous_frames", "dangerous_frame_percent", "dangerous_time", "dangerous_time_percent", "cluster_count", "max_size", "density")
    return analysis.summarize(event_rows(spark, d)).select(*names)


_REPORT = with_(CLUSTERS.replace(SIGNAL, RELATIVE), "{}")


@query("cluster_report", _REPORT.format(f"SELECT video_id, count(*) AS cluster_count, sum(count)::BIGINT AS flashes, {fixed_sql('avg(count)', 2)} AS avg_size, max(count) AS max_size, {fixed_sql('median(count)', 2)} AS median_size, {fixed_sql('CASE WHEN max(end_time) - min(start_time) > 0 THEN sum(count) / (max(end_time) - min(start_time)) ELSE 0.0 END', 2)} AS density FROM clusters GROUP BY 1"))
def _cluster_report(spark, d):
    return analysis.cluster_report(event_rows(spark, d), GAP).select("video_id", "cluster_count", "flashes", "avg_size", "max_size", "median_size", "density")


@query("cluster_list", _REPORT.format("SELECT video_id, cluster_id, printf('%.3f', start_time) AS start_time, printf('%.3f', end_time) AS end_time, printf('%.3f', end_time - start_time) AS duration, start_frame, end_frame, count FROM clusters"))
def _cluster_list(spark, d):
    return analysis.cluster_report(event_rows(spark, d), GAP).select("video_id", F.inline("clusters"))


# ---- exports read back --------------------------------------------------------------------------------------------------


def _new_folder(spark: SparkSession) -> str:
    return passing_folder(spark, "export")


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("video_id", "frame_idx", F.col("ts").alias("timestamp"), "brightness", "intensity", "is_flash")


_ROWS = with_(FLAGGED, "SELECT video_id, frame_idx, round(ts, 6) AS timestamp, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity, is_flash FROM flagged WHERE ts >= 0")


@query("csv_export", with_(FLAGGED, "SELECT round(round(ts, 6), 6) AS timestamp, round(round(brightness, 4), 6) AS brightness, is_flash::INTEGER::BIGINT AS is_flash, 79 AS columns FROM flagged WHERE ts >= 0"))
def _csv_export(spark, d):
    """The CSV contract's file, read back: its columns, and the ones with data."""
    path = _new_folder(spark)
    sinks.write_csv(_plain(spark, d), path, red=True, temporal_contrast=True)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("Timestamp").cast("double").alias("timestamp"), F.col("Brightness").cast("double").alias("brightness"), F.col("`Flash Detected`").cast("long").alias("is_flash"), F.lit(len(back.columns)).alias("columns"))


@query("ndjson_import", _ROWS)
def _ndjson_import(spark, d):
    path, rows = _new_folder(spark), _plain(spark, d)
    sinks.write_ndjson(rows, path)
    return importers.read_ndjson(spark, path, rows.schema)


@query("json_import", _ROWS)
def _json_import(spark, d):
    """Documents of videos with metadata and rows, read back with the importer of whole files."""
    path, rows = _new_folder(spark), _plain(spark, d)
    sinks.write_json(rows.withColumn("by", F.col("video_id")), path, "by")
    return importers.read_json_documents(spark, path, rows.schema)


@query("chart_import", with_(FLAGGED, "SELECT frame_idx, round(brightness, 6) AS brightness, round(intensity, 6) AS intensity FROM flagged"))
def _chart_import(spark, d):
    """Columns of charts exported as JSON arrays, read back."""
    path = _new_folder(spark)
    out = sinks.export_charts(_plain(spark, d), [("frame_idx", ["brightness"]), ("frame_idx", ["intensity", "brightness"])], path, ("json", "csv", "ndjson"))
    return importers.read_json_document(spark, f"{path}/json", out.schema)


def _reports(spark, d, rows: DataFrame, **options) -> str:
    path = _new_folder(spark)
    documents.write_reports(rows, path, made_at="2024-01-01T00:00:00.000Z", **options)
    return path


#: Rows whose documents are on disk at once in the two queries below; a row's entry takes 1.4 KB.
REPORT_ROWS = 4_000_000


def _event_reports(spark, d, read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` makes of the documents of all videos. They are written, read and removed by groups of videos, so that disk
    holds those of about REPORT_ROWS rows; a group has whole videos."""
    rows, out = _new_folder(spark), _new_folder(spark)
    made = event_rows(spark, d).withColumn("timestamp", F.col("ts"))
    groups = max(1, -(-table(spark, d, "events").count() // REPORT_ROWS))
    made = made.withColumn("_group", F.pmod(F.xxhash64("video_id"), F.lit(groups)).cast("int"))
    made.write.partitionBy("_group").parquet(rows)
    kept = spark.read.schema(made.schema).parquet(rows)
    for g in sorted(r[0] for r in kept.select("_group").distinct().collect()) or [0]:
        path = _reports(spark, d, kept.filter(F.col("_group") == g).drop("_group"))
        found = read(path)
        found.write.mode("append").parquet(out)
        documents.remove(path)
    return spark.read.schema(found.schema).parquet(out)


@query("report_metadata", with_(FLAGGED, """SELECT video_id::VARCHAR AS video_title, '2024-01-01T00:00:00.000Z' AS analysis_date, count(*) AS total_frames_analyzed, count_if(is_flash)::BIGINT AS total_flashes_detected,
  CASE WHEN count(*) > 5 THEN 'high' ELSE 'low' END AS risk_level, false AS red_metrics_enabled, false AS temporal_contrast_enabled, 0.0::DOUBLE AS spectral_bin_resolution, count(*) AS entries FROM flagged GROUP BY video_id"""))
def _report_metadata(spark, d):
    """The metadata of each video's document, and how many entries it has, read as whole documents."""
    meta = "struct<videoTitle: string, analysisDate: string, totalFramesAnalyzed: bigint, totalFlashesDetected: bigint, riskLevel: string, redMetricsEnabled: boolean, temporalContrastEnabled: boolean, spectralBinResolution: double>"
    schema = f"metadata {meta}, analysis array<struct<timestamp: string>>, colorHistory struct<r: array<double>>"
    names = ("video_title", "analysis_date", "total_frames_analyzed", "total_flashes_detected", "risk_level", "red_metrics_enabled", "temporal_contrast_enabled", "spectral_bin_resolution")

    def read(path: str) -> DataFrame:
        back = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        return back.select("metadata.*", F.size("analysis").cast("long").alias("entries")).toDF(*names, "entries")

    return _event_reports(spark, d, read)


@query("report_entries", with_(FLAGGED, "SELECT round(ts, 6) AS timestamp, round(round(brightness, 4), 6) AS brightness, is_flash, round(round(intensity, 4), 6) AS intensity, 0.0::DOUBLE AS entropy, 0::BIGINT AS edge_count FROM flagged WHERE ts >= 0"))
def _report_entries(spark, d):
    """The entries of all documents, read in many ranges of bytes."""
    schema = T.StructType.fromDDL("timestamp string, brightness string, isFlash boolean, intensity string, entropy string, edgeDetection struct<count: bigint>")

    def read(path: str) -> DataFrame:
        back = documents.read_rows(spark, path, schema, 5_000)
        return back.select(F.col("timestamp").cast("double").alias("timestamp"), F.col("brightness").cast("double").alias("brightness"), F.col("isFlash").alias("is_flash"), F.col("intensity").cast("double").alias("intensity"), F.col("entropy").cast("double").alias("entropy"), F.col("edgeDetection.count").alias("edge_count"))

    return _event_reports(spark, d, read)


@query("report_history", with_(COLORS, """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx DESC) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM col)
SELECT video_id::VARCHAR AS video_title, (least(n, 30) - k)::INTEGER AS place, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM o WHERE k <= 30"""))
def _report_history(spark, d):
    """The colour history of each video's document."""
    path = _reports(spark, d, analyzed(spark, d), red=True, temporal_contrast=True)
    back = spark.read.schema("metadata struct<videoTitle: string>, colorHistory struct<r: array<double>, g: array<double>, b: array<double>>").option("multiLine", True).json(path)
    each = back.select(F.col("metadata.videoTitle").alias("video_title"), F.posexplode(F.arrays_zip("colorHistory.r", "colorHistory.g", "colorHistory.b")).alias("place", "c"))
    return each.select("video_title", "place", "c.r", "c.g", "c.b")


@query("exported_formats", with_(FLAGGED, "SELECT unnest(['csv', 'json', 'ndjson', 'summary']) AS format, unnest([count(*), count(*), count(*), count(DISTINCT video_id)]) AS n FROM flagged WHERE ts >= 0"))
def _exported_formats(spark, d):
    path, rows = _new_folder(spark), _plain(spark, d)
    summary = analysis.short_summary(analysis.summarize(event_rows(spark, d)))
    sinks.export_selected(rows, path, csv=True, json=True, ndjson=True, summary=summary)
    counts = [
        spark.read.option("header", True).csv(f"{path}/csv").agg(F.count("*").alias("n")), importers.read_json_documents(spark, f"{path}/json", rows.schema).agg(F.count("*").alias("n")),
        importers.read_ndjson(spark, f"{path}/ndjson", rows.schema).agg(F.count("*").alias("n")), spark.read.json(f"{path}/summary").agg(F.count("*").alias("n")),
    ]
    named = [c.select(F.lit(f).alias("format"), "n") for f, c in zip(("csv", "json", "ndjson", "summary"), counts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


# ---- transparent pixels -------------------------------------------------------------------------------------------------


def _clear_frames(spark, d) -> DataFrame:
    return frames_from_embeddings(table(spark, d, "embeddings"), transparent_below=96)


CLEAR = PIXELS + ", cl AS (SELECT *, b < 96 AS clear, least(31, floor(floor(lum * 255) / 8))::INTEGER AS bin, greatest(0, least(255, floor(lum * 255 + 0.5))) AS shade FROM px), se AS (SELECT * FROM cl WHERE NOT clear)"


@query("transparent_kernels", with_(CLEAR, """, eh AS (SELECT video_id, frame_idx, shade, count(*) AS c FROM se GROUP BY ALL), ep AS (SELECT *, c / sum(c) OVER (PARTITION BY video_id, frame_idx) AS p FROM eh), en AS (SELECT video_id, frame_idx, -sum(p * log2(p)) AS entropy FROM ep GROUP BY 1, 2),
of AS (SELECT video_id, frame_idx, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(abs(r - g)) / sqrt(2) / 255 AS red_green, avg(abs(b - (r + g) / 2.0)) / sqrt(6) / 255 AS blue_yellow FROM se GROUP BY 1, 2)
SELECT f.video_id, f.frame_idx, round(coalesce(r, 0.0), 6) AS r, round(coalesce(g, 0.0), 6) AS g, round(coalesce(b, 0.0), 6) AS b, round(coalesce(entropy, 0.0), 6) AS entropy, round(coalesce(red_green, 0.0), 6) AS red_green, round(coalesce(blue_yellow, 0.0), 6) AS blue_yellow
FROM fr f LEFT JOIN of USING (video_id, frame_idx) LEFT JOIN en USING (video_id, frame_idx)"""))
def _transparent_kernels(spark, d):
    rows = frame_metrics.frame_metrics(_clear_frames(spark, d), ["dominant_color", "entropy", "chromatic"])
    return rows.select("video_id", "frame_idx", "dominant_color.*", "entropy", "chromatic.*")


@query("transparent_palette", with_(CLEAR, ", k AS (SELECT video_id, frame_idx, r // 32 * 32 AS r, g // 32 * 32 AS g, b // 32 * 32 AS b, count(*) AS n FROM se GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY n DESC, r, g, b)::INTEGER AS place FROM k) SELECT video_id, frame_idx, place, r, g, b, n FROM o WHERE place <= 5"))
def _transparent_palette(spark, d):
    rows = frame_metrics.frame_metrics(_clear_frames(spark, d), ["palette"]).select("video_id", "frame_idx", F.posexplode("palette").alias("p", "c"))
    return rows.select("video_id", "frame_idx", (F.col("p") + 1).alias("place"), "c.r", "c.g", "c.b", F.col("c.count").alias("n"))


@query("transparent_scene_change", with_(CLEAR, """, pr AS (SELECT a.video_id, a.frame_idx, a.bin AS now, b.bin AS before FROM cl a JOIN cl b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx + 1 AND a.pos = b.pos WHERE NOT (a.clear AND b.clear)),
hb AS (SELECT video_id, frame_idx, bin, sum(a) AS a, sum(b) AS b FROM (SELECT video_id, frame_idx, now AS bin, 1 AS a, 0 AS b FROM pr UNION ALL SELECT video_id, frame_idx, before, 0, 1 FROM pr) GROUP BY ALL),
sc AS (SELECT video_id, frame_idx, sum(abs(a - b)) FILTER (WHERE a <> b) / sum(a + b) FILTER (WHERE a <> b) AS s FROM hb GROUP BY 1, 2)
SELECT f.video_id, f.frame_idx, round(coalesce(s, 0.0), 6) AS scene_change FROM fr f LEFT JOIN sc USING (video_id, frame_idx)"""))
def _transparent_scene_change(spark, d):
    """A pixel that is transparent in one of two frames only counts in both histograms."""
    return frame_metrics.scene_change(_clear_frames(spark, d)).drop("ts")


# ---- streams ------------------------------------------------------------------------------------------------------------


#: Most micro-batches of the stream below: each costs some tenths of a second a state partition, however many rows it has.
LIVE_BATCHES = 4


@query("live_violations", with_(WINDOWS, "SELECT video_id::VARCHAR AS video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame, flash_count::BIGINT AS flash_count FROM closed WHERE flash_count > 3"))
def _live_violations(spark, d):
    """Closed windows from a stream of the signal, kept batch by batch by the Parquet sink. A file has videos from their
    beginning, so the watermark stays behind all of them."""
    path = _new_folder(spark)
    signal(spark, d).select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "ts", "brightness").write.parquet(f"{path}/in")
    written = spark.read.parquet(f"{path}/in")
    files = -(-len(written.inputFiles()) // LIVE_BATCHES)
    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    found = live.flash_events(live.with_event_time(stream, "1 day"), 0.1, GAP)
    run = found.writeStream.foreachBatch(sinks.append_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").filter("kind = 'violation' and not incomplete").select("video_id", "start_time", "end_time", "start_frame", "end_frame", "flash_count")
