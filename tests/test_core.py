"""Closed-form cases, state-machine tables, formats and streaming."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photowarden import params
from photowarden.functions import color, scalar
from photowarden.operators import explore, flash, frame_metrics, risk, spectral, temporal, windows
from photowarden.params import Sampling
from photowarden.plans import analysis
from photowarden.sources import frames as sources
from photowarden.sources import importers, sinks


def raster(rgba, w=8, h=8):
    return frame_metrics.Raster(w, h, bytes(rgba) * (w * h))


def test_plain_frames():
    white, black, clear = raster((255, 255, 255, 255)), raster((0, 0, 0, 255)), raster((9, 9, 9, 0))
    assert frame_metrics.brightness(white) == pytest.approx(1) and frame_metrics.coverage(white) == 1 and frame_metrics.entropy(white) == 0
    assert frame_metrics.brightness(black) == 0 and frame_metrics.coverage(black) == 0 and frame_metrics.dominant(black) == (0, 0, 0)
    assert frame_metrics.entropy(clear) == 0 and frame_metrics.dominant(clear) == (0, 0, 0) and frame_metrics.chromatic(clear) == (0, 0) and frame_metrics.brightness(clear) > 0
    assert frame_metrics.edges(white) == (0, 0) and frame_metrics.pattern(white) == pytest.approx(0, abs=1e-9)
    red = raster((255, 0, 0, 255))
    assert frame_metrics.chromatic(red) == pytest.approx((1 / math.sqrt(2), 0.5 / math.sqrt(6))) and frame_metrics.brightness(red) == pytest.approx(0.2126)
    lab = frame_metrics.lab_plane(white)[:, 0]
    assert lab == pytest.approx([100, 0.0053, -0.0104], abs=1e-3)


def test_half_frame_has_one_bit():
    px = bytes((0, 0, 0, 255)) * 32 + bytes((255, 255, 255, 255)) * 32
    f = frame_metrics.Raster(8, 8, px)
    assert frame_metrics.entropy(f) == pytest.approx(1) and frame_metrics.brightness(f) == pytest.approx(0.5) and frame_metrics.coverage(f) == 0.5


def test_empty_raster():
    f = frame_metrics.Raster(0, 0, b"")
    for name, (kernel, _, _) in frame_metrics.KERNELS.items():
        if name not in ("pixel_contrast", "pattern", "histogram", "palette", "edge_map"):
            assert np.all(np.array(kernel(f)) == 0)


def test_spectrum_of_a_sine():
    got = spectral.spectrum(0.5 + 0.4 * np.sin(2 * np.pi * 10 * np.arange(64) / 60))
    assert got["bin"] == 11 and got["dominant_frequency"] == pytest.approx(10.3125)
    with pytest.raises(ValueError):
        spectral.fft(np.zeros(63))
    assert spectral.flatness(np.array([])) == 0


def signal(spark, points, video="v"):
    """points: (time, brightness) in order."""
    return spark.createDataFrame([(video, k + 1, float(t), float(b)) for k, (t, b) in enumerate(points)], "video_id string, frame_idx int, ts double, brightness double")


def flagged(spark, points):
    """points: (time, is_flash)"""
    return spark.createDataFrame([("v", k + 1, float(t), bool(f), 0.5 if f else 0.0) for k, (t, f) in enumerate(points)], "video_id string, frame_idx int, ts double, is_flash boolean, intensity double")


@pytest.mark.parametrize(
    ("points", "counts"),
    [
        ([(0, 1), (0.3, 1), (0.6, 1), (0.9, 1), (1.0, 0)], [(4, False)]),
        ([(0, 1), (0.4, 1), (0.8, 1), (1.0, 1)], [(4, False)]),
        ([(0, 1), (0.3, 1), (0.6, 1), (1.5, 0)], []),
        ([(0, 1), (0.1, 1), (0.2, 1), (0.3, 1), (0.49, 0)], []),
        ([(0, 1), (0.1, 1), (0.2, 1), (0.3, 1), (0.5, 0)], [(4, True)]),
    ],
)
def test_violations(spark, points, counts):
    got = flash.violations(flagged(spark, points)).select("flash_count", "incomplete").collect()
    assert [tuple(r) for r in got] == counts


def test_cluster_gap_is_inclusive(spark):
    got = flash.clusters(flagged(spark, [(0, 1), (0.25, 1), (0.75, 1)]), 0.25).orderBy("cluster_id").collect()
    assert [(r["count"], r["start_time"], r["end_time"]) for r in got] == [(2, 0.0, 0.25), (1, 0.75, 0.75)]


def test_empty_flash_lists(spark):
    none = flagged(spark, [(0, 0), (1, 0)])
    assert flash.flash_counts(none).first()["avg_intensity"] == 0
    assert tuple(flash.flash_statistics(none).first())[1:] == (0, 0.0, 0)
    assert flash.violation_statistics(none).first()["violation_count"] == 0
    assert flash.clusters(none).count() == 0


def test_colors(spark):
    row = spark.createDataFrame([(255.0, 255.0, 255.0)], "r double, g double, b double")
    lab = row.select(color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("l")).first()["l"]
    assert tuple(lab) == pytest.approx((100, 0.0053, -0.0104), abs=1e-3)
    red = spark.createDataFrame([(255.0, 0.0, 0.0), (128.0, 128.0, 128.0)], "r double, g double, b double")
    area = red.select(color.red_area_fraction(F.col("r"), F.col("g"), F.col("b"), color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).alias("a"))
    assert [r["a"] for r in area.collect()] == pytest.approx([1.0, 128 / 255 * 0.05])
    labs = spark.createDataFrame([((50.0, 25.0, -10.0), (55.0, 30.0, -5.0))], "p struct<L:double,a:double,b:double>, q struct<L:double,a:double,b:double>")
    assert labs.select(color.cie76(F.col("p"), F.col("q")).alias("d")).first()["d"] == pytest.approx(math.sqrt(75))


def test_scalars(spark):
    row = spark.createDataFrame([(1.005, -2.5, 125.0)], "a double, b double, s double")
    got = row.select(scalar.to_fixed(F.col("a"), 2).alias("f"), scalar.half_up(F.col("b")).alias("h"), scalar.format_time(F.col("s")).alias("t"), scalar.to_fixed(F.lit(1234567.5), 1).alias("n")).first()
    assert tuple(got) == ("1.00", -2.0, "2:05", "1234567.5")
    assert scalar.label_of("psi.maxScore") == "Psi Max Score" and 0 <= scalar.color_index("psi.score") < 16


def test_parameters():
    assert params.percent("95%") == params.percent("p95") == params.percent(0.95) == params.percent(95) == 95
    assert params.percent(1) == 100
    assert params.Sampling(1 / 30).recommended_cluster_gap() == 0.12
    for bad in (dict(brightness_change=2.0), dict(flashes_per_second=0), dict(cluster_gap=3.0)):
        with pytest.raises(ValueError):
            params.Thresholds(**bad)


def test_risk_debt_crosses_blocks(spark):
    n = risk.DEBT_BLOCK + 50
    rows = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") + 1).cast("int").alias("frame_idx"), (F.col("id") % 7 / 7.0).alias("x"))
    got = [r["risk_debt"] for r in risk.with_debt(rows, F.col("x")).orderBy("frame_idx").collect()]
    d, want = 0.0, []
    for k in range(n):
        d = 0.95 * d + 0.05 * (k % 7 / 7.0)
        want.append(d)
    assert got == pytest.approx(want, abs=1e-12)


def test_contrast_stream_of_a_long_video(spark):
    """The decayed mean is the fold's, long after exp(lam * t) leaves a double's range, and over a pause."""
    rng = np.random.default_rng(3)
    times = [k / 10 for k in range(8000)] + [2000 + k / 10 for k in range(100)]
    rows = [("v", k + 1, t, float(g)) for k, (t, g) in enumerate(zip(times, rng.integers(0, 256, len(times)).tolist(), strict=True))]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, ts double, r double").withColumns({"g": F.col("r"), "b": F.col("r")})
    windows = temporal.with_contrast_windows(df, interval=0.1).select("frame_idx", F.col("contrast_window.stream_weighted_average_delta_e").alias("mean"))
    got = {r["frame_idx"]: r["mean"] for r in windows.filter("mean is not null").collect()}
    labs = [r["l"] for r in df.orderBy("frame_idx").select(color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("l")).collect()]
    s = w = 0.0
    for k in range(1, len(times)):
        fade = math.exp(-3 * math.log(2) * (times[k] - times[k - 1]))
        s, w = s * fade + math.dist(labs[k], labs[k - 1]), w * fade + 1
        if k + 1 in got:
            assert got[k + 1] == pytest.approx(s / w, abs=0.0051), k
    assert len(got) > 8000


def test_decayed_mean_over_missing_values(spark):
    """A row without a value has the mean so far, also a long time after the last value."""
    rows = [("v", 1, 0.0, None), ("v", 2, 1.0, 4.0), ("v", 3, 2.0, 8.0), ("v", 4, 5000.0, None), ("v", 5, 9000.0, 3.0), ("v", 6, 9001.0, 5.0), ("w", 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, ts double, x double")
    got = [r["m"] for r in temporal.with_decayed_mean(df, "x", math.log(2), "m").orderBy("video_id", "frame_idx").collect()]
    assert got[0] is None and got[1:] == pytest.approx([4.0, 20 / 3, 20 / 3, 3.0, 13 / 3, 1.0])


def test_periodicity():
    x = np.sin(2 * np.pi * np.arange(100) / 10)
    assert temporal.highest_peak(x)[:2] == (True, 10)
    assert temporal.highest_peak(np.zeros(3)) == (False, 0, 0.0)


def frames(spark, sf):
    return sources.frames_from_embeddings(spark.read.parquet(f"{sf}/embeddings.parquet")).filter("video_id < 2")


def test_analysis_and_exports(spark, sf, tmp_path):
    flags = params.Flags(red=True, temporal_contrast=True)
    rows = analysis.analyze(frames(spark, sf), params.Thresholds(0.05), flags).cache()
    n = frames(spark, sf).count()
    assert rows.count() == n
    assert rows.filter("brightness is null or psi.score is null or risk_level is null").count() == 0
    csv = sinks.csv_rows(rows, red=True, temporal_contrast=True)
    assert len(csv.columns) == 79 and csv.count() == n
    done = sinks.export_selected(rows.drop("temporal_contrast_sensitivity"), str(tmp_path), csv=True, json=True, ndjson=True, summary=analysis.summarize(rows))
    assert len(done) == 4
    back = importers.read_ndjson(spark, f"{tmp_path}/ndjson")
    a = explore.flatten_metrics(back).select("timestamp", "`psi.score`", "brightness").toPandas().sort_values(["timestamp", "brightness"])
    b = explore.flatten_metrics(rows).select("timestamp", "`psi.score`", "brightness").toPandas().sort_values(["timestamp", "brightness"])
    assert np.allclose(a.to_numpy(), b.to_numpy())
    doc = sinks.json_documents(rows.select("video_id", "timestamp", "brightness")).orderBy("video_id").first()["document"]
    parsed = json.loads(doc)
    assert parsed["metadata"]["total_frames"] == len(parsed["analysis"])
    times = [r["timestamp"] for r in parsed["analysis"]]
    assert times == sorted(times)
    s = analysis.summarize(rows, names=spark.createDataFrame([(0, "my clip.mp4")], "video_id int, name string"))
    assert {r["file_name"] for r in s.collect()} == {"analysis-my_clip", "unknown"}
    assert analysis.report(rows).count() == 2 and analysis.short_summary(s).count() == 2
    assert analysis.cluster_report(rows).count() <= 2


def test_prefix_property(spark, sf):
    """Metrics of a frame depend only on frames up to it, and not on how the input is partitioned."""
    f = frames(spark, sf)
    whole = analysis.analyze(f).filter("frame_idx <= 20").select("video_id", "frame_idx", "risk_level", "psi.score", "temporal_coherence.coherence_score").toPandas()
    part = analysis.analyze(f.filter("frame_idx <= 20").repartition(5)).select("video_id", "frame_idx", "risk_level", "psi.score", "temporal_coherence.coherence_score").toPandas()
    key = ["video_id", "frame_idx"]
    assert whole.sort_values(key).reset_index(drop=True).equals(part.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2}]', '{"analysis":[{"a":1},{"a":2}]}', '{"data":[{"a":1},{"a":2}]}'])
def test_json_shapes(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert sorted(r["a"] for r in importers.read_json_document(spark, str(tmp_path / "x.json")).collect()) == [1, 2]
    from pyspark.sql.types import LongType, StructField, StructType

    assert sorted(r["a"] for r in importers.read_json_document(spark, str(tmp_path / "x.json"), StructType([StructField("a", LongType())])).collect()) == [1, 2]


def test_ndjson_blank_lines_and_failure(spark, tmp_path):
    (tmp_path / "x.ndjson").write_bytes(b'{"a":1}\r\n\r\n{"a":2}\r\n')
    assert sorted(r["a"] for r in importers.read_ndjson(spark, str(tmp_path / "x.ndjson")).collect()) == [1, 2]
    (tmp_path / "y.ndjson").write_text('{"a":1}\n{bad\n')
    from pyspark.sql.types import LongType, StructField, StructType

    with pytest.raises(Exception, match="(?i)malformed|parse"):
        importers.read_ndjson(spark, str(tmp_path / "y.ndjson"), StructType([StructField("a", LongType())])).collect()


def test_store(spark):
    importers.save_last(spark.range(3))
    assert importers.load_last(spark).count() == 3
    importers.clear_last(spark)
    assert not spark.catalog.tableExists(importers.LAST)


def test_explore(spark):
    df = spark.createDataFrame([(k, float(k % 3), 1.0) for k in range(100)], "x int, y double, z double")
    got = explore.explore(df, "x", ["y", "z"], center=10, width=10).toPandas()
    assert sorted(got.x) == list(range(5, 16)) and got.y.min() == 0 and got.y.max() == 1 and set(got.z) == {0.5}
    assert explore.search_fields(df, "Y") == ["y"]
    assert explore.bounds(df, "z", ["y"]).first()["max_x"] == 2.0


def test_registry(spark):
    from photowarden import registry

    assert "flash.violations" in registry.METRICS and "temporal.coherence" in registry.METRICS
    registry.register_sql(spark)
    assert spark.sql("SELECT luminance(255D, 255D, 255D) AS l, psi_band(0.8D) AS b, risk_number('medium') AS r").first()[1:] == ("high", 0.5)


def test_stream_equals_batch(spark, tmp_path):
    from photowarden.streaming import live

    rng = np.random.default_rng(3)
    points = [(v, k + 1, 0.05 * k, float(rng.random())) for v in ("a", "b") for k in range(200)]
    df = spark.createDataFrame(points, "video_id string, frame_idx long, ts double, brightness double")
    src = tmp_path / "in"
    for k in range(4):
        df.filter((F.col("frame_idx") > k * 60) & (F.col("frame_idx") <= (k + 1) * 60)).coalesce(1).write.parquet(f"{src}/b{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    got = []
    q = live.flash_events(live.with_event_time(stream), 0.5, 0.06).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = flash.with_flashes(df, 0.5)
    want = {(r["video_id"], r["start_frame"], r["end_frame"], r["flash_count"]) for r in flash.violations(batch).filter("not incomplete").collect()}
    assert want == {(r["video_id"], r["start_frame"], r["end_frame"], r["flash_count"]) for r in got if r["kind"] == "violation" and not r["incomplete"]}
    spans = {(r["video_id"], r["start_frame"], r["end_frame"], r["count"]) for r in flash.clusters(batch, 0.06).collect()}
    closed = {(r["video_id"], r["start_frame"], r["end_frame"], r["flash_count"]) for r in got if r["kind"] == "cluster"}
    assert closed <= spans and len(spans - closed) <= 2


def test_stream_of_many_videos_has_few_states(spark, tmp_path):
    """Videos share calls and rows of state; one that goes quiet still gives what it has open, and only that one."""
    from photowarden.streaming import live

    points = [(None if v == 0 else str(v), k, 0.04 * k, k % 2 * 1.0) for v in range(300) for k in range(1, 16)]
    points += [(None if v == 0 else str(v), k, 90 + 0.04 * k, k % 2 * 1.0) for v in range(0, 300, 2) for k in range(16, 46)]
    df = spark.createDataFrame(points, "video_id string, frame_idx long, ts double, brightness double")
    for k, part in enumerate((df.filter("ts < 90"), df.filter("ts >= 90"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = []
    q = live.flash_events(live.with_event_time(stream), 0.5, 0.06).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 256
    name = lambda v: "None" if v == 0 else str(v)
    found = [r for r in got if r["kind"] == "violation"]
    assert sorted(r["video_id"] for r in found if r["incomplete"]) == sorted(map(name, range(1, 300, 2)))
    want = {(r["video_id"] or "None", r["start_frame"], r["end_frame"], r["flash_count"]) for r in flash.violations(flash.with_flashes(df, 0.5)).filter("not incomplete").collect()}
    assert want == {(r["video_id"], r["start_frame"], r["end_frame"], r["flash_count"]) for r in found if not r["incomplete"]} and len(want) >= 150


def test_windows_of_videos_that_pass_one_after_the_other(spark):
    """Many short videos and two that are longer than an Arrow batch, one of them without a name, without a call a video."""
    rng = np.random.default_rng(5)
    sizes = {None: 23_000, "long": 25_000} | {f"v{k}": int(rng.integers(1, 40)) for k in range(200)}
    signal = {v: (np.arange(n) * 0.05, rng.random(n) > 0.5) for v, n in sizes.items()}
    df = spark.createDataFrame([(v, k + 1, float(t), bool(f)) for v, (ts, fl) in signal.items() for k, (t, f) in enumerate(zip(ts, fl, strict=True))], "video_id string, frame_idx int, ts double, is_flash boolean")
    found = flash.violation_windows(df.orderBy(F.rand(1)))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {r["video_id"]: r for r in found.collect()}
    assert len(got) == found.count() == len(sizes)
    for v, (ts, fl) in signal.items():
        done, left = flash.closed_windows(np.arange(len(ts)) + 1, ts, fl, 1.0)
        assert [w.asDict() for w in got[v]["done"]] == done and got[v]["frames"] == len(ts)
        assert (got[v]["ws"], got[v]["wf"], got[v]["k"]) == (left or (None, None, 0))


def test_selected_exports_compute_their_rows_once(spark, tmp_path):
    from photowarden.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    rows = spark.range(50).select((F.col("id") % 3).alias("video_id"), F.col("id").alias("frame_idx"), (F.col("id") / 30.0).alias("timestamp"), F.udf(look, "double")(F.col("id") / 50.0).alias("brightness"))
    sinks.export_selected(rows, str(tmp_path), csv=True, json=True, ndjson=True)
    assert seen.value == 50
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/ndjson").count() == 50


def test_rounding_is_plain(spark):
    row = spark.createDataFrame([(0.4999999995, 0.5, -0.5, 1.25)], "a double, b double, c double, d double")
    got = row.select(*(scalar.half_up(F.col(c)).alias(c) for c in "abc"), scalar.half_up(F.col("d"), 1).alias("d")).first()
    assert tuple(got) == (0.0, 1.0, 0.0, 1.3)


def test_kept_times_are_the_greedy_ones():
    rng = np.random.default_rng(0)
    for gap in (0.0, 0.1, 0.25, 1 / 3):
        for step in (0.05, 1 / 3, 0.1):
            ts = np.sort(rng.integers(0, 60, 80) * step)
            want, last = [], -math.inf
            for k, t in enumerate(ts.tolist()):
                if t - last >= gap:
                    want.append(k)
                    last = t
            assert sources.kept_times(ts, gap) == want


def test_closed_windows_are_the_folds():
    """Against a frame-by-frame fold, with times in order and not."""
    rng = np.random.default_rng(1)
    for trial in range(200):
        n = int(rng.integers(1, 60))
        ts = rng.integers(0, 40, n) / 8
        ts = np.sort(ts) if trial % 2 else ts
        hit = rng.random(n) < 0.4
        done, ws, wf, k = [], None, None, 0
        for i in range(n):
            if hit[i] and ws is None:
                ws, wf = float(ts[i]), i + 1
            k += bool(hit[i])
            if ws is not None and ts[i] >= ws + 1.0:
                done.append({"start_time": ws, "start_frame": wf, "end_frame": i, "frame_count": i + 1 - wf, "flash_count": k, "closed_at": float(ts[i])})
                ws, wf, k = None, None, 0
        got, left = flash.closed_windows(np.arange(1, n + 1), ts, hit, 1.0)
        assert got == done and left == (None if ws is None else (ws, wf, k))


def test_coherence_against_plain_sums(spark):
    rng = np.random.default_rng(2)
    values = [0.5] * 12 + rng.random(40).tolist() + [float("nan"), 2.0]
    rows = signal(spark, [(k / 10, v) for k, v in enumerate(values)])
    clean = [v if 0 <= v <= 1 else 0.0 for v in values]
    for r in temporal.coherence(rows).orderBy("frame_idx").collect():
        v = np.array(clean[max(0, r["frame_idx"] - 30) : r["frame_idx"]])
        d, n = v - v.mean(), len(v)
        s = (d * d).mean() or 1e-8
        want = [float((d[: n - k] * d[k:]).sum() / ((n - k) * s)) for k in range(1, min(10, n - 1) + 1)]
        assert [x["lag"] for x in r["lags"]] == list(range(1, len(want) + 1)) and [x["correlation"] for x in r["lags"]] == pytest.approx(want, abs=1e-9)
        assert r["coherence_score"] == pytest.approx(np.mean(np.abs(want)) if want else 0.0, abs=1e-9)


def test_peaks_by_fft_are_those_of_plain_sums():
    rng = np.random.default_rng(4)
    for n in (4, 7, 20, 63, 200):
        x = rng.random(n)
        d = x - x.mean()
        corr = {k: float((d[: n - k] * d[k:]).sum() / np.sqrt((d[: n - k] ** 2).sum() * (d[k:] ** 2).sum())) for k in range(2, n // 2)}
        peaks = [(c, -k) for k, c in corr.items() if k - 1 in corr and k + 1 in corr and c > corr[k - 1] and c > corr[k + 1]]
        found, lag, value = temporal.highest_peak(x, threshold=-1)
        assert found == bool(peaks) and (not peaks or ((value, -lag) == (pytest.approx(max(peaks)[0]), max(peaks)[1])))


def test_spectra_in_batches():
    rng = np.random.default_rng(5)
    for n in (64, 50, 7):
        x = rng.random((5, n))
        x[3] = 0.25
        many = spectral.spectra_of(x)
        for k in range(5):
            one = spectral.spectrum(x[k])
            assert all(np.allclose(many[c][k], one[c]) for c in many)
            z = spectral.padded_fft((x[k] - np.median(x[k])) * spectral.hann(n))
            assert np.allclose(many["amplitude"][k][1:], np.abs(z[1 : len(z) // 2]) * 2 / spectral.hann(n).sum())
        assert many["bin"][3] == 0 and many["confidence"][3] == 0
        high = min(many["amplitude"].shape[1] - 1, math.ceil(50 * 2 * many["amplitude"].shape[1] / 60))
        low = max(1, int(3 * 2 * many["amplitude"].shape[1] / 60))
        assert many["flatness"][0] == pytest.approx(spectral.flatness(many["amplitude"][0], low, high))


def test_statistics_of_groups(spark):
    from photowarden.operators import quantiles

    rng = np.random.default_rng(6)
    rows = [(g, float(rng.integers(0, 9)) if k % 5 else None) for g in ("a", "b", None) for k in range(37)] + [("c", None), ("c", float("nan")), ("d", float("inf")), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in quantiles.statistics(df, "x", ["g"]).collect()}
    for g in ("a", "b", None, "d"):
        x = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        r = got[g]
        assert (r["size"], r["distinct_values"], r["min"], r["max"]) == (len(x), len(set(x)), min(x), max(x))
        assert [r["median"], r["p90"], r["p95"]] == pytest.approx(np.quantile(x, [0.5, 0.9, 0.95]).tolist())
    assert got["c"]["size"] == 0 and got["c"]["median"] is None
    ranks = {r["g"]: r for r in quantiles.latency_statistics(df, "x", ["g"]).collect()}
    x = sorted(v for k, v in rows if k == "a" and v is not None)
    assert [ranks["a"][c] for c in ("p50", "p95", "p99")] == [x[min(int(len(x) * q), len(x) - 1)] for q in (0.5, 0.95, 0.99)] and ranks["a"]["n"] == len(x)


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x")).repartition(7)
    got = explore.numbered(df, "x").orderBy("x").collect()
    assert [r[explore.NUMBERED] for r in got] == list(range(1000))
    assert explore.numbered(df.filter("false"), "x").count() == 0


def test_clusters_of_windows(spark):
    """A cluster that began before the window, one inside it, one that goes on after it, and one elsewhere."""
    times = [0.0, 0.2, 0.9, 1.1, 1.4, 1.6, 3.0, 5.0, 5.1, 5.2, 5.3, 6.5]
    points = [(t, t not in (3.0, 6.5)) for t in times]
    got = sorted((r["start_frame"], r["cluster_id"], r["count"], r["overlap_start"], r["overlap_end"]) for r in flash.associated_clusters(flagged(spark, points), 0.3).collect())
    assert got == [(1, 1, 2, 0.0, 0.2), (1, 2, 2, 0.9, 1.0), (8, 3, 4, 5.0, pytest.approx(5.3))]


def test_image_files(spark, tmp_path):
    """Bitmaps in a folder a video; and frames as Parquet."""
    import struct

    px = {(v, k): np.random.default_rng(k).integers(0, 256, (3, 5, 3), dtype=np.uint8) for v in ("a", "b") for k in (1, 2)}
    for (v, k), rgb in px.items():
        rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" for y in (2, 1, 0))  # bottom first, BGR, rows of 16 bytes
        (tmp_path / v).mkdir(exist_ok=True)
        (tmp_path / v / f"{k}.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)
    (tmp_path / "a" / "junk.bmp").write_bytes(b"no image")
    got = sources.read_images(spark, f"{tmp_path}/*/*.bmp", fps=10)
    assert {(r["video_id"], r["frame_idx"], r["ts"], r["width"], r["height"]): np.frombuffer(r["rgba"], np.uint8).reshape(3, 5, 4)[:, :, :3].tolist() for r in got.collect()} == {(v, k, k / 10, 5, 3): x.tolist() for (v, k), x in px.items()}
    got.write.parquet(str(tmp_path / "frames"))
    assert sources.read_frames(spark, str(tmp_path / "frames")).filter("length(rgba) = 60").count() == 4


def test_json_arrays(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    sinks.export_charts(df, [("a", ["b"])], str(tmp_path), ("json",))
    files = [f for f in (tmp_path / "json").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    rows = [r for f in files for r in json.loads(f.read_text())]
    assert sorted(r["a"] for r in rows) == list(range(50)) and all(r["b"] == (r["a"] if r["a"] % 2 == 0 else None) for r in rows)


def test_sinks_of_streams(spark, tmp_path):
    """A batch that is run again replaces itself; alerts are the flashes only."""
    batch = flagged(spark, [(0, 1), (1, 0), (2, 1)])
    keep = sinks.append_sink(str(tmp_path))
    for number in (0, 1, 1):
        keep(batch, number)
    assert spark.read.parquet(str(tmp_path)).count() == 6
    seen = []
    sinks.flash_alerts(lambda b, n: seen.append((n, b.count())))(batch, 4)
    assert seen == [(4, 2)]


def test_decimals_of_exact_halves(spark):
    """Halves go away from zero, as the export's contract has it; what only looks like a half does not."""
    values = [0.125, 0.375, -0.125, 12.25, 12.75, 2.5, 0.5, 1.005, -0.001, 1e15 + 0.5, 0.0]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    got = lambda p: [r[0] for r in rows.select(scalar.to_fixed(F.col("v"), p)).collect()]
    assert got(2) == ["0.13", "0.38", "-0.13", "12.25", "12.75", "2.50", "0.50", "1.00", "-0.00", "1000000000000000.50", "0.00"]
    assert got(1)[3:5] == ["12.3", "12.8"] and got(0)[5:7] == ["3", "1"] and got(0)[9] == "1000000000000001"


def test_labels_and_arguments_in_columns(spark):
    """The functions of a column give what those of a value do; a null stays null."""
    keys = ["psi.components.frequency", "edgeDetection.edge_count", "x", "a1B2C", "", "risk  level", "Zz.9"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    got = rows.select("k", scalar.label(F.col("k")).alias("l"), scalar.color_number(F.col("k")).alias("c")).collect()
    assert [(r.l, r.c) for r in got] == [(scalar.label_of(r.k), scalar.color_index(r.k)) for r in got]
    assert scalar.color_index("edgeDetection.edge_count") == got[1].c
    spelled = ["0.95", "95", "95%", " P95 ", "1", "p1", "-3", "250", "0.5%", "median", "", None]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(spelled)], "k int, v string").orderBy("k").select(scalar.percent_argument(F.col("v"))).collect()
    assert [r[0] for r in found] == [95.0, 95.0, 95.0, 95.0, 100.0, 1.0, 0.0, 100.0, 0.5, None, None, None]
    gaps = spark.createDataFrame([(0.01,), (1 / 30,), (0.1,), (0.9,)], "i double").select(scalar.recommended_cluster_gap(F.col("i"))).collect()
    assert [r[0] for r in gaps] == [0.05, 0.12, 0.35, 2.0] and Sampling(0.1).recommended_cluster_gap() == 0.35


def test_restarts_within_a_video(spark):
    """After a restart nothing of before counts; a level may be carried through; null videos and segments are kept."""
    levels = ["low", "high", "low", "low"]
    data = [("a", k + 1, k // 2, 0.9 * (k % 2), levels[k]) for k in range(4)] + [(None, 1, None, 0.5, "low")]
    rows = spark.createDataFrame(data, "video_id string, frame_idx int, part int, brightness double, risk_level string")
    cut = windows.restarted(rows.withColumn("ts", F.col("frame_idx") / 30.0), F.col("part"))
    seen = flash.with_flashes(cut).withColumn("carried", windows.levels_carried(["low", "high"])).orderBy("video_id", "frame_idx")
    assert [(r.video_id, r.frame_idx, r.intensity, r.carried) for r in seen.collect()] == [
        ("#0", 1, 0.0, "low"), ("a#0", 1, 0.0, "low"), ("a#0", 2, 0.9, "high"), ("a#1", 1, 0.0, "high"), ("a#1", 2, 0.9, "high"),
    ]
    assert windows.restarted(rows.limit(0), F.col("part")).count() == 0
