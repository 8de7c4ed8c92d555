"""Frames in runs, damaged and transparent rasters, video files, streams out of order, JSON documents of any size."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photowarden import catalog
from photowarden.operators import flash, frame_metrics, risk, sliding, temporal
from photowarden.params import Flags
from photowarden.plans import analysis
from photowarden.sources import documents, frames, importers, video
from photowarden.streaming import live, ordered

FRAME_TYPE = "video_id string, frame_idx int, ts double, width int, height int, rgba binary"


def clip(seed, n, width=12, height=10, clear=0.3):
    rng = np.random.default_rng(seed)
    for k in range(n):
        px = rng.integers(0, 256, (height, width, 4), np.uint8)
        px[..., 3] = np.where(rng.random((height, width)) < clear, 0, 255)
        yield (f"v{seed}", k + 1, k / 30, width, height, px.tobytes())


def plain_pairs(now, before):
    """difference, motion and scene change of two rasters, pixel by pixel."""
    if not len(now):
        return 0.0, 0.0, 0.0
    a = np.frombuffer(now, np.uint8).reshape(-1, 4).astype(int)
    like = before is not None and len(before) == len(now)
    b = np.frombuffer(before, np.uint8).reshape(-1, 4).astype(int) if like else np.zeros_like(a)
    d = np.abs(a - b)[:, :3].sum(1)
    score = 0.0
    if like:
        seen = (a[:, 3] != 0) | (b[:, 3] != 0)
        lin = lambda v: np.where(v / 255 > 0.04045, ((v / 255 + 0.055) / 1.055) ** 2.4, v / 255 / 12.92)
        hist = [np.bincount(np.minimum(np.floor(lin(x[seen, :3]) @ [0.2126, 0.7152, 0.0722] * 255).astype(int) // 8, 31), minlength=32) for x in (a, b)]
        differs = hist[0] != hist[1]
        score = np.abs(hist[0] - hist[1]).sum() / (hist[0] + hist[1])[differs].sum() if differs.any() else 0.0
    return d.sum() / (len(d) * 765), (d > 76.5).mean(), score


@pytest.mark.parametrize("order", ["in files", "shuffled", "in stripes", "with gaps"])
def test_frames_against_the_ones_before(spark, tmp_path, order):
    rows = [*clip(1, 40), *clip(2, 33, clear=0.0), *clip(3, 1), *clip(4, 20, 4, 4)]
    rows += [("v5", 1, 0.0, 4, 4, bytes(64)), ("v5", 2, 0.1, 4, 4, b"short"), ("v5", 3, 0.2, 4, 4, bytes([9] * 64)), ("v5", 4, 0.3, 2, 2, bytes([9] * 16)), ("v5", 5, 0.4, 4, 4, None)]
    if order == "with gaps":
        rows = [r for r in rows if r[1] % 7 != 3]
    want = {}
    for video_id in {r[0] for r in rows}:
        before = None
        for r in sorted((r for r in rows if r[0] == video_id), key=lambda r: r[1]):
            whole = r[5] if r[5] is not None and len(r[5]) >= 4 * r[3] * r[4] else b""
            want[video_id, r[1]] = plain_pairs(whole, before)
            before = whole
    if order == "shuffled":
        random.Random(4).shuffle(rows)
    if order == "in stripes":
        rows = sorted(rows, key=lambda r: r[1] % 3)
    spark.createDataFrame(rows, FRAME_TYPE).repartition(1 if order == "in stripes" else 3).write.parquet(str(tmp_path / "f")) if order != "in files" else [
        spark.createDataFrame(rows[a : a + 25], FRAME_TYPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "f")) for a in range(0, len(rows), 25)
    ]
    frames = spark.read.parquet(str(tmp_path / "f"))
    got = {(r.video_id, r.frame_idx): (r.difference, r.motion, r.scene_change) for r in frame_metrics.frame_metrics(frames, ["damaged"], True, True).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert {(r.video_id, r.frame_idx) for r in frame_metrics.frame_metrics(frames, ["damaged", "brightness"]).filter("damaged").collect()} <= {("v5", 2), ("v5", 5)}


def test_only_borders_of_runs_leave_a_task(spark, tmp_path):
    rows = list(clip(1, 60)) + list(clip(2, 60))
    spark.createDataFrame(rows, FRAME_TYPE).coalesce(1).sortWithinPartitions("video_id", "frame_idx").write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    plan = frame_metrics.frame_difference(frames)._jdf.queryExecution().executedPlan().toString()
    assert all("rgba" not in line for line in plan.split("\n") if "Exchange" in line)
    runs = frame_metrics.Runs(1)
    ended = [e for r in rows for e in runs.follow(r[0], r[1], frame_metrics.Raster(*r[3:]))[1]] + runs.close()
    assert [(e[0], e[1]) for e in ended] == [("v1", 60), ("v2", 60)]


def test_repeated_frames(spark):
    rows = [r for r in clip(1, 6) for _ in range(2)]
    got = frame_metrics.frame_metrics(spark.createDataFrame(rows, FRAME_TYPE).coalesce(1), [], True, True).collect()
    assert len(got) == 12


def test_kernels_by_blocks():
    rng = np.random.default_rng(2)
    for h, w in ((16, 24), (17, 9), (7, 30), (1, 1)):
        plane = rng.random((h, w))
        got = frame_metrics.block_deviations(plane, 8)
        assert got == pytest.approx(np.array([[plane[y : y + 8, x : x + 8].std() for x in range(0, w, 8)] for y in range(0, h, 8)]))
        f = frame_metrics.Raster(w, h, rng.integers(0, 256, h * w * 4, np.uint8).tobytes())
        y, x = np.mgrid[:h, :w]
        inner = (x - w / 2) ** 2 + (y - h / 2) ** 2 < (0.2 * min(w, h)) ** 2
        quadrant = np.where(x < w / 2, 0, 1) + np.where(y < h / 2, 0, 2)
        want = [f.luma[m].mean() if m.any() else 0.0 for m in (inner, ~inner, *(quadrant == k for k in range(4)))]
        assert frame_metrics.spatial(f) == pytest.approx(want)


# ---- video files --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("layout", ["420", "422", "444", "mono"])
@pytest.mark.parametrize("full", [True, False])
def test_planes_there_and_back(layout, full):
    rng = np.random.default_rng(1)
    for h, w in ((6, 8), (5, 7), (1, 1)):
        rgba = np.full((h, w, 4), 255, np.uint8)
        rgba[..., :3] = rng.integers(0, 256, (h // 2 + 1, w // 2 + 1, 3)).repeat(2, 0).repeat(2, 1)[:h, :w]
        if layout == "mono":
            rgba[..., 1] = rgba[..., 2] = rgba[..., 0]
        planes = video.to_planes(rgba, layout, full)
        back = video.to_rgba(planes[0], *(planes[1:] if len(planes) > 1 else (None, None)), full)
        assert np.abs(back.astype(int) - rgba).max() <= 3
        header = video.Header(w, h, 25.0, layout, full, 0)
        assert header.stride == 6 + sum(p.size for p in planes) and np.array_equal(video.frame_rgba(header, b"".join(p.tobytes() for p in planes)), back)


def test_headers():
    h = video.parse_header(b"YUV4MPEG2 W640 H360 F30000:1001 Ip A1:1 C420mpeg2 XYSCSS=420MPEG2\nFRAME\n")
    assert (h.width, h.height, h.layout, h.full, h.size) == (640, 360, "420", False, 66) and h.fps == pytest.approx(29.97, abs=0.001)
    assert video.parse_header(h.line()).stride == h.stride and video.parse_header(b"YUV4MPEG2 W6") is None and video.parse_header(b"") is None
    assert video.parse_header(b"YUV4MPEG2 W2 H2 F0:0\n").fps == 30
    for bad in (b"RIFF....", b"YUV4MPEG2 W2 H2 C420p10\n", b"YUV4MPEG2 W2\n", b"YUV4MPEG2 W0 H2\n", b"YUV4MPEG2" + b" " * 5000):
        with pytest.raises(ValueError):
            video.parse_header(bad)
    assert np.array_equal(video.sampled(np.arange(24, dtype=np.uint8).reshape(2, 3, 4), 4)[0, 0], [10, 11, 12, 13])


def test_files_that_grow_and_damaged_ones(spark, tmp_path):
    rows = spark.createDataFrame([*clip(1, 9, clear=0), *clip(2, 4, clear=0)], FRAME_TYPE)
    video.write_y4m(rows, str(tmp_path / "a"), layout="444")
    whole = (tmp_path / "a" / "v1.y4m").read_bytes()
    folder = tmp_path / "b"
    folder.mkdir()
    (folder / "none.y4m").write_bytes(b"")
    (folder / "begun.y4m").write_bytes(b"YUV4MPEG2 W12 H")
    (folder / "part.y4m").write_bytes(whole[:-10])
    (folder / "notes.txt").write_bytes(b"x")
    got = video.read_y4m(spark, str(folder), partition_bytes=800)
    assert [(r.video_id, r.frame_idx) for r in got.orderBy("frame_idx").collect()] == [("part", k) for k in range(1, 9)] and got.rdd.getNumPartitions() > 3
    assert video.read_y4m(spark, str(folder / "pa*.y4m")).count() == 8
    (folder / "part.y4m").write_bytes(whole[:600] + b"X" + whole[600:])
    with pytest.raises(Exception, match="where it should be"):
        video.read_y4m(spark, str(folder)).collect()
    with pytest.raises(Exception, match="several sizes"):
        video.write_y4m(rows.unionByName(spark.createDataFrame([("v1", 99, 9.0, 4, 4, bytes(64))], FRAME_TYPE)), str(tmp_path / "c"))
    assert not any(f.endswith(".y4m") for f in os.listdir(tmp_path / "c"))


# ---- streams out of order -----------------------------------------------------------------------------------------------


def run_risk(spark, tmp_path, batches, **options):
    """Rows of live_risk over so many micro-batches, each a list of (video, frame, ts, brightness)."""
    schema = "video_id string, frame_idx long, ts double, brightness double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    inputs = stream.withColumns({c: F.col("brightness") * 0.5 for c in ordered.RISK_INPUTS[1:]})
    got = []
    with ordered.state_store(spark):
        q = ordered.live_risk(live.with_event_time(inputs, "1 day"), **options).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_late_frames_are_counted(spark, tmp_path):
    line = [("v", k, k * 0.1, (k % 5) / 5) for k in range(1, 60)]
    late = [line.pop(5), line.pop(8)]
    got = run_risk(spark, tmp_path, [line[:20][::-1], line[20:40], late + line[40:]], delay=1.0)
    times = [r.ts for r in sorted(got, key=lambda r: r.frame_idx)]
    assert times == sorted(times) and max(times) == pytest.approx(4.9) and len(times) == len(set(times)) == 47
    assert {r.late_frames for r in got if r.ts > 3.5} == {2} and not {1, 2} & {r.late_frames for r in got if r.ts < 1}


def test_inactivity_begins_anew_and_keeps_the_level(spark, tmp_path):
    first = [("v", k, k * 0.1, float(k % 2)) for k in range(30)]
    second = [("v", 30 + k, 500 + k * 0.1, 0.01) for k in range(30)]
    got = sorted(run_risk(spark, tmp_path, [first, second], delay=0.5, gap=100.0), key=lambda r: r.frame_idx)
    assert {r.session for r in got if r.frame_idx < 30} == {0} and {r.session for r in got if r.frame_idx >= 30} == {1}
    assert {r.risk_level for r in got if r.frame_idx >= 10} == {"high"} and {r.base_level for r in got if r.frame_idx > 45} == {"low"}
    assert got[30].intensity == 0 and got[30].max_flashes == 0


def test_carried_state_is_that_of_the_last_frame(spark, sf):
    rows = catalog.flagged(spark, sf).withColumns({c: F.col("brightness") * 0.5 for c in ordered.RISK_INPUTS[1:]})
    levels = risk.risk_levels(risk.with_flash_peaks(rows))
    got = {r.video_id: r for r in ordered.carried_state(levels).collect()}
    want = levels.groupBy("video_id").agg(F.count("*").alias("n"), F.max_by("risk_level", "frame_idx").alias("level"), F.count_if("is_flash").alias("flashes"), F.max("ts").alias("ts")).collect()
    assert len(got) == len(want)
    assert all((got[str(r.video_id)].frames, risk.RANKS[got[str(r.video_id)].level], got[str(r.video_id)].flashes, got[str(r.video_id)].ts) == (r.n, r.level, r.flashes, r.ts) for r in want)


# ---- JSON documents -----------------------------------------------------------------------------------------------------

ROWS = [{"k": i, "t": ('a"b', "c\\", "[x", "}],{", '\\"', "é,", "")[i % 7] * (i % 4), "v": [1, {"q": "],"}]} for i in range(40)]
SHAPES = {
    "list": ("\n \t" + json.dumps(ROWS), 40), "analysis": (json.dumps({"metadata": {"data": [1], "x": "analysis"}, "analysis": ROWS, "data": [{"k": -1}]}, indent=2), 40),
    "data": ("\r\n" + json.dumps({"z": [[{"analysis": [{"k": -5}]}]], "data": ROWS}), 40), "one row": (json.dumps(ROWS[0], indent=1), 1), "empty list": (" [\n] ", 0),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_json_in_ranges(spark, tmp_path, shape, size):
    text, n = SHAPES[shape]
    (tmp_path / "x.json").write_text(text)
    schema = spark.createDataFrame([], "k int, t string").schema
    assert sorted((r.k, r.t) for r in documents.read_rows(spark, str(tmp_path), schema, size).collect()) == sorted((r["k"], r["t"]) for r in ROWS[:n])


@pytest.mark.parametrize("text", ['[{"k":1},', '{"analysis":[{"k":1}]', "", '[{"k":1}]]', '[{"k":"x}]', '[{"k":1}] [{"k":2}]', '[{"k":1},{"k":]'])
def test_damaged_json_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        importers.read_json_document(spark, str(tmp_path / "x.json"), spark.createDataFrame([], "k int").schema).collect()


def test_reports_have_every_field(spark, sf, tmp_path):
    rows = catalog_rows(spark, sf)
    documents.write_reports(rows, str(tmp_path / "r"), red=True, temporal_contrast=True, made_at="now")
    held = {}
    for r in rows.orderBy("timestamp").collect():
        held.setdefault(str(r.video_id), []).append(r.asDict(recursive=True))
    assert sorted(os.listdir(tmp_path / "r")) == sorted(f"{v}.json" for v in held)

    def check(entry, fields, row):
        for name, source in fields.items():
            if isinstance(source, dict):
                check(entry[name], source, row)
                continue
            value = row
            for step in source[0].split("."):
                value = value.get(step) if value is not None else None
            if source[1] == "as it is":
                assert name in ("spectrum", "periodicity") or (entry.get(name) or None) == (value or None)
            elif source[1] is None:
                assert entry[name] == int(value or 0)
            else:
                assert len(entry[name].partition(".")[2]) == source[1] and float(entry[name]) == pytest.approx(value or 0.0, abs=0.5001 * 10 ** -source[1])

    fields = documents.ENTRY | {"temporalContrastSensitivity": documents.TEMPORAL_ENTRY, "redMetrics": documents.RED_ENTRY}
    for v, frames in held.items():
        report = json.loads((tmp_path / "r" / f"{v}.json").read_text())
        assert list(report) == ["metadata", "analysis", "colorHistory"] and len(report["metadata"]) == 8 and len(report["analysis"]) == len(frames)
        assert report["metadata"]["totalFramesAnalyzed"] == len(frames) and report["metadata"]["riskLevel"] == frames[-1]["risk_level"]
        assert report["colorHistory"]["g"] == pytest.approx([f["dominant_color"]["g"] for f in frames[-30:]])
        for entry, frame in list(zip(report["analysis"], frames, strict=True))[::7]:
            frame["color_change_magnitude"] = float(np.sqrt(sum(x * x for x in frame["color_variance"]["average_change"].values())))
            check(entry, {k: f for k, f in fields.items() if k in entry}, frame)


def catalog_rows(spark, sf):
    from photowarden.params import Flags, Thresholds

    return analysis.analyze(catalog.frames(spark, sf).filter("video_id < 3"), Thresholds(0.05), Flags(red=True, temporal_contrast=True))


# ---- sliding windows ----------------------------------------------------------------------------------------------------


def test_sliding_median_and_maximum():
    rng = np.random.default_rng(6)
    x = np.where(rng.random(400) < 0.3, rng.integers(1, 9, 400) / 4, np.nan)
    got = sliding.sliding_median(x, 50)
    for k in range(400):
        window = x[max(0, k - 49) : k + 1]
        window = window[~np.isnan(window)]
        assert got[k] == pytest.approx(np.median(window)) if len(window) else np.isnan(got[k])
    y = rng.random(300)
    low = rng.integers(0, 300, 500)
    high = np.minimum(low + rng.integers(0, 300, 500), 300)
    assert sliding.sliding_max(y, low, high).tolist() == [y[a:b].max() if b > a else -np.inf for a, b in zip(low, high, strict=True)]


@pytest.mark.parametrize(("seconds", "half_life"), [(2.0, 1 / 3), (60.0, 1 / 3), (3.0, 0.001)])
def test_contrast_windows_in_blocks(spark, monkeypatch, seconds, half_life):
    """Against each window by itself, with gaps, ties and a window at the border of blocks."""
    monkeypatch.setattr(sliding, "SECONDS", seconds)
    rng = np.random.default_rng(3)
    ts = np.sort(np.concatenate((np.arange(300) / 30, 40 + rng.random(80), [40.5, 40.5, 2.0])))
    d = rng.random(len(ts)) * 5
    rows = spark.createDataFrame([("v", k + 1, float(t), None if k == 0 else float(x)) for k, (t, x) in enumerate(zip(ts, d, strict=True))], "video_id string, frame_idx int, ts double, x double")
    made = sliding.in_time_blocks(rows, {"d": F.col("x")}, 1.0, sliding.contrast_kernel(1.0, 2.3, half_life, 5), sliding.CONTRAST_FIELDS)
    got = {r.frame_idx: r for r in made.collect()}
    d[0] = np.nan
    for k, t in enumerate(ts):
        inside = np.flatnonzero((ts >= t - 1.0) & (ts <= t))
        r = got[k + 1]
        if len(inside) < 5:
            assert r.w_count is None
            continue
        x, at = d[inside[1:]], ts[inside[1:]]
        x, at = x[~np.isnan(x)], at[~np.isnan(x)]
        w = np.exp(-(t - at) * np.log(2) / half_life)
        assert (r.w_count, r.w_from, r.w_hits) == (len(inside), ts[inside[0]], (x >= 2.3).sum())
        assert (r.w_mean, r.w_std, r.w_max, r.w_weighted) == pytest.approx((x.mean(), x.std(), x.max(), (x * w).sum() / w.sum()))


def test_flicker_in_blocks_of_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(v, k, k / 30, float((k * k + v) % 7) / 7) for v in (1, 2) for k in range(1, 400)], "video_id int, frame_idx int, ts double, temporal_change double")
    want = {tuple(r) for r in temporal.flicker_frequency(rows, 0.5, 60).select("video_id", "frame_idx", "flicker_frequency").collect()}
    monkeypatch.setattr(sliding, "ROWS", 64)
    got = {tuple(r) for r in temporal.flicker_frequency(rows, 0.5, 60).select("video_id", "frame_idx", "flicker_frequency").collect()}
    assert got == want and len(got) == 798 and len({r[2] for r in got}) > 3


def test_one_video_of_a_million_frames(spark):
    """Blocks of one video are many tasks; linear in its rows."""
    rows = spark.range(1_000_000).select(F.lit("v").alias("video_id"), (F.col("id") + 1).cast("int").alias("frame_idx"), (F.col("id") / 1000.0).alias("ts"), (F.col("id") % 97 / 97.0).alias("x"))
    made = sliding.in_time_blocks(rows, {"d": F.col("x")}, 1.0, sliding.contrast_kernel(1.0, 0.5, 1 / 3, 30), sliding.CONTRAST_FIELDS)
    r = made.agg(F.count("w_count").alias("n"), F.max("w_count").alias("most"), F.max("w_max").alias("top")).first()
    assert (r.n, r.most) == (1_000_000 - 29, 1001) and r.top == pytest.approx(96 / 97)


# ---- violation windows in blocks ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_a_block", [1, 2, 7, 50, 10_000])
@pytest.mark.parametrize("kind", ["steady", "gaps", "ties", "back in time"])
def test_windows_in_blocks(rows_a_block, kind):
    """The tables of blocks, followed and then filled, against one pass."""
    rng = np.random.default_rng(rows_a_block)
    for share in (0.02, 0.3, 0.9):
        n = 300
        step = {"steady": np.full(n, 0.05), "gaps": np.where(rng.random(n) < 0.05, 7.0, 0.1), "ties": rng.integers(0, 2, n) * 0.2, "back in time": rng.normal(0.1, 0.3, n)}[kind]
        ts, hit, frame = np.cumsum(step), rng.random(n) < share, np.arange(1, n + 1)
        want, left = flash.closed_windows(frame, ts, hit, 1.0)
        blocks = []
        for a in range(0, n, rows_a_block):
            part = slice(a, a + rows_a_block)
            blocks.append(flash.block_exits(frame[part], ts[part], hit[part], 1.0, ts[:a].max() if a else -np.inf) | {"length": 1.0})
        entries, end = flash.block_entries(blocks)
        assert (None if end is None else (end["ws"], end["wf"], end["k"])) == left
        for k, e in enumerate(entries):  # a block begins with the window that is open there
            at = k * rows_a_block
            open_there = [w for w in want if w["start_frame"] <= at < w["end_frame"] + 1] or ([{"start_time": left[0], "start_frame": left[1]}] if left and left[1] <= at else [])
            assert (None if e is None else (e["ws"], e["wf"])) == (None if not open_there else (open_there[0]["start_time"], open_there[0]["start_frame"]))


def test_violations_of_videos_in_blocks(spark, sf, monkeypatch):
    rows = catalog.flagged(spark, sf)
    want = sorted(map(tuple, flash.violations(rows).collect()), key=repr)
    monkeypatch.setattr(flash, "BLOCK_ROWS", 5)
    got = sorted(map(tuple, flash.violations(rows).collect()), key=repr)
    assert got == want and len(got) > 20
    by_video = {r.video_id: r for r in flash.violation_windows(rows).collect()}
    closed, left = flash.windows_in_blocks(rows)
    assert closed.count() == sum(len(r.done) for r in by_video.values())
    assert {r.video_id: (r.ws, r.wf, r.k) for r in left.collect()} == {v: (r.ws, r.wf, r.k) for v, r in by_video.items()}


def test_violations_of_a_long_video(spark):
    rows = spark.range(1_000_000).select(F.lit("v").alias("video_id"), (F.col("id") + 1).cast("int").alias("frame_idx"), (F.col("id") / 60).alias("ts"), (F.col("id") % 10 == 0).alias("is_flash"))
    r = flash.violations(rows).filter("not incomplete").agg(F.count("*").alias("n"), F.min("flash_count").alias("least"), F.max("end_frame").alias("last")).first()
    assert r.n == 14_285 and r.least == 7 and r.last > 999_000


@pytest.mark.parametrize("rows_a_block", [1, 3, 40, 10_000])
def test_rate_limit_in_blocks(spark, rows_a_block):
    rng = np.random.default_rng(rows_a_block)
    videos = {v: np.cumsum(rng.choice([0.0, 0.004, 0.01, 0.0166667, 1 / 60, 3.0], 200)) for v in ("a", "b")}
    rows = spark.createDataFrame([(v, k, float(t)) for v, ts in videos.items() for k, t in enumerate(ts)], "video_id string, frame_idx int, ts double")
    got = {(r.video_id, r.frame_idx) for r in frames.limit_rate(rows, 1 / 60, rows_a_block).collect()}
    assert got == {(v, k) for v, ts in videos.items() for k in frames.kept_times(ts, 1 / 60)}


def test_rate_limit_keeps_rows_of_a_null_video(spark):
    rows = spark.createDataFrame([(None, 1, 0.0), (None, 2, 1.0), ("a", 1, 0.0)], "video_id string, frame_idx int, ts double")
    assert frames.limit_rate(rows).count() == 3


def test_pixels_are_read_once(spark, sf):
    """The whole analysis has one pass over the rasters; blocks take whole rows along and nothing is joined."""
    rows = analysis.analyze(frames.frames_from_embeddings(spark.read.parquet(f"{sf}/embeddings.parquet")), flags=Flags(red=True, temporal_contrast=True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_rows_without_a_time_keep_their_columns(spark):
    """Null and NaN times have null fields, also where the video is null; other columns are as they were."""
    data = [("v", 1, 0.0, 1.0, [1]), ("v", 2, None, 2.0, None), (None, 3, float("nan"), 3.0, [3]), ("v", 4, 0.5, None, [4]), ("v", 5, -70.0, 2.0, [5])]
    rows = spark.createDataFrame(data, "video_id string, frame_idx int, ts double, x double, other array<int>")
    made = sliding.in_time_blocks(rows, {"d": F.col("x")}, 1.0, sliding.contrast_kernel(1.0, 2.3, 1.0, 1), sliding.CONTRAST_FIELDS)
    got = {r.frame_idx: r for r in made.collect()}
    assert [got[k].other for k in range(1, 6)] == [[1], None, [3], [4], [5]] and made.columns[:5] == rows.columns
    assert [got[k].w_count for k in range(1, 6)] == [1, None, None, 2, 1]
    assert sliding.in_time_blocks(rows.limit(0), {"d": F.col("x")}, 1.0, sliding.contrast_kernel(1.0, 2.3, 1.0, 1), sliding.CONTRAST_FIELDS).count() == 0


def test_json_files_are_read_by_several_tasks(spark, tmp_path):
    for k in range(12):  # what tells the ranges is a few bytes a file, and must not decide how many tasks read them
        (tmp_path / f"{k}.json").write_text(json.dumps([{"n": k, "s": "x" * 50}] * 40))
    rows = documents._list_rows(spark, str(tmp_path), 500)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and rows.count() == 480


def test_pixels_are_laid_out_in_slices():
    import pyarrow as pa

    rasters = [b"x" * 400, None, b"", b"x" * 5000, b"x" * 400, b"x" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6))] * 3 + [pa.array(rasters, pa.binary())], ["video_id", "frame_idx", "width", "rgba"])
    got = list(frame_metrics.by_bytes(batch, 1000))
    assert [b.num_rows for b in got] == [3, 1, 2] and [x for b in got for x in b.column(3).to_pylist()] == rasters
    assert list(frame_metrics.by_bytes(batch.slice(0, 0))) == []


def test_partitions_of_a_long_video_are_bounded(tmp_path, monkeypatch):
    (tmp_path / "v.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F30:1 Cmono\n" + (b"FRAME\n" + b"\x80" * 16) * 500)
    parts = lambda: video.Y4mReader({"path": str(tmp_path), "partitionbytes": 22}).partitions()
    assert len(parts()) == 500
    monkeypatch.setattr(video, "MOST_PARTITIONS", 10)
    got = parts()
    assert len(got) <= 11 and [k for p in got for k in range(p.first, p.last)] == list(range(500))


def test_texts_of_reports_are_made_after_the_sort(spark, sf, tmp_path):
    rows = catalog.flagged(spark, sf).withColumn("timestamp", F.col("ts"))
    pieces, text = documents.report_pieces(rows, made_at="x")
    assert "string" not in {k for n, k in pieces.dtypes if n not in ("video_id", "metadata")} and pieces.select(text.alias("t")).filter("t is null").count() == 0


def test_parts_go_as_documents_are_joined(tmp_path):
    """A document of one part is that part renamed; a task that runs again finds what the first attempt left."""
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    part = lambda name, text, kind, last: (tmp_path / name).write_text(text) and {"kind": kind, "at": 0.0, "last": last, "part": str(tmp_path / name)}
    (tmp_path / "_parts").mkdir()
    one = [part("a", "whole", 0, 2)]
    node = os.stat(tmp_path / "a").st_ino
    for _ in range(2):
        documents._join_parts(fs, str(tmp_path), one, str(tmp_path / "one.json"))
    assert os.stat(tmp_path / "one.json").st_ino == node and not (tmp_path / "a").exists()
    more = [part("b", "[1", 0, 1), part("c", "2", 1, 1), part("d", "]", 2, 2)]
    documents._join_parts(fs, str(tmp_path), more, str(tmp_path / "more.json"))
    part("d", "]", 2, 2)
    documents._join_parts(fs, str(tmp_path), more, str(tmp_path / "more.json"))  # ended before its last part went
    assert (tmp_path / "more.json").read_text() == "[1,\n2]" and sorted(os.listdir(tmp_path)) == ["_parts", "more.json", "one.json"]
    with pytest.raises(FileNotFoundError):
        documents._join_parts(fs, str(tmp_path), more, str(tmp_path / "none.json"))


def test_documents_are_on_disk_by_groups_of_videos(spark, sf, monkeypatch):
    from photowarden import catalog_plans

    seen = []

    def read(path):
        seen.append((path.removeprefix("file://"), sorted(n for n in os.listdir(path.removeprefix("file://")) if n.endswith(".json"))))
        return spark.read.schema("metadata struct<videoTitle: string, totalFramesAnalyzed: bigint>").option("multiLine", True).json(path).select("metadata.*")

    monkeypatch.setattr(catalog_plans, "REPORT_ROWS", 300)
    got = catalog_plans._event_reports(spark, sf, read).collect()
    want = catalog.flagged(spark, sf).groupBy(F.col("video_id").cast("string")).count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    names = [n for _, found in seen for n in found]
    assert len(seen) > 1 and sorted(names) == sorted(f"{r[0]}.json" for r in want) and not any(os.path.exists(p) for p, _ in seen)


def test_ranges_that_follow_each_other_are_read_as_one():
    mb = 1 << 20
    ranges = [("x", a, a + mb, 40 * mb) for a in range(0, 40 * mb, mb)] + [("y", 0, 5, 5), ("z", 7, 9, 20), ("z", 12, 20, 20)]
    assert list(documents._runs(iter(ranges))) == [["x", 0, 32 * mb, 40 * mb], ["x", 32 * mb, 40 * mb, 40 * mb], ["y", 0, 5, 5], ["z", 7, 9, 20], ["z", 12, 20, 20]]
    assert len(list(documents._runs(("x", a, a + 7, 7000) for a in range(0, 7000, 7)))) == -(-1000 // documents.RUN)


class Handle:
    """What a stateful processor gets from Spark: one state variable and timers; writes are counted."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def bucket_rows(processor, handle, batches, now=0):
    import pandas as pd

    handle.now, out = now, []
    for rows in batches:
        frames = pd.DataFrame([(v, k, t, b, *[b / 2] * 7) for v, k, t, b in rows], columns=["video_id", "frame_idx", "ts", *ordered.RISK_INPUTS])
        out += [r for made in processor.handleInputRows((0,), iter([frames]), handle) for r in made.itertuples(index=False)]
    return out


@pytest.mark.parametrize("make", [lambda: ordered.LiveRisk(1.0, 5000, 0.2, 2.0), lambda: ordered.FlashEvents(1.0, 5000, 0.2, 0.3, 3, 1.0)])
def test_videos_of_a_bucket_are_one_call(make):
    """Two videos in one bucket give what each gives alone, with one write of state a micro-batch; a quiet one ends alone."""
    rng = random.Random(3)
    videos = {v: [(v, k, k * step, rng.choice([0.0, 0.1, 1.0])) for k in range(60)] for v, step in (("a", 0.05), (None, 0.2))}
    alone, ends = {}, {}
    for v, rows in videos.items():
        one, h = make(), Handle()
        one.init(h)
        alone[str(v)] = bucket_rows(one, h, [rows[10:25][::-1], rows[:10] + rows[25:40], rows[40:]])
        h.now = 10**12
        ends[str(v)] = [r for made in one.handleExpiredTimer((0,), h, None) for r in made.itertuples(index=False)]
        assert h.value is None
    both, h = make(), Handle()
    both.init(h)
    batches = [sorted((r for rows in videos.values() for r in part(rows)), key=lambda r: (r[1] * 7) % 60) for part in (lambda x: x[10:25], lambda x: x[:10] + x[25:40], lambda x: x[40:])]
    got = bucket_rows(both, h, batches)
    assert h.writes == 3 and got and {v: [r for r in got if r.video_id == v] for v in alone} == alone
    h.now = live.event_ms(59 * 0.05) + 5000  # the first is over, the other isn't
    last = [r for made in both.handleExpiredTimer((0,), h, None) for r in made.itertuples(index=False)]
    assert last == ends["a"] and h.value[0] == [None] and h.timers[-1] == live.event_ms(59 * 0.2) + 5000


def test_shuffled_batches_of_several_files(spark, sf, monkeypatch, tmp_path):
    """Micro-batches have the same rows whether they are a file or several."""
    from photowarden import catalog_live

    rows, found = catalog_live._narrow(catalog.flagged(spark, sf)), {}
    for least in (10**6, 20):
        monkeypatch.setattr(catalog_live, "FILE_ROWS", least)
        monkeypatch.setattr(catalog_live, "passing_folder", lambda spark, name, least=least: f"{tmp_path}/{name}{least}")
        got = found[least] = []
        stream = catalog_live._shuffled(spark, rows)
        q = stream.writeStream.foreachBatch(lambda b, n, got=got: got.append(sorted(map(tuple, b.select("video_id", "frame_idx").collect())))).option("checkpointLocation", f"{tmp_path}/c{least}").trigger(availableNow=True).start()
        q.awaitTermination()
        files = [f for f in os.listdir(f"{tmp_path}/shuffled{least}") if f.endswith(".parquet")]
        assert len(got) == 10 and (len(files) == 10 if least > 20 else len(files) > 10 and len(files) % 10 == 0)
    assert found[20] == found[10**6] and sum(map(len, found[20])) == rows.count()
