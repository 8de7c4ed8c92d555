"""JSON documents of any size: one a video, written by many tasks; lists of rows, read by many tasks.

Writing: rows are dealt to tasks by ranges of video and time. A task writes its rows as parts; when all have committed, each
video's parts are joined, byte by byte and in order, to one document under its own name, and go; a document of one part is that
part, under its new name. So disk holds documents once, but for those of several parts that are being joined. No document is
held as a string.

Reading: a file is cut into ranges of bytes. Whether a byte stands inside a string, and how deep, depends on all bytes before
it, so each range is first summed up for both answers to the first question (how many quotes, how the depth changes); running
sums over a file's few ranges then give every range its start. With that each range finds the commas of the list of rows and
reads the rows that begin in it, the last one on beyond its end.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from photowarden.functions.scalar import magnitude, to_fixed
from photowarden.runtime import ship
from photowarden.sources.store import materialized

PARTITION_BYTES = 32 << 20
_CHUNK = 1 << 20
#: Bytes that a task reads, about, where ranges are small.
TASK_BYTES = 16 << 20
#: Ranges that a task reads as one where they follow each other.
RUN = 64

# ---- reading -----------------------------------------------------------------------------------------------------------


def _files(path: str) -> list[tuple[str, int]]:
    fs, inside = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"{path} is not there")
    found = [f for f in fs.get_file_info(pafs.FileSelector(inside)) if f.size] if info.type == pafs.FileType.Directory else [info]  # a task without rows leaves an empty file
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def _escaped_before(f, at: int) -> bool:
    """Whether the byte at a place follows an odd run of backslashes."""
    n = 0
    while at - n > 0:
        f.seek(at - n - 1)
        if f.read(1) != b"\\":
            break
        n += 1
    return bool(n & 1)


class Scan:
    """Structure of a piece of JSON, given where it starts: open (+1) and close (-1) brackets, and commas, outside strings."""

    def __init__(self, data: bytes, escaped: bool = False, in_string: bool = False):
        buf = np.frombuffer(data, np.uint8)
        quote, slash = buf == 0x22, buf == 0x5C
        self.escaped_after = False
        if escaped or slash.any():
            # a character is escaped by an odd run of backslashes before it
            place = np.arange(len(buf))
            last_other = np.maximum.accumulate(np.where(slash, -1, place))
            run = place - last_other  # length of the run that ends here, 0 where there is none
            if escaped:
                run = np.where(last_other < 0, run + 1, run)
            before = np.concatenate(([1 if escaped else 0], run[:-1])) if len(buf) else run
            quote &= before % 2 == 0
            self.escaped_after = bool(len(buf) and slash[-1] and run[-1] % 2)
        self.quotes = int(quote.sum())
        self.text = np.logical_xor.accumulate(quote) ^ in_string if len(buf) else quote  # inside a string, or its opening quote
        self.text |= quote
        step = np.zeros(len(buf), np.int8)
        step[(buf == 0x5B) | (buf == 0x7B)] = 1
        step[(buf == 0x5D) | (buf == 0x7D)] = -1
        self.steps = np.where(self.text, np.int8(0), step)
        self.all_steps = int(step.sum(dtype=np.int64))
        self.buf = buf


def _scans(f, a: int, b: int, escaped: bool, inside: bool) -> Iterator[tuple[int, Scan]]:
    """Places and scans of the pieces of a range, one after the other."""
    for offset in range(a, b, _CHUNK):
        f.seek(offset)
        scan = Scan(f.read(min(_CHUNK, b - offset)), escaped, inside)
        yield offset, scan
        escaped, inside = scan.escaped_after, bool((inside + scan.quotes) % 2)


def _name_before(f, at: int) -> bytes | None:
    """The name that a value beginning at a place has in its object; None in a list."""
    f.seek(max(0, at - 64))
    if not f.read(min(64, at)).rstrip().endswith(b":"):
        f.seek(max(0, at - 4096))
        if not f.read(min(4096, at)).rstrip().endswith(b":"):
            return None
    f.seek(max(0, at - 4096))
    key = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', f.read(min(4096, at)))
    return key[1] if key else None


def _runs(ranges: Iterator[tuple[str, int, int, int]]) -> Iterator[list]:
    """Ranges (file, from, to, size) in order, those that follow each other in a file taken together, up to PARTITION_BYTES."""
    run, n = None, 0
    for name, a, b, size in ranges:
        if run is not None and n < RUN and (run[0], run[2], run[1] // PARTITION_BYTES) == (name, a, a // PARTITION_BYTES):
            run[2], n = b, n + 1
            continue
        if run is not None:
            yield run
        run, n = [name, a, b, size], 1
    if run is not None:
        yield run


class _Opened:
    """Keeps the file open that was read last: a task's ranges of a file follow each other."""

    def __init__(self, path: str):
        self.fs, self.name, self.file = pafs.FileSystem.from_uri(path)[0], None, None

    def __call__(self, name: str):
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(name)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def _list_rows(spark: SparkSession, path: str, partition_bytes: int) -> DataFrame:
    """file, value: the text of each row of each file, in one of the four shapes."""
    ship(spark)
    files = _files(path)
    many = sum(-(-max(size, 1) // partition_bytes) for _, size in files)
    tasks = max(1, min(many, 4096, max(spark.sparkContext.defaultParallelism, sum(size for _, size in files) // TASK_BYTES)))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(partition_bytes).cast("long")))
    listed = spark.createDataFrame(files, "file string, size long").select("file", begin.alias("a"), "size")
    listed = listed.select("file", "a", F.least(F.col("a") + partition_bytes, F.col("size")).alias("b"), "size")

    def dealt(rows: DataFrame) -> DataFrame:
        # by count, which isn't taken together again for being a few bytes: each row is a range of a file to be read
        return rows.repartition(tasks, "file", F.floor(F.col("a") / PARTITION_BYTES)).sortWithinPartitions("file", "a")

    def sums(batches):
        opened = _Opened(path)
        for batch in batches:
            rows = []
            for name, a, b, size in _runs(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                f = opened(name)
                escaped = _escaped_before(f, a)
                quotes = plain = every = 0
                for _, scan in _scans(f, a, b, escaped, False):
                    quotes, plain, every = quotes + scan.quotes, plain + int(scan.steps.sum(dtype=np.int64)), every + scan.all_steps
                rows.append((name, a, b, size, quotes % 2, plain, every - plain, escaped))  # what stands outside strings is inside them if the range begins in one
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 6, pa.bool_()))], [*batch.schema.names, "odd", "plain", "text", "escaped"])
        opened.close()

    w = Window.partitionBy("file").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt(listed).mapInArrow(sums, "file string, a long, b long, size long, odd long, plain long, text long, escaped boolean")
    summed = summed.withColumn("inside", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2 == 1)
    summed = summed.withColumn("change", F.when(F.col("inside"), F.col("text")).otherwise(F.col("plain")))
    starts = summed.withColumn("depth", F.coalesce(F.sum("change").over(w), F.lit(0))).select("file", "a", "b", "size", "escaped", "inside", "depth", "change", (F.col("inside") != (F.col("odd") == 1)).alias("ends_inside"))
    starts = materialized(starts)  # one row a range, read twice

    def lists(batches):
        """Lists that open outside of everything or behind a name in the outermost object, and what is wrong."""
        opened = _Opened(path)
        for batch in batches:
            rows = []
            for name, a, b, size, escaped, inside, depth, change, ends_inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, at = opened(name), depth
                wrong = (b == size and (depth + change != 0 or ends_inside)) or size == 0
                for offset, scan in _scans(f, a, b, escaped, inside):
                    levels = at + np.cumsum(scan.steps, dtype=np.int64)
                    wrong = wrong or bool(len(levels) and levels.min() < 0)
                    for k in np.flatnonzero((scan.steps == 1) & ((levels == 1) | (levels == 2) & (scan.buf == 0x5B))).tolist():
                        level = int(levels[k]) - 1
                        key = _name_before(f, offset + k) if level == 1 else None
                        if level == 0 or key in (b"analysis", b"data"):
                            rows.append((name, offset + k, level, chr(scan.buf[k]), key.decode() if key else "", False))
                    at = int(levels[-1]) if len(levels) else at
                if wrong:
                    rows.append((name, a, -1, "", "", True))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], ["file", "at", "level", "bracket", "key", "wrong"])
        opened.close()

    found = dealt(starts).mapInArrow(lists, "file string, at long, level long, bracket string, key string, wrong boolean")
    bare = F.min(F.when((F.col("level") == 0) & (F.col("bracket") == "["), F.col("at")))
    named = lambda key: F.min(F.when((F.col("level") == 1) & (F.col("key") == key), F.col("at")))
    chosen = found.groupBy("file").agg(bare.alias("bare"), named("analysis").alias("analysis"), named("data").alias("data"), F.min(F.when(F.col("level") == 0, F.col("at"))).alias("one"), F.count_if(F.col("level") == 0).alias("roots"), F.max("wrong").alias("wrong"))
    every = listed.select("file").distinct().join(chosen, "file", "left")
    damaged = F.coalesce(F.col("wrong"), F.lit(False)) | F.coalesce(F.col("roots") != 1, F.lit(True))
    every = every.withColumn("at", F.when(damaged, F.raise_error(F.concat(F.lit("no whole JSON document: "), F.col("file"))).cast("long")).otherwise(F.coalesce("bare", "analysis", "data", "one")))
    every = every.select("file", "at", F.coalesce("bare", "analysis", "data").isNull().alias("single"), F.when(F.col("bare").isNotNull(), 1).otherwise(2).alias("level"))

    def rows_of(batches):
        opened = _Opened(path)
        made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([t.decode("utf-8") for t in texts], pa.string())], ["file", "value"])
        names, texts = [], []
        for batch in batches:
            for name, a, b, escaped, inside, depth, at, single, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = opened(name)
                if single:
                    if a <= at < b:
                        f.seek(at)
                        names.append(name)
                        texts.append(f.read())
                    continue
                for text in _elements(f, a, b, escaped, inside, depth, at, level):
                    names.append(name)
                    texts.append(text)
                    if len(texts) >= 4096:
                        yield made()
                        names, texts = [], []
        yield made()
        opened.close()

    placed = starts.join(every, "file").select("file", "a", "b", "escaped", "inside", "depth", "at", "single", "level")
    return dealt(placed).mapInArrow(rows_of, "file string, value string")


def _elements(f, a: int, b: int, escaped: bool, inside: bool, depth: int, at: int, level: int) -> Iterator[bytes]:
    """Elements of the list that opens at `at` and whose elements stand at depth `level`, if the bracket or comma before
    them is in a..b."""
    if b <= at:
        return
    begin: int | None = None  # offset of the element being read
    held: list[bytes] = []
    offset = a
    while True:
        f.seek(offset)
        data = f.read(min(_CHUNK, max(b - a, 4096)) if offset >= b else min(_CHUNK, b - offset))  # the last element goes on beyond
        if not data:
            return
        scan = Scan(data, escaped, inside)
        levels = depth + np.cumsum(scan.steps)
        places = offset + np.arange(len(data))
        cut = ((scan.buf == 0x2C) & ~scan.text & (levels == level)) | ((scan.steps == -1) & (levels == level - 1))
        cut &= places > at
        marks = np.flatnonzero(cut)
        if offset <= at < offset + len(data):
            marks = np.concatenate(([at - offset], marks))
        for k in marks.tolist():
            if begin is not None:
                text = b"".join([*held, data[max(0, begin - offset) : k]]).strip()
                held = []
                if text or data[k] == 0x2C:
                    yield text
            closes = data[k] in b"]}" and offset + k != at
            if closes or offset + k >= b:
                return
            begin = offset + k + 1
        if begin is not None:
            held.append(data[max(0, begin - offset) :])
        elif offset + len(data) >= b:
            return
        depth = int(levels[-1])
        inside = bool((inside + scan.quotes) % 2)
        escaped = scan.escaped_after
        offset += len(data)


def read_rows(spark: SparkSession, path: str, schema: T.StructType, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of JSON files that are each a list of rows, {"analysis": rows}, {"data": rows} or one row; white space may stand
    anywhere. A damaged file, or a row that doesn't fit the schema, ends the read."""
    rows = _list_rows(spark, path, partition_bytes)
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


# ---- writing -----------------------------------------------------------------------------------------------------------


class Parts(WriterCommitMessage):
    def __init__(self, parts: list[tuple]):
        self.parts = parts


class PartWriter(DataSourceArrowWriter):
    """Parts of documents: runs of rows of one video in a task. Columns: video_id, kind, at, text."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{folder}/_parts", recursive=True)
        parts: list[list] = []
        out = None
        try:
            for batch in iterator:
                for video, kind, at, text in self._texts(batch):
                    if out is None or parts[-1][0] != video:
                        if out is not None:
                            out.close()
                        parts.append([video, kind, at, kind, f"{folder}/_parts/{uuid.uuid4().hex}"])
                        out = fs.open_output_stream(parts[-1][4])
                    elif kind == parts[-1][3] == 1:
                        out.write(b",\n")
                    out.write(text)
                    parts[-1][3] = kind
        finally:
            if out is not None:
                out.close()
        return Parts([tuple(p) for p in parts])

    @staticmethod
    def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Video, kind, first place and joined text of the rows of one video and kind that follow each other."""
        if not batch.num_rows:
            return
        video, kind = batch.column("video_id"), batch.column("kind").to_numpy()
        codes = pc.dictionary_encode(video, null_encoding="encode").indices.to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(kind) != 0)) + 1))
        runs = pa.ListArray.from_arrays(pa.array([*starts, len(kind)], pa.int32()), batch.column("text").cast(pa.large_string()))
        joined = pc.binary_join(runs, pa.array(np.where(kind[starts] == 1, ",\n", ""), pa.large_string()))
        at = batch.column("at").to_numpy()[starts].tolist()
        for k, (v, t) in enumerate(zip(video.take(pa.array(starts)).to_pylist(), joined, strict=True)):
            yield v, int(kind[starts[k]]), at[k], t.as_buffer()

    def commit(self, messages: list) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        with fs.open_output_stream(f"{folder}/_parts/manifest.json") as out:
            for p in itertools.chain.from_iterable(m.parts for m in messages if m is not None):
                out.write(json.dumps(dict(zip(("video", "kind", "at", "last", "part"), p, strict=True))).encode() + b"\n")

    def abort(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for p in itertools.chain.from_iterable(m.parts for m in messages if m is not None):
            fs.delete_file(p[4])


class DocumentParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return "video_id string, kind int, at double, text string"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options)


def write_documents(pieces: DataFrame, path: str, text: Column | None = None) -> None:
    """<path>/<video>.json for each video of pieces: video_id, kind (0: text before the list, 1: an element, 2: text after
    it), at (order of the elements), text. Existing documents of these names are replaced.

    text: made of the pieces' other columns when they are in order, so that texts are neither exchanged nor sorted."""
    spark = pieces.sparkSession
    ship(spark)
    spark.dataSource.register(DocumentParts)
    keys = ("video_id", "kind", "at")
    rows = pieces.withColumns({"video_id": F.col("video_id").cast("string"), "kind": F.col("kind").cast("int"), "at": F.coalesce(F.col("at").cast("double"), F.lit(0.0))})
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select(*keys, (F.col("text") if text is None else text).alias("text")).write.format("document_parts").mode("append").save(path)
    fs, folder = pafs.FileSystem.from_uri(path)
    uri = path[: len(path) - len(folder)] if path.endswith(folder) else ""
    manifest = spark.read.schema("video string, kind int, at double, last int, part string").json(f"{uri}{folder}/_parts/manifest.json")
    joined = manifest.repartition(spark.sparkContext.defaultParallelism, "video").groupBy("video").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "last", "part"))).alias("parts"))

    def join(batches):
        fs = pafs.FileSystem.from_uri(path)[0]
        for batch in batches:
            for video, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _join_parts(fs, folder, parts, f"{folder}/{re.sub(r'[^A-Za-z0-9_.-]', '_', str(video))}.json")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["video"])

    joined.mapInArrow(join, "video string").count()
    fs.delete_dir(f"{folder}/_parts")


def _join_parts(fs: pafs.FileSystem, folder: str, parts: list[dict], target: str) -> None:
    """Makes a document of its parts, in order, which go. Parts go when the document is there, so where one is missing an
    earlier attempt of the task has made it."""
    there = [i.type != pafs.FileType.NotFound for i in fs.get_file_info([p["part"] for p in parts])]
    if not all(there):
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"parts of {target} are not there")
        parts = [p for p, t in zip(parts, there, strict=True) if t]
    elif len(parts) == 1:
        fs.move(parts[0]["part"], target)
        return
    else:
        name = f"{folder}/_parts/{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as out:
            last = 0
            for p in parts:
                if p["kind"] == last == 1:
                    out.write(b",\n")
                with fs.open_input_stream(p["part"]) as f:
                    while data := f.read(_CHUNK):
                        out.write(data)
                last = p["last"]
        fs.move(name, target)
    for p in parts:
        fs.delete_file(p["part"])


def remove(path: str) -> None:
    """Documents that are no longer needed, with their folder."""
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.delete_dir(folder)


# ---- the report of a video ---------------------------------------------------------------------------------------------

# The report's fields. Name: source column and decimals as text (None: a whole number, "as it is": the value).
_RGB = ("r", "g", "b")
_CONTRAST = {
    "sensitivity": ("sensitivity", 4), "fluctuations": ("fluctuations", 4), "averageDeltaE": ("average_delta_e", 4), "maxDeltaE": ("max_delta_e", 4), "significantChanges": ("significant_changes", None),
    "totalSamples": ("total_samples", None), "fluctuationRate": ("fluctuation_rate", 4), "weightedAverageDeltaE": ("weighted_average_delta_e", 4), "windowSize": ("window_size", None), "weightDecay": ("weight_decay", 6),
    "coefficientOfVariation": ("coefficient_of_variation", 4), "medianDeltaE": ("median_delta_e", 4), "p90DeltaE": ("p90_delta_e", 4), "p95DeltaE": ("p95_delta_e", 4),
}
ENTRY: dict = {
    "timestamp": ("timestamp", 6), "brightness": ("brightness", 4), "isFlash": ("is_flash", "as it is"), "intensity": ("intensity", 4),
    "colorVariance": {
        "current": {c: (f"color_variance.current.{c}", 4) for c in _RGB}, "temporal": {c: (f"color_variance.temporal.{c}", 4) for c in _RGB},
        "averageChange": {**{c: (f"color_variance.average_change.{c}", 4) for c in _RGB}, "magnitude": ("color_change_magnitude", 4)}, "spikes": ("color_variance.spikes", "as it is"),
    },
    "temporalChange": ("temporal_change", 4), "flickerFrequency": ("flicker_frequency", 2), "entropy": ("entropy", 4),
    "psi": {"score": ("psi.score", 4), "components": {c: (f"psi.components.{c}", 4) for c in ("frequency", "intensity", "coverage", "duration")}},
    "frameDifference": {"difference": ("frame_difference.difference", 4), "motion": ("frame_difference.motion", 4)},
    "spectralAnalysis": {
        "dominantFrequency": ("spectral_analysis.dominant_frequency", 2), "dominantInstFreq": ("spectral_analysis.dominant_inst_freq", 2), "spectrum": ("spectral_analysis.spectrum", "as it is"),
        "spectralFlatness": ("spectral_flatness", 4), "confidence": ("spectral_analysis.confidence", 4),
    },
    "temporalCoherence": {"score": ("temporal_coherence.coherence_score", 4), "periodicity": ("temporal_coherence.periodicity", "as it is")},
    "edgeDetection": {"density": ("edge_detection.edge_density", 4), "count": ("edge_detection.edge_count", None), "change": ("edge_detection.temporal_edge_change", 4)},
    "redIntensity": ("red_intensity", 4), "redDelta": ("red_delta", 4), "dominantColor": {c: (f"dominant_color.{c}", 1) for c in _RGB}, "dominantLab": {c: (f"dominant_lab.{c}", 2) for c in ("L", "a", "b")},
    "cie76Delta": ("cie76_delta", 4), "patternedStimulusScore": ("patterned_stimulus_score", 4), "sceneChangeScore": ("scene_change_score", 4),
    "contrastSensitivity": {k: (f"contrast_sensitivity.{c}", p) for k, (c, p) in _CONTRAST.items()},
}
TEMPORAL_ENTRY: dict = {
    "startTime": ("temporal_contrast_sensitivity.start_time", 2), "endTime": ("temporal_contrast_sensitivity.end_time", 2), "duration": ("temporal_contrast_sensitivity.duration", 2), "sampleCount": ("temporal_contrast_sensitivity.sample_count", None),
    **{k: (f"temporal_contrast_sensitivity.{c}", p) for k, (c, p) in _CONTRAST.items()}, "streamWeightedAverageDeltaE": ("temporal_contrast_sensitivity.stream_weighted_average_delta_e", 4),
}
RED_ENTRY: dict = {
    "redAreaAvg": ("red_metrics.red_area_avg", 4), "redAreaMax": ("red_metrics.red_area_max", 4), "redOnFraction": ("red_metrics.red_on_fraction", 4), "redTransitions": ("red_metrics.red_transitions", None),
    "redFlashEvents": ("red_metrics.red_flash_events", None), "redFlashPerSecond": ("red_metrics.red_flash_per_second", 4), "redFlickerInRiskBand": ("red_metrics.red_flicker_in_risk_band", "as it is"), "redState": ("red_state", None),
}
#: Frames of the colour history.
HISTORY = 30


def _has(schema: T.DataType, path: list[str]) -> bool:
    return not path or isinstance(schema, T.StructType) and path[0] in schema.names and _has(schema[path[0]].dataType, path[1:])


def _sources(fields: dict) -> Iterator[str]:
    """Source columns of an entry's fields."""
    for source in fields.values():
        yield from _sources(source) if isinstance(source, dict) else (source[0],)


def _entry(fields: dict, schema: T.StructType, within: str) -> Iterator[str | Column]:
    """The text of an entry, as to_json has it, in pieces: what every row has (a report has many fields that rows don't), and
    what depends on the row. A field that is as it is goes where it is null, so it is never an object's first."""
    comma = ""
    for name, source in fields.items():
        begin, comma = f'{comma}"{name}":', ","
        if isinstance(source, dict):
            yield begin + "{"
            yield from _entry(source, schema, within)
            yield "}"
            continue
        path, places = source
        there = F.col(f"{within}.{path}") if _has(schema, path.split(".")) else None
        if places == "as it is":
            if there is not None:
                value = F.to_json(F.struct(there.alias("v")))  # {"v":value}
                yield F.when(there.isNotNull(), F.concat(F.lit(begin), F.substring(value, F.lit(6), F.length(value) - 6))).otherwise("")
            elif name in ("spikes", "spectrum"):
                yield begin + "[]"
        elif places is None:
            yield begin
            yield "0" if there is None else F.coalesce(there.cast("long"), F.lit(0).cast("long")).cast("string")
        else:
            yield begin + '"'
            yield f"{0:.{places}f}" if there is None else to_fixed(there, places)
            yield '"'


def _entry_text(fields: dict, schema: T.StructType, within: str) -> Column:
    pieces = itertools.groupby(("{", *_entry(fields, schema, within), "}"), lambda p: isinstance(p, str))
    return F.concat(*itertools.chain.from_iterable([F.lit("".join(same))] if text else same for text, same in pieces))


def report_pieces(rows: DataFrame, red: bool = False, temporal_contrast: bool = False, title: Column | None = None, made_at: str | None = None) -> tuple[DataFrame, Column]:
    """The pieces and their text, for write_documents, of one report a video: metadata, the entries in order of time, the colour history.

    rows: those of plans.analysis. made_at: the metadata's date (ISO); now, if None. The colour history has the mean colours
    of the last HISTORY frames, oldest first, from mean_color, or else dominant_color; it is empty without either.
    """
    rows = rows.filter("timestamp >= 0")
    have = rows.schema
    if "color_change_magnitude" not in have.names and "color_variance" in have.names:
        rows = rows.withColumn("color_change_magnitude", magnitude(*(F.col(f"color_variance.average_change.{c}") for c in _RGB)))
        have = rows.schema
    entry = dict(ENTRY)
    if temporal_contrast and "temporal_contrast_sensitivity" in have.names:
        entry["temporalContrastSensitivity"] = TEMPORAL_ENTRY
    if red:
        entry["redMetrics"] = RED_ENTRY
    order = F.struct("timestamp", "frame_idx")
    bins = F.col("spectral_analysis.bin_resolution") if _has(have, ["spectral_analysis", "bin_resolution"]) else F.lit(0.0)
    level = F.max_by("risk_level", order) if "risk_level" in have.names else F.lit("low")
    made = F.lit(made_at) if made_at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    facts = rows.groupBy("video_id").agg(
        F.count("*").alias("frames"), F.count_if("is_flash").alias("flashes"), level.alias("level"), F.coalesce(F.min_by(F.when(bins != 0, bins), F.when(bins != 0, order)), F.lit(0.0)).alias("bins"),
    )
    metadata = F.struct(
        (title if title is not None else F.col("video_id").cast("string")).alias("videoTitle"), made.alias("analysisDate"), F.col("frames").alias("totalFramesAnalyzed"), F.col("flashes").alias("totalFlashesDetected"),
        F.col("level").alias("riskLevel"), F.lit(red).alias("redMetricsEnabled"), F.lit(temporal_contrast).alias("temporalContrastEnabled"), F.col("bins").alias("spectralBinResolution"),
    )
    head = facts.select("video_id", F.lit(0).alias("kind"), F.lit(0.0).alias("at"), metadata.alias("metadata"))
    used = sorted({c.split(".")[0] for c in _sources(entry)} & set(have.names))
    body = rows.select("video_id", F.lit(1).alias("kind"), F.col("timestamp").alias("at"), F.struct(*used).alias("row"))
    color = next((c for c in ("mean_color", "dominant_color") if c in have.names), None)
    recent = rows.withColumn("_k", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("timestamp"), F.desc("frame_idx")))).filter(F.col("_k") <= HISTORY)
    kept = F.array_sort(F.collect_list(F.struct(-F.col("_k"), *((F.col(f"{color}.{c}") if color else F.lit(0.0)).alias(c) for c in _RGB))))
    history = F.struct(*((F.col(f"h.{c}") if color else F.array().cast("array<double>")).alias(c) for c in _RGB))
    tail = recent.groupBy("video_id").agg(kept.alias("h")).select("video_id", F.lit(2).alias("kind"), F.lit(0.0).alias("at"), history.alias("history"))
    first, last = F.concat(F.lit('{\n"metadata": '), F.to_json("metadata"), F.lit(',\n"analysis": [\n')), F.concat(F.lit('\n],\n"colorHistory": '), F.to_json("history"), F.lit("\n}\n"))
    text = F.when(F.col("kind") == 0, first).when(F.col("kind") == 1, _entry_text(entry, have, "row")).otherwise(last)
    return head.unionByName(body, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True), text


def write_reports(rows: DataFrame, path: str, **options) -> None:
    """<path>/<video>.json: the report of each video."""
    pieces, text = report_pieces(rows, **options)
    write_documents(pieces, path, text)
