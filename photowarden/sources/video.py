"""Uncompressed video files (YUV4MPEG2, .y4m) as a data source: batch, stream and sink.

A file is a header line and frames of one size, so a frame's place follows from its number: files are planned as ranges of
frames of about partitionBytes (longer, where that made over 1,024 of them), and a long file is many tasks. A frame is read, turned from YUV to RGBA in whole numbers and,
with sample=k, averaged over blocks of k by k pixels; only a few frames are in memory at once. Row: sources.frames.FRAMES,
with the file's name (without .y4m) as video_id and ts from the header's rate.

As a stream the offset is the number of whole frames of each file, so files may grow and appear while they are read. A
query that starts again from its checkpoint goes on at the frame behind the last one that was committed.

Defined results: a last frame that isn't whole is left out (it may still be being written); an empty file, or one whose
header line isn't whole, has no frames yet; a file that isn't YUV4MPEG2, has more than 8 bits a sample, or a frame that
doesn't begin where it should end the read; without a rate a video has 30 frames a second.
"""

from __future__ import annotations

import fnmatch
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from photowarden.runtime import ship
from photowarden.sources.frames import FRAMES

MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"
MOST_HEADER = 4096
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
#: Partitions of a read, about: where partitionBytes would ask for more, ranges are longer.
MOST_PARTITIONS = 1024
_ARROW = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int32()), ("ts", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())])
# BT.601 in millionths, for samples of the full range and of the video range (16..235, 16..240).
_TO_YUV = {
    True: (np.array([[299000, 587000, 114000], [-168736, -331264, 500000], [500000, -418688, -81312]]), np.array([0, 128, 128])),
    False: (np.array([[256788, 504129, 97906], [-148223, -290993, 439216], [439216, -367788, -71427]]), np.array([16, 128, 128])),
}
_TO_RGB = {
    True: (1000000, 0, np.array([0, 1402000]), np.array([-344136, -714136]), np.array([1772000, 0])),
    False: (1164383, 16, np.array([0, 1596027]), np.array([-391762, -812968]), np.array([2017232, 0])),
}
#: Samples a chroma sample spans, across and down.
_CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    fps: float
    layout: str
    full: bool
    size: int

    @property
    def chroma(self) -> tuple[int, int]:
        """Width and height of a chroma plane."""
        span = _CHROMA[self.layout]
        return (-(-self.width // span[0]), -(-self.height // span[1])) if span else (0, 0)

    @property
    def stride(self) -> int:
        """Bytes from one frame to the next."""
        w, h = self.chroma
        return len(FRAME) + self.width * self.height + 2 * w * h

    def frames(self, file_size: int) -> int:
        return max(0, file_size - self.size) // self.stride

    def line(self) -> bytes:
        rate = f"{round(self.fps * 1000)}:1000"
        return f"YUV4MPEG2 W{self.width} H{self.height} F{rate} Ip A1:1 C{self.layout}{' XCOLORRANGE=FULL' if self.full else ''}\n".encode()


def parse_header(data: bytes, name: str = "") -> Header | None:
    """The header at the start of a file; None if its line isn't whole yet."""
    if not data.startswith(MAGIC[: len(data)]):
        raise ValueError(f"{name} is no YUV4MPEG2 file")
    line, end, _ = data.partition(b"\n")
    if not end:
        if len(data) >= MOST_HEADER:
            raise ValueError(f"{name} has no header line")
        return None
    tags: dict[str, str] = {}
    full = False
    for word in line.decode("ascii", "replace").split(" ")[1:]:
        full = full or word.upper() == "XCOLORRANGE=FULL"
        if word and word[0] != "X":
            tags[word[0]] = word[1:]
    color = tags.get("C", "420")
    layout = next((k for k in _CHROMA if color in (k, f"{k}jpeg", f"{k}mpeg2", f"{k}paldv")), None)
    if layout is None:
        raise ValueError(f"{name} has the colour space {color}")
    if not tags.get("W", "").isdigit() or not tags.get("H", "").isdigit() or not int(tags["W"]) * int(tags["H"]):
        raise ValueError(f"{name} has no width or height")
    up, _, down = tags.get("F", "30:1").partition(":")
    fps = int(up) / int(down) if up.isdigit() and down.isdigit() and int(up) and int(down) else 30.0
    return Header(int(tags["W"]), int(tags["H"]), fps, layout, full or color == "420jpeg", len(line) + 1)


def to_rgba(y: np.ndarray, u: np.ndarray | None, v: np.ndarray | None, full: bool) -> np.ndarray:
    """(height, width, 4) from a luma plane and chroma planes that may be smaller; grey without chroma."""
    scale, black, *parts = _TO_RGB[full]
    out = np.empty((*y.shape, 4), np.uint8)
    light = (y.astype(np.int64) - black) * scale + 500000
    if u is not None:
        across, down = -(-y.shape[1] // u.shape[1]), -(-y.shape[0] // u.shape[0])
        spread = lambda c: np.repeat(np.repeat(c.astype(np.int64) - 128, down, 0), across, 1)[: y.shape[0], : y.shape[1]]
        u, v = spread(u), spread(v)
    for k, (of_u, of_v) in enumerate(parts):
        out[..., k] = np.clip((light + (u * of_u + v * of_v if u is not None else 0)) // 1000000, 0, 255)
    out[..., 3] = 255
    return out


def to_planes(rgba: np.ndarray, layout: str, full: bool) -> list[np.ndarray]:
    """Planes of a (height, width, 4) raster; a chroma sample is the mean over the pixels that it spans."""
    scale, base = _TO_YUV[full]
    rgb = rgba[..., :3].astype(np.int64)
    planes = [np.clip((rgb @ scale[0] + base[0] * 1000000 + 500000) // 1000000, 0, 255)]
    span = _CHROMA[layout]
    for k in (1, 2) if span else ():
        part = rgb @ scale[k] + base[k] * 1000000
        rows, columns = np.arange(0, part.shape[0], span[1]), np.arange(0, part.shape[1], span[0])
        n = np.diff(np.append(rows, part.shape[0]))[:, None] * np.diff(np.append(columns, part.shape[1]))
        sums = np.add.reduceat(np.add.reduceat(part, rows, 0), columns, 1)
        planes.append(np.clip((sums + n * 500000) // (n * 1000000), 0, 255))
    return [p.astype(np.uint8) for p in planes]


def sampled(rgba: np.ndarray, k: int) -> np.ndarray:
    """Means over blocks of k by k pixels, rounded; what doesn't fill a block at the right and lower border is left out,
    but a raster narrower than a block is one block across."""
    if k <= 1:
        return rgba
    wide, high = min(k, rgba.shape[1]), min(k, rgba.shape[0])
    h, w = rgba.shape[0] // high, rgba.shape[1] // wide
    sums = rgba[: h * high, : w * wide].reshape(h, high, w, wide, 4).sum((1, 3), dtype=np.int64)
    return ((2 * sums + high * wide) // (2 * high * wide)).astype(np.uint8)


def frame_rgba(header: Header, payload: bytes, sample: int = 1) -> np.ndarray:
    """The raster of a frame's bytes."""
    n, (cw, ch) = header.width * header.height, header.chroma
    data = np.frombuffer(payload, np.uint8)
    y = data[:n].reshape(header.height, header.width)
    u, v = (data[n + k * cw * ch : n + (k + 1) * cw * ch].reshape(ch, cw) for k in (0, 1)) if cw else (None, None)
    return sampled(to_rgba(y, u, v, header.full), sample)


# ---- files -------------------------------------------------------------------------------------------------------------


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Path and size of the .y4m files of a folder or glob, or of one file, by name."""
    fs, inside = _file_system(path)
    if any(c in inside for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(inside.rpartition("/")[0], allow_not_found=True)) if fnmatch.fnmatchcase(f.path, inside)]
    elif (info := fs.get_file_info(inside)).type == pafs.FileType.Directory:
        found = [f for f in fs.get_file_info(pafs.FileSelector(inside)) if f.extension == "y4m"]
    else:
        found = [info]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def read_header(fs: pafs.FileSystem, path: str) -> Header | None:
    with fs.open_input_file(path) as f:
        return parse_header(f.read(MOST_HEADER), path)


class FrameRange(InputPartition):
    """Frames first..last-1 (from 0) of a file."""

    def __init__(self, path: str, header: Header, first: int, last: int):
        self.path, self.header, self.first, self.last = path, header, first, last


def _ranges(path: str, header: Header, first: int, last: int, partition_bytes: int) -> list[FrameRange]:
    step = max(1, partition_bytes // header.stride)
    return [FrameRange(path, header, a, min(a + step, last)) for a in range(first, last, step)]


def _video(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".y4m")


def _read(uri: str, part: FrameRange, sample: int) -> Iterator[pa.RecordBatch]:
    fs, _ = _file_system(uri)
    header, video = part.header, _video(part.path)
    at_once = max(1, BATCH_BYTES // (4 * header.width * header.height))
    with fs.open_input_file(part.path) as f:
        f.seek(header.size + part.first * header.stride)
        for a in range(part.first, part.last, at_once):
            rows = []
            for k in range(a, min(a + at_once, part.last)):
                data = f.read(header.stride)
                if not data.startswith(FRAME) or len(data) < header.stride:
                    raise ValueError(f"{part.path} has no frame {k + 1} where it should be")
                raster = frame_rgba(header, data[len(FRAME) :], sample)
                rows.append((video, k + 1, k / header.fps, raster.shape[1], raster.shape[0], raster.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Y4mReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sample, self.bytes = options["path"], int(options.get("sample", 1)), int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[FrameRange]:
        fs, _ = _file_system(self.path)
        found = [(p, read_header(fs, p), size) for p, size in list_files(self.path)]
        each = max(self.bytes, sum(size for _, _, size in found) // MOST_PARTITIONS)
        return [r for p, header, size in found if header for r in _ranges(p, header, 0, header.frames(size), each)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.sample) if partition is not None else iter(())


class Y4mStream(DataSourceStreamReader):
    """Offsets: whole frames by file."""

    def __init__(self, options: dict):
        self.path, self.sample, self.bytes = options["path"], int(options.get("sample", 1)), int(options.get("partitionbytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = _file_system(self.path)
        found = [(p, read_header(fs, p), size) for p, size in list_files(self.path)]
        return {p: header.frames(size) for p, header, size in found if header}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        fs, _ = _file_system(self.path)
        new = [(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]
        return [r for p, a, n in new for r in _ranges(p, read_header(fs, p), a, n, self.bytes)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.sample)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class Y4mWriter(DataSourceArrowWriter):
    """A file a video, under another name until the job is committed; rows of a video come together, in order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.fps = options["path"], float(options.get("fps", 30))
        self.layout, self.full = options.get("layout", "420"), options.get("full", "true").lower() == "true"
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out, now, header = None, None, None
        try:
            for batch in iterator:
                for video, w, h, rgba in zip(*(batch.column(c).to_pylist() for c in ("video_id", "width", "height", "rgba")), strict=True):
                    if out is None or video != now:
                        if out is not None:
                            out.close()
                        now, header = video, Header(w, h, self.fps, self.layout, self.full, 0)
                        files.append((f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{video}.y4m"))
                        out = fs.open_output_stream(files[-1][0])
                        out.write(header.line())
                    if (w, h) != (header.width, header.height):
                        raise ValueError(f"video {video} has frames of several sizes")
                    raster = np.frombuffer(rgba, np.uint8) if rgba is not None and len(rgba) >= 4 * w * h else np.zeros(4 * w * h, np.uint8)  # a damaged frame is black
                    out.write(FRAME + b"".join(p.tobytes() for p in to_planes(raster[: 4 * w * h].reshape(h, w, 4), self.layout, self.full)))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, folder = _file_system(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        if len({target for _, target in made}) < len(made):
            self.abort(messages)
            raise ValueError("rows of a video were not together")
        if self.overwrite:
            for path, _ in list_files(self.path):
                fs.delete_file(path)
        for temporary, target in made:
            fs.move(temporary, target)

    def abort(self, messages: list) -> None:
        fs, _ = _file_system(self.path)
        for temporary, _ in itertools.chain.from_iterable(m.files for m in messages if m is not None):
            fs.delete_file(temporary)


class Y4m(DataSource):
    """Format y4m. Options: path; sample (1); partitionBytes; for writing also fps (30), layout (420, 422, 444, mono), full
    (true: samples of the full range)."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self):
        return FRAMES

    def reader(self, schema) -> Y4mReader:
        return Y4mReader(self.options)

    def streamReader(self, schema) -> Y4mStream:
        return Y4mStream(self.options)

    def writer(self, schema, overwrite: bool) -> Y4mWriter:
        return Y4mWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Y4m)


def read_y4m(spark: SparkSession, path: str, sample: int = 1, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Frames of a file, folder or glob."""
    register(spark)
    return spark.read.format("y4m").option("sample", sample).option("partitionBytes", partition_bytes).load(path)


def stream_y4m(spark: SparkSession, path: str, sample: int = 1, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Frames as files grow and appear."""
    register(spark)
    return spark.readStream.format("y4m").option("path", path).option("sample", sample).option("partitionBytes", partition_bytes).load()


def write_y4m(frames: DataFrame, path: str, fps: float = 30.0, layout: str = "420", full: bool = True) -> None:
    """One file a video, its frames in order of frame number."""
    register(frames.sparkSession)
    rows = frames.selectExpr("cast(video_id as string) as video_id", "cast(frame_idx as int) as frame_idx", "cast(ts as double) as ts", "width", "height", "rgba")
    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    ordered.write.format("y4m").option("fps", fps).option("layout", layout).option("full", str(full).lower()).mode("overwrite").save(path)
