"""Per-frame metrics over pixels: one Arrow pass over the raster, numpy inside.

The kernels that are asked for are chosen when the plan is built, and the planes that several need are computed once for
all of them. Pixels are never exploded.

Frame difference and scene change compare a frame with the one before it. A task compares the frames that it reads one
after the other itself; only the first and the last raster of each run of consecutive frames leave it, and the window over
the narrow rows brings the last of one run to the first of the next. Frames in files in order cost two rasters a task;
frames in no order at all cost each raster once, as an exchange of them would.

A raster that is missing or shorter than width times height pixels is damaged: all its metrics are those of an empty
frame, the metric `damaged` tells it, and the frame after it has no like frame before it.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photowarden.functions.color import LUMA
from photowarden.runtime import ship

#: Bytes of rasters whose pixels are laid out at once.
PIXEL_BYTES = 1 << 20
_V = np.arange(256) / 255.0
LINEAR = np.where(_V > 0.04045, ((_V + 0.055) / 1.055) ** 2.4, _V / 12.92)
_WEIGHTED = [w * LINEAR for w in LUMA]


class Raster:
    """A frame's channels as (height, width) arrays, with planes that several kernels need computed once."""

    def __init__(self, width: int | None, height: int | None, rgba: bytes | None):
        width, height = max(width or 0, 0), max(height or 0, 0)
        self.damaged = rgba is None or len(rgba) < width * height * 4
        if self.damaged:
            width = height = 0
        self.bytes = np.frombuffer(rgba if rgba is not None else b"", np.uint8)[: width * height * 4]
        self._pixels = self.bytes.reshape(-1, 4)
        self._planes: list[np.ndarray | None] = [None] * 4
        self.width, self.height, self.size = width, height, width * height
        self._luma: np.ndarray | None = None
        self._opaque: bool | None = None
        self._bins: np.ndarray | None = None
        self._gradient: np.ndarray | None = None

    def _plane(self, k: int) -> np.ndarray:
        got = self._planes[k]
        if got is None:
            got = self._planes[k] = np.ascontiguousarray(self._pixels[:, k]).reshape(self.height, self.width)
        return got

    r = property(lambda self: self._plane(0))
    g = property(lambda self: self._plane(1))
    b = property(lambda self: self._plane(2))
    a = property(lambda self: self._plane(3))

    @property
    def opaque(self) -> bool:
        """No pixel is transparent: masks can be left out."""
        if self._opaque is None:
            self._opaque = bool(self.a.all())
        return self._opaque

    @property
    def luma(self) -> np.ndarray:
        if self._luma is None:
            self._luma = np.take(_WEIGHTED[0], self.r)
            self._luma += np.take(_WEIGHTED[1], self.g)
            self._luma += np.take(_WEIGHTED[2], self.b)
        return self._luma

    @property
    def bins(self) -> np.ndarray:
        """The luminance bin of each pixel, of 32."""
        if self._bins is None:
            self._bins = np.minimum((self.luma * 255).astype(np.uint8) >> 3, 31)
        return self._bins

    @property
    def gradient(self) -> np.ndarray:
        """Gradient magnitude of the luminance of 0..1."""
        if self._gradient is None:
            self._gradient = sobel(self.luma)
        return self._gradient

    def mean_luma(self) -> float:
        """By the plane if it is there, else by the counts of the channels' values."""
        if self._luma is not None:
            return float(self._luma.mean())
        planes = (self._pixels[:, k] if p is None else p.ravel() for k, p in enumerate(self._planes[:3]))
        return sum(float(np.bincount(c, minlength=256) @ w) for c, w in zip(planes, _WEIGHTED, strict=True)) / self.size


def sobel(gray: np.ndarray) -> np.ndarray:
    """Gradient magnitude; zero on the border."""
    out = np.zeros_like(gray)
    if gray.shape[0] < 3 or gray.shape[1] < 3:
        return out
    dx = gray[:, 2:] - gray[:, :-2]
    dy = gray[2:] - gray[:-2]
    gx = dx[:-2] + dx[2:]
    gx += 2 * dx[1:-1]
    gy = dy[:, :-2] + dy[:, 2:]
    gy += 2 * dy[:, 1:-1]
    gx *= gx
    gy *= gy
    gx += gy
    np.sqrt(gx, out=out[1:-1, 1:-1])
    return out


def brightness(f: Raster) -> float:
    return f.mean_luma() if f.size else 0.0


def coverage(f: Raster, threshold: float = 0.5) -> float:
    return float((f.luma > threshold).mean()) if f.luma.size else 0.0


def red_intensity(f: Raster) -> float:
    return int(np.add.reduce(f.r, axis=None, dtype=np.uint64)) / f.size / 255 if f.size else 0.0


def dominant(f: Raster) -> tuple[float, float, float]:
    """Mean colour of the pixels that aren't transparent."""
    if f.opaque and f.a.size:
        return tuple(int(np.add.reduce(c, axis=None, dtype=np.uint64)) / f.size for c in (f.r, f.g, f.b))
    seen = f.a != 0
    n = int(seen.sum())
    return tuple(float(c[seen].sum() / n) if n else 0.0 for c in (f.r, f.g, f.b))


def entropy(f: Raster) -> float:
    """Bits of the 256-bin luminance histogram, transparent pixels left out."""
    bins = np.minimum((f.luma * 255 + 0.5).astype(np.int64), 255)
    bins = bins.ravel() if f.opaque else bins[f.a != 0]
    if not bins.size:
        return 0.0
    p = np.bincount(bins) / bins.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def chromatic(f: Raster) -> tuple[float, float]:
    seen = f.a != 0
    n = int(seen.sum())
    if not n:
        return 0.0, 0.0
    r, g, b = ((c if f.opaque else c[seen]).astype(np.int16) for c in (f.r, f.g, f.b))
    by = (b << 1) - r - g
    r -= g
    np.abs(r, out=r)
    np.abs(by, out=by)
    return float(r.sum(dtype=np.int64) / np.sqrt(2) / n / 255), float(by.sum(dtype=np.int64) / 2 / np.sqrt(6) / n / 255)


def color_deviation(f: Raster, sample: int = 1024) -> tuple[float, float, float, float, float, float]:
    """Population deviation and mean of a systematic sample: every (pixels/1024)-th pixel."""
    stride = max(1, f.r.size // sample)
    channels = [c.ravel()[::stride].astype(np.float64) for c in (f.r, f.g, f.b)]
    if not channels[0].size:
        return (0.0,) * 6
    return (*(float(c.std() / 255) for c in channels), *(float(c.mean()) for c in channels))


def histogram(f: Raster) -> list[int]:
    """32 luminance bins of the pixels that aren't transparent."""
    return np.bincount(f.bins.ravel() if f.opaque else f.bins[f.a != 0], minlength=32).tolist()


@lru_cache(16)
def _regions(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The region of each pixel, 2 * quadrant + (1 in the centre disc), and the pixels of each region."""
    y, x = np.mgrid[:height, :width]
    radius = 0.2 * min(width, height)
    inner = (x - width / 2) ** 2 + (y - height / 2) ** 2 < radius * radius
    region = 2 * (np.where(x < width / 2, 0, 1) + np.where(y < height / 2, 0, 2)) + inner
    return region.ravel(), np.bincount(region.ravel(), minlength=8)


def spatial(f: Raster) -> tuple[float, float, float, float, float, float]:
    """Mean luminance of the centre disc, the periphery and the four quadrants."""
    region, n = _regions(f.width, f.height)
    total = np.bincount(region, f.luma.ravel(), minlength=8)
    parts = [(total[1::2].sum(), n[1::2].sum()), (total[::2].sum(), n[::2].sum()), *((total[2 * k : 2 * k + 2].sum(), n[2 * k : 2 * k + 2].sum()) for k in range(4))]
    return tuple(float(t / c) if c else 0.0 for t, c in parts)


def edges(f: Raster, threshold: float = 50.0) -> tuple[float, int]:
    count = int(np.count_nonzero(f.gradient > threshold / 255))
    valid = (f.width - 2) * (f.height - 2)
    return (count / valid if f.width > 2 and f.height > 2 else 0.0), count


def edge_map(f: Raster, threshold: float = 50.0) -> bytes:
    return ((f.gradient > threshold / 255) * np.uint8(255)).tobytes()


def block_deviations(plane: np.ndarray, block: int) -> np.ndarray:
    """Population deviation of each block of the plane; blocks at the right and lower border may be smaller."""
    rows, columns = np.arange(0, plane.shape[0], block), np.arange(0, plane.shape[1], block)
    sums = lambda x: np.add.reduceat(np.add.reduceat(x, rows, 0), columns, 1)
    high, wide = np.diff(np.append(rows, plane.shape[0])), np.diff(np.append(columns, plane.shape[1]))
    n = high[:, None] * wide
    mean = sums(plane) / n
    rest = plane - np.repeat(np.repeat(mean, high, 0), wide, 1)  # squares of what is left lose nothing
    rest *= rest
    return np.sqrt(sums(rest) / n)


def pattern(f: Raster, block: int = 8) -> float:
    """Mean block contrast and the periodicity of row sums of the edge plane, half each."""
    contrast = float(block_deviations(f.luma, block).mean() / 0.5) if f.size else 0.0
    rows = f.gradient.sum(1)
    d = rows - rows.mean() if f.size else rows
    best = max([0.0, *(float((d[:-lag] * d[lag:]).sum() / (f.height - lag)) for lag in range(2, min(20, f.height >> 1)))])
    total = np.abs(d).sum()
    periodic = min(best / (total / f.height + 1e-6), 1.0) if total > 1e-6 else 0.0
    return float(max(0.0, min(0.5 * contrast + 0.5 * periodic, 1.0)))


def palette(f: Raster, n: int = 5) -> list[dict]:
    """The n most frequent colours at 3 bits a channel; ties by value."""
    seen = f.a != 0
    key = (f.r[seen].astype(np.int64) >> 5 << 21) | (f.g[seen].astype(np.int64) >> 5 << 13) | (f.b[seen].astype(np.int64) >> 5 << 5)
    keys, counts = np.unique(key, return_counts=True)
    order = np.lexsort((keys, -counts))[:n]
    return [{"r": int(k >> 16 & 255), "g": int(k >> 8 & 255), "b": int(k & 255), "count": int(c)} for k, c in zip(keys[order], counts[order], strict=True)]


def lab_plane(f: Raster) -> np.ndarray:
    from photowarden.functions.color import WHITE, XYZ

    linear = np.stack([LINEAR.take(c.ravel()) for c in (f.r, f.g, f.b)])
    t = (np.array(XYZ) / np.array(WHITE)[:, None]) @ linear
    low = t <= (6 / 29) ** 3
    root = np.cbrt(t)
    if low.any():
        root[low] = t[low] / (3 * (6 / 29) ** 2) + 16 / 116
    return np.stack([116 * root[1] - 16, 500 * (root[0] - root[1]), 200 * (root[1] - root[2])])


def quantiles(x: np.ndarray, shares: tuple[float, ...]) -> list[float]:
    """Linear between neighbours, as np.quantile, from a partition."""
    at = [s * (len(x) - 1) for s in shares]
    sides = sorted({k for a in at for k in (int(a), min(int(a) + 1, len(x) - 1))})
    part = np.partition(x, sides)
    return [float(part[int(a)] + (part[min(int(a) + 1, len(x) - 1)] - part[int(a)]) * (a - int(a))) for a in at]


def contrast(labs: np.ndarray, threshold: float = 2.3, window: int = 50, decay: float = 0.1, sample: bool = False, weights: np.ndarray | None = None) -> dict:
    """Colour differences of consecutive Lab columns; weights: of the differences, instead of index decay."""
    half = lambda x, p: float(np.floor(x * 10**p + 0.5) / 10**p)
    if labs.shape[1] < 2:
        return dict.fromkeys(CONTRAST, 0.0) | {"significant_changes": 0, "total_samples": int(labs.shape[1]), "window_size": window, "weight_decay": decay}
    steps = labs[:, 1:] - labs[:, :-1]
    d = np.sqrt(np.einsum("ij,ij->j", steps, steps))
    mean, std = d.mean(), d.std(ddof=1 if sample and len(d) > 1 else 0)
    if weights is None:
        recent = d[-window:][::-1]
        weights = np.exp(-decay * np.arange(len(recent)))
        weighted = (recent * weights).sum() / weights.sum()
    else:
        weighted = (d * weights).sum() / weights.sum()
    hits = int((d >= threshold).sum())
    q = quantiles(d, (0.5, 0.9, 0.95))
    return {
        "sensitivity": half(min(100.0, mean / threshold * 100), 2), "fluctuations": half(std, 2), "average_delta_e": half(mean, 2), "max_delta_e": half(d.max(), 2),
        "significant_changes": hits, "total_samples": int(labs.shape[1]), "fluctuation_rate": half(hits / len(d) * 100, 2), "weighted_average_delta_e": half(weighted, 2),
        "window_size": window, "weight_decay": decay, "coefficient_of_variation": half(std / mean if mean else 0.0, 3),
        "median_delta_e": half(q[0], 2), "p90_delta_e": half(q[1], 2), "p95_delta_e": half(q[2], 2),
    }


CONTRAST = (
    "sensitivity", "fluctuations", "average_delta_e", "max_delta_e", "significant_changes", "total_samples", "fluctuation_rate", "weighted_average_delta_e",
    "window_size", "weight_decay", "coefficient_of_variation", "median_delta_e", "p90_delta_e", "p95_delta_e",
)
_CONTRAST_TYPE = "struct<" + ", ".join(f"{c}: {'bigint' if c in ('significant_changes', 'total_samples', 'window_size') else 'double'}" for c in CONTRAST) + ">"

#: Kernel name: function of a raster, Spark type, names of the parts where it returns several values.
KERNELS: dict[str, tuple[Callable, str, tuple[str, ...]]] = {
    "brightness": (brightness, "double", ()),
    "coverage": (coverage, "double", ()),
    "red_intensity": (red_intensity, "double", ()),
    "dominant_color": (dominant, "double", ("r", "g", "b")),
    "entropy": (entropy, "double", ()),
    "chromatic": (chromatic, "double", ("red_green", "blue_yellow")),
    "color_deviation": (color_deviation, "double", ("r", "g", "b", "mean_r", "mean_g", "mean_b")),
    "spatial": (spatial, "double", ("center", "periphery", "q0", "q1", "q2", "q3")),
    "edges": (edges, "double", ("density", "count")),
    "edge_map": (edge_map, "binary", ()),
    "pattern": (pattern, "double", ()),
    "histogram": (histogram, "array<bigint>", ()),
    "damaged": (lambda f: f.damaged, "boolean", ()),
    "palette": (palette, "array<struct<r: int, g: int, b: int, count: bigint>>", ()),
    "pixel_contrast": (lambda f: contrast(lab_plane(f)), _CONTRAST_TYPE, ()),
}


def kernel_type(name: str) -> str:
    _, kind, parts = KERNELS[name]
    return "struct<" + ", ".join(f"{p}: {kind}" for p in parts) + ">" if parts else kind


#: What compares a frame with the one before it, in the order of compare().
PAIRS = ("difference", "motion", "scene_change")
#: Videos of which a task keeps the last raster.
MOST_RUNS = 32
#: Rows of a frame within a run, of a run's last raster, and of a run's first frame with its raster.
_INNER, _LAST, _FIRST = 0, 1, 2


class Runs:
    """The last raster of each video in a task's order of rows."""

    def __init__(self, stride: int):
        self.stride = stride
        self.open: OrderedDict = OrderedDict()

    def follow(self, video, frame: int | None, raster: Raster) -> tuple[Raster | None, list[tuple]]:
        """The raster before, if this frame continues its video's run; and the last (video, frame, raster) of runs that
        end here. A run of one frame has no last raster: its first is it."""
        number, before, length = self.open.pop(video, (None, None, 0))
        goes_on = number is not None and frame is not None and frame == number + self.stride
        ended = [(video, number, before)] if before is not None and not goes_on and length > 1 else []
        self.open[video] = (frame, raster, length + 1 if goes_on else 1)
        if len(self.open) > MOST_RUNS:
            ended += self._ends(*self.open.popitem(last=False))
        return (before if goes_on else None), ended

    @staticmethod
    def _ends(video, run: tuple) -> list[tuple]:
        return [(video, run[0], run[1])] if run[2] > 1 else []

    def close(self) -> list[tuple]:
        return [x for video, run in self.open.items() for x in self._ends(video, run)]


def frame_metrics(frames: DataFrame, metrics: list[str], with_difference: bool = False, with_scene_change: bool = False, stride: int = 1) -> DataFrame:
    """video_id, frame_idx, ts and one column a metric of KERNELS; with_difference also difference and motion,
    with_scene_change also scene_change. One pass over the pixels.

    stride: what consecutive frame numbers differ by; where they differ by something else rasters go through the exchange.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship()
    kinds = {m: kernel_type(m) for m in metrics}
    plan = [(m, KERNELS[m][0], KERNELS[m][2]) for m in metrics]
    pairs = [*PAIRS[:2]] * with_difference + [PAIRS[2]] * with_scene_change
    rows = frames.select("video_id", "frame_idx", "ts", "width", "height", "rgba")
    own = ", ".join(f"{n} {k}" for n, k in rows.dtypes[:3]) + "".join(f", {m} {k}" for m, k in kinds.items())
    schema = own + ("".join(f", {p} double" for p in pairs) + ", _kind int, _width int, _height int, _raster binary" if pairs else "")
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    at = [PAIRS.index(p) for p in pairs]

    def run(batches):
        runs = Runs(stride)
        empty = [None] * (len(metrics) + len(pairs))
        border = lambda kind, f: [kind, f.width, f.height, f.bytes.tobytes()]

        def packed(found: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], arrow.names)

        for batch in batches:
            found = []
            for video, frame, ts, w, h, rgba in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raster = Raster(w, h, rgba)
                row = [video, frame, ts]
                for _, kernel, parts in plan:
                    value = kernel(raster)
                    row.append(dict(zip(parts, map(float, value), strict=True)) if parts else value)
                if pairs:
                    before, ended = runs.follow(video, frame, raster)
                    found += [[v, n, None, *empty, *border(_LAST, f)] for v, n, f in ended]
                    if before is None:
                        row += [*empty[len(metrics) :], *border(_FIRST, raster)]
                    else:
                        got = compare(raster, before, with_scene_change)
                        row += [*(got[k] for k in at), _INNER, None, None, None]
                found.append(row)
            if found:
                yield packed(found)
        if pairs and (ended := runs.close()):
            yield packed([[v, n, None, *empty, *border(_LAST, f)] for v, n, f in ended])

    made = rows.mapInArrow(run, schema)
    return _across_runs(made, pairs, with_scene_change) if pairs else made


def _across_runs(rows: DataFrame, pairs: list[str], scene: bool) -> DataFrame:
    """Compares the first frame of each run with the last of the run before it."""
    at = [PAIRS.index(p) for p in pairs]

    @F.arrow_udf("struct<" + ", ".join(f"{p}: double" for p in pairs) + ">")
    def met(kind: pa.Array, width: pa.Array, height: pa.Array, raster: pa.Array, width_before: pa.Array, height_before: pa.Array, before: pa.Array) -> pa.Array:
        found: list = [None] * len(kind)
        for k in np.flatnonzero(kind.to_numpy(zero_copy_only=False) == _FIRST).tolist():
            now = Raster(width[k].as_py(), height[k].as_py(), raster[k].as_py())
            then = before[k].as_py()
            got = compare(now, Raster(width_before[k].as_py(), height_before[k].as_py(), then) if then is not None else None, scene)
            found[k] = dict(zip(pairs, (got[j] for j in at), strict=True))
        return pa.array(found, pa.struct([(p, pa.float64()) for p in pairs]))

    w = Window.partitionBy("video_id").orderBy("frame_idx", "_kind")
    held = ("_width", "_height", "_raster")
    rows = rows.withColumns({f"{c}_before": F.lag(c).over(w) for c in held}).filter(F.col("_kind") != _LAST)
    rows = rows.withColumn("_met", met("_kind", *held, *(f"{c}_before" for c in held)))
    return rows.withColumns({p: F.coalesce(p, F.col(f"_met.{p}")) for p in pairs}).drop("_met", "_kind", *held, *(f"{c}_before" for c in held))


def compare(now: Raster, before: Raster | None, scene: bool = True) -> tuple[float, float, float]:
    """The values of PAIRS; a missing frame before, or one of another size, is black, and no change of scene."""
    like = before if before is not None and (before.width, before.height) == (now.width, now.height) else None
    return (*difference(now.bytes, like.bytes if like is not None else None), scene_score(now, like) if scene and like is not None else 0.0)


def difference(now: np.ndarray, before: np.ndarray | None, motion_share: float = 0.1) -> tuple[float, float]:
    """Mean channel difference, and share of pixels that moved by more than motion_share; no frame before is black."""
    if not now.size:
        return 0.0, 0.0
    px = now.reshape(-1, 4)
    if before is not None:
        other = before.reshape(-1, 4)
        px = np.maximum(px, other) - np.minimum(px, other)
    d = px[:, 0].astype(np.int16)
    d += px[:, 1]
    d += px[:, 2]
    return float(d.sum(dtype=np.int64) / (len(d) * 765)), float(np.count_nonzero(d > motion_share * 765) / len(d))


def scene_score(now: Raster, before: Raster) -> float:
    """Normalised difference of the 32-bin histograms; pixels that are transparent in both frames don't count, and only
    bins that differ do."""
    if now.opaque or before.opaque:
        a, b = (np.bincount(f.bins.ravel(), minlength=32) for f in (now, before))
    else:
        seen = (now.a != 0) | (before.a != 0)
        a, b = (np.bincount(f.bins[seen], minlength=32) for f in (now, before))
    differs = a != b
    below = (a + b)[differs].sum()
    return float(np.abs(a - b).sum() / below) if below else 0.0


def frame_difference(frames: DataFrame) -> DataFrame:
    """difference and motion against the previous frame of the video; a missing or unlike previous frame is black."""
    return frame_metrics(frames, [], with_difference=True)


def scene_change(frames: DataFrame) -> DataFrame:
    """scene_change against the previous frame of the video; 0 for a missing or unlike previous frame."""
    return frame_metrics(frames, [], with_scene_change=True)


def by_bytes(batch: pa.RecordBatch, most: int = PIXEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rasters (column 3) have about so many bytes; one at least in each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def pixels(frames: DataFrame) -> DataFrame:
    """The exploded form, one row a pixel: for tests and ad-hoc SQL, not for production."""
    ship()

    def run(batches):
        for batch in itertools.chain.from_iterable(map(by_bytes, batches)):
            rasters = [np.frombuffer(x or b"", np.uint8).reshape(-1, 4).astype(np.int32) for x in batch.column(3).to_pylist()]
            flat = np.concatenate(rasters) if rasters else np.zeros((0, 4), np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rasters]))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat[:, k]))) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["video_id", "frame_idx", "width", *"rgba"])

    rows = frames.select("video_id", "frame_idx", "width", "rgba")
    head = ", ".join(f"{n} {k}" for n, k in rows.dtypes[:3])
    lists = rows.mapInArrow(run, head + "".join(f", {c} array<int>" for c in "rgba"))
    every = lists.select("video_id", "frame_idx", "width", F.posexplode(F.arrays_zip(*"rgba")).alias("pos", "p"))
    return every.select("video_id", "frame_idx", "pos", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), "p.*")


def sampled_pixels(px: DataFrame, pixels_a_frame: int, sample: int = 1024) -> DataFrame:
    """A systematic sample: every (pixels/sample)-th pixel, all of a small frame."""
    return px.filter(F.col("pos") % max(1, pixels_a_frame // sample) == 0)


def valid_pixels(px: DataFrame) -> DataFrame:
    """Pixels whose channels are within 0..255."""
    return px.filter(F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255))


def require_rgb(px: DataFrame) -> DataFrame:
    """Fails the query on a channel that is missing or NaN."""
    ok = ~F.isnull("r") & ~F.isnull("g") & ~F.isnull("b") & ~F.isnan(F.col("r").cast("double")) & ~F.isnan(F.col("g").cast("double")) & ~F.isnan(F.col("b").cast("double"))
    return px.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("invalid RGB value")).cast("boolean")))
