"""Spectra of brightness windows: numpy FFT inside Arrow batches, and the same as array expressions for one window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photowarden.functions.scalar import clean_unit
from photowarden.operators.windows import last_rows
from photowarden.runtime import ship

SIZE, LEAST, LOW, HIGH = 64, 64, 3.0, 50.0


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))


def fft(signal: np.ndarray) -> np.ndarray:
    """Transform of a power-of-two length between 2 and 4096 of finite values."""
    n = len(signal)
    if n < 2 or n > 4096 or n & (n - 1):
        raise ValueError("the length must be a power of two from 2 to 4096")
    if not np.isfinite(signal).all():
        raise ValueError("the signal must be finite")
    return np.fft.fft(signal)


def padded_fft(signal: np.ndarray) -> np.ndarray:
    """fft after zero padding to the next power of two."""
    n = max(2, 1 << (len(signal) - 1).bit_length())
    return fft(np.concatenate((signal, np.zeros(n - len(signal)))))


def flatness(amplitude: np.ndarray, low: int | None = None, high: int | None = None) -> float:
    """Geometric over arithmetic mean of power, bins low to high inclusive."""
    if not len(amplitude):
        return 0.0
    a = 0 if low is None else min(max(int(np.floor(low)), 0), len(amplitude) - 1)
    b = len(amplitude) - 1 if high is None else min(max(int(np.floor(high)), a), len(amplitude) - 1)
    p = amplitude[a : b + 1] ** 2
    eps = max(1e-20, 1e-12 * float(p.max()))
    mean = p.mean()
    return float(np.exp(np.log(p + eps).mean()) / mean) if mean else 0.0


def spectra_of(values: np.ndarray, fs: float = 60.0) -> dict[str, np.ndarray]:
    """Windowed spectra of equally long signals (a row each): amplitude and phase by bin, dominant bin in 3..50 Hz,
    flatness of that band, confidence in dB. Lengths that are no power of two are padded with zeros."""
    rows, n = values.shape
    h = hann(n)
    m = max(2, 1 << (n - 1).bit_length())
    if m > 4096 or not np.isfinite(values).all():
        raise ValueError("signals must be finite and of at most 4096 values")
    half = np.fft.rfft((values - np.median(values, axis=1, keepdims=True)) * h, m)[:, : m // 2]
    amplitude = np.abs(half) * (2 / h.sum() if h.sum() > 0 else 0.0)
    amplitude[:, 0] /= 2
    low, high = max(1, int(np.floor(LOW * m / fs))), min(m // 2 - 1, int(np.ceil(HIGH * m / fs)))
    power = amplitude[:, low : high + 1] ** 2
    if not power.shape[1]:
        k, flat, confidence = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    else:
        k = np.where(power.max(1) > 0, low + power.argmax(1), 0)
        eps = np.maximum(1e-20, 1e-12 * power.max(1, keepdims=True))
        mean = power.mean(1)
        flat = np.divide(np.exp(np.log(power + eps).mean(1)), mean, out=np.zeros(rows), where=mean > 0)
        sums = np.concatenate((np.zeros((rows, 1)), np.cumsum(power, axis=1)), axis=1)
        first, last, at = np.clip(k - 4 - low, 0, None), np.clip(k + 5 - low, 0, power.shape[1]), np.clip(k - low, 0, None)
        every = np.arange(rows)
        top, near = power[every, at], last - first - 1
        noise = np.divide(sums[every, last] - sums[every, first] - top, near, out=np.zeros(rows), where=near > 0)
        confidence = np.where((k > 0) & (near > 0), 10 * np.log10(np.maximum(top, 1e-300) / np.maximum(noise, 1e-12)), 0.0)
    return {
        "bin": k, "dominant_frequency": k * fs / m, "amplitude": amplitude, "phase": np.angle(half), "flatness": flat, "confidence": confidence,
        "bin_resolution": np.full(rows, fs / m), "window_size": np.full(rows, n),
    }


def spectrum(values: np.ndarray, fs: float = 60.0) -> dict:
    """spectra_of one signal."""
    return {c: v[0] for c, v in spectra_of(values[None], fs).items()}


_TYPE = "dominant_frequency double, dominant_inst_freq double, spectral_flatness double, confidence double, bin_resolution double, window_size int, amplitude array<double>, phase array<double>"


def spectrum_of(values: Column, fs: float = 60.0, size: int = SIZE) -> Column:
    """Struct of the spectrum of the last `size` values of an array of up to size + 1; empty until there are enough.

    The instantaneous frequency of a bin is its centre plus what its phase moved beyond the expected advance since the
    window one value earlier; both windows are in the array, so no state is kept. A batch is transformed at once.
    """
    names = [c.split(" ")[0] for c in _TYPE.split(", ")]
    ship()

    @F.arrow_udf(_TYPE)
    def run(arrays: pa.Array) -> pa.Array:
        sizes = np.diff(arrays.offsets.to_numpy())
        flat, ends = arrays.flatten().to_numpy(), np.cumsum(sizes)
        full = np.flatnonzero(np.minimum(sizes, size) >= LEAST)
        window = ends[full][:, None] - size + np.arange(size)
        now = spectra_of(flat[window], fs) if len(full) else None
        out = {c: np.zeros(len(sizes)) for c in names[:5]}
        if now is not None:
            k, every = now["bin"], np.arange(len(full))
            longer = np.flatnonzero((sizes[full] > size) & (k > 0))
            move = np.zeros(len(full))
            if len(longer):
                before = spectra_of(flat[window[longer] - 1], fs)
                moved = now["phase"][longer, k[longer]] - before["phase"][np.arange(len(longer)), k[longer]] - 2 * np.pi * k[longer] / size
                move[longer] = ((moved + np.pi) % (2 * np.pi) - np.pi) * fs / (2 * np.pi)
            for c, v in zip(names[:5], (now["dominant_frequency"], k * fs / size + move, now["flatness"], now["confidence"], now["bin_resolution"]), strict=True):
                out[c][full[every]] = v
        held = np.zeros(len(sizes), np.int64)
        held[full] = size // 2
        offsets = pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(now[c].ravel() if now is not None else np.zeros(0))) for c in ("amplitude", "phase")]
        return pa.StructArray.from_arrays([*(pa.array(out[c]) for c in names[:5]), pa.array(np.minimum(sizes, size), pa.int32()), *lists], names)

    return run(values)


def spectra(signal: DataFrame, fs: float = 60.0, size: int = SIZE) -> DataFrame:
    """Adds the fields of spectrum_of over the last values of brightness at every frame."""
    window = F.collect_list(clean_unit(F.col("brightness"))).over(last_rows(size + 1))
    rows = signal.withColumn("_v", window).withColumn("_s", spectrum_of(F.col("_v"), fs, size))
    return rows.select(*(F.col(f"`{c}`") for c in signal.columns), "_s.*")


def vector_spectra(rows: DataFrame, values: Column, key: str, fs: float = 60.0) -> DataFrame:
    """Spectrum of one array a row: key, dominant_frequency, spectral_flatness, confidence."""
    ship()
    only = rows.select(key, values.alias("v"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            out = np.zeros((3, len(sizes)))
            for n in np.unique(sizes[sizes > 0]).tolist():
                some = np.flatnonzero(sizes == n)
                found = spectra_of(flat[(ends - sizes)[some][:, None] + np.arange(n)], fs)
                out[:, some] = [found[c] for c in ("dominant_frequency", "flatness", "confidence")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], [key, "dominant_frequency", "spectral_flatness", "confidence"])

    return only.mapInArrow(run, f"{key} {only.dtypes[0][1]}, dominant_frequency double, spectral_flatness double, confidence double")
