"""Helpers shared by the training-data operators: shipping code, shared storage, batch sizes, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photowarden.runtime import shared_folder, ship

#: Rows of an Arrow batch that Python works on at once; Spark bounds a batch by bytes.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, once per context. No setting of the session is touched."""
    ship(spark)


def slices(batches, rows: int = BATCH_ROWS):
    """Arrow batches in pieces of at most so many rows; what the last ones took is given back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes to the shared folder on its way, by name; it deletes its own when all that was
    made of them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As the function written(), under a name that isn't in use."""
        path = new_table(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Delete every table but these."""
        for name in [n for n in self.paths if n not in names]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(col, n: int):
    """A bucket 0..n-1 of a column by hash."""
    return F.pmod(F.xxhash64(col), F.lit(n))


# ---- hashing of words in numpy ---------------------------------------------------------------------------------

_U = np.uint64
#: Words are hashed as polynomials modulo this prime: a power of two as modulus has collisions for every base.
PRIME = (1 << 61) - 1
_BASE = (0x1B97F4A7C159E37B, 0x0AE3D27D4EB4F2B2)
#: Space, tab, newline, vertical tab, form feed and carriage return part words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple] = {}
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo the prime."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of integers below it, from 31-bit halves."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(reduced((a1 * b1 << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31))) + reduced(a0 * b0))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _power_tables(seed: int, n: int):
    """Powers of the base and of its inverse modulo the prime."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        have = []
        for base in (_BASE[seed], pow(_BASE[seed], -1, PRIME)):
            table = np.ones(size, _U)
            k = 1
            while k < size:
                table[k : 2 * k] = times(table[:k], np.full(k, pow(base, k, PRIME), _U))
                k *= 2
            have.append(table)
        have = _powers[seed] = tuple(have)
    return have


def _sums(values: np.ndarray, powers: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times powers, as sums of low and high halves; small: the values are below 2^20."""
    low, high = np.zeros(len(values) + 1, _U), np.zeros(len(values) + 1, _U)
    if small:
        np.cumsum(values * (powers & _LOW31), out=low[1:])
        np.cumsum(values * (powers >> _U(31)), out=high[1:])
    else:
        product = times(values, powers)
        np.cumsum(product & _LOW31, out=low[1:])
        np.cumsum(product >> _U(31), out=high[1:])
    return low, high


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    high = reduced(high)
    return reduced(reduced(low) + (high >> _U(30)) + ((high & _LOW30) << _U(31)))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span of at most 4 MiB of bytes; equal spans have equal hashes anywhere."""
    p, q = _power_tables(seed, len(buf) + 1)
    low, high = _sums(buf.astype(_U) + _U(1), p[: len(buf)], True)
    return mix(times(_joined(low[ends] - low[starts], high[ends] - high[starts]), q[starts]) ^ ((ends - starts).astype(_U) << _U(48)))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `size` words, given the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    step = 1 << 16
    p, q = _power_tables(1 - seed, step + size)
    out = np.empty(n, _U)
    for a in range(0, n, step):
        part = reduced(words[a : a + step + size - 1])
        low, high = _sums(part, p[: len(part)], False)
        k = len(part) - size + 1
        out[a : a + k] = times(_joined(low[size:] - low[:k], high[size:] - high[:k]), q[:k])
    return mix(out)


def word_hashes(texts: list[bytes], seeds: tuple[int, ...] = (0, 1), lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Per seed the hashes of all words of the texts, one after the other, and each text's number of words."""
    counts = np.zeros(len(texts), np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in seeds]
    at, step = 0, 1 << 18
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < step):
            total += len(texts[end]) + 1
            end += 1
        buf = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        if lower:
            buf = lowered(buf)
        starts, ends = word_bounds(buf)
        limits = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts[at:end] = np.diff(np.searchsorted(starts, limits), prepend=0)
        lo = 0
        while lo < len(starts):  # a long text is hashed slice by slice
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * step, side="right")))
            base = starts[lo]
            for k, seed in enumerate(seeds):
                parts[k].append(span_hashes(buf[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base, seed))
            lo = hi
        at = end
    return [np.concatenate(p) if p else np.zeros(0, _U) for p in parts], counts


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes unchanged."""
    return _LOWER[buf]
