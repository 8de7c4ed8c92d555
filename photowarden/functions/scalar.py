"""Small scalar functions: rounding, formatting, labels, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def to_fixed(x: Column, places: int) -> Column:
    """A fixed number of decimals from the exact binary value, halves away from zero; missing is 0.

    format_number rounds halves to even. A double is such a half if it is an odd multiple of 2 ** -(places + 1), and only then;
    it is moved to a neighbour away from zero first.
    """
    value = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    half = F.abs(value * 2.0 ** (places + 1)) % 2.0 == 1.0
    return F.replace(F.format_number(F.when(half, value * (1 + 2.0**-51)).otherwise(value), places), F.lit(","), F.lit(""))


def clean_unit(x: Column) -> Column:
    """Values that are missing, NaN or outside 0..1 count as 0."""
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0), x).otherwise(0.0)


def magnitude(r: Column, g: Column, b: Column) -> Column:
    return F.sqrt(r * r + g * g + b * b)


def risk_number(level: Column) -> Column:
    return F.when(level == "high", 1.0).when(level == "medium", 0.5).otherwise(0.0)


def psi_band(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def format_time(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def progress_percent(at: Column, duration: Column) -> Column:
    return F.when(duration > 0, at / duration * 100).otherwise(0.0)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_\-.]", "_")


def base_file_name(name: Column, prefix: str = "analysis") -> Column:
    """Without extension, with unsafe characters replaced."""
    return F.concat(F.lit(prefix + "-"), safe_file_name(F.regexp_replace(name, r"\.[^/.]+$", "")))


def recommended_cluster_gap(interval: Column) -> Column:
    """3.5 intervals of analysis, within 0.05 and 2 seconds, to 2 places."""
    return half_up(F.greatest(F.lit(0.05), F.least(F.lit(2.0), 3.5 * interval)), 2)


def percent_argument(text: Column) -> Column:
    """A percentile argument in a column, as `params.percent` reads one: 0.95, 95, 95% and p95 are the same; null if it is none."""
    plain = F.lower(F.trim(text))
    marked = plain.startswith("p") | plain.endswith("%")
    number = F.when(plain.endswith("%"), F.substring(plain, F.lit(1), F.length(plain) - 1)).when(plain.startswith("p"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain).try_cast("double")
    scaled = F.when(~marked & number.between(0.0, 1.0), number * 100.0).otherwise(number)
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))


def label(key: Column) -> Column:
    """`label_of` on a column of dotted metric names."""
    spaced = F.regexp_replace(F.translate(key, "._", "  "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def color_number(key: Column, size: int = 16) -> Column:
    """`color_index` on a column of names without characters beyond the basic plane."""
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (F.when(h >= 1 << 31, F.lit(1 << 32) - h).otherwise(h) % size).cast("int")


def label_of(key: str) -> str:
    """Label of a dotted metric name: words in capitals, parts joined by a space."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", key.replace(".", " ").replace("_", " ")).split()
    return " ".join(w[:1].upper() + w[1:] for w in words)


def color_index(key: str, size: int = 16) -> int:
    """A palette entry from a metric's name: a 32-bit polynomial string hash."""
    h = 0
    for c in key:
        h = (ord(c) + 31 * h) & 0xFFFFFFFF
    return (h - (h >> 31 << 32)).__abs__() % size
