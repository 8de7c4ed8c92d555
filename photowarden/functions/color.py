"""Colour functions as Column expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights (BT.709), sRGB to XYZ (D65) rows, reference white.
LUMA = (0.2126, 0.7152, 0.0722)
XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)
# Saturated red and red area.
RED = {
    "linear_red": 0.85, "linear_green": 0.15, "linear_blue": 0.15, "a": 30.0, "chroma": 35.0, "area": 0.25, "dominance": 60.0,
    "intensity": 0.7, "least_area": 0.3, "weak_factor": 0.05, "weak_most": 0.1,
}


def _linear(v: Column) -> Column:
    v = v / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def srgb_to_linear(v: Column) -> Column:
    """0..255 to linear 0..1; between whole values the table of 256 is interpolated."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    low = F.floor(v)
    a, b = _linear(low.cast("double")), _linear(F.least(low + 1, F.lit(255)).cast("double"))
    return a + (v - low) * (b - a)


def luminance(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = LUMA) -> Column:
    return weights[0] * srgb_to_linear(r) + weights[1] * srgb_to_linear(g) + weights[2] * srgb_to_linear(b)


def luminance255(r: Column, g: Column, b: Column) -> Column:
    return luminance(r, g, b) * 255.0


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct<L, a, b>."""
    rgb = [srgb_to_linear(c) for c in (r, g, b)]

    def f(row, white):
        t = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        return F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * (6 / 29) ** 2) + 16 / 116)

    x, y, z = (f(row, w) for row, w in zip(XYZ, WHITE, strict=True))
    return F.struct((116 * y - 16).alias("L"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def cie76(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in ("a", "b")), (p["L"] - q["L"]) * (p["L"] - q["L"])))


def is_saturated_red(lab: Column, linear: tuple[Column, Column, Column] | None = None) -> Column:
    chroma = F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"])
    gate = (lab["a"] > RED["a"]) & (chroma > RED["chroma"])
    if linear is not None:
        gate &= (linear[0] > RED["linear_red"]) & (linear[1] < RED["linear_green"]) & (linear[2] < RED["linear_blue"])
    return gate


def red_area_fraction(r: Column, g: Column, b: Column, lab: Column, known: Column | None = None) -> Column:
    """How red a mean colour counts as, 0..1; a known fraction is only clamped."""
    share = r / 255.0
    red = is_saturated_red(lab) & (r - F.greatest(g, b) > RED["dominance"]) & (share > RED["intensity"])
    strong = F.greatest(F.lit(RED["least_area"]), F.least(share, F.lit(1.0)))
    own = clamp(F.when(red, strong).otherwise(F.least(share * RED["weak_factor"], F.lit(RED["weak_most"]))))
    return own if known is None else F.when(known.isNotNull(), clamp(known)).otherwise(own)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
