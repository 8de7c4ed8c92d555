"""Severity score, risk debt and the sticky risk level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.functions.color import clamp
from photowarden.functions.scalar import clean_unit
from photowarden.operators.windows import before, by_frame, so_far, within_seconds

# Weights of the severity score.
PSI_WEIGHTS = {"frequency": 0.3, "intensity": 0.25, "coverage": 0.2, "duration": 0.15, "brightness": 0.1}
# High and medium limits of each signal.
LIMITS = {
    "psi": (0.8, 0.65), "avg_intensity": (0.8, 0.6), "coverage": (0.25, 0.15), "red": (0.8, 0.5), "red_delta": (0.6, 0.4), "chroma": (0.8, 0.5), "pattern": (0.8, 0.5),
}
# Flashes allowed a second; flicker band and its peak; weighted score; debt.
FLASHES, FLICKER, PEAK = 3, (3.0, 30.0), 18.0
WEIGHTS, WEIGHTED = {"psi": 0.7, "color": 0.2, "pattern": 0.1}, (0.75, 0.5)
RED_DELTA_FACTOR, NEAR_FROM = 1.5, 0.8
DEBT_DECAY, DEBT_LIMITS = 0.95, (0.85, 0.60)
DEBT_WEIGHTS = {"spatial": 0.40, "psi": 0.25, "flashes": 0.25, "flicker": 0.10}
RANKS = ("low", "medium", "high")
#: Rows of a block of the debt's closed form: decay over a block is below the precision of a double.
DEBT_BLOCK = 4096


def with_psi(flagged: DataFrame, coverage: Column | None = None, weights: dict[str, float] | None = None, compat: bool = False) -> DataFrame:
    """Adds psi (score, components). Flashes before this frame count, over frames at 60 a second.

    Duration is the time that the last flash's frame lasted; compat: its time stamp.
    """
    w = PSI_WEIGHTS | (weights or {})
    flashes = F.coalesce(F.count_if("is_flash").over(before()), F.lit(0))
    n = F.row_number().over(by_frame())
    lasted = F.col("ts") if compat else F.coalesce(F.col("ts") - F.lag("ts").over(by_frame()), F.lit(0.0))
    rows = flagged.withColumn("_lasted", F.when(F.col("is_flash"), lasted))
    last = F.coalesce(F.last("_lasted", ignorenulls=True).over(before()), F.lit(0.0))
    parts = {
        "frequency": F.least(flashes / (n / 60.0) / 3.0, F.lit(1.0)), "intensity": F.least(clean_unit(F.col("intensity")) / 0.2, F.lit(1.0)),
        "coverage": clean_unit(coverage) if coverage is not None else F.lit(0.0), "duration": F.least(F.when(last >= 0, last).otherwise(0.0) / 50.0, F.lit(1.0)), "brightness": clean_unit(F.col("brightness")),
    }
    rows = rows.withColumns({f"_{k}": v for k, v in parts.items()})
    score = sum((F.col(f"_{k}") * w[k] for k in list(parts)[1:]), F.col("_frequency") * w["frequency"])
    made = F.struct(score.alias("score"), F.struct(*(F.col(f"_{k}").alias(k) for k in parts)).alias("components"))
    return rows.withColumn("psi", made).drop("_lasted", *(f"_{k}" for k in parts))


def psi_statistics(scores: DataFrame) -> DataFrame:
    """avg, max and min of the scores that are numbers other than zero, by video."""
    good = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != 0))
    return good.groupBy("video_id").agg(F.avg("score").alias("psi_avg"), F.max("score").alias("psi_max"), F.min("score").alias("psi_min"))


def near(x: Column, end: float) -> Column:
    return clamp((x - NEAR_FROM * end) / (end - NEAR_FROM * end))


def flicker_hazard(hz: Column) -> Column:
    low, high = FLICKER
    up, down = 1 - (PEAK - hz) / (PEAK - low), 1 - (hz - PEAK) / (high - PEAK)
    return F.when(hz.between(low, high), F.when(hz <= PEAK, clamp(up)).otherwise(clamp(down))).otherwise(0.0)


def with_flash_peaks(flagged: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Adds, as of each frame: flashes, mean flash intensity, most flashes in a rolling second and violations of it."""
    rows = flagged.withColumn("_n", F.when(F.col("is_flash"), within_seconds("count(*)", seconds, "is_flash")))
    rows = rows.withColumns({
        "flashes": F.count_if("is_flash").over(so_far()), "avg_intensity": F.coalesce(F.avg(F.when(F.col("is_flash") & F.col("intensity").between(0.0, 1.0), F.col("intensity"))).over(so_far()), F.lit(0.0)),
        "_peak": F.coalesce(F.max("_n").over(so_far()), F.lit(0)), "_over": F.count_if(F.col("_n") > FLASHES).over(so_far()),
    })
    several = F.col("flashes") > 1
    return rows.withColumns({"max_flashes": F.when(several, F.col("_peak")).otherwise(0), "sequence_violations": F.when(several, F.col("_over")).otherwise(0)}).drop("_n", "_peak", "_over")


def with_debt(rows: DataFrame, add: Column) -> DataFrame:
    """Adds risk_debt: d = 0.95 d + 0.05 add, as a sum of decayed terms by blocks of rows."""
    inside = Window.partitionBy("video_id", "_block").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(by_frame()) - 1
    rows = rows.withColumns({"_block": F.floor(n / DEBT_BLOCK), "_r": n % DEBT_BLOCK, "_add": clamp(add)})
    local = (1 - DEBT_DECAY) * F.pow(F.lit(DEBT_DECAY), F.col("_r")) * F.sum(F.col("_add") * F.pow(F.lit(DEBT_DECAY), -F.col("_r"))).over(inside)
    rows = rows.withColumn("_local", local)
    carried = F.coalesce(F.last(F.when(F.col("_r") == DEBT_BLOCK - 1, F.col("_local")), ignorenulls=True).over(before()), F.lit(0.0))
    return rows.withColumn("risk_debt", clamp(F.col("_local") + carried * F.pow(F.lit(DEBT_DECAY), F.col("_r") + 1))).drop("_block", "_r", "_add", "_local")


def risk_levels(rows: DataFrame) -> DataFrame:
    """Adds risk_debt, base_level and risk_level (never falls) from psi_score, coverage, red, chroma_rg, chroma_by,
    flicker_hz, pattern and what with_flash_peaks adds."""
    red_before = F.lag("red").over(by_frame())
    rows = rows.withColumns({"red_delta": F.coalesce(F.abs(F.col("red") - red_before), F.lit(0.0)), "_n": F.row_number().over(by_frame())})
    psi, cover = clamp(F.col("psi_score")), clamp(F.col("coverage"))
    chroma = F.greatest("chroma_rg", "chroma_by")
    flicker = F.col("flicker_hz").between(*FLICKER)
    spatial = F.greatest(near(clamp(F.col("avg_intensity")), LIMITS["avg_intensity"][0]), near(cover, LIMITS["coverage"][0]))
    add = DEBT_WEIGHTS["spatial"] * spatial + DEBT_WEIGHTS["psi"] * near(psi, LIMITS["psi"][0]) + DEBT_WEIGHTS["flashes"] * clamp((F.col("max_flashes") - 1) / 2) + DEBT_WEIGHTS["flicker"] * flicker_hazard(F.col("flicker_hz"))
    rows = with_debt(rows, add)
    values = {"psi": psi, "avg_intensity": clamp(F.col("avg_intensity")), "coverage": cover, "red": F.col("red"), "red_delta": F.col("red_delta"), "chroma": chroma, "pattern": clamp(F.col("pattern"))}

    def reaches(k: int) -> Column:
        hit = F.lit(False)
        for name, x in values.items():
            hit = hit | (x >= LIMITS[name][k])
        return hit | (flicker & ((values["avg_intensity"] >= LIMITS["avg_intensity"][k]) | (cover >= LIMITS["coverage"][k])))

    weighted = WEIGHTS["psi"] * psi + WEIGHTS["color"] * clamp(F.greatest(F.col("red_delta") * RED_DELTA_FACTOR, F.col("red"), chroma)) + WEIGHTS["pattern"] * values["pattern"]
    enough = (F.col("flashes") > 1) & (F.col("_n") > 1)
    base = F.when(~enough, 0).when(reaches(0) | (F.col("max_flashes") > FLASHES) | (F.col("sequence_violations") > 0), 2).when(reaches(1), 1).when(weighted >= WEIGHTED[0], 2).when(weighted >= WEIGHTED[1], 1).otherwise(0)
    rank = F.when(F.col("risk_debt") >= DEBT_LIMITS[0], 2).when(F.col("risk_debt") >= DEBT_LIMITS[1], F.greatest(base, F.lit(1))).otherwise(base)
    name = lambda x: F.element_at(F.array(*map(F.lit, RANKS)), x + 1)
    rows = rows.withColumn("_rank", rank)
    return rows.withColumns({"base_level": name(F.col("_rank")), "risk_level": name(F.max("_rank").over(so_far()))}).drop("_n", "_rank")


def _findings(counts: DataFrame, labels: tuple[str, str, str], none: str) -> Column:
    rate = F.col("flash_count") / (F.col("frame_count") / 60.0)
    found = F.array_compact(F.array(F.when(rate > 3, labels[0]), F.when(F.col("avg_intensity") > 0.5, labels[1]), F.when(F.col("flash_count") > 5, labels[2])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none)))


def risk_factors(counts: DataFrame) -> DataFrame:
    """Adds risk_factors to flash_counts."""
    return counts.withColumn("risk_factors", _findings(counts, ("High Flash Rate", "High Intensity", "Multiple Sequences"), "No significant risk factors"))


def recommendations(counts: DataFrame) -> DataFrame:
    """Adds recommendations to flash_counts."""
    labels = ("Warning: High flash rate detected", "Warning: High intensity flashes detected", "Multiple flash sequences detected")
    return counts.withColumn("recommendations", _findings(counts, labels, "No significant issues detected"))
