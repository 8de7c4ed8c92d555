"""Names of operators, for lookup by text and for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from photowarden.functions import color, scalar
from photowarden.operators import explore, flash, frame_metrics, quantiles, risk, spectral, temporal
from photowarden.plans import analysis
from photowarden.sources import frames, importers, sinks

METRICS: dict[str, Callable] = {
    f"{module.__name__.split('.')[-1]}.{name}": f
    for module in (color, scalar, explore, flash, frame_metrics, quantiles, risk, spectral, temporal, analysis, frames, importers, sinks)
    for name, f in vars(module).items()
    if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__
}


def register_sql(spark: SparkSession) -> list[str]:
    """SQL functions luminance, red_area and to_fixed2, defined by expressions (no Python at run time)."""
    made = {
        "luminance(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": color.luminance(F.col("r"), F.col("g"), F.col("b")),
        "psi_band(score DOUBLE) RETURNS STRING": scalar.psi_band(F.col("score")),
        "risk_number(level STRING) RETURNS DOUBLE": scalar.risk_number(F.col("level")),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {_text(spark, body, head)}")
    return [h.split("(")[0] for h in made]


def _text(spark: SparkSession, body, head: str) -> str:
    names = [p.split() for p in head[head.index("(") + 1 : head.index(")")].split(", ")]
    frame = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in names))
    return frame.select(body.alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql().replace("`", "")
