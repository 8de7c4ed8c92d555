"""Explorer: flatten, project, slice, normalise, bounds, nearest point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photowarden.sources.store import materialized

NUMBERED = "_row"
#: Other names under which a flat column may be asked for.
ALIASES = {"edge_detection.edge_density": "edge_detection.density", "edge_detection.edge_count": "edge_detection.count", "edge_detection.temporal_edge_change": "edge_detection.change", "temporal_coherence.coherence_score": "temporal_coherence.score"}


def flatten_metrics(rows: DataFrame) -> DataFrame:
    """Nested rows as dotted double columns: booleans 0/1, arrays their size, text cast to numbers, aliases merged."""
    out: dict[str, Column] = {}

    def walk(kind: T.DataType, path: list[str]) -> None:
        column = F.col(".".join(f"`{p}`" for p in path))
        name = ".".join(path)
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, [*path, f.name])
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out[name] = F.coalesce(F.size(column), F.lit(0)).cast("double")
        elif isinstance(kind, T.BooleanType):
            out[name] = column.cast("int").cast("double")
        elif isinstance(kind, T.StringType):
            out[name] = column.try_cast("double")
        elif isinstance(kind, T.NumericType):
            out[name] = column.cast("double")

    for f in rows.schema.fields:
        walk(f.dataType, [f.name])
    for name, other in ALIASES.items():
        if other in out:
            out[name] = F.coalesce(out[name], out[other]) if name in out else out[other]
    return rows.select(*(c.alias(n) for n, c in out.items()))


def search_fields(df: DataFrame, text: str) -> list[str]:
    """Column names that contain the text, whatever the case; groups themselves are left out."""
    return [f.name for f in df.schema.fields if text.lower() in f.name.lower() and not isinstance(f.dataType, T.StructType)]


def numbered(rows: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds the row's number from 0 in the order, of its group or of all rows.

    Of all rows: they are sorted over all partitions and written, and each partition's rows begin where those before it
    end; only the partitions' counts meet in one place.
    """
    if by:
        return rows.withColumn(NUMBERED, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    placed = materialized(rows.orderBy(order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")  # fixed by that function: 31 bits of partition, 33 of row
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_start")))  # one row a partition
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(NUMBERED, (F.col("_start") + (F.col("_place").bitwiseAND((1 << 33) - 1))).cast("long")).drop("_part", "_place", "_start")


def zoom(rows: DataFrame, center: int, width: int = 40) -> DataFrame:
    """Numbered rows from center - width//2 to center + width//2, inclusive; width at least 5."""
    half = max(5, width) // 2
    return rows.filter(F.col(NUMBERED).between(max(0, center - half), center + half))


def selection(rows: DataFrame, start: int, low: int, high: int) -> DataFrame:
    """Numbered rows start+low to start+high, inclusive."""
    return rows.filter(F.col(NUMBERED).between(start + min(low, high), start + max(low, high)))


def chart_columns(rows: DataFrame, x: str, ys: list[str]) -> DataFrame:
    return rows.select(*dict.fromkeys([x, *ys]))


def normalise(rows: DataFrame, columns: list[str], by: list[str] | None = None, skip: tuple[str, ...] = ("is_flash", "duration")) -> DataFrame:
    """Min-max normalises columns over the visible rows: constant 0.5; all-zero and skipped columns stay.

    Extremes are one aggregate a group joined back, so no window gathers all rows in one task.
    """
    todo = [c for c in columns if c.split(".")[-1] not in skip]
    spans = rows.groupBy(*(by or [])).agg(*(f(F.col(f"`{c}`")).alias(f"_{n}_{k}") for k, c in enumerate(todo) for n, f in (("lo", F.min), ("hi", F.max))))
    joined = rows.join(spans, by) if by else rows.crossJoin(F.broadcast(spans))  # without groups the extremes are one row
    made = {}
    for k, c in enumerate(todo):
        lo, hi, x = F.col(f"_lo_{k}"), F.col(f"_hi_{k}"), F.col(f"`{c}`")
        made[c] = F.when((lo == 0) & (hi == 0), x.cast("double")).when(lo == hi, 0.5).otherwise((x - lo) / (hi - lo))
    return joined.withColumns(made).drop(*(f"_{n}_{k}" for k in range(len(todo)) for n in ("lo", "hi")))


def bounds(rows: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """min_x, max_x, min_y, max_y over all rows and all y columns; equal bounds are opened by one."""
    low = F.least(*(F.min(y) for y in ys)) if len(ys) > 1 else F.min(ys[0])
    high = F.greatest(*(F.max(y) for y in ys)) if len(ys) > 1 else F.max(ys[0])
    found = rows.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), low.alias("min_y"), high.alias("max_y"))
    opened = lambda a, b: F.when(F.col(a) == F.col(b), F.col(b) + 1).otherwise(F.col(b))
    return found.select("min_x", opened("min_x", "max_x").alias("max_x"), "min_y", opened("min_y", "max_y").alias("max_y"))


def nearest_point(points: DataFrame, x: float, y: float, within: float = 12.0) -> DataFrame:
    """The point nearest to a cursor, if it is nearer than `within`; ties by position."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return points.withColumn("distance", d).filter(F.col("distance") < within).agg(F.min(F.struct("distance", "x", "y")).alias("p")).filter("p is not null").select("p.x", "p.y", "p.distance")


def explore(rows: DataFrame, x: str, ys: list[str], center: int | None = None, width: int = 40, norm: bool = True, by: list[str] | None = None) -> DataFrame:
    """Projection, zoom and normalisation in one lazy plan."""
    seen = numbered(rows.select(*dict.fromkeys([*(by or []), x, *ys])), x, by)
    seen = seen if center is None else zoom(seen, center, width)
    return normalise(seen, ys, by).drop(NUMBERED) if norm else seen.drop(NUMBERED)
