"""Order statistics: exact, interpolating quantiles and positions in the sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.params import percent


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quantile(x: Column, p: float | int | str) -> Column:
    """Aggregate: the quantile at index p/100*(n-1), linear between neighbours; non-finite values are dropped."""
    return F.percentile(finite(x.cast("double")), percent(p) / 100)


def _counted(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The different finite values of each group with n, how often they occur, upto, how many are as small, and size.

    Equal values are counted before anything is exchanged by group, and the running sum over a group's sorted values
    spills: no group is held in memory.
    """
    counts = rows.withColumn("x", finite(F.col(column).cast("double"))).filter("x is not null").groupBy(*by, "x").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    return counts.withColumns({"upto": F.sum("n").over(group.orderBy("x")), "size": F.sum("n").over(group)})


def _at(position: Column) -> Column:
    """Aggregate over _counted: the value at a position (from 0) of the sorted values."""
    return F.min(F.when(F.col("upto") > position, F.col("x")))


def statistics(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """size, distinct, min, max, median, p90 and p95 by group; groups without a finite value have size 0."""
    wanted = {"median": percent(50), "p90": percent("p90"), "p95": percent("95%")}
    place = {name: F.col("size").cast("double") * p / 100 - p / 100 for name, p in wanted.items()}
    sides = {f"_{name}_{k}": _at(f(x).cast("long")) for name, x in place.items() for k, f in (("lo", F.floor), ("hi", F.ceil))}
    found = _counted(rows, column, by).groupBy(*by).agg(F.max("size").alias("size"), F.count("*").alias("distinct_values"), F.min("x").alias("min"), F.max("x").alias("max"), *(c.alias(n) for n, c in sides.items()))
    part = {name: x - F.floor(x) for name, x in place.items()}
    found = found.withColumns({name: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * part[name] for name in wanted}).drop(*sides)
    every = rows.select(*by).distinct()
    keys = [every[c].eqNullSafe(found[c]) for c in by]
    joined = every.join(found, keys, "left").select(*(every[c] for c in by), *(found[c] for c in found.columns if c not in by))
    return joined.fillna(0, ["size", "distinct_values"])


def kth_smallest(rows: DataFrame, column: str, k: int, by: list[str]) -> DataFrame:
    """The k-th smallest value (from 0) of each group, by counts of equal values and a running sum over them."""
    return _counted(rows, column, by).filter((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)).select(*by, F.col("x").alias("kth"))


def first_sorted(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest values."""
    return rows.select(finite(F.col(column).cast("double")).alias("value")).filter("value is not null").orderBy("value").limit(n)


def latency_statistics(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, sum, mean, nearest-rank (sorted[floor(n*q)]) p50, p95 and p99, extremes and operations a second of values in ms."""
    rank = lambda q: _at(F.least(F.floor(F.col("size") * q), F.col("size") - 1))
    total = F.sum(F.col("x") * F.col("n"))
    mean = total / F.max("size")
    return _counted(rows, column, by).groupBy(*by).agg(
        F.max("size").alias("n"), total.alias("total"), mean.alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
        F.min("x").alias("min"), F.max("x").alias("max"), (1000 / mean).alias("per_second"),
    )


def by_category(rows: DataFrame, category: str, name: str, value: str) -> DataFrame:
    """Per category: count, mean, and the names of the least and greatest values (ties by name)."""
    key = F.struct(value, name)
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(key)[name].alias("fastest"), F.max(F.struct(F.col(value), F.col(name)))[name].alias("slowest"))
