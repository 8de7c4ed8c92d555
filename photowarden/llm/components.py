"""Connected components of a link table, without bringing links or labels to the driver.

Each round gives a node the least label among its neighbours and itself, then follows labels to their own labels. Every
round is written to the shared folder. A hub's links meet only as partial minima and in joins that Spark can split.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common


def connected_components(links: DataFrame, a: str, b: str, scratch: common.Scratch | None = None, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) of every node that has a link; null ends are ignored.

    Links and superseded rounds are deleted; with `scratch` the result's table is handed over to it under `name`.
    """
    own = common.Scratch(links.sparkSession)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = own.written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    labels = own.written(both.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.first("v")).alias("component")), "labels-0")
    for k in itertools.count(1):  # labels only fall, so it ends
        heard = both.join(labels.withColumnRenamed("component", "_c"), F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("_c").alias("_heard"))
        hooked = labels.join(heard, "node", "left").select("node", F.col("component").alias("_was"), F.least("component", "_heard").alias("_next"))
        ahead = labels.select(F.col("node").alias("_next"), F.col("component").alias("_beyond"))
        moved = own.written(hooked.join(ahead, "_next", "left").select("node", "_was", F.least("_next", "_beyond").alias("component")), f"labels-{k}")
        changed = moved.filter("_was <> component").limit(1).count()
        labels = moved.select("node", "component")
        own.keep("links", f"labels-{k}")
        if not changed:
            own.keep(f"labels-{k}")
            if scratch is not None:
                scratch.paths[name] = own.paths[f"labels-{k}"]
            return labels


def contracted_components(links: DataFrame, a: str, b: str, scratch: common.Scratch, name: str = "components") -> DataFrame:
    """node, component (some node of it, the same for all) of every node that has a link to another; null ends are ignored.

    Randomised contraction: each round every node goes over into the neighbour, or itself, of the least hash, and links
    between nodes that went over into the same one vanish. A constant share of the nodes vanishes a round however they
    are linked, so a long chain takes rounds as the logarithm of its length. The result's table is handed over to
    `scratch` under `name`; the rounds' tables are deleted.
    """
    own = common.Scratch(links.sparkSession)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = own.written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links-0")
    steps = []
    for k in itertools.count(1):
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("lot"), F.col(c).alias("node"))  # noqa: B023, E731
        least = edges.groupBy("u").agg(F.min(draw("v")).alias("n"))
        step = own.written(least.select(F.col("u").alias("node"), F.least("n", draw("u"))["node"].alias("next")), f"step-{k}")
        steps.append(step)
        half = edges.join(step, F.col("u") == F.col("node")).select(F.col("next").alias("u"), "v")
        whole = half.join(step, F.col("v") == F.col("node")).select("u", F.col("next").alias("v")).filter("u <> v").distinct()
        edges = own.written(whole, f"links-{k}")
        own.keep(f"links-{k}", *(f"step-{j}" for j in range(1, k + 1)))
        if edges.isEmpty():
            break
    found = steps[0].select("node", F.col("next").alias("component"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("component"), "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    found = scratch.written(found, name)
    own.keep()
    return found
