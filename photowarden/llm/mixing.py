"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token weights are summed over the cells of source, language and topic. Raking scales the cells to each margin's target
shares in turn, `rounds` rounds at a time, until what is left (the tokens that a margin's values have too many or too few, over
all tokens, for the worst margin) is at most RESIDUAL, or until such rounds no longer bring it down, as where sparse cells
can't meet their targets; a cell's factor is its raked weight over its own. A document's sampling
probability is its cell's factor over the greatest factor, so expected tokens have the raked shares and no probability
exceeds one; a document stays when the number that its id hashes to, between zero and one, is below it. The cell with the
greatest factor, however small, so sets how much of all others stays.

With a `total`, the raked weights are scaled to so many tokens instead, whatever the greatest factor is: a document's
expected copies are its cell's factor times that scale, of which it gets the whole ones and by its draw one for the rest.

The cells are one row a combination that occurs; they are put in one partition (sorted, so they may spill) and all
margins are window sums there, so that raking has no shuffle. Cells are written after each run of rounds; the driver sees one
number of them. Documents are joined to cells by a broadcast only while
there are at most `BROADCAST_CELLS` of them, and else by a join on cell and salt.

Defined results: a null source, language or topic is a value of its own (empty string); null text has no tokens; a cell
without tokens has factor zero, so its documents go; a margin value without a target keeps its own share of the rest;
repeated rows share their id's fate; a null id hashes as the empty string; an empty table gives no rows; extra columns
are carried along unless they are named tokens, topic, probability, draw, residual or, with a total, copy, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photowarden.llm import common

ROUNDS = 12
#: Share of the tokens that may be in the wrong value of a margin.
RESIDUAL = 1e-4
BROADCAST_CELLS = 20_000
SALTS = 16


def count_tokens(text: str = "text") -> Column:
    """Words: runs of characters other than space, tab, newline, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_topic(text: str = "text") -> Column:
    """A coarse topic from the whole text: data (a digit in 50 characters), lists (a line in 120), else prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    length = F.length(t)
    digits = length - F.length(F.translate(t, "0123456789", ""))
    lines = length - F.length(F.translate(t, "\n", ""))
    return F.when(digits * 50 >= F.greatest(length, F.lit(1)), "data").when(lines * 120 >= F.greatest(length, F.lit(1)), "lists").otherwise("prose")


def draw(id_column: str = "doc_id") -> Column:
    """A number in [0, 1) from an id: the first 32 bits of the MD5 of its decimal digits."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def damped(margin: str, power: float) -> Column:
    """The target of a margin value: its own weight to a power; shares follow (1: as it is, 0: all values alike)."""
    own = F.sum("w0").over(Window.partitionBy(margin))
    return F.when(own > 0, F.pow(own, F.lit(power))).otherwise(0.0)


def _aimed(cells: DataFrame, targets: dict[str, float | DataFrame]) -> DataFrame:
    """Cells in one partition with raked (as yet their weight) and each margin's target weight."""
    one = cells.coalesce(1)
    margins = list(targets)
    for m in margins:
        t = targets[m]
        if isinstance(t, DataFrame):
            own = F.sum("w0").over(Window.partitionBy(m))
            one = one.join(F.broadcast(t.select(m, F.col("target").cast("double").alias(f"_t_{m}"))), m, "left").withColumn(f"_t_{m}", F.coalesce(f"_t_{m}", own))
        else:
            one = one.withColumn(f"_t_{m}", damped(m, t))
    total = F.sum("w0").over(Window.partitionBy(F.lit(1)))
    for m in margins:  # target shares of the margin, as weights; a margin value's target is spread over its cells once
        first = F.row_number().over(Window.partitionBy(m).orderBy(*margins)) == 1
        one = one.withColumn("_f", F.when(first, F.col(f"_t_{m}")).otherwise(0.0))
        one = one.withColumn(f"_t_{m}", F.coalesce(F.try_divide(F.col(f"_t_{m}"), F.sum("_f").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)) * total)
    return one.withColumn("raked", F.col("w0")).drop("_f")


def _rounds(aimed: DataFrame, margins: list[str], rounds: int) -> DataFrame:
    one = aimed.coalesce(1)
    for _ in range(rounds):
        for m in margins:
            have = F.sum("raked").over(Window.partitionBy(m))
            one = one.withColumn("raked", F.when(have > 0, F.try_divide(F.col("raked") * F.col(f"_t_{m}"), have)).otherwise(0.0))
    return one


def residual(aimed: DataFrame, margins: list[str]) -> float:
    """The share of all tokens that is in the wrong value of a margin, for the worst margin; 0 without tokens."""
    off = None
    for m in margins:
        values = aimed.groupBy(m).agg(F.sum("raked").alias("have"), F.first(f"_t_{m}").alias("want"), F.sum("w0").alias("w0"))
        one = values.agg(F.try_divide(F.sum(F.abs(F.col("have") - F.col("want"))) / 2, F.sum("w0")).alias("off"))
        off = one if off is None else off.unionByName(one)
    return off.agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, float | DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Adds raked to cells (one row a combination; weight w0), after so many rounds.

    targets: by margin either a power (see damped) or a table of the margin's values and their `target` weights.
    """
    margins = list(targets)
    return _rounds(_aimed(cells, targets), margins, rounds).drop(*(f"_t_{m}" for m in margins))


def rake_until(cells: DataFrame, targets: dict[str, float | DataFrame], rounds: int = ROUNDS, most: float = RESIDUAL) -> tuple[DataFrame, float]:
    """As rake, going on by so many rounds until the residual is at most `most` or falls by less than a hundredth; the
    cells, written, and their residual."""
    margins = list(targets)
    done = common.written(_rounds(_aimed(cells, targets), margins, rounds), "cells")
    left = residual(done, margins)
    while left > most:
        done = common.written(_rounds(done, margins, rounds), "cells")
        before, left = left, residual(done, margins)
        if left > 0.99 * before:
            break
    return done.drop(*(f"_t_{m}" for m in margins)), left


def mix_to_targets(docs: DataFrame, targets: dict[str, float | DataFrame], id_column: str = "doc_id", rounds: int = ROUNDS, total: float | None = None, most: float = RESIDUAL) -> DataFrame:
    """docs: with tokens and the margins' columns. Adds probability, draw and the residual of the raking, and keeps the
    sampled documents.

    total: the expected tokens of the result. probability is then the expected number of copies, which may exceed one,
    and copy counts a document's copies from 0.
    """
    margins = list(targets)
    cell_names = [f"__pw_m{k}" for k in range(len(margins))]
    rows = docs.withColumns({c: F.coalesce(F.col(m).cast("string"), F.lit("")) for c, m in zip(cell_names, margins, strict=True)})
    summed = rows.groupBy(*cell_names).agg(F.sum("tokens").cast("double").alias("w0"))
    named = {c: targets[m] if not isinstance(targets[m], DataFrame) else targets[m].withColumnRenamed(m, c) for c, m in zip(cell_names, margins, strict=True)}
    raked, left = rake_until(summed, named, rounds, most)
    factor = F.when(F.col("w0") > 0, F.try_divide("raked", "w0")).otherwise(0.0)
    cells = raked.withColumn("__pw_factor", factor)
    every = Window.partitionBy(F.lit(1))
    scaled = F.try_divide(F.col("__pw_factor"), F.max("__pw_factor").over(every)) if total is None else F.try_divide(F.col("__pw_factor") * float(total), F.sum("raked").over(every))
    cells = cells.withColumn("__pw_p", scaled).select(*cell_names, F.coalesce("__pw_p", F.lit(0.0)).alias("__pw_p"))
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(cells), cell_names)
    else:
        salted = cells.withColumn("__pw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__pw_salt", common.spread(id_column, SALTS).cast("int")).join(salted, [*cell_names, "__pw_salt"]).drop("__pw_salt")
    sampled = joined.withColumns({"probability": F.col("__pw_p"), "draw": draw(id_column), "residual": F.lit(left)})
    if total is None:
        sampled = sampled.filter(F.col("draw") < F.col("probability"))
    else:
        whole = F.floor("probability")
        copies = whole + (F.col("draw") < F.col("probability") - whole).cast("long")
        sampled = sampled.withColumn("__pw_n", copies).filter("__pw_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pw_n") - 1))).drop("__pw_n")
    return sampled.drop("__pw_p", *cell_names)
