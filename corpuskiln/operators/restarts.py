"""Sums that start again each time they pass a bound, without walking through the rows in one task.

A group begins, takes rows in order until their sum reaches the bound, and the next one
begins. Where a group that begins at a row would end is known from the running totals
alone, for any row. Which of these beginnings happen is found by jump pointers: the axis
of totals is cut into cells of one bound, so that every pointer leaves its cell. Level
by level two neighbouring regions become one, pointers that end in the second half are composed, and only rows at
which a group can enter a region from outside stay, half as many each time. Then
the beginnings are spread from the largest regions down to single cells. Rounds grow
with the logarithm of the number of groups; all tables together have some twice as many narrow rows as the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskiln.scratch import write_scratch


def _pointers(spans: DataFrame, bound: int, by: list[str]) -> DataFrame:
    """(by, start, next): where a group that begins at each row that is not empty ends; NULL where the rows end first."""
    cell = F.lit(bound).cast("bigint")
    filled = spans.filter("size > 0").select(*by, F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    # a row is listed in every cell it reaches into; the wanted sum lies in exactly one row
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))
    holders = filled.select(*by, F.explode(cells).alias("_cell"), F.col("start").alias("_value"), F.lit(1).alias("_kind"), "start", "end")
    wanted = F.col("start") + cell
    asks = filled.select(
        *by, F.floor(wanted / cell).alias("_cell"), wanted.alias("_value"), F.lit(0).alias("_kind"), "start", F.lit(None).cast("bigint").alias("end")
    )
    # a row that begins at the wanted sum comes after the question
    line = Window.partitionBy(*by, "_cell").orderBy("_value", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    answered = holders.unionByName(asks).withColumn("next", F.max("end").over(line)).filter("_kind = 0")
    return answered.select(*by, "start", F.when(F.col("next") >= F.col("_value"), F.col("next")).alias("next"))


def _region(at: Column, bound: int, level: int) -> Column:
    return F.floor(at / F.lit(bound << level).cast("bigint"))


def _levels(spans: DataFrame, bound: int, by: list[str]) -> list[DataFrame]:
    """Pointers (by, start, source, next) of each level: ``next`` is the first beginning behind the region of ``start``.

    ``source`` is the earliest row whose group ends at ``start``; a row without one is never a beginning, except the first.
    """
    pointers = write_scratch(_pointers(spans, bound, by), "pointers")
    sources = pointers.filter("next IS NOT NULL").groupBy(*by, F.col("next").alias("start")).agg(F.min("start").alias("source"))
    entered = pointers.join(sources, [*by, "start"], "left").filter("source IS NOT NULL OR start = 0")
    levels = [write_scratch(entered, "jumps")]
    last = pointers.agg(F.max(_region(F.col("start"), bound, 0))).first()[0] or 0
    for level in range(1, last.bit_length()):
        below, here = levels[-1], _region(F.col("start"), bound, level)
        kept = below.filter((F.col("start") == 0) | (_region(F.col("source"), bound, level) < here))
        further = below.select(*by, F.col("start").alias("next"), F.col("next").alias("_further"))
        inside = _region(F.col("next"), bound, level) == here
        levels.append(
            write_scratch(
                kept.join(further, [*by, "next"], "left").select(
                    *by, "start", "source", F.when(inside, F.col("_further")).otherwise(F.col("next")).alias("next")
                ),
                "jumps",
            )
        )
    return levels


def restarts(spans: DataFrame, bound: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, end) of every group: it holds the rows with start <= at < end; ``end`` of the last one is NULL.

    ``spans`` is a stored table of (by, at, size) with ``at``, the sum of the sizes of all earlier rows of the same ``by``.
    Empty rows at a border belong to the later group. Columns of ``by`` must not be null.
    """
    by = list(by)
    levels = _levels(spans, bound, by)
    starts = write_scratch(spans.groupBy(*by).agg(F.min("at").alias("start")).filter("start IS NOT NULL"), "starts")
    for level in reversed(range(len(levels))):
        reached = starts.join(levels[level], [*by, "start"])
        inside = _region(F.col("next"), bound, level + 1) == _region(F.col("start"), bound, level + 1)
        starts = write_scratch(starts.unionByName(reached.filter(inside).select(*by, F.col("next").alias("start"))), "starts")
    pointers = levels[0].select(*by, "start", F.col("next").alias("end"))
    groups = write_scratch(starts.join(pointers, [*by, "start"], "left"), "groups")
    # empty rows behind the last full group form one of their own
    rest = groups.filter("end IS NOT NULL").select(*by, F.col("end").alias("start"))
    rest = rest.join(groups.select(*by, "start"), [*by, "start"], "left_anti")
    return groups.unionByName(rest.withColumn("end", F.lit(None).cast("bigint")))


def in_groups(spans: DataFrame, groups: DataFrame, bound: int, by: Sequence[str] = (), out: str = "group") -> DataFrame:
    """``spans`` with the start of each row's group, joined by the cells that a group reaches into."""
    by, last = list(by), spans.groupBy(*by).agg(F.max("at").alias("_last")) if by else spans.agg(F.max("at").alias("_last"))
    # without ``by`` this is one row, whose value is a constant of the plan
    ended = groups.join(last, by) if by else groups.withColumn("_last", F.lit(last.first()["_last"]).cast("bigint"))
    cells = F.sequence(_region(F.col("start"), bound, 0), _region(F.greatest("start", F.coalesce(F.col("end") - 1, F.col("_last"))), bound, 0))
    listed = ended.select(*by, F.explode(cells).alias("_cell"), F.col("start").alias(out), F.col("end").alias("_end"))
    found = spans.withColumn("_cell", _region(F.col("at"), bound, 0)).join(listed, [*by, "_cell"])
    return found.filter((F.col("at") >= F.col(out)) & (F.col("_end").isNull() | (F.col("at") < F.col("_end")))).drop("_cell", "_end")
