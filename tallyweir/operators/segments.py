"""Groups whose recent level moved on its own: a dense spine of periods, deviations of each group, and five gates.

One aggregation makes (dimension, label, period) sums for all dimensions and for
the table as a whole; whatever follows reads that small table. A group's series
is dense: a period without rows counts as 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators.periods import bin_of

#: Bins of segment shifts: days are looked at by week.
BINS = {"D": "W", "W": "W", "MS": "MS", "YS": "YS"}


def cube(df: DataFrame, date: str, metric: str, dimensions: list[str], grain: str) -> DataFrame:
    """(dimension, label, period, v, n, lo, hi): sums, rows and first and last day by group and period; dimension '' is the whole table."""
    items = F.array(F.struct(F.lit("").alias("dimension"), F.lit("").alias("label")), *[F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").cast("string").alias("label")) for d in dimensions])
    day = F.col(f"`{date}`")
    rows = df.where(day.isNotNull() & F.col(f"`{metric}`").isNotNull()).select(bin_of(day, grain).alias("period"), F.col(f"`{metric}`").cast("double").alias("v"), F.to_date(day).alias("day"), F.explode(items).alias("s"))
    return rows.where("s.label is not null").groupBy("s.dimension", "s.label", "period").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))


def _steps(later: F.Column, earlier: F.Column, grain: str) -> F.Column:
    """Periods from one period to a later one."""
    if grain == "W":
        return F.floor(F.datediff(later, earlier) / 7).cast("int")
    return F.round(F.months_between(later, earlier) / (12 if grain == "YS" else 1)).cast("int")


def segment_shifts(df: DataFrame, date: str, metric: str, dimensions: list[str], grain: str = "MS", recent: int = 3, before: int = 6) -> DataFrame:
    """(dimension, label, n, share, before, recent, change, overall, noise, found, rank) of every group.

    ``recent`` and ``before`` are means of the last periods and of those ahead
    of them, ``change`` and ``overall`` percent for the group and the table,
    ``noise`` what a shift must exceed: 2.5 standard errors by the group's own
    deviation in the periods before. ``found``: 25 % or more, 20 points off the
    table, over the noise, 5 % of the total and 15 rows. ``rank`` orders those
    found by their effect; ties by name. A month at either end that data cover in
    part only is left out, yes/no columns are no groups, and with fewer periods
    than ``recent + before``, or a table without a level before, there are no rows.
    """
    grain = BINS[grain]
    kinds = dict(df.dtypes)
    made = cube(df, date, metric, [d for d in dimensions if kinds[d] != "boolean"], grain)
    ends = made.where("dimension = ''").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("v").alias("total"))
    if grain == "MS":
        long = _steps(F.col("b"), F.col("a"), grain) >= 2
        first = F.when(long & (F.datediff("lo", "a") > 2), F.add_months("a", 1)).otherwise(F.col("a"))
        last = F.when(long & (F.datediff(F.last_day("b"), "hi") > 2), F.add_months("b", -1)).otherwise(F.col("b"))
    else:
        first, last = F.col("a"), F.col("b")
    span = ends.select(first.alias("first"), last.alias("last"), "total").where(_steps(F.col("last"), F.col("first"), grain) + 1 >= recent + before)
    # one row, from one row a period
    aged = made.join(F.broadcast(span), F.lit(True)).withColumn("age", _steps(F.col("last"), F.col("period"), grain))
    early = F.col("age").between(recent, recent + before - 1)
    sums = aged.groupBy("dimension", "label").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("v"), F.first("total")).alias("share"),
        F.first("total").alias("total"),
        (F.coalesce(F.sum(F.when(early, F.col("v"))), F.lit(0.0)) / before).alias("before"),
        (F.coalesce(F.sum(F.when(F.col("age").between(0, recent - 1), F.col("v"))), F.lit(0.0)) / recent).alias("recent"),
        F.sort_array(F.collect_list(F.when(early, F.col("v")))).alias("seen"),
    )
    # at most ``before`` numbers a group; periods not seen lie the whole mean away
    squares = F.aggregate("seen", F.lit(0.0), lambda a, v: a + (v - F.col("before")) * (v - F.col("before"))) + (before - F.size("seen")) * F.col("before") * F.col("before")
    noise = 2.5 * F.sqrt(squares / (before - 1)) * math.sqrt(1 / before + 1 / recent)
    change = F.when(F.col("before") > 0, (F.col("recent") - F.col("before")) / F.col("before") * 100)
    groups = sums.withColumn("change", change).withColumn("noise", noise)
    overall = groups.where("dimension = '' and change is not null").select(F.col("change").alias("overall"))
    judged = groups.where("dimension <> ''").join(F.broadcast(overall), F.lit(True))
    moved = F.abs(F.col("recent") - F.col("before"))
    good = (F.col("total") > 0) & (F.col("share") >= 0.05) & (F.col("n") >= 15) & (F.abs("change") >= 25) & (F.abs(F.col("change") - F.col("overall")) >= 20) & (moved >= F.col("noise"))
    marked = judged.withColumn("found", F.coalesce(good, F.lit(False))).withColumn("effect", moved * recent)
    best = F.expr("row_number() over (partition by found order by effect desc, dimension, label)")
    return marked.withColumn("rank", F.when(F.col("found"), best)).select("dimension", "label", "n", "share", "before", "recent", "change", "overall", "noise", "found", "rank")
