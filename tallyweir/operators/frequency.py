"""How often series have a value, the last two equal windows, and the change between them.

The gaps of all series come from one window by series and are counted by
length; a series' frequency is read off those few numbers and off what all its
dates have in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.operators.periods import bin_of

#: Periods in one window of a change, by frequency.
WINDOW = {"D": 7, "W": 4, "MS": 1, "YS": 1}
DAY = 86_400


def frequencies(df: DataFrame, series: str, date: str) -> DataFrame:
    """(series, n, gap, frequency) of every series: its different times, the median gap in days, and what they repeat by.

    Even spacing is named exactly: ``h``, ``D``, ``B`` (weekdays, over
    weekends), ``W``, ``MS`` and ``ME`` (first and last days of months), ``QS``,
    ``QE``, ``YS``, ``YE``. Series with holes go by their median gap: under 0.2
    days ``h``, up to 1.5 ``D``, 5 to 9 ``W``, 26 to 33 ``MS``, 85 to 95 ``QS``.
    Other series, and those of one time, have none. Nulls are left out; repeated
    times count once.
    """
    key, at = F.col(f"`{series}`"), F.col(f"`{date}`").cast("timestamp")
    times = df.where(at.isNotNull()).select(key.alias("series"), at.alias("t")).distinct()
    last = F.lag("t").over(Window.partitionBy("series").orderBy("t"))
    day, month = F.to_date("t"), 12 * F.year("t") + F.month("t")
    before = F.to_date("p")
    each = times.withColumn("p", last).select(
        "series",
        (F.unix_timestamp("t") - F.unix_timestamp("p")).alias("gap"),
        (month - (12 * F.year("p") + F.month("p"))).alias("months"),
        (F.col("t") == F.date_trunc("day", "t")).alias("whole"),
        (F.dayofmonth(day) == 1).alias("starts"),
        (day == F.last_day(day)).alias("ends"),
        F.month("t").alias("month"),
        (F.weekday(day) < 5).alias("working"),
        (F.col("p").isNull() | (F.datediff(day, before) == F.when(F.weekday(before) == 4, 3).otherwise(1))).alias("next_working"),
    )
    # one row for each length of gap
    lengths = each.groupBy("series", "gap").agg(F.count("*").alias("c"), *[F.min(x).alias(f"{x}_lo") for x in ("months", "whole", "starts", "ends", "working", "next_working")], F.max("months").alias("months_hi"), F.min("month").alias("m_lo"), F.max("month").alias("m_hi"))
    order = Window.partitionBy("series").orderBy("gap")
    held = lengths.withColumn("upto", F.sum(F.when(F.col("gap").isNotNull(), F.col("c")).otherwise(0)).over(order)).withColumn("gaps", F.sum(F.when(F.col("gap").isNotNull(), F.col("c")).otherwise(0)).over(Window.partitionBy("series")))
    low, high = (F.col("gaps") - 1) / 2, F.col("gaps") / 2
    made = held.groupBy("series").agg(
        F.sum("c").alias("n"),
        # the middle gap, or the mean of the two in the middle
        ((F.min(F.when(F.col("upto") > F.floor(low), F.col("gap"))) + F.min(F.when(F.col("upto") > F.floor(high), F.col("gap")))) / 2 / DAY).alias("gap"),
        F.min("gap").alias("least"),
        F.max("gap").alias("most"),
        F.min("months_lo").alias("m1"),
        F.max("months_hi").alias("m2"),
        F.min("m_lo").alias("from_month"),
        F.max("m_hi").alias("to_month"),
        *[F.min(f"{x}_lo").alias(x) for x in ("whole", "starts", "ends", "working", "next_working")],
    )
    same = F.col("least") == F.col("most")
    step = F.when(F.col("m1") == F.col("m2"), F.col("m1"))
    exact = (
        F.when(F.col("n") < 3, None)
        .when(same & (F.col("least") == 3600), "h")
        .when(same & (F.col("least") == DAY), "D")
        .when(F.col("working") & F.col("next_working") & F.col("whole"), "B")
        .when(same & (F.col("least") == 7 * DAY), "W")
        .when(F.col("whole") & F.col("starts") & (step == 12) & (F.col("from_month") == F.col("to_month")), "YS")
        .when(F.col("whole") & F.col("ends") & (step == 12) & (F.col("from_month") == F.col("to_month")), "YE")
        .when(F.col("whole") & F.col("starts") & (step == 3), "QS")
        .when(F.col("whole") & F.col("ends") & (step == 3), "QE")
        .when(F.col("whole") & F.col("starts") & (step == 1), "MS")
        .when(F.col("whole") & F.col("ends") & (step == 1), "ME")
    )
    rough = F.when(F.col("gap") < 0.2, "h").when(F.col("gap") <= 1.5, "D").when(F.col("gap").between(5, 9), "W").when(F.col("gap").between(26, 33), "MS").when(F.col("gap").between(85, 95), "QS")
    return made.select("series", "n", "gap", F.coalesce(exact, F.when(F.col("n") >= 2, rough)).alias("frequency"))


def last_windows(df: DataFrame, date: str, grain: str) -> DataFrame:
    """(p0, p1, c0, c1): the half-open days of the last two equal windows of whole periods; no row if data do not reach back that far.

    The period with the newest data is left out if they end early: more than 2
    days before the month does (where months have more than 4 different days on
    average), or before the week's Saturday.
    """
    w, at = WINDOW[grain], F.col(f"`{date}`")
    day = F.to_date(at)
    ends = df.where(at.isNotNull()).agg(F.min(bin_of(at, grain)).alias("a"), F.max(bin_of(at, grain)).alias("b"), F.max(day).alias("hi"), F.try_divide(F.count_distinct(day), F.count_distinct(F.trunc(day, "month"))).alias("per_month")).where("a is not null")
    back = {"D": lambda d, k: F.date_add(d, -k), "W": lambda d, k: F.date_add(d, -7 * k), "MS": lambda d, k: F.add_months(d, -k), "YS": lambda d, k: F.add_months(d, -12 * k)}[grain]
    # weeks carry their last day, so a window ends the day after its label; other periods end where the next begins
    end = F.date_add("b", 1) if grain == "W" else back(F.col("b"), -1)
    early = {"MS": (F.datediff(F.last_day("hi"), "hi") > 2) & (F.col("per_month") > 4), "W": F.weekday("hi") < 5}.get(grain, F.lit(False))
    start = F.date_add("a", -6) if grain == "W" else F.col("a")
    made = ends.select(start.alias("start"), F.when(early, back(end, 1)).otherwise(end).alias("c1"))
    return made.select("start", back(F.col("c1"), 2 * w).alias("p0"), back(F.col("c1"), w).alias("p1"), back(F.col("c1"), w).alias("c0"), "c1").where("p0 >= start").drop("start")


def last_change(df: DataFrame, date: str, metric: str, dimensions: list[str], grain: str = "MS", least: float = 0.03) -> DataFrame:
    """(dimension, label, before, after, delta, scale, unit, focus, lead): what moved the total between the last two windows.

    Months of unlike length are compared per day, or per reporting date where
    data are not daily, if that differs by 3 % or more: ``before`` is scaled and
    ``unit`` says so. ``focus`` is how much of the movement of its dimension the
    largest mover holds; ``lead`` marks the dimension where it is largest. A
    change under ``least`` of the total before gives no rows.
    """
    span = last_windows(df, date, grain)
    day = F.to_date(F.col(f"`{date}`"))
    kept = df.where(F.col(f"`{date}`").isNotNull() & F.col(f"`{metric}`").isNotNull())
    months = kept.agg((F.count_distinct(day) >= 20 * F.count_distinct(F.trunc(day, "month"))).alias("daily"))
    items = F.array(F.struct(F.lit("").alias("dimension"), F.lit("").alias("label")), *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("(blank)")).alias("label")) for d in dimensions])
    rows = kept.select(day.alias("day"), F.col(f"`{metric}`").cast("double").alias("v"), items.alias("items")).join(F.broadcast(span), F.lit(True)).where("day >= p0 and day < c1")
    sums = rows.select("*", F.explode("items").alias("s")).groupBy("s.dimension", "s.label").agg(
        F.coalesce(F.sum(F.when(F.col("day") < F.col("c0"), F.col("v"))), F.lit(0.0)).alias("old"),
        F.coalesce(F.sum(F.when(F.col("day") >= F.col("c0"), F.col("v"))), F.lit(0.0)).alias("after"),
        F.count_distinct(F.when(F.col("day") < F.col("c0"), F.col("day"))).alias("old_days"),
        F.count_distinct(F.when(F.col("day") >= F.col("c0"), F.col("day"))).alias("new_days"),
    )
    whole = sums.where("dimension = ''").join(F.broadcast(span), F.lit(True)).join(F.broadcast(months), F.lit(True))
    units = lambda a, b, seen: F.when(F.col("daily"), F.datediff(b, a)).otherwise(F.greatest(F.col(seen), F.lit(1)))
    scaled = whole.withColumn("s", units("c0", "c1", "new_days") / units("p0", "p1", "old_days")) if grain == "MS" else whole.withColumn("s", F.lit(1.0))
    uneven = F.abs(F.col("s") - 1) >= 0.03
    scale = scaled.select(F.when(uneven, F.col("s")).otherwise(1.0).alias("scale"), F.when(uneven, F.when(F.col("daily"), "day").otherwise("reporting date")).alias("unit"), "old", "after")
    enough = scale.where((F.col("old") != 0) & (F.abs(F.col("after") - F.col("old") * F.col("scale")) >= least * F.abs(F.col("old") * F.col("scale")))).select("scale", "unit")
    moved = sums.where("dimension <> ''").join(F.broadcast(enough), F.lit(True)).withColumn("before", F.col("old") * F.col("scale")).withColumn("delta", F.col("after") - F.col("before"))
    by = moved.groupBy("dimension").agg(F.try_divide(F.max(F.abs("delta")), F.sum(F.abs("delta"))).alias("focus"), F.count("*").alias("k")).withColumn("focus", F.when(F.col("k") >= 2, F.col("focus")))
    lead = by.agg(F.max_by("dimension", F.struct("focus", F.col("dimension"))).alias("best"))
    return moved.join(F.broadcast(by.drop("k")), "dimension").join(F.broadcast(lead), F.lit(True)).select("dimension", "label", "before", "after", "delta", "scale", "unit", "focus", (F.col("focus").isNotNull() & (F.col("dimension") == F.col("best"))).alias("lead"))
