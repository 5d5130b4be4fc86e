"""Time-series shaping: calendar spines, weekly bins, partial-period trimming, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STEP = {"D": "interval 1 day", "W": "interval 7 days", "MS": "interval 1 month", "YS": "interval 1 year"}


def bin_of(date: F.Column, grain: str) -> F.Column:
    """The period a date falls in; weeks end on Sunday and carry that day's date."""
    if grain == "W":
        return F.date_add(F.date_trunc("week", date).cast("date"), 6)
    return F.date_trunc({"D": "day", "MS": "month", "YS": "year"}[grain], date).cast("date")


def grain_of(df: DataFrame, date: str) -> str | None:
    """YS if over 730 days and all dates are 1 January, MS over 180 days, W over 45, else D."""
    first, last, yearly = df.agg(F.min(date), F.max(date), F.min((F.month(date) == 1) & (F.dayofmonth(date) == 1))).first()
    if first is None:
        return None
    span = (last - first).days
    return "YS" if span > 730 and yearly else "MS" if span > 180 else "W" if span > 45 else "D"


def period_series(df: DataFrame, date: str, metric: str, how: str = "sum", grain: str | None = None) -> DataFrame:
    """(period, y) on a full calendar: gaps are 0 for sums; for means the value before, else after, else 0."""
    grain = grain or grain_of(df, date)
    own = df.where(F.col(date).isNotNull()).groupBy(bin_of(F.col(date), grain or "D").alias("period"))
    made = own.agg((F.coalesce(F.sum(metric), F.lit(0.0)) if how == "sum" else F.avg(metric)).alias("v"))
    ends = made.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(_STEP[grain or "D"]))).alias("period"))
    joined = spine.join(made, "period", "left")
    if how == "sum":
        return joined.select("period", F.coalesce("v", F.lit(0.0)).alias("y"))
    # one row per period: the global window sees a calendar, never the input rows
    back = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("period").rowsBetween(0, Window.unboundedFollowing)
    return joined.select("period", F.coalesce(F.last("v", True).over(back), F.first("v", True).over(ahead), F.lit(0.0)).alias("y"))


def is_daily(df: DataFrame, date: str) -> DataFrame:
    """(days, months, daily): at least 20 different days per month on average."""
    made = df.agg(F.count_distinct(F.to_date(date)).alias("days"), F.count_distinct(F.date_trunc("month", date)).alias("months"))
    return made.withColumn("daily", F.coalesce(F.col("days") >= 20 * F.col("months"), F.lit(False)))


def trimmed(df: DataFrame, date: str, metric: str, how: str = "sum", grain: str = "MS") -> DataFrame:
    """The series without partial end periods, as long as more than 3 remain.

    Months: the first goes if data starts after the 3rd, the last if data ends
    more than 2 days before the month does; not for files with at most 4
    different days per month. Weeks: first if after Tuesday, last if before Saturday.
    """
    series = period_series(df, date, metric, how, grain)
    ends = df.agg(F.min(F.to_date(date)).alias("lo"), F.max(F.to_date(date)).alias("hi"), (F.count_distinct(F.to_date(date)) / F.count_distinct(F.date_trunc("month", date))).alias("per_month"))
    if grain == "MS":
        early, late = (F.dayofmonth("lo") > 3) & (F.col("per_month") > 4), (F.datediff(F.last_day("hi"), "hi") > 2) & (F.col("per_month") > 4)
    elif grain == "W":
        early, late = F.weekday("lo") > 1, F.weekday("hi") < 5
    else:
        return series
    w = Window.orderBy("period")
    marked = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy())).crossJoin(F.broadcast(ends))
    drop_first, drop_last = early & (F.col("n") > 3), late & (F.col("n") - F.when(early, 1).otherwise(0) > 3)
    return marked.where(~((F.col("i") == 1) & drop_first) & ~((F.col("i") == F.col("n")) & drop_last)).select("period", "y")


def month_rate(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(period, rate): monthly total per day of the month, times 30.4."""
    months = df.where(F.col(date).isNotNull()).groupBy(bin_of(F.col(date), "MS").alias("period")).agg(F.sum(metric).alias("t"), F.count_distinct(F.to_date(date)).alias("days"))
    typical = months.agg(F.median("days").alias("m"))
    return months.crossJoin(F.broadcast(typical)).select("period", (F.col("t") / F.when(F.col("m") <= 6, F.col("days")).otherwise(F.dayofmonth(F.last_day("period"))) * 30.4).alias("rate"))
