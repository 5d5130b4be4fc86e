"""Forecast baselines on period series, as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def naive_forecasts(series: DataFrame, horizon: int, season: int) -> DataFrame:
    """(h, naive, seasonal, drift) for h = 1..horizon of one series (period, y).

    Naive repeats the last value, seasonal the value one season before, drift
    carries on the mean step. The series is a calendar, so a global window is small.
    """
    w = Window.orderBy("period")
    marked = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    ends = marked.agg(F.max_by("y", "i").alias("last"), F.min_by("y", "i").alias("first"), F.max("n").alias("n")).where("n >= 2")
    steps = ends.select("last", "first", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    source = F.col("n") - season + 1 + (F.col("h") - 1) % season
    same = steps.join(marked.select(F.col("i").alias("at"), F.col("y").alias("seasonal")), F.col("at") == source, "left")
    return same.select("h", F.col("last").alias("naive"), F.coalesce("seasonal", "last").alias("seasonal"), (F.col("last") + F.col("h") * (F.col("last") - F.col("first")) / (F.col("n") - 1)).alias("drift"))


def seasonal_mase(series: DataFrame, season: int, holdout: int) -> DataFrame:
    """(mae, scale, mase) of the seasonal naive forecast of the last ``holdout`` periods."""
    w = Window.orderBy("period")
    marked = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("back", F.lag("y", season).over(w)).withColumn("step", F.abs(F.col("y") - F.lag("y", 1).over(w)))
    late = F.col("i") > F.col("n") - holdout
    made = marked.agg(F.avg(F.when(late, F.abs(F.col("y") - F.col("back")))).alias("mae"), F.avg(F.when(~late, F.col("step"))).alias("scale"))
    return made.withColumn("mase", F.try_divide("mae", "scale"))
