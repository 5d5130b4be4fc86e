"""Series made ready for a forecast: one value a period on their own calendar, ends cut, holes filled, refusals said.

All series are prepared together by joins and windows by series; what reaches
the model is a dense run of bounded length whatever the number of rows was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.operators.frequency import frequencies

# Periods in a season, and the words for a period, by frequency; most periods, and fewest with data.
SEASON = {"h": 24, "D": 7, "B": 5, "W": 52, "MS": 12, "ME": 12, "QS": 4, "QE": 4, "YS": 1, "YE": 1}
UNIT = {"h": "hour", "D": "day", "B": "business day", "W": "week", "MS": "month", "ME": "month", "QS": "quarter", "QE": "quarter", "YS": "year", "YE": "year"}
MOST_PERIODS, LEAST_PERIODS = 20_000, 8
#: How values of one period become one.
MERGES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "last": None}


def _by(frequency: str, choices: dict[str, F.Column], other: F.Column) -> F.Column:
    out = None
    for names, column in choices.items():
        hit = F.col(frequency).isin(*names.split())
        out = F.when(hit, column) if out is None else out.when(hit, column)
    return out.otherwise(other)


def _index(t: str, frequency: str, anchor: str) -> F.Column:
    """The number of a time's period: hours, days, weeks (ending on weekday ``anchor``), months, quarters or years."""
    days = F.datediff(F.to_date(t), F.lit("1970-01-05").cast("date"))  # a Monday
    months = 12 * (F.year(t) - 1970) + F.month(t) - 1
    week = F.floor((days + 6 - F.col(anchor)) / 7)
    return _by(frequency, {"h": F.floor(F.unix_timestamp(t) / 3600), "D B": days, "W": week, "MS ME": months, "QS QE": F.floor(months / 3), "YS YE": F.year(t) - 1970}, F.lit(None)).cast("long")


def _label(i: str, frequency: str, anchor: str) -> F.Column:
    """The time that stands for a period: its first, or for weeks and frequencies of ends its last day."""
    day = lambda n: F.date_add(F.lit("1970-01-05").cast("date"), n.cast("int")).cast("timestamp")
    month = lambda n: F.add_months(F.lit("1970-01-01").cast("date"), n.cast("int"))
    x = F.col(i)
    ends = {"ME": F.last_day(month(x)), "QE": F.last_day(month(3 * x + 2)), "YE": F.last_day(month(12 * x + 11))}
    starts = {"MS": month(x), "QS": month(3 * x), "YS": month(12 * x)}
    return _by(frequency, {"h": F.timestamp_seconds(x * 3600), "D B": day(x), "W": day(7 * x + F.col(anchor)), **{k: v.cast("timestamp") for k, v in (starts | ends).items()}}, F.lit(None).cast("timestamp"))


def prepare(df: DataFrame, series: str, date: str, value: str, merge: str = "sum", frequency: str | None = None, least: int = LEAST_PERIODS) -> tuple[DataFrame, DataFrame]:
    """Series on their calendars, and what was done to each.

    The first table is (series, frequency, season, i, period, y, filled): a
    value for every period from the first to the last that has one, ``i`` from
    0, gaps filled by straight lines. The second is (series, frequency, season,
    status, reason, periods, observed, merged, gaps, cut, odd): ``status`` is ok
    or refused with a reason (no usable value, more than MOST_PERIODS periods,
    fewer than ``least`` with data); ``merged`` values shared a period with
    another and were put together by ``merge`` (sum, mean, last, max or min),
    ``gaps`` periods inside were filled, ``cut`` ones at the end had no data, and
    ``odd`` values were no numbers. Only series that are ok are in the first.

    ``frequency`` overrules what the dates say. Series without one count as
    evenly spaced observations in the order of time. Rows without a date take no
    part; a week ends on the weekday that all dates of its series share, else on
    Sunday.
    """
    if merge not in MERGES:
        raise ValueError(f"values are merged by one of {', '.join(MERGES)}")
    if frequency is not None and frequency not in SEASON:
        raise ValueError(f"{frequency} is no known frequency")
    at, x = F.col(f"`{date}`").cast("timestamp"), F.col(f"`{value}`").cast("double")
    usable = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    rows = df.where(at.isNotNull()).select(F.col(f"`{series}`").cast("string").alias("series"), at.alias("t"), usable.alias("y"), (x.isNotNull() & usable.isNull()).cast("int").alias("odd"))
    found = frequencies(rows, "series", "t").select("series", "frequency")
    if frequency:
        found = found.withColumn("frequency", F.lit(frequency))
    days = rows.groupBy("series").agg(F.min(F.weekday("t")).alias("w1"), F.max(F.weekday("t")).alias("w2"))
    known = _joined(found, days).withColumn("anchor", F.when(F.col("w1") == F.col("w2"), F.col("w1")).otherwise(6)).drop("w1", "w2")
    placed = _joined(rows, known)
    order = Window.partitionBy("series").orderBy("t")
    placed = placed.withColumn("at", F.coalesce(_index("t", "frequency", "anchor"), F.dense_rank().over(order).cast("long")))
    how = F.max_by("y", F.when(F.col("y").isNotNull(), F.col("t"))) if merge == "last" else MERGES[merge]("y")
    periods = placed.groupBy("series", "frequency", "anchor", "at").agg(how.alias("y"), F.count("y").alias("n"), F.sum("odd").alias("odd"), F.min("t").alias("t"))
    ends = periods.groupBy("series", "frequency", "anchor").agg(
        F.min(F.when(F.col("n") > 0, F.col("at"))).alias("a"), F.max(F.when(F.col("n") > 0, F.col("at"))).alias("b"), F.max("at").alias("z"), F.count_if(F.col("n") > 0).alias("observed"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("merged"), F.sum("odd").alias("odd")
    )
    size = F.col("b") - F.col("a") + 1
    refusal = F.when(F.col("observed") == 0, "the series has no usable value").when(size > MOST_PERIODS, f"more than {MOST_PERIODS} periods").when(F.col("observed") < least, F.concat(F.lit("fewer than "), F.lit(str(least)), F.lit(" periods with data")))
    judged = ends.withColumn("reason", refusal)
    spine = judged.where("reason is null").select("series", "frequency", "anchor", F.explode(F.expr("sequence(a, b)")).alias("at"))
    spine = spine.where("frequency is null or frequency <> 'B' or pmod(at, 7) < 5")
    dense = spine.join(periods.where("n > 0").select(F.col("series").alias("s2"), F.col("at").alias("at2"), "y", "t"), F.expr("series <=> s2 and at = at2"), "left")
    own = Window.partitionBy("series").orderBy("at")
    numbered = dense.withColumn("i", F.row_number().over(own) - 1)
    known_y, here = F.col("y").isNotNull(), F.struct("i", "y")
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    sided = numbered.withColumn("p", F.last(F.when(known_y, here), True).over(back)).withColumn("q", F.first(F.when(known_y, here), True).over(ahead))
    line = F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (F.col("i") - F.col("p.i")) / F.greatest(F.col("q.i") - F.col("p.i"), F.lit(1))
    season = _by("frequency", {k: F.lit(v) for k, v in SEASON.items()}, F.lit(1))
    ready = sided.select("series", "frequency", season.alias("season"), "i", F.coalesce(_label("at", "frequency", "anchor"), "t").alias("period"), F.coalesce("y", line).alias("y"), F.col("y").isNull().alias("filled"))
    gaps = ready.groupBy("series").agg(F.count("*").alias("periods"), F.count_if("filled").alias("gaps"))
    facts = _joined(judged, gaps).select(
        "series", "frequency", season.alias("season"), F.when(F.col("reason").isNull(), "ok").otherwise("refused").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("periods", F.lit(0)).alias("periods"), "observed", "merged", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce(F.col("z") - F.col("b"), F.lit(0)).alias("cut"), "odd",
    )
    return ready, facts


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join by ``series``, null equal to null."""
    other = right.withColumnRenamed("series", "series_2")
    return left.join(other, F.expr("series <=> series_2"), "left").drop("series_2")
