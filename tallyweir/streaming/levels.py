"""Daily sums and their centred 29-day medians, kept up by a stream; anomalies as the batch query finds them.

Rows are told apart by their id within the watermark's delay, so a row that is
delivered twice counts once, and rows later than the delay are dropped. Tasks
add up their rows by day before the exchange. The state of a series is a bounded
run of daily sums: the days that a row may still change, and the 28 before them
that their medians reach back to. A late row changes the median of the days
around it; every day touched is written again, and the newest writing counts.

A micro-batch that is run again replaces its own output, and state and progress
lie in the folder given, so a query that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date as Date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweir.operators.findings import anomalies_of

#: Days on either side of a day that its median takes in, and how many it needs.
REACH, LEAST = 14, 15
_STATE = "first int, last int, start int, sums array<double>"
_LEVEL = "series string, day date, y double, mid double"
_EPOCH = Date(1970, 1, 1).toordinal()


def _medians(sums: np.ndarray) -> np.ndarray:
    """Centred medians of a dense run of days; NaN where a window holds too few of them."""
    padded = np.concatenate([np.full(REACH, np.nan), sums, np.full(REACH, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * REACH + 1)
    held = (~np.isnan(windows)).sum(1)
    with np.errstate(all="ignore"):
        return np.where(held >= LEAST, np.nanmedian(windows, axis=1), np.nan)


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.groupby(["series", "day"], as_index=False, sort=False)["v"].sum()


def _updated(delay: int):  # noqa: ANN202
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new: dict[int, float] = {}
        for frame in frames:
            for day, v in zip(frame["day"], frame["v"], strict=True):
                new[day.toordinal() - _EPOCH] = new.get(day.toordinal() - _EPOCH, 0.0) + v
        if state.exists and state.get[2] > state.get[0]:
            # the run was cut, so days near its start can no longer be put right
            new = {day: v for day, v in new.items() if day >= state.get[2] + 2 * REACH}
        if not new:
            return
        lo, hi = min(new), max(new)
        first, last, start, sums = state.get if state.exists else (lo, hi, lo, [])
        old = last if state.exists else lo
        first, last = min(first, lo), max(last, hi)
        begin = min(start, lo)
        run = np.zeros(last - begin + 1)
        run[start - begin : start - begin + len(sums)] += sums
        for day, v in new.items():
            run[day - begin] += v
        # days whose window took in a changed or a new day
        touched = max(first, min(lo, old + 1) - REACH)
        middle = _medians(run)
        at = np.arange(touched - begin, len(run))
        yield pd.DataFrame({"series": key[0], "day": [Date.fromordinal(int(begin + i) + _EPOCH) for i in at], "y": run[at], "mid": middle[at]})
        # late rows of the next batch are held against what was newest before this one
        keep = max(begin, old - delay - 1 - 2 * REACH)
        state.update((int(first), int(last), int(keep), run[keep - begin :].tolist()))

    return update


def advance(spark: SparkSession, rows: DataFrame, place: str, row_id: str, date: str, metric: str, series: str | None = None, delay_days: int = 2) -> None:
    """Bring the levels in the folder ``place`` up to date with all that the streaming ``rows`` hold now.

    Rows without a date or value are left out. ``delay_days`` says how far
    behind the newest row a row may come; a table that is replayed in no order
    of time needs a delay as long as its span. The state grows with the delay.
    """
    key = F.coalesce(F.col(series).cast("string"), F.lit("")) if series else F.lit("")
    named = rows.where(F.col(date).isNotNull() & F.col(metric).isNotNull()).select(F.col(row_id).alias("id"), F.col(date).cast("timestamp").alias("at"), key.alias("series"), F.col(metric).cast("double").alias("v"))
    once = named.withWatermark("at", f"{delay_days} days").dropDuplicatesWithinWatermark(["id"])
    days = once.select("series", F.to_date("at").alias("day"), "v").mapInPandas(_summed, "series string, day date, v double")
    levels = days.groupBy("series").applyInPandasWithState(_updated(delay_days), _LEVEL, _STATE, "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/levels/batch={number}")

    started = levels.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()


def levels(spark: SparkSession, place: str) -> DataFrame:
    """(series, day, y, mid) as last written."""
    held = spark.read.schema(f"{_LEVEL}, batch bigint").parquet(f"{place}/levels")
    newest = held.groupBy("series", "day").agg(F.max_by(F.struct("y", "mid"), "batch").alias("x"))
    return newest.select("series", "day", "x.y", F.when(~F.isnan("x.mid"), F.col("x.mid")).alias("mid"))


def anomalies(spark: SparkSession, place: str, series: str = "", **limits: float) -> DataFrame:
    """(day, y, expected, score) of one series, as the batch query has it; see ``findings.daily_anomalies``."""
    days = levels(spark, place).where(F.col("series") == series).select(F.col("day").alias("period"), "y", "mid")
    return anomalies_of(days, **limits)
