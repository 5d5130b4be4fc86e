"""Exact quantiles of many columns by distributed selection: no sort, and no buffer that holds all values.

Each round asks a mergeable sketch for values around the rank wanted, counts
exactly how many values lie below and between them, and goes on between the two
that enclose it. A round leaves a few ten-thousandths of the values. Once few
different values are left, they are fetched with their counts. Columns become
rows, so one job a round serves all columns and quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that are fetched at once, over all columns and quantiles.
FETCHED = 50_000
#: Accuracy of the sketch, and how far from the wanted quantile its brackets lie, in parts of one.
ACCURACY, APART = 10_000, 3e-4


@dataclass(frozen=True)
class Spread:
    """Count, least, largest and the quantiles asked for of one column; None without a value."""

    n: int
    least: float | None
    most: float | None
    quantiles: tuple[float | None, ...]


@dataclass
class _Search:
    """One order statistic: the value at ``rank`` (from 0) among those from ``low`` to ``high``."""

    at: int
    rank: int
    low: float
    high: float
    size: int


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])
    return df.select(F.explode(values).alias("cell")).select("cell.*").where("x is not null and not isnan(x)")


def _within(cells: DataFrame, searches: list[_Search]) -> DataFrame:
    """(s, x): every value once for each search whose interval holds it."""
    rows = [(k, s.at, s.low, s.high) for k, s in enumerate(searches)]
    wanted = cells.sparkSession.createDataFrame(rows, "s int, at int, low double, high double")
    # a search is a row, and there are no more of them than columns times quantiles
    return cells.join(F.broadcast(wanted), "at").where("x between low and high").select("s", "x")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, Spread]:
    """Exact quantiles (between two values, in proportion) of each column; nulls and NaN are left out."""
    if not columns:
        return {}
    cells = _cells(df, columns)
    first = {r["at"]: r for r in cells.groupBy("at").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    found: dict[tuple[int, int], float] = {}
    places = {(i, p): p * (first[i]["n"] - 1) for i in first for p in probabilities}
    ranks = {(i, r) for (i, _), h in places.items() for r in (math.floor(h), math.ceil(h))}
    open_ = []
    for i, r in sorted(ranks):
        lo, hi, n = first[i]["lo"], first[i]["hi"], first[i]["n"]
        if lo == hi or r == 0:
            found[i, r] = lo
        elif r == n - 1:
            found[i, r] = hi
        else:
            open_.append((r, _Search(i, r, lo, hi, n)))
    while open_:
        open_ = _narrowed(cells, open_, found)
    out = {}
    for i, c in enumerate(columns):
        if i not in first:
            out[c] = Spread(0, None, None, (None,) * len(probabilities))
            continue
        made = []
        for p in probabilities:
            h = places[i, p]
            a, b = found[i, math.floor(h)], found[i, math.ceil(h)]
            made.append(a + (b - a) * (h - math.floor(h)))
        out[c] = Spread(first[i]["n"], first[i]["lo"], first[i]["hi"], tuple(made))
    return out


def _narrowed(cells: DataFrame, open_: list[tuple[int, _Search]], found: dict[tuple[int, int], float]) -> list[tuple[int, _Search]]:
    """One round: values found go to ``found``, the others come back with a narrower interval."""
    searches = [s for _, s in open_]
    inside = _within(cells, searches)
    near = lambda s, d: min(1.0, max(0.0, (s.rank + 0.5) / s.size + d))
    # a sketch is asked for all shares at once, of which each search uses two
    shares = sorted({near(s, d) for s in searches for d in (-APART, APART)})
    guessed = {r["s"]: r for r in inside.groupBy("s").agg(F.percentile_approx("x", F.array(*[F.lit(x) for x in shares]), F.lit(ACCURACY)).alias("q"), F.approx_count_distinct("x").alias("d")).collect()}
    few = [k for k in range(len(searches)) if guessed[k]["d"] * len(searches) <= FETCHED]
    if few:
        values: dict[int, list] = {}
        for r in inside.where(F.col("s").isin(few)).groupBy("s", "x").agg(F.count("*").alias("c")).collect():
            values.setdefault(r["s"], []).append((r["x"], r["c"]))
        for k in few:
            rank, left = open_[k][0], searches[k].rank
            for x, c in sorted(values[k]):
                if left < c:
                    found[searches[k].at, rank] = x
                    break
                left -= c
    wide = [k for k in range(len(searches)) if k not in few]
    if not wide:
        return []
    ends = {}
    for k in wide:
        s, q = searches[k], dict(zip(shares, guessed[k]["q"], strict=True))
        ends[k] = tuple(q[near(s, d)] for d in (-APART, APART))
    bounds = cells.sparkSession.createDataFrame([(k, *v) for k, v in ends.items()], "s int, a double, b double")
    counted = inside.join(F.broadcast(bounds), "s").groupBy("s").agg(F.expr("count_if(x < a)").alias("below"), F.expr("count_if(x between a and b)").alias("between"), F.expr("max(case when x < a then x end)").alias("under"), F.expr("min(case when x > b then x end)").alias("over"))
    left = []
    for r in counted.collect():
        s, (a, b) = searches[r["s"]], ends[r["s"]]
        if s.rank < r["below"]:
            new = _Search(s.at, s.rank, s.low, r["under"], r["below"])
        elif s.rank < r["below"] + r["between"]:
            new = _Search(s.at, s.rank - r["below"], a, b, r["between"])
        else:
            new = _Search(s.at, s.rank - r["below"] - r["between"], r["over"], s.high, s.size - r["below"] - r["between"])
        if new.low == new.high:
            found[s.at, open_[r["s"]][0]] = new.low
        else:
            left.append((open_[r["s"]][0], new))
    return left
