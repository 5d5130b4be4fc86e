"""Findings on pairs of measures from one matrix: correlations within a band, and parts of wholes by group.

Every task adds up square matrices over its rows (how many rows hold both
measures, their sums, products and order), so a table of n measures is read
once, and n * n numbers a task are all that is exchanged. Rows without a value
take no part in the pairs of that measure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: measures whose correlation with another says nothing, by name.
COMPONENT_NAME = r"budget|target|planned|expected|quota|cogs|(^|_)cost|(^|_)total|pending|remaining|balance|(^|_)due|transactions?|orders?|count"
#: Columns of the matrix: rows that hold both, sums of the first, of its squares, of the products, rows with first <= second, and of pairs with a second over 0: rows, rows with first <= second, rows with first < 0, sums of both.
SUMS = ("n", "sx", "sxx", "sxy", "le", "pn", "ple", "neg", "pa", "pb")


def _numbers(frame: pd.DataFrame, columns: int) -> np.ndarray:
    return frame[[f"m{i}" for i in range(columns)]].to_numpy(float, na_value=np.nan)


def _matrices(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """SUMS by pair (first, second) over the rows of ``x``."""
    n = x.shape[1]
    there = ~np.isnan(x)
    held, full = there.astype(float), np.where(there, x, 0.0)
    moved = np.where(there, x - centre, 0.0)
    over = (there & (full > 0)).astype(float)
    out = np.zeros((len(SUMS), n, n))
    out[0], out[1], out[2], out[3] = held.T @ held, moved.T @ held, (moved**2).T @ held, moved.T @ moved
    out[5], out[7], out[8], out[9] = held.T @ over, ((full < 0) & there).astype(float).T @ over, full.T @ over, held.T @ (full * over)
    for i in range(n):
        within = there[:, i : i + 1] & there
        out[4, i] = (within & (full[:, i : i + 1] <= full)).sum(0)
        out[6, i] = (within & (full > 0) & (full[:, i : i + 1] <= full + 1e-9)).sum(0)
    return out


def pair_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second, ``SUMS``) of all ordered pairs of ``columns``, sums about the means of the columns."""
    n = len(columns)
    flat = df.select(*[F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(columns)])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(n), np.zeros(n)
        for frame in frames:
            x = _numbers(frame, n)
            good = np.isfinite(x)
            count, total = count + good.sum(0), total + np.where(good, x, 0.0).sum(0)
        yield pd.DataFrame({"i": range(n), "c": count, "t": total})

    # means keep the sums of squares small; a mean of what is finite does
    means = {r["i"]: r["t"] / r["c"] for r in flat.mapInPandas(sums, "i int, c double, t double").groupBy("i").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where("c > 0").collect()}
    centre = np.array([means.get(i, 0.0) for i in range(n)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(SUMS), n, n))
        for frame in frames:
            x = _numbers(frame, n)
            x[np.isinf(x)] = np.nan
            for begin in range(0, len(x), 4096):
                total += _matrices(x[begin : begin + 4096], centre)
        first, second = np.divmod(np.arange(n * n), max(n, 1))
        yield pd.DataFrame({"i": first, "j": second, **{k: total[m].ravel() for m, k in enumerate(SUMS)}})

    summed = flat.mapInPandas(run, "i int, j int, " + ", ".join(f"{k} double" for k in SUMS)).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in SUMS])
    names = F.array(*[F.lit(c) for c in columns])
    return summed.where("i <> j").select(F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), *SUMS)


def correlated(matrix: DataFrame) -> DataFrame:
    """(first, second, n, r) of every ordered pair with two rows or more and some spread."""
    # the second's sums are those of the turned pair
    turned = matrix.select(F.col("first").alias("second"), F.col("second").alias("first"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = matrix.join(turned, ["first", "second"])
    a, b = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(a * b)
    return both.where("n >= 2").withColumn("r", F.when((a > 0) & (b > 0), r)).where("r is not null").select("first", "second", F.col("n").cast("long").alias("n"), "r")


def moves_with(df: DataFrame, metric: str, others: list[str], least_rows: int = 50, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """(other, n, r): the measure that moves with ``metric`` most, of those between ``low`` and ``high``; one row or none.

    Names that stand for a component of another measure are left out, and a
    table under ``least_rows`` rows finds nothing. A correlation near one is a
    copy or a part, not a driver. Ties go to the smaller name.
    """
    named = [o for o in others if o != metric and not re.search(COMPONENT_NAME, o, re.I)]
    matrix = pair_matrix(df, [metric, *named])
    enough = df.agg((F.count("*") >= least_rows).alias("enough")).first()["enough"]
    found = correlated(matrix).where((F.col("first") == metric) & F.lit(enough) & (F.abs("r") > low) & (F.abs("r") < high))
    return found.orderBy(F.abs("r").desc(), "second").limit(1).select(F.col("second").alias("other"), "n", "r")


def part_pairs(matrix: DataFrame, rows: int, least_rows: int = 40) -> DataFrame:
    """(part, whole, n, overall): pairs of which the first is within the second in 95 % of the rows where the second is over 0.

    Both must be there in 90 % of the ``rows``; the part is never negative; the
    whole's sum is over 0 and the part's share of it between 0 and 0.999.
    """
    overall = F.col("pa") / F.col("pb")
    good = matrix.where((F.col("n") >= 0.9 * rows) & (F.col("pn") >= least_rows) & (F.col("ple") >= 0.95 * F.col("pn")) & (F.col("neg") == 0) & (F.col("pb") > 0) & (F.col("pa") > 0) & (overall < 0.999))
    return good.select(F.col("first").alias("part"), F.col("second").alias("whole"), F.col("pn").cast("long").alias("n"), overall.alias("overall"))


def group_sums(df: DataFrame, pairs: list[tuple[str, str]], dimensions: list[str]) -> DataFrame:
    """(dimension, label, part, whole, n, pa, pb) of every group and pair, over rows that hold both and a whole over 0; one pass."""
    columns = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(columns)}
    first, second = np.array([at[a] for a, _ in pairs], int), np.array([at[b] for _, b in pairs], int)
    flat = df.select(*[F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(columns)], *[F.col(f"`{d}`").cast("string").alias(f"d{i}") for i, d in enumerate(dimensions)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for frame in frames:
            x = _numbers(frame, len(columns))
            a, b = x[:, first], x[:, second]
            good = ~np.isnan(a) & ~np.isnan(b) & (b > 0)
            sums = np.stack([good, np.where(good, a, 0.0), np.where(good, b, 0.0)])
            for d in range(len(dimensions)):
                codes, labels = pd.factorize(frame[f"d{d}"])
                for k, label in enumerate(labels):
                    held[d, label] = held.get((d, label), 0) + sums[:, codes == k].sum(1)
        out = [(d, label, p, *v[:, p]) for (d, label), v in held.items() for p in range(len(pairs))]
        yield pd.DataFrame(out, columns=["d", "label", "p", "n", "pa", "pb"])

    summed = flat.mapInPandas(run, "d int, label string, p int, n double, pa double, pb double").groupBy("d", "label", "p").agg(*[F.sum(k).alias(k) for k in ("n", "pa", "pb")])
    pick = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), F.col(key))
    return summed.select(pick(dimensions, "d").alias("dimension"), "label", pick([a for a, _ in pairs], "p").alias("part"), pick([b for _, b in pairs], "p").alias("whole"), F.col("n").cast("long").alias("n"), "pa", "pb")


def ratio_gaps(df: DataFrame, measures: list[str], dimensions: list[str], most: int = 8) -> DataFrame:
    """(part, whole, dimension, label, n, ratio, overall, share, gap, rank): groups whose part of a whole is off, over all pairs found among the first ``most`` measures.

    A group counts with 20 rows and 5 % of the whole; it is off by 10 points at
    least, and by a quarter of the overall ratio. ``rank`` 1 is the finding:
    the largest gap times share.
    """
    columns = measures[:most]
    rows = df.count()
    pairs = [(r["part"], r["whole"], r["overall"]) for r in part_pairs(pair_matrix(df, columns), rows).collect()]
    several = _several(df, [a for a, _, _ in pairs]) if pairs else set()
    pairs = [p for p in pairs if p[0] in several]
    schema = "part string, whole string, dimension string, label string, n bigint, ratio double, overall double, share double, gap double, rank int"
    if not pairs or not dimensions:
        return df.sparkSession.createDataFrame([], schema)
    known = df.sparkSession.createDataFrame(pairs, "part string, whole string, overall double")
    sums = group_sums(df, [(a, b) for a, b, _ in pairs], dimensions)
    whole = df.select(*[F.sum(F.when((F.col(f"`{b}`") > 0) & F.col(f"`{a}`").isNotNull(), F.col(f"`{b}`"))).alias(f"t{i}") for i, (a, b, _) in enumerate(pairs)]).first()
    totals = df.sparkSession.createDataFrame([(a, b, float(whole[f"t{i}"])) for i, (a, b, _) in enumerate(pairs)], "part string, whole string, total double")
    joined = sums.join(F.broadcast(known), ["part", "whole"]).join(F.broadcast(totals), ["part", "whole"])
    ratio, share = F.col("pa") / F.col("pb"), F.col("pb") / F.col("total")
    made = joined.where("n >= 20 and pb > 0").withColumn("ratio", ratio).withColumn("share", share).withColumn("gap", F.abs(F.col("ratio") - F.col("overall")))
    off = made.where((F.col("share") >= 0.05) & (F.col("gap") >= F.greatest(F.lit(0.10), 0.25 * F.col("overall"))))
    # a row for each pair and group: few
    order = Window.orderBy((F.col("gap") * F.col("share")).desc(), "part", "whole", "dimension", "label")
    return off.withColumn("rank", F.row_number().over(order).cast("int")).select(*[c.split()[0] for c in schema.split(", ")])


def _several(df: DataFrame, columns: list[str], least: int = 3) -> set[str]:
    """Columns of at least ``least`` different values."""
    names = sorted(set(columns))
    counts = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if counts[f"c{i}"] >= least}
