"""Findings on one table: groups, shares, distributions, correlations, trends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.operators.periods import bin_of, period_series
from tallyweir.operators.quantiles import exact_quantiles


def top_groups(df: DataFrame, dimension: str, metric: str, how: str = "sum", k: int = 8) -> DataFrame:
    """The k largest groups; null keys are left out. A top-k, so no full sort."""
    value = F.coalesce(F.sum(metric), F.lit(0.0)) if how == "sum" else F.avg(metric)
    return df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(value.alias("value")).orderBy(F.desc("value"), "label").limit(k)


def pie(df: DataFrame, dimension: str, metric: str, k: int = 7) -> DataFrame:
    """Positive groups, the k largest by name and the rest as 'Other'."""
    sums = df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(F.sum(metric).alias("value")).where("value > 0")
    # one row per group: the window sees groups, not input rows
    ranked = sums.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("value"), "label")))
    return ranked.groupBy(F.when(F.col("rn") <= k, F.col("label")).otherwise("Other").alias("label")).agg(F.sum("value").alias("value"))


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(bin, lo, hi, n): log bins if max/median > 20 and min > 0, clipped to p1..p99 if negative, else linear.

    Fewer than 20 values or 5 distinct ones give no rows.
    """
    x = F.col(column).cast("double")
    spread = exact_quantiles(df, [column], [0.01, 0.5, 0.99])[column]
    distinct = df.agg(F.approx_count_distinct(x, 0.01)).first()[0] if spread.n >= 20 else 0
    if distinct < 5:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    p01, median, p99 = spread.quantiles
    lo, hi = (p01, p99) if spread.least < 0 else (spread.least, spread.most)
    rows = [(spread.least > 0 and spread.most > 20 * median, lo, hi)] if hi > lo else []
    edges = df.sparkSession.createDataFrame(rows, "logs boolean, lo double, hi double")
    low, high = F.when(F.col("logs"), F.ln("lo")).otherwise(F.col("lo")), F.when(F.col("logs"), F.ln("hi")).otherwise(F.col("hi"))
    held = edges.select("logs", low.alias("a"), high.alias("b"))
    value = F.when(F.col("logs"), F.ln("x")).otherwise(F.col("x"))
    rows = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(held)).withColumn("v", F.greatest("a", F.least("b", value)))
    # the last bin is closed
    counted = rows.groupBy(F.least(F.lit(bins), F.width_bucket("v", "a", "b", F.lit(bins))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = held.select("logs", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    edge = lambda i: F.when(F.col("logs"), F.exp(F.col("a") + (F.col("b") - F.col("a")) * i / bins)).otherwise(F.col("a") + (F.col("b") - F.col("a")) * i / bins)
    return spine.join(counted, "bin", "left").select("bin", edge(F.col("bin") - 1).alias("lo"), edge(F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def concentration(df: DataFrame, entity: str, metric: str, k: int = 5) -> DataFrame:
    """(entities, top, total, share, found): the k largest hold 25 % or more of 15 or more entities, nothing negative."""
    sums = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.sum(metric).alias("v"), F.min(metric).alias("least"))
    top = sums.orderBy(F.desc("v"), entity).limit(k).agg(F.sum("v").alias("top"))
    whole = sums.agg(F.count("*").alias("entities"), F.sum("v").alias("total"), F.min("least").alias("least"))
    share = F.try_divide("top", "total")
    return whole.crossJoin(F.broadcast(top)).select("entities", "top", "total", share.alias("share"), F.coalesce((F.col("entities") >= 15) & (F.col("least") >= 0) & (share >= 0.25), F.lit(False)).alias("found"))


def dominant_segment(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """(label, share, segments, found): one of 3 or more segments holds more than max(35 %, 1.5 / k)."""
    sums = df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(F.sum(metric).alias("v"))
    made = sums.agg(F.max_by("label", F.struct("v", "label")).alias("label"), F.try_divide(F.max("v"), F.sum("v")).alias("share"), F.count("*").alias("segments"))
    return made.withColumn("found", F.coalesce((F.col("segments") >= 3) & (F.col("share") > F.greatest(F.lit(0.35), F.try_divide(F.lit(1.5), "segments"))), F.lit(False)))


def correlations(df: DataFrame, columns: list[str], least_rows: int = 50) -> DataFrame:
    """(a, b, n, r) of all pairs in one pass, over rows where both are there; constant columns are left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        n, sx, sy, sxy, sxx, syy = F.count(x), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x), F.sum(y * y)
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        r = F.when(spread > 0, (n * sxy - sx * sy) / F.sqrt(spread))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("r")).alias(f"p{i}"))
    made = df.agg(*aggs).select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return made.where((F.col("n") >= least_rows) & F.col("r").isNotNull())


def negatives(df: DataFrame, metric: str) -> DataFrame:
    """(n, total, found): entries under zero; 3 or more are a finding."""
    return df.where(F.col(metric) < 0).agg(F.count("*").alias("n"), F.coalesce(F.sum(metric), F.lit(0.0)).alias("total")).withColumn("found", F.col("n") >= 3)


def trend(df: DataFrame, date: str, metric: str, grain: str = "MS") -> DataFrame:
    """(first, last, change, found): mean of the first and the last max(2, n // 3) periods; 5 % or more is a finding."""
    series = period_series(df, date, metric, "sum", grain)
    up, down = Window.orderBy("period"), Window.orderBy(F.desc("period"))
    marked = series.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down)).withColumn("k", F.greatest(F.lit(2), F.floor(F.count("*").over(Window.partitionBy()) / 3)))
    made = marked.agg(F.avg(F.when(F.col("i") <= F.col("k"), F.col("y"))).alias("first"), F.avg(F.when(F.col("j") <= F.col("k"), F.col("y"))).alias("last"))
    change = F.try_divide(F.col("last") - F.col("first"), F.abs("first"))
    return made.withColumn("change", change).withColumn("found", F.coalesce(F.abs("change") >= 0.05, F.lit(False)))


def _within(date: str, start: str, end: str) -> Column:
    """A half-open range of days, on the bare column, so that the scan can use it."""
    return (F.col(date) >= F.lit(start).cast("timestamp")) & (F.col(date) < F.lit(end).cast("timestamp"))


def change_bridge(df: DataFrame, date: str, metric: str, dimensions: list[str], before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """(dimension, label, before, after, delta): contributions that add up to the change exactly.

    One conditional aggregation over both half-open date ranges, which reach the
    scan as filters; blank keys keep a segment of their own, so that the sum
    holds for every dimension.
    """
    old, new = (_within(date, *ends) for ends in (before, after))
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(blank)")).alias("label")) for c in dimensions])).alias("s")
    rows = df.where(old | new).select(F.when(old, F.col(metric)).alias("o"), F.when(new, F.col(metric)).alias("n"), items)
    made = rows.groupBy("s.dimension", "s.label").agg(F.coalesce(F.sum("o"), F.lit(0.0)).alias("before"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("after"))
    return made.withColumn("delta", F.col("after") - F.col("before"))


def price_volume(df: DataFrame, date: str, quantity: str, revenue: str, segment: str, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """(label, volume, price, delta): delta = volume + price exactly; a new or gone segment is all volume."""
    old, new = (_within(date, *ends) for ends in (before, after))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    made = df.where(old | new).groupBy(F.coalesce(F.col(segment).cast("string"), F.lit("(blank)")).alias("label")).agg(total(quantity, old).alias("q0"), total(quantity, new).alias("q1"), total(revenue, old).alias("r0"), total(revenue, new).alias("r1"))
    price = F.when((F.col("q0") > 0) & (F.col("q1") > 0), (F.col("r1") / F.col("q1") - F.col("r0") / F.col("q0")) * F.col("q1")).otherwise(0.0)
    return made.select("label", (F.col("r1") - F.col("r0") - price).alias("volume"), price.alias("price"), (F.col("r1") - F.col("r0")).alias("delta"))


def period_outliers(series: DataFrame, z: float = 3.5, most: int = 2) -> DataFrame:
    """(period, y, score): the periods farthest from the median, by 0.6745 deviations in units of the median deviation.

    ``series`` is (period, y), one row a period. A median deviation of 0 finds nothing.
    """
    centred = series.where("y is not null").crossJoin(F.broadcast(series.agg(F.median("y").alias("m")))).withColumn("off", F.col("y") - F.col("m"))
    scored = centred.crossJoin(F.broadcast(centred.agg(F.median(F.abs("off")).alias("mad")))).withColumn("score", F.try_divide(0.6745 * F.col("off"), "mad"))
    return scored.where(F.abs("score") > z).orderBy(F.abs("score").desc(), "period").limit(most).select("period", "y", "score")


def ratio_pairs(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """(part, whole, n, share): ordered pairs where the part is within the whole in ``least`` of the rows that hold both, in one pass."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    counts = [F.struct(F.lit(a).alias("part"), F.lit(b).alias("whole"), F.count_if(both(a, b)).alias("n"), F.count_if(both(a, b) & (F.col(a) <= F.col(b))).alias("k")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    made = df.agg(*counts).select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return made.where((F.col("n") > 0) & (F.col("k") >= least * F.col("n"))).select("part", "whole", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"))


def daily_anomalies(df: DataFrame, date: str, metric: str, z: float = 6.0, off: float = 0.4, most: int = 2) -> DataFrame:
    """(day, y, expected, score): days far from a centred 29-day median times their weekday's factor; see :func:`anomalies_of`."""
    days = settled(period_series(df, date, metric, "sum", "D"))
    near = Window.orderBy("period").rowsBetween(-14, 14)
    return anomalies_of(days.withColumn("mid", F.when(F.count("y").over(near) >= 15, F.percentile("y", F.lit(0.5)).over(near))), z, off, most)


def settled(days: DataFrame) -> DataFrame:
    """``days``, a few columns with one row for each period of a calendar, computed once: what follows reads no input again."""
    return days.sparkSession.createDataFrame(days.collect(), days.schema)


def anomalies_of(days: DataFrame, z: float = 6.0, off: float = 0.4, most: int = 2) -> DataFrame:
    """(day, y, expected, score) of the most unusual days of (period, y, mid), ``mid`` the median around a day.

    Needs 28 days, 20 of them with a positive sum and at most half of them zero.
    Residuals are scaled by the root of the expectation and by their own median
    deviation. All medians are of one row a day.
    """
    days = settled(days)
    gate = days.agg((F.count_if(F.col("y") > 0) >= 20) & (2 * F.count_if(F.col("y") == 0) <= F.count("*")) & (F.count("*") >= 28)).first()[0]
    ratio = days.where(F.lit(bool(gate))).withColumn("wd", F.weekday("period")).withColumn("r", F.when(F.col("mid") > 0, F.col("y") / F.col("mid")))
    factors = ratio.groupBy("wd").agg(F.median("r").alias("f"))
    scaled = factors.crossJoin(factors.agg(F.avg("f").alias("m"))).select("wd", F.coalesce(F.try_divide("f", "m"), F.lit(1.0)).alias("f"))
    floor = days.where("y > 0").agg((0.1 * F.median("y")).alias("floor"))
    expected = ratio.join(F.broadcast(scaled), "wd").crossJoin(F.broadcast(floor)).where("mid is not null").withColumn("expected", F.greatest(F.col("mid") * F.col("f"), F.col("floor")))
    res = settled(expected.select("period", "y", "expected", F.try_divide(F.col("y") - F.col("expected"), F.sqrt("expected")).alias("res")))
    centre = res.agg(F.median("res").alias("c"))
    spread = res.crossJoin(F.broadcast(centre)).withColumn("dev", F.abs(F.col("res") - F.col("c")))
    mad = spread.agg(F.median("dev").alias("mad"))
    scored = spread.crossJoin(F.broadcast(mad)).withColumn("score", F.try_divide(0.6745 * (F.col("res") - F.col("c")), "mad"))
    hit = scored.where((F.abs("score") > z) & (F.abs(F.col("y") - F.col("expected")) >= off * F.col("expected")))
    return hit.orderBy(F.abs("score").desc(), "period").limit(most).select(F.col("period").alias("day"), "y", "expected", "score")


def rating_gaps(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """(label, n, mean, z, found): segments whose mean is 3 standard errors and 10 % off, with 15 rows or more."""
    whole = df.agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"))
    made = df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    z = F.try_divide(F.col("mean") - F.col("m"), F.try_divide(F.col("s"), F.sqrt("n")))
    found = (F.abs("z") >= 3) & (F.abs(F.col("mean") - F.col("m")) >= 0.1 * F.abs("m")) & (F.col("n") >= 15)
    return made.crossJoin(F.broadcast(whole)).withColumn("z", z).select("label", "n", "mean", "z", F.coalesce(found, F.lit(False)).alias("found"))


def segment_shift(df: DataFrame, date: str, metric: str, dimension: str, recent: int = 3, earlier: int = 6) -> DataFrame:
    """(label, recent, earlier, change): mean of the last 3 months against the 6 before, by segment; absent months are 0."""
    months = df.where(F.col(date).isNotNull() & F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label"), bin_of(F.col(date), "MS").alias("period")).agg(F.sum(metric).alias("v"))
    end = months.agg(F.max("period").alias("end"))
    back = months.crossJoin(F.broadcast(end)).withColumn("age", F.months_between("end", "period").cast("int"))
    made = back.groupBy("label").agg((F.coalesce(F.sum(F.when(F.col("age") < recent, F.col("v"))), F.lit(0.0)) / recent).alias("recent"), (F.coalesce(F.sum(F.when(F.col("age").between(recent, recent + earlier - 1), F.col("v"))), F.lit(0.0)) / earlier).alias("earlier"))
    return made.withColumn("change", F.try_divide(F.col("recent") - F.col("earlier"), F.abs("earlier")))


def ratio_gaps(df: DataFrame, part: str, whole: str, dimension: str) -> DataFrame:
    """(label, ratio, overall): a part as a share of its whole by segment, where part <= whole in 95 % of the rows."""
    both = df.where(F.col(part).isNotNull() & F.col(whole).isNotNull())
    total = both.agg(F.try_divide(F.sum(part), F.sum(whole)).alias("overall"), F.avg((F.col(part) <= F.col(whole)).cast("double")).alias("ok")).where("ok >= 0.95")
    made = both.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("ratio"))
    return made.crossJoin(F.broadcast(total)).select("label", "ratio", "overall")


def profile_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, missing_pct, uniques, mn, median, mx, outliers): two passes for all columns together.

    Outliers lie more than three interquartile ranges outside the quartiles, on
    a log scale where min > 0 and p99 / median > 8.
    """
    spreads = exact_quantiles(df, columns, [0.25, 0.5, 0.75, 0.99])
    aggs, kept = [F.count("*").alias("n")], {}
    for i, c in enumerate(columns):
        s, x, found = spreads[c], F.col(f"`{c}`").cast("double"), F.lit(0)
        if s.n:
            low, median, high, p99 = s.quantiles
            scale = lambda v: v
            if s.least > 0 and median > 0 and p99 / median > 8:
                low, high, scale = math.log10(low), math.log10(high), F.log10
            if high > low:
                gap = 3 * (high - low)
                found = F.count_if((scale(x) < low - gap) | (scale(x) > high + gap))
        kept[c] = s
        aggs.append(F.struct(F.count(x).alias("held"), F.count_distinct(F.col(f"`{c}`")).alias("uniques"), found.cast("bigint").alias("outliers")).alias(f"c{i}"))
    made = df.agg(*aggs).first()
    rows = [(c, 100.0 * (made["n"] - made[f"c{i}"]["held"]) / max(made["n"], 1), made[f"c{i}"]["uniques"], kept[c].least, kept[c].quantiles[1], kept[c].most, made[f"c{i}"]["outliers"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "name string, missing_pct double, uniques bigint, mn double, median double, mx double, outliers bigint")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n): rows that repeat an earlier one; null equals null. Rows meet by a 128-bit hash, so only 16 bytes are shuffled."""
    keys = df.groupBy(F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)).agg(F.count("*").alias("c"))
    return keys.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n"))


def range_attribution(df: DataFrame, date: str, metric: str, dimension: str, flagged: DataFrame, days: int = 14) -> DataFrame:
    """(day, label, excess): on each flagged day, every segment against its mean of the other days within +-14.

    ``flagged`` has at most two rows and is joined by broadcast.
    """
    daily = df.groupBy(F.to_date(date).alias("d"), F.col(dimension).alias("label")).agg(F.sum(metric).alias("v"))
    near = daily.join(F.broadcast(flagged.select("day")), F.col("d").between(F.date_add("day", -days), F.date_add("day", days)))
    made = near.groupBy("day", "label").agg(F.sum(F.when(F.col("d") == F.col("day"), F.col("v")).otherwise(0.0)).alias("on"), F.avg(F.when(F.col("d") != F.col("day"), F.col("v"))).alias("usual"))
    return made.select("day", "label", (F.col("on") - F.coalesce("usual", F.lit(0.0))).alias("excess"))
