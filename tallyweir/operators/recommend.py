"""Recommendations: rules over a table's roles, scored by impact and weight.

All rules read one cube of totals: sums and counts by day, and by dimension,
label and month. The table itself is read three times: for the cube, for the two
largest records and for the entities. Stock and repeated records, where a table
has them, take a pass of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators import findings, periods
from tallyweir.operators.roles import COST, has, repeated_rows

# Patterns of names and statuses, weights of kinds, most items of a kind.
STATUS_NAME = r"status|state|stage|paid|payment_status"
BAD = r"overdue|unpaid|pending|outstanding|due|failed|declin|cancel|refund|return|bounced|defaulted|late"
OWED = r"overdue|unpaid|pending|outstanding|due|late|default"
STOCK = r"stock|on_hand|inventory|in_hand|balance_qty|closing_qty"
FLOW = r"ship|sold|sales_qty|units|qty|quantity|dispatch|issued|consum|distribut"
NOT_ADDITIVE = r"rating|stars?|score|grade|marks|margin|percent|pct|rate$|_rate|ratio|satisf|age$|temperature|height|balance"
LEVEL = r"stock|balance|on_hand"
WEIGHTS = {"entity": 1.0, "change": 1.0, "trend": 0.7, "season": 0.6, "stock": 1.3, "segment": 0.5, "status": 0.9, "refund": 0.7, "costline": 0.8, "anomaly": 0.5, "quality": 0.35}
MOST = {"quality": 2, "segment": 1, "anomaly": 1}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


@dataclass(frozen=True)
class Advice:
    kind: str
    key: tuple
    impact: float
    title: str
    because: str

    @property
    def score(self) -> float:
        return self.impact * WEIGHTS[self.kind]


def month_run(months: set[int]) -> list[int] | None:
    """The months in calendar order if they follow each other, also across the year's end."""
    for start in sorted(months):
        run = [(start - 1 + i) % 12 + 1 for i in range(len(months))]
        if set(run) == months:
            return run
    return None


def entity_shares(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """(label, value, total, entities) of the five largest entities; total counts positive ones."""
    sums = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("label")).agg(F.coalesce(F.sum(metric), F.lit(0.0)).alias("value"))
    whole = sums.agg(F.sum(F.greatest("value", F.lit(0.0))).alias("total"), F.count("*").alias("entities"))
    return sums.orderBy(F.desc("value"), "label").limit(5).crossJoin(F.broadcast(whole))


def lapsed(df: DataFrame, entity: str, date: str, metric: str) -> DataFrame:
    """(label, value): entities of two or more records, silent for 180 days, with records in the 365 days before."""
    d = F.to_date(date)
    end = df.agg(F.max(d)).first()[0]
    if end is None:
        return df.select(F.col(entity).alias("label"), F.lit(0.0).alias("value")).limit(0)
    cut = F.date_sub(F.lit(end), 180)
    before = (d >= F.date_sub(cut, 365)) & (d < cut)
    own = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("label")).agg(F.max(d).alias("last"), F.count("*").alias("n"), F.count_if(before).alias("b"), F.sum(F.when(before, F.col(metric))).alias("value"))
    return own.where((F.col("last") < cut) & (F.col("n") >= 2) & (F.col("b") > 0)).select("label", F.coalesce("value", F.lit(0.0)).alias("value"))


def season_index(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(month, rate, index): mean monthly rate of each calendar month, and its ratio to the mean month."""
    moy = periods.month_rate(df, date, metric).groupBy(F.month("period").alias("month")).agg(F.avg("rate").alias("rate"))
    return moy.crossJoin(F.broadcast(moy.agg(F.avg("rate").alias("m")))).select("month", "rate", F.try_divide("rate", "m").alias("index"))


def weekday_index(df: DataFrame, date: str, metric: str) -> DataFrame:
    """(weekday, index, above, days, active): ratio of a weekday to the mean one, and how often it beats its own week."""
    days = periods.period_series(df.where(F.col(metric).isNotNull()), date, metric, "sum", "D")
    weeks = days.groupBy(F.date_trunc("week", "period").alias("week")).agg(F.avg("y").alias("mean"))
    own = days.withColumn("week", F.date_trunc("week", "period")).join(weeks, "week").groupBy(F.weekday("period").alias("weekday"))
    made = own.agg(F.avg("y").alias("m"), F.avg((F.col("y") > F.col("mean")).cast("double")).alias("above"))
    whole = made.agg(F.avg("m").alias("all")).crossJoin(days.agg(F.count("*").alias("days"), F.avg((F.col("y") > 0).cast("double")).alias("active")))
    return made.crossJoin(F.broadcast(whole)).select("weekday", F.try_divide("m", "all").alias("index"), "above", "days", "active")


def stock_cover(df: DataFrame, date: str, dimension: str, stock: str, flow: str) -> DataFrame:
    """(label, stock, outflow, cover): stock of the last date over the mean outflow of the last 8 dates."""
    last = [r[0] for r in df.where(F.col(date).isNotNull()).select(date).distinct().orderBy(F.desc(date)).limit(8).collect()]
    if len(last) < 8:
        return df.select(F.col(dimension).alias("label"), F.lit(0.0).alias("stock"), F.lit(0.0).alias("outflow"), F.lit(0.0).alias("cover")).limit(0)
    own = df.where(F.col(date).isin(last) & F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label"))
    made = own.agg(F.sum(F.when(F.col(date) == F.lit(last[0]), F.col(stock).cast("double"))).alias("stock"), (F.sum(flow).cast("double") / F.count_distinct(date)).alias("outflow"))
    return made.where("stock is not null and outflow <> 0").withColumn("cover", F.col("stock") / F.col("outflow"))


def status_shares(df: DataFrame, status: str, metric: str) -> DataFrame:
    """(label, value, total, kind): amounts by status; kind is owed, lost or empty."""
    sums = df.where(F.col(status).isNotNull()).groupBy(F.col(status).cast("string").alias("label")).agg(F.coalesce(F.sum(metric), F.lit(0.0)).alias("value"))
    kind = F.when(F.col("label").rlike(f"(?i){OWED}"), "owed").when(F.col("label").rlike(f"(?i){BAD}"), "lost").otherwise("")
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("value").alias("total")))).withColumn("kind", kind)


def refunds(df: DataFrame, metric: str) -> DataFrame:
    """(n, refunds, gross, share): negative records against the positive ones."""
    x = F.col(metric)
    made = df.agg(F.count_if(x < 0).alias("n"), F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("refunds"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("gross"))
    return made.withColumn("share", F.try_divide(F.abs("refunds"), "gross"))


def windows_of(series: list[float], grain: str) -> tuple[float, float, bool] | None:
    """(now, before, alike): 12 against 12 months, else 3 months against the same a year ago, else last against first third."""
    n = len(series)
    if grain == "MS" and n >= 24:
        pair, alike = (series[-12:], series[-24:-12]), True
    elif grain == "MS" and n >= 15:
        pair, alike = (series[-3:], series[-15:-12]), True
    elif n >= 6:
        k = max(2, n // 3)
        pair, alike = (series[-k:], series[:k]), False
    else:
        return None
    return (sum(pair[0]), sum(pair[1]), alike) if sum(pair[1]) else None


#: Cells of a cube that rules may hold: labels of dimensions (50 at most each) by months, and days.
MOST_CELLS = 1_000_000


def totals_cube(df: DataFrame, metric: str, date: str | None, dimensions: list[str]) -> DataFrame:
    """(dimension, label, period, v, n, rows, lost, lost_n): sums of ``metric`` by group and month, in one pass.

    Dimension '' is the whole table, by day. ``n`` counts values, ``rows`` rows,
    ``lost`` and ``lost_n`` are the sum and the number of values under 0. Rows
    without a date have a null period, and without a label a null label.
    """
    day = F.to_date(F.col(f"`{date}`")) if date else F.lit(None).cast("date")
    x = F.col(f"`{metric}`").cast("double")
    item = lambda d, label, at: F.struct(F.lit(d).alias("dimension"), label.cast("string").alias("label"), at.alias("period"))
    month = F.trunc(day, "month")
    items = F.array(item("", F.lit(""), day), *[item(d, F.col(f"`{d}`"), month) for d in dimensions])
    cells = df.select(x.alias("x"), F.explode(items).alias("s")).groupBy("s.dimension", "s.label", "s.period")
    under = F.when(F.col("x") < 0, F.col("x"))
    return cells.agg(F.sum("x").alias("v"), F.count("x").alias("n"), F.count("*").alias("rows"), F.sum(under).alias("lost"), F.count(under).alias("lost_n"))


@dataclass
class Table:
    """A table with its roles and its cube; ``series`` holds its (period, y) rows, a calendar.

    ``daily`` is (day, v) of the whole table. ``mega`` is the record that all
    trends are looked at without as well: its value, day and labels.
    """

    df: DataFrame
    found: dict
    cells: pd.DataFrame
    daily: DataFrame
    grain: str | None = None
    series: list = field(default_factory=list)
    mega: dict | None = None

    @property
    def metric(self) -> str:
        return self.found["metric"]

    @property
    def date(self) -> str:
        return self.found["date"]

    def dims(self) -> list[str]:
        unique = {s["name"]: s["unique"] for s in self.found["columns"]}
        return [c for c in self.found["dims"] if 3 <= unique[c] <= 30 and not has(STATUS_NAME, c) and unique[c] < 0.5 * self.found["rows"]]

    def of(self, dim: str, mega: bool = True) -> pd.DataFrame:
        """(label, period, v) of a dimension, labelled rows only; without the mega record if it is not wanted."""
        own = self.cells[(self.cells["dimension"] == dim) & self.cells["label"].notna()].copy()
        own["v"] = own["v"].fillna(0.0)
        if not mega and self.mega:
            at = (own["label"] == self.mega["labels"].get(dim)) & ((own["period"] == self.mega["month"]) | (own["period"].isna() & (self.mega["month"] is None)))
            own.loc[at, "v"] -= self.mega["value"]
        return own

    def sums(self, dim: str, mega: bool = True) -> list[tuple[str, float]]:
        """Sums by a dimension of at most 50 values, largest first."""
        own = self.of(dim, mega).groupby("label")["v"].sum()
        return sorted(((k, float(v)) for k, v in own.items()), key=lambda r: (-r[1], r[0]))

    def days(self, mega: bool = True) -> DataFrame:
        """(day, v) with or without the mega record."""
        if mega or not self.mega or self.mega["day"] is None:
            return self.daily
        return self.daily.withColumn("v", F.when(F.col("day") == F.lit(self.mega["day"]), F.col("v") - self.mega["value"]).otherwise(F.col("v")))


def table_of(df: DataFrame, found: dict) -> Table:
    """The cube of a table by its roles, the calendar series, and the record that holds 10 % of the total and 5 times the next."""
    metric, date, dims = found["metric"], found["date"], found["dims"]
    cells = totals_cube(df, metric, date, dims).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} groups by month")
    whole = cells[(cells["dimension"] == "") & cells["period"].notna()]
    daily = df.sparkSession.createDataFrame([(r.period, None if pd.isna(r.v) else float(r.v)) for r in whole.itertuples()], "day date, v double")
    table = Table(df, found, cells, daily)
    if date and len(whole):
        table.grain = periods.grain_of(daily, "day")
        table.series = periods.trimmed(daily, "day", "v", "sum", table.grain).orderBy("period").collect()
    all_rows = cells[cells["dimension"] == ""]
    n, total = int(all_rows["n"].sum()), float(all_rows["v"].sum())
    if n >= 10 and total > 0:
        day = F.to_date(F.col(f"`{date}`")) if date else F.lit(None).cast("date")
        own = df.where(F.col(f"`{metric}`").isNotNull()).select(F.col(f"`{metric}`").cast("double").alias("x"), day.alias("day"), *[F.col(f"`{d}`").cast("string").alias(f"d{i}") for i, d in enumerate(dims)])
        first, second = own.orderBy(F.desc("x")).limit(2).collect()
        if first["x"] >= 0.1 * total and first["x"] >= 5 * second["x"]:
            table.mega = {"value": first["x"], "day": first["day"], "month": first["day"] and first["day"].replace(day=1), "labels": {d: first[f"d{i}"] for i, d in enumerate(dims)}}
    return table


def _percent(x: float) -> str:
    return f"{100 * x:.0f} %"


@dataclass(frozen=True)
class Entities:
    """The five largest entities, the sum of the positive ones, the least sum, how many there are, and those that went quiet."""

    top: list
    total: float
    least: float
    count: int
    quiet: int
    quiet_value: float


def entities_of(t: Table) -> Entities | None:
    """One row per entity from one pass, held while it is read twice."""
    entity = t.found["entity"]
    if not entity:
        return None
    end = max((r for r in t.cells.loc[t.cells["dimension"] == "", "period"] if r is not None and not pd.isna(r)), default=None)
    x, day = F.col(f"`{t.metric}`").cast("double"), F.to_date(F.col(f"`{t.date}`")) if t.date else F.lit(None).cast("date")
    cut = F.date_sub(F.lit(end).cast("date"), 180)
    before = (day >= F.date_sub(cut, 365)) & (day < cut)
    own = t.df.where(F.col(f"`{entity}`").isNotNull()).groupBy(F.col(f"`{entity}`").alias("label"))
    sums = own.agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("value"), F.max(day).alias("last"), F.count("*").alias("n"), F.count_if(before).alias("b"), F.coalesce(F.sum(F.when(before, x)), F.lit(0.0)).alias("before")).persist()
    try:
        gone = (F.col("last") < cut) & (F.col("n") >= 2) & (F.col("b") > 0)
        total, least, count, quiet, value = sums.agg(F.sum(F.greatest("value", F.lit(0.0))), F.min("value"), F.count("*"), F.count_if(gone), F.coalesce(F.sum(F.when(gone, F.col("before"))), F.lit(0.0))).first()
        top = sums.orderBy(F.desc("value"), "label").limit(5).select("label", "value").collect()
    finally:
        sums.unpersist()
    return Entities(top, total or 0.0, least or 0.0, count, quiet, value)


def r_entity(t: Table) -> list[Advice]:
    e = entities_of(t)
    if e is None:
        return []
    out = []
    if len(e.top) == 5 and e.total > 0:
        first, five = e.top[0]["value"] / e.total, sum(r["value"] for r in e.top) / e.total
        if first >= 0.08 and e.top[0]["value"] >= 3 * e.top[1]["value"]:
            out = [Advice("entity", ("entity", str(e.top[0]["label"])), first, f"Secure {e.top[0]['label']}: {_percent(first)} of all {t.metric}", f"{e.top[0]['value']:,.0f} of {e.total:,.0f}; the next holds {e.top[1]['value']:,.0f}.")]
        elif five >= 0.25 and e.count >= 15:
            out = [Advice("entity", ("entity", "top5"), 0.7 * five, f"Look after the five largest: {_percent(five)} of {t.metric}", f"Five of {e.count} entities.")]
    whole = t.cells[(t.cells["dimension"] == "") & t.cells["period"].notna()]
    if len(whole):
        end = max(whole["period"])
        year = float(whole.loc[[(end - p).days <= 365 for p in whole["period"]], "v"].sum())
        if e.quiet >= 3 and year > 0 and e.quiet_value >= 0.03 * year:
            out.append(Advice("entity", ("entity", "lapsed"), e.quiet_value / year, f"Win back {e.quiet} that went quiet", f"They brought {e.quiet_value:,.0f} in the year before and nothing for 180 days."))
    return out


def r_change(t: Table) -> list[Advice]:
    """The last two full months by rate per day; a change that last year's season shows too counts less."""
    if t.grain != "MS" or len(t.series) < 2 or not t.dims():
        return []
    y = [r["y"] for r in t.series]
    old, new = (str(r["period"]) for r in t.series[-2:])
    rates = [r["rate"] for r in periods.month_rate(t.daily, "day", "v").where(F.col("period").isin(old, new)).orderBy("period").collect()]
    if len(rates) < 2 or not rates[0] or not y[-2]:
        return []
    raw, alike = y[-1] / y[-2] - 1, rates[1] / rates[0] - 1
    if abs(alike) < 0.03 or raw * alike <= 0 or abs(alike) < 0.5 * abs(raw):
        return []
    season = len(y) >= 14 and y[-14] and (y[-13] / y[-14] - 1) * raw > 0 and abs(y[-13] / y[-14] - 1) >= 0.6 * abs(raw)
    spread: dict[str, list] = {}
    for d in t.dims()[:3]:
        own = t.cells[(t.cells["dimension"] == d) & t.cells["period"].notna()]
        by = lambda at, own=own: own[[str(p) == at for p in own["period"]]].assign(label=lambda x: x["label"].fillna("(blank)")).set_index("label")["v"].fillna(0.0)
        before, after = by(old), by(new)
        rows = [{"label": k, "before": float(before.get(k, 0.0)), "after": float(after.get(k, 0.0))} for k in {*before.index, *after.index}]
        rows = [r | {"delta": r["after"] - r["before"]} for r in rows]
        if rows:
            spread[d] = sorted(rows, key=lambda r: (-abs(r["delta"]), r["label"]))
    if not spread:
        return []
    share = lambda rows: abs(rows[0]["delta"]) / (sum(abs(r["delta"]) for r in rows) or 1)
    dim = max(spread, key=lambda d: share(spread[d]))
    lead, word = spread[dim][0], "rise" if y[-1] > y[-2] else "fall"
    good = (y[-1] > y[-2]) != has(COST, t.metric)
    title = f"Last year had the same {word}: dig into {lead['label']} only if something changed there" if season else f"Find out what worked in {lead['label']}" if good else f"Find out why {lead['label']} changed and act on it"
    return [Advice("change", ("change", dim, lead["label"]), abs(y[-1] - y[-2]) / max(sum(y) / len(y), 1e-9) * (0.4 if season else 1), title, f"{lead['label']}: {lead['before']:,.0f} to {lead['after']:,.0f}; in all {_percent(raw)}, {_percent(alike)} per day.")]


def r_trend(t: Table) -> list[Advice]:
    series = periods.trimmed(t.days(mega=False), "day", "v", "sum", t.grain).orderBy("period").collect() if t.mega else t.series
    got = windows_of([r["y"] for r in series], t.grain)
    if not got or abs(got[0] / got[1] - 1) < 0.05:
        return []
    change, up = got[0] / got[1] - 1, got[0] > got[1]
    if has(COST, t.metric):
        title = f"Costs press: {t.metric} is up {_percent(change)}" if up else f"Keep the saving: {t.metric} is down {_percent(-change)}"
    else:
        title = f"Prepare for growth: {t.metric} is up {_percent(change)}" if up else f"Stop the slide: {t.metric} is down {_percent(-change)}"
    return [Advice("trend", ("trend",), abs(change) * (1 if got[2] else 0.5), title, f"{got[0]:,.0f} against {got[1]:,.0f}, {'like for like' if got[2] else 'not adjusted for season'}.")]


def r_season(t: Table) -> list[Advice]:
    if t.grain != "MS" or len(t.series) < 18:
        return []
    index = {r["month"]: r["index"] for r in season_index(t.days(mega=False), "day", "v").where("index is not null").collect()}
    peak, out = {m for m, x in index.items() if x >= 1.3}, []
    run = month_run(peak) if peak else None
    if run:
        share = sum(index[m] for m in peak) / sum(index.values())
        name = MONTHS[run[0] - 1] + (f"-{MONTHS[run[-1] - 1]}" if len(run) > 1 else "")
        out.append(Advice("season", ("season", "overall"), 1.5 * (share - len(peak) / 12), f"Plan around the busy season {name}", f"It brings {_percent(share)} of a typical year."))
    best = None
    for dim in t.dims():
        sums = t.sums(dim, mega=False)
        total = sum(v for _, v in sums)
        rates = t.of(dim, mega=False)
        rates = rates[rates["period"].notna()]
        by_month = rates.groupby(["label", [p.month for p in rates["period"]]])["v"].sum()
        for label, value in sums:
            own = {m: float(v) for m, v in by_month.get(label, {}).items()}
            mean = sum(own.values()) / 12
            if total <= 0 or value < 0.1 * total or mean <= 0:
                continue
            high = {m for m, v in own.items() if v / mean >= 1.3 and v / mean >= 1.15 * index.get(m, 1)}
            months = month_run(high) if 2 <= len(high) <= 5 else None
            if months and len(high & peak) < 0.6 * len(high | peak):
                score = (max(own.values()) / mean - 1) * value / total
                if best is None or score > best[0]:
                    best = score, dim, label, months
    if best:
        out.append(Advice("season", ("season", best[1], best[2]), 0.6 * best[0], f"{best[2]} has a season of its own: {MONTHS[best[3][0] - 1]}-{MONTHS[best[3][-1] - 1]}", f"Its months differ from the whole by {best[1]}."))
    return out


def r_stock(t: Table) -> list[Advice]:
    unique = {s["name"]: s["unique"] for s in t.found["columns"]}
    stock = next((c for c in t.found["metrics"] if has(STOCK, c)), None)
    flow = next((c for c in t.found["metrics"] if c != stock and has(FLOW, c) and c not in t.found["means"]), None)
    dims = [c for c in t.dims() if unique[c] <= 15]
    if not (stock and flow and dims):
        return []
    dim = max(dims, key=unique.get)
    rows = stock_cover(t.df, t.date, dim, stock, flow).collect()
    if not rows:
        return []
    months = {(r["s"], r["m"]): r["v"] for r in t.df.groupBy(F.col(dim).alias("s"), F.month(t.date).alias("m")).agg(F.sum(flow).alias("v")).collect()} if t.grain == "MS" and len(t.series) >= 12 else {}
    now = t.series[-1]["period"].month if t.series else 1

    def stressed(r) -> float:
        """Cover at the segment's own highest month of the next six."""
        base = months.get((r["label"], now)) or 0
        later = [months.get((r["label"], (now - 1 + i) % 12 + 1)) or 0 for i in range(1, 7)]
        return r["cover"] / (max(1.0, max(later) / base) if base > 0 else 1.0)

    thin = min(rows, key=lambda r: (stressed(r), str(r["label"])))
    usual = sorted(r["cover"] for r in rows)[len(rows) // 2]
    if stressed(thin) > 3 and thin["cover"] > 0.8 * usual:
        return []
    return [Advice("stock", ("stock", str(thin["label"])), 0.12 + (6 - min(stressed(thin), 6)) / 30, f"Reorder {thin['label']} first: stock for {thin['cover']:.1f} periods", f"{thin['stock']:,.0f} left, {thin['outflow']:,.0f} go per period; usual cover {usual:.1f}.")]


def r_status(t: Table) -> list[Advice]:
    out = []
    for c in t.found["dims"]:
        if not has(STATUS_NAME, c):
            continue
        sums = t.sums(c)
        total = sum(v for _, v in sums)
        kinds = {k: "owed" if has(OWED, k) else "lost" if has(BAD, k) else "" for k, _ in sums}
        for kind, title in (("owed", "Collect what is not settled"), ("lost", "Find out why this is lost")):
            part = [(k, v) for k, v in sums if kinds[k] == kind]
            share = sum(v for _, v in part) / total if part and total > 0 else 0
            if share >= 0.03:
                names = ", ".join(sorted(k for k, _ in part))
                out.append(Advice("status", ("status", c, kind), share, f"{title}: {_percent(share)} is {names}", f"By {c}."))
    return out


def r_refund(t: Table) -> list[Advice]:
    own = t.cells[t.cells["dimension"] == ""]
    n, lost = int(own["lost_n"].sum()), float(own["lost"].sum())
    gross = float(own["v"].sum()) - lost
    if n < 3 or gross <= 0 or -lost / gross < 0.03:
        return []
    return [Advice("refund", ("refund",), -lost / gross, f"Cut refunds: {_percent(-lost / gross)} of gross {t.metric} goes back", f"{n} records, {lost:,.0f}.")]


def r_costline(t: Table) -> list[Advice]:
    if not has(COST, t.metric):
        return []
    best = None
    for dim in t.dims():
        sums = t.sums(dim)
        if len(sums) >= 5 and sums[-1][1] > 0:
            share = sum(v for _, v in sums[:3]) / sum(v for _, v in sums)
            if share >= 0.5 and (best is None or share > best[0]):
                best = share, dim, [k for k, _ in sums[:3]]
    return [Advice("costline", ("costline", best[1]), 0.5 * best[0], f"Start saving with {', '.join(best[2])}: {_percent(best[0])} of {t.metric}", f"The three largest by {best[1]}.")] if best else []


def r_dow(t: Table) -> list[Advice]:
    rows = weekday_index(t.daily, "day", "v").collect()
    if not rows or rows[0]["days"] < 56 or rows[0]["active"] < 0.5:
        return []
    high = sorted((r for r in rows if r["index"] is not None and r["index"] >= 1.15 and r["above"] >= 0.7), key=lambda r: r["weekday"])
    if not high:
        return []
    return [Advice("season", ("dow",), 0.5 * (sum(r["index"] for r in high) / len(high) - 1), f"Staff for {', '.join(DAYS[r['weekday']] for r in high)}", "Above their own week's mean in 70 % of the weeks or more.")]


def r_segment(t: Table) -> list[Advice]:
    out = []
    for dim in t.dims():
        for mega in (True, False) if t.mega else (True,):
            sums = t.sums(dim, mega)
            total = sum(v for _, v in sums)
            if not sums or sums[-1][1] < 0 or total <= 0 or sums[0][1] / total <= max(0.5, 2.5 / len(sums)):
                break
        else:
            out.append(Advice("segment", ("seg", dim, sums[0][0]), 0.6 * sums[0][1] / total, f"Depend less on {sums[0][0]}: {_percent(sums[0][1] / total)} of {t.metric}", f"By {dim}."))
    return out


def r_anomaly(t: Table) -> list[Advice]:
    total = sum(v for v in t.cells.loc[t.cells["dimension"] == "", "v"] if not pd.isna(v))
    days = [r for r in findings.daily_anomalies(t.daily, "day", "v").collect() if abs(r["y"] - r["expected"]) >= 0.01 * total and r["expected"] >= 0.02 * r["y"]]
    return [Advice("anomaly", ("anomaly",), 0.05 * len(days), f"Confirm {len(days)} unusual days", "; ".join(f"{r['day']}: {r['y']:,.0f}, expected {r['expected']:,.0f}" for r in days))] if days else []


def r_quality(t: Table) -> list[Advice]:
    out = [Advice("quality", ("quality", s["name"]), 0.8 * s["missing_pct"] / 100, f"Fill in {s['name']}: blank in {s['missing_pct']} %", "Comparisons leave these rows out.") for s in t.found["columns"] if s["name"] in t.found["dims"] and 5 <= s["missing_pct"] < 100]
    for s in t.found["columns"]:
        if s["name"] in t.found["dims"] and s["type"] == "string":
            own = t.of(s["name"]).groupby("label")["rows"].sum()
            groups: dict[str, list[tuple[int, str]]] = {}
            for raw, n in own.items():
                groups.setdefault(raw.strip(" ").lower(), []).append((-int(n), raw))
            several = sorted((sum(n for n, _ in g), key, g) for key, g in groups.items() if len(g) > 1)
            if several:
                out.append(Advice("quality", ("quality", s["name"], "labels"), 0.05, f"Use one spelling in {s['name']}", " / ".join(sorted(raw for _, raw in sorted(several[0][2])[:3]))))
    repeated = repeated_rows(t.df, t.found)
    return [*out, Advice("quality", ("quality", "dups"), 0.01, f"{repeated} rows are exact duplicates", "Totals count them twice.")] if repeated else out


RULES: tuple[tuple[Callable[[Table], list[Advice]], bool, bool], ...] = (
    # rule, needs a date, needs 30 rows
    (r_entity, False, False), (r_change, True, True), (r_trend, True, True), (r_season, True, True), (r_stock, True, True), (r_status, False, False),
    (r_refund, False, False), (r_costline, False, False), (r_dow, True, True), (r_segment, False, True), (r_anomaly, True, True), (r_quality, False, False),
)


def ranked(items: list[Advice], most: int = 6) -> list[Advice]:
    """The best items: one per key, three per kind (two quality, one segment, one anomaly), two per segment value."""
    best: dict[tuple, Advice] = {}
    for x in items:
        if x.key not in best or x.score > best[x.key].score:
            best[x.key] = x
    out: list[Advice] = []
    for x in sorted(best.values(), key=lambda x: (-x.score, x.key)):
        same = [y for y in out if y.key[0] in ("seg", "change") and x.key[0] in ("seg", "change") and y.key[-1] == x.key[-1]]
        if len(out) < most and sum(y.kind == x.kind for y in out) < MOST.get(x.kind, 3) and len(same) < 2:
            out.append(x)
    return out


def recommend(df: DataFrame, found: dict) -> list[Advice]:
    """At most six items, best first; none for averages; one for scores and balances, whose totals mean nothing."""
    metric = found["metric"]
    if not metric or metric in found["means"]:
        return []
    if has(NOT_ADDITIVE, metric) or has(LEVEL, metric):
        return [Advice("quality", ("metric",), 1.0, f"Choose another measure: totals of {metric} mean nothing", "It is a score, rate or balance by its name.")]
    table = table_of(df, found)
    items = [x for rule, dated, large in RULES if (table.grain or not dated) and (found["rows"] >= 30 or not large) for x in rule(table)]
    return ranked(items)
