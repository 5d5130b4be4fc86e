"""The roles of a table's columns: what to measure, by which date, split by what.

Statistics of all columns come from one aggregation each over the whole table;
the rules that follow see one small record per column.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.inference import CODE_NAME
from tallyweir.operators.findings import duplicate_rows, profile_numbers
from tallyweir.operators.quantiles import exact_quantiles

# Fixed patterns of column names.
METRIC = r"amount|sales|revenue|total|donat|expens|cost|profit|qty|quantity|units|price|balance|spend|value|volume|score|rate"
STRONG = r"amount|revenue|sales|total|donat|expens|cost|profit|spend|volume"
VOLUME = r"visit|view|session|signup|sign_up|registration|appointment|attendance|booking|order|download|ticket|hours|yield|units|quantity|qty|count|volume|weight|kg|tonne|sold|shipped|donation|amount|revenue|sales|total|income|profit|spend|expens|cost|fee|paid|collected|balance"
SCORE = r"score|rating|satisf|quality|q\d"
HAPPENED = r"paid|collected|received|actual|net"
PLANNED = r"(^|_)(due|target|budget|budgeted|planned|expected|quota|goal)(_|$)"
CALENDAR = r"^(year|yr|month|mon|day|dow|weekday|week|quarter|qtr|hour|minute|fy|period)$"
STATUS = r"status|state|stage|paid|flag|active|promo|received|sent"
ENTITY = r"(^|_)(name|customer|client|donor|member|student|supplier|vendor|patient|employee|account|payer|contact)(_|$)"
DATE_STRONG = r"order|trans|invoice|sale|event|created|purchase|bill|payment|record|activity|checkout|revenue|entry"
DATE_HINT = r"date|time|day|month|period|timestamp|dt"
DATE_AVOID = r"birth|dob|born|expir|delet|cancel|valid_until"
RECORD_ID = r"(^|_)(id|invoice|order|receipt|ref|reference|transaction|txn|ticket|booking)(_|$)"
COST = r"cost|expens|spend|refund|loss|churn|debt|complaint|defect|return|waste|cancel|overdue|debit|payable|outstanding|unpaid|pending|absent|dropout|no_?show|late"
# Fixed value: words in a name whose measure is averaged, not summed.
MEAN_WORDS = frozenset({"price", "rate", "score", "age", "temp", "temperature", "ratio", "avg", "average", "pct", "percent", "percentage", "unit"})

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
_WHOLE = ("int", "bigint", "smallint", "tinyint")


def has(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.I) is not None


def with_records(df: DataFrame) -> DataFrame:
    """Adds ``records`` = 1 if the table has a date and no such column, so that rows can be counted."""
    dated = any(kind in ("date", "timestamp", "timestamp_ntz") for _, kind in df.dtypes)
    return df.withColumn("records", F.lit(1)) if dated and "records" not in df.columns else df


def column_stats(df: DataFrame) -> list[dict]:
    """(name, type, kind, n, missing_pct, unique, least, most, small, whole, small_unique) of every column, by one aggregation.

    Kinds: date, numeric, category (up to 30 or 5 % different values, and yes/no), text.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(df.dtypes):
        x = F.col(f"`{c}`")
        numeric = kind in _NUMERIC or kind.startswith("decimal")
        v = x.cast("double") if numeric else F.lit(None).cast("double")
        inside = F.when(v.between(0, 11), v)
        # lists, maps and records are compared by their JSON text
        plain = x if not kind.startswith(("map", "struct", "array")) else F.to_json(F.struct(x))
        text = lambda f, x=x, kind=kind: f(x).cast("string") if kind in ("date", "timestamp", "timestamp_ntz") else F.lit(None).cast("string")
        aggs.append(
            F.struct(
                F.count(x).alias("n"),
                F.count_distinct(plain).alias("unique"),
                F.min(v).alias("least"),
                F.max(v).alias("most"),
                F.count(inside).alias("small"),
                F.count_if(inside == F.round(inside)).alias("whole"),
                (F.count_distinct(inside) if numeric else F.lit(0)).alias("small_unique"),
                text(F.min).alias("first"),
                text(F.max).alias("last"),
            ).alias(f"c{i}")
        )
    got = df.agg(*aggs).first()
    out = []
    for i, (c, kind) in enumerate(df.dtypes):
        s = got[f"c{i}"].asDict()
        if kind in ("date", "timestamp", "timestamp_ntz"):
            role = "date"
        elif kind in _NUMERIC or kind.startswith("decimal"):
            role = "numeric"
        else:
            role = "category" if kind == "boolean" or s["unique"] <= max(30, 0.05 * got["rows"]) else "text"
        out.append({"name": c, "type": kind, "kind": role, "rows": got["rows"], "missing_pct": round(100 * (1 - s["n"] / got["rows"]), 1) if got["rows"] else 0.0, **s})
    return out


def rating_like(s: dict) -> bool:
    """A scale of 3 to 11 whole numbers within 0..11, for 95 % of at least 10 values; names of amounts are not scales."""
    if s["n"] < 10 or (has(VOLUME, s["name"]) and not has(SCORE, s["name"])):
        return False
    return s["small"] >= 0.95 * s["n"] and s["whole"] == s["small"] and 3 <= s["small_unique"] <= 11


def is_mean(s: dict) -> bool:
    """Whether a measure is averaged: by a word of its name, as a rating, or as shares within 0..1."""
    return bool(MEAN_WORDS & set(re.split(r"[^a-z0-9]+", s["name"].lower()))) or rating_like(s) or (s["n"] > 0 and s["least"] >= 0 and s["most"] <= 1 and s["unique"] > 2)


def counts_up(df: DataFrame, column: str, row_id: str) -> bool:
    """Whether a column grows by exactly 1 from row to row.

    Equal differences to ``row_id`` say the same without a sort if ids have no gap.
    """
    lo, hi, least, most, n = df.agg(F.min(F.col(column) - F.col(row_id)), F.max(F.col(column) - F.col(row_id)), F.min(row_id), F.max(row_id), F.count(column)).first()
    return bool(n) and lo == hi and most - least + 1 == n


def metric_rank(s: dict) -> int:
    """Lower is better: money and volumes before prices and scores, what happened before what was planned."""
    name, rank = s["name"], 0
    for pattern, points in ((STRONG, -10), (VOLUME, -6), (METRIC, -2), (HAPPENED, -3), (PLANNED, 3)):
        rank += points if has(pattern, name) else 0
    if name == "records":
        return rank + 5
    return rank + ((4 if rating_like(s) else 20) if is_mean(s) else 0)


def date_rank(name: str) -> int:
    return -sum(points for pattern, points in ((DATE_STRONG, 10), (DATE_HINT, 5), (DATE_AVOID, -10)) if has(pattern, name))


def roles(df: DataFrame, metric: str | None = None, date: str | None = None, row_id: str | None = None) -> dict:
    """Roles of all columns: measures, dates, dimensions in order, entity, and the choice of the main ones.

    ``metric`` and ``date`` overrule the choice; ValueError if they cannot serve.
    """
    df = with_records(df)
    stats = column_stats(df.drop(row_id) if row_id else df)
    for s in stats:
        s["id_like"] = s["kind"] == "numeric" and has(CODE_NAME, s["name"])
        if s["kind"] == "numeric" and not s["id_like"] and not has(METRIC, s["name"]) and s["type"] in _WHOLE and s["rows"] >= 10 and s["unique"] == s["rows"]:
            s["id_like"] = counts_up(df, s["name"], row_id) if row_id else s["most"] - s["least"] + 1 == s["rows"]
        s["rating"], s["mean"] = s["kind"] == "numeric" and rating_like(s), s["kind"] == "numeric" and is_mean(s)
    measures = [s for s in stats if s["kind"] == "numeric" and not s["id_like"] and not has(CALENDAR, s["name"])]
    dates = sorted((s["name"] for s in stats if s["kind"] == "date"), key=date_rank)
    dims = sorted((s for s in stats if s["kind"] == "category" and 2 <= s["unique"] <= 50), key=lambda s: (has(STATUS, s["name"]), s["unique"] < 3, abs(math.log(s["unique"] / 8))))
    rows = stats[0]["rows"] if stats else 0
    entities = sorted((s for s in stats if s["kind"] in ("text", "category") and has(ENTITY, s["name"]) and 15 <= s["unique"] <= 0.8 * rows), key=lambda s: s["unique"])
    names = [s["name"] for s in measures]
    if metric is not None and metric not in names:
        raise ValueError(f"{metric} cannot be the measure")
    if date is not None and date not in dates:
        raise ValueError(f"{date} cannot be the date")
    return {
        "rows": rows,
        "columns": stats,
        "metrics": names,
        "dates": dates,
        "dims": [s["name"] for s in dims],
        "entity": entities[0]["name"] if entities else None,
        "metric": metric or (min(measures, key=metric_rank)["name"] if measures else None),
        "date": date or (dates[0] if dates else None),
        "means": {s["name"] for s in measures if s["mean"]},
        "ratings": {s["name"] for s in measures if s["rating"]},
    }


def role_table(df: DataFrame) -> DataFrame:
    """(name, kind, missing_pct, uniques, role): one row per column."""
    found = roles(df)
    named = {**dict.fromkeys(found["dims"], "dimension"), **dict.fromkeys(found["metrics"], "measure"), **dict.fromkeys(found["dates"], "date"), found["entity"]: "entity"}
    rows = [(s["name"], s["kind"], float(s["missing_pct"]), s["unique"], "code" if s["id_like"] else named.get(s["name"], "")) for s in found["columns"] if s["name"] in df.columns]
    return df.sparkSession.createDataFrame(rows, "name string, kind string, missing_pct double, uniques bigint, role string")


def common_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(value, n): the k most frequent values, ties to the smaller text."""
    x = F.col(f"`{column}`").cast("string")
    return df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def spelling_groups(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """(key, spellings, n): labels written in several ways, the k with most rows; at most 3 spellings are shown."""
    x = F.col(f"`{column}`")
    own = df.where(x.isNotNull()).groupBy(F.lower(F.trim(x)).alias("key"), x.alias("raw")).agg(F.count("*").alias("n"))
    # ranked before they are gathered, so that a group is never collected whole
    ranked = own.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "raw")))
    made = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("i") <= 3, F.col("raw")))).alias("spellings"), F.sum("n").alias("n"), F.count("*").alias("c"))
    return made.where("c > 1").select("key", "spellings", "n").orderBy(F.desc("n"), "key").limit(k)


def outlier_examples(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(value, share): the k largest values by size outside three interquartile ranges, and the share all outliers hold."""
    x = F.col(f"`{column}`").cast("double")
    spread = exact_quantiles(df, [column], [0.25, 0.5, 0.75, 0.99])[column]
    (q1, mid, q3, p99), least = spread.quantiles, spread.least
    none = df.select(x.alias("value"), F.lit(None).cast("double").alias("share")).limit(0)
    if q1 is None:
        return none
    logs = least > 0 and mid > 0 and p99 / mid > 8
    low, high, scaled = (math.log10(q1), math.log10(q3), F.log10(x)) if logs else (q1, q3, x)
    if high <= low:
        return none
    out = df.where((scaled < low - 3 * (high - low)) | (scaled > high + 3 * (high - low))).select(x.alias("value"))
    held, total = df.agg(F.sum(F.when((scaled < low - 3 * (high - low)) | (scaled > high + 3 * (high - low)), x)), F.sum(x)).first()
    share = held / total if held is not None and least >= 0 and total > 0 else None
    return out.orderBy(F.abs("value").desc(), "value").limit(k).withColumn("share", F.lit(share).cast("double"))


def kpis(df: DataFrame, metric: str, date: str | None, mean: bool = False) -> DataFrame:
    """(label, value, delta_pct, note): rows, total or mean, and the latest and the best full period."""
    from tallyweir.operators.periods import grain_of, trimmed

    first = df.agg(F.count("*"), (F.avg if mean else F.sum)(metric)).first()
    rows = [("rows", float(first[0]), None, None), ("average" if mean else "total", None if first[1] is None else float(first[1]), None, None)]
    valued = df.where(F.col(metric).isNotNull())
    grain = grain_of(valued, date) if date else None
    if grain:
        series = trimmed(valued, date, metric, "mean" if mean else "sum", grain)
        last = series.orderBy(F.desc("period")).limit(2).collect()
        if len(last) == 2 and last[1]["y"]:
            rows.append(("latest period", last[0]["y"], 100 * (last[0]["y"] - last[1]["y"]) / abs(last[1]["y"]), str(last[0]["period"])))
        best = series.agg(F.max_by(F.struct("period", "y"), F.struct("y", -F.unix_date("period"))).alias("b")).first()["b"]
        if best is not None:
            rows.append(("best period", best["y"], None, str(best["period"])))
    return df.sparkSession.createDataFrame(rows, "label string, value double, delta_pct double, note string")


def questions(found: dict) -> list[str]:
    """Questions that suit the table's roles."""
    m, out = found["metric"], []
    if not m:
        return out
    if found["dims"]:
        out += [f"Which {found['dims'][0]} has the highest {m}?", f"What share of {m} does each {found['dims'][0]} hold?"]
    if found["date"]:
        out += [f"How did {m} develop by month?", f"Which month had the highest {m}?"]
    if found["entity"]:
        out.append(f"Who are the top 5 by {found['entity']}?")
    return out


def repeated_rows(df: DataFrame, found: dict) -> int:
    """Exact duplicates, where a record number makes them suspect: 2 or more, and half a percent of the rows; else 0."""
    numbered = any(has(RECORD_ID, s["name"]) and s["kind"] != "date" and s["n"] and s["unique"] >= 0.9 * s["n"] for s in found["columns"])
    n = duplicate_rows(df).first()["n"] if numbered else 0
    return n if n >= 2 and n >= 0.005 * found["rows"] else 0


def quality_notes(df: DataFrame, found: dict) -> list[str]:
    """Notes on blank key columns, repeated rows where a record number exists, unusual values and spellings."""
    notes = [f"{s['name']} is blank in {s['missing_pct']} % of the rows" for s in found["columns"] if s["missing_pct"] > 20 and s["name"] in {found["metric"], found["date"], *found["dims"]}]
    repeated = repeated_rows(df, found)
    if repeated:
        notes.append(f"{repeated} rows are exact duplicates")
    if found["metric"] and found["metric"] in df.columns:
        n = profile_numbers(df, [found["metric"]]).first()["outliers"]
        if n:
            notes.append(f"{n} unusual values of {found['metric']}")
    return notes
