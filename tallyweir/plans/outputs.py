"""What a reader gets to see first: starter charts, a preview, JSON and CSV of rows, and whether two results agree."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators import findings, periods
from tallyweir.operators.prepare import UNIT
from tallyweir.operators.recommend import table_of

CHART = "chart int, title string, kind string, place int, x string, y double"
#: Bars of a chart, rows of a preview and of a CSV head.
BARS, PREVIEW, HEAD = 8, 15, 20
#: Relative difference that two numbers may have.
SLACK = 0.005


def starter_charts(df: DataFrame, found: dict) -> DataFrame:
    """(chart, title, kind, place, x, y): the charts a table with these roles starts with, a row for each point.

    The measure by period, by the first two dimensions and by entity (the BARS
    largest), and its histogram. Means stay means. A chart without points is
    left out; a table without a measure has none. All are small.
    """
    metric, spark = found["metric"], df.sparkSession
    if metric is None:
        return spark.createDataFrame([], CHART)
    mean = metric in found["means"]
    charts: list[tuple[str, str, list[tuple[str, float]]]] = []
    table = table_of(df, found)
    if table.grain:
        series = periods.trimmed(df, table.date, metric, "mean", table.grain).orderBy("period").collect() if mean else table.series
        if len(series) > 1:
            charts.append((f"{metric} by {UNIT[table.grain]}", "line", [(str(r["period"]), r["y"]) for r in series]))
    for name, title in [*[(d, f"{metric} by {d}") for d in found["dims"][:2]], *[(e, f"Top {e} by {metric}") for e in [found["entity"]] if e]]:
        rows = findings.top_groups(df, f"`{name}`", f"`{metric}`", "mean" if mean else "sum", BARS).collect()
        charts.append((title, "bar", [(str(r["label"]), float(r["value"])) for r in rows if r["value"] is not None]))
    bins = findings.histogram(df, metric).orderBy("bin").collect()
    charts.append((f"How {metric} is spread", "hist", [(f"{r['lo']:,.4g} to {r['hi']:,.4g}", float(r["n"])) for r in bins]))
    shown = [c for c in charts if c[2]]
    return spark.createDataFrame([(i + 1, title, kind, j + 1, x, y) for i, (title, kind, points) in enumerate(shown) for j, (x, y) in enumerate(points)], CHART)


def json_rows(df: DataFrame) -> DataFrame:
    """(row): each row as JSON text; numbers that are not finite are null, times are ISO 8601, nulls are kept."""
    cells = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        elif kind.startswith("decimal"):
            x = x.cast("double")
        cells.append(x.alias(c))
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return df.select(F.to_json(F.struct(*cells), options).alias("row")) if cells else df.select(F.lit("{}").alias("row"))


def preview(df: DataFrame, n: int = PREVIEW, row_id: str | None = None) -> dict:
    """Columns, their types, the first ``n`` rows as JSON texts (by ``row_id``, if the order is known) and the table's size."""
    shown = df.drop(row_id) if row_id else df
    first = df.orderBy(row_id).limit(n).drop(row_id) if row_id else df.limit(n)
    return {"columns": shown.columns, "dtypes": [kind for _, kind in shown.dtypes], "rows": [r["row"] for r in json_rows(first).collect()], "total_rows": df.count(), "total_cols": len(shown.columns)}


def csv_head(df: DataFrame, n: int = HEAD) -> str:
    """The first ``n`` rows as CSV with a header; numbers with at most ten digits."""

    def cell(x: object) -> str:
        if x is None:
            return ""
        text = f"{x:.10g}" if isinstance(x, float) else str(x)
        return '"' + text.replace('"', '""') + '"' if re.search(r'[",\r\n]', text) else text

    lines = [",".join(map(cell, df.columns)), *[",".join(map(cell, r)) for r in df.limit(n).collect()]]
    return "\n".join(lines) + "\n"


def _near(x: float, want: float, scales: tuple[float, ...] = (1.0,)) -> bool:
    return any(math.isclose(x * k, want, rel_tol=SLACK, abs_tol=1e-9) for k in scales)


def _numbers(row: Sequence) -> list[float]:
    return [float(x) for x in row if isinstance(x, (int, float)) and not isinstance(x, bool)]


def _named(cell: object, want: str) -> bool:
    """The text itself, or a date that begins with it: ``2025-12`` names the first of December."""
    text = str(cell)
    return text == want or re.match(r"\d{4}-\d\d", text) is not None and text.startswith(want)


def answers(truth: float | str | dict, rows: Sequence[Sequence]) -> bool:
    """Whether the rows of a result give ``truth``.

    A number must be in the only row, as it is or as a share instead of a
    percentage and the reverse; a text anywhere in the only row, or first in the
    first of several; a table {label: number} must have the same labels and
    numbers, one number a row. Numbers may differ by SLACK.
    """
    if not rows:
        return False
    if isinstance(truth, dict):
        found = {str(next(x for x in r if isinstance(x, bool) or not isinstance(x, (int, float)))): _numbers(r)[0] for r in rows if len(_numbers(r)) == 1 and len(r) > 1}
        return found.keys() == truth.keys() and all(_near(found[k], truth[k]) for k in truth)
    if isinstance(truth, str):
        return any(_named(x, truth) for x in rows[0]) if len(rows) == 1 else _named(rows[0][0], truth)
    return len(rows) == 1 and any(_near(x, truth, (1.0, 100.0, 0.01)) for x in _numbers(rows[0]))
