"""Starter charts, previews, JSON and CSV rows, and scoring of results."""

import datetime
import json

from tallyweir.operators import roles
from tallyweir.plans import outputs

DAY = datetime.datetime(2024, 1, 1)


def test_charts_of_other_tables(spark):
    rows = [(f"c{i % 30}", ["a", "b"][i % 2], float(i % 9) + 1) for i in range(120)]
    df = spark.createDataFrame(rows, "customer string, kind string, amount double")
    got = outputs.starter_charts(df, roles.roles(df)).collect()
    assert {(r["chart"], r["kind"]) for r in got} >= {(1, "bar")} and not [r for r in got if r["kind"] == "line"]
    top = [r for r in got if r["title"].startswith("Top customer")]
    assert len(top) == 8 and [r["y"] for r in top] == sorted((r["y"] for r in top), reverse=True)
    assert sum(r["y"] for r in got if r["kind"] == "hist") == 120
    assert outputs.starter_charts(df.drop("amount"), roles.roles(df.drop("amount"))).count() == 0
    assert outputs.starter_charts(df.limit(0), roles.roles(df.limit(0))).count() == 0


def test_preview_and_json(spark):
    rows = [(i, float("nan") if i == 1 else float("inf") if i == 2 else i / 2, DAY if i else None, i % 2 == 0, None if i == 3 else "x\"y") for i in range(20)]
    df = spark.createDataFrame(rows, "at int, `a.b` double, t timestamp, flag boolean, s string")
    got = outputs.preview(df, row_id="at")
    assert got["columns"] == ["a.b", "t", "flag", "s"] and got["dtypes"] == ["double", "timestamp", "boolean", "string"] and (got["total_rows"], got["total_cols"], len(got["rows"])) == (20, 4, 15)
    assert [json.loads(r) for r in got["rows"][:4]] == [{"a.b": 0.0, "t": None, "flag": True, "s": 'x"y'}, {"a.b": None, "t": "2024-01-01T00:00:00", "flag": False, "s": 'x"y'}, {"a.b": None, "t": "2024-01-01T00:00:00", "flag": True, "s": 'x"y'}, {"a.b": 1.5, "t": "2024-01-01T00:00:00", "flag": False, "s": None}]
    assert outputs.preview(df.limit(0))["rows"] == []


def test_csv_head(spark):
    df = spark.createDataFrame([(1, 1 / 3, 'a "b", c'), (2, None, None)], "n int, x double, t string")
    assert outputs.csv_head(df.orderBy("n")) == 'n,x,t\n1,0.3333333333,"a ""b"", c"\n2,,\n'
    assert outputs.csv_head(spark.range(50)).count("\n") == 21


def test_answers():
    yes = [(34.6, [(0.346,)]), (0.346, [("share", 34.6)]), (100, [(100.4,)]), ("Hat", [("Hat", 3)]), ("2025-12", [(datetime.datetime(2025, 12, 1), 5)]), ("Hat", [("Hat", 3), ("Sock", 1)]), ({"a": 1.0, "b": 2}, [("a", 1.001), ("b", 2)])]
    no = [(34.6, [(35.6,)]), (3, [(3,), (3,)]), (1, [(True,)]), ("Hat", [("Sock", 3), ("Hat", 1)]), ("Hat", []), ({"a": 1.0}, [("a", 1.0), ("b", 2)]), ({"a": 1.0}, [("a", 1.2)])]
    assert all(outputs.answers(t, r) for t, r in yes) and not any(outputs.answers(t, r) for t, r in no)
