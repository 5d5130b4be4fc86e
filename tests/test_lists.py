"""The findings list, prepared series, and types of written dates, against plain Python."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweir.functions import cleaning, inference
from tallyweir.operators import fitted, insights, prepare, recommend, roles
from tallyweir.operators.insights import Finding
from tallyweir.plans import ingest

DAY = datetime.datetime(2023, 1, 1)


def shop(change=1.0, spike=1.0, days=730):
    rng, rows = np.random.default_rng(4), []
    for i in range(days):
        day = DAY + datetime.timedelta(days=i)
        for k, region in enumerate(("north", "south", "west")):
            level = 100.0 + 10 * rng.random()
            level *= change if region == "south" and i >= days - 91 else 1.0
            level *= spike if i == 400 else 1.0
            rows.append((day, f"c{(3 * i + k) % 40}", region, level))
    return rows


SHOP = "order_date timestamp, customer string, region string, amount double"


def listed(df, **more):
    return insights.insights(df, roles.roles(df), **more).orderBy("rank").collect()


def test_findings(spark):
    found = listed(spark.createDataFrame(shop(change=0.3, spike=8.0), SHOP))
    said = [(r["kind"], r["severity"], r["subject"]) for r in found]
    assert ("anomaly", "warn", "2024-02-05") in said and ("driver", "warn", "region") in said
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 8
    keys = [(r["kind"] == "quality", insights.SEVERITY[r["severity"]], r["kind"] != "change") for r in found]
    assert keys == sorted(keys)
    moved = next(json.loads(r["evidence"]) for r in found if r["kind"] == "driver" and r["severity"] == "warn")
    assert moved["label"] == "south" and moved["change_pct"] < -60
    # nothing moves; only the short months stand out
    assert not [r for r in listed(spark.createDataFrame(shop(), SHOP)) if r["kind"] in ("driver", "trend") or r["kind"] == "anomaly" and "-02-" not in r["subject"]]


def test_findings_without_measure_date_or_rows(spark):
    assert listed(spark.createDataFrame([("a", "b")], "city string, note string")) == []
    assert listed(spark.createDataFrame([], SHOP)) == []
    undated = spark.createDataFrame([(f"p{i % 4}", float(i % 4 == 0) * 100 + 1) for i in range(80)], "item string, amount double")
    assert [(r["kind"], r["subject"]) for r in listed(undated)] == [("driver", "item")]
    sheets = listed(undated, notes={"sheet": "A", "sheets": 3})
    assert sheets[-1]["kind"] == "quality" and sheets[-1]["subject"] == "sheet"


def test_quality_findings(spark):
    rows = [(f"I{i // 2}", DAY + datetime.timedelta(days=i // 2), ["North", "north ", "South"][i % 2 if i % 3 else 2], float(i // 2 % 7) + 1) for i in range(200)]
    rows = [(a, b, "North", d) for a, b, _, d in rows[:120]] + rows[120:] + [("X1", None, "South", 9_000.0), ("X2", DAY, "North", -4.0), ("X3", DAY, "North", -4.0), ("X4", DAY, "North", -4.0)]
    df = spark.createDataFrame(rows, "invoice_no string, order_date timestamp, region string, amount double")
    found = {(r["subject"]): r for r in listed(df, most=50) if r["kind"] == "quality"}
    assert {"region", "amount", "negative"} <= set(found) and found["region"]["severity"] == "warn"
    records = json.loads(found["amount"]["evidence"])
    assert records["records"][0][-1] == "9000.0" and len(records["records"]) <= 10 and found["amount"]["severity"] == "info"


def test_order_of_findings():
    items = [Finding("quality", "warn", "q", "", "", ""), Finding("driver", "info", "d", "", "", ""), Finding("trend", "warn", "t", "", "", ""), Finding("change", "warn", "c", "", "", ""), Finding("anomaly", "warn", "a", "", "", ""), Finding("trend", "good", "g", "", "", "")]
    assert [x.subject for x in insights.ordered(items)] == ["c", "t", "a", "g", "d", "q"]
    assert len(insights.ordered(items * 3)) == 8


def test_cube_reads_the_table_three_times(spark):
    df = spark.createDataFrame(shop(), SHOP)
    found = roles.roles(df)
    reads = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    n = df.count()
    recommend.recommend(df.mapInPandas(count, SHOP), found)
    assert reads.value <= 4 * n  # the third pass, over entities, is held and read from there; one more for duplicates if a number suggests it


def test_totals_cube(spark):
    rows = shop(days=70) + [(None, "c1", "north", 5.0), (DAY, None, None, None), (DAY, "c2", "north", -7.0)]
    got = recommend.totals_cube(spark.createDataFrame(rows, SHOP), "amount", "order_date", ["region"]).toPandas()
    frame = pd.DataFrame(rows, columns=["d", "c", "region", "v"])
    assert got[got.dimension == ""].v.sum() == pytest.approx(frame.v.sum()) == got[got.dimension == "region"].v.sum()
    own = got[(got.dimension == "region") & (got.label == "north") & (got.period == datetime.date(2023, 1, 1))].iloc[0]
    want = frame[(frame.region == "north") & (frame.d.dt.to_period("M").astype(str) == "2023-01")]
    assert own.v == pytest.approx(want.v.sum()) and (own.n, own["rows"], own.lost, own.lost_n) == (want.v.count(), len(want), -7.0, 1)
    assert recommend.totals_cube(spark.createDataFrame([], SHOP), "amount", None, []).count() == 0


def _prepared(spark, rows, **more):
    ready, facts = prepare.prepare(spark.createDataFrame(rows, "s string, t timestamp, v double"), "s", "t", "v", **more)
    out = {}
    for r in ready.orderBy("i").collect():
        out.setdefault(r["s" if "s" in r else "series"], []).append((str(r["period"])[:16], round(r["y"], 6), r["filled"]))
    return out, {r["series"]: r for r in facts.collect()}


@pytest.mark.parametrize("merge", ["sum", "mean", "last", "max", "min"])
def test_prepared_merges(spark, merge):
    days = [DAY + datetime.timedelta(days=i) for i in range(20) if i not in (7, 8)]
    rows = [("a", d + datetime.timedelta(hours=h), float(d.day * (h + 1))) for d in days for h in (3, 9)] + [("a", days[0] - datetime.timedelta(days=2), None), ("a", days[-1] + datetime.timedelta(days=3), float("nan"))]
    got, facts = _prepared(spark, rows, merge=merge, frequency="D")
    frame = pd.DataFrame(rows, columns=["s", "t", "v"]).dropna().set_index("t")["v"]
    want = frame.resample("D").last() if merge == "last" else getattr(frame.resample("D"), merge)(**({"min_count": 1} if merge == "sum" else {}))
    filled = want.interpolate()
    assert got["a"] == [(str(t)[:16], round(filled[t], 6), bool(np.isnan(want[t]))) for t in filled.index]
    a = facts["a"]
    assert (a["status"], a["periods"], a["observed"], a["merged"], a["gaps"], a["cut"], a["odd"]) == ("ok", 20, 18, 18, 2, 3, 1)


@pytest.mark.parametrize("frequency", ["h", "D", "B", "W", "MS", "ME", "QS", "QE", "YS", "YE"])
def test_prepared_calendars(spark, frequency):
    times = list(pd.date_range("2021-03-01", periods=12, freq=frequency))
    rows = [("a", t.to_pydatetime(), float(i)) for i, t in enumerate(times) if i not in (4, 5, 9)]
    got, facts = _prepared(spark, rows, frequency=frequency)
    assert [x[0] for x in got["a"]] == [str(t)[:16] for t in times] and [x[1] for x in got["a"]] == [float(i) for i in range(12)]
    assert facts["a"]["gaps"] == 3 and facts["a"]["season"] == prepare.SEASON[frequency]


def test_prepared_refusals_and_uneven_series(spark):
    day = lambda i: DAY + datetime.timedelta(days=i)
    rows = [("few", day(i), 1.0) for i in range(7)] + [("blank", day(i), None) for i in range(9)] + [("long", day(30_000 * i), 1.0) for i in range(3)] + [("long", day(i), 1.0) for i in range(20)] + [("uneven", day(13 * i + i * i), float(i)) for i in range(9)] + [(None, day(i), float(i)) for i in range(9)] + [("undated", None, 1.0)]
    got, facts = _prepared(spark, rows)
    assert {k: r["reason"] for k, r in facts.items()} == {"few": "fewer than 8 periods with data", "blank": "the series has no usable value", "long": "more than 20000 periods", "uneven": "", None: ""}
    assert [x[1] for x in got["uneven"]] == [float(i) for i in range(9)] and facts["uneven"]["frequency"] is None and set(got) == {"uneven", None}
    assert _prepared(spark, [])[0] == {}
    for bad in ({"merge": "median"}, {"frequency": "SM"}):
        with pytest.raises(ValueError):
            _prepared(spark, rows, **bad)


def test_forecasts_of_raw_rows(spark):
    months = [t.to_pydatetime() for t in pd.date_range("2019-01-01", periods=60, freq="MS")]
    rows = [("m", t, float(50.0 + 20 * np.sin(2 * np.pi * i / 12))) for i, t in enumerate(months) if i != 30 for _ in range(2)]
    rows += [("w", DAY + datetime.timedelta(days=7 * i), 5.0 + i % 3) for i in range(30)] + [("few", DAY, 1.0), (None, DAY, 2.0)]
    got = fitted.forecast_series(spark.createDataFrame(rows, "s string, t timestamp, v double"), "s", "t", "v", 4).orderBy("series", "h").collect()
    m = [r for r in got if r["series"] == "m"]
    want = 2 * (50 + 20 * np.sin(2 * np.pi * np.arange(60, 64) / 12))
    assert [str(r["period"]) for r in m] == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"] and np.abs(np.array([r["y"] for r in m]) - want).mean() < 4
    assert m[0]["caveats"] == ["59 values shared a period", "1 periods were filled"] and m[0]["frequency"] == "MS"
    assert [str(r["period"]) for r in got if r["series"] == "w"] == [str((DAY + datetime.timedelta(days=7 * i)).date()) for i in range(30, 34)]
    assert {(r["series"], r["status"], r["reason"]) for r in got if r["status"] == "refused"} == {("few", "refused", "fewer than 8 periods with data"), (None, "refused", "fewer than 8 periods with data")}
    with pytest.raises(ValueError):
        fitted.forecast_series(spark.createDataFrame(rows, "s string, t timestamp, v double"), "s", "t", "v", 61)


def _typed(spark, columns):
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{n}` string" for n in names))
    got, kinds = inference.typed(df.withColumn("_at", F.monotonically_increasing_id()))
    return {n: [r[n] for r in got.orderBy("_at").select(*[f"`{n}`" for n in names]).toDF(*names).collect()] for n in names}, kinds


def test_dates_with_offsets_and_labels(spark):
    n = 24
    columns = {
        "one zone": [f"2025-01-{i + 1:02d}T06:00:00+05:30" for i in range(n)],
        "zones": [f"2025-03-{i + 1:02d}T00:30:00{'-0500' if i < 9 else '-04:00'}" for i in range(n)],
        "half zoned": [f"2025-03-{i + 1:02d}T00:30:00{'Z' if i % 2 else ''}" for i in range(n)],
        "label": [f"{m}-{y}" for y in (24, 25) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")],
        "wide label": [f"{m} {y}" for y in (24, 25) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "Sept", "October", "November", "December")],
        "order_date": [str(45292 + i) for i in range(n)],
        "timestamp": [str(1704067200 + 86400 * i) for i in range(n)],
        "time": [str(1000 * (1704067200 + 86400 * i)) for i in range(n)],
        "year": [str(2000 + i) for i in range(n)],
        "compact": [f"202401{i + 1:02d}" for i in range(n)],
        "month first": [f"01/{i + 1:02d}/2025" for i in range(n)],
        "short": [f"{i + 1:02d}-02-25" for i in range(n)],
        "dotted": [f"{i + 1}.3.2024" for i in range(n)],
    }
    got, kinds = _typed(spark, columns)
    assert set(kinds.values()) == {"date"}, kinds
    at = datetime.datetime
    assert got["one zone"][0] == at(2025, 1, 1, 6) and got["zones"][:1] + got["zones"][-1:] == [at(2025, 3, 1, 5, 30), at(2025, 3, 24, 4, 30)]
    assert got["half zoned"][:2] == [at(2025, 3, 1, 0, 30), at(2025, 3, 2, 0, 30)]
    assert got["label"][13] == got["wide label"][13] == at(2025, 2, 1) and got["wide label"][8] == at(2024, 9, 1)
    assert got["order_date"][1] == got["timestamp"][1] == got["time"][1] == got["compact"][1] == at(2024, 1, 2)
    assert got["year"][5] == at(2005, 1, 1) and got["month first"][14] == at(2025, 1, 15) and got["short"][2] == at(2025, 2, 3) and got["dotted"][9] == at(2024, 3, 10)


def test_few_values_come_from_a_table_of_them(spark, monkeypatch):
    columns = {"day": [f"{i % 9 + 1}/2/2024" if i % 5 else None for i in range(90)], "fee": [f"${i % 4},000.50" if i % 7 else "n/a" for i in range(90)], "kind": [["A", "a ", "b"][i % 3] for i in range(90)]}
    assert inference.MAP_ROWS >= 9
    few = _typed(spark, columns)
    monkeypatch.setattr(inference, "MAP_ROWS", 0)
    assert few == _typed(spark, columns) and few[1] == {"day": "date", "fee": "number", "kind": "text"}
    assert few[0]["fee"][:3] == [None, 1000.5, 2000.5]


@pytest.mark.parametrize("small", [True, False])
def test_spellings(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(inference, "MAP_ROWS", 0)
        monkeypatch.setattr(cleaning, "BROADCAST_ROWS", 0)
    rows = [("North", "x", "1"), ("north ", "x", "2"), ("North", None, "3"), ("SOUTH", "Y", "4"), ("south", "y", "5"), (None, "y", "6"), ("west", "y", "7")]
    df = spark.createDataFrame(rows, "`a.b` string, _raw string, n string")
    got, _ = ingest.cleaned(df)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[2]) == [("North", "x", 1.0), ("North", "x", 2.0), ("North", None, 3.0), ("SOUTH", "y", 4.0), ("SOUTH", "y", 5.0), (None, "y", 6.0), ("west", "y", 7.0)]
    one = cleaning.merge_spellings(df, "_raw")
    assert one.columns == df.columns and {r["_raw"] for r in one.collect()} == {"x", "y", None}
