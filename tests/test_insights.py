"""Type inference, workbooks, roles, recommendations, fitted forecasts and answer checks on small tables."""

import datetime
import zipfile

import numpy as np
import pytest

from tallyweir.functions import inference
from tallyweir.operators import fitted, recommend, roles
from tallyweir.plans import answers
from tallyweir.sources import excel

DAY = datetime.datetime(2024, 1, 1)


def test_types_by_whole_columns(spark):
    rows = [(str(45292 + i), f"{i + 1:02d}/01/2024", f"1.{i % 10}00,50", "yes" if i % 2 else "no", f"x{i}", f"00{i:03d}", "20240101", "2021") for i in range(20)]
    df, kinds = inference.typed(spark.createDataFrame(rows, "date string, day string, betrag string, paid string, name string, zip_code string, stamp string, yr string"))
    assert kinds == {"date": "date", "day": "date", "betrag": "number", "paid": "boolean", "name": "text", "zip_code": "text", "stamp": "date", "yr": "date"}
    first = df.orderBy("date").first()
    assert first["date"] == DAY and first["day"] == DAY and first["betrag"] == 1000.5 and first["paid"] is False


def test_types_of_empty_table(spark):
    df, kinds = inference.typed(spark.createDataFrame([], "a string, `b.c` string"))
    assert kinds == {"a": "text", "b.c": "text"} and df.count() == 0


def test_month_first_when_second_part_is_large(spark):
    df, kinds = inference.typed(spark.createDataFrame([("01/13/2025",), ("02/01/2025",)], "date string"))
    assert kinds == {"date": "date"} and {r[0].month for r in df.collect()} == {1, 2}


def test_total_lines(spark):
    rows = [(i, "a", 10.0) for i in range(40)] + [(40, "Grand total:", 400.0)]
    assert inference.without_total_lines(spark.createDataFrame(rows, "i int, item string, v double")).count() == 40
    rows = [(i, "a", float(i + 1)) for i in range(9)] + [(9, None, 45.0)]
    df = spark.createDataFrame(rows, "i int, item string, v double")
    assert inference.without_sum_row(df, "i").count() == 9
    assert inference.without_sum_row(df.where("i < 9"), "i").count() == 9
    assert inference.without_index_columns(df.withColumnRenamed("i", "row").withColumn("unnamed_0", roles.F.col("row").cast("string")), "row").columns == ["row", "item", "v"]


def workbook(path):
    cell = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f'<c r="{at}"><v>{x}</v></c>'
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    table = [["Report"], [], ["Date", "Item", "Net Sales"], *[[45292 + i, f"p{i}", 10.5 * i] for i in range(6)], ["Total", "", 157.5]]
    sheets = []
    for rows in ([["Cover"]], table):
        sheets.append(head + "".join(f'<row r="{i + 1}">' + "".join(cell(f"{'ABC'[j]}{i + 1}", x) for j, x in enumerate(r)) + "</row>" for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as out:
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        out.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="Cover" sheetId="1" r:id="r1"/><sheet name="Data" sheetId="2" r:id="r2"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        out.writestr("xl/worksheets/a.xml", sheets[0])
        out.writestr("xl/worksheets/b.xml", sheets[1])


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.csv")
    df, notes = excel.read_workbook(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["row_id", "date", "item", "net_sales"] and notes == {"sheet": "Data", "sheets": 2}
    got, kinds = inference.typed(df)
    assert got.count() == 6 and kinds == {"date": "date", "item": "text", "net_sales": "number"}
    with pytest.raises(ValueError):
        excel.is_workbook(b"\xd0\xcf\x11\xe0\xa1")


def orders(spark, n=720):
    rows = []
    for i in range(n):
        day = DAY + datetime.timedelta(days=i)
        amount = 100.0 * (3 if day.month == 12 else 1) * (2 if day.weekday() == 5 else 1)
        rows.append((day, f"c{i % 20}", ("north", "south", "west")[i % 3], "overdue" if i % 5 == 0 else "done", amount))
    rows.append((DAY + datetime.timedelta(days=100), "c1", "north", "done", 50000.0))
    return spark.createDataFrame(rows, "order_date timestamp, customer string, region string, status string, amount double")


def test_roles(spark):
    found = roles.roles(orders(spark))
    assert (found["metric"], found["date"], found["entity"], found["dims"]) == ("amount", "order_date", "customer", ["customer", "region", "status"])
    with pytest.raises(ValueError):
        roles.roles(orders(spark), metric="region")
    assert roles.roles(spark.createDataFrame([], "a string"))["metric"] is None
    scale = roles.roles(spark.createDataFrame([(i % 5 + 1, float(i)) for i in range(40)], "q1_quality int, fee_paid double"))
    assert scale["ratings"] == {"q1_quality"} and scale["metric"] == "fee_paid" and "q1_quality" in scale["means"]
    assert roles.questions(found) and roles.quality_notes(orders(spark), found) == []
    sparse = spark.createDataFrame([(i // 2 % 30, "a" if i % 3 else None, 5.0) for i in range(60)] + [(99, "b", 5.0)] * 3, "order_id int, item string, amount double")
    assert roles.quality_notes(sparse, roles.roles(sparse)) == ["item is blank in 31.7 % of the rows"]


def test_recommendations(spark):
    df = orders(spark)
    items = recommend.recommend(df, roles.roles(df))
    kinds = {x.kind for x in items}
    assert items[0].score == max(x.score for x in items) and len(items) <= 6
    assert "entity" in kinds and "season" in kinds and "status" in kinds
    assert recommend.recommend(df, roles.roles(df.drop("amount").withColumn("score", roles.F.lit(3.0)), metric="score")) == []


def test_lapsed_and_runs(spark):
    rows = [(DAY, "a", 5.0), (DAY + datetime.timedelta(days=3), "a", 6.0), (DAY + datetime.timedelta(days=300), "b", 1.0), (DAY, "c", 2.0)]
    got = recommend.lapsed(spark.createDataFrame(rows, "d timestamp, e string, v double"), "e", "d", "v").collect()
    assert [(r["label"], r["value"]) for r in got] == [("a", 11.0)]
    assert recommend.month_run({11, 12, 1}) == [11, 12, 1] and recommend.month_run({1, 3}) is None


def test_forecasts(spark):
    t = np.arange(60)
    y = 100 + 20 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(1).normal(0, 1, 60)
    rows = [("a", (datetime.date(2019 + i // 12, i % 12 + 1, 1)), float(v)) for i, v in enumerate(y)] + [("b", datetime.date(2020, 1, 1), 1.0), ("c", datetime.date(2020, 1, 1), 1.0), ("c", datetime.date(2020, 5, 1), 5.0)]
    got = fitted.forecasts(spark.createDataFrame(rows, "series string, period date, y double"), 12).orderBy("series", "h").collect()
    a = [r for r in got if r["series"] == "a"]
    want = 100 + 20 * np.sin(2 * np.pi * np.arange(60, 72) / 12)
    assert len(a) == 12 and np.abs(np.array([r["y"] for r in a]) - want).mean() < 4 and a[0]["mase"] < 0.5 and str(a[0]["period"]) == "2024-01-01"
    assert all(r["lo95"] <= r["lo80"] <= r["y"] <= r["hi80"] <= r["hi95"] for r in a)
    assert [r["status"] for r in got if r["series"] == "b"] == ["refused"] and [r["status"] for r in got if r["series"] == "c"] == ["limited"] * 12


def test_forecast_coverage():
    inside, rng = [], np.random.default_rng(7)
    for _ in range(20):
        e, x = rng.normal(0, 1, 120), np.zeros(120)
        for i in range(1, 120):
            x[i] = 0.5 * x[i - 1] + e[i]
        y = 50 + x + 3 * np.sin(2 * np.pi * np.arange(120) / 7)
        got = fitted.forecast_values(y[:-7], 7, 7)
        inside += list((got["lo95"] <= y[-7:]) & (y[-7:] <= got["hi95"]))
    assert np.mean(inside) >= 0.85


def test_intervals_against_plain_loops():
    rng = np.random.default_rng(3)
    for folds, steps in ((1, 1), (2, 2), (2, 6), (5, 12), (4, 3)):
        e = rng.normal(0, 1, (folds, steps)) * np.arange(1, steps + 1) ** 0.4

        def law(e):
            h = np.arange(1, e.shape[1] + 1)
            b = fitted.GROWTH_PRIOR
            if e.shape[1] >= 3 and len(e) >= 2:
                b = fitted.GROWTH_WEIGHT * min(0.6, max(0.0, np.polyfit(np.log(h), np.log(np.sqrt((e**2).mean(0))), 1)[0])) + (1 - fitted.GROWTH_WEIGHT) * b
            c = np.sqrt((e**2 / h ** (2 * b)).mean())
            z = sorted(np.abs(e / (c * h**b)).ravel())
            q = [z[min(len(z), int(np.ceil((len(z) + 1) * p))) - 1] for p in (0.8, 0.95)]
            q[1], w = max(q[1], q[0] * fitted.Z95 / fitted.Z80), min(1, len(z) / 16)
            return c, b, *((w * x + (1 - w) * z0) * (1 + fitted.WIDENING / len(e)) for x, z0 in zip(q, (fitted.Z80, fitted.Z95), strict=True))

        assert np.allclose(fitted.spread_of(e), law(e))
        if folds > 1:
            h, hits = np.arange(1, steps + 1), []
            for i in range(folds):
                c, b, *qs = law(np.delete(e, i, 0))
                hits.append([(np.abs(e[i]) <= q * c * h**b).mean() for q in qs])
            assert np.allclose(fitted.coverage_of(e), np.mean(hits, 0))
    assert fitted.coverage_of(np.ones((1, 3))) is None and fitted.spread_of(np.zeros((3, 4)))[0] == 0
    assert fitted.fold_plan(60, 12, 12) == ([24, 30, 36, 42, 48], 12, 3) and fitted.fold_plan(9, 6, 12) == ([6], 3, 1)


def test_mentions():
    got = lambda text: [(m.value, m.percent) for m in answers.mentions(text)]
    assert got("") == got(None) == got("A12 v7") == []
    assert got("made 1,234.5, then -3%, −2 k and 4 lakhs") == [(1234.5, False), (-3.0, True), (-2000.0, False), (400000.0, False)]
    assert got("10-5 of B7, 5 mice, +8") == [(10.0, False), (5.0, False), (5.0, False), (8.0, False)]
    assert answers.mentions("2.50")[0].slack == pytest.approx(0.005, rel=1e-4)


def test_answers(spark):
    data = spark.createDataFrame([("Hat", 10.0), ("Shoe", 30.0), ("Sock", 60.0)], "product string, amount double")
    left = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, t string")
    assert answers.same_results(left, spark.createDataFrame([(None, 2.0), ("a", 1.0), (None, 2.0)], "x string, y double"))
    assert not answers.same_results(left, spark.createDataFrame([(None, 2.0), ("a", 1.0)], "x string, y double"))
    assert not answers.same_results(left, spark.createDataFrame([("1", "a"), ("2", None), ("2", None)], "x string, y string"))
    known = answers.support("top 2", [("Sock", 60.0), ("Shoe 41", 30.0)])
    assert answers.unsupported_numbers("Sock made 60, twice 30; 66.7% of it; 41 and 45", known) == [] and answers.unsupported_numbers("it made 77", known) == [77.0]
    assert answers.foreign_names(data, "Sock beats Hat", "best?", [("Sock", 60.0)]) == ["Hat"]
    assert answers.describe(["n"], [(5,)]) == "n is 5." and answers.describe(["n"], []) == "No rows match."
    course = answers.describe(["day", "v"], [(datetime.date(2024, 1, i), float(i * i % 5)) for i in range(1, 6)])
    assert course == "v over 5 periods went from 1 at 2024-01-01 to 0 at 2024-01-05, between 0 (2024-01-05) and 4 (2024-01-02)."
    assert answers.describe(["p", "v"], [("x", 1234.5), ("y", 2)]) == "2 rows by v, starting with x: 1,234, y: 2."
    plan = {"sql": "select product, amount from data order by amount desc limit 1", "check_sql": "select max_by(product, amount), max(amount) from data", "text": "Sock leads with 60."}
    got = answers.answer(spark, data, "Which is best?", lambda q, e: plan)
    assert got["status"] == "checked" and got["text"] == "Sock leads with 60."
    assert answers.answer(spark, data, "Which is best?", lambda q, e: {**plan, "text": "Hat leads with 99."})["status"] == "partly"
    assert answers.answer(spark, data, "Which is best?", lambda q, e: {**plan, "check_sql": "select 1"})["status"] == "disagree"
    # a copy of the first query proves nothing
    assert answers.answer(spark, data, "Which is best?", lambda q, e: {**plan, "check_sql": plan["sql"].upper().replace("SELECT", "select  /* again */")})["status"] == "partly"
