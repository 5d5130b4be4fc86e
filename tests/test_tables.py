"""The table operators against DuckDB, and the SQL guard."""

import datetime
import decimal
import threading

import duckdb
import pytest

import __spark_entry__ as entry
from tallyweir import queries
from tallyweir.functions import cleaning
from tallyweir.plans import ingest
from tallyweir.plans.sqlguard import QueryRefused, guard
from tallyweir.sources import text

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    def cell(x):
        if isinstance(x, (float, decimal.Decimal)):
            return round(float(x), 4)
        return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x

    return sorted((tuple(cell(c) for c in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    by = {}
    for r in rows:
        by[r["dimension"]] = by.get(r["dimension"], 0) + r["delta"]
    assert len({round(v, 1) for v in by.values()}) == 1


@pytest.mark.parametrize(
    "sql",
    ["select * from hidden", "drop table data", "select * from parquet.`/etc`", "select 1; select 2", "select reflect('java.lang.System', 'exit')", "select (select max(x) from hidden) from data", "with data as (select * from hidden) select * from data", "", "show tables", "select * from data where a in (select b from hidden)", "select * from data lateral view explode(array(1)) t as x"],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(QueryRefused):
        guard(spark, sql)


@pytest.mark.parametrize("sql", ["select a, sum(b) over (partition by a) from data", "with t as (select * from data) select * from t union all select * from t", "select a from data where a in (select a from data) limit 3", "select a, count(*) from data group by rollup (a)"])
def test_guard_allows(spark, sql):
    guard(spark, sql)


def test_cleaning(spark):
    rows = [("$1,234.50",), ("(5)",), ("7-",), ("n/a",), ("12%",), ("abc",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(cleaning.number_of(cleaning.F.col("t"))).collect()]
    assert got == [1234.5, -5.0, -7.0, None, 12.0, None, None]
    days = spark.createDataFrame([("2024-01-05",), ("5/1/2024",), ("31/02/2024",), ("Sept 3, 2025",)], "t string").select(cleaning.date_of(cleaning.F.col("t"))).collect()
    assert [str(r[0])[:10] for r in days] == ["2024-01-05", "2024-01-05", "None", "2025-09-03"]


def test_csv(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("Datum;Betrag €;Betrag €\n01/01/2024;1,5;\n02/01/2024;2;\n", "utf-8")
    df = text.read_table(spark, f"file://{file}")
    assert df.columns == ["datum", "betrag"] and df.count() == 2
    file.write_bytes(b"%PDF-1.4 x")
    with pytest.raises(ValueError):
        text.read_table(spark, f"file://{file}")


@pytest.mark.parametrize(("late", "coding"), [("Café – €5", "cp1252"), ("Café – €5", "utf-8"), ("Caf\xe9 \x81", "latin-1")])
def test_csv_encoding_after_head(spark, tmp_path, late, coding):
    file = tmp_path / "late.csv"
    rows = [*[f"{i},plain row" for i in range(8_000)], f"8000,{late}"]
    file.write_bytes("\n".join(["id,name", *rows, ""]).encode(coding))
    assert file.read_bytes()[: text.HEAD].isascii()
    df = text.read_table(spark, f"file://{file}")
    assert df.count() == 8_001 and [r.name for r in df.where("id = '8000'").collect()] == [late]


def test_csv_encoding_across_head(spark, tmp_path):
    file = tmp_path / "edge.csv"
    start = "id,name\n1,"
    file.write_bytes((start + "x" * (text.HEAD - len(start) - 1) + "é\n2,ü\n").encode())
    assert [r.name[-1] for r in text.read_table(spark, f"file://{file}").collect()] == ["é", "ü"]


def test_csv_refuses_web_pages_and_reads_quoted_breaks(spark, tmp_path):
    page = tmp_path / "page.csv"
    page.write_text("<!DOCTYPE html>\n<html><body>\n<p>a, b</p></body></html>\n")
    with pytest.raises(ValueError):
        text.read_table(spark, f"file://{page}")
    file = tmp_path / "quoted.csv"
    file.write_text('id,"net\nsales",note\n1,2.5,"a\nb"\n2,3,c\n')
    df = text.read_table(spark, f"file://{file}")
    assert df.columns == ["id", "net_sales", "note"] and df.count() == 2


def test_prepared(spark):
    rows = [(i, f"{i % 28 + 1:02d}/02/2024", ["North", "north ", "South"][i % 3], f"$1,{i % 10}00.50", "n/a" if i % 4 else "99" if i % 8 else "4", str(i)) for i in range(120)]
    raw = spark.createDataFrame(rows, "row_id bigint, order_date string, region string, amount string, q1_quality string, unnamed_0 string")
    got = ingest.prepared(raw, "row_id")
    assert got.table.columns == ["order_date", "region", "amount", "q1_quality"] and got.table.count() == 120
    assert {r[0] for r in got.table.select("region").distinct().collect()} in ({"North", "South"}, {"north", "South"})
    assert got.roles["metric"] == "amount" and got.roles["date"] == "order_date"
    empty = ingest.cleaned(spark.createDataFrame([], "a string, b string"))
    assert empty[0].count() == 0 and empty[1] == {"a": "text", "b": "text"}


def test_date_ranges_reach_the_scan(spark):
    plan = queries.change_bridge(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line and "o_orderdate" in line]
    assert pushed and "GreaterThanOrEqual(o_orderdate" in pushed[0]


def test_self_join_of_odd_and_many_rows(spark, tmp_path):
    name, columns = "guarded_self_join", "c_nationkey int, c_custkey bigint"
    odd = [(1, 1), (1, 2), (1, 2), (1, 2), (1, 5), (1, None), (2, 7), (2, 7), (3, 1), (4, None), (4, None), (4, 9), (None, 1), (None, 2), (5, -3), (5, 4)]
    for part, rows in (("odd", odd), ("none", []), ("nulls", [(1, None), (1, None)])):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{part}/customer.parquet")
        con = duckdb.connect()
        con.execute(f"create view customer as select * from '{tmp_path}/{part}/customer.parquet/*.parquet'")
        assert plain(map(tuple, queries.QUERIES[name](spark, f"{tmp_path}/{part}").collect())) == plain(con.execute(queries.SQL[name]).fetchall())
    # one by one, these 10^10 pairs take minutes
    spark.range(200_000).selectExpr("cast(1 as int) as c_nationkey", "id as c_custkey").write.parquet(f"{tmp_path}/many/customer.parquet")
    context = spark.sparkContext
    timer = threading.Timer(40, context.cancelAllJobs)
    timer.start()
    try:
        assert [tuple(r) for r in queries.QUERIES[name](spark, f"{tmp_path}/many").collect()] == [(1, 200_000 * 199_999 // 2)]
    finally:
        timer.cancel()
