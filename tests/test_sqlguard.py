"""The SQL guard: refused and allowed statements, the cap, the time limit and separate callers."""

import time

import pytest
from pyspark.errors import AnalysisException

from tallyweir.plans.sqlguard import QueryRefused, guard, limited, run, same_query

#: Statements by kind of attack.
REFUSED = {
    "empty": ["", "   ", ";"],
    "not a select": ["drop table data", "insert into data values (1)", "create table t as select * from data", "update data set a = 1", "delete from data", "set x = 1", "show tables", "describe data", "explain select 1", "use db", "cache table data", "truncate table data", "alter table data rename to t", "call x()"],
    "several": ["select 1; select 2", "select 1; drop table data"],
    "files": ["select * from parquet.`/etc`", "select * from csv.`/etc/passwd`", "select * from text.`file:///etc/passwd`"],
    "hidden table": [
        "select * from hidden",
        "table hidden",
        "select * from default.hidden",
        "select (select max(b) from hidden) from data",
        "select * from data where a in (select b from hidden)",
        "select * from data where exists (select 1 from hidden)",
        "select * from data join hidden on true",
        "select * from data order by (select max(b) from hidden)",
        "select a from data group by a having max(a) > (select max(b) from hidden)",
        "with data as (select * from hidden) select * from data",
        "with t as (select * from hidden) select * from data",
        "select * from data union all select * from hidden",
        "select * from data, lateral (select * from hidden)",
        "select a, row_number() over w from data window w as (order by case when (select max(b) from hidden) = 7 then a else -a end)",
        "select sum(a) over (partition by (select max(b) from hidden)) from data",
        "select * from (select a, rank() over w from data window w as (partition by (select count(*) from hidden) order by a))",
    ],
    "functions": [
        "select reflect('java.lang.System', 'exit')",
        "select java_method('java.lang.System', 'exit')",
        "select try_reflect('java.lang.System', 'exit')",
        "select current_user from data",
        "select user from data",
        "select session_user from data",
        "select current_catalog from data",
        "select current_database from data",
        "select current_user() from data",
        "select input_file_name() from data",
        "select version() from data",
        "select spark_partition_id() from data",
        "select raise_error('x') from data",
        "select max(a) filter (where current_user = 'root') from data",
        "select no_such_function(a) from data",
    ],
    "row sources": ["select * from range(10)", "select * from data lateral view explode(array(1)) t as x", "select transform(a) using 'cat' as (x) from data", "select * from data pivot (sum(a) for b in (1, 2))", "select * from values (1), (2)"],
}
ALLOWED = [
    "select a, sum(b) over (partition by a) from data",
    "with t as (select * from data) select * from t union all select * from t",
    "select a from data where a in (select a from data) limit 3",
    "select a, count(*) from data group by rollup (a)",
    "select x.a from data x join data y on x.a = y.b",
    "select x.a from data x cross join data y",
    "select a from data intersect select b from data",
    "select a from data except select b from data",
    "select a from data x where not exists (select 1 from data y where y.b = x.a)",
    "select a, sum(b) over w from data window w as (partition by a order by b rows between 1 preceding and current row)",
    "select case when a > 1 then 'x' else 'y' end as k, avg(b) from data group by 1 having count(*) > 0 order by k",
    "select date_trunc('month', date'2024-01-05'), upper('a'), coalesce(a, b), current_date from data",
    "select explode(array(1, 2)) from data -- a comment",
    "select * from data, lateral (select a + b as s)",
    "select typeof(a) from data;",
    "select transform(array(a, b), x -> x + 1), rand(), current_timestamp(), pi() from data",
    "select a, lag(b) over (order by a), dense_rank() over (order by b desc) from data",
    "select count(distinct a), sum(b) filter (where a > 1), percentile(b, 0.5) from data",
    "select date'2024-01-01' + interval 3 days, cast(a as decimal(9, 2)), array(1, 2)[0], named_struct('x', a).x from data",
]


@pytest.fixture(scope="module")
def data(spark):
    spark.range(3).selectExpr("7 b").createOrReplaceTempView("hidden")
    yield spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    spark.catalog.dropTempView("hidden")


@pytest.mark.parametrize("sql", [s for kind in REFUSED.values() for s in kind])
def test_refused(spark, data, sql):
    # a name that is neither a column nor a function is refused by Spark itself
    with pytest.raises((QueryRefused, AnalysisException)):
        limited(spark, sql, {"data": data})


def test_too_long(spark):
    with pytest.raises(QueryRefused):
        guard(spark, "select " + "1," * 5000 + "1")


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, data, sql):
    assert limited(spark, sql, {"data": data}).collect() is not None


@pytest.mark.parametrize("sql", ["select secretvar from data", "select session.secretvar from data", "select system.session.secretvar from data", "select a from data where b < secretvar", "select (select max(b) + secretvar from data) from data"])
def test_session_variables_are_refused(spark, data, sql):
    spark.sql("declare or replace variable secretvar int default 42")
    with pytest.raises((QueryRefused, AnalysisException)):
        limited(spark, sql, {"data": data})
    spark.sql("drop temporary variable secretvar")


def test_user_functions_are_refused(spark, data):
    spark.udf.register("own_plus", lambda x: x + 1, "int")
    with pytest.raises(QueryRefused):
        limited(spark, "select own_plus(a) from data", {"data": data})
    # what a given table is made of is the caller's business
    assert limited(spark, "select x from data", {"data": data.selectExpr("own_plus(a) x")}).count() == 3


def test_cap_and_order(spark, data):
    assert [r.a for r in limited(spark, "select a from data order by a desc", {"data": data}, 2).collect()] == [3, 2]
    many = spark.range(5000).withColumnRenamed("id", "a")
    assert len(run(spark, "select a from data", many)) == 1000


def test_callers_keep_apart(spark, data):
    spark.range(1).createOrReplaceTempView("data")
    first = limited(spark, "select sum(a) s from data", {"data": data})
    second = limited(spark, "select sum(a) s from data", {"data": data.limit(0)})
    assert first.first().s == 6 and second.first().s is None and spark.table("data").columns == ["id"]
    spark.catalog.dropTempView("data")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("guarded_")]


def test_time_limit(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    began = time.time()
    with pytest.raises(TimeoutError):
        run(spark, "select sum(a) s from data", spark.range(8).selectExpr("id a").mapInArrow(slow, "a bigint"), seconds=3)
    assert time.time() - began < 40
    assert run(spark, "select count(*) n from data", spark.range(300).selectExpr("id a"))[0].n == 300


def test_same_query():
    assert same_query("select a from data where b > 'X'", "SELECT  a /* again */ FROM data\nWHERE b>'X' -- end")
    assert not same_query("select a from data where b > 'X'", "select a from data where b > 'x'")
    assert not same_query("select max(a) m from data", "select a m from data order by a desc limit 1")
