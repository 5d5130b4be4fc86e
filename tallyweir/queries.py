"""Registered queries of the table operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweir.functions import cleaning, inference
from tallyweir.operators import findings, fitted, forecast, frequency, insights, pairs, periods, prepare, quantiles, recommend, roles, segments
from tallyweir.plans import ingest, outputs, sqlguard
from tallyweir.sources.shared import Folder, followed
from tallyweir.streaming import levels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BEFORE, AFTER = ("2001-06-01", "2001-07-01"), ("2001-07-01", "2001-08-01")


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns}).withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


@query("SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 1000")
def guarded_top_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "select o_orderpriority as label, round(sum(o_totalprice), 2) as value from data where o_orderpriority is not null group by 1 order by 2 desc"
    return sqlguard.limited(spark, sql, {"data": table(spark, sf_dir, "orders")})


@query("SELECT c_mktsegment AS label, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(findings.top_groups(joined, "c_mktsegment", "o_totalprice"), 2, "value")


@query("SELECT event_type AS label, round(avg(value), 6) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_event_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.top_groups(table(spark, sf_dir, "events"), "event_type", "value", "mean"), 6, "value")


@query("""
    WITH s AS (SELECT p_brand AS label, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1 HAVING sum(l_extendedprice) > 0),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn FROM s)
    SELECT CASE WHEN rn <= 7 THEN label ELSE 'Other' END AS label, round(sum(v), 2) AS value FROM r GROUP BY 1
""")
def pie_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(findings.pie(joined, "p_brand", "l_extendedprice"), 2, "value")


@query("""
    WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
    c AS (SELECT least(12, floor((o_totalprice - a) * 12 / (b - a))::INT + 1) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
    SELECT i::INT AS bin, round(a + (b - a) * (i - 1) / 12, 4) AS lo, round(a + (b - a) * i / 12, 4) AS hi, coalesce(n, 0)::BIGINT AS n
    FROM e, range(1, 13) t(i) LEFT JOIN c ON c.bin = i
""")
def histogram_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.histogram(table(spark, sf_dir, "orders"), "o_totalprice"), 4, "lo", "hi")


@query("""
    WITH s AS (SELECT o_custkey, sum(o_totalprice) AS v, min(o_totalprice) AS m FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
    SELECT count(*) AS entities, round((SELECT sum(v) FROM (SELECT v FROM s ORDER BY v DESC, o_custkey LIMIT 5)), 2) AS top, round(sum(v), 2) AS total,
        round((SELECT sum(v) FROM (SELECT v FROM s ORDER BY v DESC, o_custkey LIMIT 5)) / sum(v), 6) AS share,
        count(*) >= 15 AND min(m) >= 0 AND (SELECT sum(v) FROM (SELECT v FROM s ORDER BY v DESC, o_custkey LIMIT 5)) / sum(v) >= 0.25 AS found FROM s
""")
def concentration_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(findings.concentration(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), 2, "top", "total"), 6, "share")


@query("""
    WITH s AS (SELECT l_returnflag AS label, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT (SELECT label FROM s ORDER BY v DESC, label DESC LIMIT 1) AS label, round(max(v) / sum(v), 6) AS share, count(*) AS segments,
        count(*) >= 3 AND max(v) / sum(v) > greatest(0.35, 1.5 / count(*)) AS found FROM s
""")
def dominant_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.dominant_segment(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"), 6, "share")


@query("""
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem
""")
def correlations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 6, "r")


@query("SELECT count(*) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total, count(*) >= 3 AS found FROM customer WHERE c_acctbal < 0")
def negative_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.negatives(table(spark, sf_dir, "customer"), "c_acctbal"), 2, "total")


_MONTHS = """
    m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS v FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    series AS (SELECT p::DATE AS period, coalesce(v, 0) AS y FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS p FROM m) LEFT JOIN m ON m.period = p::DATE)
"""


@query(f"WITH {_MONTHS} SELECT period::VARCHAR AS period, round(y, 2) AS y FROM series")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(periods.period_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 2, "y")


@query("""
    WITH m AS (SELECT (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS period, avg(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT period::VARCHAR AS period, round(v, 6) AS y FROM m
""")
def weekly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(periods.period_series(table(spark, sf_dir, "events"), "ts", "value", "mean", "W"), 6, "y")


@query("""
    WITH m AS (SELECT ts::DATE AS period, sum(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT p::DATE::VARCHAR AS period, round(coalesce(v, 0), 2) AS y FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS p FROM m) LEFT JOIN m ON m.period = p::DATE
""")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(periods.period_series(table(spark, sf_dir, "events"), "ts", "value"), 2, "y")


@query(f"""
    WITH {_MONTHS}, e AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders)
    SELECT period::VARCHAR AS period, round(y, 2) AS y FROM series, e
    WHERE NOT (day(lo) > 3 AND period = date_trunc('month', lo)) AND NOT (date_diff('day', hi, last_day(hi)) > 2 AND period = date_trunc('month', hi))
""")
def trimmed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(periods.trimmed(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 2, "y")


@query("SELECT count(DISTINCT o_orderdate::DATE) AS days, count(DISTINCT date_trunc('month', o_orderdate)) AS months, count(DISTINCT o_orderdate::DATE) >= 20 * count(DISTINCT date_trunc('month', o_orderdate)) AS daily FROM orders")
def daily_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.is_daily(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""
    WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS t, count(DISTINCT o_orderdate::DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
    SELECT period::VARCHAR AS period, round(t / CASE WHEN (SELECT median(d) FROM m) <= 6 THEN d ELSE day(last_day(period)) END * 30.4, 2) AS rate FROM m
""")
def month_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(periods.month_rate(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 2, "rate")


@query(f"""
    WITH {_MONTHS}, r AS (SELECT *, row_number() OVER (ORDER BY period) AS i, row_number() OVER (ORDER BY period DESC) AS j, greatest(2, floor(count(*) OVER () / 3)) AS k FROM series),
    t AS (SELECT avg(y) FILTER (i <= k) AS f, avg(y) FILTER (j <= k) AS l FROM r)
    SELECT round(f, 2) AS "first", round(l, 2) AS "last", round((l - f) / abs(f), 6) AS change, abs((l - f) / abs(f)) >= 0.05 AS found FROM t
""")
def trend_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(findings.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 2, "first", "last"), 6, "change")


def _bridge_sql(dimension: str) -> str:
    part = lambda a, b: f"coalesce(sum(o_totalprice) FILTER (o_orderdate::DATE >= '{a}' AND o_orderdate::DATE < '{b}'), 0)"
    return f"SELECT '{dimension}' AS dimension, coalesce({dimension}, '(blank)') AS label, round({part(*BEFORE)}, 2) AS before, round({part(*AFTER)}, 2) AS after, round({part(*AFTER)} - {part(*BEFORE)}, 2) AS delta FROM orders WHERE o_orderdate::DATE >= '{BEFORE[0]}' AND o_orderdate::DATE < '{AFTER[1]}' GROUP BY 1, 2"


@query(f"{_bridge_sql('o_orderpriority')} UNION ALL {_bridge_sql('o_orderstatus')}")
def change_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = findings.change_bridge(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority", "o_orderstatus"], BEFORE, AFTER)
    return rounded(made, 2, "before", "after", "delta")


@query(f"""
    WITH s AS (SELECT l_returnflag AS label,
        coalesce(sum(l_quantity) FILTER (l_shipdate::DATE < '{BEFORE[1]}'), 0) AS q0, coalesce(sum(l_quantity) FILTER (l_shipdate::DATE >= '{AFTER[0]}'), 0) AS q1,
        coalesce(sum(l_extendedprice) FILTER (l_shipdate::DATE < '{BEFORE[1]}'), 0) AS r0, coalesce(sum(l_extendedprice) FILTER (l_shipdate::DATE >= '{AFTER[0]}'), 0) AS r1
        FROM lineitem WHERE l_shipdate::DATE >= '{BEFORE[0]}' AND l_shipdate::DATE < '{AFTER[1]}' GROUP BY 1),
    p AS (SELECT *, CASE WHEN q0 > 0 AND q1 > 0 THEN (r1 / q1 - r0 / q0) * q1 ELSE 0 END AS price FROM s)
    SELECT coalesce(label, '(blank)') AS label, round(r1 - r0 - price, 2) AS volume, round(price, 2) AS price, round(r1 - r0, 2) AS delta FROM p
""")
def price_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = findings.price_volume(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", BEFORE, AFTER)
    return rounded(made, 2, "volume", "price", "delta")


@query("""
    WITH m AS (SELECT ts::DATE AS period, sum(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1),
    days AS (SELECT p::DATE AS d, coalesce(v, 0) AS y FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS p FROM m) LEFT JOIN m ON m.period = p::DATE),
    w AS (SELECT d, y, isodow(d) AS wd, count(*) OVER () AS n, CASE WHEN count(y) OVER c >= 15 THEN quantile_cont(y, 0.5) OVER c END AS mid FROM days WINDOW c AS (ORDER BY d ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)),
    f AS (SELECT wd, median(y / mid) FILTER (mid > 0) AS f FROM w GROUP BY 1),
    s AS (SELECT wd, coalesce(f / (SELECT avg(f) FROM f), 1) AS f FROM f),
    e AS (SELECT d, y, greatest(mid * f, (SELECT 0.1 * median(y) FROM days WHERE y > 0)) AS expected FROM w JOIN s USING (wd) WHERE mid IS NOT NULL AND n >= 28),
    r AS (SELECT *, (y - expected) / nullif(sqrt(expected), 0) AS res FROM e),
    c AS (SELECT *, res - (SELECT median(res) FROM r) AS off FROM r),
    z AS (SELECT *, 0.6745 * off / nullif((SELECT median(abs(off)) FROM c), 0) AS score FROM c)
    SELECT d::VARCHAR AS "day", round(y, 4) AS y, round(expected, 4) AS expected, round(score, 4) AS score FROM z WHERE abs(score) > 6 AND abs(y - expected) >= 0.4 * expected
        AND (SELECT count(*) FILTER (y > 0) >= 20 AND 2 * count(*) FILTER (y = 0) <= count(*) FROM days) ORDER BY abs(score) DESC, d LIMIT 2
""")
def daily_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.daily_anomalies(table(spark, sf_dir, "events"), "ts", "value"), 4, "y", "expected", "score")


@query("""
    WITH w AS (SELECT avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM lineitem),
    g AS (SELECT l_returnflag AS label, count(*) AS n, avg(l_discount) AS mean FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT label, n, round(mean, 6) AS mean, round((mean - m) / (s / sqrt(n)), 4) AS z, abs((mean - m) / (s / sqrt(n))) >= 3 AND abs(mean - m) >= 0.1 * abs(m) AND n >= 15 AS found FROM g, w
""")
def rating_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(findings.rating_gaps(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount"), 6, "mean"), 4, "z")


@query("""
    WITH m AS (SELECT o_orderpriority AS label, date_trunc('month', o_orderdate)::DATE AS p, sum(o_totalprice) AS v FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT label, v, date_diff('month', p, (SELECT max(p) FROM m)) AS age FROM m),
    s AS (SELECT label, coalesce(sum(v) FILTER (age < 3), 0) / 3 AS r, coalesce(sum(v) FILTER (age BETWEEN 3 AND 8), 0) / 6 AS e FROM a GROUP BY 1)
    SELECT label, round(r, 4) AS recent, round(e, 4) AS earlier, round((r - e) / nullif(abs(e), 0), 6) AS change FROM s
""")
def segment_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(findings.segment_shift(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority"), 4, "recent", "earlier"), 6, "change")


@query("""
    SELECT l_linestatus AS label, round(sum(l_quantity) / sum(l_extendedprice), 8) AS ratio, round((SELECT sum(l_quantity) / sum(l_extendedprice) FROM lineitem), 8) AS overall
    FROM lineitem WHERE (SELECT avg((l_quantity <= l_extendedprice)::INT) FROM lineitem) >= 0.95 AND l_linestatus IS NOT NULL GROUP BY 1
""")
def ratio_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.ratio_gaps(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_linestatus"), 8, "ratio", "overall")


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS name, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS uniques, min({c}) AS mn, round(median({c}), 6) AS median, max({c}) AS mx,
        (SELECT count(*) FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders) WHERE {c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) AS outliers FROM orders"""


@query(_profile_sql("o_totalprice"))
def profile_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.profile_numbers(table(spark, sf_dir, "orders"), ["o_totalprice"]), 6, "median")


@query("SELECT (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS n")
def duplicate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.duplicate_rows(table(spark, sf_dir, "customer"))


@query("""
    WITH d AS (SELECT ts::DATE AS d, event_type AS label, sum(value) AS v FROM events GROUP BY 1, 2)
    SELECT '2024-01-15' AS "day", label, round(coalesce(sum(v) FILTER (d = DATE '2024-01-15'), 0) - coalesce(avg(v) FILTER (d <> DATE '2024-01-15'), 0), 6) AS excess
    FROM d WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-29' GROUP BY 2
""")
def anomaly_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = spark.sql("select date'2024-01-15' as day")
    return rounded(findings.range_attribution(table(spark, sf_dir, "events"), "ts", "value", "event_type", flagged), 6, "excess")


@query(f"""
    WITH {_MONTHS}, r AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM series),
    e AS (SELECT max(n) AS n, max(y) FILTER (i = n) AS l, max(y) FILTER (i = 1) AS f FROM r)
    SELECT h::INT AS h, round(l, 2) AS naive, round((SELECT y FROM r WHERE i = e.n - 12 + 1 + (h - 1) % 12), 2) AS seasonal, round(l + h * (l - f) / (n - 1), 2) AS drift FROM e, range(1, 13) t(h)
""")
def forecast_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = periods.period_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return rounded(forecast.naive_forecasts(series, 12, 12), 2, "naive", "seasonal", "drift")


@query(f"""
    WITH {_MONTHS}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER () AS n, lag(y, 12) OVER w AS b, abs(y - lag(y) OVER w) AS s FROM series WINDOW w AS (ORDER BY period))
    SELECT round(avg(abs(y - b)) FILTER (i > n - 6), 2) AS mae, round(avg(s) FILTER (i <= n - 6), 2) AS scale, round(avg(abs(y - b)) FILTER (i > n - 6) / avg(s) FILTER (i <= n - 6), 6) AS mase FROM r
""")
def forecast_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = periods.period_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return rounded(rounded(forecast.seasonal_mase(series, 12, 6), 2, "mae", "scale"), 6, "mase")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rounded(found.select("c_custkey", "c_acctbal"), 2, "c_acctbal")


@query("SELECT event_id, ts, value FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 DESC LIMIT 8)")
def last_eight_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    days = events.select("d").distinct().orderBy(F.desc("d")).limit(8)
    return events.join(days, "d", "left_semi").select("event_id", "ts", "value")


@query("""
    SELECT event_id, user_id, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts AND o.o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate <= e.ts)) AS o_orderkey FROM events e
""")
def asof_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by one window over the union of both sides: no range join, one exchange on the key."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("ts", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    return events.union(orders).withColumn("o_orderkey", F.last("o", True).over(w)).where("side = 1").select("event_id", F.col("k").alias("user_id"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def guarded_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlguard.limited(spark, "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from data group by rollup (o_orderstatus, o_orderpriority)", {"data": table(spark, sf_dir, "orders")})


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS label, round(sum(o_totalprice), 2) AS value, (SELECT round(sum(o_totalprice), 2) FROM orders) AS total, (SELECT count(DISTINCT o_custkey) FROM orders) AS entities FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5")
def entity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.entity_shares(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), 2, "value", "total")


@query("""
    WITH e AS (SELECT max(o_orderdate)::DATE - 180 AS cut FROM orders),
    g AS (SELECT o_custkey AS label, max(o_orderdate::DATE) AS last, count(*) AS n, count(*) FILTER (o_orderdate::DATE >= cut - 365 AND o_orderdate::DATE < cut) AS b,
        sum(o_totalprice) FILTER (o_orderdate::DATE >= cut - 365 AND o_orderdate::DATE < cut) AS v, any_value(cut) AS cut FROM orders, e WHERE o_custkey IS NOT NULL GROUP BY 1)
    SELECT label, round(coalesce(v, 0), 2) AS value FROM g WHERE last < cut AND n >= 2 AND b > 0
""")
def lapsed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.lapsed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice"), 2, "value")


@query("""
    WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, sum(o_totalprice) AS t, count(DISTINCT o_orderdate::DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    r AS (SELECT month(p)::INT AS month, avg(t / CASE WHEN (SELECT median(d) FROM m) <= 6 THEN d ELSE day(last_day(p)) END * 30.4) AS rate FROM m GROUP BY 1)
    SELECT month, round(rate, 2) AS rate, round(rate / (SELECT avg(rate) FROM r), 6) AS index FROM r
""")
def season_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(recommend.season_index(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 2, "rate"), 6, "index")


@query("""
    WITH m AS (SELECT o_orderdate::DATE AS period, sum(o_totalprice) AS v FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    days AS (SELECT p::DATE AS d, coalesce(v, 0) AS y FROM (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS p FROM m) LEFT JOIN m ON m.period = p::DATE),
    w AS (SELECT d, y, avg(y) OVER (PARTITION BY date_trunc('week', d)) AS mean FROM days),
    g AS (SELECT (isodow(d) - 1)::INT AS weekday, avg(y) AS m, avg((y > mean + 1e-6)::INT) AS above FROM w GROUP BY 1)
    SELECT weekday, round(m / (SELECT avg(m) FROM g), 6) AS index, round(above, 6) AS above, (SELECT count(*) FROM days) AS days, round((SELECT avg((y > 0)::INT) FROM days), 6) AS active FROM g
""")
def weekday_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.weekday_index(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 6, "index", "above", "active")


@query("SELECT o_orderstatus AS label, round(sum(o_totalprice), 2) AS value, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus IS NOT NULL) AS total, '' AS kind FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.status_shares(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice"), 2, "value", "total")


@query("SELECT count(*) FILTER (c_acctbal < 0) AS n, round(coalesce(sum(c_acctbal) FILTER (c_acctbal < 0), 0), 2) AS refunds, round(coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0), 2) AS gross, round(-sum(c_acctbal) FILTER (c_acctbal < 0) / sum(c_acctbal) FILTER (c_acctbal > 0), 6) AS share FROM customer")
def refund_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(recommend.refunds(table(spark, sf_dir, "customer"), "c_acctbal"), 2, "refunds", "gross"), 6, "share")


@query("""
    WITH d AS (SELECT p_brand AS label, l_shipdate AS t, l_extendedprice AS s, l_quantity AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL AND l_shipdate IN (SELECT DISTINCT l_shipdate FROM lineitem WHERE l_shipdate IS NOT NULL ORDER BY 1 DESC LIMIT 8)),
    g AS (SELECT label, sum(s) FILTER (t = (SELECT max(t) FROM d)) AS stock, sum(f) / count(DISTINCT t) AS outflow FROM d GROUP BY 1)
    SELECT label, round(stock, 2) AS stock, round(outflow, 4) AS outflow, round(stock / outflow, 4) AS cover FROM g WHERE stock IS NOT NULL AND outflow <> 0
""")
def stock_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(rounded(recommend.stock_cover(joined, "l_shipdate", "p_brand", "l_extendedprice", "l_quantity"), 2, "stock"), 4, "outflow", "cover")


def _columns_sql(*columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, round(100.0 * (count(*) - count({c})) / count(*), 1)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS uniques FROM orders" for c in columns)


@query(_columns_sql("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.role_table(table(spark, sf_dir, "orders")).select("name", "missing_pct", "uniques")


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def common_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.common_values(table(spark, sf_dir, "events"), "event_type")


@query(f"""
    WITH {_MONTHS}, e AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders),
    s AS (SELECT period, y, row_number() OVER (ORDER BY period DESC) AS i, lead(y) OVER (ORDER BY period DESC) AS b FROM series, e
        WHERE NOT (day(lo) > 3 AND period = date_trunc('month', lo)) AND NOT (date_diff('day', hi, last_day(hi)) > 2 AND period = date_trunc('month', hi)))
    SELECT 'rows' AS label, count(*)::DOUBLE AS value, NULL::DOUBLE AS delta_pct, NULL::VARCHAR AS note FROM orders
    UNION ALL SELECT 'total', round(sum(o_totalprice), 2), NULL, NULL FROM orders
    UNION ALL SELECT 'latest period', round(y, 2), round(100 * (y - b) / abs(b), 4), period::VARCHAR FROM s WHERE i = 1
    UNION ALL (SELECT 'best period', round(y, 2), NULL, period::VARCHAR FROM s ORDER BY y DESC, period LIMIT 1)
""")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(roles.kpis(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate"), 2, "value"), 4, "delta_pct")


@query(None)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.role_table(table(spark, sf_dir, "orders"))


@query(None)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    items = recommend.recommend(orders, roles.roles(orders))
    return spark.createDataFrame([(i + 1, x.kind, round(x.score, 6), x.title, x.because) for i, x in enumerate(items)], "priority int, kind string, score double, title string, because string")


@query(None)
def forecast_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months ahead for every order priority, all series in parallel."""
    months = table(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(F.coalesce("o_orderpriority", F.lit("(blank)")).alias("series"), periods.bin_of(F.col("o_orderdate"), "MS").alias("period")).agg(F.sum("o_totalprice").alias("y"))
    return fitted.forecasts(months, 6, "MS")

_GUARDED = {
    "guarded_window_share": ("orders", "SELECT o_orderkey, o_orderpriority, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS share FROM {} WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1000"),
    "guarded_ranked_days": ("events", "SELECT * FROM (SELECT event_id, user_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM {} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) AS t WHERE n <= 2 ORDER BY event_id LIMIT 1000"),
    "guarded_union_all": ("orders", "SELECT o_orderstatus AS label, count(*) AS n FROM {} GROUP BY o_orderstatus UNION ALL SELECT o_orderpriority, count(*) FROM {} GROUP BY o_orderpriority"),
    "guarded_self_join": ("customer", "SELECT a.c_nationkey, count(*) AS pairs FROM {} a JOIN {} b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY a.c_nationkey"),
    "guarded_cross_join": ("orders", "SELECT s.o_orderstatus, p.o_orderpriority FROM (SELECT DISTINCT o_orderstatus FROM {}) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {}) p"),
    "guarded_except": ("customer", "SELECT c_nationkey FROM {} EXCEPT SELECT c_nationkey FROM {} WHERE c_acctbal > 9700"),
    "guarded_text": ("part", "SELECT p_partkey, upper(substring(p_name, 1, 5)) AS head, length(trim(p_name)) AS size, replace(p_brand, '#', '-') AS brand, CASE WHEN p_type ILIKE '%steel%' THEN 'steel' ELSE 'other' END AS kind FROM {} ORDER BY p_partkey LIMIT 1000"),
    "guarded_months": ("orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(DISTINCT o_custkey) AS buyers, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM {} GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 1000"),
}

#: What Spark is given where the SQL as it stands would go through rows with the square of a group's size: a key that
#: occurs c times among n of a group is in c * (n - c) pairs of unequal keys, and so each pair is counted from both ends.
_LINEAR = {
    "guarded_self_join": """
        SELECT a.c_nationkey, sum(CAST(b.c * (a.n - b.c) AS DECIMAL(38, 0))) DIV 2 AS pairs
        FROM (SELECT c_nationkey, count(c_custkey) AS n FROM {} GROUP BY c_nationkey) a
        JOIN (SELECT c_nationkey, c_custkey, count(*) AS c FROM {} WHERE c_custkey IS NOT NULL GROUP BY c_nationkey, c_custkey) b ON a.c_nationkey = b.c_nationkey
        GROUP BY a.c_nationkey HAVING max(a.n - b.c) > 0
    """,
}


def _guarded(name: str, source: str, sql: str) -> None:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sqlguard.limited(spark, _LINEAR.get(name, sql).replace("{}", "data"), {"data": table(spark, sf_dir, source)})

    made.__name__ = name
    # counts of Spark are BIGINT, parts of a date INT
    casts = {"guarded_text": "SELECT p_partkey, head, size::INT AS size, brand, kind FROM ({})", "guarded_months": "SELECT y::INT AS y, m::INT AS m, buyers, done::BIGINT AS done FROM ({})", "guarded_ranked_days": "SELECT event_id, user_id, n::INT AS n, near FROM ({})"}
    query(casts.get(name, "{}").format(sql.replace("{}", source)))(made)


for _name, (_source, _sql) in _GUARDED.items():
    _guarded(_name, _source, _sql)


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2000-01-01')")
def customers_gone_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    found = table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rounded(found.select("c_custkey", "c_acctbal"), 2, "c_acctbal")


#: Daily order sums of 2,399 days with three of them raised, so that there is something to find.
_SPIKED = "CASE WHEN o_orderdate::DATE IN ('1997-03-12', '1998-07-01', '1999-10-20') THEN 40 ELSE 1 END"


@query(SQL["daily_anomalies"].replace("SELECT ts::DATE AS period, sum(value) AS v FROM events WHERE ts IS NOT NULL", f"SELECT o_orderdate::DATE AS period, sum(o_totalprice * {_SPIKED}) AS v FROM orders WHERE o_orderdate IS NOT NULL"))
def spiked_day_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    spiked = F.when(F.to_date("o_orderdate").cast("string").isin("1997-03-12", "1998-07-01", "1999-10-20"), 40).otherwise(1)
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice") * spiked)
    return rounded(findings.daily_anomalies(orders, "o_orderdate", "o_totalprice"), 4, "y", "expected", "score")


@query(f"""
    WITH {_MONTHS}, s AS (SELECT period, CASE WHEN period IN ('1996-05-01', '2000-02-01') THEN y * 9 ELSE y END AS y FROM series),
    c AS (SELECT *, y - (SELECT median(y) FROM s) AS o FROM s), z AS (SELECT *, 0.6745 * o / nullif((SELECT median(abs(o)) FROM c), 0) AS score FROM c)
    SELECT period::VARCHAR AS period, round(y, 2) AS y, round(score, 4) AS score FROM z WHERE abs(score) > 3.5 ORDER BY abs(score) DESC, period LIMIT 2
""")
def month_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = periods.period_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    raised = series.withColumn("y", F.when(F.col("period").cast("string").isin("1996-05-01", "2000-02-01"), F.col("y") * 9).otherwise(F.col("y")))
    return rounded(rounded(findings.period_outliers(raised), 2, "y"), 4, "score")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS part, '{b}' AS whole, count(*) AS n, round(avg(({a} <= {b})::INT), 6) AS share FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL HAVING avg(({a} <= {b})::INT) >= 0.95" for a in _MEASURES for b in _MEASURES if a != b))
def parts_of_wholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ratio_pairs(table(spark, sf_dir, "lineitem"), list(_MEASURES))


def _dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a careless export: all text, with currency signs, brackets, day-first dates, spellings, tokens for nothing and a total line."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    money = F.format_number(price, 2)
    amount = F.when(k % 7 == 0, F.concat(F.lit("("), money, F.lit(")"))).when(k % 7 == 1, F.concat(F.lit("$"), money)).when(k % 7 == 2, F.concat(money, F.lit("-"))).when(k % 7 == 3, F.lit(" n/a ")).otherwise(money)
    status = F.when(k % 11 == 0, F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" "))).when(k % 11 == 1, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(amount.alias("amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"), status.alias("priority"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("done"), F.when(k % 5 == 0, F.lit("-")).otherwise(F.concat(F.lit("0"), k.cast("string"))).alias("zip_code"))
    return rows.union(spark.createDataFrame([("1.00", None, "Grand Total:", None, None)], "a string, b string, c string, d string, e string"))


@query("""
    WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 IN (0, 2) THEN -round(o_totalprice, 2) WHEN o_orderkey % 7 = 3 THEN NULL ELSE round(o_totalprice, 2) END AS amount FROM orders)
    SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, o_orderpriority AS priority, o_orderstatus = 'F' AS done, count(*) AS n, count(amount) AS amounts,
        round(coalesce(sum(amount), 0), 2) AS total, count(*) FILTER (o_orderkey % 5 <> 0) AS codes
    FROM o GROUP BY 1, 2, 3
""")
def cleaned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, kinds = ingest.cleaned(_dirty_orders(spark, sf_dir))
    if kinds != {"amount": "number", "order_date": "date", "priority": "text", "done": "boolean", "zip_code": "text"}:
        raise ValueError(f"read as {kinds}")
    made = df.groupBy(F.date_trunc("month", "order_date").cast("date").cast("string").alias("month"), "priority", "done")
    return made.agg(F.count("*").alias("n"), F.count("amount").alias("amounts"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"), F.count("zip_code").alias("codes"))


@query("SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 10 <> 0) AS scores, round(avg(p_partkey % 5 + 1) FILTER (p_partkey % 9 <> 0 AND p_partkey % 10 <> 0), 6) AS mean FROM part GROUP BY 1")
def cleared_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("p_partkey") % 9 == 0, 99.0).when(F.col("p_partkey") % 10 == 0, float("inf")).otherwise((F.col("p_partkey") % 5 + 1).cast("double"))
    scores = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), cleaning.finite(score).alias("score"))
    clear = inference.without_stray_codes(scores, "score")
    return clear.groupBy("brand").agg(F.count("*").alias("n"), F.count("score").alias("scores"), F.round(F.avg("score"), 6).alias("mean"))


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(100 * p):02d}" for p in _SHARES) + " FROM lineitem" for c in _MEASURES))
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), list(_MEASURES), list(_SHARES))
    rows = [(c, s.n, *(round(q, 6) for q in s.quantiles)) for c, s in found.items()]
    return spark.createDataFrame(rows, "name string, n bigint, " + ", ".join(f"p{round(100 * p):02d} double" for p in _SHARES))


_WEIGHED = "SELECT l_quantity AS amount, l_quantity + 20 * (l_partkey % 3) AS handling, 2 * l_quantity + 1 AS twice, l_quantity + 10 * (l_partkey % 4) AS packing_total, l_extendedprice AS price, CASE WHEN l_suppkey % 10 > 0 THEN -l_quantity + 9 * (l_orderkey % 4) END AS slack FROM lineitem"


@query(f"""
    WITH t AS ({_WEIGHED}), r AS (
        {" UNION ALL ".join(f"SELECT '{c}' AS other, count(amount + {c}) AS n, corr(amount, {c}) AS r FROM t" for c in ("handling", "twice", "price", "slack"))}
    )
    SELECT other, n, round(r, 6) AS r FROM r WHERE abs(r) > 0.5 AND abs(r) < 0.95 AND (SELECT count(*) FROM t) >= 50 ORDER BY abs(r) DESC, other LIMIT 1
""")
def moves_with_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, key = F.col("l_quantity"), lambda c, n: (F.col(c) % n).cast("double")
    weighed = table(spark, sf_dir, "lineitem").select(q.alias("amount"), (q + 20 * key("l_partkey", 3)).alias("handling"), (2 * q + 1).alias("twice"), (q + 10 * key("l_partkey", 4)).alias("packing_total"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_suppkey") % 10 > 0, -q + 9 * key("l_orderkey", 4)).alias("slack"))
    return rounded(pairs.moves_with(weighed, "amount", ["handling", "twice", "packing_total", "price", "slack"]), 6, "r")


_PAID = "SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS charged, l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 0.25 WHEN l_linestatus = 'O' THEN 0.75 ELSE 0.5 END AS paid, CASE WHEN l_orderkey % 50 > 0 THEN l_quantity END AS pieces FROM lineitem"


@query(f"""
    WITH t AS ({_PAID}), c AS (
        {" UNION ALL ".join(f"SELECT '{a}' AS part, '{b}' AS whole, {d} AS label, '{d}' AS dimension, {a} AS a, {b} AS b FROM t" for a in ("charged", "paid", "pieces") for b in ("charged", "paid", "pieces") if a != b for d in ("flag", "status"))}
    ), p AS (
        SELECT part, whole, sum(a) FILTER (b > 0) / sum(b) FILTER (b > 0 AND a IS NOT NULL) AS overall, sum(b) FILTER (b > 0 AND a IS NOT NULL) AS total FROM c WHERE dimension = 'flag' GROUP BY 1, 2
        HAVING count(a + b) >= 0.9 * count(*) AND count(*) FILTER (b > 0 AND a IS NOT NULL) >= 40 AND avg((a <= b + 1e-9)::INT) FILTER (b > 0) >= 0.95
            AND count(*) FILTER (b > 0 AND a < 0) = 0 AND sum(a) FILTER (b > 0) > 0 AND sum(a) FILTER (b > 0) / sum(b) FILTER (b > 0 AND a IS NOT NULL) < 0.999
    ), g AS (
        SELECT part, whole, dimension, label, count(*) AS n, sum(a) / sum(b) AS ratio, sum(b) AS pb FROM c WHERE b > 0 AND a IS NOT NULL AND label IS NOT NULL GROUP BY ALL
    ), o AS (
        SELECT part, whole, dimension, label, n, ratio, overall, pb / total AS share, abs(ratio - overall) AS gap FROM g JOIN p USING (part, whole)
        WHERE n >= 20 AND pb / total >= 0.05 AND abs(ratio - overall) >= greatest(0.10, 0.25 * overall)
    )
    SELECT part, whole, dimension, label, n, round(ratio, 6) AS ratio, round(overall, 6) AS overall, round(share, 6) AS share, round(gap, 6) AS gap,
        row_number() OVER (ORDER BY gap * share DESC, part, whole, dimension, label)::INT AS rank FROM o
""")
def ratio_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    rate = F.when(flag == "R", 0.25).when(F.col("l_linestatus") == "O", 0.75).otherwise(0.5)
    paid = table(spark, sf_dir, "lineitem").select(flag.alias("flag"), F.col("l_linestatus").alias("status"), price.alias("charged"), (price * rate).alias("paid"), F.when(F.col("l_orderkey") % 50 > 0, F.col("l_quantity")).alias("pieces"))
    return rounded(pairs.ratio_gaps(paid, ["charged", "paid", "pieces"], ["flag", "status"]), 6, "ratio", "overall", "share", "gap")


_SHIFTED = """SELECT o_orderdate::DATE AS d, o_orderpriority AS priority, o_orderstatus AS status,
    o_totalprice * CASE WHEN o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderpriority = '1-URGENT' THEN 0.4 WHEN o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderstatus = 'P' THEN 1.9 ELSE 1 END AS v FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL"""


@query(f"""
    WITH t AS ({_SHIFTED}), ends AS (
        SELECT date_trunc('month', min(d))::DATE AS a, date_trunc('month', max(d))::DATE AS b, min(d) AS lo, max(d) AS hi, sum(v) AS total FROM t
    ), span AS (
        SELECT CASE WHEN lo - a > 2 THEN (a + INTERVAL 1 MONTH)::DATE ELSE a END AS first, CASE WHEN last_day(b) - hi > 2 THEN (b - INTERVAL 1 MONTH)::DATE ELSE b END AS last, total FROM ends
    ), c AS (
        SELECT dimension, label, date_trunc('month', d)::DATE AS period, sum(v) AS v, count(*) AS n FROM (
            SELECT '' AS dimension, '' AS label, d, v FROM t UNION ALL SELECT 'priority', priority, d, v FROM t UNION ALL SELECT 'status', status, d, v FROM t
        ) WHERE label IS NOT NULL GROUP BY ALL
    ), dense AS (
        SELECT g.dimension, g.label, age, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT dimension, label FROM c) g, (SELECT unnest(range(9)) AS age), span
        LEFT JOIN c ON c.dimension = g.dimension AND c.label = g.label AND c.period = (span.last - to_months(age::INT))::DATE
    ), s AS (
        SELECT dimension, label, avg(v) FILTER (age >= 3) AS before, avg(v) FILTER (age < 3) AS recent, stddev_samp(v) FILTER (age >= 3) AS sd FROM dense GROUP BY ALL
    ), f AS (
        SELECT s.*, n, sv / total AS share, total, CASE WHEN before > 0 THEN (recent - before) / before * 100 END AS change, 2.5 * sd * sqrt(1 / 6.0::DOUBLE + 1 / 3.0::DOUBLE) AS noise
        FROM s JOIN (SELECT dimension, label, sum(n) AS n, sum(v) AS sv FROM c GROUP BY ALL) USING (dimension, label), span WHERE date_diff('month', first, last) >= 8
    ), j AS (
        SELECT f.*, o.change AS overall, coalesce(total > 0 AND share >= 0.05 AND n >= 15 AND abs(f.change) >= 25 AND abs(f.change - o.change) >= 20 AND abs(recent - before) >= noise, false) AS found
        FROM f, (SELECT change FROM f WHERE dimension = '' AND change IS NOT NULL) o WHERE dimension <> ''
    )
    SELECT dimension, label, n::BIGINT AS n, round(share, 6) AS share, round(before, 1) AS before, round(recent, 1) AS recent, round(change, 4) AS change, round(overall, 4) AS overall, round(noise, 1) AS noise, found,
        CASE WHEN found THEN row_number() OVER (PARTITION BY found ORDER BY abs(recent - before) DESC, dimension, label) END::INT AS rank FROM j
""")
def moved_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp")
    factor = F.when(late & (F.col("o_orderpriority") == "1-URGENT"), 0.4).when(late & (F.col("o_orderstatus") == "P"), 1.9).otherwise(1.0)
    shifted = table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") * factor).alias("v"))
    return rounded(rounded(rounded(segments.segment_shifts(shifted, "o_orderdate", "v", ["priority", "status"]), 6, "share"), 4, "change", "overall"), 1, "before", "recent", "noise")


#: Name of a series, its times from an order's day d, and which orders it takes.
_SERIES = {
    "days": ("d", "true"),
    "working days": ("d", "isodow(d) <= 5"),
    "weeks": ("date_trunc('week', d)", "true"),
    "weeks with holes": ("date_trunc('week', d)", "week(d) % 5 <> 0"),
    "months": ("date_trunc('month', d)", "true"),
    "month ends": ("last_day(d)", "true"),
    "quarters": ("date_trunc('quarter', d)", "true"),
    "years": ("date_trunc('year', d)", "true"),
    "twice a month": ("d", "day(d) IN (3, 17)"),
    "once": ("d", "d = DATE '1999-01-04'"),
}


@query(f"""
    WITH o AS (SELECT o_orderdate::DATE AS d FROM orders WHERE o_orderdate IS NOT NULL), t AS (
        {" UNION ".join(f"SELECT '{name}' AS series, ({at})::DATE AS t FROM o WHERE {which}" for name, (at, which) in _SERIES.items())}
    ), p AS (
        SELECT series, t, lag(t) OVER (PARTITION BY series ORDER BY t) AS p FROM t
    ), g AS (
        SELECT series, count(*) AS n, median(t - p) AS gap, min(t - p) AS least, max(t - p) AS most, min(date_diff('month', p, t)) AS m1, max(date_diff('month', p, t)) AS m2, count(DISTINCT month(t)) AS months,
            bool_and(day(t) = 1) AS starts, bool_and(t = last_day(t)) AS ends, bool_and(isodow(t) <= 5) AS working, bool_and(p IS NULL OR t - p = CASE WHEN isodow(p) = 5 THEN 3 ELSE 1 END) AS next_working
        FROM p GROUP BY series
    )
    SELECT series, n, round(gap, 6) AS gap, coalesce(
        CASE WHEN n < 3 THEN NULL WHEN least = most AND least = 1 THEN 'D' WHEN working AND next_working THEN 'B' WHEN least = most AND least = 7 THEN 'W'
            WHEN starts AND m1 = m2 AND m1 = 12 AND months = 1 THEN 'YS' WHEN ends AND m1 = m2 AND m1 = 12 AND months = 1 THEN 'YE' WHEN starts AND m1 = m2 AND m1 = 3 THEN 'QS' WHEN ends AND m1 = m2 AND m1 = 3 THEN 'QE'
            WHEN starts AND m1 = m2 AND m1 = 1 THEN 'MS' WHEN ends AND m1 = m2 AND m1 = 1 THEN 'ME' END,
        CASE WHEN n < 2 THEN NULL WHEN gap < 0.2 THEN 'h' WHEN gap <= 1.5 THEN 'D' WHEN gap BETWEEN 5 AND 9 THEN 'W' WHEN gap BETWEEN 26 AND 33 THEN 'MS' WHEN gap BETWEEN 85 AND 95 THEN 'QS' END) AS frequency
    FROM g
""")
def series_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    day = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    trunc = lambda unit: F.trunc(d, unit)
    times = {
        "days": d,
        "working days": F.when(F.weekday(d) < 5, d),
        "weeks": trunc("week"),
        "weeks with holes": F.when(F.weekofyear(d) % 5 != 0, trunc("week")),
        "months": trunc("month"),
        "month ends": F.last_day(d),
        "quarters": trunc("quarter"),
        "years": trunc("year"),
        "twice a month": F.when(F.dayofmonth(d).isin(3, 17), d),
        "once": F.when(d == F.lit("1999-01-04").cast("date"), d),
    }
    rows = day.select(F.explode(F.array(*[F.struct(F.lit(name).alias("series"), t.alias("t")) for name, t in times.items()])).alias("x")).select("x.*")
    return rounded(frequency.frequencies(rows, "series", "t"), 6, "gap")


@query("""
    WITH o AS (SELECT o_orderdate::DATE AS d, o_totalprice AS v, o_orderpriority AS priority, o_orderstatus AS status FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL), e AS (
        SELECT date_trunc('month', min(d))::DATE AS a, date_trunc('month', max(d))::DATE AS b, max(d) AS hi, count(DISTINCT d) / count(DISTINCT date_trunc('month', d)) AS per_month, count(DISTINCT d) >= 20 * count(DISTINCT date_trunc('month', d)) AS daily FROM o
    ), w AS (
        SELECT a, daily, CASE WHEN last_day(hi) - hi > 2 AND per_month > 4 THEN b ELSE (b + INTERVAL 1 MONTH)::DATE END AS c1 FROM e
    ), s AS (
        SELECT a, daily, (c1 - INTERVAL 2 MONTH)::DATE AS p0, (c1 - INTERVAL 1 MONTH)::DATE AS c0, c1 FROM w WHERE (c1 - INTERVAL 2 MONTH)::DATE >= a
    ), r AS (
        SELECT o.*, s.* FROM o, s WHERE d >= p0 AND d < c1
    ), u AS (
        SELECT old, new, CASE WHEN daily THEN d1 ELSE n1 END / CASE WHEN daily THEN d0 ELSE n0 END AS s, daily FROM (
            SELECT sum(v) FILTER (d < c0) AS old, sum(v) FILTER (d >= c0) AS new, count(DISTINCT d) FILTER (d < c0) AS n0, count(DISTINCT d) FILTER (d >= c0) AS n1, min(c1 - c0) AS d1, min(c0 - p0) AS d0, bool_and(daily) AS daily FROM r)
    ), k AS (
        SELECT CASE WHEN abs(s - 1) >= 0.03 THEN s ELSE 1.0 END AS scale, CASE WHEN abs(s - 1) >= 0.03 THEN CASE WHEN daily THEN 'day' ELSE 'reporting date' END END AS unit FROM u
        WHERE abs(new - old * CASE WHEN abs(s - 1) >= 0.03 THEN s ELSE 1.0 END) >= 0.03 * abs(old * CASE WHEN abs(s - 1) >= 0.03 THEN s ELSE 1.0 END)
    ), g AS (
        SELECT dimension, label, scale, unit, old * scale AS before, after FROM (
            SELECT dimension, coalesce(label, '(blank)') AS label, coalesce(sum(v) FILTER (d < c0), 0) AS old, coalesce(sum(v) FILTER (d >= c0), 0) AS after
            FROM (SELECT 'priority' AS dimension, priority AS label, d, v, c0 FROM r UNION ALL SELECT 'status', status, d, v, c0 FROM r) GROUP BY ALL), k
    ), f AS (
        SELECT dimension, CASE WHEN count(*) >= 2 THEN max(abs(after - before)) / sum(abs(after - before)) END AS focus FROM g GROUP BY 1
    )
    SELECT dimension, label, round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS delta, round(scale, 6) AS scale, unit, round(focus, 6) AS focus,
        focus IS NOT NULL AND dimension = (SELECT dimension FROM f ORDER BY focus DESC NULLS LAST, dimension DESC LIMIT 1) AS lead FROM g JOIN f USING (dimension)
""")
def latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return rounded(rounded(frequency.last_change(orders, "o_orderdate", "o_totalprice", ["priority", "status"]), 2, "before", "after", "delta"), 6, "scale", "focus")


@query(SQL["spiked_day_anomalies"])
def streamed_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days, from daily levels that a stream keeps up; the table is in no order of time, so the delay covers its span."""
    path = f"{sf_dir}/orders.parquet"
    spiked = F.when(F.to_date("o_orderdate").cast("string").isin("1997-03-12", "1998-07-01", "1999-10-20"), 40).otherwise(1)
    rows = followed(spark, path).withColumn("o_totalprice", F.col("o_totalprice") * spiked)
    with Folder(spark, "levels") as place:
        levels.advance(spark, rows, place, "o_orderkey", "o_orderdate", "o_totalprice", delay_days=36_500)
        found = rounded(levels.anomalies(spark, place), 4, "y", "expected", "score")
        return findings.settled(found)


#: Orders with three raised days, a group that falls in the last months, and some returns.
_PLANTED = f"""SELECT o_orderdate, o_orderpriority, o_orderstatus,
    o_totalprice * {_SPIKED} * CASE WHEN o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderpriority = '1-URGENT' THEN 0.4 ELSE 1 END * CASE WHEN o_orderkey % 500 = 0 THEN -1 ELSE 1 END AS o_totalprice FROM orders"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate").cast("string")
    factor = F.when(day.isin("1997-03-12", "1998-07-01", "1999-10-20"), 40.0).otherwise(1.0) * F.when((F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp")) & (F.col("o_orderpriority") == "1-URGENT"), 0.4).otherwise(1.0)
    sign = F.when(F.col("o_orderkey") % 500 == 0, -1.0).otherwise(1.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") * factor * sign).alias("amount"))


@query(f"""
    SELECT '' AS dimension, '' AS label, o_orderdate::DATE::VARCHAR AS period, round(sum(o_totalprice), 2) AS v, count(o_totalprice) AS n, count(*) AS rows, round(sum(o_totalprice) FILTER (o_totalprice < 0), 2) AS lost, count(*) FILTER (o_totalprice < 0) AS lost_n FROM ({_PLANTED}) GROUP BY ALL
    UNION ALL SELECT 'priority', o_orderpriority, date_trunc('month', o_orderdate)::DATE::VARCHAR, round(sum(o_totalprice), 2), count(o_totalprice), count(*), round(sum(o_totalprice) FILTER (o_totalprice < 0), 2), count(*) FILTER (o_totalprice < 0) FROM ({_PLANTED}) GROUP BY ALL
    UNION ALL SELECT 'status', o_orderstatus, date_trunc('month', o_orderdate)::DATE::VARCHAR, round(sum(o_totalprice), 2), count(o_totalprice), count(*), round(sum(o_totalprice) FILTER (o_totalprice < 0), 2), count(*) FILTER (o_totalprice < 0) FROM ({_PLANTED}) GROUP BY ALL
""")
def totals_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recommend.totals_cube(_planted(spark, sf_dir), "amount", "order_date", ["priority", "status"]), 2, "v", "lost")


_MOVED = SQL["moved_segments"].replace(_SHIFTED, "SELECT o_orderdate::DATE AS d, o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS v FROM planted WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL")


@query(f"""
    WITH planted AS ({_PLANTED}),
    whole AS (SELECT *, CASE WHEN mn > 0 AND p99 / p50 > 8 THEN NULL ELSE 3 * (q3 - q1) END AS gap FROM (SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_totalprice) AS mn, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS q3, quantile_cont(o_totalprice, 0.99) AS p99 FROM planted)),
    odd AS (SELECT count(*) AS n, sum(o_totalprice) AS held FROM planted, whole WHERE gap > 0 AND (o_totalprice < q1 - gap OR o_totalprice > q3 + gap)),
    moved AS ({SQL["latest_change"].replace("FROM orders", "FROM planted")}),
    chief AS (SELECT dimension, label, delta, sum(delta) OVER () AS total, sum(before) OVER () AS base FROM moved WHERE lead ORDER BY abs(delta) DESC, label DESC LIMIT 1),
    days AS ({SQL["spiked_day_anomalies"].replace("sum(o_totalprice * " + _SPIKED + ") AS v FROM orders", "sum(o_totalprice) AS v FROM planted")}),
    months AS (SELECT period, y, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM (
        SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS y FROM planted GROUP BY 1) WHERE period < (SELECT CASE WHEN last_day(max(o_orderdate)::DATE) - max(o_orderdate)::DATE > 2 THEN date_trunc('month', max(o_orderdate)) ELSE max(o_orderdate) END FROM planted)),
    periods AS (SELECT period, 0.6745 * off / nullif(median(abs(off)) OVER (), 0) AS z FROM (SELECT period, y - median(y) OVER () AS off FROM months)),
    trend AS (SELECT 100 * (avg(y) FILTER (i > n - greatest(2, n // 3)) - avg(y) FILTER (i <= greatest(2, n // 3))) / abs(avg(y) FILTER (i <= greatest(2, n // 3))) AS c FROM months HAVING count(*) >= 6),
    groups AS (SELECT 'priority' AS dimension, o_orderpriority AS label, sum(o_totalprice) AS v FROM planted GROUP BY ALL UNION ALL SELECT 'status', o_orderstatus, sum(o_totalprice) FROM planted GROUP BY ALL),
    found AS (
        SELECT 1 AS place, 'quality' AS kind, CASE WHEN mn >= 0 AND held / total >= 0.2 THEN 'warn' ELSE 'info' END AS severity, 'amount' AS subject FROM odd o, whole WHERE o.n > 0
        UNION ALL SELECT 2, 'quality', 'info', 'negative' FROM planted WHERE o_totalprice < 0 HAVING count(*) >= 3
        UNION ALL SELECT 3, 'change', CASE WHEN total > 0 AND (abs(delta / total) < 0.25 OR delta > 0) THEN 'good' ELSE 'warn' END, dimension FROM chief
        UNION ALL SELECT 4 + row_number() OVER (ORDER BY abs(score) DESC, "day") / 10.0, 'anomaly', 'warn', "day" FROM days
        UNION ALL SELECT 5, 'trend', CASE WHEN c > 0 THEN 'good' ELSE 'warn' END, 'amount' FROM trend WHERE abs(c) >= 5
        UNION ALL SELECT * FROM (SELECT 6 + row_number() OVER (ORDER BY abs(z) DESC, period) / 10.0 AS place, 'anomaly' AS kind, 'warn' AS severity, period::VARCHAR AS subject FROM periods WHERE abs(z) > 3.5 AND (SELECT count(*) FROM days) = 0 AND (SELECT count(*) FROM months) >= 6) WHERE place < 6.25
        UNION ALL SELECT 7 + CASE dimension WHEN 'priority' THEN 0.1 ELSE 0.2 END, 'driver', 'info', dimension FROM groups GROUP BY dimension HAVING count(*) >= 3 AND min(v) >= 0 AND max(v) / sum(v) > greatest(0.35, 1.5 / count(*))
        UNION ALL SELECT 8 + rank / 10.0, 'driver', CASE WHEN change > 0 THEN 'good' ELSE 'warn' END, dimension FROM ({_MOVED}) WHERE rank <= 2
    )
    SELECT row_number() OVER (ORDER BY kind = 'quality', CASE severity WHEN 'warn' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, kind <> 'change', place)::INT AS rank, kind, severity, subject FROM found
    QUALIFY rank <= 8
""")
def findings_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = _planted(spark, sf_dir)
    return insights.insights(planted, roles.roles(planted)).select("rank", "kind", "severity", "subject")


#: Series with holes and several values a period: name, time, orders taken, frequency, number of a period, and its first day.
_RAGGED = {
    "weeks": ("date_trunc('week', d)::DATE", "week(d) % 5 <> 0", "W", "(t - DATE '1970-01-05') // 7", "DATE '1970-01-05' + (7 * i)::INT"),
    "months": ("date_trunc('month', d)::DATE", "month(d) <> 4", "MS", "12 * (year(t) - 1970) + month(t) - 1", "(DATE '1970-01-01' + to_months(i::INT))::DATE"),
    "quarters": ("date_trunc('quarter', d)::DATE", "true", "QS", "4 * (year(t) - 1970) + quarter(t) - 1", "(DATE '1970-01-01' + to_months((3 * i)::INT))::DATE"),
    "year starts": ("d", "month(d) = 1 AND day(d) = 1 AND d < DATE '2000-01-01'", "YS", "year(t) - 1970", "(DATE '1970-01-01' + to_years(i::INT))::DATE"),
}
_RAGGED_SQL = f"""
    o AS (SELECT o_orderdate::DATE AS d, CASE WHEN o_orderkey % 41 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 43 > 0 THEN o_totalprice END AS v FROM orders WHERE o_orderdate IS NOT NULL),
    t AS ({" UNION ALL ".join(f"SELECT '{k}' AS series, d, {at} AS t, v FROM o WHERE {which}" for k, (at, which, *_) in _RAGGED.items())}),
    n AS (SELECT series, CASE series {" ".join(f"WHEN '{k}' THEN {i}" for k, (_, _, _, i, _) in _RAGGED.items())} END AS i, v FROM t),
    p AS (SELECT series, i, sum(v) FILTER (NOT isnan(v)) AS y, count(v) FILTER (NOT isnan(v)) AS n, count(v) FILTER (isnan(v)) AS odd FROM n GROUP BY ALL),
    e AS (SELECT series, min(i) FILTER (n > 0) AS a, max(i) FILTER (n > 0) AS b, max(i) AS z, count(*) FILTER (n > 0) AS observed, sum(greatest(n - 1, 0)) AS merged, sum(odd) AS odd FROM p GROUP BY ALL)
"""


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    key = F.col("o_orderkey")
    v = F.when(key % 41 == 0, float("nan")).when(key % 43 > 0, F.col("o_totalprice"))
    day = table(spark, sf_dir, "orders").where("o_orderdate is not null").select(F.to_date("o_orderdate").alias("d"), v.alias("v"))
    first = (F.month(d) == 1) & (F.dayofmonth(d) == 1) & (d < F.lit("2000-01-01").cast("date"))
    times = {"weeks": F.when(F.weekofyear(d) % 5 != 0, F.trunc(d, "week")), "months": F.when(F.month(d) != 4, F.trunc(d, "month")), "quarters": F.trunc(d, "quarter"), "year starts": F.when(first, d)}
    return day.select("v", F.explode(F.array(*[F.struct(F.lit(k).alias("series"), t.alias("t")) for k, t in times.items()])).alias("x")).select("x.*", "v").where("t is not null")


@query(f"""
    WITH {_RAGGED_SQL},
    spine AS (SELECT series, unnest(range(a, b + 1)) AS i FROM e WHERE observed >= 8),
    dense AS (SELECT s.series, s.i, y, row_number() OVER (PARTITION BY s.series ORDER BY s.i) - 1 AS k FROM spine s LEFT JOIN p ON p.series = s.series AND p.i = s.i AND p.n > 0),
    sided AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(y IGNORE NULLS) OVER b AS py, first_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER f AS qk, first_value(y IGNORE NULLS) OVER f AS qy FROM dense
        WINDOW b AS (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, CASE series {" ".join(f"WHEN '{k}' THEN '{f}'" for k, (_, _, f, _, _) in _RAGGED.items())} END AS frequency, CASE series WHEN 'weeks' THEN 52 WHEN 'months' THEN 12 WHEN 'quarters' THEN 4 ELSE 1 END::INT AS season, k::INT AS i,
        CASE series {" ".join(f"WHEN '{k}' THEN {at}" for k, (_, _, _, _, at) in _RAGGED.items())} END::VARCHAR AS period, round(coalesce(y, py + (qy - py) * (k - pk) / greatest(qk - pk, 1)), 1) AS y, y IS NULL AS filled FROM sided
""")
def prepared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare.prepare(_ragged(spark, sf_dir), "series", "t", "v")[0]
    return rounded(ready.withColumn("period", F.to_date("period").cast("string")), 1, "y")


@query(f"""
    WITH {_RAGGED_SQL}, g AS (SELECT e.series, sum((p.i IS NULL OR p.n = 0)::INT) AS gaps, count(*) AS periods FROM (SELECT series, unnest(range(a, b + 1)) AS i FROM e WHERE observed >= 8) e LEFT JOIN p ON p.series = e.series AND p.i = e.i GROUP BY ALL)
    SELECT e.series, CASE WHEN observed >= 8 THEN 'ok' ELSE 'refused' END AS status, CASE WHEN observed >= 8 THEN '' ELSE 'fewer than 8 periods with data' END AS reason,
        coalesce(periods, 0)::BIGINT AS periods, observed::BIGINT AS observed, merged::BIGINT AS merged, coalesce(gaps, 0)::BIGINT AS gaps, (z - b)::BIGINT AS cut, odd::BIGINT AS odd FROM e LEFT JOIN g ON g.series = e.series
""")
def prepared_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare(_ragged(spark, sf_dir), "series", "t", "v")[1].select("series", "status", "reason", "periods", "observed", "merged", "gaps", "cut", "odd")


@query(None)
def forecast_ragged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six periods ahead of series of different frequencies, with refusals and caveats as rows."""
    return fitted.forecast_series(_ragged(spark, sf_dir), "series", "t", "v")


@query(f"""
    WITH {_MONTHS}, kept AS (SELECT * FROM series WHERE period < (SELECT CASE WHEN last_day(max(o_orderdate)::DATE) - max(o_orderdate)::DATE > 2 THEN date_trunc('month', max(o_orderdate)) ELSE max(o_orderdate) END FROM orders)),
    bars AS (SELECT 2 AS chart, 'priority' AS d, o_orderpriority AS x, sum(o_totalprice) AS y FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL UNION ALL SELECT 3, 'status', o_orderstatus, sum(o_totalprice) FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY y DESC, x) AS place FROM bars)
    SELECT 1 AS chart, 'amount by month' AS title, 'line' AS kind, row_number() OVER (ORDER BY period)::INT AS place, period::VARCHAR AS x, round(y, 2) AS y FROM kept
    UNION ALL SELECT chart, 'amount by ' || d, 'bar', place::INT, x, round(y, 2) FROM ordered WHERE place <= 8
    UNION ALL SELECT 4, 'How amount is spread', 'hist', bin, NULL, n FROM ({SQL["histogram_prices"]})
""")
def starter_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    # the words for a bin are formatted apart from the query's rows
    return rounded(outputs.starter_charts(orders, roles.roles(orders)), 2, "y").withColumn("x", F.when(F.col("kind") != "hist", F.col("x")))


@query("SELECT to_json({'region': r_regionkey, 'name': r_name, 'ratio': CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_regionkey / 4 END, 'seen': CASE WHEN r_regionkey = 3 THEN NULL ELSE '2024-01-0' || (r_regionkey + 1) || 'T10:00:00' END})::VARCHAR AS row FROM region")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    ratio = F.when(key == 0, float("nan")).when(key % 2 == 0, float("inf")).otherwise(key / 4)
    seen = F.when(key != 3, F.make_timestamp(F.lit(2024), F.lit(1), key + 1, F.lit(10), F.lit(0), F.lit(0)))
    return outputs.json_rows(table(spark, sf_dir, "region").select(key.alias("region"), F.col("r_name").alias("name"), ratio.alias("ratio"), seen.alias("seen")))
