"""Quantiles, pairs of measures, moved segments, frequencies and windows against plain Python."""

import datetime
import time

import numpy as np
import pandas as pd
import pytest

from tallyweir.operators import frequency, pairs, quantiles, segments

DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("fetched", [50_000, 60])
def test_exact_quantiles(spark, monkeypatch, fetched):
    monkeypatch.setattr(quantiles, "FETCHED", fetched)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "wide": rng.standard_cauchy(9_000) * 1e6,
        "same": np.where(rng.random(9_000) < 0.9, 5.0, rng.normal(0, 1, 9_000)),
        "holes": np.where(rng.random(9_000) < 0.5, np.nan, rng.lognormal(0, 4, 9_000)),
        "one": 7.0,
        "two": rng.integers(0, 2, 9_000).astype(float),
    })
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(frame).repartition(5), list(frame), p)
    for c in frame:
        x = frame[c].dropna()
        assert got[c].n == len(x) and (got[c].least, got[c].most) == (x.min(), x.max())
        assert np.allclose(got[c].quantiles, np.quantile(x, p), rtol=1e-12)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "`a.b` double, c double")
    assert quantiles.exact_quantiles(df, ["a.b", "c"], [0.5])["a.b"] == quantiles.Spread(0, None, None, (None,))
    assert quantiles.exact_quantiles(df.limit(0), ["c"], [0.5])["c"].n == 0 and quantiles.exact_quantiles(df, [], [0.5]) == {}
    assert quantiles.exact_quantiles(spark.createDataFrame([(3.0,)], "c double"), ["c"], [0.3])["c"].quantiles == (3.0,)


def _measures(rows, columns, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (rows, columns)) * rng.uniform(0.1, 1e5, columns) + rng.uniform(-1e6, 1e6, columns)
    x[rng.random(x.shape) < 0.1] = np.nan
    return pd.DataFrame(x, columns=[f"m{i}" for i in range(columns)])


def test_correlations_of_all_pairs(spark):
    frame = _measures(400, 9, 1)
    frame["near"] = frame["m1"] * 2 + frame["m2"].fillna(0) * 0.01
    frame["flat"] = 4.0
    got = {(r["first"], r["second"]): (r["n"], r["r"]) for r in pairs.correlated(pairs.pair_matrix(spark.createDataFrame(frame).repartition(3), list(frame))).collect()}
    want = frame.corr()
    for a in frame:
        for b in frame:
            if a != b and "flat" not in (a, b):
                assert got[a, b][0] == (frame[a].notna() & frame[b].notna()).sum() and got[a, b][1] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert not [k for k in got if "flat" in k]


def test_measure_that_moves_with_another(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(100, 10, 300)
    frame = pd.DataFrame({"sales": m, "copy": m * 3, "visits": m + rng.normal(0, 8, 300), "weak": m + rng.normal(0, 40, 300), "order_total": m + rng.normal(0, 6, 300), "against": -m + rng.normal(0, 5, 300)})
    df = spark.createDataFrame(frame)
    found = pairs.moves_with(df, "sales", ["copy", "visits", "weak", "order_total", "against"]).collect()
    assert [(r["other"], r["n"]) for r in found] == [("against", 300)] and found[0]["r"] == pytest.approx(frame["sales"].corr(frame["against"]))
    # a component by name, a copy, too weak, or too few rows
    assert pairs.moves_with(df, "sales", ["copy", "weak", "order_total"]).count() == 0
    assert pairs.moves_with(df.limit(49), "sales", ["visits"]).count() == 0 == pairs.moves_with(df.limit(0), "sales", []).count()


def test_many_measures_in_time(spark):
    frame = _measures(300, 250, 5)
    df = spark.createDataFrame(frame)
    pairs.pair_matrix(df.limit(10), ["m0", "m1"]).count()
    began = time.time()
    matrix = pairs.pair_matrix(df, list(frame))
    assert matrix.where("n > 0").count() == 250 * 249
    assert time.time() - began < 6


def _paid(rows=600, seed=4):
    rng = np.random.default_rng(seed)
    due = rng.uniform(50, 150, rows)
    kind = np.array(["a", "b", "c"])[np.arange(rows) % 3]
    paid = due * np.where(kind == "b", 0.3, 0.9)
    return pd.DataFrame({"class": kind, "town": np.array(["x", "y"])[np.arange(rows) % 2], "fee_due": due, "fee_paid": paid, "age": rng.uniform(5, 15, rows)})


def test_ratio_gaps(spark):
    frame = _paid()
    got = pairs.ratio_gaps(spark.createDataFrame(frame), ["fee_due", "fee_paid", "age"], ["class", "town"]).collect()
    first = min(got, key=lambda r: r["rank"])
    own = frame[frame["class"] == "b"]
    assert (first["part"], first["whole"], first["dimension"], first["label"], first["n"]) == ("fee_paid", "fee_due", "class", "b", 200)
    assert first["ratio"] == pytest.approx(own.fee_paid.sum() / own.fee_due.sum()) and first["overall"] == pytest.approx(frame.fee_paid.sum() / frame.fee_due.sum())
    assert not [r for r in got if r["dimension"] == "town"]
    # a negative part, too few rows, a measure mostly absent, or nothing at all
    for bad in (frame.assign(fee_paid=np.where(frame.index == 7, -1.0, frame.fee_paid)), frame.head(30), frame.assign(fee_paid=frame.fee_paid.where(frame.index % 5 > 0))):
        assert not [r for r in pairs.ratio_gaps(spark.createDataFrame(bad), ["fee_due", "fee_paid"], ["class"]).collect()]
    assert pairs.ratio_gaps(spark.createDataFrame(frame).limit(0), ["fee_due", "fee_paid"], ["class"]).count() == 0


def _sales(change, noise=0.0, days=400, end_cut=0):
    rng, rows = np.random.default_rng(6), []
    for i in range(days - end_cut):
        day = DAY + datetime.timedelta(days=i)
        for store in "ABC":
            level = 100.0 + (rng.normal(0, noise) if noise else 0.0)
            late = i >= days - 92
            rows.append((day, store, bool(i % 2), level * (change if store == "B" and late else 1.0)))
    return rows


SALES = "d timestamp, store string, promo boolean, net_sales double"


def _plain_shift(rows, store, recent=3, before=6):
    """Monthly sums of whole months, the way a person would do it."""
    frame = pd.DataFrame(rows, columns=["d", "store", "promo", "v"])
    months = frame.set_index("d")["v"].resample("MS").sum()
    if frame.d.min() > months.index[0] + pd.Timedelta(days=2):
        months = months.iloc[1:]
    if frame.d.max() < months.index[-1] + pd.offsets.MonthEnd(0) - pd.Timedelta(days=2):
        months = months.iloc[:-1]
    at = months.index[-(recent + before) :]
    s = frame[frame.store == store].set_index("d")["v"].resample("MS").sum().reindex(at).fillna(0.0)
    b, r = s.iloc[:before], s.iloc[before:]
    return b.mean(), r.mean(), 2.5 * b.std(ddof=1) * np.sqrt(1 / before + 1 / recent)


def test_segment_shifts(spark):
    rows = _sales(0.4)
    got = {(r["dimension"], r["label"]): r for r in segments.segment_shifts(spark.createDataFrame(rows, SALES), "d", "net_sales", ["store", "promo"]).collect()}
    assert set(got) == {("store", s) for s in "ABC"}
    assert [k for k, r in got.items() if r["found"]] == [("store", "B")] and got["store", "B"]["rank"] == 1
    for s in "ABC":
        b, r, noise = _plain_shift(rows, s)
        assert (got["store", s]["before"], got["store", s]["recent"], got["store", s]["noise"]) == pytest.approx((b, r, noise))


def test_segment_shifts_refused(spark):
    found = lambda rows, **k: segments.segment_shifts(spark.createDataFrame(rows, SALES), "d", "net_sales", ["store"], **k).where("found").count()
    assert found(_sales(0.85)) == 0  # under a quarter
    assert found([(d, s, p, v * (0.4 if d >= DAY + datetime.timedelta(days=308) and s != "B" else 1)) for d, s, p, v in _sales(0.4)]) == 0  # everyone moved
    assert found(_sales(0.7, noise=60.0, days=290)) == segments.segment_shifts(spark.createDataFrame(_sales(0.7, noise=60.0, days=290), SALES), "d", "net_sales", ["store"]).where("found and abs(recent - before) >= noise").count()
    small = [(d, s, p, v * (0.01 if s == "B" else 1)) for d, s, p, v in _sales(0.4)]
    assert found(small) == 0  # under 5 % of the total
    assert segments.segment_shifts(spark.createDataFrame(_sales(0.4, days=200), SALES), "d", "net_sales", ["store"]).count() == 0  # fewer than nine months
    few = [r for r in _sales(0.4) if r[1] != "B" or r[0].day == 1]
    assert found(few) == 0  # 14 rows
    assert segments.segment_shifts(spark.createDataFrame([], SALES), "d", "net_sales", ["store"]).count() == 0


def test_segment_shifts_noise_and_holes(spark):
    # a group that swings as much every month, and one that has months without a row
    rows = []
    for i in range(14):
        month = datetime.datetime(2023 + i // 12, i % 12 + 1, 15)
        for j in range(20):
            rows += [(month, "steady", True, 100.0), (month, "wild", True, 100.0 * (0.2 if i % 2 else 2.2) * (0.3 if i >= 10 else 1)), (month, "new", True, 200.0)] if i >= 8 or j else [(month, "steady", True, 100.0)]
    got = {r["label"]: r for r in segments.segment_shifts(spark.createDataFrame([r for r in rows if not (r[1] == "new" and r[0].month % 2)], SALES), "d", "net_sales", ["store"]).collect()}
    assert not got["wild"]["found"] and abs(got["wild"]["change"]) >= 25
    b, r, noise = _plain_shift([r for r in rows if not (r[1] == "new" and r[0].month % 2)], "new")
    assert (got["new"]["before"], got["new"]["recent"], got["new"]["noise"]) == pytest.approx((b, r, noise))


def test_segment_shifts_by_week(spark):
    rows = [(DAY + datetime.timedelta(days=i), s, True, 100.0 * (0.3 if s == "B" and i >= 49 else 1)) for i in range(70) for s in "ABC"]
    got = {r["label"]: r for r in segments.segment_shifts(spark.createDataFrame(rows, SALES), "d", "net_sales", ["store"], "D").collect()}
    assert got["B"]["found"] and got["B"]["before"] == pytest.approx(700) and got["B"]["recent"] == pytest.approx(210)


def _times(freq, n):
    return [t.to_pydatetime() for t in pd.date_range("2021-01-01", periods=n, freq=freq)]


def test_frequencies(spark):
    made = {f: _times(f, 30) for f in ("h", "D", "B", "W", "MS", "ME", "QS", "QE", "YS", "YE")}
    for f in ("D", "W", "MS", "QS"):
        made[f"{f} holes"] = [t for i, t in enumerate(_times(f, 40)) if i % 7 != 3]
    made["fortnight"], made["pair"], made["one"], made["other day"] = _times("14D", 12), _times("D", 2), _times("D", 1), _times("2D", 9)
    rows = [(k, t) for k, v in made.items() for t in [*v, v[0]]] + [("none", None), (None, DAY)]
    got = {r["series"]: r for r in frequency.frequencies(spark.createDataFrame(rows, "s string, t timestamp"), "s", "t").collect()}
    want = {f: f for f in ("h", "D", "B", "W", "MS", "ME", "QS", "QE", "YS", "YE")} | {f"{f} holes": f for f in ("D", "W", "MS", "QS")} | {"fortnight": None, "pair": "D", "one": None, "other day": None, None: None}
    assert {k: r["frequency"] for k, r in got.items()} == want
    assert all(got[k]["n"] == len(v) and (len(v) < 2 or got[k]["gap"] == pytest.approx(np.median(np.diff(np.array(v, "M8[s]")).astype(float)) / 86400)) for k, v in made.items())
    assert frequency.frequencies(spark.createDataFrame([], "s string, t timestamp"), "s", "t").count() == 0


@pytest.mark.parametrize(("grain", "want"), [("D", ("2024-03-03", "2024-03-10", "2024-03-17")), ("W", ("2024-01-22", "2024-02-19", "2024-03-18")), ("MS", ("2024-01-01", "2024-02-01", "2024-03-01")), ("YS", ("2022-01-01", "2023-01-01", "2024-01-01"))])
def test_last_windows(spark, grain, want):
    last = datetime.datetime(2023, 12, 31) if grain == "YS" else datetime.datetime(2024, 3, 16)
    days = spark.createDataFrame([(last - datetime.timedelta(days=i),) for i in range(800)], "d timestamp")
    got = [str(x) for x in frequency.last_windows(days, "d", grain).first()]
    assert got == [want[0], want[1], want[1], want[2]]
    assert frequency.last_windows(days.limit(3), "d", grain).count() == 0 == frequency.last_windows(days.limit(0), "d", grain).count()


def test_last_change_per_day(spark):
    rows = [(DAY + datetime.timedelta(days=i), "a" if i % 2 else "b", 10.0 if i < 31 else 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "d timestamp, k string, v double")
    assert frequency.last_change(df, "d", "v", ["k"]).count() == 0  # January to February is a change of days only
    more = df.union(spark.createDataFrame([(DAY + datetime.timedelta(days=40), "a", 100.0)], df.schema))
    got = {r["label"]: r for r in frequency.last_change(more, "d", "v", ["k"]).collect()}
    assert got["a"]["unit"] == "day" and got["a"]["scale"] == pytest.approx(29 / 31) and got["a"]["lead"]
    assert sum(r["delta"] for r in got.values()) == pytest.approx(390 - 310 * 29 / 31)
