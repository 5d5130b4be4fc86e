"""Daily levels kept up by a stream against the batch query: replay, late and repeated rows, restarts."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest

from tallyweir.operators import findings
from tallyweir.sources.shared import followed
from tallyweir.streaming import levels

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "id bigint, at timestamp, v double, shop string"


def _events(days=90, seed=8):
    rng, rows = np.random.default_rng(seed), []
    for i in range(days * 6):
        day = i // 6
        if day in (40, 41):
            continue  # days without a row
        rows.append((i, DAY + datetime.timedelta(days=day, hours=int(rng.integers(0, 24))), float(rng.uniform(80, 120)) * (30 if day == 60 else 1), "ab"[i % 2]))
    return rows


def _write(spark, folder, parts):
    for rows in parts:
        frame = pd.DataFrame(rows, columns=["id", "at", "v", "shop"]).astype({"id": "Int64", "v": float, "shop": object})
        frame["at"] = frame["at"].astype("datetime64[us]").dt.tz_localize("UTC")
        n = len(list(folder.iterdir()))
        frame.to_parquet(folder / f"{n:03d}.parquet", index=False)
        os.utime(folder / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age


def _level(found):
    return {(r["series"], str(r["day"])): (round(r["y"], 6), None if r["mid"] is None else round(r["mid"], 6)) for r in found.collect()}


def _plain(rows, key=lambda r: ""):
    out = {}
    frame = pd.DataFrame(rows, columns=["id", "at", "v", "shop"]).drop_duplicates("id")
    frame["s"] = [key(r) for r in frame.itertuples()]
    for s, own in frame.groupby("s"):
        y = own.set_index("at")["v"].resample("D").sum()
        mid = y.rolling(29, center=True, min_periods=15).median()
        out |= {(s, str(t.date())): (round(y[t], 6), None if np.isnan(mid[t]) else round(mid[t], 6)) for t in y.index}
    return out


@pytest.fixture()
def source(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    return folder


def test_replay_with_late_and_repeated_rows(spark, tmp_path, source):
    rows = _events()
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for a, b in zip(parts, parts[1:], strict=False):
        b.append(a.pop())  # late by a file
        b.append(b[0])  # twice in one file
        b.append(a[-1])  # and again from the file before
    _write(spark, source, parts)
    levels.advance(spark, followed(spark, str(source), 1), str(tmp_path / "place"), "id", "at", "v", delay_days=15)
    assert _level(levels.levels(spark, str(tmp_path / "place"))) == _plain(rows)
    got = levels.anomalies(spark, str(tmp_path / "place")).collect()
    want = findings.daily_anomalies(spark.createDataFrame(rows, SCHEMA), "at", "v").collect()
    assert [str(r["day"]) for r in got] == ["2024-03-01", "2024-02-10"] and [(r["day"], round(r["score"], 6)) for r in got] == [(r["day"], round(r["score"], 6)) for r in want]


def test_goes_on_after_a_stop(spark, tmp_path, source):
    rows, place = _events(), str(tmp_path / "place")
    _write(spark, source, [rows[:200]])
    levels.advance(spark, followed(spark, str(source), 1), place, "id", "at", "v", "shop", delay_days=3)
    assert _level(levels.levels(spark, place)) == _plain(rows[:200], lambda r: r.shop)
    levels.advance(spark, followed(spark, str(source), 1), place, "id", "at", "v", "shop", delay_days=3)  # nothing new
    _write(spark, source, [rows[200:350], rows[350:]])
    levels.advance(spark, followed(spark, str(source), 1), place, "id", "at", "v", "shop", delay_days=3)
    assert _level(levels.levels(spark, place)) == _plain(rows, lambda r: r.shop)


def test_rows_later_than_the_delay_are_dropped(spark, tmp_path, source):
    rows, place = _events(), str(tmp_path / "place")
    late = (10_000, DAY + datetime.timedelta(days=5), 1e6, "a")
    _write(spark, source, [rows[:300], rows[300:], [late, (None, None, None, None), (10_001, DAY + datetime.timedelta(days=89), None, "a")]])
    levels.advance(spark, followed(spark, str(source), 1), place, "id", "at", "v", delay_days=2)
    assert _level(levels.levels(spark, place)) == _plain(rows)
    # the state holds a batch's days, those that can still change and the 28 before them, and no more
    run = levels._updated(2)

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, day = State(), datetime.date(2020, 1, 1)
    for i in range(0, 400, 40):
        list(run(("",), iter([pd.DataFrame({"day": [day + datetime.timedelta(days=i + j) for j in range(40)], "v": 1.0})]), state))
        assert len(state.get[3]) <= 40 + 2 + 1 + 2 * levels.REACH + 1
