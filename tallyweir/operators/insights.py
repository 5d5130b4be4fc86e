"""The findings list of a table: every check as one typed relation, in the order a reader should see them.

Group and period checks read the cube of ``recommend.table_of``; exact
quantiles, entities, the latest change, pairs of measures and segment shifts
take their own passes. Findings are few, so they are ranked on the driver and
handed back as a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators import findings, frequency, pairs, periods, segments
from tallyweir.operators.recommend import Table, entities_of, table_of
from tallyweir.operators.roles import COST, has, outlier_examples, repeated_rows

# Fixed value: labels of which more is worse.
BAD_LABEL = r"overdue|unpaid|pending|cancel|expired|refund|return|fail|late|outstanding|absent|dropout|churn|no[ _-]?show|reject|defect|lost|inactive|unresolved|open"
SEVERITY = {"warn": 0, "good": 1, "info": 2}
SCHEMA = "rank int, kind string, severity string, subject string, title string, detail string, action string, evidence string"
#: Findings shown, and how many of them may be about single groups.
MOST, MOST_SEGMENTS = 8, 3


@dataclass(frozen=True)
class Finding:
    kind: str
    severity: str
    subject: str
    title: str
    detail: str
    action: str
    evidence: dict = field(default_factory=dict)


def short(x: float) -> str:
    """A number as a reader takes it in: millions, whole numbers, or three digits."""
    size = abs(x)
    return f"{x / 1e6:,.1f}M" if size >= 1e7 else f"{x:,.0f}" if size >= 1000 else f"{x:,.1f}" if size >= 10 else f"{x:.3g}"


def how_far(seen: float, expected: float) -> str:
    """How a value compares with what was expected: as a multiple from three times on, else in percent."""
    if expected > 0 and seen >= 100 * expected:
        return "over 100 times"
    if expected > 0 and seen >= 3 * expected:
        return f"{seen / expected:.0f} times"
    return f"{100 * abs(seen - expected) / max(abs(expected), 1e-12):.0f} % {'over' if seen > expected else 'under'}"


def label_of(df: DataFrame, dimension: str, label: str) -> str:
    """A readable name for one value: ``promo = Yes`` for yes/no columns, else the value."""
    return f"{dimension} = {'Yes' if label == 'true' else 'No'}" if dict(df.dtypes).get(dimension) == "boolean" else label


def _quality(t: Table, notes: dict) -> list[Finding]:
    out, found = [], t.found
    if notes.get("sheets", 1) > 1:
        out.append(Finding("quality", "info", "sheet", f"Sheet {notes['sheet']} of {notes['sheets']} was read", "The other sheets take no part.", "Read them on their own if they matter."))
    keys = {found["metric"], found["date"], found["entity"]}
    for s in found["columns"]:
        if 20 < s["missing_pct"] < 100 and s["name"] in keys:
            out.append(Finding("quality", "warn", s["name"], f"{s['name']} is blank in {s['missing_pct']} % of the rows", "What is based on it may mislead.", f"Fill in {s['name']}.", {"missing_pct": s["missing_pct"]}))
    repeated = repeated_rows(t.df, found)
    if repeated:
        out.append(Finding("quality", "warn", "duplicates", f"{repeated:,} rows repeat another one", "They have the same record number too, so totals may count twice.", "Check them and drop the extra ones.", {"rows": repeated}))
    for s in found["columns"]:
        if s["name"] in found["dims"] and s["type"] == "string":
            written: dict[str, set] = {}
            for raw in t.of(s["name"])["label"].unique():
                written.setdefault(raw.strip(" ").lower(), set()).add(raw)
            several = sorted((sorted(v) for v in written.values() if len(v) > 1), key=lambda v: v[0])
            if several:
                out.append(Finding("quality", "warn", s["name"], f"{s['name']} is spelled in several ways", f"{' and '.join(several[0][:2])} count as different values.", f"Use one spelling in {s['name']}.", {"groups": len(several)}))
    return out


def _values(t: Table, mean: bool) -> list[Finding]:
    """Unusual values with the largest records behind them, and negative entries."""
    out, m = [], t.metric
    n = findings.profile_numbers(t.df, [m]).first()["outliers"]
    if n:
        share = next((r["share"] for r in outlier_examples(t.df, m, 1).collect()), None)
        shown = [c for c in dict.fromkeys([t.date, t.found["entity"], *t.found["dims"][:2], m]) if c and c in t.df.columns][:6]
        records = t.df.where(F.col(f"`{m}`").isNotNull()).orderBy(F.desc(f"`{m}`"), *[F.col(f"`{c}`").cast("string") for c in shown]).limit(min(10, n)).select(*[F.col(f"`{c}`").cast("string") for c in shown]).collect()
        evidence = {"count": n, "share": share, "record_columns": shown, "records": [list(r) for r in records]}
        out.append(Finding("quality", "warn" if (share or 0) >= 0.2 else "info", m, f"{n:,} unusual values of {m}", f"They lie far outside the usual range{f' and hold {100 * share:.0f} % of the total' if share and share >= 0.05 else ''}.", "Check that the largest records are real.", evidence))
    lost = t.cells[t.cells["dimension"] == ""]
    count, total = int(lost["lost_n"].sum()), float(lost["lost"].sum())
    if not mean and count >= 3:
        out.append(Finding("quality", "info", "negative", f"{count:,} entries are under zero, {short(total)} in all", "They look like refunds or corrections; totals are net of them.", "Decide whether totals should hold them.", {"count": count, "total": total}))
    return out


def _entities(t: Table) -> list[Finding]:
    e = entities_of(t)
    if e is None or e.count < 15 or e.least < 0 or e.total <= 0:
        return []
    share = sum(r["value"] for r in e.top) / e.total
    if share < 0.25:
        return []
    return [Finding("driver", "info", t.found["entity"], f"Five of {e.count} hold {100 * share:.0f} % of {t.metric}", f"{', '.join(str(r['label']) for r in e.top[:3])} come first.", "Watch for any of them that stops.", {"share": share, "top": [[str(r["label"]), r["value"]] for r in e.top]})]


def _change(t: Table) -> list[Finding]:
    """What moved the total between the last two equal windows, by the dimension where the movement is most concentrated."""
    dims = t.found["dims"][:3]
    rows = [r for r in frequency.last_change(t.df, t.date, t.metric, dims, t.grain).collect() if r["lead"]] if dims else []
    if not rows:
        return []
    before, after, cost = sum(r["before"] for r in rows), sum(r["after"] for r in rows), has(COST, t.metric)
    lead = max(rows, key=lambda r: (abs(r["delta"]), r["label"]))
    delta, share = after - before, lead["delta"] / (after - before)
    name = label_of(t.df, lead["dimension"], lead["label"])
    wanted = ((lead["delta"] > 0) != cost) != has(BAD_LABEL, name)
    good = (delta > 0) != cost and (abs(share) < 0.25 or wanted)
    per = f" per {lead['unit']}" if lead["unit"] else ""
    detail = f"{short(after)} against {short(before)}{' like for like' if per else ''}; by {lead['dimension']}, " + (f"{name} moved {short(lead['delta'])}, {100 * share:.0f} % of it." if abs(share) >= 0.25 else "no single value stands out.")
    evidence = {"dimension": lead["dimension"], "before": before, "after": after, "scale": lead["scale"], "contributions": sorted(([r["label"], r["delta"]] for r in rows), key=lambda x: -abs(x[1]))[:4]}
    return [Finding("change", "good" if good else "warn", lead["dimension"], f"{t.metric} {'rose' if delta > 0 else 'fell'} {100 * abs(delta / before):.0f} %{per}", detail, f"Look at {name} first." if abs(share) >= 0.25 else f"Look at several values of {lead['dimension']}.", evidence)]


def _trend(t: Table, mean: bool) -> list[Finding]:
    def change(series: list) -> float | None:
        k = max(2, len(series) // 3)
        first, last = sum(r["y"] for r in series[:k]) / k, sum(r["y"] for r in series[-k:]) / k
        return 100 * (last - first) / abs(first) if first else None

    if len(t.series) < 6:
        return []
    found, note = change(t.series), ""
    if found is not None and not mean and t.mega:
        rest = periods.trimmed(t.days(mega=False), "day", "v", "sum", t.grain).orderBy("period").collect()
        other = change(rest) if len(rest) == len(t.series) else None
        if other is not None and abs(other - found) >= 15:
            found, note = other, f" One record of {short(t.mega['value'])} is left out; with it the change is {found:+.0f} %."
    if found is None or abs(found) < 5:
        return []
    good = (found > 0) != has(COST, t.metric)
    k = max(2, len(t.series) // 3)
    return [Finding("trend", "good" if good else "warn", t.metric, f"{t.metric} is {'up' if found > 0 else 'down'} {abs(found):.0f} % over the whole time", f"The last {k} periods against the first {k}.{note}", "Find out what worked." if good else "Find out what changed, and act on it.", {"change_pct": found})]


def _days(t: Table) -> list[Finding]:
    days = findings.daily_anomalies(t.daily, "day", "v").collect()
    return [Finding("anomaly", "warn", str(r["day"]), f"{'Spike' if r['y'] > r['expected'] else 'Drop'} on {r['day']}", f"{short(r['y'])}, {how_far(r['y'], r['expected'])} the {short(r['expected'])} expected.", "Find out whether it is real.", {"score": r["score"]}) for r in days]


def _odd_periods(t: Table) -> list[Finding]:
    if len(t.series) < 6:
        return []
    series = t.df.sparkSession.createDataFrame([(r["period"], float(r["y"])) for r in t.series], "period date, y double")
    return [Finding("anomaly", "warn", str(r["period"]), f"Unusual period: {r['period']}", f"{short(r['y'])}, far from the usual.", "Find out whether it is real.", {"score": r["score"]}) for r in findings.period_outliers(series).collect()]


def _dominant(t: Table) -> list[Finding]:
    out = []
    for dim in t.found["dims"]:
        sums = t.sums(dim)
        total = sum(v for _, v in sums)
        if len(sums) >= 3 and sums[-1][1] >= 0 and total > 0 and sums[0][1] / total > max(0.35, 1.5 / len(sums)):
            name, share = label_of(t.df, dim, sums[0][0]), sums[0][1] / total
            out.append(Finding("driver", "info", dim, f"{name} holds {100 * share:.0f} % of {t.metric}", f"Of {len(sums)} values of {dim}.", f"Protect {name}, and try to grow the others.", {"share": share}))
    return out


def _moves(t: Table) -> list[Finding]:
    others = [c for c in t.found["metrics"] if c not in (t.metric, "records")]
    return [Finding("driver", "info", r["other"], f"{t.metric} moves with {r['other']}", f"Correlation {r['r']:.2f}; which of them causes the other is open.", f"Watch {r['other']} too.", {"r": r["r"]}) for r in (pairs.moves_with(t.df, t.metric, others).collect() if others else [])]


def _segments(t: Table, mean: bool) -> list[Finding]:
    dims = [d for d in t.found["dims"] if d in t.df.columns and 2 <= next(s["unique"] for s in t.found["columns"] if s["name"] == d) <= 30][:3]
    out = []
    if mean:
        best = [(r, d) for d in dims for r in findings.rating_gaps(t.df, d, t.metric).where("found").collect()]
        if best:
            r, d = max(best, key=lambda x: (abs(x[0]["z"]), x[1]))
            out.append(Finding("driver", "warn" if r["z"] < 0 else "good", d, f"{label_of(t.df, d, str(r['label']))} scores {'lowest' if r['z'] < 0 else 'highest'}: {r['mean']:.2f}", f"{r['n']:,} values.", "Find out why.", {"z": r["z"]}))
        return out
    if t.grain and dims:
        cost = has(COST, t.metric)
        for r in segments.segment_shifts(t.df, t.date, t.metric, dims, t.grain).where("rank <= 2").orderBy("rank").collect():
            wanted = ((r["change"] > 0) != cost) != has(BAD_LABEL, r["label"])
            out.append(Finding("driver", "good" if wanted else "warn", r["dimension"], f"{r['label']} {'rose' if r['change'] > 0 else 'fell'} {abs(r['change']):.0f} % while the total moved {r['overall']:+.0f} %", f"{short(r['recent'])} a period lately, {short(r['before'])} before.", f"Look at {r['label']} first.", {"label": r["label"], "change_pct": r["change"]}))
    measures = [t.metric, *[c for c in t.found["metrics"] if c not in (t.metric, "records")]]
    for r in (pairs.ratio_gaps(t.df, measures, dims).where("rank = 1").collect() if len(measures) > 1 and dims else []):
        worse = (r["ratio"] > r["overall"]) == has(BAD_LABEL, r["part"])
        out.append(Finding("driver", "warn" if worse else "info", r["dimension"], f"{r['label']}: {r['part']} is {100 * r['ratio']:.0f} % of {r['whole']}, {100 * r['overall']:.0f} % in all", f"{r['n']:,} records.", f"Find out what is different for {r['label']}.", {"label": r["label"], "ratio": r["ratio"]}))
    return out[:MOST_SEGMENTS]


def ordered(items: list[Finding], most: int = MOST) -> list[Finding]:
    """Notes on data quality last, then by severity, the latest change ahead of its equals; else as they came."""
    return sorted(items, key=lambda x: (x.kind == "quality", SEVERITY[x.severity], x.kind != "change"))[:most]


def insights(df: DataFrame, found: dict, notes: dict | None = None, most: int = MOST) -> DataFrame:
    """(rank, kind, severity, subject, title, detail, action, evidence) of the ``most`` important findings on a table with its roles.

    ``evidence`` is JSON. ``notes`` may hold ``sheet`` and ``sheets`` of a
    workbook. A table without a measure has notes on its quality only; one
    without a date, nothing on periods; averages are compared as averages.
    """
    metric = found["metric"]
    if metric is None:
        items = _quality(Table(df, found, pd.DataFrame(columns=["dimension", "label", "period", "v", "rows"]), df), notes or {})
    else:
        t, mean = table_of(df, found), metric in found["means"]
        items = _quality(t, notes or {}) + _values(t, mean)
        if not mean:
            items += _entities(t)
        if t.grain:
            if mean:
                t.series = periods.trimmed(df, t.date, metric, "mean", t.grain).orderBy("period").collect()
            days = [] if mean else _days(t)
            # the check by day is the finer one
            items += ([] if mean else _change(t)) + days + _trend(t, mean) + ([] if days else _odd_periods(t))
        items += ([] if mean else _dominant(t)) + _moves(t) + _segments(t, mean)
    rows = [(i + 1, x.kind, x.severity, x.subject, x.title, x.detail, x.action, json.dumps(x.evidence, default=str)) for i, x in enumerate(ordered(items, most))]
    return df.sparkSession.createDataFrame(rows, SCHEMA)
