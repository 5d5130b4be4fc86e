"""Column types of an all-text table: yes/no, numbers, dates; total lines; stray codes.

Every decision comes from all rows of all columns, by way of their distinct
texts, so a column's type does not depend on a sample. Empty columns stay text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import cleaning
from tallyweir.functions.cleaning import FALSE, TRUE, boolean_of, number_of

Column = F.Column

# Fixed patterns: names of codes, names that allow an encoded date, texts that look like dates, labels of total lines.
CODE_NAME = r"(^|_)(id|uuid|guid|zip|zipcode|postal|pin|pincode|phone|mobile|contact|ssn|ein|code|index|num|number|no|invoice|ticket|ref|reference|account|acct|roll|aadhaar|pan|gst)(_|$)"
SERIAL_NAME = r"(^|_)(date|dt|time|timestamp|day)(_|$)"
YEAR_NAME = r"(^|_)(year|yr|period|date)(_|$)"
EPOCH_NAME = r"(^|_)(timestamp|time|date)(_|$)"
TOTAL_TEXT = r"(?i)^\s*(grand\s+|sub\s*-?\s*)?totals?\s*:?\s*$"


#: What a text must look like for a column of it to be tried as dates.
DATE_TEXT = r"(?i)^(\d{1,4}[-/. ]\d{1,2}[-/. ]\d{1,4}|\d{4}-\d{1,2}$|\d{1,2}[-/ ]?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-/., ]+\d{1,4})"
#: A column's texts that are replaced by a small table of their values: at most so many distinct ones, each used MAP_USES times on average.
MAP_ROWS, MAP_USES = 20_000, 4


def dictionary(clean: DataFrame, texts: list[str]) -> DataFrame:
    """(at, text, n): the distinct texts of every column, numbered as in ``texts``, and how many rows hold them.

    Columns become rows, so one pass serves all of them and the generated code
    stays that of one column.
    """
    cells = clean.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").alias("text")) for i, c in enumerate(texts)])).alias("cell")).select("cell.*")
    return cells.where("text is not null").groupBy("at", "text").agg(F.count("*").alias("n"))


def read_once(book: DataFrame) -> DataFrame:
    """``book`` with every reading of its texts: dates day and month first, numbers with point and comma, and what the text looks like."""
    c = F.col("text")
    bare = F.regexp_replace(c, r"(?i)usd|eur|gbp|inr|rs\.?|[$€£¥₹%()\s']", "")
    first = book.select("at", "text", "n", cleaning.date_fields(c).alias("f"), cleaning.number_of(c, True).alias("as_comma"), cleaning.number_of(c, False).alias("as_point"), bare.alias("bare"), c.try_cast("double").alias("x"), F.when(c.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]"), F.split(c, "[-/.]")).alias("p"))
    x, b = F.col("x"), F.col("bare")
    return first.select(
        "at",
        "text",
        "n",
        "f",
        "as_comma",
        "as_point",
        F.lower("text").isin(*TRUE, *FALSE).alias("words"),
        c.rlike(r"^0\d{2,}").alias("padded"),
        (b.rlike(r"^-?\d{1,3}(\.\d{3})*,\d+$").cast("int") + b.rlike(r"^-?\d+,\d{1,2}$").cast("int")).alias("comma"),
        (b.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$").cast("int") + b.rlike(r"^-?\d+\.\d+$").cast("int")).alias("point"),
        x.between(30000, 60000).alias("serial"),
        c.rlike(r"^(19|20)\d{6}$").alias("compact"),
        c.rlike(r"^(19\d\d|20\d\d|2100)$").alias("years"),
        x.between(1e9, 2.5e9).alias("seconds"),
        x.between(1e12, 2.5e12).alias("millis"),
        c.rlike(DATE_TEXT).alias("dateish"),
        (F.col("p")[0].try_cast("int") > 12).alias("over_first"),
        (F.col("p")[1].try_cast("int") > 12).alias("over_second"),
    )


def statistics(readings: DataFrame) -> dict[int, dict]:
    """What :func:`reading` decides by, for each column: one row of it from all its texts, each as often as it occurs."""
    weigh = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    flags = ("words", "padded", "serial", "compact", "years", "seconds", "millis", "dateish", "over_first", "over_second")
    made = {"n": F.sum("n"), "distinct": F.count("*"), **{k: weigh(F.col(k)) for k in flags}, **{k: F.sum(F.col(k) * F.col("n")) for k in ("comma", "point")}, **{k: weigh(F.col(k).isNotNull()) for k in ("as_comma", "as_point")}}
    for k in ("day", "month", "label"):
        at = F.col(f"f.{k}")
        made |= {f"{k}_ok": weigh(at.isNotNull()), f"{k}_lo": F.min(F.year(at)), f"{k}_hi": F.max(F.year(at)), f"{k}_span": F.datediff(F.max(at), F.min(at))}
    made |= {"off_n": weigh(F.col("f.offset").isNotNull()), "off_lo": F.min("f.offset"), "off_hi": F.max("f.offset")}
    return {row["at"]: row.asDict() for row in readings.groupBy("at").agg(*[v.alias(k) for k, v in made.items()]).collect()}


def day_first(s: dict) -> bool:
    """A part over 12 decides; if neither shows one, the tighter span; else day first."""
    if s["over_first"] and not s["over_second"]:
        return True
    if s["over_second"]:
        return False
    if s["day_span"] is None or s["month_span"] is None:
        return True
    return s["day_span"] <= s["month_span"]


def reading(name: str, s: dict, c: Column) -> tuple[str, Column]:
    """(kind, expression) of a text column by its statistics."""
    n = s["n"]
    if not n or s["words"] == n:
        return ("boolean", boolean_of(c)) if n else ("text", c)
    share = lambda key: s[key] / n
    named = lambda pattern: re.search(pattern, name, re.I)
    number = c.try_cast("double")
    if named(SERIAL_NAME) and share("serial") > 0.8:
        return "date", F.timestamp_seconds((F.when(number.between(0, 2958465), number) - 25569) * 86400)
    if share("compact") > 0.8:
        return "date", F.try_to_timestamp(c, F.lit("yyyyMMdd"))
    if named(YEAR_NAME) and share("years") > 0.8:
        return "date", F.try_to_timestamp(F.concat(c, F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    if named(EPOCH_NAME) and share("seconds") > 0.8:
        return "date", F.timestamp_seconds(number)
    if named(EPOCH_NAME) and share("millis") > 0.8:
        return "date", F.timestamp_millis(number.cast("long"))
    first = day_first(s)
    key = "day" if first else "month"
    if s[f"{key}_ok"] < 0.5 * n and s["label_ok"] > s[f"{key}_ok"]:
        key = "label"
    if share("dateish") >= 0.8 and share(f"{key}_ok") > 0.75 and s[f"{key}_lo"] >= 1800 and s[f"{key}_hi"] <= 2200:
        if key == "label":
            return "date", cleaning.date_fields(c)["label"].cast("timestamp")
        # one offset in all rows: the clock's time stays; several, or times without one: all become UTC
        mixed = s["off_n"] > 0 and (s["off_lo"] != s["off_hi"] or s["off_n"] < s[f"{key}_ok"])
        return "date", cleaning.date_from(cleaning.date_fields(c), first, mixed, labels=False)
    comma = s["comma"] > s["point"]
    if not named(CODE_NAME) and not s["padded"] and s["as_comma" if comma else "as_point"] > 0.8 * n:
        return "number", number_of(c, comma)
    return "text", c


def typed(df: DataFrame, spellings: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The table with typed columns, and the kind of each text column.

    Null tokens become null first. Types are decided on the distinct texts of
    each column, weighted by their rows, and every text is read once. A column
    with few distinct dates or numbers gets its values from a table of them, of
    MAP_ROWS rows at most, by broadcast; others are read in place. With
    ``spellings``, spelling variants of text columns are merged from the same
    counts. A table without rows stays text.
    """
    texts = [c for c, kind in df.dtypes if kind == "string"]
    clean = df.withColumns({c: cleaning.cleaned_text(F.col(f"`{c}`")) for c in texts})
    if not texts:
        return clean, {}
    spark = df.sparkSession
    # texts are dealt evenly: a few distinct ones would else be read by one task
    book = read_once(dictionary(clean, texts).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))).persist()
    try:
        got = statistics(book)
        found = {c: reading(c, got.get(i, {"n": 0}), F.col(f"`{c}`")) for i, c in enumerate(texts)}
        few = {i: c for i, c in enumerate(texts) if found[c][0] in ("date", "number") and got[i]["distinct"] <= MAP_ROWS and MAP_USES * got[i]["distinct"] <= got[i]["n"]}
        out = clean.withColumns({c: e for i, (c, (_, e)) in enumerate(found.items()) if i not in few})
        maps: dict[int, list[tuple[str, str]]] = {i: [] for i in few}
        for i, c in few.items():
            value = found[c][1].cast("timestamp_ntz" if found[c][0] == "date" else "double").cast("string")
            maps[i] = [tuple(r) for r in book.where(F.col("at") == i).select(F.col("text").alias(c)).select(F.col(f"`{c}`").alias("text"), value.alias("value")).collect()]
        for i, c in few.items():
            kind = "timestamp_ntz" if found[c][0] == "date" else "double"
            out = _looked_up(out, c, spark.createDataFrame(maps[i], "text string, value string").select("text", F.col("value").cast(kind).cast("timestamp" if kind != "double" else kind).alias("value")))
        if spellings:
            plain = [i for i, c in enumerate(texts) if found[c][0] == "text"]
            out = _merged(out, book.where(F.col("at").isin(plain)), texts)
        return out, {c: kind for c, (kind, _) in found.items()}
    finally:
        book.unpersist()


def _looked_up(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column`` of ``df`` replaced by what ``values`` (text, value) has for it."""
    name = "_value"
    while name in (c.lower() for c in df.columns):
        name += "_"
    joined = df.join(F.broadcast(values.toDF(f"{name}text", name)), F.col(f"`{column}`") == F.col(f"{name}text"), "left")
    return joined.select(*[F.col(name).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def _merged(df: DataFrame, counts: DataFrame, texts: list[str]) -> DataFrame:
    """``df`` with spelling variants merged in all columns of ``counts`` (at, text, n)."""
    keyed = counts.select("at", F.col("text").alias("raw"), "n", F.lower(F.trim("text")).alias("key"))
    best = keyed.groupBy("at", "key").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("best"), F.count("*").alias("k")).where("k > 1").select("at", "key", "best")
    changed = keyed.join(best, ["at", "key"]).where("raw <> best").select("at", "raw", "best")
    sizes = {r["at"]: r["count"] for r in changed.groupBy("at").count().collect()}
    small = [i for i, n in sizes.items() if n <= MAP_ROWS]
    rows = changed.where(F.col("at").isin(small)).collect() if small else []
    for i in sizes:
        if i in small:
            own = df.sparkSession.createDataFrame([(r["raw"], r["best"]) for r in rows if r["at"] == i], "raw string, best string")
            df = cleaning.respelled(df, texts[i], F.broadcast(own))
        else:
            df = cleaning.merge_spellings(df, texts[i])
    return df


def without_total_lines(df: DataFrame, most: float = 0.05) -> DataFrame:
    """Rows whose text says "total" go, if they are at most ``most`` of the rows."""
    texts = [F.col(f"`{c}`") for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(c.rlike(TOTAL_TEXT), F.lit(False))
    n, hits = df.agg(F.count("*"), F.count_if(hit)).first()
    return df.where(~hit) if n and 0 < hits <= most * n else df


def without_sum_row(df: DataFrame, row_id: str) -> DataFrame:
    """The last row goes if each number in it is the sum of the rows above and few of its other cells are filled.

    Needs 6 rows. ``row_id`` gives the order of rows; a total of 0 says nothing and keeps the row.
    """
    kinds = {c: kind for c, kind in df.dtypes if c != row_id}
    numbers = [c for c, kind in kinds.items() if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")]
    others = [c for c in kinds if c not in numbers]
    if not numbers:
        return df
    # columns get plain names of their own, so that any name works
    flat = df.select(F.col(f"`{row_id}`").alias("at"), *[F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numbers)], *[F.col(f"`{c}`").isNotNull().cast("int").alias(f"o{i}") for i, c in enumerate(others)])
    rest = [x for x in flat.columns if x != "at"]
    got = flat.agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max_by(F.struct(*rest), "at").alias("last"), *[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(numbers))]).first()
    if got["n"] < 6:
        return df
    checked = 0
    for i in range(len(numbers)):
        value = got["last"][f"n{i}"]
        if value is None:
            continue
        above = got[f"s{i}"] - value
        if above == 0 or abs(value - above) > 1e-6 + 1e-6 * abs(above):
            return df
        checked += 1
    filled = sum(got["last"][f"o{i}"] for i in range(len(others)))
    if not checked or filled > max(1, len(others) // 2):
        return df
    return df.where(F.col(f"`{row_id}`") != got["at"])


def without_index_columns(df: DataFrame, row_id: str) -> DataFrame:
    """Columns ``index`` or ``unnamed_N`` that only count the rows from 0 go; ``row_id`` must count rows from 0."""
    names = [c for c in df.columns if re.fullmatch(r"unnamed_\d+|index", c)]
    if not names:
        return df
    got = df.agg(*[F.count_if(~F.col(c).try_cast("double").eqNullSafe(F.col(row_id).cast("double"))).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if got[c] == 0])


def without_stray_codes(df: DataFrame, column: str) -> DataFrame:
    """On a rating column, values under 0 or over 11 (codes such as 99) become null."""
    return df.withColumn(column, F.when(F.col(column).between(0, 11), F.col(column)))
