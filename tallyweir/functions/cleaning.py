"""Column cleaning: null tokens, formatted numbers, dates, yes/no values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Column = F.Column

#: Texts that stand for no value; a fixed list.
NULL_TOKENS = ("", "n/a", "na", "null", "none", "#n/a", "<na>", "-")
#: Texts of yes and no; fixed lists.
TRUE, FALSE = ("true", "yes", "y", "t"), ("false", "no", "n", "f")
#: Written dates with a month's name, each tried on texts of its shape only: a failed parse costs far more than a look at the shape.
DATE_FORMATS = {
    "d MMM yyyy": r"\d{1,2} [A-Za-z]{3} \d{4}",
    "MMM d, yyyy": r"[A-Za-z]{3} \d{1,2}, \d{4}",
    "MMMM d, yyyy": r"[A-Za-z]+ \d{1,2}, \d{4}",
    "dd-MMM-yy": r"\d{2}-[A-Za-z]{3}-\d{2}",
}
#: Labels of a month and a year of two digits.
LABEL_FORMATS = {
    "MMM-yy": r"[A-Za-z]{3}-\d{2}",
    "MMM yy": r"[A-Za-z]{3} \d{2}",
    "MMMM-yy": r"[A-Za-z]{4,}-\d{2}",
    "MMMM yy": r"[A-Za-z]{4,} \d{2}",
}
#: Three numbers whose order of day and month is open; year first; a day with its time and perhaps an offset.
PARTS_SHAPE = r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{2})$"
YEAR_SHAPE = r"^\d{4}(-\d{1,2}-\d{1,2}|/\d{1,2}/\d{1,2}|-\d{2})$"
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
#: What a pattern calls white space.
WHITE = " \t\n\x0b\x0c\r"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def cleaned_text(c: Column) -> Column:
    """Trimmed text, with null tokens as null."""
    bare = F.btrim(c, F.lit(WHITE))
    return F.when(~F.lower(bare).isin(*NULL_TOKENS), bare)


def number_of(c: Column, decimal_comma: bool = False) -> Column:
    """A number with currency signs, percent, brackets or a trailing minus for negatives, or grouping; else null."""

    def read(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")") | t.endswith("-")
        bare = F.regexp_replace(t, r"[$€£₹¥%()\s'\u00a0]|-$", "")
        plain = F.translate(F.translate(bare, ".", ""), ",", ".") if decimal_comma else F.translate(bare, ",", "")
        value = once(plain, lambda x: F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), x).try_cast("double"))
        return once(F.struct(negative.alias("minus"), value.alias("value")), lambda x: F.when(x["minus"] & (x["value"] > 0), -x["value"]).otherwise(x["value"]))

    return once(F.translate(cleaned_text(c), "\u2212", "-"), read)


def boolean_of(c: Column) -> Column:
    t = F.lower(cleaned_text(c))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def date_fields(c: Column) -> Column:
    """Every reading of a written date, from one look at it, as a struct.

    ``day`` and ``month`` (timestamps without zone, null where impossible) read
    three bare numbers day or month first and are equal for all other forms;
    ``label`` reads a month and a year of two digits; ``offset`` is the distance
    from UTC in seconds that stands behind a time. No reading raises inside, so
    a column of other texts costs only the look.
    """

    def named(t: Column, formats: dict[str, str]) -> Column:
        text = F.regexp_replace(t, r"(?i)\bsept\b", "Sep")
        parsed = once(text, lambda x: F.coalesce(*[F.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(x, F.lit(f))) for f, shape in formats.items()]))
        return F.when(t.rlike("[A-Za-z]{3}"), parsed).cast("timestamp_ntz")

    def read(t: Column) -> Column:
        stamp = lambda x: x.try_cast("timestamp_ntz")

        def ordered(p: Column) -> Column:
            year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
            return F.struct(stamp(F.concat_ws("-", year, p[1], p[0])).alias("day"), stamp(F.concat_ws("-", year, p[0], p[1])).alias("month"))

        bare = F.when(t.rlike(PARTS_SHAPE), once(F.split(t, "[-/.]"), ordered))
        timed = F.when(t.rlike(TIME_SHAPE), F.struct(stamp(F.regexp_replace(t, r"\s*" + OFFSET, "")).alias("wall"), F.regexp_extract(t, OFFSET, 1).alias("zone")))
        plain = F.when(t.rlike(YEAR_SHAPE), stamp(F.translate(t, "/", "-")))
        found = F.struct(bare.alias("bare"), timed.alias("timed"), F.coalesce(plain, named(t, DATE_FORMATS)).alias("other"), named(t, LABEL_FORMATS).alias("label"))

        def chosen(x: Column) -> Column:
            zone, rest = x["timed"]["zone"], F.coalesce(x["timed"]["wall"], x["other"])
            minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
            offset = F.when(zone == "Z", 0).when(zone.startswith("-"), -60 * minutes).when(zone != "", 60 * minutes)
            return F.struct(F.coalesce(x["bare"]["day"], rest).alias("day"), F.coalesce(x["bare"]["month"], rest).alias("month"), x["label"].alias("label"), offset.alias("offset"))

        return once(found, chosen)

    return once(cleaned_text(c), read)


def date_from(fields: Column, day_first: bool = True, utc: bool = True, labels: bool = True) -> Column:
    """The timestamp of :func:`date_fields`; ``utc`` shifts times with an offset to UTC, else the clock's time stays. Zones are dropped."""

    def read(x: Column) -> Column:
        wall = x["day" if day_first else "month"]
        moved = F.when(x["offset"].isNotNull(), wall - F.make_dt_interval(secs=x["offset"].cast("decimal(18,6)"))).otherwise(wall) if utc else wall
        return (F.coalesce(moved, x["label"]) if labels else moved).cast("timestamp")

    return once(fields, read)


def date_of(c: Column, day_first: bool = True, utc: bool = True) -> Column:
    """A timestamp from the common written forms; impossible dates are null."""
    return date_from(date_fields(c), day_first, utc)


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


#: Rows of short columns up to this number are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def changed_spellings(counts: DataFrame) -> DataFrame:
    """(raw, best) of the spellings that are not the commonest of theirs, from (raw, n); ties go to the smaller text."""
    keyed = counts.withColumn("key", F.lower(F.trim("raw")))
    best = keyed.groupBy("key").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("best"), F.count("*").alias("k")).where("k > 1").select("key", "best")
    return keyed.join(best, "key").where("raw <> best").select("raw", "best")


def merge_spellings(df: DataFrame, column: str) -> DataFrame:
    """Spellings that differ in case or outer blanks become the commonest one, ties to the smaller text.

    Only changed spellings are joined to the table, by broadcast if a count shows that they are few.
    """
    text = F.col(f"`{column}`")
    changed = changed_spellings(df.where(text.isNotNull()).groupBy(text.alias("raw")).agg(F.count("*").alias("n"))).persist()
    try:
        many = changed.count()
        if not many:
            return df
        return respelled(df, column, changed if many > BROADCAST_ROWS else F.broadcast(df.sparkSession.createDataFrame(changed.collect(), "raw string, best string")))
    finally:
        changed.unpersist()


def respelled(df: DataFrame, column: str, changed: DataFrame) -> DataFrame:
    """``df`` with the spellings of ``changed`` (raw, best) replaced in ``column``."""
    text, names = F.col(f"`{column}`"), ["_raw", "_best"]
    while {n.lower() for n in df.columns} & set(names):
        names = [f"{n}_" for n in names]
    joined = df.join(changed.toDF(*names), text == F.col(names[0]), "left")
    return joined.withColumn(column, F.coalesce(F.col(names[1]), text)).select(*[F.col(f"`{c}`") for c in df.columns])
