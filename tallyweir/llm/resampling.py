"""Importance resampling towards a target distribution, counting every distinct line once. DataFrame functions only.

Texts are cut into lines at ``\\n``, which separates words anyway. Features are
runs of 1 to ``longest`` words, hashed to ``buckets``. The features of a
distinct line are made once: their counts times the line's occurrences give the
corpus counts, and the sum of their gains is what the line adds to the weight of
each document that holds it. Runs that cross a line's end belong to one
document and are counted there, on their own. Gumbel noise of a hashed number
turns weights into scores, of which the highest are a draw without replacement.

Lines that are a share of 1 in ``HEAVY`` or more of all lines are at most
``HEAVY`` many; they are looked up by broadcast, and no other line can fill a
task of the join. Ranks need no global sort in one task: they are an offset by
score, from counts by score, plus a row number among equal scores.

Defined results: null and empty texts have no features, weight 0 and a score,
and are never drawn when ``least_words`` is over 0; repeated rows share their
score and take a rank each; ties go to the smaller id, a null id (hashed as an
empty text) comes last; texts of any length are read whole; an empty table, or
one smaller than it takes for one draw, draws nothing; an empty target gives
all features its smoothed count of one; columns other than doc_id and text
take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm._common import Scratch, if_few, stage
from tallyweir.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lines that make up 1 in HEAVY of all lines, or more, are joined by broadcast: HEAVY rows at most.
HEAVY = 10_000
#: Neighbouring scores whose counts are summed together first.
COARSE = 64


def words_of(text: F.Column) -> F.Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _bucket(feature: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _starts(words: F.Column, n: int) -> F.Column:
    """Where runs of ``n`` words begin, from 1."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))


def features_of(words: F.Column, longest: int, buckets: int) -> F.Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats included."""

    def runs(n: int) -> F.Column:
        return F.transform(_starts(words, n), lambda i: _bucket(F.array_join(F.slice(words, i, n), " "), buckets))

    return F.concat(F.transform(words, lambda w: _bucket(w, buckets)), *[runs(n) for n in range(2, longest + 1)])


def crossing_features(text: F.Column, longest: int, buckets: int) -> F.Column:
    """Buckets of the runs of up to ``longest`` words whose first and last word stand in different lines."""
    lines = F.split(text, "\n")
    placed = F.flatten(F.transform(lines, lambda line, i: F.transform(words_of(line), lambda w: F.struct(w.alias("w"), i.alias("i")))))

    def runs(words: F.Column, n: int) -> F.Column:
        across = F.filter(_starts(words, n), lambda i: words[i - 1]["i"] != words[i + (n - 2)]["i"])
        return F.transform(across, lambda i: _bucket(F.array_join(F.transform(F.slice(words, i, n), lambda x: x["w"]), " "), buckets))

    def made(words: F.Column) -> F.Column:
        return F.concat(*[runs(words, n) for n in range(2, longest + 1)])

    return let(placed, made)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): ``key`` tells apart texts of one id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))


def _hashed(line: str = "line") -> list[F.Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def distinct_lines(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(h1, h2, times, words, features) of every distinct line; lines without a word are one."""
    lines = _rows(docs).select(F.explode(F.split("text", "\n")).alias("line"))
    # equal lines meet before and after the exchange; words are looked for only then
    counted = lines.groupBy("line").agg(F.count("*").alias("times"))
    worded = counted.select(*_hashed(), "times", words_of(F.col("line")).alias("w"))
    return worded.select("h1", "h2", "times", F.size("w").cast("long").alias("words"), features_of(F.col("w"), longest, buckets).alias("features"))


def crossing_rows(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, key, features): a row's runs that cross the end of a line; rows without one are left out."""
    made = _rows(docs).select("doc_id", "key", crossing_features(F.col("text"), longest, buckets).alias("features"))
    return made.where(F.size("features") > 0)


def bucket_counts(lines: DataFrame, crossing: DataFrame | None) -> DataFrame:
    """(bucket, n) over all texts: features of distinct lines times their occurrences, and those across lines."""
    each = lines.select("times", F.explode("features").alias("bucket"))
    if crossing is not None:
        each = each.union(crossing.select(F.lit(1).cast("long").alias("times"), F.explode("features").alias("bucket")))
    return each.groupBy("bucket").agg(F.sum("times").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket from the two bucket counts: as many numbers as there are buckets, whatever the input."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    spine = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = both.union(spine).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = F.broadcast(counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t")))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    found = counts.join(total, F.lit(True)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    gains = [0] * buckets
    for row in found:
        gains[row["bucket"]] = row["gain"]
    return gains


def weighted(docs: DataFrame, lines: DataFrame, crossing: DataFrame | None, gains: list[int]) -> DataFrame:
    """(doc_id, key, copies, n_words, n_features, weight) of every distinct (doc_id, text); ``lines`` and ``crossing`` are staged."""
    # a text of the numbers is folded into one constant array when the plan is made
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    gain = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    known = lines.select("h1", "h2", "words", F.size("features").cast("long").alias("n"), gain.alias("gain"), "times")
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("times")).first()["times"]
    heavy = F.col("times") * HEAVY >= total
    placed = _rows(docs).select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "key", "pos", *_hashed())
    often = known.where(heavy).select("h1", "h2", *[F.col(c).alias(f"{c}_h") for c in ("words", "n", "gain")])
    marked = placed.join(F.broadcast(often), ["h1", "h2"], "left")
    easy = marked.where("n_h is not null").select("doc_id", "key", "pos", F.col("words_h").alias("words"), F.col("n_h").alias("n"), F.col("gain_h").alias("gain"))
    # Spark itself broadcasts these if they are small
    rare = known.where(~heavy).drop("times")
    others = marked.where("n_h is null").join(rare, ["h1", "h2"]).select("doc_id", "key", "pos", "words", "n", "gain")
    parts = easy.union(others)
    if crossing is not None:
        own = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
        parts = parts.union(crossing.select("doc_id", "key", F.lit(-1), F.lit(0).cast("long"), F.size("features").cast("long"), own))
    # repeated rows add the same sums again, as often as their first line occurs
    sums = parts.groupBy("doc_id", "key").agg(F.count_if(F.col("pos") == 0).alias("copies"), F.sum("words").alias("w"), F.sum("n").alias("n"), F.sum("gain").alias("g"))
    each = [F.expr(f"{c} div copies").alias(name) for c, name in (("w", "n_words"), ("n", "n_features"))]
    # both sums are multiples of copies; the division of the integers rounds towards zero, so a remainder under zero takes one off
    low = F.when(F.col("n") > 0, F.expr("g div n") - F.when(F.expr("g % n < 0"), 1).otherwise(0)).otherwise(0)
    return sums.select("doc_id", "key", "copies", *each, low.cast("long").alias("weight"))


def noisy(weight: F.Column, doc_id: F.Column, seed: int) -> F.Column:
    """``weight`` plus Gumbel noise, in thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, able: F.Column, percent: int) -> DataFrame:
    """``scored`` (staged; doc_id, score) with rank: 1, 2, 3, ... of the ``percent`` of the able rows that score highest."""
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("c")).withColumn("coarse", F.floor(F.col("score") / COARSE))
    # two short windows instead of one over all scores
    blocks = counts.groupBy("coarse").agg(F.sum("c").alias("b"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = blocks.select("coarse", before("b", Window.orderBy(F.desc("coarse"))).alias("above"))
    within = counts.select("score", "coarse", before("c", Window.partitionBy("coarse").orderBy(F.desc("score"))).alias("within"))
    total = F.broadcast(blocks.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("able")).select(F.expr(f"able * {percent} div 100").alias("drawn")))
    offsets = within.join(F.broadcast(above), "coarse").join(total, F.lit(True)).select("score", (F.col("above") + F.col("within")).alias("offset"), "drawn")
    # scores are whole numbers between fixed bounds, so there are not many
    placed = scored.withColumn("able", able).join(if_few(stage(offsets, "scores")), "score", "left")
    near = F.coalesce(F.col("able") & (F.col("offset") < F.col("drawn")), F.lit(False))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    drawn = placed.where(near).withColumn("rank", F.col("offset") + F.row_number().over(order)).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = placed.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``target`` needs a column text.

    Drawn rows, ``percent`` of those with ``least_words`` words, have a rank.
    """
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession, "resampling") as scratch:
        lines = scratch.stage(distinct_lines(docs, longest, buckets), "lines")
        crossing = scratch.stage(crossing_rows(docs, longest, buckets), "crossing") if longest > 1 else None
        goal = bucket_counts(distinct_lines(aim, longest, buckets), crossing_rows(aim, longest, buckets) if longest > 1 else None)
        gains = bucket_gains(bucket_counts(lines, crossing), goal, buckets)
        sums = weighted(docs, lines, crossing, gains)
        copied = sums.withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed).cast("long")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        scored = stage(copied.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("long_enough")), "scored")
    return ranked(scored, F.col("long_enough"), percent).select("doc_id", "n_features", "weight", "score", "rank")
