"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its target share of the output divided
by its share of the input. A row's count is the inverse of the Poisson
distribution of that mean at a uniform number hashed from the seed and the
row's id, so it does not depend on partitioning and repeats exactly. Rows are
exploded by their counts and shuffled by another hash of the copy.

Defined results: a null source is a source of its own; repeated rows draw the
same number (they are the same document); a row without an id draws by its text;
rows of a source with target weight 0 go; a source without a weight in an
explicit map keeps rate 1; null and empty texts, and texts of any length, count
as rows like others; an empty table stays empty; other columns are carried
along, whatever their names, but a column ``copy`` raises ValueError, because
that is the column added. The order repeats as long as the input's files do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._common import Scratch, stage, unused

#: Sources and steps of their distributions up to this number (about 8 MB) are joined by broadcast; beyond it, by shuffle.
BROADCAST_NUMBERS = 1_000_000


def uniform(*parts: F.Column | str) -> F.Column:
    """A uniform number in (0, 1) from 52 bits of an MD5 of the parts; the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, scratch: Scratch) -> DataFrame:
    """(source_key, rate, tails) of each source, one row per source.

    Target shares are ``weights`` (normalised over the sources they name), or
    the input shares to the power ``temperature``. ``tails`` is the Poisson
    distribution function at 0, 1, 2, ... until it no longer changes.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    counts = docs.groupBy(key.alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (f"s{k}", float(v))]
        counts = counts.withColumn("w", F.try_element_at(F.create_map(*pairs), F.col("source_key")) if pairs else F.lit(None).cast("double"))
    counts = scratch.stage(counts, "sources")
    total = counts.where("w is not null").agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rated = counts.crossJoin(F.broadcast(total)).withColumn("rate", F.coalesce(F.try_divide(F.col("all_n") * F.col("w"), F.col("all_w") * F.col("n")), F.lit(1.0)))
    last = (F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    # log of the probability of k, for each k, then running sums
    steps = F.when(F.col("rate") > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), F.exp(k * F.ln("rate") - F.col("rate") - _log_factorial(k)).alias("p"))))
    sums = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<double>)").alias("tails")),
        lambda acc, x: F.struct((acc["s"] + x["p"]).alias("s"), F.concat(acc["tails"], F.array(acc["s"] + x["p"])).alias("tails")),
    )
    return rated.select("source_key", "n", "rate", F.coalesce(sums["tails"], F.array(F.lit(1.0))).alias("tails"))


def _log_factorial(k: F.Column) -> F.Column:
    """ln k!: a sum of logarithms for small k, Stirling's series beyond."""
    x = k + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    small = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(30))), F.lit(0.0), lambda a, i: a + F.ln(F.greatest(i, F.lit(1)).cast("double")))
    return F.when(k <= 30, small).otherwise(series)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 1) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in globally shuffled order; adds ``copy`` (from 1).

    The output is dealt to partitions by a hash of the copy and sorted by a
    second hash inside them, which is a uniform order in one exchange.
    """
    if "copy" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column copy, which is made here")
    key, tails, copies, place, number = unused(docs, "source_key", "tails", "copies", "shuffle_key", "row_number")
    with Scratch(docs.sparkSession, "mixing") as scratch:
        rates = scratch.stage(source_rates(docs, weights, temperature, scratch).select("source_key", "tails").toDF(key, tails), "rates")
        numbers = rates.agg(F.coalesce(F.sum(F.size(tails)), F.lit(0)) + F.count("*")).first()[0]
        few = numbers <= BROADCAST_NUMBERS
        rates = F.broadcast(docs.sparkSession.createDataFrame(rates.collect(), rates.schema)) if few else stage(rates, "rates")
    # numbered before any exchange: a row keeps its number when a lost executor's share is computed again
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).withColumn(number, F.monotonically_increasing_id())
    joined = keyed.join(rates, key)
    drawn = uniform(f"poisson-{seed}", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    # the array around the number binds it once, or it would be hashed anew for each step of the distribution
    count = F.transform(F.array(drawn), lambda u: F.size(F.filter(tails, lambda t: t < u)))[0]
    counted = joined.withColumn(copies, count).where(F.col(copies) > 0)
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies))))
    # the running number keeps a row that is repeated many times from landing in one task
    dealt = copied.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", "copy", "text", number))
    return dealt.repartition(place).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), place), "doc_id", "copy").select(*docs.columns, "copy")
