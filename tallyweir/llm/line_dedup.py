"""Fuzzy line deduplication over the whole corpus, in DataFrame functions only.

A line's set holds hashes of its character shingles (``shingle`` UTF-16 units).
Minimum hashes of all shingles come from one generated-code aggregation, which
merges equal lines at the same time. Bands of the signatures propose pairs, the
exact Jaccard index of the full shingle sets confirms them, and a distributed
union-find groups the lines; see ``linked`` for how hot buckets stay linear. Of
each component the first line stays, in order of doc_id and place.

Lines are what a split at ``\\n`` gives. Defined results: null text has no
lines; lines of white space only are never removed and take no part; a line
shorter than a shingle is one shingle; repeated rows (same doc_id and text)
count as one document and keep or lose the same lines; of different texts with
one id, the one with the smaller hash of both comes first; texts and lines of any
length are read whole; an empty table gives an empty result; other columns are
carried along by ``keep_first_lines``, whatever their names.

A line is known by two 64-bit hashes and a number of its own in the union-find.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._common import Scratch, if_few, linked, settings, sketches, stage, unused
from tallyweir.llm.quality import WHITE, let

#: Characters are UTF-16 units, so that places in a line are places in its bytes.
UNITS = "UTF-16BE"
#: Bands of three minimum hashes. Measured miss of a pair that shares 0.8: 0.1 to 0.5 % by length; at 0.9 under 1e-4.
BANDS, ROWS = 8, 3
#: Orders of the elements: a hash turned by this many bits, so that other bits lead, with its first two bits flipped by
#: these masks, so that each order prefers another quarter of the hashes.
_TURNS, _QUARTERS = (0, 11, 21, 32, 43, 53), (0, 1 << 62, -(1 << 62), -(1 << 63))
#: Elements that an order's quarter holds, on average, among those handed on.
_FEW = 4


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, pos, line, h1, h2) of every line that holds more than white space."""
    found = _key(docs.select("doc_id", "text")).select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # the left end tells already whether a line is white throughout; btrim would also walk all others to their right end
    return found.where(F.ltrim("line", F.lit(WHITE)) != "").withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _turned(x: F.Column, bits: int) -> F.Column:
    """``x`` rotated to the left."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def signatures(lines: DataFrame, shingle: int) -> DataFrame:
    """(h1, h2, weight, keys) of every distinct line: occurrences and band keys.

    Every shingle is hashed. Of a long line only shingles that can be a minimum
    are handed on to the aggregation: those whose hash, in one of the orders, is
    small behind its first two bits, under a limit that leaves _FEW shingles a
    quarter on average. The limit depends on the number of shingles; where no
    shingle of a quarter is under it (a chance of e**-_FEW), that order's value
    is the minimum of what the other orders let through.
    """
    n = F.greatest(F.expr(f"cast(length(units) div 2 as int) - {shingle - 1}"), F.lit(1))
    wide = lines.select("h1", "h2", F.encode("line", UNITS).alias("units")).withColumn("n", n)
    limit = F.expr(f"cast({float(1 << 62)}D * least(1D, {_FEW * len(_QUARTERS)}D / n) as bigint)")
    each = wide.withColumn("limit", limit).select("h1", "h2", "units", "limit", F.explode(F.sequence(F.lit(1), F.col("n") * 2 - 1, F.lit(2))).alias("i"))
    # the zero from the partition's number keeps the optimizer from copying the hash into each condition of the filter
    zero = F.spark_partition_id().bitwiseAND(F.lit(0)).cast("long")
    hashed = each.select("h1", "h2", "limit", (F.col("i") == 1).alias("first"), F.xxhash64(F.substring("units", F.col("i"), F.lit(2 * shingle))).bitwiseOR(zero).alias("s"))
    near = [_turned(F.col("s"), t).bitwiseAND(F.lit((1 << 62) - 1)) < F.col("limit") for t in _TURNS]
    handed = hashed.where(reduce(or_, near, F.col("first")))
    minima = [F.min(_turned(F.col("s"), t).bitwiseXOR(F.lit(q))) for t in _TURNS for q in _QUARTERS]
    signed = handed.groupBy("h1", "h2").agg(F.count_if("first").alias("weight"), *[m.alias(f"m{i}") for i, m in enumerate(minima)])
    # a band's minima are of three turns and three quarters; each minimum is in one band
    keys = [F.xxhash64(F.lit(b), *[f"m{4 * (b % 2 * ROWS + r) + (b // 2 + r) % 4}" for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("h1", "h2", "weight", F.array(*keys).alias("keys"))


def _shingles(line: F.Column, shingle: int) -> F.Column:
    """Hashes of a line's shingles, repeated ones included."""

    def made(both: F.Column) -> F.Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(both) - (2 * shingle - 1), F.lit(1)), F.lit(2))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(both, i, F.lit(2 * shingle))))

    return let(F.encode(line, UNITS), made)


def _copies(gone: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(row_key, keeper): rows that would be near copies of another as a whole, if they kept the lines that it keeps.

    ``gone`` is (row_key, keeper, chars), a row for each line lost. Lines that
    the other keeps must make up ``percent`` of the characters of either, after
    all other lines are cut. A few changed words leave whole lines unlike, so
    this share is smaller than that of common words.
    """
    lost = gone.groupBy("row_key").agg(F.sum("chars").alias("lost"))
    shared = gone.where("row_key <> keeper").groupBy("row_key", "keeper").agg(F.sum("chars").alias("own"))
    best = shared.groupBy("row_key").agg(F.max_by(F.struct("keeper", "own"), F.struct("own", "keeper")).alias("x")).select("row_key", "x.*")
    sizes = _key(docs.select("doc_id", "text")).groupBy("row_key").agg(F.max(F.length("text")).alias("size"))
    kept = sizes.join(lost, "row_key", "left").select("row_key", (F.col("size") - F.coalesce("lost", F.lit(0))).alias("kept"))
    both = best.join(kept, "row_key").join(kept.toDF("keeper", "kept_2"), "keeper")
    return both.where((100 * F.col("own") >= percent * (F.col("kept") + F.col("own"))) & (100 * F.col("own") >= percent * F.col("kept_2"))).select("row_key", "keeper")


def removed_lines(docs: DataFrame, shingle: int = 9, percent: int = 80, copies: int | None = None) -> DataFrame:
    """(doc_id, row_key, pos), staged, of every line that is not the first of its component.

    With ``copies``, a row that shares so many percent of what is left of both
    with a single other one, once all other lines are cut, keeps the lines that
    the other keeps: it is a near copy of a document, which is for a later stage
    to see.
    """
    lines = lines_of(docs)
    with Scratch(docs.sparkSession, "line-dedup") as scratch:
        # distinct lines are numbered, no two alike: first by weight, which makes leaders of buckets, then by partition and row
        number = F.least("weight", F.lit((1 << 13) - 1)) * F.lit(1 << 50) + F.monotonically_increasing_id()
        # hardly a value stands in it twice
        with settings(docs.sparkSession, parquet__enable__dictionary="false"):
            signed = scratch.stage(signatures(lines, shingle).withColumn("id", number), "signatures")
        held: list[DataFrame] = []

        def fetch(ids: DataFrame) -> DataFrame:
            # all places of lines that occur twice or share a key, so that the documents need not be cut into lines again
            shared = if_few(ids).withColumn("shared", F.lit(True))
            wanted = signed.join(shared, "id", "left").where("weight > 1 or shared").select("id", "h1", "h2", (F.col("weight") > 1).alias("twice"), "shared")
            wanted = scratch.stage(wanted, "wanted")
            found = lines.select("doc_id", "row_key", "pos", F.length("line").alias("chars"), "h1", "h2", "line").join(if_few(wanted), ["h1", "h2"])
            held.append(scratch.stage(found.select("id", "twice", "doc_id", "row_key", "pos", "chars", F.when(F.col("shared"), F.col("line")).alias("line")), "found"))
            return held[0].where("line is not null").groupBy("id").agg(F.min("line").alias("text"))

        def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
            both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
            # a condition on the partition's number keeps the optimizer from moving the sets into the filter; outside of a
            # lambda they are met by generated code, which passes over repeated ones
            s, t = (F.when(F.spark_partition_id() >= 0, _shingles(F.col(c), shingle)) for c in ("x", "y"))
            sets = both.select("a", "b", "total", s.alias("s"), t.alias("t"))
            return sets.where((100 + percent) * F.size(F.array_intersect("s", "t")) >= percent * F.col("total")).select("a", "b")

        def elements(texts: DataFrame) -> DataFrame:
            # as above: else the set would be made again for its size
            return texts.select("id", F.when(F.spark_partition_id() >= 0, F.array_distinct(_shingles(F.col("text"), shingle))).alias("items"))

        roots = linked(signed.select("id", "keys"), fetch, confirmed, elements, lambda texts: sketches(elements(texts.repartition("id")), 8), percent, scratch)
        # lines that occur once and are linked with none stay, and take no further part
        found = held[0].drop("line").join(if_few(roots), "id", "left").where("twice or root is not null")
        places = scratch.stage(found.select(F.coalesce("root", "id").alias("g"), F.struct("doc_id", "row_key", "pos").alias("at"), "chars"), "places")
        keepers = scratch.stage(places.groupBy("g").agg(F.min("at").alias("keep")), "keepers")
        gone = places.join(if_few(keepers), "g").where(~F.col("at").eqNullSafe(F.col("keep"))).select("at.*", "g", "chars", F.col("keep.row_key").alias("keeper"))
        if copies is not None:
            gone = scratch.stage(gone, "gone")
            whole = scratch.stage(_copies(gone, docs, copies), "copies")
            # of lines that are near-equal inside a row, the first is spared
            spared = gone.join(if_few(whole), ["row_key", "keeper"]).groupBy("row_key", "g").agg(F.min("pos").alias("pos"))
            gone = gone.join(if_few(scratch.stage(spared.select("row_key", "pos"), "spared")), ["row_key", "pos"], "left_anti")
        gone = gone.select("doc_id", "row_key", "pos").distinct()
        return stage(gone, "removed")


def _by_document(removed: DataFrame) -> DataFrame:
    """(row_key, removed): sorted places of the removed lines, at most as many as the document has lines."""
    return removed.groupBy("row_key").agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def decisions(docs: DataFrame, shingle: int = 9, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row of ``docs``."""
    gone = _by_document(removed_lines(docs, shingle, percent))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    keyed = _key(docs.select("doc_id", "text")).select("doc_id", "row_key", F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"))
    joined = keyed.join(gone, "row_key", "left")
    return joined.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def _others(lines: F.Column, places: F.Column) -> F.Column:
    """The lines that are not at ``places``, in order."""
    return let(lines, lambda a: F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), places), lambda i: a[i]))


def keep_first_lines(docs: DataFrame, shingle: int = 9, percent: int = 80, copies: int | None = None, still: Callable[[F.Column], F.Column] | None = None) -> DataFrame:
    """``docs`` without the removed lines; a document that loses its last line with text goes too.

    ``copies`` as in :func:`removed_lines`; with ``still``, a document that lost
    lines also goes unless its new text passes.
    """
    key, gone = unused(docs, "row_key", "removed")
    removed = _by_document(removed_lines(docs, shingle, percent, copies)).toDF(key, gone)
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(removed, key, "left")
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_others(F.split("text", "\n"), F.col(gone)), "\n"))
    good = F.ltrim("text", F.lit(WHITE)) != ""
    new = joined.withColumn("text", kept).where(F.col(gone).isNull() | (good & still(F.col("text")) if still else good))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)
