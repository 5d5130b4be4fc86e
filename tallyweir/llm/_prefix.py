"""Prefix filter: which sets of a table may share enough elements, by the rare elements that they begin with.

Elements are ordered by how many sets hold them, rare ones first. Two sets that
link share an element among the first of each, so only those are listed. A
passage that many sets hold opens no list unless a set is little else.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tallyweir.llm._common import Scratch

#: Members of a list that are met in one group; larger lists are dealt to several.
CELL = 2048
#: Long lists up to this number are known to all executors; beyond it they are joined by a shuffle.
LONG_LISTS = 100_000


def needed_sql(a: str, b: str, percent: int) -> str:
    """The least number of common elements at which sets of ``a`` and ``b`` elements have a Jaccard index of ``percent``."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def least_sql(n: str, percent: int) -> str:
    """The smallest partner's size, which is also the least number of elements that a set shares with any partner."""
    return f"(({percent} * {n} + 99) div 100)"


def counted(entries: DataFrame) -> DataFrame:
    """``entries`` whose element ``e`` more than one set holds, with their number ``df``."""
    return entries.withColumn("df", F.count("*").over(Window.partitionBy("e"))).where("df > 1")


def listed(sets: DataFrame, percent: int, *carried: str) -> DataFrame:
    """(id, n, carried, e, pos): the entries of the inverted lists of (id, n, carried, items).

    ``pos`` is an element's place in its set, rare elements first. Elements that
    no other set holds come before all others and open no list; a set that has
    more of them than it may have for itself has no partner.
    """
    own = ["id", "n", *carried]
    held = counted(sets.select(*own, F.explode("items").alias("e"))).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("known"))
    first = held.withColumn("own", F.col("n") - F.size("known")).withColumn("open", F.expr(f"n - {least_sql('n', percent)} + 1 - own").cast("int")).where("open > 0")
    return first.select(*own, "own", F.posexplode(F.slice("known", F.lit(1), F.col("open"))).alias("i", "x")).select(*own, F.col("x.e").alias("e"), (F.col("own") + F.col("i")).alias("pos"))


def may_link(small: str, large: str, percent: int) -> F.Column:
    """Whether two entries of a list can be the first common element of a linked pair, the first of them in the smaller set."""
    need = needed_sql(f"n{small}", f"n{large}", percent)
    return F.expr(f"n{large} * {percent} <= n{small} * 100 and pos{small} + {need} <= n{small} and pos{large} + {need} <= n{large}")


def meetings(rooted: DataFrame, percent: int, scratch: Scratch, boundary: int = 1) -> DataFrame:
    """(a, b, x, y): pairs of ids of different roots that may link, and their roots, each pair once.

    ``rooted`` is (id, n, e, pos, root), entries of :func:`listed` with the
    component that each set is in already. Only lists with several roots are
    looked at. The larger set of a pair, of ``boundary`` elements or more, scans
    the lists of the smaller ones, whose own entries go even less far; sizes are
    put into bands of which a set meets two, and a long list is dealt to groups
    of about CELL of its smaller members.
    """
    mixed = rooted.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("e")
    band = F.floor(F.ln("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    rest = scratch.stage(rooted.join(mixed, "e").withColumn("band", band.cast("long")), "lists")
    short = F.expr(f"pos + {needed_sql('n', 'n', percent)} <= n")
    # only long lists are dealt out: at most one for each CELL entries
    cells = scratch.stage(rest.where(short).groupBy("e", "band").agg(F.expr(f"(count(*) + {CELL - 1}) div {CELL}").alias("cells")).where("cells > 1"), "cells")
    cells = F.broadcast(cells) if cells.count() <= LONG_LISTS else cells
    small = rest.where(short).join(cells, ["e", "band"], "left").withColumn("cell", F.pmod(F.xxhash64("id"), F.coalesce("cells", F.lit(1).cast("long")))).drop("cells")
    large = rest.where(F.col("n") >= boundary).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    large = large.join(cells, ["e", "band"], "left").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cells", F.lit(1).cast("long")) - 1))).drop("cells")
    key = ["e", "band", "cell"]
    large = large.select(*key, *[F.col(c).alias(f"{c}_2") for c in ("id", "n", "pos", "root")])
    order = (F.col("n") < F.col("n_2")) | (F.col("n") == F.col("n_2")) & (F.col("id") < F.col("id_2"))
    across = small.join(large, key).where((F.col("root") != F.col("root_2")) & order & may_link("", "_2", percent))
    return across.select(F.col("id").alias("a"), F.col("id_2").alias("b"), F.col("root").alias("x"), F.col("root_2").alias("y")).distinct()
