"""Exact n-gram Jaccard join of whole documents: size-aware, light sets by subsets, heavy ones by inverted lists.

A document's set holds 64-bit hashes of its distinct word shingles; documents
with equal sets are one class. Two sets of a and b elements link when they share
at least ``needed(a, b)`` of them.

1. Sieve. Each class shows its smallest hashes, a little more than the elements
   it may have for itself. If too few of them are seen in another class, it has
   no partner (the prefix filter, with more than one common element asked for).
   Most documents end here, and only these hashes were shuffled.
2. Light sets, smaller than the boundary, list all subsets of the size that a
   partner must share, for each size of partner. Who lists the same subset is
   linked, so a list is joined to its smallest member: no pair is made.
3. Heavy sets are found by inverted lists. Elements are ordered by how many of
   the remaining sets hold them, rare ones first, and only the first elements
   are listed, so a common passage opens no list. The larger set of a pair scans
   the lists of the smaller ones. First everyone is held against the member of
   its list that has the most copies; after a union-find, only members of a list
   that are still in different components meet. Sizes and places in the order
   bound what a pair can share before sets are compared in full.

The boundary is the size at which listing subsets becomes dearer than scanning,
from counts of the sets and the lengths of their lists at each size. It decides
the way, not the result. No link between components is missed: the filters are
exact and nothing is capped.

Defined results: null texts, and those without a word, have an empty set and are
linked with nothing; a text with fewer words than a shingle is one shingle;
repeated rows and copies share a class; texts of any length are read whole; an
empty table stays empty; other columns take no part, whatever their names; rows
with a null doc_id are linked like all others, but name a component only if no
row of it has an id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._arrays import mix, word_shingles
from tallyweir.llm._common import Scratch, arrow_map, components, if_few, map_arrow, stage
from tallyweir.llm._prefix import counted, least_sql, listed, may_link, meetings, needed_sql
from tallyweir.llm.near_dedup import printed, shingle_sets

#: Sizes up to this one may be light; the sets of such a class are kept whole from the start.
SMALL = 16
#: The sieve shows this many hundredths of a set more than the least, and asks for about as many common elements.
EXTRA = 10
#: Subset keys that one Arrow batch holds, about.
_KEYS = 1 << 18


def needed(a: int, b: int, percent: int) -> int:
    """The least number of common elements at which sets of ``a`` and ``b`` elements link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a partner of a set of ``n`` can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def _shown(n: str, percent: int) -> str:
    """How many of its smallest hashes a set shows to the sieve."""
    return f"least({n}, {n} - {least_sql(n, percent)} + 1 + {n} * {EXTRA} div 100)"


def _common(n: str, percent: int) -> str:
    """How many of the hashes shown a set has in common with any partner, at least.

    Of two sets, the one whose shown hashes end first has all but those it may
    have for itself among the other's; it can be the smaller partner.
    """
    least = least_sql(n, percent)
    return f"least({least_sql(least, percent)}, 1 + {least} * {EXTRA} div 100)"


def _marked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, t1, t2, n, f1, f2, head): text fingerprint, set size, set fingerprint and the smallest hashes, in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = word_shingles(batch.column(3), shingle)
        prints = [(int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))))) for s in sets]
        marks = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        shown = np.minimum(sizes, np.maximum(SMALL, sizes - -(-percent * sizes // 100) + 1 + sizes * EXTRA // 100))
        heads = np.concatenate([*[s[:k] for s, k in zip(sets, shown, strict=True)], np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *shown]), pa.int32()), pa.array(heads))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], names=["doc_id", "t1", "t2", "n", "f1", "f2", "head"])

    schema = "doc_id bigint, t1 bigint, t2 bigint, n bigint, f1 bigint, f2 bigint, head array<bigint>"
    return map_arrow(printed(docs.select("doc_id", "text")).select("doc_id", "t1", "t2", "text"), run, schema, "text", 1 << 19)


def _boundary(lists: DataFrame, percent: int) -> int:
    """The size from which scanning lists is cheaper than listing subsets; ``lists`` is (n, sets, scanned) of sizes up to SMALL."""
    cost = {n: [0, 0] for n in range(1, SMALL + 1)}
    for n, sets, scanned in lists.collect():
        cost[n] = [sets * sum(math.comb(n, needed(n, b, percent)) for b in partners(n, percent)), scanned]
    total = {x: sum(c[0] if n < x else c[1] for n, c in cost.items()) for x in range(1, SMALL + 2)}
    return min(total, key=lambda x: (total[x], -x))


def _subsets(light: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(key, id, n, alike): the subsets of (id, n, head) that a partner of a light size must share; ``alike``: partners of the same size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[tuple[int, int], np.ndarray] = {}

        def made(held: list[tuple[np.ndarray, int, int, bool]]) -> pa.RecordBatch:
            sizes = [len(h[0]) for h in held]
            keys = np.concatenate([np.zeros(0, np.uint64), *[h[0] for h in held]]).view(np.int64)
            columns = [pa.array(np.repeat(np.array([h[i] for h in held], t), sizes)) for i, t in ((1, np.int64), (2, np.int64), (3, bool))]
            return pa.RecordBatch.from_arrays([pa.array(keys), *columns], names=["key", "id", "n", "alike"])

        for batch in batches:
            held, count = [], 0
            for number, n, head in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                items = np.array(head, np.int64).view(np.uint64)
                for b in (b for b in partners(n, percent) if b < boundary):
                    c = needed(n, b, percent)
                    if (n, c) not in chosen:
                        chosen[n, c] = np.array(list(itertools.combinations(range(n), c)), np.int64).reshape(-1, c)
                    picked = items[chosen[n, c]]
                    key = np.full(len(picked), min(n, b) * 65_536 + max(n, b), np.uint64)
                    for i in range(c):
                        key = mix(key ^ picked[:, i])
                    held.append((key, number, n, n == b))
                    count += len(key)
                if count >= _KEYS:
                    yield made(held)
                    held, count = [], 0
            yield made(held)

    return arrow_map(light.select("id", "n", "head"), run, "key bigint, id bigint, n bigint, alike boolean")


def _light_links(keys: DataFrame) -> DataFrame:
    """(a, b) of (key, id, n, alike): every member of a list that holds a linked pair, with its smallest member."""
    lists = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("alike").alias("same"))
    good = lists.where("k > 1 and (same or lo <> hi)").select("key", "a")
    return keys.join(good, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their full sets (id, n, items)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("p"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("n").alias("q"), F.col("items").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= F.expr(needed_sql("p", "q", percent))).select("a", "b")


def _heavy_links(sets: DataFrame, entries: DataFrame, weights: DataFrame, light: DataFrame, boundary: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, root) of the components of the ``light`` links and all links of which one set at least is not light."""
    weighed = entries.join(weights, "id")
    leaders = weighed.groupBy("e").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("n_2"), F.col("pos").alias("pos_2")), F.struct("weight", -F.col("id"))).alias("lead")).select("e", "lead.*")
    met = entries.join(leaders, "e").where("id <> a").where(may_link("", "_2", percent) & (F.col("n") <= F.col("n_2")) | may_link("_2", "", percent) & (F.col("n_2") < F.col("n")))
    pairs = met.where(F.greatest("n", "n_2") >= boundary).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    links = _confirmed(scratch.stage(pairs, "pairs"), sets, percent).union(light)
    first = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    rooted = entries.join(first, "id", "left").withColumn("root", F.coalesce("root", "id"))
    across = scratch.stage(meetings(rooted, percent, scratch, boundary), "across")
    more = _confirmed(across.select("a", "b"), sets, percent).join(across, ["a", "b"]).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    more = scratch.stage(more, "more")
    if more.isEmpty():
        return first
    second = components(more, scratch)
    moved = first.join(second.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return scratch.stage(moved.union(second).distinct(), "roots")


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; links are pairs with a Jaccard index of ``percent`` or more (1 to 100)."""
    with Scratch(docs.sparkSession, "jaccard-join") as scratch:
        marked = scratch.stage(_marked(docs, shingle, percent), "marked")
        one = F.first(F.struct("t1", "t2", "head")).alias("one")
        classes = marked.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), one)
        classes = scratch.stage(classes.select("f1", "f2", "n", "rep", "weight", "one.*").withColumn("id", F.monotonically_increasing_id()), "classes")

        shown = F.slice("head", F.lit(1), F.expr(_shown("n", percent)).cast("int"))
        seen = counted(classes.select("id", "n", F.explode(shown).alias("e"))).groupBy("id", "n").agg(F.count("*").alias("k"), F.sum("df").alias("scanned"))
        left = scratch.stage(seen.where(F.col("k") >= F.expr(_common("n", percent))).select("id", "n", "scanned"), "left")
        boundary = _boundary(left.where(F.col("n") <= SMALL).groupBy("n").agg(F.count("*"), F.sum("scanned")), percent)
        rows = scratch.stage(classes.join(if_few(left.select("id")), "id").select("id", "n", "weight", "t1", "t2", F.when(F.col("n") <= SMALL, F.col("head")).alias("head")), "rows")
        light = scratch.stage(_light_links(_subsets(rows.where(F.col("n") < boundary), boundary, percent)), "light")

        wanted = rows.where(F.col("n") > SMALL).select("id", "n", "t1", "t2")
        texts = printed(docs.select("text")).join(if_few(wanted), ["t1", "t2"]).dropDuplicates(["id"])
        near = F.col("n") * 100 >= percent * boundary
        whole = rows.where((F.col("n") <= SMALL) & near).select("id", F.col("head").alias("items")).union(shingle_sets(texts.select("id", "text"), shingle))
        sets = scratch.stage(whole.select("id", F.size("items").cast("long").alias("n"), "items"), "sets")
        entries = scratch.stage(listed(sets, percent), "entries")
        roots = _heavy_links(sets, entries, rows.select("id", "weight"), light, boundary, percent, scratch)

        rooted = classes.join(if_few(roots), "id", "left").select("f1", "f2", "n", "rep", F.coalesce("root", "id").alias("group"))
        named = scratch.stage(rooted.join(rooted.groupBy("group").agg(F.min("rep").alias("component")), "group").select("f1", "f2", "n", "component"), "named")
        joined = marked.select("doc_id", "f1", "f2", "n").join(if_few(named), ["f1", "f2", "n"], "left")
        component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return stage(joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "jaccard-components")
