"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds 64-bit hashes of its distinct word shingles. SuperMinHash
gives each element one random permutation of the signature's places: in round j
the element offers the value j + r to the j-th place of its permutation, so
places are filled by different elements and the estimate varies less than with
independent hashes. Rounds stop as soon as every place holds a value of an
earlier round (early stopping); the result does not depend on element order.

Documents with equal sets are one class from the start. Bands of the class
signatures propose pairs, full sets confirm them, and a distributed union-find
groups classes; see ``linked`` for how hot buckets stay linear.

Defined results: null or empty texts have an empty set and are linked with
nothing; a text shorter than a shingle is one shingle; repeated rows and copies
share a class, and so do different texts of one id only if their sets are equal;
texts of any length are read whole; an empty table stays empty; extra columns
are ignored, whatever their names (``keep_first`` carries them along); rows with a null doc_id are linked
like all others, but name a component only if no row of it has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._arrays import mix, word_shingles
from tallyweir.llm._common import Scratch, if_few, linked, map_arrow, sketches, stage, unused

#: Bands and rows in each. At a similarity of 0.85 a pair shares no band with a chance of 4e-7, at 0.8 of 5e-5.
BANDS, ROWS = 25, 5


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (one row per set) of sets of distinct uint64 elements; an empty set keeps the maximum."""
    out = np.full((len(sets), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.zeros((0, 0), np.uint8)
    for j in range(size):
        if j:
            # early stopping: a set is done when all its places hold values of rounds before this one
            active = (out.max(1) >= np.uint64(j) << np.uint64(32))[owner]
            if not active.any():
                break
            owner, items = owner[active], items[active]
            if j > 1:
                order = order[active]
            else:
                order = np.tile(np.arange(size, dtype=np.uint16), (len(items), 1))
                row, place = np.arange(len(items)), place[active]
                order[row, place] = 0
                order[:, 0] = place
        draw = mix(items ^ mix(np.array([j + 1], np.uint64))[0])
        place = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        if j:
            row, swap = np.arange(len(items)), place
            place = order[row, swap].astype(np.int64)
            order[row, swap] = order[:, j]
            order[:, j] = place
        np.minimum.at(out.ravel(), owner * size + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; equal keys mean equal rows of that band."""
    out = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key ^ signatures[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t1, t2, n, f1, f2, keys): text fingerprint, set size, set fingerprint and band keys (none for an empty set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = word_shingles(batch.column(3), shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = band_keys(superminhash(sets, bands * rows), bands, rows)
        prints = [(int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))))) for s in sets]
        marks = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(keys[sizes > 0].ravel(), pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], names=["doc_id", "t1", "t2", "n", "f1", "f2", "keys"])

    schema = "doc_id bigint, t1 bigint, t2 bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>"
    return map_arrow(printed(docs.select("doc_id", "text")).select("doc_id", "t1", "t2", "text"), run, schema, "text", 1 << 19)


def printed(docs: DataFrame, one: str = "t1", two: str = "t2") -> DataFrame:
    """``docs`` with the 128-bit fingerprint of the text."""
    return docs.withColumn(one, F.xxhash64("text")).withColumn(two, F.xxhash64(F.lit(7), "text"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union; ``texts`` is (id, text)."""
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = word_shingles(batch.column(2), shingle), word_shingles(batch.column(3), shingle)
        good = []
        for s, t in zip(left, right, strict=True):
            same = len(np.intersect1d(s, t, assume_unique=True))
            good.append(same > 0 and 100 * same >= percent * (len(s) + len(t) - same))
        keep = pa.array(good, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(both.select("a", "b", "x", "y"), run, "a bigint, b bigint", "x", 1 << 19)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the shingle sets of (id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = word_shingles(batch.column(1), shingle)
        edge = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edge, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], names=["id", "items"])

    return map_arrow(texts, run, "id bigint, items array<bigint>", "text", 1 << 20)


def _labelled(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t1, t2, n, class, group, component) of every row, staged: its set's number, group number and the group's smallest doc_id."""
    with Scratch(docs.sparkSession, "near-dedup") as scratch:
        marked = scratch.stage(signed(docs, shingle, bands, rows), "signed")
        # equal sets have equal keys; t1 and t2 are those of one text of the class
        found = marked.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("t1").alias("t1"), F.min_by("t2", "t1").alias("t2"), F.min("doc_id").alias("rep"), F.count("*").alias("weight"), *[F.max(F.col("keys")[i]).alias(f"k{i}") for i in range(bands)])
        classes = scratch.stage(found.select("f1", "f2", "n", "t1", "t2", "rep", "weight", F.array(*[f"k{i}" for i in range(bands)]).alias("keys")).withColumn("id", F.monotonically_increasing_id()), "classes")

        def fetch(ids: DataFrame) -> DataFrame:
            wanted = scratch.stage(classes.join(if_few(ids), "id", "left_semi").select("id", "t1", "t2"), "wanted")
            return printed(docs.select("text")).join(if_few(wanted), ["t1", "t2"]).dropDuplicates(["id"]).select("id", "text")

        roots = linked(classes.select("id", "weight", "keys"), fetch, lambda pairs, texts: confirmed(pairs, texts, shingle, percent), lambda texts: shingle_sets(texts, shingle), lambda texts: sketches(shingle_sets(texts, shingle).repartition("id")), percent, scratch)
        rooted = classes.join(if_few(roots), "id", "left").select("f1", "f2", F.col("n").alias("m"), "rep", "id", F.coalesce("root", "id").alias("group"))
        groups = rooted.groupBy("group").agg(F.min("rep").alias("component"))
        named = scratch.stage(rooted.join(groups, "group").drop("rep"), "named")
        joined = marked.alias("d").join(named.alias("c"), (F.col("d.f1") == F.col("c.f1")) & (F.col("d.f2") == F.col("c.f2")) & (F.col("d.n") == F.col("c.m")) & (F.col("d.n") > 0), "left")
        component = F.when(F.col("d.n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return stage(joined.select("doc_id", "t1", "t2", F.col("d.n").alias("n"), "group", component.alias("component")), "labelled")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links are pairs with a Jaccard index of ``percent`` or more."""
    found = _labelled(docs, shingle, percent, bands, rows)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, then the smallest text fingerprint; a null id comes last.

    Rows with an empty set are in no group and stay. Of repeated rows of one id
    and text one stays, whichever in columns other than those two.
    """
    key = ["doc_id", "t1", "t2"]
    found = _labelled(docs, shingle, percent, BANDS, ROWS).where("n > 0")
    rows = found.groupBy("group", *key).agg(F.count("*").alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), *key)
    keepers = rows.groupBy("group").agg(F.min(order).alias("keep"))
    judged = rows.join(keepers, "group").withColumn("kept", order.eqNullSafe(F.col("keep")))
    # rows of one id and text share a set and so a group; every row of a kept key but one goes below
    names = unused(docs, "t1", "t2", "id_x", "t1_x", "t2_x", "kept_x")
    own, there = ["doc_id", *names[:2]], names[2:5]
    touched = stage(judged.where("not kept or times > 1").select(*key, "kept").toDF(*names[2:]), "touched")

    def matched(part: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col(there[0])) & (F.col(own[1]) == F.col(there[1])) & (F.col(own[2]) == F.col(there[2]))
        return printed(docs, *names[:2]).join(if_few(part), same, how)

    single = matched(touched, "left_anti").select(*docs.columns)
    again = touched.where(F.col(names[5]))
    if again.isEmpty():
        return single
    return single.union(matched(again, "left_semi").dropDuplicates(own).select(*docs.columns))
