"""Filter interaction audit by a retracting stream: what each filter removes under every order of five filters.

All files of the documents' table are processed as available-now micro-batches.
A stateful operator remembers for every text (by its SHA-256) the smallest
doc_id seen and where the rows of that id were counted. The row with the
smallest id does not fail E; when a smaller id arrives, the counters of the
rows that held that place are taken back and they are counted again with E in
their mask. Texts share a state in buckets of a few hundred by hash, so that a
micro-batch is worked through in arrays; a bucket's state holds one row for
each of its texts. What the stream adds up is, for each part, how many documents
failed which set of filters; everything that the report asks of 120 orders
follows from those at most 32 x 4 counters a part.

Before the exchange, rows of equal text are put together in each Arrow batch,
so a text that a third of all rows share costs its state a few rows a task.
State lives in RocksDB and, like the changes of each micro-batch, in the shared
folder: a lost executor's state is read from there, and a micro-batch that is
run again replaces its own changes. ``advance`` goes on from such a folder when
files were added since.

Defined results: a null text is the empty text, a null source the part ``''``;
a row with a null doc_id neither fails E nor makes others fail it; repeated rows
are documents of their own, and those that share a text's smallest id all pass
E; labels of an id count once, quality = 1 or toxic = 1 in any of its rows;
texts of any length are read whole; an empty table gives no rows; other columns
take no part, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweir.llm._common import Scratch, arrow_map, if_few, stage
from tallyweir.llm.quality import let

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Micro-batches that the files of one call are dealt to, about.
BATCHES = 4
#: Settings of the stream: state on local disk and in the checkpoint, small commits, bounded memory, no disk taken ahead of need.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_LAST = 2**63 - 1
_STATE = "held binary"
#: Bytes of the table for each bucket of texts: some hundred documents.
BUCKET_BYTES = 1 << 20
_CHANGE = "part string, mask int, good int, toxic int, n bigint"
_HELD, _COUNTED = ["print", "id", "part", "mask", "good", "toxic", "n"], ["part", "mask", "good", "toxic", "n"]
_ROW = "bucket bigint, print binary, named boolean, id bigint, part string, mask int, good int, toxic int, n bigint"


def masks(text: F.Column) -> F.Column:
    """Bits 0 to 3: the text fails A (few words), B (few distinct words), C (capitals), D (signs)."""
    both = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.size(w) < 50).cast("int") + 2 * (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).cast("int"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return both + 4 * (100 * capitals > 5 * F.length(text)).cast("int") + 8 * text.rlike(r"[#$%&*|]").cast("int")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with a count; of the others with the same text only what the state needs of them.

    Rows over the batch's smallest id of a text fail E whatever comes, so they
    are told apart by part and labels only and carry the next larger id.
    """
    for batch in batches:
        rows = batch.to_pandas()
        least = rows["id"].where(rows["named"], _LAST).groupby(rows["print"]).transform("min")
        later = rows["named"] & (rows["id"] > least)
        rows.loc[later, "id"] = least[later] + 1
        made = rows.groupby(["bucket", *_HELD[:1], "named", *_HELD[1:-1]], sort=False)["n"].sum().reset_index()
        yield pa.RecordBatch.from_pandas(made, batch.schema, preserve_index=False)


def _seen(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the counters that a bucket's new rows bring about.

    The state is a table of the rows that hold the smallest id of their text,
    equal ones counted.
    """
    new = pd.concat(list(frames), ignore_index=True)
    old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0][_HELD]
    named = new[new["named"]][_HELD]
    rows = pd.concat([old, named], ignore_index=True) if len(old) else named.reset_index(drop=True)
    arrived = np.arange(len(rows)) >= len(old)
    first = (rows["id"] == rows.groupby("print")["id"].transform("min")).to_numpy()
    late = rows["mask"] | 16
    back = rows[~arrived & ~first]
    changes = [
        rows[arrived & first],
        rows.assign(mask=late)[~first],
        back.assign(n=-back["n"]),
        new[~new["named"]],
    ]
    counted = pd.concat([c[_COUNTED] for c in changes], ignore_index=True).groupby(_COUNTED[:-1], sort=False)["n"].sum().reset_index()
    if arrived.any():
        held = rows[first].groupby(_HELD[:-1], sort=False)["n"].sum().reset_index()
        table = pa.Table.from_pandas(held, pa.schema([("print", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    yield counted[counted["n"] != 0]


def _followed(spark: SparkSession, path: str) -> str:
    """``path`` as a stream takes it: a folder as it is, a single file by a pattern that only it matches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def _buckets(spark: SparkSession, place: str, wanted: int) -> int:
    """The number of buckets of the counters in ``place``: ``wanted`` the first time, then what it was."""
    at = f"{place}/buckets"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.range(wanted, wanted + 1).coalesce(1).write.parquet(at)
    return spark.read.schema("id bigint").parquet(at).first()["id"]


def marked_labels(labels: DataFrame) -> DataFrame:
    """(label_id, good, toxic): one row of each id that has a mark."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def advance(spark: SparkSession, path: str, labels: DataFrame, place: str, bytes_per_batch: int | None = None) -> None:
    """Bring the counters in the folder ``place`` up to date with all files of the Parquet table ``path``.

    ``labels`` is (label_id, good, toxic), ids unique; the stream reads it anew
    in each micro-batch, so it must stay the same. ``bytes_per_batch`` sets the
    size of a micro-batch (default: 1 / BATCHES of the table). The result does
    not depend on it, nor on the order of files.
    """
    table = spark.read.parquet(path)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bytes_per_batch = bytes_per_batch or max(32 << 20, math.ceil(size / BATCHES))
    buckets = _buckets(spark, place, max(1, size // BUCKET_BYTES))
    source = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(_followed(spark, path))
    text = F.coalesce("text", F.lit(""))
    rows = source.select("doc_id", F.sha2(text.cast("binary"), 256).alias("print"), F.coalesce("source", F.lit("")).alias("part"), masks(text).alias("mask"))
    rows = rows.join(if_few(labels), F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select(F.pmod(F.xxhash64("print"), F.lit(buckets)).alias("bucket"), F.unhex("print").alias("print"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.lit(1).cast("long").alias("n"))
    changes = arrow_map(rows, _together, _ROW).groupBy("bucket").applyInPandasWithState(_seen, _CHANGE, _STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{place}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STREAM}
    try:
        for k, v in STREAM.items():
            spark.conf.set(k, v)
        started = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def counters(spark: SparkSession, place: str) -> DataFrame:
    """(part, mask, good, toxic, n) as of the last micro-batch, groups of which nothing is left included."""
    return spark.read.schema(_CHANGE).parquet(f"{place}/changes").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> F.Column:
    """Every (filter, set of filters before it) with the orders in which it occurs: 80 structs for 600 steps."""
    found: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            found.setdefault((f, before), []).append(("".join(FILTERS[i] for i in order), k + 1))
            before |= 1 << f
    orders = lambda at: F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step")) for o, k in at])
    return F.array(*[F.struct(F.lit(1 << f).alias("own"), F.lit(before).alias("before"), orders(at).alias("at")) for (f, before), at in found.items()])


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from (part, mask, good, toxic, n); zeros included."""
    n_masks, orders = 1 << len(FILTERS), math.factorial(len(FILTERS))
    total = lambda m, when: F.coalesce(F.sum(F.when((F.col("mask") == m) & when, F.col("n"))), F.lit(0))
    array = lambda name, when: F.array(*[total(m, when) for m in range(n_masks)]).alias(name)
    wide = counted.groupBy("part").agg(array("n", F.lit(True)), array("g", F.col("good") == 1), array("t", F.col("toxic") == 1))
    each = wide.select("part", "n", "g", "t", F.explode(_steps()).alias("s")).select("part", "n", "g", "t", "s.*")
    every = F.sequence(F.lit(0), F.lit(n_masks - 1))

    def over(column: str, when) -> F.Column:  # noqa: ANN001
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(when(m), F.get(F.col(column), m)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    first = lambda m: fails(m) & ~gone(m)
    # of all orders, a filter comes first among the k that a document fails in one of k
    share = F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(fails(m), F.expr(f"{orders}L") * F.get("n", m) / F.bit_count(m)).otherwise(0).cast("long"))
    made = each.select(
        "part",
        "at",
        over("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        over("n", first).alias("removed"),
        over("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("n", lambda m: m == own).alias("unique_fails"),
        over("g", first).alias("good_lost"),
        over("t", first).alias("toxic_lost"),
        share.alias("shapley"),
    )
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return made.select("part", F.explode("at").alias("at"), *counts).select("part", "at.*", *counts)


def audit(spark: SparkSession, path: str, labels: DataFrame, bytes_per_batch: int | None = None) -> DataFrame:
    """:func:`report` over all files of the Parquet table ``path``; ``labels`` is (doc_id, quality, toxic)."""
    with Scratch(spark, "filter-audit") as scratch:
        advance(spark, path, scratch.stage(marked_labels(labels), "labels"), scratch.root, bytes_per_batch)
        return stage(report(counters(spark, scratch.root)), "filter-audit")
