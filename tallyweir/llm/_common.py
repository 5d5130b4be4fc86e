"""Helpers shared by the operators: tables, shared scratch space, Arrow maps, graph components."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm._prefix import listed, meetings


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it no column of ``df`` (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_col(column: str = "doc_id") -> F.Column:
    """The same value as :func:`crc_of_id`, computed by Spark."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallyweir-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables staged for the steps of one operator, deleted together once its result is staged outside.

    Nothing that is still to be computed may read from it: a lost executor's
    share would be computed again from tables that are gone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this folder before the others; tables read from elsewhere stay."""
        for file in df.inputFiles()[:1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if str(path.getParent().toString()).rstrip("/").endswith(self.root.rsplit("/", 1)[-1]):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors, once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="tallyweir-")) / "tallyweir_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "tallyweir").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return df.mapInArrow(run, schema)


def split_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``max_bytes`` of text each, so that a kernel's memory stays bounded.

    A single row longer than that forms a slice of its own. No row is dropped.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i in range(rows):
            if held and held + sizes[i] > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(sizes[i])
        yield batch.slice(begin, rows - begin)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str, max_bytes: int = 2 << 20) -> DataFrame:
    """``function`` over slices of ``df`` that hold at most ``max_bytes`` of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in split_batches(batches, text, max_bytes):
            yield function(part)

    return arrow_map(df, run, schema)


def components(edges: DataFrame, place: Scratch | None = None) -> DataFrame:
    """Connected components of ``edges`` (long columns src, dst): distributed union-find.

    Alternates the large-star and small-star contractions until only stars are
    left, which no contraction changes, and returns (id, root) with ``root`` the
    smallest id of the component; ids without an edge do not appear. All state
    stays in tables of the shared folder, of which only the result is left (in
    ``place``, if given).
    Self-loops, repeated and null edges are ignored.
    """
    with Scratch(edges.sparkSession, "union-find") as scratch:
        now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
        now = scratch.stage(now, "edges")
        while True:
            # in a star every id but the root has one edge up, and the root none
            ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
            ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            count, open_ends = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()
            if open_ends == 0:
                break
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            now = scratch.stage(small.where("u <> v").distinct(), "edges", max(1, math.ceil(count / 500_000)))
        roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
        keep = place.stage if place else stage
        return keep(now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots), "roots", max(1, math.ceil(count / 500_000)))


#: Ids up to this number are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def if_few(rows: DataFrame) -> DataFrame:
    """``rows`` (staged, a few short columns), marked for broadcast if a count shows that there are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


#: A side of a join may be held in a hash table where Spark finds that each of its partitions is smaller than this.
HASHED = "64m"


#: Bytes of a generated method up to which an operator that looks at wide pairs is one.
LONG_METHOD = "4000"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with other settings (``__`` in names stands for a dot), for what is computed inside."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    try:
        for k, name in names.items():
            spark.conf.set(name, values[k])
        yield
    finally:
        for k, name in names.items():
            spark.conf.set(name, before[k]) if before[k] is not None else spark.conf.unset(name)


#: Words of 64 bits in a sketch.
WORDS = 32


def sketches(owned: DataFrame, groups: int = WORDS) -> DataFrame:
    """(id, size, w0, w1, ..., bits): a set's size, a bit field in which each element sets one bit, and the number of bits set.

    ``owned`` is (id, items array<bigint>), items distinct, dealt out by id, so
    that a set is folded where it is: into a row for each of ``groups`` of words
    (a divisor of WORDS; with fewer there are fewer rows to find, but each has more words), then into one row.
    """
    each = owned.select("id", F.size("items").cast("long").alias("size"), F.explode("items").alias("s"))
    bits = each.select("id", "size", F.pmod("s", F.lit(WORDS)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 58) as int))").alias("bit"))
    if groups < WORDS:
        bits = bits.select("id", "size", F.expr(f"w % {groups}").alias("w"), F.expr(f"w div {groups}").alias("k"), "bit")
        held = [F.bit_or(F.when(F.col("k") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))) for k in range(WORDS // groups)]
    else:
        held = [F.bit_or("bit")]
    words = bits.groupBy("id", "size", "w").agg(*[h.alias(f"word{k}") for k, h in enumerate(held)])
    made = words.groupBy("id", "size").agg(*[F.coalesce(F.max(F.when(F.col("w") == w % groups, F.col(f"word{w // groups}"))), F.lit(0)).cast("long").alias(f"w{w}") for w in range(WORDS)])
    return made.withColumn("bits", F.expr(" + ".join(f"bit_count(w{w})" for w in range(WORDS))).cast("long"))


def may_be_linked(percent: int) -> F.Column:
    """Whether two sets of :func:`sketches` can have a Jaccard index of ``percent``.

    A bit of one that the other lacks is an element of its own, so they share
    at most the common bits and those elements that set no bit of their own.
    Close to the truth while sets are small against the number of bits, valid for all.
    """
    # one count of common bits a pair keeps the generated code of the join small
    common = F.expr(" + ".join(f"bit_count(w{w} & w{w}_2)" for w in range(WORDS)))
    most = common + F.least(F.col("size") - F.col("bits"), F.col("size_2") - F.col("bits_2"))
    near = F.expr(f"100 * size_2 >= {percent} * size and 100 * size >= {percent} * size_2")
    return near & ((100 + percent) * most >= percent * (F.col("size") + F.col("size_2")))


#: Members up to which all pairs of a bucket are looked at, some 0.1 ms a member; members of larger ones meet by rare elements.
BUCKET = 4096


def linked(
    sets: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame],
    sketch: Callable[[DataFrame], DataFrame],
    percent: int,
    place: Scratch,
) -> DataFrame:
    """Components of sets that share a band key and pass ``verify``: (id, root), staged in ``place``, ids without a link left out.

    ``sets`` is a staged table (id, weight, keys), ids unique, keys one per band
    (without a weight, the larger of two ids stands for the larger weight);
    ``fetch`` takes all ids that share a key and returns (id, text), the only
    time that texts are looked up; ``verify`` takes pairs (a, b, total), total the
    sum of their sets' sizes, and those texts,
    and returns the pairs that are truly linked; ``sketch`` returns the sketches
    of those texts, whose bound drops most other pairs before. First every
    member is held against its bucket's member of the largest weight (how often
    its text occurs: an original rather than a changed copy; the same one in all
    buckets that hold several of one weight), so a hot bucket costs one pair per
    member and is pre-aggregated before the exchange. After the
    union-find only buckets whose members are in different components are left:
    pairs inside a component cannot change it. In a bucket of up to BUCKET
    members all pairs of different components are held against the bound of
    their sketches. Members of larger buckets do not meet in pairs, but by the
    rare elements of their sets (``elements`` of texts is (id, items), items
    distinct): see ``meetings``. Either way is exact, so no link between members
    is lost. The links found then join the components of before.
    """
    with Scratch(sets.sparkSession, "linked") as scratch:
        ends = [F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")]
        if "weight" in sets.columns:
            # weights first, then a hash of the id, in one number
            rank = F.least("weight", F.lit((1 << 22) - 1)) * F.lit(1 << 40) + F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))
            keyed = sets.select("id", rank.alias("rank"), F.explode("keys").alias("key"))
            found = keyed.groupBy("key").agg(F.max_by("id", "rank").alias("a"), *ends).where("n > 1")
        else:
            keyed = sets.select("id", F.explode("keys").alias("key"))
            found = keyed.groupBy("key").agg(*ends).where("n > 1").withColumn("a", F.col("hi"))
        leaders = scratch.stage(found, "leaders")
        # the members of a bucket of two are known by now; only for larger ones the sets are read again
        two = leaders.where("n = 2").select("key", "a", F.explode(F.array("lo", "hi")).alias("b"))
        with settings(sets.sparkSession, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
            shared = scratch.stage(keyed.join(if_few(leaders.where("n > 2").select("key", "a")), "key").select("key", "a", F.col("id").alias("b")).union(two), "buckets")
        # staged, not held: a held table's whole plan would stand in every plan that reads it, and all of those stay with the driver
        texts = scratch.stage(fetch(scratch.stage(shared.select(F.col("b").alias("id")).distinct(), "sharing")), "texts")
        sketched = scratch.stage(sketch(texts), "sketches")
        other = sketched.select(*[F.col(c).alias(f"{c}_2") for c in sketched.columns])
        pairs = shared.where("a <> b").select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("id_2")).distinct()
        pairs = pairs.join(sketched, "id").join(other, "id_2").where(may_be_linked(percent)).select(F.col("id").alias("a"), F.col("id_2").alias("b"), (F.col("size") + F.col("size_2")).alias("total"))
        links = verify(pairs, texts)
        first = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
        rooted = shared.join(first.withColumnRenamed("id", "b"), "b", "left").select("key", "a", "b", F.coalesce("root", "b").alias("root"))
        # the leader has met everyone; only other members can still be linked across components
        mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key", "n")
        rest = scratch.stage(rooted.join(mixed, "key").where("a <> b").select("key", "n", F.col("b").alias("id"), "root"), "rest")
        largest = rest.agg(F.max("n")).first()[0]
        if largest is None:
            return place.stage(first, "roots")
        # of the buckets that two members share, only that of the least key makes a row of them
        held = rest.where(F.col("n") <= BUCKET).groupBy("id", "root").agg(F.collect_set("key").alias("keys"))
        each = held.join(sketched, "id").withColumn("key", F.explode("keys"))
        other = each.select("key", *[F.col(c).alias(f"{c}_2") for c in each.columns if c != "key"])
        close = each.join(other, "key").where((F.col("root") < F.col("root_2")) & may_be_linked(percent) & (F.col("key") == F.array_min(F.array_intersect("keys", "keys_2"))))
        close = close.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"), F.col("root").alias("x"), F.col("root_2").alias("y"), (F.col("size") + F.col("size_2")).alias("total"))
        if largest > BUCKET:
            many = rest.where(F.col("n") > BUCKET).select("id", "root").distinct()
            items = elements(texts.join(if_few(many.select("id")), "id", "left_semi"))
            sets_of = items.select("id", F.size("items").cast("long").alias("n"), "items").join(many, "id")
            far = meetings(listed(sets_of, percent, "root"), percent, scratch)
            for end in ("a", "b"):
                far = far.join(sketched.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}")), end)
            close = close.union(far.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("size_a") + F.col("size_b")))
        # loops over pairs of so many columns are too long to be compiled well in one method
        with settings(sets.sparkSession, spark__sql__codegen__hugeMethodLimit=LONG_METHOD):
            across = scratch.stage(close.dropDuplicates(["a", "b"]), "across")
        more = scratch.stage(verify(across.select("a", "b", "total"), texts).join(across, ["a", "b"]).select(F.col("x").alias("src"), F.col("y").alias("dst")), "more")
        if more.isEmpty():
            return place.stage(first, "roots")
        second = components(more, scratch)
        moved = first.join(second.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        return place.stage(moved.union(second).distinct(), "roots")
