"""Exact top-k inner products through a pivot-distance index.

Vectors are quantised to floor(scale * x). One more component, sqrt(M - |v|^2)
with M the largest squared norm, makes all of them equally long, so the largest
inner product is the smallest distance: |q|^2 + M - 2 q.v. The index keys every
vector by its nearest pivot and its distance to it, in one global order of
(pivot, distance, id) cut into blocks, so equal vectors, however many, spread
over blocks. Each block is an annulus of its pivot: every vector in it is at
least max(0, d(q,p) - far, near - d(q,p)) away from a query q.

Components are kept in the smallest type that holds them all. Slices of the
index and groups of queries make a grid of cells, each a task of bounded size;
a slice goes to a cell once for a whole group of queries. A query starts with
the k-th best score of its own block as a threshold. In its cell it meets the
blocks of a slice from the nearest outwards: an annulus takes no part if the
triangle inequality bounds it under the thresholds of all queries of a block,
a query leaves out a block whose annuli are all bounded under its own, and a
threshold rises as better rows are found. Only the top k of a query in a slice
leave the cell; a window picks the k best of all.

Defined results: vectors that are null, empty, or hold null or non-finite
components, or are not of the commonest length, or whose id is null, take no
part; equal scores are ordered by smaller id; a query leaves out all rows of
its own id; repeated rows are searched once and ranked separately, as in the
SQL: each pair of a row of the query and a row of the neighbour takes a rank of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm._common import arrow_map, stage

#: Pivots, rows and bytes of the bounded sample that they are chosen from, rows of an index block and of a query block.
PIVOTS, SAMPLE, SAMPLE_BYTES, BLOCK, QUERIES = 32, 2_000, 8 << 20, 1_024, 512
#: Bytes of index rows, or of queries with what they hold, in a cell; pairs below which a cell is not cut further; cells for each core.
CELL, PAIRS, CELLS = 48 << 20, 1 << 24, 8
#: Lower than any score, higher than any id.
LOWEST, LAST = -(2**62), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, with whole-number components."""
    v = F.col("embedding")
    good = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).select("vec_id", v.cast("array<double>").alias("d"))
    finite = good.where(F.forall("d", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    return finite.select("vec_id", F.transform("d", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _kind(most: float) -> str:
    """The smallest type of components up to ``most``."""
    return next((f"<i{n}" for n in (1, 2, 4) if most < 2 ** (8 * n - 1)), "<f8")


def _to_binary(rows: np.ndarray) -> pa.Array:
    """A binary of its bytes for each row."""
    step = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(rows) * step + 1, step, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _from_binary(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sample's row farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _products(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Whole-number inner products, exact, of components up to ``most``: in the smallest floats that hold all sums, else in int64."""
    sums = most * most * left.shape[1]
    kind = np.float32 if sums < 2**24 else np.float64 if sums < 2**53 else np.int64
    return left.astype(kind) @ right.astype(kind).T


@dataclass
class Block:
    """Rows of an index block, how often each occurs, and the row ranges, pivots and distances of its annuli."""

    ids: np.ndarray
    rows: np.ndarray
    times: np.ndarray
    edges: np.ndarray
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, blocks: list[Block], chosen: np.ndarray, top: float, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best rows in ``blocks`` that reach its floor: number of the query, id, score and how often the row occurs."""
    wide = queries.astype(np.float64)
    to_pivots, norms = _distances(np.concatenate([wide, np.zeros((len(wide), 1))], 1), chosen), (wide * wide).sum(1)
    slack = 1e-5 * (1 + np.sqrt(top))

    def reach(block: Block) -> np.ndarray:
        """The highest score that each annulus can hold for each query."""
        away = to_pivots[:, block.pivots]
        gap = np.maximum(0.0, np.maximum(away - block.far, block.near - away) - slack)
        return (norms[:, None] + top - gap * gap) / 2 + 0.5 + 1e-12 * top

    floors, last = floors.copy(), np.full(len(queries), LAST)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]

    def merge() -> None:
        who, ids, scores, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -scores, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        order, who, place = order[place < k], who[place < k], place[place < k]
        found[:] = [(who, ids[order], scores[order], times[order])]
        full = place == k - 1
        floors[who[full]], last[who[full]] = scores[order][full], ids[order][full]

    bounds = [reach(b) for b in blocks]
    pending = 0
    for n in sorted(range(len(blocks)), key=lambda n: -float(bounds[n].max(initial=-np.inf))):
        block, may = blocks[n], bounds[n] >= floors[:, None]
        asking, cuts = np.flatnonzero(may.any(1)), may.any(0)
        if not len(asking):
            continue
        rows, ids, times = block.rows, block.ids, block.times
        if not cuts.all():
            among = np.repeat(cuts, np.diff(block.edges))
            rows, ids, times = rows[among], ids[among], times[among]
        scores = _products(queries[asking], rows, most)
        hit = np.flatnonzero(scores >= floors[asking].astype(scores.dtype)[:, None])
        if not len(hit):
            continue
        at, row = np.divmod(hit, len(ids))
        who, score = asking[at], scores.ravel()[hit].astype(np.int64)
        # of rows that only equal the k-th best, smaller ids count
        good = (ids[row] != query_ids[who]) & ((score > floors[who]) | (ids[row] < last[who]))
        found.append((who[good], ids[row][good], score[good], times[row][good]))
        pending += int(good.sum())
        if pending > 4 * k * len(queries):
            merge()
            pending = 0
    merge()
    return found[0]


@dataclass
class Index:
    """The staged blocks, the pivots, the largest squared norm and component, the number of components, their type and the rows."""

    blocks: DataFrame
    pivots: np.ndarray
    top: float
    most: float
    dim: int
    kind: str
    rows: int


def build_index(vectors: DataFrame, scale: int, pivots: int, block: int) -> Index | None:
    # equal rows are one from here on: repeats would raise the thresholds and fill the k best
    every = stage(quantised(vectors, scale).groupBy("vec_id", "v").agg(F.count("*").alias("times")), "vectors")
    norm, largest = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), F.greatest(F.array_max("v"), -F.array_min("v"))
    sizes = every.groupBy(F.size("v").alias("dim")).agg(F.sum("times").alias("n"), F.count("*").alias("rows"), F.max(norm).alias("top"), F.max(largest).alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim, top, most, count = int(sizes["dim"]), float(sizes["top"]), float(sizes["most"]), int(sizes["rows"])
    kind = _kind(most)
    good = every.where(F.size("v") == dim)
    chosen = choose_pivots(_lifted(sample_rows(good, count, dim, pivots), top), pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            away = _distances(_lifted(v, top), chosen)
            near = away.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _to_binary(v.astype(kind)), batch.column(2), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], names=["vec_id", "v", "times", "pivot", "away"])

    rows = stage(arrow_map(good.select("vec_id", "v", "times"), keyed, "vec_id bigint, v binary, times bigint, pivot int, away double"), "keyed")
    parts = max(1, -(-count // (16 * block)))
    ordered = rows.repartitionByRange(parts, "pivot", "away", "vec_id").sortWithinPartitions("pivot", "away", "vec_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _from_binary(batch.column(1), dim, kind)
            times, pivot, away = (batch.column(i).to_numpy() for i in (2, 3, 4))
            for a in range(0, len(ids), block):
                b = min(a + block, len(ids))
                edges = [a, *(a + 1 + np.flatnonzero(pivot[a + 1 : b] != pivot[a : b - 1])).tolist(), b]
                cuts = [(x, min(x + 256, y)) for s, y in zip(edges[:-1], edges[1:], strict=True) for x in range(s, y, 256)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[a:b].astype("<i8").tobytes()], pa.binary()),
                        pa.array([v[a:b].tobytes()], pa.binary()),
                        pa.array([times[a:b].astype("<i8").tobytes()], pa.binary()),
                        pa.array([[x - a for x, _ in cuts] + [b - a]], pa.list_(pa.int32())),
                        pa.array([[int(pivot[x]) for x, _ in cuts]], pa.list_(pa.int32())),
                        pa.array([[float(away[x]) for x, _ in cuts]], pa.list_(pa.float64())),
                        pa.array([[float(away[y - 1]) for _, y in cuts]], pa.list_(pa.float64())),
                    ],
                    names=["ids", "rows", "times", "edges", "pivots", "near", "far"],
                )

    blocks = arrow_map(ordered, packed, "ids binary, rows binary, times binary, edges array<int>, pivots array<int>, near array<double>, far array<double>")
    return Index(stage(blocks, "blocks"), chosen, top, most, dim, kind, count)


def sample_rows(rows: DataFrame, count: int, dim: int, pivots: int) -> np.ndarray:
    """A bounded sample of ``count`` rows with a column v.

    Rows are drawn by their hash before they are put in order: of all rows,
    every task would send the driver as many as the whole sample has.
    """
    most = max(4 * pivots, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    number = F.xxhash64("vec_id", "v")
    drawn = rows.where(number < F.lit(-(2**63) + 2**64 * most // count)) if count > most else rows
    return np.array([r["v"] for r in drawn.orderBy(number, "vec_id").limit(most).select("v").collect()]).reshape(-1, dim)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))[:, None]], 1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)))


def grid(rows: int, queries: int, width: int, k: int, cores: int) -> tuple[int, int]:
    """Slices of the index and groups of queries: as few as fit a cell each, more where there are cores to use, and about as many bytes of one as of the other to be sent."""
    index, asked = rows * (width + 24), queries * (width + 24 + 24 * k)
    slices, groups = max(1, -(-index // CELL)), max(1, -(-asked // CELL))
    while slices * groups < CELLS * cores and rows * queries > PAIRS * slices * groups:
        if index * groups <= asked * slices:
            groups += 1
        else:
            slices += 1
    return slices, groups


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows whose id is divisible by ``every``."""
    schema, spark = "query_id bigint, rank int, vec_id bigint, score bigint", vectors.sparkSession
    index = build_index(vectors, scale, pivots, block)
    if index is None:
        return spark.createDataFrame([], schema)
    chosen, top, most, dim, kind = index.pivots, index.top, index.most, index.dim, index.kind

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries in blocks, each with the k-th best score of its own index block."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([len(parts[0])], pa.int64())], names=["q_ids", "q_rows", "q_times", "floors", "n"])

        for batch in batches:
            for ids, rows, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, rows, times = np.frombuffer(ids, "<i8"), np.frombuffer(rows, kind).reshape(-1, dim), np.frombuffer(times, "<i8")
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                floors = np.full(len(mine), LOWEST)
                if len(ids) >= k:
                    scores = _products(rows[mine], rows, most).astype(np.int64)
                    scores[ids[mine][:, None] == ids] = LOWEST
                    floors = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                held.append((ids[mine], rows[mine].ravel(), times[mine], floors))
                if sum(len(h[0]) for h in held) >= QUERIES:
                    yield out()
        if held:
            yield out()

    queries = stage(arrow_map(index.blocks.select("ids", "rows", "times"), starts, "q_ids binary, q_rows binary, q_times binary, floors binary, n bigint"), "queries")
    asked = queries.agg(F.sum("n")).first()[0]
    if asked is None:
        return spark.createDataFrame([], schema)
    # a stated query set against all rows: each cell of the grid holds a slice of the index against a group of the queries
    slices, groups = grid(index.rows, asked, dim * np.dtype(kind).itemsize, k, spark.sparkContext.defaultParallelism)
    first = F.pmod(F.xxhash64("ids"), F.lit(slices)) * groups
    sliced = index.blocks.withColumn("cell", F.explode(F.sequence(first, first + (groups - 1))))
    group = F.pmod(F.xxhash64("q_ids"), F.lit(groups))
    grouped = queries.drop("n").withColumn("cell", F.explode(F.sequence(group, group + (slices - 1) * groups, F.lit(groups).cast("bigint"))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        ints = lambda raw: np.frombuffer(raw, "<i8")
        blocks = [
            Block(ints(r["ids"]), np.frombuffer(r["rows"], kind).reshape(-1, dim), ints(r["times"]), np.array(r["edges"]), np.array(r["pivots"]), np.array(r["near"]), np.array(r["far"]))
            for r in right.to_pylist()
        ]
        parts = [(np.zeros(0, np.int64),) * 4]
        for q in left.to_pylist() if blocks else []:
            ids = ints(q["q_ids"])
            who, found, scores, times = search(np.frombuffer(q["q_rows"], kind).reshape(-1, dim), ids, ints(q["floors"]), blocks, chosen, top, most, k)
            parts.append((ids[who], found, scores, np.minimum(k, times * ints(q["q_times"])[who])))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], names=["query_id", "vec_id", "score", "times"])

    # cells are few and large: so many partitions that few of them hold several
    tasks = 2 * slices * groups
    cells = grouped.repartition(tasks, "cell").groupBy("cell").cogroup(sliced.repartition(tasks, "cell").groupBy("cell"))
    scored = cells.applyInArrow(probe, "query_id bigint, vec_id bigint, score bigint, times bigint")
    each = scored.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
