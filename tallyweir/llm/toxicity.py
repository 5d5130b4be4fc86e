"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

Terms are lower-cased words, their leading stems and the pairs' interactions
that the factors learn: an insult next to a group mention can weigh more than
the two alone. The model is fitted on a bounded sample of labelled rows
(``max_rows``, smallest xxhash64 first, so the sample does not depend on
partitioning); scoring covers every whole text of every row.

Defined results: a null or empty text has no terms and scores by the bias
alone; texts of any length are read whole; repeated rows score alike; labels
that are null are no training rows; with no usable labels every score is 0.5;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm._arrays import LOWER, bounds, flat, mix, run_hashes, runs
from tallyweir.llm._common import crc_col, crc_of_id, map_arrow

#: Bytes that are no part of a term: ASCII other than letters and digits.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Leading bytes of a word that count as terms of their own, so that inflected forms share evidence.
STEMS = (4, 5, 6)


def term_ids(column: pa.Array, bits: int) -> list[np.ndarray]:
    """Each text's distinct hashed terms, as numbers below 2 ** bits."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = runs(~_GAP[data], offsets)
    found, owner = [run_hashes(data, starts, ends)], [rows]
    for size in STEMS:
        long = ends - starts > size
        found.append(mix(run_hashes(data, starts[long], starts[long] + size) + np.uint64(size)))
        owner.append(rows[long])
    terms, rows = np.concatenate(found) >> np.uint64(64 - bits), np.concatenate(owner)
    both = np.unique((rows.astype(np.uint64) << np.uint64(bits)) | terms)
    edge = bounds((both >> np.uint64(bits)).astype(np.int64), len(column))
    ids = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


@dataclass
class FactorizationMachine:
    """Weights over 2 ** bits hashed terms; only terms seen in ``min_rows`` training rows count."""

    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of distinct term ids."""
        sizes = np.array([len(r) for r in rows], np.int64)
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            ids = np.concatenate([rows[i] for i in full])
            begins = np.cumsum(sizes[full]) - sizes[full]
            factors = self.factors[ids]
            total = np.add.reduceat(factors, begins)
            square = np.add.reduceat((factors * factors).sum(1), begins)
            out[full] += np.add.reduceat(self.weights[ids], begins) + 0.5 * ((total * total).sum(1) - square)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, rank: int = 4, epochs: int = 8, rate: float = 0.5, decay: float = 2e-3, min_rows: int = 6, seed: int = 7) -> FactorizationMachine:
    """Trains by mini-batch AdaGrad on the logistic loss."""
    size = 1 << bits
    model = FactorizationMachine(bits, 0.0, np.zeros(size), np.zeros((size, rank)))
    labels = np.asarray(labels, float)
    if not len(rows) or labels.min() == labels.max():
        model.bias = 0.0 if not len(rows) else 4.0 * (2 * labels[0] - 1)
        return model
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=size)
    usable = seen >= min_rows
    rows = [r[usable[r]] for r in rows]
    random = np.random.default_rng(seed)
    model.factors[usable] = random.normal(0, 0.01, (int(usable.sum()), rank))
    model.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    past_w, past_v, past_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 64)):
            own = [rows[i] for i in part]
            error = model.scores(own) - labels[part]
            sizes = np.array([len(r) for r in own])
            ids = np.concatenate(own)
            if not len(ids):
                continue
            which = np.repeat(np.arange(len(part)), sizes)
            terms, place = np.unique(ids, return_inverse=True)
            factors = model.factors[ids]
            total = np.zeros((len(part), rank))
            np.add.at(total, which, factors)
            step = error[which][:, None] * (total[which] - factors)
            grad_v = np.stack([np.bincount(place, step[:, f], len(terms)) for f in range(rank)], 1) / len(part) + decay * model.factors[terms]
            grad_w = np.bincount(place, error[which], len(terms)) / len(part) + decay * model.weights[terms]
            past_w[terms] += grad_w**2
            past_v[terms] += grad_v**2
            past_b += (g := error.mean()) ** 2
            model.weights[terms] -= rate * grad_w / np.sqrt(past_w[terms])
            model.factors[terms] -= rate * 0.3 * grad_v / np.sqrt(past_v[terms])
            model.bias -= rate * g / np.sqrt(past_b)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = 18, max_rows: int = 12_000, **options: float) -> FactorizationMachine:
    """Fits on at most ``max_rows`` labelled rows (smallest xxhash64 of the id first).

    Only rows whose crc32(id) mod 5 is not 0 are learnt from. Term lists are
    made on the executors; the driver receives the sample's term numbers only.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y")).where((crc_col() % 5) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.astype(np.int32) for x in term_ids(batch.column(1), bits)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "y", "ids"])

    found = map_arrow(sample.select("doc_id", "text", "y"), run, "doc_id bigint, y int, ids binary", "text").toPandas()
    found["key"] = [x for x in found["ids"]]
    found = found.sort_values(["doc_id", "key"])
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in found["ids"]]
    return fit(rows, found["y"].to_numpy(), bits, **options)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The model has a fixed size (2 ** bits terms) and travels as one broadcast variable.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = FactorizationMachine(*held.value)
        scores = own.scores(term_ids(batch.column(1), own.bits))
        ids = batch.column(0).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([crc_of_id(i) % 5 == 0 for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, held_out boolean, score double, predicted int", "text")
