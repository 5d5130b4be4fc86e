"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A language's profile is the ranking of its most frequent character 1- to
3-grams over letters (other characters act as word ends). A document's own most
frequent n-grams are ranked alike; its distance to a language is the sum of the
rank differences, an n-gram that the profile lacks costing the profile's full
length. The nearest language wins, ties to the smaller name.

Profiles are learnt from a bounded sample of labelled documents (``max_rows``);
every row is scored on its whole text.

Defined results: null text or text without a letter is ``und`` with score 0;
rows with null lang are not learnt from; without any training row everything is
``und``; very long texts are read whole; repeated rows are scored alike; other
columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.llm._common import crc_col, crc_of_id, map_arrow

#: N-gram sizes, and how many n-grams a profile holds.
SIZES, LENGTH = (1, 2, 3), 300


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a blank on both sides, and each text's start."""
    low = [f" {t.lower()} " for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    edge = np.cumsum([0, *map(len, low)])
    return np.where(_letters()[data], data, 32), edge


def ranked(texts: list[str], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``length`` most frequent n-grams of each text.

    Returns row numbers, ranks from 0, n-gram codes, and the alphabet of code
    points in which the codes are written. Ties go to the smaller code point
    sequence, shorter first.
    """
    points, edge = _points(texts)
    alphabet, letter = np.unique(np.append(points, 32), return_inverse=True)
    letter = letter[:-1].astype(np.uint64) + np.uint64(1)
    blank = np.uint64(np.searchsorted(alphabet, 32) + 1)
    base = np.uint64(len(alphabet) + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(edge))
    codes, rows = [], []
    for size in SIZES:
        if len(letter) < size:
            continue
        end = len(letter) - size + 1
        code = np.zeros(end, np.uint64)
        useful = owner[:end] == owner[size - 1 :]
        inner = np.zeros(end, bool)
        for i in range(size):
            code = code * base + letter[i : end + i]
            inner |= letter[i : end + i] != blank
            if 0 < i < size - 1:
                useful &= letter[i : end + i] != blank
        useful &= inner
        codes.append(code[useful])
        rows.append(owner[:end][useful])
    codes, rows = np.concatenate(codes), np.concatenate(rows).astype(np.uint64)
    span = base * base * base
    if float(span) * (len(texts) + 1) >= 2**63:
        if len(texts) == 1:
            raise ValueError("one text uses too many different characters")
        half = len(texts) // 2
        return _joined(ranked(texts[:half], length), ranked(texts[half:], length), half)
    keys = np.sort(rows * span + codes)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), alphabet
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    rows, codes = (keys // span).astype(np.int64), keys % span
    order = np.lexsort((codes, -counts, rows))
    rows, codes = rows[order], codes[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = rank < length
    return rows[top], rank[top], codes[top], alphabet


def _joined(a: tuple, b: tuple, shift: int) -> tuple:
    """Two results under one alphabet."""
    alphabet = np.union1d(a[3], b[3])

    def recode(x: tuple) -> np.ndarray:
        old, new, out, scale = np.uint64(len(x[3]) + 1), np.uint64(len(alphabet) + 1), np.zeros(len(x[2]), np.uint64), np.uint64(1)
        place = np.concatenate([[0], np.searchsorted(alphabet, x[3]) + 1]).astype(np.uint64)
        rest = x[2].copy()
        for _ in range(max(SIZES)):
            out += place[rest % old] * scale
            rest //= old
            scale *= new
        return out

    return np.concatenate([a[0], b[0] + shift]), np.concatenate([a[1], b[1]]), np.concatenate([recode(a), recode(b)]), alphabet


def grams_of(codes: np.ndarray, alphabet: np.ndarray) -> list[str]:
    """N-grams as text."""
    base = len(alphabet) + 1
    out = []
    for code in codes.tolist():
        points = []
        while code:
            points.append(chr(alphabet[code % base - 1]))
            code //= base
        out.append("".join(reversed(points)))
    return out


def distances(texts: list[str], profiles: dict[str, list[str]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of every text (rows) to every language (columns), and each text's number of n-grams."""
    rows, rank, codes, alphabet = ranked(texts, length)
    base, at = len(alphabet) + 1, {chr(c): i + 1 for i, c in enumerate(alphabet.tolist())}
    out = np.zeros((len(texts), len(profiles)))
    for column, grams in enumerate(profiles.values()):
        own = {}
        for place, gram in enumerate(grams):
            if all(c in at for c in gram):
                code = 0
                for c in gram:
                    code = code * base + at[c]
                own[code] = place
        keys = np.array(sorted(own), np.uint64)
        places = np.array([own[k] for k in keys.tolist()], np.int64)
        cost = np.full(len(rows), length, np.int64)
        if len(keys):
            found = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = keys[found] == codes
            cost[hit] = np.minimum(np.abs(rank[hit] - places[found[hit]]), length)
        out[:, column] = np.bincount(rows, cost, len(texts))
    return out, np.bincount(rows, minlength=len(texts))


def train(docs: DataFrame, length: int = LENGTH, max_rows: int = 4_000) -> dict[str, list[str]]:
    """Profiles by language, from the labelled documents of at most ``max_rows`` ids (smallest hash of the id first).

    Learns only from rows whose crc32(id) mod 3 is not 1. N-grams are counted
    on the executors; the driver gets the top ``length`` of each language.
    """
    marked = docs.where(F.col("lang").isNotNull() & ((crc_col() % 3) != 1))
    # the sample is chosen by narrow rows; only then are its texts read
    ids = marked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = marked.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
        names = sorted(set(langs))
        rows, counts, grams = [], [], []
        for name in names:
            points, edge = _points([t for own, t in zip(langs, texts, strict=True) if own == name])
            text = "".join(map(chr, points.tolist()))
            for size in SIZES:
                held: dict[str, int] = {}
                for i in range(len(text) - size + 1):
                    gram = text[i : i + size]
                    if " " not in gram[1:-1] and gram.strip():
                        held[gram] = held.get(gram, 0) + 1
                grams += held.keys()
                counts += held.values()
                rows += [name] * len(held)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counted = map_arrow(chosen, run, "lang string, gram string, n bigint", "text").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length).select("lang", "gram", "rank").collect()
    profiles: dict[str, list[str]] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def identify(texts: list[str | None], profiles: dict[str, list[str]], length: int = LENGTH) -> tuple[list[str], list[float]]:
    """Language and score (1 at distance 0, 0 if no n-gram is shared) of each text."""
    if not profiles:
        return ["und"] * len(texts), [0.0] * len(texts)
    away, sizes = distances([t or "" for t in texts], profiles, length)
    names = list(profiles)
    best = away.argmin(1)
    score = 1 - away.min(1) / np.maximum(sizes * length, 1)
    known = sizes > 0
    return [names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0).tolist()


def predict(docs: DataFrame, profiles: dict[str, list[str]], length: int = LENGTH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = identify(batch.column(1).to_pylist(), profiles, length)
        ids = batch.column(0).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([crc_of_id(i) % 3 == 1 for i in ids], pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double", "text", 1 << 20)
