"""Secret scans: key patterns, plus character Markov models of random strings.

Base kinds (assign, access, hex) are regular expressions over the whole text.
Further kind ``random``: long tokens for which a character bigram model of
random strings is likelier than one of ordinary identifiers, by more than
``margin`` nats a character. Both models are trained from labelled samples:
random strings drawn from the alphabets of real keys by a seeded generator,
and ordinary names joined in the usual styles.

Defined results: null text is empty; spans are code points, end exclusive; a
``random`` span never overlaps a base span; equal starts are ordered by kind;
texts of any length are scanned whole; repeated rows are scanned alike; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweir.llm._arrays import bounds, flat, runs
from tallyweir.llm._common import map_arrow

KINDS = ("assign", "access", "hex", "random")


def _either_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


#: The word of an assignment; only A-Z and a-z count as the cases of a letter.
_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
#: Bytes of a token that the models judge.
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[*(string.ascii_letters + string.digits + "+/_=-").encode()]] = True

#: Ordinary words of program names, a fixed list.
_NAMES = (
    "account action address agent amount array backup batch block buffer build cache call channel char check child class client code color column command config connection content context copy count create cursor data date default delete device directory document driver element email enable encode entry error event field file filter find first flag folder format frame function get global group handle hash header height host image index info input insert instance item job key label last length level limit line link list load local lock log loop map mask match max memory message method min mode model module mouse name network next node number object offset open option order output owner page param parent parse path pattern pixel plugin point port prefix process product profile project property proxy query queue random range rate read record region remote remove render report request reset resource response result return role root row rule sample save schema score scope script search section select sequence server service session set setting shape size sort source span stack start state status step storage stream string style suffix sum switch system table tag target task temp test text thread time title total trace tree trigger type unit update upload url user valid value vector version view visible width window word worker write zone"
).split()


def _classes() -> np.ndarray:
    """A small number for each byte: letters and digits by themselves, the rest of a token together."""
    out = np.full(256, 62, np.int64)
    for i, c in enumerate(string.ascii_letters + string.digits):
        out[ord(c)] = i
    return out


_CLASS = _classes()
_STATES = 64


def labelled_samples(n: int = 6_000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Random strings, and ordinary identifiers in the common styles."""
    draw = np.random.default_rng(seed)
    alphabets = [string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits]
    keys = ["".join(draw.choice([*alphabets[i % len(alphabets)]], int(draw.integers(20, 48)))) for i in range(n)]
    names = []
    for i in range(n):
        words = [str(w) for w in draw.choice(_NAMES, int(draw.integers(2, 6)))]
        style = i % 5
        if style == 0:
            names.append("_".join(words))
        elif style == 1:
            names.append(words[0] + "".join(w.title() for w in words[1:]))
        elif style == 2:
            names.append("".join(w.title() for w in words))
        elif style == 3:
            names.append("-".join(words) + (str(int(draw.integers(0, 100))) if i % 2 else ""))
        else:
            names.append("_".join(words).upper())
    return keys, names


class CharacterModels:
    """Bigram models of two classes of strings, compared by their log-likelihood ratio."""

    def __init__(self, positive: list[str], negative: list[str]):
        self.ratio = self._fit(positive) - self._fit(negative)

    @staticmethod
    def _fit(samples: list[str]) -> np.ndarray:
        counts = np.full((_STATES, _STATES), 0.5)
        for text in samples:
            states = np.concatenate([[63], _CLASS[np.frombuffer(text.encode(), np.uint8)]])
            np.add.at(counts, (states[:-1], states[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    def per_character(self, token: bytes) -> float:
        """The mean log-likelihood ratio of a token's characters."""
        states = np.concatenate([[63], _CLASS[np.frombuffer(token, np.uint8)]])
        return float(self.ratio[states[:-1], states[1:]].mean())


@functools.cache
def default_models() -> CharacterModels:
    return CharacterModels(*labelled_samples())


def scan(texts: pa.Array, models: CharacterModels | None = None, margin: float = 0.3, least: int = 20) -> list[list[tuple[int, int, str]]]:
    """All spans of every text. Byte runs come from one array pass; regular expressions run on texts that can match."""
    models = models or default_models()
    data, offsets = flat(texts)
    raw = data.tobytes()
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]

    # code points before each byte: bytes 0x80 to 0xBF continue one
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def points(row: int, at: int) -> int:
        return int(before[at] - before[offsets[row]])

    starts, ends, rows = runs(_IS_HEX[data], offsets)
    long = ends - starts >= 24
    for a, b, row in zip(starts[long].tolist(), ends[long].tolist(), rows[long].tolist(), strict=True):
        begin = points(row, a)
        out[row].append((begin, begin + b - a, "hex"))
    for row in range(len(texts)):
        one = raw[offsets[row] : offsets[row + 1]]
        low = one.lower()
        if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
            text = one.decode()
            out[row] += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if b"AKIA" in one:
            text = one.decode()
            out[row] += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for spans in out:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    starts, ends, rows = runs(_IS_TOKEN[data], offsets)
    long = ends - starts >= least
    edge = bounds(rows[long], len(texts))
    heads, tails = starts[long].tolist(), ends[long].tolist()
    for row in np.flatnonzero(np.diff(edge)).tolist():
        base, at, reach, found = out[row], 0, 0, []
        # tokens and base spans are in order of their starts: one walk over both tells overlaps
        for a, b in zip(heads[edge[row] : edge[row + 1]], tails[edge[row] : edge[row + 1]], strict=True):
            begin = points(row, a)
            end = begin + b - a
            while at < len(base) and base[at][0] < end:
                reach = max(reach, base[at][1])
                at += 1
            if reach <= begin and models.per_character(raw[a:b]) > margin:
                found.append((begin, end, "random"))
        if found:
            base += found
            base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, margin: float = 0.3, least: int = 20) -> DataFrame:
    """Per document: counts of the base kinds, their digest, the number of random tokens, and all spans as text."""
    models = default_models()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan(batch.column(1), models, margin, least)
        base = [[s for s in spans if s[2] != "random"] for spans in found]
        count = lambda kind, rows: pa.array([sum(s[2] == kind for s in r) for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(count(k, base) for k in KINDS[:3]),
                pa.array([hashlib.sha256(_shown(r).encode()).hexdigest() for r in base], pa.string()),
                pa.array([_shown(r) for r in found], pa.string()),
                count("random", found),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
        )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return map_arrow(docs.select("doc_id", "text"), run, schema, "text")
