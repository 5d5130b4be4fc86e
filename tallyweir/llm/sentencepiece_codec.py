"""SentencePiece encoding and decoding with original byte spans.

The model file is parsed here: flags, pieces and the compiled character map (a
double-array trie over UTF-8 prefixes plus replacement strings). ``Normalizer``
walks a text by longest prefix through that map and records, for every byte it
writes, which source bytes it stands for. The normalised text is segmented by
the library under an identity normaliser, and piece lengths are projected
through the recorded alignment to byte spans of the original text.

Defined results: null text is empty; an empty text has no pieces but the
requested end id; repeated rows and ids are encoded row by row; texts of any
length are encoded whole; other columns are carried or ignored by name.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyweir.llm._common import arrow_map, map_arrow

_BLANK = "▁".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _message(parts: list[tuple[int, int | bytes]]) -> bytes:
    """A message of varint and length-delimited fields."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    return b"".join(varint(f << 3) + varint(v) if isinstance(v, int) else varint(f << 3 | 2) + varint(len(v)) + v for f, v in parts)


class Normalizer:
    """Longest-prefix normalisation through a compiled character map, with alignment."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        charsmap = got.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.strings = charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest source prefix at ``at`` that the map replaces: its length and replacement."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        node ^= (units[0] >> 10) << ((units[0] & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & ((1 << 31) | 255) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return best

    def chunks(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source start, source end and replacement of each prefix; plain characters map to themselves."""
        at = 0
        while at < len(text):
            found = self.longest(text, at)
            if found:
                yield at, at + found[0], found[1]
                at += found[0]
            else:
                lead = text[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, at + size, text[at : at + size]
                at += size

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and where each of them begins in ``text`` (one more: its end)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.units and not self.squeeze:
            return self._plain(text)
        parts = [(a, b, c) for a, b, c in self.chunks(text) if c]
        mark = _BLANK if self.escape else b" "
        if self.squeeze:
            while parts and parts[0][2].strip(b" ") == b"":
                parts.pop(0)
        out, source = bytearray(), []

        def put(piece: bytes, start: int) -> None:
            out.extend(piece)
            source.extend([start] * len(piece))

        if self.dummy_prefix and parts:
            put(mark, parts[0][0])
        end = parts[-1][1] if parts else 0
        blank = self.squeeze
        for a, _, piece in parts:
            for byte in range(len(piece)):
                one = piece[byte : byte + 1]
                if one == b" ":
                    if not (blank and self.squeeze):
                        put(mark, a)
                    blank = True
                else:
                    put(one, a)
                    blank = False
        if self.squeeze:
            while out.endswith(mark) and out:
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, end], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The empty map: only blanks change, so the alignment is two array operations."""
        raw = np.frombuffer(text, np.uint8)
        out = (b" " if self.dummy_prefix else b"") + text
        source = np.concatenate([np.zeros(int(self.dummy_prefix), np.int64), np.arange(len(raw) + 1)])
        if self.escape:
            wide = np.where(np.frombuffer(out, np.uint8) == 32, len(_BLANK), 1)
            source = np.concatenate([np.repeat(source[:-1], wide), source[-1:]])
            out = out.replace(b" ", _BLANK)
        return out, source


class Codec:
    """Encodes and decodes with a SentencePiece model given as bytes."""

    def __init__(self, model: bytes):
        fields = list(_fields(model))
        spec = next((v for f, v in fields if f == 3), b"")
        self.normalize = Normalizer(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        identity = _message([(1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0)])
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=_message_with(fields, identity))
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        pieces = [dict(_fields(v)) for f, v in fields if f == 1]
        names = [p.get(1, b"").decode() for p in pieces]
        self.shown = [str(i) for i in range(len(pieces))]
        self.sizes = np.array([1 if p.get(3, 1) == 6 else len(n.encode()) for n, p in zip(names, pieces, strict=True)], np.int64)

    def _sizes(self, text: str, ids: list[int]) -> np.ndarray:
        """Each id's length in normalised bytes; an unknown piece has that of its surface."""
        out = self.sizes[ids]
        if self.unknown in ids:
            for i, surface in enumerate(self.inner.encode(text, out_type=str)):
                if ids[i] == self.unknown:
                    out[i] = len(surface.encode())
        return out

    def encode(self, text: str | None, end: bool = False) -> tuple[list[int], np.ndarray]:
        """Ids and an (n, 2) array of byte spans in the original text; an end id has an empty span."""
        ids, _, spans = self.encode_digest(text, end)
        return ids, spans

    def encode_digest(self, text: str | None, end: bool = False) -> tuple[list[int], str, np.ndarray]:
        """Ids, their decimal text joined by blanks, and the spans."""
        raw = (text or "").encode()
        norm, source = self.normalize(raw)
        shown = norm.decode()
        ids = self.inner.encode(shown) if shown else []
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self._sizes(shown, ids), out=edge[1:])
        edge = source[edge]
        spans = np.stack([edge[:-1], edge[1:]], 1)
        if end:
            ids.append(self.end)
            spans = np.concatenate([spans, np.full((1, 2), len(raw), np.int64)])
        names = self.shown
        return ids, " ".join([names[i] for i in ids]), spans

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _message_with(fields: list[tuple[int, int | bytes]], normalizer: bytes) -> bytes:
    return _message([(f, normalizer if f == 3 else v) for f, v in fields if f != 5])


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec per worker and model."""
    return Codec(model)


def encode_documents(docs: DataFrame, model: bytes, id_column: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """(id, ids array<int>, starts array<long>, ends array<long>) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [codec(model).encode(t, end) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i for i, _ in made], pa.list_(pa.int32())), *(pa.array([s[:, k] for _, s in made], pa.list_(pa.int64())) for k in (0, 1))],
            names=[id_column, "ids", "starts", "ends"],
        )

    return map_arrow(docs.select(id_column, text), run, f"`{id_column}` {kind}, ids array<int>, starts array<bigint>, ends array<bigint>", text, 1 << 20)


def decode_ids(encoded: DataFrame, model: bytes, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of the ids that :func:`encode_documents` made."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codec(model).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[id_column, "text"])

    return arrow_map(encoded.select(id_column, "ids"), run, f"`{id_column}` {kind}, text string")


def token_digests(docs: DataFrame, model: bytes, end: bool = True, with_ids: bool = False) -> DataFrame:
    """Per document: token count, digests of the ids, of the decoded text and of the byte spans; the ids if asked for.

    Encodes and decodes in one pass over each text.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model)
        rows: list[list] = [[], [], [], [], []]
        for text in batch.column(1).to_pylist():
            ids, said, spans = own.encode_digest(text, end)
            parts = len(ids), said.encode(), own.decode(ids).encode(), spans.astype("<i8").tobytes(), np.array(ids, np.int32)
            for held, part in zip(rows, parts, strict=True):
                held.append(hashlib.sha256(part).hexdigest() if isinstance(part, bytes) else part)
        columns = [batch.column(0), pa.array(rows[0], pa.int64()), *(pa.array(rows[i], pa.string()) for i in (1, 2, 3))]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
        if with_ids:
            columns.append(pa.array(rows[4], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema, "text", 1 << 20)
