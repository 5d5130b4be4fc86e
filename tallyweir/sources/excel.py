"""Excel workbooks (.xlsx) as a Spark data source: many books in one read, one partition for each sheet, and header search.

A task reads the parts of one sheet through a seekable file, row by row, and
hands on batches; it never holds a whole book. What is held is the book's table
of shared texts, which the format keeps in one piece. Archives that unpack to
far more than a table needs are refused by their directory, and again while
they are unpacked, because a directory can lie. Old .xls files are refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyweir.functions.inference import TOTAL_TEXT
from tallyweir.sources.text import read_head, slugs

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def is_workbook(head: bytes) -> bool:
    """By the first bytes, whatever the file's name says; raises ValueError for the old binary format."""
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError("save the workbook as .xlsx or CSV; .xls is not read")
    return head.startswith(b"PK\x03\x04")


#: Bytes that a workbook may unpack to, and how many times its own size.
MOST_BYTES, MOST_RATIO = 2 << 30, 200
#: Rows of a batch.
BATCH = 10_000


class _Counted(io.RawIOBase):
    """A stream that refuses to give more than ``most`` bytes."""

    def __init__(self, inner: IO[bytes], most: int):
        self.inner, self.left = inner, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        got = self.inner.read(len(buffer))
        self.left -= len(got)
        if self.left < 0:
            raise ValueError("the workbook unpacks to too many bytes")
        buffer[: len(got)] = got
        return len(got)


@dataclass
class Book:
    """An open workbook; ``limit`` is what any of its parts may unpack to."""

    archive: zipfile.ZipFile
    limit: int

    def part(self, name: str) -> IO[bytes]:
        return io.BufferedReader(_Counted(self.archive.open(name), self.limit), 1 << 16)

    def sheets(self) -> list[tuple[str, str]]:
        """(name, part) of every sheet, in order."""
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.parse(self.part("xl/_rels/workbook.xml.rels")).getroot()}
        found = [(x.get("name"), targets[x.get(_LINK)]) for x in ElementTree.parse(self.part("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet")]
        return [(name, at.lstrip("/") if at.startswith("/") else f"xl/{at}") for name, at in found]

    def shared(self) -> list[str]:
        """The texts that cells refer to by number."""
        out: list[str] = []
        if "xl/sharedStrings.xml" in self.archive.namelist():
            for _, node in ElementTree.iterparse(self.part("xl/sharedStrings.xml")):
                if node.tag == f"{_MAIN}si":
                    out.append(_text(node))
                    node.clear()
        return out


@contextmanager
def opened(path: str, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> Iterator[Book]:
    """The workbook at a local path or a URI that pyarrow knows; ValueError for archives that would unpack to too much."""
    system, at = pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (pa.fs.LocalFileSystem(), path)
    size = system.get_file_info(at).size or 0
    with system.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
        limit = min(most_bytes, most_ratio * max(1, size))
        if sum(x.file_size for x in archive.infolist()) > limit:
            raise ValueError("the workbook unpacks to too many bytes")
        yield Book(archive, limit)


def _number_of_column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_cells(book: Book, part: str) -> Iterator[tuple[int, list[str | None], list[bool]]]:
    """(row number, cell texts, which cells hold text) of a sheet, in order, one row in memory at a time."""
    shared = book.shared()
    count, data = 0, None
    for event, node in ElementTree.iterparse(book.part(part), ("start", "end")):
        if event == "start":
            data = node if node.tag == f"{_MAIN}sheetData" else data
            continue
        if node.tag != f"{_MAIN}row":
            continue
        row: list[str | None] = []
        words: list[bool] = []
        for c in node.iter(f"{_MAIN}c"):
            at = _number_of_column(c.get("r")) if c.get("r") else len(row)
            row += [None] * (at + 1 - len(row))
            words += [False] * (at + 1 - len(words))
            value, kind = c.find(f"{_MAIN}v"), c.get("t")
            if kind == "inlineStr":
                row[at], words[at] = _text(c), True
            elif value is not None and value.text is not None:
                row[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text) if kind == "b" else value.text
                words[at] = kind in ("s", "str")
            if row[at] is not None and not row[at].strip():
                row[at], words[at] = None, False
        yield count, row, words
        count += 1
        # rows already read would else stay in the tree
        (data if data is not None else node).clear()


@dataclass
class Sheet(InputPartition):
    """One partition of a read."""

    path: str
    sheet: str
    place: int
    part: str


_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("place", pa.int32()), ("row_id", pa.int64()), ("cells", pa.list_(pa.string())), ("words", pa.list_(pa.bool_()))])


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.limits = int(options.get("most_bytes", MOST_BYTES)), int(options.get("most_ratio", MOST_RATIO))

    def partitions(self) -> list[Sheet]:
        """The sheets of all books, from their directories alone."""
        out = []
        for path in self.paths:
            with opened(path, *self.limits) as book:
                out += [Sheet(path, name, i, part) for i, (name, part) in enumerate(book.sheets())]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        def batch(held: list) -> pa.RecordBatch:
            numbers, rows, words = ([h[i] for h in held] for i in range(3))
            same = [partition.path, partition.sheet, partition.place]
            return pa.RecordBatch.from_arrays([*[pa.array([x] * len(held), t) for x, t in zip(same, _SCHEMA.types[:3], strict=True)], *[pa.array(x, t) for x, t in zip((numbers, rows, words), _SCHEMA.types[3:], strict=True)]], schema=_SCHEMA)

        with opened(partition.path, *self.limits) as book:
            held = []
            for row in sheet_cells(book, partition.part):
                held.append(row)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            yield batch(held)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")``: rows of all sheets of the books in option ``paths``, a path on each line."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, place int, row_id bigint, cells array<string>, words array<boolean>"

    def reader(self, schema: object) -> DataSourceReader:
        return WorkbookReader(self.options)


def sheet_rows(spark: SparkSession, paths: str | list[str], most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> DataFrame:
    """(path, sheet, place, row_id, cells, words) of one or many workbooks, a partition for each sheet; ``place`` counts a book's sheets from 0."""
    spark.dataSource.register(WorkbookSource)
    books = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("workbook").options(paths="\n".join(books), most_bytes=str(most_bytes), most_ratio=str(most_ratio)).load()


def header_row(rows: list[tuple[list, list]], columns: int) -> int:
    """The first of at most 30 rows that is filled in 60 % of the columns, two at least, and 80 % text; else the first row."""
    for i, (values, words) in enumerate(rows[:30]):
        filled = sum(v is not None for v in values)
        if filled >= max(2, 0.6 * columns) and sum(words) >= 0.8 * filled:
            return i
    return 0


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table, notes): the sheet with the most filled cells, all columns as text, and row_id.

    Leading titles are skipped, and up to three closing lines that say "total" go.
    Notes hold the sheet's name and the number of sheets.
    """
    if not is_workbook(read_head(spark, path, 8)):
        raise ValueError("this is not a workbook")
    rows = sheet_rows(spark, path)
    held = rows.persist()
    try:
        return _best_sheet(held, rows)
    finally:
        held.unpersist()


def _best_sheet(held: DataFrame, rows: DataFrame) -> tuple[DataFrame, dict]:
    """As :func:`read_workbook`; looks at ``held``, and the table reads ``rows``."""
    filled = F.size(F.filter("cells", lambda x: x.isNotNull()))
    places = held.select("place", "sheet", F.posexplode("cells").alias("i", "cell")).where("cell is not null").groupBy("place", "sheet", "i").count().collect()
    if not places:
        raise ValueError("the workbook is empty")
    sizes: dict[tuple[int, str], int] = {}
    for r in places:
        sizes[r["place"], r["sheet"]] = sizes.get((r["place"], r["sheet"]), 0) + r["count"]
    place, sheet = min(sizes, key=lambda k: (-sizes[k], k[1], k[0]))
    keep = sorted(r["i"] for r in places if r["place"] == place)
    count = held.select("place").distinct().count()
    chosen = (F.col("place") == place) & (filled > 0)
    own = held.where(chosen)
    head = own.orderBy("row_id").limit(31).collect()
    pick = lambda values, default: [values[i] if i < len(values) else default for i in keep]
    at = header_row([(pick(r["cells"], None), pick(r["words"], False)) for r in head[: max(1, len(head) - 1)]], len(keep))
    names = slugs([v.strip() if v else f"unnamed_{j}" for j, v in enumerate(pick(head[at]["cells"], None))])
    later = F.col("row_id") > head[at]["row_id"]
    tail = own.where(later).orderBy(F.desc("row_id")).limit(3).collect()
    end = None
    for r in tail:
        if not any(v is not None and w and re.match(TOTAL_TEXT, v) for v, w in zip(r["cells"], r["words"], strict=True)):
            break
        end = r["row_id"]
    body = rows.where(chosen & later & (F.col("row_id") < end if end is not None else F.lit(True)))
    table = body.select("row_id", *[F.get("cells", F.lit(i)).alias(name) for i, name in zip(keep, names, strict=True)])
    return table, {"sheet": sheet, "sheets": count}
