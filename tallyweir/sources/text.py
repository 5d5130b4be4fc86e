"""Delimited text: encoding over all bytes, format and delimiter sniffing on the head, then a Spark CSV scan."""

from __future__ import annotations

import csv
import io
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 64 * 1024
#: Characters of Windows-1252 by the Latin-1 character of the same byte, where they differ.
WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def read_head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file by Spark's file systems, so that any store works."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def encoding_of(spark: SparkSession, path: str, head: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, Windows-1252 or Latin-1, whichever decodes the whole file.

    One pass over the file's lines as bytes; a line end is never part of a longer UTF-8 character.
    """
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    undefined = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(r"[\x81\x8D\x8F\x90\x9D]")
    found = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(undefined).alias("undefined")).first()
    if found["utf8"] is not False:
        return "UTF-8"
    return "ISO-8859-1" if found["undefined"] else "windows-1252"


def delimiter_of(text: str) -> str:
    lines = [x for x in text.splitlines() if x.strip()][:20]
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",;\t|").delimiter
    except csv.Error:
        found = max(",;\t|", key=lines[0].count)
        return found if lines[0].count(found) else ","


def check_table(head: bytes, text: str) -> None:
    """Raises ValueError for PDFs, web pages, binary files and files without a line."""
    start = text[:4000]
    if re.match(r"\s*<(!doctype\s+html|html|head|body|\?xml)\b", start, re.I):
        raise ValueError("this is a web page, not a table")
    odd = sum(ord(c) < 32 and c not in "\t\r\n\f" for c in start)
    if head.startswith(b"%PDF") or odd > 0.02 * max(1, len(start)):
        raise ValueError("this is not a table")
    if not any(line.strip() for line in text.splitlines()):
        raise ValueError("the file is empty")


def slugs(names: list[str]) -> list[str]:
    """Column names in lower case with letters, digits, marks and single underscores; repeated ones numbered."""
    out: list[str] = []
    for i, name in enumerate(names):
        text = unicodedata.normalize("NFC", name or "")
        kept = "".join(c if c.isalnum() or unicodedata.category(c).startswith("M") else "_" for c in text).lower()
        base = "_".join(x for x in kept.split("_") if x) or f"col_{i}"
        slug, n = base, 0
        while slug in out:
            n += 1
            slug = f"{base}_{n}"
        out.append(slug)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, under clean names; short rows are padded, all-null rows and columns dropped."""
    head = read_head(spark, path)
    encoding = encoding_of(spark, path, head)
    text = head.decode({"windows-1252": "cp1252", "ISO-8859-1": "latin-1"}.get(encoding, encoding), "ignore").lstrip("﻿")
    check_table(head, text)
    sep = delimiter_of(text)
    header = next(row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row)
    if len(text.splitlines()) < 2:
        raise ValueError("the file has a header only")
    # Spark's reader does not take Windows-1252: read as Latin-1, byte for byte, and translated
    windows = encoding == "windows-1252"
    df = spark.read.csv(path, sep=sep, encoding="ISO-8859-1" if windows else encoding, header=True, multiLine=True, escape='"', enforceSchema=True)
    df = df.toDF(*slugs(header)[: len(df.columns)]).na.drop(how="all")
    if windows:
        df = df.select(*[F.translate(f"`{c}`", "".join(WINDOWS), "".join(WINDOWS.values())).alias(c) for c in df.columns])
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]])
