"""Workbooks as a data source: many at once, a partition for each sheet, refused archives."""

import struct
import zipfile

import pytest
from pyspark.errors import PySparkException

from tallyweir.sources import excel

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=False, extra=b""):
    """Write a workbook of {sheet: rows}; texts inline or in the shared table."""
    texts = []

    def cell(at, x):
        if isinstance(x, bool):
            return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
        if not isinstance(x, str):
            return f'<c r="{at}"><v>{x}</v></c>'
        if shared:
            texts.append(x)
            return f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        names = list(sheets)
        out.writestr("xl/workbook.xml", f"<workbook {SPACE}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            body = "".join(f'<row r="{k + 1}">' + "".join(cell(f"{'ABCDE'[j]}{k + 1}", x) for j, x in enumerate(r) if x is not None) + "</row>" for k, r in enumerate(sheets[n]))
            out.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {SPACE}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            out.writestr("xl/sharedStrings.xml", f"<sst {SPACE}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        if extra:
            out.writestr("xl/media/big.bin", extra)


def table(n, name="Item"):
    return [["Report"], [], [name, "Sold", "Done"], *[[f"p{i}", i * 1.5, bool(i % 2)] for i in range(n)], ["Total", 99, None]]


def test_many_books_in_one_read(spark, tmp_path):
    paths = []
    for k in range(5):
        book(tmp_path / f"b{k}.xlsx", {"Cover": [["Hello"]], "Data": table(20 + k), "Empty": []}, shared=k % 2 == 0)
        paths.append(f"file://{tmp_path}/b{k}.xlsx")
    rows = excel.sheet_rows(spark, paths)
    assert rows.rdd.getNumPartitions() == 15
    got = {(r["path"], r["sheet"]): r["count"] for r in rows.groupBy("path", "sheet").count().collect()}
    assert got == {(p, s): n for k, p in enumerate(paths) for s, n in (("Cover", 1), ("Data", 24 + k))}
    one = rows.where(f"path = '{paths[2]}' and row_id = 4 and sheet = 'Data'").first()
    assert one["cells"] == ["p1", "1.5", "true"] and one["words"] == [True, False, False] and one["place"] == 1


@pytest.mark.parametrize("shared", [True, False])
def test_best_sheet(spark, tmp_path, shared):
    book(tmp_path / "a.xlsx", {"Notes": [["a", "b"]], "Data": table(12)}, shared)
    df, notes = excel.read_workbook(spark, f"file://{tmp_path}/a.xlsx")
    assert df.columns == ["row_id", "item", "sold", "done"] and df.count() == 12 and notes == {"sheet": "Data", "sheets": 2}
    assert not df.storageLevel.useMemory
    book(tmp_path / "empty.xlsx", {"Data": []})
    with pytest.raises(ValueError):
        excel.read_workbook(spark, f"file://{tmp_path}/empty.xlsx")


def test_rows_are_streamed(spark, tmp_path):
    book(tmp_path / "long.xlsx", {"Data": [["n", "text"], *[[i, f"line {i}"] for i in range(25_000)]]})
    assert excel.sheet_rows(spark, f"file://{tmp_path}/long.xlsx").count() == 25_001
    with excel.opened(str(tmp_path / "long.xlsx")) as found:
        first = next(excel.sheet_cells(found, found.sheets()[0][1]))
    assert first == (0, ["n", "text"], [True, True])


def test_archives_that_unpack_to_too_much(spark, tmp_path):
    bomb = tmp_path / "bomb.xlsx"
    book(bomb, {"Data": table(3)}, extra=b"\0" * 50_000_000)
    with pytest.raises((ValueError, PySparkException), match="too many bytes"):
        excel.sheet_rows(spark, f"file://{bomb}").count()
    with pytest.raises((ValueError, PySparkException), match="too many bytes"):
        excel.sheet_rows(spark, f"file://{bomb}", most_ratio=10**9, most_bytes=1_000_000).count()
    assert excel.sheet_rows(spark, f"file://{bomb}", most_ratio=10**9).count() == 7


def test_a_directory_that_lies(spark, tmp_path):
    # the sizes in the directory say 1 byte; what comes out is counted all the same
    path = tmp_path / "lie.xlsx"
    book(path, {"Data": [["x"], *[["y" * 200] for _ in range(40_000)]]})
    raw = bytearray(path.read_bytes())
    at = raw.find(b"PK\x01\x02")
    while at >= 0:
        name = raw[at + 46 : at + 46 + struct.unpack_from("<H", raw, at + 28)[0]]
        if name == b"xl/worksheets/s0.xml":
            struct.pack_into("<I", raw, at + 24, 1)
        at = raw.find(b"PK\x01\x02", at + 4)
    path.write_bytes(raw)
    with pytest.raises((ValueError, PySparkException, zipfile.BadZipFile)):
        excel.sheet_rows(spark, f"file://{path}", most_ratio=10**9, most_bytes=100_000).count()
