"""Workbooks and zips by member: binary twins, malformed records, other stores."""

import struct
import zipfile

import pytest

from kappaforge.sources import archives, readers

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.{0}"/><Relationship Id="r2" Target="/xl/worksheets/s2.{0}"/></Relationships>'
SHARED = ["Patient", "Zoë 漢", "x" * 200]
#: (row, col, kind, value) of two sheets
CELLS = [
    [(1, 1, "s", 0), (1, 28, "t", " Date "), (2, 1, "n", 7.0), (2, 28, "n", 45296.0), (3, 1, "s", 1), (3, 2, "n", 0.1), (4, 1, "b", 1), (4, 3, "e", "#N/A"), (900, 16384, "n", -12.5)],
    [(1, 1, "s", 2), (2, 1, "n", 123456.78), (2, 2, "n", 1e300), (2, 3, "n", -3.0)],
]


def want(book=CELLS):
    text = lambda k, v: SHARED[v] if k == "s" else archives.number_text(v) if k == "n" else str(v)
    return [(f"Sheet {n}", n, r, c, text(k, v)) for n, cells in enumerate(book) for r, c, k, v in cells]


def letters(col):
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def xlsx(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Sheet 0" r:id="r1"/><sheet name="Sheet 1" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", RELS.format("xml"))
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in SHARED) + "</sst>")
        for n, cells in enumerate(CELLS, 1):
            body = ""
            for r in sorted({c[0] for c in cells}):
                body += f'<row r="{r}">'
                for _, c, k, v in (x for x in cells if x[0] == r):
                    at = f'r="{letters(c)}{r}"'
                    body += {"s": f'<c {at} t="s"><v>{v}</v></c>', "t": f"<c {at} t=\"inlineStr\"><is><t>{v}</t></is></c>", "n": f"<c {at}><v>{archives.number_text(v) if k == 'n' else 0}</v></c>", "b": f'<c {at} t="b"><v>{v}</v></c>', "e": f'<c {at} t="e"><v>{v}</v></c>'}[k]
                body += f'<c r="B{r + 5000}"/></row>'
            z.writestr(f"xl/worksheets/s{n}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def record(kind, body=b""):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size, out = len(body), b""
    while True:
        out += bytes([size & 0x7F | (0x80 if size > 127 else 0)])
        size >>= 7
        if not size:
            return head + out + body


def wide(s):
    return struct.pack("<I", len(s.encode("utf-16-le")) // 2) + s.encode("utf-16-le")


def packed(v):
    """A number as its packed cell, or None where only a double holds it."""
    for word in (int(v) << 2 | 2 if v == int(v) and abs(v) < 1 << 29 else None, round(v * 100) << 2 | 3 if abs(v) < 1 << 22 and round(v * 100) / 100 == v else None):
        if word is not None and archives.rk(word & 0xFFFFFFFF) == v:
            return word & 0xFFFFFFFF
    return None


def sheet(cells):
    out, last = record(129) + record(145), None
    for r, c, k, v in cells:
        if r != last:
            out, last = out + record(0, struct.pack("<I", r - 1) + bytes(13)), r
        head = struct.pack("<II", c - 1, 0)
        if k == "n" and packed(v) is not None:
            out += record(archives.RK, head + struct.pack("<I", packed(v)))
        else:
            out += {"s": lambda: record(7, head + struct.pack("<I", v)), "t": lambda: record(6, head + wide(v)), "n": lambda: record(9 if c % 2 else 5, head + struct.pack("<d", v) + b"fm"[: 2 * (c % 2)]), "b": lambda: record(4, head + bytes([v])), "e": lambda: record(3, head + b"\x2a")}[k]()
        out += record(1, struct.pack("<II", c + 50, 0))  # a blank
    return out + record(146) + record(130)


def xlsb(path, sheets=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        named = b"".join(record(156, struct.pack("<II", 0, n + 1) + wide(f"r{n + 1}") + wide(f"Sheet {n}")) for n in range(2))
        z.writestr("xl/workbook.bin", record(131) + record(143) + named + record(144) + record(132))
        z.writestr("xl/_rels/workbook.bin.rels", RELS.format("bin"))
        z.writestr("xl/sharedStrings.bin", record(159, struct.pack("<II", 3, 3)) + b"".join(record(19, b"\0" + wide(s)) for s in SHARED) + record(160))
        for n, data in enumerate(sheets or map(sheet, CELLS), 1):
            z.writestr(f"xl/worksheets/s{n}.bin", data)


def rows(df):
    return [tuple(r) for r in df.orderBy("sheet_ord", "row", "col").collect()]


@pytest.mark.parametrize("make", [xlsx, xlsb])
def test_workbook_by_sheet(spark, tmp_path, make):
    path = str(tmp_path / f"book.{make.__name__}")
    make(path)
    cells = readers.workbook_cells(spark, path)
    assert cells.columns == ["sheet", "sheet_ord", "row", "col", "value"] and cells.rdd.getNumPartitions() == 2
    assert rows(cells) == want()
    # without a sort: tasks are sheets in order, and rows keep theirs
    assert [tuple(r) for r in cells.collect()] == want()
    assert rows(readers.workbook_cells(spark, path, sheet="Sheet 1")) == want()[len(CELLS[0]) :]
    assert rows(readers.workbook_cells(spark, path, sheet="none")) == []
    named = readers.sheet_rows(readers.workbook_cells(spark, path, sheet="Sheet 0"), ["Patient", "Date"]).orderBy("ord").collect()
    assert [(r.ord, r.Patient, r.Date) for r in named][:2] == [(2, "7", "45296"), (3, "Zoë 漢", None)]


def test_twins_and_other_stores(spark, tmp_path):
    xlsx(str(tmp_path / "a.xlsx"))
    xlsb(str(tmp_path / "b.xlsb"))
    both = readers.workbook_cells(spark, str(tmp_path))
    assert both.rdd.getNumPartitions() == 4 and sorted(map(tuple, both.collect())) == sorted(want() * 2)
    # a store of its own, which workers cannot open as files
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.books.link./in", f"file://{tmp_path}")
    for name in ("a.xlsx", "b.xlsb"):
        assert rows(readers.workbook_cells(spark, f"viewfs://books/in/{name}")) == want()


@pytest.mark.parametrize(
    ("damage", "left"),
    [
        (lambda s: s[:-25], 3),  # ends within a record
        (lambda s: record(9, struct.pack("<IId", 0, 0, 1.0)) + s, 0),  # a cell before any row
        (lambda s: s + record(0, struct.pack("<I", 5)) + record(5, struct.pack("<II", 0, 0)), 4),  # a number without one
        (lambda s: s + record(0, struct.pack("<I", 5)) + record(7, struct.pack("<III", 0, 0, 99)), 4),  # no such string
        (lambda s: s + record(6, struct.pack("<III", 9, 0, 1000) + b"ab"), 4),  # a string longer than its record
    ],
)
def test_malformed_records(spark, tmp_path, damage, left):
    path = str(tmp_path / "odd.xlsb")
    xlsb(path, [sheet(CELLS[0]), damage(sheet(CELLS[1]))])
    with pytest.raises(Exception, match="s2.bin"):
        readers.workbook_cells(spark, path).collect()
    got = rows(readers.workbook_cells(spark, path, mode="PERMISSIVE"))
    assert got[: len(CELLS[0])] == want()[: len(CELLS[0])] and len(got) == len(CELLS[0]) + left


def test_packed_numbers():
    assert [archives.rk(x) for x in (2, 6, 0xFFFFFFFE, 3 | 4 * 1234, 0x3FF00000, 0x3FF00001)] == [0, 1, -1, 12.34, 1.0, 0.01]


def test_zip_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("b.txt", "a.txt", "c.dat"):
            z.writestr(name, "".join(f"{name}\t{k}\x0bé\r\n" for k in range(20_000)))
        z.writestr("folder/", "")
    lines = archives.register(spark).read.format("kappaforge_zip_lines").option("pattern", r"\.txt$").load(str(tmp_path / "r.zip"))
    assert lines.rdd.getNumPartitions() == 2
    got = [(r.member, r.value) for r in lines.orderBy("ord").collect()]
    assert got == [(n, f"{n}\t{k}\x0bé") for n in ("a.txt", "b.txt") for k in range(20_000)]
    assert archives.register(spark).read.format("kappaforge_zip_lines").option("pattern", "none").load(str(tmp_path / "r.zip")).collect() == []
