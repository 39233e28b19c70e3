"""Zip archives and workbooks as data sources whose tasks are members.

A task opens the archive where it lies, reads its directory and streams one
member: no archive is in memory, and one with many sheets or files is read by as
many tasks. The archive must lie on a path that every worker sees; for other
stores ``readers`` has functions that Spark hands the bytes to.

Binary workbooks are sequences of records (type, size, body); only rows, cells,
shared strings and the list of sheets are looked at. A member that ends within a
record, or has a cell before any row, is malformed: the read fails and names
it, or with mode ``PERMISSIVE`` keeps what stands before.
"""

from __future__ import annotations

import glob
import io
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: rows of an Arrow batch
BATCH = 8192
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: record types of the binary format (fixed values)
ROW, RK, ERROR, BOOL, REAL, STRING, SHARED, F_STRING, F_NUMBER, F_BOOL, F_ERROR, SHARED_ITEM, SHEET = 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 19, 156
#: error cells (fixed values)
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Malformed(ValueError):
    """A member that is not what its format says."""


@dataclass
class Member(InputPartition):
    """One member of an archive: a task."""

    path: str
    name: str
    member: str
    ord: int

    def __post_init__(self) -> None:
        super().__init__(self.member)


def number_text(value: float) -> str:
    """A stored number as the text format writes it."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _whole(f: io.BufferedIOBase, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Malformed("ends within a record")
    return data


def records(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    """(type, body) of every record; types and sizes are numbers of seven bits a byte, low ones first."""
    while first := f.read(1):
        kind, size = first[0] & 0x7F, 0
        if first[0] & 0x80:
            kind |= (_whole(f, 1)[0] & 0x7F) << 7
        for k in range(4):
            byte = _whole(f, 1)[0]
            size |= (byte & 0x7F) << 7 * k
            if byte < 0x80:
                break
        yield kind, _whole(f, size)


def _string(body: bytes, at: int) -> tuple[str, int]:
    """The string at a place of a record, and where it ends; a length of 2**32 - 1 stands for none."""
    if at + 4 > len(body):
        raise Malformed("a string without its length")
    n = struct.unpack_from("<I", body, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    if at + 4 + 2 * n > len(body):
        raise Malformed("a string longer than its record")
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def rk(word: int) -> float:
    """The number of a packed cell: 30 bits of an integer or of a double, in hundredths if so marked."""
    value = (word - (1 << 32) if word & 1 << 31 else word) >> 2 if word & 2 else struct.unpack("<d", struct.pack("<Q", (word & 0xFFFFFFFC) << 32))[0]
    return value / 100 if word & 1 else value


def _value(kind: int, body: bytes, shared: list[str]) -> str | None:
    if kind in (STRING, F_STRING):
        return _string(body, 8)[0]
    if kind == SHARED:
        return shared[struct.unpack_from("<I", body, 8)[0]]
    if kind in (REAL, F_NUMBER):
        return number_text(struct.unpack_from("<d", body, 8)[0])
    if kind == RK:
        return number_text(rk(struct.unpack_from("<I", body, 8)[0]))
    if kind in (BOOL, F_BOOL):
        return str(body[8])
    return ERRORS.get(body[8], "#N/A") if kind in (ERROR, F_ERROR) else None


def binary_cells(f: io.BufferedIOBase, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, value) of the filled cells of a binary sheet, from 1."""
    row = None
    for kind, body in records(f):
        try:
            if kind == ROW:
                row = struct.unpack_from("<I", body)[0] + 1
            elif RK <= kind <= F_ERROR:
                if row is None:
                    raise Malformed("a cell before any row")
                if (value := _value(kind, body, shared)) is not None:
                    yield row, struct.unpack_from("<I", body)[0] + 1, value
        except (struct.error, IndexError) as e:
            raise Malformed("a cell shorter than its kind asks for") from e


def xml_cells(f: io.BufferedIOBase, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, value) of the filled cells of a sheet; what is read is let go of row by row."""
    try:
        for _, node in ElementTree.iterparse(f):
            if node.tag == _MAIN + "row":
                node.clear()
            if node.tag != _MAIN + "c":
                continue
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", node.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            kind, value = node.get("t"), node.find(_MAIN + "v")
            if kind == "inlineStr":
                yield int(row), col, "".join(t.text or "" for t in node.iter(_MAIN + "t"))
            elif value is not None:
                yield int(row), col, shared[int(value.text)] if kind == "s" else value.text
    except (ElementTree.ParseError, AttributeError, IndexError, TypeError) as e:
        raise Malformed(str(e)) from e


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, member) of the sheets of a workbook, in order."""
    binary = "xl/workbook.bin" in z.namelist()
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(f"xl/_rels/workbook.{'bin' if binary else 'xml'}.rels"))}
    if binary:
        with z.open("xl/workbook.bin") as f:
            named = []
            for kind, body in records(f):
                if kind == SHEET:
                    rel, at = _string(body, 8)
                    named.append((_string(body, at)[0], rel))
    else:
        named = [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
    for name, rel in named:
        yield name, rels[rel].lstrip("/") if rels[rel].startswith("/") else "xl/" + rels[rel]


def _shared(z: zipfile.ZipFile) -> list[str]:
    """The shared strings of a workbook."""
    names = z.namelist()
    if "xl/sharedStrings.bin" in names:
        with z.open("xl/sharedStrings.bin") as f:
            return [_string(body, 1)[0] for kind, body in records(f) if kind == SHARED_ITEM]
    if "xl/sharedStrings.xml" not in names:
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == _MAIN + "si":
                out.append("".join(t.text or "" for t in node.iter(_MAIN + "t")))
                node.clear()
    return out


class _Members(DataSource):
    """What both sources share: files of the option path (a file, a folder or a pattern) and their members."""

    columns: tuple[tuple[str, pa.DataType], ...] = ()

    def files(self) -> list[str]:
        path = re.sub(r"^file:/*", "/", self.options["path"])
        return sorted(p for p in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if os.path.isfile(p))

    def members(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
        raise NotImplementedError

    def rows(self, z: zipfile.ZipFile, member: Member) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: _Members):
        self.source = source

    def partitions(self) -> list[Member]:
        out: list[Member] = []
        for path in self.source.files():
            with zipfile.ZipFile(path) as z:
                out += [Member(path, name, member, k) for k, (name, member) in enumerate(self.source.members(path, z))]
        return out or [Member("", "", "", 0)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*self.source.columns)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        if not partition.path:
            return
        rows: list[tuple] = []
        with zipfile.ZipFile(partition.path) as z:
            try:
                for row in self.source.rows(z, partition):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
            except (Malformed, zipfile.BadZipFile) as e:
                if self.source.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                    raise Malformed(f"{partition.path}, {partition.member}: {e}") from e
        if rows:
            yield batch(rows)


class WorkbookSource(_Members):
    """(path, sheet, sheet_ord, row, col, value) of .xlsx and .xlsb workbooks; option sheet names the only one wanted."""

    columns = (("path", pa.string()), ("sheet", pa.string()), ("sheet_ord", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()))

    @classmethod
    def name(cls) -> str:
        return "kappaforge_workbook"

    def schema(self) -> str:
        return "path string, sheet string, sheet_ord int, row int, col int, value string"

    def members(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
        return _sheets(z)

    def rows(self, z: zipfile.ZipFile, member: Member) -> Iterator[tuple]:
        if self.options.get("sheet", member.name) != member.name:
            return
        read = binary_cells if member.member.endswith(".bin") else xml_cells
        with z.open(member.member) as f:
            for row, col, value in read(f, _shared(z)):
                yield member.path, member.name, member.ord, row, col, value


class ZipLines(_Members):
    """(path, member, ord, value) of the lines of text members; option pattern is a regular expression for their names."""

    columns = (("path", pa.string()), ("member", pa.string()), ("ord", pa.int64()), ("value", pa.string()))

    @classmethod
    def name(cls) -> str:
        return "kappaforge_zip_lines"

    def schema(self) -> str:
        return "path string, member string, ord long, value string"

    def members(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
        return ((n, n) for n in sorted(z.namelist()) if not n.endswith("/") and re.search(self.options.get("pattern", ""), n))

    def rows(self, z: zipfile.ZipFile, member: Member) -> Iterator[tuple]:
        with z.open(member.member) as f:
            for k, line in enumerate(io.TextIOWrapper(f, "utf-8", newline="\n")):
                yield member.path, member.member, member.ord << 40 | k, line.rstrip("\r\n")


def register(spark: SparkSession) -> SparkSession:
    """The session with both sources known to it."""
    for source in (WorkbookSource, ZipLines):
        spark.dataSource.register(source)
    return spark
