"""Workbooks: a data source that reads XLSX sheets, and sheets written from tables.

An XLSX file is a ZIP of XML parts. Reading takes the book's list of sheets, its shared strings and its number formats, and then streams one
sheet's rows; a cell is text: whole numbers as digits, dates in ISO form, formulas by their last value. ``register`` makes
``spark.read.format("xlsx")`` known: a partition for each file and sheet, columns from the first filled row. Files in stores that only Spark
reads come through ``binaryFile`` and ``read_books``. Writing puts out books of at most ``MOST_ROWS`` rows, each by one task, whole or not at all.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ranked import ranked
from ..operators.stored import Scratch, publish

MOST_ROWS, CHUNK = 50_000, 4096
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_MAIN = "{" + _NS["m"] + "}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)|\r")


def _column(address: str) -> int:
    """The column of a cell's address, from 0."""
    n = 0
    for c in address:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def column_letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _shows_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code.lower())
    return bare != "general" and bool(re.search("[ymdhs]", bare))


def _text(node) -> str:
    """The text of a string item without what is only its reading aid."""
    parts = [t.text or "" for child in node for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class Book:
    """An open workbook; raises ``zipfile.BadZipFile``, ``KeyError`` or ``ElementTree.ParseError`` where it isn't one."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(_REL)]) for s in book.findall("m:sheets/m:sheet", _NS)}
        view = book.find("m:bookViews/m:workbookView", _NS)
        self.active = list(self.sheets)[min(int(view.get("activeTab", 0)) if view is not None else 0, len(self.sheets) - 1)]
        properties = book.find("m:workbookPr", _NS)
        old_mac = properties is not None and properties.get("date1904", "0") in ("1", "true")
        self.day_zero = datetime(1904, 1, 1) if old_mac else datetime(1899, 12, 30)
        self.shifted = not old_mac
        held = set(self.zip.namelist())
        self.strings = [_text(x) for x in self._xml("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in held else []
        self.dated = self._styles() if "xl/styles.xml" in held else []

    def _xml(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def _styles(self) -> list[bool]:
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): _shows_date(f.get("formatCode", "")) for f in styles.findall("m:numFmts/m:numFmt", _NS)}
        numbers = [int(x.get("numFmtId", 0)) for x in styles.findall("m:cellXfs/m:xf", _NS)]
        return [own.get(n, n in _DATE_FORMATS) for n in numbers]

    def _date(self, serial: float) -> str:
        if 0 <= serial < 1:
            return (datetime.min + timedelta(seconds=round(serial * 86400))).time().isoformat()
        at = self.day_zero + timedelta(days=serial + (self.shifted and serial < 60))  # 1900 has a day too many
        at = (at + timedelta(microseconds=500_000)).replace(microsecond=0)
        return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat(" ")

    def _value(self, cell) -> str | None:
        kind, v = cell.get("t", "n"), cell.find("m:v", _NS)
        if kind == "inlineStr":
            inner = cell.find("m:is", _NS)
            return _text(inner) if inner is not None else None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return str(v.text.strip() == "1")
        if kind != "n":
            return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), v.text)
        number, style = float(v.text), int(cell.get("s", 0))
        if style < len(self.dated) and self.dated[style]:
            return self._date(number)
        return str(int(v.text)) if re.fullmatch(r"\s*-?\d+\s*", v.text) else str(int(number)) if number.is_integer() else repr(number)

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of the rows with a filled cell, read as they come."""
        number = 0
        with self.zip.open(self.sheets[sheet or self.active]) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != f"{_MAIN}row":
                    continue
                number = int(node.get("r", number + 1))
                cells: list[str | None] = []
                for cell in node.findall("m:c", _NS):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(self._value(cell))
                node.clear()
                if any(x is not None and x.strip() for x in cells):
                    yield number, cells

    def table(self, sheet: str | None = None) -> tuple[list[str], Iterator[tuple[int, list[str | None]]]]:
        """Headers and rows; blank headers are numbered, repeated ones counted."""
        rows = self.rows(sheet)
        _, head = next(rows, (0, []))
        headers: list[str] = []
        for k, x in enumerate(head, 1):
            name = base = (x or "").strip() or f"Колонка {k}"
            again = 1
            while name in headers:
                again += 1
                name = f"{base} {again}"
            headers.append(name)
        return headers, rows


def _opened(path: str) -> bytes:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


def _files(path: str) -> list[str]:
    """A file, or the workbooks of a folder and its subfolders in order."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + f.path for f in found if f.is_file and f.path.lower().endswith(".xlsx") and not f.base_name.startswith((".", "~")))


class Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__(f"{path}#{sheet}")
        self.path, self.sheet = path, sheet


class Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, names: list[str]):
        self.path, self.sheet, self.names = path, sheet, names

    def partitions(self) -> list[Sheet]:
        found = []
        for path in _files(self.path):
            book = Book(_opened(path))
            wanted = list(book.sheets) if self.sheet == "*" else [self.sheet] if self.sheet else [book.active]
            found += [Sheet(path, s) for s in wanted if s in book.sheets]
        return found

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        headers, rows = Book(_opened(partition.path)).table(partition.sheet)
        at = [headers.index(n) if n in headers else -1 for n in self.names]
        schema = pa.schema([(n, pa.string()) for n in self.names])
        held: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = [[r[k] if 0 <= k < len(r) else None for r in held] for k in at]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

        for _, cells in rows:
            held.append(cells)
            if len(held) == CHUNK:
                yield batch()
                held = []
        if held:
            yield batch()


class Xlsx(DataSource):
    """Options: ``path`` (a book or a folder of books) and ``sheet`` (a name, ``*`` for all; the active one unless given)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        for path in _files(self.options["path"]):
            book, sheet = Book(_opened(path)), self.options.get("sheet", "")
            headers, _ = book.table(None if sheet in ("", "*") else sheet)
            if headers:
                return StructType([StructField(h, StringType()) for h in headers])
        raise ValueError("the table has no rows")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("sheet", ""), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)


def read_books(files: DataFrame) -> DataFrame:
    """``source, sheet, number, cells, error`` of the filled rows of all sheets of ``files(path, content)``; an unreadable book is a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("sheet", pa.string()), ("number", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        for batch in batches:
            for path, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                held = []
                try:
                    book = Book(data)
                    for sheet in book.sheets:
                        for number, cells in book.rows(sheet):
                            held.append((path, sheet, number, cells, None))
                            if len(held) == CHUNK:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                                held = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                    held.append((path, None, None, None, f"unreadable: {e}"))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "source string, sheet string, number long, cells array<string>, error string")


_BOLD, _WRAP, _DAY, _TITLE = 1, 2, 3, 4
_STYLES = (
    '<styleSheet xmlns="{ns}"><numFmts count="1"><numFmt numFmtId="164" formatCode="DD.MM.YYYY"/></numFmts>'
    '<fonts count="3"><font><sz val="11"/></font><font><b/><sz val="11"/></font><font><b/><sz val="14"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    "<borders count=\"1\"><border/></borders><cellStyleXfs count=\"1\"><xf/></cellStyleXfs>"
    '<cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>{top}0" applyAlignment="1">{wrap}</xf>{top}164" applyNumberFormat="1" applyAlignment="1">{wrap}</xf><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>'
).format(ns=_NS["m"], top='<xf numFmtId="', wrap='<alignment wrapText="1" vertical="top"/>')


def _written(value: str) -> str:
    return escape(_UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))


def _cell_xml(at: str, value, style: int) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b" s="{style}"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        value = value.date()
    if isinstance(value, date):
        return f'<c r="{at}" s="{_DAY}"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'
    # a string is never read as a formula, whatever it begins with
    return f'<c r="{at}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{_written(str(value))}</t></is></c>'


def book_bytes(columns: dict[str, int], rows: list[list], title: str = "Sheet1", head: tuple[str, ...] = ()) -> bytes:
    """A book of one sheet: lines of ``head``, a bold row of column names with their widths, then the rows; names stay in view and can be filtered."""
    at = len(head) + (1 if head else 0) + 1
    lines = [f'<row r="{k}">{_cell_xml(f"A{k}", x, _TITLE if k == 1 else 0)}</row>' for k, x in enumerate(head, 1)]
    for k, (row, style) in enumerate([(list(columns), _BOLD), *((r, _WRAP) for r in rows)], at):
        lines.append(f'<row r="{k}">' + "".join(_cell_xml(f"{column_letters(j)}{k}", x, style) for j, x in enumerate(row)) + "</row>")
    widths = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(columns.values(), 1))
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{at}" topLeftCell="A{at + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    area = f'<autoFilter ref="A{at}:{column_letters(len(columns) - 1)}{at + len(rows)}"/>'
    ns, rel, office = _NS["m"], "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{office}"><sheets><sheet name="{_written(title[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}">{pane}<cols>{widths}</cols><sheetData>{"".join(lines)}</sheetData>{area}</worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():  # a fixed time: equal tables give equal files
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{body}', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_books(df: DataFrame, folder: str, by: str, order: list, columns: dict[str, int], title: str = "Sheet1", head=lambda key: (), most: int = MOST_ROWS) -> DataFrame:
    """A book for each value of ``by`` (several of up to ``most`` rows for a large one), rows in order, with the columns and widths given.

    Returns ``key, part, path, n_rows, n_bytes`` of each book. ``head(key)`` gives the lines above the table."""
    rows = ranked(df.select(F.col(by).cast("string").alias("_key"), *(F.col(c) for c in dict.fromkeys([*df.columns]))), Scratch(df.sparkSession, "books"), "rows", ["_key"], order, "_place")
    rows = rows.select("_key", ((F.col("_place") - 1) / most).cast("long").alias("_part"), "_place", *columns)

    def put(key: tuple, table: pa.Table) -> pa.Table:
        name, part = (x.as_py() for x in key)
        body = table.sort_by("_place").select(list(columns))
        data = book_bytes(columns, [list(r.values()) for r in body.to_pylist()], title, tuple(head(name)))
        file = "null" if name is None else "key" + re.sub("[^0-9A-Za-z]", lambda m: f"_{ord(m[0]):X}_", name)
        path = f"{folder}/{file}-{part:05d}.xlsx"
        return pa.table({"key": pa.array([name], pa.string()), "part": [part], "path": [path], "n_rows": [len(body)], "n_bytes": [publish(path, data)]})

    return rows.groupBy("_key", "_part").applyInArrow(put, "key string, part long, path string, n_rows long, n_bytes long")
