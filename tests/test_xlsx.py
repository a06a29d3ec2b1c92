"""Workbooks read and written: cells of all kinds, several sheets and files, broken ones."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rosterlake.sources import xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets, strings=(), styles="", extra=""):
    """A book as other programs write it: shared strings, styles, sheets by relation."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}>{extra}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        targets = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for k, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


STYLES = '<numFmts count="3"><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[$-419]General"/></numFmts>' + (
    '<cellXfs count="6"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/><xf numFmtId="166"/></cellXfs>'
)


def test_cells_of_all_kinds():
    strings = ("<t>Имя</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t>line_x000A_two</t>")
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row>'
        '<row r="3"/><row r="4"><c r="A4" t="inlineStr"><is><t> </t></is></c></row>'
        '<row r="5"><c r="A5"><v>79121234567</v></c><c r="B5"><v>1.5</v></c><c r="C5"><v>3.0</v></c><c r="AB5" t="b"><v>1</v></c></row>'
        '<row><c t="s"><v>1</v></c><c t="s"><v>2</v></c><c t="str"><f>A1</f><v>=x</v></c><c t="e"><v>#N/A</v></c><c s="0"/></row>'
        '<row r="9"><c r="A9" s="1"><v>45292</v></c><c r="B9" s="2"><v>45292.0</v></c><c r="C9" s="3"><v>45292</v></c><c r="D9" s="4"><v>45292.75</v></c><c r="E9" s="1"><v>0.5</v></c><c r="F9" s="1"><v>59</v></c><c r="G9" s="5"><v>7</v></c></row>'
    )
    held = xlsx.Book(book({"one": rows}, strings, STYLES))
    found = dict(held.rows())
    assert list(found) == [2, 5, 6, 9]
    assert found[2] == ["Имя", None, "in"]
    assert found[5][:3] == ["79121234567", "1.5", "3"] and found[5][27] == "True" and len(found[5]) == 28
    assert found[6] == ["rich text", "line\ntwo", "=x", "#N/A", None]
    assert found[9] == ["2024-01-01", "2024-01-01", "45292", "2024-01-01 18:00:00", "12:00:00", "1900-02-28", "7"]
    headers, rest = held.table()
    assert headers == ["Имя", "Колонка 2", "in"] and len(list(rest)) == 3
    old = xlsx.Book(book({"one": '<row><c s="1"><v>0</v></c><c s="1"><v>100</v></c></row>'}, (), STYLES, '<workbookPr date1904="1"/>'))
    assert next(old.rows())[1] == ["00:00:00", "1904-04-10"]


def test_active_sheet_and_repeated_headers(spark, tmp_path):
    row = lambda *cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"
    sheets = {"first": row("a", "a", "") + row("1", "2", "3"), "second": row("b") + row("4"), "empty": ""}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.xlsx").write_bytes(book(sheets, extra='<bookViews><workbookView activeTab="1"/></bookViews>'))
    (tmp_path / "in" / "y.XLSX").write_bytes(book({"z": row("b", "c") + row("5", "6")}))
    (tmp_path / "in" / "~lock.xlsx").write_bytes(b"no book")
    xlsx.register(spark)
    read = lambda **o: sorted(map(tuple, spark.read.format("xlsx").options(**o).load(str(tmp_path / "in")).collect()), key=str)
    assert read() == [("4",), ("5",)]
    one = spark.read.format("xlsx").option("sheet", "first").load(str(tmp_path / "in" / "x.xlsx"))
    assert one.columns == ["a", "a 2", "Колонка 3"] and one.collect() == [("1", "2", "3")]
    assert len(read(sheet="*")) == 3
    with pytest.raises(Exception, match="no rows"):
        spark.read.format("xlsx").option("sheet", "empty").load(str(tmp_path / "in" / "x.xlsx"))


def test_books_come_back(spark, tmp_path):
    text = ["=1+1", "-5", "@x", "<&>\"'", "a\nb\rc", " edge ", "\x01\x1f", "_x0041_", "", None, "ё漢😀"]
    rows = [(k, t, k / 4, k % 2 == 0, datetime.date(2024, 2, 28 + k % 2) if k % 3 else None, [None, "", "д/к"][k % 3]) for k, t in enumerate(text)]
    df = spark.createDataFrame(rows, "id long, t string, x double, b boolean, d date, g string").repartition(3)
    written = xlsx.write_books(df, f"file://{tmp_path}/out", "g", [F.col("id")], {"id": 5, "t": 20, "x": 8, "b": 5, "d": 10}, "Лист", lambda key: (f"of {key}", "two"), most=3)
    told = written.collect()
    assert sum(r.n_rows for r in told) == len(rows) and max(r.n_rows for r in told) <= 3 and len({r.path for r in told}) == len(told) == 5
    cells = xlsx.read_books(spark.read.format("binaryFile").load(f"{tmp_path}/out/*.xlsx")).where("number > 4").collect()
    found = {int(r.cells[0]): [*r.cells[1:], *[None] * (5 - len(r.cells))] for r in cells}
    shown = lambda x: None if x in (None, "") else str(x) if not isinstance(x, float) else str(int(x)) if x.is_integer() else repr(x)
    for k, t, x, b, d, _ in rows:
        assert [v or None for v in found[k]] == [shown(t), shown(x), str(b), shown(d)]
    assert {r.error for r in cells} == {None}
    one = xlsx.Book(open(told[0].path.removeprefix("file://"), "rb").read())
    assert list(one.sheets) == ["Лист"] and xlsx.column_letters(27) == "AB" and xlsx._column("AB7") == 27


def test_broken_books_are_rows_with_errors(spark):
    whole = xlsx.book_bytes({"a": 5}, [[1], [2]])
    files = spark.createDataFrame([("good", bytearray(whole)), ("cut", bytearray(whole[: len(whole) // 2])), ("text", bytearray(b"a;b")), ("none", bytearray(b""))], "path string, content binary")
    found = {}
    for r in xlsx.read_books(files).collect():
        found.setdefault(r.source, []).append(r.error)
    assert found["good"] == [None] * 3 and all(found[k][0].startswith("unreadable") for k in ("cut", "text", "none"))
    assert xlsx.book_bytes({"a": 5}, [[1], [2]]) == whole
