import io
import zipfile

import pytest

from condensa.sources import files, sheets

HEAD = ["name", "n", "name", None, "ok"]
ODD = ["<a & \"b\">", " two\nlines\r\n", "\x0b_x000B_ and _x0041_", "é 日本", "_"]


def test_workbooks_are_read_in_parallel_by_head(spark, tmp_path):
    for i in range(3):
        rows = [HEAD, *[[x, i, j, None, j % 2 == 0] for j, x in enumerate(ODD)], [None] * 5, ["last", 1.5, "", "kept", None]]
        (tmp_path / f"b{i}.xlsx").write_bytes(sheets.packed([("first", rows), ("other & more", [["k"], [i]])]))
    got = files.sheet(spark, str(tmp_path))
    assert got.columns == ["file", "row", "name", "n", "name C", "D", "ok"]
    rows = sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in got.collect())
    want = [(f"b{i}.xlsx", j + 2, x, str(i), str(j), None, str(j % 2 == 0)) for i in range(3) for j, x in enumerate(ODD)]
    assert rows == sorted([*want, *((f"b{i}.xlsx", 8, "last", "1.5", "", "kept", None) for i in range(3))])
    other = sheets.table(sheets.workbooks(spark, str(tmp_path)), "other & more")
    assert sorted(r.k for r in other.collect()) == ["0", "1", "2"] and sheets.table(sheets.workbooks(spark, str(tmp_path)), 1).columns == other.columns
    assert files.sheet(spark, str(tmp_path), columns=["n"]).columns == ["file", "row", "n"]
    assert sheets.table(sheets.workbooks(spark, str(tmp_path)), "none").count() == 0


def test_only_the_parts_asked_for_are_unpacked():
    book = zipfile.ZipFile(io.BytesIO(sheets.packed([("a", [["x"]]), ("b", [["y", 2], [None, "z"]])])))
    opened, old = [], book.open
    book.open = lambda name, *a, **k: (opened.append(name if isinstance(name, str) else name.filename), old(name, *a, **k))[1]
    parts, strings = sheets.sheet_parts(book), sheets.shared_strings(book)
    assert [n for n, _ in parts] == ["a", "b"]
    assert list(sheets.sheet_rows(book, parts[1][1], strings, {1})) == [(1, {1: "2"}), (2, {1: "z"})]
    assert parts[0][1] not in opened and parts[1][1] in opened


def test_other_writers_of_the_format():
    """Inline strings, rich text, cells without references, absolute targets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{sheets.MAIN[1:-1]}" xmlns:r="{sheets.LINK[1:-1]}"><sheets><sheet name="s" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sheets.PACKAGE[1:-1]}"><Relationship Id="x" Target="/xl/s.xml"/></Relationships>')
        z.writestr("xl/s.xml", f'<worksheet xmlns="{sheets.MAIN[1:-1]}"><sheetData><row><c t="inlineStr"><is><t>a</t></is></c><c><v>1e3</v></c></row><row r="5"><c r="C5" t="str"><f>x</f><v>sum</v></c><c t="s"><v>0</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.MAIN[1:-1]}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
    book = zipfile.ZipFile(out)
    rows = list(sheets.sheet_rows(book, sheets.sheet_parts(book)[0][1], sheets.shared_strings(book)))
    assert rows == [(1, {0: "a", 1: "1e3"}), (5, {2: "sum", 3: "rich", 4: "#N/A"})]


@pytest.mark.parametrize("n", [0, 25, 26, 51, 701, 702, 16383])
def test_column_names(n):
    assert sheets.column_number(sheets.column_name(n) + "7") == n
