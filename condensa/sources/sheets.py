"""Spreadsheet workbooks (Office Open XML) read and written in tasks, a workbook a row.

A workbook is a zip of XML parts.  Only the parts of the sheets that are asked
for are unpacked, rows are parsed as a stream, and cells of other columns are
passed over.  Bytes come through Spark's reader of binary files, so any store
that Spark reads will do, and nothing goes through the driver but a head line.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions.ship import ship

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(x.get("name"), part(links[x.get(f"{LINK}id")])) for x in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def _text(x: ET.Element) -> str:
    """Of a string, its runs joined; phonetic hints are none of it. What XML can't hold is written _xHHHH_."""
    text = "".join(t.text or "" for run in [x, *x.findall(f"{MAIN}r")] for t in run.findall(f"{MAIN}t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _held(text: str) -> str:
    """The other way round; what looks like it already has its first stroke written so."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", text))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, x in ET.iterparse(f):
            if x.tag == f"{MAIN}si":
                out.append(_text(x))
                x.clear()
    return out


def sheet_rows(book: zipfile.ZipFile, part: str, strings: list[str], wanted: set[int] | None = None, first_only: bool = False) -> Iterator[tuple[int, dict[int, str]]]:
    """(row from 1, value by column number) of the cells that hold something, as text; numbers as they are written, dates as numbers."""
    number = 0
    with book.open(part) as f:
        for _, x in ET.iterparse(f):
            if x.tag != f"{MAIN}row":
                continue
            number = int(x.get("r") or number + 1)
            cells, at = {}, -1
            for c in x.findall(f"{MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else at + 1
                if wanted is not None and at not in wanted:
                    continue
                kind, v = c.get("t"), c.find(f"{MAIN}v")
                if kind == "inlineStr":
                    value = _text(c.find(f"{MAIN}is")) if c.find(f"{MAIN}is") is not None else ""
                elif v is None or v.text is None:
                    continue
                else:
                    value = strings[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else v.text
                cells[at] = value
            x.clear()
            if cells or first_only:
                yield number, cells
            if first_only:
                return


def workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, content) of workbooks in folders or files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def head(books: DataFrame, sheet: int | str = 0) -> list[str]:
    """The first row of the first workbook's sheet, by file name; cells without text are named by their column."""
    first = books.orderBy("file").limit(1).mapInPandas(_parser(sheet, None, True), "file string, row int, at int, value string")
    named = {r.at: r.value for r in first.collect() if r.at is not None}
    return [named.get(i, column_name(i)) for i in range(max(named, default=-1) + 1)]


def _parser(sheet: int | str, wanted: set[int] | None, first_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                out = []
                if content:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        parts = sheet_parts(book)
                        found = [p for i, (name, p) in enumerate(parts) if sheet in (i, name)]
                        strings = shared_strings(book) if found else []
                        for part in found:
                            for row, cells in sheet_rows(book, part, strings, wanted, first_only):
                                out += [(file, row, at, value) for at, value in cells.items()]
                                if len(out) >= 100_000:
                                    yield pd.DataFrame(out, columns=["file", "row", "at", "value"])
                                    out = []
                yield pd.DataFrame(out, columns=["file", "row", "at", "value"])

    return run


def table(books: DataFrame, sheet: int | str = 0, columns: list[str] | None = None) -> DataFrame:
    """(file, row, columns...): a sheet of each of books(file, content) below its head, as text; rows without a cell are left out.

    sheet: its place from 0, or its name; workbooks without it give no rows.
    Columns are those of the first workbook's head, `columns` only if given;
    where a name repeats, the later ones are followed by their column's letters.
    """
    ship(books.sparkSession)
    names: list[str] = []
    for i, n in enumerate(head(books, sheet)):
        names.append(f"{n} {column_name(i)}" if n in names else n)
    wanted = {i: n for i, n in enumerate(names) if columns is None or n in columns}
    cells = books.select("file", "content").mapInPandas(_parser(sheet, set(wanted), False), "file string, row int, at int, value string").where("row > 1")
    # a row's cells come from one task, in a run; they meet again by file and row
    rows = cells.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"))
    return rows.select("file", "row", *(F.col("cells")[i].alias(n) for i, n in wanted.items()))


def packed(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of sheets (name, rows): text as shared strings, numbers as numbers, None as no cell."""
    strings: dict[str, int] = {}

    def cell(row: int, at: int, value) -> str:
        if value is None or value != value:
            return ""
        ref = f"{column_name(at)}{row}"
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value!r}</v></c>'
        return f'<c r="{ref}" t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>'

    bodies = ["".join(f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1)) for _, rows in sheets]
    top, main, link = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', MAIN[1:-1], LINK[1:-1]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name), top + text)  # a fixed date: equal rows make equal bytes

        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{link}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        for i, body in enumerate(bodies, 1):
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        put("xl/sharedStrings.xml", f'<sst xmlns="{main}" count="{len(strings)}" uniqueCount="{len(strings)}">' + "".join(f'<si><t xml:space="preserve">{_held(s)}</t></si>' for s in strings) + "</sst>")
    return out.getvalue()


def books(rows: DataFrame, by: str, order: list[str], sheet: str = "Sheet1", rows_a_book: int = 100_000) -> DataFrame:
    """(file, content): workbooks of a group's rows under a head line, in the order of some columns; a large group goes on in further workbooks."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        body = [[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in pdf[names].itertuples(index=False)]
        return pd.DataFrame({"file": [f"{pdf[by].iloc[0]}-{pdf['book__'].iloc[0]}.xlsx"], "content": [packed([(sheet, [names, *body])])]})

    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / rows_a_book).cast("int").alias("books__"))
    dealt = rows.join(sizes, by).withColumn("book__", F.pmod(F.xxhash64(*order), F.col("books__")))
    return dealt.drop("books__").groupBy(by, "book__").applyInPandas(run, "file string, content binary")
