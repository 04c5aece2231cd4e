"""Workbooks written by hand: shared, rich and inline strings, ragged rows, repeated headers, several sheets and parts."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from bitloom.sources import workbooks as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def cell(column, row, value, shared):
    at = f'r="{column}{row}"'
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {at}><v>{value}</v></c>"
    if value.startswith("="):
        return f'<c {at} t="str"><f>A1</f><v>{escape(value[1:])}</v></c>'
    if value.startswith("~"):
        return f'<c {at} t="inlineStr"><is><t>{escape(value[1:])}</t></is></c>'
    return f'<c {at} t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'


def write(path, sheets, numbered=True):
    """``sheets``: name -> {row: {column: value}}."""
    shared = {}
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        for k, name in enumerate(names):
            rows = "".join(f"<row{f' r=\"{r}\"' if numbered else ''}>{''.join(cell(c, r, v, shared) for c, v in cells.items())}</row>" for r, cells in sheets[name].items())
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k + 1}" Target="{"/xl/" if k % 2 else ""}worksheets/sheet{k + 1}.xml"/>' for k in range(len(names))) + "</Relationships>")
        rich = lambda t: f"<si><r><t>{escape(t[: len(t) // 2])}</t></r><r><rPr/><t>{escape(t[len(t) // 2 :])}</t></r><rPh><t>no</t></rPh></si>" if len(t) > 8 else f"<si><t>{escape(t)}</t></si>"
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(map(rich, shared)) + "</sst>")


HEAD = {"A": " zh ", "B": "en", "C": "en", "E": "note", "G": " "}
TERMS = {
    1: HEAD, 2: {"A": "止", "B": "calm\nabiding & rest", "C": "=stop", "E": 1.5}, 3: {"A": "观"}, 4: {"A": "zh", "B": "en", "C": "en", "E": "note"}, 5: {"A": " ", "H": "beyond"}, 7: {"AB": "far out", "B": "~inline"},
    9: {"A": "a long shared string", "E": True},
}


def test_rows(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"Terms & more": TERMS, "空": {}, "other": {3: {"B": "x"}}})
    W.register(spark)
    for size in (1, 2, 50_000):
        d = spark.read.format("workbook").option("path", f"file://{tmp_path}/a.xlsx").option("rows", size).load()
        assert d.rdd.getNumPartitions() >= (9 if size == 1 else 3)
        got = {(r.sheet, r.row): r.cells for r in d.collect()}
        assert got["Terms & more", 2] == ["止", "calm\nabiding & rest", "stop", "", "1.5"] and got["Terms & more", 7] == ["", "inline", *[""] * 25, "far out"]
        assert got["Terms & more", 9] == ["a long shared string", "", "", "", "TRUE"] and got["other", 3] == ["", "x"] and ("Terms & more", 6) not in got and len(got) == 8


def test_entries(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"t": TERMS, "u": {2: {"A": "zh", "B": "en"}, 3: {"A": "空", "B": "empty"}}})
    write(tmp_path / "b.xlsx", {"t": {1: {"A": "zh"}, 2: {"A": "无"}}})
    for size in (2, 100):
        got = {(r.path.rsplit("/", 1)[1], r.sheet, r.row): r.fields for r in W.entries(spark, f"file://{tmp_path}", size).collect()}
        names = ["zh", "en", "en_2", "column4", "note"]
        assert set(got) == {("a.xlsx", "t", 2), ("a.xlsx", "t", 3), ("a.xlsx", "t", 7), ("a.xlsx", "t", 9), ("a.xlsx", "u", 3), ("b.xlsx", "t", 2)}
        assert got["a.xlsx", "t", 2] == dict(zip(names, ["止", "calm\nabiding & rest", "stop", "", "1.5"], strict=True))
        assert got["a.xlsx", "t", 3] == dict(zip(names, ["观", "", "", "", ""], strict=True)) and got["a.xlsx", "u", 3] == {"zh": "空", "en": "empty"} and got["b.xlsx", "t", 2] == {"zh": "无"}


def test_rows_without_numbers(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"t": {1: {"A": "x"}, 2: {"A": "y"}}}, numbered=False)
    W.register(spark)
    d = spark.read.format("workbook").option("path", str(tmp_path / "a.xlsx")).option("rows", 1).load()
    assert sorted((r.row, r.cells) for r in d.collect()) == [(1, ["x"]), (2, ["y"])]


@pytest.mark.parametrize("letters", ["A", "Z", "AA", "AZ", "BA", "XFD"])
def test_columns(letters):
    n = 0
    for c in letters:
        n = n * 26 + "ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c) + 1
    assert W._column(f"{letters}12") == n - 1
