"""Workbooks (zipped XML sheets) as a Spark data source, one partition for each part of each sheet.

``register(spark)`` once, then ``spark.read.format("workbook").option("path", uri).load()`` gives path, sheet, row (from 1) and
cells: the texts of the row's cells up to the last one that isn't empty. Options: ``rows`` (rows of a partition, 50000).

A sheet's XML has no index, so a partition reads it from the start and parses rows of its range only; shared strings are
parsed once in a partition. Files lie in any store that pyarrow opens.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import text as X

SCHEMA = "path string, sheet string, row int, cells array<string>"
BATCH = 2000
_LETTERS = re.compile("[A-Z]+")


def _name(element: ElementTree.Element) -> str:
    """The tag without its namespace."""
    return element.tag.rsplit("}", 1)[-1]


def _open(path: str) -> zipfile.ZipFile:
    filesystem, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return zipfile.ZipFile(filesystem.open_input_file(inner))


def _files(path: str) -> list[str]:
    """The workbooks at a path: itself, or those directly in a folder."""
    filesystem, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    if filesystem.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    found = filesystem.get_file_info(pafs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.base_name.endswith(".xlsx") and not f.base_name.startswith("~"))


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in the order of the workbook."""
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _name(e) == "sheet":
            key = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            target = targets[key]
            out.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _text(element: ElementTree.Element) -> str:
    """All runs of a string, without phonetic notes."""
    if _name(element) == "rPh":
        return ""
    return (element.text or "") if _name(element) == "t" else "".join(map(_text, element))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _column(reference: str) -> int:
    n = 0
    for c in _LETTERS.match(reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, strings: list[str]) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(x) for x in c if _name(x) == "is")
    value = next((x.text or "" for x in c if _name(x) == "v"), "")
    return strings[int(value)] if kind == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value


def rows(book: zipfile.ZipFile, part: str, first: int, last: int) -> Iterator[tuple[int, list[str]]]:
    """(row, cells) of the rows first..last that hold anything."""
    strings = shared_strings(book)
    at = 0
    with book.open(part) as f:
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if _name(e) != "row":
                continue
            if event == "start":
                at = int(e.get("r", at + 1))
                if at > last:
                    return
                continue
            if at >= first:
                cells: list[str] = []
                for c in e:
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (k + 1 - len(cells))
                    cells[k] = _cell(c, strings)
                while cells and not cells[-1].strip():
                    cells.pop()
                if cells:
                    yield at, cells
            e.clear()


def _last_row(book: zipfile.ZipFile, part: str) -> int:
    """The number of the last row, which a sheet states in its last row element."""
    last = 0
    with book.open(part) as f:
        rest = b""
        while block := f.read(1 << 20):
            text = rest + block
            found = re.findall(rb"<(?:\w+:)?row\b[^>]*?\br=\"(\d+)\"", text)
            last = max([last, *map(int, found)])
            rest = text[-512:]
    return last


@dataclass
class Part(InputPartition):
    path: str
    sheet: str
    part: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Part]:
        out = []
        for path in _files(self.path):
            with _open(path) as book:
                for sheet, part in sheets(book):
                    last = _last_row(book, part)
                    # rows without numbers can't be told apart beforehand, so such a sheet is one part
                    starts = range(1, last + 1, self.size) if last else [1]
                    out += [Part(path, sheet, part, a, a + self.size - 1 if last else 1 << 31) for a in starts]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.sheet] * n), pa.array([r for r, _ in held], pa.int32()), pa.array([c for _, c in held], pa.list_(pa.string()))], names=["path", "sheet", "row", "cells"])

        with _open(partition.path) as book:
            for row in rows(book, partition.part, partition.first, partition.last):
                held.append(row)
                if len(held) == BATCH:
                    yield batch()
                    held = []
        if held:
            yield batch()


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rows", 50_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)


def entries(spark: SparkSession, path: str, rows_per_part: int = 50_000) -> DataFrame:
    """path, sheet, row, fields: the rows of each sheet below its first, as a map from header names to trimmed texts.

    Names are trimmed and made unique by a number (``en``, ``en_2``); a column without a name goes by its place. Rows shorter
    than the header are filled with empty texts, cells beyond it go, and so do rows that repeat the header or hold nothing.
    """
    register(spark)
    d = spark.read.format("workbook").option("path", path).option("rows", rows_per_part).load()
    trimmed = d.withColumn("cells", F.transform("cells", X.strip))
    first = trimmed.groupBy("path", "sheet").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("top"))  # one row a sheet
    base = F.transform("head", lambda h, i: F.when(h == "", F.concat(F.lit("column"), (i + 1).cast("string"))).otherwise(h))
    named = first.withColumn("base", base)
    before = lambda b, i: F.size(F.filter(F.slice("base", F.lit(1), i), lambda x: x == b))
    unique = F.transform("base", lambda b, i: F.when(before(b, i) > 0, F.concat(b, F.lit("_"), (before(b, i) + 1).cast("string"))).otherwise(b))
    named = named.withColumn("names", unique)
    j = trimmed.join(named, ["path", "sheet"]).where(F.col("row") > F.col("top"))
    filled = F.transform("names", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))
    j = j.withColumn("values", filled).where(F.exists("values", lambda v: v != "") & (F.col("values") != F.col("head")))
    return j.select("path", "sheet", "row", F.map_from_arrays("names", "values").alias("fields"))
