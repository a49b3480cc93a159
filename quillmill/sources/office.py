"""Office files to Markdown: documents, sheets, slides and books, read without any outside library.

The XML parts of a file become rows: paragraphs, table cells, shared strings. What belongs together is put together by Spark: a
sheet's cells are joined with the strings they refer to, rows and tables are rebuilt by grouping, and a file's lines by order. A
file that cannot be read has a reason and no text.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html

_PIECE = "path string, kind string, place int, row int, col int, style string, text string"
_COLUMNS = [x.split()[0] for x in _PIECE.split(", ")]
Piece = tuple[str, int, int, int, str, str]


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(archive: zipfile.ZipFile, part: str) -> ET.Element:
    data = archive.read(part)
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        raise ValueError(f"{part} declares entities")
    return ET.fromstring(data)


def _attribute(element: ET.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if _name(k) == name), "")


def _text(element: ET.Element) -> str:
    """The runs of text in an element; tabs and breaks as spaces."""
    parts = [x.text or "" if _name(x.tag) == "t" else " " if _name(x.tag) in ("tab", "br", "cr") else "" for x in element.iter()]
    return " ".join("".join(parts).split())


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _document(archive: zipfile.ZipFile) -> Iterator[Piece]:
    body = next(x for x in _tree(archive, "word/document.xml") if _name(x.tag) == "body")
    for place, block in enumerate(body):
        if _name(block.tag) == "tbl":
            for r, row in enumerate(x for x in block if _name(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _name(x.tag) == "tc"):
                    yield "cell", place, r, c, "", _text(cell)
        elif _name(block.tag) == "p":
            style = next((_attribute(x, "val") for x in block.iter() if _name(x.tag) == "pStyle"), "")
            heading = re.fullmatch(r"(?i)heading ?([1-6])", style)
            yield "line", place, 0, 0, "#" * int(heading[1]) if heading else "#" if style.lower() == "title" else "", _text(block)


def _slides(archive: zipfile.ZipFile) -> Iterator[Piece]:
    place = 0
    for n, part in enumerate(_numbered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
        yield "line", place, 0, 0, "##", f"Slide {n}"
        place += 1
        for p in (x for x in _tree(archive, part).iter() if _name(x.tag) == "p"):
            yield "line", place, 0, 0, "", _text(p)
            place += 1


def _sheets(archive: zipfile.ZipFile) -> Iterator[Piece]:
    if "xl/sharedStrings.xml" in archive.namelist():
        for i, item in enumerate(x for x in _tree(archive, "xl/sharedStrings.xml") if _name(x.tag) == "si"):
            yield "shared", 0, i, 0, "", _text(item)
    names = [_attribute(x, "name") for x in _tree(archive, "xl/workbook.xml").iter() if _name(x.tag) == "sheet"]
    for n, part in enumerate(_numbered(archive.namelist(), r"xl/worksheets/sheet(\d+)\.xml")):
        yield "line", 2 * n, 0, 0, "##", names[n] if n < len(names) else f"Sheet {n + 1}"
        for cell in (x for x in _tree(archive, part).iter() if _name(x.tag) == "c"):
            at = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
            value = next((x.text or "" for x in cell if _name(x.tag) == "v"), None)
            if at and (value is not None or cell.get("t") == "inlineStr"):
                col = 0
                for letter in at[1]:
                    col = 26 * col + ord(letter) - 64
                yield "cell", 2 * n + 1, int(at[2]) - 1, col - 1, cell.get("t", ""), _text(cell) if cell.get("t") == "inlineStr" else value


def _book(archive: zipfile.ZipFile) -> Iterator[Piece]:
    package = next(_attribute(x, "full-path") for x in _tree(archive, "META-INF/container.xml").iter() if _name(x.tag) == "rootfile")
    tree = _tree(archive, package)
    items = {_attribute(x, "id"): _attribute(x, "href") for x in tree.iter() if _name(x.tag) == "item"}
    place = 0
    for ref in (x for x in tree.iter() if _name(x.tag) == "itemref"):
        part = posixpath.normpath(posixpath.join(posixpath.dirname(package), items[_attribute(ref, "idref")]))
        for line in html.visible(archive.read(part).decode("utf-8", "replace"))[1].split("\n"):
            yield "line", place, 0, 0, "", line
            place += 1


_READERS = {".docx": _document, ".pptx": _slides, ".xlsx": _sheets, ".epub": _book}


def pieces(files: DataFrame) -> DataFrame:
    """path, kind (line, cell, shared or error), place, row, col, style, text. files: path, content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                reader = _READERS.get(posixpath.splitext(path)[1].lower())
                try:
                    if reader is None:
                        raise ValueError("no office file")
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        found = [(path, *x) for x in reader(archive)]
                except Exception as e:  # noqa: BLE001  a file that cannot be read is reported as data
                    found = [(path, "error", 0, 0, 0, "", str(e) or type(e).__name__)]
                yield pd.DataFrame(found, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, _PIECE)


def to_markdown(files: DataFrame) -> DataFrame:
    """Path, text and reason of every file (path, content): headings, paragraphs, and tables with their gaps filled."""
    rows = pieces(files)
    shared = rows.where("kind = 'shared'").select("path", F.col("row").cast("string").alias("text"), F.col("text").alias("string"))
    cells = rows.where("kind = 'cell'").join(shared, ["path", "text"], "left")
    value = F.when(F.col("style") == "s", F.coalesce("string", F.lit(""))).when(F.col("style") == "b", F.when(F.col("text") == "1", "TRUE").otherwise("FALSE")).otherwise(F.col("text"))
    plain = F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    cells = cells.select("path", "place", "row", "col", plain.alias("text"))
    widths = cells.groupBy("path", "place").agg((F.max("col") + 1).alias("width"), F.min("row").alias("first"))
    lines = cells.groupBy("path", "place", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells")).join(widths, ["path", "place"])
    every = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit("")))
    shown = F.concat(F.lit("| "), F.array_join(every, " | "), F.lit(" |"))
    ruled = F.when(F.col("row") == F.col("first"), F.concat(shown, F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))).otherwise(shown)
    tables = lines.select("path", "place", "row", ruled.alias("line"))
    text = F.when(F.col("style") == "", F.col("text")).otherwise(F.concat_ws(" ", "style", "text"))
    written = rows.where("kind = 'line' AND text <> ''").select("path", "place", "row", text.alias("line"))
    whole = tables.union(written).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row", "line"))), lambda x: x["line"]), "\n").alias("text"))
    errors = rows.where("kind = 'error'").select("path", F.col("text").alias("reason"))
    out = files.select("path").join(whole, "path", "left").join(errors, "path", "left")
    return out.select("path", F.when(F.col("reason").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "reason")
