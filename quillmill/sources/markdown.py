"""The extraction layer as Markdown: a file a document that people can read and edit.

A header between two lines of three dashes holds where the extraction comes from, its summary, topics, and how many items each
section has; then a section for each list, an item a line. Every value is JSON, which YAML readers read too, so no value has a
line break of its own and a heading is known by standing at the start of a line. Rendering and parsing are column expressions;
files are read and written in the tasks, and a scan of headers stops reading each file where its header ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text

from .extractions import HEADER, LISTS, SCHEMA, VERSION, counts

_KINDS = {f.name: f.dataType for f in SCHEMA.fields}
_END = b"\n---\n"


def _scalar(value: Column) -> Column:
    """A value as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def serialise() -> Column:
    """K1: an extraction (the columns of extractions.SCHEMA but counts) as Markdown; topics sorted, an absent value has no line."""
    lines = []
    for name in HEADER:
        value = F.lit(VERSION) if name == "schema_version" else F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX") if name == "extracted_at" else F.col(name)
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), _scalar(value), F.lit("\n"))).otherwise(""))
    lines.append(F.concat(F.lit("summary: "), _scalar(F.coalesce("summary", F.lit(""))), F.lit("\n")))
    lines.append(F.concat(F.lit("topics: "), F.to_json(F.array_sort(F.coalesce("topics", F.array().cast("array<string>")))), F.lit("\n")))
    lines.append(F.concat(F.lit("counts: "), F.to_json(counts()), F.lit("\n")))
    sections = []
    for name in LISTS:
        items = F.array_join(F.transform(name, lambda x: F.concat(F.lit("- "), F.to_json(x), F.lit("\n"))), "")
        sections.append(F.concat(F.lit("\n## "), text.heading_for(F.lit(name)), F.lit("\n\n"), F.when(F.size(name) > 0, items).otherwise("[]\n")))
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"), *sections)


def _header(content: Column) -> Column:
    """What is between the dashes, with a line break before and after; null if the second line of them is missing."""
    found = F.regexp_extract(content, r"(?s)\A---(\n.*?\n)---\n", 1)
    return F.when(found != "", found)


def _value(header: Column, name: str) -> Column:
    kind = _KINDS[name]
    raw = F.regexp_extract(header, rf"\n{name}: ([^\n]*)\n", 1)
    if name in ("topics", "counts"):
        return F.from_json(raw, kind)
    plain = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    return F.try_to_timestamp(plain) if name == "extracted_at" else plain.try_cast(kind)


def header_columns(content: Column) -> dict[str, Column]:
    """The header alone: where it comes from, summary, topics and counts."""
    head = _header(content)
    return {name: _value(head, name) for name in (*HEADER, "summary", "topics", "counts")}


def _section(parts: Column, name: str) -> Column:
    """The lines of a section; null if it has no heading."""
    found = F.get(F.filter(parts, lambda s: F.startswith(s, F.concat(text.heading_for(F.lit(name)), F.lit("\n")))), F.lit(0))
    return F.filter(F.slice(F.split(found, "\n"), 2, 1 << 30), lambda x: F.trim(x) != "")


def parse(rows: DataFrame, column: str = "content") -> DataFrame:
    """Rows with the columns of an extraction in place of the Markdown, and ``reason``, why it cannot be used (null if it can): a record that fails counts as absent, never as empty."""
    lines = {name: f"_lines_{name}" for name in LISTS}
    out = rows.withColumn("_head", _header(F.col(column))).withColumn("_parts", F.split(column, "\n## ")).withColumns({lines[n]: _section(F.col("_parts"), n) for n in LISTS})
    out = out.withColumns({n: _value(F.col("_head"), n) for n in (*HEADER, "summary", "topics", "counts")})
    parsed = {}
    for name in LISTS:
        at = F.col(lines[name])
        items = F.from_json(F.concat(F.lit("["), F.array_join(F.transform(at, lambda x: F.substring(x, F.lit(3), F.length(x))), ","), F.lit("]")), _KINDS[name])
        listed = F.forall(at, lambda x: F.startswith(x, F.lit("- ")))
        parsed[name] = F.when((F.size(at) == 0) | (F.array_join(at, "") == "[]"), F.array().cast(_KINDS[name])).when(listed, F.when(~F.exists(items, lambda x: x.isNull()), items))
    out = out.withColumns(parsed)
    reason = F.when(F.col("_head").isNull(), "no complete header").when(~F.col("schema_version").eqNullSafe(VERSION), "unknown version")
    for name in LISTS:
        reason = reason.when(F.col(lines[name]).isNull(), f"section {name} missing").when(F.col(name).isNull(), f"section {name} is no list")
    for name in LISTS:
        reason = reason.when(~F.size(name).eqNullSafe(F.col(f"counts.{name}")), f"count of {name} disagrees")
    return out.withColumn("reason", reason).drop("_head", "_parts", column, *lines.values())


# ---- files


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """K1: each row (rel_path, content) as a file below root; a file is written beside and moved into place, so that none is ever half there. Returns rel_path, bytes and existed. Evaluating the result writes; its rows may be written twice, with the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        made: set[str] = set()
        for batch in batches:
            sizes, existed = [], []
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{rel}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                data = content.encode()
                existed.append(store.get_file_info(path).type == fs.FileType.File)
                with store.open_output_stream(f"{path}.part") as out:
                    out.write(data)
                store.move(f"{path}.part", path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(existed, pa.bool_())], ["rel_path", "bytes", "existed"])

    return rows.select("rel_path", "content").mapInArrow(run, "rel_path string, bytes long, existed boolean")


def _contents(spark: SparkSession, root: str, whole: bool, block: int = 4096) -> DataFrame:
    """path, content and read (bytes taken from the store) of the files below root; only their headers, or whole. Spark lists the files without opening them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                data, end = b"", -1
                with store.open_input_stream(name, buffer_size=0) as source:
                    while end < 0 and len(data) < length:
                        more = source.read(length if whole else block)
                        if not more:
                            break
                        seen = max(0, len(data) - len(_END))
                        data += more
                        end = -1 if whole else data.find(_END, seen)
                kept = data if end < 0 else data[: end + len(_END)]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kept.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64())], ["path", "content", "read"])

    return listed.mapInArrow(run, "path string, content string, read long")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, the columns of the extractions, and reason."""
    return parse(_contents(spark, root, True)).drop("read")


def read_headers(spark: SparkSession, root: str, block: int = 4096) -> DataFrame:
    """Path, read, and the headers' columns; no file is read further than the block in which its header ends."""
    return _contents(spark, root, False, block).select("path", "read", *(c.alias(n) for n, c in header_columns(F.col("content")).items()))
