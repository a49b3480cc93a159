"""Raw documents: scanning a tree of files, taking in new ones, and uploads with a verdict for each file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths, text

#: Suffixes taken in as text.
TEXT_SUFFIXES = (
    ".md .markdown .txt .rst .org .py .js .ts .tsx .jsx .go .rs .java .c .h .cpp .hpp .rb .php .sh "
    ".yaml .yml .toml .ini .cfg .json .html .css .sql"
).split()
#: Directories never entered.
IGNORED_DIRS = (
    ".git .hg .svn node_modules .venv venv __pycache__ .mypy_cache .pytest_cache .ruff_cache dist build .idea .vscode .next target"
).split()
#: Upload limits in bytes and entries.
MAX_FILE, MAX_RICH_FILE, MAX_ZIP_FILE, MAX_ZIP_ENTRIES, MAX_ZIP_TOTAL = 1_048_576, 10_485_760, 5_242_880, 200, 31_457_280
#: Suffixes of files that need conversion before they are text.
RICH_SUFFIXES = ".pdf .docx .pptx .xlsx .epub .rtf".split()


def _binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].lstrip("/")
    return files.withColumn("rel", F.regexp_replace(F.replace(plain, F.lit(base), F.lit("")), "^/+", ""))


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Markdown under raw/, without hidden files and _skipped folders: rel_path, checksum, size_bytes, on request text."""
    files = _binary(spark, f"{root.rstrip('/')}/raw", "*.md")
    parts = F.split("rel", "/")
    hidden = F.element_at(parts, -1).startswith(".") | F.array_contains(parts, "_skipped")
    body = text.newline_normalised(F.decode("content", "UTF-8"))
    rows = files.where(~hidden).select(F.concat(F.lit("raw/"), "rel").alias("rel_path"), body.alias("text"))
    rows = rows.select("rel_path", text.checksum(F.col("text")).alias("checksum"), F.octet_length("text").cast("long").alias("size_bytes"), "text")
    return rows if content else rows.drop("text")


def ingest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Text files of a tree as raw documents that name their source, and what was skipped with the reason."""
    files = _binary(spark, root)
    folders = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    files = files.where(~F.exists(folders, lambda d: d.isin(*IGNORED_DIRS)))
    reason = F.when(~_suffix(F.col("rel")).isin(*TEXT_SUFFIXES), "not a text suffix").when(~F.is_valid_utf8(F.col("content").cast("string")), "undecodable")
    judged = files.select("rel", "content", reason.alias("reason"))
    body = F.concat(F.lit("<!-- source: "), F.col("rel"), F.lit(" -->\n\n"), text.newline_normalised(F.decode("content", "UTF-8")))
    good = judged.where("reason IS NULL").select(F.concat(F.lit("raw/"), paths.flattened(F.col("rel"))).alias("rel_path"), body.alias("text"))
    return good, judged.where("reason IS NOT NULL").select(F.col("rel").alias("ref"), "reason")


def submit(new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (name, text) whose content is not yet known, once each, and duplicates. known: content_hash."""
    hashed = new.withColumn("content_hash", F.sha2("text", 256))
    first = hashed.groupBy("content_hash").agg(F.min("name").alias("name"))
    fresh = first.join(known.select("content_hash"), "content_hash", "left_anti")
    good = hashed.join(fresh, ["content_hash", "name"], "left_semi").dropDuplicates(["content_hash"])
    bad = hashed.join(fresh, ["content_hash", "name"], "left_anti").select("name", F.lit("content already submitted").alias("reason"))
    return good, bad


def upload_verdicts(files: DataFrame, allowed: Sequence[str] = tuple(TEXT_SUFFIXES) + tuple(RICH_SUFFIXES) + (".zip",)) -> DataFrame:
    """Files (name, size_bytes) with status uploaded or failed and the reason."""
    suffix = _suffix(F.col("name"))
    most = F.when(suffix == ".zip", MAX_ZIP_FILE).when(suffix.isin(*RICH_SUFFIXES), MAX_RICH_FILE).otherwise(MAX_FILE)
    reason = F.when(~suffix.isin(*allowed), "unsupported type").when(F.col("size_bytes") > most, "file too large").when(F.col("size_bytes") == 0, "empty file")
    return files.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "uploaded").otherwise("failed"))


def unzip(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archives (name, content) to their text entries. All entries of an archive are checked before any is taken; sizes are read from what is unpacked."""

    def entries(blob: bytes) -> tuple[list[tuple[str, str]], str]:
        try:
            z = zipfile.ZipFile(io.BytesIO(blob))
        except zipfile.BadZipFile:
            return [], "not an archive"
        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/") and not i.filename.split("/")[-1].startswith(".")]
        if len(infos) > MAX_ZIP_ENTRIES:
            return [], "too many entries"
        out, total = [], 0
        for i in infos:
            if i.filename.startswith("/") or ".." in i.filename.split("/") or (i.external_attr >> 16) & 0o170000 == 0o120000:
                return [], f"unsafe entry {i.filename}"
            if not i.filename.lower().endswith(tuple(TEXT_SUFFIXES)):
                return [], f"unsupported entry {i.filename}"
            with z.open(i) as f:
                data = f.read(MAX_FILE + 1)
            total += len(data)
            if len(data) > MAX_FILE or total > MAX_ZIP_TOTAL:
                return [], f"entry too large {i.filename}"
            try:
                out.append((i.filename, data.decode("utf-8")))
            except UnicodeDecodeError:
                return [], f"undecodable entry {i.filename}"
        return out, "" if out else "no entries"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, blob in zip(f["name"], f["content"], strict=True):
                found, reason = entries(bytes(blob))
                rows += [(name, e, t, None) for e, t in found] or [(name, None, None, reason)]
            yield pd.DataFrame(rows, columns=["archive", "name", "text", "reason"])

    both = archives.select("name", "content").mapInPandas(run, "archive string, name string, text string, reason string")
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL").select("archive", "reason")
