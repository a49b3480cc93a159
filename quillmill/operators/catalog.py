"""Catalogs and indexes: inverted tag index, document catalog, directory counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import paths, text


def document_catalog(docs: DataFrame, limit: int = 200) -> DataFrame:
    """One entry a raw document: its extraction's summary, else its first paragraph, after a context prefix and within the limit.

    docs: rel_path, context, text and declared (null without an extraction).
    """
    prefix = F.concat(F.col("context"), F.lit(" · "))
    about = F.coalesce(F.when(F.trim("declared") != "", F.col("declared")), text.first_paragraph(text.split_frontmatter(F.col("text"))[1]))
    return docs.select(
        F.col("rel_path").alias("path"),
        paths.stem(F.col("rel_path")).alias("title"),
        F.concat(prefix, text.flatten(about, F.lit(limit) - F.length(prefix))).alias("summary"),
    )


def tag_index(articles: DataFrame) -> DataFrame:
    """A1, O2: articles (title, tags) by tag, titles in order. Counts are partial before the shuffle; lists are what an index holds."""
    rows = articles.select("title", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("title")), "; ").alias("titles"))


def primary(index: DataFrame, least: int = 3) -> DataFrame:
    """A2: tags of at least so many articles; the others make the long tail."""
    return index.where(F.col("n") >= least)


def long_tail(index: DataFrame, least: int = 3) -> DataFrame:
    return index.where(F.col("n") < least)


def directory_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """Files below every directory, at any depth."""
    return files.select(F.explode(paths.prefixes(F.col(path))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def tree(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of a tree: path, parent, depth, is_dir; directories first, then names."""
    p = F.col(path)
    leaves = files.select(p.alias("path"), F.lit(False).alias("is_dir"))
    dirs = files.select(F.explode(paths.prefixes(p)).alias("path"), F.lit(True).alias("is_dir")).where("path <> ''").distinct()
    rows = leaves.union(dirs)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return rows.select("path", parent.alias("parent"), F.size(F.split("path", "/")).alias("depth"), "is_dir").orderBy("parent", F.desc("is_dir"), "path")


def resolve_documents(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """References of articles (a list column of possibly comma-joined refs) to raw documents: ref and status, each ref once."""
    refs = articles.select(F.explode("sources").alias("s")).select(F.explode(F.split("s", ",")).alias("ref")).select(F.trim("ref").alias("ref")).where("ref <> ''").distinct()
    held = raw.select(F.col("rel_path").alias("ref"), F.lit(True).alias("found"))
    clean = paths.normalised(F.col("ref"))
    status = (
        F.when(clean.isNull(), "escapes_kb")
        .when(~clean.startswith("raw/"), "not_a_raw_document")
        .when(F.col("found").isNull(), "document_missing")
        .otherwise("ok")
    )
    return refs.join(held, "ref", "left").select("ref", status.alias("status"))


def selected(choices: DataFrame, catalog: DataFrame, k: int = 6) -> DataFrame:
    """A model's choice of paths (question, paths): known ones, first mention, at most k a question."""
    rows = choices.select("question", F.posexplode("paths").alias("pos", "path"))
    first = rows.groupBy("question", "path").agg(F.min("pos").alias("pos")).join(catalog.select("path"), "path", "left_semi")
    rank = F.row_number().over(Window.partitionBy("question").orderBy("pos"))
    return first.select("question", rank.alias("rank"), "path").where(F.col("rank") <= k)


def invented(choices: DataFrame, catalog: DataFrame) -> DataFrame:
    """How many distinct chosen paths the catalog does not have."""
    rows = choices.select("question", F.explode("paths").alias("path")).distinct()
    return rows.join(catalog.select("path"), "path", "left_anti").groupBy("question").agg(F.count(F.lit(1)).alias("dropped"))


def off_topic(catalog: DataFrame, keep: DataFrame) -> DataFrame:
    """U4."""
    return catalog.select("path").join(keep.select("path"), "path", "left_anti")


def matches_query(query: str, title: Column, name: Column, path: Column, tags: Column) -> Column:
    """P20: part of the title (or the name without one), the path or a tag, in any case."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    return F.coalesce(has(F.coalesce(title, name)), F.lit(False)) | has(path) | F.coalesce(F.exists(tags, has), F.lit(False))


def parse_index(lines: DataFrame, line: str = "line") -> DataFrame:
    """Catalog entries of an index file: - [title](path) — summary | keys: ..."""
    pattern = r"^- \[(.*?)\]\((.*?)\)(?: — (.*?))?(?: \| keys: (.*))?$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return lines.where(F.col(line).rlike(pattern)).select(part(1).alias("title"), part(2).alias("path"), part(3).alias("summary"), part(4).alias("keys"))


def index_line(title: Column, path: Column, about: Column) -> Column:
    """K3: what parse_index reads."""
    return F.concat(F.lit("- ["), title, F.lit("]("), path, F.lit(") — "), about)
