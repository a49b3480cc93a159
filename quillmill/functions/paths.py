"""Path functions over '/'-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """The path with '.', '' and '..' folded away; null if it is absolute or climbs out of its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(stack: Column, part: Column) -> Column:
        pop = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(stack.isNull(), stack).when(part == "..", pop).otherwise(F.concat(stack, F.array(part)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.startswith("/"), F.lit(None).cast("string")).otherwise(F.array_join(folded, "/"))


def is_article(path: Column) -> Column:
    """Starts with wiki/ and lies strictly under it once normalised."""
    return path.startswith("wiki/") & F.coalesce(normalised(path).startswith("wiki/"), F.lit(False))


def extraction_path(raw: Column) -> Column:
    """raw/x to extraction/x; null for what is not under raw/ or climbs."""
    ok = F.coalesce(normalised(raw).startswith("raw/"), F.lit(False)) & ~F.array_contains(F.split(raw, "/"), "..")
    return F.when(ok, F.regexp_replace(raw, "^raw/", "extraction/"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def citation(path: Column) -> Column:
    """No fragment, no leading ./ or /, always .md."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), "#.*$", ""), r"^(?:\./|/)+", "")
    return F.when(bare.endswith(".md"), bare).otherwise(F.concat(bare, F.lit(".md")))


def type_of(path: Column) -> Column:
    """The second segment of a path of more than two, else concept."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("concept")


def title_of(path: Column) -> Column:
    """The stem, hyphens to spaces, in title case."""
    return F.initcap(F.replace(stem(path), F.lit("-"), F.lit(" ")))


def prefixes(path: Column) -> Column:
    """All directories above a path, the root '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def flattened(rel: Column) -> Column:
    """Directories joined by __, .md appended unless there."""
    flat = F.replace(rel, F.lit("/"), F.lit("__"))
    return F.when(flat.endswith(".md"), flat).otherwise(F.concat(flat, F.lit(".md")))


def is_raw(path: Column) -> Column:
    """Strictly under raw/ once normalised."""
    return F.coalesce(normalised(path).startswith("raw/"), F.lit(False))


#: Suffixes of files that are no text before they are converted.
RICH = ".pdf .docx .pptx .xlsx .html .htm .epub .rtf".split()


def needs_conversion(path: Column) -> Column:
    """S7, P13."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*RICH)


def source_tokens(path: Column) -> Column:
    """what a source may be called by: its path, and the last part of its name between double underscores."""
    return F.array_distinct(F.array(path, F.element_at(F.split(stem(path), "__"), -1)))
