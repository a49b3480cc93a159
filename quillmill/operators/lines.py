"""Texts as rows of lines, and what runs over them in order; a text's lines are one window partition, bounded by the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(articles: DataFrame, key: str, text: str = "text") -> DataFrame:
    return articles.select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))


def _upto(key: str) -> Window:
    return Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fenced(rows: DataFrame, key: str) -> DataFrame:
    """Rows with inside: an odd number of fence lines so far. The fence lines themselves are not inside."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    odd = F.sum(fence.cast("int")).over(_upto(key)) % 2 == 1
    return rows.withColumn("inside", odd & ~fence)


def sections(rows: DataFrame, key: str) -> DataFrame:
    """Rows with section: the number of second-level headings so far, 0 before the first."""
    return rows.withColumn("section", F.sum(F.col("line").startswith("## ").cast("int")).over(_upto(key)))


def digest(rows: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """A digest of a key's lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("l"))))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
