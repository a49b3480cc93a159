"""Text sinks: index files, stubs, timelines and event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(lines: DataFrame, path: str, order: list[str]) -> None:
    """K3, K4: lines in order, as one or more text files whose names keep the order."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def append_timeline(spark, path: str, event: str) -> None:
    """K5."""
    spark.range(1).select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"), F.lit(" "), F.lit(event)).alias("value")).write.mode("append").text(path)


def event_lines(events: DataFrame) -> DataFrame:
    """K9: one JSON object a line."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def parse_events(frames: DataFrame, column: str = "value") -> DataFrame:
    """server-sent frames ('data: {...}' parted by blank lines) to their type and payload; unknown types are null."""
    data = F.regexp_extract_all(column, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1))
    v = frames.select(F.explode(data).alias("d")).withColumn("v", F.try_parse_json("d"))
    kind = F.expr("try_variant_get(v, '$.type', 'string')")
    return v.select(F.when(kind.isin("status", "delta", "done", "error"), kind).alias("type"), "d")
