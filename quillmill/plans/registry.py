"""The queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel_path() -> Column:
    return F.concat(F.lit("raw/"), F.col("source"), F.lit("__"), F.col("doc_id").cast("string"), F.lit(".md"))


#: The same in SQL.
REL_PATH = "'raw/' || source || '__' || doc_id || '.md'"
#: The head of the checksum of a text.
SUM16 = r"substr(sha256(regexp_replace(text, '\r\n?', chr(10), 'g')), 1, 16)"


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with rel_path; contents stay unread unless a query selects text."""
    return table(spark, sf_dir, "documents").withColumn("rel_path", rel_path())
