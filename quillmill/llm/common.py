"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors.

    batch_bytes: how much goes to Python at a time, which executor and worker hold more than once each.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillmill/{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"}  # the table stands for the shuffles behind it: Spark deletes their files when it is written
    if batch_bytes is not None:
        wanted[_BATCH] = str(batch_bytes)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns the memory that Arrow and the C library hold for reuse: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def returning(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """What a task does with its batches, after which spare memory goes back."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def returning_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """What a task does with a group, after which spare memory goes back."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """batches in parts of a bounded number of rows, so that what is made of one is not held for all."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def salts(places: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word, mixed so that hashes made of sums of products depend on every letter and its place, however long the word."""
    x = (np.arange(int(places.max()) + 1 if len(places) else 0, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) | np.uint64(1))[places]


def values(spark: SparkSession, rows: list[tuple[str, float]], names: str) -> DataFrame:
    """A small table written out as SQL VALUES, so that no Python runs to make it. rows: a string and a number each."""
    listed = ", ".join(f"('{a.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', {float(b)!r}D)" for a, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def count_chars(text: Column, kept: str) -> Column:
    """How many characters of the class ``kept`` (the inside of a regex bracket) a text holds."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
