"""What a knowledge base remembers between runs, as tables keyed by document: compile state, the classify cache, categories, and what was refused."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths

#: The categories of a knowledge base that names none.
CATEGORIES = ("concept", "decision", "project", "reference", "guide", "person")


# ---- stores


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty where none has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def save(rows: DataFrame, path: str, version: int) -> str:
    """K6: a new version beside the old ones, committed as a whole; readers take the version they were told. A version that is there stays: writing it again is an error."""
    out = f"{path}/v{version}"
    rows.write.mode("error").parquet(out)
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def latest(spark: SparkSession, root: str) -> int:
    """The last committed version of a table; 0 before the first."""
    store, place = _place(spark, f"{root}/commits")
    return max((int(f.getPath().getName()) for f in store.listStatus(place)), default=0) if store.exists(place) else 0


def committed(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    """A version of a table; empty for version 0."""
    if not version:
        return spark.createDataFrame([], schema)
    store, place = _place(spark, f"{root}/commits/{version:012}")
    for _ in range(600):  # its writer may have made the name, and be about to say where the data is
        with_name = store.open(place)
        try:
            name = bytes(with_name.readNBytes(64)).decode()
        finally:
            with_name.close()
        if len(name) == 32:
            return spark.read.schema(schema).parquet(f"{root}/data/{name}")
        time.sleep(0.05)
    raise RuntimeError(f"version {version} of {root} has no data: its writer broke off between its commit's name and content")


def commit(spark: SparkSession, root: str, schema: str, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
    """K2, K6: the next version of a table, made of the last by ``change``; returns its number. No writer's rows are lost.

    Data is written first, under a name of its own; then a commit of the next number is made, which only one writer can do. Who
    comes second drops its data, reads the winner's version, and makes its change to that. Readers see whole versions only.
    Needs a store that can create a file only if it is absent (HDFS and local files can).
    """
    for _ in range(tries):
        version = latest(spark, root)
        name = uuid.uuid4().hex
        change(committed(spark, root, version, schema)).write.mode("error").parquet(f"{root}/data/{name}")
        store, place = _place(spark, f"{root}/commits/{version + 1:012}")
        try:
            out = store.create(place, False)
        except Exception:  # noqa: BLE001  any store's way to say that the file is there
            if not store.exists(place):
                raise
            data = _place(spark, f"{root}/data/{name}")[1]
            store.delete(data, True)
            continue
        out.write(bytearray(name.encode()))
        out.close()
        return version + 1
    raise RuntimeError(f"{root}: {tries} other writers came first")


def upserted(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """State with the rows of new in place of those of the same key."""
    return state.join(new.select(key), key, "left_anti").unionByName(new.select(*state.columns))


def completed(state: DataFrame, done: DataFrame) -> DataFrame:
    """Operations done before and now, each once, in order. Both: rel_path, ops."""
    rows = state.select("rel_path", "ops").union(done.select("rel_path", "ops")).select("rel_path", F.explode("ops").alias("op")).distinct()
    return rows.groupBy("rel_path").agg(F.array_sort(F.collect_list("op")).alias("ops"))


# ---- the classify cache


def cache_key(checksum: Column, articles: Column, categories: Column) -> Column:
    """F13."""
    return F.concat_ws("-", checksum, articles, categories)


def framed_digest(*parts: Column, digits: int = 12) -> Column:
    """The parts, each with its length in front, so that no two lists of parts have one rendering."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, digits)


def cached(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose key the cache has, with the answer it holds; and those that have to be asked. items: key. cache: key, answer."""
    joined = items.join(cache.select("key", F.struct("answer").alias("_hit")), "key", "left")
    return joined.where("_hit IS NOT NULL").withColumn("answer", F.col("_hit.answer")).drop("_hit"), joined.where("_hit IS NULL").drop("_hit")


def first_creators(ops: DataFrame) -> DataFrame:
    """What items classified in order (ord) would see: of equal paths the first create stays, later ones merge into it, and so do all into existing articles.

    ops: ord, path, action. The first creator of a path is an aggregate, so no item waits for another.
    """
    first = ops.where("action = 'create'").groupBy("path").agg(F.min("ord").alias("_first"))
    action = F.when((F.col("action") == "create") & (F.col("ord") > F.col("_first")), "merge").otherwise(F.col("action"))
    return ops.join(first, "path", "left").withColumn("action", action).drop("_first")


def frozen_categories(frozen: Sequence[str] | None, wanted: Sequence[str] | None) -> tuple[list[str], bool]:
    """The categories of a run, and whether it differs from those the base was made with. The first run's are kept; explicit ones win."""
    if not frozen:
        return list(wanted or CATEGORIES), False
    return list(wanted or frozen), bool(wanted) and list(wanted) != list(frozen)


# ---- lookups


def documents_from_paths(asked: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw documents by path, each once, and the paths refused with the reason. asked: path. raw: rel_path, checksum, size_bytes."""
    once = asked.where("path IS NOT NULL").select("path").distinct()
    joined = once.join(raw.select(F.col("rel_path").alias("path"), F.struct("checksum", "size_bytes").alias("_d")), "path", "left")
    reason = F.when(paths.normalised(F.col("path")).isNull(), "escapes_kb").when(F.col("_d").isNull(), "document_missing").when(~paths.is_raw(F.col("path")), "not_a_raw_document")
    judged = joined.withColumn("reason", reason)
    return judged.where("reason IS NULL").select(F.col("path").alias("rel_path"), "_d.checksum", "_d.size_bytes").orderBy("rel_path"), judged.where("reason IS NOT NULL").select(F.col("path").alias("ref"), "reason")


def looked_up(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """Path, status (ok, forbidden or not_found) and text of articles asked for by a path that may hold . and .. segments."""
    rows = asked.select("path", paths.normalised(F.col("path")).alias("_p"))
    joined = rows.join(articles.select(F.col("path").alias("_p"), F.struct("text").alias("_a")), "_p", "left")
    status = F.when(F.col("_p").isNull(), "forbidden").when(F.col("_a").isNull(), "not_found").otherwise("ok")
    return joined.select("path", status.alias("status"), F.col("_a.text").alias("text"))


def with_extractions(items: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their extraction, and an error row for each that has none that can be used. items: content_hash, source_ref. extractions: source_ref, summary."""
    joined = items.join(extractions.select("source_ref", F.struct("summary").alias("_e")), "source_ref", "left")
    why = F.when(F.coalesce("source_ref", F.lit("")) == "", "no source_ref").otherwise("no extraction")
    error = F.concat(F.lit("no usable extraction for '"), F.coalesce("source_ref", F.lit("")), F.lit("' ("), why, F.lit(")"))
    bad = joined.where("_e IS NULL").select("content_hash", F.lit("error").alias("status"), error.alias("error"), F.lit("extract").alias("phase"))
    return joined.where("_e IS NOT NULL").select("content_hash", "source_ref", "_e.summary"), bad


def selected_batches(answers: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of what the batches of a topic filter chose, each path once at its first mention, and how many mentions the catalog does not have.

    answers: batch, paths; null paths are an error, not an empty choice.
    """
    checked = answers.select("batch", F.coalesce("paths", F.raise_error(F.lit("topic filter returned no paths list")).cast("array<string>")).alias("paths"))
    rows = checked.select("batch", F.posexplode("paths").alias("pos", "path"))
    known = rows.join(catalog.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min(F.struct("batch", "pos")).alias("at"))
    dropped = rows.join(catalog.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
    return known.select("path", "at.batch", "at.pos"), dropped


def finished_items(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Items of which all articles are done, with how many failed: an item is reported once its count is full. results: item, error. expected: item, n."""
    done = results.groupBy("item").agg(F.count(F.lit(1)).alias("done"), F.count("error").alias("failed"))
    return expected.join(done, "item").where("done >= n").select("item", "n", "failed")


def free_slots(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests that may start: one active job a slug, and of several for one slug the first. jobs: slug, status. asked: slug, seq."""
    active = jobs.where(F.col("status").isin("pending", "running")).select("slug").distinct()
    return asked.join(active, "slug", "left_anti").groupBy("slug").agg(F.min("seq").alias("seq"))


def retry_schedule(calls: DataFrame, deadline: float, first: float = 10.0, most: int = 2) -> DataFrame:
    """When a failed call is tried again: waits of first * 2^n seconds, at most so many, none that would end after the deadline. calls: call_id, failed_at, retryable."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda n: F.struct(n.alias("n"), (F.col("failed_at") + first * (F.pow(F.lit(2.0), n + 1) - 1)).alias("at")))
    return calls.where("retryable").select("call_id", F.explode(tries).alias("t")).select("call_id", F.col("t.n").cast("int").alias("attempt"), F.col("t.at").alias("at")).where(F.col("at") <= deadline)


def with_missing(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with columns of older tables filled in: those that are not there, empty; null texts become ''."""
    for name, kind in columns.items():
        blank = F.lit("") if kind == "string" else F.lit(0).cast(kind)
        rows = rows.withColumn(name, F.coalesce(F.col(name), blank) if name in rows.columns else blank)
    return rows


def write_articles(spark: SparkSession, root: str, new: DataFrame, read_only: bool = False) -> int:
    """K2: a base's articles (path, text) with the new ones in place of those of the same path, as a new version; its number. Refused on a base that is only read."""
    if read_only:
        raise PermissionError("this knowledge base is read-only")
    return commit(spark, root, "path string, text string", lambda old: upserted(old, new, "path"))


def listed(bases: DataFrame, parent: str | None = None) -> DataFrame:
    """Derived bases that are shown: those compiled, of one parent on request. bases: slug, parent, compiled."""
    shown = bases.where("compiled")
    return shown if parent is None else shown.where(F.col("parent") == parent)
