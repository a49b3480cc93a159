"""Documents arriving as files, compiled in micro-batches: only new and changed ones are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.functions import text
from quillmill.operators import state


def arrivals(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of documents as a stream, at most so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def distinct_contents(docs: DataFrame, event_time: str, delay: str) -> DataFrame:
    """One of all equal texts that arrive within the delay; state goes with the watermark."""
    hashed = docs.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def compile_stream(docs: DataFrame, state_path: str, out_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Per batch, documents whose checksum the state does not have go through work. State and results are partitioned by
    batch and written by overwriting that partition, so a batch that is run again leaves the same tables.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = batch.withColumn("checksum", text.checksum(F.col("text"))).dropDuplicates(["rel_path", "checksum"])
        done = state.load(spark, state_path, "rel_path string, checksum string, batch int").where(F.col("batch") != number).select("rel_path", "checksum")
        fresh = sums.join(done, ["rel_path", "checksum"], "left_anti").persist()
        try:
            work(fresh).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
            fresh.select("rel_path", "checksum").write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        finally:
            fresh.unpersist()

    return docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Calls by kind and window, for the ledger's live view; late ones beyond the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
