"""The extraction layer: one record a document, its provenance and its integrity check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
LISTS = ("concepts", "entities", "decisions", "action_items", "claims", "enumerations")
_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()


def _structs(*names: str, **other: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, other.get(n, _S)) for n in names]))


_FIELDS: dict[str, T.DataType] = {
    "source": _S,
    "source_checksum": _S,
    "extract_model": _S,
    "extract_strategy": _S,
    "prompt_version": _S,
    "extracted_at": T.TimestampType(),
    "schema_version": _I,
    "summarize_model": _S,
    "summary": _S,
    "topics": T.ArrayType(_S),
    "concepts": _structs("title", "summary"),
    "entities": _structs("name", "type", "context"),
    "decisions": _structs("title", "what", "why", "who", who=T.ArrayType(_S)),
    "action_items": _structs("task", "owner"),
    "claims": _structs("claim", "source", "surprising", surprising=_B),
    "enumerations": _structs("name", "kind", "ordered", "items", ordered=_B, items=T.ArrayType(_S)),
    "counts": T.StructType([T.StructField(k, _I) for k in LISTS]),
}
SCHEMA = T.StructType([T.StructField(k, v) for k, v in _FIELDS.items()])
HEADER = [f.name for f in SCHEMA.fields[:8]]


def from_model(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Model output (JSON) read with tolerance: what is missing is empty, extra keys go, bare strings may stand for concepts, and topics that are no strings are dropped."""
    v = F.try_parse_json(column)
    fields = {f.name: f.dataType for f in SCHEMA.fields}
    out = answers.withColumn("_v", v).withColumn("_topics", F.expr("try_variant_get(_v, '$.topics', 'array<variant>')")).withColumn("_concepts", F.expr("try_variant_get(_v, '$.concepts', 'array<variant>')"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    topics = F.transform(F.filter(F.coalesce("_topics", F.array().cast("array<variant>")), is_text), lambda x: x.cast("string"))
    concept = lambda x: F.when(is_text(x), F.struct(x.cast("string").alias("title"), F.lit(None).cast("string").alias("summary"))).otherwise(F.try_variant_get(x, "$", "struct<title:string,summary:string>"))
    named = {
        "summary": F.coalesce(F.expr("try_variant_get(_v, '$.summary', 'string')"), F.lit("")),
        "topics": F.array_sort(F.array_distinct(topics)),
        "concepts": F.filter(F.transform(F.coalesce("_concepts", F.array().cast("array<variant>")), concept), lambda c: c["title"].isNotNull()),
    }
    for k in LISTS[1:]:
        named[k] = F.coalesce(F.expr(f"try_variant_get(_v, '$.{k}', '{fields[k].simpleString()}')"), F.array().cast(fields[k]))
    return out.withColumns(named).withColumn("bad_answer", F.col("_v").isNull()).drop("_v", "_topics", "_concepts")


def counts() -> Column:
    return F.struct(*(F.size(k).alias(k) for k in LISTS))


def persist(extractions: DataFrame, path: str) -> None:
    """K1: written as a whole by the committer, topics sorted, counts recorded."""
    whole = extractions.withColumns({"topics": F.array_sort("topics"), "schema_version": F.lit(VERSION), "counts": counts()})
    whole.select(*SCHEMA.fieldNames()).write.mode("overwrite").parquet(path)


def fault() -> Column:
    """Why a record is not intact, null if it is: an unknown version, a section missing, or one whose count disagrees."""
    reason = F.when(~F.col("schema_version").eqNullSafe(VERSION), "unknown version")
    for k in LISTS:
        reason = reason.when(F.col(k).isNull(), f"section {k} missing").when(~F.size(k).eqNullSafe(F.col(f"counts.{k}")), f"count of {k} disagrees")
    return reason


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Intact extractions, and the others with a reason. A record that fails counts as absent, never as empty."""
    judged = spark.read.schema(SCHEMA).parquet(path).withColumn("reason", fault())
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select("source", "reason")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The provenance alone: other columns are never read."""
    return spark.read.schema(SCHEMA).parquet(path).select(*HEADER)


def replace(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Overwrite by key: what is new, and what it does not replace."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def usage(responses: DataFrame, column: str = "usage") -> DataFrame:
    """token counts from either provider's dialect."""
    rows = responses.withColumn("_u", F.try_parse_json(column))
    get = lambda *ks: F.coalesce(*(F.expr(f"nullif(try_variant_get(_u, '$.{k}', 'bigint'), 0)") for k in ks), F.lit(0))
    return rows.withColumns({
        "prompt_tokens": get("prompt_tokens"), "completion_tokens": get("completion_tokens"),
        "cached_tokens": get("prompt_tokens_details.cached_tokens", "cache_read_input_tokens"),
        "cache_created_tokens": get("prompt_tokens_details.cache_creation_tokens", "cache_creation_input_tokens"),
    }).drop("_u")
