"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is replaced, sources are
mixed to their targets, and what is left is packed into training sequences.

Each stage takes all rows that the one before kept, and all but the last return them with the columns they came with. The last
returns op5's columns and ids, the token ids of each piece (unsigned 32-bit, little-endian): sequence_id and offset say where
they go, packing.sequences() joins them. Defined results: a row with a null text stays as an empty text would, and its text
stays null until packing, where it gives the end id alone. Null doc_ids and sources are kept, repeated rows are near-duplicates
of each other, an empty table gives an empty result, and columns named like anything used inside pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import mixing, packing, pii, simhash, toxicity
from quillmill.llm.common import discard, materialise, table
from quillmill.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: a trained model, a tokenizer and connected components decide; tests/llm checks run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if hasattr(before, "_written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
