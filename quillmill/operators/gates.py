"""What needs work and what has fallen behind: equi joins of metadata tables; contents are never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staleness(recorded: dict[str, Column], current: dict[str, Column]) -> Column:
    """The first field that differs, in the order given, or ''."""
    out = F.lit("")
    for name in reversed(list(current)):
        out = F.when(~recorded[name].eqNullSafe(current[name]), F.lit(f"{name} changed")).otherwise(out)
    return out


def extract_gate(raw: DataFrame, recorded: DataFrame, current: dict[str, Column]) -> DataFrame:
    """Every raw document with why it has to be extracted; '' if its extraction is fresh.

    raw: rel_path, checksum. recorded: rel_path, checksum and the fields of current.
    """
    held = recorded.select("rel_path", F.struct(*[c for c in recorded.columns if c != "rel_path"]).alias("r"))
    joined = raw.join(held, "rel_path", "left")
    now = {"checksum": F.col("checksum"), **current}
    return joined.withColumn("reason", F.when(F.col("r").isNull(), "missing").otherwise(staleness({k: F.col(f"r.{k}") for k in now}, now))).drop("r")


def compose_gate(raw: DataFrame, state: DataFrame) -> DataFrame:
    """Documents to compose again: new ones, changed ones, and those begun but not finished."""
    held = state.select("rel_path", F.col("checksum").alias("s_checksum"), "compiled_at", "completed_ops")
    why = (
        F.when(F.col("s_checksum").isNull(), "new")
        .when(F.col("s_checksum") != F.col("checksum"), "changed")
        .when((F.size("completed_ops") > 0) & F.col("compiled_at").isNull(), "unfinished")
    )
    return raw.join(held, "rel_path", "left").withColumn("why", why).where(F.col("why").isNotNull()).drop("s_checksum", "compiled_at", "completed_ops")


def lag(present: DataFrame, state: DataFrame, extract_version: str, write_version: str) -> DataFrame:
    """Of documents still present, whose recorded prompt versions are older. A version never recorded is not behind."""
    behind = lambda c, now: F.coalesce(F.col(c) != now, F.lit(False))
    return state.join(present.select("rel_path"), "rel_path", "left_semi").select("rel_path", behind("prompt_version", extract_version).alias("behind_extract"), behind("write_prompt_version", write_version).alias("behind_write"))


def check_extractions(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """Raw with verdict matches, missing or mismatched."""
    held = headers.select("rel_path", F.col("source_checksum"))
    verdict = F.when(F.col("source_checksum").isNull(), "missing").when(F.col("source_checksum") == F.col("checksum"), "matches").otherwise("mismatched")
    return raw.join(held, "rel_path", "left").withColumn("verdict", verdict).drop("source_checksum")


def check_parent(manifest: DataFrame, parent: DataFrame) -> DataFrame:
    """A derived base's documents against their parent: in_sync, changed or gone."""
    held = parent.select("rel_path", F.col("checksum").alias("p_checksum"))
    verdict = F.when(F.col("p_checksum").isNull(), "gone").when(F.col("p_checksum") == F.col("checksum"), "in_sync").otherwise("changed")
    return manifest.join(held, "rel_path", "left").select("rel_path", verdict.alias("verdict"))


def copy_guard(documents: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with an extraction of the same checksum, and warnings for the rest."""
    held = extractions.select("rel_path", "source_checksum")
    joined = documents.join(held, "rel_path", "left")
    same = F.coalesce(F.col("source_checksum") == F.col("checksum"), F.lit(False))
    warning = F.when(F.col("source_checksum").isNull(), "no extraction").otherwise("extraction is of another version")
    return joined.where(same).drop("source_checksum"), joined.where(~same).select("rel_path", warning.alias("warning"))
