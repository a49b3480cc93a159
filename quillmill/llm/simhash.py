"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: XXH64 of every three-word shingle, bits by majority, in numpy over Arrow batches; a narrow pass. From there on
only distinct fingerprints (8 bytes each) are shuffled.

Pigeonring: the 64 bits form a ring of m segments. If two fingerprints differ in at most k bits, some segment starts a chain
in which, for every length l, the first l segments together differ in at most l * k / m bits. While l * k < m that budget is
below one bit, so the chain's first c = ceil(m / k) - 1 segments must agree exactly: they are the join key. Candidates must
pass the longer prefixes of the chain before their full Hamming distance is taken.

A bucket of at most ``small`` fingerprints compares its pairs, at most small / 2 a row. In a larger bucket, pairs would grow
with the square, so links are found by meeting points instead: fingerprints within two bits share a value that is at most one
bit from either, hence each row emits itself and its 64 one-bit neighbours and all who meet at a value are linked to the
least of them. That is exact, linear, and costs about what pairs cost at the limit. No bucket is capped.

Defined results: a null text has no word and fingerprint 0, as any text without words, and is linked like any other. Fewer
than three words make one shingle. Repeated rows share a component. An empty table gives an empty result. Rows with a null
doc_id get a component like any other; component_id is null only if a component has no other id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components

RADIUS = 2
SEGMENTS = 16


def fingerprint(text: str, size: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, split at ASCII white space
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(s, seed) for s in shingles])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 * block):
        part = np.frombuffer(hashes[at : at + 8 * block], np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named and fp, the fingerprint as a signed long."""
    kept = list(kept)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(len(kept)).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*kept, "fp"])

    return docs.select(*kept, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{schema}, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _chain_mask(start: int, length: int, segments: int) -> int:
    """The bits of ``length`` segments from ``start`` on, around the ring."""
    width = 64 // segments
    return _signed(sum(((1 << width) - 1) << (width * ((start + i) % segments)) for i in range(length)))


def _exact_length(segments: int, radius: int) -> int:
    return -(-segments // radius) - 1


def chains(distinct: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(start, key, fp): a row for each start of a chain; key has the bits that must agree exactly."""
    exact = _exact_length(segments, radius)
    rows = F.array(*(F.struct(F.lit(s).cast("byte").alias("start"), F.col("fp").bitwiseAND(F.lit(_chain_mask(s, exact, segments))).alias("key")) for s in range(segments)))
    return distinct.select("fp", F.explode(rows).alias("c")).select("c.start", "c.key", "fp")


def _within(start: Column, differing: Column, segments: int, radius: int) -> Column:
    """Pigeonring: every longer prefix of the chain keeps to its part of the budget; then the full distance."""
    ok = F.lit(True)
    for length in range(_exact_length(segments, radius) + 1, segments):
        if (length * radius) // segments == ((length + 1) * radius) // segments and length + 1 < segments:
            continue  # a longer prefix has the same budget and implies this one
        masks = F.array(*(F.lit(_chain_mask(s, length, segments)) for s in range(segments)))
        ok = ok & (F.bit_count(differing.bitwiseAND(F.get(masks, start.cast("int")))) <= length * radius // segments)
    return ok & (F.bit_count(differing) <= radius)


def links(distinct: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, small: int = 64) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of "at most two bits differ"."""
    if radius != 2:
        raise ValueError("meeting points are made for a radius of 2")
    rows = materialise(chains(distinct, segments, radius))
    sizes = materialise(rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # tables: Spark can split a join with them
    counted = materialise(rows.join(sizes, ["start", "key"]))
    discard(rows, sizes)
    few = counted.where(F.col("n") <= small).select("start", "key", "fp")
    a, b = few.withColumnRenamed("fp", "u"), few.withColumnRenamed("fp", "v")
    near = (F.col("v") < F.col("u")) & _within(F.col("start"), F.col("u").bitwiseXOR(F.col("v")), segments, radius)
    pairs = a.join(b, ["start", "key"]).where(near).select("u", "v")
    many = counted.where(F.col("n") > small).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    met = materialise(many.select("fp", F.explode(around).alias("at")))
    least = materialise(met.groupBy("at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "v"))
    meeting = met.join(least, "at").where("fp <> v").select(F.col("fp").alias("u"), "v")
    out = materialise(pairs.union(meeting).distinct())
    discard(counted, met, least)
    return out


def roots_of(prints: DataFrame, segments: int = SEGMENTS, small: int = 64) -> DataFrame:
    """(fp, root) for every distinct fingerprint of prints; root is the same for all that links join."""
    distinct = materialise(prints.select("fp").distinct())
    edges = links(distinct, segments, small=small)
    roots = connected_components(edges)
    discard(edges)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, segments: int = SEGMENTS, small: int = 64) -> DataFrame:
    """prints: doc_id and fp, materialised. Adds component_id, the least doc_id that links reach."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = materialise(first.join(roots_of(prints, segments, small), "fp"))
    least = materialise(joined.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, as it was: that of the least doc_id, null last; of rows alike in id and text, one. Texts are shuffled once."""
    mark, n = _unused(docs, "_text_hash"), _unused(docs, "_alike")
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    prints = materialise(fingerprints(keyed, ("doc_id", mark)))
    alike = prints.groupBy("fp", "doc_id", mark).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(mark).alias("h"), "n")
    first = materialise(alike.groupBy("fp").agg(F.min(order).alias("first")).join(roots_of(prints), "fp"))
    stay = materialise(first.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.id").alias("_id"), F.col("f.h").alias("_h"), F.col("f.n").alias(n)))
    discard(prints, first)
    found = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed[mark] == stay["_h"])).select(*(keyed[f"`{c}`"] for c in keyed.columns), n)
    many = F.col(n) > 1
    out = found if stay.where(many).isEmpty() else found.where(~many).union(found.where(many).dropDuplicates(["doc_id", mark]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    found = classes(materialise(fingerprints(docs)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


assert sys.byteorder == "little"
