"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w, u from a hash of its id and w its quality weight; smaller keys come first.
Sources get targets by weight, each at most ``max_epochs`` times what it holds. A source whose target is e whole epochs and a
rest gives each document e times; the rest is filled with the documents of smallest keys, prefix-summed to the budget.

No source is ever sorted as a whole, so a source that holds a third of all rows is no bottleneck. The key at which a source's
budget ends is searched by zooming in: the range of its keys is cut into ``CUTS`` equal parts, their sizes are aggregated and
prefix-summed, and the part in which the budget ends is the next range, until it holds at most ``bucket_rows`` documents; only
those are put in order. This holds whatever the keys' distribution, takes about one pass for every factor of ``CUTS``, and
hands the driver one number a pass. What is kept per source is one row; windows over all sources run on such rows.

Defined results: a null text has size 0; a null source is a source of its own, after all others. Rows that agree in key and
id share one fate. Empty tables give empty results. Reruns agree, since keys depend on ids alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_chars, discard, materialise, words

CYCLE = (5.0, 2.0, 1.0)
CUTS = 4096


def quality_weight(text: Column) -> Column:
    """Less for texts full of symbols."""
    text = F.coalesce(text, F.lit(""))
    return 1 / (1 + 10 * count_chars(text, r"#*$%&|<>") / F.greatest(F.length(text), F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / w with u in (0, 1) from 48 bits of an MD5 of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**48)) / weight


def slim(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size and key: all that the mix is decided on."""
    df = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), (quality_weight(F.col("text")) if weight is None else weight).alias("_w"))
    return df.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("_w")).alias("key"))


def targets(rows: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """One row a source: source_size, n_rows, target, epochs (whole ones) and rest.

    The excess over a cap is reshared by weight until none is above. Sources sorted by cap over weight are capped in that
    order, so the level is found with running sums: a source is capped when its cap is at most its part of what those before
    it leave. Windows here run over one row a source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(x)) for x in cycle))
    per = per.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumns({
        "_left": F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "_weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("_level", F.when(F.col("cap") > F.col("weight") * F.col("_left") / F.col("_weights"), F.struct(F.col("_left").alias("left"), F.col("_weights").alias("weights"))))
    first = F.first("_level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("_first", first)
    target = F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("_first.left") / F.col("_first.weights"))
    per = per.withColumn("target", F.least(target, F.col("cap")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("epochs", epochs).select("source", "source_size", "n_rows", "target", "epochs", (F.col("target") - epochs * F.col("source_size")).alias("rest"))


def _of_sources(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of their source in per, a table, so that Spark can split the join at a large source."""
    return rows.join(per.withColumnRenamed("source", "_src"), rows["source"].eqNullSafe(F.col("_src"))).drop("_src")


def last_range(rows: DataFrame, per: DataFrame, bucket_rows: int = 512, cuts: int = CUTS) -> DataFrame:
    """Per source with a rest to fill: lo, hi, the keys between which its budget ends; base, the size of all documents before lo; and n, the documents from lo to hi."""
    known = materialise(per.where("rest > 0").select("source", "rest"))
    ends = materialise(_of_sources(rows, known).groupBy("source").agg(F.first("rest").alias("rest"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.lit(0.0).alias("base"), F.count(F.lit(1)).alias("n")))
    discard(known)
    before = Window.partitionBy("source").orderBy("part")
    while not ends.where((F.col("n") > bucket_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
        inside = _of_sources(rows, ends.drop("n")).where("key BETWEEN lo AND hi")
        part = F.least(F.floor((F.col("key") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * cuts), F.lit(cuts - 1))
        sums = inside.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).groupBy("source", "part").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("rest").alias("rest"), F.first("base").alias("base")
        )
        sums = sums.withColumn("upto", F.col("base") + F.sum("size").over(before))
        first = sums.where("upto >= rest").groupBy("source").agg(F.min_by(F.struct("rest", "lo", "hi", (F.col("upto") - F.col("size")).alias("base"), "n"), "part").alias("e"))
        old, ends = ends, materialise(first.select("source", "e.*"))
        discard(old)
    return ends


def thresholds(rows: DataFrame, per: DataFrame, bucket_rows: int = 512, cuts: int = CUTS) -> DataFrame:
    """per with lo, last_key and last_id: documents of keys below lo, or up to (last_key, last_id), fill the rest of the source's budget; last_key is null where lo says all.

    A document at which the sum passes the budget is taken if that brings the sum nearer to it.
    """
    ends = last_range(rows, per, bucket_rows, cuts)
    last = _of_sources(rows, ends).where("key BETWEEN lo AND hi")
    tied = last.groupBy("source", "key", "doc_id", "rest", "base").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id")) + F.col("base")
    # a prefix is kept while its last document lies with its middle below the budget
    fits = tied.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    best = fits.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    best = best.select("source", F.col("last.key").alias("last_key"), F.col("last.doc_id").alias("last_id"))
    return _beside(_beside(per, ends.select("source", "lo")), best)


def _beside(per: DataFrame, more: DataFrame) -> DataFrame:
    return per.join(more.withColumnRenamed("source", "_src"), per["source"].eqNullSafe(F.col("_src")), "left").drop("_src")


def copies(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with what thresholds() gives of their source, and ``copies``: how often the mix takes each."""
    upto_last = (F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & F.coalesce(F.col("doc_id") <= F.col("last_id"), F.col("doc_id").isNull()))
    chosen = F.coalesce((F.col("rest") > 0) & ((F.col("key") < F.col("lo")) | upto_last), F.lit(False))
    return _of_sources(rows, per).withColumn("copies", F.col("epochs") + chosen.cast("long"))


def decided(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the mix is decided on, and the decisions, one row a source."""
    rows = materialise(slim(docs))
    per = materialise(targets(rows))
    out = materialise(thresholds(rows, per))
    discard(per)
    return rows, out


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) of each document."""
    return copies(*decided(docs)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept. Decisions are joined by source, not by document."""
    rows, per = decided(docs)
    discard(rows)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "source", sampling_key(F.col("doc_id"), quality_weight(F.col("text"))).alias("key"))
    taken = copies(keyed, per).where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("_doc.*")
