"""Classification in waves: clusters of like documents side by side, the members of one in order, so that each sees what those before it created."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import paths, text
from quillmill.operators import overlap, state

from .extraction import kept
from .model import ModelEndpoint, answered

_CLASSES = "merge_into ARRAY<STRING>, create_new ARRAY<STRUCT<path:STRING, type:STRING, title:STRING>>"
_MADE = "group_id long, seq long, path string, title string"


@dataclass
class Classified:
    ops: DataFrame  # rel_path, action, path, type, title
    rejects: DataFrame  # ref, reason
    cache: DataFrame  # key, answer: what was asked now


def clusters(found: DataFrame, threshold: float = 0.3, cap: int = 8) -> DataFrame:
    """rel_path, group_id and wave (the place in its group, from 0) of documents that share topics and concept titles. found: rel_path, topics, concepts."""
    names = F.concat(F.coalesce("topics", F.array().cast("array<string>")), F.coalesce(F.transform("concepts", lambda c: c["title"]), F.array().cast("array<string>")))
    tokens = F.array_distinct(F.filter(F.transform(names, F.lower), lambda x: x != ""))
    rows = kept(found.select("rel_path", tokens.alias("tokens")).orderBy("rel_path").withColumn("id", F.monotonically_increasing_id()))
    sets = rows.select("id", "tokens")
    grouped = overlap.cluster(overlap.overlap_pairs(sets.where(F.size("tokens") > 0), threshold), sets, cap).join(rows.select("id", "rel_path"), "id")
    wave = F.row_number().over(Window.partitionBy("group_id").orderBy("id")) - 1
    return kept(grouped.select("rel_path", "group_id", wave.alias("wave")))


def menus(found: DataFrame, existing: DataFrame, k: int) -> DataFrame:
    """rel_path and catalog, the paths of the k articles whose titles share most with a document's topics, most first; none for a document without any."""
    words = F.array_distinct(F.filter(F.flatten(F.transform("topics", text.title_words)), lambda w: w != ""))
    items = kept(found.select(F.xxhash64("rel_path").alias("id"), "rel_path", words.alias("tokens")).where(F.size("tokens") > 0))
    titles = kept(_numbered(existing))
    best = overlap.relevance(items.select("id", "tokens"), titles.select("id", "tokens").where(F.size("tokens") > 0), k)
    named = best.join(titles.select(F.col("id").alias("article_id"), "path"), "article_id").join(items.select(F.col("id").alias("item_id"), "rel_path"), "item_id")
    return named.groupBy("rel_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("catalog"))


def _numbered(existing: DataFrame) -> DataFrame:
    """id, path, tokens of articles, numbered by path."""
    return existing.select("path", text.title_words(F.col("title")).alias("tokens")).orderBy("path").withColumn("id", F.monotonically_increasing_id())


def inputs_hash(existing: DataFrame) -> str:
    """What the cache says of the articles that a classification saw: the same for the same paths and titles in any order."""
    r = existing.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "title")).alias("h"), F.sum(F.xxhash64("title", "path").cast("decimal(20,0)")).alias("s")).first()
    return f"{r.n:x}-{(r.h or 0) & (2**64 - 1):x}-{int(r.s or 0) & (2**64 - 1):x}"


def _asked(rows: DataFrame, endpoint: ModelEndpoint, cache: DataFrame) -> DataFrame:
    """key, answer, error of each key of rows (key, topics, catalog): from the cache, or asked once."""
    hits, misses = state.cached(rows, cache)
    once = misses.groupBy("key").agg(F.min_by(F.struct("topics", "catalog"), "rel_path").alias("p")).select("key", "p.*")
    said = answered(once, endpoint, "classify", ["key"], "key string")
    error = F.coalesce("error", F.when(F.try_parse_json("answer").isNull(), "unreadable answer"))
    return hits.select("key", "answer", F.lit(None).cast("string").alias("error")).distinct().union(said.select("key", "answer", error.alias("error")))


def _settled(creates: DataFrame, numbered: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """creates with ``into``: the article, there before or created by the group, whose title is the same by enough of its words. Of equal ones the earliest, those there before first."""
    wanted = kept(creates.withColumn("tokens", text.title_words(F.col("title"))).withColumn("new_id", F.xxhash64("rel_path", "n")))
    filled = wanted.where(F.size("tokens") > 0)
    before = overlap.best_matches(filled.select(F.col("new_id").alias("id"), "tokens"), numbered.select("id", "tokens").where(F.size("tokens") > 0), threshold)
    before = before.join(numbered.select(F.col("id").alias("match_id"), "path"), "match_id").select("new_id", F.struct("overlap", (-F.lit(0)).alias("late"), (-F.lit(0).cast("long")).alias("seq"), "path").alias("best"))
    own = made.select("group_id", "seq", F.col("path").alias("there"), text.title_words(F.col("title")).alias("other"))
    score = F.size(F.array_intersect("tokens", "other")) / F.least(F.size("tokens"), F.size("other"))
    beside = filled.join(own.where(F.size("other") > 0), "group_id").withColumn("overlap", score).where(F.col("overlap") >= threshold)
    beside = beside.select("new_id", F.struct("overlap", (-F.lit(1)).alias("late"), (-F.col("seq")).alias("seq"), F.col("there").alias("path")).alias("best"))
    best = before.union(beside).groupBy("new_id").agg(F.max("best").alias("best"))
    return wanted.join(best, "new_id", "left").select(*creates.columns, F.col("best.path").alias("into"))


def classify(found: DataFrame, existing: DataFrame, endpoint: ModelEndpoint, groups: DataFrame, cache: DataFrame | None = None, shown: int = 500, threshold: float = 0.7, categories: tuple[str, ...] = state.CATEGORIES) -> Classified:
    """Found (rel_path, checksum, topics) classified serially within groups (rel_path, group_id, wave), which run side by side.

    A wave takes one member of every group, so there are as many waves as the largest group has members, whatever the number of
    documents. A prompt shows the ``shown`` most relevant of the articles that were there, and all that the group has created so
    far. What is answered goes to the cache by checksum, articles and categories; an answer that the cache has is not asked for
    again. A title that an article has already, by enough of its words, merges into it. Documents that cannot be classified are
    rejected and create nothing. found may have documents whose groups lack: they are not classified.
    """
    spark = found.sparkSession
    found, existing = kept(found.select("rel_path", "checksum", "topics")), kept(existing.select("path", "title"))  # read again below, however they are made
    none = F.array().cast("array<string>")
    keyed = state.cache_key(F.col("checksum"), F.lit(inputs_hash(existing)), F.lit(",".join(categories)))
    key = F.when(F.coalesce("checksum", F.lit("")) == "", F.concat(F.lit("?"), "rel_path")).otherwise(keyed)  # without a checksum nothing is remembered
    rows = found.select("rel_path", key.alias("key"), F.coalesce("topics", none).alias("topics")).join(groups, "rel_path").join(menus(found, existing, shown), "rel_path", "left")
    rows = kept(rows.withColumn("catalog", F.coalesce("catalog", none)))
    numbered = kept(_numbered(existing))
    known = cache if cache is not None else spark.createDataFrame([], "key string, answer string")
    made = spark.createDataFrame([], _MADE)
    ops = rejects = asked = None
    last = rows.agg(F.max("wave")).first()[0]
    for wave in range(0 if last is None else int(last) + 1):
        own = made.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"]).alias("own"))
        now = rows.where(F.col("wave") == wave).join(own, "group_id", "left").withColumn("catalog", F.array_distinct(F.concat(F.coalesce("own", none), "catalog"))).drop("own")
        now = kept(now)
        answers = _asked(now, endpoint, known)
        new = kept(answers.where("error IS NULL AND NOT startswith(key, '?')").join(known.select("key"), "key", "left_anti").select("key", "answer"))
        known, asked = known.union(new), new if asked is None else asked.union(new)
        said = kept(now.join(answers, "key").select("rel_path", "group_id", F.from_json("answer", _CLASSES).alias("c"), "error"))
        merges = said.select("rel_path", F.explode("c.merge_into").alias("path")).select("rel_path", F.lit("merge").alias("action"), "path", paths.type_of(F.col("path")).alias("type"), paths.title_of(F.col("path")).alias("title"))
        creates = said.select("rel_path", "group_id", F.posexplode("c.create_new").alias("n", "x")).select("rel_path", "group_id", "n", "x.path", "x.type", "x.title")
        settled = kept(_settled(creates, numbered, made, threshold))
        made = made.union(settled.where("into IS NULL").select("group_id", (F.lit(wave * 1_000_000).cast("long") + F.col("n")).alias("seq"), "path", "title"))
        moved = F.col("into").isNotNull()
        here = merges.union(settled.select("rel_path", F.when(moved, "merge").otherwise("create").alias("action"), F.coalesce("into", "path").alias("path"), "type", "title"))
        bad = said.where("error IS NOT NULL").select(F.col("rel_path").alias("ref"), F.concat(F.lit("Error (Classify): "), "error").alias("reason"))
        ops, rejects = (here, bad) if ops is None else (ops.union(here), rejects.union(bad))
    if ops is None:
        ops, rejects, asked = spark.createDataFrame([], "rel_path string, action string, path string, type string, title string"), spark.createDataFrame([], "ref string, reason string"), known.limit(0)
    # across groups: of equal paths the first create stays a create; the rest merge into it
    first = ops.where(F.col("action") == "create").groupBy("path").agg(F.min("rel_path").alias("owner"))
    valid = paths.is_article(F.col("path"))
    again: Column = (F.col("action") == "create") & (F.col("rel_path") != F.col("owner"))
    once = ops.where(valid).join(first, "path", "left").withColumn("action", F.when(again, "merge").otherwise(F.col("action"))).select(*ops.columns)
    refused = ops.where(~F.coalesce(valid, F.lit(False))).select(F.col("rel_path").alias("ref"), F.lit("bad article path").alias("reason"))
    return Classified(kept(once), rejects.union(refused), asked)
