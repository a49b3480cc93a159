"""The composite pipelines: compiling a knowledge base, deriving a topic's subset, and answering from it.

Every phase reads tables and returns tables. Callers write the phase results they want to keep; what a model was asked for is
always materialised before it is used twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import catalog, chunking, compose, gates, overlap, retrieval, state

from . import extraction, merging, serial
from .extraction import kept as _kept
from .model import ModelEndpoint, answered


@dataclass
class KnowledgeBase:
    raw: DataFrame  # rel_path, text, checksum
    extractions: DataFrame  # rel_path, source_checksum, summary, topics, concepts ...
    articles: DataFrame  # path, title, type, text, sources
    catalog: DataFrame  # path, title, summary
    rejects: DataFrame  # ref, reason
    cache: DataFrame | None = None  # key, answer: what classification asked in this run


def extract(raw: DataFrame, endpoint: ModelEndpoint, known: DataFrame | None = None, prompt_version: str = "p1", limit: int = chunking.LIMIT) -> DataFrame:
    """Extractions of documents whose recorded one is missing or stale; the others keep theirs. Texts longer than a prompt are cut, and the answers folded."""
    todo = raw
    if known is not None:
        recorded = known.select("rel_path", F.col("source_checksum").alias("checksum"), F.col("prompt_version"), F.col("extract_model"))
        gated = gates.extract_gate(raw.select("rel_path", "checksum"), recorded, {"extract_model": F.lit(endpoint.name), "prompt_version": F.lit(prompt_version)})
        todo = raw.join(gated.where("reason <> ''").select("rel_path"), "rel_path", "left_semi")
    found = extraction.extracted(todo.select("rel_path", "text"), endpoint, limit)
    new = todo.select("rel_path", F.col("checksum").alias("source_checksum")).join(found, "rel_path")
    new = new.select("rel_path", "source_checksum", F.lit(endpoint.name).alias("extract_model"), F.lit(prompt_version).alias("prompt_version"), *extraction.FIELDS, "bad_answer")
    if known is None:
        return new
    return known.join(new.select("rel_path"), "rel_path", "left_anti").join(raw.select("rel_path"), "rel_path", "left_semi").select(*new.columns).unionByName(new)


def dedup_titles(ops: DataFrame, threshold: float = 0.7) -> DataFrame:
    """J10, W11 over the created titles: a title that overlaps an earlier one merges into its article."""
    created = ops.where("action = 'create'").select("path", "title").dropDuplicates(["path"])
    numbered = _kept(created.select(F.xxhash64("path").alias("id"), "path", text.title_words(F.col("title")).alias("tokens")))
    elected = overlap.elect(numbered.select("id", "tokens"), threshold=threshold)
    target = elected.join(numbered.select("id", "path"), "id").join(numbered.select(F.col("id").alias("merged_into"), F.col("path").alias("into")), "merged_into").where("NOT kept").select("path", "into")
    joined = ops.join(target, "path", "left")
    moved = F.col("into").isNotNull()
    return joined.select("rel_path", F.when(moved, "merge").otherwise(F.col("action")).alias("action"), F.coalesce("into", "path").alias("path"), "type", "title")


def write(ops: DataFrame, found: DataFrame, endpoint: ModelEndpoint, existing: DataFrame | None = None) -> DataFrame:
    """A3, A10, M8, M9: one article a path: a new one composed of all its documents, one that is there merged with them.

    existing: path, title, type, text, sources. Articles that no operation names stay as they are.
    """
    rows = ops.join(found.select("rel_path", "summary", "topics"), "rel_path").withColumn("ref", F.col("rel_path"))
    whole = _kept(compose.combine(rows, "path", ["rel_path"]))
    head = ops.groupBy("path").agg(F.min_by("title", F.struct(F.when(F.col("action") == "create", 0).otherwise(1), "rel_path")).alias("title"), F.min("type").alias("type"))
    fresh = whole if existing is None else whole.join(existing.select("path"), "path", "left_anti")
    made = answered(fresh.join(head, "path"), endpoint, "write", ["path", "title", "type", "refs"], "path string, title string, type string, refs array<string>")
    new = made.where("error IS NULL").select("path", "title", "type", text.strip_fence(F.col("answer")).alias("text"), F.col("refs").alias("sources"))
    if existing is None:
        return new
    merged = _kept(merging.merge_into_articles(existing.select("path", "text"), whole, endpoint))
    changed = existing.drop("text").join(merged.select("path", "text"), "path").join(whole.select("path", "refs"), "path")
    changed = changed.select("path", "title", "type", "text", F.array_union("sources", "refs").alias("sources"))
    return new.unionByName(changed).unionByName(existing.select(*new.columns).join(merged.select("path"), "path", "left_anti"))


def compile_kb(raw: DataFrame, endpoint: ModelEndpoint, known: DataFrame | None = None, existing: DataFrame | None = None, cache: DataFrame | None = None) -> KnowledgeBase:
    """raw: rel_path, text. Extraction, classification (serial within clusters of like documents), title dedup, writing and merging, and the catalog.

    existing: the articles there are (path, title, type, text, sources). cache: answers of earlier classifications (key, answer).
    """
    spark = raw.sparkSession
    raw = raw.select("rel_path", "text", text.checksum(F.col("text")).alias("checksum"))
    found = _kept(extract(raw, endpoint, known))
    titles = existing if existing is not None else spark.createDataFrame([], "path string, title string")
    readable = found.where("NOT bad_answer").withColumnRenamed("source_checksum", "checksum")
    done = serial.classify(readable, titles.select("path", "title"), endpoint, serial.clusters(readable), cache)
    articles = write(_kept(dedup_titles(done.ops)), found, endpoint, existing)
    body = text.split_frontmatter(F.col("text"))[1]
    entries = articles.select("path", "title", text.summary(F.lit(None).cast("string"), body, 150).alias("summary"))
    bad = found.where("bad_answer").select(F.col("rel_path").alias("ref"), F.lit("unreadable answer").alias("reason"))
    return KnowledgeBase(raw, found, articles, entries, done.rejects.unionByName(bad), done.cache)


_PARTS, _LINE_BUDGET = 64, 40_000


def _catalog_prompts(kb: KnowledgeBase) -> DataFrame:
    """The catalog as one row a batch of lines that fits a prompt; a line longer than that is cut to it."""
    line = F.substring(text.catalog_line(F.col("path"), F.col("title"), F.col("summary")), 1, _LINE_BUDGET - 1)
    lines = _kept(kb.catalog.select("path", line.alias("line"), F.pmod(F.xxhash64("path"), F.lit(_PARTS)).alias("part")))
    packed = chunking.pack_batches(lines, _LINE_BUDGET, "part", ["path"]).join(lines.select("path", "line"), "path")
    return packed.groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.array("path", "line"))).alias("catalog"))


def retrieve(kb: KnowledgeBase, questions: DataFrame, endpoint: ModelEndpoint, k: int = 6, per_prompt: int = 50) -> DataFrame:
    """Question, rank, path, title of each question, asked once however often it is there.

    Every question reads the whole catalog, ``per_prompt`` of them at once: a prompt has a block of questions and as much of the
    catalog as fits, and its answer a list of paths for each. A prompt that fails chooses nothing.
    """
    once = questions.where("question IS NOT NULL").select("question").distinct()
    count = once.count()
    blocks = once.groupBy(F.pmod(F.xxhash64("question"), F.lit(max(1, -(-count // per_prompt)))).alias("block")).agg(F.array_sort(F.collect_list("question")).alias("questions"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))))
    prompts = _kept(blocks.join(_catalog_prompts(kb), "part").select("block", (F.col("part") * 1_000_000 + F.col("batch")).alias("batch"), "questions", "catalog", F.lit(k).alias("k")))
    answers = answered(prompts, endpoint, "select", ["block", "batch"], "block long, batch long")
    said = _kept(prompts.select("block", "batch", "questions").join(answers, ["block", "batch"]).select("batch", "questions", F.from_json("answer", "array<array<string>>").alias("lists")))
    none = F.array().cast("array<string>")
    chosen = said.select("batch", F.posexplode("questions").alias("i", "question"), "lists").select("batch", "question", F.coalesce(F.get("lists", F.col("i")), none).alias("paths"))
    merged = chosen.groupBy("question").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "paths"))), lambda x: x["paths"])).alias("paths"))
    return retrieval.titled(catalog.selected(merged, kb.catalog, k), kb.catalog)


def rewrite(questions: DataFrame, endpoint: ModelEndpoint) -> DataFrame:
    """Questions (question, history) with asked, what they say without their history. Without history that is the question, and no model is called; so too where a call fails."""
    blank = F.coalesce(F.trim("history"), F.lit("")) == ""
    answers = answered(questions.where(~blank).select("question", "history").distinct(), endpoint, "rewrite", ["question", "history"], "question string, history string")
    said = answers.where("error IS NULL AND trim(answer) <> ''").select("question", "history", F.trim("answer").alias("asked"))
    return questions.join(said, ["question", "history"], "left").withColumn("asked", F.coalesce("asked", "question"))


def ask(kb: KnowledgeBase, questions: DataFrame, endpoint: ModelEndpoint) -> tuple[DataFrame, DataFrame]:
    """Answers (question, text) and their citations. questions: question, and history if there is one. A question that is there several times is answered once for each history it has."""
    if "history" in questions.columns:
        asked = _kept(rewrite(questions.select("question", "history").distinct(), endpoint).select("question", "asked").distinct())
    else:
        asked = _kept(questions.select("question", F.col("question").alias("asked")).distinct())
    hits = retrieve(kb, asked.select(F.col("asked").alias("question")), endpoint)
    found = _kept(asked.join(hits.withColumnRenamed("question", "asked"), "asked"))
    context = found.groupBy("question", "asked").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "title"))).alias("a"))
    none = F.array().cast("array<struct<rank:int,path:string,title:string>>")
    rows = asked.join(context, ["question", "asked"], "left").select("question", "asked", F.transform(F.coalesce("a", none), lambda x: F.array(x["path"], x["title"])).alias("articles"))
    answers = answered(rows, endpoint, "answer", ["question", "asked"], "question string, asked string").select("question", F.col("answer").alias("text"))
    return answers, retrieval.citations(answers, found.select("path", "title").distinct(), ["question"])


#: What a pass over a catalog asks for: whatever could contribute to a topic, or only what is about it.
RECALL, PRECISION = "recall", "precision"


def on_topic(kb: KnowledgeBase, topic: str, endpoint: ModelEndpoint, mode: str = RECALL) -> tuple[DataFrame, DataFrame]:
    """The catalog's paths of a topic in order of mention, and how many were made up. All that any prompt chose counts; a prompt without an answer is an error, since a selection that is empty by mistake would lose everything."""
    if mode not in (RECALL, PRECISION):
        raise ValueError(f"unknown filter mode: {mode!r}")
    rows = _catalog_prompts(kb).select((F.col("part") * 1_000_000 + F.col("batch")).alias("batch"), F.lit(topic).alias("question"), F.lit(mode).alias("mode"), "catalog")
    answers = answered(rows, endpoint, "filter", ["batch"], "batch long")
    return state.selected_batches(answers.select("batch", F.from_json("answer", "array<string>").alias("paths")), kb.catalog)


def derive(kb: KnowledgeBase, topic: str, endpoint: ModelEndpoint) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents behind the articles that could contribute to a topic, those copied with a matching extraction, and what was skipped."""
    chosen = on_topic(kb, topic, endpoint, RECALL)[0]
    picked = kb.articles.join(chosen.select("path"), "path", "left_semi")
    refs = catalog.resolve_documents(picked, kb.raw)
    docs = kb.raw.join(refs.where("status = 'ok'").select(F.col("ref").alias("rel_path")), "rel_path", "left_semi")
    copied, warnings = gates.copy_guard(docs, kb.extractions)
    skipped = refs.where("status <> 'ok'").select("ref", F.col("status").alias("reason")).unionByName(warnings.select(F.col("rel_path").alias("ref"), F.col("warning").alias("reason")))
    return docs, copied, skipped


def focus(kb: KnowledgeBase, topic: str, endpoint: ModelEndpoint) -> tuple[DataFrame, DataFrame]:
    """Of a derived base the catalog entries that are about its topic, and those that are not: its documents all came from the topic, so this pass asks narrowly."""
    keep = _kept(on_topic(kb, topic, endpoint, PRECISION)[0])
    return kb.catalog.join(keep.select("path"), "path", "left_semi"), prune(kb, keep)


def prune(kb: KnowledgeBase, keep: DataFrame) -> DataFrame:
    """Articles off topic: catalog entries without a place in keep."""
    return catalog.off_topic(kb.catalog, keep)
