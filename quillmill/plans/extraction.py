"""Documents to extractions, whatever their length: cut to prompts, routed, asked chunk by chunk, and folded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import chunking, compose
from quillmill.operators.tables import written
from quillmill.sources import extractions

from .model import ModelEndpoint, answered

FIELDS = ("summary", "topics", *extractions.LISTS)
#: Which fields each of two or three parallel prompts owns.
OWNERS = {
    1: {f: "A" for f in FIELDS},
    2: {**{f: "A" for f in ("concepts", "entities", "topics", "summary")}, **{f: "B" for f in ("claims", "decisions", "action_items", "enumerations")}},
    3: {**{f: "A" for f in ("concepts", "entities")}, **{f: "B" for f in ("claims", "summary", "topics")}, **{f: "C" for f in ("decisions", "action_items", "enumerations")}},
}
#: Fixed value: so many neighbouring summaries become one.
SECOND_LEVEL = 5


def kept(df: DataFrame) -> DataFrame:
    """What a model said is written before it is used twice."""
    return written(df)


def chunks(docs: DataFrame, limit: int = chunking.LIMIT, threshold: int = 3) -> DataFrame:
    """rel_path, no, chunk, n and route of every chunk. Transcripts are cut at turns, other texts at lines. docs: rel_path, text."""
    head, body = text.document_frontmatter(F.col("text"))
    context = text.labelled_lines(title=text.header_field(head, "title"), time=text.header_field(head, "time"))
    cut = F.when(text.is_transcript(head), chunking.chunk_transcript(body, context, limit)).otherwise(chunking.chunk_lines(F.col("text"), limit))
    rows = docs.select("rel_path", F.coalesce(cut, F.array(F.lit(""))).alias("c"))
    route = chunking.strategy(F.lit("auto"), F.size("c"), threshold)
    return rows.select("rel_path", F.size("c").alias("n"), route.alias("route"), F.posexplode("c").alias("no", "chunk"))


def _folded(parsed: DataFrame, joiner: str) -> DataFrame:
    """A5: a document's chunks as one extraction, in order; unreadable if one of them is. A document's chunks are bounded by its text."""
    rows = parsed.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("no", *FIELDS))).alias("r"), F.bool_or("bad_answer").alias("bad_answer"))
    said = F.filter(F.transform("r", lambda x: x["summary"]), lambda s: s != "")
    return rows.select(
        "rel_path",
        F.array_join(said, joiner).alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x["topics"])))).alias("topics"),
        *(F.flatten(F.transform("r", compose.field(f))).alias(f) for f in extractions.LISTS),
        "bad_answer",
    )


def chunked(rows: DataFrame, endpoint: ModelEndpoint) -> DataFrame:
    """M1, M6: each chunk asked for all fields. rows: rel_path, no, chunk."""
    answers = answered(rows.select("rel_path", "no", F.col("chunk").alias("text")), endpoint, "extract", ["rel_path", "no"], "rel_path string, no int")
    return _folded(extractions.from_model(answers), " ")


def _joined(summaries: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(summaries), lambda x: x["s"]), "\n---\n")


def summaries(rows: DataFrame, endpoint: ModelEndpoint) -> DataFrame:
    """M3, M4: rel_path, n (chunks that could be summarised), text: their summaries in order; many of them are first merged by fives,
    and a five that cannot be merged is joined as it is. A document all of whose chunks fail has no row."""
    said = answered(rows.select("rel_path", "no", F.col("chunk").alias("text")), endpoint, "summarize", ["rel_path", "no"], "rel_path string, no int")
    good = said.where("error IS NULL AND answer <> ''").select("rel_path", "no", F.col("answer").alias("s"))
    whole = kept(good.groupBy("rel_path").agg(F.count(F.lit(1)).cast("int").alias("n"), _joined(F.collect_list(F.struct("no", "s"))).alias("text")))
    plan = whole.select("*", chunking.fan_out(F.col("n"), F.length("text")).alias("p"))
    small = plan.where("NOT p.second_level").select("rel_path", "n", "text", F.col("p.groups").alias("groups"))
    large = plan.where("p.second_level").select("rel_path", "n", F.col("p.groups").alias("groups"))
    fives = good.join(large.select("rel_path"), "rel_path", "left_semi").groupBy("rel_path", F.floor(F.col("no") / SECOND_LEVEL).alias("five")).agg(_joined(F.collect_list(F.struct("no", "s"))).alias("text"))
    fives = kept(fives)
    merged = answered(fives, endpoint, "merge_summaries", ["rel_path", "five"], "rel_path string, five long")
    second = fives.join(merged, ["rel_path", "five"]).select("rel_path", F.col("five").alias("no"), F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.col("text")).alias("s"))
    folded = second.groupBy("rel_path").agg(_joined(F.collect_list(F.struct("no", "s"))).alias("text"))
    return small.unionByName(large.join(folded, "rel_path"))


def summarised(rows: DataFrame, endpoint: ModelEndpoint) -> DataFrame:
    """M2, M5: extraction from summaries, by one, two or three prompts that own fields each. A prompt that fails leaves its fields
    empty; a document of which all prompts or all summaries fail is unreadable."""
    parts = summaries(rows, endpoint).select("rel_path", "groups", F.col("text"), F.explode(F.slice(F.array(*map(F.lit, "ABC")), F.lit(1), F.col("groups"))).alias("part"))
    answers = answered(parts.select("rel_path", "groups", "part", "text"), endpoint, "extract_group", ["rel_path", "groups", "part"], "rel_path string, groups int, part string")
    parsed = kept(extractions.from_model(answers))
    out = None
    for k, owners in OWNERS.items():
        mine = compose.merge_groups(parsed.where(F.col("groups") == k), "rel_path", owners)
        out = mine if out is None else out.unionByName(mine)
    bad = parsed.groupBy("rel_path").agg(F.bool_and("bad_answer").alias("bad_answer"))
    read = rows.select("rel_path").distinct().join(out.join(bad, "rel_path"), "rel_path", "left")
    empty = {f.name: f.dataType for f in parsed.schema.fields}
    return read.select("rel_path", F.coalesce("summary", F.lit("")).alias("summary"), *(F.coalesce(f, F.array().cast(empty[f])).alias(f) for f in FIELDS[1:]), F.coalesce("bad_answer", F.lit(True)).alias("bad_answer"))


def extracted(docs: DataFrame, endpoint: ModelEndpoint, limit: int = chunking.LIMIT, threshold: int = 3) -> DataFrame:
    """rel_path, the fields of an extraction and bad_answer, of every document. docs: rel_path, text."""
    rows = kept(chunks(docs, limit, threshold))
    short = chunked(rows.where("route = 'chunked'"), endpoint)
    return short.unionByName(summarised(rows.where("route = 'summarize'"), endpoint))
