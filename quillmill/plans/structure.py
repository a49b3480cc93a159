"""Headers, lines, transcripts, sessions and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import chunking, lines
from quillmill.sources import extractions

from .registry import REL_PATH, query, raw_documents, table


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# "), "p_name", F.lit("\n## A\n```\n## in fence\n"), "p_type", F.lit("\n```\nafter\n## B\n~~~\n"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("text"))


_LINES = """
    a AS (SELECT p_partkey, '# ' || p_name || chr(10) || '## A' || chr(10) || '```' || chr(10) || '## in fence' || chr(10) || p_type || chr(10) || '```' || chr(10) || 'after' || chr(10) || '## B' || chr(10) || '~~~' || chr(10) || p_brand AS text FROM part),
    s AS (SELECT p_partkey, string_split(text, chr(10)) AS ls FROM a),
    l AS (SELECT p_partkey, unnest(range(len(ls)))::INT AS no, unnest(ls) AS line FROM s)"""


@query(rf"""
    WITH {_LINES}, f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l)
    SELECT p_partkey, no, (sum(fence::INT) OVER (PARTITION BY p_partkey ORDER BY no)) % 2 = 1 AND NOT fence AS inside FROM f""")
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fenced(lines.lines(_markdown(spark, sf_dir), "p_partkey"), "p_partkey").select("p_partkey", "no", "inside")


@query(f"WITH {_LINES} SELECT p_partkey, no, (sum((line LIKE '## %')::INT) OVER (PARTITION BY p_partkey ORDER BY no))::BIGINT AS section FROM l")
def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sections(lines.lines(_markdown(spark, sf_dir), "p_partkey"), "p_partkey").select("p_partkey", "no", "section")


@query(f"SELECT source, sha256(string_agg({REL_PATH} || ' ' || lang, chr(10) ORDER BY {REL_PATH})) AS digest, count(*) AS n FROM documents GROUP BY source")
def catalog_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_documents(spark, sf_dir).select("source", "rel_path", F.concat_ws(" ", "rel_path", "lang").alias("line"))
    return lines.digest(rows, "source", ["rel_path"], "line")


@query("SELECT lang, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, sum(strlen(text)) > 300000 AS needs_approval FROM documents GROUP BY lang")
def volume_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    docs = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").cast("long").alias("b"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("b").alias("bytes")).withColumn("needs_approval", F.col("bytes") > 300_000)


@query("""
    WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '---' || chr(10) || 'title: "' || p_name || '"' || chr(10) || '---' || chr(10) || '# Other' WHEN 1 THEN 'x' || chr(10) || '# ' || p_name || ' ' || chr(10)
                                           WHEN 2 THEN '<!-- c -->' || chr(10) || chr(10) || '---' || chr(10) || 'title: ' || p_type || chr(10) || '---' || chr(10) || 'b' ELSE 'plain' END AS t, p_name, p_type FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE 'p' || p_partkey END AS title, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 2 THEN p_type END AS declared, p_partkey % 4 = 0 AS strict FROM a""")
def article_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    body = (
        F.when(k == 0, F.concat(F.lit('---\ntitle: "'), "p_name", F.lit('"\n---\n# Other')))
        .when(k == 1, F.concat(F.lit("x\n# "), "p_name", F.lit(" \n")))
        .when(k == 2, F.concat(F.lit("<!-- c -->\n\n---\ntitle: "), "p_type", F.lit("\n---\nb")))
        .otherwise("plain")
    )
    stem = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    declared = text.header_field(text.document_frontmatter(body)[0], "title")
    return table(spark, sf_dir, "part").select("p_partkey", text.title(body, stem).alias("title"), declared.alias("declared"), (text.strict_frontmatter(body)[0] != "").alias("strict"))


@query("""
    WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f AS (SELECT conv_id, role, min(i) AS i FROM t GROUP BY ALL)
    SELECT conv_id, (SELECT count(*) FROM t WHERE t.conv_id = f.conv_id)::INT AS turns, string_agg(role, ',' ORDER BY i) AS speakers FROM f GROUP BY conv_id""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W8 over conversations written as transcripts."""
    said = F.concat(F.lit("**@"), "role", F.lit("** "), F.regexp_replace("text", r"\*\*@", "@"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["s"]), "\n")
    return rows.select("conv_id", F.size(chunking.speaker_turns(body)).alias("turns"), F.array_join(chunking.speakers(body), ",").alias("speakers"))


@query("""
    SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id""")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their messages, after a delete that cascades."""
    messages = table(spark, sf_dir, "conversations")
    gone = messages.select("conv_id").where("conv_id % 3 = 0").distinct()
    return messages.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


@query("""
    WITH o AS (SELECT doc_id, unnest(range(doc_id % 4)) AS op FROM documents)
    SELECT d.doc_id, count(op) AS total, coalesce(count_if(op % 2 = 0), 0)::BIGINT AS done, count(op) - coalesce(count_if(op % 2 = 0), 0)::BIGINT AS pending, count(op) - coalesce(count_if(op % 2 = 0), 0)::BIGINT = 0 AS compiled
    FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id""")
def ops_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each document, those done, and whether it counts as compiled."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    ops = docs.where("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4 - 1)).alias("op"))
    counted = ops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("op") % 2 == 0).alias("done"))
    out = docs.join(counted, "doc_id", "left").select("doc_id", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("done", F.lit(0).cast("long")).alias("done"))
    return out.withColumn("pending", F.col("total") - F.col("done")).withColumn("compiled", F.col("total") == F.col("done"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS prompt_tokens, CASE WHEN event_id % 3 = 2 THEN 0 ELSE CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END END + CASE WHEN event_id % 3 = 2 THEN event_id % 5 ELSE 0 END AS cached_tokens FROM events""")
def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    one = F.concat(F.lit('{"prompt_tokens": '), s(F.col("user_id")), F.lit(', "prompt_tokens_details": {"cached_tokens": '), s(e % 7), F.lit("}}"))
    other = F.concat(F.lit('{"prompt_tokens": '), s(F.col("user_id")), F.lit(', "cache_read_input_tokens": '), s(e % 5), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 3 == 0, "not json").when(e % 3 == 1, one).otherwise(other).alias("usage"))
    return extractions.usage(rows).select("event_id", "prompt_tokens", "cached_tokens")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'q' || doc_id || '|b|c' ELSE 'only' END AS asked FROM documents")
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    answer = F.when(d % 3 == 0, "sorry, no").when(d % 3 == 1, F.concat(F.lit('["q'), d.cast("string"), F.lit('", 4, "b", "c", "d"]'))).otherwise('["only"]')
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.string_list(answer), "|").alias("asked"))


@query(r"""
    WITH w AS (SELECT doc_id, length(text) AS total, list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS d, list_sort(d) AS ws FROM documents),
    t AS (SELECT doc_id, ws, floor(len(ws) / pow(2, k))::INT AS m FROM (SELECT *, unnest(range(0, 32)) AS k FROM w)),
    f AS (SELECT doc_id, max(m) AS kept FROM t WHERE m > 0 AND list_sum(list_transform(ws[1:m], lambda x: length(x) + 1)) - 1 <= 600 GROUP BY 1)
    SELECT doc_id, coalesce(kept, 0)::INT AS topics, least(total, greatest(600 - coalesce(list_sum(list_transform(ws[1:coalesce(kept, 0)], lambda x: length(x) + 1)), 0), 0))::INT AS summary_chars FROM w LEFT JOIN f USING (doc_id)""")
def fit_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    kept = chunking.fit_fields({"topics": (F.col("w"), True), "summary": (F.col("text"), False)}, 600)
    return table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w")).select("doc_id", F.size(kept["topics"]).alias("topics"), F.length(kept["summary"]).alias("summary_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own ' || doc_id ELSE 'raw head' END AS file_title FROM documents")
def backfilled_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """empty titles from the head of the raw file, read for those tasks only."""
    docs = table(spark, sf_dir, "documents")
    tasks_ = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("own "), F.col("doc_id").cast("string"))).otherwise("").alias("file_title"))
    heads = docs.select("doc_id", F.concat(F.lit("# raw head\n"), F.substring("text", 1, 4096)).alias("head")).join(tasks_.where("file_title = ''").select("doc_id"), "doc_id", "left_semi")
    found = heads.select("doc_id", text.title(F.col("head"), F.lit("?")).alias("t"))
    return tasks_.join(found, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("file_title", F.lit("")), "t").alias("file_title"))
