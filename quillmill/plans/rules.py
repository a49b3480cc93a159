"""State, lookups, predicates and small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths, text
from quillmill.operators import chunking, compose, retrieval, state, tasks
from quillmill.sources import extractions, raw, sinks

from .registry import REL_PATH, SUM16, query, raw_documents, table
from .served import _PEOPLE, _linked


def _s(c: Column) -> Column:
    return c.cast("string")


_D = F.col


# ---- state


@query("""
    SELECT doc_id, array_to_string(CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN ['extract', 'write'] ELSE ['extract'] END WHEN doc_id % 3 = 0 THEN ['classify', 'extract', 'write'] ELSE ['classify', 'extract'] END, ',') AS ops FROM documents""")
def completed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _s(_D("doc_id")).alias("rel_path"))
    before = docs.select("rel_path", F.when(_D("doc_id") % 4 == 0, F.array(F.lit("extract"))).otherwise(F.array(F.lit("extract"), F.lit("classify"))).alias("ops"))
    now = docs.where("doc_id % 3 = 0").select("rel_path", F.array(F.lit("write"), F.lit("extract")).alias("ops"))
    return state.completed(before, now).select(_D("rel_path").cast("long").alias("doc_id"), F.array_join("ops", ",").alias("ops"))


@query(f"""
    WITH i AS (SELECT doc_id, {SUM16} || '-a' || doc_id % 5 || '-' || lang AS key FROM documents),
    c AS (SELECT key, min('answer ' || doc_id) AS answer FROM i WHERE doc_id % 3 <> 0 AND doc_id % 5 < 3 GROUP BY key)
    SELECT doc_id, key, answer FROM i LEFT JOIN c USING (key)""")
def classify_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cache holds for each document's text, articles and categories; null where a model has to be asked. Equal texts share a key."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select("doc_id", state.cache_key(text.checksum(_D("text")), F.concat(F.lit("a"), _s(_D("doc_id") % 5)), _D("lang")).alias("key"))
    cache = items.where("doc_id % 3 <> 0 AND doc_id % 5 < 3").groupBy("key").agg(F.min(F.concat(F.lit("answer "), _s(_D("doc_id")))).alias("answer"))
    hit, miss = state.cached(items, cache)
    return hit.select("doc_id", "key", "answer").union(miss.select("doc_id", "key", F.lit(None).cast("string")))


@query("SELECT p_partkey, substr(sha256(strlen(p_name) || ':' || p_name || strlen(p_type) || ':' || p_type || '0:'), 1, 12) AS digest FROM part")
def prompt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return table(spark, sf_dir, "part").select("p_partkey", state.framed_digest(_D("p_name"), _D("p_type"), F.lit("")).alias("digest"))


@query("""
    WITH o AS (SELECT doc_id AS ord, 'wiki/concept/' || lang || doc_id % 30 || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 'merge' ELSE 'create' END AS action FROM documents)
    SELECT ord, path, CASE WHEN action = 'create' AND ord > min(CASE WHEN action = 'create' THEN ord END) OVER (PARTITION BY path) THEN 'merge' ELSE action END AS action FROM o""")
def serial_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    d = _D("doc_id")
    ops = table(spark, sf_dir, "documents").select(d.alias("ord"), F.concat(F.lit("wiki/concept/"), "lang", _s(d % 30), F.lit(".md")).alias("path"), F.when(d % 7 == 0, "merge").otherwise("create").alias("action"))
    return state.first_creators(ops).select("ord", "path", "action")


# ---- lookups

_ASKED = f"""
    asked AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'raw/../../' || doc_id WHEN 1 THEN 'raw/none' || doc_id || '.md' WHEN 2 THEN 'wiki/' || doc_id || '.md' ELSE {REL_PATH} END AS path, doc_id FROM documents)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = _D("doc_id") % 6, _s(_D("doc_id"))
    path = F.when(k == 0, F.concat(F.lit("raw/../../"), s)).when(k == 1, F.concat(F.lit("raw/none"), s, F.lit(".md"))).when(k == 2, F.concat(F.lit("wiki/"), s, F.lit(".md"))).otherwise(_D("rel_path"))
    return raw_documents(spark, sf_dir).select("doc_id", path.alias("path"))


@query(f"""
    WITH {_ASKED}
    SELECT path, CASE doc_id % 6 WHEN 0 THEN 'escapes_kb' WHEN 1 THEN 'document_missing' WHEN 2 THEN 'document_missing' ELSE 'ok' END AS status, CASE WHEN doc_id % 6 > 2 THEN (SELECT strlen(text) FROM documents d WHERE d.doc_id = asked.doc_id) END AS size_bytes FROM asked""")
def documents_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, O12."""
    held = raw_documents(spark, sf_dir).select("rel_path", F.lit("").alias("checksum"), F.octet_length("text").cast("long").alias("size_bytes"))
    good, bad = state.documents_from_paths(_asked(spark, sf_dir).select("path"), held)
    return good.select(_D("rel_path").alias("path"), F.lit("ok").alias("status"), "size_bytes").union(bad.select("ref", "reason", F.lit(None).cast("long")))


@query("""
    SELECT CASE p_partkey % 4 WHEN 0 THEN 'wiki/./a/../' || p_partkey WHEN 1 THEN '../' || p_partkey WHEN 2 THEN 'wiki/x' || p_partkey ELSE 'wiki/' || p_partkey END AS path,
        CASE p_partkey % 4 WHEN 1 THEN 'forbidden' WHEN 2 THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN p_partkey % 4 IN (0, 3) THEN p_name END AS text FROM part""")
def article_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4, S18."""
    k, s = _D("p_partkey") % 4, _s(_D("p_partkey"))
    path = F.when(k == 0, F.concat(F.lit("wiki/./a/../"), s)).when(k == 1, F.concat(F.lit("../"), s)).when(k == 2, F.concat(F.lit("wiki/x"), s)).otherwise(F.concat(F.lit("wiki/"), s))
    parts = table(spark, sf_dir, "part")
    return state.looked_up(parts.select(path.alias("path")), parts.select(F.concat(F.lit("wiki/"), s).alias("path"), _D("p_name").alias("text")))


@query(f"""
    WITH i AS (SELECT doc_id, 'h' || doc_id AS content_hash, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {REL_PATH} END AS ref FROM documents)
    SELECT content_hash, CASE WHEN ref IS NOT NULL AND doc_id % 4 <> 0 THEN 'about ' || doc_id END AS summary,
        CASE WHEN ref IS NULL THEN 'no usable extraction for '''' (no source_ref)' WHEN doc_id % 4 = 0 THEN 'no usable extraction for ''' || ref || ''' (no extraction)' END AS error FROM i""")
def item_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, U1."""
    docs = raw_documents(spark, sf_dir).select("doc_id", "rel_path")
    items = docs.select(F.concat(F.lit("h"), _s(_D("doc_id"))).alias("content_hash"), F.when(_D("doc_id") % 9 != 0, _D("rel_path")).alias("source_ref"))
    held = docs.where("doc_id % 4 <> 0").select(_D("rel_path").alias("source_ref"), F.concat(F.lit("about "), _s(_D("doc_id"))).alias("summary"))
    good, bad = state.with_extractions(items, held)
    none = F.lit(None).cast("string")
    return good.select("content_hash", "summary", none.alias("error")).union(bad.select("content_hash", none, "error"))


@query(f"""
    WITH c AS (SELECT doc_id // 10 AS batch, doc_id % 10 * 2 + k AS pos, CASE WHEN doc_id % 5 = 0 AND k = 1 THEN 'made/up' ELSE 'raw/' || (SELECT min(source) FROM documents) || '__' || (doc_id * (k + 1) % 150) || '.md' END AS path FROM (SELECT doc_id, unnest([0, 1]) AS k FROM documents)),
    f AS (SELECT path, min((batch, pos)) AS spot FROM c WHERE path IN (SELECT {REL_PATH} FROM documents) GROUP BY 1)
    SELECT path, spot[1] AS batch, spot[2]::INT AS pos FROM f""")
def topic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents' choices make a batch's answer."""
    docs = table(spark, sf_dir, "documents")
    d, first = _D("doc_id"), docs.agg(F.min("source").alias("s"))
    path = lambda k: F.concat(F.lit("raw/"), "s", F.lit("__"), _s(d * (k + 1) % 150), F.lit(".md"))
    mine = F.array(path(0), F.when(d % 5 == 0, "made/up").otherwise(path(1)))
    rows = docs.select("doc_id").crossJoin(F.broadcast(first)).select(F.floor(d / 10).alias("batch"), "doc_id", mine.alias("p"))
    answers = rows.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"])).alias("paths"))
    return state.selected_batches(answers, raw_documents(spark, sf_dir).select(_D("rel_path").alias("path")))[0]


@query("""
    WITH r AS (SELECT o_custkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error FROM orders WHERE o_orderstatus <> 'P'),
    e AS (SELECT o_custkey AS item, count(*) AS n FROM orders GROUP BY 1)
    SELECT item, n, count(error) AS failed FROM e JOIN r USING (item) GROUP BY item, n HAVING count(*) >= n""")
def finished_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers all of whose orders are through."""
    orders = table(spark, sf_dir, "orders")
    results = orders.where("o_orderstatus <> 'P'").select(_D("o_custkey").alias("item"), F.when(_D("o_orderstatus") == "F", "failed").alias("error"))
    return state.finished_items(results, orders.groupBy(_D("o_custkey").alias("item")).agg(F.count(F.lit(1)).alias("n")))


@query("""
    SELECT o_custkey AS slug, min(o_orderkey) AS seq FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15."""
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(_D("o_custkey").alias("slug"), F.when(_D("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"))
    return state.free_slots(jobs, orders.where("o_orderstatus <> 'P'").select(_D("o_custkey").alias("slug"), _D("o_orderkey").alias("seq")))


@query("""
    WITH e AS (SELECT event_id, user_id::DOUBLE AS t0 FROM events WHERE event_type = 'error')
    SELECT event_id AS call_id, n::INT AS attempt, t0 + 10 * (pow(2, n + 1) - 1) AS due FROM (SELECT *, unnest([0, 1]) AS n FROM e) WHERE t0 + 10 * (pow(2, n + 1) - 1) <= 60""")
def retry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    calls = table(spark, sf_dir, "events").select(_D("event_id").alias("call_id"), _D("user_id").cast("double").alias("failed_at"), (_D("event_type") == "error").alias("retryable"))
    return state.retry_schedule(calls, 60.0).withColumnRenamed("at", "due")


@query("SELECT p_partkey, p_name, p_brand, '' AS note, 0::BIGINT AS tries FROM part")
def widened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F40."""
    return state.with_missing(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), {"p_brand": "string", "note": "string", "tries": "long"})


# ---- predicates and formats


@query("""
    WITH p AS (SELECT doc_id, 'in/' || source || '__n' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.tar.docx' WHEN 3 THEN '' ELSE '.htm' END AS path FROM documents)
    SELECT doc_id, doc_id % 5 IN (0, 2, 4) AS rich, path || ',' || 'n' || doc_id || CASE WHEN doc_id % 5 = 2 THEN '.tar' ELSE '' END AS tokens,
        replace(path, '/', '__') || CASE WHEN doc_id % 5 = 1 THEN '' ELSE '.md' END AS flat FROM p""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7, P13, F28."""
    d = _D("doc_id")
    suffix = F.when(d % 5 == 0, ".PDF").when(d % 5 == 1, ".md").when(d % 5 == 2, ".tar.docx").when(d % 5 == 3, "").otherwise(".htm")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), "source", F.lit("__n"), _s(d), suffix).alias("path"))
    return rows.select("doc_id", paths.needs_conversion(_D("path")).alias("rich"), F.array_join(paths.source_tokens(_D("path")), ",").alias("tokens"), paths.flattened(_D("path")).alias("flat"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS stub, CASE WHEN p_partkey % 3 < 2 THEN '2024-0' || (1 + p_partkey % 9) END AS created, p_partkey % 6 = 1 AS transcript FROM part")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, F25."""
    k = _D("p_partkey")
    head = F.concat(F.lit("---\ncreated: 2024-0"), _s(1 + k % 9), F.lit("\nsource: "), F.when(k % 2 == 1, "meetings").otherwise("mail"), F.lit("\nartifact_kind: "), F.when(k % 3 == 1, "vc_note_transcript").otherwise("note"), F.lit("\n---\n"))
    page = F.when(k % 3 == 2, F.concat(F.lit(text.STUB_MARK), "p_name")).otherwise(F.concat(head, F.when(k % 3 == 0, F.lit("\n" + text.STUB_MARK + "\n")).otherwise(""), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_stub(page).alias("stub"), text.existing_created(page).alias("created"), text.is_transcript(text.split_frontmatter(page)[0]).alias("transcript"))


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE '<reference_material>' || chr(10) || role || chr(10) || '</reference_material>' || chr(10) || chr(10) || text END) AS digest FROM conversations")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32."""
    message = text.user_message(_D("text"), F.when(_D("turn") % 2 == 1, _D("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(message).alias("digest"))


@query(f"SELECT doc_id, (length({REL_PATH}) + 11 + length(text) + CASE WHEN text = '' THEN 0 ELSE 12 END + CASE WHEN doc_id % 2 = 0 THEN length('[\"' || lang || '\"]') + 17 ELSE 0 END)::INT AS size FROM documents")
def extraction_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    items = F.when(_D("doc_id") % 2 == 0, F.to_json(F.array("lang"))).otherwise("[]")
    return raw_documents(spark, sf_dir).select("doc_id", text.extraction_size(_D("rel_path"), {"summary": _D("text"), "action_items": items}).alias("size"))


@query("""
    WITH h AS (SELECT doc_id, strlen(text) <= 1000 AS whole, CASE WHEN strlen(text) <= 1000 THEN text ELSE substr(text, 1, list_max(list_filter(range(250, 1001), lambda n: strlen(substr(text, 1, n::INT)) <= 1000))::INT) END AS head FROM documents)
    SELECT doc_id, whole, strlen(head) AS bytes, md5(head) AS digest FROM h""")
def task_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many characters of a text as fit a thousand bytes."""
    head = text.head_of(_D("text"), 1000)
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") <= 1000).alias("whole"), head.alias("h"))
    return rows.select("doc_id", "whole", F.octet_length("h").cast("long").alias("bytes"), F.md5("h").alias("digest"))


@query("""
    SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading, lower(replace(p_type, ' ', '_')) AS field FROM part""")
def field_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    field = text.field_for(_D("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.heading_for(field).alias("heading"), field.alias("field"))


@query("""
    SELECT conv_id, turn, 'Title ' || conv_id AS name, '10:0' || turn % 10 || ' - 11:30' AS time, 'title: Title ' || conv_id || chr(10) || 'started at: 10:0' || turn % 10 || ' - 11:30' AS context, length(text)::INT + 2 AS rest FROM conversations""")
def transcript_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9."""
    body = F.concat(F.lit("# Title "), _s(_D("conv_id")), F.lit("\n\n> held 10:0"), _s(_D("turn") % 10), F.lit(" - 11:30\n\n"), F.lit("x "), F.regexp_replace("text", r"^\s+", "x"))
    name, time, rest = text.transcript_header(body)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), time.alias("time"), rest.alias("r"))
    return rows.select("conv_id", "turn", "name", "time", text.labelled_lines(title=_D("name"), started_at=_D("time"), note=F.lit("")).alias("context"), F.length("r").alias("rest"))


@query("""
    SELECT conv_id, turn, md5(substr(role || ' | ' || text || ' | ' || turn, 1, 60)) AS joined, md5(text) AS bare FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)""".replace("\\\\", "\\"))
def joined_and_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F22."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\n"))
    return rows.select("conv_id", "turn", F.md5(text.bounded_join(F.array("role", "text", _s(_D("turn"))), " | ", 60)).alias("joined"), F.md5(text.strip_fence(fenced)).alias("bare"))


@query("SELECT conv_id, '9:0' || min(turn) % 10 AS first, '1' || max(turn) % 10 || ':30:15' AS last FROM conversations GROUP BY conv_id")
def chunk_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    first, last = chunking.time_span(F.concat(F.lit("from 9:0"), _s(_D("a") % 10), F.lit(" over 77:777 and 9:59 to 1"), _s(_D("b") % 10), F.lit(":30:15.")))
    return rows.select("conv_id", first.alias("first"), last.alias("last"))


@query("SELECT p_partkey, p_name AS summary, p_type AS claims, p_brand AS topics FROM part")
def owned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers to each text, of which each owns a field."""
    parts = table(spark, sf_dir, "part")
    none = F.lit("not its own")
    rows = [("a", "p_name", None, None), ("b", None, "p_type", None), ("c", None, None, "p_brand")]
    answers = [parts.select("p_partkey", F.lit(g).alias("part"), *(F.col(v).alias(k) if v else none.alias(k) for k, v in zip(("summary", "claims", "topics"), vs, strict=True))) for g, *vs in rows]
    return compose.merge_groups(answers[0].union(answers[1]).union(answers[2]), "p_partkey", {"summary": "a", "claims": "b", "topics": "c"})


@query("""
    SELECT 'p' || p_partkey AS source, CASE WHEN p_partkey % 7 = 0 THEN 'unknown version' WHEN p_partkey % 5 = 0 THEN 'count of concepts disagrees' WHEN p_partkey % 3 = 0 THEN 'section claims missing' END AS reason FROM part""")
def intact_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the reason why they count as absent, null if none."""
    k = _D("p_partkey")
    answer = F.concat(F.lit('{"summary": "s", "topics": ["t"], "concepts": [{"title": "'), "p_brand", F.lit('"}]}'))
    rows = extractions.from_model(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), _s(k)).alias("source"), answer.alias("answer")))
    kind = dict(rows.dtypes)["claims"]
    rows = rows.withColumn("counts", extractions.counts())
    off = _D("counts").withField("concepts", F.lit(9))
    rows = rows.withColumns({"counts": F.when(k % 5 == 0, off).otherwise(_D("counts")), "claims": F.when(k % 3 != 0, _D("claims")).otherwise(F.lit(None).cast(kind)), "schema_version": F.when(k % 7 == 0, 1).otherwise(extractions.VERSION)})
    return rows.select("source", extractions.fault().alias("reason"))


@query("""
    WITH n AS (SELECT doc_id::VARCHAR AS name, sha256(text) AS h FROM documents), k AS (SELECT DISTINCT h FROM n WHERE name::BIGINT % 10 = 0),
    f AS (SELECT h, min(name) AS name FROM n WHERE h NOT IN (SELECT h FROM k) GROUP BY 1)
    SELECT n.name, f.name IS NOT NULL AS taken FROM n LEFT JOIN f ON f.name = n.name AND f.h = n.h""")
def submitted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    docs = table(spark, sf_dir, "documents").select(_s(_D("doc_id")).alias("name"), "text", "doc_id")
    known = docs.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct()
    good, bad = raw.submit(docs.select("name", "text"), known)
    return good.select("name", F.lit(True).alias("taken")).union(bad.select("name", F.lit(False)))


@query("""
    WITH f AS (SELECT doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.exe' ELSE '.txt' END AS name, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE strlen(text) * 100 END AS n, doc_id FROM documents)
    SELECT name, CASE WHEN doc_id % 4 = 2 THEN 'unsupported type' WHEN n > CASE WHEN doc_id % 4 = 1 THEN 10485760 ELSE 1048576 END THEN 'file too large' WHEN n = 0 THEN 'empty file' END AS reason FROM f""")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    d = _D("doc_id")
    suffix = F.when(d % 4 == 0, ".md").when(d % 4 == 1, ".PDF").when(d % 4 == 2, ".exe").otherwise(".txt")
    files = table(spark, sf_dir, "documents").select(F.concat(_s(d), suffix).alias("name"), F.when(d % 11 == 0, 0).otherwise(F.octet_length("text").cast("long") * 100).alias("size_bytes"))
    return raw.upload_verdicts(files).select("name", "reason")


@query(f"""
    WITH {_PEOPLE},
    m AS (SELECT canonical, count(*) AS n FROM links JOIN people ON alias = lower(link) GROUP BY 1)
    SELECT 'wiki/people/' || trim(regexp_replace(regexp_replace(lower(canonical), '[^\\p{{L}}\\p{{N}}\\s_-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-') || '.md' AS path, canonical AS title, n || CASE WHEN n = 1 THEN ' mention' ELSE ' mentions' END AS said FROM m""".replace("\\\\", "\\"))
def people_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, F26."""
    articles, people = _linked(spark, sf_dir)
    none = spark.range(0).select(F.lit("").alias("path"), F.lit(False).alias("is_stub"))
    stubs = retrieval.person_stubs(articles, people, none)
    return stubs.select("path", "title", F.regexp_extract("summary", r"^Person stub, (\d+ mentions?) in: ", 1).alias("said"))


@query("""
    SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN CASE event_type WHEN 'click' THEN 'delta' ELSE 'error' END END AS type FROM events""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as frames and read again."""
    kind = F.when(_D("event_type") == "click", "delta").when(_D("event_type") == "error", "error").otherwise(F.concat(F.lit("x"), "event_type"))
    lines = sinks.event_lines(table(spark, sf_dir, "events").select(kind.alias("type"), "event_id"))
    frames = lines.select(F.concat(F.lit(": ping\n\ndata: "), "value", F.lit("\n\n")).alias("value"))
    return sinks.parse_events(frames).select(F.get_json_object("d", "$.event_id").cast("long").alias("event_id"), "type")


@query("""
    WITH s AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'kb-' || c_nationkey WHEN 1 THEN '-kb' || c_nationkey WHEN 2 THEN 'KB' || c_nationkey ELSE 'new-' || c_custkey END AS slug FROM customer)
    SELECT slug, CASE WHEN NOT regexp_matches(slug, '^[a-z0-9][a-z0-9-]{0,39}$') THEN 'invalid' WHEN slug LIKE 'kb-%' THEN 'taken' ELSE 'free' END AS verdict FROM s""")
def slug_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36, S15."""
    k, n = _D("c_custkey"), _s(_D("c_nationkey"))
    slug = F.when(k % 4 == 0, F.concat(F.lit("kb-"), n)).when(k % 4 == 1, F.concat(F.lit("-kb"), n)).when(k % 4 == 2, F.concat(F.lit("KB"), n)).otherwise(F.concat(F.lit("new-"), _s(k)))
    asked = table(spark, sf_dir, "customer").select(slug.alias("slug")).distinct()
    taken = table(spark, sf_dir, "customer").select(F.concat(F.lit("kb-"), n).alias("slug"), F.lit(True).alias("t")).distinct()
    verdict = F.when(~text.is_slug(_D("slug")), "invalid").when(_D("t"), "taken").otherwise("free")
    return asked.join(taken, "slug", "left").select("slug", verdict.alias("verdict"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_size::VARCHAR, 'true'])), '|') AS topics, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END::VARCHAR, '') AS said FROM part")
def mixed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13, F4."""
    answer = F.parse_json(F.concat(F.lit('["'), "p_brand", F.lit('", '), _s(_D("p_size")), F.lit(', true, null, "'), "p_brand", F.lit('"]')))
    topics = text.sorted_topics(F.variant_get(answer, "$", "array<variant>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(topics, "|").alias("topics"), text.as_text(F.when(_D("p_partkey") % 2 == 0, _D("p_size"))).alias("said"))


@query("""
    SELECT conv_id, max(turn) AS updated_at, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id DESC LIMIT 50""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the sessions changed last, with their messages in order."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    newest = messages.groupBy("conv_id").agg(F.max("turn").alias("updated_at")).orderBy(F.desc("updated_at"), F.desc("conv_id")).limit(50)
    said = messages.join(newest, "conv_id").groupBy("conv_id", "updated_at").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return said.select("conv_id", "updated_at", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN '{\"n\":' || o_orderkey || '}' END AS result FROM orders")
def task_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tasks as they are shown; a result that is no JSON is left out."""
    result = F.when(_D("o_orderkey") % 3 == 0, F.concat(F.lit('{"n": '), _s(_D("o_orderkey")), F.lit("}"))).otherwise(F.concat(F.lit("{broken "), _s(_D("o_orderkey"))))
    return table(spark, sf_dir, "orders").select(_D("o_orderkey").alias("id"), _D("o_orderstatus").alias("status"), F.to_json(F.try_parse_json(result)).alias("result"))


@query(f"""
    WITH a AS (SELECT 'wiki/a' || doc_id % 20 || '.md' AS path, {REL_PATH} AS ref FROM documents)
    SELECT path, ref FROM a WHERE path IN ('wiki/a3.md', 'wiki/a7.md')""")
def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the articles a topic selected were made of."""
    articles = raw_documents(spark, sf_dir).select(F.concat(F.lit("wiki/a"), _s(_D("doc_id") % 20), F.lit(".md")).alias("path"), _D("rel_path").alias("ref"))
    picked = spark.range(2).select(F.concat(F.lit("wiki/a"), _s(_D("id") * 4 + 3), F.lit(".md")).alias("path"))
    return articles.join(picked, "path", "left_semi")


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 0 END::INT AS n, CASE WHEN p_partkey % 4 = 3 THEN 'not a list' END AS error FROM part""")
def loaded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    k = _D("p_partkey") % 4
    value = F.when(k == 0, " ").when(k == 1, F.concat(F.lit('["'), "p_brand", F.lit('", 4]'))).when(k == 2, "[]").otherwise(F.concat(F.lit('{"a": "'), "p_brand", F.lit('"}')))
    items, error = text.section_items(value)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(items.isNotNull(), F.size(items)).alias("n"), error.alias("error"))


@query("SELECT o_orderkey, '[write] wiki/' || o_custkey || ': ' || CASE WHEN o_orderstatus = 'F' THEN 'ALERT failed' ELSE o_orderkey % 1000 || '+' || o_orderkey % 77 || ' tokens, $' || printf('%.4f', (o_orderkey % 1000) / 16.0::DOUBLE) END AS line FROM orders")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    k = _D("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("write").alias("op"), F.concat(F.lit("wiki/"), _s(_D("o_custkey"))).alias("where"), k.alias("key"), (k % 1000).alias("prompt"), (k % 77).alias("completion"), ((k % 1000) / 16.0).alias("cost"), F.when(_D("o_orderstatus") == "F", "failed").alias("error")
    )
    lines = tasks.log_lines(rows.withColumn("target", F.concat("where", F.lit("#"), _s(_D("key")))))
    return lines.select(F.regexp_extract("target", r"#(\d+)$", 1).cast("long").alias("o_orderkey"), F.regexp_replace("line", r"#\d+:", ":").alias("line"))


@query("SELECT c_custkey AS slug FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey = 7")
def listed_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23."""
    bases = table(spark, sf_dir, "customer").select(_D("c_custkey").alias("slug"), _s(_D("c_nationkey")).alias("parent"), (_D("c_custkey") % 3 != 0).alias("compiled"))
    return state.listed(bases, "7").select("slug")


@query("""
    WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS renewed, p_name, p_type FROM part)
    SELECT 'wiki/' || p_partkey || '.md' AS path, CASE WHEN renewed THEN p_type ELSE p_name END AS text FROM p UNION ALL SELECT 'wiki/new' || p_partkey || '.md', p_type FROM p WHERE p_partkey % 5 = 0""")
def renewed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K6: what a new version of the articles holds."""
    k = _D("p_partkey")
    parts = table(spark, sf_dir, "part")
    path = lambda prefix: F.concat(F.lit(prefix), _s(k), F.lit(".md")).alias("path")
    old = parts.select(path("wiki/"), _D("p_name").alias("text"))
    new = parts.where(k % 3 == 0).select(path("wiki/"), _D("p_type").alias("text")).union(parts.where(k % 5 == 0).select(path("wiki/new"), _D("p_type").alias("text")))
    return state.upserted(old, new, "path")
