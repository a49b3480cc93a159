"""Queries of the Markdown extraction layer and of classification in waves."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators.tables import written
from quillmill.sources import extractions, markdown

from . import serial
from .compiled import _TITLES, _topics
from .registry import REL_PATH, SUM16, query, raw_documents


def _records(docs: DataFrame) -> DataFrame:
    """An extraction of each document: every line that is not blank is a claim, and the first two are concepts."""
    empty = {f.name: f.dataType for f in extractions.SCHEMA.fields}
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    made = {
        "source": F.col("rel_path"), "source_checksum": F.substring(text.checksum(F.col("text")), 1, 16), "extract_model": F.lit("m"), "prompt_version": F.lit("p1"), "extract_strategy": F.lit("chunked"),
        "summary": F.substring("text", 1, 300), "topics": F.array("source", "lang"), "claims": F.transform(lines, lambda x: F.struct(x.alias("claim"), F.lit(None).cast("string").alias("source"), (F.length(x) > 80).alias("surprising"))),
        "concepts": F.transform(F.slice(lines, 1, 2), lambda x: F.struct(F.substring(x, F.lit(1), F.lit(20)).alias("title"), x.alias("summary"))),
    }
    columns = [made.get(n, F.array().cast(kind) if kind.typeName() == "array" else F.lit(None).cast(kind)).alias(n) for n, kind in empty.items() if n != "counts"]
    return docs.select("doc_id", *columns)


@query(rf"""
    WITH d AS (SELECT doc_id, {REL_PATH} AS ref, {SUM16} AS sum16, substr(text, 1, 300) AS head, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
    m AS (SELECT doc_id, '---' || chr(10) || 'source: ' || to_json(ref)::VARCHAR || chr(10) || 'source_checksum: "' || sum16 || '"' || chr(10) || 'extract_model: "m"' || chr(10) || 'extract_strategy: "chunked"' || chr(10)
            || 'prompt_version: "p1"' || chr(10) || 'schema_version: 2' || chr(10) || 'summary: ' || to_json(head)::VARCHAR || chr(10) || 'topics: ' || to_json(list_sort([source, lang]))::VARCHAR || chr(10)
            || 'counts: {{"concepts":' || least(len(lines), 2) || ',"entities":0,"decisions":0,"action_items":0,"claims":' || len(lines) || ',"enumerations":0}}' || chr(10) || '---' || chr(10) AS header,
        chr(10) || '## Concepts' || chr(10) || chr(10) || CASE WHEN len(lines) = 0 THEN '[]' || chr(10) ELSE array_to_string(list_transform(lines[1:2], lambda x: '- {{"title":' || to_json(substr(x, 1, 20))::VARCHAR || ',"summary":' || to_json(x)::VARCHAR || '}}' || chr(10)), '') END
            || array_to_string(list_transform(['Entities', 'Decisions', 'Action Items'], lambda x: chr(10) || '## ' || x || chr(10) || chr(10) || '[]' || chr(10)), '')
            || chr(10) || '## Claims' || chr(10) || chr(10) || CASE WHEN len(lines) = 0 THEN '[]' || chr(10) ELSE array_to_string(list_transform(lines, lambda x: '- {{"claim":' || to_json(x)::VARCHAR || ',"surprising":' || (length(x) > 80)::VARCHAR || '}}' || chr(10)), '') END
            || chr(10) || '## Enumerations' || chr(10) || chr(10) || '[]' || chr(10) AS body FROM d)
    SELECT doc_id, strlen(header) AS header_bytes, strlen(header || body) AS n_bytes, md5(header || body) AS digest, md5(header || body) AS again, NULL::VARCHAR AS reason FROM m""")
def extraction_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's extraction as Markdown, parsed, and rendered again."""
    written = _records(raw_documents(spark, sf_dir)).select("doc_id", markdown.serialise().alias("content"))
    ends = F.instr("content", "\n---\n") + 4
    sized = written.select("doc_id", F.octet_length(F.substring(F.col("content"), F.lit(1), ends)).alias("header_bytes"), F.octet_length("content").alias("n_bytes"), F.md5("content").alias("digest"), "content")
    read = markdown.parse(sized)
    return read.select("doc_id", F.col("header_bytes").cast("long").alias("header_bytes"), F.col("n_bytes").cast("long").alias("n_bytes"), "digest", F.md5(markdown.serialise()).alias("again"), "reason")


class Rules:
    """Merges into the first article it is shown where the topics' letters say so, and else creates one of their name."""

    name = "rules-1"

    def complete(self, task: str, payload: dict) -> str:
        title = " ".join(payload["topics"])
        if len(title) % 3 == 0 and payload["catalog"]:
            return json.dumps({"merge_into": payload["catalog"][:1], "create_new": []})
        return json.dumps({"merge_into": [], "create_new": [{"path": f"wiki/concept/{hashlib.md5(title.encode()).hexdigest()[:12]}.md", "type": "concept", "title": title}]})


@query(rf"""
    WITH RECURSIVE {_TITLES},
    t AS (SELECT id, list(DISTINCT w) AS ws FROM x GROUP BY id),
    names AS (SELECT id, string_agg(w, ' ' ORDER BY r) AS title FROM w1 WHERE r <= 4 GROUP BY id),
    rel AS (SELECT a.id, b.id AS b, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS o FROM x a JOIN x b ON a.w = b.w AND b.id % 20 = 0 GROUP BY 1, 2),
    best AS (SELECT id, 'wiki/concept/d' || lpad(b::VARCHAR, 9, '0') || '.md' AS bp, o AS bo FROM rel QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC, b) = 1),
    items AS (SELECT doc_id // 6 AS g, doc_id % 6 AS wave, {REL_PATH} AS ref, coalesce(title, '') AS title, coalesce(ws, []) AS ws, bp, bo
              FROM documents LEFT JOIN t ON t.id = doc_id LEFT JOIN names ON names.id = doc_id LEFT JOIN best ON best.id = doc_id),
    r(g, wave, made, ref, action, path) AS (
        SELECT DISTINCT g, -1::BIGINT, []::STRUCT(path VARCHAR, ws VARCHAR[])[], '', '', '' FROM items
        UNION ALL
        SELECT g, wave, CASE WHEN action = 'create' THEN list_append(made, {{'path': path, 'ws': ws}}) ELSE made END, ref, action, path FROM (
            SELECT *, CASE WHEN shown THEN 'merge' WHEN into_path IS NOT NULL THEN 'merge' ELSE 'create' END AS action, CASE WHEN shown THEN first ELSE coalesce(into_path, 'wiki/concept/' || substr(md5(title), 1, 12) || '.md') END AS path FROM (
                SELECT *, length(title) % 3 = 0 AND first IS NOT NULL AS shown,
                    CASE WHEN len(ws) = 0 THEN NULL WHEN coalesce(bo, 0) >= 0.7 AND coalesce(bo, 0) >= coalesce(own.o, 0) THEN bp WHEN own.o >= 0.7 THEN own.path END AS into_path FROM (
                    SELECT i.*, r.made, coalesce(r.made[1].path, i.bp) AS first,
                        list_max(list_transform(list_filter(r.made, lambda c: len(c.ws) > 0 AND len(i.ws) > 0), lambda c, n: {{'o': len(list_intersect(c.ws, i.ws))::DOUBLE / least(len(c.ws), len(i.ws)), 'late': -n, 'path': c.path}})) AS own
                    FROM r JOIN items AS i ON i.g = r.g AND i.wave = r.wave + 1)))),
    owner AS (SELECT path, min(ref) AS owner FROM r WHERE action = 'create' GROUP BY path)
    SELECT ref AS rel_path, CASE WHEN action = 'create' AND ref <> owner THEN 'merge' ELSE action END AS action, path FROM r LEFT JOIN owner USING (path) WHERE wave >= 0""")
def serial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in groups of six, classified in waves; a twentieth of their titles are articles that were there."""
    docs = raw_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "rel_path")
    found = docs.join(_topics(spark, sf_dir, 4), "id").select("id", "rel_path", F.col("rel_path").alias("checksum"), F.col("tokens").alias("topics")).transform(written)
    there = found.where("id % 20 = 0").select(F.concat(F.lit("wiki/concept/d"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.array_join("topics", " ").alias("title"))
    groups = docs.select("rel_path", F.floor(F.col("id") / 6).alias("group_id"), (F.col("id") % 6).cast("int").alias("wave"))
    return serial.classify(found, there, Rules(), groups, shown=3).ops.select("rel_path", "action", "path")
