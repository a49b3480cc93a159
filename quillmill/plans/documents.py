"""Scans, gates and checks over raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths, text
from quillmill.operators import catalog, compose, gates

from .registry import REL_PATH, SUM16, query, raw_documents, table


@query(f"SELECT {REL_PATH} AS rel_path, {SUM16} AS checksum, strlen(regexp_replace(text, '\\r\\n?', chr(10), 'g'))::BIGINT AS size_bytes FROM documents")
def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.newline_normalised(F.col("text"))
    return raw_documents(spark, sf_dir).select("rel_path", text.checksum(F.col("text")).alias("checksum"), F.octet_length(norm).cast("long").alias("size_bytes"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS keep_doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.duplicates(table(spark, sf_dir, "documents"), F.col("text"))


@query(rf"""
    WITH d AS (SELECT {REL_PATH} AS path, source || '__' || doc_id AS title, source || ' · ' AS prefix,
            coalesce(list_filter(list_transform(string_split(text, E'\n\n'), lambda b: array_to_string(list_filter(string_split(b, E'\n'), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^#{{1,6}}\s')), ' ')), lambda b: b <> '')[1], '') AS para
        FROM documents),
    f AS (SELECT *, trim(regexp_replace(para, '\s+', ' ', 'g')) AS flat, 200 - length(prefix) AS room FROM d),
    c AS (SELECT *, substr(flat, 1, room) AS head FROM f)
    SELECT path, title, prefix || CASE WHEN length(flat) <= room THEN flat WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) || '…' ELSE head END AS summary FROM c""")
def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_documents(spark, sf_dir).select("rel_path", F.col("source").alias("context"), "text", F.lit(None).cast("string").alias("declared"))
    return catalog.document_catalog(docs)


@query(r"SELECT p_partkey, trim(substr(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug FROM part")
def slug_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).select("doc_id", "rel_path", "source", text.checksum(F.col("text")).alias("checksum"))


@query(rf"""
    WITH raw AS (SELECT doc_id, {REL_PATH} AS rel_path, {SUM16} AS checksum FROM documents),
    rec AS (SELECT rel_path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE checksum END AS checksum, CASE WHEN doc_id % 11 = 0 THEN 'm0' ELSE 'm1' END AS model,
                   CASE WHEN doc_id % 13 = 0 THEN 'p0' ELSE 'p1' END AS prompt_version FROM raw WHERE doc_id % 5 <> 0)
    SELECT doc_id, CASE WHEN rec.rel_path IS NULL THEN 'missing' WHEN rec.checksum <> raw.checksum THEN 'checksum changed' WHEN model <> 'm1' THEN 'model changed'
                        WHEN prompt_version <> 'p1' THEN 'prompt_version changed' ELSE '' END AS reason
    FROM raw LEFT JOIN rec USING (rel_path)""")
def extract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sums(spark, sf_dir)
    old = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    recorded = raw.where("doc_id % 5 <> 0").select("rel_path", old(7, F.lit("old"), F.col("checksum")).alias("checksum"), old(11, "m0", "m1").alias("model"), old(13, "p0", "p1").alias("prompt_version"))
    return gates.extract_gate(raw, recorded, {"model": F.lit("m1"), "prompt_version": F.lit("p1")}).select("doc_id", "reason")


@query(rf"""
    WITH raw AS (SELECT doc_id, {REL_PATH} AS rel_path, {SUM16} AS checksum FROM documents),
    st AS (SELECT rel_path, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE checksum END AS checksum, doc_id % 9 = 0 AS unfinished FROM raw WHERE doc_id % 4 <> 0),
    j AS (SELECT doc_id, CASE WHEN st.rel_path IS NULL THEN 'new' WHEN st.checksum <> raw.checksum THEN 'changed' WHEN unfinished THEN 'unfinished' END AS why FROM raw LEFT JOIN st USING (rel_path))
    SELECT doc_id, why FROM j WHERE why IS NOT NULL""")
def compose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sums(spark, sf_dir)
    state = raw.where("doc_id % 4 <> 0").select(
        "rel_path",
        F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("checksum")).alias("checksum"),
        F.when(F.col("doc_id") % 9 != 0, F.lit("2024-01-01").cast("timestamp")).alias("compiled_at"),
        F.array(F.lit("write")).alias("completed_ops"),
    )
    return gates.compose_gate(raw, state).select("doc_id", "why")


@query(f"""
    WITH st AS (SELECT {REL_PATH} AS rel_path, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS e, CASE WHEN doc_id % 5 = 0 THEN 'w1' ELSE 'w2' END AS w FROM documents)
    SELECT rel_path, coalesce(e <> 'v2', false) AS behind_extract, coalesce(w <> 'w2', false) AS behind_write FROM st WHERE doc_id % 10 <> 0""")
def wiki_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_documents(spark, sf_dir).select("doc_id", "rel_path")
    state = docs.select(
        "rel_path",
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 4 == 0, "v1").otherwise("v2").alias("prompt_version"),
        F.when(F.col("doc_id") % 5 == 0, "w1").otherwise("w2").alias("write_prompt_version"),
    )
    return gates.lag(docs.where("doc_id % 10 <> 0"), state, "v2", "w2")


@query(rf"""
    WITH raw AS (SELECT doc_id, source, {SUM16} AS checksum FROM documents),
    h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE checksum END AS s FROM raw WHERE doc_id % 5 <> 0)
    SELECT source, coalesce(count_if(h.s = checksum), 0)::BIGINT AS matches, coalesce(count_if(h.doc_id IS NULL), 0)::BIGINT AS missing, coalesce(count_if(h.s <> checksum), 0)::BIGINT AS mismatched FROM raw LEFT JOIN h USING (doc_id) GROUP BY source""")
def check_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sums(spark, sf_dir)
    headers = raw.where("doc_id % 5 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("checksum")).alias("source_checksum"))
    found = gates.check_extractions(raw, headers)
    return found.groupBy("source").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("matches", "missing", "mismatched")))


@query(rf"""
    WITH raw AS (SELECT doc_id, {REL_PATH} AS rel_path, {SUM16} AS checksum FROM documents),
    p AS (SELECT rel_path, CASE WHEN doc_id % 4 = 0 THEN 'edited' ELSE checksum END AS c FROM raw WHERE doc_id % 10 <> 0)
    SELECT rel_path, CASE WHEN p.rel_path IS NULL THEN 'gone' WHEN c = checksum THEN 'in_sync' ELSE 'changed' END AS verdict FROM raw LEFT JOIN p USING (rel_path)""")
def check_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sums(spark, sf_dir)
    parent = raw.where("doc_id % 10 <> 0").select("rel_path", F.when(F.col("doc_id") % 4 == 0, "edited").otherwise(F.col("checksum")).alias("checksum"))
    return gates.check_parent(raw, parent)


@query(f"""
    SELECT {REL_PATH} AS rel_path, CASE WHEN doc_id % 6 = 0 THEN 'no extraction' ELSE 'extraction is of another version' END AS warning
    FROM documents WHERE doc_id % 6 = 0 OR doc_id % 7 = 0""")
def copy_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sums(spark, sf_dir)
    held = raw.where("doc_id % 6 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("checksum")).alias("source_checksum"))
    return gates.copy_guard(raw, held)[1]


# ---- catalogs and derived bases


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.concat(F.array(F.col("p_brand"), F.concat(F.lit("k"), (F.col("p_partkey") % 900).cast("string"))), F.filter(F.split("p_type", " "), lambda w: w != "")))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), tags.alias("tags"), "p_partkey", "p_name", "p_type")


_TAGS = """
    WITH t AS (SELECT p_name, unnest(list_distinct(list_concat([p_brand, 'k' || p_partkey % 900], list_filter(string_split(p_type, ' '), lambda w: w <> '')))) AS tag FROM part)
    SELECT tag, count(*) AS n, array_to_string(list_sort(list(p_name)), '; ') AS titles FROM t GROUP BY tag HAVING count(*) {}"""


@query(_TAGS.format(">= 3"))
def tag_index_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.primary(catalog.tag_index(_parts(spark, sf_dir))).orderBy(F.desc("n"), "tag")


@query(_TAGS.format("< 3"))
def tag_index_longtail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.long_tail(catalog.tag_index(_parts(spark, sf_dir))).orderBy("tag")


@query(r"""
    SELECT p_name AS title, '- wiki/concepts/' || trim(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') || '.md — ' || p_name || ': ' || p_type AS line FROM part""")
def master_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("wiki/concepts/"), text.slug(F.col("p_name")), F.lit(".md"))
    rows = _parts(spark, sf_dir).select("title", text.catalog_line(path, F.col("p_name"), F.col("p_type")).alias("line"))
    return rows.orderBy("title", "line")


_REFS = """
    a AS (SELECT 'raw/src' || (p_partkey % 20) || '__' || (p_partkey % 1500) || '.md' AS r1,
                 CASE WHEN p_partkey % 7 = 0 THEN '../etc/x' || p_partkey || '.md' WHEN p_partkey % 11 = 0 THEN 'wiki/x.md' ELSE 'raw/src1__' || p_partkey || '.md' END AS r2 FROM part),
    refs AS (SELECT r1 AS ref FROM a UNION SELECT r2 FROM a)"""


@query(f"""
    WITH {_REFS}
    SELECT ref, CASE WHEN ref LIKE '../%' THEN 'escapes_kb' WHEN ref NOT LIKE 'raw/%' THEN 'not_a_raw_document' WHEN d.p IS NULL THEN 'document_missing' ELSE 'ok' END AS status
    FROM refs LEFT JOIN (SELECT {REL_PATH} AS p FROM documents) d ON d.p = ref""")
def resolve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.concat(F.lit("raw/src"), (k % 20).cast("string"), F.lit("__"), (k % 1500).cast("string"), F.lit(".md"))
    other = F.when(k % 7 == 0, F.concat(F.lit("../etc/x"), k.cast("string"), F.lit(".md"))).when(k % 11 == 0, "wiki/x.md").otherwise(F.concat(F.lit("raw/src1__"), k.cast("string"), F.lit(".md")))
    articles = table(spark, sf_dir, "part").select(F.array(F.concat(one, F.lit(", "), other)).alias("sources"))
    return catalog.resolve_documents(articles, raw_documents(spark, sf_dir).select("rel_path"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    p = lambda x: F.concat(F.lit("raw/src"), (x % 20).cast("string"), F.lit("__"), x.cast("string"), F.lit(".md"))
    mine = F.array(p(d), p(d + 1), F.concat(F.lit("made/up"), d.cast("string")), p(d), p(d * 7 % 900), p(d * 3 % 800), p(d * 5 % 700), p(d * 11 % 600), p(d * 13 % 500), F.lit("made/up"))
    return table(spark, sf_dir, "documents").select(d.alias("question"), mine.alias("paths"))


_CHOICES = """
    c AS (SELECT doc_id AS question, unnest(list_transform([doc_id, doc_id + 1, -1, doc_id, doc_id * 7 % 900, doc_id * 3 % 800, doc_id * 5 % 700, doc_id * 11 % 600, doc_id * 13 % 500, -2],
            lambda x: CASE x WHEN -1 THEN 'made/up' || doc_id WHEN -2 THEN 'made/up' ELSE 'raw/src' || (x % 20) || '__' || x || '.md' END)) AS path,
            unnest(range(10)) AS pos FROM documents),
    f AS (SELECT question, path, min(pos) AS pos FROM c GROUP BY ALL)"""


@query(f"""
    WITH {_CHOICES},
    r AS (SELECT question, row_number() OVER (PARTITION BY question ORDER BY pos)::INT AS rank, path FROM f WHERE path IN (SELECT {REL_PATH} FROM documents))
    SELECT * FROM r WHERE rank <= 6""")
def select_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.selected(_choices(spark, sf_dir), raw_documents(spark, sf_dir).select(F.col("rel_path").alias("path")))


@query(f"WITH {_CHOICES} SELECT question, count(*) AS dropped FROM f WHERE path NOT IN (SELECT {REL_PATH} FROM documents) GROUP BY question")
def invented_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.invented(_choices(spark, sf_dir), raw_documents(spark, sf_dir).select(F.col("rel_path").alias("path")))


@query(f"SELECT {REL_PATH} AS path FROM documents WHERE doc_id % 3 <> 0")
def offtopic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = raw_documents(spark, sf_dir).select(F.col("rel_path").alias("path"), "doc_id")
    return catalog.off_topic(entries, entries.where("doc_id % 3 = 0"))


_FILES = "files AS (SELECT 'wiki/' || r_name || '/' || n_name || '/' || c_name || '.md' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("rn"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nn"), F.col("n_regionkey").alias("rk"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), "c_name")
    return c.join(n, "nk").join(r, "rk").select(F.concat(F.lit("wiki/"), F.concat_ws("/", "rn", "nn", "c_name"), F.lit(".md")).alias("path"))


@query(f"""
    WITH {_FILES},
    p AS (SELECT string_split(path, '/') AS s FROM files)
    SELECT array_to_string(s[1:i], '/') AS dir, count(*) AS files FROM (SELECT s, unnest(range(0, len(s))) AS i FROM p) GROUP BY 1""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.directory_counts(_files(spark, sf_dir))


@query(f"""
    WITH {_FILES},
    p AS (SELECT string_split(path, '/') AS s FROM files),
    rows AS (SELECT array_to_string(s, '/') AS path, false AS is_dir FROM p UNION ALL SELECT DISTINCT array_to_string(s[1:i], '/'), true FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p))
    SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, len(string_split(path, '/'))::INT AS depth, is_dir FROM rows""")
def wiki_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tree(_files(spark, sf_dir))


@query("""
    SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains('wiki/' || p_partkey, '77') OR contains(lower(p_brand), '#2')
        OR contains(lower(p_type), 'ring') OR contains('k' || p_partkey % 900, '77') OR contains(lower(p_name), '#2')""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    path = F.concat(F.lit("wiki/"), F.col("p_partkey").cast("string"))
    hit = lambda q: catalog.matches_query(q, F.col("title"), F.col("p_name"), path, F.col("tags"))
    return rows.where(hit("RING") | hit("#2") | hit("77")).select("p_partkey")


@query(r"""
    SELECT p_partkey, p_name AS title, 'wiki/concepts/' || p_partkey || '.md' AS path, p_type AS summary, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS keys FROM part""")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("wiki/concepts/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    line = catalog.index_line(F.col("p_name"), path, F.col("p_type"))
    lines = table(spark, sf_dir, "part").select(F.concat(line, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" | keys: "), F.col("p_brand"))).otherwise("")).alias("line"))
    parsed = catalog.parse_index(lines)
    return parsed.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("p_partkey"), "title", "path", "summary", "keys")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'extraction/a/' || doc_id || '.md' WHEN doc_id % 4 = 1 THEN 'extraction/' || doc_id || '.b.md' END AS extraction,
           doc_id % 4 = 3 AND doc_id % 8 <> 3 AS is_article FROM documents""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = d.cast("string")
    path = (
        F.when(d % 4 == 0, F.concat(F.lit("raw/a/"), s, F.lit(".md")))
        .when(d % 4 == 1, F.concat(F.lit("raw/"), s, F.lit(".b.md")))
        .when(d % 4 == 2, F.concat(F.lit("raw/../"), s))
        .when(d % 8 == 3, F.concat(F.lit("wiki/../../"), s))
        .otherwise(F.concat(F.lit("wiki/x/./../"), s))
    )
    return table(spark, sf_dir, "documents").select("doc_id", paths.extraction_path(path).alias("extraction"), paths.is_article(path).alias("is_article"))


@query(r"""
    WITH a AS (SELECT p_partkey, 'title: ' || p_name || chr(10) || 'type: ' || p_type || chr(10) AS header, chr(10) || '# ' || p_name || chr(10) || chr(10) || 'About ' || p_type || '.' AS body FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE header END AS header, CASE WHEN p_partkey % 3 = 0 THEN header || body ELSE body END AS body, p_partkey % 3 = 0 AS bare FROM a""")
def frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("title: "), F.col("p_name"), F.lit("\ntype: "), F.col("p_type"), F.lit("\n"))
    body = F.concat(F.lit("\n# "), F.col("p_name"), F.lit("\n\nAbout "), F.col("p_type"), F.lit("."))
    article = F.when(F.col("p_partkey") % 3 == 0, F.concat(header, body)).otherwise(F.concat(F.lit("---\n"), header, F.lit("---\n"), body))
    h, b = text.split_frontmatter(article)
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("header"), b.alias("body"), (h == "").alias("bare"))


@query(r"""
    WITH k AS (SELECT c_nationkey, array_to_string(list_sort(list_distinct(list('key_' || c_custkey % 97))), ',') AS all_keys, list_sort(list_distinct(list('key_' || c_custkey % 97))) AS ks FROM customer GROUP BY 1),
    e AS (SELECT c_nationkey, ks, i, list_sum(list_transform(ks[1:i], lambda x: length(x) + 2)) - 2 AS upto, len(ks) AS n FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM k)),
    c AS (SELECT c_nationkey, any_value(ks) AS ks, any_value(n) AS n, min(CASE WHEN upto > CASE WHEN i < n THEN 40 - 3 ELSE 40 END THEN i END) - 1 AS kept FROM e GROUP BY 1)
    SELECT c_nationkey, CASE WHEN kept IS NULL THEN array_to_string(ks, ', ') WHEN kept > 0 THEN array_to_string(ks[1:kept], ', ') || ', …' ELSE '' END AS keys FROM c""")
def table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("key_"), (F.col("c_custkey") % 97).cast("string")))).alias("k"))
    body = F.array_join(F.transform("k", lambda x: F.concat(F.lit("| `"), x, F.lit("` | about |"))), "\n")
    return rows.select("c_nationkey", text.table_keys(F.concat(F.lit("| name | text |\n|---|---|\n"), body), 40).alias("keys"))
