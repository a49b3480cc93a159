"""Overlap, chunking, composition and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import chunking, compose, grounding, overlap
from quillmill.operators.tables import written

from .registry import REL_PATH, query, raw_documents, table

_SPLIT = r"[^\x20\x09-\x0D]"


def _topics(spark: SparkSession, sf_dir: str, n: int = 12) -> DataFrame:
    """(id, tokens): the n most frequent words of five characters and more of each whole text, most frequent first; none for a text without any."""
    docs = table(spark, sf_dir, "documents")
    found = F.sort_array(F.regexp_extract_all(F.lower("text"), F.lit(f"({_SPLIT}{{5,}})"), F.lit(1)))  # in order they shuffle smaller
    words = docs.select(F.col("doc_id").alias("id"), F.explode(found).alias("w")).repartition("id")  # once, for all that follows
    counted = words.groupBy("id", "w").agg(F.count(F.lit(1)).alias("c"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "w"))).where(F.col("r") <= n)
    lists = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("tokens"))
    return docs.select(F.col("doc_id").alias("id")).join(lists, "id", "left").select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


_TOPICS = rf"""
    w0 AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{_SPLIT}{{{{5,}}}}')) AS w FROM documents),
    w1 AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, w) AS r FROM w0 GROUP BY id, w)""".replace("{{", "{").replace("}}", "}")


@query(f"""
    WITH {_TOPICS},
    x AS (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM w1 WHERE r <= 12)
    SELECT a.id AS i, b.id AS j, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS overlap FROM x a JOIN x b ON a.w = b.w AND a.id < b.id
    GROUP BY 1, 2 HAVING count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) >= 0.3""")
def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(_topics(spark, sf_dir), 0.3)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's title is made of its four most frequent long words."""
    return _topics(spark, sf_dir, 4).select("id", _title_words(F.col("tokens")).alias("tokens"))


def _title_words(topics: Column) -> Column:
    return text.title_words(F.array_join(topics, " "))


_TITLES = rf"""{_TOPICS},
    x0 AS (SELECT DISTINCT id, regexp_replace(w, '[^a-zA-Z0-9]', '', 'g') AS w FROM w1 WHERE r <= 4),
    x AS (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM x0 WHERE w <> '')"""


@query(f"""
    WITH {_TITLES},
    s AS (SELECT a.id AS new_id, b.id AS match_id, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS overlap FROM x a JOIN x b ON a.w = b.w AND b.id < a.id GROUP BY 1, 2)
    SELECT new_id, match_id, overlap FROM s WHERE overlap >= 0.7 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY overlap DESC, match_id) = 1""")
def title_dedup_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir).transform(written)
    return overlap.best_matches(titles, titles, earlier=True)


@query(f"""
    WITH {_TITLES},
    y AS (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM w1 WHERE r <= 12),
    s AS (SELECT y.id AS item_id, x.id AS article_id, count(*)::DOUBLE / least(any_value(y.n), any_value(x.n)) AS score FROM y JOIN x ON x.w = y.w GROUP BY 1, 2)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, article_id)::INT AS rank, article_id, score FROM s QUALIFY rank <= 5""")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _topics(spark, sf_dir).transform(written)
    return overlap.relevance(topics, topics.select("id", _title_words(F.slice("tokens", 1, 4)).alias("tokens")))


@query(rf"""
    WITH RECURSIVE {_TOPICS},
    x AS (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM w1 WHERE r <= 12),
    p AS (SELECT a.id AS i, b.id AS j, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS overlap FROM x a JOIN x b ON a.w = b.w AND a.id < b.id
          GROUP BY 1, 2 HAVING count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) >= 0.5),
    nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT i AS id FROM p UNION SELECT j FROM p)),
    links AS (SELECT row_number() OVER (ORDER BY overlap DESC, i DESC, j DESC) AS k, a.pos AS a, b.pos AS b FROM p JOIN nodes AS a ON a.id = i JOIN nodes AS b ON b.id = j),
    r(k, labels) AS (
        SELECT 0::BIGINT, (SELECT list(pos ORDER BY pos) FROM nodes)
        UNION ALL
        SELECT l.k, CASE WHEN r.labels[l.a] <> r.labels[l.b] AND len(list_filter(r.labels, lambda x: x = r.labels[l.a] OR x = r.labels[l.b])) <= 8
            THEN list_transform(r.labels, lambda x: CASE WHEN x = greatest(r.labels[l.a], r.labels[l.b]) THEN least(r.labels[l.a], r.labels[l.b]) ELSE x END) ELSE r.labels END
        FROM r JOIN links AS l ON l.k = r.k + 1),
    done AS (SELECT labels FROM r ORDER BY k DESC LIMIT 1)
    SELECT doc_id, coalesce(g.id, doc_id) AS group_id FROM documents LEFT JOIN nodes AS n ON n.id = doc_id LEFT JOIN done ON n.id IS NOT NULL LEFT JOIN nodes AS g ON g.pos = done.labels[n.pos]""")
def cluster_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _topics(spark, sf_dir).transform(written)
    return overlap.cluster(overlap.overlap_pairs(sets, 0.5), sets).select(F.col("id").alias("doc_id"), "group_id")


@query(rf"""
    WITH RECURSIVE {_TITLES},
    p AS (SELECT a.id AS id, b.id AS j, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS overlap FROM x a JOIN x b ON a.w = b.w AND b.id < a.id
          GROUP BY 1, 2 HAVING count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) >= 0.7),
    near AS (SELECT id, list(j ORDER BY overlap DESC, j) AS js FROM p GROUP BY id),
    o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k, coalesce(js, []) AS js FROM documents LEFT JOIN near ON near.id = doc_id),
    r(k, id, kept, into_id) AS (
        SELECT 0::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT
        UNION ALL
        SELECT k, id, CASE WHEN hit IS NULL THEN list_append(kept, id) ELSE kept END, coalesce(hit, id)
        FROM (SELECT o.k, o.id, r.kept, list_filter(o.js, lambda j: list_contains(r.kept, j))[1] AS hit FROM r JOIN o ON o.k = r.k + 1))
    SELECT id AS doc_id, id = into_id AS kept, into_id AS merged_into FROM r WHERE k > 0""")
def dedup_elect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.elect(_titles(spark, sf_dir).transform(written)).select(F.col("id").alias("doc_id"), "kept", "merged_into")


# ---- chunks and budgets


def _chunks_sql(limit: int) -> str:
    """chunks(doc_id, sizes): lengths of the chunks of every document, by a recursion over its lines."""
    return rf"""
    l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS ls, length(text) AS total FROM documents),
    r(doc_id, ls, i, n, size, sizes) AS (
        SELECT doc_id, ls, 0, 0, 0::BIGINT, []::BIGINT[] FROM l WHERE total > {limit}
        UNION ALL
        SELECT doc_id, ls, i + 1,
            CASE WHEN ls[i + 1] > {limit} THEN CASE WHEN size + ls[i + 1] > {limit} AND n > 0 THEN 0 ELSE n END ELSE CASE WHEN size + ls[i + 1] > {limit} AND n > 0 THEN 1 ELSE n + 1 END END,
            CASE WHEN ls[i + 1] > {limit} THEN CASE WHEN size + ls[i + 1] > {limit} AND n > 0 THEN 0 ELSE size END ELSE CASE WHEN size + ls[i + 1] > {limit} AND n > 0 THEN 0 ELSE size END + ls[i + 1] + 1 END,
            list_concat(sizes, CASE WHEN size + ls[i + 1] > {limit} AND n > 0 THEN [size - 1] ELSE [] END,
                CASE WHEN ls[i + 1] > {limit} THEN list_transform(range(0, (ls[i + 1] - 1) // {limit} + 1), lambda k: least({limit}, ls[i + 1] - k * {limit})) ELSE [] END)
        FROM r WHERE i < len(ls)),
    chunks AS (SELECT doc_id, CASE WHEN n > 0 THEN list_append(sizes, size - 1) ELSE sizes END AS sizes FROM r WHERE i = len(ls)
               UNION ALL SELECT doc_id, [total] FROM l WHERE total <= {limit})"""


@query(f"WITH RECURSIVE {_chunks_sql(2000)} SELECT doc_id, unnest(range(len(sizes)))::INT AS ord, unnest(sizes)::INT AS n_chars FROM chunks")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_lines(F.col("text"), 2000).alias("c"))
    return docs.select("doc_id", F.posexplode(F.transform("c", F.length)).alias("ord", "n_chars"))


@query(f"WITH RECURSIVE {_chunks_sql(4000)} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'chunked' WHEN len(sizes) >= 3 THEN 'summarize' ELSE 'chunked' END AS strategy FROM chunks")
def route_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.chunk_lines(F.col("text"), 4000)).alias("n"))
    wanted = F.when(F.col("doc_id") % 10 == 0, "chunked").otherwise("auto")
    return docs.select("doc_id", chunking.strategy(wanted, F.col("n")).alias("strategy"))


@query("""
    SELECT doc_id, CASE WHEN n >= 20 OR n_chars > 60000 OR n >= 8 THEN 3 WHEN n >= 4 THEN 2 ELSE 1 END AS groups, n >= 20 OR n_chars > 60000 AS second_level, least(n_chars, 72000) AS chars
    FROM (SELECT doc_id, n_chars, (n_chars // 1000)::INT AS n FROM documents)""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = chunking.fan_out(F.floor(F.col("n_chars") / 1000), F.col("n_chars"))
    return docs.select("doc_id", plan.alias("p")).select("doc_id", F.col("p.groups").alias("groups"), F.col("p.second_level").alias("second_level"), F.col("p.chars").alias("chars"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text.catalog_line(F.col("rel_path"), F.col("lang"), text.flatten(F.col("text"), 150))
    return raw_documents(spark, sf_dir).select("source", "doc_id", F.col("rel_path").alias("path"), line.alias("line"))


_LINES = rf"""
    f AS (SELECT doc_id, source, lang, {REL_PATH} AS path, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
    g AS (SELECT *, CASE WHEN length(flat) <= 150 THEN flat WHEN contains(substr(flat, 1, 150), ' ') THEN regexp_extract(substr(flat, 1, 150), '(?s)^(.*) ', 1) || '…' ELSE substr(flat, 1, 150) END AS about FROM f),
    lines AS (SELECT doc_id, source, path, about, length('- ' || path || ' — ' || lang || ': ' || about) AS n FROM g)"""


@query(rf"""
    WITH RECURSIVE {_LINES},
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS i FROM lines),
    r(source, i, path, batch, size, shown) AS (
        SELECT source, i, path, 0, CASE WHEN n + 1 > 2000 THEN 0 ELSE n + 1 END, CASE WHEN n + 1 <= 2000 THEN 0 END FROM o WHERE i = 1
        UNION ALL
        SELECT o.source, o.i, o.path,
            CASE WHEN o.n + 1 <= 2000 AND r.size > 0 AND r.size + o.n + 1 > 2000 THEN r.batch + 1 ELSE r.batch END,
            CASE WHEN o.n + 1 > 2000 THEN r.size WHEN r.size > 0 AND r.size + o.n + 1 > 2000 THEN o.n + 1 ELSE r.size + o.n + 1 END,
            CASE WHEN o.n + 1 <= 2000 THEN CASE WHEN r.size > 0 AND r.size + o.n + 1 > 2000 THEN r.batch + 1 ELSE r.batch END END
        FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
    SELECT source, path, shown AS batch FROM r""")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack_batches(_lines(spark, sf_dir), 2000, "source", ["path"])


@query(rf"""
    WITH {_LINES},
    q AS (SELECT source, list(n ORDER BY doc_id) AS ns FROM lines GROUP BY source),
    k AS (SELECT source, ns, len(ns) AS n, unnest(range(0, 32)) AS k FROM q),
    m AS (SELECT source, ns, n, k, floor(n / pow(2, k))::INT AS m FROM k),
    fit AS (SELECT source, n, k, m FROM m WHERE m > 0 AND list_sum(list_transform(ns[1:m], lambda x: x + 1)) - 1 <= 2000)
    SELECT q.source, len(q.ns) AS n_total, coalesce(arg_min(m, k), 0)::INT AS n_kept FROM q LEFT JOIN fit USING (source) GROUP BY ALL""")
def halving_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.halving_fit_groups(_lines(spark, sf_dir), "source", "doc_id", 2000)


@query("""
    SELECT source, ((i - 1) // 5)::INT AS grp, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) GROUP BY 1, 2""")
def fanout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16. Only a source's count matters: its rows fill groups of five."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("c"))
    groups = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 5)), lambda g: F.struct(g.cast("int").alias("grp"), F.least(F.lit(5).cast("long"), F.col("c") - g * 5).alias("n")))
    return sizes.select("source", F.explode(groups).alias("g")).select("source", F.col("g.grp").alias("grp"), F.col("g.n").alias("n"))


# ---- composition


@query(rf"""
    WITH {_TOPICS}, {_LINES},
    e AS (SELECT l.doc_id, l.path AS ref, l.about, a.w AS article, list_sort(list(t.w)) AS topics FROM lines l JOIN w1 a ON a.id = l.doc_id AND a.r = 1 JOIN w1 t ON t.id = l.doc_id AND t.r <= 3 GROUP BY ALL)
    SELECT article, array_to_string(list_sort(list_distinct(flatten(list(topics)))), ',') AS topics, array_to_string(list(ref ORDER BY doc_id), ',') AS refs, length(string_agg(about, chr(10) ORDER BY doc_id))::INT AS summary_chars
    FROM e GROUP BY article""")
def combine_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each leading topic, combined of the documents that have it."""
    topics = _topics(spark, sf_dir, 3).select(F.col("id").alias("doc_id"), F.col("tokens").alias("topics")).where(F.size("topics") > 0)
    docs = raw_documents(spark, sf_dir).select("doc_id", F.col("rel_path").alias("ref"), text.flatten(F.col("text"), 150).alias("summary"))
    e = docs.join(topics, "doc_id").withColumn("article", F.get("topics", F.lit(0)))
    out = compose.combine(e, "article", ["doc_id"])
    return out.select("article", F.array_join("topics", ",").alias("topics"), F.array_join("refs", ",").alias("refs"), F.length("summary").alias("summary_chars"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = lambda n, kind: F.concat(F.lit(f"wiki/{kind}/a"), (d % n).cast("string"), F.lit(".md"))
    t = F.array(
        F.struct(path(40, "concept").alias("path"), F.lit("create").alias("action")),
        F.when(d % 2 == 0, F.struct(path(15, "entity").alias("path"), F.lit("merge").alias("action"))),
        F.when(d % 5 == 0, F.struct(F.concat(F.lit("wiki/../out"), (d % 3).cast("string")).alias("path"), F.lit("merge").alias("action"))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(t, lambda x: x.isNotNull())).alias("t")).select("doc_id", "t.path", "t.action")


_TARGETS = """
    t AS (SELECT doc_id, 'wiki/concept/a' || doc_id % 40 || '.md' AS path, 'create' AS action FROM documents
          UNION ALL SELECT doc_id, 'wiki/entity/a' || doc_id % 15 || '.md', 'merge' FROM documents WHERE doc_id % 2 = 0
          UNION ALL SELECT doc_id, 'wiki/../out' || doc_id % 3, 'merge' FROM documents WHERE doc_id % 5 = 0)"""


@query(f"WITH {_TARGETS} SELECT path, action, count(*) AS n_ops, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs, path NOT LIKE '%..%' AS valid FROM t GROUP BY ALL")
def article_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.article_ops(_targets(spark, sf_dir))


@query(f"""
    WITH {_TARGETS},
    r AS (SELECT doc_id, path, action, CASE WHEN path LIKE '%..%' THEN 'bad path ' || path WHEN doc_id % 20 = 3 THEN 'write failed' END AS error FROM t),
    g AS (SELECT doc_id AS content_hash, coalesce(string_agg(CASE WHEN action = 'create' AND error IS NULL THEN path END, ',' ORDER BY path), '') AS created,
                 coalesce(string_agg(CASE WHEN action = 'merge' AND error IS NULL THEN path END, ',' ORDER BY path), '') AS merged, coalesce(string_agg(error, '; ' ORDER BY error), '') AS error FROM r GROUP BY 1)
    SELECT content_hash, created, merged, error, CASE WHEN error = '' THEN 'ok' WHEN created = '' AND merged = '' THEN 'failed' ELSE 'partial' END AS status FROM g""")
def item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("path").contains(".."), F.concat(F.lit("bad path "), F.col("path"))).when(F.col("doc_id") % 20 == 3, "write failed")
    return compose.item_results(_targets(spark, sf_dir).select(F.col("doc_id").alias("content_hash"), "path", "action", error.alias("error")))


@query()
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = F.concat(F.lit("---\ntitle: "), F.col("p_name"), F.lit("\nupdated: 2024-01-01\nsources:\n  - raw/a.md\n---\n\n# "), F.col("p_name"), F.lit("\n\n## Facts\n\nbody\n\n## More\n\nrest"))
    none = F.lit(None).cast("string")
    fields = ("action", "section", "after", "heading", "content")
    one = lambda *values: F.struct(*(v.alias(k) for k, v in zip(fields, values, strict=True)))
    patch = F.array(
        one(F.lit("append_to_section"), F.lit("## Facts"), none, none, F.col("p_type")),
        one(F.lit("new_section"), none, F.lit("## Facts"), F.lit("## New"), F.col("p_brand")),
    )
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("wiki/"), F.col("p_partkey").cast("string")).alias("path"), article.alias("text"), F.lit("raw/b.md").alias("source"), patch.alias("patches"))
    return compose.apply_patches(rows, "2024-06-01")


# ---- grounding

_FACTS = """
    n AS (SELECT item_id AS article, regexp_extract_all(text, '[A-Za-z]+') AS ws, lower(text) AS text FROM benchmark),
    names AS (SELECT article, text, unnest(['known_' || ws[1], 'Absent' || article || 'Name', ws[2] || '.' || ws[3], ws[2] || '.zq' || article]) AS name FROM n)"""


@query(rf"""
    WITH {_FACTS},
    known AS (SELECT article, unnest(regexp_extract_all(text || ' known_' || lower(regexp_extract(text, '[A-Za-z]+')), '[\p{{L}}\p{{N}}_]+')) AS w FROM (SELECT DISTINCT article, text FROM names)),
    parts AS (SELECT article, name, unnest(regexp_extract_all(lower(name), '\w+')) AS w FROM names)
    SELECT DISTINCT article, name FROM parts WHERE (article, w) NOT IN (SELECT article, w FROM known)""")
def unsourced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    w = lambda i: F.get(ws, F.lit(i))
    names = [F.concat(F.lit("known_"), w(0)), F.concat(F.lit("Absent"), F.col("item_id").cast("string"), F.lit("Name")), F.concat(w(1), F.lit("."), w(2)), F.concat(w(1), F.lit(".zq"), F.col("item_id").cast("string"))]
    article = F.concat(F.lit("# Facts\n\n| Name | About |\n|---|---|\n"), *(F.concat(F.lit("| `"), n, F.lit("` | 30s |\n")) for n in names), F.lit("```\n- `Fenced`\n```\n- [[Link]]\n- Prose only\n"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("article"), article.alias("text"), F.concat("text", F.lit(" known_"), w(0)).alias("source"))
    found = grounding.unsourced(grounding.named_items(rows.select("article", "text")), rows.select("article", F.col("source").alias("text")))
    return found.select(F.col("article").cast("long").alias("article"), "name")
