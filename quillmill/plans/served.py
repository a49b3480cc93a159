"""Retrieval and chat, people, the task queue, sessions and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths, text
from quillmill.operators import folds, retrieval, tasks
from quillmill.sources import html

from .registry import REL_PATH, query, raw_documents, table

_LINKS = """' [a](./' || {p} || '#top) [b](/' || {p} || ') [c](raw/none' || turn || ') [d](' || {p} || ') [e](src' || conv_id % 20 || '__' || conv_id % 100 || ')'"""


@query(rf"""
    WITH a AS (SELECT conv_id, turn, text || {_LINKS.format(p="'raw/src' || conv_id % 20 || '__' || conv_id % 100 || '.md'")} AS text FROM conversations WHERE role = 'assistant'),
    l AS (SELECT conv_id, turn, regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)\)', 1) AS ls FROM a),
    u AS (SELECT conv_id, turn, unnest(ls) AS link, unnest(range(len(ls))) AS pos FROM l),
    n AS (SELECT *, regexp_replace(regexp_replace(link, '#.*$', ''), '^(\./|/)+', '') AS bare FROM u),
    d AS (SELECT {REL_PATH} AS path, 'doc ' || doc_id AS title FROM documents),
    f AS (SELECT conv_id, turn, d.path, d.title, min(pos) AS pos FROM n JOIN d ON d.path = CASE WHEN bare LIKE '%.md' THEN bare ELSE bare || '.md' END GROUP BY ALL)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos)::INT AS rank, path, title FROM f""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"), F.lit("__"), (F.col("conv_id") % 100).cast("string"))
    links = F.concat(F.lit(" [a](./raw/"), p, F.lit(".md#top) [b](/raw/"), p, F.lit(".md) [c](raw/none"), F.col("turn").cast("string"), F.lit(") [d](raw/"), p, F.lit(".md) [e]("), p, F.lit(")"))
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", links).alias("text"))
    held = raw_documents(spark, sf_dir).select(F.col("rel_path").alias("path"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    return retrieval.citations(answers, held, ["conv_id", "turn"])


@query(r"""
    WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS rs, list(role || ': ' || text ORDER BY turn) AS ls FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY 1)
    SELECT conv_id, array_to_string(CASE WHEN rs[-1] = 'user' THEN ls[1:len(ls) - 1] ELSE ls END, chr(10)) AS history FROM m""")
def history_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history(table(spark, sf_dir, "conversations"))


@query(f"SELECT doc_id, length(CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000 - {len(text.NOTICE)}) || '{text.NOTICE[2:]}' || chr(10) || chr(10) ELSE text END)::INT AS kept_chars, length(text) > 12000 AS truncated FROM documents")
def truncate_with_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.truncated(F.col("text"))).alias("kept_chars"), (F.length("text") > 12_000).alias("truncated"))


@query(f"""
    WITH r AS (SELECT doc_id, {REL_PATH} AS path, CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000 - {len(text.NOTICE)}) || chr(10) || chr(10) || '{text.NOTICE[2:]}' ELSE text END AS t FROM documents)
    SELECT doc_id // 6 AS question, sha256(string_agg('### d' || doc_id || ' (/' || path || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM r GROUP BY 1""")
def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six articles a question, as retrieval gives; of the context its digest."""
    rows = raw_documents(spark, sf_dir)
    rows = rows.select(F.floor(F.col("doc_id") / 6).alias("question"), F.col("doc_id").alias("rank"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("rel_path").alias("path"), "text")
    return retrieval.article_context(rows, "question").select("question", F.sha2("context", 256).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE source || '__' || doc_id END AS title FROM documents")
def catalog_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_documents(spark, sf_dir).select("doc_id", F.col("rel_path").alias("path"))
    held = rows.where("doc_id % 2 = 0").select("path", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    return retrieval.titled(rows, held).select("doc_id", "title")


_NAME = r"[^\x00-\x20\[\]|]{9,}"
_PEOPLE = f"""
    links AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAME}')) AS link FROM documents),
    people AS (SELECT lower(link) AS alias, upper(lower(link)) AS canonical FROM links GROUP BY ALL ORDER BY count(*) DESC, alias LIMIT 40)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents with their long words as wikilinks, and as people the forty words that stand in most links."""
    docs = table(spark, sf_dir, "documents")
    articles = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.regexp_replace(F.regexp_replace("text", r"[\[\]]", " "), f"({_NAME})", "[[$1]]").alias("text"))
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({_NAME})"), F.lit(1))).alias("w")).select(F.lower("w").alias("alias"))
    top = words.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "alias").limit(40)
    return articles, top.select(F.lit(0).alias("ord"), F.upper("alias").alias("canonical"), F.array("alias").alias("aliases"))


@query(f"WITH {_PEOPLE} SELECT canonical, count(*) AS mentions, count(DISTINCT doc_id) AS n_sources FROM links JOIN people ON alias = lower(link) GROUP BY 1")
def people_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.mentions(*_linked(spark, sf_dir))


@query(r"""
    SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand || '''s_Éa-' || p_size), '[^\p{L}\p{N}\s_-]', '', 'g')) <> '' AS named,
           regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || '''s_Éa-' || p_size), '[^\p{L}\p{N}\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def person_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit("'s_Éa-"), F.col("p_size").cast("string"))
    slug = text.person_slug(name)
    return table(spark, sf_dir, "part").select("p_partkey", (slug != "").alias("named"), slug.alias("slug"))


@query("SELECT doc_id, 'wiki/t' || doc_id % 9 || '/two-words-' || doc_id || '.md' AS path, 't' || doc_id % 9 AS type, 'Two Words ' || doc_id AS title FROM documents")
def target_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat(F.lit("wiki/t"), (d % 9).cast("string"), F.lit("/two-words-"), d.cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), paths.type_of(path).alias("type"), paths.title_of(path).alias("title"))


# ---- queue


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("""
    WITH k AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority ILIKE '%urg%' OR o_orderpriority ILIKE '%_lo%'))
    SELECT o_orderkey, o_custkey, o_orderpriority, (SELECT count(*) FROM k) AS total FROM k ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def tasks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority").ilike("%urg%")
    rows = _tasks(spark, sf_dir).withColumn("title", F.when(urgent, "URGENT").otherwise(""))
    rows = rows.withColumn("title", F.when(F.col("title") == "URGENT", "x urg x").otherwise(F.when(F.col("o_orderpriority").ilike("%_lo%"), "urg").otherwise("")))
    return tasks.page(rows.withColumnRenamed("o_orderstatus", "status"), "F", "URG", ["o_orderkey", "o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey"), 2, 20, ["title", "o_orderpriority"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done"))
    return tasks.claim_next(rows, "o_custkey", "o_orderdate", "o_orderkey")


@query("""
    WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'succeeded' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE epoch_ms(o_orderdate) + (o_orderkey % 100) * 86400000 END AS lease FROM orders)
    SELECT o_orderkey, CASE WHEN status = 'running' AND lease > 0 AND lease <= epoch_ms(TIMESTAMP '1997-01-01') THEN 'pending' ELSE status END AS new_status FROM t""")
def recover_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    lease = F.when(key % 4 == 0, F.lit(0)).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (key % 100) * 86_400_000)
    rows = _tasks(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"), lease.alias("lease"))
    return tasks.recover_expired(rows, F.unix_millis(F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey", "new_status")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F')")
def delete_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"))
    return tasks.delete_terminal(rows, rows.where("id % 3 = 0").select("id")).select("id")


@query("""
    SELECT o_orderdate < TIMESTAMP '1996-06-15' AS old, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last7days' WHEN d <= 30 THEN 'last30days' ELSE 'older' END AS bucket, count(*) AS n
    FROM (SELECT o_orderdate, date_diff('day', o_orderdate::DATE, DATE '1996-06-15') AS d FROM orders) GROUP BY 1, 2""")
def session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1996-06-15").cast("date")
    return _tasks(spark, sf_dir).groupBy((F.col("o_orderdate") < F.lit("1996-06-15").cast("timestamp")).alias("old"), tasks.bucket(F.col("o_orderdate"), now).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- costs


@query("""
    WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN 'claude-opus-4-6' WHEN 'N' THEN 'router.claude-sonnet' ELSE 'other-1' END AS model, (l_quantity * 100)::BIGINT AS prompt, (l_linenumber * 10)::BIGINT AS cached, (l_suppkey % 500)::BIGINT AS completion FROM lineitem),
    p AS (SELECT *, CASE model WHEN 'claude-opus-4-6' THEN 5.0 WHEN 'router.claude-sonnet' THEN 3.0 ELSE 0 END AS i, CASE model WHEN 'claude-opus-4-6' THEN 25.0 WHEN 'router.claude-sonnet' THEN 15.0 ELSE 0 END AS o FROM c)
    SELECT model, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum(((prompt - cached) * i::DOUBLE + cached * i::DOUBLE * 0.1 + completion * o::DOUBLE) / 1e6), 2) AS cost FROM p GROUP BY 1""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "A", "claude-opus-4-6").when(F.col("l_returnflag") == "N", "router.claude-sonnet").otherwise("other-1")
    calls = table(spark, sf_dir, "lineitem").select(model.alias("model"), (F.col("l_quantity") * 100).cast("long").alias("prompt"), (F.col("l_linenumber") * 10).cast("long").alias("cached"), (F.col("l_suppkey") % 500).alias("completion"))
    return tasks.ledger(tasks.resolve_prices(calls), ["model"])


@query("""
    WITH m AS (SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'claude-opus-4-6' WHEN 1 THEN 'claude-sonnet-4-' || p_size WHEN 2 THEN p_brand || '.OPUS' WHEN 3 THEN 'my-haiku-' || p_size WHEN 4 THEN 'gpt-4o' WHEN 5 THEN 'acme/gpt-4o-' || p_size WHEN 6 THEN p_brand ELSE '' END AS model FROM part),
    f AS (SELECT model, CASE WHEN contains(lower(model), 'gpt-4o') THEN [2.5, 10.0] WHEN contains(lower(model), 'opus') THEN [5.0, 25.0] WHEN contains(lower(model), 'sonnet') THEN [3.0, 15.0] WHEN contains(lower(model), 'haiku') THEN [1.0, 5.0] END AS p FROM m)
    SELECT model, coalesce(p[1], 0)::DOUBLE AS input, coalesce(p[2], 0)::DOUBLE AS output, p IS NOT NULL AS priced FROM f""")
def price_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    model = F.when(k == 0, "claude-opus-4-6").when(k == 1, F.concat(F.lit("claude-sonnet-4-"), size)).when(k == 2, F.concat("p_brand", F.lit(".OPUS"))).when(k == 3, F.concat(F.lit("my-haiku-"), size))
    model = model.when(k == 4, "gpt-4o").when(k == 5, F.concat(F.lit("acme/gpt-4o-"), size)).when(k == 6, F.col("p_brand")).otherwise("")
    return tasks.resolve_prices(table(spark, sf_dir, "part").select(model.alias("model")).distinct(), [("gpt-4o", 2.5, 10.0)])


@query("""
    WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS total FROM c)
    SELECT user_id, day::VARCHAR AS day, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY day), 0) AS delta FROM k""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    per_day = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counters = per_day.select("user_id", "day", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")).alias("total"))
    return tasks.deltas(counters, "user_id", "day", "total").select("user_id", F.col("day").cast("string").alias("day"), "delta")


@query("""
    WITH m AS (SELECT user_id, event_type = 'error' AS hit, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    r AS (SELECT user_id, island, coalesce(count_if(hit), 0) AS n FROM m GROUP BY ALL)
    SELECT user_id, max(n)::BIGINT AS longest_run FROM r GROUP BY 1""")
def miss_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.longest_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(r"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at, event_type IN ('error', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r(user_id, event_id, i, state, fails, opened, shown) AS (
        SELECT user_id, 0::BIGINT, 0::BIGINT, 'closed', 0, 0.0::DOUBLE, '' FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT e.user_id, e.event_id, e.i,
            CASE WHEN r.state = 'open' AND e.at - r.opened < 3000 THEN 'open' WHEN NOT e.failed THEN 'closed' WHEN r.state = 'open' OR r.fails + 1 >= 2 THEN 'open' ELSE 'closed' END,
            CASE WHEN r.state = 'open' AND e.at - r.opened < 3000 THEN r.fails WHEN NOT e.failed THEN 0 WHEN r.state = 'open' THEN r.fails ELSE r.fails + 1 END,
            CASE WHEN NOT (r.state = 'open' AND e.at - r.opened < 3000) AND e.failed AND (r.state = 'open' OR r.fails + 1 >= 2) THEN e.at ELSE r.opened END,
            CASE WHEN r.state = 'open' AND e.at - r.opened < 3000 THEN 'rejected' WHEN NOT e.failed THEN 'closed' WHEN r.state = 'open' OR r.fails + 1 >= 2 THEN 'open' ELSE 'closed' END
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, shown AS state FROM r WHERE i > 0""")
def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", seconds, F.col("event_type").isin("error", "click").alias("failed"))
    out = folds.breaker_states(events, "user_id", ["ts", "event_id"], "at", "failed", threshold=2, cooldown=3000.0)
    return out.select("user_id", "event_id", "state")


@query("""
    WITH e AS (SELECT user_id % 40 AS model, event_id, ts, event_type IN ('purchase', 'signup') AS hit FROM events),
    m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS i, sum(hit::INT) OVER (PARTITION BY model ORDER BY ts, event_id) AS island FROM e),
    r AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY model, island ORDER BY i) AS missed FROM m),
    f AS (SELECT model, min(i) FILTER (missed >= 10) AS off FROM r GROUP BY model)
    SELECT model, event_id, off IS NULL OR i <= off AS cached FROM r JOIN f USING (model)""")
def cache_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every call whether its model's prompt cache was on: off from ten misses in a row on."""
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("model"), "ts", "event_id", F.col("event_type").isin("purchase", "signup").alias("hit"))
    return folds.cache_states(calls, "model", ["ts", "event_id"], "hit").select("model", "event_id", "cached")


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "title", F.length("text").alias("n_chars"))
