"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, divergence, html_extract, line_quality, media, mixing, packing, pii, quality_rules, simhash, suffix_dedup, toxicity, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def vocabulary() -> str:
    """Where the public tokenizer's file lies; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_quality_rules,
        op3_mix_sources,
        op4_suffix_dedup,
        op5_best_fit_packing,
        op6_pii,
        op7_line_quality,
        op8_media_columns,
        op9_toxicity,
        op10_simhash,
        op11_collocations,
        op12_html_extract,
        op13_source_divergence,
    )
}

#: Queries whose rows DuckDB SQL can express.
ORACLE_SQL = {
    "op3_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
                   / (1 / (1 + 10 * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS key
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        r AS (SELECT *,
                sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_sum,
                sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
              FROM w),
        l AS (SELECT *, cap > weight * rest_sum / rest_weight AS below FROM r),
        f AS (SELECT arg_min(rest_sum, cap / weight) AS ls, arg_min(rest_weight, cap / weight) AS lw FROM l WHERE below),
        t AS (SELECT source, source_size, least(CASE WHEN below THEN weight * ls / lw ELSE cap END, cap) AS target FROM l LEFT JOIN f ON true),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
        p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) AS upto
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, epochs + (rest > 0 AND upto - size / 2.0::DOUBLE <= rest)::BIGINT AS copies,
               size * (epochs + (rest > 0 AND upto - size / 2.0::DOUBLE <= rest)::BIGINT) AS taken
        FROM p""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        c AS (SELECT doc_id, n, off, substr(h, 2 * off + 1, 612) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n, 256)) AS off FROM d)),
        p AS (SELECT doc_id, h, n, off, unnest(range(least(256, n - off))) AS j FROM c),
        w AS (SELECT doc_id, off + j AS i, CASE WHEN off + j + 50 <= n THEN substr(h, 2 * j + 1, 100) END AS w, substr(h, 2 * j + 1, 2) AS b FROM p),
        f AS (SELECT w, min(doc_id) AS first_id FROM w WHERE w IS NOT NULL GROUP BY w),
        m AS (SELECT w.doc_id, w.i, w.b, coalesce(f.first_id < w.doc_id, false) AS hit FROM w LEFT JOIN f ON w.w = f.w),
        r AS (SELECT doc_id, i, b, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM r),
        g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
        f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM i GROUP BY ALL),
        f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM i WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM i WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        covered AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
        two AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (l.f::HUGEINT * r.f) AS score
                FROM f2 JOIN f1 AS l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 AS r ON r.lang = f2.lang AND r.x = f2.y
                LEFT JOIN covered AS c ON c.lang = f2.lang AND c.x = f2.x AND c.y = f2.y WHERE coalesce(100 * c.longer < 50 * f2.f, true)),
        cuts AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, l.f AS l1, r.f AS r1, l2.f AS l2, r2.f AS r2,
                        (1000000::HUGEINT * f3.f * f3.f) // (l.f::HUGEINT * r.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (l2.f::HUGEINT * r2.f) AS s2
                 FROM f3 JOIN f1 AS l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 AS r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
                 JOIN f2 AS l2 ON l2.lang = f3.lang AND l2.x = f3.x AND l2.y = f3.y JOIN f1 AS r2 ON r2.lang = f3.lang AND r2.x = f3.z),
        three AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, least(s1, s2) AS score FROM cuts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        cells AS (SELECT g.lang, g.source, k.term, k.c AS in_lang FROM groups AS g JOIN kept AS k ON k.lang = g.lang),
        counted AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
        counts AS (SELECT cells.*, coalesce(counted.c, 0) AS c FROM cells LEFT JOIN counted USING (lang, source, term)),
        sums AS (SELECT lang, source, sum(c)::BIGINT AS n FROM counts GROUP BY ALL),
        p AS (SELECT c.lang, c.source, c.term, c.c, 1 + (1000000000::HUGEINT * (c.c + 1)) // (s.n + v.v) AS p, 1 + (1000000000::HUGEINT * (c.in_lang + 1)) // (v.n + v.v) AS q
              FROM counts AS c JOIN sums AS s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        bare AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
