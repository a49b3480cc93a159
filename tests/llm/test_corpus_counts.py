"""Collocations and source divergence against plain-Python versions and their SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from quillmill.llm import collocations, divergence, queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same_as_sql(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows) == sorted(want.fetchall())


def plain_collocations(rows, least=10, covered=50, top=2000, longest=3):
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(zip(*(w[i:] for i in range(k)), strict=False))
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


ODD = [
    ("en", None), ("en", ""), (None, "new york " * 12), ("und", "New  York\tcity, " * 9), ("", "a a a a a a a a a a a a a"), ("en", "x\x0by\x0cz! " * 11), ("en", "…"), ("de", "ÄÖ äö Straße " * 30),
    ("en", "the quick fox. " * 10 + "the quick dog " * 10 + "quick fox jumps; " * 8), ("en", "the quick fox. " * 10 + "the quick dog " * 10), ("fr", "w" * 30_000 + " b " + "c d e f " * 9), ("en", "q\x00r s\x85t " * 12),
]


def test_collocations_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD + ODD[3:5]], "lang string, text string, rank int, phrase string")
    for longest, covered in ((3, 50), (2, 50), (4, 80)):
        got = sorted(tuple(r) for r in collocations.collocations(docs.repartition(3), longest, covered_percent=covered).collect())
        assert got == plain_collocations(ODD + ODD[3:5], covered=covered, longest=longest) and got
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("lang = 'en' AND text = ''")).count() == 0


def test_collocations_over_many_blocks_and_a_tight_rank(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    whole = collocations.word_lists
    monkeypatch.setattr(collocations, "word_lists", lambda d: whole(d.repartition(3), block_chars=20_000))
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=40).collect())
    assert got == plain_collocations(rows, top=40)


def test_collocations_match_their_sql(spark, sf_dir, db):
    same_as_sql(spark, sf_dir, db, "op11_collocations")


def plain_divergence(rows, k=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in here for t in set(d[2])).items() if n >= 3}
        counts = {s: Counter() for s in {d[1] for d in here}}
        for _, s, terms in here:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        v = len(kept)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        probability = {s: {t: p(c, t) for t in kept} for s, c in counts.items()}
        of_lang = {t: p(whole, t) for t in kept}
        for s, c in counts.items():
            pair = [(-sum(f(probability[s][t], probability[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            term = [(-f(probability[s][t], of_lang[t]), t.encode(), t) for t in kept if c[t] and probability[s][t] > of_lang[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:k])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


ODD_SOURCES = [
    ("en", "a", None), (None, None, "alpha beta ALPHA"), ("", "", "alpha-beta, gamma2alpha"), (None, "b", "alpha Beta"), ("en", "a", "x y"), ("en", "b", ""), ("de", "only", "Öl öl Öl"), ("de", "only", "ÖL öl"), ("de", "only", "Öl öl"),
    *[("fr", f"s{i % 3}", " ".join(f"w{chr(97 + j)}{chr(97 + i % 5)} common " for j in range(20)) + "é" * i) for i in range(30)], *[("fr", "s9", "")] * 2, *[("es", s, "uno") for s in "ab"],
]


def test_divergence_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD_SOURCES], "lang string, source string, text string, rank int, term string")
    for k, settle in ((200, 4096), (3, 1)):
        got = sorted(tuple(r) for r in divergence.divergence(docs.repartition(3), k=k, settle=settle).collect())
        assert got == plain_divergence(ODD_SOURCES, k)
    assert {r.value for r in divergence.divergence(docs.where("lang = 'es'")).collect()} == {0}
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms_of_long_texts_in_stretches():
    for text in ("", "a", "ab cd", "x" * 40, "ab,Cd " * 9 + "é1É" * 5, " " * 30, "abcdefgh " * 4 + "z" * 50 + " y"):
        want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
        for piece in (1, 2, 3, 7, 16, 100):
            assert [w.decode() for part in divergence._words(text, piece) for w in part] == want


def test_radix_select_ranks_large_values_and_ties_by_bytes(spark):
    rows = [("g", f"{'long prefix ' * 9}{i % 97:03d}é{i}", (i % 5) << 60 if i % 3 else i) for i in range(900)] + [("h", "one", 0), ("h", "", 0)] + [("t", "a" * i, 7) for i in range(1, 40)]
    table = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 200, 899):
        got = {tuple(r) for r in divergence.top(table, ["g"], k, settle=2).select("g", "item", "value").collect()}
        want = {r for g in "ght" for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]}
        assert got == want


def test_divergence_matches_its_sql(spark, sf_dir, db):
    same_as_sql(spark, sf_dir, db, "op13_source_divergence")
