"""Operators on hand-made cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import paths, text
from quillmill.operators import catalog, chunking, compose, folds, gates, grounding, overlap, retrieval, tasks


def one(spark, expr, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Cost-Review Report!", ["costreview", "report"]), ("", []), ("!!!", []), ("A a A", ["a"])],
)
def test_title_words(spark, raw, want):
    assert one(spark, text.title_words(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("O'Brien", "obrien"), ("Jean-Luc Picard", "jean-luc-picard"), ("!!!", ""), ("Zoë  Q_x", "zoë-q-x")])
def test_person_slug(spark, raw, want):
    assert one(spark, text.person_slug(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("raw/a.b.c.md", "extraction/a.b.c.md"), ("wiki/a.md", None), ("raw/../a.md", None), ("/raw/a.md", None)])
def test_extraction_path(spark, raw, want):
    assert one(spark, paths.extraction_path(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("wiki/a/b.md", True), ("wiki/", False), ("wiki/../x", False), ("wiki/a/../b.md", True), ("raw/a.md", False), ("wiki/a/../../wiki/b", True)])
def test_article_path(spark, raw, want):
    assert one(spark, paths.is_article(F.col("t")), t=raw) is want


@pytest.mark.parametrize(("raw", "want"), [("./a/b.md#x", "a/b.md"), ("/a/b", "a/b.md"), ("a", "a.md"), (".//a.md", "a.md")])
def test_citation(spark, raw, want):
    assert one(spark, paths.citation(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "limit", "want"),
    [("a  b\n c", 10, "a b c"), ("hello big world", 11, "hello big…"), ("abcdefghij", 4, "abcd"), ("", 5, "")],
)
def test_flatten(spark, raw, limit, want):
    assert one(spark, text.flatten(F.col("t"), limit), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "head", "body"),
    [("---\na: 1\n---\nbody", "a: 1\n", "body"), (" ---\na: 1\n---", "a: 1\n", ""), ("no\n---\n", "", "no\n---\n"), ("---\na\n ---\nb", "", "---\na\n ---\nb"), ("", "", "")],
)
def test_frontmatter(spark, raw, head, body):
    h, b = text.split_frontmatter(F.col("t"))
    assert (one(spark, h, t=raw), one(spark, b, t=raw)) == (head, body)


@pytest.mark.parametrize(("raw", "want"), [("# T\n\n## O\n\nprose here", "prose here"), ("# Only", "Only"), ("", ""), ("# H\nline", "line"), ("\n\n\nx", "x")])
def test_summary(spark, raw, want):
    assert one(spark, text.summary(F.lit(None).cast("string"), F.col("t")), t=raw) == want
    assert one(spark, text.summary(F.lit(" own "), F.col("t")), t=raw) == "own"


def test_keys(spark):
    body = "| `a` | x |\n|`b`| y |\n| prose | z |\n| `a` | again |\n| `two words` | no |"
    assert one(spark, text.table_keys(F.col("t")), t=body) == "a, b"
    assert one(spark, text.capped_list(F.split("t", ","), 9), t="aaa,bbb,c") == "aaa, …"
    assert one(spark, text.capped_list(F.split("t", ","), 8), t="aaa,bbb") == "aaa, bbb"
    assert one(spark, text.capped_list(F.split("t", ","), 3), t="aaaa,b") == ""


def test_misc_text(spark):
    assert one(spark, text.strip_fence(F.col("t")), t="```md\nx\ny\n```") == "x\ny"
    assert one(spark, text.field_for(text.heading_for(F.col("t"))), t="action_items") == "action_items"
    assert one(spark, text.bounded_join(F.split("t", ","), "-", 4), t="ab,cd") == "ab-c"
    assert one(spark, text.wikilink_target(F.col("t")), t=" A B | shown") == "A B"
    assert len(one(spark, text.truncated(F.col("t"), 100), t="x" * 500)) == 100


# ---- overlap


def sets(spark, *rows):
    return spark.createDataFrame([(i, sorted(set(r))) for i, r in enumerate(rows)], "id long, tokens array<string>")


def brute_pairs(rows, threshold):
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i] and rows[j] and len(rows[i] & rows[j]) / min(len(rows[i]), len(rows[j])) >= threshold}


def test_overlap_pairs(spark):
    assert [(r.i, r.j) for r in overlap.overlap_pairs(sets(spark, "abc", "ade"), 0.3).collect()] == [(0, 1)]
    assert overlap.overlap_pairs(sets(spark, "abc", "ade"), 0.5).count() == 0
    assert overlap.overlap_pairs(sets(spark, "", "a"), 0.1).count() == 0
    rng = random.Random(1)
    rows = [set(rng.choices("abcdefghijklmnop", k=rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, sorted(r)) for i, r in enumerate(rows)], "id long, tokens array<string>")
    for t in (0.2, 0.5, 0.7, 1.0):
        assert {(r.i, r.j) for r in overlap.overlap_pairs(df, t).collect()} == brute_pairs(rows, t)


def test_best_match_ties_go_to_the_earliest(spark):
    new, old = sets(spark, "ab"), spark.createDataFrame([(7, ["a", "b"]), (3, ["a", "b", "c"]), (5, ["a", "b"])], "id long, tokens array<string>")
    assert [tuple(r) for r in overlap.best_matches(new, old).collect()] == [(0, 3, 1.0)]
    # titles that share common words: each meets the first of every list it is on, not all
    titles = [(i, [f"a{i % 2}", f"b{i % 3}", f"c{i % 5}", f"w{i // 3}"]) for i in range(600)]
    df = spark.createDataFrame(titles, "id long, tokens array<string>")
    want = set()
    for i, t in titles:
        s, j = min(((-len(set(t) & set(u)) / 4, j) for j, u in titles[:i]), default=(0, 0))
        want |= {(i, j, -s)} if s <= -0.7 else set()
    assert {tuple(r) for r in overlap.best_matches(df, df, earlier=True).collect()} == want and want
    assert overlap._seen(df, df, 1, True).count() <= 600 * 15


def test_pairs_by_several_shared_words_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "_MET", 3)  # so that few sets crowd a word
    rng = random.Random(7)
    words = [f"r{i}" for i in range(40)] + ["a", "b", "c", "d"] * 15
    made = [(i, sorted(set(rng.choices(words, k=rng.randint(0, 8))))) for i in range(150)]
    made += [(200 + i, made[3 * (i % 2)][1]) for i in range(20)]  # copies
    df = spark.createDataFrame(made, "id long, tokens array<string>")
    for threshold in (0.3, 0.7):
        score = {(i, j): len(set(t) & set(u)) / min(len(t), len(u)) for i, t in made for j, u in made if i < j and set(t) & set(u)}
        pairs = overlap.overlap_pairs(df, threshold)
        assert sorted(tuple(r) for r in pairs.collect()) == sorted((i, j, s) for (i, j), s in score.items() if s >= threshold)
        assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()  # what meets is judged in the join, not gathered first


def test_relevance(spark):
    article = spark.createDataFrame([(1, ["pricing", "model"]), (2, ["pricing"]), (3, ["other"])], "id long, tokens array<string>")
    got = [(r["rank"], r.article_id, r.score) for r in overlap.relevance(sets(spark, ["pricing", "model"]), article).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0)]


def test_relevance_equals_all_pairs_and_meets_few(spark):
    rng = random.Random(5)
    words = [f"r{i}" for i in range(60)] + ["the", "of"] * 40
    make = lambda n, most: [(7 * i % 1009, sorted(set(rng.choices(words, k=rng.randint(0, most))))) for i in range(n)]
    items, articles = make(60, 7), make(400, 5)
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (items, articles))
    for k in (1, 3, 20):
        want = set()
        for i, t in items:
            scored = sorted((-len(set(t) & set(u)) / min(len(t), len(u)), j) for j, u in articles if set(t) & set(u))
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
        assert {tuple(r) for r in overlap.relevance(a, b, k).collect()} == want
    # a word of all titles: only titles that hold the kth score off are met
    common = spark.createDataFrame([(i, ["all", f"w{i}"]) for i in range(2000)], "id long, tokens array<string>")
    asked = spark.createDataFrame([(i, ["all", f"w{i}", f"w{i + 1}", "none"]) for i in range(0, 1000, 10)], "id long, tokens array<string>")
    assert {(r.item_id, r["rank"], r.article_id) for r in overlap.relevance(asked, common, 2).collect()} == {(i, j + 1, i + j) for i in range(0, 1000, 10) for j in (0, 1)}
    assert overlap._seen(asked, common, 2).count() <= 100 * 4
    # words of half of all titles: only the first titles of what an item has in common with them are met
    pairs = [(i, [f"a{i % 2}", f"b{i % 3}", f"w{i}"]) for i in range(1200)]
    titles = spark.createDataFrame(pairs, "id long, tokens array<string>")
    some = spark.createDataFrame(pairs[:120], "id long, tokens array<string>")
    nearest = lambda t: sorted((-len(set(t) & set(u)) / 3, j) for j, u in pairs if set(t) & set(u))[:3]
    assert {(r.item_id, r["rank"], r.article_id) for r in overlap.relevance(some, titles, 3).collect()} == {(i, r + 1, j) for i, t in pairs[:120] for r, (_, j) in enumerate(nearest(t))}
    assert overlap._seen(some, titles, 3).count() <= 120 * 12


def test_cluster_cap(spark):
    df = sets(spark, *["xyz"] * 10)
    got = overlap.cluster(overlap.overlap_pairs(df, 0.3), df, cap=4).groupBy("group_id").count().collect()
    assert sum(r["count"] for r in got) == 10 and max(r["count"] for r in got) <= 4


def test_parts_stop_where_links_leave_them():
    import pandas as pd

    links = [(1, 2, True, 0.9), (2, 9, False, 0.8), (1, 3, True, 0.7), (3, 4, True, 0.6), (5, 6, True, 0.5), (6, 8, False, 0.4)]
    frame = pd.DataFrame([(a, 1, b, 1, within, s, a, b) for a, b, within, s in links], columns=["a", "na", "b", "nb", "within", "overlap", "i", "j"])
    got = overlap._merged_in_order(frame, 4)
    assert {tuple(r) for r in got.itertuples(index=False)} == {(2, 1, 2), (1, 1, 2), (6, 5, 2), (5, 5, 2)}  # 1 and 2 wait for 9, so 3 waits, and 4 for 3


def test_clusters_are_those_of_links_taken_in_order(spark):
    rng = random.Random(8)
    pairs = sorted({(rng.choice([0.5, 0.6, 0.75, 1.0]), *sorted(rng.sample(range(30), 2))) for _ in range(50)}, reverse=True)
    group = {i: {i} for i in range(35)}
    for _, i, j in pairs:
        if group[i] is not group[j] and len(group[i]) + len(group[j]) <= 4:
            group[i] |= group[j]
            for x in group[j]:
                group[x] = group[i]
    edges = spark.createDataFrame([(i, j, o) for o, i, j in pairs], "i long, j long, overlap double").dropDuplicates(["i", "j", "overlap"])
    for in_task in (10_000, 20):  # all at once in tasks, and mostly in rounds
        got = overlap.cluster(edges, spark.range(35), cap=4, in_task=in_task)
        assert {r.id: r.group_id for r in got.collect()} == {i: min(g) for i, g in group.items()}


def test_clusters_take_few_rounds_where_texts_have_many_links(spark, monkeypatch):
    import itertools

    pairs = sorted(((1.0 if i % 3 == j % 3 else 0.5, i, j) for i, j in itertools.combinations(range(120), 2)), reverse=True)
    group = {i: {i} for i in range(120)}
    for _, i, j in pairs:
        if group[i] is not group[j] and len(group[i]) + len(group[j]) <= 8:
            group[i] |= group[j]
            for x in group[j]:
                group[x] = group[i]
    edges = spark.createDataFrame([(i, j, o) for o, i, j in pairs], "i long, j long, overlap double")
    tables, old = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df: tables.append(0) or old(df))
    got = overlap.cluster(edges, spark.range(120), in_task=1000)  # one component of 7,140 links
    assert {r.id: r.group_id for r in got.collect()} == {i: min(g) for i, g in group.items()}
    assert len(tables) <= 22  # three a round


def test_pairs_of_one_common_word_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "_CELL", 50)
    df = sets(spark, *(["common", f"w{i}"] for i in range(300)), ["common"], ["other"])
    got = overlap.overlap_pairs(df, 0.3).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.i, r.j) for r in got}) == len(got) == 301 * 300 // 2
    assert all(r.overlap == (1.0 if 300 in (r.i, r.j) else 0.5) for r in got)
    assert max(Counter(r.task for r in got).values()) < 0.6 * len(got)


def test_election(spark):
    df = sets(spark, ["foo", "bar"], ["foo", "bar"], ["else"], ["foo", "bar", "baz"])
    got = {r.id: (r.kept, r.merged_into) for r in overlap.elect(df).collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (True, 2), 3: (False, 0)}


def test_election_of_one_large_component(spark):
    rng = random.Random(3)
    rows = [[], *(rng.sample("abcdefghijklmnop", rng.choice([1, 2, 3, 4, 4, 4])) for _ in range(300)), []]
    rows += [rows[9], rows[40][::-1], rows[200]]
    kept, want = [], {}
    for i, words in enumerate(map(set, rows)):
        shares = [(len(words & rest) / min(len(words), len(rest)), -j) for j, rest in kept if words and rest]
        best = max(shares, default=(0, 0))
        want[i] = (best[0] < 0.7, i if best[0] < 0.7 else -best[1])
        if best[0] < 0.7:
            kept.append((i, words))
    df = sets(spark, *rows)
    got = overlap.elect(df)
    assert {r.id: (r.kept, r.merged_into) for r in got.collect()} == want
    # no component is handed to one task
    assert "InPandas" not in got._jdf.queryExecution().toString()


# ---- chunks


def plain_chunks(content, limit):
    if len(content) <= limit:
        return [content]
    out, cur, size = [], [], 0
    for line in content.split("\n"):
        if size + len(line) > limit and cur:
            out, cur, size = [*out, "\n".join(cur)], [], 0
        if len(line) > limit:
            out += [line[i : i + limit] for i in range(0, len(line), limit)]
        else:
            cur.append(line)
            size += len(line) + 1
    return [*out, "\n".join(cur)] if cur else out


def test_chunks(spark):
    rng = random.Random(2)
    rows = ["\n".join("x" * rng.choice([0, 1, 5, 9, 10, 11, 25]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", chunking.chunk_lines(F.col("t"), 10).alias("c")).collect()
    assert all(r.c == plain_chunks(r.t, 10) for r in got)


def test_transcript(spark):
    body = "**@ann** 10:00 hi there\nmore\n**@bob.x** 10:05 yes\n**@ann** 10:09 bye"
    got = one(spark, chunking.chunk_transcript(F.col("t"), F.lit("Meeting"), 39), t=body)
    assert got == [
        "Meeting\nSpeakers: ann, bob.x\nTime: 10:00 - 10:00\n\n**@ann** 10:00 hi there\nmore",
        "Meeting\nSpeakers: ann, bob.x\nTime: 10:05 - 10:05\n\n**@bob.x** 10:05 yes",
        "Meeting\nSpeakers: ann, bob.x\nTime: 10:09 - 10:09\n\n**@ann** 10:09 bye",
    ]
    assert one(spark, chunking.chunk_transcript(F.col("t"), F.lit("M")), t=body) == [body]


def test_budgets(spark):
    lines = [4, 6, 1, 99, 8, 3]
    df = spark.createDataFrame([("s", i, "x" * (n - 1)) for i, n in enumerate(lines)], "source string, path int, line string")
    assert [r.batch for r in chunking.pack_batches(df, 10, "source", ["path"]).orderBy("path").collect()] == [0, 0, 1, None, 1, 2]


def test_batches_over_ranges_are_those_of_a_plain_loop(spark):
    rng = random.Random(12)
    rows = [(g, i, "x" * rng.randint(0, 25)) for g, n in (("hot", 3000), ("b", 40), (None, 200), ("c", 1)) for i in range(n)]
    want = {}
    for g in ("hot", "b", None, "c"):
        number = size = 0
        for _, i, line in (r for r in rows if r[0] == g):
            cost = len(line) + 1
            if cost > 20:
                want[g, i] = None
                continue
            if size and size + cost > 20:
                number, size = number + 1, 0
            size += cost
            want[g, i] = number
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "source string, path int, line string")
    got = chunking.pack_batches(df, 20, "source", ["path"])
    assert {(r.source, r.path): r.batch for r in got.collect()} == want and got.columns == ["source", "path", "batch"]
    assert chunking.pack_batches(df.limit(0), 20, "source", ["path"]).count() == 0
    assert one(spark, chunking.halving_fit(F.array_repeat(F.lit(9), 37), 100)) == 9
    assert one(spark, chunking.halving_fit(F.array_repeat(F.lit(200), 3), 100)) == 0
    words = spark.createDataFrame([(["a", "bc", "d", "e"], "text")], "w array<string>, t string")
    fitted = words.select(*chunking.fit_fields({"w": (F.col("w"), True), "t": (F.col("t"), False)}, 6).values())
    assert tuple(fitted.first()) == (["a", "bc"], "t")
    assert "<= aggregate(" not in fitted._jdf.queryExecution().optimizedPlan().toString()  # what fits is counted once, not for every try
    assert one(spark, chunking.strategy(F.lit("auto"), F.lit(3))) == "summarize"
    with pytest.raises(Exception, match="unknown strategy"):
        one(spark, chunking.strategy(F.lit("odd"), F.lit(3)))
    assert tuple(one(spark, chunking.fan_out(F.lit(20), F.lit(10)))) == (3, True, 10)
    assert one(spark, chunking.merge_mode(F.lit(30_000), F.lit(1))) == "diff"


# ---- composition


ARTICLE = "---\ntitle: T\nupdated: 2020-01-01\nsources:\n  - raw/a.md\ntags: [x]\n---\n\n# T\n\n## One\n\na\n\n### Sub\n\nb\n\n## Two\n\nc"


def test_patches():
    out = compose.patched(ARTICLE, [{"action": "append_to_section", "section": "## One", "content": "added"}, {"action": "new_section", "after": "## One", "heading": "## Mid", "content": "m"}, {"action": "odd"}], "raw/b.md", "2024-05-05")
    assert out.startswith("---\ntitle: T\nupdated: 2024-05-05\nsources:\n  - raw/a.md\n  - raw/b.md\ntags: [x]\n---\n")
    assert out.index("### Sub") < out.index("added") < out.index("## Mid") < out.index("## Two")
    again = compose.patched(ARTICLE, [], "raw/a.md", "2024-05-05")
    assert again.count("raw/a.md") == 1
    assert compose.patched("plain", [{"action": "append_to_section", "section": "## None", "content": "x"}], "s", "d") == "plain\n\n## None\n\nx\n"


def test_sections_kept_by_topic():
    body = "intro\n## Alpha\n" + "a" * 30 + "\n## Beta\n" + "b" * 30
    out = compose.kept_sections(body, {"beta"}, 70)
    assert "## Alpha" in out and "b" * 30 in out and "a" * 30 not in out


def test_combine_is_ordered(spark):
    rows = [("k", 2, "r2", "s2", ["b", "a"]), ("k", 1, "r1", "s1", ["c", "a"]), ("k", 3, "r3", "s3", None)]
    got = compose.combine(spark.createDataFrame(rows, "k string, o int, ref string, summary string, topics array<string>"), "k", ["o"]).first()
    assert (got.summary, got.topics, got.refs) == ("s1\ns2\ns3", ["a", "b", "c"], ["r1", "r2", "r3"])


# ---- gates, catalog


def test_lag_ignores_what_was_never_recorded(spark):
    state = spark.createDataFrame([("a", "v1", "w2"), ("b", None, "w1"), ("gone", "v1", "w1")], "rel_path string, prompt_version string, write_prompt_version string")
    got = {tuple(r) for r in gates.lag(spark.createDataFrame([("a",), ("b",)], "rel_path string"), state, "v2", "w2").collect()}
    assert got == {("a", True, False), ("b", False, True)}


def test_resolve(spark):
    articles = spark.createDataFrame([(["raw/a.md, raw/b.md", "raw/b.md"],), (["/etc/x", "../y", "wiki/z.md", "raw/none.md", " "],)], "sources array<string>")
    raw = spark.createDataFrame([("raw/a.md",), ("raw/b.md",)], "rel_path string")
    got = {tuple(r) for r in catalog.resolve_documents(articles, raw).collect()}
    assert got == {("raw/a.md", "ok"), ("raw/b.md", "ok"), ("/etc/x", "escapes_kb"), ("../y", "escapes_kb"), ("wiki/z.md", "not_a_raw_document"), ("raw/none.md", "document_missing")}


def test_selection(spark):
    choice = spark.createDataFrame([("q", ["a0", "made", "42", "a1", "a0"])], "question string, paths array<string>")
    entries = spark.createDataFrame([("a0",), ("a1",)], "path string")
    assert [(r["rank"], r.path) for r in catalog.selected(choice, entries).orderBy("rank").collect()] == [(1, "a0"), (2, "a1")]
    assert catalog.invented(choice, entries).first().dropped == 2


# ---- people, prices, tasks


def test_people(spark):
    people = spark.createDataFrame([(0, "Ann Lee", ["al"]), (1, "Bob", ["al", "bobby"])], "ord int, canonical string, aliases array<string>")
    articles = spark.createDataFrame([("wiki/a.md", "A", "[[AL|x]] [[Bobby]] [[nobody]]"), ("wiki/b.md", "B", "[[ann lee]]")], "path string, title string, text string")
    assert {tuple(r) for r in retrieval.mentions(articles, people).collect()} == {("Bob", 2, 1), ("Ann Lee", 1, 1)}
    own = spark.createDataFrame([("wiki/people/bob.md", False)], "path string, is_stub boolean")
    many = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("path"), F.format_string("t%04d", "id").alias("title"), F.lit("[[Ann Lee]] [[ann]]").alias("text"))
    stubs = retrieval.person_stubs(many, people.where("canonical = 'Ann Lee'").withColumn("aliases", F.array(F.lit("ann"))), own)
    assert stubs.first().summary == "Person stub, 2000 mentions in: " + ", ".join(f"t{i:04}" for i in range(22)) + ", …"
    assert "collect_set" not in stubs._jdf.queryExecution().optimizedPlan().toString()  # a person's titles are not brought together
    assert [tuple(r) for r in retrieval.person_stubs(articles, people, own).collect()] == [("wiki/people/ann-lee.md", "Ann Lee", "Person stub, 1 mention in: B")]


def test_prices(spark):
    names = ["claude-sonnet-4-20250514", "x.opus-4-6", "gpt-4o", "acme-GPT-4O-x"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert [(r.input, r.priced) for r in tasks.resolve_prices(df).collect()] == [(3.0, True), (5.0, True), (0.0, False), (0.0, False)]
    assert [r.input for r in tasks.resolve_prices(df, [("gpt-4o", 2.5, 10.0)]).collect()] == [3.0, 5.0, 2.5, 2.5]


def test_folds_over_ranges_equal_a_walk(spark):
    rng = random.Random(8)
    rows, at = [], 0.0
    for i in range(1500):
        at += rng.choice([0, 0, 1, 4, 40])
        rows.append(("hot" if i % 5 else f"k{i % 4}", i, at, rng.random() < 0.55))
    rows.append((None, 5000, 1.0, True))
    df = spark.createDataFrame(rows, "k string, i long, at double, bad boolean").repartition(7)
    breaker, toggle = folds.Breaker(3, 30.0), folds.Toggle(4)
    want_states, want_cached = {}, {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        seen = breaker.walk(breaker.start, np.array([r[2] for r in mine]), np.array([r[3] for r in mine]))[0]
        want_states |= {r[1]: s for r, s in zip(mine, seen, strict=True)}
        want_cached |= {r[1]: s for r, s in zip(mine, toggle.walk(toggle.start, np.array([r[3] for r in mine]))[0], strict=True)}
    out = folds.breaker_states(df, "k", ["i"], "at", "bad", 3, 30.0)
    assert {r.i: r.state for r in out.collect()} == want_states and {"open", "closed", "rejected"} == set(want_states.values())
    assert {r.i: r.cached for r in folds.cache_states(df, "k", ["i"], "bad", 4).collect()} == want_cached
    assert folds.cache_states(df.limit(0), "k", ["i"], "bad").count() == 0


@pytest.mark.parametrize("seed", range(300))
def test_fold_tables_say_what_walks_do(seed):
    rng = random.Random(seed)
    n, threshold, cooldown = rng.randint(1, 14), rng.randint(1, 4), rng.choice([0.0, 1.0, 3.0, 10.0])
    at, failed = np.sort(np.array([rng.choice([0, 1, 2, 3, 5, 8, 13]) + rng.random() * rng.choice([0, 1]) for _ in range(n)])), np.array([rng.random() < 0.6 for _ in range(n)])
    breaker, toggle = folds.Breaker(threshold, cooldown), folds.Toggle(threshold)
    plain = lambda s: (s[0], s[1] if s[0] else 0, 0 if s[0] else s[2])
    for state in [[False, 0.0, k] for k in range(threshold)] + [[True, at[0] - x, threshold] for x in (0, 0.5, 1, 2.9, 3, 9, 20)]:
        assert plain(breaker.apply(breaker.table(at, failed), state)) == plain(breaker.walk(state, at, failed)[1])
    for state in [[k, False] for k in range(threshold)] + [[threshold, True]]:
        got, want = toggle.apply(toggle.table(failed), state), toggle.walk(state, failed)[1]
        assert got[1] == want[1] and (want[1] or got[0] == want[0])


def test_breaker(spark):
    outcomes = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (10, False), (36, True), (50, False), (70, False), (71, True)]
    df = spark.createDataFrame([("k", i, float(at), bad) for i, (at, bad) in enumerate(outcomes)], "k string, i int, at double, bad boolean")
    got = [r.state for r in folds.breaker_states(df, "k", ["i"], "at", "bad", threshold=3).orderBy("i").collect()]
    assert got == ["closed", "closed", "closed", "closed", "closed", "open", "rejected", "open", "rejected", "closed", "closed"]


# ---- grounding


def test_leading_name(spark):
    cases = [
        ("| `MaxConns` | x |", "MaxConns"), ("|---|:--|", ""), ("- `func NewServer(c Conf) *Server`", "NewServer"), ("- `func (s *Srv) Start()`", "Start"), ("- **bold** text", ""), ("- Auth word", ""),
        ("- rest.Config: x", "rest.Config"), ("- e.g. x", ""), ("- 30s", ""), ("- [[Link]]", ""), ("- `/usr/bin/x`", ""), ("1. snake_case,", "snake_case"), ("| | `B2` |", "B2"), ("prose MaxConns", ""), ("- `Map[K, V]`", "Map"), ("* **`Auth`**", "Auth"),
        ("  - `return nil`", ""), ("| 10.5ms | x |", ""), ("- `type Conf struct`", "Conf"), ("- (`x`)", ""), ("", ""), ("- `x`", ""), ("|  plain cell | `Other` |", ""),
    ]
    df = spark.createDataFrame(cases, "line string, name string").withColumn("got", grounding.leading_name(F.col("line")))
    assert [(r.line, r.got) for r in df.collect()] == cases


def test_named_items(spark):
    text = "- `First`\n```\n- `Fenced`\n```\n| `Second_one` | x |\n- `First`\n~~~\n- `Open`"
    got = grounding.named_items(spark.createDataFrame([("a", text), ("b", "")], "article string, text string"))
    assert {tuple(r) for r in got.collect()} == {("a", "First", 1), ("a", "Second_one", 5)}


def test_unsourced(spark):
    names = spark.createDataFrame([("a", "Shedder"), ("a", "syncx.Limit"), ("a", "syncx.Auth"), ("b", "Gone")], "article string, name string")
    sources = spark.createDataFrame([("a", "Shedding uses SYNCX and a limit"), ("b", "nothing")], "article string, text string")
    assert {tuple(r) for r in grounding.unsourced(names, sources).collect()} == {("a", "Shedder"), ("a", "syncx.Auth"), ("b", "Gone")}


# ---- headers


@pytest.mark.parametrize(
    ("raw", "want"),
    [("---\ntitle: 'A b'\n---\n# X", "A b"), ("text\n# H1 \n", "H1"), ("plain", "stem"), ("﻿# B", "B"), ("---\nother: 1\n---\n## no\n# yes", "yes")],
)
def test_title(spark, raw, want):
    assert one(spark, text.title(F.col("t"), F.lit("stem")), t=raw) == want


def test_frontmatter_dialects(spark):
    commented = "<!-- a -->\n<!-- b\n c -->\n\n---\nk: v\n---\nbody"
    h, b = text.document_frontmatter(F.col("t"))
    assert (one(spark, h, t=commented), one(spark, b, t=commented)) == ("k: v\n", "body")
    prose = "<!-- a -->\n\n---\nno field here\n---\nbody"
    assert one(spark, b, t=prose) == prose
    sh, sb = text.strict_frontmatter(F.col("t"))
    assert (one(spark, sh, t="---\nk: v\n---\n\n body "), one(spark, sb, t="---\nk: v\n---\n\n body ").strip()) == ("k: v", "body")
    assert one(spark, sh, t=" ---\nk: v\n---\n") == ""


def test_transcript_header(spark):
    n, t, rest = text.transcript_header(F.col("t"))
    raw = "# Weekly\n> on 10:00 - 11:30 here\n\nfirst\n# later"
    assert (one(spark, n, t=raw), one(spark, t, t=raw), one(spark, rest, t=raw)) == ("Weekly", "10:00 - 11:30", "first\n# later")
    assert one(spark, text.labelled_lines(topic=F.lit("x"), no=F.lit(None).cast("string"), meeting_time=F.lit("1"))) == "topic: x\nmeeting time: 1"
    assert one(spark, text.string_list(F.lit('["a", 1, "b", "c", "d"]'))) == ["a", "b", "c"] and one(spark, text.string_list(F.lit("{}"))) == []
