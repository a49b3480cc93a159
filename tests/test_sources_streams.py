"""Files in and out, streams, and the composite pipelines with the offline endpoint."""

import io
import json
import os
import random
import re
import threading
import time
import zipfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from html import unescape

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import paths
from quillmill.operators import state
from quillmill.plans import knowledge, serial
from quillmill.plans.model import CutOff, OfflineEndpoint, Patience, Unavailable, answered
from quillmill.sources import extractions, html, markdown, raw, sinks
from quillmill.streaming import incremental, items, leases


def test_scan_and_ingest(spark, tmp_path):
    root = tmp_path / "kb"
    for name, data in {"raw/a.md": b"x\r\ny", "raw/sub/b.md": "é".encode(), "raw/_skipped/c.md": b"no", "raw/.hid.md": b"no", "raw/d.txt": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.rel_path: (r.size_bytes, len(r.checksum)) for r in raw.scan(spark, str(root)).collect()}
    assert got == {"raw/a.md": (3, 16), "raw/sub/b.md": (2, 16)}
    src = tmp_path / "src"
    for name, data in {"m/a.py": b"print(1)", "n.md": b"# N", "node_modules/x.js": b"no", "bad.txt": b"\xff\xfe\x00", "p.bin": b"1"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    good, bad = raw.ingest(spark, str(src))
    assert {r.rel_path: r.text for r in good.collect()} == {"raw/m__a.py.md": "<!-- source: m/a.py -->\n\nprint(1)", "raw/n.md": "<!-- source: n.md -->\n\n# N"}
    assert {tuple(r) for r in bad.collect()} == {("bad.txt", "undecodable"), ("p.bin", "not a text suffix")}


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_uploads(spark):
    files = spark.createDataFrame([("a.md", 5), ("b.exe", 5), ("c.txt", 2_000_000), ("d.md", 0), ("e.PDF", 5_000_000)], "name string, size_bytes long")
    assert {(r.name, r.status) for r in raw.upload_verdicts(files).collect()} == {("a.md", "uploaded"), ("b.exe", "failed"), ("c.txt", "failed"), ("d.md", "failed"), ("e.PDF", "uploaded")}
    zips = [("ok", archive(**{"a.md": "x", "__MACOSX/b": "y", ".h.md": "z"})), ("climb", archive(**{"a.md": "x", "../b.md": "y"})), ("type", archive(**{"a.exe": "x"})), ("none", b"no zip")]
    good, bad = raw.unzip(spark.createDataFrame(zips, "name string, content binary"))
    assert [tuple(r) for r in good.collect()] == [("ok", "a.md", "x")]
    assert {r.archive for r in bad.collect()} == {"climb", "type", "none"}
    known = spark.createDataFrame([], "content_hash string")
    new, dup = raw.submit(spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "name string, text string"), known)
    assert {r.name for r in new.collect()} == {"a", "c"} and [r.name for r in dup.collect()] == ["b"]


ANSWER = '{"summary": "s", "topics": ["b", 42, "a", "b"], "concepts": ["bare", {"title": "T", "summary": "x", "extra": 1}, 7], "claims": [{"claim": "c", "surprising": true}], "more": 1}'


def test_extraction_layer(spark, tmp_path):
    df = extractions.from_model(spark.createDataFrame([("raw/a.md", ANSWER), ("raw/b.md", "no json")], "source string, answer string"))
    rows = {r.source: r for r in df.collect()}
    assert rows["raw/a.md"].topics == ["a", "b"] and [c.title for c in rows["raw/a.md"].concepts] == ["bare", "T"] and rows["raw/a.md"].claims[0].surprising
    assert rows["raw/b.md"].bad_answer and rows["raw/b.md"].topics == []
    whole = df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in extractions.SCHEMA.fields if f.name not in df.columns and f.name not in ("counts", "schema_version")))
    path = str(tmp_path / "x")
    extractions.persist(whole, path)
    good, bad = extractions.load(spark, path)
    assert good.count() == 2 and bad.count() == 0
    broken = good.withColumn("schema_version", F.when(F.col("source") == "raw/a.md", 1).otherwise(2)).withColumn("claims", F.when(F.col("source") == "raw/b.md", F.lit(None).cast(extractions.SCHEMA["claims"].dataType)).otherwise(F.col("claims")))
    broken.write.parquet(path + "2")
    assert {tuple(r) for r in extractions.load(spark, path + "2")[1].collect()} == {("raw/a.md", "unknown version"), ("raw/b.md", "section claims missing")}
    assert extractions.headers(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].count("topics") == 0


def test_usage_dialects(spark):
    rows = [('{"prompt_tokens": 9, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 4}}',), ('{"prompt_tokens": 9, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 1}',), ("bad",)]
    got = extractions.usage(spark.createDataFrame(rows, "usage string")).collect()
    assert [(r.prompt_tokens, r.completion_tokens, r.cached_tokens, r.cache_created_tokens) for r in got] == [(9, 2, 4, 0), (9, 0, 3, 1), (0, 0, 0, 0)]


def test_html():
    page = '<html><title>A &amp; B</title><script>x="</p>"</script><nav>menu</nav><!-- no --><p>One <b>two</b><p>Three <a href="/x">link</a><table><tr><td>a</td><td>b</td></tr></table>'
    assert html.visible(page) == ("A & B", "One two\nThree [link](/x)\na | b")


def test_html_main_content_of_pages(sf_dir):
    pages = [r["html"] for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()]
    kept = right = wanted = 0
    for page in pages:
        inner = page[page.index("<article>") : page.index("</article>")]
        want = Counter(x for x in (" ".join(unescape(re.sub("<[^>]*>", "", y)).split()) for y in re.split("<p>|</p>|<h1>|</h1>", inner)) if x)
        got = Counter(html.visible(page)[1].split("\n"))
        kept, right, wanted = kept + got.total(), right + (got & want).total(), wanted + want.total()
    assert right / kept > 0.95 and right / wanted > 0.95


def test_html_main_content_without_telling_elements():
    text = "A paragraph that has a good many words, as paragraphs of articles have, and ends like one."
    page = f'<div><a href=/>Home</a> <a href=/b>All</a></div><h2>On it</h2><p>{text}</p><p>Short.</p><p>{text} <a href="/y">More</a></p><div class="side-bar"><p>{text}</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>'
    assert html.visible(page)[1] == f"On it\n{text}\nShort.\n{text} [More](/y)"
    assert html.visible("") == html.visible("<nav>menu</nav>") == ("", "") and html.visible("a < b &amp; c <3 d") == ("", "a < b & c <3 d")


@pytest.mark.parametrize("part", ["<", "<script ", "<!--", '<a href="', '<a href="x">y', "<b>", "<div>", "</div>", "<p><b>", "<li><td>", "<title>", "&amp", "<a ='", '<div class="ad x">t'])
def test_html_time_is_linear(part):
    def seconds(size):
        page = part * (size // len(part))
        began = time.process_time()
        html.visible(page)
        return time.process_time() - began

    few = seconds(300_000)
    assert seconds(1_200_000) < 9 * few + 0.5


def test_event_lines(spark):
    frames = spark.createDataFrame([('data: {"type": "delta", "text": "x"}\n\ndata: {"type": "odd"}\n\n',)], "value string")
    assert [r.type for r in sinks.parse_events(frames).collect()] == ["delta", None]


LOG = [
    ("t", 1, 0, "submit", None, None), ("t", 2, 10, "claim", "w1", 100), ("t", 3, 50, "heartbeat", "w1", 100), ("t", 4, 200, "claim", "w2", 100), ("t", 5, 210, "ack", "w1", None), ("t", 6, 220, "nack", "w2", None),
    ("t", 7, 230, "claim", "w3", 50), ("t", 8, 240, "ack", "w3", None), ("u", 1, 0, "claim", "w1", 10), ("u", 2, 5, "submit", None, None), ("u", 3, 6, "cancel", None, None),
]
WANT = {("t", 1, True, "pending"), ("t", 2, True, "running"), ("t", 3, True, "running"), ("t", 4, True, "running"), ("t", 5, False, "running"), ("t", 6, True, "pending"), ("t", 7, True, "running"), ("t", 8, True, "succeeded"), ("u", 1, False, "absent"), ("u", 2, True, "pending"), ("u", 3, True, "cancelled")}


def test_leases_batch_and_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, leases.EVENTS)
    assert {(r.task_id, r.seq, r.accepted, r.status) for r in leases.replay(log).collect()} == WANT
    assert [(r.task_id, r.seq) for r in leases.late(leases.replay(log)).collect()] == [("t", 5)]
    log.where("seq <= 4").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: leases.transitions(spark.readStream.schema(leases.EVENTS).parquet(str(tmp_path / "e")), timers=False).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    stream()
    log.where("seq > 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream()
    assert {(r.task_id, r.seq, r.accepted, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == WANT


def test_idle_leases_run_out_and_finished_tasks_are_forgotten(spark, tmp_path):
    now = int(time.time() * 1000)
    rows = [("idle", 1, now, "submit", None, None), ("idle", 2, now, "claim", "w1", 1500), ("done", 1, now, "submit", None, None), ("done", 2, now, "claim", "w2", 60_000), ("done", 3, now, "ack", "w2", None), ("live", 1, now, "submit", None, None)]
    spark.createDataFrame(rows, leases.EVENTS).coalesce(1).write.parquet(str(tmp_path / "e"))
    changes = leases.transitions(spark.readStream.schema(leases.EVENTS).parquet(str(tmp_path / "e")), retention_ms=1000)
    q = changes.writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        end, kinds, states = time.time() + 90, [], []
        while time.time() < end and not ("expired" in kinds and states and states[-1] == 2):
            time.sleep(0.5)
            kinds = [r.kind for r in spark.sql("SELECT * FROM leases").collect()]
            states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
        found = {(r.task_id, r.kind): r.status for r in spark.sql("SELECT * FROM leases").collect()}
        assert found["idle", "expired"] == "pending" and ("done", "expired") not in found and ("live", "expired") not in found
        assert max(states) == 3 and states[-1] == 2  # the task that ended is gone, those that live are there
    finally:
        q.stop()


def test_items_are_reported_once_over_restarts(spark, tmp_path):
    results, expected = "item string, article string, error string", "item string, n int"
    add = lambda name, n, schema, *rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / str(n)))

    def go():
        read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
        out = items.finished(read("expected", expected), read("results", results))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(items.OUT).parquet(str(tmp_path / "out")).collect())

    add("expected", 1, expected, ("a", 2), ("b", 1), ("none", 0))
    add("results", 1, results, ("a", "x", None), ("a", "x", None), ("late", "y", "E1"))
    assert go() == [("none", 0, 0, "")]
    add("results", 2, results, ("a", "x", None), ("a", "z", "bad"), ("b", "x", "worse"), ("b", "x", "worse"))
    both = [("a", 2, 1, "bad"), ("b", 1, 1, "worse"), ("none", 0, 0, "")]
    assert go() == both
    add("results", 3, results, ("a", "z", "bad"), ("b", "x", None))
    add("expected", 2, expected, ("late", 1))
    assert go() == sorted([*both, ("late", 1, 1, "E1")])


def flaky(root):
    class Flaky(OfflineEndpoint):
        """Unavailable and cut off by the rules of a row; every call leaves a file."""

        def __init__(self, root):
            self.root = root

        def complete(self, task, p):
            with open(f"{self.root}/{p['id']}.{time.monotonic_ns()}", "w") as f:
                f.write(str(p["room"]))
            made = len([x for x in os.listdir(self.root) if x.startswith(f"{p['id']}.")])
            if made <= p["down"]:
                raise Unavailable(f"503 the {made}. time")
            if p["room"] < p["needs"]:
                raise CutOff("length")
            if p["needs"] < 0:
                raise ValueError("no such thing")
            return f"answer {p['id']}"

    return Flaky(root)


def test_calls_are_made_again_as_often_as_it_may_help(spark, tmp_path):
    rows = [("fine", 0, 1), ("twice", 2, 1), ("down", 9, 1), ("long", 0, 10_000), ("endless", 0, 10**6), ("wrong", 0, -1), ("both", 1, 5_000)]
    df = spark.createDataFrame(rows, "id string, down int, needs int")
    waits, clock = [], [0.0]

    def sleep(s):
        waits.append(s)
        clock[0] += s

    run = lambda root, **more: {r.id: (r.answer, r.error) for r in answered(df, flaky(str(root)), "x", ["id"], "id string", Patience(clock=lambda: clock[0], sleep=sleep, **more)).collect()}
    first, second = tmp_path / "1", tmp_path / "2"
    first.mkdir()
    second.mkdir()
    got = run(first)
    calls = Counter(x.split(".")[0] for x in os.listdir(first))
    assert calls == {"fine": 1, "twice": 3, "down": 3, "long": 3, "endless": 5, "wrong": 1, "both": 3}
    assert got == {"fine": ("answer fine", None), "twice": ("answer twice", None), "down": (None, "503 the 3. time"), "long": ("answer long", None), "endless": (None, "answer cut off at 64000 tokens"), "wrong": (None, "no such thing"), "both": ("answer both", None)}
    assert sum(waits) == 30.0
    waits.clear()
    clock[0] = 0.0
    got = run(second, deadline=75.0)  # there is time to wait 10 seconds, but not 20 more
    assert got["twice"] == got["down"] == (None, "deadline_too_close") and got["both"][0] == "answer both" and waits == [10.0]
    assert answered(df.limit(0), flaky(str(second)), "x", ["id"], "id string").count() == 0


def test_extractions_as_markdown_files(spark, tmp_path):
    long = "x\n## Claims\n---\n" * 2000
    rows = [
        ("raw/a.md", "s1", "m", "chunked", "p1", None, 2, None, "a \"summary\"\n---\nof lines", ["t2", "t1"], [("One", "é"), ("## Two", None)], [], [], [("do", None)], [("c1", "s", True), (long, None, None)], [("e", "k", False, ["x", "y"])]),
        ("raw/b.md", "s2", None, None, None, None, 2, "big", "", [], [], [("n", "t", "c")], [("d", "w", "y", ["p"])], [], [], []),
    ]
    schema = T.StructType([f for f in extractions.SCHEMA.fields if f.name != "counts"])
    df = spark.createDataFrame([dict(zip(extractions.SCHEMA.fieldNames(), r, strict=False)) for r in rows], schema)
    texts = df.select("source", markdown.serialise().alias("content"))
    again = markdown.parse(texts.drop("source"))
    assert again.where("reason IS NOT NULL").count() == 0
    assert {tuple(r) for r in again.select("source", markdown.serialise()).collect()} == {tuple(r) for r in texts.collect()}
    back = {r.source: r for r in again.collect()}
    assert back["raw/a.md"].claims[1].claim == long and back["raw/a.md"].topics == ["t1", "t2"] and back["raw/b.md"].counts.decisions == 1
    root = str(tmp_path / "kb")
    files = texts.select(paths.extraction_path(F.col("source")).alias("rel_path"), "content")
    assert {r.existed for r in markdown.write_files(files, root).collect()} == {False}
    assert {r.existed for r in markdown.write_files(files, root).collect()} == {True}
    content = {r.source: r.content for r in texts.collect()}
    assert (tmp_path / "kb" / "extraction" / "a.md").read_bytes() == content["raw/a.md"].encode()
    heads = {r.source: r for r in markdown.read_headers(spark, root, block=512).collect()}
    for name, text in content.items():
        assert heads[name].read <= text.encode().index(b"\n---\n") + 5 + 512 and heads[name].summary == back[name].summary and heads[name].counts == back[name].counts
    assert heads["raw/a.md"].read < 1100 < 30_000 < len(content["raw/a.md"])
    assert {r.source for r in markdown.read_files(spark, root).where("reason IS NULL").collect()} == set(content)
    good = content["raw/a.md"]
    faults = {
        "no dashes": "no complete header", good.replace("schema_version: 2", "schema_version: 3"): "unknown version", good.replace("\n## Entities\n", "\n## Entitys\n"): "section entities missing",
        good.replace('- {"task"', '- {"task'): "section action_items is no list", good.replace('"claims":2', '"claims":3'): "count of claims disagrees", good.replace('- {"title":"One"', '* {"title":"One"'): "section concepts is no list", "": "no complete header",
    }
    found = markdown.parse(spark.createDataFrame([(x, x) for x in faults], "key string, content string")).select("key", "reason").collect()
    assert {r.key: r.reason for r in found} == faults


def test_incremental_compile(spark, tmp_path):
    schema = "rel_path string, text string"
    def add(n, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    def go():
        q = incremental.compile_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "out"), lambda d: d.select("rel_path", F.length("text").alias("n")), str(tmp_path / "ck"))
        q.awaitTermination()
        return sorted((r.rel_path, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    add(1, ("a", "x"), ("b", "yy"))
    assert go() == [("a", 1), ("b", 2)]
    add(2, ("a", "x"), ("b", "zzz"))
    assert go() == [("a", 1), ("b", 2), ("b", 3)]


def test_stream_windows_and_dedup(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = incremental.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == events.count()
    docs = stream.select(F.col("event_type").alias("text"), "ts")
    q = incremental.distinct_contents(docs, "ts", "365 days").writeStream.format("memory").queryName("contents").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM contents").first().n == events.select("event_type").distinct().count()


def test_knowledge_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select(F.concat(F.lit("raw/"), "doc_id", F.lit(".md")).alias("rel_path"), "text")
    kb = knowledge.compile_kb(docs, OfflineEndpoint())
    assert kb.extractions.count() == 40 and kb.rejects.count() == 0
    articles = kb.articles.collect()
    assert articles and all(a.path.startswith("wiki/concept/") and a.sources for a in articles)
    covered = {s for a in articles for s in a.sources}
    assert covered == {r.rel_path for r in docs.collect()}
    entries = {r.path: r for r in kb.catalog.collect()}
    assert set(entries) == {a.path for a in articles} and all(len(r.summary) <= 151 for r in entries.values())
    word = articles[0].title
    answers, cited = knowledge.ask(kb, spark.createDataFrame([(f"what about {word}",), ("zzzzzz qqqqqq",)], "question string"), OfflineEndpoint())
    got = {r.question: r.text for r in answers.collect()}
    assert got["zzzzzz qqqqqq"] == "No article covers this." and {r.path for r in cited.collect()} >= {articles[0].path}
    docs2, copied, skipped = knowledge.derive(kb, word, OfflineEndpoint())
    assert 0 < docs2.count() == copied.count() and skipped.count() == 0
    again = knowledge.extract(kb.raw, OfflineEndpoint(), kb.extractions)
    assert again.count() == 40
    assert knowledge.prune(kb, kb.catalog.limit(1)).count() == len(entries) - 1


def test_merged_articles_keep_their_text_and_long_ones_are_cut(spark):
    docs = spark.createDataFrame([("raw/a.md", "zebra " * 30 + "end."), ("raw/b.md", "\n".join(f"walrus line {i} of a long text." for i in range(2000)))], "rel_path string, text string")
    first = knowledge.compile_kb(docs.where("rel_path = 'raw/a.md'"), OfflineEndpoint())
    old = first.articles.collect()
    existing = first.articles.unionByName(spark.createDataFrame([("wiki/concept/other.md", "Other", "concept", "untouched", ["raw/z.md"])], first.articles.schema))
    kb = knowledge.compile_kb(docs.where("rel_path = 'raw/b.md'").unionByName(spark.createDataFrame([("raw/c.md", "zebra zebra once more")], docs.schema)), OfflineEndpoint(), existing=existing)
    got = {r.path: r for r in kb.articles.collect()}
    assert set(got) == {old[0].path, "wiki/concept/other.md", "wiki/concept/walrus.md"} and got["wiki/concept/other.md"].text == "untouched"
    merged = got[old[0].path]
    assert merged.text.startswith(old[0].text.rstrip()) and "Update from raw/c.md" in merged.text and set(merged.sources) == {"raw/a.md", "raw/c.md"}
    assert kb.extractions.where("rel_path = 'raw/b.md'").first().topics


def test_history_is_read_before_a_question_is_asked(spark):
    class Counting(OfflineEndpoint):
        def complete(self, task, payload):
            if task == "rewrite" and payload["history"] == "boom":
                raise RuntimeError("no answer")
            return super().complete(task, payload)

    rows = [("what of it", "user: tell me of walruses"), ("plain", None), ("broken", "boom"), ("blank", " ")]
    out = {r.question: r.asked for r in knowledge.rewrite(spark.createDataFrame(rows, "question string, history string"), Counting()).collect()}
    assert out == {"what of it": "what of it walruses", "plain": "plain", "broken": "broken", "blank": "blank"}


def grouped(spark, *rows):
    return spark.createDataFrame(rows, "rel_path string, group_id long, wave int")


def test_classify_shows_the_most_relevant(spark):
    topics = spark.createDataFrame([("raw/a.md", "1", ["zeta", "common", "word"]), ("raw/b.md", "2", ["fresh", "common"]), ("raw/c.md", None, ["alone"])], "rel_path string, checksum string, topics array<string>")
    rows = [(f"wiki/concept/a{i:02}.md", "Common word") for i in range(12)] + [("wiki/concept/zeta.md", "Zeta one two three")]
    existing = spark.createDataFrame(rows, "path string, title string")
    for shown in (3, 500):  # where it is not shown the title finds it
        done = serial.classify(topics, existing, OfflineEndpoint(), grouped(spark, ("raw/a.md", 0, 0), ("raw/b.md", 1, 0), ("raw/c.md", 2, 0)), shown=shown)
        assert {(r.rel_path, r.action, r.path) for r in done.ops.collect()} == {("raw/a.md", "merge", "wiki/concept/zeta.md"), ("raw/b.md", "create", "wiki/concept/fresh.md"), ("raw/c.md", "create", "wiki/concept/alone.md")}
        assert done.rejects.count() == 0


def titles(silent=False):
    """An endpoint; made here, so that it travels to the tasks as a value."""

    class Titles(OfflineEndpoint):
        """Creates an article of all topics, unless it is shown one that has its first topic in its path; it fails and babbles when told to."""

        def _classify(self, p):
            if silent or "boom" in p["topics"]:
                raise RuntimeError("no answer")
            if "babble" in p["topics"]:
                return "?"
            shown = [x for x in p["catalog"] if p["topics"][0] in x][:1]
            name = "-".join(p["topics"])
            new = [] if shown else [{"path": f"wiki/concept/{name}.md" if "odd" not in p["topics"] else "elsewhere.md", "type": "concept", "title": " ".join(p["topics"])}]
            return json.dumps({"merge_into": shown, "create_new": new})

    return Titles()


def plain_serial(items, existing, cache):
    """One group after another, one item after another."""
    ops, bad, asked = [], [], {}
    words = lambda t: set(re.sub(r"[^a-z0-9\s]", "", t.lower()).split())
    for g in sorted({i[3] for i in items}):
        there = [(p, t) for p, t in existing]
        for ref, checksum, topics, _, _ in sorted((i for i in items if i[3] == g), key=lambda i: i[4]):
            shown = [p for p, t in existing if words(t) & words(" ".join(topics))]
            catalog = [p for p, _ in there[len(existing) :]] + sorted(shown, key=lambda p: (-len(words(dict(existing)[p]) & words(" ".join(topics))) / min(len(words(dict(existing)[p])), len(words(" ".join(topics)))), p))
            try:
                answer = cache.get(checksum) or asked.get(checksum) or titles()._classify({"topics": topics, "catalog": catalog})
                c = json.loads(answer)
            except Exception:  # noqa: BLE001
                bad.append(ref)
                continue
            if checksum:
                asked.setdefault(checksum, answer)
            ops += [(ref, "merge", p) for p in c["merge_into"]]
            for n in c["create_new"]:
                scored = [(len(words(t) & words(n["title"])) / min(len(words(t)), len(words(n["title"]))), -i) for i, (_, t) in enumerate(there) if words(t)]
                best = max(scored, default=(0, 0))
                if best[0] >= 0.7:
                    ops.append((ref, "merge", there[-best[1]][0]))
                else:
                    ops.append((ref, "create", n["path"]))
                    there.append((n["path"], n["title"]))
    return ops, bad


def test_serial_classification_equals_a_plain_loop(spark):
    rng = random.Random(11)
    names = "ant bee cat dog eel fox gnu hen".split()
    existing = [("wiki/concept/x-ant.md", "Ant bee cat"), ("wiki/concept/y.md", "Dog"), ("wiki/concept/z.md", "Hen gnu fox eel")]
    items = []
    for g in range(12):
        for w in range(rng.randint(1, 6)):
            topics = rng.sample(names, rng.randint(2, 4))
            items.append((f"raw/{g:02}-{w}.md", f"sum{g}-{w}", topics, g, w))
    items[3] = (*items[3][:2], ["boom", "x"], *items[3][3:])
    items[4] = (*items[4][:2], ["babble", "x"], *items[4][3:])
    items[5] = (items[5][0], None, *items[5][2:])
    found = spark.createDataFrame([i[:3] for i in items], "rel_path string, checksum string, topics array<string>")
    articles = spark.createDataFrame(existing, "path string, title string")
    groups = grouped(spark, *[(i[0], i[3], i[4]) for i in items])
    done = serial.classify(found, articles, titles(), groups)
    ops, bad = plain_serial(items, existing, {})
    made = {}
    for ref, action, path in ops:
        if action == "create":
            made[path] = min(made.get(path, ref), ref)
    want = sorted((ref, "merge" if action == "create" and made[path] != ref else action, path) for ref, action, path in ops)
    assert sorted((r.rel_path, r.action, r.path) for r in done.ops.collect()) == want
    assert sorted(r.ref for r in done.rejects.collect()) == sorted(bad) and len(bad) == 2
    cache = done.cache.collect()
    assert len(cache) == len(items) - 3  # all but the one without a checksum and those that failed

    again = serial.classify(found, articles, titles(silent=True), groups, done.cache)
    failed = {r.ref for r in again.rejects.collect()}
    assert failed == {items[i][0] for i in (3, 4, 5)} and {r.rel_path for r in again.ops.collect()} == {o[0] for o in ops} - failed
    assert serial.classify(found.limit(0), articles, titles(), groups).ops.count() == 0


def test_classify_reads_what_it_is_given_once(spark):
    """Each of its steps made the topics anew, however costly, before."""
    reads = spark.sparkContext.accumulator(0)

    def counting(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    kind = "rel_path string, checksum string, topics array<string>"
    found = spark.createDataFrame([(f"raw/{i}.md", str(i), ["zeta", f"word{i}"]) for i in range(3)], kind).mapInPandas(counting, kind)
    existing = found.selectExpr("concat('wiki/concept/', checksum, '.md') AS path", "concat('Old ', topics[1]) AS title")
    serial.classify(found, existing, OfflineEndpoint(), grouped(spark, ("raw/0.md", 0, 0), ("raw/1.md", 0, 1), ("raw/2.md", 1, 0))).ops.count()
    assert reads.value == 6  # three documents, once as such and once as articles


def test_clusters_keep_to_their_cap_and_order(spark):
    rows = [(f"raw/{i}.md", ["same", f"t{i}"], []) for i in range(9)] + [("raw/x.md", ["alone"], [("Same", "")]), ("raw/y.md", [], None)]
    found = spark.createDataFrame(rows, "rel_path string, topics array<string>, concepts array<struct<title:string,summary:string>>")
    got = serial.clusters(found, threshold=0.4, cap=4).collect()
    assert sorted(r.rel_path for r in got) == sorted(r[0] for r in rows)
    by_group = {}
    for r in sorted(got, key=lambda r: r.wave):
        by_group.setdefault(r.group_id, []).append((r.rel_path, r.wave))
    assert all(len(m) <= 4 and [p for p, _ in m] == sorted(p for p, _ in m) and [w for _, w in m] == list(range(len(m))) for m in by_group.values())
    assert [("raw/y.md", 0)] in by_group.values()


def test_repeated_questions_are_asked_once_and_long_lines_are_kept(spark):
    asked = spark.createDataFrame([("q", "user: walruses")] * 3 + [("q", None), ("p", "user: zebras")], "question string, history string")
    out = [tuple(r) for r in knowledge.rewrite(asked, OfflineEndpoint()).select("question", "history", "asked").collect()]
    assert sorted(out, key=repr) == sorted([("q", "user: walruses", "q walruses")] * 3 + [("q", None, "q"), ("p", "user: zebras", "p zebras")], key=repr)
    entries = spark.createDataFrame([(f"wiki/concept/w{i}.md", f"Walrus {i}", "s") for i in range(300)] + [("wiki/concept/long.md", "Zebra", "zebra " * 9000)], "path string, title string, summary string")
    base = knowledge.KnowledgeBase(None, None, None, entries, None)
    hits = knowledge.retrieve(base, spark.createDataFrame([(f"where is walrus {i % 7}",) for i in range(21)] + [("a zebra",)], "question string"), OfflineEndpoint(), per_prompt=3).collect()
    assert {r.path for r in hits if r.question == "a zebra"} == {"wiki/concept/long.md"}
    assert {r.question for r in hits} == {"a zebra"} | {f"where is walrus {i}" for i in range(7)} and len(hits) == 7 * 6 + 1
    answers, _ = knowledge.ask(base, spark.createDataFrame([("a zebra",)] * 3, "question string"), OfflineEndpoint())
    assert answers.count() == 1


def test_recall_and_precision_passes(spark):
    entries = spark.createDataFrame([("wiki/concept/a.md", "Walrus tusks", "s"), ("wiki/concept/b.md", "Walrus", "s"), ("wiki/concept/c.md", "Zebra", "s")], "path string, title string, summary string")
    base = knowledge.KnowledgeBase(None, None, None, entries, None)
    of = lambda mode: {r.path for r in knowledge.on_topic(base, "walrus tusks", OfflineEndpoint(), mode)[0].collect()}
    assert of("recall") == {"wiki/concept/a.md", "wiki/concept/b.md"} and of("precision") == {"wiki/concept/a.md"}
    keep, away = knowledge.focus(base, "walrus tusks", OfflineEndpoint())
    assert [r.path for r in keep.collect()] == ["wiki/concept/a.md"] and {r.path for r in away.collect()} == {"wiki/concept/b.md", "wiki/concept/c.md"}
    with pytest.raises(ValueError):
        knowledge.on_topic(base, "x", OfflineEndpoint(), "both")


def test_state_versions(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "path string, text string"
    assert state.load(spark, f"{path}/v0", schema).count() == 0
    one = state.save(spark.createDataFrame([("a", "1")], schema), path, 1)
    with pytest.raises(Exception, match="(?i)exists"):
        state.save(spark.createDataFrame([("b", "2")], schema), path, 1)
    assert [tuple(r) for r in state.load(spark, one, schema).collect()] == [("a", "1")]
    root = str(tmp_path / "articles")
    assert state.latest(spark, root) == 0 and state.committed(spark, root, 0, schema).count() == 0
    assert state.write_articles(spark, root, spark.createDataFrame([("a", "1"), ("b", "2")], schema)) == 1
    assert state.write_articles(spark, root, spark.createDataFrame([("b", "3"), ("c", "4")], schema)) == 2
    assert {tuple(r) for r in state.committed(spark, root, 2, schema).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {tuple(r) for r in state.committed(spark, root, 1, schema).collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(PermissionError):
        state.write_articles(spark, root, spark.createDataFrame([("a", "1")], schema), read_only=True)
    assert state.frozen_categories(None, None) == (list(state.CATEGORIES), False)
    assert state.frozen_categories(["a"], None) == (["a"], False) and state.frozen_categories(["a"], ["b"]) == (["b"], True)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "k string"
    state.commit(spark, root, schema, lambda old: spark.createDataFrame([("first",)], schema))
    barrier = threading.Barrier(3)
    met: set[str] = set()

    def writer(name):
        def change(old):
            if name not in met:  # all read the same version before any commits
                met.add(name)
                barrier.wait()
            return old.union(spark.createDataFrame([(name,)], schema))

        return state.commit(spark, root, schema, change)

    with ThreadPoolExecutor(3) as pool:
        versions = sorted(pool.map(writer, ["x", "y", "z"]))
    assert versions == [2, 3, 4]
    assert sorted(r.k for r in state.committed(spark, root, 4, schema).collect()) == ["first", "x", "y", "z"]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4  # what lost a race is gone
