"""Repeated passages against brute force, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np

from quillmill.llm import queries, suffix_dedup


def brute(rows, width=50):
    first = {}
    last = 1 << 63
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            first[w] = min(first.get(w, last), last - 1 if d is None else d)
    out = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        keep = np.ones(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < (last - 1 if d is None else d):
                keep[i : i + width] = False
        runs = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum()) if len(raw) else 0
        out[d, len(raw), int((~keep).sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[keep].tobytes()).hexdigest()] += 1
    return out


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 90)
        s = np.array([rng.randint(1, rng.choice([1, 2, 5, 300])) for _ in range(n)], np.int64)
        got = suffix_dedup.suffix_array(s).tolist()
        assert got == sorted(range(n), key=lambda i: s[i:].tolist()), s


def test_marks_against_windows():
    rng = random.Random(5)
    base = [bytes(rng.choices(b"ab", k=84)) for _ in range(6)]
    blocks = sorted({b[: rng.randint(50, 84)] if rng.random() < 0.3 else b[:40] + bytes(rng.choices(b"ab", k=20)) + b[60:] if rng.random() < 0.5 else b for b in base for _ in range(9)})
    least = np.array([rng.randint(0, 9) for _ in blocks])
    got = suffix_dedup.marks(blocks, least)
    for b, d, m in zip(blocks, least, got, strict=True):
        want = sum(1 << i for i in range(len(b) - 49) if any(e < d and b[i : i + 50] in c for c, e in zip(blocks, least, strict=True)))
        assert m == want


def made(rng):
    passages = ["".join(rng.choices("abcdefg hij", k=rng.randint(45, 160))) for _ in range(8)]
    rows = []
    for d in range(150):
        parts = ["".join(rng.choices("lmnopqr é", k=rng.randint(0, 200)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 20) :] if rng.random() < 0.5 else p, "".join(rng.choices("stuvw", k=rng.randint(0, 30)))]
        rows.append((d, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows += [(300, "x" * 49), (301, "x" * 49), (302, "x" * 50), (303, "x" * 51), (304, "x" * 4000), (305, "x" * 4000), (306, None), (307, ""), (308, "é" * 25), (309, "zé" + "é" * 24)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rid string, at int").repartition(5)
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(df, **options).collect())


def test_against_brute_force(spark):
    rows = made(random.Random(1))
    assert run(spark, rows) == brute(rows)


def test_many_buckets_and_portions(spark, monkeypatch):
    old, cut = suffix_dedup.spans, suffix_dedup._portions
    monkeypatch.setattr(suffix_dedup, "spans", lambda rows, width: old(rows, width, bucket_bytes=3000))
    monkeypatch.setattr(suffix_dedup, "_portions", lambda sizes: cut(sizes, 2000))
    rows = made(random.Random(11))
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = made(random.Random(7))[:60] + [(None, "n" * 60), (None, "n" * 60), (5, "m" * 70), (5, "m" * 70), (6, "m" * 70 + "n" * 60), (5, "k" * 55)]
    assert run(spark, rows) == brute(rows)


def test_heavy_anchors_take_the_other_way(spark, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choices("abcdefgh", k=60))
    rows = [(d, "".join(rng.choices("klmnop", k=80)) + line + "".join(rng.choices("klmnop", k=80))) for d in range(120)]
    old = suffix_dedup.verdicts
    monkeypatch.setattr(suffix_dedup, "verdicts", lambda r, b, w: old(r, b, w, per_bucket=30, heavy=10))
    assert run(spark, rows) == brute(rows)


def test_query_on_real_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op4_suffix_dedup(spark, sf_dir).collect()) == brute(rows)


def test_empty_table_and_kept_bytes(spark):
    df = spark.createDataFrame([(1, "q" * 80), (2, "a" + "q" * 80 + "b")], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, with_text=True).collect()} == {1: b"q" * 80, 2: b"ab"}


def test_exact_copies_are_dealt_over_many_buckets(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=400)) for _ in range(40)]
    rows = [(d, t) for d, t in enumerate(texts + texts)]
    seen, old = [], suffix_dedup.buckets_of
    monkeypatch.setattr(suffix_dedup, "buckets_of", lambda blocks, per_bucket: (seen.append((blocks.count(), old(blocks, 50))), seen[-1][1])[1])
    assert run(spark, rows) == brute(rows)
    (blocks, buckets), = seen
    assert blocks > 500 and buckets >= blocks / 50  # none of these blocks has a like one


def test_blocks_that_are_like_no_other_are_never_written(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=20)) for _ in range(5)]
    rows = [(d, "".join("".join(rng.choices(letters, k=60)) + w for w in words) + "".join(rng.choices(letters, k=60))) for d in range(100)]
    rows += [(100, rows[0][1]), (101, "q" + rows[1][1][:200])]
    written, old = [], suffix_dedup.materialise

    def counted(df, **options):
        written.append(old(df, **options))
        return written[-1]

    sizes = []
    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: sizes.extend(t.count() for t in tables))
    assert run(spark, rows) == brute(rows)
    assert max(sizes + [t.count() for t in written]) < 100  # anchors in words stand in all documents: a row for each were 400 and more


def test_packed_blocks_come_back():
    rng = np.random.default_rng(4)
    top = (1 << 63) - 1
    rid = np.array([5, 5, 9, 2, -7, top, 0])
    ord_ = np.array([5, 5, 9, 2, -7, top, top])
    rest = [rng.integers(0, 1 << 8 * n, 7) for n in (4, 3, 3, 3)]
    step = np.diff(rid, prepend=0)
    columns = [rest[0], rest[0] << 8, rest[1], rest[2], step, ord_ - rid, rest[3], rng.integers(50, 85, 7)]
    packed = suffix_dedup._packed(columns)
    again = np.array([1, 3]), np.array([1, 3])
    got = suffix_dedup._unpacked([packed.tobytes(), suffix_dedup._packed([again[0]] * 4 + [np.array([8, -3]), np.zeros(2, np.int64)] + [again[0]] * 2).tobytes()])
    want = [np.concatenate([c, again[0]]) for c in columns]
    want[4], want[5] = np.concatenate([rid, [8, 5]]), np.concatenate([ord_, [8, 5]])
    assert all((g == w).all() for g, w in zip(got, want, strict=True))
