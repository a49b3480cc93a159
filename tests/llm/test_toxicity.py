"""Toxicity: counts, gradient and scores against plain Python, and texts without spaces."""

import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa

from quillmill.llm import toxicity


def plain_units(text):
    """The terms of every unit of a text."""
    out, run = [], []
    for c in [*text.lower(), " "]:
        if unicodedata.category(c)[0] in "LM":
            run.append(c)
            continue
        word, run = "".join(run), []
        if not word:
            continue
        if len(word) > toxicity.LONG or re.search("[฀-\U0010ffff]", word):
            for i in range(len(word)):
                sizes = range(2, 5) if word[i] >= "฀" else range(3, 9)
                out.append([word[i : i + n] + ("" if word[i] >= "฀" else "*") for n in sizes if i + n <= len(word)])
        else:
            out.append([word, *(word[:n] + "*" for n in range(3, 9) if n <= len(word))])
    return out


def plain_windows(text, vocabulary):
    units = plain_units(text)
    steps = [units[i : i + toxicity.STEP] for i in range(0, len(units), toxicity.STEP)]
    out = []
    for w in range(max(1, len(steps) - 1)):
        counts = {}
        for unit in (u for s in steps[w : w + 2] for u in s):
            for t in unit:
                if t in vocabulary:
                    counts[t] = counts.get(t, 0) + 1
        out.append(counts)
    return out


def made_texts():
    rng = random.Random(2)
    words = ["ab", "abcde", "Abcdefghijk", "x", "well/idiot", "end.Moron", "汉字漢", "ไทยคำ", "한국말", "é́a", "ab-cd_ef9gh", "q" * 40, "nestedidiotinsidealongrunofletters", "", "\n", "½"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 500))) for _ in range(40)] + ["", "   ", "汉字" * 700, "wort" * 900]


def test_counts_against_plain_python():
    texts = made_texts()
    every = sorted({t for x in texts for u in plain_units(x) for t in u})
    vocabulary = {t: i for i, t in enumerate(random.Random(3).sample(every, len(every) // 3))}
    names = list(vocabulary)
    window, term, n, sizes, first = toxicity.Counts(vocabulary).of(pa.array(texts))
    got = [{} for _ in sizes]
    for w, t, c in zip(window.tolist(), term.tolist(), n.tolist(), strict=True):
        got[w][names[t]] = c
    want = [plain_windows(x, vocabulary) for x in texts]
    assert [len(w) for w in want] == np.diff(first).tolist()
    assert got == [c for w in want for c in w]
    assert {t for x in texts for u in plain_units(x) for t in u} == {t for x in texts for r, d in zip(toxicity.runs(pa.array([x]))[0].to_pylist(), toxicity.dense(toxicity.runs(pa.array([x]))[0]).tolist(), strict=True) for t in toxicity.terms(r, d)}


def test_texts_without_spaces_are_read_to_their_end(spark):
    model = toxicity.Model({"坏话": 0, "idiot*": 1}, np.array([3.0, 3.0]), np.array([2.0, 3.0, 4.0]))
    texts = ["好" * 5000, "好" * 5000 + "坏话坏话坏话" + "好" * 5000, "well/idiot end.IDIOT idiots", "a" * 100_000, "a" * 100_000 + "idiotidiotidiot", None, "fine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert [i for i in got if got[i]] == [1, 2, 4]


def likelihood(p, x, y, n_terms, ridge):
    w, t = p[:n_terms], p[n_terms:]
    theta = [t[0], t[0] + math.exp(t[1]), t[0] + math.exp(t[1]) + math.exp(t[2])]
    total = ridge / 2 * float((w * w).sum())
    for (ids, counts), grade in zip(x, y.tolist(), strict=True):
        s = sum(w[i] * math.log1p(c) for i, c in zip(ids, counts, strict=True))
        upto = [0.0, *(1 / (1 + math.exp(s - th)) for th in theta), 1.0]
        total -= math.log(upto[grade + 1] - upto[grade])
    return total


def test_the_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(5)
    x = [(rng.choice(6, rng.integers(0, 4), replace=False), rng.integers(1, 4, 4).astype(float)) for _ in range(60)]
    x = [(i, c[: len(i)]) for i, c in x]
    y = np.array([min(3, int(sum(i < 2) + rng.integers(0, 2))) for i, _ in x])
    w, theta = toxicity._fit(x, y, 6, 0.3, steps=4000)
    p = np.concatenate([w, [theta[0]], np.log(np.diff(theta))])
    at = likelihood(p, x, y, 6, 0.3)
    for j in range(len(p)):
        for step in (-0.02, 0.02):
            q = p.copy()
            q[j] += step
            assert likelihood(q, x, y, 6, 0.3) > at - 1e-4, j


def test_scores_against_plain_python(spark):
    texts = made_texts()
    every = sorted({t for x in texts for u in plain_units(x) for t in u})
    vocabulary = {t: i for i, t in enumerate(random.Random(4).sample(every, 60))}
    weights = np.random.default_rng(1).normal(size=60)
    model = toxicity.Model(vocabulary, weights, np.array([0.5, 1.0, 2.5]))
    docs = spark.createDataFrame([(i, t, "mine", 4) for i, t in enumerate(texts)], "doc_id long, text string, toxic string, grade int")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "severity", "p_toxic", "grade", "toxic"]
    least = max(toxicity.THRESHOLD, min(0.5, 2 / (1 + math.exp(0.5))))
    for i, text in enumerate(texts):
        s = max(sum(weights[vocabulary[t]] * math.log1p(c) for t, c in w.items()) for w in plain_windows(text, vocabulary))
        upto = [0.0, *(1 / (1 + math.exp(s - t)) for t in model.thetas), 1.0]
        p = np.diff(upto)
        assert abs(got[i].severity - sum(k * x for k, x in enumerate(p))) < 1e-9 and got[i].toxic == (1 - p[0] >= least)


def test_rejection_keeps_columns_named_like_results(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "a", i) for i in range(5)], "doc_id long, text string, toxic string, severity int")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    out = toxicity.reject_toxic(docs, labels)
    assert out.schema == docs.schema and out.count() == 5
