"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text is cut at everything that is no letter or mark. A run of letters is a unit, whose features are the run itself and its
beginnings of three to eight letters (compounding languages hide words at the front of longer ones). Scripts that part no words
(from U+0E00 on) and runs of more than ``LONG`` letters have a unit at every letter, with what begins there: pieces of two to
four letters, or beginnings as above. So no part of a text goes unread. Units are counted in windows of ``2 * STEP`` that
overlap by half and cover the whole text. P(grade <= k) = sigmoid(theta_k - w.x): all thresholds share w, and theta is kept
ordered. The score is the expected grade, and a text has that of its worst window, so that what stands around a toxic passage
cannot outweigh it, however long.

Labels say toxic or not; grades come from them: 0 is not toxic, and toxic documents are graded 1 to 3 by thirds of how dense
their telling terms are. The terms are chosen by the significance of their log odds. A toxic document is trained on by the window
in which its telling terms are the most significant, one that is not toxic by all its windows. Training reads a bounded sample
(``max_toxic`` and ``max_clean`` labelled rows, by hashed id); document frequencies of terms are counted by Spark, and only
the chosen terms (at most ``max_terms``, the size of the model) and their counts in those windows reach the driver. Scoring is
one narrow pass: Arrow cuts the texts, each different run of a portion is looked up once, and hits are counted in numpy.

Defined results: a null text counts as empty and gets the score of a text without any telling term. Repeated rows score
alike. Without labelled rows of both classes nothing is toxic and all severities are 0. Extra columns are ignored by
toxicity(), kept by reject_toxic() whatever their names, and by score() unless they have the names of its results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning

GRADES = 4
STEP = 100
LONG = 30
SCORES = "severity double, p_toxic double, grade int, toxic boolean"
_STAR, _EMPTY = pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())
_APART = r"[^\p{L}\p{M}]+"
_UNSPACED = r"[\x{0E00}-\x{10FFFF}]"


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different runs of letters of texts, lower-cased; of each occurrence which it is; where each text's occurrences begin, and their end."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), _APART)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()


def dense(found: pa.Array) -> np.ndarray:
    """Which runs have a unit at every letter."""
    return (pc.match_substring_regex(found, _UNSPACED).to_numpy(zero_copy_only=False)) | (pc.utf8_length(found).to_numpy() > LONG)


def beginnings(run: str, at: int) -> list[str]:
    """The terms of a dense run's unit at a letter."""
    if run[at] >= "\u0e00":
        return [run[at : at + n] for n in range(2, min(4, len(run) - at) + 1)]
    return [f"{run[at : at + n]}*" for n in range(3, min(8, len(run) - at) + 1)]


def terms(run: str, is_dense: bool) -> set[str]:
    if is_dense:
        return {t for i in range(len(run)) for t in beginnings(run, i)}
    return {run, *(f"{run[:n]}*" for n in range(3, min(8, len(run)) + 1))} if run else set()


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thetas: np.ndarray

    def distribution(self, score: np.ndarray) -> np.ndarray:
        """(n, GRADES) probabilities."""
        upto = 1 / (1 + np.exp(-np.clip(self.thetas[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)


class Counts:
    """Counts of vocabulary terms in the windows of texts."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.terms = vocabulary, pa.array(list(vocabulary), pa.large_string())

    def _hits(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run how many units it has; and (run, unit in it, term) of what they have of the vocabulary, in order of run."""
        whole = dense(found)
        letters = pc.utf8_length(found).to_numpy()
        units = np.where(whole, letters, 1)
        units[letters == 0] = 0
        of, unit, term = [], [], []
        for n in (0, *range(3, 9)):
            part = pc.binary_join_element_wise(pc.utf8_slice_codeunits(found, 0, n), _STAR, _EMPTY) if n else found
            at = pc.index_in(part, self.terms)
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False) & ~whole & (letters >= max(n, 1)))
            of.append(hit)
            unit.append(np.zeros(len(hit), np.int64))
            term.append(at.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64))
        get = self.vocabulary.get
        for i in np.flatnonzero(whole).tolist():
            run = found[i].as_py()
            met = [(j, k) for j in range(len(run)) for t in beginnings(run, j) if (k := get(t)) is not None]
            of.append(np.full(len(met), i))
            unit.append(np.array([j for j, _ in met], np.int64))
            term.append(np.array([k for _, k in met], np.int64))
        of, unit, term = (np.concatenate(x) for x in (of, unit, term))
        order = np.argsort(of, kind="stable")
        return units, of[order], unit[order], term[order]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, term, count) of the terms met, in order of window; how many units each window has; and where each text's windows begin, and their end. A text has one window at least."""
        found, code, begins = runs(texts)
        units, run, unit, term = self._hits(found)
        upto = np.concatenate([[0], np.cumsum(units[code])])
        n_units = upto[begins[1:]] - upto[begins[:-1]]
        steps = -(-n_units // STEP)
        last = np.maximum(steps - 2, 0)
        first_window = np.concatenate([[0], np.cumsum(last + 1)])
        starts = (np.arange(first_window[-1]) - np.repeat(first_window[:-1], last + 1)) * STEP
        sizes = np.minimum(np.repeat(n_units, last + 1), starts + 2 * STEP) - starts
        # every occurrence of a run with hits, and its hits
        many = np.bincount(run, minlength=len(units))
        met = np.flatnonzero(many[code])
        times = many[code[met]]
        at = np.repeat((np.cumsum(many) - many)[code[met]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        met = np.repeat(met, times)
        text = np.searchsorted(begins, met, "right") - 1
        step = (upto[met] + unit[at] - upto[begins[text]]) // STEP
        window, term = first_window[text] + step, term[at]
        first, second = step <= last[text], step >= 1
        keys, n = np.unique(np.concatenate([window[first], window[second] - 1]) * len(self.vocabulary) + np.concatenate([term[first], term[second]]), return_counts=True)
        return *np.divmod(keys, max(1, len(self.vocabulary))), n, sizes, first_window


def _portions(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = (F.xxhash64("doc_id"), "doc_id")
    few = one.where("toxic > 0").orderBy(*by).limit(max_toxic).union(one.where("toxic <= 0").orderBy(*by).limit(max_clean))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", (F.col("toxic") > 0).alias("toxic"), "text")


def _vocabulary(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int, least_z: float = 2.5) -> tuple[dict[str, int], np.ndarray]:
    """The telling terms, numbered, and their significance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _portions(b, 2)):
            found, code, begins = runs(batch.column(2))
            whole, names = dense(found).tolist(), found.to_pylist()
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for i, toxic in enumerate(batch.column(1).to_pylist()):
                seen[toxic].update({t for k in np.unique(code[begins[i] : begins[i + 1]]).tolist() for t in terms(names[k], whole[k])})
            for toxic in (False, True):
                listed = list(seen[toxic])
                yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array([seen[toxic][n] if toxic else 0 for n in listed], pa.int64()), pa.array([0 if toxic else seen[toxic][n] for n in listed], pa.int64())], ["term", "a", "c"])

    counted = sample.mapInArrow(count, "term string, a long, c long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where("a >= 3")
    a, b, c, d = F.col("a") + 0.5, n_toxic - F.col("a") + 0.5, F.col("c") + 0.5, n_clean - F.col("c") + 0.5
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    rows = counted.select("term", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms).collect()
    return {r.term: i for i, r in enumerate(rows)}, np.array([r.z for r in rows])


def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_terms: int, ridge: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the penalised likelihood; theta = t0, t0 + exp(t1), ... stays ordered."""
    row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    col = np.concatenate([i for i, _ in x]) if len(row) else np.zeros(0, np.int64)
    val = np.log1p(np.concatenate([c for _, c in x])) if len(row) else np.zeros(0)
    k = GRADES - 1
    p = np.concatenate([np.zeros(n_terms), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:n_terms], p[n_terms:]
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        score = np.bincount(row, val * w[col], len(x)) if len(row) else np.zeros(len(x))
        cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -35, 35)))
        full = np.concatenate([np.zeros((len(x), 1)), cum, np.ones((len(x), 1))], axis=1)
        at = np.arange(len(x))
        prob = np.maximum(full[at, y + 1] - full[at, y], 1e-12)
        slope = full * (1 - full)
        up, down = slope[at, y + 1] / prob, slope[at, y] / prob
        g_score = up - down  # d(-log prob)/d score
        g_theta = np.array([(-(up * (y == j)) + down * (y == j + 1)).sum() for j in range(k)])
        g_t = np.array([g_theta.sum(), *(np.exp(t[j]) * g_theta[j:].sum() for j in range(1, k))])
        g_w = (np.bincount(col, val * g_score[row], n_terms) if len(row) else np.zeros(n_terms)) + ridge * w
        g = np.concatenate([g_w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return p[:n_terms], np.cumsum(np.concatenate([p[n_terms : n_terms + 1], np.exp(p[n_terms + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 4000, max_terms: int = 2000, ridge: float = 1.0) -> Model | None:
    """None if the labelled rows lack a class."""
    sample = _sample(docs, labels, max_toxic, max_clean).persist()
    try:
        sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not sizes.get(True) or not sizes.get(False):
            return None
        vocabulary, z = _vocabulary(sample, sizes[True], sizes[False], max_terms)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = Counts(vocabulary)
            for batch in (p for b in batches for p in _portions(b, 2)):
                found = []
                window, ids, n, sizes, first = counts.of(batch.column(2))
                ends = np.searchsorted(window, np.arange(len(sizes) + 1)).tolist()
                weight = np.bincount(window, np.log1p(n) * z[ids], len(sizes))
                for i, (key, toxic) in enumerate(zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    a, b = first[i], first[i + 1]
                    only = [int(a + weight[a:b].argmax())] if toxic else range(a, b)
                    found += [(key, toxic, w - a, int(sizes[w]), ids[ends[w] : ends[w + 1]].tolist(), n[ends[w] : ends[w + 1]].tolist()) for w in only]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["id", "toxic", "w", "n", "ids", "counts"])

        rows = sorted(sample.mapInArrow(features, "id string, toxic boolean, w long, n long, ids array<long>, counts array<long>").collect())
    finally:
        sample.unpersist()
    x = [(np.array(r.ids, np.int64), np.array(r.counts, np.float64)) for r in rows]
    toxic = np.array([r.toxic for r in rows])
    density = np.array([sum(r.counts) / max(1, r.n) for r in rows])
    cuts = np.quantile(density[toxic], [1 / 3, 2 / 3])
    y = np.where(toxic, 1 + np.searchsorted(cuts, density), 0)
    return Model(vocabulary, *_fit(x, y, len(vocabulary), ridge))


#: A toxic document that stays costs as much as four others that go: rejecting pays from this probability on. Where labels make
#: even a text without any telling term likely to be toxic, twice its probability is asked for, a half at most.
THRESHOLD = 0.2


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, whole, with severity (expected grade), p_toxic, grade (the likeliest) and toxic (p_toxic reaches the threshold, see THRESHOLD)."""
    docs = docs.drop(*(c.split()[0] for c in SCORES.split(", ")))
    if model is None:
        return docs.selectExpr("*", "0.0D AS severity", "0.0D AS p_toxic", "0 AS grade", "false AS toxic")
    least = max(threshold, min(0.5, 2 * (1 - float(model.distribution(np.zeros(1))[0, 0]))))
    at = docs.columns.index("text")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(model.vocabulary)
        for batch in (p for b in batches for p in _portions(b, at)):
            window, ids, n, sizes, first = counts.of(pc.fill_null(batch.column(at), ""))
            total = np.maximum.reduceat(np.bincount(window, np.log1p(n) * model.weights[ids], len(sizes)), first[:-1])
            p = model.distribution(total)
            added = [pa.array(p @ np.arange(GRADES)), pa.array(1 - p[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(1 - p[:, 0] >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, "severity", "p_toxic", "grade", "toxic"])

    return docs.mapInArrow(run, f"{schema}, {SCORES}")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with its scores."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, as they were."""
    name = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    back = [F.col(name[c]).alias(c) if c in name else F.col(c) for c in docs.columns]
    plain = docs.select([F.col(c).alias(name.get(c, c)) for c in docs.columns])
    return score(plain, train(docs, labels)).where("NOT toxic").select(*back)
