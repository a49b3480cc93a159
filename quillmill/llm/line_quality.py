"""Document quality from a linear-chain CRF over lines.

Every line is labelled good or bad, by features of its own and of the lines before and after it; forward-backward marginals,
weighted by the lines' lengths, give the document's raw quality, which a logistic curve fitted on the same training rows turns
into a probability. Lines have no labels of their own: in training they bear their document's.

Training reads a bounded sample of labelled documents outside the held-out fold: by hashed id the first ``max_labelled``, as far
as they have ``max_lines`` lines together. Their texts are whole: line features are made in the tasks, as in scoring, and only
these reach the driver. Scoring is one narrow pass over whole texts; line statistics of a batch are computed at once in numpy
from UTF-8 bytes, and documents go through forward-backward side by side.

Defined results: a null text counts as empty and has one empty line. Repeated rows score alike. Without labelled rows of both
classes every score is the share of good labels (0.5 with no label at all). A null doc_id is not held out. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salts

# classes of bytes
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _PIPE, _EXCLAIM, _STOP, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (bytes(range(128, 256)), _LOWER), (b"0123456789", _DIGIT), (b" \t\x0b\x0c\r", _SPACE), (b"#*$%&<>=@^~_\\{}[]", _SYMBOL), (b"|", _PIPE), (b"!?", _EXCLAIM), (b".,;:", _STOP)):
    for _b in _chars:
        _CLASS[_b] = _kind
OWN = 13
N_FEATURES = 2 * 3 * OWN + 1


@dataclass
class Lines:
    features: np.ndarray  # (lines, N_FEATURES)
    weight: np.ndarray  # bytes of a line and one
    first: np.ndarray  # for each document its first line, and the end


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, OWN) features, the bytes of each line, and for each document its first line, and the end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    n = len(starts)
    doc_starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, doc_starts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    kind = _CLASS[data]
    count = lambda mask: np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64)
    upper, lower, digit, symbol, pipe, exclaim, stop = (count(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _EXCLAIM, _STOP))
    # words: hashes by position-weighted sums
    gap = (kind == _SPACE) | (data == 10)
    edge = np.diff(np.concatenate([[1], gap.view(np.int8)]))
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line_of = np.searchsorted(starts, w_start, "right") - 1
    words = np.bincount(line_of, minlength=n)
    if len(w_start):
        w_len = w_end - w_start
        inside = np.flatnonzero(~gap)
        offset = np.arange(len(inside)) - np.repeat(np.cumsum(w_len) - w_len, w_len)
        h = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * salts(offset), np.cumsum(w_len) - w_len)
        of_doc = owner[line_of]
        before = np.where(np.concatenate([[True], of_doc[1:] != of_doc[:-1]]), np.uint64(0), np.concatenate([h[:1], h[:-1]]))
        pair = h * np.uint64(0xD6E8FEB86659FD93) + before
        same = np.bincount(line_of, h == before, n)

        def distinct(x: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
            key = (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (of.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
            _, at = np.unique(key, return_index=True)
            return np.bincount(of[at], minlength=many)

        distinct_words = distinct(h, line_of, n)
        in_doc = np.bincount(of_doc, minlength=len(texts))
        pairs_doc = np.where(in_doc > 0, distinct(pair, of_doc, len(texts)) / np.maximum(in_doc, 1), 1.0)
        line_hash = np.bincount(line_of, (h >> np.uint64(24)).astype(np.float64) * (1 + (np.arange(len(h)) - np.searchsorted(line_of, line_of)) % 97), n)
    else:
        same = distinct_words = line_hash = np.zeros(n)
        pairs_doc = np.ones(len(texts))
    key = line_hash.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    solid = np.maximum(upper + lower + digit + symbol + pipe + exclaim + stop, 1)
    wordy = np.maximum(words, 1)
    lines_in = np.diff(first)
    own = np.stack([
        np.log1p(length) / 8, np.log1p(words) / 6, upper / solid, digit / solid, np.minimum(symbol / wordy, 3), np.minimum(pipe / wordy, 2),
        np.minimum(exclaim / wordy, 2), np.minimum(stop / wordy, 2), np.minimum(solid / wordy / 10, 3), same / wordy,
        distinct_words / wordy, (times[inverse] > 1) & (words > 0), pairs_doc[owner],
    ], axis=1).astype(np.float64)
    own[:, 0] *= lines_in[owner] > 0
    return own, length, first


def beside(own: np.ndarray, length: np.ndarray, first: np.ndarray) -> Lines:
    """Lines with what their neighbours are like."""
    n = len(own)
    own = np.concatenate([own, own * own], axis=1)
    is_first = np.zeros(n, bool)
    is_first[first[:-1]] = True
    before = np.where(is_first[:, None], 0, np.concatenate([np.zeros((1, own.shape[1])), own[:-1]]))
    after = np.where(np.concatenate([is_first[1:], [True]])[:, None], 0, np.concatenate([own[1:], np.zeros((1, own.shape[1]))]))
    return Lines(np.concatenate([own, before, after, np.ones((n, 1))], axis=1), length + 1.0, first)


def line_features(texts: list[str]) -> Lines:
    return beside(*own_features(texts))


def _softplus_ratio(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the next label from log odds r of this one, through transitions t[from, to]."""
    return np.logaddexp(t[1, 1] + r, t[0, 1]) - np.logaddexp(t[1, 0] + r, t[0, 0])


def _sweep(e: np.ndarray, first: np.ndarray, count: np.ndarray, t: np.ndarray, backward: bool) -> np.ndarray:
    """Messages into every line: log odds from one side, without the line's own emission. Documents go side by side."""
    out = np.zeros(len(e))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    at = first + count - 1 if backward else first
    step = -1 if backward else 1
    r = np.zeros(len(first))
    tt = t.T if backward else t
    for j in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -j, "left"))  # documents of more than j lines come first
        here = at[:live] + step * j
        if j:
            r = _softplus_ratio(r[:live], tt)
        else:
            r = r[:live]
        out[here] = r
        r = r + e[here]
    return out


def marginals(e: np.ndarray, lines: Lines, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, and the forward and backward messages."""
    count = np.diff(lines.first)
    f = _sweep(e, lines.first[:-1], count, t, False)
    b = _sweep(e, lines.first[:-1], count, t, True)
    return 1 / (1 + np.exp(-np.clip(e + f + b, -40, 40))), f, b


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    level: float

    def score(self, texts: list[str]) -> np.ndarray:
        return self.of_lines(line_features(texts))

    def of_lines(self, lines: Lines) -> np.ndarray:
        p = marginals(lines.features @ self.weights, lines, self.trans)[0]
        mean = np.add.reduceat(p * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.level, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(lines: Lines, good: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> Model:
    count = np.diff(lines.first)
    y = np.repeat(good.astype(np.float64), count)
    share = np.clip(good.mean(), 0.02, 0.98)
    w = np.zeros(N_FEATURES)
    w[-1] = np.log(share / (1 - share))
    t = np.array([[1.0, 0.0], [0.0, 1.0]])
    # a document's lines together weigh as one document, so that long ones don't decide alone
    per = np.repeat(1 / np.sqrt(count), count)
    inner = np.ones(len(y), bool)
    inner[lines.first[:-1]] = False
    here = np.flatnonzero(inner)
    p = np.concatenate([w, t.ravel()])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
        e = lines.features @ w
        q, f, b = marginals(e, lines, t)
        g_w = lines.features.T @ ((q - y) * per) / len(good)
        # pairs of neighbouring lines
        left, right = (f + e)[here - 1], (e + b)[here]
        score = np.stack([t[a, c] + a * left + c * right for a in (0, 1) for c in (0, 1)])
        score -= score.max(axis=0)
        prob = np.exp(score)
        prob /= prob.sum(axis=0)
        true = np.stack([(y[here - 1] == a) & (y[here] == c) for a in (0, 1) for c in (0, 1)])
        g_t = ((prob - true) * per[here]).sum(axis=1) / len(good)
        g = np.concatenate([g_w, g_t]) + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model = Model(p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2), 1.0, 0.0)
    x = _logit(model.of_lines(lines))
    a, c = 1.0, 0.0  # the curve, by Newton steps with a little shrinkage
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(a * x + c, -35, 35)))
        r, d = s - good, np.maximum(s * (1 - s), 1e-6)
        g = np.array([(r * x).sum() + 0.1 * (a - 1), r.sum() + 0.1 * c])
        h = np.array([[(d * x * x).sum() + 0.1, (d * x).sum()], [(d * x).sum(), d.sum() + 0.1]])
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return Model(model.weights, model.trans, float(max(a, 0.05)), float(c))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= chars):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 2500, max_lines: int = 200_000, batch_chars: int = 600_000) -> Model | float:
    """A model, or the share of good labels if there is but one class."""
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    sample = sample.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id"), (F.col("quality") > 0).alias("good"), (F.size(F.split("text", "\n", -1))).alias("n"), "text").where(F.col("n") <= max_lines).persist()
    try:
        sized = sample.select("h", "id", "n").orderBy("h", "id", "n").collect()  # max_labelled documents, but for repeated ids
        upto = np.cumsum([r.n for r in sized])
        last = int(np.searchsorted(upto, max_lines, "right"))
        taken = sample if last == len(sized) else sample.where(F.struct("h", "id", "n") < F.struct(*(F.lit(x).cast(t) for x, t in zip(sized[last], ("long", "string", "int"), strict=True))))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(4).to_pylist()
                for a, b in _portions(texts, batch_chars):
                    own, length, first = own_features(texts[a:b])
                    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(length.astype(np.int64)))
                    flat = pa.ListArray.from_arrays(pa.array((first * OWN).astype(np.int32)), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], lists, flat], ["h", "id", "good", "bytes", "own"])

        rows = sorted(taken.mapInArrow(features, "h long, id string, good boolean, bytes array<long>, own array<double>").toLocalIterator(), key=lambda r: (r.h, r.id, r.bytes))
    finally:
        sample.unpersist()
    good = np.array([r.good for r in rows], bool)
    if not len(good) or good.all() or not good.any():
        return float(good.mean()) if len(good) else 0.5
    own = np.concatenate([np.array(r.own).reshape(-1, OWN) for r in rows])
    first = np.cumsum([0, *(len(r.bytes) for r in rows)])
    return fit(beside(own, np.concatenate([np.array(r.bytes) for r in rows]), first), good)


def score(docs: DataFrame, model: Model | float, batch_chars: int = 600_000) -> DataFrame:
    """doc_id, score (probability of being good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros(len(texts))
            for at, end in _portions(texts, batch_chars):
                out[at:end] = model.score(texts[at:end]) if isinstance(model, Model) else model
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
