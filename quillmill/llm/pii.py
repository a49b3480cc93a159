"""Personal data: patterns for e-mail, IP, card and phone, and a linear-chain CRF over word-shape features for the rest.

The patterns are matched in linear time and always stand. The CRF finds what has no fixed form (access secrets, identity
numbers, names after a title); it is trained by gradient on a small labelled table made here, and decodes whole texts by
Viterbi in numpy batches. Word shapes and hashed identities are computed for all words of a batch at once from code points, and take in whole words.

Most words are certain: if no pair of neighbouring labels could make another label better than "outside", the best path goes
through "outside" there. Such words cut the text into short islands, and Viterbi runs over islands only, padded by length;
the labels are those of the full decoding.

All work is narrow: Arrow batches of whole rows, nothing is shuffled. Defined results: a null text counts as empty and has no
span; repeated rows get equal results; an empty table gives an empty result; other columns are ignored (spans) or kept as they
are (redact). Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning, salts, sliced

BASE = ("email", "ip", "card", "phone")
LABELS = ("outside", "id", "name", "secret")

# ---- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """A match starts where the run of local characters before its @ does; looking from the @ keeps this linear."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- words and features, for all words of a batch at once

SPACE = 1 << 18
_KINDS = np.full(0x250, 1, np.uint64)  # of a character below 0x250; others count as lower-case letters
_FOLD = np.arange(0x250, dtype=np.uint64)
for _c in range(0x250):
    _ch = chr(_c)
    _KINDS[_c] = 2 if _ch.isupper() else 1 if _ch.isalpha() else 3 if _ch.isdigit() else 4 if _ch in "\"'`" else 5 if _ch in ".," else 6 if _ch in ":=" else 7 if _ch in "-_/" else 8
    _FOLD[_c] = ord(_ch.lower()) if len(_ch.lower()) == 1 else _c


class Words:
    """Words of text joined by newlines: their places and seven hashed features each."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(self.start)
        if not n:
            self.features = np.zeros((0, 7), np.int64)
            self.first = np.zeros(0, bool)
            return
        length = self.end - self.start
        inside = np.flatnonzero(~space)
        ch = codes[inside]
        low = np.minimum(ch, 0x24F)
        kind = np.where(ch < 0x250, _KINDS[low], np.uint64(1))
        heads = np.concatenate([[0], np.cumsum(length)[:-1]])
        offset = np.arange(len(inside)) - np.repeat(heads, length)
        # shape: kinds with runs collapsed
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        new[heads] = True
        order = np.cumsum(new)
        order = order - np.repeat(order[heads], length)
        shape = np.add.reduceat(np.where(new, kind * salts(order), np.uint64(0)), heads)
        # identity: folded letters and digits; hashes wrap around
        folded = np.where(ch < 0x250, _FOLD[low], ch.astype(np.uint64))
        word = np.add.reduceat(np.where(kind <= 3, folded * salts(offset), np.uint64(0)), heads)
        digits = np.add.reduceat((kind == 3).astype(np.int64), heads)
        sizes = np.minimum(np.log2(length).astype(np.uint64), 7) * np.uint64(8) + np.minimum(8 * digits // (length + 1), 7).astype(np.uint64)
        # a word is first if a newline stands between it and the word before
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        line = lines[self.start]
        self.first = np.concatenate([[True], line[1:] != line[:-1]])
        before = lambda x, k: np.concatenate([np.zeros(min(k, n), np.uint64), x[: max(n - k, 0)]])
        first2 = self.first | np.concatenate([[True], self.first[:-1]])
        last = np.concatenate([self.first[1:], [True]])
        prev_shape, prev_word = (np.where(self.first, np.uint64(7), before(x, 1)) for x in (shape, word))
        prev2 = np.where(first2, np.uint64(7), before(word, 2))
        next_shape = np.where(last, np.uint64(7), np.concatenate([shape[1:], [np.uint64(0)]]))
        columns = (shape, sizes, word, prev_word, prev2, prev_shape * np.uint64(31) + shape, next_shape)
        hashed = [((c + np.uint64(i + 1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46) for i, c in enumerate(columns)]
        self.features = np.stack(hashed, axis=1).astype(np.int64)


# ---- the labelled table

_TITLES = "Mr. Mrs. Ms. Dr. Prof.".split()
_GIVEN = "Anna Peter Maria John Laura Thomas Elena Paul Julia Martin Sofia Daniel".split()
_FAMILY = "Keller Smith Moreau Garcia Novak Rossi Brown Weber Lopez Dubois Olsen Carter".split()
_FILL = (
    "the of and report was sent on again to with every morning we saw that they have been here before is not a list for this year "
    "le la de et dans pour une avec der die und nicht mit einer el los para con como por"
).split()
_SYLLABLES = "an be ca do er fi go ha in ka le mi no ou pa re st th un vi en es ing tion é ö ñ ie ch".split()
_KEYS = "token secret password passwd api_key apikey access_token auth_token key client_secret".split()
_ID_NAMES = "SSN ssn IBAN iban passport taxid".split()


def labelled_lines(n: int = 900, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Lines as words and label numbers; a third has something to find, the rest shows what to leave alone."""
    rng = random.Random(seed)
    made = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 5)))

    def fill(k: int) -> list[str]:
        """Sentences: some words end one, and the next is then capitalised."""
        out, start = [], rng.random() < 0.3
        for _ in range(k):
            word = rng.choice(_FILL) if rng.random() < 0.4 else made()
            word = word.capitalize() if start or rng.random() < 0.1 else word
            start = rng.random() < 0.3
            out.append(word + "." if start else word + "," if rng.random() < 0.1 else word)
        return out

    code = lambda abc, a, b: "".join(rng.choices(abc, k=rng.randint(a, b)))
    noise = lambda w: w + rng.choice(["", "", "", "", ".", ",", "###", "$$$", "***", "%%%", "&&&", "!!"])
    out = []
    for i in range(n):
        words, labels = fill(rng.randint(0, 6)), []
        labels = [0] * len(words)
        put = []
        kind = i % 6
        if kind == 0:
            value = code(rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHabcdefgh0123456789"]), 24, 44)
            quote = rng.choice(['"', '"', "'", ""])
            sign = rng.choice(["=", "=", ":"])
            put = [(rng.choice(_KEYS), 0), (sign, 0), (quote + value + quote, 3)] if rng.random() < 0.8 else [(rng.choice(_KEYS) + sign, 0), (quote + value + quote, 3)]
        elif kind == 1:
            value = rng.choice([lambda: f"{code('0123456789', 3, 3)}-{code('0123456789', 2, 2)}-{code('0123456789', 4, 4)}", lambda: code("DFGE", 2, 2) + code("0123456789", 18, 20)])()
            put = [(rng.choice(_ID_NAMES), 0), (rng.choice([":", "is", "no."]), 0), (value, 1)]
        elif kind == 2:
            put = [(rng.choice(_TITLES), 0), *((w, 2) for w in ([rng.choice(_GIVEN)] if rng.random() < 0.5 else [])), (rng.choice(_FAMILY), 2)]
        elif kind == 3:  # things that only look alike
            put = rng.choice([[("the", 0), (rng.choice(_KEYS), 0), ("was", 0)], [("=", 0), (code("0123456789", 1, 6), 0)], [("Mr.", 0), ("and", 0)], [(made().capitalize(), 0)] * rng.randint(3, 12), [(made().capitalize(), 0) for _ in range(rng.randint(2, 8))], [(code("0123456789", 2, 16), 0)], [("|", 0), ("Total", 0), ("|", 0), (code("0123456789", 1, 4), 0)], [(f"+{code('0123456789', 2, 2)}", 0), ("(555)", 0), ("123-4567", 0)], [("a.b1@mail2.example.com", 0)], [("10.20.30.40", 0)], [('"quoted"', 0), ("words", 0)]])
        words += [w for w, _ in put]
        labels += [x for _, x in put]
        tail = fill(rng.randint(0, 6))
        out.append(([noise(w) if rng.random() < 0.25 else w for w in words + tail], labels + [0] * len(tail)))
    return out


class Crf:
    """Emissions are sums of weights of a word's features; "outside" stands before and after every line."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights.astype(np.float32), trans.astype(np.float32)
        t = self.trans
        # the most that another label y could gain over "outside" from its neighbours
        self.slack = (t[:, None, :] + t.T[None, :, :] - t[:, 0][:, None, None] - t[0][None, :, None]).max(axis=(0, 1))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for i in range(1, features.shape[1]):
            out += self.weights[features[:, i]]
        return out

    def decode(self, words: Words, width: int = 512) -> np.ndarray:
        """The label of every word."""
        n = len(words.start)
        labels = np.zeros(n, np.int64)
        if not n:
            return labels
        e = self.emissions(words.features)
        unsure = (e[:, 1:] + self.slack[1:] >= e[:, :1]).any(axis=1)
        # islands: runs of unsure words within a line
        start = unsure & (words.first | ~np.concatenate([[False], unsure[:-1]]))
        heads = np.flatnonzero(start)
        if not len(heads):
            return labels
        stop = unsure & np.concatenate([words.first[1:] | ~unsure[1:], [True]])
        lengths = np.flatnonzero(stop) + 1 - heads
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), width):
            part = order[at : at + width]
            self._viterbi(e, heads[part], lengths[part], labels)
        return labels

    def _viterbi(self, e: np.ndarray, heads: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> None:
        longest, many = int(lengths.max()), len(heads)
        back = np.zeros((longest, many, len(LABELS)), np.int8)
        best = self.trans[0][None, :] + e[heads]
        final = np.where((lengths == 1)[:, None], best, 0)
        for j in range(1, longest):
            live = j < lengths
            step = best[:, :, None] + self.trans[None, :, :]
            back[j] = step.argmax(axis=1)
            best = np.where(live[:, None], step.max(axis=1) + e[np.minimum(heads + j, len(e) - 1)], best)
            final = np.where((lengths == j + 1)[:, None], best, final)
        now = (final + self.trans[:, 0][None, :]).argmax(axis=1)
        for j in range(longest - 1, -1, -1):
            live = j < lengths
            labels[(heads + j)[live]] = now[live]
            now = np.where(live, back[j][np.arange(many), now], now)


def train_crf(lines: list[tuple[list[str], list[int]]], steps: int = 100, ridge: float = 0.02) -> Crf:
    """Maximum likelihood by Adam; forward and backward passes over all lines at once, padded to the longest."""
    lines = [x for x in lines if x[0]]
    words = Words("\n".join(" ".join(w) for w, _ in lines))
    used, compact = np.unique(words.features, return_inverse=True)
    compact = compact.reshape(words.features.shape)
    lengths = np.array([len(w) for w, _ in lines])
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    gold = np.concatenate([np.array(y) for _, y in lines])
    k, longest = len(LABELS), int(lengths.max())
    at = np.minimum(heads[:, None] + np.arange(longest), len(gold) - 1)
    live = np.arange(longest)[None, :] < lengths[:, None]
    padded = np.where(live, gold[at], 0)
    seen = np.zeros((k, k))
    paths = np.concatenate([np.zeros((len(lines), 1), np.int64), padded, np.zeros((len(lines), 1), np.int64)], axis=1)
    steps_live = np.concatenate([live, np.zeros((len(lines), 1), bool)], axis=1)
    steps_live[np.arange(len(lines)), lengths] = True
    np.add.at(seen, (paths[:, :-1][steps_live], paths[:, 1:][steps_live]), 1)
    p = np.zeros((len(used) + k) * k)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[: len(used) * k].reshape(-1, k), p[len(used) * k :].reshape(k, k)
        e = w[compact].sum(axis=1)[at]
        lse = lambda x, axis: (mx := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - mx).sum(axis=axis))
        a = np.zeros((longest, len(lines), k))
        b = np.zeros((longest, len(lines), k))
        a[0] = t[0] + e[:, 0]
        for j in range(1, longest):
            a[j] = np.where(live[:, j, None], lse(a[j - 1][:, :, None] + t[None], 1) + e[:, j], a[j - 1])
        b[longest - 1] = t[:, 0]
        for j in range(longest - 2, -1, -1):
            b[j] = np.where(live[:, j + 1, None], lse(t[None] + (e[:, j + 1] + b[j + 1])[:, None, :], 2), t[:, 0])
        z = lse(a[longest - 1] + t[:, 0], 1)
        marginal = np.exp(a + b - z[None, :, None]) * live.T[:, :, None]
        expected = np.zeros((k, k))
        expected[0] += marginal[0].sum(axis=0)
        expected[:, 0] += marginal[lengths - 1, np.arange(len(lines))].sum(axis=0)
        for j in range(1, longest):
            pair = np.exp(a[j - 1][:, :, None] + t[None] + (e[:, j] + b[j])[:, None, :] - z[:, None, None])
            expected += (pair * live[:, j, None, None]).sum(axis=0)
        diff = np.zeros((len(gold), k))
        diff[at[live]] = marginal.transpose(1, 0, 2)[live]
        diff[np.arange(len(gold)), gold] -= 1
        g_w = np.stack([np.bincount(compact.ravel(), np.repeat(diff[:, y], compact.shape[1]), len(used)) for y in range(k)], axis=1)
        g = np.concatenate([g_w.ravel(), (expected - seen).ravel()]) + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((SPACE, k))
    weights[used] = p[: len(used) * k].reshape(-1, k)
    return Crf(weights, p[len(used) * k :].reshape(k, k))


@lru_cache(maxsize=1)
def default_crf() -> Crf:
    """Trained from the labelled table once a process (about a second), and the same everywhere."""
    return train_crf(labelled_lines())


# ---- spans of texts

_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def find(texts: list[str], crf: Crf, chars: int = 400_000) -> Iterator[list[Span]]:
    """For each text the base spans, by kind as listed and start, then those that the CRF adds: none overlaps a base span."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) <= chars):
            total += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        words = Words("\n".join(part))
        label = crf.decode(words)
        hits = np.flatnonzero(label)
        starts = np.cumsum([0, *(len(t) + 1 for t in part)])
        owner = np.searchsorted(starts, words.start[hits], "right") - 1
        added: dict[int, list[Span]] = {}
        for h, i in zip(hits.tolist(), owner.tolist(), strict=True):
            a, b = int(words.start[h] - starts[i]), int(words.end[h] - starts[i])
            raw = part[i][a:b]
            core = _TRIM.sub("", raw)
            if core:
                a += raw.index(core)
                spans = added.setdefault(i, [])
                kind = LABELS[label[h]]
                if spans and kind == "name" and spans[-1][0] == "name" and a - spans[-1][2] == 1:
                    spans[-1] = (kind, spans[-1][1], a + len(core))
                else:
                    spans.append((kind, a, a + len(core)))
        for i, text in enumerate(part):
            base = base_spans(text)
            more = sorted(s for s in added.get(i, ()) if not any(s[1] < y and x < s[2] for _, x, y in base))
            yield base + more
        first = last


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, all spans, and how many the method found of each kind and of all in all."""
    crf = crf or default_crf()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in LABELS[1:]), "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in find(batch.column(1).to_pylist(), crf):
                base = [s for s in found if s[0] in BASE]
                count = Counter(s[0] for s in found)
                rows.append((*(count[k] for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), *(count[k] for k in LABELS[1:]), len(found)))
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names[1:], cols, strict=True))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names[1:])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def redacted(text: str, found: list[Span]) -> str:
    """Each span replaced with its kind in capitals; overlapping spans are one, named after the first."""
    out, free = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"<{kind.upper()}>"]
        free = max(free, b)
    return "".join(out) + text[free:]


def redact(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """docs with personal data in text replaced; a null text stays null. n_chars, if there, follows."""
    crf = crf or default_crf()
    at = docs.columns.index("text")

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redacted(t, s) if s else t for t, s in zip(texts, find([t or "" for t in texts], crf), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
