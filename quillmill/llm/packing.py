"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Tokenising is a narrow pass: each task encodes its rows in Arrow batches and returns numbers only. Documents longer than a
sequence are cut into full pieces and a last one. How pieces combine depends on nothing but their lengths, of which there are
at most ``capacity``, so best-two-fit runs on the histogram of lengths (a bounded table, whatever the input): it yields bin
patterns with multiplicities. A piece finds its place by its rank among pieces of its length. Ranks are counted per
(length, bucket) with bucket offsets, so that a length which a third of all pieces share is spread over many tasks.

Best-two-fit: a bin is filled greedily with the longest pieces that still fit; then its smallest piece is replaced with two
unpacked ones that fit into the gap this opens more tightly, as long as there are such.

Defined results: a null text counts as empty and gives one piece, the end id alone. Repeated rows are packed each for itself.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, returning

CAPACITY, END_ID = 2048, 0
#: Fixed value: texts go to Python in batches of this many bytes, about one portion each.
BATCH_BYTES = 3 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters only can be encoded word by word: no combining marks, no unusual white space or controls, and lower-casing keeps the length.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
#: Special tokens are looked for in a text as it stands, before anything is lower-cased; all begin like this.
_SPECIAL = "<|"
#: Fixed value: what the tokenizer encodes on its own, and how it marks the last token of each.
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LAST = "</w>"
#: Words of these letters with these signs around them are cut into units without the pattern.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower())
_SIGNS = string.punctuation


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple:
    """The tokenizer, one of the same model for lower-case units with spaces between, and which ids end a unit."""
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads beside it would each hold memory
    out = Tokenizer.from_file(path)
    units = Tokenizer(out.model)  # nothing is left to normalise or to be found by a pattern
    units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(out.get_vocab_size(), bool)
    ends[[i for token, i in out.get_vocab().items() if token.endswith(_LAST)]] = True
    return out, units, ends


def _gather(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids holds lists of n ids one after another: those of the lists at, likewise, and how many each has."""
    found = n[at]
    upto = np.cumsum(found)
    return ids[np.repeat((np.cumsum(n) - n)[at] - (upto - found), found) + np.arange(int(found.sum()))], found


def _apart(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all words in order, and which word each is of. Arrow cuts signs off letters, the pattern is for other words."""
    core = pc.utf8_trim(words, _SIGNS)
    core = pc.if_else(pc.equal(core, ""), words, core)  # signs only: one unit
    lead = pc.utf8_rtrim(pc.utf8_rtrim(words, _SIGNS), _LETTERS)
    tail = pc.utf8_ltrim(pc.utf8_ltrim(words, _SIGNS), _LETTERS)
    size = [pc.binary_length(p).to_numpy(zero_copy_only=False) for p in (lead, core, tail, words)]
    # an apostrophe before letters may be a unit with them
    easy = pc.and_(pc.or_(pc.utf8_is_alpha(core), pc.equal(pc.utf8_trim(core, _SIGNS), "")), pc.invert(pc.match_substring(lead, "'"))).to_numpy(zero_copy_only=False)
    easy &= size[0] + size[1] + size[2] == size[3]
    of = [np.flatnonzero(easy & (n > 0)) for n in size[:3]]
    parts = [p.take(pa.array(i)) for p, i in zip((lead, core, tail), of, strict=True)]
    hard = np.flatnonzero(~easy)
    cut = [_UNIT.findall(w) for w in words.take(pa.array(hard)).to_numpy(zero_copy_only=False).tolist()]
    parts.append(pa.array([u for us in cut for u in us], pa.large_string()))
    of.append(np.repeat(hard, np.fromiter(map(len, cut), np.int64, len(cut))))
    owner = np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return pa.concat_arrays(parts).take(pa.array(order)), owner[order]


class Encoder:
    """Token ids of texts as bytes (unsigned 32-bit, little-endian). Remembers the ids of up to max_words units, in flat arrays.

    The tokenizer cuts a text into units (runs of letters, single digits, runs of signs) and encodes each on its own. Plain texts
    are cut into words by Arrow, the different words of a portion into units; the units not yet known are encoded, the ids of
    words are put together of their units', and those of all occurrences are gathered in numpy. Units are looked up once a
    portion, since each look-up has Arrow index all that are known. Other texts, and those that may hold a special token, go to
    the tokenizer as they are.
    """

    def __init__(self, path: str, max_words: int = 500_000) -> None:
        self.tokenizer, self.unit_tokenizer, self.ends = _tokenizer(path)
        self.max_words = max_words
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_string())
        self.ids, self.n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _learn(self, units: pa.Array, block: int = 500) -> None:
        listed = units.to_numpy(zero_copy_only=False).tolist()
        found = self.unit_tokenizer.encode_batch_fast([" ".join(listed[i : i + block]) for i in range(0, len(listed), block)], add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, "<u4") for f in found])
        n = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[ids])]))
        self.units = pa.concat_arrays([self.units, units])
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where different units stand among those known, which they all are afterwards."""
        if len(self.units) > self.max_words:
            self._forget()
        at = pc.fill_null(pc.index_in(units, self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            at[new] = len(self.units) + np.arange(int(new.sum()))
            self._learn(units.filter(pa.array(new)))
        return at

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        words = split.flatten().dictionary_encode()
        units, owner = _apart(words.dictionary)
        units = units.dictionary_encode()
        at = self._places(units.dictionary)[units.indices.to_numpy()]  # before ids and n are read: it may add to both
        ids, n = _gather(self.ids, self.n, at)
        per = np.bincount(owner, n, len(words.dictionary)).astype(np.int64)
        ids, n = _gather(ids, per, words.indices.to_numpy())
        raw = ids.tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _whole(self, text: str, most: int = 200_000) -> bytes:
        """Any text, in stretches so that one call's tokens stay few: cut at white space before plain characters, where nothing is joined."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + most)
            end = cut.start() if cut else len(text)
            out.append(np.array(self.tokenizer.encode(text[at:end], add_special_tokens=False).ids, "<u4").tobytes())
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if _SPECIAL not in t and _PLAIN.fullmatch(t)]
        found = dict(zip(plain, self._plain([texts[i] for i in plain]), strict=True)) if plain else {}
        return [found[i] if i in found else self._whole(t) for i, t in enumerate(texts)]


_CUT = re.compile(r"[ \n][a-zA-Z0-9]")


def _portions(texts: list[str], chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > chars:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and on request the ids themselves as bytes."""
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}") + (", ids binary" if with_ids else "")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)  # what it remembers goes with the task
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _portions(texts):
                owner, rows = [], []
                for i, raw in enumerate(own.encode(texts[a:b]), a):
                    raw += end
                    for j in range(0, len(raw), 4 * capacity):
                        part = raw[j : j + 4 * capacity]
                        owner.append(i)
                        rows.append((j // (4 * capacity), j // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], fields)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


Pattern = tuple[tuple[int, ...], int]  # the lengths in a bin, longest first, and how many such bins


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins for a histogram of lengths. Each step uses a pattern as often as its rarest length allows, so steps are few."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    index = np.arange(capacity + 1)
    patterns: list[Pattern] = []
    top = capacity
    while True:
        while top > 0 and not count[top]:
            top -= 1
        if top == 0:
            return patterns
        left = count.copy()
        left[top] -= 1
        inside, gap = [top], capacity - top
        while gap > 0:
            fit = np.flatnonzero(left[1 : gap + 1])
            if not len(fit):
                break
            length = int(fit[-1]) + 1
            n = min(gap // length, int(left[length]))
            left[length] -= n
            inside += [length] * n
            gap -= n * length
        while gap > 0 and len(inside) > 1:
            small = inside[-1]
            room = gap + small
            # for each first piece the longest second one that fits beside it
            longest = np.maximum.accumulate(np.where(left[: room + 1] > 0, index[: room + 1], 0))
            first = np.flatnonzero(left[: room + 1])
            first = first[first < room]
            if not len(first):
                break
            second = longest[room - first]
            alone = (second == first) & (left[first] < 2)
            second[alone] = longest[np.maximum(first[alone] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            left[small] += 1
            pair = [int(first[best]), int(second[best])]
            for x in pair:
                left[x] -= 1
            inside = sorted(inside[:-1] + pair, reverse=True)
            gap = capacity - sum(inside)
        used = Counter(inside)
        times = min(int(count[x]) // k for x, k in used.items())
        for x, k in used.items():
            count[x] -= times * k
        patterns.append((tuple(inside), times))


def intervals(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces of this length in a bin, offset of the first of them), sorted."""
    taken: Counter[int] = Counter()
    rows, bins = [], 0
    for inside, times in patterns:
        at = 0
        for length, k in Counter(inside).items():  # longest first, as inside is
            rows.append((length, taken[length], bins, k, at))
            taken[length] += k * times
            at += k * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, patterns: list[Pattern], buckets: int) -> DataFrame:
    """pieces with sequence_id and offset. The closure holds one row a (length, pattern), bounded by the capacity."""
    rows = intervals(patterns)
    keys = (rows[:, 0] << 44) | rows[:, 1]
    columns = list(pieces.columns)
    df = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = df.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ordered = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    df = df.join(offsets, ["length", "_bucket"]).select(*columns, (F.col("_before") + F.row_number().over(ordered) - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            _, first, bins, k, offset = rows[at].T
            within = rank - first
            arrays = [*batch.columns[:-1], pa.array(bins + within // k), pa.array(offset + (within % k) * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return df.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = materialise(tokenised(docs, vocabulary, capacity, end_id, with_ids), BATCH_BYTES)
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    buckets = max(64, sum(histogram.values()) // 200_000)
    return place(pieces, best_two_fit(histogram, capacity), buckets)


def sequences(packed: DataFrame) -> DataFrame:
    """packed with ids: one row a sequence, (sequence_id, ids as bytes). A sequence holds at most its capacity, so groups are small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
