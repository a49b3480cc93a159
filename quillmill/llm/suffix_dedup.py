"""Removal of repeated passages: every byte covered by a ``width``-byte string that also starts in a document of smaller id.

A suffix array of the whole corpus would pass each byte's suffix through several sorts of records many times its size. Suffixes
that can't matter are kept out first, exactly:

1. Anchors. Every 16-byte string has a hash; in each window of ``width`` bytes the least one is the window's anchor. Equal
   windows have equal anchors, so only anchors that two documents share can lie in a repeated window. About 6 % of the
   positions are anchors.
2. Blocks. An anchor's block is the text that its windows can reach. Blocks are known by hashes (of the anchor, the block and
   what lies at its sides), made where the text is read, and dealt by their anchor's in buckets of about half a million, once, so
   all occurrences of a repeated window meet. What repeats a smaller id's block is done there, and so are blocks whose
   surroundings are like no other's. Only of the rest, a tenth or so, rows are written and the bytes fetched, once for all copies.
3. Difference-cover suffix sorting of every bucket of blocks: suffixes at positions 1 and 2 modulo 3 are sorted by triples, the
   triples' names are sorted recursively, the remaining suffixes are merged in, and neighbours in the suffix array are compared
   by their first ``width`` bytes. Runs that agree get the least id; windows that a smaller document has are marked.
4. Marks go back to the blocks' places, intervals are gathered by document and cut out of the text.

An anchor that more than ``heavy`` different blocks share (a line that stands in ever new surroundings) is not sorted in one
task: its windows become rows and their least id is aggregated. So no key, however common, is gathered in one place.

Defined results: a null text is empty; a text shorter than ``width`` bytes loses nothing. A null doc_id counts as larger than
any other. Rows of one doc_id are not repeats of each other, since no id among them is smaller. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, returning, returning_group

WIDTH, GRAM = 50, 16
_LAST = (1 << 63) - 1


# ---- anchors


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    h = (eight[:n] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = (h + eight[8 : 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    f = np.minimum if least else np.maximum
    span, out = 1, x
    while span * 2 <= width:
        out = f(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, position, hash) of the anchors of texts."""
    long = [i for i, t in enumerate(texts) if len(t) >= width]
    none = np.zeros(0, np.int64)
    if not long:
        return none, none, none
    lengths = np.array([len(texts[i]) for i in long])
    starts = np.cumsum(lengths) - lengths
    h = _gram_hashes(np.frombuffer(b"".join([texts[i] for i in long]), np.uint8))
    w = width - GRAM + 1
    low = _sliding(h, w, True)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, False) == h)
    owner = np.searchsorted(starts, at, "right") - 1
    inside = at - starts[owner] + GRAM <= lengths[owner]  # windows across two texts add candidates at most
    at, owner = at[inside], owner[inside]
    return np.array(long)[owner], at - starts[owner], h[at].astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """rid (one a row), ord (the id that is compared) and text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if df.groupBy("doc_id").count().where("`count` > 1 OR doc_id IS NULL").isEmpty():
        return df.select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("ord"), "doc_id", "text")
    numbered = df.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "doc_id", "text")
    return materialise(numbered)  # row numbers must not change when a task is run again


def _portions(sizes: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


#: Bytes of h, key, lo, hi, rid (as its difference from the one before), ord (from rid), start and n in a packed block. Of h and the sides fewer will do: equal ones by chance are candidates more, no more. h and key, which are independent, tell blocks apart by 80 bits.
_BYTES = (4, 6, 3, 3, 8, 8, 4, 1)


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """A column for each record, a row for each byte of it: bytes of one significance lie together, so the constant ones shrink to nothing."""
    return np.concatenate([np.ascontiguousarray(c.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :n].T for c, n in zip(columns, _BYTES, strict=True)])


def _unpacked(rows: list[bytes]) -> list[np.ndarray]:
    planes = np.concatenate([np.zeros((sum(_BYTES), 0), np.uint8), *(np.frombuffer(r, np.uint8).reshape(sum(_BYTES), -1) for r in rows)], axis=1)
    out, first = [], 0
    for n in _BYTES:
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :n] = planes[first : first + n].T
        out.append(wide.view("<i8").ravel())
        first += n
    step, more, end = out[4], out[5], 0
    for r in rows:
        begin, end = end, end + len(r) // sum(_BYTES)
        np.cumsum(step[begin:end], out=step[begin:end])
    more += step
    return out


def _hashes(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each of the places on."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        x = eight[at + k] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _blocks_of(raws: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """For each anchor of texts, in order of text and place: owner, its hash, the hash of its block (key, of which the anchor's place is part), of the bytes at its left and right (0 where the text ends), and where the block lies (start, n)."""
    reach, half = width - GRAM, (width - GRAM + 1) // 2
    data, sizes = b"".join(raws), np.array([len(r) for r in raws])
    parts = [(a, *anchors(raws[a:b], width)) for a, b in _portions(sizes.tolist(), 1_000_000)]  # a portion's hashes at once are fifty times its size
    owner, at, h = (np.concatenate(x) for x in zip(*((a + owner, at, h) for a, owner, at, h in parts), strict=True))
    base = (np.cumsum(sizes) - sizes)[owner]
    start, end = np.maximum(0, at - reach), np.minimum(sizes[owner], at + width)
    digest = xxhash.xxh64_intdigest
    full = end - start == reach + width
    key = np.zeros(len(at), np.uint64)
    key[full] = _hashes(data, (base + start)[full], reach + width)
    key[~full] = [digest(data[i:j], k) for i, j, k in zip((base + start)[~full].tolist(), (base + end)[~full].tolist(), (at - start)[~full].tolist(), strict=True)]
    lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for side, there, first in ((lo, at >= half, at - half), (hi, at + GRAM + half <= sizes[owner], at)):
        side[there] = (_hashes(data, (base + first)[there], GRAM + half) % np.uint64((1 << 24) - 1)).astype(np.int64) + 1
    return owner, h, key.astype(np.int64), lo, hi, start, end - start


def _groups(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(x):
        return np.zeros(0, np.int64)
    other = x[1:] != x[:-1]
    for y in more:
        other = other | (y[1:] != y[:-1])
    return np.flatnonzero(np.concatenate([[True], other]))


def packed_blocks(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """Blocks by bucket of their anchor's hash, some thousand in a row (blocks), and what a portion knows to be repeated: rid, start and n (pieces).

    A block that a smaller id of the portion has too is a piece; pieces of a text that touch are one. So a bucket gets a block from one id a portion, however common it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ords = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for a, b in _portions([len(t) for t in texts]):
                owner, h, key, lo, hi, start, n = _blocks_of(texts[a:b], width)
                if not len(h):
                    continue
                rid, ord_ = rids[a:b][owner], ords[a:b][owner]
                order = np.argsort(key, kind="stable")
                head = _groups(key[order])
                least = np.empty(len(key), np.int64)
                least[order] = np.repeat(np.minimum.reduceat(ord_[order], head), np.diff(np.append(head, len(key))))
                again = ord_ > least
                x, begin, end = owner[again], start[again], (start + n)[again]
                first = np.flatnonzero(np.concatenate([[True] * (len(x) > 0), (x[1:] != x[:-1]) | (begin[1:] > end[:-1])]))
                end = end[np.append(first[1:], len(x)) - 1] if len(first) else end
                pieces = np.array([rids[a:b][x[first]], begin[first], end - begin[first]], np.int64).tobytes()
                columns = [c[~again] for c in (h, key, lo, hi, rid, ord_, start, n)]
                place = (columns[0] >> 8 * _BYTES[0]) % buckets  # by those bits of h that are left out
                order = np.argsort(place, kind="stable")
                place, columns = place[order], [c[order] for c in columns]
                found = np.unique(place)
                cuts = np.searchsorted(place, np.append(found, buckets))
                columns[5] -= columns[4]
                step = np.diff(columns[4], prepend=0)
                step[cuts[:-1]] = columns[4][cuts[:-1]]
                columns[4] = step
                packed, cuts = _packed(columns), cuts.tolist()
                blocks = [packed[:, i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blocks, pa.binary()), pa.array([pieces, *[b""] * (len(blocks) - 1)], pa.binary())], ["bucket", "blocks", "pieces"])

    return rows.select("rid", "ord", "text").mapInArrow(returning(run), "bucket long, blocks binary, pieces binary")


def judged_blocks(packed: DataFrame) -> DataFrame:
    """(kind, h, key, least, rid, start, n): what is repeated (kind 0), and the blocks that share what lies left or right of their anchor with another block of another least id: one for each (kind 1), and its others in rows of that id (kind 2).

    A window holds its anchor's 16 bytes and half of its other bytes at least on one side, so blocks whose sides are both unlike all others have no equal window.
    """

    def judge(table: pa.Table) -> pa.Table:
        h, key, lo, hi, rid, ord_, start, n = _unpacked(table.column("blocks").to_pylist())
        order = np.lexsort((key, h))
        h, key, lo, hi, rid, ord_, start, n = (x[order] for x in (h, key, lo, hi, rid, ord_, start, n))
        del order
        head = _groups(h, key)
        times = np.diff(np.append(head, len(h)))
        least = np.minimum.reduceat(ord_, head) if len(head) else ord_
        like = np.zeros(len(head), bool)
        top = _groups(h[head])
        some = np.flatnonzero(np.repeat(np.diff(np.append(top, len(head))) > 1, np.diff(np.append(top, len(head)))))
        for side in (lo, hi):
            at = some[side[head[some]] > 0]
            mixed = h[head[at]] * np.int64(0x1E3779B97F4A7C15) + side[head[at]] * np.int64(0x165667B19E3779F9)
            at, mixed = (x[np.argsort(mixed)] for x in (at, mixed))
            if len(at):
                cut = _groups(mixed)
                differ = np.minimum.reduceat(least[at], cut) < np.maximum.reduceat(least[at], cut)
                like[at[np.repeat(differ, np.diff(np.append(cut, len(at))))]] = True
        least, like = np.repeat(least, times), np.repeat(like, times)
        again = ord_ > least
        once = np.flatnonzero(like & ~again)
        kind = np.where(np.concatenate([[True] * (len(once) > 0), key[once][1:] != key[once][:-1]]), 1, 2).astype(np.int32)
        pieces = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(p, np.int64).reshape(3, -1) for p in table.column("pieces").to_pylist())], axis=1)
        zeros = np.zeros(pieces.shape[1] + int(again.sum()), np.int64)
        columns = [np.concatenate([zeros, x]) for x in (kind, h[once], key[once], least[once])]
        columns += [np.concatenate([p, x[again], x[once]]) for p, x in zip(pieces, (rid, start, n), strict=True)]
        order = np.lexsort((columns[5], columns[4], columns[0]))  # by row: such columns are written in a fraction of the space
        return pa.table([pa.array(c[order], t) for c, t in zip(columns, _JUDGED.values(), strict=True)], list(_JUDGED))

    return packed.groupBy("bucket").applyInArrow(returning_group(judge), "kind int, h long, key long, least long, rid long, start int, n int")


_JUDGED = dict.fromkeys(("kind", "h", "key", "least", "rid", "start", "n"), pa.int64()) | dict.fromkeys(("kind", "start", "n"), pa.int32())


# ---- difference-cover suffix sorting


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of letters >= 1 whose suffixes all differ within the string (DC3)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    bits = np.uint64(max(1, int(s.max()).bit_length()))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # n % 3 == 1: an empty suffix stands in, so that names at 1 end with a zero
    sample = np.concatenate([one, two])
    triple = (((t[sample] << bits) | t[sample + 1]) << bits) | t[sample + 2]
    found, name = np.unique(triple, return_inverse=True)
    if len(found) < len(sample):
        order = suffix_array(name + 1)
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.arange(len(sample))
    else:
        rank = name
    ranks = np.zeros(n + 3, np.uint64)
    ranks[sample] = rank.astype(np.uint64) + np.uint64(1)
    sorted12 = sample[np.argsort(rank)]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    wide = np.uint64(max(1, int(n + 1).bit_length()))
    key1 = lambda i: (t[i] << wide) | ranks[i + 1]
    key2 = lambda i: (((t[i] << bits) | t[i + 1]) << wide) | ranks[i + 2]
    zero = zero[np.argsort(key1(zero), kind="stable")]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    place = np.arange(len(zero)) + np.searchsorted(key1(ones), key1(zero)) + np.searchsorted(key2(twos), key2(zero))
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = sorted12
    return out


def marks(blocks: list[bytes], least: np.ndarray, width: int = WIDTH) -> list[int]:
    """For each block the windows, as bits, that a block of smaller least id has too."""
    lengths = np.array([len(b) for b in blocks])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int((lengths + 1).sum()), 0, np.int64)
    ends = starts + lengths
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int64) + 1
    text[ends] = 257 + np.arange(len(blocks))  # every block ends with a letter of its own
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(blocks)), lengths + 1)
    whole = order + width <= ends[owner[order]]
    order = order[whole]
    if not len(order):
        return [0] * len(blocks)
    # neighbours in the suffix array that agree on their first letters; no end lies in a whole window, so bytes will do, eight at once
    eight = np.ndarray((len(text),), np.uint64, text.astype(np.uint8).tobytes() + bytes(8), 0, (1,))
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, width - 8, 8), width - 8]:
        live = np.flatnonzero(same)
        same[live] = eight[order[live] + k] == eight[order[live + 1] + k]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    first = np.minimum.reduceat(least[owner[order]], head)
    group = np.cumsum(np.concatenate([[0], ~same]))
    hit = order[first[group] < least[owner[order]]]
    # at most 48 different bits a block: their sum is exact in doubles
    bits = np.exp2(hit - starts[owner[hit]])
    return np.bincount(owner[hit], bits, len(blocks)).astype(np.int64).tolist()


# ---- blocks

def _listed(batch: pa.RecordBatch, column: int, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs, as arrays; a null list is empty."""
    lists = batch.column(column)
    return lists.offsets.to_numpy(), [lists.values.field(f).to_numpy(zero_copy_only=False) for f in fields]


def block_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The blocks (bucket, h, key, least, rid, start, n) with their bytes, each taken from one row that has it."""
    fields = ["bucket", "h", "key", "least", "start", "n"]
    per_row = chosen.groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, columns = _listed(batch, 1, *fields)
            offsets, starts, sizes = offsets.tolist(), columns[4].tolist(), columns[5].tolist()
            blocks = []
            for i, text in enumerate(batch.column(0).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                blocks += [raw[starts[j] : starts[j] + sizes[j]] for j in range(offsets[i], offsets[i + 1])]
            part = slice(offsets[0], offsets[-1])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[part], pa.int64()) for c in columns[:4]), pa.array(blocks, pa.binary())], [*fields[:4], "block"])

    return rows.select("rid", "text").join(per_row, "rid").select("text", "a").mapInArrow(returning(run), "bucket long, h long, key long, least long, block binary")


def buckets_of(blocks: DataFrame, per_bucket: int) -> int:
    """What is known to be repeated is counted too: there are never too few."""
    return max(1, -(-blocks.count() // per_bucket))


def verdicts(rows: DataFrame, blocks: DataFrame, width: int, per_bucket: int = 12_000, heavy: int = 6_000) -> DataFrame:
    """(h, key, mask): the windows, as bits, of the judged blocks that a smaller id has too; blocks without any are left out."""
    buckets = buckets_of(blocks, per_bucket)
    alike = blocks.where("kind = 1").drop("kind")
    common = materialise(alike.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > heavy).select("h"))
    bucket, many = F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("long"), not common.isEmpty()
    if many:
        bucket = F.when(F.col("hot"), F.lit(-1).cast("long")).otherwise(bucket)
        alike = alike.join(common.withColumn("hot", F.lit(True)), "h", "left")
    texts = materialise(block_texts(rows, alike.select(bucket.alias("bucket"), "h", "key", "least", "rid", "start", "n")))

    def sort(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        cuts = [0]
        for i in np.flatnonzero(np.diff(h[order])).tolist():  # a bucket may hold more than one string should
            if i + 1 - cuts[-1] >= per_bucket:
                cuts.append(i + 1)
        hits, masks = [], []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:b]
            found = marks(table.column("block").take(pa.array(part)).to_pylist(), table.column("least").to_numpy()[part], width)
            hit = [i for i, m in enumerate(found) if m]
            hits += part[hit].tolist()
            masks += [found[i] for i in hit]
        return table.select(["h", "key"]).take(pa.array(hits, pa.int64())).append_column("mask", pa.array(masks, pa.int64()))

    found = texts.where("bucket >= 0").groupBy("bucket").applyInArrow(returning_group(sort), "h long, key long, mask long")
    if not many:
        return _step(found, texts, common)
    offsets = F.sequence(F.lit(0), F.length("block") - width)
    windows = texts.where("bucket < 0").select("h", "key", "least", F.posexplode(F.transform(offsets, lambda i: F.substring(F.col("block"), i + 1, F.lit(width)))).alias("i", "w"))
    windows = windows.select("h", "key", "least", "i", F.unhex(F.md5("w")).alias("w"))
    first = _step(windows.groupBy("w").agg(F.min("least").alias("first")), common)  # a table: Spark can split the join at a window that stands everywhere
    marked = windows.join(first, "w").where("first < least").groupBy("h", "key").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    return _step(found.union(marked), texts, first)


def runs_of(owner: np.ndarray, start: np.ndarray, length: np.ndarray, mask: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the maximal runs that pieces cover, in order. A piece without a length has the windows of its mask."""
    base = np.cumsum(sizes + 1) - (sizes + 1)  # a byte between texts keeps their runs apart
    start = base[owner] + start
    whole = length > 0
    bits, at = mask[~whole], start[~whole]
    ones = lambda x: np.nonzero(np.unpackbits(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    of, first = ones(bits & ~(bits << 1))  # neighbouring windows are one interval
    _, last = ones(bits & ~(bits >> 1))
    begin = np.concatenate([start[whole], at[of] + first])
    end = np.concatenate([start[whole] + length[whole], at[of] + last + width])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.concatenate([[True] * (len(begin) > 0), begin[1:] > end[:-1]]))
    begin, end = begin[head], end[np.append(head[1:], len(end)) - 1] if len(head) else end
    text = np.searchsorted(base, begin, "right") - 1
    return text, begin - base[text], end - base[text]


def _step(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes df, then deletes the tables that were made for it alone."""
    out = materialise(df)
    discard(*done)
    return out


def spans(rows: DataFrame, width: int = WIDTH, bucket_bytes: int = 10_000_000) -> DataFrame:
    """(rid, pieces): for every row with something to remove, structs start, length, mask; length 0 means that the mask says which windows go."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    judged = materialise(judged_blocks(packed_blocks(rows, width, max(1, -(-size // bucket_bytes)))), batch_bytes=4_000_000)
    found = verdicts(rows, judged, width)
    piece = lambda length, mask: F.struct("start", F.col(length).alias("length") if length else F.lit(0).alias("length"), mask.alias("mask"))
    whole = judged.where("kind = 0").select("rid", piece("n", F.lit(0).cast("long")).alias("piece"))
    partly = judged.where("kind > 0").select("h", "key", "rid", "start").join(found, ["h", "key"]).select("rid", piece("", F.col("mask")).alias("piece"))
    return _step(whole.union(partly).groupBy("rid").agg(F.collect_list("piece").alias("pieces")), judged, found)  # gone before the texts are dealt


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; on request kept, the bytes that stay."""
    if not GRAM <= width <= GRAM + 47:
        raise ValueError("windows of a block must fit the bits of a mask")
    rows = _rows(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.select("rid", "doc_id", "text").join(spans(rows, width), "rid", "left").select("doc_id", "text", "pieces")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            offsets, fields = _listed(batch, 2, "start", "length", "mask")
            texts = batch.column(1).to_pylist()
            for a, b in _portions([len(t) for t in texts]):
                raws = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                owner = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                found = runs_of(owner, *(x[offsets[a] : offsets[b]].astype(np.int64) for x in fields), np.array([len(r) for r in raws]), width)
                cuts = np.searchsorted(found[0], np.arange(b - a + 1)).tolist()
                begins, ends = found[1].tolist(), found[2].tolist()
                for i, raw in enumerate(raws):
                    begin, end = begins[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]
                    kept = b"".join([raw[x:y] for x, y in zip([0, *end], [*begin, len(raw)], strict=True)]) if begin else raw
                    out.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return joined.mapInArrow(returning(run), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
