"""Phrase collocation mining over vertical positional inverted lists.

Texts are gathered into blocks of one language; a block keeps, for each phrase in it, the list of positions where the phrase
stands. Words stand at positions one apart, and pieces are a position apart more, so that no phrase crosses from one to the
next. A phrase of n + 1 words stands where a frequent phrase of n words stands and the next position's posting continues it,
which is to say that it ends in a frequent phrase of n words too: both lists are sorted by position and merge-joined, a block at
a time, in numpy. The length of a list is the phrase's exact frequency in the block; lengths are summed over blocks.

Level by level: rows (phrase, block, length) without positions are windowed by phrase, which gives the frequency everywhere, and
as the phrase's id the place where it is met first; the frequent ones go back to their blocks, where they meet the positions,
and the next level's lists are made. A phrase has a row a block at most, so a phrase that is a third of all words has no more
rows than there are blocks, and no task holds more than a block's positions. Ids are exact: no hash stands for a phrase.

Defined results: a null text is empty, a null lang is ``und`` (and meets documents that say so); an empty lang is a language of
its own. Repeated rows count as often as they stand there. A language without candidates has no row; an empty table gives an
empty result. Other columns, doc_id included, are not read. A text is never cut: one longer than a block is a block alone, and
its task needs some 80 bytes for each of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, returning

#: Bytes that end a piece, as newlines; tabs as spaces; A-Z as a-z.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A place is a block and an ordinal in it: 2**36 blocks of 2**27 phrases.
_BITS, _BLOCKS = 27, 12
_LISTS = "block long, lang string, ordinal int, a {0}, b {0}, n int, lists binary"


def _packed(counts: np.ndarray, positions: np.ndarray) -> bytes:
    """The lengths of lists and the lists, one after the other: int32 in byte planes, compressed."""
    numbers = np.concatenate([[len(counts)], counts, positions]).astype("<i4")
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()
    return numbers[1 : 1 + numbers[0]], numbers[1 + numbers[0] :]


def _tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The words, and for each position the word there: 0 ends a piece."""
    data = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_PLAIN).replace(b"\n", b" \n ")
    found: defaultdict[bytes, int] = defaultdict()
    found.default_factory = found.__len__
    gap, nothing = found[b"\n"], found[b""]
    raw = data.split(b" ")
    ids = np.fromiter(map(found.__getitem__, raw), np.int32, len(raw))
    ids = ids[ids != nothing]
    words = list(found)
    return words[2:], np.where(ids == gap, 0, ids - 1)


def _batch(block: int, lang: str, first: pa.Array, second: pa.Array, counts: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """A row for each phrase of a block, and one with all their lists, one after the other."""
    m = len(counts)
    one = lambda x, kind, empty: pa.concat_arrays([x.cast(kind), pa.array([empty], kind)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m + 1, block)), pa.array([lang] * (m + 1)), one(pa.array(np.arange(m, dtype=np.int32)), pa.int32(), -1),
            one(first, first.type, None), one(second, second.type, None), one(pa.array(counts.astype(np.int32)), pa.int32(), None), pa.array([None] * m + [_packed(counts, positions)], pa.binary()),
        ],
        ["block", "lang", "ordinal", "a", "b", "n", "lists"],
    )


def word_lists(docs: DataFrame, block_chars: int = 8_000_000) -> DataFrame:
    """Level 1: block, lang, ordinal, a (the word), n (the length of its list); and for each block a row of ordinal -1 with lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        texts: defaultdict[str, list[str]] = defaultdict(list)
        chars: defaultdict[str, int] = defaultdict(int)

        def block(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            words, at = _tokens(texts.pop(lang))
            del chars[lang]
            if not words:
                return
            if made >> _BLOCKS:
                raise ValueError("more blocks in a task than places can name; use more partitions")
            order = np.argsort(at, kind="stable").astype(np.int32)
            counts = np.bincount(at, minlength=len(words) + 1)
            yield _batch((TaskContext.get().partitionId() << _BLOCKS) | made, lang, pa.array(words, pa.binary()).cast(pa.string()), pa.nulls(len(words), pa.string()), counts[1:], order[counts[0] :])
            made += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
                chars[lang] += len(text)
                if chars[lang] > block_chars or sum(chars.values()) > 2 * block_chars:
                    yield from block(max(chars, key=lambda x: chars[x]))
        for lang in list(texts):
            yield from block(lang)

    df = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return df.mapInArrow(returning(run), _LISTS.format("string"))


def frequent(lists: DataFrame, least: int) -> DataFrame:
    """place, id, f and what the phrase is made of (lang, a, b), for each phrase of each block that stands in all blocks together ``least`` times; place = id in one row a phrase."""
    same = Window.partitionBy("lang", "a", "b")
    place = (F.shiftleft("block", _BITS) + F.col("ordinal")).alias("place")
    rows = lists.where("ordinal >= 0").select(place, "lang", "a", "b", "n")
    return rows.withColumns({"f": F.sum("n").over(same), "id": F.min("place").over(same)}).where(F.col("f") >= least).drop("n")


def longer(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The next level's lists, as word_lists() gives them: a and b are the ids of the phrases that a phrase begins and ends with."""

    def extend(block: int, lang: str, packed: bytes, ordinal: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        counts, everywhere = _unpacked(packed)
        name = np.full(len(counts), -1)
        name[ordinal] = np.arange(len(ordinal))  # of the frequent ones, within the block
        names = np.repeat(name, counts)
        positions, names = everywhere[names >= 0], names[names >= 0]
        order = np.argsort(positions, kind="stable")
        positions, names = positions[order], names[order]
        at = np.flatnonzero(positions[1:] == positions[:-1] + 1)  # the merge: lists that go on at the next position
        if not len(at):
            return None
        key = names[at] * len(ids) + names[at + 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first, second = ids[key[heads] // len(ids)], ids[key[heads] % len(ids)]
        return _batch(block, lang, pa.array(first), pa.array(second), np.diff(np.append(heads, len(key))), positions[at[order]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block: first its lists, then what is frequent in it, by ordinal."""
        now: tuple[int, str, bytes] | None = None
        ordinal, ids = [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if now and ids:
                out = extend(*now, np.concatenate(ordinal), np.concatenate(ids))
                if out is not None:
                    yield out

        for batch in batches:
            block, places, found_ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            heads = np.flatnonzero(places == -1).tolist()
            for a, b in zip([0, *heads], [*heads, len(places)], strict=True):
                if a < b and places[a] == -1:
                    yield from ended()
                    now, ordinal, ids = (int(block[a]), batch.column(3)[a].as_py(), batch.column(4)[a].as_py()), [], []
                    a += 1
                if a < b:
                    ordinal.append(places[a:b].astype(np.int64))
                    ids.append(found_ids[a:b].astype(np.int64))
        yield from ended()

    heads = lists.where("ordinal = -1").select("block", "ordinal", F.lit(0).cast("long").alias("id"), "lang", "lists")
    ordinal = F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias("ordinal")
    tails = found.select(F.shiftright("place", _BITS).alias("block"), ordinal, "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("lists"))
    both = heads.union(tails).repartition("block").sortWithinPartitions("block", "ordinal")
    return both.mapInArrow(returning(run), _LISTS.format("long"))


def phrases(docs: DataFrame, max_words: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """For 1, 2, ... words the phrases that stand ``least`` times in their language, as tables: id, lang, phrase, head (its first
    word), a and b, f (how often), begins and ends (how often its first and last 1, 2, ... words stand); and lang, n (all words)."""
    lists = materialise(word_lists(docs))
    totals = materialise(lists.where("ordinal >= 0").groupBy("lang").agg(F.sum("n").alias("n")))
    levels: list[DataFrame] = []
    for words in range(1, max_words + 1):
        last = words == max_words
        if last and words > 1:  # nothing is made of these, so their places are not needed
            summed = lists.where("ordinal >= 0").groupBy("lang", "a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            found, once = None, summed.withColumn("id", F.lit(None).cast("long"))
        else:
            found = materialise(frequent(lists, least))
            once = found.where("place = id")
        if words == 1:
            named = once.select("id", "lang", F.col("a").alias("phrase"), F.col("a").alias("head"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "f", F.array("f").alias("begins"), F.array("f").alias("ends"))
        else:
            first = levels[-1].select(F.col("id").alias("a"), "head", "begins")
            rest = levels[-1].select(F.col("id").alias("b"), F.col("phrase").alias("rest"), "ends")
            with_f = lambda c: F.concat(c, F.array("f")).alias(c)
            named = once.join(first, "a").join(rest, "b").select("id", "lang", F.concat_ws(" ", "head", "rest").alias("phrase"), "head", "a", "b", "f", with_f("begins"), with_f("ends"))
        levels.append(materialise(named))
        if not last:
            before, lists = lists, materialise(longer(lists, found))
            discard(before)
        if found is not None:
            discard(found)
    discard(lists)
    return levels, totals


def score(words: int) -> Column:
    """The cut of least floor(1000000 a a / (l r)), then of fewest first words: score, l, r. Decimals are exact for frequencies below 10**15."""
    whole = lambda c: c.cast("decimal(15,0)")
    f = whole(F.col("f"))
    cuts = []
    for k in range(1, words):
        a, b = F.element_at("begins", k), F.element_at("ends", words - k)
        cuts.append(F.struct(F.call_function("div", f * f * F.lit(1_000_000), whole(a) * whole(b)).alias("score"), F.lit(k).alias("k"), a.alias("l"), b.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, covered_percent: int = 50, top: int = 2000, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``max_words`` words.

    A phrase goes if a longer one that it is a part of stands at least ``covered_percent`` as often. Of the longer ones, those
    of one word more are enough to look at: what they are part of stands no more often.
    """
    levels, totals = phrases(docs, max_words, least)
    kept = []
    for words in range(2, max_words + 1):
        here = levels[words - 1].select("id", "lang", "phrase", "f", score(words).alias("cut"))
        if words < max_words:
            parts = levels[words].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            here = here.join(parts, "id", "left").where(~(F.coalesce(100 * F.col("longer"), F.lit(-1)) >= covered_percent * F.col("f")))
        kept.append(here.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.union(more)
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*best)  # a language may have most phrases: first of each part of it
    few = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
