"""How the sources of a language differ from each other and from the language as a whole, in the terms they use.

A term's probability in a group is smoothed by one and kept as a whole number, p = 1 + floor(10**9 (count + 1) / (N + V)); the
divergence of p from q is the sum of floor((p - q)**2 / q). All of it is exact: integers and decimals.

Pairs of sources are summed sparsely. Every kept term counts in every pair, but where neither source has it, its part is the
same for all such terms: V times that is the baseline. Terms of one source correct it by their counts, of which only a
histogram is needed; terms that both have correct it once more, and only these meet in a join.

Telling terms are ranked by radix select: a histogram over the first 16 bits of the values tells in which bin a group's kth
value lies, the bin's rows are cut by the next 16 bits, and so on until the bin fits. Ties at the threshold are refined in the
same way by the UTF-8 bytes of the terms, behind what the tied terms have in common. Histograms are pre-aggregated in the
tasks; a group's window sees bins, 65,536 at most, and at the end ``k`` rows. So no group is ever sorted, however large.

Defined results: null text, lang and source are ''. Repeated rows are documents of their own. A group without terms has none
ranked, but is compared as any other; where a language keeps no term (V = 0), every pair's value is 0. A language of one source
has no pairs. An empty table gives an empty result. Other columns are not read. A very long text is read in stretches, and
takes some 30 bytes for each of its terms in the task that reads it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, returning

#: Bytes that are of no term as spaces, A-Z as a-z. Terms match [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1_000_000_000
GROUP = ["lang", "source"]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _words(text: str, piece: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch after another, so that a very long one is never a list as a whole."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = at + piece
        if end < len(data):
            end = data.rfind(b" ", at + 1, end)
            end = data.find(b" ", at + piece) if end < 0 else end
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(texts: list[str], group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms; and (group, term, count, docs) of those that each group of texts has."""
    found: defaultdict[bytes, int] = defaultdict()
    found.default_factory = found.__len__
    ids, sizes = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for words in _words(text):
            ids.append(np.fromiter(map(found.__getitem__, words), np.int64, len(words)))
            sizes[i] += len(words)
    term, n = np.concatenate(ids), max(1, len(found))
    doc = np.repeat(np.arange(len(texts)), sizes)
    pairs, times = np.unique(doc * n + term, return_counts=True)
    keys, at = np.unique(group[pairs // n] * n + pairs % n, return_inverse=True)
    return list(found), *np.divmod(keys, n), np.bincount(at, times, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))


def term_counts(docs: DataFrame, portion: int = 4_000_000) -> DataFrame:
    """lang, source, term, count, docs (how many documents have it). Portions of texts are counted in the tasks, and their counts summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= portion):
                    size += len(texts[end])
                    end += 1
                pairs = list(zip(batch.column(0)[at:end].to_pylist(), batch.column(1)[at:end].to_pylist(), strict=True))
                groups = {g: i for i, g in enumerate(dict.fromkeys(pairs))}
                terms, g, t, count, docs_with = _counted(texts[at:end], np.array([groups[p] for p in pairs], np.int64))
                names = [pa.array([x[i] for x in groups], pa.string()).take(pa.array(g)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(t)), pa.array(count), pa.array(docs_with)], ["lang", "source", "term", "count", "docs"])
                at = end

    rows = docs.select(_blank("lang"), _blank("source"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.mapInArrow(returning(run), "lang string, source string, term string, count long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(count + 1) * F.lit(UNIT), whole(total + terms)) + 1


def part(p: Column, q: Column) -> Column:
    """One term's part of the divergence; p and q are at most 10**9 + 1, so that the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(28,0)"))


def kept_counts(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Tables: lang, source, term, count, in_lang of the terms that ``least_docs`` documents of the language have; and every group with
    total (its count of kept terms), terms (how many the language keeps) and in_lang (the language's count of them)."""
    counts = materialise(term_counts(docs))
    kept = materialise(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).where(F.col("docs") >= least_docs).drop("docs"))
    rows = materialise(counts.select("lang", "source", "term", "count").join(kept, ["lang", "term"]))
    discard(counts)
    totals = rows.groupBy(GROUP).agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("in_lang"))
    groups = docs.select(_blank("lang"), _blank("source")).distinct().join(totals, GROUP, "left").join(langs, "lang", "left")
    groups = materialise(groups.na.fill(0, ["total", "terms", "in_lang"]))
    discard(kept)
    return rows, groups


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the divergence of source from item over all kept terms."""
    some = groups.where("terms > 0").withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))).select("lang", "source", "terms", "p0")
    other = some.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = some.join(other, "lang").where("source <> item")
    known = rows.join(groups.select(*GROUP, "total", "terms"), GROUP).select("lang", "source", "term", probability(F.col("count"), F.col("total"), F.col("terms")).alias("p"))
    alike = materialise(known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")))
    p, q, p0, q0, n = (F.col(c) for c in ("p", "q", "p0", "q0", "n"))
    none = part(p0, q0)
    of_source = base.join(alike, GROUP).select("lang", "source", "item", ((part(p, q0) - none).cast("decimal(20,0)") * n).alias("value"))
    of_item = base.join(alike.select("lang", F.col("source").alias("item"), p.alias("q"), "n"), ["lang", "item"]).select("lang", "source", "item", ((part(p0, q) - none).cast("decimal(20,0)") * n).alias("value"))
    first = known.join(some, GROUP).select("lang", "term", "source", "p", "p0")
    second = first.select("lang", "term", F.col("source").alias("item"), p.alias("q"), p0.alias("q0"))
    both = first.join(second, ["lang", "term"]).where("source < item")  # each pair once, both ways in a row
    there = part(p, q) - part(p, q0) - part(p0, q) + none
    back = part(q, p) - part(q, p0) - part(q0, p) + part(q0, p0)
    summed = both.groupBy("lang", "source", "item").agg(_sum(there).alias("there"), _sum(back).alias("back"))
    ways = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    of_both = summed.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    start = base.select("lang", "source", "item", (none.cast("decimal(20,0)") * F.col("terms")).alias("value"))
    decimal = lambda df: df.withColumn("value", F.col("value").cast("decimal(38,0)"))
    found = decimal(start).union(decimal(of_source)).union(decimal(of_item)).union(decimal(of_both)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    bare = groups.where("terms = 0").select(*GROUP)
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return found.union(zero)


def threshold(rows: DataFrame, by: list[str], k: int, bits: int = 16) -> DataFrame:
    """rows: by, value (not negative). Per group: low, above and n: ``above`` rows are over the bin that begins at low, in which n are; rows from low on are the k largest, but for too many in that bin.

    The bin is the narrowest that was needed: one value if its rows do not all fit.
    """
    ends = materialise(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("above"), "n"))
    over = Window.partitionBy(by).orderBy(F.col("digit").desc())
    for shift in range(64 - bits, -1, -bits):
        open_ends = ends.where(F.col("above") + F.col("n") > k)
        if open_ends.isEmpty():
            break
        inside = rows.join(open_ends.drop("n"), by).where(F.expr(f"value >= low AND shiftright(value - low, {shift}) < {1 << bits}"))
        bins = inside.groupBy(*by, F.shiftright(F.col("value") - F.col("low"), shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("above").alias("above"))
        bins = bins.withColumn("upto", F.sum("n").over(over)).where(F.col("above") + F.col("upto") >= k)
        best = bins.groupBy(by).agg(F.max_by(F.struct((F.col("low") + F.shiftleft("digit", shift)).alias("low"), (F.col("above") + F.col("upto") - F.col("n")).alias("above"), "n"), "digit").alias("e"))
        before, ends = ends, materialise(best.select(*by, "e.*").union(ends.where(F.col("above") + F.col("n") <= k)))
        discard(before)
    return ends


def _common(a: Column, b: Column) -> Column:
    """How many bytes two binaries begin with alike."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    differ = F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, F.length(a))


def last_of_ties(ties: DataFrame, by: list[str], settle: int = 4096) -> DataFrame:
    """ties: by, item, need (the same in a group, fewer than its rows). Per group ``last``: the need-th item in order of UTF-8 bytes."""
    done = None
    state = materialise(ties.groupBy(by).agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("n"), F.min("item").alias("least"), F.max("item").alias("most")).withColumn("start", F.lit(b"")))
    made = [state]
    over = Window.partitionBy(by).orderBy("digit")
    starts = lambda: F.expr("substring(CAST(item AS BINARY), 1, length(start)) = start")
    while True:
        few = state.where(F.col("n") <= settle)
        rank = F.row_number().over(Window.partitionBy(by).orderBy("item"))
        settled = ties.drop("need").join(few.select(*by, "need", "start"), by).where(starts()).withColumn("rank", rank).where("rank = need").select(*by, F.col("item").alias("last"))
        settled = materialise(settled)
        made.append(settled)
        done = settled if done is None else done.union(settled)
        many = state.where(F.col("n") > settle)
        if many.isEmpty():
            break
        common = F.expr("substring(CAST(least AS BINARY), 1, shared)")
        many = many.withColumn("shared", _common(F.col("least").cast("binary"), F.col("most").cast("binary"))).select(*by, "need", common.alias("start"))
        inside = ties.drop("need").join(many, by).where(starts())
        digit = F.expr("substring(CAST(item AS BINARY), 1, length(start) + 2)")
        bins = inside.groupBy(*by, digit.alias("digit")).agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("n"), F.min("item").alias("least"), F.max("item").alias("most"))
        bins = bins.withColumn("upto", F.sum("n").over(over)).where(F.col("upto") >= F.col("need"))
        best = bins.groupBy(by).agg(F.min_by(F.struct((F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n", "least", "most", F.col("digit").alias("start")), "digit").alias("e"))
        state = materialise(best.select(*by, "e.*"))
        made.append(state)
    out = materialise(done)
    discard(*made)
    return out


def top(rows: DataFrame, by: list[str], k: int, settle: int = 4096) -> DataFrame:
    """rows: a table of by, item (each once in a group) and value. The k first of each group by value descending, then by item's UTF-8 bytes."""
    ends = threshold(rows, by, k)
    crowded = ends.where(F.col("above") + F.col("n") > k).select(*by, "low", (F.lit(k) - F.col("above")).alias("need"))
    ties = materialise(rows.join(crowded, by).where("value = low").select(*by, "item", "need"))
    last = last_of_ties(ties, by, settle)
    best = rows.join(ends.join(last, by, "left").select(*by, "low", "last"), by).where("value >= low AND (last IS NULL OR value > low OR item <= last)")
    out = materialise(best.drop("low", "last"))
    discard(ends, ties, last)
    return out


def telling_terms(rows: DataFrame, groups: DataFrame, k: int = 200, settle: int = 4096) -> DataFrame:
    """lang, source, item (a term), value: the k terms of each group that stand out most from the language."""
    known = rows.withColumnRenamed("in_lang", "of_lang").join(groups, GROUP)
    p, q = probability(F.col("count"), F.col("total"), F.col("terms")), probability(F.col("of_lang"), F.col("in_lang"), F.col("terms"))
    found = materialise(known.select(*GROUP, F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select(*GROUP, "item", part(F.col("p"), F.col("q")).alias("value")))
    out = top(found, GROUP, k, settle)
    discard(found)
    return out


def divergence(docs: DataFrame, least_docs: int = 3, k: int = 200, settle: int = 4096) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    rows, groups = kept_counts(docs, least_docs)
    told = telling_terms(rows, groups, k, settle)
    both = pairs(rows, groups).withColumn("part", F.lit("pair")).unionByName(told.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return both.select("lang", "source", "part", "item", "value", rank.cast("int").alias("rank"))
