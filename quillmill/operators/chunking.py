"""Cutting and fitting text to budgets.

A reset that depends on the running total is no window function. Where one document's lines are folded, `aggregate` over an ordered
array does it inside a row; a group's lines, of which there is no end, are folded range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text

from .overlap import ensure_checkpoint_dir

LIMIT = 16_000


def chunk_lines(content: Column, limit: int = LIMIT) -> Column:
    """line-packed chunks of at most limit characters; an over-long line is sliced and closes no open chunk by itself.

    The fold keeps (done, open, length). A line that would overflow closes the open chunk; then an over-long line goes to done
    in slices, any other joins the open chunk.
    """
    lines = F.split(content, "\n", -1)
    none = F.array().cast("array<string>")

    def slices(line: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.length(line) - 1) / limit).cast("int")), lambda i: F.substring(line, i * limit + 1, F.lit(limit)))

    def step(s: Column, line: Column) -> Column:
        full = (s["size"] + F.length(line) > limit) & (F.size(s["open"]) > 0)
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"])
        opened = F.when(full, none).otherwise(s["open"])
        size = F.when(full, F.lit(0)).otherwise(s["size"])
        long = F.length(line) > limit
        return F.struct(
            F.when(long, F.concat(done, slices(line))).otherwise(done).alias("done"),
            F.when(long, opened).otherwise(F.concat(opened, F.array(line))).alias("open"),
            F.when(long, size).otherwise(size + F.length(line) + 1).alias("size"),
        )

    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size"))
    packed = F.aggregate(lines, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]))
    return F.when(F.length(content) <= limit, F.array(content)).otherwise(packed)


def speaker_turns(text: Column) -> Column:
    """A transcript's turns; one begins at every line that names a speaker."""
    marked = F.regexp_replace(text, r"(?m)^(?=\*\*@[\w.]+\*\*)", "\u0000")
    return F.transform(F.filter(F.split(marked, "\u0000", -1), lambda t: t != ""), lambda t: F.regexp_replace(t, r"\n\z", ""))


def speakers(text: Column) -> Column:
    """Distinct speakers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\*\*@([\w.]+)\*\*"), F.lit(1)))


def time_span(chunk: Column) -> tuple[Column, Column]:
    """First and last time of day in a chunk, '' without one."""
    times = F.regexp_extract_all(chunk, F.lit(r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b"), F.lit(1))
    return F.coalesce(F.get(times, F.lit(0)), F.lit("")), F.coalesce(F.get(times, F.size(times) - 1), F.lit(""))


def chunk_transcript(text: Column, context: Column, limit: int = LIMIT) -> Column:
    """turns packed like lines, two characters a join; an over-long turn falls back to lines. One chunk is the text itself, several get the context in front."""
    none = F.array().cast("array<string>")

    def step(s: Column, turn: Column) -> Column:
        full = (s["size"] + F.length(turn) > limit) & (F.size(s["open"]) > 0)
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"])
        opened = F.when(full, none).otherwise(s["open"])
        long = F.length(turn) > limit
        return F.struct(
            F.when(long, F.concat(done, chunk_lines(turn, limit))).otherwise(done).alias("done"),
            F.when(long, none).otherwise(F.concat(opened, F.array(turn))).alias("open"),
            F.when(long, F.lit(0)).otherwise(F.when(full, F.lit(0)).otherwise(s["size"]) + F.length(turn) + 2).alias("size"),
        )

    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size"))
    chunks = F.aggregate(speaker_turns(text), start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"]))

    def prefixed(chunk: Column) -> Column:
        first, last = time_span(chunk)
        span = F.when(first != "", F.concat(F.lit("Time: "), first, F.lit(" - "), last))
        who = F.when(F.size(speakers(text)) > 0, F.concat(F.lit("Speakers: "), F.array_join(speakers(text), ", ")))
        return F.concat(F.concat_ws("\n", context, who, span), F.lit("\n\n"), chunk)

    return F.when(F.size(chunks) <= 1, F.array(text)).otherwise(F.transform(chunks, prefixed))


def strategy(wanted: Column, chunks: Column, threshold: int = 3) -> Column:
    """Chunked and summarize as asked; auto summarizes from so many chunks on; anything else is an error."""
    auto = F.when(chunks >= threshold, "summarize").otherwise("chunked")
    return F.when(wanted.isin("chunked", "summarize"), wanted).when(wanted == "auto", auto).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), wanted)))


def fan_out(n: Column, joined_chars: Column) -> Column:
    """How many parallel field groups, and whether summaries are merged once more first."""
    merged = (n >= 20) | (joined_chars > 60_000)
    k = F.when(merged | (n >= 8), 3).when(n >= 4, 2).otherwise(1)
    return F.struct(k.alias("groups"), merged.alias("second_level"), F.least(joined_chars, F.lit(72_000)).alias("chars"))


def merge_mode(article_bytes: Column, prompt_chars: Column, budget: int = 80_000, large: int = 30_000) -> Column:
    """Large articles, and prompts over budget, are merged by patches; others are rewritten."""
    return F.when((article_bytes >= large) | (prompt_chars > budget), "diff").otherwise("rewrite")


def _filled(costs: np.ndarray, budget: int, size: int) -> tuple[np.ndarray, int]:
    """The batch of each line, from 0 for the one that is open with so much in it, and what is in the last. -1 for a line over the whole budget."""
    over = costs > budget
    upto = np.concatenate([[0], np.cumsum(np.where(over, 0, costs))])
    out, at, number = np.zeros(len(costs), np.int64), 0, 0
    while True:
        end = int(np.searchsorted(upto, upto[at] + budget - size, "right")) - 1  # as many lines as fit
        out[at:end] = number
        size += int(upto[end] - upto[at])
        if end >= len(costs):
            break
        at, size, number = end, 0, number + 1
    out[over] = -1
    return out, size


def _outcomes(costs: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """What a stretch of lines does to any size it may start with: (least size, batches closed, size at the end), by size.

    A size decides only where the first batch closes, so there are no more cases than lines that one batch holds, and one in which none closes.
    """
    kept = costs[costs <= budget]
    upto = np.cumsum(kept)
    total = int(upto[-1]) if len(kept) else 0
    cases: list[tuple[int, int, int]] = []
    first = int(np.searchsorted(upto, budget, "right"))  # the first line that cannot join a batch that begins here
    for i in range(min(first, len(kept) - 1), -1, -1) if len(kept) else ():
        least = max(1, budget - int(upto[i]) + 1)  # from this size on, line i opens a batch
        numbers, size = _filled(kept[i:], budget, 0)
        cases.append((least, int(numbers[-1]) + 1, size))
    by_size: dict[int, tuple[int, int, int]] = {}
    for case in cases:  # earlier lines, at greater sizes, come later
        by_size[case[0]] = case
    open_end = [(0, 0, -1)] if total <= budget else []
    if not open_end:
        numbers, size = _filled(kept, budget, 0)
        open_end = [(0, int(numbers[-1]), size)]
    return open_end + sorted(by_size.values())


def pack_batches(lines: DataFrame, budget: int, group: str, order: list[str]) -> DataFrame:
    """Lines in batches within the budget, group by group and in order; null for a line over the whole budget. Where a batch closes depends on all before
    it, yet no group is gathered: lines are sorted over ranges, each range says what it does to any size it may start with (a short table,
    and one row a range reaches the driver), the tables are applied one after another, and each range is then filled from its own start.
    """
    spark = lines.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [group, *order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select(*keys, (F.length("line") + 1).cast("long").alias("cost")).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).checkpoint()  # both passes see the same ranges

    def stretches(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        """A range's lines, their costs, and where its groups begin and end."""
        parts = list(batches)
        table = pa.Table.from_batches(parts) if parts else None
        if table is None or not table.num_rows:
            return None
        code = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return table, table.column(table.num_columns - 1).to_numpy(), np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := stretches(batches)) is not None:
            table, costs, cuts = found
            numbers, size = _filled(costs[cuts[-2] :], budget, 0)
            name = [str(table.column(0)[i].as_py()) + ("" if table.column(0)[i].is_valid else "\0") for i in (0, table.num_rows - 1)]
            cases = [list(c) for c in _outcomes(costs[: cuts[1]], budget)]
            row = {"range": TaskContext.get().partitionId(), "first": name[0], "last": name[1], "single": len(cuts) == 2, "cases": cases, "sum": int(costs[: cuts[1]][costs[: cuts[1]] <= budget].sum()), "number": int(max(numbers.max(), 0)), "size": size}
            yield pa.RecordBatch.from_pylist([row], schema=_SEEN)

    seen = sorted(dealt.mapInArrow(look, "range int, first string, last string, single boolean, cases array<array<long>>, sum long, number long, size long").collect(), key=lambda r: r["range"])
    starts: dict[int, tuple[int, int]] = {}
    open_group, number, size = None, 0, 0
    for r in seen:
        if r["first"] == open_group:
            starts[r["range"]] = (number, size)
            least, closed, end = next(c for c in reversed(r["cases"]) if c[0] <= size)
            if r["single"]:
                number, size = number + closed, size + r["sum"] if end < 0 else end
        elif r["single"]:
            number, size = r["number"], r["size"]
        if not r["single"]:
            number, size = r["number"], r["size"]
        open_group = r["last"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := stretches(batches)) is not None:
            table, costs, cuts = found
            out = np.zeros(len(costs), np.int64)
            number, size = starts.get(TaskContext.get().partitionId(), (0, 0))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                numbers, _ = _filled(costs[a:b], budget, size)
                out[a:b] = np.where(numbers < 0, -1, numbers + number)
                number = size = 0
            batch = pa.array(out.astype(np.int32), mask=out < 0)
            yield from table.drop_columns(["cost"]).append_column("batch", batch).to_batches(10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "cost")
    return dealt.mapInArrow(fill, f"{schema}, batch int")


_SEEN = pa.schema([("range", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("cases", pa.list_(pa.list_(pa.int64()))), ("sum", pa.int64()), ("number", pa.int64()), ("size", pa.int64())])


def halving_fit(sizes: Column, budget: Column | int) -> Column:
    """The largest of n, n/2, n/4 ... leading items whose joined length stays within budget; 0 if not even one does.

    How many fit is counted once, over at most budget + 1 items, since each takes a character at least with what joins it.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("room"))

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + x + 1
        return F.struct(total.alias("total"), (s["room"] + (total - 1 <= budget).cast("int")).alias("room"))

    room = F.aggregate(F.slice(sizes, F.lit(1), F.greatest(budget, F.lit(0)) + 1), start, step, lambda s: s["room"])
    counts = F.struct(F.size(sizes).alias("n"), room.alias("room"))

    def largest(c: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.floor(c["n"] / F.pow(F.lit(2), k)).cast("int"))
        return F.coalesce(F.get(F.filter(tries, lambda m: m <= c["room"]), F.lit(0)), F.lit(0))

    return text.bound(counts, largest)


def halving_fit_groups(lines: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """W15 by group, whatever a group's size: group, n_total, n_kept. At most budget + 1 leading lines can matter, since each takes a character at least
    with what joins it; they are found by a top-k that each task prunes before anything is shuffled, and the count is an aggregate.
    """
    sized = lines.select(group, order, F.length("line").alias("n"))
    total = sized.groupBy(group).agg(F.count(F.lit(1)).alias("n_total"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = sized.withColumn("i", rank).where(F.col("i") <= budget + 1)
    upto = first.select(group, "i", (F.sum(F.col("n") + 1).over(Window.partitionBy(group).orderBy("i")) - 1).alias("upto"))
    room = upto.where(F.col("upto") <= budget).groupBy(group).agg(F.max("i").alias("room"))
    tries = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.floor(F.col("n_total") / F.pow(F.lit(2), k)))
    kept = F.get(F.filter(tries, lambda m: m <= F.coalesce("room", F.lit(0))), F.lit(0))
    return total.join(room, group, "left").select(group, "n_total", kept.cast("int").alias("n_kept"))


def fit_fields(fields: dict[str, tuple[Column, bool]], budget: int) -> dict[str, Column]:
    """F16: text and list fields in order of priority; each takes what it can of what the ones before it leave. Texts are cut, lists halved.

    fields: columns, each with whether it is a list (array<string>) or a text; a list's items count one more character each, for what joins them.
    """
    left, out = F.lit(budget), {}
    for name, (value, is_list) in fields.items():
        if is_list:
            whole = F.coalesce(value, F.array().cast("array<string>"))
            kept = text.bound(F.struct(whole.alias("v"), left.alias("left")), lambda b: F.slice(b["v"], F.lit(1), halving_fit(F.transform(b["v"], F.length), b["left"])))
            used = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + F.length(y) + 1)
        else:
            kept = F.substring(F.coalesce(value, F.lit("")), F.lit(1), F.greatest(left, F.lit(0)))
            used = F.length
        out[name] = kept
        left = left - used(kept)
    return out
