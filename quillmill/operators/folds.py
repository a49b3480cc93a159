"""States that depend on all rows before, over groups of any size, without gathering a group.

Rows are sorted over ranges, so that a large group spreads over many. Each range says what its first stretch does to any state it
may start with, and in what state its last group leaves it; these short tables, one row a range, are applied one after another;
then each range is walked from the state it starts in. A fold says what a state is, what a stretch does to it, and what a row shows.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import ensure_checkpoint_dir

State = list[Any]  # what JSON can hold


class Fold(Protocol):
    start: State

    def table(self, *columns: np.ndarray) -> Any:
        """What a stretch does to any state, as JSON can hold it."""

    def apply(self, table: Any, state: State) -> State:
        """The state after a stretch."""

    def walk(self, state: State, *columns: np.ndarray) -> tuple[list, State]:
        """What each row shows, and the state after the last."""


def over_ranges(rows: DataFrame, group: str, order: list[str], values: list[str], fold: Fold, out: str, kind: str) -> DataFrame:
    """group, order and ``out`` of every row. values: the columns that the fold reads. Rows of a group that tie in order are taken as they come, so order should tell them apart."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [group, *order]
    extra = [v for v in values if v not in keys]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, *extra).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).checkpoint()  # both passes see the same ranges
    at = [[*keys, *extra].index(v) for v in values]

    def stretches(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray], np.ndarray] | None:
        parts = list(batches)
        table = pa.Table.from_batches(parts) if parts else None
        if table is None or not table.num_rows:
            return None
        code = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return table, [table.column(i).to_numpy() for i in at], np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))

    def name(table: pa.Table, i: int) -> str:
        value = table.column(0)[i]
        return json.dumps([value.is_valid, str(value.as_py())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := stretches(batches)) is not None:
            table, columns, cuts = found
            part = lambda a, b: [c[a:b] for c in columns]
            single = len(cuts) == 2
            _, end = fold.walk(fold.start, *part(cuts[-2], cuts[-1]))
            row = {"range": TaskContext.get().partitionId(), "first": name(table, 0), "last": name(table, table.num_rows - 1), "single": single, "table": json.dumps(fold.table(*part(cuts[0], cuts[1]))), "end": json.dumps(end)}
            yield pa.RecordBatch.from_pylist([row], schema=_SEEN)

    seen = sorted(dealt.mapInArrow(look, "range int, first string, last string, single boolean, table string, end string").collect(), key=lambda r: r["range"])
    starts: dict[int, State] = {}
    group_now, state = None, fold.start
    for r in seen:
        goes_on = r["first"] == group_now
        if goes_on:
            starts[r["range"]] = state
        state = fold.apply(json.loads(r["table"]), state) if goes_on and r["single"] else json.loads(r["end"])
        group_now = r["last"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := stretches(batches)) is not None:
            table, columns, cuts = found
            state = starts.get(TaskContext.get().partitionId(), fold.start)
            shown: list = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                shown += fold.walk(state, *(c[a:b] for c in columns))[0]
                state = fold.start
            yield from table.select(keys).append_column(out, pa.array(shown)).to_batches(10_000)

    schema = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(fill, f"{schema}, `{out}` {kind}")


_SEEN = pa.schema([("range", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("table", pa.string()), ("end", pa.string())])


class Toggle:
    """Whether a cache is on for a call: off for good once so many calls in a row have missed; a hit only resets the count. State: misses in a row, off."""

    start: State = [0, False]

    def __init__(self, most: int = 10) -> None:
        self.most = most

    def walk(self, state: State, hit: np.ndarray) -> tuple[list, State]:
        misses, off = state
        shown = []
        for h in hit.tolist():
            shown.append(not off)
            if not off:  # what is not cached neither hits nor misses
                misses = 0 if h else misses + 1
                off = misses >= self.most
        return shown, [misses, off]

    def table(self, hit: np.ndarray) -> Any:
        first = int(hit.argmax()) if hit.any() else len(hit)  # misses before the first hit
        return [first, first == len(hit), self.walk(self.start, hit[first:])[1]]

    def apply(self, table: Any, state: State) -> State:
        first, all_missed, after = table
        misses, off = state
        if off:
            return state
        if misses + first >= self.most:
            return [self.most, True]
        return [misses + first, False] if all_missed else after


class Breaker:
    """The state after each call: closed, open, or rejected if it came while open and before the cooldown's end. State: open, since when, failures in a row.

    The first value is the call's time, which must not fall in the order of calls. From an open state a stretch depends only on
    which of its calls is the first after the cooldown, and that is one within a cooldown of its beginning, or the first beyond.
    """

    start: State = [False, 0.0, 0]

    def __init__(self, threshold: int = 5, cooldown: float = 30.0) -> None:
        self.threshold, self.cooldown = threshold, cooldown

    def walk(self, state: State, at: np.ndarray, failed: np.ndarray) -> tuple[list, State]:
        is_open, since, fails = state
        shown = []
        for t, bad in zip(at.tolist(), failed.tolist(), strict=True):
            if is_open and t - since < self.cooldown:
                shown.append("rejected")
                continue
            if bad:
                fails = fails if is_open else fails + 1
                is_open = is_open or fails >= self.threshold
                since = t if is_open else since
            else:
                is_open, fails = False, 0
            shown.append("open" if is_open else "closed")
        return shown, [is_open, since, fails]

    def _ends(self, at: np.ndarray, failed: np.ndarray) -> tuple[Callable[[int], State], Callable[[int], State]]:
        """The end of a stretch, from closed before a call, and from a call that probes an open breaker."""
        n = len(at)
        index = np.arange(n)
        run = index - np.maximum.accumulate(np.where(failed, -1, index)) if n else index  # failures in a row up to here
        trips = np.flatnonzero(run >= self.threshold)
        later = np.searchsorted(at, at + self.cooldown, "left")
        later = np.where(at[np.maximum(later - 1, 0)] - at >= self.cooldown, later - 1, later)  # sums round otherwise than the walk's differences do
        later = np.where(at[np.minimum(later, n - 1)] - at < self.cooldown, np.minimum(later + 1, n), later)
        later = np.maximum(later, index + 1)
        probed: list[State] = [[]] * n

        def closed(i: int) -> State:
            k = int(np.searchsorted(trips, i + self.threshold - 1, "left"))
            if k == len(trips):
                return [False, 0.0, int(min(run[-1], n - i)) if n > i else 0]
            return opened(int(trips[k]))

        def opened(j: int) -> State:
            return probed[later[j]] if later[j] < n else [True, float(at[j]), self.threshold]

        for i in range(n - 1, -1, -1):
            probed[i] = opened(i) if failed[i] else closed(i + 1)
        return closed, lambda i: probed[i]

    def table(self, at: np.ndarray, failed: np.ndarray) -> Any:
        closed, probed = self._ends(at, failed)
        n = len(at)
        first = n if failed.all() else int(np.flatnonzero(~failed)[0])  # failures before the first success
        from_closed = []
        for fails in range(self.threshold):
            if fails + first >= self.threshold:
                j = self.threshold - fails - 1
                over = np.flatnonzero(at[j + 1 :] - at[j] >= self.cooldown)
                from_closed.append(probed(j + 1 + int(over[0])) if len(over) else [True, float(at[j]), self.threshold])
            else:
                from_closed.append([False, 0.0, fails + first] if first == n else closed(first + 1))
        cases: list[list] = []
        for i in range(n):
            end = probed(i)
            if cases and cases[-1][1] == end:
                cases[-1][0] = float(at[i])
            else:
                cases.append([float(at[i]), end])
            if at[i] - at[0] >= self.cooldown:
                break
        return [from_closed, cases]

    def apply(self, table: Any, state: State) -> State:
        from_closed, cases = table
        is_open, since, fails = state
        if not is_open:
            return from_closed[fails]
        i = bisect.bisect_left(cases, True, key=lambda c: c[0] - since >= self.cooldown)
        return cases[i][1] if i < len(cases) else state


def cache_states(calls: DataFrame, group: str, order: list[str], hit: str, most: int = 10) -> DataFrame:
    """Group, order and cached, whether the cache was on for the call. calls: hit is whether a call read or wrote the cache, or would have."""
    return over_ranges(calls, group, order, [hit], Toggle(most), "cached", "boolean")


def breaker_states(calls: DataFrame, group: str, order: list[str], at: str, failed: str, threshold: int = 5, cooldown: float = 30.0) -> DataFrame:
    """Group, order and state. A call that comes while the breaker is open is rejected and leaves no trace; the first after the cooldown is let through, and decides."""
    return over_ranges(calls.withColumn(failed, F.coalesce(failed, F.lit(False))), group, order, [at, failed], Breaker(threshold, cooldown), "state", "string")
