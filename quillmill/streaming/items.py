"""Items reported as they finish: a count-down for each, kept as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "expected int, seen array<string>, failed int, errors string, reported boolean"
OUT = "item string, articles int, failed int, errors string"


def finished(expected: DataFrame, results: DataFrame, retention_ms: int | None = None) -> DataFrame:
    """Item, articles, failed and errors, once for each item, when the last of its articles is done. Two streams, in any order.

    expected: item, n (how many articles). results: item, article, error. The state of an item is which of its articles are done;
    a result that comes again changes nothing, and an item without articles is done at once. What was reported is remembered, as a
    mark without its articles, so that repeated results do not report it again: for good, or on streams that run on without end for
    retention_ms (a stream with timers does not end by itself when its input does). Checkpoints carry the count-down over restarts.
    """
    none = F.lit(None)
    both = expected.select("item", F.col("n").cast("int").alias("n"), none.cast("string").alias("article"), none.cast("string").alias("error")).union(results.select("item", none.cast("int"), "article", "error"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, seen, failed, errors, reported = state.get if state.exists else (-1, [], 0, "", False)
        done = set(seen)
        for rows in frames:
            for r in rows.sort_values(["article", "error"], na_position="first").itertuples(index=False):
                if pd.notna(r.n):
                    n = int(r.n)
                elif r.article not in done and not reported:
                    done.add(r.article)
                    if pd.notna(r.error):
                        failed, errors = failed + 1, f"{errors}; {r.error}" if errors else r.error
        if not reported and 0 <= n <= len(done):
            reported = True
            yield pd.DataFrame([(key[0], n, failed, errors)], columns=["item", "articles", "failed", "errors"])
        state.update((n, [] if reported else sorted(done), failed, errors, reported))
        if reported and retention_ms is not None:
            state.setTimeoutDuration(retention_ms)

    timers = GroupStateTimeout.NoTimeout if retention_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return both.groupBy("item").applyInPandasWithState(step, OUT, STATE, "append", timers)
