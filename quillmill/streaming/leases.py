"""The task queue as a stream: leases as keyed state, and late results set aside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "task_id string, seq long, ts_ms long, kind string, owner string, ttl_ms long"
STATE = "status string, owner string, lease long, attempts long"
_COLUMNS = ["task_id", "seq", "kind", "owner", "accepted", "status", "attempts"]
OUT = "task_id string, seq long, kind string, owner string, accepted boolean, status string, attempts long"


@dataclass
class Task:
    """One task's state. Each event either applies or is refused; refused results of an owner that lost its lease are late."""

    status: str = "absent"
    owner: str = ""
    lease: int = 0
    attempts: int = 0

    def apply(self, kind: str, now: int, owner: str | None, ttl: int, most: int) -> bool:
        if self.status == "running" and 0 < self.lease <= now:  # T3: the lease ran out before this event
            self.status, self.owner, self.lease = "pending", "", 0
        if kind == "submit":
            if self.status != "absent":
                return False
            self.status = "pending"
        elif kind == "claim":
            if self.status != "pending":
                return False
            self.status, self.owner, self.lease, self.attempts = "running", owner or "", now + ttl, self.attempts + 1
        elif kind in ("heartbeat", "ack", "nack"):
            if self.status != "running" or self.owner != owner:  # T5
                return False
            if kind == "heartbeat":
                self.lease = now + ttl
            elif kind == "ack":
                self.status, self.lease = "succeeded", 0
            else:  # T4
                self.status, self.owner, self.lease = ("pending" if self.attempts < most else "failed"), "", 0
        elif kind == "cancel":
            if self.status not in ("pending", "running"):
                return False
            self.status, self.lease = "cancelled", 0
        else:
            return kind == "tick"
        return True


def _fold(task: Task, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["ts_ms", "seq"]).itertuples(index=False):
        accepted = task.apply(r.kind, int(r.ts_ms), r.owner, 0 if pd.isna(r.ttl_ms) else int(r.ttl_ms), most)
        out.append((r.task_id, r.seq, r.kind, r.owner, accepted, task.status, task.attempts))
    return pd.DataFrame(out, columns=_COLUMNS)


def transitions(events: DataFrame, max_attempts: int = 3, retention_ms: int = 3_600_000, timers: bool = True) -> DataFrame:
    """T2-T5 on a stream: every event with whether it applied and the state after it. State is one small record a live task.

    A lease runs out by a timer on the clock, whether or not another event comes: that shows as a row of kind ``expired`` with no
    seq. A finished task is remembered for retention_ms after its last event, so that late results are refused, and then its state
    goes; so does that of a task that was never submitted. Such a stream runs on without end. Without timers (for logs of other
    times, and runs that end with their input) leases run out by the events' own times alone, as in replay(), and the state of a
    finished task goes at once: what comes for it later is refused as for a task that is not there.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task = Task(*state.get) if state.exists else Task()
        now = state.getCurrentProcessingTimeMs() if timers else 0
        if timers and state.hasTimedOut:
            if task.status != "running":
                state.remove()
                return
            task.apply("tick", max(now, task.lease), None, 0, max_attempts)
            yield pd.DataFrame([(key[0], None, "expired", None, True, task.status, task.attempts)], columns=_COLUMNS).astype({"seq": "Int64"})
        for rows in frames:
            yield _fold(task, rows, max_attempts)
        live = task.status in ("running", "pending")
        if not live and not timers:
            if state.exists:
                state.remove()
            return
        state.update(tuple(asdict(task).values()))
        if timers and task.status == "running":
            state.setTimeoutDuration(max(1, task.lease - now))
        elif timers and not live:
            state.setTimeoutDuration(retention_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.groupBy("task_id").applyInPandasWithState(step, OUT, STATE, "append", kind)


def replay(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The same over a finished log, for checks and repairs."""
    return events.groupBy("task_id").applyInPandas(lambda rows: _fold(Task(), rows, max_attempts), OUT)


def late(changes: DataFrame) -> DataFrame:
    """Results that came after their lease was lost."""
    return changes.where("NOT accepted AND kind IN ('ack', 'nack', 'heartbeat')")
