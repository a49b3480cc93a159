"""What asks a language model, behind one small interface; the offline endpoint answers by rule, the same each time.

All answers are checked afterwards by the deterministic operators. Calls are made in Arrow batches on the executors by an
endpoint object that is shipped with the task; results are written before they are used again, so no call is repeated.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.tables import written


class Unavailable(Exception):
    """A timeout, or a gateway's 502, 503 or 504: the call may be made again."""


class CutOff(Exception):
    """The answer did not fit the room that it was given."""


class ModelEndpoint(Protocol):
    name: str

    def complete(self, task: str, payload: dict) -> str:
        """The answer. payload has ``room``, the tokens that it may take. May raise Unavailable and CutOff."""


class OfflineEndpoint:
    """Frequent long words are topics, first sentences are summaries; choices go by shared words."""

    name = "offline-1"

    def complete(self, task: str, payload: dict) -> str:
        return getattr(self, f"_{task}")(payload)

    @staticmethod
    def _words(text: str) -> list[str]:
        return re.findall(r"[^\W\d_]{5,}", text.lower())

    def _extract(self, p: dict) -> str:
        common = self._topics(p["text"])
        summary = re.split(r"(?<=[.!?])\s", p["text"].strip(), maxsplit=1)[0][:200]
        return json.dumps({"summary": summary, "topics": common, "concepts": [{"title": w.capitalize(), "summary": summary} for w in common[:2]]})

    def _summarize(self, p: dict) -> str:
        return re.split(r"(?<=[.!?])\s", p["text"].strip(), maxsplit=1)[0][:400] + " " + " ".join(self._topics(p["text"]))

    def _topics(self, text: str) -> list[str]:
        return [w for w, _ in sorted(Counter(self._words(text)).items(), key=lambda x: (-x[1], x[0]))[:5]]

    def _merge_summaries(self, p: dict) -> str:
        return " ".join(p["text"].split("\n---\n"))

    def _extract_group(self, p: dict) -> str:
        return self._extract(p)

    def _merge(self, p: dict) -> str:
        return f"{p['text'].rstrip()}\n\n## Update from {', '.join(p['refs'])}\n\n{p['summary']}\n"

    def _merge_diff(self, p: dict) -> str:
        return json.dumps({"patches": [{"action": "new_section", "after": "", "heading": f"## Update from {', '.join(p['refs'])}", "content": p["summary"]}]})

    def _rewrite(self, p: dict) -> str:
        return f"{p['question']} {' '.join(self._topics(p['history']))}"

    def _filter(self, p: dict) -> str:
        """What shares a word with the topic could contribute; what shares all of them is about it."""
        asked = set(self._words(p["question"]))
        least = len(asked) if p.get("mode") == "precision" else 1
        return json.dumps([path for path, line in p["catalog"] if asked and len(asked & set(self._words(line))) >= least])

    def _classify(self, p: dict) -> str:
        topic = (p["topics"] or ["misc"])[0]
        path = f"wiki/concept/{topic}.md"
        return json.dumps({"merge_into": [path], "create_new": []} if path in p["catalog"] else {"merge_into": [], "create_new": [{"path": path, "type": "concept", "title": topic.capitalize()}]})

    def _write(self, p: dict) -> str:
        sources = "\n".join(f"  - {r}" for r in p["refs"])
        return f"---\ntitle: {p['title']}\ntype: {p['type']}\ntags: [{', '.join(p['topics'][:5])}]\nsources:\n{sources}\n---\n\n# {p['title']}\n\n{p['summary']}\n"

    def _select(self, p: dict) -> str:
        lines, out = [(path, set(self._words(line))) for path, line in p["catalog"]], []
        for question in p["questions"]:
            asked = set(self._words(question))
            scored = sorted((-len(asked & words), path) for path, words in lines)
            out.append([path for score, path in scored if score < 0][: p["k"]])
        return json.dumps(out)

    def _answer(self, p: dict) -> str:
        if not p["articles"]:
            return "No article covers this."
        return " ".join(f"See [{t}]({path})." for path, t in p["articles"])


def call(rows: DataFrame, endpoint: ModelEndpoint, task: str, keys: list[str], schema: str) -> DataFrame:
    """keys, answer, error and outcome (ok, unavailable, cut_off or failed) of each row, asked once; the columns of rows are the payload. Errors of one row become its error column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = []
            for payload in f.to_dict("records"):
                payload = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in payload.items()}
                try:
                    said.append((endpoint.complete(task, payload), None, "ok"))
                except Exception as e:  # noqa: BLE001  reported as data
                    said.append((None, str(e), "unavailable" if isinstance(e, Unavailable) else "cut_off" if isinstance(e, CutOff) else "failed"))
            answers, errors, outcomes = zip(*said, strict=True) if said else ((), (), ())
            yield f[keys].assign(answer=list(answers), error=list(errors), outcome=list(outcomes))

    return rows.mapInPandas(run, f"{schema}, answer string, error string, outcome string")


@dataclass
class Patience:
    """How often a call that failed is made again, the wait before the first time (it doubles), the room of an answer and
    its ceiling, and the seconds that a call needs before a deadline."""

    again: int = 2
    wait: float = 10.0
    room: int = 4096
    ceiling: int = 64_000
    reserve: float = 60.0
    deadline: float | None = None  # by the clock below
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


def answered(rows: DataFrame, endpoint: ModelEndpoint, task: str, keys: list[str], schema: str, patience: Patience | None = None) -> DataFrame:
    """Keys, answer and error of each row; keys tell rows apart. Written before it is returned, so nothing is asked twice.

    Calls go in rounds over what is still open, a written table. What was unavailable waits 10, 20, ... seconds and is asked again,
    ``again`` times, unless that would end too near the deadline; what was cut off is asked at once with twice the room, up to the
    ceiling, and may be unavailable as often as a new call. An answer that came is never asked for again. A round waits for the
    earliest of its rows, so rows that have waited less stay open for another.
    """
    patience = patience or Patience()
    payload = rows.columns
    due, tries, room = F.lit(float("-inf")).alias("_due"), F.lit(0).alias("_tries"), F.lit(patience.room).alias("room")
    left = rows.select(*payload, room, tries, due)
    first, done = True, None
    while True:
        now = patience.clock()
        ready = left if first else left.where(F.col("_due") <= now)
        said = call(ready.drop("_tries", "_due"), endpoint, task, [*keys, "room"], f"{schema}, room int").transform(written)
        if first and said.where("outcome IN ('unavailable', 'cut_off')").isEmpty():
            return said.select(*keys, "answer", "error")
        now = patience.clock()
        known = said.join(ready.select(*keys, "_tries"), keys)
        wait = F.lit(patience.wait) * F.pow(F.lit(2.0), F.col("_tries"))
        wider = F.least(2 * F.col("room"), F.lit(patience.ceiling))
        late = lambda w: F.lit(False) if patience.deadline is None else F.lit(now) + w + patience.reserve > patience.deadline
        unavailable, cut = F.col("outcome") == "unavailable", F.col("outcome") == "cut_off"
        error = (
            F.when(unavailable & (F.col("_tries") >= patience.again), F.col("error"))
            .when(unavailable & late(wait), "deadline_too_close")
            .when(cut & (wider == F.col("room")), F.format_string("answer cut off at %d tokens", F.col("room")))
            .when(cut & late(F.lit(0.0)), "deadline_too_close")
            .when(~unavailable & ~cut, F.col("error"))
        )
        over = ~(unavailable | cut) | error.isNotNull()
        judged = known.withColumns({"_over": over, "_error": error, "_due": F.when(cut, F.lit(now)).otherwise(F.lit(now) + wait), "_next": F.when(cut, 0).otherwise(F.col("_tries") + 1), "_room": F.when(cut, wider).otherwise(F.col("room"))}).transform(written)
        ended = judged.where("_over").select(*keys, "answer", F.col("_error").alias("error"))
        done = ended if done is None else done.union(ended)
        again = judged.where("NOT _over").select(*keys, F.col("_room").alias("room"), F.col("_next").alias("_tries"), "_due")
        reopened = rows.join(again, keys).select(*payload, "room", "_tries", "_due")
        if not first:
            reopened = reopened.union(left.join(ready.select(*keys), keys, "left_anti").select(*payload, "room", "_tries", "_due"))
        left, first = reopened.transform(written), False
        soonest = left.agg(F.min("_due")).first()[0]
        if soonest is None:
            return done.transform(written)
        pause = soonest - patience.clock()
        if pause > 0:
            patience.sleep(pause)
