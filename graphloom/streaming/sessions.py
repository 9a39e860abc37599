"""Session state: the last turns of each conversation, on the driver, in a batch and in a stream."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

KEPT, VISIBLE, NAMES, TTL = 10, 5, 3, 3600.0


@dataclass
class SessionMemory:
    """Turns per session; a session unused for ``ttl`` seconds is dropped at the next access of any."""

    ttl: float = TTL
    clock: Callable[[], float] = time.time
    turns: dict[str, deque] = field(default_factory=dict)
    used: dict[str, float] = field(default_factory=dict)

    def _touch(self, session: str) -> deque:
        now = self.clock()
        for s in [s for s, t in self.used.items() if now - t > self.ttl]:
            del self.used[s], self.turns[s]
        self.used[session] = now
        return self.turns.setdefault(session, deque(maxlen=KEPT))

    def add(self, session: str, query: str, answer: str, entities: list[str], ids: list[str], events: list[str]) -> None:
        self._touch(session).append((query, answer, entities, ids, events))

    def context(self, session: str) -> dict:
        """Entities of the visible turns, the latest first, each once, and the latest event."""
        visible = list(self._touch(session))[-VISIBLE:][::-1]
        return {
            "entities": list(dict.fromkeys(e for t in visible for e in t[2])),
            "ids": list(dict.fromkeys(i for t in visible for i in t[3])),
            "event": next((e for t in visible for e in t[4]), None),
        }

    def clear(self, session: str) -> None:
        self.turns.pop(session, None), self.used.pop(session, None)


def contexts(turns: DataFrame, key: str = "session_id", order: str = "seq", entities: str = "entities") -> DataFrame:
    """Per turn the entities of the visible turns up to it, the latest turn's first, each once, three a turn."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(VISIBLE - 1), 0)
    seen = F.collect_list(F.slice(entities, 1, NAMES)).over(w)
    return turns.withColumn("context", F.array_distinct(F.flatten(F.reverse(seen))))


def sessions(events: DataFrame, key: str, at: str, gap: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap that long: (key, start, end, n)."""
    s = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


OUT = "session_id string, seq long, context array<string>"


def stream_contexts(turns: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """``contexts`` as a stateful stream over (session_id, seq, entities, at): ten turns are kept per session, and a
    session without turns for ``ttl`` of event time is dropped."""
    seconds = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [list(t) for t in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = []
        for r in rows.itertuples():
            kept = (kept + [list(r.entities) if r.entities is not None else []])[-KEPT:]
            recent = kept[-VISIBLE:][::-1]
            out.append((key[0], r.seq, list(dict.fromkeys(e for t in recent for e in t[:NAMES]))))
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000) + seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "seq", "context"])

    return turns.withWatermark("at", "10 minutes").groupBy("session_id").applyInPandasWithState(update, OUT, "turns array<array<string>>", "append", GroupStateTimeout.EventTimeTimeout)
