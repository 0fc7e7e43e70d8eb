"""Streams of tile requests: slots that move, answers that come too late, windows that follow a viewer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICTS = "slot bigint, version bigint, event_id bigint, verdict string"


def _judge(slot: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Assignments raise a slot's version (-1 before the first); an answer counts only if it is of that version."""
    current = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values("event_id", kind="stable")
    out = []
    for e in rows.itertuples(index=False):
        if e.kind == "assign":
            current = e.version if current is None else max(current, e.version)
            out.append((slot[0], e.version, e.event_id, "assigned"))
        else:
            out.append((slot[0], e.version, e.event_id, "kept" if e.version == (-1 if current is None else current) else "stale"))
    if current is not None:
        state.update((current,))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in VERDICTS.split(", ")])


def drop_stale(events: DataFrame) -> DataFrame:
    """Verdict on each event of a stream (event_id, slot, kind 'assign' or 'answer', version), in order of event_id.

    State is one number a slot, whatever the stream brings.
    """
    return events.groupBy("slot").applyInPandasWithState(_judge, VERDICTS, "current bigint", "append", GroupStateTimeout.NoTimeout)


def _follow(viewer: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tiles that come into and go out of each viewer's window as it moves."""
    rows = pd.concat(list(parts)).sort_values("event_id", kind="stable")
    place = state.get if state.exists else None
    out = []
    for e in rows.itertuples(index=False):
        new = (int(e.x), int(e.y), int(e.nx), int(e.ny))
        box = lambda p: {(p[0] + i, p[1] - j) for j in range(p[3]) for i in range(p[2])} if p else set()
        have, want = box(place), box(new)
        out += [(viewer[0], e.event_id, x, y, "load") for x, y in sorted(want - have)] + [(viewer[0], e.event_id, x, y, "drop") for x, y in sorted(have - want)]
        place = new
    state.update(place)
    yield pd.DataFrame(out, columns=["viewer", "event_id", "x", "y", "action"])


def follow_windows(moves: DataFrame) -> DataFrame:
    """Loads and drops of moving windows; moves has event_id, viewer, corner x and y, and the size nx x ny."""
    return moves.groupBy("viewer").applyInPandasWithState(_follow, "viewer bigint, event_id bigint, x bigint, y bigint, action string", "x bigint, y bigint, nx bigint, ny bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that is there, in bounded micro-batches, written to a table; a restart goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class CaughtUp(StreamingQueryListener):
    """Calls back with the number of rows done whenever a stream finds nothing more to do."""

    def __init__(self, call: Callable[[int], None]) -> None:
        self.call, self.done = call, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        n = event.progress.numInputRows
        self.done += n
        if not n and self.done:
            self._tell()

    def onQueryIdle(self, event) -> None:
        if self.done:
            self._tell()

    def onQueryTerminated(self, event) -> None:
        if self.done:
            self._tell()

    def _tell(self) -> None:
        done, self.done = self.done, 0
        self.call(done)
