"""Query status as a keyed state machine with expiry, for an unbounded stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave.operators.lifecycle import COMPLETED, FAILED, IN_PROGRESS, QUEUED

#: What each state may turn into.
NEXT = {None: {QUEUED}, QUEUED: {IN_PROGRESS, FAILED}, IN_PROGRESS: {COMPLETED, FAILED}, COMPLETED: set(), FAILED: set()}


def advance(state: str | None, events: list[str]) -> tuple[str | None, int]:
    """State after the events, and how many of them it refused."""
    refused = 0
    for event in events:
        if event in NEXT.get(state, set()):
            state = event
        else:
            refused += 1
    return state, refused


def track(events: DataFrame, minutes: int = 10) -> DataFrame:
    """(query_id, status, refused, expired) as it changes; a finished query is forgotten ``minutes`` after.

    ``events`` is a stream of (query_id, status, at). Within a micro-batch events are taken in order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"query_id": [key[0]], "status": [held], "refused": [0], "expired": [True]})
            return
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        held, refused = advance(held, rows["status"].tolist())
        state.update((held,))
        if held in (COMPLETED, FAILED):
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame({"query_id": [key[0]], "status": [held], "refused": [refused], "expired": [False]})

    return events.groupBy("query_id").applyInPandasWithState(step, "query_id string, status string, refused long, expired boolean", "status string", "update", GroupStateTimeout.ProcessingTimeTimeout)
