"""The quota as a stream: the same fold, its state kept by Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.limits import QUOTA, Rolling

OUT = "id bigint, client string, asked_at double, accepted boolean, retry_after int"
STATE = "times array<double>, ids array<bigint>, at array<double>"


def admitted_stream(log: DataFrame, limits: tuple = QUOTA) -> DataFrame:
    """Decides each event of a streaming log (id, client, asked_at); events of one trigger are taken in time order (ties by id).

    As in the batch form, an event delivered twice is decided once, as long as its first delivery is within the longest window; an event without a time
    is refused without a retry; null clients are one client. One client is one state, which holds no more than the longest window.
    """
    longest = max(w for _, w in limits)

    def step(key, frames, state: GroupState):
        times, ids, at = state.get if state.exists else ((), (), ())
        window, seen = Rolling(limits, times), dict(zip(ids, at))
        rows = pd.concat(list(frames)).drop_duplicates(["id", "asked_at"])
        rows = rows[[i not in seen or seen[i] != t for i, t in zip(rows.id, rows.asked_at)]]
        known, unknown = rows[rows.asked_at.notna()].sort_values(["asked_at", "id"]), rows[rows.asked_at.isna()]
        waits = [window.offer(t) for t in known.asked_at]
        seen |= dict(zip(known.id, known.asked_at))
        last = max(seen.values(), default=0.0)
        seen = {i: t for i, t in seen.items() if t > last - longest}
        state.update((list(window.times), list(seen), list(seen.values())))
        out = pd.concat([known.assign(accepted=[w is None for w in waits], retry_after=pd.array(waits, dtype="Int32")), unknown.assign(accepted=False, retry_after=pd.array([None] * len(unknown), dtype="Int32"))])
        yield out[["id", "client", "asked_at", "accepted", "retry_after"]]

    return log.select("id", "client", "asked_at").groupBy("client").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
