"""Admission by rolling windows: only accepted events count, so it is a fold over a client's events, batch or stream."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted events allowed within so many seconds.
QUOTA = ((5, 60.0), (50, 86_400.0))
LOGIN = ((10, 60.0),)
SESSION_SECONDS = 43_200


class Rolling:
    """The accepted times of one client, as far back as the longest window."""

    def __init__(self, limits: tuple = QUOTA, times: Iterable[float] = ()):
        self.limits, self.times = limits, deque(times)

    def offer(self, now: float) -> int | None:
        """None if the event is accepted, else the seconds until one would be."""
        longest = max(w for _, w in self.limits)
        while self.times and self.times[0] <= now - longest:
            self.times.popleft()
        waits = []
        for most, window in self.limits:
            inside = [t for t in self.times if t > now - window]
            if len(inside) >= most:
                waits.append(inside[-most] + window - now)
        if waits:
            return max(1, math.ceil(max(waits)))
        self.times.append(now)
        return None


def admitted(log: DataFrame, limits: tuple = QUOTA) -> DataFrame:
    """(id, client, asked_at, accepted, retry_after), each event once, by client in time order (ties by id).

    Null clients are one client of their own; a null time is refused without a retry. A client's events stream through one task in order, with
    no more than the accepted times of the longest window held.
    """
    rows = log.select("id", "client", "asked_at").distinct()
    timed = rows.where("asked_at is not null and not isnan(asked_at)")
    spread = timed.repartition(F.coalesce("client", F.lit("\0"))).sortWithinPartitions(F.coalesce("client", F.lit("\0")), "asked_at", "id")

    def run(batches):
        client, window = object(), None
        for pdf in batches:
            out = []
            for c, t in zip(pdf.client, pdf.asked_at):
                if window is None or c != client:
                    client, window = c, Rolling(limits)
                out.append(window.offer(t))
            yield pdf.assign(accepted=[x is None for x in out], retry_after=pd.array([x for x in out], dtype="Int32"))

    schema = "id bigint, client string, asked_at double, accepted boolean, retry_after int"
    return spread.mapInPandas(run, schema).unionByName(rows.where("asked_at is null or isnan(asked_at)").select("*", F.lit(False).alias("accepted"), F.lit(None).cast("int").alias("retry_after")))


def session_active(events: DataFrame, at: str) -> DataFrame:
    """(user_id, sessions): users with sessions, begun by a signup and valid for SESSION_SECONDS, at a time."""
    now = F.to_timestamp_ntz(F.lit(at))
    begun = events.where("event_type = 'signup' and ts is not null and user_id is not null")
    return begun.where((F.col("ts") <= now) & (F.col("ts") + F.expr(f"INTERVAL {SESSION_SECONDS} SECONDS") > now)).groupBy("user_id").agg(F.count("*").alias("sessions"))
