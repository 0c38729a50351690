"""State kept per key over streams: the rate limit and the newest entries.

The batch operators in ``tracewright.operators.usage`` give the reference
results; these give the same ones event by event, in the order of arrival
within a micro-batch sorted by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept_rate_stream(events: DataFrame, limit: float) -> DataFrame:
    """T1 over a stream of (user STRING, ts DOUBLE, event_id BIGINT): ``accepted`` per event."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        out = []
        for t in pdf["ts"]:
            ok = limit <= 0 or not key[0] or last is None or t - last >= limit
            if ok:
                last = t
            out.append(ok)
        if last is not None:
            state.update((last,))
        yield pdf.assign(accepted=out)[["user", "ts", "event_id", "accepted"]]

    return events.groupBy("user").applyInPandasWithState(run, "user string, ts double, event_id long, accepted boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def newest_stream(entries: DataFrame, ttl: float, most: int = 10) -> DataFrame:
    """T2 over a stream of (uid STRING, text STRING, stored_at DOUBLE): after each
    micro-batch the live entries of the users in it, the newest first."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf["stored_at"], pdf["text"], strict=True))
        now = max(t for t, _ in kept)
        kept = sorted((x for x in kept if now - x[0] <= ttl), reverse=True)[:most]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"uid": key[0], "rank": range(1, len(kept) + 1), "text": [x for _, x in kept], "stored_at": [t for t, _ in kept]})

    return entries.groupBy("uid").applyInPandasWithState(run, "uid string, rank int, text string, stored_at double", "times array<double>, texts array<string>", "update", GroupStateTimeout.NoTimeout)
