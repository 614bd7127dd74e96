"""Streams of frames and requests whose state ends: throttling, stale frames, reports, the latest request, cancellations.

Every function takes a stream with an event time and a watermark on it (``withWatermark``). A session's state is dropped
``idle`` milliseconds of event time after its last row; a session that comes back later begins anew. Rows of one micro-batch
count in the order of (time, seq), ties included; rows older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE = 600_000


def _ms(at: pd.Timestamp) -> int:
    return round(at.timestamp() * 1000)


def _kept(stream: DataFrame, key: str, time: str, step: Callable[[Any, Any, int], tuple[Any, bool]], shape: str, idle: int) -> DataFrame:
    """The rows of a stream with columns (key, seq, time, value) that ``step(state, row, ms)`` keeps, as (key, seq)."""

    def run(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, out, newest = state.get if state.exists else None, [], state.getCurrentWatermarkMs()
        for row in pd.concat(list(batches)).sort_values(["time", "seq"]).itertuples(index=False):
            ms = _ms(row.time)
            known, kept = step(known, row, ms)
            newest = max(newest, ms)
            if kept:
                out.append((found[0], int(row.seq)))
        state.update(known)
        state.setTimeoutTimestamp(newest + idle)
        yield pd.DataFrame(out, columns=[key, "seq"])

    named = stream.withColumnRenamed(time, "time") if time != "time" else stream
    kind = dict(stream.dtypes)[key]
    return named.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long", shape, "append", GroupStateTimeout.EventTimeTimeout)


def throttle(frames: DataFrame, every: int, key: str = "session_id", time: str = "at", idle: int = IDLE) -> DataFrame:
    """(key, seq) of the first frame of each interval of ``every`` milliseconds of a session. A frame of an interval before the newest
    one comes too late."""

    def step(state, row, ms):
        interval = ms // every
        fresh = state is None or interval > state[0]
        return ((interval,), True) if fresh else (state, False)

    return _kept(frames, key, time, step, "interval long", idle)


def drop_stale(frames: DataFrame, key: str = "session_id", time: str = "at", idle: int = IDLE) -> DataFrame:
    """(key, seq) of frames whose ``generation`` isn't older than the newest seen so far in their session."""

    def step(state, row, ms):
        newest = int(row.generation) if state is None else max(state[0], int(row.generation))
        return (newest,), row.generation >= newest

    return _kept(frames, key, time, step, "newest long", idle)


def report(frames: DataFrame, every: int, key: str = "session_id", time: str = "at", idle: int = IDLE) -> DataFrame:
    """(key, seq) of frames that a report is made at: the first, and each that comes ``every`` milliseconds or more after the last
    report."""

    def step(state, row, ms):
        due = state is None or ms - state[0] >= every
        return ((ms,), True) if due else (state, False)

    return _kept(frames, key, time, step, "last long", idle)


def drop_cancelled(requests: DataFrame, cancelled: DataFrame, key: str = "document_id", time: str = "at", idle: int = IDLE) -> DataFrame:
    """(key, seq) of requests (key, seq, time) of documents that no row (key, time) of a second stream has cancelled by then.

    A cancellation at the time of a request comes first. Requests that went on before stay."""
    both = requests.select(key, "seq", time, F.lit(False).alias("ends"))
    both = both.unionByName(cancelled.select(key, F.lit(-1).cast("long").alias("seq"), time, F.lit(True).alias("ends")))

    def step(state, row, ms):
        gone = bool(row.ends) or state is not None and state[0]
        return (gone,), not gone

    return _kept(both, key, time, step, "gone boolean", idle)


def latest_request(requests: DataFrame, delay: int, key: str = "document_id", time: str = "at") -> DataFrame:
    """(key, seq, request) of the last request of a document once the watermark is ``delay`` milliseconds past it and nothing newer has come;
    requests that a newer one replaces before that are never made."""

    def run(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, seq, request = state.get
            state.remove()
            yield pd.DataFrame([(found[0], seq, request)], columns=[key, "seq", "request"])
            return
        best = state.get if state.exists else None
        for row in pd.concat(list(batches)).itertuples(index=False):
            new = (_ms(row.time), int(row.seq), row.request)
            best = new if best is None or new[:2] > tuple(best[:2]) else best
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] + delay, state.getCurrentWatermarkMs() + 1))

    named = requests.withColumnRenamed(time, "time") if time != "time" else requests
    shape = f"{key} {dict(requests.dtypes)[key]}, seq long, request string"
    return named.groupBy(key).applyInPandasWithState(run, shape, "ms long, seq long, request string", "append", GroupStateTimeout.EventTimeTimeout)
