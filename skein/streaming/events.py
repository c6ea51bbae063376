"""Windowed and stateful operators on events; each works on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def _marked(events: DataFrame) -> DataFrame:
    """Event times of streams have to be instants; those without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events


def hourly(events: DataFrame) -> DataFrame:
    """Counts and totals by hour and type."""
    found = _marked(events).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("hour_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with pauses shorter than ``gap``."""
    found = _marked(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), "n")


def _decide(times: list[int], recent: list[int], limit: int, span: int) -> list[bool]:
    """For times in order, whether each is accepted; ``recent`` is left with the accepted times of the last span."""
    accepted = []
    for now in times:
        while recent and now - recent[0] >= span:
            recent.pop(0)
        accepted.append(len(recent) < limit)
        if accepted[-1]:
            recent.append(now)
    return accepted


def limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, accepted: at most ``limit`` accepted events of a user within ``seconds``; refused ones do not count.

    A user's events are decided in the order of their times, then ids. In a batch they come sorted to their task in a
    stream of rows; what is kept of them is the accepted ones of the last window, so any number of events of one user
    needs no more memory than ``limit`` times. On a stream a user's state is these and the events that the watermark has
    not passed: an event is decided when no earlier one can come any more, so the decisions are those of the batch in
    whatever order and batches the events arrive. State that no later event can need is removed by a timer.

    Defined results. Null users are one user. Events without a time have no place in the order and get no row. On a
    stream an event later than the watermark gets none either: the ones after it have been decided (the progress of the
    query counts it). Repeated rows are events each; ``without_repeats`` goes before.
    """
    timed = events.where("ts IS NOT NULL")
    return _limited_stream(timed, limit, seconds * 1_000_000) if events.isStreaming else _limited_batch(timed, limit, seconds * 1_000_000)


def _limited_batch(events: DataFrame, limit: int, span: int) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    ordered = events.select("user_id", micros, "event_id").repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, []
        for frame in frames:
            ids = frame["user_id"].astype(object).where(frame["user_id"].notna(), None)
            accepted = []
            for u, at in zip(ids, frame["at"].tolist(), strict=True):
                if u != user:
                    user, recent = u, []
                accepted += _decide([at], recent, limit, span)
            yield pd.DataFrame({"event_id": frame["event_id"], "accepted": accepted})

    return ordered.mapInPandas(run, "event_id long, accepted boolean")


def _limited_stream(events: DataFrame, limit: int, span: int) -> DataFrame:
    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, recent = (list(x) for x in state.get) if state.exists else ([], [], [])
        for frame in frames:
            times += frame["at"].tolist()
            ids += [None if pd.isna(i) else int(i) for i in frame["event_id"]]
        passed = state.getCurrentWatermarkMs() * 1000
        # Nulls first, as in the batch.
        waiting = sorted(zip(times, ids, strict=True), key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        ready = [e for e in waiting if e[0] <= passed]
        waiting = waiting[len(ready) :]
        accepted = _decide([at for at, _ in ready], recent, limit, span)
        # The next event that can be decided, or the end of what has been accepted, in milliseconds after the watermark.
        due = waiting[0][0] if waiting else recent[-1] + span if recent else 0
        if waiting or due > passed:
            state.update(([at for at, _ in waiting], [i for _, i in waiting], recent))
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": pd.array([i for _, i in ready], "Int64"), "accepted": pd.array(accepted, "boolean")})

    rows = _marked(events).select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, accepted boolean", "times array<long>, ids array<long>, recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(events: DataFrame) -> DataFrame:
    """Each event once; on a stream within the watermark."""
    return _marked(events).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
