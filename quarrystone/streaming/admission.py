"""Stateful admission and the request queue as streaming queries."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

log = logging.getLogger(__name__)


def admit_stream(events: DataFrame, limit: int = 5, seconds: float = 3600, cooldown: float = 0, late: str = "1 hour") -> DataFrame:
    """The sliding-window limiter, with a cooldown as in ``limits.admit``, on a stream of (event_id, user_id, ts): adds admitted.

    The state of a user is the admitted times within the window and the last start. It is dropped once the
    watermark, ``late`` behind the newest event, has passed the window; events that come later than that
    are left out. Events of a user are taken in order of time within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, started = state.get if state.exists else ([], None)
        recent = list(recent)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out, t = [], 0.0
        for t in rows["ts"].astype("int64") / (1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1e6):
            recent = [x for x in recent if t - x < seconds]
            ok = len(recent) < limit
            if ok:
                recent.append(t)
                ok = not (cooldown and started is not None and t - started < cooldown)
                started = t if ok else started
            out.append(ok)
        state.update((recent, started))
        state.setTimeoutTimestamp(max(int((t + max(seconds, cooldown)) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[["event_id", "user_id", "ts"]].assign(admitted=out)

    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, ts timestamp, admitted boolean", "recent array<double>, started double", "append", GroupStateTimeout.EventTimeTimeout)


def run_queue(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", available_now: bool = False, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """One worker over a stream of requests: micro-batches in turn, each passed to ``handle`` once it is its turn; a failed one is logged, told to ``failed``, and the next goes on."""

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as error:  # the failure of one batch must not stop the queue
            log.warning("batch %d failed: %s", number, error)
            if failed:
                failed(number, error)

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(guarded)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
