"""Admission: sliding-window rate limits, cooldowns, and the queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..lineage import BROADCAST_ROWS, cut


def sliding_count(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds n_recent: the user's events in the window that ends with each event, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count("*").over(w))


def admit(events: DataFrame, limit: int = 5, seconds: float = 3600, cooldown: float = 0) -> DataFrame:
    """(event_id, user_id, ts, admitted): an event is refused while ``limit`` admitted ones lie within ``seconds``; refused ones do not count.

    With a ``cooldown`` an event that passes the limit uses it up, and is refused all the same if it
    comes less than that after the last started one. Users are streamed in order of time: the state
    is at most ``limit`` times, whatever a user's number of events.
    """
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("_t", F.unix_micros("ts") / 1e6)
    schema = "event_id long, user_id long, ts timestamp, admitted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent, started = None, [], None
        for batch in batches:
            out = []
            for who, t in zip(batch["user_id"], batch["_t"]):
                if who != user:
                    user, recent, started = who, [], None
                recent = [x for x in recent if t - x < seconds]
                ok = len(recent) < limit
                if ok:
                    recent.append(t)
                    if cooldown and started is not None and t - started < cooldown:
                        ok = False
                    else:
                        started = t
                out.append(ok)
            yield batch[["event_id", "user_id", "ts"]].assign(admitted=out)

    return rows.where("user_id is not null").repartition("user_id").sortWithinPartitions("user_id", "_t", "event_id").mapInPandas(run, schema)


def queue_positions(requests: DataFrame, by: str) -> DataFrame:
    """Adds position, counted from 1 in order of arrival within ``by``.

    Requests are dealt out by ranges of (queue, time); each range counts for itself and starts from
    what the ranges before it hold, so that a queue of any length goes over many tasks.
    """
    order = ("ts", "event_id")
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(requests.repartitionByRange(tasks, by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_size"))  # a row for each range, and for each queue within one
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range", by).orderBy(*order)))
    side = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    placed = own.join(side, (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))
    return placed.select(*requests.columns, (F.col("_start") + F.col("_own")).alias("position"))
