"""Structured Streaming forms: flushing captured chunks, sessions with late data, rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLUSH_EVERY = "30 seconds"


def flush_stream(chunks: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = FLUSH_EVERY) -> StreamingQuery:
    """Embed-and-append of arriving chunks in micro-batches; empty batches write nothing, replays are dropped by id within the batch log."""

    def one(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            write_batch(batch.dropDuplicates(["id"]), epoch)

    w = chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def session_stream(events: DataFrame, entity: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap over a stream; events later than the watermark are left out."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    return s.select(entity, F.col("w.start").alias("start"), "last", "n")


def rate_stream(events: DataFrame, entity: str, time: str, cap: int, late: str = "10 seconds") -> DataFrame:
    """Requests per client and second, with those above the cap."""
    r = events.withWatermark(time, late).groupBy(F.window(time, "1 second").alias("w"), entity).agg(F.count(F.lit(1)).alias("n"))
    return r.select(entity, F.col("w.start").alias("second"), "n", F.greatest(F.col("n") - cap, F.lit(0)).alias("denied"))


def timeline_stream(events: DataFrame, time: str, *groups: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *groups).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *groups, "n")


def consecutive_stream(events: DataFrame, entity: str, time: str, what: str) -> DataFrame:
    """Changes of a value per entity, with the length of the run that ended; state is one small row per entity."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (None, 0)
        out = []
        arrived = list(frames)  # a micro-batch may come in several parts, which are in no order
        for v in pd.concat(arrived).sort_values(time, kind="stable")[what] if arrived else ():
            if v == value:
                n += 1
            else:
                if n:
                    out.append((key[0], value, n))
                value, n = v, 1
        state.update((value, n))
        yield pd.DataFrame(out, columns=["entity", "value", "n"])

    kind = events.schema[entity].dataType.simpleString()
    return events.select(entity, time, what).groupBy(entity).applyInPandasWithState(step, f"entity {kind}, value string, n bigint", "value string, n bigint", "append", GroupStateTimeout.NoTimeout)
