"""Sessions: events of one entity divided at idle gaps.

Each (entity, block of 32,768 cells) gets an occupancy bitmap, built by a partial aggregate inside the JVM.  A bitmap
is closed morphologically: dilated and eroded by doubling shifts, so that every hole that is certainly no longer than
the gap is filled.  The remaining runs get their exact first and last event by an equi-join on (entity, block), and
neighbours whose exact distance is within the gap (across blocks, or at the resolution of a cell) are joined last.
The last step sees one row per run: its size is bounded by time span / gap and does not grow with the events.

Nulls: events without entity (null or '') or time (null or <= 0) take no part.  Rows repeated under one id count once.
An empty table gives no sessions.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.session import once_per_id

BLOCK_CELLS = 32768
CELLS_PER_GAP = 1800
RUN_TYPE = "array<struct<lo:int,hi:int>>"


def _spread(x: int, by: int, left: bool) -> int:
    """OR (left) or AND (right) of x shifted by 0..by, with a logarithmic number of shifts."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        x = x | (x << step) if left else x & (x >> step)
        done += step
    return x


def close_bitmap(raw: bytes, reach: int) -> list[tuple[int, int]]:
    """Runs (first cell, last cell) after filling holes between cells at most `reach` apart."""
    x = int.from_bytes(raw, "little")
    if not x:
        return []
    grow = max(reach - 1, 0)
    closed = _spread(_spread(x, grow, True), grow, False)
    size = closed.bit_length() // 8 + 1

    def places(v: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(v.to_bytes(size + 1, "little"), np.uint8), bitorder="little"))

    return list(zip(places(closed & ~(closed << 1)).tolist(), places(closed & ~(closed >> 1)).tolist()))


def _closing(reach: int):
    @F.pandas_udf(RUN_TYPE)
    def runs(bitmaps: pd.Series) -> pd.Series:
        return bitmaps.map(lambda b: [{"lo": a, "hi": z} for a, z in close_bitmap(bytes(b), reach)])

    return runs


def known_events(df: DataFrame, entity: str, time: str, key: str, *extra: str) -> DataFrame:
    """Events that take part, once per id."""
    d = once_per_id(df.filter((F.col(time) > 0) & (F.col(entity) != "")), key, time, entity, *extra)
    return d.filter(F.col(time).isNotNull())


def session_parts(events: DataFrame, entity: str, time: str, gap_ms: int) -> DataFrame:
    """Events with the block and run that hold them: columns of events + _block, _run."""
    cell_ms = max(1, gap_ms // CELLS_PER_GAP)
    cell = F.floor(F.col(time) / F.lit(cell_ms)).cast("bigint")
    reach = max(1, (gap_ms + 1) // cell_ms - 1)
    e = events.withColumn("_cell", cell).withColumn("_block", F.floor(F.col("_cell") / BLOCK_CELLS).cast("bigint"))
    e = e.withColumn("_pos", F.pmod(F.col("_cell"), F.lit(BLOCK_CELLS)).cast("int")).drop("_cell")
    maps = e.groupBy(entity, "_block").agg(F.bitmap_construct_agg(F.col("_pos").cast("bigint")).alias("_map"))
    runs = maps.select(entity, "_block", F.transform(_closing(reach)("_map"), lambda r: r["lo"]).alias("_lo"))
    j = e.join(runs, [entity, "_block"])
    return j.withColumn("_run", F.size(F.filter("_lo", lambda lo: lo <= F.col("_pos")))).drop("_lo", "_pos")


def _numbered(parts: DataFrame, entity: str, time: str, gap_ms: int) -> DataFrame:
    """One row per run with the start of the session it belongs to."""
    runs = parts.groupBy(entity, "_block", "_run").agg(F.min(time).alias("_a"), F.max(time).alias("_z"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(entity).orderBy("_a")
    new = F.when(F.col("_a") - F.lag("_z").over(w) <= gap_ms, F.lit(None)).otherwise(F.col("_a"))
    return runs.withColumn("_new", new).withColumn("start_ms", F.last("_new", ignorenulls=True).over(w))


def sessionize(df: DataFrame, entity: str = "session_id", time: str = "captured_at_ms", key: str = "id", gap_ms: int = 1_800_000) -> DataFrame:
    """One row per session: entity, start_ms, end_ms, duration_ms, n_events."""
    parts = session_parts(known_events(df, entity, time, key), entity, time, gap_ms)
    s = _numbered(parts, entity, time, gap_ms).groupBy(entity, "start_ms").agg(F.max("_z").alias("end_ms"), F.sum("_n").alias("n_events"))
    return s.select(entity, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")


def session_app_counts(
    df: DataFrame, entity: str = "session_id", time: str = "captured_at_ms", key: str = "id", app: str = "app_name", gap_ms: int = 1_800_000
) -> DataFrame:
    """Events per session and app; apps are compared without letter case and outer spaces, null counts as ''."""
    e = known_events(df, entity, time, key, app).withColumn("app", F.lower(F.trim(F.coalesce(F.col(app), F.lit("")))))
    parts = session_parts(e.select(entity, time, "app"), entity, time, gap_ms)
    by_app = parts.groupBy(entity, "_block", "_run", "app").agg(F.min(time).alias("_a"), F.max(time).alias("_z"), F.count(F.lit(1)).alias("n"))
    runs = by_app.groupBy(entity, "_block", "_run").agg(
        F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.collect_list(F.struct("app", "n")).alias("_apps")
    )
    w = Window.partitionBy(entity).orderBy("_a")
    new = F.when(F.col("_a") - F.lag("_z").over(w) <= gap_ms, F.lit(None)).otherwise(F.col("_a"))
    runs = runs.withColumn("_new", new).withColumn("start_ms", F.last("_new", ignorenulls=True).over(w))
    return runs.select(entity, "start_ms", F.explode("_apps").alias("_x")).groupBy(entity, "start_ms", F.col("_x.app").alias("app_name")).agg(F.sum("_x.n").alias("n_events"))
