"""Activity over time: timelines, focus, sessions, loops, counters, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(df: DataFrame, time: str, unit: str, *groups: str) -> DataFrame:
    """Rows per hour or day (and further groups)."""
    return df.groupBy(F.date_trunc(unit, F.col(time)).alias("bucket"), *groups).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def delta_since(df: DataFrame, time: str, since) -> DataFrame:
    return df.filter(F.col(time) > F.lit(since))


def active_focus(df: DataFrame, entity: str, time: str, what: str, window_s: int) -> DataFrame:
    """Per entity the latest value and the commonest within a trailing window before its last event."""
    last = df.groupBy(entity).agg(F.max(time).alias("_last"))
    d = df.join(last, entity).filter(F.col(time) >= F.col("_last") - F.make_interval(secs=F.lit(window_s)))
    c = d.groupBy(entity, what).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("t"))
    latest = F.max_by(what, F.struct("t", what))
    return c.groupBy(entity).agg(latest.alias("latest"), F.max_by(what, F.struct("n", "t", what)).alias("focus"), F.sum("n").alias("events"))


def lagged(df: DataFrame, entity: str, time: str, order: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds columns name -> (column, n): its value n rows before, per entity.

    Windows run within (entity, day), so an entity with a third of all rows is spread over its days; the first rows of a
    day get theirs from a window over day edges only, which grows with the time span and not with the rows.  `order`
    must be total within the entity and begin with `time`."""
    n = max(k for _, k in columns.values())
    inner, outer = Window.partitionBy(entity, "_day").orderBy(*order), Window.partitionBy(entity).orderBy(*order)
    d = df.withColumn("_day", F.to_date(F.col(time)))
    d = d.withColumn("_rn", F.row_number().over(inner)).withColumn("_left", F.count(F.lit(1)).over(Window.partitionBy(entity, "_day")) - F.col("_rn"))
    rest = d.select("*", *[F.lag(c, k).over(inner).alias(a) for a, (c, k) in columns.items()]).filter(F.col("_rn") > n)
    edges = d.filter((F.col("_rn") <= n) | (F.col("_left") < n))
    heads = edges.select("*", *[F.lag(c, k).over(outer).alias(a) for a, (c, k) in columns.items()]).filter(F.col("_rn") <= n)
    return rest.unionByName(heads).drop("_day", "_rn", "_left")


def gap_sessions(df: DataFrame, entity: str, time: str, gap_s: int) -> DataFrame:
    """Session number of every row, by gaps; numbers are counted within days and then shifted by the days before."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    order = [time, *[c for c in df.columns if c not in (entity, time)]]
    d = lagged(df, entity, time, order, {"_before": (time, 1)})
    new = F.when(seconds(time) - seconds("_before") <= gap_s, 0).otherwise(1)
    d = d.withColumn("_new", new).withColumn("_day", F.to_date(F.col(time)))
    days = d.groupBy(entity, "_day").agg(F.sum("_new").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy(entity).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(entity, "_day", base.alias("_base"))
    inside = F.sum("_new").over(Window.partitionBy(entity, "_day").orderBy(*order))
    return d.withColumn("_in", inside).join(days, [entity, "_day"]).withColumn("session", F.col("_base") + F.col("_in")).drop("_before", "_new", "_day", "_in", "_base")


def without_consecutive(df: DataFrame, entity: str, order: list[str], key: Column) -> DataFrame:
    """Rows whose key differs from the row before; order begins with the time and is total."""
    d = lagged(df.withColumn("_k", key), entity, order[0], order, {"_p": ("_k", 1)})
    return d.filter(F.col("_p").isNull() | (F.col("_k") != F.col("_p"))).drop("_k", "_p")


def back_and_forth(df: DataFrame, entity: str, order: list[str], what: str) -> DataFrame:
    """Rows that end an A-B-A pattern."""
    d = lagged(df, entity, order[0], order, {"_1": (what, 1), "_2": (what, 2)})
    return d.filter((F.col("_2") == F.col(what)) & (F.col("_1") != F.col(what))).drop("_1", "_2")


def hash_distance(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit picture hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def near_repeats(df: DataFrame, entity: str, order: list[str], picture: str, most: int) -> DataFrame:
    """Frames within `most` bits of the frame before."""
    d = lagged(df, entity, order[0], order, {"_p": (picture, 1)})
    return d.withColumn("distance", hash_distance(F.col(picture), F.col("_p"))).drop("_p").withColumn("repeat", F.coalesce(F.col("distance") <= most, F.lit(False)))


def rate_window(df: DataFrame, entity: str, time: str, cap: int) -> DataFrame:
    """admitted: the first `cap` requests of each calendar second of a client."""
    sec = F.date_trunc("second", F.col(time))
    w = Window.partitionBy(entity, "second").orderBy(time, *[c for c in df.columns if c not in (entity, time)][:1])
    return df.withColumn("second", sec).withColumn("nth", F.row_number().over(w)).withColumn("admitted", F.col("nth") <= cap)


def admission(df: DataFrame, rate_ok: str, host_ok: str, origin_ok: str, token_ok: str) -> DataFrame:
    """status and reason of a request log; the checks apply in this order."""
    bad = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = F.when(bad(rate_ok), "rate").when(bad(host_ok), "host").when(bad(origin_ok), "origin").when(bad(token_ok), "token").otherwise("ok")
    status = F.when(bad(rate_ok), 429).when(bad(host_ok) | bad(origin_ok), 403).when(bad(token_ok), 401).otherwise(200)
    return df.withColumn("reason", reason).withColumn("status", status)


def capture_admission(df: DataFrame, title: str, text: str, app: str) -> DataFrame:
    """admitted and reason: navigation surfaces and records that are nothing but an address are skipped."""
    from mnemolake.functions import text as T

    body = T.trim_all(T.col(text))
    only_url = body.rlike(r"^(?:https?://)?[\w.\-]+\.[a-z]{2,}(?:/\S*)?$")
    nav = T.generic_title(T.col(app), T.normalize_inline(T.col(title))) & (T.bytes_of(T.reduce_noise(T.col(app), T.col(text))) < 80)
    reason = F.when(body == "", "empty").when(only_url, "url_only").when(nav, "navigation")
    return df.withColumn("reason", reason).withColumn("admitted", reason.isNull())


def sampling(df: DataFrame, entity: str, time: str, idle_s: int, forced_s: int) -> DataFrame:
    """captured: replay of adaptive sampling; a tick counts after activity within idle_s, or if forced_s went by."""
    order = [time, *[c for c in df.columns if c not in (entity, time)]]
    d = lagged(df, entity, time, order, {"_b": (time, 1)})
    gap = F.col(time).cast("timestamp").cast("double") - F.col("_b").cast("timestamp").cast("double")
    return d.withColumn("captured", F.col("_b").isNull() | (gap <= idle_s) | (gap >= forced_s)).drop("_b")


def consolidation(df: DataFrame, time: str, zone: str, day: str, *groups: str) -> DataFrame:
    """What a daily run over a local day would take in: a dry run that only counts."""
    local = F.to_date(F.from_utc_timestamp(F.timestamp_millis(F.col(time)), zone))
    return df.filter(local == F.lit(day).cast("date")).groupBy(*groups).agg(F.count(F.lit(1)).alias("records"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))


def skip_counters(df: DataFrame, reason: str) -> DataFrame:
    """One terminal counter per tick."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("stored")).alias("reason")).agg(F.count(F.lit(1)).alias("ticks"))


def capture_explain(df: DataFrame, time: str, stage: str, reason: str, lo, hi) -> DataFrame:
    return df.filter((F.col(time) >= lo) & (F.col(time) < hi) & F.col(reason).isNotNull()).select(time, stage, reason).orderBy(time)


def gate_deltas(a: DataFrame, b: DataFrame, gate: str) -> DataFrame:
    """Drops per gate under two policies and the difference."""
    n = lambda d, c: d.groupBy(gate).agg(F.count(F.lit(1)).alias(c))
    j = n(a, "before").join(n(b, "after"), gate, "full_outer").fillna(0, ["before", "after"])
    return j.withColumn("delta", F.col("after") - F.col("before"))


def meeting_overlap(segments: DataFrame, records: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """segment_id, record_id of records captured during a segment: an equi-join on time buckets, then the exact range."""
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("started_at_ms") / bucket_ms), F.floor(F.col("ended_at_ms") / bucket_ms))))
    r = records.withColumn("_b", F.floor(F.col("captured_at_ms") / bucket_ms))
    j = s.join(r, "_b").filter((F.col("captured_at_ms") >= F.col("started_at_ms")) & (F.col("captured_at_ms") < F.col("ended_at_ms")))
    return j.select("segment_id", "record_id")


def due_reviews(queue: DataFrame, now_ms: int, cap: int = 5) -> DataFrame:
    return queue.filter((F.col("next_attempt_at_ms") <= now_ms) & (F.col("attempts") < cap))


def after_attempt(queue: DataFrame, ok: Column, now_ms: int, base_ms: int = 60_000, cap: int = 5) -> DataFrame:
    """Queue after one attempt: done rows leave, others wait longer each time, the last failure is final."""
    q = queue.withColumn("_ok", ok).filter("not _ok").drop("_ok").withColumn("attempts", F.col("attempts") + 1)
    wait = (F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("bigint")
    return q.withColumn("next_attempt_at_ms", F.lit(now_ms) + wait).withColumn("failed", F.col("attempts") >= cap)


def by_priority(jobs: DataFrame, classes: list[str], kind: str = "class", enqueued: str = "enqueued_at_ms") -> DataFrame:
    """Jobs with their class number; sort by (priority, enqueued) to serve them."""
    pr = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(kind))
    return jobs.withColumn("priority", pr).orderBy("priority", enqueued)


def drift(df: DataFrame, entity: str, time: str, app: str, unit: str = "hour") -> DataFrame:
    """Changes of app per event and time bucket."""
    d = lagged(df.select(entity, time, app), entity, time, [time, app], {"_p": (app, 1)})
    d = d.withColumn("_c", F.coalesce((F.col("_p") != F.col(app)).cast("int"), F.lit(0)))
    return d.groupBy(entity, F.date_trunc(unit, F.col(time)).alias("bucket")).agg(F.sum("_c").alias("changes"), F.count(F.lit(1)).alias("events"))


def capped_per_day(df: DataFrame, time: str, order: list[str], cap: int, *groups: str) -> DataFrame:
    """The first `cap` rows of each day and group (a frequency cap)."""
    w = Window.partitionBy("_day", *groups).orderBy(*order)
    d = df.withColumn("_day", F.to_date(F.col(time)))
    return d.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= cap).withColumnRenamed("_day", "day")


def usage(df: DataFrame, time: str, tool: str) -> DataFrame:
    return df.groupBy(F.to_date(F.col(time)).alias("day"), F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("served"))


def story(df: DataFrame, entity: str, session: str, time: str, what: str) -> DataFrame:
    """Per session the ordered, cited list of what happened."""
    return df.groupBy(entity, session).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("at"), F.col(what).alias("what")))).alias("story"))


def daily_digest(df: DataFrame, time: str, day: str, *groups: str) -> DataFrame:
    return df.filter(F.to_date(F.col(time)) == F.lit(day).cast("date")).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def continuity(df: DataFrame, entity: str, time: str, anchor: str, gap_ms: int, floor: float = 1.0) -> DataFrame:
    """merge: whether a row continues the one before, by a score of equal anchor (1.0) and nearness in time (0.5)."""
    d = df.withColumn("_ts", F.timestamp_millis(F.col(time)))
    d = lagged(d, entity, "_ts", ["_ts", anchor], {"_t": (time, 1), "_a": (anchor, 1)})
    near = (F.col(time) - F.col("_t") <= gap_ms).cast("double") * 0.5
    same = (F.col(anchor) == F.col("_a")).cast("double")
    return d.withColumn("score", F.coalesce(near + same, F.lit(0.0))).withColumn("merge", F.col("score") >= floor).drop("_ts", "_t", "_a")
