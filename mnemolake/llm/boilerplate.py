"""Lines that come back in many texts of one group (source), and the texts without them.

Copies are collapsed first: a text stands in the cluster as its digest, is moved once whatever the number of its rows, and
is split into lines once for each group that has it.  So a republished text counts once however often it was captured.
Then every line is counted over distinct clusters and over the distinct dates on which its clusters were first captured.
A line is removed from MIN_TEXTS clusters and MIN_DAYS dates on (one date by default, as all that is asked for is
different texts; a greater number spares what one day repeats).  Two lines are the same if equal without white space,
decimal digits and letter case.

All counting is in the JVM.  The lines of a cluster are put together where its text lies, a line of a hot group is counted
in every task before the shuffle, and finding the clusters of a line again is a salted join, so neither a source nor a
line nor a text with a third of all rows meets in one task.

Null and empty texts have no lines to remove and come out as they are; rows repeated under one id count once; groups
that are null (or whose app is null or empty) take no part; unknown dates (null or 0) count as no date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, once_per_id

MIN_TEXTS, MIN_DAYS = 8, 1
MIN_LETTERS = 8
SALTS = 16
DAY_MS = 86_400_000


def line_key(line: Column) -> Column:
    """A line without white space, decimal digits and letter case."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(line), "ß", "ss"), "ς", "σ")
    return F.regexp_replace(folded, r"(?U)[\p{IsWhite_Space}\p{Nd}]+", "")


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64("text", F.lit(7))})


def _day() -> Column:
    return F.when(F.col("captured_at_ms") > 0, F.floor(F.col("captured_at_ms") / DAY_MS)).alias("day")


def corpus_texts(corpus: DataFrame, *more: str) -> DataFrame:
    """origin, row_key, source, app, day, takes_part, d1 and d2 (digest of the text) of the corpus; the group is the source."""
    c = once_per_id(_digest(corpus), "id", "source", "captured_at_ms", "d1", "d2", *more)
    return c.select(
        F.lit("corpus_records").alias("origin"), F.col("id").cast("string").alias("row_key"), "source", F.lit("").alias("app"), _day(),
        (F.col("source") != "").alias("takes_part"), "d1", "d2", *more,
    )


def chunk_texts(chunks: DataFrame, records: DataFrame, *more: str) -> DataFrame:
    """The same of pending chunks; the group is the source with the app of the record, without case and outer spaces."""
    p = once_per_id(_digest(chunks), "chunk_id", "record_id", "source", "captured_at_ms", "d1", "d2", *more)
    app = F.lower(F.regexp_replace(F.col("app_name"), r"(?U)^\s+|\s+$", ""))
    wanted = chunks.select(F.col("record_id").alias("id")).distinct()
    r = once_per_id(records.select("id", "app_name").join(wanted, "id", "left_semi"), "id", "app_name").select(F.col("id").alias("record_id"), app.alias("app"))
    p = p.join(r, "record_id", "left")
    return p.select(
        F.lit("pending_chunks").alias("origin"), F.col("chunk_id").alias("row_key"), "source", "app", _day(),
        (F.coalesce(F.col("source"), F.lit("")) != "") & (F.coalesce(F.col("app"), F.lit("")) != ""), "d1", "d2", *more,
    ).toDF("origin", "row_key", "source", "app", "day", "takes_part", "d1", "d2", *more)


def bodies(*tables: DataFrame) -> DataFrame:
    """d1, d2, text: every distinct text once."""
    one = [_digest(t.select("text").filter(F.col("text") != "")).select("d1", "d2", "text") for t in tables]
    both = one[0]
    for t in one[1:]:
        both = both.unionByName(t)
    return both.groupBy("d1", "d2").agg(F.first("text").alias("text"))


def _lines(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per cluster and distinct line: origin, source, app, d1, d2, lk (128 bits of the line within its group), at (line numbers), day."""
    group = ["origin", "source", "app"]
    clusters = rows.filter("takes_part").groupBy(*group, "d1", "d2").agg(F.min("day").alias("day"))
    t = texts.join(clusters, ["d1", "d2"]).select(*group, "d1", "d2", "day", F.posexplode(F.split("text", "\n", -1)).alias("_i", "_line"))
    t = t.withColumn("_k", line_key(F.col("_line"))).filter(F.length(F.regexp_replace("_k", r"\P{L}+", "")) >= MIN_LETTERS)
    lk = F.struct(F.xxhash64(*group, "_k").alias("a"), F.xxhash64("_k", F.lit(7), *group[::-1]).alias("b"))
    return t.withColumn("lk", lk).groupBy("d1", "d2", *group, "day", "lk").agg(F.collect_list((F.col("_i") + 1).cast("bigint")).alias("at"))


def repeated_lines(rows: DataFrame, texts: DataFrame, min_texts: int = MIN_TEXTS, min_days: int = MIN_DAYS) -> DataFrame:
    """origin, row_key, line_no, n_texts, n_days of the lines to remove."""
    rows = materialize(rows.select("origin", "row_key", "source", "app", "day", "takes_part", "d1", "d2"))
    lines = materialize(_lines(rows, texts))
    by_day = lines.groupBy("lk", "day").agg(F.count(F.lit(1)).alias("n"))
    common = by_day.groupBy("lk").agg(F.sum("n").alias("n_texts"), F.count("day").alias("n_days")).filter((F.col("n_texts") >= min_texts) & ((F.col("n_days") >= min_days) | (F.lit(min_days) <= 1)))
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    group = ["origin", "source", "app", "d1", "d2"]
    gone = lines.select(*group, "lk", "at", F.pmod(F.xxhash64("d1", "d2"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["lk", "salt"])
    gone = gone.groupBy(*group).agg(F.collect_list(F.struct("at", "n_texts", "n_days")).alias("gone"))
    found = rows.filter("takes_part").select("row_key", *group).join(gone, group).select("origin", "row_key", F.explode("gone").alias("x"))
    return found.select("origin", "row_key", F.explode("x.at").alias("line_no"), "x.n_texts", "x.n_days")


def without_lines(texts: DataFrame, found: DataFrame) -> DataFrame:
    """origin, row_key, text, n_removed: every text without its found lines."""
    gone = found.groupBy("origin", "row_key").agg(F.collect_set("line_no").alias("_gone"))
    t = texts.select("origin", "row_key", "text").join(gone, ["origin", "row_key"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("bigint")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return t.select("origin", "row_key", text.alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))
