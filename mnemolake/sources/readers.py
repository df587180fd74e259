"""Readers and writers at the edges: line-wise JSON, images, reports, checksums."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake import schemas


class LineError(ValueError):
    """A line of a file that is not a record; carries file and line number (from 1)."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a line-wise JSON file; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), text of the lines that are not records.

    Lines are numbered within each split of a file by the tasks that read it; what the splits before hold is one row per split."""
    at = ["file", "start"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    splits = raw.groupBy(*at).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(*at, "first", F.coalesce(before, F.lit(0)).alias("before"))
    parsed = raw.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    key = schema.split()[0]
    bad = parsed.filter((F.trim("value") != "") & (F.col("r").isNull() | F.col(f"r.{key}").isNull()))
    return bad.join(splits, at).select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def load_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """records and queries of an evaluation corpus; it is an error if either is empty."""
    out = []
    for name, schema in (("records", schemas.CORPUS_RECORDS), ("queries", schemas.CORPUS_QUERIES)):
        path = f"{folder}/{name}.jsonl"
        df = read_jsonl(spark, path, schema)
        if df.isEmpty():
            raise ValueError(f"{path} has no rows")
        out.append(df)
    return out[0], out[1].withColumn("qid", F.xxhash64("query"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Image files as frames: captured_at_ms, png; empty files are typed as such."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.unix_millis("modificationTime").alias("captured_at_ms"), F.col("content").alias("png"), F.when(F.col("length") == 0, "EmptyFrame").alias("error"))


def write_report(report: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=2)


def artifact_status(spark: SparkSession, folder: str, registry: DataFrame) -> DataFrame:
    """Registry (id, file, size_bytes, sha256) with state: missing, wrong_size, wrong_sum or ok."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length"), F.sha2("content", 256).alias("sum"))
    j = registry.join(files, "file", "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size_bytes"), "wrong_size").when(F.lower("sum") != F.lower("sha256"), "wrong_sum").otherwise("ok")
    return j.select("id", "file", "size_bytes", state.alias("state"))


def bytes_needed(status: DataFrame, ids: list[str]) -> int:
    """Sum of the sizes of wanted artifacts that are missing or wrongly sized; unknown ids need nothing."""
    r = status.filter(F.col("id").isin(ids) & F.col("state").isin("missing", "wrong_size")).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    return int(r[0])


def synthetic_rows(spark: SparkSession, n: int, dim: int = 768, topics: int = 10) -> DataFrame:
    """Rows of a scale probe: id, source, captured_at_ms, text, vector; every value follows from the id."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.col("id"), i), F.lit(2_000_001)) / 1_000_000.0 - 1.0).cast("float"))
    topic = F.concat(F.lit("topic"), F.pmod("id", F.lit(topics)).cast("string"))
    return spark.range(n).select(
        "id", F.when(F.col("id") % 5 == 0, "meeting").otherwise("screen").alias("source"), (F.col("id") * 1000 + 1_755_000_000_000).alias("captured_at_ms"),
        F.concat(topic, F.lit(" notes continued in window rec"), F.col("id").cast("string"), F.lit(" with more detail")).alias("text"), vector.alias("vector"),
    )


def write_digest(df: DataFrame, path: str, *by: str) -> None:
    """One folder of text per project: line by line, for export."""
    df.select(*by, F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


# importers of what other programs keep: id, source, captured_at_ms, title, text

IMPORTED = "id string, source string, captured_at_ms bigint, title string, text string"


def import_shell_history(spark: SparkSession, path: str) -> DataFrame:
    """Commands of a shell: plain lines, lines after `#seconds`, or `: seconds:duration;command`; unknown times are 0."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, raw in zip(pdf["path"], pdf["content"]):
                at = 0
                for n, line in enumerate(raw.decode("utf-8", "replace").split("\n"), 1):
                    if m := re.fullmatch(r"#(\d{9,12})", line):
                        at = int(m[1]) * 1000
                        continue
                    if m := re.match(r": (\d{9,12}):\d+;(.*)", line):
                        at, line = int(m[1]) * 1000, m[2]
                    if line.strip():
                        rows.append((f"{file}#{n}", "shell", at, line.split()[0], line))
                    at = 0
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMPORTED.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, IMPORTED)


def import_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of the output of `git log --format=raw` or the default format with dates in seconds (--date=unix)."""
    t = spark.read.text(path, lineSep="\ncommit ").select(F.regexp_replace("value", r"^commit ", "").alias("c"))
    body = F.trim(F.regexp_replace(F.regexp_extract("c", r"(?s)\n\n(.*)\z", 1), r"(?m)^ {4}", ""))
    seconds = F.regexp_extract("c", r"(?m)^(?:committer .*> |author .*> |Date:\s+)(\d{9,12})", 1)
    return t.filter(F.col("c").rlike(r"^[0-9a-f]{7,64}")).select(
        F.regexp_extract("c", r"^([0-9a-f]+)", 1).alias("id"), F.lit("git").alias("source"), (F.coalesce(seconds.try_cast("bigint"), F.lit(0)) * 1000).alias("captured_at_ms"),
        F.split(body, "\n")[0].alias("title"), body.alias("text"),
    )


def import_browser_history(spark: SparkSession, path: str) -> DataFrame:
    """Visits of history databases: tables urls and visits (microseconds since 1601), or moz_places and moz_historyvisits (since 1970)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(raw))
                names = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                if {"urls", "visits"} <= names:
                    q, off = "SELECT v.id, v.visit_time, u.title, u.url FROM visits v JOIN urls u ON u.id = v.url", 11_644_473_600_000
                elif {"moz_places", "moz_historyvisits"} <= names:
                    q, off = "SELECT v.id, v.visit_date, p.title, p.url FROM moz_historyvisits v JOIN moz_places p ON p.id = v.place_id", 0
                else:
                    raise LineError(f"{file} is no history database")
                rows = [(f"{file}#{i}", "browser", t // 1000 - off if t else 0, title or "", url) for i, t, title, url in db.execute(q)]
                db.close()
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMPORTED.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, IMPORTED)
