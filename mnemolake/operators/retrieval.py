"""Composition of retrieval: routes, fusion, adjustments, gate, diversity, verdict and context packs.

Constants that are not given elsewhere are parameters; their defaults are ours.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.operators.vectors import rrf

# ours
HALF_LIFE_MS = 30 * 86_400_000
COVERAGE_FLOOR = 0.3
BACKERS = 2
_UNITS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 7 * 86_400_000}


def time_window(value, now_ms: int) -> tuple[int | None, int | None]:
    """A shorthand ('24h', '7d'), a start in milliseconds, or {from, to}, as a range."""
    if value is None:
        return None, None
    if isinstance(value, dict):
        return value.get("from"), value.get("to")
    if isinstance(value, (int, float)):
        return int(value), None
    m = re.fullmatch(r"\s*(\d+)\s*([mhdw])\s*", str(value))
    if not m:
        raise ValueError(f"not a time window: {value!r}")
    return now_ms - int(m[1]) * _UNITS[m[2]], now_ms


def in_window(column: Column, window: tuple[int | None, int | None]) -> Column:
    lo, hi = window
    out = F.lit(True)
    if lo is not None:
        out = out & (column >= lo)
    if hi is not None:
        out = out & (column <= hi)
    return out


def plan(query: str, now_ms: int, sources: list[str] | None = None) -> dict:
    """Intent, time window and filters of a query text."""
    m = re.search(r"\b(?:last|past)\s+(\d+)\s*(minute|hour|day|week)s?\b", query, re.I)
    window = time_window(f"{m[1]}{m[2][0].lower()}", now_ms) if m else (None, None)
    low = query.lower()
    intent = "recall" if re.search(r"\b(decided|decision|todo|blocker|error)s?\b", low) else "timeline" if re.search(r"\bwhen\b|\btimeline\b", low) else "search"
    return {"intent": intent, "window": window, "sources": sources, "text": re.sub(r"\s+", " ", query.replace(m[0], "") if m else query).strip()}


def route(df: DataFrame, name: str, order: Column, id_col: str = "id", k: int = 50) -> DataFrame:
    """id, route, rank of the k best rows of a route."""
    top = df.select(F.col(id_col).alias("id"), order.alias("_o")).orderBy("_o", "id").limit(k)  # k rows: one small task
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_o", "id"))).select("id", F.lit(name).alias("route"), "rank")


def second_wave(fused: DataFrame, mentions: DataFrame, name: str = "graph") -> DataFrame:
    """Records that mention the same nodes as the hits of the first wave, by the number of shared nodes."""
    seeds = mentions.join(fused.select(F.col("id").alias("record_id")), "record_id").select("node_id").distinct()
    near = mentions.join(seeds, "node_id").groupBy(F.col("record_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return route(near, name, -F.col("n"))


def staleness(time: Column, now_ms: int, lexical: Column, half_life_ms: int = HALF_LIFE_MS) -> Column:
    """Multiplier that halves with age; hits of the lexical route are exempt."""
    age = F.greatest(F.lit(now_ms) - time, F.lit(0))
    return F.when(lexical, 1.0).otherwise(F.pow(F.lit(0.5), age / half_life_ms))


def alignment(full: Column, partial: Column) -> Column:
    """Source-alignment ladder (fixed values 1.0, 0.85, 0.45)."""
    return F.when(full, 1.0).when(partial, 0.85).otherwise(0.45)


def adjusted(df: DataFrame, base: str, features: dict[str, Column]) -> DataFrame:
    """Additive named adjustments; each stays visible in the struct `signals`."""
    d = df.withColumn("signals", F.struct(F.col(base).alias("fused"), *[c.alias(n) for n, c in features.items()]))
    total = F.col("signals.fused")
    for n in features:
        total = total + F.col(f"signals.{n}")
    return d.withColumn("score", total)


def relevance_gate(df: DataFrame, matched: str, wanted: str, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """coverage and passed: the share of query terms that a hit has."""
    cov = F.when(F.col(wanted) == 0, 0.0).otherwise(F.col(matched) / F.greatest(F.col(wanted), F.lit(1)))
    return df.withColumn("coverage", cov).withColumn("passed", cov >= floor)


def diversify(df: DataFrame, score: str, key: str, *facets: str, keep: int = 3, partition: str | None = None) -> DataFrame:
    """The first `keep` hits stay; after them hits of new facets (app, source, time bucket) come before repeats."""
    by = [partition] if partition else []
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    d = df.withColumn("_r", F.row_number().over(w))
    f = Window.partitionBy(*by, *facets).orderBy("_r")
    d = d.withColumn("_n", F.row_number().over(f))
    o = Window.partitionBy(*by).orderBy(F.when(F.col("_r") <= keep, F.struct(F.lit(0).alias("a"), F.col("_r").alias("b"))).otherwise(F.struct(F.col("_n").alias("a"), F.col("_r").alias("b"))))
    return d.withColumn("place", F.row_number().over(o)).drop("_r", "_n")


def verdicts(claims: DataFrame, claim: str = "claim_id", record: str = "record_id", backers: int = BACKERS) -> DataFrame:
    """Per claim the number of different records that back it, and a verdict of three states."""
    c = claims.groupBy(claim).agg(F.countDistinct(record).alias("backers"))
    v = F.when(F.col("backers") >= backers, "Grounded").when(F.col("backers") > 0, "PartialAnswer").otherwise("NotEnoughEvidence")
    return c.withColumn("verdict", v)


def grounded_claims(claims: DataFrame, chunks: DataFrame, floor: float = 0.6) -> DataFrame:
    """claim_id, record_id: chunks that hold at least a share of the words of a claim (an equi-join on words)."""
    from mnemolake.operators.search import tokens

    c = claims.select("claim_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    size = c.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    t = chunks.select(F.col("id").alias("chunk_id"), "record_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    t = t.join(c.select("w").distinct(), "w", "left_semi")
    hit = c.join(t, "w").groupBy("claim_id", "chunk_id", "record_id").agg(F.count(F.lit(1)).alias("m")).join(size, "claim_id")
    backed = hit.filter(F.col("m") >= floor * F.col("n")).select("claim_id", "record_id").distinct()
    return claims.select("claim_id").join(backed, "claim_id", "left")


def surfacing_reason(**signals: Column) -> Column:
    """Names of the active signals, joined."""
    return F.concat_ws(", ", *[F.when(c, F.lit(n)) for n, c in signals.items()])


def roll_up(hits: DataFrame, record: str = "record_id", chunk: str = "id", score: str = "score") -> DataFrame:
    """Chunk hits as records: best chunk, best score, number of chunks."""
    return hits.groupBy(record).agg(F.max_by(chunk, F.struct(F.col(score), F.col(chunk))).alias("best_chunk"), F.max(score).alias("score"), F.count(F.lit(1)).alias("chunks"))


def context_pack(hits: DataFrame, rank: str, tokens: str, budget: int, partition: str | None = None) -> DataFrame:
    """Hits by rank while the running number of tokens is within the budget, with citation numbers."""
    w = Window.partitionBy(*([partition] if partition else [])).orderBy(rank)
    d = hits.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget)
    return d.withColumn("citation", F.row_number().over(w))


def explain(df: DataFrame, **gates: Column) -> DataFrame:
    """All candidates with the first gate that drops them, instead of a filter."""
    why = None
    for name, passed in gates.items():
        why = (F if why is None else why).when(~passed, name)
    return df.withColumn("dropped_by", why)


def hybrid(keyword: DataFrame, vector: DataFrame, k: int = 10, constant: int = X.RRF_K) -> DataFrame:
    """Two ranked routes (id, rank) fused: id, score, routes of the k best."""
    both = keyword.select("id", "rank", F.lit("keyword").alias("route")).unionByName(vector.select("id", "rank", F.lit("vector").alias("route")))
    return rrf(both, "id", constant).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def rerank(hits: DataFrame, score: str, model=None, text: str = "text", k: int = 50, key: str = "id") -> DataFrame:
    """The k best hits in the order of a model (a function of a series of texts); without a model nothing changes.

    Equal values of the model keep the order of the score, equal scores that of the key."""
    top = hits.orderBy(F.desc(score), key).limit(k)
    if model is None:
        return top

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s), dtype="float64")

    return top.withColumn("model_score", run(F.col(text))).orderBy(F.desc("model_score"), F.desc(score), key)


def recall_kind(ledger: DataFrame, tasks: DataFrame, kind: str) -> DataFrame:
    """decisions, todos, errors or blockers, as kind, at_ms, text, record_id."""
    d = ledger.select(F.lit("decisions").alias("kind"), F.col("decided_at_ms").alias("at_ms"), F.col("statement").alias("text"), "record_id")
    t = tasks.filter("status = 0").select(F.lit("todos").alias("kind"), F.col("due_at_ms").alias("at_ms"), F.col("title").alias("text"), F.col("source_record_id").alias("record_id"))
    if kind in ("errors", "blockers"):
        word = kind[:-1]
        return d.unionByName(t).filter(F.lower("text").contains(word)).withColumn("kind", F.lit(kind))
    return d.unionByName(t).filter(F.col("kind") == kind)


def embedding_document(app: Column, title: Column, evidence: Column) -> Column:
    """The one text that is embedded for a record, at capture and at review alike."""
    return F.concat_ws("\n", F.nullif(F.coalesce(app, F.lit("")), F.lit("")), F.nullif(F.coalesce(title, F.lit("")), F.lit("")), evidence)


def chunk_lines(df: DataFrame, key: str, text: str, max_bytes: int = 1500) -> DataFrame:
    """record_id, ord, span_start, span_end (bytes), text: whole lines up to a size; text equals source[span] always."""

    def step(acc: Column, line: Column) -> Column:
        n = F.octet_length(line)
        fits = (acc["size"] + n <= max_bytes) | (acc["size"] == 0)
        done = F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"].alias("s"), (acc["start"] + acc["size"]).alias("e"), acc["buf"].alias("t")))))
        return F.struct(
            done.alias("out"), F.when(fits, acc["start"]).otherwise(acc["start"] + acc["size"]).alias("start"),
            F.when(fits, acc["size"] + n).otherwise(n).alias("size"), F.when(fits, F.concat(acc["buf"], line)).otherwise(line).alias("buf"),
        )

    kind = "struct<out:array<struct<s:int,e:int,t:string>>,start:int,size:int,buf:string>"
    start = F.struct(F.array().alias("out"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("buf")).cast(kind)
    end = lambda a: F.when(a["size"] > 0, F.concat(a["out"], F.array(F.struct(a["start"].alias("s"), (a["start"] + a["size"]).alias("e"), a["buf"].alias("t"))))).otherwise(a["out"])
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=\n)", -1), lambda x: x != "")
    d = df.select(F.col(key).alias("record_id"), F.posexplode(F.aggregate(lines, start, lambda a, x: step(a, x).cast(kind), end)).alias("ord", "x"))
    return d.select("record_id", F.col("ord").cast("bigint").alias("ord"), F.col("x.s").cast("bigint").alias("span_start"), F.col("x.e").cast("bigint").alias("span_end"), F.col("x.t").alias("text"))
