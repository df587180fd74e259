"""Measures of retrieval quality and the gate against a baseline."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.operators.search import Index, search_many


def recall_at(ranked: Column, relevant: Column, k: int = X.RECALL_AT) -> Column:
    """Share of the relevant ids within the first k; none relevant gives 0; repeated relevant ids count."""
    top = F.slice(ranked, 1, k)
    return F.when(F.size(relevant) == 0, 0.0).otherwise(F.size(F.filter(relevant, lambda r: F.array_contains(top, r))) / F.greatest(F.size(relevant), F.lit(1)))


def reciprocal_rank_at(ranked: Column, relevant: Column, k: int = X.MRR_AT) -> Column:
    """1 / place of the first relevant id within the first k, else 0."""
    places = F.filter(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) == 0, 0.0).otherwise(1.0 / F.greatest(F.coalesce(F.array_min(places), F.lit(1)), F.lit(1)))


def percentile(values: Column, p: float) -> Column:
    """Of an array: the sorted value at round((n - 1) * p), half up; empty gives 0."""
    at = F.floor((F.size(values) - 1) * F.lit(float(p)) + 0.5).cast("int")
    return F.when(F.size(values) == 0, 0.0).otherwise(F.get(F.array_sort(values), F.greatest(at, F.lit(0))))


def exact_percentile(df: DataFrame, value: str, p: float, *groups: str) -> DataFrame:
    """The same over rows of groups of any size: counts per distinct value instead of one array per group."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy(value)
    c = c.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*groups)))
    at = F.floor((F.col("_all") - 1) * F.lit(float(p)) + 0.5)
    return c.filter((F.col("_to") > at) & (F.col("_to") - F.col("_n") <= at)).select(*groups, F.col(value).alias("percentile"))


def run_baseline(index: Index, queries: DataFrame, mode: str = "and") -> DataFrame:
    """qid, query, ranked, hits, recall, rr of every query (qid, query, relevant), answered by one join."""
    found = search_many(index, queries, X.MRR_AT, mode).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank_no", "doc"))).alias("r"))
    q = queries.join(found, "qid", "left").withColumn("ranked", F.coalesce(F.transform("r", lambda x: x["doc"]), F.array().cast("array<bigint>"))).drop("r")
    return q.withColumn("hits", F.size("ranked")).withColumn("recall", recall_at(F.col("ranked"), F.col("relevant"))).withColumn("rr", reciprocal_rank_at(F.col("ranked"), F.col("relevant")))


def report(per_query: DataFrame, latencies_ms: list[float] | None = None) -> dict:
    r = per_query.agg(F.count(F.lit(1)), F.avg("recall"), F.avg("rr")).first()
    lat = sorted(latencies_ms or [])
    pick = lambda p: lat[int((len(lat) - 1) * p + 0.5)] if lat else 0.0
    return {"queries": r[0], "recall_at_5": r[1] or 0.0, "mrr_at_10": r[2] or 0.0, "latency_p50_ms": pick(0.5), "latency_p95_ms": pick(0.95)}


def regressions(new: dict, old: dict) -> list[str]:
    """Measures that fell by more than the epsilon; latency is never compared."""
    return [f"{k}: {old[k]} -> {new[k]}" for k in ("recall_at_5", "mrr_at_10") if new[k] + X.GATE_EPSILON < old[k]]


def gate(new: dict, baseline_path: str | None) -> int:
    """0 fine, 1 regression or unreadable baseline."""
    if baseline_path is None:
        return 0
    try:
        with open(baseline_path) as f:
            return 1 if regressions(new, json.load(f)) else 0
    except (OSError, ValueError, KeyError):
        return 1


def verdict_accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, item: str, rater: str, rating: str) -> DataFrame:
    """Share of rater pairs that agree on an item, from counts per rating (no pairs are built)."""
    c = df.groupBy(item, rating).agg(F.countDistinct(rater).alias("c")).groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return c.filter("n > 1").agg((F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias("agreement"), F.count(F.lit(1)).alias("items"))


def ablation(a: DataFrame, b: DataFrame, key: str = "qid", measure: str = "recall") -> DataFrame:
    """Per query the measure under two routes and the difference."""
    j = a.select(key, F.col(measure).alias("a")).join(b.select(key, F.col(measure).alias("b")), key)
    return j.withColumn("delta", F.col("b") - F.col("a"))


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """Append-only feedback (query, record_id, useful) as labelled pairs; ranking is not touched."""
    return feedback.groupBy("query", "record_id").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.col("useful").cast("bigint")).alias("useful"))


def scale_probe(spark, path: str, rows: int, questions: int = 20) -> dict:
    """Latencies in milliseconds of keyword and exact vector questions over generated rows: index seconds, p50 and p95 of each."""
    import time

    from mnemolake.operators import search, vectors
    from mnemolake.sources.readers import synthetic_rows

    synthetic_rows(spark, rows, 64).write.mode("overwrite").parquet(f"{path}/rows")
    df = spark.read.parquet(f"{path}/rows")
    began = time.perf_counter()
    index = search.store_index(search.build_index(df, "id", "text"), f"{path}/index")
    out = {"rows": rows, "index_s": round(time.perf_counter() - began, 3)}
    probe = df.filter("id = 1").select("vector").first()[0]
    for name, ask in (
        ("keyword", lambda i: search.ranked(index, f"topic{i % 10} rec{i}").orderBy("rank", "doc").limit(10).collect()),
        ("vector", lambda i: vectors.knn(df, "id", "vector", [x + i / 1000 for x in probe]).collect()),
    ):
        took = []
        for i in range(questions):
            began = time.perf_counter()
            ask(i)
            took.append((time.perf_counter() - began) * 1000)
        took.sort()
        out |= {f"{name}_p{p}_ms": round(took[int((questions - 1) * p / 100 + 0.5)], 2) for p in (50, 95)}
    return out
