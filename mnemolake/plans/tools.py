"""The sixteen questions that agents ask, each one parameterised plan over the tables of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import activity, graph, retrieval, search


def find(records: DataFrame, index: search.Index, query: str, now_ms: int, limit: int | None = None, window=None, app: str | None = None) -> DataFrame:
    """search: hits with a reason and a snippet."""
    d = records.filter(retrieval.in_window(F.col("captured_at_ms"), retrieval.time_window(window, now_ms)))
    d = d if app is None else d.filter(F.lower("app_name") == app.lower())
    hits = search.search(index, d, "id", query, limit)
    return search.serving(search.with_snippets(hits, "text", query)).withColumn("reason", F.lit("keyword"))


def context_pack(hits: DataFrame, token_budget: int) -> DataFrame:
    """Hits with citations within a budget; tokens are counted as words."""
    d = hits.withColumn("tokens", F.size(search.tokens(F.col("text"))))
    return retrieval.context_pack(d, "rank", "tokens", token_budget)


def delta(records: DataFrame, since_ms: int) -> DataFrame:
    return activity.delta_since(records, "created_at_ms", since_ms)


def timeline(records: DataFrame, granularity: str) -> DataFrame:
    """Groups by hour, day, app, session or project (source)."""
    d = records.withColumn("ts", F.timestamp_millis("captured_at_ms"))
    if granularity in ("hour", "day"):
        return activity.timeline(d, "ts", granularity)
    by = {"app": "app_name", "session": "session_id", "project": "source"}[granularity]
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def active_focus(records: DataFrame, window_s: int = 3600) -> DataFrame:
    d = records.filter("captured_at_ms > 0").withColumn("ts", F.timestamp_millis("captured_at_ms"))
    return activity.active_focus(d, "session_id", "ts", "app_name", window_s)


def project_context(records: DataFrame, tasks: DataFrame, ledger: DataFrame, project: Column) -> DataFrame:
    """kind, at_ms, text of a project: captures by app, open tasks, decisions."""
    r = records.filter(project)
    ids = r.select(F.col("id").alias("record_id")).distinct()
    out = r.groupBy("app_name").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at_ms").alias("at_ms"))
    out = out.select(F.lit("activity").alias("kind"), "at_ms", F.concat_ws(": ", "app_name", F.col("n").cast("string")).alias("text"))
    for kind in ("todos", "decisions"):
        out = out.unionByName(retrieval.recall_kind(ledger, tasks, kind).join(ids, "record_id", "left_semi").select("kind", "at_ms", "text"))
    return out


def source_evidence(records: DataFrame, texts: DataFrame, ids: list[str], include_raw: bool = False) -> DataFrame:
    t = texts if include_raw else texts.drop("raw_text")
    return records.filter(F.col("id").isin(ids)).join(t.withColumnRenamed("record_id", "id"), "id", "left")


def graph_context(edges: DataFrame, node, hops: int = 2, per_hop: int = 10) -> DataFrame:
    seeds = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    return graph.neighbourhood(edges, seeds, hops, per_hop)


def open_target(records: DataFrame, record_id: str) -> DataFrame:
    """The address, file or app that a record can be reopened with."""
    t = F.coalesce("window_title", F.lit(""))
    url, path = F.regexp_extract(t, r"(https?://\S+)", 1), F.regexp_extract(t, r"((?:~|/)?[\w.\-]+(?:/[\w.\-]+)+|\b[\w\-]+\.\w{1,4}\b)", 1)
    kind = F.when(url != "", "url").when(path != "", "file").otherwise("app")
    return records.filter(F.col("id") == record_id).select("id", kind.alias("kind"), F.when(url != "", url).when(path != "", path).otherwise(F.col("app_name")).alias("target"))


def explain_retrieval(candidates: DataFrame, **gates: Column) -> DataFrame:
    return retrieval.explain(candidates, **gates)


def feedback(log: DataFrame) -> DataFrame:
    from mnemolake.operators.evaluate import feedback_labels

    return feedback_labels(log)


def privacy_status(records: DataFrame, apps: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: captures, blocked apps and domains."""
    n = records.groupBy().agg(F.count(F.lit(1)).alias("captures"))
    a = apps.groupBy().agg(F.count(F.lit(1)).alias("blocked_apps"))
    d = domains.groupBy().agg(F.count(F.lit(1)).alias("blocked_domains"))
    return n.withColumn("_k", F.lit(0)).join(a.withColumn("_k", F.lit(0)), "_k").join(d.withColumn("_k", F.lit(0)), "_k").drop("_k")


def answer(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per claim the backing records and a verdict of three states."""
    return retrieval.verdicts(retrieval.grounded_claims(claims, chunks))


def session_story(records: DataFrame, gap_s: int = 1800) -> DataFrame:
    d = records.filter("captured_at_ms > 0 and session_id <> ''").select("session_id", "id", "window_title", F.timestamp_millis("captured_at_ms").alias("ts"))
    return activity.story(activity.gap_sessions(d, "session_id", "ts", gap_s), "session_id", "session", "ts", "window_title")


def insight(app: Column, title: Column, text: Column) -> Column:
    """Complete record without a model: kept text, evidence, snippet, noise, document to embed."""
    kept = T.high_signal(app, text)

    def of(h: Column) -> Column:
        evidence = T.bind(T.salient_spans(app, h["text"]), lambda s: T.compress_evidence(s, h["text"], 320))
        return F.struct(
            h["text"].alias("cleaned_text"), T.fallback_snippet(app, title, text).alias("summary"), T.noise_score(app, text).alias("noise"),
            retrieval.embedding_document(app, title, evidence).alias("embedding_text"),
        )

    return T.bind(kept, of)


def remember_decision(store, decided_at_ms: int, statement: str, record_id: str | None = None) -> None:
    """The only question that writes: append to the ledger."""
    n = store.table("decision_ledger").count()
    store.append("decision_ledger", store.spark.createDataFrame([(n + 1, decided_at_ms, statement, record_id)], "id bigint, decided_at_ms bigint, statement string, record_id string"))


TOOLS: dict[str, Callable] = {
    "search": find, "context_pack": context_pack, "delta": delta, "timeline": timeline, "active_focus": active_focus, "project_context": project_context,
    "recall": retrieval.recall_kind, "source_evidence": source_evidence, "graph_context": graph_context, "open_target": open_target,
    "explain_retrieval": explain_retrieval, "feedback": feedback, "privacy_status": privacy_status, "remember_decision": remember_decision, "answer": answer,
    "session_story": session_story,
}
