"""Schemas of the tables of the store; never inferred.  Times are epoch milliseconds, '' and 0 mean missing and not yet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X

TABLES = {
    "memory_records": "id string, session_id string, source string, app_name string, window_title string, captured_at_ms bigint, created_at_ms bigint, lifecycle bigint, reviewed_at_ms bigint, reviewer_generation bigint",
    "memory_texts": "record_id string, raw_text string, cleaned_text string, summary string, embedding_text string, updated_at_ms bigint",
    "memory_scores": "record_id string, name string, value double",
    "chunks": "id string, record_id string, ord bigint, text string, span_start bigint, span_end bigint",
    "flush_log": "id string, flushed_at_ms bigint, epoch bigint",
    "graph_nodes": "id string, kind string, name string, created_at_ms bigint",
    "graph_edges": "src string, dst string, kind string, weight double",
    "node_mentions": "node_id string, record_id string",
    "entity_aliases": "node_id string, alias string",
    "tasks": "id string, title string, status bigint, source_record_id string, due_at_ms bigint",
    "meetings": "id string, title string, started_at_ms bigint, ended_at_ms bigint",
    "meeting_segments": "id bigint, meeting_id string, started_at_ms bigint, ended_at_ms bigint, speaker string, text string",
    "decision_ledger": "id bigint, decided_at_ms bigint, statement string, record_id string",
    "review_queue": "record_id string, enqueued_at_ms bigint, attempts bigint, next_attempt_at_ms bigint",
    "settings": "key string, value string",
    "devices": "id string, name string, paired_at_ms bigint",
    "tokens": "token_hash string, device_id string, created_at_ms bigint",
}
CORPUS_RECORDS = "id bigint, source string, captured_at_ms bigint, text string"
CORPUS_QUERIES = "query string, relevant array<bigint>"
OCR_LINES = "frame_id bigint, lines array<struct<text:string,confidence:float>>"


def index_schema(dim: int = X.EMBEDDING_DIM) -> str:
    return "id string, record_id string, ord bigint, text string, source string, captured_at_ms bigint, vector array<float>"


@dataclass(frozen=True)
class EmbeddingSpec:
    """Model and dimension name the table: another model is another table."""

    model: str = X.EMBEDDING_MODEL
    dim: int = X.EMBEDDING_DIM
    version: int = 1

    @property
    def table(self) -> str:
        return f"chunks_v{self.version}_{self.model}"


def _decode(value: Column, names: dict[int, str], kind: str) -> Column:
    out = None
    for k, name in names.items():
        out = (F if out is None else out).when(value == k, name)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind} discriminant: "), F.coalesce(value.cast("string"), F.lit("null")))))


def lifecycle_name(value: Column) -> Column:
    return _decode(value, X.LIFECYCLE, "ReviewLifecycle")


def task_status_name(value: Column) -> Column:
    return _decode(value, X.TASK_STATUS, "TaskStatus")


def lifecycle_code(name: Column) -> Column:
    out = None
    for k, n in X.LIFECYCLE.items():
        out = (F if out is None else out).when(name == n, F.lit(k))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown ReviewLifecycle name: "), F.coalesce(name, F.lit("null"))))).cast("bigint")
