"""Named queries that run the store itself: capture, flush, crash, rebuild, deletion, retention, backup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.plans.catalog import query
from mnemolake.session import stored_path, table
from mnemolake.sources.store import SineEmbedder, Store

_C = "c AS (SELECT DISTINCT id, record_id, ord, text FROM record_chunks), r AS (SELECT DISTINCT id, source, captured_at_ms FROM memory_records)"
_V = _C + ", v AS (SELECT c.id, c.record_id, c.ord, c.text, r.source, r.captured_at_ms FROM c JOIN r ON r.id = c.record_id)"


def _store(spark, d) -> Store:
    """A store of all records and their chunks, in the shared folder."""
    s = Store(spark, stored_path(spark, "store-"))
    records = table(spark, d, "memory_records").select("id", "source", "captured_at_ms").distinct()
    s.insert_captures(records, table(spark, d, "record_chunks").select("id", "record_id", "ord", "text").distinct())
    return s


def _counts(s: Store, *names: str) -> DataFrame:
    out = None
    for n in names:
        c = s.table(n).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("tab"), "kept")
        out = c if out is None else out.unionByName(c)
    return out


@query(f"WITH {_V} SELECT id, record_id, ord, source, captured_at_ms FROM v WHERE id NOT IN (SELECT id FROM chunk_index) ORDER BY captured_at_ms NULLS FIRST, ord, id LIMIT 256")
def pending_chunks(spark, d):
    s = _store(spark, d)
    s.mark_flushed(table(spark, d, "chunk_index").select("id").distinct())
    return s.pending_chunks(X.FLUSH_BATCH).select("id", "record_id", "ord", "source", "captured_at_ms")


@query(f"WITH {_V} SELECT id, record_id, ord, source, round(sin(strlen(coalesce(text, '')) + 1), 4) AS first, round(sin(strlen(coalesce(text, '')) + 8), 4) AS last FROM v")
def flush_index(spark, d):
    s, e = _store(spark, d), SineEmbedder(8)
    s.flush_once(e, None)
    return s.index(e.spec).select("id", "record_id", "ord", "source", F.round(F.get("vector", 0).cast("double"), 4).alias("first"), F.round(F.get("vector", 7).cast("double"), 4).alias("last"))


@query(f"WITH {_V}, n AS (SELECT count(*) AS n FROM v) SELECT least(n, 256) AS first_batch, n > 256 AS batch_was_full, greatest(n - 256, 0) AS left_over, 0 AS third FROM n")
def flush_batches(spark, d):
    s, e = _store(spark, d), SineEmbedder(4)
    first = s.flush_once(e, X.FLUSH_BATCH)
    rest = s.flush_once(e, None)
    third = s.flush_once(e, None)  # nothing is left: a flush that writes nothing
    return spark.createDataFrame([(first["written"], first["batch_was_full"], rest["written"], third["written"])], "first_batch bigint, batch_was_full boolean, left_over bigint, third bigint")


@query(f"WITH {_V}, n AS (SELECT count(*) AS n FROM v) SELECT 2 * n AS n_rows, n AS ids, 0 AS pending_before, n AS rebuilt, ceil(n / 256.0)::BIGINT AS batches, n AS n_rows_after FROM n")
def rebuild_converges(spark, d):
    """A flush that broke between append and stamp leaves rows twice; readers see them once and a rebuild removes them."""
    s, e = _store(spark, d), SineEmbedder(4)
    s.flush_once(e, None)
    s.append(e.spec.table, s.index(e.spec))
    rows, ids, pending = s.index(e.spec).count(), s.converged_index(e.spec).count(), s.pending_chunks(None).count()
    r = s.rebuild(e)
    return spark.createDataFrame(
        [(rows, ids, pending, r["chunks"], r["batches"], s.index(e.spec).count())], "n_rows bigint, ids bigint, pending_before bigint, rebuilt bigint, batches bigint, n_rows_after bigint"
    )


@query(f"WITH {_V} SELECT id FROM v UNION ALL SELECT id FROM v WHERE id NOT IN (SELECT id FROM chunk_index)")
def reset_flush_state(spark, d):
    s = _store(spark, d)
    s.mark_flushed(table(spark, d, "chunk_index").select("id").distinct())
    before = s.pending_chunks(None).select("id")
    s.reset_flush_state()
    return before.unionByName(s.pending_chunks(None).select("id"))


@query(
    f"""WITH {_V}, gone AS (SELECT id FROM r WHERE source = 'meeting') SELECT 'memory_records' AS tab, count(*) AS kept FROM r WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM c WHERE record_id IS NULL OR record_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'flush_log', count(*) FROM v WHERE record_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'index', count(*) FROM v WHERE record_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'tasks', count(*) FROM r
    UNION ALL SELECT 'tasks without record', count(*) FROM gone"""
)
def cascade_delete(spark, d):
    s, e = _store(spark, d), SineEmbedder(4)
    s.append("tasks", s.table("memory_records").select(F.concat(F.lit("t"), "id").alias("id"), F.lit("look").alias("title"), F.lit(0).alias("status"), F.col("id").alias("source_record_id")))
    s.flush_once(e, None)
    s.delete_where(F.col("source") == "meeting", (e.spec,))
    index = s.index(e.spec).agg(F.count(F.lit(1)).alias("kept")).select(F.lit("index").alias("tab"), "kept")
    tasks = s.table("tasks").agg(F.count_if(F.col("source_record_id").isNull()).alias("kept")).select(F.lit("tasks without record").alias("tab"), "kept")
    return _counts(s, "memory_records", "chunks", "flush_log", "tasks").unionByName(index).unionByName(tasks)


@query("SELECT id FROM (SELECT DISTINCT id, captured_at_ms FROM memory_records) WHERE captured_at_ms IS NULL OR captured_at_ms <= 0 OR captured_at_ms >= 1577919600000")
def retention(spark, d):
    s = _store(spark, d)
    s.retain_since(1_577_919_600_000)
    return s.table("memory_records").select("id")


@query(f"WITH {_C} SELECT 'memory_records' AS tab, count(*) AS kept FROM r UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'flush_log', 0")
def backup_restore(spark, d):
    s = _store(spark, d)
    copy = stored_path(spark, "backup-")
    s.backup(copy)
    other = Store(spark, stored_path(spark, "store-"))
    other.restore(copy)
    return _counts(other, "memory_records", "chunks", "flush_log")


@query(f"WITH {_C} SELECT 2 AS before, 1 AS after, 2 AS pruned, 2 * count(*) AS n_rows FROM c")
def compact_and_prune(spark, d):
    s = _store(spark, d)
    s.append("chunks", s.table("chunks"))
    before = len(s.batches("chunks"))
    s.compact("chunks")
    after, pruned = len(s.batches("chunks")), s.prune("chunks")
    return s.table("chunks").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(before).cast("bigint").alias("before"), F.lit(after).cast("bigint").alias("after"), F.lit(pruned).cast("bigint").alias("pruned"), "n_rows")


@query("SELECT count(DISTINCT id) AS n FROM memory_records")
def record_count(spark, d):
    return spark.createDataFrame([(_store(spark, d).record_count(),)], "n bigint")


@query("SELECT id, source, captured_at_ms FROM (SELECT DISTINCT id, source, captured_at_ms FROM memory_records) WHERE id = (SELECT max(id) FROM memory_records)")
def point_lookup(spark, d):
    s = _store(spark, d)
    last = s.table("memory_records").agg(F.max("id")).first()[0]
    return s.get("memory_records", last).select("id", "source", "captured_at_ms")


@query(
    """WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
    SELECT 'graph_edges' AS tab, count(*) AS kept FROM e WHERE src <> 'n3' AND dst <> 'n3' UNION ALL SELECT 'graph_nodes', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM region) - 1
    UNION ALL SELECT 'entity_aliases', count(*) - 1 FROM nation"""
)
def node_delete(spark, d):
    s = Store(spark, stored_path(spark, "store-"))
    n, p, r = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "region")
    node = lambda df, c, k: df.select(F.concat(F.lit(k), c).alias("id"), F.lit(k).alias("kind"), F.concat(F.lit(k), c).alias("name"))
    s.append("graph_nodes", node(n, "n_nationkey", "n").unionByName(node(p, "s_suppkey", "s")).unionByName(node(r, "r_regionkey", "r")))
    edge = lambda df, a, k, b, m: df.select(F.concat(F.lit(k), a).alias("src"), F.concat(F.lit(m), b).alias("dst"), F.lit("PART_OF").alias("kind"), F.lit(1.0).alias("weight"))
    s.add_edges(edge(n, "n_nationkey", "n", "n_regionkey", "r").unionByName(edge(p, "s_suppkey", "s", "s_nationkey", "n")))
    s.append("entity_aliases", n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("alias")))
    s.delete_nodes(spark.createDataFrame([("n3",)], "id string"))
    return _counts(s, "graph_edges", "graph_nodes", "entity_aliases")


@query("SELECT id, strlen(coalesce(text, '')) AS bytes FROM (SELECT DISTINCT id, record_id, text FROM record_chunks) WHERE record_id IN (SELECT id FROM memory_records)")
def visible_chunks(spark, d):
    s = _store(spark, d)
    s.append("chunks", spark.createDataFrame([("lost-c0", "a record that never came", 0, "x")], "id string, record_id string, ord bigint, text string"))
    return s.visible_chunks().select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
