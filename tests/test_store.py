import json

import pytest
from pyspark.sql import functions as F

from mnemolake import schemas
from mnemolake.sources import readers
from mnemolake.sources.store import ConcurrentWrite, SchemaTooNew, SineEmbedder, Store, changed_files, embedded, orphans

RECORD = "id string, session_id string, source string, app_name string, window_title string, captured_at_ms bigint, created_at_ms bigint, lifecycle bigint"
CHUNK = "id string, record_id string, ord bigint, text string"


def capture(spark, store, name, n, at=1755000000000):
    store.insert_captures(
        spark.createDataFrame([(name, "s", "screen", "App", "Title", at, at, 0)], RECORD),
        spark.createDataFrame([(f"{name}-c{i}", name, i, f"chunk {i} of {name}") for i in range(n)], CHUNK),
    )


class Broken(SineEmbedder):
    def embed_documents(self, texts):
        raise RuntimeError("model is away")


class Short(SineEmbedder):
    def embed_documents(self, texts):
        return [[1.0] * 5 for _ in texts]


class Fewer(SineEmbedder):
    def embed_documents(self, texts):
        return super().embed_documents(texts)[:-1]


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def test_flush_and_empty_flush(spark, store):
    capture(spark, store, "r1", 3)
    capture(spark, store, "r2", 2)
    e = SineEmbedder(8)
    assert store.pending_chunks().count() == 5
    assert store.flush_once(e) == {"written": 5, "batch_was_full": False}
    assert store.pending_chunks().count() == 0 and store.flush_once(e)["written"] == 0
    assert len(store.batches(e.spec.table)) == 1
    assert store.index(e.spec).filter(F.size("vector") != 8).count() == 0


def test_outage_then_retry(spark, store):
    capture(spark, store, "r", 4)
    with pytest.raises(Exception):
        store.flush_once(Broken(8))
    assert store.pending_chunks().count() == 4 and store.flush_once(SineEmbedder(8))["written"] == 4


@pytest.mark.parametrize("embedder", [Short(8), Fewer(8)])
def test_wrong_vectors_refuse_the_batch(spark, store, embedder):
    capture(spark, store, "r", 1)
    with pytest.raises(Exception):
        store.flush_once(embedder)
    assert store.pending_chunks().count() == 1


def test_crash_window_then_rebuild(spark, store):
    capture(spark, store, "r", 5)
    e = SineEmbedder(8)
    store.flush_once(e)
    store.append(e.spec.table, embedded(store.visible_chunks().select("id", "record_id", "ord", "text", F.lit("screen").alias("source"), F.lit(1).cast("bigint").alias("captured_at_ms")), e), schemas.index_schema(8))
    assert store.index(e.spec).count() == 10 and store.converged_index(e.spec).count() == 5
    assert store.rebuild(e) == {"chunks": 5, "batches": 1}
    assert sorted(r["id"] for r in store.index(e.spec).collect()) == [f"r-c{i}" for i in range(5)]


def test_orphan_chunks_are_invisible(spark, store):
    store.append("chunks", spark.createDataFrame([("x-c0", "x", 0, "lost")], CHUNK))
    assert store.visible_chunks().count() == 0 and store.pending_chunks().count() == 0


def test_delete_cascades(spark, store):
    capture(spark, store, "r1", 2, at=1000)
    capture(spark, store, "r2", 1, at=2000)
    e = SineEmbedder(4)
    store.flush_once(e)
    store.append("memory_scores", spark.createDataFrame([("r1", "noise", 0.5), ("r2", "noise", 0.1)], schemas.TABLES["memory_scores"]))
    store.append("tasks", spark.createDataFrame([("t", "do", 0, "r1", 0)], schemas.TABLES["tasks"]))
    store.retain_since(1500, index_specs=(e.spec,))
    assert store.record_count() == 1 and store.table("chunks").count() == 1 and store.table("memory_scores").count() == 1
    assert store.index(e.spec).count() == 1 and store.table("tasks").first()["source_record_id"] is None


def test_graph_integrity(spark, store):
    nodes = spark.createDataFrame([("a", "app", "A", 0), ("b", "app", "B", 0)], schemas.TABLES["graph_nodes"])
    store.append("graph_nodes", nodes)
    with pytest.raises(ValueError, match="foreign key"):
        store.add_edges(spark.createDataFrame([("a", "zz", "uses", 1.0)], schemas.TABLES["graph_edges"]))
    store.add_edges(spark.createDataFrame([("a", "b", "uses", 1.0)], schemas.TABLES["graph_edges"]))
    store.delete_nodes(spark.createDataFrame([("b",)], "id string"))
    assert store.table("graph_edges").count() == 0 and store.table("graph_nodes").count() == 1


def test_versions(spark, store):
    assert store.schema_version() == 2 and Store(spark, store.root).schema_version() == 2
    store.files.write(store._version_file(), json.dumps({"version": 99}), overwrite=True)
    with pytest.raises(SchemaTooNew):
        Store(spark, store.root)


def test_compaction_and_backup(spark, store, tmp_path):
    for i in range(4):
        capture(spark, store, f"r{i}", 1)
    store.compact("chunks")
    assert len(store.batches("chunks")) == 1 and store.table("chunks").count() == 4 and store.prune("chunks") == 4
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).record_count() == 4


def test_batches_are_shown_at_once_and_only_by_manifest(spark, store):
    capture(spark, store, "r1", 1)
    version, live = store._live("chunks")
    lost = store._write("chunks", spark.createDataFrame([("x-c0", "r1", 9, "never shown")], CHUNK), schemas.TABLES["chunks"])
    assert store.table("chunks").count() == 1  # a writer that dies before its manifest shows nothing
    capture(spark, store, "r2", 1)
    with pytest.raises(ConcurrentWrite):
        store._show("chunks", version, [*live, lost])
    assert store.table("chunks").count() == 2 and store.prune("chunks") == 1 and store.table("chunks").count() == 2


def test_deletion_rewrites_only_the_batches_that_hold_the_rows(spark, store):
    for i in range(3):
        capture(spark, store, f"r{i}", 2, at=1000 + i)
    before = store.batches("chunks")
    store.delete_where(F.col("id") == "r1")
    after = store.batches("chunks")
    assert [b for b in after if b in before] == [before[0], before[2]] and store.table("chunks").count() == 4
    assert store.rewrite("chunks", spark.createDataFrame([("none",)], "record_id string"), "record_id", lambda d: d) == 0


def test_store_on_a_uri(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/on/a/uri")
    capture(spark, store, "r", 2)
    assert store.flush_once(SineEmbedder(4))["written"] == 2 and Store(spark, f"file://{tmp_path}/on/a/uri").record_count() == 1
    store.restore(f"file://{tmp_path}/empty")
    assert store.record_count() == 0


def test_lifecycle_codes(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "v bigint")
    names = [r[0] for r in df.select(schemas.lifecycle_name(F.col("v"))).collect()]
    assert names == ["Captured", "Pending", "ReviewedLocal", "ReviewedDaily", "ReviewFailed"]
    with pytest.raises(Exception, match="unknown TaskStatus discriminant: 999"):
        spark.createDataFrame([(999,)], "v bigint").select(schemas.task_status_name(F.col("v"))).collect()


def test_jsonl_and_corpus(spark, tmp_path):
    (tmp_path / "records.jsonl").write_text('{"id":1,"source":"screen","captured_at_ms":5,"text":"hello"}\n\n{"id":2,"source":"meeting","captured_at_ms":6,"text":"world"}\n')
    (tmp_path / "queries.jsonl").write_text('{"query":"hello","relevant":[1]}\n')
    records, queries = readers.load_corpus(spark, str(tmp_path))
    assert records.count() == 2 and queries.first()["relevant"] == [1]
    (tmp_path / "bad.jsonl").write_text('{"id":1}\nnonsense\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.CORPUS_RECORDS).collect()
    assert [r["line"] for r in readers.bad_lines(spark, str(tmp_path / "bad.jsonl"), schemas.CORPUS_RECORDS).collect()] == [2]
    (tmp_path / "queries.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        readers.load_corpus(spark, str(tmp_path))


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    reg = spark.createDataFrame([("a", "a.bin", 3, "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("b", "b.bin", 7, "x")], "id string, file string, size_bytes bigint, sha256 string")
    s = readers.artifact_status(spark, str(tmp_path), reg)
    assert {r["id"]: r["state"] for r in s.collect()} == {"a": "ok", "b": "missing"}
    assert readers.bytes_needed(s, ["a", "b", "unknown"]) == 7


def test_changes_and_orphans(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1")], "path string, hash string")
    b = spark.createDataFrame([("q", "2"), ("r", "1")], "path string, hash string")
    assert {(r["path"], r["state"]) for r in changed_files(a, b).collect()} == {("p", "removed"), ("q", "changed"), ("r", "added")}
    assert orphans(a, "path", b, "path").count() == 1


def test_bad_lines_are_numbered_per_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_text("".join('{"id":1,"source":"s","captured_at_ms":1,"text":"x"}\n' if i % 50 else "broken\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r["file"][-7], r["line"]) for r in readers.bad_lines(spark, str(tmp_path), schemas.CORPUS_RECORDS).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(str(n), i + 1) for n in range(3) for i in range(0, 400, 50)}
