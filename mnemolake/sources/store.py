"""The store: tables of truth as Parquet folders, and a derived chunk table that can be rebuilt from them.

Everything goes through Hadoop's file systems, so the root may be any URI that Spark can write.  A table is a folder of
batches and a manifest: `_manifest/N` names the live batches, and the greatest N counts.  Writing a batch shows nothing;
creating the next manifest, which fails if someone else has created it, shows all of it at once.  So a replacement never
shows old and new rows together, and batches that no manifest names are leftovers that `prune` deletes.

A record becomes visible with its own row, which is written last, so a capture that broke off between its tables leaves
nothing that is read (chunks without record are invisible).  Flushing is at least once: batches are appended to the
derived table first and stamped in an append-only flush log after.  Rows are deleted from the batches that hold them; the
other batches of a table stay as they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schemas
from mnemolake.functions import fixed as X
from mnemolake.session import materialize


class SchemaTooNew(RuntimeError):
    """The store was written by a newer version; it is never downgraded."""


class EmbedderUnavailable(RuntimeError):
    """The embedding model cannot be used now; nothing is stamped."""


class WrongDimension(RuntimeError):
    """A vector does not have the dimension of the table; the whole batch is refused."""


class Embedder(Protocol):
    spec: schemas.EmbeddingSpec

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


class SineEmbedder:
    """Deterministic vectors for tests: component i is sin(bytes of the text + 1 + i)."""

    def __init__(self, dim: int = X.EMBEDDING_DIM):
        self.spec = schemas.EmbeddingSpec(dim=dim)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        return [np.sin(len(t.encode()) + 1 + np.arange(self.spec.dim)).astype("float32").tolist() for t in texts]


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the table in between; nothing of this change is visible."""


class Files:
    """The few operations on folders that the store needs, on the file system of a URI."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> bool:
        """False if the file is there already."""
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            return False
        try:
            stream = fs.create(p, overwrite)
        except Exception:
            if fs.exists(p):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._migrate()

    # schema version

    def _version_file(self) -> str:
        return f"{self.root}/schema_version.json"

    def schema_version(self) -> int:
        text = self.files.read(self._version_file())
        return json.loads(text)["version"] if text else 0

    def _migrate(self) -> None:
        at = self.schema_version()
        if at > X.SCHEMA_VERSION:
            raise SchemaTooNew(f"the store has version {at}, this code knows {X.SCHEMA_VERSION}")
        if at < X.SCHEMA_VERSION:
            self.files.write(self._version_file(), json.dumps({"version": X.SCHEMA_VERSION}), overwrite=True)

    # tables

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[int]:
        return sorted(int(x) for x in self.files.names(f"{self.path(name)}/_manifest") if x.isdigit())

    def _live(self, name: str) -> tuple[int, list[str]]:
        """(version of the table, its live batches in order)."""
        v = self._versions(name)
        return (v[-1], json.loads(self.files.read(f"{self.path(name)}/_manifest/{v[-1]}"))) if v else (0, [])

    def batches(self, name: str) -> list[str]:
        return self._live(name)[1]

    def _show(self, name: str, version: int, batches: list[str]) -> None:
        if not self.files.write(f"{self.path(name)}/_manifest/{version + 1}", json.dumps(batches)):
            raise ConcurrentWrite(f"version {version + 1} of {name} was written by someone else")

    def _read(self, name: str, batches: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path(name)}/{b}" for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        return self._read(name, self.batches(name), schema or schemas.TABLES[name])

    def get(self, name: str, key, column: str = "id") -> DataFrame:
        """The row of a key: a filter that reaches the files' statistics."""
        return self.table(name).filter(F.col(column) == F.lit(key))

    def _write(self, name: str, df: DataFrame, schema: str, files: int | None = None) -> str:
        cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], schema).schema]
        batch = f"batch-{uuid.uuid4().hex}"
        out = df.select(*cols)
        (out.repartition(files) if files else out).write.parquet(f"{self.path(name)}/{batch}")
        return batch

    def append(self, name: str, df: DataFrame, schema: str | None = None) -> None:
        """One batch more; a table without schema of its own takes that of the derived chunk tables.  Appends of others in between are kept: only the manifest is tried again."""
        batch = self._write(name, df, schema or schemas.TABLES.get(name) or schemas.index_schema())
        for _ in range(20):
            version, live = self._live(name)
            try:
                return self._show(name, version, [*live, batch])
            except ConcurrentWrite:
                continue
        raise ConcurrentWrite(f"{name} is written by too many")

    def replace(self, name: str, df: DataFrame, schema: str | None = None, files: int | None = None) -> None:
        """New content as one batch, in place of all that is there, at once."""
        version, _ = self._live(name)
        self._show(name, version, [self._write(name, df, schema or schemas.TABLES[name], files)])

    def rewrite(self, name: str, touched: DataFrame, column: str, change, schema: str | None = None) -> int:
        """Batches that hold a key of `touched` (a column of the same name) are written anew as change(batch); returns their number."""
        schema = schema or schemas.TABLES[name]
        version, live = self._live(name)
        if not live:
            return 0
        t = self._read(name, live, schema).withColumn("_b", F.regexp_extract(F.input_file_name(), r"(batch-[0-9a-f]{32})", 1))
        hit = {r[0] for r in t.join(touched.select(column), column, "left_semi").select("_b").distinct().collect()}  # names of batches
        if hit:
            new = self._write(name, change(self._read(name, [b for b in live if b in hit], schema)), schema)
            self._show(name, version, [*[b for b in live if b not in hit], new])
        return len(hit)

    def compact(self, name: str, schema: str | None = None, files: int = 1) -> None:
        """All batches as one of `files` files."""
        if len(self.batches(name)) > 1:
            self.replace(name, self.table(name, schema), schema, files)

    def prune(self, name: str) -> int:
        """Delete batches and manifests that no reader of the last version needs; returns the number of batches."""
        version, live = self._live(name)
        old = [b for b in self.files.names(self.path(name)) if b.startswith("batch-") and b not in live]
        for b in old:
            self.files.delete(f"{self.path(name)}/{b}")
        for v in self._versions(name):
            if v < version:
                self.files.delete(f"{self.path(name)}/_manifest/{v}")
        return len(old)

    def backup(self, target: str) -> None:
        """A copy of the truth; derived tables are left out."""
        copy = Store(self.spark, target)
        for name in schemas.TABLES:
            if name != "flush_log" and self.batches(name):
                copy.replace(name, self.table(name))

    # captures

    def insert_captures(self, records: DataFrame, chunks: DataFrame) -> None:
        self.append("chunks", chunks)
        self.append("memory_records", records)

    def record_count(self) -> int:
        return self.table("memory_records").count()

    def visible_chunks(self) -> DataFrame:
        return self.table("chunks").join(self.table("memory_records").select(F.col("id").alias("record_id")), "record_id", "left_semi")

    def flushed(self) -> DataFrame:
        log = self.table("flush_log")
        last = log.filter("id is null").agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]  # resets
        return log.filter(F.col("id").isNotNull() & (F.col("epoch") >= last)).select("id").distinct()

    def pending_chunks(self, limit: int | None = X.FLUSH_BATCH) -> DataFrame:
        """Chunks not flushed, with source and time of their record; oldest first, in a total order."""
        p = self.table("chunks").join(self.flushed(), "id", "left_anti")
        r = self.table("memory_records").select(F.col("id").alias("record_id"), "source", "captured_at_ms")
        p = p.join(r, "record_id").select("id", "record_id", "ord", "text", "source", "captured_at_ms")
        return p if limit is None else p.orderBy("captured_at_ms", "ord", "id").limit(limit)

    def mark_flushed(self, ids: DataFrame, now_ms: int | None = None) -> None:
        self.append("flush_log", ids.select("id", F.lit(now_ms or int(time.time() * 1000)).alias("flushed_at_ms"), F.lit(self._epoch()).alias("epoch")))

    def _epoch(self) -> int:
        return self.table("flush_log").agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def reset_flush_state(self) -> int:
        n = self.table("chunks").count()
        self.append("flush_log", self.spark.createDataFrame([(None, 0, self._epoch() + 1)], schemas.TABLES["flush_log"]))
        return n

    # derived table

    def index(self, spec: schemas.EmbeddingSpec) -> DataFrame:
        return self.table(spec.table, schemas.index_schema(spec.dim))

    def converged_index(self, spec: schemas.EmbeddingSpec) -> DataFrame:
        """The derived table with the rows of broken flushes counted once."""
        return self.index(spec).dropDuplicates(["id"])

    def flush_once(self, embedder: Embedder, batch: int | None = X.FLUSH_BATCH) -> dict:
        """Embed up to a batch of pending chunks, append, then stamp.  An empty flush writes nothing."""
        pending = materialize(self.pending_chunks(batch))
        n = pending.count()
        if n:
            self.append(embedder.spec.table, embedded(pending, embedder), schemas.index_schema(embedder.spec.dim))
            self.mark_flushed(pending)
        return {"written": n, "batch_was_full": batch is not None and n == batch}

    def rebuild(self, embedder: Embedder, batch: int = X.FLUSH_BATCH) -> dict:
        """Make the derived table anew from the truth, in one distributed pass; it is empty until then."""
        schema = schemas.index_schema(embedder.spec.dim)
        self.replace(embedder.spec.table, self.spark.createDataFrame([], schema), schema)
        self.reset_flush_state()
        n = self.flush_once(embedder, None)["written"]
        return {"chunks": n, "batches": -(-n // batch)}

    # deletion and integrity

    def delete_records(self, ids: DataFrame, index_specs: tuple[schemas.EmbeddingSpec, ...] = ()) -> None:
        """Remove records (id) and all that hangs on them; tasks and decisions stay without their record."""
        gone = materialize(ids.select(F.col("id").alias("record_id")).distinct())
        chunk_ids = materialize(self.table("chunks").join(gone, "record_id", "left_semi").select("id"))
        without = lambda keys, column: lambda df: df.join(keys.select(column), column, "left_anti")
        for spec in index_specs:
            self.rewrite(spec.table, chunk_ids, "id", without(chunk_ids, "id"), schemas.index_schema(spec.dim))
        self.rewrite("flush_log", chunk_ids, "id", without(chunk_ids, "id"))
        for name in ("memory_texts", "memory_scores", "chunks", "review_queue", "node_mentions"):
            self.rewrite(name, gone, "record_id", without(gone, "record_id"))
        for name, column in (("tasks", "source_record_id"), ("decision_ledger", "record_id")):
            keys = gone.withColumnRenamed("record_id", column)
            self.rewrite(name, keys, column, lambda df, k=keys, c=column: null_missing(df, c, k, c))
        own = gone.withColumnRenamed("record_id", "id")
        self.rewrite("memory_records", own, "id", without(own, "id"))

    def delete_where(self, condition: Column, index_specs: tuple[schemas.EmbeddingSpec, ...] = ()) -> None:
        self.delete_records(self.table("memory_records").filter(condition).select("id"), index_specs)

    def retain_since(self, cutoff_ms: int, **kw) -> None:
        self.delete_where((F.col("captured_at_ms") > 0) & (F.col("captured_at_ms") < cutoff_ms), **kw)

    def retain_meetings_since(self, cutoff_ms: int) -> None:
        """Transcripts have a cutoff of their own; segments go with their meeting."""
        m = self.table("meetings")
        kept = m.filter(F.col("ended_at_ms") >= cutoff_ms)
        ids = kept.select(F.col("id").alias("meeting_id"))
        self.replace("meeting_segments", self.table("meeting_segments").join(ids, "meeting_id", "left_semi"))
        self.replace("meetings", kept)

    def restore(self, source: str) -> None:
        """Truth from a backup; derived tables must be rebuilt."""
        copy = Store(self.spark, source)
        for name in schemas.TABLES:
            if name != "flush_log" and (copy.batches(name) or self.batches(name)):
                self.replace(name, copy.table(name))

    def delete_nodes(self, ids: DataFrame) -> None:
        """Remove nodes with their edges, mentions and aliases."""
        gone = materialize(ids.select("id").distinct())
        for name, column in (("graph_edges", "src"), ("graph_edges", "dst"), ("node_mentions", "node_id"), ("entity_aliases", "node_id"), ("graph_nodes", "id")):
            keys = gone.withColumnRenamed("id", column)
            self.rewrite(name, keys, column, lambda df, k=keys, c=column: df.join(k, c, "left_anti"))

    def add_edges(self, edges: DataFrame) -> None:
        """Append edges; an edge to a node that is not there fails."""
        nodes = self.table("graph_nodes").select("id")
        for end in ("src", "dst"):
            if not orphans(edges, end, nodes, "id").isEmpty():
                raise ValueError(f"foreign key: {end} of an edge is no node")
        self.append("graph_edges", edges)


def embedded(pending: DataFrame, embedder: Embedder) -> DataFrame:
    """Pending chunks with their vectors; count and dimension are checked before anything is written."""
    dim = embedder.spec.dim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embedder.embed_documents(list(pdf["text"].fillna("")))
            if len(vectors) != len(pdf):
                raise WrongDimension(f"{len(pdf)} texts gave {len(vectors)} vectors")
            for v in vectors:
                if len(v) != dim:
                    raise WrongDimension(f"expected {dim} components, got {len(v)}")
            yield pdf.assign(vector=vectors)

    return pending.mapInPandas(run, schemas.index_schema(dim))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def null_missing(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """df with a reference set to null where its target is gone."""
    g = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    d = df.join(g, column, "left")
    return d.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*df.columns)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (added, removed, changed) from two listings (path, hash): what an incremental index must redo."""
    j = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    state = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return j.select("path", state.alias("state")).filter("state is not null")


def reindexed(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without rows of changed paths, with their fresh rows."""
    return index.join(changed.select("path"), "path", "left_anti").unionByName(fresh.join(changed.filter("state <> 'removed'").select("path"), "path", "left_semi"))
