"""The graph of a code base: kinds, checks, callers and dependents, reach of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import graph

# fixed values
NODE_KINDS = [
    "Repository", "Directory", "File", "Module", "Namespace", "Package", "Class", "Struct", "Interface", "Trait", "Function", "Method", "Variable", "Constant",
    "Enum", "Type", "DatabaseTable", "APIEndpoint", "Configuration", "Test", "Documentation", "ADR / RFC", "ExternalDependency",
]
EDGE_KINDS = [
    "CONTAINS", "DEFINES", "IMPORTS", "EXPORTS", "CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "INHERITS", "USES", "DEPENDS_ON", "RETURNS", "ACCEPTS",
    "INSTANTIATES", "OVERRIDES", "TESTS", "CONFIGURES", "EXPOSES", "READS", "WRITES", "STORES_IN", "QUERIES", "MIGRATES", "DOCUMENTS", "JUSTIFIED_BY",
    "REPLACED_BY",
]

NODES = "id string, kind string, name string, path string"
EDGES = "src string, dst string, kind string, provenance string, confidence double, location string"


def checked_nodes(nodes: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("unknown node kind: "), F.coalesce("kind", F.lit("null"))))
    return nodes.withColumn("kind", F.when(F.col("kind").isin(NODE_KINDS), F.col("kind")).otherwise(bad))


def checked_edges(edges: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("unknown relationship: "), F.coalesce("kind", F.lit("null"))))
    return graph.valid_provenance(edges.withColumn("kind", F.when(F.col("kind").isin(EDGE_KINDS), F.col("kind")).otherwise(bad)))


def callees(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("kind") == "CALLS") & (F.col("src") == node)).select(F.col("dst").alias("node")).distinct()


def callers(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("kind") == "CALLS") & (F.col("dst") == node)).select(F.col("src").alias("node")).distinct()


def dependencies(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    return graph.neighbourhood(graph.strong_edges(edges.withColumnRenamed("confidence", "weight"), kinds=kinds), seeds, hops)


def blast_radius(edges: DataFrame, seeds: DataFrame, hops: int = 5, kinds: list[str] | None = None) -> DataFrame:
    """node, depth of all that may notice a change of the seeds: the edges followed backwards."""
    back = graph.strong_edges(edges.withColumnRenamed("confidence", "weight"), kinds=kinds)
    back = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return graph.neighbourhood(back, seeds, hops)


def compact_subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2, per_hop: int = 10) -> DataFrame:
    """Edges between the nodes near the seeds, with a bound on what each node adds."""
    near = graph.neighbourhood(edges.withColumnRenamed("confidence", "weight"), seeds, hops, per_hop).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def find_symbols(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Nodes by exact name, then by parts of the name."""
    parts = [F.lower("name").contains(w) for w in query.lower().split()]
    score = graph.symbol_score(F.col("name"), query)
    for p in parts:
        score = score + p.cast("double") * 0.1
    return nodes.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "name", "id").limit(k)
