"""The typed graph of entities: extraction, traversal, paths, communities.

Nodes and edges are tables (src, dst, kind, weight).  Traversals are iterated joins whose frontier is cut from lineage in
the shared checkpoint folder; nothing is collected but the emptiness of a frontier.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.session import materialize

EDGE_FLOOR = 0.4  # fixed value
PROVENANCE = ["EXTRACTED", "INFERRED", "LLM_INFERRED", "AMBIGUOUS"]  # fixed values


def node_ids(df: DataFrame, kind: str, name: str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> DataFrame:
    """Adds node_id, a name-based UUID (version 5) of kind and name, once per distinct pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(node_id=[str(uuid.uuid5(namespace, f"{k}:{n}")) for k, n in zip(pdf["_kind"], pdf["_name"])])

    d = df.select(F.col(kind).alias("_kind"), F.lower(F.trim(F.col(name))).alias("_name")).distinct().mapInPandas(run, "_kind string, _name string, node_id string")
    return df.join(d, (df[kind] == d["_kind"]) & (F.lower(F.trim(df[name])) == d["_name"])).drop("_kind", "_name")


def extract_entities(df: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, float]], floor: float = EDGE_FLOOR) -> DataFrame:
    """record_id, kind, name, confidence of pattern matches (kind -> (pattern, confidence)) at or above the floor."""
    out = None
    for kind, (pattern, conf) in patterns.items():
        if conf < floor:
            continue
        d = df.select(F.col(key).alias("record_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 0))).alias("name"))
        d = d.select("record_id", F.lit(kind).alias("kind"), "name", F.lit(conf).alias("confidence"))
        out = d if out is None else out.unionByName(d)
    return out


def resolve_aliases(df: DataFrame, alias: str, aliases: DataFrame) -> DataFrame:
    """Adds node_id of an alias, compared without case and outer spaces."""
    a = aliases.select(F.lower(F.trim("alias")).alias("_a"), "node_id").groupBy("_a").agg(F.min("node_id").alias("node_id"))
    return df.withColumn("_a", F.lower(F.trim(F.col(alias)))).join(a, "_a", "left").drop("_a")


def strong_edges(edges: DataFrame, floor: float = EDGE_FLOOR, kinds: list[str] | None = None) -> DataFrame:
    e = edges.filter(F.col("weight") >= floor)
    return e if kinds is None else e.filter(F.col("kind").isin(kinds))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, per_hop: int | None = None) -> DataFrame:
    """node, depth: nodes within `hops` directed steps of the seeds (column node); per_hop limits what one node adds.

    Only columns src and dst of edges are used (and weight, to choose under a limit); they are made and stored once."""
    edges = materialize(edges.select("src", "dst", *(["weight"] if "weight" in edges.columns and per_hop is not None else [])))
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges, "src")
        if per_hop is not None:
            w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst") if "weight" in edges.columns else Window.partitionBy("src").orderBy("dst")
            step = step.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_hop)
        frontier = materialize(step.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame, start, goal, most: int = 10) -> DataFrame:
    """step, node of one shortest directed path (the smallest predecessors win); no rows if there is none."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, None, 0)], f"node {kind}, via {kind}, depth int")
    layers, frontier = [seen], seen
    for depth in range(1, most + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        layers.append(frontier)
        seen = seen.unionByName(frontier)
        if not frontier.filter(F.col("node") == F.lit(goal)).isEmpty():
            break
    path, at = [], goal
    for depth in range(len(layers) - 1, -1, -1):  # one row per step
        row = layers[depth].filter(F.col("node") == F.lit(at)).select("via").first()
        if row is None:
            if path:
                break
            continue
        path.append((depth, at))
        at = row[0]
    return spark.createDataFrame(path[::-1] if path and path[-1][1] == start else [], f"step int, node {kind}")


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree."""
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = o.join(i, "node", "full_outer").fillna(0, ["out_degree", "in_degree"])
    return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_anti")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (the smallest node): alternating large-star and small-star, a logarithmic number of rounds.

    It is an error if `most` rounds do not suffice: what has not converged is never given out as a result."""
    e = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct())
    for _ in range(most):
        two = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.join(m, "a").filter("b > a").select(F.col("b").alias("x"), "m").filter("x <> m").distinct()
        down = large.select(F.col("x").alias("a"), F.col("m").alias("b"))
        m2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m2, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").filter("x <> m").distinct()
        new = materialize(small.select(F.col("m").alias("a"), F.col("x").alias("b")))
        old_n, new_n = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first(), new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = new
        if old_n == new_n:
            break
    else:
        raise RuntimeError(f"components have not converged in {most} rounds")
    out = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    alone = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.select("node"), "node", "left_anti")
    return out.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a labelling (node, label) of an undirected graph (each edge once)."""
    e = edges.select("src", "dst", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).alias("w"))
    j = e.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    deg = j.select(F.explode(F.array("ls", "ld")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("deg"))
    inside = j.agg(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("m"))
    d2 = deg.agg(F.sum(F.col("deg") * F.col("deg")).alias("d2"))
    return inside.join(F.broadcast(d2)).select((F.col("i") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def communities(edges: DataFrame, rounds: int = 12, levels: int = 8) -> DataFrame:
    """node, label (the smallest node of the community): Louvain, level after level.

    A level moves nodes to the neighbouring community of greatest modularity gain; then communities become nodes, with
    what lies inside them as loops, and the next level begins, until a level joins nothing."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", weight.alias("w")).filter("src <> dst")
    two = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = two.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] or 1.0
    labels = two.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    n = labels.count()
    for _ in range(levels):
        level = materialize(_one_level(two, total, rounds))
        names = level.groupBy("label").agg(F.min("node").alias("name"))  # a community is called by its smallest node
        level = materialize(level.join(names, "label").select("node", F.col("name").alias("label")))
        fewer = level.select("label").distinct().count()
        labels = materialize(labels.join(level.select(F.col("node").alias("label"), F.col("label").alias("to")), "label").select("node", F.col("to").alias("label")))
        if fewer == n:
            break
        n = fewer
        name = lambda c: level.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        two = materialize(two.join(name("src"), "src").join(name("dst"), "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")))
    return labels


def _one_level(two: DataFrame, total: float, rounds: int) -> DataFrame:
    """node, label after the moves of one level; `two` has every edge in both directions, loops once with both ends counted.

    Half of the nodes, by a hash of node and round, move at a time, so that neighbours do not swap for ever."""
    deg = materialize(two.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    labels = deg.select("node", "k", F.col("node").alias("label"))
    out = two.filter("src <> dst")
    for r in range(rounds):
        tot = labels.groupBy("label").agg(F.sum("k").alias("tot"))
        near = out.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy("src", "to").agg(F.sum("w").alias("kin"))
        own = labels.select(F.col("node").alias("src"), "k", "label")
        gain = near.join(own, "src").join(tot.select(F.col("label").alias("to"), "tot"), "to")
        rest = F.col("tot") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0.0)
        gain = gain.select("src", "label", "to", (F.col("kin") - F.col("k") * rest / F.lit(float(total))).alias("g"))
        best = gain.groupBy("src").agg(
            F.max(F.struct(F.round("g", 9).alias("g"), (F.col("to") == F.col("label")).alias("stay"), F.col("to").alias("to"))).alias("b"),
            F.coalesce(F.max(F.when(F.col("to") == F.col("label"), F.round("g", 9))), F.lit(None).cast("double")).alias("here"),
        )
        # alone again, a node gains nothing: it leaves its community only for a better one
        turn = (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0) & (F.col("b.g") > F.greatest(F.coalesce("here", F.lit(0.0)), F.lit(0.0)))
        new = labels.join(best.select(F.col("src").alias("node"), "b", "here"), "node", "left")
        moved = materialize(new.select("node", "k", F.when(turn, F.col("b.to")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was")))
        changed = moved.filter("label <> was").limit(1).count()
        labels = moved.select("node", "k", "label")
        if not changed and r > 2:
            break
    return labels.select("node", "label")


def cycles(edges: DataFrame, most: int = 6) -> DataFrame:
    """node, length: nodes on a directed cycle of at most `most` edges.

    Nodes that no edge enters or none leaves are trimmed first, again and again; walks then start and stay within the
    strongly bound rest and hold each (start, node) once."""
    e = materialize(edges.select("src", "dst").distinct())
    n = e.count()
    while True:
        kept = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = kept.count()
        e = kept
        if m == n:
            break
        n = m
    # a cycle stays within a component of what is left
    reach = e.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    found = reach.filter("start = node").select("node", F.lit(1).alias("length"))
    step = e.select(F.col("src").alias("node"), "dst")
    for k in range(2, most + 1):
        done = materialize(found.select(F.col("node").alias("start")).distinct())
        reach = materialize(reach.join(done, "start", "left_anti").join(step, "node").select("start", F.col("dst").alias("node")).distinct())
        found = found.unionByName(reach.filter("start = node").select("node", F.lit(k).alias("length")))
    return found.groupBy("node").agg(F.min("length").alias("length"))


def valid_provenance(edges: DataFrame, column: str = "provenance") -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("unknown provenance: "), F.coalesce(F.col(column), F.lit("null"))))
    return edges.withColumn(column, F.when(F.col(column).isin(PROVENANCE), F.col(column)).otherwise(bad))


def task_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_id, title of lines that read like open tasks."""
    lines = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    d = df.select(F.col(key).alias("record_id"), lines.alias("line"))
    pattern = r"(?i)^\s*(?:[-*]\s*)?(?:\[ \]\s*|todo[:\s]\s*)(.+?)\s*$"
    return d.filter(F.col("line").rlike(pattern)).select("record_id", F.regexp_extract("line", pattern, 1).alias("title"))


def banned_dependencies(deps: DataFrame, banned: DataFrame, allowed: DataFrame) -> DataFrame:
    """(package, dependency) rows of banned dependencies that are not allowed for their package."""
    return deps.join(banned, "dependency", "left_semi").join(allowed, ["package", "dependency"], "left_anti")


def labelled_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, depth, path: one labelled path (kinds of the edges) per reached node."""
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit("").alias("path"))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.select(F.col("node").alias("src"), "path").join(edges.select("src", "dst", "kind"), "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.lit("/"), "kind")).alias("path"))
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path"))
        seen = seen.unionByName(frontier)
    return seen


def symbol_score(name: Column, query: str) -> Column:
    """Exact name before lexical overlap, for finding symbols by words."""
    return F.when(F.lower(name) == query.lower(), 1.0).when(F.lower(name).contains(query.lower()), 0.5).otherwise(0.0)
