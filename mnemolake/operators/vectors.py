"""Vector search: exact with prefilter, approximate by cells, hybrid fusion, and the contract of stored vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def renormalised(v: Column, dim: int = X.EMBEDDING_DIM) -> Column:
    """The first `dim` components, scaled to length 1."""
    cut = F.slice(v, 1, dim).cast("array<double>")
    length = norm(cut)
    return F.transform(cut, lambda x: x / length)


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if its length is wrong or it is all zero."""
    bad = F.raise_error(F.concat(F.lit(f"expected a non-zero vector of {dim} components, got "), F.size(v).cast("string")))
    return F.when((F.size(v) == dim) & F.exists(v, lambda x: x != 0), v).otherwise(bad)


def knn(df: DataFrame, key: str, vector: str, probe, k: int = 10, prefilter: Column | None = None) -> DataFrame:
    """The k rows nearest to one probe; a prefilter applies before, never after."""
    d = df if prefilter is None else df.filter(prefilter)
    p = literal_vector(probe) if not isinstance(probe, Column) else probe
    return d.select(key, F.sqrt(l2_squared(F.col(vector), p)).alias("distance")).orderBy("distance", key).limit(k)


PROBE_BLOCK = 2048


def knn_batch(df: DataFrame, key: str, vector: str, probes: DataFrame, probe_key: str, probe_vector: str, k: int = 10) -> DataFrame:
    """probe, id, rank, distance: the k nearest rows of every probe.

    A stated set of probes goes against all rows in blocks of PROBE_BLOCK, which bounds what is sent; every batch of rows
    keeps its k best of a probe, so that k rows per probe and batch are shuffled."""
    p = probes.select(F.col(probe_key).alias("probe"), F.col(probe_vector).alias("v"))
    out, last = None, None
    kind = df.schema[key].dataType.simpleString()
    while True:
        block = (p if last is None else p.filter(F.col("probe") > last)).orderBy("probe").limit(PROBE_BLOCK).collect()
        if block:
            part = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(_nearest_of([r[0] for r in block], [r[1] for r in block], k), f"probe bigint, id {kind}, distance double")
            out = part if out is None else out.unionByName(part)
        if len(block) < PROBE_BLOCK:
            break
        last = block[-1][0]
    if out is None:
        return df.sparkSession.createDataFrame([], f"probe bigint, id {kind}, distance double, rank int")
    w = Window.partitionBy("probe").orderBy(F.round("distance", 9), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest_of(names: list, values: list, k: int):
    import numpy as np

    probes = np.array(values, np.float64)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                ids = pdf["id"].to_numpy()[lo : lo + 2000]
                x = np.stack(pdf["v"].to_numpy()[lo : lo + 2000]).astype(np.float64)
                d = np.maximum((x * x).sum(1)[None] - 2 * probes @ x.T + (probes * probes).sum(1)[:, None], 0)
                # all rows at the k-th distance or below, as that is only near the exact one; of these the k best by distance and id
                kth = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                slack = 1e-9 * ((x * x).sum(1).max() + (probes * probes).sum(1))
                out = []
                for i, q in enumerate(probes):
                    at = np.flatnonzero(d[i] <= kth[i] + slack[i])
                    exact = np.sqrt(((x[at] - q) ** 2).sum(1))
                    best = np.lexsort((ids[at], exact.round(9)))[:k]
                    out.append((at[best], exact[best]))
                sizes = [len(a) for a, _ in out]
                yield pd.DataFrame({"probe": np.repeat(names, sizes), "id": ids[np.concatenate([a for a, _ in out])], "distance": np.concatenate([e for _, e in out])})

    return run


def ivf_cells(df: DataFrame, key: str, vector: str, cells: int = 16, seed: int = 11, sample: int = 4096, rounds: int = 6):
    """(rows with their cell, centroids): k-means on about `sample` rows on the driver, then every row is indexed."""
    import numpy as np

    n = df.count()
    step = max(1, n // sample)
    some = df.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(vector).limit(2 * sample).collect()
    x = np.array([r[0] for r in some], np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) < 200_000 else np.concatenate([((x[i : i + 512, None, :] - c[None]) ** 2).sum(2).argmin(1) for i in range(0, len(x), 512)])
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    centres = [literal_vector(v) for v in c]
    dist = F.array(*[F.struct(l2_squared(F.col(vector), v).alias("d"), F.lit(j).alias("c")) for j, v in enumerate(centres)])
    return df.withColumn("cell", F.array_min(dist)["c"]), c


def ann(indexed: DataFrame, centroids, key: str, vector: str, probe, k: int = 10, probes: int = 4) -> DataFrame:
    """Approximate: only the cells nearest to the probe are read (a partition filter when stored by cell)."""
    import numpy as np

    order = ((np.asarray(centroids) - np.asarray(probe)) ** 2).sum(1).argsort()[:probes]
    return knn(indexed.filter(F.col("cell").isin([int(i) for i in order])), key, vector, probe, k).withColumn("mode", F.lit("ann"))


class ProductQuantiser:
    """A vector as `parts` small numbers, each the nearest of `words` centroids of its stretch of components."""

    def __init__(self, books):
        self.books = books  # (parts, words, components of a part)

    @classmethod
    def fit(cls, df: DataFrame, key: str, vector: str, parts: int = 8, words: int = 64, sample: int = 4096, rounds: int = 8, seed: int = 13) -> ProductQuantiser:
        """Centroids on at most `sample` rows, chosen by hash; every row is encoded."""
        import numpy as np

        step = max(1, -(-df.count() // sample))
        some = df.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).orderBy(key).limit(sample).select(vector).collect()
        x = np.array([r[0] for r in some], np.float64)
        rng = np.random.default_rng(seed)
        books = []
        for part in np.split(x, parts, axis=1):
            c = part[rng.choice(len(part), min(words, len(part)), replace=False)]
            for _ in range(rounds):
                at = ((part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1)).argmin(1)
                c = np.stack([part[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            books.append(c)
        return cls(np.stack(books))

    def encode(self, vector: Column) -> Column:
        import numpy as np

        books = self.books

        @F.pandas_udf("array<int>")
        def codes(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            out = [((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)).argmin(1) for p, c in zip(np.split(x, len(books), axis=1), books)]
            return pd.Series(list(np.stack(out, axis=1).astype(np.int32)))

        return codes(vector)

    def distance(self, codes: Column, probe) -> Column:
        """Squared distance of a probe to the vector that the codes stand for: a sum of looked-up values."""
        import numpy as np

        table = ((self.books - np.stack(np.split(np.asarray(probe, np.float64), len(self.books)))[:, None, :]) ** 2).sum(2)
        total = F.lit(0.0)
        for j, row in enumerate(table):
            total = total + F.get(literal_vector(row), F.get(codes, j))
        return total


def ann_pq(indexed: DataFrame, quantiser: ProductQuantiser, key: str, vector: str, codes: str, probe, k: int = 10, again: int = 10) -> DataFrame:
    """Approximate: the `again` * k rows nearest by codes, of which the k nearest by the vectors themselves."""
    near = indexed.withColumn("_d", quantiser.distance(F.col(codes), probe)).orderBy("_d", key).limit(again * k)
    return knn(near, key, vector, probe, k).withColumn("mode", F.lit("pq"))


def rrf(routes: DataFrame, id_col: str = "id", k: int = X.RRF_K) -> DataFrame:
    """Fuse routes (qid, route, id, rank) by reciprocal ranks: qid, id, score, routes."""
    keys = [c for c in ("qid",) if c in routes.columns]
    return routes.groupBy(*keys, id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("route")).alias("routes"))


def query_text(task: str, query: str) -> str:
    """Queries carry an instruction, documents come bare."""
    return f"Instruct: {task}\nQuery:{query}"


def semantic_repeats(df: DataFrame, key: str, time: str, vector: str, window_ms: int, floor: float) -> DataFrame:
    """Rows that are at least `floor` similar to an earlier row within a time window: equi-joins on time buckets."""
    d = df.filter(F.col(time).isNotNull()).withColumn("_b", F.floor(F.col(time) / window_ms).cast("bigint"))
    a = d.select(F.col(key).alias("id"), F.col(time).alias("t"), F.col(vector).alias("v"), F.explode(F.array("_b", F.col("_b") - 1)).alias("_b"))
    b = d.select(F.col(key).alias("first_id"), F.col(time).alias("u"), F.col(vector).alias("w"), "_b")
    j = a.join(b, "_b").filter((F.struct("u", "first_id") < F.struct("t", "id")) & (F.col("t") - F.col("u") <= window_ms))
    j = j.withColumn("cosine", dot(F.col("v"), F.col("w")) / (norm(F.col("v")) * norm(F.col("w")))).filter(F.col("cosine") >= floor)
    return j.groupBy("id").agg(F.max("cosine").alias("cosine"), F.min("first_id").alias("first_id"))


def store_cells(indexed: DataFrame, path: str) -> None:
    materialize(indexed).write.mode("overwrite").partitionBy("cell").parquet(path)
