import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemolake.functions.porter import stem
from mnemolake.operators import evaluate, search

DOCS = [
    (1, "The walking skeleton connects capture and index"), (2, "Skeleton search works over the indexes"), (3, "Café notes about scalar index prefilter plans"),
    (4, "scalar values, prefiltering by index; index again"), (5, "zebra crossing"), (6, ""), (7, None), (8, "one two three four five six seven eight nine ten eleven skeleton"),
]


@pytest.fixture(scope="module")
def index(spark):
    i, df = search.memory_index(spark, DOCS)
    i.postings.cache()
    return i, df


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(text, tokenize='porter unicode61')")
    c.executemany("insert into t(rowid, text) values (?, ?)", [(i, t or "") for i, t in DOCS])
    return c


@pytest.mark.parametrize("q", ["skeleton", "scalar index prefiltering", "cafe", "index OR zebra", "skeleton NOT search", '"index again"', "ind*", '"scalar index"', "NEAR(scalar prefilter, 3)", "NEAR(one twelve)", "(skeleton AND capture) OR zebra", "one + two", "text : zebra", "nothinghere"])
def test_matches_and_ranks_like_a_full_text_engine(index, fts, q):
    want = {r[0]: r[1] for r in fts.execute("select rowid, bm25(t) from t where t match ?", (q,))}
    got = {r["doc"]: r["rank"] for r in search.ranked(index[0], q).collect()}
    assert set(got) == set(want)
    if "NEAR" not in q and "NOT" not in q:
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("q", ["", "?", "foo-bar", '"open', "AND x", "nosuch : x", "(x"])
def test_syntax_errors_are_errors(index, fts, q):
    with pytest.raises(search.QuerySyntaxError):
        search.parse_query(q)
    if q:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("select rowid from t where t match ?", (q,)).fetchall()


def test_delete_keeps_the_index_in_step(spark, index):
    i = index[0].without(spark.createDataFrame([(5,)], "doc bigint"))
    assert search.ranked(i, "zebra").count() == 0 and search.ranked(index[0], "zebra").count() == 1


@pytest.mark.parametrize("n,want", [(None, 10), (3, 3), (999, 50), (0, 0)])
def test_limit_policy(n, want):
    assert search.hit_limit(n) == want


def test_snippet_and_serving(index):
    hits = search.search(*index, "id", "skeleton")
    rows = search.with_snippets(hits, "text", "skeleton").withColumn("captured_at_ms", F.lit(5))
    r = {x["id"]: x for x in search.serving(rows).collect()}
    assert r[2]["snippet"] == "[Skeleton] search works over the indexes" and r[2]["captured_at_ms"] == 5.0 and "rank" not in rows.drop("rank").columns
    assert search.snippet(None, "x") == ""


def test_stemmer():
    assert [stem(w) for w in "indexes indexing prefiltering relational hopping flies sky".split()] == ["index", "index", "prefilt", "relat", "hop", "fli", "sky"]


def test_metrics(spark):
    df = spark.createDataFrame([([7, 3, 9, 1, 2, 8], [3, 2]), ([7, 3, 9, 1, 2, 8], [3, 8]), ([7, 3, 9, 1, 2, 8], [42]), ([7], []), ([], [1])], "r array<bigint>, t array<bigint>")
    rows = df.select(evaluate.recall_at(F.col("r"), F.col("t")).alias("recall"), evaluate.reciprocal_rank_at(F.col("r"), F.col("t")).alias("rr")).collect()
    assert [x["recall"] for x in rows] == [1.0, 0.5, 0.0, 0.0, 0.0] and [x["rr"] for x in rows][:3] == [0.5, 0.5, 0.0]
    one = spark.createDataFrame([([7, 3, 9, 1, 2, 8], [8])], "r array<bigint>, t array<bigint>").select(evaluate.reciprocal_rank_at(F.col("r"), F.col("t"))).first()[0]
    assert one == pytest.approx(1 / 6)


@pytest.mark.parametrize("values,p,want", [([], 0.5, 0.0), ([4.0], 0.5, 4.0), ([1.0, 2.0], 0.5, 2.0), ([float(i) for i in range(8)], 0.5, 4.0), ([float(i) for i in range(8)], 0.95, 7.0)])
def test_percentile(spark, values, p, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(evaluate.percentile(F.col("v"), p)).first()[0] == want
    if values:
        assert evaluate.exact_percentile(spark.createDataFrame([(v,) for v in values], "v double"), "v", p).first()[0] == want


def test_baseline_run_and_gate(spark, index, tmp_path):
    q = spark.createDataFrame([(1, "scalar index prefiltering", [4]), (2, "zebra", [5]), (3, "absent", [1])], "qid bigint, query string, relevant array<bigint>")
    r = evaluate.report(evaluate.run_baseline(index[0], q), [1.0, 2.0])
    assert r["queries"] == 3 and r["recall_at_5"] == pytest.approx(2 / 3) and 0.5 <= r["mrr_at_10"] <= 2 / 3
    assert evaluate.regressions(r, r | {"latency_p50_ms": 0.0}) == []
    assert len(evaluate.regressions(r, r | {"recall_at_5": 0.8})) == 1
    assert evaluate.gate(r, str(tmp_path / "none.json")) == 1 and evaluate.gate(r, None) == 0


def test_agreement(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 0)], "item int, rater string, rating int")
    assert evaluate.agreement(df, "item", "rater", "rating").first()["agreement"] == 0.5


def test_stored_index_equals_the_built_one_and_reads_its_buckets(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9)) + " Straße café") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    for stemmed in (True, False):
        built = search.build_index(df, "id", "text", stemmed=stemmed)
        kept = search.store_index(built, f"{tmp_path}/{stemmed}", 8)
        for q in ("w3 OR w7", "w3 w7", '"w1 w2"', "w1*", "w5 NOT w2", "NEAR(w1 w4, 2)", "cafe", "nothing OR w9"):
            get = lambda i, q=q: {r["doc"]: round(r["rank"], 9) for r in search.ranked(i, q).collect()}
            assert get(kept) == get(built)
    plan = kept.rows(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters")[1]
    assert search.open_index(spark, f"{tmp_path}/True").stats() == (60, 10.0)
