import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import activity, codegraph, retrieval, search, vectors
from mnemolake.plans import tools
from mnemolake.sources import readers
from mnemolake.sources.store import Store

REC = "id string, session_id string, source string, app_name string, window_title string, captured_at_ms bigint, created_at_ms bigint, text string"
ROWS = [
    ("a", "s", "screen", "Code", "src/main.rs", 1000, 1100, "scalar index notes"), ("b", "s", "screen", "Safari", "see https://x.example/y now", 2000, 2100, "zebra crossing"),
    ("c", "q", "meeting", "Mail", "Inbox", 9_000_000, 9_000_100, "index of the zebra"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, REC)


def test_find_and_pack(spark, records):
    index = search.build_index(records, "id", "text")
    hits = tools.find(records, index, "index", 10_000_000)
    assert {r["id"] for r in hits.collect()} == {"a", "c"} and "rank" not in hits.columns
    assert [r["id"] for r in tools.find(records, index, "index", 10_000_000, window={"from": 5000}).collect()] == ["c"]
    assert [r["id"] for r in tools.find(records, index, "index", 0, app="code").collect()] == ["a"]
    ranked = search.search(index, records, "id", "zebra OR index")
    assert tools.context_pack(ranked, 5).count() == 1


def test_timeline_focus_delta(spark, records):
    assert {r["app_name"]: r["n"] for r in tools.timeline(records, "app").collect()} == {"Code": 1, "Safari": 1, "Mail": 1}
    assert tools.timeline(records, "hour").count() == 2
    assert {r["session_id"]: r["latest"] for r in tools.active_focus(records).collect()} == {"s": "Safari", "q": "Mail"}
    assert [r["id"] for r in tools.delta(records, 3000).collect()] == ["c"]


def test_targets_evidence_privacy(spark, records):
    got = {i: tuple(tools.open_target(records, i).first())[1:] for i in "abc"}
    assert got == {"a": ("file", "src/main.rs"), "b": ("url", "https://x.example/y"), "c": ("app", "Mail")}
    texts = spark.createDataFrame([("a", "raw", "clean")], "record_id string, raw_text string, cleaned_text string")
    assert "raw_text" not in tools.source_evidence(records, texts, ["a"]).columns
    assert tools.source_evidence(records, texts, ["a"], True).first()["raw_text"] == "raw"
    e = spark.createDataFrame([("x",)], "entry string")
    assert tuple(tools.privacy_status(records, e, e).first()) == (3, 1, 1)


def test_answer_and_story(spark, records):
    claims = spark.createDataFrame([(1, "zebra crossing"), (2, "nothing known")], "claim_id int, text string")
    chunks = spark.createDataFrame([("k1", "r1", "the zebra crossing"), ("k2", "r2", "zebra at a crossing"), ("k3", "r3", "zebra")], "id string, record_id string, text string")
    assert {r["claim_id"]: r["verdict"] for r in tools.answer(claims, chunks).collect()} == {1: "Grounded", 2: "NotEnoughEvidence"}
    s = {(r["session_id"], r["session"]): len(r["story"]) for r in tools.session_story(records).collect()}
    assert s == {("s", 1): 2, ("q", 1): 1}


def test_decisions_and_projects(spark, records, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    tools.remember_decision(store, 5, "use parquet", "a")
    tools.remember_decision(store, 6, "fix the error later", None)
    tasks = spark.createDataFrame([("t", "write it", 0, "a", 9)], "id string, title string, status bigint, source_record_id string, due_at_ms bigint")
    ledger = store.table("decision_ledger")
    assert sorted(r["id"] for r in ledger.collect()) == [1, 2]
    assert retrieval.recall_kind(ledger, tasks, "errors").count() == 1
    kinds = {r["kind"] for r in tools.project_context(records, tasks, ledger, F.col("source") == "screen").collect()}
    assert kinds == {"activity", "todos", "decisions"}


def test_insight(spark):
    df = spark.createDataFrame([("Chrome", "New Tab", "Home\nImplement robust cleanup for the capture pipeline because it must survive.")], "a string, t string, x string")
    i = df.select(tools.insight(F.col("a"), F.col("t"), F.col("x")).alias("i")).first()["i"]
    assert "Home" not in i["cleaned_text"] and i["summary"].startswith("Implement robust") and i["embedding_text"].startswith("Chrome\nNew Tab\n")


def test_code_graph(spark):
    e = spark.createDataFrame(
        [("f", "g", "CALLS", "EXTRACTED", 1.0, "a:1"), ("g", "h", "CALLS", "INFERRED", 0.6, "a:2"), ("h", "z", "CALLS", "AMBIGUOUS", 0.2, "a:3"), ("t", "g", "TESTS", "EXTRACTED", 1.0, "b:1")],
        codegraph.EDGES,
    )
    assert codegraph.checked_edges(e).count() == 4
    assert [r["node"] for r in codegraph.callees(e, "f").collect()] == ["g"] and [r["node"] for r in codegraph.callers(e, "h").collect()] == ["g"]
    seeds = spark.createDataFrame([("h",)], "node string")
    assert {r["node"]: r["depth"] for r in codegraph.blast_radius(e, seeds).collect()} == {"h": 0, "g": 1, "f": 2, "t": 2}
    assert {r["node"] for r in codegraph.dependencies(e, spark.createDataFrame([("f",)], "node string"), 5, ["CALLS"]).collect()} == {"f", "g", "h"}
    assert codegraph.compact_subgraph(e, spark.createDataFrame([("f",)], "node string"), 1, 1).count() == 1
    n = spark.createDataFrame([("1", "Function", "parse_query", "a"), ("2", "Class", "Parser", "a")], codegraph.NODES)
    assert codegraph.find_symbols(codegraph.checked_nodes(n), "parser").first()["id"] == "2"
    with pytest.raises(Exception, match="unknown relationship"):
        codegraph.checked_edges(e.withColumn("kind", F.lit("LIKES"))).collect()


def test_lag_over_days(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 0)
    rows = [("u", i, t0 + dt.timedelta(minutes=25 * i)) for i in range(200)] + [("w", 900, t0)]
    df = spark.createDataFrame(rows, "u string, i int, ts timestamp")
    got = activity.lagged(df, "u", "ts", ["ts", "i"], {"p1": ("i", 1), "p3": ("i", 3)}).collect()
    assert len(got) == 201 and all((r["p1"], r["p3"]) == (r["i"] - 1 if r["i"] >= 1 else None, r["i"] - 3 if r["i"] >= 3 else None) for r in got if r["u"] == "u")
    s = activity.gap_sessions(df, "u", "ts", 20 * 60)
    assert {r["i"]: r["session"] for r in s.collect() if r["u"] == "u"} == {i: i + 1 for i in range(200)}
    k = activity.sampling(df, "u", "ts", 60, 1500)
    assert k.filter("captured").count() == 201


def test_admission_of_captures(spark):
    df = spark.createDataFrame([(0, "New Tab", "Home", "Chrome"), (1, "x", "https://a.example/b", "Chrome"), (2, "x", " ", "Chrome"), (3, "Plan", "a long and useful text about the launch of the new search", "Notes")], "i int, t string, x string, a string")
    r = {x["i"]: x["reason"] for x in activity.capture_admission(df, "t", "x", "a").collect()}
    assert r == {0: "navigation", 1: "url_only", 2: "empty", 3: None}


def test_ocr_settings(spark):
    df = spark.createDataFrame([("ok fine\nOK fine\nThis is actual content",)], "t string")
    assert df.select(T.OcrConfig().normalize(F.col("t"))).first()[0] == "ok fine\nThis is actual content"
    assert df.select(T.OcrConfig.fast().normalize(F.col("t"))).first()[0] == df.first()[0]


def test_rerank_probe_rows_and_repeats(spark, tmp_path):
    hits = spark.createDataFrame([(1, 0.9, "short"), (2, 0.5, "a much longer text")], "id int, score double, text string")
    assert [r["id"] for r in retrieval.rerank(hits, "score").collect()] == [1, 2]
    assert [r["id"] for r in retrieval.rerank(hits, "score", lambda s: s.str.len()).collect()] == [2, 1]
    rows = readers.synthetic_rows(spark, 20, 8)
    assert rows.filter(F.size("vector") == 8).count() == 20 and rows.filter("source = 'meeting'").count() == 4
    assert {(r["probe"], r["id"]) for r in vectors.knn_batch(rows, "id", "vector", rows.filter("id < 3"), "id", "vector", 1).collect()} == {(0, 0), (1, 1), (2, 2)}
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 10, [1.0, 0.01]), ("c", 5000, [1.0, 0.0])], "id string, t bigint, v array<double>")
    assert [r["id"] for r in vectors.semantic_repeats(v, "id", "t", "v", 100, 0.99).collect()] == ["b"]
    readers.write_digest(hits, str(tmp_path / "d"), "id")
    assert spark.read.text(str(tmp_path / "d")).count() == 2


def test_importers(spark, tmp_path):
    import sqlite3

    from mnemolake.sources import readers

    (tmp_path / "sh").mkdir()
    (tmp_path / "sh" / "a").write_text("#1700000000\nmake mill\nls\n: 1700000005:3;turn wheel\n\n")
    got = {(r["text"], r["captured_at_ms"], r["title"]) for r in readers.import_shell_history(spark, str(tmp_path / "sh")).collect()}
    assert got == {("make mill", 1_700_000_000_000, "make"), ("ls", 0, "ls"), ("turn wheel", 1_700_000_005_000, "turn")}
    (tmp_path / "log").write_text("commit abcdef12\nAuthor: A <a@b.example>\nDate:   1700000000\n\n    Weigh sacks\n\n    All of them.\n\ncommit 99887766\nAuthor: B\nDate:   1700000100\n\n    Second\n")
    got = {(r["id"], r["title"], r["captured_at_ms"]) for r in readers.import_git_log(spark, str(tmp_path / "log")).collect()}
    assert got == {("abcdef12", "Weigh sacks", 1_700_000_000_000), ("99887766", "Second", 1_700_000_100_000)}
    (tmp_path / "db").mkdir()
    db = sqlite3.connect(tmp_path / "db" / "History")
    db.executescript("CREATE TABLE urls (id, url, title); CREATE TABLE visits (id, url, visit_time); INSERT INTO urls VALUES (1, 'https://mill.example', 'Mill'); INSERT INTO visits VALUES (5, 1, 13344473600000000)")
    db.commit()
    db.close()
    r = readers.import_browser_history(spark, str(tmp_path / "db")).first()
    assert (r["title"], r["text"], r["captured_at_ms"]) == ("Mill", "https://mill.example", 1_700_000_000_000)


def test_gate_command(spark, tmp_path):
    import json

    from mnemolake.plans import gate

    (tmp_path / "records.jsonl").write_text('{"id":1,"source":"screen","captured_at_ms":5,"text":"nine sacks of rye"}\n{"id":2,"source":"screen","captured_at_ms":6,"text":"the ferry"}\n')
    (tmp_path / "queries.jsonl").write_text('{"query":"rye","relevant":[1]}\n')
    report = tmp_path / "r.json"
    assert gate.main([str(tmp_path), "--report", str(report)], spark) == 0
    assert json.loads(report.read_text())["recall_at_5"] == 1.0
    assert gate.main([str(tmp_path), "--baseline", str(report)], spark) == 0
    (tmp_path / "better.json").write_text(json.dumps({"recall_at_5": 1.0, "mrr_at_10": 1.1}))
    assert gate.main([str(tmp_path), "--baseline", str(tmp_path / "better.json")], spark) == 1
    assert gate.main([str(tmp_path), "--baseline", str(tmp_path / "none.json")], spark) == 1
    assert gate.main([str(tmp_path / "nowhere")], spark) == 2 and gate.main(["--what"], spark) == 2


def test_scale_probe(spark, tmp_path):
    from mnemolake.operators import evaluate

    r = evaluate.scale_probe(spark, str(tmp_path), 500, 3)
    assert r["rows"] == 500 and 0 < r["keyword_p50_ms"] <= r["keyword_p95_ms"] and 0 < r["vector_p50_ms"]
