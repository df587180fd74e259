import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.operators import activity, graph, privacy, retrieval, sessions, vectors
from mnemolake.streaming import flows


def ids(df, c="blocked"):
    return [r[c] for r in df.orderBy("i").collect()]


def apps(spark, entries, names):
    df = spark.createDataFrame(list(enumerate(names)), "i int, app string")
    return ids(privacy.block_apps(df, "app", privacy.app_list(spark, entries)))


def urls(spark, entries, names):
    df = spark.createDataFrame(list(enumerate(names)), "i int, url string")
    return ids(privacy.block_urls(df, "url", privacy.domain_list(spark, entries)))


def test_apps(spark):
    assert apps(spark, ["Arc"], ["Arc", "Architecture Tool", "Arcade Machine", None, ""]) == [True, False, False, False, False]
    assert apps(spark, ["s"], ["s", "Safari", "iOS Simulator"]) == [True, False, False]
    assert apps(spark, ["  Google   Chrome  "], ["Google Chrome", "Google Chrome Beta", "Google Meet", "google chrome"]) == [True, True, False, True]
    assert apps(spark, ["Password Manager Pro"], ["Password", "Manager"]) == [False, False]
    assert apps(spark, ["", "  "], ["Anything"]) == [False]


def test_urls(spark):
    names = ["https://bank.com/login", "https://online.bank.com/a?id=1", "https://burbank.com/", "https://bank.com.evil.example/", "https://example.com/bank.com/page", "https://example.com/?next=bank.com", "online.bank.com", "not a url at all", None, "https://user:pw@BANK.com:8443/x"]
    assert urls(spark, ["https://Bank.com:443"], names) == [True, True, False, False, False, False, True, False, False, True]
    assert urls(spark, ["mail.google.com"], ["https://mail.google.com/u", "https://a.mail.google.com/", "https://google.com/", "https://docs.google.com/"]) == [True, True, False, False]
    assert urls(spark, [".chase.com", ""], ["https://www.chase.com/", "x"]) == [True, False]


def test_safety_gate(spark):
    df = spark.createDataFrame([(0, "password: hunter2 ok"), (1, "fine"), (2, "fine")], "i int, t string")
    g = privacy.safety_gate(df, "t", F.col("i") == 2)
    assert ids(g, "decision") == ["Redact", "Allow", "SkipStorage"] and ids(g, "stored_text") == ["[password] ok", "fine", None]


SESS = "id string, session_id string, captured_at_ms bigint, app_name string, _block int, t int"


def by_hand(rows, gap):
    out = []
    for s, t in sorted({(r[1], r[2]) for r in rows if r[1] and r[2] and r[2] > 0}):
        if out and out[-1][0] == s and t - out[-1][2] <= gap:
            out[-1][2] = t
        else:
            out.append([s, t, t])
    return {tuple(x) for x in out}


def test_sessions_edges(spark):
    gap = 1_800_000
    t0 = 1_577_842_649_477
    times = [t0, t0 + gap, t0 + 2 * gap + 1, t0 + 50 * gap, t0 + 50 * gap + 32768 * 1000, t0 + 50 * gap + 32768 * 1000 + gap]
    rows = [(f"a{i}", "s", t, "X", 1, 2) for i, t in enumerate(times)] + [("a0", "s", t0, "X", 1, 2), ("n1", None, t0, "", 1, 2), ("n2", "", t0, "", 1, 2), ("n3", "s", 0, "", 1, 2), ("n4", "s", None, "", 1, 2), ("b", "q", t0, None, 1, 2)]
    df = spark.createDataFrame(rows, SESS)
    assert {tuple(r) for r in sessions.sessionize(df).select("session_id", "start_ms", "end_ms").collect()} == by_hand(rows, gap)
    assert sessions.session_app_counts(df).agg(F.sum("n_events")).first()[0] == 7
    assert sessions.sessionize(df.limit(0)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "q", ""]), st.integers(0, 40_000_000)), max_size=40))
def test_sessions_property(spark, events):
    rows = [(f"{s}{t}", s, t, "a", 0, 0) for s, t in events]
    got = {tuple(r) for r in sessions.sessionize(spark.createDataFrame(rows, SESS)).select("session_id", "start_ms", "end_ms").collect()}
    assert got == by_hand(rows, 1_800_000)


def test_closing():
    assert sessions.close_bitmap(b"\x00", 3) == [] and sessions.close_bitmap(bytes([0b10010001]), 3) == [(0, 0), (4, 7)] and sessions.close_bitmap(bytes([0b10010001]), 4) == [(0, 7)]


def vec_df(spark):
    return spark.createDataFrame([(i, [float(i), 1.0, 0.0], i % 2) for i in range(10)], "id bigint, v array<float>, g int")


def test_vectors(spark):
    df = vec_df(spark)
    assert [r["id"] for r in vectors.knn(df, "id", "v", [4.0, 1.0, 0.0], 3).collect()] == [4, 3, 5]
    assert [r["id"] for r in vectors.knn(df, "id", "v", [4.0, 1.0, 0.0], 2, F.col("g") == 1).collect()] == [3, 5]
    n = df.select(vectors.norm(vectors.renormalised(F.col("v"), 2)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-12 for r in n)
    with pytest.raises(Exception, match="non-zero vector of 4"):
        df.select(vectors.checked(F.col("v"), 4)).collect()
    indexed, c = vectors.ivf_cells(df, "id", "v", 3)
    assert vectors.ann(indexed, c, "id", "v", [4.0, 1.0, 0.0], 3, 3).count() == 3
    assert vectors.query_text("find", "x") == "Instruct: find\nQuery:x"


def test_rrf_does_not_depend_on_order(spark):
    rows = [("a", "k", 1), ("b", "k", 2), ("b", "v", 1), ("c", "v", 2)]
    one = {r["id"]: r["score"] for r in vectors.rrf(spark.createDataFrame(rows, "id string, route string, rank int")).collect()}
    two = {r["id"]: r["score"] for r in vectors.rrf(spark.createDataFrame(rows[::-1], "id string, route string, rank int")).collect()}
    assert one == two and max(one, key=one.get) == "b"


def test_retrieval_pieces(spark):
    assert retrieval.time_window("24h", 86_400_000) == (0, 86_400_000) and retrieval.time_window({"from": 1, "to": 2}, 0) == (1, 2)
    with pytest.raises(ValueError):
        retrieval.time_window("soon", 0)
    assert retrieval.plan("what was decided in the last 2 days", 200_000_000)["intent"] == "recall"
    hits = spark.createDataFrame([(i, "a" if i < 5 else "b", 10.0 - i, 100) for i in range(8)], "id int, app string, s double, n int")
    place = {r["id"]: r["place"] for r in retrieval.diversify(hits, "s", "id", "app").collect()}
    assert [place[i] for i in (0, 1, 2)] == [1, 2, 3] and place[5] == 4
    assert [r["id"] for r in retrieval.context_pack(hits, "id", "n", 250).collect()] == [0, 1]
    claims = spark.createDataFrame([("x", "r1"), ("x", "r2"), ("y", "r1"), ("y", "r1"), ("z", None)], "claim_id string, record_id string")
    assert {r["claim_id"]: r["verdict"] for r in retrieval.verdicts(claims).collect()} == {"x": "Grounded", "y": "PartialAnswer", "z": "NotEnoughEvidence"}
    e = retrieval.explain(hits, score=F.col("s") > 5, app=F.col("app") == "a")
    assert {r["id"]: r["dropped_by"] for r in e.collect()}[6] == "score"


def test_chunk_spans_equal_source(spark):
    text = "first line\nsecond líne\n\n" + "x" * 50 + "\nend"
    rows = retrieval.chunk_lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t", 30).collect()
    raw = text.encode()
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: r["ord"])) == text
    assert all(raw[r["span_start"] : r["span_end"]].decode() == r["text"] for r in rows)


TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def test_graph(spark):
    e = spark.createDataFrame(TRIANGLES, "src bigint, dst bigint")
    c = {r["node"]: r["label"] for r in graph.communities(e).collect()}
    assert len(set(c.values())) == 2 and c[1] == c[2] == c[3] and c[4] == c[5] == c[6]
    m = graph.modularity(e, graph.communities(e)).first()[0]
    assert m == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2)
    assert [r["node"] for r in graph.shortest_path(e, 1, 6).orderBy("step").collect()] == [1, 3, 4, 6]
    assert graph.shortest_path(e, 6, 1).count() == 0
    assert {r["node"]: r["depth"] for r in graph.neighbourhood(e, spark.createDataFrame([(1,)], "node bigint"), 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r["component"] for r in graph.components(e).collect()} == {1}
    cyc = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    assert {r["node"]: r["length"] for r in graph.cycles(cyc).collect()} == {1: 3, 2: 3, 3: 3}
    n = graph.neighbourhood(cyc, spark.createDataFrame([(1,)], "node bigint"), 10)
    assert n.count() == 4


def test_entities(spark):
    df = spark.createDataFrame([("r", "see LRK-12 and LRK-12 and @bob")], "id string, t string")
    e = graph.extract_entities(df, "id", "t", {"ticket": (r"[A-Z]+-\d+", 0.9), "person": (r"@\w+", 0.3)})
    assert [(r["kind"], r["name"]) for r in e.collect()] == [("ticket", "LRK-12")]
    a, b = (graph.node_ids(e, "kind", "name").first()["node_id"] for _ in range(2))
    assert a == b and a[14] == "5"
    with pytest.raises(Exception, match="unknown provenance"):
        graph.valid_provenance(spark.createDataFrame([("X",)], "provenance string")).collect()


def ev(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t + dt.timedelta(minutes=m), a) for i, (m, a) in enumerate([(0, "A"), (1, "B"), (2, "A"), (3, "A"), (200, "C")])]
    return spark.createDataFrame(rows, "i int, u int, ts timestamp, app string")


def test_activity(spark):
    e = ev(spark)
    assert [r["i"] for r in activity.back_and_forth(e, "u", ["ts"], "app").collect()] == [2]
    assert activity.without_consecutive(e, "u", ["ts"], F.col("app")).count() == 4
    assert activity.gap_sessions(e, "u", "ts", 1800).select("session").distinct().count() == 2
    assert activity.active_focus(e, "u", "ts", "app", 4 * 3600).first()["focus"] == "A"
    q = spark.createDataFrame([("r1", 0, 0, 100), ("r2", 0, 4, 100), ("r3", 0, 9, 100)], "record_id string, enqueued_at_ms bigint, attempts bigint, next_attempt_at_ms bigint")
    assert activity.due_reviews(q, 100).count() == 2
    after = {r["record_id"]: r for r in activity.after_attempt(q, F.lit(False), 100).collect()}
    assert after["r1"]["next_attempt_at_ms"] == 60_100 and after["r2"]["failed"]
    seg = spark.createDataFrame([(1, 0, 1_000_000)], "segment_id int, started_at_ms bigint, ended_at_ms bigint")
    rec = spark.createDataFrame([("a", 5), ("b", 999_999), ("c", 1_000_000)], "record_id string, captured_at_ms bigint")
    assert {r["record_id"] for r in activity.meeting_overlap(seg, rec).collect()} == {"a", "b"}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "id string, text string").coalesce(1).write.parquet(src)
    got = []
    q = flows.flush_stream(spark.readStream.schema("id string, text string").parquet(src), lambda b, e: got.extend(r["id"] for r in b.collect()), str(tmp_path / "cp"), None)
    q.awaitTermination(60)
    assert sorted(got) == ["a", "b"]
    ev(spark).write.parquet(str(tmp_path / "ev"))
    s = flows.session_stream(spark.readStream.schema("i int, u int, ts timestamp, app string").parquet(str(tmp_path / "ev")), "u", "ts")
    q = s.writeStream.outputMode("complete").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("sess").collect()) == [1, 4]
    r = flows.consecutive_stream(spark.readStream.schema("i int, u int, ts timestamp, app string").parquet(str(tmp_path / "ev")), "u", "ts", "app")
    q = r.writeStream.outputMode("append").format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(x["value"], x["n"]) for x in spark.table("changes").collect()] == [("A", 1), ("B", 1), ("A", 2)]


def test_many_equal_rows_go_to_the_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 3001)] + [(5000 + i, [1.0, 0.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    probe = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.6])], "id bigint, v array<double>")
    got = [(r["probe"], r["rank"], r["id"]) for r in vectors.knn_batch(df, "id", "v", probe, "id", "v", 5).collect()]
    assert sorted(got) == [(0, i, i) for i in range(1, 6)] + [(1, i, 4999 + i) for i in range(1, 6)]


def test_communities_of_a_ring_of_cliques(spark):
    edges = [(10 * c + a, 10 * c + b) for c in range(6) for a in range(5) for b in range(a + 1, 5)] + [(10 * c, 10 * ((c + 1) % 6) + 1) for c in range(6)]
    got = {r["node"]: r["label"] for r in graph.communities(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(len({got[10 * c + i] for i in range(5)}) == 1 for c in range(6))
    q = graph.modularity(spark.createDataFrame(edges, "src bigint, dst bigint"), graph.communities(spark.createDataFrame(edges, "src bigint, dst bigint"))).first()[0]
    assert q > 0.6


def test_cycles_among_trees(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (3, 1), (3, 100), (50, 1), (7, 7)]
    got = {r["node"]: r["length"] for r in graph.cycles(spark.createDataFrame(edges, "src bigint, dst bigint"), 4).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 7: 1}


def test_recall_of_cells_and_of_product_quantisation(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 1500)] + 0.3 * rng.standard_normal((1500, 32))).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").cache()
    q = vectors.ProductQuantiser.fit(df, "id", "v", parts=8, words=32)
    coded = df.withColumn("codes", q.encode(F.col("v"))).cache()
    cells, c = vectors.ivf_cells(df, "id", "v", 16)
    cells = cells.cache()
    hit = {"pq": 0, "cells": 0}
    for i in range(0, 1500, 150):
        probe = (x[i] + 0.05).tolist()
        best = {int(j) for j in np.lexsort((np.arange(1500), ((x - probe) ** 2).sum(1)))[:10]}
        hit["pq"] += len(best & {r["id"] for r in vectors.ann_pq(coded, q, "id", "v", "codes", probe).collect()})
        hit["cells"] += len(best & {r["id"] for r in vectors.ann(cells, c, "id", "v", probe, 10, 6).collect()})
    assert hit["pq"] >= 95 and hit["cells"] >= 90
