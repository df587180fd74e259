import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.llm import bpe, neighbours, runs, splitting

REC = "id string, session_id string, source string, app_name string, window_title string, captured_at_ms bigint, created_at_ms bigint, e string, key_a int, t int"


def rec(spark, rows):
    return spark.createDataFrame([(f"i{n}" if len(r) < 5 else r[4], r[0], "screen", r[2], r[3], r[1], 0, "x", 1, 2) for n, r in enumerate(rows)], REC)


def found(df):
    return {(r["session_id"], r["start_ms"], r["end_ms"], r["n"]) for r in runs.collapse_runs(df).collect()}


@pytest.mark.parametrize(
    "a,b",
    [
        ("Inbox", "(3) Inbox"), ("Inbox (20 unread)", "inbox"), ("● a.py", "a.py [+]"), ("a.py *", "a.py — Edited"), ("Plan Q3 (autosaved 07:04)", "Plan\xa0Q3*"), ("x – y", "x - y"),
        ("Week 2 review | 11 participants", "[00:21:03] Week 2 review"), ("~/a/b — 113×43", "⠋ ~/a/b"), ("72% docs", "🔊 docs"), ("Loading… docs", "▶ docs"), ("* #room", "! #room"),
        ("make it (running 01:57)", "[59%] make it"), ("plan - Last edit 9 min ago", "plan – Not responding"), (None, ""), ("Steady bucket outs…", "Steady bucket outside the gate"),
    ],
)
def test_titles_of_one_window(a, b):
    assert runs.title_dissimilarity(runs.title_key(a), runs.title_key(b)) == 0.0


@pytest.mark.parametrize("a,b", [("Plan Q2", "Plan Q3"), ("a_v4.py", "a_v5.py"), ("a.py", "a_test.py"), ("~/x/y", "~/x/y-old"), ("sync", "sync part 2"), ("page 5", "page 6"), ("#room1", "#room2"), ("", "x"), ("a…", "a")])
def test_titles_of_different_windows(a, b):
    assert runs.title_dissimilarity(runs.title_key(a), runs.title_key(b)) > 0


def test_runs_edges(spark):
    g = runs.GAP_MS
    rows = [("s", 1, "App", "T"), ("s", 1 + g, " app ", "(2) T"), ("s", 2 + 2 * g, "App", "T"), ("s", 3 + 2 * g, "Other", "T"), ("s", 4 + 2 * g, None, ""), ("s", 5 + 2 * g, "", None)]
    rows += [(None, 5, "App", "T"), ("", 6, "App", "T"), ("s", 0, "App", "T"), ("s", None, "App", "T"), ("s", 1, "App", "T", "i0")]
    want = {("s", 1, 1 + g, 2), ("s", 2 + 2 * g, 2 + 2 * g, 1), ("s", 3 + 2 * g, 3 + 2 * g, 1), ("s", 4 + 2 * g, 5 + 2 * g, 2)}
    assert found(rec(spark, rows)) == want
    assert found(rec(spark, rows).limit(0)) == set()


def test_one_session_over_many_tasks(spark):
    rows = [("hot", i * 1000, "A", "T1" if i < 700 else "T2") for i in range(1, 1500)]
    assert found(rec(spark, rows)) == {("hot", 1000, 699000, 699), ("hot", 700000, 1499000, 800)}


def run_cost(keys):
    """By definition, over all pairs within reach."""
    d, n = runs.title_dissimilarity, len(keys)
    return sum(d(keys[i], keys[j]) * (1 if j == i + 1 else 1 / runs.REACH) for i in range(n) for j in range(i + 1, min(n, i + runs.REACH + 1)))


def least_cost(keys, penalty):
    f = [0.0]
    for j in range(1, len(keys) + 1):
        f.append(min(f[i] + run_cost(keys[i:j]) + penalty for i in range(j)))
    return f[-1]


TITLES = [runs.title_key(x) for x in ("alpha plan", "alpha plan two", "beta", "alp…", "alpha pl…")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(TITLES), min_size=1, max_size=14), st.sampled_from([0.2, 0.7, 1.5, 3.0]))
def test_pruned_programme_is_optimal(keys, penalty):
    got = runs.best_segmentation(keys, penalty)
    assert [a for a, _ in got] == [0] + [z + 1 for _, z in got[:-1]] and got[-1][1] == len(keys) - 1
    assert abs(sum(run_cost(keys[a : z + 1]) + penalty for a, z in got) - least_cost(keys, penalty)) < 1e-9


def test_programme_weighs_the_run_not_only_neighbours():
    a, b = TITLES[0], TITLES[1]
    cut = [i for i in range(1, 9) if [a, a, a, b, a, a, a, b, b][i] != [a, a, a, b, a, a, a, b, b][i - 1]]
    assert cut == [3, 4, 7]
    # one event between is bridged, a lasting change is not
    assert runs.best_segmentation([a, a, a, b, a, a, a] + [b] * 9, 1.4) == [(0, 6), (7, 15)]
    # with the default penalty every change of the window ends the run
    assert runs.best_segmentation([a, a, a, b, a, a, a, b, b], runs.PENALTY) == [(0, 2), (3, 3), (4, 6), (7, 8)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["alpha plan", "Alpha Plan*", "alpha plan two", "beta", "alp…"]), st.integers(0, 3), st.booleans()), min_size=1, max_size=24), st.sampled_from([0.2, 0.7, 1.5]), st.integers(1, 5))
def test_tasks_are_joined_by_the_programme(events, penalty, parts):
    import pandas as pd

    t, rows = 0, []
    for title, step, gap in events:
        t += 5000 if gap and step == 0 else step
        rows.append(("s", t, t, "a", title, 1, False))
    cols = ["e", "t", "z", "app", "title", "n", "begins"]

    def go(pieces):
        settled, ends = [], []
        for p in pieces:
            r = pd.concat(list(runs._segment(1000, penalty, runs.title_dissimilarity, False)(iter([p]))) or [pd.DataFrame(columns=runs.COLUMNS)])
            done = r["settled"].astype(bool)
            settled += r[done][["start_ms", "end_ms", "n"]].values.tolist()
            ends.append(r[~done].sort_values("place"))
        e = pd.concat(ends)[["session_id", "start_ms", "end_ms", "app_name", "window_title", "n", "begins"]].set_axis(cols, axis=1).astype({"n": int, "begins": bool, "t": int, "z": int})
        for r in runs._segment(1000, penalty, runs.title_dissimilarity, True)(iter([e])):
            settled += r[["start_ms", "end_ms", "n"]].values.tolist()
        return sorted(settled)

    df = pd.DataFrame(rows, columns=cols)
    size = max(1, -(-len(df) // parts))
    cut, one = go([df.iloc[i : i + size] for i in range(0, len(df), size)]), go([df])
    assert sum(x[2] for x in cut) == len(rows) == sum(x[2] for x in one)
    if penalty == runs.PENALTY:
        assert cut == one


def test_memory_of_a_long_run_is_flat():
    import tracemalloc

    import pandas as pd

    def batches(n):
        for lo in range(0, n, 10_000):
            t = np.arange(lo, lo + 10_000)
            yield pd.DataFrame({"e": "s", "t": t, "z": t, "app": "a", "title": np.where(t % 2, "(1) Inbox", "Inbox"), "n": 1, "begins": False})

    def peak(n):
        tracemalloc.start()
        rows = sum(len(x) for x in runs._segment(1000, runs.PENALTY, runs.title_dissimilarity, False)(batches(n)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 1
        return most

    assert peak(400_000) < 1.5 * peak(50_000)


# pieces

CH = "id string, record_id string, ord bigint, text string, no int, start int, n_pieces int"


def pieces(spark, rows, **kw):
    return splitting.split_texts(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], CH), **kw)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,\n\ré́日。", max_size=400), st.sampled_from([(50, 10), (37, 0), (40, 19)]))
def test_cuts_cover_the_text(text, size):
    limit, overlap = size
    p = splitting.cut_points(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for (a, z), (b, y) in zip(p, p[1:]):
        assert z - a <= limit and y - b <= limit and a < b <= z and z - b <= overlap and y > z


def test_cuts_at_the_strongest_boundary():
    text = "a" * 30 + ". " + "b" * 20 + "\n\n" + "c" * 20 + " " + "d" * 60
    assert splitting.cut_points(text, 80, 0)[0] == (0, 54)


def test_range_max_takes_the_rightmost():
    t = splitting.RangeMax(np.array([1, 3, 2, 3, 1], np.int8), 5)
    assert t.best(0, 4) == (3, 3) and t.best(0, 2) == (1, 3) and t.best(4, 4) == (4, 1)


def test_pieces_keep_everything_and_renew_ord(spark):
    rows = [("r-c1", "r", 1, "x " * 900), ("r-c0", "r", 0, "short"), ("r-c2", "r", 2, None), ("r-c3", "r", 3, ""), ("r-c0", "r", 0, "short"), ("q-c0", "q", 0, "y" * 3000), ("n", None, None, "z"), ("r-c5000", "r", 5000, "far")]
    out = pieces(spark, rows).collect()
    r = sorted((x for x in out if x["record_id"] == "r"), key=lambda x: x["ord"])
    assert [x["ord"] for x in r] == list(range(6)) and [x["id"] for x in r] == ["r-c0", "r-c1", "r-c1", "r-c2", "r-c3", "r-c5000"]
    assert all(len(x["text"] or "") <= 1200 for x in out) and sum(x["id"] == "n" for x in out) == 1
    q = sorted((x for x in out if x["record_id"] == "q"), key=lambda x: x["ord"])
    assert q[0]["text"] + "".join(b["text"][a["end"] - b["start"] :] for a, b in zip(q, q[1:])) == "y" * 3000
    assert pieces(spark, rows).limit(0).count() == 0 and splitting.split_texts(spark.createDataFrame([], CH)).count() == 0


# encoding


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.load(bpe.DEFAULT_VOCAB)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_public_encoder(vocab, text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    assert vocab.encode(text) == enc.encode_ordinary(text)


def test_encoding_of_long_pieces_and_round_trip(vocab):
    back = {v: k for k, v in vocab.ranks.items()}
    for text in ("ab" * 5000, "\n" * 3000, "日本" * 800, "<|endoftext|> x"):
        assert b"".join(back[i] for i in vocab.encode(text)).decode() == text


def test_encoding_of_tables(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2 and bpe.encode_texts(df.limit(0)).count() == 0


# vectors

VEC = "id string, vector array<float>, h int, cosine int"


def near(spark, rows, k=3, dim=8):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VEC)
    return {(r["id_a"], r["id_b"]) for r in neighbours.near_pairs(df, k=k, dim=dim).collect()}


def brute(rows, k=3, dim=8):
    ok = {i: np.array(v, float) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for a, x in ok.items():
        c = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), b) for b, y in ok.items() if b != a)
        out |= {(min(a, b), max(a, b)) for _, b in c[:k]}
    return out


def test_vectors_small_and_dirty(spark):
    rng = np.random.default_rng(0)
    rows = [(f"v{i:02d}", rng.standard_normal(8).round(2).tolist()) for i in range(30)]
    rows += [("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [math.nan] + [1.0] * 7), ("inf", [math.inf] + [1.0] * 7), ("hole", [None] + [1.0] * 7), rows[0]]
    assert near(spark, rows) == brute(rows)
    assert near(spark, []) == set() and near(spark, rows[:1]) == set() and near(spark, [("zero", [0.0] * 8)]) == set()


def test_copies_take_the_smaller_ids(spark):
    rows = [(f"c{i}", [1.0, 2.0] + [0.0] * 6) for i in range(7)] + [("d", [1.0, 2.1] + [0.0] * 6), ("e", [0.0, 0.0, 1.0] + [0.0] * 5)]
    assert near(spark, rows) == brute(rows)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = np.repeat(rng.standard_normal((300, 64)), 4, axis=0)
    x = (base + 0.6 * rng.standard_normal(base.shape)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), 0, 0) for i, v in enumerate(x)], VEC)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.near_pairs(df, dim=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{min(i, j):05d}", f"{max(i, j):05d}") for i in range(len(x)) for j in np.argsort(-s[i])[:3]}
    assert len(got & want) / len(want) > 0.9


def test_packing_has_no_loss():
    rng = np.random.default_rng(1)
    for v in (rng.standard_normal(768), rng.standard_normal(768).round(3), rng.integers(0, 9, 768) / 7, np.array([-0.0, 1e30, 1e-30])):
        v = v.astype(np.float32)
        assert (neighbours.unpack(neighbours.pack(v)) == v).all()


@pytest.mark.parametrize("cell_mean,part_rows,hot", [(20, 20_000, False), (500, 300, False), (500, 300, True)])
def test_many_leaves_and_descended_parts(spark, monkeypatch, cell_mean, part_rows, hot):
    """Two levels of symbols; prefixes descended bit by bit; a third of all rows crowded together."""
    monkeypatch.setattr(neighbours, "CELL_MEAN", cell_mean)
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    rng = np.random.default_rng(5)
    base = np.repeat(rng.standard_normal((750, 32)), 4, axis=0)
    if hot:
        base[:1000] = 0.3 * base[:1000] + rng.standard_normal(32)
    x = (base + 0.1 * rng.standard_normal(base.shape)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), 0, 0) for i, v in enumerate(x)], VEC)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.near_pairs(df, dim=32).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{min(i, j):05d}", f"{max(i, j):05d}") for i in range(len(x)) for j in np.argsort(-s[i])[:3]}
    assert len(got & want) / len(want) >= 0.9


def test_neighbours_share_a_leaf_when_leaves_are_many(monkeypatch):
    """Rows of a few topics: with many leaves near rows still share one, and no leaf is near to all."""
    monkeypatch.setattr(neighbours, "CELL_MEAN", 10)
    rng = np.random.default_rng(8)
    topic = 0.8 * rng.standard_normal((8, 256)).repeat(750, axis=0)
    base = np.repeat(topic + rng.standard_normal((6000, 256)), 4, axis=0)
    x = base + 0.7 * rng.standard_normal(base.shape)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    book = neighbours.Codebook(x[rng.permutation(len(x))[:16_000]], len(x))
    leaf = np.concatenate([book.leaves(x[i : i + 2000]) for i in range(0, len(x), 2000)])
    four = leaf.reshape(-1, 4, leaf.shape[1])
    assert (four[:, 0, :, None] == four[:, 1, None, :]).any((1, 2)).mean() >= 0.995
    assert np.bincount(leaf[leaf >= 0]).max() < 0.02 * len(x)


def test_forest_of_one_part():
    rng = np.random.default_rng(6)
    base = np.repeat(rng.standard_normal((1500, 64)), 4, axis=0)
    x = base + 0.5 * rng.standard_normal(base.shape)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = neighbours.forest_pairs(*neighbours.hash_strings(x, neighbours.projection(64)))
    have = set(map(tuple, pairs.tolist()))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = [(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:3]]
    assert sum((i, j) in have or (j, i) in have for i, j in want) / len(want) >= 0.95
    assert len(pairs) <= len(x) * neighbours.COMPARED  # far from all pairs


def test_rank_and_cosine(spark):
    rows = [("a", [1.0] + [0.0] * 7), ("b", [1.0, 0.1] + [0.0] * 6), ("c", [0.0, 1.0] + [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VEC)
    r = {(x["id"], x["rank"]): (x["neighbour"], round(x["cosine"], 4)) for x in neighbours.nearest(df, k=2, dim=8).collect()}
    assert r[("a", 1)] == ("b", 0.995) and r[("a", 2)] == ("c", 0.0)
    assert neighbours.nearest(df.filter(F.lit(False)), k=2, dim=8).count() == 0
