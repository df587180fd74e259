import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mnemolake.llm import boilerplate, leakage, ocr_repair, pii, spans

# boilerplate

CORPUS = "id bigint, source string, captured_at_ms bigint, text string, lk string, cluster int, day int"
CHUNKS = "chunk_id string, record_id string, ord bigint, text string, source string, captured_at_ms bigint"
RECS = "id string, app_name string"


def removed(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], CORPUS)
    return {(r["row_key"], r["line_no"]) for r in boilerplate.repeated_lines(boilerplate.corpus_texts(df), boilerplate.bodies(df), **kw).collect()}


def test_lines_over_different_texts_only(spark):
    rows = [(i, "s", 10**12, f"own words of text {chr(97 + i) * 5}\nAll rights {i} RESERVED here") for i in range(8)]
    assert removed(spark, rows) == {(str(i), 2) for i in range(8)}
    copies = [(i, "s", 10**12, "the same article\nAll rights reserved here") for i in range(30)]
    assert removed(spark, copies) == set()
    assert removed(spark, rows[:7]) == set()
    assert removed(spark, rows + [rows[0]]) == removed(spark, rows)
    assert removed(spark, [(i, f"s{i}", 0, r[3]) for i, r in enumerate(rows)]) == set()
    assert removed(spark, [(i, None, None, r[3]) for i, r in enumerate(rows)] + [(99, "s", 0, None), (98, "s", 0, "")]) == set()
    assert removed(spark, []) == set()


def test_dates_of_first_capture_decide_if_asked(spark):
    day = 86_400_000
    rows = [(i, "s", day * (20 + i % 3) + 5, f"own words of text {chr(97 + i) * 5}\nAll rights reserved here\nAll rights reserved here") for i in range(9)]
    assert removed(spark, rows, min_days=3) == {(str(i), n) for i in range(9) for n in (2, 3)}
    assert removed(spark, rows, min_days=4) == set()
    copies = [(100 + i, "s", day * (40 + i), rows[0][3]) for i in range(5)]  # captured again later: no new date
    assert removed(spark, rows + copies, min_days=4) == set()


def test_one_text_in_many_groups(spark):
    body = "shared body line of all\nsecond common line here"
    rows = [(i, f"s{i % 3}", 0, body) for i in range(30)] + [(50 + i, "s1", 0, f"second common line here\n{chr(97 + i) * 9}") for i in range(7)]
    assert removed(spark, rows) == {(str(i), 2) for i in range(30) if i % 3 == 1} | {(str(50 + i), 1) for i in range(7)}


def test_short_lines_are_no_cases(spark):
    assert removed(spark, [(i, "s", 0, f"abc 1234567 def\nbody {chr(97 + i) * 6}") for i in range(9)]) == set()


def test_chunk_groups_and_cleaning(spark):
    chunks = [(f"c{i}", f"r{i}", 0, f"Print  Export  Copy link\nbody {chr(97 + i) * 6}", "screen", 5) for i in range(10)]
    recs = [(f"r{i}", " App " if i % 2 else "app") for i in range(8)] + [("r8", None), ("r9", "")]
    c, r = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(recs, RECS)
    t = boilerplate.chunk_texts(c, r, "text")
    f = boilerplate.repeated_lines(boilerplate.chunk_texts(c, r), boilerplate.bodies(c))
    assert {r["row_key"] for r in f.collect()} == {f"c{i}" for i in range(8)}
    out = {r["row_key"]: (r["text"], r["n_removed"]) for r in boilerplate.without_lines(t, f).collect()}
    assert out["c0"] == ("body aaaaaa", 1) and out["c8"][1] == 0 and len(out) == 10


# shared spans


def texts_df(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, rep string, h int")


def shared_by_hand(texts, n):
    g = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else set() for t in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if g[a] & g[b]}


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é日") for _ in range(n))
    core = word(400)
    texts = [word(500), None, "", "short", core, word(100) + core[50:351] + word(90), core[:299] + word(300), word(200) + core[99:400], core, "a" * 700, "a" * 320, "b" + "a" * 299, word(3000) + core[10:310] + word(3000)]
    got = {tuple(r) for r in spans.shared_pairs(texts_df(spark, texts)).collect()}
    assert got == shared_by_hand(texts, 300) and (4, 8) in got and (4, 6) not in got and (9, 10) in got
    assert spans.shared_pairs(texts_df(spark, texts).limit(0)).count() == 0
    cov = {r["doc_id"]: r for r in spans.shared_coverage(texts_df(spark, texts)).collect()}
    assert cov[5]["shared_chars"] == 301 and cov[4]["copies"] == 2 and cov[4]["shared_chars"] == 400 and 0 not in cov


def test_many_occurrences_take_the_hashed_way(spark, monkeypatch):
    monkeypatch.setattr(spans, "MANY", 3)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = word(320)
    texts = [word(50 + i) + core[: 320 - 5 * i] + word(60) for i in range(9)]
    got = {tuple(r) for r in spans.shared_pairs(texts_df(spark, texts)).collect()}
    assert got == shared_by_hand(texts, 300)


def test_phrase_hashes():
    t = "abcabcabcabcabcabc"
    h = spans.phrase_hashes(t, 5)
    assert len(h) == 14 and h[0] == h[3] and h[0] != h[1] and len(spans.phrase_hashes("ab", 5)) == 0
    for w in (3, 7, 20):
        places = spans.winnow(h, w)
        for i in range(len(h) - w + 1):
            assert any(i <= p < i + w for p in places)


def coverage_by_hand(texts, n):
    out = {}
    for a, t in enumerate(texts):
        others = {u[i : i + n] for u in {x for b, x in enumerate(texts) if b != a and x} for i in range(len(u) - n + 1)} if t else set()
        hit = set()
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in others:
                hit |= set(range(i, i + n))
        if hit:
            out[a] = len(hit)
    return out


def test_coverage_equals_brute_force(spark):
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    licence, long = own(310), own(900)
    texts = [own(rng.choice([0, 50, 400])) + licence + own(rng.choice([0, 30, 500])) for _ in range(90)]  # above MANY
    texts += [own(200) + long[a : a + n] + own(200) for a, n in ((0, 900), (100, 420), (300, 299), (350, 300), (500, 400))]
    texts += [own(700), own(700), None, "", texts[3], texts[3], own(60) + licence[:299], licence[5:]]
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_coverage(texts_df(spark, texts)).collect()}
    assert got == coverage_by_hand(texts, 300)
    assert {tuple(r) for r in spans.shared_pairs(texts_df(spark, texts)).collect()} == shared_by_hand(texts, 300)


# leaks


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(docs)], "doc_id bigint, text string, w string, cosine double")
    q = spark.createDataFrame([(i, t, "q words", [1]) for i, t in enumerate(items)], "item_id bigint, text string, query string, relevant array<bigint>")
    return {(r["doc_id"], r["item_id"], r["verbatim"]) for r in leakage.leaked_items(d, q, **kw).collect()}


def test_leaks(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    item, short = words(26), words(9)
    text = lambda w: " ".join(w)
    docs = [
        text(words(60)), text(words(40) + item[5:18] + words(40)).upper(), text(words(40) + item[5:17] + words(40)), text(words(11) + short + words(50)), text(words(20) + short[:8] + words(9)),
        None, "", text(item), ", ".join(item[3:20]), text(words(3000) + item[13:] + words(3000)),
    ]
    got = {(d, i) for d, i, v in leaks(spark, docs, [text(item), text(short), None, ""]) if v}
    assert got == {(1, 0), (3, 1), (7, 0), (8, 0), (9, 0)}
    assert leaks(spark, docs, []) == set() and leaks(spark, [], [text(item)]) == set()


def test_paraphrases(spark):
    rng = random.Random(7)
    item = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(24)]
    near = [w if i % 6 else "zzzz" for i, w in enumerate(item)]
    others = [" ".join(rng.sample(item, 3) + ["other"] * 20) for _ in range(40)]
    got = leaks(spark, [" ".join(near), *others], [" ".join(item)], paraphrases=True)
    assert (0, 0, False) in got and all(d == 0 for d, _, _ in got)


def test_candidates_find_planted_runs():
    """Recall of the latent candidates against a scan, over leaks at any place of the passages and of the items."""
    import numpy as np

    rng = random.Random(11)
    common = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    rare = ["".join(rng.choice("fghijklmnop") for _ in range(7)) for _ in range(900)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    texts = [words(rng.choice([20, 26, 40, 90])) for _ in range(60)]
    items = leakage.Items([(i, " ".join(t), "") for i, t in enumerate(texts)])
    docs, planted = [], []
    for d in range(600):
        w = words(150)
        if d % 2:
            k = rng.randrange(60)
            a = rng.randrange(len(texts[k]) - 12)
            at = rng.randrange(138)
            w[at : at + 13] = texts[k][a : a + 13]
            planted.append((d, k))
        docs.append(np.array([items.vocab.get(x, -1) for x in w], np.int32))
    p = leakage.Passages(docs, items.size, 13)
    n = np.bincount(p.known, minlength=items.size)
    idf = np.log1p(p.n_segs / (1 + n)) ** leakage.SHARP + 0.05
    q = np.linalg.qr(rng_matrix := np.random.default_rng(3).standard_normal((items.size, 192)))[0]
    acc = np.zeros_like(rng_matrix)
    s = p.sums(np.concatenate([q * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32))
    p.spread(s[:, :-1] / s[:, -1:], acc, idf.astype(np.float32))
    slow = np.zeros_like(acc)  # the same product passage by passage
    for a, z in zip(p.at, p.to):
        w = p.flat[a:z]
        w = w[w >= 0]
        np.add.at(slow, w, idf[w, None] * (q[w] * idf[w, None]).sum(0) / (idf[w] ** 2).sum())
    assert np.allclose(acc, slow, rtol=1e-3, atol=1e-3 * np.abs(slow).max())
    space = leakage.LatentSpace(idf, np.linalg.qr(acc)[0])
    index = leakage.ProbeIndex(items, space, [d for d in docs[::2]])
    row, item, _ = index.candidates(leakage._unit(p.sums(space.table)))
    exact = leakage._verbatim(items, p, row, item)
    found = set(zip(p.doc[row[exact]].tolist(), item[exact].tolist()))
    assert sum(x in found for x in planted) / len(planted) >= 0.99
    assert len(row) < 0.5 * len(p) * len(texts)


def test_leaks_among_rare_words_of_other_items(spark):
    """A run of common words between rare words of items is found, though the passage is not near to it."""
    rng = random.Random(12)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common, rare = [word("abc", 3) for _ in range(20)], [word("defghij", 8) for _ in range(700)]
    texts = [[rng.choice(common) for _ in range(26)] for _ in range(4)] + [rng.sample(rare, 60) for _ in range(60)]
    docs = [[rng.choice(common) for _ in range(150)] for _ in range(400)]
    docs += [rng.sample(rare, 13) + texts[0][a : a + 13] + rng.sample(rare, 13) for a in range(14)]
    runs = [{tuple(t[a : a + 13]) for a in range(len(t) - 12)} for t in texts]
    want = {(d, i) for d, w in enumerate(docs) for i, r in enumerate(runs) if any(tuple(w[a : a + 13]) in r for a in range(len(w) - 12))}
    assert {(400 + a, 0) for a in range(14)} <= want
    got = leaks(spark, [" ".join(w) for w in docs], [" ".join(t) for t in texts])
    assert {(d, i) for d, i, v in got if v} == want


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(-1, 4), max_size=14))
def test_bit_parallel_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    assert leakage.lcs_length(a, b) == row[-1]


def test_items_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "VOCABULARY", 40)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    rng = random.Random(8)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(15)) for _ in range(8)]
    got = leaks(spark, [f"so {x} it goes" for x in items], items)
    assert got == {(i, i, True) for i in range(8)}


# personal data


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("cc a.b-9@sub.mill.example.net on", "email", "a.b-9@sub.mill.example.net"), ("for x+y (at) tarn (dot) example again", "email", "x+y (at) tarn (dot) example"),
        ("rings at +44 (0)7700 900027.", "phone", "+44 (0)7700 900027"), ("Call 538-555-0178 about", "phone", "538-555-0178"), ("at (640) 555-0190", "phone", "(640) 555-0190"),
        ("Tel. 01 99 00 61 40;", "phone", "01 99 00 61 40"), ("822.555.0182 ext. 478 x", "phone", "822.555.0182 ext. 478"), ("On file: passport T99824238", "id_number", "passport T99824238"),
        ("shows 000-60-4892 (SSN) in", "id_number", "000-60-4892 (SSN)"), ("DNI 00004666K", "id_number", "DNI 00004666K"), ("NI number QQ 12 19 97 C", "id_number", "NI number QQ 12 19 97 C"),
        ("Lives at 18 Harrow Lane, Ostrey - x", "address", "18 Harrow Lane, Ostrey"), ("Ferryweg 156.", "address", "Ferryweg 156"), ("to Avda. de Kelbury, 239. x", "address", "Avda. de Kelbury, 239"),
        ("76 bis, avenue de Dunharrow | x", "address", "76 bis, avenue de Dunharrow"),
    ],
)
def test_certain_forms(text, kind, span):
    assert (kind, span) in {(x[0], text[x[2] : x[3]]) for x in pii.find_spans(text) if x[1]}


@pytest.mark.parametrize("text", ["Ticket ID 3592 and part no. 150-85-2", "Order ref 9973-5169 shipped", "Epoch 1514941217533 in", "Version 5.58.1404.19 of", "Range 17-415-24 is", "Build 42500880 passed on runner 10.13.87.7.", "Use @a/b@9.33.4 for", "Lane 9 of the board", "Timestamp 2024-11-06 06:08:57", "Commit 29173298e9280f touched 73 files", "", "during 9 days"])
def test_decoys(text):
    assert [x for x in pii.find_spans(text) if x[1]] == []


def test_names_are_learned(spark):
    people = [("Martin", "Daliscu"), ("Leila", "Kestamere"), ("Oskar", "Thornvik"), ("Elin", "Roskuldt"), ("Hugo", "Brennvan")]
    rows = [(f"m{i}", f"mail {a.lower()}.{b.lower()}@post.example") for i, (a, b) in enumerate(people)]
    rows += [(f"t{i}{j}", f"Please ask {a} {people[j][1]} for the thing") for i, (a, _) in enumerate(people) for j in range(5)]
    rows += [("new", "Please ask Hugo Quillottir-Holscu for it"), ("rev", "Signed, Kestamere, Leila"), ("caps", "Talked with OSKAR THORNVIK about"), ("no", "The Project Sensor Ladder reached phase 8")]
    df = spark.createDataFrame([("corpus_records", k, t) for k, t in rows], "origin string, row_key string, text string")
    found = pii.personal_spans(df)
    names = {r["row_key"] for r in found.collect() if r["kind"] == "name"}
    assert {"new", "rev", "caps"} <= names and "no" not in names and len(names) == 28
    out = {r["row_key"]: r["text"] for r in pii.redacted(df, found).collect()}
    assert out["new"] == "Please ask [NAME] for it" and out["m0"] == "mail [EMAIL]" and out["no"] == dict(rows)["no"]


def test_personal_tables(spark):
    c = spark.createDataFrame([(1, "write to a@b.example", "start"), (1, "write to a@b.example", "start"), (2, None, ""), (3, "", "")], "id bigint, text string, kind string")
    r = spark.createDataFrame([("r1", "Call +1 417 555 0168"), ("r2", "Call +1 417 555 0168"), ("r3", None)], "id string, window_title string")
    p = spark.createDataFrame([("p1", "SSN 000-35-5128")], "chunk_id string, text string")
    got = pii.by_record(pii.personal_spans(pii.personal_texts(c, r, p)).select("origin", "row_key", "kind").distinct(), r)
    assert {tuple(x) for x in got.collect()} == {("corpus_records", "1", "email"), ("memory_records", "r1", "phone"), ("memory_records", "r2", "phone"), ("pending_chunks", "p1", "id_number")}
    empty = pii.personal_spans(pii.personal_texts(c.limit(0), r.limit(0), p.limit(0)))
    assert empty.count() == 0


def test_every_row_comes_out(spark):
    c = spark.createDataFrame([(1, "mail a.b@c.example now"), (2, None), (3, ""), (3, "")], "id bigint, text string")
    r = spark.createDataFrame([("r1", "plain"), ("r2", None), ("r3", ""), ("r4", "a.b@c.example"), ("r5", "a.b@c.example")], "id string, window_title string")
    p = spark.createDataFrame([("p1", None), ("p2", "x"), ("p2", "x")], "chunk_id string, text string")
    found = pii.by_record(pii.personal_spans(pii.personal_texts(c, r, p)).drop("by"), r)
    out = {(x["origin"][0], x["row_key"]): (x["text"], x["n_spans"]) for x in pii.redacted(pii.all_texts(c, r, p), found).collect()}
    assert out == {
        ("c", "1"): ("mail [EMAIL] now", 1), ("c", "2"): (None, 0), ("c", "3"): ("", 0), ("m", "r1"): ("plain", 0), ("m", "r2"): (None, 0), ("m", "r3"): ("", 0),
        ("m", "r4"): ("[EMAIL]", 1), ("m", "r5"): ("[EMAIL]", 1), ("p", "p1"): (None, 0), ("p", "p2"): ("x", 0),
    }


def test_forms_never_seen_are_learned_from_patterns(spark):
    texts = [f"Please ring desk +44 20 7946 0{i:03d} today" for i in range(12)] + ["Please ring desk 8812045 today", "The batch number 8812046 today"]
    texts += [f"They live at {i} Alder{chr(97 + i)} Street now" for i in range(12)] + ["They live at 7 Hollowbrook now", "Meeting at Hollowbrook 8 now"]
    df = spark.createDataFrame([("corpus_records", str(i), t) for i, t in enumerate(texts)], "origin string, row_key string, text string")
    got = {(r["row_key"], r["kind"]) for r in pii.personal_spans(df).filter("by = 'learned'").collect()}
    assert got == {("12", "phone"), ("26", "address")}


def test_very_long_texts(spark):
    text = "word 12 " * 60_000 + "a.b@c.example " * 2000
    df = spark.createDataFrame([("corpus_records", "1", text)], "origin string, row_key string, text string")
    assert pii.personal_spans(df).filter("kind = 'email'").count() == 2000


# scanned pages

PAGE = """Melow reader, vol. 2
The quick library copied the inci-
Melow reader, vol. 2
- 15 -
dent beyond the grand sensor.

Items: 17
Melow reader, vol. 2
xvii"""


def test_layout():
    lines, kinds, body = ocr_repair.layout(PAGE)
    assert [i for i, k in enumerate(kinds) if "header" in k] == [0, 2, 7] and [i for i, k in enumerate(kinds) if "page_no" in k] == [3, 8]
    tokens, hyph = ocr_repair.word_tokens(lines, kinds, body)
    assert hyph == {1} and ["incident", 1, 4, 4, 5] in tokens
    assert ocr_repair.repair_text(PAGE, {}) == "The quick library copied the incident beyond the grand sensor.\n\nItems: 17"
    _, kinds, _ = ocr_repair.layout("177    Chapter 8 The open morning\nSome sentence goes here and\nCh@pter 8 The open morning    178")
    assert kinds == [{"header", "page_no"}, set(), {"header", "page_no"}]


@pytest.mark.parametrize("line", ["- 14 -", "– 137 –", "[131]", "Page 36", "p. 150", "Pg 162", "page 3 of 48", "12 / 25", "180", "      65", "xvii", "- iv -"])
def test_page_numbers(line):
    assert ocr_repair.layout(line)[1] == [{"page_no"}]


@pytest.mark.parametrize("line", ["Items: 17", "Total 42", "Sum 1,024 -", "Range 40-60 of the quarter", "Figure 3. The exporter", "- courier list", ""])
def test_no_page_numbers(line):
    assert ocr_repair.layout(line)[1] == [set()]


@pytest.mark.parametrize("seen,true,cost", [("adju5ted", "adjusted", 0.3), ("modem", "modern", 0.3), ("gatevvay", "gateway", 0.3), ("biitton", "button", 0.3), ("same", "same", 0.0)])
def test_weighted_distance(seen, true, cost):
    assert min(ocr_repair.weighted_distance(seen, true, 2.0), 9) == pytest.approx(cost)


def test_deletes_meet():
    assert ocr_repair.deletes("modern") & ocr_repair.deletes("modem") and not ocr_repair.deletes("abc", 1) & {"c"}


@given(st.text("abc", max_size=14), st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13)), max_size=2))
def test_words_two_deletions_apart_always_meet(word, gone):
    a = "".join(c for i, c in enumerate(word) if i not in {x for x, _ in gone})
    b = "".join(c for i, c in enumerate(word) if i not in {y for _, y in gone})
    assert ocr_repair.deletes(a) & ocr_repair.deletes(b)


@given(st.text("abcd", min_size=8, max_size=12), st.text("abcd", min_size=8, max_size=12), st.integers(0, 11), st.integers(0, 11))
def test_near_titles_equal_plain_distance(a, c, i, j):
    for b in (c, a[:i] + "x" + a[i + 1 :], a[:j] + a[j + 1 :] + "d", "c" + a, a[:i] + a[i + 2 :]):
        row = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            diag, row[0] = row[0], n
            for k, y in enumerate(b, 1):
                diag, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diag + (x != y))
        near = a == b or (row[-1] <= 2 and min(len(a), len(b)) >= 8)
        t = ocr_repair._Titles()
        t.add(b)
        assert ocr_repair._near(a, b) == near == bool(t.near(a))


def test_places_get_their_own_repairs():
    text = "the rnodem case and the rnodem\ncase of a rno-\ndem line"
    assert ocr_repair.repair_text(text, {1: "modern", 5: "modem", 9: "model"}) == "the modern case and the modem case of a model line"


def test_one_word_in_two_contexts(spark):
    base = ["fine house stands here"] * 40 + ["warm horse runs fast"] * 40 + ["fine hou5e stands here. warm hou5e runs fast"]
    df = spark.createDataFrame([("recognized_texts", str(i), t) for i, t in enumerate(base)], "origin string, row_key string, text string")
    vocab = {r["word"]: r["repair"] for r in ocr_repair.misread_words(ocr_repair.laid_out(df)).collect()}
    assert vocab == {"hou5e": "house"}
    df = spark.createDataFrame([("recognized_texts", str(i), t) for i, t in enumerate(["old soit here"] * 40 + ["new solt there"] * 40 + ["old so1t here and new so1t there"])], "origin string, row_key string, text string")
    out = {r["row_key"]: r["text"] for r in ocr_repair.repaired_texts(df).collect()}
    assert out["80"] == "old soit here and new solt there"


def test_words_without_end(spark):
    long = "ab" * 50_000
    texts = [long, "日本語" * 2000, long + "\n" + "plain words here now\n" * 5, "x-" * 20_000, "-" * 5000, "Title A\n" * 400]
    df = spark.createDataFrame([("recognized_texts", str(i), t) for i, t in enumerate(texts)], "origin string, row_key string, text string")
    assert {r["row_key"]: r["text"] for r in ocr_repair.repaired_texts(df).collect()}["0"] == long
    assert ocr_repair.weighted_distance(long, long[:-1] + "h") == pytest.approx(0.3)


def test_misread_words_and_repair(spark):
    rng = random.Random(8)
    words = "modern gateway button adjusted station library picture morning captain general".split()
    clean = [" ".join(rng.choice(words) for _ in range(30)) + " x86 T-104 read-only." for _ in range(60)]
    faulty = ["the rnodern gatevvay was\nadju5ted by a sta-\nti0n in x86 mode", "all fine with the picture"]
    df = spark.createDataFrame([("recognized_texts", str(i), t) for i, t in enumerate(clean + faulty)] + [("recognized_texts", "n", None), ("recognized_texts", "e", "")], "origin string, row_key string, text string")
    got = {(r["row_key"], r["line_no"], r["kind"]) for r in ocr_repair.faulty_lines(df).collect()}
    assert got == {("60", 1, "misread"), ("60", 2, "misread"), ("60", 2, "hyphen"), ("60", 3, "misread")}
    out = {r["row_key"]: r["text"] for r in ocr_repair.repaired_texts(df).collect()}
    assert out["60"] == "the modern gateway was adjusted by a station in x86 mode" and out["n"] is None and out["e"] == "" and out["0"] == clean[0]
    assert ocr_repair.faulty_lines(df.limit(0)).count() == 0


def test_scanned_tables(spark):
    r = spark.createDataFrame([(1, "a\n- 3 -"), (1, "a\n- 3 -")], "frame_id bigint, text string")
    c = spark.createDataFrame([(7, "scan:x", "b"), (8, "web:x", "c"), (9, None, "d")], "id bigint, source string, text string")
    assert {(x["origin"], x["row_key"]) for x in ocr_repair.scanned_texts(r, c).collect()} == {("recognized_texts", "1"), ("corpus_records", "7")}


def test_hashes_differ():
    h = spans.phrase_hashes("".join(chr(97 + i % 26) for i in range(26)) + "zyx" * 30, 20)
    assert len(np.unique(h)) > 20 and re.match("x", "x")
