import pytest
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.functions import text as T


def run(spark, f, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


def reduced(spark, app, text):
    return run(spark, T.reduce_noise, app, text)


def test_rows_of_tabs_go(spark):
    # two or more dots between short pieces make a strip; one dot, or a long piece, does not
    assert reduced(spark, "Safari", "Harvest ledger of the north mill\nOats · Barley · Rye") == "Harvest ledger of the north mill"
    assert reduced(spark, "Safari", "Oats · Barley") == "Oats · Barley"
    long = "Oats · Barley · " + "a piece that is much longer than any tab would be written"
    assert reduced(spark, "Safari", long) == long
    assert reduced(spark, "Safari", "alpha | beta | gamma\nalpha | beta only") == "alpha | beta only"


def test_labels_of_browsers(spark):
    for label in X.GENERIC_LABELS:
        assert reduced(spark, "Firefox", f"{label.upper()}\nSeven ferries cross at dawn") == "Seven ferries cross at dawn"
    url = "https://mill.example/ledger?page=7&sort=weight"
    assert url in reduced(spark, "Firefox", f"Weights of the second week\n{url}")


def test_lists_of_paths(spark):
    listing = "a/one.ts b/two.ts c/three.ts d/four.ts"
    assert reduced(spark, "Firefox", f"{listing}\nFour ferries wait at the pier") == "Four ferries wait at the pier"
    assert reduced(spark, "iTerm", "make wheel && ./turn --slow 3") == "make wheel && ./turn --slow 3"


def test_repeats_are_kept_first_and_short_lines_dropped(spark):
    assert reduced(spark, "", "One good line here\nshort\none good LINE here\r\nAnother good line") == "One good line here\nAnother good line"


@pytest.mark.parametrize(
    "app,title,text,want",
    [
        ("Ledger", "Oat prices of May", "a/one.ts b/two.ts c/three.ts d/four.ts", "Oat prices of May"),  # an inventory gives way to the title
        ("Firefox", "home", "a/one.ts b/two.ts c/three.ts d/four.ts\nBarley rose by two coins", "Barley rose by two coins"),  # a title that says nothing is left out
        ("Ledger", "Oat prices of May", "Barley rose by two coins\nRye fell by one coin\nWheat did not move", "Oat prices of May: Barley rose by two coins | Rye fell by one coin"),
        ("Firefox", "", "", "Using Firefox"),
        ("", "", "", ""),
        (None, None, None, ""),
    ],
)
def test_fallback_snippet(spark, app, title, text, want):
    df = spark.createDataFrame([(app, title, text)], "a string, t string, x string")
    assert df.select(T.fallback_snippet(T.col("a"), T.col("t"), T.col("x"))).first()[0] == want


def test_noise_score(spark):
    # every line is a label, half of the lines are, no line is
    assert run(spark, T.noise_score, "Firefox", "\n".join(X.GENERIC_LABELS)) == 1.0
    assert run(spark, T.noise_score, "Firefox", "explore\nSeven ferries cross at dawn") == 0.5
    assert run(spark, T.noise_score, "Firefox", "Seven ferries cross at dawn\nOne ferry stays") == 0.0
    assert run(spark, T.noise_score, "", "") == 1.0


def test_high_signal(spark):
    raw = f"{X.LOW_CONF} explore\nThe miller weighed nine sacks of rye before noon\n{X.LOW_CONF} a/one.ts b/two.ts c/three.ts d/four.ts"
    h = run(spark, T.high_signal, "Firefox", raw)
    assert h["text"] == "The miller weighed nine sacks of rye before noon"
    assert (h["total_lines"], h["low_conf_lines"], h["kept_lines"]) == (3, 2, 1)
    h = run(spark, T.high_signal, "Firefox", "\n".join(X.GENERIC_LABELS))
    assert h["text"] == "" and h["kept_lines"] == 0 and h["total_lines"] == len(X.GENERIC_LABELS)
    h = run(spark, T.high_signal, "Outlook", "Subject: Sacks for the ferry on Monday")
    assert h["text"] == "Subject: Sacks for the ferry on Monday"


def sentences_by_hand(block):
    block, out, buf = block.strip(), [], ""
    for i, ch in enumerate(block):
        buf += ch
        if (ch in ".!?" and (i + 1 == len(block) or block[i + 1] in " \n")) or ch == "\n":
            if len(buf.strip()) >= 12:
                out.append(buf.strip())
                buf = ""
    return out + ([buf.strip()] if buf.strip() else [])


@pytest.mark.parametrize("block", ["", "Short. Also short. This one is long enough. Tail", "No end at all", "A. B. C. D. E. F. G.", "line one\nline two is longer\nx", "What? Yes! 3.14 is pi."])
def test_sentences(spark, block):
    assert run(spark, T.sentences, block) == sentences_by_hand(block)


def test_spans_rank_content_first_and_budget(spark):
    raw = "explore\n\nThe miller decided to weigh nine sacks of rye because the ferry must leave before noon.\n\nsettings"
    spans = run(spark, lambda x: T.salient_spans(F.lit("Ledger"), x), raw)
    assert spans[0]["text"].startswith("The miller decided")
    raw = "\n\n".join(f"The miller decided to weigh {n} sacks of rye because the ferry must leave." for n in ("nine", "ten", "eleven"))
    out = run(spark, lambda x: T.compress_evidence(T.salient_spans(F.lit("Ledger"), x), x, 100), raw)
    assert 0 < len(out) <= 102
    assert run(spark, lambda x: T.concentration(T.salient_spans(F.lit("Ledger"), x)), "Only this line stands here, alone and long enough.") == 1.0


@pytest.mark.parametrize("line", X.OCR_UI_WORDS + ["7:05", "23:59", "9:15 AM", "8 KB", "1.5 GB", "12%", "com.apple.mill"])
def test_ocr_noise(spark, line):
    assert run(spark, T.ocr_noise, line)


@pytest.mark.parametrize("line", ["nine sacks of rye", "the ferry leaves before noon", "weigh 45 sacks"])
def test_ocr_content(spark, line):
    assert not run(spark, T.ocr_noise, line)


def test_ocr_preprocess(spark):
    lines = [("Nine  Sacks", 0.9), ("nine sacks", 0.9), ("of rye", 0.5), ("blurred", 0.1), ("  ", 0.9), ("nine sacks", 0.8)]
    df = spark.createDataFrame([(lines,)], "lines array<struct<text:string,confidence:float>>")
    o = df.select(T.ocr_preprocess(F.col("lines")).alias("o")).first()["o"]
    assert o["text"] == "Nine Sacks\n[LOW_CONF] of rye\nnine sacks"
    assert (o["lines_used"], o["lines_dropped"], o["low_conf_count"]) == (3, 2, 1)


@pytest.mark.parametrize("chars", [79, 80, 199, 200, 399, 400])
@pytest.mark.parametrize("blocks", [4, 5, 9, 10])
def test_text_volume(spark, chars, blocks):
    # floors: 80 characters at all; 400, or 200 in ten blocks, at medium confidence; five blocks at high confidence
    df = spark.createDataFrame([(chars, c, blocks) for c in (0.3, 0.4, 0.6)], "n int, c float, b int")
    got = [r[0] for r in df.select(T.text_volume(F.col("n"), F.col("c"), F.col("b"))).collect()]
    long = chars >= 400 or (chars >= 200 and blocks >= 10)
    assert got == [False, long, long or (chars >= 80 and blocks >= 5)]


def test_ocr_normalize_limits(spark):
    text = "\n".join(f"content line number {i}" for i in range(300))
    assert run(spark, T.ocr_normalize, text).count("\n") == 219
