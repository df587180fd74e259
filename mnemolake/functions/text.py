"""Text-signal rules as column expressions; nothing leaves the JVM.

Lengths named bytes count UTF-8 bytes, others count characters, as the rules were tuned that way.  All rules take null
as ''; white space and letters are Unicode's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X

_WS = r"(?U)\s+"
_ALNUM = r"\p{IsAlphabetic}\p{N}"


def col(x) -> Column:
    return F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(""))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(x: Column, parts: list[str]) -> Column:
    return x.rlike("|".join(re.escape(p).replace("\\ ", " ") for p in parts))


def starts_any(x: Column, parts: list[str]) -> Column:
    return x.rlike("^(?:" + "|".join(re.escape(p).replace("\\ ", " ") for p in parts) + ")")


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def bytes_of(x: Column) -> Column:
    return F.octet_length(x)


def text_lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def words_of(x: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(x, _WS, -1), lambda w: w != "")


def normalize_inline(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, _WS, " "))


def strip_low_conf(x: Column) -> Column:
    return normalize_inline(F.replace(x, F.lit(X.LOW_CONF), F.lit(" ")))


def truncate_snippet(x: Column, chars: int = X.SNIPPET_CHARS) -> Column:
    return F.when(F.length(x) <= chars, x).otherwise(F.concat(F.substring(x, 1, max(chars - 3, 0)), F.lit("...")))


def dedup_key(x: Column) -> Column:
    return F.lower(normalize_inline(x))


def count_of(x: Column, ch: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))


def _widest(x: Column, ch: str) -> Column:
    return F.array_max(F.transform(F.split(x, re.escape(ch), -1), lambda s: bytes_of(trim_all(s))))


def tab_strip(x: Column) -> Column:
    return (count_of(x, "·") >= 2) & (_widest(x, "·") <= 42) & (bytes_of(x) <= 220)


def pipe_row(x: Column) -> Column:
    return (count_of(x, "|") >= 2) & (_widest(x, "|") <= 36) & (bytes_of(x) <= 220)


def compact_caption(x: Column) -> Column:
    low = F.lower(x)
    glued = low.isin("backforward", "forwardback")
    both = low.contains("back") & low.contains("forward") & (bytes_of(low) < 42) & (low.contains("reload") | low.contains("refresh"))
    return (bytes_of(x) <= 64) & (glued | both)


def separator(x: Column) -> Column:
    return x.rlike(r"^[-_=. ]+$")


def symbol_ratio(x: Column) -> Column:
    rest = F.length(F.regexp_replace(x, rf"(?U)[{_ALNUM}\s]", ""))
    return F.when(F.length(x) == 0, F.lit(1.0)).otherwise(rest / F.length(x))


def alnum_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, rf"[^{_ALNUM}]", ""))


def file_inventory(x: Column) -> Column:
    def pathish(w: Column) -> Column:
        t = F.regexp_replace(w, r"^[,;:()\[\]{}]+|[,;:()\[\]{}]+$", "")
        named = t.contains("_") | t.contains("-") | any_of(t.endswith(e) for e in X.PATH_ENDS)
        return t.contains("/") | t.contains("\\") | (t.contains(".") & named)

    w = words_of(x)
    return (F.size(w) >= 4) & (F.size(F.filter(w, pathish)) >= 3)


def json_inventory(x: Column) -> Column:
    t = trim_all(x)
    bracketed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.when(bracketed, bytes_of(t) > 50).otherwise(contains_any(F.lower(t), X.JSON_KEYS))


def notification(x: Column) -> Column:
    low = F.lower(x)
    return contains_any(low, X.NOTIFICATION_PARTS) | low.startswith("breaking:")


def feed_fragment(x: Column) -> Column:
    low = F.lower(x)
    return (bytes_of(x) <= 90) & ((F.size(words_of(x)) <= 2) | low.startswith("sponsored") | low.isin(*X.FEED_LABELS))


def animation(x: Column) -> Column:
    return F.lower(x).isin(*X.ANIMATION_LABELS)


def is_browser(app: Column) -> Column:
    return contains_any(F.lower(app), X.BROWSER_APPS)


def is_code(app: Column) -> Column:
    return contains_any(F.lower(app), X.CODE_APPS)


def is_mail(app: Column) -> Column:
    return contains_any(F.lower(app), X.MAIL_APPS)


def mail_header(x: Column) -> Column:
    return starts_any(F.lower(x), X.MAIL_HEADERS)


def url_line(x: Column) -> Column:
    low = F.lower(trim_all(x))
    return low.startswith("http://") | low.startswith("https://") | low.contains("www.")


def generic_label(x: Column) -> Column:
    return F.lower(x).rlike("^(?:" + "|".join(X.GENERIC_LABELS) + r")(?: |\z)")


def generic_title(app: Column, title: Column) -> Column:
    low = F.lower(title)
    return ((app != "") & (low == F.lower(app))) | low.isin(*X.GENERIC_TITLES)


def should_drop(app: Column, x: Column) -> Column:
    """The ordered decision list; the first rule that applies decides."""
    browser, code, mail = is_browser(app), is_code(app), is_mail(app)
    return (
        F.when(separator(x) | tab_strip(x) | pipe_row(x) | compact_caption(x), True)
        .when((browser | mail) & generic_label(x), True)
        .when(url_line(x), False)
        .when(browser & (notification(x) | feed_fragment(x)), True)
        .when(animation(x), True)
        .when(~code & (file_inventory(x) | json_inventory(x)), True)
        .when(mail & mail_header(x), False)
        .when(browser & (symbol_ratio(x) > X.BROWSER_SYMBOLS), True)
        .when(~code & (symbol_ratio(x) > X.OTHER_SYMBOLS), True)
        .otherwise(False)
    )


def useful_line(app: Column, x: Column) -> Column:
    return bind(normalize_inline(x), lambda n: bytes_of(n).between(X.MIN_LINE_BYTES, 240) & ~should_drop(app, n) & ~generic_title(app, n))


def line_quality(app: Column, x: Column, low_conf: Column, dropped: Column | None = None) -> Column:
    dropped = should_drop(app, x) if dropped is None else dropped
    alpha = F.when(x == "", F.lit(0.0)).otherwise(alnum_count(x) / bytes_of(x))
    score = alpha * 0.52 + (F.lit(1.0) - symbol_ratio(x)) * 0.28 + F.least(bytes_of(x), F.lit(180)) / 180 * 0.20
    score = score * F.when(low_conf, 0.78).otherwise(1.0) * F.when(dropped, 0.16).otherwise(1.0)
    score = score * F.when(~is_code(app) & file_inventory(x), 0.25).otherwise(1.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _clean_lines(text: Column) -> Column:
    return F.filter(F.transform(text_lines(text), normalize_inline), lambda x: x != "")


def bind(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it (inside lambdas nothing is shared otherwise)."""
    return F.get(F.transform(F.array(x), f), 0)


def _first_of_each(arr: Column, key) -> Column:
    """Entries of an array of strings whose key did not occur before."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(F.concat(acc["keys"], F.array(key(x))).alias("keys"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(F.array_contains(acc["keys"], key(x)), acc).otherwise(new)

    return F.aggregate(arr, F.struct(none.alias("keys"), none.alias("out")), step, lambda acc: acc["out"])


def noise_score(app: Column, text: Column) -> Column:
    def weight(x: Column) -> Column:
        over = F.least(F.greatest((symbol_ratio(x) - 0.5) * 1.8, F.lit(0.0)), F.lit(1.0))
        return F.when(should_drop(app, x) | (bytes_of(x) < X.MIN_LINE_BYTES), F.lit(1.0)).when(symbol_ratio(x) > 0.5, over).otherwise(0.0)

    def mean(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
        return F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.least(total / F.greatest(F.size(w), F.lit(1)), F.lit(1.0)))

    return bind(F.transform(_clean_lines(text), weight), mean)


def reduce_noise(app: Column, text: Column) -> Column:
    kept = F.filter(_clean_lines(text), lambda x: (bytes_of(x) >= X.MIN_LINE_BYTES) & ~should_drop(app, x))
    return F.array_join(_first_of_each(kept, F.lower), "\n")


def high_signal(app: Column, text: Column) -> Column:
    """Struct of the kept text and the counters of its lines."""
    raw = F.transform(text_lines(text), lambda x: F.struct(strip_low_conf(x).alias("x"), x.contains(X.LOW_CONF).alias("low")))
    lines = F.filter(raw, lambda r: r["x"] != "")
    weak = lambda r: (r["q"] < X.QUALITY_FLOOR) | (bytes_of(r["x"]) < X.MIN_LINE_BYTES)

    def judged(r: Column) -> Column:
        s = F.struct(r["x"].alias("x"), r["low"].alias("low"), should_drop(app, r["x"]).alias("drop"))
        return bind(s, lambda v: F.struct(v["x"].alias("x"), v["low"].alias("low"), v["drop"].alias("drop"), line_quality(app, v["x"], v["low"], v["drop"]).alias("q")))

    def counted(scored: Column) -> Column:
        kept = _first_of_each(F.transform(F.filter(scored, lambda r: ~r["drop"] & ~weak(r)), lambda r: r["x"]), F.lower)
        total = F.size(scored)
        return F.struct(
            kept.alias("kept"),
            total.cast("bigint").alias("total_lines"),
            F.size(F.filter(scored, lambda r: r["low"])).cast("bigint").alias("low_conf_lines"),
            F.size(F.filter(scored, lambda r: r["drop"])).cast("bigint").alias("dropped_noise_lines"),
            F.size(F.filter(scored, lambda r: ~r["drop"] & weak(r))).cast("bigint").alias("dropped_low_signal_lines"),
            F.when(total == 0, 0.0).otherwise(F.aggregate(F.transform(scored, lambda r: r["q"]), F.lit(0.0), lambda a, b: a + b) / F.greatest(total, F.lit(1))).alias("avg_line_score"),
        )

    def whole(c: Column) -> Column:
        out = F.array_join(c["kept"], "\n")
        fallback = reduce_noise(app, F.replace(text, F.lit(X.LOW_CONF), F.lit(" ")))
        return F.struct(
            F.when(F.size(c["kept"]) == 0, fallback).otherwise(out).alias("text"), c["total_lines"].alias("total_lines"), F.size(c["kept"]).cast("bigint").alias("kept_lines"),
            c["low_conf_lines"].alias("low_conf_lines"), c["dropped_noise_lines"].alias("dropped_noise_lines"),
            c["dropped_low_signal_lines"].alias("dropped_low_signal_lines"), c["avg_line_score"].alias("avg_line_score"),
        )

    return bind(bind(F.transform(lines, judged), counted), whole)


def fallback_snippet(app: Column, title: Column, text: Column) -> Column:
    name = trim_all(app)

    def of(h: Column) -> Column:
        t, good = h["t"], h["good"]
        lines = F.filter(_clean_lines(text), lambda x: useful_line(app, x) & ~file_inventory(x) & ~json_inventory(x) & (~good | (F.lower(x) != F.lower(t))))
        return bind(
            F.array_join(F.slice(_first_of_each(lines, F.lower), 1, 2), " | "),
            lambda two: F.when(good, truncate_snippet(F.when(two == "", t).otherwise(F.concat(t, F.lit(": "), two))))
            .when(two != "", truncate_snippet(two))
            .when(t != "", truncate_snippet(t))
            .when(name != "", F.concat(F.lit("Using "), name))
            .otherwise(""),
        )

    return bind(bind(normalize_inline(title), lambda t: F.struct(t.alias("t"), ((t != "") & useful_line(app, t)).alias("good"))), of)


# salient spans


def sentences(block: Column) -> Column:
    """Sentences of a block; a piece below 12 characters goes into the next one."""
    parts = F.split(trim_all(block), r"(?<=[.!?])(?=[ \n]|\z)|(?<=\n)", -1)

    def step(acc: Column, p: Column) -> Column:
        buf = F.concat(acc["buf"], p)
        cut = p.rlike(r"[.!?\n]\z") & (F.length(trim_all(buf)) >= 12)
        return F.struct(
            F.when(cut, F.concat(acc["out"], F.array(trim_all(buf)))).otherwise(acc["out"]).alias("out"), F.when(cut, F.lit("")).otherwise(buf).alias("buf")
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    end = lambda acc: F.when(trim_all(acc["buf"]) != "", F.concat(acc["out"], F.array(trim_all(acc["buf"])))).otherwise(acc["out"])
    return F.aggregate(parts, start, step, end)


def span_score(app: Column, span: Column) -> Column:
    return bind(F.struct(normalize_inline(span).alias("n"), _clean_lines(span).alias("lines"), words_of(normalize_inline(span)).alias("w")), lambda r: _span_score(app, r["n"], r["lines"], r["w"]))


def _span_score(app: Column, n: Column, lines: Column, w: Column) -> Column:
    per_line = F.aggregate(F.transform(lines, lambda x: line_quality(app, x, F.lit(False))), F.lit(0.0), lambda a, b: a + b)
    avg = F.when(F.size(lines) == 0, line_quality(app, n, F.lit(False))).otherwise(per_line / F.greatest(F.size(lines), F.lit(1)))
    size = F.greatest(F.size(w), F.lit(1))
    share = lambda cond, cap: F.least(F.size(F.filter(w, cond)) / size, F.lit(cap)) / cap
    caps = share(lambda t: t.rlike(r"^\p{Lu}"), 0.45)
    verbs = share(lambda t: F.lower(t).rlike("(?:" + "|".join(X.ACTION_ENDS) + r")\z"), 0.30)
    low = F.lower(n)
    cues = F.least(reduce(lambda a, b: a + b, [low.contains(c).cast("int") for c in X.CUE_WORDS]) * 0.05, F.lit(0.18))
    score = avg * 0.40 + caps * 0.12 + verbs * 0.10 + F.least(F.length(n), F.lit(280)) / 280 * 0.16 + F.size(F.array_distinct(w)) / size * 0.12 + cues
    return F.when(F.length(n) < 10, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def salient_spans(app: Column, text: Column) -> Column:
    """array<struct<text, score>>, best first; the first MAX_SPANS spans of the text compete."""
    all_spans = F.flatten(F.transform(F.split(text, "\n\n", -1), sentences))
    scored = F.filter(F.transform(all_spans, lambda s: F.struct(span_score(app, s).alias("score"), s.alias("text"))), lambda r: (r["score"] > 0) & (r["text"] != ""))
    few = F.slice(scored, 1, X.MAX_SPANS)
    ranked = F.array_sort(F.transform(few, lambda r, i: F.struct((-r["score"]).alias("neg"), i.alias("i"), r["text"].alias("text"), r["score"].alias("score"))))
    return F.transform(ranked, lambda r: F.struct(r["text"].alias("text"), r["score"].alias("score")))


def compress_evidence(spans: Column, text: Column, chars: int) -> Column:
    """Best spans up to a number of characters; the separator may run over by two, as it is set before the check."""
    if chars <= 0:
        return F.lit("")

    def step(acc: Column, s: Column) -> Column:
        out = F.when(acc["out"] == "", F.lit("")).otherwise(F.concat(acc["out"], F.lit(" • ")))
        left = F.greatest(F.lit(chars) - F.length(out), F.lit(0))
        fits = F.length(out) + F.length(s["text"]) <= chars
        done = acc["done"] | (F.length(acc["out"]) >= chars)
        more = F.when(fits, F.concat(out, s["text"])).otherwise(F.concat(out, s["text"].substr(F.lit(1), left)))
        return F.struct(F.when(done, acc["out"]).otherwise(more).alias("out"), (done | ~fits).alias("done"))

    folded = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(False).alias("done")), step, lambda acc: acc["out"])
    return F.when(trim_all(text) == "", "").when(F.size(spans) == 0, F.substring(text, 1, chars)).otherwise(folded)


def concentration(spans: Column) -> Column:
    """Share of the three best spans in the sum of all scores."""
    mass = lambda a: F.aggregate(F.transform(a, lambda r: r["score"]), F.lit(0.0), lambda x, y: x + y)
    total = mass(spans)
    return F.when(total <= 1e-6, 0.0).otherwise(F.least(mass(F.slice(spans, 1, 3)) / F.greatest(total, F.lit(1e-6)), F.lit(1.0)))


# recognised text


def ocr_preprocess(lines: Column) -> Column:
    """lines: array<struct<text, confidence>>.  Struct of text, OCR statistics."""
    low = F.lit(X.OCR_LOW).cast("float")
    drop = F.lit(X.OCR_DROP).cast("float")
    norm = F.transform(lines, lambda r: F.struct(normalize_inline(r["text"]).alias("x"), r["confidence"].cast("float").alias("c")))
    avg = lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(F.transform(a, lambda r: r["c"].cast("double")), F.lit(0.0), lambda x, y: x + y) / F.size(a))
    def of_fine(f: Column) -> Column:
        keys = F.transform(f, lambda r: F.lower(r["x"]))
        return bind(keys, lambda k: F.struct(F.size(f).alias("fine"), F.filter(f, lambda r, i: (i == 0) | (F.get(k, i - 1) != F.lower(r["x"]))).alias("kept")))

    def of_kept(h: Column) -> Column:
        kept = h["kept"]
        return F.struct(
            F.array_join(F.transform(kept, lambda r: F.when(r["c"] < low, F.concat(F.lit(X.LOW_CONF + " "), r["x"])).otherwise(r["x"])), "\n").alias("text"),
            avg(norm).alias("avg_confidence_all"),
            avg(kept).alias("avg_confidence_kept"),
            F.size(kept).cast("bigint").alias("lines_used"),
            (F.size(lines) - h["fine"]).cast("bigint").alias("lines_dropped"),
            F.size(F.filter(kept, lambda r: r["c"] < low)).cast("bigint").alias("low_conf_count"),
        )

    return bind(bind(F.filter(norm, lambda r: (r["c"] >= drop) & (r["x"] != "")), of_fine), of_kept)


def ocr_noise(x: Column, aggressive: bool = True, custom: list[str] | None = None) -> Column:
    base = contains_any(x, [*(custom or []), *X.OCR_NOISE_PARTS])
    if not aggressive:
        return base
    t = trim_all(x)
    return (
        base
        | ((F.length(x) > 0) & (alnum_count(x) / F.greatest(F.length(x), F.lit(1)) < 0.5))
        | ((F.size(words_of(x)) == 1) & F.lower(t).isin(*X.OCR_UI_WORDS))
        | x.rlike(X.OCR_TIME)
        | (t.endswith("%") & t.rlike(r"^[\p{N}%.]+$"))
        | t.rlike(X.OCR_SIZE)
        | (starts_any(x, X.OCR_DAYS) & (bytes_of(x) < 20))
        | (contains_any(x, X.OCR_MONTHS) & (bytes_of(x) < 15))
    )


def ocr_normalize(text: Column, min_bytes: int = 7, aggressive: bool = True, custom: list[str] | None = None, dedup: bool = True, keep_format: bool = False) -> Column:
    if keep_format:
        return text
    lines = F.filter(F.transform(text_lines(text), trim_all), lambda x: (bytes_of(x) >= min_bytes) & ~ocr_noise(x, aggressive, custom))
    return F.array_join(F.slice(_first_of_each(lines, F.lower) if dedup else lines, 1, X.OCR_MAX_LINES), "\n")


def text_volume(chars: Column, confidence: Column, blocks: Column) -> Column:
    c = confidence.cast("float")
    at_least = lambda v: c >= F.lit(v).cast("float")
    return F.when(chars < 80, False).otherwise(
        ((chars >= 400) & at_least(0.35)) | ((chars >= 200) & (blocks >= 10) & at_least(0.35)) | ((blocks >= 5) & at_least(0.55))
    )


def low_signal(text: Column, confidence: Column, blocks: Column, min_chars: int) -> Column:
    n, c = bytes_of(trim_all(text)), confidence.cast("float")
    return (n < min_chars) | (c < F.lit(0.15).cast("float")) | ((blocks <= 1) & (c < F.lit(0.35).cast("float"))) | ~text_volume(n, c, blocks)


@dataclass(frozen=True)
class OcrConfig:
    """Settings of text recognition; the confidence below which lines go is fixed (OCR_DROP)."""

    min_confidence: float = 0.30
    aggressive: bool = True
    min_bytes: int = 7
    custom: tuple[str, ...] = ()
    dedup: bool = True
    keep_format: bool = False
    language_correction: bool = True
    accurate: bool = True
    min_text_height: float = 0.02

    @classmethod
    def fast(cls) -> OcrConfig:
        return cls(0.3, False, 5, (), False, True, False, False, 0.015)

    @classmethod
    def high_quality(cls) -> OcrConfig:
        return cls(0.7, False, 1, (), False, True, True, True, 0.01)

    def normalize(self, text: Column) -> Column:
        return ocr_normalize(text, self.min_bytes, self.aggressive, list(self.custom), self.dedup, self.keep_format)
