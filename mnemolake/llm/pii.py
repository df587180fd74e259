"""Personal data in free text, by bootstrapped contextual extraction.

One pass over all texts emits spans: such as have an unmistakable form (seeds: addresses of mail, formatted telephone
numbers, labelled identity numbers, streets with house numbers) and such as may be personal (pairs of capitalised words,
numbers of some length, numbers beside capitalised words), each with the lexical pattern around it.  From the seeds the
graph of patterns and instances is scored in rounds by joins and aggregates: a pattern is as good as the share of its
distinct instances that are trusted, an instance is worth the mean of its patterns.  Patterns of high confidence then
decide about candidates not seen before; a candidate that names a seed in another form is found as well.  Names have no
form of their own: the parts of mail addresses and names behind a form of address are the first trusted given and family
names.  The column `by` tells what was found by form and what was learned.

The lexicons stay tables and are joined, nothing is collected.  Null and empty texts hold nothing and come out as they
are.  Rows repeated under one id count once.  Placeholders replace whole spans; the rest of a text stays as it is,
character by character.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, once_per_id

ROUNDS = 3
TRUST = 0.5
SUPPORT, SURE, LEAST_INSTANCE = 5, 0.9, 9
_S = r"[^\S\n]"
_WORD = r"[^\W\d_]"

EMAIL = re.compile(
    r"(?:<?mailto:)?[A-Za-z0-9À-ÿ](?:[\w.+%'-]*[\w+])?@(?:[A-Za-z0-9À-ÿ](?:[\w-]*\w)?\.)+[A-Za-z]{2,}\b>?"
    rf"|\b[A-Za-z0-9À-ÿ][\w.+-]*{_S}+@{_S}+(?:[A-Za-z0-9](?:[\w-]*\w)?\.)+[A-Za-z]{{2,}}\b"
    rf"|\b[A-Za-z0-9À-ÿ][\w.+-]*{_S}*[\[(]{_S}*at{_S}*[\])]{_S}*[A-Za-z0-9](?:[\w-]|\.(?=\w)|{_S}*[\[(]{_S}*dot{_S}*[\])]{_S}*)*[A-Za-z]",
    re.I,
)
#: Words that name an official number of a person (fixed values).
ID_LABEL = (
    r"passport(?: (?:no\.?|number|nr\.?))?|reisepass(?:nr\.?)?|passeport|pasaporte|id[ -]card(?: (?:no\.?|number))?|identity (?:card|number)|national id(?:entity)?(?: (?:card|no\.?|number))?"
    r"|social security(?: (?:no\.?|number))?|ssn|ni(?:no)?(?: (?:no\.?|number))|national insurance(?: (?:no\.?|number))?|dni|nie|nif|steuer-?id(?:nr\.?)?|tax id|taxpayer id|tin"
    r"|driv(?:er|ing)(?:'?s)?[ -]licen[cs]e(?: (?:no\.?|number))?|personalausweis(?:nr\.?)?|ausweis(?:nr\.?)?|nir|num[ée]ro de s[ée]curit[ée] sociale|carte d'identit[ée]|health insurance (?:no\.?|number)|curp|cpf"
)
ID_NUMBER = re.compile(
    rf"\b(?:{ID_LABEL}){_S}*[:#]?{_S}*(?:is{_S}+)?(?:[A-Z]{{0,3}}[ \-]?\d(?:[ \-./]?[\dX])*(?:[ \-]?[A-Z])?)(?![\w])"
    r"|(?<![\w.\-/])\d{3}-\d{2}-\d{4}(?![\w\-/])(?:\s*\(SSN\))?"
    r"|(?<![\w\-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"
    r"|(?<![\w\-])QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)",
    re.I,
)
_EXT = rf"(?:{_S}*(?:ext|extension|x|durchwahl)\.?{_S}*\d{{1,6}})?"
PHONE = re.compile(
    r"(?<![\w.+\-/@])(?:"
    rf"(?:\+|00)[1-9]\d{{0,2}}[ .\-/]?(?:\(0\) ?)?(?:\(\d{{1,4}}\)[ .\-]?)?\d(?:[ .\-/]?\d){{6,12}}{_EXT}"
    rf"|\(\d{{3}}\) ?\d{{3}}[ .\-]\d{{4}}{_EXT}"
    rf"|(?:1[ .\-])?\d{{3}}([.\-])\d{{3}}\1\d{{4}}{_EXT}"
    rf"|(?:1 )?[2-9]\d{{2}} \d{{3}} \d{{4}}{_EXT}"
    rf"|1[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}"
    rf"|0\d{{4}} \d{{3}} ?\d{{3}}{_EXT}|07\d{{9}}{_EXT}|07\d{{3}}[ \-]\d{{6}}{_EXT}"
    rf"|0[1-9](?:[ .]\d{{2}}){{4}}{_EXT}"
    rf"|0[1-9]\d{{1,3}}[ \-/]\d{{4,8}}(?:[ \-]?\d{{2,5}})?{_EXT}"
    r")(?![\w@]|[.\-/:]\d)"
)
_TYPES = r"street|st|road|rd|lane|ln|avenue|ave|av|drive|dr|court|ct|close|way|place|pl|square|sq|terrace|ter|crescent|cres|boulevard|blvd|row|hill|walk|gardens|grove|mews|parade|alley|highway|hwy|parkway|pkwy"
_CAP = r"(?:[A-ZÀ-Ý][\w'’-]+)"
_TAIL = rf"(?:,?{_S}+(?:apt|flat|unit|suite|apartment|no)\.?{_S}*\d+\w?)?"
_TOWN = rf"(?:,{_S}*(?:\d{{4,5}}{_S}+)?{_CAP}(?:{_S}+\d{{4,5}}\b)?|{_S}+{_CAP}{_S}+\d{{4,5}}\b)?"
ADDRESS = re.compile(
    rf"\b(?:(?:(?i:flat|apt|unit|suite|apartment)\.?{_S}*\d+\w?,{_S}*)?(?:{_CAP}{_S}+(?i:house|court|building|tower),{_S}*)?)?"
    rf"\d{{1,5}}(?:[a-z]\b|{_S}?[A-Za-z]\b)?,?{_S}+(?:{_CAP}{_S}+){{1,3}}(?i:{_TYPES})\b\.?{_TAIL}{_TOWN}"
    rf"|\b\d{{1,5}}(?:{_S}?(?i:bis|ter|quater)|[a-z])?,?{_S}+(?i:rue|avenue|av\.?|boulevard|bd|place|chemin|impasse|all[ée]e|quai|cours|route){_S}+(?:(?i:de la|de l['’]|des|du|de|d['’]){_S}*)?{_CAP}(?:[ -]{_CAP})?{_TOWN}"
    rf"|\b(?:{_CAP}[ -])?[A-ZÀ-Ý]\w*(?i:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|damm|ufer){_S}+\d{{1,4}}(?:{_S}?[a-z]\b)?(?=\W|$){_TOWN}"
    rf"|\b(?i:calle|c/|avda\.?|avenida|plaza|paseo|carrer|ronda|camino|via|viale|piazza){_S}+(?:(?i:de la|de los|de las|del|de){_S}+)?{_CAP}(?:{_S}+{_CAP})?,?{_S}+(?:n[ºo°]\.?{_S}*)?\d{{1,4}}\b(?:,{_S}*\d{{1,2}}[ºª°]{_S}*[A-Z]\b)?{_TOWN}"
)
_PERSON_CAP = r"[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ'’]+)"
PAIR = re.compile(
    rf"(?<![\w@.+\-/])(?:(?:Dr|Mr|Mrs|Ms|Prof|DR|MR|MRS|MS|PROF|Herr|Frau|Mme|Sr|Sra)\.?{_S}+)?"
    rf"(?P<a>{_PERSON_CAP}(?:-{_PERSON_CAP})*)(?P<c>,)?{_S}+(?:[A-ZÀ-Ý]\.{_S}*)?(?=(?P<b>{_PERSON_CAP}(?:-{_PERSON_CAP})*)(?![\w@]|-\w))"
)
LOWER_PAIR = re.compile(rf"(?<![\w@.+\-/])(?P<a>{_WORD}{{3,}}(?:-{_WORD}+)*)(?P<c>,)?{_S}+(?:{_WORD}\.{_S}*)?(?=(?P<b>{_WORD}{{4,}}(?:-{_WORD}+)*)(?![\w@]|-\w))")
NUMBER = re.compile(r"(?<![\w.\-/+@])(?:[A-Z]{1,3}[ \-]?)?\d(?:[ \-./]?\d){5,14}(?:[ \-]?[A-Z])?(?![\w\-/@])")
#: A number beside one or two capitalised words: perhaps a street without a word that says so.
PLACE = re.compile(rf"(?<![\w.+\-/@:])(?:\d{{1,4}}[a-z]?,?{_S}+{_CAP}(?:{_S}+{_CAP})?|{_CAP}(?:{_S}+{_CAP})?{_S}+\d{{1,4}}[a-z]?)(?![\w.\-/@:]*\d|\w)")
_HONORIFIC = re.compile(r"(?:Dr|Mr|Mrs|Ms|Prof|DR|MR|MRS|MS|PROF|Herr|Frau|Mme|Sr|Sra)\b")
# cheap signs without which the patterns above cannot match
_AT = re.compile(r"[\[(]\s*at\s*[\])]", re.I)
_SIX_DIGITS = re.compile(r"\d(?:\D{0,3}\d){5}")
_NUMBER_FIRST = re.compile(r"\d(?: ?\w)?,?[^\S\n]+(?:bis|ter|quater)?,?[^\S\n]*(?:[A-ZÀ-Ý]|(?i:rue|av|bo|bd|pla|che|imp|all|quai|cours|rou))|\d ?(?i:bis|ter|quater)")
_STREET_FIRST = re.compile(r"(?i:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|damm|ufer)[^\S\n]+\d|\b(?i:calle|c/|avda\.?|avenida|plaza|paseo|carrer|ronda|camino|via|viale|piazza)[^\S\n]")
_LOCAL = re.compile(r"^(?:<?mailto:)?([^\W\d_]{3,})[._]([^\W\d_]{4,})(?:-?\d+)?\s*[@\[(]", re.I)
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_DNI = re.compile(r"(?<![\w\-])(\d{8})-?([A-Z])(?!\w)")
_RIGHT = re.compile(r"[^\S\n]*(\S+)")

_SPAN = "origin string, row_key string, kind string, seed boolean, start int, end int, a string, b string, rev boolean, cap boolean, lft string, rgt string"
_COLS = [c.split()[0] for c in _SPAN.split(", ")]


def _word_before(text: str, at: int) -> tuple[str, int]:
    """(the word that ends before `at` on its line, where it begins); '' at the line's begin."""
    z = at
    while z and text[z - 1] != "\n" and text[z - 1].isspace():
        z -= 1
    a = z
    while a and not text[a - 1].isspace():
        a -= 1
    return text[a:z], a


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """Two words to the left, one to the right, on the same line, without numbers and case."""
    w, a = _word_before(text, start)
    v, _ = _word_before(text, a) if w else ("", 0)
    left = f"{v} {w}" if v else w or "^"
    m = _RIGHT.match(text, end)
    return re.sub(r"\d+", "9", left.lower()), re.sub(r"\d+", "9", (m[1] if m else "$").lower())


_NUMBER_STREET = re.compile(r"(\d+)[a-z]?,?\s+([^\d,.]+)")
_STREET_NUMBER = re.compile(r"([^\d,]+?),?\s+(?:n[ºo°]\.?\s*)?(\d+)")


def _instance(kind: str, span: str) -> tuple[str | None, str | None]:
    """(what is named, whatever its form; its form): digits of a number, house number and whole street name of an address."""
    if kind in ("phone", "id_number", "number"):
        return re.sub(r"\D", "", span), re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", span))
    if kind in ("address", "place"):
        if m := _NUMBER_STREET.match(span):
            return f"{m[1]} {' '.join(m[2].lower().split())}", None
        if m := _STREET_NUMBER.match(span):
            return f"{m[2]} {' '.join(m[1].lower().split())}", None
    return None, None


_DIGIT = re.compile(r"\d")


def _in_lines(pattern: re.Pattern, text: str, sign) -> Iterator[re.Match]:
    """Matches in the lines that show a sign; no pattern reaches over a line end."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if sign(text[at:end]):
            yield from pattern.finditer(text, at, end)
        at = end + 1


def find_spans(text: str, titles: bool = False) -> list[tuple]:
    """(kind, seed, start, end, a, b, rev, cap, left, right) of a text: certain spans (seed) and candidates."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []  # in order, without overlap

    def free(a: int, z: int) -> bool:
        i = bisect.bisect_left(taken, (z, -1))
        return i == 0 or taken[i - 1][1] <= a

    def add(kind: str, a: int, z: int) -> None:
        bisect.insort(taken, (a, z))
        out.append((kind, True, a, z, *_instance(kind, text[a:z]), False, True, *_context(text, a, z)))

    if "@" in text or _AT.search(text):
        for m in _in_lines(EMAIL, text, lambda x: "@" in x or _AT.search(x)):
            add("email", m.start(), m.end())
            p = _LOCAL.match(m[0])
            if p:
                out.append(("mail", True, m.start(), m.end(), p[1].lower(), p[2].lower(), False, True, "", ""))
    if _DIGIT.search(text):
        for m in _in_lines(ID_NUMBER, text, _SIX_DIGITS.search):
            if sum(c.isdigit() for c in m[0]) >= 6 and free(*m.span()):
                add("id_number", *m.span())
        for m in _DNI.finditer(text):
            if _DNI_LETTERS[int(m[1]) % 23] == m[2] and free(*m.span()):
                add("id_number", *m.span())
        for m in _in_lines(ADDRESS, text, lambda x: _NUMBER_FIRST.search(x) or _STREET_FIRST.search(x)):
            if free(*m.span()):
                add("address", *m.span())
        if titles:
            low = text.title()
            if low != text and len(low) == len(text):
                for m in ADDRESS.finditer(low):
                    if free(*m.span()):
                        add("address", *m.span())
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 21 and free(*m.span()):
                add("phone", *m.span())
        for m in NUMBER.finditer(text):
            if free(*m.span()):
                out.append(("number", False, *m.span(), *_instance("number", m[0]), False, True, *_context(text, *m.span())))
        for m in PLACE.finditer(text):
            if free(*m.span()):
                out.append(("place", False, *m.span(), *_instance("place", m[0]), False, True, *_context(text, *m.span())))
    for cap, pattern in ((True, PAIR), (False, LOWER_PAIR)):
        if not cap and not titles:
            continue
        for m in pattern.finditer(text):
            a, b, z = m["a"], m["b"], m.end("b")
            if len(a) > 2 and len(b) > 2 and free(m.start(), z):
                if cap and (a.isupper() != b.isupper()):
                    continue
                if cap and _HONORIFIC.match(m[0]):
                    out.append(("titled", True, m.start(), z, a.lower(), b.lower(), False, True, "", ""))
                out.append(("pair", False, m.start(), z, a.lower(), b.lower(), bool(m["c"]), cap, *_context(text, m.start(), z)))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for o, k, t in zip(pdf["origin"], pdf["row_key"], pdf["text"]):
            rows += [(o, k, *x) for x in find_spans(t, o == "memory_records")]
        yield pd.DataFrame(rows, columns=_COLS)


def personal_texts(corpus: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """origin, row_key, text of the three fields; of titles each distinct one, with the title as key.  Null and empty texts hold nothing."""
    return (
        corpus.select(F.lit("corpus_records").alias("origin"), F.col("id").cast("string").alias("row_key"), "text")
        .unionByName(chunks.select(F.lit("pending_chunks").alias("origin"), F.col("chunk_id").alias("row_key"), "text"))
        .unionByName(records.select(F.lit("memory_records").alias("origin"), F.col("window_title").alias("row_key"), F.col("window_title").alias("text")).distinct())
        .filter(F.col("text") != "")
    )


def all_texts(corpus: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """origin, row_key, text of every row of the three tables, once per id; null and empty texts included."""
    c = once_per_id(corpus, "id", "text").select(F.lit("corpus_records").alias("origin"), F.col("id").cast("string").alias("row_key"), "text")
    p = once_per_id(chunks, "chunk_id", "text").select(F.lit("pending_chunks").alias("origin"), F.col("chunk_id").alias("row_key"), "text")
    r = once_per_id(records, "id", "window_title").select(F.lit("memory_records").alias("origin"), F.col("id").alias("row_key"), F.col("window_title").alias("text"))
    return c.unionByName(p).unionByName(r)


def name_lexicon(spans: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(given: w, score), (family: w, score), from mail addresses and the pattern-instance graph."""
    mail = spans.filter("kind in ('mail', 'titled')").select("a", "b").distinct()
    given = mail.select(F.col("a").alias("w")).distinct().withColumn("g", F.lit(0.9))
    family = mail.select(F.col("b").alias("w")).distinct().withColumn("f", F.lit(0.9))
    pairs = spans.filter("kind = 'pair' and cap")
    edges = pairs.select(
        F.when(F.col("rev"), F.col("b")).otherwise(F.col("a")).alias("given"), F.split(F.when(F.col("rev"), F.col("a")).otherwise(F.col("b")), "-").alias("families"),
        F.array(F.concat_ws("|", "lft", F.lit("L")), F.concat_ws("|", "rgt", F.lit("R"))).alias("ps"),
    )
    edges = edges.select("given", F.explode("families").alias("family"), "ps").select("given", "family", F.explode("ps").alias("p"))
    edges = materialize(edges.distinct())
    pairs = edges.select("given", "family").distinct()
    known_given = mail.select(F.col("a").alias("given")).distinct()
    known_family = mail.select(F.col("b").alias("given")).distinct().join(known_given, "given", "left_anti").withColumn("is_f", F.lit(True))
    trusted = None
    for _ in range(rounds):
        p = pairs.join(given.withColumnRenamed("w", "given"), "given", "left").join(family.withColumnRenamed("w", "family"), "family", "left")
        # a word that is a family name by itself is no given name
        g, f = F.coalesce("g", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
        p = p.join(known_family, "given", "left").withColumn("own", F.when(F.col("is_f"), 0.0).otherwise(1 - (1 - g) * (1 - 0.5 * f)))
        p = p.select("given", "family", "own", "is_f")
        scored = edges.join(p, ["given", "family"]).groupBy("p").agg((F.sum("own") / (F.count(F.lit(1)) + 3)).alias("ps"))
        lift = edges.join(scored, "p").groupBy("given", "family").agg(F.avg("ps").alias("ctx"))
        score = F.when(F.col("is_f"), 0.0).otherwise(0.5 * F.col("own") + 0.5 * F.col("ctx"))
        trusted = p.join(lift, ["given", "family"]).select("given", "family", F.greatest(F.when(F.col("own") > 0.9, F.col("own")).otherwise(0.0), score).alias("score"))
        trusted = materialize(trusted)
        given2 = trusted.groupBy(F.col("given").alias("w")).agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("g"))
        family2 = trusted.groupBy(F.col("family").alias("w")).agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("f"))
        given = given2.unionByName(mail.select(F.col("a").alias("w"), F.lit(0.9).alias("g"))).groupBy("w").agg(F.max("g").alias("g"))
        family = family2.unionByName(mail.select(F.col("b").alias("w"), F.lit(0.9).alias("f"))).groupBy("w").agg(F.max("f").alias("f"))
    return materialize(given.filter(F.col("g") >= 0.3)), materialize(family.filter(F.col("f") >= 0.3))


def learned(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """origin, row_key, kind, start, end of numbers and places without certain form, by the graph of patterns and instances.

    Seeds are the instances (digits of a number, house number and street) that have a certain form somewhere.  A pattern
    (two words before, or the word before with the one behind) is as good for a kind as the share of its distinct instances
    that are trusted; an instance is trusted for the mean of its patterns.  A candidate is found if it names a seed, or if
    its pattern has SUPPORT trusted instances or more and nearly no others.  Numbers and places share no node of the graph."""
    part = F.when(F.col("kind").isin("place", "address"), "p").otherwise("n")
    one = spans.filter(F.col("kind").isin("number", "phone", "id_number", "place", "address") & F.col("a").isNotNull())
    one = one.select("kind", "seed", "lft", "rgt", F.concat(part, "a").alias("v"), part.alias("part"))
    pattern = F.array(F.concat_ws("|", "part", "lft", F.lit("L")), F.concat_ws("|", "part", F.element_at(F.split("lft", " "), -1), "rgt"))
    edges = materialize(one.filter("lft <> '^'").select("v", F.explode(pattern).alias("p")).distinct())
    seeds = materialize(one.filter("seed").select("v", "kind", F.lit(1.0).alias("t")).distinct())
    sizes = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    trust = seeds
    for i in range(rounds):
        scored = materialize(edges.join(trust, "v").groupBy("p", "kind").agg(F.sum("t").alias("s")).join(sizes, "p"))
        if i + 1 < rounds:
            # of instances with a pattern that somebody trusts; patterns without count as zero
            near = scored.select("p", "kind", (F.col("s") / (F.col("n") + 3)).alias("ps"))
            lift = edges.join(near, "p").groupBy("v", "kind").agg(F.sum("ps").alias("t")).join(edges.groupBy("v").agg(F.count(F.lit(1)).alias("m")), "v")
            lift = lift.select("v", "kind", (F.col("t") / F.col("m")).alias("t")).filter(F.col("t") >= TRUST)
            trust = materialize(seeds.unionByName(lift).groupBy("v", "kind").agg(F.max("t").alias("t")))
    good = scored.filter((F.col("s") >= SUPPORT) & (F.col("s") / F.col("n") >= SURE) & F.col("p").endswith("|L")).select("p", "kind")
    c = spans.filter(F.col("kind").isin("number", "place")).select("origin", "row_key", "start", "end", F.concat_ws("|", part, "lft", F.lit("L")).alias("p"), F.concat(part, "a").alias("v"))
    same = seeds.groupBy("v").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("k")).filter((F.col("k") == 1) & (F.length("v") > LEAST_INSTANCE)).select("v", "kind")
    both = c.join(good, "p").select("origin", "row_key", "kind", "start", "end").unionByName(c.join(same, "v").select("origin", "row_key", "kind", "start", "end"))
    return both.distinct()


def personal_spans(texts: DataFrame) -> DataFrame:
    """origin, row_key, kind, start, end, by (form, or learned) of all personal data in texts (origin, row_key, text)."""
    spans = materialize(texts.mapInPandas(_scan, _SPAN))
    given, family = name_lexicon(spans)
    sure = spans.filter("seed and kind not in ('mail', 'titled')").select("origin", "row_key", "kind", "start", "end")
    more = learned(spans)
    p = spans.filter("kind = 'pair'").select(
        "origin", "row_key", "start", "end", "cap", F.when(F.col("rev"), F.col("b")).otherwise(F.col("a")).alias("given"),
        F.split(F.when(F.col("rev"), F.col("a")).otherwise(F.col("b")), "-")[0].alias("family"),
    )
    p = p.join(given.withColumnRenamed("w", "given"), "given", "left").join(family.withColumnRenamed("w", "family"), "family", "left")
    g, f = F.coalesce("g", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    ok = F.when(F.col("cap"), ((g >= TRUST) & (f >= 0.3)) | ((f >= 0.7) & (g >= 0.3))).otherwise((g >= 0.8) & (f >= 0.3))
    names = p.filter(ok).select("origin", "row_key", F.lit("name").alias("kind"), "start", "end")
    return sure.withColumn("by", F.lit("form")).unionByName(more.unionByName(names).withColumn("by", F.lit("learned")))


def by_record(found: DataFrame, records: DataFrame) -> DataFrame:
    """Spans of titles laid to the records that have the title."""
    rest = found.filter("origin <> 'memory_records'")
    titles = found.filter("origin = 'memory_records'").withColumnRenamed("row_key", "window_title")
    r = records.select(F.col("id").alias("row_key"), "window_title").filter(F.col("window_title") != "").distinct()
    return rest.unionByName(r.join(titles, "window_title").select(*rest.columns))


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """origin, row_key, text with typed placeholders, n_spans; of overlapping spans the first, then longest counts."""
    per = found.groupBy("origin", "row_key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("spans"))
    t = once_per_id(texts.withColumn("_k", F.struct("origin", "row_key")), "_k", "text").select("_k.origin", "_k.row_key", "text").join(per, ["origin", "row_key"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, k, text, spans in zip(pdf["origin"], pdf["row_key"], pdf["text"], pdf["spans"]):
                out, at, n = [], 0, 0
                for x in sorted(spans, key=lambda x: (x["start"], -x["end"], x["kind"])) if text and spans is not None else ():
                    if x["start"] >= at:
                        out += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
                        at, n = x["end"], n + 1
                rows.append((o, k, "".join(out) + text[at:] if text else text, n))
            yield pd.DataFrame(rows, columns=["origin", "row_key", "text", "n_spans"])

    return t.mapInPandas(run, "origin string, row_key string, text string, n_spans bigint")
