"""Repair of text recognised from scanned pages.

Layout: a page number is a line that is nothing but a number in a usual dress, or a number set apart from a running
title; a running header or footer is a line with such a number, or one that comes back within the text (letter for
letter up to misread characters) without being a sentence.  A line is hyphenated if it ends within a word and the next
line that is no page furniture goes on in lower case.

Each text is laid out once, in Python, into a stored table: the kinds of its lines and its words with their places.  All
else is counted and joined from there in the JVM, but for the distance of two words.

Words: the frequency lexicon of all texts is counted in the cluster.  A symmetric-delete index (the first PREFIX characters
of every word with up to two removed, on both sides of an equi-join; words within two deletions of each other always meet
in it) gives candidate pairs; short keys, which many words have, are salted.  A weighted edit distance, in which pairs of
characters that recognition confuses are cheap and all else is dear, keeps the plausible ones; frequency and the counts
of the two bigrams around the word pick the repair, for every place by itself.  A word broken across lines is judged whole
and the fault laid to the line that holds it.  Words of one or two characters are not repaired, and a repair is a word of
letters that the corpus has LEAST times; these bounds hold for corpora of every size.

The lexicon and the index are tables, joined by word; the corrections are broadcast only below CORRECTIONS_BROADCAST
rows and joined by shuffle beyond.  Null and empty texts have no faults and come out as they are; rows repeated under
one id count once.  A word may be of any length.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, once_per_id

#: What recognition makes (left) of what was printed (right).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("q", "g"), ("2", "z"), ("4", "a"), ("3", "e"), ("7", "t"), ("@", "a"), ("†", "t"), ("+", "t"), ("€", "e"), ("¢", "c"), ("c", "e"), ("e", "c"), ("v", "y"),
    ("y", "v"), ("i", "l"), ("l", "i"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("o", "c"), ("f", "t"), ("t", "f"), ("m", "rn"), ("rn", "m"),
    ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("lc", "k"), ("nn", "m"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]
CONFUSED, OTHER, MOST = 0.3, 1.0, 0.65
RATIO, LEAST = 20, 3
PREFIX, SALTS = 10, 16
CORRECTIONS_BROADCAST = 200_000
HYPHENS = "-‐‑¬\xad"

_NUM = r"(?:\d{1,5}|(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_NUMBER = re.compile(rf"\s*(?:[-–—~]\s*{_NUM}\s*[-–—~]|[\[(]\s*{_NUM}\s*[\])]|(?:page|pg|p|seite|s)\.?\s*{_NUM}(?:\s*(?:of|von|/)\s*{_NUM})?|{_NUM}\s*(?:/|of)\s*{_NUM}|{_NUM})\s*", re.I)
_NUMERAL = re.compile(_NUM, re.I)
_SENTENCE_END = re.compile(r"[.,;:?!…][\"'”’)]*$")
_LETTER = re.compile(r"[^\W\d_]")
_AFTER_HYPHENS = re.compile(rf"[\{HYPHENS}]")
_EDGE = ".,;:?!\"'()[]{}…“”‘’«»"
_FOLD = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "5": "s", "6": "b", "9": "g", "@": "a", "†": "t", "c": "e", "v": "y"})


def _folded(s: str) -> str:
    """A line for comparison up to misread characters."""
    s = s.lower().replace("rn", "m").replace("ri", "n").replace("li", "h").replace("cl", "d").replace("vv", "w").replace("ii", "u")
    return re.sub(r"[^\w]+", "", s.translate(_FOLD))


def _near(a: str, b: str) -> bool:
    """At most two edits apart; long lines only."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 2 or min(n, m) < 8:
        return False
    row = {j: j for j in range(3)}
    for i in range(1, n + 1):  # a band of two around the diagonal
        new = {}
        for j in range(max(0, i - 2), min(m, i + 2) + 1):
            if j == 0:
                new[j] = i
                continue
            new[j] = min(row.get(j, 9) + 1, new.get(j - 1, 9) + 1, row.get(j - 1, 9) + (a[i - 1] != b[j - 1]))
        if min(new.values()) > 2:
            return False
        row = new
    return row.get(m, 9) <= 2


@functools.lru_cache(100_000)
def _beginnings(prefix: str) -> frozenset:
    return frozenset(deletes(prefix))


class _Titles:
    """Keys of title-like lines; those near a key are found by the deletions of its beginning."""

    def __init__(self):
        self.by: dict[str, list[str]] = {}
        self.keys: set[str] = set()

    def add(self, key: str) -> None:
        if key not in self.keys:
            self.keys.add(key)
            if len(key) >= 8:
                for d in _beginnings(key[:6]):
                    self.by.setdefault(d, []).append(key)

    def near(self, key: str) -> set[str]:
        """All keys equal to it or near it."""
        out = {key} & self.keys
        if len(key) >= 8:
            for k in set().union(*(self.by[d] for d in _beginnings(key[:6]) & self.by.keys())):
                if k != key and abs(len(k) - len(key)) <= 2 and _near(key, k):
                    out.add(k)
        return out


def _apart(line: str) -> str | None:
    """The title beside a number that stands apart from it."""
    body = line.strip()
    first = body.split(None, 1)
    if len(first) < 2:
        return None
    if _NUMERAL.fullmatch(first[0]) and body[len(first[0]) : len(first[0]) + 2].isspace():
        return first[1]
    rest, last = body.rsplit(None, 1)
    if _NUMERAL.fullmatch(last) and len(body) - len(last) - len(rest) >= 2:
        return rest
    return None


def layout(text: str) -> tuple[list[str], list[set[str]], list[str]]:
    """(lines, kinds of each line among header and page_no, content of each line without a page number)."""
    lines = text.split("\n")
    kinds: list[set[str]] = [set() for _ in lines]
    body = [x.strip() for x in lines]
    titles: list[int] = []
    for i, line in enumerate(lines):
        x = body[i]
        if not x:
            continue
        if len(x) <= 64 and _NUMBER.fullmatch(x) or len(x) > 64 and x.count(" ") > 32 and _NUMBER.fullmatch(" ".join(x.split())):
            kinds[i].add("page_no")
            body[i] = ""
            continue
        title = _apart(line)
        if title is not None and not _SENTENCE_END.search(title[-8:]) and sum(map(str.isalpha, title)) > 3:
            kinds[i] |= {"header", "page_no"}
            body[i] = title
            titles.append(i)
        elif not _SENTENCE_END.search(x[-8:]) and not x[0].islower() and x[0] not in "-–•*" and " " in x and sum(map(str.isalpha, x)) > 7:
            titles.append(i)
    keys = {i: _folded(re.sub(r"\d+$", "", body[i][-400:] if len(body[i]) > 4000 else body[i])) for i in titles}
    groups = Counter(keys.values())
    known = _Titles()
    for i in titles:
        if kinds[i] or groups[keys[i]] > 1:
            known.add(keys[i])
    for i in titles:
        if not kinds[i] and (keys[i] in known.keys or known.near(keys[i])):
            kinds[i].add("header")
            known.add(keys[i])
    every = _Titles()  # titles that are misread each time differently
    for i in titles:
        every.add(keys[i])
    for i in titles:
        if not kinds[i] and every.near(keys[i]) - {keys[i]}:
            kinds[i].add("header")
    return lines, kinds, body


def word_tokens(lines: list[str], kinds: list[set[str]], body: list[str]):
    """([word, line, line of its second part or -1, length of its first part, its place in the line], ...), set of hyphenated lines."""
    out: list[list] = []
    hyphenated: set[int] = set()
    flow = [i for i in range(len(lines)) if body[i] and not kinds[i]]
    carry = None
    for at, i in enumerate(flow):
        parts = lines[i].split()
        skipped = 0
        if carry is not None:
            head, line, place = carry
            out.append([(head + parts[0]).strip(_EDGE).lower(), line, i, len(head.lstrip(_EDGE)), place])
            parts, skipped, carry = parts[1:], 1, None
        last = parts[-1] if parts else ""
        if last and last[-1] in HYPHENS and at + 1 < len(flow) and lines[flow[at + 1]].lstrip()[:1].islower() and _LETTER.search(_AFTER_HYPHENS.split(last[:-1])[-1]):
            hyphenated.add(i)
            carry = (last.rstrip(HYPHENS), i, skipped + len(parts) - 1)
            parts = parts[:-1]
        out += [[p.strip(_EDGE).lower(), i, -1, 0, skipped + k] for k, p in enumerate(parts)]
    for i, k in enumerate(kinds):
        if "header" in k:
            out += [[p.strip(_EDGE).lower(), i, -1, 0, -1] for p in body[i].split()]
    return out, hyphenated


@functools.lru_cache(200_000)
def _is_word(w: str) -> bool:
    if w.isalpha():
        return len(w) > 2
    return len(w) > 2 and sum(c.isalpha() for c in w) >= 2 and not any(c in "/\\_-–—=<>#" for c in w)


def deletes(w: str, most: int = 2, prefix: int = PREFIX) -> set[str]:
    """The first `prefix` characters of w with up to `most` removed.

    Two words that are equal once `most` characters at most are removed from each have one of these in common: the
    removals that fall into the beginning of the one leave at least as much as the other's."""
    w = w[:prefix]
    out, level = {w}, {w}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out |= level
    return out


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(d, w, n) for w, n in zip(pdf["w"], pdf["n"]) for d in deletes(w)]
        yield pd.DataFrame(rows, columns=["d", "w", "n"])


_BY_SEEN: dict[str, list[str]] = {}
for _seen, _true in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_true)


def weighted_distance(seen: str, true: str, most: float = MOST) -> float:
    """Least cost of confusions and edits that turn `true` into `seen`; above `most` it is most + 1.

    Only places that are reached within `most` are kept, so the work is a few steps per character."""
    n, m, none = len(seen), len(true), most + 1
    rows: list[dict[int, float]] = [{0: 0.0}, {}, {}]

    def reach(row: dict[int, float], j: int, c: float) -> bool:
        if c <= most and j <= m and c < row.get(j, none):
            row[j] = c
            return True
        return False

    for i in range(n + 1):
        row = rows[0]
        todo = sorted(row)
        while todo:
            j = todo.pop(0)
            c = row[j]
            if i < n and j < m and seen[i] == true[j]:
                reach(rows[1], j + 1, c)
            if c + CONFUSED <= most:
                for k in (1, 2):
                    for t in _BY_SEEN.get(seen[i : i + k], ()) if i + k <= n else ():
                        if true.startswith(t, j):
                            reach(rows[k], j + len(t), c + CONFUSED)
            if c + OTHER <= most:
                if i < n:
                    reach(rows[1], j, c + OTHER)
                    reach(rows[1], j + 1, c + OTHER)
                if reach(row, j + 1, c + OTHER) and (not todo or todo[0] != j + 1):
                    todo.insert(0, j + 1)
        if i == n:
            return row.get(m, none)
        rows = [rows[1], rows[2], {}]
    return none


def first_fault(seen: str, true: str) -> int:
    """Place in `seen` of the first character that differs."""
    for i, (a, b) in enumerate(zip(seen, true)):
        if a != b:
            return i
    return min(len(seen), len(true))


def _plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for w, nw, c, nc in zip(pdf["w"], pdf["nw"], pdf["c"], pdf["nc"]):
            odd = not w.isalpha() or any(0xFB00 <= ord(x) <= 0xFB06 for x in w)
            if not odd and len(w) < 5 and nc < nw * RATIO * 5:
                continue
            d = weighted_distance(w, c)
            if d <= (MOST if odd or len(w) > 6 else CONFUSED + 0.01) and d > 0:
                rows.append((w, nw, c, nc, d, odd))
        yield pd.DataFrame(rows, columns=["w", "nw", "c", "nc", "dist", "odd"])


def corrections(vocab: DataFrame) -> DataFrame:
    """w, c, nw, nc, dist, odd: plausible repairs of words; vocab (w, n) is a stored table."""
    top = vocab.agg(F.max("n")).first()[0] or 0
    odd = ~F.col("w").rlike(r"^\p{L}+$") | F.col("w").rlike("[ﬀ-ﬆ]")
    seen = vocab.filter(odd | (F.col("n") * RATIO <= top)).mapInPandas(_index, "d string, w string, n bigint")
    good = vocab.filter(~odd & (F.col("n") >= LEAST)).mapInPandas(_index, "d string, w string, n bigint")
    short = F.length("d") <= 2
    seen = seen.select("d", F.when(short, F.pmod(F.xxhash64("w"), F.lit(SALTS))).otherwise(0).alias("salt"), "w", F.col("n").alias("nw"))
    good = good.select("d", F.explode(F.when(short, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("salt"), F.col("w").alias("c"), F.col("n").alias("nc"))
    pairs = seen.join(good, ["d", "salt"]).filter((F.col("w") != F.col("c")) & (odd | (F.col("nc") >= F.col("nw") * RATIO)) & (F.abs(F.length("w") - F.length("c")) <= 2))
    pairs = pairs.select("w", "nw", "c", "nc").distinct()
    return pairs.mapInPandas(_plausible, "w string, nw bigint, c string, nc bigint, dist double, odd boolean")


_LAID = "origin string, row_key string, flags array<struct<line_no:bigint,kind:string>>, w array<string>, line_a array<int>, line_b array<int>, head array<int>"
_COLS = ["origin", "row_key", "flags", "w", "line_a", "line_b", "head"]


def _lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every text as the kinds of its lines and its words ('' for what is none)."""
    for pdf in batches:
        rows = []
        for o, k, text in zip(pdf["origin"], pdf["row_key"], pdf["text"]):
            lines, kinds, body = layout(text)
            tokens, hyphenated = word_tokens(lines, kinds, body)
            flags = [{"line_no": i + 1, "kind": x} for i, s in enumerate(kinds) for x in s] + [{"line_no": i + 1, "kind": "hyphen"} for i in hyphenated]
            rows.append((o, k, flags, [t[0] if _is_word(t[0]) else "" for t in tokens], [t[1] + 1 for t in tokens], [t[2] + 1 for t in tokens], [t[3] for t in tokens]))
        yield pd.DataFrame(rows, columns=_COLS)


def laid_out(texts: DataFrame) -> DataFrame:
    """The stored layout of all texts that are not empty."""
    return materialize(texts.filter(F.col("text") != "").mapInPandas(_lay_out, _LAID))


def scanned_texts(recognized: DataFrame, corpus: DataFrame) -> DataFrame:
    """origin, row_key, text of recognised frames and of the scanned part of the corpus."""
    r = once_per_id(recognized, "frame_id", "text").select(F.lit("recognized_texts").alias("origin"), F.col("frame_id").cast("string").alias("row_key"), "text")
    c = once_per_id(corpus.filter(F.col("source").startswith("scan:")), "id", "text")
    return r.unionByName(c.select(F.lit("corpus_records").alias("origin"), F.col("id").cast("string").alias("row_key"), "text"))


def misread_words(laid: DataFrame) -> DataFrame:
    """origin, row_key, place (number of the word in the text), line_no, word, repair, dist: the repair of every misread word."""

    @F.pandas_udf("int")
    def _fault_at(seen: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([first_fault(a, b) for a, b in zip(seen, true)], dtype="int32")

    vocab = materialize(laid.select(F.explode("w").alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    fix = materialize(corrections(vocab))
    small = fix.count() <= CORRECTIONS_BROADCAST
    word = F.transform(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: F.struct(
            i.alias("place"), F.get("w", i).alias("w"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("prv"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("nxt"),
            F.get("line_a", i).alias("line_a"), F.get("line_b", i).alias("line_b"), F.get("head", i).alias("head"),
        ),
    )
    t = laid.filter(F.size("w") > 0).select("origin", "row_key", F.explode(word).alias("x")).select("origin", "row_key", "x.*").filter("w <> ''")
    t = materialize(t.join(F.broadcast(fix) if small else fix, "w"))
    # only bigrams that a candidate would make are looked up
    asked = t.select(F.col("prv").alias("a"), F.col("c").alias("b")).unionByName(t.select(F.col("c").alias("a"), F.col("nxt").alias("b"))).filter("a <> '' and b <> ''").distinct()
    pair = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))
    two = laid.filter(F.size("w") > 1).select(F.explode(pair).alias("x")).select("x.a", "x.b").filter("a <> '' and b <> ''")
    two = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(asked, ["a", "b"], "left_semi")
    two = materialize(two)
    left = two.select(F.col("a").alias("prv"), F.col("b").alias("c"), F.col("n").alias("n_l"))
    right = two.select(F.col("a").alias("c"), F.col("b").alias("nxt"), F.col("n").alias("n_r"))
    t = t.join(left, ["prv", "c"], "left").join(right, ["c", "nxt"], "left")
    context = F.log1p(F.coalesce("n_l", F.lit(0)) + F.coalesce("n_r", F.lit(0)))
    t = t.withColumn("score", F.log("nc") + 2 * context - 4 * F.col("dist"))
    best = t.groupBy("origin", "row_key", "place", "line_a", "line_b", "head", "w").agg(F.max(F.struct("score", F.col("c").alias("repair"), "dist")).alias("x"))
    line = F.when((F.col("line_b") > 0) & (_fault_at("w", "x.repair") >= F.col("head")), F.col("line_b")).otherwise(F.col("line_a"))
    return best.select("origin", "row_key", "place", line.cast("bigint").alias("line_no"), F.col("w").alias("word"), F.col("x.repair").alias("repair"), F.col("x.dist").alias("dist"))


def faulty_lines(texts: DataFrame) -> DataFrame:
    """origin, row_key, line_no, kind (hyphen, misread, header, page_no)."""
    laid = laid_out(texts)
    words = misread_words(laid).select("origin", "row_key", "line_no", F.lit("misread").alias("kind"))
    flags = laid.select("origin", "row_key", F.explode("flags").alias("x")).select("origin", "row_key", "x.line_no", "x.kind")
    return flags.unionByName(words.distinct())


def _match_case(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 2 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair_text(text: str | None, repairs: dict[int, str]) -> str | None:
    """Continuous paragraphs: without page furniture, hyphenation undone, misread words replaced at their places."""
    if not text:
        return text
    lines, kinds, body = layout(text)
    tokens, hyphenated = word_tokens(lines, kinds, body)
    parts = {i: lines[i].split() for i in range(len(lines)) if body[i] and not kinds[i]}
    moved: set[int] = set()

    def fixed(part: str, repair: str | None) -> str:
        w = part.strip(_EDGE)
        return part.replace(w, _match_case(repair, w), 1) if repair and w else part

    for place, (_, a, b, _, k) in enumerate(tokens):
        if k < 0:
            continue
        if b >= 0:  # the second part of a broken word joins the first
            parts[a][k] = fixed(parts[a][k].rstrip(HYPHENS) + parts[b][0], repairs.get(place))
            moved.add(b)
        elif place in repairs:
            parts[a][k] = fixed(parts[a][k], repairs[place])
    out: list[str] = []
    para: list[str] = []
    glue = False
    for i in range(len(lines)):
        if i in parts:
            para += parts[i][1 if i in moved else 0 :]
            glue = i in hyphenated
        elif not kinds[i] and not glue and para:
            out.append(" ".join(para))
            para = []
    if para:
        out.append(" ".join(para))
    return "\n\n".join(out)


def repaired_texts(texts: DataFrame) -> DataFrame:
    """origin, row_key, text (repaired), n_repairs."""
    per = misread_words(laid_out(texts)).groupBy("origin", "row_key").agg(F.collect_list(F.struct("place", "repair")).alias("fixes"))
    t = texts.join(per, ["origin", "row_key"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for o, k, text, fixes in zip(pdf["origin"], pdf["row_key"], pdf["text"], pdf["fixes"]):
                d = {int(x["place"]): x["repair"] for x in fixes} if fixes is not None else {}
                out.append((o, k, repair_text(text, d), len(d)))
            yield pd.DataFrame(out, columns=["origin", "row_key", "text", "n_repairs"])

    return t.select("origin", "row_key", "text", "fixes").mapInPandas(run, "origin string, row_key string, text string, n_repairs bigint")
