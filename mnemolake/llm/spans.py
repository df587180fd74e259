"""Long exact spans shared between records, with repeated-phrase automata.

1. Exact copies are collapsed into classes (md5 of the text); all else runs over one text per class.
2. Of every text phrases of PHRASE characters are chosen by winnowing: of each window of neighbouring phrases the one
   with the least hash.  Any shared span of SPAN characters contains a whole window, hence a phrase chosen in both.
3. Phrases chosen in two classes or more are confirmed as recurring.  The texts lie in shards (buckets of one table) and
   stay there; each shard compiles Aho-Corasick automata of the recurring phrases of its texts and streams the texts
   through them, which locates every occurrence.  (A text without a recurring phrase of its own shares no span.)
4. Two occurrences of a phrase belong to a shared span of SPAN characters if the equal context to the left and right
   together makes up the rest.  For pairs, phrases with at most MANY occurrences are compared pair by pair; beyond that
   equal spans around the phrase meet by their digest.  The coverage makes no pairs at all: it asks which spans around a
   phrase two classes hold, on a grid of places first, and is linear in the occurrences.

Null texts and texts shorter than SPAN share nothing.  Rows repeated under one id count once.  Tables without rows give
no rows.  Comparison is exact, by Unicode characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import bucketed, materialize, once_per_id, partitions

SPAN = 300
PHRASE = 100
MANY, GRID = 64, 25
_B = np.uint64(0x9E3779B97F4A7C15)


def phrase_hashes(text: str, length: int) -> np.ndarray:
    """A 64-bit hash of every substring of `length` characters (position i: text[i:i+length])."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(h)
    if n < length:
        return np.empty(0, np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    out, done, power = None, 0, np.array([_B])  # arrays wrap around without a warning
    bits, at = length, 0
    # h holds hashes of 2^k characters; out those of the low bits of length
    while bits:
        if bits & 1:
            out = h.copy() if out is None else out[: n - at - (1 << done) + 1] * power + h[at : at + n - at - (1 << done) + 1]
            at += 1 << done
        bits >>= 1
        if bits:
            m = 1 << done
            h = h[:-m] * power + h[m:]
            power = power * power
            done += 1
    out = out[: n - length + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(30))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least value of each window of `window` neighbours; of all if there are fewer."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    m = -(-n // window) * window
    x = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    b = x.reshape(-1, window)
    pre = np.minimum.accumulate(b, axis=1).ravel()
    suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suf[: n - window + 1], pre[window - 1 : n])  # of h[i:i+window]
    hit = np.zeros(n, bool)
    # the rightmost place that equals the least of the window: step from each window's end to the last equal value
    order = np.argsort(h, kind="stable")
    same = h[order]
    first = np.searchsorted(same, least, "left")
    last = np.searchsorted(same, least, "right")
    single = last - first == 1
    hit[order[first[single]]] = True
    for i in np.flatnonzero(~single):
        places = order[first[i] : last[i]]
        hit[places[np.searchsorted(places, i + window - 1, "right") - 1]] = True
    return np.flatnonzero(hit)


def _select(span: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reps, hs, at = [], [], []
            for rep, text in zip(pdf["rep"], pdf["text"]):
                h = phrase_hashes(text, phrase)
                places = winnow(h, span - phrase + 1)
                v, i = np.unique(h[places].view(np.int64), return_index=True)
                hs.append(v)
                at.append(places[i])
                reps.append(np.full(len(v), rep))
            if hs:
                yield pd.DataFrame({"rep": np.concatenate(reps), "h": np.concatenate(hs), "pos": np.concatenate(at).astype(np.int32)})

    return run


def _locate(span: int, phrase: int):
    """A task is a shard: it compiles the automaton of the recurring phrases of its texts and streams all its texts through it.

    Texts that come without marks are held back in no way: they cannot share a span, as a shared span has a phrase chosen in both."""
    rest = span - phrase

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        for pdf in batches:  # an automaton for each batch of texts, so that memory is bounded by the batch
            auto = ahocorasick.Automaton()
            for text, marks in zip(pdf["text"], pdf["marks"]):
                for m in marks:
                    auto.add_word(text[m["pos"] : m["pos"] + phrase], int(m["h"]))
            auto.make_automaton()
            out = []
            for rep, text in zip(pdf["rep"], pdf["text"]):
                for end, found in auto.iter(text):
                    a = end + 1 - phrase
                    out.append((found, int(rep), a, text[max(0, a - rest) : a], text[end + 1 : end + 1 + rest]))
            if out:
                yield pd.DataFrame(out, columns=["h", "rep", "pos", "lft", "rgt"])

    return run


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


_LINK = "rep_a bigint, rep_b bigint, a_from int, a_to int, b_from int, b_to int"


def _pairs(span: int, phrase: int):
    rest = span - phrase

    def of(group: list[tuple]) -> list[tuple]:
        out = []
        for i, (_, ra, pa, la, ga) in enumerate(group):
            for _, rb, pb, lb, gb in group[i + 1 :]:
                if ra == rb:
                    continue
                left, right = _common(la[::-1], lb[::-1]), _common(ga, gb)
                if left + right >= rest:
                    x = (ra, rb, pa - left, pa + phrase + right, pb - left, pb + phrase + right)
                    out.append(x if ra < rb else (rb, ra, x[4], x[5], x[2], x[3]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for pdf in batches:
            out = []
            for row in pdf[["h", "rep", "pos", "lft", "rgt"]].itertuples(index=False, name=None):
                if group and group[0][0] != row[0]:
                    out += of(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=["rep_a", "rep_b", "a_from", "a_to", "b_from", "b_to"])
        if group:
            yield pd.DataFrame(of(group), columns=["rep_a", "rep_b", "a_from", "a_to", "b_from", "b_to"])

    return run


def _classes(df: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc, cls, n_chars), (one text per class: rep, text, as a table in buckets by rep).

    Of rows repeated under one id the one with the smallest digest counts.  Only digests travel to find the members and the
    representative of a class; the texts travel once, to the bucket where the later join by rep finds them."""
    d = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).withColumn("cls", F.md5(F.col("text").cast("binary")))
    members = once_per_id(d.withColumn("n_chars", F.length("text")), "doc", "cls", "n_chars").filter((F.col("n_chars") >= span) & F.col("doc").isNotNull())
    members = materialize(members)
    reps = members.groupBy("cls").agg(F.min("doc").alias("doc")).select("doc", F.col("cls").alias("_c"))
    one = d.filter(F.length("text") >= span).join(reps, "doc").filter(F.col("cls") == F.col("_c"))
    return members, bucketed(one.groupBy("doc").agg(F.first("text").alias("text")).withColumnRenamed("doc", "rep"), "rep")


def recurring_phrases(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(members: doc, cls, n_chars), (found: h, rep, pos, lft, rgt of every occurrence of a recurring phrase)."""
    if not 16 <= phrase < span:
        raise ValueError("the phrase must be shorter than the span")
    members, texts = _classes(df, key, text, span)
    chosen = materialize(texts.select("rep", "text").mapInPandas(_select(span, phrase), "rep bigint, h bigint, pos int"))
    again = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    marks = chosen.join(again, "h").groupBy("rep").agg(F.collect_list(F.struct("h", "pos")).alias("marks"))
    found = texts.join(marks, "rep").select("rep", "text", "marks").mapInPandas(_locate(span, phrase), "h bigint, rep bigint, pos int, lft string, rgt string")
    return members, materialize(found)


def shared_links(found: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """Links between classes: rep_a, rep_b and the equal stretch of each around one phrase."""
    n = partitions(found.sparkSession)
    sizes = found.groupBy("h").agg(F.count(F.lit(1)).alias("_m"))
    few = found.join(sizes.filter((F.col("_m") <= MANY) & (F.col("_m") > 1)).select("h"), "h", "left_semi").repartition(n, "h").sortWithinPartitions("h", "rep", "pos")
    links = few.mapInPandas(_pairs(span, phrase), _LINK)
    # many occurrences: equal spans around the phrase meet by their hash
    many = shared_windows(found.join(sizes.filter(F.col("_m") > MANY).select("h"), "h", "left_semi"), span, phrase)
    x, y = many.alias("x"), many.alias("y")
    cond = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("h", "o", "w")]
    hot = x.join(y, [*cond, F.col("x.rep") < F.col("y.rep")]).select(
        F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b"), F.col("x.at").alias("a_from"), (F.col("x.at") + span).alias("a_to"),
        F.col("y.at").alias("b_from"), (F.col("y.at") + span).alias("b_to"),
    )
    return links.unionByName(hot)


def _around(o: str, width: int) -> Column:
    """A digest of `o` characters before the phrase and the rest of `width` behind it; it is compared for one phrase and place only."""
    return F.xxhash64(F.expr(f"right(lft, {o})"), F.expr(f"left(rgt, {width} - {o})"))


def _held_twice(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key two classes or more have."""
    two = rows.groupBy(*key).agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select(*key)
    return rows.join(two, list(key), "left_semi")


def _near_shared(found: DataFrame, span: int, phrase: int) -> DataFrame:
    """Occurrences that may belong to a shared span, with the grid places `gs` near which it may lie.

    Whoever shares a span with `o` characters before the phrase shares, for the grid place g at or below o, g characters
    before it and rest - GRID - g behind.  Eight or so small rows per occurrence; the contexts travel once, for the rest."""
    wide = max(0, span - phrase - GRID)
    c = found.filter(F.length("lft") + F.length("rgt") >= span - phrase)
    near = c.select("h", "rep", "pos", "lft", "rgt", F.explode(F.sequence(F.lit(0), F.lit(wide), F.lit(GRID))).alias("g"))
    near = near.filter((F.length("lft") >= F.col("g")) & (F.length("rgt") >= wide - F.col("g"))).select("h", "rep", "pos", "g", _around("g", wide).alias("w"))
    gs = _held_twice(near, "h", "g", "w").groupBy("h", "rep", "pos").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    return c.join(gs, ["h", "rep", "pos"])


def _places(span: int, phrase: int, gs: Column) -> Column:
    """All o near some grid places that the contexts allow."""
    rest = span - phrase
    every = F.array_distinct(F.flatten(F.transform(gs, lambda g: F.sequence(g, F.least(g + GRID, F.lit(rest))))))
    return F.filter(every, lambda o: (o <= F.length("lft")) & (rest - o <= F.length("rgt")))


def shared_windows(found: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """h, o, w, rep, at: all spans around phrases that two classes or more hold."""
    c = _near_shared(found, span, phrase).select("h", "rep", "pos", "lft", "rgt", F.explode(_places(span, phrase, F.col("gs"))).alias("o"))
    return _held_twice(c.select("h", "o", _around("o", span - phrase).alias("w"), "rep", (F.col("pos") - F.col("o")).alias("at")), "h", "o", "w").distinct()


def shared_stretches(found: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """rep, f, t: the stretch around each occurrence of a phrase that is covered by shared spans.

    All spans around one phrase overlap, so the first and the last shared one say it all: the places near the outermost
    grid places are asked first, everything in between only of occurrences where that finds none."""
    occ = materialize(_near_shared(found, span, phrase))

    def verified(asked: DataFrame) -> DataFrame:
        """h, rep, pos, lo, hi of the shared spans at the asked (h, os), which every occurrence of the phrase answers."""
        o = F.filter("os", lambda x: (x <= F.length("lft")) & (span - phrase - x <= F.length("rgt")) & F.exists("gs", lambda g: (g <= x) & (x <= g + GRID)))
        rows = occ.join(asked, "h").select("h", "rep", "pos", "lft", "rgt", F.explode(o).alias("o")).select("h", "o", _around("o", span - phrase).alias("w"), "rep", "pos")
        return _held_twice(rows, "h", "o", "w").groupBy("h", "rep", "pos").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))

    def asked_of(rows: DataFrame, gs: Column) -> DataFrame:
        return rows.select("h", F.explode(_places(span, phrase, gs)).alias("o")).groupBy("h").agg(F.collect_set("o").alias("os"))

    first = materialize(verified(asked_of(occ, F.array_distinct(F.array(F.element_at("gs", 1), F.element_at("gs", -1))))))
    at = occ.select("h", "rep", "pos", F.element_at("gs", 1).alias("g1"), F.element_at("gs", -1).alias("g2")).join(first, ["h", "rep", "pos"], "left")
    open_ = at.filter(F.col("lo").isNull() | (F.col("hi") < F.col("g2")) | (F.col("lo") > F.col("g1") + GRID)).select("h", "rep", "pos")
    more = verified(asked_of(occ.join(open_, ["h", "rep", "pos"], "left_semi"), F.col("gs")))
    both = first.unionByName(more).groupBy("h", "rep", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.select("rep", (F.col("pos") - F.col("hi")).alias("f"), (F.col("pos") - F.col("lo") + span).alias("t"))


def shared_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_a < doc_b: all pairs of documents with a common substring of at least `span` characters."""
    members, found = recurring_phrases(df, key, text, span)
    reps = shared_links(found, span).select("rep_a", "rep_b").distinct()
    of = members.join(members.groupBy("cls").agg(F.min("doc").alias("rep")), "cls").select("rep", "doc")
    a = of.select(F.col("rep").alias("rep_a"), F.col("doc").alias("da"))
    b = of.select(F.col("rep").alias("rep_b"), F.col("doc").alias("db"))
    across = reps.join(a, "rep_a").join(b, "rep_b")
    m = members.select("cls", F.col("doc").alias("db"))
    inside = members.select("cls", F.col("doc").alias("da")).join(m, "cls").filter("da < db")
    both = across.select("da", "db").unionByName(inside.select("da", "db"))
    return both.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b")).distinct()


def shared_coverage(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document that shares a span: doc_id, class_id, copies (documents with the same text), shared_chars, n_chars.

    No pairs are made: a text gives its own stretches around a phrase, and the work is linear in the occurrences."""
    members, found = recurring_phrases(df, key, text, span)
    cut = shared_stretches(found, span).groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("f", "t"))).alias("iv"))
    fold = F.aggregate(
        "iv",
        F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("end")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["t"] - F.greatest(x["f"], acc["end"]))).alias("sum"), F.greatest(acc["end"], x["t"]).alias("end")),
    )
    cut = cut.select("rep", fold["sum"].alias("cov"))
    size = members.groupBy("cls").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    d = members.join(size, "cls").join(cut, "rep", "left").filter((F.col("copies") > 1) | F.col("cov").isNotNull())
    return d.select(
        F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "copies",
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("cov")).cast("bigint").alias("shared_chars"), F.col("n_chars").cast("bigint").alias("n_chars"),
    )
