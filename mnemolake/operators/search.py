"""Ranked keyword search over an inverted index that is an ordinary table of postings.

A query is parsed on the driver into a tree of phrases, AND, OR, NOT and NEAR; its evaluation is joins over the postings
of the query's terms only.  Stemming happens once per distinct term of the vocabulary, not per token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.functions.porter import stem

_ACCENTED = [(chr(c), d) for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c).lower()) if not unicodedata.combining(x))) == 1 and d != chr(c)]
_FROM, _TO = "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED)
_SPLIT = r"[^\p{L}\p{N}]+"


class QuerySyntaxError(ValueError):
    """The query is not well formed; it is never read as an empty result."""


def fold(x: Column, diacritics: bool = True) -> Column:
    """Lower case, without combining marks and accents."""
    y = F.lower(x)
    return F.regexp_replace(F.translate(y, _FROM, _TO), r"\p{Mn}+", "") if diacritics else y


def fold_word(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))


def tokens(text: Column, diacritics: bool = True) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit("")), diacritics), _SPLIT, -1), lambda w: w != "")


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"term": pdf["term"], "stem": pdf["term"].map(stem)})


@dataclass
class Index:
    """postings: term, doc, tf, pos (array of places from 0), len (words of the document); docs: doc, len.

    A stored index has its postings in `buckets` folders by a hash of the term, each sorted by term: a question reads
    only the buckets of its terms, and there only the row groups that can hold them."""

    postings: DataFrame
    docs: DataFrame
    stemmed: bool = True
    n_docs: int | None = None
    avg_len: float | None = None
    meta: dict = field(default_factory=dict)
    buckets: int | None = None

    def stats(self) -> tuple[int, float]:
        if self.n_docs is None:
            n, s = self.docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            self.n_docs, self.avg_len = n, (s / n if n else 0.0)
        return self.n_docs, self.avg_len

    def rows(self, terms: list[str]) -> DataFrame:
        """The postings of some terms."""
        r = self.postings.filter(F.col("term").isin(terms) if len(terms) > 1 else F.col("term") == terms[0])
        if self.buckets:
            at = [bucket_of(F.lit(t), self.buckets) for t in terms]  # constants: folders are chosen before anything is read
            r = r.filter(F.col("bucket").isin(*at) if len(at) > 1 else F.col("bucket") == at[0])
        return r

    def without(self, ids: DataFrame) -> Index:
        """The index after deletion of documents (a table with column doc)."""
        return Index(self.postings.join(ids, "doc", "left_anti"), self.docs.join(ids, "doc", "left_anti"), self.stemmed, buckets=self.buckets)


def build_index(df: DataFrame, key: str, text: str, stemmed: bool = True, diacritics: bool = True) -> Index:
    d = df.select(F.col(key).alias("doc"), tokens(F.col(text), diacritics).alias("w"))
    docs = d.select("doc", F.size("w").cast("bigint").alias("len"))
    flat = d.select("doc", F.size("w").cast("bigint").alias("len"), F.posexplode("w").alias("at", "term"))
    if stemmed:
        vocab = flat.select("term").distinct().mapInPandas(_stems, "term string, stem string")
        flat = flat.join(vocab, "term").select("doc", "len", "at", F.col("stem").alias("term"))
    postings = flat.groupBy("term", "doc").agg(F.count(F.lit(1)).cast("bigint").alias("tf"), F.array_sort(F.collect_list("at")).alias("pos"), F.first("len").alias("len"))
    return Index(postings, docs, stemmed)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def store_index(index: Index, path: str, buckets: int = 16) -> Index:
    """Write an index once; returns it as it is read back.

    A term with very many postings is spread over the files of its bucket by a salt, so no task writes a bucket alone."""
    spark = index.docs.sparkSession
    n, avg = index.stats()
    p = index.postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    p.repartition(buckets, "bucket", F.pmod(F.xxhash64("doc"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame([(n, avg, index.stemmed, buckets)], "n_docs bigint, avg_len double, stemmed boolean, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    n, avg, stemmed, buckets = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), stemmed, n, avg, buckets=buckets)


# query language


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<sym>[()+*:,^{}-])|(?P<word>[\w\x80-\U0010ffff]+)|(?P<bad>\S))')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m or m["bad"]:
            raise QuerySyntaxError(f"syntax error near {query[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    """expr := and (OR and)*; and := not (AND? not)*; not := atom (NOT atom)*; binding as in the usual full-text grammar."""

    def __init__(self, query: str, columns: tuple[str, ...], stemmed: bool, diacritics: bool = True):
        self.t, self.i, self.columns, self.stemmed, self.diacritics = _lex(query), 0, columns, stemmed, diacritics
        if not self.t:
            raise QuerySyntaxError("empty query")

    def peek(self, kind: str | None = None, value: str | None = None) -> bool:
        if self.i >= len(self.t):
            return False
        k, v = self.t[self.i]
        return (kind is None or k == kind) and (value is None or v == value)

    def take(self) -> tuple[str, str]:
        if self.i >= len(self.t):
            raise QuerySyntaxError("unexpected end of the query")
        self.i += 1
        return self.t[self.i - 1]

    def parse(self):
        node = self.either()
        if self.i < len(self.t):
            raise QuerySyntaxError(f"syntax error near {self.t[self.i][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek("word", "OR"):
            self.take()
            node = Node("or", node, self.both())
        return node

    def both(self):
        node = self.but()
        while self.i < len(self.t) and not self.peek("word", "OR") and not self.peek("sym", ")"):
            if self.peek("word", "AND"):
                self.take()
            node = Node("and", node, self.but())
        return node

    def but(self):
        node = self.atom()
        while self.peek("word", "NOT"):
            self.take()
            node = Node("not", node, self.atom())
        return node

    def atom(self):
        if self.peek("sym", "("):
            self.take()
            node = self.either()
            if not self.peek("sym", ")"):
                raise QuerySyntaxError("missing )")
            self.take()
            return node
        if self.peek("word", "NEAR") and self.i + 1 < len(self.t) and self.t[self.i + 1] == ("sym", "("):
            return self.near()
        if self.peek("word") and self.i + 1 < len(self.t) and self.t[self.i + 1] == ("sym", ":"):
            name = self.take()[1]
            if name not in self.columns:
                raise QuerySyntaxError(f"no such column: {name}")
            self.take()
            return self.atom()
        return self.phrase()

    def near(self):
        self.i += 2
        phrases, distance = [], 10
        while not self.peek("sym", ")"):
            if self.peek("sym", ","):
                self.take()
                k, v = self.take()
                if k != "word" or not v.isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                distance = int(v)
                break
            phrases.append(self.phrase())
        if not self.peek("sym", ")") or not phrases:
            raise QuerySyntaxError("NEAR is not closed")
        self.take()
        return Near(tuple(phrases), distance)

    def phrase(self) -> Phrase:
        words: list[str] = []
        while True:
            k, v = self.take()
            if k == "str":
                words += [x for x in re.split(r"[\W_]+", v) if x]
            elif k == "word" and v not in ("AND", "OR", "NOT"):
                words += [x for x in re.split(r"[\W_]+", v) if x]
            else:
                raise QuerySyntaxError(f"syntax error near {v!r}")
            if not self.peek("sym", "+"):
                break
            self.take()
        prefix = self.peek("sym", "*")
        if prefix:
            self.take()
        if not words:
            raise QuerySyntaxError("a phrase without words")
        words = [fold_word(w) if self.diacritics else w.lower() for w in words]
        return Phrase(tuple(stem(w) if self.stemmed else w for w in words), prefix)


def parse_query(query: str, columns: tuple[str, ...] = ("text",), stemmed: bool = True, diacritics: bool = True):
    return _Parser(query, columns, stemmed, diacritics).parse()


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    if node.op == "not":
        return _phrases(node.left)
    return _phrases(node.left) + _phrases(node.right)


def _followed_at(i: int):
    # no default arguments: a lambda with two parameters would get the index of the element
    return lambda x: F.array_contains("_p", x + i)


def _near_to(k: int, first: int, size: int, reach: int):
    return lambda x: F.exists(f"p{k}", lambda y: (y <= x + first + reach) & (x <= y + size + reach))


def phrase_hits(index: Index, p: Phrase) -> DataFrame:
    """doc, tf, pos (of the first word) of a phrase; the last word may be a prefix."""
    out = None
    for i, w in enumerate(p.words):
        last = p.prefix and i == len(p.words) - 1
        rows = index.postings.filter(F.col("term").startswith(w)) if last else index.rows([w])
        if last:
            rows = rows.groupBy("doc", "len").agg(F.array_sort(F.flatten(F.collect_list("pos"))).alias("pos"))
        rows = rows.select("doc", "len", F.col("pos").alias("_p"))
        if out is None:
            out = rows.withColumnRenamed("_p", "pos")
        else:
            out = out.join(rows.drop("len"), "doc").select("doc", "len", F.filter("pos", _followed_at(i)).alias("pos"))
    return out.filter(F.size("pos") > 0).select("doc", F.size("pos").cast("bigint").alias("tf"), "pos", "len")


def _every_phrase(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return _every_phrase(node.left) + _every_phrase(node.right)


def _hits(index: Index, phrases: list[Phrase]) -> DataFrame:
    """k (number of the phrase), doc, tf, pos, len: single words by one read of their buckets."""
    single = {p.words[0]: k for k, p in enumerate(phrases) if len(p.words) == 1 and not p.prefix}
    out = None
    if single:
        k = F.element_at(F.create_map(*[F.lit(x) for w, n in single.items() for x in (w, n)]), F.col("term"))
        out = index.rows(list(single)).select(k.alias("k"), "doc", "tf", "pos", "len")
    for k, p in enumerate(phrases):
        if len(p.words) > 1 or p.prefix:
            h = phrase_hits(index, p).select(F.lit(k).alias("k"), "doc", "tf", "pos", "len")
            out = h if out is None else out.unionByName(h)
    return out


def _holds(node, number: dict[Phrase, int]) -> Column:
    """The tree as a condition on m0, m1.. (whether a phrase matched) and p0, p1.. (its places)."""
    if isinstance(node, Phrase):
        return F.coalesce(F.col(f"m{number[node]}"), F.lit(False))
    if isinstance(node, Near):
        found = _all(_holds(p, number) for p in node.phrases)
        if len(node.phrases) == 1:
            return found
        # every phrase within the distance of a place of the first; a span of the group is at most distance words
        first, reach = len(node.phrases[0].words), node.distance
        near = [_near_to(number[p], first, len(p.words), reach) for p in node.phrases[1:]]
        return found & F.coalesce(F.exists(f"p{number[node.phrases[0]]}", lambda x: _all(f(x) for f in near)), F.lit(False))
    a, b = _holds(node.left, number), _holds(node.right, number)
    return a & b if node.op == "and" else a | b if node.op == "or" else a & ~b


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def ranked(index: Index, query: str, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc, rank: matching documents with their bm25 rank (lower is better)."""
    tree = parse_query(query, columns, index.stemmed)
    n, avg = index.stats()
    phrases = list(dict.fromkeys(_every_phrase(tree)))
    number = {p: k for k, p in enumerate(phrases)}
    scored = sorted({number[p] for p in _phrases(tree)})
    hits = _hits(index, phrases)
    df = hits.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.select("k", F.when(raw <= 0, X.BM25_IDF_FLOOR).otherwise(raw).alias("idf"))
    tf, k1, b = F.col("tf"), X.BM25_K1, X.BM25_B
    gain = F.when(F.col("k").isin(scored), F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(avg or 1.0))))
    flags = [F.max(F.when(F.col("k") == k, F.lit(True))).alias(f"m{k}") for k in range(len(phrases))]
    places = [F.first(F.when(F.col("k") == number[p], F.col("pos")), ignorenulls=True).alias(f"p{number[p]}") for p in phrases if _in_near(tree, p)]
    s = hits.join(F.broadcast(idf), "k").groupBy("doc").agg((-F.sum(gain)).alias("rank"), *flags, *places)  # idf: one row per phrase
    return s.filter(_holds(tree, number)).select("doc", "rank")


def _in_near(node, p: Phrase) -> bool:
    if isinstance(node, Near):
        return p in node.phrases
    return isinstance(node, Node) and (_in_near(node.left, p) or _in_near(node.right, p))


def hit_limit(limit: int | None) -> int:
    return max(0, min(X.DEFAULT_HITS if limit is None else limit, X.MAX_HITS))


def search(index: Index, df: DataFrame, key: str, query: str, limit: int | None = None) -> DataFrame:
    """The best hits joined with their records; ties by key."""
    top = ranked(index, query).orderBy("rank", "doc").limit(hit_limit(limit))
    return df.join(F.broadcast(top.withColumnRenamed("doc", key)), key).orderBy("rank", key)  # MAX_HITS rows


def serving(df: DataFrame, time: str = "captured_at_ms") -> DataFrame:
    """The projection that is served: no rank, times as double."""
    return df.drop("rank").withColumn(time, F.col(time).cast("double"))


# snippets


def snippet(text: str | None, query: str, before: str = "[", after: str = "]", dots: str = " … ", width: int = X.SNIPPET_TOKENS, stemmed: bool = True) -> str:
    """The window of `width` tokens with most matches of different terms, every match in brackets."""
    text = text or ""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [stem(fold_word(text[a:z])) if stemmed else fold_word(text[a:z]) for a, z in spans]
    marked = [False] * len(words)
    kinds: list[int] = [-1] * len(words)
    for n, p in enumerate(_phrases(parse_query(query, stemmed=stemmed))):
        k = len(p.words)
        for i in range(len(words) - k + 1):
            part = words[i : i + k]
            if part[:-1] == list(p.words[:-1]) and (part[-1].startswith(p.words[-1]) if p.prefix else part[-1] == p.words[-1]):
                for j in range(i, i + k):
                    marked[j], kinds[j] = True, n
    if not spans:
        return text
    best, at = -1, 0
    for i in range(max(1, len(words) - width + 1)):
        got = [k for k in kinds[i : i + width] if k >= 0]
        value = 1000 * len(set(got)) + len(got)
        if value > best:
            best, at = value, i
    end = min(at + width, len(words))
    out = [] if at == 0 else [dots.lstrip()]
    pos = 0 if at == 0 else spans[at][0]
    i = at
    while i < end:
        if marked[i]:
            j = i
            while j + 1 < end and marked[j + 1] and kinds[j + 1] == kinds[i]:
                j += 1
            out += [text[pos : spans[i][0]], before, text[spans[i][0] : spans[j][1]], after]
            pos = spans[j][1]
            i = j + 1
        else:
            out.append(text[pos : spans[i][1]])
            pos = spans[i][1]
            i += 1
    out.append(text[pos:] if end == len(words) else dots.rstrip())
    return "".join(out)


def with_snippets(hits: DataFrame, text: str, query: str) -> DataFrame:
    """Adds a snippet to the few hits of a search."""

    @F.pandas_udf("string")
    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet(t, query))

    return hits.withColumn("snippet", make(F.col(text)))


def search_many(index: Index, queries: DataFrame, k: int = 10, mode: str = "or") -> DataFrame:
    """qid, doc, score, rank_no: many bag-of-words queries (qid, query) in one join instead of a loop."""
    n, avg = index.stats()
    q = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    if index.stemmed:
        vocab = q.select("term").distinct().mapInPandas(_stems, "term string, stem string")
        q = q.join(vocab, "term").select("qid", F.col("stem").alias("term")).distinct()
    terms = q.select("term").distinct()
    post = index.postings.select("term", "doc", "tf", "len").join(terms, "term", "left_semi")
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = idf.select("term", F.when(raw <= 0, X.BM25_IDF_FLOOR).otherwise(raw).alias("idf"))
    tf, k1, b = F.col("tf"), X.BM25_K1, X.BM25_B
    s = post.join(idf, "term")
    s = s.select("term", "doc", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(avg or 1.0)))).alias("gain"))
    s = q.join(s, "term").groupBy("qid", "doc").agg(F.sum("gain").alias("score"), F.count(F.lit(1)).alias("matched"))
    if mode == "and":
        s = s.join(q.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted")), "qid").filter("matched = wanted").drop("wanted")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc")
    return s.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k).select("qid", "doc", "score", "rank_no")


def memory_index(spark: SparkSession, rows: list[tuple[int, str]]) -> tuple[Index, DataFrame]:
    """A small index over literal rows (id, text)."""
    df = spark.createDataFrame(rows, "id bigint, text string")
    return build_index(df, "id", "text"), df
