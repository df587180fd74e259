"""Named queries of the core: name -> function of (spark, directory of the tables), and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import fixed as X
from mnemolake.functions import text as T
from mnemolake.operators import activity, evaluate, graph, privacy, retrieval, search, sessions, vectors
from mnemolake.plans import sql as S
from mnemolake.plans import tools
from mnemolake.session import once_per_id, stored_path, table
from mnemolake.sources import store

CORE: dict = {}
CORE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        CORE[f.__name__] = f
        if sql is not None:
            CORE_SQL[f.__name__] = sql
        return f

    return add


def big(x):
    return x.cast("bigint")


# sessions

_SESSIONS = """
r AS (SELECT id, min(captured_at_ms) AS t, arg_min(session_id, captured_at_ms) AS s, arg_min(app_name, captured_at_ms) AS a FROM memory_records
      WHERE captured_at_ms > 0 AND session_id <> '' GROUP BY id),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY s ORDER BY t) <= 1800000 THEN 0 ELSE 1 END AS n FROM r),
h AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY t) AS k FROM g),
z AS (SELECT *, min(t) OVER (PARTITION BY s, k) AS start_ms FROM h)
"""


@query(f"WITH {_SESSIONS} SELECT s AS session_id, start_ms, max(t) AS end_ms FROM z GROUP BY s, start_ms")
def p3_found(spark, d):
    return sessions.sessionize(table(spark, d, "memory_records")).select("session_id", "start_ms", "end_ms")


@query(f"WITH {_SESSIONS} SELECT s AS session_id, start_ms, max(t) AS end_ms, max(t) - start_ms AS duration_ms, count(*) AS n_events FROM z GROUP BY s, start_ms")
def p3_sessions(spark, d):
    return sessions.sessionize(table(spark, d, "memory_records"))


@query(f"WITH {_SESSIONS} SELECT s AS session_id, start_ms, lower(trim(coalesce(a, ''))) AS app_name, count(*) AS n_events FROM z GROUP BY 1, 2, 3")
def p3_app_counts(spark, d):
    return sessions.session_app_counts(table(spark, d, "memory_records"))


# lines of text


def _lines(spark, d) -> DataFrame:
    t = table(spark, d, "documents", True).select("doc_id", T.col("app_name").alias("app"), F.posexplode(T.text_lines(T.col("text"))).alias("p", "_x"))
    return t.select("doc_id", "app", big(F.col("p") + 1).alias("pos"), T.normalize_inline(F.col("_x")).alias("x")).filter("x <> ''")


_FLAGS = {
    "tab_strip": (T.tab_strip, S.strip_row("x", "·", 42)), "pipe_row": (T.pipe_row, S.strip_row("x", "|", 36)), "compact_caption": (T.compact_caption, S.compact("x")),
    "is_separator": (T.separator, S.separator("x")), "file_inventory": (T.file_inventory, S.inventory("x")), "json_inventory": (T.json_inventory, S.json_like("x")),
    "notification": (T.notification, S.notification("x")), "feed_fragment": (T.feed_fragment, S.feed("x")), "animation": (T.animation, S.animation("x")),
    "mail_header": (T.mail_header, S.any_start("lower(x)", X.MAIL_HEADERS)), "url_line": (T.url_line, S.url("x")), "generic_label": (T.generic_label, S.label("x")),
}


@query(f"WITH {S.LINES} SELECT doc_id, " + ", ".join(f"count(*) FILTER ({s}) AS {k}" for k, (_, s) in _FLAGS.items()) + f", round(avg({S.symbols('x')}), 6) AS symbol_ratio FROM lines GROUP BY doc_id")
def line_flags(spark, d):
    x = F.col("x")
    counts = [F.count_if(f(x)).alias(k) for k, (f, _) in _FLAGS.items()]
    return _lines(spark, d).groupBy("doc_id").agg(*counts, F.round(F.avg(T.symbol_ratio(x)), 6).alias("symbol_ratio"))


_APPS = ["Safari", "Terminal", "Mail"]


@query(f"WITH {S.LINES}, a AS (SELECT unnest(['Safari', 'Terminal', 'Mail']) AS test_app) SELECT doc_id, test_app, count(*) AS n, count(*) FILTER ({S.drop('test_app', 'x')}) AS dropped FROM lines, a GROUP BY ALL")
def drop_line_flags(spark, d):
    lines = _lines(spark, d).withColumn("test_app", F.explode(F.array(*[F.lit(a) for a in _APPS])))
    return lines.groupBy("doc_id", "test_app").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.should_drop(F.col("test_app"), F.col("x"))).alias("dropped"))


@query(f"WITH {S.LINES} SELECT doc_id, pos, round({S.quality('app', 'x', '(doc_id + pos) % 3 = 0')}, 6) AS quality FROM lines")
def line_quality(spark, d):
    low = (F.col("doc_id") + F.col("pos")) % 3 == 0
    return _lines(spark, d).select("doc_id", "pos", F.round(T.line_quality(F.col("app"), F.col("x"), low), 6).alias("quality"))


def _docs(spark, d):
    return table(spark, d, "documents", True), T.col("app_name"), T.col("text")


@query(
    f"WITH {S.LINES}, w AS (SELECT doc_id, CASE WHEN {S.drop('app', 'x')} OR strlen(x) < 7 THEN 1.0 WHEN {S.symbols('x')} > 0.5 THEN least(greatest(({S.symbols('x')} - 0.5) * 1.8, 0.0), 1.0) ELSE 0.0 END AS v FROM lines) "
    "SELECT d.doc_id, round(coalesce(least(sum(v) / count(v), 1.0), 1.0), 6) AS noise FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id"
)
def noise_score(spark, d):
    t, app, text = _docs(spark, d)
    return t.select("doc_id", F.round(T.noise_score(app, text), 6).alias("noise"))


_REDUCED = f"""{S.LINES}, kept AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS nth FROM lines WHERE strlen(x) >= 7 AND NOT {S.drop('app', 'x')}),
reduced AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS t FROM kept WHERE nth = 1 GROUP BY doc_id)"""


@query(f"WITH {_REDUCED} SELECT d.doc_id, coalesce(t, '') AS cleaned FROM documents d LEFT JOIN reduced USING (doc_id)")
def reduce_chrome_noise(spark, d):
    t, app, text = _docs(spark, d)
    return t.select("doc_id", T.reduce_noise(app, text).alias("cleaned"))


@query(
    f"""WITH {_REDUCED}, q AS (SELECT doc_id, pos, x, {S.drop('app', 'x')} AS dropped, {S.quality('app', 'x')} AS q FROM lines),
    k AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS nth FROM q WHERE NOT dropped AND q >= 0.36 AND strlen(x) >= 7),
    o AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS t, count(*) AS kept FROM k WHERE nth = 1 GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (dropped) AS noise, count(*) FILTER (NOT dropped AND (q < 0.36 OR strlen(x) < 7)) AS weak, avg(q) AS score FROM q GROUP BY doc_id)
    SELECT d.doc_id, coalesce(o.t, r.t, '') AS signal_text, coalesce(total, 0) AS total_lines, coalesce(kept, 0) AS kept_lines, coalesce(noise, 0) AS dropped_noise_lines,
    coalesce(weak, 0) AS dropped_low_signal_lines, round(coalesce(score, 0.0), 6) AS avg_line_score
    FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN reduced r USING (doc_id) LEFT JOIN s USING (doc_id)"""
)
def high_signal_text(spark, d):
    t, app, text = _docs(spark, d)
    h = t.select("doc_id", T.high_signal(app, text).alias("h"))
    return h.select(
        "doc_id", F.col("h.text").alias("signal_text"), "h.total_lines", "h.kept_lines", "h.dropped_noise_lines", "h.dropped_low_signal_lines",
        F.round("h.avg_line_score", 6).alias("avg_line_score"),
    )


# a title of each kind: none, the app itself, a generic one, a web address, a telling one
_TITLE = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN coalesce(app_name, '') WHEN 2 THEN 'New  Tab' WHEN 3 THEN 'https://' || source || '/p' ELSE 'Ledger of ' || source || ' ' || doc_id END"
_SHORT = "CASE WHEN length({0}) > 220 THEN substring({0}, 1, 217) || '...' ELSE {0} END"


@query(
    f"""WITH {S.LINES}, h AS (SELECT doc_id, a, t, t <> '' AND {S.useful('a', 't')} AS good FROM (SELECT doc_id, coalesce(app_name, '') AS a, {S.inline(_TITLE)} AS t FROM documents)),
    u AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS nth FROM lines JOIN h USING (doc_id)
          WHERE {S.useful('app', 'x')} AND NOT {S.inventory('x')} AND NOT {S.json_like('x')} AND (NOT good OR lower(x) <> lower(t))),
    v AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM u WHERE nth = 1),
    w AS (SELECT doc_id, string_agg(x, ' | ' ORDER BY k) AS two FROM v WHERE k <= 2 GROUP BY doc_id),
    y AS (SELECT doc_id, a, t, good, coalesce(two, '') AS two, CASE WHEN coalesce(two, '') = '' THEN t ELSE t || ': ' || two END AS whole FROM h LEFT JOIN w USING (doc_id))
    SELECT doc_id, CASE WHEN good THEN {_SHORT.format('whole')} WHEN two <> '' THEN {_SHORT.format('two')} WHEN t <> '' THEN {_SHORT.format('t')}
    WHEN {S.trim('a')} <> '' THEN 'Using ' || {S.trim('a')} ELSE '' END AS snippet FROM y"""
)
def fallback_snippet(spark, d):
    t, app, text = _docs(spark, d)
    n = F.col("doc_id") % 5
    title = F.when(n == 0, "").when(n == 1, app).when(n == 2, "New  Tab").when(n == 3, F.concat(F.lit("https://"), "source", F.lit("/p"))).otherwise(F.concat(F.lit("Ledger of "), "source", F.lit(" "), "doc_id"))
    return t.select("doc_id", T.fallback_snippet(app, title, text).alias("snippet"))


@query()
def salient_spans(spark, d):
    t, app, text = _docs(spark, d)
    s = t.select("doc_id", text.alias("text"), T.salient_spans(app, text).alias("s"))
    return s.select("doc_id", F.size("s").alias("spans"), F.round(T.concentration(F.col("s")), 6).alias("concentration"), T.compress_evidence(F.col("s"), F.col("text"), 320).alias("evidence"))


# every third line recognised badly
@query(
    f"""WITH {_REDUCED}, q AS (SELECT doc_id, pos, x, pos % 3 = 0 AS low, {S.drop('app', 'x')} AS dropped, {S.quality('app', 'x', 'pos % 3 = 0')} AS q FROM lines),
    k AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS nth FROM q WHERE NOT dropped AND q >= 0.36 AND strlen(x) >= 7),
    o AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS t, count(*) AS kept FROM k WHERE nth = 1 GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (low) AS lows, avg(q) AS score FROM q GROUP BY doc_id)
    SELECT d.doc_id, coalesce(o.t, r.t, '') AS signal_text, coalesce(total, 0) AS total_lines, coalesce(kept, 0) AS kept_lines, coalesce(lows, 0) AS low_conf_lines, round(coalesce(score, 0.0), 6) AS avg_line_score
    FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN reduced r USING (doc_id) LEFT JOIN s USING (doc_id)"""
)
def high_signal_low_conf(spark, d):
    t, app, text = _docs(spark, d)
    marked = F.array_join(F.transform(T.text_lines(text), lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit(X.LOW_CONF + " "), x)).otherwise(x)), "\n")
    h = t.select("doc_id", app.alias("app"), marked.alias("m")).select("doc_id", T.high_signal(F.col("app"), F.col("m")).alias("h"))
    return h.select("doc_id", F.col("h.text").alias("signal_text"), "h.total_lines", "h.kept_lines", "h.low_conf_lines", F.round("h.avg_line_score", 6).alias("avg_line_score"))


# recognised text

_CONF = "((doc_id * 31 + pos * 17) % 100)"


def _ocr_lines(spark, d):
    t = table(spark, d, "documents", True).filter("text is not null")
    conf = lambda i: (F.pmod(F.col("doc_id") * 31 + (i + 1) * 17, F.lit(100)) / 100).cast("float")
    return t.select("doc_id", F.transform(T.text_lines(F.col("text")), lambda x, i: F.struct(x.alias("text"), conf(i).alias("confidence"))).alias("lines"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS raw FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS a FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, pos, {S.inline('raw')} AS x, {_CONF} AS c FROM l),
    f AS (SELECT *, lag(lower(x)) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM m WHERE c >= 40 AND x <> ''),
    k AS (SELECT * FROM f WHERE p IS NULL OR p <> lower(x)),
    a AS (SELECT doc_id, count(*) AS lines, avg(c / 100.0) AS avg_all, count(*) FILTER (NOT (c >= 40 AND x <> '')) AS dropped FROM m GROUP BY doc_id),
    b AS (SELECT doc_id, string_agg(CASE WHEN c < 65 THEN '[LOW_CONF] ' || x ELSE x END, chr(10) ORDER BY pos) AS t, count(*) AS used, count(*) FILTER (c < 65) AS low, avg(c / 100.0) AS avg_kept FROM k GROUP BY doc_id)
    SELECT doc_id, coalesce(t, '') AS ocr_text, coalesce(used, 0) AS lines_used, dropped AS lines_dropped, coalesce(low, 0) AS low_conf_count, round(avg_all + 1e-7, 4) AS avg_confidence_all, round(coalesce(avg_kept, 0) + 1e-7, 4) AS avg_confidence_kept
    FROM a LEFT JOIN b USING (doc_id)"""
)
def ocr_preprocess(spark, d):
    o = _ocr_lines(spark, d).select("doc_id", T.ocr_preprocess(F.col("lines")).alias("o"))
    return o.select("doc_id", F.col("o.text").alias("ocr_text"), "o.lines_used", "o.lines_dropped", "o.low_conf_count", F.round(F.col("o.avg_confidence_all") + 1e-7, 4).alias("avg_confidence_all"), F.round(F.col("o.avg_confidence_kept") + 1e-7, 4).alias("avg_confidence_kept"))


@query(
    f"""WITH l AS (SELECT frame_id, unnest(range(1, len(a) + 1)) AS pos, {S.trim('unnest(a)')} AS x FROM (SELECT frame_id, string_split_regex(text, '\\r?\\n') AS a FROM (SELECT frame_id, min(text) AS text FROM recognized_texts GROUP BY frame_id) WHERE text IS NOT NULL)),
    k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, lower(x) ORDER BY pos) AS nth FROM l WHERE strlen(x) >= 7 AND NOT {S.ocr_noise('x')}),
    n AS (SELECT frame_id, x, row_number() OVER (PARTITION BY frame_id ORDER BY pos) AS r FROM k WHERE nth = 1),
    o AS (SELECT frame_id, string_agg(x, chr(10) ORDER BY r) AS t FROM n WHERE r <= 220 GROUP BY frame_id)
    SELECT r.frame_id, coalesce(o.t, '') AS normal_text FROM (SELECT DISTINCT frame_id FROM recognized_texts WHERE text IS NOT NULL) r LEFT JOIN o USING (frame_id)"""
)
def ocr_normalize(spark, d):
    t = once_per_id(table(spark, d, "recognized_texts").filter("text is not null"), "frame_id", "text")
    return t.select("frame_id", T.ocr_normalize(F.col("text")).alias("normal_text"))


@query(
    """WITH r AS (SELECT DISTINCT frame_id, coalesce(text, '') AS text, confidence, block_count FROM recognized_texts), s AS (SELECT *, strlen(trim(text, chr(10) || chr(13) || chr(9) || ' ')) AS n FROM r)
    SELECT frame_id, n AS chars, CASE WHEN n < 80 THEN false ELSE (n >= 400 AND confidence >= 0.35::FLOAT) OR (n >= 200 AND block_count >= 10 AND confidence >= 0.35::FLOAT) OR (block_count >= 5 AND confidence >= 0.55::FLOAT) END AS qualifies FROM s"""
)
def text_volume(spark, d):
    r = table(spark, d, "recognized_texts").select("frame_id", T.col("text").alias("text"), "confidence", "block_count").distinct()
    n = T.bytes_of(F.regexp_replace("text", r"^[\n\r\t ]+|[\n\r\t ]+\z", ""))
    return r.select("frame_id", big(n).alias("chars"), F.coalesce(T.text_volume(n, F.col("confidence"), F.col("block_count")), F.lit(None).cast("boolean")).alias("qualifies"))


# search


_STORED: dict[tuple, search.Index] = {}


def _index(spark, d, stemmed=False, name="documents", key="doc_id"):
    """The stored index of the texts of a table; built once per application and read by every question after."""
    at = (spark.sparkContext.applicationId, d, stemmed, name)
    if at not in _STORED:
        t = table(spark, d, name, True)
        t = t if key == "doc_id" else once_per_id(t, key, "text")
        _STORED[at] = search.store_index(search.build_index(t, key, "text", stemmed=stemmed, diacritics=stemmed), stored_path(spark, "index-"))
    return _STORED[at]


def _search_sql(terms: list[str], need: int) -> str:
    t = ", ".join(S.lit(x) for x in terms)
    return f"""WITH {S.WORDS} SELECT doc_id, round(-sum({S.GAIN}), 6) AS rank FROM tf JOIN idf USING (term) JOIN lens USING (doc_id), st WHERE term IN ({t})
    GROUP BY doc_id HAVING count(*) >= {need} ORDER BY -sum({S.GAIN}), doc_id LIMIT 50"""


def _top(index, q):
    return search.ranked(index, q).orderBy(F.col("rank"), "doc").limit(X.MAX_HITS).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(_search_sql(["orchard", "lantern"], 2))
def keyword_search_bm25(spark, d):
    return _top(_index(spark, d), "orchard lantern")


@query(_search_sql(["orchard", "lantern", "compass"], 1))
def keyword_search_or(spark, d):
    return _top(_index(spark, d), "orchard OR lantern OR compass")


@query(
    f"""WITH {S.WORDS}, p AS (SELECT doc_id, count(*) AS tf FROM flat WHERE starts_with(term, 'harb') GROUP BY doc_id),
    i AS (SELECT greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, st GROUP BY docs)
    SELECT doc_id, round(-({S.GAIN}), 6) AS rank FROM p JOIN lens USING (doc_id), st, i ORDER BY -({S.GAIN}), doc_id LIMIT 50"""
)
def prefix_search(spark, d):
    return _top(_index(spark, d), "harb*")


@query(
    f"""WITH {S.WORDS}, p AS (SELECT a.doc_id, count(*) AS tf FROM flat a JOIN flat b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'so' AND b.term = 'the' GROUP BY a.doc_id),
    i AS (SELECT CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, st GROUP BY docs)
    SELECT doc_id, round(-({S.GAIN}), 6) AS rank FROM p JOIN lens USING (doc_id), st, i ORDER BY round(-({S.GAIN}), 6), doc_id LIMIT 50"""
)
def phrase_search(spark, d):
    r = search.ranked(_index(spark, d), '"so the"').withColumn("rank", F.round("rank", 6))
    return r.orderBy("rank", "doc").limit(X.MAX_HITS).select(F.col("doc").alias("doc_id"), "rank")


@query(
    f"""WITH {S.WORDS} SELECT DISTINCT f.doc_id FROM flat f WHERE term = 'orchard' AND doc_id NOT IN (SELECT doc_id FROM flat WHERE term = 'lantern')"""
)
def not_search(spark, d):
    return search.ranked(_index(spark, d), "orchard NOT lantern").select(F.col("doc").alias("doc_id"))


@query(f"WITH {S.WORDS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, (SELECT docs FROM st) AS docs, round((SELECT avg_len FROM st), 6) AS avg_len FROM tf GROUP BY term")
def postings_stats(spark, d):
    i = search.build_index(table(spark, d, "documents", True), "doc_id", "text", stemmed=False, diacritics=False)  # the build itself
    n, avg = i.stats()
    return i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("docs", big(F.lit(n))).withColumn("avg_len", F.round(F.lit(avg), 6))


@query()
def stemmed_search(spark, d):
    docs = table(spark, d, "documents")
    hits = search.search(_index(spark, d, stemmed=True), docs.select("doc_id", "source", "captured_at_ms", "text"), "doc_id", "lanterns recording")
    return search.serving(search.with_snippets(hits, "text", "lanterns recording")).select("doc_id", "source", "captured_at_ms", "snippet")


# evaluation


def _eval(spark, d):
    q = once_per_id(table(spark, d, "eval_items"), "item_id", "query", "relevant").select(F.col("item_id").alias("qid"), "query", "relevant")
    return evaluate.run_baseline(_index(spark, d, name="corpus_records", key="id"), q, mode="or")


@query(
    r"""WITH c AS (SELECT id, min(text) AS text FROM corpus_records GROUP BY id), tok AS (SELECT id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM c),
    lens AS (SELECT id, len(w) AS n FROM tok), st AS (SELECT count(*) AS docs, sum(n)::DOUBLE / count(*) AS avg_len FROM lens),
    tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY 1, 2),
    idf AS (SELECT term, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, st GROUP BY term, docs),
    q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM eval_items),
    s AS (SELECT item_id, id, sum("""
    + S.GAIN
    + r""") AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (id), st GROUP BY 1, 2),
    r AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS k FROM s),
    l AS (SELECT item_id, unnest(relevant) AS id, len(relevant) AS m FROM eval_items)
    SELECT e.item_id, round(coalesce(count(k) FILTER (k <= 5) / any_value(m)::DOUBLE, 0), 6) AS recall_at_5, round(coalesce(1.0 / min(k) FILTER (k <= 10), 0), 6) AS rr_at_10
    FROM eval_items e LEFT JOIN l USING (item_id) LEFT JOIN r ON r.item_id = l.item_id AND r.id = l.id GROUP BY e.item_id"""
)
def eval_recall_mrr(spark, d):
    return _eval(spark, d).select(F.col("qid").alias("item_id"), F.round("recall", 6).alias("recall_at_5"), F.round("rr", 6).alias("rr_at_10"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(value) FILTER (i = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (i = floor((n - 1) * 0.95 + 0.5)) AS p95 FROM r GROUP BY event_type"""
)
def eval_percentile(spark, d):
    e = table(spark, d, "events")
    p50 = evaluate.exact_percentile(e, "value", 0.5, "event_type").withColumnRenamed("percentile", "p50")
    return p50.join(evaluate.exact_percentile(e, "value", 0.95, "event_type").withColumnRenamed("percentile", "p95"), "event_type")


# vectors


def _probe(spark, d):
    return F.broadcast(table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("_p")))  # one row


_DIST = "sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p ORDER BY {_DIST}, e.vec_id LIMIT 10")
def knn_exact(spark, d):
    e = table(spark, d, "embeddings").join(_probe(spark, d))
    return vectors.knn(e, "vec_id", "embedding", F.col("_p")).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p WHERE e.label = 3 AND e.vec_id > 20 ORDER BY {_DIST}, e.vec_id LIMIT 10")
def knn_prefilter(spark, d):
    e = table(spark, d, "embeddings").filter((F.col("label") == 3) & (F.col("vec_id") > 20)).join(_probe(spark, d))
    return vectors.knn(e, "vec_id", "embedding", F.col("_p")).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH x AS (SELECT p.vec_id AS probe, e.vec_id AS id, {_DIST} AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) p),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(distance, 9), id) AS rank FROM x) SELECT probe, id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5"""
)
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    x = vectors.knn_batch(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return x.select("probe", "id", big(F.col("rank")).alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    """WITH c AS (SELECT vec_id, embedding[1:48]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM c)
    SELECT vec_id, len(v) AS dim, round(v[1] / l, 6) AS first, round(v[48] / l, 6) AS last FROM n"""
)
def knn_renormalised(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.renormalised(F.col("embedding"), 48).alias("v"))
    return e.select("vec_id", big(F.size("v")).alias("dim"), F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 47), 6).alias("last"))


@query()
def knn_cells(spark, d):
    e = table(spark, d, "embeddings")
    indexed, centres = vectors.ivf_cells(e, "vec_id", "embedding", 16)
    probe = e.filter("vec_id = 0").select("embedding").first()[0]
    return vectors.ann(indexed, centres, "vec_id", "embedding", probe, 10, 4).select("vec_id", F.round("distance", 6).alias("distance"), "mode")


@query(
    f"""WITH {S.WORDS}, k AS (SELECT doc_id AS id, -sum({S.GAIN}) AS o FROM tf JOIN idf USING (term) JOIN lens USING (doc_id), st WHERE term IN ('orchard', 'lantern') GROUP BY doc_id),
    kr AS (SELECT id, row_number() OVER (ORDER BY round(o, 9), id) AS rank FROM k), v AS (SELECT e.vec_id AS id, {_DIST} AS o FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p),
    vr AS (SELECT id, row_number() OVER (ORDER BY round(o, 9), id) AS rank FROM v), u AS (SELECT * FROM kr WHERE rank <= 50 UNION ALL SELECT * FROM vr WHERE rank <= 50)
    SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id LIMIT 10"""
)
def hybrid_rrf(spark, d):
    k = retrieval.route(search.ranked(_index(spark, d), "orchard OR lantern"), "keyword", F.round("rank", 9), "doc")
    e = table(spark, d, "embeddings").join(_probe(spark, d)).select("vec_id", F.sqrt(vectors.l2_squared(F.col("embedding"), F.col("_p"))).alias("o"))
    return retrieval.hybrid(k, retrieval.route(e, "vector", F.round("o", 9), "vec_id")).select("id", F.round("score", 9).alias("score"))


# privacy

_BLOCKED_APPS = ["Browser", "huddle  bay", "Pin"]
_BLOCKED_DOMAINS = ["https://larkwiki.example:443", ".post.example"]


@query(
    r"""WITH a AS (SELECT DISTINCT app_name, ' ' || lower(trim(regexp_replace(coalesce(app_name, ''), '\s+', ' ', 'g'))) || ' ' AS n FROM memory_records)
    SELECT app_name, contains(n, ' browser ') OR contains(n, ' huddle bay ') OR contains(n, ' pin ') AS blocked FROM a"""
)
def block_app(spark, d):
    apps = table(spark, d, "memory_records").select("app_name").distinct()
    return privacy.block_apps(apps, "app_name", privacy.app_list(spark, _BLOCKED_APPS)).select("app_name", "blocked")


@query(
    """WITH u AS (SELECT DISTINCT 'https://www.' || lower(replace(source, 'web:', '')) || '/x?next=post.example' AS url, 'www.' || lower(replace(source, 'web:', '')) AS h FROM corpus_records)
    SELECT url, h = 'larkwiki.example' OR ends_with(h, '.larkwiki.example') OR h = 'post.example' OR ends_with(h, '.post.example') AS blocked FROM (SELECT url, regexp_extract(h, '^[^:/]*') AS h FROM u)"""
)
def block_url(spark, d):
    u = table(spark, d, "corpus_records").select(F.concat(F.lit("https://www."), F.lower(F.replace("source", F.lit("web:"), F.lit(""))), F.lit("/x?next=post.example")).alias("url")).distinct()
    return privacy.block_urls(u, "url", privacy.domain_list(spark, _BLOCKED_DOMAINS)).select("url", "blocked")


_GATES = {**privacy.SECRETS, "word": r"(?i)\bcursor\b"}
_RED = "coalesce(text, '')"
for _name, _pattern in _GATES.items():
    _RED = f"regexp_replace({_RED}, '{_pattern}', '[{_name}]', 'g')"


@query(
    f"""WITH r AS (SELECT doc_id, lower(coalesce(app_name, '')) = 'termite' AS skip, coalesce(text, '') AS t, {_RED} AS red FROM documents)
    SELECT doc_id, CASE WHEN skip THEN 'SkipStorage' WHEN red <> t THEN 'Redact' ELSE 'Allow' END AS decision, CASE WHEN NOT skip THEN red END AS stored_text FROM r"""
)
def safety_gate(spark, d):
    return privacy.safety_gate(table(spark, d, "documents"), "text", F.lower(T.col("app_name")) == "termite", _GATES).select("doc_id", "decision", "stored_text")


# store


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def set_null_on_delete(spark, d):
    gone = table(spark, d, "customer").filter("c_custkey % 7 = 0")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ghosts = o.filter("o_custkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")).unionByName(gone.select("c_custkey"))
    return store.null_missing(o, "o_custkey", ghosts, "c_custkey")


@query("SELECT id, record_id FROM (SELECT DISTINCT id, record_id FROM record_chunks) WHERE record_id NOT IN (SELECT id FROM memory_records WHERE source = 'screen')")
def orphan_check(spark, d):
    parents = table(spark, d, "memory_records").filter("source = 'screen'").select("id").distinct()
    return store.orphans(table(spark, d, "record_chunks").select("id", "record_id").distinct(), "record_id", parents, "id").select("id", "record_id")


@query(
    """WITH a AS (SELECT id AS path, min(md5(coalesce(text, ''))) AS h FROM record_chunks GROUP BY id), b AS (SELECT chunk_id AS path, min(md5(upper(coalesce(text, '')))) AS h FROM pending_chunks GROUP BY chunk_id)
    SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h"""
)
def incremental_reindex(spark, d):
    a = table(spark, d, "record_chunks").groupBy(F.col("id").alias("path")).agg(F.min(F.md5(T.col("text").cast("binary"))).alias("hash"))
    b = table(spark, d, "pending_chunks").groupBy(F.col("chunk_id").alias("path")).agg(F.min(F.md5(F.upper(T.col("text")).cast("binary"))).alias("hash"))
    return store.changed_files(a, b)


# activity


def _events(spark, d):
    return table(spark, d, "events")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


for _unit in ("hour", "day"):

    def _timeline(spark, d, unit=_unit):
        t = activity.timeline(_events(spark, d), "ts", unit, "event_type")
        return t.select(_stamp("bucket").alias("bucket"), "event_type", "n", _stamp("first").alias("first"), _stamp("last").alias("last"))

    CORE[f"timeline_{_unit}"] = _timeline
    _f = "'%Y-%m-%d %H:%M:%S'"
    CORE_SQL[f"timeline_{_unit}"] = f"SELECT strftime(date_trunc('{_unit}', ts), {_f}) AS bucket, event_type, count(*) AS n, strftime(min(ts), {_f}) AS first, strftime(max(ts), {_f}) AS last FROM events GROUP BY date_trunc('{_unit}', ts), event_type"


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ROLLUP (strftime(date_trunc('day', ts), '%Y-%m-%d'), event_type)")
def timeline_rollup(spark, d):
    return _events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def delta_since(spark, d):
    return activity.delta_since(_events(spark, d), "ts", __import__("datetime").datetime(2024, 1, 25)).select("event_id", "user_id")


@query(
    """WITH l AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events), c AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS t FROM l WHERE ts >= m - INTERVAL 3 DAY GROUP BY ALL)
    SELECT user_id, arg_max(event_type, (t, event_type)) AS latest, arg_max(event_type, (n, t, event_type)) AS focus, sum(n)::BIGINT AS events FROM c GROUP BY user_id"""
)
def active_focus(spark, d):
    return activity.active_focus(_events(spark, d), "user_id", "ts", "event_type", 3 * 86400)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 7200 THEN 0 ELSE 1 END AS n FROM events),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, k::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL"""
)
def sessionize_events(spark, d):
    return activity.gap_sessions(_events(spark, d), "user_id", "ts", 7200).groupBy("user_id", big(F.col("session")).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def consecutive_dedup(spark, d):
    return activity.without_consecutive(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type AS a, lag(event_type, 1) OVER w AS b, lag(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c = a AND b <> a")
def aba_loop(spark, d):
    return activity.back_and_forth(_events(spark, d), "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("SELECT event_type, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, count(*) AS n, greatest(count(*) - 2, 0) AS denied FROM events GROUP BY event_type, date_trunc('second', ts)")
def rate_window(spark, d):
    r = activity.rate_window(_events(spark, d), "event_type", "ts", 2)
    return r.groupBy("event_type", _stamp("second").alias("second")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("admitted")).alias("denied"))


@query("SELECT coalesce(CASE WHEN event_id % 5 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'idle' END, 'stored') AS reason, count(*) AS ticks FROM events GROUP BY 1")
def skip_reasons(spark, d):
    e = _events(spark, d).withColumn("why", F.when(F.col("event_id") % 5 == 0, "blocked").when(F.col("event_id") % 7 == 0, "idle"))
    return activity.skip_counters(e, "why")


@query(
    """WITH c AS (SELECT user_id, ts, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) <> event_type THEN 1 ELSE 0 END AS c FROM events)
    SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, sum(c)::BIGINT AS changes, count(*) AS events FROM c GROUP BY ALL"""
)
def focus_drift(spark, d):
    return activity.drift(_events(spark, d), "user_id", "ts", "event_type", "day").select("user_id", F.date_format("bucket", "yyyy-MM-dd").alias("day"), "changes", "events")


@query("SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY value DESC, event_id) AS nth FROM events) WHERE nth <= 3")
def resurfacing_cap(spark, d):
    e = activity.capped_per_day(_events(spark, d).withColumn("_v", -F.col("value")), "ts", ["_v", "event_id"], 3, "user_id")
    return e.select("event_id", big(F.col("nth")).alias("nth"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, count(*) AS served FROM events GROUP BY 1, 2")
def usage_counters(spark, d):
    return activity.usage(_events(spark, d), "ts", "event_type").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tool", "served")


@query(
    """WITH s AS (SELECT id AS segment_id, min(captured_at_ms) AS a, min(captured_at_ms) + 900000 AS z FROM memory_records WHERE source = 'meeting' AND captured_at_ms > 0 GROUP BY id),
    r AS (SELECT DISTINCT id, captured_at_ms FROM memory_records WHERE source = 'screen' AND captured_at_ms > 0) SELECT segment_id, r.id AS record_id FROM s JOIN r ON r.captured_at_ms >= a AND r.captured_at_ms < z"""
)
def meeting_overlap(spark, d):
    m = table(spark, d, "memory_records").filter("captured_at_ms > 0")
    s = m.filter("source = 'meeting'").groupBy(F.col("id").alias("segment_id")).agg(F.min("captured_at_ms").alias("started_at_ms")).withColumn("ended_at_ms", F.col("started_at_ms") + 900_000)
    r = m.filter("source = 'screen'").select(F.col("id").alias("record_id"), "captured_at_ms").distinct()
    return activity.meeting_overlap(s, r)


@query(
    """WITH a AS (SELECT event_type AS gate, count(*) AS b FROM events WHERE value > 50 GROUP BY 1), c AS (SELECT event_type AS gate, count(*) AS a FROM events WHERE value > 80 GROUP BY 1)
    SELECT gate, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS delta FROM a FULL JOIN c USING (gate)"""
)
def gate_replay(spark, d):
    e = _events(spark, d).withColumnRenamed("event_type", "gate")
    return activity.gate_deltas(e.filter("value > 50"), e.filter("value > 80"), "gate")


# retrieval composition


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
    f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r) AS n FROM r)
    SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN r <= 3 THEN 0 ELSE n END, r) AS place FROM f"""
)
def diversity(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(X.MAX_HITS)
    x = retrieval.diversify(hits, "n_chars", "doc_id", "source")
    return x.select("doc_id", big(F.col("place")).alias("place"))


@query(
    f"""WITH {S.WORDS}, m AS (SELECT doc_id, count(*) AS matched FROM tf WHERE term IN ('orchard', 'lantern', 'compass', 'harbor') GROUP BY doc_id)
    SELECT doc_id, round(matched / 4.0, 6) AS coverage, matched / 4.0 >= 0.5 AS passed FROM m"""
)
def relevance_gate(spark, d):
    want = ["orchard", "lantern", "compass", "harbor"]
    m = _index(spark, d).postings.filter(F.col("term").isin(want)).groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("matched"))
    return retrieval.relevance_gate(m.withColumn("wanted", F.lit(len(want))), "matched", "wanted", 0.5).select("doc_id", F.round("coverage", 6).alias("coverage"), "passed")


@query(
    """SELECT source AS claim_id, count(DISTINCT app_name) AS backers, CASE WHEN count(DISTINCT app_name) >= 2 THEN 'Grounded' WHEN count(DISTINCT app_name) > 0 THEN 'PartialAnswer' ELSE 'NotEnoughEvidence' END AS verdict FROM documents GROUP BY source"""
)
def verdict(spark, d):
    return retrieval.verdicts(table(spark, d, "documents").withColumnRenamed("source", "claim_id"), record="app_name")


@query(
    """WITH u AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
    SELECT source, doc_id, used::BIGINT AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS citation FROM u WHERE used <= 4000"""
)
def pack_budget(spark, d):
    p = retrieval.context_pack(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "doc_id", "n_chars", 4000, "source")
    return p.select("source", "doc_id", "used", big(F.col("citation")).alias("citation"))


@query("SELECT record_id, arg_max(id, (strlen(coalesce(text, '')), id)) AS best_chunk, max(strlen(coalesce(text, ''))) AS score, count(*) AS chunks FROM (SELECT DISTINCT id, record_id, text FROM record_chunks) GROUP BY record_id")
def chunk_rollup(spark, d):
    c = table(spark, d, "record_chunks").select("id", "record_id", "text").distinct().withColumn("score", big(T.bytes_of(T.col("text"))))
    return retrieval.roll_up(c)


@query("SELECT doc_id, round(CASE WHEN lang = 'en' THEN 1.0 ELSE pow(0.5, greatest(1700000000000 - captured_at_ms, 0) / 2592000000.0) END, 6) AS weight FROM documents WHERE captured_at_ms IS NOT NULL AND lang IS NOT NULL")
def staleness(spark, d):
    t = table(spark, d, "documents").filter("captured_at_ms is not null and lang is not null")
    return t.select("doc_id", F.round(retrieval.staleness(F.col("captured_at_ms"), 1_700_000_000_000, F.col("lang") == "en"), 6).alias("weight"))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, i, x, strlen(x) AS n FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+$') AS a FROM documents)) WHERE x <> ''),
    c AS (SELECT doc_id, i, x, n AS size, 0 AS ord, 0 AS start, n AS upto FROM l WHERE i = 1
    UNION ALL SELECT l.doc_id, l.i, l.x, CASE WHEN size + n <= 1500 THEN size + n ELSE n END, CASE WHEN size + n <= 1500 THEN ord ELSE ord + 1 END, CASE WHEN size + n <= 1500 THEN start ELSE upto END, upto + n FROM c JOIN l ON l.doc_id = c.doc_id AND l.i = c.i + 1)
    SELECT doc_id AS record_id, ord::BIGINT AS ord, any_value(start)::BIGINT AS span_start, max(upto)::BIGINT AS span_end, string_agg(x, '' ORDER BY i) AS text FROM c GROUP BY doc_id, ord"""
)
def chunk_lines(spark, d):
    return retrieval.chunk_lines(table(spark, d, "documents"), "doc_id", "text")


# questions of agents


@query()
def session_story(spark, d):
    s = tools.session_story(once_per_id(table(spark, d, "memory_records"), "id", "session_id", "captured_at_ms", "window_title"))
    return s.select("session_id", big(F.col("session")).alias("session"), big(F.size("story")).alias("events"), F.to_json("story").alias("story"))


@query("SELECT app_name, count(*) AS n FROM (SELECT DISTINCT id, app_name, captured_at_ms FROM memory_records) GROUP BY app_name")
def timeline_app(spark, d):
    return tools.timeline(table(spark, d, "memory_records").select("id", "app_name", "captured_at_ms").distinct(), "app").select("app_name", "n")


@query("SELECT id, session_id FROM memory_records WHERE created_at_ms > 1577900000000")
def delta_records(spark, d):
    return tools.delta(table(spark, d, "memory_records"), 1_577_900_000_000).select("id", "session_id")


@query()
def record_insight(spark, d):
    t, app, text = _docs(spark, d)
    i = t.select("doc_id", tools.insight(app, F.lit(""), text).alias("i"))
    return i.select("doc_id", "i.cleaned_text", "i.summary", F.round("i.noise", 6).alias("noise"), "i.embedding_text")


_TITLE_BODY = f"(CASE WHEN strlen({S.inline('t')}) >= 7 AND NOT {S.drop('a', S.inline('t'))} THEN {S.inline('t')} ELSE '' END)"


@query(
    f"""WITH c AS (SELECT id, coalesce(min(window_title), '') AS t, coalesce(min(app_name), '') AS a FROM memory_records GROUP BY id), x AS (SELECT DISTINCT t, a FROM c),
    y AS (SELECT t, a, CASE WHEN {S.trim('t')} = '' THEN 'empty' WHEN regexp_matches({S.trim('t')}, '^(?:https?://)?[0-9A-Za-z_.\\-]+\\.[a-z]{{2,}}(?:/\\S*)?$') THEN 'url_only'
    WHEN {S.generic_title('a', S.inline('t'))} AND strlen({_TITLE_BODY}) < 80 THEN 'navigation' END AS reason FROM x)
    SELECT id, reason, reason IS NULL AS admitted FROM c JOIN y USING (t, a)"""
)
def capture_admission(spark, d):
    r = table(spark, d, "memory_records").groupBy("id").agg(F.min("window_title").alias("window_title"), F.min("app_name").alias("app_name"))
    return activity.capture_admission(r, "window_title", "window_title", "app_name").select("id", "reason", "admitted")


@query(
    """SELECT session_id, count(*) AS records, min(captured_at_ms) AS first_ms, max(captured_at_ms) AS last_ms FROM (SELECT DISTINCT id, session_id, captured_at_ms FROM memory_records)
    WHERE captured_at_ms >= 1577919600000 AND captured_at_ms < 1578006000000 GROUP BY session_id"""
)
def daily_consolidation(spark, d):
    r = table(spark, d, "memory_records").select("id", "session_id", "captured_at_ms").distinct()
    return activity.consolidation(r, "captured_at_ms", "Europe/Berlin", "2020-01-02", "session_id")


# graph


def _edges(spark, d):
    """customer c -> order o -> part p as one graph of strings."""
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    line = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return o.unionByName(line)


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""


@query(f"WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS a FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS b FROM e GROUP BY 1) SELECT node, coalesce(a, 0) AS out_degree, coalesce(b, 0) AS in_degree, coalesce(a, 0) + coalesce(b, 0) AS degree FROM o FULL JOIN i USING (node)")
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2) SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node")
def graph_neighbourhood(spark, d):
    return graph.neighbourhood(_edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 2).select("node", big(F.col("depth")).alias("depth"))


@query(f"WITH {_EDGES} SELECT node FROM (SELECT 'p' || p_partkey AS node FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier) WHERE node NOT IN (SELECT dst FROM e)")
def graph_isolated(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return graph.isolated(nodes, _edges(spark, d))


@query()
def graph_path(spark, d):
    return graph.shortest_path(graph.both_ways(_edges(spark, d)), "c7", "c8", 6)


def _small(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 3 % 64).alias("dst"))


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * 3 % 64 AS b FROM supplier), t AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
    r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a"""
)
def graph_components(spark, d):
    return graph.components(_small(spark, d))


@query("SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS component FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey FROM orders")
def graph_components_orders(spark, d):
    return graph.components(table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))


@query()
def graph_communities(spark, d):
    return graph.communities(_small(spark, d))


@query()
def graph_modularity(spark, d):
    e = _small(spark, d).filter("src <> dst")
    return graph.modularity(e, graph.communities(e))


@query("WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, s_suppkey * 3 % 64 AS dst FROM supplier), r AS (SELECT src AS a, dst AS b, 1 AS n FROM e UNION SELECT a, dst, n + 1 FROM r JOIN e ON src = b WHERE n < 5 AND a <> b) SELECT a AS node, min(n)::BIGINT AS length FROM r WHERE a = b GROUP BY 1")
def graph_cycles(spark, d):
    return graph.cycles(_small(spark, d), 5).select("node", big(F.col("length")).alias("length"))


def queries() -> dict:
    return dict(CORE)


def oracle_sql() -> dict[str, str]:
    return dict(CORE_SQL)


