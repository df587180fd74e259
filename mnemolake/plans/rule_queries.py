"""Named queries of rules, requests, retrieval pieces, graphs and code graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import schemas
from mnemolake.functions import fixed as X
from mnemolake.functions import text as T
from mnemolake.operators import activity, codegraph, evaluate, graph, retrieval, search, vectors
from mnemolake.plans import sql as S
from mnemolake.plans.catalog import _DIST, _EDGES, _edges, _events, _index, big, query
from mnemolake.session import table

# rules over single texts


@query(f"SELECT doc_id, {S.inline(f'replace({S.lit(X.LOW_CONF)} || coalesce(text, {S.lit(str())}), {S.lit(X.LOW_CONF)}, {S.lit(chr(32))})')} AS plain FROM documents")
def strip_low_conf_marker(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_low_conf(F.concat(F.lit(X.LOW_CONF), T.col("text"))).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 40 THEN coalesce(text, '') ELSE substring(text, 1, 37) || '...' END AS snippet FROM documents")
def truncate_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_snippet(T.col("text"), 40).alias("snippet"))


@query(f"SELECT doc_id, lower({S.inline(f'coalesce(text, {S.lit(str())})')}) AS key FROM documents")
def snippet_dedup_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedup_key(T.col("text")).alias("key"))


@query(f"WITH r AS (SELECT DISTINCT coalesce(app_name, '') AS a, coalesce(window_title, '') AS t FROM memory_records UNION SELECT DISTINCT coalesce(app_name, ''), coalesce(app_name, '') FROM memory_records) SELECT a, t, {S.generic_title('a', 't')} AS generic FROM r")
def title_is_generic(spark, d):
    r = table(spark, d, "memory_records").select(T.col("app_name").alias("a"), T.col("window_title").alias("t")).distinct()
    r = r.unionByName(r.select("a", F.col("a").alias("t"))).distinct()
    return r.select("a", "t", T.generic_title(F.col("a"), F.col("t")).alias("generic"))


@query(f"SELECT DISTINCT coalesce(app_name, '') AS app, {S.app_is(S.lit(str()) + ' || coalesce(app_name, ' + S.lit(str()) + ')', X.BROWSER_APPS)} AS browser, {S.app_is('coalesce(app_name, ' + S.lit(str()) + ')', X.CODE_APPS)} AS code, {S.app_is('coalesce(app_name, ' + S.lit(str()) + ')', X.MAIL_APPS)} AS mail FROM memory_records")
def app_kinds(spark, d):
    a = table(spark, d, "memory_records").select(T.col("app_name").alias("app")).distinct()
    return a.select("app", T.is_browser(F.col("app")).alias("browser"), T.is_code(F.col("app")).alias("code"), T.is_mail(F.col("app")).alias("mail"))


_STATES = ", ".join(f"({k}, '{v}')" for k, v in X.LIFECYCLE.items())


@query(f"SELECT doc_id, name AS state FROM documents JOIN (VALUES {_STATES}) AS v(k, name) ON k = doc_id % {len(X.LIFECYCLE)}")
def lifecycle_names(spark, d):
    return table(spark, d, "documents").select("doc_id", schemas.lifecycle_name(F.col("doc_id") % len(X.LIFECYCLE)).alias("state"))


@query(r"SELECT doc_id, unnest(range(0, len(l))) AS nth, unnest(l) AS title FROM (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)^\s*(?:[-*]\s*)?(?:\[ \]\s*|todo[:\s]\s*)(.+?)\s*$')), lambda x: regexp_extract(x, '(?i)^\s*(?:[-*]\s*)?(?:\[ \]\s*|todo[:\s]\s*)(.+?)\s*$', 1)) AS l FROM documents) WHERE len(l) > 0")
def task_extraction(spark, d):
    t = graph.task_candidates(table(spark, d, "documents"), "doc_id", "text")
    t = t.groupBy(F.col("record_id").alias("doc_id")).agg(F.collect_list("title").alias("l"))
    return t.select("doc_id", F.posexplode("l").alias("nth", "title")).select("doc_id", big(F.col("nth")).alias("nth"), "title")


@query(r"SELECT DISTINCT doc_id AS record_id, kind, unnest(l) AS name FROM (SELECT doc_id, 'name' AS kind, regexp_extract_all(text, '[A-Z][a-z]{7,}') AS l FROM documents UNION ALL SELECT doc_id, 'number', regexp_extract_all(text, '[0-9]{3,}') FROM documents)")
def entity_extraction(spark, d):
    patterns = {"name": (r"[A-Z][a-z]{7,}", 0.9), "number": (r"[0-9]{3,}", 0.8), "weak": (r"\w+", 0.1)}
    return graph.extract_entities(table(spark, d, "documents"), "doc_id", "text", patterns).select("record_id", "kind", "name")


@query("SELECT m.id, n_nationkey AS node_id FROM (SELECT DISTINCT id, app_name FROM memory_records) m LEFT JOIN (SELECT lower(trim(app_name)) AS a, min(n_nationkey) AS n_nationkey FROM (SELECT app_name, row_number() OVER (ORDER BY app_name) AS n_nationkey FROM (SELECT DISTINCT app_name FROM memory_records WHERE app_name <> '')) WHERE n_nationkey % 2 = 0 GROUP BY 1) a ON lower(trim(m.app_name)) = a.a")
def alias_resolution(spark, d):
    from pyspark.sql import Window

    m = table(spark, d, "memory_records").select("id", "app_name").distinct()
    names = m.filter("app_name <> ''").select(F.col("app_name").alias("alias")).distinct().withColumn("node_id", F.row_number().over(Window.orderBy("alias")).cast("bigint"))  # one row per app
    return graph.resolve_aliases(m, "app_name", names.filter("node_id % 2 = 0")).select("id", "node_id")


# requests, queues and reviews


@query(
    """WITH r AS (SELECT event_id, event_id % 7 <> 0 AS r, event_id % 5 <> 0 AS h, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS o, event_id % 2 = 0 AS t FROM events)
    SELECT event_id, CASE WHEN NOT r THEN 'rate' WHEN NOT h THEN 'host' WHEN NOT coalesce(o, false) THEN 'origin' WHEN NOT t THEN 'token' ELSE 'ok' END AS reason,
    CASE WHEN NOT r THEN 429 WHEN NOT h OR NOT coalesce(o, false) THEN 403 WHEN NOT t THEN 401 ELSE 200 END AS status FROM r"""
)
def request_admission(spark, d):
    i = F.col("event_id")
    e = _events(spark, d).select(i, (i % 7 != 0).alias("r"), (i % 5 != 0).alias("h"), F.when(i % 11 != 0, i % 3 != 0).alias("o"), (i % 2 == 0).alias("t"))
    return activity.admission(e, "r", "h", "o", "t").select("event_id", "reason", big(F.col("status")).alias("status"))


@query("SELECT event_id FROM events WHERE event_id % 1000 <= 500 AND event_id % 9 < 5")
def due_reviews(spark, d):
    q = _events(spark, d).select("event_id", (F.col("event_id") % 1000).alias("next_attempt_at_ms"), (F.col("event_id") % 9).alias("attempts"))
    return activity.due_reviews(q, 500).select("event_id")


@query("SELECT event_id, event_id % 6 + 1 AS attempts, 1000000 + 60000 * pow(2, event_id % 6)::BIGINT AS next_attempt_at_ms, event_id % 6 + 1 >= 5 AS failed FROM events WHERE event_id % 3 <> 0")
def review_after_attempt(spark, d):
    q = _events(spark, d).select("event_id", (F.col("event_id") % 6).alias("attempts"))
    return activity.after_attempt(q, F.col("event_id") % 3 == 0, 1_000_000).select("event_id", "attempts", "next_attempt_at_ms", "failed")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS priority FROM events")
def job_priority(spark, d):
    e = _events(spark, d).select("event_id", F.col("event_type").alias("class"), F.col("ts").alias("enqueued_at_ms"))
    return activity.by_priority(e, ["click", "view"]).select("event_id", big(F.col("priority")).alias("priority"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS stage, user_id AS reason FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00' AND user_id IS NOT NULL")
def capture_explain(spark, d):
    e = activity.capture_explain(_events(spark, d), "ts", "event_type", "user_id", F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-11 00:00:00").cast("timestamp"))
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("stage"), F.col("user_id").alias("reason"))


@query(
    """WITH g AS (SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
    SELECT event_id, gap IS NULL OR gap <= 600 OR gap >= 86400 AS captured FROM g"""
)
def adaptive_sampling(spark, d):
    return activity.sampling(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 600, 86_400).select("event_id", "captured")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, (event_id * 2654435761) % 65536 AS p FROM events), l AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM e)
    SELECT event_id, bit_count(xor(p, q))::BIGINT AS distance, coalesce(bit_count(xor(p, q)) <= 6, false) AS repeat FROM l"""
)
def near_repeats(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "ts", (F.col("event_id") * 2654435761 % 65536).alias("p"))
    return activity.near_repeats(e, "user_id", ["ts", "event_id"], "p", 6).select("event_id", big(F.col("distance")).alias("distance"), "repeat")


@query(
    """WITH r AS (SELECT DISTINCT id, session_id, captured_at_ms, coalesce(window_title, '') AS a FROM memory_records WHERE captured_at_ms > 0 AND session_id <> ''),
    l AS (SELECT *, lag(captured_at_ms) OVER w AS t, lag(a) OVER w AS b FROM r WINDOW w AS (PARTITION BY session_id ORDER BY captured_at_ms, a))
    SELECT id, coalesce((captured_at_ms - t <= 1800000)::INT * 0.5 + (a = b)::INT, 0.0) AS score, coalesce((captured_at_ms - t <= 1800000)::INT * 0.5 + (a = b)::INT, 0.0) >= 1.0 AS merge FROM l"""
)
def continuity(spark, d):
    r = table(spark, d, "memory_records").filter("captured_at_ms > 0 and session_id <> ''").select("id", "session_id", "captured_at_ms", T.col("window_title").alias("a")).distinct()
    return activity.continuity(r, "session_id", "captured_at_ms", "a", 1_800_000).select("id", "score", "merge")


@query("SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events WHERE ts::DATE = DATE '2024-01-10' GROUP BY user_id")
def daily_digest(spark, d):
    x = activity.daily_digest(_events(spark, d), "ts", "2024-01-10", "user_id")
    return x.select("user_id", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("WITH s AS (SELECT user_id, event_type, ts::DATE AS day FROM events) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS events FROM s GROUP BY ALL")
def story_lengths(spark, d):
    e = _events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return activity.story(e, "user_id", "day", "ts", "event_type").select("user_id", "day", big(F.size("story")).alias("events"))


# retrieval pieces


@query("SELECT event_id FROM events WHERE epoch_ms(ts) >= 1704844800000 - 172800000 AND epoch_ms(ts) <= 1704844800000")
def time_window(spark, d):
    return _events(spark, d).filter(retrieval.in_window(F.unix_millis(F.col("ts").cast("timestamp")), retrieval.time_window("2d", 1_704_844_800_000))).select("event_id")


@query("SELECT event_id, round(value + (event_type = 'click')::INT * 5 - 0.5, 6) AS score, round(value, 6) AS fused, (event_type = 'click')::INT * 5.0 AS focus FROM events WHERE value IS NOT NULL")
def score_adjustments(spark, d):
    e = _events(spark, d).filter("value is not null")
    a = retrieval.adjusted(e, "value", {"focus": F.when(F.col("event_type") == "click", 5.0).otherwise(0.0), "age": F.lit(-0.5)})
    return a.select("event_id", F.round("score", 6).alias("score"), F.round("signals.fused", 6).alias("fused"), F.col("signals.focus").alias("focus"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND app_name IS NOT NULL THEN 1.0::DOUBLE WHEN lang = 'en' THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS weight FROM documents")
def source_alignment(spark, d):
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    return table(spark, d, "documents").select("doc_id", retrieval.alignment(en & F.col("app_name").isNotNull(), en).alias("weight"))


@query("SELECT doc_id, CASE WHEN n_chars > 500 AND lang = 'en' THEN 'long, english' WHEN n_chars > 500 THEN 'long' WHEN lang = 'en' THEN 'english' ELSE '' END AS reason FROM documents")
def surfacing_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.surfacing_reason(long=F.col("n_chars") > 500, english=F.col("lang") == "en").alias("reason"))


@query("SELECT doc_id, CASE WHEN n_chars <= 100 THEN 'length' WHEN coalesce(lang, '') <> 'en' THEN 'language' END AS dropped_by FROM documents")
def explain_retrieval(spark, d):
    return retrieval.explain(table(spark, d, "documents"), length=F.col("n_chars") > 100, language=F.coalesce("lang", F.lit("")) == "en").select("doc_id", "dropped_by")


@query("WITH t AS (SELECT doc_id, n_chars, length(coalesce(text, '')) % 97 AS m FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT doc_id, row_number() OVER (ORDER BY m DESC, n_chars DESC, doc_id) AS place FROM t")
def model_rerank(spark, d):
    from pyspark.sql import Window

    r = retrieval.rerank(table(spark, d, "documents"), "n_chars", lambda s: s.fillna("").str.len() % 97, key="doc_id")
    return r.select("doc_id", big(F.row_number().over(Window.orderBy(F.desc("model_score"), F.desc("n_chars"), "doc_id"))).alias("place"))  # 50 rows


@query("SELECT 'todos' AS kind, o_orderkey::VARCHAR AS record_id, 'order ' || o_orderkey AS text FROM orders WHERE o_orderkey % 3 = 0")
def recall_todos(spark, d):
    o = table(spark, d, "orders")
    ledger = o.select(F.lit(1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("decided_at_ms"), F.lit("x").alias("statement"), F.col("o_orderkey").cast("string").alias("record_id"))
    tasks = o.select(F.concat(F.lit("order "), "o_orderkey").alias("title"), (F.col("o_orderkey") % 3).alias("status"), F.col("o_orderkey").cast("string").alias("source_record_id"), F.lit(0).cast("bigint").alias("due_at_ms"))
    return retrieval.recall_kind(ledger, tasks, "todos").select("kind", "record_id", "text")


@query("SELECT doc_id, concat_ws(chr(10), nullif(app_name, ''), nullif(source, ''), left(text, 60)) AS doc FROM documents WHERE text IS NOT NULL")
def embedding_document(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", retrieval.embedding_document(F.col("app_name"), F.col("source"), F.left("text", F.lit(60))).alias("doc"))


# whole lines up to a size: a chunk begins where the next line would go beyond it
@query(
    """WITH RECURSIVE l AS (SELECT doc_id, i, strlen(x) AS n FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+$') AS a FROM documents)) WHERE x <> ''),
    c AS (SELECT doc_id, i, n AS size, 0 AS ord, 0 AS start, n AS upto FROM l WHERE i = 1
    UNION ALL SELECT l.doc_id, l.i, CASE WHEN size + n <= 300 THEN size + n ELSE n END, CASE WHEN size + n <= 300 THEN ord ELSE ord + 1 END, CASE WHEN size + n <= 300 THEN start ELSE upto END, upto + n FROM c JOIN l ON l.doc_id = c.doc_id AND l.i = c.i + 1)
    SELECT doc_id AS record_id, ord::BIGINT AS ord, any_value(start)::BIGINT AS span_start, max(upto)::BIGINT AS span_end FROM c GROUP BY doc_id, ord"""
)
def chunk_spans(spark, d):
    return retrieval.chunk_lines(table(spark, d, "documents"), "doc_id", "text", 300).select("record_id", "ord", "span_start", "span_end")


# evaluation


@query("SELECT round(avg((app_name = source)::INT), 6) AS accuracy, count(*) AS n FROM documents WHERE app_name IS NOT NULL")
def verdict_accuracy(spark, d):
    x = evaluate.verdict_accuracy(table(spark, d, "documents").filter("app_name is not null"), "app_name", "source")
    return x.select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(
    """WITH c AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY ALL), i AS (SELECT l_orderkey, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1)
    SELECT round(sum(same)::DOUBLE / sum(n * (n - 1)), 6) AS agreement, count(*) AS items FROM i WHERE n > 1"""
)
def rater_agreement(spark, d):
    a = evaluate.agreement(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag")
    return a.select(F.round("agreement", 6).alias("agreement"), "items")


@query("SELECT o_custkey AS qid, min(o_totalprice) AS a, max(o_totalprice) AS b, round(max(o_totalprice) - min(o_totalprice), 4) AS delta FROM orders GROUP BY 1")
def ablation_delta(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("qid"))
    a, b = o.agg(F.min("o_totalprice").alias("recall")), o.agg(F.max("o_totalprice").alias("recall"))
    return evaluate.ablation(a, b).select("qid", "a", "b", F.round("delta", 4).alias("delta"))


@query("SELECT event_type AS query, user_id AS record_id, count(*) AS votes, count(*) FILTER (value > 50) AS useful FROM events WHERE value IS NOT NULL GROUP BY ALL")
def feedback_labels(spark, d):
    f = _events(spark, d).filter("value is not null").select(F.col("event_type").alias("query"), F.col("user_id").alias("record_id"), (F.col("value") > 50).alias("useful"))
    return evaluate.feedback_labels(f)


# search over the stored index


def _near_sql(reach: int) -> str:
    return f"""WITH {S.WORDS} SELECT DISTINCT a.doc_id FROM flat a JOIN flat b ON a.doc_id = b.doc_id AND b.at <= a.at + 1 + {reach} AND a.at <= b.at + 1 + {reach} WHERE a.term = 'the' AND b.term = 'harbor'"""


@query(_near_sql(3))
def near_search(spark, d):
    return search.ranked(_index(spark, d), "NEAR(the harbor, 3)").select(F.col("doc").alias("doc_id"))


@query(f"WITH {S.WORDS} SELECT DISTINCT doc_id FROM flat WHERE term = 'orchard'")
def column_search(spark, d):
    return search.ranked(_index(spark, d), "text : orchard").select(F.col("doc").alias("doc_id"))


@query(f"WITH {S.WORDS}, o AS (SELECT min(term) AS term FROM (SELECT term FROM tf GROUP BY term HAVING count(*) = 1 AND length(term) >= 6)) SELECT doc_id, term FROM tf JOIN o USING (term)")
def unique_token(spark, d):
    i = _index(spark, d)
    rare = i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") == 1) & (F.length("term") >= 6)).agg(F.min("term")).first()[0]
    return search.ranked(i, rare).select(F.col("doc").alias("doc_id"), F.lit(rare).alias("term"))


# the stems of the query and all words that have them (accents folded): lantern(s), record(s, ed, ing, er, ers)
_STEMMED = r"""tok AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
flat AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^lanterns?$') THEN 'lantern' WHEN regexp_matches(w, '^record(s|ed|ing|ings|er|ers)?$') THEN 'record' ELSE w END AS term FROM (SELECT doc_id, unnest(w) AS w FROM tok)),
lens AS (SELECT doc_id, len(w) AS n FROM tok), st AS (SELECT count(*) AS docs, sum(n)::DOUBLE / count(*) AS avg_len FROM lens),
tf AS (SELECT term, doc_id, count(*) AS tf FROM flat GROUP BY 1, 2),
idf AS (SELECT term, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, st GROUP BY term, docs)"""


@query(f"WITH {_STEMMED} SELECT doc_id, round(-sum({S.GAIN}), 6) AS rank FROM tf JOIN idf USING (term) JOIN lens USING (doc_id), st WHERE term IN ('lantern', 'record') GROUP BY doc_id ORDER BY -sum({S.GAIN}), doc_id LIMIT 50")
def stemmed_bm25(spark, d):
    r = search.ranked(_index(spark, d, stemmed=True), "Lanterns OR recording")
    return r.orderBy("rank", "doc").limit(X.MAX_HITS).select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))


# vectors


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) p ORDER BY {_DIST}, e.vec_id LIMIT 10")
def knn_all_cells(spark, d):
    """With all cells asked the cells lose nothing."""
    e = table(spark, d, "embeddings")
    indexed, centres = vectors.ivf_cells(e, "vec_id", "embedding", 16)
    probe = e.filter("vec_id = 7").select("embedding").first()[0]
    return vectors.ann(indexed, centres, "vec_id", "embedding", probe, 10, 16).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) p ORDER BY {_DIST}, e.vec_id LIMIT 10")
def knn_quantised(spark, d):
    """Nearest by codes of 16 parts, 400 of them compared exactly: nothing is lost among these vectors."""
    e = table(spark, d, "embeddings")
    q = vectors.ProductQuantiser.fit(e, "vec_id", "embedding", 16, 64)
    coded = e.withColumn("codes", q.encode(F.col("embedding")))
    probe = e.filter("vec_id = 7").select("embedding").first()[0]
    return vectors.ann_pq(coded, q, "vec_id", "embedding", "codes", probe, 10, 40).select("vec_id", F.round("distance", 6).alias("distance"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS id, round(max({_COS}), 6) AS cosine, min(b.vec_id) AS first_id FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND a.vec_id - b.vec_id <= 50 WHERE {_COS} >= 0.2 GROUP BY 1")
def semantic_repeats(spark, d):
    e = table(spark, d, "embeddings").withColumn("t", F.col("vec_id"))
    return vectors.semantic_repeats(e, "vec_id", "t", "embedding", 50, 0.2).select("id", F.round("cosine", 6).alias("cosine"), "first_id")


# graphs


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'c7' AS node, 0 AS depth, '' AS path UNION SELECT dst, depth + 1, path || '/' || left(dst, 1) FROM r JOIN e ON src = node WHERE depth < 2), f AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT node, f.depth::BIGINT AS depth, min(path) AS path FROM r JOIN f USING (node, depth) GROUP BY 1, 2")
def labelled_paths(spark, d):
    e = _edges(spark, d).withColumn("kind", F.left("dst", F.lit(1)))
    return graph.labelled_paths(e, spark.createDataFrame([("c7",)], "node string"), 2).select("node", big(F.col("depth")).alias("depth"), "path")


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN b ON src = node WHERE depth < 4) SELECT min(depth)::BIGINT AS edges FROM r WHERE node = (SELECT min(src) FROM e WHERE dst = (SELECT min(dst) FROM e WHERE src LIKE 'o%' AND src IN (SELECT dst FROM e WHERE src = 'c7')) AND src LIKE 'o%')")
def path_length(spark, d):
    """From a customer to an order that shares a part with one of theirs."""
    e = _edges(spark, d)
    own = e.filter("src = 'c7'").select(F.col("dst").alias("src"))
    part = e.join(own, "src", "left_semi").agg(F.min("dst")).first()[0]
    goal = e.filter(F.col("dst") == part).agg(F.min("src")).first()[0]
    p = graph.shortest_path(graph.both_ways(e), "c7", goal, 4)
    return p.agg(F.max("step").cast("bigint").alias("edges"))


@query(
    """WITH e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b, o_custkey % 5 AS la, o_orderkey % 5 AS lb FROM orders), g AS (SELECT la AS l FROM e UNION ALL SELECT lb FROM e), k AS (SELECT l, count(*) AS d FROM g GROUP BY 1)
    SELECT round((SELECT count(*) FILTER (la = lb)::DOUBLE / count(*) FROM e) - (SELECT sum(d * d) FROM k) / (4.0 * (SELECT count(*) FROM e) * (SELECT count(*) FROM e)), 9) AS modularity"""
)
def modularity_of_labels(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    labels = o.select(F.concat(F.lit("c"), "o_custkey").alias("node"), (F.col("o_custkey") % 5).alias("label")).distinct()
    labels = labels.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("o_orderkey") % 5).alias("label")))
    return graph.modularity(e, labels).select(F.round("modularity", 9).alias("modularity"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 500 AS src, o_orderkey % 500 AS dst FROM orders WHERE o_orderkey % 11 = 0), r AS (SELECT src AS a, dst AS b, 1 AS n FROM e UNION SELECT a, dst, n + 1 FROM r JOIN e ON src = b WHERE n < 3 AND a <> b) SELECT a AS node, min(n)::BIGINT AS length FROM r WHERE a = b GROUP BY 1")
def short_cycles(spark, d):
    e = table(spark, d, "orders").filter("o_orderkey % 11 = 0").select((F.col("o_custkey") % 500).alias("src"), (F.col("o_orderkey") % 500).alias("dst")).distinct()
    return graph.cycles(e, 3).select("node", big(F.col("length")).alias("length"))


@query("SELECT package, dependency FROM (SELECT DISTINCT l_suppkey AS package, l_partkey AS dependency FROM lineitem) WHERE dependency % 10 = 0 AND NOT (package % 2 = 0 AND dependency % 20 = 0)")
def banned_dependencies(spark, d):
    deps = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("dependency")).distinct()
    return graph.banned_dependencies(deps, deps.filter("dependency % 10 = 0").select("dependency").distinct(), deps.filter("package % 2 = 0 and dependency % 20 = 0")).select("package", "dependency")


def _code(spark, d):
    """Suppliers call parts, parts depend on brands of 40 names: a code graph by shape."""
    s = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("CALLS").alias("kind")).distinct()
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("b"), F.col("p_partkey") % 40).alias("dst"), F.lit("DEPENDS_ON").alias("kind"))
    return codegraph.checked_edges(s.unionByName(p).withColumns({"provenance": F.lit("EXTRACTED"), "confidence": F.when(F.col("dst") == "b1", 0.1).otherwise(0.9), "location": F.lit("")}))


_CODE = "x AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'CALLS' AS kind, 0.9 AS c FROM lineitem UNION ALL SELECT 'p' || p_partkey, 'b' || p_partkey % 40, 'DEPENDS_ON', CASE WHEN p_partkey % 40 = 1 THEN 0.1 ELSE 0.9 END FROM part)"


@query(f"WITH {_CODE} SELECT DISTINCT 'caller' AS role, src AS node FROM x WHERE kind = 'CALLS' AND dst = 'p7' UNION ALL SELECT DISTINCT 'callee', dst FROM x WHERE kind = 'CALLS' AND src = 's3'")
def callers_and_callees(spark, d):
    e = _code(spark, d)
    return codegraph.callers(e, "p7").select(F.lit("caller").alias("role"), "node").unionByName(codegraph.callees(e, "s3").select(F.lit("callee").alias("role"), "node"))


@query(f"WITH {_CODE}, a AS (SELECT DISTINCT src AS node FROM x WHERE dst = 'b5' AND c >= 0.4), b AS (SELECT DISTINCT src AS node FROM x WHERE dst IN (SELECT node FROM a) AND c >= 0.4) SELECT 'b5' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b")
def blast_radius(spark, d):
    return codegraph.blast_radius(_code(spark, d), spark.createDataFrame([("b5",)], "node string"), 5).select("node", big(F.col("depth")).alias("depth"))


@query(f"WITH {_CODE}, a AS (SELECT DISTINCT dst AS node FROM x WHERE src = 's3' AND c >= 0.4), b AS (SELECT DISTINCT dst AS node FROM x WHERE src IN (SELECT node FROM a) AND c >= 0.4) SELECT 's3' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b")
def dependencies(spark, d):
    return codegraph.dependencies(_code(spark, d), spark.createDataFrame([("s3",)], "node string"), 3).select("node", big(F.col("depth")).alias("depth"))


@query(
    f"""WITH {_CODE}, h AS (SELECT dst AS node FROM x WHERE src = 's3' ORDER BY c DESC, dst LIMIT 5), i AS (SELECT dst AS node FROM x WHERE src IN (SELECT node FROM h)), n AS (SELECT 's3' AS node UNION SELECT node FROM h UNION SELECT node FROM i)
    SELECT src, dst, kind FROM x WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)"""
)
def compact_subgraph(spark, d):
    return codegraph.compact_subgraph(_code(spark, d), spark.createDataFrame([("s3",)], "node string"), 2, 5).select("src", "dst", "kind")


@query("SELECT p_partkey AS id, round((lower(p_name) = 'azure almond')::INT + CASE WHEN lower(p_name) <> 'azure almond' AND contains(lower(p_name), 'azure almond') THEN 0.5 ELSE 0 END + contains(lower(p_name), 'azure')::INT * 0.1 + contains(lower(p_name), 'almond')::INT * 0.1, 6) AS score FROM part WHERE contains(lower(p_name), 'azure') OR contains(lower(p_name), 'almond') ORDER BY score DESC, p_name, p_partkey LIMIT 10")
def find_symbols(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Function").alias("kind"), F.col("p_name").alias("name"), F.lit("").alias("path"))
    return codegraph.find_symbols(codegraph.checked_nodes(n), "azure almond").select("id", F.round("score", 6).alias("score"))


@query("SELECT id, path, hash FROM (SELECT DISTINCT id, record_id AS path, md5(coalesce(text, '')) AS hash FROM record_chunks) WHERE path IN (SELECT record_id FROM record_chunks EXCEPT SELECT record_id FROM pending_chunks)")
def reindexed_rows(spark, d):
    """The index without the rows of changed paths; nothing fresh comes for removed ones."""
    from mnemolake.sources import store

    c = table(spark, d, "record_chunks").select("id", F.col("record_id").alias("path"), F.md5(T.col("text").cast("binary")).alias("hash")).distinct()
    gone = table(spark, d, "pending_chunks").select(F.col("record_id").alias("path")).distinct().withColumn("state", F.lit("removed"))
    return store.reindexed(c.filter("path is not null"), gone, c.limit(0)).select("id", "path", "hash")


# sentences and spans

_PARTS = r"string_split(regexp_replace(regexp_replace(t, '([.!?])([ \n]|$)', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1))"


@query(
    f"""WITH RECURSIVE b AS (SELECT doc_id, {S.trim("coalesce(text, '')")} AS t FROM documents), p AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS p FROM (SELECT doc_id, {_PARTS} AS a FROM b)),
    r AS (SELECT doc_id, i, p AS buf, regexp_matches(p, '[.!?\\n]$') AND length({S.trim('p')}) >= 12 AS cut FROM p WHERE i = 1
    UNION ALL SELECT p.doc_id, p.i, (CASE WHEN cut THEN '' ELSE buf END) || p.p, regexp_matches(p.p, '[.!?\\n]$') AND length({S.trim("(CASE WHEN cut THEN '' ELSE buf END) || p.p")}) >= 12 FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
    l AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS m FROM r)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth, {S.trim('buf')} AS sentence FROM l WHERE cut OR (i = m AND {S.trim('buf')} <> '')"""
)
def span_sentences(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(T.col("text"))).alias("nth", "sentence"))
    return s.select("doc_id", big(F.col("nth")).alias("nth"), "sentence")


def _share(cond: str, cap: float) -> str:
    return f"least(len(list_filter({S.words('x')}, lambda w: {cond}))::DOUBLE / greatest(len({S.words('x')}), 1), {cap}) / {cap}"


_CUES = " + ".join(f"contains(lower(x), {S.lit(c)})::INT" for c in X.CUE_WORDS)
_UPPER = _share("regexp_matches(w, '^\\p{Lu}')", 0.45)
_VERBS = _share("(" + " OR ".join(f"ends_with(lower(w), {S.lit(e)})" for e in X.ACTION_ENDS) + ")", 0.30)
_SPAN_SCORE = f"""CASE WHEN length(x) < 10 THEN 0.0 ELSE least({S.quality('app', 'x')} * 0.40 + {_UPPER} * 0.12 + {_VERBS} * 0.10 + least(length(x), 280) / 280.0::DOUBLE * 0.16
    + len(list_distinct({S.words('x')}))::DOUBLE / greatest(len({S.words('x')}), 1) * 0.12 + least(({_CUES}) * 0.05, 0.18), 1.0) END"""


@query(f"WITH {S.LINES} SELECT doc_id, pos, round({_SPAN_SCORE}, 6) AS score FROM lines")
def span_scores(spark, d):
    from mnemolake.plans.catalog import _lines

    return _lines(spark, d).select("doc_id", "pos", F.round(T.span_score(F.col("app"), F.col("x")), 6).alias("score"))


# one line, one span: what ranks first, what is kept of it, and how much the best three hold
@query(
    f"""WITH {S.LINES}, s AS (SELECT doc_id, pos, x, {_SPAN_SCORE} AS score FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM s WHERE score > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM k WHERE i <= {X.MAX_SPANS}),
    t AS (SELECT doc_id, count(*) AS spans, sum(score) AS total, sum(score) FILTER (place <= 3) AS three, max(x) FILTER (place = 1) AS best FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(spans, 0) AS spans, round(CASE WHEN coalesce(total, 0) <= 1e-6 THEN 0.0 ELSE least(three / total, 1.0) END, 6) AS concentration, best FROM documents d LEFT JOIN t USING (doc_id)"""
)
def ranked_spans(spark, d):
    """Every line as a block of its own."""
    from mnemolake.plans.catalog import _docs

    t, app, text = _docs(spark, d)
    lines = F.filter(F.transform(T.text_lines(text), T.normalize_inline), lambda x: x != "")
    scored = F.filter(F.transform(lines, lambda x: F.struct(T.span_score(app, x).alias("score"), x.alias("text"))), lambda r: r["score"] > 0)
    ranked = F.array_sort(F.transform(F.slice(scored, 1, X.MAX_SPANS), lambda r, i: F.struct((-r["score"]).alias("neg"), i.alias("i"), r["text"].alias("text"), r["score"].alias("score"))))
    s = t.select("doc_id", F.transform(ranked, lambda r: F.struct(r["text"].alias("text"), r["score"].alias("score"))).alias("s"))
    return s.select("doc_id", big(F.size("s")).alias("spans"), F.round(T.concentration(F.col("s")), 6).alias("concentration"), F.get("s", 0)["text"].alias("best"))


@query(
    f"""WITH r AS (SELECT DISTINCT frame_id, coalesce(text, '') AS text, confidence AS c, block_count AS b FROM recognized_texts), s AS (SELECT *, strlen({S.trim('text')}) AS n FROM r)
    SELECT frame_id, n, n < 40 OR c < 0.15::FLOAT OR (b <= 1 AND c < 0.35::FLOAT) OR NOT (CASE WHEN n < 80 THEN false ELSE (n >= 400 AND c >= 0.35::FLOAT) OR (n >= 200 AND b >= 10 AND c >= 0.35::FLOAT) OR (b >= 5 AND c >= 0.55::FLOAT) END) AS low FROM s"""
)
def low_signal(spark, d):
    r = table(spark, d, "recognized_texts").select("frame_id", T.col("text").alias("text"), "confidence", "block_count").distinct()
    return r.select("frame_id", big(T.bytes_of(T.trim_all(F.col("text")))).alias("n"), T.low_signal(F.col("text"), F.col("confidence"), F.col("block_count"), 40).alias("low"))


@query("SELECT DISTINCT frame_id, text AS fast, text AS high_quality FROM recognized_texts WHERE text IS NOT NULL")
def ocr_presets(spark, d):
    """Both presets keep the format of a text as it is; the default one is `ocr_normalize`."""
    r = table(spark, d, "recognized_texts").filter("text is not null").select("frame_id", "text").distinct()
    return r.select("frame_id", T.OcrConfig.fast().normalize(F.col("text")).alias("fast"), T.OcrConfig.high_quality().normalize(F.col("text")).alias("high_quality"))
