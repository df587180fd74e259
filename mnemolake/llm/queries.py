"""Queries of the training-data operators: name -> function of (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.llm import boilerplate, bpe, leakage, neighbours, ocr_repair, pii, runs, spans, splitting
from mnemolake.session import table


def p1_runs(spark, d):
    r = runs.collapse_runs(table(spark, d, "memory_records"))
    return r.select("session_id", "app_name", "window_title", "start_ms", "end_ms", "duration_ms", F.col("n").alias("n_events"))


def p1_found(spark, d):
    return runs.collapse_runs(table(spark, d, "memory_records")).filter("n > 1").select("session_id", "start_ms", "end_ms").distinct()


def p2_neighbours(spark, d):
    x = neighbours.nearest(table(spark, d, "chunk_index"))
    return x.select("id", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def p2_found(spark, d):
    return neighbours.near_pairs(table(spark, d, "chunk_index"))


def p4_pieces(spark, d):
    return splitting.split_texts(table(spark, d, "record_chunks", True)).select("id", "record_id", "ord", "piece", "start", "end", "text")


def p4_found(spark, d):
    return splitting.split_texts(table(spark, d, "record_chunks", True)).filter("n_pieces > 1 and piece = 0").select("id").distinct()


def _p5_tables(spark, d):
    return table(spark, d, "corpus_records", True), table(spark, d, "pending_chunks", True), table(spark, d, "memory_records")


def p5_found(spark, d):
    corpus, chunks, records = _p5_tables(spark, d)
    rows = boilerplate.corpus_texts(corpus).unionByName(boilerplate.chunk_texts(chunks, records))
    return boilerplate.repeated_lines(rows, boilerplate.bodies(corpus, chunks)).select("origin", "row_key", "line_no").distinct()


def p5_clean_texts(spark, d):
    corpus, chunks, records = _p5_tables(spark, d)
    texts = boilerplate.corpus_texts(corpus, "text").unionByName(boilerplate.chunk_texts(chunks, records, "text"))
    rows = boilerplate.corpus_texts(corpus).unionByName(boilerplate.chunk_texts(chunks, records))
    return boilerplate.without_lines(texts, boilerplate.repeated_lines(rows, boilerplate.bodies(corpus, chunks)))


def _p6_tables(spark, d):
    return table(spark, d, "corpus_records", True), table(spark, d, "memory_records"), table(spark, d, "pending_chunks", True)


def p6_found(spark, d):
    corpus, records, chunks = _p6_tables(spark, d)
    found = pii.personal_spans(pii.personal_texts(corpus, records, chunks)).select("origin", "row_key", "kind").distinct()
    return pii.by_record(found, records).select("origin", "row_key", "kind").distinct()


def p6_redacted(spark, d):
    corpus, records, chunks = _p6_tables(spark, d)
    found = pii.personal_spans(pii.personal_texts(corpus, records, chunks)).drop("by")
    return pii.redacted(pii.all_texts(corpus, records, chunks), pii.by_record(found, records))


def p6_kinds(spark, d):
    corpus, records, chunks = _p6_tables(spark, d)
    found = pii.personal_spans(pii.personal_texts(corpus, records, chunks))
    return found.groupBy("kind", "by").agg(F.count(F.lit(1)).alias("spans"))


def _p7_texts(spark, d):
    return ocr_repair.scanned_texts(table(spark, d, "recognized_texts", True), table(spark, d, "corpus_records", True))


def p7_found(spark, d):
    return ocr_repair.faulty_lines(_p7_texts(spark, d)).distinct()


def p7_repaired(spark, d):
    return ocr_repair.repaired_texts(_p7_texts(spark, d))


def p8_ids(spark, d):
    return bpe.encode_texts(table(spark, d, "documents", True))


def p9_found(spark, d):
    found = leakage.leaked_items(table(spark, d, "documents", True), table(spark, d, "eval_items"))
    return found.filter("verbatim").select("doc_id", "item_id").distinct()


def p9_report(spark, d):
    return leakage.leaked_items(table(spark, d, "documents", True), table(spark, d, "eval_items"), paraphrases=True).select(
        "doc_id", "item_id", "verbatim", F.round("lcs", 4).alias("lcs"), F.round("answers", 4).alias("answers")
    )


def p10_found(spark, d):
    return spans.shared_pairs(table(spark, d, "documents", True))


def p10_coverage(spark, d):
    return spans.shared_coverage(table(spark, d, "documents", True))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "p" and k[1].isdigit()}

_KEY = r"regexp_replace(replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ'), '[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{Nd}]+', '', 'g')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_P5 = f"""WITH c AS (SELECT 'corpus_records' AS origin, id::VARCHAR AS row_key, min(source) AS a, 'c' AS b, min(text) AS text FROM corpus_records GROUP BY id),
        r AS (SELECT id, lower(trim(min(app_name))) AS app FROM memory_records GROUP BY id),
        p AS (SELECT 'pending_chunks' AS origin, chunk_id AS row_key, min(source) AS a, min(app) AS b, min(text) AS text FROM pending_chunks LEFT JOIN r ON r.id = record_id GROUP BY chunk_id),
        t AS (SELECT * FROM c UNION ALL SELECT * FROM p),
        l AS (SELECT origin, row_key, a, b, text, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS x FROM (SELECT *, string_split(text, chr(10)) AS s FROM t WHERE a <> '' AND b <> '' AND text <> '')),
        k AS (SELECT *, {_KEY} AS k FROM l),
        g AS (SELECT origin, a, b, k FROM k WHERE length(regexp_replace(k, '\\P{{L}}+', '', 'g')) >= 8 GROUP BY ALL HAVING count(DISTINCT text) >= 8),
        f AS (SELECT DISTINCT origin, row_key, line_no FROM k JOIN g USING (origin, a, b, k))"""

#: the queries that SQL can express; the others are tested against brute force and exact round trips
SQL: dict[str, str] = {
    "p4_found": "SELECT DISTINCT id FROM record_chunks WHERE length(text) > 1200",
    "p5_found": _P5 + " SELECT DISTINCT origin, row_key, line_no FROM f",
    "p5_clean_texts": _P5
    + """, n AS (SELECT origin, row_key, list(DISTINCT line_no) AS ls FROM f GROUP BY ALL)
        SELECT origin, row_key, CASE WHEN ls IS NULL THEN text WHEN len(ls) = len(string_split(text, chr(10))) THEN '' ELSE
        array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ls, i)), chr(10)) END AS text, coalesce(len(ls), 0) AS n_removed
        FROM t LEFT JOIN n USING (origin, row_key)""",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), j AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
        n AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM j)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''), s AS (SELECT DISTINCT k FROM n),
        m AS (SELECT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, s WHERE len(w) >= k))
        SELECT DISTINCT doc_id, item_id FROM m JOIN n USING (k, g)""",
    "p2_found": """WITH v AS (SELECT id, any_value(vector) AS v FROM chunk_index WHERE len(vector) = 768 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
        c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM v a JOIN v b ON a.id <> b.id),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM c) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 3""",
    "p10_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
        g AS (SELECT DISTINCT doc_id, hash(s) AS a, md5_number_lower(s) AS b FROM (SELECT doc_id, substring(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d)))
        SELECT DISTINCT x.doc_id AS doc_a, y.doc_id AS doc_b FROM g x JOIN g y USING (a, b) WHERE x.doc_id < y.doc_id""",
    "p10_coverage": """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
        c AS (SELECT text, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM d GROUP BY text),
        g AS (SELECT rep, i, hash(s) AS a, md5_number_lower(s) AS b FROM (SELECT rep, i, substring(text, i, 300) AS s FROM (SELECT rep, text, unnest(range(1, n - 298)) AS i FROM c))),
        k AS (SELECT a, b FROM g GROUP BY a, b HAVING count(DISTINCT rep) > 1),
        v AS (SELECT DISTINCT rep, i FROM g JOIN k USING (a, b)),
        u AS (SELECT rep, least(300, coalesce(lead(i) OVER (PARTITION BY rep ORDER BY i) - i, 300)) AS x FROM v),
        s AS (SELECT rep, sum(x)::BIGINT AS cov FROM u GROUP BY rep)
        SELECT d.doc_id, c.rep AS class_id, copies, CASE WHEN copies > 1 THEN d.n ELSE cov END AS shared_chars, d.n AS n_chars
        FROM d JOIN c USING (text) LEFT JOIN s USING (rep) WHERE copies > 1 OR cov IS NOT NULL""",
}
