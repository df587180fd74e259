"""SQL fragments of the text rules, for checking plans against another engine."""

from __future__ import annotations

from mnemolake.functions import fixed as X

WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def any_in(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def any_start(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in parts) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def inline(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def count_of(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(ch)}, '')))"


def strip_row(x: str, ch: str, most: int) -> str:
    widest = f"list_max(list_transform(string_split({x}, {lit(ch)}), lambda s: strlen({trim('s')})))"
    return f"({count_of(x, ch)} >= 2 AND {widest} <= {most} AND strlen({x}) <= 220)"


def compact(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(strlen({x}) <= 64 AND ({low} IN ('backforward', 'forwardback') OR (contains({low}, 'back') AND contains({low}, 'forward') AND strlen({low}) < 42 "
        f"AND (contains({low}, 'reload') OR contains({low}, 'refresh')))))"
    )


def separator(x: str) -> str:
    return f"regexp_matches({x}, '^[-_=. ]+$')"


def symbols(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 1.0 ELSE length(regexp_replace({x}, '[\\p{{L}}\\p{{N}}]|{WS}', '', 'g'))::DOUBLE / length({x}) END)"


def alnum(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def inventory(x: str) -> str:
    t = "regexp_replace(w, '^[,;:()\\[\\]{}]+|[,;:()\\[\\]{}]+$', '', 'g')"
    ends = " OR ".join(f"ends_with({t}, {lit(e)})" for e in X.PATH_ENDS)
    path = f"(contains({t}, '/') OR contains({t}, '\\') OR (contains({t}, '.') AND (contains({t}, '_') OR contains({t}, '-') OR {ends})))"
    return f"(len({words(x)}) >= 4 AND len(list_filter({words(x)}, lambda w: {path})) >= 3)"


def json_like(x: str) -> str:
    t = trim(x)
    br = f"((starts_with({t}, '{{') AND ends_with({t}, '}}')) OR (starts_with({t}, '[') AND ends_with({t}, ']')))"
    return f"(CASE WHEN {br} THEN strlen({t}) > 50 ELSE {any_in(f'lower({t})', X.JSON_KEYS)} END)"


def notification(x: str) -> str:
    return f"({any_in(f'lower({x})', X.NOTIFICATION_PARTS)} OR starts_with(lower({x}), 'breaking:'))"


def feed(x: str) -> str:
    return f"(strlen({x}) <= 90 AND (len({words(x)}) <= 2 OR starts_with(lower({x}), 'sponsored') OR lower({x}) IN {listed(X.FEED_LABELS)}))"


def animation(x: str) -> str:
    return f"(lower({x}) IN {listed(X.ANIMATION_LABELS)})"


def label(x: str) -> str:
    return "(" + " OR ".join(f"lower({x}) = {lit(v)} OR starts_with(lower({x}), {lit(v + ' ')})" for v in X.GENERIC_LABELS) + ")"


def url(x: str) -> str:
    low = f"lower({trim(x)})"
    return f"(starts_with({low}, 'http://') OR starts_with({low}, 'https://') OR contains({low}, 'www.'))"


def app_is(app: str, needles: list[str]) -> str:
    return any_in(f"lower({app})", needles)


def drop(app: str, x: str) -> str:
    b, c, m = app_is(app, X.BROWSER_APPS), app_is(app, X.CODE_APPS), app_is(app, X.MAIL_APPS)
    return (
        f"(CASE WHEN {separator(x)} OR {strip_row(x, '·', 42)} OR {strip_row(x, '|', 36)} OR {compact(x)} THEN true "
        f"WHEN ({b} OR {m}) AND {label(x)} THEN true WHEN {url(x)} THEN false WHEN {b} AND ({notification(x)} OR {feed(x)}) THEN true "
        f"WHEN {animation(x)} THEN true WHEN NOT {c} AND ({inventory(x)} OR {json_like(x)}) THEN true "
        f"WHEN {m} AND {any_start(f'lower({x})', X.MAIL_HEADERS)} THEN false WHEN {b} AND {symbols(x)} > {X.BROWSER_SYMBOLS} THEN true "
        f"WHEN NOT {c} AND {symbols(x)} > {X.OTHER_SYMBOLS} THEN true ELSE false END)"
    )


def quality(app: str, x: str, low: str = "false", dropped: str | None = None) -> str:
    alpha = f"(CASE WHEN {x} = '' THEN 0.0 ELSE {alnum(x)}::DOUBLE / strlen({x}) END)"
    score = f"({alpha} * 0.52 + (1.0 - {symbols(x)}) * 0.28 + least(strlen({x}), 180)::DOUBLE / 180 * 0.20)"
    d = dropped or drop(app, x)
    return (
        f"least(greatest({score} * (CASE WHEN {low} THEN 0.78 ELSE 1.0 END) * (CASE WHEN {d} THEN 0.16 ELSE 1.0 END) * "
        f"(CASE WHEN NOT {app_is(app, X.CODE_APPS)} AND {inventory(x)} THEN 0.25 ELSE 1.0 END), 0.0), 1.0)"
    )


def generic_title(app: str, x: str) -> str:
    return f"(({app} <> '' AND lower({x}) = lower({app})) OR lower({x}) IN {listed(X.GENERIC_TITLES)})"


def useful(app: str, x: str) -> str:
    n = inline(x)
    return f"(strlen({n}) BETWEEN {X.MIN_LINE_BYTES} AND 240 AND NOT {drop(app, n)} AND NOT {generic_title(app, n)})"


def ocr_noise(x: str) -> str:
    t = trim(x)
    return (
        f"({any_in(x, X.OCR_NOISE_PARTS)} OR (length({x}) > 0 AND {alnum(x)}::DOUBLE / length({x}) < 0.5) OR (len({words(x)}) = 1 AND lower({t}) IN {listed(X.OCR_UI_WORDS)}) "
        f"OR regexp_matches({x}, '{X.OCR_TIME}') OR (ends_with({t}, '%') AND regexp_matches({t}, '^[\\p{{N}}%.]+$')) OR regexp_matches({t}, '{X.OCR_SIZE}') "
        f"OR ({any_start(x, X.OCR_DAYS)} AND strlen({x}) < 20) OR ({any_in(x, X.OCR_MONTHS)} AND strlen({x}) < 15))"
    )


#: lines of documents: doc_id, app, pos, x (normalised, not empty)
LINES = f"""
raw_lines AS (SELECT doc_id, coalesce(app_name, '') AS app, string_split_regex(coalesce(text, ''), '\\r?\\n') AS l FROM documents),
lines AS (SELECT doc_id, app, pos, {inline('x')} AS x FROM (SELECT doc_id, app, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM raw_lines) WHERE {inline('x')} <> '')
"""

#: words of documents: doc_id, at, term
WORDS = r"""
tok AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
flat AS (SELECT doc_id, unnest(range(0, len(w))) AS at, unnest(w) AS term FROM tok),
lens AS (SELECT doc_id, len(w) AS n FROM tok),
st AS (SELECT count(*) AS docs, sum(n)::DOUBLE / count(*) AS avg_len FROM lens),
tf AS (SELECT term, doc_id, count(*) AS tf FROM flat GROUP BY 1, 2),
idf AS (SELECT term, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, st GROUP BY term, docs)
"""
GAIN = "idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg_len))"
