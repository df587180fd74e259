"""Blocklists of apps and domains, and the three-way safety gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize_app(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))


_URL_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:\\ ]*)"


def url_host(x: Column) -> Column:
    """Host of an absolute address, lower case; '' if there is none."""
    return F.regexp_extract(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+\z", "")), _URL_HOST, 1)


def normalize_domain(x: Column) -> Column:
    """Host of an address, or what stands before the first / or :; without outer space and leading dots."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+\z", ""), r"^\.+", ""))
    return F.when(t.contains("://"), url_host(t)).otherwise(F.regexp_extract(t, r"^([^/:]*)", 1))


def host_of(x: Column) -> Column:
    """What is matched: the host of an absolute address, else the value read as a bare host."""
    return F.when(url_host(x) != "", url_host(x)).otherwise(normalize_domain(x))


def app_list(spark: SparkSession, entries: list[str]) -> DataFrame:
    return spark.createDataFrame([(e,) for e in entries], "entry string").select(normalize_app(F.col("entry")).alias("entry")).filter("entry <> ''").distinct()


def domain_list(spark: SparkSession, entries: list[str]) -> DataFrame:
    return spark.createDataFrame([(e,) for e in entries], "entry string").select(normalize_domain(F.col("entry")).alias("entry")).filter("entry <> ''").distinct()


def token_runs(x: Column) -> Column:
    """All contiguous runs of whole tokens of an app name."""
    t = F.split(normalize_app(x), " ")
    n = F.size(t)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(t, i, j - i + 1), " ")))))


def host_suffixes(x: Column) -> Column:
    """A host and its parents on label boundaries."""
    t = F.split(host_of(x), r"\.", -1)
    n = F.size(t)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(t, i, n - i + 1), "."))


def _flagged(df: DataFrame, keys: Column, entries: DataFrame) -> DataFrame:
    """df with column blocked: an equi-join of distinct values on exploded keys, no comparison of all with all."""
    d = df.withColumn("_ks", keys)
    hit = d.select("_ks").distinct().select("_ks", F.explode("_ks").alias("entry")).join(entries, "entry", "left_semi").select("_ks").distinct().withColumn("_hit", F.lit(True))
    return d.join(hit, "_ks", "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_ks", "_hit")


def block_apps(df: DataFrame, app: str, entries: DataFrame) -> DataFrame:
    return _flagged(df, token_runs(F.col(app)), entries)


def block_urls(df: DataFrame, url: str, entries: DataFrame) -> DataFrame:
    return _flagged(df, host_suffixes(F.col(url)), entries)


def allowed_only(df: DataFrame, app: str, url: str | None, apps: DataFrame, domains: DataFrame | None) -> DataFrame:
    """Rows of sources that are not blocked (clipboard, meetings, captures)."""
    d = block_apps(df, app, apps).filter("not blocked").drop("blocked")
    return d if url is None or domains is None else block_urls(d, url, domains).filter("not blocked").drop("blocked")


#: Our choice of secrets; replace as needed.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._\-]{20,}",
    "password": r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S+",
}


def safety_gate(df: DataFrame, text: str, skip: Column, secrets: dict[str, str] | None = None) -> DataFrame:
    """decision Allow, Redact or SkipStorage, and the text as it may be stored (null if it may not)."""
    t = F.coalesce(F.col(text), F.lit(""))
    red = t
    for name, pattern in (secrets or SECRETS).items():
        red = F.regexp_replace(red, pattern, f"[{name}]")
    decision = F.when(skip, "SkipStorage").when(red != t, "Redact").otherwise("Allow")
    return df.withColumn("decision", decision).withColumn("stored_text", F.when(~skip, red))
