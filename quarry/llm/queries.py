"""The subpackage's registered queries: each applies one operator to its whole table. SQL stands beside a query where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe, merkle, packing, quality, simhash, suffix_dedup, toxicity, url_filter, warc, webp
from quarry.llm.common import held_out_of

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = held_out_of(4, 2)
    model = toxicity.train(docs, labels, keep=f"not {held_out}")
    return _judged(toxicity.classify_toxicity(docs, model, ["doc_id"]), held_out, toxicity.THRESHOLD)


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_rows(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null texts have the closing id only, rows that repeat are packed each."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path(TOKENIZER)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = held_out_of(5, 0)
    model = quality.train(docs, labels, keep=f"not {held_out}")
    return _judged(quality.classify_quality(docs, model, ["doc_id"]), held_out, quality.THRESHOLD)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(_table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, held_out: str, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.expr(held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_webp, op3_simhash, op4_warc, op5_merkle, op6_packing, op7_quality, op8_bpe, op9_urls, op10_suffix_dedup)
}

def _uuid_sql(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return f"'urn:uuid:' || substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' || substring({h}, 17, 4) || '-' || substring({h}, 21, 12)"


#: Characters by name, spelled out here on their own so that the SQL doesn't repeat the operator's table.
_NAMED = "amp & lt < gt > quot \" apos ' copy \u00a9 reg \u00ae trade \u2122 hellip \u2026 mdash \u2014 ndash \u2013 lsquo \u2018 rsquo \u2019 ldquo \u201c rdquo \u201d laquo \u00ab raquo \u00bb bull \u2022 middot \u00b7 euro \u20ac pound \u00a3 yen \u00a5 cent \u00a2 sect \u00a7 para \u00b6 deg \u00b0 plusmn \u00b1 times \u00d7 divide \u00f7 auml \u00e4 ouml \u00f6 uuml \u00fc Auml \u00c4 Ouml \u00d6 Uuml \u00dc szlig \u00df eacute \u00e9 egrave \u00e8 ecirc \u00ea agrave \u00e0 aacute \u00e1 acirc \u00e2 ccedil \u00e7 ntilde \u00f1 iacute \u00ed oacute \u00f3 uacute \u00fa shy \u00ad zwnj \u200c".split(" ")


def _entities_sql(x: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    pairs = list(zip(_NAMED[::2], _NAMED[1::2], strict=True)) + [("nbsp", " ")]
    named = "CASE regexp_extract(p, '^([A-Za-z][A-Za-z0-9]{1,31});', 1) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs) + " END"
    code = "CASE WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INT) WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') THEN CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1) AS INT) END"
    char = f"CASE WHEN {code} = 160 THEN ' ' WHEN {code} > 0 AND {code} < 1114112 AND NOT ({code} BETWEEN 55296 AND 57343) THEN chr({code}) ELSE {named} END"
    part = f"CASE WHEN ({char}) IS NOT NULL THEN ({char}) || substring(p, strpos(p, ';') + 1) ELSE '&' || p END"
    parts = f"string_split({x}, '&')"
    return f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {part}), ''))"


def _warc_sql() -> str:
    text = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "template", "head"):
        end = r"|\z" if tag in ("script", "style") else ""
        text = rf"regexp_replace({text}, '(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>{end})', ' ', 'g')"
    blocks = "address article aside blockquote br dd div dl dt footer form h[1-6] header hr li main nav ol p pre section table td th tr ul".replace(" ", "|")
    text = rf"regexp_replace(regexp_replace({text}, '(?i)</?(?:{blocks})(?:[\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    text = _entities_sql(text)
    text = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    title = rf"regexp_replace(regexp_replace({_entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
    end = "chr(13) || chr(10)"
    return rf"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
        r AS (SELECT *, {_uuid_sql("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", 'target_uri', 'sha256(html)')} AS refers_to, 'sha256:' || sha256(html) AS source_digest,
                     'HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || strlen(html) || {end} AS source_headers, {text} AS t, {title} AS title,
                     len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links FROM p),
        d AS (SELECT *, {_uuid_sql("'conversion'", 'refers_to', 'source_digest')} AS of_text FROM r),
        k AS (SELECT *, 'conversion' AS warc_type, of_text AS record_id, 'text/plain' AS content_type, t AS block FROM d UNION ALL
              SELECT *, 'metadata', {_uuid_sql("'metadata'", 'refers_to', 'source_digest')}, 'application/warc-fields',
                     'title: ' || title || {end} || 'source-content-type: text/html; charset=utf-8' || {end} || 'source-payload-digest: ' || source_digest || {end} || 'conversion-record-id: ' || of_text || {end} ||
                     'conversion-digest: sha256:' || sha256(t) || {end} || 'outlinks: ' || links || {end} FROM d)
        SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, source_headers, source_digest, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM k
    """


SQL: dict[str, str] = {
    "op4_warc": _warc_sql(),
    "op9_urls": r"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
                         row_number() OVER () AS n FROM pages),
        hits AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
                 FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (n)
    """,
}
