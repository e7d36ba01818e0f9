"""URL filters over host-suffix and path-prefix expressions, joined on short hash prefixes.

Everything here is DataFrame code that stays in the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the digest that the join compares; the full digest is confirmed afterwards.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty for null or where there is no `://`."""
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def _label_count(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """For each shape (labels, characters) the last labels of the host with the first characters of the path, where it has as many."""
    labels = F.split(host, r"\.", -1)
    wanted = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("n")) for d, n in shapes])
    fitting = F.filter(wanted, lambda s: (s["d"] <= F.size(labels)) & (s["n"] <= F.length(path)))
    return F.transform(
        fitting,
        lambda s: F.struct(
            F.array_join(F.slice(labels, F.size(labels) - s["d"] + 1, s["d"]), ".").alias("host"),
            F.substring(path, F.lit(1), s["n"]).alias("path"),
        ),
    )


def match_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge each distinct url of `urls` by `rules` (host, path, verdict).

    Returns `url, host, path, rule, verdict`, a row for each distinct url, null included. A rule fits its own host and all
    subdomains if the url's path starts with the rule's path. The longest rule (host and path together) wins; of equally
    long ones the longer host, then `block`. Without a rule `rule` is null and `verdict` is `default`. Null, empty and
    malformed urls have an empty host and path and fit no rule; an empty rule table fits nothing. Repeated rules count once.

    The expressions a url is expanded into have the shapes (labels, path length) that occur among the rules: a set bounded
    by the longest rule, however many rules there are. Rules are joined on the first digits of a SHA-256; Spark broadcasts
    them only under its own size threshold and otherwise shuffles, where AQE splits hot prefixes.
    """
    rules = rules.select(
        F.coalesce(F.col("host"), F.lit("")).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).distinct()
    shapes = sorted((r[0], r[1]) for r in rules.select(_label_count(F.col("r_host")), F.length("r_path")).distinct().collect())
    distinct = urls.select(F.col(url_col).alias("url")).distinct()
    parts = distinct.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    rules = rules.withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    expanded = parts.select("*", F.explode_outer(_expressions(F.col("host"), F.col("path"), shapes)).alias("e"))
    expanded = expanded.withColumn("digest", _digest(F.col("e.host"), F.col("e.path")))
    joined = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(rules, "prefix", "left")
    precedence = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("r_verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    confirmed = F.when(F.col("digest") == F.col("r_digest"), precedence)
    best = joined.groupBy("url", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """`id_col, url, host, path, rule, verdict` for every row of `pages`, repeated rows and null ids included.

    Other columns of `pages` never enter the plan, so their names cannot clash.
    """
    own = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("__url"))
    judged = match_urls(pages, rules, url_col, default).withColumnRenamed("url", "__of")
    return own.join(judged, F.col("__url").eqNullSafe(F.col("__of")), "left").select(id_col, F.col("__url").alias("url"), "host", "path", "rule", "verdict")
