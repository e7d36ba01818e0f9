"""WARC derivatives: for each response a metadata record and a plain-text conversion record that refer to it.

The derivatives are DataFrame code over one scan: two rows for each response, no shuffle. Files of them, with a gzip member
for each record, are written and read in Python.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Element pairs whose contents are no text.
_HIDDEN = ("script", "style", "noscript", "template", "head")
#: Those of them that reach to the page's end where they aren't closed.
_TO_THE_END = ("script", "style")
_BLOCK_TAGS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:[\s/][^>]*)?>"
#: Names of characters in HTML that are decoded, besides those by number.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026",
    "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "bull": "\u2022", "middot": "\u00b7",
    "euro": "\u20ac", "pound": "\u00a3", "yen": "\u00a5", "cent": "\u00a2", "sect": "\u00a7", "para": "\u00b6", "deg": "\u00b0", "plusmn": "\u00b1", "times": "\u00d7", "divide": "\u00f7",
    "auml": "\u00e4", "ouml": "\u00f6", "uuml": "\u00fc", "Auml": "\u00c4", "Ouml": "\u00d6", "Uuml": "\u00dc", "szlig": "\u00df", "eacute": "\u00e9", "egrave": "\u00e8", "ecirc": "\u00ea",
    "agrave": "\u00e0", "aacute": "\u00e1", "acirc": "\u00e2", "ccedil": "\u00e7", "ntilde": "\u00f1", "iacute": "\u00ed", "oacute": "\u00f3", "uacute": "\u00fa", "shy": "\u00ad", "zwnj": "\u200c",
}


def decoded(text: Column) -> Column:
    """Character references by name or number as characters, each once; unknown ones and numbers of no character stay as they are.

    Each step is an array made from the one before, so that the text is split, and a reference read, once.
    """
    names = F.create_map(*[x for k, v in ENTITIES.items() for x in (F.lit(k), F.lit(v))])
    reference = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def number(r: Column) -> Column:
        return F.when(r.startswith("#x") | r.startswith("#X"), F.conv(F.substring(r, 3, 6), 16, 10)).when(r.startswith("#"), F.substring(r, 2, 7)).try_cast("int")

    def character(x: Column) -> Column:
        n = x["n"]
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        by_number = F.when(n == 160, " ").when(n.between(1, 127), F.chr(n)).when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.when(n.isNotNull(), by_number).otherwise(F.try_element_at(names, x["r"]))

    parts = F.transform(F.split(text, "&"), lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.when(i > 0, F.regexp_extract(p, reference, 1)).alias("r")))
    parts = F.transform(parts, lambda x: F.struct(x["p"].alias("p"), x["i"].alias("i"), x["r"].alias("r"), number(x["r"]).alias("n")))
    parts = F.transform(parts, lambda x: F.struct(x["p"].alias("p"), x["i"].alias("i"), x["r"].alias("r"), F.when(x["r"] != "", character(x)).alias("c")))
    whole = F.transform(parts, lambda x: F.when(x["i"] == 0, x["p"]).when(x["c"].isNull(), F.concat(F.lit("&"), x["p"])).otherwise(F.concat(x["c"], F.substr(x["p"], F.length(x["r"]) + 2))))
    return F.array_join(whole, "")


def _where(text: Column, marks: dict[str, Callable[[Column], Column]]) -> Column:
    """Steps in order, each only for texts that had its mark (lower-case ASCII) at the beginning, in either case: a step adds no mark.

    Each is an array made from the one before, so that no text is made twice.
    """

    def taken(mark: str, step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.when(F.contains(s["l"], F.lit(mark)), step(s["t"])).otherwise(s["t"]).alias("t"), s["l"].alias("l"))

    x = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), F.lower(t).alias("l")))
    for mark, step in marks.items():
        x = F.transform(x, taken(mark, step))
    return F.element_at(x, 1)["t"]


def plain_text(html: Column) -> Column:
    """The visible text of an HTML page, a line for each block; null is empty."""
    steps = {"<!--": lambda t: F.regexp_replace(t, r"(?s)<!--.*?-->", " ")}
    for tag in _HIDDEN:
        end = r"|\z" if tag in _TO_THE_END else ""
        steps[f"<{tag}"] = lambda t, tag=tag, end=end: F.regexp_replace(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>{end})", " ")
    text = _where(F.coalesce(html, F.lit("")), steps)
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK_TAGS, "\n"), r"<[^>]*>", "")
    text = _where(text, {"&": decoded})
    # Neither pattern matches what it would leave as it is: single blanks and single ends of lines.
    text = F.regexp_replace(F.regexp_replace(text, r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " "), r" \n[ \n]*|\n[ \n]+", "\n")
    return F.btrim(text, F.lit(" \n"))


def page_title(html: Column) -> Column:
    title = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.regexp_replace(F.regexp_replace(decoded(title), r"\s+", " "), r"^ | $", "")


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from the parts, so that recomputed rows keep their ids."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages: `page_id, record_id, target_uri, headers, payload, payload_digest`."""
    html, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, F.sha2(html, 256)).alias("record_id"),
        uri.alias("target_uri"),
        headers.alias("headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def _header(headers: Column, name: str) -> Column:
    return F.regexp_extract(headers, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)


def derivatives(responses: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows for each response: `warc_type` metadata and conversion.

    Takes `id_col, record_id, target_uri, headers, payload, payload_digest`, other columns are not read. Returns `id_col,
    warc_type, record_id, refers_to, target_uri, content_type, source_headers, source_digest, content_length,
    block_digest, block`. `refers_to` is the response's record id, `source_headers` and `source_digest` are the response's
    own, unchanged. The conversion's block is the plain text; the metadata's block names the title, the source's type and
    digest, the conversion's id and digest, and the number of links. Null payloads are empty and give empty text; repeated
    responses give repeated records with equal ids.
    """
    r = responses.select(
        id_col,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        F.coalesce("headers", F.lit("")).alias("source_headers"),
        F.coalesce("payload", F.lit("")).alias("__payload"),
        F.coalesce("payload_digest", digest(F.coalesce("payload", F.lit("")))).alias("source_digest"),
    )
    r = r.withColumn("__text", plain_text(F.col("__payload"))).withColumn("__title", page_title(F.col("__payload")))
    r = r.withColumn("__links", F.regexp_count("__payload", F.lit(r"(?i)<a\s[^>]*href"))).withColumn("__of_text", record_id(F.lit("conversion"), F.coalesce("refers_to", F.lit("")), "source_digest"))
    r = r.withColumn("__text_digest", digest(F.col("__text")))
    fields = F.concat(
        F.lit("title: "), F.col("__title"),
        F.lit("\r\nsource-content-type: "), _header(F.col("source_headers"), "content-type"),
        F.lit("\r\nsource-payload-digest: "), F.col("source_digest"),
        F.lit("\r\nconversion-record-id: "), F.col("__of_text"),
        F.lit("\r\nconversion-digest: "), F.col("__text_digest"),
        F.lit("\r\noutlinks: "), F.col("__links").cast("string"), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), record_id(F.lit("metadata"), F.coalesce("refers_to", F.lit("")), "source_digest").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("__of_text").alias("record_id"), F.lit("text/plain").alias("content_type"), F.col("__text").alias("block")),
    )
    rows = r.select(id_col, "refers_to", "target_uri", "source_headers", "source_digest", F.explode(kinds).alias("k"))
    return rows.select(
        id_col, "k.warc_type", "k.record_id", "refers_to", "target_uri", "k.content_type", "source_headers", "source_digest",
        F.octet_length("k.block").cast("long").alias("content_length"), digest(F.col("k.block")).alias("block_digest"), "k.block",
    )


def warc_record(rows: DataFrame, date: str) -> DataFrame:
    """The rows of `derivatives` as WARC/1.1 records (binary column `record`), dated `date`; one after the other they form a WARC file."""
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    shown = [F.concat(F.lit(f"{n}: "), F.concat(F.lit("<"), F.col(c), F.lit(">")) if c in ("record_id", "refers_to") else F.col(c).cast("string")) for n, c in lines]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Date: {date}"), *shown)
    return rows.select(rows.columns[0], F.encode(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")), "utf-8").alias("record"))


def gzip_members(records: DataFrame) -> DataFrame:
    """The `record` column of `warc_record` as gzip members: the members one after the other are a compressed WARC file."""

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda r: None if r is None else gzip.compress(bytes(r), mtime=0))

    return records.withColumn("record", packed("record"))


def _plain(data: bytes) -> Iterator[bytes]:
    """The data, or what its gzip members hold, one after the other."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        data = member.unused_data
    if data:
        yield data


def parse_warc(data: bytes | None) -> list[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records of a WARC file, compressed by record or not.

    Null and empty files have none. A record that isn't one, or is cut short, is an error that says where.
    """
    text = b"".join(_plain(data or b""))
    out, at = [], 0
    while at < len(text):
        end = text.find(b"\r\n\r\n", at)
        if end < 0 or not text.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = text[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin, size = end + 4, int(headers.get("content-length", "-1"))
        if size < 0 or text[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        out.append((headers, text[begin : begin + size]))
        at = begin + size + 4
    return out


def read_warc(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each record of WARC files (binary column `content`): `warc_type, record_id, refers_to, target_uri, block_digest, source_digest, content_type, block`, and whether the block has its digest."""
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-block-digest", "warc-source-payload-digest", "content-type"]
    schema = "array<struct<warc_type: string, record_id: string, refers_to: string, target_uri: string, block_digest: string, source_digest: string, content_type: string, block: binary>>"

    @F.udf(schema)
    def records(data: bytes | None) -> list[tuple]:
        return [(*[h[n].strip("<>") if n in h else None for n in names], block) for h, block in parse_warc(data)]

    rows = files.select(F.explode(records(content)).alias("r")).select("r.*")
    return rows.withColumn("intact", F.col("block_digest") == F.concat(F.lit("sha256:"), F.sha2("block", 256)))
