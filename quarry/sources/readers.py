"""Readers and parsers: canonical views over drifting schemas, files, feeds, pages, sitemaps and statistical services' JSON."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from quarry.functions import text as T
from quarry.registry import query
from quarry.sources.market import table


@dataclass(frozen=True)
class ColumnSpec:
    """A canonical column: its type, the names it may come under, the value where none has one."""

    name: str
    type: str
    aliases: tuple[str, ...] = ()
    default: object = None


#: Columns of the canonical bar.
BAR_COLUMNS = (
    ColumnSpec("symbol", "string", ("ticker",), ""), ColumnSpec("asset_type", "string", (), ""), ColumnSpec("exchange", "string", (), ""), ColumnSpec("ts", "timestamp", ("timestamp", "datetime", "date")),
    ColumnSpec("timeframe", "string", ("interval",), ""), ColumnSpec("open", "double"), ColumnSpec("high", "double"), ColumnSpec("low", "double"), ColumnSpec("close", "double", ("adj_close",)), ColumnSpec("volume", "double"),
    ColumnSpec("source", "string", (), ""), ColumnSpec("provider", "string", (), ""),
)


def canonical(df: DataFrame, specs: tuple[ColumnSpec, ...]) -> DataFrame:
    """The specified columns and no others: the first of a column's names that has a value of its type, else the default.

    Values that are no number or time become null. Names that the data lack are passed over; extra columns are dropped.
    """
    have = {c.lower(): c for c in df.columns}

    def one(s: ColumnSpec) -> Column:
        found = [have[n.lower()] for n in (s.name, *s.aliases) if n.lower() in have]
        parts = [F.col(f"`{c}`").cast("string") if s.type == "string" else F.expr(f"try_cast(`{c}` as {s.type})") for c in found]
        return F.coalesce(*parts, F.lit(s.default).cast(s.type)).alias(s.name)

    return df.select(*[one(s) for s in specs])


def empty(spark: SparkSession, specs: tuple[ColumnSpec, ...]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(s.name, spark.createDataFrame([], f"x {s.type}").schema[0].dataType) for s in specs]))


def lake(spark: SparkSession, paths: list[str], specs: tuple[ColumnSpec, ...], root: str | None = None) -> DataFrame:
    """A canonical view over Parquet folders whose schemas differ and whose partitions are named in their paths; none existing gives an empty view."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (s := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).globStatus(s)]
    if not there:
        return empty(spark, specs)
    reader = spark.read.option("mergeSchema", True)
    return canonical((reader.option("basePath", root) if root else reader).parquet(*there), specs)


def register(spark: SparkSession, name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(name)


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, JSON lines, JSON or Parquet, by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.option("multiLine", kind == "json").json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {kind}")


def by_record_type(rows: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """One table for each value of `record_type`, with the columns that have values there left to the reader's projection."""
    return {k: rows.where(F.col("record_type") == k) for k in kinds}


def page(df: DataFrame, number: int, size: int, search: str = "", sort: str | None = None, descending: bool = False) -> DataFrame:
    """A page of at most 1000 rows of a preview, filtered by a text in any column and sorted as text."""
    rows = df.limit(1000)
    if search:
        rows = rows.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).contains(search.lower()))
    if sort:
        key = F.col(sort).cast("string")
        rows = rows.orderBy(key.desc() if descending else key.asc())
    return rows.offset((number - 1) * size).limit(size)


# feeds and pages


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def parse_feed(xml: str | None) -> list[dict]:
    """Items of RSS or Atom: title, url, published, author, content. Text that is no XML has no items."""
    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError:
        return []
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in item:
            name, text = _local(child.tag), " ".join("".join(child.itertext()).split())
            key = {"title": "title", "link": "url", "id": "id", "guid": "id", "pubdate": "published", "published": "published", "updated": "updated", "author": "author", "creator": "author", "summary": "summary", "description": "summary", "content": "content", "encoded": "content"}.get(name)
            if name == "link" and not text:
                text = child.get("href", "")
            if key and text:
                got.setdefault(key, text)
        out.append({"title": got.get("title", ""), "url": got.get("url") or got.get("id", ""), "published": got.get("published") or got.get("updated"), "author": got.get("author"), "content": got.get("content") or got.get("summary", "")})
    return out


FEED_ITEM = "array<struct<title:string,url:string,published:string,author:string,content:string>>"


def feed_items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """A row for each item of each feed: the feed's other columns and the item's."""

    @F.pandas_udf(FEED_ITEM)
    def items(xml: pd.Series) -> pd.Series:
        return xml.map(parse_feed)

    rest = [c for c in feeds.columns if c != xml_col]
    return feeds.select(*rest, F.explode(items(xml_col)).alias("item")).select(*rest, "item.*")


class PageParser(HTMLParser):
    """Collects title, meta data, language, paragraphs and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.lang, self.canonical = "", "", ""
        self.paragraphs: list[list[str]] = []
        self.links: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content", ""))
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = a.get("href", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in ("title", "p", "script", "style"):
            if tag == "p":
                self.inside = [t for t in self.inside if t != "p"]
                self.paragraphs.append([])
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.inside:
            return
        if self.inside[-1] == "title":
            self.title += data
        elif self.inside[-1] == "p":
            self.paragraphs[-1].append(data)


def parse_page(html: str | None) -> dict:
    p = PageParser()
    p.feed(html or "")
    p.close()
    clean = lambda s: " ".join(s.split())
    content = "\n".join(t for t in (clean("".join(x)) for x in p.paragraphs) if t)
    title = p.meta.get("og:title") or p.meta.get("twitter:title") or p.title
    return {"title": clean(title), "content": content or clean(p.meta.get("description", "")), "author": p.meta.get("author") or None, "published": p.meta.get("article:published_time") or None, "canonical": p.canonical or None, "lang": p.lang or None, "links": len(p.links)}


def parse_pages(pages: DataFrame) -> DataFrame:
    """`page_id, title, content, author, published, canonical, lang, links` of each page; broken markup gives what can be read."""
    schema = "page_id long, title string, content string, author string, published string, canonical string, lang string, links int"

    def run(batches):
        for b in batches:
            rows = [parse_page(h) for h in b.column(1).to_pylist()]
            names = [f.split()[0] for f in schema.split(", ")][1:]
            yield pa.record_batch([b.column(0).cast(pa.int64()), *[pa.array([r[n] for r in rows], pa.int32() if n == "links" else pa.string()) for n in names]], ["page_id", *names])

    return pages.select("page_id", "html").mapInArrow(run, schema)


@query("pages_parsed", """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a [^>]*href="[^"]+"')) AS links FROM pages""")
def _pages(spark, sf):
    p = parse_pages(table(spark, sf, "pages"))
    return p.select("page_id", "lang", F.col("links").cast("long").alias("links"))


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """A row for each `loc` of each sitemap."""
    plain = F.regexp_replace(xml_col, r'xmlns(:\w+)?="[^"]*"', "")
    return sitemaps.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<loc>\s*([^<]*?)\s*</loc>"), 1)).alias("url"))


#: Names under which services put an item's parts.
ITEM_NAMES = {"url": ("url", "link"), "title": ("title", "name"), "content": ("content", "body", "summary", "description"), "published": ("published_at", "published", "date"), "author": ("author", "byline")}


def api_items(answers: DataFrame, json_col: str = "json") -> DataFrame:
    """Items of answers that are a list, or an object with one in `items`: the first name of each part that has a value."""
    kind = "array<map<string,string>>"
    items = F.coalesce(F.from_json(json_col, kind), F.from_json(F.get_json_object(json_col, "$.items"), kind))
    rows = answers.select(F.explode(items).alias("i"))
    return rows.select(*[F.coalesce(*[F.nullif(F.trim(F.col("i")[n]), F.lit("")) for n in names]).alias(part) for part, names in ITEM_NAMES.items()])


def company_facts(filings: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """(cik, json) with facts nested by taxonomy, tag and unit as one row for each fact."""
    fact = "array<struct<end:string,val:double,fy:int,fp:string,form:string,filed:string>>"
    nested = F.from_json("json", f"struct<facts:map<string,map<string,struct<units:map<string,{fact}>>>>>")
    rows = filings.select("cik", F.explode(nested["facts"]).alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "t")).select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "list")).select("cik", "taxonomy", "tag", "unit", F.inline("list"))
    return rows.where(F.col("form").isin(forms)) if forms else rows


def observations(answers: DataFrame) -> DataFrame:
    """(series_id, json) as dated numbers; missing values, written as a dot or nothing, are left out."""
    rows = answers.select("series_id", F.explode(F.from_json("json", "struct<observations:array<struct<date:string,value:string>>>")["observations"]).alias("o"))
    value = F.regexp_replace("o.value", ",", "")
    return rows.where(F.coalesce(F.trim("o.value"), F.lit("")).isin("", ".") == F.lit(False)).select("series_id", F.to_date("o.date").alias("date"), value.try_cast("double").alias("value"))


def source_schema_report(df: DataFrame) -> DataFrame:
    """For each column: rows, nulls and approximate number of values, in one aggregation."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("present"), (F.count(F.lit(1)) - F.count(F.col(c))).alias("nulls")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


@query("schema_report", "SELECT 'doc_id' AS \"column\", count(doc_id) AS present, count(*) - count(doc_id) AS nulls FROM documents UNION ALL SELECT 'lang', count(lang), count(*) - count(lang) FROM documents UNION ALL SELECT 'source', count(source), count(*) - count(source) FROM documents")
def _report(spark, sf):
    return source_schema_report(table(spark, sf, "documents").select("doc_id", "lang", "source"))


@query("canonical_events", "SELECT event_type AS symbol, '' AS exchange, ts, value AS close FROM events")
def _canonical(spark, sf):
    specs = (ColumnSpec("symbol", "string", ("event_type",), ""), ColumnSpec("exchange", "string", (), ""), ColumnSpec("ts", "timestamp_ntz"), ColumnSpec("close", "double", ("value",)))
    return canonical(table(spark, sf, "events"), specs)


@query("turns_sentences", r"SELECT conv_id, turn, len(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g'), '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '')) AS n FROM conversations")
def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.sentences("text")).cast("long").alias("n"))
