"""Catalogues of feeds, connectors for public data services, rules of robots, pages of papers, and stores of factors, signals and datasets."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable
from urllib import robotparser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions.numeric import ratio
from quarry.registry import query
from quarry.sources import readers, sinks

# catalogues

CATALOG = "name string, url string, category string, tags array<string>, source_tier int, language string, cadence_minutes int, rate_limit_seconds int, reputation_score double, state_affiliation string, propaganda_risk boolean"
#: What a row of a catalogue has where it says nothing.
DEFAULTS = {"language": "en", "cadence_minutes": 60, "rate_limit_seconds": 10, "reputation_score": 0.0, "state_affiliation": "", "propaganda_risk": False}
TIERS = (1, 2, 3, 4)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list of feeds, with defaults, trimmed texts and lower-case tags."""
    rows = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return rows.withColumns({**{c: F.trim(c) for c in ("name", "url", "category")}, "tags": tags})


def host_of(url: Column) -> Column:
    """The lower-case host without port and www; null without a scheme."""
    return F.regexp_replace(F.regexp_replace(F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit("")), ":[0-9]*$", ""), r"^www\.", "")


def catalog_problems(rows: DataFrame, domains: DataFrame, categories: list[str]) -> DataFrame:
    """`name, problem`: names and addresses that repeat, unknown categories and tiers, and hosts that no allowed domain covers.

    A host is looked up by each of its suffixes, so the domains are an equi-join.
    """
    twice = lambda c: F.count("*").over(Window.partitionBy(F.lower(c))) > 1
    host = host_of(F.col("url"))
    r = rows.withColumns({"__host": host, "__name": twice("name"), "__url": twice("url")})
    parts = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    allowed = domains.select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("__s")).distinct()
    fits = r.where("__host is not null").select("url", F.explode(suffixes).alias("__s")).join(allowed, "__s").select("url").distinct().withColumn("__ok", F.lit(True))
    checks = [
        (F.col("__name"), "name repeats"), (F.col("__url"), "address repeats"), (~F.coalesce(F.col("category").isin(categories), F.lit(False)), "unknown category"),
        (~F.coalesce(F.col("source_tier").isin(*TIERS), F.lit(False)), "unknown tier"), (F.col("__ok").isNull(), "domain not allowed"),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in checks])))
    return r.join(fits, "url", "left").select("name", found.alias("problem"))


def check_catalog(rows: DataFrame, domains: DataFrame, categories: list[str]) -> DataFrame:
    """The rows, or an error with the first problems."""
    bad = catalog_problems(rows, domains, categories).orderBy("name", "problem").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{b.name}: {b.problem}" for b in bad))
    return rows


@query("catalog_problems", r"""WITH f AS (SELECT CAST(page_id % 200 AS VARCHAR) AS name, url, CASE page_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'science' ELSE 'gossip' END AS category, CAST(page_id % 6 AS INT) AS source_tier FROM pages), h AS (SELECT *, regexp_replace(regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), ''), ':[0-9]*$', ''), '^www\.', '') AS host, count(*) OVER (PARTITION BY lower(name)) > 1 AS n, count(*) OVER (PARTITION BY lower(url)) > 1 AS u FROM f)
    SELECT name, 'name repeats' AS problem FROM h WHERE n UNION ALL SELECT name, 'address repeats' FROM h WHERE u UNION ALL SELECT name, 'unknown category' FROM h WHERE category = 'gossip' UNION ALL SELECT name, 'unknown tier' FROM h WHERE source_tier NOT IN (1, 2, 3, 4) UNION ALL SELECT name, 'domain not allowed' FROM h WHERE host IS NULL OR NOT (host = 'org' OR ends_with(host, '.org') OR host = 'example.com' OR ends_with(host, '.example.com'))""")
def _problems(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    kind = F.when(F.col("page_id") % 3 == 0, "news").when(F.col("page_id") % 3 == 1, "science").otherwise("gossip")
    rows = p.select((F.col("page_id") % 200).cast("string").alias("name"), "url", kind.alias("category"), (F.col("page_id") % 6).cast("int").alias("source_tier"))
    return catalog_problems(rows, spark.createDataFrame([("org",), ("WWW.example.com",)], "domain string"), ["news", "science"])


# connectors


def frames(rows: DataFrame, taxonomy: str, tag: str, payload: str = "payload") -> DataFrame:
    """A row for each company of a service's frames (JSON with a list `data`); payloads without one give none."""
    items = F.from_json(F.get_json_object(payload, "$.data"), "array<struct<accn: string, cik: long, entityName: string, end: string, start: string, val: double>>")
    d = rows.select(F.explode(items).alias("i"))
    return d.select(F.lit(taxonomy).alias("taxonomy"), F.lit(tag).alias("tag"), F.col("i.cik").alias("cik"), F.col("i.entityName").alias("entity_name"), F.col("i.accn").alias("accession"), F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("i.val").alias("value"))


def series_metadata(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each series of a service's description of series (JSON with a list `seriess` or `series`)."""
    kind = "array<struct<id: string, title: string, frequency: string, units: string, seasonal_adjustment: string, notes: string>>"
    items = F.coalesce(F.from_json(F.get_json_object(payload, "$.seriess"), kind), F.from_json(F.get_json_object(payload, "$.series"), kind))
    text = lambda c, n: F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(n)
    return rows.select(F.explode(items).alias("i")).select(F.lit("FRED").alias("provider"), text("id", "series_id"), text("title", "title"), text("frequency", "frequency"), text("units", "units"), text("seasonal_adjustment", "seasonal_adjustment"), text("notes", "source_notes"))


#: Columns of the traders' report and their names here.
COT_TEXTS = {"Market_and_Exchange_Names": "market_name", "CFTC_Contract_Market_Code": "cftc_contract_market_code", "Report_Date_as_YYYY-MM-DD": "report_date"}
COT_NUMBERS = {
    "Prod_Merc_Positions_Long_ALL": "producer_merchant_long",
    "Prod_Merc_Positions_Short_ALL": "producer_merchant_short",
    "M_Money_Positions_Long_All": "managed_money_long",
    "M_Money_Positions_Short_All": "managed_money_short",
    "Swap_Positions_Long_All": "swap_dealer_long",
    "Swap__Positions_Short_All": "swap_dealer_short",
    "Open_Interest_All": "open_interest",
}


def trader_positions(rows: DataFrame, report_type: str) -> DataFrame:
    """Positions of traders by market and date: renamed, numbers without their commas, blank or missing ones null."""
    have = lambda c: F.col(f"`{c}`").cast("string") if c in rows.columns else F.lit(None).cast("string")
    texts = [F.trim(F.coalesce(have(c), F.lit(""))).alias(n) for c, n in COT_TEXTS.items()]
    numbers = [F.nullif(F.replace(have(c), F.lit(","), F.lit("")), F.lit("")).try_cast("double").alias(n) for c, n in COT_NUMBERS.items()]
    return rows.select(*texts, F.lit(report_type).alias("report_type"), *numbers)


@query("trader_positions", "SELECT c_name AS market_name, CAST(c_nationkey AS VARCHAR) AS cftc_contract_market_code, '' AS report_date, 'futures' AS report_type, CAST(c_custkey * 1000 AS DOUBLE) AS producer_merchant_long, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS producer_merchant_short, CAST(NULL AS DOUBLE) AS managed_money_long, CAST(NULL AS DOUBLE) AS managed_money_short, CAST(NULL AS DOUBLE) AS swap_dealer_long, CAST(NULL AS DOUBLE) AS swap_dealer_short, CAST(c_custkey AS DOUBLE) AS open_interest FROM customer")
def _positions(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    rows = c.select(F.concat(F.lit(" "), "c_name").alias("Market_and_Exchange_Names"), F.col("c_nationkey").alias("CFTC_Contract_Market_Code"), F.format_number(F.col("c_custkey") * 1000, 0).alias("Prod_Merc_Positions_Long_ALL"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("").alias("Prod_Merc_Positions_Short_ALL"), F.col("c_custkey").alias("Open_Interest_All"))
    return trader_positions(rows, "futures")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a news file with the columns that news must have; others follow. Missing ones are an error."""
    rows = readers.read_rows(spark, path)
    missing = [c for c in ("symbol", "headline", "url") if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows.withColumn("symbol", F.upper(F.trim("symbol")))


def symbols_of(rows: DataFrame) -> DataFrame:
    """Distinct upper-case symbols."""
    return rows.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()


def rows_of_symbol(rows: DataFrame, symbol: str) -> DataFrame:
    return rows.where(F.upper(F.trim("symbol")) == symbol.strip().upper())


@query("symbols", "SELECT DISTINCT upper(event_type) AS symbol FROM events WHERE upper(event_type) <> ''")
def _symbols(spark, sf):
    return symbols_of(spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit(" "), "event_type").alias("symbol")))


#: Parsers of what a source sends, by the source's kind: text of one document to a list of records.
ADAPTERS: dict[str, Callable[[str], list]] = {"rss": readers.parse_feed, "atom": readers.parse_feed, "sitemap": lambda text: [{"url": u} for u in re.findall(r"<loc>\s*([^<\s]+)\s*</loc>", text or "")]}


def adapter(kind: str) -> Callable[[str], list]:
    if kind.lower() not in ADAPTERS:
        raise ValueError(f"no adapter for {kind}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[kind.lower()]


def may_fetch(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """`allowed` for each url of `pages` by the rules (origin, rules: the text of robots.txt) of its origin; an origin without rules allows all.

    Rules are joined by origin and parsed once for each run of equal texts; nothing is fetched here.
    """
    origin = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0))
    joined = pages.withColumn("origin", origin).join(robots.select(F.lower("origin").alias("origin"), "rules"), "origin", "left")

    @F.pandas_udf("boolean")
    def judged(url: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, robotparser.RobotFileParser] = {}
        out = []
        for u, r in zip(url, rules, strict=True):
            if not u or not isinstance(r, str):
                out.append(bool(u))
                continue
            if r not in parsed:
                parsed[r] = robotparser.RobotFileParser()
                parsed[r].parse(r.splitlines())
            out.append(parsed[r].can_fetch(agent, u))
        return pd.Series(out)

    return joined.withColumn("allowed", judged("url", "rules")).drop("rules", "origin")


# papers


def paged_chunks(pages: list[tuple[int, str]], most: int = 1800) -> list[tuple[int, int, int, str, int]]:
    """Chunks (index, first page, last page, text, words) of whole pages joined by new lines while they stay within `most` characters."""
    out: list[tuple[int, int, int, str, int]] = []
    text, first, last = "", 0, 0
    for number, page in pages:
        page = (page or "").strip()
        longer = f"{text}\n{page}" if text else page
        if text and len(longer) > most:
            out.append((len(out), first, last, text, len(text.split())))
            text, first = page, number
        else:
            text, first = longer, first or number
        last = number
    if text:
        out.append((len(out), first, last, text, len(text.split())))
    return out


def chunk_papers(pages: DataFrame, most: int = 1800) -> DataFrame:
    """Chunks of papers given as rows (paper, page, text); a paper's pages are brought to one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = paged_chunks(list(rows.sort_values("page")[["page", "text"]].itertuples(index=False, name=None)), most)
        return pd.DataFrame([(rows["paper"].iloc[0], *m) for m in made], columns=["paper", "chunk", "first_page", "last_page", "text", "words"])

    return pages.select("paper", "page", "text").groupBy("paper").applyInPandas(run, "paper long, chunk int, first_page int, last_page int, text string, words int")


def search_chunks(chunks: DataFrame, text: str, most: int = 5) -> DataFrame:
    """The chunks that share the largest part of the query's words, at least one; ties by paper and chunk."""
    wanted = sorted(set(re.findall(r"[a-z0-9]+", text.lower())))
    if not wanted:
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    have = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)))
    return chunks.withColumn("score", have / len(wanted)).where("score > 0").orderBy(F.desc("score"), "paper", "chunk").limit(most)


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """Page numbers and texts of a PDF; needs the optional library pypdf, and says so without it."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("pypdf is needed to read PDF files") from e
    return [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]


@query("conversation_chunks")
def _chunks(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("paper"), F.col("turn").cast("int").alias("page"), "text")
    return chunk_papers(c, 400).select("paper", "chunk", "first_page", "last_page", "words")


def export_chunks(chunks: DataFrame, path: str) -> dict:
    return sinks.export(chunks, path)


# stores


def parquet_bytes(rows: list[dict]) -> bytes:
    """A few rows as one Parquet file in memory."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows), out)
    return out.getvalue()


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, each with its `record_type`; nulls are written as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


class FactorValues:
    """Values of factors as Parquet, a version at a time, under root/factor=.../version=...; versions sort as text."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, factor: str, version: str, values: DataFrame) -> str:
        path = f"{self.root}/factor={sinks.path_token(factor)}/version={sinks.path_token(version)}"
        values.write.mode("overwrite").parquet(path)
        return path

    def latest(self, factor: str) -> str | None:
        """The path of the latest version, by the file system that Spark uses; None without any."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/factor={sinks.path_token(factor)}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        found = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("version="))
        return found[-1] if found else None

    def read(self, factor: str) -> DataFrame:
        path = self.latest(factor)
        if path is None:
            raise ValueError(f"no values of {factor}")
        return self.spark.read.parquet(path)


SIGNAL_KEY = ["symbol", "ts", "horizon", "model_name", "model_version"]


def upserted_signals(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Signals by key, the new ones in place of old ones; of new ones with one key the surest, ties by signal. The caller writes them under a new path."""
    w = Window.partitionBy(*SIGNAL_KEY).orderBy(F.desc_nulls_last("confidence"), F.desc("signal"))
    chosen = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if old is None:
        return chosen
    return old.join(chosen.select(*SIGNAL_KEY), SIGNAL_KEY, "left_anti").unionByName(chosen, allowMissingColumns=True)


@query("signals_upserted", "WITH o AS (SELECT event_type AS symbol, date_trunc('day', ts) AS ts, '1d' AS horizon, 'm' AS model_name, CAST(event_id % 3 AS VARCHAR) AS model_version, round(value, 3) AS signal, round(value / 100, 5) AS confidence, event_id FROM events), a AS (SELECT * EXCLUDE (event_id) FROM o WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts, model_version ORDER BY confidence DESC, signal DESC) = 1), n AS (SELECT * EXCLUDE (event_id) FROM o WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY symbol, ts, model_version ORDER BY confidence DESC, signal DESC) = 1) SELECT * FROM n UNION ALL SELECT a.* FROM a ANTI JOIN n ON a.symbol = n.symbol AND a.ts = n.ts AND a.model_version = n.model_version")
def _signals(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = e.select("event_id", F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.lit("1d").alias("horizon"), F.lit("m").alias("model_name"), (F.col("event_id") % 3).cast("string").alias("model_version"), F.round("value", 3).alias("signal"), F.round(F.col("value") / 100, 5).alias("confidence"))
    old = upserted_signals(None, s.where("event_id % 2 = 0").drop("event_id"))
    return upserted_signals(old, s.where("event_id % 2 = 1").drop("event_id"))


def build_dataset(rows: DataFrame, specs: DataFrame, path: str, name: str, embargo: int = 0, horizon: int = 0, least: int = 1000) -> DataFrame:
    """Rows of each window's parts as Parquet under path/dataset=name, by window_id and part, and the windows' health beside them, which is returned."""
    from quarry.operators.availability import diagnosed_windows
    from quarry.operators.preparation import assign_windows

    root = f"{path.rstrip('/')}/dataset={sinks.path_token(name)}"
    assign_windows(rows, specs).write.mode("overwrite").partitionBy("window_id", "part").parquet(f"{root}/rows")
    health = diagnosed_windows(rows, specs, embargo, horizon, least)
    health.write.mode("overwrite").parquet(f"{root}/metadata")
    return rows.sparkSession.read.parquet(f"{root}/metadata")


def inspect_dataset(spark: SparkSession, path: str, name: str, window_id: int | None = None) -> DataFrame:
    """The health of a built dataset's windows, or of one; a dataset that isn't there is an error of the reader."""
    health = spark.read.parquet(f"{path.rstrip('/')}/dataset={sinks.path_token(name)}/metadata")
    return health if window_id is None else health.where(F.col("window_id") == window_id)


def save_model_dataset(rows: DataFrame, path: str, about: dict) -> dict:
    """Rows with array features as Parquet, and a JSON manifest beside them."""
    manifest = sinks.export(rows, f"{path.rstrip('/')}/rows") | {"about": about}
    rows.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/manifest")
    return manifest


def file_health(rows: DataFrame) -> DataFrame:
    """For each file that `rows` were read from: rows, share of missing cells, first and last time; and over all files as `*`.

    The share over all is that of all cells, so files weigh by their rows.
    """
    cells = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in rows.columns[1:]), F.when(F.col(f"`{rows.columns[0]}`").isNull(), 1).otherwise(0))
    ts = F.col("ts") if "ts" in rows.columns else F.lit(None).cast("timestamp_ntz")
    g = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), cells.alias("m"), ts.alias("ts"))
    g = g.rollup("file").agg(F.count("*").alias("rows"), F.sum("m").alias("m"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.grouping("file").alias("g"))
    return g.select(F.when(F.col("g") == 1, "*").otherwise(F.col("file")).alias("file"), "rows", F.round(F.coalesce(ratio(F.col("m").cast("double"), (F.col("rows") * len(rows.columns)).cast("double")), F.lit(0.0)), 6).alias("missing_ratio"), "first_ts", "last_ts")


@query("files_health", "SELECT file, rows, round(m / (rows * 6), 6) AS missing_ratio, first_ts, last_ts FROM (SELECT 'events.parquet' AS file, count(*) AS rows, sum(CAST(ts IS NULL AS INT) + CAST(value IS NULL AS INT) + CAST(event_type IS NULL AS INT) + CAST(props IS NULL AS INT)) AS m, min(ts) AS first_ts, max(ts) AS last_ts FROM events) UNION ALL SELECT '*', rows, round(m / (rows * 6), 6), first_ts, last_ts FROM (SELECT count(*) AS rows, sum(CAST(ts IS NULL AS INT) + CAST(value IS NULL AS INT) + CAST(event_type IS NULL AS INT) + CAST(props IS NULL AS INT)) AS m, min(ts) AS first_ts, max(ts) AS last_ts FROM events)")
def _files(spark, sf):
    h = file_health(spark.read.parquet(f"{sf}/events.parquet"))
    return h.withColumn("file", F.when(F.col("file") == "*", "*").otherwise("events.parquet")).groupBy("file").agg(F.sum("rows").alias("rows"), F.max("missing_ratio").alias("missing_ratio"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
