"""Scalars of records: payloads of ticks and bars, sessions of exchanges, ratios of facts, names, tags and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import as_column as c
from quarry.functions.numeric import clamp, digits, ratio
from quarry.registry import query

#: Exchanges with their market code, time zone, and opening and closing minutes of the local day.
EXCHANGES = {
    "NYSE": ("XNYS", "America/New_York", "09:30", "16:00"),
    "NASDAQ": ("XNAS", "America/New_York", "09:30", "16:00"),
    "CME": ("XCME", "America/Chicago", "08:30", "15:15"),
    "CBOE": ("XCBO", "America/Chicago", "08:30", "15:00"),
    "LSE": ("XLON", "Europe/London", "08:00", "16:30"),
    "XETRA": ("XETR", "Europe/Berlin", "09:00", "17:30"),
    "B3": ("BVMF", "America/Sao_Paulo", "10:00", "17:00"),
    "TSE": ("XTKS", "Asia/Tokyo", "09:00", "15:00"),
    "HKEX": ("XHKG", "Asia/Hong_Kong", "09:30", "16:00"),
    "SSE": ("XSHG", "Asia/Shanghai", "09:30", "15:00"),
    "SZSE": ("XSHE", "Asia/Shanghai", "09:30", "15:00"),
}


def market_windows(spark) -> DataFrame:
    """A row for each exchange."""
    return spark.createDataFrame([(k, *v) for k, v in EXCHANGES.items()], "exchange string, mic string, zone string, opens string, closes string")


def sessions(rows: DataFrame, ts: str, exchange: str) -> DataFrame:
    """`mic`, `local_ts` and `session` (regular from opening to closing on weekdays, else closed) of UTC times; unknown exchanges have none."""
    from functools import reduce

    name = F.upper(F.trim(exchange))
    pick = lambda i: reduce(lambda a, kv: a.when(name == kv[0], kv[1][i]), list(EXCHANGES.items())[1:], F.when(name == next(iter(EXCHANGES)), next(iter(EXCHANGES.values()))[i]))
    local = F.convert_timezone(F.lit("UTC"), pick(1), F.col(ts).cast("timestamp_ntz"))
    r = rows.withColumns({"mic": pick(0), "local_ts": local})
    clock = F.date_format("local_ts", "HH:mm:ss")
    open_ = (F.weekday("local_ts") < 5) & (clock >= F.concat(pick(2), F.lit(":00"))) & (clock <= F.concat(pick(3), F.lit(":00")))
    return r.withColumn("session", F.when(F.col("mic").isNull(), None).when(open_, "regular").otherwise("closed"))


_FIXED = {"TSE": (9, "XTKS", "09:00:00", "15:00:00"), "HKEX": (8, "XHKG", "09:30:00", "16:00:00"), "SSE": (8, "XSHG", "09:30:00", "15:00:00")}


@query("market_sessions", f"WITH x(exchange, h, mic, o, z) AS (VALUES {', '.join(f'({k!r}, {v[0]}, {v[1]!r}, {v[2]!r}, {v[3]!r})' for k, v in _FIXED.items())}), l AS (SELECT event_id, exchange, mic, ts + to_hours(h) AS local_ts, o, z FROM events, x) SELECT event_id, exchange, mic, local_ts, CASE WHEN isodow(local_ts) < 6 AND strftime(local_ts, '%H:%M:%S') BETWEEN o AND z THEN 'regular' ELSE 'closed' END AS session FROM l")
def _sessions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.explode(F.array(*[F.lit(k) for k in _FIXED])).alias("exchange"))
    return sessions(e, "ts", "exchange").select("event_id", "exchange", "mic", "local_ts", "session")


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(c(a).bitwiseXOR(c(b)))


def numeric_value(x: Column | str, default: float = 0.0) -> Column:
    """A text as a number, or the default; not a number is the default too."""
    n = c(x).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(n)


def nan_to_zero(x: Column | str) -> Column:
    return F.when(F.isnan(c(x)), 0.0).otherwise(c(x))


def filing_lag_days(filed: Column | str, period_end: Column | str) -> Column:
    return F.greatest(F.lit(0), F.datediff(filed, period_end))


def corrected_correlation(r: Column, sx: Column, sy: Column, sx_total: Column, sy_total: Column, tiny: float = 1e-12) -> Column:
    """A correlation over a restricted range, widened by the deviations of the whole; between -1 and 1."""
    cut = F.greatest(F.lit(-1 + tiny), F.least(F.lit(1 - tiny), r))
    wide = lambda total, part: F.greatest(total, F.lit(tiny)) / F.greatest(part, F.lit(tiny))
    return clamp(F.tanh(F.atanh(cut) * F.sqrt(wide(sx_total, sx) * wide(sy_total, sy))), -1.0, 1.0)


def fact_ratios(facts: Column) -> dict[str, Column]:
    """Margin, leverage and liquidity of a map of facts; what is missing is 0, and so is a ratio to 0."""
    of = lambda k: F.coalesce(F.element_at(facts, F.lit(k)).cast("double"), F.lit(0.0))
    pairs = {"gross_margin": ("gross_profit", "revenue"), "debt_to_equity": ("debt", "equity"), "current_ratio": ("current_assets", "current_liabilities"), "net_margin": ("net_income", "revenue")}
    return {n: F.coalesce(ratio(of(a), of(b)), F.lit(0.0)) for n, (a, b) in pairs.items()}


def fact_similarity(a: Column, b: Column) -> Column:
    """1 less the mean distance over the facts that both maps have, at least 0; none in common gives 0."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    total = F.aggregate(F.transform(keys, lambda k: F.abs(F.element_at(a, k) - F.element_at(b, k))), F.lit(0.0), lambda x, v: x + v)
    return F.when(F.size(keys) > 0, F.greatest(F.lit(0.0), 1 - total / F.size(keys))).otherwise(0.0)


@query("facts_compared", """WITH f AS (SELECT c_custkey, CAST(c_custkey % 97 AS DOUBLE) AS revenue, CAST(c_custkey % 31 AS DOUBLE) AS gross_profit, abs(c_acctbal) / 1000 AS debt, CAST(c_custkey % 7 AS DOUBLE) AS equity FROM customer)
    SELECT c_custkey, format('{:.6e}', CASE WHEN revenue = 0 THEN 0 ELSE gross_profit / revenue END * 1.0000000000003)::DOUBLE AS gross_margin, format('{:.6e}', CASE WHEN equity = 0 THEN 0 ELSE debt / equity END * 1.0000000000003)::DOUBLE AS debt_to_equity,
           format('{:.6e}', greatest(0.0, 1 - (abs(debt - equity) + abs(revenue - 50)) / 2) * 1.0000000000003)::DOUBLE AS similarity, bit_count(xor(c_custkey, 12345)) AS bits FROM f""")
def _facts(spark, sf):
    k = F.col("c_custkey")
    facts = F.create_map(F.lit("revenue"), (k % 97).cast("double"), F.lit("gross_profit"), (k % 31).cast("double"), F.lit("debt"), F.abs("c_acctbal") / 1000, F.lit("equity"), (k % 7).cast("double"))
    r = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", facts.alias("f"))
    other = F.create_map(F.lit("debt"), (F.col("c_custkey") % 7).cast("double"), F.lit("revenue"), F.lit(50.0))
    made = fact_ratios(F.col("f"))
    return r.select("c_custkey", digits(made["gross_margin"], 6).alias("gross_margin"), digits(made["debt_to_equity"], 6).alias("debt_to_equity"), digits(fact_similarity(F.col("f"), other), 6).alias("similarity"), hamming_distance("c_custkey", F.lit(12345).cast("long")).cast("int").alias("bits"))


def payload(text: Column | str, fields: dict[str, str]) -> dict[str, Column]:
    """Fields of a JSON payload by type; blank and unreadable values are null."""
    get = lambda n: F.nullif(F.trim(F.get_json_object(c(text), f"$.{n}")), F.lit(""))
    return {n: get(n).try_cast(t) for n, t in fields.items()}


def _with_volume(f: dict[str, Column], price: Column) -> dict[str, Column]:
    made = price * f["volume"]
    return f | {"dollar_volume": F.coalesce(f["dollar_volume"], made), "dollar_volume_source": F.when(f["dollar_volume"].isNull() & made.isNotNull(), "computed").otherwise("provided")}


def tick(text: Column | str) -> dict[str, Column]:
    """A tick's typed fields; a price that is absent or 0 falls back to the last where there is one, the dollar volume to price times volume, and says which."""
    f = payload(text, {**dict.fromkeys(("price", "bid", "ask", "last", "volume", "dollar_volume"), "double"), "timestamp": "timestamp", "trade_id": "string"})
    price = F.coalesce(F.nullif(f["price"], F.lit(0.0)), f["last"], f["price"])
    return _with_volume(f | {"price": price, "trade_id": F.coalesce(f["trade_id"], F.lit(""))}, price)


def bar(text: Column | str) -> dict[str, Column]:
    """A bar's typed fields, with the dollar volume as in `tick`, from the close."""
    f = payload(text, {**dict.fromkeys(("open", "high", "low", "close", "adjusted_close", "volume", "dollar_volume"), "double"), "trade_count": "long", "timestamp": "timestamp"})
    return _with_volume(f, f["close"])


@query("ticks_normalized", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value / 2 ELSE value END AS price, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS volume, CASE WHEN event_id % 5 = 0 THEN 7.0::DOUBLE WHEN event_id % 3 = 0 THEN NULL ELSE round(CASE WHEN event_id % 4 = 0 THEN value / 2 ELSE value END * user_id, 4) END AS dollar_volume, CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN 'computed' ELSE 'provided' END AS dollar_volume_source FROM events")
def _ticks(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    text = F.to_json(F.struct(F.when(i % 4 != 0, F.col("value")).alias("price"), F.when(i % 4 == 0, F.col("value") / 2).alias("last"), F.when(i % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("volume"), F.when(i % 5 == 0, 7.0).alias("dollar_volume")))
    t = e.select("event_id", text.alias("j"))
    f = tick("j")
    return t.select("event_id", f["price"].alias("price"), f["volume"].alias("volume"), F.round(f["dollar_volume"], 4).alias("dollar_volume"), f["dollar_volume_source"].alias("dollar_volume_source"))


def merged_tags(first: Column, second: Column) -> Column:
    """Trimmed lower-case tags of both arrays, each once, in order of first occurrence; blanks go."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def provider_name(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c(name)), r"\s+", " "))


def path_token(value: Column | str) -> Column:
    """Letters, digits, - and _ as they are, anything else as _, none at the ends; nothing left is __null__."""
    plain = F.regexp_replace(F.regexp_replace(c(value).cast("string"), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "__null__").otherwise(plain)


def publication_time(text: Column | str) -> Column:
    """ISO 8601 or RFC 2822 as a UTC time; blank or unreadable text is null. Times without a zone are UTC."""
    t = F.trim(c(text))
    iso = t.try_cast("timestamp")
    mail = [F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, *", ""), " (GMT|UTC|UT|Z)$", " +0000"), "^([0-9]) ", "0$1 "), F.lit(p)) for p in ("dd MMM yyyy HH:mm:ss xx", "dd MMM yyyy HH:mm xx")]
    return F.coalesce(iso, *mail)


@query("names_and_tags", r"SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '   Wire '), '\s+', ' ', 'g')) AS provider, CASE WHEN regexp_replace(regexp_replace(c_mktsegment || ' #1', '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN '__null__' ELSE regexp_replace(regexp_replace(c_mktsegment || ' #1', '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g') END AS token, array_to_string(CASE WHEN lower(c_mktsegment) = 'building' THEN [lower(c_mktsegment), 'news'] ELSE [lower(c_mktsegment), 'news', 'building'] END, ',') AS tags FROM customer")
def _names(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet")
    tags = merged_tags(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("News"), F.lit("")), F.array(F.lit("BUILDING"), F.lit("news ")))
    return n.select("c_custkey", provider_name(F.concat(F.lit("  "), "c_name", F.lit("   Wire "))).alias("provider"), path_token(F.concat("c_mktsegment", F.lit(" #1"))).alias("token"), F.array_join(tags, ",").alias("tags"))


def detrended(rows: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """`residual` of a least-squares line through each series in order; one aggregation joined back."""
    from pyspark.sql import Window

    r = rows.withColumn("__i", (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("double"))
    line = r.groupBy(by).agg(F.coalesce(F.regr_slope(value, "__i"), F.lit(0.0)).alias("__s"), F.avg(value).alias("__y"), F.avg("__i").alias("__x"))
    return r.join(line, by).withColumn("residual", F.col(value) - (F.col("__y") + F.col("__s") * (F.col("__i") - F.col("__x")))).drop("__i", "__s", "__x", "__y")


def path_variation(rows: DataFrame, value: str, by: str, order: str, tiny: float = 1e-12) -> DataFrame:
    """Sum of |steps| over the whole change, of values and of their logarithms."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    v, ln = F.col(value), F.ln(F.greatest(F.col(value), F.lit(tiny)))
    r = rows.select(by, order, v.alias("v"), ln.alias("l"), F.abs(v - F.lag(v).over(w)).alias("dv"), F.abs(ln - F.lag(ln).over(w)).alias("dl"))
    ends = lambda x: F.abs(F.max_by(x, order) - F.min_by(x, order)) + tiny
    return r.groupBy(by).agg((F.coalesce(F.sum("dv"), F.lit(0.0)) / ends("v")).alias("variation"), (F.coalesce(F.sum("dl"), F.lit(0.0)) / ends("l")).alias("roughness"))
