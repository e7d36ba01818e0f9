"""Market datasets made from the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.numeric import mid_price


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one hour for each event type; first and last are by (ts, event_id)."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    order = F.struct("ts", "event_id")
    return (
        e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit("event").alias("asset_type"), F.lit("1h").alias("timeframe"), "ts", "open", "high", "low", "close", "volume", F.lit("events").alias("source"))
    )


HOURLY_SQL = """bars AS (
    SELECT event_type AS symbol, 'event' AS asset_type, '1h' AS timeframe, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open,
           max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, 'events' AS source
    FROM events GROUP BY event_type, date_trunc('hour', ts))"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one day for each nation, from the totals of its customers' orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    order = F.struct("o_orderdate", "o_orderkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        joined.groupBy(F.col("n_name").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by("o_totalprice", order).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", order).alias("close"), F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.lit("order").alias("asset_type"), F.lit("1d").alias("timeframe"), "ts", "open", "high", "low", "close", "volume", F.lit("orders").alias("source"))
    )


DAILY_SQL = """bars AS (
    SELECT n_name AS symbol, 'order' AS asset_type, '1d' AS timeframe, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,
           max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume, 'orders' AS source
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, date_trunc('day', o_orderdate))"""


def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a two-level order book for each line item of a supplier: sizes from quantities, prices from unit price, discount and tax."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (unit * (1 - F.col("l_discount"))).alias("bid_price_1"),
        (unit * (1 + F.col("l_tax"))).alias("ask_price_1"),
        F.col("l_quantity").cast("double").alias("bid_size_1"),
        (F.lit(51.0) - F.col("l_quantity")).alias("ask_size_1"),
        (unit * (1 - F.col("l_discount")) * 0.99).alias("bid_price_2"),
        (unit * (1 + F.col("l_tax")) * 1.01).alias("ask_price_2"),
        (F.col("l_quantity") * 2.0).alias("bid_size_2"),
        ((F.lit(51.0) - F.col("l_quantity")) * 2.0).alias("ask_size_2"),
    )


BOOK_SQL = """book AS (
    SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
           l_extendedprice / l_quantity * (1 - l_discount) AS bid_price_1, l_extendedprice / l_quantity * (1 + l_tax) AS ask_price_1,
           CAST(l_quantity AS DOUBLE) AS bid_size_1, 51.0::DOUBLE - l_quantity AS ask_size_1,
           l_extendedprice / l_quantity * (1 - l_discount) * 0.99 AS bid_price_2, l_extendedprice / l_quantity * (1 + l_tax) * 1.01 AS ask_price_2,
           l_quantity * 2.0 AS bid_size_2, (51.0::DOUBLE - l_quantity) * 2.0 AS ask_size_2 FROM lineitem)"""


def book_depths(book: DataFrame) -> DataFrame:
    """Spread, imbalance and depth per row of the book."""
    bids, asks = F.col("bid_size_1") + F.col("bid_size_2"), F.col("ask_size_1") + F.col("ask_size_2")
    return book.select(
        "symbol", "ts", "seq", (F.col("ask_price_1") - F.col("bid_price_1")).alias("spread"), mid_price(F.col("bid_price_1"), F.col("ask_price_1")).alias("mid_price"),
        ((bids - asks) / F.nullif(bids + asks, F.lit(0.0))).alias("imbalance"), bids.alias("bid_depth"), asks.alias("ask_depth"),
    )


DEPTHS_SQL = BOOK_SQL + """, depths AS (
    SELECT symbol, ts, seq, ask_price_1 - bid_price_1 AS spread, (bid_price_1 + ask_price_1) / 2.0 AS mid_price, bid_size_1 + bid_size_2 AS bid_depth, ask_size_1 + ask_size_2 AS ask_depth,
           (bid_size_1 + bid_size_2 - (ask_size_1 + ask_size_2)) / nullif(bid_size_1 + bid_size_2 + (ask_size_1 + ask_size_2), 0) AS imbalance FROM book)"""


def predictions(bars: DataFrame) -> DataFrame:
    """Model outputs over bars: the last return as prediction, its sign as signal."""
    from quarry.operators.market import returns

    r = F.col("simple_return")
    return returns(bars).select(
        "symbol", "asset_type", "timeframe", "ts", F.lit("last_return").alias("model_name"), F.lit("1").alias("model_version"), F.lit("1").alias("horizon"), r.alias("prediction"),
        F.signum(r).alias("signal"), F.least(F.lit(1.0), F.abs(r)).alias("confidence"), F.lit("{}").alias("explanation_json"), F.lit("model").alias("source"),
    )
