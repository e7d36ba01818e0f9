"""Warehouse views over bars: returns, volatility, signal, backtest and risk panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from quarry.functions.numeric import OFF_TIES, digits, ratio, safe_ln
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, DEPTHS_SQL, HOURLY_SQL, book_depths, book_rows, daily_bars, hourly_bars, predictions

KEYS = ["symbol", "timeframe", "ts"]


def series(*more: str) -> WindowSpec:
    return Window.partitionBy("symbol", "timeframe").orderBy("ts", *more)


def trailing(n: int, *more: str) -> WindowSpec:
    """The row and the n - 1 before it."""
    return series(*more).rowsBetween(1 - n, 0)


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars with a symbol and a time; an empty source falls back to the provider, if there is such a column."""
    other = F.col("provider") if "provider" in bars.columns else F.lit(None).cast("string")
    return bars.where((F.col("symbol") != "") & F.col("ts").isNotNull()).withColumn("source", F.coalesce(F.nullif("source", F.lit("")), other, F.lit("")))


def deduplicated_bars(bars: DataFrame, *order: str) -> DataFrame:
    """The first bar of each (symbol, timeframe, ts), in the order of the columns named, or of the source."""
    w = Window.partitionBy(*KEYS).orderBy(*[F.col(c).asc_nulls_last() for c in order or ("source",)])
    return bars.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def returns(bars: DataFrame) -> DataFrame:
    """Simple, log, absolute and squared returns from one bar to the next; bars without a positive close or a predecessor drop out."""
    priced = valid_bars(bars).where("close is not null").withColumn("previous_close", F.lag("close").over(series()))
    kept = priced.where("previous_close is not null and previous_close <> 0 and close > 0")
    log = safe_ln(ratio("close", "previous_close"))
    return kept.select(
        "symbol", "asset_type", "timeframe", "ts", "close", "previous_close", (ratio("close", "previous_close") - 1.0).alias("simple_return"),
        log.alias("log_return"), F.abs(log).alias("absolute_return"), (log * log).alias("squared_return"),
    )


def realized_volatility(r: DataFrame) -> DataFrame:
    """Sample deviation of log returns over 20 and 60 bars."""
    return r.select("symbol", "asset_type", "timeframe", "ts", *[F.stddev_samp("log_return").over(trailing(n)).alias(f"realized_volatility_{n}") for n in (20, 60)])


def signal_panel(bars: DataFrame, preds: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """Bars with returns, volatility, model outputs and book states at the same time; what is missing is null.

    Returns and volatility come from one pass over the bars' own partitions, so that the panel needs joins with the
    predictions and the book only.
    """
    valid = valid_bars(bars)
    r = returns(bars)
    known = r.select(*KEYS, "simple_return", "log_return", "absolute_return", "squared_return", *[F.stddev_samp("log_return").over(trailing(n)).alias(f"realized_volatility_{n}") for n in (20, 60)])
    p = preds.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in ("model_name", "model_version", "horizon", "signal", "confidence")])
    out = valid.join(known, KEYS, "left").join(p, KEYS, "left")
    if book is not None:
        out = out.join(book.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in ("spread", "imbalance", "bid_depth", "ask_depth")]), KEYS, "left")
    return out


def research_panel(panel: DataFrame, universe: list[str] | None = None, start: str | None = None, end: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Rows of a panel between two times (both inclusive), of a timeframe and of symbols, upper or lower case."""
    if start:
        panel = panel.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        panel = panel.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if timeframe:
        panel = panel.where(F.col("timeframe") == timeframe)
    return panel.where(F.upper("symbol").isin([s.upper() for s in universe])) if universe else panel


def backtest_panel(backtests: DataFrame, weights: DataFrame, panel: DataFrame) -> DataFrame:
    """Backtest rows and portfolio weights, whichever there are, with the panel's prices and signals."""
    b, w, p = backtests.alias("b"), weights.alias("w"), panel.alias("p")
    keys = [*KEYS, "backtest_id"]
    both = b.join(w, keys, "full").select(
        *keys, F.coalesce("b.name", "w.portfolio_name").alias("name"), F.coalesce("b.weight", "w.weight").alias("weight"), "w.target_weight", "b.pnl", "b.cumulative_pnl", "b.drawdown"
    )
    return both.where("ts is not null").join(p.select(*KEYS, "close", "simple_return", "signal", "confidence"), KEYS, "left")


def risk_panel(risk: DataFrame, vol: DataFrame) -> DataFrame:
    """Reported risk beside realised volatility, which also stands in for a missing volatility."""
    return risk.join(vol.select(*KEYS, "realized_volatility_20", "realized_volatility_60"), KEYS, "full").withColumn("volatility", F.coalesce("volatility", "realized_volatility_20"))


_RETURNS_SQL = """, ordered AS (SELECT *, lag(close) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS previous_close FROM bars WHERE symbol <> '' AND ts IS NOT NULL AND close IS NOT NULL),
    rets AS (SELECT symbol, asset_type, timeframe, ts, close, previous_close, close / previous_close - 1.0 AS simple_return, CASE WHEN close / previous_close > 0 THEN ln(close / previous_close) END AS log_return
             FROM ordered WHERE previous_close IS NOT NULL AND previous_close <> 0 AND close > 0),
    vol AS (SELECT symbol, timeframe, ts, stddev_samp(log_return) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS realized_volatility_20,
                   stddev_samp(log_return) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS realized_volatility_60 FROM rets)"""


def dig(x: str, name: str | None = None, n: int = 9) -> str:
    """SQL of `digits`."""
    return f"CAST(printf('%.{n}e', CAST({x} AS DOUBLE) * CAST({OFF_TIES} AS DOUBLE) + 0.0) AS DOUBLE) AS {name or x}"


@query("market_bars_hourly", f"WITH {HOURLY_SQL} SELECT * FROM bars")
def _hourly(spark, sf):
    return valid_bars(hourly_bars(spark, sf))


@query("market_bars_daily", f"WITH {DAILY_SQL} SELECT * FROM bars")
def _daily(spark, sf):
    return valid_bars(daily_bars(spark, sf))


@query("returns_hourly", f"WITH {HOURLY_SQL} {_RETURNS_SQL} SELECT symbol, ts, {dig('simple_return')}, {dig('log_return')}, {dig('abs(log_return)', 'absolute_return')}, {dig('log_return * log_return', 'squared_return')} FROM rets")
def _returns(spark, sf):
    r = returns(hourly_bars(spark, sf))
    return r.select("symbol", "ts", *[digits(c).alias(c) for c in ("simple_return", "log_return", "absolute_return", "squared_return")])


@query("realized_volatility", f"WITH {DAILY_SQL} {_RETURNS_SQL} SELECT symbol, timeframe, ts, {dig('realized_volatility_20')}, {dig('realized_volatility_60')} FROM vol")
def _volatility(spark, sf):
    v = realized_volatility(returns(daily_bars(spark, sf)))
    return v.select(*KEYS, *[digits(c).alias(c) for c in ("realized_volatility_20", "realized_volatility_60")])


_PANEL_SQL = f"""WITH {DAILY_SQL} {_RETURNS_SQL}
    SELECT b.symbol, b.ts, b.timeframe, b.close, b.volume, {dig('r.simple_return', 'simple_return')}, {dig('r.log_return', 'log_return')}, {dig('v.realized_volatility_20', 'realized_volatility_20')},
           {dig('v.realized_volatility_60', 'realized_volatility_60')}, CASE WHEN r.ts IS NOT NULL THEN 'last_return' END AS model_name, CAST(sign(r.simple_return) AS DOUBLE) AS signal,
           {dig('CASE WHEN r.ts IS NOT NULL THEN least(1.0, abs(r.simple_return)) END', 'confidence')}
    FROM bars b LEFT JOIN rets r USING (symbol, timeframe, ts) LEFT JOIN vol v USING (symbol, timeframe, ts)"""


def _panel(spark, sf):
    bars = daily_bars(spark, sf)
    return signal_panel(bars, predictions(bars))


def _panel_out(p):
    return p.select("symbol", "ts", "timeframe", "close", "volume", *[digits(c).alias(c) for c in ("simple_return", "log_return", "realized_volatility_20", "realized_volatility_60")], "model_name", "signal", digits("confidence").alias("confidence"))


@query("panel_daily", _PANEL_SQL)
def _signal_panel(spark, sf):
    return _panel_out(_panel(spark, sf))


@query("research_panel", f"SELECT * FROM ({_PANEL_SQL}) WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-06-30' AND upper(symbol) IN ('NATION_1', 'NATION_2', 'NATION_14') AND timeframe = '1d'")
def _research(spark, sf):
    return _panel_out(research_panel(_panel(spark, sf), ["Nation_1", "NATION_2", "nation_14"], "1996-01-01", "1997-06-30", "1d"))


def _backtests(bars):
    """A backtest that holds the sign of the last return; weights for a third of the symbols, which also have rows of their own."""
    r = returns(bars)
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    pnl = F.signum(F.lag("simple_return").over(series())) * F.col("simple_return")
    b = r.select(*KEYS, pnl.alias("pnl")).where("pnl is not null").select(*KEYS, "pnl", F.sum("pnl").over(w).alias("cumulative_pnl"))
    return b.select(*KEYS, F.lit("bt1").alias("backtest_id"), F.lit("trend").alias("name"), F.lit(0.1).alias("weight"), "pnl", "cumulative_pnl", (F.col("cumulative_pnl") - F.max("cumulative_pnl").over(w)).alias("drawdown"))


def _weights(bars):
    return bars.where("volume >= 2").select(*KEYS, F.lit("bt1").alias("backtest_id"), F.lit("pf").alias("portfolio_name"), F.lit(0.05).alias("weight"), F.lit(0.06).alias("target_weight"))


@query("backtest_panel", f"""WITH {DAILY_SQL} {_RETURNS_SQL},
    signed AS (SELECT symbol, timeframe, ts, sign(lag(simple_return) OVER (PARTITION BY symbol, timeframe ORDER BY ts)) * simple_return AS pnl FROM rets),
    summed AS (SELECT symbol, timeframe, ts, pnl, sum(pnl) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cumulative_pnl FROM signed WHERE pnl IS NOT NULL),
    bt AS (SELECT *, cumulative_pnl - max(cumulative_pnl) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING) AS drawdown, 'trend' AS name, 0.1 AS weight FROM summed),
    w AS (SELECT symbol, timeframe, ts, 'pf' AS portfolio_name, 0.05 AS weight, 0.06 AS target_weight FROM bars WHERE volume >= 2)
    SELECT coalesce(bt.symbol, w.symbol) AS symbol, coalesce(bt.ts, w.ts) AS ts, coalesce(bt.name, w.portfolio_name) AS name, CAST(coalesce(bt.weight, w.weight) AS DOUBLE) AS weight,
           CAST(w.target_weight AS DOUBLE) AS target_weight, round(bt.pnl, 8) AS pnl, round(bt.cumulative_pnl, 6) AS cumulative_pnl, round(bt.drawdown, 6) AS drawdown, bars.close, {dig('rets.simple_return', 'simple_return')}
    FROM bt FULL JOIN w ON bt.symbol = w.symbol AND bt.ts = w.ts AND bt.timeframe = w.timeframe
    LEFT JOIN bars ON bars.symbol = coalesce(bt.symbol, w.symbol) AND bars.ts = coalesce(bt.ts, w.ts) LEFT JOIN rets ON rets.symbol = bars.symbol AND rets.ts = bars.ts""")  # fmt: skip
def _backtest_panel(spark, sf):
    bars = daily_bars(spark, sf)
    out = backtest_panel(_backtests(bars), _weights(bars), signal_panel(bars, predictions(bars)))
    return out.select("symbol", "ts", "name", "weight", "target_weight", F.round("pnl", 8).alias("pnl"), F.round("cumulative_pnl", 6).alias("cumulative_pnl"), F.round("drawdown", 6).alias("drawdown"), "close", digits("simple_return").alias("simple_return"))


@query("risk_panel", f"""WITH {DAILY_SQL} {_RETURNS_SQL}, risk AS (SELECT symbol, timeframe, ts, CASE WHEN volume > 2 THEN 0.5 END AS volatility, 'hist' AS risk_model FROM bars WHERE volume >= 2)
    SELECT symbol, ts, risk_model, {dig('coalesce(risk.volatility, vol.realized_volatility_20)', 'volatility')}, {dig('realized_volatility_60')} FROM risk FULL JOIN vol USING (symbol, timeframe, ts)""")
def _risk_panel(spark, sf):
    bars = daily_bars(spark, sf)
    risk = bars.where("volume >= 2").select(*KEYS, F.when(F.col("volume") > 2, 0.5).alias("volatility"), F.lit("hist").alias("risk_model"))
    out = risk_panel(risk, realized_volatility(returns(bars)))
    return out.select("symbol", "ts", "risk_model", digits("volatility").alias("volatility"), digits("realized_volatility_60").alias("realized_volatility_60"))


@query("book_depths", f"WITH {DEPTHS_SQL} SELECT symbol, ts, seq, {dig('spread')}, {dig('mid_price')}, {dig('imbalance')}, bid_depth, ask_depth FROM depths")
def _depths(spark, sf):
    d = book_depths(book_rows(spark, sf))
    return d.select("symbol", "ts", "seq", *[digits(c).alias(c) for c in ("spread", "mid_price", "imbalance")], "bid_depth", "ask_depth")


@query("bars_deduplicated", f"WITH {HOURLY_SQL}, doubled AS (SELECT * FROM bars UNION ALL SELECT * REPLACE (close + 1 AS close, 'zz' AS source) FROM bars) SELECT symbol, timeframe, ts, arg_min(close, source) AS close, min(source) AS source FROM doubled GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY symbol, timeframe, ts"))
def _dedup_bars(spark, sf):
    bars = hourly_bars(spark, sf)
    doubled = bars.union(bars.withColumn("close", F.col("close") + 1).withColumn("source", F.lit("zz")))
    return deduplicated_bars(doubled, "source").select(*KEYS, "close", "source")
