"""Feature stores over bars and order books: long form (one row per feature) and wide form (one row per bar).

The two have different definitions on purpose: long features follow fixed windows of 20 and 60 bars and log returns, wide
features follow parameters, simple returns and the last price that was not null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.numeric import clamp, digits, ratio, safe_ln
from quarry.operators.market import KEYS, dig, series, trailing
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, DEPTHS_SQL, HOURLY_SQL, book_depths, book_rows, daily_bars, hourly_bars

ID = ["symbol", "asset_type", "ts", "timeframe"]
VERSION = "v1"


def price_features(bars: DataFrame) -> DataFrame:
    """Returns, momentum, reversion, drawdown, volumes and their windows. Windows of one partitioning share one sort."""
    w = series()
    b = bars.select(*ID, "close", "volume").withColumns(
        {
            "previous_close": F.lag("close").over(w),
            "close_20": F.lag("close", 20).over(w),
            "mean_close": F.avg("close").over(trailing(20)),
            "peak": F.max("close").over(trailing(60)),
            "mean_volume": F.avg("volume").over(trailing(20)),
        }
    )
    r = F.when((F.col("close") > 0) & (F.col("previous_close") > 0), F.ln(F.col("close") / F.col("previous_close")))
    b = b.select(
        *ID, "volume",
        (ratio("close", "previous_close") - 1.0).alias("returns"),
        r.alias("log_returns"),
        (ratio("close", "close_20") - 1.0).alias("momentum"),
        (ratio("mean_close", "close") - 1.0).alias("mean_reversion"),
        (ratio("close", "peak") - 1.0).alias("drawdown"),
        ratio(F.col("volume") - F.col("mean_volume"), F.col("mean_volume")).alias("volume_imbalance"),
    )
    r = F.col("log_returns")
    return b.withColumns(
        {
            "rolling_volatility": F.stddev_samp(r).over(trailing(20)),
            "volatility_60": F.stddev_samp(r).over(trailing(60)),
            "second_moment": F.avg(r * r).over(trailing(20)),
            "fourth_moment": F.avg(r * r * r * r).over(trailing(20)),
            "mean_size_20": F.avg(F.abs(r)).over(trailing(20)),
            "mean_size_60": F.avg(F.abs(r)).over(trailing(60)),
            "var_95": F.percentile(r, F.lit(0.05)).over(trailing(60)),
            "liquidity_proxy": ratio("volume", F.abs(r)),
        }
    ).withColumn("realized_volatility", F.sqrt("second_moment"))


def risk_features(prices: DataFrame) -> DataFrame:
    """Features against the mean return of all symbols at the same time. The tail mean takes rows below their own quantile."""
    market = prices.groupBy("timeframe", "ts").agg(F.avg("log_returns").alias("market"))
    w = trailing(60)
    p = prices.join(market, ["timeframe", "ts"], "left").withColumns(
        {
            "covariance": F.covar_samp("log_returns", "market").over(w),
            "market_variance": F.var_samp("market").over(w),
            # deviations of the rows that have both
            "own_deviation": F.stddev_samp(F.when(F.col("market").isNotNull(), F.col("log_returns"))).over(w),
            "market_deviation": F.stddev_samp(F.when(F.col("log_returns").isNotNull(), F.col("market"))).over(w),
            "expected_drawdown": F.avg("drawdown").over(w),
            "max_drawdown": F.min("drawdown").over(w),
            "cvar_95": F.avg(F.when(F.col("log_returns") <= F.col("var_95"), F.col("log_returns"))).over(w),
            "mean_liquidity": F.avg("liquidity_proxy").over(w),
        }
    )
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    p = p.withColumns(
        {
            "rolling_beta": ratio("covariance", "market_variance"),
            "correlation": ratio("covariance", F.col("own_deviation") * F.col("market_deviation")),
            "tail_risk": F.abs(F.col("var_95") - F.col("cvar_95")),
            "liquidity_risk": ratio(F.lit(1.0), F.col("liquidity_proxy")),
            "volatility_regime": flag(F.col("rolling_volatility") > F.col("volatility_60")),
            "trend_regime": F.when(F.col("momentum") > 0, 1.0).when(F.col("momentum") < 0, -1.0).otherwise(0.0),
            "liquidity_regime": flag(F.col("liquidity_proxy") < F.col("mean_liquidity")),
        }
    )
    return p.withColumn("correlation_regime", flag(F.abs("correlation") > 0.6))


def _gap() -> Column:
    return F.abs(F.coalesce("volatility_60", F.lit(0.0)) - F.coalesce("rolling_volatility", F.lit(0.0)))


def _group_columns(group: str) -> dict[str, Column]:
    change = F.abs(F.col("returns") - F.lag("returns").over(series()))
    none = F.lit(None).cast("double")
    return {
        "price_volume": {n: F.col(n) for n in ("returns", "log_returns", "rolling_volatility", "realized_volatility", "momentum", "mean_reversion", "drawdown", "liquidity_proxy", "volume_imbalance")},
        "multifractal": {
            "generalized_hurst_exponent": clamp(0.5 + F.coalesce(F.col("mean_size_20") - F.col("mean_size_60"), F.lit(0.0))),
            "mf_dfa_features": ratio("rolling_volatility", "volatility_60"),
            "multifractal_spectrum_width": _gap(),
            "intermittency_proxy": ratio("fourth_moment", F.col("second_moment") * F.col("second_moment")),
            "scaling_exponents": safe_ln(ratio(F.nullif("rolling_volatility", F.lit(0.0)), F.col("volatility_60"))) / math.log(20 / 60),
            "rolling_market_inefficiency_index": ratio(F.abs("momentum"), F.col("rolling_volatility")),
            "multifractal_volatility_proxy": F.abs("log_returns") * _gap(),
            "var_oriented_multifractal_features": F.abs("var_95") * F.coalesce(ratio("volatility_60", "rolling_volatility"), F.lit(1.0)),
        },
        "risk": {
            **{n: F.col(c) for n, c in (("var", "var_95"), ("cvar", "cvar_95"))},
            **{n: F.col(n) for n in ("max_drawdown", "expected_drawdown", "rolling_beta", "correlation", "covariance", "tail_risk", "liquidity_risk")},
            "concentration_risk": F.lit(1.0),
            "regime_conditional_risk": F.col("rolling_volatility") * (1.0 + F.col("volatility_regime")),
        },
        "portfolio": {
            "mean_variance_baseline": ratio("returns", F.col("rolling_volatility") * F.col("rolling_volatility")),
            "risk_parity_baseline": ratio(F.lit(1.0), F.col("rolling_volatility")),
            "hierarchical_risk_parity_optional": none,
            "max_weight_constraints": F.lit(0.10),
            "turnover_constraints": change,
            "transaction_cost_model": 0.001 * change,
            "long_only_first": F.when(F.col("returns").isNotNull(), clamp(F.col("returns"), 0.0, 0.10)).otherwise(F.lit(0.10)),
            "long_short_optional": F.when(F.col("returns").isNotNull(), clamp(F.col("returns"), -0.10, 0.10)).otherwise(F.lit(0.10)),
        },
        "regime": {
            **{n: F.col(n) for n in ("volatility_regime", "trend_regime", "correlation_regime", "liquidity_regime")},
            "multifractal_inefficiency_regime": F.when(ratio(F.abs("momentum"), F.col("rolling_volatility")) > 1.0, 1.0).otherwise(0.0),
            "hidden_state_optional": none,
        },
        "knowledge_graph": {n: F.lit(0.0) for n in ("company_entity_relation", "sector_relation", "supply_chain_relation_optional", "news_event_relation_optional", "graph_embeddings_placeholder")},
        "lob": {
            "spread": F.col("spread"), "mid_price": none, "microprice": none, "order_imbalance": F.col("imbalance"),
            "depth_imbalance": ratio(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")),
            "slope": ratio("spread", F.col("bid_depth") + F.col("ask_depth")),
            "queue_pressure": F.col("imbalance") * (F.col("bid_depth") + F.col("ask_depth")),
            "short_horizon_realized_volatility": F.stddev_samp("spread").over(trailing(5, *_book_order())),
        },
    }[group]


def _book_order() -> tuple[str, ...]:
    return ("seq",)


GROUPS = ("price_volume", "lob", "multifractal", "risk", "portfolio", "regime", "knowledge_graph")


def long_features(source: DataFrame, group: str, version: str = VERSION) -> DataFrame:
    """One row for each feature of the group that is not null: the columns once, then an unpivot, not a union of scans."""
    columns = _group_columns(group)
    keys = [*ID, *[c for c in ("seq",) if c in source.columns]]
    wide = source.select(*keys, *[c.cast("double").alias(n) for n, c in columns.items()])
    out = wide.unpivot(keys, list(columns), "feature_name", "feature_value").where("feature_value is not null")
    return out.select(*keys, F.lit(group).alias("feature_set"), F.lit(version).alias("version"), "feature_name", "feature_value", F.lit("{}").alias("values_json"), F.lit("feature_store").alias("source"))


def feature_store(bars: DataFrame, groups: tuple[str, ...] = GROUPS, version: str = VERSION) -> DataFrame:
    """The groups named, over bars, in one table. Risk and regime need the market's returns, the others do not."""
    unknown = set(groups) - set(GROUPS)
    if unknown:
        raise ValueError(f"no feature groups named {sorted(unknown)}")
    prices = price_features(bars)
    risk = risk_features(prices) if {"risk", "regime"} & set(groups) else None
    out = None
    for g in groups:
        if g == "lob":
            continue
        rows = long_features(risk if g in ("risk", "regime") else prices, g, version)
        out = rows if out is None else out.unionByName(rows)
    return out


_W20 = "(PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_W60 = "(PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_W = "(PARTITION BY symbol, timeframe ORDER BY ts)"
PRICES_SQL = f""", o AS (SELECT *, lag(close) OVER {_W} AS pc, lag(close, 20) OVER {_W} AS c20, avg(close) OVER {_W20} AS mc, max(close) OVER {_W60} AS pk, avg(volume) OVER {_W20} AS mv FROM bars),
    p0 AS (SELECT symbol, asset_type, ts, timeframe, volume, close / nullif(pc, 0) - 1.0 AS returns, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS log_returns, close / nullif(c20, 0) - 1.0 AS momentum,
                  mc / nullif(close, 0) - 1.0 AS mean_reversion, close / nullif(pk, 0) - 1.0 AS drawdown, (volume - mv) / nullif(mv, 0) AS volume_imbalance FROM o),
    p AS (SELECT *, stddev_samp(log_returns) OVER {_W20} AS rolling_volatility, sqrt(avg(log_returns * log_returns) OVER {_W20}) AS realized_volatility, volume / nullif(abs(log_returns), 0) AS liquidity_proxy,
                 stddev_samp(log_returns) OVER {_W60} AS volatility_60, avg(abs(log_returns)) OVER {_W20} AS a20, avg(abs(log_returns)) OVER {_W60} AS a60, avg(log_returns * log_returns) OVER {_W20} AS m2,
                 avg(log_returns * log_returns * log_returns * log_returns) OVER {_W20} AS m4, quantile_cont(log_returns, 0.05) OVER {_W60} AS var_95, lag(returns) OVER {_W} AS pr FROM p0)"""
RISK_SQL = f""", m AS (SELECT timeframe, ts, avg(log_returns) AS market FROM p GROUP BY timeframe, ts),
    r0 AS (SELECT p.*, market, covar_samp(log_returns, market) OVER {_W60} AS covariance, var_samp(market) OVER {_W60} AS mvar, stddev_samp(CASE WHEN market IS NOT NULL THEN log_returns END) OVER {_W60} AS sx,
                  stddev_samp(CASE WHEN log_returns IS NOT NULL THEN market END) OVER {_W60} AS sy, avg(drawdown) OVER {_W60} AS expected_drawdown, min(drawdown) OVER {_W60} AS max_drawdown,
                  avg(CASE WHEN log_returns <= var_95 THEN log_returns END) OVER {_W60} AS cvar_95, avg(liquidity_proxy) OVER {_W60} AS ml FROM p LEFT JOIN m USING (timeframe, ts)),
    r AS (SELECT *, covariance / nullif(mvar, 0) AS rolling_beta, covariance / nullif(sx * sy, 0) AS correlation, abs(var_95 - cvar_95) AS tail_risk, 1.0 / nullif(liquidity_proxy, 0) AS liquidity_risk,
                 CASE WHEN rolling_volatility > volatility_60 THEN 1.0 ELSE 0.0 END AS volatility_regime, CASE WHEN momentum > 0 THEN 1.0 WHEN momentum < 0 THEN -1.0 ELSE 0.0 END AS trend_regime,
                 CASE WHEN liquidity_proxy < ml THEN 1.0 ELSE 0.0 END AS liquidity_regime FROM r0)"""
_GAP = "abs(coalesce(volatility_60, 0) - coalesce(rolling_volatility, 0))"
_SQL_OF = {
    "price_volume": {n: n for n in ("returns", "log_returns", "rolling_volatility", "realized_volatility", "momentum", "mean_reversion", "drawdown", "liquidity_proxy", "volume_imbalance")},
    "multifractal": {
        "generalized_hurst_exponent": "greatest(0.0, least(1.0, 0.5 + coalesce(a20 - a60, 0)))", "mf_dfa_features": "rolling_volatility / nullif(volatility_60, 0)", "multifractal_spectrum_width": _GAP,
        "intermittency_proxy": "m4 / nullif(m2 * m2, 0)", "scaling_exponents": "ln(nullif(rolling_volatility, 0) / nullif(volatility_60, 0)) / ln(20.0 / 60.0)",
        "rolling_market_inefficiency_index": "abs(momentum) / nullif(rolling_volatility, 0)", "multifractal_volatility_proxy": f"abs(log_returns) * {_GAP}",
        "var_oriented_multifractal_features": "abs(var_95) * coalesce(volatility_60 / nullif(rolling_volatility, 0), 1.0)",
    },
    "risk": {
        "var": "var_95", "cvar": "cvar_95", "max_drawdown": "max_drawdown", "expected_drawdown": "expected_drawdown", "rolling_beta": "rolling_beta", "correlation": "correlation", "covariance": "covariance",
        "tail_risk": "tail_risk", "liquidity_risk": "liquidity_risk", "concentration_risk": "1.0", "regime_conditional_risk": "rolling_volatility * (1.0 + volatility_regime)",
    },
    "portfolio": {
        "mean_variance_baseline": "returns / nullif(rolling_volatility * rolling_volatility, 0)", "risk_parity_baseline": "1.0 / nullif(rolling_volatility, 0)", "max_weight_constraints": "0.10",
        "turnover_constraints": "abs(returns - pr)", "transaction_cost_model": "0.001 * abs(returns - pr)", "long_only_first": "greatest(0.0, least(0.10, returns))", "long_short_optional": "greatest(-0.10, least(0.10, returns))",
    },
    "regime": {
        "volatility_regime": "volatility_regime", "trend_regime": "trend_regime", "correlation_regime": "CASE WHEN abs(correlation) > 0.6 THEN 1.0 ELSE 0.0 END", "liquidity_regime": "liquidity_regime",
        "multifractal_inefficiency_regime": "CASE WHEN abs(momentum) / nullif(rolling_volatility, 0) > 1.0 THEN 1.0 ELSE 0.0 END",
    },
    "knowledge_graph": {n: "0.0" for n in ("company_entity_relation", "sector_relation", "supply_chain_relation_optional", "news_event_relation_optional", "graph_embeddings_placeholder")},
    "lob": {
        "spread": "spread", "order_imbalance": "imbalance", "depth_imbalance": "(bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0)", "slope": "spread / nullif(bid_depth + ask_depth, 0)",
        "queue_pressure": "imbalance * (bid_depth + ask_depth)", "short_horizon_realized_volatility": "stddev_samp(spread) OVER (PARTITION BY symbol, timeframe ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    },
}


def _long_sql(group: str) -> str:
    source = {"risk": "r", "regime": "r", "lob": "l"}.get(group, "p")
    if group == "lob":
        ctes = f"WITH {DEPTHS_SQL}, l AS (SELECT *, 'book' AS asset_type, 'tick' AS timeframe FROM depths)"
    else:
        ctes = f"WITH {HOURLY_SQL} {PRICES_SQL} {RISK_SQL if source == 'r' else ''}"
    seq = ", seq" if group == "lob" else ""
    names = _SQL_OF[group]
    wide = f"SELECT symbol, ts{seq}, " + ", ".join(f"CAST({e} AS DOUBLE) AS f{i}" for i, e in enumerate(names.values())) + f" FROM {source}"
    parts = " UNION ALL ".join(f"SELECT symbol, ts{seq}, '{group}' AS feature_set, '{n}' AS feature_name, f{i} AS v FROM wide" for i, n in enumerate(names))
    return f"{ctes}, wide AS ({wide}), long AS ({parts}) SELECT symbol, ts{seq}, feature_set, feature_name, {dig('v', 'feature_value', 7)} FROM long WHERE v IS NOT NULL"


def _register_group(group: str) -> None:
    @query(f"features_long_{group}", _long_sql(group))
    def run(spark, sf):
        if group == "lob":
            source = book_depths(book_rows(spark, sf)).withColumns({"asset_type": F.lit("book"), "timeframe": F.lit("tick")})
        else:
            source = price_features(hourly_bars(spark, sf))
            source = risk_features(source) if group in ("risk", "regime") else source
        rows = long_features(source, group)
        return rows.select("symbol", "ts", *[c for c in ("seq",) if c in rows.columns], "feature_set", "feature_name", digits("feature_value", 7).alias("feature_value"))


for _g in GROUPS:
    _register_group(_g)


@query("feature_store_counts", f"WITH {HOURLY_SQL} {PRICES_SQL} {RISK_SQL} SELECT 'returns' AS feature_name, count(returns) AS n FROM p UNION ALL SELECT 'var', count(var_95) FROM p UNION ALL SELECT 'rolling_beta', count(rolling_beta) FROM r UNION ALL SELECT 'sector_relation', count(*) FROM p")
def _store(spark, sf):
    store = feature_store(hourly_bars(spark, sf), ("price_volume", "risk", "knowledge_graph"))
    return store.where(F.col("feature_name").isin("returns", "var", "rolling_beta", "sector_relation")).groupBy("feature_name").agg(F.count("*").alias("n"))


# wide form


def with_previous_price(bars: DataFrame) -> DataFrame:
    """`previous`: the last close before the row that is not null."""
    return bars.withColumn("previous", F.last("close", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)))


def floor_quantile(x: str, q: float, n: int) -> Column:
    """The sorted value at floor(q * (count - 1)) of the last n rows, nulls left out."""
    values = F.array_sort(F.collect_list(x).over(trailing(n)))
    return F.when(F.size(values) > 0, F.element_at(values, F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1))


def wide_price_features(bars: DataFrame, window: int = 20, lag: int = 5) -> DataFrame:
    """Per bar: returns against the last known price, rolling moments, momentum over `lag` bars, drawdown and liquidity."""
    b = with_previous_price(bars.select(*ID, "close", "volume"))
    simple = ratio("close", "previous") - 1.0
    b = b.withColumns({"returns": simple, "log_returns": F.when((F.col("close") > 0) & (F.col("previous") > 0), F.ln(F.col("close") / F.col("previous")))})
    w = trailing(window)
    return b.select(
        *ID, "returns", "log_returns", F.stddev_samp("returns").over(w).alias("rolling_volatility"), F.sqrt(F.avg(F.col("log_returns") * F.col("log_returns")).over(w)).alias("realized_volatility"),
        (ratio(F.col("close"), F.lag("close", lag).over(series())) - 1.0).alias("momentum"), (ratio(F.avg("close").over(w), F.col("close")) - 1.0).alias("mean_reversion"),
        (ratio(F.col("close"), F.max("close").over(w)) - 1.0).alias("drawdown"), ratio("volume", F.abs("returns")).alias("liquidity_proxy"),
    )


def wide_risk_features(bars: DataFrame, window: int = 60) -> DataFrame:
    """Per bar: quantile loss by floor index, the mean of the window's returns at or below it, drawdowns, market beta."""
    b = with_previous_price(bars.select(*ID, "close")).withColumn("returns", ratio("close", "previous") - 1.0)
    market = b.groupBy("timeframe", "ts").agg(F.avg("returns").alias("market"))
    w = trailing(window)
    b = b.join(market, ["timeframe", "ts"], "left").withColumns(
        {
            "var": floor_quantile("returns", 0.05, window), "window_returns": F.collect_list("returns").over(w), "drawdown": ratio(F.col("close"), F.max("close").over(w)) - 1.0,
            "covariance": F.covar_samp("returns", "market").over(w), "market_variance": F.var_samp("market").over(w),
        }
    )
    tail = F.filter("window_returns", lambda x: x <= F.col("var"))
    return b.select(
        *ID, "var", F.when(F.size(tail) > 0, F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)).alias("cvar"), F.min("drawdown").over(w).alias("max_drawdown"),
        ratio("covariance", "market_variance").alias("beta"),
    )


_WIDE_SQL = f""", w0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, lag(close, 5) OVER {_W} AS c5, avg(close) OVER {_W20} AS mc,
                                max(close) OVER {_W20} AS pk FROM bars),
    w1 AS (SELECT *, close / nullif(previous, 0) - 1.0 AS ret, CASE WHEN close > 0 AND previous > 0 THEN ln(close / previous) END AS lr FROM w0)"""


def _holey(bars: DataFrame) -> DataFrame:
    """Every seventh hour's closing price is missing."""
    return bars.withColumn("close", F.when(F.hour("ts") % 7 != 3, F.col("close")))


_HOLEY_SQL = HOURLY_SQL.replace("bars AS", "full_bars AS") + ", bars AS (SELECT * REPLACE (CASE WHEN hour(ts) % 7 <> 3 THEN close END AS close) FROM full_bars)"


@query("features_wide_price", f"WITH {_HOLEY_SQL} {_WIDE_SQL} SELECT symbol, ts, {dig('ret', 'returns', 8)}, {dig('lr', 'log_returns', 8)}, {dig(f'stddev_samp(ret) OVER {_W20}', 'rolling_volatility', 8)}, {dig(f'sqrt(avg(lr * lr) OVER {_W20})', 'realized_volatility', 8)}, {dig('close / nullif(c5, 0) - 1.0', 'momentum', 8)}, {dig('mc / nullif(close, 0) - 1.0', 'mean_reversion', 8)}, {dig('close / nullif(pk, 0) - 1.0', 'drawdown', 8)}, {dig('volume / nullif(abs(ret), 0)', 'liquidity_proxy', 8)} FROM w1")
def _wide_price(spark, sf):
    f = wide_price_features(_holey(hourly_bars(spark, sf)))
    return f.select("symbol", "ts", *[digits(c, 8).alias(c) for c in f.columns if c not in ID])


@query("features_wide_risk", f"""WITH {_HOLEY_SQL} {_WIDE_SQL}, mk AS (SELECT timeframe, ts, avg(ret) AS market FROM w1 GROUP BY timeframe, ts),
    w2 AS (SELECT w1.*, market, list_sort(list(ret) FILTER (WHERE ret IS NOT NULL) OVER {_W60}) AS l, close / nullif(max(close) OVER {_W60}, 0) - 1.0 AS dd, covar_samp(ret, market) OVER {_W60} AS cv, var_samp(market) OVER {_W60} AS vm FROM w1 LEFT JOIN mk USING (timeframe, ts)),
    w3 AS (SELECT *, l[CAST(floor(0.05 * (len(l) - 1)) AS INT) + 1] AS q FROM w2)
    SELECT symbol, ts, {dig('q', 'var', 8)}, {dig('list_avg(list_filter(l, lambda x: x <= q))', 'cvar', 8)}, {dig(f'min(dd) OVER {_W60}', 'max_drawdown', 8)}, {dig('cv / nullif(vm, 0)', 'beta', 8)} FROM w3""")
def _wide_risk(spark, sf):
    f = wide_risk_features(_holey(hourly_bars(spark, sf)))
    return f.select("symbol", "ts", *[digits(c, 8).alias(c) for c in ("var", "cvar", "max_drawdown", "beta")])


def regime_flags(bars: DataFrame, window: int = 20) -> DataFrame:
    """Per bar, from simple returns: high volatility (short window above the long one), trend by momentum, deep drawdown."""
    long = max(3 * window, window + 1)
    b = with_previous_price(bars.select(*ID, "close")).withColumn("returns", ratio("close", "previous") - 1.0)
    short_dev, long_dev = F.stddev_samp("returns").over(trailing(window)), F.stddev_samp("returns").over(trailing(long))
    change = ratio(F.col("close"), F.lag("close", min(5, window)).over(series())) - 1.0
    down = ratio(F.col("close"), F.max("close").over(trailing(long))) - 1.0
    return b.select(*ID, F.when(short_dev > long_dev, 1.0).otherwise(0.0).alias("high_volatility"), F.coalesce(F.signum(change), F.lit(0.0)).alias("trend"), F.when(down <= -0.10, 1.0).otherwise(0.0).alias("deep_drawdown"))


@query("regime_flags", f"WITH {_HOLEY_SQL} {_WIDE_SQL} SELECT symbol, ts, CAST(CASE WHEN stddev_samp(ret) OVER {_W20} > stddev_samp(ret) OVER {_W60} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS high_volatility, CAST(coalesce(sign(close / nullif(c5, 0) - 1.0), 0) AS DOUBLE) AS trend, CAST(CASE WHEN close / nullif(max(close) OVER {_W60}, 0) - 1.0 <= -0.10 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS deep_drawdown FROM w1")
def _regimes(spark, sf):
    return regime_flags(_holey(hourly_bars(spark, sf))).select("symbol", "ts", "high_volatility", "trend", "deep_drawdown")


def feature_metadata(rows: DataFrame) -> DataFrame:
    """Long features as one map per (symbol, time, set, version)."""
    return rows.groupBy("symbol", "ts", "feature_set", "version").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_name", "feature_value"))))).alias("values_json"), F.count("*").alias("n"))


@query("feature_metadata", f"WITH {HOURLY_SQL} SELECT symbol, ts, 'knowledge_graph' AS feature_set, CAST(5 AS BIGINT) AS n FROM bars")
def _metadata(spark, sf):
    rows = long_features(price_features(hourly_bars(spark, sf)), "knowledge_graph")
    return feature_metadata(rows).select("symbol", "ts", "feature_set", "n")
