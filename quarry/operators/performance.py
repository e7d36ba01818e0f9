"""Losses, scores of equity curves, multifractal risk, covariance shares and weights under limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.evaluation import RETURNS_SQL, covariances, prediction_metrics, prediction_pairs, value_at_risk
from quarry.operators.market import dig, returns, series
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, HOURLY_SQL, daily_bars, hourly_bars

TINY = 1e-12


# losses


def rank_hinge(p: np.ndarray, t: np.ndarray) -> float:
    """Mean of max(0, 1 - (p_i - p_j)) over all pairs with t_i > t_j; 0 without such pairs. By merging sorted runs, never by pairs."""
    order = np.lexsort((p, t))
    p, t = p[order], t[order]
    runs = np.split(p, np.flatnonzero(np.diff(t)) + 1)  # of equal targets, each sorted
    total, pairs = 0.0, 0
    while len(runs) > 1:
        merged = []
        for i in range(0, len(runs) - 1, 2):
            low, high = runs[i], runs[i + 1]
            rest = np.concatenate([np.cumsum(low[::-1])[::-1], [0.0]])
            at = np.searchsorted(low, high - 1, side="right")
            total += float(((len(low) - at) * (1 - high) + rest[at]).sum())
            pairs += len(low) * len(high)
            merged.append(np.sort(np.concatenate([low, high]), kind="stable"))
        runs = merged + runs[len(runs) - len(runs) % 2 :]
    return total / max(pairs, 1)


def training_losses(pairs: DataFrame, weights: tuple[float, float, float, float] = (1.0, 0.5, 0.1, 0.1)) -> DataFrame:
    """Per symbol: squared, absolute, pairwise rank and directional loss of predictions p of y, and their weighted sum.

    Directions are those from one row to the next in time; one that doesn't rise falls. The rank loss takes one symbol's
    rows into a task.
    """

    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "rank": [rank_hinge(rows["p"].to_numpy(), rows["y"].to_numpy())]})

    up = lambda c: F.col(c) > F.lag(c).over(series())
    wrong = pairs.withColumns({"__w": (up("p") != up("y")).cast("int")})
    e = F.col("p") - F.col("y")
    g = wrong.groupBy("symbol").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.coalesce(F.avg("__w"), F.lit(0.0)).alias("directional"))
    r = pairs.select("symbol", "p", "y").groupBy("symbol").applyInPandas(ranked, "symbol string, rank double")
    total = sum(w * F.col(c) for w, c in zip(weights, ("mse", "mae", "rank", "directional"), strict=True))
    return g.join(r, "symbol").withColumn("total", total)


@query("training_losses", f"""WITH {DAILY_SQL} {RETURNS_SQL}, d AS (SELECT symbol, p, y, CAST((p > lag(p) OVER w) <> (y > lag(y) OVER w) AS INT) AS wrong FROM pairs WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    g AS (SELECT symbol, avg((p - y) * (p - y)) AS mse, avg(abs(p - y)) AS mae, coalesce(avg(wrong), 0) AS directional FROM d GROUP BY symbol),
    r AS (SELECT a.symbol, avg(greatest(0.0, 1 - sign(a.y - b.y) * (a.p - b.p))) AS rank FROM pairs a JOIN pairs b ON a.symbol = b.symbol AND a.ts < b.ts AND a.y <> b.y GROUP BY a.symbol)
    SELECT symbol, {dig('mse', n=7)}, {dig('mae', n=7)}, {dig('directional', n=7)}, {dig('coalesce(rank, 0)', 'rank', 7)}, {dig('mse + 0.5 * mae + 0.1 * coalesce(rank, 0) + 0.1 * directional', 'total', 7)} FROM g LEFT JOIN r USING (symbol)""")
def _losses(spark, sf):
    t = training_losses(prediction_pairs(daily_bars(spark, sf)))
    return t.select("symbol", *[digits(c, 7).alias(c) for c in ("mse", "mae", "directional", "rank", "total")])


def metrics_by_regime(pairs: DataFrame, regime: Column) -> DataFrame:
    """Errors, correlation and sign agreement for each regime; rows without one are `unknown`."""
    return prediction_metrics(pairs.withColumn("regime", F.coalesce(F.nullif(regime, F.lit("")), F.lit("unknown"))), "regime")


@query("regime_metrics", f"WITH {HOURLY_SQL} {RETURNS_SQL}, k AS (SELECT *, CASE WHEN abs(p) > 1 THEN 'volatile' WHEN abs(p) > 0.1 THEN 'calm' ELSE 'unknown' END AS regime FROM pairs) SELECT regime, count(*) AS n, {dig('avg((p - y) * (p - y))', 'mse', 7)}, {dig('avg(abs(p - y))', 'mae', 7)}, {dig('coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0)', 'ic', 6)}, {dig('avg(CASE WHEN abs(p) > 0 THEN CAST(sign(p) = sign(y) AS INT) END)', 'hit_ratio', 7)} FROM k GROUP BY regime")
def _by_regime(spark, sf):
    m = metrics_by_regime(prediction_pairs(hourly_bars(spark, sf)), F.when(F.abs("p") > 1, "volatile").when(F.abs("p") > 0.1, "calm"))
    return m.select("regime", "n", digits("mse", 7).alias("mse"), digits("mae", 7).alias("mae"), digits("ic", 6).alias("ic"), digits("hit_ratio", 7).alias("hit_ratio"))


def alpha_validation(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """Per group, over signals p and outcomes y in time: correlation, correlation of average ranks, hits, turnover, the worst
    drawdown of summed returns, and ratios of the mean and sum of the strategy's returns to their risk."""
    w = Window.partitionBy(by).orderBy("ts")
    rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0
    both = (F.col("p") != 0) & (F.col("y") != 0)
    r = rows.withColumns({"rp": rank("p"), "ry": rank("y"), "s": F.col("p") * F.col("y"), "turn": F.abs(F.col("p") - F.lag("p").over(w))})
    r = r.withColumn("total", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("down", F.col("total") - F.greatest(F.lit(0.0), F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    corr = lambda a, b: F.coalesce(ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    per = lambda risk: F.avg("s") / F.coalesce(F.nullif(risk, F.lit(0.0)), F.lit(TINY))
    return r.groupBy(by).agg(
        F.count("*").alias("observations"), corr("p", "y").alias("ic"), corr("rp", "ry").alias("rank_ic"),
        F.coalesce(F.avg(F.when(both, (F.signum("p") == F.signum("y")).cast("int"))), F.lit(0.0)).alias("hit_ratio"), F.coalesce(F.avg("turn"), F.lit(0.0)).alias("turnover"),
        F.min("down").alias("drawdown"), per(F.stddev_samp("s")).alias("sharpe"), per(F.stddev_samp(F.least(F.col("s"), F.lit(0.0)))).alias("sortino"),
        (F.sum("s") / F.coalesce(F.nullif(F.abs(F.min("down")), F.lit(0.0)), F.lit(TINY))).alias("calmar"),
    )


_ALPHA = ["ic", "rank_ic", "hit_ratio", "turnover", "drawdown", "sharpe", "sortino", "calmar"]


@query("alpha_validation", f"""WITH {DAILY_SQL} {RETURNS_SQL}, k AS (SELECT symbol, ts, p, y, p * y AS s, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry,
    abs(p - lag(p) OVER (PARTITION BY symbol ORDER BY ts)) AS turn FROM pairs), t AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS total FROM k), d AS (SELECT *, total - greatest(0.0, max(total) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS down FROM t)
    SELECT symbol, count(*) AS observations, {dig('coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0)', 'ic', 6)}, {dig('coalesce(covar_pop(rp, ry) / nullif(stddev_pop(rp) * stddev_pop(ry), 0), 0)', 'rank_ic', 6)}, {dig('coalesce(avg(CASE WHEN p <> 0 AND y <> 0 THEN CAST(sign(p) = sign(y) AS INT) END), 0)', 'hit_ratio', 6)}, {dig('coalesce(avg(turn), 0)', 'turnover', 6)},
           {dig('min(down)', 'drawdown', 6)}, {dig('avg(s) / coalesce(nullif(stddev_samp(s), 0), 1e-12)', 'sharpe', 6)}, {dig('avg(s) / coalesce(nullif(stddev_samp(least(s, 0.0)), 0), 1e-12)', 'sortino', 6)}, {dig('sum(s) / coalesce(nullif(abs(min(down)), 0), 1e-12)', 'calmar', 6)} FROM d GROUP BY symbol""")
def _alpha(spark, sf):
    a = alpha_validation(prediction_pairs(daily_bars(spark, sf)))
    return a.select("symbol", "observations", *[digits(c, 6).alias(c) for c in _ALPHA])


# equity curves


def equity_scores(curves: DataFrame, value: str = "close") -> DataFrame:
    """Per symbol: slope times fit of the logarithm in time, worst and mean drawdown, share of rows below the peak, the trend
    score weakened by all three, and ratios of returns to their risk."""
    w = series()
    v, past = F.col(value), w.rowsBetween(Window.unboundedPreceding, 0)
    c = curves.withColumns({"i": (F.row_number().over(w) - 1).cast("double"), "lv": F.ln(F.greatest(v, F.lit(TINY))), "peak": F.max(v).over(past), "r": ratio(v, F.lag(v).over(w)) - 1.0})
    c = c.withColumn("down", (F.col("peak") - v) / F.greatest(F.col("peak"), F.lit(TINY)))
    risk = lambda x: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(TINY))
    g = c.groupBy("symbol").agg(
        F.coalesce(F.regr_slope("lv", "i") * F.regr_r2("lv", "i"), F.lit(0.0)).alias("trend"), F.max("down").alias("max_drawdown"), F.avg("down").alias("expected_drawdown"),
        F.avg((v < F.col("peak")).cast("int")).alias("underwater"), (F.avg("r") / risk(F.stddev_pop("r"))).alias("sharpe"), (F.avg("r") / risk(F.stddev_pop(F.when(F.col("r").isNotNull(), F.least(F.col("r"), F.lit(0.0)))))).alias("sortino"),
        ((ratio(F.max_by(v, "i"), F.min_by(v, "i")) - 1.0) / risk(F.max("down"))).alias("calmar"),
    )
    return g.withColumn("score", F.col("trend") / (1 + F.col("max_drawdown") + F.col("expected_drawdown") + F.col("underwater")))


_EQUITY = ["trend", "max_drawdown", "expected_drawdown", "underwater", "sharpe", "sortino", "calmar", "score"]


@query("equity_scores", f"""WITH {DAILY_SQL}, c AS (SELECT symbol, close, CAST(row_number() OVER w - 1 AS DOUBLE) AS i, ln(greatest(close, 1e-12)) AS lv, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak, close / nullif(lag(close) OVER w, 0) - 1.0 AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    d AS (SELECT *, (peak - close) / greatest(peak, 1e-12) AS down FROM c), g AS (SELECT symbol, coalesce(regr_slope(lv, i) * regr_r2(lv, i), 0) AS trend, max(down) AS max_drawdown, avg(down) AS expected_drawdown, avg(CAST(close < peak AS INT)) AS underwater, avg(r) / coalesce(nullif(stddev_pop(r), 0), 1e-12) AS sharpe,
    avg(r) / coalesce(nullif(stddev_pop(least(r, 0.0)) FILTER (WHERE r IS NOT NULL), 0), 1e-12) AS sortino, (arg_max(close, i) / arg_min(close, i) - 1.0) / coalesce(nullif(max(down), 0), 1e-12) AS calmar FROM d GROUP BY symbol)
    SELECT symbol, {', '.join(dig(c, n=5) for c in _EQUITY[:-1])}, {dig('trend / (1 + max_drawdown + expected_drawdown + underwater)', 'score', 5)} FROM g""")
def _equity(spark, sf):
    return equity_scores(daily_bars(spark, sf)).select("symbol", *[digits(c, 5).alias(c) for c in _EQUITY])


# multifractal risk


def intermittency(r: DataFrame, value: str, *by: str) -> DataFrame:
    """Deviation of the logarithm of |return| over the root of their number."""
    return r.groupBy(*by).agg((F.stddev_pop(F.ln(F.abs(value) + TINY)) / F.sqrt(F.count(value))).alias("intermittency"))


def multifractal_risk(r: DataFrame, value: str, *by: str, features: DataFrame | None = None) -> DataFrame:
    """Per group of returns in time: volatility, downside volatility, value at risk, shortfall, worst drawdown and longest
    time below the peak of compounded wealth, and a score with the group's spectral features (delta_alpha, intermittency, extreme)."""
    x, past = F.col(value), Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    c = r.withColumn("lw", F.sum(F.ln(F.greatest(1 + x, F.lit(TINY)))).over(past)).withColumn("peak", F.greatest(F.lit(0.0), F.max("lw").over(past)))
    c = c.withColumns({"down": 1 - F.exp(F.col("lw") - F.col("peak")), "below": F.col("lw") < F.col("peak")}).withColumn("island", F.sum((~F.col("below")).cast("int")).over(past))
    runs = c.groupBy(*by, "island").agg(F.count_if("below").alias("n")).groupBy(*by).agg(F.max("n").alias("drawdown_duration"))
    g = c.groupBy(*by).agg(F.stddev_pop(value).alias("volatility"), F.stddev_pop(F.least(x, F.lit(0.0))).alias("downside_volatility"), F.max("down").alias("max_drawdown"))
    tails = value_at_risk(r, value, *by).select(*by, F.col("var_interpolated").alias("var_95"), F.col("es").alias("es_95"))
    out = g.join(tails, [*by]).join(runs, [*by])
    if features is not None:
        out = out.join(features, [c for c in by if c in features.columns], "left")
    part = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if features is not None and name in features.columns else F.lit(0.0)
    score = 10 * F.col("volatility") + 5 * F.col("es_95") + F.col("max_drawdown") + part("delta_alpha") + part("intermittency") + part("extreme")
    return out.withColumn("risk_score", F.greatest(F.lit(0.0), score))


def rolling_windows(r: DataFrame, size: int, step: int) -> DataFrame:
    """Rows with `window_start`, once for each window of `size` rows that holds them; windows begin every `step` rows, and only full ones count."""
    w = Window.partitionBy("symbol").orderBy("ts")
    i = r.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)), F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - size) / step))
    return i.where((F.col("n") >= size) & (lo <= hi)).withColumn("window_start", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * step))).drop("i", "n")


_RISK = ["volatility", "downside_volatility", "max_drawdown", "var_95", "es_95", "risk_score"]


def _risk_sql(rows: str, by: str, extra: str = "0.0::DOUBLE") -> str:
    return f"""w1 AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lw FROM {rows}), w2 AS (SELECT *, greatest(0.0, max(lw) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS peak FROM w1),
    w3 AS (SELECT *, sum(CAST(lw >= peak AS INT)) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM w2), runs AS (SELECT {by}, max(n) AS drawdown_duration FROM (SELECT {by}, island, count(*) FILTER (WHERE lw < peak) AS n FROM w3 GROUP BY {by}, island) GROUP BY {by}),
    q AS (SELECT {by}, stddev_pop(r) AS volatility, stddev_pop(least(r, 0.0)) AS downside_volatility, max(1 - exp(lw - peak)) AS max_drawdown, quantile_cont(greatest(0.0, -r), 0.95) AS var_95, list(greatest(0.0, -r)) AS x, {extra} AS extra FROM w3 GROUP BY {by}),
    a AS (SELECT *, list_avg(list_filter(x, lambda v: v >= var_95)) AS es_95 FROM q JOIN runs USING ({by})), z AS (SELECT *, greatest(0.0, 10 * volatility + 5 * es_95 + max_drawdown + extra) AS risk_score FROM a)"""


@query("multifractal_risk", f"WITH {DAILY_SQL} {RETURNS_SQL}, {_risk_sql('rets', 'symbol', 'stddev_pop(ln(abs(r) + 1e-12)) / sqrt(count(r))')} SELECT symbol, drawdown_duration, {', '.join(dig(c, n=6) for c in _RISK)} FROM z")
def _mf_risk(spark, sf):
    r = returns(daily_bars(spark, sf)).select("symbol", "ts", "simple_return")
    m = multifractal_risk(r, "simple_return", "symbol", features=intermittency(r, "simple_return", "symbol"))
    return m.select("symbol", "drawdown_duration", *[digits(c, 6).alias(c) for c in _RISK])


@query("multifractal_risk_rolling", f"WITH {DAILY_SQL} {RETURNS_SQL}, i AS (SELECT symbol, ts, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets), v AS (SELECT symbol, ts, r, s.s AS window_start FROM i JOIN range(0, 4000, 64) s(s) ON i.i >= s.s AND i.i < s.s + 128 AND s.s + 128 <= n), {_risk_sql('v', 'symbol, window_start')} SELECT symbol, window_start, drawdown_duration, {', '.join(dig(c, n=6) for c in _RISK)} FROM z")
def _mf_rolling(spark, sf):
    r = rolling_windows(returns(daily_bars(spark, sf)).select("symbol", "ts", "simple_return"), 128, 64)
    return multifractal_risk(r, "simple_return", "symbol", "window_start").select("symbol", "window_start", "drawdown_duration", *[digits(c, 6).alias(c) for c in _RISK])


# covariance


def variance_shares(r: DataFrame) -> DataFrame:
    """Each symbol's share of the sum of variances, a stand-in for explained variance."""
    v = r.groupBy("symbol").agg(F.var_pop("simple_return").alias("variance"))
    total = v.agg(F.sum("variance").alias("total"))
    return v.crossJoin(F.broadcast(total)).select("symbol", F.coalesce(ratio("variance", "total"), F.lit(0.0)).alias("share"))  # one row of totals


def buffered(cov: DataFrame, buffer: float = 1e-6) -> DataFrame:
    """Covariances (a, b, covariance) with `buffer` added on the diagonal."""
    return cov.withColumn("covariance", F.col("covariance") + F.when(F.col("a") == F.col("b"), buffer).otherwise(0.0))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Each weight's share of the sum of w^2 times variance; without any, 0."""
    own = cov.where("a = b").select(F.col("a").alias("symbol"), F.col("covariance").alias("variance"))
    raw = weights.join(own, "symbol", "left").withColumn("raw", F.col("weight") * F.col("weight") * F.coalesce("variance", F.lit(0.0)))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("symbol", F.coalesce(ratio("raw", "total"), F.lit(0.0)).alias("contribution"))


@query("risk_contributions", f"WITH {DAILY_SQL} {RETURNS_SQL}, v AS (SELECT symbol, var_pop(r) AS v, var_pop(r) + 0.000001 AS b, count(*) AS n FROM rets GROUP BY symbol), w AS (SELECT *, n / sum(n) OVER () AS w FROM v) SELECT symbol, {dig('v / sum(v) OVER ()', 'share', 6)}, {dig('w * w * b / sum(w * w * b) OVER ()', 'contribution', 6)} FROM w")
def _contributions(spark, sf):
    r = returns(daily_bars(spark, sf))
    n = r.groupBy("symbol").agg(F.count("*").alias("n"))
    weights = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("symbol", (F.col("n") / F.col("t")).alias("weight"))
    c = risk_contributions(weights, buffered(covariances(r)))
    return variance_shares(r).join(c, "symbol").select("symbol", digits("share", 6).alias("share"), digits("contribution", 6).alias("contribution"))


# weights under limits


def _settled(df: DataFrame, start: float, step) -> float:
    """The fixed point of a level that rises from round to round, each round one aggregation."""
    level = start
    while True:
        now = step(level)
        if now is None or now <= level * (1 + 1e-15) + 1e-18:
            return level
        level = now


def equal_residual(w: DataFrame, column: str, cap: float, budget: float = 1.0) -> DataFrame:
    """Long-only weights of sum `budget` and at most `cap`; what the cap cuts is dealt in equal parts to those with room.

    Equal parts raise all that have room by the same amount, so that amount is sought by rounds of one aggregation each.
    A cap that cannot hold the budget, or weights without a positive sum, are an error.
    """
    clean = w.withColumn("__w", F.greatest(F.lit(0.0), F.coalesce(F.col(column), F.lit(0.0))))
    total, n = clean.agg(F.sum("__w"), F.count("*")).first()
    if not total or total <= 0:
        raise ValueError("the weights have no positive sum")
    if cap * n + TINY < budget:
        raise ValueError(f"{n} weights of {cap} at most cannot reach {budget}")
    scaled = clean.withColumn("__w", F.least(F.lit(cap), F.lit(budget) * F.col("__w") / F.lit(total)))
    left, room = scaled.agg(F.lit(budget) - F.sum("__w"), F.count_if(F.col("__w") < cap)).first()
    level = 0.0
    if left > TINY and room:

        def step(level: float) -> float | None:
            used, open_ = scaled.agg(F.sum(F.when(cap - F.col("__w") <= level, cap - F.col("__w"))), F.count_if(cap - F.col("__w") > level)).first()
            return (left - (used or 0.0)) / open_ if open_ else None

        level = _settled(scaled, left / room, step)
    return scaled.withColumn("capped", F.least(F.lit(cap), F.col("__w") + F.lit(level))).select(*w.columns, "capped")


_CAPPED_SQL = """n AS (SELECT symbol, w / sum(w) OVER () AS w FROM raw), c AS (SELECT symbol, least(0.06, w) AS w FROM n), b AS (SELECT symbol, w, 0.06 - w AS room, row_number() OVER (ORDER BY 0.06 - w, symbol) - 1 AS k, count(*) OVER () AS n, sum(0.06 - w) OVER (ORDER BY 0.06 - w, symbol ROWS UNBOUNDED PRECEDING) - (0.06 - w) AS used, 1.0 - sum(w) OVER () AS lost FROM c),
    lv AS (SELECT max(CASE WHEN lost > 0 THEN (lost - used) / (n - k) ELSE 0 END) AS level FROM b)"""


@query("portfolio_equal_residual", f"WITH {DAILY_SQL}, raw AS (SELECT symbol, 1.0::DOUBLE / (1 + CAST(substring(symbol, 8) AS INT) % 7) AS w FROM bars GROUP BY symbol), {_CAPPED_SQL} SELECT symbol, {dig('least(0.06, w + level)', 'capped', 7)} FROM b, lv")
def _equal(spark, sf):
    w = daily_bars(spark, sf).groupBy("symbol").agg((F.lit(1.0) / (1 + F.substring("symbol", 8, 9).cast("int") % 7)).alias("w"))
    return equal_residual(w, "w", 0.06).select("symbol", digits("capped", 7).alias("capped"))


def exposures(weights: DataFrame, groups: DataFrame, limit: float) -> DataFrame:
    """Sums of weights by group (a symbol without one stands alone) and whether they keep the limit."""
    g = weights.join(groups.select("symbol", "group"), "symbol", "left").withColumn("group", F.coalesce("group", F.concat(F.lit("single:"), F.col("symbol"))))
    return g.groupBy("group").agg(F.sum("weight").alias("exposure")).withColumn("kept", F.col("exposure") <= limit + TINY)


@query("portfolio_exposures", f"WITH {DAILY_SQL}, w AS (SELECT symbol, count(*) / sum(count(*)) OVER () AS weight FROM bars GROUP BY symbol), g AS (SELECT 'NATION_' || n_nationkey AS symbol, 'region:' || n_regionkey AS grp FROM nation WHERE n_nationkey < 20) SELECT coalesce(grp, 'single:' || symbol) AS \"group\", {dig('sum(weight)', 'exposure', 7)}, sum(weight) <= 0.2 AS kept FROM w LEFT JOIN g USING (symbol) GROUP BY 1")
def _exposures(spark, sf):
    from quarry.sources.market import table

    b = daily_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    w = b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("t")))).select("symbol", (F.col("n") / F.col("t")).alias("weight"))
    g = table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("symbol"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("group"))
    return exposures(w, g, 0.2).select("group", digits("exposure", 7).alias("exposure"), "kept")


def event_alphas(events: DataFrame, reactions: dict[str, float], least_reliability: float = 0.6) -> DataFrame:
    """Testable positions from events (event_id, event_type, polarity, confidence, reliability, sector): reliable bad news
    without a rising sector go short, good news without a falling one go long; the confidence is the mean of three."""
    reaction = F.coalesce(F.lit(reactions.get("default", 0.0)) if not reactions else F.element_at(F.create_map(*[x for k, v in reactions.items() for x in (F.lit(k), F.lit(float(v)))]), F.coalesce("sector", F.lit("unknown"))), F.lit(float(reactions.get("default", 0.0))))
    e = events.withColumn("__r", reaction).where(F.col("reliability") >= least_reliability)
    direction = F.when((F.col("polarity") == "negative") & (F.col("__r") <= 0), "short").when((F.col("polarity") == "positive") & (F.col("__r") >= 0), "long")
    e = e.withColumn("direction", direction).where("direction is not null")
    mean = (F.coalesce("confidence", F.lit(0.0)) + F.col("reliability") + F.least(F.abs("__r"), F.lit(1.0))) / 3
    name = F.concat(F.lit("alpha_"), F.substring(F.sha1(F.concat_ws(":", F.col("event_id").cast("string"), "direction", "event_type").cast("binary")), 1, 12))
    return e.select("event_id", name.alias("candidate_id"), "direction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("confidence"))


@query("event_alphas", f"WITH e AS (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS polarity, value / 1000 AS confidence, (event_id % 10) / 10.0 AS reliability, CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN -0.25 ELSE 0.0 END AS r FROM events), d AS (SELECT *, CASE WHEN polarity = 'negative' AND r <= 0 THEN 'short' WHEN polarity = 'positive' AND r >= 0 THEN 'long' END AS direction FROM e WHERE reliability >= 0.6) SELECT event_id, 'alpha_' || substring(sha1(event_id || ':' || direction || ':' || event_type), 1, 12) AS candidate_id, direction, {dig('greatest(0.0, least(1.0, (confidence + reliability + least(abs(r), 1.0)) / 3))', 'confidence', 6)} FROM d WHERE direction IS NOT NULL")
def _event_alphas(spark, sf):
    from quarry.sources.market import table

    p = F.when(F.col("event_id") % 3 == 0, "negative").when(F.col("event_id") % 3 == 1, "positive").otherwise("neutral")
    e = table(spark, sf, "events").select("event_id", "event_type", p.alias("polarity"), (F.col("value") / 1000).alias("confidence"), (F.col("event_id") % 10 / 10.0).alias("reliability"), F.col("event_type").alias("sector"))
    return event_alphas(e, {"click": 0.5, "view": -0.25}).select("event_id", "candidate_id", "direction", digits("confidence", 6).alias("confidence"))


#: Positions that weaken each kind of risk.
HEDGES = {
    "currency_risk": ["currency_forward", "currency_hedged_etf"],
    "commodity_risk": ["commodity_future", "sector_pair_trade"],
    "market_risk": ["index_put_spread", "beta_reduction"],
    "liquidity_risk": ["position_size_reduction", "staggered_execution"],
    "legal_risk": ["reduce_single_name_exposure", "sector_neutral_pair"],
    "regulatory_risk": ["reduce_single_name_exposure", "policy_event_hedge"],
    "sentiment_risk": ["options_collar", "news_event_stop"],
}


def explained_portfolio(signals: DataFrame, positions: DataFrame, limit: int = 5) -> DataFrame:
    """The `limit` strongest risk signals (entity, risk_type, score) with the position (entity, asset, market_value) they bear on and hedges; ties by entity and kind."""
    hedges = F.create_map(*[x for k, v in HEDGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    top = signals.orderBy(F.desc("score"), "entity", "risk_type").limit(limit)
    joined = top.join(positions, "entity", "left")
    return joined.select("entity", "risk_type", "score", F.coalesce("asset", F.concat(F.lit("entity:"), F.col("entity").cast("string"))).alias("asset"), "market_value", F.coalesce(F.element_at(hedges, F.col("risk_type")), F.array(F.lit("position_size_reduction"))).alias("hedges"))


@query("portfolio_explained", f"WITH s AS (SELECT o_custkey AS entity, CASE o_custkey % 4 WHEN 0 THEN 'market_risk' WHEN 1 THEN 'legal_risk' WHEN 2 THEN 'currency_risk' ELSE 'other_risk' END AS risk_type, sum(o_totalprice) AS score FROM orders GROUP BY 1, 2 ORDER BY score DESC, entity LIMIT 5), h(risk_type, hedges) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in HEDGES.items())}) SELECT entity, risk_type, {dig('score', n=7)}, coalesce(c_name, 'entity:' || entity) AS asset, c_acctbal AS market_value, coalesce(hedges, ['position_size_reduction']) AS hedges FROM s LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = entity LEFT JOIN h USING (risk_type)")
def _explained(spark, sf):
    from quarry.sources.market import table

    kind = F.when(F.col("o_custkey") % 4 == 0, "market_risk").when(F.col("o_custkey") % 4 == 1, "legal_risk").when(F.col("o_custkey") % 4 == 2, "currency_risk").otherwise("other_risk")
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), kind.alias("risk_type")).agg(F.sum("o_totalprice").alias("score"))
    p = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("asset"), F.col("c_acctbal").alias("market_value"))
    return explained_portfolio(s, p).withColumn("score", digits("score", 7))
