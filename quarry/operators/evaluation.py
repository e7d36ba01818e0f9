"""Evaluation of predictions, backtests, risk, drift and portfolio weights, per group in aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.market import dig, returns, series, trailing
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, HOURLY_SQL, daily_bars, hourly_bars, table

RETURNS_SQL = """, rets AS (SELECT symbol, timeframe, ts, close, volume, close / pc - 1.0 AS r FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS pc FROM bars) WHERE pc <> 0 AND close > 0),
    preds AS (SELECT symbol, ts, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS p, r AS y FROM rets), pairs AS (SELECT * FROM preds WHERE p IS NOT NULL)"""


def prediction_pairs(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, ts, p, y): the last return as the prediction of the next."""
    r = returns(bars).select("symbol", "timeframe", "ts", F.col("simple_return").alias("y"))
    return r.withColumn("p", F.lag("y").over(series())).where("p is not null")


def prediction_metrics(pairs: DataFrame, *by: str, threshold: float = 0.0, delta: float = 1.0) -> DataFrame:
    """Errors, correlation and sign agreement of predictions p with outcomes y, one aggregation for all."""
    e = F.col("p") - F.col("y")
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    acted = F.abs("p") > threshold
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(huber).alias("huber"),
        F.coalesce(ratio(F.covar_pop("p", "y"), F.stddev_pop("p") * F.stddev_pop("y")), F.lit(0.0)).alias("ic"),
        F.avg(F.when(acted, (F.signum("p") == F.signum("y")).cast("int"))).alias("hit_ratio"),
        F.avg((F.signum("p") != F.signum("y")).cast("int")).alias("directional_loss"),
    )


_METRICS = ["mse", "rmse", "mae", "huber", "ic", "hit_ratio", "directional_loss"]


@query("prediction_metrics", f"""WITH {HOURLY_SQL} {RETURNS_SQL} SELECT symbol, count(*) AS n, {dig('avg((p - y) * (p - y))', 'mse')}, {dig('sqrt(avg((p - y) * (p - y)))', 'rmse')}, {dig('avg(abs(p - y))', 'mae')},
    {dig('avg(CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END)', 'huber')}, {dig('coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0)', 'ic')},
    {dig('avg(CASE WHEN abs(p) > 0 THEN CAST(sign(p) = sign(y) AS INT) END)', 'hit_ratio')}, {dig('avg(CAST(sign(p) <> sign(y) AS INT))', 'directional_loss')} FROM pairs GROUP BY symbol""")
def _metrics(spark, sf):
    m = prediction_metrics(prediction_pairs(hourly_bars(spark, sf)), "symbol")
    return m.select("symbol", "n", *[digits(c).alias(c) for c in _METRICS])


def rank_ic(pairs: DataFrame, *by: str) -> DataFrame:
    """Correlation of ranks; ties keep the order of ts, as positions in a list would."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, "ts"))
    r = pairs.withColumns({"rp": rank("p"), "ry": rank("y")})
    return r.groupBy(*by).agg(F.coalesce(ratio(F.covar_pop("rp", "ry"), F.stddev_pop("rp") * F.stddev_pop("ry")), F.lit(0.0)).alias("rank_ic"))


@query("prediction_rank_ic", f"WITH {DAILY_SQL} {RETURNS_SQL}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY p, ts) AS rp, row_number() OVER (PARTITION BY symbol ORDER BY y, ts) AS ry FROM pairs) SELECT symbol, {dig('coalesce(covar_pop(rp, ry) / nullif(stddev_pop(rp) * stddev_pop(ry), 0), 0)', 'rank_ic')} FROM k GROUP BY symbol")
def _rank_ic(spark, sf):
    return rank_ic(prediction_pairs(daily_bars(spark, sf)), "symbol").select("symbol", digits("rank_ic").alias("rank_ic"))


def backtest(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Positions of the prediction's sign beyond a threshold, profit, summed log equity, drawdown and turnover, row by row.

    Equity compounds; its logarithm is summed, and a loss of everything (return of -1 or less) makes it null from there on.
    """
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    b = pairs.withColumn("position", F.when(F.col("p") > threshold, 1.0).when(F.col("p") < -threshold, -1.0).otherwise(0.0))
    b = b.withColumn("pnl", F.col("position") * F.col("y"))
    b = b.withColumns({"ruin": F.max((F.col("pnl") <= -1).cast("int")).over(w), "log": F.sum(F.when(F.col("pnl") > -1, F.ln(1 + F.col("pnl")))).over(w)})
    b = b.withColumn("log_equity", F.when(F.col("ruin") == 0, F.col("log")))
    change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(series()), F.lit(0.0)))
    return b.withColumns({"drawdown": 1 - F.exp(F.col("log_equity") - F.greatest(F.lit(0.0), F.max("log_equity").over(w))), "turnover": change}).drop("log")


def backtest_summary(b: DataFrame) -> DataFrame:
    """Per symbol: trades, hits, final equity, worst drawdown, turnover, Sharpe and Sortino ratios."""
    acted = F.col("position") != 0
    return b.groupBy("symbol").agg(
        F.count_if(acted).alias("trades"), F.avg(F.when(acted, (F.col("pnl") > 0).cast("int"))).alias("hit_ratio"), F.sum("pnl").alias("total_pnl"),
        F.sum("turnover").alias("turnover"), F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.max("ruin").alias("ruined"),
        F.coalesce(ratio(F.avg("pnl"), F.stddev_samp("pnl")), F.lit(0.0)).alias("sharpe"), F.coalesce(ratio(F.avg("pnl"), F.stddev_pop(F.least(F.col("pnl"), F.lit(0.0)))), F.lit(0.0)).alias("sortino"),
    )


_BT = ["hit_ratio", "total_pnl", "turnover", "max_drawdown", "sharpe", "sortino"]
BACKTEST_SQL = """, b0 AS (SELECT symbol, ts, y, CASE WHEN p > 0.05 THEN 1.0 WHEN p < -0.05 THEN -1.0 ELSE 0.0 END AS position FROM pairs), b1 AS (SELECT *, CAST(position AS DOUBLE) * y AS pnl FROM b0),
    b2 AS (SELECT *, max(CAST(pnl <= -1 AS INT)) OVER w AS ruin, sum(CASE WHEN pnl > -1 THEN ln(1 + pnl) END) OVER w AS lg, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0.0)) AS turnover FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    b3 AS (SELECT *, CASE WHEN ruin = 0 THEN lg END AS le FROM b2), b AS (SELECT *, 1 - exp(le - greatest(0.0, max(le) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))) AS drawdown FROM b3)"""


@query("backtest_summary", f"""WITH {DAILY_SQL} {RETURNS_SQL} {BACKTEST_SQL} SELECT symbol, count(*) FILTER (WHERE position <> 0) AS trades, {dig('avg(CASE WHEN position <> 0 THEN CAST(pnl > 0 AS INT) END)', 'hit_ratio')}, {dig('sum(pnl)', 'total_pnl', 7)}, {dig('sum(turnover)', 'turnover')},
    {dig('coalesce(max(drawdown), 0)', 'max_drawdown', 7)}, max(ruin) AS ruined, {dig('coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0)', 'sharpe', 7)}, {dig('coalesce(avg(pnl) / nullif(stddev_pop(least(pnl, 0.0)), 0), 0)', 'sortino', 7)} FROM b GROUP BY symbol""")
def _backtest(spark, sf):
    s = backtest_summary(backtest(prediction_pairs(daily_bars(spark, sf)), 0.05))
    return s.select("symbol", "trades", "ruined", digits("hit_ratio").alias("hit_ratio"), digits("turnover").alias("turnover"), *[digits(c, 7).alias(c) for c in ("total_pnl", "max_drawdown", "sharpe", "sortino")])


def value_at_risk(r: DataFrame, value: str, *by: str, level: float = 0.95) -> DataFrame:
    """Five definitions side by side, never mixed.

    var_interpolated: interpolated quantile of max(0, -r). var_index: the int(n * level)-th smallest loss. var_floor: the
    return at floor((1 - level) * (n - 1)). var_round: at the nearest index, halves to even. es: mean loss at or above
    var_interpolated. Each group's sorted values are one array; the groups are a symbol's history.
    """
    x = F.col(value)
    g = r.groupBy(*by).agg(F.percentile(F.greatest(F.lit(0.0), -x), F.lit(level)).alias("var_interpolated"), F.array_sort(F.collect_list(x)).alias("__x"), F.count(value).alias("n"))
    at = lambda i: F.element_at("__x", i.cast("int") + 1)
    losses = F.transform("__x", lambda v: F.greatest(F.lit(0.0), -v))
    tail = F.filter(losses, lambda v: v >= F.col("var_interpolated"))
    n = F.col("n")
    return g.select(
        *by, "n", "var_interpolated", (-at(n - F.floor(n * level))).alias("var_index"), at(F.floor((n - 1) * (1 - level))).alias("var_floor"),
        at(F.bround((n - 1) * (1 - level), 0)).alias("var_round"), (F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail)).alias("es"),
    )


@query("value_at_risk", f"""WITH {DAILY_SQL} {RETURNS_SQL}, g AS (SELECT symbol, count(r) AS n, quantile_cont(greatest(0.0, -r), 0.95) AS q, list_sort(list(r)) AS x FROM rets GROUP BY symbol)
    SELECT symbol, n, {dig('q', 'var_interpolated')}, {dig('-x[n - CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1]', 'var_index')}, {dig('x[CAST(floor((n - 1) * (1 - 0.95::DOUBLE)) AS BIGINT) + 1]', 'var_floor')}, {dig('x[CAST(round_even((n - 1) * (1 - 0.95::DOUBLE), 0) AS BIGINT) + 1]', 'var_round')},
           {dig('list_avg(list_filter(list_transform(x, lambda v: greatest(0.0, -v)), lambda v: v >= q))', 'es')} FROM g""")
def _var(spark, sf):
    v = value_at_risk(returns(daily_bars(spark, sf)), "simple_return", "symbol")
    return v.select("symbol", "n", *[digits(c).alias(c) for c in ("var_interpolated", "var_index", "var_floor", "var_round", "es")])


def ewma_volatility(r: DataFrame, value: str, decay: float = 0.94, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Root of the exponentially weighted mean of squares, newest first, started at 0: sum of (1 - decay) decay^age r^2."""
    order = Window.partitionBy(*by).orderBy(F.col("ts").desc())
    aged = r.withColumn("__age", F.row_number().over(order) - 1)
    return aged.groupBy(*by).agg(F.sqrt(F.sum((1 - decay) * F.pow(F.lit(decay), "__age") * F.col(value) * F.col(value))).alias("ewma_volatility"))


@query("ewma_volatility", f"WITH {DAILY_SQL} {RETURNS_SQL}, a AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS age FROM rets) SELECT symbol, {dig('sqrt(sum(0.06 * pow(0.94, age) * r * r))', 'ewma_volatility', 8)} FROM a GROUP BY symbol")
def _ewma(spark, sf):
    return ewma_volatility(returns(daily_bars(spark, sf)), "simple_return").select("symbol", digits("ewma_volatility", 8).alias("ewma_volatility"))


def drawdowns(bars: DataFrame) -> DataFrame:
    """Per symbol: worst and mean drawdown from the running peak and the longest run of bars below it."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumn("peak", F.max("close").over(w)).withColumn("below", F.col("close") < F.col("peak"))
    b = b.withColumn("island", F.sum((~F.col("below")).cast("int")).over(w))
    runs = b.groupBy("symbol", "island").agg(F.count_if("below").alias("run"), F.min(ratio(F.col("close"), F.col("peak")) - 1).alias("worst"), F.sum(1 - ratio(F.col("close"), F.col("peak"))).alias("total"), F.count("*").alias("n"))
    return runs.groupBy("symbol").agg(F.min("worst").alias("max_drawdown"), (F.sum("total") / F.sum("n")).alias("expected_drawdown"), F.max("run").alias("duration"))


@query("drawdowns", f"""WITH {HOURLY_SQL}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM bars), i AS (SELECT *, sum(CAST(close >= peak AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM p),
    r AS (SELECT symbol, island, count(*) FILTER (WHERE close < peak) AS run, min(close / peak - 1) AS worst, sum(1 - close / peak) AS total, count(*) AS n FROM i GROUP BY symbol, island)
    SELECT symbol, {dig('min(worst)', 'max_drawdown')}, {dig('sum(total) / sum(n)', 'expected_drawdown')}, max(run) AS duration FROM r GROUP BY symbol""")
def _drawdowns(spark, sf):
    return drawdowns(hourly_bars(spark, sf)).select("symbol", digits("max_drawdown").alias("max_drawdown"), digits("expected_drawdown").alias("expected_drawdown"), "duration")


def liquidity(r: DataFrame, volumes: DataFrame) -> DataFrame:
    """Amihud's measure: mean of |return| / volume, 0 where the volume is 0."""
    return r.join(volumes.select("symbol", "timeframe", "ts", "volume"), ["symbol", "timeframe", "ts"]).groupBy("symbol").agg(F.avg(F.coalesce(ratio(F.abs("simple_return"), F.col("volume")), F.lit(0.0))).alias("amihud"))


@query("amihud_illiquidity", f"WITH {HOURLY_SQL} {RETURNS_SQL} SELECT symbol, {dig('avg(coalesce(abs(r) / nullif(volume, 0), 0))', 'amihud')} FROM rets GROUP BY symbol")
def _amihud(spark, sf):
    b = hourly_bars(spark, sf)
    return liquidity(returns(b), b).select("symbol", digits("amihud").alias("amihud"))


def covariances(r: DataFrame, shrinkage: float = 0.2) -> DataFrame:
    """Population covariance and correlation of each two symbols over common times, a <= b; off the diagonal shrunk by `shrinkage`.

    Each time's returns are one short array (a row for each symbol), so pairs are made within rows and partly summed before
    the shuffle; symbols are a bounded universe.
    """
    at = r.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("symbol", F.col("simple_return").alias("x")))).alias("s"))
    left = at.select("s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("b")).select(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b"), F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    g = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.select("a", "b", "n", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(F.col("cov") * (1 - shrinkage)).alias("covariance"), F.coalesce(ratio("cov", F.col("sx") * F.col("sy")), F.lit(0.0)).alias("correlation"))


@query("covariance_matrix", f"WITH {HOURLY_SQL} {RETURNS_SQL} SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {dig('covar_pop(x.r, y.r) * CASE WHEN x.symbol = y.symbol THEN 1.0 ELSE 0.8 END', 'covariance', 8)}, {dig('coalesce(covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0), 0)', 'correlation', 8)} FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY x.symbol, y.symbol")
def _covariances(spark, sf):
    return covariances(returns(hourly_bars(spark, sf))).select("a", "b", "n", digits("covariance", 8).alias("covariance"), digits("correlation", 8).alias("correlation"))


def weights(stats: DataFrame, budget: float = 1.0) -> DataFrame:
    """Equal, inverse-volatility, inverse-variance and prototype maximum-Sharpe weights of (symbol, mean, volatility); all zero scores give equal weights."""
    scores = {"equal": F.lit(1.0), "inverse_volatility": ratio(F.lit(1.0), F.col("volatility")), "minimum_variance": ratio(F.lit(1.0), F.col("volatility") * F.col("volatility")), "max_sharpe": ratio(F.greatest(F.lit(0.0), F.col("mean")), F.col("volatility") * F.col("volatility"))}
    s = stats.select("symbol", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in scores.items()])
    totals = s.agg(*[F.sum(n).alias(f"t_{n}") for n in scores], F.count("*").alias("t_n"))
    joined = s.crossJoin(F.broadcast(totals))  # one row of totals
    return joined.select("symbol", *[F.when(F.col(f"t_{n}") > 0, budget * F.col(n) / F.col(f"t_{n}")).otherwise(budget / F.col("t_n")).alias(n) for n in scores])


def capped(w: DataFrame, column: str, cap: float) -> DataFrame:
    """Weights of at most `cap`; what is cut is dealt to the others by their size, until nothing exceeds it.

    That scales all below the cap by one factor, which is sought by rounds of one aggregation each; a round puts a weight
    more at the cap or is the last. Weights that cannot reach the budget under the cap all take it.
    """
    x = F.coalesce(F.col(column), F.lit(0.0))
    total, n = w.agg(F.sum(x), F.count("*")).first()
    if not n or cap * n <= (total or 0.0):
        return w.withColumn("capped", F.lit(cap))
    factor = 1.0
    while True:
        full, rest = w.agg(F.count_if(x * factor >= cap), F.sum(F.when(x * factor < cap, x))).first()
        now = (total - full * cap) / rest if rest else factor
        if now <= factor * (1 + 1e-15):
            return w.withColumn("capped", F.least(F.lit(cap), x * factor))
        factor = now


def _stats(spark, sf):
    return returns(daily_bars(spark, sf)).groupBy("symbol").agg(F.avg("log_return").alias("mean"), F.stddev_pop("log_return").alias("volatility"))


@query("portfolio_weights", f"WITH {DAILY_SQL} {RETURNS_SQL}, s AS (SELECT symbol, avg(ln(1 + r)) AS m, stddev_pop(ln(1 + r)) AS v FROM rets GROUP BY symbol), t AS (SELECT count(*) AS n, sum(1 / v) AS a, sum(1 / (v * v)) AS b, sum(greatest(0.0, m) / (v * v)) AS c FROM s) SELECT symbol, {dig('1.0 / n', 'equal')}, {dig('1 / v / a', 'inverse_volatility', 8)}, {dig('1 / (v * v) / b', 'minimum_variance', 8)}, {dig('CASE WHEN c > 0 THEN greatest(0.0, m) / (v * v) / c ELSE 1.0 / n END', 'max_sharpe', 5)} FROM s, t")
def _weights(spark, sf):
    w = weights(_stats(spark, sf))
    return w.select("symbol", digits("equal").alias("equal"), digits("inverse_volatility", 8).alias("inverse_volatility"), digits("minimum_variance", 8).alias("minimum_variance"), digits("max_sharpe", 5).alias("max_sharpe"))


@query("portfolio_capped", f"WITH {DAILY_SQL} {RETURNS_SQL}, s AS (SELECT symbol, 1 / stddev_pop(ln(1 + r)) AS v FROM rets GROUP BY symbol), t AS (SELECT symbol, v / sum(v) OVER () AS w FROM s), k AS (SELECT *, row_number() OVER (ORDER BY w DESC, symbol) - 1 AS k, coalesce(sum(w) OVER (ORDER BY w DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), f AS (SELECT min_by((1 - k * 0.0405::DOUBLE) / (1 - before), k) AS f FROM k WHERE w * (1 - k * 0.0405::DOUBLE) / (1 - before) <= 0.0405::DOUBLE) SELECT symbol, {dig('least(0.0405::DOUBLE, w * f)', 'capped', 6)} FROM k, f")
def _capped(spark, sf):
    w = weights(_stats(spark, sf)).select("symbol", "inverse_volatility")
    return capped(w, "inverse_volatility", 0.0405).select("symbol", digits("capped", 6).alias("capped"))


def drift(rows: DataFrame, columns: list[str], first: Column) -> DataFrame:
    """Mean of the later rows less that of the first, for each column."""
    g = rows.agg(*[(F.avg(F.when(~first, F.col(c))) - F.avg(F.when(first, F.col(c)))).alias(c) for c in columns])
    return g.unpivot([], columns, "column", "drift")


@query("feature_drift", f"SELECT 'value' AS \"column\", {dig('avg(value) FILTER (WHERE event_id >= 5000) - avg(value) FILTER (WHERE event_id < 5000)', 'drift', 6)} FROM events UNION ALL SELECT 'user_id', {dig('avg(user_id) FILTER (WHERE event_id >= 5000) - avg(user_id) FILTER (WHERE event_id < 5000)', 'drift', 6)} FROM events")
def _drift(spark, sf):
    return drift(table(spark, sf, "events"), ["value", "user_id"], F.col("event_id") < 5000).select("column", digits("drift", 6).alias("drift"))


def classification(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 of a binary prediction."""
    n = lambda c: F.count_if(c)
    g = rows.agg(F.count("*").alias("n"), n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = g.select("n", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"))
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


@query("classification_metrics", f"WITH j AS (SELECT toxic = 1 AS t, n_chars > 3000 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM j) SELECT n, {dig('(n - fp - fn) / n', 'accuracy')}, {dig('tp / (tp + fp)', 'precision')}, {dig('tp / (tp + fn)', 'recall')}, {dig('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM c")
def _classification(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    c = classification(j, F.col("toxic") == 1, F.col("n_chars") > 3000)
    return c.select("n", *[digits(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])
