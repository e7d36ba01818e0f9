"""Regimes of series, books and graphs: entropy, liquidity, density, shifts, rules over features and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.evaluation import RETURNS_SQL
from quarry.operators.market import dig, returns, series, trailing
from quarry.registry import query
from quarry.sources.market import BOOK_SQL, DAILY_SQL, HOURLY_SQL, book_depths, book_rows, daily_bars, hourly_bars, table


def histogram_entropy(values: Column, bins: int) -> Column:
    """Entropy in bits of an array's histogram of equal bins from its least to its largest; one value only gives 0."""
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)
    place = lambda v: F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins).cast("int"))
    share = lambda k: F.size(F.filter(values, lambda v: place(v) == k)) / n
    term = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return F.when(low < high, sum((term(share(k)) for k in range(1, bins)), term(share(0)))).otherwise(0.0)


def entropy_regime(rows: DataFrame, value: str, window: int = 20, bins: int = 4) -> DataFrame:
    """`entropy` of the trailing window and `regime`: complex above 1, else simple."""
    held = rows.withColumn("__x", F.collect_list(value).over(trailing(window)))
    return held.withColumn("entropy", histogram_entropy(F.col("__x"), bins)).withColumn("regime", F.when(F.col("entropy") > 1, "complex").otherwise("simple")).drop("__x")


_BIN = "least(3, CAST(floor((v - list_min(x)) / (list_max(x) - list_min(x)) * 4) AS INT))"
_TERM = "CASE WHEN len(list_filter(x, lambda v: {b} = {k})) > 0 THEN -(len(list_filter(x, lambda v: {b} = {k})) / len(x)) * log2(len(list_filter(x, lambda v: {b} = {k})) / len(x)) ELSE 0 END"


@query("regime_entropy", f"WITH {DAILY_SQL}, h AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM bars), e AS (SELECT symbol, ts, CASE WHEN list_min(x) < list_max(x) THEN {' + '.join(_TERM.format(b=_BIN, k=k) for k in range(4))} ELSE 0 END AS entropy FROM h) SELECT symbol, ts, round(entropy, 5) AS entropy, CASE WHEN entropy > 1.0000001 THEN 'complex' ELSE 'simple' END AS regime FROM e")
def _entropy(spark, sf):
    e = entropy_regime(daily_bars(spark, sf), "close")
    return e.select("symbol", "ts", F.round("entropy", 5).alias("entropy"), F.when(F.col("entropy") > 1.0000001, "complex").otherwise("simple").alias("regime"))


def liquidity_regime(book: DataFrame, limit: float = 0.01) -> DataFrame:
    """Mean spread per symbol and whether it is wide; rows without a spread count as 0."""
    g = book.groupBy("symbol").agg(F.avg(F.coalesce("spread", F.lit(0.0))).alias("average_spread"))
    return g.withColumn("regime", F.when(F.col("average_spread") > limit, "wide_spread").otherwise("normal_spread"))


@query("regime_liquidity", f"WITH {BOOK_SQL} SELECT symbol, {dig('avg(ask_price_1 - bid_price_1)', 'average_spread', 7)}, CASE WHEN avg(ask_price_1 - bid_price_1) > 130 THEN 'wide_spread' ELSE 'normal_spread' END AS regime FROM book GROUP BY symbol")
def _liquidity(spark, sf):
    return liquidity_regime(book_depths(book_rows(spark, sf)), 130).select("symbol", digits("average_spread", 7).alias("average_spread"), "regime")


def graph_densities(edges: DataFrame, at: str) -> DataFrame:
    """Per snapshot of directed edges (src, dst): nodes, edges and their share of all possible edges."""
    nodes = edges.select(at, F.col("src").alias("node")).union(edges.select(at, "dst")).groupBy(at).agg(F.count_distinct("node").alias("nodes"))
    n = edges.select(at, "src", "dst").distinct().groupBy(at).agg(F.count("*").alias("edges"))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return n.join(nodes, at).select(at, "nodes", "edges", F.coalesce(ratio(F.col("edges").cast("double"), possible.cast("double")), F.lit(0.0)).alias("density"))


def density_regime(densities: DataFrame, at: str, dense: float = 0.25) -> DataFrame:
    """The latest snapshot's density and whether the graph is dense; without a snapshot no row."""
    return densities.orderBy(F.desc(at)).limit(1).withColumn("regime", F.when(F.col("density") >= dense, "dense_graph").otherwise("sparse_graph"))


def density_changes(densities: DataFrame, by: str, at: str, threshold: float) -> DataFrame:
    """Snapshots whose density differs from the one before by `threshold` or more."""
    d = densities.withColumn("change", F.col("density") - F.lag("density").over(Window.partitionBy(by).orderBy(at)))
    return d.where(F.abs("change") >= threshold)


_TRADES = "t AS (SELECT DISTINCT year(o_orderdate) AS year, c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def _trades(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("year", "src", "dst").distinct()


@query("regime_graph_density", f"WITH {_TRADES}, n AS (SELECT year, count(DISTINCT node) AS nodes FROM (SELECT year, src AS node FROM t UNION ALL SELECT year, dst FROM t) GROUP BY year), d AS (SELECT year, nodes, count(*) AS edges, count(*)::DOUBLE / nullif(nodes * (nodes - 1), 0) AS density FROM t JOIN n USING (year) GROUP BY year, nodes) SELECT year, nodes, edges, {dig('density', n=7)}, CASE WHEN density >= 0.25 THEN 'dense_graph' ELSE 'sparse_graph' END AS regime FROM d ORDER BY year DESC LIMIT 1")
def _density(spark, sf):
    return density_regime(graph_densities(_trades(spark, sf), "year"), "year").withColumn("density", digits("density", 7))


@query("graph_density_changes", f"WITH e AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS day, user_id % 50 AS src, (user_id * 7 + event_id) % 50 AS dst FROM events), n AS (SELECT event_type, day, count(DISTINCT node) AS nodes FROM (SELECT event_type, day, src AS node FROM e UNION ALL SELECT event_type, day, dst FROM e) GROUP BY ALL), d AS (SELECT event_type, day, coalesce(count(*)::DOUBLE / nullif(nodes * (nodes - 1), 0), 0) AS density FROM e JOIN n USING (event_type, day) GROUP BY event_type, day, nodes), c AS (SELECT *, density - lag(density) OVER (PARTITION BY event_type ORDER BY day) AS change FROM d) SELECT event_type, day, {dig('density', n=7)}, {dig('change', n=5)} FROM c WHERE abs(change) >= 0.001")
def _changes(spark, sf):
    e = table(spark, sf, "events").select(F.struct("event_type", F.date_trunc("day", "ts").alias("day")).alias("at"), (F.col("user_id") % 50).alias("src"), ((F.col("user_id") * 7 + F.col("event_id")) % 50).alias("dst"))
    d = graph_densities(e, "at").select("at.event_type", "at.day", "density")
    return density_changes(d, "event_type", "day", 0.001).select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), digits("density", 7).alias("density"), digits("change", 5).alias("change"))


def mean_shift(rows: DataFrame) -> DataFrame:
    """The middle of each series as its change point, a stand-in without a library: its place and the means before and from it."""
    w = Window.partitionBy("symbol")
    r = rows.withColumns({"i": F.row_number().over(series()) - 1, "n": F.count("*").over(w)})
    before = F.col("i") < F.floor(F.col("n") / 2)
    return r.groupBy("symbol").agg(F.floor(F.max("n") / 2).cast("long").alias("change_point"), F.avg(F.when(before, F.col("close"))).alias("mean_before"), F.avg(F.when(~before, F.col("close"))).alias("mean_after"))


@query("regime_mean_shift", f"WITH {HOURLY_SQL}, r AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, max(n) // 2 AS change_point, {dig('avg(close) FILTER (WHERE i < n // 2)', 'mean_before', 7)}, {dig('avg(close) FILTER (WHERE i >= n // 2)', 'mean_after', 7)} FROM r GROUP BY symbol")
def _shift(spark, sf):
    return mean_shift(hourly_bars(spark, sf)).select("symbol", "change_point", digits("mean_before", 7).alias("mean_before"), digits("mean_after", 7).alias("mean_after"))


#: The states, in the order in which the first of equals wins.
STATES = ["low_volatility", "high_volatility", "crisis", "recovery", "liquidity_shock", "risk_on", "risk_off", "trend", "mean_reversion"]


def rule_regimes(features: DataFrame) -> DataFrame:
    """Probabilities of nine states from volatility, liquidity, return_value, kg_risk, trend_strength and multifractal_stress,
    the largest, and whether it or a rise of kg_risk by more than 0.2 (kg_risk_change) asks for a new look at risk."""
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in features.columns else F.lit(d)
    vol, liq, ret, kg, trend, stress = get("volatility", 0.0), get("liquidity", 1.0), get("return_value", 0.0), get("kg_risk", 0.0), get("trend_strength", 0.0), get("multifractal_stress", 0.0)
    raw = dict(zip(STATES, [0.35 - vol, vol + stress / 2, vol + kg - liq, ret + liq - kg, 1 - liq, ret + liq - vol, kg + vol - ret, F.abs(trend), vol - F.abs(trend)], strict=True))
    cut = {n: F.greatest(F.lit(0.0), c) for n, c in raw.items()}
    f = features.withColumns({f"__{n}": c for n, c in cut.items()})
    total = sum((F.col(f"__{n}") for n in STATES[1:]), F.col(f"__{STATES[0]}"))
    best = F.array_sort(F.array(*[F.struct((-F.col(f"__{n}")).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(STATES)]))[0]
    out = f.withColumn("regime", F.when(total > 0, best["name"]).otherwise(STATES[0]))
    out = out.withColumns({f"p_{n}": F.when(total > 0, F.col(f"__{n}") / total).otherwise(1.0 if n == STATES[0] else 0.0) for n in STATES})
    asks = F.col("regime").isin("high_volatility", "crisis", "liquidity_shock", "risk_off") | (get("kg_risk_change", 0.0) > 0.2)
    return out.withColumn("recompute_risk", asks).drop(*[f"__{n}" for n in STATES])


_RULES = ["0.35 - v", "v", "v + k - l", "m + l - k", "1 - l", "m + l - v", "k + v - m", "abs(t)", "v - abs(t)"]


@query("regime_rules", f"WITH {DAILY_SQL} {RETURNS_SQL}, f AS (SELECT symbol, stddev_pop(ln(1 + r)) AS v, avg(r) AS m, 1 / (1 + avg(volume)) AS l, avg(CAST(r < -0.5 AS INT)) AS k, avg(ln(1 + r)) * 10 AS t FROM rets GROUP BY symbol), s AS (SELECT symbol, {', '.join(f'greatest(0.0, {e}) AS {n}' for n, e in zip(STATES, _RULES, strict=True))} FROM f) SELECT symbol, {', '.join(dig(f'{n} / ({" + ".join(STATES)})', f'p_{n}', 6) for n in STATES)}, list_extract({STATES}, list_position([{', '.join(STATES)}], greatest({', '.join(STATES)}))) AS regime, list_extract({STATES}, list_position([{', '.join(STATES)}], greatest({', '.join(STATES)}))) IN ('high_volatility', 'crisis', 'liquidity_shock', 'risk_off') AS recompute_risk FROM s")
def _rules(spark, sf):
    b = daily_bars(spark, sf)
    r = returns(b).join(b.select("symbol", "ts", "volume"), ["symbol", "ts"])
    f = r.groupBy("symbol").agg(F.stddev_pop("log_return").alias("volatility"), F.avg("simple_return").alias("return_value"), (1 / (1 + F.avg("volume"))).alias("liquidity"), F.avg((F.col("simple_return") < -0.5).cast("int")).alias("kg_risk"), (F.avg("log_return") * 10).alias("trend_strength"))
    return rule_regimes(f).select("symbol", *[digits(f"p_{n}", 6).alias(f"p_{n}") for n in STATES], "regime", "recompute_risk")


#: Limits of the spectral regimes.
STRESS_DRAWDOWN, STRESS_LIQUIDITY, TREND_HURST, REVERSION_HURST, WIDE_SPECTRUM, HIGH_VOLATILITY = -0.15, 0.85, 0.58, 0.42, 0.45, 0.025


def spectral_regimes(rows: DataFrame, window: int = 20) -> DataFrame:
    """A regime for each row of (symbol, timeframe, ts, hurst_h2, delta_alpha, realized_volatility, drawdown, liquidity_proxy).

    Stress by drawdown or liquidity, turbulence by a spectrum or volatility above a floor and the value at three quarters of
    the sorted trailing window, then trend and mean reversion by the Hurst exponent, else calm. Missing features are neutral.
    """
    neutral = {"hurst_h2": 0.5, "delta_alpha": 0.0, "realized_volatility": 0.0, "drawdown": 0.0, "liquidity_proxy": 0.0}
    r = rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d) for c, d in neutral.items()})
    high = lambda c, floor: F.greatest(F.lit(floor), F.get(F.array_sort(F.collect_list(c).over(trailing(window))), F.least(F.count(c).over(trailing(window)) - 1, F.floor(F.count(c).over(trailing(window)) * 0.75)).cast("int")))
    r = r.withColumns({"__a": high("delta_alpha", WIDE_SPECTRUM), "__v": high("realized_volatility", HIGH_VOLATILITY)})
    regime = (
        F.when((F.col("drawdown") <= STRESS_DRAWDOWN) | (F.col("liquidity_proxy") >= STRESS_LIQUIDITY), "crash_liquidity_stress_regime")
        .when((F.col("delta_alpha") >= F.col("__a")) | (F.col("realized_volatility") >= F.col("__v")), "turbulent_multifractal_regime")
        .when(F.col("hurst_h2") >= TREND_HURST, "persistent_trend_regime").when(F.col("hurst_h2") <= REVERSION_HURST, "anti_persistent_mean_reversion_regime").otherwise("calm_efficient_regime")
    )
    return r.withColumn("regime", regime).drop("__a", "__v")


def transitions(labelled: DataFrame) -> DataFrame:
    """How often each regime follows each, per symbol."""
    return labelled.withColumn("before", F.lag("regime").over(series())).where("before is not null").groupBy("symbol", "before", "regime").agg(F.count("*").alias("n"))


@query("regime_spectral", f"""WITH {HOURLY_SQL}, f AS (SELECT symbol, ts, (close % 10) / 10 AS h, (open % 10) / 10 AS a, (high % 10) / 300 AS v, -(low % 10) / 60 AS d FROM bars), l AS (SELECT *, list_sort(list(a) OVER w) AS sa, list_sort(list(v) OVER w) AS sv, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    r AS (SELECT symbol, ts, CASE WHEN d <= -0.15 THEN 'crash_liquidity_stress_regime' WHEN a >= greatest(0.45::DOUBLE, sa[CAST(least(n - 1, floor(n * 0.75)) AS BIGINT) + 1]) OR v >= greatest(0.025::DOUBLE, sv[CAST(least(n - 1, floor(n * 0.75)) AS BIGINT) + 1]) THEN 'turbulent_multifractal_regime' WHEN h >= 0.58 THEN 'persistent_trend_regime' WHEN h <= 0.42 THEN 'anti_persistent_mean_reversion_regime' ELSE 'calm_efficient_regime' END AS regime FROM l),
    t AS (SELECT symbol, lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS before, regime FROM r) SELECT symbol, before, regime, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY ALL""")
def _spectral(spark, sf):
    b = hourly_bars(spark, sf)
    f = b.select("symbol", "timeframe", "ts", (F.col("close") % 10 / 10).alias("hurst_h2"), (F.col("open") % 10 / 10).alias("delta_alpha"), (F.col("high") % 10 / 300).alias("realized_volatility"), (-(F.col("low") % 10) / 60).alias("drawdown"))
    return transitions(spectral_regimes(f))
