"""Graphs between series by several measures, groups as hyperedges, the complexity of a graph, and snapshots of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.evaluation import RETURNS_SQL
from quarry.operators.market import dig, returns, series
from quarry.registry import query
from quarry.sources.market import HOURLY_SQL, hourly_bars, table

MEASURES = ["correlation", "partial", "lead_lag", "coherence", "mutual_information", "complexity"]


def series_graph(r: DataFrame, value: str, until: str | None = None) -> DataFrame:
    """Weights between each two symbols a < b over common times, up to `until`: correlation, 0.8 of it as a partial
    correlation, how much a leads b, coherence, mutual information of a Gaussian pair, and likeness of their variation.

    The rows of a time are one array, a row for each symbol of a bounded universe, so pairs are made within rows and partly
    summed before the shuffle.
    """
    if until is not None:
        r = r.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    w = series()
    r = r.withColumns({"x": F.col(value), "next": F.lead(value).over(w), "step": F.abs(F.col(value) - F.lag(value).over(w))})
    at = r.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("symbol", "x", "next"))).alias("s"))
    left = at.select("s", F.posexplode("s").alias("i", "p"))
    pairs = left.select("p", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("q")).select(F.col("p.symbol").alias("a"), F.col("q.symbol").alias("b"), F.col("p.x").alias("x"), F.col("q.x").alias("y"), F.col("p.next").alias("xn"), F.col("q.next").alias("yn"))
    # Sums over pairs of which one is missing would mix different rows, so each correlation sees complete pairs only.
    corr = lambda x, y: F.coalesce(ratio(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y)))), F.lit(0.0))
    g = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), corr("x", "y").alias("correlation"), (corr("x", "yn") - corr("y", "xn")).alias("lead_lag"))
    rough = r.groupBy("symbol").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("c"))
    g = g.join(rough.select(F.col("symbol").alias("a"), F.col("c").alias("ca")), "a").join(rough.select(F.col("symbol").alias("b"), F.col("c").alias("cb")), "b")
    rho = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("correlation")))
    return g.select(
        "a", "b", "n", "correlation", (0.8 * F.col("correlation")).alias("partial"), "lead_lag", F.abs("correlation").alias("coherence"),
        (-0.5 * F.ln(F.greatest(F.lit(1e-12), 1 - rho * rho))).alias("mutual_information"), (1 / (1 + F.abs(F.col("ca") - F.col("cb")))).alias("complexity"),
    )


_PAIRS_SQL = f"""{HOURLY_SQL} {RETURNS_SQL}, s AS (SELECT symbol, ts, r AS x, lead(r) OVER w AS xn, abs(r - lag(r) OVER w) AS step FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c AS (SELECT symbol, coalesce(sum(step), 0) AS c FROM s GROUP BY symbol),
    g AS (SELECT p.symbol AS a, q.symbol AS b, count(*) AS n, coalesce(corr(p.x, q.x), 0) AS correlation, coalesce(corr(p.x, q.xn), 0) - coalesce(corr(q.x, p.xn), 0) AS lead_lag FROM s p JOIN s q ON p.ts = q.ts AND p.symbol < q.symbol GROUP BY 1, 2)"""


@query("graph_series", f"WITH {_PAIRS_SQL} SELECT a, b, n, {dig('correlation', n=5)}, {dig('0.8 * correlation', 'partial', 5)}, {dig('lead_lag', n=5)}, {dig('abs(correlation)', 'coherence', 5)}, {dig('-0.5 * ln(1 - correlation * correlation)', 'mutual_information', 4)}, {dig('1 / (1 + abs(x.c - y.c))', 'complexity', 5)} FROM g JOIN c x ON x.symbol = a JOIN c y ON y.symbol = b")
def _series(spark, sf):
    g = series_graph(returns(hourly_bars(spark, sf)), "simple_return")
    return g.select("a", "b", "n", *[digits(c, 4 if c == "mutual_information" else 5).alias(c) for c in MEASURES])


def strongest_edges(edges: DataFrame, weight: str) -> DataFrame:
    """The n - 1 edges of greatest |weight| of a graph of n nodes; ties by a, b. A top-k over edges, never a window over all."""
    n = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().count()
    return edges.orderBy(F.abs(weight).desc(), "a", "b").limit(max(0, n - 1))


@query("graph_sparse", f"WITH {_PAIRS_SQL} SELECT a, b, {dig('correlation', n=5)} FROM g ORDER BY abs(correlation) DESC, a, b LIMIT (SELECT greatest(0, count(DISTINCT node) - 1) FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g))")
def _sparse(spark, sf):
    return strongest_edges(series_graph(returns(hourly_bars(spark, sf)), "simple_return"), "correlation").select("a", "b", digits("correlation", 5).alias("correlation"))


def hyperedges(metadata: DataFrame, fields: list[str]) -> DataFrame:
    """`name` (field:value) of each group that has a member, how many it has, and its first and last member; blank values make none.

    Members stay rows of (name, symbol) in `hyperedge_members`; a group may be large.
    """
    return hyperedge_members(metadata, fields).groupBy("name").agg(F.count("*").alias("members"), F.min("symbol").alias("first"), F.max("symbol").alias("last"))


def hyperedge_members(metadata: DataFrame, fields: list[str]) -> DataFrame:
    m = metadata.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.trim(F.col(f).cast("string")).alias("v")) for f in fields])).alias("g"))
    return m.where(F.coalesce(F.col("g.v"), F.lit("")) != "").select(F.concat(F.col("g.f"), F.lit(":"), F.col("g.v")).alias("name"), "symbol").distinct()


@query("graph_hyperedges", "WITH m AS (SELECT DISTINCT c_name AS symbol, 'segment:' || trim(c_mktsegment) AS name FROM customer WHERE trim(c_mktsegment) <> '' UNION SELECT c_name, 'nation:' || c_nationkey FROM customer) SELECT name, count(*) AS members, min(symbol) AS first, max(symbol) AS last FROM m GROUP BY name")
def _hyper(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return hyperedges(c, ["segment", "nation"])


def topology(edges: DataFrame) -> DataFrame:
    """One row of an undirected graph (a, b): nodes, edges, directed density, entropy in bits of the degrees."""
    d = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count("*").alias("d"))
    total = d.agg(F.sum("d").alias("t"), F.count("*").alias("nodes"))
    p = F.col("d") / F.col("t")
    g = d.crossJoin(F.broadcast(total)).groupBy("nodes", "t").agg(F.sum(-p * F.log2(p)).alias("degree_entropy"))
    return g.select("nodes", (F.col("t") / 2).cast("long").alias("edges"), F.coalesce(ratio(F.col("t") / 2, (F.col("nodes") * (F.col("nodes") - 1)).cast("double")), F.lit(0.0)).alias("density"), "degree_entropy")


@query("graph_topology", f"WITH {_PAIRS_SQL}, e AS (SELECT a, b FROM g WHERE abs(correlation) >= 0.01), d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), t AS (SELECT sum(d) AS t, count(*) AS nodes FROM d) SELECT nodes, CAST(t / 2 AS BIGINT) AS edges, {dig('t / 2 / (nodes * (nodes - 1))', 'density', 6)}, {dig('sum(-(d / t) * log2(d / t))', 'degree_entropy', 6)} FROM d, t GROUP BY nodes, t")
def _topology(spark, sf):
    g = series_graph(returns(hourly_bars(spark, sf)), "simple_return").where(F.abs("correlation") >= 0.01)
    return topology(g).select("nodes", "edges", digits("density", 6).alias("density"), digits("degree_entropy", 6).alias("degree_entropy"))


def save_snapshot(edges: DataFrame, path: str, name: str, **about: str) -> None:
    """Edges as Parquet under path/name/edges, and beside them one JSON row of the graph's topology and what the caller says about it."""
    edges.write.mode("overwrite").parquet(f"{path}/{name}/edges")
    row = topology(edges).withColumns({k: F.lit(v) for k, v in {"name": name, **about}.items()})
    row.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/about")


def book_resilience(book: DataFrame) -> DataFrame:
    """1 less the change of the spread over the spread before, at least 0; the first row of a symbol is fully resilient."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq", "spread", "bid_depth", "ask_depth")
    before = F.lag("spread").over(w)
    change = F.abs(F.col("spread") - before) / F.greatest(before, F.lit(1e-12))
    return book.withColumn("resilience", F.when(before.isNotNull(), F.greatest(F.lit(0.0), 1 - change)).otherwise(1.0))


def book_series(book: DataFrame) -> DataFrame:
    """Spread, imbalance, depths and seconds since the row before (1 for the first, a billionth at least): the series that multifractal kernels take."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq", "spread", "bid_depth", "ask_depth")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    before = F.lag(seconds).over(w)
    gap = F.when(before.isNotNull(), F.greatest(seconds - before, F.lit(1e-9)))
    return book.withColumns({"imbalance": F.coalesce("imbalance", F.lit(0.0)), "seconds": F.coalesce(gap, F.lit(1.0))})


def _book_sql() -> str:
    from quarry.sources.market import DEPTHS_SQL

    return f"WITH {DEPTHS_SQL}, l AS (SELECT *, lag(spread) OVER w AS ps, lag(ts) OVER w AS pt FROM depths WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq, spread, bid_depth, ask_depth)) SELECT symbol, seq, {dig('CASE WHEN ps IS NULL THEN 1.0 ELSE greatest(0.0, 1 - abs(spread - ps) / greatest(ps, 1e-12)) END', 'resilience', 6)}, {dig('CASE WHEN pt IS NULL THEN 1.0 ELSE greatest((epoch_us(ts) - epoch_us(pt)) / 1e6, 1e-9) END', 'seconds', 6)}, {dig('coalesce(imbalance, 0)', 'imbalance', 6)} FROM l"


@query("book_series", _book_sql())
def _book(spark, sf):
    from quarry.sources.market import book_depths, book_rows

    b = book_depths(book_rows(spark, sf))
    s = book_series(book_resilience(b))
    return s.select("symbol", "seq", digits("resilience", 6).alias("resilience"), digits("seconds", 6).alias("seconds"), digits("imbalance", 6).alias("imbalance"))
