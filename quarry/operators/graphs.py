"""Graphs as two tables: edge lists, degrees, PageRank, exposure, reachability, correlation graphs and spanning forests.

Iterations are a fixed small number of joins; each result is written to a checkpoint where the session has a folder for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.evaluation import RETURNS_SQL, covariances
from quarry.operators.market import dig, returns
from quarry.operators.settling import settle
from quarry.registry import query
from quarry.sources.market import HOURLY_SQL, hourly_bars, table


def trade_edges(spark, sf) -> DataFrame:
    """(src, dst, weight): supplier nation to another customer nation by the number of line items, where it is above the supplier's mean."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    flows = li.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = flows.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = flows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return g.where("src <> dst").withColumn("mean", F.avg("weight").over(Window.partitionBy("src"))).where("weight > mean").drop("mean")


EDGES_SQL = "e0 AS (SELECT s_nationkey AS src, c_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2), e AS (SELECT * FROM e0 QUALIFY weight > avg(weight) OVER (PARTITION BY src))"


def degrees(edges: DataFrame) -> DataFrame:
    """Edges out and in, and their weights, of each node."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("wo"), F.lit(0.0).alias("wi")).union(edges.select("dst", F.lit(0), F.lit(1), F.lit(0.0), "weight"))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("wo").alias("out_weight"), F.sum("wi").alias("in_weight"))


@query("graph_degrees", f"WITH {EDGES_SQL}, b AS (SELECT src AS node, 1 AS o, 0 AS i, weight AS wo, 0.0::DOUBLE AS wi FROM e UNION ALL SELECT dst, 0, 1, 0.0, weight FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, sum(wo) AS out_weight, sum(wi) AS in_weight FROM b GROUP BY node")
def _degrees(spark, sf):
    return degrees(trade_edges(spark, sf))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Ranks after `rounds` steps from equal ranks; nodes without edges out keep theirs to themselves."""
    e = settle(edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    out = settle(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = out.join(ranks, out["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        ranks = nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 4 == 3:
            ranks = settle(ranks)
    return ranks


def _pagerank_sql(rounds: int) -> str:
    steps = [f"{EDGES_SQL.replace('e AS (', 'e AS MATERIALIZED (')}, n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS c FROM n), k AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / c AS rank FROM n, c)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / c + 0.85::DOUBLE * coalesce(sum(r.rank / k.k), 0) AS rank FROM n CROSS JOIN c LEFT JOIN e ON e.dst = n.node LEFT JOIN r{i} r ON r.node = e.src LEFT JOIN k ON k.src = e.src GROUP BY n.node, c)")
    return "WITH " + ", ".join(steps) + f" SELECT node, {dig('rank', 'rank', 7)} FROM r{rounds}"


@query("graph_pagerank", _pagerank_sql(20))
def _pagerank(spark, sf):
    return pagerank(trade_edges(spark, sf)).select("node", digits("rank", 7).alias("rank"))


def exposure(edges: DataFrame, seeds: DataFrame, decay: float = 0.85, steps: int = 3) -> DataFrame:
    """Scores that spread from seeds (node, score) along edges, weakened by weight and decay at each of `steps` steps, and add up."""
    front, total = seeds, seeds
    for _ in range(steps):
        front = edges.join(front, edges["src"] == front["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("weight") * decay).alias("score"))
        total = total.union(front)
    return total.groupBy("node").agg(F.sum("score").alias("score"))


@query("graph_exposure", f"WITH {EDGES_SQL}, w AS (SELECT src, dst, weight / 1000 AS weight FROM e), f0 AS (SELECT 0 AS node, 1.0::DOUBLE AS score UNION ALL SELECT 3, 0.5), " + ", ".join(f"f{i + 1} AS (SELECT dst AS node, sum(score * weight * 0.85::DOUBLE) AS score FROM w JOIN f{i} ON src = node GROUP BY dst)" for i in range(3)) + f" SELECT node, {dig('sum(score)', 'score', 7)} FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2 UNION ALL FROM f3) GROUP BY node")
def _exposure(spark, sf):
    e = trade_edges(spark, sf).withColumn("weight", F.col("weight") / 1000)
    return exposure(e, spark.createDataFrame([(0, 1.0), (3, 0.5)], "node int, score double")).select("node", digits("score", 7).alias("score"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """The least number of steps, up to `depth`, from the nodes of `start` (node) to each node they reach."""
    seen = start.select("node", F.lit(0).alias("steps"))
    for i in range(depth):
        step = edges.join(seen.where(F.col("steps") == i), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.lit(i + 1).alias("steps"))
        seen = seen.union(step).groupBy("node").agg(F.min("steps").alias("steps"))
    return seen


@query("graph_reachable", f"WITH RECURSIVE {EDGES_SQL}, s(node, steps) AS (SELECT 1, 0 UNION SELECT dst, steps + 1 FROM s JOIN e ON src = node WHERE steps < 3) SELECT node, min(steps) AS steps FROM s GROUP BY node")
def _reachable(spark, sf):
    return reachable(trade_edges(spark, sf), spark.createDataFrame([(1,)], "node int"))


def correlation_graph(r: DataFrame, least: float) -> DataFrame:
    """Pairs of symbols (a < b) whose returns correlate by at least `least`, either sign, with mutual information of a Gaussian pair."""
    c = covariances(r).where((F.col("a") < F.col("b")) & (F.abs("correlation") >= least))
    rho = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("correlation")))
    return c.select("a", "b", "correlation", (-0.5 * F.ln(1 - rho * rho)).alias("mutual_information"))


@query("graph_correlation", f"WITH {HOURLY_SQL} {RETURNS_SQL}, c AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS correlation FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2) SELECT a, b, {dig('correlation', n=7)}, {dig('-0.5 * ln(1 - correlation * correlation)', 'mutual_information', 6)} FROM c WHERE abs(correlation) >= 0.01")
def _correlation(spark, sf):
    g = correlation_graph(returns(hourly_bars(spark, sf)), 0.01)
    return g.select("a", "b", digits("correlation", 7).alias("correlation"), digits("mutual_information", 6).alias("mutual_information"))


def components(edges: DataFrame) -> DataFrame:
    """`node, component` of an undirected graph (src, dst): a component is called by its smallest node.

    Alternating large and small stars, whose rounds grow with the logarithm of a component's size. Joins are by merging:
    what a broadcast in each of many rounds leaves in the driver adds up with the nodes. Loops make a node of its own.
    """
    ends = settle(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null").distinct())
    stars = ends.where("u <> v")
    while True:
        several = stars.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if not several.take(1) and not stars.join(stars.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").take(1):
            break
        # Large star: each node links its larger neighbours to the smallest node it knows.
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        stars = settle(small.where("u <> v").distinct())
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(labels.select(F.col("component").alias("node"), "component")).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The forest of heaviest edges, by rounds in which every component takes its heaviest edge to another (ties by a, b).

    Each round at least halves the components that still have edges to others; labels are joined, never collected.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    taken = edges.limit(0)
    while True:
        l1, l2 = nodes.select(F.col("node").alias("a"), F.col("label").alias("la")), nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = settle(edges.join(l1, "a").join(l2, "b").where("la <> lb"))
        if not between.take(1):
            return taken
        best = F.max_by(F.struct("a", "b", "weight", "la", "lb"), F.struct(F.abs("weight"), F.col("a"), F.col("b")))
        sides = between.select("*", F.col("la").alias("l")).union(between.select("*", F.col("lb").alias("l")))
        chosen = settle(sides.groupBy("l").agg(best.alias("e")).select("e.*").distinct())
        taken = settle(taken.union(chosen.select(*edges.columns)))
        labels = nodes.select("label").distinct().select(F.col("label").alias("x"), F.col("label").alias("to"))
        for _ in range(6):  # pull labels together along the edges chosen
            hop = chosen.select(F.col("la").alias("p"), F.col("lb").alias("q")).union(chosen.select("lb", "la"))
            lower = hop.join(labels, hop["q"] == labels["x"]).groupBy("p").agg(F.min("to").alias("m"))
            labels = settle(labels.join(lower, labels["x"] == lower["p"], "left").select("x", F.least("to", F.coalesce("m", "to")).alias("to")))
        nodes = settle(nodes.join(labels, nodes["label"] == labels["x"]).select("node", F.col("to").alias("label")))


def density(edges: DataFrame) -> DataFrame:
    """Edges over possible directed edges, and the entropy in bits of the distribution of degrees."""
    d = degrees(edges).withColumn("d", F.col("out_degree") + F.col("in_degree"))
    n = d.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).alias("edges"))
    p = d.groupBy("d").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).withColumn("p", F.col("c") / F.col("nodes"))
    return p.groupBy("nodes", "edges").agg(F.sum(-F.col("p") * F.log2("p")).alias("degree_entropy")).withColumn("density", ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


@query("graph_density", f"WITH {EDGES_SQL}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), n AS (SELECT count(*) AS nodes, sum(d) / 2 AS edges FROM d), p AS (SELECT d, count(*) / any_value(nodes) AS p FROM d, n GROUP BY d) SELECT any_value(nodes) AS nodes, {dig('any_value(edges)', 'edges')}, {dig('sum(-p * log2(p))', 'degree_entropy', 7)}, {dig('any_value(edges / (nodes * (nodes - 1)))', 'density')} FROM p, n")
def _density(spark, sf):
    d = density(trade_edges(spark, sf))
    return d.select("nodes", digits("edges").alias("edges"), digits("degree_entropy", 7).alias("degree_entropy"), digits("density").alias("density"))
