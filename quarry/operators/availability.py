"""Point-in-time rules: when a value may be known, rows that look ahead, embargoes and the health of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.numeric import digits
from quarry.operators.market import dig
from quarry.operators.preparation import window_specs
from quarry.plans.factors import Node, validate
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, daily_bars, table

#: Of what each kind of value is known by.
KNOWN_BY = {"fundamental": ["filed_at"], "macro": ["realtime_start", "date"], "market": ["timestamp"]}


def available_at(kind: str) -> Column:
    """When a row of a kind may be known: fundamentals when filed, macro values by vintage or else date, market values at once."""
    return F.coalesce(*[F.col(c) for c in KNOWN_BY[kind]])


@query("availability_times", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 30 DAY WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts END ELSE ts END AS available_at FROM events")
def _times(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("ts").alias("date"), F.expr("ts + interval 30 days").alias("filed_at"), F.expr("if(event_id % 2 = 0, ts + interval 2 hours, null)").alias("realtime_start"))
    rule = F.when(F.col("event_id") % 3 == 0, available_at("fundamental")).when(F.col("event_id") % 3 == 1, available_at("macro")).otherwise(available_at("market"))
    return e.select("event_id", rule.alias("available_at"))


def lookahead_rows(rows: DataFrame, ts: str = "ts", available: str = "available_at") -> DataFrame:
    """Rows whose value becomes known after the time at which it is used. Null times look ahead of nothing."""
    return rows.where(F.col(available) > F.col(ts))


def assert_no_lookahead(rows: DataFrame, ts: str = "ts", available: str = "available_at") -> None:
    """An error that names one offending row, if there is any."""
    bad = lookahead_rows(rows, ts, available).limit(1).collect()
    if bad:
        raise ValueError(f"a value is used at {bad[0][ts]} and known at {bad[0][available]}: {bad[0].asDict()}")


def future_features(rows: DataFrame, feature: str = "feature_timestamp", label: str = "label_timestamp") -> DataFrame:
    """Rows whose feature is later than their label, or that lack one of the times."""
    return rows.where(F.col(feature).isNull() | F.col(label).isNull() | (F.col(feature) > F.col(label)))


def respects_availability(rows: DataFrame, available: str = "available_at", as_of: str = "as_of") -> DataFrame:
    """One row, `respected`: no row is known after its as-of time; frames without both columns respect it."""
    if not {available, as_of} <= set(rows.columns):
        return rows.sparkSession.createDataFrame([(True,)], "respected boolean")
    return rows.agg(F.coalesce(F.every(F.coalesce(F.col(available) <= F.col(as_of), F.lit(True))), F.lit(True)).alias("respected"))


@query("lookahead_rows", "SELECT l_returnflag, count(*) AS n, max(l_shipdate) AS last_known FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY l_returnflag")
def _lookahead(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_shipdate").alias("available_at"))  # noqa: E741
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderdate + interval 60 days").alias("ts"))
    return lookahead_rows(l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("available_at").alias("last_known"))


def leakage_score(formula: Node, known: list[str], future: tuple[str, ...]) -> float:
    """1 if a formula uses an operand that lies in the future, else 0."""
    return float(any("lies in the future" in e for e in validate(formula, known, future)))


def embargo_violated(train_latest: Column, test_earliest: Column, days: int) -> Column:
    """Whether less than `days` lie between the last time of training and the first of testing."""
    return test_earliest < train_latest + F.make_dt_interval(F.lit(days))


def diagnosed_windows(rows: DataFrame, specs: DataFrame, embargo: int, horizon: int, least: int, ts: str = "ts") -> DataFrame:
    """Per window: rows of each part, gaps between them in days, embargo violations, training rows at or after the test, whether
    no training row's horizon reaches into the test, and whether there are `least` rows.

    Rows are counted by time first; the windows, which are few, are joined to those counts. Times are midnights of days.
    """
    day = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    joined = specs.join(day, F.col("day").between(F.col("train_start"), F.col("test_end")), "left")
    inside = {p: F.col("day").between(F.col(f"{p}_start"), F.col(f"{p}_end")) for p in ("train", "validation", "test")}
    pick = lambda p, x: F.when(inside[p], x)
    g = joined.groupBy("window_id").agg(
        *[F.coalesce(F.sum(pick(p, F.col("n"))), F.lit(0)).alias(f"{p}_rows") for p in inside], F.max(pick("train", F.col("day"))).alias("__tl"), F.min(pick("validation", F.col("day"))).alias("__ve"),
        F.max(pick("validation", F.col("day"))).alias("__vl"), F.min(pick("test", F.col("day"))).alias("__te"), F.coalesce(F.sum(pick("train", F.when(F.col("day") >= F.col("test_start"), F.col("n")))), F.lit(0)).alias("leaking_rows"),
        F.coalesce(F.every(F.when(inside["train"], F.date_add("day", horizon) <= F.col("test_start"))), F.lit(True)).alias("horizon_compliant"),
    )
    gap = lambda a, b: F.datediff(b, a).cast("double")
    short = lambda a, b: F.coalesce((F.datediff(b, a) < embargo).cast("int"), F.lit(0))
    return g.select(
        "window_id", "train_rows", "validation_rows", "test_rows", gap("__tl", "__te").alias("train_test_gap"), gap("__tl", "__ve").alias("train_validation_gap"), gap("__vl", "__te").alias("validation_test_gap"),
        (short("__tl", "__ve") + short("__vl", "__te")).alias("embargo_violations"), "leaking_rows", "horizon_compliant", (F.col("train_rows") + F.col("validation_rows") + F.col("test_rows") >= least).alias("enough_rows"),
    )


@query("window_diagnostics", f"""WITH {DAILY_SQL}, w AS (SELECT CAST(k / 120 AS INT) AS window_id, DATE '1995-01-01' + CAST(k AS INT) AS a FROM range(0, 1400, 120) t(k) WHERE k + 250 <= datediff('day', DATE '1995-01-01', DATE '1998-08-02') + 1),
    s AS (SELECT window_id, a, a + 179 AS b, a + 185 AS c, a + 214 AS d, a + 220 AS e, a + 249 AS f FROM w), j AS (SELECT *, CAST(ts AS DATE) AS day FROM s LEFT JOIN bars ON CAST(ts AS DATE) BETWEEN a AND f),
    g AS (SELECT window_id, count(*) FILTER (WHERE day BETWEEN a AND b) AS train_rows, count(*) FILTER (WHERE day BETWEEN c AND d) AS validation_rows, count(*) FILTER (WHERE day BETWEEN e AND f) AS test_rows, max(day) FILTER (WHERE day BETWEEN a AND b) AS tl, min(day) FILTER (WHERE day BETWEEN c AND d) AS ve, max(day) FILTER (WHERE day BETWEEN c AND d) AS vl, min(day) FILTER (WHERE day BETWEEN e AND f) AS te,
                 count(*) FILTER (WHERE day BETWEEN a AND b AND day >= e) AS leaking_rows, coalesce(bool_and(day + 42 <= e) FILTER (WHERE day BETWEEN a AND b), true) AS horizon_compliant FROM j GROUP BY window_id)
    SELECT window_id, train_rows, validation_rows, test_rows, CAST(te - tl AS DOUBLE) AS train_test_gap, CAST(ve - tl AS DOUBLE) AS train_validation_gap, CAST(te - vl AS DOUBLE) AS validation_test_gap, coalesce(CAST(ve - tl < 7 AS INT), 0) + coalesce(CAST(te - vl < 7 AS INT), 0) AS embargo_violations, leaking_rows, horizon_compliant, train_rows + validation_rows + test_rows >= 1000 AS enough_rows FROM g""")
def _windows(spark, sf):
    specs = window_specs(spark, "1995-01-01", "1998-08-02", 180, 30, 30, 120, 5)
    return diagnosed_windows(daily_bars(spark, sf), specs, 7, 42, 1000)


def memberships(members: DataFrame, clusters: DataFrame, as_of: str) -> DataFrame:
    """Members (cluster, first_seen, last_seen, available_at) of clusters (cluster, window_start, window_end) whose time overlaps
    the cluster's and that are known at `as_of`."""
    at = F.lit(as_of).cast("timestamp_ntz")
    known = members.where(F.col("available_at") <= at)
    return known.join(clusters, "cluster").where((F.col("first_seen") <= F.col("window_end")) & (F.col("last_seen") >= F.col("window_start"))).select(*members.columns)


@query("cluster_memberships", "WITH m AS (SELECT user_id AS cluster, event_type, min(ts) AS first_seen, max(ts) AS last_seen, min(ts) + INTERVAL 1 DAY AS available_at FROM events GROUP BY 1, 2), c AS (SELECT user_id AS cluster, min(ts) FILTER (WHERE event_type = 'click') AS window_start, min(ts) FILTER (WHERE event_type = 'click') + INTERVAL 2 DAY AS window_end FROM events GROUP BY 1) SELECT m.* FROM m JOIN c USING (cluster) WHERE available_at <= TIMESTAMP '2024-01-20' AND first_seen <= window_end AND last_seen >= window_start")
def _memberships(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    m = e.groupBy(F.col("user_id").alias("cluster"), "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).withColumn("available_at", F.expr("first_seen + interval 1 day"))
    c = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("cluster")).agg(F.min("ts").alias("window_start")).withColumn("window_end", F.expr("window_start + interval 2 days"))
    return memberships(m, c, "2024-01-20")


def forward_windows(rows: DataFrame, by: str, order: list[str], folds: int) -> DataFrame:
    """`fold` of each row within its group: rows in order, cut into equal parts of floor(n / folds) rows, at least one; what is left over is one fold more."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / F.lit(max(1, folds))))
    return rows.withColumn("fold", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size).cast("long"))


def forward_score(rows: DataFrame, factor: str, objective: str, *by: str, threshold: float = 0.5) -> DataFrame:
    """Utility of a factor against an objective cut to 0..1: of the rows where it reaches the threshold, the share where the objective does; and its novelty, distinct values to three places per row."""
    x, y = F.coalesce(F.col(factor), F.lit(0.0)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(objective), F.lit(0.0))))
    g = rows.groupBy(*by).agg(F.count_if(x >= threshold).alias("__c"), F.count_if((x >= threshold) & (y >= threshold)).alias("__h"), F.count_distinct(F.bround(x, 3)).alias("__d"), F.count("*").alias("__n"))
    return g.select(*by, (F.col("__h") / F.greatest(F.lit(1), F.col("__c"))).alias("utility"), (F.col("__d") / F.greatest(F.lit(1), F.col("__n"))).alias("novelty"))


def stability(rows: DataFrame, factor: str, *by: str) -> DataFrame:
    """1 / (1 + deviation / |mean|), from 0 to 1; without rows 0."""
    x = F.coalesce(F.col(factor), F.lit(0.0))
    return rows.groupBy(*by).agg((1 / (1 + F.stddev_pop(x) / F.greatest(F.abs(F.avg(x)), F.lit(1e-9)))).alias("stability"))


@query("factor_forward_scores", f"WITH e AS (SELECT event_id, event_type, ts, value / 100 AS f, (event_id % 13) / 10.0 AS o FROM events), k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / greatest(1, floor(count(*) OVER (PARTITION BY event_type) / 3))) AS BIGINT) AS fold FROM e) SELECT event_type, fold, {dig('count(*) FILTER (WHERE f >= 0.5 AND greatest(0.0, least(1.0, o)) >= 0.5) / greatest(1, count(*) FILTER (WHERE f >= 0.5))', 'utility', 7)}, {dig('count(DISTINCT round_even(f * 1.0000000001, 3)) / count(*)', 'novelty', 7)}, {dig('1 / (1 + stddev_pop(f) / greatest(abs(avg(f)), 1e-9))', 'stability', 6)} FROM k GROUP BY event_type, fold")
def _forward(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", (F.col("value") / 100).alias("f"), (F.col("event_id") % 13 / 10.0).alias("o"))
    k = forward_windows(e, "event_type", ["ts", "event_id"], 3)
    scores = forward_score(k.withColumn("f", F.col("f") * 1.0000000001), "f", "o", "event_type", "fold").join(stability(k, "f", "event_type", "fold"), ["event_type", "fold"])
    return scores.select("event_type", "fold", digits("utility", 7).alias("utility"), digits("novelty", 7).alias("novelty"), digits("stability", 6).alias("stability"))


def tercile_agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Share of rows whose two values lie in the same third of their own column, a stand-in for mutual information. Thirds end at quantiles of the whole frame, one row of which is broadcast."""
    third = F.array(F.lit(1 / 3), F.lit(2 / 3))
    q = rows.agg(F.percentile(left, third).alias("__l"), F.percentile(right, third).alias("__r"))
    part = lambda c, at: (F.col(c) > at[0]).cast("int") + (F.col(c) > at[1]).cast("int")
    return rows.crossJoin(F.broadcast(q)).agg(F.avg((part(left, F.col("__l")) == part(right, F.col("__r"))).cast("int")).alias("agreement"))


@query("factor_tercile_agreement", f"WITH q AS (SELECT quantile_cont(value, [1.0 / 3, 2.0 / 3]) AS l, quantile_cont(user_id::DOUBLE, [1.0 / 3, 2.0 / 3]) AS r FROM events) SELECT {dig('avg(CAST((value > l[1])::INT + (value > l[2])::INT = (user_id > r[1])::INT + (user_id > r[2])::INT AS INT))', 'agreement', 7)} FROM events, q")
def _terciles(spark, sf):
    e = table(spark, sf, "events").select("value", F.col("user_id").cast("double").alias("user"))
    return tercile_agreement(e, "value", "user").select(digits("agreement", 7).alias("agreement"))
