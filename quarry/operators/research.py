"""Research operators: coverage factors of sources, book labels, supervised rows, scenario and cost arithmetic, resolution of names, retraction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.functions.numeric import clamp, digits, ratio
from quarry.operators.evaluation import RETURNS_SQL
from quarry.operators.market import dig, returns, series, trailing
from quarry.registry import query
from quarry.sources.market import BOOK_SQL, DAILY_SQL, HOURLY_SQL, book_rows, daily_bars, hourly_bars, table


def coverage_factors(docs: DataFrame, source: str, event: str) -> DataFrame:
    """Per source and event: intensity against peers, omission pressure, dependency, uniqueness, syndication and share of reach.

    Counts per (source, event) first; everything after is over that small table.
    """
    n = docs.groupBy(source, event).agg(F.count("*").alias("n"), F.sum("n_chars").alias("reach"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))
    e, s = Window.partitionBy(event), Window.partitionBy(source)
    peers = F.count("*").over(e) - 1
    mean_peers = ratio((F.sum("n").over(e) - F.col("n")).cast("double"), peers.cast("double"))
    share = F.col("reach") / F.sum("reach").over(e)
    return n.select(
        source, event, "n",
        (F.col("n") / F.greatest(F.lit(1.0), F.coalesce(mean_peers, F.lit(1.0)))).alias("coverage_intensity"),
        F.greatest(F.lit(0.0), F.percentile("n", F.lit(0.5)).over(e) - F.col("n")).alias("omission_pressure"),
        (F.col("n") / F.sum("n").over(s)).alias("dependency"), (1.0 / F.count("*").over(e)).alias("uniqueness"),
        F.ln(1.0 + F.col("n") - F.col("distinct_texts")).alias("syndication"), share.alias("share"),
    ).withColumn("amplification", F.coalesce(ratio(F.col("share") - F.avg("share").over(e), F.stddev_pop("share").over(e)), F.lit(0.0)))


_FACTORS = ["coverage_intensity", "omission_pressure", "dependency", "uniqueness", "syndication", "share", "amplification"]


@query("coverage_factors", f"""WITH g AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS reach, count(DISTINCT sha256(text)) AS d FROM documents GROUP BY source, lang),
    f AS (SELECT source, lang, n, n / greatest(1.0, coalesce((sum(n) OVER e - n) / nullif(count(*) OVER e - 1, 0), 1.0)) AS coverage_intensity, greatest(0.0, quantile_cont(n, 0.5) OVER e - n) AS omission_pressure, n / sum(n) OVER s AS dependency,
                 1.0 / count(*) OVER e AS uniqueness, ln(1.0 + n - d) AS syndication, reach / sum(reach) OVER e AS share FROM g WINDOW e AS (PARTITION BY lang), s AS (PARTITION BY source))
    SELECT source, lang, n, {', '.join(dig(c, n=7) for c in _FACTORS[:-1])}, {dig('coalesce((share - avg(share) OVER (PARTITION BY lang)) / nullif(stddev_pop(share) OVER (PARTITION BY lang), 0), 0)', 'amplification', 6)} FROM f""")
def _coverage(spark, sf):
    f = coverage_factors(table(spark, sf, "documents"), "source", "lang")
    return f.select("source", "lang", "n", *[digits(c, 6 if c == "amplification" else 7).alias(c) for c in _FACTORS])


def concentration(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Entropy in bits, Gini-Simpson index and the largest share of each group's distribution."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(group))
    return counts.withColumn("p", p).groupBy(group).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), F.max("p").alias("largest"))


@query("source_concentration", f"WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, {dig('sum(-p * log2(p))', 'entropy', 7)}, {dig('1 - sum(p * p)', 'gini', 7)}, {dig('max(p)', 'largest', 7)} FROM p GROUP BY lang")
def _concentration(spark, sf):
    c = concentration(table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "n")
    return c.select("lang", *[digits(x, 7).alias(x) for x in ("entropy", "gini", "largest")])


def book_labels(book: DataFrame, horizon: int) -> DataFrame:
    """Mid-price move, direction and spread change over `horizon` rows ahead; near the end the last row stands in."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    ahead = w.rowsBetween(0, horizon)
    b = book.withColumns({"mid": (F.col("bid_price_1") + F.col("ask_price_1")) / 2.0, "sp": F.col("ask_price_1") - F.col("bid_price_1")})
    b = b.withColumns({"mid_ahead": F.last("mid").over(ahead), "sp_ahead": F.last("sp").over(ahead)})
    return b.select("symbol", "ts", "seq", (F.col("mid_ahead") - F.col("mid")).alias("mid_move"), F.signum(F.col("mid_ahead") - F.col("mid")).cast("int").alias("direction"), (F.col("sp_ahead") - F.col("sp")).alias("spread_change"))


@query("book_labels", f"WITH {BOOK_SQL}, m AS (SELECT symbol, ts, seq, (bid_price_1 + ask_price_1) / 2.0 AS mid, ask_price_1 - bid_price_1 AS sp FROM book), l AS (SELECT *, last_value(mid) OVER w AS ma, last_value(sp) OVER w AS sa FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT symbol, ts, seq, {dig('ma - mid', 'mid_move', 7)}, CAST(sign(ma - mid) AS INT) AS direction, {dig('sa - sp', 'spread_change', 7)} FROM l")
def _book_labels(spark, sf):
    b = book_labels(book_rows(spark, sf), 5)
    return b.select("symbol", "ts", "seq", digits("mid_move", 7).alias("mid_move"), "direction", digits("spread_change", 7).alias("spread_change"))


def supervised_rows(bars: DataFrame, window: int, horizon: int) -> DataFrame:
    """Rows of the last `window` returns and the return `horizon` bars on, where all of them are there."""
    r = returns(bars).select("symbol", "timeframe", "ts", F.col("log_return").alias("r"))
    w = series()
    full = r.withColumns({"features": F.collect_list("r").over(trailing(window)), "target": F.lead("r", horizon).over(w)})
    return full.where((F.size("features") == window) & F.col("target").isNotNull()).drop("r")


@query("supervised_rows", f"WITH {DAILY_SQL} {RETURNS_SQL}, f AS (SELECT symbol, ts, ln(1 + r) AS l, list(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f, lead(ln(1 + r), 2) OVER (PARTITION BY symbol ORDER BY ts) AS t FROM rets) SELECT symbol, ts, round(f[1], 7) AS f1, round(f[4], 7) AS f4, round(t, 7) AS target FROM f WHERE len(f) = 4 AND t IS NOT NULL")
def _supervised(spark, sf):
    s = supervised_rows(daily_bars(spark, sf), 4, 2)
    return s.select("symbol", "ts", F.round(F.col("features")[0], 7).alias("f1"), F.round(F.col("features")[3], 7).alias("f4"), F.round("target", 7).alias("target"))


#: Shocks to a period's return.
SCENARIOS = {"crash": -0.20, "correction": -0.10, "slump": -0.05, "calm": 0.0, "rally": 0.05, "boom": 0.10}


def scenarios(r: DataFrame, value: str, *by: str) -> DataFrame:
    """The sum of returns per group under each shock, one aggregation and an unpivot in the row."""
    g = r.groupBy(*by).agg(F.sum(value).alias("base"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("shock")) for n, s in SCENARIOS.items()])).alias("s")
    return g.select(*by, "base", rows).select(*by, "s.scenario", (F.col("base") + F.col("s.shock")).alias("outcome"))


@query("scenarios", f"WITH {HOURLY_SQL} {RETURNS_SQL}, b AS (SELECT symbol, sum(r) AS base FROM rets GROUP BY symbol), s(scenario, shock) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {s}::DOUBLE)' for n, s in SCENARIOS.items())}) SELECT symbol, scenario, {dig('base + shock', 'outcome', 8)} FROM b, s")
def _scenarios(spark, sf):
    return scenarios(returns(hourly_bars(spark, sf)), "simple_return", "symbol").select("symbol", "scenario", digits("outcome", 8).alias("outcome"))


def turnover_costs(current: DataFrame, target: DataFrame, value: float, bps: float, fixed: float) -> DataFrame:
    """Half the sum of weight changes over the union of symbols, and the cost of the trades in money and as a share."""
    both = current.select("symbol", F.col("weight").alias("c")).join(target.select("symbol", F.col("weight").alias("t")), "symbol", "full")
    change = F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("c", F.lit(0.0)))
    g = both.agg(F.sum(change).alias("moved"), F.count_if(change > 1e-12).alias("trades"))
    cost = F.col("moved") * value * bps / 10000 + F.col("trades") * fixed
    return g.select((F.col("moved") / 2).alias("turnover"), "trades", cost.alias("cost"), (cost / value).alias("drag"))


@query("turnover_costs", f"WITH {DAILY_SQL}, h AS (SELECT symbol, sum(volume) FILTER (WHERE ts < TIMESTAMP '1996-07-01') AS a, sum(volume) FILTER (WHERE ts >= TIMESTAMP '1996-07-01') AS b FROM bars GROUP BY symbol), w AS (SELECT symbol, a / sum(a) OVER () AS c, b / sum(b) OVER () AS t FROM h) SELECT {dig('sum(abs(t - c)) / 2', 'turnover', 7)}, count(*) FILTER (WHERE abs(t - c) > 1e-12) AS trades, {dig('sum(abs(t - c)) * 1000000 * 5 / 10000 + count(*) FILTER (WHERE abs(t - c) > 1e-12) * 2', 'cost', 7)} FROM w")
def _costs(spark, sf):
    b = daily_bars(spark, sf)
    weight = lambda c: b.where(c).groupBy("symbol").agg(F.sum("volume").alias("v")).crossJoin(F.broadcast(b.where(c).agg(F.sum("volume").alias("s")))).select("symbol", (F.col("v") / F.col("s")).alias("weight"))
    t = turnover_costs(weight("ts < timestamp_ntz '1996-07-01'"), weight("ts >= timestamp_ntz '1996-07-01'"), 1_000_000, 5, 2)
    return t.select(digits("turnover", 7).alias("turnover"), "trades", digits("cost", 7).alias("cost"))


def blended_returns(prior: DataFrame, views: DataFrame, weight: float, shrink: float) -> DataFrame:
    """Expected returns: a convex mix of priors and views where there are views, then drawn towards the mean."""
    mixed = prior.join(views, "symbol", "left").select("symbol", F.coalesce((1 - weight) * F.col("prior") + weight * F.col("view"), F.col("prior")).alias("mu"))
    mean = mixed.agg(F.avg("mu").alias("m"))
    return mixed.crossJoin(F.broadcast(mean)).select("symbol", ((1 - shrink) * F.col("mu") + shrink * F.col("m")).alias("expected"))


@query("blended_returns", f"WITH {HOURLY_SQL} {RETURNS_SQL}, p AS (SELECT symbol, avg(r) AS prior FROM rets GROUP BY symbol), m AS (SELECT symbol, CASE WHEN symbol = 'view' THEN 0.7 * prior + 0.3 * 0.05 ELSE prior END AS mu FROM p) SELECT symbol, {dig('0.8 * mu + 0.2 * avg(mu) OVER ()', 'expected', 7)} FROM m")
def _blended(spark, sf):
    p = returns(hourly_bars(spark, sf)).groupBy("symbol").agg(F.avg("simple_return").alias("prior"))
    v = spark.createDataFrame([("view", 0.05)], "symbol string, view double")
    return blended_returns(p, v, 0.3, 0.2).select("symbol", digits("expected", 7).alias("expected"))


def kupiec(r: DataFrame, value: str, limit: Column, *by: str) -> DataFrame:
    """Share of periods that lose more than a limit, and the likelihood ratio against the share expected at 5 %."""
    g = r.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) < -limit).alias("x"))
    x, n, p = F.col("x"), F.col("n"), 0.05
    q = x / n
    lr = -2 * ((n - x) * math.log(1 - p) + x * math.log(p) - F.when((x > 0) & (x < n), (n - x) * F.ln(1 - q) + x * F.ln(q)).otherwise(0.0))
    return g.select(*by, "n", "x", q.alias("hit_rate"), lr.alias("likelihood_ratio"))


@query("kupiec", f"WITH {HOURLY_SQL} {RETURNS_SQL}, g AS (SELECT symbol, count(r) AS n, count(*) FILTER (WHERE r < -0.8) AS x FROM rets GROUP BY symbol) SELECT symbol, n, x, {dig('x / n', 'hit_rate', 8)}, {dig('-2 * ((n - x) * ln(0.95) + x * ln(0.05) - CASE WHEN x > 0 AND x < n THEN (n - x) * ln(1 - x / n) + x * ln(x / n) ELSE 0 END)', 'likelihood_ratio', 5)} FROM g")
def _kupiec(spark, sf):
    k = kupiec(returns(hourly_bars(spark, sf)), "simple_return", F.lit(0.8), "symbol")
    return k.select("symbol", "n", "x", digits("hit_rate", 8).alias("hit_rate"), digits("likelihood_ratio", 5).alias("likelihood_ratio"))


def resolve_names(mentions: DataFrame, aliases: DataFrame, reach: int = 2) -> DataFrame:
    """Mentions (mention) with the entity of an equal alias, else of the closest alias within `reach` edits.

    Close aliases are looked up among those with the same first two letters and a length that differs by no more than
    `reach`; ties go to the smaller entity. Each distinct mention is resolved once.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    m = mentions.select("mention", norm(F.col("mention")).alias("m")).distinct()
    a = aliases.select(norm(F.col("alias")).alias("a"), "entity").distinct()
    exact = m.join(a.groupBy("a").agg(F.min("entity").alias("entity")), F.col("m") == F.col("a"), "left").select("mention", "m", "entity")
    block = lambda c: F.substring(c, 1, 2).alias("block")
    open_ = exact.where("entity is null").select("mention", "m", block(F.col("m")), F.explode(F.sequence(F.length("m") - reach, F.length("m") + reach)).alias("size"))
    near = open_.join(a.select("a", "entity", block(F.col("a")), F.length("a").alias("size")), ["block", "size"]).withColumn("edits", F.levenshtein("m", "a", reach)).where("edits >= 0")
    best = near.groupBy("mention").agg(F.min(F.struct("edits", "entity")).alias("b")).select("mention", F.col("b.entity").alias("close"), F.col("b.edits").alias("edits"))
    return exact.join(best, "mention", "left").select("mention", F.coalesce("entity", "close").alias("entity"), F.when(F.col("entity").isNotNull(), "exact").when(F.col("close").isNotNull(), "fuzzy").otherwise("none").alias("method"))


@query("names_resolved", """WITH m AS (SELECT DISTINCT replace(c_name, '#', ' ') AS mention, trim(regexp_replace(lower(replace(c_name, '#', ' ')), '[^a-z0-9]+', ' ', 'g')) AS m FROM customer), a AS (SELECT DISTINCT trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS a, s_suppkey AS entity FROM supplier),
    x AS (SELECT mention, m, min(entity) AS entity FROM m LEFT JOIN a ON m = a GROUP BY mention, m), n AS (SELECT mention, min(struct_pack(d := levenshtein(m, a), e := a.entity)) AS b FROM x JOIN a ON substring(m, 1, 2) = substring(a, 1, 2) AND abs(length(m) - length(a)) <= 2 AND levenshtein(m, a) <= 2 WHERE x.entity IS NULL GROUP BY mention)
    SELECT x.mention, coalesce(x.entity, b.e) AS entity, CASE WHEN x.entity IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method FROM x LEFT JOIN n ON n.mention = x.mention""")
def _resolved(spark, sf):
    m = table(spark, sf, "customer").select(F.replace("c_name", F.lit("#"), F.lit(" ")).alias("mention"))
    return resolve_names(m, table(spark, sf, "supplier").select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("entity")))


def retract(justifications: DataFrame, retracted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Justifications that stand without the retracted ones, and the beliefs that lost one and are stale until recomputed."""
    standing = justifications.join(retracted.select(key).distinct(), key, "left_anti")
    stale = justifications.join(retracted.select(key).distinct(), key, "left_semi").select("belief").distinct()
    return standing, stale


@query("beliefs_stale", "SELECT DISTINCT source AS belief FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def _stale(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", F.col("source").alias("belief"))
    return retract(j, table(spark, sf, "labels").where("toxic = 1"), "doc_id")[1]


def path_signature(r: DataFrame, value: str, *by: str) -> DataFrame:
    """Level one of a path's signature (its whole change), the sum of squared steps over two, its variation and roughness."""
    step = F.col(value) - F.lag(value).over(series())
    d = r.withColumn("d", step).where("d is not null")
    return d.groupBy(*by).agg(F.sum("d").alias("level_one"), (0.5 * F.sum(F.col("d") * F.col("d"))).alias("squares"), F.coalesce(ratio(F.sum(F.abs("d")), F.abs(F.sum("d"))), F.lit(0.0)).alias("variation"))


@query("path_signatures", f"WITH {HOURLY_SQL}, d AS (SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars) SELECT symbol, {dig('sum(d)', 'level_one', 6)}, {dig('0.5 * sum(d * d)', 'squares', 7)}, {dig('sum(abs(d)) / abs(sum(d))', 'variation', 6)} FROM d WHERE d IS NOT NULL GROUP BY symbol")
def _signatures(spark, sf):
    s = path_signature(hourly_bars(spark, sf), "close", "symbol")
    return s.select("symbol", digits("level_one", 6).alias("level_one"), digits("squares", 7).alias("squares"), digits("variation", 6).alias("variation"))


def regime_probabilities(parts: DataFrame, names: list[str]) -> DataFrame:
    """Scores cut to 0 and above, as probabilities, and the name of the largest; without any score `calm`."""
    cut = [F.greatest(F.lit(0.0), F.coalesce(F.col(n), F.lit(0.0))) for n in names]
    total = sum(cut[1:], cut[0])
    best = F.array_sort(F.array(*[F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(zip(names, cut, strict=True))]))[0]
    return parts.withColumns({f"p_{n}": F.coalesce(ratio(c, total), F.lit(0.0)) for n, c in zip(names, cut, strict=True)} | {"regime": F.when(total > 0, best["name"]).otherwise("calm")})


@query("regimes", f"WITH {HOURLY_SQL} {RETURNS_SQL}, s AS (SELECT symbol, greatest(0.0, avg(r)) AS trend, greatest(0.0, stddev_pop(r) - 1) AS turbulent, greatest(0.0, -min(r)) AS stress FROM rets GROUP BY symbol) SELECT symbol, {dig('trend / (trend + turbulent + stress)', 'p_trend', 7)}, CASE WHEN trend >= turbulent AND trend >= stress THEN 'trend' WHEN turbulent >= stress THEN 'turbulent' ELSE 'stress' END AS regime FROM s")
def _regimes(spark, sf):
    s = returns(hourly_bars(spark, sf)).groupBy("symbol").agg(F.avg("simple_return").alias("trend"), (F.stddev_pop("simple_return") - 1).alias("turbulent"), (-F.min("simple_return")).alias("stress"))
    return regime_probabilities(s, ["trend", "turbulent", "stress"]).select("symbol", digits("p_trend", 7).alias("p_trend"), "regime")


def penalised_weights(stats: DataFrame) -> DataFrame:
    """Inverse variance times a penalty for wide spectra (0 to 1), to one; weights without a variance are 0."""
    score = F.coalesce(ratio(clamp(1 - F.col("penalty")), F.col("volatility") * F.col("volatility")), F.lit(0.0))
    s = stats.withColumn("score", score)
    return s.crossJoin(F.broadcast(s.agg(F.sum("score").alias("total")))).select("symbol", F.coalesce(ratio("score", "total"), F.lit(0.0)).alias("weight"))


@query("penalised_weights", f"WITH {DAILY_SQL} {RETURNS_SQL}, s AS (SELECT symbol, greatest(0.0, least(1.0, 1 - abs(avg(r)) / 10)) / (stddev_pop(r) * stddev_pop(r)) AS s FROM rets GROUP BY symbol) SELECT symbol, {dig('s / sum(s) OVER ()', 'weight', 7)} FROM s")
def _penalised(spark, sf):
    s = returns(daily_bars(spark, sf)).groupBy("symbol").agg(F.stddev_pop("simple_return").alias("volatility"), (F.abs(F.avg("simple_return")) / 10).alias("penalty"))
    return penalised_weights(s).select("symbol", digits("weight", 7).alias("weight"))


#: Words that mark topics.
TOPIC_WORDS = {"markets": ["market", "stock", "price"], "policy": ["law", "policy", "government"], "science": ["study", "research", "science"], "sport": ["game", "team", "match"]}


def topic_scores(docs: DataFrame, words: dict[str, list[str]] = TOPIC_WORDS) -> DataFrame:
    """Per document and topic the share of the topic's words that occur in it, where there is one."""
    w = F.array_distinct(T.words("text"))
    rows = F.array(*[F.struct(F.lit(n).alias("topic"), F.array(*map(F.lit, g)).alias("g")) for n, g in words.items()])
    d = docs.select("doc_id", w.alias("w"), F.explode(rows).alias("t"))
    score = F.size(F.array_intersect("w", F.col("t.g"))) / F.size(F.col("t.g"))
    return d.select("doc_id", F.col("t.topic").alias("topic"), F.round(score, 6).alias("score")).where("score > 0")


@query("document_topics", "WITH t(topic, g) AS (VALUES " + ", ".join(f"('{n}', {g})" for n, g in T.HINTS.items()) + "), w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) SELECT doc_id, topic, round(len(list_intersect(w, g)) / len(g), 6) AS score FROM w, t WHERE len(list_intersect(w, g)) > 0")
def _topics(spark, sf):
    return topic_scores(table(spark, sf, "documents"), T.HINTS)


@query("calendar_rollup", f"SELECT CASE WHEN grouping(n_name) = 1 THEN '*' ELSE n_name END AS nation, year(o_orderdate) AS year, count(*) AS n, {dig('sum(o_totalprice)', 'total', 8)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (year(o_orderdate), n_name) HAVING grouping(year(o_orderdate)) = 0")
def _rollup(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    j = o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.rollup("year", "n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping("n_name").alias("g"), F.grouping("year").alias("gy"))
    return g.where("gy = 0").select(F.when(F.col("g") == 1, "*").otherwise(F.col("n_name")).alias("nation"), "year", "n", digits("total", 8).alias("total"))
