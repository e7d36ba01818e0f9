"""Cleaning and validation of bars, calendars, imputation, corporate actions, outlier flags, splits and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.market import KEYS, dig, returns, series, trailing
from quarry.registry import query
from quarry.sources.market import BOOK_SQL, DAILY_SQL, HOURLY_SQL, book_rows, daily_bars, hourly_bars

PRICES = ["open", "high", "low", "close"]
#: Names under which a column may arrive, and the name it gets.
ALIASES = {"datetime": "ts", "timestamp": "ts", "date": "ts", "time": "ts", "ticker": "symbol", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume"}
#: Columns that rows of each kind must have.
REQUIRED = {
    "market": ["symbol", "open", "high", "low", "close", "volume"],
    "news": ["symbol", "headline", "url"],
    "lob": ["symbol", "bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1"],
}


def clean_column_name(name: str) -> str:
    """Lower-case words joined by underscores, under the canonical name if the name is an alias."""
    plain = "_".join("".join(ch if ch.isalnum() else " " for ch in name).lower().split())
    return ALIASES.get(plain, plain)


def clean_rows(rows: DataFrame) -> DataFrame:
    """Canonical names, upper-case symbols, UTC times and numbers; text that is no number becomes null."""
    out = rows.select(*[F.col(f"`{c}`").alias(clean_column_name(c)) for c in rows.columns])
    numbers = [c for c in out.columns if c in (*PRICES, "volume") or c.startswith(("bid_", "ask_"))]
    changes: dict[str, Column] = {c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}
    if "symbol" in out.columns:
        changes["symbol"] = F.upper(F.trim("symbol"))
    if "ts" in out.columns:
        changes["ts"] = F.expr("try_cast(ts as timestamp)")
    return out.withColumns(changes)


def invalid_rows(rows: DataFrame, kind: str) -> DataFrame:
    """The rows that lack a field which rows of the kind must have, with the missing fields' names."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() if c in rows.columns else F.lit(True), F.lit(c)) for c in REQUIRED[kind]]), lambda x: x.isNotNull())
    return rows.withColumn("missing", missing).where(F.size("missing") > 0)


def quality_flags(bars: DataFrame) -> DataFrame:
    """`flags`: missing_close, missing_timestamp and high_below_low, as they apply."""
    flags = [F.when(F.col("close").isNull(), F.lit("missing_close")), F.when(F.col("ts").isNull(), F.lit("missing_timestamp")), F.when(F.col("high") < F.col("low"), F.lit("high_below_low"))]
    return bars.withColumn("flags", F.array_compact(F.array(*flags)))


def missing_ratio(rows: DataFrame) -> DataFrame:
    """Share of cells that are null, to six places."""
    cells = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in rows.columns])
    return rows.agg(F.round(F.sum(cells) / (F.count("*") * len(rows.columns)), 6).alias("missing_ratio"))


def align_days(bars: DataFrame) -> DataFrame:
    """One row per (symbol, timeframe) and day from the first to the last: the day's last bar, or one made of the last close with volume 0.

    The days between two bars are made by the earlier bar, so that no calendar is joined and a gap costs what it holds.
    """
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    latest = bars.withColumn("day", day).withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "timeframe", "day").orderBy(F.col("ts").desc()))).where("__n = 1")
    following = F.lead("day").over(Window.partitionBy("symbol", "timeframe").orderBy("day"))
    spaced = latest.withColumn("__days", F.when(following.isNotNull(), F.datediff(following, "day")).otherwise(1))
    rows = spaced.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__days") - 1)))
    made = F.col("__k") > 0
    price = {c: F.when(made, F.col("close")).otherwise(F.col(c)) for c in PRICES}
    return rows.select("symbol", "timeframe", F.expr("cast(date_add(cast(day as date), __k) as timestamp_ntz)").alias("ts"), *[v.alias(c) for c, v in price.items()], F.when(made, 0.0).otherwise(F.col("volume")).alias("volume"), made.alias("inserted"))


def impute(bars: DataFrame) -> DataFrame:
    """Missing prices take the last known close, missing volumes 0, except before the first close; `imputed` says where."""
    w = series().rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("close", ignorenulls=True).over(w)
    later = F.row_number().over(series()) > 1
    b = bars.withColumns({"__known": known, "__later": later, "imputed": reduce(lambda a, c: a | F.col(c).isNull(), [*PRICES, "volume"], F.lit(False))})
    return b.withColumns({c: F.coalesce(F.col(c), F.col("__known")) for c in PRICES} | {"volume": F.coalesce("volume", F.when(F.col("__later"), 0.0))}).drop("__known", "__later")


def outlier_flags(bars: DataFrame, jump: float = 0.2, stale: int = 2) -> DataFrame:
    """price_jump against the last known close, stale_price by the length of a run of equal closes, zero_volume, inconsistent prices."""
    w = series()
    known = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = bars.withColumns({"__known": known, "__changed": F.when(F.col("close").eqNullSafe(F.lag("close").over(w)), 0).otherwise(1)})
    b = b.withColumn("__run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("symbol", "timeframe", "__run").orderBy("ts"))
    return b.withColumns(
        {
            "price_jump": F.coalesce(F.abs(ratio("close", "__known") - 1.0) > jump, F.lit(False)),
            "stale_price": F.col("close").isNotNull() & (length >= stale),
            "zero_volume": F.coalesce(F.col("volume") == 0, F.lit(False)),
            "inconsistent": F.coalesce((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")), F.lit(False)),
        }
    ).drop("__known", "__changed", "__run")


def adjust_for_actions(bars: DataFrame, actions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Prices times the product of the factors of all later actions known by `as_of`; actions (symbol, effective_ts, known_at, factor) are a short list per symbol."""
    known = actions if as_of is None else actions.where(F.col("known_at") <= F.lit(as_of).cast("timestamp_ntz"))
    per = known.groupBy("symbol").agg(F.collect_list(F.struct("effective_ts", "factor")).alias("__actions"))
    b = bars.join(per, "symbol", "left")
    later = F.filter(F.coalesce("__actions", F.array()), lambda a: F.col("ts") < a["effective_ts"])
    factor = F.aggregate(later, F.lit(1.0), lambda p, a: p * a["factor"])
    return b.withColumn("factor", factor).withColumns({c: F.round(F.col(c) * F.col("factor"), 10) for c in PRICES}).drop("__actions")


@query("bar_quality_report", f"WITH {HOURLY_SQL} SELECT symbol, count(*) FILTER (WHERE close IS NULL) AS missing_close, count(*) FILTER (WHERE high < low) AS high_below_low, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY symbol")
def _report(spark, sf):
    b = quality_flags(hourly_bars(spark, sf))
    return b.groupBy("symbol").agg(F.count_if(F.array_contains("flags", "missing_close")).alias("missing_close"), F.count_if(F.array_contains("flags", "high_below_low")).alias("high_below_low"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


_HOLES = "full_bars AS"
_HOLED_SQL = HOURLY_SQL.replace("bars AS", _HOLES) + ", bars AS (SELECT * REPLACE (CASE WHEN hour(ts) % 7 <> 3 THEN close END AS close, CASE WHEN hour(ts) % 5 <> 1 THEN high END AS high, CASE WHEN hour(ts) % 6 <> 2 THEN volume END AS volume) FROM full_bars)"


def _holed(spark, sf):
    h = F.hour("ts")
    return hourly_bars(spark, sf).withColumns({"close": F.when(h % 7 != 3, F.col("close")), "high": F.when(h % 5 != 1, F.col("high")), "volume": F.when(h % 6 != 2, F.col("volume"))})


@query("missing_ratio", f"WITH {_HOLED_SQL} SELECT round((count(*) FILTER (WHERE close IS NULL) + count(*) FILTER (WHERE high IS NULL) + count(*) FILTER (WHERE volume IS NULL)) / (count(*) * 10.0), 6) AS missing_ratio FROM bars")
def _missing(spark, sf):
    return missing_ratio(_holed(spark, sf))


@query("bars_imputed", f"""WITH {_HOLED_SQL}, k AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS rn FROM bars)
    SELECT symbol, ts, coalesce(open, known) AS open, coalesce(high, known) AS high, coalesce(low, known) AS low, coalesce(close, known) AS close, coalesce(volume, CASE WHEN rn > 1 THEN 0.0 END) AS volume,
           (close IS NULL OR high IS NULL OR volume IS NULL) AS imputed FROM k""")
def _imputed(spark, sf):
    return impute(_holed(spark, sf)).select("symbol", "ts", *PRICES, "volume", "imputed")


@query("bars_day_aligned", f"""WITH {DAILY_SQL}, sparse AS (SELECT * FROM bars WHERE volume >= 2),
    days AS (SELECT symbol, timeframe, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM sparse GROUP BY symbol, timeframe),
    j AS (SELECT d.symbol, d.ts, s.open, s.high, s.low, s.close, s.volume, last_value(s.close IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.ts ROWS UNBOUNDED PRECEDING) AS known FROM days d LEFT JOIN sparse s ON s.symbol = d.symbol AND s.ts = d.ts)
    SELECT symbol, ts, coalesce(open, known) AS open, coalesce(high, known) AS high, coalesce(low, known) AS low, coalesce(close, known) AS close, coalesce(volume, 0.0) AS volume, close IS NULL AS inserted FROM j""")
def _aligned(spark, sf):
    return align_days(daily_bars(spark, sf).where("volume >= 2")).select("symbol", "ts", *PRICES, "volume", "inserted")


@query("bars_outliers", f"""WITH {HOURLY_SQL.replace('bars AS', 'full_bars AS')}, bars AS (SELECT * REPLACE (floor(close / 20) * 20 AS close) FROM full_bars),
    a AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, CASE WHEN close IS NOT DISTINCT FROM lag(close) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM bars),
    b AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT symbol, ts, coalesce(abs(close / nullif(pc, 0) - 1.0) > 0.2, false) AS price_jump, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) >= 2 AS stale_price, volume = 0 AS zero_volume,
           (high < greatest(open, close, low) OR low > least(open, close)) AS inconsistent FROM b""")
def _outliers(spark, sf):
    b = hourly_bars(spark, sf).withColumn("close", F.floor(F.col("close") / 20) * 20.0)
    return outlier_flags(b).select("symbol", "ts", "price_jump", "stale_price", "zero_volume", "inconsistent")


_ACTIONS = [("NATION_1", "1995-06-01", "1995-05-01", 0.5), ("NATION_1", "1997-01-01", "1996-12-01", 0.25), ("NATION_2", "1996-01-01", "1999-01-01", 2.0)]


@query("bars_adjusted", f"""WITH {DAILY_SQL}, actions(symbol, e, k, factor) AS (VALUES {', '.join(f"('{s}', TIMESTAMP '{e}', TIMESTAMP '{k}', {f}::DOUBLE)" for s, e, k, f in _ACTIONS)}),
    j AS (SELECT b.symbol, b.ts, any_value(b.close) AS close, coalesce(product(a.factor), 1.0) AS factor FROM bars b LEFT JOIN actions a ON a.symbol = b.symbol AND b.ts < a.e AND a.k <= TIMESTAMP '1998-01-01' GROUP BY b.symbol, b.ts)
    SELECT symbol, ts, {dig('close * factor', 'close')}, factor FROM j""")
def _adjusted(spark, sf):
    actions = spark.createDataFrame(_ACTIONS, "symbol string, effective_ts string, known_at string, factor double")
    actions = actions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("effective_ts", "known_at")})
    return adjust_for_actions(daily_bars(spark, sf), actions, "1998-01-01").select("symbol", "ts", digits("close").alias("close"), "factor")


# splits


def window_specs(spark: SparkSession, first: str, last: str, train: int, validation: int, test: int, step: int, embargo: int = 0, mode: str = "rolling") -> DataFrame:
    """Bounds (dates, both inclusive) of train, validation and test periods in days, with an embargo before the last two.

    rolling windows move by `step`; expanding and anchored ones keep the first day of training.
    """
    if mode not in ("rolling", "expanding", "anchored"):
        raise ValueError(f"no window mode {mode!r}")
    span = train + validation + test + 2 * embargo
    specs = spark.range(1).select(F.to_date(F.lit(first)).alias("a"), F.to_date(F.lit(last)).alias("z")).select("a", F.explode(F.expr(f"sequence(0, greatest(0, datediff(z, a) + 1 - {span}), {step})")).alias("k"), "z").where(f"datediff(z, a) + 1 >= {span}")
    start = F.expr("date_add(a, k)") if mode == "rolling" else F.col("a")
    at = lambda days: F.expr(f"date_add(a, k + {days})")
    v, t = train + embargo, train + validation + 2 * embargo
    return specs.select((F.col("k") / step).cast("int").alias("window_id"), start.alias("train_start"), at(train - 1).alias("train_end"), at(v).alias("validation_start"), at(v + validation - 1).alias("validation_end"), at(t).alias("test_start"), at(t + test - 1).alias("test_end"))


def assign_windows(rows: DataFrame, specs: DataFrame, ts: str = "ts") -> DataFrame:
    """Each row with each window and the part of it that holds the row's day. Specs are few; rows stay where they are."""
    day = F.to_date(ts)
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("lo"), F.col(f"{p}_end").alias("hi")) for p in ("train", "validation", "test")]))
    return rows.join(specs.select("window_id", parts.alias("p")), day.between(F.col("p.lo"), F.col("p.hi"))).select(*rows.columns, "window_id", F.col("p.part").alias("part"))


def purged_folds(spark: SparkSession, first: str, last: str, folds: int, embargo: int) -> DataFrame:
    """Test periods of equal length; training ends `embargo` days before each, so that fold 0 has none."""
    size = F.expr(f"cast(floor((datediff(z, a) + 1) / {folds}) as int)")
    s = spark.range(folds).select(F.col("id").cast("int").alias("fold"), F.to_date(F.lit(first)).alias("a"), F.to_date(F.lit(last)).alias("z")).withColumn("n", size)
    return s.select("fold", F.expr("date_add(a, fold * n)").alias("test_start"), F.expr(f"case when fold = {folds - 1} then z else date_add(a, (fold + 1) * n - 1) end").alias("test_end"), F.expr(f"date_sub(date_add(a, fold * n), {embargo + 1})").alias("train_end"), F.col("a").alias("train_start"))


@query("walk_forward_windows", f"""WITH {DAILY_SQL}, w AS (SELECT CAST(k / 120 AS INT) AS window_id, DATE '1995-01-01' AS a, k FROM range(0, 1400, 120) t(k) WHERE k + 250 <= datediff('day', DATE '1995-01-01', DATE '1998-08-02') + 1),
    s AS (SELECT window_id, 'train' AS part, a + CAST(k AS INT) AS lo, a + CAST(k AS INT) + 179 AS hi FROM w UNION ALL SELECT window_id, 'validation', a + CAST(k AS INT) + 185, a + CAST(k AS INT) + 214 FROM w
          UNION ALL SELECT window_id, 'test', a + CAST(k AS INT) + 220, a + CAST(k AS INT) + 249 FROM w)
    SELECT window_id, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN s ON CAST(ts AS DATE) BETWEEN lo AND hi GROUP BY window_id, part""")
def _walk(spark, sf):
    specs = window_specs(spark, "1995-01-01", "1998-08-02", 180, 30, 30, 120, 5)
    return assign_windows(daily_bars(spark, sf), specs).groupBy("window_id", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("purged_folds", f"""WITH {DAILY_SQL}, f AS (SELECT CAST(k AS INT) AS fold, DATE '1995-01-01' + CAST(k AS INT) * 261 AS test_start, CASE WHEN k = 4 THEN DATE '1998-08-01' ELSE DATE '1995-01-01' + (CAST(k AS INT) + 1) * 261 - 1 END AS test_end FROM range(5) t(k))
    SELECT fold, count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN test_start AND test_end) AS n_test, count(*) FILTER (WHERE CAST(ts AS DATE) < test_start - 5) AS n_train FROM f, bars GROUP BY fold""")
def _folds(spark, sf):
    folds = purged_folds(spark, "1995-01-01", "1998-08-01", 5, 5)
    b = daily_bars(spark, sf).where("ts >= timestamp_ntz '1995-01-01'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return b.join(F.broadcast(folds), F.col("day") <= F.col("test_end")).groupBy("fold").agg(one(F.col("day") >= F.col("test_start"))("n_test"), one(F.col("day") <= F.col("train_end"))("n_train"))


# labels


def forward_labels(bars: DataFrame, horizon: int) -> DataFrame:
    """Return, direction and volatility of the next `horizon` bars; null where they are not all there."""
    ahead = F.lead("close", horizon).over(series())
    r = ratio(F.lead("close").over(series()), F.col("close")) - 1.0
    b = bars.withColumns({"forward_return": ratio(ahead, F.col("close")) - 1.0, "__r": r})
    vol = F.when(F.lead("close", horizon).over(series()).isNotNull(), F.stddev_pop("__r").over(series().rowsBetween(0, horizon - 1)))
    return b.withColumns({"forward_direction": F.signum("forward_return").cast("int"), "forward_volatility": vol}).drop("__r")


@query("labels_forward", f"""WITH {DAILY_SQL}, f AS (SELECT *, lead(close, 5) OVER w AS c5, lead(close) OVER w / nullif(close, 0) - 1.0 AS r FROM bars WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts))
    SELECT symbol, ts, {dig('c5 / nullif(close, 0) - 1.0', 'forward_return', 8)}, CAST(sign(c5 / nullif(close, 0) - 1.0) AS INT) AS forward_direction,
           {dig('CASE WHEN c5 IS NOT NULL THEN stddev_pop(r) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END', 'forward_volatility', 8)} FROM f""")
def _labels(spark, sf):
    f = forward_labels(daily_bars(spark, sf), 5)
    return f.select("symbol", "ts", digits("forward_return", 8).alias("forward_return"), "forward_direction", digits("forward_volatility", 8).alias("forward_volatility"))


# scaling


def scaled(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """z-score, min-max, robust and winsorised values within groups: sums per group first, then a join, never one window over all rows."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    stats = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), q.alias("__q"))
    x = F.col(value)
    return rows.join(stats, by).withColumns(
        {
            "z": F.coalesce(ratio(x - F.col("__m"), F.col("__s")), F.lit(0.0)),
            "min_max": F.coalesce(ratio(x - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)),
            "robust": F.coalesce(ratio(x - F.col("__q")[2], F.col("__q")[3] - F.col("__q")[1]), F.lit(0.0)),
            "winsorized": F.greatest(F.col("__q")[0], F.least(F.col("__q")[4], x)),
            "outlier": F.coalesce(F.abs(ratio(x - F.col("__m"), F.col("__s"))) > 3.0, F.lit(False)),
        }
    ).drop("__m", "__s", "__lo", "__hi", "__q")


@query("values_scaled", f"""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM events GROUP BY event_type)
    SELECT event_id, {dig('(value - m) / s', 'z', 8)}, {dig('(value - lo) / (hi - lo)', 'min_max', 8)}, {dig('(value - q[3]) / (q[4] - q[2])', 'robust', 8)}, {dig('greatest(q[1], least(q[5], value))', 'winsorized', 8)}, abs((value - m) / s) > 3 AS outlier FROM events JOIN s USING (event_type)""")
def _scaled(spark, sf):
    from quarry.sources.market import table

    s = scaled(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return s.select("event_id", *[digits(c, 8).alias(c) for c in ("z", "min_max", "robust", "winsorized")], "outlier")


def rolling_moments(r: DataFrame, value: str, n: int) -> DataFrame:
    """Mean, population deviation and z-score of the last n rows, where there are n; a deviation of 0 counts as 1."""
    w = trailing(n)
    full = F.count(value).over(w) == n
    return r.withColumns({"mean": F.when(full, F.avg(value).over(w)), "deviation": F.when(full, F.stddev_pop(value).over(w))}).withColumn("z", (F.col(value) - F.col("mean")) / F.when(F.col("deviation") > 1e-12, F.col("deviation")).otherwise(1.0))


@query("rolling_moments", f"""WITH {HOURLY_SQL}, m AS (SELECT symbol, ts, close, CASE WHEN count(close) OVER w = 12 THEN avg(close) OVER w END AS mean, CASE WHEN count(close) OVER w = 12 THEN stddev_pop(close) OVER w END AS deviation FROM bars WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, {dig('mean', n=8)}, {dig('deviation', n=8)}, round((close - mean) / CASE WHEN deviation > 1e-12 THEN deviation ELSE 1.0 END, 7) AS z FROM m""")
def _rolling(spark, sf):
    m = rolling_moments(hourly_bars(spark, sf), "close", 12)
    return m.select("symbol", "ts", digits("mean", 8).alias("mean"), digits("deviation", 8).alias("deviation"), F.round("z", 7).alias("z"))


def change_points(r: DataFrame, value: str, n: int = 20, cusum: float = 2.0, z: float = 2.5) -> DataFrame:
    """Shifts of the mean between adjacent windows, and values far from the n before them; only with full windows."""
    before, ahead = series().rowsBetween(-n, -1), series().rowsBetween(0, n - 1)
    full_b, full_a = F.count(value).over(before) == n, F.count(value).over(ahead) == n
    both = series().rowsBetween(-n, n - 1)
    gap = F.abs(F.avg(value).over(ahead) - F.avg(value).over(before)) / F.nullif(F.stddev_pop(value).over(both), F.lit(0.0))
    far = F.abs(F.col(value) - F.avg(value).over(before)) / F.nullif(F.stddev_pop(value).over(before), F.lit(0.0))
    return r.withColumns({"mean_shift": F.coalesce(full_b & full_a & (gap >= cusum), F.lit(False)), "jump": F.coalesce(full_b & (far >= z), F.lit(False))})


@query("change_points", f"""WITH {HOURLY_SQL}, w AS (SELECT symbol, ts, close, avg(close) OVER b AS mb, avg(close) OVER a AS ma, count(close) OVER b AS nb, count(close) OVER a AS na, stddev_pop(close) OVER b AS sb, stddev_pop(close) OVER ab AS sab FROM bars
    WINDOW b AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ab AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING))
    SELECT symbol, ts, coalesce(nb = 20 AND na = 20 AND abs(ma - mb) / nullif(sab, 0) >= 1.0, false) AS mean_shift, coalesce(nb = 20 AND abs(close - mb) / nullif(sb, 0) >= 2.5, false) AS jump FROM w""")
def _changes(spark, sf):
    return change_points(hourly_bars(spark, sf), "close", 20, 1.0).select("symbol", "ts", "mean_shift", "jump")


def book_features(book: DataFrame) -> DataFrame:
    """Prices and imbalances of the book's first level and of all levels."""
    from quarry.functions.numeric import imbalance, microprice, mid_price

    b1, a1, bs, as_ = (F.col(c) for c in ("bid_price_1", "ask_price_1", "bid_size_1", "ask_size_1"))
    bids, asks = bs + F.col("bid_size_2"), as_ + F.col("ask_size_2")
    return book.select(
        "symbol", "ts", "seq", mid_price(b1, a1).alias("mid_price"), microprice(b1, a1, bs, as_).alias("microprice"), (ratio(a1 - b1, mid_price(b1, a1)) * 10000).alias("spread_bps"),
        imbalance(bs, as_).alias("queue_imbalance"), imbalance(bids, asks).alias("depth_imbalance"), ratio(b1 * bs + a1 * as_, bs + as_).alias("weighted_mid"),
    )


@query("book_microstructure", f"""WITH {BOOK_SQL}, f AS (SELECT symbol, ts, seq, (bid_price_1 + ask_price_1) / 2.0 AS mid_price, (ask_price_1 * bid_size_1 + bid_price_1 * ask_size_1) / nullif(bid_size_1 + ask_size_1, 0) AS microprice,
    (bid_size_1 - ask_size_1) / nullif(bid_size_1 + ask_size_1, 0) AS queue_imbalance, (bid_size_1 + bid_size_2 - ask_size_1 - ask_size_2) / nullif(bid_size_1 + bid_size_2 + ask_size_1 + ask_size_2, 0) AS depth_imbalance,
    (bid_price_1 * bid_size_1 + ask_price_1 * ask_size_1) / nullif(bid_size_1 + ask_size_1, 0) AS weighted_mid, ask_price_1 - bid_price_1 AS sp FROM book)
    SELECT symbol, ts, seq, {dig('mid_price')}, {dig('microprice', n=9)}, {dig('sp / mid_price * 10000', 'spread_bps', 8)}, {dig('queue_imbalance', n=8)}, {dig('depth_imbalance', n=8)}, {dig('weighted_mid', n=9)} FROM f""")
def _book(spark, sf):
    f = book_features(book_rows(spark, sf))
    return f.select("symbol", "ts", "seq", digits("mid_price").alias("mid_price"), digits("microprice", 9).alias("microprice"), digits("spread_bps", 8).alias("spread_bps"), digits("queue_imbalance", 8).alias("queue_imbalance"), digits("depth_imbalance", 8).alias("depth_imbalance"), digits("weighted_mid", 9).alias("weighted_mid"))
