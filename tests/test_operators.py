from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry import registry
from quarry.functions import text as T
from quarry.operators import documents, evaluation, features, graphs, market, models, preparation, timeseries
from quarry.plans import factors, runner
from quarry.sources import readers, sinks
from quarry.streaming import windows

import oracle

SF = "/root/testdata/sf0.001"
BAR = "symbol string, asset_type string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, source string"


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, symbol="SPY", volumes=None):
    rows = [(symbol, "equity", "1d", day(i), c, c, c, c, 10.0 if volumes is None else volumes[i], "s") for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_duckdb(spark, con, name):
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.SQL[name], SF) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_returns_and_gaps(spark):
    r = market.returns(bars(spark, [100.0, 101.0, None, 0.0, 50.0])).orderBy("ts").collect()
    assert [round(x.simple_return, 6) for x in r] == [0.01]
    assert not market.returns(bars(spark, [])).collect()


def test_feature_store_groups(spark):
    store = features.feature_store(bars(spark, [100.0 + i for i in range(30)]), ("price_volume", "knowledge_graph"))
    assert {r.feature_set for r in store.select("feature_set").distinct().collect()} == {"price_volume", "knowledge_graph"}
    with pytest.raises(ValueError, match="no feature groups"):
        features.feature_store(bars(spark, [1.0]), ("nothing",))


def test_cleaning_and_validation(spark):
    raw = spark.createDataFrame([(" spy ", "2024-01-01 10:00:00", "1.5", "x")], ["Ticker", "Date Time", "Close", "Volume"])
    row = preparation.clean_rows(raw.withColumnRenamed("Date Time", "datetime")).first()
    assert (row.symbol, row.close, row.volume) == ("SPY", 1.5, None) and row.ts is not None
    missing = preparation.invalid_rows(preparation.clean_rows(raw), "market").first().missing
    assert set(missing) == {"open", "high", "low", "volume"}


def test_imputation_and_flags(spark):
    b = preparation.impute(bars(spark, [None, 5.0, None], volumes=[None, 1.0, None])).orderBy("ts").collect()
    assert [x.close for x in b] == [None, 5.0, 5.0] and [x.volume for x in b] == [None, 1.0, 0.0]
    f = preparation.outlier_flags(bars(spark, [1.0, 1.0, 2.0, None, 2.0])).orderBy("ts").collect()
    assert [x.stale_price for x in f] == [False, True, False, False, False] and [x.price_jump for x in f] == [False, False, True, False, False]


def test_window_specs(spark):
    w = preparation.window_specs(spark, "2024-01-01", "2026-09-26", 180, 30, 30, 30, 5).orderBy("window_id").collect()
    assert w and all(x.train_end < x.validation_start and x.validation_end < x.test_start for x in w)
    assert w[-1].test_end <= dt.date(2026, 9, 26) and (w[1].train_start - w[0].train_start).days == 30
    e = preparation.window_specs(spark, "2024-01-01", "2026-09-26", 180, 30, 30, 30, 5, "expanding").collect()
    assert {x.train_start for x in e} == {dt.date(2024, 1, 1)}
    assert not preparation.window_specs(spark, "2024-01-01", "2024-02-01", 180, 30, 30, 30).collect()


def test_capped_weights(spark):
    w = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "symbol string, w double")
    got = {r.symbol: r.capped for r in evaluation.capped(w, "w", 0.5).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.375, "c": 0.125})
    assert {r.symbol: r.capped for r in evaluation.capped(w, "w", 0.4).collect()} == pytest.approx({"a": 0.4, "b": 0.4, "c": 0.2})
    assert {r.capped for r in evaluation.capped(w, "w", 0.3).collect()} == {0.3}


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w = models.fit_ridge(df, ["a", "b"], "y", 2.0)
    full = np.column_stack([x, np.ones(50)])
    want = np.linalg.solve(full.T @ full + 2.0 * np.diag([1, 1, 0]), full.T @ y)
    assert [w["a"], w["b"], w["intercept"]] == pytest.approx(want.tolist())
    assert models.predict_linear(df, w).columns[-1] == "prediction"


def test_multifractal_kernels():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=4096)
    h = timeseries.multifractal(noise, [16, 32, 64, 128])
    assert 0.35 < h["hurst"] < 0.65 and 0.35 < timeseries.rescaled_range(noise, [16, 32, 64, 128]) < 0.75
    cascade = timeseries.multifractal(timeseries.binomial_cascade(12, 0.25), [16, 32, 64, 128])
    assert cascade["width"] > h["width"]
    assert timeseries.multifractal(timeseries.surrogate(timeseries.binomial_cascade(12, 0.25), 3), [16, 32, 64, 128])["width"] < cascade["width"]
    assert timeseries.recurrence_rate(np.array([0.0, 1.0]), 0.5) == 0.5 and sum(timeseries.haar_energy(noise)) == pytest.approx(1)
    assert timeseries.detrended_cross_correlation(noise, noise, 64) == pytest.approx(1) and timeseries.histogram_entropy(np.array([1.0, 1.0])) == 0
    assert np.abs(np.fft.rfft(timeseries.surrogate(noise, 2, "phase"))) == pytest.approx(np.abs(np.fft.rfft(noise)))


def test_spanning_forest(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("a", "c", 0.5), ("d", "e", 0.1), ("c", "d", 0.2)], "a string, b string, weight double")
    got = {(r.a, r.b) for r in graphs.spanning_forest(e).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")}


def test_formulas():
    node = factors.call("group_zscore", factors.call("div", factors.operand("x"), factors.constant(2)))
    assert factors.parse(factors.serialize(node)) == node and node.depth() == 3
    assert factors.validate(node, ["y"]) == ["no operand x"] and factors.validate(factors.call("add", node), ["x"]) == ["add takes 2 arguments"]
    assert factors.validate(factors.operand("later"), ["later"], future=("later",)) == ["later lies in the future"]
    with pytest.raises(ValueError, match="cycle"):
        factors.schedule({"a": factors.operand("b"), "b": factors.operand("a")})


def test_text_functions(spark):
    row = spark.createDataFrame([("Good gain, #Tag #tag! Bad news. New York is up",)], "t string").select(T.hashtags("t").alias("h"), T.sentiment("t").alias("s"), T.sentences("t").alias("n"), T.title_spans("t").alias("e")).first()
    assert row.h == ["#tag"] and row.s == pytest.approx(0.5) and len(row.n) == 3 and "New York" in row.e
    urls = [("HTTP://User@Www.Example.com:80/a/?b=2&utm_x=1&a=1#f", "http://user@www.example.com/a?a=1&b=2", "example.com")]
    for url, want, domain in urls:
        r = spark.createDataFrame([(url,)], "u string").select(T.canonical_url("u", True).alias("c"), T.url_domain("u").alias("d")).first()
        assert (r.c, r.d) == (want, domain)


def test_feeds_pages_and_json(spark):
    rss = "<rss><channel><item><title>One  two</title><link>http://a/1</link><pubDate>x</pubDate><description>text</description></item><item><title>B</title></item></channel></rss>"
    got = readers.feed_items(spark.createDataFrame([(1, rss), (2, "broken <"), (3, None)], "id long, xml string")).collect()
    assert [(r.id, r.title, r.url, r.content) for r in got] == [(1, "One two", "http://a/1", "text"), (1, "B", "", "")]
    p = readers.parse_page('<html lang="en"><head><meta property="og:title" content="T"><title>x</title></head><body><p>a<b>b</b><script>no</script></p><p>c<a href="/l">d</a></html>')
    assert (p["title"], p["content"], p["lang"], p["links"]) == ("T", "ab\ncd", "en", 1)
    site = spark.createDataFrame([("<urlset xmlns='x'><url><loc> http://a/ </loc></url><url><loc>http://b/</loc></url></urlset>",)], "xml string")
    assert [r.url for r in readers.sitemap_urls(site).collect()] == ["http://a/", "http://b/"]
    api = spark.createDataFrame([('{"items": [{"link": "u", "name": "t", "body": "c"}]}',), ('[{"url": "v"}]',)], "json string")
    assert [(r.url, r.title) for r in readers.api_items(api).collect()] == [("u", "t"), ("v", None)]
    facts = spark.createDataFrame([(1, '{"facts": {"gaap": {"Assets": {"units": {"USD": [{"end": "2024-01-01", "val": 5, "form": "10-K"}, {"val": 6, "form": "8-K"}]}}}}}')], "cik long, json string")
    assert [(r.taxonomy, r.tag, r.unit, r.val) for r in readers.company_facts(facts, ["10-K"]).collect()] == [("gaap", "Assets", "USD", 5.0)]
    obs = spark.createDataFrame([("S", '{"observations": [{"date": "2024-01-01", "value": "1,000.5"}, {"date": "2024-01-02", "value": "."}]}')], "series_id string, json string")
    assert [(r.series_id, r.value) for r in readers.observations(obs).collect()] == [("S", 1000.5)]


def test_lake_and_sinks(spark, tmp_path):
    path = str(tmp_path / "lake")
    a = spark.createDataFrame([("A", 1, "1.5")], "ticker string, ts_day int, close string")
    a.write.parquet(path + "/one")
    spark.createDataFrame([("B", 2.5)], "symbol string, close double").write.parquet(path + "/two")
    got = {(r.symbol, r.close, r.source) for p in ("one", "two") for r in readers.lake(spark, [f"{path}/{p}"], readers.BAR_COLUMNS).collect()}
    assert got == {("A", 1.5, ""), ("B", 2.5, "")} and readers.lake(spark, [path + "/none"], readers.BAR_COLUMNS).columns == [s.name for s in readers.BAR_COLUMNS]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string")
    sinks.write_partitioned(df, str(tmp_path / "p"), ["k"], 2)
    sinks.write_partitioned(df.where("k = 'y'").withColumn("v", F.lit(9)), str(tmp_path / "p"), ["k"])
    assert {(r.v, r.k) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "x"), (9, "y")}
    for kind in ("csv", "jsonl", "parquet"):
        m = sinks.export(df, str(tmp_path / kind), kind)
        assert m["rows"] == 2 and m["columns"][0]["type"] == "int"
    assert sinks.path_token("a/b c") == "a_b_c"
    assert readers.page(df, 1, 1, "Y").collect()[0].v == 2


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "u", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = windows.windowed(windows.event_stream(spark, src, df.schema), "ts", ["event_type"], "5 minutes", late="1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = windows.windowed(df, "ts", ["event_type"], "5 minutes")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    ok, bad = [], []
    handle = windows.with_dead_letters(lambda d: ok.extend(d.collect()), lambda d: bad.extend(d.collect()), F.col("value") > 3)
    handle(df, 7)
    assert len(ok) == 6 and len(bad) == 4 and bad[0].batch == 7


def test_runner(spark):
    calls = []

    def step(spark, config, inputs):
        calls.append(config.get("n"))
        if config.get("fail") and len(calls) < 3:
            raise RuntimeError("again")
        return sum(inputs.values()) + config.get("n", 0)

    tasks = [runner.Task("b", step, ("a",), {"n": 2, "fail": True}, retries=2), runner.Task("a", step, (), {"n": 1})]
    state = {}
    first = runner.run(spark, tasks, state)
    assert first["b"]["result"] == 3 and first["b"]["status"] == "done"
    assert {v["status"] for v in runner.run(spark, tasks, state).values()} == {"skipped"}
    failing = [runner.Task("x", lambda *a: 1 / 0), runner.Task("y", step, ("x",))]
    assert {n: v["status"] for n, v in runner.run(spark, failing).items()} == {"x": "failed", "y": "blocked"}


def test_value_at_risk_definitions(spark):
    r = spark.createDataFrame([("s", float(x)) for x in range(-10, 10)], "symbol string, r double")
    v = evaluation.value_at_risk(r, "r", "symbol").first()
    assert v.var_interpolated == pytest.approx(9.05) and v.es == pytest.approx(10.0) and math.isfinite(v.var_round)


def test_digest_quotas(spark):
    d = spark.createDataFrame([(i, "en", f"s{i % 2}", i) for i in range(40)], "doc_id long, lang string, source string, n long")
    got = documents.digest(d, F.col("n"), 5, 8).collect()
    assert len(got) == 8 and {r.position for r in got} == set(range(1, 9))


def test_more_kernels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=2048)
    scales = [8, 16, 32, 64]
    assert 0.3 < timeseries.slopes(timeseries.moving_average_fluctuations(x, scales, (2.0,)), scales)[0] < 0.7
    assert np.allclose(timeseries.cross_fluctuations(x, x, scales, (2.0,)) ** 2, [[np.mean([np.var(w - np.polyval(np.polyfit(np.arange(s), w, 1), np.arange(s))) for w in x[: len(x) // s * s].reshape(-1, s)]) for s in scales]])
    masses = timeseries.partition_function(np.ones(64), [1, 2, 4], (0.0, 1.0, 2.0))
    assert masses[0].tolist() == [64, 32, 16] and masses[2] == pytest.approx([1 / 64, 1 / 32, 1 / 16]) and masses[1] == pytest.approx(masses[2])
    assert timeseries.robust_slope(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 4, 100])) == pytest.approx(18, abs=17) and 0.4 < timeseries.generalized_hurst(x) < 0.6
    assert timeseries.circular_autocorrelation(np.array([1.0, -1.0])) == pytest.approx(-1)
    for made in (timeseries.block_shuffle(x, 10, 1), timeseries.amplitude_adjusted_surrogate(x, 1), timeseries.surrogate(x, 1)):
        assert sorted(made) == pytest.approx(sorted(x))
    lo, hi = timeseries.bootstrap_interval(x, np.mean, 50, 0.9, 1)
    assert lo < 0.1 and hi > -0.1 and lo < hi
    for kind in ("gaussian", "mrw", "msm", "mmar"):
        s = timeseries.simulate(kind, 500, 2)
        assert len(s) == 500 and (s == timeseries.simulate(kind, 500, 2)).all()
    with pytest.raises(ValueError, match="no model"):
        timeseries.simulate("none", 5, 1)
