from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import availability, evaluation, graphs, performance, regimes, relations, stories
from quarry.plans import search
from quarry.plans.factors import call, compile_formula, operand
from quarry.sources import catalog
from quarry.streaming import control


def test_rank_hinge_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 40):
        p, t = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
        pairs = [max(0.0, 1 - np.sign(t[i] - t[j]) * (p[i] - p[j])) for i, j in itertools.combinations(range(n), 2) if t[i] != t[j]]
        assert performance.rank_hinge(p, t) == pytest.approx(np.mean(pairs) if pairs else 0.0)


def test_equal_residual_against_rounds(spark):
    def rounds(w, cap):
        w = {k: min(cap, max(0.0, v)) for k, v in w.items()}
        for _ in w:
            left, room = 1 - sum(w.values()), [k for k in w if w[k] < cap]
            if left <= 1e-12 or not room:
                break
            w |= {k: min(cap, w[k] + left / len(room)) for k in room}
        return w

    raw = {"a": 0.7, "b": 0.2, "c": 0.06, "d": 0.04, "e": 0.0}
    df = spark.createDataFrame(list(raw.items()), "symbol string, w double")
    for cap in (0.5, 0.3, 0.21):
        got = {r.symbol: r.capped for r in performance.equal_residual(df, "w", cap).collect()}
        assert got == pytest.approx(rounds(raw, cap)) and sum(got.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="cannot reach"):
        performance.equal_residual(df, "w", 0.1)
    with pytest.raises(ValueError, match="no positive sum"):
        performance.equal_residual(df.withColumn("w", F.lit(0.0)), "w", 0.5)


def test_rolling_windows_are_full(spark):
    r = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 0, 1.0)], "symbol string, ts int, x double")
    got = performance.rolling_windows(r, 4, 3).groupBy("symbol", "window_start").agg(F.sort_array(F.collect_list("ts")).alias("t")).collect()
    assert {(g.symbol, g.window_start): g.t for g in got} == {("a", s): list(range(s, s + 4)) for s in (0, 3, 6)}


def test_lookahead_and_leakage(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, t), (t, t + dt.timedelta(days=1)), (t, None)], "ts timestamp_ntz, available_at timestamp_ntz")
    assert availability.lookahead_rows(rows).count() == 1
    with pytest.raises(ValueError, match="known at"):
        availability.assert_no_lookahead(rows)
    availability.assert_no_lookahead(rows.where("available_at is null or available_at <= ts"))
    assert not availability.respects_availability(rows, "available_at", "ts").first().respected
    assert availability.respects_availability(rows.drop("available_at")).first().respected and availability.respects_availability(rows.limit(0), "available_at", "ts").first().respected
    assert availability.future_features(rows, "available_at", "ts").count() == 2
    assert availability.leakage_score(call("abs", operand("next")), ["x"], ("next",)) == 1.0 and availability.leakage_score(operand("x"), ["x"], ("next",)) == 0.0


def test_stories_against_one_pass_over_all(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        v = [rnd.random() for _ in range(4)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, start + dt.timedelta(hours=rnd.randint(0, 400)), rnd.sample(words, rnd.randint(0, 4)), rnd.sample(words, rnd.randint(0, 3)), [x / n for x in v] if i % 5 else [0.0] * 4))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, title array<string>, entities array<string>, vector array<double>")

    def jaccard(a, b):
        return round(len(set(a) & set(b)) / len(set(a) | set(b)), 4) if a and b else 0.0

    def like(a, b):
        cos, ent, title = sum(x * y for x, y in zip(a[4], b[4], strict=True)), jaccard(a[3], b[3]), jaccard(a[2], b[2])
        return round(0.45 * cos + 0.35 * ent + 0.20 * title, 4) if cos > 0 else round(0.55 * ent + 0.45 * title, 4)

    members: dict[int, list] = {}
    want = {}
    for a in sorted(rows, key=lambda r: (r[1], r[0])):
        scored = [(max(like(b, a) for b in m), -k) for k, (f, m) in enumerate(members.values()) if abs(a[1] - f) <= dt.timedelta(hours=73)]
        best = max(scored, default=(0, 0))
        keys = list(members)
        if best[0] >= 0.5:
            want[a[0]] = keys[-best[1]]
            members[keys[-best[1]]][1].append(a)
        else:
            want[a[0]] = a[0]
            members[a[0]] = (a[1], [a])
    got = {r.id: r.story for r in stories.stories(df).collect()}
    assert got == want and len(set(want.values())) < 50
    told = df.join(stories.stories(df).select("id", "story"), "id")
    tops = {s: {e for e, _ in sorted(pd.Series([e for r in told.collect() if r.story == s for e in set(r.entities)]).value_counts().items(), key=lambda x: (-x[1], x[0]))[:10]} for s in set(want.values())}
    first = {s: min(r[1] for r in rows if want[r[0]] == s) for s in tops}
    merged = {}
    for a, b in itertools.permutations(tops, 2):
        if (first[a], a) < (first[b], b) and jaccard(tops[a], tops[b]) >= 0.85:
            merged[b] = min([merged[b], a] if b in merged else [a], key=lambda s: (first[s], s))
    assert {r.story: r.merged_into for r in stories.merged_stories(told).collect()} == merged


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 75), (9, 9)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 50, 50: 50, 75: 50}
    assert graphs.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert [(r.node, r.component) for r in graphs.components(spark.createDataFrame([(7, 7), (None, 3)], "src long, dst long")).collect()] == [(7, 7)]


def test_components_broadcast_nothing(spark, monkeypatch):
    rounds, settle = [], graphs.settle

    def kept(df):
        out = settle(df)
        rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graphs, "settle", kept)
    chain = list(range(300))
    random.Random(3).shuffle(chain)
    got = graphs.components(spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "src long, dst long"))
    assert got.where("component = 0").count() == 300 == got.count()
    assert len(rounds) < 16 and not any("BroadcastExchange" in p for p in rounds)


def test_assumptions(spark):
    df = spark.createDataFrame([("news", "", False), ("omission", "", False), ("jobs", "ISIN", False), ("jobs", "", True), ("jobs", "", False)], "c string, i string, a boolean")
    got = [r.p for r in df.select(stories.assumption(F.col("c"), F.col("i"), F.col("a")).alias("p")).collect()]
    assert got == ["OWA", "PartialCWA", "UniqueNameAssumption", "NoUniqueNameAssumption", "CWA"]


def test_times_and_sessions(spark):
    texts = ["2026-05-08T10:00:00Z", "Fri, 08 May 2026 12:00:00 +0200", "Fri, 8 May 2026 10:00:00 GMT", " ", "soon", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(scalars.publication_time("s").cast("timestamp_ntz").alias("t")).collect()]
    assert got == [dt.datetime(2026, 5, 8, 10)] * 3 + [None] * 3
    rows = [(dt.datetime(2024, 7, 1, 13, 30), " nyse"), (dt.datetime(2024, 1, 2, 13, 30), "NYSE"), (dt.datetime(2024, 7, 6, 14), "NYSE"), (dt.datetime(2024, 7, 1, 7), "LSE"), (dt.datetime(2024, 7, 1, 7), "moon")]
    s = scalars.sessions(spark.createDataFrame(rows, "ts timestamp_ntz, x string"), "ts", "x").collect()
    assert [r.session for r in s] == ["regular", "closed", "closed", "regular", None] and scalars.market_windows(spark).count() == 11


def test_scalars(spark):
    r = spark.createDataFrame([("1.5", float("nan"), 0.4)], "s string, n double, r double").select(
        scalars.numeric_value("s").alias("a"), scalars.numeric_value(F.lit("x"), 7.0).alias("b"), scalars.nan_to_zero("n").alias("c"),
        scalars.corrected_correlation(F.col("r"), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("d"), scalars.path_token(F.lit(" / ")).alias("e"), scalars.filing_lag_days(F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date")).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.e, r.f) == (1.5, 7.0, 0.0, "__null__", 0) and r.d == pytest.approx(np.tanh(np.arctanh(0.4) * 2))
    line = spark.createDataFrame([("a", i, 2.0 * i + (i == 2)) for i in range(5)] + [("b", 0, 3.0)], "k string, i int, v double")
    got = {(x.k, x.i): x.residual for x in scalars.detrended(line, "v", "k", "i").collect()}
    y = np.array([0, 2, 5, 6, 8.0])
    assert [got["a", i] for i in range(5)] == pytest.approx((y - np.polyval(np.polyfit(np.arange(5), y, 1), np.arange(5))).tolist()) and got["b", 0] == 0
    v = {x.k: x.variation for x in scalars.path_variation(line, "v", "k", "i").collect()}
    assert v["a"] == pytest.approx(1.0) and v["b"] == 0


def test_catalog_and_robots(spark, tmp_path):
    (tmp_path / "feeds.json").write_text('[{"name": " A ", "url": "https://www.example.org:80/f", "category": "news", "tags": [" X ", ""], "source_tier": 1}, {"name": "a", "url": "ftp:/x", "category": "odd", "source_tier": 9}]')
    rows = catalog.load_catalog(spark, str(tmp_path / "feeds.json"))
    first = rows.where("name = 'A'").first()
    assert first.tags == ["x"] and first.language == "en" and first.cadence_minutes == 60
    domains = spark.createDataFrame([("example.org",)], "domain string")
    got = {(r.name, r.problem) for r in catalog.catalog_problems(rows, domains, ["news"]).collect()}
    assert got == {("A", "name repeats"), ("a", "name repeats"), ("a", "unknown category"), ("a", "unknown tier"), ("a", "domain not allowed")}
    with pytest.raises(ValueError, match="a: domain not allowed"):
        catalog.check_catalog(rows, domains, ["news"])
    assert catalog.check_catalog(rows.limit(1), domains, ["news"]).count() == 1
    pages = spark.createDataFrame([("https://x.org/a",), ("https://x.org/private/b",), ("https://y.org/private",), (None,)], "url string")
    robots = spark.createDataFrame([("https://x.org", "User-agent: *\nDisallow: /private")], "origin string, rules string")
    assert {r.url: r.allowed for r in catalog.may_fetch(pages, robots, "bot").collect()} == {"https://x.org/a": True, "https://x.org/private/b": False, "https://y.org/private": True, None: False}
    with pytest.raises(ValueError, match="no adapter"):
        catalog.adapter("carrier pigeon")
    assert catalog.adapter("sitemap")("<urlset><url><loc>https://x.org/</loc></url></urlset>") == [{"url": "https://x.org/"}]


def test_connectors(spark):
    one = lambda text: spark.createDataFrame([(text,), (None,), ("{}",)], "payload string")
    f = catalog.frames(one('{"data": [{"cik": 7, "entityName": "X", "val": 1.5, "end": "2024-01-01"}]}'), "us-gaap", "Assets").collect()
    assert [(r.cik, r.value, r.tag) for r in f] == [(7, 1.5, "Assets")]
    m = catalog.series_metadata(one('{"seriess": [{"id": "GDP", "title": "Output"}]}')).collect()
    assert [(r.series_id, r.title, r.units) for r in m] == [("GDP", "Output", "")]


def test_stores(spark, tmp_path):
    store = catalog.FactorValues(spark, f"file://{tmp_path}/factors")
    assert store.latest("f") is None
    with pytest.raises(ValueError, match="no values"):
        store.read("f")
    for version, n in (("1", 1), ("2", 2)):
        store.write("f", version, spark.range(n))
    assert store.read("f").count() == 2
    rows = spark.createDataFrame([("S", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)], "symbol string, ts timestamp_ntz")
    from quarry.operators import preparation

    specs = preparation.window_specs(spark, "2024-01-01", "2024-02-09", 20, 5, 5, 5)
    health = catalog.build_dataset(rows, specs, f"file://{tmp_path}", "d one", least=30)
    assert {(r.window_id, r.train_rows, r.test_rows, r.enough_rows) for r in health.collect()} == {(i, 20, 5, True) for i in range(3)}
    assert catalog.inspect_dataset(spark, f"file://{tmp_path}", "d one", 1).count() == 1
    assert spark.read.parquet(f"file://{tmp_path}/dataset=d_one/rows").count() == 90
    assert pd.read_parquet(__import__("io").BytesIO(catalog.parquet_bytes([{"a": 1}, {"a": 2}])))["a"].tolist() == [1, 2]
    assert catalog.save_model_dataset(rows, f"file://{tmp_path}/m", {"w": 1})["rows"] == 40


def test_papers(spark):
    assert catalog.paged_chunks([]) == [] and catalog.paged_chunks([(1, " a b "), (2, "c" * 10), (3, "d")], 12) == [(0, 1, 1, "a b", 2), (1, 2, 3, "c" * 10 + "\nd", 2)]
    chunks = catalog.chunk_papers(spark.createDataFrame([(1, 2, "walk forward"), (1, 1, "first page"), (2, 1, None)], "paper long, page int, text string"), 12)
    assert {(r.paper, r.chunk, r.first_page) for r in chunks.collect()} == {(1, 0, 1), (1, 1, 2)}
    found = catalog.search_chunks(chunks, "Walk-forward!").collect()
    assert [(r.chunk, r.score) for r in found] == [(1, 1.0)] and catalog.search_chunks(chunks, "?").count() == 0
    with pytest.raises(RuntimeError, match="pypdf"):
        catalog.pdf_pages(b"")


def test_distributions_of_odd_arrays(spark):
    df = spark.createDataFrame([([], [1.0], {}, {"a": 1.0}), ([0.0, -1.0], [None, 2.0], {"b": 1.0}, {"b": 3.0})], "a array<double>, b array<double>, m map<string,double>, n map<string,double>")
    p, q = search.aligned_maps(F.col("m"), F.col("n"))
    got = df.select(search.entropy(F.col("a")).alias("e"), search.gini(F.col("b")).alias("g"), search.cosine(F.col("a"), F.col("b")).alias("c"), search.js_divergence(p, q).alias("j"), search.jaccard(F.col("a"), F.col("b")).alias("k"), search.coverage_ratio(F.col("b"), F.col("a")).alias("r")).collect()
    assert [(r.e, r.g, r.c, r.k, r.r) for r in got] == [(0, 0, 0, 0, 0), (0, 0, 0, 0, 0)] and got[1].j == 0


def test_searches_repeat(spark):
    rows = spark.createDataFrame([(f"s{i % 5}", f"e{i}", i, float(i % 7), float(i), float(i % 3)) for i in range(40)], "g string, e string, t int, x double, y double, goal double")
    limits = search.Limits(("x", "y"), ("goal",), max_depth=3)
    a, b = (search.random_search(rows, 8, limits, "goal", "g", "e", ["t"], 3) for _ in range(2))
    assert a == b and a and all(s.score >= 0 and search.allowed(s.formula, limits) for s in a)
    frame, c = compile_formula(rows, a[0].formula, "g", "e", ["t"])
    values = frame.select(c.alias("v"), "goal").toPandas()
    if values["v"].nunique() > 1:
        assert a[0].utility == pytest.approx(abs(values["v"].corr(values["goal"])), abs=1e-6)
    best, winners = search.genetic_search(rows, 6, 2, limits, "goal", "g", "e", ["t"], 3)
    assert len(winners) == 2 and best == sorted(best) and search.scored_rows(spark, winners).count() == 2
    leaking = search.Scored("n", operand("goal"), 0.5, 0.5, 0.2, 0, 0.0)
    assert search.without_leak(leaking, limits).leakage == 1.0


def test_source_health_over_two_days(spark):
    t = dt.datetime(2024, 1, 1)
    kinds = "source long, at timestamp_ntz, succeeded boolean, items long, error string"
    none = spark.createDataFrame([], "source long, last_attempt_at timestamp_ntz, last_success_at timestamp_ntz, last_status string, item_count long, consecutive_failures long, cooldown_until timestamp_ntz, last_error string")
    one = control.recorded(none, spark.createDataFrame([(1, t, False, None, "x"), (2, t, True, 5, None)], kinds))
    two = control.recorded(one, spark.createDataFrame([(1, t + dt.timedelta(hours=1), False, None, "y")], kinds))
    got = {r.source: r for r in two.collect()}
    assert (got[1].consecutive_failures, got[1].cooldown_until, got[1].last_error) == (2, t + dt.timedelta(hours=1, minutes=5), "y")
    assert (got[2].last_status, got[2].item_count, got[2].consecutive_failures) == ("succeeded", 5, 0)
    sources = spark.createDataFrame([(1, True, 60), (2, True, 60), (3, True, 60), (4, False, 1)], "source long, is_enabled boolean, cadence_minutes int")
    assert [r.source for r in control.due_sources(sources, two, "2024-01-01 01:03:00", 9).collect()] == [2, 3]


def test_limits_queue_and_registries():
    now = [0.0]
    bucket = control.TokenBucket(2, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.try_acquire() and bucket.try_acquire() and not bucket.try_acquire()
    with pytest.raises(control.TooFast):
        bucket.acquire(block=False)
    bucket.acquire()
    assert now[0] == 1.0
    limits = control.WindowLimits({"api": [(60, 2), (3600, 3)]})
    assert [limits.check("api", "k", 10.0)[0] for _ in range(3)] == [True, True, False] and limits.check("api", "k", 70.0)[0] and not limits.check("api", "k", 130.0)[0] and limits.check("none", "k", 0.0)[0]
    q, seen = control.Queue(), []
    a = q.publish("t", {"n": 1})
    assert q.consume("t", seen.append) == 1 and seen == [{"n": 1}] and a in q.done and not q.retry(a) and not q.dead_letter(a)
    b = q.publish("t", {"n": 2})
    with pytest.raises(ZeroDivisionError):
        q.consume("t", lambda m: 1 / 0)
    assert q.retry(b) and q.consume("t", seen.append) == 1 and len(seen) == 2
    parts = control.default_components()
    assert parts.names("model") and parts.is_enabled("source", "rss")
    parts.register(control.Component("odd", "model", int, needs="no_such_library"))
    with pytest.raises(RuntimeError, match="needs"):
        parts.resolve("model", "odd")
    with pytest.raises(KeyError, match="no model"):
        parts.get("model", "x")


def test_places_and_costs():
    here, there = control.Profile("local", frozenset({"a", "b"}), 100), control.Profile("cloud", frozenset({"a", "b", "c"}), 10**9, "cuda", 2.0)
    assert control.placed(["a", "c"], 10, here, there) == {"a": "local", "c": "cloud"} and control.placed(["a"], 1000, here, there) == {"a": "cloud"}
    with pytest.raises(ValueError, match="no place"):
        control.placed(["z"], 1, here, there)
    assert control.chosen_backend(there) == ("cpu", True) and control.chosen_backend(there, available=("cpu", "cuda")) == ("cuda", False)
    assert [c["profile"] for c in control.costs(1000, 2, [here, there])] == ["cloud", "local"]
    p = control.Profiler()
    with p.step("x", 10) as s:
        s["rows"] = 20
    assert p.summary()["rows"] == 20 and "too long" not in p.failures()


def test_graph_snapshot_and_resilience(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", -2.0), ("a", "c", 0.5)], "a string, b string, w double")
    assert [(r.a, r.b) for r in relations.strongest_edges(edges, "w").collect()] == [("b", "c"), ("a", "b")]
    relations.save_snapshot(edges, f"file://{tmp_path}", "g", seed="1")
    about = spark.read.json(f"file://{tmp_path}/g/about").first()
    assert (about.nodes, about.edges, about.seed) == (3, 3, "1")
    assert regimes.density_regime(regimes.graph_densities(edges.select(F.lit(1).alias("t"), F.col("a").alias("src"), F.col("b").alias("dst")), "t"), "t").first().regime == "dense_graph"


def test_capped_extremes(spark):
    w = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.0)], "symbol string, w double")
    assert {r.symbol: r.capped for r in evaluation.capped(w, "w", 0.6).collect()} == pytest.approx({"a": 0.6, "b": 0.4, "c": 0.0})
    assert evaluation.capped(w.limit(0), "w", 0.6).count() == 0


def naive_exponent(x, scales, q):
    """Slope of ln F_q against ln s: windows from both ends, a straight line off each, one window at a time."""
    profile = np.cumsum(x - np.mean(x))
    points = []
    for s in scales:
        n = len(profile) // s
        parts = [profile[i * s : (i + 1) * s] for i in range(n)] + [profile[len(profile) - (i + 1) * s : len(profile) - i * s] for i in range(n)]
        v = [np.mean((p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s))) ** 2) for p in parts]
        f = np.exp(0.5 * np.mean(np.log(v))) if q == 0 else np.mean(np.power(v, q / 2)) ** (1 / q)
        points.append((np.log(s), np.log(f)))
    return np.polyfit(*zip(*points, strict=True), 1)[0]


def naive_width(x, scales, q=(-4.0, -2.0, 0.0, 2.0, 4.0)):
    tau = [k * naive_exponent(x, scales, k) - 1 for k in q]
    alpha = np.gradient(np.array(tau), np.array(q))
    return alpha.max() - alpha.min()


@pytest.fixture(scope="module")
def log_returns(spark):
    from quarry.operators.market import returns
    from quarry.sources.market import daily_bars, hourly_bars

    def of(bars):
        out: dict[str, list] = {}
        for r in returns(bars(spark, SF)).orderBy("symbol", "ts").collect():
            out.setdefault(r.symbol, []).append((r.ts, r.log_return))
        return out

    return of(hourly_bars), of(daily_bars)


SF = "/root/testdata/sf0.001"


def test_series_queries_against_naive_kernels(spark, log_returns):
    from quarry import registry
    from quarry.operators import timeseries

    hourly, daily = log_returns
    got = {r.symbol: r for r in registry.QUERIES["series_features"](spark, SF).collect()}
    assert got.keys() == hourly.keys()
    for k, rows in hourly.items():
        x, r = np.array([v for _, v in rows]), got[k]
        assert r.n == len(x)
        if len(x) >= 128:
            assert r.hurst == pytest.approx(naive_exponent(x, [8, 16, 32, 64], 2.0)) and r.width == pytest.approx(naive_width(x, [8, 16, 32, 64]))
        else:
            assert r.hurst is None or np.isnan(r.hurst)
        counts = np.histogram(x, 4)[0] / len(x)
        assert r.entropy == pytest.approx(-sum(p * np.log2(p) for p in counts if p)) and r.recurrence == pytest.approx(np.mean(np.abs(x[:, None] - x[None, :]) <= 0.1 * x.std()))
    windows = {(r.symbol, r.ts): r.hurst for r in registry.QUERIES["rolling_exponents"](spark, SF).collect()}
    want = {(k, rows[i + 127][0]): naive_exponent(np.array([v for _, v in rows[i : i + 128]]), [8, 16, 32], 2.0) for k, rows in daily.items() for i in range(0, len(rows) - 127, 32)}
    assert windows == pytest.approx(want)
    spectra = {r.symbol: r for r in registry.QUERIES["series_surrogates"](spark, SF).collect()}
    for k, rows in hourly.items():
        x = np.array([v for _, v in rows])
        if len(x) < 64:
            assert k not in spectra
            continue
        low, high = np.quantile(x, [0.01, 0.99])
        assert spectra[k].width == pytest.approx(naive_width(x, [8, 16, 32])) and spectra[k].clipped == pytest.approx(naive_width(np.clip(x, low, high), [8, 16, 32]))
        shuffles = [naive_width(np.random.default_rng(1 + i).permutation(x), [8, 16, 32]) for i in range(5)]
        assert spectra[k].shuffled == pytest.approx(np.mean(shuffles)) and sorted(timeseries.amplitude_adjusted_surrogate(x, 1)) == sorted(x)


def test_text_queries_against_plain_versions(spark):
    from quarry import registry

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict[int, list] = {}
    for r in sorted(registry.QUERIES["documents_chunks"](spark, SF).collect(), key=lambda r: (r.doc_id, r.position)):
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == {i for i, t in docs.items() if t}
    for i, rows in got.items():
        text = docs[i]
        assert rows[0].char_start == 0 and rows[-1].char_end == len(text) and all(r.chunk == text[r.char_start : r.char_end] and 0 < len(r.chunk) <= 2000 for r in rows)
        for a, b in itertools.pairwise(rows):
            assert b.char_start == max(a.char_end - 200, a.char_start + 1)
            cut = [k for k in range(a.char_start + 1000, a.char_start + 2000) if text[k] in " \n"]
            assert a.char_end == (cut[-1] if cut else a.char_start + 2000)
    turns = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in registry.QUERIES["conversations_summarized"](spark, SF).collect():
        s = [x.strip() for x in __import__("re").findall(r"[^.!?]+[.!?]*", " ".join(turns[r.conv_id, r.turn].split())) if x.strip()]
        sets = [set(__import__("re").findall(r"[a-z0-9]+", x.lower())) for x in s]
        like = [[len(a & b) / len(a | b) if i != j and a | b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        rank = [1.0] * len(s)
        for _ in range(12):
            rank = [0.15 + 0.85 * sum(x * y for x, y in zip(row, rank, strict=True)) for row in like]
        assert set(r.summary) <= set(s) and len(r.summary) == min(3, len(s))
        if len({round(x, 4) for x in rank}) == len(rank):
            best = sorted(sorted(range(len(s)), key=lambda i: -rank[i])[:3])
            assert r.summary == [s[i] for i in best]
    slices: dict[str, list] = {}
    for r in registry.QUERIES["documents_topics"](spark, SF).collect():
        slices.setdefault(r.slice, []).append((r.doc_id, r.topic_id))
    from quarry.operators.documents import keyword_rows

    words = {r.doc_id: set(r.keywords) for r in keyword_rows(spark.read.parquet(f"{SF}/documents.parquet"), 5).collect()}
    for rows in slices.values():
        topics: list[tuple[int, set]] = []
        for i, topic in sorted(rows):
            own = next((t for t in topics if len(t[1] & words[i]) >= 2), None)
            if own is None:
                topics.append((i, set(words[i])))
            else:
                own[1].update(words[i])
            assert topic == (own[0] if own else i)


def test_scales_and_checks():
    from quarry.operators import timeseries as ts

    assert ts.scale_grid(512, count=4) == [8, 20, 51, 128] and ts.scale_grid(40, 10, 10) == [10]
    with pytest.raises(ValueError, match="no scales"):
        ts.scale_grid(5)
    points = [(s, 3.0 * s**0.7) for s in (8, 16, 32, 64)]
    for robust in (False, True):
        d = ts.scaling_diagnostic([*points, (0, 1.0), (128, float("nan"))], robust)
        assert d["slope"] == pytest.approx(0.7) and d["r2"] == pytest.approx(1) and (d["scales"], d["lowest"], d["highest"]) == (4, 8, 64)
    with pytest.raises(ValueError, match="are needed"):
        ts.scaling_diagnostic(points[:2])
    x = np.random.default_rng(3).normal(size=600)
    f = ts.finite_size_check(x, [8, 16, 32], 1, 3)
    assert f["is_short"] == 0 and f["bias"] == pytest.approx(f["width"] - f["width_control"]) and abs(f["bias"]) < 1
    e = ts.extreme_sensitivity(np.append(x, [50.0, -50.0]), [8, 16, 32])
    assert e["sensitivity"] > 0 and ts.extreme_sensitivity(x, [8, 16, 32], method="trimmed")["n"] < len(x)
    v = ts.volatility_forecast(5, 40, 2)
    assert v["p05"] <= v["p50"] <= v["p95"] and v == ts.volatility_forecast(5, 40, 2) and len(set(ts.switching_volatility(30, 1, switch=0.0))) == 1
    m = ts.modes(np.array([1.0, 2.0]))
    assert m["missing"] == "PyEMD" and m["energies"] == [5.0] and m["error"] == 0
    values = list("abcdefgh")
    assert ts.shuffled_training(values, [0, 1, 2, 3, 4], kind="patches", patch=2) == list("ecdabfgh") and sorted(ts.shuffled_training(values, [0, 1, 2], 1)) == values
    assert ts.shuffled_training(values, [0, 1, 2], 1)[3:] == values[3:] and ts.shuffled_training(values, [1], kind="none") == values


def test_boosted_baseline(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 10 > 4)) for i in range(200)], "x double, y double")
    model = __import__("quarry.operators.models", fromlist=["x"]).boosted_baseline(rows, ["x"], "y", 3)
    assert all((r.prediction > 0.5) == (r.y > 0.5) for r in model.transform(rows).collect())


def test_checks_of_identity_and_flags(spark):
    from quarry.operators import checks

    with pytest.raises(ValueError, match="name, frequency"):
        checks.check_identity(" ", "s", "")
    checks.check_identity("n", "s", "1d")
    rows = [(1, "t", "word " * 20, "2024"), (2, None, None, None), (3, "t", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "x"), (4, "t", "one one two two three three four four five five six six", "x")]
    got = {r.doc_id: r.flags for r in checks.document_flags(spark.createDataFrame(rows, "doc_id int, title string, text string, published string"), "title", "text", "published").collect()}
    assert got == {1: ["repeated_tokens"], 2: ["missing_title", "missing_published_at", "short_content"], 3: [], 4: ["short_content"]}
    assert checks.checked_claims(spark.createDataFrame([("a", " ", None, "e")], "subject string, predicate string, object string, evidence string")).first().errors == ["missing_predicate", "missing_object"]


def test_passages_of_any_length(spark):
    from quarry.operators import knowledge

    texts = ["smart is long, and wide open today! x", "is long, and", "", None, "?? no", "a b c d e f g h"]
    passages = ["art is long, and wid", "is long, and", "is", "??", "x", "b c d e f g", "b c d e f g h i", "", "no such thing at all here today", " b c "]
    got = {(r.doc_id, r.item_id): r.char_start for r in knowledge.evidence(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")).collect()}
    assert got == {(i, k): t.index(p) for i, t in enumerate(texts) for k, p in enumerate(passages) if t and p and p in t}
    none = spark.createDataFrame([], "item_id long, text string")
    assert knowledge.evidence(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none).count() == 0


def test_ticks_of_price_zero(spark):
    texts = spark.createDataFrame([(1, '{"price":0.0,"volume":"2"}'), (2, '{"price":0,"last":5,"volume":2}'), (3, '{"last":0.0,"volume":2}'), (4, '{"volume":2}')], "i int, j string")
    f = scalars.tick("j")
    got = {r.i: (r.p, r.d, r.s) for r in texts.select("i", f["price"].alias("p"), f["dollar_volume"].alias("d"), f["dollar_volume_source"].alias("s")).collect()}
    assert got == {1: (0.0, 0.0, "computed"), 2: (5.0, 10.0, "computed"), 3: (0.0, 0.0, "computed"), 4: (None, None, "provided")}
