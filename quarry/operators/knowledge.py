"""Knowledge operators: chunks and evidence, entities and events, topics, alerts, framing, source groups, rules and risk propagation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.functions.numeric import digits, ratio
from quarry.operators.documents import _sql_list, _WORDS, keyword_rows
from quarry.operators.graphs import EDGES_SQL, trade_edges
from quarry.operators.market import dig
from quarry.registry import query
from quarry.sources.market import table

# chunks and evidence


def chunk_spans(text: str, size: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of at most `size` characters that overlap; a chunk ends at the last white space of its second half, if there is one."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            space = max(text.rfind(" ", start + size // 2, end), text.rfind("\n", start + size // 2, end))
            end = space if space > 0 else end
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """`doc_id, position, char_start, char_end, chunk` of each document; null and empty texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (s, e) in enumerate(chunk_spans(t or "", size, overlap))]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "position", "char_start", "char_end", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position int, char_start int, char_end int, chunk string")


@query("documents_chunks")
def _chunks(spark, sf):
    return chunks(table(spark, sf, "documents"))


def evidence(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Where documents hold the passages (item_id, text), exactly: the first place of each, as characters from 0.

    A passage's inner words, without its first and last, stand as whole words wherever it stands; up to five of them are
    its key, and documents are searched for runs of as many words. Passages without inner words are keyed by their first
    three characters. Only documents with a passage's key are compared with the whole passage. Empty passages are nowhere.
    """
    words = T.words("text")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.least(F.lit(5), F.size(words) - 2)))
    p = passages.where(F.length("text") > 0).select("item_id", F.col("text").alias("passage"), inner.alias("inner"))
    long, short = p.where(F.size("inner") > 0), p.where(F.size("inner") == 0)
    w = docs.select("doc_id", T.words("text").alias("w"))
    sizes = [r[0] for r in long.select(F.size("inner")).distinct().collect()]  # 1 to 5
    hits = None

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))

    def parts_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))

    for n in sizes:
        keyed = w.where(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(runs_of(n))).alias("key"))
        found = keyed.join(long.where(F.size("inner") == n).select("item_id", F.array_join("inner", " ").alias("key")), "key").select("doc_id", "item_id")
        hits = found if hits is None else hits.union(found)
    for n in [r[0] for r in short.select(F.least(F.lit(3), F.length("passage"))).distinct().collect()]:
        keyed = docs.where(F.length("text") >= n).select("doc_id", F.explode(F.array_distinct(parts_of(n))).alias("key"))
        found = keyed.join(short.where(F.least(F.lit(3), F.length("passage")) == n).select("item_id", F.substring("passage", 1, n).alias("key")), "key").select("doc_id", "item_id")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = docs.select("doc_id").limit(0).crossJoin(passages.select("item_id").limit(0))
    located = hits.distinct().join(p.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return located.withColumn("char_start", F.expr("locate(passage, text) - 1")).where("char_start >= 0").select("doc_id", "item_id", "char_start", F.sha2("passage", 256).alias("evidence_hash"))


@query("passages_located", "SELECT doc_id, item_id, CAST(strpos(d.text, b.text) - 1 AS INT) AS char_start, sha256(b.text) AS evidence_hash FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _evidence(spark, sf):
    return evidence(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# entities, events, framing

#: Words that mark kinds of events, in the order in which ties are decided; words of attribution, doubt and heat.
EVENT_WORDS = {"earnings": ["earnings", "profit", "revenue"], "merger": ["merger", "acquire", "acquisition"], "lawsuit": ["lawsuit", "court", "sued"], "hiring": ["hire", "hiring", "appointed"], "launch": ["launch", "release", "unveil"]}
ATTRIBUTION, MODALS, LOADED = ["said", "says", "according", "told", "reported"], ["may", "might", "could", "should", "would"], ["shocking", "massive", "outrage", "disaster", "crisis"]


def entities(docs: DataFrame) -> DataFrame:
    """Capitalised spans of each document and how often each name occurs anywhere; names are joined by their normal form."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    found = docs.select("doc_id", F.explode(T.title_spans("text")).alias("name")).withColumn("entity", normal(F.col("name")))
    return found.groupBy("entity").agg(F.count_distinct("doc_id").alias("documents"), F.min("name").alias("name"))


@query("entities", r"WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){0,4}'))) AS name FROM documents) SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS entity, count(DISTINCT doc_id) AS documents, min(name) AS name FROM f GROUP BY 1")
def _entities(spark, sf):
    return entities(table(spark, sf, "documents"))


def framing(docs: DataFrame) -> DataFrame:
    """Shares of words of attribution, doubt and heat, the density of quotation marks, and sentiment."""
    w = T.words("text")
    share = lambda group: F.round(F.coalesce(ratio(F.size(F.filter(F.col("w"), lambda x: x.isin(group))).cast("double"), F.size("w").cast("double")), F.lit(0.0)), 8)
    d = docs.select("doc_id", "text", w.alias("w"))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    return d.select("doc_id", share(ATTRIBUTION).alias("attribution"), share(MODALS).alias("modal"), share(LOADED).alias("loaded"), F.round(F.coalesce(ratio(quotes.cast("double"), F.length("text").cast("double")), F.lit(0.0)), 8).alias("quotes"), F.round(T.sentiment("text"), 8).alias("sentiment"))


def _share_sql(group: list[str]) -> str:
    return f"round(coalesce(len(list_filter(w, lambda x: x IN {_sql_list(group)}))::DOUBLE / nullif(len(w), 0), 0), 8)"


@query("framing", f"WITH t AS (SELECT doc_id, text, {_WORDS} AS w FROM documents) SELECT doc_id, {_share_sql(ATTRIBUTION)} AS attribution, {_share_sql(MODALS)} AS modal, {_share_sql(LOADED)} AS loaded, round(coalesce((length(text) - length(replace(text, '\"', '')))::DOUBLE / nullif(length(text), 0), 0), 8) AS quotes, round(CASE WHEN len(list_filter(w, lambda x: x IN {_sql_list(T.POSITIVE + T.NEGATIVE)})) > 0 THEN (len(list_filter(w, lambda x: x IN {_sql_list(T.POSITIVE)})) - len(list_filter(w, lambda x: x IN {_sql_list(T.NEGATIVE)}))) / len(list_filter(w, lambda x: x IN {_sql_list(T.POSITIVE + T.NEGATIVE)})) ELSE 0.0 END, 8) AS sentiment FROM t")
def _framing(spark, sf):
    return framing(table(spark, sf, "documents"))


def event_type(text: Column) -> Column:
    """The kind of event with the most marking words; `other` without any; of equals the first."""
    w = T.words(text)
    hits = lambda group: F.size(F.filter(w, lambda x: x.isin(group)))
    scores = F.array(*[F.struct((-hits(g)).alias("n"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, g) in enumerate(EVENT_WORDS.items())])
    best = F.array_sort(scores)[0]
    return F.when(best["n"] < 0, best["name"]).otherwise("other")


def divergence(counts: DataFrame, group: str, item: str, n: str) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of each group's distribution of items from that of all groups together."""
    totals = counts.groupBy(group).agg(F.sum(n).alias("t"))
    everything = counts.groupBy(item).agg(F.sum(n).alias("a"))
    grand = counts.agg(F.sum(n).alias("z"))
    p = counts.join(totals, group).join(everything, item).crossJoin(F.broadcast(grand)).select(group, (F.col(n) / F.col("t")).alias("p"), (F.col("a") / F.col("z")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = 0.5 * F.col("p") * F.ln(F.col("p") / m) + 0.5 * F.col("q") * F.ln(F.col("q") / m)
    # items that the group lacks add q ln 2 / 2 each
    g = p.groupBy(group).agg(F.sum(part).alias("d"), F.sum("q").alias("covered"))
    return g.select(group, (F.col("d") + 0.5 * np.log(2.0) * (1 - F.col("covered"))).alias("divergence"))


@query("source_language_divergence", f"WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT DISTINCT source FROM c), l AS (SELECT lang, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY lang), j AS (SELECT s.source, coalesce(c.n, 0) / (SELECT sum(n) FROM c x WHERE x.source = s.source) AS p, q FROM s CROSS JOIN l LEFT JOIN c ON c.source = s.source AND c.lang = l.lang) SELECT source, round(sum(0.5 * CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + 0.5 * q * ln(2 * q / (p + q))), 8) AS divergence FROM j GROUP BY source")
def _divergence(spark, sf):
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return divergence(c, "source", "lang", "n").select("source", F.round("divergence", 8).alias("divergence"))


def source_groups(docs: DataFrame, by: list[list[str]]) -> DataFrame:
    """Counts for several choices of columns at once, `*` where a column was not chosen: grouping sets over one scan."""
    columns = sorted({c for g in by for c in g})
    sets = [[F.col(c) for c in g] for g in by]
    g = docs.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.grouping_id().alias("gid"))
    bit = lambda c: F.shiftright("gid", len(columns) - 1 - columns.index(c)).bitwiseAND(F.lit(1)) == 1
    return g.select(*[F.when(bit(c), "*").otherwise(F.col(c)).alias(c) for c in columns], "n", "mean_chars")


@query("source_groups", f"SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS n, {dig('avg(n_chars)', 'mean_chars')} FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def _groups(spark, sf):
    return source_groups(table(spark, sf, "documents"), [["lang"], ["source"], ["lang", "source"]]).select("lang", "source", "n", digits("mean_chars").alias("mean_chars"))


# embeddings, summaries, topics


def hashed_embedding(text: str, dim: int = 128) -> list[float]:
    """Counts of words in buckets by their SHA-256, scaled to length 1; no words: zeros."""
    v = np.zeros(dim)
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        v[int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % dim] += 1
    n = float(np.sqrt((v * v).sum()))
    return [round(float(x) / n, 6) if n else 0.0 for x in v]


def embeddings(docs: DataFrame, dim: int = 128) -> DataFrame:
    """`doc_id` and the hashed embedding, as columns of an aggregation: words are counted, then buckets."""
    w = docs.select("doc_id", F.explode(T.words("text")).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    bucket = F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("long") % dim
    b = w.groupBy("doc_id", bucket.cast("int").alias("b")).agg(F.sum("n").alias("n"))
    g = b.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    return g.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.round(F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("l"), 6)).alias("embedding"))


@query("documents_embedded", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), b AS (SELECT doc_id, CAST(CAST(('0x' || substring(sha256(w), 1, 8)) AS BIGINT) % 128 AS INT) AS b, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM b GROUP BY doc_id) SELECT doc_id, b AS bucket, round(n / l, 6) AS part FROM b JOIN l USING (doc_id)")
def _embedded(spark, sf):
    e = embeddings(table(spark, sf, "documents"))
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "part")).where("part <> 0")


def textrank(text: str, keep: int = 3, rounds: int = 12, damping: float = 0.85) -> list[str]:
    """The highest-ranked sentences in their order; sentences are linked by the Jaccard likeness of their words."""
    s = [x.strip() for x in re.findall(r"[^.!?]+[.!?]*", " ".join(text.split())) if x.strip()]
    sets = [frozenset(re.findall(r"[a-z0-9]+", x.lower())) for x in s]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    if not vocabulary:
        return s[:keep]
    m = np.zeros((len(s), len(vocabulary)), np.float32)
    for i, ws in enumerate(sets):
        m[i, [vocabulary[w] for w in ws]] = 1
    common = m @ m.T
    size = m.sum(axis=1)
    like = common / np.maximum(size[:, None] + size[None, :] - common, 1)
    np.fill_diagonal(like, 0)
    rank = np.ones(len(s))
    for _ in range(rounds):
        rank = (1 - damping) + damping * like @ rank
    best = sorted(np.argsort(-rank, kind="stable")[:keep])
    return [s[i] for i in best]


@query("conversations_summarized")
def _summaries(spark, sf):
    @F.pandas_udf("array<string>")
    def summary(t: pd.Series) -> pd.Series:
        return t.map(lambda x: textrank(x or ""))

    return table(spark, sf, "conversations").select("conv_id", "turn", summary("text").alias("summary"))


def topics(docs: DataFrame, shared: int = 2) -> DataFrame:
    """Greedy topics of documents (doc_id, slice, keywords): in order of id a document joins the first topic of its slice with `shared` words in common, which takes its words.

    Sequential by nature, so each slice is one task's; slices are what grows.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, set]] = []
        out = []
        for i, words in sorted(zip(g["doc_id"], g["keywords"], strict=True), key=lambda r: r[0]):
            w = set(words)
            topic = next((t for t in found if len(t[1] & w) >= shared), None)
            if topic is None:
                topic = (int(i), set())
                found.append(topic)
            topic[1].update(w)
            out.append((int(i), topic[0]))
        return pd.DataFrame(out, columns=["doc_id", "topic_id"]).assign(slice=g["slice"].iloc[0])

    return docs.groupBy("slice").applyInPandas(one, "doc_id long, topic_id long, slice string")


@query("documents_topics")
def _topics(spark, sf):
    k = keyword_rows(table(spark, sf, "documents"), 5, "lang", "source")
    return topics(k.select("doc_id", F.concat_ws("/", "lang", "source", (F.col("doc_id") / 500).cast("int")).alias("slice"), "keywords"))


# alerts, rules, risk

#: Weights of an alert's parts; least scores of severities.
ALERT_WEIGHTS = {"volume": 0.20, "novelty": 0.20, "diversity": 0.15, "trend": 0.15, "market": 0.10, "entities": 0.10, "sentiment": 0.10}
SEVERITIES = (("critical", 0.85), ("high", 0.70), ("medium", 0.50))


def alert_scores(parts: DataFrame) -> DataFrame:
    """The weighted score of the parts, each cut to 0 to 1, and its severity."""
    score = F.lit(0.0)
    for name, w in ALERT_WEIGHTS.items():
        score = score + w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(0.0))))
    scored = parts.withColumn("score", F.round(score, 3))
    severity = F.lit("low")
    for name, least in reversed(SEVERITIES):
        severity = F.when(F.col("score") >= least, name).otherwise(severity)
    return scored.withColumn("severity", severity)


@query("alerts", """WITH g AS (SELECT source, least(1.0, count(*) / 60.0) AS volume, count(DISTINCT lang) / 4.0 AS diversity, least(1.0, avg(n_chars) / 3000.0) AS trend, count(DISTINCT n_chars)::DOUBLE / count(*) AS novelty FROM documents GROUP BY source),
    s AS (SELECT source, round(0.2 * volume + 0.2 * novelty + 0.15 * diversity + 0.15 * trend, 3) AS score FROM g) SELECT source, score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM s""")
def _alerts(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("l"), F.avg("n_chars").alias("c"), F.count_distinct("n_chars").alias("u"))
    zero = F.lit(0.0)
    parts = d.select("source", (F.col("n") / 60.0).alias("volume"), (F.col("l") / 4.0).alias("diversity"), (F.col("c") / 3000.0).alias("trend"), (F.col("u") / F.col("n")).alias("novelty"), zero.alias("market"), zero.alias("entities"), zero.alias("sentiment"))
    return alert_scores(parts).select("source", "score", "severity")


def propagate_risk(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Signals (node, score) on the far ends of edges, either way: score * weight * confidence, at most 1; the strongest counts."""
    either = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "weight", "confidence").union(edges.select("dst", "src", "weight", "confidence"))
    hit = signals.join(either, "node").select(F.col("to").alias("node"), F.least(F.lit(1.0), F.col("score") * F.col("weight") * F.col("confidence")).alias("score"))
    return hit.groupBy("node").agg(F.max("score").alias("score"), F.count("*").alias("paths"))


@query("risk_propagated", f"WITH {EDGES_SQL}, b AS (SELECT src AS node, dst AS t, weight FROM e UNION ALL SELECT dst, src, weight FROM e), s(node, score) AS (VALUES (1, 0.9), (2, 0.4)) SELECT t AS node, {dig('max(least(1.0, score * weight / 200 * 0.8))', 'score')}, count(*) AS paths FROM b JOIN s USING (node) GROUP BY t")
def _risk(spark, sf):
    e = trade_edges(spark, sf).withColumns({"weight": F.col("weight") / 200, "confidence": F.lit(0.8)})
    r = propagate_risk(spark.createDataFrame([(1, 0.9), (2, 0.4)], "node int, score double"), e)
    return r.select("node", digits("score").alias("score"), "paths")


def apply_rules(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Beliefs from rules: each has a name, `when` ({column: value or list of values}), `unless` (the same) and `then` (a belief)."""

    def holds(criteria: dict) -> Column:
        c = F.lit(True)
        for k, v in criteria.items():
            c = c & F.coalesce(F.col(k).isin(v if isinstance(v, list) else [v]), F.lit(False))
        return c

    derived = [F.when(holds(r["when"]) & (~holds(r["unless"]) if r.get("unless") else F.lit(True)), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["then"]).alias("belief"))) for r in rules]
    return facts.select(*facts.columns, F.explode(F.array_compact(F.array(*derived))).alias("d")).select(*facts.columns, "d.rule", "d.belief")


@query("rules_applied", "SELECT c_custkey, 'r1' AS rule, 'valued' AS belief FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_nationkey = 3 UNION ALL SELECT c_custkey, 'r2', 'watched' FROM customer WHERE c_nationkey IN (3, 5)")
def _rules(spark, sf):
    rules = [{"name": "r1", "when": {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "unless": {"c_nationkey": 3}, "then": "valued"}, {"name": "r2", "when": {"c_nationkey": [3, 5]}, "then": "watched"}]
    return apply_rules(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), rules).select("c_custkey", "rule", "belief")


def same_group_edges(rows: DataFrame, node: str, group: str) -> DataFrame:
    """Membership edges from each node to its group's hub, in place of an edge for each pair of members."""
    return rows.select(F.col(node).alias("src"), F.concat(F.lit(f"{group}:"), F.col(group).cast("string")).alias("dst"), F.lit(f"same_{group}").alias("kind")).distinct()


@query("group_edges", "SELECT DISTINCT s_suppkey AS src, 's_nationkey:' || s_nationkey AS dst, 'same_s_nationkey' AS kind FROM supplier")
def _edges(spark, sf):
    return same_group_edges(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey")


def ntriples(edges: DataFrame) -> DataFrame:
    """Edges (src, kind, dst) as N-Triples lines."""
    iri = lambda c: F.concat(F.lit("<urn:node:"), F.regexp_replace(F.col(c).cast("string"), r"[^A-Za-z0-9._-]", "_"), F.lit(">"))
    return edges.select(F.concat_ws(" ", iri("src"), F.concat(F.lit("<urn:edge:"), F.col("kind"), F.lit(">")), iri("dst"), F.lit(".")).alias("triple"))


@query("edges_ntriples", "SELECT DISTINCT '<urn:node:' || s_suppkey || '> <urn:edge:same_s_nationkey> <urn:node:s_nationkey_' || s_nationkey || '> .' AS triple FROM supplier")
def _triples(spark, sf):
    return ntriples(_edges(spark, sf))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time: a union, one sort, and a window of last values."""
    r = right.select(key, time, F.lit(0).alias("__side"), F.struct(*values).alias("__v"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema[0].dataType).alias("__row"))
    rows = left.select(key, time, F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct("*").alias("__row"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return r.union(rows).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


@query("orders_as_of_events", "SELECT o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id, ts)) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts - INTERVAL 9490 DAY")
def _as_of(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("k"), F.expr("ts - INTERVAL 9490 DAYS").alias("t")).agg(F.max("event_id").alias("event_id"))
    return as_of(orders, e, "k", "t", ["event_id"]).select("o_orderkey", "event_id")


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, and which: `added` or `removed`; rows of both are left out."""
    added, removed = after.exceptAll(before).distinct(), before.exceptAll(after).distinct()
    return added.withColumn("change", F.lit("added")).union(removed.withColumn("change", F.lit("removed")))


_BUCKETS = "SELECT DISTINCT event_type, user_id, CAST(floor(value / 10) AS BIGINT) AS bucket FROM events WHERE ts"


@query("set_changes", f"SELECT *, 'added' AS change FROM (({_BUCKETS} >= TIMESTAMP '2024-01-15') EXCEPT ({_BUCKETS} < TIMESTAMP '2024-01-15')) UNION ALL SELECT *, 'removed' FROM (({_BUCKETS} < TIMESTAMP '2024-01-15') EXCEPT ({_BUCKETS} >= TIMESTAMP '2024-01-15'))")
def _changes(spark, sf):
    e = table(spark, sf, "events")
    part = lambda c: e.where(c).select("event_type", "user_id", F.floor(F.col("value") / 10).alias("bucket")).distinct()
    return set_changes(part("ts < timestamp_ntz '2024-01-15'"), part("ts >= timestamp_ntz '2024-01-15'"))
