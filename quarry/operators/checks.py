"""Checks of claims, documents and datasets; recent alerts and risks; what a question names; values of factors on a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T
from quarry.functions.numeric import ratio
from quarry.operators.documents import _CLAIMS_SQL, claims
from quarry.operators.features import feature_store
from quarry.registry import query
from quarry.sources.market import hourly_bars, table


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def checked_claims(c: DataFrame) -> DataFrame:
    """`errors` of claims (subject, predicate, object, evidence) that lack a part, and `status`: active without any, else incomplete."""
    errors = F.array_compact(F.array(*[F.when(blank(F.col(n)), F.lit(f"missing_{n}")) for n in ("subject", "predicate", "object", "evidence")]))
    return c.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") == 0, "active").otherwise("incomplete"))


@query("claims_checked", f"WITH {_CLAIMS_SQL}, k AS (SELECT conv_id, turn, subject, CASE WHEN turn % 3 = 0 THEN ' ' ELSE predicate END AS predicate, CASE WHEN turn % 2 = 0 THEN NULL ELSE object END AS object FROM c) SELECT conv_id, turn, subject, array_to_string(list_filter([CASE WHEN trim(predicate) = '' THEN 'missing_predicate' END, CASE WHEN object IS NULL THEN 'missing_object' END], lambda e: e IS NOT NULL), ',') AS errors, CASE WHEN trim(predicate) = '' OR object IS NULL THEN 'incomplete' ELSE 'active' END AS status FROM k")
def _claims(spark, sf):
    c = claims(table(spark, sf, "conversations"))
    k = c.withColumns({"predicate": F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("predicate")), "object": F.when(F.col("turn") % 2 != 0, F.col("object")), "evidence": F.lit("turn")})
    return checked_claims(k).select("conv_id", "turn", "subject", F.array_join("errors", ",").alias("errors"), "status")


#: A text of fewer characters is short; from so many words on, a share of one word above this is repetition.
SHORT, WORDS, REPEATED = 80, 12, 0.35


def document_flags(docs: DataFrame, title: str, text: str, published: str) -> DataFrame:
    """`flags`: missing_title, missing_published_at, short_content and repeated_tokens (one word makes up more than 35 % of twelve or more), as they apply. Null texts are empty."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    d = docs.withColumn("__w", w)
    # Of sorted words the longest run of equals.
    runs = F.aggregate(F.array_sort("__w"), F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")), lambda a, x: F.struct(x.alias("w"), F.when(a["w"] == x, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["m"], F.when(a["w"] == x, a["n"] + 1).otherwise(1)).alias("m")))["m"]
    flags = [(blank(F.col(title)), "missing_title"), (F.col(published).isNull(), "missing_published_at"), (F.length(F.coalesce(F.col(text), F.lit(""))) < SHORT, "short_content"), ((F.size("__w") >= WORDS) & (runs > REPEATED * F.size("__w")), "repeated_tokens")]
    return d.withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))).drop("__w")


@query("documents_flagged", "WITH w AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'title' END AS title, doc_id % 7 = 0 AS undated, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM w) GROUP BY doc_id, x), m AS (SELECT doc_id, max(n) AS m, sum(n) AS s FROM c GROUP BY doc_id) SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN undated THEN 'missing_published_at' END, CASE WHEN length(text) < 80 THEN 'short_content' END, CASE WHEN s >= 12 AND m > 0.35 * s THEN 'repeated_tokens' END], lambda f: f IS NOT NULL), ',') AS flags FROM w LEFT JOIN m USING (doc_id)")
def _flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, " ").otherwise("title").alias("title"), F.when(F.col("doc_id") % 7 != 0, F.lit("2024-01-01")).alias("published"))
    return document_flags(d, "title", "text", "published").select("doc_id", F.array_join("flags", ",").alias("flags"))


def check_identity(name: str, source: str, frequency: str) -> None:
    """An error that names what of a dataset's identity is blank."""
    missing = [n for n, v in (("name", name), ("source", source), ("frequency", frequency)) if not (v or "").strip()]
    if missing:
        raise ValueError(f"a dataset needs {', '.join(missing)}")


def multifractal_rows(store: DataFrame) -> DataFrame:
    """Rows of a long feature store with a time whose set or name speaks of multifractals: that word within, or mf in front."""
    speaks = lambda c: F.lower(c).contains("multifractal") | F.lower(c).startswith("mf")
    return store.where(F.col("ts").isNotNull() & (speaks("feature_set") | speaks("feature_name")))


@query("features_multifractal_view")
def _multifractal(spark, sf):
    return multifractal_rows(feature_store(hourly_bars(spark, sf), ("price_volume", "multifractal"))).groupBy("feature_name").agg(F.count("*").alias("n"))


# alerts


#: Severities that count as high, most severe first.
HIGH = ["critical", "high"]


def high_risks(alerts: DataFrame, factors: DataFrame, most: int = 5, each: int = 3) -> DataFrame:
    """The latest `most` alerts of high severity (alert, severity, score, detected_at, occurred_at), by times and then alert, with
    the probability in percent and the names of their `each` strongest factors (alert, factor, weight)."""
    top = alerts.where(F.lower("severity").isin(HIGH)).orderBy(F.desc("detected_at"), F.desc("occurred_at"), "alert").limit(most)
    w = Window.partitionBy("alert").orderBy(F.desc("weight"), "factor")
    strong = factors.join(top.select("alert"), "alert").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    names = strong.groupBy("alert").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "factor"))), lambda x: x["factor"]), ",").alias("factors"))
    percent = F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).cast("int")
    return top.join(names, "alert", "left").select("alert", "severity", percent.alias("probability_percent"), F.coalesce("factors", F.lit("")).alias("factors"), "detected_at")


@query("alerts_high_risk", "WITH a AS (SELECT user_id AS alert, CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' ELSE 'low' END AS severity, avg(value) / 100 AS score, max(ts) AS detected_at, min(ts) AS occurred_at FROM events GROUP BY 1, 2), t AS (SELECT * FROM a WHERE lower(severity) IN ('critical', 'high') ORDER BY detected_at DESC, occurred_at DESC, alert LIMIT 5), f AS (SELECT user_id AS alert, event_type AS factor, round(sum(value), 4) AS weight FROM events GROUP BY 1, 2), s AS (SELECT alert, string_agg(factor, ',' ORDER BY r) AS factors FROM (SELECT f.*, row_number() OVER (PARTITION BY f.alert ORDER BY weight DESC, factor) AS r FROM f JOIN t ON f.alert = t.alert) WHERE r <= 3 GROUP BY alert) SELECT t.alert, severity, CAST(round(100 * greatest(0.0, least(1.0, score))) AS INT) AS probability_percent, coalesce(factors, '') AS factors, detected_at FROM t LEFT JOIN s ON s.alert = t.alert")
def _high(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    level = F.when(F.col("alert") % 4 == 0, "critical").when(F.col("alert") % 4 == 1, "High").otherwise("low")
    a = e.groupBy(F.col("user_id").alias("alert")).agg((F.avg("value") / 100).alias("score"), F.max("ts").alias("detected_at"), F.min("ts").alias("occurred_at")).withColumn("severity", level)
    f = e.groupBy(F.col("user_id").alias("alert"), F.col("event_type").alias("factor")).agg(F.round(F.sum("value"), 4).alias("weight"))
    return high_risks(a, f)


def recent_clusters(clusters: DataFrame, now: str, hours: int = 24, most: int = 100) -> DataFrame:
    """Active clusters that were updated within `hours` and not merged, the latest first, at most `most`: those for which alerts are made."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return clusters.where((F.col("status") == "active") & F.col("merged_into").isNull() & (F.col("updated_at") >= since)).orderBy(F.desc("updated_at"), "cluster").limit(most)


@query("clusters_recent", "WITH c AS (SELECT user_id AS cluster, max(ts) AS updated_at, CASE WHEN user_id % 3 = 0 THEN 'closed' ELSE 'active' END AS status, CASE WHEN user_id % 5 = 0 THEN user_id - 1 END AS merged_into FROM events GROUP BY user_id) SELECT cluster, updated_at FROM c WHERE status = 'active' AND merged_into IS NULL AND updated_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 240 HOUR ORDER BY updated_at DESC, cluster LIMIT 100")
def _recent(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("cluster")).agg(F.max("ts").cast("timestamp_ntz").alias("updated_at"))
    c = c.withColumns({"status": F.when(F.col("cluster") % 3 == 0, "closed").otherwise("active"), "merged_into": F.when(F.col("cluster") % 5 == 0, F.col("cluster") - 1)})
    return recent_clusters(c, "2024-01-20 00:00:00", 240).select("cluster", "updated_at")


# questions and evidence


def named_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (question, entity): entities of names (entity, name, is_alias) that a question's text names.

    A name is named where its text lies within the question, and a canonical one also where all its words do. Names are
    keyed by their first word, which a question must have at a word's edge or within; so questions are joined by the
    suffixes of their words, never with all names.
    """
    q = questions.select("question", F.lower("text").alias("text"), F.array_distinct(T.words("text")).alias("tokens"))
    n = names.select("entity", F.lower(F.trim("name")).alias("name"), "is_alias").where("name <> ''").withColumn("words", T.words("name"))
    n = n.withColumn("k", F.element_at(F.filter(F.concat("words", F.array(F.col("name"))), lambda w: w != ""), 1))
    parts = F.array_distinct(F.flatten(F.transform("tokens", lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.sequence(F.lit(1), F.length(w) - i + 1), lambda m: F.substr(w, i, m)))))))
    keyed = q.withColumn("k", F.explode(parts))
    met = keyed.join(n, "k")
    said = F.contains(F.col("text"), F.col("name")) | (~F.col("is_alias") & (F.size("words") > 0) & (F.size(F.array_except("words", "tokens")) == 0))
    return met.where(said).select("question", "entity").distinct()


@query("questions_parsed", "WITH q AS (SELECT item_id AS question, lower(array_to_string(string_split(text, ' ')[1:12], ' ')) AS text, list_distinct(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:12], ' ')), '[a-z0-9]+')) AS tokens FROM benchmark), n AS (SELECT doc_id AS entity, lower(array_to_string(string_split(trim(text), ' ')[1:1], ' ')) AS name, doc_id % 2 = 0 AS is_alias FROM documents WHERE lang = 'en'), w AS (SELECT *, regexp_extract_all(name, '[a-z0-9]+') AS words FROM n WHERE trim(name) <> '') SELECT DISTINCT question, entity FROM q JOIN w ON len(words) > 0 AND (contains(text, name) OR (NOT is_alias AND len(list_filter(words, lambda x: NOT list_contains(tokens, x))) = 0))")
def _questions(spark, sf):
    first = lambda c, n: F.array_join(F.slice(F.split(c, " "), 1, n), " ")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), first(F.col("text"), 12).alias("text"))
    n = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("entity"), first(F.trim("text"), 1).alias("name"), (F.col("doc_id") % 2 == 0).alias("is_alias"))
    return named_entities(q, n.where(F.size(T.words("name")) > 0))


def evidence(justifications: DataFrame, beliefs: DataFrame) -> DataFrame:
    """How many pieces of evidence for and against each of the beliefs there are, their summed weight, and the first; none gives zeros."""
    side = lambda p: F.col("polarity") == p
    g = justifications.join(beliefs.select("belief"), "belief", "left_semi").groupBy("belief").agg(F.count_if(side("positive")).alias("supporting"), F.count_if(side("negative")).alias("contradicting"), F.sum("weight").alias("weight"), F.min("evidence").alias("first"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("supporting", "contradicting")}
    return beliefs.select("belief").distinct().join(g, "belief", "left").withColumns({**zero, "weight": F.coalesce("weight", F.lit(0.0))})


@query("beliefs_evidence", f"WITH {_CLAIMS_SQL}, j AS (SELECT lower(subject) AS belief, polarity, 1.0::DOUBLE AS weight, conv_id * 1000 + turn AS evidence FROM c), b AS (SELECT DISTINCT belief FROM j WHERE length(belief) % 2 = 0 UNION SELECT 'nothing like it') SELECT b.belief, count(*) FILTER (WHERE polarity = 'positive') AS supporting, count(*) FILTER (WHERE polarity = 'negative') AS contradicting, coalesce(sum(weight), 0) AS weight, min(evidence) AS first FROM b LEFT JOIN j ON j.belief = b.belief GROUP BY b.belief")
def _evidence(spark, sf):
    j = claims(table(spark, sf, "conversations")).select(F.lower("subject").alias("belief"), "polarity", F.lit(1.0).alias("weight"), (F.col("conv_id") * 1000 + F.col("turn")).alias("evidence"))
    b = j.where(F.length("belief") % 2 == 0).select("belief").distinct().union(spark.createDataFrame([("nothing like it",)], "belief string"))
    return evidence(j, b)


def mean_confidence(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The mean to two places, halves to even, of decimals; groups without a value have 0."""
    return rows.groupBy(by).agg(F.coalesce(F.bround(F.avg(F.col(value).cast("decimal(18,6)")), 2), F.lit(0)).cast("double").alias("confidence"))


@query("confidence_means", "SELECT event_type, round_even(avg(CAST(round(value, 2) AS DECIMAL(18, 6)))::DOUBLE, 2) AS confidence FROM events GROUP BY event_type")
def _confidence(spark, sf):
    return mean_confidence(table(spark, sf, "events").withColumn("v", F.round("value", 2)), "event_type", "v")


def factor_on(frame: DataFrame, values: DataFrame, name: str, as_of: str, entity: str = "entity_id") -> DataFrame:
    """The frame with a factor's latest value known at `as_of` for each entity, 0 where there is none (values: entity, as_of, value)."""
    known = values.where(F.col("as_of") <= F.lit(as_of).cast("timestamp_ntz")).groupBy(entity).agg(F.max_by("value", F.struct("as_of", "value")).alias("__v"))
    return frame.join(known, entity, "left").withColumn(name, F.coalesce("__v", F.lit(0.0))).drop("__v")


@query("factor_latest", "WITH k AS (SELECT user_id, arg_max(round(value, 4), (ts, round(value, 4))) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND user_id % 2 = 0 GROUP BY user_id) SELECT DISTINCT e.user_id AS entity_id, coalesce(v, 0.0) AS factor FROM events e LEFT JOIN k ON k.user_id = e.user_id")
def _latest(spark, sf):
    e = table(spark, sf, "events")
    values = e.where("user_id % 2 = 0").select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp_ntz").alias("as_of"), F.round("value", 4).alias("value"))
    return factor_on(e.select(F.col("user_id").alias("entity_id")).distinct(), values, "factor", "2024-01-10")


class Snapshot:
    """A folder of Parquet tables as SQL views of their names."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]) -> None:
        self.spark = spark
        for n in names:
            spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def count(self, name: str) -> int:
        return self.spark.table(name).count()

    def by_type(self, name: str, column: str) -> DataFrame:
        """Rows of a table by a column's value, the most frequent first."""
        return self.spark.table(name).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


@query("snapshot_events", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def _snapshot(spark, sf):
    s = Snapshot(spark, sf, ["events"])
    return s.by_type("events", "event_type").select("event_type", "n", F.round(ratio(F.col("n").cast("double"), F.lit(float(s.count("events")))), 6).alias("share"))
