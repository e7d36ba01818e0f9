"""Distributions and sets as operands, the seed factors, and searches for factors: random and evolved formulas, scored in one aggregation."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.market import dig
from quarry.operators.settling import settle
from quarry.plans.factors import Node, call, compile_formula, constant, evaluate_all, operand, serialize, validate
from quarry.registry import query
from quarry.sources.market import table


# distributions and sets


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def weights(values: Column) -> Column:
    """An array's non-negative parts of their sum; all 0 without a positive one."""
    cut = F.transform(values, lambda v: F.greatest(F.lit(0.0), F.coalesce(v.cast("double"), F.lit(0.0))))
    return F.transform(cut, lambda v: F.coalesce(ratio(v, _sum(cut)), F.lit(0.0)))


def entropy(values: Column) -> Column:
    """Entropy in bits."""
    return _sum(F.transform(weights(values), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))


def gini(values: Column) -> Column:
    return 1.0 - _sum(F.transform(weights(values), lambda p: p * p))


def _aligned(a: Column, b: Column) -> tuple[Column, Column]:
    """Two arrays as weights of one length, the shorter padded with 0; of maps use `aligned_maps` first."""
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(weights(x), i), F.lit(0.0)))
    return pad(a), pad(b)


def aligned_maps(a: Column, b: Column) -> tuple[Column, Column]:
    """The values of two maps by the sorted union of their keys, 0 where a key is missing."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    of = lambda m: F.transform(keys, lambda k: F.coalesce(F.element_at(m, k).cast("double"), F.lit(0.0)))
    return of(a), of(b)


def kl_divergence(a: Column, b: Column) -> Column:
    """In bits, over the places where both have weight."""
    p, q = _aligned(a, b)
    return _sum(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0)))


def js_divergence(a: Column, b: Column) -> Column:
    """In bits; symmetric, from 0 to 1 for weights that sum to 1."""
    p, q = _aligned(a, b)
    half = lambda x, m: F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)
    return _sum(F.zip_with(p, q, lambda x, y: (half(x, (x + y) / 2) + half(y, (x + y) / 2)) / 2))


def cosine(a: Column, b: Column) -> Column:
    p, q = _aligned(a, b)
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u * v))
    return F.coalesce(ratio(dot(p, q), F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets of texts; two empty ones give 0."""
    return F.coalesce(ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def coverage_ratio(a: Column, b: Column) -> Column:
    """The share of the second set that the first has; an empty one gives 0."""
    return F.coalesce(ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(b)).cast("double")), F.lit(0.0))


def set_count(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def graph_value(x: Column) -> Column:
    """1 for a value that is there and is not 0, else 0."""
    return F.when(F.coalesce(x.cast("double"), F.lit(0.0)) != 0, 1.0).otherwise(0.0)


_DIST_SQL = """l AS (SELECT source, map_from_entries(list((lang, n) ORDER BY lang)) AS m, list(n ORDER BY lang) AS v, list(lang ORDER BY lang) AS k, sum(n) AS t FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source), a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), z AS (SELECT list(n ORDER BY lang) AS v, list(lang ORDER BY lang) AS k, sum(n) AS t FROM a),
    p AS (SELECT source, l.v AS v, l.k AS k, z.k AS zk, list_transform(z.k, lambda x: coalesce(l.m[x], 0) / l.t) AS p, list_transform(z.v, lambda x: x / z.t) AS q FROM l, z)"""


@query("factor_distributions", f"""WITH {_DIST_SQL} SELECT source, {dig('list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END))', 'entropy', 6)}, {dig('1 - list_sum(list_transform(p, lambda x: x * x))', 'gini', 6)},
    round(list_sum(list_transform(list_zip(p, q), lambda x: CASE WHEN x[1] > 0 AND x[2] > 0 THEN x[1] * log2(x[1] / x[2]) ELSE 0 END)), 6) AS kl, round(list_sum(list_transform(list_zip(p, q), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) / 2)), 6) AS js,
    {dig('list_cosine_similarity(p, q)', 'cosine', 6)}, {dig('len(k) / len(zk)', 'jaccard', 6)}, {dig('len(k) / len(zk)', 'coverage', 6)}, len(k) AS languages FROM p""")
def _distributions(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entries = lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n"))))
    own = d.groupBy("source").agg(entries().alias("m"))
    everything = d.groupBy("lang").agg(F.sum("n").alias("n")).agg(entries().alias("z"))
    j = own.crossJoin(F.broadcast(everything))  # one row, as many entries as there are languages
    p, q = aligned_maps(F.col("m"), F.col("z"))
    f = j.select("source", p.alias("p"), q.alias("q"), F.map_keys("m").alias("k"), F.map_keys("z").alias("zk"))
    p, q, k, zk = (F.col(c) for c in ("p", "q", "k", "zk"))
    return f.select("source", digits(entropy(p), 6).alias("entropy"), digits(gini(p), 6).alias("gini"), F.round(kl_divergence(p, q), 6).alias("kl"), F.round(js_divergence(p, q), 6).alias("js"), digits(cosine(p, q), 6).alias("cosine"), digits(jaccard(k, zk), 6).alias("jaccard"), digits(coverage_ratio(k, zk), 6).alias("coverage"), set_count(k).cast("long").alias("languages"))


# seeds


def _share(name: str, of: str) -> Node:
    return call("div", operand(name), call("max", constant(1), call(of, operand(name))))


#: The factors that a search starts from, as formulas over operands of a source and an event; distributions come as their entropies and divergences.
SEEDS: dict[str, Node] = {
    "coverage_intensity": _share("article_count", "group_mean"),
    "provider_amplification": call("group_zscore", _share("article_reach_weight", "group_sum")),
    "owner_amplification": call("group_zscore", _share("article_reach_weight", "group_sum")),
    "omission_pressure": call("max", constant(0), call("sub", call("group_median", operand("claim_coverage")), operand("claim_coverage"))),
    "entity_omission": call("max", constant(0), call("sub", call("group_median", operand("claim_coverage")), operand("claim_coverage"))),
    "framing_divergence": operand("frame_divergence"),
    "provider_frame_concentration": operand("frame_entropy"),
    "claim_conflict": call("add", operand("stance_entropy"), call("add", call("log1p", operand("contradiction_edge_count")), operand("disagreement_provider_diversity"))),
    "event_conflict_risk": call("mul", call("zscore", call("group_sum", operand("claim_conflict"))), call("mul", call("log1p", operand("event_source_count")), operand("frame_entropy"))),
    "amplified_conflict_risk": call("mul", operand("event_conflict_risk"), call("mul", operand("provider_amplification"), operand("provider_frame_concentration"))),
    "evidence_density": call("div", operand("evidence_span_count"), call("max", constant(1), operand("article_count"))),
    "evidence_asymmetry": call("abs", call("sub", operand("evidence_span_count"), call("group_mean", operand("evidence_span_count")))),
    "syndication_pressure": call("log1p", operand("syndication_edge_count")),
    "narrative_velocity": call("div", operand("article_count"), constant(24)),
    "narrative_acceleration_shock": call("abs", operand("narrative_velocity")),
    "graph_spread": call("log1p", operand("graph_degree")),
    "provider_dependency": _share("article_count", "group_sum"),
    "coverage_uniqueness": call("div", constant(1), call("max", constant(1), call("group_sum", operand("article_count")))),
}


def seed_factors(rows: DataFrame, group: str, entity: str, order: list[str]) -> DataFrame:
    """All seed factors as columns beside the rows' own."""
    return evaluate_all(rows, SEEDS, group, entity, order)


_OPERANDS_SQL = "n AS (SELECT source, lang, count(*) AS article_count, sum(n_chars) / 1000.0 AS article_reach_weight, count(DISTINCT n_chars) AS claim_coverage, count(*) FILTER (WHERE n_chars % 5 = 0) AS evidence_span_count, count(*) - count(DISTINCT sha256(text)) AS syndication_edge_count, count(DISTINCT n_chars % 17) AS graph_degree, count(*) FILTER (WHERE n_chars % 3 = 0) AS contradiction_edge_count FROM documents GROUP BY 1, 2), o AS (SELECT *, count(*) OVER (PARTITION BY lang) AS event_source_count FROM n)"


def operands(docs: DataFrame) -> DataFrame:
    """The driver's documents as operands of (source, lang): a source's coverage of an event."""
    from pyspark.sql import Window

    n = docs.groupBy("source", "lang").agg(
        F.count("*").alias("article_count"), (F.sum("n_chars") / 1000.0).alias("article_reach_weight"), F.count_distinct("n_chars").alias("claim_coverage"), F.count_if(F.col("n_chars") % 5 == 0).alias("evidence_span_count"),
        (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("syndication_edge_count"), F.count_distinct(F.col("n_chars") % 17).alias("graph_degree"), F.count_if(F.col("n_chars") % 3 == 0).alias("contradiction_edge_count"),
    )
    w = Window.partitionBy("lang")
    zero = {c: F.lit(0.0) for c in ("frame_divergence", "disagreement_provider_diversity")}
    share = F.col("contradiction_edge_count") / F.col("article_count")
    both = F.array(share, 1 - share)
    return n.withColumns({"event_source_count": F.count("*").over(w), "frame_entropy": entropy(both), "stance_entropy": entropy(both), **zero})


_SEED_COLUMNS = ["coverage_intensity", "provider_amplification", "omission_pressure", "claim_conflict", "event_conflict_risk", "amplified_conflict_risk", "evidence_density", "evidence_asymmetry", "syndication_pressure", "narrative_acceleration_shock", "graph_spread", "provider_dependency", "coverage_uniqueness"]


@query("factor_seeds", f"""WITH {_OPERANDS_SQL}, s AS (SELECT *, contradiction_edge_count / article_count AS c FROM o), e AS (SELECT *, CASE WHEN c > 0 THEN -c * log2(c) ELSE 0 END + CASE WHEN c < 1 THEN -(1 - c) * log2(1 - c) ELSE 0 END AS h, article_reach_weight / greatest(1, sum(article_reach_weight) OVER g) AS reach FROM s WINDOW g AS (PARTITION BY lang)),
    f AS (SELECT *, h + ln(1 + contradiction_edge_count) AS claim_conflict, coalesce((reach - avg(reach) OVER g) / nullif(stddev_samp(reach) OVER g, 0), 0) AS provider_amplification, sum(h + ln(1 + contradiction_edge_count)) OVER g AS gs FROM e WINDOW g AS (PARTITION BY lang)),
    r AS (SELECT *, coalesce((gs - avg(gs) OVER ()) / nullif(stddev_samp(gs) OVER (), 0), 0) * ln(1 + event_source_count) * h AS event_conflict_risk FROM f)
    SELECT source, lang, {dig('article_count / greatest(1, avg(article_count) OVER g)', 'coverage_intensity', 5)}, round(provider_amplification, 5) AS provider_amplification, {dig('greatest(0, quantile_cont(claim_coverage, 0.5) OVER g - claim_coverage)', 'omission_pressure', 5)}, {dig('claim_conflict', n=5)}, round(event_conflict_risk, 5) AS event_conflict_risk, round(event_conflict_risk * provider_amplification * h, 5) AS amplified_conflict_risk,
    {dig('evidence_span_count / greatest(1, article_count)', 'evidence_density', 5)}, {dig('abs(evidence_span_count - avg(evidence_span_count) OVER g)', 'evidence_asymmetry', 5)}, {dig('ln(1 + syndication_edge_count)', 'syndication_pressure', 5)}, {dig('article_count / 24', 'narrative_acceleration_shock', 5)}, {dig('ln(1 + graph_degree)', 'graph_spread', 5)}, {dig('article_count / greatest(1, sum(article_count) OVER g)', 'provider_dependency', 5)}, {dig('1 / greatest(1, sum(article_count) OVER g)', 'coverage_uniqueness', 5)}
    FROM r WINDOW g AS (PARTITION BY lang)""")
def _seeds(spark, sf):
    f = seed_factors(operands(table(spark, sf, "documents")), "lang", "source", ["lang"])
    signed = {"provider_amplification", "event_conflict_risk", "amplified_conflict_risk"}
    return f.select("source", "lang", *[(F.round(c, 5) if c in signed else digits(c, 5)).alias(c) for c in _SEED_COLUMNS])


# search


@dataclass(frozen=True)
class Limits:
    """What a formula may be and what its values must be."""

    operands: tuple[str, ...]
    future: tuple[str, ...] = ()
    max_depth: int = 4
    max_operators: int = 6
    max_missing: float = 0.6
    min_unique: int = 2


@dataclass(frozen=True)
class Scored:
    """A formula's score: usefulness, stability and novelty less a hundredth for each operator and 1 for a look ahead."""

    name: str
    formula: Node
    utility: float
    stability: float
    novelty: float
    complexity: int
    leakage: float

    @property
    def score(self) -> float:
        return self.utility + self.stability + self.novelty - 0.01 * self.complexity - self.leakage


UNARY, WRAPPING, BINARY = ("log1p", "sqrt", "abs"), ("zscore", "rank"), ("add", "sub", "mul", "div", "max", "min")
#: What a formula is worth where it cannot be compared with an objective, and how many a search accepts.
NEUTRAL, ACCEPTED = 0.25, 25


def operators_in(n: Node) -> int:
    return (n.kind == "call") + sum(operators_in(a) for a in n.args)


def allowed(n: Node, limits: Limits) -> bool:
    return not validate(n, list(limits.operands), limits.future, limits.max_depth) and operators_in(n) <= limits.max_operators


def random_formulas(count: int, limits: Limits, rng: random.Random) -> list[Node]:
    """Formulas that grow from an operand by operators around it, drawn until `count` are allowed."""
    out: list[Node] = []
    while len(out) < count:
        n = operand(rng.choice(limits.operands))
        for _ in range(min(rng.randint(0, max(0, limits.max_depth - 1)), limits.max_operators)):
            roll = rng.random()
            if roll < 0.35:
                n = call(rng.choice(UNARY), n)
            elif roll < 0.55:
                n = call(rng.choice(WRAPPING), n)
            else:
                right = constant(rng.randint(1, 5)) if rng.random() < 0.2 else operand(rng.choice(limits.operands))
                n = call(rng.choice(BINARY), n, right)
        if allowed(n, limits):
            out.append(n)
    return out


def measured(rows: DataFrame, formulas: list[Node], objective: str | None, group: str, entity: str, order: list[str]) -> list[dict]:
    """Share of missing values, distinct values, deviation and |correlation| with the objective of each formula.

    Each formula is compiled on its own and becomes one row of an aggregation; all rows are computed in one job over the
    stored operands.
    """
    rows = settle(rows)
    goal = F.coalesce(F.col(objective).cast("double"), F.lit(0.0)) if objective in rows.columns else F.lit(0.0)
    parts = []
    for i, f in enumerate(formulas):
        frame, c = compile_formula(rows, f, group, entity, order)
        x = F.coalesce(c.cast("double"), F.lit(0.0))
        r = F.coalesce(F.abs(ratio(F.covar_pop(x, goal), F.stddev_pop(x) * F.stddev_pop(goal))), F.lit(0.0))
        parts.append(frame.agg(F.lit(i).alias("i"), F.avg(c.isNull().cast("int")).alias("m"), F.approx_count_distinct(x).alias("u"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("s"), r.alias("r"), F.approx_count_distinct(goal).alias("goal")))
    found = {r["i"]: r for r in reduce(DataFrame.union, parts).collect()}
    out = []
    for i in range(len(formulas)):
        r = found[i]
        comparable = objective in rows.columns and r["goal"] >= 2 and r["u"] >= 2
        out.append({"missing": 1.0 if r["m"] is None else r["m"], "unique": r["u"], "utility": r["r"] if comparable else NEUTRAL, "stability": max(0.0, 1.0 - 0.05 * r["s"])})
    return out


def random_search(rows: DataFrame, count: int, limits: Limits, objective: str, group: str, entity: str, order: list[str], seed: int = 1) -> list[Scored]:
    """The first 25 of `count` random formulas whose values are there, differ, and score 0 or more; the same seed gives the same formulas."""
    formulas = random_formulas(count, limits, random.Random(seed))
    out = []
    for i, (f, m) in enumerate(zip(formulas, measured(rows, formulas, objective, group, entity, order), strict=True)):
        if m["missing"] > limits.max_missing or m["unique"] < limits.min_unique:
            continue
        s = Scored(f"candidate_random_{seed}_{i}", f, m["utility"], m["stability"], 0.2 + (i + seed) % 5 * 0.05, operators_in(f), 0.0)
        if s.score >= 0:
            out.append(s)
        if len(out) == min(ACCEPTED, count):
            break
    return out


def genetic_search(rows: DataFrame, size: int, generations: int, limits: Limits, objective: str, group: str, entity: str, order: list[str], seed: int = 1) -> tuple[list[float], list[Scored]]:
    """The best score up to each generation, and each generation's best formula.

    A twentieth of a generation survives as it is; the others are children of two winners of tournaments of two, crossed
    by an operator and mutated, where that stays allowed. Each generation's formulas are measured in one aggregation.
    """
    rng = random.Random(seed)
    population = random_formulas(size, limits, rng)
    best, winners = [], []
    for g in range(generations):
        found = measured(rows, population, objective, group, entity, order)
        fitness = [max(0.0, Scored("", f, m["utility"], m["stability"], 0.3, operators_in(f), 0.0).score) for f, m in zip(population, found, strict=True)]
        top = max(range(size), key=lambda i: fitness[i])
        winner = Scored(f"candidate_gp_{seed}_{g}", population[top], fitness[top], 0.5, 0.3, operators_in(population[top]), 0.0)
        best.append(max([winner.score, *best[-1:]]))
        winners.append(winner)
        ranked = sorted(range(size), key=lambda i: -fitness[i])
        following = [population[i] for i in ranked[: max(1, size // 20)]]
        while len(following) < size:
            parents = []
            for _ in range(2):
                a, b = rng.sample(range(size), 2)
                parents.append(population[a] if fitness[a] >= fitness[b] else population[b])
            child = call(rng.choice(("add", "max", "div")), *parents)
            child = child if allowed(child, limits) else parents[0]
            new = random_formulas(1, limits, random.Random(rng.randint(1, 1_000_000)))[0]
            changed = new if rng.random() < 0.35 else call("rank", child) if rng.random() < 0.65 else call(rng.choice(("add", "sub", "max")), child, new)
            following.append(changed if allowed(changed, limits) else child)
        population = following
    return best, winners


def scored_rows(spark, found: list[Scored]) -> DataFrame:
    """Candidates as rows, by name."""
    return spark.createDataFrame([(s.name, serialize(s.formula), s.utility, s.stability, s.novelty, s.complexity, s.leakage, s.score) for s in found], "name string, formula string, utility double, stability double, novelty double, complexity long, leakage double, score double")


def without_leak(s: Scored, limits: Limits) -> Scored:
    """The score with 1 taken off where the formula uses an operand that lies in the future."""
    return replace(s, leakage=float(any("future" in e for e in validate(s.formula, list(limits.operands), limits.future, 64))))


def contributions(values: DataFrame, by: str, name: str, value: str, most: int = 5) -> DataFrame:
    """The `most` operands of largest |contribution| for each `by`; ties by name."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.abs(value).desc(), name)
    return values.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


@query("factor_contributions", "SELECT event_type, user_id, contribution, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(contribution) DESC, user_id) AS position FROM (SELECT event_type, user_id, round(sum(value) - 500, 4) AS contribution FROM events GROUP BY 1, 2)) WHERE position <= 5")
def _contributions(spark, sf):
    v = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value") - 500, 4).alias("contribution"))
    return contributions(v, "event_type", "user_id", "contribution")


@query("factor_search")
def _search(spark, sf):
    o = operands(table(spark, sf, "documents"))
    names = ("article_count", "article_reach_weight", "claim_coverage", "evidence_span_count", "graph_degree")
    return scored_rows(spark, random_search(o, 40, Limits(names), "contradiction_edge_count", "lang", "source", ["lang"], 7)).select("name", "formula", "complexity", *[digits(c, 6).alias(c) for c in ("utility", "stability", "novelty", "score")])
