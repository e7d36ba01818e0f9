"""Factor formulas: a small typed expression language that compiles to DataFrame columns.

A formula is a tree of operands, constants and operators. Operators on rows become columns; operators over a group or over
time become window columns, one level of windows for each level of the tree. Ranks and z-scores over the whole frame would
put it in one partition: those become an aggregation joined back.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.numeric import digits, ratio
from quarry.operators.market import dig
from quarry.registry import query
from quarry.sources.market import table

ROW_OPERATORS = {"add": 2, "sub": 2, "mul": 2, "div": 2, "max": 2, "min": 2, "clip": 1, "abs": 1, "neg": 1, "log1p": 1, "sqrt": 1, "sigmoid": 1}
FRAME_OPERATORS = {"rank": 1, "zscore": 1, "winsorize": 1}
GROUP_OPERATORS = {n: 1 for n in ("group_mean", "group_sum", "group_std", "group_rank", "group_share", "group_median", "group_zscore", "neutralize")}
TIME_OPERATORS = {n: 1 for n in ("ts_sum", "ts_mean", "ts_std", "ts_delta", "smooth")}
ARITY = {**ROW_OPERATORS, **FRAME_OPERATORS, **GROUP_OPERATORS, **TIME_OPERATORS}


@dataclass(frozen=True)
class Node:
    """An operator with arguments, an operand by name, or a constant."""

    kind: str
    name: str = ""
    value: float = 0.0
    args: tuple[Node, ...] = field(default=())

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.args), default=0)

    def operands(self) -> set[str]:
        return ({self.name} if self.kind == "operand" else set()).union(*[a.operands() for a in self.args])


def operand(name: str) -> Node:
    return Node("operand", name)


def constant(value: float) -> Node:
    return Node("constant", value=float(value))


def call(name: str, *args: Node) -> Node:
    return Node("call", name, args=tuple(args))


def serialize(node: Node) -> str:
    def plain(n: Node) -> dict:
        return {"operand": n.name} if n.kind == "operand" else {"constant": n.value} if n.kind == "constant" else {"call": n.name, "args": [plain(a) for a in n.args]}

    return json.dumps(plain(node), sort_keys=True)


def parse(text: str) -> Node:
    def build(d: dict) -> Node:
        return operand(d["operand"]) if "operand" in d else constant(d["constant"]) if "constant" in d else call(d["call"], *[build(a) for a in d["args"]])

    return build(json.loads(text))


def validate(node: Node, known: list[str], future: tuple[str, ...] = (), max_depth: int = 8) -> list[str]:
    """What is wrong with a formula: unknown names, wrong numbers of arguments, depth, operands that lie in the future."""
    found = [f"too deep: {node.depth()}"] if node.depth() > max_depth else []

    def visit(n: Node) -> None:
        if n.kind == "operand" and n.name in future:
            found.append(f"{n.name} lies in the future")
        elif n.kind == "operand" and n.name not in known:
            found.append(f"no operand {n.name}")
        elif n.kind == "call" and n.name not in ARITY:
            found.append(f"no operator {n.name}")
        elif n.kind == "call" and len(n.args) != ARITY[n.name]:
            found.append(f"{n.name} takes {ARITY[n.name]} arguments")
        for a in n.args:
            visit(a)

    visit(node)
    return found


def _row(name: str, x: Column, y: Column | None) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "add": lambda: zero(x) + zero(y), "sub": lambda: zero(x) - zero(y), "mul": lambda: zero(x) * zero(y),
        "div": lambda: zero(x) / F.when(zero(y) == 0, 1.0).otherwise(zero(y)),
        "max": lambda: F.greatest(x, y), "min": lambda: F.least(x, y), "clip": lambda: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), x)),
        "abs": lambda: F.abs(x), "neg": lambda: -x, "log1p": lambda: F.log1p(F.greatest(F.lit(0.0), x)), "sqrt": lambda: F.sqrt(F.greatest(F.lit(0.0), x)),
        "sigmoid": lambda: 1 / (1 + F.exp(-zero(x))),
    }[name]()


#: Ranges into which values are cut to count them.
RANGES = 200


def counted(frame: DataFrame, x: Column) -> DataFrame:
    """Each distinct value `__v` of a column, how often it occurs (`__c`), how many are smaller (`__start`), and how many there are (`__n`).

    Values are cut into ranges at approximate quantiles, so that no task holds more than about one part in `RANGES` of the
    distinct values; the number below a range comes from the ranges' totals, which are one short array.
    """
    values = frame.where(x.isNotNull())
    bounds = values.agg(F.percentile_approx(x, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(10 * RANGES)).alias("__q"))
    counts = values.groupBy(x.alias("__v")).agg(F.count("*").alias("__c"))
    at = counts.crossJoin(F.broadcast(bounds)).select("__v", "__c", F.size(F.filter("__q", lambda b: b < F.col("__v"))).alias("__r"))  # one row
    totals = at.groupBy("__r").agg(F.sum("__c").alias("__s")).agg(F.collect_list(F.struct("__r", "__s")).alias("__t"), F.sum("__s").alias("__n"))
    inside = F.coalesce(F.sum("__c").over(Window.partitionBy("__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.aggregate(F.filter("__t", lambda t: t["__r"] < F.col("__r")), F.lit(0).cast("long"), lambda n, t: n + t["__s"])
    return at.withColumn("__i", inside).crossJoin(F.broadcast(totals)).select("__v", "__c", (below + F.col("__i")).alias("__start"), "__n")


def quantiles(placed: DataFrame, of: dict[str, float]) -> DataFrame:
    """One row of exact interpolated quantiles, by name, of what `counted` returns."""
    at = lambda k: F.max(F.when((F.col("__start") <= k) & (k < F.col("__start") + F.col("__c")), F.col("__v")))
    h = {n: F.lit(q) * (F.col("__n") - 1) for n, q in of.items()}
    ends = placed.agg(F.max("__n").alias("__n"), *[f for n in of for f in (at(F.floor(h[n])).alias(f"{n}_a"), at(F.ceil(h[n])).alias(f"{n}_b"))])
    return ends.select(*[(F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * (h[n] - F.floor(h[n]))).alias(n) for n in of])


def compile_formula(df: DataFrame, node: Node, group: str, entity: str, order: list[str], window: int = 3) -> tuple[DataFrame, Column]:
    """The frame with the columns that the formula needs, and the column of its value.

    Group operators work over `group`, time operators over `entity` in `order`, trailing rows. The frame's own columns are
    kept; helpers are named `__f0` and so on.
    """
    problems = validate(node, df.columns, max_depth=64)
    if problems:
        raise ValueError("; ".join(problems))
    made = 0

    def keep(frame: DataFrame, column: Column) -> tuple[DataFrame, Column]:
        nonlocal made
        name = f"__f{made}"
        made += 1
        return frame.withColumn(name, column), F.col(name)

    def build(frame: DataFrame, n: Node) -> tuple[DataFrame, Column]:
        if n.kind == "operand":
            return frame, F.col(n.name).cast("double")
        if n.kind == "constant":
            return frame, F.lit(n.value)
        parts = []
        for a in n.args:
            frame, c = build(frame, a)
            parts.append(c)
        x, y = parts[0], parts[1] if len(parts) > 1 else None
        if n.name in ROW_OPERATORS:
            return frame, _row(n.name, x, y)
        frame, x = keep(frame, x)
        if n.name in GROUP_OPERATORS:
            g = Window.partitionBy(group)
            mean, std = F.avg(x).over(g), F.stddev_samp(x).over(g)
            column = {
                "group_mean": lambda: mean, "group_sum": lambda: F.sum(x).over(g), "group_std": lambda: F.coalesce(std, F.lit(0.0)), "group_median": lambda: F.percentile(x, F.lit(0.5)).over(g),
                "group_share": lambda: x / F.when(F.sum(x).over(g) == 0, 1.0).otherwise(F.sum(x).over(g)), "group_zscore": lambda: F.coalesce(ratio(x - mean, std), F.lit(0.0)), "neutralize": lambda: x - mean,
                "group_rank": lambda: (F.rank().over(g.orderBy(x)) + (F.count(x).over(Window.partitionBy(group, x)) - 1) / 2.0) / F.count(x).over(g),
            }[n.name]()
            return keep(frame, column)
        if n.name in TIME_OPERATORS:
            w = Window.partitionBy(entity).orderBy(*order)
            t = w.rowsBetween(1 - window, 0)
            column = {
                "ts_sum": lambda: F.sum(x).over(t), "ts_mean": lambda: F.avg(x).over(t), "smooth": lambda: F.avg(x).over(t), "ts_std": lambda: F.coalesce(F.stddev_samp(x).over(t), F.lit(0.0)),
                "ts_delta": lambda: F.coalesce(x - F.lag(x).over(w), F.lit(0.0)),
            }[n.name]()
            return keep(frame, column)
        if n.name == "rank":
            placed = counted(frame, x)
            ranked = placed.select("__v", ((F.col("__start") + 1 + (F.col("__c") - 1) / 2.0) / F.col("__n")).alias("__rank"))
            made_frame, c = keep(frame.join(ranked, x == F.col("__v"), "left").drop("__v"), F.col("__rank"))
            return made_frame.drop("__rank"), c
        if n.name == "zscore":
            stats = frame.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
            value = F.coalesce(ratio(x - F.col("__m"), F.col("__s")), F.lit(0.0))
        else:
            stats = quantiles(counted(frame, x), {"__lo": 0.05, "__hi": 0.95})
            value = F.greatest(F.col("__lo"), F.least(F.col("__hi"), x))
        made_frame, c = keep(frame.crossJoin(F.broadcast(stats)), value)  # one row
        return made_frame.drop(*stats.columns), c

    return build(df, node)


def evaluate(df: DataFrame, name: str, node: Node, group: str, entity: str, order: list[str], window: int = 3) -> DataFrame:
    """Factor rows: the columns of `df` and `factor_name, value`, which replace columns of these names."""
    frame, column = compile_formula(df, node, group, entity, order, window)
    return frame.select(*[c for c in df.columns if c not in ("factor_name", "value")], F.lit(name).alias("factor_name"), column.alias("value"))


def schedule(formulas: dict[str, Node]) -> list[str]:
    """Names in an order in which each formula follows those it uses; a cycle is an error."""
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("cycle: " + " > ".join((*path, name)))
        if name not in done:
            for used in sorted(formulas[name].operands() & formulas.keys()):
                visit(used, (*path, name))
            done.append(name)

    for name in sorted(formulas):
        visit(name, ())
    return done


def evaluate_all(df: DataFrame, formulas: dict[str, Node], group: str, entity: str, order: list[str], window: int = 3) -> DataFrame:
    """One column for each formula, which may use others by name."""
    return reduce(lambda frame, n: _with(frame, n, formulas[n], group, entity, order, window), schedule(formulas), df)


def _with(frame: DataFrame, name: str, node: Node, group: str, entity: str, order: list[str], window: int) -> DataFrame:
    keep = frame.columns
    made, column = compile_formula(frame, node, group, entity, order, window)
    return made.select(*keep, column.alias(name))


x, y = operand("value"), operand("n")
#: name -> (formula, DuckDB's expression over e with columns value and n)
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_G = "OVER (PARTITION BY event_type)"
FORMULAS = {
    "add": (call("add", x, y), "value + n"),
    "sub": (call("sub", x, y), "value - n"),
    "mul": (call("mul", x, y), "value * n"),
    "div": (call("div", x, y), "value / CASE WHEN n = 0 THEN 1.0 ELSE n END"),
    "max": (call("max", x, y), "greatest(value, n)"),
    "min": (call("min", x, y), "least(value, n)"),
    "clip": (call("clip", x), "greatest(-5.0, least(5.0, value))"),
    "abs_neg": (call("abs", call("neg", x)), "abs(-value)"),
    "log1p": (call("log1p", x), "ln(1 + greatest(0.0, value))"),
    "sqrt": (call("sqrt", x), "sqrt(greatest(0.0, value))"),
    "sigmoid": (call("sigmoid", call("sub", x, constant(50))), "1 / (1 + exp(-(value - 50)))"),
    "rank": (call("rank", x), "(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER ()"),
    "zscore": (call("zscore", x), "(value - avg(value) OVER ()) / stddev_samp(value) OVER ()"),
    "winsorize": (call("winsorize", x), "greatest(quantile_cont(value, 0.05) OVER (), least(quantile_cont(value, 0.95) OVER (), value))"),
    "group_mean": (call("group_mean", x), f"avg(value) {_G}"),
    "group_sum": (call("group_sum", x), f"sum(value) {_G}"),
    "group_std": (call("group_std", x), f"stddev_samp(value) {_G}"),
    "group_median": (call("group_median", x), f"quantile_cont(value, 0.5) {_G}"),
    "group_share": (call("group_share", x), f"value / sum(value) {_G}"),
    "group_zscore": (call("group_zscore", x), f"(value - avg(value) {_G}) / stddev_samp(value) {_G}"),
    "group_rank": (call("group_rank", x), f"(rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0) / count(*) {_G}"),
    "neutralize": (call("neutralize", x), f"value - avg(value) {_G}"),
    "ts_sum": (call("ts_sum", x), f"sum(value) {_W}"),
    "ts_mean": (call("ts_mean", x), f"avg(value) {_W}"),
    "ts_std": (call("ts_std", x), f"coalesce(stddev_samp(value) {_W}, 0)"),
    "ts_delta": (call("ts_delta", x), "coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)"),
}


def _register(name: str, node: Node, sql: str) -> None:
    @query(f"factor_{name}", f"WITH e AS (SELECT event_id, event_type, user_id, ts, value, CAST(event_id % 7 AS DOUBLE) AS n FROM events), v AS (SELECT event_id, {sql} AS v FROM e) SELECT event_id, 'factor_{name}' AS factor_name, round(v, 5) AS value FROM v")
    def run(spark, sf):
        e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts", "value", (F.col("event_id") % 7).cast("double").alias("n"))
        f = evaluate(e, f"factor_{name}", node, "event_type", "user_id", ["ts", "event_id"])
        return f.select("event_id", "factor_name", F.round("value", 5).alias("value"))


for _name, (_node, _sql) in FORMULAS.items():
    _register(_name, _node, _sql)


@query("factor_dag", f"WITH e AS (SELECT event_id, event_type, user_id, ts, value FROM events), a AS (SELECT *, avg(value) {_G} AS base FROM e), b AS (SELECT *, value - base AS excess FROM a) SELECT event_id, round(base, 5) AS base, round(excess, 5) AS excess, round(avg(excess) {_W}, 5) AS signal FROM b")
def _dag(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts", "value")
    f = evaluate_all(e, {"signal": call("ts_mean", operand("excess")), "excess": call("sub", x, operand("base")), "base": call("group_mean", x)}, "event_type", "user_id", ["ts", "event_id"])
    return f.select("event_id", *[F.round(c, 5).alias(c) for c in ("base", "excess", "signal")])


def redundant_pairs(factors: DataFrame, names: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of factor columns whose correlation is at least `threshold`, either sign: one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = factors.agg(*[F.coalesce(ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*").where(F.abs("correlation") >= threshold)


@query("factor_redundant", "WITH e AS (SELECT value, value * 2 + 1 AS doubled, -value AS opposite, CAST(user_id AS DOUBLE) AS other FROM events), p AS (SELECT 'value' AS a, 'doubled' AS b, corr(value, doubled) AS c FROM e UNION ALL SELECT 'value', 'opposite', corr(value, opposite) FROM e UNION ALL SELECT 'value', 'other', corr(value, other) FROM e UNION ALL SELECT 'doubled', 'opposite', corr(doubled, opposite) FROM e UNION ALL SELECT 'doubled', 'other', corr(doubled, other) FROM e UNION ALL SELECT 'opposite', 'other', corr(opposite, other) FROM e) SELECT a, b, round(c, 6) AS correlation FROM p WHERE abs(c) >= 0.95")
def _redundant(spark, sf):
    e = table(spark, sf, "events").select("value", (F.col("value") * 2 + 1).alias("doubled"), (-F.col("value")).alias("opposite"), F.col("user_id").cast("double").alias("other"))
    return redundant_pairs(e, e.columns).select("a", "b", F.round("correlation", 6).alias("correlation"))
