"""Column functions that never raise under ANSI mode: division by zero and logarithms of non-positive numbers are null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import as_column as c


OFF_TIES = 1.0000000000003


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def safe_ln(x: Column | str) -> Column:
    return F.when(c(x) > 0, F.ln(c(x)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def digits(x: Column | str, n: int = 9) -> Column:
    """The number cut to n + 1 significant digits, so that sums in another order give the same value.

    The factor moves numbers off exact ties, which engines round in different ways.
    """
    return F.when(c(x).isNotNull(), F.format_string(f"%.{n}e", c(x).cast("double") * OFF_TIES + 0.0).cast("double"))


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def relative_spread(bid: Column, ask: Column) -> Column:
    return ratio(ask - bid, mid_price(bid, ask))


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return ratio(bid_size - ask_size, bid_size + ask_size)


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """Mid price leaning to the thinner side of the book."""
    return ratio(ask * bid_size + bid * ask_size, bid_size + ask_size)


def average_rank(over_all: Column, ties: Column, n: Column) -> Column:
    """Percentile rank with ties at their mean: from `rank`, the number of ties and of rows."""
    return (over_all + (ties - 1) / 2.0) / n
