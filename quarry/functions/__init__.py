"""Column functions: numbers and order books, text and addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
