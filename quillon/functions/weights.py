"""Term weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def damped(tf: Column) -> Column:
    """1 + ln tf, and 0 for 0."""
    return F.when(tf > 0, 1 + F.ln(F.when(tf > 0, tf))).otherwise(F.lit(0.0))


def idf(n: int, df: Column) -> Column:
    """ln(1 + n / df)."""
    return F.ln(1 + F.lit(float(n)) / df)


def bm25_idf(n: int, df: Column) -> Column:
    return F.ln(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def plain(n: int) -> Column:
    """Weight of a posting by its whole tf."""
    return damped(F.col("tf")) * idf(n, F.col("df"))


def zoned(n: int, title: float, body: float) -> Column:
    """Weight of a posting by its tf in each zone."""
    return (F.lit(float(title)) * damped(F.col("tf_title")) + F.lit(float(body)) * damped(F.col("tf_body"))) * idf(n, F.col("df"))
