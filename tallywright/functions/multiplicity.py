"""False-discovery and family-wise control as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, p: str, by: list[str], tie: list[str]) -> DataFrame:
    """Rank among the usable p values of a family, and their number; NaN and null are left out."""
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    df = df.withColumn("_ok", usable)
    w = Window.partitionBy(*by, "_ok")
    df = df.withColumn("_rank", F.when(F.col("_ok"), F.row_number().over(w.orderBy(p, *tie))))
    return df.withColumn("_m", F.when(F.col("_ok"), F.count("*").over(w)))


def _harmonic(m: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)


def adjusted(df: DataFrame, p: str, by: list[str], method: str = "bh", tie: list[str] | None = None, out: str = "p_adj") -> DataFrame:
    """``df`` with p values adjusted within ``by``: bh, by (dependent tests) or holm.

    bh and by run down from the largest p, holm up from the least; all are cut at 1.
    """
    tie = tie or []
    df = _ranked(df, p, by, tie)
    w = Window.partitionBy(*by, "_ok")
    if method == "holm":
        scaled = F.col(p) * (F.col("_m") - F.col("_rank") + 1)
        run = F.max(scaled).over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    else:
        scaled = F.col(p) * F.col("_m") / F.col("_rank")
        if method == "by":
            scaled = scaled * _harmonic(F.col("_m"))
        run = F.min(scaled).over(w.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col("_ok"), F.least(F.lit(1.0), run))).drop("_ok", "_rank", "_m")


def decided(df: DataFrame, p: str, by: list[str], alpha: float = 0.05, method: str = "bh", tie: list[str] | None = None, out: str = "significant") -> DataFrame:
    """Step-up decisions: all up to the largest rank r with p <= r * alpha / m (by: over the harmonic sum).

    NaN and null are never significant and don't count.
    """
    df = _ranked(df, p, by, tie or [])
    line = F.col("_rank") * alpha / F.col("_m")
    if method == "by":
        line = line / _harmonic(F.col("_m"))
    top = F.max(F.when(F.col(p) <= line, F.col("_rank"))).over(Window.partitionBy(*by, "_ok"))
    return df.withColumn(out, F.coalesce(F.col("_ok") & (F.col("_rank") <= top), F.lit(False))).drop("_ok", "_rank", "_m")
