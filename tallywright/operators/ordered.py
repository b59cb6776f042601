"""Running sums and quantiles over ordered values, in parallel slices of the value's range.

A window over all values of a group is one task however many values there are. Here a sketch of the
values cuts each group's range into slices; every slice is ordered by itself, and what lies below it is
added from a small table with a row per group and slice. Results are exact: the sketch only places the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's range is cut into SIDE * SIDE slices; a value finds its own in two steps of SIDE - 1 comparisons.
SIDE = 16


def running(counts: DataFrame, value: str, weight: str, by: list[str] = (), out: str = "upto", few: bool = False) -> DataFrame:
    """``counts``, with one row per group and distinct numeric value, and the sum of ``weight`` up to each value.

    ``few`` says that a parameter bounds the number of groups; their cuts are broadcast then.
    """
    by = list(by)
    few = few or not by
    x = F.col(value).cast("double")
    slices = SIDE * SIDE
    cuts = counts.groupBy(*by).agg(F.percentile_approx(x, F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(4 * slices)).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda e, i: (i + 1) % SIDE == 0))
    placed = _matched(counts, cuts, by, few).withColumn("_c", F.size(F.filter("_coarse", lambda e: e < x)))
    fine = F.size(F.filter(F.slice("_cuts", SIDE * F.col("_c") + 1, SIDE - 1), lambda e: e < x))
    placed = placed.withColumn("_slice", SIDE * F.col("_c") + fine).drop("_cuts", "_coarse", "_c")
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_inside", F.sum(weight).over(inside))
    per = placed.groupBy(*by, "_slice").agg(F.max("_inside").alias("_own"))  # needs no other shuffle
    below = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    per = per.withColumn("_below", F.coalesce(F.sum("_own").over(below), F.lit(0))).drop("_own")
    return _matched(placed, per, [*by, "_slice"], few).withColumn(out, F.col("_below") + F.col("_inside")).drop("_below", "_inside", "_slice")


def _matched(left: DataFrame, right: DataFrame, by: list[str], few: bool) -> DataFrame:
    """An inner join on equal or equally null ``by``; without any, ``right`` is one row. ``few`` rows are broadcast."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({b: f"_of{i}" for i, b in enumerate(by)})
    on = [F.col(b).eqNullSafe(F.col(f"_of{i}")) for i, b in enumerate(by)]
    return left.join(F.broadcast(right) if few else right, on).drop(*[f"_of{i}" for i in range(len(by))])


def quantiles(df: DataFrame, value: Column, shares: list[float], by: list[str] = (), out: str = "q", few: bool = False) -> DataFrame:
    """``by`` and an array of exact quantiles, interpolated between neighbours; null values are left out.

    Values are counted first. Without ``by`` there is one row, or none if there are no values.
    """
    counts = df.select(*by, value.cast("double").alias("_x")).filter("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_k"))
    return quantiles_of(counts, shares, by, out, few)


def quantiles_of(counts: DataFrame, shares: list[float], by: list[str] = (), out: str = "q", few: bool = False) -> DataFrame:
    """``quantiles`` of distinct values ``_x`` that occur ``_k`` times."""
    by = list(by)
    counts = running(counts, "_x", "_k", by, few=few)
    total = counts.groupBy(*by).agg(F.max("upto").alias("_n"))
    t = _matched(counts, total, by, few)
    parts = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("_n") - 1)
        for name, at in ((f"_lo{i}", F.floor(place)), (f"_hi{i}", F.ceil(place))):
            parts.append(F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("_k") <= at), F.col("_x"))).alias(name))
        parts.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    q = F.array(*[F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(shares))])
    return t.groupBy(*by).agg(*parts).select(*by, q.alias(out))


def quantile(df: DataFrame, value: Column, share: float) -> float | None:
    """One exact quantile of a column, None if there are no values."""
    row = quantiles(df, value, [share]).first()
    return None if row is None else row.q[0]
