"""Raking, trimming and effective bases.

All respondents of a cell (a combination of the raked variables) always have the same weight, so raking
works on one row per cell: Spark counts the cells, the driver iterates over those few rows, and the
weights come back by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.ordered import quantile

NO_ANSWER = "__NA__"
MAX_CELLS = 200_000
CYCLES = 5


def category(c: Column, kind: str) -> Column:
    """The key of a category: whole floats as integers, trimmed text, ``__NA__`` for null."""
    text = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else F.trim(c.cast("string"))
    return F.coalesce(text, F.lit(NO_ANSWER))


def normalised_targets(targets: dict[str, float]) -> dict[str, float]:
    """Shares from shares, percentages or counts; ValueError for anything else."""
    values = list(targets.values())
    total = sum(values)
    if not values or any(v < 0 for v in values) or total <= 0:
        raise ValueError("targets must not be negative and need a positive sum")
    counts = all(float(v).is_integer() for v in values) and len(values) > 1 and not 99 <= total <= 101
    if counts or (total > 101 and min(values) >= 1):
        return {k: v / total for k, v in targets.items()}
    if 99 <= total <= 101:
        return {k: v / 100 for k, v in targets.items()}
    if 0.99 <= total <= 1.01:
        return dict(targets)
    raise ValueError(f"targets sum to {total:g}: neither shares, percentages nor counts")


def kish(w: np.ndarray, n: np.ndarray | None = None) -> float:
    n = np.ones_like(w) if n is None else n
    square = float((n * w * w).sum())
    return float((n * w).sum()) ** 2 / square if square > 0 else 0.0


def _percentile(w: np.ndarray, n: np.ndarray, q: float) -> float:
    """Linear percentile of values with multiplicities."""
    order = np.argsort(w, kind="stable")
    upto = np.cumsum(n[order])
    at = (upto[-1] - 1) * q / 100
    low, high = int(np.floor(at)), int(np.ceil(at))
    a, b = (w[order][np.searchsorted(upto, k, side="right")] for k in (low, high))
    return float(a + (b - a) * (at - low))


def trimmed(w: np.ndarray, n: np.ndarray, percentile: float | None = 95.0, cap_ratio: float | None = None) -> np.ndarray:
    """Large weights pulled in, the sum kept: logarithmically above a percentile, or cut at a multiple of the mean."""
    before = (n * w).sum()
    if cap_ratio is not None:
        out = np.minimum(w, cap_ratio * before / n.sum())
    else:
        top = _percentile(w, n, percentile)
        out = np.where(w > top, top + np.log1p(np.maximum(w - top, 0)), w)
    after = (n * out).sum()
    return out * before / after if after > 0 else out


@dataclass
class Raking:
    """Weights by cell, and how well the margins are met."""

    variables: list[str]
    cells: list[tuple]
    weights: np.ndarray
    diagnostics: dict = field(default_factory=dict)


def rake_cells(variables: list[str], cells: list[tuple], counts: np.ndarray, targets: dict[str, dict[str, float]], max_iter: int = 100, tol: float = 1e-5, trim: float | None = 95.0) -> Raking:
    """Iterative proportional fitting on cells, in up to five cycles of raking and trimming."""
    n = counts.astype(float)
    total, w = n.sum(), np.ones(len(cells))
    goals: list[tuple[np.ndarray, float]] = []
    for j, v in enumerate(variables):
        shares = normalised_targets({str(k).strip(): x for k, x in targets[v].items()})
        keys = np.array([c[j] for c in cells], object)
        strange = sorted({k for k in keys if k != NO_ANSWER} - set(shares))
        if strange:
            raise ValueError(f"{v}: no target for {', '.join(strange)}")
        for key, share in shares.items():
            mask = keys == key
            if share > 0 and not mask.any():
                raise ValueError(f"{v}: category {key} has 0 respondents")
            if mask.any():
                goals.append((mask, share * total))

    def rake() -> bool:
        for _ in range(max_iter):
            worst = 0.0
            for mask, goal in goals:
                now = float((n[mask] * w[mask]).sum())
                if now > 0:
                    w[mask] *= goal / now
                    worst = max(worst, abs(goal / now - 1))
            if worst < tol:
                return True
        return False

    converged = False
    for _ in range(CYCLES):
        converged = rake() or converged
        if trim is not None:
            w = trimmed(w, n, trim)
    rake()
    error = max((abs(float((n[m] * w[m]).sum()) - g) / total for m, g in goals), default=0.0)
    neff = kish(w, n)
    return Raking(variables, cells, w, {"n": int(total), "neff": neff, "efficiency": neff / total if total else 0.0, "max_margin_error": error, "converged": bool(converged and error < 0.02), "min_weight": float(w.min()), "max_weight": float(w.max())})


def rim_weights(df: DataFrame, targets: dict[str, dict[str, float]], out: str = "weight", max_iter: int = 100, tol: float = 1e-5, trim: float | None = 95.0) -> tuple[DataFrame, Raking]:
    """``df`` with weights that meet the margins, and the raking.

    Variables that ``df`` lacks are skipped; if none is left all weights are 1. Respondents without an
    answer to a variable are not raked by it.
    """
    kinds = dict(df.dtypes)
    variables = [v for v in targets if v in kinds]
    if not variables:
        return df.withColumn(out, F.lit(1.0)), Raking([], [], np.ones(0), {"max_margin_error": 0.0})
    keys = [category(F.col(v), kinds[v]).alias(f"_k{i}") for i, v in enumerate(variables)]
    counted = df.select(*keys).groupBy(*[f"_k{i}" for i in range(len(variables))]).count().limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of {', '.join(variables)}")
    counted.sort(key=lambda r: tuple(r)[:-1])
    raking = rake_cells(variables, [tuple(r)[:-1] for r in counted], np.array([r["count"] for r in counted]), targets, max_iter, tol, trim)
    names = [f"_c{i}" for i in range(len(variables))]
    table = df.sparkSession.createDataFrame([(*c, float(w)) for c, w in zip(raking.cells, raking.weights)], ", ".join(f"{k} string" for k in names) + f", `{out}` double")
    on = [category(F.col(v), kinds[v]) == F.col(k) for v, k in zip(variables, names)]
    joined = df.join(F.broadcast(table) if len(counted) <= 10_000 else table, on, "left")
    return joined.drop(*names), raking


def one_variable_weights(df: DataFrame, variable: str, targets: dict[str, float], out: str = "weight") -> DataFrame:
    """Weights of a single margin in closed form: target share over sample share."""
    return rim_weights(df, {variable: targets}, out, trim=None)[0]


def soft_trim(df: DataFrame, weight: str, percentile: float | None = 95.0, cap_ratio: float | None = None, out: str = "trimmed") -> DataFrame:
    """Trim a weight column; the scalars come from two aggregates, the rows stay where they are."""
    w = F.col(weight).cast("double")
    if cap_ratio is not None:
        mean = df.agg(F.avg(w)).first()[0] or 0.0
        pulled = F.least(w, F.lit(cap_ratio * mean))
    else:
        top = quantile(df, w, percentile / 100) or 0.0
        pulled = F.when(w > top, F.lit(top) + F.log1p(F.greatest(w - top, F.lit(0.0)))).otherwise(w)
    sums = df.agg(F.sum(w).alias("a"), F.sum(pulled).alias("b")).first()
    return df.withColumn(out, pulled * ((sums.a or 0.0) / sums.b if sums.b else 1.0))


def weight_diagnostics(df: DataFrame, weight: str, by: list[str] = ()) -> DataFrame:
    """n, sum, Kish effective base and efficiency; null and negative weights are left out."""
    w = F.col(weight).cast("double")
    t = df.filter(w.isNotNull() & ~F.isnan(w) & (w >= 0))
    agg = [F.count("*").alias("n"), F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2")]
    t = t.groupBy(*by).agg(*agg)
    neff = F.when(F.col("sum_w2") > 0, F.col("sum_w") * F.col("sum_w") / F.col("sum_w2")).otherwise(0.0)
    return t.select(*by, "n", "sum_w", neff.alias("neff"), (neff / F.col("n")).alias("efficiency"))


def use_weight_column(df: DataFrame, weight: str, out: str = "weight") -> DataFrame:
    """An existing column as the weight; missing and non-positive weights are refused."""
    w = F.col(weight).try_cast("double")
    bad = df.agg(F.sum((w.isNull() | F.isnan(w) | (w <= 0)).cast("int"))).first()[0]
    if bad:
        raise ValueError(f"{bad} respondents have a missing or non-positive weight")
    return df.withColumn(out, w)


def suggested_weight(columns: list[str]) -> str | None:
    """A column that is named like a weight; it is suggested, never applied."""
    names = {"weight", "weights", "wt", "wgt", "wts", "wtvar", "weight_var", "rim_weight", "rimweight", "final_weight", "finalweight", "sample_weight", "wght", "survey_weight", "pweight", "wt_final", "weight_final"}
    return next((c for c in columns if c.strip().lower().replace(" ", "_") in names), None)


def margin_report(df: DataFrame, weight: str, variable: str) -> DataFrame:
    """category, n, weighted count and shares of a margin."""
    t = df.groupBy(category(F.col(variable), dict(df.dtypes)[variable]).alias("category")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    total = t.agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    return t.crossJoin(F.broadcast(total)).select("category", "n", "w", (F.col("n") / F.col("tn")).alias("share"), (F.col("w") / F.col("tw")).alias("weighted_share"))  # one row
