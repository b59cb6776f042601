"""Tests and models: Spark aggregates sufficient statistics, the driver does the p x p algebra."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import multiplicity, tails
from tallywright.operators.crosstab import text_of
from tallywright.operators.ordered import quantiles, quantiles_of, running

MAX_COMBINATIONS = 1_500_000
#: Patterns of respondents that the branch and bound takes to the driver.
MAX_PATTERNS = 1_000_000
#: Distinct pairs of values in a Kendall correlation, which are compared with each other.
MAX_PAIRS = 20_000
#: Without ties p is exact for up to so many values in the smaller sample and pairs of both (Mann-Whitney), or differences (Wilcoxon).
EXACT_SAMPLE, EXACT_PAIRS, EXACT_DIFFERENCES = 8, 10_000, 50
#: Quadrants rank the target in slices of so many rows, by at most so many cuts; bins are digits of four bits, so many in a number.
SLICE_ROWS, CUTS, DIGITS = 400_000, 4_096, 15


def _one(df: DataFrame, **values) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items()))


# --- ranks -----------------------------------------------------------------


def midranks(df: DataFrame, value: str, weight: str | None = None, by: list[str] = (), out: str = "midrank") -> DataFrame:
    """``df`` with weighted midranks: half the weight below plus half up to the value, plus a half.

    Values are counted first, so the running sum walks over distinct values only.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(w).alias("_w"))
    v = running(v, "_v", "_w", by).withColumn("_r", (2 * F.col("upto") - F.col("_w")) / 2 + 0.5).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_v", "_r")
    on = [df[value] == v["_v"]] + [df[b].eqNullSafe(v[f"_b{i}"]) for i, b in enumerate(by)]
    return df.join(v, on, "left").withColumn(out, F.col("_r")).drop("_v", "_r", *[f"_b{i}" for i in range(len(by))])


def _rank_cells(df: DataFrame, value: str, group: str, weight: str | None, rescale: bool) -> DataFrame:
    """(g, y, n, w, w2) per group and value, with weights brought to the effective sample size on request."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = text_of(F.col(group), dict(df.dtypes)[group])
    t = df.select(F.col(value).cast("double").alias("y"), g.alias("g"), w.alias("w")).filter("y is not null and not isnan(y) and g is not null and g <> '' and w > 0")
    t = t.groupBy("g", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    if rescale:
        k = t.agg((F.sum("w") / F.sum("w2")).alias("k")).first()[0] or 1.0
        t = t.withColumn("w", F.col("w") * k).withColumn("w2", F.col("w2") * k * k)
    y = running(t.groupBy("y").agg(F.sum("w").alias("yw")), "y", "yw")
    y = y.select(F.col("y").alias("yy"), ((2 * F.col("upto") - F.col("yw")) / 2 + 0.5).alias("r"))
    return t.join(y, F.col("y") == F.col("yy")).drop("yy")


def _rank_groups(df: DataFrame, value: str, group: str, weight: str | None, rescale: bool) -> DataFrame:
    """Per group: n, w, neff, mean rank, and the pooled rank variance with its total weight."""
    t = _rank_cells(df, value, group, weight, rescale)
    g = t.groupBy("g").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.sum(F.col("w") * F.col("r")).alias("s"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("ss"))
    over = Window.partitionBy()  # a row per group
    g = g.withColumn("total", F.sum("w").over(over)).withColumn("mean", F.sum("s").over(over) / F.col("total"))
    g = g.withColumn("variance", (F.sum("ss").over(over) - F.col("total") * F.col("mean") * F.col("mean")) / F.greatest(F.col("total") - 1, F.lit(1e-12)))
    return g.withColumn("mean_rank", F.col("s") / F.col("w")).withColumn("neff", F.col("w") * F.col("w") / F.col("w2"))


def kruskal_wallis(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """h, df, p, n: tie-corrected; weights count by the effective sample size, so their scale is of no matter."""
    g = _rank_groups(df, value, group, weight, True)
    h = F.sum(F.col("w") * F.pow(F.col("mean_rank") - F.col("mean"), F.lit(2.0)))
    t = g.agg(h.alias("num"), F.max("variance").alias("v"), (F.count("*") - 1).alias("df"), F.sum("n").alias("n"))
    t = t.select(F.when(F.col("v") > 0, F.col("num") / F.col("v")).otherwise(0.0).alias("h"), "df", "n")
    return t.withColumn("p", tails.chi2_p("h", "df"))


def dunn(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """Pairs of groups after a rank test: mean rank difference, z, raw p and p by Holm; weights as given."""
    g = _rank_groups(df, value, group, weight, False).withColumn("variance", F.when(F.col("total") > 1, F.col("variance")).otherwise(1.0))
    a, b = g.alias("a"), g.alias("b")
    t = a.join(b, F.expr("a.g < b.g"))
    diff = F.col("a.mean_rank") - F.col("b.mean_rank")
    se = F.sqrt(F.col("a.variance") * (1 / F.col("a.neff") + 1 / F.col("b.neff")))
    t = t.select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), diff.alias("mean_rank_diff"), F.when(se > 0, diff / se).otherwise(0.0).alias("z"))
    t = t.withColumn("p_raw", tails.normal_p("z"))
    return multiplicity.adjusted(t, "p_raw", [], "holm", ["group_a", "group_b"]).withColumn("significant", F.col("p_adj") < 0.05)


def rank_sum_ways(n: int, m: int) -> list[int]:
    """In how many orders of n and m different values U is 0, 1, ..., n * m: the coefficients of a Gaussian binomial."""
    ways = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for u in range(n * m, m + i - 1, -1):
            ways[u] -= ways[u - m - i]
        for u in range(i, n * m + 1):
            ways[u] += ways[u - i]
    return ways


def signed_rank_ways(n: int) -> list[int]:
    """For how many signs of the ranks 1 to n the positive ones sum to 0, 1, ..., n (n + 1) / 2."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for i in range(1, n + 1):
        for w in range(len(ways) - 1, i - 1, -1):
            ways[w] += ways[w - i]
    return ways


def exact_rank_sum_p(u: float, n: int, m: int) -> float | None:
    """Two-sided p of U without ties; None for an empty sample and beyond EXACT_SAMPLE or EXACT_PAIRS."""
    if not (n >= 1 and m >= 1) or min(n, m) > EXACT_SAMPLE or n * m > EXACT_PAIRS:
        return None
    n, m = int(n), int(m)
    ways = rank_sum_ways(min(n, m), max(n, m))
    return min(1.0, 2 * sum(ways[: int(min(u, n * m - u)) + 1]) / sum(ways))


def exact_signed_rank_p(w: float, n: int) -> float | None:
    """Two-sided p of the lesser signed rank sum without ties; None beyond EXACT_DIFFERENCES."""
    if n > EXACT_DIFFERENCES:
        return None
    return min(1.0, 2 * sum(signed_rank_ways(n)[: int(w) + 1]) / 2**n)


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """u (of group ``a``), z, p and medians. p is exact for small samples without ties, else from z.

    z is the normal approximation with tie and continuity correction.
    """
    exact = F.pandas_udf(lambda u, n, m: pd.Series([exact_rank_sum_p(*x) for x in zip(u, n, m)], dtype=float), "double")  # a single row
    g = text_of(F.col(group), dict(df.dtypes)[group])
    t = df.filter(g.isin(a, b) & F.col(value).isNotNull())
    cells = _rank_cells(t, value, group, None, False)
    s = cells.agg(
        F.sum(F.when(F.col("g") == a, F.col("r") * F.col("w"))).alias("ra"), F.sum(F.when(F.col("g") == a, F.col("w"))).alias("na"), F.sum(F.when(F.col("g") == b, F.col("w"))).alias("nb")
    )
    ties = cells.groupBy("y").agg(F.sum("w").alias("k")).agg(F.sum(F.pow("k", F.lit(3.0)) - F.col("k")).alias("ties"))
    q = quantiles(t.select(g.alias("g"), F.col(value).alias("x")), F.col("x"), [0.5], ["g"], few=True)
    medians = q.agg(F.max(F.when(F.col("g") == a, F.col("q")[0])).alias("median_a"), F.max(F.when(F.col("g") == b, F.col("q")[0])).alias("median_b"))
    s = s.crossJoin(F.broadcast(ties)).crossJoin(F.broadcast(medians))  # one row each
    n = F.col("na") + F.col("nb")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(u, F.col("na") * F.col("nb") - u) - F.col("na") * F.col("nb") / 2 - 0.5
    s = s.select(u.alias("u"), F.when(sd > 0, far / sd).otherwise(0.0).alias("z"), F.col("na").cast("long").alias("n_a"), F.col("nb").cast("long").alias("n_b"), "median_a", "median_b", "ties")
    near = F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), F.least(F.lit(1.0), tails.normal_p(F.greatest("z", F.lit(0.0)))))
    return s.withColumn("_exact", exact("u", "n_a", "n_b")).withColumn("p", F.coalesce(F.when((F.col("ties") == 0) & ~F.isnan("_exact"), F.col("_exact")), near)).drop("_exact", "ties")


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    """w (the lesser signed rank sum), z, p of paired values; zero differences are dropped, five must remain.

    p is exact for up to EXACT_DIFFERENCES differences without ties, else from z.
    """
    exact = F.pandas_udf(lambda w, n: pd.Series([exact_signed_rank_p(*x) for x in zip(w, n)], dtype=float), "double")  # a single row
    d = df.select((F.col(after).cast("double") - F.col(before).cast("double")).alias("d")).filter("d is not null and d <> 0")
    c = d.groupBy(F.abs("d").alias("y")).agg(F.count("*").cast("double").alias("k"), F.sum(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("up"))
    c = running(c, "y", "k").withColumn("r", (2 * F.col("upto") - F.col("k") + 1) / 2)
    s = c.agg(F.sum(F.col("up") * F.col("r")).alias("plus"), F.sum((F.col("k") - F.col("up")) * F.col("r")).alias("minus"), F.sum("k").alias("n"), F.sum(F.pow("k", F.lit(3.0)) - F.col("k")).alias("ties"))
    w = F.least("plus", "minus")
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    s = s.filter("n >= 5").select(w.alias("w"), F.when(sd > 0, (w - F.col("n") * (F.col("n") + 1) / 4) / sd).otherwise(0.0).alias("z"), F.col("n").cast("long").alias("n"), "ties")
    return s.withColumn("_exact", exact("w", "n")).withColumn("p", F.coalesce(F.when((F.col("ties") == 0) & ~F.isnan("_exact"), F.col("_exact")), tails.normal_p("z"))).drop("_exact", "ties")


# --- means -----------------------------------------------------------------


def t_test(df: DataFrame, value: str, group: str, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Welch's t of two groups: means, t, df, p; weights are brought to a mean of 1 in each group."""
    g = text_of(F.col(group), dict(df.dtypes)[group])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = F.col(value).cast("double")
    t = df.select(g.alias("g"), x.alias("x"), w.alias("w")).filter(F.col("g").isin(a, b) & F.col("x").isNotNull())
    shift = t.agg(F.avg("x")).first()[0] or 0.0
    d = F.col("x") - shift
    s = t.groupBy("g").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("ss"))
    var = F.col("ss") / F.col("w") - F.pow(F.col("s") / F.col("w"), F.lit(2.0))
    if not weight:
        var = var * F.col("n") / (F.col("n") - 1)
    s = s.select("g", "n", (F.col("s") / F.col("w") + shift).alias("m"), var.alias("v"))
    l, r = s.filter(F.col("g") == a).alias("l"), s.filter(F.col("g") == b).alias("r")
    both = l.crossJoin(r)  # one row each
    va, vb = F.col("l.v") / F.col("l.n"), F.col("r.v") / F.col("r.n")
    both = both.select(
        F.col("l.m").alias("mean_a"), F.col("r.m").alias("mean_b"), ((F.col("l.m") - F.col("r.m")) / F.sqrt(va + vb)).alias("t"),
        (F.pow(va + vb, F.lit(2.0)) / (va * va / (F.col("l.n") - 1) + vb * vb / (F.col("r.n") - 1))).alias("df"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b"),
    )
    return both.withColumn("p", tails.t_p("t", "df"))


def paired_t(df: DataFrame, before: str, after: str) -> DataFrame:
    """Mean difference (after - before), t, df, p."""
    d = df.select((F.col(after).cast("double") - F.col(before).cast("double")).alias("d")).filter("d is not null")
    s = d.agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"))
    s = s.select("mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0).alias("t"), (F.col("n") - 1).alias("df"), "n")
    return s.withColumn("p", tails.t_p("t", "df"))


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, mean, sd, minimum, maximum, one scan for all."""
    a = [e for i, c in enumerate(columns) for e in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"), F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum")) for i, c in enumerate(columns)])
    return df.agg(*a).select(F.explode(rows).alias("r")).select("r.*")


# --- association -----------------------------------------------------------


def correlation(df: DataFrame, x: str, y: str, kind: str = "pearson") -> DataFrame:
    """r, n, p of pearson, spearman, kendall (tau-b) or point_biserial correlation."""
    t = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if kind == "kendall":
        return kendall(t)
    if kind == "spearman":
        t = midranks(midranks(t, "x", out="rx"), "y", out="ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    s = t.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).filter("n >= 3")
    s = s.withColumn("t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).otherwise(F.lit(1e300))).withColumn("df", F.col("n") - 2)
    return s.withColumn("p", tails.t_p("t", "df")).select("r", "n", "p")


def kendall(t: DataFrame) -> DataFrame:
    """Tau-b of columns x and y, from the table of distinct pairs.

    Discordant and concordant weights come from one join of that table with itself, so it is for
    variables with a bounded number of values (ratings, codes): more than MAX_PAIRS pairs are an error.
    """
    c = t.groupBy("x", "y").agg(F.count("*").cast("double").alias("k"))
    if c.count() > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of values; use spearman, or coarser values")
    a, b = c.alias("a"), c.alias("b")
    sign = F.signum(F.col("a.y") - F.col("b.y"))
    s = a.join(b, F.expr("a.x > b.x")).agg(F.sum(sign * F.col("a.k") * F.col("b.k")).alias("s"))
    ties = lambda v: c.groupBy(v).agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"t{v}"), F.sum(F.col("k") * (F.col("k") - 1) * (2 * F.col("k") + 5)).alias(f"v{v}"), F.sum("k").alias(f"n{v}"), F.sum(F.col("k") * (F.col("k") - 1) * (F.col("k") - 2)).alias(f"w{v}"))
    r = s.crossJoin(F.broadcast(ties("x"))).crossJoin(F.broadcast(ties("y")))  # one row each
    n = F.col("nx")
    pairs = n * (n - 1) / 2
    below = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    var = (n * (n - 1) * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18 + 2 * F.col("tx") * F.col("ty") / (n * (n - 1)) + F.col("wx") * F.col("wy") / (9 * n * (n - 1) * (n - 2))
    r = r.select(F.when(below > 0, F.coalesce("s", F.lit(0.0)) / below).otherwise(0.0).alias("r"), n.cast("long").alias("n"), F.when(var > 0, F.coalesce("s", F.lit(0.0)) / F.sqrt(var)).otherwise(0.0).alias("z"))
    return r.withColumn("p", tails.normal_p("z")).select("r", "n", "p")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """(row, col, value): all combinations of the values of two columns with their counts."""
    kinds = dict(df.dtypes)
    t = df.select(text_of(F.col(x), kinds[x]).alias("row"), text_of(F.col(y), kinds[y]).alias("col")).dropna().groupBy("row", "col").agg(F.count("*").alias("value"))
    return t.select("row").distinct().crossJoin(t.select("col").distinct()).join(t, ["row", "col"], "left").fillna(0, ["value"])  # values x values


def chi_square_association(df: DataFrame, x: str, y: str) -> DataFrame:
    """stat, df, p and Cramer's v; Yates' correction on 2 x 2 tables."""
    t = contingency(df, x, y)
    r, c, everything = Window.partitionBy("row"), Window.partitionBy("col"), Window.partitionBy()
    t = t.withColumn("rs", F.sum("value").over(r)).withColumn("cs", F.sum("value").over(c)).withColumn("n", F.sum("value").over(everything))
    t = t.withColumn("e", F.col("rs") * F.col("cs") / F.col("n")).withColumn("gap", F.abs(F.col("value") - F.col("e")))
    s = t.agg(F.count_distinct("row").alias("k"), F.count_distinct("col").alias("m"), F.max("n").alias("n"), F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("plain"), F.sum(F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(2.0)) / F.col("e")).alias("yates"))
    s = s.withColumn("df", (F.col("k") - 1) * (F.col("m") - 1)).withColumn("stat", F.when(F.col("df") == 1, F.col("yates")).otherwise(F.col("plain")))
    side = F.least("k", "m") - 1
    return s.withColumn("cramers_v", F.when(side > 0, F.sqrt(F.col("stat") / (F.col("n") * side))).otherwise(0.0)).withColumn("p", tails.chi2_p("stat", F.greatest("df", F.lit(1)))).select("stat", "df", "p", "cramers_v", "n")


def agreement(df: DataFrame, human: Column, machine: Column) -> DataFrame:
    """Exact agreement, mean Jaccard and mean Cohen's kappa of two arrays of codes per row."""
    t = df.select(F.array_distinct(F.coalesce(human, F.array().cast("array<string>"))).alias("h"), F.array_distinct(F.coalesce(machine, F.array().cast("array<string>"))).alias("m"))
    both, either = F.size(F.array_intersect("h", "m")), F.size(F.array_union("h", "m"))
    overall = t.agg(F.count("*").alias("n"), F.avg((F.sort_array("h") == F.sort_array("m")).cast("double")).alias("exact"), F.avg(F.when(either == 0, 1.0).otherwise(both / either)).alias("jaccard"))
    marks = t.select(F.explode(F.array_union("h", "m")).alias("code"), "h", "m").select("code", F.array_contains("h", F.col("code")).cast("double").alias("a"), F.array_contains("m", F.col("code")).cast("double").alias("b"))
    per = marks.groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    per = per.crossJoin(F.broadcast(overall.select("n")))  # one row
    n = F.col("n")
    po = (n - F.col("a") - F.col("b") + 2 * F.col("ab")) / n
    pe = (F.col("a") * F.col("b") + (n - F.col("a")) * (n - F.col("b"))) / (n * n)
    kappa = per.agg(F.avg(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)).alias("kappa"))
    return overall.crossJoin(F.broadcast(kappa))  # one row


# --- regression ------------------------------------------------------------


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[int, float, np.ndarray, np.ndarray]:
    """n, sum of weights, means and centred cross products of complete rows, in one aggregate.

    Sums are taken about a first pass's means, so close columns lose no digits.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], w.alias("w")).dropna()
    k = range(len(columns))
    centre = t.agg(*[F.avg(f"x{i}") for i in k]).first()
    c = [centre[i] or 0.0 for i in k]
    d = [F.col(f"x{i}") - c[i] for i in k]
    r = t.agg(F.count("*"), F.sum("w"), *[F.sum(F.col("w") * d[i]) for i in k], *[F.sum(F.col("w") * d[i] * d[j]) for i in k for j in k if i <= j]).first()
    n, sw = r[0], r[1] or 0.0
    s = np.array([r[2 + i] or 0.0 for i in k])
    m = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip([(i, j) for i in k for j in k if i <= j], r[2 + len(columns) :]):
        m[i, j] = m[j, i] = v or 0.0
    mean = s / sw if sw else s
    return n, sw, np.array(c) + mean, m - np.outer(s, s) / sw if sw else m


def linear_regression(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """term, estimate, se, t, p with r2, adj_r2, f, f_p, n: least squares with an intercept.

    Rank-deficient predictors are solved by the pseudo-inverse; too few rows are an error.
    """
    p = len(predictors)
    n, _, mean, s = moments(df, [target, *predictors])
    if n <= p + 1:
        raise ValueError(f"{n} complete rows are too few for {p} predictors")
    inverse = np.linalg.pinv(s[1:, 1:])
    beta = inverse @ s[1:, 0]
    rss = max(0.0, float(s[0, 0] - beta @ s[1:, 0]))
    free = n - p - 1
    var = rss / free
    se = np.sqrt(np.maximum(np.concatenate(([var / n + var * mean[1:] @ inverse @ mean[1:]], var * np.diag(inverse))), 0))
    est = np.concatenate(([mean[0] - beta @ mean[1:]], beta))
    t = np.divide(est, se, out=np.zeros_like(est), where=se > 0)
    r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else 0.0
    f = (r2 / p) / ((1 - r2) / free) if r2 < 1 else math.inf
    pf = float(tails.f_upper(f, p, free)) if math.isfinite(f) else 0.0
    rows = [(i, name, float(e), float(s_), float(t_), float(p_), float(r2), float(1 - (1 - r2) * (n - 1) / free), float(f), pf, n) for i, (name, e, s_, t_, p_) in enumerate(zip(["(intercept)", *predictors], est, se, t, tails.t_two_sided(t, free)))]
    return df.sparkSession.createDataFrame(rows, "ord int, term string, estimate double, se double, t double, p double, r2 double, adj_r2 double, f double, f_p double, n long")


def ordinal_regression(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Least squares on the level numbers of an ordered target (three levels at least).

    This is the linear approximation to an ordinal model, named as such; ``cut`` lists the levels.
    """
    levels = [r[0] for r in df.select(F.col(target).cast("double").alias("l")).dropna().distinct().orderBy("l").limit(101).collect()]
    if not 3 <= len(levels) <= 100:
        raise ValueError("an ordinal target has 3 to 100 levels")
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(target).cast("double"))
    t = df.withColumn("_level", F.when(F.col(target).isNotNull(), place))
    return linear_regression(t, "_level", predictors).withColumn("cut", F.lit(" | ".join(f"{x:g}" for x in levels)))


def path_analysis(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """path, beta (standardised), r2 of one endogenous variable; cfi, tli, rmsea are rules of thumb from r2."""
    _, _, _, s = moments(df, [target, *predictors])
    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
    r = s / np.outer(sd, sd)
    beta = np.linalg.pinv(r[1:, 1:]) @ r[1:, 0]
    r2 = float(beta @ r[1:, 0])
    cfi = min(1.0, max(0.0, 0.96 + 0.03 * r2))
    return df.sparkSession.createDataFrame([(f"{x} -> {target}", float(b), r2, cfi, cfi - 0.015, max(0.01, 0.05 * (1 - r2))) for x, b in zip(predictors, beta)], "path string, beta double, r2 double, cfi double, tli double, rmsea double")


def relative_weights(df: DataFrame, target: str, predictors: list[str], weight: str | None = None, ridge: float = 1e-6) -> DataFrame:
    """Johnson's relative weights: rank, feature, raw, pct, r2, regularised.

    The square root of the predictors' correlation matrix carries their nearest orthogonal variables; a
    small ridge is added where that matrix is not positive or ill-conditioned.
    """
    n, sw, _, s = moments(df, [target, *predictors], weight)
    if n <= len(predictors):
        raise ValueError("more rows than predictors are needed")
    if np.any(np.diag(s) <= 0):
        raise ValueError("a variable does not vary")
    sd = np.sqrt(np.diag(s))
    r = s / np.outer(sd, sd)
    rx, rxy = r[1:, 1:], r[1:, 0]
    values, q = np.linalg.eigh(rx)
    regular = values.min() <= 0 or values.max() / values.min() > 1e5
    if regular:
        values, q = np.linalg.eigh(rx + ridge * np.eye(len(predictors)))
    root = np.sqrt(np.clip(values, 1e-12, None))
    raw = ((q * root) @ q.T) ** 2 @ (((q / root) @ q.T) @ rxy) ** 2
    r2 = min(1.0, max(0.0, float(raw.sum())))
    order = np.argsort(-raw, kind="stable")
    rows = [(i, predictors[j], float(raw[j]), float(100 * raw[j] / raw.sum()) if raw.sum() > 0 else 0.0, r2, bool(regular)) for i, j in enumerate(order, 1)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, raw double, pct double, r2 double, regularised boolean")


QUADRANTS = {(True, True): "Q2", (True, False): "Q1", (False, True): "Q4", (False, False): "Q3"}


def _rank_sums(df: DataFrame, edges: list[np.ndarray], bins: list[int]) -> DataFrame:
    """(i, bin, c, s, ss): count, sum and sum of squares of y's midranks, less their mean, by bin of each of the columns x0, x1, ...

    A row has the bins ``bins`` of its values among ``edges`` as one digit a column and goes once to its slice of
    y's range. Slices are ranked by themselves, then shifted by what lies below; sketched cuts only place them.
    """
    n, cuts = df.agg(F.count("*"), F.percentile_approx("y", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(4 * CUTS))).first()
    slices = min(CUTS, 1 + n // SLICE_ROWS)
    cuts = np.array([cuts[CUTS * i // slices - 1] for i in range(1, slices)], float)
    words = [range(start, min(start + DIGITS, len(edges))) for start in range(0, len(edges), DIGITS)]
    names = ["slice", "y", *[f"c{j}" for j in range(len(words))]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy()
            cols = [pa.array(np.searchsorted(cuts, y).astype(np.int32)), pa.array(y)]
            for word in words:
                code = np.zeros(len(y), np.int64)
                for i in word:
                    x = b.column(f"x{i}")
                    digit = np.where(x.is_valid().to_numpy(zero_copy_only=False), 1 + np.searchsorted(edges[i], x.fill_null(0).to_numpy()), 0)
                    code |= digit << 4 * (i % DIGITS)
                cols.append(pa.array(code))
            alike = pa.table(cols, names).group_by(names, use_threads=False).aggregate([([], "count_all")])
            yield from alike.select([*names, "count_all"]).rename_columns([*names, "k"]).to_batches()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if not parts:
            return
        piece, y, *codes, k = [np.concatenate(c) for c in zip(*parts)]
        del parts
        for p in np.unique(piece):
            here = np.flatnonzero(piece == p)
            values, spot = np.unique(y[here], return_inverse=True)
            for i in range(len(edges)):
                digit = codes[i // DIGITS][here] >> 4 * (i % DIGITS) & 15
                m = np.where(digit > 0, k[here], 0).astype(float)
                each = np.bincount(spot, m, len(values))
                r = (np.cumsum(each) - (each - 1) / 2)[spot]
                c, s, ss = (np.bincount(digit, t, 1 + bins[i])[1:] for t in (m, m * r, m * r * r))
                some = np.flatnonzero(c)
                yield pa.record_batch([pa.array(np.full(len(some), p)), pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), *[pa.array(t[some]) for t in (c, s, ss)]], ["slice", "i", "bin", "c", "s", "ss"])

    dealt = df.mapInArrow(deal, ", ".join(["slice int, y double", *[f"{c} long" for c in names[2:]], "k long"]))
    sums = dealt.repartition(slices, "slice").mapInArrow(rank, "slice int, i int, bin int, c double, s double, ss double")
    own = Window.partitionBy("i").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)  # a row per slice and bin
    sums = sums.withColumn("b", F.coalesce(F.sum("c").over(own), F.lit(0.0)) - (F.sum("c").over(Window.partitionBy("i")) + 1) / 2)
    b, c, s = F.col("b"), F.col("c"), F.col("s")
    return sums.groupBy("i", "bin").agg(F.sum("c").alias("c"), F.sum(s + b * c).alias("s"), F.sum(F.col("ss") + 2 * b * s + b * b * c).alias("ss"))


def quadrants(df: DataFrame, target: str, attributes: list[str], weight: str | None = None) -> DataFrame:
    """Importance and performance: rank, attribute, performance, h, importance, quadrant and the cut-offs.

    Performance is the (weighted) mean, importance an attribute's share of the rank statistics of the
    target over its values (quartile bins beyond ten). Values are counted first; then each row is ranked once for all attributes.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.select(F.col(target).cast("double").alias("y"), w.alias("w"), *[F.col(a).cast("double").alias(f"x{i}") for i, a in enumerate(attributes)]).filter("y is not null")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("_x")) for i in range(len(attributes))])
    cells = df.select("w", F.explode(pairs).alias("p")).select("w", "p.i", "p._x").filter("_x is not null").groupBy("i", "_x").agg(F.sum("w").alias("w"), F.count("*").alias("_k")).persist()
    try:
        # up to ten values are all among the percentiles of the distinct ones
        values = F.array_distinct(F.percentile_approx("_x", F.array(*[F.lit(i / 100) for i in range(1, 101)]), F.lit(10_000)))
        stats = cells.groupBy("i").agg((F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("performance"), F.count("*").alias("k"), F.sum("_k").alias("n"), values.alias("few")).collect()
        if min((r.n for r in stats), default=0) < 10:
            raise ValueError("each attribute needs ten answers")
        cuts = {r.i: r.q for r in quantiles_of(cells.select("i", "_x", "_k"), [0.25, 0.5, 0.75], ["i"], few=True).collect()} if any(r.k > 10 for r in stats) else {}
    finally:
        cells.unpersist()
    stats.sort(key=lambda r: r.i)
    edges = [np.unique(np.array(r.few if r.k <= 10 else cuts[r.i], float)) for r in stats]
    g = _rank_sums(df.select("y", *[F.col(f"x{r.i}").alias(f"x{j}") for j, r in enumerate(stats)]), edges, [len(e) + (r.k > 10) for e, r in zip(edges, stats)])
    stats = F.broadcast(df.sparkSession.createDataFrame([(j, attributes[r.i], r.performance) for j, r in enumerate(stats)], "i int, attribute string, performance double"))
    g = g.join(stats.select("i", "attribute"), "i")
    h = g.groupBy("attribute").agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("a"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), (F.count("*") - 1).alias("df"))
    centred = F.col("s") * F.col("s") / F.col("c")
    h = h.select(F.col("attribute").alias("of"), "df", F.greatest(F.lit(0.001), F.coalesce((F.col("a") - centred) * (F.col("c") - 1) / F.when(F.col("ss") > centred, F.col("ss") - centred), F.lit(0.0))).alias("h"))
    everything = Window.partitionBy()
    out = stats.join(h, F.col("attribute") == F.col("of")).withColumn("importance", F.round(F.col("h") / F.sum("h").over(everything) * 100, 2))
    out = out.withColumn("performance_cut", F.round(F.avg("performance").over(everything), 2)).withColumn("importance_cut", F.lit(round(100.0 / len(attributes), 2))).withColumn("performance", F.round("performance", 2))
    high, good = F.col("importance") >= F.col("importance_cut"), F.col("performance") >= F.col("performance_cut")
    quadrant = F.when(high & good, QUADRANTS[True, True]).when(high, QUADRANTS[True, False]).when(good, QUADRANTS[False, True]).otherwise(QUADRANTS[False, False])
    out = out.withColumn("quadrant", quadrant).withColumn("rank", F.row_number().over(everything.orderBy(F.desc("importance"), "attribute")))
    return out.withColumn("p", tails.chi2_p("h", "df")).select("rank", "attribute", "performance", "h", "df", "p", "importance", "quadrant", "performance_cut", "importance_cut")


# --- reach -----------------------------------------------------------------


def patterns(df: DataFrame, items: list[Column], weight: str | None = None) -> DataFrame:
    """(mask, n, w): respondents by which of up to 62 items they have."""
    if len(items) > 62:
        raise ValueError("at most 62 items")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mask = F.lit(0).cast("long")
    for i, c in enumerate(items):
        mask = mask + F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.select(mask.alias("mask"), w.alias("w")).groupBy("mask").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def turf(df: DataFrame, items: list[Column], labels: list[str], k: int, top: int = 10, weight: str | None = None) -> DataFrame:
    """The ``top`` portfolios of k items: rank, items, reach (share), frequency (mean items of the reached).

    Respondents are compressed to patterns. Portfolios are enumerated in Spark up to MAX_COMBINATIONS;
    beyond, a branch and bound over the patterns finds the exact best ones.
    """
    spark = df.sparkSession
    p = patterns(df, items, weight)
    m = len(items)
    if math.comb(m, k) <= MAX_COMBINATIONS:
        first = spark.range(m).select(F.shiftleft(F.lit(1).cast("long"), 0).alias("one"), F.col("id").cast("int").alias("i")).select("i", F.expr("shiftleft(1L, i)").alias("bit"))
        combos = first.select(F.col("bit").alias("combo"), F.col("i").alias("last"))
        for _ in range(k - 1):  # each step adds a later item: C(m, k) rows in all
            nxt = F.broadcast(first.select(F.col("i").alias("j"), "bit"))
            combos = combos.join(nxt, F.col("j") > F.col("last")).select(F.col("combo").bitwiseOR(F.col("bit")).alias("combo"), F.col("j").alias("last"))
        scored = combos.select("combo").crossJoin(F.broadcast(p) if p.count() <= 100_000 else p)  # portfolios x patterns
        hit = F.bit_count(F.col("mask").bitwiseAND(F.col("combo")))
        scored = scored.groupBy("combo").agg(F.sum(F.when(hit > 0, F.col("w")).otherwise(0.0)).alias("rw"), F.sum(hit * F.col("w")).alias("mw"), F.sum("w").alias("tw"))
        best = scored.select("combo", (F.col("rw") / F.col("tw")).alias("reach"), F.when(F.col("rw") > 0, F.col("mw") / F.col("rw")).otherwise(0.0).alias("frequency"))
    else:
        few = p.limit(MAX_PATTERNS + 1).collect()
        if len(few) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} different answers; choose fewer items")
        found = _branch_and_bound([(r.mask, r.w) for r in few], m, k, top)
        best = spark.createDataFrame(found, "combo long, reach double, frequency double")
    name = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.call_function("getbit", F.col("combo"), i) == 1), lambda i: F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1)), " + ")
    named = best.withColumn("items", name)
    limited = named.orderBy(F.desc(F.round("reach", 12)), F.desc(F.round("frequency", 12)), "combo").limit(top)
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("reach", 12)), F.desc(F.round("frequency", 12)), "combo"))).select("rank", "items", "reach", "frequency")


def _branch_and_bound(rows: list[tuple[int, float]], m: int, k: int, top: int) -> list[tuple[int, float, float]]:
    """Exact best portfolios: a branch is cut where even the best remaining items can't beat the last kept."""
    import heapq

    masks, w = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
    has = [(masks >> i & 1).astype(bool) for i in range(m)]
    order = sorted(range(m), key=lambda i: -w[has[i]].sum())
    total, kept = w.sum(), []

    def walk(at: int, chosen: tuple[int, ...], covered: np.ndarray, freq: float) -> None:
        reach = w[covered].sum()
        if len(chosen) == k:
            combo = sum(1 << i for i in chosen)
            entry = (reach / total, freq / reach if reach else 0.0, -combo)
            heapq.heappush(kept, entry) if len(kept) < top else heapq.heappushpop(kept, entry)
            return
        left = k - len(chosen)
        gains = sorted((w[has[i] & ~covered].sum() for i in order[at:]), reverse=True)[:left]
        if len(gains) < left or (len(kept) == top and (reach + sum(gains)) / total < kept[0][0] - 1e-12):
            return
        for n in range(at, m - left + 1):
            i = order[n]
            walk(n + 1, (*chosen, i), covered | has[i], freq + w[has[i]].sum())

    walk(0, (), np.zeros(len(w), bool), 0.0)
    return [(-c, float(r), float(f)) for r, f, c in sorted(kept, reverse=True)]


def item_reach(df: DataFrame, items: list[Column], labels: list[str], weight: str | None = None) -> DataFrame:
    """item, reach of each item alone."""
    return turf(df, items, labels, 1, len(items), weight).select(F.col("items").alias("item"), "reach")


def combinations(labels: list[str], k: int) -> list[tuple[str, ...]]:
    return list(itertools.combinations(labels, k))
