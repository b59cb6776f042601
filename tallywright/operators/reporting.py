"""Reports: intervals, coder evaluation, default tables and the snapshot."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators import crosstab as ct
from tallywright.operators import models, weighting
from tallywright.operators.profile import profile
from tallywright.sources.exports import Section, frequency_tables, section, top_two_box

#: Release targets of a coder: largest or least per cent.
GATE = {"other_pct": ("<=", 15.0), "theme_agree_pct": (">=", 80.0), "theme_kappa": (">=", 0.70), "sent_acc_pct": (">=", 85.0)}


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null without cases."""
    n = F.when(n > 0, n).cast("double")
    p, d = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return centre - half, centre + half


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and kappa of two columns of single codes; kappa is null where chance explains all."""
    pairs = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy())  # a row per pair of codes
    t = pairs.select("a", "b", "k", total.alias("n"))
    ea, eb = t.groupBy("a").agg(F.sum("k").alias("ka")), t.groupBy("b").agg(F.sum("k").alias("kb")).withColumnRenamed("b", "c")
    chance = ea.join(eb, F.col("a").eqNullSafe(F.col("c"))).agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).cast("double").alias("s"))
    o = t.agg(F.max("n").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("k")).otherwise(0)).alias("same")).crossJoin(F.broadcast(chance))  # one row
    po, pe = F.col("same") / F.col("n"), F.col("s") / F.col("n") / F.col("n")
    return o.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def coder_metrics(df: DataFrame, theme: str, expected_theme: str, sentiment: str, expected_sentiment: str, uncoded: Column, out_of_scope: str = "OUT_OF_SCOPE") -> DataFrame:
    """One row: shares of uncoded answers, right themes and right sentiments in per cent, with intervals."""
    inside = F.col(expected_theme) != out_of_scope
    t = df.agg(
        F.count("*").alias("n"), F.sum(uncoded.cast("int")).alias("u"), F.sum(inside.cast("int")).alias("m"),
        F.sum((inside & (F.col(theme) == F.col(expected_theme))).cast("int")).alias("t"), F.sum((F.col(sentiment) == F.col(expected_sentiment)).cast("int")).alias("s"),
    )
    cols = ["n"]
    for name, k, n in (("other", "u", "n"), ("theme_agree", "t", "m"), ("sent_acc", "s", "n")):
        low, high = wilson(F.col(k), F.col(n))
        cols += [F.round(100 * F.col(k) / F.when(F.col(n) > 0, F.col(n)), 1).alias(f"{name}_pct"), F.round(100 * low, 1).alias(f"{name}_low"), F.round(100 * high, 1).alias(f"{name}_high")]
    kappa = cohen_kappa(df.filter(inside), theme, expected_theme).select(F.round("kappa", 3).alias("theme_kappa"))
    return t.select(*cols).crossJoin(F.broadcast(kappa))  # one row each


def gate(metrics: dict[str, float | None], targets: dict[str, tuple[str, float]] = GATE) -> dict[str, bool]:
    """Which targets are met; an unknown figure meets none."""
    return {k: metrics.get(k) is not None and (metrics[k] <= t if op == "<=" else metrics[k] >= t) for k, (op, t) in targets.items()}


def default_table(df: DataFrame, weight: str | None = None, banner: str = "Region") -> DataFrame:
    """A first table: the banner, or the second column, by the first column that is a closed question."""
    kinds = {r.column: r.type for r in profile(df).collect()}  # a row per column
    banner = banner if banner in df.columns else df.columns[min(1, len(df.columns) - 1)]
    plain = re.compile(r"(id|timestamp|submitted|date|duration)$", re.I)
    stubs = [c for c in df.columns if kinds.get(c) in ("single_select", "rating_scale", "multi_select") and not plain.search(c) and c != banner]
    return ct.crosstab(df, stubs[0] if stubs else df.columns[0], [banner], weight)


def default_targets(df: DataFrame, variable: str, shares: dict[str, float]) -> dict[str, dict[str, float]]:
    """Built-in shares for a variable, only if the table has no other values of it."""
    if variable not in df.columns:
        raise ValueError("no targets given")
    strange = df.filter(F.col(variable).isNotNull() & ~F.trim(F.col(variable).cast("string")).isin(*shares)).limit(1).count()
    if strange:
        raise ValueError(f"no targets given, and {variable} has values of its own")
    return {variable: shares}


def snapshot(themes: DataFrame, delights: list[str], ignore: tuple[str, ...] = ("General", "Needs Review", "None")) -> DataFrame:
    """kind (delight, friction), theme and first quote of each theme, from ``openends.theme_frequencies``."""
    has = lambda words: F.col("theme").rlike("|".join(rf"(?i)\b{re.escape(w)}\b" for w in words)) if words else F.lit(False)
    kind = F.when(has(delights), "delight").when(~has(list(ignore)), "friction")
    return themes.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.size("quotes") > 0)).select("kind", "theme", "n", F.element_at("quotes", 1).alias("quote"))


def satisfaction(df: DataFrame, weight: str | None = None) -> float | None:
    """Share of the top two points of the first column named for satisfaction that has answers, up to five."""
    x = lambda c: F.when(~F.col(c).try_cast("double").isin(97.0, 98.0, 99.0), F.col(c).try_cast("double"))
    named = [c for c in df.columns if "csat" in c.lower() or "satisfaction" in c.lower()]
    highest = df.agg(*[F.max(x(c)).alias(c) for c in named]).first().asDict() if named else {}
    column = next((c for c in named if highest[c] is not None and highest[c] <= 5), None)
    return top_two_box(df.withColumn("_score", x(column)), "_score", weight).first().share if column else None


def key_figures(df: DataFrame, weight: str | None = None) -> Section:
    """Respondents, effective base, weighting efficiency and satisfaction, for the snapshot."""
    n = df.count()
    w = weighting.weight_diagnostics(df, weight).first() if weight else None
    csat = satisfaction(df, weight)
    neff, efficiency = (w.neff or 0.0, 100 * (w.efficiency or 0.0)) if w else (float(n), 100.0)
    return Section("Key figures", [["figure", "value"], ["Respondents", n], ["Effective base", neff], ["Weighting efficiency, %", efficiency], ["Satisfaction, %", "n/a" if csat is None else 100 * csat]])


def snapshot_sections(df: DataFrame, themes: DataFrame, delights: list[str], weight: str | None = None) -> list[Section]:
    """The snapshot page: key figures, what pleases and what hurts in the answers' own words."""
    told = snapshot(themes, delights).orderBy(F.desc("n"), "theme")
    quotes = [section(told.filter(F.col("kind") == kind).select("theme", "n", "quote"), title) for kind, title in (("delight", "Delights"), ("friction", "Frictions"))]
    return [key_figures(df, weight), *quotes]


def omnibus_line(test) -> str:
    """A row of ``crosstab.omnibus`` in words: statistic, degrees of freedom and p without a leading zero."""
    if test is None:
        return ""
    if test.skipped:
        return f"Not tested: {test.skipped}."
    if test.stat is None or test.p is None:
        return "Not tested: too few answers."
    df = f"{test.df1:.4g}" + (f", {test.df2:.4g}" if test.df2 is not None else "")
    name = {"chi_square": "Chi-square", "rao_scott_2": "Rao-Scott chi-square", "anova": "F"}[test.test]
    return f"{name}({df}) = {test.stat:.2f}, p " + ("< .001" if test.p < 0.001 else "= " + f"{test.p:.3f}".removeprefix("0"))


def tables_for_report(
    df: DataFrame, demographics: list[str] = (), crosstabs: list[tuple[str, list[str]]] = (), measures: list[str] = (), themes: DataFrame | None = None, weight: str | None = None,
) -> list[Section]:
    """Sections of a report: categories, crosstabs with the test of the whole table, means and deviations, themes.

    ``sources.exports.sections_book`` and ``sections_page`` write them as a workbook or a page.
    """
    out = []
    if demographics:
        counts = frequency_tables(df, list(demographics), weight).orderBy("variable", *ct.natural(F.col("category")))
        out.append(section(counts.select("variable", "category", "n", F.round("percent", 1).alias("%"), F.round("weighted", 1).alias("weighted n")), "Characteristics of the respondents"))
    for stub, banner in crosstabs:
        cells = sorted(ct.crosstab(df, stub, banner, weight=weight).collect(), key=lambda r: (r.row_ord, r.col_ord))  # lines and columns are bounded
        columns = sorted({(c.col_ord, c.col_label, c.base_n) for c in cells})
        lines = {}
        for c in cells:
            lines.setdefault((c.row_ord, c.label), {})[c.col_ord] = f"{c.value:.1f}{' ' + c.letters if c.letters else ''}" if c.value is not None else ""
        rows = [[stub, *[label for _, label, _ in columns]], ["Base", *[n for *_, n in columns]], *[[label, *[line.get(o, "") for o, *_ in columns]] for (_, label), line in sorted(lines.items())]]
        out.append(Section(f"{stub} by {', '.join(banner) or 'default banner'}", rows, omnibus_line(ct.omnibus(df, stub, banner, weight).first())))
    if measures:
        out.append(section(models.descriptives(df, list(measures)), "Means and standard deviations"))
    if themes is not None:
        out.append(section(themes.orderBy(F.desc("n"), "theme").select("theme", "n", "prevalence"), "Themes of the answers"))
    return out


def nearest_topics(df: DataFrame, column: str, codeframe: dict, embed: Callable[[list[str]], np.ndarray], least: float = 0.35) -> DataFrame:
    """``df`` with ``topic`` and ``similarity``: the topic whose centroid of quotes and keywords is nearest.

    ``embed`` turns texts into rows of numbers and must be picklable; centroids are made once on the
    driver, as many as the codeframe has topics.
    """
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    ids, rows = [], []
    for t in codeframe["topics"]:
        texts = [x for x in [*t.get("exemplars", ()), t.get("subnet", ""), *list(t.get("keywords", ()))[:40]] if x]
        if texts:
            ids.append(t["id"])
            rows.append(unit(np.asarray(embed(texts), float)).mean(0))
    sent = df.sparkSession.sparkContext.broadcast((ids, unit(np.stack(rows)) if rows else None))

    @F.pandas_udf("topic string, similarity double")
    def run(s: pd.Series) -> pd.DataFrame:
        names, centroids = sent.value
        if centroids is None or not len(s):
            return pd.DataFrame({"topic": [None] * len(s), "similarity": [0.0] * len(s)})
        sims = unit(np.asarray(embed([t or "" for t in s]), float)) @ centroids.T
        best = sims.argmax(1)
        top = sims[np.arange(len(s)), best]
        return pd.DataFrame({"topic": [names[b] if v >= least else None for b, v in zip(best, top)], "similarity": top})

    return df.withColumn("_near", run(column)).select("*", "_near.topic", "_near.similarity").drop("_near")
