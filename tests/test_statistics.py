import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import multiplicity, tails
from tallywright.operators import crosstab as ct
from tallywright.operators import models, weighting


def test_tails_known_values():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9) and 0 < tails.normal_two_sided(9.0) < 1e-15
    assert tails.f_upper(0.87, 3, 2000) == pytest.approx(0.456, abs=2e-3)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8) and tails.chi2_upper(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(0, 3) == 1 and tails.f_upper(-1, 2, 3) == 1
    for n in (1, 2, 5, 30):  # an F of one degree is a squared t
        assert tails.f_upper(2.5**2, 1, n) == pytest.approx(float(tails.t_two_sided(2.5, n)), rel=1e-10)


@given(st.floats(0.01, 50), st.integers(2, 40))
@settings(max_examples=60, deadline=None)
def test_chi2_of_even_degrees_is_poisson(x, k):
    want = sum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(k))
    assert float(tails.chi2_upper(x, 2 * k)) == pytest.approx(want, rel=1e-9, abs=1e-14)


def test_multiplicity(spark):
    ps = [0.01, float("nan"), 0.02, 0.85, None]
    df = spark.createDataFrame([(i, 1, p) for i, p in enumerate(ps)], "i int, g int, p double")
    bh = [r.significant for r in multiplicity.decided(df, "p", ["g"], tie=["i"]).orderBy("i").collect()]
    by = [r.significant for r in multiplicity.decided(df, "p", ["g"], method="by", tie=["i"]).orderBy("i").collect()]
    assert bh == [True, False, True, False, False] and by[1] is False
    adj = [r.p_adj for r in multiplicity.adjusted(df, "p", ["g"], "bh", ["i"]).orderBy("i").collect()]
    assert adj[0] == pytest.approx(0.03) and adj[1] is None and adj[2] == pytest.approx(0.03)
    holm = [r.p_adj for r in multiplicity.adjusted(df, "p", ["g"], "holm", ["i"]).orderBy("i").collect()]
    assert holm[0] == pytest.approx(0.03) and holm[2] == pytest.approx(0.04)


def test_benchmark_and_letters(spark):
    rows = [("A", "yes" if i < 200 else "no", 1.0) for i in range(400)] + [("B", "yes" if i < 232 else "no", 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "G string, Y string, w double")
    t = {(r.label, r.col_label): r for r in ct.crosstab(df, "Y", ["G"]).collect()}
    assert t["yes", "B"].letters == "A" and t["yes", "A"].letters == "" and t["yes", "Total"].letters == "-"
    strict = {(r.label, r.col_label): r for r in ct.crosstab(df, "Y", ["G"], confidence=99).collect()}
    assert strict["yes", "B"].letters == "a"
    tenfold = {(r.label, r.col_label): r for r in ct.crosstab(df.withColumn("w", F.lit(10.0)), "Y", ["G"], "w").collect()}
    assert all(tenfold[k].letters == t[k].letters and tenfold[k].neff == t[k].neff for k in t)


def test_small_bases_have_no_letters(spark):
    rows = [("tiny", "yes") for _ in range(12)] + [("big", "no" if i % 2 else "yes") for i in range(200)]
    t = ct.crosstab(spark.createDataFrame(rows, "G string, Buy string"), "Buy", ["G"]).collect()
    assert all(r.letters in ("", "-") for r in t) and {r.col_label: r.small_base for r in t} == {"Total": False, "tiny": True, "big": False}


def test_scale_rows(spark):
    rows = [(g, 1 + i % 4) for g in "xy" for i in range(100)]
    t = [r for r in ct.crosstab(spark.createDataFrame(rows, "G string, Sat_1to5 int"), "Sat_1to5", ["G"], metric="t2b").collect() if r.col_ord == 0]
    assert [(r.label, r.value) for r in t] == [("NET: Top-2-Box (4-5)", 0.25)]
    more = [4] * 30 + [3] * 30 + [2] * 20 + [99] * 20
    t = [r for r in ct.crosstab(spark.createDataFrame([("a", v) for v in more], "G string, Sat_1to5 int"), "Sat_1to5", ["G"], metric="t2b").collect() if r.col_ord == 0]
    assert t[0].value == 0.375 and t[0].base_n == 100


def test_banner_resolution(spark):
    df = spark.createDataFrame([("NCR", "Female", 1), ("Luzon", "Male", 0), ("NCR", None, 1)], "Region string, Gender string, Flag int")
    labels = [b[0] for b in ct.banners(df, ["Total", "gender"])]
    assert labels == ["Female", "Male"]
    got = ct.crosstab(df, "Region", ["NCR (A)", "Flag"]).collect()
    assert {(r.col_label, r.base_n) for r in got} == {("Total", 3), ("NCR (A)", 2), ("Flag", 2)}
    assert ct.letter(1) == "A" and ct.letter(27) == "AA" and ct.resolve_column(df, "re-gion") == "Region"


def test_rao_scott_matches_eigenvalues(spark):
    draw = np.random.Generator(np.random.PCG64(3))
    y = draw.random((300, 4)) < np.array([0.2, 0.5, 0.7, 0.4])
    y[:, 1] |= y[:, 0]
    g = draw.integers(0, 3, 300)
    names = list("abcd")
    df = spark.createDataFrame([(str(k), [n for n, f in zip(names, r) if f]) for k, r in zip(g, y)], "group string, chosen array<string>")
    got = ct.rao_scott(df, names).first()
    lam = np.repeat(np.linalg.eigvalsh(np.corrcoef(y.astype(float), rowvar=False)), 2)
    x2 = 0.0
    for j in range(4):
        table = np.array([[((g == k) & (y[:, j] == v)).sum() for k in range(3)] for v in (1, 0)], float)
        e = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True) / table.sum()
        x2 += ((table - e) ** 2 / e).sum()
    a2 = ((lam - lam.mean()) ** 2).sum() / (len(lam) * lam.mean() ** 2)
    assert got.stat == pytest.approx(x2 / (lam.mean() * (1 + a2)), rel=1e-9) and got.df == pytest.approx(len(lam) / (1 + a2), rel=1e-9)


def test_raking(spark):
    rows = [(r, "Female" if i % 5 < 3 else "Male") for i, r in enumerate(["NCR"] * 30 + ["Luzon"] * 50 + ["VisMin"] * 20)]
    df = spark.createDataFrame(rows, "Region string, Gender string")
    out, raking = weighting.rim_weights(df, {"Region": {"NCR": 0.2, "Luzon": 0.5, "VisMin": 0.3}, "Gender": {"Female": 0.5, "Male": 0.5}})
    assert raking.diagnostics["converged"] and raking.diagnostics["max_margin_error"] < 0.02
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(100)
    with pytest.raises(ValueError, match="0 respondents"):
        weighting.rim_weights(df.filter("Region = 'NCR'"), {"Region": {"NCR": 0.5, "Mindanao": 0.5}})
    with pytest.raises(ValueError, match="no target"):
        weighting.rim_weights(df, {"Region": {"NCR": 0.5, "Luzon": 0.5}})
    assert weighting.normalised_targets({"A": 20, "B": 30})["A"] == 0.4
    with pytest.raises(ValueError):
        weighting.normalised_targets({"A": 0.4, "B": 0.5})
    assert weighting.kish(np.array([2.0] * 50 + [0.5] * 50)) == pytest.approx(73.529, abs=1e-3)


def test_raking_cells_equal_rows():
    draw = random.Random(2)
    cells = [(a, b) for a in "xy" for b in "pqr"]
    n = np.array([draw.randrange(5, 60) for _ in cells])
    targets = {"a": {"x": 0.3, "y": 0.7}, "b": {"p": 0.2, "q": 0.3, "r": 0.5}}
    one = weighting.rake_cells(["a", "b"], cells, n, targets)
    rows = [c for c, k in zip(cells, n) for _ in range(k)]
    each = weighting.rake_cells(["a", "b"], rows, np.ones(len(rows)), targets)
    assert np.allclose(np.repeat(one.weights, n), each.weights, atol=1e-9)


def test_rank_tests(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 20, 30, 40)], "y int")
    assert [r.midrank for r in models.midranks(df, "y").orderBy("y").collect()] == [1, 2.5, 2.5, 4, 5]
    draw = random.Random(1)
    rows = [(g, min(5, draw.randrange(1, 6) + (g == "c")), 1.0) for g in "abc" for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, y int, w double")
    plain, scaled = models.kruskal_wallis(df, "y", "g").first(), models.kruskal_wallis(df.withColumn("w", F.lit(10.0)), "y", "g", "w").first()
    y = np.array([r[1] for r in rows], float)
    order = np.sort(y)
    rank = np.array([(np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in y])
    h = sum(80 * (rank[k : k + 80].mean() - rank.mean()) ** 2 for k in (0, 80, 160)) / (((rank - rank.mean()) ** 2).sum() / 239)
    assert plain.h == pytest.approx(h) and scaled.h == pytest.approx(h) and plain.df == 2
    assert models.dunn(df, "y", "g").count() == 3


def test_relative_weights_sum_to_r2(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.normal(size=(200, 3))
    x[:, 1] += x[:, 0]
    y = x @ [1.0, 0.5, 0.2] + draw.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    rows = models.relative_weights(df, "y", ["a", "b", "c"]).collect()
    reg = models.linear_regression(df, "y", ["a", "b", "c"]).collect()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert sum(r.raw for r in rows) == pytest.approx(reg[0].r2) and sum(r.pct for r in rows) == pytest.approx(100)
    assert [r.estimate for r in sorted(reg, key=lambda r: r.ord)] == pytest.approx(want.tolist())
    near = df.withColumn("b", F.col("a") + F.rand(1) * 1e-4)
    assert models.relative_weights(near, "y", ["a", "b"]).first().regularised


def test_turf(spark):
    m = [(1, 1, 0, 3.0), (1, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 0, 0, 1.0)]
    df = spark.createDataFrame(m, "a int, b int, c int, w double")
    items = [F.col(k) == 1 for k in "abc"]
    one = {r["items"]: r.reach for r in models.turf(df, items, list("abc"), 1).collect()}
    assert one == {"a": 0.5, "b": 0.5, "c": 0.25}
    two = {r["items"]: r.reach for r in models.turf(df, items, list("abc"), 2).collect()}
    assert two == {"a + b": 0.75, "b + c": 0.75, "a + c": 0.5}
    assert {r["items"]: r.reach for r in models.turf(df, items, list("abc"), 1, weight="w").collect()}["a"] == pytest.approx(4 / 6)


def test_branch_and_bound_is_exact():
    draw = random.Random(4)
    rows = [(draw.randrange(1 << 9), draw.random()) for _ in range(60)]
    got = models._branch_and_bound(rows, 9, 3, 5)
    total = sum(w for _, w in rows)
    every = sorted((sum(w for p, w in rows if p & sum(1 << i for i in c)) / total for c in models.combinations(list(range(9)), 3)), reverse=True)
    assert [r[1] for r in got] == pytest.approx(every[:5])


def test_kendall_and_spearman(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(5), draw.randrange(4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "x int, y int")
    s = sum((a > c) - (a < c) and ((a > c) - (a < c)) * ((b > d) - (b < d)) for i, (a, b) in enumerate(rows) for c, d in rows[:i])
    ties = lambda k: sum(a[k] == b[k] for i, a in enumerate(rows) for b in rows[:i])
    n = 60 * 59 / 2
    assert models.correlation(df, "x", "y", "kendall").first().r == pytest.approx(s / math.sqrt((n - ties(0)) * (n - ties(1))))
    assert models.correlation(df, "x", "x", "spearman").first().r == pytest.approx(1)


def test_agreement(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c"]), (["b"], ["b"])], "h array<string>, m array<string>")
    assert models.agreement(df, F.col("h"), F.col("m")).first().exact == pytest.approx(2 / 3)


def test_quadrants(spark):
    draw = random.Random(1)
    rows = [tuple(draw.randrange(1, 6) for _ in range(5)) for _ in range(120)]
    q = models.quadrants(spark.createDataFrame(rows, "y int, a int, b int, c int, d int"), "y", list("abcd")).collect()
    assert q[0].importance_cut == 25.0 and sum(r.importance for r in q) == pytest.approx(100, abs=0.1) and [r["rank"] for r in q] == [1, 2, 3, 4]


def test_quadrants_in_slices(spark, monkeypatch):
    """Against ranks by pandas: nulls, ties, NaN, quartile bins, weights, more columns than fit in one number; rows are not multiplied."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(models, "SLICE_ROWS", 50)
    draw = random.Random(2)
    names = [f"a{i}" for i in range(17)]
    some = lambda x: None if draw.random() < 0.1 else x
    for scale in (1000, 3):
        rows = [(some(float(draw.randrange(scale))), draw.random(), *[some(float(draw.randrange(-3, 4 + 3 * i))) for i in range(16)], 7.0) for _ in range(700)]
        rows[0] = (float("nan"), *rows[0][1:])
        df = spark.createDataFrame(rows, "y double, w double, " + ", ".join(f"{n} double" for n in names))
        out = models.quadrants(df, "y", names, "w")
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.attribute: r for r in out.collect()}
        assert set(got) == set(names)
        for i, n in enumerate(names):
            y, w, x = (np.array(v) for v in zip(*[(1e9 if r[0] != r[0] else r[0], r[1], r[2 + i]) for r in rows if r[0] is not None and r[2 + i] is not None]))
            bins = x if len(set(x)) <= 10 else np.searchsorted(np.unique(np.quantile(x, [0.25, 0.5, 0.75])), x)
            r = pd.Series(y).rank() - (len(y) + 1) / 2
            h = (r.groupby(bins).sum() ** 2 / r.groupby(bins).count()).sum() * (len(y) - 1) / (r * r).sum()
            assert got[n].h == pytest.approx(max(0.001, h), rel=1e-9) and got[n].df == len(set(bins)) - 1
            assert got[n].performance == pytest.approx((w * x).sum() / w.sum(), abs=0.0051)
    with pytest.raises(ValueError, match="ten answers"):
        models.quadrants(df.limit(5), "y", names)


def test_exact_rank_tests(spark):
    """p values of small samples without ties, against all orders and all signs."""
    from itertools import combinations, product

    a, b = [1.1, 5.0, 7.5, 9.0], [0.3, 2.0, 2.5, 3.0, 4.0, 6.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    us = [sum(sum(k > j for j in set(range(10)) - set(c)) for k in c) for c in combinations(range(10), 4)]
    r = models.mann_whitney(df, "x", "g", "a", "b").first()
    assert r.u == sum(x > y for x in a for y in b)
    assert r.p == pytest.approx(min(1, 2 * sum(u >= max(r.u, 24 - r.u) for u in us) / len(us)), abs=1e-12)
    assert [us.count(u) for u in range(25)] == models.rank_sum_ways(4, 6)
    d = [1.5, -0.5, 3.0, 4.0, -2.0, 6.0, 0.0, None]
    r = models.wilcoxon(spark.createDataFrame([(0.0, x) for x in d], "b double, a double"), "b", "a").first()
    sums = [sum(i for i, s in enumerate(signs, 1) if s) for signs in product((0, 1), repeat=6)]
    assert r.w == 4 and r.n == 6 and r.p == pytest.approx(2 * sum(w <= 4 for w in sums) / 64, abs=1e-12)
    tied = models.mann_whitney(df.union(spark.createDataFrame([("b", 1.1)], df.schema)), "x", "g", "a", "b").first()
    assert tied.p == pytest.approx(math.erfc(tied.z / math.sqrt(2)), abs=1e-9)
    assert models.mann_whitney(df, "x", "g", "a", "nobody").first().p is None
    assert models.exact_rank_sum_p(3, 9, 9) is None and models.exact_signed_rank_p(3, 51) is None
