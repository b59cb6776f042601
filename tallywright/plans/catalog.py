"""Registered queries over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import multiplicity
from tallywright.functions import textprep
from tallywright.operators import crosstab as ct
from tallywright.operators import hygiene, models, multiselect, openends, reporting, rules, weighting
from tallywright.operators import profile as profiling
from tallywright.plans import tailsql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# --- crosstabs ---------------------------------------------------------------

_CELLS = """
    WITH base AS (SELECT o_orderpriority AS label, o_orderstatus AS banner, o_totalprice / 1000 AS w FROM orders),
    long AS (SELECT label, w, 'Total' AS col, 0 AS col_ord FROM base
        UNION ALL SELECT label, w, banner, b.ord FROM base JOIN (SELECT v, row_number() OVER (ORDER BY v) AS ord FROM (SELECT DISTINCT banner AS v FROM base)) b ON banner = v),
    bases AS (SELECT col, col_ord, count(*) AS n, sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS raw FROM long GROUP BY 1, 2),
    lines AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS row_ord FROM base GROUP BY 1),
    cells AS (SELECT l.row_ord, l.label, b.col, b.col_ord, b.n, b.sw, round(b.raw, 1) AS neff, coalesce(sum(x.w), 0) / b.sw AS p
        FROM lines l CROSS JOIN bases b LEFT JOIN long x ON x.label = l.label AND x.col_ord = b.col_ord GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


@query(_CELLS + """
    SELECT CAST(row_ord AS INTEGER) AS row_ord, label, CAST(col_ord AS INTEGER) AS col_ord, col AS col_label, n AS base_n, round(sw, 1) AS base_w, neff, neff < 30 AS small_base, round(p, 6) AS value FROM cells""")
def crosstab_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases, effective bases and weighted shares of priority by status, weighted by price."""
    df = read(spark, sf_dir, "orders").withColumn("w", F.col("o_totalprice") / 1000)
    t = ct.crosstab(df, "o_orderpriority", ["o_orderstatus"], "w")
    return t.select(F.col("row_ord").cast("int"), "label", F.col("col_ord").cast("int"), "col_label", "base_n", "base_w", "neff", "small_base", F.round("value", 6).alias("value"))


@query(_CELLS + """,
    pairs AS (SELECT a.row_ord, a.col_ord AS i, b.col_ord AS j, chr(CAST(64 + a.col_ord AS INTEGER)) AS li, chr(CAST(64 + b.col_ord AS INTEGER)) AS lj, a.neff AS ni, b.neff AS nj,
        (a.p - b.p) / sqrt(((a.p * a.neff + b.p * b.neff) / (a.neff + b.neff)) * (1 - (a.p * a.neff + b.p * b.neff) / (a.neff + b.neff)) * (1 / a.neff + 1 / b.neff)) AS z
        FROM cells a JOIN cells b ON a.row_ord = b.row_ord AND a.col_ord < b.col_ord WHERE a.col_ord > 0),
    won AS (SELECT row_ord, CASE WHEN z > 0 THEN i ELSE j END AS col_ord, i, j, CASE WHEN abs(z) > 1.959963985 THEN upper(CASE WHEN z > 0 THEN lj ELSE li END) WHEN abs(z) > 1.644853627 THEN lower(CASE WHEN z > 0 THEN lj ELSE li END) END AS m
        FROM pairs WHERE ni >= 20 AND nj >= 20),
    letters AS (SELECT row_ord, col_ord, string_agg(m, ' ' ORDER BY i, j) AS letters FROM won WHERE m IS NOT NULL GROUP BY 1, 2),
    rest AS (SELECT c.*, t.n AS tn, t.neff AS tneff, t.p AS tp, greatest(0, least(1, (t.p * t.n - c.p * c.n) / (t.n - c.n))) AS pr, greatest(1, (t.n - c.n) * t.neff / t.n) AS nr FROM cells c JOIN cells t ON c.row_ord = t.row_ord AND t.col_ord = 0 WHERE c.col_ord > 0),
    bz AS (SELECT *, (p - pr) / sqrt(((p * neff + pr * nr) / (neff + nr)) * (1 - (p * neff + pr * nr) / (neff + nr)) * (1 / neff + 1 / nr)) AS z FROM rest)
    SELECT CAST(c.row_ord AS INTEGER) AS row_ord, c.label, CAST(c.col_ord AS INTEGER) AS col_ord, c.col AS col_label, CASE WHEN c.col_ord = 0 THEN '-' ELSE coalesce(l.letters, '') END AS letters,
        CASE WHEN c.col_ord = 0 THEN '-' WHEN b.neff < 20 OR b.nr < 20 THEN '' WHEN z > 1.959963985 THEN '++' WHEN z > 1.644853627 THEN '+' WHEN z < -1.959963985 THEN '--' WHEN z < -1.644853627 THEN '-' ELSE '' END AS benchmark
    FROM cells c LEFT JOIN letters l ON c.row_ord = l.row_ord AND c.col_ord = l.col_ord LEFT JOIN bz b ON c.row_ord = b.row_ord AND c.col_ord = b.col_ord""")
def crosstab_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column letters and rest-of-sample benchmarks of the weighted crosstab."""
    df = read(spark, sf_dir, "orders").withColumn("w", F.col("o_totalprice") / 1000)
    t = ct.crosstab(df, "o_orderpriority", ["o_orderstatus"], "w")
    return t.select(F.col("row_ord").cast("int"), "label", F.col("col_ord").cast("int"), "col_label", "letters", "benchmark")


_MEANS = """
    WITH o AS (SELECT v, row_number() OVER (ORDER BY v) AS ord FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)),
    long AS (SELECT l_linenumber AS x, l_quantity AS w, 'Total' AS col, 0 AS ord FROM lineitem UNION ALL SELECT l_linenumber, l_quantity, l_returnflag, ord FROM lineitem JOIN o ON l_returnflag = v),
    s AS (SELECT col, ord, count(*) AS n, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) AS sx, sum(w * x * x) AS sxx FROM long GROUP BY 1, 2),
    m AS (SELECT *, sx / sw AS mean, sqrt((sxx / sw - sx / sw * sx / sw) * n / (n - 1)) AS sd, sw * sw / sww AS raw, round(sw * sw / sww, 1) AS neff FROM s)"""


@query(_MEANS + f""",
    pairs AS (SELECT a.ord AS i, b.ord AS j, a.neff AS na, b.neff AS nb, a.mean - b.mean AS d, a.sd * a.sd / a.neff AS va, b.sd * b.sd / b.neff AS vb FROM m a JOIN m b ON a.ord < b.ord WHERE a.ord > 0),
    tested AS (SELECT *, d / sqrt(va + vb) AS t, power(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM pairs),
    won AS (SELECT CASE WHEN d > 0 THEN i ELSE j END AS ord, i, j, chr(CAST(CASE WHEN d > 0 THEN 64 + j ELSE 64 + i END AS INTEGER)) AS l, {tailsql.t("t", "df")} AS p FROM tested WHERE na >= 20 AND nb >= 20),
    letters AS (SELECT ord, string_agg(CASE WHEN p < 0.05 THEN l WHEN p < 0.10 THEN lower(l) END, ' ' ORDER BY i, j) AS letters FROM won GROUP BY 1),
    rest AS (SELECT c.*, t.n - c.n AS rn, t.sw - c.sw AS rw, t.sww - c.sww AS rww, t.sx - c.sx AS rx, t.sxx - c.sxx AS rxx FROM m c JOIN m t ON t.ord = 0 WHERE c.ord > 0),
    bench AS (SELECT ord, raw, rw * rw / rww AS rraw, mean - rx / rw AS d, sd * sd / raw AS va, (rxx / rw - rx / rw * rx / rw) * rn / (rn - 1) / (rw * rw / rww) AS vb FROM rest),
    bt AS (SELECT *, d / sqrt(va + vb) AS t, power(va + vb, 2) / (va * va / (raw - 1) + vb * vb / (rraw - 1)) AS df FROM bench),
    bp AS (SELECT *, {tailsql.t("t", "df")} AS p FROM bt)
    SELECT m.col AS col_label, m.n AS base_n, round(mean, 6) AS value, round(sd, 6) AS sd, neff, CASE WHEN m.ord = 0 THEN '-' ELSE coalesce(letters, '') END AS letters,
        CASE WHEN m.ord = 0 THEN '-' WHEN bp.raw < 20 OR rraw < 20 THEN '' WHEN p < 0.05 THEN CASE WHEN d > 0 THEN '++' ELSE '--' END WHEN p < 0.10 THEN CASE WHEN d > 0 THEN '+' ELSE '-' END ELSE '' END AS benchmark, round(p, 6) AS p
    FROM m LEFT JOIN letters l ON m.ord = l.ord LEFT JOIN bp ON m.ord = bp.ord""")
def crosstab_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and standard deviation of line number by return flag, with letters and benchmark."""
    t = ct.crosstab(read(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"], "l_quantity", metric="mean", stat_columns=True)
    p = F.when(F.col("col_ord") > 0, F.round("bm_p", 6)).alias("p")
    return t.select("col_label", "base_n", F.round("value", 6).alias("value"), F.round("sd", 6).alias("sd"), "neff", "letters", "benchmark", p)


@query("""
    WITH long AS (SELECT l_linenumber AS x, l_quantity AS w, 'Total' AS col FROM lineitem UNION ALL SELECT l_linenumber, l_quantity, l_returnflag FROM lineitem)
    SELECT 'NET: Top-2-Box (6-7)' AS label, col AS col_label, round(sum(CASE WHEN x IN (6, 7) THEN w ELSE 0 END) / sum(w), 6) AS value FROM long GROUP BY col""")
def crosstab_top_two_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-two-box share of line number, a scale of 1 to 7, by return flag."""
    t = ct.crosstab(read(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"], "l_quantity", metric="t2b")
    return t.select("label", "col_label", F.round("value", 6).alias("value"))


@query("""
    WITH top AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1), n AS (SELECT count(*) - 12 AS more FROM top)
    SELECT CASE WHEN r <= 12 THEN p_brand ELSE 'Other (' || more || ' categories)' END AS label, round(count(*) * 1.0 / (SELECT count(*) FROM part), 6) AS value
    FROM part JOIN top USING (p_brand), n GROUP BY 1""")
def crosstab_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent brands and the rest."""
    t = ct.crosstab(read(spark, sf_dir, "part"), "p_brand", ["p_size"])
    return t.filter("col_ord = 0").select("label", F.round("value", 6).alias("value"))


@query(f"""
    WITH o AS (SELECT v, row_number() OVER (ORDER BY v) AS ord FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)),
    long AS (SELECT l_linenumber AS x, l_quantity AS w, 'Total' AS col, 0 AS ord FROM lineitem UNION ALL SELECT l_linenumber, l_quantity, l_returnflag, ord FROM lineitem JOIN o ON l_returnflag = v),
    r AS (SELECT 0 AS row_ord, 'NET: Top-2-Box (6-7)' AS label, true AS is_net, 6 AS lo, 7 AS hi UNION ALL SELECT 8 - k, CAST(k AS VARCHAR), false, k, k FROM range(1, 8) g(k)),
    cells AS (SELECT row_ord, label, is_net, ord, col, count(*) AS n, sum(w) AS sw, round(sum(w) * sum(w) / sum(w * w), 1) AS neff, sum(CASE WHEN x BETWEEN lo AND hi THEN w ELSE 0 END) / sum(w) AS p FROM long, r GROUP BY ALL),
    z AS (SELECT a.row_ord, a.ord AS i, b.ord AS j, a.neff AS na, b.neff AS nb, (a.p - b.p) / sqrt((a.p * a.neff + b.p * b.neff) / (a.neff + b.neff) * (1 - (a.p * a.neff + b.p * b.neff) / (a.neff + b.neff)) * (1 / a.neff + 1 / b.neff)) AS z
        FROM cells a JOIN cells b ON a.row_ord = b.row_ord AND a.ord < b.ord WHERE a.ord > 0),
    q AS (SELECT *, {tailsql.normal("z")} AS q FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY row_ord ORDER BY q, i, j) AS r, count(*) OVER (PARTITION BY row_ord) AS m FROM q),
    adj AS (SELECT *, least(1.0, min(q * m / r * list_sum(list_transform(range(1, m + 1), lambda h: 1.0 / h))) OVER (PARTITION BY row_ord ORDER BY r DESC)) AS pa FROM k),
    won AS (SELECT row_ord, CASE WHEN z > 0 THEN i ELSE j END AS ord, i, j, pa, chr(CAST(CASE WHEN z > 0 THEN 64 + j ELSE 64 + i END AS INTEGER)) AS l FROM adj WHERE na >= 20 AND nb >= 20),
    letters AS (SELECT row_ord, ord, string_agg(CASE WHEN pa < 0.05 THEN l WHEN pa < 0.10 THEN lower(l) END, ' ' ORDER BY i, j) AS letters FROM won GROUP BY 1, 2),
    rest AS (SELECT c.row_ord, c.ord, c.p, c.neff, greatest(0, least(1, (t.p * t.n - c.p * c.n) / (t.n - c.n))) AS pr, greatest(1, (t.n - c.n) * t.neff / t.n) AS nr FROM cells c JOIN cells t ON c.row_ord = t.row_ord AND t.ord = 0 WHERE c.ord > 0),
    b AS (SELECT *, (p - pr) / sqrt((p * neff + pr * nr) / (neff + nr) * (1 - (p * neff + pr * nr) / (neff + nr)) * (1 / neff + 1 / nr)) AS z FROM rest), bp AS (SELECT *, {tailsql.normal("z")} AS q FROM b)
    SELECT CAST(c.row_ord AS INTEGER) AS row_ord, label, is_net, CAST(c.ord AS INTEGER) AS col_ord, c.col AS col_label, CASE WHEN c.ord = 0 THEN '' ELSE chr(CAST(64 + c.ord AS INTEGER)) END AS letter, c.n AS base_n, round(sw, 1) AS base_w, c.neff, c.neff < 30 AS small_base,
        round(c.p, 4) AS value, CAST(NULL AS DOUBLE) AS sd, CASE WHEN c.ord = 0 THEN '-' ELSE coalesce(letters, '') END AS letters,
        CASE WHEN c.ord = 0 THEN '-' WHEN bp.neff < 20 OR nr < 20 THEN '' WHEN q < 0.05 THEN CASE WHEN z > 0 THEN '++' ELSE '--' END WHEN q < 0.10 THEN CASE WHEN z > 0 THEN '+' ELSE '-' END ELSE '' END AS benchmark
    FROM cells c LEFT JOIN letters l ON c.row_ord = l.row_ord AND c.ord = l.ord LEFT JOIN bp ON c.row_ord = bp.row_ord AND c.ord = bp.ord""")
def crosstab_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters under false-discovery control for dependent tests."""
    return rounded(ct.crosstab(read(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"], "l_quantity", fdr="by"))


@query(f"""
    WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, sum(o_totalprice) AS w, sum(o_totalprice * o_totalprice) AS ww FROM orders GROUP BY 1, 2),
    s AS (SELECT r, c, w * sum(w) OVER () / sum(ww) OVER () AS v FROM c),
    e AS (SELECT v, sum(v) OVER (PARTITION BY r) * sum(v) OVER (PARTITION BY c) / sum(v) OVER () AS e FROM s),
    x AS (SELECT sum((v - e) * (v - e) / e) AS stat, (SELECT (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) FROM c) AS df FROM e)
    SELECT round(stat, 4) AS stat, df, round({tailsql.chi2("stat", "df")}, 6) AS p FROM x""")
def crosstab_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square of the weighted table, scaled to the effective base."""
    t = ct.crosstab_chi_square(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return t.select(F.round("stat", 4).alias("stat"), F.col("df").cast("long"), F.round("p", 6).alias("p"))


@query(f"""
    WITH g AS (SELECT l_returnflag AS g, count(*) AS n, sum(l_quantity) AS w, sum(l_quantity * l_linenumber) AS s, sum(l_quantity * l_linenumber * l_linenumber) AS ss FROM lineitem GROUP BY 1),
    a AS (SELECT sum(s * s / w) AS a, sum(s) AS s, sum(w) AS w, sum(ss) AS ss, sum(n) AS n, count(*) AS k FROM g),
    x AS (SELECT ((a - s * s / w) / (k - 1)) / ((ss - a) / (n - k)) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2 FROM a)
    SELECT round(f, 4) AS f, df1, df2, round({tailsql.f("f", "df1", "df2")}, 6) AS p FROM x""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted one-way analysis of variance of line number by return flag."""
    t = ct.anova(read(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return t.select(F.round("f", 4).alias("f"), "df1", "df2", F.round("p", 6).alias("p"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of each user and day, as a multi-select answer."""
    t = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("chosen"))
    return t.withColumn("group", (F.col("user_id") % 3).cast("string")).withColumn("answer", F.array_join(F.transform("chosen", F.initcap), ", "))


TYPES = ["click", "error", "purchase", "signup", "view"]
_DAYS = "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS chosen FROM events GROUP BY 1, 2),"


@query(_DAYS + f"""
    o(v) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')),
    y AS (SELECT user_id, day, user_id % 3 AS g, v, CASE WHEN list_contains(chosen, v) THEN 1.0 ELSE 0.0 END AS y FROM d, o),
    n AS (SELECT count(*) AS n FROM d), p AS (SELECT v, avg(y) AS p FROM y GROUP BY 1 HAVING avg(y) > 0 AND avg(y) < 1),
    x AS (SELECT sum((s - k * p) * (s - k * p) / (k * p) + (s - k * p) * (s - k * p) / (k * (1 - p))) AS x2, count(DISTINCT g) AS gs FROM (SELECT v, g, sum(y) AS s, count(*) AS k FROM y GROUP BY 1, 2) JOIN p USING (v)),
    c AS (SELECT a.v AS i, b.v AS j, avg(a.y * b.y) AS joint FROM y a JOIN y b USING (user_id, day) GROUP BY 1, 2),
    r AS (SELECT sum(power(joint - pi.p * pj.p, 2) / (pi.p * (1 - pi.p) * pj.p * (1 - pj.p))) AS f, count(DISTINCT i) AS k FROM c JOIN p pi ON i = pi.v JOIN p pj ON j = pj.v),
    s AS (SELECT x2 / (f / k) AS stat, k * (gs - 1) / (f / k) AS df FROM x, r)
    SELECT round(stat, 4) AS stat, round(df, 4) AS df, round({tailsql.chi2("stat", "df")}, 6) AS p FROM s""")
def rao_scott(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order Rao-Scott test of event types by user group."""
    t = ct.rao_scott(user_days(spark, sf_dir), TYPES)
    return t.select(F.round("stat", 4).alias("stat"), F.round("df", 4).alias("df"), F.round("p", 6).alias("p"))


@query(_DAYS + """
    e AS (SELECT unnest(chosen) AS option FROM d) SELECT upper(option[1]) || option[2:] AS option, count(*) AS n FROM e GROUP BY 1""")
def option_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a comma-joined multi-select answer with their counts."""
    return multiselect.census_table(user_days(spark, sf_dir), "answer")


@query(_DAYS + """
    m AS (SELECT user_id, day, chosen FROM d) SELECT upper(option[1]) || option[2:] AS option, col AS grp, count(*) AS mentions FROM (SELECT unnest(chosen) AS option, user_id % 3 AS col FROM m) GROUP BY 1, 2""")
def multi_response_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each option by group, from the split answers."""
    t = multiselect.resolved(user_days(spark, sf_dir), "answer", [t.title() for t in TYPES])
    return t.select(F.explode("chosen").alias("option"), (F.col("user_id") % 3).alias("grp")).groupBy("option", "grp").agg(F.count("*").alias("mentions"))


# --- weighting ---------------------------------------------------------------


@query("""
    WITH t(s, share) AS (VALUES ('F', 0.5), ('O', 0.3), ('P', 0.2)), n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
    SELECT s AS status, n, round(share * (SELECT count(*) FROM orders) / n, 6) AS weight FROM n JOIN t USING (s)""")
def rake_one_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of one margin."""
    t = weighting.one_variable_weights(read(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0.5, "O": 0.3, "P": 0.2})
    return t.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query()
def rake_two_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted margins after raking two variables: what the targets ask for."""
    targets = {"o_orderstatus": {"F": 50, "O": 30, "P": 20}, "o_orderpriority": {"1-URGENT": 0.3, "2-HIGH": 0.25, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.1}}
    t, _ = weighting.rim_weights(read(spark, sf_dir, "orders"), targets)
    return rounded(weighting.margin_report(t, "weight", "o_orderstatus").union(weighting.margin_report(t, "weight", "o_orderpriority")))


@query("""
    WITH RECURSIVE c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
    gs(s, g) AS (VALUES ('F', 0.5), ('O', 0.3), ('P', 0.2)), gp(p, g) AS (VALUES ('1-URGENT', 0.3), ('2-HIGH', 0.25), ('3-MEDIUM', 0.2), ('4-NOT SPECIFIED', 0.15), ('5-LOW', 0.1)),
    rake AS (
        SELECT 0 AS i, list(struct_pack(s := s, p := p, n := n, a := gs.g * total, b := gp.g * total, w := CAST(1 AS DOUBLE))) AS state FROM c JOIN gs USING (s) JOIN gp USING (p), (SELECT sum(n) AS total FROM c)
        UNION ALL
        SELECT i + 1, list_transform(state, lambda x: struct_pack(s := x.s, p := x.p, n := x.n, a := x.a, b := x.b, w := x.w * CASE WHEN i % 2 = 0
            THEN CAST(x.a AS DOUBLE) / list_sum(list_transform(list_filter(state, lambda y: y.s = x.s), lambda y: y.n * y.w)) ELSE CAST(x.b AS DOUBLE) / list_sum(list_transform(list_filter(state, lambda y: y.p = x.p), lambda y: y.n * y.w)) END))
        FROM rake WHERE i < 80)
    SELECT x.s AS status, x.p AS priority, CAST(x.n AS BIGINT) AS n, round(x.w, 6) AS weight FROM (SELECT unnest(state) AS x FROM rake WHERE i = 80)""")
def rake_two_margins_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all cells after raking two variables to convergence, without trimming."""
    targets = {"o_orderstatus": {"F": 50, "O": 30, "P": 20}, "o_orderpriority": {"1-URGENT": 0.3, "2-HIGH": 0.25, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.1}}
    t, _ = weighting.rim_weights(read(spark, sf_dir, "orders"), targets, tol=1e-12, trim=None)
    t = t.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return t.agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("""
    WITH q AS (SELECT quantile_cont(l_extendedprice, 0.95) AS t FROM lineitem),
    w AS (SELECT l_returnflag, l_extendedprice AS w, CASE WHEN l_extendedprice > t THEN t + ln(1 + l_extendedprice - t) ELSE l_extendedprice END AS x FROM lineitem, q),
    k AS (SELECT sum(w) / sum(x) AS k FROM w)
    SELECT l_returnflag, count(*) AS n, round(sum(x * k), 2) AS sum_w, round(sum(x * k) * sum(x * k) / sum(x * k * x * k), 4) AS neff FROM w, k GROUP BY 1""")
def soft_trim_kish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile trimming of a weight, then effective bases by group."""
    t = weighting.soft_trim(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return weighting.weight_diagnostics(t, "trimmed", ["l_returnflag"]).select("l_returnflag", "n", F.round("sum_w", 2).alias("sum_w"), F.round("neff", 4).alias("neff"))


# --- hygiene and profile -----------------------------------------------------


@query("""
    WITH r AS (SELECT *, l_orderkey || '-' || (l_partkey % 50) AS line_id, l_quantity - 3 AS seconds, l_linenumber % 3 AS a_rating, CAST(l_quantity AS BIGINT) % 3 AS b_rating, CASE WHEN l_partkey % 5 > 0 THEN l_suppkey % 3 END AS c_rating FROM lineitem),
    m AS (SELECT median(seconds) AS m FROM r WHERE seconds > 0),
    d AS (SELECT count(*) OVER (PARTITION BY line_id) > 1 AS twice, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, CAST(l_shipdate AS DATE), a_rating, b_rating, c_rating) > 1 AS same,
        (a_rating IS NOT NULL)::INT + (b_rating IS NOT NULL)::INT + (c_rating IS NOT NULL)::INT >= 2 AND least(a_rating, b_rating, c_rating) = greatest(a_rating, b_rating, c_rating) AS straight,
        seconds <= 0 AS invalid, seconds > 0 AND seconds < m / 3.0 AS speeder FROM r, m)
    SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN twice THEN 'DUPLICATE_ID' END, CASE WHEN straight THEN 'STRAIGHT_LINER' END, CASE WHEN invalid THEN 'INVALID_DURATION' END,
        CASE WHEN speeder THEN 'SPEEDER' END, CASE WHEN same THEN 'DUPLICATE_RECORD' END], lambda x: x IS NOT NULL)) AS flag FROM d) GROUP BY 1""")
def hygiene_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five flags of order lines, with columns that stand for ids, durations and ratings found by name."""
    t = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", F.col("l_partkey") % 50).alias("line_id"), (F.col("l_quantity") - 3).alias("seconds"), (F.col("l_linenumber") % 3).alias("a_rating"),
        (F.col("l_quantity").cast("long") % 3).alias("b_rating"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_suppkey") % 3).alias("c_rating"), "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship_day"),
    )
    return hygiene.audited(t, id_column="line_id").select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, max(l_linenumber) FILTER (WHERE r = 1) AS a, max(l_linenumber) FILTER (WHERE r = 2) AS b, max(l_linenumber) FILTER (WHERE r = 3) AS c
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS r FROM lineitem) GROUP BY 1)
    WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 AND least(a, b, c) = greatest(a, b, c)""")
def straight_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first three lines have the same number, as equal ratings."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    t = read(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).groupBy("l_orderkey").agg(*[F.max(F.when(F.col("r") == i, F.col("l_linenumber"))).alias(f"q{i}_rating") for i in (1, 2, 3)])
    return t.filter(hygiene.straight_liner(["q1_rating", "q2_rating", "q3_rating"])).select(F.col("l_orderkey").alias("o_orderkey"))


@query()
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey types of the customer columns."""
    return profiling.profile(read(spark, sf_dir, "customer"))


@query(r"""
    WITH v AS (SELECT unnest([struct_pack(c := 'o_orderpriority', s := o_orderpriority), struct_pack(c := 'o_orderstatus', s := o_orderstatus), struct_pack(c := 'o_totalprice', s := CAST(o_totalprice AS VARCHAR))]) AS x FROM orders),
    t AS (SELECT x.c AS variable, x.s AS s, TRY_CAST(x.s AS DOUBLE) AS d FROM v),
    w AS (SELECT variable, unnest(regexp_extract_all(lower(s), '\w+')) AS word FROM t WHERE variable <> 'o_totalprice'), k AS (SELECT variable, word, count(*) AS k, row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, word) AS r FROM w GROUP BY 1, 2),
    u AS (SELECT variable, sum(k) FILTER (WHERE r <= 30) / sum(k) AS reuse FROM k GROUP BY 1)
    SELECT variable, count(s) AS n, count(DISTINCT s) AS kinds, avg((d IS NOT NULL)::INT) AS "numeric", min(d) AS low, max(d) AS high, avg(regexp_matches(s, '^0\d+')::INT) AS zeros, avg((contains(s, ','))::INT) AS commas,
        round(avg(length(s)), 4) AS length, 0.0::DOUBLE AS dates, round(any_value(reuse), 6) AS reuse FROM t LEFT JOIN u USING (variable) GROUP BY 1""")
def profile_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the profile."""
    t = profiling.measures(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice")))
    return t.select(
        F.col("column").alias("variable"), F.col("n").cast("long").alias("n"), F.col("distinct").cast("long").alias("kinds"), "numeric", "low", "high", "zeros", "commas",
        F.round("length", 4).alias("length"), "dates", F.round("reuse", 6).alias("reuse"),
    )


# --- models ------------------------------------------------------------------

_RANKS = """
    WITH w AS (SELECT l_linenumber AS y, l_returnflag AS g, l_quantity AS w FROM lineitem WHERE l_quantity > 0){scale},
    v AS (SELECT y, sum(w) AS yw FROM s GROUP BY 1), r AS (SELECT y, (2 * sum(yw) OVER (ORDER BY y) - yw) / 2 + 0.5 AS r FROM v),
    t AS (SELECT g, w, r FROM s JOIN r USING (y)), a AS (SELECT sum(w) AS n, sum(w * r) / sum(w) AS m FROM t),
    va AS (SELECT sum(w * (r - m) * (r - m)) / (max(n) - 1) AS v FROM t, a),
    gs AS (SELECT g, count(*) AS n, sum(w) AS gw, sum(w) * sum(w) / sum(w * w) AS neff, sum(w * r) / sum(w) AS mr FROM t GROUP BY 1)"""


@query(_RANKS.replace("{scale}", ", s AS (SELECT y, g, w * (SELECT sum(w) / sum(w * w) FROM w) AS w FROM w)") + f""",
    h AS (SELECT sum(gw * (mr - m) * (mr - m)) / max(v) AS h, CAST(count(*) - 1 AS BIGINT) AS df, CAST(sum(gs.n) AS BIGINT) AS n FROM gs, a, va)
    SELECT round(h, 4) AS h, df, n, round({tailsql.chi2("h", "df")}, 6) AS p FROM h""")
def kruskal_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Kruskal-Wallis of line number by return flag."""
    t = models.kruskal_wallis(read(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return t.select(F.round("h", 4).alias("h"), "df", "n", F.round("p", 6).alias("p"))


@query(_RANKS.replace("{scale}", ", s AS (SELECT * FROM w)") + f""",
    z AS (SELECT a.g AS group_a, b.g AS group_b, a.mr - b.mr AS diff, (a.mr - b.mr) / sqrt(v * (1 / a.neff + 1 / b.neff)) AS z FROM gs a JOIN gs b ON a.g < b.g, va),
    p AS (SELECT *, {tailsql.normal("z")} AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p, group_a, group_b) AS r, count(*) OVER () AS m FROM p),
    h AS (SELECT *, least(1.0, max(p * (m - r + 1)) OVER (ORDER BY r)) AS p_adj FROM o)
    SELECT group_a, group_b, round(diff, 3) AS mean_rank_diff, round(z, 4) AS z, round(p, 6) AS p_raw, round(p_adj, 6) AS p_adj, p_adj < 0.05 AS significant FROM h""")
def dunn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Dunn comparisons."""
    t = models.dunn(read(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    digits = {"mean_rank_diff": 3, "z": 4, "p_raw": 6, "p_adj": 6}
    return t.select("group_a", "group_b", *[F.round(c, d).alias(c) for c, d in digits.items()], "significant")


@query(f"""
    WITH t AS (SELECT o_totalprice AS x, o_orderstatus AS g FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT x, g, (rank() OVER (ORDER BY x) + (rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1)) / 2.0 AS r FROM t),
    s AS (SELECT sum(r) FILTER (WHERE g = 'F') AS ra, count(*) FILTER (WHERE g = 'F') AS na, count(*) FILTER (WHERE g = 'O') AS nb,
        median(x) FILTER (WHERE g = 'F') AS median_a, median(x) FILTER (WHERE g = 'O') AS median_b FROM r),
    k AS (SELECT sum(power(k, 3) - k) AS ties FROM (SELECT count(*) AS k FROM t GROUP BY x)),
    u AS (SELECT *, ra - na * (na + 1) / 2.0 AS u, na + nb AS n FROM s, k),
    z AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2.0 - 0.5) / sqrt(na * nb / 12.0 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS z FROM u)
    SELECT round(u, 1) AS u, round(z, 4) AS z, na AS n_a, nb AS n_b, round(median_a, 2) AS median_a, round(median_b, 2) AS median_b, round(least(1.0, {tailsql.normal("greatest(z, 0.0)")}), 6) AS p FROM z""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney U of price between two statuses."""
    t = models.mann_whitney(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    digits = {"u": 1, "z": 4, "median_a": 2, "median_b": 2, "p": 6}
    return t.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "n_a", "n_b")


@query(f"""
    WITH d AS (SELECT l_linenumber - l_quantity / 7 AS d FROM lineitem WHERE l_linenumber - l_quantity / 7 <> 0),
    r AS (SELECT d, (2 * rank() OVER (ORDER BY abs(d)) + count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
    k AS (SELECT sum(power(k, 3) - k) AS ties FROM (SELECT count(*) AS k FROM d GROUP BY abs(d))),
    s AS (SELECT least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w, CAST(count(*) AS DOUBLE) AS n FROM r),
    z AS (SELECT w, n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, k)
    SELECT round(w, 1) AS w, round(z, 4) AS z, CAST(n AS BIGINT) AS n, round({tailsql.normal("z")}, 6) AS p FROM z""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's signed ranks of line number against a seventh of quantity."""
    t = read(spark, sf_dir, "lineitem").withColumn("b", F.col("l_quantity") / 7)
    return models.wilcoxon(t, "b", "l_linenumber").select(F.round("w", 1).alias("w"), F.round("z", 4).alias("z"), "n", F.round("p", 6).alias("p"))


@query("""
    WITH m AS (SELECT r_name AS g, n_name, round(avg(c_acctbal), 6) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name IN ('AMERICA', 'ASIA') GROUP BY r_name, n_name),
    r AS (SELECT g, x, row_number() OVER (ORDER BY x) AS r FROM m),
    s AS (SELECT count(*) FILTER (WHERE g = 'AMERICA') AS na, count(*) FILTER (WHERE g = 'ASIA') AS nb, sum(r) FILTER (WHERE g = 'AMERICA') AS ra,
        median(x) FILTER (WHERE g = 'AMERICA') AS median_a, median(x) FILTER (WHERE g = 'ASIA') AS median_b FROM r),
    u AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM s),
    masks AS (SELECT unnest(range(CAST(power(2, na + nb) AS BIGINT))) AS mask FROM u),
    orders_of AS (SELECT mask, sum(pos) - count(*) * (count(*) + 1) / 2 AS v FROM masks, (SELECT unnest(range(1, na + nb + 1)) AS pos FROM u)
        WHERE (mask >> (pos - 1)) & 1 = 1 GROUP BY mask HAVING count(*) = (SELECT na FROM u))
    SELECT CAST(u AS DOUBLE) AS u, na AS n_a, nb AS n_b, round(median_a, 4) AS median_a, round(median_b, 4) AS median_b,
        round(least(1.0, 2.0 * (SELECT count(*) FROM orders_of WHERE v <= least(u, na * nb - u)) / (SELECT count(*) FROM orders_of)), 9) AS p FROM u""")
def mann_whitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney U of the nations' mean balances in two regions: few enough for an exact p."""
    t = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    means = t.groupBy("r_name", "n_name").agg(F.round(F.avg("c_acctbal"), 6).alias("x"))
    out = models.mann_whitney(means, "x", "r_name", "AMERICA", "ASIA")
    return out.select("u", "n_a", "n_b", F.round("median_a", 4).alias("median_a"), F.round("median_b", 4).alias("median_b"), F.round("p", 9).alias("p"))


@query("""
    WITH y AS (SELECT year(o_orderdate) AS y, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 6) - round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 6) AS d
        FROM orders GROUP BY 1),
    r AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS r FROM y WHERE d <> 0),
    s AS (SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, count(*) AS n FROM r),
    masks AS (SELECT unnest(range(CAST(power(2, n) AS BIGINT))) AS mask FROM s),
    signs AS (SELECT mask, coalesce(sum(pos) FILTER (WHERE (mask >> (pos - 1)) & 1 = 1), 0) AS v FROM masks, (SELECT unnest(range(1, n + 1)) AS pos FROM s) GROUP BY mask)
    SELECT CAST(w AS DOUBLE) AS w, n, round(least(1.0, 2.0 * (SELECT count(*) FROM signs WHERE v <= w) / (SELECT count(*) FROM signs)), 9) AS p FROM s WHERE n >= 5""")
def wilcoxon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's signed ranks of yearly mean prices of two priorities: few enough for an exact p."""
    mean = lambda p: F.round(F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), 6)
    years = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(mean("1-URGENT").alias("urgent"), mean("5-LOW").alias("low"))
    return models.wilcoxon(years, "urgent", "low").select("w", "n", F.round("p", 9).alias("p"))


@query(f"""
    WITH s AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
    x AS (SELECT a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
        power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS df FROM s a, s b WHERE a.g = 'F' AND b.g = 'O')
    SELECT round(ma, 2) AS mean_a, round(mb, 2) AS mean_b, round(t, 4) AS t, round(df, 2) AS df, na AS n_a, nb AS n_b, round({tailsql.t("t", "df")}, 6) AS p FROM x""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t of price between two statuses."""
    t = models.t_test(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    digits = {"mean_a": 2, "mean_b": 2, "t": 4, "df": 2, "p": 6}
    return t.select(*[F.round(c, d).alias(c) for c, d in digits.items()], "n_a", "n_b")


@query(f"""
    WITH x AS (SELECT avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) AS n FROM (SELECT l_discount - l_tax AS d FROM lineitem)
        UNION ALL SELECT avg(d), avg(d) / (stddev_samp(d) / sqrt(count(*))), count(*) FROM (SELECT l_linenumber - l_quantity AS d FROM lineitem))
    SELECT round(m, 6) AS mean_diff, round(t, 4) AS t, n - 1 AS df, n, round({tailsql.t("t", "(n - 1)")}, 6) AS p FROM x""")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t of tax and discount, and of quantity and line number."""
    df = read(spark, sf_dir, "lineitem")
    t = models.paired_t(df, "l_tax", "l_discount").union(models.paired_t(df, "l_quantity", "l_linenumber"))
    return t.select(F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"), "df", "n", F.round("p", 6).alias("p"))


@query(f"""
    WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem),
    r AS (SELECT a, b, c, 2 * rank() OVER (ORDER BY a) + count(*) OVER (PARTITION BY a) AS ra, 2 * rank() OVER (ORDER BY b) + count(*) OVER (PARTITION BY b) AS rb, 2 * rank() OVER (ORDER BY c) + count(*) OVER (PARTITION BY c) AS rc FROM x),
    s AS (SELECT 'pearson' AS kind, 'price' AS of, corr(a, b) AS r, count(*) AS n FROM r UNION ALL SELECT 'spearman', 'price', corr(ra, rb), count(*) FROM r
        UNION ALL SELECT 'pearson', 'discount', corr(a, c), count(*) FROM r UNION ALL SELECT 'spearman', 'discount', corr(ra, rc), count(*) FROM r)
    SELECT kind, of, round(r, 6) AS r, n, round({tailsql.t("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")}, 6) AS p FROM s""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman correlation of quantity with price and with discount."""
    t = read(spark, sf_dir, "lineitem")
    parts = [
        models.correlation(t, "l_quantity", c, k).select(F.lit(k).alias("kind"), F.lit(of).alias("of"), F.round("r", 6).alias("r"), "n", F.round("p", 6).alias("p"))
        for of, c in (("price", "l_extendedprice"), ("discount", "l_discount")) for k in ("pearson", "spearman")
    ]
    return reduce(DataFrame.union, parts)


@query(f"""
    WITH c AS (SELECT l_linenumber AS x, floor(l_quantity / 10) AS y, CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(sign(a.y - b.y) * a.k * b.k) AS s FROM c a JOIN c b ON a.x > b.x), n AS (SELECT sum(k) AS n FROM c),
    tx AS (SELECT sum(k * (k - 1) / 2) AS t, sum(k * (k - 1) * (2 * k + 5)) AS v, sum(k * (k - 1) * (k - 2)) AS w FROM (SELECT x, sum(k) AS k FROM c GROUP BY 1)),
    ty AS (SELECT sum(k * (k - 1) / 2) AS t, sum(k * (k - 1) * (2 * k + 5)) AS v, sum(k * (k - 1) * (k - 2)) AS w FROM (SELECT y, sum(k) AS k FROM c GROUP BY 1)),
    z AS (SELECT s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)) AS r, n,
        s / sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + 2 * tx.t * ty.t / (n * (n - 1)) + tx.w * ty.w / (9 * n * (n - 1) * (n - 2))) AS z FROM s, n, tx, ty)
    SELECT round(r, 6) AS r, CAST(n AS BIGINT) AS n, round({tailsql.normal("z")}, 6) AS p FROM z""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of line number and tens of quantity."""
    t = read(spark, sf_dir, "lineitem").withColumn("y", F.floor(F.col("l_quantity") / 10))
    return models.correlation(t, "l_linenumber", "y", "kendall").select(F.round("r", 6).alias("r"), "n", F.round("p", 6).alias("p"))


@query(f"""
    WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS v FROM lineitem GROUP BY 1, 2),
    f AS (SELECT a.r, b.c, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT r FROM c) a CROSS JOIN (SELECT DISTINCT c FROM c) b LEFT JOIN c ON c.r = a.r AND c.c = b.c),
    e AS (SELECT *, sum(v) OVER (PARTITION BY r) * sum(v) OVER (PARTITION BY c) * 1.0 / sum(v) OVER () AS e FROM f),
    k AS (SELECT count(DISTINCT r) AS k, count(DISTINCT c) AS m, sum(v) AS n, sum((v - e) * (v - e) / e) AS plain, sum(power(abs(v - e) - least(0.5, abs(v - e)), 2) / e) AS yates FROM e),
    s AS (SELECT *, CASE WHEN (k - 1) * (m - 1) = 1 THEN yates ELSE plain END AS stat, CAST((k - 1) * (m - 1) AS BIGINT) AS df FROM k)
    SELECT round(stat, 4) AS stat, df, round({tailsql.chi2("stat", "greatest(df, 1)")}, 6) AS p, round(sqrt(stat / (n * (least(k, m) - 1))), 6) AS cramers_v, CAST(n AS BIGINT) AS n FROM s""")
def chi_square_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square and Cramer's v of return flag and line status."""
    t = models.chi_square_association(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return t.select(F.round("stat", 4).alias("stat"), "df", F.round("p", 6).alias("p"), F.round("cramers_v", 6).alias("cramers_v"), "n")


@query(f"""
    WITH m AS (SELECT regr_intercept(l_tax, l_discount) AS a, regr_slope(l_tax, l_discount) AS b, regr_r2(l_tax, l_discount) AS r2, regr_sxx(l_tax, l_discount) AS sxx, regr_syy(l_tax, l_discount) AS syy, avg(l_discount) AS mx, count(*) AS n FROM lineitem),
    v AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2, r2 / ((1 - r2) / (n - 2)) AS f FROM m),
    t AS (SELECT '(intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, r2, f, n FROM v UNION ALL SELECT 'l_discount', b, sqrt(s2 / sxx), r2, f, n FROM v)
    SELECT term, round(estimate, 8) AS estimate, round(se, 8) AS se, round(estimate / se, 4) AS t, round({tailsql.t("(estimate / se)", "(n - 2)")}, 6) AS p, round(r2, 8) AS r2,
        round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS adj_r2, round(f, 4) AS f, round({tailsql.f("f", "1", "(n - 2)")}, 6) AS f_p, n FROM t""")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax on discount, with all its statistics."""
    t = models.linear_regression(read(spark, sf_dir, "lineitem"), "l_tax", ["l_discount"])
    digits = {"estimate": 8, "se": 8, "t": 4, "p": 6, "r2": 8, "adj_r2": 8, "f": 4, "f_p": 6}
    return t.select("term", *[F.round(c, d).alias(c) for c, d in digits.items()], "n")


@query("""
    WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS aa, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_discount, l_discount) AS bb, covar_samp(l_quantity, l_extendedprice) AS ay,
        covar_samp(l_discount, l_extendedprice) AS by_, covar_samp(l_extendedprice, l_extendedprice) AS yy, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
    d AS (SELECT *, aa * bb - ab * ab AS det FROM c), b AS (SELECT *, (ay * bb - by_ * ab) / det AS ba, (by_ * aa - ay * ab) / det AS bd FROM d),
    r AS (SELECT *, (ba * ay + bd * by_) / yy AS r2, (yy - ba * ay - bd * by_) * (n - 1) / (n - 3) AS s2 FROM b),
    t AS (SELECT '(intercept)' AS term, my - ba * ma - bd * mb AS estimate, sqrt(s2 / n + s2 * (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (det * (n - 1))) AS se, r2, n FROM r
        UNION ALL SELECT 'l_quantity', ba, sqrt(s2 * bb / (det * (n - 1))), r2, n FROM r UNION ALL SELECT 'l_discount', bd, sqrt(s2 * aa / (det * (n - 1))), r2, n FROM r)
    SELECT term, round(estimate, 2) AS estimate, round(se, 3) AS se, round(estimate / se, 2) AS t, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2, n FROM t""")
def linear_regression_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity and discount."""
    t = models.linear_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    digits = {"estimate": 2, "se": 3, "t": 2, "r2": 6, "adj_r2": 6}
    return t.select("term", *[F.round(c, d).alias(c) for c, d in digits.items()], "n")


@query("""
    WITH c AS (SELECT corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b FROM lineitem),
    p AS (SELECT *, (sqrt(1 + r) + sqrt(1 - r)) / 2 AS u, (sqrt(1 + r) - sqrt(1 - r)) / 2 AS v FROM c),
    s AS (SELECT *, (u * a - v * b) / (u * u - v * v) AS s1, (u * b - v * a) / (u * u - v * v) AS s2 FROM p),
    w AS (SELECT 'l_quantity' AS feature, u * u * s1 * s1 + v * v * s2 * s2 AS raw FROM s UNION ALL SELECT 'l_discount', v * v * s1 * s1 + u * u * s2 * s2 FROM s)
    SELECT CAST(row_number() OVER (ORDER BY raw DESC) AS INTEGER) AS rank, feature, round(raw, 6) AS raw, round(100 * raw / sum(raw) OVER (), 4) AS pct, round(sum(raw) OVER (), 6) AS r2, false AS regularised FROM w""")
def relative_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Johnson's relative weights of two predictors of price."""
    t = models.relative_weights(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return t.select("rank", "feature", F.round("raw", 6).alias("raw"), F.round("pct", 4).alias("pct"), F.round("r2", 6).alias("r2"), "regularised")


@query(f"""
    WITH l AS (SELECT unnest([struct_pack(a := 'l_linenumber', x := CAST(l_linenumber AS DOUBLE)), struct_pack(a := 'l_quantity', x := CAST(l_quantity AS DOUBLE)), struct_pack(a := 'l_discount', x := CAST(l_discount AS DOUBLE)), struct_pack(a := 'l_tax', x := CAST(l_tax AS DOUBLE))]) AS s, l_extendedprice AS y FROM lineitem),
    t AS (SELECT s.a AS attribute, s.x AS x, y FROM l),
    k AS (SELECT attribute, avg(x) AS perf, count(DISTINCT x) AS k, list_distinct(quantile_cont(x, [0.25, 0.5, 0.75])) AS q FROM t GROUP BY 1),
    b AS (SELECT t.attribute, CASE WHEN k.k <= 10 THEN x ELSE len(list_filter(q, lambda e: e < x)) END AS bin, (2 * rank() OVER (PARTITION BY t.attribute ORDER BY y) + count(*) OVER (PARTITION BY t.attribute, y) - 1) / 2.0 AS r FROM t JOIN k USING (attribute)),
    g AS (SELECT attribute, bin, CAST(count(*) AS DOUBLE) AS c, sum(r) AS s, sum(r * r) AS ss FROM b GROUP BY 1, 2),
    h AS (SELECT attribute, count(*) - 1 AS df, greatest(0.001, (sum(s * s / c) - sum(s) * sum(s) / sum(c)) * (sum(c) - 1) / (sum(ss) - sum(s) * sum(s) / sum(c))) AS h FROM g GROUP BY 1),
    i AS (SELECT h.*, round(perf, 2) AS performance, round(avg(perf) OVER (), 2) AS performance_cut, round(h / sum(h) OVER () * 100, 2) AS importance, 25.0 AS importance_cut FROM h JOIN k USING (attribute))
    SELECT CAST(row_number() OVER (ORDER BY importance DESC, attribute) AS INTEGER) AS rank, attribute, performance, round(h, 4) AS h, df, round({tailsql.chi2("h", "df")}, 4) AS p, importance,
        CASE WHEN importance >= importance_cut THEN CASE WHEN performance >= performance_cut THEN 'Q2' ELSE 'Q1' END ELSE CASE WHEN performance >= performance_cut THEN 'Q4' ELSE 'Q3' END END AS quadrant, performance_cut, importance_cut FROM i""")
def quadrant_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and performance of line attributes for price."""
    return rounded(models.quadrants(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linenumber", "l_quantity", "l_discount", "l_tax"]))


@query(_DAYS + """
    o(v) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')), c AS (SELECT a.v AS a, b.v AS b FROM o a JOIN o b ON a.v < b.v),
    s AS (SELECT a || ' + ' || b AS items, avg(CASE WHEN list_contains(chosen, a) OR list_contains(chosen, b) THEN 1.0 ELSE 0.0 END) AS reach,
        sum(list_contains(chosen, a)::INT + list_contains(chosen, b)::INT) * 1.0 / sum((list_contains(chosen, a) OR list_contains(chosen, b))::INT) AS f FROM d, c GROUP BY a, b)
    SELECT CAST(row_number() OVER (ORDER BY round(reach, 12) DESC, round(f, 12) DESC, items) AS INTEGER) AS rank, items, round(reach, 6) AS reach, round(f, 6) AS frequency FROM s""")
def turf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach of pairs of event types over user days."""
    t = models.turf(user_days(spark, sf_dir), [F.array_contains("chosen", e) for e in TYPES], TYPES, 2, 10)
    return t.select("rank", "items", F.round("reach", 6).alias("reach"), F.round("frequency", 6).alias("frequency"))


@query("""
    WITH p AS (SELECT l_orderkey AS k, CAST(l_discount * 5 AS DOUBLE) AS p FROM (SELECT l_orderkey, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1)),
    f AS (SELECT k, p, k % 7 AS fam FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, k) AS r, count(*) OVER (PARTITION BY fam) AS m FROM f)
    SELECT k, round(least(1.0, min(p * m / r) OVER (PARTITION BY fam ORDER BY r DESC)), 6) AS bh, round(least(1.0, max(p * (m - r + 1)) OVER (PARTITION BY fam ORDER BY r)), 6) AS holm FROM r""")
def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg and Holm adjustment of ratios, in families."""
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.avg("l_discount") * 5).alias("p")).withColumn("fam", F.col("k") % 7)
    t = multiplicity.adjusted(t, "p", ["fam"], "bh", ["k"], "bh")
    t = multiplicity.adjusted(t, "p", ["fam"], "holm", ["k"], "holm")
    return t.select("k", F.round("bh", 6).alias("bh"), F.round("holm", 6).alias("holm"))


@query("SELECT 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS minimum, max(l_quantity) AS maximum FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount) FROM lineitem")
def descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, mean, standard deviation and range."""
    return rounded(models.descriptives(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), 6)


# --- open ends ---------------------------------------------------------------


@query("""
    WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS t FROM conversations),
    a AS (SELECT list_distinct(list_filter(t, lambda x: x IN ('the', 'and', 'of', 'in', 'to'))) AS h, list_distinct(list_filter(t, lambda x: x IN ('the', 'and', 'of', 'on', 'at'))) AS m FROM t),
    e AS (SELECT *, len(list_intersect(h, m)) AS i, len(list_distinct(list_concat(h, m))) AS u FROM a),
    o AS (SELECT count(*) AS n, avg(CASE WHEN i = u THEN 1.0 ELSE 0.0 END) AS exact, avg(CASE WHEN u = 0 THEN 1.0 ELSE i * 1.0 / u END) AS jaccard FROM e),
    c AS (SELECT unnest(list_distinct(list_concat(h, m))) AS code, h, m FROM a), p AS (SELECT code, CAST(sum(list_contains(h, code)::INT) AS DOUBLE) AS a, CAST(sum(list_contains(m, code)::INT) AS DOUBLE) AS b, CAST(sum((list_contains(h, code) AND list_contains(m, code))::INT) AS DOUBLE) AS ab FROM c GROUP BY 1),
    q AS (SELECT (n - a - b + 2 * ab) / n AS po, (a * b + (n - a) * (n - b)) / (CAST(n AS DOUBLE) * n) AS pe FROM p, o)
    SELECT n, round(exact, 6) AS exact, round(jaccard, 6) AS jaccard, round((SELECT avg(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END) FROM q), 6) AS kappa FROM o""")
def coder_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two coders that give sets of codes: words found in each turn."""
    t = read(spark, sf_dir, "conversations")
    codes = lambda words: F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda x: x.isin(words.split()))
    return rounded(models.agreement(t, codes("the and of in to"), codes("the and of on at")), 6)


@query("""
    WITH t AS (SELECT l_orderkey AS r, p_type AS net, p_brand AS subnet, p_size AS leaf FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT count(DISTINCT r) AS b FROM t)
    SELECT 1 AS level, net, NULL AS subnet, CAST(NULL AS INTEGER) AS leaf, count(DISTINCT r) AS n, round(count(DISTINCT r) * 100.0 / max(b), 4) AS pct FROM t, b GROUP BY net
    UNION ALL SELECT 2, net, subnet, NULL, count(DISTINCT r), round(count(DISTINCT r) * 100.0 / max(b), 4) FROM t, b GROUP BY net, subnet
    UNION ALL SELECT 3, net, subnet, leaf, count(DISTINCT r), round(count(DISTINCT r) * 100.0 / max(b), 4) FROM t, b GROUP BY net, subnet, leaf""")
def hierarchy_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by part type, brand and size, every level without double counting."""
    t = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return openends.hierarchy(t, "l_orderkey", "p_type", "p_brand", "p_size").select("level", "net", "subnet", "leaf", "n", F.round("pct", 4).alias("pct"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\[[a-z_]+\]|[a-zñ0-9]+(?:[-''][a-zñ0-9]+)*') AS t FROM conversations)
    SELECT conv_id, turn, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM t""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per turn, by the library's tokeniser."""
    found = textprep.tokens(F.lower("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("tokens"))


@query("""
    WITH f AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n FROM documents) SELECT doc_id, n FROM f WHERE n > 0""".replace("\\\\", "\\"))
def masked_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that the survey scrubber masks, by document."""
    t = read(spark, sf_dir, "documents").withColumn("n", F.regexp_count(textprep.masked_numbers(F.col("text")), F.lit(r"\[EMAIL\]")).cast("long"))
    return t.filter("n > 0").select("doc_id", "n")


CODEFRAME = {
    "schema_version": 1, "id": "shop", "name": "Shop", "domain": "consumer",
    "topics": [
        {"id": "price", "net": "Offer", "subnet": "Price", "codes": {"pos": {"code_id": 101, "label": "Good price"}, "neg": {"code_id": 102, "label": "Poor price"}}, "keywords": ["price", "cost", "presyo"], "pos_keywords": ["cheap", "mura"], "neg_keywords": ["expensive", "mahal"]},
        {"id": "service", "net": "Service", "subnet": "Staff", "codes": {"pos": {"code_id": 111, "label": "Good service"}, "neg": {"code_id": 112, "label": "Poor service"}}, "keywords": ["staff", "service", "cashier"], "pos_keywords": ["friendly", "helpful"], "neg_keywords": ["rude", "slow"]},
    ],
}


@query()
def coded_open_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment and themes of all conversation turns."""
    t = read(spark, sf_dir, "conversations").withColumn("response_id", F.concat_ws("-", "conv_id", "turn"))
    return openends.coded(t, "text", CODEFRAME).select("conv_id", "turn", "coded.sentiment", "coded.score", "coded.needs_review", F.transform("coded.themes", lambda x: x["code_id"]).alias("codes"))


@query("""
    WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('split' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= round(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM h""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A salted, stratified split of the documents."""
    return openends.stratified_split(read(spark, sf_dir, "documents"), ["lang"], "doc_id").select("doc_id", "part")


@query("""
    WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1), s AS (SELECT source, count(*) AS n, sum(q) AS k FROM l JOIN documents USING (doc_id) GROUP BY 1),
    p AS (SELECT source, n, k * 1.0 / n AS p, 1 + 1.96 * 1.96 / n AS d FROM s)
    SELECT source, n, round((p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d, 6) AS low, round((p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d, 6) AS high FROM p""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals of the share of good documents by source."""
    t = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    t = t.join(read(spark, sf_dir, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("q").alias("k"))
    low, high = reporting.wilson(F.col("k"), F.col("n"))
    return t.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
    WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1), n AS (SELECT count(*) AS n, avg((q = t)::INT) AS po, avg(q) * avg(t) + (1 - avg(q)) * (1 - avg(t)) AS pe FROM l)
    SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM n""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two label sets."""
    t = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return reporting.cohen_kappa(t, "q", "t").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


RULES = [
    rules.CodeRule(1, "There", ("the", "der", "le", "el")), rules.CodeRule(2, "And", ("and", "und", "et", "y"), lump_into=1),
]


_PLAIN = r"[^\x00-\x7F]"
_NEGATED = r"\b(no|not|never|di|wala|walang|hindi|dili)\b"


@query(f"""
    WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '{_PLAIN}', 'x', 'g'), '{_NEGATED}', 'xx', 'g') AS t FROM conversations)
    SELECT conv_id, turn, regexp_matches(t, '\\b(the|der|le|el)\\b') AS has_first, regexp_matches(t, '\\b(and|und|et|y)\\b') AS has_second FROM t""")
def rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule codes of all turns; letters beyond ASCII and negators are masked, which SQL engines see differently."""
    t = read(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace(F.regexp_replace(F.lower("text"), _PLAIN, "x"), _NEGATED, "xx"))
    ids = F.transform("codes", lambda x: x["code_id"])
    return rules.rule_coded(t, "text", RULES).select("conv_id", "turn", F.array_contains(ids, 1).alias("has_first"), F.array_contains(ids, 2).alias("has_second"))


#: The rules with an opposite code; "and" is lumped into "There".
OPPOSED = [rules.CodeRule(1, "There", ("the", "der", "le", "el"), opposite=3), RULES[1], rules.CodeRule(3, "Absent", ("absent", "missing"), opposite=1)]


@query()
def rule_codes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule codes of all turns as they stand, with negation, opposite codes and lumping."""
    t = rules.rule_coded(read(spark, sf_dir, "conversations"), "text", OPPOSED, lump=True)
    return t.select("conv_id", "turn", F.transform("codes", lambda x: x["code_id"]).alias("codes"))
