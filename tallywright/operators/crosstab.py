"""Weighted cross-tabulation with two kinds of significance tests.

All cells of a table come from one aggregate over the respondents: each is exploded into the columns
(banners) it belongs to, 0 standing for the total, and a column's bases, moments and the weight of every
row are summed together. What follows works on the few cells.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import multiplicity, names, tails

#: Answer codes that mean a missing answer on a scale.
MISSING = (97, 98, 99)
MAX_ROWS = 12
MIN_BASE = 20
SMALL_BASE = 30
MAX_BANNERS = 200
SCALE_TOPS = (4, 5, 6, 7, 10)


@dataclass(frozen=True)
class Row:
    """A line of a table: label, predicate on the stub column, whether it is a net or a missing code."""

    label: str
    matches: Column
    is_net: bool = False
    is_missing: bool = False


@dataclass(frozen=True)
class Net:
    """A custom net: the stub it belongs to, its label and the parts that its answers contain."""

    stub: str
    label: str
    categories: tuple[str, ...]


def resolve_column(df: DataFrame, name: str) -> str | None:
    """A column by exact name, then by letters and digits only, then without a leading question number."""
    if name in df.columns:
        return name
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    short = lambda s: re.sub(r"^\s*(?:[qQ]?\d+)\s*[.:]\s*", "", s).strip().lower()
    for same in (plain, short):
        hits = [c for c in df.columns if same(c) == same(name)]
        if hits:
            return hits[0]
    return None


def clean_label(label: str) -> str:
    """Without a trailing letter in brackets."""
    return re.sub(r"\s*[(\[][A-Z0-9]+[)\]]\s*$", "", label).strip()


def text_of(c: Column, kind: str) -> Column:
    """Category text: whole floats like integers, else trimmed text."""
    if kind in ("double", "float"):
        return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return F.trim(c.cast("string"))


def natural(text: Column) -> list[Column]:
    """Sort keys of category text: numbers by value and first, then other text by its letters."""
    number = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    return [number.asc_nulls_last(), F.lower(text).asc(), text.asc()]


#: Columns that make the banner where none is named, the first that is there.
DEFAULT_BANNERS = ("Region", "Age_Generation", "Gender", "Socioeconomic_Class")


def first_with_few(df: DataFrame, columns: list[str], most: int) -> str | None:
    """The first of ``columns`` that has 2 to ``most`` different values."""
    if not columns:
        return None
    counts = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in columns]).first().asDict()
    near = [c for c in columns if counts[c] <= most + most // 2]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    return next((c for c in near if 2 <= exact[c] <= most), None)


def banner_groups(df: DataFrame, most: int = 5) -> list[tuple[str, Column]]:
    """Columns for a table of net counts: the first values, ``most`` of them, of the first column with two to six."""
    column = first_with_few(df, [c for c in df.columns if not c.startswith("__")], 6)
    return [(f"{v} ({letter(i)})", m) for i, (v, m) in enumerate(banners(df, [column])[:most], 1)] if column else []


def banners(df: DataFrame, names: list[str], besides: str | None = None) -> list[tuple[str, Column]]:
    """Label and membership of each banner column.

    One name of a column gives a banner per distinct value, numbers by value and other text by its letters. Otherwise each name is
    an exact value of the first column that has it, or a column (present and not 0), or a word in the
    first column whose values contain it; what is found nowhere is an empty banner. Without names the
    first of DEFAULT_BANNERS is used, or else the first column with two to eight values, but never ``besides``;
    where there is none, there are no banner columns.
    """
    names = [n for n in names if n.strip().lower() != "total"]
    if not names:
        others = [c for c in df.columns if c != besides]
        chosen = next((c for c in DEFAULT_BANNERS if c in others), None) or first_with_few(df, others, 8)
        if chosen is None:
            return []
        names = [chosen]
    kinds = dict(df.dtypes)
    column = resolve_column(df, names[0]) if len(names) == 1 else None
    if column:
        text = text_of(F.col(column), kinds[column])
        values = [r.v for r in df.select(text.alias("v")).filter("v is not null").distinct().orderBy(*natural(F.col("v"))).limit(MAX_BANNERS + 1).collect()]
        if len(values) > MAX_BANNERS:
            raise ValueError(f"{column} has more than {MAX_BANNERS} values; choose a banner with fewer")
        return [(v, text == v) for v in values]
    out = []
    texts = {c: text_of(F.col(c), kinds[c]) for c in df.columns}
    for name in names:
        tries = [name, clean_label(name)]
        found = df.agg(*[F.max(F.when(texts[c].isin(tries), 1)).alias(c) for c in df.columns]).first().asDict()
        hit = next((c for c in df.columns if found[c]), None)
        own = resolve_column(df, name)
        if hit:
            out.append((name, texts[hit].isin(tries)))
        elif own:
            out.append((name, F.col(own).isNotNull() & (texts[own] != "0")))
        else:
            word = rf"(?i)\b{re.escape(clean_label(name))}\b"
            held = df.agg(*[F.max(F.when(texts[c].rlike(word), 1)).alias(c) for c in df.columns]).first().asDict()
            hit = next((c for c in df.columns if held[c]), None)
            out.append((name, texts[hit].rlike(word) if hit else F.lit(False)))
    return out


def letter(i: int) -> str:
    """A to Z, then AA and on, for column i from 1."""
    out = ""
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass(frozen=True)
class Stub:
    """What a stub is: scale bounds if a rating scale, multi-select or plain."""

    column: str
    numeric: bool
    low: int | None = None
    high: int | None = None
    multi: bool = False

    @property
    def scale(self) -> bool:
        return self.high is not None


def scale_of_values(column: str, low: float, high: float, kinds: int, whole: bool) -> tuple[int, int] | None:
    """The scale that numbers from ``low`` to ``high`` belong to, also where nobody chose its lowest points.

    A column named like a rating, or whole numbers of 1 to 5 in one that isn't named like a count, starts at
    1 (0 for nps or if 0 occurs), and at 5 ends what has no answer above 4.
    """
    if not whole:
        return None
    rating, likert = names.is_rating(column), 1 <= low and high <= 5 and kinds >= 2
    known = low in (0, 1)
    guessed = not known and 0 <= low <= 3 and (rating or (likert and not names.is_count(column)))
    if not (known or guessed) or high not in SCALE_TOPS:
        return None
    start = int(low) if known else int("nps" not in names.words(column))
    return start, 5 if high == 4 and (rating or likert) else int(high)


def read_stub(df: DataFrame, column: str) -> Stub:
    """By name ``_XtoY`` or by values: at most 11 numbers from 0 or 1 to a usual top; else text with commas."""
    kind = dict(df.dtypes)[column]
    named = re.search(r"_(\d+)to(\d+)$", column)
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if named:
        return Stub(column, True, int(named[1]), int(named[2]))
    c = F.col(column)
    if numeric:
        valid = F.when(~c.isin(*MISSING), c)
        r = df.agg(F.min(valid).alias("lo"), F.max(valid).alias("hi"), F.approx_count_distinct(valid).alias("n"), F.bool_and(valid == F.floor(valid)).alias("whole")).first()
        scale = scale_of_values(column, r.lo, r.hi, r.n, bool(r.whole)) if r.lo is not None and r.n <= 14 else None
        return Stub(column, True, *(scale or ()))
    share = df.agg(F.avg(c.cast("string").contains(", ").cast("double")).alias("s")).first().s or 0.0
    return Stub(column, False, multi=share > 0.10)


def rows_of(df: DataFrame, stub: Stub, nets: list[Net] = (), max_rows: int = MAX_ROWS) -> list[Row]:
    """The lines of a stub: top-two-box and points of a scale, options of a multi-select, or categories.

    Beyond ``max_rows`` categories the rest is one line. Order is by count, then label.
    """
    c = F.col(stub.column)
    text = text_of(c, dict(df.dtypes)[stub.column])
    if stub.scale:
        x = c.cast("double")
        rows = [Row(f"NET: Top-2-Box ({stub.high - 1}-{stub.high})", x.isin(stub.high - 1, stub.high), True)]
        rows += [Row(str(k), x == k) for k in range(stub.high, stub.low - 1, -1)]
        there = [r.v for r in df.filter(x.isin(*MISSING)).select(x.alias("v")).distinct().collect()]
        rows += [Row(f"{int(k)} (missing)", x == k, is_missing=True) for k in sorted(there)]
    elif stub.multi:
        from tallywright.operators import multiselect

        rows = [Row(o, F.array_contains(multiselect.split_answers(c), o)) for o, _ in multiselect.census(df, stub.column)]
    else:
        top = df.filter(text.isNotNull()).groupBy(text.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_rows + 1).collect()
        rows = [Row(r.v, text == r.v) for r in top[:max_rows]]
        if len(top) > max_rows:
            kept = [r.v for r in top[:max_rows]]
            others = df.agg(F.count_distinct(text)).first()[0] - max_rows
            rows.append(Row(f"Other ({others} categories)", ~text.isin(*kept)))
    for net in nets:
        if net.stub == stub.column or net.stub in stub.column:
            hit = F.lit(False)
            for part in net.categories:
                hit = hit | text.contains(part)
            rows.insert(0, Row(net.label, hit, True))
    return rows


def cells(df: DataFrame, stub: Stub, rows: list[Row], columns: list[tuple[str, Column]], weight: Column) -> DataFrame:
    """One row per column: bases, moments of the valid answers, and the weight of each row's matches.

    n, w, w2 count every answer; v_n, v_w, v_w2, v_x, v_xx leave the missing codes of a scale out.
    """
    c = F.col(stub.column)
    x = c.cast("double") if stub.numeric else F.lit(None).cast("double")
    valid = ~c.isin(*MISSING) if stub.scale or stub.numeric else F.lit(True)
    place = F.array_compact(F.array(F.lit(0), *[F.when(m, F.lit(i)) for i, (_, m) in enumerate(columns, 1)]))
    flags = [F.coalesce(r.matches, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rows)]
    base = df.filter(c.isNotNull()).select(weight.cast("double").alias("w"), x.alias("x"), valid.alias("valid"), place.alias("place"), *flags)
    shift = base.agg(F.avg("x")).first()[0] or 0.0 if stub.numeric else 0.0  # moments about a near centre lose no digits
    long = base.withColumn("col_ord", F.explode("place"))
    v = F.when(F.col("valid"), F.col("w"))
    d = F.col("x") - shift
    sums = [F.coalesce(F.sum(F.when(F.col(f"r{i}"), F.col("w"))), F.lit(0.0)).alias(f"m{i}") for i in range(len(rows))]
    return long.groupBy("col_ord").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"),
        F.count(v).alias("v_n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("v_w"), F.sum(v * v).alias("v_w2"), F.sum(v * d).alias("v_d"), F.sum(v * d * d).alias("v_dd"), *sums,
    ).withColumn("shift", F.lit(float(shift)))


def _neff(w: str, w2: str) -> Column:
    return F.when(F.col(w2) > 0, F.col(w) * F.col(w) / F.col(w2)).otherwise(0.0)


def proportion_z(p1: Column, p2: Column, n1: Column, n2: Column) -> Column:
    """The pooled two-proportion statistic; 0 where it is undefined."""
    pool = (p1 * n1 + p2 * n2) / F.when(n1 + n2 > 0, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / F.when(n1 > 0, n1) + 1 / F.when(n2 > 0, n2)))
    return F.when((n1 > 1) & (n2 > 1) & (se > 0), (p1 - p2) / F.when(se > 0, se)).otherwise(F.lit(0.0))


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t and its Satterthwaite degrees of freedom; 0 and 1 where undefined."""
    a, b = s1 * s1 / F.when(n1 > 0, n1), s2 * s2 / F.when(n2 > 0, n2)
    ok = (n1 > 1) & (n2 > 1) & (a + b > 0)
    df = F.pow(a + b, F.lit(2.0)) / (a * a / F.when(n1 > 1, n1 - 1) + b * b / F.when(n2 > 1, n2 - 1))
    return F.when(ok, (m1 - m2) / F.sqrt(F.when(a + b > 0, a + b))).otherwise(0.0), F.when(ok, df).otherwise(1.0)


def _signed(stat: Column, p: Column) -> Column:
    return (
        F.when((stat > 0) & (p < 0.05), "++").when((stat > 0) & (p < 0.10), "+")
        .when((stat < 0) & (p < 0.05), "--").when((stat < 0) & (p < 0.10), "-").otherwise("")
    )


def crosstab(
    df: DataFrame, stub: str, banner: list[str], weight: str | None = None, metric: str = "pct", confidence: int = 95,
    fdr: str | None = None, nets: list[Net] = (), exact_neff: bool = False, stat_columns: bool = False,
) -> DataFrame:
    """A table in long form: one row per line and column.

    Columns: row_ord, label, is_net, col_ord (0: total), col_label, letter, base_n, base_w, neff,
    small_base, value (share, or mean for metric "mean"), sd, letters, benchmark. ``metric`` is pct, mean
    (one mean line) or t2b (nets only). Letters name the columns that a column exceeds: capital below the
    upper level, small below the lower; confidence 99 tests at .01/.05, 90 and 95 at .05/.10. ``fdr`` (bh,
    by) adjusts a line's pairs together. The benchmark compares a column with the rest of the sample.
    Effective bases are rounded to one place before testing unless ``exact_neff``. Null weights count 0.
    """
    name = resolve_column(df, stub)
    if name is None:
        raise ValueError(f"no column {stub}")
    kind = read_stub(df, name)
    cols = banners(df, banner, name)
    mean = metric == "mean" and kind.numeric
    rows = [Row("Mean", F.lit(True))] if mean else rows_of(df, kind, nets)
    if metric == "t2b":
        rows = [r for r in rows if r.is_net]
    wide = cells(df, kind, rows, cols, F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1.0))
    return _tested(wide, rows, cols, mean, confidence, fdr, exact_neff, stat_columns)


def _tested(wide: DataFrame, rows: list[Row], cols: list[tuple[str, Column]], mean: bool, confidence: int, fdr: str | None, exact_neff: bool, stat_columns: bool) -> DataFrame:
    digits = (lambda c: c) if exact_neff else (lambda c: F.round(c, 1))
    labels = F.array(F.lit("Total"), *[F.lit(v) for v, _ in cols])
    letters = F.array(F.lit(""), *[F.lit(letter(i)) for i in range(1, len(cols) + 1)])
    whole = Window.partitionBy().orderBy("col_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per column
    t = wide.withColumn("neff", digits(_neff("w", "w2"))).withColumn("all", F.first(F.struct("n", "neff", "v_n", "v_w", "v_w2", "v_d", "v_dd", "shift")).over(whole))
    lines = F.array(*[F.struct(F.lit(i).alias("row_ord"), F.lit(r.label).alias("label"), F.lit(r.is_net).alias("is_net"), F.lit(r.is_missing).alias("is_missing"), F.col(f"m{i}").alias("matched")) for i, r in enumerate(rows)])
    t = t.withColumn("line", F.explode(lines)).select("*", "line.*").drop("line")
    if mean:
        centre = F.col("v_d") / F.when(F.col("v_w") > 0, F.col("v_w"))
        spread = lambda n, w, d, dd: F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), dd / w - F.pow(d / w, F.lit(2.0))) * n / (n - 1))).otherwise(0.0)
        t = t.withColumn("value", F.coalesce(centre + F.col("shift"), F.lit(0.0)))
        t = t.withColumn("sd", F.coalesce(spread(F.col("v_n"), F.when(F.col("v_w") > 0, F.col("v_w")), F.col("v_d"), F.col("v_dd")), F.lit(0.0)))
        rest = {k: F.col(f"all.{k}") - F.col(k) for k in ("v_n", "v_w", "v_w2", "v_d", "v_dd")}
        rw = F.when(rest["v_w"] > 0, rest["v_w"])
        stat, free = welch(F.col("value"), F.col("sd"), _neff("v_w", "v_w2"), rest["v_d"] / rw + F.col("shift"), spread(rest["v_n"], rw, rest["v_d"], rest["v_dd"]), rest["v_w"] * rest["v_w"] / F.when(rest["v_w2"] > 0, rest["v_w2"]))
        small = (F.col("v_n") <= 1) | (rest["v_n"] <= 1) | (_neff("v_w", "v_w2") < MIN_BASE) | (rest["v_w"] * rest["v_w"] / F.when(rest["v_w2"] > 0, rest["v_w2"]) < MIN_BASE)
        t = t.withColumn("bm_stat", F.coalesce(stat, F.lit(0.0))).withColumn("bm_df", F.coalesce(free, F.lit(1.0))).withColumn("bm_small", F.coalesce(small, F.lit(True)))
        t = t.withColumn("bm_p", tails.t_p("bm_stat", "bm_df"))
    else:
        below = F.when(F.col("is_missing"), F.col("w")).otherwise(F.col("v_w")) if any(r.is_missing for r in rows) else F.col("v_w")
        t = t.withColumn("value", F.coalesce(F.col("matched") / F.when(below > 0, below), F.lit(0.0))).withColumn("sd", F.lit(None).cast("double"))
        total = F.max(F.when(F.col("col_ord") == 0, F.col("value"))).over(Window.partitionBy("row_ord"))
        t = t.withColumn("p_all", total)
        n_rest = F.col("all.n") - F.col("n")
        clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
        p_rest = clip(F.greatest(F.lit(0.0), clip(F.col("p_all")) * F.col("all.n") - clip(F.col("value")) * F.col("n")) / F.when(n_rest > 0, n_rest))
        neff_rest = F.greatest(F.lit(1.0), n_rest * F.col("all.neff") / F.greatest(F.lit(1), F.col("all.n")))
        t = t.withColumn("bm_stat", F.coalesce(proportion_z(clip(F.col("value")), p_rest, F.col("neff"), neff_rest), F.lit(0.0)))
        t = t.withColumn("bm_small", (F.col("n") <= 1) | (n_rest <= 1) | (F.col("neff") < MIN_BASE) | (neff_rest < MIN_BASE)).withColumn("bm_p", tails.normal_p("bm_stat"))
    t = t.withColumn("benchmark", F.when(F.col("col_ord") == 0, "-").when(F.col("bm_small"), "").otherwise(_signed(F.col("bm_stat"), F.col("bm_p"))))
    t = t.withColumn("letter", F.element_at(letters, F.col("col_ord") + 1)).withColumn("col_label", F.element_at(labels, F.col("col_ord") + 1))
    won = _letters(t, mean, confidence, fdr)
    out = t.join(won, (F.col("row_ord") == F.col("w_row")) & (F.col("col_ord") == F.col("w_col")), "left")
    out = out.withColumn("letters", F.when(F.col("col_ord") == 0, "-").otherwise(F.coalesce("won", F.lit(""))))
    extra = ["bm_stat", "bm_p"] if stat_columns else []
    return out.select(
        "row_ord", "label", "is_net", "col_ord", "col_label", "letter", F.col("n").alias("base_n"), F.round("w", 1).alias("base_w"), "neff",
        (F.col("neff") < SMALL_BASE).alias("small_base"), "value", "sd", "letters", "benchmark", *extra,
    )


def _letters(t: DataFrame, mean: bool, confidence: int, fdr: str | None) -> DataFrame:
    """(w_row, w_col, won): for each line and column the letters of the columns it exceeds, in pair order."""
    high, low = (0.01, 0.05) if confidence == 99 else (0.05, 0.10)
    side = t.filter("col_ord > 0").select("row_ord", "col_ord", "letter", "neff", "value", "sd")
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, F.expr("a.row_ord = b.row_ord and a.col_ord < b.col_ord"))
    ca, cb = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    if mean:
        stat, free = welch(ca("value"), ca("sd"), ca("neff"), cb("value"), cb("sd"), cb("neff"))
    else:
        stat, free = proportion_z(ca("value"), cb("value"), ca("neff"), cb("neff")), F.lit(1.0)
    pairs = pairs.select(
        ca("row_ord").alias("w_row"), ca("col_ord").alias("i"), cb("col_ord").alias("j"), ca("letter").alias("l_i"), cb("letter").alias("l_j"),
        stat.alias("stat"), free.alias("df"), ((ca("neff") < MIN_BASE) | (cb("neff") < MIN_BASE)).alias("small"),
    )
    pairs = pairs.withColumn("p", tails.t_p("stat", "df") if mean else tails.normal_p("stat"))
    pairs = multiplicity.adjusted(pairs, "p", ["w_row"], fdr, ["i", "j"], "pa") if fdr else pairs.withColumn("pa", F.col("p"))
    up = F.col("stat") > 0
    beaten = F.when(up, F.col("l_j")).otherwise(F.col("l_i"))
    mark = F.when(F.col("pa") < high, F.upper(beaten)).when(F.col("pa") < low, F.lower(beaten))
    won = pairs.filter(~F.col("small")).withColumn("mark", mark).filter("mark is not null").withColumn("w_col", F.when(up, F.col("i")).otherwise(F.col("j")))
    return won.groupBy("w_row", "w_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "mark"))), lambda s: s["mark"]), " ").alias("won"))


def chi_square_cells(observed: DataFrame) -> DataFrame:
    """stat, df from (row, col, value): Pearson's statistic on the rows and columns that aren't all zero."""
    r, c, everything = Window.partitionBy("row"), Window.partitionBy("col"), Window.partitionBy()
    t = observed.withColumn("rs", F.sum("value").over(r)).withColumn("cs", F.sum("value").over(c)).withColumn("t", F.sum("value").over(everything))
    t = t.filter("rs > 0 and cs > 0").withColumn("e", F.col("rs") * F.col("cs") / F.col("t"))
    out = t.agg(F.sum(F.pow(F.col("value") - F.col("e"), F.lit(2.0)) / F.col("e")).alias("stat"), F.count_distinct("row").alias("k"), F.count_distinct("col").alias("m"))
    return out.select(F.coalesce("stat", F.lit(0.0)).alias("stat"), F.greatest(F.lit(1), (F.col("k") - 1) * (F.col("m") - 1)).alias("df"))


def crosstab_chi_square(df: DataFrame, stub: str, banner: str, weight: str | None = None) -> DataFrame:
    """stat, df, p of a table of exclusive columns; weighted counts are scaled to the effective base."""
    kinds = dict(df.dtypes)
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double") if weight else F.lit(1.0)
    t = df.select(text_of(F.col(stub), kinds[stub]).alias("row"), text_of(F.col(banner), kinds[banner]).alias("col"), w.alias("w")).filter("row is not null and col is not null")
    t = t.groupBy("row", "col").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    full = t.select("row").distinct().crossJoin(t.select("col").distinct()).join(t, ["row", "col"], "left").fillna(0.0)  # rows x columns of one table
    scale = F.sum("sw").over(Window.partitionBy()) / F.sum("sww").over(Window.partitionBy())
    out = chi_square_cells(full.select("row", "col", (F.col("sw") * scale).alias("value")))
    return out.withColumn("p", tails.chi2_p("stat", "df"))


def anova(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """One-way analysis of variance: f, df1, df2, p. Degrees of freedom count respondents, not weights."""
    kinds = dict(df.dtypes)
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double") if weight else F.lit(1.0)
    t = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull() & ~F.col(value).isin(*MISSING))
    t = t.select(text_of(F.col(group), kinds[group]).alias("g"), F.col(value).cast("double").alias("x"), w.alias("w"))
    shift = t.agg(F.avg("x")).first()[0] or 0.0
    d = F.col("x") - shift
    g = t.groupBy("g").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("ss"))
    out = g.agg(
        F.sum(F.col("s") * F.col("s") / F.col("w")).alias("a"), F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.count("*").alias("k"),
    )
    between, within = F.col("a") - F.col("s") * F.col("s") / F.col("w"), F.col("ss") - F.col("a")
    out = out.select(
        F.when(within > 0, between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).otherwise(0.0).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2")
    )
    return out.withColumn("p", tails.f_p("f", "df1", "df2"))


def overlapping(df: DataFrame, columns: list[tuple[str, Column]]) -> bool:
    """Whether some respondent is in two of the banner columns, which are no independent samples then."""
    held = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(False)).cast("int") for _, m in columns], F.lit(0))
    return (df.agg(F.max(held)).first()[0] or 0) > 1


def omnibus(df: DataFrame, stub: str, banner: list[str], weight: str | None = None, metric: str = "pct") -> DataFrame:
    """The test of a whole crosstab over its banner columns: test, stat, df1, df2, p, skipped.

    A mean line gets an analysis of variance; categories a chi-square on counts scaled to the effective base;
    a multi-select the second-order Rao-Scott test, on respondents. The last two need exclusive columns:
    overlapping ones are skipped, and ``skipped`` says why. Fewer than two columns or lines give no row.
    """
    spark = df.sparkSession
    name = resolve_column(df, stub)
    if name is None:
        raise ValueError(f"no column {stub}")
    kind, cols = read_stub(df, name), banners(df, banner, name)
    schema = "test string, stat double, df1 double, df2 double, p double, skipped string"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double") if weight else F.lit(1.0)
    place = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, (_, m) in enumerate(cols, 1)]))
    t = df.filter(F.col(name).isNotNull()).select(F.col(name).alias("stub"), w.alias("w"), place.alias("place"))
    if kind.numeric:
        if metric != "mean":
            return spark.createDataFrame([], schema)
        f = anova(t.withColumn("g", F.explode("place")), "stub", "g", "w")
        return f.select(F.lit("anova").alias("test"), F.col("f").alias("stat"), F.col("df1").cast("double").alias("df1"), F.col("df2").cast("double").alias("df2"), "p", F.lit(None).cast("string").alias("skipped"))
    test = "rao_scott_2" if kind.multi else "chi_square"
    if overlapping(df, cols):
        return spark.createDataFrame([(test, None, None, None, None, "banner columns overlap; test one banner variable")], schema)
    t = t.filter(F.size("place") > 0).withColumn("g", F.element_at("place", 1).cast("string"))
    if kind.multi:
        from tallywright.operators import multiselect

        options = [o for o, _ in multiselect.census(df, name)]
        out = rao_scott(t.withColumn("chosen", multiselect.split_answers(F.col("stub"))), options, "g")
    else:
        out = crosstab_chi_square(t, "stub", "g", "w")
    return out.select(F.lit(test).alias("test"), "stat", F.col("df").cast("double").alias("df1"), F.lit(None).cast("double").alias("df2"), "p", F.lit(None).cast("string").alias("skipped"))


def rao_scott(answers: DataFrame, options: list[str], group: str = "group", chosen: str = "chosen") -> DataFrame:
    """stat, df, p of simultaneous independence of options and exclusive groups, second order.

    ``answers`` has ``group`` and ``chosen`` (an array). The eigenvalues of the items' correlation matrix
    have mean 1, and their squares sum to that of its entries, so pair counts suffice: the correction is
    a2 = (sum of squared correlations) / J - 1. Constant items are left out.
    """
    t = answers.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[F.coalesce(F.array_contains(chosen, o), F.lit(False)).cast("double").alias(f"y{i}") for i, o in enumerate(options)])
    k = range(len(options))
    sums = t.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"s{i}") for i in k], *[F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"c{i}_{j}") for i in k for j in k if i < j])
    rows = sums.collect()  # one per group
    import numpy as np

    n = np.array([r.n for r in rows], float)
    total = n.sum()
    s = np.array([[r[f"s{i}"] for i in k] for r in rows], float).reshape(len(rows), -1)
    p = s.sum(0) / total if total else s.sum(0)
    live = [i for i in k if 0 < p[i] < 1]
    if len(rows) < 2 or not live or total < 3:
        stat, free = 0.0, 1.0
    else:
        x2 = sum(float((((s[:, i] - n * p[i]) ** 2) / (n * p[i]) + ((s[:, i] - n * p[i]) ** 2) / (n * (1 - p[i]))).sum()) for i in live)
        square = float(len(live))
        for i in live:
            for j in live:
                if i < j:
                    both = sum(r[f"c{i}_{j}"] for r in rows) / total
                    square += 2 * (both - p[i] * p[j]) ** 2 / (p[i] * (1 - p[i]) * p[j] * (1 - p[j]))
        a2 = square / len(live) - 1
        stat, free = x2 / (1 + a2), len(live) * (len(rows) - 1) / (1 + a2)
    out = answers.sparkSession.createDataFrame([(float(stat), float(free))], "stat double, df double")
    return out.withColumn("p", tails.chi2_p("stat", "df"))
