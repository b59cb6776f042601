"""Multi-select answers: splitting comma-joined text into options, other text, and indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Options that a census returns at most.
MOST_OPTIONS = 500
OUTSIDE_BRACKETS = r",\s*(?![^()]*\))"


def split_answers(c: Column) -> Column:
    """Options of an answer: cut at commas outside brackets; a part that starts in lower case belongs to
    the part before it, unless that starts with "other"."""
    parts = F.filter(F.transform(F.split(c.cast("string"), OUTSIDE_BRACKETS), F.trim), lambda p: p != "")

    def put(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & part.rlike(r"^\p{Ll}") & ~F.lower(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))).startswith("other")
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(", "), part)))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), put)


def census(df: DataFrame, column: str, least: int = 2) -> list[tuple[str, int]]:
    """Options with their counts, most frequent first, then by name; "Other: ..." and single ones left out.

    With fewer than ten answers single ones stay. The list is a questionnaire's options; more than
    MOST_OPTIONS are refused, ``census_table`` has them all.
    """
    t = census_table(df, column, least)
    rows = t.orderBy(F.desc("n"), "option").limit(MOST_OPTIONS + 1).collect()
    if len(rows) > MOST_OPTIONS:
        raise ValueError(f"{column} has more than {MOST_OPTIONS} options that occur {least} times; give the options, or raise least")
    return [(r.option, r.n) for r in rows]


def census_table(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    few = df.filter(F.col(column).isNotNull()).limit(10).count() < 10
    t = df.filter(F.col(column).isNotNull()).select(F.explode(split_answers(F.col(column))).alias("option"))
    t = t.filter(~F.lower("option").rlike(r"^other\s*[:(\-]")).groupBy("option").agg(F.count("*").alias("n"))
    return t if few else t.filter(F.col("n") >= least)


def resolved(df: DataFrame, column: str, options: list[str] | None = None) -> DataFrame:
    """``df`` with ``chosen`` (the known options of the answer) and ``other_text`` (what is left).

    Longer options are taken out first, so an option inside another's name isn't counted twice.
    """
    options = options if options is not None else [o for o, _ in census(df, column)]
    import re

    text, chosen = F.col(column).cast("string"), F.array().cast("array<string>")
    for o in sorted(options, key=lambda o: (-len(o), o)):
        pattern = rf"(?:^|,\s*)\Q{o}\E(?:\s*(?=,)|\s*$)"
        found = text.rlike(pattern)
        chosen = F.when(found, F.array_append(chosen, o)).otherwise(chosen)
        text = F.regexp_replace(text, pattern, "")
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[\s,]+|[\s,]+$", ""), r"(?i)^other\s*[:(\-]?\s*", ""))
    return df.withColumn("chosen", F.when(F.col(column).isNotNull(), chosen)).withColumn("other_text", F.when(F.length(rest) > 0, rest))


def indicators(df: DataFrame, column: str, options: list[str]) -> DataFrame:
    """``df`` with one 0/1 column ``<column>_<k>`` per option; null answers stay null."""
    out = resolved(df, column, options)
    for k, o in enumerate(options, 1):
        out = out.withColumn(f"{column}_{k}", F.array_contains("chosen", o).cast("int"))
    return out


def from_indicators(df: DataFrame, columns: dict[str, str], out: str = "chosen") -> DataFrame:
    """A binary set (0/1 columns by option) as one array of options."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(o)) for o, c in columns.items()])))


def binary_sets(columns: list[str]) -> dict[str, list[str]]:
    """0/1 columns that belong together: a common stem before a number, or a multi-response mark in the name."""
    import re

    sets: dict[str, list[str]] = {}
    for c in columns:
        marked = re.match(r"(.*?_(?:ms|mr|mrcv)_)", c, re.I)
        stem = re.match(r"(.+?)[_ .]?\d+(?:_.*)?$", c)
        key = marked[1] if marked else stem[1] if stem else None
        if key:
            sets.setdefault(key, []).append(c)
    return {k: v for k, v in sets.items() if len(v) > 1 or re.search(r"_(?:ms|mr|mrcv)_$", k, re.I)}
