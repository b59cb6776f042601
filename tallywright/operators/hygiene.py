"""Quality flags of respondents: duplicates, straight-liners, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import names
from tallywright.operators.ordered import quantile

FLAGS = ("DUPLICATE_ID", "STRAIGHT_LINER", "INVALID_DURATION", "SPEEDER", "DUPLICATE_RECORD")


def repeated(df: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: whether another row has equal (or equally null) ``keys``.

    Keys are counted first, and only those that occur twice meet the rows again.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    twice = df.select(*named).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n").withColumn(out, F.lit(True))
    on = [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(twice, on, "left").drop(*[f"_k{i}" for i in range(len(keys))]).withColumn(out, F.coalesce(out, F.lit(False)))


def straight_liner(columns: list[str]) -> Column:
    """At least two answers to at least three ratings, all the same."""
    answers = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return (F.size(answers) >= 2) & (F.array_min(answers) == F.array_max(answers)) if len(columns) >= 3 else F.lit(False)


def rating_columns_of(df: DataFrame) -> list[str]:
    """Columns named like ratings; of those with bounds in their names the ones on the commonest scale."""
    found = [c for c in df.columns if not c.startswith("__") and names.is_rating(c)]
    scales = [names.scale_of(c) for c in found if names.scale_of(c)]
    if not scales:
        return found
    usual = max(sorted(set(scales)), key=scales.count)
    return [c for c in found if names.scale_of(c) in (None, usual)]


def audited(df: DataFrame, id_column: str | None = None, time_column: str | None = None, rating_columns: list[str] | None = None, substantive: list[str] | None = None) -> DataFrame:
    """``df`` with ``flags`` (array), ``__is_flagged`` and ``__flag_reasons``.

    Unnamed columns are found by name. Ids are compared trimmed and case-folded, nulls alike. A speeder
    takes less than a third of the median valid time; a null or non-positive time is invalid. Duplicate
    records agree in all substantive columns, of which there must be four (all but id, time and ``__``
    columns).
    """
    own = [c for c in df.columns if not c.startswith("__")]
    id_column = id_column or next((c for c in own if names.is_id(c)), None)
    time_column = time_column or next((c for c in own if names.is_time(c)), None)
    rating_columns = rating_columns if rating_columns is not None else rating_columns_of(df)
    substantive = substantive if substantive is not None else [c for c in own if c not in (id_column, time_column)]
    flags, out = [], df
    if id_column:
        out = repeated(out, [F.coalesce(F.upper(F.trim(F.col(id_column).cast("string"))), F.lit("NAN"))], "__twice")
        flags.append(F.when(F.col("__twice"), "DUPLICATE_ID"))
    flags.append(F.when(straight_liner(rating_columns), "STRAIGHT_LINER"))
    if time_column:
        t = F.col(time_column).try_cast("double")
        usual = quantile(df.filter(t > 0), t, 0.5)
        flags.append(F.when(t.isNull() | F.isnan(t) | (t <= 0), "INVALID_DURATION"))
        if usual is not None:
            flags.append(F.when((t > 0) & (t < usual / 3), "SPEEDER"))
    if len(substantive) >= 4:
        out = repeated(out, [F.col(c) for c in substantive], "__same")
        flags.append(F.when(F.col("__same"), "DUPLICATE_RECORD"))
    out = out.withColumn("flags", F.array_compact(F.array(*flags))).drop("__twice", "__same")
    return out.withColumn("__is_flagged", F.size("flags") > 0).withColumn("__flag_reasons", F.array_join("flags", "; "))


def quarantined(df: DataFrame, straight_liners: bool = True, speeders: bool = True) -> DataFrame:
    """Audited rows without those that the switches exclude."""
    bad = (["STRAIGHT_LINER"] if straight_liners else []) + (["SPEEDER", "INVALID_DURATION"] if speeders else [])
    return df.filter(~F.arrays_overlap("flags", F.array(*[F.lit(b) for b in bad]))) if bad else df


def flag_summary(df: DataFrame) -> DataFrame:
    """flag, n, share of audited rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("flag", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def audit_log(df: DataFrame, id_column: str) -> DataFrame:
    """One row per flag raised: id, flag, time."""
    return df.select(F.col(id_column).cast("string").alias("row_id"), F.explode("flags").alias("flag")).withColumn("at", F.current_timestamp())
