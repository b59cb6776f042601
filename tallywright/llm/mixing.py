"""Mixing sources to target weights: capped water-filling and seeded repetitions, all in SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Slices of a source's hash order; a slice is ordered by itself only where the mix ends in it.
SLICES = 4096
#: Slices of all sources that are sent to every executor (about 25 MB); more are joined by a shuffle.
BROADCAST_CUTS = 250_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the total size. A share above
    max_epochs times its source is clamped there and the excess goes to the others by weight, until
    none is above. Filling to a common level clamps the sources in ascending size per weight, so the
    clamped are a prefix of that order, and the first source whose fill of the rest stays under its cap
    ends it. The table has one row per source, so its windows run in one small task.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("long"))
    t = t.withColumn("ratio", F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("heavy", F.sum("weight").over(everything))
    t = t.withColumn("rest", F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    t = t.withColumn("open", F.col("heavy") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # Integers are compared, so both sides are exact: rest * weight / open against max_epochs * size.
    t = t.withColumn("capped", (F.col("rest").cast("decimal(38,0)") * F.col("weight") > F.col("source_size").cast("decimal(38,0)") * max_epochs * F.col("open")).cast("int"))
    level = F.min(F.when(F.col("capped") == 0, F.struct("ratio", F.struct(F.col("source").isNull().alias("n"), "source").alias("s"), "rest", "open"))).over(everything)
    t = t.withColumn("level", level)
    filled = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.open")
    return t.select("source", "source_size", F.when(F.col("capped") == 1, (F.col("source_size") * max_epochs).cast("double")).otherwise(filled).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size) with source_size, target and copies: how often the mix takes a row.

    Each source is taken floor(target / source_size) times whole. Of the rest, rows are taken once more
    in the order of a seeded hash of doc_id, as long as the words so far, and half of the next row,
    stay within it; so a source ends within half a document of its target, and reruns agree. A row
    never exceeds max_epochs copies, since only a source below that has a rest. Rows that repeat a
    doc_id are ordered by size. Sources without words get target 0 and copies 0.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    docs = docs.withColumn("hash", key).withColumn("slice", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    by_slice = docs.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    per_source = by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goal = targets(per_source, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    goal = goal.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest")
    so_far = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = by_slice.withColumn("upto", F.sum("slice_size").over(so_far)).select(F.col("source").alias("s"), F.col("slice").alias("c"), "slice_size", "upto")
    cuts = cuts.join(goal, F.expr("s <=> of")).drop("of")
    all_in = F.col("upto") <= F.col("rest")
    none_in = F.col("upto") - F.col("slice_size") > F.col("rest")
    cuts = cuts.withColumn("inside", F.when(all_in, 1).when(none_in, 0).cast("int")).withColumn("room", F.col("rest") - (F.col("upto") - F.col("slice_size")))
    cuts = stored(cuts.select("s", "c", "source_size", "target", "whole", "inside", "room"), "cuts")
    if cuts.count() <= BROADCAST_CUTS:
        cuts = F.broadcast(cuts)  # only rows of the slices in which the mix ends are moved
    rows = docs.join(cuts, F.expr("source <=> s and slice = c")).drop("s", "c")
    sure = rows.filter("inside is not null").withColumn("extra", F.col("inside").cast("long"))
    order = Window.partitionBy("source", "slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.filter("inside is null").withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = part.withColumn("extra", (F.col("ahead") + F.col("size") / 2 <= F.col("room")).cast("long")).drop("ahead")
    out = sure.unionByName(part)
    return out.withColumn("copies", F.col("whole") + F.col("extra")).drop("hash", "slice", "whole", "inside", "room", "extra")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words of the text, 0 for null."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0; a null source is one more source. An empty table gives no rows.
    """
    out = mixed(stored(sizes(docs), "sizes"))  # the texts are read once
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, columns unchanged."""
    inner = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.struct(*docs.columns).alias("row"))
    return mixed(inner).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
