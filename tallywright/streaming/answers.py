"""Answers as a stream: each micro-batch is coded and appended; an extra beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywright.operators.openends import coded


def code_stream(answers: DataFrame, column: str, codeframe: dict, out: str, checkpoint: str) -> StreamingQuery:
    """Code a streaming DataFrame into a Parquet table; the coder keeps no state, so restarts repeat nothing."""
    return coded(answers, column, codeframe).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sentiment_by_window(answers: DataFrame, column: str, codeframe: dict, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by time window and sentiment, closed when the watermark has passed."""
    t = coded(answers, column, codeframe).withWatermark(time, late)
    return t.groupBy(F.window(time, window), F.col("coded.sentiment").alias("sentiment")).agg(F.count("*").alias("n"))
