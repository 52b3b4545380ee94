"""Log profile: alphabet, first and last activities, word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize


def activity_alphabet(log: DataFrame) -> DataFrame:
    return log.select("activity").distinct()


def activity_index(log: DataFrame) -> DataFrame:
    """``activity, index``: 0-based rank of each name.

    The names are sorted in ranges, each numbered in its own task and shifted by the sizes of those before.
    """
    names = activity_alphabet(log)
    ordered = materialize(
        names.repartitionByRange("activity").sortWithinPartitions("activity")
        .select("activity", F.monotonically_increasing_id().alias("row_id"))
        .withColumn("piece", F.shiftright("row_id", 33)), "sorted-names")
    # One row per range: the running sum over them is the only step in a single task.
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("piece").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).select(
        "piece", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ordered.join(starts, "piece").select(
        "activity", (F.col("row_id") - F.col("first_id") + F.col("before")).alias("index"))


def start_activities(log: DataFrame) -> DataFrame:
    return log.filter(F.col("pos") == 1).select("activity").distinct()


def end_activities(log: DataFrame) -> DataFrame:
    return log.filter(F.col("next1").isNull()).select("activity").distinct()


def word_count(lines: DataFrame, column: str) -> DataFrame:
    """``word, n`` over lines split at single spaces.

    Empty words between and before spaces count, those at the end of a line do not; an
    empty line is one empty word, a line of spaces only is none.
    """
    line, trimmed = F.col(column), F.rtrim(column)
    words = F.when((line == "") | (trimmed != ""), F.split(trimmed, " "))
    # An outer explode keeps the split from being evaluated a second time to filter empty arrays.
    return (
        lines.select(F.explode_outer(words).alias("word")).filter("word IS NOT NULL")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
