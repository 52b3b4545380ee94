"""Putting the events of every case in order, also when one case is huge.

The ordered log carries, per event, its 1-based position in the case and the next two
activities of the case, so that no later operator has to sort a case again.

Cases of up to ``block_rows`` events are ordered by one window per case. Longer cases
never go to one task: their events are range-partitioned on (case, order), numbered
from per-partition row counts, and cut into blocks of ``block_rows`` positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize

# A case of more events than this is handled in several blocks.
BLOCK_ROWS = 1 << 18

LOG_COLUMNS = ["case_id", "pos", "block", "activity", "next1", "next2"]


def block_of(pos: Column, block_rows: int) -> Column:
    return F.call_function("div", pos.cast("bigint") - 1, F.lit(block_rows))


def order_events(events: DataFrame, order: Sequence[str], block_rows: int = BLOCK_ROWS,
                 max_case_rows: int | None = None) -> DataFrame:
    """Ordered log from ``events(case_id, activity, *order)``.

    ``order`` must be unique within a case. Unless the caller vouches for
    ``max_case_rows``, one pass over ``case_id`` counts the events per case first.
    """
    if block_rows < 2:
        raise ValueError("a block must hold at least two events")
    if max_case_rows is not None and max_case_rows <= block_rows:
        return _order_whole_cases(events, order)
    sizes = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
    if sizes.isEmpty():
        return _order_whole_cases(events, order)
    sizes = materialize(sizes, "long-cases")
    short = events.join(sizes, "case_id", "left_anti")
    long = events.join(sizes.select("case_id"), "case_id", "left_semi")
    total = sizes.agg(F.sum("n")).first()[0]
    return _order_whole_cases(short, order).unionByName(
        _order_long_cases(long, order, block_rows, total))


def _order_whole_cases(events: DataFrame, order: Sequence[str]) -> DataFrame:
    by_case = Window.partitionBy("case_id").orderBy(*order)
    return events.select(
        "case_id",
        F.row_number().over(by_case).cast("bigint").alias("pos"),
        F.lit(None).cast("bigint").alias("block"),
        "activity",
        F.lead("activity", 1).over(by_case).alias("next1"),
        F.lead("activity", 2).over(by_case).alias("next2"),
    )


def _order_long_cases(events: DataFrame, order: Sequence[str], block_rows: int, total: int) -> DataFrame:
    # Sorted pieces of about four blocks each; the written row ids keep the sort order
    # and say which piece a row is in (the bits from 33 up).
    pieces = -(-total // (4 * block_rows))
    keys = ["case_id", *order]
    sorted_rows = materialize(
        events.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys)
        .select("case_id", "activity", F.monotonically_increasing_id().alias("row_id"))
        .withColumn("piece", F.shiftright("row_id", 33)),
        "sorted-events")

    # One row per case and piece: how many events of the case lie in earlier pieces.
    earlier = Window.partitionBy("case_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        sorted_rows.groupBy("case_id", "piece")
        .agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n"),
        "piece-starts")
    numbered = (
        sorted_rows.join(starts, ["case_id", "piece"])
        .select("case_id", "activity", (F.col("row_id") - F.col("first_id") + F.col("before") + 1).alias("pos")))
    return with_next(numbered, block_rows)


def with_next(numbered: DataFrame, block_rows: int) -> DataFrame:
    """Add ``block``, ``next1`` and ``next2`` to ``(case_id, activity, pos)`` of long cases.

    The first two events of a block are also sent to the block before, as its look-ahead.
    """
    pos = F.col("pos")
    own = block_of(pos, block_rows)
    by_block = Window.partitionBy("case_id", "block").orderBy("pos")
    return (
        numbered
        .withColumn("block", F.explode(
            F.when((own > 0) & ((pos - 1) % block_rows < 2), F.array(own, own - 1)).otherwise(F.array(own))))
        .withColumn("next1", F.lead("activity", 1).over(by_block))
        .withColumn("next2", F.lead("activity", 2).over(by_block))
        .filter(F.col("block") == own)
        .select(LOG_COLUMNS))
