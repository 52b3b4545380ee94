"""Names of columns that an operator adds beside those it is given."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with so many underscores after it that no column of ``df`` has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, replaced: Iterable[str]) -> list[str]:
    """The columns of ``df`` but those that are ``replaced``, which Spark finds in any case of letters."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds the place of each row in its group, from 0, by ``order`` (null first); columns in the order of ``df``.

    A group may be null, and of any size: rows are sorted in ranges of group and order and written, and the places
    where groups begin in each range follow from counts, one row for each group and range. Reads ``df`` twice, to
    sample and to sort, so it should be a written table.
    """
    row, piece, first = (free_name(df, n) for n in ("_row", "_piece", "_first"))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (*groups, *order)]
    # The numbers of written rows ascend through the ranges, whose own numbers are in the bits from 33 up.
    rows = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id())
        .withColumn(piece, F.shiftright(row, 33)), "ranges")
    names = [f"_group{i}" for i in range(len(groups))]
    earlier = Window.partitionBy(*names).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(groups, names, strict=True)), piece, row).groupBy(
        *names, piece).agg(F.min(row).alias(first), F.count(F.lit(1)).alias("n")).select(
        *names, piece, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col(first)).alias(first))
    starts = materialize(starts, "starts")
    same = F.col(f"r.{piece}") == F.col(f"s.{piece}")
    for c, n in zip(groups, names, strict=True):
        same &= F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.{n}"))
    return rows.alias("r").join(starts.alias("s"), same).select(
        *(F.col(f"r.`{c}`") for c in others(df, [rank])), (F.col(f"r.{row}") + F.col(f"s.{first}")).alias(rank))
