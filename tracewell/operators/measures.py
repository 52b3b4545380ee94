"""Dependency measures between -1 and 1 from the tallies of ``dependency_counts``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.counts import COUNT, DIRECT, LOOP2, SUCCESSOR

_FORWARD, _BACKWARD = "(c1 - c2) / (c1 + c2 + 1)", "(c2 - c1) / (c1 + c2 + 1)"


def _of(counts: DataFrame, rel: str, forward: str, backward: str) -> DataFrame:
    return counts.filter(f"rel = '{rel}'").selectExpr("a", "b", f"{forward} AS forward", f"{backward} AS backward")


def direct_measure(counts: DataFrame) -> DataFrame:
    """``a, b, forward, backward`` of the direct tallies."""
    return _of(counts, DIRECT, f"if(a = b, c1 / (c1 + 1), {_FORWARD})", f"if(a = b, 0D, {_BACKWARD})")


def loop2_measure(counts: DataFrame, loop2: str = "difference") -> DataFrame:
    """Two-step loops: the difference of the tallies, or with ``"paper"`` their sum both ways."""
    if loop2 == "paper":
        return _of(counts, LOOP2, "(c1 + c2) / (c1 + c2 + 1)", "(c1 + c2) / (c1 + c2 + 1)")
    if loop2 == "difference":
        return _of(counts, LOOP2, _FORWARD, _BACKWARD)
    raise ValueError(f"loop2 must be 'difference' or 'paper', not {loop2!r}")


def successor_measure(counts: DataFrame) -> DataFrame:
    """How often one comes before the other, less the difference of their own tallies."""
    totals = counts.filter(f"rel = '{COUNT}'")
    joined = (
        counts.join(totals.selectExpr("a", "c1 AS n_a"), "a").join(totals.selectExpr("b", "c1 AS n_b"), "b"))
    return _of(joined, SUCCESSOR, "2D * (c1 - abs(n_a - n_b)) / (n_a + n_b + 1)",
               "2D * (c2 - abs(n_a - n_b)) / (n_a + n_b + 1)")


def directed_measures(counts: DataFrame, loop2: str = "difference") -> DataFrame:
    """``rel, src, dst, measure``: both directions of every measure as rows."""
    return (
        direct_measure(counts).withColumn("rel", F.lit(DIRECT))
        .unionByName(loop2_measure(counts, loop2).withColumn("rel", F.lit(LOOP2)))
        .unionByName(successor_measure(counts).withColumn("rel", F.lit(SUCCESSOR)))
        .selectExpr("rel", "stack(2, a, b, forward, b, a, backward) AS (src, dst, measure)"))


def _positive(measures: DataFrame, rel: str) -> DataFrame:
    return measures.filter(f"rel = '{rel}' AND measure > 0").select("src", "dst", "measure")


def positive_direct(measures: DataFrame) -> DataFrame:
    return _positive(measures, DIRECT)


def positive_loop2(measures: DataFrame) -> DataFrame:
    return _positive(measures, LOOP2)


def positive_successor(measures: DataFrame) -> DataFrame:
    return _positive(measures, SUCCESSOR)
