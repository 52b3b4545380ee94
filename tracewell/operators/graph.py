"""Dependency graph: which measures count as edges.

All functions take the ``rel, src, dst, measure`` table of ``directed_measures`` and return
edges ``src, dst`` without duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.measures import positive_direct, positive_loop2, positive_successor


@dataclass(frozen=True)
class Thresholds:
    """Least measures for edges, one-step loops, two-step loops and long-distance edges, and
    how much weaker than the best an edge may be."""

    dependency: float = 0.9
    loop1: float = 0.9
    loop2: float = 0.9
    long_distance: float = 0.9
    relative: float = 0.05


DEFAULTS = Thresholds()


def loops_len1(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return positive_direct(measures).filter(_is_loop(t)).select("src", "dst")


def _is_loop(t: Thresholds) -> str:
    return f"(src = dst AND measure >= {t.loop1}D)"


def _nodes(measures: DataFrame, t: Thresholds) -> DataFrame:
    """``activity, best_out, best_in, loops``: strongest edge to and from another activity, and
    whether the activity is a one-step loop."""
    return (
        positive_direct(measures)
        .selectExpr("measure", f"{_is_loop(t)} AS loop", "if(src <> dst, measure, NULL) AS to_other",
                    "stack(2, src, true, dst, false) AS (activity, leaves)")
        .groupBy("activity").agg(
            F.expr("max(to_other) FILTER (WHERE leaves) AS best_out"),
            F.expr("max(to_other) FILTER (WHERE NOT leaves) AS best_in"),
            F.expr("bool_or(loop) AS loops")))


def _loops_len2(measures: DataFrame, nodes: DataFrame, t: Thresholds) -> DataFrame:
    """Two-step loops and the best measures of the far end."""
    return (
        positive_loop2(measures).filter(f"measure >= {t.loop2}D").select("src", "dst")
        .join(nodes.selectExpr("activity AS src", "loops AS src_loops"), "src", "left")
        .join(nodes.selectExpr("activity AS dst", "loops AS dst_loops", "best_out", "best_in"), "dst", "left")
        .filter("NOT coalesce(src_loops, false) AND NOT coalesce(dst_loops, false)"))


def loops_len2(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Two-step loops neither end of which loops in one step."""
    return _loops_len2(measures, _nodes(measures, t), t).select("src", "dst")


def _edges(measures: DataFrame, t: Thresholds) -> DataFrame:
    """Positive direct measures, with the best measure at either end and whether it is weak.

    The best edges at an end all have the same measure, so they are weak together: when it is
    below the threshold and the activity is in a two-step loop with a partner whose best
    measure at the same end is clearly stronger.
    """
    nodes = _nodes(measures, t)
    partners = _loops_len2(measures, nodes, t).groupBy(F.col("src").alias("activity")).agg(
        F.max("best_out").alias("partner_out"), F.max("best_in").alias("partner_in"))

    def weak(end: str) -> str:
        return (f"coalesce(best_{end} < {t.dependency}D AND partner_{end} - best_{end} > {t.relative}D, false)"
                f" AS weak_{end}")

    judged = nodes.join(partners, "activity", "left").selectExpr(
        "activity", "best_out", "best_in", weak("out"), weak("in"))
    return (
        positive_direct(measures)
        .join(judged.selectExpr("activity AS src", "best_out", "weak_out"), "src")
        .join(judged.selectExpr("activity AS dst", "best_in", "weak_in"), "dst"))


def _is_best(end: str) -> str:
    return f"(src <> dst AND measure = best_{end})"


def _is_strong(end: str) -> str:
    return f"({_is_best(end)} AND NOT weak_{end})"


def _is_accepted(end: str, t: Thresholds) -> str:
    """Above the threshold, or hardly weaker than a strong best edge at the same end."""
    return f"(measure >= {t.dependency}D OR (NOT weak_{end} AND best_{end} - measure < {t.relative}D))"


def _where(measures: DataFrame, t: Thresholds, condition: str) -> DataFrame:
    return _edges(measures, t).filter(condition).select("src", "dst")


def best_successors(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The strongest edges out of each activity, all of them on a tie."""
    return _where(measures, t, _is_best("out"))


def best_predecessors(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The strongest edges into each activity, all of them on a tie."""
    return _where(measures, t, _is_best("in"))


def weak_out(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Best successors given up because a two-step-loop partner has a stronger one."""
    return _where(measures, t, f"{_is_best('out')} AND weak_out")


def weak_in(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Best predecessors given up because a two-step-loop partner has a stronger one."""
    return _where(measures, t, f"{_is_best('in')} AND weak_in")


def strong_out(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return _where(measures, t, _is_strong("out"))


def strong_in(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return _where(measures, t, _is_strong("in"))


def accepted_out(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return _where(measures, t, _is_accepted("out", t))


def accepted_in(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return _where(measures, t, _is_accepted("in", t))


def long_distance(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return positive_successor(measures).filter(f"measure > {t.long_distance}D").select("src", "dst")


def dependency_graph(measures: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """All one- and two-step loops, strong best edges, accepted edges and long-distance edges."""
    direct = _where(measures, t, " OR ".join([
        _is_loop(t), _is_strong("out"), _is_strong("in"), _is_accepted("out", t), _is_accepted("in", t)]))
    return direct.unionByName(loops_len2(measures, t)).unionByName(long_distance(measures, t)).distinct()


def adjacency(graph: DataFrame) -> DataFrame:
    """``activity, successors, predecessors``: sorted neighbours of every activity on an edge."""
    return (
        graph.selectExpr("stack(2, src, dst, NULL, dst, NULL, src) AS (activity, successor, predecessor)")
        .groupBy("activity").agg(
            F.expr("array_sort(collect_set(successor)) AS successors"),
            F.expr("array_sort(collect_set(predecessor)) AS predecessors")))
