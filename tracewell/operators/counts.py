"""Dependency tallies: in how many cases one activity comes directly, in a two-step loop, or
at any distance before another.

Every tally has ``a <= b`` with ``c1`` cases oriented a before b and ``c2`` the other way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.footprint import oriented_pairs, trace_follow_pairs

COUNT, DIRECT, LOOP2, SUCCESSOR = "COUNT", "DIRECT", "LOOP2", "SUCCESSOR"


def activity_trace_count(log: DataFrame) -> DataFrame:
    """``activity, n``: number of cases in which the activity occurs."""
    return (
        log.select("case_id", "activity").distinct()
        .groupBy("activity").agg(F.count(F.lit(1)).alias("n")))


def _tally(oriented: DataFrame) -> DataFrame:
    return oriented.groupBy("a", "b").agg(
        F.count_if("forward").alias("c1"), F.count_if("backward").alias("c2"))


def direct_counts(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    return _tally(trace_follow_pairs(log, counting))


def loop2_counts(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """Patterns x y x with x <> y; the orientation is x before y."""
    sightings = log.filter((F.col("next2") == F.col("activity")) & (F.col("next1") != F.col("activity"))).select(
        "case_id",
        F.least("activity", "next1").alias("a"),
        F.greatest("activity", "next1").alias("b"),
        (F.col("activity") < F.col("next1")).alias("fwd"),
        "pos")
    return _tally(oriented_pairs(sightings, ["case_id", "a", "b"], counting))


def successor_counts(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """x comes before y in a case when the last x is before the last y (``last_wins``), or
    when some x is before some y (``presence``); a repeated activity comes before itself.

    A case enters only through the order in which its activities first and last occur. Cases
    that agree in it are counted once with their number before any pair is formed.
    """
    if counting not in ("last_wins", "presence"):
        raise ValueError(f"unknown counting {counting!r}")
    per_activity = log.groupBy("case_id", "activity").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"))
    # A marker per first and per last occurrence, in order: who, and does the marker open
    # (first) or close (last) the activity's span. One event that is both gives two markers.
    repeated = F.col("last") > F.col("first")
    if counting == "last_wins":
        markers = F.array(F.struct(F.col("last").alias("pos"), F.lit(1).alias("closes"), "activity",
                                   repeated.alias("repeated")))
    else:
        markers = F.array(
            F.struct(F.col("first").alias("pos"), F.lit(0).alias("closes"), "activity", repeated.alias("repeated")),
            F.struct(F.col("last").alias("pos"), F.lit(1).alias("closes"), "activity", repeated.alias("repeated")))
    outlines = (
        per_activity.groupBy("case_id").agg(F.sort_array(F.flatten(F.collect_list(markers))).alias("markers"))
        .select(F.transform("markers", lambda m: F.struct(
            m["activity"].alias("activity"), m["closes"].alias("closes"), m["repeated"].alias("repeated")))
            .alias("outline"))
        .groupBy("outline").agg(F.count(F.lit(1)).alias("n")))
    # An x opening (presence) or closing (last_wins) before a y closes.
    first_kind = 1 if counting == "last_wins" else 0
    pairs = (
        outlines.select("outline", "n", F.posexplode("outline").alias("i", "x"))
        .filter(F.col("x.closes") == first_kind)
        .select("n", "x", F.explode(F.filter(
            F.slice("outline", F.col("i") + 1, F.size("outline")), lambda m: m["closes"] == 1)).alias("y"))
        .filter((F.col("x.activity") != F.col("y.activity")) | F.col("x.repeated"))
        .select("n", F.col("x.activity").alias("x"), F.col("y.activity").alias("y")))
    fwd = F.col("x") <= F.col("y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.sum(F.when(fwd, F.col("n")).otherwise(0)).alias("c1"),
        F.sum(F.when(fwd, 0).otherwise(F.col("n"))).alias("c2"))


def dependency_counts(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """``rel, a, b, c1, c2``: all tallies in one table. ``COUNT`` rows have a = b and c2 = 0.

    One pass finds all sightings of activities, direct pairs and two-step loops; the pass for
    the successors reads the same shuffled events.
    """
    x, y, z = F.col("activity"), F.col("next1"), F.col("next2")

    def sighting(rel: str, a, b, fwd):
        return F.struct(F.lit(rel).alias("rel"), a.alias("a"), b.alias("b"), fwd.alias("fwd"))

    a, b = F.least(x, y), F.greatest(x, y)
    count = sighting(COUNT, x, x, F.lit(True))
    direct = sighting(DIRECT, a, b, x <= y)
    loop2 = sighting(LOOP2, a, b, x < y)
    sightings = log.select("case_id", "pos", F.inline(
        F.when(y.isNull(), F.array(count))
        .when((z == x) & (y != x), F.array(count, direct, loop2))
        .otherwise(F.array(count, direct))))
    near = oriented_pairs(sightings, ["case_id", "rel", "a", "b"], counting).groupBy("rel", "a", "b").agg(
        F.count_if("forward").alias("c1"), F.count_if("backward").alias("c2"))
    return near.unionByName(
        successor_counts(log, counting).select(F.lit(SUCCESSOR).alias("rel"), "a", "b", "c1", "c2"))
