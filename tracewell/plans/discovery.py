"""Whole jobs: from a log to a causal net, or to a workflow net and its fitness.

Each stage boundary writes its result, which is as large as the related pairs of activities and not
as the log, so that the stages after it neither read the log again nor guess at sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.operators.bindings import binding_counts
from tracewell.operators.counts import dependency_counts
from tracewell.operators.footprint import log_profile, profile_alphabet, related_cells
from tracewell.operators.graph import DEFAULTS, Thresholds, dependency_graph
from tracewell.operators.measures import directed_measures
from tracewell.operators.net import pre_post_places, with_source_sink
from tracewell.operators.places import maximal_places
from tracewell.operators.replay import trace_conformance


def measured(log: DataFrame, counting: str = "last_wins", loop2: str = "difference") -> DataFrame:
    """Directed measures of a log, over tallies written once."""
    return directed_measures(materialize(dependency_counts(log, counting), "dependency-counts"), loop2)


def discovered_graph(log: DataFrame, t: Thresholds = DEFAULTS, counting: str = "last_wins",
                     loop2: str = "difference") -> DataFrame:
    """Dependency graph of a log, written once."""
    return materialize(dependency_graph(measured(log, counting, loop2), t), "graph")


def causal_net(log: DataFrame, t: Thresholds = DEFAULTS, counting: str = "last_wins",
               loop2: str = "difference", by_variant: bool = False) -> DataFrame:
    """``activity, side, binding, n``: the binding counts of a log."""
    return binding_counts(log, discovered_graph(log, t, counting, loop2), by_variant=by_variant)


def profiled(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """The profile of a log, written once: the only pass over the log that discovering a net takes."""
    return materialize(log_profile(log, counting), "log-profile")


def places_of(profile: DataFrame) -> DataFrame:
    """Maximal places with source and sink, written once, from a written profile."""
    def ends(kind: str) -> DataFrame:
        return profile.where(F.col("kind") == kind).select(F.col("a").alias("activity"))

    places = maximal_places(related_cells(profile.where("kind = 'pair'")))
    return materialize(with_source_sink(places, ends("start"), ends("end")), "net-places")


def discovered_places(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """Maximal places of a log with source and sink, written once."""
    return places_of(profiled(log, counting))


def replayed(log: DataFrame, counting: str = "last_wins", on_disabled: str = "skip",
             by_variant: bool = False) -> DataFrame:
    """``case_id, accepted``: the log replayed on the net discovered from it."""
    profile = profiled(log, counting)
    rules = pre_post_places(profile_alphabet(profile), places_of(profile))
    has_long = bool(profile.agg(F.bool_or("long")).first()[0])
    return trace_conformance(log, rules, on_disabled, has_long=has_long, by_variant=by_variant)
