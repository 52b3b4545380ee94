"""Arcs of a workflow net, given its places and the log they were found in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.profile import end_activities, start_activities

SOURCE, SINK = "In", "Out"


def event_to_place_arcs(places: DataFrame) -> DataFrame:
    return places.select(F.explode("in_set").alias("activity"), "place")


def place_to_event_arcs(places: DataFrame) -> DataFrame:
    return places.select("place", F.explode("out_set").alias("activity"))


def event_places_map(alphabet: DataFrame, places: DataFrame) -> DataFrame:
    """``activity, places``: the sorted output places of every activity, empty where it has none."""
    return (
        alphabet.join(event_to_place_arcs(places), "activity", "left")
        .groupBy("activity").agg(F.array_sort(F.collect_set("place")).alias("places")))


def connect_source_sink(places: DataFrame, log: DataFrame) -> DataFrame:
    """The places, a source before all start activities and a sink after all end activities."""
    return with_source_sink(places, start_activities(log), end_activities(log))


def with_source_sink(places: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Like connect_source_sink(), from one-column tables of the start and end activities."""
    nothing = F.array().cast("array<string>")
    source = starts.agg(F.array_sort(F.collect_list("activity")).alias("activities")).select(
        F.lit(SOURCE).alias("place"), nothing.alias("in_set"), F.col("activities").alias("out_set"))
    sink = ends.agg(F.array_sort(F.collect_list("activity")).alias("activities")).select(
        F.lit(SINK).alias("place"), F.col("activities").alias("in_set"), nothing.alias("out_set"))
    return places.unionByName(source).unionByName(sink)


def workflow_net(net_places: DataFrame) -> DataFrame:
    """``kind, place, activity``: one row per arc of the net."""
    return (
        event_to_place_arcs(net_places).select(F.lit("event_to_place").alias("kind"), "place", "activity")
        .unionByName(
            place_to_event_arcs(net_places).select(F.lit("place_to_event").alias("kind"), "place", "activity")))


def pre_post_places(alphabet: DataFrame, net_places: DataFrame) -> DataFrame:
    """``activity, pre, post``: sorted input and output places of every activity."""
    arcs = workflow_net(net_places)

    def of_kind(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("place"))))

    return (
        alphabet.join(arcs, "activity", "left").groupBy("activity")
        .agg(of_kind("place_to_event").alias("pre"), of_kind("event_to_place").alias("post")))
