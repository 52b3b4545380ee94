"""Variants by digest, and what is counted by them, against whole cases."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import variants as V
from tracewell.operators.bindings import binding_counts
from tracewell.operators.net import SINK, SOURCE
from tracewell.operators.replay import trace_conformance
from tracewell.plans import discovery
from tracewell.sources.logs import traces_to_events


def traces(seed):
    rng = random.Random(seed)
    kinds = [[rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 40, 200]))] for _ in range(12)]
    out = {f"c{i:03}": rng.choice(kinds) for i in range(60)}
    long = [rng.choice("abc") for _ in range(200)]
    # Equal but for the first event, the last one, and one event more; names that run into each other.
    return out | {"x1": long, "x2": long, "x3": ["d", *long[1:]], "x4": [*long[:-1], "d"], "x5": [*long, "a"],
                  "y1": ["ab", "c"], "y2": ["a", "bc"], "y3": ["1:a", "b"], "y4": ["1:a1:b"], "y5": ["é", "𝔘"], "y6": ["é", "𝔘"]}


def log_of(spark, cases, block_rows=1 << 18):
    rows = random.Random(0).sample(sorted(cases.items()), len(cases))
    return traces_to_events(spark.createDataFrame(rows, "c string, t array<string>").repartition(3), "c", "t", block_rows)


@pytest.mark.parametrize("part_rows,block_rows", [(2, 7), (5, 1 << 18), (1024, 4)])
def test_against_whole_traces(spark, part_rows, block_rows):
    given = traces(part_rows)
    log = log_of(spark, given, block_rows)
    distinct, cases = V.variants(log, part_rows)
    smallest = {}
    for c in sorted(given, reverse=True):
        smallest[tuple(given[c])] = c
    assert {r.case_id: r.variant for r in cases.collect()} == {c: smallest[tuple(t)] for c, t in given.items()}
    # The chosen cases' events are as they were, blocks and all.
    kept = sorted(map(tuple, distinct.collect()), key=repr)
    assert kept == sorted(map(tuple, log.filter(F.col("case_id").isin(list(smallest.values()))).collect()), key=repr)
    assert V.variants(log.limit(0), part_rows)[1].collect() == []
    with pytest.raises(ValueError):
        V.trace_digests(log, 1)


@pytest.mark.parametrize("block_rows", [4, 10 ** 7])
def test_counted_by_variant(spark, block_rows):
    log = log_of(spark, traces(9), block_rows)
    plain, quick = (discovery.replayed(log, by_variant=v).collect() for v in (False, True))
    assert sorted(plain) == sorted(quick) and len(quick) == 71
    graph = discovery.discovered_graph(log)
    plain, quick = (binding_counts(log, graph, by_variant=v).collect() for v in (False, True))
    assert sorted(plain) == sorted(quick)


def test_case_longer_than_the_usual_block(spark):
    """Logs may be made with larger blocks than usual; a long case must not be lost then."""
    long = spark.range(300_000).select(F.lit("long").alias("case_id"), (F.col("id") + 1).alias("pos"), F.when(
        F.col("id") == 0, "a").when(F.col("id") == 299_999, "c").otherwise("b").alias("activity"))
    twin = long.withColumn("case_id", F.lit("twin"))
    short = spark.createDataFrame([("short", 1, "a"), ("short", 2, "c")], "case_id string, pos long, activity string")
    rules = spark.createDataFrame(
        [("a", [SOURCE], ["p"]), ("b", ["p"], ["p"]), ("c", ["p"], [SINK])], "activity string, pre array<string>, post array<string>")
    log = long.unionByName(twin).unionByName(short).withColumn("block", F.lit(None).cast("long"))
    for has_long in (None, False):
        got = {r.case_id: r.accepted for v in (False, True)
               for r in trace_conformance(log, rules, has_long=has_long, by_variant=v).collect()}
        assert got == {"long": True, "twin": True, "short": True}
    sizes = V.trace_digests(log)
    assert sizes.count() == 3 and sizes.select("digest").distinct().count() == 2


def test_no_whole_case_in_a_shuffle(spark, monkeypatch):
    """No row of what is written for digests holds more than a digest."""
    seen = []

    def kept(df, name="table", partition_by=None):
        seen.append((name, df.schema.simpleString()))
        return df
    monkeypatch.setattr(V, "materialize", kept)
    V.variants(log_of(spark, traces(3)), 16)
    assert all("array" not in schema for _, schema in seen) and "digests" in dict(seen)
