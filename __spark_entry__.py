"""Queries over the test tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import check_sql  # noqa: E402
from check_sql import sql  # noqa: E402
from tracewell.functions.storage import materialize, new_path  # noqa: E402
from tracewell.operators import bindings as B  # noqa: E402
from tracewell.operators import counts as D  # noqa: E402
from tracewell.operators import footprint as FP  # noqa: E402
from tracewell.operators import graph as G  # noqa: E402
from tracewell.operators import measures as M  # noqa: E402
from tracewell.operators import net as N  # noqa: E402
from tracewell.operators import places as P  # noqa: E402
from tracewell.operators import profile as L  # noqa: E402
from tracewell.operators import replay as C  # noqa: E402
from tracewell.plans import discovery  # noqa: E402
from tracewell.sources import logs as S  # noqa: E402
from tracewell.sources import sinks as W  # noqa: E402

try:  # The subpackage and the pipeline may have been taken out; whatever else is missing is an error.
    import corpus_pipeline
    from tracewell.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in {"corpus_pipeline", "tracewell.llm"}:
        raise
    corpus_pipeline = llm = None

# Thresholds under which the weak relations of the events log give every kind of edge.
SENSITIVE = G.Thresholds(dependency=0.5, loop1=0.995, loop2=0.05, long_distance=0.5, relative=0.02)
SENSITIVE_SQL = {"a": 0.5, "l1": 0.995, "l2": 0.05, "long": 0.5, "rel": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did, in time order."""
    return S.log_from_table(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who spoke in each conversation."""
    return S.log_from_table(_table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")


def customers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of each customer's orders."""
    return S.log_from_table(
        _table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")


def lifecycle_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps each order goes through, as an array: choices, an optional step and steps in either order."""
    price = F.col("o_totalprice")
    review = F.when(price >= 250000, F.array(F.lit("review"))).otherwise(F.array().cast("array<string>"))
    handling = F.when(price < 100000, F.array(F.lit("pack"), F.lit("invoice"))).otherwise(
        F.array(F.lit("invoice"), F.lit("pack")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(
        F.array(F.concat(F.lit("placed "), "o_orderpriority")), review,
        F.array(F.concat(F.lit("status "), "o_orderstatus")), handling,
        F.array(F.lit("close"))).alias("trace"))


def lifecycle_log(spark: SparkSession, sf_dir: str, by_case: bool = True) -> DataFrame:
    return S.traces_to_events(lifecycle_traces(spark, sf_dir), "o_orderkey", "trace", by_case=by_case)


def lifecycle_log_as_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle log for operators that do not group by case."""
    return lifecycle_log(spark, sf_dir, by_case=False)


def _joined(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined strings, the form the check SQL returns them in."""
    return df.select([
        F.array_join(f.name, ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema])


def _tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "log-tsv")
    _table(spark, sf_dir, "events").orderBy("ts", "event_id").select(
        F.concat_ws("\t", F.col("user_id").cast("string"), "event_type", "props")).write.text(path)
    return S.read_tsv_log(spark, path).select("case_id", "pos", "activity")


def _xes_log(spark: SparkSession, sf_dir: str, name) -> DataFrame:
    """The lifecycle log, written as XES with the given names of traces and read back, with these names."""
    path = new_path(spark, "log-xes")

    def named(value):
        return F.array(F.struct(F.lit("concept:name").alias("_key"), value.alias("_value")))

    (lifecycle_traces(spark, sf_dir)
     .select(named(name).alias("string"),
             F.transform("trace", lambda a: F.struct(named(a).alias("string"))).alias("event"))
     .write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path))
    return S.read_xes_log(spark, path, with_name=True)


def _xes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _xes_log(spark, sf_dir, F.col("o_orderkey").cast("string"))
    return log.select(F.col("name").alias("case_id"), "pos", "activity")


def _xes_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases of each name have each trace, where many traces share a name."""
    log = _xes_log(spark, sf_dir, F.concat(F.lit("case "), (F.col("o_orderkey") % 10).cast("string")))
    traces = log.groupBy("case_id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "activity"))).alias("t"))
    return traces.groupBy("name", F.array_join("t.activity", ",").alias("trace")).agg(F.count("*").alias("cases"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.explode_outer(F.split("text", "\n")).alias("line"))


def _footprint_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "footprint-text")
    W.write_footprint_text(FP.footprint_text(FP.footprint(lifecycle_log(spark, sf_dir))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _bindings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bindings")
    W.write_bindings(discovery.causal_net(conversations_log(spark, sf_dir)), path)
    return _joined(spark.read.parquet(path))


def _counts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "word-counts")
    W.write_counts(L.word_count(_lines(spark, sf_dir), "line"), path)
    return spark.read.parquet(path)


def _set_pairs(fp: DataFrame) -> DataFrame:
    """Sets to test: each activity with all that follow it and all that precede it, and both
    with all that are unrelated to it."""
    sets = FP.relation_sets(fp)
    one = F.array("activity")
    return sets.select("activity", F.inline(F.array(
        F.struct(F.lit("one-followers").alias("kind"), one.alias("in_set"), F.col("followers").alias("out_set")),
        F.struct(F.lit("preceders-one").alias("kind"), F.col("preceders").alias("in_set"), one.alias("out_set")),
        F.struct(F.lit("unrelated-followers").alias("kind"), F.col("unrelated").alias("in_set"),
                 F.col("followers").alias("out_set"))))).select(
        F.concat_ws(" ", "activity", "kind").alias("pair_id"), "in_set", "out_set")


def _relation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of the first and last activity of every case, and of each with itself."""
    log = lifecycle_log(spark, sf_dir)
    ends = log.groupBy("case_id").agg(
        F.max(F.when(F.col("pos") == 1, F.col("activity"))).alias("a"),
        F.max(F.when(F.col("next1").isNull(), F.col("activity"))).alias("b"))
    pairs = ends.select(F.inline(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
        F.struct("a", F.col("a").alias("b"))))).distinct()
    return FP.relation_lookup(pairs, FP.footprint(log))


def _lifecycle_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(FP.footprint(lifecycle_log(spark, sf_dir)), "footprint")


def _net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = lifecycle_log(spark, sf_dir)
    return log, discovery.discovered_places(log)


def _of_measures(operator: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(discovery.measured(events_log(spark, sf_dir)), *args)


def _of_counts(operator: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(
        materialize(D.dependency_counts(events_log(spark, sf_dir)), "dependency-counts"), *args)


def _of_log(log: Callable[[SparkSession, str], DataFrame], operator: Callable[..., DataFrame],
            *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _joined(operator(log(spark, sf_dir), *args))


def _of_footprint(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _joined(operator(FP.footprint(lifecycle_log(spark, sf_dir))))


def _of_places(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _joined(operator(P.maximal_places(_lifecycle_footprint(spark, sf_dir))))


def _event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lifecycle_log(spark, sf_dir)
    places = P.maximal_places(_lifecycle_footprint(spark, sf_dir))
    return _joined(N.event_places_map(L.activity_alphabet(log), places))


def _connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_net(spark, sf_dir)[1])


def _pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, places = _net(spark, sf_dir)
    return _joined(N.pre_post_places(L.activity_alphabet(log), places))


def _bindings(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = events_log(spark, sf_dir)
        return _joined(operator(log, discovery.discovered_graph(log)))
    return run


def _binding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return _joined(B.binding_counts(log, discovery.discovered_graph(log, SENSITIVE)))


def entry(spark: SparkSession) -> DataFrame:
    """Causal net of the events log: the binding counts of every activity."""
    return discovery.causal_net(events_log(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # Sources and sinks.
        "event_log": lambda spark, d: events_log(spark, d).drop("block"),
        "read_tsv_log": _tsv_round_trip,
        "read_xes_log": _xes_round_trip,
        "read_xes_log_repeated_names": _xes_repeated_names,
        "traces_to_events": lambda spark, d: lifecycle_log_as_read(spark, d).drop("block"),
        "build_traces": _of_log(events_log, S.build_traces),
        "build_traces_parts": _of_log(events_log, S.build_traces, 50),
        "write_footprint_text": _footprint_text_round_trip,
        "write_bindings": _bindings_round_trip,
        "write_counts": _counts_round_trip,
        # Log profile.
        "activity_alphabet": _of_log(events_log, L.activity_alphabet),
        "activity_index": _of_log(lifecycle_log_as_read, L.activity_index),
        "start_activities": _of_log(lifecycle_log_as_read, L.start_activities),
        "start_activities_events": _of_log(events_log, L.start_activities),
        "end_activities": _of_log(events_log, L.end_activities),
        "word_count": lambda spark, d: L.word_count(_lines(spark, d), "line"),
        # Footprint.
        "trace_follow_pairs": _of_log(events_log, FP.trace_follow_pairs),
        "follow_flags": _of_log(events_log, FP.follow_flags),
        "follow_flags_presence": _of_log(conversations_log, FP.follow_flags, "presence"),
        "footprint": _of_log(lifecycle_log, FP.footprint),
        "footprint_events": _of_log(events_log, FP.footprint),
        "footprint_conversations": _of_log(conversations_log, FP.footprint),
        "footprint_rows": _of_footprint(FP.footprint_rows),
        "footprint_text": _of_footprint(FP.footprint_text),
        "relation_lookup": _relation_lookup,
        "connected_pairs": _of_footprint(FP.connected_pairs),
        "sequence_pairs": _of_footprint(FP.sequence_pairs),
        "sets_connected": lambda spark, d: (
            lambda fp: FP.sets_connected(_set_pairs(fp), fp))(_lifecycle_footprint(spark, d)),
        # Places and net.
        "place_candidates": lambda spark, d: _joined(P.place_candidates(_lifecycle_footprint(spark, d))),
        "maximal_places": lambda spark, d: _joined(P.maximal_places(_lifecycle_footprint(spark, d))),
        "event_to_place_arcs": _of_places(N.event_to_place_arcs),
        "event_places_map": _event_places,
        "place_to_event_arcs": _of_places(N.place_to_event_arcs),
        "connect_source_sink": _connected,
        "workflow_net": lambda spark, d: N.workflow_net(_net(spark, d)[1]),
        "pre_post_places": _pre_post,
        # Conformance.
        "trace_conformance": _of_log(lifecycle_log, discovery.replayed),
        "trace_conformance_reject": _of_log(lifecycle_log, discovery.replayed, "last_wins", "reject"),
        "trace_conformance_by_variant": _of_log(lifecycle_log, discovery.replayed, "last_wins", "skip", True),
        "log_fitness": lambda spark, d: C.log_fitness(discovery.replayed(lifecycle_log(spark, d))),
        "log_fitness_conversations": lambda spark, d: C.log_fitness(discovery.replayed(conversations_log(spark, d))),
        # Dependency tallies.
        "activity_trace_count": _of_log(events_log, D.activity_trace_count),
        "direct_counts": _of_log(events_log, D.direct_counts),
        "loop2_counts": _of_log(events_log, D.loop2_counts),
        "successor_counts": _of_log(events_log, D.successor_counts),
        "dependency_counts": _of_log(events_log, D.dependency_counts),
        "dependency_counts_customers": _of_log(customers_log, D.dependency_counts),
        "dependency_counts_presence": _of_log(customers_log, D.dependency_counts, "presence"),
        # Measures.
        "direct_measure": _of_counts(M.direct_measure),
        "loop2_measure": _of_counts(M.loop2_measure),
        "loop2_measure_paper": _of_counts(M.loop2_measure, "paper"),
        "successor_measure": _of_counts(M.successor_measure),
        "directed_measures": _of_counts(M.directed_measures),
        "positive_direct": _of_measures(M.positive_direct),
        "positive_loop2": _of_measures(M.positive_loop2),
        "positive_successor": _of_measures(M.positive_successor),
        # Dependency graph.
        "loops_len1": _of_measures(G.loops_len1),
        "best_successors": _of_measures(G.best_successors),
        "best_predecessors": _of_measures(G.best_predecessors),
        "adjacency": lambda spark, d: _joined(G.adjacency(discovery.discovered_graph(events_log(spark, d)))),
        "dependency_graph": _of_measures(G.dependency_graph),
        "dependency_graph_sensitive": _of_measures(G.dependency_graph, SENSITIVE),
        # Bindings.
        "output_bindings": _bindings(B.output_bindings),
        "input_bindings": _bindings(B.input_bindings),
        "binding_counts": _binding_counts,
        "causal_net": _of_log(events_log, discovery.causal_net),
        "causal_net_lifecycle": _of_log(lifecycle_log, discovery.causal_net),
        "causal_net_by_variant": lambda spark, d: _joined(
            discovery.causal_net(lifecycle_log(spark, d), by_variant=True)),
        "causal_net_customers_by_variant": lambda spark, d: _joined(
            discovery.causal_net(customers_log(spark, d), by_variant=True)),
        "causal_net_customers": _of_log(customers_log, discovery.causal_net),
    }
    for operator in (G.loops_len2, G.weak_out, G.strong_out, G.weak_in, G.strong_in, G.accepted_out,
                     G.accepted_in, G.long_distance):
        out[operator.__name__] = _of_measures(operator, SENSITIVE)
    if llm:
        out |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return out


def oracle_sql() -> dict[str, str]:
    life, ev, conv, cust = "lifecycle", "events", "conversations", "customers"
    strings = "array_to_string(ins, ',') AS in_set, array_to_string(outs, ',') AS out_set"
    fitness = """SELECT count(*) FILTER (accepted) AS accepted, count(*) AS cases,
        (count(*) FILTER (accepted))::DOUBLE / count(*)::DOUBLE AS fitness FROM verdict"""
    out = {
        "event_log": sql(ev, "SELECT * FROM ev", ["ev"]),
        "read_tsv_log": sql(ev, "SELECT case_id::VARCHAR AS case_id, pos, activity FROM log", ["log"]),
        "read_xes_log": sql(life, "SELECT case_id::VARCHAR AS case_id, pos, activity FROM log", ["log"]),
        "traces_to_events": sql(life, "SELECT * FROM ev", ["ev"]),
        "read_xes_log_repeated_names": sql(life, """SELECT name, trace, count(*) AS cases FROM (
            SELECT 'case ' || case_id % 10 AS name, string_agg(activity, ',' ORDER BY pos) AS trace
            FROM log GROUP BY case_id) GROUP BY name, trace""", ["log"]),
        "build_traces": sql(ev, """SELECT case_id, 0::BIGINT AS part, string_agg(activity, ',' ORDER BY pos) AS trace
            FROM log GROUP BY case_id""", ["log"]),
        "build_traces_parts": sql(ev, """SELECT case_id, (pos - 1) // 50 AS part,
            string_agg(activity, ',' ORDER BY pos) AS trace FROM log GROUP BY ALL""", ["log"]),
        "write_footprint_text": sql(life, "SELECT line FROM fp_text", ["fp_text"]),
        "write_bindings": sql(conv, "SELECT * FROM bindings", ["bindings"]),
        "write_counts": check_sql.WORDS,
        "activity_alphabet": sql(ev, "SELECT * FROM alphabet", ["alphabet"]),
        "activity_index": sql(life, """SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS index
            FROM alphabet""", ["alphabet"]),
        "start_activities": sql(life, "SELECT * FROM starts", ["starts"]),
        "start_activities_events": sql(ev, "SELECT * FROM starts", ["starts"]),
        "end_activities": sql(ev, "SELECT * FROM ends", ["ends"]),
        "word_count": check_sql.WORDS,
        "trace_follow_pairs": sql(ev, "SELECT * FROM pairs", ["pairs"]),
        "follow_flags": sql(ev, "SELECT * FROM flags", ["flags"]),
        "follow_flags_presence": sql(conv, "SELECT * FROM flags_presence", ["flags_presence"]),
        "footprint": sql(life, "SELECT * FROM fp", ["fp"]),
        "footprint_events": sql(ev, "SELECT * FROM fp", ["fp"]),
        "footprint_conversations": sql(conv, "SELECT * FROM fp", ["fp"]),
        "footprint_rows": sql(life, "SELECT * FROM fp_rows", ["fp_rows"]),
        "footprint_text": sql(life, "SELECT * FROM fp_text", ["fp_text"]),
        "relation_lookup": sql(life, """SELECT a, b, relation FROM fp JOIN (
                SELECT f.activity AS a, l.activity AS b FROM log f JOIN ev l
                    ON f.pos = 1 AND l.next1 IS NULL AND f.case_id = l.case_id
                UNION SELECT l.activity, f.activity FROM log f JOIN ev l
                    ON f.pos = 1 AND l.next1 IS NULL AND f.case_id = l.case_id
                UNION SELECT activity, activity FROM starts) USING (a, b)""", ["fp", "starts", "ev"]),
        "connected_pairs": sql(life, "SELECT * FROM fp WHERE relation <> '#'", ["fp"]),
        "sequence_pairs": sql(life, "SELECT a, b FROM fp WHERE relation = '->'", ["fp"]),
        "sets_connected": sql(life, """, given AS (
                SELECT activity || ' one-followers' AS pair_id, [activity] AS ins, followers AS outs FROM sets
                UNION ALL SELECT activity || ' preceders-one', preceders, [activity] FROM sets
                UNION ALL SELECT activity || ' unrelated-followers', unrelated, followers FROM sets)
            SELECT pair_id,
                NOT EXISTS (SELECT 1 FROM fp WHERE list_contains(ins, a) AND list_contains(ins, b) AND relation <> '#')
                AND NOT EXISTS (SELECT 1 FROM fp WHERE list_contains(outs, a) AND list_contains(outs, b)
                    AND relation <> '#')
                AND NOT EXISTS (SELECT 1 FROM fp WHERE list_contains(ins, a) AND list_contains(outs, b)
                    AND relation <> '->') AS connected
            FROM given""", ["sets"]),
        "place_candidates": sql(life, f"SELECT {strings} FROM cand", ["cand"]),
        "maximal_places": sql(life, f"SELECT place, {strings} FROM places", ["places"]),
        "event_to_place_arcs": sql(life, "SELECT unnest(ins) AS activity, place FROM places", ["places"]),
        "event_places_map": sql(life, """SELECT activity, coalesce(string_agg(place, ',' ORDER BY place), '') AS places
            FROM alphabet LEFT JOIN (SELECT unnest(ins) AS activity, place FROM places) USING (activity)
            GROUP BY activity""", ["places", "alphabet"]),
        "place_to_event_arcs": sql(life, "SELECT place, unnest(outs) AS activity FROM places", ["places"]),
        "connect_source_sink": sql(life, f"SELECT place, {strings} FROM net", ["net"]),
        "workflow_net": sql(life, "SELECT * FROM arcs", ["arcs"]),
        "pre_post_places": sql(life, """SELECT activity, array_to_string(pre, ',') AS pre,
            array_to_string(post, ',') AS post FROM pre_post""", ["pre_post"]),
        "trace_conformance": sql(life, "SELECT * FROM verdict", ["verdict"]),
        "trace_conformance_reject": sql(life, "SELECT * FROM verdict", ["verdict"], stuck="NULL"),
        "trace_conformance_by_variant": sql(life, "SELECT * FROM verdict", ["verdict"]),
        "log_fitness": sql(life, fitness, ["verdict"]),
        "log_fitness_conversations": sql(conv, fitness, ["verdict"]),
        "activity_trace_count": sql(ev, "SELECT * FROM totals", ["totals"]),
        "direct_counts": sql(ev, "SELECT * FROM direct", ["direct"]),
        "loop2_counts": sql(ev, "SELECT * FROM loop2", ["loop2"]),
        "successor_counts": sql(ev, "SELECT * FROM successor", ["successor"]),
        "dependency_counts": sql(ev, "SELECT * FROM counts", ["counts"]),
        "dependency_counts_customers": sql(cust, "SELECT * FROM counts", ["counts"]),
        "dependency_counts_presence": sql(cust, "SELECT * FROM counts_presence", ["counts_presence"]),
        "direct_measure": sql(ev, "SELECT * FROM direct_m", ["direct_m"]),
        "loop2_measure": sql(ev, "SELECT * FROM loop2_m", ["loop2_m"]),
        "loop2_measure_paper": sql(ev, "SELECT * FROM loop2_paper_m", ["loop2_paper_m"]),
        "successor_measure": sql(ev, "SELECT * FROM successor_m", ["successor_m"]),
        "directed_measures": sql(ev, "SELECT * FROM measures", ["measures"]),
        "loops_len1": sql(ev, "SELECT * FROM c1", ["c1"]),
        "best_successors": sql(ev, "SELECT src, dst FROM cout", ["cout"]),
        "best_predecessors": sql(ev, "SELECT src, dst FROM cin", ["cin"]),
        "adjacency": sql(ev, """SELECT activity,
                coalesce(string_agg(s, ',' ORDER BY s), '') AS successors,
                coalesce(string_agg(p, ',' ORDER BY p), '') AS predecessors
            FROM (SELECT src AS activity, dst AS s, NULL AS p FROM dg
                UNION ALL SELECT dst, NULL, src FROM dg) GROUP BY activity""", ["dg"]),
        "dependency_graph": sql(ev, "SELECT * FROM dg", ["dg"]),
        "dependency_graph_sensitive": sql(ev, "SELECT * FROM dg", ["dg"], SENSITIVE_SQL),
        "output_bindings": sql(ev, "SELECT * FROM outb", ["outb"]),
        "input_bindings": sql(ev, "SELECT * FROM inb", ["inb"]),
        "binding_counts": sql(ev, "SELECT * FROM bindings", ["bindings"], SENSITIVE_SQL),
        "causal_net": sql(ev, "SELECT * FROM bindings", ["bindings"]),
        "causal_net_lifecycle": sql(life, "SELECT * FROM bindings", ["bindings"]),
        "causal_net_by_variant": sql(life, "SELECT * FROM bindings", ["bindings"]),
        "causal_net_customers_by_variant": sql(cust, "SELECT * FROM bindings", ["bindings"]),
        "causal_net_customers": sql(cust, "SELECT * FROM bindings", ["bindings"]),
    }
    for rel in ("direct", "loop2", "successor"):
        out[f"positive_{rel}"] = sql(ev, f"""SELECT src, dst, measure FROM measures
            WHERE rel = '{rel.upper()}' AND measure > 0""", ["measures"])
    for name, step in {"loops_len2": "c2", "weak_out": "weak_out", "strong_out": "strong_out", "weak_in": "weak_in",
                       "strong_in": "strong_in", "accepted_out": "accepted_out", "accepted_in": "accepted_in",
                       "long_distance": "long_distance"}.items():
        out[name] = sql(ev, f"SELECT src, dst FROM {step}", [step], SENSITIVE_SQL)
    if llm:
        out |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
