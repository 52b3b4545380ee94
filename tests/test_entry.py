"""The registered queries: every one has check SQL, and a choice of them agrees with it on the test tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_every_query_has_check_sql():
    """The queries of the llm subpackage, if it is there, have tests of their own."""
    others = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert others == {n for n in entry.oracle_sql() if n != "pipeline" and not re.match(r"op\d+_", n)}


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"activity", "side", "binding", "n"}


@needs_tables
@pytest.mark.parametrize("name", [
    "read_tsv_log", "read_xes_log", "read_xes_log_repeated_names", "build_traces", "build_traces_parts", "activity_index",
    "write_counts", "pre_post_places", "trace_conformance", "trace_conformance_by_variant", "causal_net_by_variant",
    "causal_net_customers_by_variant", "maximal_places", "relation_lookup", "sets_connected", "trace_conformance_reject",
    "dependency_counts_presence", "dependency_graph_sensitive", "input_bindings"])
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("events", "orders", "documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = connection.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(expected, key=repr)
