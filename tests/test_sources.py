"""Text and XES logs, sinks, and unusual input."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize, shared_dir
from tracewell.operators.bindings import output_bindings
from tracewell.operators.counts import activity_trace_count, dependency_counts
from tracewell.operators.footprint import footprint, footprint_text, log_profile, oriented_pairs
from tracewell.operators.profile import word_count
from tracewell.operators.variants import trace_digests
from tracewell.plans.discovery import causal_net
from tracewell.sources.logs import build_traces, log_from_table, read_tsv_log, read_xes_log, read_xes_traces, traces_to_events
from tracewell.sources.sinks import write_bindings, write_counts, write_footprint_text


def traces_of(log):
    return {r.case_id: r.trace for r in build_traces(log).collect()}


def test_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\tb\n2\tx y\tignored\n1\ta\t\n")
    (tmp_path / "b.txt").write_text("2\tz\n1\t\tempty name\n\tno case\n")
    assert traces_of(read_tsv_log(spark, str(tmp_path))) == {
        "1": ["b", "a", ""], "2": ["x y", "z"], "": ["no case"]}


@pytest.mark.parametrize("line", ["no tab", "case\t", "\t", ""])
def test_bad_tsv_line(spark, tmp_path, line):
    (tmp_path / "a.txt").write_text(f"1\ta\n{line}\n1\tb\n")
    assert traces_of(read_tsv_log(spark, str(tmp_path), on_bad_line="drop")) == {"1": ["a", "b"]}
    with pytest.raises(Exception, match="no activity in log line"):
        traces_of(read_tsv_log(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        read_tsv_log(spark, str(tmp_path), on_bad_line="ignore")


def test_tsv_line_order_over_splits(spark, tmp_path):
    lines = [f"{i % 7}\t{i:06}" for i in range(20000)]
    for n in range(3):
        (tmp_path / f"part-{n}").write_text("\n".join(lines[n * 7000:(n + 1) * 7000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        # Cases of about 2,857 events are cut into blocks, so both ways of ordering are used.
        for block_rows in (1 << 18, 1000):
            whole = traces_of(read_tsv_log(spark, str(tmp_path), block_rows=block_rows))
            assert whole == {str(k): [f"{i:06}" for i in range(k, 20000, 7)] for k in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


XES = """<?xml version="1.0" encoding="UTF-8"?>
<log><string key="concept:name" value="the log"/>
<trace><string key="concept:name" value="c1"/>
 <event><string key="concept:name" value="A ] b"/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/></event>
 <event><string key="org:resource" value="x"/></event>
 <event><string key="org:resource" value="x"/><string key="concept:name" value="B"/></event></trace>
<trace><string key="concept:name" value="c1"/>
 <event><string key="concept:name" value="A ] b"/></event><event><string key="concept:name" value="B"/></event></trace>
<trace><event><string key="concept:name" value="C"/></event></trace>
</log>"""


def test_xes(spark, tmp_path):
    """Every trace is a case of its own, also where names repeat within a file and over files."""
    for name in ("one.xes", "two.xes"):
        (tmp_path / name).write_text(XES)
    read = read_xes_traces(spark, str(tmp_path))
    names = {r.case_id: r.name for r in read.collect()}
    assert names == {r.case_id: r.name for r in read.collect()}
    traces = traces_of(read_xes_log(spark, str(tmp_path)))
    assert traces.keys() == names.keys() and len(names) == 6
    assert sorted((str(names[c]), t) for c, t in traces.items()) == sorted(
        [("c1", ["A ] b", "B"]), ("c1", ["A ] b", "B"]), ("None", ["C"])] * 2)


def test_ties_are_found_on_request(spark):
    table = spark.createDataFrame([(7, 1, "a"), (7, 1, "b"), (8, 1, "c")], "k long, t int, x string")
    log_from_table(table, "k", ["t"], "x")
    with pytest.raises(ValueError, match="2 events of case 7"):
        log_from_table(table, "k", ["t"], "x", check_ties=True)
    log_from_table(table, "k", ["t", "x"], "x", check_ties=True)


def test_table_and_nulls(spark):
    table = spark.createDataFrame([(7, 2, "b"), (7, 1, "a"), (8, 1, "c")], "k long, t int, x string")
    log = log_from_table(table, "k", ["t"], "x", max_case_rows=2)
    assert traces_of(log) == {7: ["a", "b"], 8: ["c"]}
    nulls = spark.createDataFrame([(7, 2, None)], "k long, t int, x string")
    with pytest.raises(Exception, match="null activity"):
        traces_of(log_from_table(nulls, "k", ["t"], "x"))
    with pytest.raises(Exception, match="null case"):
        traces_of(log_from_table(nulls.selectExpr("cast(NULL AS long) AS k", "t", "'a' AS x"), "k", ["t"], "x"))


def test_names_with_equal_hash_codes_stay_apart(spark):
    log = traces_to_events(spark.createDataFrame(
        [(1, ["Aa", "BB"]), (2, ["a", "z"]), (3, ["n", "s"])], "c long, t array<string>"), "c", "t")
    assert activity_trace_count(log).count() == 6
    direct = {(r.a, r.b) for r in dependency_counts(log).filter("rel = 'DIRECT'").collect()}
    assert direct == {("Aa", "BB"), ("a", "z"), ("n", "s")}


def test_quotes_in_names(spark):
    log = traces_to_events(spark.createDataFrame(
        [(1, ["it's", "b\\c", 'd"e']), (2, ["it's", "b\\c"])], "c long, t array<string>"), "c", "t")
    bindings = {(r.activity, r.side): r.binding for r in causal_net(log).collect()}
    assert bindings["it's", "SUCC"] == ["b\\c"] and bindings["b\\c", "SUCC"] == ['d"e']


def test_one_event_cases(spark):
    log = traces_to_events(spark.createDataFrame([(1, ["a"]), (2, ["a"])], "c long, t array<string>"), "c", "t")
    assert [tuple(r) for r in dependency_counts(log).collect()] == [("COUNT", "a", "a", 2, 0)]
    assert [tuple(r) for r in footprint(log).collect()] == [("a", "a", "#")]
    assert causal_net(log).count() == 0


def test_word_count(spark):
    lines = spark.createDataFrame([("",), ("  ",), ("a b  ",), (" a",), ("c  d",)], "line string")
    assert {r.word: r.n for r in word_count(lines, "line").collect()} == {"": 3, "a": 2, "b": 1, "c": 1, "d": 1}


@pytest.mark.parametrize("single_file", [True, False])
def test_sinks(spark, tmp_path, single_file):
    log = traces_to_events(spark.createDataFrame(
        [(1, list("abd")), (2, list("acd"))], "c long, t array<string>"), "c", "t").cache()
    write_footprint_text(footprint_text(footprint(log)), str(tmp_path / "fp"), single_file)
    files = sorted((tmp_path / "fp").glob("part-*"))
    assert "".join(f.read_text() for f in files) == (
        "\ta\tb\tc\td\t\na\t#\t->\t->\t#\t\nb\t<-\t#\t#\t->\t\nc\t<-\t#\t#\t->\t\nd\t#\t<-\t<-\t#\t\n")
    counts = causal_net(log).cache()
    write_bindings(counts, str(tmp_path / "b"), "text", single_file)
    lines = {line for f in (tmp_path / "b").glob("part-*") for line in f.read_text().splitlines()}
    assert lines == {"((a/SUCC,Set(b)),1)", "((a/SUCC,Set(c)),1)", "((b/PRED,Set(a)),1)", "((b/SUCC,Set(d)),1)",
                     "((c/PRED,Set(a)),1)", "((c/SUCC,Set(d)),1)", "((d/PRED,Set(b)),1)", "((d/PRED,Set(c)),1)"}
    write_bindings(counts, str(tmp_path / "bp"), single_file=single_file)
    assert sorted(spark.read.parquet(str(tmp_path / "bp")).collect()) == sorted(counts.collect())
    words = word_count(spark.createDataFrame([("a b a",)], "line string"), "line")
    write_counts(words, str(tmp_path / "w"), "text", single_file)
    assert {line for f in (tmp_path / "w").glob("part-*") for line in f.read_text().splitlines()} == {
        "(a,2)", "(b,1)"}
    if single_file:
        assert len(list((tmp_path / "b").glob("part-*"))) == 1
    with pytest.raises(ValueError):
        write_counts(words, str(tmp_path / "x"), "csv")


def test_written_tables_lie_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3), "three").inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark))


def test_xes_cases_stay_the_same_however_files_are_split(spark, tmp_path):
    for name, count in (("a", 300), ("b", 1), ("c", 120)):
        traces = "".join(
            f'<trace><string key="concept:name" value="{name}{i}"/>' + "".join(
                f'<event><string key="concept:name" value="{"xyz"[(i + k) % 3]}"/></event>' for k in range(i % 4)) + "</trace>\n"
            for i in range(count))
        (tmp_path / f"{name}.xes").write_text(f"<log>\n{traces}</log>")
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7000", "1500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_xes_traces(spark, str(tmp_path))
            found.append(sorted((r.case_id, r.name, r.trace) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 421
    # A case is known by its file and its number there.
    assert {(c.rpartition("/")[2], name) for c, name, _ in found[0]} == {
        (f"{f}.xes#{i}", f"{f}{i}") for f, n in (("a", 300), ("b", 1), ("c", 120)) for i in range(n)}
    log = read_xes_log(spark, str(tmp_path), with_name=True)
    assert {(r.case_id, r.name) for r in log.collect()} == {(c, n) for c, n, t in found[0] if t}


def small_tasks(spark, monkeypatch, cases):
    """A log by case of 49 events a case on average, where a task is to get 1,000, and the log as read."""
    monkeypatch.setattr("tracewell.sources.logs.TASK_EVENTS", 1000)
    given = spark.createDataFrame(
        [(i, ["a", "b"] * (i % 50)) for i in range(cases)] + [(-1, None), (-2, [])], "c long, t array<string>")
    return traces_to_events(given, "c", "t", by_case=True), traces_to_events(given, "c", "t")


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("cases", [400, 1600])
def test_by_case_tasks_sized_by_events(spark, monkeypatch, cases):
    """However few bytes the arrays take and however many partitions a shuffle has."""
    log, as_read = small_tasks(spark, monkeypatch, cases)
    assert most_in_a_task(log) < 3000
    tasks = log.select("case_id", F.spark_partition_id().alias("task")).distinct()
    assert tasks.groupBy("case_id").count().filter("count > 1").isEmpty()
    assert sorted(map(tuple, log.collect()), key=repr) == sorted(map(tuple, as_read.collect()), key=repr)
    nothing = spark.createDataFrame([], "c long, t array<string>")
    assert traces_to_events(nothing, "c", "t", by_case=True).collect() == []


def test_bindings_stay_in_small_tasks(spark, monkeypatch):
    log, as_read = small_tasks(spark, monkeypatch, 800)
    graph = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    links = output_bindings(log, graph)
    assert most_in_a_task(links) < 3000
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, output_bindings(as_read, graph).collect()))


def test_digests_come_from_small_tasks(spark, monkeypatch):
    log, as_read = small_tasks(spark, monkeypatch, 800)
    monkeypatch.setattr("tracewell.operators.variants.materialize", lambda df, name: df)
    digests = trace_digests(log)
    assert most_in_a_task(digests) < 100
    assert sorted(map(tuple, digests.collect())) == sorted(map(tuple, trace_digests(as_read).collect()))


def test_profile_starts_in_small_tasks(spark, monkeypatch):
    """Pairs of each case are found in the tasks of the log; the profile itself is the same as without them."""
    log, as_read = small_tasks(spark, monkeypatch, 800)
    sightings = log.selectExpr("case_id", "pos", "activity AS a", "pos > 1 AS fwd")
    assert most_in_a_task(oriented_pairs(sightings.withColumn("b", F.col("pos")), ["case_id", "a", "b"], "last_wins")) < 3000
    assert sorted(map(tuple, log_profile(log).collect())) == sorted(map(tuple, log_profile(as_read).collect()))


def test_tables_read_by_few_tasks_are_sent_on_by_many(spark, monkeypatch):
    """Beyond DIRECT_TASKS a task holds what it sends, so those that read the table must not be the ones to send it there."""
    _, as_read = small_tasks(spark, monkeypatch, 800)
    rows = sorted(map(tuple, as_read.collect()), key=repr)
    dealt = []
    for most in (200, 7):
        monkeypatch.setattr("tracewell.sources.logs.DIRECT_TASKS", most)
        log, _ = small_tasks(spark, monkeypatch, 800)
        dealt.append(log._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM"))
        assert sorted(map(tuple, log.collect()), key=repr) == rows
        assert most_in_a_task(log) < 3000
        tasks = log.select("case_id", F.spark_partition_id().alias("task")).distinct()
        assert tasks.groupBy("case_id").count().filter("count > 1").isEmpty()
    assert dealt == [1, 2]
