"""Readers that turn tables, text, XES and trace arrays into the canonical event log.

Canonical event log: ``case_id``, ``pos`` (1-based position in the case), ``block`` (null
unless the case is so long that it is cut into blocks), ``activity``, ``next1``, ``next2``
(the two activities that follow in the case, null past its end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.ordering import BLOCK_ROWS, LOG_COLUMNS, block_of, order_events
from tracewell.functions.storage import materialize

ColumnOrName = Column | str

# Events that a task gets on average of traces spread by case.
TASK_EVENTS = 1 << 18
# A task that sends rows to at most so many others writes each as it comes; with more of them it holds all its rows until the end.
DIRECT_TASKS = 200


def _column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _required(c: Column, what: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(f"null {what} in event log")))


def log_from_table(df: DataFrame, case: ColumnOrName, order_by: Sequence[ColumnOrName], activity: ColumnOrName,
                   block_rows: int = BLOCK_ROWS, max_case_rows: int | None = None,
                   check_ties: bool = False) -> DataFrame:
    """Event log of a table; ``order_by`` must order the rows of each case without ties.

    ``check_ties`` makes sure of that, at the price of a grouping by case and order, and fails otherwise.
    """
    order = [f"order_{i}" for i in range(len(order_by))]
    events = df.select(
        _required(_column(case), "case").alias("case_id"),
        _required(_column(activity).cast("string"), "activity").alias("activity"),
        *[_column(c).alias(name) for c, name in zip(order_by, order)])
    if check_ties:
        tied = events.groupBy("case_id", *order).count().filter("count > 1").first()
        if tied:
            raise ValueError(f"{tied['count']} events of case {tied['case_id']!r} have the same order")
    return order_events(events, order, block_rows, max_case_rows)


def read_tsv_log(spark: SparkSession, path: str, on_bad_line: str = "fail",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lines ``case<TAB>activity[<TAB>ignored]``; events of a case are in line order.

    Files are ordered by path. A line without a second field (trailing empty fields do not
    count) fails the query, or is left out with ``on_bad_line="drop"``.
    """
    if on_bad_line not in ("fail", "drop"):
        raise ValueError(f"on_bad_line must be 'fail' or 'drop', not {on_bad_line!r}")
    lines = spark.read.text(path).select(
        "value",
        F.split(F.regexp_replace("value", "\t+$", ""), "\t").alias("fields"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row_id"))
    good = F.size("fields") >= 2
    if on_bad_line == "drop":
        lines = lines.filter(good)
    else:
        lines = lines.withColumn("fields", F.when(good, F.col("fields")).otherwise(
            F.raise_error(F.concat(F.lit("no activity in log line: "), F.col("value")))))
    return log_from_table(lines, F.col("fields")[0], ["file", "start", "row_id"], F.col("fields")[1], block_rows)


_XES_STRINGS = T.ArrayType(T.StructType([
    T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_XES_SCHEMA = T.StructType([
    T.StructField("string", _XES_STRINGS),
    T.StructField("event", T.ArrayType(T.StructType([T.StructField("string", _XES_STRINGS)]))),
])


def _concept_name(strings: Column) -> Column:
    return F.get(F.filter(strings, lambda s: s["_key"] == "concept:name"), F.lit(0))["_value"]


def _with_ordinal(rows: DataFrame) -> DataFrame:
    """Rows ``file, start, row_id`` and more with ``ordinal``, their number in the file from 0, instead of the last two.

    The rows of a piece of a file are read by one task one after another, so their ids are too; how many rows the pieces before
    have makes the number the same however files are split. Only one row per piece is counted up.
    """
    rows = materialize(rows, "file-rows")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("file", "start").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    pieces = materialize(pieces, "file-pieces")
    return rows.join(pieces, ["file", "start"]).withColumn("ordinal", F.col("row_id") + F.col("shift")).drop(
        "start", "row_id", "shift")


def read_xes_traces(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, name, trace``: one row per ``<trace>``, with the names of its events that have one.

    ``name`` is the trace's own ``concept:name``, which may be missing or repeat, within a file or over
    several. ``case_id`` is its own: the file and its number in there from 0, however the files are split for reading.
    The files are read once; what is found in them is written.
    """
    rows = (
        spark.read.format("xml").option("rowTag", "trace").schema(_XES_SCHEMA).load(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row_id"), _concept_name(F.col("string")).alias("name"),
            F.filter(F.transform("event", lambda e: _concept_name(e["string"])),
                     lambda name: name.isNotNull()).alias("trace")))
    return _with_ordinal(rows).select(
        F.concat_ws("#", "file", F.col("ordinal").cast("string")).alias("case_id"), "name", "trace")


def read_xes_log(spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS, with_name: bool = False) -> DataFrame:
    """One case per ``<trace>``, whatever its name, and one event per ``<event>`` that has a ``concept:name``.

    ``case_id`` is that of read_xes_traces(); ``with_name`` adds the name of the event's trace as ``name``.
    """
    keep = ["name"] if with_name else []
    return traces_to_events(read_xes_traces(spark, path), "case_id", "trace", block_rows, keep=keep)


def traces_to_events(df: DataFrame, case: ColumnOrName, trace: ColumnOrName,
                     block_rows: int = BLOCK_ROWS, by_case: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Event log of a table that holds one array of activity names per row.

    ``keep`` names columns of the table, other than those of a log, that each event gets too. Needs no shuffle. With ``by_case`` the arrays are hash-partitioned by case before they are
    spread into events, so that operators that group by case need not shuffle the events. The bytes of the arrays
    say little about the rows they become, so one pass over the table counts the events first and there are
    as many partitions as these need. Where that is more than ``DIRECT_TASKS``, the arrays go to so many partitions
    before, for the tasks that send them on hold their rows meanwhile, and those that read the table may get any number.
    """
    tasks = 0
    if by_case:
        events = df.agg(F.sum(F.greatest(F.size(_column(trace)), F.lit(0)))).first()[0] or 0
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-events // TASK_EVENTS))
        if tasks > DIRECT_TASKS:
            df = df.repartition(DIRECT_TASKS, _column(case))
    traces = df.select(_required(_column(case), "case").alias("case_id"), _column(trace).alias("trace"), *keep)
    if tasks:
        traces = traces.repartition(tasks, "case_id")
    return (
        traces.select("case_id", F.posexplode("trace").alias("i", "activity"), "trace", *keep)
        .select(
            "case_id",
            (F.col("i") + 1).cast("bigint").alias("pos"),
            F.when(F.size("trace") > block_rows, block_of(F.col("i") + 1, block_rows)).alias("block"),
            _required(F.col("activity"), "activity").alias("activity"),
            F.get("trace", F.col("i") + 1).alias("next1"),
            F.get("trace", F.col("i") + 2).alias("next2"), *keep)
        .select(*LOG_COLUMNS, *keep))


def build_traces(log: DataFrame, part_rows: int | None = None) -> DataFrame:
    """``case_id, part, trace``: the activities of each case in order, one row (part 0) per case.

    With ``part_rows`` every case is cut into parts of so many activities, the last one shorter; the
    blocks that the log itself is cut into play no part.
    """
    part = F.lit(0).cast("bigint") if part_rows is None else block_of(F.col("pos"), part_rows)
    return (
        log.groupBy("case_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "activity"))).alias("events"))
        .select("case_id", "part", F.col("events.activity").alias("trace")))
