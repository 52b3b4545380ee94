"""Input and output bindings of activities: which neighbours an event is linked to.

An event of activity x is linked to a later event of a successor s when no predecessor of s
(x included) occurs between the two: among the events that are s or precede s in the graph,
the one right after the event of x is s itself. One window per case and s finds this; input
bindings are the mirror image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.bits import MAX_BITS, bit_sql, few_names, from_bits_sql
from tracewell.functions.storage import materialize
from tracewell.operators.graph import adjacency
from tracewell.operators.variants import variants

SUCC, PRED = "SUCC", "PRED"


def output_bindings(log: DataFrame, graph: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``case_id, pos, activity, binding``: the sorted successors each event is linked to."""
    links, decode = _links(log, graph, [SUCC], max_bits)
    return links.selectExpr("case_id", "pos", "activity", decode)


def input_bindings(log: DataFrame, graph: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``case_id, pos, activity, binding``: the sorted predecessors each event is linked to."""
    links, decode = _links(log, graph, [PRED], max_bits)
    return links.selectExpr("case_id", "pos", "activity", decode)


def binding_counts(log: DataFrame, graph: DataFrame, max_bits: int = MAX_BITS, by_variant: bool = False) -> DataFrame:
    """``activity, side, binding, n``: number of cases in which the binding occurs.

    ``by_variant`` looks at each distinct trace once and counts it as often as it occurs.
    """
    number = F.count(F.lit(1))
    if by_variant:
        log, cases = variants(log)
        weights = cases.groupBy(F.col("variant").alias("case_id")).agg(F.count(F.lit(1)).alias("weight"))
        number = F.sum("weight")
    links, decode = _links(log, graph, [SUCC, PRED], max_bits)
    found = links.select("case_id", "activity", "side", "linked").distinct()
    return (
        (found.join(weights, "case_id") if by_variant else found)
        .groupBy("activity", "side", "linked").agg(number.alias("n"))
        .selectExpr("activity", "side", decode, "n"))


def _links(log: DataFrame, graph: DataFrame, sides: list[str], max_bits: int) -> tuple[DataFrame, str]:
    """``case_id, pos, activity, side, linked`` for every event linked to something, and the SQL
    that turns ``linked`` into the column ``binding``.

    With few activities ``linked`` is a set of bits, so that grouping needs no arrays. ``graph``
    is read twice and should be a written table.
    """
    names = few_names(graph.selectExpr("explode(array(src, dst))"), max_bits)
    if names is None:
        code, collect, decode = "s", "array_sort(collect_list(neighbour)) AS linked", "linked AS binding"
    else:
        code, collect = bit_sql(names, "s"), "bit_or(shiftleft(1L, neighbour)) AS linked"
        decode = f"{from_bits_sql(names, 'linked')} AS binding"

    # Every event stands in line for each neighbour on a side, and in its own line if it is
    # anyone's neighbour there. Inputs are looked for backwards.
    def in_line(side: str) -> str:
        near, far, direction = ("successors", "predecessors", 1) if side == SUCC else ("predecessors", "successors", -1)
        return f"""transform(array_union({near}, if(size({far}) > 0, array(activity), array())), s -> named_struct(
            'side', '{side}', 'direction', {direction}, 'neighbour', {code},
            'waits', array_contains({near}, s), 'arrives', s = activity))"""

    # Written, so that its size is known from the start: with a late choice the events might move by activity first.
    roles = materialize(
        adjacency(graph).selectExpr("activity", f"concat({', '.join(map(in_line, sides))}) AS roles"), "roles")
    lines = (
        log.select("case_id", "block", "pos", "activity").join(roles, "activity")
        .selectExpr("case_id", "block", "pos", "activity", "inline(roles)")
        .withColumn("step", F.expr("pos * direction")))
    in_block = Window.partitionBy("case_id", "block", "side", "neighbour").orderBy("step")
    met = (
        lines.withColumn("met", F.lead("arrives").over(in_block))
        .withColumn("n", F.row_number().over(in_block)))

    # In cases cut into blocks, the last in line of a block looks at the first in line of the
    # next block that has any: two rows per block and line are enough for that.
    across = Window.partitionBy("case_id", "side", "neighbour").orderBy("step")
    beyond = (
        met.filter("block IS NOT NULL AND (n = 1 OR met IS NULL)")
        .withColumn("met_beyond", F.lead("arrives").over(across))
        .filter("met IS NULL AND met_beyond AND waits"))

    columns = ["case_id", "pos", "activity", "side", "neighbour"]
    links = (
        met.filter("met AND waits").select(columns).unionByName(beyond.select(columns))
        .groupBy("case_id", "pos", "activity", "side").agg(F.expr(collect)))
    return links, decode

