"""Places of a workflow net, found from a footprint.

A place has input activities A and output activities B: all of A mutually unrelated, all of
B mutually unrelated, every a -> b. Every part of such a pair is such a pair too, so the pairs
are grown one activity at a time: first A in name order, then B in name order. Each pair is
reached in exactly one way and needs no deduplication.

There may be exponentially many such pairs but few maximal ones, which are found without the others:
activities as inputs and activities as outputs are the nodes of a graph that joins what may be in one
place, and the maximal places are its maximal cliques with nodes of both kinds (Bron and Kerbosch's
search with pivots, one level per round, started at nodes in order of falling degree). Only related
pairs of activities are read; what is unrelated is known by absence, among the members of one search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.operators.footprint import relation_sets

# Activities added between two written intermediate results.
STEPS_PER_ROUND = 3


def _loop_free_sets(fp: DataFrame) -> DataFrame:
    loop_free = fp.filter((F.col("a") == F.col("b")) & (F.col("relation") == "#")).select("a")
    return relation_sets(
        fp.join(loop_free, "a", "left_semi")
        .join(loop_free.withColumnRenamed("a", "b"), "b", "left_semi"))


def _grow(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs one activity larger. ``more_in`` and ``more_out`` hold what still fits."""
    def later(candidates: str, chosen: str) -> str:
        return f"filter({candidates}, v -> v > try_element_at({chosen}, -1))"

    def steps(candidates: str, as_input: str) -> str:
        return f"transform({candidates}, v -> named_struct('activity', v, 'as_input', {as_input}))"

    def still(candidates: str, if_input: str, if_output: str) -> str:
        return (f"array_remove(array_intersect({candidates}, if(as_input, {if_input}, {if_output})), activity)"
                f" AS {candidates}")

    return (
        pairs.selectExpr("*", f"""inline(if(size(out_set) = 0,
            concat({steps(later("more_in", "in_set"), "true")}, {steps("more_out", "false")}),
            {steps(later("more_out", "out_set"), "false")}))""")
        .join(sets, "activity")
        .selectExpr(
            "if(as_input, array_append(in_set, activity), in_set) AS in_set",
            "if(as_input, out_set, array_append(out_set, activity)) AS out_set",
            still("more_in", "unrelated", "preceders"),
            still("more_out", "followers", "unrelated"))
        .filter("size(out_set) > 0 OR size(more_out) > 0"))


def _written_sets(fp: DataFrame) -> DataFrame:
    return materialize(_loop_free_sets(fp), "relation-sets")


def _all_pairs(sets: DataFrame) -> DataFrame:
    """All possible places, with what still fits."""
    seeds = sets.filter("size(followers) > 0").selectExpr(
        "array(activity) AS in_set", "cast(array() AS array<string>) AS out_set",
        "array_remove(unrelated, activity) AS more_in", "followers AS more_out")
    batches, last = [seeds], seeds
    while not last.filter("size(more_in) + size(more_out) > 0").isEmpty():
        grown = []
        for step in range(STEPS_PER_ROUND):
            last = _grow(last, sets)
            grown.append(last.withColumn("step", F.lit(step)))
        # Rebalancing spreads the offspring of prolific pairs over all tasks.
        batch = materialize(reduce(DataFrame.unionByName, grown).hint("rebalance"), "places")
        batches.append(batch.drop("step"))
        last = batch.filter(F.col("step") == STEPS_PER_ROUND - 1).drop("step")
    return reduce(DataFrame.unionByName, batches).filter("size(out_set) > 0")


def place_candidates(fp: DataFrame) -> DataFrame:
    """``in_set, out_set``: every possible place, maximal or not."""
    return _all_pairs(_written_sets(fp)).select("in_set", "out_set")


def maximal_places(fp: DataFrame) -> DataFrame:
    """``place, in_set, out_set``: the possible places to which no activity can be added.

    ``fp`` may leave out its cells with ``#``, as related_cells() does.
    """
    return with_place_name(_maximal_cliques(fp.filter("relation <> '#'")))


# Sets of members of a search are arrays of 64-bit words; member i is bit i % 64 of word i div 64.


def _any(words: str) -> str:
    return f"exists({words}, p -> p <> 0)"


def _wordwise(x: str, y: str, operation: str) -> str:
    return f"zip_with({x}, {y}, (p, q) -> {operation})"


def _size(words: str) -> str:
    return f"aggregate({words}, 0, (s, p) -> s + bit_count(p))"


def _indexes(words: str) -> str:
    return f"""flatten(transform({words}, (p, w) -> if(p = 0, cast(array() AS array<int>),
        transform(filter(sequence(0, 63), k -> p & shiftleft(1L, k) <> 0), k -> w * 64 + k))))"""


def _words(indexes: str, like: str) -> str:
    return f"""transform({like}, (p, w) -> aggregate(filter({indexes}, i -> i div 64 = w), 0L,
        (m, i) -> m | shiftleft(1L, i % 64)))"""


def _range_word(low: str, high: str, word: str) -> str:
    """The bits from ``low`` up to ``high`` that are in the word of that number."""
    def below(x: str) -> str:
        return f"""CASE WHEN {x} <= 64 * {word} THEN 0L WHEN {x} >= 64 * {word} + 64 THEN -1L
            ELSE shiftleft(1L, {x} - 64 * {word}) - 1L END"""

    return f"(({below(high)}) & ~({below(low)}))"


def _searches(cells: DataFrame) -> DataFrame:
    """``seed, is_output, i, as_output, activity, open``: one search for each node that may be the first of a place.

    Nodes come in order of falling degree, the degree of an input being the number of its followers and that of an
    output the number of its preceders. A place whose first node is the seed holds a later neighbour of the other
    kind, so only neighbours of these can be with it. The lengths of all ways from seeds over later neighbours
    add up to no more than the arcs times twice the arboricity of the graph of followers.
    """
    arcs = cells.filter("relation = '->'").selectExpr(
        "stack(2, false, a, b, true, b, a) AS (as_output, activity, other)")
    degrees = arcs.groupBy("as_output", "activity").agg(F.count("*").alias("degree"))
    arcs = materialize(
        arcs.join(degrees, ["as_output", "activity"]).join(
            degrees.selectExpr("NOT as_output AS as_output", "activity AS other", "degree AS other_degree"),
            ["as_output", "other"])
        .withColumn("later", F.expr(
            "struct(other_degree, NOT as_output, other) < struct(degree, as_output, activity)")), "place-arcs")
    starts = arcs.filter("later")
    seeds = starts.select("as_output", "activity").distinct()
    opposite = arcs.join(seeds, ["as_output", "activity"], "left_semi").selectExpr(
        "as_output AS is_output", "activity AS seed", "NOT as_output AS as_output", "other AS activity",
        "later AS open")
    same = (
        starts.selectExpr("as_output AS is_output", "activity AS seed", "degree", "NOT as_output AS as_output",
                          "other AS activity")
        .join(arcs.selectExpr("as_output", "activity", "other AS member", "other_degree"), ["as_output", "activity"])
        .filter("member <> seed")
        .selectExpr("is_output", "seed", "is_output AS as_output", "member AS activity",
                    "struct(other_degree, member) < struct(degree, seed) AS open").distinct()
        .join(cells.selectExpr("a AS seed", "b AS activity"), ["seed", "activity"], "left_anti"))
    return (
        opposite.unionByName(same)
        .groupBy("seed", "is_output").agg(
            F.array_sort(F.collect_list(F.struct("as_output", "activity", "open"))).alias("members"))
        .selectExpr("seed", "is_output", "cast(size(members) AS int) AS n",
                    "cast(size(filter(members, m -> NOT m.as_output)) AS int) AS inputs",
                    "posexplode(members) AS (i, member)")
        .selectExpr("seed", "is_output", "n", "inputs", "i", "member.*"))


def _neighbours(members: DataFrame, cells: DataFrame) -> DataFrame:
    """``seed, is_output, i, near``: the members of its search that each member may share a place with."""
    search = ["seed", "is_output"]
    # Members of one kind go together unless related, those of both kinds only if one follows the other. So the
    # related ones are the exceptions: their bits differ from those of a table that knows nothing but the kinds.
    exceptions = (
        members.selectExpr(*search, "i", "as_output", "activity AS a").join(cells, "a")
        .join(members.selectExpr(*search, "i AS j", "as_output AS to_output", "activity AS b"), [*search, "b"])
        .filter("as_output = to_output OR relation = if(as_output, '<-', '->')")
        .select(*search, "i", "j")
        .unionByName(members.selectExpr(*search, "i", "i AS j")))
    bits = (
        exceptions.selectExpr(*search, "i", "cast(j div 64 AS int) AS word", "shiftleft(1L, j % 64) AS bit")
        .groupBy(*search, "i", "word").agg(F.bit_or("bit").alias("bits"))
        .groupBy(*search, "i").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("differ")))
    kind = _range_word("if(as_output, inputs, 0)", "if(as_output, n, inputs)", "w")
    return members.join(bits, [*search, "i"]).selectExpr(*search, "i", f"""transform(
        sequence(0, cast((n - 1) div 64 AS int)), w -> {kind} ^ coalesce(differ[w], 0L)) AS near""")


def _maximal_cliques(related: DataFrame) -> DataFrame:
    loops = related.filter("a = b").select("a").distinct()
    cells = materialize(
        related.join(loops, "a", "left_anti").join(loops.withColumnRenamed("a", "b"), "b", "left_anti")
        .select("a", "b", "relation"), "related-cells")
    members = materialize(_searches(cells), "place-members")
    near = materialize(_neighbours(members, cells), "place-neighbours")
    search = ["seed", "is_output", "n", "inputs"]
    # chosen: a clique; open: members near all of it, to be tried; tried: members tried elsewhere, near all of it
    # except perhaps the last ones chosen.
    state = [*search, "chosen", "open", "tried"]
    states = (
        members.withColumn("bit", F.expr("shiftleft(1L, i % 64)"))
        .groupBy(*search, F.expr("i div 64").alias("word")).agg(
            F.bit_or(F.expr("if(open, bit, 0L)")).alias("open"), F.bit_or(F.expr("if(open, 0L, bit)")).alias("tried"))
        .groupBy(*search).agg(F.array_sort(F.collect_list(F.struct("word", "open", "tried"))).alias("words"))
        .selectExpr(*search, "transform(words, w -> 0L) AS chosen", "words.open AS open", "words.tried AS tried"))
    other_kind = _range_word("if(is_output, 0, inputs)", "if(is_output, inputs, n)", "w")
    promising = f"exists(transform(chosen, (p, w) -> (p | open[w]) & {other_kind}), p -> p <> 0)"
    found = []
    while not states.isEmpty():
        rows = (
            states.withColumn("i", F.expr(f"explode({_indexes(_wordwise('open', 'tried', 'p | q'))})"))
            .join(near, ["seed", "is_output", "i"])
            .withColumn("is_open", F.expr("open[cast(i div 64 AS int)] & shiftleft(1L, i % 64) <> 0"))
            .withColumn("reach", F.expr(_size(_wordwise("open", "near", "p & q"))))
            .filter(f"is_open OR NOT {_any(_wordwise('chosen', 'near', 'p & ~q'))}"))
        seen = (
            states.join(rows.groupBy(*state).agg(
                # A member tried elsewhere and near all open ones is near every clique from here.
                F.expr(f"bool_or(NOT is_open AND reach = {_size('open')}) AS dead"),
                # Open members near all other open ones are in every clique from here.
                F.expr(f"collect_list(i) FILTER (WHERE is_open AND reach = {_size('open')} - 1) AS sure"),
                F.expr("collect_list(i) FILTER (WHERE NOT is_open) AS still_tried"),
                # Some member of a maximal clique is the pivot or not near it.
                F.expr("max_by(near, reach) AS pivot")), state, "left")
            .filter("NOT coalesce(dead, false)"))
        ended = f"NOT {_any('open')}"
        done = seen.filter(ended).selectExpr(
            *search, "chosen", "open", "transform(tried, p -> 0L) AS tried")
        taken = seen.filter(f"NOT ({ended}) AND size(sure) > 0").withColumn("more", F.expr(_words("sure", "open"))).selectExpr(
            *search, f"{_wordwise('chosen', 'more', 'p | q')} AS chosen", f"{_wordwise('open', 'more', 'p & ~q')} AS open",
            f"{_words('still_tried', 'open')} AS tried")
        branches = (
            seen.filter(f"NOT ({ended}) AND size(sure) = 0")
            .withColumn("tried", F.expr(_words("still_tried", "open")))
            .withColumn("branch", F.expr(_indexes(_wordwise("open", "pivot", "p & ~q"))))
            .selectExpr(*state, "branch", "posexplode(branch) AS (k, i)")
            .withColumn("earlier", F.expr(_words("slice(branch, 1, k)", "open")))
            .join(near, ["seed", "is_output", "i"])
            .selectExpr(
                *search, f"{_wordwise('chosen', _words('array(i)', 'open'), 'p | q')} AS chosen",
                f"zip_with({_wordwise('open', 'earlier', 'p & ~q')}, near, (p, q) -> p & q) AS open",
                f"zip_with({_wordwise('tried', 'earlier', 'p | q')}, near, (p, q) -> p & q) AS tried")
            .filter(f"{_any('open')} OR NOT {_any('tried')}"))
        after = materialize(
            done.unionByName(taken).unionByName(branches).filter(promising).hint("rebalance"), "cliques")
        ended = f"NOT {_any('open')} AND NOT {_any('tried')}"
        found.append(after.filter(ended))
        states = after.filter(f"NOT ({ended})")

    if not found:
        return members.selectExpr("array(seed) AS in_set", "array(seed) AS out_set").limit(0)
    cliques = reduce(DataFrame.unionByName, found)
    chosen = cliques.withColumn("i", F.expr(f"explode({_indexes('chosen')})")).join(
        members.select("seed", "is_output", "i", "as_output", "activity"), ["seed", "is_output", "i"])

    def side(is_output: str, of_kind: str) -> str:
        return f"""array_sort(concat(if({is_output}, array(seed), cast(array() AS array<string>)),
            collect_list(activity) FILTER (WHERE {of_kind})))"""

    return chosen.groupBy("seed", "is_output", "chosen").agg(
        F.expr(f"{side('NOT is_output', 'NOT as_output')} AS in_set"),
        F.expr(f"{side('is_output', 'as_output')} AS out_set")).select("in_set", "out_set")


def with_place_name(places: DataFrame) -> DataFrame:
    """Name each place ``p(inputs|outputs)`` after its sorted sets.

    Different places have different names: commas, bars and backslashes in names of activities are
    written with a backslash before them. No such name is that of the source or the sink.
    """
    def joined(names: str):
        return F.array_join(F.transform(names, lambda v: F.regexp_replace(
            v, F.lit("([,|\\\\])"), F.lit("\\\\$1"))), ",")

    name = F.concat(F.lit("p("), joined("in_set"), F.lit("|"), joined("out_set"), F.lit(")"))
    return places.select(name.alias("place"), "in_set", "out_set")
