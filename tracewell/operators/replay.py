"""Token replay of cases on a workflow net.

A case starts with one token in the source. An event whose input places all hold a token takes
those tokens and puts one in each output place; an event that lacks a token does not fire. A
case is rejected by an unknown activity or by any event after the sink got its token, and
accepted if it ends with exactly one token, in the sink.

A whole case is replayed by one fold over its events. Of a case cut into blocks:

- where an event that lacks a token rejects its case, a block asks for some tokens, takes some and
  puts some, and so do several blocks in a row;
- where it is skipped, the net is first unfolded into its reachable markings; each block, on its
  own, becomes a table that says which marking it turns every marking into, and these tables are
  chained in a tree;
- where there are too many markings, all blocks are replayed at once from guesses, then from the
  markings that guesses led to at the end of the block before, until the case can be followed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bits import MAX_BITS, few_names, to_bits_sql
from tracewell.functions.storage import append, materialize, new_path
from tracewell.operators.net import SINK, SOURCE
from tracewell.operators.variants import variants

# Beyond so many reachable markings long cases are replayed from the markings that arrive at their blocks.
MAX_MARKINGS = 4096
# Blocks chained per step of the tree.
FAN_IN = 1024
# Events after which a block first merges markings that have become the same.
FIRST_MERGE = 64


def trace_conformance(log: DataFrame, pre_post: DataFrame, on_disabled: str = "skip",
                      max_markings: int = MAX_MARKINGS, max_bits: int = MAX_BITS,
                      has_long: bool | None = None, by_variant: bool = False) -> DataFrame:
    """``case_id, accepted``. ``pre_post`` is the table of ``pre_post_places``; an event that
    cannot fire is skipped, or with ``on_disabled="reject"`` rejects its case. ``has_long`` says
    whether the log has cases cut into blocks; if unknown, the log is asked. ``by_variant`` replays
    each distinct trace once, in the blocks that its smallest case has in ``log``."""
    if by_variant:
        distinct, cases = variants(log)
        verdicts = trace_conformance(distinct, pre_post, on_disabled, max_markings, max_bits, has_long)
        return cases.join(verdicts.withColumnRenamed("case_id", "variant"), "variant").select("case_id", "accepted")
    if on_disabled not in ("skip", "reject"):
        raise ValueError(f"on_disabled must be 'skip' or 'reject', not {on_disabled!r}")
    pre_post = materialize(pre_post, "pre-post")
    rules = _rules(pre_post, on_disabled, max_bits)
    long = log.filter("block IS NOT NULL")
    whole = rules.verdict(
        rules.block_events(log.filter("block IS NULL"))
        .selectExpr("case_id", f"{rules.after(rules.start)} AS state"))
    if not (has_long if has_long is not None else not long.isEmpty()):
        return whole
    if on_disabled == "reject":
        return whole.unionByName(_replay_by_tokens(long, rules))
    steps = _unfold(pre_post, on_disabled, max_markings)
    if steps is None:
        return whole.unionByName(_replay_from_arrivals(long, rules))
    return whole.unionByName(_replay_in_parallel(long, steps))


def log_fitness(conformance: DataFrame) -> DataFrame:
    """One row ``accepted, cases, fitness``."""
    return conformance.selectExpr("count_if(accepted) AS accepted", "count(1) AS cases").selectExpr(
        "accepted", "cases", "try_divide(accepted, cases) AS fitness")


@dataclass(frozen=True)
class _Rules:
    """How a marking changes: ``net`` has the input and output places of each activity as
    ``pre`` and ``post``, the texts are SQL. A rejected case has the state ``dead``. ``full`` is the
    marking of all places but the source and the sink; ``plus`` and ``minus`` are operations on sets of
    places, ``meets`` and ``within`` say whether one shares a place with, or lies in, another."""

    net: DataFrame
    start: str
    final: str
    dead: str
    full: Column
    nothing: str
    plus: Callable[[str, str], str]
    minus: Callable[[str, str], str]
    meets: Callable[[str, str], str]
    within: Callable[[str, str], str]
    sink: str
    is_closed: str
    is_enabled: str
    fire: str
    stuck: str

    def block_events(self, log: DataFrame) -> DataFrame:
        """Events per case and block in order, each with its places; null places if unknown."""
        return (
            log.join(self.net, "activity", "left").groupBy("case_id", "block")
            .agg(F.expr("sort_array(collect_list(struct(pos, pre, post))) AS events")))

    def after(self, state: str) -> str:
        """The state after the events of a block."""
        return f"""aggregate(events, {state}, (s, e) -> CASE
            WHEN e.pre IS NULL OR {self.is_closed} THEN {self.dead}
            WHEN {self.is_enabled} THEN {self.fire} ELSE {self.stuck} END)"""

    def verdict(self, states: DataFrame) -> DataFrame:
        return states.selectExpr("case_id", f"coalesce(state = {self.final}, false) AS accepted")


def _rules(pre_post: DataFrame, on_disabled: str, max_bits: int) -> _Rules:
    places = few_names(
        pre_post.selectExpr("explode(array_union(pre, post)) AS place")
        .filter(~F.col("place").isin(SOURCE, SINK)), max_bits - 2)
    if places is None:
        dead = "cast(NULL AS array<string>)"
        return _Rules(
            pre_post, start=f"array('{SOURCE}')", final=f"array('{SINK}')", dead=dead,
            full=pre_post.selectExpr("explode(array_union(pre, post)) AS place")
            .filter(~F.col("place").isin(SOURCE, SINK))
            .agg(F.array_sort(F.collect_set("place"))).scalar(),
            nothing="cast(array() AS array<string>)", plus="array_union({}, {})".format,
            minus="array_except({}, {})".format, meets="arrays_overlap({}, {})".format,
            within="(size(array_except({}, {})) = 0)".format, sink=f"array('{SINK}')",
            is_closed=f"s IS NULL OR array_contains(s, '{SINK}')",
            is_enabled="size(array_except(e.pre, s)) = 0",
            fire="array_union(array_except(s, e.pre), e.post)",
            stuck="s" if on_disabled == "skip" else dead)
    # The source is bit 0, the sink bit 1, and a rejected case -1.
    places = [SOURCE, SINK, *places]
    net = pre_post.selectExpr(
        "activity", f"{to_bits_sql(places, 'pre')} AS pre", f"{to_bits_sql(places, 'post')} AS post")
    return _Rules(
        net, start="1L", final="2L", dead="-1L", full=F.lit((1 << len(places)) - 4).cast("long"),
        nothing="0L", plus="({} | {})".format, minus="({} & ~{})".format, meets="({} & {} <> 0)".format,
        within="({0} & {1} = {0})".format, sink="2L", is_closed="s < 0 OR s & 2L = 2L",
        is_enabled="s & e.pre = e.pre", fire="(s & ~e.pre) | e.post", stuck="s" if on_disabled == "skip" else "-1L")


def _replay_by_tokens(long: DataFrame, rules: _Rules) -> DataFrame:
    """For cases that end with the first event that lacks a token; any net, one row per block after one fold over it.

    Events all of which fire ask for the tokens that none of them has put before, clear all they take, and put what
    none of them takes after. They cannot all fire if one lacks a token that an earlier one took, or follows the sink's.
    """
    plus, minus = rules.plus, rules.minus
    asked = minus("e.pre", "x.put")
    effect = f"""aggregate(events, named_struct('need', {rules.nothing}, 'clear', {rules.nothing}, 'put', {rules.nothing}),
        (x, e) -> CASE
            WHEN x IS NULL OR e.pre IS NULL OR {rules.meets("x.put", rules.sink)} OR {rules.meets(asked, "x.clear")}
            THEN NULL
            ELSE named_struct('need', {plus("x.need", asked)}, 'clear', {plus("x.clear", "e.pre")},
                'put', {plus(minus("x.put", "e.pre"), "e.post")}) END)"""
    blocks = rules.block_events(long).selectExpr("case_id", "block", f"{effect} AS effect")
    after = f"""aggregate(blocks, {rules.start}, (s, b) -> CASE
        WHEN {rules.is_closed} OR b.effect IS NULL OR NOT {rules.within("b.effect.need", "s")} THEN {rules.dead}
        ELSE {plus(minus("s", "b.effect.clear"), "b.effect.put")} END)"""
    return rules.verdict(
        blocks.groupBy("case_id").agg(F.expr("sort_array(collect_list(struct(block, effect))) AS blocks"))
        .selectExpr("case_id", f"{after} AS state"))


def _replay_from_arrivals(long: DataFrame, rules: _Rules) -> DataFrame:
    """For nets with any number of markings.

    All blocks are replayed from the marking of all places and from the source alone; in each round, then, from the
    markings that the block before is known to end with. After r rounds a block has seen the r blocks before it, and
    most blocks end alike from most markings: so a case can soon be followed from its start over what is known. A
    round adds no more than two markings a block. Cases that a logarithm of the number of blocks and two rounds leave
    open are replayed on block after block, so that the work stays that of a few replays for each doubling.
    """
    blocks = materialize(rules.block_events(long), "block-events")
    last = int(blocks.agg(F.max("block")).first()[0])
    in_order = (lambda state: state) if rules.dead == "-1L" else "array_sort({})".format
    alive = f"NOT (state <=> {rules.dead})"

    def replayed(arrivals: DataFrame) -> DataFrame:
        return arrivals.selectExpr("case_id", "block", "arrives", f"{in_order(rules.after('arrives'))} AS state")

    guesses = F.array(F.expr(rules.start), rules.full)
    known = materialize(replayed(blocks.withColumn("arrives", F.explode(
        F.when(F.col("block") == 0, F.slice(guesses, 1, 1)).otherwise(F.array_distinct(guesses))))), "arrivals")
    # Entries come by block; one of the next block that starts where the case stands takes it on.
    follow = f"""aggregate(entries, named_struct('next', 0L, 'state', {rules.start}), (x, e) ->
        if(e.block = x.next AND e.arrives = x.state, named_struct('next', x.next + 1, 'state', e.state), x))"""
    for left in reversed(range(last.bit_length() + 3)):
        cases = materialize(
            known.groupBy("case_id").agg(
                F.max("block").alias("last"), F.expr("sort_array(collect_list(struct(block, arrives, state))) AS entries"))
            .selectExpr("case_id", "last", f"inline(array({follow}))")
            .selectExpr("case_id", "next", "state", f"next <= last AND {alive} AS open"), "followed")
        unfinished = cases.filter("open")
        if not left or unfinished.isEmpty():
            break
        keys = ["case_id", "block", "arrives"]
        new = (
            known.filter(alive).join(unfinished.select("case_id"), "case_id", "left_semi")
            .selectExpr("case_id", "block + 1 AS block", "state AS arrives").distinct().join(known, keys, "left_anti"))
        known = known.unionByName(materialize(replayed(blocks.join(new, ["case_id", "block"])), "arrivals"))

    first = unfinished.agg(F.min("next")).first()[0]
    if first is None:
        return rules.verdict(cases)
    states, rest = unfinished, materialize(
        blocks.join(unfinished.select("case_id", "next"), "case_id").filter("block >= next").select("case_id", "block", "events"),
        "open-blocks", partition_by="block")
    for block in range(first, last + 1):
        states = materialize(
            states.join(rest.filter(F.col("block") == block).select("case_id", "events"), "case_id", "left")
            .selectExpr("case_id", f"if(events IS NULL, state, {rules.after('state')}) AS state"), "replay-states")
    return rules.verdict(cases.filter("NOT open").select("case_id", "state").unionByName(states.select("case_id", "state")))


def _fire(marking: Column, pre: Column, post: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(marking, pre), post))


def _unfold(pre_post: DataFrame, on_disabled: str, max_markings: int) -> DataFrame | None:
    """``moves, start, final``: the net as a table over its markings, in one row.

    ``moves[activity][i]`` is the marking that the activity turns marking i into; 0 stands for
    a rejected case. None if more than ``max_markings`` markings are reachable.
    """
    spark = pre_post.sparkSession
    needs = pre_post.select("activity", F.explode("pre").alias("place"))
    # (marking, activity, next) for every activity that can fire, breadth first. What is known is only added to: a level
    # and its moves are written once, and the next one starts from that level alone.
    level = spark.createDataFrame([([SOURCE],)], "marking array<string>")
    markings, changes = new_path(spark, "markings"), new_path(spark, "moves")
    seen, count = append(level, markings), 1
    free = pre_post.filter(F.size("pre") == 0)
    fired = None
    while not level.isEmpty():
        open_markings = level.filter(~F.array_contains("marking", SINK))
        met = (
            open_markings.select("marking", F.explode("marking").alias("place")).join(needs, "place")
            .groupBy("marking", "activity").agg(F.count(F.lit(1)).alias("met"))
            .join(pre_post, "activity").filter(F.col("met") == F.size("pre")))
        always = open_markings.withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one")
        moves = materialize(
            met.select("marking", "activity", "pre", "post")
            .unionByName(always.select("marking", "activity", "pre", "post"))
            .select("marking", "activity", _fire(F.col("marking"), F.col("pre"), F.col("post")).alias("next")),
            "level-moves")
        fired = append(moves, changes)
        level = materialize(
            moves.select(F.col("next").alias("marking")).distinct().join(seen, "marking", "left_anti"), "level")
        count += level.count()
        if count > max_markings:
            return None
        seen = append(level, markings)

    numbered = seen.agg(F.array_sort(F.collect_list("marking")).alias("markings")).select(
        F.posexplode("markings").alias("i", "marking")).select(
        (F.col("i") + 1).alias("id"), "marking")
    numbered = materialize(numbered, "numbered-markings")
    size = count
    ids = numbered.toDF("next_id", "next")
    changes = (
        fired.join(numbered, "marking").join(ids, "next")
        .groupBy("activity").agg(F.map_from_entries(F.collect_list(F.struct("id", "next_id"))).alias("to")))
    closed = numbered.agg(F.collect_set(F.when(F.array_contains("marking", SINK), F.col("id"))).alias("closed"))
    stay = (lambda i: i) if on_disabled == "skip" else (lambda i: F.lit(0))
    tables = (
        pre_post.select("activity").join(changes, "activity", "left")
        .select("activity", "to", closed.scalar().alias("closed"))
        .select("activity", F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.when(
            (i == 0) | F.array_contains("closed", i), F.lit(0)).otherwise(
            F.coalesce(F.try_element_at("to", i), stay(i)))).alias("to")))

    def id_of(place: str) -> Column:
        return F.max(F.when(F.col("marking") == F.array(F.lit(place)), F.col("id")))

    ends = numbered.agg(id_of(SOURCE).alias("start"), id_of(SINK).alias("final"), F.max("id").alias("size"))
    return materialize(
        tables.agg(F.array_sort(F.collect_list(F.struct("activity", "to"))).alias("tables"))
        .select(F.col("tables.activity").alias("activities"), F.col("tables.to").alias("moves"),
                ends.select(F.struct("*")).scalar().alias("ends"))
        .select("activities", "moves", "ends.*"),
        "unfolded-net")


def _then(first: Column, second: Column) -> Column:
    return F.transform(first, lambda i: F.get(second, i))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _block_effect(events: Column, moves: Column, size: Column) -> Column:
    """What a block turns every marking into. ``events`` are activities by number, null if unknown.

    Markings that have come to the same one stay together, so only the images of classes of them are moved on: an event
    costs as many steps as there are different images. Classes are merged after 64 events and then whenever the events
    so far have doubled.
    """
    number = F.size(events)
    # Segments [0, 64), [64, 128), [128, 256) and so on, as (begin, length).
    doublings = F.greatest(F.ceil(F.log2(F.greatest(number, F.lit(1)) / FIRST_MERGE)), F.lit(0)).cast("int")
    whole = (lambda s: F.call_function("shiftleft", F.lit(FIRST_MERGE // 2), s))
    segments = F.transform(F.sequence(F.lit(0), doublings), lambda s: F.struct(
        F.when(s == 0, F.lit(0)).otherwise(whole(s)).alias("before"), F.greatest(whole(s), F.lit(FIRST_MERGE)).alias("length")))

    def moved(images: Column, segment: Column) -> Column:
        return F.aggregate(F.slice(events, segment["before"] + 1, segment["length"]), images, lambda now, k: F.when(
            k.isNull(), F.transform(now, lambda i: F.lit(0))).otherwise(_then(now, F.get(moves, k))))

    def merged(classes: Column, images: Column) -> Column:
        return _let(F.array_distinct(images), lambda distinct: _let(
            F.transform(images, lambda i: (F.array_position(distinct, i) - 1).cast("int")), lambda place: F.struct(
                _then(classes, place).alias("classes"), distinct.alias("images"))))

    every = F.sequence(F.lit(0), size)
    last = F.aggregate(segments, F.struct(every.alias("classes"), every.alias("images")), lambda state, segment: _let(
        moved(state["images"], segment), lambda images: merged(state["classes"], images)))
    return _let(last, lambda state: _then(state["classes"], state["images"]))


def _replay_in_parallel(long: DataFrame, net: DataFrame) -> DataFrame:
    index = net.select(F.posexplode("activities").alias("k", "activity"))
    effects = (
        long.select("case_id", "block", "pos", "activity").join(index, "activity", "left")
        .groupBy("case_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("events"))
        .select("case_id", "block", F.col("events.k").alias("events"),
                net.select(F.struct("moves", "size")).scalar().alias("net"))
        .select("case_id", "block", "events", "net.*")
        .select("case_id", "block", _block_effect(F.col("events"), F.col("moves"), F.col("size")).alias("effect")))
    # Three steps of FAN_IN chain a billion blocks; the fourth is the whole case.
    for width in (FAN_IN, FAN_IN ** 2, FAN_IN ** 3, None):
        group = F.lit(0) if width is None else F.col("block") - F.col("block") % F.lit(width)
        effects = (
            effects.groupBy("case_id", group.cast("bigint").alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("block", "effect"))).alias("parts"))
            .select("case_id", "block", F.col("parts.effect").alias("parts"))
            .select("case_id", "block", F.aggregate(
                F.slice("parts", 2, F.size("parts")), F.col("parts")[0], _then).alias("effect")))
    return (
        effects.select("case_id", "effect", net.select(F.struct("start", "final")).scalar().alias("net"))
        .select("case_id", F.coalesce(
            F.get("effect", F.col("net.start")) == F.col("net.final"), F.lit(False)).alias("accepted")))
