"""Random short logs against brute force, whole and cut into tiny blocks, from tables and arrays."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from tracewell.operators.bindings import binding_counts, input_bindings, output_bindings
from tracewell.operators.counts import dependency_counts
from tracewell.operators.footprint import follow_flags, footprint
from tracewell.operators.net import connect_source_sink, pre_post_places
from tracewell.operators.places import maximal_places, place_candidates
from tracewell.operators.profile import activity_alphabet, end_activities, start_activities
from tracewell.operators.replay import trace_conformance
from tracewell.sources.logs import build_traces, log_from_table, traces_to_events


def random_traces(seed, cases=60, longest=9, letters="abcde"):
    rng = random.Random(seed)
    traces = {f"c{i:03}": [rng.choice(letters) for _ in range(rng.randint(1, longest))] for i in range(cases)}
    # One case with a third of all events.
    traces["hot"] = [rng.choice(letters) for _ in range(sum(map(len, traces.values())) // 2)]
    return traces


def as_log(spark, traces, block_rows, kind):
    if kind == "arrays":
        return traces_to_events(
            spark.createDataFrame(list(traces.items()), "c string, t array<string>"), "c", "t", block_rows)
    rows = [(c, p * 3, p % 2, a) for c, t in traces.items() for p, a in enumerate(t)]
    random.Random(0).shuffle(rows)
    table = spark.createDataFrame(rows, "c string, p long, q long, a string").repartition(3)
    return log_from_table(table, "c", [F.col("p").cast("timestamp"), "q"], "a", block_rows)


LOGS = [(1, 1 << 18, "table"), (2, 4, "arrays"), (3, 4, "table"), (4, 2, "table")]


@pytest.fixture(scope="module", params=LOGS, ids=lambda p: f"seed{p[0]}-block{p[1]}-{p[2]}")
def case(request, spark):
    seed, block_rows, kind = request.param
    traces = random_traces(seed)
    return traces, as_log(spark, traces, block_rows, kind).cache(), block_rows


def test_log(case):
    traces, log, block_rows = case
    got = {}
    for r in log.collect():
        got[r.case_id, r.pos] = r
    assert len(got) == sum(map(len, traces.values()))
    for c, t in traces.items():
        for i, a in enumerate(t):
            r = got[c, i + 1]
            after = t[i + 1:] + [None, None]
            assert (r.activity, r.next1, r.next2) == (a, after[0], after[1])
            assert r.block == (i // block_rows if len(t) > block_rows else None)


def test_build_traces(case):
    traces, log, block_rows = case
    rows = build_traces(log).collect()
    assert {(r.case_id, r.part): r.trace for r in rows} == {(c, 0): t for c, t in traces.items()}
    parts = {(r.case_id, r.part): r.trace for r in build_traces(log, part_rows=4).collect()}
    assert parts == {(c, i // 4): t[i:i + 4] for c, t in traces.items() for i in range(0, len(t), 4)}


def test_profile(case):
    traces, log, _ = case
    assert {r[0] for r in start_activities(log).collect()} == {t[0] for t in traces.values()}
    assert {r[0] for r in end_activities(log).collect()} == {t[-1] for t in traces.values()}


@pytest.mark.parametrize("counting", ["last_wins", "presence"])
def test_counts(case, counting):
    traces, log, _ = case
    got = {(r.rel, r.a, r.b): (r.c1, r.c2) for r in dependency_counts(log, counting).collect()}
    assert got == brute.counts(traces.values(), counting)


@pytest.mark.parametrize("counting", ["last_wins", "presence"])
def test_flags_and_footprint(case, counting):
    traces, log, _ = case
    flags = {(r.a, r.b): (r.forward, r.backward) for r in follow_flags(log, counting).collect()}
    assert flags == {k: (f > 0, b > 0) for k, (f, b) in brute.follow_flags(traces.values(), counting).items()}
    names, rel = brute.relations(list(traces.values()), counting)
    assert {(r.a, r.b): r.relation for r in footprint(log, counting).collect()} == rel


@pytest.mark.parametrize("max_bits", [63, 2])
def test_bindings(case, spark, max_bits):
    traces, log, _ = case
    rng = random.Random(len(traces["hot"]))
    edges = sorted({(rng.choice("abcde"), rng.choice("abcdef")) for _ in range(9)})
    graph = spark.createDataFrame(edges, "src string, dst string")
    outputs, inputs = output_bindings(log, graph, max_bits), input_bindings(log, graph, max_bits)
    expected = brute.bindings(traces, edges)
    got = {}
    for side, rows in (("SUCC", outputs), ("PRED", inputs)):
        for r in rows.collect():
            got[r.case_id, r.pos, side, r.activity] = set(r.binding)
            assert r.binding == sorted(set(r.binding))
    assert got == expected
    tallies = {}
    for c, side, a, s in {(c, side, a, tuple(sorted(s))) for (c, _, side, a), s in expected.items()}:
        tallies[a, side, s] = tallies.get((a, side, s), 0) + 1
    assert {(r.activity, r.side, tuple(r.binding)): r.n
            for r in binding_counts(log, graph, max_bits).collect()} == tallies


def staged(seed, cases=40):
    """Traces that mostly move through layers, so that the net has places with choices."""
    rng = random.Random(seed)
    traces = {}
    for i in range(cases):
        t = [rng.choice("ab")]
        t += rng.choice([["c", "d"], ["d", "c"], ["e"]])
        t += [rng.choice("fg")]
        if rng.random() < 0.3:
            t += ["h"] * rng.randint(1, 2)
        t += ["z"]
        traces[f"c{i:03}"] = t
    return traces


@pytest.mark.parametrize("seed,block_rows,max_markings,max_bits", [
    (1, 1 << 18, 4096, 63), (2, 2, 4096, 63), (3, 3, 1, 3)])
@pytest.mark.parametrize("on_disabled", ["skip", "reject"])
def test_places_and_replay(spark, seed, block_rows, max_markings, max_bits, on_disabled):
    traces = staged(seed)
    learn = as_log(spark, traces, 1 << 18, "arrays")
    fp = footprint(learn).cache()
    pairs = brute.candidates(list(traces.values()))
    found = [(tuple(r.in_set), tuple(r.out_set)) for r in place_candidates(fp).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    places = maximal_places(fp).cache()
    sets = {r.place: (tuple(r.in_set), tuple(r.out_set)) for r in places.collect()} | {"In": "In", "Out": "Out"}
    assert sorted(v for v in sets.values() if isinstance(v, tuple)) == sorted(brute.maximal(pairs))

    pre_post = pre_post_places(activity_alphabet(learn), connect_source_sink(places, learn)).cache()
    net = brute.net_of(list(traces.values()))
    assert {r.activity: ({sets[p] for p in r.pre}, {sets[p] for p in r.post}) for r in pre_post.collect()} == net

    rng = random.Random(seed)
    for i in range(40):
        t = list(rng.choice(list(traces.values())))
        for _ in range(rng.randint(0, 2)):
            t.insert(rng.randint(0, len(t)), rng.choice("abcdefghz?"))
        traces[f"x{i:03}"] = t
    log = as_log(spark, traces, block_rows, "table")
    got = {r.case_id: r.accepted
           for r in trace_conformance(log, pre_post, on_disabled, max_markings, max_bits).collect()}
    expected = {c: brute.accepts(t, net, on_disabled) for c, t in traces.items()}
    assert got == expected
    assert any(expected.values()) and not all(expected.values())


@pytest.mark.parametrize("on_disabled,max_bits", [("skip", 63), ("reject", 63), ("reject", 3)])
def test_a_thousand_blocks_of_a_net_with_too_many_markings(spark, on_disabled, max_bits):
    """Two loops side by side, in a case of 1,000 blocks and ones that go wrong at some place or end early."""
    rng = random.Random(5)
    net = [("s", ["In"], ["p", "q"]), ("a", ["p"], ["r"]), ("b", ["r"], ["p"]), ("c", ["q"], ["t"]),
           ("d", ["t"], ["q"]), ("z", ["p", "q"], ["Out"])]
    pre_post = spark.createDataFrame(net, "activity string, pre array<string>, post array<string>")
    rules = {a: (set(pre), set(post)) for a, pre, post in net}
    middle = [e for _ in range(500) for e in rng.choice([["a", "c", "d", "b"], ["c", "a", "b", "d"]])]
    traces = {"good": ["s", *middle, "z"]}
    traces["lacks"] = ["s", *middle[:901], *middle[903:], "z"]
    traces["unknown"] = ["s", *middle[:700], "?", *middle[700:], "z"]
    traces["early"] = ["s", *middle[:400], "z", *middle[400:], "z"]
    traces["open"] = ["s", *middle]
    traces["no start"] = [*middle, "z"]
    traces["repeats"] = ["s", *[e for e in middle[:600] for _ in range(2)], "z"]
    log = as_log(spark, traces, 2, "table")
    got = {r.case_id: r.accepted for r in trace_conformance(log, pre_post, on_disabled, 1, max_bits).collect()}
    assert got == {c: brute.accepts(t, rules, on_disabled) for c, t in traces.items()}
    assert got["good"] and not got["unknown"] and got["repeats"] == (on_disabled == "skip")


def test_blocks_that_a_token_waits_through(spark):
    """What the first block decides and the last one asks for can't be guessed by the blocks between them."""
    net = [("s", ["In"], ["p", "q"]), ("a", ["p"], ["r"]), ("b", ["p"], ["o"]), ("x", ["q"], ["t"]), ("y", ["t"], ["q"]),
           ("z", ["r", "q"], ["Out"])]
    pre_post = spark.createDataFrame(net, "activity string, pre array<string>, post array<string>")
    rules = {a: (set(pre), set(post)) for a, pre, post in net}
    traces = {f"{e}{n}": ["s", e, *["x", "y"] * n, "z"] for e in "ab" for n in (1, 16)}
    log = as_log(spark, traces, 2, "table")
    got = {r.case_id: r.accepted for r in trace_conformance(log, pre_post, "skip", 1).collect()}
    assert got == {c: brute.accepts(t, rules, "skip") for c, t in traces.items()}
    assert got["a16"] and not got["b16"]


def random_footprint(spark, rng, names):
    rel = {}
    for i, a in enumerate(names):
        rel[a, a] = "->" if rng.random() < 0.1 else "#"
        for b in names[i + 1:]:
            rel[a, b], rel[b, a] = rng.choice([("#", "#"), ("#", "#"), ("->", "<-"), ("<-", "->"), ("||", "||")])
    return rel, spark.createDataFrame([(*k, v) for k, v in rel.items()], "a string, b string, relation string")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_cliques_on_random_footprints(spark, seed):
    names = "abcdefgh"
    rel, fp = random_footprint(spark, random.Random(seed), names)
    expected = sorted(brute.maximal(brute.candidates_of(names, rel)))
    assert sorted((tuple(r.in_set), tuple(r.out_set))
                  for r in maximal_places(fp).collect()) == expected
    related = maximal_places(fp.filter("relation <> '#'")).collect()
    assert sorted((tuple(r.in_set), tuple(r.out_set)) for r in related) == expected


def test_places_of_twenty_thousand_activities(spark):
    """A hub of 150 choices, each the head of a chain; all 20,000 activities are known by their related cells only."""
    heads, length = 150, 133
    name = "concat({}, '-', {})".format
    arcs = spark.range(heads).selectExpr("id AS h", f"explode(sequence(0, {length - 1})) AS k").selectExpr(
        f"if(k = 0, 'hub', {name('h', 'k')}) AS a", f"{name('h', 'k + 1')} AS b")
    cells = arcs.selectExpr("stack(2, a, b, '->', b, a, '<-') AS (a, b, relation)")
    places = maximal_places(cells).cache()
    assert places.count() == 1 + heads * (length - 1)
    (choice,) = places.filter("in_set = array('hub')").collect()
    assert choice.out_set == sorted(f"{h}-1" for h in range(heads))
    assert places.filter("in_set <> array('hub')").selectExpr("max(size(in_set) + size(out_set))").first()[0] == 2


def test_wide_choices_do_not_explode(spark):
    """Thirty alternatives followed by thirty alternatives: 2^60 places, one maximal."""
    layers = [[f"{c}{i:02}" for i in range(30)] for c in "pq"]
    rows = [(a, b, "#" if x == y else ("->" if x < y else "<-"))
            for x in range(2) for y in range(2) for a in layers[x] for b in layers[y]]
    fp = spark.createDataFrame(rows, "a string, b string, relation string")
    (place,) = maximal_places(fp).collect()
    assert (place.in_set, place.out_set) == (layers[0], layers[1])
