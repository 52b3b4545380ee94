"""Names of activities that look like parts of other names must change nothing."""

import pytest

import brute
from tracewell.operators.footprint import footprint
from tracewell.operators.places import maximal_places
from tracewell.plans.discovery import causal_net, replayed
from tracewell.sources.logs import traces_to_events

ODD = {"q": "a,b", "r": "a|b", "t": "(", "u": "\\", "v": "In", "w": "it's", "x": "a\\,b"}
# q and both a and b may follow s; the last two cases fit the net only where {q} and {a, b} are told apart.
TRACES = ["sqcz", "sabcz", "sbacz", "srcz", "stcz", "sucz", "svcz", "swcz", "sxcz", "sacz", "sqacz"]


def log_of(spark, names):
    rows = [(f"c{i:02}", [names.get(x, x) for x in t]) for i, t in enumerate(TRACES)]
    return traces_to_events(spark.createDataFrame(rows, "c string, t array<string>"), "c", "t")


@pytest.mark.parametrize("on_disabled", ["skip", "reject"])
def test_verdicts_do_not_depend_on_names(spark, on_disabled):
    plain, odd = ({r.case_id: r.accepted for r in replayed(log_of(spark, n), on_disabled=on_disabled).collect()}
                  for n in ({}, ODD))
    assert plain == odd and any(plain.values()) and not all(plain.values())


def test_places_have_names_of_their_own(spark):
    rows = maximal_places(footprint(log_of(spark, ODD))).collect()
    assert len({r.place for r in rows}) == len(rows) == len({(tuple(r.in_set), tuple(r.out_set)) for r in rows})
    assert not {r.place for r in rows} & {"In", "Out"}


@pytest.mark.parametrize("escaped", ["true", "false"])
def test_parser_setting(spark, escaped):
    """Quoting rules of the SQL parser may differ between sessions."""
    key = "spark.sql.parser.escapedStringLiterals"
    spark.conf.set(key, escaped)
    try:
        log = log_of(spark, ODD)
        traces = {f"c{i:02}": [ODD.get(x, x) for x in t] for i, t in enumerate(TRACES)}
        net = brute.net_of(list(traces.values()))
        assert {r.case_id: r.accepted for r in replayed(log).collect()} == {
            c: brute.accepts(t, net, "skip") for c, t in traces.items()}
        plain, odd = (sorted((names.get(r.activity, r.activity), r.side, sorted(names.get(b, b) for b in r.binding), r.n)
                             for r in causal_net(log_of(spark, given)).collect())
                      for given, names in (({}, ODD), (ODD, {})))
        assert plain == odd
    finally:
        spark.conf.unset(key)
