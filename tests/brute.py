"""Plain-Python answers for small logs, written from the definitions and used as test oracles."""

from __future__ import annotations

from itertools import chain, combinations


def follow_flags(traces, counting):
    out = {}
    for t in traces:
        seen = {}
        for x, y in zip(t, t[1:]):
            key = (min(x, y), max(x, y))
            way = (True, False) if x <= y else (False, True)
            if counting == "presence" and key in seen:
                way = tuple(p or q for p, q in zip(seen[key], way))
            seen[key] = way
        for key, way in seen.items():
            c = out.setdefault(key, [0, 0])
            c[0] += way[0]
            c[1] += way[1]
    return {k: tuple(v) for k, v in out.items()}


def counts(traces, counting):
    out = {}

    def tally(rel, seen):
        for key, way in seen.items():
            c = out.setdefault((rel, *key), [0, 0])
            c[0] += way[0]
            c[1] += way[1]

    def note(seen, x, y):
        key = (min(x, y), max(x, y))
        way = (1, 0) if x <= y else (0, 1)
        if counting == "presence" and key in seen:
            way = tuple(max(p, q) for p, q in zip(seen[key], way))
        seen[key] = way

    for t in traces:
        tally("COUNT", {(x, x): (1, 0) for x in t})
        direct, loop2, successor = {}, {}, {}
        for x, y in zip(t, t[1:]):
            note(direct, x, y)
        for x, y, z in zip(t, t[1:], t[2:]):
            if x == z and x != y:
                note(loop2, x, y)
        for i in range(len(t)):
            for j in range(i + 1, len(t)):
                note(successor, t[i], t[j])
        tally("DIRECT", direct)
        tally("LOOP2", loop2)
        tally("SUCCESSOR", successor)
    return {k: tuple(v) for k, v in out.items()}


def bindings(traces, edges):
    """(case, pos, side, activity) -> set, positions from 1."""
    succ, pred = {}, {}
    for x, y in edges:
        succ.setdefault(x, set()).add(y)
        pred.setdefault(y, set()).add(x)
    out = {}
    for case, t in traces.items():
        for i, x in enumerate(t):
            ahead, behind = t[i + 1:], t[:i][::-1]
            for side, near, far, rest in (("SUCC", succ, pred, ahead), ("PRED", pred, succ, behind)):
                linked = {
                    s for s in near.get(x, ())
                    if s in rest and not far[s] & set(rest[:rest.index(s)])}
                if linked:
                    out[(case, i + 1, side, x)] = linked
    return out


def relations(traces, counting="last_wins"):
    names = sorted(set(chain.from_iterable(traces)))
    rel = {(x, y): "#" for x in names for y in names}
    for (x, y), (f, b) in follow_flags(traces, counting).items():
        if f and b:
            rel[x, y] = rel[y, x] = "||"
        elif x == y or f:
            rel[y, x] = "<-"
            rel[x, y] = "->"
        else:
            rel[x, y] = "<-"
            rel[y, x] = "->"
    return names, rel


def candidates(traces):
    return candidates_of(*relations(traces))


def candidates_of(names, rel):
    subsets = [s for n in range(1, len(names) + 1) for s in combinations(names, n)
               if all(rel[x, y] == "#" for x in s for y in s)]
    return {(a, b) for a in subsets for b in subsets if all(rel[x, y] == "->" for x in a for y in b)}


def maximal(pairs):
    return {(a, b) for a, b in pairs
            if not any((a, b) != (c, d) and set(a) <= set(c) and set(b) <= set(d) for c, d in pairs)}


def accepts(trace, net, on_disabled):
    """``net``: activity -> (pre, post), places as pairs of sets, the source and the sink as their names."""
    marking = {"In"}
    for x in trace:
        if "Out" in marking or x not in net:
            return False
        pre, post = net[x]
        if pre <= marking:
            marking = (marking - pre) | post
        elif on_disabled == "reject":
            return False
    return marking == {"Out"}


def net_of(traces):
    places = maximal(candidates(traces)) if traces else set()
    names = set(chain.from_iterable(traces))
    starts, ends = {t[0] for t in traces}, {t[-1] for t in traces}
    net = {}
    for x in names:
        pre = {p for p in places if x in p[1]}
        post = {p for p in places if x in p[0]}
        if x in starts:
            pre.add("In")
        if x in ends:
            post.add("Out")
        net[x] = (pre, post)
    return net
