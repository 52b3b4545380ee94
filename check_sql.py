"""DuckDB SQL that answers each query of ``__spark_entry__`` independently of Spark.

Each text is a chain of named steps (``STEPS``) ending in a final SELECT. Steps name what they
need, so a query states only its log, its thresholds and its last SELECT.
"""

from __future__ import annotations

LOGS = {
    "events": """SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        event_type AS activity FROM events""",
    "conversations": """SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
        role AS activity FROM conversations""",
    "customers": """SELECT o_custkey AS case_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos,
        o_orderpriority AS activity FROM orders""",
    "lifecycle": """SELECT case_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS activity FROM (
        SELECT o_orderkey AS case_id, list_concat(
            ['placed ' || o_orderpriority],
            CASE WHEN o_totalprice >= 250000 THEN ['review'] ELSE []::VARCHAR[] END,
            ['status ' || o_orderstatus],
            CASE WHEN o_totalprice < 100000 THEN ['pack', 'invoice'] ELSE ['invoice', 'pack'] END,
            ['close']) AS t FROM orders)""",
}

DEFAULT = {"a": 0.9, "l1": 0.9, "l2": 0.9, "long": 0.9, "rel": 0.05}

# name -> (steps it reads, SQL). {a}, {l1}, {l2}, {long}, {rel} are thresholds.
STEPS = {
    "alphabet": (["log"], "SELECT DISTINCT activity FROM log"),
    "ev": (["log"], """SELECT *, lead(activity, 1) OVER w AS next1, lead(activity, 2) OVER w AS next2
        FROM log WINDOW w AS (PARTITION BY case_id ORDER BY pos)"""),
    "pairs": (["ev"], """SELECT case_id, least(activity, next1) AS a, greatest(activity, next1) AS b,
        arg_max(activity <= next1, pos) AS forward, NOT arg_max(activity <= next1, pos) AS backward
        FROM ev WHERE next1 IS NOT NULL GROUP BY case_id, least(activity, next1), greatest(activity, next1)"""),
    "pairs_presence": (["ev"], """SELECT case_id, least(activity, next1) AS a, greatest(activity, next1) AS b,
        bool_or(activity <= next1) AS forward, bool_or(activity > next1) AS backward
        FROM ev WHERE next1 IS NOT NULL GROUP BY case_id, least(activity, next1), greatest(activity, next1)"""),
    "flags": (["pairs"], """SELECT a, b, bool_or(forward) AS forward, bool_or(backward) AS backward
        FROM pairs GROUP BY a, b"""),
    "flags_presence": (["pairs_presence"], """SELECT a, b, bool_or(forward) AS forward, bool_or(backward) AS backward
        FROM pairs_presence GROUP BY a, b"""),
    "fp": (["alphabet", "flags"], """SELECT x.activity AS a, y.activity AS b, CASE
            WHEN x.activity = y.activity THEN CASE WHEN f.forward OR f.backward THEN '->' ELSE '#' END
            WHEN f.forward AND f.backward THEN '||'
            WHEN f.forward IS NULL THEN '#'
            WHEN f.forward = (x.activity < y.activity) THEN '->' ELSE '<-' END AS relation
        FROM alphabet x CROSS JOIN alphabet y
        LEFT JOIN flags f ON f.a = least(x.activity, y.activity) AND f.b = greatest(x.activity, y.activity)"""),
    "fp_rows": (["fp"], """SELECT a AS activity, string_agg(relation, ',' ORDER BY b) AS relations
        FROM fp GROUP BY a"""),
    "fp_text": (["fp", "alphabet"], """SELECT 0 AS row_no, chr(9) || string_agg(activity || chr(9), '' ORDER BY activity) AS line
            FROM alphabet
        UNION ALL
        SELECT row_number() OVER (ORDER BY a), a || chr(9) || string_agg(relation || chr(9), '' ORDER BY b)
            FROM fp GROUP BY a"""),
    "starts": (["log"], "SELECT DISTINCT activity FROM log WHERE pos = 1"),
    "ends": (["ev"], "SELECT DISTINCT activity FROM ev WHERE next1 IS NULL"),
    # Places.
    "sets": (["fp"], """SELECT a AS activity,
            coalesce(list(b) FILTER (relation = '#'), []) AS unrelated,
            coalesce(list(b) FILTER (relation = '->'), []) AS followers,
            coalesce(list(b) FILTER (relation = '<-'), []) AS preceders,
            bool_or(a = b AND relation = '#') AS loop_free
        FROM fp GROUP BY a"""),
    "cand": (["sets"], """SELECT [s.activity] AS ins, [t.activity] AS outs FROM sets s JOIN sets t
            ON list_contains(s.followers, t.activity) AND s.loop_free AND t.loop_free
        UNION
        SELECT CASE WHEN to_in THEN list_sort(list_append(ins, activity)) ELSE ins END,
               CASE WHEN to_in THEN outs ELSE list_sort(list_append(outs, activity)) END
        FROM cand, sets, (VALUES (true), (false)) v(to_in)
        WHERE loop_free AND CASE WHEN to_in
            THEN NOT list_contains(ins, activity) AND list_has_all(unrelated, ins) AND list_has_all(followers, outs)
            ELSE NOT list_contains(outs, activity) AND list_has_all(unrelated, outs) AND list_has_all(preceders, ins)
            END"""),
    "places": (["cand"], r"""SELECT 'p(' || array_to_string(list_transform(ins, lambda v: regexp_replace(v, '([,|\\])', '\\\1', 'g')), ',')
            || '|' || array_to_string(list_transform(outs, lambda v: regexp_replace(v, '([,|\\])', '\\\1', 'g')), ',')
            || ')' AS place, ins, outs FROM cand c
        WHERE NOT EXISTS (SELECT 1 FROM cand d WHERE list_has_all(d.ins, c.ins) AND list_has_all(d.outs, c.outs)
            AND len(d.ins) + len(d.outs) > len(c.ins) + len(c.outs))"""),
    "net": (["places", "starts", "ends"], """SELECT place, ins, outs FROM places
        UNION ALL SELECT 'In', []::VARCHAR[], list(activity ORDER BY activity) FROM starts
        UNION ALL SELECT 'Out', list(activity ORDER BY activity), []::VARCHAR[] FROM ends"""),
    "arcs": (["net"], """SELECT 'event_to_place' AS kind, place, unnest(ins) AS activity FROM net
        UNION ALL SELECT 'place_to_event', place, unnest(outs) FROM net"""),
    "pre_post": (["arcs", "alphabet"], """SELECT activity,
            coalesce(list(place ORDER BY place) FILTER (kind = 'place_to_event'), []) AS pre,
            coalesce(list(place ORDER BY place) FILTER (kind = 'event_to_place'), []) AS post
        FROM alphabet LEFT JOIN arcs USING (activity) GROUP BY activity"""),
    # Replay knows places by their two sets, not by name: the source is 0, the sink -1.
    "keyed": (["places", "starts", "ends"], """SELECT row_number() OVER (ORDER BY ins, outs) AS k, ins, outs FROM places
        UNION ALL SELECT 0, []::VARCHAR[], list(activity) FROM starts
        UNION ALL SELECT -1, list(activity), []::VARCHAR[] FROM ends"""),
    "rules": (["keyed", "alphabet"], """SELECT activity,
            coalesce(list(k) FILTER (list_contains(outs, activity)), []) AS pre,
            coalesce(list(k) FILTER (list_contains(ins, activity)), []) AS post
        FROM alphabet LEFT JOIN keyed ON list_contains(outs, activity) OR list_contains(ins, activity) GROUP BY activity"""),
    "replay": (["log", "rules"], """SELECT DISTINCT case_id, 0::BIGINT AS pos, [0::BIGINT] AS marking FROM log
        UNION ALL
        SELECT r.case_id, l.pos, CASE
            WHEN r.marking IS NULL OR p.activity IS NULL OR list_contains(r.marking, -1) THEN NULL
            WHEN list_has_all(r.marking, p.pre) THEN
                list_distinct(list_concat(list_filter(r.marking, lambda x: NOT list_contains(p.pre, x)), p.post))
            ELSE {stuck} END
        FROM replay r JOIN log l ON l.case_id = r.case_id AND l.pos = r.pos + 1
        LEFT JOIN rules p ON p.activity = l.activity"""),
    "verdict": (["replay"], """SELECT case_id, coalesce(arg_max_null(marking, pos) = [-1::BIGINT], false) AS accepted
        FROM replay GROUP BY case_id"""),
    # Tallies.
    "per_activity": (["log"], """SELECT case_id, activity, min(pos) AS first, max(pos) AS last, count(*) AS n
        FROM log GROUP BY case_id, activity"""),
    "totals": (["per_activity"], "SELECT activity, count(*) AS n FROM per_activity GROUP BY activity"),
    "direct": (["pairs"], """SELECT a, b, count(*) FILTER (forward) AS c1, count(*) FILTER (backward) AS c2
        FROM pairs GROUP BY a, b"""),
    "direct_presence": (["pairs_presence"], """SELECT a, b, count(*) FILTER (forward) AS c1,
        count(*) FILTER (backward) AS c2 FROM pairs_presence GROUP BY a, b"""),
    "loop2": (["ev"], """SELECT a, b, count(*) FILTER (forward) AS c1, count(*) FILTER (NOT forward) AS c2 FROM (
            SELECT case_id, least(activity, next1) AS a, greatest(activity, next1) AS b,
                arg_max(activity < next1, pos) AS forward
            FROM ev WHERE next2 = activity AND next1 <> activity
            GROUP BY case_id, least(activity, next1), greatest(activity, next1)) GROUP BY a, b"""),
    "loop2_presence": (["ev"], """SELECT a, b, count(*) FILTER (forward) AS c1, count(*) FILTER (backward) AS c2 FROM (
            SELECT case_id, least(activity, next1) AS a, greatest(activity, next1) AS b,
                bool_or(activity < next1) AS forward, bool_or(activity > next1) AS backward
            FROM ev WHERE next2 = activity AND next1 <> activity
            GROUP BY case_id, least(activity, next1), greatest(activity, next1)) GROUP BY a, b"""),
    "successor": (["per_activity"], """SELECT x.activity AS a, y.activity AS b,
            count(*) FILTER (x.activity = y.activity OR x.last < y.last) AS c1,
            count(*) FILTER (x.activity <> y.activity AND x.last > y.last) AS c2
        FROM per_activity x JOIN per_activity y ON x.case_id = y.case_id AND x.activity <= y.activity
        WHERE x.activity < y.activity OR x.n >= 2 GROUP BY x.activity, y.activity"""),
    "successor_presence": (["per_activity"], """SELECT x.activity AS a, y.activity AS b,
            count(*) FILTER (x.first < y.last) AS c1,
            count(*) FILTER (x.activity <> y.activity AND y.first < x.last) AS c2
        FROM per_activity x JOIN per_activity y ON x.case_id = y.case_id AND x.activity <= y.activity
        WHERE x.activity < y.activity OR x.n >= 2 GROUP BY x.activity, y.activity"""),
    "counts": (["totals", "direct", "loop2", "successor"], """
        SELECT 'COUNT' AS rel, activity AS a, activity AS b, n AS c1, 0::BIGINT AS c2 FROM totals
        UNION ALL SELECT 'DIRECT', a, b, c1, c2 FROM direct
        UNION ALL SELECT 'LOOP2', a, b, c1, c2 FROM loop2
        UNION ALL SELECT 'SUCCESSOR', a, b, c1, c2 FROM successor"""),
    "counts_presence": (["totals", "direct_presence", "loop2_presence", "successor_presence"], """
        SELECT 'COUNT' AS rel, activity AS a, activity AS b, n AS c1, 0::BIGINT AS c2 FROM totals
        UNION ALL SELECT 'DIRECT', a, b, c1, c2 FROM direct_presence
        UNION ALL SELECT 'LOOP2', a, b, c1, c2 FROM loop2_presence
        UNION ALL SELECT 'SUCCESSOR', a, b, c1, c2 FROM successor_presence"""),
    # Measures.
    "direct_m": (["direct"], """SELECT a, b,
            CASE WHEN a = b THEN c1::DOUBLE / (c1 + 1)::DOUBLE ELSE (c1 - c2)::DOUBLE / (c1 + c2 + 1)::DOUBLE END AS forward,
            CASE WHEN a = b THEN 0::DOUBLE ELSE (c2 - c1)::DOUBLE / (c1 + c2 + 1)::DOUBLE END AS backward
        FROM direct"""),
    "loop2_m": (["loop2"], """SELECT a, b, (c1 - c2)::DOUBLE / (c1 + c2 + 1)::DOUBLE AS forward,
            (c2 - c1)::DOUBLE / (c1 + c2 + 1)::DOUBLE AS backward FROM loop2"""),
    "loop2_paper_m": (["loop2"], """SELECT a, b, (c1 + c2)::DOUBLE / (c1 + c2 + 1)::DOUBLE AS forward,
            (c1 + c2)::DOUBLE / (c1 + c2 + 1)::DOUBLE AS backward FROM loop2"""),
    "successor_m": (["successor", "totals"], """SELECT a, b,
            2::DOUBLE * (c1 - abs(x.n - y.n))::DOUBLE / (x.n + y.n + 1)::DOUBLE AS forward,
            2::DOUBLE * (c2 - abs(x.n - y.n))::DOUBLE / (x.n + y.n + 1)::DOUBLE AS backward
        FROM successor s JOIN totals x ON x.activity = s.a JOIN totals y ON y.activity = s.b"""),
    "measures": (["direct_m", "loop2_m", "successor_m"], """
        SELECT 'DIRECT' AS rel, a AS src, b AS dst, forward AS measure FROM direct_m
        UNION ALL SELECT 'DIRECT', b, a, backward FROM direct_m
        UNION ALL SELECT 'LOOP2', a, b, forward FROM loop2_m
        UNION ALL SELECT 'LOOP2', b, a, backward FROM loop2_m
        UNION ALL SELECT 'SUCCESSOR', a, b, forward FROM successor_m
        UNION ALL SELECT 'SUCCESSOR', b, a, backward FROM successor_m"""),
    # Graph.
    "m": (["measures"], "SELECT src, dst, measure FROM measures WHERE rel = 'DIRECT' AND measure > 0"),
    "c1": (["m"], "SELECT src, dst FROM m WHERE src = dst AND measure >= {l1}"),
    "c2": (["measures", "c1"], """SELECT src, dst FROM measures WHERE rel = 'LOOP2' AND measure > 0 AND measure >= {l2}
        AND src NOT IN (SELECT src FROM c1) AND dst NOT IN (SELECT src FROM c1)"""),
    "cout": (["m"], """SELECT src, dst, measure FROM m x WHERE src <> dst
        AND measure = (SELECT max(measure) FROM m y WHERE y.src = x.src AND y.src <> y.dst)"""),
    "cin": (["m"], """SELECT src, dst, measure FROM m x WHERE src <> dst
        AND measure = (SELECT max(measure) FROM m y WHERE y.dst = x.dst AND y.src <> y.dst)"""),
    "weak_out": (["cout", "c2"], """SELECT DISTINCT x.src, x.dst FROM cout x JOIN c2 ON c2.src = x.src
        JOIN cout y ON y.src = c2.dst WHERE x.measure < {a} AND y.measure - x.measure > {rel}"""),
    "weak_in": (["cin", "c2"], """SELECT DISTINCT x.src, x.dst FROM cin x JOIN c2 ON c2.src = x.dst
        JOIN cin y ON y.dst = c2.dst WHERE x.measure < {a} AND y.measure - x.measure > {rel}"""),
    "strong_out": (["cout", "weak_out"], """SELECT src, dst, measure FROM cout
        WHERE (src, dst) NOT IN (SELECT (src, dst) FROM weak_out)"""),
    "strong_in": (["cin", "weak_in"], """SELECT src, dst, measure FROM cin
        WHERE (src, dst) NOT IN (SELECT (src, dst) FROM weak_in)"""),
    "accepted_out": (["m", "strong_out"], """SELECT src, dst FROM m WHERE measure >= {a} OR EXISTS (
        SELECT 1 FROM strong_out s WHERE s.src = m.src AND s.measure - m.measure < {rel})"""),
    "accepted_in": (["m", "strong_in"], """SELECT src, dst FROM m WHERE measure >= {a} OR EXISTS (
        SELECT 1 FROM strong_in s WHERE s.dst = m.dst AND s.measure - m.measure < {rel})"""),
    "long_distance": (["measures"], """SELECT src, dst FROM measures
        WHERE rel = 'SUCCESSOR' AND measure > 0 AND measure > {long}"""),
    "dg": (["c1", "c2", "strong_out", "strong_in", "accepted_out", "accepted_in", "long_distance"], """
        SELECT src, dst FROM c1 UNION SELECT src, dst FROM c2
        UNION SELECT src, dst FROM strong_out UNION SELECT src, dst FROM strong_in
        UNION SELECT src, dst FROM accepted_out UNION SELECT src, dst FROM accepted_in
        UNION SELECT src, dst FROM long_distance"""),
    # Bindings, by looking at everything between an event and the first later (last earlier) neighbour.
    "out_near": (["log", "dg"], """SELECT e.case_id, e.pos, e.activity, d.dst AS s, min(f.pos) AS near
        FROM log e JOIN dg d ON d.src = e.activity
        JOIN log f ON f.case_id = e.case_id AND f.activity = d.dst AND f.pos > e.pos
        GROUP BY e.case_id, e.pos, e.activity, d.dst"""),
    "in_near": (["log", "dg"], """SELECT e.case_id, e.pos, e.activity, d.src AS s, max(f.pos) AS near
        FROM log e JOIN dg d ON d.dst = e.activity
        JOIN log f ON f.case_id = e.case_id AND f.activity = d.src AND f.pos < e.pos
        GROUP BY e.case_id, e.pos, e.activity, d.src"""),
    "outb": (["out_near", "log", "dg"], """SELECT case_id, pos, activity, string_agg(s, ',' ORDER BY s) AS binding
        FROM out_near o WHERE NOT EXISTS (SELECT 1 FROM log g JOIN dg p ON p.src = g.activity
            WHERE g.case_id = o.case_id AND p.dst = o.s AND g.pos > o.pos AND g.pos < o.near)
        GROUP BY case_id, pos, activity"""),
    "inb": (["in_near", "log", "dg"], """SELECT case_id, pos, activity, string_agg(s, ',' ORDER BY s) AS binding
        FROM in_near o WHERE NOT EXISTS (SELECT 1 FROM log g JOIN dg p ON p.dst = g.activity
            WHERE g.case_id = o.case_id AND p.src = o.s AND g.pos < o.pos AND g.pos > o.near)
        GROUP BY case_id, pos, activity"""),
    "bindings": (["outb", "inb"], """SELECT activity, side, binding, count(*) AS n FROM (
            SELECT DISTINCT case_id, activity, 'SUCC' AS side, binding FROM outb
            UNION ALL SELECT DISTINCT case_id, activity, 'PRED', binding FROM inb)
        GROUP BY activity, side, binding"""),
}


def sql(log: str, last: str, needs: list[str], thresholds: dict = DEFAULT, stuck: str = "r.marking") -> str:
    """The steps in ``needs`` and all they read, over ``log``, then the SELECT ``last``."""
    done: dict[str, str] = {}

    def add(step: str) -> None:
        if step in done:
            return
        if step == "log":
            done[step] = LOGS[log]
            return
        reads, text = STEPS[step]
        for r in reads:
            add(r)
        values = {k: f"{v}::DOUBLE" for k, v in thresholds.items()}
        for k, v in {**values, "stuck": stuck}.items():
            text = text.replace("{" + k + "}", v)
        done[step] = text

    for step in needs:
        add(step)
    steps = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH RECURSIVE {steps}\n{last}"


WORDS = """SELECT word, count(*) AS n FROM (
    SELECT unnest(string_split(rtrim(line, ' '), ' ')) AS word FROM (
        SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line = '' OR rtrim(line, ' ') <> '') GROUP BY word"""
