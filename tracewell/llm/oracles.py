"""DuckDB SQL that answers those queries of ``queries.py`` that SQL can express."""

from __future__ import annotations

from tracewell.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PREFERENCES = """WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
answers AS (SELECT pair_id, max(turn) FILTER (role = 'assistant') AS own_last,
        {'said': arg_max(text, turn) FILTER (role = 'assistant'), 'n': count(*) FILTER (role = 'assistant')} AS answer
    FROM t GROUP BY pair_id),
last AS (SELECT pair_id, own_last, coalesce(lead(answer) OVER (ORDER BY pair_id), first_value(answer) OVER (ORDER BY pair_id)) AS other
    FROM answers),
sides AS (
    SELECT pair_id, 'chosen' AS side, turn, role, text FROM t
    UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM t JOIN last USING (pair_id)
        WHERE own_last IS NULL OR turn < own_last
    UNION ALL SELECT pair_id, 'rejected', own_last, 'assistant', other.said FROM last
        WHERE own_last IS NOT NULL AND other.n > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS rn FROM sides),
prefix AS (SELECT pair_id, coalesce(min(rn) FILTER (NOT same) - 1, max(rn)) AS n FROM (
        SELECT pair_id, rn, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
        FROM numbered GROUP BY pair_id, rn) GROUP BY pair_id),
placed AS (SELECT *, sum(length(whole)) OVER (PARTITION BY pair_id, side, rn > n ORDER BY rn) - length(whole) AS begins FROM (
        SELECT *, '<|im_start|>' || role || chr(10) AS head,
            '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole
        FROM numbered JOIN prefix USING (pair_id)))
SELECT pair_id, any_value(n)::INTEGER AS n_prompt_turns,
    coalesce(string_agg(whole, '' ORDER BY rn) FILTER (side = 'chosen' AND rn <= n), '') AS prompt,
    coalesce(string_agg(whole, '' ORDER BY rn) FILTER (side = 'chosen' AND rn > n), '') AS chosen,
    coalesce(string_agg(whole, '' ORDER BY rn) FILTER (side = 'rejected' AND rn > n), '') AS rejected,
    coalesce(string_agg((begins + length(head))::BIGINT || ':' || (begins + length(whole) - 1)::BIGINT, ',' ORDER BY rn)
        FILTER (side = 'chosen' AND rn > n AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((begins + length(head))::BIGINT || ':' || (begins + length(whole) - 1)::BIGINT, ',' ORDER BY rn)
        FILTER (side = 'rejected' AND rn > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id"""

def listed(values: list[str]) -> str:
    return f"[{', '.join(map(quoted, values))}]::VARCHAR[]"


def _template(i: int, t: licenses.Template) -> str:
    versions, kinds = licenses.demands(t.license)
    have, lack = ([p for p, has in kinds if has is wanted] for wanted in (True, False))
    return (f"({i}, {quoted(t.license)}, {quoted(t.text)}, {quoted(t.names)}, {listed([t.barred] * bool(t.barred) + lack)}, "
            f"{listed(have)}, {listed(versions)})")


WORD = licenses.WORD
_COUNT = "len(regexp_extract_all(lower({0}), '" + WORD + "'))"
_JOINED = "array_to_string(regexp_extract_all(lower({0}), '" + WORD + "'), ' ')"
#: The texts of the test tables have no comments; a header is a first paragraph, the file names are no licence files'.
LICENSES = f"""WITH RECURSIVE files AS (SELECT source || '/' || CASE WHEN doc_id % 3 > 0 THEN lang || '/' ELSE '' END
        || CASE WHEN doc_id % 3 > 1 THEN (doc_id // 100) || '/' ELSE '' END || doc_id || '.txt' AS path,
    coalesce(text, '') AS text FROM documents),
templates AS (SELECT * FROM (VALUES {", ".join(_template(i, t) for i, t in enumerate(licenses.TEMPLATES))})
    v(id, license, text, names, lacks, has, versions)),
speech AS (SELECT path, {_COUNT.format("text")} AS words, text FROM files WHERE regexp_matches(text, {quoted(licenses.GRANT)})),
claims AS (SELECT path, words, 0 AS rank, said FROM (
        SELECT path, words, unnest(string_split_regex(text, '\r?\n|\r')) AS said FROM speech)
        WHERE regexp_matches(said, {quoted(licenses.MENTION)}) AND NOT regexp_matches({_JOINED.format("said")}, {quoted(licenses.NEGATED)})
    UNION ALL SELECT path, words, 1, said FROM (
        SELECT path, words, string_split_regex(ltrim(text), {quoted(licenses.PARAGRAPH)})[1] AS said FROM speech)
        WHERE regexp_matches(said, {quoted(licenses.GRANT)})),
own_texts AS (SELECT said, words, list_transform(regexp_extract_all(words, {quoted(licenses.VERSION)}, 1),
        lambda v: regexp_replace(v, '[.]0$', '')) AS told
    FROM (SELECT DISTINCT said, {_JOINED.format("said")} AS words FROM claims WHERE NOT regexp_matches(said, {quoted(licenses.SPDX)}))),
admitted AS (SELECT said, id FROM own_texts, templates WHERE regexp_matches(words, names) AND list_has_all(told, versions)
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(lacks) AS p) WHERE regexp_matches(words, p))
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(has) AS p) WHERE NOT regexp_matches(words, p))),
bags AS (SELECT 'text' AS kind, said AS name, word, count(*) AS tf FROM (
        SELECT said, unnest(regexp_extract_all(lower(said), '{WORD}')) AS word FROM own_texts) GROUP BY said, word
    UNION ALL SELECT 'template', id::VARCHAR, word, count(*) FROM (
        SELECT id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM templates) GROUP BY id, word),
idf AS (SELECT word, ln((SELECT count(*) FROM templates)::DOUBLE / count(*)) + 1 AS idf FROM bags WHERE kind = 'template' GROUP BY word),
weights AS (SELECT kind, name, bags.word, tf * coalesce(idf, ln((SELECT count(*) FROM templates)::DOUBLE) + 1) AS w
    FROM bags LEFT JOIN idf ON idf.word = bags.word),
norms AS (SELECT kind, name, sqrt(sum(w * w)) AS norm FROM weights GROUP BY kind, name),
near AS (SELECT ad.said, ad.id, round(sum(l.w * t.w) / (any_value(a.norm) * any_value(b.norm)), 6) AS cosine
    FROM admitted ad JOIN weights l ON l.kind = 'text' AND l.name = ad.said
    JOIN weights t ON t.kind = 'template' AND t.name = ad.id::VARCHAR AND l.word = t.word
    JOIN norms a ON a.kind = 'text' AND a.name = l.name JOIN norms b ON b.kind = 'template' AND b.name = t.name
    GROUP BY ad.said, ad.id),
ranked AS (SELECT said, license, cosine, lead(cosine) OVER (PARTITION BY said ORDER BY cosine DESC, license) AS second,
    row_number() OVER (PARTITION BY said ORDER BY cosine DESC, license) AS place
    FROM (SELECT said, license, max(cosine) AS cosine FROM near JOIN templates USING (id) GROUP BY said, license)),
best AS (SELECT said, license, cosine FROM ranked WHERE place = 1 AND cosine >= 0.6 AND coalesce(cosine - second, 1) >= 0.02),
hits AS (SELECT path, words, rank, {_COUNT.format("said")} AS n, coalesce(b.license, regexp_replace(
        regexp_extract(said, {quoted(licenses.SPDX)}, 1), {quoted(licenses.LATER)}, '\1')) AS license, coalesce(b.cosine, 1) AS cosine
    FROM claims LEFT JOIN best b USING (said)
    WHERE b.license IS NOT NULL OR rank = 0 AND regexp_matches(said, {quoted(licenses.SPDX)})),
own AS (SELECT path, license, cosine, coalesce(sum(n) FILTER (rank = 0) OVER (PARTITION BY path), max(n) OVER (PARTITION BY path))
        >= 0.1 * words AS speaks FROM hits
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, cosine DESC, license) = 1),
speaking AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, license, cosine FROM own WHERE speaks
    QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY cosine DESC, license) = 1),
up AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '^(.*)/[^/]*$', 1) AS above
        FROM files
    UNION SELECT folder, regexp_extract(above, '^(.*)/[^/]*$', 1) FROM up WHERE above <> ''),
nearest AS (SELECT folder, directory, license, cosine FROM up JOIN speaking ON directory = above
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1)
SELECT f.path, coalesce(o.license, n.license) AS license, coalesce(o.cosine, n.cosine) AS cosine,
    CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN o.license IS NULL THEN n.directory END AS directory
FROM files f LEFT JOIN own o USING (path) LEFT JOIN nearest n ON n.folder = regexp_extract(f.path, '^(.*)/[^/]*$', 1)"""

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, {words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
    JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

_BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {words("text", _BENCH)} AS w FROM documents),
items AS (SELECT item, w, least(13, len(w)) AS k FROM (
    SELECT item_id::VARCHAR AS item, {words("text", _BENCH)} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS x FROM (
    SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, i, w[i:i + k - 1] AS x FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, k, item FROM places JOIN windows USING (k, x)),
counts AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits)
    GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
    SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN found USING (doc_id)"""


INFILL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT % (length(t) + 1) AS x,
    ('0x' || h[9:16])::BIGINT % (length(t) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
    FROM d),
forms AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
        WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, left(t, a::BIGINT) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM parts"""

#: The remainder table of the checksum, as ``remainders.r``, and the checksum of a text with it.
CRC_TABLE = """remainders AS MATERIALIZED (SELECT list(r ORDER BY i) AS r FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM range(256) t(i)))"""


def crc32(text: str) -> str:
    """Needs ``remainders`` among the tables."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda a, b: xor(a >> 8, r[(xor(a, b) & 255) + 1])), 4294967295)"""


SHARDS = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, remainders),
trees AS (SELECT n, s, s % 4 AS region, s // 4 % 2 AS rack FROM (SELECT unnest([16, 17]) AS n), range(17) t(s) WHERE s < n),
paths AS (SELECT n, s, '/r' || region AS p1, '/r' || region || '/k' || rack AS p2,
    '/r' || region || '/k' || rack || '/s' || s AS p3 FROM trees),
nodes AS (SELECT DISTINCT n, unnest([p1, p2, p3]) AS path, unnest(['', p1, p2]) AS above FROM paths),
draws AS (SELECT doc_id, key, path, -ln((('0x' || sha256(path || ':' || key)[1:13])::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52)) AS draw
    FROM (SELECT DISTINCT doc_id, key FROM d), (SELECT DISTINCT path FROM nodes)),
best AS (SELECT key, n, above, arg_min(path, draw) AS path FROM draws JOIN nodes USING (path) GROUP BY key, n, above),
placed AS (SELECT a.key, a.n, paths.s FROM best a JOIN best b ON b.key = a.key AND b.n = a.n AND b.above = a.path
    JOIN best c ON c.key = a.key AND c.n = a.n AND c.above = b.path JOIN paths ON paths.n = a.n AND p3 = c.path WHERE a.above = '')
SELECT doc_id, size, text_crc32, 'key' AS law, x.s::INTEGER AS shard,
    row_number() OVER (PARTITION BY x.s ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, y.s::INTEGER AS grown_shard
FROM d JOIN placed x ON x.key = d.key AND x.n = 16 JOIN placed y ON y.key = d.key AND y.n = 17"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256({} || {} || {} || {{}} || {})".format(*(_FIELD.format(c) for c in ("doc_id", "source", "lang", "text")))
_TAMPERED = _FIELD.format("(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)")
#: Levels of (team, pos, node): pairs are hashed until one node of the team is left; ``sizes`` has what a team begins with.
_LEVEL = """SELECT team, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value(ceil(size / 2)::BIGINT)
    FROM {0} WHERE size > 1 GROUP BY team, level, pos // 2"""
#: A leaf's way up: the node it is under, the siblings so far and what the other leaf folds to.
_CLIMB = """SELECT c.leaf_at, c.team, c.level + 1, c.pos // 2, c.siblings || coalesce(s.node, ''),
        sha256(CASE WHEN s.pos < c.pos THEN s.node || c.fold ELSE c.fold || coalesce(s.node, '') END)
    FROM {1} c JOIN {0} own ON own.team = c.team AND own.level = c.level AND own.pos = c.pos AND own.size > 1
    LEFT JOIN {0} s ON s.team = c.team AND s.level = c.level AND s.pos = xor(c.pos, 1)"""
MANIFEST = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32("doc_id::VARCHAR")} END AS crc FROM documents, remainders),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS team, leaf, other, count(*) OVER (PARTITION BY lang) AS size,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos FROM (
        SELECT doc_id, lang, {_LEAF.format(_FIELD.format("n_chars"))} AS leaf, {_LEAF.format(_TAMPERED)} AS other FROM d)),
tree(team, level, pos, node, size) AS (SELECT team, 0, pos, leaf, size FROM leaves UNION ALL {_LEVEL.format("tree")}),
subroots AS (SELECT team, node, row_number() OVER (ORDER BY encode(team)) - 1 AS pos, count(*) OVER () AS size
    FROM tree WHERE size = 1),
top(team, level, pos, node, size) AS (SELECT '', 0, pos, node, size FROM subroots UNION ALL {_LEVEL.format("top")}),
climb(leaf_at, team, level, pos, siblings, fold) AS (SELECT pos, team, 0, pos, '', other FROM leaves
    UNION ALL {_CLIMB.format("tree", "climb")}),
arrived AS (SELECT leaf_at, team, siblings, fold FROM climb QUALIFY row_number() OVER (
    PARTITION BY team, leaf_at ORDER BY level DESC) = 1),
rise(leaf_at, team, level, pos, siblings, fold) AS (
    SELECT a.team || ' ' || a.leaf_at, '', 0, s.pos, a.siblings, a.fold FROM arrived a JOIN subroots s ON s.team = a.team
    UNION ALL {_CLIMB.format("top", "rise")}),
risen AS (SELECT leaf_at, siblings, fold FROM rise QUALIFY row_number() OVER (PARTITION BY leaf_at ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, t.node AS root, sha256(r.siblings) AS proof_sha256, r.fold AS folded_root,
    r.fold = t.node AS verified
FROM leaves l JOIN subroots s ON s.team = l.team JOIN risen r ON r.leaf_at = l.team || ' ' || l.pos
    JOIN top t ON t.size = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_preferences": PREFERENCES, "op2_licenses": LICENSES, "op9_near_dedup": NEAR_DEDUP,
            "op10_decontaminate": DECONTAMINATE, "op11_infill": INFILL, "op12_shards": SHARDS, "op13_manifest": MANIFEST}
