"""Merkle manifests against a tree that is hashed level by level, and its siblings looked up."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_by_level(nodes):
    """All levels from the nodes to their root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append(("<" if at % 2 else ">") + nodes[at ^ 1] if at ^ 1 < len(nodes) else "-")
        at //= 2
    return out


def leaf(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def test_streams():
    for size in (*range(1, 40), 64, 65, 100):
        nodes = [H(str(i)) for i in range(size)]
        levels = level_by_level(nodes)
        stream = M.Stream()
        witnesses = [stream.append(n) for n in nodes]
        # What is open are whole subtrees of falling height, and their witnesses are complete up to them.
        heights = [h for h, _, _ in stream.open]
        assert heights == sorted(set(heights), reverse=True) and sum(1 << h for h in heights) == size
        assert all(len(w) == h for h, _, own in stream.open for w in own)
        assert stream.close() == levels[-1][0]
        assert witnesses == [siblings(levels, i) for i in range(size)]
        assert {M.folded(n, w) for n, w in zip(nodes, witnesses)} == {levels[-1][0]}
        assert len(nodes) == 1 or M.folded(H("other"), witnesses[0]) != levels[-1][0]


def rows(rng, count):
    langs = [None, "en", "en", "en", "en", "zz", "é", "EN", ""]
    texts = [None, "", "text", "é𝔘", "a:b-", "long " * 20_000]
    out = [(i, rng.choice(langs), rng.choice(texts), rng.choice([None, 0, 7, 123])) for i in rng.sample(range(10 ** 6), count)]
    return out + [(5, "one", "alone", 1), (None, "en", "no id", 1), (None, "en", None, None), *[(9, "en", "repeated", 3)] * 4]


@pytest.mark.parametrize("levels,count", [(1, 150), (2, 400), (10, 400)])
def test_against_levels(spark, levels, count):
    given = rows(random.Random(levels), count)
    df = spark.createDataFrame([(*r, "clash", 1) for r in given],
                               "doc_id long, lang string, text string, n_chars long, team string, at int").repartition(5)
    n = F.col("n_chars")
    made = (M.leaf_digest(F.col("doc_id"), F.col("lang"), n, F.col("text")),
            M.leaf_digest(F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, n + 1).otherwise(n), F.col("text")))
    manifest = M.built(df, F.col("lang"), F.col("doc_id"), *made, levels=levels)
    got = M.proven(manifest, "doc_id").collect()

    groups = {}
    for d, lang, text, n in given:
        other = n + 1 if n is not None and d is not None and d % 3 == 0 else n
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf(d, lang, n, text), leaf(d, lang, other, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: level_by_level([r[2] for r in sorted(groups[g])]) for g in order}
    top = level_by_level([trees[g][-1][0] for g in order])
    expected = []
    for j, g in enumerate(order):
        for i, (known, d, own, other) in enumerate(sorted(groups[g])):
            way = siblings(trees[g], i) + siblings(top, j)
            root = other
            for s in way:
                root = H(s[1:], root) if s[0] == "<" else H(root, s[1:])
            expected.append((d if known else None, own, other, trees[g][-1][0], top[-1][0], way, H(*(s[1:] for s in way)), root, root == top[-1][0]))
    assert manifest.root == top[-1][0]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert {r.verified for r in got} == {True, False}


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    one = M.leaf_digest(F.col("id"), F.col("name"))
    row = M.proven(M.built(df, F.lit(None).cast("string"), F.col("name"), one), "at").first()
    assert row == ("x", leaf(1, "x"), leaf(1, "x"), leaf(1, "x"), leaf(1, "x"), [], H(""), leaf(1, "x"), True)
    manifest = M.built(df.limit(0), F.col("name"), F.col("id"), one)
    assert manifest.root is None and M.proven(manifest).collect() == []
    assert M.proven(manifest, "id").schema["id"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("levels,cuts", [(2, (0, 1, 4, 17, 60, 60, 200)), (10, (50, 200))])
def test_appending_is_building(spark, levels, cuts):
    rng = random.Random(levels)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", f"late{i // 50}"]), f"text {i}") for i in range(200)]
    columns = "id long, team string, text string"
    leaf = M.leaf_digest(F.col("id"), F.col("text"))
    parts = [rows[a:b] for a, b in zip((0, *cuts), cuts)]
    manifest, sofar = M.built(spark.createDataFrame(parts[0], columns), F.col("team"), F.col("id"), leaf, levels=levels), parts[0]
    for part in parts[1:]:
        before = {(r.team, r.block): r.root for r in manifest.roots.collect()}
        manifest = M.appended(manifest, spark.createDataFrame(part, columns), F.col("team"), F.col("id"), leaf)
        sofar = sofar + part
        assert all({(r.team, r.block): r.root for r in manifest.roots.collect()}[k] == before[k]
                   for k in {(r.team, r.block) for r in manifest.blocks.where(f"size(nodes) = {1 << levels}").collect()} & before.keys()
                   if k in before and len([x for x in sofar[:-len(part) or None] if (f"={x[1]}" if x[1] is not None else "") == k[0]]) >= (k[1] + 1) << levels)
    whole = M.built(spark.createDataFrame(rows, columns), F.col("team"), F.col("id"), leaf, levels=levels)
    assert manifest.root == whole.root
    assert sorted(map(tuple, M.proven(manifest).collect())) == sorted(map(tuple, M.proven(whole).collect()))
    with pytest.raises(Exception, match="does not come after"):
        M.appended(manifest, spark.createDataFrame([(3, "a", "early")], columns), F.col("team"), F.col("id"), leaf)
