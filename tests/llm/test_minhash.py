"""Near duplicates against all pairs compared in plain Python."""

import random
import re
import string

import pytest

from tracewell.llm import minhash
from tracewell.llm.components import components


def sets_of(rows, words):
    out = {}
    for doc, text in rows:
        low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[doc] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += rng.randint(1, 3)
            if rng.random() < 0.3:
                base = copy  # chains: the ends of a group may be unlike
    rows += [(n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "one"),
             (n + 6, "Éa b c"), (n + 7, "éa b c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,block", [(3, 85, 512), (5, 80, 2)])
def test_against_all_pairs(spark, words, percent, block):
    rows = corpus(words)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, key string")
    got = minhash.near_duplicates(df, minhash.Scheme(words, percent), block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert found == brute(rows, words, percent)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(2, "a b c d"), (2, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, None), (7, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Scheme(3, 85))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (None, 2, None, False), (7, 0, 7, True), (7, 0, 7, True)],
        key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_text_ids_and_small_parts(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "PART", 2)
    rows = [(f"d{d}", t) for d, t in corpus(seed)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), minhash.Scheme(3, 85), block=3)
    assert got.schema["component_id"].dataType.simpleString() == "string"
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 3, 85)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []


def test_members_apart_from_the_hub_meet(spark):
    """The hub of the buckets is unlike two members that are alike: only the comparison in blocks joins them."""
    common = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(common[:88] + [f"x{i}" for i in range(12)])),
            (1, " ".join([f"y{i}" for i in range(9)] + common[:97])), (2, " ".join([f"y{i}" for i in range(9)] + common))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Scheme(1, 90))
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 1, 2: 1}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    links += [(3, 3), (None, 4), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    groups = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            union = groups.get(a, {a}) | groups.get(b, {b})
            groups |= {n: union for n in union}
    assert got == {n: min(g) for n, g in groups.items()}
