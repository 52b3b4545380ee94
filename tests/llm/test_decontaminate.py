"""Benchmark windows against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - window + 1)):
                windows[tuple(w[i:i + window])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in set(map(len, windows)):
            for i in range(len(w) - size + 1):
                if items_here := windows.get(tuple(w[i:i + size])):
                    hit |= set(range(i, i + size))
                    found |= items_here
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_automaton(seed):
    rng = random.Random(seed)
    letters = "abc"[:rng.choice([2, 3])]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(1, 6))]
    docs = [(i, " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 25)))) for i in range(8)]
    window = rng.choice([2, 3, 4])
    shards = list(D.automata(((str(i), t) for i, t in items), window, rng.choice([8, 1000])))
    for doc, (_, n_hit, found, _) in brute(docs, items, window).items():
        hit, which = set(), set()
        for shard in shards:
            spans, names = shard.search([D.words_of(t) for _, t in docs]).get(doc, ([], set()))
            hit |= {i for a, b in spans for i in range(a, b)}
            which |= names
        assert (len(hit), sorted(which)) == (n_hit, found)


ITEMS = [(1, "The quick brown Fox jumps"), (2, "fox"), (3, None), (None, "lazy dog"), (4, "--"), (5, "über den, FLUSS!")]
DOCS = [(1, "A b. The  QUICK-brown fox jumps, over"), (2, None), (3, ""), (4, "nothing here"), (5, "fox" + " z" * 30),
        (5, "fox" + " z" * 30), (6, "Über\nden fluss"), (7, "a über den fluss über den fluss"), (8, "lazy dog")]


@pytest.mark.parametrize("shard_words", [4, 1000])
def test_frames(spark, shard_words):
    docs = spark.createDataFrame([(d, t, "old", 1) for d, t in DOCS], "doc_id long, text string, items string, begin int")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    found = D.matches(docs, items, window=3, shard_words=shard_words)
    assert {"doc_id", "text", "begin", "n_words", "spans", "items"} == set(found.columns)
    rows = found.select("doc_id", "n_words", D.n_hit().alias("hit"), "items", D.contaminated().alias("bad")).collect()
    assert len(rows) == len(DOCS)
    assert {r[0]: tuple(r[1:]) for r in rows} == brute(DOCS, ITEMS, 3)
    # Places are those of the words in the text.
    for r in found.where("size(spans) > 0").collect():
        for s in r.spans:
            assert words(r.text[s["from"]:s["to"]]) == words(r.text)[s["begin"]:s["end"]]


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = D.matches(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), window=3)
    left = {r.doc_id: r.text for r in D.without_spans(found, longest=4).collect()}
    assert left[1] == "A b. , over" and left[2] is None and left[3] == "" and left[4] == "nothing here"
    assert left[5] == DOCS[4][1] and left[6] == "Über\nden fluss" and left[7] == "a "


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).where(D.n_hit() > 0).count() == 0
    assert D.matches(docs.limit(0), none).select(F.col("n_words")).collect() == []
