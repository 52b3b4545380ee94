"""One very long text among short, empty and missing ones, in the operators whose own tests have none."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, lz, minhash, quality

rng = random.Random(7)
WORDS = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(5000)]
LONG = " ".join(rng.choices(WORDS, k=200_000))
ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG + " and a few words more"), (3, LONG[:700_000] + " " + ITEM + " " + LONG[700_000:]), (4, None), (5, ""), (6, "short text")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([("a", ITEM), ("b", "not there at all " * 5)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, items).collect()}
    assert {d for d, r in got.items() if r["items"]} == {3} and got[3]["items"] == ["a"] and got[3].n_words >= 200_020
    (span,) = got[3].spans
    assert span["end"] - span["begin"] == 20 and [got[d].n_words for d in (4, 5, 6)] == [0, 0, 2]


def test_near_duplicates(docs):
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True)}


def test_fingerprints(docs):
    got = {r.doc_id: r.fingerprint for r in lz.fingerprinted(docs).collect()}
    assert got[4] == got[5] == "" and lz.likeness(got[1], got[2]) > 0.9 > 0.3 > lz.likeness(got[1], got[6])


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, quality int")
    taught = spark.createDataFrame([(i, ("good plain words of prose here " if i % 2 else "zzz 999 !!! ") * 30) for i in range(100, 160)],
                                   "doc_id long, text string")
    model = quality.fit(taught, labels)
    rows = quality.scored(docs, model).select("doc_id", F.col("score").between(0, 1).alias("ok")).collect()
    assert len(rows) == 6 and all(r.ok for r in rows)
