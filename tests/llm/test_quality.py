"""Compression scores: held-out accuracy, edge cases."""

import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    df = spark.range(50).withColumn("held", quality.held_out("id"))
    assert {r.id: r.held for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def made(n=240):
    rng = random.Random(1)
    good = ["".join(rng.choice("aeiou") + rng.choice("ntrsl") for _ in range(3)) for _ in range(60)]
    bad = ["".join(rng.choice("QXZ$%#") for _ in range(6)) for _ in range(60)]
    return [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randint(20, 90))), int(i % 4 > 0))
            for i in range(n)]


def test_learns_and_scores(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (901, "", "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (7777, 0), (3, 9)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.scored(docs, model)
    assert set(found.columns) == {"doc_id", "text", "score"} and found.count() == len(rows) + 3
    scores = {r.doc_id: r.score for r in found.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i] >= 0.5) == (i % 4 > 0) for i in held) >= 0.97 * len(held)


def test_held_out_labels_play_no_part(spark):
    rows = made(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    learn = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    flipped = learn + [(i, 1 - y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (learn, flipped))
    assert (a.good, a.bad, a.weights.tolist()) == (b.good, b.bad, b.weights.tolist())


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = quality.fit(docs, given)
        assert model is None and quality.scored(docs, model).first().score == 0.5
    assert quality.scored(docs.limit(0), None).collect() == []


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out())
    right = scored.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.97
