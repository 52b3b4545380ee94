"""Lempel-Ziv fingerprints against a parse of each whole text."""

import hashlib
import random

import pytest

from tracewell.llm import lz


def plain(text):
    seen, phrase = set(), ""
    for c in text or "":
        if phrase + c in seen:
            phrase += c
        else:
            seen.add(phrase + c)
            phrase = ""
    return lz.as_text(lz.least(sorted(seen)))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, lz.likeness(a, b), lz.likeness(a, c)))
    return out


@pytest.mark.parametrize("count", [1, 4, 50])
def test_against_whole_parses(spark, count):
    rng = random.Random(2)
    rows = [(rng.randrange(10 ** 6), "".join(rng.choice("abcdé 𝔘\n") for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))))
            for _ in range(70)]
    rows += [(10 ** 6 + 1, None), (10 ** 6 + 2, ""), (10 ** 6 + 3, "same"), (10 ** 6 + 4, "same")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, at int, range int")
    got = lz.edited_and_next(df, count=count)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)


def test_ties_and_missing_ids(spark):
    rows = [(None, "n"), (None, "m"), (5, "bb"), (5, "aa"), (5, "aa"), (9, "z")]
    got = lz.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string"), count=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)
    single = lz.edited_and_next(spark.createDataFrame([(1, "abc")], "doc_id long, text string"))
    assert list(map(tuple, single.collect())) == expected([(1, "abc")])
    assert lz.edited_and_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "abcabc", 3), (4, "abcabc", 3)]
    df = lz.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int"))
    got = {r.doc_id: r.fingerprint for r in df.collect()}
    assert got == {1: "", 2: "", 3: plain("abcabc"), 4: plain("abcabc")}
    assert lz.likeness("", "") == 1 and lz.likeness("", got[3]) == 0 and lz.likeness(got[3], got[4]) == 1
