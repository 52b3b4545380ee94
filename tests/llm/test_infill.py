"""Fill-in-middle examples against slices of plain strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import infill as I


def plain(doc, text, percent=90, spm_percent=20, seed=1, unit="char", markers=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    at = list(range(len(text))) if unit == "char" else [
        i for i in range(len(text)) if not i or text[i] not in " \t\n\v\f\r" and text[i - 1] in " \t\n\v\f\r"]
    n = len(at)
    if not n or any(m in text for m in markers) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = ([*at, len(text)][i] for i in (a, b))
    p, s, m = markers
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, s + text[y:] + p + text[:x] + m + text[x:y]
    return n, "psm", a, b - a, p + text[:x] + s + text[y:] + m + text[x:y]


def rows(rng):
    shared = "".join(rng.choice("abc dé\n𝔘ñ") for _ in range(9000))
    texts = [None, "", "x", " ", "<P", "a <S> b", "<M>", "𝔘" * 5000, "a" * 100_000, " " * 3000, "word " * 20_000]
    texts += [rng.choice("xyzé") * rng.randrange(700) + shared[rng.randrange(2000):rng.randrange(3000, 9000)] for _ in range(60)]
    texts += ["y" * rng.randrange(400) + shared[:k] + "<M>" + shared[k:] for k in rng.sample(range(9000), 20)]
    return list(enumerate(texts)) + [(7, "equal ids"), (7, "equal ids"), (None, "no id"), (10 ** 12, "big id")]


@pytest.mark.parametrize("unit", I.UNITS)
def test_against_slices(spark, unit):
    given = rows(random.Random(3))
    df = spark.createDataFrame([(d, t, "own", 5, None) for d, t in given],
                               "doc_id long, text string, _source string, form int, _key string")
    got = I.fill_in_middle(df, unit=unit, percent=80, cache_bytes=40_000)
    assert set(got.columns) == {"doc_id", "text", "_source", "_key", "n_units", "form", "prefix_units", "middle_units", "output"}
    got = got.withColumn("back", I.restored())
    expected = [(d, t, *plain(d, t, 80, unit=unit)) for d, t in given]
    out = [(r.doc_id, r.text, r.n_units, r.form, r.prefix_units, r.middle_units, r.output) for r in got.collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert got.where("back <> coalesce(text, '') OR _source <> 'own'").count() == 0
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert I.fill_in_middle(df.limit(0)).collect() == []


def test_parameters(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", "four five"), ("c", "x|y")], "name string, body string")
    markers = ("(p)", "[s]", "{m}")
    got = I.fill_in_middle(df, "name", "body", "made", "word", 100, 100, 9, markers).withColumn("back", I.restored("made", "form", markers))
    for r in got.collect():
        assert (r.n_units, r.form, r.prefix_units, r.middle_units, r.made) == plain(r.name, r.body, 100, 100, 9, "word", markers)
        assert r.back == r.body
    for wrong in (("<P>", "<S>"), ("a", "a", "b"), ("ab", "bc", "x"), ("", "x", "y"), ("aba", "x", "y"), ("<P>", "P", "y"), ("x" * 300, "y", "z")):
        with pytest.raises(ValueError):
            I.fill_in_middle(df, "name", "body", markers=wrong)
    with pytest.raises(ValueError):
        I.fill_in_middle(df, "name", "body", unit="token")
    empty = df.select(F.lit("n").alias("form"), F.lit("psm").cast("string").alias("output")).select(
        F.lit(None).cast("string").alias("form"), "output").withColumn("back", I.restored())
    assert {r.back for r in empty.collect()} == {None}


def test_chunks_are_shared_and_checked(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(I, "SEGMENT", 1000)
    passage = bytes(rng.randrange(97, 123) for _ in range(60_000))
    data = b"".join([passage, rng.randbytes(5000).hex().encode(), passage[100:], b"q" * 40_000])
    found = I.ends(np.frombuffer(data, np.uint8))
    monkeypatch.setattr(I, "SEGMENT", 1 << 22)
    assert found == I.ends(np.frombuffer(data, np.uint8)) and found == sorted(found)
    cache = I.Chunks([b"<P>"])
    bounds = [0, 60_000, 70_000, 129_900, 169_900]
    texts = [I.Text(data, a, b, found, cache) for a, b in zip(bounds, bounds[1:])]
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert t.bounds[0] == a and t.bounds[-1] == b and t.units == b - a
        sizes = [y - x for x, y in zip(t.bounds, t.bounds[1:])]
        assert max(sizes) <= I.MOST and all(s >= I.LEAST for s in sizes[:-1])
        assert [t.place(k) for k in (0, 1, (b - a) // 2, b - a - 1, b - a)] == [a, a + 1, a + (b - a) // 2, b - 1, b]
    # The passage's second occurrence begins elsewhere and still falls into chunks that are known.
    assert cache.shared > 0.8 * (len(texts[2].bounds) - 1)
    small = I.Chunks([b"<P>"], most=5000)
    for a, b in zip(bounds, bounds[1:]):
        assert I.Text(data, a, b, found, small).units == b - a and small.size <= max(5000, I.MOST)
    assert small.size == sum(map(len, small.kept))
    # Chunks of one hash value are told apart by their bytes.
    class Same(bytes):
        def __hash__(self):
            return 1
    cache = I.Chunks([])
    assert cache[Same(b"abc")].inner == 2 and cache[Same(b"ab")].inner == 1 and cache.shared == 0


def test_markers_across_chunks():
    text = "".join(random.Random(6).choices("abcdefgh ij", k=20_000))
    bounds = I.Text(text.encode(), 0, len(text), I.ends(np.frombuffer(text.encode(), np.uint8)), I.Chunks([b"<P>"])).bounds
    assert len(bounds) > 5
    for at in bounds[1:-1]:
        for shift in (-3, -2, -1, 0):
            data = (text[:at + shift] + "<P>" + text[at + shift + 3:]).encode()
            t = I.Text(data, 0, len(data), [b for b in bounds[1:]], I.Chunks([b"<P>", b"<S>", b"<M>"]))
            assert t.marked
