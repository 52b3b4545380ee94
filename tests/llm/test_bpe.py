"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import pytest

from tracewell.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    yield from ["", " ", "\n\n", "Hello, World's don't WE'LL x²", "ΣΑΣ İstanbul ﬁ１２ é é", "\x85　\xa0\x1c​",
                "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|endoftext", "a" * 3000, "ha" * 500 + "h", "é" * 99 + "!" * 50]
    for _ in range(400):
        yield "".join(rng.choice("abAB  'st'llre\n\t12<|>é.,-") for _ in range(rng.randint(0, 80)))
    for _ in range(200):
        yield "".join(rng.choice("haHA") for _ in range(rng.randint(0, 60)))


def test_same_as_library(library):
    given = list(texts())
    flat, size = bpe.Encoder(bpe.read_model(PATH)).encode(given)
    expected = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == expected


def test_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 20)
    encoder = bpe.Encoder(bpe.read_model(PATH))
    for text in texts():
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_careful_ranks():
    """A model in which a merge makes a pair of lower rank: one by one, the new pair goes first."""
    letters = bpe.byte_letters()
    names = [*letters, *(c + "</w>" for c in letters), "ab", "aba"]
    number = {t: i for i, t in enumerate(names)}
    merges = [("ab", "a"), ("a", "b")]
    left, right = (np.array([number[m[i]] for m in merges]) for i in (0, 1))
    made = np.array([number[a + b] for a, b in merges])
    keys = left << 20 | right
    order = np.argsort(keys)
    model = bpe.Model("", {}, names, np.arange(256), np.arange(256) + 256, keys[order], np.arange(2)[order], made,
                      np.array([False, True]))
    ids, _ = bpe.merge_words([b"ababx"], model)
    assert [names[i] for i in ids] == ["aba", "b", "x</w>"]


def test_frames(spark, library):
    rows = [(1, None, 5, "x"), (2, "", 6, "x"), (3, "Hello World", 7, "y"), (3, "Hello World", 7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    both = bpe.encode(df, PATH, decoded="decoded")
    got = sorted((r.doc_id, r.text, r.ids, r.decoded) for r in both.collect() if r.text is not None)
    ids = library.encode("Hello World", add_special_tokens=False).ids
    text = library.decode(ids, skip_special_tokens=False)
    assert got == [(2, "", [], ""), (3, "Hello World", ids, text), (3, "Hello World", ids, text)]
    assert both.where("text IS NULL").select("ids", "decoded").first() == ([], "")
    apart = bpe.decode(bpe.encode(df, PATH, ids="own"), PATH, ids="own", text="back")
    assert apart.columns == ["doc_id", "text", "ids", "decoded", "own", "back"]
    assert sorted(r.back for r in apart.collect()) == ["", "", text, text]
    assert bpe.encode(df.limit(0), PATH, decoded="d").collect() == []
