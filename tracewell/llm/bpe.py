"""Byte pair encoding and decoding with a public vocabulary file, by batched numpy merge rounds.

Method. Texts are cut at spaces; what a task has not seen yet is normalised and split into words, and those are
laid out as one flat array of symbols. A round finds the rank of every neighbouring pair by binary search
over the sorted pair keys, takes each word's lowest rank, and merges those pairs in all words at once.
Words without a known pair leave the array.

One by one, the pair of lowest rank and then furthest left is merged. Merging all places of that pair in one
round gives the same, unless the new symbol starts or ends a pair of still lower rank; such ranks are found
when the model is read, and only their first place in a word is merged in a round.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import free_name, others

NONE = np.int64(1 << 40)
#: Chunks of text kept in a task's cache, and characters of short texts looked at in one go.
CACHE_CHUNKS, SLICE_CHARS = 250_000, 1 << 20


@dataclass
class Model:
    """What encoding and decoding need of a vocabulary file; a few megabytes, whatever the corpus."""

    pattern: str
    special: dict[str, int]
    tokens: list[str]
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at the end of a word
    keys: np.ndarray  # sorted: left << 20 | right
    ranks: np.ndarray
    made: np.ndarray  # by rank
    careful: np.ndarray  # by rank: the new symbol is part of a pair of lower rank


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable in Latin-1."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def read_model(path: str) -> Model:
    """Reads a ``tokenizers`` JSON file of a lower-casing BPE with word ends, on the driver."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in [*vocab.items(), *special.items()]:
        tokens[i] = token
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    rank = np.arange(len(merges))
    lowest = np.full(len(tokens), NONE)  # the lowest rank of a pair that a symbol is part of
    np.minimum.at(lowest, left, rank)
    np.minimum.at(lowest, right, rank)
    keys = left << 20 | right
    order = np.argsort(keys, kind="stable")
    letters = byte_letters()
    pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Model(pattern, special, tokens, np.array([vocab[c] for c in letters], np.int64),
                 np.array([vocab[c + suffix] for c in letters], np.int64), keys[order], rank[order], made,
                 lowest[made] < rank)


def pair_ranks(left: np.ndarray, right: np.ndarray, model: Model) -> np.ndarray:
    """The rank of each pair of symbols, NONE for pairs that don't merge, by binary search."""
    key = left << 20 | right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    return np.where(model.keys[at] == key, model.ranks[at], NONE)


def merge_words(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words (none of them empty), one word after the other, and how many each has."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    symbols, ends = model.first[flat], np.cumsum(lengths) - 1
    symbols[ends] = model.last[flat[ends]]
    word = np.repeat(np.arange(len(words)), lengths)
    rank = np.full(len(symbols), NONE)  # of the pair that begins here
    rank[:-1] = pair_ranks(symbols[:-1], symbols[1:], model)
    rank[ends] = NONE
    out = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            finished = np.repeat(done, sizes)
            out.append((word[finished], symbols[finished]))
            symbols, word, rank = symbols[~finished], word[~finished], rank[~finished]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        place = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # Of places that overlap (aaa), every other one counts, from the left.
        run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
        place = place[(np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))) % 2 == 0]
        first = np.r_[True, word[place][1:] != word[place][:-1]]
        place = place[first | ~model.careful[rank[place]]]
        symbols[place] = model.made[rank[place]]
        rank[place] = NONE
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        # Only the pairs on either side of a new symbol have changed.
        new = place - np.arange(len(place))
        new = np.r_[new, new[new > 0] - 1]
        new, ends = new[new < len(symbols) - 1], new[new == len(symbols) - 1]
        rank[ends] = NONE
        rank[new] = np.where(word[new] == word[new + 1], pair_ranks(symbols[new], symbols[new + 1], model), NONE)
    word, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``begin, size`` of ``values``, one after the other."""
    shift = begin - np.cumsum(size) + size
    return values[np.arange(size.sum()) + np.repeat(shift, size)]


class Encoder:
    """Encodes whole texts chunk by chunk, a chunk being what stands between spaces, with a bounded cache of chunks.

    No word, special token or composed character reaches over a space, so chunks can be encoded apart.
    """

    def __init__(self, model: Model):
        self.model = model
        self.words = regex.compile(model.pattern).findall
        names = sorted(model.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str | int, int] = {}
        self.ids, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, size: np.ndarray) -> None:
        self.cache |= zip(keys, range(len(self.cache), len(self.cache) + len(keys)), strict=True)
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
        self.size, self.ids = np.r_[self.size, size], np.r_[self.ids, ids.astype(np.int32)]

    def at(self, chunks: list[str | int]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, chunks), np.int64, len(chunks))

    def chunks(self, text: str) -> list[str | int]:
        """The normalised text cut at spaces; special tokens, looked for before that, are their ids."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [c for i, p in enumerate(parts) for c in ([self.model.special[p]] if i % 2 else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Letters are lowered one by one: a capital sigma becomes the same letter at the end of a word too.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text.replace("\n", " ").split(" ")

    def learn(self, chunks: set[str | int]) -> None:
        new = chunks.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.forget()
            new = chunks
        numbers = [c for c in new if isinstance(c, int)]
        self.add(numbers, np.array(numbers), np.ones(len(numbers), np.int64))
        words, mixed = set(), {}
        for c in new.difference(numbers):
            if c.isalpha():
                words.add(c)
            elif c[-1:] in (".", ",") and c[:-1].isalpha():
                mixed[c] = [c[:-1], c[-1]]
            else:
                mixed[c] = self.words(c)
        parts = [w for ws in mixed.values() for w in ws]
        words = list(words.union(parts).difference(self.cache))
        if words:
            self.add(words, *merge_words([w.encode() for w in words], self.model))
        count = np.fromiter(map(len, mixed.values()), np.int64, len(mixed))
        at, owner = self.at(parts), np.repeat(np.arange(len(mixed)), count)
        size = np.bincount(owner, self.size[at], len(mixed)).astype(np.int64)
        ids = gathered(self.ids, self.begin[at], self.size[at])
        whole = np.array([c not in self.cache for c in mixed], bool)  # a chunk of a single mark is known by now
        self.add([c for c, w in zip(mixed, whole, strict=True) if w], ids[np.repeat(whole, size)], size[whole])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        chunks = [self.chunks(t) for t in texts]
        self.learn(set().union(*chunks))
        of = np.concatenate([self.at(c) for c in chunks])
        text = np.repeat(np.arange(len(texts)), [len(c) for c in chunks])
        size = np.bincount(text, self.size[of], len(texts)).astype(np.int64)
        return gathered(self.ids, self.begin[of], self.size[of]), size


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str, model: Model) -> Encoder:
    """One encoder for each Python worker, whose cache then serves all tasks that run in it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(model)
    return _ENCODERS[path]


def shared_model(spark: SparkSession, path: str):
    """The model of the file at ``path`` as a broadcast variable; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(read_model(path))


def slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths come to SLICE_CHARS at most, or of one longer row."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > SLICE_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of each whole text (``array<int>``; null and empty texts give an empty array).

    Replaces a column named as ``ids`` if there is one; all other columns stay as they are. Strings of special
    tokens inside a text become those tokens. Repeated rows stay repeated, an empty table gives no rows, and a
    very long text is a slice of its own. ``decoded`` also adds what decode()
    makes of the ids, in the same pass.
    """
    model = shared_model(df.sparkSession, path)
    new = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    kept = others(df, new)
    source = df.select(F.col(f"`{text}`").cast("string").alias(free_name(df, "_source")), *(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = encoder_for(path, model.value), np.array(model.value.tokens, object)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist()
            for a, b in slices(lengths):
                part = batch.slice(a, b - a)
                flat, size = encoder.encode([x or "" for x in part.column(0).to_pylist()])
                arrays = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(flat, pa.int32()))]
                if decoded:
                    arrays.append(pa.array(joined(tokens, flat, size), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *arrays], names=[*kept, *new])

    schema = T.StructType([*source.schema.fields[1:]])
    for name, kind in new.items():
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if kind == "array<int>" else T.StringType())
    return source.mapInArrow(run, schema)


def joined(tokens: np.ndarray, flat: np.ndarray, size: np.ndarray) -> list[str]:
    """The tokens of each run of ids, joined by one space."""
    ends = np.cumsum(size).tolist()
    return [" ".join(tokens[flat[b - n:b]].tolist()) for b, n in zip(ends, size.tolist(), strict=True)]


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids: the tokens, special ones included, joined by one space.

    The vocabulary file names no decoder, so word ends and stand-ins of bytes stay as they are written in it.
    A null array gives an empty text; an id that is not in the vocabulary is an error.
    """
    model = shared_model(df.sparkSession, path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = np.array(model.value.tokens, object)
        for arrays in batches:
            yield pd.Series(["" if a is None else " ".join(tokens[a].tolist()) for a in arrays], dtype=object)

    return df.withColumn(text, decoded(F.col(f"`{ids}`")))
