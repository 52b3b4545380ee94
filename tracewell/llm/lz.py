"""Fingerprints of documents from their Lempel-Ziv phrases, for a likeness akin to compressing texts together.

A text is parsed from left to right into dictionary phrases: each is the shortest stretch that the dictionary
does not hold yet, which then enters it. The set of phrases is hashed; the smallest value of each of many hash
functions over the set makes the fingerprint. The share of equal places in two fingerprints estimates how much
of their phrases two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.minhash import minima

#: Hash functions, of whose minima the low 16 bits are kept.
PLACES = 128
ROWS = 256  # texts taken from an Arrow batch at a time
_rng = np.random.default_rng(4)
MULTIPLY = _rng.integers(0, 1 << 31, PLACES, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, PLACES, np.uint32)
NOTHING = np.full(PLACES, 0xFFFFFFFF, np.uint32)


def parse(text: str, seen: set[str], phrase: str = "") -> tuple[list[str], str]:
    """The phrases that ``text`` adds to ``seen``, which gets them, and the unfinished one at the end."""
    new = []
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def least(phrases: list[str]) -> np.ndarray:
    """The minimum of each hash function."""
    if not phrases:
        return NOTHING
    return minima(np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases)), MULTIPLY, ADD)


def as_text(minimum: np.ndarray) -> str:
    """Four hexadecimal digits a place; nothing for a text without phrases."""
    return "" if (minimum == NOTHING).all() else minimum.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of places at which two fingerprints are equal; 1 for two empty ones, 0 for one."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(t), np.uint16) for t in (a, b))
    return float((x == y).mean())


class Parsed:
    """A text's fingerprint, and its parse up to the middle, from where it can go on with another second half."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.half = len(self.text) // 2
        self.seen: set[str] = set()
        phrases, self.phrase = parse(self.text[:len(self.text) - self.half], self.seen)
        self.least = least(phrases)
        self.fingerprint = self.going_on(self.text[len(self.text) - self.half:])

    def going_on(self, rest: str) -> str:
        phrases, _ = parse(rest, self.seen, self.phrase)
        self.seen.difference_update(phrases)
        return as_text(np.minimum(self.least, least(phrases)))

    def edited(self, after: Parsed) -> tuple[str, str]:
        """The text with its second half replaced by the beginning of ``after``, and its fingerprint."""
        rest = after.text[:self.half]
        return self.text[:len(self.text) - self.half] + rest, self.going_on(rest)


def fingerprinted(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text, empty for null and empty texts; equal texts have equal ones."""
    @F.pandas_udf("string")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(least(parse(t or "", set())[0])) for t in texts], dtype=object)

    return df.withColumn(fingerprint, fingerprints(F.col(f"`{text}`")))


def ranges(docs: DataFrame, doc: str, count: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds that cut the ids into about equal ranges, and the smallest id of each range that isn't empty.

    Both have at most ``count`` numbers, however many documents there are.
    """
    bounds = docs.agg(F.percentile_approx(doc, [i / count for i in range(1, count)], 20 * count)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    firsts = docs.groupBy(place(doc).alias("range")).agg(F.min(doc)).collect()
    return bounds, {r[0]: r[1] for r in sorted(firsts)}


def edited_and_next(docs: DataFrame, doc: str = "doc_id", text: str = "text", count: int | None = None) -> DataFrame:
    """Each document against its edited text and the next document, by ascending id, the first after the last.

    Gives ``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every
    row. The edited text has its last half (rounded down) replaced by as many code points from the beginning
    of the next document, or all if it has fewer. A null text is empty; a row without an id comes first; rows
    of equal id follow each other in the order of their texts. Other columns play no part. Ids must be numbers, or texts of
    numbers. A document alone is its own next, an empty table gives no rows, and a very long text is parsed as a whole.

    Documents are dealt out by ranges of ids, the first of a range also to the range before it, so that every
    task has the documents that follow its own.
    """
    session = docs.sparkSession
    count = count or 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    # A missing id sorts first.
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(
        F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("at"), F.col(text).cast("string").alias("text"))
    bounds, firsts = ranges(docs, "at", count)
    used = list(firsts)
    before = {firsts[r]: used[i - 1] for i, r in enumerate(used)}  # the range that also needs this document

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(), side="right").tolist()
        return pd.Series([[r, before[i]] if i in before else [r] for r, i in zip(own, ids.tolist(), strict=True)],
                         dtype=object)

    dealt = docs.select("doc", "at", "text", F.posexplode(places("at")).alias("guard", "range"))
    dealt = dealt.repartition(max(count // 4, 1), "range").sortWithinPartitions("range", "guard", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, over = None, None, False  # the row that waits for its next, its range, whether a guard was seen
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                out = []
                for row in batch.slice(start, ROWS).to_pylist():
                    if row["range"] != of:
                        held, of, over = None, row["range"], False
                    if over:
                        continue
                    parsed = Parsed(row["text"])
                    if held is not None:
                        out.append(compared(*held, parsed))
                    held, over = (row["doc"], parsed), bool(row["guard"])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=NAMES)

    return dealt.select("range", "guard", "doc", "text").mapInArrow(
        run, "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double").withColumnRenamed("doc", doc)


NAMES = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(doc: int | None, own: Parsed, after: Parsed) -> tuple:
    text, edited = own.edited(after)
    return (doc, len(own.text), hashlib.sha256(text.encode()).hexdigest(), own.fingerprint, edited,
            likeness(own.fingerprint, edited), likeness(own.fingerprint, after.fingerprint))
