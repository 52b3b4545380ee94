"""Fill-in-middle examples: texts cut in three at drawn places and put together again around markers.

Places are drawn in units of a text (code points, or words), so its units must be counted and found. A text is
cut into chunks where a rolling hash of its last bytes says so, hence equal passages of different texts fall into equal
chunks. What is known of a chunk, its boundary summary, is computed once and kept in a cache by its content: a
chunk met again is compared byte by byte with the one kept, never by its hash alone. Summaries of neighbours
combine: the units of a text are those inside its chunks and those that begin where chunks meet, and sums of these
counts say which chunk holds a cut; only that chunk is looked into.

Chunks may end inside a character or a marker; the summaries carry what the neighbour needs to know of that.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.bpe import slices
from tracewell.llm.common import free_name, others

#: Bytes that the rolling hash sees, and its top bits that are zero at the end of a chunk.
WINDOW, BITS = 32, 10
#: A chunk's least and most bytes, but for the last of a text; the least is more than the window and any marker.
LEAST, MOST = 256, 1 << 14
#: Bytes of text whose hashes are held at a time, and bytes of chunks in a task's cache.
SEGMENT, CACHE_BYTES = 1 << 22, 1 << 25
UNITS = ("char", "word")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)


def ends(data: np.ndarray) -> list[int]:
    """Places after which the hash of the last ``WINDOW`` bytes ends a chunk, in ascending order."""
    found = []
    for start in range(0, len(data), SEGMENT):
        before = min(start, WINDOW - 1)
        h = _GEAR[data[start - before:start + SEGMENT]]
        width = 1
        while width < WINDOW:  # each round doubles the bytes that a hash has seen
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0)
        found += (at[at >= before] + (start - before + 1)).tolist()
    return found


def chunks(found: list[int], start: int, stop: int) -> list[int]:
    """Where the chunks of the text at [start, stop) end, of all places ``found``."""
    out, at = [], start
    while stop - at > LEAST:
        k = bisect_left(found, at + LEAST)
        at = min(found[k] if k < len(found) else stop, at + MOST, stop)
        out.append(at)
    if at < stop or not out:
        out.append(stop)
    return out


class Summary(NamedTuple):
    """What neighbours and whole texts need of a chunk."""

    inner: int  # units that begin after its first byte
    first: tuple[int, int]  # whether one begins at its first byte, after a byte that goes on and one that breaks
    breaks: bool  # whether a unit begins at whatever may begin one, right after the chunk
    marked: bool  # whether a marker lies inside
    head: bytes  # too short for a marker, long enough for the part of one that crosses
    tail: bytes


def begins(chunk: bytes, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte; at the first one, after a byte that breaks."""
    b = np.frombuffer(chunk, np.uint8)
    if unit == "char":
        return b & 0xC0 != 0x80
    word = ~SPACE[b]
    word[1:] &= SPACE[b[:-1]]
    return word


class Chunks:
    """Summaries by content, the oldest of which go when they come to more than ``most`` bytes."""

    def __init__(self, markers: Sequence[bytes], unit: str = "char", most: int = CACHE_BYTES):
        self.markers, self.unit, self.most, self.size = markers, unit, most, 0
        self.kept: dict[bytes, Summary] = {}
        self.edge = max(map(len, markers), default=1) - 1
        self.met = self.shared = 0

    def __getitem__(self, chunk: bytes) -> Summary:
        self.met += 1
        if known := self.kept.get(chunk):  # finds an equal chunk: the bytes are compared after the hash
            self.shared += 1
            return known
        at = begins(chunk, self.unit)
        new = Summary(
            int(np.count_nonzero(at[1:])), (int(at[0]) if self.unit == "char" else 0, int(at[0])),
            self.unit == "char" or bool(SPACE[chunk[-1]]), any(m in chunk for m in self.markers),
            chunk[:self.edge], chunk[max(len(chunk) - self.edge, 0):])
        self.kept[chunk] = new
        self.size += len(chunk)
        while self.size > self.most and len(self.kept) > 1:
            oldest = next(iter(self.kept))
            del self.kept[oldest]
            self.size -= len(oldest)
        return new


class Text:
    """The text at [start, stop) of ``data``, known by its chunks."""

    def __init__(self, data: bytes, start: int, stop: int, found: list[int], cache: Chunks):
        self.data, self.stop, self.unit = data, stop, cache.unit
        bounds = [start, *chunks(found, start, stop)] if stop > start else [start]
        known = [cache[data[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        # A unit begins at the first byte of a text, whatever it is.
        self.first = [1, *(s.first[p.breaks] for p, s in zip(known, known[1:], strict=False))] if known else []
        self.before = [0, *accumulate(s.inner + f for s, f in zip(known, self.first, strict=True))]
        self.bounds, self.units = bounds, self.before[-1]
        # All chunks but the last are longer than a marker, so one that crosses is in two neighbours.
        self.marked = any(s.marked for s in known) or any(
            m in p.tail + s.head for p, s in zip(known, known[1:], strict=False) for m in cache.markers)

    def place(self, unit: int) -> int:
        """Where in ``data`` the unit of this number begins, or the text ends."""
        if unit >= self.units:
            return self.stop
        k = bisect_right(self.before, unit) - 1
        at = begins(self.data[self.bounds[k]:self.bounds[k + 1]], self.unit)
        at[0] = self.first[k]
        return self.bounds[k] + int(np.flatnonzero(at)[unit - self.before[k]])


def _check(markers: Sequence[str]) -> None:
    """Markers must be told from the text around them wherever they stand."""
    crossing = any(
        a != b and b in a or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) for a in markers for b in markers)
    if len(markers) != 3 or len(set(markers)) < 3 or not all(markers) or crossing:
        raise ValueError("three different markers are needed, none of which holds another or begins as one ends")
    if any(len(m.encode()) > LEAST for m in markers):
        raise ValueError(f"a marker may have {LEAST} bytes at most")


def fill_in_middle(df: DataFrame, doc: str = "doc_id", text: str = "text", output: str = "output", unit: str = "char",
                   percent: int = 90, spm_percent: int = 20, seed: int = 1,
                   markers: Sequence[str] = (PREFIX, SUFFIX, MIDDLE), cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Adds ``n_units long, form string, prefix_units long, middle_units long`` and the ``output``.

    A text is cut before two of its units, or at its end, and becomes prefix, middle and suffix. Form ``psm`` puts
    them out as prefix, suffix, middle, form ``spm`` as suffix, prefix, middle, each after its one of ``markers``
    (prefix, suffix, middle); form ``plain`` is the text as it is, with null for the two lengths. ``percent`` of all texts are not plain,
    ``spm_percent`` of these are spm; empty texts and those that hold a marker are always plain. All draws come from
    the SHA-256 of seed and id, so the same row gets the same example wherever it is. A ``unit`` is a code point
    (``char``), or a word with the ASCII space after it (``word``; space before the first word is one of its own).

    A null text is an empty one and a null id an empty string; rows of equal ids draw the same numbers, and an empty table
    gives no rows. Columns of these names are replaced, all others stay. Nothing is shuffled. A task holds one Arrow
    batch, the hashes of ``SEGMENT`` bytes and ``cache_bytes`` of chunks: a text of any length is read in one pass.
    """
    _check(markers)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    new = {"n_units": T.LongType(), "form": T.StringType(), "prefix_units": T.LongType(), "middle_units": T.LongType(),
           output: T.StringType()}
    kept = others(df, new)
    whole, key = free_name(df, "_source"), free_name(df, "_key")
    source = df.select(F.col(f"`{text}`").cast("string").alias(whole), F.col(f"`{doc}`").cast("string").alias(key),
                       *(F.col(f"`{c}`") for c in kept))
    p, s, m = (x.encode() for x in markers)

    def example(key: str | None, t: Text, start: int) -> tuple:
        digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
        if not t.units or t.marked or h3 % 100 >= percent:
            return t.units, "plain", None, None, t.data[start:t.stop]
        a, b = sorted((h1 % (t.units + 1), h2 % (t.units + 1)))
        x, y = t.place(a), t.place(b)
        before, inside, after = t.data[start:x], t.data[x:y], t.data[y:t.stop]
        if h4 % 100 < spm_percent:
            return t.units, "spm", a, b - a, b"".join((s, after, p, before, m, inside))
        return t.units, "psm", a, b - a, b"".join((p, before, s, after, m, inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks((p, s, m), unit, cache_bytes)
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                texts = [(x or "").encode() for x in part.column(0).to_pylist()]
                data = b"".join(texts)
                # No chunk is shorter than the window, so no hash that counts has seen two texts.
                found = ends(np.frombuffer(data, np.uint8))
                at = [0, *accumulate(map(len, texts))]
                rows = [example(k, Text(data, x, y, found, cache), x)
                        for k, x, y in zip(part.column(1).to_pylist(), at, at[1:], strict=False)]
                n, form, first, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=[*kept, *new])

    schema = T.StructType([*source.schema.fields[2:], *(T.StructField(c, k) for c, k in new.items())])
    return source.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of, as an expression of it and its form; null if one of them is."""
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in markers), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, third, second)).when(
        F.col(form) == "spm", F.concat(second, third, first)).when(F.col(form).isNotNull(), F.col(output))
