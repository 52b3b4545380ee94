"""Benchmark passages in documents, found with a generalised suffix automaton over words.

The automaton holds every stretch of words of every benchmark item. A document's words are streamed through
it; the longest match that ends at each word tells whether a window of an item (or a whole shorter item) ends
there. Stretches in which no window can end, because a word or a pair of neighbours is in no item, are found
with numpy beforehand and skipped; skipping them changes no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import free_name, others

#: Item words in one automaton. A larger benchmark takes several, one pass of a document's words for each.
SHARD_WORDS = 50_000
#: Characters of documents looked at in one go.
SLICE_CHARS = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before letters are lowered
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
SPANS = "array<struct<begin:int,end:int,`from`:int,`to`:int>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: ASCII letters in lower case, ASCII digits and whatever is not ASCII."""
    return (text or "").encode().translate(SPLIT).split()


@dataclass
class Automaton:
    """All stretches of the items' words. State 0 is the empty stretch."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    steps: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, set[str]] = field(default_factory=dict)  # items, by the state of each of their prefixes
    short: dict[int, set[str]] = field(default_factory=dict)  # items shorter than the window, by their state
    pairs: set[tuple[int, int]] = field(default_factory=set)
    least: int = 0

    def state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def split_off(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` for what ``p`` reaches over ``word``, if ``q`` also stands for longer stretches."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self.state(self.length[p] + 1, dict(self.steps[q]), self.link[q])
        while p != -1 and self.steps[p].get(word) == q:
            self.steps[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.steps[last]:
            return self.split_off(last, self.steps[last][word], word)
        new, p = self.state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.steps[p]:
            self.steps[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self.split_off(p, self.steps[p][word], word)
        return new

    def add(self, item: str, words: list[bytes], whole: bool) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        last = 0
        for w in ids:
            last = self.extend(last, w)
            self.ends.setdefault(last, set()).add(item)
        if whole and len(ids) < self.window:
            self.short.setdefault(last, set()).add(item)
        self.pairs.update(zip(ids, ids[1:], strict=False))
        self.least = min(self.least or self.window, len(ids))

    def finish(self) -> Automaton:
        """Spreads items to the states of their windows and short items to the states that end in them."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):  # what ends in a state also ends in the state it links to
            up = self.link[s]
            if s in self.ends and self.length[up] >= self.window:
                self.ends.setdefault(up, set()).update(self.ends.pop(s))
        self.base = [0] * len(self.link)  # the state of the last ``window`` words
        self.tails: list[list[tuple[int, set[str]]]] = [[] for _ in self.link]
        for s in order:
            up = self.link[s]
            self.base[s] = self.base[up] if self.length[up] >= self.window else s
            self.tails[s] = self.tails[up] + [(self.length[s], self.short[s])] if s in self.short else self.tails[up]
        n = len(self.vocabulary)
        self.keys = np.unique(np.array([a * n + b for a, b in self.pairs], np.int64))
        self.pairs = set()
        return self

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches of ``ids`` that windows cover, as [begin, end) in order, and the items they come from."""
        steps, link, length, window = self.steps, self.link, self.length, self.window
        state = size = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, w in enumerate(ids):
            while state and w not in steps[state]:
                state = link[state]
                size = length[state]
            state = steps[state].get(w, 0)
            size = size + 1 if state else 0
            begin = i + 1
            if size >= window:
                begin = i + 1 - window
                found |= self.ends[self.base[state]]
            for n, items in self.tails[state]:
                if n <= size:
                    begin = min(begin, i + 1 - n)
                    found |= items
            if begin <= i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, found

    def search(self, docs: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """What stream() finds in each document, for those in which it finds something."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.least:
            return out
        counts = np.array([len(d) + 1 for d in docs])
        starts = np.cumsum(counts) - counts
        ids = np.full(int(counts.sum()) + 1, -1, np.int64)  # -1 before, between and after documents
        for d, at in zip(docs, starts.tolist(), strict=True):
            ids[at + 1:at + 1 + len(d)] = np.fromiter(map(self.vocabulary.get, d, repeat(-1)), np.int64, len(d))
        gaps = np.flatnonzero(ids < 0)
        for a, b in zip(gaps[:-1], gaps[1:], strict=True):
            if b - a <= self.least:
                continue
            part = ids[a + 1:b]
            key = part[:-1] * len(self.vocabulary) + part[1:]
            at = np.searchsorted(self.keys, key)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
            cuts = np.r_[0, np.flatnonzero(~known) + 1, len(part)]
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x < self.least:
                    continue
                spans, items = self.stream(part[x:y].tolist())
                if spans:
                    shift = int(a) - int(starts[doc]) + x
                    old = out.setdefault(doc, ([], set()))
                    old[0].extend((shift + i, shift + j) for i, j in spans)
                    old[1].update(items)
        return out


def automata(items: Iterable[tuple[str, str | None]], window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata of at most ``shard_words`` words each; a longer item is cut into pieces that overlap by a window."""
    current, size = Automaton(window), 0
    for item, text in items:
        words = words_of(text)
        step = max(shard_words - window + 1, 1)
        for i in range(0, max(len(words) - window + 1, 1) if words else 0, step):
            piece = words[i:i + step + window - 1]
            if size and size + len(piece) > shard_words:
                yield current.finish()
                current, size = Automaton(window), 0
            current.add(item, piece, len(piece) == len(words))
            size += len(piece)
    yield current.finish()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item: str = "item_id",
            item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``items``, which replace columns of these names.

    ``spans`` are the parts of the text that windows of items cover, neither overlapping nor touching, as
    words [begin, end) and code points [from, to); a window is ``window`` consecutive words of an item, or a whole item of fewer words.
    ``items`` are the ids, as strings and sorted, of items with a window in the text. A null or empty text has
    no words; an item without words, or without an id, has no windows; rows with the same item id are one item.
    An empty table gives no rows, an empty benchmark no spans; texts of any length are streamed through as a whole.
    The benchmark is read in shards of ``shard_words`` words: neither the driver nor a task holds more of it.
    """
    session = docs.sparkSession
    rows = benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{item_text}`")).dropna()
    shards = [session.sparkContext.broadcast(a)
              for a in automata(((r[0], r[1]) for r in rows.toLocalIterator()), window, shard_words)]
    new = ("n_words", "spans", "items")
    kept, whole = others(docs, new), free_name(docs, "_source")
    source = docs.select(F.col(f"`{text}`").cast("string").alias(whole), *(F.col(f"`{c}`") for c in kept),
                         F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType())])
    for shard in shards:
        source = source.select(whole, *(F.col(f"`{c}`") for c in kept), "spans", "items").mapInArrow(
            _searching(shard), schema)
    return source.drop(whole).withColumns({
        "spans": _merged(F.coalesce("spans", F.array().cast(SPANS))),
        "items": F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))})


def _searching(shard):
    """Adds what one shard finds to the spans and items, and counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lengths = batch.schema.names, pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_pylist()
            start = 0
            while start < len(lengths):
                stop, chars = start, 0
                while stop < len(lengths) and (stop == start or chars + lengths[stop] <= SLICE_CHARS):
                    chars += lengths[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                texts = part.column(0).to_pylist()
                words = [words_of(t) for t in texts]
                spans, items = part.column(names.index("spans")), part.column(names.index("items"))
                if found := shard.value.search(words):
                    spans, items = spans.to_pylist(), items.to_pylist()
                    for i, (where, which) in found.items():
                        at = [m.span() for m in WORD.finditer(texts[i])]
                        spans[i] = (spans[i] or []) + [
                            {"begin": a, "end": b, "from": at[a][0], "to": at[b - 1][1]} for a, b in where]
                        items[i] = (items[i] or []) + sorted(which)
                    spans = pa.array(spans, part.schema.field("spans").type)
                    items = pa.array(items, part.schema.field("items").type)
                own = {"spans": spans, "items": items}
                yield pa.RecordBatch.from_arrays(
                    [*(own.get(n, c) for n, c in zip(names, part.columns, strict=True)),
                     pa.array([len(w) for w in words], pa.int64())], names=[*names, "n_words"])
                start = stop

    return run


def _merged(spans):
    """Spans in order; those that overlap or touch, found in different shards, become one."""
    def join(done, s):
        last = F.element_at(done, -1)
        both = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"),
                        last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), F.array().cast(SPANS), join))


def n_hit(spans="spans"):
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def contaminated(share: int = 20):
    """At least one word in ``share`` is hit, and one at all."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def without_spans(matched: DataFrame, longest: int = 50, share: int = 20, text: str = "text",
                  out: str = "text") -> DataFrame:
    """Replaces ``text`` by what is left when spans beyond a limit are cut out of it.

    Cut out are spans of more than ``longest`` words and, where contaminated(share) holds, all spans. What
    stands between spans stays as it is; a null text stays null.
    """
    cut = F.when(contaminated(share), F.col("spans")).otherwise(
        F.filter("spans", lambda s: s["end"] - s["begin"] > longest))
    source = F.col(f"`{text}`")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"))
    left = F.aggregate(cut, begin, lambda a, s: F.struct(
        s["to"].alias("at"), F.concat(a["left"], source.substr(a["at"] + 1, s["from"] - a["at"])).alias("left")),
        lambda a: F.concat(a["left"], source.substr(a["at"] + 1, F.length(source) - a["at"])))
    return matched.withColumn(out, F.when(F.size(cut) > 0, left).otherwise(source))
