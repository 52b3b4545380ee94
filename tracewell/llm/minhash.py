"""Near duplicates by MinHash: many universal hash minima, banding, signature verification, components.

Texts with equal shingle sets form a class, represented by its smallest document. Representatives meet in the
buckets of their bands. Each bucket's smallest member, its hub, is compared with all others; after the links
confirmed so have been joined to components, members that a bucket still holds of different components are
compared with each other in blocks, inside tasks. So no two similar texts of a bucket stay in different
components, however large it is. Signatures must agree before texts are compared, and only texts that have such
a partner move; all links are confirmed on full sets. The documents of a hub are cut into numbered parts, each of
which gets the hub's signature and text, so that a hub of any size is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracewell.functions.storage import materialize
from tracewell.llm.common import ranked
from tracewell.llm.components import components

#: So many documents of a hub are compared with it in one part.
PART = 500

#: Odd multipliers of the shingle hash; any would do.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Scheme:
    """What two texts must share: ``percent`` of the union of their sets of ``words``-word shingles.

    ``rows`` minima form a band. There are so many bands that a pair at the limit shares none with a
    probability of at most ``miss``; the limit for the signatures lies six standard deviations lower.
    """

    words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-8

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def agreeing(self) -> int:
        """So many of the minima, kept as bytes, must be equal."""
        s, n = self.percent / 100, self.rows * self.bands
        return math.floor(n * (s - 6 * math.sqrt(s * (1 - s) / n)))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers and summands of the universal hash functions, modulo 2^32."""
        rng = np.random.default_rng(20)
        size = self.rows * self.bands
        return (rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1),
                rng.integers(0, 1 << 32, size, np.uint32))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: ASCII letters in lower case, cut at ASCII space.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    total = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        total = (total + hashed[i:len(hashed) - size + 1 + i]) * MIX[0]
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def minima(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that is not empty; in blocks that fit the cache."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 256):
        hashed = np.multiply.outer(folded[i:i + 256], multiply)
        hashed += add
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row of minima; keys of different bands differ."""
    bands = least.reshape(len(least), -1, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]) * MIX[2]
    for i in range(rows):
        total = (total + bands[:, :, i]) * MIX[0]
        total ^= total >> np.uint64(29)
    return _mixed(total).view(np.int64)


def id_type(docs: DataFrame, doc: str) -> str:
    """``long`` for whole numbers, else ``string``."""
    return "long" if isinstance(docs.select(f"`{doc}`").schema[0].dataType, IntegralType) else "string"


def _id(docs: DataFrame, doc: str) -> Column:
    return F.col(f"`{doc}`").cast(id_type(docs, doc))


def _links(found: list, kind: str) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["hub", "doc"], dtype=np.int64 if kind == "long" else object)


def signatures(docs: DataFrame, scheme: Scheme, doc: str, text: str) -> DataFrame:
    """``doc, n, high, low, bands, signature``: set size, digest of the set, band keys and the low byte of each minimum."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        multiply, add = scheme.functions()
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start:start + 1024]
                sizes, digests = np.zeros(len(part), np.int64), np.zeros((len(part), 2), np.uint64)
                least = np.zeros((len(part), len(multiply)), np.uint32)
                for i, whole in enumerate(part["text"]):
                    shingles = shingle_set(whole, scheme.words)
                    sizes[i] = len(shingles)
                    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
                    digests[i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
                    if len(shingles):
                        least[i] = minima(shingles, multiply, add)
                yield pd.DataFrame({
                    "doc": part["doc"].array, "n": sizes, "high": digests[:, 0].view(np.int64),
                    "low": digests[:, 1].view(np.int64), "bands": list(band_keys(least, scheme.rows)),
                    "signature": [x.tobytes() for x in least.astype(np.uint8)]})

    return docs.select(_id(docs, doc).alias("doc"), F.col(f"`{text}`").alias("text")).mapInPandas(
        sign, f"doc {id_type(docs, doc)}, n long, high long, low long, bands array<long>, signature binary")


def _similar(pairs: DataFrame, signed: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``hub, doc, part`` whose signatures agree in enough places; ``part`` numbers a hub's documents by PART.

    ``pairs`` are distinct and written.
    """
    parts = ranked(pairs, ["hub"], ["doc"], "rank").select(
        "hub", "doc", F.floor(F.col("rank") / PART).alias("part"))
    heads = parts.select("hub", "part").distinct().join(
        signed.select(F.col("doc").alias("hub"), F.col("signature").alias("y")), "hub")
    joined = parts.join(signed.select("doc", F.col("signature").alias("x")), "doc").join(heads, ["hub", "part"])

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in "xy")
                yield batch.loc[(x == y).sum(axis=1) >= scheme.agreeing, ["hub", "doc", "part"]]

    kind = signed.schema["doc"].dataType.simpleString()
    return joined.mapInPandas(agree, f"hub {kind}, doc {kind}, part long")


def _confirmed(pairs: DataFrame, docs: DataFrame, scheme: Scheme, doc: str, text: str) -> DataFrame:
    """The pairs ``hub, doc`` of ``hub, doc, part`` whose full sets are similar enough.

    Documents are shuffled once to their pairs; the texts of pairs then meet by part, each with the hub's text.
    """
    kind = id_type(docs, doc)
    ends = pairs.select("hub", "part", F.col("doc").alias("id"), F.lit(1).alias("role")).unionByName(
        pairs.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("id"), F.lit(0).alias("role")))
    texts = docs.select(_id(docs, doc).alias("id"), F.col(f"`{text}`").alias("text"))
    # The same join at every size: the pairs grow with the documents.
    met = texts.join(ends.hint("merge"), "id").repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, of = None, None
        for batch in batches:
            found = []
            for hub, role, own, whole in zip(batch["hub"], batch["role"], batch["id"], batch["text"], strict=True):
                if role == 0:
                    at, of = hub, shingle_set(whole, scheme.words)
                    continue
                if alike(of, shingle_set(whole, scheme.words), scheme.percent):
                    found.append((at, own))
            yield _links(found, kind)

    return met.mapInPandas(compare, f"hub {kind}, doc {kind}")


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each group, whole; those of equal keys come one after the other."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        at = batch[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.iloc[a:b]
        held = batch.iloc[starts[-1]:]
    if held is not None:
        yield held


def _agreeing(group: pd.DataFrame, root: np.ndarray, scheme: Scheme) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of two blocks the later ones of other components whose signatures agree, and how far.

    ``root`` are the members' components, which the caller may join in between. Members of the same block are compared
    where it meets itself only.
    """
    signs = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
    own = group["own"].to_numpy()
    apart = group["low"].iat[0] != group["high"].iat[0]
    for i in range(len(group) - 1):
        at = np.flatnonzero((root[i + 1:] != root[i]) & (not apart or own[i + 1:] != own[i])) + i + 1
        agree = (signs[at] == signs[i]).sum(axis=1)
        enough = agree >= scheme.agreeing
        yield i, at[enough], agree[enough]


def _left_over(shared: DataFrame, joined: DataFrame, signed: DataFrame, docs: DataFrame, scheme: Scheme, block: int,
               doc: str, text: str) -> DataFrame:
    """Links ``hub, doc`` that join components: between members of a bucket, but its hub, of different ones.

    Members meet in blocks, first with their signatures alone. Those with a partner there whose signature agrees
    meet again with their texts, and are compared on their full sets, the likeliest first, unless links found in the
    same two blocks have joined their components by then.
    """
    kind = id_type(docs, doc)
    members = shared.where("doc != hub").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component"))
    buckets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"),
        F.bit_xor(F.xxhash64("doc")).alias("who"), F.sum(F.hash("doc").cast("long")).alias("which"))
    # Many bands give the same bucket; one of each will do.
    keys = buckets.where("least < most").groupBy("n", "who", "which").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("n") / block).alias("blocks"))
    left = members.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(1)), "blocks"))
    left = materialize(left.join(signed.select("doc", "signature"), "doc").select(
        "key", "doc", "own", "blocks", F.col("component").alias("root"), "signature"), "left-over")
    meeting = ["key", "low", "high"]

    def met(members: DataFrame) -> DataFrame:
        return members.repartition(*meeting).sortWithinPartitions(*meeting, "own", "doc")

    # Each member's signature goes to every pair of blocks that its own block is part of.
    spread = met(left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc", "root",
        "signature"))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, meeting):
            likely = np.zeros(len(group), bool)
            for i, at, _ in _agreeing(group, group["root"].to_numpy(), scheme):
                likely[at] = True
                likely[i] |= len(at) > 0
            yield group.loc[likely, [*meeting, "doc"]]

    likely = spread.mapInPandas(partners, f"key long, low long, high long, doc {kind}")
    # A text is joined once a bucket, and goes only to the pairs of blocks that hold a partner.
    places = materialize(likely.groupBy("key", "doc").agg(F.collect_list(F.struct("low", "high")).alias("at")), "partners")
    texts = docs.select(_id(docs, doc).alias("doc"), F.col(f"`{text}`").alias("text"))
    wanted = texts.join(left.join(places, ["key", "doc"]).hint("merge"), "doc").withColumn("at", F.explode("at")).select(
        "key", "at.low", "at.high", "own", "doc", "root", "signature", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, meeting):
            ids, root = group["doc"].to_numpy(), group["root"].to_numpy().copy()
            sets = [shingle_set(t, scheme.words) for t in group["text"]]
            found = []
            for i, at, agree in _agreeing(group, root, scheme):
                for j in at[np.argsort(-agree, kind="stable")]:
                    if root[j] != root[i] and alike(sets[i], sets[j], scheme.percent):
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        root[root == root[j]] = root[i]
            yield _links(found, kind)

    return met(wanted).mapInPandas(compare, f"hub {kind}, doc {kind}").distinct()


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), doc: str = "doc_id", text: str = "text",
                    block: int = 512) -> DataFrame:
    """``doc, n_shingles, component_id, kept`` for every row of ``docs``; other columns play no part.

    Documents are linked if their shingle sets are similar enough under ``scheme``; ``component_id`` is the
    smallest id that links lead to, ``kept`` marks the document of that id. A null or empty text has no
    shingles and is linked with nothing. Rows of equal id are one document for links; each gets its row, and
    all are kept or none. A row without an id is linked with nothing and never kept; its component is null.
    ``block`` is how many members of a bucket meet in a task at a time; it changes no result. Ids of whole numbers come
    back as longs and are ordered as numbers, all others as texts. An empty table gives no rows; the whole of a very
    long text enters its set.
    """
    signed = materialize(signatures(docs, scheme, doc, text), "signatures")
    classes = materialize(signed.where("n > 0 AND doc IS NOT NULL").groupBy("high", "low").agg(
        F.min("doc").alias("doc")), "classes")
    first = signed.join(classes, ["high", "low", "doc"]).dropDuplicates(["doc", "high", "low"])
    first = materialize(first.select("doc", "bands", "signature"), "representatives")
    buckets = first.select(F.explode("bands").alias("key"), "doc")
    hubs = buckets.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("most")).where("hub < most")
    # Written, so that both sides of the join are shuffles of its own, which adaptive execution splits where a key is hot.
    hubs = materialize(hubs.select("key", "hub"), "hubs")
    shared = materialize(buckets.join(hubs, "key"), "buckets")
    met = materialize(shared.where("doc != hub").select("hub", "doc").distinct(), "met")
    pairs = _similar(met, first, scheme)
    links = materialize(_confirmed(materialize(pairs, "pairs"), docs, scheme, doc, text), "confirmed")
    joined = materialize(components(links, "hub", "doc"), "components")
    more = _left_over(shared, joined, first, docs, scheme, block, doc, text)
    joined = components(links.unionByName(more), "hub", "doc")
    of_class = classes.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select(
        "high", "low", F.coalesce("component", "doc").alias("component"))
    out = signed.select("doc", "n", "high", "low").join(of_class, ["high", "low"], "left").select(
        "doc", F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc")).alias(
            "component_id"))
    return out.select(F.col("doc").alias(doc), "n_shingles", "component_id", F.coalesce(
        F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"))
