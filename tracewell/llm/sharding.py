"""Shards by a hierarchical weighted hash tree: regions hold racks, racks hold shards, and each row descends them.

At each level a row draws a number for every child of the node it has reached, from a hash of its key and the child's
path: -ln(u) / weight, whose smallest falls on each child in proportion to its weight. The row goes on into that
child. A draw depends on nothing but key, path and weight, so a change of weight, a new or a lost child moves rows only
into or out of that child and leaves all below its siblings where it is. Weights of racks and regions are set, not
summed from below: a new shard therefore draws from its own rack alone, and what it gains goes into it and nowhere else.

All of it is expressions over a constant tree; no row meets another one until slots are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.llm.common import ranked

#: Children of the root, and of each of them, in a tree that grows one shard at a time.
REGIONS, RACKS = 4, 2


@dataclass(frozen=True)
class Node:
    """A region or rack with its children, or a shard with its number; ``name`` is unique among siblings."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    def __post_init__(self):
        names = [c.name for c in self.children]
        if not 0 < self.weight < float("inf") or len(set(names)) < len(names) or any("/" in n for n in names):
            raise ValueError(f"{self.name!r}: weights must be positive and names of children different, without '/'")
        if (self.shard is None) != bool(self.children):
            raise ValueError(f"{self.name!r}: a node has either children or a number of a shard")

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def even(count: int, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """A tree of ``count`` shards dealt to regions in turn, and in each of them to racks in turn, all of weight 1.

    Each shard more is one node more: a shard of a rack, or a new rack or region that holds it. So ``even(n + 1)``
    takes rows from the siblings of that node only, and into the new shard only. Loads are equal where shards
    fill all racks alike; between that, shards of the fuller racks get less.
    """
    if count < 1 or regions < 1 or racks < 1:
        raise ValueError("a tree needs a shard, a region and a rack at least")
    return Node("", children=tuple(
        Node(f"r{r}", children=tuple(
            Node(f"k{k}", children=tuple(
                Node(f"s{s}", shard=s) for s in range(r + regions * k, count, regions * racks)))
            for k in range(racks) if r + regions * k < count))
        for r in range(regions) if r < count))


def _drawn(key: Column, children: Column) -> Column:
    """The child of the smallest draw, equal ones by path: 52 bits of a hash as a number in (0, 1), over the weight."""

    def draw(child: Column) -> Column:
        digest = F.sha2(F.concat(child["path"], F.lit(":"), key), 256)
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"), child["below"].alias("below"))

    return F.array_min(F.transform(children, draw))["below"]


def _constant(node: Node, path: str = "") -> Column:
    """What is below a node: its children, or its shard."""
    if node.shard is not None:
        return F.lit(node.shard)
    return F.array(*(F.struct(
        F.lit(f"{path}/{c.name}").alias("path"), F.lit(float(c.weight)).alias("weight"),
        _constant(c, f"{path}/{c.name}").alias("below")) for c in node.children))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that a key descends to: region, then rack, then shard, each time the child of the smallest draw.

    Draws are made for the children of the nodes that the row reaches, not for the whole tree. A null key is the
    empty string.
    """
    if any(rack.shard is not None or any(s.shard is None for s in rack.children) for r in tree.children for rack in r.children or [r]):
        raise ValueError("a tree has three levels below its root: regions, racks and shards")
    key = F.coalesce(key.cast("string"), F.lit(""))
    return _drawn(key, _drawn(key, _drawn(key, _constant(tree))))


def sharded(df: DataFrame, tree: Node, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``df`` with the number of the shard each row goes to; rows of equal keys go together, null ones are as empty.

    Adds or replaces one column. A row's shard depends on its key and the tree alone: repeated rows and any order or
    partitioning give the same, an empty table gives no rows. The key may be of any type that casts to a string.
    """
    return df.withColumn(shard, shard_of(F.col(f"`{key}`"), tree))


def slotted(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds a row's place in its shard, from 0 without gaps, by ``order`` (null first; rows equal in it follow each other).

    Rows are sorted in ranges of (shard, order), so a shard of any size is spread over tasks.
    """
    return ranked(df, [shard], order, slot)


def assigned(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row, and ``grown_shard`` in a tree ``grown``.

    ``size`` is the text's bytes in UTF-8 plus 1 and ``text_crc32`` their checksum, both of no bytes for a null
    text. Slots go by key (as text and number alike the given type orders it), then by checksum and size. The
    texts are read once; only these columns move. Other columns of ``docs`` play no part.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    name = F.col(f"`{key}`")
    rows = docs.select(
        name.alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(name, tree).alias("shard"),
        (shard_of(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    return slotted(materialize(rows, "sharded"), "shard", ["key", "text_crc32", "size"]).withColumnRenamed("key", key)
