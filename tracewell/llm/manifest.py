"""A Merkle manifest of a dataset: one digest that vouches for every row, and for each row the witness that proves it.

Rows are leaves, ordered within groups; nodes of a level are hashed two by two, a last one without a partner alone, until
one is left for the group. The groups' digests, in order of the groups, are hashed up to the root in the same way.

Witnesses grow with the tree. A ``Stream`` takes nodes one after another and keeps the open subtrees, whole ones of
ever smaller size, each with the partial witnesses of its leaves. When a subtree gets a sibling of its size, the two are one,
and each extends the witnesses of the other's leaves by its own root. Leaves are dealt out in aligned blocks, each block is one stream,
and the roots of blocks are appended to streams of the next round in the same way: a block's witness continues those of all its
leaves. Rounds follow until one node of each group is left; each shortens the table by the size of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.llm.common import ranked

#: Leaves of a whole block are two to the power of this.
BLOCK_LEVELS = 10
#: Marks before a sibling's digest in a witness, and the step of a node that has none.
LEFT, RIGHT, ALONE = "<", ">", "-"


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of texts one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Stream:
    """Nodes appended in order, as open subtrees ``(height, root, witnesses of its nodes)`` of falling height."""

    def __init__(self):
        self.open: list[tuple[int, str, list[list[str]]]] = []

    def append(self, node: str) -> list[str]:
        """Takes the next node and gives its witness, which grows as siblings are completed."""
        witness: list[str] = []
        self._add(0, node, [witness])
        return witness

    def _add(self, height: int, root: str, witnesses: list[list[str]]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, before = self.open.pop()
            for w in before:
                w.append(RIGHT + root)
            for w in witnesses:
                w.append(LEFT + left)
            height, root, witnesses = height + 1, digest(left, root), before + witnesses
        self.open.append((height, root, witnesses))

    def close(self, height: int | None = None) -> str:
        """Hashes what is open up to one root, at ``height`` if given, and gives it. Nothing may be appended after that."""
        while len(self.open) > 1 or height is not None and self.open[0][0] < height:
            at, root, witnesses = self.open.pop()
            for w in witnesses:
                w.append(ALONE)
            self._add(at + 1, digest(root), witnesses)
        return self.open[0][1]


def folded(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for step in witness:
        side, sibling = step[0], step[1:]
        leaf = digest(sibling, leaf) if side == LEFT else digest(leaf, sibling)  # none is an empty text
    return leaf


def proof(witness: list[str]) -> str:
    """The digest of all siblings in a witness."""
    return digest(*(step[1:] for step in witness))


def block_stream(nodes: list[str], block: int, levels: int) -> tuple[str, list[list[str]]]:
    """Root and witnesses of one aligned block. All blocks rise to the same level but the only one of a group."""
    stream = Stream()
    witnesses = [stream.append(n) for n in nodes]
    return stream.close(levels if block else None), witnesses


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: each field as its count of bytes in UTF-8, a colon and its text, or ``-`` if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts)), 256)


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``team, block, nodes``: the nodes of each aligned block in order, at most two to the power of ``levels``."""
    entry = F.struct("at", *(c for c in nodes.columns if c not in ("team", "at")))
    return nodes.groupBy("team", F.shiftright("at", levels).alias("block")).agg(
        F.sort_array(F.collect_list(entry)).alias("nodes"))


def _roots(blocks: DataFrame, levels: int, witnesses: bool) -> DataFrame:
    """``team, block, root`` of each block and, if asked for, the witnesses of its nodes."""
    kind = blocks.schema["team"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one block at a time
                row = batch.slice(i, 1)
                of = row.column(1)[0].as_py()
                root, paths = block_stream(row.column(2)[0].as_py(), of, levels)
                columns = [row.column(0), row.column(1), pa.array([root])]
                if witnesses:
                    columns.append(pa.array([paths], pa.list_(pa.list_(pa.string()))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["team", "block", "root"] + ["witnesses"] * witnesses
    return blocks.select("team", "block", F.col("nodes.node").alias("nodes")).mapInArrow(
        run, f"team {kind}, block long, root string" + ", witnesses array<array<string>>" * witnesses)


def _risen(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """``team, root`` of each team of ``team, at, node``, and ``team, at, witness`` of every node up to there.

    Teams are not null. Rounds of streams over blocks, of which each has a table of its nodes' witnesses.
    """
    rounds = []
    while True:
        rounds.append(materialize(_roots(_blocks(nodes, levels), levels, True), "rounds"))
        if not rounds[-1].agg(F.max("block")).first()[0]:
            break
        nodes = rounds[-1].select("team", F.col("block").alias("at"), F.col("root").alias("node"))
    tops = rounds[-1].select("team", "root")
    above = None
    for table in reversed(rounds):
        own = table.select("team", "block", F.posexplode("witnesses").alias("i", "witness")).select(
            "team", "block", (F.shiftleft("block", levels) + F.col("i")).alias("at"), "witness")
        if above is not None:
            own = own.join(above.select("team", F.col("at").alias("block"), F.col("witness").alias("rest")), ["team", "block"]
                           ).withColumn("witness", F.concat("witness", "rest"))
        above = materialize(own.select("team", "at", "witness"), "witnesses")
    return tops, above


@dataclass(frozen=True)
class Manifest:
    """Written tables of a tree. ``blocks`` has the leaves, ``tops`` for each block the subroot and the rest of its witnesses."""

    blocks: DataFrame  # team, block, nodes: array<struct<at, node, id, other>>
    roots: DataFrame  # team, block, root
    tops: DataFrame  # team, block, subroot, rest: array<string>
    root: str | None
    levels: int


def _leaves(rows: DataFrame, group: Column, order: Column, leaf: Column, other: Column | None) -> DataFrame:
    """``team, id, node, other, at``: the leaves of ``rows`` in order within teams, which are never null and ordered as groups."""
    team = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = materialize(rows.select(
        team.alias("team"), order.alias("id"), leaf.alias("node"), (leaf if other is None else other).alias("other")), "leaves")
    return ranked(leaves, ["team"], ["id", "node", "other"], "at")


def _finished(blocks: DataFrame, roots: DataFrame, levels: int) -> Manifest:
    """The manifest over written blocks and their roots, which are appended to streams in turn."""
    if roots.isEmpty():
        return Manifest(blocks, roots, roots.select("team", "block", F.col("root").alias("subroot"),
                                                    F.array().cast("array<string>").alias("rest")), None, levels)
    subroots, in_team = _risen(roots.select("team", F.col("block").alias("at"), F.col("root").alias("node")), levels)
    subroots = materialize(subroots, "subroots")
    places = ranked(subroots, [], ["team"], "at").select(F.lit("").alias("all"), "team", "at", F.col("root").alias("node"))
    top, among = _risen(places.select(F.col("all").alias("team"), "at", "node"), levels)
    rest = places.join(among.select("at", "witness"), "at").select("team", F.col("node").alias("subroot"), "witness")
    tops = in_team.withColumnRenamed("witness", "own").join(rest, "team").select(
        "team", F.col("at").alias("block"), "subroot", F.concat("own", "witness").alias("rest"))
    return Manifest(blocks, roots, materialize(tops, "tops"), top.first()["root"], levels)


def built(rows: DataFrame, group: Column, order: Column, leaf: Column, other: Column | None = None,
          levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``rows``, whose ``leaf`` digests ascend by ``order`` (null first, then equal ones by digest) in each ``group``.

    A null group is a group of its own and the first; groups ascend by the bytes of their texts. ``other`` is a second digest
    carried with each leaf and not part of the tree. Repeated rows are leaves of their own; of no rows the root is null.
    The rows are read once, a very long one is hashed as it is read; digests, groups and orders are sorted in ranges and
    then meet in blocks, so a group of any size is spread over tasks and none holds more than a block. The driver gets the root alone.
    """
    leaves = _leaves(rows, group, order, leaf, other)
    blocks = materialize(_blocks(leaves.select("team", "at", "node", "id", "other"), levels), "blocks")
    return _finished(blocks, materialize(_roots(blocks, levels, False), "block-roots"), levels)


def appended(manifest: Manifest, rows: DataFrame, group: Column, order: Column, leaf: Column, other: Column | None = None) -> Manifest:
    """The manifest with further ``rows``, each of which must come after all leaves of its group.

    It is the one that ``built`` would make of all rows. Whole blocks stay as they are and are not hashed again, the open block of each group
    goes on with its new leaves, and above it only roots of blocks are hashed. Rows that do not come after those
    of their group are an error; where orders are equal, the new rows follow. New groups find their places among the old ones.
    """
    levels = manifest.levels
    last = materialize(manifest.blocks.groupBy("team").agg(F.max("block").alias("block")).join(
        manifest.blocks, ["team", "block"]).select(
        "team", "block", F.size("nodes").alias("n"), F.element_at("nodes", -1)["id"].alias("last"), "nodes"), "last-blocks")
    ends = last.select("team", (F.shiftleft("block", levels) + F.col("n")).alias("before"), "last")
    late = F.col("before").isNotNull() & F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))
    new = _leaves(rows, group, order, leaf, other).join(ends, "team", "left").select(
        "team", (F.when(late, F.raise_error(F.lit("a row does not come after the leaves of its group")).cast("long")).otherwise(
            F.col("at") + F.coalesce("before", F.lit(0)))).alias("at"), "node", "id", "other")
    new = materialize(new, "new-leaves")
    open_blocks = last.where(F.col("n") < 1 << levels).select("team", "block", "nodes").join(
        new.select("team").distinct(), "team", "left_semi")
    again = open_blocks.select("team", F.inline("nodes")).select(new.columns)
    touched = materialize(_blocks(again.unionByName(new), levels), "blocks")
    kept = open_blocks.select("team", "block")

    def whole(table: DataFrame, changed: DataFrame, name: str) -> DataFrame:
        return materialize(table.join(kept, ["team", "block"], "left_anti").unionByName(changed), name)

    return _finished(whole(manifest.blocks, touched, "blocks"), whole(
        manifest.roots, _roots(touched, levels, False), "block-roots"), levels)


def proven(manifest: Manifest, order: str = "id") -> DataFrame:
    """``order, leaf, other, subroot, root, witness, proof_sha256, folded_root, verified`` for every leaf.

    ``witness`` lists the siblings from the leaf up, each after ``<`` if it stands on the left and ``>`` if on the right,
    and ``-`` where there is none; ``folded_root`` comes from ``other`` and the witness, and ``verified`` tells whether it is the root.
    Blocks meet their upper witnesses as one row each; those of single leaves are made in the task that gives them out.
    """
    levels, root = manifest.levels, manifest.root
    blocks = manifest.blocks.join(manifest.tops, ["team", "block"]).select("block", "nodes", "subroot", "rest")
    kind = manifest.blocks.schema["nodes"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, nodes, subroot, rest = (c[i] for c in batch.columns)
                nodes, rest = nodes.values, rest.as_py()
                leaves, others = nodes.field("node").to_pylist(), nodes.field("other").to_pylist()
                paths = [own + rest for own in block_stream(leaves, block.as_py(), levels)[1]]
                roots = [folded(leaf, path) for leaf, path in zip(others, paths, strict=True)]
                size = len(leaves)
                yield pa.RecordBatch.from_arrays([
                    nodes.field("id"), nodes.field("node"), nodes.field("other"), pa.array([subroot.as_py()] * size),
                    pa.array([root] * size), pa.array(paths, pa.list_(pa.string())), pa.array([proof(p) for p in paths]),
                    pa.array(roots), pa.array([r == root for r in roots])], names=names)

    names = [order, "leaf", "other", "subroot", "root", "witness", "proof_sha256", "folded_root", "verified"]
    return blocks.mapInArrow(
        run, f"`{order}` {kind}, leaf string, other string, subroot string, root string, witness array<string>, "
        "proof_sha256 string, folded_root string, verified boolean")
