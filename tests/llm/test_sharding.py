"""Shards against a plain descent, and what moves when trees change."""

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import replace

import pytest

from tracewell.llm import sharding as S


def plain(key, tree):
    node, path = tree, ""
    while node.shard is None:
        draws = []
        for c in node.children:
            digest = hashlib.sha256(f"{path}/{c.name}:{'' if key is None else key}".encode()).hexdigest()
            draws.append((-math.log((int(digest[:13], 16) + 0.5) / 2 ** 52) / c.weight, c.name, c))
        _, name, node = min(draws, key=lambda d: d[:2])
        path += "/" + name
    return node.shard


def test_one_more_shard_takes_rows_into_itself_only(spark):
    keys = spark.range(4000)
    before = None
    for count in range(1, 27):
        after = {r.id: r.s for r in keys.select("id", S.shard_of(keys.id, S.even(count)).alias("s")).collect()}
        assert after == {k: plain(k, S.even(count)) for k in after} if count in (1, 5, 17) else True
        assert set(after.values()) == set(range(count)) == set(S.even(count).shards())
        if before:
            moved = {k for k in after if after[k] != before[k]}
            assert moved and {after[k] for k in moved} == {count - 1}
            # They come from the siblings of the new node alone.
            r, k = (count - 1) % S.REGIONS, (count - 1) // S.REGIONS % S.RACKS
            new_rack = count - 1 < S.REGIONS * S.RACKS
            assert count - 1 < S.REGIONS or {before[x] % S.REGIONS for x in moved} == {r}
            assert new_rack or {before[x] // S.REGIONS % S.RACKS for x in moved} == {k}
        before = after


def tree(weights):
    return S.Node("", children=tuple(S.Node(f"r{r}", w, tuple(S.Node(f"k{k}", x, tuple(
        S.Node(f"s{i}", y, shard=i) for i, y in shards)) for k, (x, shards) in enumerate(racks)))
        for r, (w, racks) in enumerate(weights)))


def test_weights(spark):
    a = tree([(1.0, [(1.0, [(0, 1.0), (1, 3.0)])]), (3.0, [(1.0, [(2, 1.0)]), (2.0, [(3, 1.0), (4, 1.0)])])])
    keys = spark.range(20_000)
    got = {r.id: r.s for r in keys.select("id", S.shard_of(keys.id, a).alias("s")).collect()}
    share = Counter(got.values())
    for s, expected in {0: 1 / 16, 1: 3 / 16, 2: 1 / 4, 3: 1 / 4, 4: 1 / 4}.items():
        assert abs(share[s] / 20_000 - expected) < 0.015
    # A region of twice the weight: rows move into it only, and none moves within a region.
    heavier = replace(a, children=(replace(a.children[0], weight=2.0), a.children[1]))
    after = {r.id: r.s for r in keys.select("id", S.shard_of(keys.id, heavier).alias("s")).collect()}
    moved = [(got[k], after[k]) for k in got if got[k] != after[k]]
    assert moved and all(x > 1 and y < 2 for x, y in moved)
    # A lighter shard: rows move out of it only, and stay in its rack.
    rack = a.children[1].children[1]
    lighter = replace(a, children=(a.children[0], replace(a.children[1], children=(
        a.children[1].children[0], replace(rack, children=(replace(rack.children[0], weight=0.5), rack.children[1]))))))
    after = {r.id: r.s for r in keys.select("id", S.shard_of(keys.id, lighter).alias("s")).collect()}
    assert {(got[k], after[k]) for k in got if got[k] != after[k]} == {(3, 4)}


def test_rows(spark):
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(500)] + [(7, "again")] * 300 + [(None, "no id"), (None, None), (600, None), (601, "é𝔘" * 90_000)]
    df = spark.createDataFrame([(*r, "x", 9, 9, 9) for r in rows],
                               "doc_id long, text string, shard string, slot int, _row int, size int").repartition(5)
    t, grown = S.even(6), S.even(7)
    got = S.assigned(df, t, grown)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "grown_shard", "slot"]
    size = lambda x: len((x or "").encode()) + 1
    crc = lambda x: zlib.crc32((x or "").encode())
    out = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out) == Counter(
        (d, size(x), crc(x), plain(d, t), plain(d, grown)) for d, x in rows)
    for s in range(6):
        own = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
        assert order == sorted(order)
    assert S.assigned(df.limit(0), t).collect() == [] and S.assigned(df, t).where("grown_shard IS NOT NULL").isEmpty()
    kept = S.sharded(df, t, shard="SHARD").first()
    assert kept["_row"] == 9 and "text" in kept and kept["SHARD"] == plain(kept["doc_id"], t)
    names = S.sharded(df.withColumnRenamed("text", "a.b"), t, "a.b", "to")
    assert all(r["to"] == plain(r["a.b"], t) for r in names.collect())


def test_wrong_trees(spark):
    leaf = S.Node("s", shard=0)
    for make in (lambda: S.Node("x", 0.0, shard=1), lambda: S.Node("x"), lambda: S.Node("x", children=(leaf, leaf)),
                 lambda: S.Node("x", children=(S.Node("a/b", shard=1),)), lambda: S.even(0), lambda: S.Node("x", float("inf"), shard=1),
                 lambda: S.shard_of(spark.range(1).id, S.Node("", children=(leaf,))),
                 lambda: S.shard_of(spark.range(1).id, S.Node("", children=(S.Node("r", children=(leaf,)),)))):
        with pytest.raises(ValueError):
            make()
