"""The tree of weighted draws: laws of the query, weights, and where keys move."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from parley.llm import shards  # noqa: E402
from parley.llm.shards import Leaf  # noqa: E402


def by_hand(key, tree):
    """The descent in plain Python."""
    path, left = key, tree
    for level in range(3):
        weights = defaultdict(float)
        for x in left:
            weights[x[level]] += x.weight
        draw = lambda c: (-math.log((int(hashlib.md5(f"{path}/{c}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[c], c)  # noqa: E731, B023
        child = min(draw(c) for c, w in weights.items() if w)[1]
        path, left = f"{path}/{child}", [x for x in left if x[level] == child]
    return left[0].shard


def keys(spark, n):
    return spark.range(n).withColumnRenamed("id", "key")


def at(df):
    return {r["key"]: r["shard"] for r in df.collect()}


def test_descent_equals_plain_python(spark):
    tree = [Leaf(0, 0, 0), Leaf(0, 0, 1, 2.5), Leaf(0, 1, 2, 0.5), Leaf(2, 0, 9, 3.0), Leaf(2, 0, 10, 0.0)]
    got = at(shards.placed(keys(spark, 400), "key", tree))
    assert got == {k: by_hand(str(k), tree) for k in range(400)}
    assert 10 not in got.values()


def test_shares_follow_weights(spark):
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 1, 1, 3.0), Leaf(1, 0, 2, 4.0)]
    count = Counter(at(shards.placed(keys(spark, 8000), "key", tree)).values())
    assert all(abs(count[s] - want) < 5 * math.sqrt(want) for s, want in ((0, 1000), (1, 3000), (2, 4000)))


def test_a_region_of_its_own_takes_rows_only_into_itself(spark):
    tree = shards.uniform(24)
    old, new = at(shards.placed(keys(spark, 3000), "key", tree)), at(shards.placed(keys(spark, 3000), "key", shards.grown(tree)))
    moved = [k for k in old if old[k] != new[k]]
    assert shards.grown(tree) == shards.uniform(25) and moved and all(new[k] == 24 for k in moved) and len(moved) < 3000 / 25 * 1.5


def test_a_new_weight_moves_rows_within_its_ancestors_only(spark):
    tree = shards.uniform(24)
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in tree]  # region 0, rack 1
    old, new = at(shards.placed(keys(spark, 4000), "key", tree)), at(shards.placed(keys(spark, 4000), "key", heavier))
    moved = {(old[k], new[k]) for k in old if old[k] != new[k]}
    region = lambda s: s // 8
    assert moved and all(region(b) == 0 for _, b in moved)  # into the region that grew, never between others
    inside = {(a, b) for a, b in moved if region(a) == 0}
    assert inside and all(b // 4 == 1 for _, b in inside) and all(b == 5 for a, b in inside if a // 4 == 1)


def test_bad_trees(spark):
    for tree in ([], [Leaf(0, 0, 0, 0.0)], [Leaf(0, 0, 0, -1.0)]):
        with pytest.raises(ValueError):
            shards.placed(keys(spark, 1), "key", tree)


def test_documents_get_gapless_slots(spark):
    texts = [(None, None), (None, ""), (1, None), (1, "é"), (1, "é"), (2, "x" * 200_000), (3, "漢")] + [(4, "hot")] * 500 + [(k, f"text {k}") for k in range(10, 400)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in texts], "doc_id long, text string, `slot.x` string, slot int, shard int").repartition(7)
    rows = shards.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    tree, more = shards.uniform(24), shards.uniform(25)
    slots = defaultdict(list)
    for r in rows:
        key = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == by_hand(key, tree) and r["grown_shard"] == by_hand(key, more) and r["law"] == "key"
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
    for found in slots.values():
        found.sort()
        assert [s for s, *_ in found] == list(range(len(found))) and [x[1:] for x in found] == sorted(x[1:] for x in found)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shards.shard_documents(docs).count() == 0
