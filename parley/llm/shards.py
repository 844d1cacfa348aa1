"""Sharding by a hierarchical tree of weighted hash draws: a key descends region, rack and shard levels.

At each level every child of the node reached draws a number from the key and its own path, and the child whose exponential
draw, divided by its weight, is the least takes the key. A node's weight is the sum of its shards'. A draw depends on nothing
but the key and the path, so that a change of one shard's weight can move keys only between its own ancestors and their
siblings: subtrees whose weights stay keep the keys they have, or lose some to the one that grew. A shard that comes as a region
of its own (`grown`) takes keys only into itself.

Everything is built-in column functions: digests by md5, logarithms in doubles, choices by array functions.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.ranks import ranked
from parley.llm.shared import stored

SHARDS = 24
PER_RACK, RACKS = 4, 2
#: Hexadecimal digits of a digest that make a draw: 52 bits, exact in a double.
DIGITS = 13


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform(count: int, per_rack: int = PER_RACK, racks: int = RACKS) -> list[Leaf]:
    """A tree of shards 0 to count - 1 of weight one, per_rack to a rack and racks to a region."""
    return [Leaf(s // (per_rack * racks), s // per_rack % racks, s) for s in range(count)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard as a region of its own, so that it takes keys only into itself."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _draw(path: Column) -> Column:
    """A number above 0 and below 1 from a text."""
    number = F.conv(F.substring(F.md5(path), 1, DIGITS), 16, 10).cast("long")
    return (number.cast("double") + 0.5) / float(1 << (4 * DIGITS))


def _chosen(path: Column, children: Column) -> Column:
    """Of children (array of id, weight) the one with the least weighted draw; equal draws go to the lower id."""
    drawn = F.transform(children, lambda c: F.struct((-F.log(_draw(F.concat(path, F.lit("/"), c["id"].cast("string")))) / c["weight"]).alias("draw"), c["id"].alias("id")))
    return F.array_min(drawn)["id"]


def _children(nodes: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in sorted(nodes.items())])


def placed(rows: DataFrame, key: str, tree: list[Leaf], names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """rows with the region, rack and shard (int) of their key; a null key counts as '-'.

    tree: a short list (it becomes constants of the plan); shards of weight 0 get no key, negative weights and a tree without
    weight are errors, a (region, rack, shard) that stands twice has the sum of its weights.
    """
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[tuple[int, int], dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for x in tree:
        if x.weight < 0:
            raise ValueError(f"negative weight of {x}")
        if x.weight:
            regions[x.region] += x.weight
            racks[x.region][x.rack] += x.weight
            shards[x.region, x.rack][x.shard] += x.weight
    if not regions:
        raise ValueError("the tree has no shard with a weight")
    region, rack, shard = names
    at = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    by_region = F.create_map(*[x for r, nodes in racks.items() for x in (F.lit(r), _children(nodes))])
    by_rack = F.create_map(*[x for (r, k), nodes in shards.items() for x in (F.lit(f"{r}/{k}"), _children(nodes))])
    slash = F.lit("/")
    told = rows.withColumn(region, _chosen(at, _children(regions)))
    told = told.withColumn(rack, _chosen(F.concat(at, slash, F.col(region).cast("string")), F.element_at(by_region, F.col(region))))
    place = F.concat(F.col(region).cast("string"), slash, F.col(rack).cast("string"))
    return told.withColumn(shard, _chosen(F.concat(at, slash, place), F.element_at(by_rack, place)))


def shard_documents(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard of all documents, by the law `key`.

    The shard depends on doc_id and count alone; grown_shard is the shard after one more has come as a region of its own. Slots
    are places in a shard by doc_id, size and text_crc32, gapless from 0; no task gets a whole shard. Null text: size 8 and
    text_crc32 0. Null doc_id: placed like the key '-', first in its shard. Repeated rows: each has a slot, equal ones in any
    order. Very long texts are only measured. An empty table gives no row. Columns other than doc_id and text aren't read.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    tree = uniform(count)
    both = placed(placed(sized, "doc_id", tree), "doc_id", grown(tree), ("_region", "_rack", "grown_shard")).drop("_region", "_rack")
    slots = ranked(stored(both, "shards"), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")
