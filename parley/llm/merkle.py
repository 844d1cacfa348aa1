"""A Merkle manifest of a dataset: trees of leaves by group, a tree of their roots, and a proof for every leaf.

Two nodes in a row make one of the level above (a last one alone makes one too) until one is left. Trees are built by segments:
up to 2^HEIGHT nodes in a row and the levels above them up to a single node. A segment is stored as a record under the digest of
that node: from the digest to its children and theirs, level by level, down to the segment's own leaves, which are digests of
segments below or leaves of the dataset. Equal segments share a record, but for SALTS copies of one that stands very often.

Proofs descend from the root: a request has a digest, a place in its level and the siblings collected so far. It looks its digest
up among the records, follows the digits of each place below, collects the child not taken at each step and goes on with the
segment's leaves as requests; the path of a segment is turned round and put before that of the segments above. So a request at the
top stands for all leaves below it, no digest is asked by more than one request for each of its places, and what a leaf needs is
shuffled once for each segment, not for each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.ranks import ranked
from parley.llm.shared import stored

#: Levels of a segment: it has at most 2^HEIGHT nodes at its foot.
HEIGHT = 8
#: A record that stands at many places is kept under so many keys at most, so that requests for it are split.
SALTS = 64
_WIDTH = 1 << HEIGHT


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal sha256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: '-' if null, else its UTF-8 length, ':' and the value as text."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _height(n: Column) -> Column:
    """Levels above n nodes (at most 2^HEIGHT of them) until one is left."""
    told = F.lit(HEIGHT)
    for h in range(HEIGHT - 1, -1, -1):
        told = F.when(n <= (1 << h), F.lit(h)).otherwise(told)
    return told


def _level_above(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda k: digest(F.get(level, 2 * k), F.coalesce(F.get(level, 2 * k + 1), F.lit(""))))


def _levels(feet: Column, height: Column) -> Column:
    """All levels of a segment from its foot to its single node."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(HEIGHT)), F.lit(1), height)
    return F.aggregate(steps, F.array(feet), lambda levels, _: F.concat(levels, F.array(_level_above(F.element_at(levels, -1)))))


def _collected(levels: Column, place: Column) -> Column:
    """From a segment's node down to the foot at `place`: the child not taken at each level, turned round.

    Each step is (left, right): the sibling stands on one side, and on neither where a node was alone.
    """
    down = F.reverse(F.slice(F.sequence(F.lit(0), F.lit(HEIGHT)), F.lit(1), F.size(levels) - 1))

    def step(h: Column) -> Column:
        here = F.call_function("shiftright", place, h)
        level = F.get(levels, h)
        odd = here % 2 == 1
        return F.struct(F.when(odd, F.get(level, here - 1)).alias("left"), F.when(~odd, F.get(level, here + 1)).alias("right"))

    return F.reverse(F.transform(down, step))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.coalesce(s["left"], F.lit("")), node, F.coalesce(s["right"], F.lit(""))))


def _segments(nodes: DataFrame, name: str) -> DataFrame:
    """Segments of nodes (tree, leaves, n, place, digest, members): tree, leaves, n, segment, digest, levels, and the members of
    each foot, stored.

    leaves: of the tree; n: its nodes at this level; place: a node's place in it. The last segment of a tree with several goes
    up as far as the others.
    """
    inner = F.array_sort(F.collect_list(F.struct("place", "digest", "members")))
    grouped = nodes.withColumn("segment", F.floor(F.col("place") / _WIDTH)).groupBy("tree", "leaves", "n", "segment").agg(inner.alias("feet"))
    height = F.when(F.col("n") > _WIDTH, F.lit(HEIGHT)).otherwise(_height(F.col("n")))
    made = grouped.withColumn("levels", _levels(F.transform("feet", lambda x: x["digest"]), height))
    told = made.select("tree", "leaves", "n", "segment", F.element_at(F.element_at("levels", -1), 1).alias("digest"), "levels", F.transform("feet", lambda x: x["members"]).alias("members"))
    return stored(told, name)


def _forest(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Segments of all trees from the lowest floor up; nodes: tree, leaves, place, digest, members."""
    floors = [_segments(nodes.withColumn("n", F.col("leaves")), f"{name}-0")]
    while True:
        low = floors[-1].where(F.col("n") > _WIDTH)
        if low.isEmpty():
            return floors
        above = low.select("tree", "leaves", F.ceil(F.col("n") / _WIDTH).alias("n"), F.col("segment").alias("place"), "digest", F.lit(None).cast("boolean").alias("members"))
        floors.append(_segments(above, f"{name}-{len(floors)}"))


def _salt(place: Column) -> Column:
    return F.pmod(place, F.lit(SALTS))


def _store(floor: DataFrame) -> DataFrame:
    """Records of one floor by digest, each kept once under a salt."""
    return floor.select("digest", _salt(F.col("segment")).alias("salt"), "levels").dropDuplicates(["digest", "salt"])


def _descended(asked: DataFrame, floor: DataFrame) -> DataFrame:
    """Requests (tree, subroot, place, digest, path) one floor down: those of the feet of each one's record."""
    found = asked.withColumn("salt", _salt(F.col("place"))).join(_store(floor), ["digest", "salt"])
    feet = found.select("tree", "subroot", F.col("place").alias("_above"), "path", "levels", F.posexplode(F.element_at("levels", 1)).alias("_k", "digest"))
    return feet.select("tree", "subroot", (F.col("_above") * _WIDTH + F.col("_k")).alias("place"), "digest", F.concat(_collected(F.col("levels"), F.col("_k")), F.col("path")).alias("path"))


def _requests(tops: DataFrame, floors: list[DataFrame]) -> DataFrame:
    """Requests for the lowest segments, with their paths, from those for the trees' roots (tree, leaves, subroot, path)."""
    asked = None
    for k in range(len(floors) - 1, -1, -1):
        # a tree has its root on the floor where one segment holds all
        here = (F.col("leaves") > _WIDTH**k if k else F.lit(True)) & (F.col("leaves") <= _WIDTH ** (k + 1))
        own = tops.where(here).select("tree", "subroot", F.lit(0).cast("long").alias("place"), F.col("subroot").alias("digest"), "path")
        asked = own if asked is None else own.unionByName(asked)
        if k:
            asked = _descended(asked, floors[k])
    return asked


def _roots(floors: list[DataFrame]) -> DataFrame:
    """tree, leaves, subroot of all trees: the digests of segments that hold a whole level."""
    out = None
    for floor in floors:
        part = floor.where(F.col("n") <= _WIDTH).select("tree", "leaves", F.col("digest").alias("subroot"))
        out = part if out is None else out.unionByName(part)
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """Trees and proofs of leaves (tree, order, leaf, row): subroot, root, leaf, row and path of each.

    tree: a text, may be null; a tree's leaves ascend by `order` (nulls first), equal ones by leaf. row: anything that goes
    with a leaf. path: steps (left, right) from the leaf up to the root, through the tree of the trees' roots, which are ordered
    by tree, null first and bytewise. A lone leaf is its tree's root. An empty table gives no row.
    """
    placed = ranked(leaves, ["tree"], ["order", "leaf"], size="leaves")
    floors = _forest(placed.select("tree", "leaves", "place", F.col("leaf").alias("digest"), F.col("row").alias("members")), "leaves")
    # the tree of the trees' roots
    tops = stored(_roots(floors).withColumn("all", F.lit(0)), "tops")
    over = ranked(tops, ["all"], ["tree"], size="trees")
    upper = _forest(over.select(F.col("all").alias("tree"), F.col("trees").alias("leaves"), "place", F.col("subroot").alias("digest"), F.struct("tree", "leaves", "subroot").alias("members")), "trees")
    root = _roots(upper)
    none = F.array().cast("array<struct<left:string,right:string>>")
    found = _descended(_requests(root.withColumn("path", none), upper), upper[0])
    named = upper[0].select(F.col("segment"), F.posexplode("members").alias("_k", "m")).select((F.col("segment") * _WIDTH + F.col("_k")).alias("place"), "m.*")
    asked = _requests(named.join(found.select("place", "path"), "place"), floors).select(F.col("tree").alias("_tree"), "subroot", "place", F.col("digest").alias("_asked"), "path")
    # a request for a lowest segment meets it by place, and has to ask for its digest
    lowest = floors[0]
    met = lowest.join(asked, (asked["place"] == lowest["segment"]) & asked["_tree"].eqNullSafe(lowest["tree"])).where("_asked = digest")
    feet = met.select("subroot", "path", "levels", F.posexplode("members").alias("_k", "row"))
    proven = feet.select("subroot", F.get(F.element_at("levels", 1), F.col("_k")).alias("leaf"), "row", F.concat(_collected(F.col("levels"), F.col("_k")), F.col("path")).alias("path"))
    return proven.crossJoin(F.broadcast(root.select(F.col("subroot").alias("root"))))  # the root is one row


def manifest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all documents, by trees of each lang.

    A document's leaf is made of doc_id, source, lang, n_chars and text. Where 7 divides the unsigned crc32 of the decimal
    doc_id, the leaf is tampered with before folding: n_chars is one more. A null value enters a leaf as '-', so that a null
    n_chars stays as it is and verifies; a null doc_id isn't tampered with and stands first. An empty text enters as '0:'. Equal
    doc_ids of one lang: by leaf. Repeated rows: each is a leaf, equal ones in any order. Very long texts are only digested. An
    empty table gives no row. Columns other than the five aren't read.
    """
    parts = lambda n: digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = F.when(bad, parts(F.col("n_chars") + 1))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("order"), parts(F.col("n_chars")).alias("leaf"), F.struct("doc_id", other.alias("tampered")).alias("row"))
    told = manifest(stored(leaves, "leaves"))
    siblings = F.flatten(F.transform("path", lambda s: F.filter(F.array(s["left"], s["right"]), lambda x: x.isNotNull())))
    told = told.select("row.doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("row.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
