"""N-gram Jaccard join of documents by a MinHash LSH forest and exact verification.

Every text is a set of word n-grams (five words; a shorter text is one n-gram of all its words; words are parted by ASCII
white space and compared as they are). Each tree of the forest is a prefix trie of signatures, LONGEST values of its own for
each text; a node holds the texts that share a prefix. Texts of an open node are compared exactly. In each tree prefixes are
shortened from LONGEST values down to `prefix_length`, at which all trees together reach the target recall for pairs at the
threshold; but not below a node that is CROWDED: there the texts stay with longer prefixes, as far as the trees in which they
don't still reach the target. Where they don't, the least crowded of a text's nodes are opened until the target is reached.
Whether a node is crowded doesn't hang on any one pair, so that a pair's chance to be missed is that of its texts' prefixes.
A pair is compared in the first tree where its texts meet in an open node and nowhere else.

Equal texts form one class that is compared once and counted with its copies. A prefix with many classes is split into
blocks; tasks get pairs of blocks and return sums and a few edges, never the pairs. Trees whose prefixes hold the same
classes as those of an earlier tree are left out, since the earlier tree has their pairs.

Null text: as the empty text. A text without words is like no other text, but equal texts are copies of one another
(likeness 1). Repeated rows count as copies. Null doc_id: such a row takes part; its class has the least id that isn't null.
An empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
THRESHOLD = 0.8
TREES = 16
#: Values of a signature in one tree, and bits of a value; four of them make one half of it.
LONGEST_PREFIX, BITS = 8, 16
#: Expected share of the pairs at the threshold that meet in some tree; pairs above it meet more often.
RECALL = 0.999
#: Classes of one prefix that are compared in one block.
BLOCK = 512
#: A node with more classes than this isn't opened while its texts can do without it.
CROWDED = 256
#: A class (or other key) with more than this share of all rows is joined by broadcast; there are fewer than 1/HOT of them.
HOT = 1 / 1000
#: Steps of component labelling; each halves long chains, so the number needed grows with the logarithm of the input.
MOST_ROUNDS = 60


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST_PREFIX, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold reach the recall."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts in order, and how many each text has (repeats included)."""
    from parley.llm.shared import IS_SPACE, Spans, flat, mixed, runs

    data, at = flat(texts)
    starts, ends, counts = runs(~IS_SPACE[data], at)
    hashes = Spans(data).hash(starts, ends)
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    end = np.repeat(np.cumsum(counts), number)
    first = np.repeat(np.cumsum(counts) - counts, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    total = np.zeros(len(first), np.uint64)
    for k in range(words):
        inside = first + k < end
        total += np.where(inside, hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else 0, np.uint64(0)) * np.uint64(0xD1342543DE82EF95 + 2 * k * 0x9E3779B97F4A)
    return mixed(total), number


def signatures(hashes: np.ndarray, counts: np.ndarray, trees: int, seed: int = 7) -> np.ndarray:
    """One row for each text that has n-grams: for each tree the first half of its values, then for each tree the second."""
    rng = np.random.default_rng(seed)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), 2 * trees), np.uint64)
    if not len(starts):
        return out
    for tree in range(trees):
        for k in range(LONGEST_PREFIX):
            factor, shift = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat(hashes * (factor | np.uint64(1)) + shift, starts)
            half = tree + trees * (k >= LONGEST_PREFIX // 2)
            # low bits of the least hash, mixed: the high ones are small in all of them
            out[:, half] = (out[:, half] << np.uint64(BITS)) | ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return out


def _sign(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, class (of equal texts), keys (the signature's halves): no keys for a text without words."""
    from parley.llm.shared import list_array, slices

    def run(batches):
        for batch in slices(batches):
            hashes, counts = shingles(batch.column("text"), words)
            keys = signatures(hashes, counts, trees)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("class"), list_array(pa.array(keys.view(np.int64).ravel()), np.where(counts > 0, 2 * trees, 0))], names=["doc_id", "class", "keys"])

    return docs.select("doc_id", "text", class_of().alias("class")).mapInArrow(run, "doc_id long, class binary, keys array<long>")


def opened(each: DataFrame, trees: int, length: int, threshold: float, recall: float, crowded: int) -> DataFrame:
    """each (class, keys: a signature's halves) with keys replaced by the open node that the class is in, one for each tree."""
    from parley.llm.shared import stored

    half = LONGEST_PREFIX // 2
    if length > half:  # a node is told by the first half and what it has of the second
        raise ValueError("the prefix at the target recall is longer than half a signature")
    # the prefix of `length` values, and all values behind it
    head = F.shiftrightunsigned("head", BITS * (half - length))
    entries = each.select("class", F.posexplode(F.slice("keys", 1, trees)).alias("tree", "head"), "keys")
    entries = entries.select("class", "tree", head.alias("node"), "head", F.element_at("keys", trees + 1 + F.col("tree")).alias("tail"))
    full = entries.groupBy("tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    inside = stored(entries.join(full, ["tree", "node"]), "crowded")
    # the shortest longer prefix whose node isn't crowded, or the whole signature, for each distinct signature in there
    distinct = stored(inside.groupBy("tree", "node", "head", "tail").agg(F.count("*").alias("n")), "crowded-signatures")
    prefix = {d: F.struct(F.shiftrightunsigned("head", BITS * max(half - d, 0)).alias("h"), F.shiftrightunsigned("tail", BITS * (2 * half - d)).alias("t") if d > half else F.lit(0).cast("long").alias("t")) for d in range(length + 1, LONGEST_PREFIX + 1)}
    sized = distinct
    for d, p in prefix.items():
        size = distinct.groupBy("tree", p.alias("p")).agg(F.sum("n").alias(f"n{d}"))
        sized = sized.withColumn("p", p).join(size, ["tree", "p"]).drop("p")
    depth = F.coalesce(*[F.when(F.col(f"n{d}") <= crowded, d) for d in prefix], F.lit(LONGEST_PREFIX))
    sized = stored(sized.withColumn("depth", depth).select("tree", "head", "tail", "depth"), "crowded-depths")
    # how far each class is from the target if it stays with the longer prefixes, and which nodes it has to open
    missed = lambda d: math.log(1 - threshold**d)
    loss = F.create_map(*[F.lit(x) for d in range(1, LONGEST_PREFIX + 1) for x in (d, missed(d) - missed(length))])
    told = inside.join(sized, ["tree", "head", "tail"]).withColumn("loss", F.try_element_at(loss, F.col("depth")))
    mine = Window.partitionBy("class")  # at most one row for each tree
    over = F.sum("loss").over(mine) - (math.log(1 - recall) - trees * missed(length))
    before = F.coalesce(F.sum("loss").over(mine.orderBy("n", "tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    told = stored(told.withColumn("open", before < over), "crowded-classes")
    open_ = told.where("open").select("tree", "node").distinct().withColumn("opens", F.lit(True))
    closed = told.join(open_, ["tree", "node"], "left").where("opens is null")
    longer = F.coalesce(*[F.when(F.col("depth") == d, F.xxhash64(F.lit(d), p)) for d, p in prefix.items()])
    closed = closed.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("tree", longer.alias("key")))).alias("instead"))
    heads = F.transform(F.slice("keys", 1, trees), lambda k, t: F.coalesce(F.try_element_at("instead", t), F.shiftrightunsigned(k, BITS * (half - length))))
    return each.join(closed, "class", "left").withColumn("keys", heads).drop("instead")


def class_of(text: str = "text"):
    """Equal texts have the same class."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """class, keys, copies and the sorted distinct n-gram hashes."""
    from parley.llm.shared import list_array, slices

    def run(batches):
        for batch in slices(batches):
            hashes, counts = shingles(batch.column("text"), words)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            sets = list_array(pa.array(hashes[fresh].view(np.int64)), np.bincount(owner[fresh], minlength=len(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("keys"), batch.column("copies"), sets], names=["class", "keys", "copies", "grams"])

    return docs.mapInArrow(run, "class binary, keys array<long>, copies long, grams array<long>")


def compare(sets: list[np.ndarray], keys: np.ndarray, tree: int, block: np.ndarray, diagonal: bool, threshold: float) -> np.ndarray:
    """Which of the sets are alike: a symmetric matrix of True for each pair that first meets in this tree.

    block: of each set; unless diagonal, only pairs from two blocks count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
    several = times > 1  # the others are in no intersection
    number = (np.cumsum(several) - 1)[place]
    kept = several[place]
    width = -(-int(several.sum()) // 64) or 1
    bits = np.zeros((n, width * 64), np.uint8)
    bits[owner[kept], number[kept]] = 1
    bits = np.packbits(bits, axis=1).view(np.uint64)
    top = round(threshold * 10**6)
    alike = np.zeros((n, n), bool)
    for i in range(n - 1):
        shared = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
        like = shared * 10**6 >= top * (size[i] + size[i + 1 :] - shared)
        at = np.flatnonzero(like) + i + 1
        if len(at):
            if not diagonal:
                at = at[block[at] != block[i]]
            at = at[~(keys[at, :tree] == keys[i, :tree]).any(axis=1)]
            alike[i, at] = alike[at, i] = True
    return alike


def _forest(alike: np.ndarray) -> Iterator[tuple[int, int]]:
    """An edge from each linked set to the first of its component."""
    label = np.arange(len(alike))
    while True:
        least = np.minimum(label, np.where(alike, label[None, :], len(alike)).min(axis=1))
        if (least == label).all():
            break
        label = least[least]
    linked = np.flatnonzero(label != np.arange(len(alike)))
    yield from zip(linked.tolist(), label[linked].tolist(), strict=True)


def _links(groups: DataFrame, threshold: float) -> DataFrame:
    """From rows that stand together by tree, key, low and high: for each class the number of linked documents, and edges."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        tree = rows.column("tree")[0].as_py()
        diagonal = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        name = rows.column("class").to_pylist()
        first = {c: i for i, c in reversed(list(enumerate(name)))}  # a repeated row counts once
        at = sorted(first.values())
        if len(at) < 2:
            return None
        grams, at_grams = rows.column("grams").combine_chunks(), None
        values = grams.flatten().to_numpy().view(np.uint64)
        at_grams = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(name), -1)
        block, copies = rows.column("block").to_numpy()[at], rows.column("copies").to_numpy()[at]
        alike = compare([values[at_grams[i] : at_grams[i + 1]] for i in at], keys[at], tree, block, diagonal, threshold)
        links = alike @ copies
        some = np.flatnonzero(links)
        if not len(some):
            return None
        edges = list(_forest(alike))
        a = [name[at[i]] for i in some] + [name[at[i]] for i, _ in edges]
        b = [None] * len(some) + [name[at[j]] for _, j in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())], names=["class", "other", "links"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "key", "low", "high")]
            cuts = np.flatnonzero(np.any([p[1:] != p[:-1] for p in part], axis=0)) + 1
            if waiting and tuple(p[0] for p in part) != last:
                if found := solve(pa.Table.from_batches(waiting)):
                    yield found
                waiting = []
            begin = 0
            for end in cuts.tolist():
                if found := solve(pa.Table.from_batches([*waiting, batch.slice(begin, end - begin)])):
                    yield found
                waiting, begin = [], end
            waiting.append(batch.slice(begin))
            last = tuple(p[-1] for p in part)
        if waiting and (found := solve(pa.Table.from_batches(waiting))):
            yield found

    return groups.mapInArrow(run, "class binary, other binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it hangs together with) for every node of the edges (a, b): stars, large and small in turn.

    Each round is written to the shared folder. The work of a round goes by edges, whatever a node's number of neighbours.
    """
    from parley.llm.shared import stored

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        before = now
    raise RuntimeError("components didn't settle")


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, class of equal texts), and for each class: copies (its rows), first_id (its least doc_id), root (the same
    for all classes that hang together and for no others), class_id (least doc_id of those) and links (other documents that
    are alike, copies included)."""
    from parley.llm.shared import stored

    signed = stored(_sign(docs, words, trees), "signed")
    each = stored(signed.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "classes")
    length = min(prefix_length(threshold, trees, recall=recall), LONGEST_PREFIX // 2)
    each = stored(opened(each, trees, length, threshold, recall, crowded), "opened")
    entries = each.select("class", F.posexplode("keys").alias("tree", "key"))
    buckets = entries.groupBy("tree", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("h1"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("h2")).where("n > 1")
    kept = buckets.groupBy("n", "h1", "h2").agg(F.min(F.struct("tree", "key")).alias("at")).select("at.*", "n")
    members = stored(entries.join(kept, ["tree", "key"]), "members")
    wanted = members.select("class").distinct().join(each, "class")
    texts = docs.select(F.col("doc_id").alias("first_id"), "text", class_of().alias("class"))
    texts = texts.join(wanted.withColumnRenamed("class", "c").withColumnRenamed("first_id", "f"), texts["first_id"].eqNullSafe(F.col("f")) & (texts["class"] == F.col("c"))).select("class", "text", "keys", "copies")
    sets = _sets(texts, words)
    blocks = F.ceil(F.col("n") / block)
    mine = members.withColumn("block", F.expr(f"pmod(xxhash64(class, 7), cast(ceil(n / {block}) as bigint))"))
    mine = mine.withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    mine = mine.select("class", "tree", "key", "block", F.least("block", "facing").alias("low"), F.greatest("block", "facing").alias("high"))
    groups = mine.join(sets, "class").repartition("tree", "key", "low", "high").sortWithinPartitions("tree", "key", "low", "high")
    links = stored(_links(groups, threshold), "links")
    sums = links.where("other is null").groupBy("class").agg(F.sum("links").alias("more"))
    rooted = components(links.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    rooted = rooted.withColumnRenamed("node", "class").join(each.select("class", "first_id"), "class")
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    found = each.select("class", "first_id", "copies").join(rooted.join(roots, "root").select("class", "class_id", "root"), "class", "left").join(sums, "class", "left")
    found = found.select("class", "copies", "first_id", F.coalesce("root", "class").alias("root"), F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "class"), found


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links: for every row the id of its class (documents that hang together through links, by their
    least doc_id) and the number of other documents with a likeness of the threshold or more."""
    from parley.llm.shared import stored

    rows, found = classes(docs, **options)
    found = stored(found.select("class", "copies", "class_id", "n_links"), "found")
    # classes of many copies are few: their rows stay where they are
    many = F.broadcast(found.where(F.col("copies") > HOT * rows.count()))
    told = rows.join(many, "class").union(rows.join(many.select("class"), "class", "left_anti").join(found, "class"))
    return told.select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are like an earlier one: of each group that hangs together the row of the least
    doc_id stays, a null doc_id after all others.

    Of rows with that doc_id and the same text, one stays. Texts that aren't alike stay, whatever their doc_ids are.
    """
    from parley.llm.shared import unused

    _, found = classes(docs, **options)
    mine, id_, kept_ = unused(docs, "_class", "_id", "_kept")
    least = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias(id_), F.col("class").alias(kept_)))
    stay = found.groupBy("root").agg(least.alias("least")).select(F.col("least")[id_].alias(id_), F.col("least")[kept_].alias(kept_))
    told = docs.withColumn(mine, class_of())
    kept = told.join(stay, told["doc_id"].eqNullSafe(F.col(id_)) & (told[mine] == F.col(kept_)), "left_semi")
    return kept.dropDuplicates(["doc_id", mine]).drop(mine)
