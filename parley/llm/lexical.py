"""Ranked lexical search: items against all documents by blocked dense multiplication, exact in whole numbers.

Items are taken in blocks. For each block every document's terms are counted once over the block's vocabulary and written as
sparse rows; from them come the corpus counts and each document's impacts. A task then multiplies tiles: the weights of a tile
of items over its own compact vocabulary, and the impacts of a tile of documents, both dense, in float64. Every entry is a whole
number, and the vocabulary is cut so that no item's sum over one cut can reach 2^53: each product is exact in any order of
summing, and cuts are added as 64-bit numbers. Of each tile those documents stay that reach the item's k-th score so far, ties
included; a task keeps k for each item, and tasks' lists are merged in groups.

Null text (document or item): no terms. Very long texts are read whole. Repeated documents: each is ranked; ties by ascending
doc_id, null first. Repeated items: each row is ranked for itself, under its item_id. Empty tables: no row. Columns other than
the id and the text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import flat, list_array, lower_ascii, runs, slices, stored

BEST = 10
#: Items and bytes of their texts in a block: what the driver and a task hold at once. A larger item is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
#: Items, documents and terms of a tile.
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 64, 512, 4096
#: An impact is less than this, so that a weight times this bounds an entry's part of a score.
MOST_IMPACT = 1_000_000
EXACT = 1 << 53
#: Lists of so many tasks are merged at a time, as a power of two.
MERGED = 8

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, with A-Z in lower case, and the number in each text: runs of letters and digits of
    ASCII and of whatever isn't ASCII."""
    data, at = flat(texts)
    inside = _IN_TERM[data]
    starts, ends, counts = runs(inside, at)
    joined = np.ascontiguousarray(lower_ascii(data[inside]))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]), counts


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of items, a block at a time."""
    ids, texts, size = [], [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        text = text or ""
        if ids and (len(ids) == BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


def counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms), terms (numbers in the vocabulary, ascending) and tfs of the documents that have a term."""

    def run(batches):
        size = max(len(vocabulary), 1)
        for batch in slices(batches):
            found, n = terms(batch.column("text"))
            number = pc.index_in(found, value_set=vocabulary)
            known = pc.is_valid(number).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[known]
            key, tf = np.unique(row * size + pc.drop_null(number).to_numpy().astype(np.int64), return_counts=True)
            each = np.bincount(key // size, minlength=len(n))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), list_array(pa.array((key % size).astype(np.int32)), each), list_array(pa.array(tf.astype(np.int64)), each)], names=["doc_id", "n", "terms", "tfs"]
            )
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _exact_div(n: np.ndarray, factor: int, by: int) -> np.ndarray:
    """(n * factor) // by, also where the product needs more than 64 bits."""
    if len(n) == 0 or int(n.max()) * factor < 1 << 63:
        return n * factor // by
    return np.array([int(x) * factor // by for x in n.tolist()], np.int64)


class ItemTile:
    """Items over their own vocabulary, in cuts of it: for each the terms' numbers and the dense weights (terms x items)."""

    def __init__(self, first: int, item: np.ndarray, term: np.ndarray, repeats: np.ndarray, weights: np.ndarray):
        self.first, self.size = first, int(item.max()) + 1 if len(item) else 0
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        own, at = np.unique(term, return_inverse=True)
        dense = np.zeros((len(own), self.size), np.int64)
        dense[at, item] = repeats
        columns, held, rows = [], np.zeros(self.size, np.int64), []
        for k, t in enumerate(own.tolist()):
            w = int(weights[t])
            if w == 0:
                continue
            part = (EXACT - 1) // (w * MOST_IMPACT)  # repeats that one entry can have
            left = dense[k].copy()
            while left.any():
                row = np.minimum(left, part)
                left -= row
                most = row * (w * MOST_IMPACT)
                # a term stands once in a cut: its impacts fill one column
                if rows and ((held + most >= EXACT).any() or len(rows) == TILE_TERMS or columns[-1] == t):
                    self._close(columns, rows)
                    columns, held, rows = [], np.zeros(self.size, np.int64), []
                columns.append(t)
                rows.append(row * w)
                held = held + most
        if rows:
            self._close(columns, rows)

    def _close(self, columns: list[int], rows: list[np.ndarray]) -> None:
        self.cuts.append((np.array(columns, np.int64), np.array(rows, np.float64)))


def item_tiles(owner: np.ndarray, term: np.ndarray, repeats: np.ndarray, weights: np.ndarray, items: int) -> list[ItemTile]:
    """Tiles of a block from its entries (item, term, repeats) in the order of items."""
    out = []
    for first in range(0, items, TILE_ITEMS):
        mine = slice(*np.searchsorted(owner, [first, first + TILE_ITEMS]))
        out.append(ItemTile(first, owner[mine] - first, term[mine], repeats[mine], weights))
    return out


class Best:
    """The k best documents of each item so far: scores, then lower ids, nulls before all."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # item, score, whether it has an id, id

    def take(self, first: int, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns) from number `first` on."""
        docs, items = scores.shape
        floor = self.floor[first : first + items]
        if docs > self.k:  # what is below a tile's own k-th score can't be among its best
            floor = np.maximum(floor, np.partition(scores, docs - self.k, axis=0)[docs - self.k])
        row, item = np.nonzero(scores >= floor)
        if len(row) == 0:
            return
        new = np.column_stack([item + first, scores[row, item], known[row], ids[row]])
        both = np.concatenate([self.rows, new])
        both = both[np.lexsort((both[:, 3], both[:, 2], -both[:, 1], both[:, 0]))]
        start = np.searchsorted(both[:, 0], both[:, 0])
        place = np.arange(len(both)) - start
        self.rows = both[place < self.k]
        full = both[place == self.k - 1]
        self.floor[full[:, 0]] = np.maximum(self.floor[full[:, 0]], full[:, 1])


def _ranked_block(docs: DataFrame, ids: list, texts: list[str], k: int) -> DataFrame | None:
    """item (its number in the block), doc_id, score, part of the k best documents in each task."""
    spark = docs.sparkSession
    found, per_item = terms(pa.array(texts, pa.string()))
    encoded = found.dictionary_encode()
    vocabulary = encoded.dictionary
    if len(vocabulary) == 0:
        return None
    owner = np.repeat(np.arange(len(ids)), per_item)
    key, repeats = np.unique(owner * len(vocabulary) + encoded.indices.to_numpy().astype(np.int64), return_counts=True)
    rows = stored(counted(docs, vocabulary), "terms")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if documents == 0:
        return None
    # one row for each term of the block
    df = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    sent = spark.sparkContext.broadcast((key // len(vocabulary), key % len(vocabulary), repeats, weights))
    items = len(ids)

    def run(batches):
        tiles, local = item_tiles(*sent.value, items), np.full(len(sent.value[3]), -1, np.int64)
        best = Best(items, k)
        for batch in batches:
            for low in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(low, TILE_DOCS)
                n, lists = part.column("n").to_numpy(), part.column("terms")
                each = pc.list_value_length(lists).to_numpy()
                row, term = np.repeat(np.arange(len(n)), each), pc.list_flatten(lists).to_numpy()
                tf = pc.list_flatten(part.column("tfs")).to_numpy()
                m = 25 + _exact_div(n, 75 * documents, total)
                impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[row])).astype(np.float64)
                doc = part.column("doc_id")
                known, number = pc.is_valid(doc).to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy()
                for tile in tiles:
                    scores = np.zeros((len(n), tile.size), np.int64)
                    for columns, dense in tile.cuts:
                        local[columns] = np.arange(len(columns))
                        at = local[term]
                        own = at >= 0
                        impacts = np.zeros((len(n), len(columns)))
                        impacts[row[own], at[own]] = impact[own]
                        scores += (impacts @ dense).astype(np.int64)
                        local[columns] = -1
                    if tile.size:
                        best.take(tile.first, scores, known, number)
        item, score, known, number = best.rows.T
        part = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(number, mask=known == 0), pa.array(score), pa.array(part)], names=["item", "doc_id", "score", "part"])

    return rows.mapInArrow(run, "item int, doc_id long, score long, part int")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k documents with the highest scores above 0 for each item.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its impact in a document (10^9 tf) div (1000 tf + 8m) with
    m = 25 + (75 n N) div L; a score sums weight times impact over the item's terms, repeats included.
    """
    spark = docs.sparkSession
    out = None
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for ids, texts in item_blocks(items):
        found = _ranked_block(docs, ids, texts, k)
        if found is None:
            continue
        few = F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))
        merged = found.withColumn("group", F.shiftright("part", MERGED)).withColumn("rank", few).where(F.col("rank") <= k)
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        block = merged.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # at most BLOCK_ITEMS rows
        out = block if out is None else out.unionByName(block)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
