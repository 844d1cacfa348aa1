"""R9 as a join: like texts of two tables without comparing every pair of a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import normalised
from parley.operators.graphs import components
from parley.sources.stage import stored

#: Shorter texts are alike only when they are equal.
LEAST = 12
#: Groups of at most so many texts on both sides together are compared pair by pair, larger ones by pieces.
FEW = 256
#: Texts of LEAST * 2**k to twice as many bytes are looked up by a piece of GRAM * 2**k bytes: of every RUN * 2**k pieces in a row
#: the one of the least hash is kept. GRAM + RUN are LEAST, so that what is kept of a text is kept of every text it is part of, and
#: that each text has a window of (GRAM + RUN) * 2**k bytes around its piece: candidates share the window.
GRAM, RUN, LEVELS = 8, 4, 6
#: Bits of a filter: so many for each number that it holds, within bounds; a fuller one only lets more through. SET of the 64 bits of
#: a word are set for a number: by the bits of the number from WORD_BITS on, the word by those below.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
SET, WORD_BITS = 4, 23
#: Bytes of texts whose pieces a task reckons at once.
AT_ONCE = 4_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _ahead(x: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """x moved k places to the front; what comes in from behind is fill."""
    out = np.full_like(x, fill)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def _levels(data: np.ndarray, ends: np.ndarray):
    """For each level the hashes of the pieces that begin at each byte, _NONE where the text ends before the piece does.

    data: the bytes of texts one behind the other. ends: for each byte where its text ends.
    """
    left = ends - np.arange(len(data))
    h = data.astype(np.uint64)
    for k in (1, 2, 4):
        h = h | (_ahead(h, k) << np.uint64(8 * k))
    h = _mixed(h + _MIX[2])
    for level in range(LEVELS):
        gram = GRAM << level
        yield level, np.where(left >= gram, np.minimum(h, _NONE - np.uint64(1)), _NONE)
        h = _mixed(h * _MIX[2] + _ahead(h, gram))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and where each text begins, with the end of the last."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text of a batch once, with its least _id: copies don't come together in one task."""
    told = pa.Table.from_batches([batch.drop_columns(["_text", "_size"])]).append_column("_row", pa.array(np.arange(batch.num_rows)))
    first = told.group_by([c for c in batch.schema.names if c not in ("_id", "_size", "_text")]).aggregate([("_row", "min"), ("_id", "min")]).combine_chunks()
    if first.num_rows == batch.num_rows:
        return batch
    kept = batch.take(first.column("_row_min").combine_chunks())
    return kept.set_column(kept.schema.get_field_index("_id"), "_id", first.column("_id_min").combine_chunks())


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about AT_ONCE bytes of text at most, or of one text."""
    for batch in map(_once, batches):
        page = _bytes_of(batch.column("_text"))[1][:-1] // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _level_of(sizes: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(sizes, LEAST) / LEAST)).astype(np.int64), 0, LEVELS - 1)


def _windows(h: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """The hashes of the windows of a level that begin at the given bytes: two pieces cover a window."""
    return _mixed(h[at] * _MIX[1] + h[at + (RUN << level)])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_gram, _at, _piece and _level for each text (_text goes): the least hash of all its pieces at the level of its size (_piece),
    and around that piece the window that begins with it, or as late as the text lets it."""
    for batch in _pages(batches):
        data, at = _bytes_of(batch.column("_text"))
        sizes, level_of = np.diff(at), _level_of(np.diff(at))
        gram, piece, place = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
        for level, h in _levels(data, np.repeat(at[1:], sizes)):
            mine = np.flatnonzero(level_of == level)
            if len(mine):
                least = np.minimum.reduceat(h, at[:-1])
                hits = np.flatnonzero(h == np.repeat(least, sizes))
                first = np.minimum(hits[np.searchsorted(hits, at[mine])], at[mine + 1] - (GRAM + RUN << level))
                piece[mine], gram[mine], place[mine] = least[mine], _windows(h, first, level), first - at[mine]
        yield _with(batch, gram.view(np.int64), np.arange(batch.num_rows), _at=place, _piece=piece.view(np.int64), _level=level_of)


def _with(batch: pa.RecordBatch, gram: np.ndarray, rows: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    kept = batch.drop_columns(["_text"]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(gram), *map(pa.array, more.values())], names=[*kept.schema.names, "_gram", *more])


def _known(told: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers (unsigned) the filter knows, and a few more."""
    word, known = told[(numbers & np.uint64(len(told) - 1)).astype(np.int64)], np.ones(len(numbers), bool)
    for k in range(SET):
        known &= (word >> ((numbers >> np.uint64(WORD_BITS + 6 * k)) & np.uint64(63))) & np.uint64(1) == 1
    return known


def _kept(told: Broadcast):
    """The rows whose _gram the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_known(told.value, batch.column("_gram").to_numpy().view(np.uint64))))

    return run


def _asked(pieces: Broadcast, windows: Broadcast, levels: list[int]):
    """Of each text the windows that some text may be looked up by: _gram and _at, the byte of the text where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pages(batches):
            data, at = _bytes_of(batch.column("_text"))
            sizes = np.diff(at)
            starts, ends = np.repeat(at[:-1], sizes), np.repeat(at[1:], sizes)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for level, h in _levels(data, ends):
                run_, gram = RUN << level, GRAM << level
                if level not in levels:
                    continue
                least, k = h, 1
                while k < run_:
                    least, k = np.minimum(least, _ahead(least, k)), 2 * k
                # windows that lie in one text; a piece is kept where it is the least of one that it lies in
                least = np.where(ends - np.arange(len(h)) >= gram + run_ - 1, least, 0)
                most, k = least, 1
                while k < run_:
                    most, k = np.maximum(most, _ahead(most[::-1], k)[::-1]), 2 * k
                at_ = np.flatnonzero((h == most) & (h != _NONE))
                at_ = at_[_known(pieces.value, h[at_])]
                for before in range(run_ + 1):
                    begin = at_ - before
                    begin = begin[(begin >= starts[at_]) & (begin + gram + run_ <= ends[at_])]
                    hashes = _windows(h, begin, level)
                    passed = _known(windows.value, hashes)
                    found.append((begin[passed], hashes[passed]))
            places, grams = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            (places, grams) = np.unique(np.stack((places.view(np.uint64), grams)), axis=1) if len(places) else (places, grams)
            places = places.view(np.int64)
            rows = np.searchsorted(at, places, side="right") - 1
            yield _with(batch, grams.view(np.int64), rows, _at=places - starts[places])

    return run


def _filter(numbers: DataFrame, n: int) -> Broadcast:
    """A filter of n numbers (_gram). It comes together as words of 64 bits and is at most MOST_BITS, whatever the tables hold."""
    words = 1 << (min(max(n * BITS_EACH, LEAST_BITS), MOST_BITS) // 64 - 1).bit_length()
    set_ = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("_gram", WORD_BITS + 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(SET)]
    bits = reduce(lambda a, b: a.bitwiseOR(b), set_)
    # a power of two: the same for signed and unsigned numbers
    told = numbers.groupBy(F.pmod("_gram", F.lit(words)).cast("int").alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    filled = np.zeros(words, np.int64)
    filled[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return numbers.sparkSession.sparkContext.broadcast(filled.view(np.uint64))


def _digest(text: str | Column) -> Column:
    return F.unhex(F.md5(text))


def _parts_by_pieces(short: DataFrame, long_: DataFrame, on: list[str]) -> DataFrame:
    """on, _short_id, _long_id, _short, _long for groups of any size, a row for each place where a text (on, _id, _text) is part of
    a longer one. Equal texts may come more than once: the least _id stands for them.

    A text is looked up by a window around the piece of its least hash, and a longer one offers only windows that pass a filter of
    those: what is shuffled are the anchors and what they may meet, not every piece. A candidate says where in the longer text the other has
    to begin and what its digest is, so that of the texts only the longer ones of candidates are shuffled, and once.
    """
    keyed = lambda df: df.select(*on, "_id", _digest("_text").alias("_key"), F.octet_length("_text").alias("_size"), "_text")
    shape = ", ".join(f"`{c}` {t}" for c, t in short.select(*on).dtypes) + ", _id long, _key binary, _size int, _gram long, _at long"
    anchors = stored(keyed(short).mapInArrow(_anchors, shape + ", _piece long, _level long"), "anchors")
    levels = anchors.groupBy("_level").count().collect()
    if not levels:
        return long_.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in short.select(*on).dtypes) + ", _short_id long, _long_id long, _short string, _long string")
    n = sum(r["count"] for r in levels)
    told = _filter(anchors.select(F.col("_piece").alias("_gram")), n), _filter(anchors.select("_gram"), n)
    asked = keyed(long_).mapInArrow(_asked(*told, [r["_level"] for r in levels]), shape)
    # dealt as the join below deals them, so that rows are shuffled once
    one = lambda df: df.repartition(*on, "_gram").groupBy(*on, "_gram", "_key", "_size", "_at").agg(F.min("_id").alias("_id"))
    far = one(asked).select(*on, "_gram", F.col("_id").alias("_long_id"), F.col("_size").alias("_long_size"), F.col("_at").alias("_long_at"))
    met = one(anchors).withColumnRenamed("_id", "_short_id").join(far, [*on, "_gram"]).withColumn("_from", F.col("_long_at") - F.col("_at"))
    met = met.where("_size < _long_size and _from between 0 and _long_size - _size")
    met = stored(met.select(*on, "_short_id", "_key", "_size", "_from", "_long_id"), "met")
    wanted = _filter(met.select(F.xxhash64("_long_id").alias("_gram")), met.count())
    texts = long_.select(*on, F.col("_id").alias("_long_id"), F.col("_text").alias("_long"), F.xxhash64("_id").alias("_gram"))
    texts = texts.mapInArrow(_kept(wanted), texts.schema).drop("_gram")
    there = F.substring(F.col("_long").cast("binary"), (F.col("_from") + 1).cast("int"), F.col("_size"))
    found = met.join(texts, [*on, "_long_id"]).where(_digest(there) == F.col("_key"))
    return found.select(*on, "_short_id", "_long_id", there.cast("string").alias("_short"), "_long")


def _enough(texts: DataFrame) -> DataFrame:
    return texts.where(F.length("_text") >= LEAST)


def _few_and_many(texts: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The groups of at most FEW texts, and the larger ones; of these there is one for FEW texts at most."""
    sizes = stored(texts.groupBy(*on).agg(F.count("*").alias("_texts")), "sizes")
    return sizes.where(F.col("_texts") <= FEW).select(*on), sizes.where(F.col("_texts") > FEW).select(*on)


def _parts_by_pairs(short: DataFrame, long_: DataFrame, on: list[str]) -> DataFrame:
    """on, _short, _long by a join whose rows grow with the square of a group, and what else the sides have."""
    side = lambda df, name: df.withColumnRenamed("_text", name).withColumn(f"{name}_length", F.length(name))
    met = side(short, "_short").join(side(long_, "_long"), on)
    return met.where((F.col("_short_length") < F.col("_long_length")) & F.col("_long").contains(F.col("_short"))).drop("_short_length", "_long_length")


def _parts(short: DataFrame, long_: DataFrame, on: list[str]) -> DataFrame:
    """on, _short, _long: texts (stored ones best, they are read more than once) that are part of a longer one.

    Groups of few texts are compared pair by pair, in a join whose rows grow with FEW at most; larger ones go by pieces.
    """
    a, b = (_enough(df).select(*on, "_text") for df in (short, long_))
    few, many = _few_and_many(a if short is long_ else a.select(*on).union(b.select(*on)), on)
    pairs = _parts_by_pairs(a.join(few, on), b.join(few, on), on).select(*on, "_short", "_long")
    if many.isEmpty():
        return pairs
    told = lambda df: df.join(F.broadcast(many), on).select(*on, F.xxhash64("_text").alias("_id"), "_text")
    return pairs.unionByName(_parts_by_pieces(told(a), told(b), on).select(*on, "_short", "_long").distinct())


def texts_of(items: DataFrame, on: list[str]) -> DataFrame:
    """on, _text: the distinct normalised descriptions that aren't empty."""
    return items.select(*on, normalised(F.col("description")).alias("_text")).where("_text <> ''").distinct()


def like_texts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on, _left, _right: pairs of normalised descriptions of the two tables that are like by R9, each pair once.

    Null descriptions and rows with a null in `on` are like nothing. Empty tables give no row.
    """
    a, b = stored(texts_of(left, on), "texts"), stored(texts_of(right, on), "texts")
    same = a.join(b, [*on, "_text"]).select(*on, F.col("_text").alias("_left"), F.col("_text").alias("_right"))
    within = _parts(a, b, on).select(*on, F.col("_short").alias("_left"), F.col("_long").alias("_right"))
    around = _parts(b, a, on).select(*on, F.col("_long").alias("_left"), F.col("_short").alias("_right"))
    return same.union(within).union(around)


def like_components(texts: DataFrame, on: list[str]) -> DataFrame:
    """on, _text, _root of the distinct normalised texts (on, _text) that are like another one of their group by R9: texts that
    hang together through likeness have one root, a number; others may share it by chance, which only makes a group larger."""
    texts = stored(texts, "texts")
    pairs = _parts(texts, texts, on)
    node = lambda text: F.xxhash64(*on, text)
    pairs = stored(pairs, "like")
    roots = components(pairs.select(node("_short").alias("a"), node("_long").alias("b")))
    met = pairs.select(*on, F.explode(F.array("_short", "_long")).alias("_text")).distinct()
    return met.withColumn("node", node("_text")).join(roots, "node").select(*on, "_text", F.col("root").alias("_root"))


def like_items(items: DataFrame, on: list[str]) -> DataFrame:
    """id, other (id < other): pairs of items that stand for like texts, and each further item of a text with the first.

    The item of the least id stands for all that have its normalised description; copies aren't paired with one another. Copies
    are found by digests, so that texts are shuffled only as far as pairs of few and candidates by pieces ask for it.
    """
    told = items.select(F.col("id").alias("_id"), *on, normalised(F.col("description")).alias("_text")).where("_text <> ''").dropna(subset=on)
    told = stored(told, "told")
    digests = told.select("_id", *on, _digest("_text").alias("_key"))
    first = digests.groupBy(*on, "_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = digests.join(first, [*on, "_key"]).where("_id <> _first").select(F.col("_first").alias("id"), F.col("_id").alias("other"))
    few, many = _few_and_many(_enough(told), on)
    found = copies
    if not few.isEmpty():
        texts = stored(_enough(told).join(few, on).groupBy(*on, "_text").agg(F.min("_id").alias("_id")), "first")
        pairs = _parts_by_pairs(texts.withColumnRenamed("_id", "_short_id"), texts.withColumnRenamed("_id", "_long_id"), on)
        found = found.union(pairs.select(F.least("_short_id", "_long_id"), F.greatest("_short_id", "_long_id")))
    if not many.isEmpty():
        texts = _enough(told).join(F.broadcast(many), on)
        pairs = _parts_by_pieces(texts, texts, on).select(F.least("_short_id", "_long_id"), F.greatest("_short_id", "_long_id"))
        found = found.union(pairs.distinct())
    return found
