"""A log-bilinear language model trained by noise-contrastive estimation, and corpus-wide unigram counts.

Counts cover every training document. The items of the model are words: each word that the training documents have LEAST_COUNT
times or oftener has vectors of its own, up to MOST_OWN of them, and all other words share an item with those of the same
first two bytes. The vectors of the last words, each scaled by its place, add up to a prediction. Items are dealt into groups
by the company they keep, and the probability of an item is that of its group times that within the group, each a softmax
over products with the prediction: a batch of tokens is a matrix product, and probabilities are normalised exactly. A word of
a shared item has the item's probability times its share by the smoothed counts, in which the item has one more place for
words that were never seen.

Training learns from every position of every training document, PASSES times. Documents are dealt by a hash into shards of
about SHARD_TOKENS tokens and lie in hash order there. In each pass every shard goes on from the model so far, and the shards'
models are averaged in whole numbers. So the model depends on the documents, not on how they are partitioned.

Null text: as the empty text, the end token alone. Repeated rows: counted, learnt and scored as they are. Very long texts: one
row each, learnt and scored whole. No training documents: no counts, and the model is uniform over items. Null doc_id: a
training document. An empty table gives no row. Only doc_id and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with vectors of their own: how often they must occur, and how many at most; items that the other words share.
LEAST_COUNT, MOST_OWN, SHARED = 16, 8_000, 192
DIMENSIONS, CONTEXT = 24, 4
#: Noise groups of a step, noise items of each run of equal groups, positions of a step, positions of a run.
NOISE_GROUPS, NOISE_ITEMS, BATCH, RUN = 16, 16, 1 << 13, 64
PASSES, RATES = 2, (0.7, 0.2)
SHARD_TOKENS, MOST_PARTS = 1 << 21, 100_000
#: Vectors multiplied at a time by one scale.
TILE = 8
#: Positions shuffled together before they are learnt from.
AT_ONCE = 1 << 16
#: The items by whose company the others are grouped.
COMPANY = 64
#: Frequent words whose counts every task has; the others' counts are joined.
KNOWN_WORDS = 1 << 17
END = np.uint64(0x0123456789ABCDEF)
#: Averages are taken over whole multiples of this.
UNIT = 2.0**-24
_LN10 = np.log(10.0)


def is_training(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 1, F.lit(True))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and the end token of each text, their shared items, and the number of tokens by text."""
    from parley.llm.shared import IS_SPACE, Spans, flat, lower_ascii, runs

    data, at = flat(texts)
    low = lower_ascii(data).astype(np.uint8)
    starts, ends, counts = runs(~IS_SPACE[data], at)
    words = Spans(low).hash(starts, ends)
    two = low[starts].astype(np.int64) * 256 + np.where(ends - starts > 1, low[np.minimum(starts + 1, max(len(low) - 1, 0))] if len(low) else 0, 0)
    shared = (two * 2654435761 >> 12) % SHARED
    border = np.cumsum(counts)
    return np.insert(words, border, END), np.insert(shared, border, 0).astype(np.int16), counts + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, shared, n of every distinct token of all documents."""
    from parley.llm.shared import slices

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            words, shared, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, back = np.unique(words, return_index=True, return_inverse=True)
            return found, shared[first], np.bincount(back, n).astype(np.int64)

        def out(found, shared, n):
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(shared), pa.array(n)], names=["hash", "shared", "n"])

        for batch in slices(batches):
            words, shared, _ = tokens(batch.column("text"))
            held.append((words, shared, np.ones(len(words), np.int64)))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*merged())

    found = docs.select("text").mapInArrow(run, "hash long, shared short, n long")
    return found.groupBy("hash", "shared").agg(F.sum("n").alias("n"))


class Table:
    """Places of 64-bit hashes among known ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.place[slot] < 0
            self.place[slot[free][::-1]] = left[free][::-1]  # of several for one slot the first stays
            self.keys[slot[free]] = keys[self.place[slot[free]]]
            left, step = left[self.place[slot] != left], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.place[slot], -1)
        left = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        for step in range(1, self.steps):
            slot = self._slot(keys[left], step)
            place = self.place[slot]
            hit = (self.keys[slot] == keys[left]) & (place >= 0)
            out[left[hit]] = place[hit]
            left = left[~hit & (place >= 0)]
        return out


@dataclass
class Vocabulary:
    """What every task knows: totals, the frequent words with counts and items, and the weight of each item.

    Items are numbered by group: item = group x width + place in it; a place without an item has weight 0.
    """

    total: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    items: np.ndarray  # of the frequent words
    shared: np.ndarray  # the items of the shared classes
    groups: int
    width: int
    weight: np.ndarray  # of each item, with 0.5 for unseen words in each shared one

    def __post_init__(self):
        self._table = None

    def look_up(self, words: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item of each token, and its count, -1 if it isn't among the frequent words."""
        if not len(self.words):
            return self.shared[shared], np.full(len(words), -1)
        if self._table is None:
            self._table = Table(self.words)
        at = self._table.find(words)
        return np.where(at >= 0, self.items[at], self.shared[shared]), np.where(at >= 0, self.counts[at], -1)

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def is_shared(self) -> np.ndarray:
        out = np.zeros(self.groups * self.width, bool)
        out[self.shared] = True
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From stored counts; all items in one group yet. To the driver go KNOWN_WORDS rows and one for each shared item."""
    top = counts.orderBy(F.desc("n"), "hash").limit(KNOWN_WORDS).toArrow()
    words, shared, n = top.column("hash").to_numpy().view(np.uint64), top.column("shared").to_numpy(), top.column("n").to_numpy()
    own = min(MOST_OWN, int((n >= LEAST_COUNT).sum()))
    items = np.where(np.arange(len(words)) < own, np.arange(len(words)), own + shared).astype(np.int32)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weight = np.zeros(own + SHARED)
    weight[own:] = 0.5
    for r in counts.groupBy("shared").agg(F.sum(F.col("n") + 0.5).alias("w")).collect():
        weight[own + r["shared"]] += r["w"]
    weight[:own] = n[:own] + 0.5
    np.subtract.at(weight, own + shared[:own], n[:own] + 0.5)
    return Vocabulary(int(totals[0]), int(totals[1]), words, n.astype(np.int64), items, own + np.arange(SHARED, dtype=np.int32), 1, own + SHARED, np.maximum(weight, 0.5))


def _in_groups(features: np.ndarray, groups: int) -> np.ndarray:
    """A group for each row: halves by the median along the direction in which the rows differ most, again and again."""
    out = np.zeros(len(features), np.int64)
    for _ in range(groups.bit_length() - 1):
        out *= 2
        for g in np.unique(out):
            rows = np.flatnonzero(out == g)
            x = features[rows] - features[rows].mean(axis=0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            out[rows[np.argsort(along, kind="stable")[len(rows) // 2 :]]] += 1
    return out


def grouped(vocab: Vocabulary, company: np.ndarray) -> Vocabulary:
    """The vocabulary with its items dealt into about as many groups as a group has items.

    company: for each item how often each of the COMPANY heaviest items stands before it and behind it.
    """
    n = len(vocab.weight)
    groups = 1 << round(np.log2(np.sqrt(n)))
    share = company.sum(axis=0, keepdims=True) / max(company.sum(), 1)
    seen = company.sum(axis=1, keepdims=True)
    features = np.log((company + 5 * share + 1e-9) / ((seen + 5) * share + 1e-9)) * np.sqrt(share)
    group = _in_groups(features, groups)
    width = int(np.bincount(group, minlength=groups).max())
    order = np.argsort(group, kind="stable")
    item = np.empty(n, np.int32)
    item[order] = group[order] * width + np.arange(n) - np.searchsorted(group[order], group[order])
    weight = np.zeros(groups * width)
    weight[item] = vocab.weight
    return Vocabulary(vocab.total, vocab.distinct, vocab.words, vocab.counts, item[vocab.items], item[vocab.shared], groups, width, weight)


def start(vocab: Vocabulary) -> dict[str, np.ndarray]:
    """A model that predicts by the items' weights alone, with small random vectors."""
    rng = np.random.default_rng(1)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    size = vocab.groups * vocab.width
    by_group = vocab.weight.reshape(vocab.groups, -1).sum(axis=1)
    with np.errstate(divide="ignore"):
        item_bias = np.log(vocab.weight / np.repeat(by_group, vocab.width))
    item_bias[vocab.weight == 0] = -80.0  # no item there
    return {
        "context": small(size + 1, DIMENSIONS),
        "place": np.full((CONTEXT, DIMENSIONS), 1 / CONTEXT, np.float32),
        "group": small(vocab.groups, DIMENSIONS),
        "group_bias": np.log(by_group / by_group.sum()).astype(np.float32),
        "item": small(size, DIMENSIONS),
        "item_bias": item_bias.astype(np.float32),
    }


def laid_out(items: np.ndarray, counts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The items with CONTEXT times `none` before each text, so that no context reaches over a text's start, and `none` up to
    a multiple of TILE; and the places of the items in that row."""
    place = np.arange(len(items)) + CONTEXT * np.repeat(np.arange(1, len(counts) + 1), counts)
    row = np.full(-(-(len(items) + CONTEXT * len(counts)) // TILE) * TILE, none, np.int32)
    row[place] = items
    return row, place


def scaled(vectors: np.ndarray, by: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each row times `by`, TILE rows at a time; their number is a multiple of TILE."""
    wide = (-1, TILE * vectors.shape[1])
    np.multiply(vectors.reshape(wide), np.tile(by, TILE), out=out.reshape(wide))
    return out


def predictions(vectors: np.ndarray, place: np.ndarray) -> np.ndarray:
    """From the vectors of a row of items, for each place the sum of those of the CONTEXT items before it, each scaled by its
    distance."""
    out, part = np.zeros_like(vectors), np.empty_like(vectors)
    for k in range(CONTEXT):
        out[k + 1 :] += scaled(vectors, place[k], part)[: len(vectors) - k - 1]
    return out


def runs_of(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values in runs of equal ones, of at most `longest`: the place of each run's first, and each place's run."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    begins = np.flatnonzero((np.arange(len(values)) - first) % longest == 0)
    return begins, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(values))))


def _sum_into(out: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """Adds to the rows of out, by key, the values of a row of sorted keys; two columns are added at a time, as one complex."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    out[keys[begins]] += np.add.reduceat(values.view(np.complex64), begins, axis=0).view(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation by Adagrad, of groups and of items within the group. The noise is drawn by weight, the
    groups' once for a step, the items' once for each run of positions with one group."""

    def __init__(self, model: dict[str, np.ndarray], vocab: Vocabulary, rate: float, seed: int):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in model.items()}
        self.groups, self.width, self.rate, self.rng, self.seen = vocab.groups, vocab.width, np.float32(rate), np.random.default_rng(seed), 0
        weight = vocab.weight.reshape(vocab.groups, -1)
        by_group = weight.sum(axis=1)
        self.group_cumulated = np.cumsum(by_group / by_group.sum())
        self.log_group = np.log(NOISE_GROUPS * by_group / by_group.sum()).astype(np.float32)
        self.log_item = np.log(NOISE_ITEMS * np.maximum(weight / by_group[:, None], 1e-30)).astype(np.float32).ravel()
        # one rising row for all groups: group + cumulated share in it
        self.item_cumulated = (np.minimum(np.cumsum(weight / by_group[:, None], axis=1), 1 - 1e-9) + np.arange(vocab.groups)[:, None]).ravel()

    def learn(self, items: np.ndarray, counts: np.ndarray) -> None:
        """One step over each stretch of whole texts of about BATCH items; a longer text has steps of its own."""
        end = np.cumsum(counts)
        first = 0
        while first < len(counts):
            at = end[first] - counts[first]
            last = max(first + 1, int(np.searchsorted(end, at + BATCH, "right")))
            if last == first + 1 and counts[first] > BATCH:
                for start in range(0, counts[first], BATCH):  # with the items before it as context
                    begin = max(0, start - CONTEXT)
                    self._step(items[at + begin : at + min(start + BATCH, counts[first])], np.array([min(start + BATCH, counts[first]) - begin]), start - begin)
            else:
                self._step(items[at : end[last - 1]], counts[first:last], 0)
            first = last
        self.seen += len(items)

    def _move(self, name: str, gradient: np.ndarray) -> None:
        square, part = self.squares[name], np.multiply(gradient, gradient)
        square += part
        np.sqrt(square, out=part)
        np.divide(gradient, part, out=part)
        part *= self.rate
        self.model[name] -= part

    def _step(self, items: np.ndarray, counts: np.ndarray, skipped: int) -> None:
        """Learns from all items but the first `skipped` ones, which are there as context."""
        m, size = self.model, self.groups * self.width
        row, place = laid_out(items, counts, size)
        seen = m["context"].take(row, axis=0)
        all_h = predictions(seen, m["place"])
        place = place[skipped:]
        target = row[place]
        order = np.argsort(target.astype(np.int16), kind="stable")  # by item, so by group
        place, target = place[order], target[order]
        h, n = all_h.take(place, axis=0), len(target)
        scale, ones = np.float32(1 / n), np.ones(DIMENSIONS, np.float32)
        # groups
        group = target // self.width
        noise = np.minimum(np.searchsorted(self.group_cumulated, self.rng.random(NOISE_GROUPS)), self.groups - 1)
        bias = m["group_bias"] - self.log_group
        mine, vectors = m["group"].take(group, axis=0), m["group"][noise]
        own = (_sigmoid((h * mine) @ ones + bias[group]) - 1) * scale
        false = vectors @ h.T  # a row for each noise group
        false += bias[noise][:, None]
        false = _sigmoid(false)
        false *= scale
        mine *= own[:, None]
        g_all = np.zeros((n + 1, DIMENSIONS), np.float32)  # the last row for places that nothing is learnt at
        g_h = g_all[:n]
        np.matmul(false.T, vectors, out=g_h)
        g_h += mine
        drawn_by = (noise == np.arange(self.groups)[:, None]).astype(np.float32)
        by_group = drawn_by @ (false @ h)
        by_bias = drawn_by @ false.sum(axis=1) + np.bincount(group, own, self.groups).astype(np.float32)
        # items within the group, in runs of positions with one group; a run's matrices are padded to its full length
        begins, run = runs_of(group, RUN)
        cell = run * RUN + np.arange(n) - begins[run]
        drawn = np.searchsorted(self.item_cumulated, group[begins][:, None] + self.rng.random((len(begins), NOISE_ITEMS)))
        place_of = np.zeros(len(begins) * RUN, np.int64)  # nothing stands before place 0, so its prediction is 0
        place_of[cell] = place
        h_run = all_h.take(place_of, axis=0).reshape(len(begins), RUN, DIMENSIONS)
        some, own_run = np.zeros((2, len(begins) * RUN), np.float32)
        some[cell], own_run[cell] = scale, own
        _sum_into(by_group, group[begins], (own_run.reshape(len(begins), 1, RUN) @ h_run)[:, 0])
        vectors, bias = m["item"].take(drawn, axis=0), m["item_bias"] - self.log_item
        false = vectors @ h_run.transpose(0, 2, 1)
        false += bias[drawn][:, :, None]
        false = _sigmoid(false)
        false *= some.reshape(len(begins), 1, RUN)
        mine = m["item"].take(target, axis=0)
        own = (_sigmoid((h * mine) @ ones + bias[target]) - 1) * scale
        mine *= own[:, None]
        g_h += mine
        g_h += (false.transpose(0, 2, 1) @ vectors).reshape(-1, DIMENSIONS).take(cell, axis=0)
        by_item = np.zeros_like(m["item"])
        h *= own[:, None]
        _sum_into(by_item, target, h)
        keys = drawn.ravel()
        sort = np.argsort(keys.astype(np.int16), kind="stable")
        _sum_into(by_item, keys[sort], (false @ h_run).reshape(-1, DIMENSIONS).take(sort, axis=0))
        by_item_bias = (np.bincount(target, own, size) + np.bincount(keys, false.sum(axis=2).ravel(), size)).astype(np.float32)
        # back to the order of the row: an item's vector is moved by all predictions that it is part of
        learnt = np.full(len(row), n)
        learnt[place] = np.arange(n)
        all_g = g_all.take(learnt, axis=0)
        back, part = np.zeros_like(all_h), np.empty_like(all_h)
        by_place = np.zeros_like(m["place"])
        for k in range(CONTEXT):
            back[: -k - 1] += scaled(all_g, m["place"][k], part)[k + 1 :]
            by_place[k] = np.ones(len(row) - k - 1, np.float32) @ np.multiply(seen[: -k - 1], all_g[k + 1 :], out=part[: -k - 1])
        sort = np.argsort(row.astype(np.int16), kind="stable")
        by_context = np.zeros_like(m["context"])
        _sum_into(by_context, row[sort], back.take(sort, axis=0))
        for name, gradient in (("group", by_group), ("group_bias", by_bias), ("item", by_item), ("item_bias", by_item_bias), ("place", by_place), ("context", by_context)):
            self._move(name, gradient)


def log_probability(model: dict[str, np.ndarray], items: np.ndarray, counts: np.ndarray, batch: int = 1 << 15) -> np.ndarray:
    """Natural logarithms of the normalised probability of each item of each text after the items before it."""
    groups = len(model["group"])
    width = len(model["item"]) // groups
    # with the biases as one more dimension, in which predictions are 1
    group_vectors = np.concatenate([model["group"].T, model["group_bias"][None]])
    item_vectors = np.concatenate([model["item"].reshape(groups, width, -1).transpose(0, 2, 1), model["item_bias"].reshape(groups, 1, width)], axis=1)
    ones = np.ones(max(groups, width), np.float32)

    def softmax(h: np.ndarray, vectors: np.ndarray, mine: np.ndarray, out: np.ndarray) -> None:
        """Adds to out the logarithm of the share of each row's own score, a slice of rows at a time."""
        for a in range(0, len(h), 1024):
            score = h[a : a + 1024] @ vectors
            if score.max() > 60:
                score -= score.max(axis=1, keepdims=True)
            own = score[np.arange(len(score)), mine[a : a + 1024]]
            np.exp(score, out=score)
            out[a : a + 1024] += own - np.log(score @ ones[: score.shape[1]])

    row, place = laid_out(items, counts, groups * width)
    out = np.zeros(len(items))
    for at in range(0, len(items), batch):
        some = place[at : at + batch]
        low = (some[0] - CONTEXT) // TILE * TILE
        predicted = predictions(model["context"].take(row[low : -(-(some[-1] + 1) // TILE) * TILE], axis=0), model["place"])
        order = np.argsort(row[some].astype(np.int16), kind="stable")
        t = row[some][order]
        h = np.ones((len(t), predicted.shape[1] + 1), np.float32)
        h[:, :-1] = predicted.take(some[order] - low, axis=0)
        group, place_in = t // width, t % width
        found = np.zeros(len(t), np.float64)
        softmax(h, group_vectors, group, found)
        border = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(t))
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            softmax(h[a:b], item_vectors[group[a]], place_in[a:b], found[a:b])
        out[at + order] = found
    return out


def _ids(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, row, training, n_tokens, known, smooth, share, items (16-bit numbers), rare, times of every whole text.

    smooth: the sum of the logarithms of the smoothed counts of the frequent words; share: of those among them that share an
    item. items: numbers in the ungrouped vocabulary. rare: hashes of the tokens outside the frequent words, each once.
    """
    from parley.llm.shared import list_array, slices, sums_by

    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        vocab = sent.value
        task, row, is_shared = TaskContext.get().partitionId(), 0, vocab.is_shared()
        for batch in slices(batches):
            words, shared, n = tokens(batch.column("text"))
            items, count = vocab.look_up(words, shared)
            known = count >= 0
            smooth = np.where(known, np.log(np.maximum(count, 0) + 0.5), 0)
            owner = np.repeat(np.arange(len(n)), n)[~known]
            rare = words[~known]
            order = np.lexsort((rare, owner))
            owner, rare = owner[order], rare[order]
            fresh = np.ones(len(rare), bool)
            fresh[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
            times = np.diff(np.append(np.flatnonzero(fresh), len(rare)))
            number = np.bincount(owner[fresh], minlength=len(n))
            raw, end = items.astype("<i2").tobytes(), (2 * np.cumsum(n)).tolist()
            columns = [
                batch.column("doc_id"),
                pa.array((task << 40) + row + np.arange(len(n))),
                batch.column("training"),
                pa.array(n, pa.int64()),
                pa.array(sums_by(known.astype(float), n).astype(np.int64)),
                pa.array(sums_by(smooth, n)),
                pa.array(sums_by(np.where(is_shared[items], smooth, 0), n)),
                pa.array([raw[e - 2 * k : e] for e, k in zip(end, n.tolist(), strict=True)], pa.binary()),
                list_array(pa.array(rare[fresh].view(np.int64)), number),
                list_array(pa.array(times.astype(np.int32)), number),
            ]
            row += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "training", "n_tokens", "known", "smooth", "share", "items", "rare", "times"])

    told = docs.select("doc_id", "text", is_training().alias("training"))
    return told.mapInArrow(run, "doc_id long, row long, training boolean, n_tokens long, known long, smooth double, share double, items binary, rare array<long>, times array<int>")


def _items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of all texts of a column of `_ids` in one array, and how many each text has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i2").astype(np.int32), np.array([len(x) // 2 for x in raw], np.int64)


def _total(parts: DataFrame) -> tuple[np.ndarray | None, int]:
    """The sum of rows (sums: 64-bit whole numbers as bytes, n) of all tasks, added up in three levels; exact in any order."""

    def summed(batches):
        total, n = None, 0
        for batch in batches:
            for raw, k in zip(batch.column("sums").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total, n = np.frombuffer(raw, np.int64) + (0 if total is None else total), n + k
        if n:
            yield _sum_row(total, n)

    kind = "sums binary, n long"
    rows = parts.repartition(16).mapInArrow(summed, kind).repartition(2).mapInArrow(summed, kind).collect()  # two rows
    return (sum(np.frombuffer(r["sums"], np.int64) for r in rows), sum(r["n"] for r in rows)) if rows else (None, 0)


def _sum_row(total: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])


def company_of(ids: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Of each item how often each of the COMPANY heaviest items stands before it, and behind it.

    To the driver goes a row for each such pair that occurs: at most 2 x COMPANY for each item.
    """
    n = len(vocab.weight)
    heavy = np.argsort(-vocab.weight, kind="stable")[:COMPANY]
    place = np.full(n, -1, np.int64)
    place[heavy] = np.arange(len(heavy))

    def run(batches):
        total = np.zeros(2 * n * COMPANY, np.int64)
        for batch in batches:
            items, counts = _items(batch.column("items"))
            if len(items) > 1:
                ends = np.cumsum(counts)[:-1] - 1  # pairs over a text's end don't count
                together = np.ones(len(items) - 1, bool)
                together[ends[(ends >= 0) & (ends < len(together))]] = False
                for side, (mine, other) in enumerate(((items[1:], items[:-1]), (items[:-1], items[1:]))):
                    at = together & (place[other] >= 0)
                    np.add.at(total, (side * n + mine[at]) * COMPANY + place[other[at]], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    cells = ids.select("items").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * n * COMPANY)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return np.concatenate(out.reshape(2, n, COMPANY), axis=1)


def train(ids: DataFrame, plain: Vocabulary, vocab: Vocabulary, passes: int = PASSES) -> dict[str, np.ndarray]:
    """The model learnt from the rows of ids, those of `plain`, with the items of the grouped vocabulary."""
    spark = ids.sparkSession
    new = np.zeros(len(plain.weight), np.int32)
    new[plain.items], new[plain.shared] = vocab.items, vocab.shared
    shards = max(1, -(-plain.total // SHARD_TOKENS))
    model = start(vocab)
    names, shapes = list(model), {k: v.shape for k, v in model.items()}
    hashed = F.xxhash64("doc_id", F.lit(3))
    rows = ids.select(F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), hashed.alias("h"), "items")
    parts = min(shards, MOST_PARTS)
    rows = rows.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "h", "items").drop("h")
    for k in range(passes):
        sent = spark.sparkContext.broadcast((model, vocab, new))
        rate = RATES[min(k, len(RATES) - 1)]

        def run(batches, sent=sent, rate=rate, k=k):
            model, vocab, new = sent.value
            total, n, shard, trainer, held, waiting = None, 0, None, None, [], 0

            def learn():
                counts = np.array([len(x) for x in held])
                trainer.learn(np.concatenate(held), counts)

            def done():
                if held:
                    learn()
                flat = np.concatenate([trainer.model[name].ravel() for name in names]).astype(np.float64)
                return np.rint(flat / UNIT).astype(np.int64) + (0 if total is None else total)

            for batch in batches:
                # row by row, so that steps don't depend on the borders of batches
                for number, raw in zip(batch.column("shard").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    if number != shard:
                        if trainer is not None:
                            total, n = done(), n + 1
                        shard, trainer, held, waiting = number, Trainer(model, vocab, rate, 1000 * k + number), [], 0
                    held.append(new[np.frombuffer(raw, "<i2")])
                    waiting += len(held[-1])
                    if waiting >= AT_ONCE:
                        learn()
                        held, waiting = [], 0
            if trainer is not None:
                yield _sum_row(done(), n + 1)

        total, n = _total(rows.mapInArrow(run, "sums binary, n long"))
        if total is None:
            return model
        flat, at, model = (total / n * UNIT).astype(np.float32), 0, {}
        for name in names:
            size = int(np.prod(shapes[name]))
            model[name] = flat[at : at + size].reshape(shapes[name])
            at += size
    return model


def score(ids: DataFrame, counts: DataFrame, plain: Vocabulary, vocab: Vocabulary, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ids.

    Tokens outside the frequent words are joined with their counts; a hash of such a token goes out once for each document.
    """
    from parley.llm.shared import sums_by

    new = np.zeros(len(plain.weight), np.int32)
    new[plain.items], new[plain.shared] = vocab.items, vocab.shared
    sent = ids.sparkSession.sparkContext.broadcast((model, vocab, new))

    def run(batches):
        model, vocab, new = sent.value
        # within a shared item: the word's share; its smoothed count is in `share` or follows by the join
        apart = np.where(vocab.is_shared(), np.log(np.maximum(vocab.weight, 1e-9)), 0)
        columns = ("doc_id", "row", "n_tokens", "known", "smooth")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                items, n = _items(part.column("items"))
                items = new[items]
                mine = log_probability(model, items, n) - apart[items]
                mine = sums_by(mine, n) + part.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(mine)], names=[*columns, "mine"])

    told = ids.select("doc_id", "row", "n_tokens", "known", "smooth", "share", "items").mapInArrow(run, "doc_id long, row long, n_tokens long, known long, smooth double, mine double")
    pairs = ids.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    found = pairs.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    whole = float(np.log(vocab.total + 0.5 * (vocab.distinct + 1)))
    return told.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        ((F.col("smooth") + logs - F.col("n_tokens") * whole) / float(_LN10)).alias("base_score"),
        ((F.col("mine") + logs) / float(_LN10)).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Counts and learns from the training documents (`is_training`), then scores all documents."""
    from parley.llm.shared import stored

    counts = stored(word_counts(docs.where(is_training()).select("doc_id", "text")), "word-counts")
    plain = vocabulary(counts)
    ids = stored(_ids(docs, plain), "items")
    training = ids.where("training")
    vocab = grouped(plain, company_of(training, plain))
    return score(ids, counts, plain, vocab, train(training, plain, vocab))
