"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are by document, so tokens are labelled first: words and word beginnings that occur in labelled toxic documents far
more often than in the others (a likelihood-ratio test over all distinct words of the sample) mark the tokens of toxic
documents. On those tokens a chain of two states is trained; its features are hashed: the word, its beginning and its two
neighbours. Forward-backward marginals then give each token's probability; a document's score is a logistic function of
the expected number of toxic tokens, their share and the largest marginal, and runs of likely tokens are its offending spans.

A token is a run of letters, digits and non-ASCII characters, in lower case. A chain is a whole text, however long.

Null, empty or wordless text: the score of a text without toxic tokens. Repeated rows: the same score. Without usable
labels (none, or of one kind only) every text has the same score, sigmoid(-9). An empty table gives no row. Of several labels
of one doc_id the largest counts. Columns other than text aren't read but passed on; names of the new ones are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.quality import sigmoid

#: Tokens of a chain that are worked on in one column of blocks, and of all chains in one step of training.
BLOCK, STEP_TOKENS = 64, 1 << 15
BEGINNING = 5
WORD_BITS, NEAR_BITS = 18, 14
#: Bounds of the samples: documents for each label in the word test and in training the chain, bytes of a text, words kept.
MOST_TESTED, MOST_TRAINED, LONGEST, MOST_WORDS = 10_000, 2_000, 1 << 14, 5_000
EPOCHS = 8
#: Tokens added to a text before the share of toxic ones is taken.
CALM = 50
THRESHOLD = 0.7
#: Tokens of at least this marginal make spans.
SPAN = 0.5

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Chain:
    """Weights of the hashed features (of state 1 against state 0), bias, transitions, and the document's calibration."""

    word: np.ndarray
    start: np.ndarray
    near: np.ndarray
    bias: float
    moves: np.ndarray
    document: np.ndarray


def tokens(texts: pa.Array):
    """Word hashes, hashes of the beginnings, starts and ends of the tokens in the flat bytes, counts by text, and the text."""
    from parley.llm.shared import Spans, flat, lower_ascii, runs

    data, at = flat(texts)
    low = lower_ascii(data)
    # upper-case letters of the Latin-1 block are two bytes: C3, then 80 to 9E
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low).astype(np.uint8)
    starts, ends, counts = runs(_WORDLIKE[data], at)
    spans = Spans(low)
    return spans.hash(starts, ends), spans.hash(starts, np.minimum(ends, starts + BEGINNING)) ^ np.uint64(0x5555555555555555), starts, ends, counts, (data, at)


def _features(word: np.ndarray, begin: np.ndarray, counts: np.ndarray):
    """Buckets: word, beginning, and the two neighbours (0 beyond the text's border)."""
    w = (word >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    b = (begin >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    near = ((word >> np.uint64(20)) & np.uint64((1 << NEAR_BITS - 1) - 1)).astype(np.int64)
    left, right = np.zeros_like(near), np.zeros_like(near)
    left[1:], right[:-1] = near[:-1], near[1:] + (1 << NEAR_BITS - 1)
    end = np.cumsum(counts)
    left[(end - counts)[counts > 0]] = 0
    right[end[counts > 0] - 1] = 1 << NEAR_BITS - 1
    return w, b, left, right


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains laid out in blocks of BLOCK tokens: first token, number of tokens and place in its chain of each block."""
    number = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), number)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    first = (np.cumsum(counts) - counts)[owner] + inside * BLOCK
    return first, np.minimum(counts[owner] - inside * BLOCK, BLOCK), inside


def _carried(start: np.ndarray, block: np.ndarray, chain_of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The state vector before each block, when that before a chain's first block is `start` and each block multiplies it."""
    out = np.empty((len(block), 2))
    out[place == 0] = start
    order = np.argsort(place, kind="stable")
    border = np.searchsorted(place[order], np.arange(place.max() + 2))
    for k in range(1, place.max() + 1):
        at = order[border[k] : border[k + 1]]
        v = np.einsum("nr,nrs->ns", out[chain_of[at]], block[chain_of[at]])
        out[at] = v / v.sum(axis=1, keepdims=True)
    return out


def forward_backward(emit: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for all tokens of all chains in one row, and the expected moves between states over all chains.

    emit: the score of state 1 against state 0. A chain has as many tokens as its text. It is laid out in blocks, whose
    products of transfer matrices carry the messages over their borders, so that blocks are worked on side by side.
    """
    if not len(emit):
        return np.zeros(0), np.zeros((2, 2))
    first, length, place = _blocks(counts)
    n = len(first)
    m, weight = np.exp(moves), np.exp(np.clip(emit, -30, 30))
    # one row for each place in a block, so that a step works on one row; beyond a block's end nothing changes
    token = np.minimum(first + np.arange(BLOCK)[:, None], len(emit) - 1)
    inside = np.arange(BLOCK)[:, None] < length
    e = weight[token]
    opens = place == 0
    full = int(length.min())

    def moved(k: int, v0: np.ndarray, v1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The messages behind place k of all blocks, from those before it."""
        u0, u1 = v0 * m[0, 0] + v1 * m[1, 0], v0 * m[0, 1] + v1 * m[1, 1]
        if k == 0:  # no move into a chain's first token
            u0[opens], u1[opens] = v0[opens], v1[opens]
        u1 *= e[k]
        if k >= full:
            u0, u1 = np.where(inside[k], u0, v0), np.where(inside[k], u1, v1)
        return u0, u1

    # transfer matrices of whole blocks: where each state before a block leads
    rows = [(np.ones(n), np.zeros(n)), (np.zeros(n), np.ones(n))]
    for k in range(BLOCK):
        rows = [moved(k, *v) for v in rows]
        scale = 1 / (rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1])
        rows = [(v0 * scale, v1 * scale) for v0, v1 in rows]
    whole = np.stack([np.stack(v, axis=1) for v in rows], axis=1)
    last = np.flatnonzero(np.append(opens[1:], True))
    before = _carried(np.full(2, 0.5), whole, np.arange(n) - 1, place)
    after = _carried(np.full(2, 0.5), whole.transpose(0, 2, 1), np.arange(n) + 1, np.repeat(place[last], place[last] + 1) - place)
    # messages as the share of state 1
    forward, backward = np.empty((BLOCK, n)), np.empty((BLOCK, n))
    v = before[:, 1].copy()
    for k in range(BLOCK):
        u0, u1 = moved(k, 1 - v, v)
        v = u1 / (u0 + u1)
        forward[k] = v
    v = after[:, 1].copy()
    for k in range(BLOCK - 1, -1, -1):
        backward[k] = v
        w = v * e[k]
        u0, u1 = (1 - v) * m[0, 0] + w * m[0, 1], (1 - v) * m[1, 0] + w * m[1, 1]
        u1 /= u0 + u1
        v = np.where(inside[k], u1, v) if k >= full else u1
    a, b = forward.T[inside.T], backward.T[inside.T]
    p = a * b / (a * b + (1 - a) * (1 - b))
    # moves into each token but a chain's first, by the messages on both sides
    into = np.ones(len(emit), bool)
    into[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(into)
    from_, to = (1 - a[at - 1], a[at - 1]), (1 - b[at], b[at] * weight[at])
    x = np.array([[from_[r] * to[s] * m[r, s] for s in (0, 1)] for r in (0, 1)])
    return p, (x / x.sum(axis=(0, 1))).sum(axis=2)


def marginals(model: Chain, word: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability that each token is toxic."""
    if not len(word):
        return np.zeros(0)
    w, b, left, right = _features(word, begin, counts)
    return forward_backward(model.bias + model.word[w] + model.start[b] + model.near[left] + model.near[right], counts, model.moves)[0]


def by_document(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the document's score is made of: 1, log(1 + expected toxic tokens), the log odds of the largest marginal (a
    third of them, within 8 either way), and the log of the expected toxic tokens among a hundred (short texts count as longer)."""
    from parley.llm.shared import sums_by

    most = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[some])
    number = np.maximum(sums_by(p, counts), 0)
    odds = np.clip(np.log(most + 1e-9) - np.log1p(1e-9 - most), -8, 8) / 3
    return np.stack((np.ones(len(counts)), np.log1p(number), odds, np.log1p(100 * number / (counts + CALM))), axis=1)


def fit(texts: pa.Array, label: np.ndarray, marked: np.ndarray) -> Chain:
    """Trains the chain on tokens whose word or beginning is among the marked hashes, in documents of label 1."""
    from parley.llm.shared import text_slices

    parts = []
    for part, begin_row, end_row in text_slices(texts):
        word, begin, _, _, n, _ = tokens(part)
        truth = (np.isin(word, marked) | np.isin(begin, marked)) & (np.repeat(label[begin_row:end_row], n) == 1)
        parts.append((truth, *(x.astype(np.int32) for x in _features(word, begin, n)), n))
    y, w, b, left, right, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
    first = np.cumsum(counts) - counts
    model = Chain(np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS), np.zeros(1 << NEAR_BITS), -2.0, np.zeros((2, 2)), np.array([-9.0, 0, 0, 0]))
    squares = [np.full(x.shape, 1e-4) for x in (model.word, model.start, model.near, model.moves)]
    bias_square, rng = 1e-4, np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(counts))
        # steps of whole chains, of about STEP_TOKENS tokens together
        for chains in np.split(order, np.flatnonzero(np.diff(np.cumsum(counts[order]) // STEP_TOKENS)) + 1) if len(order) else ():
            n = counts[chains]
            token = np.repeat(first[chains] - np.cumsum(n) + n, n) + np.arange(n.sum())
            truth = y[token].astype(np.int64)
            p, moves = forward_backward(model.bias + model.word[w[token]] + model.start[b[token]] + model.near[left[token]] + model.near[right[token]], n, model.moves)
            into = np.ones(len(token), bool)
            into[np.cumsum(n) - n] = False
            seen = np.bincount((truth[:-1] * 2 + truth[1:])[into[1:]], minlength=4).reshape(2, 2)
            error = p - truth
            for table, square, places, rate in ((model.word, squares[0], (w,), 0.5), (model.start, squares[1], (b,), 0.5), (model.near, squares[2], (left, right), 0.05)):
                for x in places:
                    found, back = np.unique(x[token], return_inverse=True)
                    g = np.bincount(back, error) + 1e-3 * table[found]
                    square[found] += g**2
                    table[found] -= rate * g / np.sqrt(square[found])
            g = (moves - seen) / 16
            squares[3] += g**2
            model.moves -= 0.1 * g / np.sqrt(squares[3])
            bias_square += error.sum() ** 2
            model.bias -= 0.5 * error.sum() / np.sqrt(bias_square)
    if 0 < label.sum() < len(label):
        x = []
        for part, _, _ in text_slices(texts):
            word, begin, _, _, n, _ = tokens(part)
            x.append(by_document(marginals(model, word, begin, n), n))
        x, weight = np.concatenate(x), np.zeros(4)
        for _ in range(40):  # Newton's method with a ridge
            q = sigmoid(x @ weight)
            ridge = np.diag([1e-3, 0.02, 0.02, 0.02])
            weight -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (q - label) + ridge @ weight)
        model.document = weight
    return model


def marked_words(rows: DataFrame, most: int = MOST_WORDS) -> np.ndarray:
    """Hashes of words and beginnings that stand in toxic documents far more often than in the others.

    rows: text, label. Counts documents, in tasks and then by hash; at most `most` hashes, the most telling, are returned.
    """

    from parley.llm.shared import slices

    def run(batches):
        for batch in slices(batches):
            word, begin, _, _, counts, _ = tokens(batch.column("text"))
            owner = np.repeat(np.arange(len(counts)), counts)
            label = batch.column("label").to_numpy()
            for hashes in (word, begin):
                pair = np.unique(np.stack((owner.astype(np.uint64), hashes)), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
                toxic = label[pair[0].astype(np.int64)] == 1
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((~toxic).astype(np.int64))], names=["hash", "t", "c"])

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    if not t or not c:
        return np.zeros(0, np.uint64)
    found = rows.select("text", "label").mapInArrow(run, "hash long, t long, c long").groupBy("hash").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # twice the log likelihood ratio of one rate for each label against one rate for both, from presence counts
    part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("t") + F.col("c")) * share))).otherwise(0.0)
    ratio = 2 * (part("t", t / (t + c)) + part("c", c / (t + c)))
    # so that chance marks about one of as many words as a sample of this size has
    least = 2 * np.log(300 * (t + c))
    telling = found.where((F.col("t") * c > 8 * F.col("c") * t) & (F.col("t") >= 3)).select("hash", ratio.alias("g")).where(F.col("g") > float(least))
    top = telling.orderBy(F.desc("g"), "hash").limit(most).toArrow()
    return top.column("hash").to_numpy().view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, keep=None) -> Chain:
    """Fits on bounded samples of the labelled documents that `keep` (a condition on doc_id) admits."""
    from parley.llm import labelled

    rows = labelled.sample(docs, labels, "toxic", MOST_TESTED, keep, LONGEST)
    marked = marked_words(rows)
    few = labelled.sample(docs, labels, "toxic", MOST_TRAINED, keep, LONGEST).select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    texts = few.column("text").combine_chunks() if few.num_rows else pa.array([], pa.string())
    return fit(texts, few.column("label").to_numpy().astype(np.int64), marked)


def spans_of(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, data: np.ndarray, at: np.ndarray):
    """Runs of likely tokens: their starts and ends in code points of their text, and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    likely = p >= SPAN
    opens, closes = likely.copy(), likely.copy()
    opens[1:] &= ~likely[:-1] | (owner[1:] != owner[:-1])
    closes[:-1] &= ~likely[1:] | (owner[1:] != owner[:-1])
    characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = characters[at[:-1]][owner[opens]]
    return characters[starts[opens]] - base, characters[ends[closes]] - base, np.bincount(owner[opens], minlength=len(counts))


def toxicity(docs: DataFrame, model: Chain, kept: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("toxic_score", "toxic_spans")) -> DataFrame:
    """The kept columns, then the score and the spans (code point offsets) of every whole text under the given names."""
    from parley.llm.shared import list_array, named, numbered, slices

    read = list(dict.fromkeys((*kept, "text")))
    docs = numbered(docs.select(named(docs, read)))
    text, passed = f"c{read.index('text')}", [f"c{read.index(c)}" for c in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, text):
            word, begin, starts, ends, counts, (data, at) = tokens(batch.column(text))
            p = marginals(model, word, begin, counts)
            score = sigmoid(by_document(p, counts) @ model.document)
            a, b, n = spans_of(p, starts, ends, counts, data, at)
            spans = list_array(pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["start", "end"]), n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(score), spans], names=[*passed, *names])

    schema = T.StructType(docs.select(*passed).schema.fields[:]).add(names[0], "double").add(names[1], T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")))
    return docs.mapInArrow(run, schema).toDF(*kept, *names)
