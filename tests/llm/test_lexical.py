"""Ranked lexical search against the formula term by term, and tiles at their bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from parley.llm import lexical  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    told = [(i, Counter(terms_of(t))) for i, t in docs]
    told = [(i, c) for i, c in told if c]
    n, total = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms_of(text)), []
        for i, c in told:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, `n.terms` string, score int, item int")


def items_frame(spark, rows):
    return spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, item_id long, `rank` int")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms_are_runs_of_letters_digits_and_wide_characters():
    texts = ["Ab-c9 ÉÀ漢字, x", None, "", "!!", "ÄB"]
    got, counts = lexical.terms(pa.array(texts))
    assert [t.decode() for t in got.to_pylist()] == ["ab", "c9", "ÉÀ漢字", "x", "Äb"] and counts.tolist() == [4, 0, 0, 0, 1]


def test_search_equals_the_formula(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "ÉTÉ", "漢字", "x1", "the", "of", "rare" * 9, "z"] + [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(200 + k, "the same words of every copy") for k in range(25)]  # ties by doc_id
    docs += [(None, "the same words of every copy"), (300, None), (301, ""), (302, "- ."), (303, "the " * 30_000), (7, "the same words"), (7, "the same words")]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(70)] + [(500, None), (501, "?"), (502, "the same words of every copy"), (503, "the " * 500 + "rare" * 9), (504, "notthere"), (502, "the same words")]
    assert found(lexical.search(frame(spark, docs).repartition(5), items_frame(spark, items))) == by_hand(docs, items)


def test_empty_tables(spark):
    some, none = frame(spark, [(1, "a b")]), frame(spark, [(1, "a b")]).limit(0)
    items = items_frame(spark, [(1, "a")])
    for docs, asked in ((none, items), (some, items.limit(0)), (frame(spark, [(1, None), (2, "..")]), items), (some, items_frame(spark, [(1, None)]))):
        got = lexical.search(docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_blocks_of_items_cover_all(spark, monkeypatch):
    docs = [(k, f"a{k % 7} b{k % 5} c{k % 3}") for k in range(90)]
    items = [(k, f"a{k % 7} c{k % 3}") for k in range(23)]
    whole = found(lexical.search(frame(spark, docs), items_frame(spark, items)))
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 10)
    assert [len(i) for i, _ in lexical.item_blocks(items_frame(spark, items).coalesce(1))] == [10, 10, 3]
    assert found(lexical.search(frame(spark, docs), items_frame(spark, items))) == whole == by_hand(docs, items)


def test_cuts_keep_sums_exact():
    weights = np.array([26_000, 5, 0, 25_999], np.int64)
    repeats = np.array([900_000, 3, 8, 100_000, 1])
    tile = lexical.ItemTile(0, np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 3]), repeats, weights)
    assert len(tile.cuts) > 1
    total = np.zeros((4, 2), np.int64)
    for columns, dense in tile.cuts:
        assert (dense.sum(axis=0) * lexical.MOST_IMPACT < lexical.EXACT).all() and len(set(columns)) == len(columns)
        np.add.at(total, columns, dense.astype(np.int64))
    assert total.tolist() == [[900_000 * 26_000, 100_000 * 26_000], [15, 0], [0, 0], [0, 25_999]]


def test_best_keeps_ties_of_a_tile():
    best = lexical.Best(1, 3)
    for ids in ([9, 8, 7, 6], [5, 4, 3, 2]):
        best.take(0, np.array([[7], [7], [7], [1]]), np.ones(4, np.int64), np.array(ids))
    assert best.rows[:, [1, 3]].tolist() == [[7, 3], [7, 4], [7, 5]]


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9], np.int64)
    assert lexical._exact_div(n, 75 * 10**12, 10**13).tolist() == [22, 7_500_000_000]
