"""Joins of like texts against a comparison of every pair."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from parley.functions.text import similar
from parley.operators import likeness
from parley.operators.likeness import like_items, like_texts
from parley.operators.replies import recovery_merge


def descriptions(seed, n):
    rng = random.Random(seed)
    said = ["Ship the installer", "ship the installer by Friday", "the vendor is late", "The vendor is late with the parts!", "risk", "a risk", "请在周五之前完成安装程序的测试和部署工作", "请在周五之前完成安装程序的测试和部署", "!!!", "", None]
    return [rng.choice(said) if rng.random() < 0.7 else " ".join(filter(None, rng.sample(said, 2))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, meeting_id long, category string, description string, _text string")


@pytest.fixture(scope="module")
def sides(spark):
    new = [(k, k % 2, "risks" if k % 3 else "issues", t, "x") for k, t in enumerate(descriptions(1, 40))]
    old = [(100 + k, k % 2, "risks" if k % 3 else None, t, "y") for k, t in enumerate(descriptions(2, 12))]
    return frame(spark, new), frame(spark, old)


def like(spark, pairs):
    """Which of the pairs of descriptions are like by the plain rule."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    return {r["i"] for r in rows.where(similar(F.col("a"), F.col("b"))).select("i").collect()}


def test_recovery_merge_equals_every_pair(spark, sides):
    new, old = sides
    n, o = new.collect(), old.collect()
    pairs = [(a, b) for a, b in product(n, o) if (a["meeting_id"], a["category"]) == (b["meeting_id"], b["category"])]
    found = like(spark, [(a["description"], b["description"]) for a, b in pairs])
    gone = {pairs[i][0]["id"] for i in found}
    got = recovery_merge(new, old)
    assert got.columns == new.columns
    assert 0 < len(gone) < len(n)
    assert sorted(r["id"] for r in got.collect()) == sorted({r["id"] for r in n} - gone)


def test_like_items_hang_together_as_every_pair_does(spark, sides):
    rows = sides[0].collect()
    pairs = [(a, b) for a, b in product(rows, rows) if a["id"] < b["id"] and a["category"] == b["category"]]
    found = {(pairs[i][0]["id"], pairs[i][1]["id"]) for i in like(spark, [(a["description"], b["description"]) for a, b in pairs])}
    got = [tuple(r) for r in like_items(sides[0], ["category"]).collect()]
    assert len(got) == len(set(got)) and set(got) <= found

    def parts(edges):
        root = {r["id"]: r["id"] for r in rows}
        for _ in rows:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(got) == parts(found)


def test_like_texts_of_empty_tables(spark, sides):
    none = sides[0].limit(0)
    assert like_texts(none, sides[1], ["category"]).count() == like_texts(sides[0], none, ["category"]).count() == 0


def test_parts_of_long_texts_lose_none(spark):
    rng = random.Random(11)
    texts = {"".join(rng.choice("ab 会c") for _ in range(rng.choice([11, 12, 13, 15, 40, 300]))).strip() for _ in range(60)}
    texts |= {t[k : k + n].strip() for t in texts for k in (0, 7) for n in (12, 16, 30) if len(t) >= 40} | {"x" * n for n in (11, 12, 13, 5000)}
    texts = sorted(t for t in {" ".join(t.split()) for t in texts} if t)
    df = spark.createDataFrame([("k", t) for t in texts], "category string, _text string")
    got = {tuple(r) for r in likeness._parts(df, df, ["category"]).select("_short", "_long").collect()}
    assert got == {(a, b) for a in texts for b in texts if 12 <= len(a) < len(b) and a in b} and len(got) > 100


def test_parts_by_pairs_and_by_pieces_agree(spark, monkeypatch):
    """Texts of every level, in groups of several sizes: pieces give what pairs give, and groups above the bound go by pieces."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 会") for _ in range(rng.choice([12, 14, 30, 70, 150, 400, 900, 2000]))) for _ in range(80)]
    texts += [t[k : k + n] for t in texts for k in (0, 5) for n in (12, 23, 24, 50, 100, 200, 500) if len(t) > n]
    texts = sorted({t.strip() for t in texts if len(t.strip()) >= 12})
    rows = [(g, t) for k, t in enumerate(texts) for g in ("all", "few" if k % 9 == 0 else None)]
    df = spark.createDataFrame(rows, "category string, _text string")
    sides_ = {g: sorted(t for h, t in rows if h == g) for g in ("all", "few")}
    expected = {(g, a, b) for g, ts in sides_.items() for a in ts for b in ts if len(a) < len(b) and a in b}
    for few in (0, 60, 1 << 20):
        monkeypatch.setattr(likeness, "FEW", few)
        got = [tuple(r) for r in likeness._parts(df, df, ["category"]).select("category", "_short", "_long").collect()]
        assert len(got) == len(set(got)) and set(got) == expected and len(got) > 300


def test_pieces_are_not_shuffled_one_by_one(spark, tmp_path, monkeypatch):
    """What goes on of a group of unlike texts is about a row for each text, not one for every three characters."""
    written = {}
    plain = likeness.stored
    monkeypatch.setattr(likeness, "FEW", 0)
    monkeypatch.setattr(likeness, "stored", lambda df, name: written.setdefault(name, plain(df, name)))
    rng = random.Random(6)
    df = spark.createDataFrame([("k", "".join(rng.choice("abcdefghij ") for _ in range(300)).strip()) for _ in range(200)], "category string, _text string")
    assert likeness._parts(df, df, ["category"]).count() == 0
    assert sum(x.count() for x in written.values()) < 5 * 200


def test_like_items_shuffle_only_the_texts_of_candidates(spark, monkeypatch):
    """Of all that goes from task to task only the longer texts of candidates are texts; copies are found by digests."""
    monkeypatch.setattr(likeness, "FEW", 0)
    rng = random.Random(7)
    said = ["".join(rng.choice("abcdefghij ") for _ in range(200)).strip() for _ in range(50)]
    rows = [(k, 0, "risks", t, "") for k, t in enumerate(said + said[:20] + [t[5:60].strip() for t in said[:10]])]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = like_items(frame(spark, rows), ["category"])
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {tuple(r) for r in found.collect()} == {(k, 50 + k) for k in range(20)} | {(k, 70 + k) for k in range(10)}
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert inputs and [x for x in inputs if "_text#" in x] == []
    assert len({x for x in inputs if "_long#" in x or "_short#" in x}) <= 1


def test_filter_knows_its_numbers_and_few_others(spark):
    numbers = spark.range(20_000).select(F.xxhash64("id").alias("_gram"), "id")
    told = likeness._filter(numbers.where("id < 10000").select("_gram"), 10_000)
    kept = {r["id"] for r in numbers.mapInArrow(likeness._kept(told), numbers.schema).collect()}
    assert set(range(10_000)) <= kept and len(kept) < 10_000 + 50
    assert told.value.nbytes * 8 == likeness.LEAST_BITS


def test_copies_look_up_pieces_once(spark, monkeypatch):
    """Copies of a text in one batch leave one row, so that a frequent one doesn't fill the task of its window."""
    written = {}
    plain = likeness.stored
    monkeypatch.setattr(likeness, "FEW", 0)
    monkeypatch.setattr(likeness, "stored", lambda df, name: written.setdefault(name, plain(df, name)))
    rows = [(k, 0, "risks", "the same long line of every document" if k else "and the same long line of every document", "") for k in range(2000)]
    got = {tuple(r) for r in like_items(frame(spark, rows).coalesce(1), ["category"]).collect()}
    assert got == {(0, 1)} | {(1, k) for k in range(2, 2000)}
    assert written["anchors"].count() == 2 and written["met"].count() == 1
