"""The pipeline's stages, each against what its rule says of its own input."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from parley.llm import near, packing, quality, toxic  # noqa: E402
from tests.llm.test_operators import chain_by_loop, quality_score_by_loop  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_follow_their_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near-duplicates", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, SF).persist()
        assert at.columns == docs.columns
        now = {r["doc_id"]: r for r in at.collect()}
        assert all(now[i] == before[i] for i in now)
        gone = [i for i in before if i not in now]
        if name == "quality":
            assert all(labels[i]["quality"] == 0 for i in gone if i in labels)
            assert all(i not in now for i in before if i in labels and labels[i]["quality"] == 0)
        elif name == "toxicity":
            assert all(labels[i]["toxic"] == 1 for i in gone if i in labels)
        else:
            classes = {}
            for r in near.jaccard_join(spark.createDataFrame(list(before.values()), docs.schema)).collect():
                classes.setdefault(r["class_id"], set()).add(r["doc_id"])
            assert set(now) == {min(c) for c in classes.values()}
        before = now
    packed = corpus_pipeline.STAGES[3][1](spark, at, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_run_gives_pieces(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= packing.CAPACITY
    assert quality.MOST_LABELLED > 0 and toxic.THRESHOLD == 0.7


ODD_COLUMNS = ["toxic_score", "toxic_spans", "Quality_Tail", "quality_expected", "_class", "__class", "_id", "__id", "_kept", "class", "label", "n", "row", "part", "meta.lang", "a`b", "two words", "doc_id_", "text_", "`", "text.x"]


def odd_documents(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, two texts under one id, clashing columns."""
    texts = [None, "", "plain words of a quiet day in the hills", "plain words of a quiet day in the hills", "a " * 40_000, "x" * 50_000, "same id one", "same id two"]
    ids = [None, 1, 2, 2, 3, 4, 5, 5]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD_COLUMNS)
    rows = [(i, t, None, None, None, *[None if k % 2 else f"{c} {k}" for c in ODD_COLUMNS]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows.append(rows[2])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:3])
def test_stages_pass_all_columns_on(spark, name, stage):
    docs = odd_documents(spark)
    before = [tuple(r) for r in docs.collect()]
    kept = stage(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns
    now = [tuple(r) for r in kept.collect()]
    left = list(before)
    for r in now:  # rows as they came, none more often
        left.remove(r)
    if name == "near-duplicates":
        assert sorted((r[0] is None, r[0], r[1]) for r in now if r[0] is not None) == sorted({(False, r[0], r[1]) for r in before if r[0] is not None and r[1] != ""} | ({(False, 1, "")}))
    elif name == "toxicity":
        assert not left
    none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert none.columns == docs.columns and none.count() == 0


SMALL = "/root/testdata/sf0.001"


def test_quality_stage_equals_scores_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    tail = {r["doc_id"]: 1 / (1 + np.exp(model.thresholds[-1] - quality_score_by_loop(r["text"], model))) for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.good(spark, docs, SMALL).collect()}
    assert kept == {i for i, p in tail.items() if p >= corpus_pipeline.KEEP_QUALITY} and 0 < len(kept) < len(tail)


def test_toxicity_stage_equals_chains_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxic.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = {}
    for r in docs.collect():
        word, begin, _, _, counts, _ = toxic.tokens(pa.array([r["text"]]))
        w, b, left, right = toxic._features(word, begin, counts)
        p, _ = chain_by_loop(model.bias + model.word[w] + model.start[b] + model.near[left] + model.near[right], model.moves)
        number, most = p.sum(), p.max()
        x = [1, np.log1p(number), np.clip(np.log(most + 1e-9) - np.log1p(1e-9 - most), -8, 8) / 3, np.log1p(100 * number / (len(p) + toxic.CALM))]
        score[r["doc_id"]] = 1 / (1 + np.exp(-np.dot(x, model.document)))
    kept = {r["doc_id"] for r in corpus_pipeline.civil(spark, docs, SMALL).collect()}
    assert kept == {i for i, s in score.items() if s < toxic.THRESHOLD} and 0 < len(kept) < len(score)


def test_packing_takes_odd_documents(spark):
    docs = odd_documents(spark)
    rows = corpus_pipeline.STAGES[3][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert corpus_pipeline.STAGES[3][1](spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
