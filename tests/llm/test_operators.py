"""The ten operators against the libraries, brute force and hand-made cases: nulls, empty and long texts, ties, repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from parley.llm import chunks, licences, logbilinear, media, near, packing, pieces, quality, queries, separators, toxic  # noqa: E402
from parley.llm.shared import flat, slices, stored  # noqa: E402

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "a ", "  two  spaces ", "line\n\nline", "漢字かな😀 é\u0000", "▁x ▁", "<s> <|endoftext|>", "word " * 3000, "x" * 5000, "same text here for all five", "same text here for all five"]


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "class", 0, 1.0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, number int, score double")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 100, 3, 3)] + [None])], names=["text"])
    parts = list(slices(iter([batch]), size=8))
    assert sum(p.num_rows for p in parts) == 6 and max(p.num_rows for p in parts) < 6


# --- 1: pieces


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdeinthrso .,\n▁ éß漢😀0123=-") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    given = ODD + made
    got = by_id(pieces.encode_documents(frame(spark, given), P.path("piece_bpe_32k.model")))
    for i, t in enumerate(given):
        ids = sp.encode(t or "")
        assert got[i]["n_tokens"] == len(ids), repr(t)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    model = pieces.load(P.path("piece_bpe_32k.model"))
    for ids in ([259, 13, 200, 250, 3], [29871], [235, 199, 131]):
        assert model.decode(np.array(ids)) == sp.decode(ids)


def test_long_words_equal_the_library_in_time():
    import time

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    encoder = pieces.Encoder(pieces.load(P.path("piece_bpe_32k.model")))
    rng = random.Random(11)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    joined = "".join(rng.choice(["the", "quick", "brown", "fox", "jumped", "over", "lazy", "dogs", "and", "information"]) for _ in range(8_000))
    for given in (letters, joined, "a" * 100_000, "漢字かな" * 5_000, "http://x.org/" + joined[:3_000], "ab" * 20_000, "=" * 3_000 + letters[:100]):
        began = time.process_time()
        ids = encoder.ids(given)
        spent = time.process_time() - began
        began = time.process_time()
        assert ids.tolist() == sp.encode(given)
        library = time.process_time() - began
        print(given[:20], len(given), round(spent, 2), round(library, 2))
        assert spent < 60
        if given is letters:
            assert spent < 10 * library + 3


# --- 2: media


def samples_of_png(media):
    """Another decoder of PNG, for 8-bit RGB with any of the five line filters."""
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, defaultdict(bytes)
    while at < len(media):
        size, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(media[at + 8 + size : at + 12 + size], "big")
        parts[kind] += body
        at += 12 + size
    width, height = (int.from_bytes(parts[b"IHDR"][k : k + 4], "big") for k in (0, 4))
    assert list(parts[b"IHDR"][8:]) == [8, 2, 0, 0, 0] and b"IEND" in parts
    raw, out, before = zlib.decompress(parts[b"IDAT"]), [], [0] * (3 * width)
    step = 3 * width + 1
    assert len(raw) == step * height
    for k in range(height):
        kind, line = raw[k * step], list(raw[k * step + 1 : (k + 1) * step])
        for x in range(len(line)):
            left, up, corner = line[x - 3] if x > 2 else 0, before[x], before[x - 3] if x > 2 else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            line[x] = (line[x] + (0, left, up, (left + up) // 2, paeth)[kind]) & 255
        out += line
        before = line
    return bytes(out)


def test_media_round_trip(spark):
    got = by_id(media.media_columns(frame(spark, ODD)))
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
        assert media.padded(raw) == payload
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
        stored_form = media.to_png(payload)
        assert samples_of_png(stored_form) == payload == media.from_png(stored_form)
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored_form), hashlib.sha256(stored_form).hexdigest())
        span = len(payload) // 16
        means = [sum(payload[k * span : (k + 1) * span]) / span for k in range(16)]
        assert got[i]["feature"] == "".join(f"{round(m):02x}" for m in means)  # half to even, as rounding does
        assert (got[i]["width"], got[i]["height"]) == (64, len(payload) // 192)
    with pytest.raises(ValueError):
        broken = bytearray(media.to_png(media.padded(b"abc")))
        broken[45] ^= 1
        media.from_png(bytes(broken))


def test_shards_are_plain_tar_files(spark, tmp_path):
    """Every object lies where its row says, in files that tar reads."""
    import tarfile

    refs = media.store(frame(spark, ODD), f"file://{tmp_path}/s").collect()
    for r in refs:
        with tarfile.open(f"{tmp_path}/s/{r['shard']}") as tar:
            member = next(m for m in tar if m.offset_data == r["offset"])
            data = tar.extractfile(member).read()
        assert member.name == f"{r['digest']}.png" and len(data) == r["length"]
        assert hashlib.sha256(samples_of_png(data)).hexdigest() == r["digest"]
    assert len(refs) == len(ODD)


def test_equal_texts_share_an_object(spark, tmp_path):
    refs = media.store(frame(spark, ["a", "b", "a", "a"] * 20).coalesce(1), f"file://{tmp_path}/s").persist()
    assert refs.select("digest", "shard", "offset").distinct().count() == 2
    assert media.canonical(refs).count() == 2


# --- 3: near-duplicates


def brute_links(texts, threshold=0.8):
    sets = {i: ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := re.findall(r"[^ \t-\r]+", t)) else set()) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = defaultdict(set)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if k / (len(s) + len(sets[j]) - k) >= threshold - 1e-12:
                links[i].add(j), links[j].add(i)
    for i, t in texts.items():
        for j, u in texts.items():
            if i < j and t == u:
                links[i].add(j), links[j].add(i)
    return links


def roots(ids, links):
    root = {}
    for i in sorted(ids):
        if i in root:
            continue
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = i
                stack.extend(links[k])
    return root


def near_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    out = []
    for k in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + out[:7] + [" ".join(word() for _ in range(30)) for _ in range(10)] + ["", None, "", "one two", "one two", "one two three"]


@pytest.mark.parametrize("block, crowded", [(512, 256), (8, 256), (512, 12)])
def test_near_links_equal_brute_force(spark, block, crowded):
    given = near_texts()
    got = by_id(near.jaccard_join(frame(spark, given), block=block, crowded=crowded))
    links = brute_links({i: t or "" for i, t in enumerate(given)})
    root = roots(range(len(given)), links)
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (root[i], len(links[i])) for i in range(len(given))}


def test_near_query_equals_brute_force(spark, texts):
    got = by_id(queries.op3_jaccard_join(spark, SF))
    links = brute_links(texts)
    root = roots(texts, links)
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (root[i], len(links[i])) for i in texts}


def test_near_query_equals_its_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = duck.execute(queries.oracle_sql()["op3_jaccard_join"]).fetchall()
    got = queries.op3_jaccard_join(spark, SF).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_one_of_each_keeps_one_row(spark):
    rows = frame(spark, ["a b c d e f", "a b c d e f", "x y", "x y", None], [3, 3, 9, 4, 7]).union(frame(spark, ["z"], [None]))
    kept = near.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 3), (False, 4), (False, 7)]
    assert kept.where("doc_id is null").count() == 1


def test_one_of_each_keeps_unlike_texts_without_an_id(spark):
    rows = frame(spark, ["z", "y", "y", "p q r s t u"], [None, None, None, 2])
    assert sorted((r["doc_id"] is None, r["text"]) for r in near.one_of_each(rows).collect()) == [(False, "p q r s t u"), (True, "y"), (True, "z")]


def test_one_of_each_keeps_unlike_texts_under_one_id(spark):
    rows = frame(spark, ["a b c d e f", "u v w x y z", "u v w x y z", "a b c d e f"], [3, 3, 3, 5])
    assert sorted((r["doc_id"], r["text"]) for r in near.one_of_each(rows).collect()) == [(3, "a b c d e f"), (3, "u v w x y z")]


def test_one_of_each_keeps_one_of_like_texts_under_any_ids(spark):
    words = [f"w{k}" for k in range(60)]
    first, second = " ".join(words), " ".join([*words, "more"])  # likeness 56/57
    rows = frame(spark, [first, second, first, second, "z"], [None, 8, 8, None, 8])
    got = [(r["doc_id"], r["text"]) for r in near.one_of_each(rows).collect()]
    assert len(got) == 2 and (8, "z") in got and all(d == 8 for d, _ in got)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in near.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_crowded_nodes_stay_closed_within_the_recall(spark):
    """Signatures by hand: three trees share one value prefix among all classes, the others none."""
    rng = random.Random(8)
    trees, length = near.TREES, near.prefix_length()
    value = lambda: rng.getrandbits(63)
    common, rows = [value() for _ in range(trees)], []
    for k in range(40):
        shared = 3 if k < 30 else 12  # the last ten are crowded in too many trees
        rows.append((bytes([k]), [common[t] if t < shared else value() for t in range(trees)] + [value() for _ in range(trees)]))
    each = spark.createDataFrame(rows, "class binary, keys array<long>")
    got = {r["class"]: r["keys"] for r in near.opened(each, trees, length, 0.8, near.RECALL, 8).collect()}
    keys = [got[bytes([k])] for k in range(40)]
    plain = lambda k, t: keys[k][t] == common[t]
    alone = lambda k, t: sum(x[t] == keys[k][t] for x in keys) == 1
    for k in range(40):
        assert len(keys[k]) == trees
        # what a class can lose by its closed nodes, whose prefixes have five values here
        left = sum(np.log(1 - 0.8 ** (length + 1 if t < (3 if k < 30 else 12) and not plain(k, t) else length)) for t in range(trees))
        assert left <= np.log(1 - near.RECALL)
    assert any(alone(k, t) for k in range(30) for t in range(3))


def test_recall_of_the_forest():
    """Pairs at a likeness of 0.8 by their signatures alone."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(300):
        grams = rng.integers(0, 1 << 63, 108, dtype=np.uint64)
        hashes = np.concatenate((grams[:96], grams[:84], grams[96:]))  # 84 of 108 shared: 0.78
        a, b = near.signatures(hashes, np.array([96, 96]), near.TREES)[:, : near.TREES]
        met += bool((a == b).any())
    assert met >= 299


def test_prefix_is_shortened_to_the_recall():
    n = near.prefix_length()
    assert 1 - (1 - 0.8**n) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (n + 1)) ** near.TREES


# --- 4: quality


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    made, label = [], []
    for _ in range(240):
        g = int(rng.integers(0, 4))
        made.append(" ".join("good" if rng.random() < g / 3 else "junk!" for _ in range(40)))
        label.append(g)
    model = quality.fit(pa.array(made), np.array(label))
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.expected(quality.scores(pa.array(made), model))
    means = [expected[np.array(label) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5


def quality_score_by_loop(text, model):
    """The score of one text, trigram by trigram and word by word."""
    raw = (text or "").encode()
    n = max(len(raw) - 2, 0)
    total = sum(model.weights[((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 2654435761 % 2**32) >> (32 - 15)] for k in range(n))
    words = re.findall(rb"[^ \t-\r]+", raw)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return quality.SCALE * total / (n + quality.CALM) + model.weights[quality.BUCKETS] * quality.SCALE * again / (len(words) + quality.CALM_WORDS)


def test_quality_equals_brute_force(spark, texts):
    """Score, expected grade and tail of nulls, empty, long, repeated and real texts, for three grades."""
    rng = random.Random(2)
    made = [" ".join(rng.choice(["good", "fair fair", "junk!"][g : g + 2] or ["junk!"]) for _ in range(20)) for g in (0, 1, 2) for _ in range(30)]
    labels = spark.createDataFrame([(k, 2 - k // 30) for k in range(90)], "doc_id long, quality int")
    model = quality.train(frame(spark, made), labels)
    assert model.grades.tolist() == [0, 1, 2] and len(model.thresholds) == 2
    given = [*ODD, "ab", "abc", "the the the", "é" * 30_000, *[texts[i] for i in sorted(texts)[:30]]]
    got = by_id(quality.graded(frame(spark, given).select("doc_id", "text"), model))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for i, t in enumerate(given):
        tails = [sigmoid(quality_score_by_loop(t, model) - c) for c in model.thresholds]
        assert abs(got[i]["quality_tail"] - tails[-1]) < 1e-9 and abs(got[i]["quality_expected"] - sum(tails)) < 1e-9
        assert tails[0] >= tails[1]


def test_quality_gradient_finds_the_most_likely_thresholds():
    """With texts that say nothing the thresholds are those of the grades' even weights: logits of 1/3 and 2/3."""
    model = quality.fit(pa.array(["same text"] * 60), np.repeat([0, 1, 2], [10, 20, 30]))
    score = quality.scores(pa.array(["same text"]), model)[0]
    assert np.allclose(1 / (1 + np.exp(score - model.thresholds)), [2 / 3, 1 / 3], atol=0.02) or np.allclose(1 / (1 + np.exp(-(model.thresholds - score))), [1 / 3, 2 / 3], atol=0.02)


def test_quality_on_the_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = by_id(queries.op4_quality(spark, "/root/testdata/sf0.01"))
    right = [got[i]["kept"] == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.97
    assert all(got[i]["kept"] for i, q in labels.items() if q)


def test_quality_without_labels_keeps_all(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(frame(spark, ODD), none)
    got = quality.graded(frame(spark, ODD), model).collect()
    assert model is None and len(got) == len(ODD) and all(r["quality_tail"] == 1 for r in got)


# --- 5: language model


def language_model(docs):
    """The steps of score_documents, with what they make."""
    counts = stored(logbilinear.word_counts(docs.where(logbilinear.is_training()).select("doc_id", "text")), "word-counts")
    plain = logbilinear.vocabulary(counts)
    ids = stored(logbilinear._ids(docs, plain), "items")
    training = ids.where("training")
    vocab = logbilinear.grouped(plain, logbilinear.company_of(training, plain))
    return counts, plain, ids, vocab, logbilinear.train(training, plain, vocab)


def test_all_positions_of_long_documents_are_learnt_from(spark):
    """A cycle of eight words: one position in eight would be always the same word."""
    text = " ".join(f"w{k}" for k in range(8)) + " "
    _, plain, _, vocab, model = language_model(frame(spark, [text * 800] * 60).coalesce(1))
    items, _ = vocab.look_up(*logbilinear.tokens(pa.array([text * 3]))[:2])
    log_p = logbilinear.log_probability(model, items, np.array([len(items)]))[8:16]
    assert (log_p > np.log(1 / 8) + 0.5).all()


def test_scores_equal_brute_force_and_beat_the_base(spark, texts):
    got = by_id(queries.op5_lm_scores(spark, SF))
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate({k: k + 32 for k in range(65, 91)})), None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = tokens(t)
        base = sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    assert sum(r["score"] for i, r in got.items() if held[i]) > sum(r["base_score"] for i, r in got.items() if held[i])


def test_score_equals_a_softmax_by_hand(spark, docs, texts, monkeypatch):
    """Every document's score from the model's tables, token by token over all items, with few frequent words so that the
    counts of many words come by the join."""
    monkeypatch.setattr(logbilinear, "KNOWN_WORDS", 500)
    monkeypatch.setattr(logbilinear, "MOST_OWN", 60)
    counts, plain, ids, vocab, model = language_model(docs)
    got = by_id(logbilinear.score(ids, counts, plain, vocab, model))
    number = {r["hash"]: r["n"] for r in counts.collect()}
    m = {k: v.astype(float) for k, v in model.items()}
    groups, width = len(m["group"]), len(m["item"]) // len(m["group"])
    real = vocab.weight > 0
    for i in sorted(texts)[:25]:
        words, shared, _ = logbilinear.tokens(pa.array([texts[i]]))
        items, _ = vocab.look_up(words, shared)
        total = 0.0
        for t, item in enumerate(items[:400]):
            before = [items[t - k] if t >= k else groups * width for k in range(1, logbilinear.CONTEXT + 1)]
            h = sum(m["context"][x] * m["place"][k] for k, x in enumerate(before))
            by_group = np.exp(m["group"] @ h + m["group_bias"])
            by_item = np.exp(m["item"] @ h + m["item_bias"]).reshape(groups, width)
            joint = (by_group / by_group.sum())[:, None] * by_item / by_item.sum(axis=1, keepdims=True)
            assert abs(joint.sum() - 1) < 1e-9 and joint.ravel()[~real].sum() < 1e-9
            total += np.log(joint.ravel()[item])
            if item in set(vocab.shared.tolist()):
                total += np.log(number.get(int(words[t : t + 1].view(np.int64)[0]), 0) + 0.5) - np.log(vocab.weight[item])
        if len(items) <= 400:
            assert abs(got[i]["score"] - total / np.log(10)) < 1e-4 * abs(total)


def test_model_does_not_depend_on_partitions(spark, docs):
    one = language_model(docs.coalesce(1))[-1]
    other = language_model(docs.orderBy("text").repartition(7))[-1]
    assert all(np.array_equal(one[k], other[k]) for k in one)


def test_known_hashes_are_found():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    rng.shuffle(keys)
    keys = np.concatenate((keys, keys[:50] ^ np.uint64(1), [np.uint64(0)]))  # neighbours want the same slots
    table = logbilinear.Table(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    assert (table.find(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)) == -1).mean() > 0.99
    assert (logbilinear.Table(keys[:0]).find(keys) == -1).all()


def test_scores_of_odd_texts(spark):
    got = logbilinear.score_documents(frame(spark, [*ODD, "a b"], [*range(len(ODD)), None])).collect()
    assert len(got) == len(ODD) + 1 and all(r["n_tokens"] >= 1 and r["score"] < 0 for r in got)
    assert logbilinear.score_documents(frame(spark, [])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    got = logbilinear.score_documents(frame(spark, ["only held out"], [held])).collect()
    assert len(got) == 1 and got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0


# --- 6: separators


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_equals_a_split(spark, tmp_path, block):
    rng = random.Random(block)
    expected, files = [], []
    for name in ("a.bin", "b.bin", "empty.bin", "open.bin"):
        ids = [] if name == "empty.bin" else [rng.choice([9, 9, 1, 2, 3]) for _ in range(50)] + ([5] if name == "open.bin" else [9])
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        files.append((name, 2 * len(ids)))
        start = 0
        for number, stop in enumerate([k for k, x in enumerate(ids) if x == 9] + ([len(ids)] if ids and ids[-1] != 9 else [])):
            expected.append((name, number, start, stop - start, stop < len(ids)))
            start = stop + 1
    got = separators.scan(spark.createDataFrame(files, "file string, bytes long"), f"file://{tmp_path}", 9, block)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = by_id(separators.token_counts(frame(spark, ODD), RANKS, P.PATTERN))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(ODD)}


# --- 7: packing


def test_packing_of_the_documents(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = queries.op7_best_fit_packing(spark, SF).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
    total = 0
    for i, x in texts.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        mine = sorted(parts[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 2048 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 2


def test_packing_has_the_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>"
    given = [e, e + e, f"a {e} b", f"a{e}b", f"{e} x", f"x  {e}  y", "no token", f"end {e}", "<|endoftext|", None, f"{e}  two {e}{e} three  "]
    rows = by_id(queries.pack(frame(spark, given)))
    for i, x in enumerate(given):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i]["length"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())), x


def best_fit_by_items(counts, capacity):
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else capacity) - length)
    return len(room)


def test_plan_holds_all_and_nothing_twice():
    rng = random.Random(1)
    for capacity in (10, 64):
        for _ in range(50):
            counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
            plan = packing.plan_best_fit(counts, capacity)
            used = defaultdict(list)
            seen = Counter()
            for length, rank, n, first, offset in plan.tolist():
                assert rank == seen[length]
                seen[length] += n
                for k in range(n):
                    used[first + k].append((offset, length))
            assert seen == Counter(counts)
            for p in used.values():
                at = 0
                for offset, length in sorted(p):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(used) == best_fit_by_items(counts, capacity)
    with pytest.raises(ValueError):
        packing.plan_best_fit({11: 1}, 10)


def test_packing_of_odd_texts(spark):
    rows = packing.pack_documents(frame(spark, ODD), RANKS, P.PATTERN, 64).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(ODD)))
    assert packing.pack_documents(frame(spark, []), RANKS, P.PATTERN).count() == 0


# --- 8: licences


MIT_WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC_WRAPPED = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL_WRAPPED = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {v} of the License, or
(at your option) any later version."""


def test_licence_lines_are_found(spark):
    lines = [
        "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under CC BY-NC 4.0.",
        "All rights reserved.",
        "the license of the first part",
        "a walk in the park with the dog",
        "",
    ]
    docs = frame(spark, ["\n".join(lines), None, "", "plain words\nof no licence", "x. " * 20_000 + "\nReleased under the MIT License.\n" + "y. " * 20_000])
    got = sorted((r["doc_id"], r["line_no"], r["last_line"], r["family"], r["confirmed"]) for r in licences.scan(docs).collect())
    assert got == [(0, 0, 0, "MIT", True), (0, 1, 1, "GPL-3.0", True), (0, 2, 2, "Apache-2.0", True), (0, 3, 3, "CC-BY-NC-4.0", True), (0, 4, 4, "proprietary", True), (4, 1, 1, "MIT", True)]


def test_wrapped_licences_and_versions(spark):
    given = [MIT_WRAPPED, "a first line\n\n" + ISC_WRAPPED + "\n\nand more", GPL_WRAPPED.format(v=2), GPL_WRAPPED.format(v=3), "This work is licensed under the GNU General Public License, version 2.", "Licensed under the BSD 2-Clause License."]
    given += ["This is free and unencumbered software released into the public domain.", "Licensed under the Eclipse Public License, version 2.0.", GPL_WRAPPED.format(v=3).replace("General", "Affero General"), GPL_WRAPPED.format(v=2)]
    got = [(r["doc_id"], r["line_no"], r["last_line"], r["family"], r["confirmed"]) for r in licences.scan(frame(spark, given)).collect()]
    wanted = [(0, 0, 12, "MIT"), (1, 2, 4, "ISC"), (2, 0, 3, "GPL-2.0"), (3, 0, 3, "GPL-3.0"), (4, 0, 0, "GPL-2.0"), (5, 0, 0, "BSD-2-Clause"), (6, 0, 0, "Unlicense"), (7, 0, 0, "EPL-2.0"), (8, 0, 3, "AGPL-3.0"), (9, 0, 3, "GPL-2.0")]
    assert sorted(got) == [(*w, True) for w in wanted]


def test_other_versions_and_line_ends(spark):
    """A notice of a version outside the list confirms nothing; a CRLF text's empty lines are empty."""
    wrapped = "plain words of a letter\r\n\r\nReleased under the MIT License.\r\n\t\r\nand more words\r\n"
    given = ["Licensed under CC BY 2.0.", "This work is licensed under a Creative Commons Attribution 2.0 Generic License.", "Licensed under CC BY 4.0.", wrapped, "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 3.0."]
    got = {r["doc_id"]: (r["line_no"], r["last_line"], r["family"], r["confirmed"]) for r in licences.scan(frame(spark, given)).collect()}
    assert got[2][2:] == ("CC-BY-4.0", True) and got[5][2:] == ("CC-BY-3.0", True) and got[3] == (2, 2, "MIT", True)
    assert not any(got[i][3] for i in (0, 1, 4) if i in got)


DUAL = ["Dual licensed under the MIT license or the Apache License, Version 2.0.", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."]
BSD3 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Neither fitted on nor used for the calibration.
ELSEWHERE = [
    "Licensed under CC BY 2.0.", "Licensed under the CeCILL License, version 2.1.", "Licensed under the Artistic License 1.0.", "Released under the Ruby License.", "Licensed under the Eclipse Distribution License, version 1.0.",
    "Licensed under the Open Database License, version 1.0.", "Licensed under the Elastic License 2.0.", "Licensed under the Business Source License 1.1.", "Released under the NCSA License.", "Licensed under the Vim License.",
    "Permission to make digital or hard copies of all or part of this work for personal or classroom use is granted without fee", "This work is licensed under the GNU General Public License, version 1.", "Mozilla Public License Version 1.0",
    "The company reserves all rights to the name and no part of this report may be changed.", "Licensed under the PHP License, version 3.01.", "Licensed under the Server Side Public License, version 1.",
]


def test_dual_notices_identifiers_titles_and_licences_outside_the_list(spark):
    given = [*DUAL, "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0", "MIT License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", BSD3]
    given += ["Distributed under the Boost Software License, Version 1.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", *ELSEWHERE]
    got = defaultdict(dict)
    for r in licences.scan(frame(spark, given)).collect():
        got[r["doc_id"]][r["family"]] = r
    wanted = [{"MIT", "Apache-2.0"}, {"MIT", "Apache-2.0"}, {"MIT"}, {"Apache-2.0"}, {"MIT"}, {"GPL-3.0"}, {"BSD-3-Clause"}, {"BSL-1.0"}, {"CC-BY-NC-SA-4.0"}]
    assert [set(got[i]) for i in range(len(wanted))] == wanted
    assert all(got[i][f]["confirmed"] for i in (2, 3, 6, 7, 8) for f in wanted[i]) and got[6]["BSD-3-Clause"]["last_line"] == 2
    outside = [r for i in range(len(wanted), len(given)) for r in got[i].values()]
    assert not any(r["confirmed"] for r in outside) and len(outside) <= len(ELSEWHERE) / 4


def test_licence_scan_is_native(spark, docs):
    table, _ = licences.train(docs)
    for df in (licences.hits_of(docs, table), licences.scan(docs)):
        assert not re.search("Python|Pandas|MapInArrow", df._jdf.queryExecution().toString())


def paragraphs_by_loop(text):
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines):
        blank = lambda x: not re.search(r"[^ \t\n\x0b\f\r]", x)
        if k == 0 or blank(line) or blank(lines[k - 1]) or re.search("[.!?:。！？][)\"'”]*[ \t\n\x0b\f\r]*$", lines[k - 1]):
            out.append([k, k, line])
        else:
            out[-1][1:] = [k, out[-1][2] + " " + line]
    return out


def test_licence_scan_equals_brute_force(spark, docs, texts):
    """Findings of whole documents by hand from the weights table and the biases."""
    given = [MIT_WRAPPED, GPL_WRAPPED.format(v=2) + "\nReleased under the MIT License.", *[texts[i] for i in sorted(texts)]]
    df = frame(spark, given)
    table, model = licences.train(df)
    got = sorted(map(tuple, licences.findings(stored(licences.hits_of(df, table), "hits"), model).collect()))
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: {tuple(w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1)}
    known = sorted({g for t in licences.TEMPLATES.values() for x in t for g in grams(words(x))})
    hashed = spark.createDataFrame([(list(g),) for g in known], "g array<string>").select("g", F.when(F.size("g") == 2, F.xxhash64(F.col("g")[0], F.col("g")[1])).otherwise(F.xxhash64(F.get("g", 0), F.get("g", 1), F.get("g", 2))).alias("h"))
    name = {r["h"]: tuple(r["g"]) for r in hashed.collect()}
    weight, of = defaultdict(dict), {}
    for r in table.collect():
        g = name[r["gram"]]
        weight[g][r["family"]], of[g] = r["weight"], r["templates"]
    family_of = [f for f, t in licences.TEMPLATES.items() for _ in t]
    generic, expected = licences.GENERIC, []
    for i, t in enumerate(given):
        found_in, grams_at = [], {}
        for first, last, paragraph in paragraphs_by_loop(t):
            left = grams_at[first] = {g for g in grams(words(paragraph)) if g in weight}
            for _ in range(licences.ROUNDS):
                z = Counter()
                for g in left:
                    z.update(weight[g])
                if not left:
                    break
                e = {f: np.exp(z[f] + b) for f, b in model["bias"].items()}
                best = max(z, key=lambda f: (e[f], f))
                p = e[best] / (1 + sum(e.values()))
                if p < licences.LEAST_PROBABILITY:
                    break
                found_in.append((first, last, best, p))
                left = {g for g in left if best not in {family_of[t] for t in of[g]}}
        for root in {generic.get(f, f) for _, _, f, _ in found_in}:
            runs = []
            for first, last, f, p in sorted(x for x in found_in if generic.get(x[2], x[2]) == root):
                special = f if f != root else None
                if runs and first <= runs[-1][1] + 2 and not (special and runs[-1][2] and special != runs[-1][2]):
                    runs[-1] = (runs[-1][0], max(last, runs[-1][1]), runs[-1][2] or special, max(p, runs[-1][3]), runs[-1][4] | grams_at[first])
                else:
                    runs.append((first, last, special, p, grams_at[first]))
            for first, last, special, p, found in runs:
                best = special or root
                parts = [sum(t in of[g] for g in found) / model["size"][t] for t in range(len(family_of))]
                number = lambda g: any(re.fullmatch("[0-9]+", w) for w in g)
                told = [sum(t in of[g] and number(g) for g in found) >= licences.LEAST_CONTAINMENT * sum(t in of[g] and number(g) for g in of) for t in range(len(family_of))]
                known = {x[2] for x in found_in} | {root, best}
                containment = max(x for x, f in zip(parts, family_of, strict=True) if f == best)
                other = max((x for x, f in zip(parts, family_of, strict=True) if f not in known), default=0)
                proof = max((x for x, f, ok in zip(parts, family_of, told, strict=True) if f == best and ok), default=0)
                expected.append((i, first, last, best, round(p, 6), round(containment, 6), proof >= licences.LEAST_CONTAINMENT and containment > other))
    near = lambda rows: [(*r[:4], r[6], pytest.approx(r[4], abs=2e-6), pytest.approx(r[5], abs=2e-6)) for r in sorted(rows)]
    assert [(*r[:4], r[6], r[4], r[5]) for r in got] == near(expected) and len(got) > 5


def test_licences_of_the_documents(spark, docs):
    expected = {(r["doc_id"], k) for r in docs.collect() for k, line in enumerate((r["text"] or "").split("\n")) if re.search("licen[cs]ed? under|released under", line, re.I)}
    got = {(r["doc_id"], k) for r in queries.op8_licences(spark, SF).collect() for k in range(r["line_no"], r["last_line"] + 1)}
    assert expected <= got


# --- 9: toxicity


def chain_by_loop(emit, moves):
    """Marginals and expected moves of one chain, token by token in logarithms."""
    n = len(emit)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    score = lambda k: np.array([0.0, emit[k]])
    a[0] = score(0)
    for k in range(1, n):
        a[k] = [np.logaddexp(a[k - 1, 0] + moves[0, s], a[k - 1, 1] + moves[1, s]) for s in (0, 1)] + score(k)
    for k in range(n - 2, -1, -1):
        b[k] = [np.logaddexp(*(moves[s] + score(k + 1) + b[k + 1])) for s in (0, 1)]
    z = np.logaddexp(*a[-1])
    expected = sum((np.exp(a[k - 1][:, None] + moves + (score(k) + b[k])[None, :] - z) for k in range(1, n)), np.zeros((2, 2)))
    return np.exp(a[:, 1] + b[:, 1] - z), expected


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emit, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    weights = {}
    for code in range(64):
        y = [code >> k & 1 for k in range(6)]
        weights[tuple(y)] = np.exp(sum(emit[k] * y[k] for k in range(6)) + sum(moves[y[k], y[k + 1]] for k in range(5)))
    z = sum(weights.values())
    p, expected = toxic.forward_backward(emit, np.array([6]), moves)
    assert np.allclose(p, [sum(w for y, w in weights.items() if y[k]) / z for k in range(6)])
    assert np.allclose(expected, [[sum(w * sum(y[k] == r and y[k + 1] == s for k in range(5)) for y, w in weights.items()) / z for s in (0, 1)] for r in (0, 1)])


def test_chains_reach_over_blocks_and_not_over_texts():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 63, 64, 65, 0, 700, 128, 2, 0])
    emit, moves = rng.normal(size=counts.sum()) * 3, rng.normal(size=(2, 2)) * 2
    p, expected = toxic.forward_backward(emit, counts, moves)
    at, total = 0, np.zeros((2, 2))
    for n in counts[counts > 0]:
        q, more = chain_by_loop(emit[at : at + n], moves)
        assert np.allclose(p[at : at + n], q)
        at, total = at + n, total + more
    assert np.allclose(expected, total)


def test_toxicity_equals_a_loop_over_tokens(spark):
    """Scores and spans of whole documents from the model's tables, token by token."""
    made = [f"{a} one two {w} three {b}" for w in ("gut", "bös") for a in ("x", "yy") for b in ("p", "q") for _ in range(8)]
    labels = spark.createDataFrame([(k, int("bös" in t)) for k, t in enumerate(made)], "doc_id long, toxic int")
    model = toxic.train(frame(spark, made), labels)
    given = [*ODD, "bös " * 200 + "gut", "a bös. Bös! gut", "BÖS"]
    got = by_id(toxic.toxicity(frame(spark, given), model))
    for i, t in enumerate(given):
        t = t or ""
        found = [(m.start(), m.end()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t)]
        word, begin, _, _, counts, _ = toxic.tokens(pa.array([t]))
        assert counts[0] == len(found)
        if not found:
            assert got[i]["toxic_spans"] == [] and abs(got[i]["toxic_score"] - 1 / (1 + np.exp(-(model.document @ [1, 0, -8 / 3, 0])))) < 1e-9
            continue
        w, b, left, right = toxic._features(word, begin, counts)
        emit = [model.bias + model.word[w[k]] + model.start[b[k]] + model.near[left[k]] + model.near[right[k]] for k in range(len(found))]
        p, _ = chain_by_loop(np.array(emit), model.moves)
        number, most = p.sum(), p.max()
        x = [1, np.log1p(number), np.clip(np.log(most + 1e-9) - np.log1p(1e-9 - most), -8, 8) / 3, np.log1p(100 * number / (len(p) + toxic.CALM))]
        assert abs(got[i]["toxic_score"] - 1 / (1 + np.exp(-np.clip(np.dot(x, model.document), -40, 40)))) < 1e-6
        runs = []
        for k, (start, end) in enumerate(found):
            if p[k] >= toxic.SPAN:
                if runs and runs[-1][2] == k - 1:
                    runs[-1] = (runs[-1][0], end, k)
                else:
                    runs.append((start, end, k))
        assert [tuple(s) for s in got[i]["toxic_spans"]] == [(a, e) for a, e, _ in runs]


def test_toxicity_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = {i: r for i, r in by_id(queries.op9_toxicity(spark, "/root/testdata/sf0.1")).items() if i in labels and r["held_out"]}
    assert sum(r["predicted"] == labels[i] for i, r in got.items()) / len(got) > 0.97
    assert sum(r["predicted"] for i, r in got.items() if not labels[i]) / len(got) < 0.01
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxic_spans_are_code_points(spark):
    made = [f"wörter é {w} mehr" for w in ("gut", "bös") for _ in range(30)]
    docs = frame(spark, made)
    labels = docs.select("doc_id", (F.col("text").contains("bös")).cast("int").alias("toxic"))
    model = toxic.train(docs, labels)
    got = by_id(toxic.toxicity(frame(spark, ["alles bös hier", "alles gut", None, "alles BÖS hier"]), model))
    assert [tuple(s) for s in got[0]["toxic_spans"]] == [(6, 9)] and got[1]["toxic_spans"] == []
    assert got[0]["toxic_score"] > got[1]["toxic_score"] and got[2]["toxic_score"] < 0.5 and got[3]["toxic_score"] > 0.5


# --- 10: fingerprints


def test_fingerprints_equal_single_ones(spark, texts):
    rows = queries.op10_fingerprints(spark, SF).collect()
    order = sorted(texts, reverse=True)
    following = {i: texts[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    print_of = lambda t: chunks.strings(*chunks.fingerprints(pa.array([t], pa.large_string())))[0]
    assert len(rows) == len(texts)
    for r in rows:
        t, after = texts[r["doc_id"]], following[r["doc_id"]]
        new = chunks.edited(t, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (print_of(t), print_of(new))
        assert abs(r["near_edited"] - chunks.likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9
        assert abs(r["near_next"] - chunks.likeness(r["fingerprint"], print_of(after))) < 1e-9
    assert np.mean([r["near_edited"] for r in rows]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in rows])


def chunks_by_bytes(raw):
    """Starts and ends of a text's chunks, one byte after the other."""
    gear, h, start, out = chunks._gear().tolist(), 0, 0, []
    for k, x in enumerate(raw):
        h = ((h << 1) + gear[x]) & 0xFFFFFFFF
        n = k + 1 - start
        mask = int(chunks.STRICT) if n < chunks.MEAN else int(chunks.LOOSE)
        if n == chunks.MOST or k + 1 == len(raw) or (n >= chunks.LEAST and not h & mask):
            out.append((start, k + 1))
            start = k + 1
    return out


def test_chunks_equal_a_loop_over_bytes(texts):
    rng = random.Random(9)
    given = [*(t or "" for t in ODD), *list(texts.values())[:40], "a" * 1000, "".join(rng.choice("ab ") for _ in range(3000))]
    data, at = flat(pa.array(given, pa.large_string()))
    starts, ends, owner = chunks.cut(data, at)
    got = defaultdict(list)
    for s, e, o in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
        got[o].append((s - at[o], e - at[o]))
    for i, t in enumerate(given):
        assert got[i] == chunks_by_bytes(t.encode()), t[:50]


def test_likeness_by_hand():
    """Containment by the sets of distinct chunks, weighted by length."""
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    for other in (base, base[:2000], "zz" + base[500:] + "q" * 300, base[::-1], ""):
        sides = []
        for t in (base, other):
            raw = t.encode()
            sides.append({raw[s:e] for s, e in chunks_by_bytes(raw)})
        a, b = sides
        size = lambda x: sum(map(len, x))
        expected = size(a & b) / min(size(a), size(b)) if a and b else float(not a and not b)
        prints = [chunks.strings(*chunks.fingerprints(pa.array([t], pa.large_string())))[0] for t in (base, other)]
        assert abs(chunks.likeness(*prints) - expected) < 1e-9


def test_chunks_withstand_shifts():
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    one, two = (chunks.strings(*chunks.fingerprints(pa.array([x])))[0] for x in (t, "something put before it " + t))
    assert chunks.likeness(one, two) > 0.97 and chunks.likeness("", "") == 1 and chunks.likeness("", one) == 0


def test_fingerprints_of_odd_rows(spark):
    docs = frame(spark, [*ODD, "last"], [*range(len(ODD)), None])
    assert chunks.fingerprint_documents(docs).count() == len(ODD) + 1
    assert chunks.fingerprint_documents(frame(spark, ["alone"])).first()["near_next"] == 1
    assert chunks.fingerprint_documents(frame(spark, [])).count() == 0


# --- all of them on an empty table


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pieces.encode_documents(none, P.path("piece_bpe_32k.model")).count() == 0
    assert media.media_columns(none).count() == 0
    assert near.jaccard_join(none).count() == 0
    assert separators.token_counts(none, RANKS, P.PATTERN).count() == 0
    assert licences.scan(none).count() == 0
    assert toxic.toxicity(none, toxic.train(none, labels)).count() == 0
    assert quality.graded(none, quality.train(none, labels)).count() == 0
