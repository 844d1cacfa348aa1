"""The manifest against a plain loop over lists, with trees of several floors and proofs of all leaves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from parley.llm import merkle, ranks  # noqa: E402
from parley.llm.shared import stored  # noqa: E402


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    n = row["n_chars"]
    return sha(*(field(v) for v in (row["doc_id"], row["source"], row["lang"], n if n is None else n + more, row["text"])))


def tree(nodes):
    """All levels, and for each leaf the siblings with the side on which they stand."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[k : k + 2]) for k in range(0, len(low), 2)])
    paths = []
    for k in range(len(nodes)):
        path = []
        for low in levels[:-1]:
            path.append((k % 2, low[k ^ 1] if (k ^ 1) < len(low) else None))
            k //= 2
        paths.append(path)
    return levels[-1][0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        mine = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        made[lang] = (mine, *tree([leaf_of(r) for r in mine]))
    root, over = tree([made[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, over, strict=True):
        mine, subroot, paths = made[lang]
        for r, path in zip(mine, paths, strict=True):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, int(bad))
            for right, other in path + above:
                node = sha(*([other or "", node] if right else [node, other or ""]))
            proof = sha(*(x for _, x in path + above if x))
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, `path.x` int, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "l") for r in rows], SCHEMA)


def check(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    got = merkle.manifest_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == by_hand(rows)
    return got


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "a", None, "s", 1), (1, "", "", "s", 0), (2, "x" * 100_000, "de", "é漢", 100_000), (7, "one", "en", "s", 3), (7, "two", "en", "s", 3), (7, "two", "en", "s", 3)]
    rows += [(k, f"text {k}", "en", "s", None if k % 3 == 0 else k) for k in range(20, 90)]
    got = check(spark, frame(spark, rows).repartition(3))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_document_and_none(spark):
    one = check(spark, frame(spark, [(5, "alone", "en", "s", 5)]))
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == sha()
    assert merkle.manifest_documents(frame(spark, [(5, "alone", "en", "s", 5)]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [255, 256, 257, 1025])
def test_sizes_around_a_segment(spark, n):
    check(spark, frame(spark, [(k, f"t{k}", "en", "s", k) for k in range(n)] + [(k, "t", "de", "s", 1) for k in range(3)]))


def test_three_floors_and_many_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "_WIDTH", 4)
    monkeypatch.setattr(merkle, "SALTS", 3)
    rows = [(k, f"t{k}", "en", "s", k) for k in range(70)] + [(k, "t", f"l{k % 19:02}", "s", 1) for k in range(60)]
    check(spark, frame(spark, rows))


def test_repeated_rows_share_records(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "_WIDTH", 4)
    rows = [(9, "same", "en", "s", 4)] * 300 + [(k, "t", "en", "s", 1) for k in range(100, 110)]
    docs = frame(spark, rows).repartition(5)
    check(spark, docs)
    nodes = docs.select(F.lit("en").alias("tree"), F.lit(310).cast("long").alias("leaves"), F.lit(310).cast("long").alias("n"), F.monotonically_increasing_id().alias("m"), F.lit("x").alias("digest"), F.lit(0).alias("members"))
    floor = merkle._segments(ranks.ranked(stored(nodes, "test"), ["tree"], ["m"]).drop("m"), "test")
    assert floor.count() > merkle._store(floor).count()


def test_ranks_split_one_group_and_equal_rows(spark):
    rows = stored(spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("v")), "test")
    got = ranks.ranked(rows, ["g"], ["v"], size="n").collect()
    assert {(r["g"], r["n"]) for r in got} == {(0, 2000), (1, 1000)}
    for g in (0, 1):
        mine = sorted((r["place"], r["v"] is not None, r["v"] or 0) for r in got if r["g"] == g)
        assert [p for p, *_ in mine] == list(range(len(mine))) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
