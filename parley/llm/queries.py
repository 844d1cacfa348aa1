"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from parley.llm import bytepairs, chunks, lexical, licences, logbilinear, media, merkle, near, packing, pieces, quality, separators, shards, toxic
from parley.llm.shared import documents

#: Documents whose probability of the better grade is lower are rejected.
KEEP_QUALITY = 0.3


def op1_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_media_columns(spark, sf_dir):
    return media.media_columns(documents(spark, sf_dir))


def op3_jaccard_join(spark, sf_dir):
    return near.jaccard_join(documents(spark, sf_dir))


def op4_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.graded(docs.select("doc_id", "text"), model).select("doc_id", "quality_expected", "quality_tail", (F.col("quality_tail") >= KEEP_QUALITY).alias("kept"))


def op5_lm_scores(spark, sf_dir):
    found = logbilinear.score_documents(documents(spark, sf_dir))
    return found.withColumn("held_out", ~logbilinear.is_training())


def op6_token_counts(spark, sf_dir):
    return separators.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pack(docs):
    """The packing of op7 and of the pipeline: the tokenizer's ids, added tokens included."""
    added = bytepairs.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op7_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op8_licences(spark, sf_dir):
    return licences.scan(documents(spark, sf_dir))


def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    found = toxic.toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxic.THRESHOLD).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def op10_fingerprints(spark, sf_dir):
    return chunks.fingerprint_documents(documents(spark, sf_dir))


def op11_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_sharding(spark, sf_dir):
    return shards.shard_documents(documents(spark, sf_dir))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest_documents(documents(spark, sf_dir))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_sentencepiece, op2_media_columns, op3_jaccard_join, op4_quality, op5_lm_scores, op6_token_counts, op7_best_fit_packing, op8_licences, op9_toxicity, op10_fingerprints,
            op11_lexical_search, op12_sharding, op13_merkle_manifest,
        )
    }


#: All pairs of different texts that share a five-word n-gram, by their exact likeness; classes by reachability.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY text),
w AS (SELECT first_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM c),
k AS (SELECT first_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT first_id, array_to_string(words[k:k + 4], ' ') AS gram FROM k),
size AS (SELECT first_id, count(*) AS n FROM g GROUP BY first_id),
pair AS (SELECT x.first_id AS a, y.first_id AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.first_id <> y.first_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair p JOIN size x ON x.first_id = a JOIN size y ON y.first_id = b WHERE p.n * 10 >= 8 * (x.n + y.n - p.n)),
reach AS (SELECT first_id AS a, first_id AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
root AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
more AS (SELECT a, sum(c.copies) AS n FROM link JOIN c ON c.first_id = link.b GROUP BY a)
SELECT d.doc_id, root.class_id, CAST(c.copies - 1 + coalesce(more.n, 0) AS BIGINT) AS n_links
FROM d JOIN c ON c.text = d.text JOIN root ON root.a = c.first_id LEFT JOIN more ON more.a = c.first_id
"""


#: Scores by the formula for every pair of an item and a document that share a term.
LEXICAL_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len_ AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
all_ AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM len_),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, all_ GROUP BY term, n_docs),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // total AS m FROM len_, all_),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM qf JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def _crc_table() -> str:
    """The byte table of the reflected polynomial 0xEDB88320 as a list in SQL."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return f"[{', '.join(out)}]::BIGINT[]"


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of a text's bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, ({_crc_table()})[1 + (xor(c, b) & 255)])))"


def _draws_sql(path: str, children: str, weight: str) -> str:
    """The child with the least weighted draw."""
    number = f"CAST(concat('0x', substr(md5(concat({path}, '/', c)), 1, {shards.DIGITS})) AS BIGINT)"
    return f"list_sort(list_transform({children}, lambda c: struct_pack(d := -ln(({number} + 0.5) / {float(1 << 4 * shards.DIGITS)}) / ({weight}), i := c)))[1].i"


_KEY = "coalesce(CAST(doc_id AS VARCHAR), '-')"
#: The tree of 24 shards: three regions of two racks of four; the grown one has a fourth region with one shard.
SHARDS_SQL = f"""
WITH d AS (SELECT doc_id, {_KEY} AS k, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST({_crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents),
a AS (SELECT *, {_draws_sql("k", "[0, 1, 2]", "8.0")} AS region, {_draws_sql("k", "[0, 1, 2, 3]", "CASE WHEN c = 3 THEN 1.0 ELSE 8.0 END")} AS grown_region FROM d),
b AS (SELECT *, {_draws_sql("concat(k, '/', region)", "[0, 1]", "4.0")} AS rack FROM a),
c AS (SELECT *, {_draws_sql("concat(k, '/', region, '/', rack)", "[s + region * 8 + rack * 4 for s in [0, 1, 2, 3]]", "1.0")} AS shard FROM b)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(region AS INT) AS region, CAST(rack AS INT) AS rack, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(CASE WHEN grown_region = 3 THEN 24 ELSE shard END AS INT) AS grown_shard FROM c
"""


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


#: Level by level: nodes of each lang, then of the langs' roots, each document's siblings, and its leaf folded with them.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN mod(CAST({_crc_sql("CAST(doc_id AS VARCHAR)")} AS BIGINT), 7) = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents),
p AS (SELECT *, coalesce(lang, '') AS g, lang IS NULL AS no_lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM d),
node AS (SELECT g, no_lang, 0 AS h, k, leaf AS x, n FROM p
    UNION ALL SELECT g, no_lang, h + 1, k // 2, sha256(string_agg(x, '' ORDER BY k)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY g, no_lang, h, k // 2, n),
sub AS (SELECT g, no_lang, h, x, row_number() OVER (ORDER BY NOT no_lang, encode(g)) - 1 AS k, count(*) OVER () AS n FROM node WHERE n = 1),
over_ AS (SELECT 0 AS h, k, x, n FROM sub
    UNION ALL SELECT h + 1, k // 2, sha256(string_agg(x, '' ORDER BY k)), (n + 1) // 2 FROM over_ WHERE n > 1 GROUP BY h, k // 2, n),
top AS (SELECT h, x AS root FROM over_ WHERE n = 1),
step AS (SELECT p.doc_id, p.leaf, p.tampered, sub.x AS subroot, top.root, sub.h + top.h AS levels, sub.h AS own, p.g, p.no_lang, p.k, sub.k AS s FROM p JOIN sub ON p.g = sub.g AND p.no_lang = sub.no_lang, top),
walk AS (SELECT *, 0 AS h, coalesce(tampered, leaf) AS fold, '' AS proof FROM step
    UNION ALL SELECT w.doc_id, w.leaf, w.tampered, w.subroot, w.root, w.levels, w.own, w.g, w.no_lang, w.k, w.s, w.h + 1,
        CASE WHEN mod(CASE WHEN w.h < w.own THEN w.k >> w.h ELSE w.s >> (w.h - w.own) END, 2) = 1 THEN sha256(concat(coalesce(a.x, b.x), w.fold)) ELSE sha256(concat(w.fold, coalesce(a.x, b.x, ''))) END, concat(w.proof, coalesce(a.x, b.x, ''))
        FROM walk w LEFT JOIN node a ON w.h < w.own AND a.g = w.g AND a.no_lang = w.no_lang AND a.h = w.h AND a.k = xor(w.k >> w.h, 1)
        LEFT JOIN over_ b ON w.h >= w.own AND b.h = w.h - w.own AND b.k = xor(w.s >> (w.h - w.own), 1) WHERE w.h < w.levels)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM walk WHERE h = levels
"""


def oracle_sql():
    return {"op3_jaccard_join": JACCARD_SQL, "op11_lexical_search": LEXICAL_SQL, "op12_sharding": SHARDS_SQL, "op13_merkle_manifest": MERKLE_SQL}
