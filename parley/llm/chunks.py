"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks places where a text may be cut; up to the mean length a stricter mask holds, then a
looser one, so that lengths lie close to the mean (normalised chunking). Since a cut depends on the bytes before it alone,
texts that share a passage share its chunks wherever it stands. A fingerprint is the set of chunk digests with their
lengths; likeness is the length of the shared chunks against that of the shorter text's chunks (containment).

Null text: as the empty text, whose fingerprint is empty; an empty fingerprint is like nothing (0), but for another empty
one (1). Equal texts have equal fingerprints. Repeated rows and ties of doc_id: next to each other, by text. Null doc_id:
after all others. One row alone: the next document is itself. An empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MEAN, MOST = 16, 48, 192
#: Masks on the top bits of the gear hash, before and after the mean.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
_GEAR = None
#: Rows of a stretch of neighbours, and the most stretches (beyond which stretches grow; they are read as streams).
STRETCH_ROWS, MOST_STRETCHES = 8_000, 20_000


def _gear() -> np.ndarray:
    global _GEAR
    if _GEAR is None:
        _GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), np.uint32).copy()
    return _GEAR


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each place (fewer at the start), by doubling the window."""
    h = _gear()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else np.uint32(0)
    return h


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts: starts, ends, and each one's text. Places depend on the text alone, not on its neighbours."""
    n = len(at) - 1
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    h = gear_hash(data)
    # the first chunk's windows may reach over the text's start; those places are hashed anew from the text alone
    for k in range(LEAST, 32):
        place = at[:-1] + k - 1
        place = place[place < at[1:]]
        if len(place):
            h[place] = sum((_gear()[data[place - j]] << np.uint32(j)) for j in range(k))
    strict, loose = (np.flatnonzero((h & m) == 0) + 1 for m in (STRICT, LOOSE))
    strict, loose = np.append(strict, 1 << 62), np.append(loose, 1 << 62)
    live, here, end = np.arange(n), at[:-1].copy(), at[1:]
    live = live[here < end]
    starts, ends, owner = [], [], []
    while len(live):
        s, e = here[live], end[live]
        a = strict[np.searchsorted(strict, s + LEAST)]
        b = loose[np.searchsorted(loose, s + MEAN)]
        stop = np.minimum(np.where(a < s + MEAN, a, np.minimum(b, s + MOST)), e)
        starts.append(s), ends.append(stop), owner.append(live)
        here[live] = stop
        live = live[stop < e]
    starts, ends, owner = (np.concatenate(x) for x in (starts, ends, owner))
    order = np.argsort(starts)
    return starts[order], ends[order], owner[order]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in order the distinct chunk digests (sorted, 40 bits), their lengths, and how many each text has."""
    from parley.llm.shared import Spans, flat

    data, at = flat(texts)
    starts, ends, owner = cut(data, at)
    digest = Spans(data).hash(starts, ends) >> np.uint64(24)
    length = np.minimum(ends - starts, MOST)
    order = np.lexsort((length, digest, owner))
    digest, length, owner = digest[order], length[order], owner[order]
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
    return digest[fresh], length[fresh], np.bincount(owner[fresh], minlength=len(at) - 1)


def strings(digest: np.ndarray, length: np.ndarray, counts: np.ndarray) -> list[str]:
    """Ten hexadecimal digits of digest and two of length less one for each chunk."""
    raw = np.zeros((len(digest), 6), np.uint8)
    for k in range(5):
        raw[:, k] = digest >> np.uint64(32 - 8 * k)
    raw[:, 5] = length - 1
    text = raw.tobytes().hex()
    end = np.cumsum(counts) * 12
    return [text[a:b] for a, b in zip((end - counts * 12).tolist(), end.tolist(), strict=True)]


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    return sum(raw[:, k].astype(np.uint64) << np.uint64(32 - 8 * k) for k in range(5)) + np.uint64(0), raw[:, 5].astype(np.int64) + 1


def likeness_of_pairs(a, b) -> np.ndarray:
    """Containment for each row of two lists of fingerprints, given as (digest, length, counts)."""
    (da, la, ca), (db, lb, cb) = a, b
    n = len(ca)
    digest = np.concatenate((da, db))
    owner = np.concatenate((np.repeat(np.arange(n), ca), np.repeat(np.arange(n), cb)))
    length = np.concatenate((la, lb))
    order = np.lexsort((digest, owner))
    digest, owner, length = digest[order], owner[order], length[order]
    twin = (digest[1:] == digest[:-1]) & (owner[1:] == owner[:-1])
    shared = np.bincount(owner[1:][twin], length[1:][twin], n)
    total = [np.bincount(np.repeat(np.arange(n), c), x, n) for x, c in ((la, ca), (lb, cb))]
    least = np.minimum(*total)
    both_empty = (total[0] == 0) & (total[1] == 0)
    return np.where(both_empty, 1.0, np.minimum(1.0, shared / np.maximum(least, 1)))


def likeness(a: str, b: str) -> float:
    """Containment of two fingerprints, 0 to 1."""
    x, y = parsed(a), parsed(b)
    return float(likeness_of_pairs((*x, np.array([len(x[0])])), (*y, np.array([len(y[0])])))[0])


def edited(text: str, following: str) -> str:
    """The last third of the text, rounded down, replaced by as much of the start of the following one, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_following(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in stretches of descending doc_id: part, extra, doc_id, text; and the number of stretches. A stretch ends with a copy of the first row of the
    next one (extra = true), the last with that of the very first, so that each row's following text stands behind it.

    The borders of the stretches are quantiles of doc_id; they and each stretch's first id go to the driver (a few numbers
    for each of at most MOST_STRETCHES).
    """
    rows = docs.count()
    wanted = min(MOST_STRETCHES, -(-rows // STRETCH_ROWS))
    shares = [k / wanted for k in range(1, wanted)]
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / wanted) if shares else []
    borders = np.array(sorted({int(x) for x in cuts}), np.int64)

    def parts(ids: pa.Array) -> np.ndarray:
        """Part 0 has the largest ids; a null id goes to the last part."""
        found = len(borders) - np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(borders), found).astype(np.int32)

    def numbered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(parts(batch.column("doc_id"))), batch.column("doc_id")], names=["part", "doc_id"])

    firsts = docs.select("doc_id").mapInArrow(numbered, "part int, doc_id long").groupBy("part").agg(F.max("doc_id").alias("first")).collect()
    first = {r["part"]: r["first"] for r in firsts}
    order = sorted(first)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # of the first part: the last
    least = np.iinfo(np.int64).min
    heads = np.full(len(borders) + 1, least)
    for p, i in first.items():
        heads[p] = least if i is None else i
    to = np.array([before.get(p, 0) for p in range(len(borders) + 1)], np.int32)

    def placed(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").fill_null("")
            part = parts(ids)
            again = np.flatnonzero(ids.fill_null(int(least)).to_numpy(zero_copy_only=False) == heads[part])
            for p, extra, rows in ((part, False, None), (to[part[again]], True, pa.array(again))):
                if len(p):
                    i, t = (ids, texts) if rows is None else (ids.take(rows), texts.take(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), extra)), i, t], names=["part", "extra", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(placed, "part int, extra boolean, doc_id long, text string"), len(borders) + 1


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text."""
    from parley.llm.shared import slices

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        mine, after, new = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, following, changed))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(strings(*mine)),
                pa.array(strings(*new)),
                pa.array(likeness_of_pairs(mine, new)),
                pa.array(likeness_of_pairs(mine, after)),
            ],
            names=names,
        )

    def run(batches):
        held = None  # a row whose following text hasn't come yet
        for batch in slices(batches):
            part, extra = batch.column("part").to_pylist(), batch.column("extra").to_pylist()
            ids, texts, following = [], [], []
            for p, x, i, t in zip(part, extra, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held is not None and held[0] == p:
                    ids.append(held[1]), texts.append(held[2]), following.append(t)
                    held = None
                if not x:
                    held = (p, i, t)
            if ids:
                yield rows(ids, texts, following)

    stretches, number = with_following(docs)
    stretches = stretches.repartitionById(number, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return stretches.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
