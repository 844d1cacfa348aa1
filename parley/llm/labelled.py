"""Bounded samples of labelled documents, for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A label column with more values than this is no grading.
MOST_LABELS = 64


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int, keep=None, longest: int | None = None) -> DataFrame:
    """doc_id, text, label of at most `most` labelled documents for each label, chosen by a hash of doc_id.

    labels: doc_id and the label column; null labels are left out, and of several labels of one doc_id the largest counts.
    keep: a condition on doc_id. longest: texts of more bytes aren't used for fitting. The chosen ids are `most` for each of
    at most MOST_LABELS labels, so they can be broadcast; more labels than that are an error.
    """
    told = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if keep is not None:
        told = told.where(keep)
    told = told.groupBy("doc_id").agg(F.max("label").alias("label"))
    hashed = F.xxhash64("doc_id", F.lit(11))
    sizes = {r["label"]: r["count"] for r in told.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    # a hash under a bound that lets through a little more than `most`, so that no task sends its own top `most` to the driver
    chosen = []
    for kind, n in sorted(sizes.items()):
        rows = told.where(F.col("label") == kind)
        if n > 2 * most:
            rows = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * 1.5 * most / n))
        # the chosen ids come to the driver: `most` at most
        chosen += sorted((h, i, kind) for i, h in rows.select("doc_id", hashed).collect())[:most]
    chosen = [(i, kind) for _, i, kind in chosen]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if longest is not None:
        texts = texts.where(F.octet_length("text") <= longest)
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    return texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
