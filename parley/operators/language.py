"""Which languages a recording really holds, from votes of windows and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import CJK_OR_COMPATIBLE, canonical_language, shares_script

SUPPORTED = ("en", "zh", "ms")


def window_votes(detections: DataFrame, min_prob: float = 0.3) -> DataFrame:
    """P12 for windows: canonical language among the supported ones and a probability that is null or high enough."""
    told = detections.withColumn("lang", canonical_language(F.col("lang")))
    return told.where(F.col("lang").isin(*SUPPORTED) & (F.col("prob").isNull() | (F.col("prob") >= min_prob)))


def segment_votes(detections: DataFrame, dominant: DataFrame, min_seconds: float = 0.6, min_prob: float = 0.55) -> DataFrame:
    """P12 for segments: long enough, supported, not the meeting's dominant language, probability null or high enough."""
    told = detections.withColumn("lang", canonical_language(F.col("lang"))).join(dominant.select("meeting_id", "dominant"), "meeting_id")
    sure = F.col("prob").isNull() | (F.col("prob") >= min_prob)
    return told.where((F.col("seconds") >= min_seconds) & F.col("lang").isin(*SUPPORTED) & (F.col("lang") != F.col("dominant")) & sure)


def dominant_language(votes: DataFrame, meetings: DataFrame | None = None) -> DataFrame:
    """The most frequent language (ties alphabetically) and whether there are several. meetings (meeting_id) without a
    vote count as English."""
    counts = votes.groupBy("meeting_id", "lang").agg(F.count("*").alias("n"))
    order = Window.partitionBy("meeting_id").orderBy(F.desc("n"), "lang")
    best = counts.withColumns({"_rank": F.row_number().over(order), "_kinds": F.count("*").over(Window.partitionBy("meeting_id"))}).where("_rank = 1")
    best = best.select("meeting_id", F.col("lang").alias("dominant"), (F.col("_kinds") > 1).alias("is_mixed"))
    if meetings is None:
        return best
    all_ = meetings.select("meeting_id").distinct().join(best, "meeting_id", "left")
    return all_.select("meeting_id", F.coalesce("dominant", F.lit("en")).alias("dominant"), F.coalesce("is_mixed", F.lit(False)).alias("is_mixed"))


def languages_in_segments(segments: DataFrame) -> DataFrame:
    """The sorted distinct canonical languages of a meeting's segments, with Chinese if any text has its characters."""
    named = segments.select("meeting_id", F.nullif(canonical_language(F.col("language")), F.lit("")).alias("lang"))
    seen = segments.where(F.col("text").rlike(CJK_OR_COMPATIBLE)).select("meeting_id", F.lit("zh").alias("lang"))
    return named.unionByName(seen).groupBy("meeting_id").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def corroborated_languages(votes: DataFrame, totals: DataFrame, min_segments: int = 3, min_share: float = 0.1) -> DataFrame:
    """The minority languages to keep.

    votes: meeting_id, lang, n. totals: meeting_id, dominant, total. A language of the dominant one's script needs enough
    segments and share; one of the other script is always kept, as is everything where the total isn't positive.
    """
    told = votes.join(totals, "meeting_id")
    enough = (F.col("n") >= min_segments) & (F.col("n") >= min_share * F.col("total"))
    return told.where((F.col("total") <= 0) | ~shares_script(F.col("lang"), F.col("dominant")) | enough).select("meeting_id", "lang", "n")
