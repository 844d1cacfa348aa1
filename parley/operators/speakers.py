"""Speakers: talk time, phantom voices, word runs and the splitting of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.intervals import micros, overlap_join, segment_speaker, with_micros, word_speaker

#: A run of at most so many words and shorter than so many seconds is noise at a turn's border.
SHORT_WORDS, SHORT_SECONDS = 2, 0.8


def talk_time(turns: DataFrame) -> DataFrame:
    """G1: seconds per (meeting_id, speaker), summed in whole microseconds."""
    us = F.sum(micros("end_seconds") - micros("start_seconds"))
    return turns.groupBy("meeting_id", "speaker").agg((us / 1_000_000).alias("seconds"))


def voiceprint_labels(voiceprints: DataFrame, turns: DataFrame) -> DataFrame:
    """Voiceprint row i belongs to the i-th distinct label in order. Where the counts differ the whole meeting has none;
    rows with a NaN are left out after that. Gives meeting_id, speaker, embedding."""
    m = Window.partitionBy("meeting_id")
    labels = turns.select("meeting_id", "speaker").distinct()
    labels = labels.withColumns({"_no": F.row_number().over(m.orderBy("speaker")), "_labels": F.count("*").over(m)})
    rows = voiceprints.withColumns({"_no": F.row_number().over(m.orderBy("row_no")), "_rows": F.count("*").over(m)})
    met = rows.join(labels, ["meeting_id", "_no"]).where("_rows = _labels")
    return met.where(~F.exists("embedding", lambda x: F.isnan(x))).select("meeting_id", "speaker", "embedding")


def merge_phantoms(turns: DataFrame, labelled: DataFrame, max_seconds: float = 3.0, fixed_counts: DataFrame | None = None) -> DataFrame:
    """A speaker with a voiceprint who talks less than the limit becomes the most similar one who doesn't.

    labelled: meeting_id, speaker, embedding. Similarity is the cosine, -1 with a zero vector; ties go to the first label.
    Nothing changes in a meeting with fewer than two voiceprints, without phantoms or without targets, or in those of
    fixed_counts (meeting_id), where the number of speakers was given.
    """
    m = Window.partitionBy("meeting_id")
    known = labelled.join(talk_time(turns), ["meeting_id", "speaker"], "left").withColumn("_several", F.count("*").over(m) > 1).where("_several")
    known = known.withColumn("_phantom", F.coalesce(F.col("seconds") < max_seconds, F.lit(False)))
    if fixed_counts is not None:
        known = known.join(fixed_counts.select("meeting_id"), "meeting_id", "left_anti")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("embedding", "embedding"))
    known = known.withColumn("_norm", norm)
    phantom = known.where("_phantom").select("meeting_id", "speaker", F.col("embedding").alias("_e"), F.col("_norm").alias("_n"))
    target = known.where("not _phantom").select("meeting_id", F.col("speaker").alias("_target"), F.col("embedding").alias("_f"), F.col("_norm").alias("_m"))
    # a few voiceprints in each meeting, so the join within it is small
    pairs = phantom.join(target, "meeting_id")
    cosine = F.when((F.col("_n") == 0) | (F.col("_m") == 0), -1.0).otherwise(dot("_e", "_f") / (F.col("_n") * F.col("_m")))
    rank = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy(F.desc("_cosine"), "_target"))
    renamed = pairs.withColumn("_cosine", cosine).withColumn("_rank", rank).where("_rank = 1").select("meeting_id", "speaker", "_target")
    return turns.join(renamed, ["meeting_id", "speaker"], "left").withColumn("speaker", F.coalesce("_target", "speaker")).drop("_target")


def fill_word_speakers(words: DataFrame) -> DataFrame:
    """Words without a speaker take the last known one of their segment, leading ones the first that follows."""
    order = Window.partitionBy("meeting_id", "segment_id").orderBy("word_no")
    before = F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("speaker", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return words.withColumn("speaker", F.coalesce(before, after))


def speaker_runs(words: DataFrame, **more: Column) -> DataFrame:
    """Runs of words of one speaker in a segment: run_no from 1, speaker, first and last word, words, start, end, and more aggregates."""
    order = Window.partitionBy("meeting_id", "segment_id").orderBy("word_no")
    new = F.when(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    numbered = words.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("meeting_id", "segment_id", "run_no").agg(
        F.first("speaker").alias("speaker"),
        F.min("word_no").alias("first_word"),
        F.max("word_no").alias("last_word"),
        F.count("*").alias("words"),
        F.min_by("start_seconds", "word_no").alias("start_seconds"),
        F.max_by("end_seconds", "word_no").alias("end_seconds"),
        *[x.alias(c) for c, x in more.items()],
    )


def number_speakers(segments: DataFrame) -> DataFrame:
    """meeting_id, speaker, speaker_name: 'Speaker n' by first appearance; null speakers have none."""
    first = segments.where("speaker is not null").groupBy("meeting_id", "speaker").agg(F.min(F.struct("start_seconds", "id")).alias("_first"))
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first", "speaker"))
    return first.select("meeting_id", "speaker", F.concat(F.lit("Speaker "), n.cast("string")).alias("speaker_name"))


def speaker_minutes(segments: DataFrame, turns: DataFrame, bin_seconds: int = 30) -> DataFrame:
    """J2, W3 and G1 together: who spoke how long in each meeting, after attributing every segment."""
    attributed = segment_speaker(segments, turns, bin_seconds=bin_seconds).where("speaker is not null")
    us = F.sum(micros("end_seconds") - micros("start_seconds"))
    spoken = attributed.groupBy("meeting_id", "speaker").agg((us / 1_000_000).alias("seconds"), F.count("*").alias("segments"), F.min(F.struct("start_seconds", "id")).alias("_first"))
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first", "speaker"))
    return spoken.withColumn("speaker_name", F.concat(F.lit("Speaker "), n.cast("string"))).drop("_first")


def _passed(runs: Column) -> Column:
    """One pass over an array of runs: from left to right a short one takes the speaker of its only neighbour, or of the one with
    more words (the one before if they have as many); the one before may have changed already."""

    def step(done: Column, k: Column) -> Column:
        x, before, after = F.get(runs, k), F.get(done, k - 1), F.get(runs, k + 1)
        own = before.isNotNull() & (after.isNull() | (before["words"] >= after["words"]))
        speaker = F.when(_short(x), F.when(own, before["speaker"]).otherwise(after["speaker"])).otherwise(x["speaker"])
        return F.concat(done, F.array(_run(speaker, x, x, x["words"])))

    return F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), F.slice(runs, 1, 0), step)


def _short(x: Column) -> Column:
    return (x["words"] <= SHORT_WORDS) & (x["end"] - x["start"] < SHORT_SECONDS)


def _run(speaker: Column, first: Column, last: Column, words: Column) -> Column:
    return F.struct(speaker.alias("speaker"), words.alias("words"), first["start"].alias("start"), last["end"].alias("end"), first["first"].alias("first"), last["last"].alias("last"))


def _coalesced(runs: Column) -> Column:
    """Runs of one speaker that follow one another as one."""

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & last["speaker"].eqNullSafe(x["speaker"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_run(last["speaker"], last, x, last["words"] + x["words"])))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(runs, F.slice(runs, 1, 0), step)


def smoothed(runs: Column) -> Column:
    """Smoothed runs of an array of (speaker, words, start, end, first, last): passes until no run is short or one is left, at
    most as many as there are runs."""

    def step(now: Column, _: Column) -> Column:
        return F.when((F.size(now) > 1) & F.exists(now, _short), _coalesced(_passed(now))).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.size(runs)), runs, step)


def smooth_runs(runs: DataFrame) -> DataFrame:
    """Short runs take a neighbour's speaker. runs: as from speaker_runs; gives the same rows with speaker and the
    smoothed run's number. A segment's runs are folded as an array in the JVM, read once, where speaker_runs left them."""
    rest = [c for c in runs.columns if c not in ("meeting_id", "segment_id", "speaker")]
    rows = F.array_sort(F.collect_list(F.struct("run_no", "speaker", F.struct(*rest).alias("row"))))
    grouped = runs.groupBy("meeting_id", "segment_id").agg(rows.alias("rows"))
    shaped = F.transform("rows", lambda x, k: F.struct(x["speaker"].alias("speaker"), x["row"]["words"].alias("words"), x["row"]["start_seconds"].alias("start"), x["row"]["end_seconds"].alias("end"), k.alias("first"), k.alias("last")))
    told = grouped.withColumn("_shaped", shaped).withColumn("_smooth", smoothed(F.col("_shaped")))
    of_run = lambda s, n: F.transform(F.slice("rows", s["first"] + 1, s["last"] - s["first"] + 1), lambda x: F.struct(s["speaker"].alias("speaker"), x["row"].alias("row"), (n + 1).cast("long").alias("smooth_no")))
    told = told.select("meeting_id", "segment_id", F.explode(F.flatten(F.transform("_smooth", of_run))).alias("_run"))
    return told.select("meeting_id", "segment_id", "_run.speaker", "_run.row.*", "_run.smooth_no").select(*runs.columns, "smooth_no")


def split_by_speaker(segments: DataFrame, words: DataFrame, turns: DataFrame, min_ratio: float = 0.3, bin_seconds: int = 30) -> DataFrame:
    """Segments split at changes of the speaker: meeting_id, id, part_no, start_seconds, end_seconds, text, language, speaker.

    Without words a segment gets its speaker as a whole (J2). With too little speech it stays whole and has none. With one
    speaker it stays as it is; with several, each smoothed run of words becomes a part whose text is the run's words.
    """
    with_words = words.select("meeting_id", F.col("segment_id").alias("id")).distinct()
    whole = segment_speaker(segments.join(with_words, ["meeting_id", "id"], "left_anti"), turns, min_ratio, bin_seconds)
    spoken = segments.join(with_words, ["meeting_id", "id"])
    left = with_micros(spoken).select("meeting_id", "id", "start_us", "end_us")
    right = with_micros(turns).select("meeting_id", F.col("speaker").alias("_s"), "start_us", "end_us")
    speech = overlap_join(left, right, ["meeting_id"], bin_seconds).groupBy("meeting_id", "id").agg(F.sum("overlap_us").alias("_us"))
    heard = spoken.join(speech, ["meeting_id", "id"], "left")
    enough = F.coalesce("_us", F.lit(0)) >= min_ratio * F.greatest(F.lit(1000), micros("end_seconds") - micros("start_seconds"))
    heard = heard.withColumn("_enough", enough)
    # a run keeps its words' texts, so that words are shuffled once
    lines = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    runs = smooth_runs(speaker_runs(fill_word_speakers(word_speaker(words, turns, bin_seconds)), _lines=lines))
    parts = runs.groupBy("meeting_id", "segment_id", "smooth_no").agg(
        F.first("speaker").alias("_speaker"), F.min_by("start_seconds", "run_no").alias("_start"), F.max_by("end_seconds", "run_no").alias("_end"), F.sort_array(F.flatten(F.collect_list("_lines"))).alias("_lines")
    )
    several = Window.partitionBy("meeting_id", "segment_id")
    parts = parts.withColumn("_several", F.count("*").over(several) > 1).withColumnRenamed("segment_id", "id")
    cut = heard.where("_enough").join(parts, ["meeting_id", "id"])
    close = F.trim(F.array_join(F.transform("_lines", lambda x: x["text"]), ""))
    spaced = F.trim(F.array_join(F.transform("_lines", lambda x: F.trim(x["text"])), " "))
    own = lambda part, segment: F.when(F.col("_several"), part).otherwise(F.col(segment)).alias(segment)
    text = F.when(F.col("language") == "zh", close).otherwise(spaced)
    cut = cut.select("meeting_id", "id", F.col("smooth_no").alias("part_no"), own(F.col("_start"), "start_seconds"), own(F.col("_end"), "end_seconds"), own(text, "text"), "language", F.col("_speaker").alias("speaker"))
    shape = lambda df, speaker: df.select("meeting_id", "id", F.lit(1).cast("long").alias("part_no"), "start_seconds", "end_seconds", "text", "language", speaker.alias("speaker"))
    return shape(whole, F.col("speaker")).unionByName(shape(heard.where("not _enough"), F.lit(None).cast("string"))).unionByName(cut)
