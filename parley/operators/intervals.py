"""Interval and as-of joins of words, segments, turns and clips, in whole microseconds inside.

Overlap joins go by a hierarchy of time bins: an interval lies in one or two bins of the level whose bins are as long as itself
or longer, and looks for longer ones in its bins of the levels above. As-of joins go by blocks of time, each with what the blocks
before it carry in. Neither needs a task for a whole meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.stage import stored

#: Length of a time bin of the lowest level in seconds; each level above has bins STEP times as long.
BIN_SECONDS = 30
STEP = 8
#: Rows that look for longer intervals are dealt over so many parts of a bin, and longer ones are repeated for each.
PARTS = 8
#: Segments of at most so many turns, and of so many bins from their first word to their last, take their turns to their words.
MOST_TURNS, MOST_BINS = 256, 64
#: Length of a block of an as-of join in seconds, and the segments whose ends are summed up together.
BLOCK_SECONDS, BLOCK_SEGMENTS = 3600, 1024


def micros(seconds: str | Column) -> Column:
    return F.round((F.col(seconds) if isinstance(seconds, str) else seconds) * 1_000_000).cast("long")


def _level(start: str, end: str, size: int) -> Column:
    """The lowest level with bins as long as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(STEP), (F.col(end) - F.col(start)) / float(size))).cast("int"))


def _bin(us: Column | str, level: Column, size: int) -> Column:
    """The number of the bin of a level in which a moment lies."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / (F.pow(F.lit(float(STEP)), level) * float(size)))


def _placed(df: DataFrame, start: str, end: str, others: Column, size: int, lower: int) -> DataFrame:
    """df once for each place (_level, _bin, _part) where it can meet the other side.

    At its own level an interval meets others of that level in part 0. Shorter ones of the other side come to it in parts of
    their own, lower + 1 and so on for the one side, and this one goes to longer ones (levels in `others`) likewise.
    """
    told = df.withColumns({"_own": _level(start, end, size), "_others": F.concat(F.array(F.lit(-1)), others)})
    told = told.withColumn("_level", F.explode("_others")).where("_level = -1 or _level > _own").withColumn("_level", F.greatest("_level", "_own")).drop("_others")
    told = told.withColumn("_bin", F.explode(F.sequence(_bin(start, F.col("_level"), size), _bin(F.col(end) - 1, F.col("_level"), size))))
    here, shorter = F.col("_level") == F.col("_own"), F.sequence(F.lit(1 + lower), F.lit(PARTS + lower))
    away = F.array((F.pmod(F.floor(F.col(start) / float(size)), F.lit(PARTS)) + (1 + PARTS - lower)).cast("int"))
    return told.withColumn("_part", F.explode(F.when(~here, away).when(F.col("_own") > 0, F.concat(F.array(F.lit(0)), shorter)).otherwise(F.array(F.lit(0))))).drop("_own")


def _levels(df: DataFrame, start: str, end: str, size: int) -> Column:
    """The levels that df's intervals have, as a subquery: a few numbers, whatever df holds."""
    return df.select(F.collect_set(_level(start, end, size)).alias("levels")).scalar()


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Pairs of rows of one key that overlap in time, with overlap_us. Both sides have start_us and end_us (end excluded).

    Columns of the right side must differ from the left's but for the keys; its interval comes back as r_start_us, r_end_us.
    Empty or reversed intervals overlap nothing. Two intervals meet at the level of the longer one, and the pair counts only in
    the bin where the later of the two starts lies. A level has bins of bin_seconds or STEP, STEP², … times as much, so that an
    interval makes a handful of rows, however long it is, and a long recording splits over many tasks. bin_seconds: best about
    the length of most of the longer side's intervals, so that few have to be looked for above.
    """
    size = bin_seconds * 1_000_000
    left = left.where("end_us > start_us")
    right = right.withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us"}).where("r_end_us > r_start_us")
    a = _placed(left, "start_us", "end_us", _levels(right, "r_start_us", "r_end_us", size), size, 0)
    b = _placed(right, "r_start_us", "r_end_us", _levels(left, "start_us", "end_us", size), size, PARTS)
    first = F.greatest("start_us", "r_start_us")
    met = a.join(b, [*keys, "_level", "_bin", "_part"]).withColumn("overlap_us", F.least("end_us", "r_end_us") - first)
    return met.where((F.col("overlap_us") > 0) & (_bin(first, F.col("_level"), size) == F.col("_bin"))).drop("_level", "_bin", "_part")


def with_micros(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_us": micros("start_seconds"), "end_us": micros("end_seconds")})


def _speaker_by_overlap(items: DataFrame, turns: DataFrame, min_ratio: float | None, bin_seconds: int) -> DataFrame:
    left = with_micros(items).select("meeting_id", "id", "start_us", "end_us")
    right = with_micros(turns).select("meeting_id", F.col("speaker").alias("turn_speaker"), "turn_no", "start_us", "end_us")
    met = overlap_join(left, right, ["meeting_id"], bin_seconds)
    by_speaker = met.groupBy("meeting_id", "id", "turn_speaker").agg(F.sum("overlap_us").alias("us"), F.min("turn_no").alias("first_turn"))
    # the most overlap, and of equal ones the speaker met first
    best = by_speaker.groupBy("meeting_id", "id").agg(F.max(F.struct(F.col("us"), -F.col("first_turn"), F.col("turn_speaker").alias("speaker"))).alias("best"), F.sum("us").alias("total_us"))
    out = items.drop("speaker").join(best, ["meeting_id", "id"], "left")
    speaker = F.col("best.speaker")
    if min_ratio is not None:
        duration = F.greatest(F.lit(1000), micros("end_seconds") - micros("start_seconds"))
        speaker = F.when(F.col("total_us") >= min_ratio * duration, speaker)
    return out.withColumn("speaker", speaker).drop("best", "total_us")


def segment_speaker(segments: DataFrame, turns: DataFrame, min_ratio: float = 0.3, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Segments with the speaker of most overlap, null if all speakers together cover less than the ratio."""
    return _speaker_by_overlap(segments, turns, min_ratio, bin_seconds)


def word_speaker(words: DataFrame, turns: DataFrame, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Words with the speaker of most overlap, null where no turn overlaps.

    Words with a segment_id are shuffled once, by meeting_id and segment_id, as what follows in W1 and W2 wants them: only the
    spans of segments are joined with turns by time, and each word looks through its segment's turns. Words without one, and
    those of a segment that many turns or long times lie in, are joined with turns by time themselves.
    """
    if "segment_id" not in words.columns:
        return _speaker_by_overlap(words, turns, None, bin_seconds)
    group, columns = ["meeting_id", "segment_id"], [c for c in words.columns if c != "speaker"]
    timed = with_micros(words.select(columns))
    spans = timed.where("end_us > start_us").groupBy(*group).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    spans = stored(spans.withColumn("_apart", F.col("segment_id").isNull() | (F.col("end_us") - F.col("start_us") > MOST_BINS * bin_seconds * 1_000_000)), "spans")
    right = with_micros(turns).select("meeting_id", F.col("speaker").alias("turn_speaker"), "turn_no", "start_us", "end_us")
    # larger bins, in which most turns are of the lowest level: a few more comparisons, but a turn makes few rows
    met = overlap_join(spans.where("not _apart").drop("_apart"), right, ["meeting_id"], STEP * bin_seconds)
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("turn_no"))
    met = met.withColumn("_nth", nth).where(F.col("_nth") <= MOST_TURNS + 1).groupBy(*group)
    near = stored(met.agg(F.collect_list(F.struct("r_start_us", "r_end_us", "turn_no", "turn_speaker")).alias("_turns")), "near")
    heard = timed.join(near.where(F.size("_turns") <= MOST_TURNS), group, "left").select(*columns, _most_heard(F.col("_turns")).alias("speaker"))
    apart = near.where(F.size("_turns") > MOST_TURNS).select(*group).union(spans.where("_apart").select(*group))
    if apart.isEmpty():
        return heard
    apart = apart.withColumnsRenamed({"meeting_id": "_m", "segment_id": "_s"})
    theirs = F.col("meeting_id").eqNullSafe(F.col("_m")) & F.col("segment_id").eqNullSafe(F.col("_s"))
    by_time = _speaker_by_overlap(words.join(apart, theirs, "left_semi"), turns, None, bin_seconds)
    return heard.join(apart, theirs, "left_anti").unionByName(by_time)


def _most_heard(turns: Column) -> Column:
    """The speaker of those turns that overlap start_us to end_us most, and of equal ones the one met first."""
    us = lambda t: F.least(t["r_end_us"], F.col("end_us")) - F.greatest(t["r_start_us"], F.col("start_us"))
    hits = F.filter(F.transform(turns, lambda t: F.struct(t["turn_speaker"].alias("speaker"), t["turn_no"].alias("turn_no"), us(t).alias("us"))), lambda t: t["us"] > 0)

    def total(speaker: Column) -> Column:
        own = F.filter(hits, lambda t: t["speaker"].eqNullSafe(speaker))
        first = F.array_min(F.transform(own, lambda t: t["turn_no"]))
        return F.struct(F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + t["us"]).alias("us"), (-first).alias("first"), speaker.alias("speaker"))

    speakers = F.array_distinct(F.transform(hits, lambda t: t["speaker"]))
    heard = F.when(F.size(speakers) == 1, speakers[0]).otherwise(F.array_max(F.transform(speakers, total))["speaker"])
    # greatest and least pass over a missing time
    return F.when(F.col("end_us") > F.col("start_us"), heard)


def _carried(summary: DataFrame, keys: list[str], block: str, values: dict[str, Column], before: bool = True) -> DataFrame:
    """keys and block with each value over the blocks before (or, from the last one on, behind) it: the scan over summaries, one
    row for each block."""
    w = Window.partitionBy(*keys).orderBy(F.col(block) if before else F.desc(block)).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, block, *[x.over(w).alias(n) for n, x in values.items()])


def bucket_words(words: DataFrame, segments: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Words (meeting_id, word_no, start_seconds, end_seconds, …) with the segment_id whose end first passes their midpoint.

    Neither words nor segments go back: a word counts with the largest midpoint so far, a segment with the largest end so
    far. Words past the last end go to the last segment; without segments to none.

    Both run in blocks: the largest midpoint of a block of time (the largest end of a block of segments) is carried into the
    blocks behind it. Then each different midpoint of a block looks for its segment in its own block of ends, and takes the first
    segment of the blocks behind if there is none: no task holds a meeting, and one word with a wrong time doesn't draw the
    others into its block.
    """
    m, size = ["meeting_id"], block_seconds * 1_000_000
    upto = Window.unboundedPreceding, Window.currentRow
    w = with_micros(words).withColumns({"_mid": F.col("start_us") + F.col("end_us"), "_block": F.floor(F.col("start_us") / size)})
    most = _carried(w.groupBy(*m, "_block").agg(F.max("_mid").alias("_top")), m, "_block", {"_before": F.max("_top")})
    own = Window.partitionBy(*m, "_block").orderBy("start_us", "end_us", "word_no")
    w = w.withColumns({"_inside": F.max("_mid").over(own.rowsBetween(*upto)), "_passed": F.max("_mid").over(own.rowsBetween(Window.unboundedPreceding, -1)), "_nth": F.row_number().over(own)})
    w = w.join(most, [*m, "_block"], "left").withColumn("_at", F.greatest("_inside", "_before"))
    s = segments.select(*m, "segment_no", F.col("id").alias("_segment"), (2 * micros("end_seconds")).alias("_end")).withColumn("_row", F.floor(F.col("segment_no") / BLOCK_SEGMENTS))
    ends = _carried(s.groupBy(*m, "_row").agg(F.max("_end").alias("_top")), m, "_row", {"_before": F.max("_top")})
    so_far = F.max("_end").over(Window.partitionBy(*m, "_row").orderBy("segment_no").rowsBetween(*upto))
    s = s.withColumn("_inside", so_far).join(ends, [*m, "_row"]).withColumn("_at", F.greatest("_inside", "_before"))
    # a segment ends strictly after its words' midpoints, so at one time words come behind it: they belong to the next
    marks = s.select(*m, "_at", F.lit(1).alias("_kind"), "segment_no", "_segment")
    # midpoints don't go back in a block, so that each different one is told by the word before it
    asked = w.where((F.col("_nth") == 1) | ~F.col("_at").eqNullSafe(F.greatest("_passed", "_before"))).select(*m, "_block", "_at")
    both = marks.unionByName(asked.withColumn("_kind", F.lit(0)), allowMissingColumns=True).withColumn("_time", F.floor(F.col("_at") / (2 * size)))
    mark = F.when(F.col("_kind") == 1, F.struct("_at", "segment_no", "_segment"))
    summary = both.groupBy(*m, "_time").agg(F.min(mark)["_segment"].alias("_first"), F.max(F.when(F.col("_kind") == 1, F.struct("segment_no", "_segment"))).alias("_last"))
    behind = _carried(summary.withColumn("_final", F.max("_last").over(Window.partitionBy(*m))["_segment"]), [*m, "_final"], "_time", {"_next": F.last("_first", ignorenulls=True)}, before=False)
    # from the last one on: a frame that reached to the end would be reckoned anew for each row
    order = Window.partitionBy(*m, "_time").orderBy(F.desc("_at"), "_kind", F.desc("segment_no"))
    ahead = F.last("_segment", ignorenulls=True).over(order.rowsBetween(*upto))
    found = both.withColumn("_ahead", ahead).where("_kind = 0").join(behind, [*m, "_time"])
    found = found.select(*m, "_block", "_at", F.coalesce("_ahead", "_next", "_final").alias("bucket_id"))
    return w.join(found, [*m, "_block", "_at"], "left").select(*words.columns, "bucket_id")


def graft_text(segments: DataFrame, clips: DataFrame, minority: DataFrame) -> DataFrame:
    """Second-language clips replace the text of minority segments.

    minority: meeting_id, id, language of the segments to fill. A clip goes to the first such segment of its language in
    which more than half of it lies. The clips' texts in order, joined by spaces, replace text and language; a segment that
    gets no text stays.
    """
    wanted = segments.drop("language").join(minority.select("meeting_id", "id", "language"), ["meeting_id", "id"])
    left = with_micros(clips).select("meeting_id", "language", "clip_no", F.col("text").alias("clip_text"), "start_us", "end_us")
    right = with_micros(wanted).select("meeting_id", "language", "segment_no", F.col("id").alias("segment_id"), "start_us", "end_us")
    met = overlap_join(left, right, ["meeting_id", "language"]).where("2 * overlap_us > end_us - start_us")
    first = met.groupBy("meeting_id", "language", "clip_no").agg(F.min(F.struct("segment_no", "segment_id", F.trim("clip_text").alias("clip_text"))).alias("to"))
    lines = F.sort_array(F.collect_list(F.struct("clip_no", "to.clip_text")))
    texts = first.where("to.clip_text <> ''").groupBy("meeting_id", F.col("to.segment_id").alias("id"), F.col("language").alias("_language"))
    texts = texts.agg(F.array_join(F.transform(lines, lambda x: x["clip_text"]), " ").alias("_text"))
    out = segments.join(texts, ["meeting_id", "id"], "left")
    return out.withColumns({"text": F.coalesce("_text", "text"), "language": F.coalesce("_language", "language")}).drop("_text", "_language")


def segment_at(segments: DataFrame, times: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Times (meeting_id, time_id, seconds) with the 0-based ordinal of the last segment that starts by then (0.05 s early), else 0.

    That is the number of such segments less one: those of the blocks of time before, summed up from a count for each block,
    and those of the time's own block so far.
    """
    m, size = ["meeting_id"], block_seconds * 1_000_000
    s = segments.select(*m, micros("start_seconds").alias("_at"), F.lit(0).alias("_kind"))
    t = times.select(*m, (micros("seconds") + 50_000).alias("_at"), F.lit(1).alias("_kind"), "time_id")
    both = s.unionByName(t, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / size))
    counts = both.groupBy(*m, "_block").agg(F.count_if(F.col("_kind") == 0).alias("_n"))
    before = _carried(counts, m, "_block", {"_before": F.sum("_n")})
    inside = Window.partitionBy(*m, "_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("_here", F.count_if(F.col("_kind") == 0).over(inside)).where("_kind = 1").join(before, [*m, "_block"])
    return told.select(*m, "time_id", F.greatest(F.lit(0), F.col("_here") + F.coalesce("_before", F.lit(0)) - 1).cast("int").alias("ordinal"))


def stitch_speech(pieces: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Speech intervals relative to pieces of a recording, as absolute times; failed pieces are left out."""
    shift = F.col("piece_no") * F.lit(float(chunk_seconds))
    return pieces.where(~F.col("failed")).select("meeting_id", "piece_no", (F.col("start_seconds") + shift).alias("start_seconds"), (F.col("end_seconds") + shift).alias("end_seconds"))


def detection_windows(meetings: DataFrame, n: int = 10, seconds: float = 25.0) -> DataFrame:
    """N evenly spaced sample windows of each recording, clamped to its ends; windows under 2 s are left out."""
    d = F.col("duration_seconds")
    no = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window_no")
    middle = (F.col("window_no") + 0.5) * d / n - seconds / 2
    start = F.greatest(F.lit(0.0), F.least(middle, F.greatest(F.lit(0.0), d - seconds)))
    spread = meetings.where("duration_seconds > 0").select("id", "duration_seconds", no).withColumn("start_seconds", start)
    return spread.withColumn("end_seconds", F.least(d, F.col("start_seconds") + seconds)).where("end_seconds - start_seconds >= 2").select(F.col("id").alias("meeting_id"), "window_no", "start_seconds", "end_seconds")
