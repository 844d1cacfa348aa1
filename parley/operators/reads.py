"""Reads of stored meetings: transcripts, lists, pages, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.dates import local_date
from parley.functions.text import fmt_time, language_name, speaker_name

SHAKY_SCORE = 0.5
MOST_HITS, SNIPPET = 200, 60
#: Terms of a search that are sent to every task.
MOST_TERMS = 1000


def segment_index(segments: DataFrame) -> DataFrame:
    """Segments with ordinal, their 0-based place by start within the meeting."""
    return segments.withColumn("ordinal", F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_seconds", "id")) - 1)


def transcript(segments: DataFrame, speakers: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Segments with ordinal, speaker name, the meeting's number of segments and, if words are given, their ordered words
    (an empty array where there are none). Words are gathered by segment first, never by meeting."""
    names = speakers.select(F.col("id").alias("speaker_id"), speaker_name(F.col("label"), F.col("display_name")).alias("speaker_name"))
    told = segment_index(segments).join(names, "speaker_id", "left").withColumns({"speaker_name": F.coalesce("speaker_name", F.lit("Unknown")), "segments": F.count("*").over(Window.partitionBy("meeting_id"))})
    if words is None:
        return told
    rows = words.groupBy(F.col("segment_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("start_seconds", "word_no", "end_seconds", "text", "score"))).alias("words"))
    return told.join(rows, "id", "left").withColumn("words", F.coalesce("words", F.array().cast(rows.schema["words"].dataType)))


def with_transcript(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Meetings with has_transcript: whether they have a segment."""
    has = segments.select(F.col("meeting_id").alias("id"), F.lit(True).alias("has_transcript")).distinct()
    return meetings.join(has, "id", "left").withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False)))


def list_meetings(meetings: DataFrame) -> DataFrame:
    """K1: all meetings, newest first, then by id downwards."""
    return meetings.orderBy(F.desc("created_at"), F.desc("id"))


def list_templates(templates: DataFrame) -> DataFrame:
    """K1: all templates, newest first, then by id downwards."""
    return templates.orderBy(F.desc("created_at"), F.desc("id"))


def segments_page(segments: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """K2: of each meeting the time-ordered slice, with the meeting's total; offset from 0 on, limit held within 1 to 500."""
    offset, limit = max(offset, 0), min(max(limit, 1), 500)
    told = segment_index(segments).withColumn("total", F.count("*").over(Window.partitionBy("meeting_id")))
    return told.where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit))


def search(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """K3: for each term (term) the first 200 hits of each meeting by time, with ordinal and a snippet.

    Terms are trimmed and need two characters; case doesn't count and no character is special. A snippet has 60 characters on
    each side of the first hit, with '...' on cut sides. Up to MOST_TERMS terms are matched with every line as they come;
    more of them meet the lines that have their first two characters anywhere.
    """
    wanted = wanted_terms(terms)
    lines = segment_index(segments)
    found = F.lower(F.col("text")).contains(F.lower(F.col("term")))
    if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        hits = lines.join(F.broadcast(wanted), found)
    else:
        low = F.lower("text")
        pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda k: F.substr(low, k, F.lit(2)))
        spread = lines.where(F.length(low) >= 2).withColumn("_pair", F.explode(F.array_distinct(pairs)))
        hits = spread.join(wanted.withColumn("_pair", F.substring(F.lower("term"), 1, 2)), "_pair").where(found).drop("_pair")
    return first_hits(hits)


def wanted_terms(terms: DataFrame) -> DataFrame:
    """The different terms, trimmed, of two characters or more."""
    return terms.select(F.trim("term").alias("term")).where(F.length("term") >= 2).distinct()


def first_hits(hits: DataFrame) -> DataFrame:
    """Of lines with a term in them (and ordinal) the first MOST_HITS of each meeting and term, with their snippets."""
    at = F.instr(F.lower("text"), F.lower("term"))
    rank = F.row_number().over(Window.partitionBy("term", "meeting_id").orderBy("ordinal"))
    return hits.withColumns({"_at": at, "_rank": rank}).where(F.col("_rank") <= MOST_HITS).select("term", "meeting_id", "id", "ordinal", "start_seconds", _snippet(F.col("text"), F.col("_at"), F.length("term")).alias("snippet"))


def _snippet(text: Column, at: Column, size: Column) -> Column:
    start = F.greatest(F.lit(1), at - SNIPPET)
    end = F.least(F.length(text), at + size - 1 + SNIPPET)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))


def segment_words(words: DataFrame, segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """K7: words of the wanted (meeting_id, segment_id) pairs, if the segment is the meeting's; order by start when read."""
    own = segments.select("meeting_id", F.col("id").alias("segment_id")).join(wanted, ["meeting_id", "segment_id"])
    return words.join(own.select("segment_id"), "segment_id", "left_semi")


def flag_shaky_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words with shaky: a score under 0.5, where the segment's words joined are its text but for spaces, punctuation and case."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]", "")
    lines = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    joined = words.groupBy("segment_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "").alias("_words"))
    same = joined.join(segments.select(F.col("id").alias("segment_id"), "text"), "segment_id").select("segment_id", (bare(F.col("_words")) == bare(F.col("text"))).alias("_same"))
    return words.join(same, "segment_id", "left").withColumn("shaky", F.coalesce(F.col("_same") & (F.col("score") < SHAKY_SCORE), F.lit(False))).drop("_same")


def meeting_overview(meetings: DataFrame, speakers: DataFrame, zone: str = "UTC") -> DataFrame:
    """Title, local date, duration, language, number of speakers, attendees in id order, summary or a placeholder."""
    names = F.sort_array(F.collect_list(F.struct("id", F.coalesce(F.nullif("display_name", F.lit("")), "label").alias("name"))))
    people = speakers.groupBy("meeting_id").agg(F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("attendees"), F.count("*").alias("speaker_count"))
    told = meetings.join(people, meetings["id"] == people["meeting_id"], "left")
    return told.select(
        "id",
        "title",
        local_date(F.col("created_at"), zone).alias("date"),
        fmt_time(F.col("duration_seconds")).alias("duration"),
        language_name(F.col("language")).alias("language_name"),
        F.coalesce("speaker_count", F.lit(0)).alias("speaker_count"),
        F.coalesce("attendees", F.lit("")).alias("attendees"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("No summary generated yet.")).alias("summary"),
    )
