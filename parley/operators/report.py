"""Minutes as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import fmt_time
from parley.operators.followup import as_lines
from parley.operators.intervals import micros

STATUS_LABELS = {"completed": "Completed", "in_progress": "In progress", "blocked": "Blocked", "changed": "Changed", "not_discussed": "Not discussed"}
SECTIONS = ("action_items", "decisions", "deadlines", "issues", "risks", "carry_forward")
DETAILS = {"action_items": ("owner", ""), "deadlines": ("date", ""), "risks": ("mitigation", "Mitigation: ")}


def status_label(status: Column) -> Column:
    label = status
    for value, text in STATUS_LABELS.items():
        label = F.when(status == value, text).otherwise(label)
    return label


def minutes_rows(items: DataFrame, segments: DataFrame, combined: bool = False) -> DataFrame:
    """M1: items (id, meeting_id, category, description, owner, due, date, mitigation, status, note, source_segment_id)
    numbered in each section of a meeting, with the source's time and '-' for what is empty.

    combined: the items of whole series (also series_id, position, meeting_title, as pooled_items gives them), numbered in
    each section of a series by position and id, with the column meeting.
    """
    at = segments.select("meeting_id", F.col("id").alias("source_segment_id"), fmt_time(F.col("start_seconds")).alias("source"))
    told = items.join(at, ["meeting_id", "source_segment_id"], "left")
    order = Window.partitionBy("series_id", "category").orderBy("position", "id") if combined else Window.partitionBy("meeting_id", "category").orderBy("id")
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    shown = {c: dash(F.col(c)) for c in ("owner", "due", "date", "mitigation", "note") if c in items.columns}
    if "status" in items.columns:
        shown["status"] = dash(status_label(F.col("status")))
    if combined:
        shown["meeting"] = dash(F.col("meeting_title"))
    return told.withColumn("number", F.row_number().over(order)).withColumns(shown | {"source": dash(F.col("source"))})


def section_text(items: DataFrame, meetings: DataFrame, combined: bool = False) -> DataFrame:
    """M2: meeting_id, section, text: a section's items joined by '; ' with their detail in brackets, or 'None recorded.'.

    items: id, meeting_id, category, description, owner, date, mitigation, status. combined: the items of whole series, as
    `pooled_items` gives them (also series_id, position, meeting_title), for each id of meetings as a series: series_id instead of
    meeting_id, in the order of the chain and then of ids, each behind its meeting's title in square brackets.
    """
    key = "series_id" if combined else "meeting_id"
    told = items.withColumn("_line", _line(items, _tag(F.col("meeting_title")) if combined else F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(*(["position"] if combined else []), "id", "_line")))
    texts = told.groupBy(key, F.col("category").alias("section")).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "; ").alias("_text"))
    every = meetings.select(F.col("id").alias(key), F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section"))
    return every.join(texts, [key, "section"], "left").select(key, "section", F.coalesce("_text", _no_items()).alias("text"))


def _tag(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), title, F.lit("] "))).otherwise("")


def _line(items: DataFrame, tag: Column) -> Column:
    """An item's text behind the tag, with its detail."""
    detail = F.lit(None).cast("string")
    for category, (column, lead) in DETAILS.items():
        text = F.concat(F.lit(f" ({lead}"), F.nullif(F.col(column), F.lit("")), F.lit(")"))
        detail = F.when(F.col("category") == category, text).otherwise(detail)
    if "status" in items.columns:
        detail = F.when(F.col("category") == "carry_forward", F.concat(F.lit(" — "), status_label(F.col("status")))).otherwise(detail)
    return F.concat(tag, F.coalesce("description", F.lit("")), F.coalesce(detail, F.lit("")))


def _no_items() -> Column:
    return F.when(F.col("section") == "carry_forward", "No previous meeting linked.").otherwise("None recorded.")


def series_section_text(lines: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """M2 combined for every series of `series_lines`: series_id, section, text, as section_text gives them for pooled items.

    A meeting's items are put together once, and what is shuffled to its line is that text: a series' text is the line's so far.
    """
    titles = meetings.select(F.col("id").alias("meeting_id"), _tag(F.col("title")).alias("_tag"))
    every = lines.join(titles, "meeting_id").withColumn("section", F.explode(F.array(*[F.lit(s) for s in SECTIONS])))
    said = items.select("meeting_id", F.col("category").alias("section"), "id", _line(items, F.lit("")).alias("_line"))
    rows = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", F.concat("_tag", "_line").alias("_line")))))
    text = F.when(F.count("id") > 0, F.array_join(F.transform(rows, lambda r: r["_line"]), "; "))
    told = every.join(said, ["meeting_id", "section"], "left").groupBy("meeting_id", "section", "line", "position", "series_id").agg(text.alias("_text"))
    so_far = Window.partitionBy("line", "section").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.select("series_id", "section", F.collect_list("_text").over(so_far).alias("_texts")).where("series_id is not null")
    return told.select("series_id", "section", F.when(F.size("_texts") > 0, F.array_join("_texts", "; ")).otherwise(_no_items()).alias("text"))


def marker_values(overview: DataFrame, sections: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """M2 and M6: meeting_id, field, value of every field that a template can ask of a meeting.

    overview: as `meeting_overview` gives it; sections: as `section_text`; transcripts: as `transcript_text` ('' where a meeting
    has none). Nobody present is told by a dash.
    """
    shown = {"title": "title", "date": "date", "duration": "duration", "language": "language_name", "participants": "speaker_count", "attendees": "attendees", "summary": "summary"}
    pairs = [F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in shown.items()]
    told = overview.select(F.col("id").alias("meeting_id"), F.inline(F.array(*pairs)))
    dash = F.when((F.col("field") == "attendees") & (F.col("value") == ""), "—").otherwise(F.col("value"))
    told = told.withColumn("value", dash).unionByName(sections.select("meeting_id", F.col("section").alias("field"), F.col("text").alias("value")))
    if transcripts is not None:
        spoken = overview.select(F.col("id").alias("meeting_id")).join(transcripts, "meeting_id", "left")
        told = told.unionByName(spoken.select("meeting_id", F.lit("transcript").alias("field"), F.coalesce("text", F.lit("")).alias("value")))
    return told


def series_values(chain: DataFrame, overview: DataFrame, meetings: DataFrame, speakers: DataFrame, sections: DataFrame) -> DataFrame:
    """M2 and M6 for series: series_id, field, value, from `series_lines` or a chain (id, position, meeting_id), the overview of
    every meeting, durations and speakers, and the combined sections.

    Title of the last meeting, dates from first to last, durations summed, languages and attendees in first-seen order, one
    summary line for each meeting, and a note that stands for the transcripts.
    """
    seconds = meetings.select(F.col("id").alias("meeting_id"), F.coalesce(micros("duration_seconds"), F.lit(0)).alias("_us"))
    own = overview.select(F.col("id").alias("meeting_id"), F.struct("title", "date", "language_name", "summary").alias("_row"))
    names = F.sort_array(F.collect_list(F.struct("id", F.coalesce(F.nullif("display_name", F.lit("")), "label").alias("name"))))
    named = speakers.groupBy("meeting_id").agg(F.transform(names, lambda p: p["name"]).alias("names"))
    told = as_lines(chain).join(own.join(seconds, "meeting_id"), "meeting_id", "left").join(named, "meeting_id", "left")
    so_far = Window.partitionBy("line").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    people = F.collect_list(F.when(F.col("_row").isNotNull(), F.col("names"))).over(so_far)
    told = told.select("series_id", F.collect_list("_row").over(so_far).alias("rows"), (F.sum("_us").over(so_far) / 1_000_000).alias("seconds"), F.flatten(people).alias("people"))
    told = told.where("series_id is not null and size(rows) > 0")
    first, last, n = F.element_at("rows", 1), F.element_at("rows", -1), F.size("rows")
    seen = F.array_distinct(F.filter("people", lambda x: F.coalesce(x, F.lit("")) != ""))
    languages = F.array_distinct(F.filter(F.transform("rows", lambda r: r["language_name"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    count = n.cast("string")
    values = {
        "title": F.concat(last["title"], F.when(n > 1, F.concat(F.lit(" (combined series of "), count, F.lit(" meetings)"))).otherwise("")),
        "date": F.when(first["date"] == last["date"], first["date"]).otherwise(F.concat(first["date"], F.lit(" to "), last["date"])),
        "duration": fmt_time(F.col("seconds")),
        "language": F.coalesce(F.nullif(F.array_join(languages, ", "), F.lit("")), F.lit("-")),
        "participants": F.size(seen).cast("string"),
        "attendees": F.coalesce(F.nullif(F.array_join(seen, ", "), F.lit("")), F.lit("—")),
        "summary": F.array_join(F.transform("rows", lambda r: F.concat(r["title"], F.lit(" ("), r["date"], F.lit("): "), r["summary"])), "\n"),
        # Fixed value: the note for a transcript that isn't repeated.
        "transcript": F.concat(F.lit("Full transcripts are not reproduced in a combined document - each of the "), count, F.lit(" meeting"), F.when(n != 1, "s").otherwise(""), F.lit(" in this series carries its verbatim record in its own export.")),
    }
    told = told.select("series_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])))
    return told.unionByName(sections.select("series_id", F.col("section").alias("field"), F.col("text").alias("value")))


def transcript_text(transcript: DataFrame) -> DataFrame:
    """M2 for the transcript: meeting_id, text: '[m:ss] Name: text' joined by ' / ' in time order."""
    line = F.concat(F.lit("["), fmt_time(F.col("start_seconds")), F.lit("] "), F.col("speaker_name"), F.lit(": "), F.trim("text"))
    rows = F.sort_array(F.collect_list(F.struct("start_seconds", "id", line.alias("line"))))
    return transcript.groupBy("meeting_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), " / ").alias("text"))
