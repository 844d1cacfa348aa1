"""Insights of a meeting: owners, derived deadlines, citations, summaries and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.dates import NO_DUE, date_cues, display_date, norm_date
from parley.functions.text import is_low_support, is_self_assignment, normalised, output_language, speaker_name
from parley.operators.likeness import LEAST, like_components, like_texts
from parley.sources.stage import stored

# The texts that stand for a missing summary.
NO_SUMMARY = "No narrative summary could be generated for this meeting; please refer to the extracted items and the full transcript."
NO_CHUNKS = (
    "Automatic insight extraction did not produce usable structured output for this meeting. The local language model could not reliably categorize this "
    "content (this can happen with non-English audio on the 8B model). The full transcript is available for manual review."
)
LONGEST_SUMMARY = 1500


def attribute_owners(items: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Action items without an owner get the speaker of the first cited line that is a self-assignment and has one."""
    open_ = items.where("category = 'action_items' and coalesce(owner, '') = ''").select("meeting_id", "chunk_no", "category", "item_no", F.posexplode("source_segment_ids").alias("_pos", "_segment"))
    named = segments.where("speaker_id is not null").join(speakers.select(F.col("id").alias("speaker_id"), speaker_name(F.col("label"), F.col("display_name")).alias("_name")), "speaker_id")
    named = named.where(is_self_assignment(F.col("text"))).select("meeting_id", F.col("id").alias("_segment"), "_name")
    owner = open_.join(named, ["meeting_id", "_segment"]).groupBy("meeting_id", "chunk_no", "category", "item_no").agg(F.min_by("_name", "_pos").alias("_owner"))
    return items.join(owner, ["meeting_id", "chunk_no", "category", "item_no"], "left").withColumn("owner", F.coalesce("_owner", "owner")).drop("_owner").select(items.columns)


def all_insights(tables: dict[str, DataFrame]) -> DataFrame:
    """The five item tables as one, with category and every table's columns; order by category and id when read."""
    out = None
    for category, table in tables.items():
        part = table.withColumn("category", F.lit(category))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cite_items(items: DataFrame, segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """Items (id, meeting_id, category, description, source_segment_id) with the cited line's text, language and start,
    and low_support, false without a citation. Nothing is left out."""
    lines = segments.select("meeting_id", F.col("id").alias("source_segment_id"), F.col("text").alias("source_text"), F.col("language").alias("source_language"), F.col("start_seconds").alias("source_seconds"))
    spoken = meetings.select(F.col("id").alias("meeting_id"), output_language(F.col("primary_language"), F.col("language"), None).alias("_language"))
    told = items.join(lines, ["meeting_id", "source_segment_id"], "left").join(spoken, "meeting_id", "left")
    return told.withColumn("low_support", is_low_support(F.col("description"), F.col("source_text"), F.col("_language"), F.col("source_language"))).drop("_language")


def _candidates(due: str, description: str) -> Column:
    """(date, shown) of an action's cues in order: its due, unless its first word means none, then its wording's."""
    said = F.btrim(F.coalesce(F.col(due), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    plain = F.btrim(F.lower(said), F.lit(" .()-—\"'"))
    own = F.when((plain != "") & ~F.regexp_extract(plain, r"(?U)^\s*(\S*)", 1).isin(NO_DUE), F.array(said)).otherwise(F.array().cast("array<string>"))
    cues = F.transform(F.concat(own, date_cues(F.col(description))), lambda c: F.struct(norm_date(c).alias("date"), display_date(c).alias("shown")))
    return F.filter(cues, lambda c: c["date"] != "")


def _fold(actions: Column) -> Column:
    """Actions (item_no, text, cues, …) of one group in order, with picked: the cues whose date no earlier row of a like text has."""
    none = F.array().cast("array<struct<text:string,date:string>>")
    start = F.struct(none.alias("covered"), F.array().cast("array<array<string>>").alias("picked"))
    like = lambda a, b: (a == b) | ((F.least(F.length(a), F.length(b)) >= LEAST) & (a.contains(b) | b.contains(a)))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["cues"], lambda c: ~F.exists(acc["covered"], lambda v: (v["date"] == c["date"]) & like(v["text"], x["text"])))
        picked = F.transform(free, lambda c: c["shown"])
        row = F.array(F.struct(x["text"].alias("text"), norm_date(F.array_join(picked, ", ")).alias("date")))
        return F.struct(F.when(F.size(picked) > 0, F.array_union(acc["covered"], row)).otherwise(acc["covered"]).alias("covered"), F.concat(acc["picked"], F.array(picked)).alias("picked"))

    return F.zip_with(actions, F.aggregate(actions, start, step)["picked"], lambda x, p: F.struct(x["item_no"].alias("item_no"), x["description"].alias("description"), x["source_segment_ids"].alias("source_segment_ids"), p.alias("picked")))


def _with_cues(actions: DataFrame) -> DataFrame:
    """The actions that have cues (date, shown), each date once. The texts are searched in a generator, since a condition on the
    cues would be pushed below a projection and have them searched again for each mention."""
    first = lambda found: F.filter(found, lambda c, k: ~F.exists(F.slice(found, F.lit(1), k), lambda other: other["date"] == c["date"]))
    told = actions.select("meeting_id", "item_no", "description", "source_segment_ids", normalised(F.col("description")).alias("text"), F.explode(F.array(_candidates("due", "description"))).alias("_all"))
    return told.withColumn("cues", first(F.col("_all"))).drop("_all").where(F.size("cues") > 0)


def derive_deadlines(deadlines: DataFrame, actions: DataFrame) -> DataFrame:
    """The deadlines (meeting_id, item_no, description, date, source_segment_ids) with one more for every dated action
    that needs it.

    actions: meeting_id, item_no, description, due, source_segment_ids; a new row has its action's citations. An action's cues
    are its due (unless its first word means none) and the date phrases of its wording, each date once, without those that a like
    deadline has. item_no goes on counting; the new row's cues are joined by ', '.

    What given deadlines cover is a join of like texts. New rows cover later actions too, in order, but only actions of a like
    text: so the actions with cues left are folded one after the other within a component of like texts, and those that are like
    no other stand for themselves.
    """
    on = ["meeting_id"]
    told = stored(_with_cues(actions), "cues")
    given = deadlines.select(*on, normalised(F.col("description")).alias("_right"), norm_date(F.col("date")).alias("date")).where("date <> ''").distinct()
    covered = like_texts(told, deadlines, on).join(given, [*on, "_right"]).groupBy(*on, F.col("_left").alias("text")).agg(F.collect_set("date").alias("_dates"))
    told = told.join(covered, [*on, "text"], "left").withColumn("cues", F.filter("cues", lambda c: ~F.coalesce(F.array_contains("_dates", c["date"]), F.lit(False)))).drop("_dates")
    told = stored(told.where(F.size("cues") > 0), "open")
    roots = like_components(told.where("text <> ''").select(*on, F.col("text").alias("_text")).distinct(), on).withColumnRenamed("_text", "text")
    placed = told.join(roots, [*on, "text"], "left").withColumn("_group", F.struct("_root", F.when(F.col("_root").isNull(), F.col("text")).alias("_text")))
    row = F.struct("item_no", "text", "cues", "description", "source_segment_ids")
    folded = placed.where("text <> ''").groupBy(*on, "_group").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(*on, F.inline(_fold(F.col("rows"))))
    alone = told.where("text = ''").select(*on, "item_no", "description", "source_segment_ids", F.transform("cues", lambda c: c["shown"]).alias("picked"))
    new = folded.unionByName(alone).where(F.size("picked") > 0)
    last = deadlines.groupBy(*on).agg(F.max("item_no").alias("_last"))
    number = F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy(*on).orderBy("item_no"))
    new = new.join(last, on, "left").select(*on, number.cast("int").alias("item_no"), "description", F.array_join("picked", ", ").alias("date"), "source_segment_ids", F.lit(True).alias("derived"))
    return deadlines.select(*on, "item_no", "description", "date", "source_segment_ids", F.lit(False).alias("derived")).unionByName(new)


def summary_fallback(meetings: DataFrame, summaries: DataFrame, items: DataFrame) -> DataFrame:
    """meeting_id, summary: the first that isn't empty of the model's summary, the chunks' summaries joined, the first
    five decisions and actions joined, and a fixed note; without any parsed chunk a fixed text.

    meetings: meeting_id, model_summary. summaries: meeting_id, chunk_no, summary of parsed chunks. items: as parsed.
    """
    lines = F.sort_array(F.collect_list(F.when(F.trim("summary") != "", F.struct("chunk_no", F.trim("summary").alias("t")))))
    joined = summaries.groupBy("meeting_id").agg(F.substring(F.array_join(F.transform(lines, lambda x: x["t"]), " "), 1, LONGEST_SUMMARY).alias("_joined"), F.lit(True).alias("_parsed"))
    rows = lambda c: F.slice(F.sort_array(F.collect_list(F.when((F.col("category") == c) & (F.col("description") != ""), F.struct("chunk_no", "item_no", "description")))), 1, 5)
    points = items.where(F.col("category").isin("decisions", "action_items")).groupBy("meeting_id").agg(F.concat(rows("decisions"), rows("action_items")).alias("_p"))
    points = points.select("meeting_id", F.substring(F.array_join(F.transform("_p", lambda x: x["description"]), " / "), 1, LONGEST_SUMMARY).alias("_points"))
    told = meetings.join(joined, "meeting_id", "left").join(points, "meeting_id", "left")
    some = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(some(F.trim("model_summary")), some(F.col("_joined")), some(F.col("_points")), F.lit(NO_SUMMARY))
    return told.select("meeting_id", F.when(F.col("_parsed").isNull(), NO_CHUNKS).otherwise(text).alias("summary"))


def summary_input(summaries: DataFrame, items: DataFrame, most: int = 15) -> DataFrame:
    """K6: meeting_id, material: all chunk summaries and the first decisions and actions, as one JSON text."""
    texts = lambda rows, field: F.transform(F.sort_array(rows), lambda x: x[field])
    lines = summaries.groupBy("meeting_id").agg(texts(F.collect_list(F.struct("chunk_no", "summary")), "summary").alias("chunk_summaries"))
    rows = lambda c: F.slice(texts(F.collect_list(F.when(F.col("category") == c, F.struct("chunk_no", "item_no", "description"))), "description"), 1, most)
    points = items.groupBy("meeting_id").agg(rows("decisions").alias("decisions"), rows("action_items").alias("action_items"))
    none = F.array().cast("array<string>")
    told = lines.join(points, "meeting_id", "left")
    return told.select("meeting_id", F.to_json(F.struct("chunk_summaries", F.coalesce("decisions", none).alias("decisions"), F.coalesce("action_items", none).alias("action_items"))).alias("material"))


def item_counts(items: DataFrame) -> DataFrame:
    """meeting_id and the number of items in each category."""
    names = ["action_items", "decisions", "deadlines", "issues", "risks"]
    return items.groupBy("meeting_id").agg(*[F.count_if(F.col("category") == n).alias(n) for n in names])
