"""Changes to stored tables: replacements, purges, corrections and the sweep after a restart.

Each change is a function from tables to new tables. The forms ending in `_stored` apply it to tables that lie in folders by hash
bucket of the meeting, and read and write only the buckets that the change touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.sources.tables import BUCKETS, change_buckets, overwrite_buckets, path_exists, with_bucket

BUSY = ("uploading", "uploaded", "audio_extracted", "vad_done", "transcribing", "aligning", "diarizing")
CARRY_STATUSES = ("completed", "in_progress", "blocked", "changed", "not_discussed")
#: Columns of each table that a correction may change.
EDITABLE = {
    "action_items": ("description", "owner", "due_date"),
    "decisions": ("description",),
    "deadlines": ("description", "target_date"),
    "issues": ("description", "severity"),
    "risks": ("description", "mitigation"),
    "carry_forward": ("description", "owner", "status", "note"),
}


def replace_meetings(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """S3: old rows of the done meetings (meeting_id) go, new rows come; a meeting without new rows still loses its old ones.

    Applied twice it gives the same. Write it partitioned by a hash bucket of meeting_id with dynamic overwrite.
    """
    ids = done.select("meeting_id").distinct()
    return old.join(ids, "meeting_id", "left_anti").select(old.columns).unionByName(new.join(ids, "meeting_id", "left_semi").select(old.columns))


def store_table(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A table in folders by hash bucket of its meeting_id; that of the meetings themselves by their id."""
    keyed = table if "meeting_id" in table.columns else table.withColumn("meeting_id", F.col("id"))
    overwrite_buckets(with_bucket(keyed, buckets), path)


def replace_stored(new: DataFrame, done: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """S3 on a stored table: the done meetings' rows are replaced by those of new. Gives the buckets touched."""
    spark, schema = new.sparkSession, new.schema
    if not path_exists(spark, path):
        overwrite_buckets(with_bucket(new.join(done.select("meeting_id").distinct(), "meeting_id", "left_semi").select(new.columns), buckets), path)
        return []
    return change_buckets(spark, path, schema, done, lambda old: replace_meetings(old, new, done), buckets)


def purge_stored(spark: SparkSession, folder: str, schemas: dict[str, StructType | str], ids: DataFrame, buckets: int = BUCKETS) -> dict[str, list[int]]:
    """J16 on stored tables, one below folder for each name of schemas; gives the buckets touched in each.

    All tables have meeting_id (words too, meetings their own id as such). A follower's bucket counts as touched in `meetings` and
    `carry_forward`: followers are found by a scan of two columns, whose rows are written only in their own buckets.
    """
    gone = ids.select(F.col("id").alias("meeting_id")).distinct()
    out = {}
    for name, schema in schemas.items():
        path, follower = f"{folder}/{name}", {"meetings": "follow_up_of", "carry_forward": "previous_meeting_id"}.get(name)
        more = None
        if follower:
            links = spark.read.schema(schema).parquet(path).select("meeting_id", F.col(follower).alias("_of"))
            more = links.join(gone.withColumnRenamed("meeting_id", "_of"), "_of", "left_semi").select("meeting_id")
        if name == "words":  # their meeting is a column of the stored form, so that segments needn't be read
            out[name] = change_buckets(spark, path, schema, gone, lambda t: t.join(gone, "meeting_id", "left_anti").select(t.columns), buckets)
        elif name == "meetings":
            out[name] = change_buckets(spark, path, schema, gone, lambda t: purge_meetings({"meetings": t}, ids)["meetings"], buckets, more)
        else:
            out[name] = change_buckets(spark, path, schema, gone, lambda t, n=name: purge_meetings({"meetings": ids.select("id", F.lit(None).cast("long").alias("follow_up_of"), F.lit(None).cast("string").alias("carry_forward_status")), n: t}, ids)[n], buckets, more)
    return out


def edit_stored(edits: DataFrame, name: str, path: str, schema: StructType | str, buckets: int = BUCKETS) -> list[int]:
    """J17 on a stored table: the accepted edits take effect; gives the buckets touched, those of the edits' meetings."""
    return change_buckets(edits.sparkSession, path, schema, edits, lambda table: apply_edits(table, name, edits)[0], buckets)


def purge_meetings(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the meetings (id) and what is theirs. Followers lose their link, its status and its rows."""
    gone = ids.select(F.col("id").alias("meeting_id")).distinct()
    out = {}
    meetings = tables["meetings"].join(gone.withColumnRenamed("meeting_id", "id"), "id", "left_anti")
    lost = gone.select(F.col("meeting_id").alias("follow_up_of"), F.lit(True).alias("_lost"))
    meetings = meetings.join(lost, "follow_up_of", "left")
    out["meetings"] = meetings.withColumns({"follow_up_of": F.when(F.col("_lost").isNull(), F.col("follow_up_of")), "carry_forward_status": F.when(F.col("_lost").isNull(), F.col("carry_forward_status"))}).select(tables["meetings"].columns)
    for name, table in tables.items():
        if name == "words":
            theirs = tables["segments"].join(gone, "meeting_id", "left_semi").select(F.col("id").alias("segment_id"))
            out[name] = table.join(theirs, "segment_id", "left_anti").select(table.columns)
        elif name == "carry_forward":
            kept = table.join(gone, "meeting_id", "left_anti")
            out[name] = kept.join(gone.withColumnRenamed("meeting_id", "previous_meeting_id"), "previous_meeting_id", "left_anti").select(table.columns)
        elif name != "meetings":
            out[name] = table.join(gone, "meeting_id", "left_anti").select(table.columns)
    return out


def normal_status(status: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(status)), " ", "_")


def apply_edits(table: DataFrame, name: str, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the accepted edits, and all edits with accepted and reason.

    edits: edit_id, id, meeting_id, fields (the columns supplied), a column for each editable field, and delete. Reasons:
    unknown row (also by another meeting), nothing editable, empty description, bad status. Only supplied fields change;
    a status is trimmed, in lower case, with '_' for spaces; the citation never changes. An edit of a row that another
    edit deletes has no effect; of several edits of a row the last by edit_id counts.
    """
    columns = EDITABLE[name]
    known = table.select("id", "meeting_id", F.lit(True).alias("_known"))
    told = edits.join(known, ["id", "meeting_id"], "left")
    fields = F.array_intersect("fields", F.array(*[F.lit(c) for c in columns]))
    has = lambda c: F.array_contains("_fields", c)
    told = told.withColumn("_fields", F.coalesce(fields, F.array().cast("array<string>")))
    reason = F.when(F.col("_known").isNull(), "unknown row").when(F.col("delete"), None).when(F.size("_fields") == 0, "nothing to edit")
    reason = reason.when(has("description") & (F.trim(F.coalesce("description", F.lit(""))) == ""), "empty description")
    if "status" in columns:
        told = told.withColumn("status", normal_status(F.col("status")))
        reason = reason.when(has("status") & ~F.coalesce(F.col("status").isin(*CARRY_STATUSES), F.lit(False)), "bad status")
    told = told.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    good = told.where("accepted")
    deleted = good.where("delete").select("id", "meeting_id").distinct()
    last = good.where("not delete").groupBy("id", "meeting_id").agg(F.max_by(F.struct("_fields", *columns), "edit_id").alias("_e"))
    kept = table.join(deleted, ["id", "meeting_id"], "left_anti").join(last, ["id", "meeting_id"], "left")
    new = {c: F.when(F.array_contains("_e._fields", c), F.trim(F.col(f"_e.{c}")) if c == "description" else F.col(f"_e.{c}")).otherwise(F.col(c)) for c in columns}
    return kept.withColumns(new).select(table.columns), told.select("edit_id", "id", "meeting_id", "accepted", "reason")


def edit_transcript(segments: DataFrame, speakers: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with corrected text and speaker, and all edits with accepted and reason.

    edits: edit_id, id, meeting_id, fields (text, speaker_id), text, speaker_id. A text is trimmed and not empty; a speaker
    must be the meeting's, null un-assigns. Of several edits of a segment the last by edit_id counts.
    """
    told = edits.join(segments.select("id", "meeting_id", F.lit(True).alias("_known")), ["id", "meeting_id"], "left")
    own = speakers.select(F.col("id").alias("speaker_id"), "meeting_id", F.lit(True).alias("_own"))
    told = told.join(own, ["speaker_id", "meeting_id"], "left")
    has = lambda c: F.array_contains("fields", c)
    reason = (
        F.when(F.col("_known").isNull(), "unknown row")
        .when(~F.arrays_overlap("fields", F.array(F.lit("text"), F.lit("speaker_id"))), "nothing to edit")
        .when(has("text") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty text")
        .when(has("speaker_id") & F.col("speaker_id").isNotNull() & F.col("_own").isNull(), "unknown speaker")
    )
    told = told.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    last = told.where("accepted").groupBy("id", "meeting_id").agg(F.max_by(F.struct("fields", "text", "speaker_id"), "edit_id").alias("_e"))
    kept = segments.join(last, ["id", "meeting_id"], "left")
    text = F.when(F.array_contains("_e.fields", "text"), F.trim("_e.text")).otherwise(F.col("text"))
    speaker = F.when(F.array_contains("_e.fields", "speaker_id"), F.col("_e.speaker_id")).otherwise(F.col("speaker_id"))
    return kept.withColumns({"text": text, "speaker_id": speaker}).select(segments.columns), told.select("edit_id", "id", "meeting_id", "accepted", "reason")


def rename_speakers(speakers: DataFrame, names: DataFrame) -> DataFrame:
    """Speakers with new display names (meeting_id, id, display_name), trimmed; an empty one becomes null."""
    new = names.select("id", "meeting_id", F.nullif(F.trim("display_name"), F.lit("")).alias("_name"), F.lit(True).alias("_set"))
    told = speakers.join(new, ["id", "meeting_id"], "left")
    return told.withColumn("display_name", F.when(F.col("_set"), F.col("_name")).otherwise(F.col("display_name"))).select(speakers.columns)


def sweep_orphans(meetings: DataFrame) -> DataFrame:
    """T4: meetings that a restart interrupted get a status from which they can be run again; swept tells which."""
    status = F.when(F.col("status").isin(*BUSY), "error: interrupted by server restart").when(F.col("status") == "categorizing", "categorize_failed: interrupted by server restart")
    return meetings.withColumn("_new", status).withColumn("swept", F.col("_new").isNotNull()).withColumn("status", F.coalesce("_new", "status")).drop("_new")
