"""Schemas, reading and writing of meeting tables, and the check of uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from parley.sources.stage import stored

SCHEMAS = {
    "meetings": "id long, title string, original_filename string, audio_path string, duration_seconds double, language string, languages_detected string, primary_language string, expected_speakers int, status string, progress double, follow_up_of long, carry_forward_status string, summary string, created_at timestamp, updated_at timestamp",
    "speakers": "id long, meeting_id long, label string, display_name string",
    "segments": "id long, meeting_id long, segment_no int, speaker_id long, start_seconds double, end_seconds double, text string, language string",
    "words": "id long, segment_id long, word_no int, start_seconds double, end_seconds double, text string, score double",
    "action_items": "id long, meeting_id long, description string, owner string, due_date string, source_segment_id long",
    "decisions": "id long, meeting_id long, description string, source_segment_id long",
    "deadlines": "id long, meeting_id long, description string, target_date string, source_segment_id long",
    "issues": "id long, meeting_id long, description string, severity string, source_segment_id long",
    "risks": "id long, meeting_id long, description string, mitigation string, source_segment_id long",
    "carry_forward": "id long, meeting_id long, previous_meeting_id long, previous_action_id long, description string, owner string, status string, note string, source_segment_id long",
    "templates": "id long, name string, original_filename string, created_at timestamp",
    "turns": "meeting_id long, turn_no int, start_seconds double, end_seconds double, speaker string",
    "voiceprints": "meeting_id long, row_no int, embedding array<float>",
    "progress_events": "meeting_id long, ts timestamp, stage string, progress double",
}
EXTENSIONS = ("mp4", "mp3", "wav", "m4a", "webm")
LANGUAGES = ("en", "zh", "ms", "auto")
MOST_BYTES = 4 * 1024**3
BUCKETS = 256


def read_tables(spark: SparkSession, path: str, names: list[str] | None = None, fmt: str = "parquet", schemas: dict[str, str] | None = None, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The named tables with fixed schemas: below path as parquet, json or csv (with a header), or as tables of the
    database at the URL path by jdbc (options: driver; numPartitions to read in parallel, by id or else meeting_id, see
    `read_jdbc`).

    schemas: of tables other than the library's own.
    """
    known = SCHEMAS | (schemas or {})
    out = {}
    for n in names or list(known):
        reader = spark.read.options(**(options or {}))
        if fmt == "jdbc":
            fields = StructType.fromDDL(known[n]).fields
            given = dict(options or {})
            parts = int(given.pop("numPartitions", 1))
            column = given.pop("partitionColumn", None) or next((c for c in ("id", "meeting_id") if c in [f.name for f in fields]), None)
            told = read_jdbc(spark, path, n, given, column, parts)
            out[n] = told.select(*[told[f.name].cast(f.dataType).alias(f.name) for f in fields])
        else:
            reader = reader.option("header", "true") if fmt == "csv" else reader
            out[n] = reader.schema(known[n]).format(fmt).load(f"{path}/{n}")
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, column: str | None = None, parts: int = 1) -> DataFrame:
    """A table of a database, in `parts` partitions by a whole-numbered column, each read by a query of its own.

    The column's least and greatest values are asked of the database first, unless options name lowerBound and upperBound; rows
    beyond them and rows of null are still read, by the first and last partitions. An empty table is read in one.
    """
    given = dict(options or {})
    if column is not None and parts > 1:
        if "lowerBound" not in given or "upperBound" not in given:
            ends = spark.read.options(**given).jdbc(url, table).agg(F.min(column).alias("low"), F.max(column).alias("high")).first()  # pushed down
            given |= {} if ends["low"] is None else {"lowerBound": str(ends["low"]), "upperBound": str(ends["high"] + 1)}
        if "lowerBound" in given:
            given |= {"partitionColumn": column, "numPartitions": str(parts)}
    return spark.read.options(**given).jdbc(url, table)


def write_jdbc(tables: dict[str, DataFrame], url: str, options: dict[str, str] | None = None, parts: int = 8) -> None:
    """The tables into a database, each in place of the one there, over at most `parts` connections."""
    for name, df in tables.items():
        df.coalesce(parts).write.mode("overwrite").options(**(options or {})).jdbc(url, name)


def upload_manifest(spark: SparkSession, folder: str, details: DataFrame) -> DataFrame:
    """S2 for files: the manifest of what lies in a folder, for `check_uploads`: filename, bytes, and title, expected_speakers and
    language from details (by filename; null where it says nothing). Of the files only names and lengths are read. Files of zero bytes, which the
    reader passes over, have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    told = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"))
    return told.join(details.select("filename", "title", "expected_speakers", "language"), "filename", "left")


def check_uploads(manifest: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Manifest (filename, bytes, title, expected_speakers, language) with title filled in, accepted and reason.

    The first failing rule gives the reason. A missing title is the file's name without its extension.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    told = manifest.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem))
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    reason = (
        F.when(~extension.isin(*EXTENSIONS), "unsupported file type")
        .when(F.col("bytes") > most_bytes, "file too large")
        .when(~F.length("title").between(1, 255), "bad title")
        .when(F.col("expected_speakers").isNotNull() & ~F.col("expected_speakers").between(1, 20), "bad number of speakers")
        .when(~F.coalesce(F.col("language"), F.lit("auto")).isin(*LANGUAGES), "bad language")
    )
    return told.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """df with the hash bucket of its meeting_id."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)).cast("int"))


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def overwrite_buckets(df: DataFrame, path: str, touched: list[int] | None = None) -> None:
    """Writes df (with bucket) over the buckets that it has, and empties those of `touched` that it hasn't; others stay as they
    are. The rows are staged first, so that df may come from the table that is written."""
    spark = df.sparkSession
    staged = stored(df, "staged")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if touched:
        left = {r["bucket"] for r in staged.select("bucket").distinct().collect()}  # buckets, a bounded number
        for bucket in set(touched) - left:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/bucket={bucket}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def change_buckets(spark: SparkSession, path: str, schema: StructType | str, meetings: DataFrame, change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, more: DataFrame | None = None) -> list[int]:
    """Changes a table that is stored by hash bucket of the meeting: reads the buckets of the given meetings (meeting_id), and
    writes what `change` makes of their rows. Gives the numbers of the buckets touched.

    Only folders of touched buckets are read and written, through a staged copy, so that a change of one meeting costs a bucket
    and a repeated or retried one gives the same. more: further meetings whose buckets count as touched.
    """
    wanted = meetings.select("meeting_id") if more is None else meetings.select("meeting_id").union(more.select("meeting_id"))
    touched = sorted(r["bucket"] for r in with_bucket(wanted, buckets).select("bucket").distinct().collect())  # at most `buckets` numbers
    if touched:
        columns = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        read = spark.read.schema(StructType([*columns, StructField("bucket", IntegerType())])).parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        overwrite_buckets(with_bucket(change(read), buckets), path, touched)
    return touched


def write_minutes(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Minutes rows by a hash bucket of the meeting; only buckets that df has are replaced."""
    spread = with_bucket(df, buckets)
    spread.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_minutes_text(texts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """S4 as text: texts (meeting_id, filename, text) by a hash bucket of the meeting; each text below a line with its file
    name (`output_filename`)."""
    told = with_bucket(texts, buckets).select("bucket", F.concat(F.lit("# "), "filename", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    told.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").text(path)
