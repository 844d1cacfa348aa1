"""K3 over a stored index: postings of three-character pieces, so that a search reads what its terms need and not every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.reads import first_hits, search, segment_index, wanted_terms
from parley.sources.stage import stored

#: Characters of a piece, folders of texts and of postings, and the least tasks that write one folder of postings.
PIECE, BLOCKS, PARTS, SALT = 3, 256, 256, 8
#: Characters of texts, and postings (there are no more than characters), that one salt of a folder holds about.
TEXT_A_TASK, POSTINGS_A_TASK = 8_000_000, 500_000
TEXTS = "meeting_id long, id long, ordinal int, start_seconds double, text string, block int"
POSTINGS = "meeting_id long, id long, piece string, part int"
COUNTS = "piece string, n long, part int"


def _pieces(low: Column) -> Column:
    """The distinct pieces of PIECE characters of a text in lower case; in time linear in its length."""
    starts = F.sequence(F.lit(0), F.length(low) - PIECE)
    # an array of one binds the split text, so that it isn't split again for each piece
    pieces = F.flatten(F.transform(F.array(F.split(low, "")), lambda x: F.transform(starts, lambda k: F.concat(*[F.get(x, k + j) for j in range(PIECE)]))))
    return F.when(F.length(low) >= PIECE, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _part(piece: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(parts)).cast("int")


def _block(meeting: Column, row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(meeting, row), F.lit(blocks)).cast("int")


def write_search_index(segments: DataFrame, path: str, blocks: int = BLOCKS, parts: int = PARTS) -> None:
    """Writes texts (segments with ordinal, by block), postings (piece, meeting_id, id, by part) and counts (piece, n) below path.

    A folder is written by as many tasks as its share of all characters asks for, postings by SALT at least, so that what a task
    sorts doesn't grow with the input. Null and short texts have no pieces; the scan finds them. The numbers of folders are kept
    in the index, so that a search knows them.
    """
    chars = segments.agg(F.sum(F.length("text"))).first()[0] or 0
    salts = lambda folders, most: -(-chars // (folders * most))
    by_text, by_posting = max(1, salts(blocks, TEXT_A_TASK)), max(SALT, salts(parts, POSTINGS_A_TASK))
    lines = segment_index(segments).select(F.col("meeting_id").cast("long"), F.col("id").cast("long"), "ordinal", F.col("start_seconds").cast("double"), "text")
    # the salt is a hash of the row, so that a repeated task writes the same
    lines = lines.withColumns({"block": _block(F.col("meeting_id"), F.col("id"), blocks), "_salt": F.pmod(F.xxhash64("id"), F.lit(by_text))})
    lines.repartition(blocks * by_text, "block", "_salt").drop("_salt").write.mode("overwrite").partitionBy("block").parquet(f"{path}/texts")
    spark = segments.sparkSession
    told = spark.read.schema(TEXTS).parquet(f"{path}/texts").select("meeting_id", "id", F.explode(_pieces(F.lower("text"))).alias("piece"))
    told = told.withColumns({"part": _part(F.col("piece"), parts), "_salt": F.pmod(F.xxhash64("id"), F.lit(by_posting))})
    told.repartition(parts * by_posting, "part", "_salt").sortWithinPartitions("part", "piece").drop("_salt").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("part", "piece").agg(F.count("*").alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "piece").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")
    spark.createDataFrame([(blocks, parts)], "blocks int, parts int").write.mode("overwrite").parquet(f"{path}/folders")


def search_stored(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """K3 as `reads.search`, the same rows, from an index that `write_search_index` wrote.

    A term's postings are those of its rarest piece; only the folders of such pieces, and of the texts that they name, are
    read. What is found is held against the whole term. Terms shorter than PIECE characters are searched by a scan.
    """
    folders = spark.read.parquet(f"{path}/folders").first()
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    wanted = wanted_terms(terms)
    # the scan takes ordinals anew, from the same rows
    short = search(texts.drop("ordinal", "block"), wanted.where(F.length("term") < PIECE))
    asked = stored(wanted.where(F.length("term") >= PIECE).select("term", F.explode(_pieces(F.lower("term"))).alias("piece")).withColumn("part", _part(F.col("piece"), folders["parts"])), "asked")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts").where(F.col("part").isin(_numbers(asked, "part")))
    # a term with a piece that no text has isn't anywhere
    size = F.count("*").over(Window.partitionBy("term"))
    met = asked.withColumn("_pieces", size).join(counts, ["part", "piece"])
    rare = met.groupBy("term").agg(F.count("*").alias("_met"), F.first("_pieces").alias("_pieces"), F.min_by(F.struct("part", "piece"), F.struct("n", "piece")).alias("rarest")).where("_met = _pieces").select("term", "rarest.*")
    rare = stored(rare, "rarest")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("part").isin(_numbers(rare, "part")))
    named = postings.join(rare, ["part", "piece"]).select("term", "meeting_id", "id").withColumn("block", _block(F.col("meeting_id"), F.col("id"), folders["blocks"]))
    named = stored(named, "named")
    hits = texts.where(F.col("block").isin(_numbers(named, "block"))).join(named, ["block", "meeting_id", "id"])
    return first_hits(hits.where(F.lower("text").contains(F.lower(F.col("term"))))).unionByName(short)


def _numbers(df: DataFrame, column: str) -> list[int]:
    """The different folder numbers of a column: no more than there are folders."""
    return sorted(r[column] for r in df.select(column).distinct().collect())
