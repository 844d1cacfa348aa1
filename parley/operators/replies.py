"""Model replies: choosing, parsing and grounding. A reply that doesn't parse is skipped; an item of a wrong shape is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import normalised, reply_json
from parley.operators.likeness import like_texts

CATEGORIES = {"actionitems": "action_items", "decisions": "decisions", "deadlines": "deadlines", "issues": "issues", "risks": "risks"}
#: The detail fields that each category's items have; others are ignored, whatever they hold.
FIELDS = {"action_items": ("owner", "due"), "decisions": (), "deadlines": ("date",), "issues": (), "risks": ("mitigation",)}
BLANK = " \t\n\r\x0b\x0c"
VERDICTS = ("completed", "in_progress", "blocked", "changed")


def first_parseable(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: the lowest attempt of each (meeting_id, chunk_no) whose text parses (with json), and the chunks that have none."""
    told = replies.withColumn("json", reply_json(F.col("content")))
    order = Window.partitionBy("meeting_id", "chunk_no").orderBy("attempt")
    good = told.where("json is not null").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    none = told.groupBy("meeting_id", "chunk_no").agg(F.count("json").alias("n")).where("n = 0").select("meeting_id", "chunk_no")
    return good, none


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def _whole(v: Column, truncate: bool) -> Column:
    """A JSON value as a whole number, or null: numbers (with truncate cut off, else only whole ones), true and false as 1 and
    0, and texts of digits with a sign (without truncate also with '.0' behind)."""
    kind = F.schema_of_variant(v)
    number, text = F.try_variant_get(v, "$", "double"), _stripped(F.try_variant_get(v, "$", "string"))
    digits = F.when(text.rlike(r"^[+-]?[0-9]+$" if truncate else r"^[+-]?[0-9]+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").try_cast("long"))
    exact = number.try_cast("long") if truncate else F.when(number == F.floor(number), number.try_cast("long"))
    return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long")).when(kind == "STRING", digits).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), exact)


def parse_items(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: rows of parsed replies (meeting_id, chunk_no, json) as items and as chunk summaries (trimmed, '' if missing).

    Object keys are matched whatever their case and punctuation, the last of several that are the same so. Each list item is read
    on its own: its keys in lower case; a single number or text as a list of one citation; numeric texts and whole numbers as
    ids. An item goes if its description is blank or no text, if a field of its category is no text, or if its citations are
    null, a single fraction or anything else that is no list of ids; a missing list is empty. Fields of other categories are
    ignored. item_no is the item's place in its list, from 0. A reply that isn't an object gives nothing.
    """
    objects = parsed.where(F.ltrim("json").startswith("{")).withColumn("_map", F.from_json("json", "map<string,string>"))
    each = objects.select("meeting_id", "chunk_no", F.posexplode("_map").alias("_n", "key", "value")).withColumn("key", F.regexp_replace(F.lower("key"), r"(?U)[^\p{L}\p{N}]", ""))
    each = each.groupBy("meeting_id", "chunk_no", "key").agg(F.max(F.struct("_n", "value"))["value"].alias("value"))
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    lists = each.withColumn("category", F.try_element_at(names, F.col("key"))).where("category is not null").where(F.ltrim("value").startswith("["))
    rows = lists.select("meeting_id", "chunk_no", "category", F.posexplode(F.from_json("value", "array<string>")).alias("item_no", "item")).where(F.ltrim("item").startswith("{"))
    fields = F.posexplode(F.from_json("item", "map<string,variant>")).alias("_n", "field", "v")
    rows = rows.select("meeting_id", "chunk_no", "category", "item_no", fields).withColumn("field", F.lower("field"))
    kind = F.schema_of_variant("v")
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    single, several = kind.isin("BIGINT", "BOOLEAN", "STRING"), kind.startswith("ARRAY")
    ids = F.when(single, F.array(_whole(F.col("v"), False))).when(several, F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: _whole(x, False)))
    # of a key that stands twice the last counts
    told = F.struct("_n", text.alias("text"), kind.alias("kind"), F.when(F.col("field") == "source_segment_ids", ids).alias("ids"))
    last = lambda name: F.max_by(F.when(F.col("field") == name, told), F.when(F.col("field") == name, F.col("_n")))
    texts = ("description", "owner", "due", "date", "mitigation")
    wide = rows.groupBy("meeting_id", "chunk_no", "category", "item_no").agg(*[last(n).alias(n) for n in (*texts, "source_segment_ids")])
    shaped, shown = F.col("description.kind") == "STRING", {}
    for name in texts[1:]:
        own = F.col("category").isin([c for c, with_ in FIELDS.items() if name in with_])
        shaped &= ~own | F.coalesce(F.col(f"{name}.kind").isin("STRING", "VOID"), F.lit(True))
        shown[name] = F.when(own, F.col(f"{name}.text")).alias(name)
    cited = F.when(F.col("source_segment_ids").isNull(), F.array().cast("array<long>")).otherwise(F.col("source_segment_ids.ids")).alias("source_segment_ids")
    items = wide.where(shaped & (_stripped(F.col("description.text")) != "")).select("meeting_id", "chunk_no", "category", "item_no", F.col("description.text").alias("description"), *shown.values(), cited)
    items = items.where(F.col("source_segment_ids").isNotNull() & ~F.exists("source_segment_ids", lambda x: x.isNull()))
    summary = each.where("key = 'chunksummary'").select("meeting_id", "chunk_no", _stripped(F.col("value")).alias("summary"))
    summaries = objects.select("meeting_id", "chunk_no").join(summary, ["meeting_id", "chunk_no"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return items, summaries


def ground(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Only citations of segments that the item's chunk held stay, in order and with repeats; items left with none go."""
    told = items.join(chunks.select("meeting_id", "chunk_no", "segment_ids"), ["meeting_id", "chunk_no"])
    kept = told.withColumn("source_segment_ids", F.filter("source_segment_ids", lambda x: F.array_contains("segment_ids", x)))
    return kept.where(F.size("source_segment_ids") > 0).select(items.columns)


def parse_verdict(replies: DataFrame, excerpts: DataFrame) -> DataFrame:
    """meeting_id, action_id, status, cited, note, source_segment_id of the replies that hold a verdict.

    excerpts: meeting_id, action_id, number (from 1), segment_id. The status is trimmed, in lower case, with '_' for each space;
    citations are cut to whole numbers (texts only of digits), valid ones kept once in order. No valid citation or status: no
    verdict. A note is trimmed; an empty one is null.
    """
    told = replies.withColumn("_v", F.try_parse_json(reply_json(F.col("content")))).where(F.schema_of_variant("_v").startswith("OBJECT"))
    status = F.replace(F.lower(_stripped(F.try_variant_get("_v", "$.status", "string"))), F.lit(" "), F.lit("_"))
    numbers = F.transform(F.try_variant_get("_v", "$.cited", "array<variant>"), lambda x: _whole(x, True).cast("int"))
    told = told.select("meeting_id", "action_id", status.alias("status"), numbers.alias("_cited"), _stripped(F.nullif(F.try_variant_get("_v", "$.note", "string"), F.lit(""))).alias("note"))
    known = excerpts.groupBy("meeting_id", "action_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "segment_id"))).alias("_at"))
    told = told.join(known, ["meeting_id", "action_id"]).withColumn("cited", F.array_distinct(F.filter("_cited", lambda x: x.isNotNull() & F.map_contains_key("_at", x))))
    good = told.where(F.col("status").isin(*VERDICTS) & (F.size("cited") > 0))
    return good.select("meeting_id", "action_id", "status", "cited", "note", F.try_element_at("_at", F.try_element_at("cited", F.lit(1))).alias("source_segment_id"))


def merge_translations(lines: DataFrame, replies: DataFrame) -> DataFrame:
    """Lines (meeting_id, batch_no, line_no, text) with the reply's {"lines": [{"i": 1, "en": "…"}]} put in.

    A valid number within the batch and a text that isn't empty replace the line; of several the last; all others stay.
    """
    entry = F.from_json(reply_json(F.col("content")), "lines array<struct<i:int,en:string>>")
    told = replies.select("meeting_id", "batch_no", F.posexplode(entry["lines"]).alias("_n", "_x")).select("meeting_id", "batch_no", "_n", F.col("_x.i").alias("line_no"), F.trim("_x.en").alias("_en"))
    last = told.where("_en <> ''").groupBy("meeting_id", "batch_no", "line_no").agg(F.max_by("_en", "_n").alias("_en"))
    return lines.join(last, ["meeting_id", "batch_no", "line_no"], "left").withColumn("text", F.coalesce("_en", "text")).drop("_en")


def recovery_merge(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Recovered items that are like no existing one of their meeting and category."""
    on = ["meeting_id", "category"]
    key = lambda text: F.unhex(F.sha2(text, 256)).alias("_key")  # noqa: E731  texts that only have to be the same go by a digest
    told = like_texts(new, existing, on).select(*on, key("_left")).distinct()
    return new.select("*", key(normalised(F.col("description")))).join(told, [*on, "_key"], "left_anti").select(new.columns)


def first_citation(ids: Column) -> Column:
    """The first id, or null."""
    return F.try_element_at(ids, F.lit(1))
