"""Prompt tables: packing of transcript lines for a model outside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import estimate_tokens, has_risk_cue, normalised, prompt_line, speaker_name
from parley.operators.likeness import like_components
from parley.sources.stage import stored

BUDGET = 4500.0


def lines(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """P6 for every segment: meeting_id, id, start_seconds, line, tokens."""
    names = speakers.select(F.col("id").alias("speaker_id"), "label", "display_name")
    told = segments.join(names, "speaker_id", "left").withColumn("line", prompt_line(F.col("id"), speaker_name(F.col("label"), F.col("display_name")), F.col("text")))
    return told.select("meeting_id", "id", "start_seconds", "text", "line", estimate_tokens(F.col("line")).alias("tokens"))


def chunk_segments(lines_: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Greedy packing of a meeting's lines in time order; a line that doesn't fit the rest of the budget starts a chunk.

    Gives meeting_id, chunk_no (from 1), chunk_text, segment_ids, tokens. The sum starts anew at each chunk, which no window
    function expresses: an aggregate over the meeting's ordered lines (about a thousand) carries it and notes where chunks
    begin.
    """
    items = F.sort_array(F.collect_list(F.struct("start_seconds", "id", "line", "tokens")))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("starts"))
    sizes = F.transform("items", lambda x, k: F.struct(k.alias("k"), x["tokens"].alias("tokens")))

    def step(acc, x):
        new = (acc["used"] + x["tokens"] > budget) | (x["k"] == 0)
        return F.struct(F.when(new, x["tokens"]).otherwise(acc["used"] + x["tokens"]).alias("used"), F.when(new, F.concat(acc["starts"], F.array(x["k"]))).otherwise(acc["starts"]).alias("starts"))

    packed = lines_.groupBy("meeting_id").agg(items.alias("items")).withColumn("starts", F.aggregate(sizes, start, step)["starts"])
    # a chunk is what lies between its start and the next one
    first = F.col("starts")[F.col("_n")]
    after = F.coalesce(F.try_element_at("starts", F.col("_n") + 2), F.size("items"))
    rows = packed.select("meeting_id", "items", "starts", F.posexplode("starts").alias("_n", "_start")).select("meeting_id", (F.col("_n") + 1).alias("chunk_no"), F.slice("items", first + 1, after - first).alias("rows"))
    return rows.select(
        "meeting_id", "chunk_no", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("chunk_text"), F.transform("rows", lambda r: r["id"]).alias("segment_ids"), F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["tokens"]).alias("tokens")
    )


def line_batches(lines_: DataFrame, size: int = 25) -> DataFrame:
    """Numbered batches of lines for translation: batch_no from 0, and '1. line' rows joined by newlines."""
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_seconds", "id")) - 1
    told = lines_.withColumn("_n", n).withColumns({"batch_no": F.floor(F.col("_n") / size), "line_no": F.col("_n") % size + 1})
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("text")).alias("t"))))
    return told.groupBy("meeting_id", "batch_no").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("batch_text"), F.count("*").alias("lines"))


def token_prefix(lines_: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The first lines of a meeting while their tokens fit the budget, at least the first one."""
    order = Window.partitionBy("meeting_id").orderBy("start_seconds", "id")
    told = lines_.withColumns({"_used": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    # the first line that doesn't fit ends the prefix: sums only grow
    return told.where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def recovery_lines(lines_: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Lines for a second look at risks and issues, for meetings in which either is empty.

    Uncited, non-blank lines; if not all of them fit the budget, only those with a risk cue; none if no line has one.
    """
    both = items.where(F.col("category").isin("risks", "issues"))
    full = both.groupBy("meeting_id").agg(F.count_distinct("category").alias("k")).where("k = 2")
    cited = both.select("meeting_id", F.explode("source_segment_ids").alias("id")).distinct()
    open_ = lines_.join(full, "meeting_id", "left_anti").where(F.trim("text") != "").join(cited, ["meeting_id", "id"], "left_anti")
    whole = Window.partitionBy("meeting_id")
    told = open_.withColumns({"_all": F.sum("tokens").over(whole), "_lines": F.count("*").over(whole)})
    fits = (F.col("_all") <= budget) | (F.col("_lines") == 1)
    chosen = told.where(fits | has_risk_cue(F.col("text"))).drop("_all", "_lines")
    return token_prefix(chosen, budget)


def similar_normalised(a: str, b: str) -> bool:
    """R9 for texts that are normalised."""
    short, long_ = sorted((a, b), key=len)
    return bool(short) and (a == b or (len(short) >= 12 and short in long_))


def _fold_copies(rows: DataFrame, group: list[str], columns: list[str], details: list[str]) -> DataFrame:
    """Rows of one text folded by aggregates, however many there are: what `fold_items` says for rows that are all alike."""
    order = F.struct("chunk_no", "item_no")
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    filled = [F.min_by(some(c), F.when(some(c).isNotNull(), order)).alias(f"_{c}") for c in details]
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("chunk_no"), -F.col("item_no")))
    told = rows.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias("_first"), longest.alias("_description"), F.count("*").alias("_rows"), *filled)
    # only texts of several rows need their citations put together
    copied = rows.select(*group, "source_segment_ids").join(rows.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), group)
    cited = copied.select(*group, F.explode("source_segment_ids").alias("_id")).groupBy(*group).agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    told = told.join(cited, group, "left")
    none = F.array().cast("array<long>")
    own = F.coalesce("_first.source_segment_ids", none)
    new = {"description": F.col("_description"), "source_segment_ids": F.when(F.col("_rows") > 1, F.coalesce("_ids", none)).otherwise(own)} | {c: F.coalesce(f"_{c}", f"_first.{c}") for c in details}
    return told.select(*[new.get(c, F.col(f"_first.{c}")).alias(c) for c in columns])


def fold_items(items: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Near-duplicates of a (meeting_id, category) folded in chunk and item order.

    parsed: meeting_id, chunk_no of the chunks whose reply parsed, with items or without (default: those with items).

    The first kept row that is like a new one takes its citations (sorted union), its description if longer (later rows are
    compared with that), and its owner, due, date and mitigation where it has none. Meetings with one parsed chunk stay as they are.

    A kept description is always one of the input, so that rows can only fold within a component of like texts. Components come
    from a join (`like_components`); texts that are like no other fold with their copies by aggregates. Only rows of a component
    of several texts are folded one after the other, a component at a time.
    """
    on, columns = ["meeting_id", "category"], list(items.columns)
    details = [c for c in ("owner", "due", "date", "mitigation") if c in columns]
    chunks = (items if parsed is None else parsed).groupBy("meeting_id").agg(F.count_distinct("chunk_no").alias("_chunks"))
    told = items.join(chunks, "meeting_id", "left").withColumn("_several", F.coalesce("_chunks", F.lit(0)) > 1).drop("_chunks")
    told = stored(told, "told")
    several = told.where("_several").drop("_several").withColumn("_norm", normalised(F.col("description")))
    # texts go by a digest where they only have to be the same; no row carries its text twice through a shuffle
    key = F.unhex(F.sha2("_norm", 256)).alias("_key")
    named = several.where("_norm <> ''").select(*columns, key)
    texts = several.where("_norm <> ''").select(*on, F.col("_norm").alias("_text")).distinct()
    roots = stored(like_components(texts, on).select(*on, F.unhex(F.sha2("_text", 256)).alias("_key"), "_root"), "roots")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in group.sort_values(["chunk_no", "item_no"]).to_dict("records"):
            row["source_segment_ids"] = list(row["source_segment_ids"]) if row["source_segment_ids"] is not None else []
            norm = row["_norm"]
            at = next((k for k, old in enumerate(kept) if similar_normalised(old["_norm"], norm)), None)
            if at is None:
                kept.append(row)
                continue
            old = kept[at]
            old["source_segment_ids"] = sorted({*old["source_segment_ids"], *row["source_segment_ids"]})
            if len(row["description"]) > len(old["description"]):
                old["description"], old["_norm"] = row["description"], norm
            for c in details:
                if (old[c] is None or old[c] == "") and row[c]:
                    old[c] = row[c]
        return pd.DataFrame(kept, columns=group.columns)[columns]

    linked = named.join(roots, [*on, "_key"]).drop("_key").withColumn("_norm", normalised(F.col("description")))
    linked = linked.groupBy(*on, "_root").applyInPandas(fold, items.schema)
    copies = _fold_copies(named.join(roots, [*on, "_key"], "left_anti"), [*on, "_key"], columns, details)
    blank = several.where("_norm = ''").withColumn("source_segment_ids", F.coalesce("source_segment_ids", F.array().cast("array<long>")))
    return linked.unionByName(copies).unionByName(blank.select(columns)).unionByName(told.where("not _several").select(columns))
