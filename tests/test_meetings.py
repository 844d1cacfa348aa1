"""Operators on literal tables, and against short plain loops on random groups."""

import datetime
import difflib
import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parley.functions.text import normalised
from parley.operators import changes, followup, graphs, headings, insights, intervals, language, prompts, reads, replies, report, search_index, speakers
from parley.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- corrections of carried items


@pytest.fixture(scope="module")
def carried(spark):
    return spark.createDataFrame(
        [(200, 2, 1, 10, "Ship the installer", "Wei", "in_progress", "still going", 100), (201, 2, 1, None, "Write the README", None, "not_discussed", None, None)], tables.SCHEMAS["carry_forward"]
    )


def edit(spark, *edits):
    schema = "edit_id long, id long, meeting_id long, fields array<string>, description string, owner string, status string, note string, `delete` boolean"
    out = []
    for k, (i, m, change) in enumerate(edits):
        out.append((k, i, m, [f for f in change if f != "delete"], change.get("description"), change.get("owner"), change.get("status"), change.get("note"), "delete" in change))
    return spark.createDataFrame(out, schema)


def test_accepted_corrections(spark, carried):
    edits = edit(spark, (200, 2, {"status": "completed"}), (201, 2, {"status": "In Progress"}))
    after, told = changes.apply_edits(carried, "carry_forward", edits)
    assert rows(after, "id", "status", "source_segment_id", "description") == [(200, "completed", 100, "Ship the installer"), (201, "in_progress", None, "Write the README")]
    assert rows(told, "edit_id", "accepted") == [(0, True), (1, True)]
    after, _ = changes.apply_edits(carried, "carry_forward", edit(spark, (200, 2, {"description": " Ship it ", "note": "done"})))
    assert rows(after.where("id = 200"), "description", "note", "status", "source_segment_id") == [("Ship it", "done", "in_progress", 100)]


def test_rejected_corrections(spark, carried):
    edits = edit(spark, (200, 2, {"status": "finished"}), (200, 2, {"description": "   "}), (200, 2, {}), (200, 2, {"source_segment_id": 1}), (999, 2, {"note": "x"}), (200, 1, {"note": "x"}))
    after, told = changes.apply_edits(carried, "carry_forward", edits)
    assert [r["reason"] for r in told.orderBy("edit_id").collect()] == ["bad status", "empty description", "nothing to edit", "nothing to edit", "unknown row", "unknown row"]
    assert rows(after, *carried.columns) == rows(carried, *carried.columns)


def test_deletions(spark, carried):
    after, told = changes.apply_edits(carried, "carry_forward", edit(spark, (201, 2, {"delete": 1}), (200, 1, {"delete": 1})))
    assert rows(after, "id") == [(200,)] and rows(told, "edit_id", "accepted") == [(0, True), (1, False)]
    _, again = changes.apply_edits(after, "carry_forward", edit(spark, (201, 2, {"delete": 1})))
    assert again.first()["reason"] == "unknown row"


# --- languages


@pytest.mark.parametrize(
    "votes, dominant, total, kept",
    [
        ({"ms": 2, "zh": 2}, "en", 34, {"zh"}),
        ({"ms": 8, "zh": 5}, "en", 45, {"ms", "zh"}),
        ({"ms": 8, "zh": 4}, "en", 41, {"ms", "zh"}),
        ({"ms": 2}, "en", 34, set()),
        ({"ms": 3}, "en", 34, set()),
        ({"ms": 4}, "en", 34, {"ms"}),
        ({"ms": 2}, "en", 10, set()),
        ({"zh": 1}, "en", 100, {"zh"}),
        ({"en": 2}, "ms", 34, set()),
        ({"en": 1}, "zh", 40, {"en"}),
        ({"ms": 1}, "en", 0, {"ms"}),
    ],
)
def test_corroboration(spark, votes, dominant, total, kept):
    told = language.corroborated_languages(spark.createDataFrame([(1, k, n) for k, n in votes.items()], "meeting_id long, lang string, n long"), spark.createDataFrame([(1, dominant, total)], "meeting_id long, dominant string, total long"))
    assert {r["lang"] for r in told.collect()} == kept


def test_dominant_language(spark):
    d = spark.createDataFrame([(1, "zh", 0.9, 5.0), (1, "en", None, 5.0), (1, "fr", 0.9, 5.0), (2, "id", 0.3, 1.0), (3, "en", 0.1, 1.0)], "meeting_id long, lang string, prob double, seconds double")
    assert rows(language.dominant_language(language.window_votes(d), d), "meeting_id", "dominant", "is_mixed") == [(1, "en", True), (2, "ms", False), (3, "en", False)]
    s = spark.createDataFrame([(1, "en", "hello 会议"), (1, "id", "apa"), (2, None, "x")], "meeting_id long, language string, text string")
    assert rows(language.languages_in_segments(s), "meeting_id", "languages") == [(1, ["en", "ms", "zh"]), (2, [])]


# --- intervals and speakers


def test_overlap_join_is_whole_and_single(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randint(0, 2), k, s := rng.randint(0, 200) * 1_000_000, s + rng.randint(0, 90) * 1_000_000) for k in range(n)]
    a, b = make(80), make(80)
    left = spark.createDataFrame(a, "meeting_id long, a long, start_us long, end_us long")
    right = spark.createDataFrame(b, "meeting_id long, b long, start_us long, end_us long")
    expected = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    for size in (1, 7, 30, 1000):
        assert rows(intervals.overlap_join(left, right, ["meeting_id"], size), "a", "b", "overlap_us") == sorted(expected, key=repr)


def test_overlaps_of_all_lengths(spark):
    """Lengths from a microsecond to a thousand years on both sides, at exact powers of the bins too."""
    rng = random.Random(8)
    year = 365 * 86_400_000_000
    make = lambda n: [(rng.randint(0, 1), k, s := rng.choice([0, rng.randint(-year, year), 240_000_000 * rng.randint(0, 9)]), s + rng.choice([1, 30_000_000, 240_000_000, rng.randint(1, 10 ** rng.randint(1, 13)), 1000 * year])) for k in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "meeting_id long, a long, start_us long, end_us long")
    right = spark.createDataFrame(b, "meeting_id long, b long, start_us long, end_us long")
    expected = [(x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])]
    assert rows(intervals.overlap_join(left, right, ["meeting_id"]), "a", "b", "overlap_us") == sorted(expected, key=repr)


def test_a_thousand_years_make_a_handful_of_rows(spark):
    long_ = spark.createDataFrame([(1, 1, 0, 1000 * 365 * 86_400_000_000)], "meeting_id long, a long, start_us long, end_us long")
    others = spark.createDataFrame([(1, k, k * 1_000_000, k * 1_000_000 + 5) for k in range(20)], "meeting_id long, b long, start_us long, end_us long")
    size = 30_000_000
    placed = intervals._placed(long_, "start_us", "end_us", intervals._levels(others, "start_us", "end_us", size), size, 0)
    assert placed.count() <= 2 * (1 + intervals.PARTS)
    assert intervals._placed(others, "start_us", "end_us", intervals._levels(others, "start_us", "end_us", size), size, 0).count() == 20
    assert intervals.overlap_join(others.withColumnRenamed("b", "a"), long_.withColumnRenamed("a", "b"), ["meeting_id"]).count() == 20
    none = others.where("false")
    assert intervals.overlap_join(none.withColumnRenamed("b", "a"), long_.withColumnRenamed("a", "b"), ["meeting_id"]).count() == 0


def test_segment_speaker_ratio_and_ties(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 1, 10.0, 20.0), (3, 1, 20.0, 30.0)], "id long, meeting_id long, start_seconds double, end_seconds double")
    t = spark.createDataFrame([(1, 1, 0.0, 2.0, "B"), (1, 2, 2.0, 4.0, "A"), (1, 3, 10.0, 12.9, "A"), (1, 4, 21.0, 24.0, "A")], "meeting_id long, turn_no int, start_seconds double, end_seconds double, speaker string")
    assert rows(intervals.segment_speaker(s, t), "id", "speaker") == [(1, "B"), (2, None), (3, "A")]
    assert rows(intervals.word_speaker(s, t), "id", "speaker") == [(1, "B"), (2, "A"), (3, "A")]


def told_words(spark, seed):
    """Words of segments, some without one, some with a wrong time or none, and turns of four speakers with ties among them."""
    rng = random.Random(seed)
    words, turns = [], []
    for k in range(400):
        meeting, at = rng.randint(1, 3), rng.randint(0, 600) / 2
        segment = None if rng.random() < 0.05 else int(at // 40)
        end = at + rng.choice([0, 0.5, 1, 3, 3, 5]) if rng.random() < 0.98 else at + 1e7
        words.append((k, meeting, segment, k, None if rng.random() < 0.02 else at, end, f"w{k}"))
    for k in range(240):
        at = rng.randint(0, 600) / 2
        turns.append((rng.randint(1, 3), k, at, at + rng.choice([-1, 0, 1, 2, 4, 30]), rng.choice(["A", "B", "C", "D", None])))
    return (
        spark.createDataFrame(words, "id long, meeting_id long, segment_id long, word_no int, start_seconds double, end_seconds double, text string"),
        spark.createDataFrame(turns, "meeting_id long, turn_no int, start_seconds double, end_seconds double, speaker string"),
    )


@pytest.mark.parametrize("most", [1, 20, 256])
def test_words_by_segments_and_by_time_agree(spark, monkeypatch, most):
    monkeypatch.setattr(intervals, "MOST_TURNS", most)
    words, turns = told_words(spark, most)
    got, expected = intervals.word_speaker(words, turns), intervals._speaker_by_overlap(words, turns, None, 30)
    columns = [*words.columns, "speaker"]
    assert rows(got, *columns) == rows(expected, *columns) and got.columns == columns
    assert len({r["speaker"] for r in got.collect()}) == 5
    assert rows(intervals.word_speaker(words, turns.limit(0)), "id", "speaker") == sorted(((k, None) for k in range(400)), key=repr)


def word_shuffles(spark, plan_of):
    """How often the words of a query's plan go from task to task, where no side is sent whole."""
    words, turns = told_words(spark, 3)
    words = words.where("segment_id is not null and end_seconds < 1e6")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(plan_of(words, turns)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return sum("word_no#" in x or "first_word#" in x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan))


def test_words_are_shuffled_once_for_speakers_and_runs(spark):
    assert word_shuffles(spark, lambda w, t: speakers.fill_word_speakers(intervals.word_speaker(w, t))) == 1
    assert word_shuffles(spark, lambda w, t: speakers.speaker_runs(speakers.fill_word_speakers(intervals.word_speaker(w, t)))) == 1


def test_words_are_shuffled_once_for_smoothed_runs(spark):
    filled = lambda w, t: speakers.fill_word_speakers(intervals.word_speaker(w, t))
    assert word_shuffles(spark, lambda w, t: speakers.smooth_runs(speakers.speaker_runs(filled(w, t)))) == 1


def test_words_are_shuffled_once_to_split_segments(spark):
    segments = spark.createDataFrame([(k, m, 40.0 * k, 40.0 * k + 40, f"s{k}", "en") for k in range(8) for m in (1, 2, 3)], "id long, meeting_id long, start_seconds double, end_seconds double, text string, language string")
    assert word_shuffles(spark, lambda w, t: speakers.split_by_speaker(segments, w, t)) == 1


def test_words_in_buckets_equal_a_cursor(spark, monkeypatch):
    rng = random.Random(7)
    segments, words, expected = [], [], []
    for m in range(40):
        ends = [rng.randint(0, 40) / 2 for _ in range(rng.randint(1, 6))]
        mine = [(m * 100 + k, m, k, 0.0, e) for k, e in enumerate(ends)]
        said = sorted((s := rng.randint(0, 40) / 2, s + rng.randint(0, 8) / 2) for _ in range(rng.randint(0, 12)))
        at = 0
        for k, (a, b) in enumerate(said):
            while at < len(ends) and ends[at] <= (a + b) / 2:
                at += 1
            words.append((m, k, a, b))
            expected.append((m, k, m * 100 + min(at, len(ends) - 1)))
        segments += mine
    s = spark.createDataFrame(segments, "id long, meeting_id long, segment_no int, start_seconds double, end_seconds double")
    w = spark.createDataFrame(words, "meeting_id long, word_no int, start_seconds double, end_seconds double")
    for block, segments_ in ((3600, 1024), (2, 2), (7, 1)):
        monkeypatch.setattr(intervals, "BLOCK_SEGMENTS", segments_)
        assert rows(intervals.bucket_words(w, s, block), "meeting_id", "word_no", "bucket_id") == sorted(expected, key=repr)
    silent = intervals.bucket_words(w, s.where("meeting_id > 3"), 2)
    assert silent.count() == len(words) and silent.where("meeting_id <= 3 and bucket_id is not null").count() == 0


def test_blocks_split_a_meeting(spark):
    """No block of a long meeting holds it, even behind a word that claims to end in a thousand years."""
    words = spark.range(4000).select(F.lit(1).cast("long").alias("meeting_id"), F.col("id").cast("int").alias("word_no"), (F.col("id") * 10.0).alias("start_seconds"), F.when(F.col("id") == 5, 3.2e10).otherwise(F.col("id") * 10.0 + 4).alias("end_seconds"))
    segments = spark.range(400).select("id", F.lit(1).cast("long").alias("meeting_id"), F.col("id").cast("int").alias("segment_no"), (F.col("id") * 100.0).alias("start_seconds"), ((F.col("id") + 1) * 100.0).alias("end_seconds"))
    told = {r["word_no"]: r["bucket_id"] for r in intervals.bucket_words(words, segments).collect()}
    assert told == {k: 0 if k < 5 else 399 for k in range(4000)}
    plan = intervals.bucket_words(words, segments)._jdf.queryExecution().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan  # reckons the rest of a block anew for each word
    told = intervals.bucket_words(words.where("word_no <> 5"), segments)
    assert told.where("bucket_id <> cast(word_no / 10 as int)").count() == 0
    assert "hashpartitioning(meeting_id#" in (plan := told._jdf.queryExecution().toString()) and "_block" in plan
    times = words.select("meeting_id", F.col("word_no").alias("time_id"), (F.col("start_seconds") - 30).alias("seconds"))
    for block in (50, 3600):
        got = {r["time_id"]: r["ordinal"] for r in intervals.segment_at(segments, times, block).collect()}
        assert got == {k: max(0, int((k * 10 - 30 + 0.05) // 100)) for k in range(4000)}


def test_phantoms(spark):
    turns = spark.createDataFrame([(1, 1, 0.0, 9.0, "A"), (1, 2, 9.0, 20.0, "B"), (1, 3, 20.0, 21.0, "C"), (2, 1, 0.0, 1.0, "A")], "meeting_id long, turn_no int, start_seconds double, end_seconds double, speaker string")
    prints = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.2, 0.9]), (2, 0, [1.0, 1.0])], "meeting_id long, row_no int, embedding array<float>")
    labelled = speakers.voiceprint_labels(prints, turns)
    merged = speakers.merge_phantoms(turns, labelled, 3.0)
    assert rows(merged, "meeting_id", "turn_no", "speaker") == [(1, 1, "A"), (1, 2, "B"), (1, 3, "B"), (2, 1, "A")]
    fixed = spark.createDataFrame([(1,)], "meeting_id long")
    assert rows(speakers.merge_phantoms(turns, labelled, 3.0, fixed), "turn_no", "speaker") == [(1, "A"), (1, "A"), (2, "B"), (3, "C")]
    odd = prints.union(spark.createDataFrame([(2, 1, [1.0, 1.0])], prints.schema))
    assert rows(speakers.voiceprint_labels(odd, turns), "meeting_id", "speaker") == [(1, "A"), (1, "B"), (1, "C")]


def plain_smooth(runs):
    """Runs of (speaker, [(start, end), …]), as the rule is told."""
    for _ in range(len(runs)):
        merged = False
        if len(runs) <= 1:
            break
        for i in range(len(runs)):
            words = runs[i][1]
            if len(words) <= 2 and words[-1][1] - words[0][0] < 0.8:
                before = runs[i - 1] if i else None
                after = runs[i + 1] if i + 1 < len(runs) else None
                if before and (not after or len(before[1]) >= len(after[1])):
                    runs[i] = (before[0], words)
                else:
                    runs[i] = (after[0], words)
                merged = True
        if not merged:
            break
        joined = []
        for speaker, words in runs:
            if joined and joined[-1][0] == speaker:
                joined[-1] = (speaker, joined[-1][1] + words)
            else:
                joined.append((speaker, words))
        runs = joined
    return runs


def test_smoothing_equals_a_loop(spark):
    rng = random.Random(11)
    given, expected = [], {}
    for segment in range(300):
        at, runs, last = 0.0, [], object()
        for number in range(rng.randint(1, 9)):
            who = rng.choice([x for x in ("A", "B", "C", None) if x != last])
            words = []
            for _ in range(rng.randint(1, 4)):
                words.append((at, at + 0.3))
                at += 0.3
            runs.append((who, words))
            given.append((1, segment, number + 1, who, len(words), words[0][0], words[-1][1], f"row {number}"))
            last = who
        expected[segment] = [(s, len(w)) for s, w in plain_smooth(list(runs))]
    df = spark.createDataFrame(given, "meeting_id long, segment_id long, run_no long, speaker string, words long, start_seconds double, end_seconds double, extra string")
    told = speakers.smooth_runs(df)
    assert not re.search("Pandas|Python", told._jdf.queryExecution().toString()) and told.columns == [*df.columns, "smooth_no"]
    got = defaultdict(lambda: defaultdict(lambda: [set(), 0]))
    for r in told.collect():
        part = got[r["segment_id"]][r["smooth_no"]]
        part[0].add(r["speaker"])
        part[1] += r["words"]
    assert {s: [(next(iter(p[0])), p[1]) for _, p in sorted(parts.items())] for s, parts in got.items()} == expected
    assert all(len(p[0]) == 1 for parts in got.values() for p in parts.values())
    assert rows(told, "segment_id", "run_no", "extra") == rows(df, "segment_id", "run_no", "extra")


def test_split_by_speaker(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 10.0, "One two three four.", "en"), (2, 1, 10.0, 20.0, "Alone!", "en"), (3, 1, 20.0, 30.0, "No words", "en"), (4, 1, 40.0, 50.0, "Silence", "en")], "id long, meeting_id long, start_seconds double, end_seconds double, text string, language string")
    w = [(10 + k, 1, 1, k, 2.5 * k, 2.5 * k + 2, t) for k, t in enumerate(["One", "two", "three", "four."])] + [(20, 1, 2, 9, 11.0, 12.0, "Alone")] + [(21, 1, 4, 11, 41.0, 42.0, "Silence")]
    words = spark.createDataFrame(w, "id long, meeting_id long, segment_id long, word_no int, start_seconds double, end_seconds double, text string")
    turns = spark.createDataFrame([(1, 1, 0.0, 5.0, "A"), (1, 2, 5.0, 10.0, "B"), (1, 3, 10.0, 30.0, "C")], "meeting_id long, turn_no int, start_seconds double, end_seconds double, speaker string")
    got = speakers.split_by_speaker(s, words, turns)
    assert rows(got, "id", "part_no", "text", "speaker") == [(1, 1, "One two", "A"), (1, 2, "three four.", "B"), (2, 1, "Alone!", "C"), (3, 1, "No words", "C"), (4, 1, "Silence", None)]


# --- prompts, replies and insights


def test_packing_equals_a_loop(spark):
    rng = random.Random(5)
    lines, expected = [], defaultdict(list)
    for m in range(20):
        used, chunk = 0.0, []
        for k in range(rng.randint(1, 15)):
            tokens = rng.randint(1, 60) / 4
            lines.append((m, m * 100 + k, float(k), "t", f"line {k}", tokens))
            if chunk and used + tokens > 20:
                expected[m].append(chunk)
                used, chunk = 0.0, []
            chunk.append(m * 100 + k)
            used += tokens
        expected[m].append(chunk)
    df = spark.createDataFrame(lines, "meeting_id long, id long, start_seconds double, text string, line string, tokens double")
    got = rows(prompts.chunk_segments(df, 20.0), "meeting_id", "chunk_no", "segment_ids")
    assert got == sorted(((m, k + 1, ids) for m, chunks in expected.items() for k, ids in enumerate(chunks)), key=repr)


def test_folding(spark):
    schema = "meeting_id long, chunk_no int, category string, item_no int, description string, owner string, due string, source_segment_ids array<long>"
    items = spark.createDataFrame(
        [
            (1, 1, "a", 0, "Send the report", None, None, [5, 3]),
            (1, 2, "a", 0, "send the report to Wei!", "Ann", None, [4]),
            (1, 2, "a", 1, "Send the report to Wei by Friday", "Bob", "Friday", [3]),
            (1, 2, "a", 2, "Short", None, None, [9]),
            (1, 2, "b", 0, "Send the report", None, None, [8]),
            (2, 1, "a", 0, "Same thing here", None, None, [1]),
            (2, 1, "a", 1, "Same thing here", None, None, [2]),
        ],
        schema,
    )
    got = rows(prompts.fold_items(items), "meeting_id", "category", "description", "owner", "due", "source_segment_ids")
    assert got == sorted(
        [
            (1, "a", "Send the report to Wei by Friday", "Ann", "Friday", [3, 4, 5]),
            (1, "a", "Short", None, None, [9]),
            (1, "b", "Send the report", None, None, [8]),
            (2, "a", "Same thing here", None, None, [1]),
            (2, "a", "Same thing here", None, None, [2]),
        ],
        key=repr,
    )


def plain_fold(rows_):
    """The rule row by row: rows are dicts with chunk_no, item_no, description, owner, source_segment_ids and norm."""
    kept = []
    for row in sorted(rows_, key=lambda r: (r["chunk_no"], r["item_no"])):
        row = dict(row, source_segment_ids=list(row["source_segment_ids"] or []))
        like = lambda a, b: a == b or (min(len(a), len(b)) >= 12 and (a in b or b in a))
        old = next((o for o in kept if row["norm"] and o["norm"] and like(o["norm"], row["norm"])), None)
        if old is None:
            kept.append(row)
            continue
        old["source_segment_ids"] = sorted({*old["source_segment_ids"], *row["source_segment_ids"]})
        if len(row["description"]) > len(old["description"]):
            old["description"], old["norm"] = row["description"], row["norm"]
        old["owner"] = old["owner"] or row["owner"]
    return kept


def test_folding_equals_a_loop_on_random_groups(spark):
    rng = random.Random(21)
    base = "send the report to the whole team and call the client before noon tomorrow"
    schema = "meeting_id long, chunk_no int, category string, item_no int, description string, owner string, source_segment_ids array<long>, extra string"
    made = []
    for m in range(12):
        for k in range(40):
            a = rng.randint(0, 30)
            text = rng.choice([base[a : a + rng.randint(8, 44)], base[a:].upper() + "!", "Copy of one line", " ", None, "short", f"alone {k} among all others"])
            made.append((m, rng.randint(1, 3), rng.choice("ab"), k, text, rng.choice([None, "", "Wei"]), rng.choice([None, [rng.randint(0, 9), rng.randint(0, 9)]]), "x"))
    made += [(99, k % 2, "a", k, "The very same line " + "." * (k % 3), "Ann" if k == 30 else None, [k]) + ("x",) for k in range(400)]
    items = spark.createDataFrame(made, schema)
    norm = {r["description"]: r["n"] for r in items.select("description", normalised(F.col("description")).alias("n")).distinct().collect()}
    groups = defaultdict(list)
    for m, c, g, k, text, owner, ids, _ in made:
        groups[m, g].append({"chunk_no": c, "item_no": k, "description": text, "owner": owner, "source_segment_ids": ids, "norm": norm[text]})
    expected = [(m, g, r["item_no"], r["description"], r["owner"] or "", r["source_segment_ids"]) for (m, g), mine in groups.items() for r in plain_fold(mine)]
    got = [(m, g, k, t, o or "", i) for m, g, k, t, o, i in rows(prompts.fold_items(items), "meeting_id", "category", "item_no", "description", "owner", "source_segment_ids")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(80)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for x in root}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_replies(spark):
    content = [
        (1, 1, 1, "no json"),
        (1, 1, 2, 'Here: {"Action Items": [{"Description": "do", "owner": "null", "source_segment_ids": "12"}, {"description": "x", "source_segment_ids": ["seg 12"]}, {"description": 5}, {"description": " "}, {"description": "y", "source_segment_ids": [12.0, 7]}, "odd"], "chunk_summary": "s"}'),
        (1, 2, 1, "[1]"),
        (1, 3, 1, "{bad"),
    ]
    good, none = replies.first_parseable(spark.createDataFrame(content, "meeting_id long, chunk_no int, attempt int, content string"))
    assert rows(good, "chunk_no", "attempt") == [(1, 2), (2, 1)] and rows(none, "chunk_no") == [(3,)]
    items, summaries = replies.parse_items(good)
    assert rows(items, "item_no", "description", "owner", "source_segment_ids") == [(0, "do", "null", [12]), (4, "y", None, [12, 7])]
    assert rows(summaries, "chunk_no", "summary") == [(1, "s")]
    chunks = spark.createDataFrame([(1, 1, [7])], "meeting_id long, chunk_no int, segment_ids array<long>")
    assert rows(replies.ground(items, chunks), "description", "source_segment_ids") == [("y", [7])]


def test_odd_items_of_replies(spark):
    told = [
        ({"description": "a", "source_segment_ids": 12.0}, None),  # a single fraction isn't made a list
        ({"description": "b", "source_segment_ids": None}, None),
        ({"description": "c"}, []),
        ({"description": "d", "source_segment_ids": [12.0, "7", True]}, [12, 7, 1]),
        ({"description": "e", "source_segment_ids": [1.5]}, None),
        ({"description": "f", "source_segment_ids": {"id": 1}}, None),
        ({"description": "g", "source_segment_ids": " 8 ", "owner": 5, "mitigation": ["x"]}, [8]),  # no fields of a decision
        ({"description": ' say "it" \\ now\n', "source_segment_ids": []}, []),
        ({"DESCRIPTION": "h", "Source_Segment_Ids": 3}, [3]),
    ]
    body = '{"Decisions": [{"description": "lost"}], "chunk-summary": " told\\t", "decisions ": ' + json.dumps([i for i, _ in told]) + "}"
    good, _ = replies.first_parseable(spark.createDataFrame([(1, 1, 1, body)], "meeting_id long, chunk_no int, attempt int, content string"))
    items, summaries = replies.parse_items(good)
    expected = [(k, next(iter(i.values())), ids) for k, (i, ids) in enumerate(told) if ids is not None]
    assert rows(items, "item_no", "description", "source_segment_ids") == expected and items.where("owner is not null or mitigation is not null").count() == 0
    assert rows(summaries, "summary") == [("told",)]
    twice = '{"risks": [{"description": "x", "Description": "y", "mitigation": "m", "source_segment_ids": [1]}, {"description": "z", "mitigation": 4}]}'
    good, _ = replies.first_parseable(spark.createDataFrame([(1, 1, 1, twice)], "meeting_id long, chunk_no int, attempt int, content string"))
    assert rows(replies.parse_items(good)[0], "description", "mitigation") == [("y", "m")]


@pytest.mark.parametrize(
    "content, expected",
    [
        ('{"status": " Completed", "cited": [1]}', ("completed", [1], None)),
        ('{"status": "in progress", "cited": [2, 1], "note": " so "}', ("in_progress", [2, 1], "so")),
        ('{"status": "in-progress", "cited": [1]}', None),
        ('{"status": "in  progress", "cited": [1]}', None),
        ('{"status": "blocked", "cited": [1.0, 2.7, "2"]}', ("blocked", [1, 2], None)),
        ('{"status": "blocked", "cited": [true, null, "1.5", [1], {}]}', ("blocked", [1], None)),
        ('{"status": "changed", "cited": "1"}', None),
        ('{"status": "changed", "cited": [9, "x"]}', None),
        ('{"status": "not_discussed", "cited": [1]}', None),
        ('["completed"]', None),
    ],
)
def test_verdicts(spark, content, expected):
    told = spark.createDataFrame([(1, 5, content)], "meeting_id long, action_id long, content string")
    excerpts = spark.createDataFrame([(1, 5, 1, 100), (1, 5, 2, 200)], "meeting_id long, action_id long, number int, segment_id long")
    got = [(r["status"], r["cited"], r["note"]) for r in replies.parse_verdict(told, excerpts).collect()]
    assert got == ([expected] if expected else [])


def test_series_sections_and_values(spark):
    items = spark.createDataFrame([(1, 10, "decisions", "old", 7, 0, "First"), (2, 11, "decisions", "new", 7, 1, "Second"), (0, 11, "risks", "heat", 7, 1, "Second")], "id long, meeting_id long, category string, description string, series_id long, position int, meeting_title string")
    items = items.withColumns({"owner": F.lit(None).cast("string"), "date": F.lit(None).cast("string"), "mitigation": F.lit("shade")})
    told = report.section_text(items, spark.createDataFrame([(7,), (8,)], "id long"), True)
    text = {(r["series_id"], r["section"]): r["text"] for r in told.collect()}
    assert text[7, "decisions"] == "[First] old; [Second] new" and text[7, "risks"] == "[Second] heat (Mitigation: shade)" and text[8, "decisions"] == "None recorded." and text[8, "carry_forward"] == "No previous meeting linked."
    meetings = spark.createDataFrame([(10, "First", 60.5, "en", "2024-01-01 00:00:00", "one"), (11, "Second", 60.5, "zh", "2024-01-02 00:00:00", "")], "id long, title string, duration_seconds double, language string, created_at string, summary string")
    speakers_ = spark.createDataFrame([(1, 10, "S0", "Ann"), (2, 11, "S1", None), (3, 11, "S0", "Ann")], "id long, meeting_id long, label string, display_name string")
    chain = spark.createDataFrame([(7, 0, 10), (7, 1, 11), (8, 0, 10)], "id long, position int, meeting_id long")
    overview = reads.meeting_overview(meetings, speakers_)
    got = {(r["series_id"], r["field"]): r["value"] for r in report.series_values(chain, overview, meetings, speakers_, told).collect()}
    assert got[7, "title"] == "Second (combined series of 2 meetings)" and got[7, "date"] == "2024-01-01 to 2024-01-02" and got[7, "duration"] == "2:01" and got[7, "attendees"] == "Ann, S1" and got[7, "participants"] == "2"
    assert got[7, "language"] == "English, Chinese" and got[7, "summary"] == "First (2024-01-01): one\nSecond (2024-01-02): No summary generated yet." and "each of the 2 meetings" in got[7, "transcript"] and "each of the 1 meeting in" in got[8, "transcript"]
    assert got[8, "title"] == "First" and got[8, "date"] == "2024-01-01" and got[7, "decisions"] == text[7, "decisions"]
    alone = spark.createDataFrame([(12, "Quiet", None, None, None, None)], meetings.schema)
    one = {r["field"]: r["value"] for r in report.marker_values(reads.meeting_overview(alone, speakers_), report.section_text(items, alone), report.transcript_text(spark.createDataFrame([], "meeting_id long, id long, start_seconds double, speaker_name string, text string"))).collect()}
    assert one["attendees"] == "—" and one["participants"] == "0" and one["transcript"] == "" and one["risks"] == "None recorded."


def test_derived_deadlines(spark):
    given = spark.createDataFrame([(1, 0, "Ship the installer", "by Friday", [3])], "meeting_id long, item_no int, description string, date string, source_segment_ids array<long>")
    actions = spark.createDataFrame(
        [(1, 0, "Ship the installer by Friday", "null", [4]), (1, 1, "Call Ann on Thursday and Bob by Friday", "none yet", [5, 6]), (1, 2, "Nothing to see", None, [7]), (1, 3, "Write it all up", "3 July", None), (1, 4, "Write it all up", "3 July", [8]), (2, 0, "siap sebelum Jumaat", "tiada", [])],
        "meeting_id long, item_no int, description string, due string, source_segment_ids array<long>",
    )
    told = insights.derive_deadlines(given, actions)
    got = rows(told, "meeting_id", "item_no", "description", "date")
    assert got == [(1, 0, "Ship the installer", "by Friday"), (1, 1, "Call Ann on Thursday and Bob by Friday", "Thursday, Friday"), (1, 2, "Write it all up", "3 July"), (2, 0, "siap sebelum Jumaat", "Jumaat")]
    # a new row cites what its action cites
    assert rows(told, "meeting_id", "item_no", "source_segment_ids", "derived") == [(1, 0, [3], False), (1, 1, [5, 6], True), (1, 2, None, True), (2, 0, [], True)]


def test_texts_are_searched_for_cues_once(spark):
    actions = spark.range(20).select(F.lit(1).alias("meeting_id"), F.col("id").cast("int").alias("item_no"), F.concat(F.lit("by Friday "), F.col("id").cast("string")).alias("description"), F.lit(None).cast("string").alias("due"), F.array("id").alias("source_segment_ids"))
    told = insights._with_cues(actions)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and told.count() == 20


def test_a_parsed_chunk_without_items_counts_for_folding(spark):
    items = spark.createDataFrame([(1, 1, "a", k, "Same thing here", [k]) for k in (1, 2)], "meeting_id long, chunk_no int, category string, item_no int, description string, source_segment_ids array<long>")
    parsed = spark.createDataFrame([(1, 1), (1, 2)], "meeting_id long, chunk_no int")
    assert prompts.fold_items(items).count() == 2
    assert rows(prompts.fold_items(items, parsed), "description", "source_segment_ids") == [("Same thing here", [1, 2])]


def test_item_texts_do_not_decide_the_shape(spark):
    content = [(1, 1, 1, '{"action_items": [{"description": 5, "owner": "says \\"description\\": \\"x\\""}, {"description": "fine", "extra": {"description": 7}}, {"description": "kept", "owner": null}, {"description": "no", "due": ["x"]}]}')]
    good, _ = replies.first_parseable(spark.createDataFrame(content, "meeting_id long, chunk_no int, attempt int, content string"))
    assert rows(replies.parse_items(good)[0], "item_no", "description") == [(1, "fine"), (2, "kept")]


def test_accepted_links_reset_the_analysis(spark):
    m = spark.createDataFrame([(1, None, None), (2, 1, "ready"), (3, None, "ready"), (4, 3, "ready")], "id long, follow_up_of long, carry_forward_status string")
    s = spark.createDataFrame([(1,), (2,), (3,)], "meeting_id long")
    links = spark.createDataFrame([(3, 2), (2, None), (4, 3)], "meeting_id long, previous_id long")
    carried = spark.createDataFrame([(10, 2), (11, 3), (12, 4)], "id long, meeting_id long")
    linked, left = followup.apply_links(followup.check_links(links, m, s), m, carried)
    assert rows(linked, "id", "follow_up_of", "carry_forward_status") == [(1, None, None), (2, None, None), (3, 2, "analysing"), (4, 3, "ready")]
    assert rows(left, "id") == [(12,)]


def test_rows_of_a_series(spark):
    items = spark.createDataFrame([(7, 2, "decisions", "later", 1, "Second"), (9, 1, "decisions", "first", 0, "First"), (8, 2, "risks", "odd", 1, "Second")], "id long, meeting_id long, category string, description string, position int, meeting_title string")
    items = items.withColumns({"series_id": F.lit(2), "source_segment_id": F.lit(None).cast("long")})
    segments = spark.createDataFrame([], "id long, meeting_id long, start_seconds double")
    assert rows(report.minutes_rows(items, segments, True), "id", "number", "meeting", "source") == [(7, 2, "Second", "-"), (8, 1, "Second", "-"), (9, 1, "First", "-")]


def test_many_terms_are_searched_by_their_beginning(spark, monkeypatch):
    lines = spark.createDataFrame([(1, k, float(k), t) for k, t in enumerate(["Alpha beta", "x", "BETA, alphabet", None, "gamma"])], "meeting_id long, id long, start_seconds double, text string")
    terms = spark.createDataFrame([("beta",), ("alpha",), ("zz",), ("Ga",), ("et",)], "term string")
    few = rows(reads.search(lines, terms), "term", "id", "ordinal", "snippet")
    monkeypatch.setattr(reads, "MOST_TERMS", 2)
    assert rows(reads.search(lines, terms), "term", "id", "ordinal", "snippet") == few and len(few) == 7


def test_minutes_are_written_as_text(spark, tmp_path):
    texts = spark.createDataFrame([(1, "plan_minutes.docx", "a\nb"), (2, "x_minutes.docx", None)], "meeting_id long, filename string, text string")
    tables.write_minutes_text(texts, str(tmp_path / "t"), 4)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect() if r["value"]) == ["# plan_minutes.docx", "# x_minutes.docx", "a", "b"]


def test_owners(spark):
    items = spark.createDataFrame([(1, 1, "action_items", 0, None, [11, 12]), (1, 1, "action_items", 1, "Ann", [12]), (1, 1, "decisions", 2, None, [12])], "meeting_id long, chunk_no int, category string, item_no int, owner string, source_segment_ids array<long>")
    lines = spark.createDataFrame([(11, 1, 5, "Wei, can you?"), (12, 1, 6, "I'll do that")], "id long, meeting_id long, speaker_id long, text string")
    who = spark.createDataFrame([(5, 1, "S1", None), (6, 1, "S2", "Mei")], "id long, meeting_id long, label string, display_name string")
    assert rows(insights.attribute_owners(items, lines, who), "item_no", "owner") == [(0, "Mei"), (1, "Ann"), (2, None)]


def test_recovery(spark):
    lines = spark.createDataFrame([(1, k, float(k), t, t, 5.0) for k, t in enumerate(["all fine", "a risk here", "", "we might fail"])], "meeting_id long, id long, start_seconds double, text string, line string, tokens double")
    items = spark.createDataFrame([(1, "risks", [1])], "meeting_id long, category string, source_segment_ids array<long>")
    assert rows(prompts.recovery_lines(lines, items, 100.0), "id") == [(0,), (3,)]
    assert rows(prompts.recovery_lines(lines, items, 9.0), "id") == [(3,)]
    both = items.union(spark.createDataFrame([(1, "issues", [0])], items.schema))
    assert prompts.recovery_lines(lines, both, 100.0).count() == 0


# --- follow-ups


def test_chains_end_at_loops(spark):
    m = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4), (7, 99), (8, 8)], "id long, follow_up_of long")
    got = defaultdict(list)
    for i, p, x in rows(followup.meeting_chain(m), "id", "position", "meeting_id"):
        got[i].append((p, x))
    paths = {i: [x for _, x in sorted(v)] for i, v in got.items()}
    assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [5, 4], 5: [4, 5], 6: [5, 4, 6], 7: [7], 8: [8]}


def test_series_are_beginnings_of_lines(spark, monkeypatch):
    monkeypatch.setattr(followup, "BLOCK", 2)
    rng = random.Random(4)
    back = {k: None if k % 9 == 0 else rng.randrange(1, 70) for k in range(1, 61)} | {k: k - 1 for k in range(101, 120)} | {100: None}
    m = spark.createDataFrame([(k, v, f"T{k}", float(k), ("en", "zh", "")[k % 3], datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k), f"s{k}" if k % 2 else None) for k, v in back.items()], "id long, follow_up_of long, title string, duration_seconds double, language string, created_at timestamp, summary string")
    want = {}
    for k in back:
        walk = [k]
        while back[walk[-1]] in back and back[walk[-1]] not in walk:
            walk.append(back[walk[-1]])
        want[k] = walk[::-1]
    lines = followup.series_lines(m).cache()
    assert sorted(r["series_id"] for r in lines.collect() if r["series_id"] is not None) == sorted(back)
    # a plain series of twenty has a row for each meeting, not one for each that comes before another
    assert lines.where("line = 119").count() == 20 and lines.where("meeting_id >= 100").count() == 20
    chain = followup.meeting_chain(m).cache()
    got = defaultdict(dict)
    for i, p, x in rows(chain, "id", "position", "meeting_id"):
        got[i][p] = x
    assert {i: [v[p] for p in range(len(v))] for i, v in got.items()} == want
    assert rows(followup.meeting_chain(m, spark.createDataFrame([(119,), (7,)], "id long")).select("id").distinct(), "id") == [(119,), (7,)]
    speakers_ = spark.createDataFrame([(10 * k + j, k, f"S{j}", None if k % 4 else f"P{k % 5}") for k in back if k % 7 for j in range(2)], "id long, meeting_id long, label string, display_name string")
    short = followup.series_overview(lines, m, speakers_)
    assert short.columns == followup.series_overview(chain, m, speakers_).columns
    assert rows(short, *short.columns) == rows(followup.series_overview(chain, m, speakers_), *short.columns)
    items = spark.createDataFrame([(1000 * k + j, k, ("decisions", "risks", "deadlines")[j % 3], f"d{j}", "Ann", "may", "shade") for k in back if k % 5 for j in range(k % 4)], "id long, meeting_id long, category string, description string, owner string, date string, mitigation string")
    pooled = report.section_text(followup.pooled_items(chain, items, m), m, True)
    assert rows(report.series_section_text(lines, items, m), "series_id", "section", "text") == rows(pooled, "series_id", "section", "text")
    links = spark.createDataFrame([(a, b) for a in back for b in rng.sample(sorted(back), 4)], "meeting_id long, previous_id long").distinct()
    told = rows(followup.check_links(links, m, m.select(F.col("id").alias("meeting_id"))), "meeting_id", "previous_id", "reason")
    assert told == [(a, b, r) for a, b, _ in told for r in ["a meeting cannot follow itself" if a == b else "would form a loop" if a in want[b] else None]]


def test_links(spark):
    m = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, None)], "id long, follow_up_of long")
    s = spark.createDataFrame([(1,), (2,), (3,)], "meeting_id long")
    links = spark.createDataFrame([(9, 1), (3, 3), (3, 8), (3, 4), (4, 3), (1, 2), (3, 2), (2, None)], "meeting_id long, previous_id long")
    got = {(r["meeting_id"], r["previous_id"]): r["reason"] for r in followup.check_links(links, m, s).collect()}
    assert got == {
        (9, 1): "meeting not found",
        (3, 3): "a meeting cannot follow itself",
        (3, 8): "previous meeting not found",
        (3, 4): "previous meeting has no transcript",
        (4, 3): "this meeting has no transcript",
        (1, 2): "would form a loop",
        (3, 2): None,
        (2, None): None,
    }


def test_texts_are_searched_for_words_once(spark):
    texts = spark.range(20).select("id", F.concat(F.lit("the budget and plan "), F.col("id").cast("string"), F.lit("x")).alias("text"))
    told = followup._with_terms(followup._with_words(texts, "text", ["the", "and"])).where(F.size("terms") > 0).select("id", F.explode("terms").alias("term"))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and told.where("id = 3").count() == 5


def test_retrieval_equals_a_loop(spark, monkeypatch):
    rng = random.Random(9)
    vocab, stop = ["budget", "risk", "plan", "server", "the", "of", "launch", "test"], ["the", "of"]
    segments = [(m, m * 100 + k, float(k), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))) for m in range(6) for k in range(9)]
    actions = [(m, m * 10 + k, " ".join(rng.choice([*vocab, "unseen"]) for _ in range(rng.randint(0, 4)))) for m in range(6) for k in range(4)]
    s = spark.createDataFrame(segments, "meeting_id long, id long, start_seconds double, text string")
    a = spark.createDataFrame(actions, "meeting_id long, action_id long, description string")

    def terms(t):
        w = [x for x in t.split() if x not in stop]
        return Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])

    expected = []
    for m, i, d in actions:
        mine = [(sid, at, terms(t)) for x, sid, at, t in segments if x == m]
        corpus = [t for _, _, t in mine] + [terms(d)]
        n = len(corpus)
        df = Counter(t for c in corpus for t in c)
        vector = lambda c: {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        q = vector(corpus[-1])
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        sims = [(round(sum(v[t] * q[t] for t in v if t in q) / (norm(v) * norm(q)), 6) if (v := vector(c)) and q else 0.0, at, sid) for sid, at, c in mine]
        top = sorted((x for x in sims if x[0] > 0), reverse=True)[:3]
        if not top:
            top = sorted(sims, key=lambda x: x[1])[-3:] if any(corpus) else sorted(sims, key=lambda x: x[1])[:3]
        expected += [(m, i, k + 1, x[2]) for k, x in enumerate(sorted(top, key=lambda x: x[1]))]
    monkeypatch.setattr(followup, "MOST_ACTIONS", 2)
    monkeypatch.setattr(followup, "MOST_SEGMENTS", 3)
    for common in (64, 3, 1, 0):  # common terms by their bounds, down to all terms
        got = rows(followup.retrieve(a, s, 3, stop, common), "meeting_id", "action_id", "number", "segment_id")
        assert got == sorted(expected, key=repr)


# --- changes, reads, sources, templates


def touched(folder, before):
    """Names of the bucket folders whose files aren't those of before."""
    now = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    return {f.parent.name for f in {*now, *before} if now.get(f) != before.get(f)}


def files(folder):
    return {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_stored_replacement_writes_its_buckets_only(spark, tmp_path):
    path = tmp_path / "segments"
    old = spark.range(200).select((F.col("id") % 40).alias("meeting_id"), F.concat(F.lit("x"), "id").alias("x"))
    changes.store_table(old, str(path), 16)
    before = files(path)
    new = spark.createDataFrame([(3, "n"), (9, "not done")], "meeting_id long, x string")
    done = spark.createDataFrame([(3,), (5,)], "meeting_id long")
    buckets = changes.replace_stored(new, done, str(path), 16)
    assert touched(path, before) == {f"bucket={b}" for b in buckets} and len(buckets) <= 2
    expected = rows(changes.replace_meetings(old, new, done), "meeting_id", "x")
    read = lambda: rows(spark.read.parquet(str(path)), "meeting_id", "x")
    assert read() == expected
    changes.replace_stored(new, done, str(path), 16)
    assert read() == expected
    # a bucket whose last rows go is emptied
    alone = tmp_path / "alone"
    changes.store_table(old.where("meeting_id = 3"), str(alone), 16)
    changes.replace_stored(new.limit(0), done, str(alone), 16)
    assert not files(alone)
    changes.replace_stored(new, done, str(tmp_path / "fresh"), 16)
    assert rows(spark.read.parquet(str(tmp_path / "fresh")), "meeting_id", "x") == [(3, "n")]


def test_stored_purge_and_edits_write_their_buckets_only(spark, tmp_path):
    meetings = spark.range(50).select("id", F.col("id").alias("meeting_id"), F.when(F.col("id") == 7, 3).otherwise(None).cast("long").alias("follow_up_of"), F.lit("ready").alias("carry_forward_status"))
    carried = spark.createDataFrame([(1, 7, 3, "a", None, "blocked", None), (2, 20, 19, "b", None, "blocked", None)], "id long, meeting_id long, previous_meeting_id long, description string, owner string, status string, note string")
    words = spark.range(100).select("id", (F.col("id") % 50).alias("meeting_id"))
    given = {"meetings": meetings, "carry_forward": carried, "words": words, "risks": words}
    schemas = {n: t.schema for n, t in given.items()}
    for name, table in given.items():
        changes.store_table(table, str(tmp_path / name), 64)
    before = {n: files(tmp_path / n) for n in given}
    for _ in range(2):
        told = changes.purge_stored(spark, str(tmp_path), schemas, spark.createDataFrame([(3,)], "id long"), 64)
    read = lambda n: spark.read.schema(schemas[n]).parquet(str(tmp_path / n))
    assert read("meetings").count() == 49 and rows(read("meetings").where("id = 7"), "follow_up_of", "carry_forward_status") == [(None, None)]
    assert rows(read("carry_forward"), "id") == [(2,)] and read("words").count() == 98 == read("risks").count()
    assert all(len(touched(tmp_path / n, before[n])) <= 2 for n in given) and len(told["words"]) == 1
    before = files(tmp_path / "carry_forward")
    changes.edit_stored(edit(spark, (2, 20, {"status": "Completed"})), "carry_forward", str(tmp_path / "carry_forward"), schemas["carry_forward"], 64)
    assert rows(read("carry_forward"), "id", "status") == [(2, "completed")] and len(touched(tmp_path / "carry_forward", before)) == 1


def test_replacing_twice_is_replacing_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "meeting_id long, x string")
    new = spark.createDataFrame([(1, "n"), (9, "odd")], "meeting_id long, x string")
    done = spark.createDataFrame([(1,), (2,)], "meeting_id long")
    once = changes.replace_meetings(old, new, done)
    assert rows(once, "meeting_id", "x") == [(1, "n"), (3, "c")]
    assert rows(changes.replace_meetings(once, new, done), "meeting_id", "x") == [(1, "n"), (3, "c")]


def test_purge_leaves_no_orphan(spark):
    t = {
        "meetings": spark.createDataFrame([(1, None, None), (2, 1, "ready"), (3, 2, "ready")], "id long, follow_up_of long, carry_forward_status string"),
        "segments": spark.createDataFrame([(10, 1), (20, 2)], "id long, meeting_id long"),
        "words": spark.createDataFrame([(100, 10), (200, 20)], "id long, segment_id long"),
        "carry_forward": spark.createDataFrame([(5, 2, 1), (6, 3, 2)], "id long, meeting_id long, previous_meeting_id long"),
    }
    left = changes.purge_meetings(t, spark.createDataFrame([(1,)], "id long"))
    assert rows(left["meetings"], "id", "follow_up_of", "carry_forward_status") == [(2, None, None), (3, 2, "ready")]
    assert rows(left["words"], "id") == [(200,)] and rows(left["segments"], "id") == [(20,)] and rows(left["carry_forward"], "id") == [(6,)]


def test_speaker_names(spark):
    who = spark.createDataFrame([(5, 1, "S1", "Old"), (6, 1, "S2", "Mei")], "id long, meeting_id long, label string, display_name string")
    new = spark.createDataFrame([(1, 5, " Ann "), (1, 6, " ")], "meeting_id long, id long, display_name string")
    assert rows(changes.rename_speakers(who, new), "id", "display_name") == [(5, "Ann"), (6, None)]


def test_stored_search_equals_the_scan_and_reads_what_it_needs(spark, tmp_path):
    texts = ["The INSTALLER went out", "an installer", "tall 😀 installs", "ab", "", None, "一二三四", "İstanbul 100%", "x" * 5000 + "installer"]
    lines = spark.createDataFrame([(i % 2, i, float(i), t) for i, t in enumerate(texts * 2)], "meeting_id long, id long, start_seconds double, text string")
    terms = spark.createDataFrame([("installer",), (" Install ",), ("l 😀",), ("ab",), ("二三四",), ("100%",), ("absent word",), ("q",), ("xxx",), (None,)], "term string")
    path = str(tmp_path / "index")
    search_index.write_search_index(lines, path, 4, 16)
    columns = ("term", "meeting_id", "id", "ordinal", "start_seconds", "snippet")
    got = rows(search_index.search_stored(spark, path, terms), *columns)
    assert got == rows(reads.search(lines, terms), *columns) and len(got) > 15
    one = search_index.search_stored(spark, path, terms.where("term = '100%'"))
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*block#\d+", plan)
    none = search_index.search_stored(spark, path, terms.where("term = 'absent word'"))
    assert none.count() == 0
    search_index.write_search_index(lines.limit(0), str(tmp_path / "empty"), 4, 16)
    assert search_index.search_stored(spark, str(tmp_path / "empty"), terms).count() == 0


def test_tables_by_jdbc_in_partitions(spark):
    """Round trip through a database in memory."""
    url, options = "jdbc:derby:memory:meetings;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    speakers_ = spark.createDataFrame([(i, i % 7, f"S{i}", None if i % 2 else "Ünal") for i in range(1, 101)], tables.SCHEMAS["speakers"])
    turns = spark.createDataFrame([(i % 5, i, i * 0.5, i + 1.0, "A") for i in range(20)], tables.SCHEMAS["turns"])
    none = spark.createDataFrame([], tables.SCHEMAS["issues"])
    tables.write_jdbc({"speakers": speakers_, "turns": turns, "issues": none}, url, options)
    got = tables.read_tables(spark, url, ["speakers", "turns", "issues"], "jdbc", options=options | {"numPartitions": "4"})
    for name, df in {"speakers": speakers_, "turns": turns, "issues": none}.items():
        assert got[name].schema == df.schema and rows(got[name], *df.columns) == rows(df, *df.columns)
    sizes = got["speakers"].groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in sizes] == [25] * 4 and got["turns"].rdd.getNumPartitions() == 4
    wide = tables.read_jdbc(spark, url, "speakers", options | {"lowerBound": "40", "upperBound": "60"}, "id", 2)
    assert wide.count() == 100


def test_uploads_are_read_without_their_content(spark, tmp_path):
    for name, size in (("a.mp4", 10), ("b.exe", 5), ("c.wav", 30), ("d.WEBM", 1), ("empty.mp3", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    details = spark.createDataFrame([("a.mp4", "Plan", 2, "en"), ("c.wav", None, None, None), ("gone.mp3", "x", 1, "en")], "filename string, title string, expected_speakers int, language string")
    manifest = tables.upload_manifest(spark, str(tmp_path), details)
    assert rows(manifest, "filename", "bytes", "title") == [("a.mp4", 10, "Plan"), ("b.exe", 5, None), ("c.wav", 30, None), ("d.WEBM", 1, None)]
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString()
    told = tables.check_uploads(manifest, 20)
    assert rows(told, "filename", "title", "reason") == [("a.mp4", "Plan", None), ("b.exe", "b", "unsupported file type"), ("c.wav", "c", "file too large"), ("d.WEBM", "d", None)]


def test_search_takes_no_pattern(spark):
    s = spark.createDataFrame([(1, 1, 0.0, "a 50% rise_x"), (2, 1, 1.0, "a 50 rise x")], "id long, meeting_id long, start_seconds double, text string")
    terms = spark.createDataFrame([("50%",), ("RISE_",), ("a",)], "term string")
    assert rows(reads.search(s, terms), "term", "id", "ordinal") == [("50%", 1, 0), ("RISE_", 1, 0)]


def test_tables_are_written_and_read(spark, tmp_path):
    minutes = spark.createDataFrame([(k, f"row {k}") for k in range(20)], "meeting_id long, text string")
    tables.write_minutes(minutes, str(tmp_path / "m"), 4)
    tables.write_minutes(minutes.where("meeting_id = 3").withColumn("text", F.lit("new")), str(tmp_path / "m"), 4)
    bucket = tables.with_bucket(minutes, 4).where("meeting_id = 3").first()["bucket"]
    kept = spark.read.parquet(str(tmp_path / "m"))
    assert kept.where(f"bucket = {bucket}").count() == 1 and kept.where("text = 'new'").count() == 1
    speakers_ = spark.createDataFrame([(1, 2, "S", None)], tables.SCHEMAS["speakers"])
    for fmt in ("parquet", "json"):
        speakers_.write.format(fmt).save(str(tmp_path / fmt / "speakers"))
        read = tables.read_tables(spark, str(tmp_path / fmt), ["speakers"], fmt)["speakers"]
        assert [tuple(r) for r in read.collect()] == [(1, 2, "S", None)]


def test_uploads(spark):
    m = spark.createDataFrame(
        [("a.mp4", 10, None, None, None), ("b.exe", 10, "t", None, "en"), ("c.wav", 5 << 30, "t", None, "en"), ("d.wav", 1, "t", 21, "en"), ("e.wav", 1, "t", 2, "fr"), ("f.webm", 1, "x" * 256, 2, "en")], "filename string, bytes long, title string, expected_speakers int, language string"
    )
    assert rows(tables.check_uploads(m), "filename", "reason") == [("a.mp4", None), ("b.exe", "unsupported file type"), ("c.wav", "file too large"), ("d.wav", "bad number of speakers"), ("e.wav", "bad language"), ("f.webm", "bad title")]


def test_headings(spark):
    lines = ["Action Items:", "put your action items here", "Actoin items", "Riks", "风险", "本会议截止日期表", "MINUTES OF MEETING", "The risks we talked about were many and large.", "Tarikh Akhir", "date", "update", ""]
    df = spark.createDataFrame([(1, k, "Normal", t) for k, t in enumerate(lines)], "template_id long, line_no int, style string, text string")
    got = [f for _, f in sorted(rows(headings.match_headings(df), "line_no", "field"))]
    assert got == ["action_items", "action_items", "action_items", None, "risks", "deadlines", None, None, "deadlines", "date", None, None]
    assert [f for _, f in sorted(rows(headings.match_headings(df, scalar_only=True), "line_no", "field"))][9] == "date"
    marks = spark.createDataFrame([(1, 1, "See [[ Title ]], [[odd]] and [[TARIKH]]")], "template_id long, line_no int, text string")
    values = spark.createDataFrame([("title", "Plan"), ("date", "now")], "field string, value string")
    assert headings.fill_markers(marks, values).first()["filled"] == "See Plan, [[odd]] and now"


def closest_by_loop(name, fields):
    best, most = None, 0.0
    for field, names in headings.SYNONYMS.items():
        for other in names if field in fields else []:
            ratio = difflib.SequenceMatcher(None, name, other).ratio()
            if ratio > most:
                best, most = field, ratio
    return best if most >= headings.LEAST_RATIO else None


@pytest.mark.parametrize("scalar_only", [False, True])
def test_closest_names_equal_difflib(spark, scalar_only):
    rng = random.Random(7)
    names = [n for v in headings.SYNONYMS.values() for n in v]

    def slip(n):
        k = rng.randrange(len(n))
        return rng.choice([n[:k] + n[k + 1 :], n[:k] + rng.choice("aeinst 会") + n[k:], n[:k] + n[k + 1 : k + 2] + n[k : k + 1] + n[k + 2 :], n[:k] + "😀" + n[k + 1 :]])

    typed = {slip(n) if k % 3 else slip(slip(n)) for n in names for k in range(3)} | {"x" * 5000, "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"}
    typed = sorted(t for t in typed if t)
    df = spark.createDataFrame([(t,) for t in typed + typed[:50]], "_name string")  # repeats too
    got = {r[0]: r[1] for r in headings.closest(df, headings.synonyms(spark, scalar_only)).select("_name", "_field").collect()}
    fields = headings.SCALAR if scalar_only else list(headings.SYNONYMS)
    assert got == {t: f for t in typed if (f := closest_by_loop(t, fields))}
    assert len(got) > (80 if scalar_only else 200)


def test_matched_letters_equal_difflib(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abca会 ") for _ in range(rng.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", headings.matched_letters(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(a, b, sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())) for a, b in pairs]


def test_shaky_words(spark):
    s = spark.createDataFrame([(1, "Hello, you"), (2, "Hi")], "id long, text string")
    w = spark.createDataFrame([(1, 0, "hello", 0.4), (1, 1, "you", 0.9), (2, 0, "ho", 0.1)], "segment_id long, word_no int, text string, score double")
    assert rows(reads.flag_shaky_words(w, s), "segment_id", "word_no", "shaky") == [(1, 0, True), (1, 1, False), (2, 0, False)]


def test_normalised_keeps_letters(spark):
    assert spark.range(1).select(normalised(F.lit("  Über—会议, 5! "))).first()[0] == "über会议 5"
    assert datetime.date(2026, 8, 12).weekday() == 2


def test_long_lines_are_told_by_their_beginning(spark):
    """Lines of more words than a name has are matched by no more than their first characters, with the same fields as by the whole."""
    assert all(len(n.split(" ")) <= headings.WORDS for v in headings.SYNONYMS.values() for n in v)
    six, wide = "the key decisions of our meeting", " the\u00a0key  decisions\u2003of our\nmeeting : "
    cases = [
        (six, None, "decisions"), (wide, None, "decisions"), (six + " now", None, None), (six + " : .", None, None), (six + " .:", None, "decisions"), (six + " ::", None, "decisions"),
        (six + " now", "Heading 2", "decisions"), ("date " * 2000, None, None), ("date " * 2000, "Title", "date"), ("date " + "x" * 90, None, "date"),
        ("Summary" + ":" * 90, None, "summary"), (" " * 90 + "Summary", None, "summary"), ("x" * 60 + " date.", None, None), ("Date.", None, "date"), (None, None, None), ("", "Title", None),
    ]
    df = spark.createDataFrame([(1, k, *c[:2]) for k, c in enumerate(cases)], "template_id long, line_no int, text string, style string")
    assert [f for _, f in sorted(rows(headings.match_headings(df), "line_no", "field"))] == [c[2] for c in cases]
    named = headings._named(df).where("not _loose")
    assert named.count() > 2 and named.where(F.length("_name") > headings.LONGEST + 1).count() == 0


def test_template_lines_are_made_once(spark, tmp_path):
    made = [(1, 1, "paragraph", "Normal", "Summary", None), (1, 2, "cell", "Normal", "Duraton", ""), (1, 3, "cell", "Normal", "title", "as it is"), (2, 1, "paragraph", "Normal", "[[risks]] and a line of a great many words", None), (3, 1, None, None, None, None)]
    df = spark.createDataFrame(made, "template_id long, line_no int, kind string, style string, text string, next_text string")
    df.write.parquet(str(tmp_path / "template-lines"))
    lines = spark.read.parquet(str(tmp_path / "template-lines"))
    fields, report = headings.recognised_fields(lines), headings.placement_report(lines, spark.createDataFrame([("summary",), ("duration",), ("risks",)], "field string"))
    assert rows(fields, "template_id", "fields") == [(1, ["duration", "summary", "title"]), (2, ["risks"]), (3, [])]
    assert [r for r in rows(report, "template_id", "field", "way") if r[2] != "skipped"] == [(1, "duration", "table-label"), (1, "summary", "heading"), (2, "risks", "marker")]
    assert report.count() == 9
    for told in (fields, report):
        assert "template-lines" not in told._jdf.queryExecution().toString()


def test_index_is_written_by_more_tasks_for_more_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "TEXT_A_TASK", 200)
    monkeypatch.setattr(search_index, "POSTINGS_A_TASK", 50)
    lines = spark.range(300).select(F.lit(1).cast("long").alias("meeting_id"), "id", F.col("id").cast("double").alias("start_seconds"), F.lit("some words").alias("text"))
    search_index.write_search_index(lines, str(tmp_path / "index"), 2, 2)
    assert len(list((tmp_path / "index" / "postings").glob("part=*/*.parquet"))) > 2 * search_index.SALT
    assert len(list((tmp_path / "index" / "texts").glob("block=*/*.parquet"))) > 2
    terms = spark.createDataFrame([("words",)], "term string")
    assert search_index.search_stored(spark, str(tmp_path / "index"), terms).count() == 200
