"""Column rules: literal cases in English, Chinese and Malay, nulls and blanks."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from parley.functions import dates, text


def values(spark, rule, *rows):
    width = len(rows[0])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ", ".join(["k int"] + [f"c{i} string" for i in range(width)]))
    return [r["v"] for r in df.select("k", rule(*[F.col(f"c{i}") for i in range(width)]).alias("v")).orderBy("k").collect()]


def test_languages(spark):
    assert values(spark, text.canonical_language, (" ID ",), ("zh",), (None,), ("EN",)) == ["ms", "zh", "", "en"]
    assert values(spark, text.shares_script, ("zh", "en"), ("ms", "en"), ("en", "ms"), ("en", "zh"), ("zh", "zh")) == [False, True, True, False, True]
    assert values(spark, text.output_language, ("auto", "ms"), (None, "zh"), ("en", "zh"), ("auto", None)) == ["ms", "zh", "en", "en"]


def test_tokens_and_names(spark):
    assert values(spark, text.estimate_tokens, ("abcd",), ("会议ab",), (None,), ("",)) == [1.0, 2.5, 0.0, 0.0]
    assert values(spark, text.speaker_name, ("S1", "Wei"), ("S1", ""), ("S1", None), (None, None)) == ["Wei", "S1", "S1", "Unknown"]
    assert values(spark, text.prompt_line, ("7", "Wei", "  so it is "), ("8", "S", None)) == ["[seg 7] Wei: so it is", "[seg 8] S: "]
    assert values(spark, lambda c: text.fmt_time(c.cast("double")), ("0",), ("59.9",), ("3600",), ("36061.2",), (None,)) == ["0:00", "0:59", "1:00:00", "10:01:01", "0:00"]


def test_cues(spark):
    said = [("I'll do it",), ("Saya akan hantar",), ("我负责这个",), ("she will",), (None,), ("will I",)]
    assert values(spark, text.is_self_assignment, *said) == [True, True, True, False, False, False]
    risk = [("we might be late",), ("ada masalah",), ("可能来不及",), ("all is well",), (None,), ("mightier",)]
    assert values(spark, text.has_risk_cue, *risk) == [True, True, True, False, False, False]


def test_low_support(spark):
    rows = [
        ("buy 5,000 units", "we need 5000 of them", "en", "en"),
        ("finalise the budget", "the finalized numbers", "en", "en"),
        ("order new chairs", "weather looks lovely outside", "en", "en"),
        ("order new chairs", "weather looks lovely outside", "en", "ms"),
        ("order new chairs", "天气很好", "en", None),
        ("买椅子", "天气很好", "zh", "zh"),
        ("买椅子", "椅子在哪", "zh", " ZH "),
        ("", "anything", None, None),
        ("order chairs", None, None, None),
        ("team should meeting", "other plain words", "en", "en"),
    ]
    assert values(spark, text.is_low_support, *rows) == [False, False, True, False, False, True, False, False, False, False]


def test_similar(spark):
    rows = [("Ship it!", "ship IT"), ("send the report", "Send the report to Wei"), ("send it", "send it now"), ("", ""), ("会议 记录", "会议，记录"), (None, "x")]
    assert values(spark, text.similar, *rows) == [True, True, False, False, False, False]


def test_file_names(spark):
    assert values(spark, lambda t, n: text.output_filename(t, F.lit(False), n), ("Weekly Sync - #3!", None), ("!!!", ""), ("Plan", "House style for the finance department"), ("a" * 60, "x")) == [
        "weekly_sync_3_minutes.docx",
        "meeting_minutes.docx",
        "plan_minutes_house_style_for_the.docx",
        "a" * 40 + "_minutes_x.docx",
    ]
    assert values(spark, lambda t: text.output_filename(t, F.lit(True), F.lit(None).cast("string")), ("Plan",)) == ["plan_combined_minutes.docx"]


def test_status(spark):
    got = values(spark, text.status_info, ("error: no audio",), ("categorize_failed: x",), ("transcribing",), ("diarized",), ("odd",))
    assert [(g["busy"], g["failed"]) for g in got] == [(False, True), (False, True), (True, False), (False, False), (False, False)]
    assert got[4]["label"] == "odd" and got[2]["label"] == "Transcribing…"


def test_reply_json(spark):
    rows = [('so: {"a": 1} done',), ('{"a": 1',), ("[1, 2]",), ("} {",), (None,), ('{"a": {"b": 2}}',)]
    assert values(spark, text.reply_json, *rows) == ['{"a": 1}', None, "[1, 2]", None, None, '{"a": {"b": 2}}']


def test_date_cues(spark):
    rows = [
        ("Do it by next Friday or on 3 July, else 2024-05-06",),
        ("siap sebelum Jumaat atau minggu depan",),
        ("下周五之前，7月3日交",),
        ("the day after tomorrow at the end of the month",),
        (None,),
        ("fridays and ünext weekly",),
    ]
    assert values(spark, dates.date_cues, *rows) == [["by next Friday", "3 July", "2024-05-06"], ["sebelum Jumaat", "minggu depan"], ["下周", "7月3日"], ["the day after tomorrow", "end of the month"], [], []]


def test_normal_dates(spark):
    rows = [("By the Friday.",), ("before next Monday",), ("hari Jumaat",), ("hari ini",), (None,), ("on due by 3 July —",)]
    assert values(spark, dates.norm_date, *rows) == ["friday", "monday", "jumaat", "hari ini", "", "3 july"]
    assert values(spark, dates.display_date, ("by Friday",), ("next week",), ("pada Isnin",), ("on by Friday",)) == ["Friday", "next week", "Isnin", "by Friday"]


DAY = datetime.date


@pytest.mark.parametrize("anchor", [DAY(2026, 8, 12)])  # a Wednesday
def test_resolved_dates(spark, anchor):
    cases = {
        "2026-09-01": DAY(2026, 9, 1),
        "2026-13-01": None,
        "5/9": DAY(2026, 9, 5),
        "5/9/27": DAY(2027, 9, 5),
        "31/2": None,
        "9月5日": DAY(2026, 9, 5),
        "3rd of July": DAY(2026, 7, 3),
        "January 5": DAY(2027, 1, 5),
        "31 June": None,
        "tonight": anchor,
        "esok": DAY(2026, 8, 13),
        "the day after tomorrow": DAY(2026, 8, 13),
        "lusa": DAY(2026, 8, 14),
        "后天": DAY(2026, 8, 14),
        "下周五": DAY(2026, 8, 19),
        "end of the month": DAY(2026, 8, 31),
        "next month": DAY(2026, 9, 30),
        "this week": DAY(2026, 8, 16),
        "bulan ini": DAY(2026, 8, 31),
        "in three days": DAY(2026, 8, 15),
        "dalam dua minggu": DAY(2026, 8, 26),
        "within a month": DAY(2026, 8, 31),
        "2 months": DAY(2026, 9, 30),
        "周五": DAY(2026, 8, 14),
        "by Friday": DAY(2026, 8, 14),
        "Wednesday": anchor,
        "next Friday": DAY(2026, 8, 21),
        "hari Isnin": DAY(2026, 8, 17),
        "end of quarter": None,
        "eod": None,
        "": None,
    }
    got = values(spark, lambda c: dates.resolve_date(c, F.lit(anchor)), *[(c,) for c in cases])
    assert dict(zip(cases, got, strict=True)) == cases


def test_annotated_dates(spark):
    rule = lambda c: dates.annotate_dates(c, F.lit(DAY(2026, 8, 12)))
    assert values(spark, rule, ("Friday, soon",), ("Friday (x)",), ("  ",), (None,)) == ["Friday (14/08/2026), soon", "Friday (x)", "  ", None]


def test_local_dates(spark):
    zone = "Asia/Kuala_Lumpur"
    rows = [("2026-09-19 20:20:46",), ("2026-09-19T10:20:46Z",), ("yesterday at noon",), (None,), ("",)]
    assert values(spark, lambda c: dates.local_date(c, zone), *rows) == ["2026-09-20", "2026-09-19", "yesterday ", "", ""]
    assert values(spark, lambda c: dates.local_datetime(c, zone), *rows[:3]) == ["2026-09-20 04:20", "2026-09-19 18:20", "yesterday at noo"]


def test_date_cues_are_those_of_the_plain_phrases_and_quicker(spark):
    """The look ahead changes no phrase, also with odd letters and digits, and spares most places of a text."""
    rng = random.Random(3)
    bits = ["by", "next", "friday", "MONDAY", "ſaturday", "Khamis", "Khamis", "5", "12", "٣", "天", "个月", "下个", "周", "星期一", "季度", "第", "日", "月", "3/4", "2024-01-02", "january", "mei", "hari", "ini", "within", "a", "week", "eod", "q3", "end of", "x", "é", "_", ".", "hujung", "minggu", "lusa", "dalam", "dua", "大后天", "一", "礼拜", "tomorrow"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "-"]) for _ in range(12)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"(?iuU)({dates.CUES})"), F.lit(1)), lambda x: F.trim(x))
    rows = df.select("t", dates.date_cues(F.col("t")).alias("got"), plain(F.col("t")).alias("expected")).collect()
    assert all(r["got"] == r["expected"] for r in rows) and sum(len(r["got"]) for r in rows) > 1500
    long_ = spark.range(4).select(F.concat(F.col("id").cast("string"), F.lit("thingering estionhathe reronly " * 20_000)).alias("t")).localCheckpoint()

    def seconds(f):
        began = time.time()
        assert long_.select(F.size(f(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 0
        return time.time() - began

    seconds(dates.date_cues), seconds(plain)
    assert seconds(dates.date_cues) < 0.7 * seconds(plain)
