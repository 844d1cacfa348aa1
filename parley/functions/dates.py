"""Date cues in text: finding, normalising and resolving them against a meeting's date (English, Chinese, Malay)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, numbers and patterns of dates.
WEEKDAYS = {"monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6, "isnin": 0, "selasa": 1, "rabu": 2, "khamis": 3, "jumaat": 4, "sabtu": 5, "ahad": 6}
WIDE_WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
MONTHS = {"january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12, "januari": 1, "februari": 2, "mac": 3, "mei": 5, "julai": 7, "ogos": 8, "oktober": 10, "disember": 12}
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "tujuh": 7, "lapan": 8, "sembilan": 9, "sepuluh": 10, "一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5}
NO_DUE = ["null", "none", "n/a", "na", "tbd", "unknown", "无", "没有", "未定", "tiada", "tidak", "belum"]
_DAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
_HARI = "isnin|selasa|rabu|khamis|jumaat|sabtu|ahad"
_BULAN = "januari|februari|mac|april|mei|jun|julai|ogos|september|oktober|november|disember"
_BILANGAN = r"satu|dua|tiga|empat|lima|enam|tujuh|lapan|sembilan|sepuluh|\d+"
CUES = "|".join(
    [
        rf"\b(?:by|before|on|due)\s+(?:next\s+|this\s+)?(?:{_DAY})\b",
        rf"\b(?:this|next)\s+(?:{_DAY})\b",
        rf"\b(?:{_DAY})\b",
        r"\b(?:today|tonight|tomorrow|the\s+day\s+after\s+tomorrow)\b",
        r"\b(?:by\s+(?:the\s+)?end\s+of(?:\s+the)?|end\s+of(?:\s+the)?|this|next)\s+(?:week|month|quarter)\b",
        r"\b(?:eow|eod)\b",
        r"\b(?:by|before|in|end\s+of)\s+q[1-4]\b",
        r"\b(?:within|in)\s+(?:a|an|one|two|three|\d+)\s+(?:day|days|week|weeks|month|months)\b",
        r"\b(?:one|two|three|\d+)\s+(?:day|days|week|weeks|month|months)\b",
        rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{_MONTH})\b",
        rf"\b(?:{_MONTH})\s+\d{{1,2}}(?:st|nd|rd|th)?\b",
        r"\b\d{4}-\d{1,2}-\d{1,2}\b",
        r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b",
        "今天|今晚|明天|明晚|后天|大后天",
        "这个?周|本周|下个?周|这个?星期|下个?星期|周末|这个?月|下个?月|月底|月初",
        "(?:星期|周|礼拜)[一二三四五六日天]",
        r"\d{1,2}\s*月\s*\d{1,2}\s*[号日]",
        r"\d{1,2}\s*[号日]",
        r"(?:一|两|二|三|四|五|\d+)\s*(?:天|周|个?星期|个月)",
        "(?:第[一二三四1234]|下个?|这个?)?季度",
        rf"\b(?:sebelum|menjelang|pada|hari)\s+(?:{_HARI})\b",
        rf"\b(?:{_HARI})\b",
        r"\b(?:hari\s+ini|malam\s+ini|esok|besok|lusa)\b",
        r"\b(?:minggu|bulan|suku\s+tahun)\s+(?:ini|depan|hadapan)\b",
        r"\bhujung\s+(?:minggu|bulan|tahun)\b",
        r"\bakhir\s+(?:minggu|bulan|tahun)\s+(?:ini|depan|hadapan)\b",
        rf"\b(?:dalam|sebelum)\s+(?:{_BILANGAN})\s+(?:hari|minggu|bulan)\b",
        rf"\b(?:{_BILANGAN})\s+(?:hari|minggu|bulan)\s+(?:lagi|depan|hadapan)\b",
        rf"\b\d{{1,2}}\s+(?:{_BULAN})\b",
        rf"\b(?:{_BULAN})\s+\d{{1,2}}\b",
    ]
)
#: What a phrase can begin with, looked at before the phrases are tried one by one: inside words hardly any place gets further.
#: First by plain ranges, which cost least, then by the letters themselves.
START = r"(?=(?-iuU:(?<![A-Za-z])[A-Za-z]|[^\x00-\x2F\x3A-\x7F]))(?=[\d今明后大这本下周星月礼一两二三四五第季]|\b[abdefhijklmnoprstw])"
#: One leading word that doesn't change the date; 'hari' only before a weekday.
LEADING = rf"^(?:(?:by|before|on|due|this|next|the|in|within|sebelum|menjelang|pada|dalam|hari(?=\s+(?:{_HARI})))\s+)+"
SHOWN_LEADING = r"^(?:by|on|before|due|sebelum|menjelang|pada)\s+"
EDGE = " .,:;'\"-—"


def date_cues(text: Column) -> Column:
    """Every date or time phrase in order; null has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iuU)({START}(?:{CUES}))"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def norm_date(cue: Column) -> Column:
    """Lower case without leading prepositions and without punctuation at its edges; null as ''."""
    c = F.trim(F.lower(F.coalesce(cue, F.lit(""))))
    return F.btrim(F.regexp_replace(c, "(?iuU)" + LEADING, ""), F.lit(EDGE))


def display_date(cue: Column) -> Column:
    """Without one leading by/on/before/due/sebelum/menjelang/pada."""
    return F.trim(F.regexp_replace(F.coalesce(cue, F.lit("")), "(?iuU)" + SHOWN_LEADING, ""))


def _lookup(key: Column, values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def resolve_date(cue: Column, anchor: Column) -> Column:
    """D3: the date of a cue said on the anchor date, or null. The first rule that fits decides, even for an impossible date."""
    # an array of one binds the plain cue, so that the rules share it
    return F.get(F.transform(F.array(_plain(cue)), lambda c: _resolved(c, anchor)), 0)


def _plain(cue: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(cue), r"(?U)\s+", " "))


def _resolved(c: Column, anchor: Column) -> Column:
    """`resolve_date` of a plain cue."""
    has = lambda pattern: c.rlike("(?uU)" + pattern)
    group = lambda pattern, k: F.regexp_extract(c, "(?uU)" + pattern, k)
    number = lambda x: F.try_cast(x, "int") if hasattr(F, "try_cast") else x.try_cast("int")
    iso, slash = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"
    wide = r"(\d{1,2})\s*月\s*(\d{1,2})\s*[号日]"
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    day_first, month_first = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({names})\b", rf"\b({names})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
    year = F.year(anchor)
    said = number(group(slash, 3))
    slash_year = F.when(said.isNull(), year).when(said < 100, said + 2000).otherwise(said)
    day = F.when(has(day_first), number(group(day_first, 1))).otherwise(number(group(month_first, 2)))
    month = F.when(has(day_first), _lookup(group(day_first, 2), MONTHS)).otherwise(_lookup(group(month_first, 1), MONTHS))
    this_year = _date(year, month, day)
    named = F.when(this_year < F.date_sub(anchor, 180), _date(year + 1, month, day)).otherwise(this_year)
    coming = lambda base, k: F.date_add(base, F.pmod(k - F.weekday(base), F.lit(7)))
    units = "(day|days|week|weeks|month|months|hari|minggu|bulan|天|周|个月)"
    led, bare = rf"\b(?:within|in|dalam)\s+([a-z一-鿿]+|\d+)\s+{units}\b", rf"\b([a-z一-鿿]+|\d+)\s+{units}\b"
    raw = F.when(has(led), group(led, 1)).otherwise(group(bare, 1))
    unit = F.when(has(led), group(led, 2)).otherwise(group(bare, 2))
    n = F.coalesce(number(raw), _lookup(raw, NUMBERS))
    span = F.when(unit.isin("day", "days", "hari", "天"), F.date_add(anchor, n)).when(unit.isin("week", "weeks", "minggu", "周"), F.date_add(anchor, n * 7))
    span = span.otherwise(F.last_day(F.add_months(F.trunc(anchor, "month"), n - 1)))
    wide_day, latin_day = "(?:星期|周|礼拜)\\s*([一二三四五六日天])", rf"\b({'|'.join(WEEKDAYS)})\b"
    base = F.when(c.contains("next"), F.date_add(anchor, 7)).otherwise(anchor)
    return (
        F.when(c.isNull() | (c == "") | anchor.isNull(), F.lit(None).cast("date"))
        .when(has(iso), _date(number(group(iso, 1)), number(group(iso, 2)), number(group(iso, 3))))
        .when(has(slash), _date(slash_year, number(group(slash, 2)), number(group(slash, 1))))
        .when(has(wide), _date(year, number(group(wide, 1)), number(group(wide, 2))))
        .when(has(day_first) | has(month_first), named)
        .when(has(r"\b(today|tonight)\b|hari ini|malam ini|今天|今晚"), anchor)
        .when(has(r"\btomorrow\b|\besok\b|\bbesok\b|明天|明晚"), F.date_add(anchor, 1))
        .when(has(r"day after tomorrow|\blusa\b|后天"), F.date_add(anchor, 2))
        .when(has("next week|minggu depan|minggu hadapan|下个?周|下个?星期"), F.date_add(anchor, 7))
        .when(has("end of (?:the )?month|hujung bulan|月底"), F.last_day(anchor))
        .when(has("next month|bulan depan|bulan hadapan|下个?月"), F.last_day(F.add_months(F.trunc(anchor, "month"), 1)))
        .when(has("end of (?:the )?week|hujung minggu|周末|this week|minggu ini|本周"), coming(anchor, F.lit(6)))
        .when(has("this month|bulan ini|这个?月"), F.last_day(anchor))
        .when((has(led) | has(bare)) & (n > 0), span)
        .when(has(wide_day), coming(anchor, _lookup(group(wide_day, 1), WIDE_WEEKDAYS)))
        .when(has(latin_day), coming(base, _lookup(group(latin_day, 1), WEEKDAYS)))
    )


def annotate_dates(dates: Column, anchor: Column) -> Column:
    """Each comma part followed by ' (dd/MM/yyyy)' if it can be resolved; blank texts and texts with '(' stay."""
    raw = F.trim(F.coalesce(dates, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(p.alias("said"), _plain(p).alias("plain")))
    told = F.transform(pairs, lambda x: F.concat(x["said"], F.coalesce(F.concat(F.lit(" ("), F.date_format(_resolved(x["plain"], anchor), "dd/MM/yyyy"), F.lit(")")), F.lit(""))))
    return F.when((raw == "") | raw.contains("(") | anchor.isNull(), dates).otherwise(F.array_join(told, ", "))


def local_date(stored: Column, zone: str) -> Column:
    """The calendar date in the zone of a UTC text; null as '', other text as its first ten characters."""
    return _local(stored, zone, "yyyy-MM-dd", 10)


def local_datetime(stored: Column, zone: str) -> Column:
    """Date and minute in the zone; other text as its first sixteen characters."""
    return _local(stored, zone, "yyyy-MM-dd HH:mm", 16)


def _local(stored: Column, zone: str, pattern: str, width: int) -> Column:
    text = F.regexp_replace(F.replace(F.trim(stored), F.lit("T"), F.lit(" ")), "Z$", "")
    moment = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.coalesce(stored, F.lit("")) == "", "").otherwise(F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), pattern), F.substring(stored, 1, width)))
