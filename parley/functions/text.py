"""Column rules over text: languages, names, prompts, cues, support, likeness, names of files, replies.

All are expressions, evaluated inside the JVM; a null text gives what each docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOP_WORDS = ["will", "with", "that", "this", "from", "have", "should", "shall", "must", "their", "they", "them", "about", "into", "than", "then", "there", "these", "those", "your", "yours", "been", "before", "after", "meeting", "team", "make", "made", "need", "needs", "ensure", "going", "want", "wants", "also"]
SELF_ASSIGNMENT = (
    r"\b(?:i'?ll|i will|i can|i'?ve|i'?m going to|i shall|i'?d|let me)\b"
    r"|我来|我会|我负责|我可以|我去|由我|我把|我处理"
    r"|\b(?:saya\s+(?:akan|boleh|nak|akan\s+buat|uruskan|urus|handle|ambil|jaga|sediakan|hantar)|biar\s+saya|aku\s+(?:akan|boleh))\b"
)
RISK_CUE = (
    r"\b(?:if|unless|might|may|could|risk|risky|concern|concerned|worried|worry|fail|fails|failing|delay|delayed|behind|blocker|blocked|issue|problem|unable|can'?t|cannot|shortage|exceed|overrun|bottleneck|not enough)\b"
    r"|风险|如果|可能|担心|忧虑|问题|延迟|延误|失败|不够|赶不上|超出|瓶颈|阻碍|来不及"
    r"|\b(?:risiko|berisiko|jika|kalau|sekiranya|andai|mungkin|bimbang|risau|khuatir|masalah|bermasalah|isu|lewat|kelewatan|tertunda|gagal|kegagalan|halangan|terhalang|tersekat|kekurangan|melebihi|tidak\s+cukup|tak\s+cukup|tidak\s+dapat|tak\s+dapat|tak\s+sempat|belum\s+selesai)\b"
)
CJK = "[㐀-䶿一-鿿]"
CJK_OR_COMPATIBLE = "[㐀-䶿一-鿿豈-﫿]"
WIDE = "[　-〿㐀-䶿一-鿿＀-￯]"
STATUSES = {
    "uploading": ("Uploading…", True),
    "uploaded": ("Queued…", True),
    "audio_extracted": ("Detecting speech…", True),
    "vad_done": ("Detecting speech…", True),
    "transcribing": ("Transcribing…", True),
    "aligning": ("Aligning words…", True),
    "diarizing": ("Identifying speakers…", True),
    "diarized": ("Transcript ready", False),
    "categorizing": ("Extracting insights…", True),
    "ready": ("Ready", False),
}
LANGUAGE_NAMES = {"en": "English", "zh": "Chinese", "ms": "Malay"}


def canonical_language(code: Column) -> Column:
    """Trimmed lower case, null as '', Indonesian folded into Malay."""
    c = F.trim(F.lower(F.coalesce(code, F.lit(""))))
    return F.when(c == "id", "ms").otherwise(c)


def shares_script(a: Column, b: Column) -> Column:
    """Both Chinese or both not."""
    return (a == "zh") == (b == "zh")


def estimate_tokens(text: Column) -> Column:
    """Wide characters count one, all others a quarter; null counts 0."""
    t = F.coalesce(text, F.lit(""))
    narrow = F.length(F.regexp_replace(t, WIDE, ""))
    return (F.length(t) - narrow) + narrow / 4.0


def speaker_name(label: Column, display_name: Column) -> Column:
    """The display name unless null or empty, else the label; without either 'Unknown'."""
    return F.coalesce(F.nullif(display_name, F.lit("")), label, F.lit("Unknown"))


def output_language(primary: Column, detected: Column, fallback: str | None = "en") -> Column:
    """P5: the primary language unless it is null or 'auto', else the detected one, else the fallback."""
    return F.coalesce(F.when(primary != "auto", primary), detected, F.lit(fallback))


def prompt_line(segment_id: Column, speaker: Column, text: Column) -> Column:
    """P6: '[seg 12] Name: text' with the text trimmed."""
    return F.concat(F.lit("[seg "), segment_id.cast("string"), F.lit("] "), speaker, F.lit(": "), F.trim(F.coalesce(text, F.lit(""))))


def is_self_assignment(text: Column) -> Column:
    """Has a first-person commitment cue (English, Chinese, Malay); null has none."""
    return F.coalesce(text, F.lit("")).rlike("(?iuU)" + SELF_ASSIGNMENT)


def has_risk_cue(text: Column) -> Column:
    """Has a risk or issue cue; null has none."""
    return F.coalesce(text, F.lit("")).rlike("(?iuU)" + RISK_CUE)


def is_low_support(description: Column, text: Column, description_language: Column, text_language: Column) -> Column:
    """Same or unknown language, both sides comparable in one script, and nothing shared; empty sides give false."""

    def numbers(c):
        return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))

    def words(c):
        kept = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))
        return F.transform(kept, lambda w: F.substring(w, 1, 4))

    def wide(c):
        return F.regexp_extract_all(c, F.lit(f"({CJK})"), F.lit(1))

    d, t = F.coalesce(description, F.lit("")), F.coalesce(text, F.lit(""))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    other = ~blank(description_language) & ~blank(text_language) & (F.lower(F.trim(description_language)) != F.lower(F.trim(text_language)))
    shared = F.arrays_overlap(numbers(d), numbers(t)) | F.arrays_overlap(words(d), words(t)) | F.arrays_overlap(wide(d), wide(t))
    comparable = ((F.size(words(d)) > 0) & (F.size(words(t)) > 0)) | ((F.size(wide(d)) > 0) & (F.size(wide(t)) > 0))
    return (d != "") & (t != "") & ~F.coalesce(other, F.lit(False)) & ~shared & comparable


def status_info(status: Column) -> Column:
    """P10: struct(label, busy, failed); an unknown status is its own label."""
    label, busy = status, F.lit(False)
    for name, (text, is_busy) in STATUSES.items():
        label = F.when(status == name, text).otherwise(label)
        busy = F.when(status == name, F.lit(is_busy)).otherwise(busy)
    error, insights = status.startswith("error"), status.startswith("categorize_failed")
    label = F.when(error, "Failed").when(insights, "Transcript ready (insights failed)").otherwise(label)
    failed = F.coalesce(error | insights, F.lit(False))
    return F.struct(label.alias("label"), (F.coalesce(busy, F.lit(False)) & ~failed).alias("busy"), failed.alias("failed"))


def normalised(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only; null as ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def similar(a: Column, b: Column) -> Column:
    """Equal when normalised, or the shorter one (12 characters at least) is part of the longer; empty is like nothing."""
    x, y = normalised(a), normalised(b)
    short, long_ = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x != "") & (y != "") & ((x == y) | ((F.length(short) >= 12) & long_.contains(short)))


def slug(text: Column, longest: int = 40) -> Column:
    """Word characters in lower case joined by '_', cut; 'meeting' if nothing is left."""
    kept = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s-]", "")))
    cut = F.substring(F.regexp_replace(kept, r"(?U)[\s_-]+", "_"), 1, longest)
    return F.when(cut == "", "meeting").otherwise(cut)


def output_filename(title: Column, combined: Column, template: Column) -> Column:
    """Title, 'combined', 'minutes' and the template's name without a word that was cut, joined by '_'."""
    short = slug(template, 24)
    whole = F.when(short.contains("_") & (F.length(slug(template, 200)) > F.length(short)), F.regexp_replace(short, "_[^_]*$", "")).otherwise(short)
    suffix = F.when(F.coalesce(template, F.lit("")) != "", whole).otherwise(F.lit(""))
    parts = F.array(slug(title), F.when(combined, "combined").otherwise(""), F.lit("minutes"), suffix)
    return F.concat(F.array_join(F.filter(parts, lambda p: p != ""), "_"), F.lit(".docx"))


def fmt_time(seconds: Column) -> Column:
    """H:mm:ss, or m:ss under an hour; null as 0:00."""
    s = F.coalesce(seconds, F.lit(0.0)).cast("long")
    h, m, rest = F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def language_name(code: Column) -> Column:
    """The display name of a language, else its code, else '-'."""
    name = code
    for c, n in LANGUAGE_NAMES.items():
        name = F.when(code == c, n).otherwise(name)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("-"))


def reply_json(content: Column) -> Column:
    """The text from the first '{' to the last '}' if both are there in that order, else the whole; null if it doesn't parse."""
    first = F.instr(content, "{")
    last = F.length(content) - F.instr(F.reverse(content), "}") + 1
    inner = F.when((first > 0) & (F.instr(content, "}") > 0) & (last > first), F.substring(content, first, last - first + 1)).otherwise(content)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)
