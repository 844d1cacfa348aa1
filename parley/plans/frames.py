"""Meeting tables derived from the driver's tables, written once in SQL that Spark and DuckDB both read.

Each frame names the tables or frames it reads in braces. `Frames` gives it as a Spark DataFrame, `ctes` as the WITH clause
of a DuckDB query. Words that differ between the two dialects are written in capitals with an @ and replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_DIALECT = {
    "spark": {"@MICROS(": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ", "@LIST(": "array(", "@MOD(": "pmod(", "@HAS(": "array_contains("},
    "duck": {"@MICROS(": "epoch_us(", "@LIST(": "list_value(", "@MOD(": "mod(", "@HAS(": "list_contains("},
}
_ROLE = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"
_STATUS = "CASE @MOD({x}, 11) WHEN 0 THEN 'uploaded' WHEN 1 THEN 'transcribing' WHEN 2 THEN 'diarized' WHEN 3 THEN 'ready' WHEN 4 THEN 'categorizing' WHEN 5 THEN 'error: no audio' WHEN 6 THEN 'categorize_failed: model' WHEN 7 THEN 'vad_done' WHEN 8 THEN 'odd' ELSE 'ready' END"

_NTH = "CAST(1 + @MOD(length(line), {n}) AS STRING)"
_PICK = "CASE @MOD(length(line), {n}) {whens} END"


def _pick(*names: str) -> str:
    return _PICK.format(n=len(names), whens=" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(names)))


def _cue(kind: str) -> str:
    """A date phrase for a line: its kind from a number, its day, month or span from the line's length."""
    day, month, few = _NTH.format(n=31), _NTH.format(n=12), _NTH.format(n=9)
    week = _pick("Monday", "tuesday", "Wednesday", "thursday", "FRIDAY", "saturday", "Sunday")
    hari = _pick("isnin", "Selasa", "rabu", "khamis", "jumaat", "sabtu", "Ahad")
    wide = _pick("一", "二", "三", "四", "五", "六", "日", "天")
    name = _pick("January", "feb", "March", "apr", "May", "June", "jul", "August", "Sept", "october", "Nov", "december")
    count = _pick("a", "two", "3", "ten", "21", "one")
    kinds = [
        f"concat('by ', {week})",
        f"concat('before next ', {week})",
        f"concat({day}, ' ', {name})",
        f"concat({name}, ' ', {day}, 'th')",
        f"concat('2024-', {month}, '-', {day})",
        f"concat({day}, '/', {month})",
        f"concat({day}, '/', {month}, '/', CAST(20 + @MOD(length(line), 9) AS STRING))",
        f"concat('within ', {count}, ' ', {_pick('days', 'weeks', 'months', 'week', 'month')})",
        f"concat({month}, '月', {day}, '日')",
        f"concat('下周', {wide})",
        f"concat('星期', {wide})",
        f"concat('sebelum ', {hari})",
        f"concat('dalam ', {_pick('dua', '4', 'tujuh')}, ' ', {_pick('hari', 'minggu', 'bulan')})",
        _pick("today", "the day after tomorrow", "tomorrow", "end of month", "next month", "this week", "EOD", "Q3", "akhir bulan ini", "esok", "月底", "后天", "minggu depan", "hujung minggu", "lusa", "next week", "end of the week", "this month"),
        _pick("null (soon)", "tbd", "none yet", "n/a", "unknown", ""),
        f"concat({day}, ' of ', {name}, ', ', {few}, ' weeks, this ', {week})",
    ]
    whens = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(kinds))
    return f"CASE {kind} {whens} END"


#: A frame is one text for both, or a pair for Spark and DuckDB.
FRAMES: dict[str, str | tuple[str, str]] = {
    # speaker turns of meetings: events, one meeting for each user
    "turns": """
        SELECT user_id AS meeting_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS turn_no,
            (@MICROS(ts) - 1704067200000000) / 1e6 AS start_seconds,
            (@MICROS(ts) - 1704067200000000 + CAST(round(value * 600000000) AS BIGINT)) / 1e6 AS end_seconds, event_type AS speaker
        FROM {events}""",
    # half-day segments that hold an event
    "slots": """
        SELECT DISTINCT user_id * 1000 + CAST(floor((@MICROS(ts) - 1704067200000000) / 43200e6) AS BIGINT) AS id, user_id AS meeting_id,
            CAST(floor((@MICROS(ts) - 1704067200000000) / 43200e6) AS INT) AS segment_no FROM {events}""",
    "segments_a": """
        SELECT id, meeting_id, segment_no, CAST(NULL AS BIGINT) AS speaker_id, segment_no * 43200e0 AS start_seconds,
            (segment_no + 1) * 43200e0 AS end_seconds, concat('slot ', segment_no) AS text, 'en' AS language FROM {slots}""",
    "words_a": (
        """SELECT id * 100 + k AS id, meeting_id, id AS segment_id, CAST(segment_no * 24 + k AS INT) AS word_no, segment_no * 43200e0 + k * 1800e0 AS start_seconds,
            segment_no * 43200e0 + (k + 1) * 1800e0 AS end_seconds, concat('w', k) AS text, CAST(NULL AS DOUBLE) AS score
            FROM {slots} LATERAL VIEW explode(sequence(0, 23)) AS k""",
        """SELECT id * 100 + k AS id, meeting_id, id AS segment_id, CAST(segment_no * 24 + k AS INT) AS word_no, segment_no * 43200e0 + k * 1800e0 AS start_seconds,
            segment_no * 43200e0 + (k + 1) * 1800e0 AS end_seconds, concat('w', k) AS text, CAST(NULL AS DOUBLE) AS score
            FROM (SELECT *, unnest(range(24)) AS k FROM {slots})""",
    ),
    # conversations as meetings
    "spoken": f"""
        SELECT conv_id, CAST(turn AS INT) AS turn, {_ROLE} AS role_no, role, coalesce(text, '') AS text, 600 + 60 * length(coalesce(text, '')) AS ms,
            CASE @MOD(conv_id, 4) WHEN 0 THEN 'en' WHEN 1 THEN 'id' WHEN 2 THEN 'zh' ELSE 'ms' END AS language FROM {{conversations}}""",
    "segments_b": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS meeting_id, turn AS segment_no,
            CASE WHEN @MOD(turn, 5) = 4 THEN NULL ELSE conv_id * 10 + role_no END AS speaker_id,
            coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e3 AS start_seconds,
            sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e3 AS end_seconds, text,
            CASE WHEN @MOD(turn, 3) = 2 THEN 'ms' ELSE language END AS language FROM {spoken}""",
    "speakers_b": """
        SELECT DISTINCT conv_id * 10 + role_no AS id, conv_id AS meeting_id, concat('SPEAKER_0', role_no) AS label,
            CASE @MOD(conv_id, 3) WHEN 0 THEN concat('Person ', role) WHEN 1 THEN '' ELSE NULL END AS display_name FROM {spoken}""",
    "meetings_b": f"""
        SELECT conv_id AS id, concat('Meeting no. ', conv_id, ' - Plan/Review!') AS title, sum(ms) / 1e3 AS duration_seconds, CASE WHEN @MOD(conv_id, 7) = 6 THEN NULL ELSE min(language) END AS language,
            CASE @MOD(conv_id, 3) WHEN 0 THEN 'auto' WHEN 1 THEN 'en' ELSE NULL END AS primary_language, {_STATUS.format(x="conv_id")} AS status,
            concat('2024-03-', lpad(CAST(1 + @MOD(conv_id, 28) AS STRING), 2, '0'), ' ', lpad(CAST(@MOD(conv_id, 24) AS STRING), 2, '0'), ':30:00') AS created_at,
            CASE @MOD(conv_id, 5) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Summary of ', conv_id) END AS summary FROM {{spoken}} GROUP BY conv_id""",
    "words_b": (
        """SELECT id * 10000 + k AS id, meeting_id, id AS segment_id, CAST(k AS INT) AS word_no, round(start_seconds * 1000 + floor((end_seconds - start_seconds) * 1000 / n) * k) / 1e3 AS start_seconds,
            round(start_seconds * 1000 + floor((end_seconds - start_seconds) * 1000 / n) * (k + 1)) / 1e3 AS end_seconds, w AS text, pmod(k * 37, 100) / 100e0 AS score
            FROM (SELECT *, size(split(text, ' ')) AS n FROM {segments_b}) LATERAL VIEW posexplode(split(text, ' ')) AS k, w""",
        """SELECT id * 10000 + k AS id, meeting_id, id AS segment_id, CAST(k AS INT) AS word_no, round(start_seconds * 1000 + floor((end_seconds - start_seconds) * 1000 / n) * k) / 1e3 AS start_seconds,
            round(start_seconds * 1000 + floor((end_seconds - start_seconds) * 1000 / n) * (k + 1)) / 1e3 AS end_seconds, w AS text, (k * 37 % 100) / 100e0 AS score
            FROM (SELECT *, len(string_split(text, ' ')) AS n, unnest(range(len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS w FROM {segments_b})""",
    ),
    "clips": """
        SELECT meeting_id, 'ms' AS language, segment_no AS clip_no, start_seconds + @MOD(segment_no, 3) * 0.4e0 AS start_seconds, end_seconds + @MOD(segment_no, 3) * 0.4e0 AS end_seconds, concat('clip ', reverse(text)) AS text
        FROM {segments_b}""",
    # five rows of embeddings for each meeting
    "voiceprints": "SELECT CAST(floor(vec_id / 5) AS BIGINT) AS meeting_id, CAST(@MOD(vec_id, 5) AS INT) AS row_no, embedding FROM {embeddings}",
    # ten documents are one recording, and one meeting's items
    "detections": """
        SELECT CAST(floor(doc_id / 10) AS BIGINT) AS meeting_id, CASE lang WHEN 'fr' THEN ' MS' WHEN 'de' THEN 'zh' WHEN 'es' THEN 'id' ELSE lang END AS lang,
            CASE WHEN @MOD(n_chars, 7) = 0 THEN NULL ELSE @MOD(n_chars, 100) / 100e0 END AS prob, @MOD(n_chars, 50) / 20e0 AS seconds FROM {documents}""",
    # every line of every document, whole; the numbers are far enough apart for a document's lines
    "doc_lines": (
        "SELECT CAST(doc_id AS BIGINT) * 99991 + k AS id, CAST(doc_id AS BIGINT) AS doc_id, CAST(floor(doc_id / 10) AS BIGINT) AS meeting_id, k, line FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) AS k, line",
        "SELECT CAST(doc_id AS BIGINT) * 99991 + k AS id, CAST(doc_id AS BIGINT) AS doc_id, CAST(floor(doc_id / 10) AS BIGINT) AS meeting_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM {documents})",
    ),
    # extracted items: lines of documents that cite turns of a conversation; dates that are made of what the line measures
    "items": f"""
        SELECT id, meeting_id, CAST(@MOD(id, 3) AS INT) AS chunk_no,
            CASE @MOD(id, 5) WHEN 0 THEN 'action_items' WHEN 1 THEN 'decisions' WHEN 2 THEN 'deadlines' WHEN 3 THEN 'issues' ELSE 'risks' END AS category,
            CAST(@MOD(doc_id, 10) * 100000 + k AS INT) AS item_no, line AS description, CASE WHEN @MOD(id, 4) = 0 THEN 'Wei' END AS owner,
            {_cue("@MOD(id, 17)")} AS due, CASE WHEN @MOD(id, 7) < 6 THEN {_cue("@MOD(id + 5, 19)")} END AS date,
            CASE WHEN @MOD(id, 8) < 4 THEN concat('plan ', id) END AS mitigation,
            @LIST(meeting_id * 1000 + @MOD(id, 4), meeting_id * 1000 + @MOD(id, 3), meeting_id * 1000 + 900) AS source_segment_ids
        FROM {{doc_lines}}""",
    "chunks": (
        "SELECT meeting_id, CAST(pmod(segment_no, 3) AS INT) AS chunk_no, sort_array(collect_list(id)) AS segment_ids FROM {segments_b} GROUP BY meeting_id, CAST(pmod(segment_no, 3) AS INT)",
        "SELECT meeting_id, CAST(mod(segment_no, 3) AS INT) AS chunk_no, list(id ORDER BY id) AS segment_ids FROM {segments_b} GROUP BY meeting_id, CAST(mod(segment_no, 3) AS INT)",
    ),
    "replies": """
        SELECT CAST(floor(doc_id / 10) AS BIGINT) AS meeting_id, CAST(@MOD(doc_id, 4) AS INT) AS chunk_no, CAST(floor(@MOD(doc_id, 10) / 4) AS INT) AS attempt, CAST(doc_id AS BIGINT) AS doc_id,
            CASE @MOD(doc_id, 7) WHEN 0 THEN concat('note: {ob}"a": ', doc_id, '{cb} end') WHEN 1 THEN concat('{ob}"a": ', doc_id) WHEN 2 THEN concat('[', doc_id, ']') WHEN 3 THEN 'nothing' WHEN 4 THEN concat('{cb} x {ob}', doc_id) ELSE concat('{ob}"a": [', doc_id, '], "b": null{cb}') END AS content
        FROM {documents}""",
    # what the model said of each chunk that has items
    "summaries": """
        SELECT meeting_id, chunk_no, CASE WHEN @MOD(meeting_id, 3) = 0 THEN ' ' ELSE concat('part ', chunk_no) END AS summary FROM {items} GROUP BY meeting_id, chunk_no""",
    # orders as meetings that follow each other
    "meetings_o": f"""
        SELECT o_orderkey AS id, concat('Order ', o_orderkey) AS title, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS follow_up_of, o_orderdate AS created_at,
            round(o_totalprice) AS duration_seconds, CASE @MOD(o_orderkey, 4) WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN '' ELSE NULL END AS language, {_STATUS.format(x="o_orderkey")} AS status,
            CASE WHEN @MOD(o_orderkey, 3) = 0 THEN 'fine' END AS summary, CASE WHEN @MOD(o_orderkey, 2) = 0 THEN 'ready' END AS carry_forward_status FROM {{orders}}""",
    "speakers_o": "SELECT o_orderkey * 10 AS id, o_orderkey AS meeting_id, concat('S', @MOD(o_orderkey, 5)) AS label, CASE WHEN @MOD(o_orderkey, 2) = 0 THEN o_orderpriority END AS display_name FROM {orders}",
    "progress_events": """
        SELECT user_id AS meeting_id, ts, CASE event_type WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'categorizing' WHEN 'error' THEN 'transcribing' ELSE 'aligning' END AS stage, value / 400e0 AS progress FROM {events}""",
    "edits": """
        SELECT CAST(doc_id AS BIGINT) AS edit_id, CAST(doc_id AS BIGINT) * 99991 AS id, CASE WHEN @MOD(doc_id, 13) = 0 THEN -1 ELSE CAST(floor(doc_id / 10) AS BIGINT) END AS meeting_id,
            CASE @MOD(doc_id, 4) WHEN 0 THEN @LIST('description') WHEN 1 THEN @LIST('owner', 'status') WHEN 2 THEN @LIST('note', 'description') ELSE @LIST('source_segment_id') END AS fields,
            CASE WHEN @MOD(doc_id, 9) = 0 THEN '   ' ELSE concat(' new ', doc_id) END AS description, CASE WHEN quality = 1 THEN 'Ann' END AS owner,
            CASE @MOD(doc_id, 3) WHEN 0 THEN ' In Progress' WHEN 1 THEN 'finished' ELSE 'blocked' END AS status, concat('note ', toxic) AS note, @MOD(doc_id, 17) = 0 AS "delete" FROM {labels}""",
    "carried": """
        SELECT id, meeting_id, meeting_id - 1 AS previous_meeting_id, id AS previous_action_id, description, owner, CASE @MOD(id, 6) WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'blocked' WHEN 3 THEN 'changed' ELSE 'not_discussed' END AS status,
            CASE WHEN @MOD(id, 2) = 0 THEN 'said' END AS note, meeting_id * 1000 + @MOD(id, 9) AS source_segment_id FROM {items}""",
    "headed": """
        SELECT page_id AS template_id, CAST(1 AS INT) AS line_no, CASE WHEN @MOD(page_id, 3) = 0 THEN 'cell' ELSE 'paragraph' END AS kind, CASE WHEN @MOD(page_id, 4) = 0 THEN 'Heading 1' ELSE 'Normal' END AS style,
            CASE @MOD(page_id, 12) WHEN 0 THEN 'Date:' WHEN 1 THEN 'Action Items' WHEN 2 THEN 'put your key decisions here' WHEN 3 THEN 'Attendees' WHEN 4 THEN 'MINUTES OF MEETING' WHEN 5 THEN 'Risks and issues are talked about in this long line' WHEN 6 THEN 'Tarikh Akhir'
                WHEN 7 THEN '风险' WHEN 8 THEN concat('See [[ Summary ]] and [[odd ', page_id, ']] or [[title]]') WHEN 9 THEN 'Duration' WHEN 10 THEN 'Deadlines.' ELSE 'Key Dates :' END AS text,
            CASE WHEN @MOD(page_id, 6) = 0 THEN '' WHEN @MOD(page_id, 6) = 3 THEN '[[date]]' END AS next_text FROM {pages}
        UNION ALL SELECT page_id, CAST(2 AS INT), 'paragraph', 'Normal', concat('Page ', page_id, ' [[decisions]]'), NULL FROM {pages}
        UNION ALL SELECT page_id, CAST(0 AS INT), CASE WHEN @MOD(page_id, 7) IN (3, 4) THEN 'cell' ELSE 'paragraph' END, 'Normal',
            CASE @MOD(page_id, 7) WHEN 0 THEN 'Sumary:' WHEN 1 THEN 'Meeting titel' WHEN 2 THEN 'Keptusan penting' WHEN 3 THEN 'Meeting dat' WHEN 4 THEN 'Duraton' WHEN 5 THEN 'Riks' ELSE 'acton itmes' END,
            CASE @MOD(page_id, 7) WHEN 3 THEN '' WHEN 4 THEN '[[date]]' END FROM {pages}""",
    # what stands between the tags of a page, whole, behind two lines that are made up
    "page_lines": (
        "SELECT page_id AS template_id, CAST(k + 3 AS INT) AS line_no, line AS text FROM {pages} LATERAL VIEW posexplode(split(coalesce(html, ''), '<[^>]*>')) AS k, line WHERE trim(line) <> ''",
        "SELECT page_id AS template_id, CAST(k + 3 AS INT) AS line_no, line AS text FROM (SELECT page_id, unnest(regexp_split_to_array(coalesce(html, ''), '<[^>]*>')) AS line, unnest(range(len(regexp_split_to_array(coalesce(html, ''), '<[^>]*>')))) AS k FROM {pages}) WHERE trim(line) <> ''",
    ),
    "template_lines": """
        SELECT template_id, line_no, kind, style, text, next_text FROM {headed}
        UNION ALL SELECT template_id, line_no, 'paragraph', 'Normal', text, CAST(NULL AS STRING) FROM {page_lines}""",
}
_NAME = re.compile(r"\{(\w+)\}")


def _text(name: str, dialect: str) -> str:
    text = FRAMES[name]
    text = text if isinstance(text, str) else text[dialect == "duck"]
    for word, own in _DIALECT[dialect].items():
        text = text.replace(word, own)
    return text.replace('"delete"', "`delete`") if dialect == "spark" else text


def _needs(name: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(_text(name, "duck"))) if n not in ("ob", "cb")]


class Frames:
    """The derived tables of one data folder as DataFrames: frames.turns, or frames.table('events')."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                needed = {n: self.table(n) for n in _needs(name)}
                text = _text(name, "spark").replace("{ob}", "{{").replace("{cb}", "}}")
                self._made[name] = self.spark.sql(text, **needed)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FRAMES or name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def ctes(*names: str) -> str:
    """WITH … for DuckDB: the named frames and what they need, each once."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name in TABLES:
            return
        for n in _needs(name):
            add(n)
        done[name] = _text(name, "duck").replace("{ob}", "\u0001").replace("{cb}", "\u0002").format(**{n: n for n in _needs(name)}).replace("\u0001", "{").replace("\u0002", "}")

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text})" for n, text in done.items())
