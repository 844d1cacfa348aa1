"""The registered queries over meeting tables, each with its twin in DuckDB's SQL where SQL can say it.

Arrays and dates are given as text, and reckoned numbers rounded, so that both engines show the same values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import dates, text
from parley.operators import changes, followup, headings, insights, intervals, language, likeness, prompts, reads, replies, report, search_index, speakers
from parley.plans.frames import Frames, ctes
from parley.sources import stage, tables
from parley.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Bins for the long segments that are made of events.
HOURS = 12 * 3600


def query(oracle: str | None = None):
    """Registers a function of Frames under its name, with the SQL twin."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def joined(c: str, sep: str = ","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# --- intervals and speakers ---------------------------------------------------------------------------------------------

# a turn without length overlaps nothing, as in the reference (only overlaps above 0 count)
_OVERLAP = """, met AS (SELECT s.meeting_id, s.id, t.speaker, min(t.turn_no) AS first_turn,
    sum(least(round(s.end_seconds * 1e6), round(t.end_seconds * 1e6)) - greatest(round(s.start_seconds * 1e6), round(t.start_seconds * 1e6))) AS us
    FROM {items} s JOIN turns t ON s.meeting_id = t.meeting_id AND s.start_seconds < t.end_seconds AND t.start_seconds < s.end_seconds
    WHERE least(round(s.end_seconds * 1e6), round(t.end_seconds * 1e6)) > greatest(round(s.start_seconds * 1e6), round(t.start_seconds * 1e6)) GROUP BY ALL),
 best AS (SELECT *, sum(us) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY us DESC, first_turn) AS r FROM met) """
_SEGMENT_SPEAKER = ctes("segments_a", "turns") + _OVERLAP.format(items="segments_a") + """, attributed AS (SELECT s.*, CASE WHEN total >= 0.3 * greatest(1000, (s.end_seconds - s.start_seconds) * 1e6) THEN b.speaker END AS speaker
    FROM segments_a s LEFT JOIN best b ON b.id = s.id AND r = 1) """


@query(
    _SEGMENT_SPEAKER
    + """, names AS (SELECT meeting_id, speaker, concat('Speaker ', row_number() OVER (PARTITION BY meeting_id ORDER BY min(start_seconds))) AS speaker_name FROM attributed WHERE speaker IS NOT NULL GROUP BY meeting_id, speaker)
    SELECT a.meeting_id, a.speaker, sum(end_seconds - start_seconds) AS seconds, count(*) AS segments, any_value(speaker_name) AS speaker_name FROM attributed a JOIN names USING (meeting_id, speaker) GROUP BY a.meeting_id, a.speaker"""
)
def speaker_minutes(f):
    return speakers.speaker_minutes(f.segments_a, f.turns, HOURS)


@query(_SEGMENT_SPEAKER + "SELECT id, meeting_id, speaker FROM attributed")
def j2_segment_speaker(f):
    return intervals.segment_speaker(f.segments_a, f.turns, bin_seconds=HOURS).select("id", "meeting_id", "speaker")


@query(ctes("words_a", "turns") + _OVERLAP.format(items="words_a") + "SELECT w.id, w.meeting_id, b.speaker FROM words_a w LEFT JOIN best b ON b.id = w.id AND r = 1")
def j3_word_speaker(f):
    return intervals.word_speaker(f.words_a, f.turns, HOURS).select("id", "meeting_id", "speaker")


_WORD_SPEAKER = ctes("words_a", "turns") + _OVERLAP.format(items="words_a") + ", heard AS (SELECT w.*, b.speaker FROM words_a w LEFT JOIN best b ON b.id = w.id AND r = 1)"
_FILLED = (
    _WORD_SPEAKER
    + """, filled AS (SELECT id, meeting_id, segment_id, word_no, start_seconds, end_seconds, coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY segment_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(speaker IGNORE NULLS) OVER (PARTITION BY segment_id ORDER BY word_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM heard) """
)


@query(_FILLED + "SELECT id, meeting_id, speaker FROM filled")
def w1_fill_word_speakers(f):
    return speakers.fill_word_speakers(intervals.word_speaker(f.words_a, f.turns, HOURS)).select("id", "meeting_id", "speaker")


@query(
    _FILLED
    + """, flagged AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM filled WINDOW w AS (PARTITION BY segment_id ORDER BY word_no)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY word_no) AS run_no FROM flagged)
    SELECT meeting_id, segment_id, CAST(run_no AS BIGINT) AS run_no, any_value(speaker) AS speaker, min(word_no) AS first_word, max(word_no) AS last_word, count(*) AS words, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds FROM numbered GROUP BY meeting_id, segment_id, run_no"""
)
def w2_speaker_runs(f):
    return speakers.speaker_runs(speakers.fill_word_speakers(intervals.word_speaker(f.words_a, f.turns, HOURS)))


def _smoothed_sql(runs: str) -> str:
    """smooth (meeting_id, segment_id, smooth_no, speaker, f, l) from the named table of runs: one step of the walk for each run of each pass."""
    x = "struct_pack(s := sp, w := x.w, a := x.a, b := x.b, f := x.f, l := x.l)"
    merged = f"CASE WHEN len(merged) > 0 AND merged[len(merged)].s IS NOT DISTINCT FROM sp THEN list_append(merged[1:len(merged) - 1], struct_pack(s := sp, w := merged[len(merged)].w + x.w, a := merged[len(merged)].a, b := x.b, f := merged[len(merged)].f, l := x.l)) ELSE list_append(merged, {x}) END"
    return f""", r0 AS (SELECT meeting_id, segment_id, list(struct_pack(s := speaker, w := words, a := start_seconds, b := end_seconds, f := run_no, l := run_no) ORDER BY run_no) AS runs, count(*) AS n FROM {runs} GROUP BY ALL),
    steps AS (SELECT meeting_id, segment_id, n, 1 AS pass, 1 AS k, runs, runs[0] AS prev, runs[1:0] AS merged, false AS changed, n < 2 AS done FROM r0
    UNION ALL SELECT meeting_id, segment_id, n, CASE WHEN k > len(runs) AND again THEN pass + 1 ELSE pass END, CASE WHEN k > len(runs) THEN 1 ELSE k + 1 END, CASE WHEN k > len(runs) AND changed THEN merged ELSE runs END,
        CASE WHEN k > len(runs) THEN runs[0] ELSE {x} END, CASE WHEN k > len(runs) THEN runs[1:0] ELSE {merged} END, CASE WHEN k > len(runs) THEN false ELSE changed OR short END, k > len(runs) AND NOT again
        FROM (SELECT *, CASE WHEN short THEN CASE WHEN k > 1 AND (nxt IS NULL OR prev.w >= nxt.w) THEN prev.s ELSE nxt.s END ELSE x.s END AS sp, changed AND len(merged) > 1 AND pass < n AS again
            FROM (SELECT *, runs[k] AS x, runs[k + 1] AS nxt, coalesce(runs[k].w <= 2 AND runs[k].b - runs[k].a < 0.8, false) AS short FROM steps WHERE NOT done))),
    smooth AS (SELECT meeting_id, segment_id, unnest(range(1, len(runs) + 1)) AS smooth_no, unnest(runs).s AS speaker, unnest(runs).f AS f, unnest(runs).l AS l FROM steps WHERE done) """


_RUNS = (
    _FILLED
    + """, flagged AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM filled WINDOW w AS (PARTITION BY segment_id ORDER BY word_no)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY word_no) AS run_no FROM flagged) """
)


@query(
    _RUNS
    + ", runs AS (SELECT meeting_id, segment_id, CAST(run_no AS BIGINT) AS run_no, any_value(speaker) AS speaker, min(word_no) AS first_word, max(word_no) AS last_word, count(*) AS words, min(start_seconds) / 3600 AS start_seconds, min(start_seconds) / 3600 + count(*) * 0.3e0 AS end_seconds FROM numbered GROUP BY meeting_id, segment_id, run_no) "
    + _smoothed_sql("runs")
    + "SELECT r.meeting_id, r.segment_id, r.run_no, s.speaker, first_word, last_word, words, start_seconds, end_seconds, smooth_no FROM runs r JOIN smooth s ON s.meeting_id = r.meeting_id AND s.segment_id = r.segment_id AND r.run_no BETWEEN s.f AND s.l"
)
def r8_smooth_runs(f):
    runs = speakers.speaker_runs(speakers.fill_word_speakers(intervals.word_speaker(f.words_a, f.turns, HOURS)))
    return speakers.smooth_runs(runs.withColumns({"start_seconds": F.col("start_seconds") / 3600, "end_seconds": F.col("start_seconds") / 3600 + F.col("words") * 0.3}))


_OF_SEGMENTS = re.sub(r"\b(met|best)\b", r"segment_\1", _OVERLAP.format(items="segments_a"))
_ENOUGH = "total >= 0.01 * greatest(1000, (end_seconds - start_seconds) * 1e6)"


@query(
    ctes("segments_a", "words_a", "turns")
    + _OF_SEGMENTS
    + f""", told AS (SELECT s.*, b.speaker, coalesce({_ENOUGH}, false) AS enough, mod(s.id, 7) <> 3 AS has_words FROM segments_a s LEFT JOIN segment_best b ON b.id = s.id AND r = 1),
    mine AS (SELECT w.* FROM words_a w JOIN told t ON t.id = w.segment_id AND has_words AND enough) """
    + _RUNS.removeprefix(ctes("words_a", "turns")).replace("words_a", "mine")
    + ", runs AS (SELECT meeting_id, segment_id, CAST(run_no AS BIGINT) AS run_no, any_value(speaker) AS speaker, count(*) AS words, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds FROM numbered GROUP BY meeting_id, segment_id, run_no) "
    + _smoothed_sql("runs")
    + """, parts AS (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n FROM smooth),
    cut AS (SELECT p.meeting_id, p.segment_id AS id, smooth_no AS part_no, p.speaker, min(w.start_seconds) AS start_seconds, max(w.end_seconds) AS end_seconds, string_agg(w.text, ' ' ORDER BY w.word_no) AS text FROM parts p JOIN numbered k ON k.segment_id = p.segment_id AND k.run_no BETWEEN f AND l JOIN mine w ON w.id = k.id WHERE n > 1 GROUP BY ALL)
    SELECT meeting_id, id, 1::BIGINT AS part_no, start_seconds, end_seconds, text, language, CASE WHEN enough AND NOT has_words THEN speaker END AS speaker FROM told WHERE NOT (has_words AND enough)
    UNION ALL SELECT t.meeting_id, t.id, 1, t.start_seconds, t.end_seconds, text, language, p.speaker FROM told t JOIN parts p ON p.segment_id = t.id AND n = 1
    UNION ALL SELECT c.meeting_id, c.id, part_no, c.start_seconds, c.end_seconds, c.text, language, c.speaker FROM cut c JOIN told t USING (id)"""
)
def r7_split_by_speaker(f):
    return speakers.split_by_speaker(f.segments_a, f.words_a.where("segment_id % 7 <> 3"), f.turns, 0.01, HOURS)


@query(
    ctes("segments_b", "words_b")
    + """, shifted AS (SELECT *, start_seconds + 0.7 AS s, end_seconds + 0.7 AS e FROM words_b),
    w AS (SELECT *, max(round(s * 1e6) + round(e * 1e6)) OVER (PARTITION BY meeting_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM shifted),
    g AS (SELECT meeting_id, id, segment_no, 2 * max(round(end_seconds * 1e6)) OVER (PARTITION BY meeting_id ORDER BY segment_no) AS e FROM segments_b),
    l AS (SELECT meeting_id, max_by(id, segment_no) AS last FROM segments_b GROUP BY meeting_id),
    b AS (SELECT meeting_id, e, min(segment_no) AS segment_no, min_by(id, segment_no) AS sid FROM g GROUP BY meeting_id, e)
    SELECT w.id, w.meeting_id, coalesce(b.sid, l.last) AS bucket_id FROM w JOIN l USING (meeting_id) ASOF LEFT JOIN b ON w.meeting_id = b.meeting_id AND w.m < b.e"""
)
def j1_bucket_words(f):
    moved = f.words_b.withColumns({"start_seconds": F.col("start_seconds") + 0.7, "end_seconds": F.col("end_seconds") + 0.7, "word_no": F.col("id")})
    return intervals.bucket_words(moved, f.segments_b).select("id", "meeting_id", "bucket_id")


@query(
    ctes("segments_b", "clips")
    + """, minority AS (SELECT * FROM segments_b WHERE language = 'ms'),
    met AS (SELECT c.meeting_id, c.clip_no, trim(c.text) AS t, min(s.segment_no) AS segment_no FROM clips c JOIN minority s ON c.meeting_id = s.meeting_id AND
        2 * (least(round(c.end_seconds * 1e6), round(s.end_seconds * 1e6)) - greatest(round(c.start_seconds * 1e6), round(s.start_seconds * 1e6))) > round(c.end_seconds * 1e6) - round(c.start_seconds * 1e6) GROUP BY ALL),
    texts AS (SELECT meeting_id, segment_no, string_agg(t, ' ' ORDER BY clip_no) AS t FROM met WHERE t <> '' GROUP BY ALL)
    SELECT s.id, coalesce(t, text) AS text, CASE WHEN t IS NULL THEN language ELSE 'ms' END AS language FROM segments_b s LEFT JOIN texts x ON x.meeting_id = s.meeting_id AND x.segment_no = s.segment_no"""
)
def j4_graft_text(f):
    return intervals.graft_text(f.segments_b, f.clips, f.segments_b.where("language = 'ms'")).select("id", "text", "language")


@query(
    ctes("segments_b")
    + """, s AS (SELECT meeting_id, start_seconds, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) - 1 AS ordinal FROM segments_b),
    t AS (SELECT meeting_id, id AS time_id, end_seconds * 0.7 + 1 AS seconds FROM segments_b)
    SELECT t.meeting_id, t.time_id, coalesce(max(s.ordinal), 0) AS ordinal FROM t LEFT JOIN s ON s.meeting_id = t.meeting_id AND round(s.start_seconds * 1e6) <= round(t.seconds * 1e6) + 50000 GROUP BY ALL"""
)
def j9_segment_at(f):
    return intervals.segment_at(f.segments_b, f.segments_b.select("meeting_id", F.col("id").alias("time_id"), (F.col("end_seconds") * 0.7 + 1).alias("seconds")))


@query(ctes("turns") + "SELECT meeting_id, turn_no AS piece_no, start_seconds + turn_no * 600e0 AS start_seconds, end_seconds + turn_no * 600e0 AS end_seconds FROM turns WHERE mod(turn_no, 9) <> 0")
def i1_stitch_speech(f):
    return intervals.stitch_speech(f.turns.select("meeting_id", F.col("turn_no").alias("piece_no"), "start_seconds", "end_seconds", (F.col("turn_no") % 9 == 0).alias("failed")))


@query(
    ctes("meetings_b")
    + """, s AS (SELECT id, duration_seconds AS d, unnest(range(10)) AS k FROM meetings_b), p AS (SELECT id, d, k, greatest(0, least((k + 0.5) * d / 10 - 12.5, greatest(0, d - 25))) AS a FROM s)
    SELECT id AS meeting_id, CAST(k AS INT) AS window_no, round(a, 6) AS start_seconds, round(least(d, a + 25), 6) AS end_seconds FROM p WHERE least(d, a + 25) - a >= 2"""
)
def w7_detection_windows(f):
    return intervals.detection_windows(f.meetings_b).withColumns({c: F.round(c, 6) for c in ("start_seconds", "end_seconds")})


@query(ctes("turns") + "SELECT meeting_id, speaker, sum(CAST(round(end_seconds * 1e6) AS BIGINT) - CAST(round(start_seconds * 1e6) AS BIGINT)) / 1e6 AS seconds FROM turns GROUP BY ALL")
def g1_talk_time(f):
    return speakers.talk_time(f.turns)


_LABELLED = (
    ctes("turns", "voiceprints")
    + """, labels_ AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY speaker) AS no, count(*) OVER (PARTITION BY meeting_id) AS k FROM (SELECT DISTINCT meeting_id, speaker FROM turns)),
    rows_ AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY row_no) AS no, count(*) OVER (PARTITION BY meeting_id) AS k FROM voiceprints),
    labelled AS (SELECT r.meeting_id, l.speaker, r.embedding FROM rows_ r JOIN labels_ l ON r.meeting_id = l.meeting_id AND r.no = l.no AND r.k = l.k WHERE len(list_filter(r.embedding, lambda x: isnan(x))) = 0) """
)


@query(_LABELLED + "SELECT meeting_id, speaker, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM labelled")
def j6_voiceprint_labels(f):
    told = speakers.voiceprint_labels(f.voiceprints, f.turns)
    return told.select("meeting_id", "speaker", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(
    _LABELLED
    + """, talk AS (SELECT meeting_id, speaker, sum(CAST(round(end_seconds * 1e6) AS BIGINT) - CAST(round(start_seconds * 1e6) AS BIGINT)) / 1e6 AS seconds FROM turns GROUP BY ALL),
    known AS (SELECT l.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, coalesce(seconds < 60000, false) AS phantom, count(*) OVER (PARTITION BY l.meeting_id) AS k FROM labelled l LEFT JOIN talk USING (meeting_id, speaker)),
    pairs AS (SELECT a.meeting_id, a.speaker, b.speaker AS target, list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a.e, lambda x: x * x)) * list_sum(list_transform(b.e, lambda x: x * x))) AS c
        FROM known a JOIN known b ON a.meeting_id = b.meeting_id AND a.phantom AND NOT b.phantom AND a.k > 1),
    to_ AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY c DESC, target) = 1)
    SELECT t.meeting_id, t.turn_no, coalesce(target, t.speaker) AS speaker FROM turns t LEFT JOIN to_ USING (meeting_id, speaker)"""
)
def j5_merge_phantoms(f):
    labelled = speakers.voiceprint_labels(f.voiceprints, f.turns)
    return speakers.merge_phantoms(f.turns, labelled, 60_000.0).select("meeting_id", "turn_no", "speaker")


@query(_SEGMENT_SPEAKER + "SELECT meeting_id, speaker, concat('Speaker ', row_number() OVER (PARTITION BY meeting_id ORDER BY min(start_seconds))) AS speaker_name FROM attributed WHERE speaker IS NOT NULL GROUP BY meeting_id, speaker")
def w3_number_speakers(f):
    return speakers.number_speakers(intervals.segment_speaker(f.segments_a, f.turns, bin_seconds=HOURS))


# --- languages ----------------------------------------------------------------------------------------------------------

_CANON = "CASE WHEN trim(lower(coalesce({0}, ''))) = 'id' THEN 'ms' ELSE trim(lower(coalesce({0}, ''))) END"
_VOTES = ctes("detections") + ", canon AS (SELECT meeting_id, " + _CANON.format("lang") + " AS lang, prob, seconds FROM detections), votes AS (SELECT * FROM canon WHERE lang IN ('en', 'zh', 'ms') AND (prob IS NULL OR prob >= 0.3))"
_DOMINANT = (
    _VOTES
    + ", counts AS (SELECT meeting_id, lang, count(*) AS n FROM votes GROUP BY ALL), best AS (SELECT meeting_id, lang AS dominant, count(*) OVER (PARTITION BY meeting_id) > 1 AS is_mixed FROM counts QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, lang) = 1), dom AS (SELECT m.meeting_id, coalesce(dominant, 'en') AS dominant, coalesce(is_mixed, false) AS is_mixed FROM (SELECT DISTINCT meeting_id FROM detections) m LEFT JOIN best USING (meeting_id)) "
)


@query(ctes("detections") + "SELECT lang, " + _CANON.format("lang") + " AS canonical, (" + _CANON.format("lang") + " = 'zh') = (lang = 'zh') AS same_script, count(*) AS n FROM detections GROUP BY ALL")
def p1_p2_language_rules(f):
    canonical = text.canonical_language(F.col("lang"))
    return f.detections.select("lang", canonical.alias("canonical"), text.shares_script(canonical, F.col("lang")).alias("same_script")).groupBy("lang", "canonical", "same_script").agg(F.count("*").alias("n"))


@query(_DOMINANT + "SELECT * FROM dom")
def g2_dominant_language(f):
    return language.dominant_language(language.window_votes(f.detections), f.detections)


_MINORITY = _DOMINANT + ", minority AS (SELECT c.meeting_id, lang, dominant, count(*) AS n FROM canon c JOIN dom USING (meeting_id) WHERE seconds >= 0.6 AND lang IN ('en', 'zh', 'ms') AND lang <> dominant AND (prob IS NULL OR prob >= 0.55) GROUP BY ALL) "


@query(_MINORITY + "SELECT meeting_id, lang, n FROM minority")
def p12_language_gate(f):
    dominant = language.dominant_language(language.window_votes(f.detections), f.detections)
    return language.segment_votes(f.detections, dominant).groupBy("meeting_id", "lang").agg(F.count("*").alias("n"))


@query(_MINORITY + ", totals AS (SELECT meeting_id, count(*) AS total FROM detections GROUP BY ALL) SELECT m.meeting_id, lang, n FROM minority m JOIN totals USING (meeting_id) WHERE (lang = 'zh') <> (dominant = 'zh') OR (n >= 3 AND n >= 0.1 * total)")
def g4_corroborated_languages(f):
    dominant = language.dominant_language(language.window_votes(f.detections), f.detections)
    votes = language.segment_votes(f.detections, dominant).groupBy("meeting_id", "lang").agg(F.count("*").alias("n"))
    return language.corroborated_languages(votes, f.detections.groupBy("meeting_id").agg(F.count("*").alias("total")).join(dominant, "meeting_id"))


@query(ctes("segments_b") + ", c AS (SELECT meeting_id, " + _CANON.format("language") + " AS lang FROM segments_b) SELECT meeting_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM c GROUP BY meeting_id")
def g3_languages_in_segments(f):
    return language.languages_in_segments(f.segments_b).select("meeting_id", F.array_join("languages", ",").alias("languages"))


# --- text rules ---------------------------------------------------------------------------------------------------------

_LINES = (
    ctes("segments_b", "speakers_b")
    + """, lines AS (SELECT s.meeting_id, s.id, s.start_seconds, s.text, concat('[seg ', s.id, '] ', coalesce(nullif(p.display_name, ''), p.label, 'Unknown'), ': ', trim(s.text)) AS line,
    length(concat('[seg ', s.id, '] ', coalesce(nullif(p.display_name, ''), p.label, 'Unknown'), ': ', trim(s.text))) / 4.0 AS tokens FROM segments_b s LEFT JOIN speakers_b p ON p.id = s.speaker_id) """
)


@query(_LINES + "SELECT id, line, CAST(tokens AS DOUBLE) AS tokens FROM lines")
def p3_p4_p6_prompt_lines(f):
    return prompts.lines(f.segments_b, f.speakers_b).select("id", "line", "tokens")


@query(ctes("meetings_b") + "SELECT id, coalesce(CASE WHEN primary_language <> 'auto' THEN primary_language END, language, 'en') AS language FROM meetings_b")
def p5_output_language(f):
    return f.meetings_b.select("id", text.output_language(F.col("primary_language"), F.col("language")).alias("language"))


_ASCII = r"regexp_replace(coalesce({0}, ''), '[^\x00-\x7F]', 'z', 'g')"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


@query(
    "SELECT doc_id, regexp_matches(" + _ASCII.format("text") + ", '" + _re2(text.SELF_ASSIGNMENT) + "') AS self_assignment, regexp_matches(" + _ASCII.format("text") + ", '" + _re2(text.RISK_CUE) + "') AS risk_cue FROM documents"
)
def p7_p8_cues(f):
    return f.documents.select("doc_id", text.is_self_assignment(F.col("text")).alias("self_assignment"), text.has_risk_cue(F.col("text")).alias("risk_cue"))


_INFO = {n: (label, busy) for n, (label, busy) in text.STATUSES.items()}


@query(
    ctes("meetings_o")
    + "SELECT status, CASE WHEN starts_with(status, 'error') THEN 'Failed' WHEN starts_with(status, 'categorize_failed') THEN 'Transcript ready (insights failed)' "
    + " ".join(f"WHEN status = '{n}' THEN '{label}'" for n, (label, _) in _INFO.items())
    + " ELSE status END AS label, status IN ("
    + ", ".join(f"'{n}'" for n, (_, busy) in _INFO.items() if busy)
    + ") AS busy, starts_with(status, 'error') OR starts_with(status, 'categorize_failed') AS failed, count(*) AS n FROM meetings_o GROUP BY ALL"
)
def p10_status_info(f):
    return f.meetings_o.select("status", text.status_info(F.col("status")).alias("i")).select("status", "i.*").groupBy("status", "label", "busy", "failed").agg(F.count("*").alias("n"))


@query(ctes("meetings_o") + "SELECT id FROM meetings_o WHERE id <> 5 AND status NOT IN (" + ", ".join(f"'{n}'" for n, (_, busy) in _INFO.items() if busy) + ")")
def p11_follow_up_candidates(f):
    return followup.follow_up_candidates(f.meetings_o, 5).select("id")


_SLUG = r"trim(regexp_replace({0}, '[^\w\s-]', '', 'g'))"


@query(ctes("meetings_b") + r"SELECT id, concat(substr(regexp_replace(lower(trim(regexp_replace(title, '[^\w\s-]', '', 'g'))), '[\s_-]+', '_', 'g'), 1, 40), CASE WHEN mod(id, 2) = 0 THEN '_combined' ELSE '' END, '_minutes', CASE WHEN mod(id, 3) = 0 THEN '_very_long_template_name' ELSE '' END, '.docx') AS filename FROM meetings_b")
def r6_output_filename(f):
    template = F.when(F.col("id") % 3 == 0, "Very long Template name, indeed").otherwise("")
    return f.meetings_b.select("id", text.output_filename(F.col("title"), F.col("id") % 2 == 0, template).alias("filename"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    ctes("items")
    + ", n AS (SELECT * FROM (SELECT id, category, "
    + _NORM.format("description")
    + """ AS t FROM items) WHERE t <> ''), f AS (SELECT category, t, min(id) AS id FROM n GROUP BY category, t)
    SELECT least(a.id, b.id) AS id, greatest(a.id, b.id) AS other FROM f a JOIN f b ON a.category = b.category AND length(a.t) >= 12 AND length(a.t) < length(b.t) AND contains(b.t, a.t)
    UNION ALL SELECT f.id, n.id FROM n JOIN f ON f.category = n.category AND f.t = n.t AND n.id <> f.id"""
)
def r9_similar(f):
    return likeness.like_items(f.items, ["category"])


@query(ctes("turns") + "SELECT meeting_id, turn_no, CASE WHEN floor(start_seconds / 3600) > 0 THEN printf('%d:%02d:%02d', CAST(floor(start_seconds / 3600) AS BIGINT), CAST(floor(mod(CAST(floor(start_seconds) AS BIGINT), 3600) / 60) AS BIGINT), mod(CAST(floor(start_seconds) AS BIGINT), 60)) ELSE printf('%d:%02d', CAST(floor(start_seconds / 60) AS BIGINT), mod(CAST(floor(start_seconds) AS BIGINT), 60)) END AS at FROM turns")
def d6_fmt_time(f):
    return f.turns.select("meeting_id", "turn_no", text.fmt_time(F.col("start_seconds")).alias("at"))


@query(ctes("replies") + r""", inner_ AS (SELECT *, CASE WHEN instr(content, '{') > 0 AND length(content) - instr(reverse(content), '}') + 1 > instr(content, '{') AND instr(content, '}') > 0 THEN substr(content, instr(content, '{'), length(content) - instr(reverse(content), '}') + 2 - instr(content, '{')) ELSE content END AS j FROM replies)
    SELECT doc_id, CASE WHEN json_valid(j) THEN j END AS json FROM inner_""")
def r1_reply_json(f):
    return f.replies.select("doc_id", text.reply_json(F.col("content")).alias("json"))


@query(ORACLES["r1_reply_json"].split("SELECT doc_id, CASE WHEN json_valid")[0] + ", good AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, chunk_no ORDER BY attempt) AS r FROM inner_ WHERE json_valid(j)) SELECT meeting_id, chunk_no, attempt, j AS json, false AS skipped FROM good WHERE r = 1 UNION ALL SELECT meeting_id, chunk_no, NULL, NULL, true FROM inner_ GROUP BY meeting_id, chunk_no HAVING count(*) FILTER (json_valid(j)) = 0")
def k4_first_parseable(f):
    good, none = replies.first_parseable(f.replies)
    return good.select("meeting_id", "chunk_no", "attempt", "json", F.lit(False).alias("skipped")).unionByName(none.withColumn("skipped", F.lit(True)), allowMissingColumns=True)


# --- dates --------------------------------------------------------------------------------------------------------------


@query(
    ctes("items")
    + r", c AS (SELECT id, concat_ws(' / ', "
    + _ASCII.format("description")
    + r", due, date) AS cue FROM items) SELECT id, array_to_string(list_transform(regexp_extract_all(cue, '"
    + _re2(dates.CUES)
    + "'), lambda x: trim(x)), '; ') AS cues FROM c"
)
def d1_date_cues(f):
    return f.items.select("id", F.array_join(dates.date_cues(F.concat_ws(" / ", "description", "due", "date")), "; ").alias("cues"))


@query(ctes("items") + f""" SELECT id, trim(regexp_replace(trim(lower(coalesce(due, ''))), '^(?:(?:by|before|on|due|this|next|the|in|within|sebelum|menjelang|pada|dalam)\\s+)+', ''), ' .,:;''"-—') AS norm, trim(regexp_replace(coalesce(due, ''), '(?i)^(?:by|on|before|due|sebelum|menjelang|pada)\\s+', '')) AS shown FROM items""")
def d2_norm_date(f):
    return f.items.select("id", dates.norm_date(F.col("due")).alias("norm"), dates.display_date(F.col("due")).alias("shown"))


_ANCHOR = "CAST(DATE '2024-03-01' + CAST(mod(id, 60) AS INT) AS DATE)"


def _number_of(x: str, values: dict[str, int]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _resolved(cue: str, a: str = "a") -> str:
    """D3 in DuckDB's SQL: the rules in their order, over any cue."""
    c = f"regexp_replace(lower(trim({cue})), '\\s+', ' ', 'g')"
    has = lambda p: f"regexp_matches({c}, '{p}')"
    group = lambda p, k: f"regexp_extract({c}, '{p}', {k})"
    number = lambda p, k: f"try_cast({group(p, k)} AS INT)"
    day_of = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"
    coming = lambda base, k: f"({base} + CAST(mod(mod({k} - (isodow({base}) - 1), 7) + 7, 7) AS INT))"
    month_end = lambda ahead: f"last_day(CAST(date_trunc('month', {a}) AS DATE) + to_months(CAST({ahead} AS INT)))"
    iso, slash, wide = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b", r"(\d{1,2})\s*月\s*(\d{1,2})\s*[号日]"
    names = "|".join(sorted(dates.MONTHS, key=len, reverse=True))
    first, second = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({names})\b", rf"\b({names})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
    day = f"CASE WHEN {has(first)} THEN {number(first, 1)} ELSE {number(second, 2)} END"
    month = _number_of(f"CASE WHEN {has(first)} THEN {group(first, 2)} ELSE {group(second, 1)} END", dates.MONTHS)
    said = f"year({a})"
    named = f"CASE WHEN {day_of(said, month, day)} < {a} - 180 THEN {day_of(said + ' + 1', month, day)} ELSE {day_of(said, month, day)} END"
    year = f"CASE WHEN {group(slash, 3)} = '' THEN {said} WHEN {number(slash, 3)} < 100 THEN {number(slash, 3)} + 2000 ELSE {number(slash, 3)} END"
    units = "(day|days|week|weeks|month|months|hari|minggu|bulan|天|周|个月)"
    led, bare = rf"\b(?:within|in|dalam)\s+([a-z一-鿿]+|\d+)\s+{units}\b", rf"\b([a-z一-鿿]+|\d+)\s+{units}\b"
    raw, unit = (f"CASE WHEN {has(led)} THEN {group(led, k)} ELSE {group(bare, k)} END" for k in (1, 2))
    n = f"coalesce(try_cast({raw} AS INT), {_number_of(raw, dates.NUMBERS)})"
    span = f"CASE WHEN {unit} IN ('day', 'days', 'hari', '天') THEN {a} + CAST({n} AS INT) WHEN {unit} IN ('week', 'weeks', 'minggu', '周') THEN {a} + CAST({n} * 7 AS INT) ELSE {month_end(n + ' - 1')} END"
    wide_day, latin_day = "(?:星期|周|礼拜)\\s*([一二三四五六日天])", rf"\b({'|'.join(dates.WEEKDAYS)})\b"
    rules = [
        (f"{cue} IS NULL OR {cue} = ''", "NULL"),
        (has(iso), day_of(number(iso, 1), number(iso, 2), number(iso, 3))),
        (has(slash), day_of(year, number(slash, 2), number(slash, 1))),
        (has(wide), day_of(said, number(wide, 1), number(wide, 2))),
        (f"{has(first)} OR {has(second)}", named),
        (has(r"\b(today|tonight)\b|hari ini|malam ini|今天|今晚"), a),
        (has(r"\btomorrow\b|\besok\b|\bbesok\b|明天|明晚"), f"{a} + 1"),
        (has(r"day after tomorrow|\blusa\b|后天"), f"{a} + 2"),
        (has("next week|minggu depan|minggu hadapan|下个?周|下个?星期"), f"{a} + 7"),
        (has("end of (?:the )?month|hujung bulan|月底"), f"last_day({a})"),
        (has("next month|bulan depan|bulan hadapan|下个?月"), month_end("1")),
        (has("end of (?:the )?week|hujung minggu|周末|this week|minggu ini|本周"), coming(a, "6")),
        (has("this month|bulan ini|这个?月"), f"last_day({a})"),
        (f"({has(led)} OR {has(bare)}) AND {n} > 0", span),
        (has(wide_day), coming(a, _number_of(group(wide_day, 1), dates.WIDE_WEEKDAYS))),
        (has(latin_day), coming(f"({a} + CASE WHEN contains({c}, 'next') THEN 7 ELSE 0 END)", _number_of(group(latin_day, 1), dates.WEEKDAYS))),
    ]
    return "CAST(CASE " + " ".join(f"WHEN {w} THEN CAST({t} AS DATE)" for w, t in rules) + " END AS DATE)"


@query(ctes("items") + f", c AS (SELECT id, due, {_ANCHOR} AS a FROM items) SELECT id, CAST({_resolved('due')} AS VARCHAR) AS day FROM c")
def d3_resolve_date(f):
    return f.items.select("id", dates.resolve_date(F.col("due"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 60).cast("int"))).cast("string").alias("day"))


@query(
    ctes("items")
    + f""", c AS (SELECT id, date, {_ANCHOR} AS a FROM items), parts AS (SELECT id, date, a, trim(unnest(string_split(date, ','))) AS p, unnest(range(len(string_split(date, ',')))) AS k FROM c WHERE date IS NOT NULL AND NOT contains(date, '(')),
    told AS (SELECT id, k, p, {_resolved('p')} AS d FROM parts WHERE p <> ''), s AS (SELECT id, string_agg(CASE WHEN d IS NULL THEN p ELSE concat(p, ' (', strftime(d, '%d/%m/%Y'), ')') END, ', ' ORDER BY k) AS t FROM told GROUP BY id)
    SELECT c.id, coalesce(t, date) AS date FROM c LEFT JOIN s USING (id)"""
)
def d4_annotate_deadlines(f):
    return f.items.select("id", dates.annotate_dates(F.col("date"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 60).cast("int"))).alias("date"))


def _norm_date_sql(x: str) -> str:
    return f"trim(regexp_replace(trim(lower(coalesce({x}, ''))), '^(?:(?:by|before|on|due|this|next|the|in|within|sebelum|menjelang|pada|dalam)\\s+)+', ''), ' .,:;''\"-—')"


def _like_sql(a: str, b: str) -> str:
    return f"{a} <> '' AND {b} <> '' AND ({a} = {b} OR (least(length({a}), length({b})) >= 12 AND (contains({a}, {b}) OR contains({b}, {a}))))"


_NONE_DUE = ", ".join(f"'{w}'" for w in dates.NO_DUE)
_DUE = "trim(coalesce(due, ''))"
_PLAIN = f"trim(lower({_DUE}), ' .()-—\"''')"


@query(
    ctes("items")
    + f""", a AS (SELECT meeting_id, item_no, description, source_segment_ids AS ids, {_NORM.format("description")} AS t,
        list_concat(CASE WHEN {_PLAIN} <> '' AND string_split({_PLAIN}, ' ')[1] NOT IN ({_NONE_DUE}) THEN [{_DUE}] ELSE [] END, list_transform(regexp_extract_all({_ASCII.format("description")}, '{_re2(dates.CUES)}'), lambda x: trim(x))) AS cues FROM items WHERE category = 'action_items'),
    c AS (SELECT *, list_transform(cues, lambda x: struct_pack(d := {_norm_date_sql("x")}, s := trim(regexp_replace(x, '(?i)^(?:by|on|before|due|sebelum|menjelang|pada)\\s+', '')))) AS p FROM a),
    k AS (SELECT meeting_id, item_no, description, ids, t, list_filter(p, lambda x, j: x.d <> '' AND NOT list_contains(list_transform(p[1:j - 1], lambda y: y.d), x.d)) AS p, row_number() OVER (PARTITION BY meeting_id ORDER BY item_no) AS k FROM c),
    g AS (SELECT meeting_id, list(struct_pack(t := {_NORM.format("description")}, d := {_norm_date_sql("date")})) AS covered, max(item_no) AS last FROM items WHERE category = 'deadlines' GROUP BY meeting_id),
    walk AS (SELECT m.meeting_id, 0::BIGINT AS k, coalesce(g.covered, []) AS covered, CAST(coalesce(g.last, -1) AS BIGINT) AS last, [''][1:0] AS picked FROM (SELECT DISTINCT meeting_id FROM k) m LEFT JOIN g USING (meeting_id)
    UNION ALL SELECT meeting_id, k, CASE WHEN len(picked) > 0 THEN list_append(covered, struct_pack(t := t, d := {_norm_date_sql("array_to_string(picked, ', ')")})) ELSE covered END, CASE WHEN len(picked) > 0 THEN last + 1 ELSE last END, picked
        FROM (SELECT w.meeting_id, k.k, w.covered, w.last, k.t, list_transform(list_filter(k.p, lambda x: len(list_filter(w.covered, lambda v: v.d = x.d AND {_like_sql("v.t", "k.t")})) = 0), lambda x: x.s) AS picked FROM walk w JOIN k ON k.meeting_id = w.meeting_id AND k.k = w.k + 1))
    SELECT meeting_id, item_no, description, date, array_to_string(source_segment_ids, ',') AS source_segment_ids, false AS derived FROM items WHERE category = 'deadlines'
    UNION ALL SELECT k.meeting_id, CAST(w.last AS INT), k.description, array_to_string(w.picked, ', '), array_to_string(k.ids, ','), true FROM walk w JOIN k ON k.meeting_id = w.meeting_id AND k.k = w.k WHERE len(w.picked) > 0"""
)
def d5_derive_deadlines(f):
    return insights.derive_deadlines(f.items.where("category = 'deadlines'"), f.items.where("category = 'action_items'")).withColumn("source_segment_ids", joined("source_segment_ids"))


@query(ctes("meetings_b") + "SELECT id, strftime(CAST(created_at AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(CAST(created_at AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS minute, 'soon enoug' AS odd FROM meetings_b")
def d7_local_date(f):
    zone = "Asia/Kuala_Lumpur"
    return f.meetings_b.select("id", dates.local_date(F.col("created_at"), zone).alias("day"), dates.local_datetime(F.replace("created_at", F.lit(" "), F.lit("T")), zone).alias("minute"), dates.local_date(F.lit("soon enough"), zone).alias("odd"))


# --- prompts, replies and insights --------------------------------------------------------------------------------------


@query(
    _LINES
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) AS k FROM lines),
    walk AS (SELECT meeting_id, id, line, k, tokens, tokens AS used, 1 AS chunk_no FROM k WHERE k = 1 UNION ALL
        SELECT n.meeting_id, n.id, n.line, n.k, n.tokens, CASE WHEN w.used + n.tokens > 400 THEN n.tokens ELSE w.used + n.tokens END, w.chunk_no + CASE WHEN w.used + n.tokens > 400 THEN 1 ELSE 0 END FROM walk w JOIN k n ON n.meeting_id = w.meeting_id AND n.k = w.k + 1)
    SELECT meeting_id, CAST(chunk_no AS INT) AS chunk_no, string_agg(line, chr(10) ORDER BY k) AS chunk_text, string_agg(id, ',' ORDER BY k) AS segment_ids, CAST(sum(tokens) AS DOUBLE) AS tokens FROM walk GROUP BY meeting_id, chunk_no"""
)
def r5_chunk_segments(f):
    return prompts.chunk_segments(prompts.lines(f.segments_b, f.speakers_b), 400.0).select("meeting_id", "chunk_no", "chunk_text", joined("segment_ids").alias("segment_ids"), "tokens")


@query(
    _LINES
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) - 1 AS k FROM lines)
    SELECT meeting_id, CAST(floor(k / 3) AS BIGINT) AS batch_no, string_agg(concat(mod(k, 3) + 1, '. ', text), chr(10) ORDER BY k) AS batch_text, count(*) AS lines FROM n GROUP BY meeting_id, CAST(floor(k / 3) AS BIGINT)"""
)
def w5_line_batches(f):
    return prompts.line_batches(prompts.lines(f.segments_b, f.speakers_b), 3)


_PREFIX = "SELECT *, sum(tokens) OVER (PARTITION BY meeting_id ORDER BY start_seconds, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) AS k FROM {0}"


@query(_LINES + ", p AS (" + _PREFIX.format("lines") + ") SELECT meeting_id, id FROM p WHERE used <= 400 OR k = 1")
def w6_token_prefix(f):
    return prompts.token_prefix(prompts.lines(f.segments_b, f.speakers_b), 400.0).select("meeting_id", "id")


@query(
    _LINES.replace("WITH RECURSIVE ", ctes("items") + ", ")
    + ", full_ AS (SELECT meeting_id FROM items WHERE category IN ('risks', 'issues') AND (category <> 'risks' OR mod(meeting_id, 3) = 0) GROUP BY meeting_id HAVING count(DISTINCT category) = 2), cited AS (SELECT DISTINCT meeting_id, unnest(source_segment_ids) AS id FROM items WHERE category IN ('risks', 'issues') AND (category <> 'risks' OR mod(meeting_id, 3) = 0)), open_ AS (SELECT l.*, sum(tokens) OVER (PARTITION BY l.meeting_id) AS total, count(*) OVER (PARTITION BY l.meeting_id) AS n FROM lines l ANTI JOIN full_ USING (meeting_id) ANTI JOIN cited USING (meeting_id, id) WHERE trim(l.text) <> ''), chosen AS (SELECT meeting_id, id, start_seconds, tokens FROM open_ WHERE total <= 1500 OR n = 1 OR regexp_matches("
    + _ASCII.format("text")
    + ", '"
    + _re2(text.RISK_CUE)
    + "')), p AS ("
    + _PREFIX.format("chosen")
    + ") SELECT meeting_id, id FROM p WHERE used <= 1500 OR k = 1"
)
def r11_recovery_lines(f):
    # two meetings in three have no risks
    given = f.items.where("category <> 'risks' or meeting_id % 3 = 0")
    return prompts.recovery_lines(prompts.lines(f.segments_b, f.speakers_b), given, 1500.0).select("meeting_id", "id")


@query(ctes("items", "chunks") + ", k AS (SELECT i.id, list_filter(i.source_segment_ids, lambda x: list_contains(c.segment_ids, x)) AS s FROM items i JOIN chunks c USING (meeting_id, chunk_no)) SELECT id, array_to_string(s, ',') AS segment_ids, s[1] AS source_segment_id FROM k WHERE len(s) > 0")
def j10_r13_ground(f):
    return replies.ground(f.items, f.chunks).select("id", joined("source_segment_ids").alias("segment_ids"), replies.first_citation(F.col("source_segment_ids")).alias("source_segment_id"))


def _model_replies(f) -> DataFrame:
    """Replies in JSON made from the items, with all characters of their texts: keys in several spellings, single citations,
    texts, fractions and nulls for numbers, fields of a wrong kind, keys that stand twice, broken items."""
    i, first = F.col("item_no"), F.element_at("source_segment_ids", 1).cast("string")
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    cases = [F.to_json("source_segment_ids"), first, F.concat(F.lit('["'), first, F.lit('", 7.0, true]')), F.lit('["seg 12"]'), F.lit("null"), F.concat(first, F.lit(".0")), F.lit("[1.5]")]
    ids = F.lit(None).cast("string")
    for k, case in enumerate(cases):
        ids = F.when(i % 8 == k, F.concat(F.lit(', "source_segment_ids": '), case)).otherwise(ids)
    description = F.when(i % 11 == 0, F.lit("5")).when(i % 13 == 0, F.lit('"  "')).otherwise(quoted("description"))
    name = F.when(i % 2 == 0, '{"Description": ').when(i % 3 == 0, '{"description": 7, "DESCRIPTION": ').otherwise('{"description": ')
    item = F.concat(name, description, F.lit(', "owner": '), F.when(i % 4 == 0, '"Wei"').when(i % 17 == 0, "5").otherwise("null"), F.lit(', "odd": 1'), F.coalesce(ids, F.lit("")), F.lit("}"))
    key = F.when(F.col("category") == "action_items", "Action Items").when(F.col("category") == "risks", "RISKS").otherwise(F.col("category"))
    lists = f.items.groupBy("meeting_id", "chunk_no", key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("item_no", item.alias("t")))).alias("rows"))
    body = F.concat(F.lit('"'), F.col("key"), F.lit('": ['), F.array_join(F.transform("rows", lambda r: r["t"]), ", "), F.lit("]"))
    whole = lists.groupBy("meeting_id", "chunk_no").agg(F.sort_array(F.collect_list(body)).alias("bodies"))
    return whole.select("meeting_id", "chunk_no", F.lit(0).alias("attempt"), F.concat(F.lit('Here: {"decisions ": 5, "chunk_summary": " s'), F.col("meeting_id").cast("string"), F.lit(' ", '), F.array_join("bodies", ", "), F.lit("} done")).alias("content"))


@query(
    ctes("items")
    + """, listed AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, chunk_no, category ORDER BY item_no) - 1 AS k FROM items)
    SELECT meeting_id, chunk_no, category, CAST(k AS INT) AS item_no, description, CASE WHEN mod(item_no, 4) = 0 AND category = 'action_items' THEN 'Wei' END AS owner,
    CASE mod(item_no, 8) WHEN 0 THEN array_to_string(source_segment_ids, ',') WHEN 1 THEN CAST(source_segment_ids[1] AS VARCHAR) WHEN 2 THEN concat(source_segment_ids[1], ',7,1') ELSE '' END AS segment_ids
    FROM listed WHERE mod(item_no, 11) <> 0 AND mod(item_no, 13) <> 0 AND mod(item_no, 8) IN (0, 1, 2, 7) AND NOT (category = 'action_items' AND mod(item_no, 17) = 0 AND mod(item_no, 4) <> 0)
    AND trim(description, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"""
)
def r2_parse_items(f):
    good, _ = replies.first_parseable(_model_replies(f))
    items, _ = replies.parse_items(good)
    return items.select("meeting_id", "chunk_no", "category", "item_no", "description", "owner", joined("source_segment_ids").alias("segment_ids"))


_LIKE = "x.norm <> '' AND n.norm <> '' AND (x.norm = n.norm OR (least(length(x.norm), length(n.norm)) >= 12 AND CASE WHEN length(x.norm) <= length(n.norm) THEN contains(n.norm, x.norm) ELSE contains(x.norm, n.norm) END))"
_FILL = ", ".join(f"{c} := CASE WHEN coalesce(o.{c}, '') = '' THEN coalesce(nullif(n.{c}, ''), o.{c}) ELSE o.{c} END" for c in ("owner", "due", "date", "mitigation"))


@query(
    ctes("items", "summaries")
    + ", several AS (SELECT meeting_id FROM summaries GROUP BY meeting_id HAVING count(DISTINCT chunk_no) > 1), k AS (SELECT *, "
    + _NORM.format("description")
    + f""" AS norm, row_number() OVER (PARTITION BY meeting_id, category ORDER BY chunk_no, item_no) AS k FROM items SEMI JOIN several USING (meeting_id)),
    walk AS (SELECT meeting_id, category, k, [struct_pack(id := id, chunk_no := chunk_no, item_no := item_no, norm := norm, description := description, owner := owner, due := due, date := date, mitigation := mitigation, ids := source_segment_ids)] AS kept FROM k WHERE k = 1
    UNION ALL SELECT meeting_id, category, k, CASE WHEN pos IS NULL THEN list_append(kept, n) ELSE list_concat(list_concat(kept[1:pos - 1],
        [struct_pack(id := o.id, chunk_no := o.chunk_no, item_no := o.item_no, norm := CASE WHEN length(n.description) > length(o.description) THEN n.norm ELSE o.norm END, description := CASE WHEN length(n.description) > length(o.description) THEN n.description ELSE o.description END, {_FILL}, ids := list_sort(list_distinct(list_concat(o.ids, n.ids))))]), kept[pos + 1:]) END
        FROM (SELECT *, kept[pos] AS o FROM (SELECT w.meeting_id, w.category, w.kept, r.k, r.n, nullif(list_position(list_transform(w.kept, lambda x: {_LIKE.replace("n.norm", "r.n.norm")}), true), 0) AS pos
            FROM walk w JOIN (SELECT meeting_id, category, k, struct_pack(id := id, chunk_no := chunk_no, item_no := item_no, norm := norm, description := description, owner := owner, due := due, date := date, mitigation := mitigation, ids := source_segment_ids) AS n FROM k) r ON r.meeting_id = w.meeting_id AND r.category = w.category AND r.k = w.k + 1))),
    done AS (SELECT meeting_id, category, unnest(kept) AS x FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, category ORDER BY k DESC) AS r FROM walk) WHERE r = 1)
    SELECT x.id AS id, meeting_id, x.chunk_no AS chunk_no, category, x.item_no AS item_no, x.description AS description, x.owner AS owner, x.due AS due, x.date AS date, x.mitigation AS mitigation, array_to_string(x.ids, ',') AS source_segment_ids FROM done
    UNION ALL SELECT id, meeting_id, chunk_no, category, item_no, description, owner, due, date, mitigation, array_to_string(source_segment_ids, ',') FROM items ANTI JOIN several USING (meeting_id)"""
)
def r10_fold_items(f):
    folded = prompts.fold_items(f.items, f.summaries)
    return folded.withColumn("source_segment_ids", joined("source_segment_ids"))


@query(
    ctes("items")
    + ", n AS (SELECT id, meeting_id, category, "
    + _NORM.format("description")
    + """ AS t FROM items) SELECT a.id FROM n a WHERE mod(a.id, 2) = 0 AND NOT EXISTS (SELECT 1 FROM n b WHERE mod(b.id, 2) = 1 AND b.category = a.category AND b.meeting_id = a.meeting_id AND a.t <> '' AND b.t <> ''
    AND (a.t = b.t OR (least(length(a.t), length(b.t)) >= 12 AND (CASE WHEN length(a.t) <= length(b.t) THEN contains(b.t, a.t) ELSE contains(a.t, b.t) END))))"""
)
def r12_recovery_merge(f):
    return replies.recovery_merge(f.items.where("id % 2 = 0"), f.items.where("id % 2 = 1")).select("id")


@query(
    ctes("items", "segments_b", "speakers_b")
    + ", cited AS (SELECT id, unnest(source_segment_ids) AS sid, unnest(range(len(source_segment_ids))) AS k FROM items WHERE category = 'action_items' AND coalesce(owner, '') = ''), said AS (SELECT s.id AS sid, coalesce(nullif(display_name, ''), label) AS name FROM segments_b s JOIN speakers_b p ON p.id = s.speaker_id WHERE regexp_matches("
    + _ASCII.format("concat('I will ', s.text)")
    + ", '"
    + _re2(text.SELF_ASSIGNMENT)
    + "') AND mod(s.id, 2) = 0), o AS (SELECT c.id, min_by(name, k) AS name FROM cited c JOIN said USING (sid) GROUP BY c.id) SELECT i.id, coalesce(o.name, i.owner) AS owner FROM items i LEFT JOIN o USING (id)"
)
def j11_attribute_owners(f):
    lines = f.segments_b.withColumn("text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("I will "), "text")).otherwise(F.lit("you do")))
    return insights.attribute_owners(f.items, lines, f.speakers_b).select("id", "owner")


_SIGNS = """, signs AS (SELECT id, list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z]{{4,}}'), lambda x: NOT list_contains({stop}, x)), lambda x: x[1:4]) AS w, list_transform(regexp_extract_all({t}, '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '')) AS n FROM {f}) """
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query(
    ctes("items", "segments_b", "meetings_b")
    + """, d AS (SELECT id, meeting_id, source_segment_ids[1] AS sid, description FROM items), """
    + _SIGNS.format(t="description", stop=_STOP, f="d").strip()[1:].replace("signs", "di", 1)
    + _SIGNS.format(t="text", stop=_STOP, f="segments_b").replace("signs", "si", 1)
    + """SELECT d.id, s.text AS source_text, s.language AS source_language, s.start_seconds AS source_seconds, coalesce(d.description <> '' AND s.text <> '' AND NOT coalesce(coalesce(CASE WHEN m.primary_language <> 'auto' THEN m.primary_language END, m.language) <> s.language, false)
    AND NOT list_has_any(di.n, si.n) AND NOT list_has_any(di.w, si.w) AND len(di.w) > 0 AND len(si.w) > 0, false) AS low_support FROM d JOIN di ON di.id = d.id LEFT JOIN segments_b s ON s.id = d.sid AND s.meeting_id = d.meeting_id LEFT JOIN si ON si.id = s.id LEFT JOIN meetings_b m ON m.id = d.meeting_id"""
)
def j7_p9_cite_items(f):
    items = f.items.withColumn("source_segment_id", F.element_at("source_segment_ids", 1))
    return insights.cite_items(items, f.segments_b, f.meetings_b).select("id", "source_text", "source_language", "source_seconds", "low_support")


@query(ctes("items") + "SELECT id, meeting_id, category, description, CASE WHEN category = 'action_items' THEN owner END AS owner, CASE WHEN category = 'deadlines' THEN date END AS target_date, CASE WHEN category = 'risks' THEN mitigation END AS mitigation FROM items")
def u1_all_insights(f):
    part = lambda c, *more: f.items.where(F.col("category") == c).select("id", "meeting_id", "description", *more)
    given = {"action_items": part("action_items", "owner"), "decisions": part("decisions"), "deadlines": part("deadlines", F.col("date").alias("target_date")), "issues": part("issues"), "risks": part("risks", "mitigation")}
    return insights.all_insights(given)


@query(ctes("items") + "SELECT meeting_id, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in ("action_items", "decisions", "deadlines", "issues", "risks")) + " FROM items GROUP BY meeting_id")
def g9_item_counts(f):
    return insights.item_counts(f.items)


@query(
    ctes("items", "meetings_b", "summaries")
    + f""", j AS (SELECT meeting_id, substr(coalesce(string_agg(trim(summary), ' ' ORDER BY chunk_no) FILTER (trim(summary) <> ''), ''), 1, 1500) AS t FROM summaries GROUP BY meeting_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, category ORDER BY chunk_no, item_no) AS r FROM items WHERE category IN ('decisions', 'action_items') AND description <> ''),
    p AS (SELECT meeting_id, substr(string_agg(description, ' / ' ORDER BY category DESC, r), 1, 1500) AS t FROM ranked WHERE r <= 5 GROUP BY meeting_id)
    SELECT m.id AS meeting_id, CASE WHEN j.meeting_id IS NULL THEN '{insights.NO_CHUNKS}' ELSE coalesce(nullif(trim(m.summary), ''), nullif(j.t, ''), nullif(p.t, ''), '{insights.NO_SUMMARY}') END AS summary FROM meetings_b m LEFT JOIN j ON j.meeting_id = m.id LEFT JOIN p ON p.meeting_id = m.id"""
)
def g8_summary_fallback(f):
    return insights.summary_fallback(f.meetings_b.select(F.col("id").alias("meeting_id"), F.col("summary").alias("model_summary")), f.summaries, f.items)


@query(
    ctes("items", "summaries")
    + """, ranked AS (SELECT meeting_id, category, description, row_number() OVER (PARTITION BY meeting_id, category ORDER BY chunk_no, item_no) AS r FROM items),
    l AS (SELECT meeting_id, list(summary ORDER BY chunk_no) AS s FROM summaries GROUP BY meeting_id),
    d AS (SELECT meeting_id, coalesce(list(description ORDER BY r) FILTER (category = 'decisions' AND r <= 15), []) AS d, coalesce(list(description ORDER BY r) FILTER (category = 'action_items' AND r <= 15), []) AS a FROM ranked GROUP BY meeting_id)
    SELECT meeting_id, CAST(to_json(struct_pack(chunk_summaries := s, decisions := d, action_items := a)) AS VARCHAR) AS material FROM l JOIN d USING (meeting_id)"""
)
def k6_summary_input(f):
    return insights.summary_input(f.summaries, f.items)


# --- follow-ups ---------------------------------------------------------------------------------------------------------

_CHAIN = ctes("meetings_o") + """, walk AS (SELECT id, id AS here, [id] AS path FROM meetings_o UNION ALL SELECT w.id, m.follow_up_of, list_append(w.path, m.follow_up_of) FROM walk w JOIN meetings_o m ON m.id = w.here JOIN meetings_o k ON k.id = m.follow_up_of WHERE NOT list_contains(w.path, m.follow_up_of)),
    chain AS (SELECT id, here AS meeting_id, max(len(path)) OVER (PARTITION BY id) - len(path) AS position FROM walk) """


@query(_CHAIN + "SELECT id, CAST(position AS INT) AS position, meeting_id FROM chain")
def j13_meeting_chain(f):
    return followup.meeting_chain(f.meetings_o)


def _links(f) -> DataFrame:
    """Each order is to follow the next one, every fifth itself, every seventh one that isn't there, every eleventh none."""
    i = F.col("o_orderkey")
    return f.orders.select(i.alias("meeting_id"), F.when(i % 5 == 0, i).when(i % 7 == 0, F.lit(-5).cast("long")).when(i % 11 == 0, F.lit(None).cast("long")).when(i % 3 == 0, F.col("o_custkey")).otherwise(i + 1).alias("previous_id"))


@query(
    _CHAIN
    + """, links AS (SELECT o_orderkey AS meeting_id, CASE WHEN mod(o_orderkey, 5) = 0 THEN o_orderkey WHEN mod(o_orderkey, 7) = 0 THEN -5 WHEN mod(o_orderkey, 11) = 0 THEN NULL WHEN mod(o_orderkey, 3) = 0 THEN o_custkey ELSE o_orderkey + 1 END AS previous_id FROM orders),
    has AS (SELECT id FROM meetings_o WHERE mod(id, 4) <> 0),
    told AS (SELECT l.*, CASE WHEN l.previous_id IS NULL THEN NULL WHEN l.meeting_id = l.previous_id THEN 'a meeting cannot follow itself' WHEN p.id IS NULL THEN 'previous meeting not found' WHEN hp.id IS NULL THEN 'previous meeting has no transcript' WHEN hm.id IS NULL THEN 'this meeting has no transcript' WHEN c.id IS NOT NULL THEN 'would form a loop' END AS reason
        FROM links l LEFT JOIN meetings_o p ON p.id = l.previous_id LEFT JOIN has hp ON hp.id = l.previous_id LEFT JOIN has hm ON hm.id = l.meeting_id LEFT JOIN chain c ON c.id = l.previous_id AND c.meeting_id = l.meeting_id)
    SELECT meeting_id, previous_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL AND previous_id IS NOT NULL THEN 'analysing' END AS carry_forward_status FROM told"""
)
def j14_check_links(f):
    return followup.check_links(_links(f), f.meetings_o, f.meetings_o.where("id % 4 <> 0").select(F.col("id").alias("meeting_id")))


_TOLD = ORACLES["j14_check_links"].split("    SELECT meeting_id, previous_id, reason IS NULL")[0]


@query(_TOLD + " SELECT m.id, CASE WHEN t.reason IS NULL THEN t.previous_id ELSE m.follow_up_of END AS follow_up_of, CASE WHEN t.reason IS NOT NULL THEN m.carry_forward_status WHEN t.previous_id IS NOT NULL THEN 'analysing' END AS carry_forward_status, t.reason IS NOT NULL AS kept FROM meetings_o m JOIN told t ON t.meeting_id = m.id")
def j14_apply_links(f):
    checked = followup.check_links(_links(f), f.meetings_o, f.meetings_o.where("id % 4 <> 0").select(F.col("id").alias("meeting_id")))
    linked, carried = followup.apply_links(checked, f.meetings_o, f.meetings_o.select(F.col("id").alias("meeting_id")))
    return linked.join(carried.select(F.col("meeting_id").alias("id"), F.lit(True).alias("kept")), "id", "left").select("id", "follow_up_of", "carry_forward_status", F.coalesce("kept", F.lit(False)).alias("kept"))


_K5 = 8


def _k5_actions(f) -> DataFrame:
    return f.items.where("category = 'action_items'").select("meeting_id", F.col("id").alias("action_id"), "description")


_STOP_K5 = ("the", "of", "and", "to", "in", "is", "it")


def _terms_sql(t: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({', '.join(repr(w) for w in _STOP_K5)}))"
    return f"list_concat({kept}, list_transform(list_zip({kept}[1:len({kept}) - 1], {kept}[2:len({kept})]), lambda p: concat(p[1], ' ', p[2])))"


@query(
    ctes("items", "segments_b")
    + f""", st AS (SELECT meeting_id, id, unnest({_terms_sql('text')}) AS term FROM segments_b), tf AS (SELECT meeting_id, id, term, count(*) AS tf FROM st GROUP BY ALL),
    n AS (SELECT meeting_id, count(*) + 1 AS n FROM segments_b GROUP BY ALL), df AS (SELECT meeting_id, term, count(*) AS df FROM tf GROUP BY ALL),
    act AS (SELECT meeting_id, id AS action_id, description FROM items WHERE category = 'action_items'), aterm AS (SELECT meeting_id, action_id, unnest({_terms_sql('description')}) AS term FROM act), atf AS (SELECT meeting_id, action_id, term, count(*) AS tf FROM aterm GROUP BY ALL),
    pairs AS (SELECT a.action_id, s.meeting_id, s.id, s.start_seconds FROM act a JOIN segments_b s USING (meeting_id)),
    sw AS (SELECT p.action_id, p.id, t.tf * (ln((1 + n) / (1 + df + CASE WHEN b.term IS NULL THEN 0 ELSE 1 END)) + 1) AS w, b.tf * (ln((1 + n) / (2 + df)) + 1) AS aw
        FROM pairs p JOIN tf t ON t.id = p.id JOIN df ON df.meeting_id = p.meeting_id AND df.term = t.term JOIN n ON n.meeting_id = p.meeting_id LEFT JOIN atf b ON b.action_id = p.action_id AND b.term = t.term),
    sn AS (SELECT action_id, id, sum(w * w) AS norm, sum(w * aw) AS dot FROM sw GROUP BY ALL),
    an AS (SELECT a.action_id, sum(pow(a.tf * (ln((1 + n) / (2 + coalesce(df, 0))) + 1), 2)) AS norm FROM atf a JOIN n USING (meeting_id) LEFT JOIN df ON df.meeting_id = a.meeting_id AND df.term = a.term GROUP BY ALL),
    sim AS (SELECT p.*, coalesce(round(dot / sqrt(sn.norm * an.norm), 6), 0) AS s FROM pairs p LEFT JOIN sn USING (action_id, id) LEFT JOIN an USING (action_id)),
    any_ AS (SELECT action_id, max(s) AS best FROM sim GROUP BY ALL), texts AS (SELECT DISTINCT meeting_id FROM tf), terms AS (SELECT DISTINCT action_id FROM atf),
    ranked AS (SELECT sim.*, best, row_number() OVER (PARTITION BY sim.action_id ORDER BY s DESC, start_seconds DESC, id DESC) AS r, row_number() OVER (PARTITION BY sim.action_id ORDER BY start_seconds, id) AS early, texts.meeting_id IS NOT NULL OR terms.action_id IS NOT NULL AS has_terms FROM sim JOIN any_ USING (action_id) LEFT JOIN texts ON texts.meeting_id = sim.meeting_id LEFT JOIN terms ON terms.action_id = sim.action_id),
    top AS (SELECT * FROM ranked WHERE CASE WHEN best > 0 THEN s > 0 AND r <= {_K5} WHEN has_terms THEN r <= {_K5} ELSE early <= {_K5} END)
    SELECT action_id, CAST(row_number() OVER (PARTITION BY action_id ORDER BY start_seconds, id) AS INT) AS number, id AS segment_id, s AS similarity FROM top"""
)
def k5_retrieve(f):
    return followup.retrieve(_k5_actions(f), f.segments_b, _K5, list(_STOP_K5)).select("action_id", "number", "segment_id", F.col("similarity").cast("double").alias("similarity"))


_STATES = (" Completed", "in progress", "odd", "in-progress", "in  progress", "BLOCKED\n", "changed", None)
_CITED = ('["2", 1, 99, 2]', "[1.0, 2.7]", "[true, null, \"1.5\", {}]", '"2"', '[" 2 ", "x"]')


@query(
    ctes("items", "segments_b")
    + """, v AS (SELECT id AS action_id, meeting_id, CASE mod(id, 8) WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 5 THEN 'blocked' WHEN 6 THEN 'changed' END AS status,
        CASE mod(id, 7) WHEN 0 THEN [2, 1] WHEN 1 THEN [1, 2] WHEN 2 THEN [1] WHEN 4 THEN [2] WHEN 5 THEN [2, 1] WHEN 6 THEN [1, 2] ELSE [] END AS wanted, CASE WHEN mod(id, 3) > 0 THEN 'so' END AS note FROM items WHERE category = 'action_items'),
    e AS (SELECT id AS segment_id, meeting_id, segment_no + 1 AS number FROM segments_b),
    known AS (SELECT meeting_id, list(number) AS ns FROM e GROUP BY meeting_id),
    c AS (SELECT v.*, list_filter(wanted, lambda n: list_contains(ns, n)) AS cited FROM v JOIN known USING (meeting_id))
    SELECT action_id, status, array_to_string(cited, ',') AS cited, note, e.segment_id AS source_segment_id FROM c JOIN e ON e.meeting_id = c.meeting_id AND e.number = cited[1] WHERE status IS NOT NULL"""
)
def r3_parse_verdict(f):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("action_id") % by + 1).cast("int"))
    actions = _k5_actions(f)
    status = F.coalesce(F.to_json(F.array(pick(_STATES, 8)), {"ignoreNullFields": "false"}), F.lit("[null]"))
    note = F.when(F.col("action_id") % 3 > 0, '" so "').otherwise("null")
    made = actions.select("meeting_id", "action_id", F.concat(F.lit('ok {"status": '), F.substring(status, 2, 100).substr(F.lit(1), F.length(status) - 2), F.lit(', "cited": '), pick((*_CITED, *_CITED[:2]), 7), F.lit(', "note": '), note, F.lit("}")).alias("content"))
    excerpts = actions.select("meeting_id", "action_id").join(f.segments_b.select("meeting_id", (F.col("segment_no") + 1).alias("number"), F.col("id").alias("segment_id")), "meeting_id")
    return replies.parse_verdict(made, excerpts).select("action_id", "status", joined("cited").alias("cited"), "note", "source_segment_id")


@query(ctes("segments_b") + "SELECT id, CASE WHEN mod(segment_no, 3) = 0 THEN 'first' WHEN mod(segment_no, 3) = 2 THEN 'third' ELSE text END AS text FROM segments_b")
def r4_merge_translations(f):
    lines = f.segments_b.select("id", "meeting_id", F.floor(F.col("segment_no") / 3).alias("batch_no"), (F.col("segment_no") % 3 + 1).alias("line_no"), "text")
    made = lines.select("meeting_id", "batch_no").distinct().withColumn("content", F.lit('{"lines": [{"i": 1, "en": "first"}, {"i": 2, "en": " "}, {"i": 3, "en": "third"}, {"i": 9, "en": "none"}]}'))
    return replies.merge_translations(lines, made).select("id", "text")


_CARRIED = ctes("items") + """, v AS (SELECT id AS action_id, CASE mod(id, 4) WHEN 0 THEN 'completed' ELSE 'blocked' END AS status FROM items WHERE category = 'action_items' AND mod(id, 3) = 0),
    c AS (SELECT i.id AS action_id, i.meeting_id, i.description, i.owner, coalesce(v.status, 'not_discussed') AS status, CASE WHEN v.status IS NOT NULL THEN 'said' END AS note FROM items i LEFT JOIN v ON v.action_id = i.id WHERE category = 'action_items') """


def _carried(f) -> DataFrame:
    actions = f.items.where("category = 'action_items'").select("meeting_id", F.col("id").alias("action_id"), "description", "owner")
    verdicts = actions.where("action_id % 3 = 0").select("meeting_id", "action_id", F.when(F.col("action_id") % 4 == 0, "completed").otherwise("blocked").alias("status"), F.lit("said").alias("note"), F.lit(1).cast("long").alias("source_segment_id"))
    return followup.carry_forward(actions, verdicts)


@query(_CARRIED + "SELECT * FROM c")
def j15_carry_forward(f):
    return _carried(f).select("action_id", "meeting_id", "description", "owner", "status", "note")


@query(_CARRIED + "SELECT meeting_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("completed", "in_progress", "blocked", "changed", "not_discussed")) + ", count(*) AS total, count(*) FILTER (status <> 'not_discussed') AS discussed, concat(count(*) FILTER (status <> 'not_discussed'), ' of ', count(*)) AS text FROM c GROUP BY meeting_id")
def g5_verdict_tally(f):
    return followup.verdict_tally(_carried(f))


@query(
    _CHAIN.replace("WITH RECURSIVE ", ctes("speakers_o") + ", ")
    + """, own AS (SELECT c.id AS series_id, position, m.title, m.duration_seconds, strftime(m.created_at, '%Y-%m-%d') AS day, CASE m.language WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' WHEN 'ms' THEN 'Malay' ELSE coalesce(nullif(m.language, ''), '-') END AS language, m.summary, coalesce(nullif(p.display_name, ''), p.label) AS person FROM chain c JOIN meetings_o m ON m.id = c.meeting_id JOIN speakers_o p ON p.meeting_id = c.meeting_id),
    people AS (SELECT series_id, string_agg(person, ', ' ORDER BY first_) AS attendees FROM (SELECT series_id, person, min(position) AS first_ FROM own GROUP BY ALL) GROUP BY ALL),
    langs AS (SELECT series_id, string_agg(language, ', ' ORDER BY first_) AS languages FROM (SELECT series_id, language, min(position) AS first_ FROM own GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT series_id, count(*) AS length, min_by(day, position) AS a, max_by(day, position) AS b, CAST(sum(duration_seconds) AS BIGINT) AS s, max_by(title, position) AS title, coalesce(string_agg(concat(title, ': ', summary), chr(10) ORDER BY position) FILTER (summary IS NOT NULL), '') AS summary FROM own GROUP BY ALL)
    SELECT series_id, length, CASE WHEN a = b THEN b ELSE concat(a, ' to ', b) END AS dates, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration, attendees, languages,
    concat(title, CASE WHEN length > 1 THEN concat(' (combined series of ', length, ' meetings)') ELSE '' END) AS title, summary FROM g JOIN people USING (series_id) JOIN langs USING (series_id)"""
)
def g7_series_overview(f):
    return followup.series_overview(followup.series_lines(f.meetings_o), f.meetings_o, f.speakers_o)


_SERIES = (
    "WITH RECURSIVE links AS (SELECT id, CASE WHEN mod(id, 10) <> 0 THEN id - 1 END AS follow_up_of, title FROM m), walk AS (SELECT id, id AS here, 1 AS k FROM links UNION ALL SELECT w.id, l.follow_up_of, k + 1 FROM walk w JOIN links l ON l.id = w.here JOIN links p ON p.id = l.follow_up_of), chain AS (SELECT id, here AS meeting_id, max(k) OVER (PARTITION BY id) - k AS position FROM walk) "
)


def _series_sql(*frames: str) -> str:
    return ctes("meetings_b", *frames) + ", m AS (SELECT id, title FROM meetings_b), " + _SERIES.removeprefix("WITH RECURSIVE ")


def _linked(f) -> DataFrame:
    return f.meetings_b.withColumn("follow_up_of", F.when(F.col("id") % 10 != 0, F.col("id") - 1))


def _series(f) -> tuple[DataFrame, DataFrame]:
    linked = _linked(f)
    return linked, followup.meeting_chain(linked)


@query(_series_sql("items") + "SELECT c.id AS series_id, CAST(position AS INT) AS position, i.id, i.category, m.title AS meeting_title FROM chain c JOIN items i ON i.meeting_id = c.meeting_id JOIN m ON m.id = c.meeting_id")
def u2_pooled_items(f):
    linked, chain = _series(f)
    return followup.pooled_items(chain, f.items, linked).select("series_id", "position", "id", "category", "meeting_title")


@query(_series_sql("carried") + "SELECT c.id AS series_id, CAST(position AS INT) AS position, i.id, i.status, p.title AS carried_from FROM chain c JOIN carried i ON i.meeting_id = c.meeting_id LEFT JOIN m p ON p.id = i.previous_meeting_id")
def m3_series_progress(f):
    linked, chain = _series(f)
    return followup.series_progress(chain, f.carried, linked).select("series_id", "position", "id", "status", "carried_from")


# --- reads --------------------------------------------------------------------------------------------------------------


@query(
    ctes("segments_b", "speakers_b", "words_b")
    + """, w AS (SELECT segment_id, count(*) AS n, string_agg(concat(word_no, ':', text), ' ' ORDER BY word_no) AS t FROM words_b WHERE mod(segment_id, 7) <> 0 GROUP BY ALL)
    SELECT s.id, row_number() OVER (PARTITION BY s.meeting_id ORDER BY start_seconds, s.id) - 1 AS ordinal, coalesce(nullif(display_name, ''), label, 'Unknown') AS speaker_name, count(*) OVER (PARTITION BY s.meeting_id) AS segments, coalesce(n, 0) AS n, coalesce(t, '') AS words FROM segments_b s LEFT JOIN speakers_b p ON p.id = s.speaker_id LEFT JOIN w ON w.segment_id = s.id"""
)
def j8_w4_transcript(f):
    told = reads.transcript(f.segments_b, f.speakers_b, f.words_b.where("segment_id % 7 <> 0"))
    words = F.array_join(F.transform("words", lambda w: F.concat(w["word_no"].cast("string"), F.lit(":"), w["text"])), " ")
    return told.select("id", "ordinal", "speaker_name", "segments", F.size("words").alias("n"), words.alias("words"))


@query(ctes("meetings_o") + "SELECT id, id IN (SELECT user_id FROM events) AS has_transcript FROM meetings_o")
def j12_with_transcript(f):
    return reads.with_transcript(f.meetings_o, f.turns).select("id", "has_transcript")


@query(ctes("meetings_o") + "SELECT id, title, status FROM meetings_o ORDER BY created_at DESC, id DESC")
def k1_list_meetings(f):
    return reads.list_meetings(f.meetings_o).select("id", "title", "status")


@query("SELECT page_id AS id, concat('T', page_id) AS name, url AS original_filename FROM pages ORDER BY length(html) DESC, page_id DESC")
def k1_list_templates(f):
    made = f.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("original_filename"), F.timestamp_seconds(F.length("html")).alias("created_at"))
    return reads.list_templates(made).select("id", "name", "original_filename")


@query(ctes("segments_b") + ", n AS (SELECT id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) - 1 AS ordinal, count(*) OVER (PARTITION BY meeting_id) AS total FROM segments_b) SELECT * FROM n WHERE ordinal BETWEEN 1 AND 3")
def k2_segments_page(f):
    return reads.segments_page(f.segments_b, 1, 3).select("id", "ordinal", "total")


_K3 = ("the", " DE ", "100%", "einü", "q")


@query(
    ctes("segments_b")
    + f""", t AS (SELECT unnest(['the', 'DE', '100%', 'einü']) AS term), n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_seconds, id) - 1 AS ordinal FROM segments_b),
    h AS (SELECT *, instr(lower(text), lower(term)) AS p, row_number() OVER (PARTITION BY term, meeting_id ORDER BY ordinal) AS r FROM n JOIN t ON contains(lower(text), lower(term)))
    SELECT term, id, ordinal, concat(CASE WHEN p > 61 THEN '...' ELSE '' END, substr(text, greatest(1, p - 60), least(length(text), p + length(term) + 59) - greatest(1, p - 60) + 1), CASE WHEN p + length(term) + 59 < length(text) THEN '...' ELSE '' END) AS snippet FROM h WHERE r <= 200"""
)
def k3_search(f):
    terms = f.spark.createDataFrame([(t,) for t in _K3], "term string")
    return reads.search(f.segments_b, terms).select("term", "id", "ordinal", "snippet")


@query(ORACLES["k3_search"])
def k3_search_index(f):
    path, terms = stage.work_dir(f.spark, "search"), f.spark.createDataFrame([(t,) for t in _K3], "term string")
    search_index.write_search_index(f.segments_b, path, 16, 16)
    return search_index.search_stored(f.spark, path, terms).select("term", "id", "ordinal", "snippet")


@query(ctes("segments_b", "words_b") + "SELECT w.id, w.segment_id, w.text FROM words_b w JOIN segments_b s ON s.id = w.segment_id WHERE mod(s.id, 10) = 1 AND mod(s.meeting_id, 3) <> 0")
def k7_segment_words(f):
    wanted = f.segments_b.where("id % 10 = 1").select(F.when(F.col("meeting_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("meeting_id")).alias("meeting_id"), F.col("id").alias("segment_id"))
    return reads.segment_words(f.words_b, f.segments_b, wanted).select("id", "segment_id", "text")


_BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(
    ctes("segments_b", "words_b")
    + ", j AS (SELECT segment_id, string_agg(text, '' ORDER BY word_no) AS t FROM words_b WHERE id % 997 <> 0 GROUP BY ALL) SELECT w.id, coalesce("
    + _BARE.format("j.t")
    + " = "
    + _BARE.format("s.text")
    + " AND score < 0.5, false) AS shaky FROM words_b w JOIN j USING (segment_id) JOIN segments_b s ON s.id = w.segment_id WHERE w.id % 997 <> 0"
)
def p13_flag_shaky_words(f):
    return reads.flag_shaky_words(f.words_b.where("id % 997 <> 0"), f.segments_b).select("id", "shaky")


@query(
    ctes("meetings_b", "speakers_b")
    + """, p AS (SELECT meeting_id, string_agg(coalesce(nullif(display_name, ''), label), ', ' ORDER BY id) AS attendees, count(*) AS n FROM speakers_b GROUP BY ALL)
    SELECT m.id, title, strftime(CAST(created_at AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d') AS date, printf('%d:%02d', CAST(floor(duration_seconds) AS BIGINT) // 60, CAST(floor(duration_seconds) AS BIGINT) % 60) AS duration,
    CASE language WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' WHEN 'ms' THEN 'Malay' ELSE coalesce(language, '-') END AS language_name, coalesce(n, 0) AS speaker_count, coalesce(attendees, '') AS attendees, coalesce(nullif(summary, ''), 'No summary generated yet.') AS summary FROM meetings_b m LEFT JOIN p ON p.meeting_id = m.id"""
)
def g6_meeting_overview(f):
    return reads.meeting_overview(f.meetings_b, f.speakers_b, "Asia/Kuala_Lumpur")


# --- sources and changes ------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def s1_read_tables(f):
    told = tables.read_tables(f.spark, f.dir, ["embeddings.parquet"], schemas={"embeddings.parquet": "vec_id long, embedding array<float>, label int"})["embeddings.parquet"]
    return told.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(
    """WITH m AS (SELECT doc_id, concat('rec', doc_id, CASE mod(doc_id, 7) WHEN 0 THEN '.TXT' WHEN 1 THEN '.MP3' WHEN 2 THEN '' ELSE '.wav' END) AS filename, n_chars * 300000 AS bytes, CASE mod(doc_id, 5) WHEN 0 THEN ' ' WHEN 1 THEN repeat('x', 300) ELSE lang END AS title, CASE WHEN mod(doc_id, 6) <> 0 THEN mod(doc_id, 23) END AS speakers_, CASE WHEN mod(doc_id, 11) = 0 THEN 'fr' WHEN mod(doc_id, 2) = 0 THEN 'zh' END AS language FROM documents),
    t AS (SELECT *, coalesce(nullif(trim(title), ''), regexp_replace(filename, '\\.[^.]*$', '')) AS name FROM m),
    r AS (SELECT *, CASE WHEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) NOT IN ('mp4', 'mp3', 'wav', 'm4a', 'webm') THEN 'unsupported file type' WHEN bytes > 4294967296 THEN 'file too large' WHEN length(name) > 255 THEN 'bad title' WHEN speakers_ NOT BETWEEN 1 AND 20 THEN 'bad number of speakers' WHEN language = 'fr' THEN 'bad language' END AS reason FROM t)
    SELECT doc_id, name AS title, reason, reason IS NULL AS accepted FROM r"""
)
def s2_check_uploads(f):
    i = F.col("doc_id")
    suffix = F.when(i % 7 == 0, ".TXT").when(i % 7 == 1, ".MP3").when(i % 7 == 2, "").otherwise(".wav")
    manifest = f.documents.select(
        i,
        F.concat(F.lit("rec"), i.cast("string"), suffix).alias("filename"),
        (F.col("n_chars") * 300_000).alias("bytes"),
        F.when(i % 5 == 0, " ").when(i % 5 == 1, F.lit("x" * 300)).otherwise(F.col("lang")).alias("title"),
        F.when(i % 6 != 0, i % 23).alias("expected_speakers"),
        F.when(i % 11 == 0, "fr").when(i % 2 == 0, "zh").alias("language"),
    )
    return tables.check_uploads(manifest).select("doc_id", "title", "reason", "accepted")


@query(ctes("items") + "SELECT id, meeting_id, description FROM items WHERE mod(meeting_id, 3) <> 0 UNION ALL SELECT -id - 1, meeting_id, upper(category) FROM items WHERE mod(meeting_id, 6) = 0")
def s3_replace_meetings(f):
    old = f.items.select("id", "meeting_id", "description")
    new = f.items.where("meeting_id % 6 = 0").select((-F.col("id") - 1).alias("id"), "meeting_id", F.upper("category").alias("description"))
    done = f.items.where("meeting_id % 3 = 0").select("meeting_id")
    path = stage.work_dir(f.spark, "replaced")
    changes.store_table(old, path, _BUCKETS)
    for _ in range(2):  # twice is once
        changes.replace_stored(new, done, path, _BUCKETS)
    return f.spark.read.schema(old.schema).parquet(path).drop("bucket")


_BUCKETS = 32
_PURGED = {"speakers": "speakers_o", "segments": "segments_b", "words": "words_b", "carry_forward": "carried", "items": "items"}


@query(
    ctes("meetings_o", *_PURGED.values())
    + ", gone AS (SELECT id FROM meetings_o WHERE mod(id, 10) = 3), m AS (SELECT * FROM meetings_o ANTI JOIN gone USING (id)) SELECT 'meetings' AS kind, m.id, CASE WHEN g.id IS NULL THEN follow_up_of END AS follow_up_of, CASE WHEN g.id IS NULL THEN carry_forward_status END AS carry_forward_status FROM m LEFT JOIN gone g ON g.id = m.follow_up_of"
    + "".join(f" UNION ALL SELECT '{k}', id, NULL, NULL FROM {t} WHERE meeting_id NOT IN (SELECT id FROM gone)" + (" AND previous_meeting_id NOT IN (SELECT id FROM gone)" if k == "carry_forward" else "") for k, t in _PURGED.items())
)
def j16_purge_meetings(f):
    folder = stage.work_dir(f.spark, "purged")
    stored = {"meetings": f.meetings_o.select("id", F.col("id").alias("meeting_id"), "follow_up_of", "carry_forward_status")} | {k: f.table(t).select("id", "meeting_id", *(["previous_meeting_id"] if k == "carry_forward" else [])) for k, t in _PURGED.items()}
    for name, table in stored.items():
        changes.store_table(table, f"{folder}/{name}", _BUCKETS)
    changes.purge_stored(f.spark, folder, {n: t.schema for n, t in stored.items()}, f.meetings_o.where("id % 10 = 3"), _BUCKETS)
    left = None
    for name, table in stored.items():
        part = f.spark.read.schema(table.schema).parquet(f"{folder}/{name}").withColumn("kind", F.lit(name))
        left = part if left is None else left.unionByName(part, allowMissingColumns=True)
    return left.select("kind", "id", "follow_up_of", "carry_forward_status")


_EDITED = (
    ctes("edits", "carried")
    + """, e AS (SELECT e.*, CASE WHEN c.id IS NULL THEN 'unknown row' WHEN "delete" THEN NULL WHEN len(list_filter(fields, lambda x: x IN ('description', 'owner', 'status', 'note'))) = 0 THEN 'nothing to edit' WHEN list_contains(fields, 'description') AND trim(e.description) = '' THEN 'empty description'
        WHEN list_contains(fields, 'status') AND replace(lower(trim(e.status)), ' ', '_') NOT IN ('completed', 'in_progress', 'blocked', 'changed', 'not_discussed') THEN 'bad status' END AS reason FROM edits e LEFT JOIN carried c ON c.id = e.id AND c.meeting_id = e.meeting_id),
    g AS (SELECT * FROM e WHERE reason IS NULL)"""
)


@query(
    _EDITED
    + """ SELECT c.id, CASE WHEN list_contains(fields, 'description') THEN trim(g.description) ELSE c.description END AS description, CASE WHEN list_contains(fields, 'owner') THEN g.owner ELSE c.owner END AS owner,
    CASE WHEN list_contains(fields, 'status') THEN replace(lower(trim(g.status)), ' ', '_') ELSE c.status END AS status, CASE WHEN list_contains(fields, 'note') THEN g.note ELSE c.note END AS note, c.source_segment_id FROM carried c LEFT JOIN g ON g.id = c.id WHERE NOT coalesce(g."delete", false)"""
)
def j17_apply_edits(f):
    path, table = stage.work_dir(f.spark, "edited"), f.carried
    changes.store_table(table, path, _BUCKETS)
    changes.edit_stored(f.edits, "carry_forward", path, table.schema, _BUCKETS)
    return f.spark.read.schema(table.schema).parquet(path).select("id", "description", "owner", "status", "note", "source_segment_id")


@query(_EDITED + "SELECT edit_id, id, meeting_id, reason IS NULL AS accepted, reason FROM e")
def j17_edit_reasons(f):
    return changes.apply_edits(f.carried, "carry_forward", f.edits)[1]


@query(
    ctes("segments_b", "speakers_b")
    + """, e AS (SELECT s.id, s.meeting_id, CASE WHEN mod(s.segment_no, 2) = 0 THEN 'text' ELSE 'speaker_id' END AS field, CASE WHEN mod(s.id, 6) = 0 THEN ' ' ELSE ' changed ' END AS t, CASE WHEN mod(s.id, 3) = 0 THEN NULL ELSE s.meeting_id * 10 + mod(s.id, 3) END AS p FROM segments_b s),
    g AS (SELECT e.* FROM e LEFT JOIN speakers_b k ON k.id = e.p AND k.meeting_id = e.meeting_id WHERE CASE WHEN field = 'text' THEN trim(t) <> '' ELSE p IS NULL OR k.id IS NOT NULL END)
    SELECT s.id, CASE WHEN field = 'text' THEN trim(t) ELSE text END AS text, CASE WHEN field = 'speaker_id' THEN p ELSE speaker_id END AS speaker_id FROM segments_b s LEFT JOIN g ON g.id = s.id"""
)
def j18_edit_transcript(f):
    edits = f.segments_b.select(
        F.col("id").alias("edit_id"),
        "id",
        "meeting_id",
        F.when(F.col("segment_no") % 2 == 0, F.array(F.lit("text"))).otherwise(F.array(F.lit("speaker_id"))).alias("fields"),
        F.when(F.col("id") % 6 == 0, " ").otherwise(" changed ").alias("text"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("meeting_id") * 10 + F.col("id") % 3).alias("speaker_id"),
    )
    return changes.edit_transcript(f.segments_b, f.speakers_b, edits)[0].select("id", "text", "speaker_id")


# --- minutes and templates ----------------------------------------------------------------------------------------------


def _minute_items(f) -> DataFrame:
    return f.items.withColumn("source_segment_id", F.element_at("source_segment_ids", 1))


@query(
    ctes("items", "segments_b")
    + """, s AS (SELECT id, CAST(floor(start_seconds) AS BIGINT) AS t FROM segments_b)
    SELECT i.id, row_number() OVER (PARTITION BY meeting_id, category ORDER BY i.id) AS number, coalesce(CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END, '-') AS source, coalesce(owner, '-') AS owner, coalesce(nullif(due, ''), '-') AS due, coalesce(nullif(date, ''), '-') AS date, coalesce(mitigation, '-') AS mitigation
    FROM items i LEFT JOIN s ON s.id = source_segment_ids[1]"""
)
def m1_minutes_rows(f):
    return report.minutes_rows(_minute_items(f), f.segments_b).select("id", "number", F.when(F.col("source") == "NULL", "-").otherwise(F.col("source")).alias("source"), "owner", "due", "date", "mitigation")


@query(_series_sql("items") + "SELECT c.id AS series_id, i.id, row_number() OVER (PARTITION BY c.id, category ORDER BY position, i.id) AS number, m.title AS meeting, coalesce(owner, '-') AS owner, coalesce(nullif(due, ''), '-') AS due FROM chain c JOIN items i ON i.meeting_id = c.meeting_id JOIN m ON m.id = c.meeting_id")
def m1_combined_rows(f):
    linked, chain = _series(f)
    pooled = followup.pooled_items(chain, _minute_items(f), linked)
    return report.minutes_rows(pooled, f.segments_b, True).select("series_id", "id", "number", "meeting", "owner", "due")


@query(ORACLES["m1_minutes_rows"])
def s4_write_minutes(f):
    path = stage.work_dir(f.spark, "minutes")
    tables.write_minutes(m1_minutes_rows(f).join(f.items.select("id", "meeting_id"), "id"), path)
    return f.spark.read.parquet(path).drop("bucket", "meeting_id")


@query(
    ctes("items", "meetings_b")
    + """, x AS (SELECT m.id AS meeting_id, unnest(['action_items', 'decisions', 'deadlines', 'issues', 'risks', 'carry_forward']) AS section FROM meetings_b m),
    t AS (SELECT meeting_id, category AS section, string_agg(concat(description, CASE category WHEN 'action_items' THEN ' (' || nullif(owner, '') || ')' WHEN 'deadlines' THEN ' (' || nullif(date, '') || ')' WHEN 'risks' THEN ' (Mitigation: ' || nullif(mitigation, '') || ')' END), '; ' ORDER BY id) AS text FROM items GROUP BY ALL)
    SELECT x.meeting_id, section, coalesce(text, CASE WHEN section = 'carry_forward' THEN 'No previous meeting linked.' ELSE 'None recorded.' END) AS text FROM x LEFT JOIN t USING (meeting_id, section)"""
)
def m2_section_text(f):
    return report.section_text(f.items, f.meetings_b)


_DETAIL = "CASE category WHEN 'action_items' THEN ' (' || nullif(owner, '') || ')' WHEN 'deadlines' THEN ' (' || nullif(date, '') || ')' WHEN 'risks' THEN ' (Mitigation: ' || nullif(mitigation, '') || ')' END"
_SECTIONS_SQL = "['action_items', 'decisions', 'deadlines', 'issues', 'risks', 'carry_forward']"
_COMBINED = (
    _series_sql("items", "speakers_b")
    + f""", t AS (SELECT c.id AS series_id, category AS section, string_agg(concat('[', m.title, '] ', description, {_DETAIL}), '; ' ORDER BY position, i.id) AS text FROM chain c JOIN items i ON i.meeting_id = c.meeting_id JOIN m ON m.id = c.meeting_id GROUP BY ALL),
    sections AS (SELECT x.series_id, x.section, coalesce(text, CASE WHEN section = 'carry_forward' THEN 'No previous meeting linked.' ELSE 'None recorded.' END) AS text FROM (SELECT id AS series_id, unnest({_SECTIONS_SQL}) AS section FROM m) x LEFT JOIN t USING (series_id, section)) """
)


@query(_COMBINED + "SELECT series_id, section, text FROM sections")
def m2_combined_section_text(f):
    linked = _linked(f)
    return report.series_section_text(followup.series_lines(linked), f.items, linked)


_TIME = "CASE WHEN {0} >= 3600 THEN printf('%d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60) ELSE printf('%d:%02d', {0} // 60, {0} % 60) END"
_LANGUAGE = "CASE language WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' WHEN 'ms' THEN 'Malay' ELSE coalesce(nullif(language, ''), '-') END"


@query(
    ctes("meetings_b", "speakers_b", "segments_b", "items")
    + f""", p AS (SELECT meeting_id, string_agg(coalesce(nullif(display_name, ''), label), ', ' ORDER BY id) AS attendees, count(*) AS n FROM speakers_b GROUP BY ALL),
    o AS (SELECT m.id, title, strftime(CAST(created_at AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d') AS date, {_TIME.format("CAST(floor(duration_seconds) AS BIGINT)")} AS duration, {_LANGUAGE} AS language, CAST(coalesce(n, 0) AS VARCHAR) AS participants, coalesce(attendees, '—') AS attendees, coalesce(nullif(summary, ''), 'No summary generated yet.') AS summary FROM meetings_b m LEFT JOIN p ON p.meeting_id = m.id),
    l AS (SELECT s.meeting_id, s.id, start_seconds, concat('[', {_TIME.format("CAST(floor(start_seconds) AS BIGINT)")}, '] ', coalesce(nullif(display_name, ''), label, 'Unknown'), ': ', trim(s.text)) AS line FROM segments_b s LEFT JOIN speakers_b k ON k.id = s.speaker_id),
    t AS (SELECT meeting_id, category AS field, string_agg(concat(description, {_DETAIL}), '; ' ORDER BY id) AS text FROM items GROUP BY ALL)
    SELECT id AS meeting_id, field, value FROM (UNPIVOT o ON title, date, duration, language, participants, attendees, summary INTO NAME field VALUE value)
    UNION ALL SELECT x.id, x.field, coalesce(text, CASE WHEN x.field = 'carry_forward' THEN 'No previous meeting linked.' ELSE 'None recorded.' END) FROM (SELECT id, unnest({_SECTIONS_SQL}) AS field FROM meetings_b) x LEFT JOIN t ON t.meeting_id = x.id AND t.field = x.field
    UNION ALL SELECT m.id, 'transcript', coalesce(string_agg(line, ' / ' ORDER BY start_seconds, l.id), '') FROM meetings_b m LEFT JOIN l ON l.meeting_id = m.id GROUP BY m.id"""
)
def m2_marker_values(f):
    overview = reads.meeting_overview(f.meetings_b, f.speakers_b, "Asia/Kuala_Lumpur")
    return report.marker_values(overview, report.section_text(f.items, f.meetings_b), report.transcript_text(reads.transcript(f.segments_b, f.speakers_b)))


@query(
    _COMBINED
    + f""", own AS (SELECT c.id AS series_id, position, b.title, strftime(CAST(b.created_at AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, duration_seconds, {_LANGUAGE} AS language, coalesce(nullif(b.summary, ''), 'No summary generated yet.') AS summary FROM chain c JOIN meetings_b b ON b.id = c.meeting_id),
    spoke AS (SELECT c.id AS series_id, coalesce(nullif(display_name, ''), label) AS name, min(struct_pack(a := position, b := s.id)) AS first_ FROM chain c JOIN speakers_b s ON s.meeting_id = c.meeting_id GROUP BY ALL),
    people AS (SELECT series_id, string_agg(name, ', ' ORDER BY first_) AS attendees, CAST(count(*) AS VARCHAR) AS participants FROM spoke GROUP BY ALL),
    langs AS (SELECT series_id, string_agg(language, ', ' ORDER BY p) AS language FROM (SELECT series_id, language, min(position) AS p FROM own GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT series_id, count(*) AS n, min_by(day, position) AS a, max_by(day, position) AS b, CAST(sum(CAST(round(duration_seconds * 1e6) AS BIGINT)) // 1000000 AS BIGINT) AS s, max_by(title, position) AS last, string_agg(concat(title, ' (', day, '): ', summary), chr(10) ORDER BY position) AS summary FROM own GROUP BY ALL),
    o AS (SELECT series_id, concat(last, CASE WHEN n > 1 THEN concat(' (combined series of ', n, ' meetings)') ELSE '' END) AS title, CASE WHEN a = b THEN a ELSE concat(a, ' to ', b) END AS date, {_TIME.format("s")} AS duration, language, coalesce(participants, '0') AS participants, coalesce(attendees, '—') AS attendees, summary,
        concat('Full transcripts are not reproduced in a combined document - each of the ', n, ' meeting', CASE WHEN n <> 1 THEN 's' ELSE '' END, ' in this series carries its verbatim record in its own export.') AS transcript FROM g JOIN langs USING (series_id) LEFT JOIN people USING (series_id))
    SELECT series_id, field, value FROM (UNPIVOT o ON title, date, duration, language, participants, attendees, summary, transcript INTO NAME field VALUE value) UNION ALL SELECT series_id, section, text FROM sections"""
)
def m2_series_values(f):
    linked = _linked(f)
    lines = followup.series_lines(linked)
    sections = report.series_section_text(lines, f.items, linked)
    return report.series_values(lines, reads.meeting_overview(f.meetings_b, f.speakers_b, "Asia/Kuala_Lumpur"), f.meetings_b, f.speakers_b, sections)


# a literal list for DuckDB; matched: the lines that match exactly or by a contained name, among all fields or the scalar ones
_NAMES = "names AS (SELECT unnest([" + ", ".join(f"struct_pack(name := '{n}', field := '{k}', place := {p})" for p, (n, k) in enumerate((n, k) for k, v in headings.SYNONYMS.items() for n in v)) + "], recursive := true))"
_SCALARS = ", ".join(f"'{s}'" for s in headings.SCALAR)
_CONTAINED = r"""SELECT template_id, line_no, min_by(field, struct_pack(a := -length(name), b := name)) AS field FROM l JOIN names ON loose AND length(name) >= 4 AND contains(name_, name) AND (regexp_matches(name, '[㐀-䶿一-鿿]') OR regexp_matches(concat(' ', name_, ' '), concat('[^a-z]', replace(replace(name, '.', '\.'), '-', '\-'), '[^a-z]')))"""
_MATCHED = (
    ctes("template_lines")
    + ", "
    + _NAMES
    + r""", n AS (SELECT *, regexp_replace(trim(regexp_replace(trim(lower(coalesce(text, ''))), '[:：.。]+$', '')), '\s+', ' ', 'g') AS name_, starts_with(style, 'Heading') AS head FROM template_lines),
    l AS (SELECT *, head OR (len(string_split(name_, ' ')) <= 6 AND NOT regexp_matches(trim(text), '[.!?。！？]$')) AS loose FROM n),
    """
    + f"""c AS ({_CONTAINED} GROUP BY ALL), cs AS ({_CONTAINED} WHERE field IN ({_SCALARS}) GROUP BY ALL),
    matched AS (SELECT l.*, coalesce(e.field, c.field) AS field, CASE WHEN e.field IS NULL THEN cs.field WHEN e.field IN ({_SCALARS}) THEN e.field END AS scalar, loose AND e.field IS NULL AND name_ <> '' AS open_
        FROM l LEFT JOIN names e ON e.name = name_ LEFT JOIN c ON c.template_id = l.template_id AND c.line_no = l.line_no LEFT JOIN cs ON cs.template_id = l.template_id AND cs.line_no = l.line_no) """
)
# the longest common run of two pieces, the first of equal ones, with what is left and right of it as the next two pieces
_RUN = "list_max(list_transform(range(1, length({x}) + 1), lambda i: struct_pack(n := len(list_filter(range(1, length({x}) - i + 2), lambda k: contains({y}, substring({x}, i, k)))), back := -i)))"
_RATIO = (
    _MATCHED
    + f""", pair AS (SELECT DISTINCT name_ AS a, name AS b FROM matched JOIN names ON open_ AND (matched.field IS NULL OR scalar IS NULL) AND 20 * least(length(name_), length(name)) >= 9 * (length(name_) + length(name))),
    walk AS (SELECT a, b, a AS x, b AS y, {_RUN.format(x="a", y="b")} AS run FROM pair UNION ALL
        SELECT a, b, p.x, p.y, {_RUN.format(x="p.x", y="p.y")} FROM (SELECT a, b, unnest([struct_pack(x := substring(x, 1, -run.back - 1), y := substring(y, 1, j - 1)), struct_pack(x := substring(x, run.n - run.back, length(x)), y := substring(y, j + run.n, length(y)))]) AS p
            FROM (SELECT *, instr(y, substring(x, -run.back, run.n)) AS j FROM walk WHERE run.n > 0)) WHERE p.x <> '' AND p.y <> ''),
    near AS (SELECT a, field, place, 2e0 * n / (length(a) + length(b)) AS ratio FROM (SELECT a, b, sum(run.n) AS n FROM walk GROUP BY ALL) JOIN names ON name = b),
    best AS (SELECT a, min_by(field, struct_pack(r := -ratio, p := place)) AS field, min_by(field, struct_pack(r := -ratio, p := place)) FILTER (field IN ({_SCALARS})) AS scalar FROM near WHERE ratio >= 0.9 GROUP BY a),
    closest AS (SELECT m.template_id, m.line_no, kind, next_text, coalesce(m.field, b.field) AS field, coalesce(m.scalar, b.scalar) AS scalar FROM matched m LEFT JOIN best b ON open_ AND b.a = name_) """
)


@query(_MATCHED + "SELECT template_id, line_no, field FROM matched")
def m4_match_heading(f):
    return headings.match_headings(f.template_lines, ratio=False).select("template_id", "line_no", "field")


_TYPED = "(SELECT * REPLACE (CASE WHEN mod(template_id, 12) = 1 THEN 'Actoin items' ELSE text END AS text) FROM template_lines)"


@query(_RATIO.replace("AS head FROM template_lines)", f"AS head FROM {_TYPED})") + "SELECT template_id, line_no, field FROM closest")
def m4_match_heading_ratio(f):
    typed = f.template_lines.withColumn("text", F.when(F.col("template_id") % 12 == 1, "Actoin items").otherwise(F.col("text")))
    return headings.match_headings(typed).select("template_id", "line_no", "field")


_MARKS = _RATIO + r""", marks AS (SELECT template_id, line_no, n2.field FROM (SELECT template_id, line_no, unnest(regexp_extract_all(text, '\[\[\s*(.+?)\s*\]\]', 1)) AS m FROM template_lines) JOIN names n2 ON n2.name = trim(lower(m))),
    cells AS (SELECT * REPLACE (scalar AS field) FROM closest WHERE kind = 'cell' AND next_text IS NOT NULL AND scalar IS NOT NULL), heads AS (SELECT * FROM closest WHERE kind = 'paragraph' AND field IS NOT NULL) """


@query(
    _MARKS
    + """, found AS (SELECT template_id, field FROM marks UNION SELECT template_id, field FROM cells UNION SELECT template_id, field FROM heads), g AS (SELECT template_id, list(field ORDER BY field) AS fs FROM found GROUP BY ALL)
    SELECT t.template_id, array_to_string(coalesce(fs, []), ',') AS fields, array_to_string(list_filter(['summary', 'action_items', 'decisions', 'deadlines', 'issues', 'risks'], lambda x: NOT list_contains(coalesce(fs, []), x)), ',') AS missing FROM (SELECT DISTINCT template_id FROM template_lines) t LEFT JOIN g USING (template_id)"""
)
def m5_recognised_fields(f):
    return headings.recognised_fields(f.template_lines).select("template_id", F.array_join("fields", ",").alias("fields"), F.array_join("missing", ",").alias("missing"))


_VALUES = (("summary", "All went well"), ("title", "Plan"), ("decisions", "None recorded."), ("date", "2024-03-01"))


def _values(f) -> DataFrame:
    return f.spark.createDataFrame(_VALUES, "field string, value string")


@query(ctes("template_lines") + "SELECT template_id, line_no, replace(replace(replace(text, '[[ Summary ]]', 'All went well'), '[[title]]', 'Plan'), '[[decisions]]', 'None recorded.') AS filled FROM template_lines")
def m6_fill_markers(f):
    return headings.fill_markers(f.template_lines, _values(f)).select("template_id", "line_no", "filled")


@query(
    _MARKS
    + r""", places AS (SELECT template_id, field, 0 AS o FROM marks UNION ALL SELECT template_id, field, 1 FROM cells WHERE trim(next_text) = '' OR regexp_full_match(trim(next_text), '\[\[\s*(.+?)\s*\]\]') UNION ALL SELECT template_id, field, 2 FROM heads),
    first_ AS (SELECT template_id, field, min(o) AS o FROM places GROUP BY ALL) SELECT t.template_id, d.field, CASE o WHEN 0 THEN 'marker' WHEN 1 THEN 'table-label' WHEN 2 THEN 'heading' ELSE 'skipped' END AS way
    FROM (SELECT DISTINCT template_id FROM template_lines) t CROSS JOIN (SELECT unnest(['summary', 'title', 'decisions', 'date']) AS field) d LEFT JOIN first_ b ON b.template_id = t.template_id AND b.field = d.field"""
)
def m7_placement_report(f):
    return headings.placement_report(f.template_lines, _values(f))


# --- progress -----------------------------------------------------------------------------------------------------------


@query(
    ctes("progress_events")
    + """, b AS (SELECT *, min(struct_pack(p := progress, t := epoch_us(ts))) OVER (PARTITION BY meeting_id, stage ORDER BY ts, progress ROWS UNBOUNDED PRECEDING) AS base FROM progress_events WHERE stage IN ('transcribing', 'categorizing'))
    SELECT meeting_id, stage, epoch_us(ts) AS at, progress, CASE WHEN progress - base.p > 0.005 AND epoch_us(ts) > base.t THEN round((1 - progress) * ((epoch_us(ts) - base.t) / 1e6) / (progress - base.p), 3) END AS eta_seconds FROM b"""
)
def w8_progress_eta(f):
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return progress.progress_eta(f.progress_events).select("meeting_id", "stage", at.alias("at"), "progress", "eta_seconds")


@query(ctes("progress_events") + "SELECT meeting_id, max_by(stage, struct_pack(a := ts, b := stage)) AS stage, max_by(progress, struct_pack(a := ts, b := stage)) AS progress FROM progress_events GROUP BY meeting_id")
def t2_latest_status(f):
    return progress.latest_status(f.progress_events).select("meeting_id", "stage", "progress")


@query(
    ctes("progress_events")
    + """, k AS (SELECT meeting_id, epoch_us(ts) AS us, stage, progress * 400 / 350 AS progress, row_number() OVER (PARTITION BY meeting_id ORDER BY ts, stage, progress) AS k FROM progress_events),
    walk AS (SELECT k.*, us AS last_us, true AS passed FROM k WHERE k = 1 UNION ALL
        SELECT n.*, CASE WHEN n.us - w.last_us >= 21600000000 THEN n.us ELSE w.last_us END, n.us - w.last_us >= 21600000000 FROM walk w JOIN k n ON n.meeting_id = w.meeting_id AND n.k = w.k + 1)
    SELECT meeting_id, us AS "at", stage, round(least(1, greatest(0, progress)), 6) AS progress FROM walk WHERE passed"""
)
def t1_throttle_progress(f):
    heard = f.progress_events.select("meeting_id", "ts", "stage", (F.col("progress") * 400).alias("seconds"), F.lit(350.0).alias("total_seconds"))
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return progress.throttle_batch(heard, 6 * 3600.0).select("meeting_id", at.alias("at"), "stage", F.round("progress", 6).alias("progress"))


@query(ORACLES["w8_progress_eta"])
def t3_progress_eta_states(f):
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return progress.progress_eta_batch(f.progress_events).select("meeting_id", "stage", at.alias("at"), "progress", "eta_seconds")


@query(
    ctes("meetings_o")
    + "SELECT status, swept, count(*) AS n FROM (SELECT CASE WHEN status IN ("
    + ", ".join(f"'{s}'" for s in changes.BUSY)
    + ") THEN 'error: interrupted by server restart' WHEN status = 'categorizing' THEN 'categorize_failed: interrupted by server restart' ELSE status END AS status, status IN ("
    + ", ".join(f"'{s}'" for s in (*changes.BUSY, "categorizing"))
    + ") AS swept FROM meetings_o) GROUP BY ALL"
)
def t4_sweep_orphans(f):
    return changes.sweep_orphans(f.meetings_o).groupBy("status", "swept").agg(F.count("*").alias("n"))
