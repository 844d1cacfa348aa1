"""Template lines: which field of the minutes a heading, label or marker stands for, and where each field is placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import CJK
from parley.sources.stage import stored

# The names by which templates call a field.
SYNONYMS = {
    "title": ["meeting title", "title", "meeting name", "subject", "meeting subject", "会议标题", "标题", "会议主题", "主题", "tajuk", "tajuk mesyuarat", "nama mesyuarat"],
    "date": ["date", "meeting date", "日期", "会议日期", "tarikh", "tarikh mesyuarat"],
    "duration": ["duration", "length", "会议时长", "时长", "tempoh", "tempoh mesyuarat", "jangka masa"],
    "language": ["language", "languages", "语言", "bahasa"],
    "participants": ["participant count", "number of participants", "no of participants", "no. of participants", "headcount", "人数", "参与人数", "与会人数", "出席人数", "bilangan peserta", "jumlah peserta", "bilangan kehadiran"],
    "attendees": ["attendees", "attendee", "participants", "participant", "present", "attendance", "出席", "出席人员", "与会者", "参与者", "参会人员", "参加人员", "kehadiran", "hadirin", "peserta", "yang hadir", "ahli hadir", "senarai kehadiran"],
    "summary": ["summary", "meeting summary", "overview", "abstract", "executive summary", "摘要", "会议摘要", "概要", "总结", "会议总结", "内容摘要", "ringkasan", "ringkasan mesyuarat", "rumusan", "intisari"],
    "action_items": ["action items", "action item", "actions", "action points", "action plan", "tasks", "task list", "to-do", "to do", "todo", "follow-ups", "follow ups", "行动项", "行动事项", "待办", "待办事项", "任务", "任务清单", "行动计划", "跟进事项", "tindakan", "senarai tindakan", "tindakan susulan", "perkara tindakan", "tugasan", "senarai tugasan"],
    "decisions": ["key decisions", "decisions", "decision", "decisions made", "resolutions", "agreements", "决策", "决定", "关键决策", "议决", "决议", "达成的决定", "keputusan", "keputusan penting", "ketetapan", "resolusi"],
    "deadlines": ["deadlines", "deadline", "due dates", "due date", "timeline", "timelines", "key dates", "schedule", "期限", "截止日期", "截止时间", "时间表", "时间节点", "重要日期", "tarikh akhir", "tarikh tutup", "garis masa", "jadual", "tempoh masa"],
    "issues": ["technical issues", "issues", "issue", "problems", "problem", "roadblocks", "blockers", "challenges", "技术问题", "问题", "障碍", "技术难题", "待解决问题", "难点", "isu", "isu teknikal", "masalah", "permasalahan", "kekangan"],
    "risks": ["risks", "risk", "risks and mitigations", "risk and mitigation", "风险", "风险与缓解", "风险点", "潜在风险", "隐患", "risiko", "potensi risiko", "risiko dan langkah"],
    "carry_forward": ["matters arising", "progress since last meeting", "previous action items", "previous actions", "outstanding actions", "carry forward", "carried forward", "follow-up on previous meeting", "review of previous minutes", "上次会议跟进", "上次会议回顾", "前次行动项", "上次行动事项", "perkara berbangkit", "kemajuan tindakan lepas", "tindakan mesyuarat lepas"],
    "transcript": ["transcript", "full transcript", "meeting transcript", "verbatim", "verbatim record", "full record", "逐字稿", "全文", "完整记录", "会议全文", "transkrip", "transkrip penuh", "minit penuh"],
}
SCALAR = ("title", "date", "duration", "language", "participants", "attendees")
CORE = ("summary", "action_items", "decisions", "deadlines", "issues", "risks")
LEAST_RATIO = 0.9
MARKER = r"\[\[\s*(.+?)\s*\]\]"
#: Words of a line that may hold a name loosely (no name has more), the beginning of a line that has more, characters of the longest name.
WORDS = 6
MORE_WORDS = rf"(?U)^\s*(?:\S+\s+){{{WORDS}}}[^\s:：.。]"
LONGEST = max(len(name) for names in SYNONYMS.values() for name in names)


def normal_name(text: Column) -> Column:
    """Lower case, trimmed, without colons and full stops at the end, single spaces; null as ''."""
    t = F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), "[:：.。]+$", ""))
    return F.regexp_replace(t, r"(?U)\s+", " ")


def synonyms(spark: SparkSession, scalar_only: bool = False) -> DataFrame:
    """name, field, place (in the list): about two hundred rows, fixed."""
    rows = {}
    for field, names in SYNONYMS.items():
        for name in names:
            rows[name] = field
    return spark.createDataFrame([(n, f, k) for k, (n, f) in enumerate(rows.items()) if f in SCALAR or not scalar_only], "name string, field string, place int")


def matched_letters(a: Column, b: Column) -> Column:
    """How many letters of two texts lie in matching blocks: the longest common run (of equal ones the first in a, then in b), and
    so on in what is left of it and right of it. A fold over a stack of pairs of pieces; each step takes one pair off."""
    named = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    state = lambda todo, met: F.struct(todo.alias("todo"), met.alias("met"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k > 0)  # noqa: E731  from 1, none if n is 0

    def block(x: Column, y: Column) -> Column:
        run = lambda i: F.size(F.filter(upto(F.length(x) - i + 1), lambda n: F.contains(y, F.substr(x, i, n))))
        return F.array_max(F.transform(upto(F.length(x)), lambda i: F.struct(run(i).alias("n"), (-i).alias("back"))))

    def split(s: Column, x: Column, y: Column, n: Column, i: Column, j: Column) -> Column:
        sides = F.array(named(F.substr(x, F.lit(1), i - 1), F.substr(y, F.lit(1), j - 1)), named(F.substr(x, i + n), F.substr(y, j + n)))
        rest = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)
        both = F.filter(sides, lambda p: (p["x"] != "") & (p["y"] != ""))
        return F.when(n > 0, state(F.concat(rest, both), s["met"] + n)).otherwise(state(rest, s["met"]))

    def step(s: Column, _: Column) -> Column:
        top = F.element_at(s["todo"], -1)
        cut = F.transform(F.array(block(top["x"], top["y"])), lambda m: split(s, top["x"], top["y"], m["n"], -m["back"], F.instr(top["y"], F.substr(top["x"], -m["back"], m["n"]))))[0]
        return F.when(F.size(s["todo"]) == 0, s).otherwise(cut)

    steps = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) * 2 + 1)
    return F.aggregate(steps, state(F.array(named(a, b)), F.lit(0)), step, lambda s: s["met"])


def closest(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """_name, _field: the field of the name that is most like each distinct _name, if the ratio of matching letters reaches
    LEAST_RATIO; of equal ratios the first of the list. names: _name, not null; a name of no like one gives no row.

    A name meets only those of a length and a stock of letters that can reach the ratio: an equi-join by length with a fixed table
    of some thousand rows, so that long lines meet nothing.
    """
    least = F.lit(LEAST_RATIO)
    m = F.length("name")
    lengths = F.filter(F.sequence(F.lit(1), m * 2), lambda n: F.least(n, m) * 2.0 / (n + m) >= least)
    near = synonyms.select("name", "field", "place", F.explode(lengths).alias("_length"))
    total = F.length("_name") + F.length("name")
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("name", "")), F.lit(0), lambda n, c: n + F.least(count(F.col("_name"), c), count(F.col("name"), c)))
    pairs = names.select("_name").distinct().withColumn("_length", F.length("_name")).join(F.broadcast(near), "_length").where(shared * 2.0 / total >= least)
    told = pairs.withColumn("_ratio", matched_letters(F.col("_name"), F.col("name")) * 2.0 / total).where(F.col("_ratio") >= least)
    return told.groupBy("_name").agg(F.min_by("field", F.struct(-F.col("_ratio"), "place")).alias("_field"))


def _named(lines: DataFrame) -> DataFrame:
    """lines with _loose (may hold a name within, or be like one) and _name, the text by which they are matched.

    What isn't loose can only be a name as it stands, so that one character more than the longest name has tells that it is none.
    Lines with more words than a name has, most of a page, are told by their beginning and not put into plain form at all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    heading = F.coalesce(F.col("style"), F.lit("")).rlike("^(Heading|Title)")
    told = lines.withColumn("_long", ~heading & text.rlike(MORE_WORDS))
    told = told.withColumn("_plain", F.when(~F.col("_long"), normal_name(F.col("text"))))
    loose = heading | ((F.size(F.split("_plain", " ")) <= WORDS) & ~F.trim("text").rlike("[.!?。！？]$"))
    told = told.withColumn("_loose", F.when(F.col("_long"), False).otherwise(loose))
    name = F.when(F.col("_long"), F.left(text, F.lit(LONGEST + 1))).when(F.col("_loose"), F.col("_plain")).otherwise(F.left("_plain", F.lit(LONGEST + 1)))
    return told.withColumn("_name", name).drop("_long", "_plain")


def _may_match() -> Column:
    return (F.col("_name") != "") & (F.col("_loose") | (F.length("_name") <= LONGEST))


def _found(told: DataFrame, scalar_only: bool, ratio: bool) -> DataFrame:
    """_name, _loose, _field of the distinct names in told that stand for a field."""
    spark = told.sparkSession
    distinct = stored(told.where(_may_match()).select("_name", "_loose").distinct(), "names")  # asked three times
    names = F.broadcast(synonyms(spark, scalar_only).drop("place"))  # fixed size
    if scalar_only:  # a name of another field is no loose match either
        taken = synonyms(spark).where(~F.col("field").isin(*SCALAR)).select(F.col("name").alias("_name"))
        distinct = distinct.join(F.broadcast(taken), "_name", "left_anti")
    exact = distinct.join(names, F.col("_name") == F.col("name")).select("_name", "_loose", F.col("field").alias("_field"))
    # few bytes but much work for each name: all partitions, which a number given keeps from being put together
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = distinct.join(exact, ["_name", "_loose"], "left_anti").where("_loose").repartition(parts, "_name")
    long_ = names.where(F.length("name") >= 4)
    # names are letters, spaces, full stops and hyphens; a name's neighbours must not be letters
    wide = F.col("name").rlike(CJK)
    word = F.regexp_replace(F.col("name"), r"([.\-])", r"\\$1")
    inside = F.when(wide, F.col("_name").contains(F.col("name"))).otherwise(F.col("_name").contains(F.col("name")) & F.rlike("_name", F.concat(F.lit("(?<![a-z])"), word, F.lit("(?![a-z])"))))
    contained = rest.join(long_, inside).groupBy("_name", "_loose").agg(F.min_by("field", F.struct(-F.length("name"), "name")).alias("_field"))
    found = exact.unionByName(contained)
    if ratio:
        left = rest.join(contained, ["_name", "_loose"], "left_anti")
        found = found.unionByName(left.join(closest(left, synonyms(spark, scalar_only)), "_name").select("_name", "_loose", "_field"))
    return found


def match_headings(lines: DataFrame, scalar_only: bool = False, ratio: bool = True) -> DataFrame:
    """M4: lines (template_id, line_no, style, text) with field: an exact name; else, for headings and lines of at most six
    words without a sentence end, the longest contained name of four characters or more (a whole word unless Chinese), else
    the closest name from a ratio of 0.9 on. Distinct lines are matched once, and only those that can match."""
    told = _named(lines)
    return told.join(_found(told, scalar_only, ratio), ["_name", "_loose"], "left").withColumnRenamed("_field", "field").drop("_name", "_loose")


def markers(lines: DataFrame) -> DataFrame:
    """template_id, line_no, field of every known [[marker]] in the lines."""
    return _marked(lines.withColumn("_marks", F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))))


def _marked(told: DataFrame) -> DataFrame:
    names = F.broadcast(synonyms(told.sparkSession).drop("place"))
    found = told.select("template_id", "line_no", F.explode("_marks").alias("_m")).withColumn("_name", normal_name(F.col("_m")))
    return found.join(names, F.col("_name") == F.col("name")).select("template_id", "line_no", "field")


def _told(lines: DataFrame) -> DataFrame:
    """What M5 and M7 ask of each line, as an intermediate table, so that lines are made and searched once: template_id, line_no,
    kind, _next (a cell's right neighbour: has one), _blank (to be filled), _name and _loose (null unless it may match), _marks."""
    blank = (F.trim("next_text") == "") | F.trim("next_text").rlike(f"^{MARKER}$")
    told = _named(lines).withColumns({"_next": F.col("next_text").isNotNull(), "_blank": F.coalesce(blank, F.lit(False)), "_marks": F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))})
    return stored(told.select("template_id", "line_no", "kind", "_next", "_blank", F.when(_may_match(), F.col("_name")).alias("_name"), "_loose", "_marks"), "headings")


def _placed(told: DataFrame, cells: Column, ratio: bool) -> DataFrame:
    """template_id, line_no, field, way of the markers, of the cells with a scalar field, and of the paragraphs."""
    one = lambda df, scalar: df.join(_found(df, scalar, ratio), ["_name", "_loose"]).withColumn("way", F.lit("table-label" if scalar else "heading"))
    labels, heads = one(told.where((F.col("kind") == "cell") & cells), True), one(told.where("kind = 'paragraph'"), False)
    by_name = labels.unionByName(heads).select("template_id", "line_no", F.col("_field").alias("field"), "way")
    return _marked(told).withColumn("way", F.lit("marker")).unionByName(by_name)


def placements(lines: DataFrame, ratio: bool = True) -> DataFrame:
    """template_id, line_no, field, way (marker, table-label, heading) of every place that a template offers.

    lines: template_id, line_no, kind (paragraph or cell), style, text, next_text (of a cell's right neighbour).
    """
    return _placed(_told(lines), F.col("_blank"), ratio)


def recognised_fields(lines: DataFrame, ratio: bool = True) -> DataFrame:
    """M5: template_id, fields (sorted, distinct) and missing (core fields that the template has no place for)."""
    told = _told(lines)
    sets = _placed(told, F.col("_next"), ratio).groupBy("template_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    every = told.select("template_id").distinct().join(sets, "template_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    return every.withColumn("missing", F.array_except(F.array(*[F.lit(c) for c in CORE]), F.col("fields")))


def fill_markers(lines: DataFrame, values: DataFrame) -> DataFrame:
    """M6: lines with each known [[marker]] replaced by its value (values: field, value); unknown ones stay."""
    split = F.split(F.regexp_replace("text", MARKER, "\u0001[[$1]]\u0001"), "\u0001")
    parts = lines.select("template_id", "line_no", F.posexplode(split).alias("_k", "_part")).withColumn("_name", normal_name(F.regexp_extract("_part", f"^{MARKER}$", 1)))
    names = F.broadcast(synonyms(lines.sparkSession).drop("place"))
    known = parts.join(names, (F.col("_name") == F.col("name")) & (F.col("_name") != ""), "left").join(values, "field", "left")
    rows = F.sort_array(F.collect_list(F.struct("_k", F.coalesce("value", "_part").alias("t"))))
    texts = known.groupBy("template_id", "line_no").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("filled"))
    return lines.join(texts, ["template_id", "line_no"], "left")


def placement_report(lines: DataFrame, data_fields: DataFrame, ratio: bool = True) -> DataFrame:
    """M7: template_id, field, way: how each field with data (field) is placed: by marker, else table label, else heading;
    'skipped' where it has no place. Names that are no field of the minutes are left out."""
    order = F.when(F.col("way") == "marker", 0).when(F.col("way") == "table-label", 1).otherwise(2)
    best = Window.partitionBy("template_id", "field").orderBy(order, "line_no")
    told = _told(lines)
    placed = _placed(told, F.col("_blank"), ratio).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("template_id", "field", "way")
    every = F.explode(F.array(*[F.lit(f) for f in SYNONYMS])).alias("field")  # the fields that there are
    wanted = told.select("template_id").distinct().select("template_id", every).join(data_fields.select("field"), "field", "left_semi")
    return wanted.join(placed, ["template_id", "field"], "left").withColumn("way", F.coalesce("way", F.lit("skipped")))
