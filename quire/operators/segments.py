"""Soft-broken paragraphs: when lines become segments of their own, where, and what short lines look like.

A physical paragraph is an array of lines; its decision is one row's expression, the paragraph behind it comes
from one window over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import predicates as P
from quire.plans.registry import query
from quire.sources.phrases import PHRASES_SQL, phrases
from quire.sources.tables import table

# Shapes of lines that begin a segment.
NUMBER = r"^(?:[一二三四五六七八九十百]+[、.．]+|[（(][一二三四五六七八九十百]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)]|\[[0-9]+\]|-\s*[0-9]+\s*-)"
DISPATCH = r"^[一-鿿A-Za-z0-9]{0,20}[〔\[][0-9]{4}[〕\]][0-9]+号$"
HEAD_DATE = r"^[（(](?:(?:19|20)[0-9]{2}|[零〇○一二两三四五六七八九]{4})年[0-9一二两三四五六七八九十〇○×X]{1,3}月[0-9一二两三四五六七八九十〇○×X]{1,3}[日号][）)]$"
MEETING = r"^在[一-鿿A-Za-z0-9（）()、，,.·\-]{3,70}(?:会议|大会|全会|座谈会|论坛|仪式|活动)(?:上|期间|时)$"
SPEECH = r"^在[一-鿿A-Za-z0-9（）()、，,.·\-\s]{3,70}上?的?讲话$"
ATTACHMENT = "^附件"
KEY_VALUE = "^[“\"]?(?:" + "|".join(K.KEY_LABELS) + ")[:：].+"
ANNUAL = ("一年来", "五年来")
ORG = "^.{2,30}$", "(?:" + "|".join(P.ORG_SUFFIXES) + ")$", "^(?:" + "|".join(P.NEGATIVE_STARTS) + ")|[。；;：:]"
STYLES = (
    ("title", "main_title", 0.44), ("标题", "main_title", 0.44), ("subtitle", "title_continuation", 0.42), ("副标题", "title_continuation", 0.42),
    *((f"{name}{k}", f"heading_{k}", 0.40) for k in range(1, 5) for name in ("heading", "标题")), ("normal", "body", 0.30), ("正文", "body", 0.30),
)

# Derived lines: in this order they meet every rule.
LINES = (
    "关于开展工作的报告", "（2024年3月5日）", "在全市工作会议上", "某某市财政局", "2024年3月5日", "一、总体要求", "各部门要认真落实", "确保取得实效。", "内政发〔2024〕15号", "各部门要按时完成",
    "各位代表：", "现在报告工作", "同志们：", "时间：上午九时", "地点：会议室", "各部门要认真落实", "同志们！", "现在报告工作", "2024年3月5日", "附件：1.工作方案",
    "各部门要按时完成", "[1] 说明", "- 3 -", "某某市人民政府", "请各单位落实", "加强组织领导", "各单位抓好落实", "某某市教育局", "２０２４年", "在全市工作会议上的讲话", "各位代表：现在我代表市政府报告工作。",
    "一年来。", "一年来。各项工作取得新的成效。", "三、主要任务。各部门要认真落实。", "（二）重点任务。各部门要认真落实。", "某某市财政局2024年3月5日", "（二〇二四年三月×日）", "四、原因如下：认识不足，落实不够。各部门要认真落实。",
    "各县区：", "抄送：某某市财政局", "特此报告。", "附件 二", "重点任务清单", "第三条 各部门应当遵守规定", "联系人：", "⑦补充说明",
)

LINES_SQL = (
    "(select doc_id, nth, nth * 2 // 5 as para, [" + ", ".join(f"'{x}'" for x in LINES) + f"][case when doc_id % 2 = 0 then nth else k end % {len(LINES)} + 1] as text "
    "from (select o_custkey // 8 as doc_id, o_orderkey as k, row_number() over (partition by o_custkey // 8 order by o_orderkey) - 1 as nth from orders))"
)
PARAGRAPHS_SQL = f"(select doc_id, para, list(text order by nth) as lines from {LINES_SQL} group by all)"


def soft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, nth, para, text): lines of paragraphs of two and three; every other document has them in their order."""
    k = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("k"))
    nth = (F.row_number().over(W.partitionBy("doc_id").orderBy("k")) - 1).cast("bigint")
    at = F.when(F.col("doc_id") % 2 == 0, F.col("nth")).otherwise(F.col("k")) % len(LINES)
    return k.withColumn("nth", nth).select("doc_id", "nth", F.floor(F.col("nth") * 2 / 5).alias("para"), F.get(F.array(*map(F.lit, LINES)), at.cast("int")).alias("text"))


def soft_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para, lines): a group is one paragraph's lines."""
    g = soft_lines(spark, sf_dir).groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("l"))
    return g.select("doc_id", "para", F.transform("l", lambda x: x["text"]).alias("lines"))


def is_org(text: Column) -> Column:
    return text.rlike(ORG[0]) & text.rlike(ORG[1]) & ~text.rlike(ORG[2])


def is_date(text: Column) -> Column:
    return text.rlike(P.sign_date_pattern())


def is_addressing(text: Column) -> Column:
    return P.compact(text).rlike(K.ADDRESSING)


def front_profile(lines: Column) -> Column:
    """Short titles, one parenthesised date, then only meeting descriptions."""
    date = lambda x: P.compact(x).rlike(HEAD_DATE)
    meeting = lambda x: P.compact(x).rlike(MEETING)
    short = lambda x: (F.length(P.compact(x)) <= 60) & ~P.compact(x).rlike("[。！？；;：:]|^[一二三四五六七八九十]+、")
    place = F.array_position(F.transform(lines, date), True).cast("int")
    before = F.slice(lines, F.lit(1), F.greatest(place - 1, F.lit(0)))
    inside = (F.size(F.filter(lines, date)) == 1) & (place > 1) & (place < F.size(lines))
    return (F.size(lines) >= 3) & inside & F.forall(before, short) & F.forall(F.slice(lines, place + 1, F.size(lines)), meeting)


def split_rule(lines: Column, date_follows: Column) -> Column:
    """The first rule by which soft-broken lines become segments; NULL if they stay together. Lines are stripped and not empty; date_follows: the next paragraph's first is a date.

    Of the eleven rules two are not here: a role with a name in the last line, a role with a date below it.
    """
    first, second, last = F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.element_at(lines, -1)
    rest = F.slice(lines, 2, F.size(lines))
    dated = F.exists(F.slice(lines, 1, 2), is_date)
    return F.when(F.size(lines) >= 2, F.coalesce(
        F.when(front_profile(lines), "front_profile"),
        F.when(F.exists(rest, lambda x: x.rlike(NUMBER)), "number_inside"),
        F.when(first.rlike(NUMBER), "number_first"),
        F.when(P.compact(first).rlike(DISPATCH), "dispatch"),
        F.when(F.size(F.filter(lines, lambda x: P.compact(x).rlike(KEY_VALUE))) >= 2, "key_values"),
        F.when(dated & F.exists(rest, lambda x: x.rlike(ATTACHMENT)), "date_attachment"),
        F.when((F.size(lines) == 2) & is_org(first) & is_date(second), "signature"),
        F.when(F.exists(rest, is_addressing), "addressing"),
        F.when(date_follows & (F.length(last) <= 30) & ~last.rlike("[。；;：:]"), "date_follows"),
    ))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with the rule that splits them; what follows is the first line of the next paragraph."""
    p = soft_paragraphs(spark, sf_dir)
    following = F.lead(F.get("lines", F.lit(0))).over(W.partitionBy("doc_id").orderBy("para"))
    return p.withColumn("following", following).withColumn("rule", split_rule(F.col("lines"), is_date(F.col("following"))))


_COMPACT = "regexp_replace({}, '\\s', '', 'g')"


def _sql(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '{pattern}')"


_C = _COMPACT.format("text")
_FLAGS = f"""select *, {_sql(NUMBER)} as numbered, {_sql(DISPATCH, _C)} as dispatch, {_sql(HEAD_DATE, _C)} as head_date, {_sql(MEETING, _C)} as meeting, {_sql(P.sign_date_pattern())} as dated, {_sql(ATTACHMENT)} as attached, {_sql(KEY_VALUE, _C)} as key_value,
{_sql(ORG[0])} and {_sql(ORG[1])} and not {_sql(ORG[2])} as org, {_sql(K.ADDRESSING, _C)} as address, length({_C}) <= 60 and not {_sql('[。！？；;：:]', _C)} and not {_sql('^[一二三四五六七八九十]+、', _C)} and not {_sql(HEAD_DATE, _C)} as short,
row_number() over (partition by doc_id, para order by nth) as i, count(*) over (partition by doc_id, para) as n from {LINES_SQL}"""
_DECIDED = f"""f as ({_FLAGS}), h as (select *, max(case when head_date then i end) over (partition by doc_id, para) as spot from f),
g as (select doc_id, para, max(n) as n, count_if(head_date) = 1 and max(n) >= 3 and max(spot) > 1 and max(spot) < max(n) and bool_and(case when i < spot then short when i > spot then meeting else true end) as profile, bool_or(i > 1 and numbered) as inside, bool_or(i = 1 and numbered) as lead_number, bool_or(i = 1 and dispatch) as dispatch, count_if(key_value) >= 2 as kv,
  bool_or(i <= 2 and dated) and bool_or(i > 1 and attached) as da, max(n) = 2 and bool_or(i = 1 and org) and bool_or(i = 2 and dated) as sign, bool_or(i > 1 and address) as addr, bool_or(i = 1 and dated) as first_dated, bool_or(i = n and length(text) <= 30 and not {_sql('[。；;：:]')}) as open_end from h group by 1, 2),
r as (select doc_id, para, n, case when n < 2 then null when profile then 'front_profile' when inside then 'number_inside' when lead_number then 'number_first' when dispatch then 'dispatch' when kv then 'key_values' when da then 'date_attachment' when sign then 'signature' when addr then 'addressing'
  when open_end and lead(first_dated) over (partition by doc_id order by para) then 'date_follows' end as rule from g)"""


@query(f"with {_DECIDED} select doc_id, para, n::integer as lines, rule from r")
def soft_break_decisions(spark, sf_dir):
    """Which rule, the first that holds, makes segments of a paragraph's soft-broken lines."""
    return decided(spark, sf_dir).select("doc_id", "para", F.size("lines").alias("lines"), "rule")


@query(f"""with {_DECIDED}, s as (select f.*, r.rule, rule is not null and (not bool_or(i > 1 and address) over (partition by f.doc_id, f.para) or (i > 1 and address) or lag(i > 1 and address) over (partition by f.doc_id, f.para order by i)) as cut, sum(length(text) + 1) over (partition by f.doc_id, f.para order by i) - length(text) - 1 as spot from f join r using (doc_id, para)),
k as (select *, sum(case when cut and i > 1 then 1 else 0 end) over (partition by doc_id, para order by i) as segment from s)
select doc_id, para, segment::integer as segment, min(spot)::integer as start, max(spot + length(text))::integer as "end", string_agg(text, chr(10) order by i) as text from k group by 1, 2, 3""")
def logical_segments(spark, sf_dir):
    """Logical segments of soft-broken paragraphs with their offsets.

    A standalone addressing behind the first line stands alone and the lines between such are kept together;
    without one every line of a split paragraph is a segment. A paragraph that no rule splits is one segment.
    """
    alone = F.transform("lines", lambda x, i: (i > 0) & is_addressing(x))
    d = decided(spark, sf_dir).withColumn("alone", alone).withColumn("any", F.exists("alone", lambda x: x))
    place = F.transform("lines", lambda x, i: F.struct(x.alias("text"), F.get("alone", i).alias("alone"), ((i > 0) & F.coalesce(F.get("alone", i - 1), F.lit(False))).alias("behind")))
    rows = d.select("doc_id", "para", "rule", "any", F.posexplode(place).alias("i", "x")).select("doc_id", "para", "i", "x.text", (F.col("rule").isNotNull() & (F.col("i") > 0) & (~F.col("any") | F.col("x.alone") | F.col("x.behind"))).cast("int").alias("cut"))
    upto = W.partitionBy("doc_id", "para").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    at = F.sum(F.length("text") + 1).over(upto) - F.length("text") - 1
    k = rows.withColumn("segment", F.sum("cut").over(upto).cast("int")).withColumn("at", at.cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n")
    return k.groupBy("doc_id", "para", "segment").agg(F.min("at").alias("start"), F.max(F.col("at") + F.length("text")).alias("end"), joined.alias("text"))


@query(f"""with t as (select *, strpos(text, '。') as dot, regexp_extract(text, '^(各位[^：:]*[：:])', 1) as lead from {LINES_SQL}),
c as (select doc_id, nth, length(lead) as stop, 'addressing' as kind, 0.98::double as confidence from t where {_sql(K.ADDRESSING, 'lead')} and length(regexp_replace(substr(text, length(lead) + 1), '\\s', '', 'g')) >= 5
union all select doc_id, nth, dot, 'heading', case when {_sql(NUMBER)} then 0.99 else 0.84 end::double from t where dot > 0 and length(regexp_replace(substr(text, dot + 1), '\\s', '', 'g')) >= 5 and not {_sql('^[（(][一二三四五六七八九十百]+[）)]')} and (({_sql(NUMBER)} and not {_sql('[:：]', 'left(text, dot)')}) or left(text, dot - 1) in {ANNUAL}))
select doc_id, nth, (row_number() over (partition by doc_id, nth order by confidence desc, stop))::integer as place, stop::integer as stop, kind, confidence from c""")
def boundary_candidates(spark, sf_dir):
    """Where a line may be cut, best first: behind an inline addressing .98, a numbered heading .99, an annual lead .84.

    A level-2 heading with a body and a number whose colon explains give none. Every document counts as a report here.
    """
    t = F.col("text")
    dot = F.instr(t, "。")
    lead = F.regexp_extract(t, "^(各位[^：:]*[：:])", 1)
    seen = lambda x: F.length(P.compact(x))
    left = F.substr(t, F.lit(1), dot)
    numbered = t.rlike(NUMBER) & ~left.rlike("[:：]")
    annual = F.substr(t, F.lit(1), dot - 1).isin(*ANNUAL)
    heading = (dot > 0) & (seen(F.substr(t, dot + 1)) >= 5) & ~t.rlike("^[（(][一二三四五六七八九十百]+[）)]") & (numbered | annual)
    found = lambda when, stop, kind, sure: F.when(when, F.struct((-sure).alias("cost"), stop.alias("stop"), F.lit(kind).alias("kind")))
    both = F.array_sort(F.array_compact(F.array(
        found(lead.rlike(K.ADDRESSING) & (seen(F.substr(t, F.length(lead) + 1)) >= 5), F.length(lead), "addressing", F.lit(0.98)),
        found(heading, dot, "heading", F.when(t.rlike(NUMBER), 0.99).otherwise(0.84)),
    )))
    c = soft_lines(spark, sf_dir).select("doc_id", "nth", F.posexplode(both).alias("place", "c"))
    return c.select("doc_id", "nth", (F.col("place") + 1).alias("place"), "c.stop", "c.kind", (-F.col("c.cost")).alias("confidence"))


_SIGNED = "^(.*[^0-9])((?:19|20)[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日)$"


@query(f"select doc_id, nth, regexp_extract(text, '{_SIGNED}', 1) as organization, regexp_extract(text, '{_SIGNED}', 2) as date, length(regexp_extract(text, '{_SIGNED}', 1))::integer as cut from {LINES_SQL} where {_sql(_SIGNED)} and {' and '.join(('not ' if i == 2 else '') + _sql(p, f'''regexp_extract(text, '{_SIGNED}', 1)''') for i, p in enumerate(ORG))}")
def signature_lines_split(spark, sf_dir):
    """Organization and date on one line become two segments."""
    org, date = (F.regexp_extract("text", _SIGNED, i) for i in (1, 2))
    s = soft_lines(spark, sf_dir).select("doc_id", "nth", org.alias("organization"), date.alias("date"))
    return s.where(is_org(F.col("organization")) & (F.col("date") != "")).withColumn("cut", F.length("organization"))


@query(f"select doc_id, nth, {_sql(DISPATCH, _C)} as dispatch, {_sql(HEAD_DATE, _C)} as head_date, {_sql(MEETING, _C)} as meeting, {_sql(SPEECH)} as speech, regexp_extract(text, '{NUMBER}', 0) as prefix, case when strpos(text, '。') > 0 then length(trim(substr(text, strpos(text, '。') + 1))) >= 5 else false end as inline_body, {_C} in ('一年来。', '五年来。') as annual from {LINES_SQL}")
def line_shapes(spark, sf_dir):
    """Shapes of single lines: dispatch number, head date, meeting description, opening speech, physical number, inline body, annual lead."""
    t, c = F.col("text"), P.compact(F.col("text"))
    body = F.length(F.trim(F.substr(t, F.instr(t, "。") + 1)))
    return soft_lines(spark, sf_dir).select(
        "doc_id", "nth", c.rlike(DISPATCH).alias("dispatch"), c.rlike(HEAD_DATE).alias("head_date"), c.rlike(MEETING).alias("meeting"), t.rlike(SPEECH).alias("speech"),
        F.regexp_extract(t, NUMBER, 0).alias("prefix"), ((F.instr(t, "。") > 0) & (body >= 5)).alias("inline_body"), c.isin(*[x + "。" for x in ANNUAL]).alias("annual"),
    )


_STYLE = "case k % 8 when 0 then '  Heading ' || (k % 5) when 1 then '标题 ' || (k % 4 + 1) when 2 then 'TITLE' when 3 then '副标题' when 4 then 'Normal' when 5 then '正文' when 6 then 'List Paragraph' end"


@query(f"with p as (select o_orderkey as k, {_STYLE.replace('k %', 'o_orderkey %')} as style from orders), m(name, type, score) as (values {', '.join(str(x) for x in STYLES)}) select k as pos, style, type, score::double as score from p join m on replace(lower(trim(style)), ' ', '') = name")
def style_candidates(spark, sf_dir):
    """Weak proposals from the name of a paragraph's style; other styles propose nothing."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(_STYLE).alias("style"))
    name = F.replace(F.lower(F.trim("style")), F.lit(" "), F.lit(""))
    known = F.create_map(*[F.lit(x) for s, t, n in STYLES for x in (s, t)]), F.create_map(*[F.lit(x) for s, t, n in STYLES for x in (s, n)])
    return p.select(F.col("k").alias("pos"), "style", known[0][name].alias("type"), known[1][name].alias("score")).where("type is not null")


_TYPE = f"case when {_sql(DISPATCH, _C)} then 'dispatch_number' when {_sql(KEY_VALUE, _C)} then 'meeting_meta' when {_sql('报告$')} then 'title_continuation' else 'body' end"


@query(f"with t as (select doc_id, nth, {_TYPE} as type from {LINES_SQL}), l as (select *, lag(type) over (partition by doc_id order by nth) as before from t) select doc_id, nth, type, case when type = 'meeting_meta' then 'MEETING_META_AT_DOCUMENT_START' else 'HEAD_AFTER_BODY' end as code from l where (type in ('dispatch_number', 'title_continuation') and before = 'body') or (type = 'meeting_meta' and nth = 0)")
def sequence_issues(spark, sf_dir):
    """Types that cannot stand where they are: a head behind a body, meeting data at the start of a document."""
    c = P.compact(F.col("text"))
    kind = F.when(c.rlike(DISPATCH), "dispatch_number").when(c.rlike(KEY_VALUE), "meeting_meta").when(F.col("text").rlike("报告$"), "title_continuation").otherwise("body")
    l = soft_lines(spark, sf_dir).select("doc_id", "nth", kind.alias("type")).withColumn("before", F.lag("type").over(W.partitionBy("doc_id").orderBy("nth")))
    code = F.when((F.col("type") == "meeting_meta") & (F.col("nth") == 0), "MEETING_META_AT_DOCUMENT_START").when(F.col("type").isin("dispatch_number", "title_continuation") & (F.col("before") == "body"), "HEAD_AFTER_BODY")
    return l.select("doc_id", "nth", "type", code.alias("code")).where("code is not null")


_ALL_SQL = f"(select doc_id, nth as pos, text from {LINES_SQL} union all select doc_id, 100000 + pos, text from ({PHRASES_SQL}))"
_CELLS = "list_filter(list_transform(regexp_split_to_array(text, '\\t+| {2,}|　+'), lambda c: trim(c)), lambda c: c <> '')"


@query(f"""with a as (select *, regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g') as t, length(regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g')) as n, {_CELLS} as cells, regexp_matches(text, '[。！？；]') as sentence, length(regexp_extract(text, '^(.*?)[一二三四五六七八九十]+(?:是|要)', 1)) as lead,
  regexp_matches(text, '^[一二三四五六七八九十百]+[、.．]') or regexp_matches(text, '^[（(][一二三四五六七八九十百]+[）)]') or regexp_matches(text, '^[0-9]+[.．]') or (regexp_matches(text, '^[（(][0-9]+[）)]') and not regexp_matches(text, '[:：]')) as heading from {_ALL_SQL})
select doc_id, pos, n <= 30 and not regexp_matches(left(t, 10), '[。；：]') and (regexp_matches(t, '^[一二三四五六七八九十百]+[，,、\\s]') or regexp_matches(t, '^[）)][一二三四五六七八九十百]+') or (regexp_matches(t, '^[（(][一二三四五六七八九十百]+') and n <= 15)) as damaged,
  case when starts_with(text, '比如：') then 0 when regexp_matches(text, '[一二三四五六七八九十]+(?:是|要)') then lead else -1 end::integer as lead, case when heading then false else (sentence and n >= 12) or (n >= 34 and sentence) end as body_like, regexp_matches(text, '\\p{{P}}\\s*$') as punctuated,
  case when len(cells) >= 2 and len(list_filter(cells, lambda c: length(c) > 24)) = 0 and length(text) - length(regexp_replace(text, '[。；！？]', '', 'g')) <= 1 then len(cells) else 0 end::integer as columns from a""")
def line_predicates(spark, sf_dir):
    """Of every derived line: a heading whose number lost its mark, the place of a numbered lead, prose in context, a mark at the end, columns of a typed table."""
    t = F.col("text")
    lines = soft_lines(spark, sf_dir).select("doc_id", F.col("nth").alias("pos"), "text").unionByName(phrases(spark, sf_dir).select("doc_id", (F.col("pos") + 100_000).alias("pos"), "text"))
    return lines.select("doc_id", "pos", P.damaged_heading(t).alias("damaged"), P.numbered_lead(t).alias("lead"), P.body_like_context(t, F.lit(False)).alias("body_like"), P.ends_with_punctuation(t).alias("punctuated"), P.column_count(t).alias("columns"))


@query("select doc_id, regexp_replace(regexp_replace(lang || ':' || source || '/' || left(text, 40), '[\\\\/:*?\"<>|\\x00-\\x1f]', '_', 'g'), '^\\.+', '') as name, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[mail]', 'g'), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[host]', 'g')) as redacted_md5 from documents")
def safe_names_and_logs(spark, sf_dir):
    """A file name from the start of each document, and a digest of its text without addresses of mail and of hosts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.file_name(F.concat("lang", F.lit(":"), "source", F.lit("/"), F.substring("text", 1, 40))).alias("name"), F.md5(P.redacted(F.col("text"))).alias("redacted_md5"))
