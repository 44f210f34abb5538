"""Heading texts and typed paragraphs: number tokens, text rules, families, suggestions, chapters, front regions.

Everything is a column expression or a window over one document; no text is held by Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import numerals as N
from quire.functions import predicates as P
from quire.operators.outline import _LEVEL_SQL, counters, in_doc, in_order, upto
from quire.plans.registry import query
from quire.sources.phrases import PHRASES_SQL, phrases
from quire.sources.tables import OUTLINE_SQL, outline, table

T = f"with t as ({PHRASES_SQL})"
O = f"with t as ({OUTLINE_SQL})"  # noqa: E741

# Digits of numerals, circled numbers, the token of each style with its level, and what is no number.
DIGITS = "一二三四五六七八九十百千万零〇"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
STYLES = {
    "chinese_dun": (1, f"[{DIGITS}]{{1,6}}、"),
    "chinese_paren": (2, f"[（(][{DIGITS}]{{1,6}}[）)]"),
    "digit_dot": (3, "[0-9]{1,3}[.．]"),
    "digit_dun": (3, "[0-9]{1,3}、"),
    "digit_paren": (4, "[（(][0-9]{1,3}[）)]"),
    "circled": (4, f"[{CIRCLED}]"),
}
CANONICAL = {1: "chinese_dun", 2: "chinese_paren", 3: "digit_dot", 4: "digit_paren"}
LAW = "^\\s*第[一二三四五六七八九十百千万0-9]+条"
NO_NUMBER = ("^\\s*(19|20)[0-9]{2}[.．、年-]", LAW, "^\\s*附件\\s*([0-9一二三四五六七八九十]+|[:：])")
NO_BODY = (LAW, "^[0-9]{1,2}月[0-9]{1,2}日")
LEADING = "^\\s*([一二三四五六七八九十百千零〇]+[、.．]+|[（(][一二三四五六七八九十百千零〇0-9]+[）)]|[0-9]+[、.．]+)\\s*"
CHAPTER = "^[ \\t]*(第[一二三四五六七八九十百千万零〇两0-9]{1,12}[章节回][^\\r\\n]{0,100}|[cC][hH][aA][pP][tT][eE][rR][ \\t]+[0-9]+[^\\r\\n]{0,100})[ \\t]*$"
PERIOD_TAIL, BODY_LEAST, FRONT_CAP, FRONT_SOFT = 5, 5, 80, 12

_ANY = "|".join(p for _, p in STYLES.values())


def number_token(text: Column) -> Column:
    """struct(style, level, value, raw, body, confidence) of the number at the start of a text, else NULL."""
    raw, body = F.regexp_extract(text, f"^\\s*({_ANY})", 1), F.regexp_extract(text, f"^\\s*(?:{_ANY})\\s*(.*)$", 1)
    style = F.coalesce(*[F.when(raw.rlike(f"^(?:{p})$"), s) for s, (_, p) in STYLES.items()])
    level = F.coalesce(*[F.when(style == s, n) for s, (n, _) in STYLES.items()])
    digits = F.regexp_extract(raw, "[0-9]+", 0)
    value = F.when(style == "circled", F.instr(F.lit(CIRCLED), raw)).when(digits != "", digits.cast("int")).otherwise(N.token_number(F.regexp_extract(raw, f"[{DIGITS}]+", 0)).cast("int"))
    protected = F.lit(False)
    for p in NO_NUMBER:
        protected = protected | text.rlike(p)
    unsure = (body == "") | body.rlike("|".join(NO_BODY))
    token = F.struct(style.alias("style"), level.alias("level"), value.alias("value"), raw.alias("raw"), body.alias("body"), F.when(unsure, 0.62).otherwise(0.94).alias("confidence"))
    return F.when((raw != "") & ~protected & (value > 0), token)


def rendered(value: Column, style: Column) -> Column:
    """A number in a style; circled ones end at ten and are digits beyond."""
    n, cn = value.cast("string"), N.chinese_integer(value)
    return (
        F.when(style == "chinese_dun", F.concat(cn, F.lit("、"))).when(style == "chinese_paren", F.concat(F.lit("（"), cn, F.lit("）")))
        .when(style == "digit_dot", F.concat(n, F.lit("."))).when(style == "digit_dun", F.concat(n, F.lit("、")))
        .when(style == "digit_paren", F.concat(F.lit("（"), n, F.lit("）"))).when(value <= 10, F.substr(F.lit(CIRCLED), value, F.lit(1))).otherwise(n)
    )


_D = "['一','二','三','四','五','六','七','八','九']"
_NUMS = f"nums as (select range as n, case when range < 10 then {_D}[range] else case when range >= 20 then {_D}[range // 10] else '' end || '十' || case when range % 10 > 0 then {_D}[range % 10] else '' end end as cn from range(1, 100))"
_STYLE_SQL = "case " + " ".join(f"when regexp_full_match(raw, '{p}') then '{s}'" for s, (_, p) in STYLES.items()) + " end"
_LEVELS = "case style " + " ".join(f"when '{s}' then {n}" for s, (n, _) in STYLES.items()) + " end"
_PROTECTED = " or ".join(f"regexp_matches(text, '{p}')" for p in NO_NUMBER)
_UNSURE = " or ".join(f"regexp_matches(body, '{p}')" for p in NO_BODY)
_TOKENS = (
    f"{_NUMS}, a as (select *, regexp_extract(text, '^\\s*({_ANY})', 1) as raw, regexp_extract(text, '^\\s*(?:{_ANY})\\s*(.*)$', 1) as body from t), b as (select *, {_STYLE_SQL} as style from a where raw <> '' and not ({_PROTECTED})), "
    f"k as (select b.doc_id, b.pos, b.text, style, {_LEVELS} as level, coalesce(case when style = 'circled' then position(raw in '{CIRCLED}') end, try_cast(nullif(regexp_extract(raw, '[0-9]+'), '') as integer), nums.n)::integer as value, raw, body, case when body = '' or {_UNSURE} then 0.62 else 0.94 end::double as confidence from b left join nums on nums.cn = regexp_extract(raw, '[{DIGITS}]+'))"
)


def _render_sql(n: str, cn: str, style: str) -> str:
    return f"case {style} when 'chinese_dun' then {cn} || '、' when 'chinese_paren' then '（' || {cn} || '）' when 'digit_dot' then {n} || '.' when 'digit_dun' then {n} || '、' when 'digit_paren' then '（' || {n} || '）' else case when {n} <= 10 then substr('{CIRCLED}', {n}, 1) else cast({n} as varchar) end end"


@query(f"{T}, {_TOKENS} select doc_id, pos, style, level, value, raw, body, confidence from k where value > 0")
def numbering_tokens(spark, sf_dir):
    """The number that leads a paragraph: style, level, value and confidence; dates, laws and attachments have none."""
    return phrases(spark, sf_dir).select("doc_id", "pos", number_token(F.col("text")).alias("t")).where("t is not null").select("doc_id", "pos", "t.*")


_CANON = "case level " + " ".join(f"when {n} then '{s}'" for n, s in CANONICAL.items()) + " end"


@query(f"{T}, {_TOKENS}, r as (select k.*, {_render_sql('value::bigint', 'nums.cn', _CANON)} || ltrim(body) as made from k left join nums on nums.n = k.value where value > 0) select t.doc_id, t.pos, case when r.made is null or confidence < 0.9 then t.text else made end as text, coalesce(confidence >= 0.9 and made <> t.text, false) as changed, case when r.made is null then 'no_text_token' when confidence < 0.9 then 'low_confidence' when made = t.text then 'already_normalized' else style || '_to_' || {_CANON} end as reason from t left join r on t.doc_id = r.doc_id and t.pos = r.pos")
def numbering_normalized(spark, sf_dir):
    """Leading numbers in the one style of their level; unsure tokens stay as they are."""
    t = phrases(spark, sf_dir).withColumn("t", number_token(F.col("text")))
    canon = F.coalesce(*[F.when(F.col("t.level") == n, s) for n, s in CANONICAL.items()])
    made = F.concat(rendered(F.col("t.value"), canon), F.ltrim("t.body"))
    sure = F.col("t.confidence") >= 0.9
    reason = F.when(F.col("t").isNull(), "no_text_token").when(~sure, "low_confidence").when(made == F.col("text"), "already_normalized").otherwise(F.concat_ws("_to_", "t.style", canon))
    return t.select("doc_id", "pos", F.when(sure, made).otherwise(F.col("text")).alias("text"), F.coalesce(sure & (made != F.col("text")), F.lit(False)).alias("changed"), reason.alias("reason"))


@query(f"with {_NUMS}, s as (select unnest([{', '.join(repr(s) for s in STYLES)}]) as style) select o_orderkey as doc_id, n::integer as value, style, {_render_sql('n', 'cn', 'style')} as text from orders join nums on n = 1 + o_orderkey % 99, s")
def numbering_rendered(spark, sf_dir):
    """Each order's number, from 1 to 99, in every style."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_orderkey") % 99).cast("int").alias("value"), F.explode(F.array(*[F.lit(s) for s in STYLES])).alias("style"))
    return n.select("doc_id", "value", "style", rendered(F.col("value"), F.col("style")).alias("text"))


_QUOTED = "^\\s*[“”\"''‘’「『]\\s*(.*?)\\s*[”\"''’」』]?\\s*$"
_LABEL = "\\s*责\\s*任\\s*单\\s*位\\s*[:：]\\s*"
_MARK = "^\\s*附件\\s*([0-9一二三四五六七八九十百千]*)\\s*$"


@query(f"""{T}, {_NUMS}, u as (select *, regexp_replace(regexp_replace(text, '{_QUOTED}', '\\1'), '{_LABEL}', '责任单位：', 'g') as r,
  case when text like '@lvl\\_%' escape '\\' and position(':' in text) > 1 then substr(text, position(':' in text) + 1) else regexp_replace(regexp_replace(text, '^([一二三四五六七八九十百]+[、.．]+|[（(][一二三四五六七八九十百]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)])', ''), '^[.．、，,]\\s*', '') end as bare from t)
select doc_id, pos, trim(bare) as stripped, case when type = 'responsibility_line' then substr(r, 1, 1) || regexp_replace(substr(r, 2), '责任单位：', chr(10) || '责任单位：', 'g') else text end as responsibility,
  trim(regexp_replace(text, '^\\s*[一二三四五六七八九十百]+、\\s*', '')) as organization,
  case when regexp_matches(text, '{_MARK}') then '附件' || coalesce(' ' || coalesce(try_cast(regexp_extract(text, '{_MARK}', 1) as integer), nums.n), '') else text end as mark,
  case when position('。' in text) > 0 and length(trim(substr(text, position('。' in text) + 1))) < {PERIOD_TAIL} then substr(text, 1, position('。' in text) - 1) || substr(text, position('。' in text) + 1) else text end as period,
  ltrim(regexp_replace(text, '{LEADING}', '')) as unnumbered,
  coalesce(7 + nullif(length(regexp_extract(text, '^\\s*附件\\s*[:：]\\s*([0-9]+)[.．、]\\s*', 1)), 0), 5)::integer as note_wrap,
  coalesce(7 + nullif(length(regexp_extract(text, '^\\s*([0-9]+)[.．、]\\s*', 1)), 0), 8)::integer as item_wrap
from u left join nums on nums.cn = regexp_extract(text, '{_MARK}', 1)""")
def heading_text_rules(spark, sf_dir):
    """What each text rule makes of a paragraph: number and list mark stripped, labels unified, marks and periods set right, wrap columns."""
    text = F.col("text")
    colon = F.instr(text, ":")
    bare = F.when(text.startswith("@lvl_") & (colon > 1), F.substr(text, colon + 1)).otherwise(F.regexp_replace(F.regexp_replace(text, "^([一二三四五六七八九十百]+[、.．]+|[（(][一二三四五六七八九十百]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)])", ""), "^[.．、，,]\\s*", ""))
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _QUOTED, "$1"), _LABEL, "责任单位："), "(?<!^)责任单位：", "\n责任单位：")
    dot = F.instr(text, "。")
    after = F.substr(text, dot + 1)
    wrap = lambda p, none: F.coalesce(7 + F.nullif(F.length(F.regexp_extract(text, p, 1)), F.lit(0)), F.lit(none))
    return phrases(spark, sf_dir).select(
        "doc_id", "pos", F.trim(bare).alias("stripped"), F.when(F.col("type") == "responsibility_line", label).otherwise(text).alias("responsibility"),
        F.trim(F.regexp_replace(text, "^\\s*[一二三四五六七八九十百]+、\\s*", "")).alias("organization"), P.attachment_mark(text).alias("mark"),
        F.when((dot > 0) & (F.length(F.trim(after)) < PERIOD_TAIL), F.concat(F.substr(text, F.lit(1), dot - 1), after)).otherwise(text).alias("period"),
        F.ltrim(F.regexp_replace(text, LEADING, "")).alias("unnumbered"),
        wrap("^\\s*附件\\s*[:：]\\s*([0-9]+)[.．、]\\s*", 5).alias("note_wrap"), wrap("^\\s*([0-9]+)[.．、]\\s*", 8).alias("item_wrap"),
    )


@query(f"""{O}, h as (select *, lead(level) over (partition by doc_id order by pos) as next_level from t), g as (select h.*, (select max(p.pos) from h p where p.doc_id = h.doc_id and p.pos < h.pos and p.level > 0 and p.level < h.level) as parent from h where level > 0),
f as (select g.*, p.level as parent_level, lag(g.number) over w as before, count(*) over (partition by g.doc_id, g.level, parent) as members, row_number() over (partition by g.doc_id, g.level, parent, g.number order by g.pos) as nth from g left join t p on p.doc_id = g.doc_id and p.pos = g.parent window w as (partition by g.doc_id, g.level, parent order by g.pos))
select doc_id, pos, level, case when nth > 1 then 'duplicate' when before is null and number <> 1 then 'starts_after_one' when number < before then 'reverse' when number > before + 1 then 'gap' else 'none' end as sequence,
  (level > 1 and coalesce(parent_level, 0) <> level - 1) as missing_parent, members > 1 as parallel, coalesce(next_level > level, false) as nested from f""")
def family_evidence(spark, sf_dir):
    """Evidence on every numbered heading: its sequence in the family, a missing parent, siblings, deeper headings below it."""
    level, number, before = F.col("level"), F.col("number"), F.col("before")
    t = counters(outline(spark, sf_dir).withColumn("next_level", F.lead("level").over(in_order())).where("level > 0"))
    scope = F.coalesce(*[F.when(level == k, F.col(f"island{k}")) for k in range(1, 5)])
    above = [F.last(F.when(level < k, level), True).over(upto()) for k in range(2, 5)]
    t = t.withColumn("scope", scope).withColumn("above", F.coalesce(*[F.when(level == k, a) for k, a in zip(range(2, 5), above)]))
    family = W.partitionBy("doc_id", "level", "scope")
    f = t.withColumn("before", F.lag("number").over(family.orderBy("pos"))).withColumn("members", F.count("*").over(family)).withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "level", "scope", "number").orderBy("pos")))
    sequence = F.when(F.col("nth") > 1, "duplicate").when(before.isNull() & (number != 1), "starts_after_one").when(number < before, "reverse").when(number > before + 1, "gap").otherwise("none")
    return f.select("doc_id", "pos", "level", sequence.alias("sequence"), ((level > 1) & (F.coalesce("above", F.lit(0)) != level - 1)).alias("missing_parent"), (F.col("members") > 1).alias("parallel"), F.coalesce(F.col("next_level") > level, F.lit(False)).alias("nested"))


@query(f"""{O.replace('with t', 'with recursive t')}, h as (select doc_id, pos, level, row_number() over (partition by doc_id order by pos) as k from t where level > 0),
r(doc_id, pos, k, level, capped) as (select doc_id, pos, k, level, least(level, 1) from h where k = 1 union all select h.doc_id, h.pos, h.k, h.level, case when h.level = r.level then r.capped else least(h.level, r.capped + 1) end from r join h on h.doc_id = r.doc_id and h.k = r.k + 1)
select doc_id, pos, level, capped::integer as capped from r""")
def heading_level_cap(spark, sf_dir):
    """No heading goes more than one level below the one before; a repeated level keeps the level it was given.

    Over the changes of level, counted by n, the recursion c = min(level, c + 1) is the running minimum of level - n, plus n.
    """
    h = outline(spark, sf_dir).where("level > 0").select("doc_id", "pos", "level")
    h = h.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(in_order()), F.lit(0))).cast("int")).withColumn("n", F.sum("new").over(upto()))
    least = F.min(F.when(F.col("new") == 1, F.col("level") - F.col("n"))).over(upto())
    return h.select("doc_id", "pos", "level", (F.least(F.lit(0), least) + F.col("n")).cast("int").alias("capped"))


_NEXT = "lead(type) over w as t1, lead(type, 2) over w as t2, lead(text) over w as x1"
_PUNCT = "regexp_replace(regexp_replace(text, '([一-鿿]):', '\\1：', 'g'), '([一-鿿]),', '\\1，', 'g')"


@query(f"""{T}, n as (select *, {_NEXT} from t window w as (partition by doc_id order by pos))
select doc_id, pos, 'normalize_punctuation' as action, sha256(text) as before, sha256({_PUNCT}) as after, 0.9::double as confidence from n where text <> {_PUNCT}
union all select doc_id, pos, 'reorder_tail_structure', sha256('sign_org,sign_date,attachment_note'), sha256('attachment_note,sign_org,sign_date'), 0.85::double from n where type = 'sign_org' and t1 = 'sign_date' and t2 = 'attachment_note'
union all select doc_id, pos, 'merge_sibling_heading', sha256(text), sha256(text || x1), 0.7::double from n where type like 'heading%' and type = t1""")
def strict_suggestions(spark, sf_dir):
    """The strict mode changes nothing: it lists punctuation, tail orders and sibling headings that the others would set right."""
    text, kind = F.col("text"), F.col("type")
    n = phrases(spark, sf_dir).withColumns({"t1": F.lead("type").over(in_order()), "t2": F.lead("type", 2).over(in_order()), "x1": F.lead("text").over(in_order())})
    made = P.chinese_punctuation(text)
    entry = lambda when, action, old, new, sure: F.when(when, F.struct(F.lit(action).alias("action"), F.sha2(old, 256).alias("before"), F.sha2(new, 256).alias("after"), F.lit(sure).alias("confidence")))
    entries = F.array_compact(
        F.array(
            entry(made != text, "normalize_punctuation", text, made, 0.9),
            entry((kind == "sign_org") & (F.col("t1") == "sign_date") & (F.col("t2") == "attachment_note"), "reorder_tail_structure", F.lit("sign_org,sign_date,attachment_note"), F.lit("attachment_note,sign_org,sign_date"), 0.85),
            entry(kind.startswith("heading") & (kind == F.col("t1")), "merge_sibling_heading", text, F.concat(text, "x1"), 0.7),
        )
    )
    return n.select("doc_id", "pos", F.inline(entries))


@query(f"{T} select doc_id, pos, type in ('attachment_page_mark', 'attachment_title') as keep_with_next, (type = 'object_caption' and coalesce(lag(type) over (partition by doc_id order by pos), '') in ('table', 'image')) as caption_protected from t")
def kept_with_neighbours(spark, sf_dir):
    """Attachment marks and titles stay with what follows; a caption right behind a table or an image is protected, one behind a caption is not."""
    before = F.coalesce(F.lag("type").over(in_order()), F.lit(""))
    return phrases(spark, sf_dir).select("doc_id", "pos", F.col("type").isin("attachment_page_mark", "attachment_title").alias("keep_with_next"), ((F.col("type") == "object_caption") & before.isin("table", "image")).alias("caption_protected"))


_BODY = f"(type not in ('dispatch', 'date_line', 'addressing') and (type in ('key_value', 'responsibility_line') or ({_LEVEL_SQL}) is null and regexp_matches(text, '[。！？；]$') and length(text) >= 12))"
_SEMANTIC = "(text <> '' and type <> 'object_caption')"


@query(f"""{T}, p as (select *, row_number() over (partition by doc_id order by pos) - 1 as i, {_SEMANTIC} as item, ({_BODY} or type in ('attachment_note', 'key_value', 'responsibility_line') or ({_LEVEL_SQL}) is not null) as stops from t),
s as (select *, sum(item::integer) over (partition by doc_id order by pos) as nth from p), z as (select doc_id, count(*) as n, min(case when i < {FRONT_CAP} and item and nth > 1 and stops then i end) as stop from s group by 1),
c as (select z.doc_id, z.n, z.stop, count(*) filter (where s.item and s.i < least({FRONT_CAP}, coalesce(z.stop, {FRONT_CAP}))) as found from z join s on z.doc_id = s.doc_id group by 1, 2, 3)
select doc_id, found as positions, case when stop is not null then 'body-boundary' when n > {FRONT_CAP} then 'physical-safety-cap' else 'document-end' end as reason, found + (stop is not null)::integer > {FRONT_SOFT} as beyond_soft from c""")
def front_scan(spark, sf_dir):
    """The front region of each document: how many items stand before the first that starts the body, why it ends, and whether it passes twelve items.

    Captions and lines without text are no items; at most 80 lines are looked at, as the rule has it.
    """
    text, kind = F.col("text"), F.col("type")
    level = P.heading_level(text)
    labelled = kind.isin("key_value", "responsibility_line")
    body = ~kind.isin("dispatch", "date_line", "addressing") & (labelled | (level.isNull() & text.rlike("[。！？；]$") & (F.length(text) >= 12)))
    p = phrases(spark, sf_dir).withColumn("i", F.row_number().over(in_order()) - 1).withColumn("item", (text != "") & (kind != "object_caption"))
    p = p.withColumn("stops", F.col("item") & (F.sum(F.col("item").cast("int")).over(upto()) > 1) & (body | labelled | (kind == "attachment_note") | level.isNotNull()) & (F.col("i") < FRONT_CAP))
    p = p.withColumn("stop", F.min(F.when(F.col("stops"), F.col("i"))).over(in_doc()))
    c = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("stop").alias("stop"), F.count_if(F.col("item") & (F.col("i") < F.least(F.lit(FRONT_CAP), F.coalesce("stop", F.lit(FRONT_CAP))))).alias("positions"))
    ended = F.col("stop").isNotNull()
    reason = F.when(ended, "body-boundary").when(F.col("n") > FRONT_CAP, "physical-safety-cap").otherwise("document-end")
    return c.select("doc_id", "positions", reason.alias("reason"), (F.col("positions") + ended.cast("int") > FRONT_SOFT).alias("beyond_soft"))


_START = "coalesce(sum(length(text) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint"


@query(f"""{T}, o as (select *, {_START} as start from t), h as (select doc_id, start, trim(text) as title from o where regexp_matches(text, '{CHAPTER}')), z as (select o.doc_id, max(o.start + length(o.text))::bigint as size, (select min(h.start) from h where h.doc_id = o.doc_id) as first from o group by o.doc_id),
c as (select * from h union all select z.doc_id, 0, case when first is null then '全文' else '前置内容' end from z where first is null or exists (select 1 from o where o.doc_id = z.doc_id and o.start < z.first and trim(o.text) <> ''))
select c.doc_id, (row_number() over (partition by c.doc_id order by c.start) - 1)::integer as chapter, c.title, c.start::bigint as start, coalesce(lead(c.start) over (partition by c.doc_id order by c.start), z.size)::bigint as stop from c join z on c.doc_id = z.doc_id""")
def chapter_split(spark, sf_dir):
    """Chapters between heading lines; visible text before the first is a chapter of its own, no heading gives one whole."""
    o = phrases(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    o = o.withColumn("head", F.col("text").rlike(CHAPTER)).withColumn("stop", F.max(F.col("start") + F.length("text")).over(in_doc()))
    o = o.withColumn("any", F.max("head").over(in_doc())).withColumn("first", F.row_number().over(in_order()) == 1)
    # The first line also carries the text before the first heading: what is visible before any heading of its document.
    o = o.withColumn("seen", F.min(F.when(F.trim("text") != "", F.col("start"))).over(in_doc())).withColumn("at", F.min(F.when(F.col("head"), F.col("start"))).over(in_doc()))
    extra = F.when(F.col("first") & ~F.col("any"), "全文").when(F.col("first") & (F.col("seen") < F.col("at")), "前置内容")
    rows = F.array_compact(F.array(F.when(extra.isNotNull(), F.struct(F.lit(0).cast("bigint").alias("start"), extra.alias("title"))), F.when(F.col("head"), F.struct(F.col("start"), F.trim("text").alias("title")))))
    c = o.select("doc_id", "stop", F.inline(rows))
    by = in_doc().orderBy("start")
    return c.select("doc_id", (F.row_number().over(by) - 1).alias("chapter"), "title", "start", F.coalesce(F.lead("start").over(by), F.col("stop")).alias("stop"))


_HEAD = "regexp_matches(left_part, '^([一二三四五六七八九十百]+[、.．]|[（(][一二三四五六七八九十百]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)])')"
_PAREN = "regexp_matches(text, '^[（(][一二三四五六七八九十百]+[）)]')"


@query(f"""{T}, d as (select *, substr(text, 1, position('。' in text)) as left_part, trim(substr(text, position('。' in text) + 1)) as right_part from t where text <> ''),
k as (select *, position('。' in text) > 0 and {_HEAD} and not {_PAREN} and length(right_part) >= {BODY_LEAST} and not regexp_matches(left_part, '[:：]') as two from d)
select doc_id, pos, 0 as segment, case when two then 'heading' else 'whole' end as kind, 0 as start, case when two then length(left_part) else length(text) end::integer as stop, case when two then 0.99::double end as confidence from k
union all select doc_id, pos, 1, 'body', (length(text) - length(right_part))::integer, length(text)::integer, 0.99::double from k where two""")
def heading_body_split(spark, sf_dir):
    """A numbered heading with its body on one line becomes exactly two segments; level-2 headings and explanations behind a colon stay whole."""
    text = F.col("text")
    dot = F.instr(text, "。")
    left, right = F.substr(text, F.lit(1), dot), F.trim(F.substr(text, dot + 1))
    two = (dot > 0) & (P.heading_prefix(left) != "") & ~text.rlike("^[（(][一二三四五六七八九十百]+[）)]") & (F.length(right) >= BODY_LEAST) & ~left.rlike("[:：]")
    part = lambda n, kind, a, b, sure: F.struct(F.lit(n).alias("segment"), F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"), F.lit(sure).cast("double").alias("confidence"))
    n = F.length(text)
    parts = F.when(two, F.array(part(0, "heading", F.lit(0), dot, 0.99), part(1, "body", n - F.length(right), n, 0.99))).otherwise(F.array(part(0, "whole", F.lit(0), n, None)))
    return phrases(spark, sf_dir).where(text != "").select("doc_id", "pos", F.inline(parts))


@query("select stage, count(*) as n, min(v)::double as least, median(v)::double as middle, avg(v)::double as mean, list_sort(list(v))[cast(floor((count(*) - 1) * 0.9 + 0.5) as integer) + 1]::double as p90, round(stddev_pop(v), 4)::double as deviation from (select event_type as stage, cast(round(value * 100) as bigint) as v from events where value is not null) group by 1")
def duration_statistics(spark, sf_dir):
    """Least, median, mean, 90th percentile by rank, and deviation of durations of each stage.

    The rank is a window over the distinct durations and their counts, so that no list of a stage's rows is made.
    """
    v = table(spark, sf_dir, "events").where("value is not null").groupBy(F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("bigint").alias("v")).agg(F.count("*").alias("c"))
    own = W.partitionBy("stage")
    r = v.withColumn("upto", F.sum("c").over(own.orderBy("v"))).withColumn("n", F.sum("c").over(own)).withColumn("mean", F.sum(F.col("c") * F.col("v")).over(own) / F.col("n"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    deviation = F.round(F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2)) / F.first("n")), 4)
    return r.groupBy("stage").agg(F.first("n").alias("n"), F.min("v").cast("double").alias("least"), middle.alias("middle"), F.first("mean").alias("mean"), at(F.floor((n - 1) * 0.9 + 0.5)).cast("double").alias("p90"), deviation.alias("deviation"))
