"""The core classifier: fifteen kinds of paragraphs with the evidence behind them, in windows over a document.

Most kinds follow from the paragraph and its neighbours. Only titles depend on what was decided before, and that
reduces to places: the main title is the first open title-like line if no body stands before it, its continuations
are the unbroken run of such lines behind it, and all other open lines are body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.segments import LINES_SQL, soft_lines
from quire.plans.registry import query

# Shapes of the kinds, the evidence of each, thresholds.
N = "一二三四五六七八九十百千万零〇"
DISPATCH = r"^[一-龥A-Za-z0-9]{0,12}[〔\[]\s*[0-9]{4}\s*[〕\]]\s*[0-9]+\s*号$"
SIGN_DATE = f"^(?:(?:19|20)[0-9]{{2}}|[零〇一二三四五六七八九]{{4}})年(?:[0-9]{{1,2}}|[{N}]{{1,3}})月(?:[0-9]{{1,2}}|[{N}]{{1,3}})日$"
LEVELS = ((1, f"^[{N}]{{1,5}}、\\S+"), (2, f"^[（(][{N}]{{1,5}}[）)]\\S+"), (3, r"^[0-9]{1,2}[.．、]\S+"), (4, r"^(?:[（(][0-9]{1,2}[）)]|[①②③④⑤⑥⑦⑧⑨⑩])\S+"))
CLOSING = "^(?:特此(?:报告|通知|函达|批复|公告)|妥否，请批示|请予审示|以上报告)"
RECIPIENT, KEY_VALUE = r"^[一-龥A-Za-z0-9、，,（）()\s]{2,40}[:：]$", "^(?:联系人|责任单位|联系电话|地址|邮编)"
CC, NOTE, MARK = r"^抄送[:：]\S+", r"^附件[:：]\s*\S+", r"^附件\s*(?:[0-9一二三四五六七八九十]+)?$"
NO_HEADING = "^第[一二三四五六七八九十百千万0-9]+条|(?:19|20)[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日"
NO_ORG, SENTENCE = "[。；;：:]|^(?:联系人|以上|请|附件|抄送)", "[。！？；;]"
AUTO, AGGRESSIVE, HEAD, TAIL, INLINE = 0.78, 0.88, 4, 8, 5
BODY = ("body", "heading_level_1", "heading_level_2", "heading_level_3", "heading_level_4", "closing")


def classified(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, i, kind, confidence, auto_format) of (doc_id, i, text, centred, bold): i counts from 0 and text is stripped; a NULL text is empty."""
    t, doc = F.col("text"), W.partitionBy("doc_id")
    order = doc.orderBy("i")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    size = F.length(t)
    heading = F.when(~t.rlike(NO_HEADING), F.coalesce(*[F.when(t.rlike(p), k) for k, p in LEVELS]))
    facts = paragraphs.withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", "i", size.alias("n"), t.rlike(SIGN_DATE).alias("date"), ((size > 0) & (size <= 32) & ~t.rlike(NO_ORG)).alias("org"), t.rlike(DISPATCH).alias("dispatch"),
        (t.rlike(RECIPIENT) & ~t.rlike(KEY_VALUE)).alias("recipient"), t.rlike(CC).alias("cc"), t.rlike(NOTE).alias("note"), t.rlike(MARK).alias("mark"), heading.alias("level"), t.rlike(CLOSING).alias("closing"),
        t.rlike(SENTENCE).alias("sentence"), ((F.instr(t, "。") > 0) & (F.length(F.trim(F.substr(t, F.instr(t, "。") + 1))) >= INLINE)).alias("inline"),
        (size.between(4, 36) & ~t.rlike(SENTENCE) & ~t.rlike("[:：]$") & (F.col("centred") | F.col("bold"))).alias("title"), F.col("centred"),
    )
    c = F.col
    next_date, next_title = (F.coalesce(F.lead(x).over(order), F.lit(False)) for x in ("date", "title"))
    f = facts.withColumns({"next_title": next_title, "signs": c("org") & next_date & (c("i") >= F.count("*").over(doc) - TAIL)})
    f = f.withColumn("signature", c("signs") & (c("i") == F.min(F.when(c("signs"), c("i"))).over(doc)))
    known = (
        F.when(c("n") == 0, "body").when(c("cc"), "cc_recipient").when(c("date"), "signature_date").when(c("signature"), "signature_org").when(c("dispatch"), "dispatch_number").when(c("recipient"), "recipient")
        .when(c("note"), "attachment_note").when(c("mark"), "attachment_title").when(c("level").isNotNull(), F.concat(F.lit("heading_level_"), c("level").cast("string"))).when(c("closing"), "closing")
    )
    f = f.withColumn("known", known).withColumn("open", c("known").isNull() & c("title"))
    f = f.withColumns({
        "first": F.min(F.when(c("open"), c("i"))).over(doc),
        "body_at": F.min(F.when(c("known").isin(*BODY) | (c("known").isNull() & ~c("title")), c("i"))).over(doc),
        "opens": F.count(F.when(c("open"), 1)).over(upto),
    })
    titled = c("open") & (c("first") <= HEAD) & (c("body_at").isNull() | (c("first") < c("body_at"))) & (c("i") - c("first") == c("opens") - 1)
    f = f.withColumn("kind", F.coalesce("known", F.when(titled & (c("i") == c("first")), "main_title").when(titled, "title_continuation").otherwise("body")))
    f = f.withColumns({"last": F.lag("kind").over(order), "seen": F.coalesce(F.max(c("kind").isin(*BODY)).over(before), F.lit(False))})

    def evidence(*parts: tuple[float, Column | bool], most: float) -> Column:
        total = F.lit(0.0)
        for weight, when in parts:
            total = total + (F.lit(weight) if when is True else F.when(when, weight).otherwise(0.0))
        return F.least(total, F.lit(most))

    kind = c("kind")
    sure = (
        F.when(c("n") == 0, 0.4).when(kind == "cc_recipient", 0.95).when(kind == "signature_date", evidence((0.95, True), (0.04, c("last").eqNullSafe("signature_org")), most=0.99))
        .when(kind == "signature_org", evidence((0.7, True), (0.18, ~c("sentence")), most=0.95)).when(kind == "dispatch_number", evidence((0.9, True), (0.05, c("i") <= HEAD), most=0.97))
        .when(kind == "recipient", evidence((0.78, True), (0.1, ~c("seen")), most=0.95)).when(kind == "attachment_note", 0.92).when(kind == "attachment_title", F.when(c("next_title"), 0.88).otherwise(0.72))
        .when(kind.startswith("heading"), evidence((0.72, True), (0.06, c("seen") | (c("i") > HEAD)), (0.04, c("inline")), most=0.94)).when(kind == "closing", 0.86)
        .when(kind == "main_title", evidence((0.34, True), (0.3, True), (0.25, True), most=0.94)).when(kind == "title_continuation", evidence((0.5, True), (0.24, True), (0.16, True), most=0.9))
        .otherwise(evidence((0.62, True), (0.16, c("sentence") | (c("n") >= 18)), (0.08, (c("n") <= 8) & ~c("title")), most=0.86))
    )
    least = F.when(kind.startswith("heading") | kind.isin("main_title", "title_continuation"), AGGRESSIVE).otherwise(AUTO)
    return f.withColumn("sure", sure).select("doc_id", "i", "kind", F.round("sure", 3).alias("confidence"), (c("sure") >= least).alias("auto_format"))


def _m(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '{pattern}')"


_LEVEL = f"case when not {_m(NO_HEADING)} then case " + " ".join(f"when {_m(p)} then {k}" for k, p in LEVELS) + " end end"


# The SQL walks each document line by line with the state that the rules name.
@query(f"""with recursive l as (select doc_id, nth as i, text, nth < 3 and doc_id % 5 <> 0 as centred, nth % 4 = 0 as bold from {LINES_SQL}),
f as (select doc_id, i, length(text) as n, {_m(SIGN_DATE)} as date, length(text) between 1 and 32 and not {_m(NO_ORG)} as org, {_m(DISPATCH)} as dispatch, {_m(RECIPIENT)} and not {_m(KEY_VALUE)} as recipient, {_m(CC)} as cc, {_m(NOTE)} as note, {_m(MARK)} as mark, {_LEVEL} as level, {_m(CLOSING)} as closing, {_m(SENTENCE)} as sentence,
  strpos(text, '。') > 0 and length(trim(substr(text, strpos(text, '。') + 1))) >= {INLINE} as inline, length(text) between 4 and 36 and not {_m(SENTENCE)} and not {_m('[:：]$')} and (centred or bold) as title from l),
w as (select *, coalesce(lead(title) over (partition by doc_id order by i), false) as next_title, org and coalesce(lead(date) over (partition by doc_id order by i), false) and i >= count(*) over (partition by doc_id) - {TAIL} as signs from f),
s as (select *, signs and i = min(case when signs then i end) over (partition by doc_id) as signature from w),
r as (select doc_id, -1::bigint as i, '' as kind, false as seen, false as titled, 0::double as sure from s group by 1
union all select s.doc_id, s.i, k.kind, r.seen or k.kind in {BODY}, r.titled or k.kind = 'main_title',
  case when k.kind = 'cc_recipient' then 0.95 when k.kind = 'signature_date' then 0.95 + case when r.kind = 'signature_org' then 0.04 else 0 end when k.kind = 'signature_org' then 0.7 + case when sentence then 0 else 0.18 end when k.kind = 'dispatch_number' then 0.9 + case when s.i <= {HEAD} then 0.05 else 0 end
  when k.kind = 'recipient' then 0.78 + case when r.seen then 0 else 0.1 end when k.kind = 'attachment_note' then 0.92 when k.kind = 'attachment_title' then case when next_title then 0.88 else 0.72 end when k.kind like 'heading%' then 0.72 + case when r.seen or s.i > {HEAD} then 0.06 else 0 end + case when inline then 0.04 else 0 end
  when k.kind = 'closing' then 0.86 when k.kind = 'main_title' then 0.89 when k.kind = 'title_continuation' then 0.9 else least(0.86, 0.62 + case when sentence or n >= 18 then 0.16 else 0 end + case when n <= 8 and not title then 0.08 else 0 end) end::double
  from r join s on s.doc_id = r.doc_id and s.i = r.i + 1, lateral (select case when cc then 'cc_recipient' when date then 'signature_date' when signature then 'signature_org' when dispatch then 'dispatch_number' when recipient then 'recipient' when note then 'attachment_note' when mark then 'attachment_title' when level is not null then 'heading_level_' || level when closing then 'closing'
    when title and not r.titled and not r.seen and s.i <= {HEAD} then 'main_title' when title and not r.seen and r.kind in ('main_title', 'title_continuation') then 'title_continuation' else 'body' end as kind) k)
select doc_id, i, kind, round(sure, 3) as confidence, sure + 1e-9 >= case when kind like 'heading%' or kind in ('main_title', 'title_continuation') then {AGGRESSIVE} else {AUTO} end as auto_format from r where i >= 0""")
def core_classification(spark, sf_dir):
    """Kind, confidence and automatic formatting of every line; the derived lines have no style names, font sizes or native numbers."""
    at = F.col("nth")
    l = soft_lines(spark, sf_dir).select("doc_id", at.alias("i"), "text", ((at < 3) & (F.col("doc_id") % 5 != 0)).alias("centred"), (at % 4 == 0).alias("bold"))
    return classified(l)
