"""Rules of their own on paragraphs and neighbours: native numbering levels, emphasis, citations, breaks, columns, attachment notes, signature order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.plans.registry import query
from quire.sources.tables import table

# Words that open an emphasised part, marks.
LEADS, FIXED = ("是", "要"), "比如："
LEAD = f"[一二三四五六七八九十]+(?:{'|'.join(LEADS)})"
OPENERS = f"(?:{LEAD}|{FIXED})"
CITATION = r"\[[0-9]{1,2}\]|〔[0-9]{1,2}〕"
PAGE_MARK = r"^附件\s*[0-9一二三四五六七八九十百千]*$"
SPAN = "array<struct<start:int,end:int,bold:boolean>>"

_LINE = "select l_orderkey as doc_id, l_linenumber as pos, cast(min(l_quantity) as int) as q, cast(min(l_suppkey) as int) as s, cast(min(l_partkey) % 12 as int) as k from lineitem group by l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


# Emphasis and citations.
_TEXTS = (
    "'经研究[' || (q % 120) || ']表明，一是认识不足' || q || '处。二是措施不力，三要加强〔' || (s % 30) || '〕领导'", "'比如：抓好A' || q || 'bc项。一是提速。二要增效'", "'各部门要落实' || q || '项X工作'", "'一要抓落实。比如：建立制度，十二是总结。'",
    "'[1]〔22〕见附件'", "'没有标记'", "'比如：'", "'二是'", "'说明[123]一是甲〔7〕。乙'", "''", "'三要求稳，四是求进。'", "'引文〔' || (q % 10) || '〕'",
)
_MARKED = "select doc_id, pos, case k " + " ".join(f"when {i} then {x}" for i, x in enumerate(_TEXTS)) + f" end as text from ({_LINE}) f"


def emphasis(text: Column) -> Column:
    """array of struct(start, end, bold): a text cut before every numbered lead and fixed word; a lead is bold up to its full stop, a fixed word up to its colon, all of it where there is none."""
    parts = F.filter(F.split(text, f"(?={OPENERS})", -1), lambda p: p != "")
    # A split before an opener inside a longer number would cut it; the longest number is one opener.
    joined = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((F.size(acc) > 0) & F.element_at(F.concat(acc, F.array(F.lit(""))), -2).rlike("^[一二三四五六七八九十]+$") & p.rlike(f"^{LEAD}"), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))))

    def bold_length(p: Column) -> Column:
        stop = F.when(p.startswith(FIXED), F.regexp_instr(p, F.lit("[:：]"))).when(p.rlike(f"^{LEAD}"), F.instr(p, "。"))
        return F.when(stop.isNull(), 0).when(stop > 0, stop).otherwise(F.length(p))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a, n = acc["at"], F.length(p)
        b = bold_length(p)
        span = lambda x, y, bold: F.when(y > x, F.array(F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"), F.lit(bold).alias("bold")))).otherwise(F.array().cast(SPAN))
        return F.struct((a + n).cast("int").alias("at"), F.concat(acc["out"], span(a, a + b, True), span(a + b, a + n, False)).alias("out"))

    return F.aggregate(joined, zero, step)["out"]


def pieces(text: Column, pattern: str) -> Column:
    """A text cut into matches of a pattern and what lies between, in order, without empty pieces."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(between, found, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.filter(F.flatten(both), lambda x: x != "")


@query(f"""with m as ({_MARKED}), p as (select doc_id, pos, unnest(regexp_extract_all(text, '{CITATION}|(?:[^\\[〔]|[\\[〔])')) as x, generate_subscripts(regexp_extract_all(text, '{CITATION}|(?:[^\\[〔]|[\\[〔])'), 1) as i from m),
f as (select *, regexp_full_match(x, '{CITATION}') as cited from p), g as (select *, sum(case when cited or coalesce(lag_cited, true) then 1 else 0 end) over (partition by doc_id, pos order by i) as grp from (select *, lag(cited) over (partition by doc_id, pos order by i) as lag_cited from f)),
t as (select doc_id, pos, grp, bool_or(cited) as superscript, string_agg(x, '' order by i) as x from g group by 1, 2, 3) select doc_id, pos, (row_number() over (partition by doc_id, pos order by grp) - 1)::integer as n, case when superscript then '[' || regexp_extract(x, '[0-9]+') || ']' else x end as text, superscript from t""")
def citation_runs(spark, sf_dir):
    """Runs around citations of one or two digits, which become [n] and are set superscript."""
    t = _lines(spark, sf_dir, _MARKED).select("doc_id", "pos", F.posexplode(pieces(F.col("text"), CITATION)).alias("n", "x"))
    cited = F.col("x").rlike(f"^(?:{CITATION})$")
    return t.select("doc_id", "pos", "n", F.when(cited, F.concat(F.lit("["), F.regexp_extract("x", "[0-9]+", 0), F.lit("]"))).otherwise(F.col("x")).alias("text"), cited.alias("superscript"))


@query(f"with m as ({_MARKED}), r as (select doc_id, pos, regexp_extract_all(text, '[0-9]+|[a-zA-Z]+|[^0-9a-zA-Z]+') as x from m) select doc_id, pos, len(x)::integer as runs, len(list_filter(x, lambda t: regexp_matches(t, '^[0-9a-zA-Z]')))::integer as latin from r")
def latin_runs(spark, sf_dir):
    """How many runs a text has when digits and Latin letters get a font of their own, and how many of them do."""
    x = pieces(F.col("text"), "[0-9]+|[a-zA-Z]+")
    return _lines(spark, sf_dir, _MARKED).withColumn("x", x).select("doc_id", "pos", F.size("x").alias("runs"), F.size(F.filter("x", lambda t: t.rlike("^[0-9a-zA-Z]"))).alias("latin"))


@query(f"""with m as ({_MARKED}), o as (select doc_id, pos, text, unnest(range(length(text)::bigint)) as i from m), c as (select *, regexp_matches(substr(text, i + 1), '^{OPENERS}') and not (regexp_matches(substr(text, i + 1, 1), '[一二三四五六七八九十]') and i > 0 and regexp_matches(substr(text, i, 1), '[一二三四五六七八九十]')) as opens from o),
s as (select doc_id, pos, text, i as a from c where opens or i = 0), e as (select *, lead(a, 1, length(text)) over (partition by doc_id, pos order by a) as b from s), p as (select *, substr(text, a + 1, b - a) as x from e),
z as (select *, case when starts_with(x, '{FIXED}') then length('{FIXED}') when regexp_matches(x, '^{LEAD}') then case when strpos(x, '。') > 0 then strpos(x, '。') else length(x) end else 0 end as n from p)
select doc_id, pos, a::integer as start, (a + n)::integer as "end", true as bold from z where n > 0 union all select doc_id, pos, (a + n)::integer, b::integer, false from z where a + n < b""")
def emphasis_spans(spark, sf_dir):
    """Bold and plain spans of every text: numbered leads up to their full stop, fixed words up to their colon."""
    return _lines(spark, sf_dir, _MARKED).select("doc_id", "pos", F.inline(emphasis(F.col("text"))))


# Tokens: redundant page breaks.
_TOKENS = f"select doc_id, pos, q, s, k, case when k < 9 then 'body' when k = 9 then '__table__' when k = 10 then 'attachment_title' else 'heading1' end as type from ({_LINE}) f"
_OBJECTS = ("attachment_page_mark", "attachment_title", "attachment_body", "glossary_title", "__table__", "__image__", "__object_caption__")
_FORMS = (("各部门要，", "p", "落实。"), ("各部门要落实。", "p"), ("各部门", "p", "要落实。", "p", "p"), ("p", "各部门要落实。"), ("甲：", "p", " "), ("p",), ("甲、", "p", "乙；", "p", "丙。"), ("甲。", "p", "", "p"))


def without_redundant_breaks(tokens: Column) -> Column:
    """Token texts, 'p' for a page break, without those behind a mark that goes on in text, and without those at the end of all text."""
    text = lambda x: F.when(x == "p", "").otherwise(x)
    said = lambda xs: F.array_join(F.transform(xs, text), "")

    def kept(x: Column, i: Column) -> Column:
        before, behind = said(F.slice(tokens, F.lit(1), i)), said(F.slice(tokens, i + 2, F.size(tokens)))
        return ~((x == "p") & F.rtrim(before).rlike("[，,、；;：:]$") & (F.ltrim(behind) != ""))

    inner = F.filter(tokens, kept)
    return F.when(said(tokens) == "", tokens).otherwise(F.get(F.transform(F.array(inner), lambda xs: F.slice(xs, F.lit(1), F.size(xs) - F.array_position(F.transform(F.reverse(xs), lambda x: (x != "p") & (x != "")), True).cast("int") + 1)), F.lit(0)))


_FORM_SQL = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in f) + "]" for f in _FORMS) + "]"
_JOIN = lambda xs: f"array_to_string(list_transform({xs}, lambda x: case when x = 'p' then '' else x end), '')"


@query(f"""with t as ({_TOKENS}), n as (select *, {_FORM_SQL}[q % {len(_FORMS)} + 1] as v, lead(type) over (partition by doc_id order by pos) as nxt from t),
f as (select *, type = 'body' and nxt is not null and nxt not in {_OBJECTS} and {_JOIN('v')} <> '' as applies, list_filter(v, lambda x, i: not (x = 'p' and regexp_matches(rtrim({_JOIN('v[:i - 1]').replace('lambda x:', 'lambda y:').replace('when x =', 'when y =').replace('else x end', 'else y end')}), '[，,、；;：:]$') and ltrim({_JOIN('v[i + 1:]').replace('lambda x:', 'lambda y:').replace('when x =', 'when y =').replace('else x end', 'else y end')}) <> '')) as w from n),
l as (select *, list_max(list_transform(w, lambda x, i: case when x not in ('p', '') then i else 0 end)) as last from f) select doc_id, pos, array_to_string(case when applies then w[:last] else v end, '|') as tokens, applies from l""")
def page_break_tokens(spark, sf_dir):
    """Tokens of body paragraphs without redundant page breaks; before objects and attachments, and at a document's end, breaks stay."""
    t = _lines(spark, sf_dir, _TOKENS).withColumn("v", F.get(F.array(*[F.array(*map(F.lit, f)) for f in _FORMS]), F.col("q") % len(_FORMS)))
    after = F.lead("type").over(W.partitionBy("doc_id").orderBy("pos"))
    shown = F.exists("v", lambda x: (x != "p") & (x != ""))
    t = t.withColumn("applies", F.coalesce((F.col("type") == "body") & after.isNotNull() & ~after.isin(*_OBJECTS) & shown, F.lit(False)))
    return t.select("doc_id", "pos", F.array_join(F.when(F.col("applies"), without_redundant_breaks(F.col("v"))).otherwise(F.col("v")), "|").alias("tokens"), "applies")


# Rows typed with columns, attachment notes, signature order.
_ROWS = f"select doc_id, pos, case when k = 0 then '附件' || q when k = 1 then '附件 ' when k < 5 then '姓名' || chr(9) || '职务' when k < 7 then '甲  乙' || q || '  丙' when k = 7 then '一览表' else '各部门要落实' || q || '项工作。' end as text, s % 4 <> 0 as page_break from ({_LINE}) f"


@query(f"""with r as ({_ROWS}), o as (select *, row_number() over (partition by doc_id order by pos) as i, regexp_matches(trim(text), '{PAGE_MARK}') as mark, case when text like '姓名%' then 2 when text like '甲%' then 3 else 0 end as columns from r),
h as (select a.doc_id, a.i, (select min(b.i) from o b where b.doc_id = a.doc_id and b.i > a.i + 2 and (b.mark or b.columns = 0 or b.columns <> (select c.columns from o c where c.doc_id = a.doc_id and c.i = a.i + 2))) as stop, (select c.columns > 0 and not c.mark from o c where c.doc_id = a.doc_id and c.i = a.i + 2) as opens from o a where a.mark and a.page_break),
g as (select o.doc_id, o.pos, o.i, o.columns, h.i as head, count(*) over (partition by o.doc_id, h.i) as n from h join o on o.doc_id = h.doc_id and o.i >= h.i + 2 and o.i < coalesce(h.stop, 1e9) where h.opens)
select distinct doc_id, pos, columns from g where n >= 2""")
def manual_columns(spark, sf_dir):
    """Rows typed with equal columns behind an attachment's mark and title, two or more: their layout is kept."""
    doc = W.partitionBy("doc_id").orderBy("pos")
    t = F.trim("text")
    o = _lines(spark, sf_dir, _ROWS).withColumns({"i": F.row_number().over(doc), "mark": t.rlike(PAGE_MARK), "columns": P.column_count(F.col("text"))})
    # A stretch: rows of equal columns one behind the other; marks and rows without columns end it.
    o = o.withColumn("columns", F.when(F.col("mark"), 0).otherwise(F.col("columns"))).withColumn("head", F.coalesce(F.lag(F.col("mark") & F.col("page_break"), 2).over(doc), F.lit(False)))
    o = o.withColumn("same", F.sum((F.col("columns") != F.coalesce(F.lag("columns").over(doc), F.lit(-1))).cast("int")).over(doc))
    # Within a stretch everything from the first row that a head points to is kept.
    own = W.partitionBy("doc_id", "same")
    first = F.min(F.when(F.col("head"), F.col("i"))).over(own)
    kept = (F.col("columns") > 0) & (F.col("i") >= first)
    o = o.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("n", F.count(F.when(F.col("kept"), 1)).over(own))
    return o.where("kept and n >= 2").select("doc_id", "pos", "columns")


_NOTES = f"select doc_id, pos, case when k < 3 then 'attachment_note' when k < 8 then 'attachment_note_item' else 'body' end as type, case when k = 0 then '附件：' || (q % 5) || '.方案' || q when k = 1 then '附件: 清单' when k = 2 then '附件' when k < 6 then (q % 9) || '、  材料' || s when k < 8 then '说明' || q else '正文' end as text from ({_LINE}) f"


@query(f"""with t as ({_NOTES}), m as (select *, sum(case when type <> 'attachment_note_item' then 1 else 0 end) over (partition by doc_id order by pos) as grp from t),
g as (select *, first_value(type) over w as head, first_value(text) over w as lead_text, row_number() over w - 1 as off, count(*) over (partition by doc_id, grp) - 1 as items from m window w as (partition by doc_id, grp order by pos)),
b as (select *, head = 'attachment_note' and regexp_matches(lead_text, '^附件\\s*[:：]') as ok, trim(regexp_replace(lead_text, '^附件\\s*[:：]\\s*', '')) as body from g), n as (select *, try_cast(nullif(regexp_extract(body, '^([0-9]+)[.．、]', 1), '') as int) as given, trim(regexp_replace(body, '^[0-9]+[.．、]\\s*', '')) as bare from b)
select doc_id, pos, type, case when not ok or type = 'body' then text when off > 0 then (coalesce(given, 1) + off) || '. ' || trim(regexp_replace(text, '^\\s*[0-9]+[.．、]\\s*', '')) when items > 0 then rtrim('附件：' || coalesce(given, 1) || '. ' || bare) else rtrim('附件：' || bare) end as normalized, ok and off = 0 and type = 'attachment_note' and items > 0 as multiple from n""")
def attachment_note_numbers(spark, sf_dir):
    """Attachment notes and their items numbered on from the note's own number; a note without items loses it."""
    doc = W.partitionBy("doc_id").orderBy("pos")
    t = _lines(spark, sf_dir, _NOTES).withColumn("group", F.sum((F.col("type") != "attachment_note_item").cast("int")).over(doc))
    own = W.partitionBy("doc_id", "group")
    t = t.withColumns({"off": F.row_number().over(own.orderBy("pos")) - 1, "items": F.count("*").over(own) - 1, "lead": F.first(F.struct("type", "text")).over(own.orderBy("pos"))})
    body = F.trim(F.regexp_replace("lead.text", r"^附件\s*[:：]\s*", ""))
    ok = (F.col("lead.type") == "attachment_note") & F.col("lead.text").rlike(r"^附件\s*[:：]")
    start = F.coalesce(F.nullif(F.regexp_extract(body, "^([0-9]+)[.．、]", 1), F.lit("")).cast("int"), F.lit(1))
    bare = F.trim(F.regexp_replace(body, r"^[0-9]+[.．、]\s*", ""))
    item = F.concat((start + F.col("off")).cast("string"), F.lit(". "), F.trim(F.regexp_replace("text", r"^\s*[0-9]+[.．、]\s*", "")))
    new = F.when(~ok | (F.col("type") == "body"), F.col("text")).when(F.col("off") > 0, item).when(F.col("items") > 0, F.rtrim(F.concat(F.lit("附件："), start.cast("string"), F.lit(". "), bare))).otherwise(F.rtrim(F.concat(F.lit("附件："), bare)))
    return t.select("doc_id", "pos", "type", new.alias("normalized"), (ok & (F.col("off") == 0) & (F.col("type") == "attachment_note") & (F.col("items") > 0)).alias("multiple"))


_SIGNS = f"select doc_id, pos, case when k < 3 then 'sign_org' when k < 6 then 'sign_date' when k < 8 then 'attachment_note' when k = 8 then 'blank' else 'body' end as type from ({_LINE}) f"


@query(f"with t as ({_SIGNS}), v as (select *, row_number() over (partition by doc_id order by pos) as i from t where type <> 'blank'), d as (select v.doc_id, v.pos, v.i, (select max(o.i) from v o where o.doc_id = v.doc_id and o.type = 'sign_org' and o.i < v.i) as org from v where type = 'sign_date') select doc_id, pos, (i - org - 1)::bigint as between, (select count(*) from v n where n.doc_id = d.doc_id and n.i > org and n.i < d.i and n.type = 'attachment_note') as notes from d where org is not null and org <> i - 1")
def signature_order_violations(spark, sf_dir):
    """Dates whose organization does not stand right above them: how much stands between, and how many attachment notes."""
    doc = W.partitionBy("doc_id").orderBy("pos")
    v = _lines(spark, sf_dir, _SIGNS).where("type <> 'blank'").withColumns({"i": F.row_number().over(doc), "notes": F.sum((F.col("type") == "attachment_note").cast("int")).over(doc)})
    org = F.last(F.when(F.col("type") == "sign_org", F.struct("i", "notes")), True).over(doc.rowsBetween(W.unboundedPreceding, -1))
    d = v.withColumn("org", org).where("type = 'sign_date' and org is not null and org.i <> i - 1")
    return d.select("doc_id", "pos", (F.col("i") - F.col("org.i") - 1).cast("bigint").alias("between"), (F.col("notes") - F.col("org.notes")).alias("notes"))


# Native numbering.
FORMATS = ("chineseCounting", "chineseCountingThousand", "ideographTraditional")
_NATIVE = (
    f"select doc_id, pos, case when k < 9 then 'f' || (s % 3) end as family, cast(case when k < 9 then q % 4 end as int) as ilvl, case when k = 0 then 'chineseCounting' when k = 1 then 'ideographTraditional' when k < 5 then 'decimal' else 'lowerLetter' end as format, "
    "case when k in (0, 2) then '%' || (q % 4 + 1) || '.' when k = 1 then '（%' || (q % 4 + 1) || '）' when k = 3 then '(%' || (q % 4 + 1) || ')' when k = 4 then '第%1' else '%1' end as template, case when q % 5 = 0 then 'Heading ' || (s % 5) when q % 5 = 1 then '标题' || (s % 4 + 1) else 'Normal' end as style, "
    f"q % 7 = 0 as colon_end, q % 11 = 0 as sentence from ({_LINE}) f"
)


def template_level(template: Column, format_: Column, ilvl: Column) -> Column:
    """1 to 4 by the shape of a numbering's template and its format, else null."""
    t, place = F.regexp_replace(template, r"\s+", ""), F.concat(F.lit("%"), (ilvl + 1).cast("string"))
    dotted = lambda ends: F.exists(F.array(*map(F.lit, ends)), lambda e: t == F.concat(place, e))
    wrapped = (F.substring(t, 1, 1).isin("（", "(")) & (F.substring(t, -1, 1).isin("）", ")")) & (F.substr(t, F.lit(2), F.length(t) - 2) == place)
    chinese, decimal = format_.isin(*FORMATS), format_.isin("decimal", "decimalZero")
    return F.when(chinese & dotted("、.．"), 1).when(chinese & wrapped, 2).when(decimal & dotted(".．"), 3).when(decimal & wrapped, 4)


def native_levels(df: DataFrame) -> DataFrame:
    """(doc_id, pos, family, ilvl, format, template, style, colon_end, sentence) with body_list, level and source of natively numbered paragraphs.

    A run of one family behind a line that ends with a colon is a list of the body. Of the others a template decides, then the style; then the last
    decided paragraph of its family and depth, then the nearest depth of the family, levels counted from it.
    """
    doc = W.partitionBy("doc_id").orderBy("pos")
    numbered, family = F.col("family").isNotNull(), F.col("family")
    before = F.lag(F.col("colon_end")).over(doc)
    # A list opens behind a colon and goes on while the family stays; a stretch is a run of one family.
    df = df.withColumn("new", (~family.eqNullSafe(F.lag("family").over(doc))).cast("int")).withColumn("stretch", F.sum("new").over(doc))
    opened = F.max(F.coalesce(before, F.lit(False)).cast("int")).over(W.partitionBy("doc_id", "stretch").orderBy("pos"))
    df = df.withColumn("body_list", numbered & (opened == 1))
    able = numbered & ~F.col("body_list") & ~F.col("sentence") & ~F.col("colon_end")
    by_template = template_level(F.col("template"), F.col("format"), F.col("ilvl"))
    by_style = F.nullif(F.regexp_extract(F.lower("style"), r"^(?:heading|标题)\s*([1-4])$", 1), F.lit("")).cast("int")
    df = df.withColumn("able", able).withColumn("own", F.when(F.col("able"), F.coalesce(by_template, by_style))).withColumn("by", F.when(F.col("able") & by_template.isNotNull(), "template").when(F.col("able") & by_style.isNotNull(), "word-style"))
    # The last decided paragraph of each family and depth in the whole document.
    known = df.where("own is not null").groupBy("doc_id", "family", "ilvl").agg(F.max_by("own", "pos").alias("anchor"))
    lists = known.groupBy(F.col("doc_id").alias("d"), F.col("family").alias("f")).agg(F.collect_list(F.struct("ilvl", "anchor")).alias("anchors"))
    met = df.join(lists, (F.col("doc_id") == F.col("d")) & (F.col("family") == F.col("f")), "left")
    same = F.get(F.filter("anchors", lambda a: a["ilvl"] == F.col("ilvl")), F.lit(0))["anchor"]
    near = F.array_min(F.transform("anchors", lambda a: F.struct(F.abs(a["ilvl"] - F.col("ilvl")).alias("far"), a["anchor"].alias("anchor"), a["ilvl"].alias("ilvl"))))
    met = met.withColumn("relative", near["anchor"] + F.col("ilvl") - near["ilvl"])
    relative = F.when(F.col("relative").between(1, 4), F.col("relative"))
    level = F.when(F.col("able"), F.coalesce("own", same, relative))
    source = F.when(~F.col("able"), None).when(F.col("own").isNotNull(), F.col("by")).when(same.isNotNull(), "family-sibling").when(relative.isNotNull(), "family-context")
    return met.select("doc_id", "pos", "family", "ilvl", "body_list", level.cast("int").alias("level"), source.alias("source"))


_TEMPLATE_SQL = f"case when format in {FORMATS} and template in ('%' || (ilvl + 1) || '、', '%' || (ilvl + 1) || '.', '%' || (ilvl + 1) || '．') then 1 when format in {FORMATS} and regexp_full_match(template, '[（(]%' || (ilvl + 1) || '[）)]') then 2 when format = 'decimal' and template in ('%' || (ilvl + 1) || '.', '%' || (ilvl + 1) || '．') then 3 when format = 'decimal' and regexp_full_match(template, '[（(]%' || (ilvl + 1) || '[）)]') then 4 end"


@query(f"""with recursive n as ({_NATIVE}), o as (select *, row_number() over (partition by doc_id order by pos) as i from n),
walk(doc_id, i, active) as (select doc_id, i, null::varchar from o where i = 1 union all select o.doc_id, o.i, case when o.family is null then null when p.colon_end then o.family when w.active = o.family then w.active end from walk w join o on o.doc_id = w.doc_id and o.i = w.i + 1 join o p on p.doc_id = w.doc_id and p.i = w.i),
l as (select o.*, o.family is not null and coalesce(w.active = o.family, false) as body_list, {_TEMPLATE_SQL} as tl, try_cast(nullif(regexp_extract(lower(style), '^(?:heading|标题)\\s*([1-4])$', 1), '') as int) as sl from o join walk w on o.doc_id = w.doc_id and o.i = w.i),
e as (select *, family is not null and not body_list and not sentence and not colon_end as able from l), k as (select doc_id, family, ilvl, arg_max(coalesce(tl, sl), pos) as anchor from e where able and coalesce(tl, sl) is not null group by 1, 2, 3),
f as (select e.*, (select anchor from k where k.doc_id = e.doc_id and k.family = e.family and k.ilvl = e.ilvl) as same, (select min((abs(k.ilvl - e.ilvl), k.anchor, k.ilvl)) from k where k.doc_id = e.doc_id and k.family = e.family) as near from e),
r as (select *, near[2] + ilvl - near[3] as rel from f)
select doc_id, pos, family, ilvl, body_list, (case when able then coalesce(tl, sl, same, case when rel between 1 and 4 then rel end) end)::integer as level, case when not able then null when tl is not null then 'template' when sl is not null then 'word-style' when same is not null then 'family-sibling' when rel between 1 and 4 then 'family-context' end as source from r""")
def native_numbering_levels(spark, sf_dir):
    """Heading levels of natively numbered paragraphs: by template, style, siblings, the nearest depth of the family; lists of the body have none."""
    return native_levels(_lines(spark, sf_dir, _NATIVE))
