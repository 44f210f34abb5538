"""Headings and structure over derived Chinese paragraphs: levels, counters, families, gaps, blocks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import numerals as N
from quire.functions import predicates as P
from quire.plans.registry import query
from quire.sources.tables import OUTLINE_SQL, outline, table

T = f"with t as ({OUTLINE_SQL})"

_LEVEL_SQL = "case when regexp_matches(text, '^[一二三四五六七八九十百]+[、.．]') then 1 when regexp_matches(text, '^[（(][一二三四五六七八九十百]+[）)]') then 2 when regexp_matches(text, '^[0-9]+[.．]') then 3 when regexp_matches(text, '^[（(][0-9]+[）)]') and not regexp_matches(text, '[:：]') then 4 end"


def in_doc():
    return W.partitionBy("doc_id")


def in_order():
    return in_doc().orderBy("pos")


def upto():
    return in_order().rowsBetween(W.unboundedPreceding, 0)


@query(f"{T} select doc_id, pos, {_LEVEL_SQL} as heading_level, regexp_extract(text, '^([一二三四五六七八九十百]+[、.．]+|[（(][一二三四五六七八九十百]+[）)]|[0-9]+[.．]|[（(][0-9]+[）)])', 1) as prefix from t")
def heading_levels(spark, sf_dir):
    """Level and number prefix of every paragraph by shape."""
    t = outline(spark, sf_dir)
    return t.select("doc_id", "pos", P.heading_level(F.col("text")).alias("heading_level"), P.heading_prefix(F.col("text")).alias("prefix"))


def counters(t, level="level"):
    """a, b, c, d: how many headings of each level stand since the last heading of a shallower level."""
    out = t
    for k in range(1, 5):
        # An island starts at every shallower heading; counting inside it resets the counter.
        out = out.withColumn(f"island{k}", F.sum(((F.col(level) > 0) & (F.col(level) < k)).cast("int")).over(upto()))
    # The running count of a level less what it was before the island's first row; counts only grow, so that is a maximum over the same rows and needs no sort of islands.
    own = lambda k: (F.col(level) == k).cast("int")
    out = out.withColumns({f"all{k}": F.sum(own(k)).over(upto()) for k in range(1, 5)})
    out = out.withColumns({"abcd"[k - 1]: F.col(f"all{k}") - F.coalesce(F.max(F.when((F.col(level) > 0) & (F.col(level) < k), F.col(f"all{k}"))).over(upto()), F.lit(0)) for k in range(1, 5)})
    return out.drop(*[f"all{k}" for k in range(1, 5)])


_ISLANDS = ", ".join(f"sum(case when level > 0 and level < {k} then 1 else 0 end) over (partition by doc_id order by pos) as i{k}" for k in range(1, 5))
_COUNTS = ", ".join(f"(sum(case when level = {k} then 1 else 0 end) over (partition by doc_id, i{k} order by pos))::bigint as {'abcd'[k - 1]}" for k in range(1, 5))
_CN = "['一','二','三','四','五','六','七','八','九']"


@query(f"{T}, i as (select *, {_ISLANDS} from t), c as (select *, {_COUNTS} from i) select doc_id, pos, a, b, c, d, case level when 1 then {_CN}[a] || '、' when 2 then '（' || {_CN}[b] || '）' when 3 then c || '.' when 4 then '（' || d || '）' else '' end as numbering from c")
def heading_numbering(spark, sf_dir):
    """Counters that reset below a shallower heading, and the number each heading is given."""
    c = counters(outline(spark, sf_dir))
    cn = lambda x: N.chinese_integer(F.col(x).cast("int"))
    number = F.when(F.col("level") == 1, F.concat(cn("a"), F.lit("、"))).when(F.col("level") == 2, F.concat(F.lit("（"), cn("b"), F.lit("）"))).when(F.col("level") == 3, F.concat(F.col("c").cast("string"), F.lit("."))).when(F.col("level") == 4, F.concat(F.lit("（"), F.col("d").cast("string"), F.lit("）"))).otherwise("")
    return c.select("doc_id", "pos", "a", "b", "c", "d", number.alias("numbering"))


_FAMILY = f"i as (select *, {_ISLANDS} from t where level > 0), f as (select *, case level when 1 then i1 when 2 then i2 when 3 then i3 else i4 end as scope from i), g as (select *, lag(number) over (partition by doc_id, level, scope order by pos) as before from f)"
_ISSUE = "case when before is null and number > 1 then 'starts_after_one' when number = before then 'duplicate' when number < before then 'reverse' when number > before + 1 then 'gap' else 'none' end"


def families(spark, sf_dir):
    """Headings with their family (level and parent scope), the number before and the family's issue at each."""
    t = counters(outline(spark, sf_dir).where("level > 0"))
    scope = F.when(F.col("level") == 1, F.col("island1")).when(F.col("level") == 2, F.col("island2")).when(F.col("level") == 3, F.col("island3")).otherwise(F.col("island4"))
    f = t.withColumn("scope", scope).withColumn("before", F.lag("number").over(W.partitionBy("doc_id", "level", "scope").orderBy("pos")))
    n, b = F.col("number"), F.col("before")
    issue = F.when(b.isNull() & (n > 1), "starts_after_one").when(n == b, "duplicate").when(n < b, "reverse").when(n > b + 1, "gap").otherwise("none")
    return f.withColumn("issue", issue)


@query(f"{T}, {_FAMILY} select doc_id, level, scope::bigint as scope, count(*) as members, min(number) as first_number, max(number) as last_number, (count_if({_ISSUE} <> 'none'))::bigint as issues from g group by 1, 2, 3")
def heading_families(spark, sf_dir):
    """Numbering families by level and parent scope."""
    return families(spark, sf_dir).groupBy("doc_id", "level", "scope").agg(F.count("*").alias("members"), F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.count_if(F.col("issue") != "none").alias("issues"))


@query(f"{T}, {_FAMILY} select doc_id, pos, level, number as actual, coalesce(before, 0) + 1 as expected, {_ISSUE} as kind from g where {_ISSUE} <> 'none'")
def numbering_gap_issues(spark, sf_dir):
    """Where a family's numbers skip, repeat, go back or start late; only the first of these is named."""
    return families(spark, sf_dir).where("issue <> 'none'").select("doc_id", "pos", "level", F.col("number").alias("actual"), (F.coalesce("before", F.lit(0)) + 1).alias("expected"), F.col("issue").alias("kind"))


@query(f"{T}, {_FAMILY}, k as (select doc_id, {_ISSUE} as issue, level from g) select t.doc_id, count(*) as paragraphs, count_if(t.level > 0)::bigint as headings, max(t.level) as deepest, coalesce(any_value(x.issues), 0)::bigint as issues, coalesce(any_value(x.gaps), 0)::bigint as gaps from t left join (select doc_id, count_if(issue <> 'none') as issues, count_if(issue = 'gap') as gaps from k group by 1) x on t.doc_id = x.doc_id group by t.doc_id")
def outline_quality(spark, sf_dir):
    """The outline report per document: headings, depth and numbering issues, in windows and one aggregation."""
    t = outline(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("level") > 0).alias("headings"), F.max("level").alias("deepest"))
    x = families(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("issue") != "none").alias("issues"), F.count_if(F.col("issue") == "gap").alias("gaps"))
    return t.join(x, "doc_id", "left").select("doc_id", "paragraphs", "headings", "deepest", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


_LISTS = "n as (select doc_id, pos, level - 1 as ilvl, number % 2 as num_id, 1 + number % 2 * 4 as first from t where level > 0)"


@query(f"{T}, {_LISTS}, p as (select n.*, (select max(q.pos) from n q where q.doc_id = n.doc_id and q.num_id = n.num_id and q.pos < n.pos and q.ilvl < n.ilvl) as parent from n) select doc_id, pos, num_id, ilvl, (row_number() over (partition by doc_id, num_id, ilvl, parent order by pos) - 1 + first)::bigint as ordinal from p")
def native_list_ordinals(spark, sf_dir):
    """Ordinals of native lists: a counter for each list and level, from the list's start, anew below a shallower item of the same list."""
    ilvl = F.col("level") - 1
    n = outline(spark, sf_dir).where("level > 0").select("doc_id", "pos", ilvl.alias("ilvl"), (F.col("number") % 2).alias("num_id"), (1 + F.col("number") % 2 * 4).alias("first"))
    own = W.partitionBy("doc_id", "num_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    parents = [F.sum((F.col("ilvl") < k).cast("int")).over(own) for k in range(1, 4)]
    n = n.withColumn("island", F.coalesce(*[F.when(F.col("ilvl") == k, x) for k, x in zip(range(1, 4), parents)], F.lit(0)))
    place = F.row_number().over(W.partitionBy("doc_id", "num_id", "ilvl", "island").orderBy("pos")) - 1
    return n.select("doc_id", "pos", "num_id", "ilvl", (place + F.col("first")).cast("bigint").alias("ordinal"))


@query(f"{T} select doc_id, pos, case when level = 1 and number > 1 and coalesce(lag(level) over w, 0) = 0 then 'parallel' when level > coalesce(lag(level) over w, 0) + 1 then 'jump' when coalesce(lag(level) over w, 0) = level then 'sibling' when level > 0 then 'step' else 'body' end as relation, lag(level) over w as before, lead(level) over w as after from t window w as (partition by doc_id order by pos)")
def heading_relations(spark, sf_dir):
    """How a heading relates to the paragraph before: sibling, step, jump of more than one level, or parallel start."""
    before = F.coalesce(F.lag("level").over(in_order()), F.lit(0))
    level = F.col("level")
    kind = F.when((level == 1) & (F.col("number") > 1) & (before == 0), "parallel").when(level > before + 1, "jump").when(before == level, "sibling").when(level > 0, "step").otherwise("body")
    return outline(spark, sf_dir).select("doc_id", "pos", kind.alias("relation"), F.lag("level").over(in_order()).alias("before"), F.lead("level").over(in_order()).alias("after"))


_KIND = "case when pos = 1 then 'title' when level > 0 then 'heading' else 'body' end"


def labelled(spark, sf_dir):
    """Paragraphs with block labels; the last body paragraph of a document is its signature."""
    t = outline(spark, sf_dir).withColumn("last", F.max("pos").over(in_doc()))
    label = F.when(F.col("pos") == 1, "title").when((F.col("pos") == F.col("last")) & (F.col("level") == 0), "signature").when(F.col("level") > 0, "heading").otherwise("body")
    return t.withColumn("label", label)


_LABELLED = "b as (select *, case when pos = 1 then 'title' when pos = max(pos) over (partition by doc_id) and level = 0 then 'signature' when level > 0 then 'heading' else 'body' end as label from t), c as (select *, case when label <> lag(label, 1, '') over (partition by doc_id order by pos) then 1 else 0 end as new from b), s as (select *, sum(new) over (partition by doc_id order by pos) as island from c)"


def spans(t):
    """Gaps and islands: runs of one label become blocks."""
    c = t.withColumn("new", (F.col("label") != F.coalesce(F.lag("label").over(in_order()), F.lit(""))).cast("int"))
    s = c.withColumn("island", F.sum("new").over(upto()))
    return s.groupBy("doc_id", "island", "label").agg(F.min("pos").alias("start_index"), F.max("pos").alias("end_index"), F.count("*").alias("elements"))


@query(f"{T}, {_LABELLED} select doc_id, island::bigint as block, label as block_kind, min(pos) as start_index, max(pos) as end_index, count(*) as elements from s group by 1, 2, 3")
def structure_spans(spark, sf_dir):
    """Structure blocks as contiguous labelled spans."""
    return spans(labelled(spark, sf_dir)).select("doc_id", F.col("island").alias("block"), F.col("label").alias("block_kind"), "start_index", "end_index", "elements")


@query(f"{T}, {_LABELLED}, g as (select doc_id, island, label, count(*) as n from s group by 1, 2, 3) select doc_id, sum(n)::bigint as covered, count(*) as blocks, count_if(label = 'title')::bigint as titles, (count_if(label = 'heading') > 1)::boolean as split_heading from g group by 1")
def structure_coverage(spark, sf_dir):
    """Every element is in one block; a single-block kind that is split is reported."""
    return spans(labelled(spark, sf_dir)).groupBy("doc_id").agg(F.sum("elements").alias("covered"), F.count("*").alias("blocks"), F.count_if(F.col("label") == "title").alias("titles"), (F.count_if(F.col("label") == "heading") > 1).alias("split_heading"))


# Spacing in lines and page breaks between neighbouring blocks.
BOUNDARIES = (("title", "heading", 1, False), ("title", "body", 1, False), ("heading", "signature", 2, False), ("body", "signature", 2, False), ("signature", "attachment", 0, True))


@query(f"{T}, {_LABELLED}, g as (select doc_id, island, label, min(pos) as p from s group by 1, 2, 3), n as (select doc_id, island, label, lead(label) over (partition by doc_id order by island) as after from g) select n.doc_id, n.island::bigint as block, n.label as block_kind, n.after, r.spacing, r.page_break from n join (values " + ", ".join(f"('{a}', '{b}', {c}, {str(d).lower()})" for a, b, c, d in BOUNDARIES) + ") r(a, b, spacing, page_break) on n.label = r.a and n.after = r.b")
def boundary_rules_applied(spark, sf_dir):
    """Spacing between neighbouring blocks from a literal rule table."""
    n = spans(labelled(spark, sf_dir)).withColumn("after", F.lead("label").over(in_doc().orderBy("island")))
    rules = spark.createDataFrame(BOUNDARIES, "a string, b string, spacing int, page_break boolean")
    return n.join(F.broadcast(rules), (F.col("label") == F.col("a")) & (F.col("after") == F.col("b"))).select("doc_id", F.col("island").alias("block"), F.col("label").alias("block_kind"), "after", "spacing", "page_break")


TAIL = ("body", "sign_org", "sign_date", "attachment_note", "attachment_note_item")
_TAIL_SQL = "x as (select l_orderkey as doc_id, l_linenumber as pos, min(case l_linenumber when 1 then 'body' when 2 then 'sign_org' when 3 then 'sign_date' when 4 then 'attachment_note' when 5 then 'attachment_note_item' else 'attachment_note_item' end) as type from lineitem group by 1, 2)"
_TAIL_KEY = "case type when 'body' then 0 when 'attachment_note' then 1 when 'attachment_note_item' then 2 when 'sign_org' then 3 else 4 end"


@query(f"with {_TAIL_SQL} select doc_id, pos, type, row_number() over (partition by doc_id order by {_TAIL_KEY}, pos) as new_pos from x")
def tail_reorder(spark, sf_dir):
    """Signature and date move behind the attachment note and its items: a sort key inside the tail."""
    li = table(spark, sf_dir, "lineitem")
    names = F.create_map(*[F.lit(v) for i, t in enumerate(TAIL, 1) for v in (i, t)])
    x = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.coalesce(F.try_element_at(names, F.col("l_linenumber")), F.lit(TAIL[-1])).alias("type")).distinct()
    key = F.when(F.col("type") == "body", 0).when(F.col("type") == "attachment_note", 1).when(F.col("type") == "attachment_note_item", 2).when(F.col("type") == "sign_org", 3).otherwise(4)
    return x.select("doc_id", "pos", "type", F.row_number().over(in_doc().orderBy(key, "pos")).cast("bigint").alias("new_pos"))


_DIGIT = "['零','一','二','三','四','五','六','七','八','九']"


_CN_SQL = f"""case when n < 10 then {_DIGIT}[n + 1] else
  case when q > 0 then {_DIGIT}[q + 1] || '千' else '' end
  || case when h > 0 then {_DIGIT}[h + 1] || '百' else '' end
  || case when t > 0 then case when q > 0 and h = 0 then '零' else '' end || case when t = 1 and n < 100 then '十' else {_DIGIT}[t + 1] || '十' end else '' end
  || case when u > 0 then case when n >= 100 and t = 0 then '零' else '' end || {_DIGIT}[u + 1] else '' end end"""
_PLACES = "select *, n // 1000 as q, n // 100 % 10 as h, n // 10 % 10 as t, n % 10 as u"


@query(f"with n as (select o_orderkey as doc_id, (o_orderkey % 10000)::integer as n from orders), d as ({_PLACES} from n) select doc_id, n, {_CN_SQL} as cn from d")
def chinese_integer_table(spark, sf_dir):
    """The last four digits of every order's number in Chinese numerals."""
    n = (F.col("o_orderkey") % 10_000).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), n.alias("n"), N.chinese_integer(n).alias("cn"))


_TEN = "case when t > 0 then (case when n >= 100 or t = 1 then 1 else t end) * 10 + u end"


@query(f"""with n as (select o_orderkey as doc_id, (o_orderkey % 1000)::integer as n, o_custkey % 3 as form, o_custkey as c from orders), d as ({_PLACES} from n), x as (select *, case form when 0 then n::varchar when 1 then {_CN_SQL} else substr('零一二三四五六七八九', n % 10 + 1, 1) || substr('零一二三四五六七八九', h + 1, 1) end as text, {_TEN} as ten from d)
select doc_id, text, case form when 2 then null else n end::integer as date_value,
  case form when 0 then null when 2 then null else case when n = 10 then 10 when n < 10 then n else coalesce(ten, n) end end::integer as token_value,
  case form when 0 then null when 2 then nullif(u * 10 + h, 0) else case when n < 10 then nullif(n, 0) else ten end end::integer as ordinal_value, case form when 0 then n when 2 then 0 else case when n < 10 then n else coalesce(ten, 0) end end::integer as attachment_value from x""")
def chinese_to_int_variants(spark, sf_dir):
    """What the four readers of numerals make of Arabic numbers, Chinese numbers and rows of Chinese digits: beside 十 three of them see single characters only, 百 is unknown to two, rows of digits to three."""
    n, form = (F.col("o_orderkey") % 1000).cast("int"), F.col("o_custkey") % 3
    digit = lambda x: F.substring(F.lit(N.DIGITS), (x + 1).cast("int"), F.lit(1))
    text = F.when(form == 0, n.cast("string")).when(form == 1, N.chinese_integer(n)).otherwise(F.concat(digit(n % 10), digit(F.floor(n / 100) % 10)))
    t, x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), F.col("text")
    return t.select("doc_id", "text", N.date_number(x).alias("date_value"), N.token_number(x).cast("int").alias("token_value"), N.ordinal_number(x).cast("int").alias("ordinal_value"), N.attachment_number(x, F.lit(0)).cast("int").alias("attachment_value"))


_NUM = "['', '一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五','十六','十七','十八','十九','二十','二十一','二十二','二十三','二十四','二十五','二十六','二十七','二十八','二十九','三十','三十一']"


@query(f"select o_orderkey as doc_id, translate(cast(year(o_orderdate) as varchar), '0123456789', '零一二三四五六七八九') || '年' || {_NUM}[month(o_orderdate) + 1] || '月' || {_NUM}[day(o_orderdate) + 1] || '日' as text, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' as normalized from orders")
def sign_dates_normalized(spark, sf_dir):
    """Signature dates in Chinese numerals become Arabic ones."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("d"))
    cn = lambda c: N.chinese_integer(c)
    text = F.concat(F.translate(F.year("d").cast("string"), "0123456789", N.DIGITS), F.lit("年"), cn(F.month("d")), F.lit("月"), cn(F.dayofmonth("d")), F.lit("日"))
    t = d.select("doc_id", text.alias("text"))
    return t.select("doc_id", "text", P.normalize_sign_date(F.col("text")).alias("normalized"))


@query("select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then null else '内政发' end as issuer, case when o_orderkey % 3 = 0 then null else cast(year(o_orderdate) as varchar) end as year, case when o_orderkey % 3 = 0 then null else cast(o_custkey as varchar) end as number from orders")
def dispatch_number_parts(spark, sf_dir):
    """Issuer, year and number of dispatch numbers; other lines have none."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("内政发第"), F.col("o_custkey").cast("string"), F.lit("号"))).otherwise(F.concat(F.lit("内政发 〔"), F.year("o_orderdate").cast("string"), F.lit("〕"), F.col("o_custkey").cast("string"), F.lit(" 号")))
    p = P.dispatch_parts(text)
    return o.select(F.col("o_orderkey").alias("doc_id"), p["issuer"].alias("issuer"), p["year"].alias("year"), p["number"].alias("number"))


@query(f"{T} select doc_id, pos, case when level = 1 then 'number' when level = 0 then 'body' else 'heading' end as style, case when level = 1 then 3 when level = 0 then 1 else 2 end as rank, lead(level) over (partition by doc_id order by pos) is null as terminal from t")
def render_decisions(spark, sf_dir):
    """Style class and terminal paragraph of every paragraph."""
    level, after = F.col("level"), F.lead("level").over(in_order())
    style = F.when(level == 1, "number").when(level == 0, "body").otherwise("heading")
    rank = F.when(level == 1, 3).when(level == 0, 1).otherwise(2)
    return outline(spark, sf_dir).select("doc_id", "pos", style.alias("style"), rank.alias("rank"), after.isNull().alias("terminal"))


@query("select l_orderkey as doc_id, l_linenumber as cell, case when regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') then 'right' when length(v) <= 3 then 'center' else 'left' end as align from (select distinct l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then cast(l_suppkey as varchar) when 1 then l_returnflag else 'cell ' || l_linestatus end as v from lineitem)")
def table_alignment(spark, sf_dir):
    """Cells: numbers right, short ones centred, others left."""
    n = F.col("l_linenumber")
    v = F.when(n % 3 == 0, F.col("l_suppkey").cast("string")).when(n % 3 == 1, F.col("l_returnflag")).otherwise(F.concat(F.lit("cell "), "l_linestatus"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).distinct()
    align = F.when(F.col("v").rlike(r"^[0-9]+(\.[0-9]+)?$"), "right").when(F.length("v") <= 3, "center").otherwise("left")
    return x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cell"), align.alias("align"))
