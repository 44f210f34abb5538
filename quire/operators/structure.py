"""Blocks of a document by ranges, the kind of each element by its neighbours, and both reconciled.

Ranges are positions found by windows over the kinds of a document; the neighbourhood is two elements on either side and the
place in the whole; what agrees, differs or lacks support is decided by one table of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.tables import table

# Kinds by type, kinds that a block allows, thresholds.
KINDS = {
    "title": "document_title", "title_cont": "document_title", "dispatch_number": "document_number", "lh_mark": "letterhead_mark", "lh_signer": "signer", "lh_separator": "letterhead_separator", "meeting_meta": "meeting_metadata",
    **{f"heading{k}": f"heading_{k}" for k in range(1, 5)}, **dict.fromkeys(("body", "attachment_body", "addressing", "responsibility_line"), "body_paragraph"), "list": "list", "list_item": "list", "quote": "quote",
    "attachment_note": "attachment_note_item", "attachment_note_item": "attachment_note_item", "sign_org": "signature_agency", "sign_date": "signature_date", "note": "note", "annotation": "note", "attachment_page_mark": "attachment_title",
    "attachment_title": "attachment_title", "__table__": "table", "__image__": "figure", "__object_caption__": "caption", "__page_break__": "page_break",
    **dict.fromkeys(("author_line", "role_name", "date_line", "meeting_title_meta", "title2", "meeting_line", "location_line"), "title_metadata"),
}
SURE = {"title_metadata": 0.9, "page_break": 0.98, **dict.fromkeys(("letterhead_mark", "signer", "letterhead_separator"), 0.99)}  # others .95, unknown .4
FRONT = ("letterhead_mark", "document_number", "signer", "letterhead_separator")
_BODY = (*[f"heading_{k}" for k in range(1, 5)], "body_paragraph", "list", "quote", "table", "figure", "caption", "unknown", "page_break")
ALLOWED = {
    "front_matter": (*FRONT, "page_break"), "title": ("document_title", "title_metadata"), "body": _BODY, "attachment_note": ("attachment_note_item",), "signature": ("signature_agency", "signature_date", "note"),
    "attachment_content": (*_BODY, "attachment_title"), "unknown": ("unknown", "page_break"),
}
CONFIRMED, PROVISIONAL = 0.85, 0.60
TITLES, BODIES, NOTES = ("title", "title_cont"), ("body", "addressing", "responsibility_line", "attachment_body"), ("note", "annotation")
META = tuple(t for t, k in KINDS.items() if k == "title_metadata")
DATE, NOTE, MARK = "^(?:19|20)[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日$", r"^附件\s*[:：]\s*\S+", r"^附件\s*(?:[:：]\s*)?[0-9一二三四五六七八九十]+\s*[:：]?$"
SHAPES = ("^[一二三四五六七八九十]+、", "^[（(][一二三四五六七八九十]+[）)]", "^[0-9]+[.．、]", "^[（(][0-9]+[）)]")

_HEADS = (("lh_mark", "某某市人民政府文件"), ("dispatch_number", "某政发〔2024〕3号"), ("lh_separator", ""), ("title", "关于工作的报告"), ("title_cont", "（送审稿）"), ("role_name", "市长 张三"), ("date_line", "2024年3月5日"), ("body", "各部门要认真落实各项工作。"), ("sign_org", "某某市财政局"))
_MIDDLE = (
    ("heading1", "一、要求"), ("heading2", "（一）要求"), ("heading3", "3.措施"), ("heading4", "（4）安排"), ("body", "各部门要认真落实工作。"), ("body", "会议强调"), ("addressing", "各位代表："), ("__table__", ""), ("__image__", ""), ("__object_caption__", "图1"), ("heading1", "总体要求"),
    ("quote", "引文"), ("date_line", "2024年3月5日"), ("attachment_title", "附件1"), ("other", "附件2"), ("__page_break__", ""),
)
_TAILS = (("attachment_note", "附件：1.方案"), ("attachment_note_item", "2.清单"), ("sign_org", "某某市财政局"), ("sign_date", "2024年3月5日"), ("note", "（此件公开发布）"), ("__page_break__", ""), ("attachment_page_mark", "附件1"), ("attachment_body", "方案内容如下，请遵照执行。"), ("other", "其他"))
_ALL = (*_HEADS, *_MIDDLE, *_TAILS)
_K = f"case when i < 1 + d % 6 then (d + i * (1 + d % 2)) % {len(_HEADS)} when n - i <= 2 + d % 7 then {len(_HEADS) + len(_MIDDLE)} + (case when d % 3 = 0 then i - n + 30 + d else q + i end) % {len(_TAILS)} else {len(_HEADS)} + (q * 7 + i) % {len(_MIDDLE)} end"
ELEMENTS = (
    "select doc_id, i, case k " + " ".join(f"when {i} then '{t}'" for i, (t, _) in enumerate(_ALL)) + " end as type, case k " + " ".join(f"when {i} then '{x}'" for i, (_, x) in enumerate(_ALL)) + " end as text, "
    f"cast(50 + 10 * (q % 5) as double) / 100 as sure from (select d as doc_id, i, q, {_K} as k from (select o_custkey as d, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as i, cast(count(*) over (partition by o_custkey) as int) as n, cast(o_orderkey % 89 as int) as q from orders) a) b"
)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, type, text, sure): the orders of a customer are the elements of a document; sure is how sure the type is."""
    return spark.sql(ELEMENTS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def _mapped(values: dict, key: Column, other) -> Column:
    out = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return F.coalesce(out, F.lit(other))


def ranges(df: DataFrame) -> DataFrame:
    """Elements with kind, the ranges of their document, the block of each, and how sure a block is: as its weakest element."""
    doc = W.partitionBy("doc_id")
    order = doc.orderBy("i")
    ahead, before = order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    kind, i = F.col("kind"), F.col("i")
    df = df.withColumn("kind", _mapped(KINDS, F.col("type"), "unknown")).withColumns({"count": F.count("*").over(doc).cast("int"), "prev": F.lag("kind").over(order)})
    df = df.withColumn("known", F.when(kind == "unknown", 0.4).otherwise(_mapped(SURE, kind, 0.95)))
    start = (kind == "attachment_title") & (F.col("prev") == "page_break")
    df = df.withColumn("first_attachment", F.coalesce(F.min(F.when(start, i - 1)).over(doc), F.col("count")))
    # The last agency with a date behind it, notes aside, and the notes after the date.
    other = F.struct(F.col("i"), F.col("kind"))
    df = df.withColumns({"next": F.first(F.when(kind != "note", other), True).over(ahead)})
    signed = (kind == "signature_agency") & (F.col("next.kind") == "signature_date") & (F.col("next.i") < F.col("first_attachment")) & (i <= F.col("first_attachment") - 2)
    df = df.withColumn("sign", F.max(F.when(signed, F.struct("i", F.col("next.i").alias("date")))).over(doc))
    df = df.withColumn("sign_end", F.least(F.min(F.when((i > F.col("sign.date")) & (kind != "note"), i)).over(doc), F.col("first_attachment")))
    df = df.withColumn("sign_end", F.when(F.col("sign").isNotNull(), F.col("sign_end")))
    limit = F.coalesce("sign.i", "first_attachment")
    df = df.withColumn("note_last", F.max(F.when((kind == "attachment_note_item") & (i < limit), i)).over(doc))
    df = df.withColumn("note_start", F.when(F.col("note_last").isNotNull(), F.coalesce(F.max(F.when((kind != "attachment_note_item") & (i < F.col("note_last")), i)).over(doc) + 1, F.lit(0))))
    front = kind.isin(*FRONT)
    df = df.withColumns({"front_first": F.min(F.when(front, i)).over(doc), "front_sep": F.min(F.when(kind == "letterhead_separator", i)).over(doc)})
    strange = F.count(F.when(~front & (i >= F.col("front_first")) & (i <= F.col("front_sep")), 1)).over(doc)
    whole = (F.col("front_first") <= 4) & (strange == 0)
    df = df.withColumn("front_end", F.when(F.coalesce(whole, F.lit(False)), F.col("front_sep") + 1))
    df = df.withColumn("limit", F.least(F.coalesce("note_start", "first_attachment"), F.coalesce("sign.i", "first_attachment"), F.col("first_attachment")))
    inside = (kind == "document_title") & (i >= F.coalesce("front_end", F.lit(0))) & (i < F.col("limit"))
    df = df.withColumns({"title_start": F.min(F.when(inside, i)).over(doc), "title_last": F.max(F.when(inside, i)).over(doc)})
    df = df.withColumn("title_end", F.least(F.min(F.when((i > F.col("title_last")) & (kind != "title_metadata"), i)).over(doc), F.greatest(F.col("limit"), F.col("title_last") + 1)))
    df = df.withColumn("title_end", F.when(F.col("title_start").isNotNull(), F.col("title_end")))
    block = F.when(i >= F.col("first_attachment"), "attachment_content").when((i >= F.col("sign.i")) & (i < F.col("sign_end")), "signature").when((i >= F.col("note_start")) & (i <= F.col("note_last")), "attachment_note")
    block = block.when((i >= F.col("title_start")) & (i < F.col("title_end")), "title").when((i >= F.col("front_first")) & (i < F.col("front_end")), "front_matter")
    df = df.withColumn("labelled", block)
    free = F.col("labelled").isNull() & (i >= F.coalesce("title_end", "front_end", F.lit(0))) & (i < F.col("limit")) & (kind != "page_break")
    df = df.withColumns({"body_first": F.min(F.when(free, i)).over(doc), "body_last": F.max(F.when(free, i)).over(doc)})
    df = df.withColumn("block", F.coalesce("labelled", F.when(i.between(F.col("body_first"), F.col("body_last")), "body").otherwise("unknown")))
    attachment = F.sum(F.when(start_of(df), 1).otherwise(0)).over(order)
    df = df.withColumn("part", F.when(F.col("block") == "attachment_content", attachment).otherwise(0))
    new = (F.col("block") != F.coalesce(F.lag("block").over(order), F.lit(""))) | (F.col("part") != F.coalesce(F.lag("part").over(order), F.lit(0)))
    df = df.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("block_sure", F.min("known").over(W.partitionBy("doc_id", "island"))).drop("next", "prev", "labelled")


def start_of(df: DataFrame) -> Column:
    """Whether an element is the page break before an attachment's title."""
    order = W.partitionBy("doc_id").orderBy("i")
    return (df["kind"] == "page_break") & (F.lead("kind").over(order) == "attachment_title")


def neighbours(df: DataFrame) -> DataFrame:
    """Elements (doc_id, i, type, text, sure) with context_kind and context_sure, from two neighbours on either side and the place in the document."""
    doc = W.partitionBy("doc_id")
    order = doc.orderBy("i")
    t, kind, i = F.trim(F.coalesce("text", F.lit(""))), F.col("type"), F.col("i")
    no = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumn("t", t).withColumn("count", F.count("*").over(doc))
    df = df.withColumns({
        "page": kind == "__page_break__", "dated": F.col("t").rlike(DATE), "sentence": (F.length("t") >= 8) & F.col("t").rlike("[。！？；]$"), "place": i / F.greatest(F.col("count") - 1, F.lit(1)), "paragraph": ~kind.isin("__page_break__", "__table__", "__image__", "__object_caption__"),
    })
    df = df.withColumn("short", (F.col("t") != "") & (F.length("t") <= 40) & ~F.col("sentence"))
    fact = F.struct("type", "page", "dated", "sentence")
    df = df.withColumns({f"b{k}": F.lag(fact, k).over(order) for k in (1, 2)} | {f"f{k}": F.lead(fact, k).over(order) for k in (1, 2)})
    dated = F.when(~F.col("f1.page"), F.col("f1.dated")).when(~F.col("f2.page"), F.col("f2.dated"))
    df = df.withColumn("agency", F.col("paragraph") & F.col("short") & (F.col("place") >= 0.35) & no(dated))
    pages = no(F.max(F.col("page").cast("int")).over(order.rowsBetween(1, W.unboundedFollowing)) == 1)
    near = lambda *x: no(F.col("b1.type").isin(*x)) | no(F.col("b2.type").isin(*x))
    df = df.withColumns({"signed": no(F.lag("agency", 1).over(order)) | no(F.lag("agency", 2).over(order)), "titled": near(*TITLES), "head": i <= F.greatest(F.lit(4), F.floor(F.col("count") * F.lit(0.30))), "tail": (F.col("place") >= 0.65) | ((F.col("place") >= 0.20) & pages)})
    harmless = lambda f: F.col(f).isNull() | F.col(f"{f}.type").isin(*NOTES, "attachment_page_mark") | F.col(f"{f}.page")
    safe = no(F.col("f1").isNull() | F.col("f1.page") | (harmless("f1") & harmless("f2")))
    prose = lambda x: F.col(x).isNull() | F.col(f"{x}.page") | F.col(f"{x}.type").isin(*BODIES) | F.col(f"{x}.sentence")
    some = (F.col("b1").isNotNull() & ~F.col("b1.page")) | (F.col("f1").isNotNull() & ~F.col("f1.page"))
    between = no(some) & no(prose("b1")) & no(prose("f1"))
    found = lambda name, sure: F.struct(F.lit(name).alias("kind"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("sure"))
    date = F.when(F.col("signed") & F.col("tail") & safe & ~F.col("titled"), found("signature_date", 0.95)).when(F.col("titled") & F.col("head") & ~F.col("sentence"), found("title_metadata", 0.90)).when(F.col("sentence") | between, found("body_paragraph", 0.86)).otherwise(found("unknown", 0.55))
    mark = F.when(no(F.col("b1.page")) & F.col("tail") & F.col("f1").isNotNull(), found("attachment_title", 0.95)).otherwise(found("unknown", 0.55))
    tail_next = no(F.col("f1.type").isin("attachment_note_item", "sign_org", "sign_date"))
    noted = F.col("t").rlike(NOTE) & (F.col("tail") | ((F.col("place") >= 0.25) & tail_next)) & no(F.col("b1.type").isin(*BODIES, *[f"heading{k}" for k in range(1, 5)])) & tail_next
    out = F.when(F.col("page"), found("page_break", 0.99))
    for type_, name in (("__table__", "table"), ("__image__", "figure"), ("__object_caption__", "caption")):
        out = out.when(kind == type_, found(name, 0.95))
    out = out.when(F.col("dated"), date).when(F.col("t").rlike(MARK), mark).when(noted, found("attachment_note_item", 0.90)).when(F.col("agency"), found("signature_agency", 0.93))
    out = out.when(F.col("head") & F.col("titled") & kind.isin(*META, "sign_org") & F.col("short"), found("title_metadata", 0.88)).when(kind.isin(*TITLES) & F.col("head") & ~F.col("sentence"), found("document_title", 0.90))
    for k, shape in enumerate(SHAPES, 1):
        out = out.when((kind == f"heading{k}") & F.col("t").rlike(shape), found(f"heading_{k}", 0.90))
    for type_ in ("list", "list_item", "quote", "attachment_note_item", "attachment_title", "note", "annotation"):
        out = out.when((kind == type_) & ~F.col("sentence"), found(KINDS[type_], 0.86))
    out = out.when(F.col("sentence"), found("body_paragraph", 0.88)).when(kind.isin(*BODIES), found("body_paragraph", F.col("sure")))
    for type_ in ("lh_mark", "lh_signer", "lh_separator"):
        out = out.when(kind == type_, found(KINDS[type_], 0.90))
    out = out.otherwise(found("unknown", 0.45))
    supported = no(F.col("b1.page")) & F.col("tail") & F.col("f1").isNotNull() & F.col("t").rlike(MARK)
    return df.withColumn("found", out).withColumns({"context_kind": F.col("found.kind"), "context_sure": F.col("found.sure"), "bounded": supported}).drop("found", "b1", "b2", "f1", "f2", "count")


def reconciled(df: DataFrame) -> DataFrame:
    """Elements with block, structure and context: the final kind, its status and confidence, and jumps between heading levels.

    Both sure and the kind allowed in the block: confirmed, if the kinds agree and a kind that needs support has it. Both sure and not allowed: a conflict.
    Both unsure: unknown. Everything else is provisional.
    """
    a = ranges(df)
    b = neighbours(df).select(F.col("doc_id").alias("d"), F.col("i").alias("at"), "context_kind", "context_sure", "bounded")
    both = a.join(b, (F.col("doc_id") == F.col("d")) & (F.col("i") == F.col("at")))
    kind, sure, block_sure = F.col("context_kind"), F.col("context_sure"), F.col("block_sure")
    allowed = F.array_contains(F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("block")], kind)
    high, low = block_sure >= CONFIRMED, block_sure < PROVISIONAL
    c_high, c_low = sure >= CONFIRMED, sure < PROVISIONAL
    case = lambda status, final, p: F.struct(F.lit(status).alias("status"), (final if isinstance(final, Column) else F.lit(final)).alias("final"), p.alias("p"))
    first = (
        F.when(allowed & high & c_high & (kind != "unknown"), case("confirmed", kind, F.least(F.lit(0.99), F.greatest(block_sure, sure) + 0.04)))
        .when(~allowed & high & c_high, case("conflict", "unknown", F.least(block_sure, sure))).when(low & c_low, case("unknown", "unknown", F.greatest(block_sure, sure)))
        .when(allowed & ~c_low, case("provisional", kind, F.least(sure, F.lit(0.84)))).otherwise(case("provisional", "unknown", F.least(F.greatest(block_sure, sure), F.lit(0.84))))
    )
    both = both.withColumn("r", first).withColumn("differs", (F.col("r.status") == "confirmed") & (F.col("kind") != kind))
    # Only one rule gives an attachment title its support; dates and metadata have theirs whenever they are found.
    bare = (F.col("r.status") == "confirmed") & ~F.col("differs") & (F.col("r.final") == "attachment_title") & ~F.col("bounded")
    level = F.nullif(F.regexp_extract("context_kind", "^heading_([1-4])$", 1), F.lit("")).cast("int")
    order = W.partitionBy("doc_id").orderBy("i")
    above = F.last(level, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return both.select(
        "doc_id", "i", "block", F.col("kind").alias("structure_kind"), "context_kind", F.when(bare, "unknown").otherwise(F.col("r.final")).alias("final_kind"), F.when(F.col("differs") | bare, "provisional").otherwise(F.col("r.status")).alias("status"),
        F.round(F.when(F.col("differs"), F.least(F.col("r.p"), F.lit(0.84))).when(bare, F.least(F.col("r.p"), F.lit(0.59))).otherwise(F.col("r.p")), 3).alias("confidence"), F.coalesce(level > above + 1, F.lit(False)).alias("jump"),
    )


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KIND_SQL = "case type " + " ".join(f"when '{t}' then '{k}'" for t, k in KINDS.items()) + " else 'unknown' end"
_KNOWN_SQL = "case kind when 'unknown' then 0.4 " + " ".join(f"when '{k}' then {v}" for k, v in SURE.items()) + " else 0.95 end"
RANGES_SQL = f"""e0 as (select *, {_KIND_SQL} as kind from ({ELEMENTS})), e as (select *, ({_KNOWN_SQL})::double as known from e0),
d as (select doc_id, max(i) + 1 as n, coalesce((select min(a.i - 1) from e a join e b on a.doc_id = b.doc_id and b.i = a.i - 1 where a.doc_id = e.doc_id and a.kind = 'attachment_title' and b.kind = 'page_break'), max(i) + 1) as att from e group by 1),
sg as (select a.doc_id, max(a.i) as s from e a join d using (doc_id) where a.kind = 'signature_agency' and a.i <= att - 2 and exists (select 1 from e b where b.doc_id = a.doc_id and b.i > a.i and b.i < att and b.kind = 'signature_date' and not exists (select 1 from e m where m.doc_id = a.doc_id and m.i > a.i and m.i < b.i and m.kind <> 'note')) group by 1),
sg2 as (select sg.doc_id, s, (select min(b.i) from e b where b.doc_id = sg.doc_id and b.i > s and b.kind <> 'note') as sd from sg),
r1 as (select d.*, s, case when s is not null then least(coalesce((select min(b.i) from e b where b.doc_id = d.doc_id and b.i > sd and b.kind <> 'note'), n), att) end as se from d left join sg2 using (doc_id)),
r2 as (select *, (select max(b.i) from e b where b.doc_id = r1.doc_id and b.kind = 'attachment_note_item' and b.i < coalesce(s, att)) as nl, (select min(b.i) from e b where b.doc_id = r1.doc_id and b.kind in {_in(FRONT)}) as ff, (select min(b.i) from e b where b.doc_id = r1.doc_id and b.kind = 'letterhead_separator') as fs from r1),
r3 as (select *, case when nl is not null then coalesce((select max(b.i) + 1 from e b where b.doc_id = r2.doc_id and b.i < nl and b.kind <> 'attachment_note_item'), 0) end as ns, case when ff <= 4 and fs is not null and not exists (select 1 from e b where b.doc_id = r2.doc_id and b.i between ff and fs and b.kind not in {_in(FRONT)}) then fs + 1 end as fe from r2),
r4 as (select *, least(coalesce(ns, att), coalesce(s, att), att) as lim from r3),
r5 as (select *, (select min(b.i) from e b where b.doc_id = r4.doc_id and b.kind = 'document_title' and b.i >= coalesce(fe, 0) and b.i < lim) as ts, (select max(b.i) from e b where b.doc_id = r4.doc_id and b.kind = 'document_title' and b.i >= coalesce(fe, 0) and b.i < lim) as tl from r4),
r as (select *, case when ts is not null then least(coalesce((select min(b.i) from e b where b.doc_id = r5.doc_id and b.i > tl and b.kind <> 'title_metadata'), n), greatest(lim, tl + 1)) end as te from r5),
lab as (select e.*, r.n, r.att, r.lim, r.te, r.fe, case when e.i >= att then 'attachment_content' when e.i >= s and e.i < se then 'signature' when e.i between ns and nl then 'attachment_note' when e.i >= ts and e.i < te then 'title' when e.i >= ff and e.i < fe then 'front_matter' end as l from e join r using (doc_id)),
bod as (select doc_id, min(i) as b0, max(i) as b1 from lab where l is null and i >= coalesce(te, fe, 0) and i < lim and kind <> 'page_break' group by 1),
blk as (select lab.*, coalesce(l, case when i between b0 and b1 then 'body' else 'unknown' end) as block, case when i >= att then (select count(*) from e a join e b on b.doc_id = a.doc_id and b.i = a.i + 1 where a.doc_id = lab.doc_id and a.i <= lab.i and a.kind = 'page_break' and b.kind = 'attachment_title') else 0 end as part from lab left join bod using (doc_id)),
isl as (select *, sum(case when block is distinct from pb or part <> coalesce(pp, 0) then 1 else 0 end) over (partition by doc_id order by i) as island from (select *, lag(block) over (partition by doc_id order by i) as pb, lag(part) over (partition by doc_id order by i) as pp from blk)),
rng as (select *, min(known) over (partition by doc_id, island) as block_sure from isl)"""


@query(f"with {RANGES_SQL} select doc_id, island::bigint as island, any_value(block) as block, min(i)::integer as start, (max(i) + 1)::integer as stop, any_value(block_sure) as sure from rng group by 1, 2")
def structure_ranges(spark, sf_dir):
    """Blocks of every document: front matter, title, body, attachment note, signature, attachments and what is in none."""
    r = ranges(elements(spark, sf_dir))
    return r.groupBy("doc_id", "island").agg(F.any_value("block").alias("block"), F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.any_value("block_sure").alias("sure"))


_N = lambda x: f"coalesce({x}, false)"
_FACT_SQL = f"""c0 as (select doc_id, i, type, trim(text) as t, sure, type = '__page_break__' as page, regexp_matches(trim(text), '{DATE}') as dated, length(trim(text)) >= 8 and regexp_matches(trim(text), '[。！？；]$') as sentence, count(*) over (partition by doc_id) as n from ({ELEMENTS})),
c1 as (select *, i / greatest(n - 1, 1)::double as place, t <> '' and length(t) <= 40 and not sentence as short, {", ".join(f"{f}({c}, {k}) over (partition by doc_id order by i) as {a}{k}_{c}" for f, a in (("lag", "b"), ("lead", "f")) for k in (1, 2) for c in ("type", "page", "dated", "sentence"))} from c0),
c2 as (select *, type not in ('__page_break__', '__table__', '__image__', '__object_caption__') and short and place >= 0.35 and coalesce(case when not f1_page then f1_dated when not f2_page then f2_dated end, false) as agency, coalesce(bool_or(page) over (partition by doc_id order by i rows between 1 following and unbounded following), false) as pages from c1),
c3 as (select *, coalesce(lag(agency) over w, false) or coalesce(lag(agency, 2) over w, false) as signed, {_N(f"b1_type in {_in(TITLES)}")} or {_N(f"b2_type in {_in(TITLES)}")} as titled, i <= greatest(4, floor(n * 0.30::double)) as head, place >= 0.65 or (place >= 0.20 and pages) as tl,
  f1_type is null or f1_page or ((f1_type in {_in((*NOTES, 'attachment_page_mark'))} or f1_page) and (f2_type is null or f2_type in {_in((*NOTES, 'attachment_page_mark'))} or f2_page)) as safe,
  (coalesce(not b1_page, false) or coalesce(not f1_page, false)) and (b1_type is null or b1_page or b1_type in {_in(BODIES)} or b1_sentence) and (f1_type is null or f1_page or f1_type in {_in(BODIES)} or f1_sentence) as amid, {_N("f1_type in ('attachment_note_item', 'sign_org', 'sign_date')")} as tail_next from c2 window w as (partition by doc_id order by i)),
ctx as (select *, case when page then 'page_break' when type = '__table__' then 'table' when type = '__image__' then 'figure' when type = '__object_caption__' then 'caption'
  when dated then case when signed and tl and safe and not titled then 'signature_date' when titled and head and not sentence then 'title_metadata' when sentence or amid then 'body_paragraph' else 'unknown' end
  when regexp_matches(t, '{MARK}') then case when {_N('b1_page')} and tl and f1_type is not null then 'attachment_title' else 'unknown' end
  when regexp_matches(t, '{NOTE}') and (tl or (place >= 0.25 and tail_next)) and {_N(f"b1_type in {_in((*BODIES, 'heading1', 'heading2', 'heading3', 'heading4'))}")} and tail_next then 'attachment_note_item' when agency then 'signature_agency'
  when head and titled and type in {_in((*META, 'sign_org'))} and short then 'title_metadata*' when type in {_in(TITLES)} and head and not sentence then 'document_title' {" ".join(f"when type = 'heading{k}' and regexp_matches(t, '{p}') then 'heading_{k}'" for k, p in enumerate(SHAPES, 1))}
  {" ".join(f"when type = '{x}' and not sentence then '{KINDS[x]}*'" for x in ("list", "list_item", "quote", "attachment_note_item", "attachment_title", "note", "annotation"))}
  when sentence then 'body_paragraph*' when type in {_in(BODIES)} then 'body_paragraph**' {" ".join(f"when type = '{x}' then '{KINDS[x]}'" for x in ("lh_mark", "lh_signer", "lh_separator"))} else 'unknown*' end as code from c3),
context as (select *, rtrim(code, '*') as context_kind, (case code when 'page_break' then 0.99 when 'table' then 0.95 when 'figure' then 0.95 when 'caption' then 0.95 when 'signature_date' then 0.95 when 'title_metadata' then 0.90 when 'body_paragraph' then 0.86 when 'unknown' then 0.55 when 'attachment_title' then 0.95 when 'attachment_note_item' then 0.90
  when 'signature_agency' then 0.93 when 'title_metadata*' then 0.88 when 'document_title' then 0.90 when 'body_paragraph*' then 0.88 when 'body_paragraph**' then sure when 'unknown*' then 0.45 else case when code like 'heading%' or code in ('letterhead_mark', 'signer', 'letterhead_separator') then 0.90 else 0.86 end end)::double as context_sure from ctx)"""


@query(f"with {_FACT_SQL} select doc_id, i, context_kind, context_sure from context")
def neighbour_kinds(spark, sf_dir):
    """What each element is by its text, its type, two neighbours on either side and its place in the document."""
    return neighbours(elements(spark, sf_dir)).select("doc_id", "i", "context_kind", "context_sure")


_ALLOWED_SQL = "case block " + " ".join(f"when '{k}' then context_kind in {_in(v)}" for k, v in ALLOWED.items()) + " end"


@query(f"""with {RANGES_SQL}, {_FACT_SQL}, j as (select r.doc_id, r.i, r.block, r.kind, r.block_sure as bs, c.context_kind, c.context_sure as cs, c.code from rng r join context c on r.doc_id = c.doc_id and r.i = c.i), k as (select *, {_ALLOWED_SQL} as allowed from j),
s as (select *, case when allowed and bs >= 0.85 and cs >= 0.85 and context_kind <> 'unknown' then 'confirmed' when not allowed and bs >= 0.85 and cs >= 0.85 then 'conflict' when bs < 0.6 and cs < 0.6 then 'unknown' when allowed and cs >= 0.6 then 'kept' else 'open' end as st from k),
v as (select *, st = 'confirmed' and kind <> context_kind as differs, st = 'confirmed' and kind = context_kind and context_kind = 'attachment_title' and code = 'attachment_title*' as bare, case st when 'confirmed' then least(0.99::double, greatest(bs, cs) + 0.04::double) when 'conflict' then least(bs, cs) when 'unknown' then greatest(bs, cs) when 'kept' then least(cs, 0.84::double) else least(greatest(bs, cs), 0.84::double) end as p,
  case when context_kind like 'heading_%' then right(context_kind, 1)::int end as lv from s),
z as (select *, last_value(lv ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as above from v)
select doc_id, i, block, kind as structure_kind, context_kind, case when bare or st in ('conflict', 'unknown', 'open') then 'unknown' else context_kind end as final_kind, case when differs or bare or st in ('kept', 'open') then 'provisional' else st end as status,
  round(case when differs then least(p, 0.84::double) when bare then least(p, 0.59::double) else p end, 3) as confidence, coalesce(lv > above + 1, false) as jump from z""")
def structure_reconciled(spark, sf_dir):
    """Structure and context of every element reconciled: final kind, status, confidence, and jumps between heading levels."""
    return reconciled(elements(spark, sf_dir))
