"""Document context: front region, metadata lines, title scores, where the body starts, and the tail around signatures.

Facts of single paragraphs are columns; what stands before and behind comes from windows over the document's facts, the
text itself is not shuffled. Scores are whole hundredths.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import predicates as P
from quire.operators.segments import MEETING, is_date
from quire.plans.registry import query
from quire.sources.tables import table

# Lists and limits of the context rules.
ROLES = "书记|主任|主席|部长|局长|处长|科长|司长|厅长|市长|县长|区长|镇长|乡长|院长|检察长|校长|政委|组长|队长|秘书长|委员|常委|负责人|经理|总监|工程师|专员|督导员|顾问|总会计师|总经济师|同志|代表"
NO_PERSON = "(?:报告|总结|方案|计划|意见|通知|办法|材料|讲话|发言|纪要|决定|决议|规定|制度|会议|工作|调研|分析|安排|部署|说明|情况)$"
SURNAMES = (
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 "
    "漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 梁丘 左丘 东门 西门 第五"
).split()
NAME = "(?:[一-鿿×X]{2,4}|[一-鿿×X]{1,2}·[一-鿿×X]{1,2})"
JOINS = "、，,/／&兼及和与"
ROLE_END = f"(?:{ROLES})[{JOINS}]*$"
KINDS = r"(?:决议|决定|命令|公报|公告|通告|意见|通知|通报|报告|请示|批复|议案|函|纪要|令|汇报)(?:[（(][^（）()]{1,12}[）)])?$"
SPEECH = r"^(?:[一二三四五六七八九十]+、)?在[一-鿿A-Za-z0-9（）()、，,.·\-]{3,70}上?的?讲话$"
HEAD_START = r"^[（(]?\s*(?:(?:19|20)[0-9]{2}|[零〇○一二两三四五六七八九]{4})\s*年\s*[0-9一二两三四五六七八九十〇○×X]{1,3}\s*月\s*[0-9一二两三四五六七八九十〇○×X]{0,3}\s*(?:日|号)"
TITLE_STYLES = ("title", "标题", "subtitle", "副标题")
HEADING_STYLES = ("heading1", "标题1", "heading2", "标题2", "heading3", "标题3", "heading4", "标题4")
SIGNERS = "(?:委员会|工作委员会|人民政府|人民法院|人民检察院|代表大会|办公室|街道办事处|领导小组|工作组|党组|党委|政府|政协|人大|总工会|专班|小组|集团|公司|协会|学会|商会|医院|学院|学校|大学|研究院|研究所|中心|局|厅|部|院|处|科|办|镇|乡)$"
NO_SIGNER = "^(?:以上|请|现将|特此|有关|此|联系人|联系电话|责任单位)"
SCAN, SOFT, EARLY, REACH = 80, 12, 5, 8
LEAST_TITLE, LEAST_NEXT = 44, 48


def _strength(name: Column) -> Column:
    """strong or weak for what has the shape of a person's name, else null."""
    shaped = name.rlike(f"^{NAME}$") & ~name.rlike(NO_PERSON)
    strong = (F.length(name) <= 3) | name.rlike("[·×X]") | ((F.length(name) == 4) & F.substring(name, 1, 2).isin(SURNAMES))
    return F.when(shaped & strong, "strong").when(shaped, "weak")


def _ends_in_role(line: Column) -> Column:
    """line.rlike(ROLE_END) for a line without white space, by lookups of its last characters: no role ends with a joining mark, so it stands right before them."""
    core = F.when(F.substring(line, -1, 1).isin(*JOINS), F.regexp_replace(line, f"[{JOINS}]+$", "")).otherwise(line)
    of_size = [(n, [r for r in ROLES.split("|") if len(r) == n]) for n in sorted(set(map(len, ROLES.split("|"))))]
    return reduce(or_, (F.substring(core, -n, n).isin(*roles) for n, roles in of_size))


def _role_name(text: Column, compact: Column) -> Column:
    """Strength of the name in a line of a role and a name, null for other lines; a gap decides where the name begins."""
    spaced = rf"^(.*?)[\s　]+({NAME})$"
    own, role = F.regexp_extract(text, spaced, 2), F.regexp_extract(text, spaced, 1)
    tails = [F.when((F.length(compact) > n) & _ends_in_role(F.substr(compact, F.lit(1), F.length(compact) - n)), _strength(F.substring(compact, -n, n))) for n in (5, 4, 3, 2)]
    strong = F.greatest(*[F.coalesce(x == "strong", F.lit(False)) for x in tails])
    return F.when(own != "", F.when(P.strip(role).rlike(ROLE_END), _strength(own))).otherwise(F.when(strong, "strong").otherwise(F.coalesce(*tails)))


def formatted(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with the formats that they lack: not centred, not bold, no size, no style."""
    default = {"centred": F.lit(False), "bold": F.lit(False), "size": F.lit(None).cast("int"), "style": F.lit(None).cast("string")}
    return paragraphs.withColumns({"text": F.coalesce("text", F.lit("")), **{k: v for k, v in default.items() if k not in paragraphs.columns}})


def facts(paragraphs: DataFrame, **more: Column) -> DataFrame:
    """What a paragraph (doc_id, pos, text, centred, bold, size, style) says by itself; more: further facts of text and colon, by name."""
    t, c = P.strip(F.col("text")), F.col("c")
    df = K.with_colon(formatted(paragraphs), "text").withColumn("c", F.regexp_replace(P.compact(F.col("text")), "[​‌‍⁠﻿]", "")).withColumn("n", F.length("c"))
    kind, n = F.col("colon.kind"), F.col("n")
    style = F.lower(P.compact(F.coalesce("style", F.lit(""))))
    df = df.select(
        "doc_id", "pos", "c", "n", t.alias("t"), "centred", "bold", "size", style.isin(*TITLE_STYLES).alias("titled"), style.isin(*HEADING_STYLES).alias("headed"),
        P.dispatch_parts(F.col("text")).isNotNull().alias("dispatch"), is_date(F.col("text")).alias("date"), P.is_attachment_note(c).alias("note"), (kind == "key_value").alias("labelled"), (kind == "addressing").alias("addressed"),
        (kind.isin("recipient_candidate", "body_label") & ~P.is_attachment_note(c)).alias("recipient"), F.coalesce(P.heading_level(t), F.lit(0)).alias("level"), t.rlike("[。！？；]$").alias("ends"),
        P.object_caption(F.col("text")).alias("caption"), c.rlike(MEETING).alias("meeting"), c.rlike(SPEECH).alias("speech"), P.document_title(F.col("text")).alias("shaped"), (c.rlike(HEAD_START) | is_date(F.col("text"))).alias("head_date"), *[v.alias(k) for k, v in more.items()],
    )
    marks = F.col("c").rlike("[：:；;]")
    df = df.withColumn("body", (F.col("c") != "") & ~F.col("dispatch") & ~F.col("date") & (F.col("recipient") | F.col("labelled") | ((F.col("level") == 0) & F.col("ends") & (((n >= 12) & ~F.col("centred")) | (n >= 34)))))
    plain = n.between(4, 60) & ~F.col("dispatch") & ~F.col("date") & ~F.col("labelled") & ~F.col("note") & (F.col("level") == 0) & ~F.col("ends") & ~marks
    anchor = (F.col("c") != "") & ~F.col("dispatch") & ~F.col("recipient") & ~F.col("note") & ~F.col("labelled") & ~F.col("head_date") & ~F.col("body")
    anchor = anchor & (F.col("speech") | F.col("titled") | F.col("shaped") | F.col("centred") | ((n <= 50) & (F.col("level") == 0) & ~F.col("ends")))
    item = F.col("t").rlike(r"^\s*[0-9]{1,2}[.．、]\s*\S+") & ~F.col("labelled")
    own = F.when(F.col("level") == 1, F.regexp_replace(F.col("c"), f"^[{P.CN}]+[、.．]+", "")).otherwise(F.col("c"))
    signer = (own != "") & (n <= 30) & ~F.col("date") & ~F.col("note") & ~F.col("ends") & ~own.rlike("[：:；;。！？]") & ~own.rlike(NO_SIGNER) & own.rlike(SIGNERS)
    name = F.when(~F.col("c").rlike(r"\p{P}"), _strength(F.col("c")))
    return df.select(
        *[x for x in df.columns if x not in ("t", "c")], ((F.col("c") != "") & ~F.col("caption")).alias("item"), (F.col("c") != "").alias("shown"), plain.alias("plain"), (plain & F.col("c").rlike(KINDS) & ~F.col("recipient")).alias("kinded"),
        anchor.alias("anchor"), (F.col("recipient") | F.col("addressed")).alias("greets"), ((F.col("c") != "") & (n <= 42) & ~F.col("ends") & ~marks).alias("eligible"), _role_name(F.col("t"), F.col("c")).alias("role"), name.alias("name"),
        item.alias("listed"), signer.alias("signer"), F.col("c").rlike("^附件[0-9一二三四五六七八九十百千]*$").alias("page"),
    )


def _role(f, before_anchor: Column, before_date: Column, has_before: Column, within: Column) -> Column:
    """Whether a line holds a role or a name of the head; f(name) is a fact of the line."""
    c = lambda x: F.coalesce(x, F.lit(False))
    anchored, beside = c(before_anchor), f("next_meta")
    by_role = ((f("role") == "strong") & (anchored | beside)) | ((f("role") == "weak") & anchored & beside & f("centred"))
    between = has_before & f("has_next") & (anchored | c(before_date)) & beside
    by_name = (f("name") == "strong") | ((f("name") == "weak") & f("centred") & ~f("titled") & ~f("headed"))
    return f("eligible") & c(c(by_role) | (within & f("name").isNotNull()) | (between & c(by_name)))


def with_context(df: DataFrame) -> DataFrame:
    """facts with place, scan, metadata, title_score (hundredths), front, body_start and why regions end."""
    doc = W.partitionBy("doc_id")
    order = doc.orderBy("pos")
    before, behind, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, 0)
    col, no = F.col, F.lit(False)
    c = lambda x: F.coalesce(x, no)
    df = df.withColumns({"i": (F.row_number().over(order) - 1).cast("int"), "nth": F.sum(col("item").cast("int")).over(upto).cast("int") - 1, "count": F.count("*").over(doc)})
    stops = col("item") & (col("nth") > 0) & (col("i") < SCAN) & ((col("body") & ~col("recipient")) | col("note") | col("labelled") | (col("level") > 0))
    df = df.withColumn("stop", F.min(F.when(stops, col("i"))).over(doc))
    df = df.withColumn("scan", col("item") & (col("i") < F.least(F.lit(SCAN), F.coalesce("stop", F.lit(SCAN)))))
    beside = [x for x in ("head_date", "greets", "anchor", "meeting")]
    df = df.withColumns({"prev": F.last(F.when(col("item"), F.struct(*beside)), True).over(before), "next": F.first(F.when(col("item"), F.struct(*beside, "i")), True).over(behind)})
    df = df.withColumns({"has_next": col("next").isNotNull(), "next_meta": c(col("next.head_date") | col("next.greets"))})
    # Title lines of a known kind, and those before prose that a first heading follows.
    body_rank = F.min(F.when(col("item") & col("body") & ~col("recipient") & ~col("labelled"), col("nth"))).over(doc)
    df = df.withColumns({"body_rank": body_rank, "kinded": col("scan") & (col("nth") < EARLY) & col("kinded")})
    heading = F.min(F.when(col("item") & (col("level") > 0) & col("nth").between(col("body_rank") + 1, col("body_rank") + 4), F.struct("nth", "level"))).over(doc)
    df = df.withColumn("leads", c(heading["level"] == 1) & c(col("body_rank").between(1, 3)) & col("item") & c(col("nth") < col("body_rank")) & col("plain") & ~col("greets"))
    anchors = (col("scan") & (col("titled") | col("shaped") | col("speech"))) | col("kinded") | col("leads")
    df = df.withColumns({"first_anchor": F.min(F.when(anchors, col("i"))).over(doc), "first_greet": F.min(F.when(col("scan") & col("greets"), col("i"))).over(doc)})
    closed = col("first_greet").isNotNull() | col("stop").isNotNull()
    df = df.withColumn("within", c(col("first_anchor") < col("i")) & closed & (col("first_greet").isNull() | (col("i") < col("first_greet"))))
    # A date behind a title and before a meeting, and the meeting lines that follow it.
    starts = col("scan") & ~col("dispatch") & ~col("recipient") & c(col("prev.anchor")) & col("head_date") & c(col("next.meeting"))
    df = df.withColumn("starts", starts)
    chain = F.last(F.when(col("item") & ~(col("meeting") & ~col("starts")), col("starts")), True).over(before)
    own = lambda name: col(name)
    role = _role(own, col("prev.anchor"), col("prev.head_date"), col("prev").isNotNull(), col("within"))
    meta = F.when(~col("scan") | col("dispatch") | col("recipient"), None).when(col("starts") | (col("meeting") & c(chain)), "meeting_title_meta").when(col("head_date"), "date_line").when(role, "role_name")
    outside = _role(own, col("prev.anchor"), col("prev.head_date"), col("prev").isNotNull(), no)
    df = df.withColumns({"metadata": meta, "metaline": col("head_date") | outside})
    # What follows among the next four lines of the scan: the first that decides, and the dispatch numbers before it.
    known = ("dispatch", "recipient", "body", "level", "head_date", "eligible", "role", "name", "centred", "titled", "headed", "next_meta", "has_next", "kinded")
    # The scan lies in the first SCAN lines. All windows keep the order by pos: another one would hold a further sort of all rows.
    near = order.rowsBetween(1, SCAN)
    ahead = F.array_compact(F.array(*[F.nth_value(F.when(col("scan"), F.struct(*known)), k, True).over(near) for k in range(1, 5)]))
    df = df.withColumn("ahead", ahead).withColumn("soon", F.exists(F.slice("ahead", 1, 2), lambda x: x["kinded"]))

    def look(acc: Column, x: Column) -> Column:
        told = x["head_date"] | _role(lambda name: x[name], col("anchor"), col("head_date"), F.lit(True), no)
        kind = F.when(x["dispatch"], "dispatch").when(told, "metadata").when(x["recipient"], "recipient").when(x["body"] | (x["level"] > 0), "boundary")
        return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct((acc["dispatches"] + (F.coalesce(kind, F.lit("")) == "dispatch").cast("int")).alias("dispatches"), F.when(kind != "dispatch", kind).alias("end")))

    nothing = F.struct(F.lit(0).alias("dispatches"), F.lit(None).cast("string").alias("end"))
    scored = col("scan") & col("metadata").isNull() & ~col("metaline") & ~col("dispatch") & ~col("recipient") & ~col("note") & ~col("labelled") & ~col("body")
    df = df.withColumn("scored", scored).withColumn("follows", F.when(col("scored"), F.aggregate("ahead", nothing, look)))
    sizes = F.percentile(F.when((col("i") >= 3) & (col("size") > 0), col("size")), 0.5).over(doc)
    df = df.withColumn("body_size", sizes)
    end, dispatches, late = col("follows.end"), col("follows.dispatches"), col("nth") >= SOFT
    add = lambda when, n: F.when(when, n).otherwise(0)
    base = 12 + F.when(col("nth") == 0, 13).when(col("nth") < 5, 8).otherwise(0) + add(col("kinded"), 24) + add(col("soon"), 18) + add(col("leads"), 28) + add(col("centred"), 18) + add(col("shaped"), 16) + add(col("bold"), 7)
    base = base + add(c(col("size") >= col("body_size") + 1), 12) + add(col("titled"), 8)
    base = F.when(col("speech"), F.greatest(base, F.lit(98))).otherwise(base) - add(col("level") > 0, 10)
    base = base + 14 * dispatches + F.when(end == "metadata", 20).when(end == "recipient", 14 + add(col("nth") < 3, 14)).when(end == "boundary", 10).otherwise(0)
    strong = (dispatches > 0) | c(end.isin("metadata", "recipient")) | col("speech")
    base = base - add(late & ~strong, 20)
    scored = col("scored")
    df = df.withColumn("title_score", F.when(scored, F.greatest(F.lit(0), F.least(F.lit(99), base))).otherwise(0).cast("int"))
    supported = (col("nth") == 0) | col("soon") | col("leads") | (dispatches > 0) | end.isNotNull() | col("speech")
    df = df.withColumn("first_title", F.min(F.when(scored & (col("title_score") >= LEAST_TITLE) & supported, col("i"))).over(doc))
    goes = col("metaline") | (col("title_score") >= LEAST_NEXT)
    behind_title = col("scan") & c(col("i") > col("first_title"))
    df = df.withColumn("front_end", F.min(F.when(behind_title & ~goes, col("i"))).over(doc))
    inside = behind_title & goes & (col("front_end").isNull() | (col("i") < col("front_end")))
    df = df.withColumn("front", c(col("i") == col("first_title")) | inside | (behind_title & c(col("i") == col("front_end")) & col("recipient")))
    greeted = F.max(F.when(col("front") & col("recipient"), col("i"))).over(doc)
    df = df.withColumns({"greeted": greeted, "last_front": F.max(F.when(col("front"), col("i"))).over(doc)})
    next_item = F.min(F.when(col("item") & (col("i") > col("greeted")), col("i"))).over(doc)
    looks = (col("i") > F.coalesce("last_front", F.lit(-1))) & col("shown")
    found = F.when(col("recipient"), F.struct("i", F.when(col("i") + 1 < col("count"), col("i") + 1).otherwise(col("i")).alias("at"), F.when(col("i") + 1 < col("count"), "recipient-following-body").otherwise("recipient").alias("why")))
    found = found.when(col("body"), F.struct("i", col("i").alias("at"), F.lit("body-paragraph").alias("why"))).when((col("level") > 0) & (col("last_front").isNotNull() | (col("i") > 0)), F.struct("i", col("i").alias("at"), F.lit("numbered-heading-after-front").alias("why")))
    df = df.withColumns({"boundary": F.min(F.when(looks, found)).over(doc), "next_item": next_item})
    start = F.when(col("greeted").isNotNull(), F.coalesce("next_item", F.least(col("greeted") + 1, col("count") - 1))).otherwise(F.coalesce("boundary.at", F.when(col("last_front").isNull(), 0)))
    why = F.when(col("greeted").isNotNull(), "recipient-following-body").otherwise(F.coalesce("boundary.why", F.when(col("last_front").isNull(), "no-front-matter").otherwise("no-body-boundary")))
    reason = F.when(col("stop").isNotNull(), "body-boundary").when(col("count") > SCAN, "physical-safety-cap").otherwise("document-end")
    df = df.withColumns({"body_start": start.cast("int"), "body_reason": why, "scan_reason": reason})
    return df.withColumn("before_body", col("body_start").isNull() | (col("i") < col("body_start"))).drop("prev", "next", "ahead", "follows", "scored")


def with_tail(df: DataFrame) -> DataFrame:
    """with_context's rows with signature: why an organization or a date belongs to the tail, null where it does not."""
    order = W.partitionBy("doc_id").orderBy("pos")
    col = F.col
    dated = col("date") | col("head_date")
    df = df.withColumn("dated", dated).withColumn("bridge", col("note") | col("listed") | col("dated") | col("signer"))
    body = (col("i") >= col("body_start")) & (col("body") | (col("level") > 0))
    df = df.withColumn("has_body", F.coalesce(F.max(body.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)) == 1, F.lit(False)))
    near = F.struct("dated", "signer", "bridge", "page", "note", "n")
    df = df.withColumns({"ahead": F.collect_list(near).over(order.rowsBetween(1, REACH)), "back": F.reverse(F.collect_list(near).over(order.rowsBetween(-REACH, -1)))})

    def reached(side: str, what) -> Column:
        """Whether what is met before the bridge of tail lines breaks; a note must say something."""
        zero = F.struct(F.lit(True).alias("open"), F.lit(False).alias("hit"))
        return F.aggregate(side, zero, lambda acc, x: F.struct((acc["open"] & x["bridge"]).alias("open"), (acc["hit"] | (acc["open"] & what(x))).alias("hit")))["hit"]

    date_side = F.when(reached("ahead", lambda x: x["dated"]), "following-date").when(reached("back", lambda x: x["dated"]), "previous-date")
    org_side = F.when(reached("back", lambda x: x["signer"]), "previous-signature-org").when(reached("ahead", lambda x: x["signer"]), "following-signature-org")
    last = F.coalesce(F.max(F.when(col("item"), col("i"))).over(W.partitionBy("doc_id")) == col("i"), F.lit(False))
    supports = F.last(F.when(col("item"), F.struct(~col("labelled") & (col("body") | (col("level") > 0) | col("note") | col("listed")))), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumns({"date_side": date_side, "org_side": org_side, "tail_date": last & F.coalesce(supports["col1"], F.lit(False)), "page_side": ~last & reached("ahead", lambda x: x["page"])})
    why = F.when(~col("has_body"), None).when(col("signer") & col("date_side").isNotNull(), col("date_side"))
    why = why.when(col("dated"), F.coalesce("org_side", F.when(col("tail_date"), "document-tail-date"), F.when(col("page_side"), "following-attachment-page")))
    return df.withColumn("signature", why).drop("ahead", "back")


# Derived heads and tails: which line stands where depends on the keys.
HEADS = (
    "'关于开展' || q || '项工作的报告'", "'某某市人民政府'", "'内政发〔2024〕' || q || '号'", "'（2024年3月' || (q % 28 + 1) || '日）'", "'在全市工作会议上'", "'市长  张某某'", "'李四'", "'各位代表：'",
    "'各县区人民政府：'", "'在全市会议上的讲话'", "'图' || q || ' 结构'", "''", "'工作会议材料'", "'时间：上午' || q || '时'", "'司马相如'", "'王小二子'", "'县委书记王五'", "'年度总结'",
)
BODIES = (
    "'一、总体要求'", "'（二）重点任务'", "q || '.具体措施'", "'各部门要认真落实' || q || '项任务，按时完成。'", "'附件：1.工作方案'", "'2.任务清单'", "'某某市财政局'", "'2024年3月' || (q % 28 + 1) || '日'",
    "'附件 二'", "'会议强调加强领导'", "'二〇二四年三月五日'", "'三、主要任务'", "''",
)
_PLACES = "select o_custkey as doc_id, cast(o_orderkey as bigint) as pos, row_number() over (partition by o_custkey order by o_orderkey) - 1 as nth, cast(o_orderkey % 97 as int) as q from orders"
_AT = f"case when nth < 2 + doc_id % 5 then (doc_id * 5 + nth * (doc_id % 3 + 1) + q % 2) % {len(HEADS)} else {len(HEADS)} + (pos + nth * 3) % {len(BODIES)} end"
LINES = (
    "select doc_id, pos, case k " + " ".join(f"when {i} then {x}" for i, x in enumerate((*HEADS, *BODIES))) + " end as text, q % 3 = 0 and nth < 5 as centred, q % 4 = 0 as bold, case when q % 11 <> 0 then 14 + q % 5 end as size, "
    f"case q % 9 when 0 then 'Title' when 1 then '标题 1' when 2 then '副标题' else 'Normal' end as style from (select *, {_AT} as k from ({_PLACES}) a) b"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text, centred, bold, size, style): the orders of a customer are the lines of a document."""
    return spark.sql(LINES.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def _shape_sql(x: str) -> str:
    shaped = f"regexp_matches({x}, '^{NAME}$') and not regexp_matches({x}, '{NO_PERSON}')"
    return f"case when {shaped} and (length({x}) <= 3 or regexp_matches({x}, '[·×X]') or (length({x}) = 4 and left({x}, 2) in {tuple(SURNAMES)})) then 'strong' when {shaped} then 'weak' end"


def _role_sql(f: str, anchor: str, date: str, has_before: str, within: str) -> str:
    name = f"({f}name = 'strong' or ({f}name = 'weak' and {f}centred and not {f}titled and not {f}headed))"
    return f"({f}eligible and coalesce(coalesce(({f}role = 'strong' and ({anchor} or {f}next_meta)) or ({f}role = 'weak' and {anchor} and {f}next_meta and {f}centred), false) or ({within} and {f}name is not null) or ({has_before} and {f}has_next and ({anchor} or {date}) and {f}next_meta and coalesce({name}, false)), false))"


_M = lambda p, x="c": f"regexp_matches({x}, '{p}')"
_TAILS = [f"case when length(c) > {n} and {_M(ROLE_END, f'left(c, length(c) - {n})')} then {_shape_sql(f'right(c, {n})')} end" for n in (5, 4, 3, 2)]
_SPACED = rf"^(.*?)[\s　]+({NAME})$"
_FACTS_SQL = rf"""raw as (select *, trim(text) as t, regexp_replace(text, '\s', '', 'g') as c, lower(regexp_replace(coalesce(style, ''), '\s', '', 'g')) as st from ({LINES})),
f0 as (select *, length(c) as n, {_M(K.ADDRESSING)} as addressed, {_M('^时间：.+')} as labelled, {_M('^附件[:：]')} as note, {_M('^[一-鿿A-Za-z0-9、，,（）()]{2,40}：$')} and not {_M(K.ADDRESSING)} and not {_M('^附件[:：]')} as recipient,
  {_M(r'^[一-鿿A-Za-z0-9]{0,16}[〔\[][0-9]{4}[〕\]][0-9]+号$')} as dispatch, {_M(P.sign_date_pattern(), 'text')} as date, case when {_M(f'^[{P.CN}]+[、.．]+', 't')} then 1 when {_M(f'^[（(][{P.CN}]+[）)]', 't')} then 2 when {_M('^[0-9]+[.．]', 't')} then 3 when {_M('^[（(][0-9]+[）)]', 't')} then 4 else 0 end as level,
  {_M('[。！？；]$', 't')} as ends, {_M('^[图表][0-9]+')} as caption, {_M(MEETING)} as meeting, {_M(SPEECH)} as speech, length(t) between 4 and 60 and {_M('(' + '|'.join(P.TITLE_SUFFIXES) + ')$', 't')} and not {_M('[。；：:，,]', 't')} as shaped, {_M(HEAD_START)} or {_M(P.sign_date_pattern(), 'text')} as head_date,
  st in {TITLE_STYLES} as titled, st in {HEADING_STYLES} as headed, {_M('[：:；;]')} as marks from raw),
f1 as (select *, c <> '' and not dispatch and not date and (recipient or labelled or (level = 0 and ends and ((n >= 12 and not centred) or n >= 34))) as body, n between 4 and 60 and not dispatch and not date and not labelled and not note and level = 0 and not ends and not marks as plain,
  case when level = 1 then regexp_replace(c, '^[{P.CN}]+[、.．]+', '') else c end as own from f0),
facts as (select * exclude (body), body, c <> '' and not caption as item, c <> '' as shown, plain and {_M(KINDS)} and not recipient as kind_end, c <> '' and not dispatch and not recipient and not note and not labelled and not head_date and not body and (speech or titled or shaped or centred or (n <= 50 and level = 0 and not ends)) as anchor,
  recipient or addressed as greets, c <> '' and n <= 42 and not ends and not marks as eligible, case when regexp_extract(t, '{_SPACED}', 2) <> '' then case when {_M(ROLE_END, f"trim(regexp_extract(t, '{_SPACED}', 1))")} then {_shape_sql(f"regexp_extract(t, '{_SPACED}', 2)")} end
    when {' or '.join(f"coalesce(({x}) = 'strong', false)" for x in _TAILS)} then 'strong' else coalesce({', '.join(_TAILS)}) end as role, case when not {_M(chr(92) + 'p{P}')} then {_shape_sql('c')} end as name,
  {_M(r'^\s*[0-9]{1,2}[.．、]\s*\S+', 't')} and not labelled as listed, own <> '' and n <= 30 and not date and not note and not ends and not {_M('[：:；;。！？]', 'own')} and not {_M(NO_SIGNER, 'own')} and {_M(SIGNERS, 'own')} as signer, {_M('^附件[0-9一二三四五六七八九十百千]*$')} as page from f1)"""
_O = "partition by doc_id order by pos"
CONTEXT_SQL = rf"""{_FACTS_SQL},
c0 as (select *, row_number() over ({_O}) - 1 as i, sum(item::integer) over ({_O}) - 1 as nth, count(*) over (partition by doc_id) as cnt from facts),
c1 as (select *, min(case when item and nth > 0 and i < {SCAN} and ((body and not recipient) or note or labelled or level > 0) then i end) over (partition by doc_id) as stop from c0),
c2 as (select *, item and i < least({SCAN}, coalesce(stop, {SCAN})) as scan, last_value(case when item then struct_pack(head_date := head_date, anchor := anchor) end ignore nulls) over ({_O} rows between unbounded preceding and 1 preceding) as prv,
  first_value(case when item then struct_pack(head_date := head_date, greets := greets, meeting := meeting) end ignore nulls) over ({_O} rows between 1 following and unbounded following) as nxt, min(case when item and body and not recipient and not labelled then nth end) over (partition by doc_id) as body_rank from c1),
c3 as (select *, nxt is not null as has_next, coalesce(nxt.head_date or nxt.greets, false) as next_meta, scan and nth < {EARLY} and kind_end as kinded, arg_min(level, nth) filter (where item and level > 0 and nth between body_rank + 1 and body_rank + 4) over (partition by doc_id) as first_level from c2),
c4 as (select *, coalesce(first_level = 1 and body_rank between 1 and 3 and item and nth < body_rank and plain and not greets, false) as leads, scan and not dispatch and not recipient and coalesce(prv.anchor, false) and head_date and coalesce(nxt.meeting, false) as starts from c3),
c5 as (select *, min(case when (scan and (titled or shaped or speech)) or kinded or leads then i end) over (partition by doc_id) as first_anchor, min(case when scan and greets then i end) over (partition by doc_id) as first_greet,
  last_value(case when item and not (meeting and not starts) then starts end ignore nulls) over ({_O} rows between unbounded preceding and 1 preceding) as chain from c4),
c6 as (select *, coalesce(first_anchor < i, false) and (first_greet is not null or stop is not null) and (first_greet is null or i < first_greet) as within from c5),
c7 as (select *, case when not scan or dispatch or recipient then null when starts or (meeting and coalesce(chain, false)) then 'meeting_title_meta' when head_date then 'date_line' when {_role_sql('', 'coalesce(prv.anchor, false)', 'coalesce(prv.head_date, false)', 'prv is not null', 'within')} then 'role_name' end as metadata,
  head_date or {_role_sql('', 'coalesce(prv.anchor, false)', 'coalesce(prv.head_date, false)', 'prv is not null', 'false')} as metaline, median(case when i >= 3 and size > 0 then size end) over (partition by doc_id) as body_size from c6),
look as (select a.doc_id, a.pos, x.nth - a.nth as d, x.kinded, case when x.dispatch then 'dispatch' when x.head_date or {_role_sql('x.', 'a.anchor', 'a.head_date', 'true', 'false')} then 'metadata' when x.recipient then 'recipient' when x.body or x.level > 0 then 'boundary' end as what from c7 a join c7 x on a.doc_id = x.doc_id and a.scan and x.scan and x.nth between a.nth + 1 and a.nth + 4),
ended as (select doc_id, pos, bool_or(kinded and d <= 2) as soon, min(case when what <> 'dispatch' then d end) as last from look group by 1, 2),
follow as (select e.doc_id, e.pos, any_value(e.soon) as soon, max(case when l.d = e.last then l.what end) as stop_kind, count(*) filter (where l.what = 'dispatch' and l.d < coalesce(e.last, 9)) as dispatches from ended e join look l on e.doc_id = l.doc_id and e.pos = l.pos group by 1, 2),
c8 as (select c7.*, coalesce(soon, false) as soon, stop_kind, coalesce(dispatches, 0) as dispatches from c7 left join follow w on c7.doc_id = w.doc_id and c7.pos = w.pos),
c9 as (select *, scan and metadata is null and not metaline and not dispatch and not recipient and not note and not labelled and not body as scored,
  12 + case when nth = 0 then 13 when nth < 5 then 8 else 0 end + 24 * kinded::int + 18 * soon::int + 28 * leads::int + 18 * centred::int + 16 * shaped::int + 7 * bold::int + 12 * coalesce(size >= body_size + 1, false)::int + 8 * titled::int as base,
  dispatches > 0 or coalesce(stop_kind in ('metadata', 'recipient'), false) or speech as strong from c8),
c10 as (select *, case when scored then greatest(0, least(99, case when speech then greatest(base, 98) else base end - 10 * (level > 0)::int + 14 * dispatches + case stop_kind when 'metadata' then 20 when 'recipient' then 14 + 14 * (nth < 3)::int when 'boundary' then 10 else 0 end - 20 * (nth >= {SOFT} and not strong)::int)) else 0 end::integer as title_score from c9),
c11 as (select *, min(case when scored and title_score >= {LEAST_TITLE} and (nth = 0 or soon or leads or dispatches > 0 or stop_kind is not null or speech) then i end) over (partition by doc_id) as first_title from c10),
c12 as (select *, scan and coalesce(i > first_title, false) as behind, metaline or title_score >= {LEAST_NEXT} as goes from c11),
c13 as (select *, min(case when behind and not goes then i end) over (partition by doc_id) as front_end from c12),
c14 as (select *, coalesce(i = first_title, false) or (behind and goes and (front_end is null or i < front_end)) or (behind and coalesce(i = front_end, false) and recipient) as front from c13),
c15 as (select *, max(case when front and recipient then i end) over (partition by doc_id) as greeted, max(case when front then i end) over (partition by doc_id) as last_front from c14),
c16 as (select *, min(case when item and i > greeted then i end) over (partition by doc_id) as next_item, min(case when shown and i > coalesce(last_front, -1) and (recipient or body or (level > 0 and (last_front is not null or i > 0))) then i end) over (partition by doc_id) as boundary from c15),
c17 as (select *, max(case when i = boundary then case when recipient and i + 1 < cnt then i + 1 else i end end) over (partition by doc_id) as boundary_at, max(case when i = boundary then case when recipient then case when i + 1 < cnt then 'recipient-following-body' else 'recipient' end when body then 'body-paragraph' else 'numbered-heading-after-front' end end) over (partition by doc_id) as boundary_why from c16),
ctx as (select *, (case when greeted is not null then coalesce(next_item, least(greeted + 1, cnt - 1)) else coalesce(boundary_at, case when last_front is null then 0 end) end)::integer as body_start,
  case when greeted is not null then 'recipient-following-body' else coalesce(boundary_why, case when last_front is null then 'no-front-matter' else 'no-body-boundary' end) end as body_reason, case when stop is not null then 'body-boundary' when cnt > {SCAN} then 'physical-safety-cap' else 'document-end' end as scan_reason from c17)"""


@query(f"with {CONTEXT_SQL} select doc_id, pos, scan, metadata, title_score, front, body_start is null or i < body_start as before_body from ctx")
def document_context(spark, sf_dir):
    """Per line: whether the front scan reaches it, what metadata of the head it is, its title score in hundredths, whether it belongs to the front, and whether it stands before the body."""
    return with_context(facts(lines(spark, sf_dir))).select("doc_id", "pos", "scan", "metadata", "title_score", "front", "before_body")


@query(f"with {CONTEXT_SQL} select doc_id, count_if(front)::bigint as front, any_value(scan_reason) as scan_reason, count_if(scan) + any_value(stop is not null)::int > {SOFT} as beyond_soft, any_value(body_start) as body_start, any_value(body_reason) as body_reason, max(title_score) as best_title from ctx group by 1")
def context_boundaries(spark, sf_dir):
    """Per document: lines of the front, why the scan ends, where the body starts and why, and the best title score."""
    c = with_context(facts(lines(spark, sf_dir)))
    any_ = lambda x: F.any_value(x).alias(x)
    beyond = F.count_if("scan") + F.any_value(F.col("stop").isNotNull()).cast("int") > SOFT
    return c.groupBy("doc_id").agg(F.count_if("front").alias("front"), any_("scan_reason"), beyond.alias("beyond_soft"), any_("body_start"), any_("body_reason"), F.max("title_score").alias("best_title"))


def _reach_sql(what: str, ahead: bool) -> str:
    """Whether a line of the kind is met within reach before the bridge breaks."""
    side = "x.i between a.i + 1 and a.i + 8" if ahead else "x.i between a.i - 8 and a.i - 1"
    gap = "y.i > a.i and y.i < x.i" if ahead else "y.i < a.i and y.i > x.i"
    return f"exists (select 1 from tailed x where x.doc_id = a.doc_id and {side} and x.{what} and not exists (select 1 from tailed y where y.doc_id = a.doc_id and {gap} and not y.bridge))"


@query(f"""with {CONTEXT_SQL}, tailed as (select *, date or head_date as dated, note or listed or date or head_date or signer as bridge, coalesce(bool_or(i >= body_start and (body or level > 0)) over ({_O} rows between unbounded preceding and 1 preceding), false) as has_body, i = max(case when item then i end) over (partition by doc_id) as last,
  last_value(case when item then not labelled and (body or level > 0 or note or listed) end ignore nulls) over ({_O} rows between unbounded preceding and 1 preceding) as supports from ctx),
w as (select a.doc_id, a.pos, case when a.signer and {_reach_sql('dated', True)} then 'following-date' when a.signer and {_reach_sql('dated', False)} then 'previous-date' when not a.dated then null
  when {_reach_sql('signer', False)} then 'previous-signature-org' when {_reach_sql('signer', True)} then 'following-signature-org' when coalesce(a.last, false) and coalesce(a.supports, false) then 'document-tail-date' when not coalesce(a.last, false) and {_reach_sql('page', True)} then 'following-attachment-page' end as signature from tailed a where a.has_body and (a.signer or a.dated))
select * from w where signature is not null""")
def signature_context(spark, sf_dir):
    """Organizations and dates of a document's tail and why they belong to it: what stands near, across nothing but lines of a tail."""
    return with_tail(with_context(facts(lines(spark, sf_dir)))).where("signature is not null").select("doc_id", "pos", "signature")
