"""Derived typed paragraphs: the lines of Chinese office documents that the test tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table

# (type, text); the first six never end a front region.
PHRASES = (
    ("title", "关于开展专项工作的报告"), ("title", "某某市人民政府"), ("dispatch", "内政发〔2024〕15号"), ("date_line", "（2024年3月5日）"), ("title", "工作会议材料"), ("object_caption", "图1 结构"),
    ("heading1", "一、总体要求"), ("heading1", "二、总体要求。各部门要认真落实各项任务。"), ("heading2", "（三）重点任务"), ("heading2", "（四）重点任务。各单位要按照分工抓好落实。"), ("heading3", "5.具体措施"), ("heading3", "12、细化安排。"),
    ("heading4", "（6）细化安排"), ("heading4", "⑦ 补充说明"), ("heading1", "十五、3月5日前完成"), ("heading1", "二十三、"), ("law", "第三条 各部门应当遵守规定"), ("date_line", "2024年3月5日"),
    ("body", "各部门要认真落实,按时完成各项工作任务:确保取得实效。"), ("body", "会议强调要加强领导"), ("addressing", "各位代表："), ("key_value", "时间：上午九时"), ("responsibility_line", "“责 任 单 位：综合部 责任单位:财务部”"), ("responsibility_line", "责任单位：综合部"),
    ("sign_org", "一、某某市人民政府"), ("sign_org", "某某市财政局"), ("sign_date", "二〇二四年三月五日"), ("attachment_note", "附件：1.工作方案"), ("attachment_note", "附件：工作方案"), ("attachment_note_item", "2.任务清单"),
    ("attachment_page_mark", "附件 十二"), ("attachment_page_mark", "附件3"), ("attachment_page_mark", "附件"), ("attachment_title", "任务清单"), ("chapter", "第三章 总则"), ("chapter", "  Chapter 12 Notes"),
    ("table", "姓名	职务"), ("image", ""), ("object_caption", "表2 任务分解"), ("heading2", "@lvl_2:具体安排"), ("body", "、残留标记的正文"), ("heading1", "三、主要原因：一是认识不足。二是措施不力，落实不够。"),
)
CALM = 6

PHRASES_SQL = (
    "select doc_id, pos, p.type as type, p.text as text from (select doc_id, pos, ["
    + ", ".join(f"{{'type': '{t}', 'text': '{x}'}}" for t, x in PHRASES)
    + f"][case doc_id % 3 when 0 then pos % {CALM} when 1 then nth % {len(PHRASES)} else pos % {len(PHRASES)} end + 1] as p "
    + "from (select o_custkey // 8 as doc_id, o_orderkey as pos, row_number() over (partition by o_custkey // 8 order by o_orderkey) - 1 as nth from orders))"
)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, type, text): eight customers make a document, each order gives one of the phrases; one document in three has none but front lines, one has the phrases in their order here."""
    known = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text")) for t, x in PHRASES])
    pos, n = F.col("pos"), len(PHRASES)
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("pos"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    k = F.when(F.col("doc_id") % 3 == 0, pos % CALM).when(F.col("doc_id") % 3 == 1, nth % n).otherwise(pos % n)
    p = o.select("doc_id", "pos", F.get(known, k.cast("int")).alias("p"))
    return p.select("doc_id", "pos", "p.type", "p.text")
