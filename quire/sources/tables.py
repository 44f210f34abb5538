"""Table access and the derived inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Event types stand for task states.
STATUS = {"view": "queued", "click": "processing", "purchase": "done", "error": "failed", "signup": "interrupted"}
ERRORS = ("failed", "timeout", "error", "interrupted", "cancelled")
DAILY_ERRORS = ("failed", "timeout", "error")


def status(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in STATUS.items():
        out = F.when(event_type == kind, name).otherwise(out)
    return out


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a task log: id, ip, status, cents as a duration, created_at, seq."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("ip"),
        "event_type",
        status(F.col("event_type")).alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration"),
        F.col("ts").alias("created_at"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("second"),
    )


TASKS_SQL = (
    "select event_id as seq, user_id as ip, event_type, case event_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items())
    + " end as status, cast(round(value * 100) as bigint) as duration, ts as created_at, cast(floor(epoch_us(ts) / 1000000) as bigint) as second from events"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the paragraph stream line(doc_id, pos, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))


LINES_SQL = "select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as pos, unnest(string_split(text, chr(10))) as text from documents"


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived Chinese lines: one order is a document, its lines are headings whose level and number come from the row."""
    from quire.functions.numerals import chinese_integer

    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.min(F.col("l_quantity").cast("int")).alias("qty"))
    level = (F.when(F.col("n") == 1, 1).when(F.col("part") % 5 == 0, 1).when(F.col("part") % 5 == 1, 2).when(F.col("part") % 5 == 2, 3).when(F.col("part") % 5 == 3, 4).otherwise(0)).cast("int")
    number = (F.when(F.col("qty") % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))).cast("int")
    cn = chinese_integer(number)
    text = (
        F.when(level == 1, F.concat(cn, F.lit("、工作事项")))
        .when(level == 2, F.concat(F.lit("（"), cn, F.lit("）重点任务")))
        .when(level == 3, F.concat(number.cast("string"), F.lit("."), F.lit("具体措施")))
        .when(level == 4, F.concat(F.lit("（"), number.cast("string"), F.lit("）细化安排")))
        .otherwise(F.concat(F.lit("各部门要落实"), F.col("qty").cast("string"), F.lit("项工作。")))
    )
    return li.select("doc_id", F.col("n").cast("int").alias("pos"), level.alias("level"), number.alias("number"), text.alias("text"))


_CN = "['一','二','三','四','五','六','七','八','九']"
OUTLINE_SQL = f"""
select doc_id, pos, level, number, case level
    when 1 then {_CN}[number] || '、工作事项' when 2 then '（' || {_CN}[number] || '）重点任务'
    when 3 then number || '.具体措施' when 4 then '（' || number || '）细化安排'
    else '各部门要落实' || qty || '项工作。' end as text
from (
  select doc_id, n as pos, qty,
    cast(case when n = 1 or part % 5 = 0 then 1 when part % 5 = 1 then 2 when part % 5 = 2 then 3 when part % 5 = 3 then 4 else 0 end as integer) as level,
    cast(case when qty % 7 = 0 then n + 1 else n end as integer) as number
  from (
    select l_orderkey as doc_id, l_linenumber as n, min(l_partkey) as part, min(cast(l_quantity as integer)) as qty
    from lineitem group by 1, 2
  )
)
"""
