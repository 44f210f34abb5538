"""Edits across the text nodes of a paragraph: found on the joined text, spliced into the nodes by prefix sums of their lengths.

An edit may span nodes; its new text lands in the node where it starts, the rest of what it covers goes from the others. Nodes under
a link, a drawing or the like are no part of the text, and paragraphs with fields or outside the scope stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.spans import PARAGRAPHS, RUNS, piece, spots
from quire.plans.registry import query
from quire.sources.tables import table

NODE = "struct<place:int,text:string,safe:boolean>"
CHANGES = (("各部门要", "各有关单位要"), ("工作", "任务"), ("。", "；"), ("落实", ""), ("2024年3月", "二〇二四年三月"))
SCOPE = {"body": True, "tables": False, "headers": True, "footers": False}


def in_scope(part: Column, in_table: Column, field: Column, body: bool = True, tables: bool = False, headers: bool = False, footers: bool = False) -> Column:
    """Whether a paragraph may be edited: by its part, by whether it stands in a table, never with a field."""
    document = F.when(in_table, F.lit(tables)).otherwise(F.lit(body))
    # Outside the main part a table counts only with tables switched on.
    beside = lambda on: F.lit(on) & (~in_table | F.lit(tables))
    return ~field & F.when(part == "document", document).when(part == "header", beside(headers)).when(part == "footer", beside(footers)).otherwise(False)


def matches(text: Column, changes) -> Column:
    """Sorted array of struct(start, end, new): where each text of changes (old, new) stands; the old ones do not overlap."""
    found = []
    for old, new in changes:
        found.append(F.transform(spots(text, old), lambda i: F.struct(i.cast("int").alias("start"), (i + len(old)).cast("int").alias("end"), F.lit(new).alias("new"))))
    return F.array_sort(F.concat(*found))


def placed(nodes: Column) -> Column:
    """array of struct(place, text, start, end) of the safe nodes, with their places in the joined text."""
    safe = F.filter(nodes, lambda x: x["safe"])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:int,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = (acc["at"] + F.length(x["text"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["place"].alias("place"), x["text"].alias("text"), acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(safe, zero, step)["out"]


def spliced(node: Column, edits: Column) -> Column:
    """The text of a placed node after all edits of the joined text (sorted, apart from each other, none empty)."""
    a, b, text = node["start"], node["end"], node["text"]
    own = F.filter(edits, lambda e: (e["start"] < b) & (e["end"] > a))
    zero = F.struct(a.alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kept = piece(text, acc["at"] - a, F.greatest(e["start"], a) - a)
        return F.struct(F.least(e["end"], b).alias("at"), F.concat(acc["out"], kept, F.when(e["start"] >= a, e["new"]).otherwise("")).alias("out"))

    rest = lambda done: F.concat(done["out"], piece(text, done["at"] - a, b - a))
    return F.aggregate(own, zero, step, rest)


def with_edits(paragraphs: DataFrame, edits, **scope: bool) -> DataFrame:
    """paragraphs (part, in_table, field, nodes) with placed nodes, their joined text and edits(joined text); each step is a column of its own."""
    df = paragraphs.withColumn("chosen", in_scope(F.col("part"), F.col("in_table"), F.col("field"), **scope)).withColumn("placed", placed(F.col("nodes")))
    df = df.withColumn("before", F.array_join(F.transform("placed", lambda x: x["text"]), ""))
    return df.withColumn("edits", F.when(F.col("chosen"), edits(F.col("before"))).otherwise(F.array().cast("array<struct<start:int,end:int,new:string>>")))


_PART = "case doc_id % 5 when 0 then 'header' when 1 then 'footer' else 'document' end"
_SAFE = [f"(s + {i}) % 7 <> 0" for i in range(len(RUNS))]


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived paragraphs as three nodes each, some under a link, some with a field, some in tables, headers and footers."""
    p = spark.sql(PARAGRAPHS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    node = lambda i, r: F.struct(F.lit(i).alias("place"), piece(F.col("text"), F.expr(f"cast({r['start']} as int)"), F.expr(f"cast({r['end']} as int)")).alias("text"), F.expr(_SAFE[i]).alias("safe"))
    return p.select("doc_id", "para", F.expr(_PART).alias("part"), (F.col("para") % 3 == 0).alias("in_table"), (F.col("s") % 13 == 0).alias("field"), F.array(*[node(i, r) for i, r in enumerate(RUNS)]).alias("nodes"))


def _replaced(x: str) -> str:
    for old, new in CHANGES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_ROPE_SQL = f"""p as (select doc_id, para, {_PART} as part, para % 3 = 0 as in_table, s % 13 = 0 as field, text, s, cut, cut2 from ({PARAGRAPHS})),
node as ({" union all ".join(f"select doc_id, para, {i} as place, substr(text, ({r['start']})::bigint + 1, ({r['end']})::bigint - ({r['start']})::bigint) as text from p where {_SAFE[i]}" for i, r in enumerate(RUNS))}),
spot as (select *, (sum(length(text)) over (partition by doc_id, para order by place) - length(text))::bigint as a from node),
joined as (select p.doc_id, p.para, p.part, p.in_table, not field and case part when 'document' then not in_table when 'header' then not in_table else false end as chosen, coalesce(string_agg(a.text, '' order by a.place), '') as before from p left join spot a using (doc_id, para) group by all),
ch as (select doc_id, para, unnest(range(length(before))) as i, before from joined where chosen and before <> ''),
edit as (select doc_id, para, i, length(old) as n, new from ch join (values {', '.join(f"('{a}', '{b}')" for a, b in CHANGES)}) v(old, new) on substr(before, i + 1, length(old)) = old)"""


@query(f"with {_ROPE_SQL} select doc_id, para, part, chosen, before, case when chosen then {_replaced('before')} else before end as after, (select count(*) from edit e where e.doc_id = joined.doc_id and e.para = joined.para) as edits from joined")
def rope_paragraphs(spark, sf_dir):
    """Joined texts before and after edits that were made node by node: the same as editing the joined text."""
    p = with_edits(paragraphs(spark, sf_dir), lambda t: matches(t, CHANGES), **SCOPE)
    after = F.array_join(F.transform("placed", lambda x: spliced(x, F.col("edits"))), "")
    return p.select("doc_id", "para", "part", "chosen", "before", after.alias("after"), F.size("edits").cast("bigint").alias("edits"))


@query(f"""with {_ROPE_SQL}, letter as (select a.doc_id, a.para, a.place, a.a + k as i, substr(a.text, k + 1, 1) as c from spot a, unnest(range(length(a.text))) u(k)),
kept as (select l.*, e.new, e.i is not null as starts, exists (select 1 from edit x where x.doc_id = l.doc_id and x.para = l.para and l.i >= x.i and l.i < x.i + x.n) as covered from letter l left join edit e on e.doc_id = l.doc_id and e.para = l.para and e.i = l.i),
told as (select doc_id, para, place, string_agg(case when starts then new when covered then '' else c end, '' order by i) as text from kept group by 1, 2, 3)
select a.doc_id, a.para, a.place, coalesce(t.text, '') as text, coalesce(t.text, '') <> a.text as changed from spot a left join told t on a.doc_id = t.doc_id and a.para = t.para and a.place = t.place""")
def rope_nodes(spark, sf_dir):
    """Every text node after the edits: what starts in it lands in it, what an earlier node's edit covers is gone."""
    p = with_edits(paragraphs(spark, sf_dir), lambda t: matches(t, CHANGES), **SCOPE)
    rows = p.select("doc_id", "para", "edits", F.explode("placed").alias("x"))
    return rows.select("doc_id", "para", "x.place", spliced(F.col("x"), F.col("edits")).alias("text"), F.col("x.text").alias("old")).select("doc_id", "para", "place", "text", (F.col("text") != F.col("old")).alias("changed"))
