"""Operators whose result depends on order: limiters, tails, repaired numbers, decoded types.

A document or a key is sorted once and folded; folds over unbounded keys stream
through a sorted partition with constant state instead of holding a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import predicates as P
from quire.operators.grouped import per_document
from quire.plans.registry import query
from quire.sources.tables import OUTLINE_SQL, outline, table, tasks


def fold_sorted(df: DataFrame, key: str, order: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Fold rows of each key in order; step(state, row) returns (state, output values). Only one state is held.

    The input needs key and order columns only once sorted; the output has the input's columns and then the step's.
    """
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            out = []
            for row in rows:
                if first or row[at] != now:
                    now, state, first = row[at], start(), False
                state, values = step(state, row)
                out.append(values)
            extra = list(zip(*out)) if out else [()] * (schema.count(",") + 1)
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
            types = [kinds[x.split()[1]] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, t) for v, t in zip(extra, types)]], [*columns, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{own}, {schema}")


def cooldown(df: DataFrame, window: int, key: str = "ip", time: str = "second", order: str = "seq") -> DataFrame:
    """allowed: at least window since the last allowed one; a refusal changes nothing."""
    data = df.select(key, time, order)

    def step(last, row):
        allowed = last is None or row[1] - last >= window
        return (row[1] if allowed else last), (allowed,)

    return fold_sorted(data, key, order, lambda: None, step, "allowed boolean")


def sliding_log(df: DataFrame, window: int, limit: int, key: str = "ip", time: str = "second", order: str = "seq") -> DataFrame:
    """allowed and retry_after: at most limit allowed ones in a window; refused stamps are not kept."""
    data = df.select(key, time, order)

    def step(stamps, row):
        live = [s for s in stamps if row[1] - s < window]
        if len(live) >= limit:
            return live, (False, max(1, int(window - (row[1] - live[0]))))
        return [*live, row[1]], (True, 0)

    return fold_sorted(data, key, order, list, step, "allowed boolean, retry_after bigint")


COOLDOWN_SQL = (
    "with recursive t as (select event_id as seq, user_id as ip, cast(floor(epoch_us(ts) / 1000000) as bigint) as second from events), "
    "n as (select *, row_number() over (partition by ip order by seq) as k from t), "
    "r(ip, k, seq, second, last, allowed) as (select ip, k, seq, second, second, true from n where k = 1 union all "
    "select n.ip, n.k, n.seq, n.second, case when n.second - r.last >= 21600 then n.second else r.last end, n.second - r.last >= 21600 from r join n on n.ip = r.ip and n.k = r.k + 1) "
    "select ip, second, seq, allowed from r"
)


@query(COOLDOWN_SQL)
def cooldown_allow(spark, sf_dir):
    """Cooldown limiter of six hours per client."""
    return cooldown(tasks(spark, sf_dir), 21_600)


SLIDING_SQL = (
    "with recursive t as (select event_id as seq, user_id as ip, cast(floor(epoch_us(ts) / 1000000) as bigint) as second from events), "
    "n as (select *, row_number() over (partition by ip order by seq) as k from t), "
    "r(ip, k, seq, second, live, allowed) as (select ip, k, seq, second, [second], true from n where k = 1 union all "
    "select ip, k, seq, second, case when len(old) < 2 then list_append(old, second) else old end, len(old) < 2 from (select n.ip, n.k, n.seq, n.second, list_filter(r.live, lambda s: n.second - s < 86400) as old from r join n on n.ip = r.ip and n.k = r.k + 1)) "
    "select ip, second, seq, allowed, case when allowed then 0 else greatest(1, 86400 - (second - live[1])) end::bigint as retry_after from r"
)


@query(SLIDING_SQL)
def sliding_log_limit(spark, sf_dir):
    """Sliding-log limiter: two a day per client, with the seconds to wait."""
    return sliding_log(tasks(spark, sf_dir), 86_400, 2)


@query()
def colon_kinds(spark, sf_dir):
    """What the first semantic colon makes of a paragraph."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("n"))
    k = F.col("doc_id") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("责任单位：综合管理部门"), F.col("n").cast("string"))).when(k == 1, "各位代表、同志们：现在开始说明会议安排。").when(k == 2, "某某学院：")
        .when(k == 3, "本次抽查比例为1:2").when(k == 4, "时间：11:00").when(k == 5, "主要原因如下：第一阶段已经完成。").when(k == 6, "某某研究院：现将有关情况说明如下。").otherwise("时间11:00 标签：内容")
    )
    return K.with_colon(o.select("doc_id", text.alias("text")), "text").select("doc_id", "colon.*")


@query()
def punctuation_normalized(spark, sf_dir):
    """Full-width punctuation near Chinese; protected spans stay."""
    t = outline(spark, sf_dir)
    text = F.concat("text", F.lit('他说"你好,世界..."--结束(重要)! 版本1.2.3,见http://a.b/c.'))
    return t.select("doc_id", "pos", K.punctuated(text).alias("p")).select("doc_id", "pos", "p.text", "p.edits")


@query(f"with t as ({OUTLINE_SQL}) select doc_id, pos, text || '（中文）说“好”,可以？' as text from t")
def legacy_text_chain(spark, sf_dir):
    """The older chain of basic text, quotes and punctuation, all column expressions."""
    t = outline(spark, sf_dir)
    return t.select("doc_id", "pos", P.legacy_chain(F.concat("text", F.lit('(中文)说"好",可以?'))).alias("text"))


@query()
def canonical_tape(spark, sf_dir):
    """Canonical text of every document with totals of its boundary map, the number of the map's runs and a digest of them."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text", K.tape_of("text").alias("t"))
    runs = F.array_join(F.transform("t.runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("raw", "canonical", "utf16")])), ";")
    return t.select("doc_id", F.sha2("t.canonical", 256).alias("canonical_sha256"), (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("raw_boundaries"), P.utf16_length(F.col("t.canonical")).alias("utf16"), F.size("t.warnings").alias("warnings"), F.size("t.runs").alias("runs"), F.sha2(runs, 256).alias("runs_sha256"))


@query()
def normalized_text(spark, sf_dir):
    """NFKC with single blanks, and display width."""
    return table(spark, sf_dir, "documents").select("doc_id", K.normalized("text").alias("n")).select("doc_id", "n.*")


@query()
def protected_spans(spark, sf_dir):
    """Every protected span of every document."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(K.spans_of("text")).alias("s"))
    return s.select("doc_id", "s.start", "s.end", "s.kind")


@query(f"""with t as ({OUTLINE_SQL}), l as (select doc_id, pos, level, case when level = 1 then '第' || number || '章 ' || text else text end as line from t), o as (select *, (sum(length(line) + 1) over (partition by doc_id order by pos) - length(line) - 1)::integer as start from l),
z as (select doc_id, (sum(length(line) + 1) - 1)::integer as size, min(case when level = 1 then start end) as first from o group by 1), c as (select doc_id, line as title, start from o where level = 1 union all select doc_id, case when first is null then '全文' else '前置内容' end, 0 from z where first is null or first > 0)
select c.doc_id, (row_number() over (partition by c.doc_id order by c.start) - 1)::integer as chapter, c.title, c.start, coalesce(lead(c.start) over (partition by c.doc_id order by c.start), z.size)::integer as "end" from c join z on c.doc_id = z.doc_id""")
def book_chapters(spark, sf_dir):
    """Chapters of derived books by heading lines."""
    t = outline(spark, sf_dir)
    line = F.when(F.col("level") == 1, F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("章 "), "text")).otherwise(F.col("text"))
    book = t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    c = book.select("doc_id", F.posexplode(K.chapters_of("text")).alias("chapter", "c"))
    return c.select("doc_id", "chapter", "c.title", "c.start", "c.end")


TAIL_GAP, ORG_REACH = 12, 4


def tail(types: list[str]) -> list[int]:
    """The order of a document's paragraphs after the tail is set right: note and items before organization and date.

    The last date counts; the note must stand at most TAIL_GAP after it or be followed by an item; the organization
    is the nearest one up to ORG_REACH before the date. Only a region that has all of them is moved.
    """
    order = list(range(len(types)))
    date = max((i for i, t in enumerate(types) if t == "sign_date"), default=None)
    if date is None:
        return order
    note = next((i for i in range(date + 1, len(types)) if types[i] == "attachment_note" and (i - date <= TAIL_GAP or types[i + 1 : i + 2] == ["attachment_note_item"])), None)
    org = next((i for i in range(date - 1, max(-1, date - 1 - ORG_REACH), -1) if types[i] == "sign_org"), None)
    if note is None or org is None:
        return order
    end = note + 1
    while end < len(types) and types[end] == "attachment_note_item":
        end += 1
    moved = [*range(note, end), org, date]
    rest = [i for i in range(org, end) if i not in moved]
    return [*range(org), *rest, *moved, *range(end, len(types))]


@query(f"""with t as (select l_orderkey as doc_id, l_linenumber as pos, case when l_linenumber = 1 then 'body' else ['sign_org', 'sign_date', 'attachment_note', 'attachment_note_item'][min(l_partkey) % 4 + 1] end as type from lineitem group by 1, 2), o as (select *, row_number() over (partition by doc_id order by pos) as i, lead(type) over (partition by doc_id order by pos) as nxt, count(*) over (partition by doc_id) as n from t),
d as (select doc_id, max(n) as n, max(i) filter (where type = 'sign_date') as d from o group by 1), a as (select d.*, (select min(i) from o where o.doc_id = d.doc_id and type = 'attachment_note' and i > d and (i - d <= {TAIL_GAP} or nxt = 'attachment_note_item')) as note, (select max(i) from o where o.doc_id = d.doc_id and type = 'sign_org' and i < d and i >= d - {ORG_REACH}) as org from d),
e as (select *, coalesce((select min(i) from o where o.doc_id = a.doc_id and i > note and type <> 'attachment_note_item'), n + 1) as stop from a), m as (select o.*, org, stop, note, d, note is not null and org is not null and o.i >= org and o.i < stop as inside, note is not null and org is not null and ((o.i >= note and o.i < stop) or o.i in (org, d)) as moved from o join e using (doc_id)),
r as (select *, row_number() over (partition by doc_id order by case when not inside then i when not moved then org when i >= note then org + 0.2 when i = org then org + 0.4 else org + 0.6 end, i) as new_pos from m) select doc_id, pos, type, new_pos from r""")
def tail_normalize(spark, sf_dir):
    """Tails put in order; every other paragraph keeps its place."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg((F.min("l_partkey") % 4).alias("k"))
    kind = F.when(F.col("pos") == 1, "body").when(F.col("k") == 0, "sign_org").when(F.col("k") == 1, "sign_date").when(F.col("k") == 2, "attachment_note").otherwise("attachment_note_item")

    def run(rows: list) -> list[tuple]:
        return [(rows[i].doc_id, rows[i].pos, rows[i].type, n) for n, i in enumerate(tail([r.type for r in rows]), 1)]

    return per_document(li.select("doc_id", "pos", kind.alias("type")), run, "doc_id bigint, pos int, type string, new_pos bigint")
