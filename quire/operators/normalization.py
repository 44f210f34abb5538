"""Numbers and types set right after recognition: gaps in heading numbers, uniform siblings, and the guard that types stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.folds import tail
from quire.operators.grouped import per_document
from quire.plans.registry import query
from quire.sources.tables import table

CN = "一二三四五六七八九十"
PARENTS = ("heading1", "heading2", "heading3")

# Derived headings: type and number text depend on the row; some numbers say nothing, some paragraphs have none.
_KIND = "case k when 0 then 'attachment_page_mark' when 1 then 'heading1' when 2 then 'heading1' when 3 then 'heading2' when 4 then 'heading2' when 5 then 'heading3' when 6 then 'heading3' when 7 then 'heading4' when 8 then 'heading4' when 9 then 'sign_org' when 10 then 'sign_date' when 11 then 'attachment_note' when 12 then 'attachment_note_item' else 'body' end"
_CN = f"substr('{CN}', q % 10 + 1, 1)"
_NUMBER = (
    f"case when q % 13 = 0 then '' when k in (1, 2) then case when q % 11 = 0 then '第' || q || '章' when q % 7 = 0 then {_CN} || '.' else {_CN} || '、' end "
    f"when k = 3 then '（' || {_CN} || '）' when k = 4 then case when q % 9 = 0 then '甲.' else {_CN} || '.' end when k = 5 then (q % 6) || '.' when k = 6 then case when q % 5 = 0 then 'x.' else q || '.' end "
    "when k in (7, 8) then case when q % 8 = 0 then '（x）' else '（' || (q % 5) || '）' end else '' end"
)
FACTS = "select l_orderkey as doc_id, l_linenumber as pos, cast(min(l_quantity) as int) as q, cast(min(l_partkey) % 15 as int) as k from lineitem group by l_orderkey, l_linenumber"
HEADINGS = f"select doc_id, pos, {_KIND} as type, {_NUMBER} as number from ({FACTS}) f"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HEADINGS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def _cn_value(c: Column) -> Column:
    return F.when((F.length(c) == 1) & (F.instr(F.lit(CN), c) > 0), F.instr(F.lit(CN), c))


def _cn_text(n: Column) -> Column:
    return F.when(n.between(1, len(CN)), F.substring(F.lit(CN), n, F.lit(1))).otherwise(n.cast("string"))


def repaired(df: DataFrame) -> DataFrame:
    """(doc_id, pos, type, number) with actual, what a heading's number says; expected, the next of its level; and fixed, the number set to it.

    A level counts its readable numbers since the last heading above it or page mark: each level is one running
    count within the stretches that such rows begin. An empty number counts nothing and begins nothing.
    """
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    number, kind = F.col("number"), F.col("type")
    level = F.when(number != "", F.nullif(F.regexp_extract(kind, "^heading([1-4])$", 1), F.lit("")).cast("int"))
    c1 = F.substring(number, 1, 1)
    c2 = F.when(number.startswith("（"), F.substring(number, 2, 1)).otherwise(c1)
    digits = F.regexp_extract(number, "[0-9]+", 0)
    bare = F.regexp_replace(number, r"\.+$", "")
    actual = F.when(level == 1, _cn_value(c1)).when(level == 2, _cn_value(c2)).when((level == 3) & bare.rlike("^[0-9]+$"), bare.try_cast("int")).when((level == 4) & (digits != ""), digits.try_cast("int"))
    df = df.withColumn("level", level).withColumn("actual", actual.cast("int"))
    known = F.col("actual").isNotNull()
    mark = kind == "attachment_page_mark"
    # A first-level heading that says no number begins no stretch; the other levels do, whatever they say.
    begins = [mark]
    for k in range(1, 4):
        begins.append(begins[-1] | ((F.col("level") == k) & (known if k == 1 else F.lit(True))))
    # Readable numbers of a level since the stretch's first row: the running count less what it was before the last such row.
    # Counts only grow, so that is a maximum over the same rows, and one sort serves all levels.
    for k, b in enumerate(begins, 1):
        one = F.when((F.col("level") == k) & known, 1).otherwise(0)
        df = df.withColumn(f"n{k}", F.sum(one).over(order)).withColumn(f"before{k}", F.when(F.coalesce(b, F.lit(False)), F.col(f"n{k}") - one))
    df = df.withColumns({f"n{k}": F.col(f"n{k}") - F.coalesce(F.max(f"before{k}").over(order), F.lit(0)) for k in range(1, 5)})
    df = df.withColumn("expected", F.when(known, F.coalesce(*[F.when(F.col("level") == k, F.col(f"n{k}")) for k in range(1, 5)])).cast("int"))
    n = F.col("expected")
    once = lambda old, new: F.when(F.instr(number, old) > 0, F.concat(F.substr(number, F.lit(1), F.instr(number, old) - 1), new, F.substr(number, F.instr(number, old) + F.length(old)))).otherwise(number)
    second = F.when(F.instr(number, F.concat(F.lit("（"), c2, F.lit("）"))) > 0, once(F.concat(F.lit("（"), c2, F.lit("）")), F.concat(F.lit("（"), _cn_text(n), F.lit("）")))).otherwise(once(F.concat(c2, F.lit(".")), F.concat(_cn_text(n), F.lit("."))))
    said = F.col("actual").cast("string")
    fixed = F.when(F.col("level") == 1, once(F.concat(c1, F.lit("、")), F.concat(_cn_text(n), F.lit("、")))).when(F.col("level") == 2, second).when(F.col("level") == 3, F.concat(n.cast("string"), F.lit("."))).otherwise(once(said, n.cast("string")))
    df = df.withColumn("fixed", F.when(known & (F.col("actual") != n), fixed).otherwise(number))
    return df.select("doc_id", "pos", "type", "number", "actual", "expected", "fixed")


_STEP = """case when h.type = 'attachment_page_mark' then 1 when h.level = 1 and h.actual is not null then r.a + 1 else r.a end, case when h.type = 'attachment_page_mark' or (h.level = 1 and h.actual is not null) then 1 when h.level = 2 and h.actual is not null then r.b + 1 else r.b end,
  case when h.type = 'attachment_page_mark' or (h.level = 1 and h.actual is not null) or h.level = 2 then 1 when h.level = 3 and h.actual is not null then r.c + 1 else r.c end, case when h.type = 'attachment_page_mark' or (h.level = 1 and h.actual is not null) or h.level in (2, 3) then 1 when h.level = 4 and h.actual is not null then r.d + 1 else r.d end"""
_VALUE = f"case when length({{0}}) = 1 and strpos('{CN}', {{0}}) > 0 then strpos('{CN}', {{0}}) end"
_TEXT = f"case when want between 1 and 10 then substr('{CN}', want, 1) else want::varchar end"
REPAIR_SQL = f"""with recursive t as ({HEADINGS}), l as (select *, row_number() over (partition by doc_id order by pos) as k, case when number <> '' and type like 'heading%' then right(type, 1)::int end as level, left(number, 1) as c1, case when starts_with(number, '（') then substr(number, 2, 1) else left(number, 1) end as c2 from t),
h as (select *, (case level when 1 then {_VALUE.format('c1')} when 2 then {_VALUE.format('c2')} when 3 then try_cast(nullif(regexp_extract(rtrim(number, '.'), '^[0-9]+$', 0), '') as int) when 4 then try_cast(nullif(regexp_extract(number, '[0-9]+', 0), '') as int) end)::int as actual from l),
r(doc_id, k, pos, want, a, b, c, d) as (select doc_id, 0::bigint, 0::bigint, null::int, 1, 1, 1, 1 from h where k = 1
  union all select h.doc_id, h.k, h.pos::bigint, case when h.actual is not null then case h.level when 1 then r.a when 2 then r.b when 3 then r.c when 4 then r.d end end, {_STEP} from r join h on h.doc_id = r.doc_id and h.k = r.k + 1)
"""


@query(f"""{REPAIR_SQL}, j as (select h.*, r.want from h join r on h.doc_id = r.doc_id and h.k = r.k)
select doc_id, pos, type, number, actual, want::int as expected, case when actual is null or actual = want then number when level = 1 then regexp_replace(number, c1 || '、', {_TEXT} || '、')
  when level = 2 then case when contains(number, '（' || c2 || '）') then replace(number, '（' || c2 || '）', '（' || {_TEXT} || '）') else replace(number, c2 || '.', {_TEXT} || '.') end when level = 3 then want || '.' else regexp_replace(number, actual::varchar, want::varchar) end as fixed from j""")
def heading_gap_repair(spark, sf_dir):
    """Heading numbers that skip, repeat or go back are set to the next of their level; a page mark begins all levels anew."""
    return repaired(headings(spark, sf_dir))


def merged(types: list[str], numbered: list[bool]) -> list[str]:
    """Types after uniform siblings are pulled to the level below their parent, again and again until nothing changes.

    Siblings are all deeper headings up to the next heading as high as the parent; they move if they are two or more of one level and none has a
    number. Moved ones lose theirs, so they may move again with another parent.
    """
    types, numbered = list(types), list(numbered)
    level = lambda t: int(t[-1]) if t.startswith("heading") else 0
    seen, changed = {tuple(types)}, True
    while changed:
        changed = False
        for i, t in enumerate(types):
            if t not in PARENTS:
                continue
            below = []
            for j in range(i + 1, len(types)):
                if types[j] in PARENTS and level(types[j]) <= level(t):
                    break
                if level(types[j]):
                    below.append(j)
            target = f"heading{min(level(t) + 1, 4)}"
            if len(below) > 1 and len({types[j] for j in below}) == 1 and types[below[0]] != target and not any(numbered[j] for j in below):
                for j in below:
                    types[j], numbered[j] = target, False
                changed = True
        if changed and tuple(types) in seen:
            break  # a cycle of rewritings has no end; the state met again is the result
        seen.add(tuple(types))
    return types


def sibling_types(df: DataFrame) -> DataFrame:
    """(doc_id, pos, type, merged) of every paragraph of (doc_id, pos, type, number)."""

    def run(rows: list) -> list[tuple]:
        return [(r.doc_id, r.pos, r.type, m) for r, m in zip(rows, merged([r.type for r in rows], [bool(r.number) for r in rows]))]

    return per_document(df.select("doc_id", F.col("pos").cast("int").alias("pos"), "type", "number"), run, "doc_id bigint, pos int, type string, merged string")


def chain(df: DataFrame, strategy: str = "normalize") -> DataFrame:
    """Tail order, then for the strategy ``normalize`` the numbers: (doc_id, pos, type, place, number). Types stay as they are; ``strict`` changes nothing."""

    def run(rows: list) -> list[tuple]:
        order = range(len(rows)) if strategy == "strict" else tail([r.type for r in rows])
        return [(rows[i].doc_id, rows[i].pos, rows[i].type, n, rows[i].number) for n, i in enumerate(order, 1)]

    out = per_document(df.select("doc_id", F.col("pos").cast("int").alias("pos"), "type", "number"), run, "doc_id bigint, pos int, type string, place int, number string")
    if strategy != "normalize":
        return out
    fixed = repaired(out.select("doc_id", F.col("place").alias("pos"), "type", "number")).select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("fixed"))
    return out.join(fixed, (F.col("doc_id") == F.col("d")) & (F.col("place") == F.col("p"))).select("doc_id", "pos", "type", "place", F.col("fixed").alias("number"))


def guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, pos) whose type a step changed, or that it lost or made: what normalization must never have."""
    a, b = before.select("doc_id", "pos", F.col("type").alias("was")), after.select("doc_id", "pos", F.col("type").alias("now"))
    return a.join(b, ["doc_id", "pos"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


@query()
def sibling_merge(spark, sf_dir):
    """Headings whose level uniform siblings change; as it changes types, it stands outside the chain."""
    t = sibling_types(headings(spark, sf_dir).withColumn("number", F.when(F.col("doc_id") % 3 == 0, F.col("number")).otherwise("")))
    return t.where("type <> merged").select("doc_id", "pos", "type", "merged")


@query()
def normalization_chain(spark, sf_dir):
    """Place and number of every paragraph after the chain."""
    return chain(headings(spark, sf_dir))


@query(f"select count(*) as paragraphs, 0::bigint as changed_by_chain, 0::bigint as changed_by_strict from ({HEADINGS}) t")
def normalization_guard(spark, sf_dir):
    """How many paragraphs there are, and how many types the chain changes: none."""
    h = headings(spark, sf_dir)
    none = lambda s: guard(h, chain(h, s)).agg(F.count("*").alias(f"changed_by_{s if s == 'strict' else 'chain'}"))
    return h.agg(F.count("*").alias("paragraphs")).crossJoin(none("normalize")).crossJoin(none("strict"))  # one row each
