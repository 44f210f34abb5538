"""Where pieces of text come from: scopes of a host's selection, source maps by id with a fallback by place, search for fragments, token slices of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators import context as C
from quire.operators.parts import tokens
from quire.operators.spans import PARAGRAPHS, piece
from quire.plans.registry import query
from quire.sources.tables import LINES_SQL, lines, table

_BLOCKS = f"select doc_id, pos, text, case when pos % 9 = 4 then 'table' else 'paragraph' end as kind from ({LINES_SQL})"


def scoped(blocks: DataFrame, selection: DataFrame) -> DataFrame:
    """The paragraphs of blocks (doc_id, pos, kind) that a selection (doc_id, pos) names, each once however often it is named; tables never belong to a selection."""
    return blocks.where("kind = 'paragraph'").join(selection.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


@query(f"with b as ({_BLOCKS}), s as (select conv_id as doc_id, turn as pos from conversations union all select conv_id, turn + 1 from conversations where role = 'user') select b.doc_id, b.pos, length(b.text)::integer as n from b where kind = 'paragraph' and exists (select 1 from s where s.doc_id = b.doc_id and s.pos = b.pos)")
def format_scope(spark, sf_dir):
    """Lines of documents that a host has selected, without tables."""
    b = lines(spark, sf_dir).withColumn("kind", F.when(F.col("pos") % 9 == 4, "table").otherwise("paragraph"))
    c = table(spark, sf_dir, "conversations")
    chosen = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos")).union(c.where("role = 'user'").select("conv_id", F.col("turn") + 1))
    return scoped(b, chosen).select("doc_id", "pos", F.length("text").alias("n"))


def by_source(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """notes (doc_id, n, block, place) with the block (doc_id, block_id, place, value) that each belongs to: by its id, else, where the id is missing or unknown, by its place."""
    own = blocks.select(F.col("doc_id").alias("d"), "block_id", F.col("place").alias("at"), "value")
    named = notes.join(own, (F.col("doc_id") == F.col("d")) & (F.col("block") == F.col("block_id")), "left").select("doc_id", "n", "block", "place", F.col("value").alias("by_id"), F.col("block_id").isNotNull().alias("known"))
    placed = named.where(~F.col("known")).join(own, (F.col("doc_id") == F.col("d")) & (F.col("place") == F.col("at")), "left").select("doc_id", "n", F.col("value"), F.when(F.col("at").isNotNull(), "place").otherwise("none").alias("found"))
    return named.where("known").select("doc_id", "n", F.col("by_id").alias("value"), F.lit("id").alias("found")).unionByName(placed)


@query(f"""with b as (select doc_id, 'b' || (pos * 3) as block_id, pos as place, length(text)::integer as value from ({LINES_SQL})), n as (select conv_id as doc_id, turn::integer as n, case turn % 4 when 0 then 'b' || (turn * 3) when 1 then 'x' || turn when 2 then null else 'b' || (turn * 6) end as block, turn as place from conversations)
select n.doc_id, n.n, case when i.block_id is not null then i.value else p.value end as value, case when i.block_id is not null then 'id' when p.place is not null then 'place' else 'none' end as found from n left join b i on i.doc_id = n.doc_id and i.block_id = n.block left join b p on p.doc_id = n.doc_id and p.place = n.place""")
def source_map(spark, sf_dir):
    """Diagnostics joined to their blocks by id, with the place as a fallback."""
    b = lines(spark, sf_dir).select("doc_id", F.concat(F.lit("b"), (F.col("pos") * 3).cast("string")).alias("block_id"), F.col("pos").alias("place"), F.length("text").alias("value"))
    t = F.col("turn")
    block = F.when(t % 4 == 0, F.concat(F.lit("b"), (t * 3).cast("string"))).when(t % 4 == 1, F.concat(F.lit("x"), t.cast("string"))).when(t % 4 == 3, F.concat(F.lit("b"), (t * 6).cast("string")))
    n = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), t.cast("int").alias("n"), block.alias("block"), t.alias("place"))
    return by_source(n, b)


def searched(source: Column, fragments: Column) -> Column:
    """array of struct(start, end) of fragments found one behind the other in a source, also without their outer blanks; null where one is not there, and the search then goes on from where it was."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, value: Column) -> Column:
        whole = F.call_function("locate", value, source, acc["at"] + 1)
        bare = P.strip(value)
        cut = F.call_function("locate", bare, source, acc["at"] + 1)
        # Nothing is found where the search stands.
        start = F.when(value == "", acc["at"]).when(whole > 0, whole - 1).when(bare == "", acc["at"]).when(cut > 0, cut - 1)
        end = start + F.when((whole > 0) | (value == ""), F.length(value)).otherwise(F.length(bare))
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(F.coalesce(end, acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(fragments, zero, step)["out"]


_FRAGMENTS = f"select doc_id, para, text, substr(text, cut, 4) as a, ' ' || substr(text, cut2 + 1, 3) || ' ' as b, case when s % 5 = 0 then '无此文' else substr(text, 1, 2) end as c, substr(text, length(text) - 1) as d from ({PARAGRAPHS}) p"


@query(f"""with recursive f as ({_FRAGMENTS}), p as (select doc_id, para, text, unnest([a, b, c, d]) as v, generate_subscripts([a, b, c, d], 1) as n from f),
w(doc_id, para, n, spot, start, stop) as (select doc_id, para, 0::bigint, 0::bigint, null::bigint, null::bigint from f
  union all select doc_id, para, n, coalesce(stop, spot), start, stop from (select *, case when whole > 0 then spot + whole - 1 + length(v) when cut > 0 then spot + cut - 1 + length(bare) end as stop, case when whole > 0 then spot + whole - 1 when cut > 0 then spot + cut - 1 end as start from
    (select p.doc_id, p.para, p.n, w.spot, p.v, strpos(substr(p.text, w.spot + 1), p.v) as whole, strpos(substr(p.text, w.spot + 1), regexp_replace(p.v, '^\\s+|\\s+$', '', 'g')) as cut, regexp_replace(p.v, '^\\s+|\\s+$', '', 'g') as bare from w join p on p.doc_id = w.doc_id and p.para = w.para and p.n = w.n + 1)))
select doc_id, para, (n - 1)::integer as n, start::integer as start, stop::integer as stop, case when start is null then 'unresolved' else 'review' end as status, case when start is null then 'SOURCE_RANGE_UNRESOLVED' else 'SOURCE_OCCURRENCE_AMBIGUOUS' end as warning from w where n > 0""")
def fragment_search(spark, sf_dir):
    """Fragments searched one behind the other in their paragraph: a hit by text alone is never more than worth a review."""
    p = spark.sql(_FRAGMENTS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    s = p.select("doc_id", "para", F.posexplode(searched(F.col("text"), F.array("a", "b", "c", "d"))).alias("n", "x")).select("doc_id", "para", "n", "x.start", F.col("x.end").alias("stop"))
    missed = F.col("start").isNull()
    return s.select("*", F.when(missed, "unresolved").otherwise("review").alias("status"), F.when(missed, "SOURCE_RANGE_UNRESOLVED").otherwise("SOURCE_OCCURRENCE_AMBIGUOUS").alias("warning"))


def sliced(parts: Column, start: Column, end: Column) -> Column:
    """The tokens of a paragraph (kind, text) that lie in [start, end) of its text, cut at its ends; a page break belongs to the span in which it stands."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["at"], acc["at"] + F.length(x["text"])
        own = piece(x["text"], F.greatest(start, a) - a, F.least(end, b) - a)
        inside = F.when(x["kind"] == "page_break", (start <= a) & (a < end)).otherwise((F.greatest(start, a) < F.least(end, b)))
        return F.struct(b.cast("int").alias("at"), F.when(inside, F.concat(acc["out"], F.array(F.struct(x["kind"].alias("kind"), own.alias("text"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step)["out"]


_TAB = "case when s % 4 = 0 then substr(text, 1, 2) || chr(9) || substr(text, 3) else text end"
_SPANS = f"select doc_id, para, {_TAB} as text, cut, cut2, s from ({PARAGRAPHS}) p"
_CHARS = "list_transform(range(length({0})::bigint), lambda j: substr({0}, j + 1, 1))"


@query(f"""with p as ({_SPANS}), s as (select doc_id, para, 0 as n, text, 0 as a, cut as b from p union all select doc_id, para, 1, text, cut, cut2 from p union all select doc_id, para, 2, text, cut2, length(text) from p), t as (select *, substr(text, (a + 1)::bigint, (b - a)::bigint) as x from s)
select doc_id, para, n, len(regexp_extract_all(x, '[^' || chr(10) || chr(9) || ']+|' || chr(10) || '|' || chr(9)))::integer as tokens, len(list_filter({_CHARS.format('x')}, lambda c: c = chr(9)))::integer as tabs, len(list_filter({_CHARS.format('x')}, lambda c: c = chr(10)))::integer as breaks, true as reads_back from t""")
def token_slices(spark, sf_dir):
    """Tokens of the spans of every paragraph: read one behind the other they are the span's text."""
    p = spark.sql(_SPANS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    xml = F.concat(F.lit("<w:p><w:r><w:t>"), F.replace(F.replace("text", F.lit("\n"), F.lit("</w:t><w:br/><w:t>")), F.lit("\t"), F.lit("</w:t><w:tab/><w:t>")), F.lit("</w:t></w:r></w:p>"))
    ends = F.array(F.struct(F.lit(0).alias("a"), F.col("cut").alias("b")), F.struct(F.col("cut").alias("a"), F.col("cut2").alias("b")), F.struct(F.col("cut2").alias("a"), F.length("text").alias("b")))
    s = p.withColumn("parts", tokens(xml)).select("doc_id", "para", "text", "parts", F.posexplode(ends).alias("n", "x"))
    s = s.withColumn("own", sliced(F.col("parts"), F.col("x.a"), F.col("x.b")))
    count = lambda kind: F.size(F.filter("own", lambda t: t["kind"] == kind))
    back = F.array_join(F.transform("own", lambda t: t["text"]), "") == piece(F.col("text"), F.col("x.a"), F.col("x.b"))
    return s.select("doc_id", "para", "n", F.size("own").alias("tokens"), count("tab").alias("tabs"), count("line_break").alias("breaks"), back.alias("reads_back"))


_PREFIX = r"^\s*([一二三四五六七八九十百]+[、.．]|[（(][一二三四五六七八九十百0-9]+[）)]|[0-9]+[.．、]|[①②③④⑤⑥⑦⑧⑨⑩])"


@query(f"""with l as ({C.LINES}), x as (select *, trim(text) as t, regexp_replace(text, '\\s', '', 'g') as c, regexp_extract(text, '{_PREFIX}', 1) as prefix from l)
select doc_id, pos, prefix, case when prefix = '' then null when regexp_matches(prefix, '^[（(][0-9]') then 4 when regexp_matches(prefix, '^[（(]') then 2 when regexp_matches(prefix, '^[0-9]') then 3 else 1 end::integer as level, regexp_matches(c, '{C.ROLES}') as role_hint, {C._shape_sql('c')} as name_strength,
  regexp_matches(text, '^\\s*[“”"''‘’「『]?\\s*责\\s*任\\s*单\\s*位\\s*[:：]') as responsibility, regexp_matches(c, '{C.HEAD_START}') as head_date from x""")
def line_features(spark, sf_dir):
    """Of every derived line: its number and the level that it gives, hints of roles and names, a responsibility label, a date of a head."""
    t, c = F.col("text"), P.compact(F.col("text"))
    prefix = F.regexp_extract(t, _PREFIX, 1)
    level = F.when(prefix == "", None).when(prefix.rlike("^[（(][0-9]"), 4).when(prefix.rlike("^[（(]"), 2).when(prefix.rlike("^[0-9]"), 3).otherwise(1)
    return C.lines(spark, sf_dir).select(
        "doc_id", "pos", prefix.alias("prefix"), level.cast("int").alias("level"), c.rlike(C.ROLES).alias("role_hint"), C._strength(c).alias("name_strength"), t.rlike("^\\s*[“”\"'‘’「『]?\\s*责\\s*任\\s*单\\s*位\\s*[:：]").alias("responsibility"), c.rlike(C.HEAD_START).alias("head_date"),
    )
