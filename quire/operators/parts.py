"""Parts of a word package as XML texts: blocks of the body, tokens of a paragraph, relationships, sections, punctuation of every part.

A part is one column; its elements come out in their order, by expressions of the engine's own. Relationships are read with a
schema and joined by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.spans import PARAGRAPHS
from quire.plans.registry import query
from quire.sources.tables import table

RELATIONSHIPS = "struct<Relationship:array<struct<_Id:string,_Type:string,_Target:string,_TargetMode:string>>>"
BLOCK = r"(?s)<w:tbl>.*?</w:tbl>|<w:sectPr\b.*?</w:sectPr>|<w:p>.*?</w:p>"
TOKEN = r'<w:t(?: [^>]*)?>([^<]*)</w:t>|(<w:tab/>|<w:br w:type="page"/>|<w:br/>)'
MARKS = {"half": "[,.;:?!]", "wide": "[，。；：？！]", "quotes": "[\"“”'‘’]"}


def escaped(text: Column) -> Column:
    out = text
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(name), F.lit(raw))
    return out


def blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, at, kind, xml): the blocks of each body in order: p, tbl, sectPr. parts: (doc_id, document)."""
    xml = F.col("xml")
    kind = F.when(xml.startswith("<w:tbl"), "tbl").when(xml.startswith("<w:sectPr"), "sectPr").otherwise("p")
    # Of an inner explode the optimizer infers a filter on its input, for which the body would be searched once more.
    found = parts.select("doc_id", F.posexplode_outer(F.regexp_extract_all("document", F.lit(BLOCK), F.lit(0))).alias("at", "xml")).where("at is not null")
    return found.select("doc_id", "at", kind.alias("kind"), "xml")


def pieces(xml: Column) -> Column:
    """array of what a paragraph shows, in order: texts, still escaped, and the elements of tabs and breaks. All else goes first, so texts beside each other are one."""
    return F.regexp_extract_all(F.regexp_replace(xml, rf"{TOKEN}|[^<]+|<[^<]*", "$1$2"), F.lit("[^<]+|<[^>]*>"), F.lit(0))


def kind_of(piece: Column) -> Column:
    return F.when(~piece.startswith("<"), "text").when(piece == "<w:tab/>", "tab").when(piece == "<w:br/>", "line_break").otherwise("page_break")


def text_of(piece: Column) -> Column:
    return F.when(~piece.startswith("<"), unescaped(piece)).when(piece == "<w:tab/>", "\t").when(piece == "<w:br/>", "\n").otherwise("")


def tokens(xml: Column) -> Column:
    """array of struct(kind, text): what a paragraph shows, in order. Texts beside each other are one."""
    return F.transform(pieces(xml), lambda x: F.struct(kind_of(x).alias("kind"), text_of(x).alias("text")))


def relationships(parts: DataFrame) -> DataFrame:
    """(doc_id, id, type, target, external) of each relationship; a target that is missing or empty is null."""
    r = parts.select("doc_id", F.explode(F.from_xml("rels", RELATIONSHIPS)["Relationship"]).alias("r"))
    return r.select("doc_id", F.col("r._Id").alias("id"), F.regexp_extract("r._Type", "[^/]+$", 0).alias("type"), F.nullif("r._Target", F.lit("")).alias("target"), F.coalesce(F.col("r._TargetMode") == "External", F.lit(False)).alias("external"))


def sections(parts: DataFrame) -> DataFrame:
    """(doc_id, section, width, height, landscape, header, header_target): sections in order with the part of their header, null where the relationship has none."""
    attribute = lambda tag, name: F.nullif(F.regexp_extract("xml", rf'<w:{tag}\b[^>]* {name}="([^"]*)"', 1), F.lit(""))
    s = blocks(parts).where("kind = 'sectPr'").select("doc_id", "at", attribute("pgSz", "w:w").cast("int").alias("width"), attribute("pgSz", "w:h").cast("int").alias("height"), F.coalesce(attribute("pgSz", "w:orient") == "landscape", F.lit(False)).alias("landscape"), attribute("headerReference", "r:id").alias("header"))
    r = relationships(parts).select(F.col("doc_id").alias("d"), F.col("id").alias("r_id"), F.col("target").alias("header_target"))
    return s.join(r, (F.col("doc_id") == F.col("d")) & (F.col("header") == F.col("r_id")), "left").drop("d", "r_id")


# Derived parts: an order is a package, its lines are paragraphs.
_TEXT = "case when s % 4 = 0 then substr(text, 1, 2) || chr(9) || substr(text, 3) else text end || case when s % 6 = 0 then ' A&B<C>, \"x\"' else '' end"
_FACTS = f"select doc_id, para, s, q, {_TEXT} as text from ({PARAGRAPHS}) p"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FACTS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document, rels): each paragraph's runs split its text in the middle; some stand in a table, some end a page or a section."""
    f = _facts(spark, sf_dir)
    run = lambda t: F.concat(F.lit('<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), F.replace(F.replace(escaped(t), F.lit("\n"), F.lit("</w:t><w:br/><w:t>")), F.lit("\t"), F.lit("</w:t><w:tab/><w:t>")), F.lit("</w:t></w:r>"))
    half = F.floor(F.length("text") / 2).cast("int")
    p = F.concat(F.lit("<w:p>"), run(F.substr("text", F.lit(1), half)), run(F.substr("text", half + 1)), F.when(F.col("s") % 9 == 0, '<w:r><w:br w:type="page"/></w:r>').otherwise(""), F.lit("</w:p>"))
    p = F.when(F.col("s") % 11 == 0, F.concat(F.lit("<w:tbl><w:tr><w:tc>"), p, F.lit("</w:tc></w:tr></w:tbl>"))).otherwise(p)
    sect = F.concat(F.lit('<w:sectPr><w:headerReference w:type="default" r:id="rId'), F.col("para").cast("string"), F.lit('"/><w:pgSz w:w="'), (11906 + F.col("q")).cast("string"), F.lit('" w:h="16838"'), F.when(F.col("q") % 2 == 0, ' w:orient="landscape"').otherwise(""), F.lit("/></w:sectPr>"))
    block = F.concat(p, F.when(F.col("s") % 7 == 0, sect).otherwise(""))
    link = F.concat(F.lit('<Relationship Id="rId'), F.col("para").cast("string"), F.lit('" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'), F.when(F.col("q") % 5 == 0, "hyperlink").otherwise("header"), F.lit('"'),
                    F.when(F.col("q") % 7 == 0, "").when(F.col("q") % 7 == 1, ' Target=""').otherwise(F.concat(F.lit(' Target="header'), F.col("q").cast("string"), F.lit('.xml"'))), F.when(F.col("q") % 5 == 0, ' TargetMode="External"').otherwise(""), F.lit("/>"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", c.alias("x")))), lambda x: x["x"]), "")
    return f.groupBy("doc_id").agg(F.concat(F.lit("<w:document><w:body>"), joined(block), F.lit("</w:body></w:document>")).alias("document"), F.concat(F.lit("<Relationships>"), joined(link), F.lit("</Relationships>")).alias("rels"))


_PIECES = "regexp_extract_all(text, '[^' || chr(10) || chr(9) || ']+|' || chr(10) || '|' || chr(9))"
_BLOCKS_SQL = f"""f as ({_FACTS}), b0 as (select doc_id, para, 0 as o, case when s % 11 = 0 then 'tbl' else 'p' end as kind, text, s, q from f union all select doc_id, para, 1, 'sectPr', '', s, q from f where s % 7 = 0),
b as (select *, row_number() over (partition by doc_id order by para, o) - 1 as spot from b0)"""


@query(f"with {_BLOCKS_SQL} select doc_id, spot::integer as \"at\", kind from b")
def body_blocks(spark, sf_dir):
    """Blocks of every body in order: paragraphs, tables, section ends."""
    return blocks(packages(spark, sf_dir)).select("doc_id", "at", "kind")


@query(f"""with {_BLOCKS_SQL}, t as (select doc_id, spot, unnest({_PIECES}) as x, generate_subscripts({_PIECES}, 1) - 1 as n, len({_PIECES}) as total, s from b where kind = 'p'),
a as (select doc_id, spot, n, case x when chr(9) then 'tab' when chr(10) then 'line_break' else 'text' end as kind, x as text from t union all select doc_id, spot, total, 'page_break', '' from (select distinct doc_id, spot, total, s from t) where s % 9 = 0)
select doc_id, spot::integer as "at", n::integer as n, kind, text from a""")
def inline_tokens(spark, sf_dir):
    """Tokens of every paragraph outside tables: texts, tabs, line and page breaks."""
    p = blocks(packages(spark, sf_dir)).where("kind = 'p'")
    t = p.select("doc_id", "at", F.posexplode_outer(pieces(F.col("xml"))).alias("n", "piece")).where("n is not null")
    return t.select("doc_id", "at", "n", kind_of(F.col("piece")).alias("kind"), text_of(F.col("piece")).alias("text"))


@query(f"with f as ({_FACTS}) select doc_id, 'rId' || para as id, case when q % 5 = 0 then 'hyperlink' else 'header' end as type, case when q % 7 > 1 then 'header' || q || '.xml' end as target, q % 5 = 0 as external from f")
def package_relationships(spark, sf_dir):
    """Relationships of every package; a target may be missing."""
    return relationships(packages(spark, sf_dir))


@query(f"with {_BLOCKS_SQL} select doc_id, spot::integer as \"at\", 11906 + q as width, 16838 as height, q % 2 = 0 as landscape, 'rId' || para as header, case when q % 7 > 1 then 'header' || q || '.xml' end as header_target from b where kind = 'sectPr'")
def section_parts(spark, sf_dir):
    """Sections with their page and the part that their header's relationship names."""
    return sections(packages(spark, sf_dir))


@query("with f as (" + _FACTS + "), p as (select doc_id, 'document' as part, string_agg(text, '') as t from f group by 1) select doc_id, part, " + ", ".join(f"(length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')))::integer as {n}" for n, p in MARKS.items()) + " from p")
def part_punctuation(spark, sf_dir):
    """Half-width marks, wide ones and quotes in what every part shows."""
    shown = F.array_join(F.transform(F.flatten(F.transform(F.regexp_extract_all("document", F.lit(r"(?s)<w:p>.*?</w:p>"), F.lit(0)), tokens)), lambda x: x["text"]), "")
    t = packages(spark, sf_dir).select("doc_id", F.lit("document").alias("part"), shown.alias("t"))
    return t.select("doc_id", "part", *[F.regexp_count("t", F.lit(p)).alias(n) for n, p in MARKS.items()])
