"""The text library and comparisons of runs: imports with their reject reasons, progress, next books, drift, packages, payload numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.packages import MEMBERS_SQL, members
from quire.plans.registry import query
from quire.sources.phrases import PHRASES_SQL, phrases
from quire.sources.tables import TASKS_SQL, table, tasks

BOM = b"\xef\xbb\xbf"
MOST_BYTES = 64 * 1024 * 1024


def decode_bytes(raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(encoding, text, error): a byte order mark settles it, then UTF-8, then GB18030; newlines become \\n."""
    if not raw:
        return None, None, "READER_FILE_EMPTY"
    for encoding in ("utf-8-sig",) if raw.startswith(BOM) else ("utf-8", "gb18030"):
        try:
            return encoding, raw.decode(encoding).replace("\r\n", "\n").replace("\r", "\n"), None
        except UnicodeDecodeError:
            pass
    return None, None, "READER_ENCODING_UNSUPPORTED"


def decoded(raw):
    """struct(encoding, text, error) of a binary column; Spark has no GB18030, so this is a vectorized function."""

    def work(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(v) for v in values], columns=["encoding", "text", "error"], dtype=object)

    return F.pandas_udf(work, "encoding string, text string, error string")(raw)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, raw): documents as files: plain, with a mark, in GB18030, broken, empty or blank; some names are bad."""
    k, text = F.col("doc_id") % 7, F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    raw = (
        F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), text)).when(k == 2, F.concat(F.unhex(F.lit("D6D0B9FA")), F.encode(F.col("doc_id").cast("string"), "UTF-8")))
        .when(k == 3, F.unhex(F.lit("EFBBBFFF"))).when(k == 4, F.unhex(F.lit(""))).when(k == 5, F.unhex(F.lit("20200D0A"))).when(k == 6, F.unhex(F.lit("FFFF"))).otherwise(text)
    )
    name = F.when(F.col("doc_id") % 11 == 0, " .txt").when(F.col("doc_id") % 13 == 0, "a.pdf").otherwise(F.concat(F.lit("book "), F.col("doc_id").cast("string"), F.lit(".TXT")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), raw.alias("raw"))


_BYTES = "octet_length(encode(coalesce(text, '')))"


@query(f"""with f as (select doc_id, doc_id % 7 as k, coalesce(text, '') as text, case doc_id % 7 when 0 then {_BYTES} when 1 then {_BYTES} + 3 when 2 then 4 + length(doc_id::varchar) when 3 then 4 when 4 then 0 when 5 then 4 else 2 end as bytes from documents)
select doc_id, bytes::integer as bytes, case when k in (0, 5) and bytes > 0 then 'utf-8' when k = 1 then 'utf-8-sig' when k = 2 then 'gb18030' end as encoding,
  case when k in (0, 1) and (k = 1 or bytes > 0) then length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) when k = 2 then 2 + length(doc_id::varchar) when k = 5 then 3 end::integer as chars,
  case when doc_id % 11 <> 0 and doc_id % 13 = 0 then 'READER_FILE_TYPE_UNSUPPORTED' when bytes > {MOST_BYTES} then 'READER_FILE_TOO_LARGE' when k = 4 or bytes = 0 then 'READER_FILE_EMPTY' when k in (3, 6) then 'READER_ENCODING_UNSUPPORTED'
    when k = 5 or (k < 2 and trim(text) = '') then 'READER_FILE_EMPTY' when doc_id % 11 = 0 then 'READER_IMPORT_FAILED' end as reason from f""")
def text_imports(spark, sf_dir):
    """Encoding and length of every file, and the first reason for which it is not imported."""
    return imports(files(spark, sf_dir))


def imports(found: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, bytes, encoding, chars, reason) of files (doc_id, name, raw); most: bytes that a file may have."""
    f = found.withColumn("d", decoded("raw")).withColumn("bytes", F.octet_length("raw"))
    stem = F.trim(F.regexp_replace("name", r"\.[^.]*$", ""))
    reason = (
        F.when(~F.lower("name").endswith(".txt"), "READER_FILE_TYPE_UNSUPPORTED").when(F.col("bytes") > most, "READER_FILE_TOO_LARGE").when(F.col("d.error").isNotNull(), F.col("d.error"))
        .when(~F.col("d.text").rlike(r"\S"), "READER_FILE_EMPTY").when(stem == "", "READER_IMPORT_FAILED")
    )
    return f.select("doc_id", "bytes", "d.encoding", F.length("d.text").alias("chars"), reason.alias("reason"))


@query("select doc_id, case when coalesce(length(text), 0) <= 0 then 0 else greatest(0, least(1, (doc_id % 700 - 50) / length(text)::double)) end::double as ratio from documents")
def book_progress(spark, sf_dir):
    """How far a place is in the whole book, from 0 to 1."""
    n = F.coalesce(F.length("text"), F.lit(0))
    ratio = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("doc_id") % 700 - 50) / n)))
    return table(spark, sf_dir, "documents").select("doc_id", ratio.alias("ratio"))


@query("with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id desc) as place from documents) select source, max(case when place = 1 then doc_id end) as current, max(case when place = 2 then doc_id end) as next from r where place <= 2 group by 1")
def next_books(spark, sf_dir):
    """The newest book of each shelf and the one that is current once it is deleted; n_chars stands for the time of the import."""
    by = W.partitionBy("source").orderBy(F.col("n_chars").desc(), F.col("doc_id").desc())
    r = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(by).alias("place")).where("place <= 2")
    return r.groupBy("source").agg(F.max(F.when(F.col("place") == 1, F.col("doc_id"))).alias("current"), F.max(F.when(F.col("place") == 2, F.col("doc_id"))).alias("next"))


_RUNS = f"""t as ({PHRASES_SQL}), a as (select doc_id, row_number() over (partition by doc_id order by pos) as i, text, type, left(type, 4) as section from t),
b as (select doc_id, row_number() over (partition by doc_id order by pos) as i, case when pos % 7 = 0 then text || '。' else text end as text, case when pos % 5 = 0 then 'body' else type end as type, left(type, 4) as section from t where pos % 29 <> 3)"""


@query(f"with {_RUNS}, j as (select a.doc_id, a.i, unnest([{{'field': 'text', 'before': sha256(a.text), 'after': sha256(b.text)}}, {{'field': 'type', 'before': a.type, 'after': b.type}}, {{'field': 'section', 'before': a.section, 'after': b.section}}]) as d from a join b on a.doc_id = b.doc_id and a.i = b.i) select doc_id, i as paragraph, d.field as field, d.before as before, d.after as after from j where d.before is distinct from d.after")
def run_drift(spark, sf_dir):
    """Two runs compared place by place, up to the end of the shorter one: each field that differs is a row."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    t = phrases(spark, sf_dir)
    of = lambda p, text, kind: p.select("doc_id", place.alias("i"), F.struct(F.sha2(text, 256).alias("text"), kind.alias("type"), F.substring("type", 1, 4).alias("section")).alias("x"))
    a = of(t, F.col("text"), F.col("type")).withColumnRenamed("x", "a")
    b = of(t.where("pos % 29 <> 3"), F.when(F.col("pos") % 7 == 0, F.concat("text", F.lit("。"))).otherwise(F.col("text")), F.when(F.col("pos") % 5 == 0, "body").otherwise(F.col("type"))).withColumnRenamed("x", "b")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after")) for f in ("text", "type", "section")])
    d = a.join(b, ["doc_id", "i"]).select("doc_id", F.col("i").alias("paragraph"), F.inline(fields))
    return d.where(~F.col("before").eqNullSafe(F.col("after")))


_HASH = "sha256(name || ':' || size::varchar)"


@query(f"""with m as ({MEMBERS_SQL}), a as (select doc_id, name, min({_HASH}) as h from m group by 1, 2), b as (select doc_id, name, min(sha256(name || ':' || (case when part % 6 = 0 then size + 1 else size end)::varchar)) as h from m where part % 10 <> 0 group by 1, 2
  union all select doc_id, 'word/new.xml', 'added' from m group by doc_id having doc_id % 5 = 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.name, b.name) as name, case when a.h is null then 'added' when b.h is null then 'removed' else 'changed' end as status from a full join b on a.doc_id = b.doc_id and a.name = b.name where a.h is distinct from b.h""")
def package_equivalence(spark, sf_dir):
    """Two packages by the digests of their parts: what was added, removed or changed."""
    m = members(spark, sf_dir)
    digest = lambda size: F.min(F.sha2(F.concat("name", F.lit(":"), size.cast("string")), 256)).alias("h")
    a = m.groupBy("doc_id", "name").agg(digest(F.col("size")))
    b = m.where("part % 10 <> 0").groupBy("doc_id", "name").agg(digest(F.when(F.col("part") % 6 == 0, F.col("size") + 1).otherwise(F.col("size"))))
    new = m.where("doc_id % 5 = 0").select("doc_id").distinct().select("doc_id", F.lit("word/new.xml").alias("name"), F.lit("added").alias("h"))
    j = a.join(b.unionByName(new).withColumnRenamed("h", "other"), ["doc_id", "name"], "full")
    status = F.when(F.col("h").isNull(), "added").when(F.col("other").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("h").eqNullSafe(F.col("other"))).select("doc_id", "name", status.alias("status"))


@query(f"with m as ({MEMBERS_SQL}) select doc_id, count(*) as parts, count_if(name like '%.xml')::bigint as xml_parts, count_if(name like '%.rels')::bigint as relationship_parts, coalesce(sum(size) filter (name like '%.rels'), 0)::bigint as relationship_bytes from m group by 1")
def integrity_counts(spark, sf_dir):
    """Counts of an integrity report: parts, XML parts, relationship parts."""
    rels = F.col("name").endswith(".rels")
    return members(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("parts"), F.count_if(F.col("name").endswith(".xml")).alias("xml_parts"), F.count_if(rels).alias("relationship_parts"), F.coalesce(F.sum(F.when(rels, F.col("size"))), F.lit(0)).alias("relationship_bytes"))


@query(f"with t as ({PHRASES_SQL}), c as (select doc_id, type, count(*) as n from t group by 1, 2) select doc_id, list({{'type': type, 'n': n}} order by n desc, type) as types from c group by 1")
def type_counts(spark, sf_dir):
    """How often each type occurs in a document, the most frequent first."""
    c = phrases(spark, sf_dir).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n")))
    return c.groupBy("doc_id").agg(F.transform(ranked, lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("types"))


# In integers, as DuckDB divides in doubles: the quotient goes up beyond a half, and at a half if it is odd.
_EVEN = "({n} // {d} + case when 2 * ({n} % {d}) > {d} or (2 * ({n} % {d}) = {d} and {n} // {d} % 2 = 1) then 1 else 0 end)"


@query(f"with t as ({TASKS_SQL}), s as (select ip, count(*)::bigint as total, count_if(status = 'done')::bigint as done, coalesce(sum(duration), 0)::bigint as d from t group by 1) select ip, total, done, {_EVEN.format(n='(done * 1000)', d='total')} / 10.0::double as rate, {_EVEN.format(n='d', d='10')} / 100.0::double as seconds from s")
def payload_rounding(spark, sf_dir):
    """Numbers as a report shows them, halves to even: rate in percent with one digit, seconds with two."""
    t = tasks(spark, sf_dir).groupBy("ip").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.coalesce(F.sum("duration"), F.lit(0)).alias("d"))
    rate, seconds = F.col("done") * 100 / F.col("total"), F.col("d").cast("decimal(20,6)") / 1000
    return t.select("ip", "total", "done", F.bround(rate, 1).alias("rate"), F.bround(seconds, 2).cast("double").alias("seconds"))
