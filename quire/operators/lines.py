"""The paragraph stream: offsets, neighbours, duplicates, spans, windows of text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.plans.registry import query
from quire.sources.scratch import stored
from quire.sources.tables import LINES_SQL, lines, table

L = f"with l as ({LINES_SQL})"


def in_doc():
    return W.partitionBy("doc_id")


def in_order():
    return in_doc().orderBy("pos")


@query(f"{L} select doc_id, pos, length(text) as n_chars, length(text) > 0 as visible from l")
def doc_lines(spark, sf_dir):
    """Documents as lines with their lengths."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.length("text").cast("bigint").alias("n_chars"), (F.length("text") > 0).alias("visible"))


_START = "coalesce(sum(length(text) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint"


@query(f"{L} select doc_id, pos, {_START} as start, ({_START} + length(text))::bigint as stop, length(text)::integer as utf16 from l")
def line_offsets_utf16(spark, sf_dir):
    """Code-point offsets of every line and its length in UTF-16 units."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines(spark, sf_dir).select("doc_id", "pos", before.alias("start"), (before + F.length("text")).alias("stop"), P.utf16_length(F.col("text")).alias("utf16"))


_PREV = "coalesce(last_value(case when trim(text) <> '' then sha256(text) end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), '')"
_NEXT = "coalesce(first_value(case when trim(text) <> '' then sha256(text) end ignore nulls) over (partition by doc_id order by pos rows between 1 following and unbounded following), '')"


@query(f"{L} select doc_id, pos, sha256(text) as digest, {_PREV} as previous, {_NEXT} as next from l")
def line_next_prev_hash(spark, sf_dir):
    """Digests of the nearest lines with text on both sides."""
    seen = F.when(F.trim("text") != "", F.sha2("text", 256))
    previous = F.last(seen, True).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    following = F.last(seen, True).over(in_doc().orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1))
    return lines(spark, sf_dir).select("doc_id", "pos", F.sha2("text", 256).alias("digest"), F.coalesce(previous, F.lit("")).alias("previous"), F.coalesce(following, F.lit("")).alias("next"))


@query(f"{L} select doc_id, pos, row_number() over (partition by doc_id, text order by pos) - 1 as occurrence, count(*) over (partition by doc_id, text) as times from l where trim(text) <> ''")
def duplicate_occurrence_index(spark, sf_dir):
    """Which occurrence of an equal paragraph a line is, within its document."""
    # Two hashes stand for the line, so that the shuffle carries no text.
    same = W.partitionBy("doc_id", "h1", "h2")
    return lines(spark, sf_dir).where(F.trim("text") != "").select("doc_id", "pos", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).select("doc_id", "pos", (F.row_number().over(same.orderBy("pos")) - 1).cast("bigint").alias("occurrence"), F.count("*").over(same).alias("times"))


@query(f"{L}, s as (select doc_id, pos, seg, idx from (select doc_id, pos, unnest(string_split(text, '. ')) as seg, generate_subscripts(string_split(text, '. '), 1) - 1 as idx from l)) select doc_id, pos, idx::integer as segment_index, count(*) over (partition by doc_id, pos) as segment_count, length(seg)::bigint as n_chars, coalesce(sum(length(seg) + 2) over (partition by doc_id, pos order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start from s")
def segment_ordinals(spark, sf_dir):
    """Segments of a physical line: ordinal, count and offset within it."""
    own = W.partitionBy("doc_id", "pos")
    s = lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split("text", r"\. ", -1)).alias("segment_index", "seg"))
    start = F.coalesce(F.sum(F.length("seg") + 2).over(own.orderBy("segment_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return s.select("doc_id", "pos", "segment_index", F.count("*").over(own).alias("segment_count"), F.length("seg").cast("bigint").alias("n_chars"), start.alias("start"))


@query(f"{L}, o as (select doc_id, pos, text, {_START} as start from l), c as (select *, coalesce(lag(start + length(text)) over (partition by doc_id order by pos), -1) as before from o) select c.doc_id, count(*) as segments, (count_if(start <= before and pos > 0))::bigint as overlaps, (sum(length(c.text)) + count(*) - 1 = any_value(length(d.text)))::boolean as conserved from c join documents d on c.doc_id = d.doc_id group by c.doc_id")
def span_conservation_violations(spark, sf_dir):
    """Per document: spans in order, without overlap, and no character lost."""
    o = lines(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = o.withColumn("before", F.lag(F.col("start") + F.length("text")).over(in_order()))
    spans = c.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(F.col("start") <= F.col("before")).alias("overlaps"), F.sum(F.length("text")).alias("n"))
    whole = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("all"))
    return spans.join(whole, "doc_id").select("doc_id", "segments", "overlaps", (F.col("n") + F.col("segments") - 1 == F.col("all")).alias("conserved"))


_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "url": r"(https?://|ftp://|www\.)[^\s<>\"]+",
    "version": r"[0-9]+(\.[0-9]+)+",
}


@query("select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::integer as {k}" for k, p in _KINDS.items()) + " from documents")
def protected_span_counts(spark, sf_dir):
    """How many spans of each kind a document has in which punctuation must stay."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(k) for k, p in _KINDS.items()])


@query("select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, position('?' in url) > 0 as has_query, not (regexp_extract(url, '^https?://([^/:?#]+)', 1) like '%.example.com') as outside from pages")
def external_relationships(spark, sf_dir):
    """External targets by parts, without query or fragment, and whether policy calls them outside."""
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), host.alias("host"), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1).alias("path"), (F.instr(url, "?") > 0).alias("has_query"), (~host.endswith(".example.com")).alias("outside"))


_CUM = "sum(case when length(text) = 0 then 1 else 0 end) over (partition by doc_id order by pos)"


@query(f"{L}, c as (select doc_id, pos, text, ({_CUM})::bigint as breaks from l), v as (select * from c where length(text) > 0) select doc_id, pos, breaks <> lag(breaks, 1, breaks) over (partition by doc_id order by pos) as boundary_before from v")
def boundary_prefix_flag(spark, sf_dir):
    """Whether a break stands between a line and the one before: a difference of prefix sums."""
    c = lines(spark, sf_dir).withColumn("breaks", F.sum((F.length("text") == 0).cast("int")).over(in_order())).where(F.length("text") > 0)
    return c.select("doc_id", "pos", (F.col("breaks") != F.coalesce(F.lag("breaks").over(in_order()), F.col("breaks"))).alias("boundary_before"))


@query(f"{L} select doc_id, pos, lag(length(text)) over w as before, lead(length(text)) over w as after, coalesce(len(list(length(text)) over (partition by doc_id order by pos rows between 1 following and 8 following)), 0)::integer as ahead, (sum(length(text)) over (partition by doc_id order by pos rows between 12 preceding and 8 following))::bigint as near from l window w as (partition by doc_id order by pos)")
def neighbour_features(spark, sf_dir):
    """Previous and next lines, a look-ahead of eight, and a bounded neighbourhood."""
    n = F.length("text").cast("bigint")
    return lines(spark, sf_dir).select("doc_id", "pos", F.lag(n).over(in_order()).alias("before"), F.lead(n).over(in_order()).alias("after"), F.size(F.collect_list("pos").over(in_order().rowsBetween(1, 8))).alias("ahead"), F.sum(n).over(in_order().rowsBetween(-12, 8)).alias("near"))


@query("select doc_id, substr(text, 101, 200) as window_text, length(text) as total, greatest(0, least(200, length(text) - 100)) as n from documents")
def content_window(spark, sf_dir):
    """A bounded window of a book's text."""
    n = F.length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 101, 200).alias("window_text"), n.alias("total"), F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(200).cast("bigint"), n - 100)).alias("n"))


@query(f"{L}, o as (select doc_id, pos, text, {_START} as start from l), v as (select doc_id, pos, start, lead(start) over (partition by doc_id order by pos) as next_start, lag(start) over (partition by doc_id order by pos) as previous_start from o where trim(text) <> '') select doc_id, max(start)::bigint as at, (arg_max(struct_pack(v := next_start), start)).v::bigint as next_start, (arg_max(struct_pack(v := previous_start), start)).v::bigint as previous_start from v where start <= 500 group by doc_id")
def paragraph_target(spark, sf_dir):
    """From offset 500 of a text, the paragraph it lies in and the non-empty ones beside it."""
    o = lines(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    v = o.where(F.trim("text") != "").withColumn("ns", F.lead("start").over(in_order())).withColumn("ps", F.lag("start").over(in_order())).where("start <= 500")
    # max_by skips no NULL value, so the row at the largest start decides.
    return v.groupBy("doc_id").agg(F.max_by(F.struct("start", "ns", "ps"), "start").alias("r")).select("doc_id", F.col("r.start").alias("at"), F.col("r.ns").alias("next_start"), F.col("r.ps").alias("previous_start"))


@query(f"{L} select doc_id, pos, sha256(coalesce(lag(text) over w, '') || '|' || coalesce(lead(text) over w, '')) as fingerprint from l window w as (partition by doc_id order by pos)")
def neighbour_fingerprint(spark, sf_dir):
    """Digest of the lines on both sides."""
    side = lambda c: F.coalesce(c, F.lit(""))
    return lines(spark, sf_dir).select("doc_id", "pos", F.sha2(F.concat(side(F.lag("text").over(in_order())), F.lit("|"), side(F.lead("text").over(in_order()))), 256).alias("fingerprint"))


@query(f"{L} select a.doc_id, a.pos, count(b.pos)::bigint as candidates, min(b.pos)::integer as first_candidate from l a left join (select doc_id, pos + 1 as pos, text from l) b on a.doc_id = b.doc_id and a.text = b.text where trim(a.text) <> '' group by 1, 2")
def alignment_hash_candidates(spark, sf_dir):
    """Host paragraphs with the same text digest as a plan paragraph: the pre-filter of the alignment."""
    l = lines(spark, sf_dir).where(F.trim("text") != "").select("doc_id", "pos", F.sha2("text", 256).alias("h"))  # noqa: E741
    host = l.groupBy("doc_id", "h").agg(F.count("*").alias("candidates"), (F.min("pos") + 1).cast("int").alias("first_candidate"))
    return l.join(host, ["doc_id", "h"]).select("doc_id", "pos", "candidates", "first_candidate")


@query(f"{L}, a as (select doc_id, pos, text from l), b as (select doc_id, pos, case when pos % 5 = 1 then replace(text, 'a', 'A') when pos % 7 = 2 then text || ' ' else text end as text from l where pos % 11 <> 3) select coalesce(case when b.pos is null then 'missing' when trim(a.text) = trim(b.text) then 'space' when lower(a.text) = lower(b.text) then 'case' else 'text' end) as category, case when b.pos is null then 'P1' when trim(a.text) = trim(b.text) then 'P3' else 'P2' end as severity, count(*) as n, count(distinct a.doc_id) as docs from a left join b on a.doc_id = b.doc_id and a.pos = b.pos where b.pos is null or a.text <> b.text group by 1, 2")
def snapshot_diff_severity(spark, sf_dir):
    """Two versions compared paragraph by paragraph: category and severity of every difference, counted."""
    a = lines(spark, sf_dir)
    changed = F.when(F.col("pos") % 5 == 1, F.replace("text", F.lit("a"), F.lit("A"))).when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    b = a.where("pos % 11 <> 3").select("doc_id", "pos", changed.alias("other"))
    d = a.join(b, ["doc_id", "pos"], "left").where(F.col("other").isNull() | (F.col("text") != F.col("other")))
    gone, space = F.col("other").isNull(), F.trim("text") == F.trim("other")
    kind = F.when(gone, "missing").when(space, "space").when(F.lower("text") == F.lower("other"), "case").otherwise("text")
    return d.groupBy(kind.alias("category"), F.when(gone, "P1").when(space, "P3").otherwise("P2").alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"{L}, b as (select doc_id, pos, case when pos % 4 = 0 then replace(text, 'a', 'A') else text end as text from l where pos % 9 <> 8) select coalesce(l.doc_id, b.doc_id) as doc_id, coalesce(l.pos, b.pos) as pos, case when b.pos is null then 'remove' else 'replace' end as action, sha256(coalesce(l.text, '')) as before, sha256(coalesce(b.text, '')) as after from l full outer join b on l.doc_id = b.doc_id and l.pos = b.pos where coalesce(l.text, '') <> coalesce(b.text, '')")
def change_ledger(spark, sf_dir):
    """Ledger of applied changes: a full outer join of both versions, padded with empty text."""
    l = lines(spark, sf_dir)  # noqa: E741
    b = l.where("pos % 9 <> 8").select("doc_id", "pos", F.when(F.col("pos") % 4 == 0, F.replace("text", F.lit("a"), F.lit("A"))).otherwise(F.col("text")).alias("after"))
    both = l.join(b, ["doc_id", "pos"], "full_outer")
    old, new = F.coalesce("text", F.lit("")), F.coalesce("after", F.lit(""))
    return both.where(old != new).select("doc_id", "pos", F.when(F.col("after").isNull(), "remove").otherwise("replace").alias("action"), F.sha2(old, 256).alias("before"), F.sha2(new, 256).alias("after"))


@query("select doc_id, lower(sha256(text)) as digest, substr(sha256(text), 1, 12) as preview, 'doc_' || substr(sha256(lang || ':' || source || ':' || doc_id), 1, 32) as stable_id, length(text) as n from documents")
def stable_ids(spark, sf_dir):
    """Digests, previews and stable ids: outputs carry hashes, not text."""
    h = F.sha2("text", 256)
    own = F.sha2(F.concat_ws(":", "lang", "source", "doc_id"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("digest"), F.substring(h, 1, 12).alias("preview"), F.concat(F.lit("doc_"), F.substring(own, 1, 32)).alias("stable_id"), F.length("text").cast("bigint").alias("n"))


_ISSUES = [("empty_text", "trim(text) = ''"), ("length_mismatch", "length(text) <> n_chars"), ("unknown_language", "lang not in ('en', 'fr')"), ("long_text", "length(text) > 5000")]


@query(" union all ".join(f"select '{c}' as code, '/documents/' || doc_id as path, '{'error' if i < 2 else 'warning'}' as severity from documents where {w}" for i, (c, w) in enumerate(_ISSUES)))
def contract_issues(spark, sf_dir):
    """Semantic checks of records as issue rows: code, path, severity."""
    d = table(spark, sf_dir, "documents")
    checks = F.array_compact(F.array(*[F.when(F.expr(w), F.struct(F.lit(c).alias("code"), F.lit("error" if i < 2 else "warning").alias("severity"))) for i, (c, w) in enumerate(_ISSUES)]))
    return d.select("doc_id", F.explode(checks).alias("i")).select("i.code", F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")).alias("path"), "i.severity")


@query("select story as story_type, count(*) as paragraphs, count_if(in_table)::bigint as table_paragraphs, count(distinct snapshot) as snapshots, sum(n)::bigint as chars from (select conv_id as snapshot, role as story, turn % 3 = 2 as in_table, length(text) as n from conversations) group by 1")
def host_snapshot_summary(spark, sf_dir):
    """Paragraphs of a live editor by story."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("role").alias("story_type")).agg(F.count("*").alias("paragraphs"), F.count_if(F.col("turn") % 3 == 2).alias("table_paragraphs"), F.count_distinct("conv_id").alias("snapshots"), F.sum(F.length("text")).alias("chars"))


@query("select conv_id as snapshot_id, turn as host_index, row_number() over (partition by conv_id order by turn) - 1 as story_index, sha256(text) as digest from conversations where role = 'user' and turn % 3 <> 2")
def host_main_story(spark, sf_dir):
    """Host paragraphs that can be bound: main story, outside tables."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' and turn % 3 <> 2")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select(F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("host_index"), place.cast("bigint").alias("story_index"), F.sha2("text", 256).alias("digest"))


@query("with recursive e as (select distinct l_partkey as a, l_suppkey as b from lineitem), r(n) as (select cast(1 as bigint) union select e.b from r join e on e.a = r.n) select n as part from r")
def package_reachability(spark, sf_dir):
    """Parts that relationships reach from the root, level by level."""
    edges = stored(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct())
    found = front = spark.createDataFrame([(1,)], "part bigint")
    while True:  # a round for each level; only what is new is followed
        front = stored(edges.join(front, edges.a == front.part).select(F.col("b").alias("part")).distinct().join(found, "part", "left_anti"))
        if front.isEmpty():
            return found
        found = found.union(front)


@query("with r as (select l_orderkey as source, l_linenumber as id, case when l_partkey % 10 < 9 then l_partkey end as target from lineitem) select 'unreferenced' as kind, p_partkey as part, 0::bigint as relationships from part where not exists (select 1 from r where target = p_partkey) union all select 'without_target', source % 100, count(*) from r where target is null group by 2")
def relationship_dangling(spark, sf_dir):
    """Parts that no relationship refers to, and relationships without a target counted by their source; all relationships are looked at."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.when(F.col("l_partkey") % 10 < 9, F.col("l_partkey")).alias("target"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    unused = part.join(r.where("target is not null"), F.col("part") == F.col("target"), "left_anti").select(F.lit("unreferenced").alias("kind"), "part", F.lit(0).cast("bigint").alias("relationships"))
    return unused.union(r.where("target is null").groupBy((F.col("source") % 100).alias("part")).agg(F.count("*").alias("relationships")).select(F.lit("without_target"), "part", "relationships"))


@query("with r as (select l_orderkey as doc_id, l_linenumber as n, l_suppkey % 5 as font, cast(l_quantity as bigint) as weight, l_tax > 0.04 as bold from lineitem), f as (select doc_id, font, sum(weight)::bigint as w, min(n) as first from r group by 1, 2), t as (select doc_id, sum(weight)::bigint as total, (sum(case when bold then weight else 0 end))::bigint as bold_weight, count(distinct font) > 1 as mixed_font from r group by 1) select t.doc_id, arg_max(f.font, (f.w * 100 - f.first) * 10 - f.font) as font, t.total, t.bold_weight, t.mixed_font from t join f on t.doc_id = f.doc_id group by t.doc_id, t.total, t.bold_weight, t.mixed_font")
def segment_format_weights(spark, sf_dir):
    """Weighted mode of a segment's fonts (the first seen wins a tie) and its bold share, from formatted runs."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 5).alias("font"), F.col("l_quantity").cast("bigint").alias("weight"), (F.col("l_tax") > 0.04).alias("bold"))
    f = r.groupBy("doc_id", "font").agg(F.sum("weight").alias("w"), F.min("n").alias("first"), F.sum(F.when(F.col("bold"), F.col("weight")).otherwise(0)).alias("b"))
    return f.groupBy("doc_id").agg(F.max_by("font", F.struct("w", -F.col("first"), -F.col("font"))).alias("font"), F.sum("w").alias("total"), F.sum("b").alias("bold_weight"), (F.count("*") > 1).alias("mixed_font"))


@query("with s as (select c_mktsegment as style, c_custkey as id, (c_custkey - 1) as base, case when c_custkey % 4 = 0 then c_nationkey end as size from customer), b as (select s.id, coalesce(s.size, p1.size, p2.size, p3.size, 16)::integer as size from s left join s p1 on s.base = p1.id left join s p2 on p1.base = p2.id left join s p3 on p2.base = p3.id) select id as style_id, size from b")
def effective_format(spark, sf_dir):
    """A format value from the nearest style of the basedOn chain that has one, else the default."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("size"))
    # (id, at, size): the ancestor reached so far and what was found up to it. A round doubles the reach: the
    # ancestor's own row is joined. Rows with a value or without an ancestor are settled; a cycle ends with its length.
    out = stored(s.select("id", (F.col("id") - 1).alias("at"), "size"))
    for _ in range(64):
        open_ = F.col("size").isNull() & F.col("at").isNotNull()
        if out.where(open_).isEmpty():
            break
        up = out.select(F.col("id").alias("k"), F.col("at").alias("above"), F.col("size").alias("inherited"))
        going = out.where(open_).join(up, F.col("at") == F.col("k"), "left")
        out = stored(out.where(~open_).union(going.select("id", F.col("above").alias("at"), F.col("inherited").alias("size"))))
    return out.select(F.col("id").alias("style_id"), F.coalesce("size", F.lit(16)).alias("size"))
