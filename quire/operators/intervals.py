"""Interval join of two tables of spans, and what formatted runs give the segments that they meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.plans.registry import query
from quire.sources.tables import table

PER_BIN, CONFIRMED = 64, 0.80
FONTS, SIZES = ("宋体", "黑体", ""), (16.0, 18.0, 15.0)


def _upto(borders: Column, x: Column) -> Column:
    """How many of the sorted borders are at most x, by halving."""
    zero = F.struct(F.lit(0).alias("low"), F.size(borders).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, up = at["low"] < at["high"], F.get(borders, mid) <= x
        return F.struct(F.when(open_ & up, mid + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~up, mid).otherwise(at["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(borders))))
    return F.when(borders.isNull(), 0).otherwise(F.aggregate(steps, zero, halve)["low"])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], per_bin: int = PER_BIN) -> DataFrame:
    """Every pair of a left and a right row of one key whose spans [start, end) meet, with the columns of both (the key once).

    About one start in per_bin, of both sides, is a border of the key's bins, so bins are narrow where spans are
    dense and a key with many rows has many. A span stands in all bins that it meets; a long one
    stands in as many as it has partners for. A pair is made in the bin in which the later of its two starts lies, and only there.
    Spans of no length meet nothing; a null key matches nothing.
    """
    starts = left.select(F.col(key).alias("b_key"), F.col(left_span[0]).alias("at")).union(right.select(key, right_span[0]))
    borders = starts.where((F.pmod(F.xxhash64("b_key", "at"), F.lit(per_bin)) == 0) & F.col("b_key").isNotNull()).groupBy("b_key").agg(F.sort_array(F.collect_set("at")).alias("borders"))

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        met = df.where(F.col(span[0]) < F.col(span[1])).join(borders, F.col(key) == F.col("b_key"), "left")
        met = met.withColumns({f"{name}_first": _upto(F.col("borders"), F.col(span[0])), f"{name}_last": _upto(F.col("borders"), F.col(span[1]) - 1)})
        return met.withColumn(f"{name}_bin", F.explode(F.sequence(f"{name}_first", f"{name}_last"))).drop("b_key", "borders", f"{name}_last")

    a, b = dealt(left, left_span, "l"), dealt(right, right_span, "r").withColumnRenamed(key, "r_key")
    return a.join(b, (F.col(key) == F.col("r_key")) & (F.col("l_bin") == F.col("r_bin")) & (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0])) & (F.greatest("l_first", "r_first") == F.col("l_bin"))).drop("r_key", "l_bin", "r_bin", "l_first", "r_first")


# Runs are the sentences of a document's whole text, with formats by place and length; they do not stop at lines. Each 17th
# says another text than stands there.
_PIECES = "(select doc_id, unnest(string_split(text, '. ')) as piece, generate_subscripts(string_split(text, '. '), 1) - 1 as n, len(string_split(text, '. ')) as pieces, text from documents)"
_RUNS_SQL = f"""pieces as (select doc_id, text, n, case when n < pieces - 1 then piece || '. ' else piece end as own from {_PIECES}),
cursor as (select *, sum(length(own)) over (partition by doc_id order by n) - length(own) as a, case when n % 17 = 5 then upper(own) else own end as said from pieces),
runs as (select doc_id, n, a::bigint as a, (a + length(own))::bigint as b, own, said = substr(text, a::bigint + 1, length(own)) as matches, length(regexp_replace(own, '[ \\t\\n\\r\\f\\v]', '', 'g')) > 0 as shown,
  ['{FONTS[0]}', '{FONTS[1]}', ''][(n + length(own)) % 3 + 1] as font, [{', '.join(map(str, SIZES))}][(n + length(own)) % 3 + 1]::double as size, n % 5 <> 4 as sized, length(own) % 4 = 0 as bold, n % 4 = 0 as italic, n % 3 = 0 as explicit, length(own) % 7 <> 0 as known from cursor)"""
_LINES_SQL = """segments as (select doc_id, pos, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as s, length(line) as n, whole from
  (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, length(text) as whole from documents))"""


def _places(parts: pa.Array, text: pa.Array) -> pa.Array:
    """Of every row array<struct(a, b, there)>: where its parts lie one behind the other, and what the text has there."""
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pc.utf8_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    ends, first = np.concatenate([[0], ends]), np.concatenate([[0], sizes.cumsum()])
    base = np.repeat(ends[first[:-1]], sizes)
    a, b = ends[:-1] - base, ends[1:] - base
    there = (whole[x:y] for whole, i, j in zip((t.as_py() or "" for t in text), first, first[1:]) for x, y in zip(a[i:j].tolist(), b[i:j].tolist()))
    rows = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(there, pa.string(), size=len(a))], ["a", "b", "there"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows, mask=parts.is_null() if parts.null_count else None)


def _places_of(parts: Column, text: Column) -> Column:
    return F.arrow_udf(_places, "array<struct<a:bigint,b:bigint,there:string>>")(parts, text)


def cursor(pieces: DataFrame, said: Column) -> DataFrame:
    """Runs (doc_id, n, own) of (doc_id, text, owns) with the places (a, b) that a cursor over their lengths gives them; a run whose text is not what stands there is marked.

    A text is read in its own row, which holds all its runs: it is neither copied to them nor shuffled.
    """
    placed = pieces.withColumn("places", _places_of(F.col("owns"), F.col("text")))
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("owns", "places")).alias("n", "x"))
    rows = rows.select("doc_id", "n", F.col("x.owns").alias("own"), F.col("x.places.b").alias("b"), F.col("x.places.a").alias("a"), F.col("x.places.there").alias("there"))
    return rows.withColumn("matches", said == F.col("there")).drop("there").withColumn("shown", P.visible_length(F.col("own")) > 0)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.split("text", r"\. ", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", pieces.alias("p"))
    d = d.select("doc_id", "text", F.transform("p", lambda x, i: F.when(i < F.size("p") - 1, F.concat(x, F.lit(". "))).otherwise(x)).alias("owns"))
    at, n = (F.col("n") + F.length("own")) % 3, F.col("n")
    size = F.get(F.array(*map(F.lit, SIZES)), at)
    return cursor(d, F.when(n % 17 == 5, F.upper("own")).otherwise(F.col("own"))).withColumns({
        "font": F.get(F.array(*map(F.lit, FONTS)), at), "size": F.when(n % 5 != 4, size), "bold": F.length("own") % 4 == 0, "italic": n % 4 == 0, "explicit": n % 3 == 0, "known": F.length("own") % 7 != 0,
    })


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, s, e, whole): the lines of each text with their places and the text's length."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("bigint").alias("whole"), F.split("text", "\n", -1).alias("l"))
    # Every line but the last with its end, so that they lie one behind the other.
    ended = F.transform("l", lambda x, i: F.when(i < F.size("l") - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    rows = lines.select("doc_id", "whole", F.size("l").alias("n"), F.posexplode(F.transform(_places_of(ended, F.lit("")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))).alias("pos", "x"))
    return rows.select("doc_id", "pos", F.col("x.a").alias("s"), (F.col("x.b") - F.when(F.col("pos") < F.col("n") - 1, 1).otherwise(0)).alias("e"), "whole")


@query(f"with {_RUNS_SQL} select doc_id, count(*) as runs, count_if(shown and matches)::bigint as kept, count_if(not matches)::bigint as mismatched, arg_min(font, n) filter (where shown) as first_font, arg_min(bold, n) filter (where shown) as first_bold from runs group by 1")
def physical_runs(spark, sf_dir):
    """Formatted runs placed by a cursor over their lengths: how many are kept, and the format of the first visible one."""
    first = lambda c: F.min_by(c, F.when(F.col("shown"), F.col("n")))
    return runs(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("runs"), F.count_if(F.col("shown") & F.col("matches")).alias("kept"), F.count_if(~F.col("matches")).alias("mismatched"), first("font").alias("first_font"), first("bold").alias("first_bold"))


@query(f"with {_RUNS_SQL}, {_LINES_SQL} select g.doc_id, g.pos::integer as segment, count(*) as runs, sum(least(r.b, g.s + g.n) - greatest(r.a, g.s))::bigint as overlap from runs r join segments g on r.doc_id = g.doc_id and r.a < g.s + g.n and r.b > g.s group by 1, 2")
def run_segment_overlap(spark, sf_dir):
    """Interval join of formatted runs with a document's lines: runs and overlapping characters of each line."""
    met = interval_join(runs(spark, sf_dir).drop("own"), segments(spark, sf_dir), "doc_id", ("a", "b"), ("s", "e"))
    return met.groupBy("doc_id", F.col("pos").alias("segment")).agg(F.count("*").alias("runs"), F.sum(F.least("b", "e") - F.greatest("a", "s")).alias("overlap"))


def _share(part: str) -> Column:
    return F.when(F.col("chars") > 0, F.col(part) / F.col("chars")).otherwise(0.0)


def segment_features(formatted: DataFrame, places: DataFrame) -> DataFrame:
    """Per segment the formats of the runs that it meets, weighted by the visible characters shared: dominant font (the first seen of equals), mean size, shares, coverage and status."""
    met = interval_join(formatted.where("shown and matches"), places, "doc_id", ("a", "b"), ("s", "e"))
    shared = F.substring(F.col("own"), (F.greatest("a", "s") - F.col("a") + 1).cast("int"), (F.least("b", "e") - F.greatest("a", "s")).cast("int"))
    met = met.withColumn("chars", P.visible_length(shared).cast("bigint")).where("chars > 0")
    total = lambda c: F.sum(F.when(F.col(c), F.col("chars")).otherwise(0)).alias(c)
    fonts = met.groupBy("doc_id", "pos", "font").agg(
        F.min("a").alias("first"), F.count("*").alias("runs"), F.sum("chars").alias("chars"), *[total(c) for c in ("bold", "italic", "explicit", "known")],
        F.sum(F.when(F.col("size").isNotNull(), F.col("chars"))).alias("weight"), F.sum(F.col("size") * F.col("chars")).alias("sizes"), F.min("size").alias("low"), F.max("size").alias("high"),
    )
    named = F.col("font") != ""
    sums = fonts.groupBy("doc_id", "pos").agg(
        F.max_by("font", F.when(named, F.struct("chars", -F.col("first")))).alias("font"), (F.count_if(named) > 1).alias("mixed_fonts"), *[F.sum(c).alias(c) for c in ("runs", "chars", "bold", "italic", "explicit", "known", "weight", "sizes")],
        (F.min("low") < F.max("high")).alias("mixed_sizes"),
    )
    out = places.select(F.col("doc_id").alias("d"), F.col("pos").alias("segment"), "s", "e", "whole").join(sums, (F.col("d") == F.col("doc_id")) & (F.col("segment") == F.col("pos")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    place = F.when((F.col("s") == 0) & (F.col("e") == F.col("whole")), "whole").when(F.col("s") == 0, "start").when(F.col("e") == F.col("whole"), "end").otherwise("middle")
    share = F.coalesce(_share("known"), F.lit(0.0))
    status = F.when(F.col("chars").isNull(), "unknown").when(share >= CONFIRMED, "confirmed").when(share > 0, "review").otherwise("unknown")
    warning = F.when(F.col("chars").isNull(), "NO_VISIBLE_RUN_FORMAT_COVERAGE").when(status == "review", "PARTIAL_RUN_FORMAT_COVERAGE").when(status == "unknown", "NO_RUN_FORMAT_COVERAGE")
    return out.select(
        F.col("d").alias("doc_id"), "segment", zero(F.col("runs")).alias("runs"), zero(F.col("chars")).alias("chars"), "font", (F.col("sizes") / F.when(F.col("weight") > 0, F.col("weight"))).alias("size"),
        *[F.coalesce(_share(c), F.lit(0.0)).alias(f"{c}_share") for c in ("bold", "italic", "explicit")], share.alias("coverage"), F.coalesce("mixed_fonts", F.lit(False)).alias("mixed_fonts"), F.coalesce("mixed_sizes", F.lit(False)).alias("mixed_sizes"),
        place.alias("place"), status.alias("status"), warning.alias("warning"),
    )


@query(f"""with {_RUNS_SQL}, {_LINES_SQL}, met as (select g.doc_id, g.pos, r.a, r.font, case when r.sized then r.size end as size, r.bold, r.italic, r.explicit, r.known, length(regexp_replace(substr(r.own, greatest(r.a, g.s) - r.a + 1, least(r.b, g.s + g.n) - greatest(r.a, g.s)), '[ \\t\\n\\r\\f\\v]', '', 'g'))::bigint as chars
  from runs r join segments g on r.doc_id = g.doc_id and r.a < g.s + g.n and r.b > g.s where r.shown and r.matches),
fonts as (select doc_id, pos, font, sum(chars) as w, min(a) as first from met where chars > 0 and font <> '' group by 1, 2, 3), best as (select doc_id, pos, arg_max(font, (w, -first)) as font, count(*) > 1 as mixed from fonts group by 1, 2),
sums as (select doc_id, pos, count(*) as runs, sum(chars)::bigint as chars, {', '.join(f"coalesce(sum(chars) filter (where {c}), 0)::double / sum(chars) as {c}" for c in ('bold', 'italic', 'explicit', 'known'))}, sum(size * chars) / sum(chars) filter (where size is not null) as size, min(size) < max(size) as sizes from met where chars > 0 group by 1, 2)
select g.doc_id, g.pos::integer as segment, coalesce(s.runs, 0) as runs, coalesce(s.chars, 0) as chars, b.font, s.size, coalesce(s.bold, 0)::double as bold_share, coalesce(s.italic, 0)::double as italic_share, coalesce(s.explicit, 0)::double as explicit_share, coalesce(s.known, 0)::double as coverage, coalesce(b.mixed, false) as mixed_fonts, coalesce(s.sizes, false) as mixed_sizes,
  case when g.s = 0 and g.n = g.whole then 'whole' when g.s = 0 then 'start' when g.s + g.n = g.whole then 'end' else 'middle' end as place,
  case when s.chars is null then 'unknown' when s.known >= {CONFIRMED} then 'confirmed' when s.known > 0 then 'review' else 'unknown' end as status,
  case when s.chars is null then 'NO_VISIBLE_RUN_FORMAT_COVERAGE' when s.known >= {CONFIRMED} then null when s.known > 0 then 'PARTIAL_RUN_FORMAT_COVERAGE' else 'NO_RUN_FORMAT_COVERAGE' end as warning
from segments g left join sums s on g.doc_id = s.doc_id and g.pos = s.pos left join best b on g.doc_id = b.doc_id and g.pos = b.pos""")
def segment_format_features(spark, sf_dir):
    """Format of every line from the runs over it: dominant font, weighted size, shares by visible characters, coverage and how sure it is."""
    return segment_features(runs(spark, sf_dir), segments(spark, sf_dir))
