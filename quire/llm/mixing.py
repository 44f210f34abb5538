"""Mixing sources to target weights by Pareto order sampling (op12).

Sources in code-point order (null last) have the weights in turn. They share ``times`` of
all words by weight; a source's target stops at ``most`` times its words, and the excess
goes to the others by weight, until none is above.

A source's documents are first taken as many whole times as its target holds all its words.
What remains is a fraction of its words, sampled by Pareto order: a document has the rank
Q = odds(u) / (odds * odds(p)) with u uniform by its id and text, p its inclusion
probability, and the documents with the lowest ranks are taken. Samples have a fixed size in
each stratum, documents of one source and of almost one size (sixteen strata from a size to
its double). From the largest sizes down, a stratum's number is what the source still lacks
over the stratum's mean size, rounded at random, and what it takes too much or too little
goes to the next one; so the words that a source is given come near its target, while each
document keeps the expected number of copies. A very long document is taken or not, and
the shorter ones make up for it; one longer than all that its source still lacks is not
taken once more, as nothing could make up for that.

The lowest ranks of a stratum are found without a sort of the stratum: numbers of rows by cells of the
rank tell the cell of the last one taken, and only that cell, a few hundred rows, is ranked.

Edge cases: a null text has no words; documents without words are taken 0 words. A null
source is a source. A null id is kept. Rows that repeat both id and text are told apart only where the
sample's last rank falls on them. Extra columns pass through; empty tables give none. The same rows give the
same sample in any order and partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEED, fresh, keyed_join, materialize

WEIGHTS, TIMES, MOST, CELL = (5, 2, 1), 1.5, 2, 256
WORDS = r"[^\x20\x09-\x0D]+"


def _uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, that depends on the parts only."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def stratum(size: Column) -> Column:
    """Sixteen classes from each power of two to the next, by whole numbers only."""
    octave = F.length(F.bin(size)) - 1
    return (octave * 16 + F.call_function("shiftright", size * 16, octave)).cast("int")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with their place from 0 in the order of columns; each task numbers one range of them."""
    part, count, before = fresh(rows, "part", "count", "before")
    dealt = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count("*").alias(count))  # a row for each partition
    offsets = counts.select(F.col(part).alias(before + "p"), (F.sum(count).over(W.orderBy(part)) - F.col(count)).alias(before))
    place = F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(offsets), F.col(part) == F.col(before + "p")).withColumn(name, F.col(name) + F.col(before)).drop(part, before, before + "p")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, times: float = TIMES, most: float = MOST) -> DataFrame:
    """sources (none, source, words) with a double target.

    Every round gives up on the sources that are above what they can have; at least one is, or it is the last.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int"))
    known = materialize(numbered(sources, ["none", "source"], "place").select(*sources.columns, w.alias("w"), (F.col("words") * float(most)).alias("cap")))
    total, left = known.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    total, full = total * times, 0
    level = total / left if left else 0.0
    while left:
        above = F.col("cap") < F.col("w") * F.lit(level)
        n, spent, left = known.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        if n == full:
            break
        full, level = n, (total - spent) / left if left else math.inf
    return known.withColumn("target", F.least("cap", F.col("w") * F.lit(level))).drop("w", "cap")


def _numbers(strata: DataFrame) -> DataFrame:
    """strata (none, source, stratum, n, words, target, source_size) with base, the whole copies, and k, how many of the n are taken once more."""
    rows = strata.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    v = _uniform(F.coalesce("source", F.lit("")), F.col("none").cast("string"), F.col("stratum").cast("string"))
    rows = rows.withColumn("lack", F.col("target") - F.col("base") * F.col("source_size"))
    rows = rows.withColumn("share", F.when(F.col("source_size") > 0, F.col("lack") / F.col("source_size")).otherwise(0.0))
    # A source has a few hundred strata at most, as sizes double 63 times.
    lists = rows.groupBy("none", "source", "lack", "share").agg(F.sort_array(F.collect_list(F.struct("stratum", "n", "words", v.alias("v"))), asc=False).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        want = acc["want"] + acc["share"] * x["words"]
        mean = x["words"] / x["n"]
        k = F.coalesce(F.greatest(F.lit(0), F.least(x["n"], F.floor(F.try_divide(want, mean) + x["v"]), F.floor(F.try_divide(acc["left"], mean)))), F.lit(0))
        k = F.when(x["words"] > 0, k).otherwise(0).cast("long")
        return F.struct((want - k * mean).alias("want"), (acc["left"] - k * mean).alias("left"), acc["share"].alias("share"), F.concat(acc["out"], F.array(F.struct(x["stratum"].alias("stratum"), k.alias("k")))).alias("out"))

    zero = F.struct(F.lit(0.0).alias("want"), F.col("lack").alias("left"), F.col("share"), F.array().cast("array<struct<stratum:int,k:bigint>>").alias("out"))
    k = lists.select("none", "source", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("none", "source", F.col("x.stratum").alias("stratum"), F.col("x.k").alias("k"))
    return rows.join(k, ["none", "source", "stratum"])


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", odds: Column | None = None, weights: Sequence[float] = WEIGHTS, times: float = TIMES, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target and copies (long) in columns of their own names, found by ``columns``.

    odds: a positive factor of a document's odds within its stratum, 1 by default.
    """
    names = columns(docs)
    size_, whole_, target_, copies_ = names
    none, at, stratum_, u, f, h = fresh(docs.select("*", *[F.lit(0).alias(c) for c in names]), "none", "at", "stratum", "u", "f", "h")
    t = F.coalesce(docs[text], F.lit(""))
    sized = docs.withColumns({size_: F.regexp_count(t, F.lit(WORDS)).cast("long"), none: docs[source].isNull(), at: F.coalesce(docs[source], F.lit("")), h: F.md5(t), f: odds if odds is not None else F.lit(1.0)})
    sized = sized.withColumns({stratum_: F.when(F.col(size_) > 0, stratum(F.col(size_))).otherwise(-1), u: _uniform(F.coalesce(docs[key].cast("string"), F.lit("")), F.col(h))}).drop(h)
    small = materialize(sized.select(F.col(none).alias("none"), F.col(at).alias("source"), F.col(stratum_).alias("stratum"), F.col(size_).alias("size"), F.col(u).alias("u"), F.col(f).alias("f")))
    counts = materialize(small.groupBy("none", "source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    of = targets(counts.groupBy("none", "source").agg(F.sum("words").alias("words")), weights, times, most).withColumnRenamed("words", "source_size")
    strata = materialize(_numbers(counts.join(materialize(of), ["none", "source"])))
    last = _last(small, strata)
    known = materialize(strata.join(last, ["none", "source", "stratum"], "left").select(F.col("none").alias("k_none"), F.col("source").alias("k_source"), F.col("stratum").alias("k_stratum"), "n", "k", "base", "target", "source_size", "q", "ties", "room"))
    same = (F.col(none) == F.col("k_none")) & (F.col(at) == F.col("k_source")) & (F.col(stratum_) == F.col("k_stratum"))
    clash = [c for c in known.columns if c.lower() in {x.lower() for x in sized.columns}]
    known = known.withColumnsRenamed({c: c + "_of_stratum" for c in clash})
    col = lambda c: F.col(c + "_of_stratum" if c in clash else c)
    met = keyed_join(sized, known, same, "n_of_stratum" if "n" in clash else "n")
    q = rank(F.col(u), F.col(f), col("k"), col("n"))
    # Rows that share the last rank (repeated rows) are all taken where all have room.
    more = F.when(F.col(stratum_) < 0, False).when(col("k") >= col("n"), True).when(col("k") <= 0, False).otherwise((q < col("q")) | ((q == col("q")) & (col("ties") <= col("room"))))
    keep = [F.col(c) for c in docs.columns]
    result = [F.col(size_), col("source_size").alias(whole_), col("target").alias(target_)]
    copies = (col("base") + more.cast("long")).alias(copies_)
    if known.where(col("ties") > col("room")).isEmpty():
        return met.select(*keep, *result, copies)
    tied = (q == col("q")) & (col("ties") > col("room")) & (col("k") < col("n")) & (col("k") > 0)
    nth = F.row_number().over(W.partitionBy("k_none", "k_source", "k_stratum").orderBy(F.col(u)))
    some = met.where(tied).withColumn(u, nth)
    return met.where(~F.coalesce(tied, F.lit(False))).select(*keep, *result, copies).unionByName(some.select(*keep, *result, (col("base") + (F.col(u) <= col("room")).cast("long")).alias(copies_)))


def rank(u: Column, odds: Column, k: Column, n: Column) -> Column:
    """Random odds over inclusion odds, p being k / n; null where none is taken."""
    return (u / (F.lit(1.0) - u)) * F.try_divide((n - k).cast("double"), odds * k)


def _last(small: DataFrame, strata: DataFrame) -> DataFrame:
    """(none, source, stratum, q, ties, room) of the strata of which some but not all are taken: the last rank taken, how many rows have it, and how many of those are taken."""
    by = ["none", "source", "stratum"]
    part = materialize(strata.where("0 < k and k < n and stratum >= 0").select(*[F.col(c).alias("p_" + c) for c in by], "n", "k"))
    same = (F.col("none") == F.col("p_none")) & (F.col("source") == F.col("p_source")) & (F.col("stratum") == F.col("p_stratum"))
    q = rank(F.col("u"), F.col("f"), F.col("k"), F.col("n"))
    cell = F.floor(q / (F.lit(1.0) + q) * F.ceil(F.col("n") / CELL)).cast("long")
    ranked = materialize(keyed_join(small, part, same, "n").select(*by, "k", q.alias("q"), cell.alias("cell")))
    cells = ranked.groupBy(*by, "k", "cell").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy("cell"))
    edge = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    edge = materialize(edge.select(*[F.col(c).alias("p_" + c) for c in by], F.col("cell").alias("p_cell"), (F.col("k") - F.col("upto") + F.col("c")).alias("take"), "c"))
    inside = keyed_join(ranked, edge, same & (F.col("cell") == F.col("p_cell")), "c")
    ties = inside.groupBy(*by, "take", "q").agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(W.partitionBy(*by).orderBy("q"))
    return ties.withColumn("upto", upto).where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("ties") < F.col("take"))).select(*by, "q", "ties", (F.col("take") - F.col("upto") + F.col("ties")).alias("room"))


def columns(docs: DataFrame) -> list[str]:
    """The names that mix gives size, source_size, target and copies beside the columns of docs."""
    return fresh(docs, "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    out = mix(docs, **options)
    copies, each = columns(docs)[3], fresh(out, "each")[0]
    return out.where(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """op12: per document its size, its source's size and target, and the words that the mix takes."""
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
with recursive sized as (
  select doc_id, source is null as none, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint as size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5::double) / {1 << 52}::double as u
  from documents
), doc as (
  select *, case when size > 0 then 16 * (length(bin(size)) - 1) + ((size * 16) >> (length(bin(size)) - 1)) else -1 end::int as stratum from sized
), src as (
  select none, source, sum(size)::bigint as source_size from doc group by 1, 2
), weighed as (
  select *, [5, 2, 1][(row_number() over (order by none, source) - 1) % 3 + 1]::double as w, source_size * {float(MOST)}::double as cap from src
), ordered as (
  select *, row_number() over (order by cap / w, none, source) as j, (sum(source_size) over ())::double * {TIMES}::double as total,
    sum(cap) over (order by cap / w, none, source rows unbounded preceding) - cap as spent,
    sum(w) over () - sum(w) over (order by cap / w, none, source rows unbounded preceding) + w as remaining
  from weighed
), level as (
  select arg_min((total - spent) / remaining, j) as t from ordered where cap >= w * ((total - spent) / remaining)
), tgt as (
  select none, source, source_size, least(cap, w * t) as target from weighed, level
), strata as (
  select d.none, d.source, d.stratum, count(*) as n, sum(d.size)::bigint as words, any_value(t.target) as target, any_value(t.source_size) as source_size,
    row_number() over (partition by d.none, d.source order by d.stratum desc) as i
  from doc d join tgt t on d.none = t.none and d.source = t.source group by 1, 2, 3
), prepared as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as base,
    (('0x' || substr(md5('{SEED}:' || source || ':' || none::varchar || ':' || stratum::varchar), 1, 13))::bigint + 0.5::double) / {1 << 52}::double as v
  from strata
), shares as (
  select *, target - base * source_size as lack, case when source_size > 0 then (target - base * source_size) / source_size else 0 end::double as share from prepared
), fold as (
  select none, source, i, base, n, source_size, target, stratum, k, share * words - k * (words / n) as want, lack - k * (words / n) as remain from (
    select *, case when words > 0 then least(n, greatest(0, least(floor(share * words / (words / n) + v), floor(lack / (words / n))))) else 0 end::bigint as k from shares where i = 1
  )
  union all
  select none, source, i, base, n, source_size, target, stratum, k, want - k * (words / n), remain - k * (words / n) from (
    select s.*, f.want + s.share * s.words as want, f.remain,
      case when s.words > 0 then least(s.n, greatest(0, least(floor((f.want + s.share * s.words) / (s.words / s.n) + s.v), floor(f.remain / (s.words / s.n))))) else 0 end::bigint as k
    from fold f join shares s on f.none = s.none and f.source = s.source and s.i = f.i + 1
  )
), ranked as (
  select *, row_number() over (partition by none, source, stratum order by u) as place from doc
)
select r.doc_id, r.size, f.source_size, f.target, r.size * (f.base + (r.place <= f.k)::bigint) as taken
from ranked r join fold f on r.none = f.none and r.source = f.source and r.stratum = f.stratum
"""
