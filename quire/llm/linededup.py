"""Line dedup by distinct-site spread (op1).

A line (between newlines, white space at its ends cut) is known by two independent
64-bit hashes. One aggregation merges a HyperLogLog sketch of the sites on which it
stands, together with its first occurrence. Lines whose estimate is far from the
threshold are decided by it; those near it get an exact distinct count of sites.
Lines on at least ``min_sites`` sites are boilerplate and are removed everywhere but
at their first occurrence (smallest document, then position), so text that exists
only as many copies is kept once.

A row decides about its own lines where it stands: the hashes of boilerplate lines
are shared, texts are never shuffled. Of more than ``SMALL`` boilerplate lines the
most frequent are shared; the places of the others, none of which is frequent, come
by a join.

Edge cases: blank lines are never boilerplate. A null text stays null, an empty one
empty. A null site counts as no site. A null doc_id sorts last. Rows that repeat a
doc_id are told apart by their texts, so no row loses a line that it shares with no
other site; rows that repeat both are equal and stay equal. Extra columns pass
through ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, sliced

MIN_SITES, LOG_K = 10, 12
SMALL = 100_000  # boilerplate lines, 32 bytes and an id each, that every worker holds
BLANK = " \t\n\x0b\f\r"
NEAR = (0.5, 2.0)  # times the threshold; the sketch's relative error is 1.6 %
SEED = 42
SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), SEED)  # xxhash64(1, line) hashes the line with this seed


def lines(docs: DataFrame, text: str, key: str, site: str) -> DataFrame:
    """(none, id, h, pos, h1, h2, site) of every line that is not blank; h is the text's hash."""
    one = docs.select(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(site).alias("site"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(BLANK))
    rows = one.select("none", "id", "h", "pos", "site", line.alias("line")).where("line <> ''")
    return rows.select("none", "id", "h", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", key: str = "doc_id", site: str = "source") -> DataFrame:
    """(h1, h2, n, first) of the lines on at least min_sites sites: how often they stand, and their first place (none, id, h, pos)."""
    rows = lines(docs, text, key, site)
    # Partial sketches are merged per line on both sides of the shuffle, so a line on a third of all rows stays small.
    merged = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min(F.struct("none", "id", "h", "pos")).alias("first"))
    sketched = materialize(merged.where(F.col("n") >= min_sites).select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = (int(min_sites * x) for x in NEAR)
    sure = sketched.where(F.col("sites") >= high)
    near = sketched.where((F.col("sites") >= low) & (F.col("sites") < high))
    keys, same = _keys(near)
    if keys.count() <= SMALL:
        exact = rows.join(F.broadcast(keys), same, "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    else:  # distinct (line, site) pairs come before the join, so that no line is a hot key of it
        pairs = rows.where(F.col("site").isNotNull()).select("h1", "h2", "site").distinct()
        exact = pairs.join(keys, same, "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    keys, same = _keys(exact.where(F.col("sites") >= min_sites))
    columns = ["h1", "h2", "n", "first"]
    return materialize(sure.select(*columns).union(near.join(keys, same, "left_semi").select(*columns)))


def _keys(found: DataFrame) -> tuple[DataFrame, Column]:
    """The hashes of lines under names of their own, and the condition that joins them."""
    return found.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))


class Shared:
    """Boilerplate lines, sorted by their first hash, with the place where each stays."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["h1"])
        self.h1 = np.array([r["h1"] for r in rows], np.int64)
        self.rest = [(r["h2"], r["first"]["id"], r["first"]["h"], r["first"]["pos"]) for r in rows]

    def gone(self, parts: list[str], key: object, text: str) -> list[int]:
        """The places of the lines that this text loses."""
        raw = [p.strip(BLANK).encode() for p in parts]
        h1 = np.array([xxhash.xxh64_intdigest(r, SEED) for r in raw], np.uint64).view(np.int64)
        at = np.searchsorted(self.h1, h1)
        at[at == len(self.h1)] = 0
        out = []
        for pos in np.flatnonzero(self.h1[at] == h1).tolist() if len(self.h1) else []:
            i, h2 = int(at[pos]), _signed(xxhash.xxh64_intdigest(raw[pos], SECOND))
            while i < len(self.h1) and self.h1[i] == h1[pos]:
                other, *first = self.rest[i]
                if other == h2 and (first[::2] != [key, pos] or first[1] != _signed(xxhash.xxh64_intdigest(text.encode(), SEED))):
                    out.append(pos)
                i += 1
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _places(docs: DataFrame, rare: DataFrame, text: str, key: str, site: str) -> DataFrame:
    """docs, each row with the places of its rare boilerplate lines, in a last column of its own name."""
    keys = rare.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("first.id").alias("f_id"), F.col("first.h").alias("f_h"), F.col("first.pos").alias("f_pos"))
    hits = lines(docs, text, key, site).join(keys, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    hits = hits.where(~(F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")) & (F.col("pos") == F.col("f_pos"))))
    k, h, places = fresh(docs, "k", "h", "places")
    of = hits.groupBy("id", "h").agg(F.collect_set("pos").alias(places)).withColumnsRenamed({"id": k, "h": h})
    return docs.join(of, docs[key].eqNullSafe(of[k]) & (F.xxhash64(docs[text]) == of[h]), "left").drop(k, h)


def clean(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", key: str = "doc_id", site: str = "source", report: bool = False) -> DataFrame:
    """docs with boilerplate lines removed from the text; report adds n_lines and n_removed. docs is read several times."""
    found = spread(docs, min_sites, text, key, site)
    total, schema = found.count(), docs.schema
    frequent = found if total <= SMALL else found.orderBy(F.desc("n"), "h1", "h2").limit(SMALL)
    shared = docs.sparkSession.sparkContext.broadcast(Shared(frequent.select("h1", "h2", "first").collect()))  # at most SMALL rows
    if total > SMALL:
        least = frequent.agg(F.min("n")).first()[0]
        # Lines as frequent as the least frequent shared one may be in both sets; their places are then found twice.
        docs = _places(docs, materialize(found.where(F.col("n") <= least)), text, key, site)
    extra = len(docs.columns) - len(schema)
    where, own = schema.names.index(text), schema.names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, kept, counts = batch.column(where).to_pylist(), [], []
            places = batch.columns[-1].to_pylist() if extra else [None] * len(texts)
            for t, k, also in zip(texts, batch.column(own).to_pylist(), places):
                parts = [] if t is None else t.split("\n")
                gone = {*shared.value.gone(parts, k, t), *(also or ())} if parts else ()
                kept.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else t)
                counts.append((len(parts), len(gone)))
            columns = [pa.array(kept, pa.string()) if i == where else c for i, c in enumerate(batch.columns[: len(schema)])]
            names = batch.schema.names[: len(schema)]
            if report:
                columns += [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
                names = [*names, *added]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    added = fresh(docs, "n_lines", "n_removed")
    out = schema
    for name in added if report else ():
        out = type(out)([*out.fields, type(out)().add(name, "long").fields[0]])
    return docs.mapInArrow(run, out)


def digest(docs: DataFrame) -> DataFrame:
    """op1: per document the numbers of lines and of removed lines and a digest of the text that stays."""
    out = clean(docs.select("doc_id", "text", "source"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
with raw as (
  select doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents
), line as (
  select doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from raw
), wide as (
  select line, min((doc_id, pos)) as first from line where line <> '' group by line having count(distinct source) >= {MIN_SITES}
), flagged as (
  select l.*, w.line is not null and (l.doc_id, l.pos) <> w.first as gone from line l left join wide w on l.line = w.line
)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_removed,
  sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '')) as text_sha256
from flagged group by doc_id
"""
