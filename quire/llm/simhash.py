"""SimHash near-duplicates by multi-index hashing (op2).

A 64-bit fingerprint is cut into two 32-bit segments, each with a hash table. Two
fingerprints that differ in at most two bits differ in at most one bit of some
segment, so probing every value of the radius-1 Hamming ball around each segment
fetches all partners; the complete distance is then verified. Distinct
fingerprints stand for all their documents, so copies are never paired.

A table entry that more than ``BUCKET`` distinct fingerprints share would fetch a
quadratic number of pairs. Only a marker stays in the table for it; fingerprints
that meet a marker enumerate instead the radius-1 ball within each segment of the
whole fingerprint: two of them are within two bits exactly if their balls share a
point, and a point has at most 65 distinct fingerprints around it.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and links
like any other. Texts of fewer than three words are one shingle. Repeated rows
are copies. A null doc_id gets a fingerprint and a component but never names one.
Long texts are hashed whole; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import neardup
from .common import FREQUENT, SEED, bytes_of, components, materialize, sliced, survivors

MAX_BITS, SEGMENT_BITS, BUCKET = 2, 32, 64


def fingerprint(text: str | None, size: int = 3) -> int:
    words = bytes_of(text).lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(s), SEED) for s in zip(*[words[i:] for i in range(size)])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _segments(fps: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), low.alias("v")), F.struct(F.lit(1).alias("t"), high.alias("v")))).alias("s")).select("fp", "s.t", "s.v")


def _masks(bits: int) -> F.Column:
    """Zero and every single bit below bits: the radius-1 ball."""
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(bits)])


def distance(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints: edges that connect exactly what distances of at most two bits connect.

    Pairs that meet in a bucket of at most BUCKET fingerprints are all there;
    larger buckets give stars instead.
    """
    tables = _segments(fps)
    # Joins are by merge: Spark takes an exploded table for no larger than what it was, and would broadcast all probes of a few MB of fingerprints.
    # Sizes of buckets are aggregated before the shuffle; no task holds a bucket that may be large.
    sizes = materialize(tables.groupBy(F.col("t").alias("b_t"), F.col("v").alias("b_v")).agg(F.count("*").alias("n"), F.min("fp").alias("mark")))
    large, same = sizes.where(F.col("n") > BUCKET), (F.col("t") == F.col("b_t")) & (F.col("v") == F.col("b_v"))
    hot = F.broadcast(large.orderBy(F.desc("n")).limit(FREQUENT).select("b_t", "b_v"))
    small = tables.join(hot, same, "left_anti").join(sizes.where(F.col("n") <= BUCKET).hint("merge"), same, "left_semi").select("t", "v", F.col("fp").alias("found"), F.lit(False).alias("large"))
    entries = small.union(large.select("b_t", "b_v", "mark", F.lit(True)))
    probes = _segments(fps).withColumn("mask", F.explode(_masks(SEGMENT_BITS))).withColumn("probe", F.col("v").bitwiseXOR(F.col("mask")))
    met = probes.withColumnRenamed("t", "pt").withColumnRenamed("v", "pv").join(entries.hint("merge"), (F.col("pt") == F.col("t")) & (F.col("probe") == F.col("v")))
    # A pair whose segments differ is found from the larger value only, an equal one from the smaller fingerprint.
    once = F.when(F.col("mask") == 0, F.col("fp") < F.col("found")).otherwise(F.col("probe") < F.col("pv"))
    met = materialize(met.where(F.col("large") | (once & (distance("fp", "found") <= MAX_BITS))).select("fp", "found", "large"))
    near = met.where("not large").select(F.col("fp").alias("u"), F.col("found").alias("v"))
    ball = met.where("large").select("fp").distinct().withColumn("point", F.explode(_masks(64))).withColumn("point", F.col("fp").bitwiseXOR(F.col("point")))
    ball = ball.withColumn("star", F.min("fp").over(W.partitionBy("point"))).where("fp <> star").where(distance("fp", "star") <= MAX_BITS)
    return near.union(ball.select(F.col("fp").alias("u"), F.col("star").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """op2: (key, fingerprint as 16 hex digits, component_id)."""
    prints = materialize(fingerprints(docs, text, key))
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(links(distinct.select("fp")))
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(least, "component").select(F.col("fp").alias("f"), "component_id")
    out = prints.join(of, F.col("fp") == F.col("f"), "left")
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes (h, component) that join what either of two classes of the same h joins."""
    a, edges = materialize(a), []
    for c in (a, materialize(b)):
        least = c.groupBy(F.col("component").alias("of")).agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1")
        edges.append(c.join(least, F.col("component") == F.col("of")).select("h", "least"))
    found = components(edges[0].union(edges[1]), "h", "least")
    return a.select("h").join(found, F.col("h") == F.col("node"), "left").select("h", F.coalesce("component", "h").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of docs, all columns, for each component of fingerprints within MAX_BITS.

    A given similarity links more: texts whose sets of five-word shingles have that Jaccard similarity, and what either joins is one component.
    Fingerprints of 64 bits alone cannot find all of them: at 0.8 such texts differ in about ten bits, and balls of that size hold a
    fixed share of all unlike texts. Those links are found by bands of hashed minima (neardup) and verified.
    """
    prints = materialize(fingerprints(docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")), "text", "h", size).distinct())
    found = components(links(prints.select("fp").distinct()))
    classes = prints.join(found, F.col("fp") == F.col("node"), "left").select("h", F.coalesce("component", "fp").alias("component"))
    if similarity is not None:
        classes = _joined(classes, neardup.classes(docs, text, least=similarity))
    return survivors(docs, classes, text, key)
